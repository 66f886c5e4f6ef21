"""SQL building blocks for the checks: the common chain as CTEs, written without the library's code."""

from __future__ import annotations

from tripmill.plans.fixtures import POINT_COLUMNS
from tripmill.schema import ACC_LIMIT_5, DRIFT_FACTOR, MISSING_RATE, SPEED_LIMIT_5


def case(column: str, mapping: dict, default: str = "NULL") -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {k} THEN CAST({v!r} AS DOUBLE)" for k, v in mapping.items()) + f" ELSE {default} END"


def h32(*parts: str | int) -> str:
    """The sampling hash of whole-number parts."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(str(p) for p in parts)})), 1, 8) AS BIGINT)"


def distance_ctes(source: str, out: str) -> str:
    """Adds ``d`` and ``h`` (metres and bearing) to rows with lat, lon, lat2, lon2."""
    return f"""
{out}_a AS (SELECT *, atan((1 - 1/298.257223563) * tan(radians(lat))) AS u1,
    atan((1 - 1/298.257223563) * tan(radians(lat2))) AS u2 FROM {source}),
{out}_b AS (SELECT *, 2 * asin(least(1.0, sqrt(pow(sin((u2 - u1) / 2), 2)
    + cos(u1) * cos(u2) * pow(sin(radians(lon2 - lon) / 2), 2)))) AS sg FROM {out}_a),
{out} AS (SELECT * EXCLUDE (u1, u2, sg),
    CASE WHEN sg = 0 THEN 0.0 ELSE 6378137.0 * (sg - 1/298.257223563/2 * (
        (sg - sin(sg)) * pow(sin((u1 + u2) / 2) * cos((u2 - u1) / 2) / cos(sg / 2), 2)
      + (sg + sin(sg)) * pow(cos((u1 + u2) / 2) * sin((u2 - u1) / 2) / sin(sg / 2), 2))) END AS d,
    fmod(degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)),
        cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360.0, 360.0) AS h
  FROM {out}_b)"""


POINTS = f"points AS ({POINT_COLUMNS} FROM events)"

VALID = """
near AS (
  SELECT *, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS ok,
    lag(t, 1) OVER w AS t1, lag(t, 2) OVER w AS t2, lead(t) OVER w AS tn,
    lag(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, 1) OVER w AS ok1,
    lag(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, 2) OVER w AS ok2
  FROM points WINDOW w AS (PARTITION BY trj_id ORDER BY k)),
walk AS (
  SELECT trj_id, k, false AS gone FROM near WHERE k = 0
  UNION ALL
  SELECT n.trj_id, n.k,
    CASE WHEN n.t - (CASE WHEN w.gone THEN n.t2 ELSE n.t1 END) <= 0 THEN true
         WHEN NOT (CASE WHEN w.gone THEN n.ok2 ELSE n.ok1 END) THEN false
         ELSE NOT n.ok END
  FROM walk w JOIN near n ON n.trj_id = w.trj_id AND n.k = w.k + 1),
kept AS (
  SELECT n.trj_id, n.k, n.label, n.t, n.lat, n.lon FROM near n JOIN walk w USING (trj_id, k)
  WHERE NOT w.gone AND NOT (n.tn IS NOT NULL AND n.tn > n.t AND NOT n.ok)
    AND n.trj_id IN (SELECT trj_id FROM points GROUP BY trj_id HAVING count(*) >= 10)),
valid AS (SELECT * FROM kept WHERE trj_id IN (SELECT trj_id FROM kept GROUP BY trj_id HAVING count(*) >= 10))"""

TRIMMED = """
edges AS (SELECT quantile_cont(lat, 0.01) AS a1, quantile_cont(lat, 0.99) AS a9,
                 quantile_cont(lon, 0.01) AS o1, quantile_cont(lon, 0.99) AS o9 FROM valid),
inside AS (SELECT v.* FROM valid v, edges WHERE NOT ((lat <= a1 OR lat >= a9) AND (lon <= o1 OR lon >= o9))),
trimmed AS (SELECT * FROM inside WHERE trj_id IN (SELECT trj_id FROM inside GROUP BY trj_id HAVING count(*) >= 10))"""


def segs(source: str) -> str:
    return f"""
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1200 THEN 1 ELSE 0 END AS cut,
    row_number() OVER w - 1 AS place FROM {source} WINDOW w AS (PARTITION BY trj_id ORDER BY k)),
stays AS (SELECT *, sum(cut) OVER (PARTITION BY trj_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS stay_id FROM gaps),
parts AS (SELECT *, min(place) OVER (PARTITION BY trj_id, stay_id) AS start FROM stays),
chunks AS (SELECT trj_id, k, label, t, lat, lon, CAST(stay_id AS BIGINT) AS stay_id,
    CAST(start + (place - start) // 200 * 200 AS BIGINT) AS seg_id,
    CAST((place - start) % 200 AS INT) AS pos, (place - start) // 200 AS chunk FROM parts),
sized AS (SELECT *, CAST(count(*) OVER (PARTITION BY trj_id, seg_id) AS INT) AS n_points FROM chunks),
segs AS (SELECT trj_id, k, label, t, lat, lon, seg_id, pos, n_points FROM sized WHERE chunk = 0 OR n_points > 10)"""


def steps(source: str, out: str = "steps", keys: str = "trj_id, seg_id") -> str:
    """Recursive walk over the steps of each segment, remembering accepted steps only."""
    on = " AND ".join(f"r.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    return f"""
{out}_pair AS (SELECT {keys}, pos, label, t, lat, lon, lead(t) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2
    FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY pos)),
{out}_open AS (SELECT * FROM {out}_pair WHERE t2 IS NOT NULL),
{distance_ctes(out + "_open", out + "_dist")},
{out}_raw AS (SELECT {keys}, pos, label, t2 - t AS dt, CAST(floor(t / 3600) % 24 AS INT) AS hour, d, h,
    CASE WHEN t2 <> t THEN d / (t2 - t) END AS v, (t + t2) / 2 AS ts_mid,
    {case("label", SPEED_LIMIT_5)} AS vmax, {case("label", ACC_LIMIT_5)} AS amax FROM {out}_dist),
{out}_walk AS (
  SELECT {keys}, pos, 0.0::DOUBLE AS pv, 0.0::DOUBLE AS ph,
         coalesce(dt > 0 AND abs(v) <= vmax AND abs(v / dt) <= amax, false) AS acc, v, h
  FROM {out}_raw WHERE pos = 0
  UNION ALL
  SELECT {", ".join("r." + k.strip() for k in keys.split(","))}, r.pos,
         CASE WHEN w.acc THEN w.v ELSE w.pv END, CASE WHEN w.acc THEN w.h ELSE w.ph END,
         coalesce(r.dt > 0 AND abs(r.v) <= r.vmax AND abs((r.v - CASE WHEN w.acc THEN w.v ELSE w.pv END) / r.dt) <= r.amax, false),
         r.v, r.h
  FROM {out}_walk w JOIN {out}_raw r ON {on} AND r.pos = w.pos + 1),
{out}_all AS (SELECT {keys}, pos, r.label, w.acc AS accepted, r.dt AS delta_t, r.hour, r.d AS distance, r.v AS velocity,
    (r.v - w.pv) / r.dt AS acceleration, (r.v - w.pv) / r.dt / r.dt AS jerk, r.h AS heading, abs(r.h - w.ph) AS heading_change,
    abs(r.h - w.ph) / r.dt AS heading_change_rate, r.ts_mid FROM {out}_raw r JOIN {out}_walk w USING ({keys}, pos)),
{out} AS (SELECT *, CAST(count(*) FILTER (accepted) OVER (PARTITION BY {keys}) AS INT) AS n_accepted FROM {out}_all)"""


def spline(knots: str, at: str) -> str:
    """CTEs up to ``curve`` (trj_id, seg_id, pos, ya, yb): a not-a-knot cubic through ``knots`` (i, x, ya, yb, m) at ``at`` (pos, q)."""
    key, w = "trj_id, seg_id", "WINDOW w AS (PARTITION BY trj_id, seg_id ORDER BY i)"
    near = ", ".join(f"{fn}({c}, {k}) OVER w AS {c}_{fn[:2]}{k}" for c in ("h", "sa", "sb") for fn, k in (("lag", 1), ("lag", 2), ("lead", 1)))

    def right(s: str) -> str:
        return f"""CASE WHEN i = 0 THEN ((h + 2 * (h + h_le1)) * h_le1 * {s} + h * h * {s}_le1) / (h + h_le1)
    WHEN i = m - 1 THEN (h_la1 * h_la1 * {s}_la2 + (2 * (h_la1 + h_la2) + h_la1) * h_la2 * {s}_la1) / (h_la1 + h_la2)
    ELSE 3 * (h * {s}_la1 + h_la1 * {s}) END"""

    return f"""
sp_h AS (SELECT *, lead(x) OVER w - x AS h, (lead(ya) OVER w - ya) / (lead(x) OVER w - x) AS sa, (lead(yb) OVER w - yb) / (lead(x) OVER w - x) AS sb FROM {knots} {w}),
sp_n AS (SELECT *, {near} FROM sp_h {w}),
sp_r AS MATERIALIZED (SELECT {key}, i, m, CASE WHEN i = m - 1 THEN h_la1 + h_la2 ELSE h END AS lo, CASE WHEN i = 0 THEN h + h_le1 ELSE h_la1 END AS up,
  CASE WHEN i = 0 THEN h_le1 WHEN i = m - 1 THEN h_la2 ELSE 2 * (h_la1 + h) END AS di, {right("sa")} AS pa, {right("sb")} AS pb FROM sp_n),
sp_d AS (SELECT {key}, i, m, up, di, pa, pb FROM sp_r WHERE i = 0
  UNION ALL SELECT r.trj_id, r.seg_id, r.i, r.m, r.up, r.di - r.lo / d.di * d.up, r.pa - r.lo / d.di * d.pa, r.pb - r.lo / d.di * d.pb
  FROM sp_d d JOIN sp_r r ON r.trj_id = d.trj_id AND r.seg_id = d.seg_id AND r.i = d.i + 1),
sp_m AS MATERIALIZED (SELECT * FROM sp_d),
sp_u AS (SELECT {key}, i, pa / di AS da, pb / di AS db FROM sp_m WHERE i = m - 1
  UNION ALL SELECT d.trj_id, d.seg_id, d.i, (d.pa - d.up * u.da) / d.di, (d.pb - d.up * u.db) / d.di
  FROM sp_u u JOIN sp_m d ON d.trj_id = u.trj_id AND d.seg_id = u.seg_id AND d.i = u.i - 1),
sp_p AS (SELECT {key}, i, x, h, ya, yb, sa, sb, da, db, (da + lead(da) OVER w - 2 * sa) / h AS ba, (db + lead(db) OVER w - 2 * sb) / h AS bb FROM sp_h JOIN sp_u USING ({key}, i) {w}),
curve AS (SELECT a.trj_id, a.seg_id, a.pos, ya + u * (da + u * ((sa - da) / h - ba + u * ba / h)) AS ya, yb + u * (db + u * ((sb - db) / h - bb + u * bb / h)) AS yb
  FROM (SELECT a.*, p.* EXCLUDE ({key}), a.q - p.x AS u FROM {at} a ASOF JOIN (FROM sp_p WHERE h IS NOT NULL) p
    ON a.trj_id = p.trj_id AND a.seg_id = p.seg_id AND a.q >= p.x) a)"""


CHAIN = {
    "points": POINTS, "valid": VALID, "trimmed": TRIMMED, "segs": segs("valid"), "steps": steps("segs"),
    "good": "good AS (SELECT * FROM steps WHERE n_accepted >= 10)",
}


def chain(upto: str, body: str, trim: bool = False) -> str:
    """``WITH`` the chain up to a stage, then ``body``; body may open with further CTEs after a comma."""
    names = ["points", "valid", *(["trimmed"] if trim else []), "segs", "steps", "good"]
    parts = dict(CHAIN, segs=segs("trimmed" if trim else "valid"))
    used = [parts[n] for n in names[: names.index(upto) + 1]]
    return "WITH RECURSIVE " + ",\n".join(used) + "\n" + body


def r(expr: str, digits: int = 4) -> str:
    return f"(round({expr}, {digits}) + 0.0)"
