"""Queries on density, change points, peaks and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.functions.scalar import rounded
from tripmill.operators import density as de
from tripmill.operators import shape_masks as sm
from tripmill.plans import fixtures as fx
from tripmill.plans.catalog import query
from tripmill.plans.motion_profile import segments_of
from tripmill.plans.sql import chain, r
from tripmill.plans.trip_masks import extremes_sql
from tripmill.plans.trips import good_steps

SEG = ["trj_id", "seg_id"]


def segs(spark, sf):
    return segments_of(fx.points(spark, sf))


@query("density_mask")
def _density(spark, sf):
    return sm.density_mask(segs(spark, sf), SEG, 4)


# Costs of all stretches (a, b] of a segment from sums down the columns of its kernel matrix, then along its rows.
COSTS = """, v AS (SELECT trj_id, seg_id, pos, round(velocity, 3) AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY trj_id, seg_id) AS n
  FROM good WINDOW w AS (PARTITION BY trj_id, seg_id ORDER BY pos)),
pq AS (SELECT p.trj_id, p.seg_id, p.i, q.i AS j, pow(p.x - q.x, 2) AS sq FROM v p JOIN v q ON p.trj_id = q.trj_id AND p.seg_id = q.seg_id AND p.i <= q.i),
md AS (SELECT trj_id, seg_id, coalesce(median(sq) FILTER (i < j), 0.0) AS m FROM pq GROUP BY trj_id, seg_id),
kn AS (SELECT trj_id, seg_id, i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE exp(-least(greatest(sq * CASE WHEN m > 0 THEN 1 / m ELSE 1.0 END, 0.01), 100.0)) END AS k FROM pq JOIN md USING (trj_id, seg_id)),
dn AS (SELECT trj_id, seg_id, i, j, sum(k) OVER (PARTITION BY trj_id, seg_id, j ORDER BY i DESC) AS col FROM kn),
al AS (SELECT trj_id, seg_id, i - 1 AS a, j AS b, sum(2 * col - 1) OVER (PARTITION BY trj_id, seg_id, i ORDER BY j) AS inside FROM dn),
co AS (SELECT trj_id, seg_id, a, b, round((b - a) - inside / (b - a), 9) AS cost FROM al),
sz AS (SELECT DISTINCT trj_id, seg_id, n FROM v)"""


def around_sql(length: int, enough: str) -> str:
    """Masks around the stretch ends ``en`` (trj_id, seg_id, n, stop) of the segments in ``enough``; all masked elsewhere."""
    half = length // 2
    return f""", zr AS (SELECT trj_id, seg_id, CASE WHEN stop - {half} <= 0 THEN 0 WHEN stop + {half} >= n THEN greatest(0, n - {length}) ELSE stop - {half} END AS z FROM en),
hit AS (SELECT DISTINCT trj_id, seg_id, z + o AS i FROM zr, range({length}) t(o))
SELECT v.trj_id, v.seg_id, v.pos, CAST(CASE WHEN e.trj_id IS NOT NULL AND h.i IS NULL THEN 1 ELSE 0 END AS INT) AS mask FROM v
LEFT JOIN ({enough}) e ON e.trj_id = v.trj_id AND e.seg_id = v.seg_id LEFT JOIN hit h ON h.trj_id = v.trj_id AND h.seg_id = v.seg_id AND h.i = v.i - 1"""


PENALISED = chain("good", COSTS + """, ls AS (SELECT trj_id, seg_id, b AS stop, list(cost ORDER BY a) AS costs FROM co WHERE b - a >= 3 GROUP BY trj_id, seg_id, b),
gr AS (SELECT trj_id, seg_id, list(costs ORDER BY stop) AS by_stop FROM ls GROUP BY trj_id, seg_id),
dp AS (SELECT trj_id, seg_id, n, 2::BIGINT AS stop, [0.0::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE] AS best, [[], [], []]::BIGINT[][] AS paths FROM sz
  UNION ALL SELECT trj_id, seg_id, n, stop, list_append(best, list_min(total)), list_append(paths, list_append(paths[list_position(total, list_min(total))], stop))
  FROM (SELECT d.trj_id, d.seg_id, d.n, d.stop + 1 AS stop, d.best, d.paths, list_transform(list_zip(d.best[1:d.stop - 1], g.by_stop[d.stop - 1]), lambda p: p[1] + p[2] + 1.0) AS total
    FROM dp d JOIN gr g ON g.trj_id = d.trj_id AND g.seg_id = d.seg_id WHERE d.stop < d.n)),
en AS (SELECT trj_id, seg_id, n, unnest(paths[n + 1]) AS stop FROM dp WHERE stop = n AND best[n + 1] < 'inf'::DOUBLE)"""
    + around_sql(4, "SELECT trj_id, seg_id FROM en GROUP BY trj_id, seg_id HAVING count(*) > 5"))

FIXED = chain("good", COSTS + """, pl AS (SELECT trj_id, seg_id, n, unnest(list_append(range(0, n, 2), n)) AS p FROM sz),
st AS (SELECT x.trj_id, x.seg_id, y.p AS b, list(CASE WHEN y.p - x.p >= 3 THEN c.cost ELSE 'inf'::DOUBLE END ORDER BY x.p) AS col
  FROM pl x JOIN pl y ON x.trj_id = y.trj_id AND x.seg_id = y.seg_id LEFT JOIN co c ON c.trj_id = x.trj_id AND c.seg_id = x.seg_id AND c.a = x.p AND c.b = y.p GROUP BY x.trj_id, x.seg_id, y.p),
gr AS (SELECT trj_id, seg_id, n, list(col ORDER BY b) AS steps, list_append(range(0, n, 2), n) AS places,
  greatest(0, least(CAST(round_even(round_even(n * 0.15::DOUBLE, 0) / 3.0, 0) AS BIGINT), n // 3 - 1)) AS wanted FROM st JOIN sz USING (trj_id, seg_id) GROUP BY trj_id, seg_id, n),
dp AS (SELECT trj_id, seg_id, n, places, wanted, steps, 0::BIGINT AS c, list_transform(steps, lambda col: col[1]) AS best, []::BIGINT[][] AS backs FROM gr
  UNION ALL SELECT trj_id, seg_id, n, places, wanted, steps, c + 1, list_transform(totals, lambda t: list_min(t)),
    list_append(backs, list_transform(totals, lambda t: list_position(t, list_min(t))))
  FROM (SELECT *, list_transform(steps, lambda col: list_transform(list_zip(best, col), lambda p: p[1] + p[2])) AS totals FROM dp WHERE c < wanted)),
top AS (SELECT trj_id, seg_id, n, places, c, backs FROM dp WHERE c = 0 OR best[len(best)] < 'inf'::DOUBLE QUALIFY c = max(c) OVER (PARTITION BY trj_id, seg_id)),
en AS (SELECT trj_id, seg_id, n, n AS stop, c, backs, places, len(places) AS place FROM top
  UNION ALL SELECT trj_id, seg_id, n, places[backs[c][place]], c - 1, backs, places, backs[c][place] FROM en WHERE c > 0)"""
    + around_sql(3, "SELECT trj_id, seg_id FROM sz"))


def paced(spark, sf):
    return good_steps(spark, sf).withColumn("velocity", F.round("velocity", 3))


@query("change_point_mask", PENALISED)
def _change(spark, sf):
    return sm.change_mask(paced(spark, sf), SEG, "velocity", 4)


@query("change_point_mask_fixed", FIXED)
def _change_fixed(spark, sf):
    return sm.change_mask_fixed(paced(spark, sf), SEG, "velocity", 0.15, 3)


OWN = chain("segs", """, c AS (SELECT trj_id, seg_id, count(*) AS n, (coalesce(var_samp(lat), 0) + 1e-10) * pow(count(*), -1.0 / 3) AS a, (coalesce(var_samp(lon), 0) + 1e-10) * pow(count(*), -1.0 / 3) AS b,
  coalesce(covar_samp(lat, lon), 0) * pow(count(*), -1.0 / 3) AS x FROM segs GROUP BY trj_id, seg_id),
d AS (SELECT p.trj_id, p.seg_id, p.pos, sum(exp(-0.5 * (b * pow(p.lat - q.lat, 2) - 2 * x * (p.lat - q.lat) * (p.lon - q.lon) + a * pow(p.lon - q.lon, 2)) / (a * b - x * x)))
  / (any_value(c.n) * 2 * pi() * sqrt(any_value(a * b - x * x))) AS density
  FROM segs p JOIN segs q USING (trj_id, seg_id) JOIN c USING (trj_id, seg_id) GROUP BY p.trj_id, p.seg_id, p.pos)""")


@query("point_density", OWN + f" SELECT trj_id, seg_id, pos, {r('ln(density)', 4)} AS log_density FROM d")
def _point_density(spark, sf):
    return sm.point_density(segs(spark, sf), SEG).select(*SEG, "pos", rounded(F.log("density"), 4).alias("log_density"))


HEIGHTS = ", s AS (SELECT trj_id, seg_id, pos, 'density' AS feature, count(*) OVER (PARTITION BY trj_id, seg_id) AS n, round(ln(density), 6) AS x FROM d)"


@query("gaussian_density_mask", OWN + extremes_sql("max", HEIGHTS) + """,
z AS (SELECT trj_id, seg_id, CASE WHEN pos - 2 <= 0 THEN 0 WHEN pos + 2 >= n THEN greatest(0, n - 4) ELSE pos - 2 END AS z FROM ext WHERE extreme),
hit AS (SELECT DISTINCT trj_id, seg_id, z + o AS pos FROM z, range(4) t(o))
SELECT e.trj_id, e.seg_id, e.pos, CAST(CASE WHEN changes > 0 AND h.pos IS NULL THEN 1 ELSE 0 END AS INT) AS mask
FROM ext e LEFT JOIN hit h ON h.trj_id = e.trj_id AND h.seg_id = e.seg_id AND h.pos = e.pos""")
def _gaussian(spark, sf):
    return sm.gaussian_mask(segs(spark, sf), SEG, 4)


@query("densest_points", OWN + """, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY round(ln(density), 6) DESC, pos) AS INT) AS place FROM d)
SELECT trj_id, seg_id, pos, place FROM o WHERE place <= 20""")
def _densest(spark, sf):
    d = sm.point_density(segs(spark, sf), SEG).withColumn("density", F.round(F.log("density"), 6))
    return de.densest_points(d, SEG).select(*SEG, "pos", "place")


@query("kde_points", f"""WITH g AS (SELECT CAST(i * 10 AS DOUBLE) AS x FROM range(21) t(i))
SELECT event_type, x, {r('avg(exp(-0.5 * pow((x - value) / 5.0, 2))) / (5.0 * sqrt(2 * pi()))', 9)} AS density FROM events, g GROUP BY event_type, x""")
def _kde(spark, sf):
    out = de.kde_at(fx.table(spark, sf, "events"), "value", [10.0 * i for i in range(21)], 5.0, by=["event_type"])
    return out.withColumn("density", rounded(F.col("density"), 9))


@query("kde_points_epanechnikov", f"""WITH g AS (SELECT CAST(i * 10 AS DOUBLE) AS x FROM range(21) t(i))
SELECT x, {r('avg(CASE WHEN abs(x - value) < 8 THEN 0.75 * (1 - pow((x - value) / 8.0, 2)) ELSE 0 END) / 8.0', 9)} AS density FROM events, g GROUP BY x""")
def _kde_epa(spark, sf):
    out = de.kde_at(fx.table(spark, sf, "events"), "value", [10.0 * i for i in range(21)], 8.0, "epanechnikov")
    return out.withColumn("density", rounded(F.col("density"), 9))


@query("bandwidth_rules", f"""WITH s AS (SELECT least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349) AS a, pow(count(value), -0.2) AS n FROM events)
SELECT {r('0.9 * a * n', 6)} AS silverman, {r('1.059 * a * n', 6)} AS scott FROM s""")
def _rules(spark, sf):
    out = de.bandwidth_rules(fx.table(spark, sf, "events"), "value")
    return out.select(*[rounded(F.col(c), 6).alias(c) for c in out.columns])


@query("bandwidth_scores", """WITH v AS (SELECT l_quantity AS v, CAST(l_orderkey % 30 AS INT) AS fold, count(*) AS c FROM lineitem GROUP BY ALL),
h AS (SELECT CAST(0.5 * i AS DOUBLE) AS h FROM range(1, 31) t(i)), n AS (SELECT fold, sum(c) AS n FROM v GROUP BY fold),
d AS (SELECT e.v, e.fold, e.c, h, sum(t.c * exp(-0.5 * pow((e.v - t.v) / h, 2))) AS s FROM v e JOIN v t ON e.fold <> t.fold, h GROUP BY ALL),
l AS (SELECT h, d.fold, sum(d.c * ln(s / ((SELECT sum(n) FROM n) - n) / h / sqrt(2 * pi()))) AS ll FROM d JOIN n USING (fold) GROUP BY ALL),
m AS (SELECT h AS bandwidth, avg(ll) AS score FROM l GROUP BY h)
SELECT bandwidth, (round(score, 4) + 0.0) AS score, bandwidth = (SELECT arg_max(bandwidth, score) FROM m) AS best FROM m""")
def _scores(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_quantity", (F.col("l_orderkey") % 30).cast("int").alias("fold"))
    out = de.bandwidth_scores(rows, "l_quantity", "fold", [0.5 * i for i in range(1, 31)])
    return out.withColumn("score", rounded(F.col("score"), 4))


@query("kde_grid", chain("segs", f""", b AS (SELECT trj_id, seg_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1, count(*) AS n FROM segs GROUP BY ALL),
g AS (SELECT *, x0 + i * (x1 - x0) / 99 AS x, y0 + j * (y1 - y0) / 99 AS y, i, j FROM b, range(100) a(i), range(100) c(j))
SELECT g.trj_id, g.seg_id, {r('any_value(x)', 9)} AS x, {r('any_value(y)', 9)} AS y, {r('sum(exp(-0.5 * (pow((x - lon) / 0.001, 2) + pow((y - lat) / 0.001, 2)))) / any_value(n) / (2 * pi() * 0.000001)', 2)} AS density
FROM g JOIN segs s USING (trj_id, seg_id) GROUP BY g.trj_id, g.seg_id, i, j"""))
def _grid(spark, sf):
    out = de.kde_grid(segs(spark, sf), SEG, 0.001, 100)
    return out.select(*SEG, rounded(F.col("x"), 9).alias("x"), rounded(F.col("y"), 9).alias("y"), rounded(F.col("density"), 2).alias("density"))


@query("radius_density_peak", chain("segs", f""", b AS (SELECT trj_id, seg_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM segs GROUP BY ALL),
g AS (SELECT *, least(x1 - x0, y1 - y0) / 2 AS rad, x0 + i * (x1 - x0) / 49 AS x, y0 + j * (y1 - y0) / 49 AS y, i, j FROM b, range(50) a(i), range(50) c(j)),
z AS (SELECT g.trj_id, g.seg_id, i, j, any_value(rad) AS rad, any_value(x) AS x, any_value(y) AS y, sum(pow(exp(-3 * sqrt(pow(x - lon, 2) + pow(y - lat, 2)) / rad), 2) / (2 * pi()) / 0.4) AS d FROM g JOIN segs s USING (trj_id, seg_id) GROUP BY g.trj_id, g.seg_id, i, j)
SELECT trj_id, seg_id, {r('x', 9)} AS x, {r('y', 9)} AS y, {r('CASE WHEN rad > 0 THEN d END', 5)} AS density FROM z
QUALIFY row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY CASE WHEN rad > 0 THEN -round(d, 9) ELSE 0 END, i, j) = 1"""))
def _radius(spark, sf):
    peak = de.radius_density_peak(segs(spark, sf), SEG, 50)
    return peak.select(*SEG, *[rounded(F.col(c), places).alias(c) for c, places in (("x", 9), ("y", 9), ("density", 5))])


CUBE = "WITH c AS (SELECT CAST(event_id % 10 AS INT) AS x, CAST(event_id // 10 % 10 AS INT) AS y, CAST(event_id // 100 AS INT) AS z, value FROM events)"


def cube(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select((F.col("event_id") % 10).cast("int").alias("x"), (F.floor(F.col("event_id") / 10) % 10).cast("int").alias("y"),
                    F.floor(F.col("event_id") / 100).cast("int").alias("z"), "value")


@query("local_maxima_3d", CUBE + """ SELECT c.x, c.y, c.z, any_value(c.value) AS value FROM c JOIN c n ON abs(c.x - n.x) <= 1 AND abs(c.y - n.y) <= 1 AND abs(c.z - n.z) <= 1
  AND (c.x, c.y, c.z) <> (n.x, n.y, n.z) GROUP BY c.x, c.y, c.z HAVING count(*) = 26 AND any_value(c.value) > max(n.value)""")
def _maxima(spark, sf):
    return de.local_maxima(cube(spark, sf), ["x", "y", "z"], "value")


@query("grid_peaks", """WITH c AS (SELECT CAST(event_id % 50 AS INT) AS x, CAST(event_id // 50 AS INT) AS y, value FROM events)
SELECT c.x, c.y, any_value(c.value) AS value FROM c JOIN c n ON abs(c.x - n.x) <= 2 AND abs(c.y - n.y) <= 2 AND (c.x, c.y) <> (n.x, n.y)
GROUP BY c.x, c.y HAVING any_value(c.value) >= max(n.value)""")
def _peaks(spark, sf):
    e = fx.table(spark, sf, "events")
    cells = e.select((F.col("event_id") % 50).cast("int").alias("x"), F.floor(F.col("event_id") / 50).cast("int").alias("y"), "value")
    return de.local_maxima(cells, ["x", "y"], "value", 2, strict=False, border=True)


@query("shortest_interval", """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM events),
w AS (SELECT a.event_type, a.value AS lo, b.value AS hi, a.rk FROM s a JOIN s b ON a.event_type = b.event_type AND b.rk = a.rk + floor(0.95::DOUBLE * a.n)),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hi - lo, rk) AS p FROM w) SELECT event_type, lo AS hdi_min, hi AS hdi_max FROM o WHERE p = 1""")
def _hdi(spark, sf):
    return de.shortest_interval(fx.table(spark, sf, "events"), "value", ["event_type"])
