"""Queries on noise and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.functions.scalar import rounded
from tripmill.operators import augment, clean, motion, noise
from tripmill.plans import fixtures as fx
from tripmill.plans.catalog import query
from tripmill.plans.motion_profile import segments_of
from tripmill.session import stage
from tripmill.plans.sql import case, chain, distance_ctes, h32, r, spline, steps
from tripmill.plans.trips import steps_of
from tripmill.schema import DRIFT_FACTOR, MISSING_RATE

SEG = ["trj_id", "seg_id"]


def clean_segments(spark, sf):
    """Clean segments as a stage table: noise reads them once for the draw and once for the points."""
    return stage(motion.clean_segments(segments_of(fx.points(spark, sf))), "clean")


CLEAN = """,
bad AS (SELECT DISTINCT trj_id, seg_id, CASE WHEN delta_t <= 0 THEN pos + 1 ELSE pos END AS pos FROM steps WHERE NOT accepted),
cl AS (SELECT s.*, count(*) OVER (PARTITION BY trj_id, seg_id) AS m FROM segs s ANTI JOIN bad USING (trj_id, seg_id, pos) WHERE n_points >= 10),
base AS (SELECT trj_id, seg_id, label, t, lat, lon, CAST(row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY pos) - 1 AS INT) AS pos, CAST(m AS INT) AS n FROM cl WHERE m >= 10)"""


def u(seed: int | str, purpose: int, *keys: str) -> str:
    return f"(CAST({h32(seed, purpose, *keys)} AS DOUBLE) / 4294967296.0)"


def gauss(seed: int | str, purpose: int, *keys: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u(seed, purpose, *keys)})) * cos(2 * pi() * {u(seed, purpose + 1, *keys)}))"


def noisy(*settings: tuple) -> str:
    """CTEs up to ``noisy``: ``base`` under each (name, then level and seed of drift, lost runs and outliers)."""
    real = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    rows = ", ".join(f"('{name}', " + ", ".join(real(float(v)) if i % 2 == 0 else str(v) for i, v in enumerate(rest)) + ")" for name, *rest in settings)
    rank = ", ".join(f"row_number() OVER (PARTITION BY cfg ORDER BY {h32(0, f's{i}', 'trj_id', 'seg_id')}, trj_id, seg_id) AS r{i}" for i in (1, 2, 3))
    key = "cfg, trj_id, seg_id"
    on = " AND ".join(f"s.{k} = a.{k}" for k in key.split(", "))
    word = lambda at: f"CAST(CAST('0x' || substr(m, {at}, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    return f""",
cfg AS MATERIALIZED (SELECT * FROM (VALUES {rows}) v(cfg, l1, s1, l2, s2, l3, s3)),
heads AS MATERIALIZED (SELECT *, r1 <= floor(c * l1) AS p1, r2 <= floor(c * l2) AS p2, r3 <= floor(c * l3) AS p3 FROM
  (SELECT cfg.*, trj_id, seg_id, label, n, count(*) OVER (PARTITION BY cfg) AS c, {rank} FROM base, cfg WHERE pos = 0)),
b0 AS MATERIALIZED (SELECT h.cfg, b.* FROM heads h JOIN base b USING (trj_id, seg_id)),
pr AS (SELECT b0.*, l1, s1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2
  FROM b0 JOIN (SELECT {key}, l1, s1 FROM heads WHERE p1) USING ({key}) WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
{distance_ctes("pr", "ds")},
sc AS MATERIALIZED (SELECT *, avg(CASE WHEN lat2 IS NOT NULL THEN d END) OVER v * (0.05 + l1 * 0.10) * {case("label", DRIFT_FACTOR, "1.0")} / 111000.0 AS sg,
  cos(radians(avg(lat) OVER v)) AS shrink, {gauss("s1", 10, "trj_id", "seg_id", "pos")} * CASE WHEN pos = 0 THEN 1 ELSE sqrt(1 - 0.49) END AS ea,
  {gauss("s1", 20, "trj_id", "seg_id", "pos")} * CASE WHEN pos = 0 THEN 1 ELSE sqrt(1 - 0.49) END AS eo
  FROM ds WINDOW v AS (PARTITION BY {key})),
ar AS (SELECT {key}, pos, ea AS xa, eo AS xo FROM sc WHERE pos = 0
  UNION ALL SELECT s.cfg, s.trj_id, s.seg_id, s.pos, 0.7 * a.xa + s.ea, 0.7 * a.xo + s.eo FROM ar a JOIN sc s ON {on} AND s.pos = a.pos + 1),
d1 AS MATERIALIZED (SELECT {key}, label, t, least(90.0, greatest(-90.0, lat + xa * sg)) AS lat, least(180.0, greatest(-180.0, lon + xo * sg / shrink)) AS lon, pos
  FROM sc JOIN ar USING ({key}, pos)
  UNION ALL SELECT {key}, label, t, lat, lon, pos FROM b0 ANTI JOIN (SELECT {key} FROM heads WHERE p1) USING ({key})),
wanted AS (SELECT {key}, n, s2, least(CAST(floor(n * least(CAST(0.4 AS DOUBLE), {case("label", MISSING_RATE, "CAST(0.1 AS DOUBLE)")} * (1 + l2 * 2))) AS BIGINT), n - 10) AS want FROM heads WHERE p2),
lose AS (SELECT {key}, n, s2, CAST(0 AS BIGINT) AS i, CAST(want AS BIGINT) AS todo, CAST([] AS BIGINT[]) AS gone FROM wanted WHERE want > 0
  UNION ALL SELECT {key}, n, s2, i + 1, CASE WHEN met THEN todo ELSE todo - size END, CASE WHEN met THEN gone ELSE list_concat(gone, range(st, st + size)) END
  FROM (SELECT *, list_has_any(gone, range(st, st + size)) AS met
  FROM (SELECT *, CAST(floor(u3 * (n - size)) AS BIGINT) AS st
  FROM (SELECT *, low + CAST(floor(u2 * (most - low + 1)) AS BIGINT) AS size
  FROM (SELECT *, CASE WHEN kind = 15 AND most >= 9 THEN 9 WHEN kind >= 8 AND most >= 4 THEN 4 ELSE 1 END AS low
  FROM (SELECT *, least(kind, todo) AS most
  FROM (SELECT *, CASE WHEN u1 < 0.7 THEN 3 WHEN u1 < 0.95 THEN 8 ELSE 15 END AS kind
  FROM (SELECT *, {word(1)} AS u1, {word(9)} AS u2, {word(17)} AS u3
  FROM (SELECT *, md5(concat_ws('|', s2, trj_id, seg_id, i)) AS m FROM lose WHERE todo > 0))))))))),
d2 AS MATERIALIZED (SELECT {key}, label, t, lat, lon, CAST(row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS INT) AS pos,
  CAST(count(*) OVER (PARTITION BY {key}) AS INT) AS n
  FROM d1 ANTI JOIN (SELECT {key}, unnest(gone) AS pos FROM lose WHERE todo = 0) USING ({key}, pos)),
o1 AS (SELECT d2.*, p3, {u("s3", 30, "trj_id", "seg_id")} AS u0, {u("s3", 31, "trj_id", "seg_id", "pos")} AS u1, {u("s3", 32, "trj_id", "seg_id", "pos")} AS u2,
  {u("s3", 33, "trj_id", "seg_id", "pos")} AS u3, least(4, n // 5 + 1) AS most, pos >= 1 AND pos <= n - 2 AS inside_,
  (lag(lat) OVER w + lead(lat) OVER w) / 2 AS ml, (lag(lon) OVER w + lead(lon) OVER w) / 2 AS mo
  FROM d2 JOIN (SELECT {key}, p3, s3 FROM heads) USING ({key}) WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY NOT inside_, u1, pos) AS rk,
  CASE WHEN most <= 1 THEN 1 ELSE 1 + floor(u0 * (most - 1)) END AS q FROM o1),
o3 AS (SELECT *, p3 AND inside_ AND rk <= q AS hit FROM o2),
noisy AS MATERIALIZED (SELECT {key}, label, t, pos, n,
  CASE WHEN hit THEN least(90.0, greatest(-90.0, ml + (50 + 150 * u2) * cos(2 * pi() * u3) / 111000)) ELSE lat END AS lat,
  CASE WHEN hit THEN least(180.0, greatest(-180.0, mo + (50 + 150 * u2) * sin(2 * pi() * u3) / (111000 * cos(radians(ml))))) ELSE lon END AS lon FROM o3)"""


def setting(name: str, kind: str, level: float) -> tuple:
    """Levels and seeds of one noise set."""
    if kind == "mixed":
        return name, level * 0.8, 42, level * 0.6, 43, level * 0.3, 44
    return name, *(x for k in ("drift", "missing", "outlier") for x in (level if k == kind else 0.0, 42))


SETS = [setting(f"{kind}_{round(level * 100)}_percent", kind, level) for kind in noise.SWEEP_KINDS for level in noise.SWEEP_LEVELS]
PLACES = f" SELECT trj_id, seg_id, pos, {r('lat', 8)} AS lat, {r('lon', 8)} AS lon FROM noisy"
THINNED = f" SELECT trj_id, seg_id, pos, n AS n_points, t, {r('lat', 8)} AS lat, {r('lon', 8)} AS lon FROM noisy"


def places(rows, *columns: str):
    return rows.select(*SEG, "pos", *columns, rounded(F.col("lat"), 8).alias("lat"), rounded(F.col("lon"), 8).alias("lon"))


@query("noise_statistics", chain("steps", " SELECT " + ", ".join(
    f"{r(f'coalesce({fn}({c}) FILTER ({cond}), {d})')} AS {name}_{c}_{short}"
    for name, cond in (("noise", "NOT accepted"), ("clean", "accepted")) for c in ("velocity", "acceleration", "distance")
    for fn, short, d in (("avg", "mean", "0.0"), ("stddev_pop", "std", "1.0"))
) + f", {r('avg(CAST(NOT accepted AS DOUBLE))', 6)} AS noise_ratio FROM steps WHERE delta_t > 0"))
def _stats(spark, sf):
    out = noise.noise_statistics(steps_of(spark, sf))
    return out.select(*[rounded(F.col(c), 6 if c == "noise_ratio" else 4).alias(c) for c in out.columns])


@query("chosen_segments", chain("steps", CLEAN + noisy(setting("x", "drift", 0.3)) + " SELECT trj_id, seg_id FROM heads WHERE p1"))
def _chosen(spark, sf):
    return noise.choose_segments(noise.heads_of(clean_segments(spark, sf)), 0.3, 42)


@query("inject_drift", chain("steps", CLEAN + noisy(setting("x", "drift", 0.3)) + PLACES))
def _drift(spark, sf):
    return places(noise.add_drift(clean_segments(spark, sf), 0.3, 42))


@query("inject_missing", chain("steps", CLEAN + noisy(setting("x", "missing", 0.3)) + THINNED))
def _missing(spark, sf):
    return places(noise.drop_runs(clean_segments(spark, sf), 0.3, 42), "n_points", "t")


@query("inject_outliers", chain("steps", CLEAN + noisy(setting("x", "outlier", 0.3)) + PLACES))
def _outliers(spark, sf):
    return places(noise.add_outliers(clean_segments(spark, sf), 0.3, 42))


@query("inject_mixed", chain("steps", CLEAN + noisy(setting("x", "mixed", 0.3)) + THINNED))
def _mixed(spark, sf):
    return places(noise.add_mixed(clean_segments(spark, sf), 0.3, 42), "n_points", "t")


@query("noise_sweep", chain("steps", CLEAN + noisy(*SETS) + f""" SELECT cfg AS noise_config, count(*) FILTER (pos = 0) AS segments, count(*) AS n_points,
  {r("avg(lat)", 6)} AS avg_lat, {r("avg(lon)", 6)} AS avg_lon FROM noisy GROUP BY cfg"""))
def _sweep(spark, sf):
    """Segments, points left and mean place per configuration."""
    rows = noise.noise_sweep(clean_segments(spark, sf))
    return rows.groupBy("noise_config").agg(
        F.count(F.when(F.col("pos") == 0, 1)).alias("segments"), F.count(F.lit(1)).alias("n_points"),
        rounded(F.avg("lat"), 6).alias("avg_lat"), rounded(F.avg("lon"), 6).alias("avg_lon"))


RATIOS = f""",
x AS (SELECT count(*) FILTER (NOT accepted) / greatest(count(*), 1) AS q FROM sa WHERE delta_t > 0),
y AS (SELECT cfg, count(*) FILTER (NOT accepted) / greatest(count(*), 1) AS q FROM sb WHERE delta_t > 0 GROUP BY cfg)
SELECT cfg AS noise_config, {r("y.q", 6)} AS generated_noise_ratio, {r("x.q", 6)} AS original_noise_ratio, {r("abs(y.q - x.q)", 6)} AS ratio_difference FROM x, y"""


def ratios(rows):
    return rows.select("noise_config", *[rounded(F.col(c), 6).alias(c) for c in rows.columns if c != "noise_config"])


@query("noise_ratio_check", chain("steps", CLEAN + noisy(*SETS) + ", " + steps("base", "sa") + ", " + steps("noisy", "sb", "cfg, trj_id, seg_id") + RATIOS))
def _ratio_sweep(spark, sf):
    """Implausible steps before and after each of the 16 configurations."""
    base = clean_segments(spark, sf)
    changed = motion.step_features(noise.noise_sweep(base, changed_only=True), keys=["noise_config", *SEG])
    return ratios(noise.changed_ratio_check(motion.step_features(base), changed, noise.sweep_names()))


@query("outlier_ratio_check", chain("steps", CLEAN + noisy(setting("outlier", "outlier", 0.3)) + f""",
dirty AS (SELECT * REPLACE ({r("lat", 8)} AS lat, {r("lon", 8)} AS lon) FROM noisy), """ + steps("base", "sa") + ", " + steps("dirty", "sb", "cfg, trj_id, seg_id") + RATIOS))
def _ratio(spark, sf):
    base = clean_segments(spark, sf)
    noisy_rows = noise.add_outliers(base, 0.3, 42)
    noisy_rows = noisy_rows.withColumn("lat", rounded(F.col("lat"), 8)).withColumn("lon", rounded(F.col("lon"), 8))
    dirty = motion.step_features(noisy_rows).withColumn("noise_config", F.lit("outlier"))
    return ratios(noise.noise_ratio_check(motion.step_features(base), dirty, ["noise_config"]))


TRIP = " FROM points"


@query("reverse_trips", chain("points", """, n AS (SELECT *, max(k) OVER (PARTITION BY trj_id) + 1 AS n FROM points)
SELECT a.trj_id, a.k, a.t, b.lat, b.lon FROM n a JOIN n b ON a.trj_id = b.trj_id AND b.k = a.n - 1 - a.k"""))
def _reverse(spark, sf):
    return augment.reverse(fx.points(spark, sf)).select("trj_id", "k", "t", "lat", "lon")


ANGLE = [f"2 * pi() * {u(42, i, 'trj_id')}" for i in range(10)]


@query("rotate_trips", chain("points", ", ok AS (SELECT trj_id, " + ", ".join(
    f"bool_and(cos({a}) * lat - sin({a}) * lon BETWEEN -90 AND 90 AND sin({a}) * lat + cos({a}) * lon BETWEEN -180 AND 180) AS o{i}" for i, a in enumerate(ANGLE)
) + " FROM points GROUP BY trj_id), an AS (SELECT trj_id, CASE " + " ".join(f"WHEN o{i} THEN {a}" for i, a in enumerate(ANGLE)) + f""" ELSE 0.0 END AS a FROM ok)
SELECT trj_id, k, {r("cos(a) * lat - sin(a) * lon", 6)} AS lat, {r("sin(a) * lat + cos(a) * lon", 6)} AS lon FROM points JOIN an USING (trj_id)"""))
def _rotate(spark, sf):
    out = augment.rotate(fx.points(spark, sf))
    return out.select("trj_id", "k", rounded(F.col("lat"), 6).alias("lat"), rounded(F.col("lon"), 6).alias("lon"))


@query("translate_trips", chain("points", f""" SELECT trj_id, k, {r(f"lat - 0.001 + 0.002 * {u(42, 50, 'trj_id')}", 9)} AS lat,
  {r(f"lon - 0.001 + 0.002 * {u(42, 51, 'trj_id')}", 9)} AS lon FROM points"""))
def _translate(spark, sf):
    out = augment.translate(fx.points(spark, sf))
    return out.select("trj_id", "k", rounded(F.col("lat"), 9).alias("lat"), rounded(F.col("lon"), 9).alias("lon"))


@query("crop_trips", chain("points", f""", n AS (SELECT trj_id, max(k) + 1 AS n FROM points GROUP BY trj_id),
l AS (SELECT *, CASE WHEN n <= 10 THEN n ELSE 10 + CAST(floor({u(42, 60, 'trj_id')} * (n - 9)) AS BIGINT) END AS len FROM n),
s AS (SELECT *, CAST(floor({u(42, 61, 'trj_id')} * (n - len + 1)) AS BIGINT) AS st FROM l)
SELECT p.trj_id, p.k - st AS k, p.t - CASE WHEN n > 10 THEN z.t ELSE 0 END AS t, p.lat, p.lon FROM points p JOIN s USING (trj_id)
  JOIN points z ON z.trj_id = p.trj_id AND z.k = st WHERE p.k >= st AND p.k < st + len"""))
def _crop(spark, sf):
    return augment.crop(fx.points(spark, sf)).select("trj_id", "k", "t", "lat", "lon")


@query("swap_coordinates", chain("points", " SELECT trj_id, k, lon AS lat, lat AS lon FROM points"))
def _swap(spark, sf):
    return augment.swap_coordinates(fx.points(spark, sf)).select("trj_id", "k", "lat", "lon")


@query("turning_copies", chain("points", f""",
d AS (SELECT *, sqrt(pow(lat - lag(lat) OVER w, 2) + pow(lon - lag(lon) OVER w, 2)) AS d FROM points WINDOW w AS (PARTITION BY trj_id ORDER BY k)),
g AS (SELECT trj_id FROM d GROUP BY trj_id HAVING sqrt(pow(arg_max(lat, k) - arg_min(lat, k), 2) + pow(arg_max(lon, k) - arg_min(lon, k), 2)) < 0.5 * sum(d))
SELECT trj_id, k, CAST(copy AS INT) AS copy, {r("lat + dx", 9)} AS lat, {r("lon + dy", 9)} AS lon FROM points SEMI JOIN g USING (trj_id),
  (VALUES (0, -0.1, 0.0), (1, 0.1, 0.0), (2, 0.0, -0.1), (3, 0.0, 0.1)) o(copy, dx, dy)"""))
def _turning(spark, sf):
    p = fx.points(spark, sf)
    out = augment.turning_copies(p, longest=clean.longest_group(p))
    return out.select("trj_id", "k", "copy", rounded(F.col("lat"), 9).alias("lat"), rounded(F.col("lon"), 9).alias("lon"))


def uneven_points(spark, sf):
    """Points with classes of unequal size: labels by the trip number modulo 7, 5 and 6 folded."""
    label = F.when(F.col("trj_id") % 7 >= 5, 0).otherwise(F.col("trj_id") % 7).cast("int")
    return fx.points(spark, sf).withColumn("label", label)


@query("balance_counts", chain("points", """, c AS (SELECT CAST(CASE WHEN trj_id % 7 >= 5 THEN 0 ELSE trj_id % 7 END AS INT) AS label, count(DISTINCT trj_id) AS n FROM points GROUP BY 1)
SELECT label, n AS before, (SELECT max(n) FROM c) AS after FROM c"""))
def _balance(spark, sf):
    rows = augment.balance_classes(uneven_points(spark, sf)).where("k = 0")
    return rows.groupBy("label").agg(F.count(F.when(F.col("copy") == 0, 1)).alias("before"), F.count(F.lit(1)).alias("after"))


def copy_draw(purpose):
    return u(42, purpose, "label", "copy")


# A copy is a row of lists, changed by one method after the other.
COPIES = chain("points", f""", tr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h32(42, "trj_id")}, trj_id) AS rnk, count(*) OVER (PARTITION BY label) AS c
  FROM (SELECT trj_id, CAST(CASE WHEN trj_id % 7 >= 5 THEN 0 ELSE trj_id % 7 END AS INT) AS label, list(t ORDER BY k) AS t, list(lat ORDER BY k) AS a, list(lon ORDER BY k) AS o FROM points GROUP BY trj_id)),
pk AS (SELECT label, copy, CAST(floor({copy_draw(70)} * c) AS BIGINT) + 1 AS rnk
  FROM (SELECT DISTINCT label, c, unnest(range(1, (SELECT max(c) FROM tr) - c + 1)) AS copy FROM tr)),
dr AS (SELECT trj_id, label, copy, t, a, o, len(t) AS n, -0.001 + 0.002 * {copy_draw(93)} AS dx, -0.001 + 0.002 * {copy_draw(94)} AS dy,
  list_sort([{", ".join(f"{{'u': {copy_draw(80 + i)}, 'm': '{m}'}}" for i, m in enumerate(("reverse", "rotate", "translate", "crop")))}])[1:1 + CAST(floor({copy_draw(90)} * 4) AS BIGINT)] AS todo,
  [{", ".join(f"2 * pi() * {copy_draw(100 + i)}" for i in range(augment.ROTATION_TRIES))}] AS angles,
  10 + CAST(floor({copy_draw(91)} * (len(t) - 9)) AS BIGINT) AS size, {copy_draw(92)} AS rest FROM pk JOIN tr USING (label, rnk)),
st AS (SELECT 0 AS step, trj_id, label, copy, t, a, o, dx, dy, todo, angles, size, rest FROM dr
  UNION ALL SELECT step + 1, trj_id, label, copy,
    CASE WHEN m = 'crop' AND n > 10 THEN list_transform(t[lo + 1:lo + size], lambda x: x - t[lo + 1]) ELSE t END,
    CASE WHEN m = 'crop' AND n > 10 THEN a[lo + 1:lo + size] WHEN m = 'reverse' THEN list_reverse(a) WHEN m = 'translate' THEN list_transform(a, lambda x: x + dx)
      WHEN m = 'rotate' AND g IS NOT NULL THEN list_transform(list_zip(a, o), lambda p: cos(g) * p[1] - sin(g) * p[2]) ELSE a END,
    CASE WHEN m = 'crop' AND n > 10 THEN o[lo + 1:lo + size] WHEN m = 'reverse' THEN list_reverse(o) WHEN m = 'translate' THEN list_transform(o, lambda x: x + dy)
      WHEN m = 'rotate' AND g IS NOT NULL THEN list_transform(list_zip(a, o), lambda p: sin(g) * p[1] + cos(g) * p[2]) ELSE o END,
    dx, dy, todo, angles, size, rest
  FROM (SELECT *, todo[step + 1].m AS m, len(t) AS n, CAST(floor(rest * (len(t) - size + 1)) AS BIGINT) AS lo,
      list_filter(angles, lambda g: len(list_filter(list_zip(a, o), lambda p: abs(cos(g) * p[1] - sin(g) * p[2]) > 90 OR abs(sin(g) * p[1] + cos(g) * p[2]) > 180)) = 0)[1] AS g FROM st WHERE step < len(todo)))
SELECT trj_id, copy, j - 1 AS k, label, t[j] AS t, floor(a[j] * 1000000 + 0.37) / 1000000 AS lat, floor(o[j] * 1000000 + 0.37) / 1000000 AS lon
FROM (SELECT *, unnest(range(1, len(t) + 1)) AS j FROM st WHERE step = len(todo))""")


@query("augmented_copies", COPIES)
def _augmented(spark, sf):
    """Compared on a grid off the ties of the points, which are short decimals."""
    p = uneven_points(spark, sf)
    draws = augment.balance_draws(p.where("k = 0").select("trj_id", "label"))
    out = augment.augmented_copies(p, draws)
    return out.withColumns({c: F.floor(F.col(c) * 1000000 + 0.37) / 1000000 for c in ("lat", "lon")})


@query("time_warp", chain("segs", f""", dr AS (SELECT trj_id, seg_id, pos, t, lat, lon, n_points AS n, CAST(pos AS DOUBLE) / (n_points - 1) AS q, CAST({augment.WARP_DEVIATION} AS DOUBLE) * {gauss(42, 121, "trj_id", "seg_id", "pos")} AS z,
  row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY pos = 0 OR pos = n_points - 1, {u(42, 120, "trj_id", "seg_id", "pos")}, pos) <= {augment.WARP_KNOTS} AS knot FROM segs),
ed AS (SELECT trj_id, seg_id, pos, q, z, knot, lag(q) OVER w AS lo, lead(q) OVER w AS hi FROM dr WHERE knot OR pos = 0 OR pos = n - 1 WINDOW w AS (PARTITION BY trj_id, seg_id ORDER BY pos)),
bt AS (SELECT d.trj_id, d.seg_id, d.pos, d.lat, d.lon, CASE WHEN d.knot THEN least(greatest(d.q + d.z * (hi - lo), lo), hi) ELSE d.q END AS x FROM dr d LEFT JOIN ed e USING (trj_id, seg_id, pos) WHERE d.n >= 6),
kn AS MATERIALIZED (SELECT trj_id, seg_id, x, ya, yb, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY trj_id, seg_id) AS m
  FROM (SELECT trj_id, seg_id, x, arg_min(lat, pos) AS ya, arg_min(lon, pos) AS yb FROM bt GROUP BY ALL) WINDOW w AS (PARTITION BY trj_id, seg_id ORDER BY x)),
ask AS (SELECT trj_id, seg_id, pos, least(greatest(q, a), b) AS q FROM dr JOIN (SELECT trj_id, seg_id, min(x) AS a, max(x) AS b FROM kn GROUP BY ALL) USING (trj_id, seg_id)),""" + spline("kn", "ask") + f"""
SELECT trj_id, seg_id, pos, t, floor(coalesce(ya, lat) * 1000000 + 0.37) / 1000000 AS lat, floor(coalesce(yb, lon) * 1000000 + 0.37) / 1000000 AS lon FROM dr LEFT JOIN curve USING (trj_id, seg_id, pos)"""))
def _warp(spark, sf):
    """Compared on a grid off the ties of the points, which are short decimals."""
    out = augment.time_warp(segments_of(fx.points(spark, sf)), SEG)
    return out.select(*SEG, "pos", "t", *[(F.floor(F.col(c) * 1000000 + 0.37) / 1000000).alias(c) for c in ("lat", "lon")])


@query("contrast_view", chain("segs", f""", c AS (SELECT *, n_points - n_points * 9 // 10 AS unused, CAST(floor(n_points * 0.1::DOUBLE) AS INT) AS cut, {u(42, 110, "trj_id", "seg_id")} > 0.5 AS suffix FROM segs)
SELECT trj_id, seg_id, CASE WHEN suffix THEN pos ELSE pos - cut END AS pos, {r(f"lat + 0.001 * {gauss(42, 111, 'trj_id', 'seg_id', 'pos')}", 8)} AS lat,
  {r(f"lon + 0.001 * {gauss(42, 113, 'trj_id', 'seg_id', 'pos')}", 8)} AS lon, t
FROM c WHERE CASE WHEN suffix THEN pos < n_points - cut ELSE pos >= cut END"""))
def _contrast(spark, sf):
    out = augment.contrast_view(segments_of(fx.points(spark, sf)), SEG)
    return out.select(*SEG, "pos", rounded(F.col("lat"), 8).alias("lat"), rounded(F.col("lon"), 8).alias("lon"), "t")


@query("noisy_share_mix", chain("good", f""", x AS (SELECT trj_id, seg_id, pos, velocity, {u(42, 40, "trj_id", "seg_id")} < 0.5 AS is_noisy FROM good WHERE accepted)
SELECT trj_id, seg_id, pos, {r("CASE WHEN is_noisy THEN velocity * 2 ELSE velocity END", 5)} AS velocity, is_noisy FROM x"""))
def _mix(spark, sf):
    rows = motion.with_enough_steps(steps_of(spark, sf)).where("accepted")
    out = noise.mix_clean_noisy(rows, rows.withColumn("velocity", F.col("velocity") * 2), SEG, ["velocity"], 0.5)
    return out.withColumn("velocity", rounded(F.col("velocity"), 5))
