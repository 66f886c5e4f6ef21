"""Queries on extraction, resampling and masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripmill.functions.scalar import hash32, rounded
from tripmill.operators import extract, masks, motion, packed_masks, resample
from tripmill.plans import fixtures as fx
from tripmill.plans.catalog import query
from tripmill.plans.motion_profile import segments_of
from tripmill.plans.sql import chain, h32, r, spline
from tripmill.plans.trips import good_steps, steps_of
from tripmill.schema import FEATURES, MODE_CODES, SENSOR_TO_5, lookup

SEG = ["trj_id", "seg_id"]
LENGTH = 4
EPOCH = "epoch_us(ts) / 1000000.0"
INTERVALS = f"""intervals AS (SELECT user_id, event_id AS trip_id, CAST(event_id % 5 AS INT) AS label,
  {EPOCH} AS st, {EPOCH} + 172800 AS et FROM events WHERE event_type = 'signup')"""


def timed_events(spark, sf):
    return fx.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", fx.epoch(F.col("ts")).alias("t"))


def signup_intervals(spark, sf):
    e = timed_events(spark, sf).where("event_type = 'signup'")
    return e.select("user_id", F.col("event_id").alias("trip_id"), (F.col("event_id") % 5).cast("int").alias("label"),
                    F.col("t").alias("st"), (F.col("t") + 172800).alias("et"))


@query("interval_trips", f"""WITH {INTERVALS}
SELECT i.trip_id, i.label, e.event_id FROM events e JOIN intervals i ON e.user_id = i.user_id AND {EPOCH} BETWEEN st AND et""")
def _interval(spark, sf):
    p = timed_events(spark, sf).select("user_id", "event_id", "t")
    return extract.interval_trips(p, signup_intervals(spark, sf), "user_id", keep=["trip_id", "label", "event_id"])


@query("numbered_trips", f"""WITH {INTERVALS}
SELECT i.trip_id, e.event_id, row_number() OVER (PARTITION BY i.trip_id ORDER BY ts, event_id) - 1 AS k
FROM events e JOIN intervals i ON e.user_id = i.user_id AND {EPOCH} BETWEEN st AND et""")
def _numbered(spark, sf):
    p = timed_events(spark, sf).select("user_id", "event_id", "t")
    trips = extract.interval_trips(p, signup_intervals(spark, sf), "user_id", keep=["trip_id", "event_id", "t"])
    return extract.number_points(trips, ["trip_id"], ["t", "event_id"]).select("trip_id", "event_id", "k")


ASOF = f"""WITH l AS (SELECT user_id, {EPOCH} AS st, {EPOCH} + 21600 AS et, CAST(event_id % 5 AS INT) AS label
  FROM events WHERE event_type = 'signup'),
p AS (SELECT user_id, event_id, {EPOCH} AS t FROM events)
SELECT p.event_id, CASE WHEN p.t < l.et THEN l.label END AS label FROM p ASOF LEFT JOIN l ON p.user_id = l.user_id AND p.t >= l.st"""


def _asof(spark, sf, **kw):
    e = timed_events(spark, sf)
    labels = e.where("event_type = 'signup'").select(
        "user_id", F.col("t").alias("start_time"), (F.col("t") + 21600).alias("end_time"), (F.col("event_id") % 5).cast("int").alias("label"))
    return extract.asof_label(e.select("user_id", "event_id", "t"), labels, "user_id", **kw).select("event_id", "label")


query("asof_label", ASOF)(lambda spark, sf: _asof(spark, sf))
query("asof_label_bucketed", ASOF)(lambda spark, sf: _asof(spark, sf, block=8))

RUNS = f"""WITH m AS (SELECT user_id, event_type, {EPOCH} AS t, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new,
  ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
"""
RUNS_OUT = RUNS + """SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS label, min(t) AS st, max(t) AS et, count(*) AS n
FROM runs GROUP BY user_id, run"""


def _runs(spark, sf, **kw):
    samples = timed_events(spark, sf).withColumnRenamed("event_type", "label")
    return extract.label_runs(samples, "user_id", ["t", "event_id"], **kw)


query("label_runs", RUNS_OUT)(lambda spark, sf: _runs(spark, sf))
query("label_runs_bucketed", RUNS_OUT)(lambda spark, sf: _runs(spark, sf, block=8))


@query("run_trips", RUNS + f""", g AS (SELECT user_id, run, any_value(event_type) AS label, min(t) AS st, max(t) AS et, count(*) AS n FROM runs GROUP BY user_id, run)
SELECT g.user_id, CAST(g.run AS BIGINT) AS run, g.label, e.event_id FROM g JOIN events e ON e.user_id = g.user_id AND {EPOCH} BETWEEN st AND et WHERE g.label IN ('view', 'click', 'signup')""")
def _run_trips(spark, sf):
    p = timed_events(spark, sf).select("user_id", "event_id", "t")
    runs = extract.use_modes(_runs(spark, sf), ["view", "click", "signup"]).select("user_id", "run", "label", "st", "et")
    return extract.interval_trips(p, runs, "user_id", keep=["user_id", "run", "label", "event_id"])


@query("class_whitelist", "SELECT event_id, CAST(event_id % 9 AS INT) AS label FROM events WHERE event_id % 9 IN (2, 4, 5, 6, 7)")
def _whitelist(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", (F.col("event_id") % 9).cast("int").alias("label"))
    return extract.use_modes(e, [2, 4, 6, 5, 7])


@query("mode_codes", """SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 3 END AS mode_code,
CASE event_id % 9 WHEN 2 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 3 WHEN 6 THEN 2 WHEN 7 THEN 4 WHEN 8 THEN 4 END AS sensor_code FROM events""")
def _codes(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("view", "walk", "click", "car", "signup", "train", "error", "taxi", "purchase", "taxi")])
    e = fx.table(spark, sf, "events")
    return e.select("event_id", lookup(MODE_CODES, names[F.col("event_type")]).alias("mode_code"),
                    lookup(SENSOR_TO_5, (F.col("event_id") % 9).cast("int")).alias("sensor_code"))


# Values rounded before resampling, so both engines compare the same numbers.
CLEAN_ROWS = f"""clean AS (SELECT g.trj_id, g.seg_id, row_number() OVER (PARTITION BY g.trj_id, g.seg_id ORDER BY g.pos) - 1 AS i,
  {", ".join(f"{r(c, 3)} AS {c}" for c in FEATURES if c != "hour")}, CAST(hour AS DOUBLE) AS hour, z.n
  FROM good g JOIN (SELECT DISTINCT trj_id, seg_id, n_points AS n FROM segs) z USING (trj_id, seg_id) WHERE accepted),
m AS (SELECT trj_id, seg_id, n, count(*) AS m FROM clean GROUP BY ALL),
grid AS (SELECT *, CAST(CASE WHEN j = n - 1 THEN m - 1 ELSE j * (CAST(m - 1 AS DOUBLE) / (n - 1)) END AS DOUBLE) AS place
  FROM (SELECT trj_id, seg_id, n, m, unnest(range(n)) AS j FROM m)),
low AS (SELECT *, greatest(0, least(CAST(floor(place) AS BIGINT), m - 2)) AS lo FROM grid),
even AS (SELECT l.trj_id, l.seg_id, CAST(l.j AS INT) AS pos, l.n, {", ".join(f"a.{c} + (place - lo) * (b.{c} - a.{c}) AS {c}" for c in FEATURES)}
  FROM low l JOIN clean a ON a.trj_id = l.trj_id AND a.seg_id = l.seg_id AND a.i = l.lo
  JOIN clean b ON b.trj_id = l.trj_id AND b.seg_id = l.seg_id AND b.i = least(l.lo + 1, l.m - 1))"""


def even_features(spark, sf):
    """Clean features of each segment stretched back to its number of points."""
    steps = motion.with_enough_steps(motion.step_features(segments_of(fx.points(spark, sf))))
    sized = steps.withColumn("n_points", F.max("pos").over(Window.partitionBy(*SEG)) + 2).where("accepted")
    rows = sized.select(*SEG, "pos", "n_points", *[rounded(F.col(c), 3).alias(c) if c != "hour" else F.col(c).cast("double").alias(c) for c in FEATURES])
    return resample.resample_linear(rows, SEG, "pos", FEATURES, "n_points")


@query("resample_linear", chain("good", f", {CLEAN_ROWS} SELECT trj_id, seg_id, pos, " + ", ".join(f"floor({c} * 1000000 + 0.37) / 1000000 AS {c}" for c in FEATURES) + " FROM even"))
def _resample(spark, sf):
    """Compared on a grid that is off the ties which even steps between short decimals fall on."""
    return even_features(spark, sf).select(*SEG, "pos", *[(F.floor(F.col(c) * 1000000 + 0.37) / 1000000).alias(c) for c in FEATURES])


@query("resample_cubic", chain("good", """, ps AS (SELECT s.trj_id, s.seg_id, s.n_points AS n, lat AS ya, lon AS yb, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY trj_id, seg_id) AS m
  FROM segs s ANTI JOIN (SELECT trj_id, seg_id, pos FROM good WHERE NOT accepted) USING (trj_id, seg_id, pos) WINDOW w AS (PARTITION BY trj_id, seg_id ORDER BY pos)),
kn AS MATERIALIZED (SELECT *, CAST(i AS DOUBLE) AS x FROM ps WHERE m <> n),
ask AS (SELECT trj_id, seg_id, j AS pos, CASE WHEN j = n - 1 THEN CAST(m - 1 AS DOUBLE) ELSE j * (CAST(m - 1 AS DOUBLE) / (n - 1)) END AS q
  FROM (SELECT DISTINCT trj_id, seg_id, n, m FROM kn), range(1000) r(j) WHERE j < n),""" + spline("kn", "ask") + f"""
SELECT trj_id, seg_id, CAST(pos AS INT) AS pos, {r("ya", 6)} AS lat, {r("yb", 6)} AS lon FROM (FROM curve UNION ALL SELECT trj_id, seg_id, i, ya, yb FROM ps WHERE m = n)"""))
def _cubic(spark, sf):
    """Clean latitudes and longitudes stretched back to the segment's number of points."""
    seg = segments_of(fx.points(spark, sf))
    kept = motion.drop_rejected_points(seg, motion.with_enough_steps(motion.step_features(seg)))
    out = resample.resample_cubic(kept, SEG, "pos", ["lat", "lon"], "n_points")
    return out.select(*SEG, "pos", rounded(F.col("lat"), 6).alias("lat"), rounded(F.col("lon"), 6).alias("lon"))


def listed(wide):
    """A row per place and feature, from a column per feature."""
    return wide.select(*SEG, "pos", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mask")) for c in FEATURES])))


SERIES = ", s AS (SELECT trj_id, seg_id, pos, n, feature, x FROM even UNPIVOT (x FOR feature IN (" + ", ".join(FEATURES) + ")))"


def extremes_sql(kind: str, series: str = SERIES) -> str:
    compare = {"max": "x1 < x2", "min": "x1 > x2"}[kind]
    return series + f""",
e1 AS (SELECT *, sign(lead(x) OVER w - x) AS sg FROM s WINDOW w AS (PARTITION BY trj_id, seg_id, feature ORDER BY pos)),
e2 AS (SELECT *, CASE WHEN pos = 0 THEN max(CASE WHEN pos = n - 2 THEN sg END) OVER (PARTITION BY trj_id, seg_id, feature)
  ELSE lag(sg) OVER (PARTITION BY trj_id, seg_id, feature ORDER BY pos) END AS pg FROM e1),
e3 AS (SELECT *, CASE WHEN sg <> pg THEN 1 ELSE 0 END AS ch FROM e2),
e4 AS (SELECT *, sum(ch) OVER (PARTITION BY trj_id, seg_id, feature ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth,
  sum(ch) OVER (PARTITION BY trj_id, seg_id, feature) AS changes FROM e3),
e5 AS (SELECT *, max(CASE WHEN ch = 1 AND nth = 1 THEN x END) OVER v AS x1, max(CASE WHEN ch = 1 AND nth = 2 THEN x END) OVER v AS x2
  FROM e4 WINDOW v AS (PARTITION BY trj_id, seg_id, feature)),
ext AS (SELECT *, ch = 1 AND pos > 0 AND (changes = 1 OR nth % 2 = CASE WHEN {compare} THEN 0 ELSE 1 END) AS extreme FROM e5)"""


@query("extreme_points", chain("good", f", {CLEAN_ROWS} {extremes_sql('max')} SELECT trj_id, seg_id, feature, pos FROM ext WHERE extreme"))
def _extremes(spark, sf):
    found = packed_masks.extreme_places(even_features(spark, sf), SEG, "pos", FEATURES)
    return listed(found).where("mask = 1").drop("mask")


@query("extreme_points_min", chain("good", f", {CLEAN_ROWS} {extremes_sql('min')} SELECT trj_id, seg_id, feature, pos FROM ext WHERE extreme"))
def _extremes_min(spark, sf):
    found = packed_masks.extreme_places(even_features(spark, sf), SEG, "pos", FEATURES, "min")
    return listed(found).where("mask = 1").drop("mask")


@query("lowest_extremes", chain("good", f""", {CLEAN_ROWS} {extremes_sql('max')},
c AS (SELECT *, count(*) FILTER (extreme) OVER v AS have FROM ext WINDOW v AS (PARTITION BY trj_id, seg_id, feature)),
d AS (SELECT *, row_number() OVER (PARTITION BY trj_id, seg_id, feature ORDER BY extreme DESC, x, pos) AS rk FROM c)
SELECT trj_id, seg_id, feature, pos FROM d WHERE changes > 0 AND CASE WHEN have >= 3 THEN extreme AND rk <= 3
  ELSE n // 4 > 0 AND pos > 0 AND pos % (n // 4) = 0 AND pos <= 3 * (n // 4) END"""))
def _lowest(spark, sf):
    found = packed_masks.lowest_places(even_features(spark, sf), SEG, "pos", FEATURES, 3)
    return listed(found).where("mask = 1").drop("mask")


@query("extreme_mask", chain("good", f""", {CLEAN_ROWS} {extremes_sql('max')},
c AS (SELECT trj_id, seg_id, feature, n, any_value(changes) AS changes, stddev_pop(x) AS sd, list(pos) FILTER (extreme) AS peaks FROM ext GROUP BY ALL),
level AS (SELECT *, greatest(2, CAST(floor(n * 0.1) AS INT)) AS q, greatest(1, n // {LENGTH} - 2) AS mid FROM c),
flat AS (SELECT trj_id, seg_id, feature, n, unnest(CASE WHEN sd < 1e-6 THEN list_transform(range(q), lambda j: CASE WHEN j = q - 1 THEN n - 1 ELSE CAST(floor(j * (CAST(n - 1 AS DOUBLE) / (q - 1))) AS INT) END)
   ELSE list_concat([0], list_transform(range(mid), lambda j: CASE WHEN mid = 1 THEN {LENGTH} WHEN j = mid - 1 THEN n - {LENGTH} ELSE CAST(floor({LENGTH} + j * (CAST(n - 2 * {LENGTH} AS DOUBLE) / (mid - 1))) AS INT) END), [n - 1]) END) AS p
  FROM level WHERE changes = 0),
spans AS (SELECT trj_id, seg_id, feature, greatest(0, p - {LENGTH // 2}) AS a, least(n, p + {LENGTH // 2}) AS b FROM flat
  UNION ALL SELECT trj_id, seg_id, feature, CASE WHEN p - 2 <= 0 THEN 0 WHEN p + 2 >= n THEN n - {LENGTH} ELSE p - 2 END,
    CASE WHEN p - 2 <= 0 THEN {LENGTH} WHEN p + 2 >= n THEN n ELSE p - 2 + {LENGTH} END FROM (SELECT trj_id, seg_id, feature, n, unnest(peaks) AS p FROM c WHERE changes > 0)),
hit AS (SELECT DISTINCT trj_id, seg_id, feature, unnest(range(a, b)) AS pos FROM spans)
SELECT s.trj_id, s.seg_id, s.feature, s.pos, CASE WHEN h.pos IS NULL THEN 1 ELSE 0 END AS mask FROM s LEFT JOIN hit h USING (trj_id, seg_id, feature, pos)"""))
def _extreme_mask(spark, sf):
    return listed(packed_masks.extreme_masks(even_features(spark, sf), SEG, "pos", FEATURES, LENGTH))


H1 = h32(42, "trj_id", "seg_id", "pos")
H2 = h32(43, "trj_id", "seg_id", "pos")


@query("random_mask", chain("segs", f""",
a AS (SELECT trj_id, seg_id, pos, n_points AS n, CAST(round_even(n_points * 0.15, 0) AS INT) AS want, {H1} AS h1, {H2} AS h2 FROM segs),
b AS (SELECT *, greatest(1, CAST(round_even(want / 3.0, 0) AS INT)) AS spans FROM a),
c AS (SELECT *, greatest(1, CAST(round_even(CAST(want AS DOUBLE) / spans, 0) AS INT)) AS len FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY pos > n - len, h1, pos) AS r1 FROM c),
e AS (SELECT *, max(CASE WHEN pos <= n - len AND r1 <= spans THEN pos END) OVER (PARTITION BY trj_id, seg_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS st FROM d),
f AS (SELECT *, coalesce(CAST(pos - st < len AS INT), 0) AS inn FROM e),
g AS (SELECT *, sum(inn) OVER (PARTITION BY trj_id, seg_id) AS have, row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY inn, h2, pos) AS r2 FROM f)
SELECT trj_id, seg_id, pos, CASE WHEN CASE WHEN n - len <= 0 THEN pos < least(want, n) ELSE inn = 1 OR r2 <= want - have END THEN 0 ELSE 1 END AS mask FROM g"""))
def _random_mask(spark, sf):
    seg = segments_of(fx.points(spark, sf)).select(*SEG, "pos")

    def draw(seed):
        return hash32(seed, F.col("trj_id"), F.col("seg_id"), F.col("pos"))

    return masks.random_mask(seg, SEG, "pos", draw(42), draw(43))


@query("long_turn_runs", chain("steps", """,
o AS (SELECT trj_id, seg_id, pos, pos - row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY pos) AS g FROM steps WHERE heading_change >= 90)
SELECT trj_id, seg_id, min(pos) AS start, max(pos) + 1 AS "end" FROM o GROUP BY trj_id, seg_id, g HAVING count(*) > 2"""))
def _long_runs(spark, sf):
    flags = motion.stop_turn_flags(steps_of(spark, sf))
    return masks.long_runs(flags, SEG, "pos", "turn", 2)


@query("stop_turn_mask", chain("good", """,
o AS (SELECT trj_id, seg_id, pos, pos - row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY pos) AS g FROM good WHERE heading_change >= 90
  UNION ALL SELECT trj_id, seg_id, pos, 1000 + pos - row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY pos) AS g FROM good WHERE distance < 0.5),
runs AS (SELECT trj_id, seg_id, min(pos) AS a, max(pos) + 2 AS b FROM o GROUP BY trj_id, seg_id, g HAVING count(*) > 2),
hit AS (SELECT trj_id, seg_id, unnest(range(a, b)) AS pos FROM runs UNION SELECT trj_id, seg_id, pos FROM good WHERE NOT accepted)
SELECT s.trj_id, s.seg_id, s.pos, CASE WHEN h.pos IS NULL THEN 1 ELSE 0 END AS mask FROM segs s
  SEMI JOIN good USING (trj_id, seg_id) LEFT JOIN hit h USING (trj_id, seg_id, pos)"""))
def _stop_turn(spark, sf):
    flags = motion.stop_turn_flags(good_steps(spark, sf))
    return masks.stop_turn_mask(flags, SEG, longer_than=2)


@query("subsample_long", chain("points", """,
n AS (SELECT *, count(*) OVER (PARTITION BY trj_id) AS n FROM points)
SELECT trj_id, CASE WHEN n > 200 THEN k // 2 ELSE k END AS k, t FROM n WHERE n <= 200 OR k % 2 = 0"""))
def _subsample(spark, sf):
    return resample.subsample(fx.points(spark, sf).select("trj_id", "k", "t"), ["trj_id"], "k", limit=200)


@query("fill_linear", chain("points", f""",
h AS (SELECT trj_id, k, CASE WHEN k % 7 < 5 AND k % 250 NOT IN (0, 249) AND lat < 90 THEN lat END AS v FROM points),
i AS (SELECT *, row_number() OVER w AS i FROM h WINDOW w AS (PARTITION BY trj_id ORDER BY k)),
j AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w AS ia, last_value(v IGNORE NULLS) OVER w AS va,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER u AS ib, first_value(v IGNORE NULLS) OVER u AS vb FROM i
  WINDOW w AS (PARTITION BY trj_id ORDER BY k ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY trj_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT trj_id, k, {r("CASE WHEN va IS NULL THEN vb WHEN vb IS NULL OR ia = ib THEN va ELSE va + CAST(i - ia AS DOUBLE) / (ib - ia) * (vb - va) END", 8)} AS v FROM j"""))
def _fill(spark, sf):
    hole = F.when((F.col("k") % 7 < 5) & ~F.col("k").isin(0, 249) & (F.col("lat") < 90), F.col("lat"))
    rows = fx.points(spark, sf).select("trj_id", "k", hole.alias("v"))
    return resample.fill_linear(rows, ["trj_id"], "k", "v").withColumn("v", rounded(F.col("v"), 8))
