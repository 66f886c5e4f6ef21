"""Queries on points, segments, steps and extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripmill.functions import geo, scalar
from tripmill.functions.scalar import rounded
from tripmill.operators import clean, motion, segment
from tripmill.operators.scan import with_neighbours
from tripmill.plans import fixtures as fx
from tripmill.plans.catalog import query
from tripmill.plans.motion_profile import motion_profile, segments_of
from tripmill.plans.sql import chain, distance_ctes, r
from tripmill.schema import FEATURES_WITH_TIME


def steps_of(spark, sf):
    return motion.step_features(segments_of(fx.points(spark, sf)))


def good_steps(spark, sf):
    return motion.with_enough_steps(steps_of(spark, sf))


PROFILE = chain("good", f""" SELECT label, count(*) FILTER (pos = 0) AS segments, count(*) AS steps,
  count(*) FILTER (NOT accepted) AS removed, round(avg(velocity) FILTER (accepted), 4) AS avg_velocity,
  round(avg(abs(acceleration)) FILTER (accepted), 4) AS avg_acceleration, round(max(distance), 3) AS max_distance
FROM good GROUP BY label""", trim=True)


@query("motion_profile", PROFILE)
def _profile(spark, sf):
    return motion_profile(fx.points(spark, sf))


PAIRS = chain("points", f""",
pair AS (SELECT trj_id, k, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM points WINDOW w AS (PARTITION BY trj_id ORDER BY k)),
open AS (SELECT * FROM pair WHERE abs(lat) <= 90 AND abs(lat2) <= 90), {distance_ctes("open", "far")}
""")


def _pairs(spark, sf):
    """Each point and its successor, both in range, in blocks of places that share their edges."""
    near = with_neighbours(fx.points(spark, sf), "k", before=0, after=1)
    w = Window.partitionBy("trj_id", "blk").orderBy("k")
    q = near.select("trj_id", "k", "own", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    both = geo.in_range(F.col("lat"), F.col("lon")) & geo.in_range(F.col("lat2"), F.col("lon2"))
    return q.where(F.col("own") & both)


@query("geodesic_step", PAIRS + " SELECT trj_id, k, round(d, 4) AS distance FROM far")
def _geodesic(spark, sf):
    q = _pairs(spark, sf)
    d = geo.geodesic_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return q.select("trj_id", "k", F.round(d, 4).alias("distance"))


@query("bearing_step", PAIRS + " SELECT trj_id, k, round(h, 5) AS heading FROM far")
def _bearing(spark, sf):
    q = _pairs(spark, sf)
    h = geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return q.select("trj_id", "k", F.round(h, 5).alias("heading"))


@query("coordinate_filter", chain("points", " SELECT trj_id, k, lat, lon FROM points WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"))
def _coords(spark, sf):
    return clean.coordinate_filter(fx.points(spark, sf)).select("trj_id", "k", "lat", "lon")


@query("label_counts", chain("points", " SELECT label, count(DISTINCT trj_id) AS trips, count(*) AS n_points FROM points GROUP BY label"))
def _labels(spark, sf):
    """Counted per trip first: one row per trip, so no distinct over points."""
    trips = fx.points(spark, sf).groupBy("trj_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return trips.groupBy("label").agg(F.count(F.lit(1)).alias("trips"), F.sum("n").alias("n_points"))


@query("valid_points", chain("valid", " SELECT trj_id, k, label, t, lat, lon FROM valid"))
def _valid(spark, sf):
    return clean.valid_points(fx.points(spark, sf))


@query("valid_points_blocked", chain("valid", " SELECT trj_id, k, label, t, lat, lon FROM valid"))
def _valid_blocked(spark, sf):
    """The same rows through blocks of 64 points, the way taken for trips too long for one task."""
    return clean.valid_points(fx.points(spark, sf), block=64)


@query("percentile_trim", chain("valid", """,
edges AS (SELECT quantile_cont(lat, 0.01) AS a1, quantile_cont(lat, 0.99) AS a9,
                 quantile_cont(lon, 0.01) AS o1, quantile_cont(lon, 0.99) AS o9 FROM points),
inside AS (SELECT p.* FROM points p, edges WHERE NOT ((lat <= a1 OR lat >= a9) AND (lon <= o1 OR lon >= o9)))
SELECT * FROM inside WHERE trj_id IN (SELECT trj_id FROM inside GROUP BY trj_id HAVING count(*) >= 10)"""))
def _trim(spark, sf):
    return clean.percentile_trim(fx.points(spark, sf))


@query("min_points_filter", chain("points", """ SELECT trj_id, k FROM points p WHERE lat < 39.9012 AND trj_id IN
  (SELECT trj_id FROM points WHERE lat < 39.9012 GROUP BY trj_id HAVING count(*) >= 6)"""))
def _min_points(spark, sf):
    return clean.at_least(fx.points(spark, sf).where("lat < 39.9012"), ["trj_id"], 6).select("trj_id", "k")


@query("time_steps", chain("points", """ SELECT * FROM (SELECT trj_id, k, t - lag(t) OVER (PARTITION BY trj_id ORDER BY k) AS delta_t
  FROM points) WHERE delta_t IS NOT NULL"""))
def _time_steps(spark, sf):
    near = with_neighbours(fx.points(spark, sf), "k", before=1, after=0)
    w = Window.partitionBy("trj_id", "blk").orderBy("k")
    q = near.select("trj_id", "k", "own", (F.col("t") - F.lag("t").over(w)).alias("delta_t"))
    return q.where(F.col("own") & F.col("delta_t").isNotNull()).drop("own")


@query("stay_gap_split", chain("segs", " SELECT trj_id, k, CAST(stay_id AS BIGINT) AS stay_id, CAST(start AS BIGINT) AS start, CAST(place - start AS BIGINT) AS pos FROM parts"))
def _stays(spark, sf):
    p = fx.points(spark, sf)
    longest = clean.longest_group(p)
    out = segment.mark_stays(clean.valid_points(p, longest=longest), longest=longest)
    return out.select("trj_id", "k", "stay_id", "start", "pos")


@query("chunk_segments", chain("segs", " SELECT trj_id, k, seg_id, pos, n_points FROM segs"))
def _chunks(spark, sf):
    return segments_of(fx.points(spark, sf)).select("trj_id", "k", "seg_id", "pos", "n_points")


@query("chunk_segments_blocked", chain("segs", " SELECT trj_id, k, seg_id, pos, n_points FROM segs"))
def _chunks_blocked(spark, sf):
    """The same segments through blocks of 64 points, the way taken for trips too long for one task."""
    p = fx.points(spark, sf)
    return segment.cut_segments(clean.valid_points(p), block=64).select("trj_id", "k", "seg_id", "pos", "n_points")


@query("short_chunks_128", chain("points", """,
m AS (SELECT trj_id, k, k // 128 AS c, count(*) OVER (PARTITION BY trj_id, k // 128) AS n FROM points)
SELECT trj_id, k, CAST(c * 128 AS BIGINT) AS seg_id, CAST(n AS INT) AS n_points FROM m WHERE c = 0 OR n > 10"""))
def _chunks_128(spark, sf):
    out = segment.cut_segments(fx.points(spark, sf), gap=float("inf"), size=128)
    return out.select("trj_id", "k", "seg_id", "n_points")


FEATURE_ROWS = ", ".join(f"{r(c, 5)} AS {c}" if c not in ("hour", "delta_t", "ts_mid") else c for c in FEATURES_WITH_TIME)


def _rounded_features():
    return [rounded(F.col(c), 5).alias(c) if c not in ("hour", "delta_t", "ts_mid") else F.col(c) for c in FEATURES_WITH_TIME]


@query("step_features", chain("steps", f" SELECT trj_id, seg_id, pos, label, accepted, {FEATURE_ROWS} FROM steps"))
def _steps(spark, sf):
    return steps_of(spark, sf).select("trj_id", "seg_id", "pos", "label", "accepted", *_rounded_features())


@query("step_features_backwards", chain("steps", f" SELECT trj_id, seg_id, pos, label, accepted, {FEATURE_ROWS} FROM steps").replace("dt > 0 AND", "dt <> 0 AND"))
def _steps_backwards(spark, sf):
    """Steps back in time accepted like the others, if speed and acceleration hold."""
    out = motion.step_features(segments_of(fx.points(spark, sf)), backwards=True)
    return out.select("trj_id", "seg_id", "pos", "label", "accepted", *_rounded_features())


@query("feature_variants", chain("good", f""" SELECT trj_id, seg_id, pos, label, variant, {FEATURE_ROWS}
FROM good, (VALUES ('clean'), ('noisy')) x(variant) WHERE accepted OR variant = 'noisy'"""))
def _variants(spark, sf):
    out = motion.feature_variants(good_steps(spark, sf))
    return out.select("trj_id", "seg_id", "pos", "label", "variant", *_rounded_features())


@query("plausible_steps", chain("steps", " SELECT trj_id, seg_id, pos, round(velocity, 5) AS velocity FROM steps WHERE accepted"))
def _plausible(spark, sf):
    return steps_of(spark, sf).where("accepted").select("trj_id", "seg_id", "pos", F.round("velocity", 5).alias("velocity"))


@query("min_feature_rows", chain("good", " SELECT DISTINCT trj_id, seg_id, n_accepted FROM good"))
def _enough(spark, sf):
    return good_steps(spark, sf).where("pos = 0").select("trj_id", "seg_id", "n_accepted")


@query("drop_rejected_points", chain("steps", """ SELECT s.trj_id, s.seg_id, s.pos FROM segs s
  LEFT JOIN steps t USING (trj_id, seg_id, pos) WHERE t.accepted OR s.pos = s.n_points - 1"""))
def _drop(spark, sf):
    seg = segments_of(fx.points(spark, sf))
    return motion.drop_rejected_points(seg, motion.step_features(seg)).select("trj_id", "seg_id", "pos")


@query("stop_turn_flags", chain("steps", """ SELECT trj_id, seg_id, pos, CAST(distance < 0.5 AS INT) AS stop,
  CAST(heading_change >= 90 AS INT) AS turn FROM steps"""))
def _flags(spark, sf):
    return motion.stop_turn_flags(steps_of(spark, sf)).select("trj_id", "seg_id", "pos", "stop", "turn")


@query("removed_by_class", chain("good", """ SELECT label, count(*) FILTER (NOT accepted) AS removed,
  count(*) + count(*) FILTER (pos = 0) AS total FROM good GROUP BY label"""))
def _removed(spark, sf):
    return motion.removed_by_class(steps_of(spark, sf))


@query("class_limits", chain("points", """ SELECT trj_id, k, CASE label WHEN 0 THEN 7.0 WHEN 1 THEN 12.0 WHEN 3 THEN 50.0 ELSE round(120/3.6, 6) END::DOUBLE AS max_speed,
  CASE label WHEN 2 THEN 2.0 WHEN 3 THEN 10.0 ELSE 3.0 END::DOUBLE AS max_acc FROM points"""))
def _limits(spark, sf):
    speed, acc = motion.class_limits(F.col("label"))
    return fx.points(spark, sf).select("trj_id", "k", F.round(speed, 6).alias("max_speed"), acc.alias("max_acc"))


@query("hour_of_day", chain("points", " SELECT trj_id, k, CAST(floor(t / 3600) % 24 AS INT) AS hour, CAST(floor((t + 28800) / 3600) % 24 AS INT) AS hour_east8 FROM points"))
def _hour(spark, sf):
    t = F.col("t")
    return fx.points(spark, sf).select("trj_id", "k", scalar.hour_of(t).alias("hour"), scalar.hour_of(t, 28800).alias("hour_east8"))


@query("clean_trips", chain("steps", """,
bad AS (SELECT DISTINCT trj_id, seg_id, CASE WHEN delta_t <= 0 THEN pos + 1 ELSE pos END AS pos FROM steps WHERE NOT accepted),
c AS (SELECT s.*, count(*) OVER (PARTITION BY trj_id, seg_id) AS m FROM segs s ANTI JOIN bad USING (trj_id, seg_id, pos) WHERE n_points >= 10)
SELECT trj_id, seg_id, k, CAST(row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY pos) - 1 AS INT) AS pos, CAST(m AS INT) AS n_points FROM c WHERE m >= 10"""))
def _clean(spark, sf):
    return motion.clean_segments(segments_of(fx.points(spark, sf))).select("trj_id", "seg_id", "k", "pos", "n_points")
