"""Exact nearest neighbours over a tree of balls, and a classifier of Spark ML on top of them.

Each node of the tree is a ball around one of its rows. A node with over ``leaf``
rows is split among ``fan`` centres of its own: rows drawn by a hash, and the one
farthest from the node's centre, so every split makes progress. All nodes of a
level are split at once, and rows are dealt to their centres by a join on the
node; the driver sees neither rows nor centres. A node of equal rows is a leaf
whatever its size.

Whole leaves are dealt into pieces of ``PIECE`` rows and queries into shares of
``SHARE``; each piece meets each share once, in one task, so a query's vector
goes out once a piece, not once a leaf. A task reads its leaves nearest first,
and those that begin beyond the k-th distance found so far are left out. The
number of pairs still grows with the square of the rows where no leaf can be
left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tripmill.functions.scalar import hash32
from tripmill.session import stage, unstage

_SLACK = 1 + 1e-9


def _matrix(series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in series])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((a - row) ** 2).sum(axis=1)) for row in b], axis=1)


PIECE, SHARE = 1 << 16, 1 << 13  # rows of the tree and queries that meet in a task
LEAST_SHARE = 1 << 8  # queries of a share below which more tasks do not help
PART = 1 << 12  # rows of a leaf of equal rows that go together
PAIRS = 1 << 20  # distances held at once, and a sixteenth of it vectors of pairs


class BallTree:
    """``points`` (``id, x, label, node``): the rows and the leaf that each is in; and the number of levels under the root."""

    def __init__(self, points: DataFrame, levels: int):
        self.points, self.levels = points, levels


def ball_tree(train: DataFrame, fan: int = 16, leaf: int = 1024, seed: int = 42) -> BallTree:
    """The tree over ``train`` (``id``, ``x`` array<double>, ``label``)."""

    @pandas_udf("child int, dist double")
    def nearest(x: pd.Series, node: pd.Series, centres: pd.Series) -> pd.DataFrame:
        child, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
        for _, rows in pd.Series(np.arange(len(x))).groupby(node.to_numpy()):
            d = _distances(_matrix(x.iloc[rows]), _matrix(centres.iloc[rows.iloc[0]]))
            child[rows] = d.argmin(axis=1)
            dist[rows] = d.min(axis=1)
        return pd.DataFrame({"child": child, "dist": dist})

    points = stage(train.select("id", "x", "label", F.lit(0).cast("bigint").alias("node"), F.lit(1.0).alias("dist")), "ball-points")
    turn = 0
    while True:
        sizes = points.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.max_by("x", F.struct("dist", "id")).alias("far"))
        wide = stage(sizes.where((F.col("n") > leaf) & (F.col("radius") > 0)).select("node", "far"), "ball-open")
        if wide.isEmpty():
            unstage(wide)
            return BallTree(points.drop("dist"), turn)
        order = Window.partitionBy("node").orderBy(hash32(seed + turn, F.col("id")), "id")
        drawn = points.select("node", "id", "x").join(wide.select("node"), "node", "left_semi").withColumn("place", F.row_number().over(order))
        centres = drawn.where(F.col("place") < fan).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("drawn"))
        centres = stage(centres.join(wide, "node").select("node", F.array_append(F.col("drawn.x"), F.col("far")).alias("centres")), "ball-centres")
        dealt = points.select("id", "x", "label", "node").join(centres, "node").withColumn("to", nearest("x", "node", "centres"))
        child = F.col("node") * (fan + 1) + F.col("to.child") + 1
        rest = points.join(centres.select("node"), "node", "left_anti").select("id", "x", "label", "node", "dist")
        moved = stage(dealt.select("id", "x", "label", child.alias("node"), F.col("to.dist").alias("dist")).unionByName(rest), "ball-points")
        for table in (points, wide, centres):
            unstage(table)
        points, turn = moved, turn + 1


def _nearest_rows(q: np.ndarray, t: np.ndarray, ids: np.ndarray, node: np.ndarray, k: int, block: int):
    """For each of ``q`` its ``k`` nearest rows of ``t``, ties by id: number of the query, of the row, distance; rows come sorted by ``node``."""
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    last = np.append(first[1:], len(t))
    centre = np.add.reduceat(t, first, axis=0) / (last - first)[:, None]
    radius = np.maximum.reduceat(np.sqrt(((t - np.repeat(centre, last - first, axis=0)) ** 2).sum(axis=1)), first)
    norm, error = (t * t).sum(axis=1), 1e-9  # far above the rounding of a product of vectors, so no row is lost
    none = np.zeros(0, np.int64)
    for at in range(0, len(q), block):
        part = q[at: at + block]
        own = (part * part).sum(axis=1)
        away = _distances(part, centre)
        low = away - radius - error * (away + radius)
        bound = np.full(len(part), np.inf)
        best = (none, none, np.zeros(0))
        for leaf in np.argsort(low.min(axis=0), kind="stable").tolist():
            asked = np.flatnonzero(~(low[:, leaf] > bound))
            step = max(1, PAIRS // max(1, len(asked)))
            for begin in range(first[leaf], last[leaf], step) if len(asked) else ():
                end = min(begin + step, last[leaf])
                scale = own[asked][:, None] + norm[begin:end]
                near = scale - 2 * (part[asked] @ t[begin:end].T)
                most = np.minimum(bound[asked] ** 2, np.partition(near, k - 1, axis=1)[:, k - 1] if end - begin > k else np.inf)
                row, col = np.nonzero(~(near > most[:, None] + error * scale))
                row, col = asked[row], col + begin
                d = np.concatenate([np.zeros(0)] + [
                    np.sqrt(((part[row[i: i + PAIRS // 16]] - t[col[i: i + PAIRS // 16]]) ** 2).sum(axis=1)) for i in range(0, len(row), PAIRS // 16)])
                row, col, d = (np.concatenate(x) for x in zip(best, (row, col, d)))
                order = np.lexsort((ids[col], d, row))
                place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                keep = order[place < k]
                best = (row[keep], col[keep], d[keep])
                full = order[place == k - 1]
                bound[row[full]] = d[full] * _SLACK
        yield best[0] + at, best[1], best[2]


def search(tree: BallTree, queries: DataFrame, k: int, block: int = 4096, seed: int = 42) -> DataFrame:
    """``qid, id, label, distance, place``: the exact ``k`` nearest rows of each of ``queries`` (``qid``, ``qx``), ties by id.

    A task compares ``block`` queries with a leaf at once.
    """
    rows, asked = tree.points.count(), queries.count()
    pieces = max(1, -(-rows // PIECE))
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    shares = max(1, -(-asked // SHARE), min(tasks, -(-asked // LEAST_SHARE)))

    def part(salt: int, parts: Column, *keys: Column) -> Column:
        return F.pmod(hash32(salt, *keys), parts).cast("int")

    def each(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    wide = tree.points.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).where("parts > 1")
    own = part(seed, F.coalesce("parts", F.lit(1)), F.col("id"))
    held = tree.points.join(wide, "node", "left").withColumn("piece", part(seed + 1, F.lit(pieces), F.col("node"), own)).withColumn("share", each(shares))
    visits = queries.withColumn("share", part(seed + 2, F.lit(shares), F.col("qid"))).withColumn("piece", each(pieces))

    def closest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "id": [], "label": [], "distance": []})
        right = right.sort_values("node", kind="stable")
        ids = right["id"].to_numpy()
        found = _nearest_rows(_matrix(left["qx"]), _matrix(right["x"]), ids, right["node"].to_numpy(), k, block)
        row, col, d = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"qid": left["qid"].to_numpy()[row], "id": ids[col], "label": right["label"].to_numpy()[col], "distance": d})

    on = ["piece", "share"]
    pairs = visits.select(*on, "qid", "qx").groupBy(*on).cogroup(held.select(*on, "node", "id", "x", "label").groupBy(*on))
    found = pairs.applyInPandas(closest, "qid bigint, id bigint, label int, distance double")
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def vote(neighbours: DataFrame, k: int, weights: str = "uniform") -> DataFrame:
    """Majority class among the first ``k`` neighbours, plain or by inverse distance; the lower class of equals."""
    near = neighbours.where(F.col("place") <= k)
    if weights == "distance":
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("qid"))
        near = near.withColumn("_w", F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(1 / F.nullif(F.col("distance"), F.lit(0.0))))
    else:
        near = near.withColumn("_w", F.lit(1.0))
    votes = near.groupBy("qid", "label").agg(F.sum("_w").alias("_v"))
    return votes.groupBy("qid").agg(F.max_by("label", F.struct("_v", -F.col("label"))).alias("y_pred"))


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    fan = Param(Params._dummy(), "fan", "centres of a split", TypeConverters.toInt)
    leaf = Param(Params._dummy(), "leaf", "rows above which a ball is split", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(k=5, weights="uniform", fan=16, leaf=1024)


class NearestNeighbours(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Classifier by the exact nearest training rows; works with ``CrossValidator`` and ``Pipeline``."""

    @keyword_only
    def __init__(self, *, k=None, weights=None, fan=None, leaf=None, featuresCol=None, labelCol=None, predictionCol=None):
        super().__init__()
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _tree(self, dataset: DataFrame) -> BallTree:
        rows = dataset.select(
            F.monotonically_increasing_id().alias("id"), vector_to_array(self.getFeaturesCol()).alias("x"),
            F.col(self.getLabelCol()).cast("int").alias("label"))
        return ball_tree(rows, self.getOrDefault(self.fan), self.getOrDefault(self.leaf))

    def _fit(self, dataset: DataFrame) -> "NearestNeighboursModel":
        return self._copyValues(NearestNeighboursModel(self._tree(dataset)))

    def fitMultiple(self, dataset, paramMaps):
        """One tree serves all choices of ``k`` and ``weights``."""
        if any(p.name not in ("k", "weights") for m in paramMaps for p in m):
            return super().fitMultiple(dataset, paramMaps)
        tree = self._tree(dataset)
        return _FitMultipleIterator(lambda i: self.copy(paramMaps[i])._copyValues(NearestNeighboursModel(tree)), len(paramMaps))


class _Writer(MLWriter):
    def __init__(self, model: "NearestNeighboursModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        tree = self.model.tree
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"levels": tree.levels})
        tree.points.write.parquet(f"{path}/points")


class _Reader(MLReader):
    def load(self, path: str) -> "NearestNeighboursModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = NearestNeighboursModel(BallTree(self.sparkSession.read.parquet(f"{path}/points"), metadata["levels"]))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class NearestNeighboursModel(Model, _Settings, MLReadable, MLWritable):
    """The fitted tree; saving writes its rows as parquet beside the parameters."""

    def __init__(self, tree: BallTree | None = None):
        super().__init__()
        self.tree = tree

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = stage(dataset.withColumn("_qid", F.monotonically_increasing_id()), "to-classify")  # ids must not change between passes
        queries = rows.select(F.col("_qid").alias("qid"), vector_to_array(self.getFeaturesCol()).alias("qx"))
        k = self.getOrDefault(self.k)
        voted = vote(search(self.tree, queries, k), k, self.getOrDefault(self.weights)).withColumnRenamed("qid", "_qid")
        # A row per query on both sides; broadcast, each such table would go through the driver.
        return rows.join(voted.hint("merge"), "_qid", "left").withColumn(self.getPredictionCol(), F.col("y_pred").cast("double")).drop("_qid", "y_pred")

    def setPredictionCol(self, value: str) -> "NearestNeighboursModel":
        return self._set(predictionCol=value)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()
