"""Bottom-k sketches of word shingles, all in DataFrame functions.

The sketch of a text is the sorted list of the ``K`` smallest distinct hashes of
its shingles (of all, if there are fewer; then every estimate is exact). The
sketch of several parts is what is smallest in theirs together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.operators.scan import ordered_blocks, with_key

K = 128
SHINGLE = 5
FAN_IN = 64  # sketches merged in one group at once
_SPACE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words between ASCII white space; none for null and for blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The ``k`` smallest distinct hashes of runs of ``size`` words; fewer words are one shingle, no words none."""

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - size)
        hashes = F.when(F.size(w) > size, F.transform(places, lambda i: F.xxhash64(*[w[i + j] for j in range(size)])))
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return smallest(F.coalesce(hashes, short), k)

    # A one-element transform names the words once, so that they are not split for every use.
    return F.transform(F.array(words(text)), of)[0]


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that are in both; 1 for two texts without shingles."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, F.size(a)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of the first text that are in the second; 1 if it has none."""
    union = distinct_count(merge(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def merge_parts(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """``keys`` and ``sketch`` of each group of ``parts``, which has those columns; null keys are a group too.

    Groups are merged in rounds of about ``FAN_IN`` sketches, so that no group,
    however large, meets in one task.
    """
    largest = parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    left = parts.select(*keys, "sketch").withColumn("_h", F.xxhash64(F.monotonically_increasing_id()))
    gathered = smallest(F.flatten(F.collect_list("sketch")), k).alias("sketch")
    while largest > FAN_IN:
        largest = -(-largest // FAN_IN)
        left = (
            left.withColumn("_s", F.pmod("_h", F.lit(largest))).groupBy(*keys, "_s").agg(gathered)
            .withColumn("_h", F.xxhash64("_s")).drop("_s")
        )
    return left.groupBy(*keys).agg(gathered)


def neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, next_id, previous_id, previous_chars`` for each distinct id, in ascending order and closed to a ring.

    Only ids and lengths are sorted; blocks are ranges of the sort and each block
    hands its edges on. A null id comes first. Rows that share an id count with
    the largest of their lengths.
    """
    ids = docs.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    ordered = ordered_blocks(ids, [], ["doc_id"])
    order = Window.partitionBy("blk").orderBy(F.asc_nulls_first("doc_id"))
    # Structs tell a neighbour with a null id from no neighbour.
    me = F.struct("doc_id", "n_chars")
    inside = ordered.select("blk", me.alias("me"), F.lag(me).over(order).alias("before"), F.lead(me).over(order).alias("after"))
    edge = ordered.groupBy("blk").agg(
        F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "n_chars")).alias("low"),
        F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "n_chars")).alias("high"))
    blocks = Window.orderBy("blk")  # one row per block
    everything = blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    handed = edge.select(
        "blk", F.coalesce(F.lag("high").over(blocks), F.last("high").over(everything)).alias("high"),
        F.coalesce(F.lead("low").over(blocks), F.first("low").over(everything)).alias("low"))
    pair = lambda s: F.struct(F.col(f"{s}.doc_id"), F.col(f"{s}.n_chars"))
    return inside.join(handed, "blk").select(
        F.col("me.doc_id"), F.coalesce("after", pair("low")).getField("doc_id").alias("next_id"),
        F.coalesce("before", pair("high")).getField("doc_id").alias("previous_id"),
        F.coalesce("before", pair("high")).getField("n_chars").alias("previous_chars"))


def with_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch`` for each row of ``docs``.

    The edited text has its last quarter (in code points, rounded down) replaced
    by as much of the beginning of the text of the next id, or all of it. A null
    text counts as empty. Rows that share an id have the same next text; of rows
    that share the next id the one with the smallest beginning is used. With one
    id the text is its own next. An empty table gives an empty table; other
    columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    # Ids are joined as structs, which are never null; the sum over heads then shares its partitioning with the join,
    # and both uses of the texts read the same columns, so they are shuffled once.
    own = with_key(docs.select("doc_id", text.alias("text")), ["doc_id"]).drop("doc_id")
    facts = neighbours(docs.select("doc_id", F.length(text).cast("bigint").alias("n_chars")))
    placed = own.join(with_key(facts, ["doc_id"]).drop("doc_id", "next_id"), "_key")
    begins = F.left("text", F.floor(F.col("previous_chars") / 4).cast("int")).alias("head")
    heads = (
        placed.select(
            F.struct(F.col("previous_id").alias("doc_id")).alias("_key"), F.struct(begins, sketch(F.col("text")).alias("sketch")).alias("next"))
        .groupBy("_key").agg(F.min("next").alias("next"))
    )
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - moved), F.left("next.head", moved))
    both = placed.join(heads, "_key").select(
        F.col("_key.doc_id").alias("doc_id"), n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), F.col("next.sketch").alias("next_sketch"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("sketch"),
        sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
