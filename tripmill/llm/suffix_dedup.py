"""Byte strings that occur more than once anywhere, found by suffix arrays over shared contexts.

Every window of ``width`` bytes names one anchor: the few bytes in it whose
hash is smallest, the leftmost on ties. The choice depends on the window alone,
so equal windows name equal anchors at equal distances. Neighbouring windows of
a text that name the same anchor form one context, the bytes they cover.
Contexts that are equal as a whole are counted with partial sums. A context that
occurs once but shares its anchor with others is cut into parts by the distance
of its windows from the anchor. All windows of a part hold the same core, so
parts are grouped by it, and in each group the core is one symbol between the
few bytes left and right of it. A suffix array over the parts of a group
(``gsaca.suffix_array``) then tells whether a window occurs elsewhere: a
neighbour in suffix order begins with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.llm import common as C
from tripmill.llm.gsaca import suffix_array
from tripmill.session import stage, unstage

PARTS = 8  # of a context, by distance from the anchor
ARRAY_SYMBOLS = 1 << 17  # gathered for one suffix array
GROUP = 1500  # distinct parts with one core compared by suffix array; larger groups are counted by window

_CONTEXT = "doc_id bigint, th int, anchor bigint, digest bigint, start int, windows int, offset int"
_BODY = "anchor bigint, digest bigint, n bigint, doc_id bigint, th int, start int, windows int, offset int, body binary"
_PART = "anchor bigint, context bigint, part int, core bigint, digest bigint, doc_id bigint, th int, start int, windows int, n bigint"
_OPEN = "anchor bigint, part int, core bigint, kinds bigint, n bigint, doc_id bigint, th int, start int, lead binary, tail binary"
_RUN = "doc_id bigint, th int, start int, stop int"


def anchor_width(width: int) -> int:
    """Bytes of an anchor, so that a window has a multiple of ``PARTS`` places for it."""
    return width + 1 - PARTS * max(1, width * 5 // 6 // PARTS)


def _anchors(part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all strings of ``k`` bytes, and those of the power of two below it, of which longer ones are made."""
    h, size = C.mix(part.astype(np.uint64), np.full(1, 400, np.uint64)), 1
    while size * 2 <= k:
        h, size = C.mix(h[:-size], h[size:], size + 1), size * 2
    return (C.mix(h[: size - k], h[k - size:], k + 1) if k > size else h), h, size


def _whole(base: np.ndarray, size: int, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the strings of ``width`` bytes that start at ``at``."""
    out = base[at]
    for offset in [*range(size, width - size, size), width - size]:
        out = C.mix(out, base[at + offset], offset)
    return out


def _contexts(width: int):
    k = anchor_width(width)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = C.text_bytes(batch.column("text"))
        ids, th = batch.column("doc_id"), batch.column("th").to_numpy()
        found = []
        for at, end in C.slices(offsets):
            part, starts = data[offsets[at]: offsets[end]], offsets[at:end] - offsets[at]
            lengths = np.diff(offsets[at: end + 1])
            windows = np.maximum(lengths - width + 1, 0)
            if not windows.any():
                continue
            anchors, base, size = _anchors(part, k)
            chosen = C.position_of(C.sliding_minimum(C.with_position(anchors), width - k + 1))
            row = np.repeat(np.arange(end - at), windows)
            place = C.spans(starts, windows)
            position = chosen[place]
            new = np.ones(len(place), bool)
            new[1:] = (position[1:] != position[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            s, e, p, r = place[first], place[last], position[first], row[first]
            shape = ((p - s) * 4096 + (e - s)).astype(np.uint64)
            digest = C.mix(C.mix(_whole(base, size, s, width), _whole(base, size, e, width), 3), shape, 5)
            found.append((r + at, anchors[p], digest, s - starts[r], e - s + 1, p - s))
        if not found:
            return None
        r, anchor, digest, s, n, off = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(r)), pa.array(th[r], pa.int32()), pa.array(C.signed(anchor)),
             pa.array(C.signed(digest)), pa.array(s, pa.int32()), pa.array(n, pa.int32()),
             pa.array(off, pa.int32())],
            names=["doc_id", "th", "anchor", "digest", "start", "windows", "offset"])
    return run


def _bodies(width: int):
    """The bytes of the contexts listed with each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = C.text_bytes(batch.column("text"))
        listed = batch.column("contexts")
        row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
        each = listed.flatten()
        column = {c: each.field(c) for c in ("anchor", "digest", "n", "start", "windows", "offset")}
        first = offsets[row] + column["start"].to_numpy()
        last = first + column["windows"].to_numpy() + width - 1
        column["body"] = pa.array([data[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())], pa.binary())
        take = pa.array(row)
        column |= {c: batch.column(c).take(take) for c in ("doc_id", "th")}
        names = [x.split()[0] for x in _BODY.split(", ")]
        return pa.RecordBatch.from_arrays([column[c] for c in names], names=names)
    return run


def _places(batch: pa.RecordBatch, width: int):
    """For each part: its number, the contexts that have it, their first and last windows in it, and the place of the anchor."""
    step = (width - anchor_width(width) + 1) // PARTS
    data, offsets = C.text_bytes(batch.column("body"))
    starts, windows = offsets[:-1], batch.column("windows").to_numpy().astype(np.int64)
    anchor = starts + batch.column("offset").to_numpy()
    for part in range(PARTS):
        low, high = part * step, (part + 1) * step - 1  # distances from window start to anchor
        first = np.maximum(anchor - high, starts)
        last = np.minimum(anchor - low, starts + windows - 1)
        row = np.flatnonzero(first <= last)
        yield part, low, high, row, first[row], last[row], anchor[row], data, starts


def _parts(width: int):
    """The parts of each context: core, and a digest of all of it."""
    step = (width - anchor_width(width) + 1) // PARTS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part, low, _, row, f, e, p, data, starts in _places(batch, width):
            if not part:
                cores, whole = C.window_hashes(data, width - step + 1), C.window_hashes(data, width)
            shape = ((p - f) * 4096 + (e - f)).astype(np.uint64)
            digest = C.mix(C.mix(whole[f], whole[e], 3), shape, 5)
            out.append((row, np.full(len(row), part), cores[p - low], digest, f - starts[row], e - f + 1))
        row, part, core, digest, first, count = (np.concatenate(x) for x in zip(*out))
        take = pa.array(row)
        start = batch.column("start").to_numpy()[row] + first
        return pa.RecordBatch.from_arrays(
            [batch.column("anchor").take(take), batch.column("digest").take(take), pa.array(part, pa.int32()), pa.array(C.signed(core)),
             pa.array(C.signed(digest)), batch.column("doc_id").take(take), batch.column("th").take(take),
             pa.array(start, pa.int32()), pa.array(count, pa.int32()), batch.column("n").take(take)],
            names=[x.split()[0] for x in _PART.split(", ")])
    return run


def _opened(width: int):
    """The bytes before and after the core for the parts listed with each context."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        listed = [{x["part"]: x for x in row} for row in batch.column("parts").to_pylist()]
        ids, th, start = (batch.column(c).to_pylist() for c in ("doc_id", "th", "start"))
        anchors = batch.column("anchor").to_pylist()
        out = []
        for part, low, high, row, f, e, p, data, starts in _places(batch, width):
            for i, a, z, at, s in zip(row.tolist(), f.tolist(), e.tolist(), p.tolist(), starts[row].tolist()):
                if (x := listed[i].get(part)) is not None:
                    out.append((anchors[i], part, x["core"], x["kinds"], x["n"], ids[i], th[i], start[i] + a - s,
                                data[a: at - low].tobytes(), data[at + width - high: z + width].tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _OPEN.split(", ")]) if out else None
    return run


def repeats(texts: list[tuple[int, bytes, bytes]], step: int) -> list[np.ndarray]:
    """For each (group, lead, tail), whether each of its windows also starts elsewhere in the texts.

    A window is ``step`` symbols: the core of the group and bytes around it.
    """
    names: dict[int, int] = {}
    pieces = []
    for core, lead, tail in texts:
        name = names.setdefault(core, 257 + len(names))
        pieces.append(np.concatenate((
            np.frombuffer(lead, np.uint8).astype(np.int64) + 1, [name], np.frombuffer(tail, np.uint8).astype(np.int64) + 1, [0])))
    symbols = np.concatenate(pieces)
    starts = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    listed = symbols.tolist()
    order = np.array(suffix_array(listed))
    hashes = C.window_hashes(symbols, step)
    order = order[order < len(hashes)]
    same = hashes[order[1:]] == hashes[order[:-1]]
    flagged = np.zeros(len(symbols), bool)
    for i in np.flatnonzero(same):
        a, b = int(order[i]), int(order[i + 1])
        if listed[a: a + step] == listed[b: b + step]:
            flagged[a] = flagged[b] = True
    return [flagged[s: s + len(p) - step] for s, p in zip(starts, pieces)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _compare(width: int):
    """Windows that occur elsewhere, for each part that occurs once; rows come sorted by group."""
    step = (width - anchor_width(width) + 1) // PARTS

    def emit(held: list[tuple]) -> pa.RecordBatch | None:
        out = []
        flags = repeats([((r[0], r[1], r[2]), r[3], r[4]) for r in held], step)
        for (*_, doc_id, th, start, n), found in zip(held, flags):
            if n == 1:
                out += [(doc_id, th, start + a, start + b - 1 + width) for a, b in _runs(found)]
        if not out:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
            names=["doc_id", "th", "start", "stop"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= ARRAY_SYMBOLS and held[-1][:3] != row[:3]:
                    if (out := emit(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + len(row[4]) + 2
        if held and (out := emit(held)) is not None:
            yield out
    return run


def _window_rows(width: int):
    """Each window of the parts of very large groups: two hashes of it, and where it starts."""
    step = (width - anchor_width(width) + 1) // PARTS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        core = batch.column("core").to_numpy()
        for i, (lead, tail) in enumerate(zip(batch.column("lead").to_pylist(), batch.column("tail").to_pylist())):
            symbols = np.concatenate((np.frombuffer(lead, np.uint8).astype(np.uint64),
                                      core[i: i + 1].view(np.uint64) | np.uint64(256), np.frombuffer(tail, np.uint8).astype(np.uint64)))
            h, g = C.window_hashes(symbols, step), C.window_hashes(symbols + np.uint64(1 << 40), step)
            out.append((np.full(len(h), i), C.signed(h), C.signed(g), np.arange(len(h))))
        i, h, g, at = (np.concatenate(x) for x in zip(*out))
        take = pa.array(i)
        start = batch.column("start").to_numpy()[i] + at
        return pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(g), batch.column("doc_id").take(take), batch.column("th").take(take),
             pa.array(start, pa.int32()), batch.column("n").take(take)],
            names=["h", "g", "doc_id", "th", "start", "n"])
    return run


def _cut(extra: list[str]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import hashlib

        data, offsets = C.text_bytes(batch.column("text"))
        runs = batch.column("runs").to_pylist()
        rows = []
        for i, found in enumerate(runs):
            body = data[offsets[i]: offsets[i + 1]].tobytes()
            kept, removed, groups = C.kept_ranges(len(body), [(x["start"], x["stop"]) for x in found or ()])
            rest = b"".join(body[a:b] for a, b in kept)
            rows.append((len(body), removed, groups, rest, hashlib.sha256(rest).hexdigest()))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in extra] + [pa.array(c, t) for c, t in zip(cols, kinds)],
            names=[*extra, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
    return run


def repeated_runs(docs: DataFrame, width: int = 400) -> DataFrame:
    """Byte ranges covered by windows that occur elsewhere: ``doc_id, th, start, stop``, overlapping.

    ``docs`` has ``doc_id``, ``text`` (not null) and ``th`` (hash of the text).
    Rows with equal id and text are separate texts and therefore repeat each other.
    """
    contexts = stage(C.map_batches(docs.select("doc_id", "th", "text"), _contexts(width), _CONTEXT), "contexts")
    shared = (
        contexts.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("times"), F.min("digest").alias("one"), F.max("digest").alias("other"))
        .where("times > 1").select("anchor", (F.col("one") < F.col("other")).alias("mixed"))
    )
    met = stage(contexts.join(shared, "anchor"), "contexts-met")
    unstage(contexts)
    stop = (F.col("start") + F.col("windows") + width - 1).alias("stop")
    equal = met.where("not mixed").select("doc_id", "th", "start", stop)  # an anchor with one kind of context, more than once
    mixed = met.where("mixed").drop("mixed")
    place = F.min(F.struct("doc_id", "th", "start", "windows", "offset")).alias("at")
    kinds = stage(mixed.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), place), "context-kinds")
    often = mixed.join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"]).select("doc_id", "th", "start", stop)
    single = kinds.groupBy("anchor").agg(F.count_if(F.col("n") == 1).alias("single")).where("single > 0").select("anchor")
    wanted = kinds.join(single, "anchor").select("at.doc_id", "at.th", F.struct("anchor", "digest", "n", "at.start", "at.windows", "at.offset").alias("x"))
    listed = wanted.groupBy("doc_id", "th").agg(F.collect_list("x").alias("contexts")).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    same = F.expr("doc_id <=> _d and th = _t")
    texts = docs.select("doc_id", "th", "text").join(listed, same).select("doc_id", "th", "text", "contexts")
    bodies = stage(C.map_batches(texts, _bodies(width), _BODY), "bodies")
    parts = stage(C.map_batches(bodies, _parts(width), _PART), "parts")
    group = ["anchor", "part", "core"]
    part_kinds = stage(parts.groupBy(*group, "digest").agg(F.sum("n").alias("n"), F.min("context").alias("context")), "part-kinds")
    sizes = (
        part_kinds.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
        .where("kinds > 1 and single > 0").select(*group, "kinds")
    )
    opened = part_kinds.join(sizes, group).groupBy("anchor", "context").agg(F.collect_list(F.struct("part", "core", "kinds", "n")).alias("parts"))
    open_parts = stage(C.map_batches(bodies.join(opened.withColumnRenamed("context", "digest"), ["anchor", "digest"]), _opened(width), _OPEN), "parts-open")
    unstage(bodies)
    small = open_parts.where(F.col("kinds") <= GROUP).select(*group, "lead", "tail", "doc_id", "th", "start", "n")
    compared = small.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(width), _RUN)
    windows = C.map_batches(open_parts.where(F.col("kinds") > GROUP), _window_rows(width),
                            "h bigint, g bigint, doc_id bigint, th int, start int, n bigint")
    common = windows.groupBy("h", "g").agg(F.sum("n").alias("times")).where("times > 1").select("h", "g")
    counted = windows.where("n = 1").join(common, ["h", "g"]).select(
        "doc_id", "th", "start", (F.col("start") + width).alias("stop"))
    equal_parts = parts.where("n = 1").join(
        part_kinds.where("n > 1").select(*group, "digest"), [*group, "digest"])
    found = stage(
        equal.unionByName(often).unionByName(equal_parts.select("doc_id", "th", "start", stop))
        .unionByName(compared).unionByName(counted), "byte-runs")
    for table in (met, kinds, parts, part_kinds, open_parts):
        unstage(table)
    return found


def remove_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """Every row of ``docs`` with the bytes that are left: ``n_bytes, n_removed, n_spans, kept (binary), kept_sha256``.

    A byte goes if any window of ``width`` bytes over it also starts anywhere
    else, in the same text or another; windows are judged on the input. A null
    text counts as empty; texts under ``width`` bytes lose nothing; null and
    repeated ids are allowed; an empty table gives an empty table. Other columns
    of ``docs`` are left out.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.hash("text"))
    runs = repeated_runs(texts, width).groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("start", "stop")).alias("runs"))
    joined = texts.join(
        runs.withColumnsRenamed({"doc_id": "_d", "th": "_t"}), F.expr("doc_id <=> _d and th = _t"), "left"
    ).select("doc_id", "text", "runs")
    return C.map_batches(joined, _cut(["doc_id"]),
                         "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
