"""Exact substring removal by suffix arrays.

A byte is removed if it is covered by a ``LENGTH``-byte string that also starts in a document with a smaller id.

1. Equal texts are one text: all but the one with the smallest id go as a whole (from ``LENGTH`` bytes on).
2. Every window of ``LENGTH`` bytes is named by the smallest hash of its ``GRAM``-byte strings. Equal windows have equal names, so
   a window whose name occurs in one text only is no copy. Names go, distinct per text and packed, to buckets by hash; those
   in two texts come back to the batch of texts that asked.
3. Runs of windows with the same shared name are cut out as segments, grouped by name, and equal segments are made one
   with the smallest id before anything else, so a passage in a third of all texts costs one row per task.
4. A task sorts the suffixes of a group of segments in two stages: suffixes smaller than their successors are sorted
   directly, the others are induced by scanning the buckets of first bytes in order. Windows that share ``LENGTH`` bytes
   with their neighbour in this order form classes; each window learns the smallest id of its class.
5. A name with more than ``HOT`` distinct segments is not left to one task: its windows are grouped by Spark.

Nothing is sampled or capped; a chance collision of names only adds segments that the sorting then finds unequal.

Defined cases: a null text has no bytes; texts shorter than ``LENGTH`` keep all; rows with the same id never remove from
each other; a null id removes from nobody and loses nothing; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import broadcast_if_small, stored

LENGTH, GRAM = 50, 24
SEPARATOR = 0xFF  # no byte of UTF-8
#: Bytes of text per batch, bytes hashed at once, segment bytes sorted at once, and distinct segments of a hot name.
BATCH_BYTES, CHUNK_BYTES, SORT_BYTES, HOT = 8 << 20, 1 << 20, 3 << 20, 20_000
_P = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(5)]
_NAME = np.uint64((1 << 48) - 1)


def names(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The name (48 bits) of every window of ``length`` bytes."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    parts, n = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * n <= gram:
        a = parts[n]
        parts[2 * n] = a[:-n] * _P[n.bit_length() - 1] + a[n:]
        n *= 2
    h, done = parts[n], n
    while done < gram:
        n = max(k for k in parts if k <= gram - done)
        a = parts[n][done:]
        h = h[:len(a)] * _P[n.bit_length() - 1] + a[:len(h)]
        done += n
    h = h[:len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) & _NAME
    width, n = length - gram + 1, 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[:len(h) - (width - n)], h[width - n:]) if width > n else h


def runs(texts: list[bytes]):
    """(text, first window, last window, name) of every run of windows with the same name, as arrays; texts are
    hashed together in chunks."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
            size, end = size + len(texts[end]), end + 1
        lengths = np.array([len(t) for t in texts[at:end]])
        found = names(np.frombuffer(b"".join(texts[at:end]), np.uint8))
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(end - at), lengths)[:len(found)]
        inside = np.arange(len(found)) + LENGTH <= (starts + lengths)[owner]
        place = np.flatnonzero(inside)
        if len(place):
            name, own = found[place], owner[place]
            new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (own[1:] != own[:-1])])
            last = np.r_[new[1:] - 1, len(place) - 1]
            yield own[new] + at, place[new] - starts[own[new]], place[last] - starts[own[new]], name[new]
        at = end


def packed(names_: np.ndarray) -> bytes:
    return names_.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in the order of (at least) their first 56 bytes, and the eight bytes at every place as one number."""
    n = len(data)
    eight = np.concatenate([data, np.zeros(64, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        eight = (eight[:-k] << np.uint64(8 * k)) | eight[k:]
    # A suffix is smaller than its successor if the next different byte is larger; the last one is not.
    differs = np.flatnonzero(np.r_[data[1:] != data[:-1], True])
    nxt = differs[np.searchsorted(differs, np.arange(n))]
    follow = np.r_[data[1:], 0][nxt]
    small = (data < follow) & (nxt < n - 1)
    direct = np.flatnonzero(small)
    direct = direct[np.lexsort([eight[direct + 8 * k] for k in range(6, -1, -1)])]
    first = data[direct]
    bounds = np.searchsorted(first, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[data[-1]].append(np.array([n - 1]))
    order = []
    for c in range(256):
        wave = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(data[before] == c) & ~small[before]]
        bucket.append(direct[bounds[c]:bounds[c + 1]])
        here = np.concatenate(bucket)
        order.append(here)
        before = here[here > 0] - 1
        before = before[(data[before] > c) & ~small[before]]
        if len(before):
            by = np.argsort(data[before], kind="stable")
            before = before[by]
            cut = np.flatnonzero(np.r_[True, data[before[1:]] != data[before[:-1]]])
            for part in np.split(before, cut[1:]):
                pending[data[part[0]]].append(part)
    return np.concatenate(order), eight


def earlier(segments: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For every segment, which of its windows also start in a segment with a smaller id."""
    joined = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    lengths = np.array([len(s) for s in segments])
    starts = np.cumsum(lengths + 1) - lengths - 1
    order, eight = suffix_order(joined)
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    order = order[order + LENGTH <= (starts + lengths)[owner[order]]]
    offsets = [*range(0, LENGTH - 7, 8), LENGTH - 8]
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in offsets:
        v = eight[order + k]
        same &= v[1:] == v[:-1]
    head = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.empty(0, np.int64)
    least = np.repeat(np.minimum.reduceat(ids[owner[order]], head), np.diff(np.r_[head, len(order)])) if len(order) else np.empty(0)
    hit = np.zeros(len(joined), bool)
    hit[order[least < ids[owner[order]]]] = True
    return [hit[s:s + n - LENGTH + 1] for s, n in zip(starts, lengths, strict=True)]


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, first (smallest id) and spans (removed byte ranges of the text with that id) of every distinct text that loses something."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))
    rows = rows.where(F.col("id").isNotNull() & (F.length("body") >= LENGTH)).withColumn("digest", F.unhex(F.md5("body")))
    firsts = stored(rows.select("digest", "id", F.length("body").alias("n")).groupBy("digest").agg(F.min("id").alias("first"), F.first("n").alias("n"))
                    .withColumn("number", F.monotonically_increasing_id()), "suffix-texts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    # Few buckets, so that a batch of rows sends large blobs: their number grows with the text, not with the partitions.
    batches, buckets = max(24, -(-total // BATCH_BYTES)), max(24, -(-total // (4 * BATCH_BYTES)))
    distinct = (rows.join(broadcast_if_small(firsts.drop("n")), "digest").where("id = first")
                .withColumn("batch", F.pmod(F.xxhash64("digest"), F.lit(batches))).select("batch", "id", "number", "body"))

    def ask(tables):
        for table in tables:
            bodies, batch = table.column("body").to_pylist(), np.array(table.column("batch").to_pylist(), np.int64)
            asked = [np.unique(np.stack([own.astype(np.uint64), name], 1), axis=0) for own, _, _, name in runs(bodies)]
            if not asked:
                continue
            pairs = np.concatenate(asked)
            cell = batch[pairs[:, 0].astype(np.int64)] * buckets + (pairs[:, 1] % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((pairs[:, 1], cell))
            cell, name = cell[by], pairs[by, 1]
            keep = np.ones(len(name), bool)  # a name is sent twice at most by a batch of rows: that says enough
            keep[2:] = (name[2:] != name[:-2]) | (cell[2:] != cell[:-2])
            cell, name = cell[keep], name[keep]
            cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            blobs = [packed(part) for part in np.split(name, cut[1:])]
            yield pa.record_batch([pa.array(cell[cut] % buckets), pa.array(cell[cut] // buckets), pa.array(blobs, pa.binary())], ["bucket", "batch", "names"])

    def answer(table):
        blobs = table.column("names").to_pylist()
        found = unpacked(blobs)
        batch = np.repeat(np.array(table.column("batch").to_pylist()), [len(b) // 6 for b in blobs])
        by = np.lexsort((batch, found))
        found, batch = found[by], batch[by]
        head = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.empty(0, np.int64)
        many = np.repeat(np.diff(np.r_[head, len(found)]) > 1, np.diff(np.r_[head, len(found)]))
        found, batch = found[many], batch[many]
        by = np.lexsort((found, batch))
        found, batch = found[by], batch[by]
        cut = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]) if len(batch) else []
        return pa.table({"batch": pa.array(batch[cut] if len(batch) else [], pa.int64()),
                         "shared": pa.array([packed(np.unique(p)) for p in np.split(found, cut[1:])] if len(batch) else [], pa.binary())})

    shared = stored(distinct.mapInArrow(ask, "bucket long, batch long, names binary").groupBy("bucket").applyInArrow(answer, "batch long, shared binary"), "suffix-shared")

    def segments(texts, told):
        bodies = texts.column("body").to_pylist()
        ids, numbers = texts.column("id").to_pylist(), texts.column("number").to_pylist()
        known = np.sort(unpacked(told.column("shared").to_pylist())) if len(told) else np.empty(0, np.uint64)
        out: list[tuple] = []
        if len(known):
            for own, first, last, name in runs(bodies):
                at = np.searchsorted(known, name)
                hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == name)
                for o, a, b, m in zip(own[hit].tolist(), first[hit].tolist(), last[hit].tolist(), name[hit].tolist(), strict=True):
                    out.append((m, bodies[o][a:b + LENGTH], numbers[o], ids[o], a))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "segment", "number", "id", "start"])

    cut = stored(distinct.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(
        segments, "name long, segment binary, number long, id long, start long"), "suffix-segments")
    single = stored(cut.groupBy("name", "segment").agg(F.min("id").alias("first"), F.max("id").alias("last")), "suffix-distinct")
    # A name with one segment needs no sorting: its later texts lose the segment, its first one nothing.
    kinds = single.groupBy("name").agg(F.count("*").alias("kinds"), F.sum(F.length("segment") + 1).alias("bytes")).where("kinds > 1")
    kinds = stored(kinds, "suffix-names")
    weight = kinds.agg(F.sum("bytes")).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // SORT_BYTES))
    several = single.join(kinds.select("name", "kinds"), "name")

    def sort(table):
        found = earlier(table.column("segment").to_pylist(), np.array(table.column("first").to_pylist(), np.int64)) if len(table) else []
        some = [i for i, f in enumerate(found) if f.any()]
        edges = [np.flatnonzero(np.diff(np.r_[0, found[i].astype(np.int8), 0])).reshape(-1, 2).tolist() for i in some]
        return pa.table({"name": table.column("name").take(some), "segment": table.column("segment").take(some).cast(pa.binary()),
                         "windows": pa.array(edges, pa.list_(pa.list_(pa.int64())))})

    sorted_ = (several.where(F.col("kinds") <= HOT).withColumn("part", F.pmod(F.xxhash64("name"), F.lit(groups)))
               .groupBy("part").applyInArrow(sort, "name long, segment binary, windows array<array<long>>"))
    each = several.where(F.col("kinds") > HOT).select("name", "segment", "first", F.explode(F.expr(f"sequence(0L, length(segment) - {LENGTH}L)")).alias("p"))
    each = each.withColumn("window", F.expr(f"substring(segment, cast(p + 1 as int), {LENGTH})"))
    lowest = each.groupBy("name", "window").agg(F.min("first").alias("low"))
    hot = (each.join(lowest, ["name", "window"]).where("low < first").groupBy("name", "segment")
           .agg(F.transform(F.collect_list("p"), lambda p: F.array(p, p + 1)).alias("windows")))
    windows = stored(sorted_.union(hot), "suffix-windows")
    # Back to the texts: (name, hash of the segment) stands for a segment, 112 bits in all.
    code = F.xxhash64("segment").alias("code")
    known = stored(single.select("name", code, "first").join(windows.select("name", code, "windows"), ["name", "code"], "left"), "suffix-known")
    lost = (cut.select("name", code, "number", "id", "start", F.length("segment").alias("size"))
            .join(known, ["name", "code"]).where((F.col("id") > F.col("first")) | F.col("windows").isNotNull()))
    whole = F.array(F.array(F.lit(0).cast("long"), (F.col("size") - LENGTH + 1).cast("long")))
    spans = F.transform(F.when(F.col("id") > F.col("first"), whole).otherwise(F.col("windows")),
                        lambda w: F.struct((F.col("start") + w[0]).alias("s"), (F.col("start") + w[1] + LENGTH - 1).alias("e")))
    merged = """aggregate(found, cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).e >= x.s,
           concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e)))),
           concat(a, array(named_struct('s', x.s, 'e', x.e)))))"""
    pieces = lost.select("number", F.explode(spans).alias("x"))
    per_text = pieces.groupBy("number").agg(F.sort_array(F.collect_list("x")).alias("found")).select("number", F.expr(merged).alias("spans"))
    return stored(firsts.join(per_text, "number", "left").select("digest", "first", "spans"), "suffix-spans")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans (removed byte ranges) and kept (the remaining bytes) for every row. Only texts that lose a part are
    moved to their spans; a text that goes or stays as a whole needs none."""
    lost = removals(docs, key, text)
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")).withColumn("digest", F.unhex(F.md5("body")))
    told = broadcast_if_small(stored(lost.select("digest", "first", F.col("spans").isNotNull().alias("partly")), "suffix-told"))
    known = rows.join(told, "digest", "left")
    span = "array<struct<s:bigint,e:bigint>>"
    cut = (F.col(key) == F.col("first")) & F.col("partly")
    n = F.length("body").cast("long")
    plain = known.where(~F.coalesce(cut, F.lit(False))).select(key, n.alias("n_bytes"), F.expr(
        f"if(coalesce(`{key}` > first, false), array(named_struct('s', 0L, 'e', cast(length(body) as bigint))), cast(array() as {span}))").alias("spans"),
        F.when(F.coalesce(F.col(key) > F.col("first"), F.lit(False)), F.lit(b"")).otherwise(F.col("body")).alias("kept"))
    kept = """aggregate(spans, named_struct('at', 0L, 'out', cast('' as binary)),
        (a, x) -> named_struct('at', x.e, 'out', concat(a.out, substring(body, cast(a.at + 1 as int), cast(x.s - a.at as int)))),
        a -> concat(a.out, substring(body, cast(a.at + 1 as int))))"""
    parts = known.where(cut).select(key, "digest", "body").join(lost.where("spans is not null").select("digest", "spans"), "digest")
    return plain.union(parts.select(key, n.alias("n_bytes"), "spans", F.expr(kept).alias("kept")))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result of query op9."""
    return found.select(key, "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.e - x.s)").alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
