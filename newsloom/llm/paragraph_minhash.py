"""Repeated paragraphs by MinHash banding.

Paragraphs are the lines of ``WORDS`` words or more, and, so that a repeated passage is found wherever it stands in a line or
across lines, blocks of ``WORDS`` words at places that the text itself chooses (the smallest hash of any ``WORDS`` + 1 places in a
row): a passage of 2 x ``WORDS`` + 1 words holds a whole block. Blocks must be equal; lines may differ a little.

``BANDS`` bands of ``ROWS`` minima are tuned for recall: a pair of lines at similarity 0.8 meets in a band with probability
1 - (1 - 0.8^3)^8 = 99.7 %. Equal lines are one before banding; lines that meet in a band are compared with the first line of
the band, then, where a band still holds several classes, by prefix filtering, so no band pairs all its lines. The exact Jaccard
similarity of five-word shingles verifies. Components of links are classes; a class keeps the paragraphs of its smallest
document id, and the others are removals.

Defined cases: null and wordless texts have no paragraphs; documents with equal texts repeat each other as a whole; rows with
the same id do not repeat each other; a null id is neither source nor removal; shorter paragraphs are never removed alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import broadcast_if_small, over_batches, stored
from newsloom.llm.components import components
from newsloom.llm.order_minhash import SHINGLE, SIMILARITY, Words, mixed, prefix_links, shingles

WORDS, BANDS, ROWS = 25, 8, 3
#: Characters of texts that are hashed at once.
CHUNK_CHARS = 1 << 18
_rng = np.random.default_rng(3)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashed_lines(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines (ranges of ``words``, each of five words at least): two hashes of the ordered shingles, and one hash per band of their minima.

    Shingles of all words are hashed at once; a line takes those that lie in it.
    """
    n = len(words) - SHINGLE + 1
    marks = np.zeros(n + 1, np.uint64)  # one more, so that a last range has an end
    for k in range(SHINGLE):
        marks[:n] = mixed(marks[:n] + words[k:n + k] + np.uint64(k + 1))
    cut = np.stack([starts, ends - SHINGLE + 1], 1).ravel()
    place = np.zeros(n + 1, np.uint64)
    sizes = ends - SHINGLE + 1 - starts
    place[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    one = mixed(np.add.reduceat(mixed(marks + place), cut)[::2])
    two = mixed(np.bitwise_xor.reduceat(marks * _A[0] + place, cut)[::2])
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(starts), BANDS)).copy()
    for r in range(ROWS):
        for band in range(BANDS):
            least = np.minimum.reduceat(mixed(marks * _A[band * ROWS + r]), cut)[::2]
            out[:, band] = mixed(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + least)
    return one.view(np.int64), two.view(np.int64), out.view(np.int64)


def first_least(rank: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value of every ``width`` in a row, by doubling."""
    at, n = np.arange(len(rank)), 1
    while 2 * n <= width:
        left, right = at[:-n], at[n:]
        at, n = np.where(rank[left] <= rank[right], left, right), 2 * n
    if n < width:
        left, right = at[:len(at) - (width - n)], at[width - n:]
        at = np.where(rank[left] <= rank[right], left, right)
    return at


def blocks(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, and two hashes of the words of every chosen block of many texts."""
    texts_at = [k for k, w in enumerate(texts) if len(w) >= WORDS]
    gap = np.zeros(WORDS + 2, np.uint64)
    if not texts_at:
        return (np.empty(0, np.int64),) * 4
    words = np.concatenate([part for k in texts_at for part in (texts[k], gap)])
    sizes = np.array([len(texts[k]) for k in texts_at])
    starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
    rank = mixed(mixed(words[:-2] + np.uint64(5)) + words[1:-1] * np.uint64(3) + words[2:] * np.uint64(7))
    held = np.zeros(len(rank) + 1, np.int64)
    np.add.at(held, starts, 1)
    np.add.at(held, starts + sizes - WORDS + 1, -1)
    rank[np.cumsum(held[:-1]) == 0] = np.uint64(0xFFFFFFFFFFFFFFFF)  # no block of the text begins here
    least = first_least(rank, WORDS + 1)
    # Windows of places: one for a text with few places, else all that lie in the text.
    many = np.maximum(sizes - WORDS + 1 - WORDS, 1)
    window = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
    at = np.unique(least[window])
    owner = np.searchsorted(starts, at, "right") - 1
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        one, two = mixed(one + words[at + k] + np.uint64(k)), mixed(two * np.uint64(31) + words[at + k] + np.uint64(99))
    return np.array(texts_at)[owner], at - starts[owner], one.view(np.int64), two.view(np.int64)


def paragraphs(distinct: DataFrame) -> DataFrame:
    """(id, start, end, one, two, bands, line) of every paragraph: places in words, bands and text of lines only; stored."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "start", "end", "one", "two")]
                          + [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("line", T.StringType())])

    def found_in(part, vocabulary):
        texts, places, lines = [], [], []
        done = 0
        for i, text in part:
            words, ends = vocabulary.with_lines(text)
            edges, split = np.r_[0, ends, len(words)], text.split("\n")
            for k in np.flatnonzero(np.diff(edges) >= WORDS).tolist():
                places.append((done + edges[k], done + edges[k + 1]))
                lines.append((i, int(edges[k]), int(edges[k + 1]), split[k]))
            texts.append(words)
            done += len(words)
        if places:
            starts, ends = np.array(places).T
            one, two, marks = hashed_lines(np.concatenate(texts), starts, ends)
            for (i, start, end, line), a, b, m in zip(lines, one.tolist(), two.tolist(), marks.tolist(), strict=True):
                yield i, start, end, a, b, m, line
        for k, at, a, b in zip(*(c.tolist() for c in blocks(texts)), strict=True):
            yield part[k][0], at, at + WORDS, a, b, None, None

    def rows(batch):
        vocabulary, part, size = Words(), [], 0
        for i, text in batch:
            part.append((i, text))
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from found_in(part, vocabulary)
                part, size = [], 0
        if part:
            yield from found_in(part, vocabulary)

    return stored(over_batches(distinct, ["id", "text"], schema, rows), "paragraphs")


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) pairs whose sets of shingles have a Jaccard similarity of SIMILARITY or more; stored."""
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batch):
        vocabulary = Words()
        for a, b, text_a, text_b in batch:
            x, y = (np.unique(shingles(vocabulary.of(t))) for t in (text_a, text_b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9:
                yield a, b

    return stored(over_batches(both, ["a", "b", "text_a", "text_b"], schema, run), "paragraph-links")


def line_classes(found: DataFrame) -> DataFrame:
    """(one, class) of every line that has a similar one; stored. The first hash of a line is its id here; only the texts
    of lines that meet another in a band are looked up."""
    lines = found.where("bands is not null").select(F.col("one").alias("id"), "bands", F.col("line").alias("text"))
    placed = lines.select("id", F.explode("bands").alias("band"))
    shared = stored(placed.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("band", "first"), "paragraph-bands")
    members = stored(placed.join(broadcast_if_small(shared), "band").distinct(), "paragraph-members")
    star = stored(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "paragraph-star")
    wanted = stored(members.select("id").distinct(), "paragraph-wanted")
    texts = stored(lines.select("id", "text").join(broadcast_if_small(wanted), "id").dropDuplicates(["id"]), "paragraph-texts")
    links = alike(star, texts)
    roots = components(links).withColumnRenamed("node", "id")
    classed = stored(members.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("class")), "paragraph-classed")
    several = classed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("band")
    loose = stored(classed.join(several, "band", "left_semi").select("id", "class").distinct(), "paragraph-loose")
    more = prefix_links(texts.join(loose.select("id"), "id", "left_semi"), loose, lambda pairs: alike(pairs, texts), repeats=False)
    return stored(components(links.union(more)).select(F.col("node").alias("one"), F.col("root").alias("class")), "paragraph-classes")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document that repeats paragraphs of documents with smaller ids: key, n_words (removed), spans (ranges of words)
    and copied_from (the smallest id of each class it repeats)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}_]"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    firsts = stored(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")), "paragraph-documents")
    distinct = rows.join(broadcast_if_small(firsts.select("digest", "first")), "digest").where("id = first").select("id", "text")
    found = paragraphs(distinct)
    classes = line_classes(found)
    # Equal blocks and equal lines are classes by their hashes; lines that are similar share the class of their component.
    marked = found.select("id", "start", "end", F.col("bands").isNotNull().alias("is_line"), "one", "two")
    equal = stored(marked.groupBy("is_line", "one", "two").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
                   .drop("last"), "paragraph-equal")
    joined = marked.where("is_line").join(broadcast_if_small(classes), "one").groupBy("one", "two", "class").agg(F.min("id").alias("least"))
    similar_ = joined.join(joined.groupBy("class").agg(F.min("least").alias("first")), "class").select(F.lit(True).alias("is_line"), "one", "two", "first")
    known = stored(equal.union(similar_.select(*equal.columns)).groupBy("is_line", "one", "two").agg(F.min("first").alias("first")), "paragraph-known")
    lost = marked.join(broadcast_if_small(known), ["is_line", "one", "two"]).where("id > first")
    merged = """aggregate(found, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).end >= x.start,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
           concat(a, array(named_struct('start', x.start, 'end', x.end)))))"""
    partly = (lost.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"), F.sort_array(F.collect_set("first")).alias("copied_from"))
              .select("id", F.expr(merged).alias("spans"), "copied_from"))
    copies = (rows.join(broadcast_if_small(firsts.where("first < last").select("digest", "first")), "digest").where("id > first")
              .select("id", F.size(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda w: w != "")).cast("long").alias("n"), "first").distinct()
              .select("id", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))).alias("spans"), F.array("first").alias("copied_from")))
    return partly.union(copies).select(F.col("id").alias(key), F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)").alias("n_words"), "spans", "copied_from")
