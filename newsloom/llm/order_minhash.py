"""Near-duplicate classes by Order MinHash.

Texts are made distinct first. The five-word shingles of a text are labelled with their occurrence number, so that all
are different. Under each of ``SKETCHES`` hash functions the ``KEPT`` smallest labelled shingles are taken and put in
text order; the hash of that sequence is one sketch. Two texts share a sketch with a probability that falls with the
edits and with changes of order between them: in long texts of a shingle similarity of 0.8 a sketch is shared with 0.8^8 =
0.17 and none of 40 with 0.06 %, while at 0.3 one of 40 is shared with 0.3 %. Short texts share fewer (16 common of 20 shingles: none
with 1.3 %, and texts of at most ``KEPT`` shingles only if these are equal), so texts under ``SHORT`` shingles, and all that can be
similar to one, are searched exactly, without sketches (below).

Texts that share a sketch are candidates. A banded alignment of their shingle sequences (bit-parallel longest common
subsequence inside the band that the threshold leaves) verifies them: common shingles in order over all shingles must be
``SIMILARITY`` or more. Verified links are joined to classes by connected components.

Large buckets: each bucket first compares its members with its first text only (a star). Buckets that then still hold several
classes are searched in full, between different classes only: their texts are joined on their rarest shingles (prefix
filtering, which misses no similar pair), together with all short texts, and the pairs are verified. Shingles at which many classes
still meet are compared with few central texts before, which makes one class of most families. A link inside a class would not change the result, so no
link that counts is lost, without caps, and a passage that many texts share does not pair them.

Defined cases: null and wordless texts are no copies of anything and are their own class (their row's key); texts under
five words have one shingle, all their words; equal texts are always one class; repeated keys keep the class of each
row; the class is named by its smallest key; a null key is kept and never names a class with other members.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import broadcast_if_small, free_name, over_batches, stored
from newsloom.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, KEPT = 40, 8
#: Shingles from which sketches are relied on.
SHORT = 60
#: Texts up to which a shingle is not counted as common, and shingles hashed at once.
RARE, CHUNK = 8, 50_000
#: Texts outside the largest class of a mark from which they are compared with single texts first.
CROWD = 32
#: Word hashes that a worker remembers.
KNOWN_WORDS = 100_000
_WORD, _WORD_OR_END = re.compile(r"\w+"), re.compile(r"\w+|\n")
_M = np.uint64(0xFF51AFD7ED558CCD)
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M
    return x ^ (x >> np.uint64(29))


class Words:
    """Word hashes, remembered for a batch."""

    def __init__(self):
        self.known = _Hashes()

    def of(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        return self.hashed(words)

    def hashed(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if len(self.known) > KNOWN_WORDS:
            self.known = _Hashes()
        return out

    def with_lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The words of a text, and how many there are before each of its line ends."""
        words = _WORD_OR_END.findall(text.lower())
        ends = [k for k, w in enumerate(words) if w == "\n"] if "\n" in text else []
        hashes = self.hashed(words)
        return np.delete(hashes, ends), np.array(ends, np.int64) - np.arange(len(ends))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return out


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash for every run of five words; for fewer words one for all of them."""
    n = len(words)
    size = min(SHINGLE, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mixed(out + words[k:n - size + 1 + k] + np.uint64(k + 1))
    return out


def labelled(found: np.ndarray) -> np.ndarray:
    """The same hashes made different by their occurrence number."""
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    number = np.arange(len(found)) - np.repeat(start, np.diff(np.r_[start, len(found)]))
    out = np.empty_like(found)
    out[order] = mixed(ranked + number.astype(np.uint64) * _M)
    return out


def sketches(found: np.ndarray) -> list[int]:
    """The hash of the text-ordered smallest labelled shingles under each hash function."""
    marks = labelled(found)
    best_v = np.empty((0, SKETCHES), np.uint64)
    best_at = np.empty((0, SKETCHES), np.int64)
    for low in range(0, len(marks), CHUNK):
        values = mixed(marks[low:low + CHUNK, None] * _A + _B)
        at = np.broadcast_to(np.arange(low, low + len(values))[:, None], values.shape)
        values, at = np.concatenate([best_v, values]), np.concatenate([best_at, at])
        if len(values) > KEPT:
            keep = np.argpartition(values, KEPT - 1, axis=0)[:KEPT]
            values, at = np.take_along_axis(values, keep, 0), np.take_along_axis(at, keep, 0)
        best_v, best_at = values, at
    at = np.sort(best_at, axis=0)
    out = np.arange(SKETCHES, dtype=np.uint64)
    for row in marks[at]:
        out = mixed(out * _M + row)
    return out.view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the common shingles in order are ``least`` or more of all shingles, by a banded alignment.

    With c common of n and m, c / (n + m - c) >= s means c >= s (n + m) / (1 + s); so at most n - c shingles of one and m - c of
    the other stay unmatched, which bounds the diagonals. The band of a row is one whole number; a step is the
    bit-parallel recurrence of the longest common subsequence, in which a zero bit is a matched place of ``a``.
    """
    n, m = len(a), len(b)
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if need > min(n, m):
        return False
    if n == m and (a == b).all():
        return True
    if len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need:
        return False  # not enough common shingles in any order
    above, below = n - need, m - need
    width = above + below + 1
    band, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[int, list[int]] = {}
    for i, v in enumerate(a.tolist()):
        places.setdefault(v, []).append(i)
    often = {v: _bits(at) for v, at in places.items() if len(at) > 256}
    state, matched, low = band, 0, -below
    for v in b.tolist():
        if v in often:
            hit = (often[v] >> low if low >= 0 else often[v] << -low) & band
        else:
            hit = 0
            for i in places.get(v, ()):
                if 0 <= i - low < width:
                    hit |= 1 << (i - low)
        hit &= state
        if hit:
            state = ((state + hit) | (state - hit)) & band
        matched += ~state & 1  # the leftmost place leaves the band
        state = state >> 1 | top
        low += 1
    return matched + width - state.bit_count() >= need


def _bits(at: list[int]) -> int:
    raw = bytearray(at[-1] // 8 + 1)
    for i in at:
        raw[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(raw, "little")


def _digest(text: Column) -> Column:
    """128 bits of a text; null for texts without words."""
    return F.when(text.rlike(r"[\p{L}\p{N}_]"), F.unhex(F.md5(text)))


def sketched(docs: DataFrame, key: str, text: str, row: Column | None = None) -> DataFrame:
    """key, row number, digest, sketches and size in shingles (null for wordless texts) of every row; stored."""
    rows = docs.select(F.col(key).alias("key"), (F.monotonically_increasing_id() if row is None else row).alias("row"), _digest(F.col(text)).alias("digest"),
                       F.col(text).alias("text"))
    schema = T.StructType([rows.schema["key"], rows.schema["row"], rows.schema["digest"], T.StructField("sketches", T.ArrayType(T.LongType())),
                           T.StructField("size", T.LongType())])

    def run(batch):
        words, last = Words(), {}
        for k, row, digest, t in batch:
            if digest is not None and digest not in last:
                found = words.of(t)
                cut = shingles(found) if len(found) else found
                last[digest] = (sketches(cut), len(cut)) if len(found) else None
            made = last.get(digest)
            yield k, row, digest if made else None, *(made or (None, None))

    return stored(over_batches(rows, ["key", "row", "digest", "text"], schema, run), "near-sketches")


def texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of the wanted (id, key, digest) rows; stored. Only their texts are moved."""
    rows = docs.select(F.col(key).alias("its_key"), _digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    found = rows.join(broadcast_if_small(wanted), "digest").where(F.col("key").eqNullSafe(F.col("its_key")))
    return stored(found.select("id", "text").dropDuplicates(["id"]), "near-texts")


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The (a, b) pairs of ids whose texts are similar; a text that stands in many pairs of a batch is cut once."""
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batch):
        words, cut = Words(), {}
        for a, b, text_a, text_b in batch:
            if len(cut) > 200:
                cut = {}
            for i, t in ((a, text_a), (b, text_b)):
                if i not in cut:
                    cut[i] = shingles(words.of(t))
            if similar(cut[a], cut[b], least):
                yield a, b

    return stored(over_batches(both, ["a", "b", "text_a", "text_b"], schema, run), "near-links")


def prefixes(texts: DataFrame, classes: DataFrame, least: float = SIMILARITY, repeats: bool = True) -> DataFrame:
    """(id, n, mark, place, class): the rarest shingles of every text, of which similar texts share one; stored.

    Shingles count with their repeats, or as a set without ``repeats``. Of n shingles similar texts share ``least`` n or more, so they share one of the n - ceil(least n) + 1 first in any
    common order. The order puts shingles that few of these texts have first, so a passage that many texts share joins
    nothing unless nearly all of a text is such passages."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("marks", T.ArrayType(T.LongType()))])

    def run(batch):
        words = Words()
        for i, t in batch:
            found = shingles(words.of(t))
            yield i, (labelled(found) if repeats else np.unique(found)).view(np.int64).tolist()

    marks = stored(over_batches(texts, ["id", "text"], schema, run), "near-marks")
    each = marks.select("id", F.size("marks").alias("n"), F.explode("marks").alias("mark"))
    common = stored(each.groupBy("mark").agg(F.count("*").alias("df")).where(F.col("df") > RARE), "near-common")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "mark"))
    first = (each.join(broadcast_if_small(common), "mark", "left").withColumn("place", place)
             .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
             .select("id", "n", "mark", "place").join(classes, "id"))
    return stored(first, "near-prefixes")


def meeting(asking: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """The (a, b) pairs of rows of different classes that share a mark at places where similar texts can.

    For two given sizes more must be common, and the prefixes that have to meet are shorter: a row at a place meets sizes in a
    range only. Sizes are dealt into bands, so that rows of one mark that can not meet are not paired to be refused; ``asked`` has
    the band of its size, ``asking`` looks into the bands of its range."""
    lowest = F.ceil(F.col("n") * least - 1e-6)
    highest = F.floor((F.col("n") - F.col("place") + 1) * ((1 + least) / least) + 1e-6) - F.col("n")
    seeking = asking.where(highest >= lowest).withColumn("band", F.explode(F.sequence(band(lowest), band(highest))))
    side = lambda df, i: df.select("mark", "band", *[F.col(c).alias(f"{c}_{i}") for c in ("id", "n", "place", "class")])
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    near = (F.col("class_a") != F.col("class_b")) & (F.col("place_a") <= F.col("n_a") - need + 1) & (F.col("place_b") <= F.col("n_b") - need + 1)
    return side(seeking, "a").join(side(asked, "b"), ["mark", "band"]).where(near).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def band(size: Column) -> Column:
    """The number of the band of a size; bands grow by a tenth."""
    return F.floor(F.log(size.cast("double")) / float(np.log(1.1)))


def prefix_links(texts: DataFrame, classes: DataFrame, verify: Callable[[DataFrame], DataFrame], least: float = SIMILARITY,
                 repeats: bool = True) -> DataFrame:
    """Links (a, b) that join all classes between which there is a similar pair. ``verify`` keeps the similar ones of (a, b) pairs.

    Of two texts of different classes one at least is outside the largest class of a mark: those texts look for
    partners, the largest class is only looked at. So a family that is one class already makes no pairs. Where many texts of a mark are outside
    it, they and all others are first compared with one text of every band, the one that has the mark earliest: it has the
    fewest rare shingles, so it is the most like the rest of its family. Classes that meet there are joined, and further rounds take a text of a
    class that has not been compared, while they bring down what is outside by a quarter. Then every pair that is left is verified."""
    first, links, hubs, before = prefixes(texts, classes, least, repeats), None, None, None
    while True:
        rows = first.groupBy("mark", "class").agg(F.count("*").alias("rows"))
        mixed_ = stored(rows.groupBy("mark").agg(F.max_by("class", F.struct("rows", "class")).alias("largest"), (F.sum("rows") - F.max("rows")).alias("outside"))
                        .where("outside > 0"), "near-mixed")
        crowded = mixed_.where(F.col("outside") > CROWD)
        outside = crowded.agg(F.sum("outside")).first()[0] or 0
        if not outside or before is not None and outside > 0.75 * before:
            break
        before = outside
        crowd = first.join(broadcast_if_small(crowded.select("mark")), "mark").withColumn("band", band(F.col("n")))
        fresh = crowd if hubs is None else crowd.join(broadcast_if_small(stored(hubs.join(classes, "id").select("mark", "band", "class"), "near-compared")),
                                                      ["mark", "band", "class"], "left_anti")
        central = stored(fresh.groupBy("mark", "band").agg(F.min(F.struct((F.col("place") / F.col("n")).alias("depth"), "id", "n", "place", "class")).alias("hub"))
                         .select("mark", "band", "hub.*"), "near-hubs")
        found = verify(stored(meeting(crowd.drop("band"), broadcast_if_small(central), least), "near-hub-pairs"))
        links = found if links is None else links.union(found)
        hubs = central.select("mark", "band", "id") if hubs is None else hubs.union(central.select("mark", "band", "id"))
        of = lambda i: classes.select(F.col("id").alias(i), F.col("class").alias(f"class_{i}"))
        joined = broadcast_if_small(components(found.join(of("a"), "a").join(of("b"), "b"), "class_a", "class_b").withColumnRenamed("node", "class"))
        first, classes = (df.join(joined, "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root") for df in (first, classes))
    met = first.join(broadcast_if_small(mixed_), "mark")
    rest = verify(stored(meeting(met.where("class <> largest"), met.withColumn("band", band(F.col("n"))), least), "near-pairs"))
    return rest if links is None else links.union(rest)


def classes_of_rows(docs: DataFrame, key: str, text: str, least: float, row: Column | None = None) -> DataFrame:
    """key, row, digest, class_id (the smallest key of the class) and is_kept (one row of the class with that key) of every row."""
    found = sketched(docs, key, text, row)
    nodes = stored(found.where("digest is not null").groupBy("digest").agg(F.min(F.struct("row", "key")).alias("first"), F.first("sketches").alias("sketches"), F.first("size").alias("size"))
                   .select("digest", F.col("first.row").alias("id"), F.col("first.key").alias("key"), "sketches", "size"), "near-nodes")
    placed = nodes.select("id", F.explode(F.array_distinct("sketches")).alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", "first")
    members = stored(placed.join(broadcast_if_small(stored(shared, "near-buckets")), "bucket"), "near-members")
    star = stored(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "near-star")
    # A text under SHORT shingles is similar only to texts under SHORT / least.
    short = stored(nodes.where(F.col("size") * least < SHORT).select("id"), "near-short")
    wanted = nodes.join(star.select(F.col("a").alias("id")).union(star.select("b")).union(short).distinct(), "id").select("id", "key", "digest")
    texts = texts_of(docs, stored(wanted, "near-wanted"), key, text)
    links = verified(star, texts, least)
    roots = components(links).withColumnRenamed("node", "id")
    classed = stored(members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("class")), "near-classed")
    mixed_ = classed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("bucket")
    single = short.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("class"))
    loose = stored(classed.join(mixed_, "bucket", "left_semi").select("id", "class").union(single).distinct(), "near-loose")
    links = links.union(prefix_links(texts.join(loose.select("id"), "id", "left_semi"), loose, lambda pairs: verified(pairs, texts, least), least))
    roots = components(links).withColumnRenamed("node", "id").withColumnRenamed("root", "class")
    grouped = stored(nodes.join(roots, "id", "left").select("digest", F.coalesce("class", "id").alias("class")), "near-roots")
    rows = found.join(grouped, "digest", "left").select("key", "row", "digest", F.coalesce("class", "row").alias("class"))
    names = rows.groupBy("class").agg(F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "row")).alias("first"))
    return rows.join(names, "class").select("key", "row", "digest", F.col("first.key").alias("class_id"), (F.col("row") == F.col("first.row")).alias("is_kept"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """key, class_id (the smallest key of the class) and is_kept (true for one row of each class) for every row."""
    return classes_of_rows(docs, key, text, least).select(F.col("key").alias(key), "class_id", "is_kept")


def first_of_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of every class, unchanged: the one that gives the class its name. Rows are known by a stored number, so of rows
    with the same key and text, or with null keys, one stays as well."""
    number = free_name(docs, "row_number")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "near-rows")
    gone = stored(classes_of_rows(numbered, key, text, least, F.col(number)).where("not is_kept").select(F.col("row").alias(number)), "near-gone")
    return numbered.join(broadcast_if_small(gone), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
