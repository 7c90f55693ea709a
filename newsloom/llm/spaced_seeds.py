"""Benchmark decontamination by spaced seeds: native columns only.

A seed is a fixed mask over ``SPAN`` word positions; positions where it is 0 are ignored, so a changed word there does not
hide the match. Each of ``MASKS`` is applied to every place of a benchmark item and of a text, so any unchanged passage of SPAN
words is hit wherever it stands. All masks take the words at ``ALWAYS``; places of a text are first joined on these alone
(one narrow row a place), and the masks are hashed only where they meet an item, which loses no equal seed.
Equal hashes give (text, item, diagonal) hits. Around each hit the item is laid on the text along its diagonal,
and the best stretch is found: +1 for an equal word, -``PENALTY`` for another, so substitutions are tolerated. A hit is an
overlap if its stretch has ``MIN_WORDS`` words or more (or the whole item, if that is shorter) and ``MIN_SAME`` of them are equal.

Items shorter than a span are hashed whole at every place of their own length, so a changed word hides them; of longer
passages with one changed word only 12-word items changed at the fifth word are missed, of 20 words with two changed 4 %.
Hashes of the benchmark are broadcast while they
are at most ``SEED_ROWS`` rows, else joined by shuffle; hits are made distinct per text, item and diagonal before any text is
joined to them, and only texts with hits are moved.

Defined cases: null and wordless texts and items have no overlaps; items of fewer than ``MIN_ITEM`` words are too short to
prove a leak and are not searched; repeated items and rows are each reported; a null key is kept as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import broadcast_if_small, free_name, stored

SPAN = 12
#: Nine or more of twelve positions count; the ends always do.
MASKS = ["110111011011", "111011101101", "101110110111"]
ALWAYS = [i for i in range(SPAN) if all(mask[i] == "1" for mask in MASKS)]
MIN_ITEM, MIN_WORDS, MIN_SAME, PENALTY = 8, 13, 0.8, 3
SEED_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def windows(column: str) -> Column:
    """(place, key, run) at every place: a hash of the words at ``ALWAYS``, and the hashes of the span's words; ``column`` has hashes."""
    always = ", ".join(f"{column}[p + {i}]" for i in ALWAYS)
    return F.when(F.size(column) >= SPAN, F.expr(
        f"transform(sequence(0, size({column}) - {SPAN}), p -> named_struct('place', p, 'key', xxhash64({always}), 'run', slice({column}, p + 1, {SPAN})))"))


def seeds(run: str) -> Column:
    """The hash of a span's words under every mask."""
    return F.array(*[F.xxhash64(F.lit(number), *[F.col(run)[i] for i, c in enumerate(mask) if c == "1"]) for number, mask in enumerate(MASKS)])


def whole(column: str, length: int) -> str:
    """SQL for (place, hash) of every run of ``length`` words."""
    return (f"if(size({column}) >= {length}, transform(sequence(0, size({column}) - {length}), p -> named_struct('place', p, 'seed', "
            f"xxhash64({length} + 100, slice({column}, p + 1, {length})))), null)")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (row, item, diagonal) of equal seeds; ``docs`` has row and words, ``items`` has item and words."""
    hashed = lambda df, name: df.select(name, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    spans = lambda df, name: hashed(df, name).select(name, F.inline(windows("hashes")))
    masked = lambda df, name: df.select(name, "place", F.explode(seeds("run")).alias("seed"))
    held = stored(spans(items, "item"), "leak-spans")
    keys = stored(held.select("key").distinct(), "leak-keys")
    long_ = masked(held, "item").withColumnRenamed("place", "at")
    lengths = [r[0] for r in items.where((F.size("words") >= MIN_ITEM) & (F.size("words") < SPAN)).select(F.size("words")).distinct().orderBy(F.size("words")).collect()]
    short = [items.where(F.size("words") == n).select("item", F.lit(0).alias("at"), F.expr(f"xxhash64({n} + 100, words)").alias("seed")) for n in lengths]
    for df in short:
        long_ = long_.union(df)
    known = stored(long_, "leak-seeds")
    distinct = stored(known.select("seed").distinct(), "leak-seed-set")
    small = distinct.count() <= SEED_ROWS
    said = masked(spans(docs, "row").join(F.broadcast(keys) if keys.count() <= SEED_ROWS else keys, "key"), "row")
    for n in lengths:
        said = said.union(docs.select("row", F.inline(F.expr(whole("words", n)))))
    met = stored(said.join(F.broadcast(distinct) if small else distinct, "seed"), "leak-hits")
    return met.join(known, "seed").select("row", "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct()


def best_stretch(found: DataFrame) -> DataFrame:
    """Adds first, last (places in the item) and same of the best-scoring stretch on the diagonal."""
    score = f"""aggregate(sequence(0, size(item_words) - 1),
      named_struct('run', 0, 'from', 0, 'hit', 0, 'best', 0, 'first', 0, 'last', -1, 'same', 0),
      (a, j) -> transform(array(
          if(coalesce(get(doc_words, j + diagonal), '') = item_words[j], 1, 0)), e ->
          transform(array(named_struct('run', if(a.run + if(e = 1, 1, -{PENALTY}) <= 0, 0, a.run + if(e = 1, 1, -{PENALTY})),
                 'from', if(a.run + if(e = 1, 1, -{PENALTY}) <= 0, j + 1, a.from),
                 'hit', if(a.run + if(e = 1, 1, -{PENALTY}) <= 0, 0, a.hit + e))), r ->
          named_struct('run', r.run, 'from', r.from, 'hit', r.hit,
                       'best', greatest(a.best, r.run), 'first', if(r.run > a.best, r.from, a.first),
                       'last', if(r.run > a.best, j, a.last), 'same', if(r.run > a.best, r.hit, a.same)))[0])[0])"""
    return found.withColumn("stretch", F.expr(score)).select("*", "stretch.first", "stretch.last", "stretch.same").drop("stretch")


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
             item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item and the best overlap (doc_start, item_start, n_words, n_same: in words) of every text with every item it holds."""
    items = stored(benchmark.select(F.col(item_key).alias("item"), words(F.col(item_text)).alias("words")).where(F.size("words") >= MIN_ITEM)
                   .withColumn("item_row", F.monotonically_increasing_id()), "leak-items")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), words(F.col(text)).alias("words"))
    split = rows.select(F.xxhash64("key", "text").alias("row"), "words")
    found = stored(hits(split, items.select(F.col("item_row").alias("item"), "words")), "leak-diagonals")
    # Texts meet their hits again by the hash of key and text; a chance hit of another row fails the alignment.
    wanted = stored(found.select("row").distinct(), "leak-rows")
    small = wanted.count() <= SEED_ROWS
    held = rows.withColumn("row", F.xxhash64("key", "text")).join(F.broadcast(wanted) if small else wanted, "row").drop("text")
    held = stored(held.withColumn("doc_row", F.monotonically_increasing_id()), "leak-texts")
    laid = (held.withColumnRenamed("words", "doc_words").join(found.withColumnRenamed("item", "item_row"), "row")
            .join(items.withColumnRenamed("words", "item_words"), "item_row"))
    n = F.col("last") - F.col("first") + 1
    good = (best_stretch(laid).where((n >= F.least(F.lit(MIN_WORDS), F.size("item_words"))) & (F.col("same") >= n * F.lit(MIN_SAME)))
            .select("doc_row", "key", "item_row", "item", n.alias("n_words"), F.col("same").alias("n_same"), F.col("first").alias("item_start"),
                    (F.col("first") + F.col("diagonal")).alias("doc_start")))
    best = good.groupBy("doc_row", "item_row").agg(F.max_by(F.struct("key", "item", "doc_start", "item_start", "n_words", "n_same"),
                                                           F.struct("n_same", "n_words", -F.col("doc_start"))).alias("b"))
    return best.select(F.col("b.key").alias(key), F.col("b.item").alias(item_key), "b.doc_start", "b.item_start", "b.n_words", "b.n_same")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without an overlap, unchanged. Rows are known by a stored number: each is judged by its own text, whatever
    its key is, how often that stands, or whether it is null."""
    number = free_name(docs, "row_number")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "leak-numbered")
    leaked = stored(overlaps(rows, benchmark, number, text, item_key, item_text).select(number).distinct(), "leak-leaked")
    return rows.join(broadcast_if_small(leaked), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
