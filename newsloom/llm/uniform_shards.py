"""Sharding by a hypergeometric communication matrix: native columns only.

A uniform shuffle with exact shard sizes, without sorting everything. Rows are dealt to logical partitions by
the hash of a stored row number; how many rows each partition sends to each shard is drawn from the multivariate
hypergeometric law, which is what a uniform permutation would give; rows are permuted in their partition and cut
by these counts; after the exchange they are permuted again in their shard, in sub-ranges of a random key with
prefix sums for the offsets, so that no task holds a whole shard.

The driver sees row counts per partition only, sqrt(rows) / 2 of them. Row numbers, not keys, are hashed: a key or text
in a third of the rows is spread like any other. The same files read the same way give the same shuffle.

Defined cases: null texts have size 8 and checksum 0; repeated rows are rows of their own; with fewer rows than
shards some shards are empty; an empty table gives no rows; other columns are carried only if named.
"""

from __future__ import annotations

import random
from math import ceil, exp, lgamma, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import broadcast_if_small, stored

HEADER_BYTES = 8


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items are good: inversion from the mode outwards, for counts of any size."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)
    up = down = mode
    p_up = p_down = exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u = rng.random() - p_up
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            if (u := u - p_up) <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            if (u := u - p_down) <= 0:
                return down
    return mode


def matrix(counts: dict[int, int], shards: int, seed: int) -> list[tuple[int, list[int]]]:
    """For every partition, where the rows of each shard end among its permuted rows."""
    total, rng = sum(counts.values()), random.Random(seed)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for part in sorted(counts):
        left, rest, ends, end = counts[part], sum(room), [], 0
        for s in range(shards):
            rest -= room[s]
            sent = hypergeometric(rng, room[s], rest, left)
            room[s] -= sent
            left -= sent
            end += sent
            ends.append(end)
        out.append((part, ends))
    return out


def _random(seed: int, salt: int) -> Column:
    return F.xxhash64(F.col("row"), F.lit(seed), F.lit(salt))


def shuffle(df: DataFrame, columns: list[str], shards: int = 24, seed: int = 7) -> DataFrame:
    """``columns`` of every row with ``shard`` (0 ..) and ``slot`` (its place in the shard, gapless from 0)."""
    spark = df.sparkSession
    rows = stored(df.select(*columns).withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    n = rows.count()
    parts = max(1, ceil(sqrt(n) / 2))
    dealt = rows.withColumn("part", F.pmod(_random(seed, 1), F.lit(parts)))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    ends = spark.createDataFrame(matrix(counts, shards, seed), T.StructType([
        T.StructField("part", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]))
    place = F.row_number().over(Window.partitionBy("part").orderBy(_random(seed, 2), "row"))
    # The table of ends has one row per partition, sqrt(rows) / 2 in all.
    sent = (dealt.withColumn("place", place).join(F.broadcast(ends) if parts <= 100_000 else ends, "part")
            .withColumn("shard", F.expr("cast(size(filter(ends, e -> e < place)) as int)"))
            .withColumn("range", F.pmod(_random(seed, 3), F.lit(max(1, parts // 8))))
            .drop("part", "ends", "place"))
    sent = stored(sent, "shard-sent")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sent.groupBy("shard", "range").count()
              .withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy(_random(seed, 4), "row"))
    return (sent.withColumn("within", within).join(broadcast_if_small(stored(starts, "shard-starts")), ["shard", "range"])
            .select(*columns, "shard", (F.col("start") + F.col("within") - 1).cast("long").alias("slot")))


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, seed: int = 7) -> DataFrame:
    """The result of query op7: size, checksum and place of every document, under the law of equal row counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias(key), (F.octet_length(body) + F.lit(HEADER_BYTES)).cast("long").alias("size"),
                         F.crc32(body.cast("binary")).cast("long").alias("text_crc32"))
    return shuffle(narrow, [key, "size", "text_crc32"], shards, seed).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
