"""Coverage planning: archive slots, query days, gaps, progress and slice states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.times import SLOT_MINUTES, WINDOW_MINUTES, CYCLE_MINUTES, slot_start

# --- fixed values ----------------------------------------------------------------------------
MAX_SLICE_ATTEMPTS = 40
DOC_LOOKBACK_DAYS = 85
MAX_RECORDS, MIN_SPLIT_MINUTES = 250, 30
ARCHIVE, ANSWERS = "gdelt-gkg", "gdelt-doc"
# ---------------------------------------------------------------------------------------------


def gkg_slots(ranges: DataFrame) -> DataFrame:
    """15-minute slots covering ``[range_start, range_end)`` of each row, aligned downwards."""
    start, last = slot_start(F.col("range_start")), F.col("range_end") - F.expr("INTERVAL 1 MICROSECOND")
    slots = F.sequence(start, slot_start(last), F.expr(f"INTERVAL {SLOT_MINUTES} MINUTES"))
    keep = [c for c in ranges.columns if c not in ("range_start", "range_end")]
    return ranges.filter("range_start < range_end").select(
        *keep, F.explode(slots).alias("slice_start")
    ).withColumn("slice_end", F.col("slice_start") + F.expr(f"INTERVAL {SLOT_MINUTES} MINUTES"))


def backfill_plan(ranges: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    """Expected slices of each backfill ``(id, niche_id, range_start, range_end, strategy)``.

    Archive slots cover the whole range (strategies auto and gkg); one slice per query and day
    covers what the search interface still answers (auto: the last 85 days; doc: everything).
    """
    r = ranges.withColumn("range_end", F.least("range_end", now)).filter("range_start < range_end")
    archive = gkg_slots(
        r.filter("strategy <> 'doc'").select(F.col("id").alias("backfill_id"), "range_start", "range_end")
    ).select("backfill_id", F.lit(ARCHIVE).alias("provider"), F.lit(None).cast("int").alias("query_id"), "slice_start", "slice_end")
    limit = now - F.expr(f"INTERVAL {DOC_LOOKBACK_DAYS} DAYS")
    doc_from = F.when(F.col("strategy") == "doc", F.col("range_start")).otherwise(F.greatest("range_start", limit))
    days = (
        r.filter("strategy <> 'gkg'").withColumn("doc_from", doc_from).filter("doc_from < range_end")
        .select(
            F.col("id").alias("backfill_id"), "niche_id", "range_end",
            F.explode(
                F.sequence("doc_from", F.col("range_end") - F.expr("INTERVAL 1 MICROSECOND"), F.expr("INTERVAL 1 DAY"))
            ).alias("slice_start"),
        )
        .withColumn("slice_end", F.least(F.col("slice_start") + F.expr("INTERVAL 1 DAY"), F.col("range_end")))
    )
    enabled = queries.filter("enabled").select(F.col("id").alias("query_id"), "niche_id")
    answers = days.join(enabled, "niche_id").select("backfill_id", F.lit(ANSWERS).alias("provider"), "query_id", "slice_start", "slice_end")
    return archive.unionByName(answers)


def slot_gaps(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """Planned slices without a landed counterpart (same provider, query and start)."""
    key = ["provider", "query_key", "slice_start"]
    p = plan.withColumn("query_key", F.coalesce("query_id", F.lit(0)))
    done = landed.withColumn("query_key", F.coalesce("query_id", F.lit(0))).select(*key)
    return p.join(done, key, "left_anti").drop("query_key")


def resumable(slices: DataFrame, backfills: DataFrame) -> DataFrame:
    """Backfills with failed slices that may still be attempted."""
    live = backfills.filter(F.col("status").isin("running", "failed")).select(F.col("id").alias("backfill_id"))
    failed = slices.filter((F.col("status") == "failed") & (F.col("attempts") < MAX_SLICE_ATTEMPTS))
    return failed.select("backfill_id").distinct().join(live, "backfill_id", "left_semi")


def backfill_progress(backfills: DataFrame, slices: DataFrame) -> DataFrame:
    s = F.col("status")
    per = slices.groupBy(F.col("backfill_id").alias("id")).agg(
        F.count_if(s == "done").alias("done"), F.count_if(s == "skipped").alias("skipped"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("pending", "running")).alias("remaining"),
        F.sum("matched").alias("matched"),
    )
    zero = F.lit(0).cast("long")
    return backfills.join(per, "id", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("done", "skipped", "failed", "remaining", "matched")}
    )


def slice_rollup(backfills: DataFrame, slices: DataFrame) -> DataFrame:
    """A running backfill ends once nothing is pending: failed if any slice failed."""
    per = slices.groupBy(F.col("backfill_id").alias("id")).agg(
        F.bool_or(F.col("status").isin("pending", "running")).alias("open"),
        F.bool_or(F.col("status") == "failed").alias("bad"),
    )
    ended = (F.col("status") == "running") & ~F.coalesce("open", F.lit(False))
    outcome = F.when(F.coalesce("bad", F.lit(False)), "failed").otherwise("completed")
    return backfills.join(per, "id", "left").withColumn("status", F.when(ended, outcome).otherwise(F.col("status"))).drop("open", "bad")


def slice_state(events: DataFrame) -> DataFrame:
    """Current state of each slice from its events ``(slice_id, seq, event)``.

    Events: start, done, skipped, failed, retry, cancel, throttled. Cancelling skips a slice that
    is pending or failed and leaves others as they are, so the state folds the last decisive
    event; every start is an attempt and a throttled one is taken back.
    """
    states = {"start": "running", "done": "done", "skipped": "skipped", "failed": "failed", "retry": "pending",
              "throttled": "pending"}
    state = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    cancel = F.col("event") == "cancel"
    per = events.groupBy("slice_id").agg(
        F.max_by("event", F.when(~cancel, F.col("seq"))).alias("last_event"),
        F.max(F.when(~cancel, F.col("seq"))).alias("last_seq"),
        F.max(F.when(cancel, F.col("seq"))).alias("cancel_seq"),
        F.greatest(F.count_if(F.col("event") == "start") - F.count_if(F.col("event") == "throttled"), F.lit(0)).alias("attempts"),
    )
    current = F.coalesce(F.try_element_at(state, F.col("last_event")), F.lit("pending"))
    cancelled = F.coalesce(F.col("cancel_seq") > F.coalesce("last_seq", F.lit(-1)), F.lit(False))
    return per.select(
        "slice_id",
        F.when(cancelled & current.isin("pending", "failed"), "skipped").otherwise(current).alias("status"),
        "attempts",
    )


def overlap_windows(records: DataFrame, ts: str = "ts") -> DataFrame:
    """Records seen by each fetch window: 180 minutes long, started every 30 minutes."""
    w = F.window(ts, f"{WINDOW_MINUTES} minutes", f"{CYCLE_MINUTES} minutes")
    return records.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def split_full_windows(records: DataFrame, ts: str = "ts", limit: int = MAX_RECORDS) -> DataFrame:
    """Windows that hold ``limit`` records or more, at each halving until 30 minutes or less.

    A window is reached only when its parent was full too, which a fuller parent implies; at the
    last grain a full window stays truncated.
    """
    grains = [WINDOW_MINUTES * 60]
    while grains[-1] > MIN_SPLIT_MINUTES * 60:
        grains.append(grains[-1] // 2)
    finest = grains[-1]
    epoch = F.unix_timestamp(F.col(ts).cast("timestamp"))
    # Count once at the finest grain; coarser grains add up those few counts.
    base = records.groupBy((F.floor(epoch / finest) * finest).alias("at")).agg(F.count("*").alias("n"))
    sized = base.select(F.explode(F.array(*[F.lit(g) for g in grains])).alias("seconds"), "at", "n")
    return (
        sized.groupBy("seconds", (F.floor(F.col("at") / F.col("seconds")) * F.col("seconds")).alias("start"))
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= limit)
        .select(
            F.timestamp_seconds("start").alias("window_start"), "seconds", "n",
            (F.col("seconds") <= MIN_SPLIT_MINUTES * 60).alias("truncated"),
        )
    )
