"""Run logs and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import vocab
from tallymark.functions.classify import is_failure_line, test_group
from tallymark.operators.ranking import BLOCK_ROWS, carry_blocks


def step_lines(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Log lines with the step they belong to; lines outside of a step are dropped.

    `log(test_id, seq, level, msg)` with `seq` a whole number unique in its test. A start
    opens a step, an end closes it, and a start without an end switches. Blocks of
    consecutive lines are segmented on their own; what is open at the start of a block comes
    from the block totals, so one long log is shared by many tasks. Gives `(test_id, step,
    seq, level, msg, is_start, failed)`; the start line carries the title in `msg`.
    """
    opens = F.when(F.col("msg").rlike(vocab.STEP_START), True).when(
        F.col("msg").rlike(vocab.STEP_END), False)
    blocked = log.select(
        "test_id", "seq", "level", "msg", opens.alias("__opens"),
        F.struct("test_id").alias("__key"), F.floor(F.col("seq") / block_rows).alias("__block"))
    block = ["__key", "__block"]
    starts = F.count_if(F.coalesce("__opens", F.lit(False)))
    # The last mark of a block as one number, which a hash aggregate can keep.
    last_mark = F.max(F.when(
        F.col("__opens").isNotNull(), F.col("seq") * 2 + F.col("__opens").cast("bigint")))
    totals = blocked.groupBy(*block).agg(starts.alias("__starts"), last_mark.alias("__last"))
    carried = carry_blocks(totals, sums={"__starts": "__before"}, maxima={"__last": "__mark"}).select(
        *block, "__before", (F.pmod("__mark", F.lit(2)) == 1).alias("__open"))
    inside = Window.partitionBy(*block).orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = blocked.withColumns({
        "__count": starts.over(inside), "__state": F.last("__opens", True).over(inside)})
    return (
        local.join(carried, block)
        .where(F.coalesce("__state", "__open"))
        .select("test_id", (F.col("__before") + F.col("__count")).alias("step"), "seq", "level",
                "msg", F.coalesce("__opens", F.lit(False)).alias("is_start"))
        .withColumn("failed", ~F.col("is_start") & is_failure_line(F.col("level"), F.col("msg")))
    )


def steps(lines: DataFrame) -> DataFrame:
    """One row per step: number, title, lines and whether a line failed."""
    start = F.when(F.col("is_start"), F.col("msg"))
    return lines.groupBy("test_id", "step").agg(
        F.max(F.regexp_extract(start, vocab.STEP_START, 1).try_cast("int")).alias("step_no"),
        F.max(F.regexp_extract(start, vocab.STEP_START, 2)).alias("title"),
        F.count_if(~F.col("is_start")).alias("lines"),
        F.bool_or("failed").alias("failed"),
    )


def assertion_line(error: str):
    """First line of an error text that states the assertion, or `Test failed`."""
    def states(x):
        return F.startswith(x, F.lit("E   AssertionError:")) | (
            F.contains(F.lower(x), F.lit("assert")) & F.contains(x, F.lit("E ")))

    first = F.get(F.filter(F.split(error, "\n"), states), F.lit(0))
    said = F.when(F.startswith(first, F.lit("E   AssertionError:")),
                  F.replace(first, F.lit("E   AssertionError:"), F.lit(""))).otherwise(
        F.replace(first, F.lit("E   "), F.lit("")))
    return F.coalesce(F.trim(said), F.lit("Test failed"))


def mark_last_steps(step_rows: DataFrame, results: DataFrame) -> DataFrame:
    """Steps where the last one of a failed test is failed, with the assertion as summary.

    `results(test_id, outcome, error_text)`. A last step that failed already has no summary.
    """
    last = step_rows.groupBy("test_id").agg(F.max("step").alias("__last"))
    failed = results.where(F.col("outcome") == "failed").select(
        "test_id", assertion_line("error_text").alias("__summary"))
    joined = step_rows.join(last, "test_id").join(failed, "test_id", "left")
    blamed = (F.col("step") == F.col("__last")) & F.col("__summary").isNotNull() & ~F.col("failed")
    return (
        joined.withColumn("summary", F.when(blamed, F.col("__summary")))
        .withColumn("failed", F.col("failed") | blamed)
        .drop("__last", "__summary")
    )


def run_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, rates and duration of runs. `results(name, outcome, duration)`."""
    def share(part: str):
        return F.round(F.lit(100.0) * F.col(part) / F.greatest(F.col("total"), F.lit(1)), 1)

    def of(outcome: str):
        return F.count_if(F.col("outcome") == outcome).alias(outcome)

    aggregates = [F.count(F.lit(1)).alias("total"), of("passed"), of("failed"), of("skipped"),
                  F.sum("duration").alias("duration")]
    totals = results.groupBy(*by).agg(*aggregates) if by else results.agg(*aggregates)
    return totals.withColumn("pass_rate", share("passed")).withColumn("fail_rate", share("failed"))


def grouped_summary(results: DataFrame) -> DataFrame:
    return run_summary(results.withColumn("test_group", test_group(F.col("name"))), ["test_group"])


def latest_runs(runs: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Latest run of each suite, by one aggregate."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(ts, *[
        c for c in rest if c != ts])).alias("__run")).select(
        *by, *[F.col(f"__run.{c}").alias(c) for c in rest])


