"""Logs of scoring requests: attempts become records, records are graded, counted against the plan and reconciled with paid calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Classes of a record, reasons of extra calls, statuses.
PILOT, RETRIED, FIRST_PASS = "pilot_cache_hit", "format_retry", "new_primary_first_pass"
PASSED, BLOCKED = "FULL_LLM_SCORING_PASS", "FULL_LLM_SCORING_BLOCKED"


def records(attempts: DataFrame, pair: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row per record of a pair: failed attempts up to a valid one, or up to the pair's last.

    Attempts have ``valid``, ``value``, ``pilot`` and ``cached``. A record holds the pair, ``record`` (0-based; a second one is a duplicate),
    ``retries``, ``valid``, ``value`` and ``cached`` of its last attempt, ``pilot`` of its first, ``kind`` and ``calls``, the attempts it
    paid for: none for a pilot's import. A null ``valid``, ``pilot`` or ``cached`` counts as false; ``order`` must end where ties are alike.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    before = Window.partitionBy(*pair).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = attempts.withColumn("record", F.coalesce(F.count_if(flag("valid")).over(before), F.lit(0))).withColumn("_at", F.row_number().over(Window.partitionBy(*pair).orderBy(*order)))
    last = lambda c: F.max_by(c, "_at")
    found = numbered.groupBy(*pair, "record").agg((F.count(F.lit(1)) - 1).alias("retries"), last(flag("valid")).alias("valid"), last(F.col("value")).alias("value"), last(flag("cached")).alias("cached"), F.min_by(flag("pilot"), "_at").alias("pilot"))
    kind = F.when(F.col("pilot"), PILOT).when(F.col("retries") > 0, RETRIED).otherwise(FIRST_PASS)
    return found.withColumn("kind", kind).withColumn("calls", F.when(F.col("pilot"), 0).otherwise(F.col("retries") + 1))


def parse_gate(plan: DataFrame, found: DataFrame, *cell: str) -> DataFrame:
    """Per cell of the plan, which has one row per pair: what is expected, done, valid, failed, missing, out of [0, 1], cached and paid, and
    ``status``. A pair is done when one of its records is valid; cells without records have zeros."""
    valid = F.col("valid")
    counts = found.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if(valid & (F.col("retries") == 0)).alias("valid_first_pass"), F.count_if(valid).alias("valid_after_retry"), F.count_if(~valid).alias("failed"),
        F.count_if(F.col("value").isNull()).alias("missing_value"), F.count_if(valid & ((F.col("value") < 0) | (F.col("value") > 1))).alias("out_of_range"), F.count_if("cached").alias("cache_hits"),
        F.count_if("pilot").alias("pilot_imports"), F.count_if(~F.col("cached") & valid).alias("paid"),
    )
    names = [c for c in counts.columns if c not in cell]
    whole = plan.groupBy(*cell).agg(F.count(F.lit(1)).alias("expected")).join(counts, list(cell), "left").select(*cell, "expected", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    short = (F.col("completed") < F.col("expected")) | (F.col("valid_after_retry") < F.col("expected"))
    return whole.withColumn("status", F.when(short, BLOCKED).otherwise(PASSED))


def reconcile(plan: DataFrame, found: DataFrame, paid: DataFrame, pair: tuple[str, ...], *cell: str) -> DataFrame:
    """Per cell: expected and observed records, missing, duplicates, reuse of a pilot, new records, paid calls, extra ones, their reason, pass.

    ``paid`` has one row per call that was paid for, from the invoice, with the cell's columns. The reason is ``none``, ``format_retry`` if
    as many records were retried as calls are extra, ``accidental_duplicate``, else ``accounting_error``.
    """
    observed = found.groupBy(*cell, *[c for c in pair if c not in cell]).agg(F.count(F.lit(1)).alias("_n"), F.count_if("pilot").alias("_pilot"), F.count_if(F.col("kind") == RETRIED).alias("_retried"))
    counts = observed.groupBy(*cell).agg(F.sum("_n").alias("observed"), F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_pilot").alias("pilot_reuse"), F.sum("_retried").alias("retried_records"))
    calls = paid.groupBy(*cell).agg(F.count(F.lit(1)).alias("paid_calls"))
    whole = plan.groupBy(*cell).agg(F.count(F.lit(1)).alias("expected")).join(counts, list(cell), "left").join(calls, list(cell), "left")
    zero = whole.select(*cell, "expected", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("observed", "duplicates", "pilot_reuse", "retried_records", "paid_calls")])
    known = zero.withColumn("missing", F.greatest(F.lit(0), F.col("expected") - F.col("observed"))).withColumn("new_records", F.col("observed") - F.col("pilot_reuse")).withColumn("extra_calls", F.col("paid_calls") - F.col("new_records"))
    extra, retried = F.col("extra_calls"), F.col("retried_records")
    reason = F.when(extra == 0, "none").when((extra > 0) & (retried == extra), "format_retry").when(F.col("duplicates") > 0, "accidental_duplicate").otherwise("accounting_error")
    passed = (F.col("duplicates") == 0) & (F.col("observed") == F.col("expected")) & (extra == retried)
    return known.withColumn("reason", reason).withColumn("passed", passed)
