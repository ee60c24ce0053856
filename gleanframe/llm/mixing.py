"""Mix sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words of its source up to and including it,
in shuffled order, divided by the source's target.  All documents, each once per pass over
its source, stand in one global order of finish times, and the mix is what comes before
the budget is used up.  Sources of any size advance at the same virtual speed.

Prefix sums are taken in two steps, per bucket and inside a bucket, so that neither a
source with a third of all rows nor the global order meets in one task.  Only DataFrame
functions; reruns agree because the shuffle is a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm.tables import kept

# The contract's weights, budget and passes.
WEIGHTS = (3, 1, 2)
BUDGET_PCT = 150
PASSES = 2


def n_words(text: Column) -> Column:
    """Runs of characters other than x20 and x09-x0D; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_pct: int = BUDGET_PCT) -> DataFrame:
    """``(source, source_size, target)`` for sources by code point, null last.

    A target is the lesser of ``PASSES`` times the source and ``level * weight``; the level
    at which targets add up to the budget is where resharing the excess ends.  Sources are
    sorted by the level at which they stop; those before the budget's level are full.  One
    row per source meets in the window, not one per document.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy())
    cap = F.col("source_size") * PASSES
    named = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("total", total)
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("total") * budget_pct / 100 - F.coalesce(F.sum("cap").over(below), F.lit(0))
    levels = named.withColumn("level", left / F.sum("weight").over(rest))
    # The first source that isn't full at its own level fixes the level for all that follow.
    open_ = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    final = F.first(open_, ignorenulls=True).over(
        by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("weight"), F.col("cap").cast("double")))
    return levels.select("source", "source_size", target.alias("target"))


def _bucketed(rows: DataFrame, keys: list[str], bucket: str, amount: str) -> DataFrame:
    """Adds ``before``: the amount in all earlier buckets of the keys, one row per bucket."""
    per = rows.groupBy(*keys, bucket).agg(F.sum(amount).alias("_amount"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, bucket, F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("before"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_pct: int = BUDGET_PCT) -> DataFrame:
    """``(doc_id, text_key, source, size, source_size, target, taken)`` per document.

    A null text has size 0 and takes nothing; a null source is a source of its own, last in
    order.  Documents without words are in the mix if their finish time is, with 0 words.
    Ties in the shuffled order are broken by doc_id and text, rows alike in both take
    consecutive places.  Extra columns are ignored and an empty table gives no rows.
    """
    null_last = F.when(F.col("source").isNull(), 1).otherwise(0)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = kept(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            null_last.alias("no_source"),
            n_words(F.col("text")).alias("size"),
            key.alias("key"),
            F.xxhash64("text").alias("text_key"),
        ).withColumn("source_", F.coalesce("source", F.lit("")))
    )
    rows = sized.count()
    # About sqrt(rows) buckets of sqrt(rows) rows, so both steps stay small at any size.
    buckets = max(1, int(rows**0.5))
    spot = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    sized = sized.withColumn("bucket", spot)
    totals = kept(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_pct)
    ).select(
        F.col("source").alias("s"), F.col("source_size"), F.col("target")
    )
    at = ["no_source", "source_"]
    within = Window.partitionBy(*at, "bucket").orderBy("key", "doc_id", "text_key")
    run = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = sized.withColumn("run", run).join(_bucketed(sized, at, "bucket", "size"), [*at, "bucket"])
    upto = upto.withColumn("cum", F.col("run") + F.col("before")).drop("run", "before")
    timed = upto.join(totals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    for n in range(PASSES):
        finish = F.try_divide(F.col("cum") + n * F.col("source_size"), F.col("target"))
        timed = timed.withColumn(f"finish{n}", F.coalesce(finish, F.lit(0.0)))
    timed = kept(timed)
    timed, edge, best = _cut(timed, buckets, budget_pct)
    inside = [
        ((F.col(f"range{n}") < edge) | ((F.col(f"range{n}") == edge) & (_place(n) <= best))).cast("long")
        for n in range(PASSES)
    ]
    copies = sum(inside[1:], inside[0])
    columns = ["doc_id", "text_key", "source", "size", "source_size", "target"]
    return timed.select(*columns, copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def _place(n: int) -> Column:
    """A document's place in the global order in pass ``n``."""
    return F.struct(
        F.col(f"finish{n}").alias("finish"), "no_source", "source_", "key",
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text_key", "cum",
    )


def _cut(timed: DataFrame, buckets: int, budget_pct: int) -> tuple[DataFrame, int, Column]:
    """Where the budget ends: the range of finish times, and the last place inside it.

    Finish times are dealt into equal ranges; the ranges' sums show in which one the budget
    ends, and only that range is sorted.  Three single rows reach the driver.
    """
    last = f"finish{PASSES - 1}"
    total = timed.agg(F.max(last).alias("end"), F.sum("size").alias("size")).first()
    end, budget = total["end"] or 1.0, (total["size"] or 0) * budget_pct / 100
    for n in range(PASSES):
        timed = timed.withColumn(f"range{n}", (F.col(f"finish{n}") / F.lit(end) * buckets).cast("int"))
    steps = F.array(*[F.struct(F.col(f"range{n}").alias("range"), _place(n).alias("place")) for n in range(PASSES)])
    queue = timed.select("size", F.explode(steps).alias("step")).select("size", "step.*")
    before = _bucketed(queue, [], "range", "size").where(F.col("before") <= budget)
    found = before.orderBy(F.desc("range")).first()
    edge, base = (found["range"], found["before"]) if found else (-1, 0)
    order = Window.partitionBy("range").orderBy("place")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = queue.where(F.col("range") == edge).withColumn("upto", run + base).where(F.col("upto") <= budget)
    best = inside.agg(F.max("place").alias("place")).first()["place"]
    if best is None:
        return timed, edge, F.lit(None)
    values = F.struct(
        F.lit(best["finish"]).alias("finish"), F.lit(best["no_source"]).alias("no_source"),
        F.lit(best["source_"]).alias("source_"), F.lit(best["key"]).alias("key"),
        F.lit(best["doc_id"]).cast("long").alias("doc_id"), F.lit(best["text_key"]).cast("long").alias("text_key"),
        F.lit(best["cum"]).cast("long").alias("cum"),
    )
    return timed, edge, values
