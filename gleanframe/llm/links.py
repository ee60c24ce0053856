"""Links between sets that share tokens, complete, without listing all pairs of a group.

Tokens that several sets share make buckets.  First every bucket's members are compared
with one of them, its hub, which links a group of near copies with as many pairs as it has
members.  Members that are then in one component need no comparison.  A group of near copies
has members that are not near its hub but near others, so in further rounds (``rounds``) the
members of a large bucket meet ``HUBS`` more from the large component and as many from outside
of it, as long as that links any.  What is left, pairs of one bucket in different components,
is compared in full, so no link between components is lost; there a pair has a row per run of
common tokens, not per token.  Joins on tokens may be split where a token is frequent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.components import components
from gleanframe.llm.tables import kept

# Hubs from each side of a bucket in a round after the first.
HUBS = 6
# Members of a bucket for which further hubs pay; in smaller ones all pairs are at most as many as those with hubs.
LARGE = 4 * HUBS

# Checks candidate pairs (a, b) and returns the linked ones.
Verify = Callable[[DataFrame], DataFrame]


def _open(buckets: DataFrame) -> DataFrame:
    """Rows of the buckets whose members are in more than one component."""
    spread = buckets.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return buckets.join(spread.where("lo <> hi").select("token"), "token", "left_semi")


def _sided(buckets: DataFrame, rank: Column) -> DataFrame:
    """Rows of the open buckets with ``in_main`` and ``large``.

    They say whether a row is in the component of its bucket's first hub, the member of least
    ``rank``, and whether the bucket has more than ``LARGE`` members.
    """
    spread = buckets.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", rank).alias("main"), F.count("*").alias("members")
    )
    rows = buckets.drop("in_main", "large").join(spread.where("lo <> hi").select("token", "main", "members"), "token")
    in_main, large = F.col("component") == F.col("main"), F.col("members") > LARGE
    return rows.withColumns({"in_main": in_main, "large": large}).drop("main", "members")


def _labelled(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    labels = components(edges)
    return buckets.drop("component").join(labels, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def token_pairs(
    left: DataFrame, right: DataFrame, once: Column, possible: Callable[..., Column], matches: bool, runs: bool = False
) -> DataFrame:
    """``(a, b, ell, k)`` of pairs with common tokens; the sum of a pair's ``k`` is their number.

    With ``runs`` a pair's common tokens that follow one another on both sides make no row but
    the first and the last of them, so a pair has as many rows as it has such runs.  That takes
    all rows of both sides, and ``prev`` and ``next``, a side's tokens before and after the row.
    """
    fits = (F.col("o.token") == F.col("x.token")) & once & possible("o", "x")
    ell, k = F.lit(1), F.lit(1)
    if matches:
        ell = F.least("o.ell", "x.ell")
        fits = fits & (F.col("o.level") <= ell) & (F.col("x.level") <= ell)
    if runs:
        begins = F.col("o.prev") != F.col("x.prev")
        # The next token counts under the same conditions as this one.
        beyond = (F.greatest("o.next_level", "x.next_level") > ell) | ~possible("o", "x", "next_lost")
        stops = (F.col("o.next") != F.col("x.next")) | beyond
        fits = fits & (begins | stops)
        at = F.when(F.col("o.id") < F.col("x.id"), F.col("o.at")).otherwise(F.col("x.at"))
        k = F.when(stops, at + 1).otherwise(0) - F.when(begins, at).otherwise(0)
    return left.alias("o").join(right.alias("x"), fits).select(
        F.least("o.id", "x.id").alias("a"), F.greatest("o.id", "x.id").alias("b"), ell.alias("ell"), k.alias("k")
    )


def links(buckets: DataFrame, possible: Callable[..., Column], verify: Verify, matches: bool, rounds: int = 0) -> DataFrame:
    """Linked pairs ``(a, b)`` whose components are those of all links.

    ``buckets`` has ``token``, ``id`` and whatever ``possible`` reads: a condition on two
    aliased rows of a bucket that every linked pair meets.  With ``matches`` it is a written
    table whose rows carry ``lost``, ``level``, ``ell`` and what :func:`token_pairs` needs for
    runs, and a pair needs as many common tokens within both sides' first ``min(ell)`` levels
    as the lesser ``ell``.  ``rounds`` changes the work, not the components.
    """
    # The hub is the member that lost least, which is near the centre of a group of copies;
    # among equals, any fixed choice.
    lost = F.least(F.col("lost"), F.lit((1 << 15) - 1)) if matches else F.lit(0).cast("long")
    rank = F.shiftleft(lost, 48) + F.shiftrightunsigned(F.xxhash64("id"), 16)
    rows = buckets.withColumn("component", F.col("id"))
    if not matches:
        rows = kept(_open(rows))
    hubs = rows.groupBy("token").agg(F.min(rank).alias("rank"))
    hub_rows = rows.withColumn("rank", rank).join(hubs, ["token", "rank"])

    def near(left: DataFrame, right: DataFrame, once: Column, runs: bool = False) -> DataFrame:
        pairs = token_pairs(left, right, once, possible, matches, runs)
        counted = pairs.groupBy("a", "b").agg(F.sum("k").alias("common"), F.max("ell").alias("ell"))
        return counted.where("common >= ell").select("a", "b")

    # A pair may share more buckets than those with this hub; it then has its turn below.
    found = kept(verify(near(rows, hub_rows, F.col("o.id") != F.col("x.id"))))

    apart = F.col("o.component") != F.col("x.component")
    rows = kept(_sided(_labelled(rows, found), rank))
    for number in range(rounds):
        if rows.isEmpty():
            return found
        large = rows.where("large")
        more = kept(verify(near(large, _more_hubs(large, number), apart)))
        # Where further hubs link nothing, still more of them cost more than they save.
        if more.isEmpty():
            break
        found = found.unionByName(more)
        rows = kept(_sided(_labelled(rows, found), rank))
    # Only members outside of the large component start pairs.
    once = apart & (F.col("x.in_main") | (F.col("o.id") < F.col("x.id")))
    return found.unionByName(verify(near(rows.where("not in_main"), rows, once, runs=matches)))


def _more_hubs(rows: DataFrame, number: int) -> DataFrame:
    """``HUBS`` members of each bucket's large component and as many others, least in orders of their own.

    The orders are the same for all buckets, so members of a group have the same hubs in each
    bucket that they share.
    """
    orders = [F.xxhash64("id", F.lit(number * HUBS + k)) for k in range(HUBS)]
    least = [F.min(o).alias(f"least{k}") for k, o in enumerate(orders)]
    chosen = rows.groupBy("token", "in_main").agg(*least)
    is_hub = F.lit(False)
    for k, order in enumerate(orders):
        is_hub = is_hub | (order == F.col(f"least{k}"))
    return rows.join(chosen, ["token", "in_main"]).where(is_hub).select(*rows.columns)
