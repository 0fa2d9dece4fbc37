"""Mixing sources to target weights by weighted sampling without replacement (exponential keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut

#: Slices of a source's key range; only the slice in which the budget ends is ordered row by row.
SLICES = 4096


def canonical(source):
    """One spelling of a source: trimmed, lower case; blank is null."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def mix(items: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A mixture of ``items`` (doc_id, source, tokens, weight) and its shares.

    ``targets``: source, target_share, max_repeats (a small table of sources).  A source's budget is its share
    of ``total`` tokens (default: the tokens of all items of the target sources).  It takes whole epochs
    first, then items by ascending exponential key ``-ln(u) / weight`` until the rest of the budget is
    reached (the item that reaches it is taken if it lands closer with it than without); never more than
    ``max_repeats`` uses of an item.  ``u`` is a hash of the seed and doc_id, so a mixture can be repeated.

    Returns (mixture: source, doc_id, uses, tokens) and (shares: source, target_share, max_repeats,
    available_tokens, taken_tokens, actual_share), the latter with a row for each target, absent ones with 0.

    Items without a target source, without tokens or with a null id are left out; a null or non-positive
    weight counts as the smallest, 1e-6; equal keys go by doc_id; repeated rows are items of their own;
    an empty table gives an empty mixture and shares of 0.
    """
    t = targets.select(canonical("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    u = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    w = F.greatest(F.coalesce("weight", F.lit(1e-6)), F.lit(1e-6))
    x = items.where("tokens > 0 and doc_id is not null").select("doc_id", canonical("source").alias("source"), F.col("tokens").cast("long"), (-F.log(u) / w).alias("key"))
    # a monotone image of the key in [0, 1) that spreads it evenly over the slices
    x = x.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key"))) * SLICES), F.lit(SLICES - 1)).cast("int"))
    t = cut(t, "targets")
    x = x.join(broadcast_if_small(t.select("source")), "source")
    per_slice = x.groupBy("source", "slice").agg(F.sum("tokens").alias("slice_tokens"))  # at most SLICES rows a source
    upto = Window.partitionBy("source").orderBy("slice")
    all_of = Window.partitionBy("source")
    whole = F.sum("slice_tokens").over(Window.partitionBy()) if total is None else F.lit(float(total))
    plan = (
        per_slice.join(t, "source")
        .withColumn("before", F.sum("slice_tokens").over(upto) - F.col("slice_tokens"))
        .withColumn("available", F.sum("slice_tokens").over(all_of))
        .withColumn("budget", F.col("target_share") * whole)
        .withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats")).cast("int"))
        .withColumn("rest", F.when(F.col("epochs") >= F.col("max_repeats"), 0.0).otherwise(F.col("budget") - F.col("epochs") * F.col("available")))
    )
    cols = ["source", "slice", "before", "slice_tokens", "rest", "epochs"]
    # a key of both columns holds a slice of a source, so no key is hot without a broadcast
    y = x.join(broadcast_if_small(cut(plan.select(*cols), "plan")), ["source", "slice"])
    ends_here = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("slice_tokens") > F.col("rest"))
    inside = F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = y.where(ends_here).withColumn("reach", inside).withColumn("extra", (F.col("reach") - F.col("tokens") / 2.0 <= F.col("rest")).cast("int"))
    plain = y.where(~ends_here).withColumn("extra", (F.col("before") < F.col("rest")).cast("int"))
    keep = ["source", "doc_id", (F.col("epochs") + F.col("extra")).alias("uses"), "tokens"]
    mixture = plain.select(*keep).union(edge.select(*keep)).where("uses > 0")
    taken = mixture.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("taken_tokens"))
    available = per_slice.groupBy("source").agg(F.sum("slice_tokens").alias("available_tokens"))
    shares = t.join(available, "source", "left").join(taken, "source", "left").na.fill(0, ["available_tokens", "taken_tokens"])
    shares = shares.withColumn("actual_share", F.coalesce(F.col("taken_tokens") / F.nullif(F.sum("taken_tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)))
    return mixture, shares.select("source", "target_share", "max_repeats", "available_tokens", "taken_tokens", "actual_share")
