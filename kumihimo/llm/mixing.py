"""Mixing sources to target weights (problem 8), by hash-threshold histograms.

Every source's records are ordered by a hash of their id. The tokens of each source are
summed by hash bucket; the bucket in which the source's budget runs out is found from the
sums, refined by finer buckets until it holds few records, and the records are filtered by
the threshold: no sort, and one scan of small rows per refinement. A larger budget has a
greater threshold, so its selection contains that of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kumihimo.sources.shared import written

BITS = 10  # a refinement splits a bucket into 2^10
#: Targets, at most; tables of one row per target are broadcast.
MOST_TARGETS = 10_000
ROUNDS = 4  # 40 bits of hash: a bucket then holds about one record in 10^12


def canonical_source(source: str) -> F.Column:
    """Lower case, outer blanks removed, dashes and blanks within as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(source))), "[\\s-]+", "_")


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, available, wanted: tokens each source shall give.

    Without ``total`` the mixture is the largest in which every source meets its share within
    its repeats. With it, a source that can't give its part gives all it may. Targets
    of no share want nothing; sources without a target are left out; a source with a target
    but no tokens gives nothing and doesn't bound the others.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    plan = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").fillna(0, ["available"])
    bound = F.col("available") * F.col("max_repeats")
    if total is None:
        per_share = plan.where("target_share > 0 AND available > 0").agg(F.min(bound / F.col("target_share")))
        total = per_share.first()[0] or 0
    return plan.withColumn("wanted", F.least(bound.cast("double"), F.col("target_share") * F.lit(float(total))))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """source, full_uses, prefix: records whose hash is below ``prefix`` are used once more.

    The number of whole uses is wanted // available; the rest is met by the threshold, which
    is within one record of it.
    """
    full = F.floor(F.when(F.col("available") > 0, F.col("wanted") / F.col("available")).otherwise(0.0))
    state = plan.withColumn("full_uses", full).withColumn("rest", F.col("wanted") - full * F.col("available")).withColumn("prefix", F.lit(0).cast("long"))
    state = state.select("source", "full_uses", "rest", "prefix")
    for r in range(1, ROUNDS + 1):
        shift = BITS * (ROUNDS - r)
        at_bucket = F.shiftright("h", shift)
        inside = sized.join(F.broadcast(state), "source")  # one row per source of the targets
        inside = inside.where(F.shiftright("h", shift + BITS) == F.col("prefix")) if r > 1 else inside
        sums = inside.groupBy("source", "full_uses", "rest", at_bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        running = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        # the first bucket by whose end the rest is used up
        crossing = sums.withColumn("run", running).where("run > rest")
        found = crossing.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("run") + F.col("n")).alias("rest")), "bucket").alias("x"))
        joined = state.join(found, "source", "left")
        # where all records together don't use it up, everything is below the threshold
        end = F.shiftleft(F.col("prefix") + 1, BITS) if r > 1 else F.lit(1 << BITS)
        state = joined.select("source", "full_uses", F.coalesce("x.rest", "rest").alias("rest"), F.coalesce("x.bucket", end).cast("long").alias("prefix"))
        state = written(state)
    return state


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, uses for every record of the mixture.

    ``documents`` has doc_id, source and n_tokens; ``targets`` source, target_share and
    max_repeats. Sources are compared in canonical form; records without a source, with
    one that isn't a target, or without tokens are not used; no record is used more than
    its source's max_repeats times. An empty table gives an empty mixture.
    """
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    targets = targets.withColumn("source", canonical_source("source"))
    sized = documents.withColumn("source", canonical_source("source")).where("n_tokens > 0 AND source IS NOT NULL")
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("mixture")), 64 - BITS * ROUNDS)
    sized = written(sized.select("doc_id", "source", "n_tokens", h.alias("h")).join(targets.select("source"), "source", "left_semi"))
    cut = thresholds(sized, budgets(sized, targets, total))
    uses = F.col("full_uses") + F.when(F.col("h") < F.col("prefix"), 1).otherwise(0)
    return sized.join(F.broadcast(cut), "source").select("doc_id", "source", "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")


def mix_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: the share wanted and reached, tokens, records, and the most uses of one."""
    targets = targets.withColumn("source", canonical_source("source"))
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    all_tokens = Window.partitionBy()
    both = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["tokens", "records", "most_uses"])
    return both.withColumn("actual_share", F.try_divide("tokens", F.sum("tokens").over(all_tokens)))
