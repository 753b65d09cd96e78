"""Problem 7: one ranking from several scores on different scales.

Method: within each query every score is standardised robustly by its median and median absolute
deviation, squashed by the logistic function so that outliers are bounded, and the bounded values
are combined by a weighted geometric mean. The logistic falls towards 0, whose logarithm has no bound,
so deviations below ``-FAR`` count as ``-FAR``: one far outlier can't outvote the other scores.

Medians come from Spark's mergeable quantile summary with relative rank error 1/ACCURACY: exact for
groups of up to ACCURACY rows and of bounded memory for a group of any size. Ranks are counted
from pre-aggregated score counts, so no group is sorted in one task.

Defined cases: a missing (null or NaN) score stands below the lowest of its query; a score that is
missing throughout a query, or constant, doesn't tell its hypotheses apart; ties share a rank and
the smaller hypothesis_id is named first; null queries form a group of their own; rows without
hypothesis_id are left out; of a hypothesis_id the row with the latest generated_at counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 100_000
SCORES = ("evidence_score", "novelty_score", "plausibility_score", "feasibility_score")
#: 1.4826 makes the median absolute deviation of a normal distribution its standard deviation.
MAD_SCALE, MEAN_SCALE = 1.4826, 1.2533
#: Standardised deviations are cut off here downwards; upwards the logistic bounds them.
FAR = 8.0


def latest(hypotheses: DataFrame, scores=SCORES) -> DataFrame:
    """The row of the latest generated_at of each hypothesis_id; equal times: the greatest values."""
    at = F.try_to_timestamp(F.col("generated_at"))
    row = F.struct(at.alias("at"), F.col("generated_at"), F.col("query"), *[F.when(~F.isnan(s), F.col(s)).alias(s) for s in scores])
    best = hypotheses.where(F.col("hypothesis_id").isNotNull()).groupBy("hypothesis_id").agg(F.max(row).alias("r"))
    return best.select("hypothesis_id", "r.query", *[f"r.{s}" for s in scores])


def combined(rows: DataFrame, scores: Mapping[str, float], group: str = "query", accuracy: int = ACCURACY) -> DataFrame:
    """rows with ``combined_score`` in (0, 1); scores: column -> weight."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("null"))
    rows = rows.withColumn("_g", key)

    def middle(x: Column) -> Column:
        return F.percentile_approx(x, F.lit(0.5), F.lit(accuracy))

    centre = rows.groupBy("_g").agg(*[f(s).alias(f"_{k}_{s}") for s in scores for k, f in (("med", lambda s: middle(F.col(s))), ("min", F.min))])
    rows = rows.join(centre, "_g")
    dev = {s: F.abs(F.col(s) - F.col(f"_med_{s}")) for s in scores}
    spread = rows.groupBy("_g").agg(*[x for s in scores for x in (middle(dev[s]).alias(f"_mad_{s}"), F.avg(dev[s]).alias(f"_aad_{s}"))])
    rows = rows.join(spread, "_g")
    log_sum, total = F.lit(0.0), float(sum(scores.values()))
    for s, w in scores.items():
        scale = F.when(F.col(f"_mad_{s}") > 0, MAD_SCALE * F.col(f"_mad_{s}")).when(F.col(f"_aad_{s}") > 0, MEAN_SCALE * F.col(f"_aad_{s}"))
        z = (F.coalesce(F.col(s), F.col(f"_min_{s}")) - F.col(f"_med_{s}")) / scale
        z = F.coalesce(z, F.lit(0.0)) - F.when(F.col(s).isNull() & F.col(f"_min_{s}").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
        z = F.greatest(F.lit(-FAR), z)
        log_sum = log_sum - F.lit(w / total) * F.log1p(F.exp(-z))  # log of 1 / (1 + exp(-z))
    return rows.withColumn("combined_score", F.exp(log_sum)).drop("_g", *[f"_{k}_{s}" for s in scores for k in ("med", "min", "mad", "aad")])


def equal_weights(scores=SCORES) -> dict[str, float]:
    return dict.fromkeys(scores, 1.0)


def found(hypotheses: DataFrame) -> DataFrame:
    """(query, hypothesis_id) of the first of each query."""
    rows = combined(latest(hypotheses), equal_weights())
    first = rows.groupBy("query").agg(F.min(F.struct((-F.col("combined_score")).alias("s"), "hypothesis_id")).alias("m"))
    return first.select("query", "m.hypothesis_id")


def ranking(hypotheses: DataFrame, buckets: int = 1024) -> DataFrame:
    """(query, hypothesis_id, combined_score, place): place 1 is best, ties share a place.

    Places are sums of counts: of the score buckets above, and within a bucket of the distinct
    scores above; a hot query is spread over its buckets.
    """
    from pyspark.sql import Window

    rows = combined(latest(hypotheses), equal_weights()).select("query", "hypothesis_id", "combined_score")
    rows = rows.withColumn("b", F.least(F.lit(buckets - 1), F.floor(F.col("combined_score") * buckets)).cast("int"))
    values = rows.groupBy("query", "b", "combined_score").agg(F.count("*").alias("n"))
    per_bucket = values.groupBy("query", "b").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("query").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("query", "b", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    within = Window.partitionBy("query", "b").orderBy(F.desc("combined_score")).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    values = values.alias("v").join(per_bucket.alias("p"), F.expr("v.query <=> p.query AND v.b = p.b")).select("v.query", "v.combined_score", (F.col("before") + F.col("inside") + 1).alias("place"))
    return rows.alias("r").join(values.alias("v"), F.expr("r.query <=> v.query AND r.combined_score = v.combined_score")).select("r.query", "r.hypothesis_id", "r.combined_score", "v.place")
