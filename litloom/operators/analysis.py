"""Questions analysts ask of relations, gaps and hypotheses: filters, orders, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import vocab
from litloom.session import cut


def filter_evidence(
    relations: DataFrame, entity: str = "", predicates=(), polarities=(), certainties=(), years: tuple[int, int] | None = None, min_confidence: float = 0.0
) -> DataFrame:
    """Relations that meet all of: the entity as a substring of subject, object and predicate; each
    selection (an empty one doesn't filter); the years (relations without one pass); the confidence."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("None")), F.coalesce("object", F.lit("None")), F.coalesce("predicate", F.lit("None"))))
    keep = F.coalesce("confidence", F.lit(0.0)) >= min_confidence
    if entity.strip():
        keep &= F.contains(hay, F.lit(entity.strip().lower()))
    if predicates:
        keep &= F.col("predicate").isin(*predicates)
    for c, chosen in (("polarity", polarities), ("certainty", certainties)):
        if chosen:
            keep &= F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("uncertain"))).isin(*chosen)
    if years:
        y = F.col("publication_year")
        keep &= y.isNull() | (y == 0) | y.between(*years)
    return relations.where(keep)


def by_confidence(relations: DataFrame, order: str = "rel_ord", k: int | None = None) -> DataFrame:
    out = relations.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), order)
    return out.limit(k) if k else out


def filter_gaps(gaps: DataFrame, novelty=(), min_score: float = 0.0, types=()) -> DataFrame:
    keep = F.coalesce("score", F.lit(0.0)) >= min_score
    if novelty:
        keep &= F.upper("novelty_status").isin(*novelty)
    if types:
        keep &= F.col("node_a_type").isin(*types) | F.col("node_b_type").isin(*types)
    return gaps.where(keep)


def sort_gaps(gaps: DataFrame, by: str = "Score") -> DataFrame:
    """By Score, by Novelty (its rank, then score), or Alphabetical; ties by score rank and names."""
    ties = [F.desc("score"), "node_a", "node_b"]
    if by == "Score":
        return gaps.orderBy(*ties)
    if by == "Novelty":
        rank = F.create_map(*[F.lit(x) for kv in vocab.NOVELTY_RANK.items() for x in kv])[F.upper("novelty_status")]
        return gaps.orderBy(F.coalesce(rank, F.lit(99)), *ties)
    return gaps.orderBy(F.lower("node_a"), F.lower("node_b"), *ties)


def sort_hypotheses(h: DataFrame, by: str = "final_score") -> DataFrame:
    if by not in ("final_score", "evidence_score", "novelty_score", "plausibility_score", "feasibility_score", "confidence"):
        raise ValueError(f"no such score: {by}")
    return h.orderBy(F.desc(F.coalesce(by, F.lit(0.0))), "hypothesis_id")


def places(ordered: DataFrame) -> DataFrame:
    """Rows of a sorted table with their place from 1.

    Rows are numbered within the partitions of the sort, and one small row a partition holds where it
    begins, so no task sees all rows. Written once, as a second sort may cut partitions otherwise.
    """
    rows = cut(ordered.withColumn("_id", F.monotonically_increasing_id())).withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = sizes.select("_part", before.alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_row") + 1).drop("_id", "_part", "_row", "_start")


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, column: str, order: str, k: int = 10) -> DataFrame:
    """The k most frequent values, of equally frequent ones those seen first."""
    c = df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return c.orderBy(F.desc("n"), "first").limit(k).select(column, "n")


def options(df: DataFrame, *columns: str, **unions: tuple[str, ...]) -> DataFrame:
    """(name, value): sorted distinct non-blank values of each column, and of several taken together, as texts."""
    named = [(c, c) for c in columns] + [(n, c) for n, cs in unions.items() for c in cs]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in named]))
    return df.select(each.alias("o")).select("o.name", "o.value").where("value <> ''").distinct().orderBy("name", "value")


def years_covered(articles: DataFrame) -> DataFrame:
    """One row: "first–last" of the years there are, one year alone, or N/A."""
    y = F.nullif("year", F.lit(0))
    lo, hi = F.min(y).cast("string"), F.max(y).cast("string")
    return articles.agg(F.when(lo.isNull(), "N/A").when(lo == hi, lo).otherwise(F.concat(lo, F.lit("–"), hi)).alias("years_covered"))


def middle_year(relations: DataFrame) -> DataFrame:
    """One row: the middle (upper of two) of the distinct years."""
    ys = F.array_sort(F.collect_set(F.nullif("publication_year", F.lit(0))))  # of a few hundred values at most
    return relations.agg(F.try_element_at(ys, (F.size(ys) / 2).cast("int") + 1).alias("middle_year"))


def gap_figures(gaps: DataFrame, threshold: float = 0.7) -> DataFrame:
    return gaps.agg(F.count("*").alias("n_gaps"), F.count_if(F.col("score") >= threshold).alias("n_high"))


def evidence_claims(relations: DataFrame) -> DataFrame:
    return relations.agg(F.count_if(F.coalesce("sentence", F.lit("")) != "").alias("n_evidence_claims"))


def hypothesis_figures(h: DataFrame) -> DataFrame:
    def mean(c: str) -> Column:
        return F.avg(F.coalesce(c, F.lit(0.0))).alias(f"avg_{c}")

    return h.agg(F.count("*").alias("n_hypotheses"), mean("final_score"), mean("evidence_score"), mean("novelty_score"))


def metadata(articles: DataFrame, entities: DataFrame, relations: DataFrame, stats: DataFrame, gaps: DataFrame, hypotheses: DataFrame, query: str = "", cutoff: int | None = None) -> DataFrame:
    """One row of figures of a run; each part is an aggregate of one row."""
    parts = [
        articles.agg(F.count("*").alias("n_articles")), entities.agg(F.count("*").alias("n_entities")), relations.agg(F.count("*").alias("n_relations")), evidence_claims(relations),
        stats.select("n_nodes", "n_edges", "n_biological_edges"), gaps.agg(F.count("*").alias("n_gaps")), hypotheses.agg(F.count("*").alias("n_hypotheses")), years_covered(articles),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p, allowMissingColumns=True)
    one = one.agg(*[F.max(c).alias(c) for c in one.columns])
    return one.withColumns({"query": F.lit(query), "cutoff_year": F.lit(cutoff).cast("int")})


def corpus_summary(meta: DataFrame) -> DataFrame:
    return meta.select(F.concat(F.col("n_articles"), F.lit(" papers · "), F.col("n_relations"), F.lit(" evidence claims · "), F.col("years_covered")).alias("summary"))
