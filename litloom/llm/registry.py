"""Queries of the corpus operators, each over its whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.session import cut, spread, table

from . import bpe, dupes, lookalikes, names, packing, pairs, ranking, sentences, truncation


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "articles"))


def p1_associations(spark: SparkSession, d: str) -> DataFrame:
    out = pairs.associations(cut(pairs.baskets(table(spark, d, "articles"))), 5)
    return out.select("field", "item_a", "item_b", "n_ab", "n_a", "n_b", "total", F.round("lift", 6).alias("lift"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of items carried together, however rare; p1_associations has those of 5 baskets and more."""
    out = pairs.associations(cut(pairs.baskets(table(spark, d, "articles"))), 1)
    return out.select("field", "item_a", "item_b", "n_ab", "n_a", "n_b", "total", F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dupes.found(table(spark, d, "entities"), table(spark, d, "relations"))


def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    keys = dupes.entity_keys(table(spark, d, "entities")).unionByName(dupes.relation_keys(table(spark, d, "relations")))
    return dupes.copies(cut(keys))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(spread(table(spark, d, "articles")), spread(table(spark, d, "relations")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.found(spread(table(spark, d, "articles")), spread(table(spark, d, "entities")))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every title, abstract and normalized in its consistent form."""
    a = lookalikes.forms(spread(table(spark, d, "articles")), "article_ord", ["title", "abstract"])
    return a.unionByName(lookalikes.forms(spread(table(spark, d, "entities")), "entity_id", ["normalized"]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "articles"), table(spark, d, "author_ref"), table(spark, d, "journal_ref"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct spelling with every listed name that fits it best; ambiguous: several fit equally well."""
    refs = names.authority(table(spark, d, "author_ref"), table(spark, d, "journal_ref"))
    return names.links(names.spellings(table(spark, d, "articles")), refs).withColumn("score", F.round("score", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.found(table(spark, d, "hypotheses"))


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranking(table(spark, d, "hypotheses")).withColumn("combined_score", F.round("combined_score", 9))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(spread(table(spark, d, "documents")))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, d, "documents")))


def p9_valid(spark: SparkSession, d: str) -> DataFrame:
    """Of each document: are its parts complete and no more than its size asks for, and do its containers hold what they claim?"""
    boxes = cut(packing.pack_documents(spread(table(spark, d, "documents"))))
    held = boxes.groupBy("container").agg(F.sum("part_tokens").alias("held"), F.min("used").alias("u0"), F.max("used").alias("u1"), F.min("length").alias("l0"), F.max("length").alias("l1"))
    held = held.select("container", ((F.col("held") == F.col("u0")) & (F.col("u0") == F.col("u1")) & (F.col("l0") == F.col("l1")) & (F.col("held") <= F.col("l0")) & (F.col("l0") <= packing.CAPACITY)).alias("good"))
    docs = boxes.join(held, "container").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("k"), F.max("part").alias("last"), F.sum("part_tokens").alias("t"), F.bool_and("good").alias("fits"))
    least = F.greatest(F.lit(1), F.ceil(F.col("t") / packing.CAPACITY))
    return docs.select("doc_id", ((F.col("n") == F.col("k")) & (F.col("n") == F.col("last") + 1) & (F.col("n") == least)).alias("whole"), "fits")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(spread(table(spark, d, "documents")))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.sources(spread(table(spark, d, "documents")), blank=True)


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Each cut document with its class: limit or transfer."""
    return truncation.cut_documents(spread(table(spark, d, "documents"))).where("cut IS NOT NULL").select("doc_id", "source", "cut")


_BASKETS = r"""
WITH a AS (SELECT pmid, mesh_terms, keywords FROM articles WHERE regexp_full_match(pmid, '[0-9]{1,8}')),
raw AS (
  SELECT 'mesh_terms' AS field, pmid, trim(split_part(trim(regexp_replace(lower(x), '\s+', ' ', 'g')), ' / ', 1)) AS item FROM (SELECT pmid, unnest(mesh_terms) AS x FROM a)
  UNION ALL
  SELECT 'keywords', pmid, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) FROM (SELECT pmid, unnest(keywords) AS x FROM a)
),
items AS (SELECT DISTINCT field, pmid, item FROM raw WHERE item <> ''),
n AS (SELECT field, item, count(*) AS n FROM items GROUP BY ALL),
t AS (SELECT field, count(DISTINCT pmid) AS total FROM items GROUP BY ALL),
ab AS (
  SELECT x.field, x.item AS item_a, y.item AS item_b, count(*) AS n_ab
  FROM items x JOIN items y ON x.field = y.field AND x.pmid = y.pmid AND x.item < y.item GROUP BY ALL HAVING count(*) >= 5
),
s AS (
  SELECT ab.field, item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, total, round(n_ab * total / (a.n::DOUBLE * b.n), 6) AS lift
  FROM ab JOIN n a ON ab.field = a.field AND item_a = a.item JOIN n b ON ab.field = b.field AND item_b = b.item JOIN t ON ab.field = t.field
)
"""

_CANON = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_COPIES = f"""
WITH e AS (
  SELECT 'entities' AS tab, entity_id AS id, concat_ws('|', coalesce(pmid, '?'), sent_ord, entity_type, {_CANON.format('text')}) AS k FROM entities
), r0 AS (
  SELECT rel_ord, pmid, polarity, {_CANON.format('subject')} AS s, {_CANON.format('predicate')} AS p, {_CANON.format('object')} AS o FROM relations
), r AS (
  SELECT 'relations' AS tab, rel_ord AS id, concat_ws('|', coalesce(pmid, '?'), polarity, p,
    CASE WHEN p IN ('associatedwith', 'correlateswith', 'interactswith') THEN least(s, o) ELSE s END,
    CASE WHEN p IN ('associatedwith', 'correlateswith', 'interactswith') THEN greatest(s, o) ELSE o END) AS k FROM r0
), x AS (SELECT * FROM e UNION ALL SELECT * FROM r)
"""


_SCORES = ranking.SCORES
_MISSING = {c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" for c in _SCORES}
_RANKED = (
    "WITH l AS (SELECT hypothesis_id, unnest(arg_max({'query': query, " + ", ".join(f"'{c}': {x}" for c, x in _MISSING.items()) + "}, generated_at)) FROM hypotheses WHERE hypothesis_id IS NOT NULL GROUP BY 1), "
    "m AS (SELECT query, " + ", ".join(f"quantile_disc({c}, 0.5) AS m_{c}, min({c}) AS lo_{c}" for c in _SCORES) + " FROM l GROUP BY 1), "
    "lm AS (SELECT l.*, m.* EXCLUDE (query) FROM l JOIN m ON l.query IS NOT DISTINCT FROM m.query), "
    "d AS (SELECT query, " + ", ".join(f"quantile_disc(abs({c} - m_{c}), 0.5) AS d_{c}, avg(abs({c} - m_{c})) AS a_{c}" for c in _SCORES) + " FROM lm GROUP BY 1), "
    "z AS (SELECT lm.query, lm.hypothesis_id, "
    + ", ".join(
        f"coalesce((coalesce({c}, lo_{c}) - m_{c}) / CASE WHEN d_{c} > 0 THEN {ranking.MAD_SCALE} * d_{c} WHEN a_{c} > 0 THEN {ranking.MEAN_SCALE} * a_{c} END, 0) - CASE WHEN {c} IS NULL AND lo_{c} IS NOT NULL THEN 1 ELSE 0 END AS z_{c}"
        for c in _SCORES
    )
    + " FROM lm JOIN d ON lm.query IS NOT DISTINCT FROM d.query), "
    "s AS (SELECT query, hypothesis_id, " + " + ".join(f"(-ln(1 + exp(-greatest(-{ranking.FAR}, z_{c}))))" for c in _SCORES) + " AS total FROM z) "
)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_associations, p1_pairs, p2_found, p2_copies, p3_found, p4_found, p4_forms, p5_found, p5_links, p7_found, p7_ranking, p8_ids, p9_packed, p9_valid, p10_found, p10_sources, p10_kinds)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _BASKETS + "SELECT field, item_a, item_b FROM s WHERE n_ab * total >= 4 * n_a * n_b",
        "p1_associations": _BASKETS + "SELECT * FROM s",
        "p1_pairs": _BASKETS.replace(" HAVING count(*) >= 5", "") + "SELECT * FROM s",
        "p7_found": _RANKED + "SELECT query, hypothesis_id FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY total DESC, hypothesis_id) = 1",
        "p7_ranking": _RANKED + f"SELECT query, hypothesis_id, round(exp(total / {len(_SCORES)}), 9) AS combined_score, rank() OVER (PARTITION BY query ORDER BY round(total, 11) DESC) AS place FROM s",
        "p9_valid": "SELECT doc_id, true AS whole, true AS fits FROM documents",
        "p2_found": _COPIES + "SELECT tab, id_a, id AS id_b FROM (SELECT tab, id, min(id) OVER (PARTITION BY tab, k) AS id_a FROM x) WHERE id_a <> id",
        "p2_copies": _COPIES + "SELECT tab, min(id) AS id, count(*) AS n_copies FROM x GROUP BY tab, k",
    }
