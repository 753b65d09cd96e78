"""Problem 1: items that appear together, and how much more often than by chance.

Method: large-basket blocking. A basket of up to ``CHUNK`` items is one block and gives its pairs
within one row. A larger basket is cut into chunks by a hash of the item, and each pair of its
chunks is a block of its own, so that the product of a huge basket is spread over tasks. The pairs
of both kinds are counted together, and association scores come from the counts.

Defined cases: a basket key that isn't one to eight digits is left out; null arrays and null or
blank items give nothing; repeated items and rows count once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.operators.skew import join_hot
from litloom.session import cut

CHUNK = 64
FIELDS = ("mesh_terms", "keywords")


def clean_item(x: Column, heading: bool = False) -> Column:
    """Lower case, single inner and no outer spaces; of a heading only the part before ' / '."""
    x = F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))
    return F.trim(F.split_part(x, F.lit(" / "), F.lit(1))) if heading else x


def baskets(articles: DataFrame) -> DataFrame:
    """Distinct (field, basket, item): deduplicated in the row, map-side, then by one shuffle."""
    valid = articles.where(F.col("pmid").rlike(r"^[0-9]{1,8}\z"))
    def cleaned(field: str) -> Column:
        return F.array_distinct(F.transform(field, lambda x: clean_item(x, field == "mesh_terms")))

    per_field = F.array(*[F.struct(F.lit(f).alias("field"), cleaned(f).alias("items")) for f in FIELDS])
    rows = valid.select(F.col("pmid").alias("basket"), F.explode(per_field).alias("f")).select("f.field", "basket", F.explode("f.items").alias("item"))
    return rows.where(F.col("item") != "").distinct()


def pair_counts(items: DataFrame, min_count: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(field, item_a, item_b, n_ab) with item_a < item_b by code points, for n_ab >= min_count.

    Items in fewer than min_count baskets can't be in such a pair and are dropped first. Neither a frequent item
    nor a huge basket is a hot key of the joins.
    """
    counts = items.groupBy("field", "item").agg(F.count("*").alias("n"))
    total = items.count()
    kept = join_hot(items, counts.where(F.col("n") >= min_count), ["field", "item"], "n", total=total) if min_count > 1 else items
    # Only baskets that exceed a chunk are in this table: at most one in CHUNK of the items.
    large = kept.groupBy("field", "basket").agg(F.count("*").alias("size")).where(F.col("size") > chunk)
    large = large.select("field", "basket", "size", F.ceil(F.col("size") / chunk).cast("int").alias("k"))
    tagged = join_hot(kept, large, ["field", "basket"], "size", total=total, how="left").withColumn("k", F.coalesce("k", F.lit(1)))
    tagged = tagged.withColumn("c", F.pmod(F.xxhash64("item"), F.col("k")).cast("int"))
    # A chunk takes part in the blocks (i, j) with i <= j that hold it.
    blocks = tagged.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "field", "basket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "item"
    )
    sides = blocks.groupBy("field", "basket", "i", "j").agg(
        F.array_sort(F.collect_list(F.when(F.col("c") == F.col("i"), F.col("item")))).alias("xs"),
        F.array_sort(F.collect_list(F.when((F.col("c") == F.col("j")) & (F.col("i") < F.col("j")), F.col("item")))).alias("ys"),
    )
    # One block of a chunk with itself: each item with those after it. Two chunks: the whole product.
    within = sides.where("i = j").select("field", F.posexplode("xs").alias("at", "x"), "xs").select(
        "field", "x", F.explode(F.expr("slice(xs, at + 2, size(xs))")).alias("y")
    )
    across = sides.where("i < j").select("field", F.explode("xs").alias("x"), "ys").select("field", "x", F.explode("ys").alias("y"))
    pairs = within.unionByName(across).select("field", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    return pairs.groupBy("field", "item_a", "item_b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)


def associations(items: DataFrame, min_count: int = 5) -> DataFrame:
    """Pairs with their counts, lift, pointwise mutual information and its normalised form."""
    counts = items.groupBy("field", "item").agg(F.count("*").alias("n"))
    totals = items.select("field", "basket").distinct().groupBy("field").agg(F.count("*").alias("total"))
    a = counts.select("field", F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = counts.select("field", F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    out = pair_counts(items, min_count).join(a, ["field", "item_a"]).join(b, ["field", "item_b"])
    out = out.join(F.broadcast(totals), "field")  # one row a field
    lift = F.col("n_ab") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.withColumn("lift", lift).withColumn("pmi", F.log2("lift")).withColumn("npmi", F.when(F.col("n_ab") == F.col("total"), F.lit(1.0)).otherwise(F.col("pmi") / -F.log2(F.col("n_ab") / F.col("total"))))


def found(articles: DataFrame, min_count: int = 5, min_lift: int = 4) -> DataFrame:
    # Read by many branches: written once, as plain (field, basket, item) rows.
    scored = associations(cut(baskets(articles)), min_count)
    kept = scored.where(F.col("n_ab").cast("decimal(38,0)") * F.col("total") >= F.lit(min_lift).cast("decimal(38,0)") * F.col("n_a") * F.col("n_b"))
    return kept.select("field", "item_a", "item_b")
