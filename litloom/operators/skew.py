"""Joins in which no key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.session import cut

#: Parts that the rows of a hot key are dealt to.
SALTS = 4096
#: Rows of a key on either side of a product that meet in one cell.
CHUNK = 256


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str, share: int = 1000, total: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to a table of few rows a key; its column ``n`` (dropped) says how many rows have the key.

    A key is hot if it has more than 1/share of all n: there are fewer than ``share`` such keys, whatever the
    size of the data, so their part of the table goes to every task. The other keys meet in an ordinary join, in
    which the hot keys' rows, already served, are dealt out by a hash of their values. The table must hold a bounded
    number of rows a key. Without ``total``, the sum of all n, the table is cut off by a checkpoint and the sum taken.
    Empty tables give no matches; keys of null match nothing.
    """
    if total is None:
        table = cut(table)
        # n is the same in all rows of a key; counted once each.
        total = table.select(*keys, n).distinct().agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    hot = F.col(n) * share > F.lit(total)
    values = [c for c in table.columns if c not in keys and c != n]
    few = table.where(hot).select(*keys, *[F.col(c).alias(f"_h_{c}") for c in values], F.lit(True).alias("_hot"))
    rest = table.where(~hot).select(*keys, *[F.col(c).alias(f"_c_{c}") for c in values], F.lit(True).alias("_cold"), F.lit(0).alias("_salt"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    out = rows.join(F.broadcast(few), keys, "left").withColumn("_salt", salt).join(rest, [*keys, "_salt"], "left")
    if how == "inner":
        out = out.where(F.col("_hot") | F.col("_cold"))
    return out.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in values])


def product(left: DataFrame, right: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """left joined (inner) to right on a key that many rows may have on both sides.

    A key's rows are cut into chunks by hash on either side and every pair of chunks meets in a cell of its own, so
    a hub's product is spread over as many cells as its size asks for; a key of few rows has one cell.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("_nl")).join(right.groupBy(key).agg(F.count("*").alias("_nr")), key)
    sizes = cut(sizes.withColumns({"_kl": F.ceil(F.col("_nl") / chunk).cast("int"), "_kr": F.ceil(F.col("_nr") / chunk).cast("int")}))
    all_of = sizes.agg(F.coalesce(F.sum("_nl"), F.lit(0)).alias("l"), F.coalesce(F.sum("_nr"), F.lit(0)).alias("r")).first()

    def cells(rows: DataFrame, n: str, own: str, other: str, mine: str, theirs: str, total: int) -> DataFrame:
        rows_ = join_hot(rows, sizes.select(key, n, own, other), [key], n, total=total)
        return rows_.select(*rows.columns, F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))

    a = cells(left, "_nl", "_kl", "_kr", "_i", "_j", all_of["l"])
    b = cells(right, "_nr", "_kr", "_kl", "_j", "_i", all_of["r"])
    return a.join(b, [key, "_i", "_j"]).drop("_i", "_j")
