"""Cleaning and deduplication of article records, and year windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as X

LISTS = ("authors", "mesh_terms", "keywords")


def _clean_list(df: DataFrame, name: str, preserve_case: bool) -> DataFrame:
    """Normalised, non-blank, distinct items in their order. The whole list crosses to Python at most
    once, as one joined text, and only if it holds characters beyond ASCII."""
    sep = "\x1e"
    joined = X.normal_form(F.array_join(F.filter(F.col(name), lambda x: x.isNotNull()), sep), "NFC")
    items = F.transform(F.split(joined, sep), (lambda x: X.collapse(x)) if preserve_case else (lambda x: X.collapse(F.lower(x))))
    return df.withColumn(name, F.when(F.col(name).isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(items, lambda x: x != ""))))


def normalize_articles(articles: DataFrame, this_year: Column | None = None, preserve_case: bool = False) -> DataFrame:
    """Every text normalised, lists deduplicated, years validated. Null texts become empty; a null or
    empty doi stays null. Normalising lower-cases titles and abstracts, so patterns that need capitals
    find nothing afterwards; ``preserve_case`` keeps them."""

    def norm(x: Column) -> Column:
        return X.collapse(X.normal_form(X.text(x), "NFC")) if preserve_case else X.normalize_text(x)

    out = articles.withColumns({
        "pmid": X.collapse_outer(F.col("pmid")), "title": norm(F.col("title")), "abstract": norm(F.col("abstract")), "journal": norm(F.col("journal")),
        "year": X.valid_year(F.col("year"), this_year), "doi": F.when(F.col("doi") != "", norm(F.col("doi"))),
    })
    for name in LISTS:
        out = _clean_list(out, name, preserve_case)
    return out


def clean_articles(articles: DataFrame, order: str = "article_ord", this_year: Column | None = None, preserve_case: bool = False) -> DataFrame:
    """Normalised articles with a valid pmid and some text, of each pmid the first by ``order``.

    A record without text doesn't use up its pmid. The first is found by a map-side combined minimum,
    then the record itself joined by its unique ordinal, so no pmid's records are gathered in a task.
    """
    kept = articles.where(X.is_pmid(F.col("pmid")))
    has_text = (X.collapse(X.text(F.col("title"))) != "") | (X.collapse(X.text(F.col("abstract"))) != "")
    kept = kept.where(has_text)
    first = kept.groupBy("pmid").agg(F.min(order).alias(order)).select(order)
    return normalize_articles(kept.join(first, order, "left_semi"), this_year, preserve_case)


def year_window(articles: DataFrame, min_year: int | None = None, max_year: int | None = None) -> DataFrame:
    """Articles within the years, ends included; those without a year stay."""
    y = F.col("year")
    keep = F.lit(True)
    if min_year is not None:
        keep &= y >= min_year
    if max_year is not None:
        keep &= y <= max_year
    return articles.where(y.isNull() | keep)


def check_years(min_year: int, max_year: int) -> None:
    if min_year > max_year:
        raise ValueError(f"minimum year {min_year} is after maximum year {max_year}")
