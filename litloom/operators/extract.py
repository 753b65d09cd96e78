"""Typed entities and polarity-aware relations by rules, as table functions without shuffle.

A pattern's matches with their places come from one pass: the pattern's matches are put between two
marks, the text is split at the first and folded with a running place. Spans of all patterns are sorted
by place and length and chosen greedily; the nearest entity before and after a trigger is found within
the row. Only the deduplication per article shuffles, with map-side combining.

Defined cases: null or blank texts give nothing; the characters U+0001 and U+0002 count as blanks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text as X
from litloom.functions import vocab

_OPEN, _SHUT = "\x01", "\x02"
_MATCHES = "array<struct<start:int,stop:int,text:string>>"
_STRIP = r"^[ ,.;:()\[\]]+|[ ,.;:()\[\]]+\z"


def find_all(s: Column, pattern: str, holds: str | None = None) -> Column:
    """[{start, stop, text}] of a pattern's matches, places counted from 0. Texts in which ``holds`` (by
    default the pattern itself) isn't found are told first and cost no more."""
    parts = F.split(F.regexp_replace(s, f"({pattern})", f"{_OPEN}$1{_SHUT}"), _OPEN)

    def step(acc: Column, part: Column) -> Column:
        k = F.instr(part, _SHUT)
        at = acc["at"]
        match = F.struct(at.alias("start"), (at + k - 1).alias("stop"), F.substring(part, F.lit(1), k - 1).alias("text"))
        return F.struct(
            (at + F.length(part) - F.when(k > 0, 1).otherwise(0)).alias("at"),
            F.when(k > 0, F.concat(acc["found"], F.array(match))).otherwise(acc["found"]).cast(_MATCHES).alias("found"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCHES).alias("found"))
    found = F.aggregate(parts, zero, step, lambda acc: acc["found"])
    return F.when(s.rlike(holds or pattern), found).otherwise(F.array().cast(_MATCHES))


def sentences(articles: DataFrame, body: Column | None = None) -> DataFrame:
    """articles with one row a sentence (sent_ord, sentence): split behind . ! ? ; before a capital or digit."""
    body = X.article_text(F.col("title"), F.col("abstract")) if body is None else body
    flat = X.collapse(F.translate(body, _OPEN + _SHUT, "  "))
    parts = F.filter(F.split(flat, r"(?<=[.!?;])\s+(?=[A-Z0-9])", -1), lambda x: F.trim(x) != "")
    return articles.select(*[c for c in articles.columns if c not in ("title", "abstract")], F.posexplode(parts).alias("sent_ord", "sentence"))


def spans(s: Column) -> Column:
    """[{start, stop, text, confidence, kind}] of a sentence's entities, disjoint and in order."""
    tagged = []
    for i, (confidence, pattern) in enumerate(vocab.SPAN_PATTERNS):

        def tag(m: Column, i: int = i, confidence: float = confidence) -> Column:
            return F.struct(m["start"].alias("start"), (m["start"] - m["stop"]).alias("size"), F.lit(i).alias("rule"), m["stop"].alias("stop"), F.regexp_replace(m["text"], _STRIP, "").alias("text"), F.lit(confidence).alias("confidence"))

        tagged.append(F.transform(find_all(s, pattern, vocab.SPAN_HOLDS[pattern]), _unary(tag)))
    found = F.filter(F.concat(*tagged), lambda x: (x["text"] != "") & ~((x["rule"] == 0) & F.upper(x["text"]).isin(*vocab.GENE_STOP_WORDS)))
    kind = "array<struct<start:int,size:int,rule:int,stop:int,text:string,confidence:double>>"
    zero = F.struct(F.lit(0).alias("last"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        free = x["start"] >= acc["last"]
        return F.struct(F.when(free, x["stop"]).otherwise(acc["last"]).alias("last"), F.when(free, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).cast(kind).alias("kept"))

    kept = F.aggregate(F.array_sort(found), zero, step, lambda acc: acc["kept"])
    typed = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["text"].alias("text"), x["confidence"].alias("confidence"), X.entity_type(x["text"]).alias("kind")))
    return F.filter(typed, lambda x: ~((x["kind"] == "OTHER") & (F.length(x["text"]) < 4)))


def _unary(f: Callable) -> Callable[[Column], Column]:
    return lambda x: f(x)


def with_spans(sents: DataFrame) -> DataFrame:
    """Behind a generator of one row, so that filters on the spans don't find them a second time."""
    return sents.select("*", F.explode(F.array(spans(F.col("sentence")))).alias("spans"))


def entities(tagged: DataFrame, key: str = "article_ord") -> DataFrame:
    """Sentences with spans -> one row an entity; repeats of a sentence's entity in an article once, the first."""
    rows = tagged.select(key, "pmid", "sent_ord", "sentence", F.posexplode("spans").alias("span_ord", "e"))
    rows = rows.select(key, "pmid", "sent_ord", "span_ord", "sentence", F.col("e.text").alias("text"), X.normalize_entity(F.col("e.text")).alias("normalized"), F.col("e.kind").alias("entity_type"), F.col("e.confidence").alias("confidence"))
    first = F.min(F.struct("sent_ord", "span_ord", "pmid", "text", "confidence"))
    out = rows.groupBy(key, "normalized", "entity_type", "sentence").agg(first.alias("f"))
    return out.select(key, "f.sent_ord", "f.span_ord", "f.text", "normalized", "entity_type", "f.pmid", "sentence", "f.confidence")


def relations(tagged: DataFrame, key: str = "article_ord", year: str = "year") -> DataFrame:
    """Sentences with spans -> relations, each once an article, with their place (sent_ord, spec_ord, match_ord)."""
    s = F.col("sentence")
    specs = []
    for i, (pattern, predicate, base, passive) in enumerate(vocab.TRIGGERS):

        def tag(m: Column, at: Column, i: int = i, predicate=predicate, base=base, passive=passive) -> Column:
            word = F.lit(predicate).cast("string") if predicate else X.verb_predicate(m["text"])
            return F.struct(F.lit(i).alias("spec_ord"), at.alias("match_ord"), m["start"].alias("start"), m["stop"].alias("stop"), word.alias("predicate"), F.lit(base).alias("base"), F.lit(passive).alias("passive"))

        specs.append(F.transform(find_all(s, rf"(?iU)\b(?:{pattern})\b"), _binary(tag)))
    rows = tagged.where(F.size("spans") >= 2).select(key, "pmid", F.col(year).alias("publication_year"), "sent_ord", "sentence", "spans", F.explode(F.concat(*specs)).alias("t"))
    rows = rows.select("*", "t.*").drop("t")
    before = F.expr("try_element_at(filter(spans, e -> e.stop <= start), -1)")
    after = F.expr("try_element_at(filter(spans, e -> e.start >= stop), 1)")
    rows = rows.withColumns({"b": before, "a": after}).where("b IS NOT NULL AND a IS NOT NULL")
    swap = F.col("passive")
    rows = rows.withColumns({"s": F.when(swap, F.col("a")).otherwise(F.col("b")), "o": F.when(swap, F.col("b")).otherwise(F.col("a"))})
    rows = rows.where(X.normalize_entity(F.col("s.text")) != X.normalize_entity(F.col("o.text")))
    rows = rows.withColumns({"certainty": X.certainty(s), "conditional": X.is_conditional(s), "negated": X.negated_before(s, F.col("start"))})
    rows = rows.withColumn("polarity", X.polarity(F.col("conditional"), F.col("certainty"), F.col("negated"), F.col("base")))
    rows = rows.select(
        key, "sent_ord", "spec_ord", "match_ord", F.col("s.text").alias("subject"), "predicate", F.col("o.text").alias("object"), "sentence", "pmid", "publication_year", "polarity", "certainty",
        X.relation_confidence(F.col("predicate"), F.col("certainty"), F.col("polarity")).alias("confidence"), F.lit("rule_based").alias("source"),
        F.col("s.kind").alias("subject_type"), F.col("o.kind").alias("object_type"),
    )
    rest = [c for c in rows.columns if c not in (key, "predicate", "sentence")]
    first = rows.groupBy(key, F.lower("subject").alias("ls"), "predicate", F.lower("object").alias("lo"), "sentence").agg(F.min(F.struct(*rest)).alias("f"))
    return first.select(key, "predicate", "sentence", "f.*").select(*rows.columns)


def _binary(f: Callable) -> Callable[[Column, Column], Column]:
    return lambda x, i: f(x, i)


def dedupe_relations(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of relations equal in subject and object (letter case aside), predicate, pmid and polarity the one of
    greatest confidence, of equal ones the first by ``order``; with ``sort_key``, the canonical order."""
    ls, lo = F.lower("subject"), F.lower("object")
    at = F.struct(*order)
    best = F.struct(F.col("confidence"), *[(-F.col(o)).alias(f"n_{o}") for o in order])
    everything = F.struct(*rows.columns)
    out = rows.groupBy(ls.alias("ls"), "predicate", lo.alias("lo"), "pmid", "polarity").agg(F.max_by(everything, best).alias("r"), F.min(at).alias("first"))
    return out.select("r.*", F.struct(F.col("r.pmid").alias("pmid"), "ls", F.col("r.predicate").alias("predicate"), "lo", "first").alias("sort_key"))


def canonical_order(deduped: DataFrame) -> DataFrame:
    """rel_ord: increasing in the canonical order; a range-partitioned sort, not dense."""
    ordered = deduped.repartitionByRange("sort_key").sortWithinPartitions("sort_key")
    return ordered.withColumn("rel_ord", F.monotonically_increasing_id()).drop("sort_key")


#: Fixed value: the confidence of a model's entities.
MODEL_CONFIDENCE = 0.88


def placed_sentences(body: Column) -> Column:
    """[{start, stop, text}] of a text's sentences; one that isn't found as it stands begins where the last one ended."""
    parts = F.filter(F.split(X.collapse(body), r"(?<=[.!?;])\s+(?=[A-Z0-9])", -1), lambda x: F.trim(x) != "")

    def step(acc: Column, s: Column) -> Column:
        at = F.call_function("locate", s, body, acc["at"] + 1) - 1
        start = F.when(at < 0, acc["at"]).otherwise(at)
        stop = start + F.length(s)
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), stop.alias("stop"), s.alias("text")))).cast(_MATCHES).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCHES).alias("found"))
    return F.aggregate(parts, zero, step, lambda acc: acc["found"])


def model_entities(articles: DataFrame, found: DataFrame, key: str = "article_ord") -> DataFrame:
    """Entities of another recogniser: found has (key, start, text), places counted in the article's text (``X.article_text``).

    Types and normal forms are the rules'; the sentence is the one that holds the place, else the whole text; repeats
    of an entity in a sentence count once, the first; articles without any get the rules' entities.
    """
    told = articles.select(key, "pmid", X.article_text(F.col("title"), F.col("abstract")).alias("body")).withColumn("placed", placed_sentences(F.col("body")))
    rows = found.where(F.trim("text") != "").select(key, "start", X.collapse_outer(F.col("text")).alias("text")).join(told, key)
    at = X.sentence_at(F.col("placed"), F.col("start"))
    rows = rows.select(key, "pmid", "start", "text", X.normalize_entity(F.col("text")).alias("normalized"), X.entity_type(F.col("text")).alias("entity_type"), F.coalesce(at, "body").alias("sentence"), F.array_position("placed.text", at).alias("p"))
    first = F.min(F.struct(F.coalesce(F.col("p") - 1, F.lit(-1)).cast("int").alias("sent_ord"), F.col("start").cast("int").alias("span_ord"), "pmid", "text"))
    out = rows.groupBy(key, "normalized", "entity_type", "sentence").agg(first.alias("f"))
    out = out.select(key, "f.sent_ord", "f.span_ord", "f.text", "normalized", "entity_type", "f.pmid", "sentence", F.lit(MODEL_CONFIDENCE).alias("confidence"))
    rest = articles.join(out.select(key).distinct(), key, "left_anti")
    return out.unionByName(entities(with_spans(sentences(rest.select(key, "pmid", "year", "title", "abstract"))), key))


def extract(articles: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """articles -> (entities, deduplicated relations). ``recognise`` may put another recogniser's spans
    in place of the rules': it gets the sentences and returns them with a column ``spans``."""
    tagged = (recognise or with_spans)(sentences(articles.select("article_ord", "pmid", "year", "title", "abstract")))
    rels = dedupe_relations(relations(tagged), ["article_ord", "sent_ord", "spec_ord", "match_ord"])
    return entities(tagged), rels


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; for keys whose groups are known to be small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
