"""Scalar text functions and predicates as Spark columns.

White space and letter case are Unicode's. Only values beyond ASCII are normalised in Python, as Spark
has no normal forms; all else is JVM-side. Null text counts as empty unless a function says otherwise.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

_WHITE = r"(?U)[\s\x1c-\x1f]+"


def _form(name: str):
    @F.pandas_udf(T.StringType())
    def normal_form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(name, x))

    return normal_form


_FORMS = {name: _form(name) for name in ("NFC", "NFKC", "NFKD")}


def is_ascii(x: Column) -> Column:
    return ~x.rlike(r"[^\x00-\x7F]")


def normal_form(x: Column, name: str) -> Column:
    return F.when(is_ascii(x), x).otherwise(_FORMS[name](F.when(~is_ascii(x), x)))


def text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def collapse(x: Column) -> Column:
    """Single inner and no outer white space."""
    return F.trim(F.regexp_replace(x, _WHITE, " "))


def normalize_text(x: Column) -> Column:
    return collapse(F.lower(normal_form(text(x), "NFC")))


def truncate(x: Column, size: int = 80, suffix: str = "…") -> Column:
    return F.when(F.length(text(x)) <= size, text(x)).otherwise(F.concat(F.substring(x, 1, size), F.lit(suffix)))


def slugify(x: Column) -> Column:
    """Accents dropped, other characters beyond ASCII too; runs of the rest become one underscore."""
    plain = F.regexp_replace(normal_form(text(x), "NFKD"), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_"), F.lit("_"))


def is_pmid(x: Column) -> Column:
    r"""One to eight decimal digits, of any script."""
    return F.coalesce(x.rlike(r"^\p{Nd}{1,8}\z"), F.lit(False))


def valid_year(x: Column, this_year: Column | None = None) -> Column:
    """An integer from 1900 to next year, else null. The clock is a parameter."""
    year = x.try_cast("int")
    limit = (F.year(F.current_timestamp()) if this_year is None else this_year) + 1
    return F.when(year.between(1900, limit), year)


def year_in_text(x: Column) -> Column:
    """First year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(text(x), r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")


def escape_html(x: Column) -> Column:
    out = text(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def evidence_line(source: Column, target: Column, kind: Column, pmid: Column, confidence: Column) -> Column:
    def or_else(x: Column, other: str) -> Column:
        return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(other))

    score = F.when(confidence.isNotNull(), F.concat(F.lit(" ("), F.call_function("format_number", confidence.cast("double"), F.lit("0.00")), F.lit(")"))).otherwise("")
    return F.concat(F.lit("- "), or_else(source, "?"), F.lit(" -> "), or_else(target, "?"), F.lit(" ["), or_else(kind, "related_to"), F.lit("] PMID:"), or_else(pmid, "n/a"), score)


def article_text(title: Column, abstract: Column) -> Column:
    parts = [F.nullif(F.regexp_replace(text(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""), F.lit("")) for x in (title, abstract)]
    return F.concat_ws(" ", *parts)


def article_year(publication_year: Column | None = None, pub_year: Column | None = None, year: Column | None = None, pub_date: Column | None = None) -> Column:
    """The first given year that isn't zero, else the leading four digits of the date."""
    years = [F.nullif(x.cast("int"), F.lit(0)) for x in (publication_year, pub_year, year) if x is not None]
    if pub_date is not None:
        years.append(F.nullif(F.regexp_extract(text(pub_date.cast("string")), r"^(\d{4})", 1), F.lit("")).cast("int"))
    return F.coalesce(*years) if years else F.lit(None).cast("int")


def py_round(x: Column, digits: int) -> Column:
    """Rounding half to even, on the shortest decimal form of the value: it agrees with rounding of the exact
    binary value but for values whose shortest form ends in a 5 just behind the last digit kept."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")


# --- cues -----------------------------------------------------------------------------------------


def contains_any(x: Column, cues) -> Column:
    """Plain substrings, not words."""
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(c)) for c in cues])


def negated_before(sentence: Column, start: Column) -> Column:
    """A negation cue within the 40 characters before ``start`` (counted from 0)."""
    window = F.lower(F.substring(sentence, F.greatest(F.lit(1), start - 39), F.least(start, F.lit(40))))
    return contains_any(window, vocab.NEGATION_CUES)


def certainty(sentence: Column) -> Column:
    s = F.lower(sentence)
    return (
        F.when(contains_any(s, vocab.SPECULATIVE_CUES), "speculative").when(contains_any(s, vocab.POSSIBLE_CUES), "possible").when(contains_any(s, vocab.PROBABLE_CUES), "probable").otherwise("certain")
    )


def is_conditional(sentence: Column) -> Column:
    return contains_any(F.lower(sentence), vocab.CONDITIONAL_CUES)


def polarity(conditional: Column, how_certain: Column, negated: Column, base: Column) -> Column:
    flipped = F.when(base == "negative", "positive").otherwise("negative")
    return F.when(conditional, "conditional").when(how_certain != "certain", "uncertain").when(negated, flipped).otherwise(base)


def relation_confidence(predicate: Column, how_certain: Column, which_polarity: Column) -> Column:
    """The score takes a few values only: a literal map, rounded as the exact binary value is."""
    bases = {**vocab.CONFIDENCE_BASE, "": vocab.CONFIDENCE_OTHER}
    cells: list[Column] = []
    for b in sorted(set(bases.values())):
        for c, pc in {**vocab.CERTAINTY_PENALTY, "?": 0.1}.items():
            for p, pp in {**vocab.POLARITY_PENALTY, "": 0.0}.items():
                cells += [F.lit(f"{b}/{c}/{p}"), F.lit(max(0.0, min(1.0, round(b - (pc + pp) + 0.02 * b**0.5, 3))))]
    base = F.lit(str(vocab.CONFIDENCE_OTHER))
    for value in sorted(set(vocab.CONFIDENCE_BASE.values())):
        base = F.when(predicate.isin([k for k, v in vocab.CONFIDENCE_BASE.items() if v == value]), F.lit(str(value))).otherwise(base)
    c = F.when(how_certain.isin(*vocab.CERTAINTY_PENALTY), how_certain).otherwise("?")
    p = F.when(which_polarity.isin(*vocab.POLARITY_PENALTY), which_polarity).otherwise("")
    return F.create_map(*cells)[F.concat_ws("/", base, c, p)]


def verb_predicate(token: Column) -> Column:
    """The predicate of a matched verb form; other forms stay, in lower case."""
    m = F.create_map(*[F.lit(x) for kv in vocab.inflections().items() for x in kv])
    return F.coalesce(m[F.lower(token)], F.lower(token))


def graph_predicate(x: Column) -> Column:
    return F.regexp_replace(collapse(F.lower(text(x))), " ", "_")


def node_key(x: Column) -> Column:
    return collapse(F.lower(text(x)))


def normalize_entity(x: Column) -> Column:
    s = F.lower(collapse(normal_form(text(x), "NFKC")))
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s\-κ]+", ""), _WHITE, " ")
    return F.when(s.endswith("s") & (F.length(s) > 3), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)


def entity_type(x: Column) -> Column:
    s = collapse_outer(x)

    def any_of(patterns) -> Column:
        return reduce(lambda a, b: a | b, [s.rlike(p) for p in patterns])

    gene = F.upper(s).isin(*vocab.KNOWN_GENES) | (s.rlike(rf"^(?:{vocab.GENE})\z") & ~F.upper(s).isin(*vocab.GENE_STOP_WORDS))
    return (
        F.when(s == "", "OTHER").when(any_of(vocab.PATHWAYS), "PATHWAY").when(any_of(vocab.DISEASES), "DISEASE").when(any_of(vocab.CHEMICALS), "CHEMICAL")
        .when(s.rlike(vocab.PROCESS), "BIOLOGICAL_PROCESS").when(s.rlike(vocab.PROTEIN), "PROTEIN").when(gene, "GENE").otherwise("OTHER")
    )


def canonical_type(x: Column) -> Column:
    kind = F.upper(F.trim(F.coalesce(F.nullif(x, F.lit("")), F.lit("UNKNOWN"))))
    out = F.lower(kind)
    for group, members in vocab.TYPE_GROUPS.items():
        out = F.when(kind.isin(*members), group).otherwise(out)
    return out


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> bool:
        x, y = (re.sub(r"[^a-z0-9]+", "", (v or "").lower()) for v in (x, y))
        return bool(x and y) and difflib.SequenceMatcher(None, x, y).ratio() >= 0.8

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def are_synonyms(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of at least 0.8. Apply to the few pairs that need it."""
    return _alike(a, b)


def neighbour_phrase(names: Column) -> Column:
    a = F.filter(names, lambda x: F.trim(x) != "")
    n = F.size(a)
    first = F.array_join(F.slice(a, 1, 3), ", ")
    return F.when(n <= 0, "shared pathway").when(n == 1, F.try_element_at(a, F.lit(1))).when(n == 2, F.array_join(a, " and ")).when(n == 3, first).otherwise(F.concat(first, F.lit(", and related intermediates")))


def as_list(x: Column) -> Column:
    """A comma-separated text as an array without blanks."""
    return F.filter(F.transform(F.split(text(x), ","), collapse_outer), lambda v: v != "")


def collapse_outer(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def hypothesis_id(a: Column, b: Column, query: Column) -> Column:
    return F.substring(F.md5(F.concat(text(a), F.lit(":"), text(b), F.lit(":"), text(query))), 1, 12)


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.7, "HIGH").when(score >= 0.4, "MODERATE").otherwise("LOW")


def score_bar(score: Column, cells: int = 10) -> Column:
    full = F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) * cells).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full))


def strip_fence(x: Column) -> Column:
    """A model's answer without its code fence."""
    return F.regexp_replace(F.regexp_replace(collapse_outer(text(x)), r"(?i)^```(?:json)?\s*", ""), r"\s*```\z", "")


def first_present(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """The first non-null value among those of the named columns that df has."""
    there = {c.lower() for c in df.columns}
    cols = [df[n] for n in names if n.lower() in there]
    return F.coalesce(*cols, F.lit(None) if default is None else default)


def sentence_at(sentences: Column, place: Column) -> Column:
    """Of [{start, stop, text}] the text of the one that holds the place."""
    return F.try_element_at(F.filter(sentences, lambda s: (s["start"] <= place) & (place < s["stop"])), F.lit(1))["text"]


def evidence_items(items: Column) -> Column:
    """[{pmid, sentence, year as text}] with years resolved, each item once, in order."""
    return F.array_distinct(F.transform(items, lambda e: F.struct(text(e["pmid"]).alias("pmid"), text(e["sentence"]).alias("sentence"), year_in_text(e["year"].cast("string")).alias("year"))))
