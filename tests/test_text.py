"""Scalar functions on the fixtures' values and on odd ones."""

import difflib
import unicodedata

import pytest
from pyspark.sql import functions as F

from litloom.functions import text as X
from litloom.functions import vocab


def values(spark, expr, rows, schema="x string"):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i long, " + schema)
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_normalize_text(spark):
    rows = ["  Hello   World  ", "", "café", "café", None, "A\x1cB C", "ÉTÉ", " \t\n"]
    assert values(spark, X.normalize_text(F.col("x")), rows) == ["hello world", "", "café", "café", "", "a b c", "été", ""]


def test_truncate(spark):
    assert values(spark, X.truncate(F.col("x"), 5), ["hello world", "hi", "", None, "a😀bcdef"]) == ["hello…", "hi", "", "", "a😀bcd…"]


def test_checks(spark):
    assert values(spark, X.is_pmid(F.col("x")), ["12345678", "1", "", "abc", "123456789", None, "12\n", " 1"]) == [True, True, False, False, False, False, False, False]
    assert values(spark, X.valid_year(F.col("x"), F.lit(2026)), ["2020", "2015", None, "abc", "1800", "2100", "2027", ""]) == [2020, 2015, None, None, None, None, 2027, None]


def test_slug_and_html(spark):
    assert values(spark, X.slugify(F.col("x")), ["Hello World!", "BRCA1 gene", "Éa--b ", None, "β"]) == ["hello_world", "brca1_gene", "ea_b", "", ""]
    assert values(spark, X.escape_html(F.col("x")), ["<a & 'b' \"c\">", None]) == ["&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;", ""]


def test_normalize_entity(spark):
    assert values(spark, X.normalize_entity(F.col("x")), ["TP53", "BRCA1s", "apoptosis", "NF-κB", "ＴＰ５３", "gas", None]) == ["tp53", "brca1", "apoptosi", "nf-κb", "tp53", "gas", ""]


def test_entity_type(spark):
    rows = ["TP53", "EGFR", "cancer", "in cancer", "tamoxifen", "imatinib", "PI3K", "Wnt pathway", "apoptosis", "MAP kinase", "DNA", "foo", "", "PI3K disease"]
    want = ["GENE", "GENE", "DISEASE", "DISEASE", "CHEMICAL", "CHEMICAL", "PATHWAY", "PATHWAY", "BIOLOGICAL_PROCESS", "PROTEIN", "OTHER", "OTHER", "OTHER", "PATHWAY"]
    assert values(spark, X.entity_type(F.col("x")), rows) == want


def test_confidence_grid(spark):
    rows = [(p, c, q) for p in ("activates", "binds", "requires", "associated_with") for c, q in (("certain", "positive"), ("probable", "uncertain"), ("possible", "uncertain"), ("speculative", "uncertain"), ("certain", "conditional"), ("speculative", "conditional"))]
    got = values(spark, X.relation_confidence(F.col("p"), F.col("c"), F.col("q")), rows, "p string, c string, q string")
    assert got == [.879, .749, .689, .629, .799, .599, .818, .688, .628, .568, .738, .538, .767, .637, .577, .517, .687, .487, .737, .607, .547, .487, .657, .457]


def test_cues(spark):
    rows = ["This is known.", "It may be.", "We speculate so.", "Results suggest it.", "Significant."]
    assert values(spark, X.certainty(F.col("x")), rows) == ["certain", "possible", "speculative", "probable", "certain"]
    assert values(spark, X.is_conditional(F.col("x")), rows) == [False, False, False, False, True]
    assert values(spark, X.negated_before(F.col("x"), F.lit(12)), ["well known. X", "plain text.. X"]) == [True, False]


def test_predicates_and_phrases(spark):
    assert values(spark, X.verb_predicate(F.col("x")), ["Activated", "bound", "binds to", "suppressing", "interacted"]) == ["activates", "binds", "binds to", "suppresses", "interacts_with"]
    assert values(spark, X.graph_predicate(F.col("x")), ["Interacts  With", None]) == ["interacts_with", ""]
    lists = [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],), (["a", "b", "c", "d"],), ([" "],)]
    want = ["shared pathway", "a", "a and b", "a, b, c", "a, b, c, and related intermediates", "shared pathway"]
    assert values(spark, X.neighbour_phrase(F.col("x")), lists, "x array<string>") == want
    assert values(spark, X.as_list(F.col("x")), ["a, b,,c ", "", None]) == [["a", "b", "c"], [], []]
    assert values(spark, X.year_in_text(F.col("x")), ["in 2019", "1850 then 1999", "none", None]) == [2019, 1999, None, None]


def test_ids_buckets_rounding(spark):
    rows = [("brca1", "breast cancer", "BRCA1"), ("tamoxifen", "brca1", "BRCA1"), ("brca1", "breast cancer", "test")]
    assert values(spark, X.hypothesis_id(F.col("a"), F.col("b"), F.col("q")), rows, "a string, b string, q string") == ["5a3f9cbeca93", "efe9918984f9", "d7be7270a5f0"]
    assert values(spark, X.score_bucket(F.col("x")), [.7, .4, .39], "x double") == ["HIGH", "MODERATE", "LOW"]
    assert values(spark, X.score_bar(F.col("x")), [.25, 2.0, -1.0], "x double") == ["██░░░░░░░░", "█" * 10, "░" * 10]
    xs = [2.6754, 0.00051, 1.00049, 0.12345650000000001, 1e-7, -3.14159, 0.1 + 0.2]
    assert values(spark, X.py_round(F.col("x"), 3), xs, "x double") == [round(x, 3) for x in xs]


def test_synonyms_match_the_library(spark):
    rows = [("brca1", "BRCA-1"), ("xyz", "abc"), ("", "a"), (None, None), ("interleukin", "interleukins")]
    want = []
    for a, b in rows:
        a, b = ("".join(c for c in (v or "").lower() if c.isascii() and c.isalnum()) for v in (a, b))
        want.append(bool(a and b) and difflib.SequenceMatcher(None, a, b).ratio() >= .8)
    assert values(spark, X.are_synonyms(F.col("a"), F.col("b")), rows, "a string, b string") == want


def test_evidence_line_and_year(spark):
    rows = [("a", "b", "binds", "1", .695), ("", None, None, "", None)]
    got = values(spark, X.evidence_line(*[F.col(c) for c in "stkpc"]), rows, "s string, t string, k string, p string, c double")
    assert got == ["- a -> b [binds] PMID:1 (0.69)", "- ? -> ? [related_to] PMID:n/a"]
    got = values(spark, X.article_year(F.col("a"), None, F.col("b"), F.col("d")), [(0, None, "2001-02"), (None, 1999, None), (None, None, "x")], "a int, b int, d string")
    assert got == [2001, 1999, None]


def test_vocabulary():
    forms = vocab.inflections()
    assert forms["activating"] == "activates" and forms["suppresses"] == "suppresses" and forms["requiring"] == "requires" and "targeted" in forms
    assert unicodedata.is_normalized("NFC", "".join(vocab.KNOWN_GENES)) and len(vocab.SPAN_PATTERNS) == 17 and len(vocab.TRIGGERS) == 9


@pytest.mark.parametrize("answer", ["```json\n{\"a\": 1}\n```", "{\"a\": 1}", "```\n{\"a\": 1}```"])
def test_fence(spark, answer):
    assert values(spark, X.strip_fence(F.col("x")), [answer]) == ['{"a": 1}']


def test_lookups(spark):
    df = spark.createDataFrame([(None, "b", [(0, 5, "one"), (5, 9, "two")], [("1", "s", "in 2019"), ("1", "s", "2019"), (None, None, None)])], "x string, y string, s array<struct<start:int,stop:int,text:string>>, e array<struct<pmid:string,sentence:string,year:string>>")
    r = df.select(X.first_present(df, "nope", "x", "y").alias("f"), X.sentence_at(F.col("s"), F.lit(5)).alias("t"), X.sentence_at(F.col("s"), F.lit(9)).alias("n"), X.evidence_items(F.col("e")).alias("e")).first()
    assert (r.f, r.t, r.n) == ("b", "two", None) and [tuple(x) for x in r.e] == [("1", "s", 2019), ("", "", None)]
