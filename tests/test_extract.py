"""Entities and relations by rules, against the fixtures and a plain version written with Python's re."""

import random
import re

import pytest
from pyspark.sql import functions as F

from litloom.functions import vocab
from litloom.operators import extract

SCHEMA = "article_ord long, pmid string, title string, abstract string, year int"


def run(spark, texts):
    a = spark.createDataFrame([(i, str(i + 1), None, t, 2020) for i, t in enumerate(texts)], SCHEMA)
    return extract.extract(a)


CASES = [
    ("BRCA1 and TP53 are tumor suppressors.", ["BRCA1", "TP53", "tumor"], []),
    ("Breast cancer patients show elevated BRCA1 levels.", ["Breast cancer", "BRCA1"], []),
    ("The PI3K pathway is activated in triple-negative breast cancer.", ["PI3K pathway", "breast cancer"], [("PI3K pathway", "activates", "breast cancer", "positive", "certain", .879)]),
    ("BRCA1 activates TP53 in cancer cells.", ["BRCA1", "TP53", "in cancer"], [("BRCA1", "activates", "TP53", "positive", "certain", .879)]),
    ("BRCA1 did not activate TP53 in this study.", ["BRCA1", "TP53"], [("BRCA1", "activates", "TP53", "negative", "certain", .879)]),
    ("BRCA1 may activate TP53 in some contexts.", ["BRCA1", "TP53"], [("BRCA1", "activates", "TP53", "uncertain", "possible", .689)]),
    ("TP53 is activated by BRCA1.", ["TP53", "BRCA1"], [("BRCA1", "activates", "TP53", "positive", "certain", .879), ("TP53", "activates", "BRCA1", "positive", "certain", .879)]),
    ("BRCA1 significantly activates TP53.", ["BRCA1", "TP53"], [("BRCA1", "activates", "TP53", "conditional", "certain", .799)]),
    ("BRCA1 interacts with TP53.", ["BRCA1", "TP53"], [("BRCA1", "interacts with", "TP53", "positive", "certain", .767)]),
    ("BRCA1 binds to TP53.", ["BRCA1", "TP53"], [("BRCA1", "binds to", "TP53", "positive", "certain", .767)]),
    ("BRCA1 does not inhibit TP53.", ["BRCA1", "TP53"], [("BRCA1", "inhibits", "TP53", "positive", "certain", .879)]),
    ("brca1 activates tp53 in cancer cells.", ["in cancer"], []),
    # "tamoxifen" holds the conditional cue "if"
    ("Tamoxifen inhibits EGFR expression in cancer cells.", ["Tamoxifen", "in cancer"], [("Tamoxifen", "inhibits", "in cancer", "conditional", "certain", .799)]),
]


def test_fixture_sentences(spark):
    ents, rels = run(spark, [c[0] for c in CASES])
    es = {i: [] for i in range(len(CASES))}
    for r in ents.orderBy("article_ord", "sent_ord", "span_ord").collect():
        es[r.article_ord].append(r.text)
    rs = {i: [] for i in range(len(CASES))}
    for r in rels.orderBy("article_ord", "sent_ord", "spec_ord", "match_ord").collect():
        rs[r.article_ord].append((r.subject, r.predicate, r.object, r.polarity, r.certainty, r.confidence))
    for i, (_, want_e, want_r) in enumerate(CASES):
        assert es[i] == want_e
        assert rs[i] == want_r


def test_two_sentences_and_repeats(spark):
    ents, rels = run(spark, ["BRCA1 activates TP53. MDM2 inhibits CDKN1A.", None, "", "   "])
    assert ents.count() == 4 and {(r.predicate, r.polarity) for r in rels.collect()} == {("activates", "positive"), ("inhibits", "negative")}
    a = spark.createDataFrame([(0, "1", "BRCA1 activates TP53", "BRCA1 activates TP53 in cancer. BRCA1 activates TP53 in cancer.", 2020)], SCHEMA)
    ents, rels = extract.extract(a)
    assert ents.count() == 6
    row = rels.collect()
    assert len(row) == 1 and row[0].confidence == .879 and row[0].sentence.startswith("BRCA1 activates TP53 BRCA1")


def python_spans(sentence):
    found = []
    for i, (confidence, p) in enumerate(vocab.SPAN_PATTERNS):
        flags = re.I if "(?i" in p else 0
        for m in re.finditer(re.sub(r"^\(\?i?U\)", "", p), sentence, flags):
            t = m[0].strip(" ,.;:()[]")
            if t and not (i == 0 and t.upper() in vocab.GENE_STOP_WORDS):
                found.append((m.start(), m.start() - m.end(), i, m.end(), t, confidence))
    kept, last = [], 0
    for f in sorted(found):
        if f[0] >= last:
            kept.append((f[0], f[3], f[4], f[5]))
            last = f[3]
    return kept


def test_spans_against_plain_version(spark):
    random.seed(4)
    words = "TP53 BRCA1 DNA cancer breast lung disease Wnt pathway NF-κB signaling café kinase MAP-2 protein imatinib trastuzumab activates (PI3K) p53, apoptosis. in of the Ärzte syndrome 😀 tamoxifen".split()
    rows = [" ".join(random.choices(words, k=random.randrange(1, 16))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, sentence string")
    got = extract.with_spans(df).select("i", "sentence", "spans").collect()
    for r in got:
        want = [w for w in python_spans(r.sentence)]
        mine = [(s.start, s.stop, s.text, s.confidence) for s in r.spans]
        assert [w for w in want if w in mine] == mine
        assert all(len(w[2]) < 4 for w in want if w not in mine)


def test_find_all_edges(spark):
    df = spark.createDataFrame([("",), ("aa",), ("xaax",), (None,)], "s string")
    got = [r.m for r in df.select(extract.find_all(F.col("s"), "a").alias("m")).collect()]
    assert [[(m.start, m.stop) for m in x or []] for x in got] == [[], [(0, 1), (1, 2)], [(1, 2), (2, 3)], []]


def test_dedupe_and_order(spark):
    rows = [(0, "B1", "p", "C1", "9", "positive", .5), (1, "b1", "p", "c1", "9", "positive", .9), (2, "B1", "p", "C1", "9", "positive", .9), (3, "A1", "p", "C1", "1", "positive", .1)]
    r = spark.createDataFrame(rows, "rel_ord long, subject string, predicate string, object string, pmid string, polarity string, confidence double")
    out = extract.canonical_order(extract.dedupe_relations(r.withColumnRenamed("rel_ord", "o"), ["o"])).orderBy("rel_ord").collect()
    assert [x.o for x in out] == [3, 1]


@pytest.mark.parametrize("hook", [lambda s: extract.with_spans(s).withColumn("spans", F.slice("spans", 1, 1))])
def test_other_recogniser(spark, hook):
    a = spark.createDataFrame([(0, "1", None, "BRCA1 activates TP53.", 2020)], SCHEMA)
    ents, rels = extract.extract(a, hook)
    assert ents.count() == 1 and rels.count() == 0
