"""Names, ranking, tokenizer and packing."""

import math
import random
import statistics

import pytest

from litloom.llm import bpe, names, packing, ranking

PEOPLE = ["Vamonwick, Oksana", "Vamonwick, Fumiko", "Kizekquist, Niamh R.", "Domirvold, Alexander", "Töllusen, Yusuf H.", "Morge, Zofia", "Dekela, William", "Rolinbeovic, Goran P.", "Limosham, Rebecca N.", "Redizasen, James"]
GROUPS = ["Vulsova Cardiac Outcomes Working Party", "Zezemu Tumour Registry Collaboration", "Dilzilok Rare Disease Working Party"]
JOURNALS = ["Birulte Annals of Comparative Tumour Genomics", "Zustigi Annals of Clinical Tumour Genomics", "Pollitur Letters in Translational Redox Biology and Medicine", "Povinfa International Journal of Translational Pharmacology and Therapeutics"]
MEANT = {
    "Oksana Vamonwick": 0, "O. Vamonwick": 0, "Vamonwick O": 0, "vamonwick, oksana": 0, "VAMONWICK, Oksana": 0, "Vamonwick,Fumiko": 1, "Vamonwcik, Fumiko": 1, "Vamonwick, Fumkio": 1, "Niamh Kizekquist": 2, "Kizekquist NR": 2,
    "Kizenquist, Niamh R.": 2, "Sasha Domirvold": 3, "Dr. Alexander Domirvold": 3, "Alexander Domirvold, MD": 3, "Tollusen, Yusuf H.": 4, "Y. H. Töllusen": 4, "Mroge, Zofia": 5, "Bill Dekela": 6, "Rolinbeovic GP": 7, "Becky Limosham": 8, "Redizasen, Jim": 9,
    "The Vulsova Cardiac Outcomes Working Party": 100, "Cardiac Outcomes Working Party, Vulsova": 100, "Vulsova Cardiac Outcomes WP": 100, "Zezemu Tumour Registry Collab.": 101, "Dilzilook Rare Disease Working Party": 102,
}
TITLES = {
    "birulte annals of comp. tumour genomics": 0, "Zustigi Ann. Clin. Tumour Genom.": 1, "Zustigi Ann Clin Tumour Genom": 1, "Zustigi Annals of Clinical Tumor Genomics": 1, "Pollitur Letters in Translational Redox Biology & Medicine": 2,
    "Translational Redox Biology and Medicine, Pollitur Letters in": 2, "Povinfa International Journal Translational Pharmacology and Therapeutics [print]": 3, "POVINFA INTERNATIONAL JOURNAL OF TRANSLATIONAL PHARMACOLOGY AND THERAPEUTICS.": 3, "The Birulte Annals of Comparative Tumour Genomics": 0,
}
NOBODY = ["Vamonwick, Yusuf", "Y. Morge", "Sikfelar, Oksana", "Domirvold, William", "", " ", "Oksana", "Group", "123"]
NO_JOURNAL = ["Zustigi Letters of Clinical Tumour Genomics", "Maruini Annals of Dental Health", "", "Annals"]


def test_links(spark):
    rows = [(i, [a, None], None, "x") for i, a in enumerate([*MEANT, *NOBODY, *PEOPLE])] + [(1000 + i, None, j, None) for i, j in enumerate([*TITLES, *NO_JOURNAL, *JOURNALS])]
    art = spark.createDataFrame(rows, "article_ord long, authors array<string>, journal string, key string")
    people = spark.createDataFrame([(i, "person", n) for i, n in enumerate(PEOPLE)] + [(100 + i, "group", n) for i, n in enumerate(GROUPS)], "author_id long, kind string, full_name string")
    journals = spark.createDataFrame([(500 + i, n) for i, n in enumerate(JOURNALS)], "journal_id long, full_title string")
    got = {(r.article_ord, r.slot): r.ref_id for r in names.found(art, people, journals).collect()}
    assert got == {**{(i, 0): m for i, m in enumerate(MEANT.values())}, **{(1000 + i, -1): 500 + m for i, m in enumerate(TITLES.values())}}
    assert names.found(art.limit(0), people, journals).count() == 0 and names.found(art, people.limit(0), journals.limit(0)).count() == 0
    twin = people.union(spark.createDataFrame([(999, "person", "Vamonwick, Olga")], people.schema))
    linked = {(r.article_ord, r.slot) for r in names.found(art, twin, journals).collect()}
    assert (1, 0) not in linked and (0, 0) in linked  # "O. Vamonwick" may now be either


def test_common_subsequence():
    random.seed(7)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(400):
        a, b = ("".join(random.choices("abcd", k=random.randrange(12))) for _ in "ab")
        assert names.lcs(a, b) == plain(a, b)


HYP = "hypothesis_id string, query string, generated_at string, evidence_score double, novelty_score double, plausibility_score double, feasibility_score double, combined_score double, b int"


def plain_scores(rows):
    latest = {}
    for r in rows:
        if r[0] is not None and (r[0] not in latest or r[2] > latest[r[0]][2]):
            latest[r[0]] = r
    out = {}
    for q in {r[1] for r in latest.values()}:
        group = [r for r in latest.values() if r[1] == q]
        logs = dict.fromkeys((r[0] for r in group), 0.0)
        for k in range(3, 7):
            v = sorted(r[k] for r in group if r[k] is not None and not math.isnan(r[k]))
            med = v[(len(v) - 1) // 2] if v else 0.0
            dev = sorted(abs(x - med) for x in v)
            scale = 0
            if v:
                mad, aad = dev[(len(dev) - 1) // 2], statistics.fmean(dev)
                scale = 1.4826 * mad if mad > 0 else 1.2533 * aad
            for r in group:
                missing = r[k] is None or math.isnan(r[k])
                z = ((v[0] if missing else r[k]) - med) / scale if v and scale else 0.0
                z -= 1.0 if missing and v else 0.0
                logs[r[0]] -= 0.25 * (-z if z < -30 else math.log1p(math.exp(-z)))
        out |= {(q, i): math.exp(x) for i, x in logs.items()}
    return out


def test_ranking(spark):
    random.seed(9)
    at = lambda k: f"2024-01-0{k}T00:00:00+00:00"
    score = lambda s: random.choice([None, float("nan"), 1e12, random.gauss(0, s), random.gauss(0, s), random.gauss(0, s), 0.5])
    rows = [(f"h{i % 90}", f"q{i % 90 % 4}" if i % 90 % 4 else None, at(1 + i // 90), score(1), score(1e6), score(1e-6), 1.0 if i % 90 % 4 == 1 else score(3), 0.0, 1) for i in range(180)]
    rows += [(None, "q1", at(5), 9.0, 9.0, 9.0, 9.0, None, 1), ("solo", "q9", at(1), None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, HYP)
    want = plain_scores(rows)
    got = {(r.query, r.hypothesis_id): r for r in ranking.ranking(df, 16).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert math.isclose(r.combined_score, want[k], rel_tol=1e-9)
        assert r.place == 1 + sum(got[x].combined_score > r.combined_score for x in want if x[0] == k[0])
    first = {r.query: r.hypothesis_id for r in ranking.found(df).collect()}
    for q, h in first.items():
        best = max(r.combined_score for k, r in got.items() if k[0] == q)
        assert h == min(k[1] for k, r in got.items() if k[0] == q and r.combined_score == best)
    assert ranking.found(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.TOKENIZER_FILE, "rb") as f:
        return bpe.Encoder(f.read())


def odd_texts():
    random.seed(11)
    fixed = ["", " ", "  ", "a  b", "a\n\n b", "a \n \n b", "　x", "x ", "\x1c a", "<|endoftext|> a", "\t\tb", "é" * 300, "a" * 2000, "don't 's", "​⁠ ก", "🎉 🎊", "x   y", "\r\n x\r\n"]
    return fixed + ["".join(random.choice(" \n\t ab1.'sกé。Z") for _ in range(random.randrange(40))) for _ in range(3000)]


def test_tokens_equal_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.TOKENIZER_FILE.replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    texts = odd_texts()
    for t, r in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(t) == r.ids, ascii(t)


def test_merges_by_scan_and_heap(encoder):
    random.seed(12)
    for _ in range(1500):
        w = bytes(random.choice(b"abcde th\xc3\xa9") for _ in range(random.randrange(1, 120)))
        assert bpe.merge_scan(w, encoder.ranks) == bpe.merge_heap(w, encoder.ranks)


def test_corpus(spark, encoder):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "Hello world", 7), (3, "Hello world", 7)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()) == [(1, []), (2, []), (3, encoder.encode("Hello world")), (3, encoder.encode("Hello world"))]
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.token_counts(df).collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_packing(spark):
    random.seed(13)
    sizes = [(i, random.choice([0, 1, 1024, 1025, 5000, random.randrange(900), None])) for i in range(3000)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long")).collect()
    by_doc, boxes = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        boxes.setdefault(r.container, []).append(r)
    assert by_doc.keys() == {i for i, _ in sizes}
    for i, n in sizes:
        parts = sorted(by_doc[i], key=lambda r: r.part)
        assert [p.part for p in parts] == list(range(len(parts))) and sum(p.part_tokens for p in parts) == (n or 0) and len(parts) == max(1, -(-(n or 0) // 1024))
    for b in boxes.values():
        used = sum(r.part_tokens for r in b)
        assert used == b[0].used <= b[0].length and b[0].length == next(x for x in packing.LENGTHS if x >= used)
    total = sum(n or 0 for _, n in sizes)
    assert total / sum(b[0].length for b in boxes.values()) > 0.98 and len(boxes) <= total / 1024 * 1.02 + 8
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
