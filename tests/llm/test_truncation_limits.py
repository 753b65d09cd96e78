"""Truncation: the length hazards decide which incomplete endings count."""

from __future__ import annotations

import random

from litloom.llm import truncation

WORDS = "kinase levels rose in treated cells and stayed high after washing of both groups".split()


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def corpus(limit: int, quoted: int = 12):
    """Texts of one source cut at ``limit``, some of them behind a quotation or in a number; others whole."""
    r = random.Random(7)
    rows = []
    for i in range(400):
        t = " ".join(sentence(r, r.randint(5, 14)) for _ in range(r.randint(2, 12)))
        rows.append((i, "s", t if len(t) <= limit else t[:limit].rstrip() + "x" * (limit - len(t[:limit].rstrip()))))
    for k in range(quoted):
        end = ' noted "The effect is clear. It lasts."' if k % 2 else " and median follow-up came to 16."
        body = sentence(r, 40)[:-1]
        rows.append((1000 + k, "s", ("Then " + (body * 9))[: limit - len(end)] + end))
    return rows


def test_hazards_decide(spark):
    """Doubtful endings count at a significant length and nowhere else; without the test of hazards none does."""
    df = spark.createDataFrame([(*r, "abstract") for r in corpus(300)] + [(*r[:1], "free", r[2], "abstract") for r in [(2000 + i, "free", "We said so " * i + 'and noted "It is clear. It lasts."') for i in range(1, 30)]], "doc_id long, source string, text string, doc_kind string")
    rows = {r.doc_id: r for r in truncation.cut_documents(df).collect()}
    assert {rows[1000 + k].cut for k in range(12)} == {"limit"}
    assert {rows[1000 + k].how for k in range(12)} == {truncation.DOUBTFUL}
    assert {rows[2000 + i].cut for i in range(1, 30)} == {None}
    without = {r.doc_id for r in truncation.cut_documents(df, alpha=0.0).where("cut IS NOT NULL").collect()}
    assert without.isdisjoint(range(1000, 1012)) and {r.doc_id for r in truncation.found(df).collect()} - without >= set(range(1000, 1012))


def test_one_unit_explains(spark):
    """A limit in characters gives no limits in bytes, though the bytes of its texts pile up too."""
    r = random.Random(3)
    rows = [("s", 500, 500 + r.randint(0, 3)) for i in range(200)] + [("s", n, n + r.randint(0, 3)) for n in range(40, 900, 3)]
    got = truncation.significant_lengths(spark.createDataFrame(rows, "source string, chars int, bytes int")).collect()
    assert {(x.unit, x["size"]) for x in got} == {("chars", 500)}


def test_far_openings_and_marks():
    long = "The report (which " + "was read by the panel and then again by the board " * 20 + "and kept."
    assert truncation.ending(long) == truncation.OPEN  # the bracket is still open, however far back
    assert truncation.ending("It rose by 54. ...") == truncation.OPEN and truncation.ending("It rose by 54.") == truncation.DOUBTFUL
    assert truncation.ending("剂量为43. ...") == truncation.OPEN and truncation.ending("It ended in 2023.") == truncation.CLOSED
    assert truncation.ending('He noted "It is so."') == truncation.DOUBTFUL and truncation.ending('"It is so."') == truncation.CLOSED and truncation.ending('Done. "It is so."') == truncation.CLOSED
