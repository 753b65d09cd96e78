"""Ranking: no single score outvotes the others. Look-alikes: further alphabets."""

from __future__ import annotations

import random

from litloom.llm import lookalikes, pairs, ranking

HYP = "hypothesis_id string, query string, generated_at string, evidence_score double, novelty_score double, plausibility_score double, feasibility_score double"


def test_one_tight_score_does_not_outvote_three(spark):
    r = random.Random(2)
    rows = [(f"h{i:02d}", "q", "2024-01-01T00:00:00+00:00", *(r.gauss(0, 1) for _ in range(3)), r.gauss(0, .01)) for i in range(60)]
    rows.append(("three", "q", "2024-01-01T00:00:00+00:00", 3.0, 3.0, 3.0, -4.0))  # far off in one score only
    rows.append(("none", "q", "2024-01-01T00:00:00+00:00", -2.2, -2.2, -2.2, -.022))  # low in all
    got = {x.hypothesis_id: x.combined_score for x in ranking.ranking(spark.createDataFrame(rows, HYP)).collect()}
    assert got["three"] > got["none"] > 0


def test_further_alphabets():
    assert [lookalikes.normalise(x) for x in ("ᏴᎡᏟᎪ", "𝐁𝐑𝐂𝐀𝟏", "𝛼-helix")] == ["BRCA", "BRCA1", "α-helix"]


def test_frequent_item_and_huge_basket(spark):
    rows = [("k", str(b), x) for b in range(1, 400) for x in ("all", f"i{b % 7}")] + [("k", "1000", f"i{j}") for j in range(300)]
    items = spark.createDataFrame(rows, "field string, basket string, item string")
    want: dict[tuple[str, str], int] = {}
    by: dict[str, set[str]] = {}
    for _, b, x in rows:
        by.setdefault(b, set()).add(x)
    for xs in by.values():
        for a in xs:
            for b in xs:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    for least in (1, 5):
        got = {(r.item_a, r.item_b): r.n_ab for r in pairs.pair_counts(items, least, 16).collect()}
        assert got == {k: n for k, n in want.items() if n >= least}
