"""Sorts over whole tables give every row its place."""

import random

from litloom.operators import analysis
from litloom.plans import registry


def test_places(spark):
    random.seed(3)
    rows = [(f"h{k}", random.choice([None, 0.0, .5, .25, .75])) for k in range(500)]
    h = spark.createDataFrame(rows, "hypothesis_id string, confidence double").repartition(7)
    want = sorted(rows, key=lambda r: (-(r[1] or 0.0), r[0]))
    got = analysis.places(analysis.sort_hypotheses(h, "confidence"))
    assert sorted(tuple(r) for r in got.select("place", "hypothesis_id", "confidence").collect()) == [(i, *r) for i, r in enumerate(want, 1)]
    assert analysis.places(analysis.sort_hypotheses(h.limit(0), "confidence")).count() == 0


def test_every_hypothesis_has_a_place(spark, tmp_path):
    rows = [(f"h{k:02}", k / 100) for k in range(25)]
    spark.createDataFrame(rows, "hypothesis_id string, confidence double").write.parquet(str(tmp_path / "hypotheses.parquet"))
    got = registry.queries()["hypothesis_places"](spark, str(tmp_path))
    assert sorted((r.place, r.hypothesis_id) for r in got.collect()) == [(25 - k, f"h{k:02}") for k in reversed(range(25))]


def test_every_relation_has_a_place(spark, tmp_path):
    rows = [(k, None if k == 3 else k % 5 / 5) for k in range(25)]
    spark.createDataFrame(rows, "rel_ord long, confidence double").write.parquet(str(tmp_path / "relations.parquet"))
    want = sorted(rows, key=lambda r: (-(r[1] or 0.0), r[0]))
    got = registry.queries()["evidence_places"](spark, str(tmp_path))
    assert sorted((r.place, r.rel_ord, r.confidence) for r in got.collect()) == [(i, *r) for i, r in enumerate(want, 1)]
