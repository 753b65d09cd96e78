"""Incremental edges, streams, sessions, sources with limits, a model's entities and retries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from litloom import session
from litloom.functions import text as X
from litloom.operators import extract, gaps, graph, hypotheses
from litloom.plans.pipeline import Pipeline
from litloom.sources import articles as sources
from litloom.sources import sinks
from litloom.streaming import ingest
from tests.test_graph import G1, rel, relations

TOLD: list[tuple[int, int]] = []


def fake_get(url, timeout):
    from tests.test_sources import fake_get as get

    return get(url, timeout)


def note(done, total):
    with open("/tmp/litloom-progress-test.txt", "a") as f:
        f.write(f"{done}/{total} ")


def test_batches_make_the_same_edges(spark):
    rows = [rel(f"A{i % 5}", f"B{i % 7}", year=2000 + i % 9, conf=.5 + i % 4 / 10, pmid=str(i % 11)) if i % 6 else rel("A1", "B1", pred="binds", pmid=str(i)) for i in range(60)]
    ev = graph.evidence(relations(spark, rows))
    parts = graph.edge_parts(ev.where("ord < 10"))
    for lo, hi in ((10, 40), (40, 60), (60, 70)):
        parts = graph.add_relations(parts, ev.where(f"ord >= {lo} AND ord < {hi}"))
    key = ["layer", "subject", "object"]
    cols = [*key, "predicate", "predicates", "predicate_counts", "years", "pmids", "confidence", "weight", "n_relations", "first_ord"]
    plain = lambda df: sorted(str(r) for r in df.select(cols).collect())
    assert plain(graph.edges_of(*parts)) == plain(graph.merge_edges(ev))


def test_stream_equals_one_build_in_all_columns(spark, tmp_path):
    a = sources.sample_articles(spark)
    for i, part in enumerate(("article_ord IN (3, 4)", "article_ord IN (0, 3)", "article_ord IN (1, 2, 4)")):
        ingest.process(a.where(part), i, str(tmp_path / "out"))
    ingest.process(a.where("article_ord IN (0, 3)"), 1, str(tmp_path / "out"))  # run again after a failure
    _, rels = extract.extract(Pipeline(a, preserve_case=True).corpus)
    want = graph.merge_edges(graph.evidence(rels, "sort_key"))
    cols = [c for c in want.columns if c != "first_ord"]
    got = ingest.edges(spark, str(tmp_path / "out"))
    assert sorted(str(r) for r in got.select(cols).collect()) == sorted(str(r) for r in want.select(cols).collect()) and got.count() > 3
    with pytest.raises(Exception, match="(?i)parquet|cannot"):  # a broken store isn't taken for an empty one
        (tmp_path / "bad/articles/batch=0").mkdir(parents=True)
        (tmp_path / "bad/articles/batch=0/part-0.parquet").write_text("no parquet")
        ingest.process(a, 1, str(tmp_path / "bad"))


def test_service_asks_one_after_another_and_tells(spark, tmp_path):
    sources.register(spark)
    out = "/tmp/litloom-progress-test.txt"
    open(out, "w").close()
    df = spark.read.format("litloom_articles").options(query="q", batchSize="1", transport="tests.test_sources:fake_get", progress="tests.test_round_two:note", interval="0").load()
    assert df.rdd.getNumPartitions() == 1 and df.count() == 4 and open(out).read().split()[-2:] == ["1/2", "2/2"]


def test_model_is_asked_again_only_if_too_often():
    pauses, calls = [], []

    def ask(fail, message):
        def f(p):
            calls.append(p)
            if len(calls) <= fail:
                raise RuntimeError(message)
            return "ok"

        return f

    assert hypotheses.patient(ask(2, "Error 429"), sleep=pauses.append)("p") == "ok" and pauses == [1.0, 2.0]
    for message, n in (("quota", 3), ("broken", 1)):
        calls.clear()
        with pytest.raises(RuntimeError):
            hypotheses.patient(ask(9, message), sleep=pauses.append)("p")
        assert len(calls) == n


def test_model_answers_by_row(spark):
    c = spark.createDataFrame([("brca1", "tp53", "GENE", "GENE", .85, ["x"], "X"), ("a", "b", "GENE", "GENE", .7, ["c"], "X")], "node_a string, node_b string, node_a_type string, node_b_type string, score double, common_neighbors array<string>, novelty_status string")

    def ask(p):
        if "brca1" in p:
            return '{"hypothesis": "H"}'
        raise RuntimeError("down")

    h = {r.node_a: (r.hypothesis, r.method) for r in hypotheses.run(c, relations(spark, G1), "q", generator=hypotheses.asking(ask)).collect()}
    assert h["brca1"] == ("H", "llm") and h["a"][1] == "rule_based"


def test_model_entities(spark):
    a = spark.createDataFrame([(1, "11", 2020, "BRCA1 rose.", "It fell. MDM2 stayed low."), (2, "12", 2020, "TP53 binds MDM2.", None), (3, "13", 2020, None, None)], "article_ord long, pmid string, year int, title string, abstract string")
    found = spark.createDataFrame([(1, 0, "BRCA1 "), (1, 21, "MDM2"), (1, 22, "mdm2"), (1, 999, "far"), (1, 3, " ")], "article_ord long, start int, text string")
    got = {(r.article_ord, r.text, r.entity_type, r.sentence, r.confidence) for r in extract.model_entities(a, found).collect()}
    assert got == {
        (1, "BRCA1", "GENE", "BRCA1 rose.", .88), (1, "MDM2", "GENE", "MDM2 stayed low.", .88), (1, "mdm2", "OTHER", "MDM2 stayed low.", .88), (1, "far", "OTHER", "BRCA1 rose. It fell. MDM2 stayed low.", .88),
        (2, "TP53", "GENE", "TP53 binds MDM2.", .82), (2, "MDM2", "GENE", "TP53 binds MDM2.", .82),
    }


def test_types_of_padded_strings(spark):
    df = spark.createDataFrame([(" TP53 ",), ("TP53\n",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(X.entity_type(F.col("x"))).collect()][:3] == ["GENE", "GENE", "OTHER"]


def test_columns_are_bounded(spark):
    assert len(sinks.as_columns(spark.range(5))["id"]) == 5
    with pytest.raises(ValueError, match="more than 4"):
        sinks.as_columns(spark.range(5), most=4)


def test_cache_sees_changed_files(spark, tmp_path):
    made = []

    @sinks.cached(str(tmp_path / "cache"))
    def total(spark, df):
        made.append(1)
        return df.groupBy().sum("id")

    for n in (3, 3, 5):
        if n != 3 or not made:
            spark.range(n).write.mode("overwrite").parquet(str(tmp_path / "t"))
        assert total(spark, spark.read.parquet(str(tmp_path / "t"))).first()[0] == n * (n - 1) // 2
    assert len(made) == 2


def test_cluster_needs_a_shared_folder(monkeypatch):
    class Defined:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(Defined)})

        @staticmethod
        def getConf():
            return {}

    with pytest.raises(RuntimeError, match="share"):
        session.checkpoint_folder(type("Spark", (), {"sparkContext": Context}))


def test_components_say_if_they_dont_end(spark):
    ev = graph.evidence(relations(spark, [rel(f"a{i:03d}", f"a{i + 1:03d}") for i in range(40)]))
    with pytest.raises(RuntimeError, match="rounds"):
        graph.components(graph.nodes(ev), graph.undirected(ev), rounds=1)


def test_hub_of_a_third_of_the_graph_is_spread(spark):
    """Distances and components with a node linked to a third of the graph, against plain searches."""
    links = {("hub", f"n{i:03d}") for i in range(100)} | {(f"n{i:03d}", f"m{i:03d}") for i in range(0, 100, 3)} | {(f"m{i:03d}", f"z{i:03d}") for i in range(0, 60, 3)} | {(f"x{i}", f"x{i + 1}") for i in range(8)}
    und = graph.undirected(spark.createDataFrame(sorted(links), "subject string, object string"))
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def ring(a, k):
        seen, edge = {a}, {a}
        for _ in range(k):
            edge = {y for x in edge for y in near[x]} - seen
            seen |= edge
        return edge

    for k in (2, 3):
        want = {(a, b) for a in near for b in ring(a, k) if a < b}
        assert {tuple(r) for r in gaps.pairs_at_distance(und, k).collect()} == want
    nodes = spark.createDataFrame([(x,) for x in near], "node string")
    assert {r.component for r in graph.components(nodes, und).collect()} == {"hub", "x0"}
