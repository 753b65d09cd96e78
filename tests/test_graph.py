"""Graph, gap and hypothesis operators on the fixtures and against plain Python on random graphs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from litloom.functions import text as X
from litloom.operators import analysis, gaps, graph, hypotheses

REL = "rel_ord long, subject string, predicate string, object string, pmid string, publication_year int, polarity string, confidence double, subject_type string, object_type string, sentence string, certainty string, source string"
G1 = [
    ("BRCA1", "activates", "TP53", "100", 2018, "positive", .90, "GENE", "GENE"), ("TP53", "inhibits", "MDM2", "101", 2019, "negative", .85, "GENE", "GENE"),
    ("BRCA1", "associated_with", "breast cancer", "102", 2020, "positive", .88, "GENE", "DISEASE"), ("MDM2", "targets", "CDKN1A", "103", 2021, "positive", .82, "GENE", "GENE"),
    ("EGFR", "activates", "MAPK pathway", "104", 2022, "positive", .87, "GENE", "PATHWAY"),
]


def relations(spark, rows):
    return spark.createDataFrame([(i, *r, f"s{i}", "certain", "rule_based") for i, r in enumerate(rows)], REL)


def rel(s, o, pmid="1", year=2000, pol="positive", conf=.8, pred="activates", st="GENE", ot="GENE"):
    return (s, pred, o, pmid, year, pol, conf, st, ot)


def test_fixture_graph(spark):
    ev = graph.evidence(relations(spark, G1))
    s = graph.statistics(ev).first()
    assert (s.n_nodes, s.n_edges, s.n_biological_edges, s.n_semantic_edges, s.isolated_nodes_count, s.connected_components, s.negative_edge_count) == (7, 4, 4, 0, 0, 3, 1)
    assert math.isclose(s.density, 8 / 42) and math.isclose(s.avg_degree, 8 / 7)
    w = {(r.subject, r.object): r.weight for r in graph.merge_edges(ev).collect()}
    assert w == {("brca1", "tp53"): .623832, ("brca1", "breast cancer"): .609970, ("mdm2", "cdkn1a"): .568381, ("egfr", "mapk pathway"): .603038}
    g = gaps.find_gaps(ev).collect()
    assert len(g) == 1
    r = g[0]
    assert (r.node_a, r.node_b, r.score, r.method, r.novelty_status, r.evidence_pmids, r.max_year, r.common_neighbors) == ("breast cancer", "tp53", 1.010674, "adamic_adar", "PARTIALLY_SUPPORTED", ["100", "102"], 2020, ["brca1"])
    assert gaps.find_gaps(ev, 2019).count() == 0 and gaps.find_gaps(ev, 2020).count() == 1 and gaps.find_gaps(ev, top_k=0).count() == 0
    top = [(r.node, r.degree) for r in graph.top_nodes(graph.degrees(graph.nodes(ev), graph.undirected(ev.where("layer <> 'negative'")))).collect()]
    assert top[0] == ("brca1", 2) and [t[0] for t in top[1:]] == sorted(t[0] for t in top[1:])


def test_edge_merge(spark):
    rows = [rel("A1", "B1", "100", 2018, conf=.9), rel("a1 ", "B1", "200", 2019, conf=.85), rel("A1", "B1", "100", None, pred="targets", conf=.875), rel("", "B1"), rel("x1", "X1"), rel(None, "B1"), rel("A1", "B1", None, pred="co occurs")]
    e = {r.layer: r for r in graph.merge_edges(graph.evidence(relations(spark, rows))).collect()}
    b = e["biological"]
    assert (b.pmids, b.years, b.predicate, b.predicates, b.confidence, b.predicate_counts) == (["100", "200"], [2018, 2019], "activates", ["activates", "targets"], .875, {"activates": 2, "targets": 1})
    assert b.weight == round(math.log(3) * .875, 6)
    assert e["semantic"].pmids == [] and e["semantic"].weight == 0.0
    c = graph.combined(graph.merge_edges(graph.evidence(relations(spark, rows)))).collect()
    assert len(c) == 1 and c[0].layer == "semantic"
    assert graph.repeated_values(graph.merge_edges(graph.evidence(relations(spark, rows)))).agg(F.sum("n_removed")).first()[0] == 0


def test_layers_and_years(spark):
    ev = graph.evidence(relations(spark, [rel("A1", "B1", "1", 2018), rel("A1", "B1", "2", 2022)]))
    assert [r.years for r in graph.merge_edges(graph.temporal_rows(ev, 2020)).collect()] == [[2018]]
    assert graph.snapshot(graph.merge_edges(ev), 2020).count() == 0


def test_types_and_empty(spark):
    ev = graph.evidence(relations(spark, [rel("A1", "B1", st="OTHER"), rel("A1", "C1", pol="negative", st="GENE"), rel("D1", "A1", st=None, ot="DISEASE")]))
    assert {r.node: r.entity_type for r in graph.nodes(ev).collect()} == {"a1": "GENE", "b1": "GENE", "c1": "GENE", "d1": "OTHER"}
    none = graph.evidence(relations(spark, [rel("A1", "B1")]).limit(0))
    s = graph.statistics(none).first()
    assert (s.n_nodes, s.n_edges, s.density, s.avg_degree, s.connected_components, s.negative_edge_count) == (0, 0, 0.0, 0.0, 0, 0)
    assert gaps.find_gaps(none).count() == 0 and graph.merge_edges(none).count() == 0 and graph.negative_edges(none).count() == 0


def test_novelty(spark):
    def status(rows, a, b, n_pmids=0, n_common=0, cutoff=None):
        ev = graph.evidence(relations(spark, rows))
        und = graph.undirected(ev.where("layer = 'biological'"))
        p = spark.createDataFrame([(a, b, n_pmids, n_common)], "node_a string, node_b string, n_pmids int, n_common int")
        return gaps.novelty(p, und, graph.negative_edges(ev), cutoff).first().novelty_status

    assert status(G1, "tp53", "brca1") == "KNOWN"
    assert status(G1, "brca1", "egfr") == "INSUFFICIENT_EVIDENCE"
    assert status(G1, "mdm2", "tp53") == "CONTRADICTED"
    assert status(G1, "brca1", "egfr", 2, 0) == "UNEXPLORED"
    chain = [rel("A1", "B1"), rel("B1", "C1"), rel("C1", "D1")]
    assert status(chain, "a1", "c1") == "PARTIALLY_SUPPORTED" and status(chain, "a1", "d1") == "INDIRECTLY_SUPPORTED"
    assert status(chain, "interleukin", "interleukins") == "PARTIALLY_SUPPORTED"
    neg = [*chain, rel("A1", "C1", year=2020, pol="negative")]
    assert status(neg, "a1", "c1") == "CONTRADICTED" and status(neg, "a1", "c1", cutoff=2018) == "PARTIALLY_SUPPORTED"


def test_gaps_against_plain_version(spark):
    random.seed(8)
    names = [f"N{i}" for i in range(24)]
    kinds = {n: random.choice(["GENE", "DISEASE", "CHEMICAL", "PATHWAY", "OTHER"]) for n in names}
    links = {(random.choice(names[:4]), n) for n in names for _ in range(2)} | {tuple(random.sample(names, 2)) for _ in range(25)}
    rows = [rel(a, b, str(i), st=kinds[a], ot=kinds[b]) for i, (a, b) in enumerate(sorted(links)) if a != b]
    ev = graph.evidence(relations(spark, rows))
    und = graph.undirected(ev)
    numbers = gaps.numbered(und, graph.nodes(ev))
    got = {(r.node_a, r.node_b): (r.cn, round(r.aa, 9), round(r.ra, 9), round(r.jaccard, 9), r.score, r.method) for r in gaps.named(gaps.score(gaps.shared_neighbours(und, graph.nodes(ev), chunk=5, nodes=numbers)), numbers).collect()}
    nb = {}
    for a, _, b, *_ in rows:
        nb.setdefault(a.lower(), set()).add(b.lower())
        nb.setdefault(b.lower(), set()).add(a.lower())
    want = {}
    for a, b in itertools.combinations(sorted(nb), 2):
        common = nb[a] & nb[b]
        if b in nb[a] or not common or (kinds[a.upper()], kinds[b.upper()]) not in gaps.allowed_pairs():
            continue
        m = {"jaccard": len(common) / len(nb[a] | nb[b]), "adamic_adar": sum(1 / math.log(len(nb[c])) for c in common if len(nb[c]) > 1), "resource_allocation": sum(1 / len(nb[c]) for c in common), "common_neighbors": float(len(common))}
        s = round(.35 * m["jaccard"] + .25 * m["adamic_adar"] + .2 * m["resource_allocation"] + .2 * m["common_neighbors"], 6)
        top = max(round(x, 10) for x in m.values())
        want[a, b] = (len(common), round(m["adamic_adar"], 9), round(m["resource_allocation"], 9), round(m["jaccard"], 9), s, next(k for k in m if round(m[k], 10) == top))
    assert got == want
    # distances and components by breadth-first search
    dist = {}
    for a in nb:
        seen, front = {a: 0}, [a]
        while front:
            front = [y for x in front for y in nb[x] if y not in seen and not seen.update({y: seen[x] + 1})]
        dist[a] = seen
    for k in (2, 3):
        assert {(r.node_a, r.node_b) for r in gaps.pairs_at_distance(und, k).collect()} == {(a, b) for a in nb for b in dist[a] if a < b and dist[a][b] == k}
    comp = {r.node: r.component for r in graph.components(graph.nodes(ev), und).collect()}
    assert comp == {a: min(dist[a]) for a in nb}


def test_components_of_long_chains(spark):
    rows = [rel(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)] + [rel(f"b{i:03d}", f"b{i + 1:03d}") for i in range(3)]
    ev = graph.evidence(relations(spark, rows))
    got = {r.component for r in graph.components(graph.nodes(ev), graph.undirected(ev)).collect()}
    assert got == {"a000", "b000"}


CANDS = "node_a string, node_b string, node_a_type string, node_b_type string, score double, common_neighbors array<string>, novelty_status string"


def test_hypotheses(spark):
    c = spark.createDataFrame([("brca1", "breast cancer", "GENE", "DISEASE", .85, ["tp53"], "X"), ("tamoxifen", "brca1", "CHEMICAL", "GENE", .72, ["egfr"], "X")], CANDS)
    h = hypotheses.run(c, relations(spark, G1), "BRCA1").collect()
    assert [(r.hypothesis_id, r.novelty_status, r.evidence_score, r.plausibility_score, r.feasibility_score, round(r.final_score, 9), r.confidence) for r in h] == [
        ("5a3f9cbeca93", "UNEXPLORED", 0.0, .4, .8, .48, .4667), ("efe9918984f9", "UNEXPLORED", 0.0, .4, .5, .45, .4667)
    ]
    assert hypotheses.run(c, relations(spark, G1), top_k=0).count() == 0


def test_evidence_join_of_named_ends(spark):
    c = spark.createDataFrame([("brca1", "breast cancer", "GENE", "DISEASE", .85, ["tp53"], "X")], CANDS)
    rows = [("brca1", "tp53", "1", "s1", 2020), ("tp53", "breast cancer", "2", "no association seen", 2019), ("tp53", "mdm2", "3", "x", 2000), ("BRCA1", "TP53", "4", "x", 2000), ("brca1", "tp53", "1", "s1", 2020)]
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "rel_ord long, src string, dst string, pmid string, sentence string, publication_year int")
    h = hypotheses.run(c, r, "q", source="src", target="dst").first()
    assert [(e.pmid, e.sentence, e.year) for e in h.supporting_evidence] == [("1", "s1", 2020)] and [(e.pmid, e.year) for e in h.contradicting_evidence] == [("2", 2019)]
    assert (h.novelty_status, round(h.evidence_score, 9), round(h.plausibility_score, 9), round(h.final_score, 9), h.confidence) == ("CONTRADICTED", .4, .4, .35, .3)


@pytest.mark.parametrize(("n", "pmids", "against", "want"), [(2, 2, 0, .52), (1, 1, 0, .46), (1, 1, 2, .34), (0, 0, 0, 0.0), (0, 0, 9, 0.0)])
def test_evidence_score(spark, n, pmids, against, want):
    sup = [(str(i % max(pmids, 1)), "s", 1) for i in range(n)]
    df = spark.createDataFrame([(sup, [("1", "s", 1)] * against)], "s array<struct<pmid:string,sentence:string,year:int>>, c array<struct<pmid:string,sentence:string,year:int>>")
    assert math.isclose(df.select(hypotheses.evidence_score(F.col("s"), F.col("c"))).first()[0], want, abs_tol=1e-9)


def test_model_answers(spark):
    c = spark.createDataFrame([("brca1", "breast cancer", "GENE", "DISEASE", .85, ["tp53"], "X"), ("a", "b", "GENE", "GENE", .7, ["c"], "X")], CANDS)
    say = F.when(F.col("node_a") == "brca1", F.lit('```json\n{"hypothesis": "H", "novelty_status": "known", "suggested_experiment": "patient cohort"}\n```')).otherwise("no json")
    h = {r.node_a: r for r in hypotheses.run(c, relations(spark, G1), "q", generator=lambda df: df.withColumn("answer", say)).collect()}
    assert (h["brca1"].hypothesis, h["brca1"].novelty_score, h["brca1"].feasibility_score, h["brca1"].method) == ("H", 0.0, .4, "llm")
    assert h["a"].method == "rule_based" and h["a"].hypothesis.startswith("a and b")


def test_analysis(spark):
    r = relations(spark, [rel("TP53", "MDM2", year=None), rel("TP53", "X9", year=2010, conf=.2), rel("A1", "B1", year=1990, pol="negative")])
    assert analysis.filter_evidence(r, " tp53 ").count() == 2 and analysis.filter_evidence(r, years=(2000, 2020)).count() == 2
    assert analysis.filter_evidence(r, polarities=("negative",)).count() == 1 and analysis.filter_evidence(r, min_confidence=.5).count() == 2 and analysis.filter_evidence(r).count() == 3
    assert [x.rel_ord for x in analysis.by_confidence(r).collect()] == [0, 2, 1]
    y = spark.createDataFrame([(2001,), (None,), (1999,), (0,)], "year int")
    assert analysis.years_covered(y).first()[0] == "1999–2001" and analysis.years_covered(y.where("year = 2001")).first()[0] == "2001" and analysis.years_covered(y.limit(0)).first()[0] == "N/A"
    assert analysis.middle_year(r).first()[0] == 2010
    g = spark.createDataFrame([("b", "a", "GENE", "DISEASE", .9, "KNOWN"), ("A", "z", "GENE", "GENE", .5, "unexplored")], "node_a string, node_b string, node_a_type string, node_b_type string, score double, novelty_status string")
    assert [x.node_a for x in analysis.sort_gaps(g, "Novelty").collect()] == ["A", "b"] and [x.node_a for x in analysis.sort_gaps(g).collect()] == ["b", "A"] and [x.node_a for x in analysis.sort_gaps(g, "Alphabetical").collect()] == ["A", "b"]
    assert analysis.filter_gaps(g, ("UNEXPLORED",)).count() == 1 and analysis.filter_gaps(g, min_score=.7, types=("DISEASE",)).count() == 1


def test_intended_ends_meet_nodes(spark):
    ev = relations(spark, G1)
    c = spark.createDataFrame([("tp53", "breast cancer", "GENE", "DISEASE", .9, ["brca1"], "X")], CANDS)
    h = hypotheses.generate(c, ev, source=X.node_key(F.col("subject")), target=X.node_key(F.col("object"))).first()
    assert [e.pmid for e in h.supporting_evidence] == ["100", "102"] and h.novelty_status == "INDIRECTLY_SUPPORTED"
