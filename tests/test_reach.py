import itertools
import random

from pyspark.sql import functions as F

from litloom.operators import analysis, gaps, graph, reach
from litloom.plans import registry
from litloom.sources import sinks


def _graph(seed, n, m):
    rng = random.Random(seed)
    links = {tuple(rng.sample([f"n{i}" for i in range(n)], 2)) for _ in range(m)} | {("hub", f"n{i}") for i in range(0, n, 3)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist = {}
    for a in near:
        dist[a], front = {a: 0}, [a]
        while front:
            front = [y for x in front for y in near[x] if y not in dist[a] and not dist[a].update({y: dist[a][x] + 1})]
    return links, dist


def test_distances_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(reach, "CHUNK", 3)
    monkeypatch.setattr(reach, "PIECE", 256)
    links, dist = _graph(4, 300, 130)
    und = graph.undirected(spark.createDataFrame(sorted(links), "subject string, object string"))
    want = {(a, b) for a in dist for b, d in dist[a].items() if d == 3 and a < b}
    assert want and sorted(map(tuple, reach.distances(und, 3, cell_bits=64).collect())) == sorted(want)
    names = [*random.Random(5).sample(sorted(dist), 60), "absent"]
    pairs = spark.createDataFrame([*itertools.product(names, names), ("n0", "n0"), (None, "n0")], "node_a string, node_b string").distinct()
    want = {(a, b, 2 if a == b else dist[a][b]) for a in names for b in names if b in dist.get(a, ()) and dist[a][b] <= 3} | {("n0", "n0", 2)}
    got = reach.distances(und, 3, pairs, cell_bits=64).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    none = und.limit(0)
    assert reach.distances(none, 3).count() == 0 and reach.distances(none, 3, pairs).count() == 0 and reach.distances(und, 3, pairs.limit(0)).count() == 0


def test_more_than_64_cells(spark):
    """Cells beyond one word of 64: 5,000 nodes in chains of five."""
    und = graph.undirected(spark.range(5000).where("id % 5 < 4").select(F.format_string("n%05d", "id").alias("subject"), F.format_string("n%05d", F.col("id") + 1).alias("object")))
    got = reach.distances(und, 3, cell_bits=64)
    assert {tuple(r) for r in got.collect()} == {(f"n{i:05d}", f"n{i + 3:05d}") for i in range(5000) if i % 5 < 2}


def test_three_hops_of_dense_layers(spark, monkeypatch):
    """Four layers, each node linked to all of the next: 8 billion walks between 90,000 pairs, none of them a row."""
    monkeypatch.setattr(gaps, "product", None)
    n = 300
    x = spark.range(n).select(F.col("id").alias("i")).crossJoin(spark.range(n).select(F.col("id").alias("j")))
    layers = [x.select(F.concat(F.lit(a), F.format_string("%03d", "i")).alias("subject"), F.concat(F.lit(b), F.format_string("%03d", "j")).alias("object")) for a, b in ("pq", "qr", "rs")]
    und = graph.undirected(layers[0].unionByName(layers[1]).unionByName(layers[2]))
    got = gaps.pairs_at_distance(und, 3)
    assert got.where("left(node_a, 1) = 'p' AND left(node_b, 1) = 's'").count() == got.count() == n * n


def test_novelty_of_many_pairs_of_hubs(spark, monkeypatch):
    """Pairs of hubs that an edge or a negative relation decides are not walked from, and others by bits only."""
    asked = []
    real = reach.distances
    monkeypatch.setattr(gaps.reach, "distances", lambda und, steps, pairs: asked.append(pairs.count()) or real(und, steps, pairs))
    links = [("h1", f"x{i}") for i in range(50)] + [("h2", f"y{i}") for i in range(50)] + [("x0", "y0"), ("h1", "z"), ("z", "h3"), ("h1", "h4")]
    und = graph.undirected(spark.createDataFrame(links, "subject string, object string"))
    told = spark.createDataFrame([("x1", "h2", [2000]), ("h1", "x1", [2000])], "subject string, object string, years array<int>")
    rows = [("h1", "h2"), ("h2", "h1"), ("h1", "h3"), ("h1", "h4"), ("h2", "x1"), ("h1", "x1"), ("x3", "y3"), ("h1", "gone"), ("z", "z"), (None, "h1")]
    pairs = spark.createDataFrame([(*r, 0, 0) for r in rows], "node_a string, node_b string, n_pmids int, n_common int")
    got = {(r.node_a, r.node_b): r.novelty_status for r in gaps.novelty(pairs, und, told, synonyms=False).collect()}
    i, p, no = "INDIRECTLY_SUPPORTED", "PARTIALLY_SUPPORTED", "INSUFFICIENT_EVIDENCE"
    assert got == dict(zip(rows, (i, i, p, "KNOWN", "CONTRADICTED", "KNOWN", no, no, p, no)))
    assert asked == [7]


def test_gap_filter_lists_no_pmids(spark, monkeypatch, tmp_path):
    """The 200 gaps of gap_filter are told apart without the lists of articles that its result doesn't have."""
    ends = [*((f"p{i}", "PATHWAY", f"g{j}", "GENE") for i in range(3) for j in range(4)), *((f"p{i}", "PATHWAY", f"d{j}", "DISEASE") for i in range(3) for j in range(5))]
    rows = [(i, a, b, ta, tb, "activates", str(i), 2000 + i % 7, 0.9, "positive") for i, (a, ta, b, tb) in enumerate(ends)] + [(99, "g0", "d0", "GENE", "DISEASE", "activates", "99", 2001, 0.9, "negative")]
    spark.createDataFrame(rows, "rel_ord long, subject string, object string, subject_type string, object_type string, predicate string, pmid string, publication_year int, confidence double, polarity string").write.parquet(f"{tmp_path}/relations.parquet")
    full = gaps.find_gaps(graph.evidence(spark.read.parquet(f"{tmp_path}/relations.parquet")), top_k=200)
    want = sinks.gap_table(analysis.sort_gaps(analysis.filter_gaps(full, ("CONTRADICTED", "PARTIALLY_SUPPORTED"), 0.7, ("DISEASE",)), "Novelty")).collect()
    real = gaps.with_evidence

    def slim(*args, **kw):
        out = real(*args, **kw)
        assert "evidence_pmids" not in out.columns
        return out

    monkeypatch.setattr(gaps, "with_evidence", slim)
    got = registry.gap_filter(spark, str(tmp_path)).collect()
    assert got == want and len(got) >= 20 and sum(x.novelty_status == "CONTRADICTED" for x in got) == 1 and all(x.max_year for x in got)
