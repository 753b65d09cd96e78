"""Unlinked node pairs that share neighbours: scores, ranking, novelty.

Pairs come from an equi self-join on the shared neighbour, with the types of both ends checked in the
join. A hub's neighbours are cut into chunks by hash and each pair of chunks meets in a cell of its own, so
that a node linked to a third of the graph spreads its pairs over tasks; counts and sums combine map-side. Lists of shared neighbours and their
evidence are made for the ranked result only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as X
from litloom.functions import vocab
from litloom.session import cut

from . import graph, reach
from .skew import CHUNK, product

CODES = {t: i for i, t in enumerate(vocab.ENTITY_TYPES)}


def allowed_pairs(pairs=None) -> set[tuple[str, str]]:
    """Type pairs in both orders; None and an empty list mean the standard ones."""
    pairs = list(pairs or vocab.TYPE_PAIRS)
    return {*pairs, *((b, a) for a, b in pairs)}


def _types_allowed(a: Column, b: Column, pairs) -> Column:
    """For columns of type codes."""
    partners: dict[int, list[int]] = {}
    for x, y in sorted(allowed_pairs(pairs)):
        if x in CODES and y in CODES:
            partners.setdefault(CODES[x], []).append(CODES[y])
    out = F.lit(False)
    for x, ys in partners.items():
        out = out | ((a == x) & b.isin(*ys))
    return out


def numbered(und: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(id, node, kind, code, d): linked nodes with their degree, numbered in the order of their names.

    Written through a checkpoint, so that the numbers stay what they are."""
    deg = und.groupBy("node").agg(F.count("*").alias("d"))
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    n = all_nodes.select("node", F.col("entity_type").alias("kind"), F.coalesce(codes[F.col("entity_type")], F.lit(-1)).alias("code")).join(deg, "node")
    return cut(n.repartitionByRange("node").sortWithinPartitions("node").withColumn("id", F.monotonically_increasing_id()))


def shared_neighbours(und: DataFrame, all_nodes: DataFrame, pairs=None, chunk: int = CHUNK, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b, degree_a, degree_b, cn, aa, ra) of unlinked pairs of allowed types, by number, a < b.

    The pairs, by far the largest rows in number, are numbers only; ``named`` gives them their names."""
    nodes = numbered(und, all_nodes) if nodes is None else nodes
    own = nodes.select("node", F.col("id").alias("x"), "code", F.col("d").alias("dx"))
    ends = und.join(own, "node").join(nodes.select(F.col("node").alias("nbr"), F.col("id").alias("n"), F.col("d").alias("nd")), "nbr").select("n", "nd", "x", "code", "dx", F.ceil(F.col("nd") / chunk).cast("int").alias("k"))
    mine, each = F.pmod(F.xxhash64("x"), F.col("k")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = ends.select("n", "nd", F.col("x").alias("a"), F.col("code").alias("ca"), F.col("dx").alias("degree_a"), mine.alias("i"), each.alias("j"))
    right = ends.select("n", F.col("x").alias("b"), F.col("code").alias("cb"), F.col("dx").alias("degree_b"), mine.alias("j"), each.alias("i"))
    two = left.join(right, ["n", "i", "j"]).where((F.col("a") < F.col("b")) & _types_allowed(F.col("ca"), F.col("cb"), pairs))
    found = two.groupBy("a", "b").agg(
        F.min("degree_a").alias("degree_a"), F.min("degree_b").alias("degree_b"), F.count("*").alias("cn"), F.coalesce(F.sum(F.when(F.col("nd") > 1, 1 / F.log("nd"))), F.lit(0.0)).alias("aa"), F.sum(1 / F.col("nd")).alias("ra")
    )
    return found.join(ends.where("x < n").select(F.col("x").alias("a"), F.col("n").alias("b")), ["a", "b"], "left_anti")


def named(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with node_a, node_b and their types."""
    for side in "ab":
        found = found.join(nodes.select(F.col("id").alias(side), F.col("node").alias(f"node_{side}"), F.col("kind").alias(f"node_{side}_type")), side)
    return found.drop("a", "b")


def score(found: DataFrame) -> DataFrame:
    """Jaccard and the composite, with the method that gives the greatest single score."""
    j = F.col("cn") / (F.col("degree_a") + F.col("degree_b") - F.col("cn"))
    parts = {"jaccard": F.col("jaccard"), "adamic_adar": F.col("aa"), "resource_allocation": F.col("ra"), "common_neighbors": F.col("cn").cast("double")}
    total = sum((F.lit(w) * parts[m] for m, w in vocab.GAP_WEIGHTS.items()), F.lit(0.0))
    # Sums come in any order, so their last digits may differ: ties are told with some tolerance.
    top = F.greatest(*parts.values()) - 1e-9
    method = F.lit(None).cast("string")
    for m, c in reversed(parts.items()):
        method = F.when(c >= top, m).otherwise(method)
    return found.withColumn("jaccard", j).withColumns({"score": X.py_round(total, 6), "method": method})


def top_gaps(scored: DataFrame, k: int = 20) -> DataFrame:
    """The k best by score, then names (numbers follow names); a top-k, not a sort of all."""
    return scored.orderBy(F.desc("score"), "a", "b").limit(max(k, 0))


def with_evidence(top: DataFrame, und: DataFrame, edges: DataFrame, few: bool = False, pmids: bool = True) -> DataFrame:
    """top with common_neighbors (sorted), evidence_pmids and max_year of the edges at those neighbours.

    pmids: False leaves out evidence_pmids, by far the most work (every article of every neighbour of each pair).

    pmids stand in the order of neighbour, incoming before outgoing edges, first relation, place. few: top is known
    to hold a thousand rows at most, so that it may go to every task."""
    a = und.select(F.col("node").alias("node_a"), "nbr")
    b = und.select(F.col("node").alias("node_b"), "nbr")
    pair = F.broadcast(top.select("node_a", "node_b")) if few else top.select("node_a", "node_b")
    each = pair.join(a, "node_a").join(b, ["node_b", "nbr"]).select("node_a", "node_b", "nbr")
    common = each.groupBy("node_a", "node_b").agg(F.array_sort(F.collect_list("nbr")).alias("common_neighbors"))
    at = F.explode(F.array(F.struct(F.col("object").alias("nbr"), F.lit(0).alias("side")), F.struct(F.col("subject").alias("nbr"), F.lit(1).alias("side"))))
    incident = edges.select("pmids", F.array_max("years").alias("y"), "first_ord", at.alias("e")).select("pmids", "y", "first_ord", "e.*").join(each.select("nbr").distinct(), "nbr", "left_semi")
    if not pmids:
        years = each.join(incident.groupBy("nbr").agg(F.max("y").alias("y")), "nbr").groupBy("node_a", "node_b").agg(F.max("y").cast("int").alias("max_year"))
        return top.join(common, ["node_a", "node_b"], "left").join(years, ["node_a", "node_b"], "left")
    # Merged for each neighbour first: pairs share most of their neighbours. Edges without pmids give their year.
    of_nbr = incident.select("nbr", "side", "first_ord", "y", F.posexplode_outer("pmids").alias("p", "pmid"))
    if dict(edges.dtypes)["first_ord"] in ("int", "bigint"):
        # Places as one number, so that minima are kept in hash tables instead of sorts.
        place = lambda *parts: sum((x.cast("decimal(38,0)") * F.lit(str(w)).cast("decimal(38,0)") for x, w in parts), F.lit("0").cast("decimal(38,0)")).cast("decimal(38,0)")
        within = place((F.col("side"), 10**27), (F.col("first_ord"), 10**8), (F.coalesce("p", F.lit(0)), 1))
        each = common.select("node_a", "node_b", F.posexplode("common_neighbors").alias("at", "nbr"))
        at_pair = place((F.col("at"), 2 * 10**27), (F.col("o"), 1))
    else:
        within, at_pair = F.struct("side", "first_ord", "p"), F.struct("nbr", "o")
    of_nbr = of_nbr.groupBy("nbr", "pmid").agg(F.min(within).alias("o"), F.max("y").alias("y"))
    first = each.join(of_nbr, "nbr").groupBy("node_a", "node_b", "pmid").agg(F.min(at_pair).alias("o"), F.max("y").alias("y"))
    listed = F.array_sort(F.collect_list(F.when(F.col("pmid").isNotNull(), F.struct("o", "pmid"))))
    pm = first.groupBy("node_a", "node_b").agg(F.transform(listed, lambda x: x["pmid"]).alias("evidence_pmids"), F.max("y").cast("int").alias("max_year"))
    out = top.join(common, ["node_a", "node_b"], "left").join(pm, ["node_a", "node_b"], "left")
    return out.withColumn("evidence_pmids", F.coalesce("evidence_pmids", F.array().cast("array<string>")))


def novelty(pairs: DataFrame, und: DataFrame, negative: DataFrame, cutoff: int | None = None, synonyms: bool = True, sharing: bool = False) -> DataFrame:
    """pairs (node_a, node_b, n_pmids, n_common) with novelty_status, for any pair, absent nodes included.

    Distances are asked only for pairs that neither an edge nor a negative relation decides. sharing: every pair is
    known to share a neighbour in und, so that none are asked."""
    ab = [F.least("node_a", "node_b").alias("lo"), F.greatest("node_a", "node_b").alias("hi")]
    direct = und.where("node < nbr").select(F.col("node").alias("lo"), F.col("nbr").alias("hi"), F.lit(True).alias("is_direct"))
    told = negative if cutoff is None else negative.where(F.array_min("years") <= cutoff)
    told = told.select(F.least("subject", "object").alias("lo"), F.greatest("subject", "object").alias("hi")).distinct().withColumn("is_negative", F.lit(True))
    key = pairs.select("node_a", "node_b").distinct().select("*", *ab)
    key = cut(key.join(direct, ["lo", "hi"], "left").join(told, ["lo", "hi"], "left").drop("lo", "hi"))
    if sharing:
        key = key.withColumn("distance", F.lit(2))
    else:
        asked = key.where("is_direct IS NULL AND is_negative IS NULL")
        key = key.join(reach.distances(und, 3, asked), ["node_a", "node_b"], "left")
    p = pairs.join(key, ["node_a", "node_b"], "left")
    open_case = F.col("is_direct").isNull() & F.col("is_negative").isNull() & F.col("distance").isNull()
    alike = F.coalesce(X.are_synonyms(F.when(open_case, F.col("node_a")), F.when(open_case, F.col("node_b"))), F.lit(False)) if synonyms else F.lit(False)
    few = (F.col("n_pmids") < 2) & (F.col("n_common") < 2)
    status = (
        F.when(F.col("is_direct"), "KNOWN").when(F.col("is_negative"), "CONTRADICTED").when(F.col("distance") == 2, "PARTIALLY_SUPPORTED").when(F.col("distance") == 3, "INDIRECTLY_SUPPORTED")
        .when(open_case & alike, "PARTIALLY_SUPPORTED").when(few, "INSUFFICIENT_EVIDENCE").otherwise("UNEXPLORED")
    )
    return p.withColumn("novelty_status", status).drop("is_direct", "is_negative", "distance")


def pairs_at_distance(und: DataFrame, steps: int) -> DataFrame:
    """(node_a, node_b), node_a < node_b, whose shortest path has exactly 2 or 3 edges; hubs are spread over cells.

    Walks of three edges far outnumber the pairs they join, so these come from bits (``reach``)."""
    if steps not in (2, 3):
        raise ValueError("distances of 2 and 3 are supported")
    if steps == 3:
        return reach.distances(und, 3)
    one = und.select(F.col("node").alias("a"), F.col("nbr").alias("b"))
    step = und.select(F.col("node").alias("b"), F.col("nbr").alias("c"))
    two = product(one, step, "b").where("a < c").select("a", F.col("c").alias("b")).distinct().join(one, ["a", "b"], "left_anti")
    return two.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def find_gaps(rows: DataFrame, cutoff: int | None = None, top_k: int = 20, pairs=None, pmids: bool = True) -> DataFrame:
    """Ranked gap candidates from evidence rows (graph.evidence). With a cutoff, edges, degrees and
    neighbours are those of the snapshot; node types are not. pmids: False for callers without use for evidence_pmids."""
    edges = graph.merge_edges(rows.where("layer = 'biological'"))
    if cutoff is not None:
        edges = graph.snapshot(edges, cutoff)
    # Read by many branches below: made once, and safe against the loss of an executor.
    edges = cut(edges)
    und = cut(graph.undirected(edges))
    nodes = numbered(und, graph.nodes(rows))
    top = cut(named(top_gaps(score(shared_neighbours(und, nodes, pairs, nodes=nodes)), top_k), nodes))
    full = cut(with_evidence(top, und, edges, few=top_k <= 1000, pmids=pmids))
    # Gaps share a neighbour, so novelty never asks how many pmids there are.
    full = full.withColumns({"n_pmids": F.size("evidence_pmids") if pmids else F.lit(None).cast("int"), "n_common": F.size("common_neighbors")})
    out = novelty(full, und, graph.negative_edges(rows), cutoff, sharing=True)
    return out.select("node_a", "node_b", "node_a_type", "node_b_type", "score", "method", "common_neighbors", "novelty_status", *["evidence_pmids"] * pmids, "max_year")
