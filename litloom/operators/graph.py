"""The evidence graph as tables: edges by layer, nodes, negative edges, snapshots and statistics.

All aggregates combine map-side. Ordered lists hold an edge's distinct values only (first place of each
value found by a combined minimum before it is listed), so a hot edge's rows are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as X
from litloom.functions import vocab
from litloom.session import cut

from .skew import join_hot

EDGE = ["layer", "subject", "object"]


def evidence(relations: DataFrame, order: str = "rel_ord") -> DataFrame:
    """Relations as graph rows: node keys, predicate, layer; blank ends and self-loops dropped.

    Layers: negative polarity -> negative; else biological or semantic by the predicate."""
    kind = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("OTHER"))
    rows = relations.select(
        F.col(order).alias("ord"), X.node_key(F.col("subject")).alias("subject"), X.node_key(F.col("object")).alias("object"), F.col("subject").alias("subject_label"), F.col("object").alias("object_label"),
        kind("subject_type").alias("subject_type"), kind("object_type").alias("object_type"), X.graph_predicate(F.col("predicate")).alias("predicate"), X.text(F.col("pmid").cast("string")).alias("pmid"),
        F.col("publication_year").cast("int").alias("year"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(F.nullif("polarity", F.lit("")), F.lit("positive")).alias("polarity"),
    )
    rows = rows.where("subject <> '' AND object <> '' AND subject <> object")
    layer = F.when(F.col("polarity") == "negative", "negative").when(F.col("predicate").isin(*vocab.BIOLOGICAL_PREDICATES), "biological").otherwise("semantic")
    return rows.withColumn("layer", layer)


def temporal_rows(rows: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Rows of the temporal layer: biological, not negative; with a cutoff those of a year up to it."""
    out = rows.where("layer = 'biological'")
    return (out if cutoff is None else out.where(F.col("year") <= cutoff)).withColumn("layer", F.lit("temporal"))


def _listed(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Distinct non-blank values of each key in the order of their first row."""
    first = rows.where(F.col(value) != "").groupBy(*keys, value).agg(F.min("ord").alias("o"))
    return _in_order(first, keys, value, name)


def _in_order(first: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def merge_edges(rows: DataFrame, digits: int = 6) -> DataFrame:
    """One row an edge (layer, subject, object) with its merged evidence, weight included. ord may be of any type with an order."""
    return edges_of(*edge_parts(rows), digits)


def edge_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What edges are merged from, in a form that can be stored and merged with later parts: a row a predicate of an
    edge (n, o, c, ys) and a row an article of an edge (o)."""
    rows = rows.where("layer <> 'negative'")
    counts = rows.groupBy(*EDGE, "predicate").agg(F.count("*").alias("n"), F.min("ord").alias("o"), F.sum("confidence").alias("c"), F.collect_set("year").alias("ys"))
    return counts, rows.where("pmid <> ''").groupBy(*EDGE, "pmid").agg(F.min("ord").alias("o"))


def merge_parts(counts: DataFrame, pmids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of several builds, put one behind the other, as those of one."""
    counts = counts.groupBy(*EDGE, "predicate").agg(F.sum("n").alias("n"), F.min("o").alias("o"), F.sum("c").alias("c"), F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"))
    return counts, pmids.groupBy(*EDGE, "pmid").agg(F.min("o").alias("o"))


def edges_of(counts: DataFrame, pmids: DataFrame, digits: int = 6) -> DataFrame:
    """Edges of their parts."""
    merged = counts.groupBy(*EDGE).agg(
        F.min_by("predicate", F.struct((-F.col("n")).alias("n"), "o")).alias("predicate"),
        F.transform(F.array_sort(F.collect_list(F.struct("o", "predicate"))), lambda x: x["predicate"]).alias("predicates"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "n")))).alias("predicate_counts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ys")))).alias("years"),
        X.py_round(F.sum("c") / F.sum("n"), digits).alias("confidence"), F.sum("n").alias("n_relations"), F.min("o").alias("first_ord"),
    )
    out = merged.join(_in_order(pmids, EDGE, "pmid", "pmids"), EDGE, "left").withColumn("pmids", F.coalesce("pmids", F.array().cast("array<string>")))
    return out.withColumns({"weight": edge_weight(F.col("pmids"), F.col("confidence"), digits), "polarity": F.lit("positive"), "is_negated": F.lit(False)})


def edge_weight(pmids: Column, confidence: Column, digits: int = 6) -> Column:
    return X.py_round(F.log(1 + F.size(F.array_distinct(pmids))) * confidence, digits)


def negative_edges(rows: DataFrame) -> DataFrame:
    """(subject, object) of negative relations: distinct pmids, sorted years, first predicate, mean confidence, and the
    confidences as sorted values with the number of relations of each (a pair's relations may be any number, their
    values are few); ``negative_confidences`` has them a row each."""
    rows = rows.where("layer = 'negative'")
    keys = ["subject", "object"]
    values = rows.groupBy(*keys, "confidence").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("confidence", "n"))).alias("confidences"))
    out = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set("year")).alias("years"), F.count("*").alias("n_relations"), F.avg("confidence").alias("mean_confidence"), F.min_by("predicate", "ord").alias("predicate"), F.min("ord").alias("first_ord")
    )
    return out.join(values, keys).join(_listed(rows, keys, "pmid", "pmids"), keys, "left").withColumn("pmids", F.coalesce("pmids", F.array().cast("array<string>")))


def negative_confidences(rows: DataFrame) -> DataFrame:
    """(subject, object, ord, confidence): the list of a negative edge's confidences as rows, in the order of ord."""
    return rows.where("layer = 'negative'").select("subject", "object", "ord", "confidence")


def nodes(rows: DataFrame) -> DataFrame:
    """(node, label, entity_type): the first label, and the first type other than OTHER; ends of negative
    relations are nodes too."""
    ends = rows.select(F.explode(F.array(
        F.struct(F.col("subject").alias("node"), F.col("subject_label").alias("label"), F.col("subject_type").alias("kind"), F.struct("ord", F.lit(0).alias("side")).alias("o")),
        F.struct(F.col("object").alias("node"), F.col("object_label").alias("label"), F.col("object_type").alias("kind"), F.struct("ord", F.lit(1).alias("side")).alias("o")),
    )).alias("e")).select("e.*")
    typed = F.when(F.col("kind") != "OTHER", F.struct("o", "kind"))
    out = ends.groupBy("node").agg(F.min_by("label", "o").alias("label"), F.min(typed).alias("t"))
    return out.select("node", "label", F.coalesce("t.kind", F.lit("OTHER")).alias("entity_type"))


def snapshot(edges: DataFrame, cutoff: int) -> DataFrame:
    """Biological edges all of whose years are up to the cutoff; those without years are left out."""
    return edges.where((F.col("layer") == "biological") & (F.size("years") > 0) & (F.array_max("years") <= cutoff))


def combined(edges: DataFrame) -> DataFrame:
    """Both layers as one graph: where an edge is in both, the semantic one's attributes count."""
    rest = [c for c in edges.columns if c not in EDGE]
    best = F.max_by(F.struct("layer", *rest), F.when(F.col("layer") == "semantic", 1).otherwise(0)).alias("e")
    return edges.where(F.col("layer").isin("biological", "semantic")).groupBy("subject", "object").agg(best).select("subject", "object", "e.*")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (node, nbr) in both directions."""
    both = F.explode(F.array(F.struct(F.col("subject").alias("node"), F.col("object").alias("nbr")), F.struct(F.col("object").alias("node"), F.col("subject").alias("nbr"))))
    return edges.select(both.alias("e")).select("e.node", "e.nbr").distinct()


def degrees(all_nodes: DataFrame, und: DataFrame) -> DataFrame:
    d = und.groupBy("node").agg(F.count("*").alias("degree"))
    return all_nodes.select("node").join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def top_nodes(deg: DataFrame, k: int = 10) -> DataFrame:
    return deg.orderBy(F.desc("degree"), "node").limit(k)


def components(all_nodes: DataFrame, und: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the least node name of each connected component.

    Alternating large-star and small-star steps: stars are joined to ever lesser centres, so the number
    of rounds is logarithmic in the size of a component, not its diameter. Each round's edges are cut
    off by a reliable checkpoint; the rounds end when the edges no longer change, and raise if they
    still do after ``rounds``. The centre of a large star is a hot key, so it is joined as one (skew).
    """
    e = cut(und.where("node > nbr").select(F.col("node").alias("u"), F.col("nbr").alias("v")))
    print_of = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    state = print_of(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
        large = join_hot(both.where("v > u"), least, ["u"], "d", total=2 * state["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = join_hot(large, least, ["u"], "d", total=2 * state["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        after = print_of(e)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return all_nodes.select("node").join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def statistics(rows: DataFrame) -> DataFrame:
    """One row of figures of the combined graph; its parts are single-row aggregates."""
    edges = rows.where("layer <> 'negative'").select(*EDGE).distinct()
    all_nodes = nodes(rows)
    und = undirected(edges)
    deg = degrees(all_nodes, und)
    by_layer = edges.agg(F.count_if(F.col("layer") == "biological").alias("n_biological_edges"), F.count_if(F.col("layer") == "semantic").alias("n_semantic_edges"))
    negative = rows.where("layer = 'negative'").select("subject", "object").distinct().agg(F.count("*").alias("negative_edge_count"))
    per_node = deg.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"), F.count_if(F.col("degree") == 0).alias("isolated_nodes_count"))
    comps = components(all_nodes, und).agg(F.count_distinct("component").alias("connected_components"))
    parts = per_node.unionByName(by_layer, True).unionByName(negative, True).unionByName(comps, True)  # four rows
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    n = F.col("n_nodes")
    return one.select(
        "n_nodes", (F.col("n_biological_edges") + F.col("n_semantic_edges")).alias("n_edges"), "n_biological_edges", "n_semantic_edges",
        F.when(n > 1, F.col("ends") / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, F.col("ends") / n).otherwise(0.0).alias("avg_degree"),
        "isolated_nodes_count", "connected_components", "negative_edge_count",
        F.to_json(F.struct(F.col("n_biological_edges"), F.col("n_nodes"), F.col("n_semantic_edges"))).alias("summary_json"),
    )


def repeated_values(edges: DataFrame) -> DataFrame:
    """Edges with repeats removed from their lists and the predicate reset to the first, and how many
    were removed (none for edges merged here)."""
    n = sum((F.size(c) - F.size(F.array_distinct(c)) for c in ("pmids", "years", "predicates")), F.lit(0))
    out = edges.withColumn("n_removed", n).withColumns({c: F.array_distinct(c) for c in ("pmids", "years", "predicates")})
    return out.withColumn("predicate", F.coalesce(F.try_element_at("predicates", F.lit(1)), F.col("predicate")))


def add_relations(parts: tuple[DataFrame, DataFrame], new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored edge parts with the evidence rows of a further batch counted in; the earlier rows aren't read again.

    The batch's ord must lie behind that of all earlier rows if "first" is to mean the first delivered."""
    counts, pmids = edge_parts(new)
    return merge_parts(parts[0].unionByName(counts), parts[1].unionByName(pmids))
