"""Writers: JSON, CSV, GraphML, node-link JSON, columns, and a cache of results as parquet.

Documents of a graph are written as ordered lines over several part files that, one after another,
make up the document; no graph is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litloom.functions import text as X

GAP_COLUMNS = ("entity_a", "entity_b", "entity_a_type", "entity_b_type", "score", "novelty_status", "method", "common_neighbors", "max_year")
ARTICLE_COLUMNS = ("pmid", "title", "abstract", "year", "journal", "authors")


def write_json(df: DataFrame, path: str, sets: tuple[str, ...] = ()) -> None:
    """JSON lines; columns that are sets come out sorted and distinct."""
    for c in sets:
        df = df.withColumn(c, F.array_sort(F.array_distinct(c)))
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def gap_table(gaps: DataFrame) -> DataFrame:
    """Gaps as the nine columns of the export, the status in capitals."""
    return gaps.select(
        F.col("node_a").alias("entity_a"), F.col("node_b").alias("entity_b"), F.col("node_a_type").alias("entity_a_type"), F.col("node_b_type").alias("entity_b_type"), "score",
        F.upper("novelty_status").alias("novelty_status"), "method", F.array_join("common_neighbors", "; ").alias("common_neighbors"), "max_year",
    )


def write_gaps_csv(gaps: DataFrame, path: str) -> None:
    gap_table(gaps).write.mode("overwrite").option("header", "true").csv(path)


def as_columns(df: DataFrame, most: int = 100_000) -> dict[str, list]:
    """A small result as column -> values; an empty one has no columns, one of more than ``most`` rows is refused."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them with a sink instead")
    return {c: [r[c] for r in rows] for c in df.columns} if rows else {}


def export_all(folder: str, articles: DataFrame, relations: DataFrame, gaps: DataFrame, hypotheses: DataFrame, metadata: DataFrame) -> None:
    """The five results of a run."""
    write_json(articles.select(*ARTICLE_COLUMNS), f"{folder}/articles")
    write_json(relations, f"{folder}/relations")
    write_json(gaps.select("node_a", "node_a_type", "node_b", "node_b_type", "score", "method", "common_neighbors", F.upper("novelty_status").alias("novelty_status")), f"{folder}/gap_candidates")
    write_json(hypotheses, f"{folder}/hypotheses")
    write_json(metadata, f"{folder}/metadata")


def graph_edges(edges: DataFrame) -> DataFrame:
    """Edges of the combined graph with lists as texts, joined by semicolons."""
    return edges.select(
        "subject", "object", "predicate", "polarity", "confidence", "weight", F.array_join("pmids", ";").alias("pmids"), F.array_join(F.transform("years", lambda y: y.cast("string")), ";").alias("years")
    )


def _lines(spark: SparkSession, head: list[str], parts: list[tuple[DataFrame, Column, Column]], between: list[str], tail: list[str]) -> DataFrame:
    """(section, key, line), in the order of the document."""
    fixed = [(0, f"{i:03d}", x) for i, x in enumerate(head)] + [(2, f"{i:03d}", x) for i, x in enumerate(between)] + [(4, f"{i:03d}", x) for i, x in enumerate(tail)]
    out = [spark.createDataFrame(fixed, "section int, key string, line string")]
    for section, (df, key, line) in zip((1, 3), parts):
        out.append(df.select(F.lit(section).alias("section"), key.alias("key"), line.alias("line")))
    return reduce(DataFrame.unionByName, out)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document of the combined graph."""
    kinds = {"label": ("node", "string"), "entity_type": ("node", "string"), "predicate": ("edge", "string"), "polarity": ("edge", "string"), "confidence": ("edge", "double"), "weight": ("edge", "double"), "pmids": ("edge", "string"), "years": ("edge", "string")}
    head = ["<?xml version='1.0' encoding='utf-8'?>", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{a}" attr.name="{k}" attr.type="{t}"/>' for k, (a, t) in kinds.items()] + ['<graph edgedefault="directed">']

    def data(names) -> list[Column]:
        return [x for n in names for x in (F.lit(f'<data key="{n}">'), X.escape_html(F.col(n).cast("string")), F.lit("</data>"))]

    node = F.concat(F.lit('<node id="'), X.escape_html(F.col("node")), F.lit('">'), *data(k for k, v in kinds.items() if v[0] == "node"), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), X.escape_html(F.col("subject")), F.lit('" target="'), X.escape_html(F.col("object")), F.lit('">'), *data(k for k, v in kinds.items() if v[0] == "edge"), F.lit("</edge>"))
    e = graph_edges(edges)
    return _lines(nodes.sparkSession, head, [(nodes, F.col("node"), node), (e, F.concat_ws("\x1f", "subject", "object"), edge)], [], ["</graph>", "</graphml>"])


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a node-link JSON document: each item's line starts with a comma but for the first's."""
    e = graph_edges(edges).withColumn("key", F.concat_ws("\x1f", "subject", "object"))
    n = nodes.withColumn("key", F.col("node"))

    def listed(df: DataFrame, item: Column) -> tuple[DataFrame, Column, Column]:
        first = df.agg(F.min("key").alias("least"))
        with_first = df.join(F.broadcast(first), df["key"] == first["least"], "left")  # one row
        return with_first, F.col("key"), F.concat(F.when(F.col("least").isNull(), ",").otherwise(""), F.to_json(item))

    node = F.struct("label", "entity_type", F.col("node").alias("id"))
    link = F.struct("predicate", "polarity", "confidence", "weight", "pmids", "years", F.col("subject").alias("source"), F.col("object").alias("target"))
    head = ['{"directed": true, "multigraph": false, "graph": {}, "nodes": [']
    return _lines(nodes.sparkSession, head, [listed(n, node), listed(e, link)], ['], "links": ['], ["]}"])


def write_lines(lines: DataFrame, path: str) -> None:
    ordered = lines.repartitionByRange("section", "key").sortWithinPartitions("section", "key")
    ordered.select("line").write.mode("overwrite").text(path)


def _identity(x) -> str:
    """What a value is told from others by, as a text of any length."""
    if not isinstance(x, DataFrame):
        return repr(x)
    plan = x._jdf.queryExecution().analyzed().canonicalized().treeString()
    hadoop = x.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = x.sparkSession._jvm.org.apache.hadoop.fs.Path
    changed = []
    for f in sorted(x.inputFiles()):
        p = path(f)
        status = p.getFileSystem(hadoop).getFileStatus(p)
        changed.append(f"{f}@{status.getModificationTime()}+{status.getLen()}")
    return "\n".join([plan, *changed])


def cached(folder: str) -> Callable:
    """A function of DataFrames and plain values whose result is kept as parquet, by what it is called with: plans in
    canonical form with the files that they read and when these were changed, plain values as they are.

    Only a result that isn't there is made; other failures are raised."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def call(spark: SparkSession, *args, **kwargs) -> DataFrame:
            said = [f.__module__, f.__qualname__, *(_identity(a) for a in args), *(f"{k}={_identity(v)}" for k, v in sorted(kwargs.items()))]
            path = f"{folder}/{hashlib.sha256(chr(31).join(said).encode()).hexdigest()}"
            try:
                return spark.read.parquet(path)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                f(spark, *args, **kwargs).write.mode("overwrite").parquet(path)
                return spark.read.parquet(path)

        return call

    return wrap


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
