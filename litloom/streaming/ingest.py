"""Articles as they arrive: cleaned, deduplicated and turned into relations batch by batch.

A batch's outcome is written to a folder of its own, so a batch that is run again after a failure
replaces what it wrote and nothing counts twice. A pmid belongs to the first batch that delivers it, and
relations are told apart by their pmid among others, so no relation stands in two batches. Each batch also
writes its edge parts; edges are merged from them on read. "First" goes by the canonical order (pmid,
subject, predicate, object, place), which doesn't depend on how rows were batched: the edges equal those
of one build over all articles in every column.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from litloom.operators import clean, extract, graph


def _written(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """What earlier batches wrote; None only if there is no such folder yet, any other failure is raised."""
    try:
        return spark.read.parquet(path).where(F.col("batch") < before)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def process(batch: DataFrame, batch_id: int, folder: str, preserve_case: bool = True) -> None:
    """Clean a batch, leave out pmids of earlier ones, extract, write articles, relations and edge parts."""
    spark = batch.sparkSession
    new = clean.clean_articles(batch, preserve_case=preserve_case)
    seen = _written(spark, f"{folder}/articles", batch_id)
    if seen is not None:
        new = new.join(seen.select("pmid"), "pmid", "left_anti")

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}/batch={batch_id}")

    _, rels = extract.extract(store(new, "articles"))
    counts, pmids = graph.edge_parts(graph.evidence(store(rels, "relations"), "sort_key"))
    store(counts, "edge_counts")
    store(pmids, "edge_pmids")


def ingest(stream: DataFrame, folder: str, preserve_case: bool = True) -> DataStreamWriter:
    """A writer to be started: ``ingest(stream, folder).option("checkpointLocation", ...).start()``."""
    return stream.writeStream.foreachBatch(lambda df, i: process(df, i, folder, preserve_case))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of all that was ingested."""
    return graph.edges_of(*graph.merge_parts(*(spark.read.parquet(f"{folder}/{name}").drop("batch") for name in ("edge_counts", "edge_pmids"))))


def windowed_counts(events: DataFrame, time: str = "received_at", window: str = "1 hour", late: str = "1 day", by: str = "journal") -> DataFrame:
    """Articles a window and value, for a stream with late rows: a watermark bounds the state."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_deliveries(events: DataFrame, time: str = "received_at", late: str = "1 day") -> DataFrame:
    """The first row of each pmid within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["pmid"])
