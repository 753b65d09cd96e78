"""Problem 2: records identical but for letter case, white space, punctuation or field order.

Method: recursive radix partitioning on canonical bytes. A record's canonical bytes are its key
fields with all but letters and digits dropped from the formatted ones. Records are bucketed by
a prefix of these bytes; a bucket with more than ``CAPACITY`` records is split by further bytes,
until each fits or holds one key only. Each bucket is then counted in a trie with terminal counters.
A bucket of one key that is still too large (a hot group of copies) is dealt out by salt; its least
id is already known from the split. Nothing is collected: the split decisions are tables, joined without
hot keys, and the rows are cut off after each round. The number of copies of a record is the terminal
counter of its trie, added up over the salts only.

Defined cases: null fields agree with null only; strings without letters or digits agree with one
another; rows equal throughout are copies; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litloom.operators.skew import join_hot
from litloom.session import cut

CAPACITY = 50_000
FIRST_BYTES = 6
#: Predicates whose subject and object may change places, in canonical form.
SYMMETRIC = ("associatedwith", "correlateswith", "interactswith")
_SEP, _NULL = "\x1f", "\x1e"


def _letters(s: str) -> str:
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", s).casefold())
    return "".join([c for c in s if unicodedata.category(c)[0] in "LNM"])


@F.pandas_udf(T.StringType())
def _canonical_wide(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _letters(x))


def canonical(x: Column) -> Column:
    """Letters and digits in lower case; only values beyond ASCII go through Python."""
    ascii_only = ~x.rlike(r"[^\x00-\x7F]")
    wide = _canonical_wide(F.when(~ascii_only, x))
    return F.when(x.isNull(), F.lit(_NULL)).when(ascii_only, F.regexp_replace(F.lower(x), "[^a-z0-9]", "")).otherwise(wide)


def _key(tab: str, *parts: Column) -> Column:
    return F.encode(F.concat_ws(_SEP, F.lit(tab[0]), *[F.coalesce(p.cast("string"), F.lit(_NULL)) for p in parts]), "UTF-8")


def entity_keys(entities: DataFrame) -> DataFrame:
    return entities.select(F.lit("entities").alias("tab"), F.col("entity_id").cast("long").alias("id"), _key("entities", F.col("pmid"), F.col("sent_ord"), F.col("entity_type"), canonical(F.col("text"))).alias("key"))


def relation_keys(relations: DataFrame) -> DataFrame:
    r = relations.select("rel_ord", "pmid", "polarity", canonical(F.col("subject")).alias("s"), canonical(F.col("predicate")).alias("p"), canonical(F.col("object")).alias("o"))
    either = F.col("p").isin(*SYMMETRIC)
    a = F.when(either, F.least("s", "o")).otherwise(F.col("s"))
    b = F.when(either, F.greatest("s", "o")).otherwise(F.col("o"))
    return r.select(F.lit("relations").alias("tab"), F.col("rel_ord").cast("long").alias("id"), _key("relations", F.col("pmid"), F.col("polarity"), F.col("p"), a, b).alias("key"))


def split(keys: DataFrame, capacity: int = CAPACITY, first: int = FIRST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(tab, id, key, bucket) and, if there are hot keys, (bucket, at, n, least, salts) of their buckets.

    Each round counts the buckets with map-side combining and splits those beyond the capacity by
    twice the bytes, so the number of rounds is the logarithm of the longest key.
    """
    rows = keys.withColumn("bytes", F.lit(first)).withColumn("bucket", F.expr(f"substring(key, 1, {first})"))
    hot: DataFrame | None = None
    total: int | None = None
    depth = first
    while True:
        size = rows.where(F.col("bytes") == depth).groupBy("bucket").agg(
            F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("id").alias("least")
        )
        over = cut(size.where(F.col("n") > capacity))
        one_key = over.where("lo = hi")
        if not one_key.isEmpty():
            these = one_key.select("bucket", F.lit(depth).alias("at"), "n", "least", F.ceil(F.col("n") / capacity).cast("int").alias("salts"))
            hot = these if hot is None else hot.unionByName(these)
        further = over.where("lo <> hi").select("bucket", "n", F.lit(True).alias("again"))
        if further.isEmpty():
            return rows, hot
        depth *= 2
        total = keys.count() if total is None else total
        rows = join_hot(rows, further, ["bucket"], "n", total=total, how="left")
        longer = F.col("again").isNotNull() & (F.col("bytes") == depth // 2)
        rows = cut(rows.select("tab", "id", "key", F.when(longer, F.lit(depth)).otherwise(F.col("bytes")).alias("bytes"), F.when(longer, F.expr(f"substring(key, 1, {depth})")).otherwise(F.col("bucket")).alias("bucket")))


class Trie:
    """Nodes are dicts from the next ``STEP`` bytes; under b'' a terminal has its least id and its ids."""

    STEP = 8

    def __init__(self) -> None:
        self.root: dict = {}
        self.ends: list[list] = []

    def add(self, key: bytes, at: int, row: tuple) -> None:
        node = self.root
        for i in range(at, len(key), self.STEP):
            part = key[i : i + self.STEP]
            nxt = node.get(part)
            if nxt is None:
                nxt = node[part] = {}
            node = nxt
        end = node.get(b"")
        if end is None:
            node[b""] = end = [row[1], []]
            self.ends.append(end)
        elif row[1] < end[0]:
            end[0] = row[1]
        end[1].append(row)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[Trie]:
    """Rows come sorted by bucket: one trie at a time."""
    trie, current = Trie(), None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for tab, i, key, bucket, least in zip(*cols):
            if bucket != current:
                yield trie
                trie, current = Trie(), bucket
            trie.add(key, len(bucket), (tab, i, least))
    yield trie


def _least_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row leaves with the least id of its key."""
    out: tuple[list, list, list] = ([], [], [])

    def take() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["tab", "first_id", "id"])
        for x in out:
            x.clear()
        return b

    for trie in _tries(batches):
        for least, rows in trie.ends:
            for tab, i, hot in rows:
                out[0].append(tab)
                out[1].append(hot if hot is not None else least)
                out[2].append(i)
        if len(out[0]) > 50_000:
            yield take()
    yield take()


def _terminals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each terminal leaves with the least id of its key and its counter."""
    out: tuple[list, list, list] = ([], [], [])

    def take() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["tab", "id", "n"])
        for x in out:
            x.clear()
        return b

    for trie in _tries(batches):
        for least, rows in trie.ends:
            tab, _, hot = rows[0]
            out[0].append(tab)
            out[1].append(hot if hot is not None else least)
            out[2].append(len(rows))
        if len(out[0]) > 50_000:
            yield take()
    yield take()


def _bucketed(keys: DataFrame, capacity: int) -> DataFrame:
    """(tab, id, key, bucket, least), each bucket in one partition, sorted; hot ones dealt out by salt."""
    rows, hot = split(keys, capacity)
    if hot is None:
        rows = rows.withColumn("least", F.lit(None).cast("long")).withColumn("salt", F.lit(0))
    else:
        rows = join_hot(rows, hot.withColumnRenamed("at", "bytes"), ["bucket", "bytes"], "n", total=keys.count(), how="left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)))
    rows = rows.select("tab", "id", "key", "bucket", "least", "salt").repartition("bucket", "salt").sortWithinPartitions("bucket")
    return rows.select("tab", "id", "key", "bucket", "least")


def collapse(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(tab, first_id, id): each row with the least id among its copies."""
    return _bucketed(keys, capacity).mapInArrow(_least_ids, "tab string, first_id long, id long")


def copies(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One record of each class, with the number of its copies (itself included): the counters of the tries'
    terminals, one row each but for the salts of a hot key."""
    ends = _bucketed(keys, capacity).mapInArrow(_terminals, "tab string, id long, n long")
    return ends.groupBy("tab", "id").agg(F.sum("n").alias("n_copies"))


def found(entities: DataFrame, relations: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    keys = cut(entity_keys(entities).unionByName(relation_keys(relations)))
    return collapse(keys, capacity).where("first_id <> id").select("tab", F.col("first_id").alias("id_a"), F.col("id").alias("id_b"))
