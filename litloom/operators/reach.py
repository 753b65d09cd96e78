"""Nodes within a few edges of each other, found without listing the walks between them.

Sources are dealt to cells. A cell holds a bit for each of its sources and each node near any of them: a step is the
bitwise OR of the bits of a node's neighbours, so the many walks that lead to the same pair cost a bit each and no row.
A cell is sent the links of the nodes near its sources only; which these are is found by the same steps, with a bit a
cell instead of a source. Cells have fewer sources the more nodes there are, which bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.session import cut

from . import analysis

#: Bits of a cell: sources times nodes.
CELL_BITS = 1 << 28
#: Neighbours in one row of links, and bits looked at together.
CHUNK, PIECE = 1024, 1 << 22


def distances(und: DataFrame, steps: int, pairs: DataFrame | None = None, cell_bits: int = CELL_BITS) -> DataFrame:
    """pairs: (node_a, node_b, distance) of those distinct pairs that are up to ``steps`` edges apart, a linked node two
    from itself. Without pairs: (node_a, node_b), node_a < node_b, of all pairs that are exactly ``steps`` apart."""
    und = cut(und)
    ids = cut(analysis.places(und.groupBy("node").agg(F.count("*").alias("d")).orderBy("node")).select("node", "d", F.col("place").cast("int").alias("x")))
    links = und.join(ids, "node").join(ids.select(F.col("node").alias("nbr"), F.col("x").alias("y")), "nbr")
    part = F.pmod(F.xxhash64("y"), F.ceil(F.col("d") / CHUNK))
    links = cut(links.groupBy("x", "node", part.alias("part")).agg(F.collect_list("y").alias("ys")).drop("part"))
    if pairs is None:
        sources, asked = ids.select("x"), None
    else:
        asked = pairs.select("node_a", "node_b").join(ids.select(F.col("node").alias("node_a"), F.col("x").alias("a")), "node_a").join(ids.select(F.col("node").alias("node_b"), F.col("x").alias("b")), "node_b")
        asked = cut(asked)
        sources = asked.select(F.col("a").alias("x")).distinct()
    n_nodes, n_sources = ids.count(), sources.count()
    cells = max(1, min(-(-n_sources // 64), max(3 * und.sparkSession.sparkContext.defaultParallelism, -(-n_sources * n_nodes // cell_bits))))
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(cells)).cast("int")
    near = _near(links, sources.withColumn("cell", cell("x")), steps)
    empty = F.array().cast("array<int>")
    rows = near.join(links, "x").select("cell", "x", F.lit(0).alias("kind"), "node" if pairs is None else F.lit("").alias("node"), "ys")
    rows = rows.unionByName(sources.select(cell("x").alias("cell"), "x", F.lit(1).alias("kind"), F.lit("").alias("node"), empty.alias("ys")))
    if asked is not None:
        # A cell asks of a node for its own sources only, so these lists are bounded too.
        each = asked.groupBy(cell("a").alias("cell"), F.col("b").alias("x")).agg(F.collect_list("a").alias("ys"))
        rows = rows.unionByName(each.select("cell", "x", F.lit(2).alias("kind"), F.lit("").alias("node"), "ys"))
    rows = rows.repartitionById(min(cells, 2000), F.col("cell") % min(cells, 2000)).sortWithinPartitions("cell", "kind", "x")
    if asked is None:
        return rows.mapInArrow(_all_at(steps), "node_a string, node_b string")
    found = rows.mapInArrow(_of_asked(steps), "a int, b int, distance int")
    return asked.join(found, ["a", "b"]).select("node_a", "node_b", "distance")


def _near(links: DataFrame, sources: DataFrame, steps: int) -> DataFrame:
    """(cell, x): nodes up to so many steps from any source (x, cell) of a cell."""
    bit: Column = F.expr("shiftleft(1L, cell % 64)")
    near = sources.groupBy("x", F.expr("cell div 64").cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
    for _ in range(steps):
        onward = links.select("x", "ys").join(near, "x").select(F.explode("ys").alias("x"), "w", "bits")
        near = cut(near.unionByName(onward).groupBy("x", "w").agg(F.bit_or("bits").alias("bits")))
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1))
    return near.select("x", "w", each.alias("i")).select((F.col("w") * 64 + F.col("i")).cast("int").alias("cell"), "x")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell, in their order."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        c = b.column("cell").to_numpy()
        ends = [*(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
        for lo, hi in zip([0, *ends], ends):
            if lo == hi:
                continue
            if held and held[-1].column("cell")[0].as_py() != c[lo]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Cell:
    """Nodes of a cell by their place in ``ids`` (ascending), links as (to, from) in the order of to, sources as places."""

    def __init__(self, rows: pa.RecordBatch):
        kind, x = rows.column("kind").to_numpy(), rows.column("x").to_numpy()
        n, m = np.searchsorted(kind, [1, 2]).tolist()
        self.ids, first = np.unique(x[:n], return_index=True)
        self.names = rows.column("node").take(pa.array(first))
        to, ys = self._flat(rows.slice(0, n), x[:n])
        known, at = self._places(ys)
        self.to, self.of = np.searchsorted(self.ids, to[known]), at[known]
        self.sources = np.searchsorted(self.ids, np.sort(x[n:m]))
        self.asked = self._flat(rows.slice(m), x[m:])

    def _flat(self, rows: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = rows.column("ys")
        return np.repeat(x, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), lists.flatten().to_numpy()

    def _places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1)
        return self.ids[at] == x, at

    def levels(self, steps: int) -> Iterator[np.ndarray]:
        """For each step, the bits (node, source) of the nodes first reached by it."""
        n, k = len(self.ids), len(self.sources)
        now = np.zeros((n, -(-k // 64) * 8), np.uint8)
        s = np.arange(k)
        now[self.sources, s // 8] = (1 << s % 8).astype(np.uint8)
        now = now.view(np.uint64)
        seen = now.copy()
        piece = max(1, PIECE // now.shape[1] // 8)
        for _ in range(steps):
            live = now.any(axis=1)[self.of]
            to, of, then = self.to[live], self.of[live], np.zeros_like(now)
            for lo in range(0, len(to), piece):
                t = to[lo : lo + piece]
                starts = np.flatnonzero(np.diff(t, prepend=-1))
                then[t[starts]] |= np.bitwise_or.reduceat(now[of[lo : lo + piece]], starts, axis=0)
            then &= ~seen
            seen |= then
            now = then
            yield now


def _all_at(steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in map(_Cell, _cells(batches)):
            *_, last = cell.levels(steps)
            k = len(cell.sources)
            below = np.searchsorted(cell.sources, np.arange(len(cell.ids)))  # sources named before each node
            piece = max(1, PIECE // 8 // k)
            for lo in range(0, len(last), piece):
                bits = np.unpackbits(last[lo : lo + piece].view(np.uint8), axis=1, count=k, bitorder="little").view(bool)
                bits &= np.arange(k) < below[lo : lo + piece, None]
                b, a = np.divmod(np.flatnonzero(bits), k)
                if len(a):
                    yield pa.record_batch([cell.names.take(pa.array(cell.sources[a])), cell.names.take(pa.array(b + lo))], ["node_a", "node_b"])

    return run


def _of_asked(steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in map(_Cell, _cells(batches)):
            b, a = cell.asked
            distance = np.where(a == b, 2, 0).astype(np.int32)
            near, at = cell._places(b)
            s = np.searchsorted(cell.sources, np.searchsorted(cell.ids, a))
            for step, bits in enumerate(cell.levels(steps), 1):
                hit = near & (bits.view(np.uint8)[at, s // 8] >> (s % 8).astype(np.uint8) & 1 == 1)
                distance[hit] = step
            told = distance > 0
            yield pa.record_batch([pa.array(a[told]), pa.array(b[told]), pa.array(distance[told])], ["a", "b", "distance"])

    return run
