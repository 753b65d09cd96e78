"""Problem 9: documents packed into containers of bounded size in tokens.

Method: variable-capacity best fit over the histogram of sizes. The largest item left opens a container.
For each permitted length the best filling of its room is sought among the sizes left: one item, two
items that leave ``NEARLY`` tokens at most, or else the largest that fit, one after another. The length is
opened whose cost a token held is least, so a short one where nothing left fills a long one. In the end
every container is downsized to the smallest permitted length that holds its contents. Ordinary best fit
with the largest length alone is packed as well, and the cheaper of both packings kept.

A document is split only if it is longer than the largest permitted length. Documents of zero
tokens (null or empty text) take a place in some container. Only ids and sizes are shuffled; each
partition packs its own items in blocks of ``BLOCK_ITEMS``, in the order of their ids so that a task that
is run again packs the same blocks. A container never spans blocks, and the loss is at most the last few
containers of a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER_FILE, token_counts

CAPACITY = 1024
LENGTHS = (256, 512, 768, 1024)
#: Cost of a container besides its length, in tokens: few large ones are better than many small ones.
OVERHEAD = 64
#: A room that two items fill but for so many tokens counts as filled.
NEARLY = 7
#: Items packed together: bounds a task's memory; the loss is at most the last containers of a block.
BLOCK_ITEMS = 1_000_000


def best_fit(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """sizes: in descending order. The container of each item, and each container's final length."""
    lengths = sorted(lengths)
    ways = []
    for where, n in (_joint(sizes, lengths, overhead), _single(sizes, lengths[-1])):
        used = np.bincount(where, weights=sizes, minlength=n).astype(np.int64)
        ways.append((where, np.array(lengths, np.int64)[np.searchsorted(lengths, used)]))
    return min(ways, key=lambda w: int(w[1].sum()) + overhead * len(w[1]))


def _filling(have: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, ...]:
    """Sizes of a good filling of a room from the sizes left."""
    fit = np.flatnonzero(have[: room + 1])
    if not len(fit):
        return ()
    if fit[-1] == room:
        return (room,)
    for total in range(room, max(int(fit[-1]), room - NEARLY - 1), -1):
        both = have[1 : total // 2 + 1] & have[total - 1 : total - total // 2 - 1 : -1]
        for a in (np.flatnonzero(both)[:2] + 1).tolist():
            if 2 * a != total or counts[a] > 1:
                return (total - a, a)
    out: list[int] = []
    for size in fit[::-1].tolist():
        while size <= room and out.count(size) < counts[size]:
            out.append(size)
            room -= size
        if not room:
            break
    return tuple(out)


def _joint(sizes: np.ndarray, lengths: list[int], overhead: int) -> tuple[np.ndarray, int]:
    """The container of each item and the number of containers; lengths and contents chosen from the histogram."""
    top = lengths[-1]
    counts = np.bincount(sizes, minlength=top + 1)
    counts[0] = 0
    have = counts > 0
    next_of = np.searchsorted(-sizes, -np.arange(top + 1))  # where the items of a size begin
    where = np.zeros(len(sizes), np.int64)
    n, size = 0, top
    while True:
        while size and not counts[size]:
            size -= 1
        if not size:
            break
        counts[size] -= 1
        have[size] = counts[size] > 0
        least, inside = None, ()
        for c in reversed(lengths):
            if c < size:
                break
            filling = _filling(have, counts, c - size) if c > size else ()
            held = size + sum(filling)
            if least is None or (c + overhead) / held < least:
                least, inside = (c + overhead) / held, filling
            if held == c:
                break  # a shorter one can't cost less
        for x in (size, *inside):
            where[next_of[x]] = n
            next_of[x] += 1
        for x in inside:
            counts[x] -= 1
            have[x] = counts[x] > 0
        n += 1
    return where, max(n, 1 if len(sizes) else 0)  # items without tokens lie in the first one


def _single(sizes: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Best fit with one length: each item goes to the container of the least room that holds it."""
    by_room: list[list[int]] = [[] for _ in range(top + 1)]
    rooms = 0  # bit r: some open container has r tokens of room
    where = np.empty(len(sizes), np.int64)
    n = 0
    for k, size in enumerate(sizes.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room, n = n, top, n + 1
        where[k] = b
        by_room[room - size].append(b)  # full ones still take items without tokens
        rooms |= 1 << (room - size)
    return where, n


def pack(sizes: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, n_tokens) -> (doc_id, part, part_tokens, container, length, used).

    Null sizes count as zero. Repeated rows are items of their own. ``container`` is unique over
    the result: the partition in its upper bits and the place within it in the lower 33.
    """
    top = max(lengths)
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    last = F.greatest(F.lit(0), F.ceil(n / top) - 1).cast("int")
    items = (
        sizes.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
        .select("doc_id", "part", F.least(F.lit(top), F.col("n") - F.col("part") * top).cast("int").alias("part_tokens"))
        .hint("rebalance", "doc_id")  # partitions of even size, however large the corpus and whatever the keys
        .sortWithinPartitions("doc_id", "part")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        block: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            t = pa.Table.from_batches(block)
            block.clear()
            ids, part, size = (t.column(i).to_numpy() for i in range(3))
            order = np.lexsort((part, ids, -size))
            where, final = best_fit(size[order], lengths, overhead)
            used = np.bincount(where, weights=size[order], minlength=len(final)).astype(np.int64)
            out = pa.table({
                "doc_id": ids[order], "part": part[order].astype(np.int32), "part_tokens": size[order].astype(np.int32),
                "container": where + base, "length": final[where].astype(np.int32), "used": used[where].astype(np.int32),
            })
            base += len(final)
            yield from out.to_batches(max_chunksize=100_000)

        for b in batches:
            if b.num_rows:
                block.append(b)
            if sum(x.num_rows for x in block) >= BLOCK_ITEMS:
                yield from packed()
        if block:
            yield from packed()

    return items.mapInArrow(run, "doc_id long, part int, part_tokens int, container long, length int, used int")


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    return pack(token_counts(docs, tokenizer=tokenizer), lengths)
