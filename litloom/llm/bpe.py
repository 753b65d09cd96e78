"""Problem 8: a corpus encoded with a public byte-level BPE tokenizer.

Method: contiguous rank array. A word's part boundaries and the merge rank of each adjacent pair
of parts stand in two short lists; the least rank is found by a scan, its boundary is deleted and
the two neighbouring ranks are looked up again, until no pair has a rank. Words longer than
``SCAN_LIMIT`` bytes, where repeated scans would be quadratic, take the same merges from a heap.

Each word is merged once per worker and kept (bounded), so a corpus costs a split and look-ups.
Null and empty texts have an empty list of ids. White space is encoded as it stands and the names
of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCAN_LIMIT = 256
CACHE_LIMIT = 200_000
_NO_RANK = 1 << 60


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines() if isinstance(data, bytes) else data)}


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the contiguous rank array."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    bounds = list(range(n + 1))
    get = ranks.get
    adjacent = [get(word[i : i + 2], _NO_RANK) for i in range(n - 1)]
    while adjacent:
        least = min(adjacent)
        if least == _NO_RANK:
            break
        i = adjacent.index(least)
        del bounds[i + 1]
        del adjacent[i]
        if i < len(adjacent):
            adjacent[i] = get(word[bounds[i] : bounds[i + 2]], _NO_RANK)
        if i:
            adjacent[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word: a heap of (rank, place) over linked parts."""
    n = len(word)
    nxt, prv = list(range(1, n + 2)), list(range(-1, n))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or nxt[j] != end:
            continue
        alive[j] = False
        nxt[i] = end
        if end < n:
            prv[end] = i
            r = ranks.get(word[i : nxt[end]])
            if r is not None:
                heapq.heappush(heap, (r, i, nxt[end]))
        p = prv[i]
        if p >= 0:
            r = ranks.get(word[p:end])
            if r is not None:
                heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : nxt[i]]])
        i = nxt[i]
    return out


class _Chunks(dict):
    """Chunk (a run without white space, with one space before it, or white space) -> packed ids."""

    def __init__(self, ranks: dict[bytes, int], words) -> None:
        super().__init__()
        self.ranks, self.words = ranks, words

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        for w in self.words(chunk):
            b = w.encode("utf-8", "surrogatepass")
            ids += merge_scan(b, self.ranks) if len(b) <= SCAN_LIMIT else merge_heap(b, self.ranks)
        packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(self) >= CACHE_LIMIT:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed


class Encoder:
    def __init__(self, data: bytes) -> None:
        import regex

        self.ranks = parse_ranks(data)
        self.chunks = _Chunks(self.ranks, regex.compile(SPLIT_PATTERN).findall)
        # White space as the split pattern sees it, so that both splits agree.
        white = "".join(regex.findall(r"\s", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))))
        w = re.escape(white)
        self.split = re.compile(f" ?[^{w}]+|[{w}]+(?![^{w}])|[{w}]+").findall
        self.run = re.compile(f"[{w}][{w}]").search

    def packed(self, text: str | None) -> bytes:
        """Little-endian int32 ids. A text without runs of white space may be cut at each space."""
        if not text:
            return b""
        get = self.chunks.__getitem__
        if self.run(text) is None and text[-1] != " ":
            first, *rest = text.split(" ")
            return get(first) + b"".join([get(" " + x) for x in rest]) if first else b"".join([get(" " + x) for x in rest])
        return b"".join(map(get, self.split(text)))

    def encode(self, text: str | None) -> list[int]:
        p = self.packed(text)
        return list(struct.unpack(f"<{len(p) // 4}i", p))


_ENCODERS: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, tokenizer: str):
    """The vocabulary file (fixed size, under 1 MB) goes to each executor once."""
    with open(tokenizer, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """(id, ids): one pass without shuffle over two columns."""
    data = _vocabulary(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value)
        for batch in batches:
            parts = [enc.packed(t) for t in batch.column(1).to_pylist()]
            offsets, at = [0], 0
            for p in parts:
                at += len(p) // 4
                offsets.append(at)
            values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(parts))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """(id, n_tokens): as encode_corpus, but only the sizes leave the worker."""
    data = _vocabulary(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value)
        for batch in batches:
            n = pa.array([len(enc.packed(t)) // 4 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long")
