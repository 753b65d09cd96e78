"""Problem 6: deeply nested JSON records turned into linked flat tables.

Method: vectorised structural indexing. The payloads of a batch lie in one byte buffer. Bitmaps of
quotes (without escaped ones), brackets and delimiters are built for the whole buffer at once;
prefix sums of quotes tell what lies inside a string and prefix sums of brackets the nesting depth,
both restarted at each payload. The tokens found so are linked to their containers, checked against
the grammar and given key and place; spans are cut out only for the values that are emitted.

Defined cases: null, blank, invalid or non-object payloads give nothing, and don't affect their
neighbours; of a key repeated in an object the last counts; null id or extra columns don't matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WHITE, OPEN, CLOSE = b" \t\n\r", b"{[", b"}]"
_SCALAR = re.compile(rb"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?").fullmatch
_KIND = np.zeros(256, np.uint8)
for _c in b'{}[]:,"':
    _KIND[_c] = _c
_IS_WHITE = np.isin(np.arange(256), list(WHITE))
_IS_OPEN = np.isin(np.arange(256), list(OPEN))
_IS_CLOSE = np.isin(np.arange(256), list(CLOSE))
_HEX = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))
_ESCAPED = np.isin(np.arange(256), list(b'"\\/bfnrtu'))
SCALAR = 1  # kind of a number, true, false or null


class Index:
    """Tokens of many payloads. Of each: kind, start, end, doc, parent (token of its container), key, place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keys: tuple[bytes, ...]) -> None:
        n = len(data)
        lengths = np.diff(offsets)
        doc_of = np.repeat(np.arange(len(lengths)), lengths)
        start_of = offsets[:-1][doc_of]
        at = np.arange(n)
        valid = lengths > 0

        # Quotes, without those behind an odd run of backslashes.
        back = data == 0x5C
        plain = np.maximum.accumulate(np.where(back, -1, at)) if n else at
        quote_at = np.flatnonzero(data == 0x22)
        before = np.maximum(np.where(quote_at > 0, plain[quote_at - 1], -1), start_of[quote_at] - 1)
        quote_at = quote_at[(quote_at - 1 - before) % 2 == 0]
        quote = np.zeros(n, bool)
        quote[quote_at] = True
        sums = np.concatenate([[0], np.cumsum(quote)])
        parity = (sums[1:] - sums[offsets[:-1]][doc_of]) & 1
        valid &= (sums[offsets[1:]] - sums[offsets[:-1]]) % 2 == 0
        inside = (parity == 1) & ~quote
        valid[doc_of[inside & (data < 0x20)]] = False

        # Escapes: a backslash that isn't itself escaped, and what follows.
        slash = np.flatnonzero(back & inside)
        if len(slash):
            prior = np.maximum(np.where(slash > 0, plain[slash - 1], -1), start_of[slash] - 1)
            slash = slash[(slash - 1 - prior) % 2 == 0]
            nxt = np.minimum(slash + 1, n - 1)
            valid[doc_of[slash[~_ESCAPED[data[nxt]]]]] = False
            u = slash[data[nxt] == 0x75]
            for k in range(2, 6):
                where = np.minimum(u + k, n - 1)
                valid[doc_of[u[~_HEX[data[where]] | ~inside[where]]]] = False

        # Tokens: structural characters and scalars outside strings, opening quotes.
        outside = (parity == 0) & ~quote
        kind = np.where(outside, _KIND[data], 0)
        word = outside & (kind == 0) & ~_IS_WHITE[data]
        first = word.copy()
        first[1:] &= ~(word[:-1] & (doc_of[1:] == doc_of[:-1]))
        opening = quote & (parity == 1)
        pos = np.flatnonzero((kind > 0) | first | opening)
        self.data, self.pos = data, pos
        self.kind = k = np.where(opening[pos], 0x22, np.where(first[pos], SCALAR, kind[pos])).astype(np.uint8)
        self.doc = doc = doc_of[pos]
        m = len(pos)
        self.end = end = pos + 1
        closing = quote_at[parity[quote_at] == 0]
        if len(closing):
            q = np.flatnonzero(k == 0x22)
            j = np.searchsorted(closing, pos[q] + 1)
            end[q] = np.where(j < len(closing), closing[np.minimum(j, len(closing) - 1)], n)
        words = np.flatnonzero(k == SCALAR)
        if len(words):
            stops = np.flatnonzero(word & ~np.concatenate([word[1:] & (doc_of[1:] == doc_of[:-1]), [False]]))
            end[words] = stops[np.searchsorted(stops, pos[words])] + 1
            raw = data.tobytes()
            for t in words:
                if not _SCALAR(raw[pos[t] : end[t]]):
                    valid[doc[t]] = False

        # Depth by prefix sums, restarted at each payload.
        is_open, is_close = _IS_OPEN[k] & (k > SCALAR), _IS_CLOSE[k] & (k > SCALAR)
        step = is_open.astype(np.int64) - is_close
        cum = np.concatenate([[0], np.cumsum(step)])
        token_start = np.searchsorted(doc, np.arange(len(lengths)))
        token_stop = np.searchsorted(doc, np.arange(len(lengths)), side="right")
        depth = cum[1:] - cum[token_start][doc]
        valid &= token_stop > token_start
        has = np.flatnonzero(token_stop > token_start)
        valid[has] &= (k[token_start[has]] == 0x7B) & (k[token_stop[has] - 1] == 0x7D)
        last = np.zeros(m, bool)
        last[token_stop[has] - 1] = True
        valid[doc[(depth < 0) | ((depth == 0) & ~last) | ((depth > 0) & last)]] = False

        # Containers: within (payload, level) the latest opening bracket before a token.
        level = np.where(is_open, depth - 1, depth)  # level a token lies at
        opens = np.flatnonzero(is_open)
        who = np.concatenate([np.arange(m), opens, np.flatnonzero(is_close)])
        role = np.concatenate([np.zeros(m, np.int8), np.ones(len(opens), np.int8), np.full(int(is_close.sum()), 2, np.int8)])
        lev = np.where(role == 0, level[who], np.where(role == 1, depth[who], depth[who] + 1))
        order = np.lexsort((role == 0, who, lev, doc[who]))
        w, r = who[order], role[order]
        latest = np.maximum.accumulate(np.where(r == 1, np.arange(len(w)), -1)) if len(w) else np.zeros(0, np.int64)
        holder = np.where(latest >= 0, w[np.maximum(latest, 0)], -1)
        parent = np.full(m, -1, np.int64)
        parent[w[r == 0]] = holder[r == 0]
        opener = np.full(m, -1, np.int64)
        opener[w[r == 2]] = holder[r == 2]
        top = level == 0
        parent[top] = -1
        c = np.flatnonzero(is_close)
        bad = (opener[c] < 0) | (doc[np.maximum(opener[c], 0)] != doc[c]) | (k[np.maximum(opener[c], 0)] != np.where(k[c] == 0x7D, 0x7B, 0x5B))
        valid[doc[c[bad]]] = False
        pk = np.where(parent >= 0, k[np.maximum(parent, 0)], 0)  # kind of the container
        valid[doc[~top & ((parent < 0) | (doc[np.maximum(parent, 0)] != doc))]] = False

        # Grammar: what may follow the token before.
        prev = np.concatenate([[0], k[:-1]]) if m else k
        prev[token_start[has]] = 0
        value = (k == 0x22) | (k == SCALAR) | is_open
        is_key = (k == 0x22) & (pk == 0x7B) & ((prev == 0x7B) | (prev == 0x2C))
        prev_key = np.concatenate([[False], is_key[:-1]]) if m else is_key
        in_obj, in_arr = pk == 0x7B, pk == 0x5B
        ended = (prev == SCALAR) | (prev == 0x7D) | (prev == 0x5D) | ((prev == 0x22) & ~prev_key)
        close_ok = (prev == 0x7B) & (k == 0x7D) | (prev == 0x5B) & (k == 0x5D) | ended
        ok = np.where(prev == 0, k == 0x7B, False)
        ok |= is_close & close_ok
        ok |= is_key
        ok |= (k == 0x3A) & prev_key & in_obj
        ok |= (k == 0x2C) & ended & (in_obj | in_arr)
        ok |= value & ~is_key & (prev == 0x3A) & in_obj
        ok |= value & in_arr & ((prev == 0x5B) | (prev == 0x2C))
        valid[doc[~ok]] = False
        self.valid = valid

        # Key and place of each value; keys that aren't asked for stay -1.
        self.value = value & ~is_key & valid[doc]
        self.parent = parent
        key_tokens = np.flatnonzero(is_key & valid[doc])
        name = np.full(m, -1, np.int16)
        size = end[key_tokens] - pos[key_tokens] - 1
        for i, want in enumerate(keys):
            cand = key_tokens[size == len(want)]
            for j, ch in enumerate(want):
                cand = cand[data[pos[cand] + 1 + j] == ch]
            name[cand] = i
        escaped = np.concatenate([[0], np.cumsum(back)])
        raw_keys = {w: i for i, w in enumerate(keys)}
        for t in key_tokens[escaped[end[key_tokens]] > escaped[pos[key_tokens]]]:
            name[t] = raw_keys.get(self.text(t).encode("utf-8", "replace"), -1)
        self.key = np.full(m, -1, np.int16)
        v = np.flatnonzero(self.value & in_obj)
        self.key[v] = name[v - 2]
        self.place = np.zeros(m, np.int64)
        arr = np.flatnonzero(self.value & in_arr)
        if len(arr):  # values of one array, in order
            o = arr[np.lexsort((arr, parent[arr]))]
            fresh = np.concatenate([[True], parent[o[1:]] != parent[o[:-1]]])
            run = np.arange(len(o))
            self.place[o] = run - np.maximum.accumulate(np.where(fresh, run, 0))
        self.roots = token_start[np.flatnonzero(valid)]
        # Children by (parent, key); of a repeated key the last.
        named = np.flatnonzero(self.key >= 0)
        o = named[np.lexsort((named, self.key[named], parent[named]))]
        keep = np.concatenate([(parent[o[1:]] != parent[o[:-1]]) | (self.key[o[1:]] != self.key[o[:-1]]), [True]]) if len(o) else np.zeros(0, bool)
        o = o[keep]
        self._width = len(keys) + 1
        self._child_id = parent[o] * self._width + self.key[o]
        self._child = o
        elements = arr[np.lexsort((arr, parent[arr]))] if len(arr) else arr
        self._elements, self._element_parent = elements, parent[elements]

    def text(self, t: int) -> str:
        raw = self.data[self.pos[t] : self.end[t] + 1].tobytes()
        s = json.loads(raw) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\u" in raw.decode("utf-8", "replace") else s

    def child(self, tokens: np.ndarray, key: int) -> np.ndarray:
        """Of each token the value under the key, or -1; -1 and non-objects have none."""
        want = tokens * self._width + key
        if not len(self._child_id):
            return np.full(len(tokens), -1)
        j = np.minimum(np.searchsorted(self._child_id, want), len(self._child_id) - 1)
        return np.where((tokens >= 0) & (self._child_id[j] == want), self._child[j], -1)

    def items(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of tokens, item, place): elements of a list; a lone value is a list of one."""
        which = np.arange(len(tokens))
        is_list = (tokens >= 0) & (self.kind[np.maximum(tokens, 0)] == 0x5B)
        lone = which[(tokens >= 0) & ~is_list]
        lists = which[is_list]
        lo = np.searchsorted(self._element_parent, tokens[lists])
        hi = np.searchsorted(self._element_parent, tokens[lists], side="right")
        n = hi - lo
        item = self._elements[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(lists) else lists
        return np.concatenate([lone, np.repeat(lists, n)]), np.concatenate([tokens[lone], item]), np.concatenate([np.zeros(len(lone), np.int64), self.place[item]])


# The names of the record format.
KEYS = tuple(x.encode() for x in (
    "MedlineCitation", "Article", "AuthorList", "Author", "CollectiveName", "LastName", "ForeName", "AffiliationInfo", "Affiliation",
    "MeshHeadingList", "MeshHeading", "DescriptorName", "QualifierName", "KeywordList", "Keyword",
    "PubmedData", "ArticleIdList", "ArticleId", "IdType", "ELocationID", "EIdType", "#text",
))
K = {k.decode(): i for i, k in enumerate(KEYS)}


class _Records:
    def __init__(self, index: Index) -> None:
        self.x = index
        self.rows: list[tuple[int, str, int, int, str]] = []

    def path(self, tokens: np.ndarray, *names: str) -> np.ndarray:
        for n in names:
            tokens = self.x.child(tokens, K[n])
        return tokens

    def texts(self, tokens: np.ndarray) -> list[str]:
        """Of each token its text without outer white space: a string, or an object's #text; else ''."""
        inner = self.x.child(tokens, K["#text"])
        t = np.where((tokens >= 0) & (self.x.kind[np.maximum(tokens, 0)] == 0x7B), inner, tokens)
        kind = np.where(t >= 0, self.x.kind[np.maximum(t, 0)], 0)
        return [self.x.text(i).strip() if q == 0x22 else "" for i, q in zip(t.tolist(), kind.tolist())]

    def emit(self, child: str, owner: np.ndarray, pos: np.ndarray, sub: np.ndarray, vals: list[str]) -> None:
        docs = self.x.doc[owner].tolist()
        self.rows += [(d, child, p, s, v) for d, p, s, v in zip(docs, pos.tolist(), sub.tolist(), vals) if v]

    def authors(self, citation: np.ndarray) -> None:
        _, author, pos = self.x.items(self.path(citation, "Article", "AuthorList", "Author"))
        group, last, fore = (self.texts(self.path(author, n)) for n in ("CollectiveName", "LastName", "ForeName"))
        names = [g or (f"{a}, {b}" if a and b else a or b) for g, a, b in zip(group, last, fore)]
        self.emit("author", author, pos, np.full(len(author), -1), names)
        which, info, sub = self.x.items(self.path(author, "AffiliationInfo"))
        self.emit("affiliation", info, pos[which], sub, self.texts(self.path(info, "Affiliation")))

    def mesh(self, citation: np.ndarray) -> None:
        _, heading, pos = self.x.items(self.path(citation, "MeshHeadingList", "MeshHeading"))
        names = self.texts(self.path(heading, "DescriptorName"))
        which, qualifier, sub = self.x.items(self.path(heading, "QualifierName"))
        texts = self.texts(qualifier)
        some = np.zeros(len(heading), bool)
        some[which[[bool(t) for t in texts]] if len(texts) else which] = True
        self.emit("mesh", qualifier, pos[which], sub, [f"{names[w]} / {t}" if t and names[w] else "" for w, t in zip(which.tolist(), texts)])
        bare = np.flatnonzero(~some)
        self.emit("mesh", heading[bare], pos[bare], np.full(len(bare), -1), [names[i] for i in bare])

    def keywords(self, citation: np.ndarray) -> None:
        _, lists, pos = self.x.items(self.path(citation, "KeywordList"))
        which, word, sub = self.x.items(self.path(lists, "Keyword"))
        self.emit("keyword", word, pos[which], sub, self.texts(word))

    def doi(self, root: np.ndarray) -> None:
        found: dict[int, str] = {}
        for tokens, kind in ((self.path(root, "PubmedData", "ArticleIdList", "ArticleId"), "IdType"), (self.path(root, "MedlineCitation", "Article", "ELocationID"), "EIdType")):
            which, item, place = self.x.items(tokens)
            order = np.lexsort((place, which))
            which, item = which[order], item[order]
            kinds, texts = self.texts(self.path(item, kind)), self.texts(item)
            here: dict[int, str] = {}
            for w, t, v in zip(which.tolist(), kinds, texts):
                if t.lower() == "doi":
                    here.setdefault(w, v)
            for w, v in here.items():
                found.setdefault(w, v)
        owner = root[np.fromiter(found, np.int64, len(found))] if found else root[:0]
        zero = np.zeros(len(owner), np.int64)
        self.emit("doi", owner, zero, zero - 1, list(found.values()))


def flatten_payloads(payloads: pa.Array) -> list[tuple[int, str, int, int, str]]:
    """(row of the array, child, pos, sub, val) of each item."""
    a = payloads.cast(pa.large_string()).fill_null("")
    a = pa.concat_arrays([a]) if a.offset == 0 else pa.array(a.to_pylist(), pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[: len(a) + 1].copy()
    total = int(offsets[-1]) if len(offsets) else 0
    if not total:
        return []
    data = np.frombuffer(a.buffers()[2], np.uint8)[:total]
    records = _Records(Index(data, offsets, KEYS))
    root = records.x.roots
    citation = records.path(root, "MedlineCitation")
    records.authors(citation)
    records.mesh(citation)
    records.keywords(citation)
    records.doi(root)
    return records.rows


#: Bytes of payload that are indexed at once: bounds the worker's memory.
BLOCK_BYTES = 2 << 20


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1).cast(pa.large_string())])
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flatten(records: DataFrame, id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """(raw_id, child, pos, sub, val): child tables linked to their record by raw_id and place; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in _blocks(big):
                rows = flatten_payloads(batch.column(1))
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.string()),
                ], names=["raw_id", "child", "pos", "sub", "val"])

    src = records.select(records[id_col].cast("long").alias("raw_id"), records[payload_col].cast("string").alias("payload"))
    return src.mapInArrow(run, "raw_id long, child string, pos int, sub int, val string")
