"""Problem 3: sentence boundaries across languages and scripts.

Method: semi-Markov dynamic programming over whole spans. Every closing mark (and, in Thai, every
white space) is a possible end. A chain of spans is chosen whose sum of scores is greatest. A span is
scored as a whole (``_Spans.score``): its length, its opening word together with the mark that it stands
behind, its closing word together with what opens behind it, and whether quotations and brackets are
balanced within it. A short span that opens in lower case or with a number behind a mere dot
counts as the rest of a sentence, so the dot was an abbreviation's. A span may reach over any number of
possible ends; words are looked at whole, however long. Time is linear in the text, but for the ends
within ``FREE`` characters.

Offsets count code points of the text as stored. Null, empty and blank texts give no sentence; a
text without closing mark is one sentence; equal scores prefer the earlier end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import normalise

#: Characters that a span may have before its length counts against it.
FREE = 600
#: Characters under which a span is too short to open weakly behind a mere dot.
SHORT = 12
#: Characters over which a word is one of a script without spaces, or an identifier.
LONG_WORD = 64

# Abbreviations, without dots at their end, in lower case.
#: Something always follows: titles, references to figures, "for example".
BOUND = set(
    "dr prof mr mrs ms mx st vs cf fig figs eq eqs ref refs viz approx ca suppl tab tabl abb bzw vgl sog no nos nr vol pp ed eds e.g i.e z.b d.h u.a p.ex p.ej s.o "
    "sr sra srta dra mme mlle mm ej ex art cap núm num pág págs spp sp subsp var nov c.f resp.to gen lt col sgt rev hon डॉ श्री प्रो द मि कि सं د أ م نพ ดร นพ พญ".split()
)
#: May end a sentence: what follows decides.
OPEN_ENDED = set("etc inc ltd co corp al std min sec resp hr hrs wk wks mo yr yrs univ dept jan feb mar apr jun jul aug sep sept oct nov dec jr sr ph.d m.d u.s u.k u.s.a e.u a.m p.m bros assn est usw".split())
#: Doses: may end a sentence, also before one that starts in lower case.
DOSE = set("b.i.d t.i.d q.i.d q.d q.o.d i.v p.o i.p s.c i.m p.r p.r.n h.s b.d o.d n.p.o".split())
#: Words that open a sentence when written with a capital.
OPENERS = set(
    "the we in a an this these those it its our they their there here however moreover furthermore thus therefore when while after although at on of for from as if to by with no all both each patients results methods "
    "conclusions background objective median samples treatment levels loss does is are was did why how what which dose surprisingly die der das ein eine wir nach am im es bei le la les un une nous il elle dans el los las se en".split()
)
#: Words that go on with a sentence.
FUNCTION = set("and or but with for on in of to at by from until then than as is are was were the a an per via into over under after before that which who whose had has have not und oder mit für von bei nach bis ist et ou de des du pour par dans à en est y o con para por del que".split())
GERMAN_MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
ORDINAL_BEFORE = set("am vom zum bis dem den der des ab beim im seit".split())

_CLOSERS = "\"'”’»›“)]」』）】〉》"
_INVISIBLE = "­​‌‍⁠﻿"
_CANDIDATE = re.compile(
    rf"(?:[.!?…]+|[。！？।॥؟｡．]+|\.)[{_INVISIBLE}]*(?:[{re.escape(_CLOSERS)}]+|\s?[»›](?![\w]))*"
).finditer
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"\s+").finditer
_BREAKS = frozenset("([{（「『“„«\"'‘,;:")
_NEXT_WORD = re.compile(r"[^\W_][\w'-]*", re.U).search
_QUOTE = re.compile(r"[\"“”„«»‹›「」『』()（）\[\]【】]|(?<!\w)'(?=\w)|(?<=[\w.!?,])'(?!\w)")
_PAIR = {"«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "„": "“", "“": "”"}
_MATCH_CLOSE = {")": "(（", "）": "(（", "]": "[", "】": "【", "」": "「", "』": "『", "»": "«", "›": "‹", "”": "“„", "“": "„"}


def pairs(text: str) -> tuple[list[tuple[int, int, str]], list[int]]:
    """(open, close, mark) of quotations and brackets, and the places of those never closed."""
    stack: list[tuple[int, str]] = []
    waiting: dict[str, int] = {}  # how many of each mark are open
    done: list[tuple[int, int, str]] = []

    def push(at: int, c: str) -> None:
        stack.append((at, c))
        waiting[c] = waiting.get(c, 0) + 1

    def close(at: int, openers: str) -> None:
        while stack:
            a, o = stack.pop()
            waiting[o] -= 1
            if o in openers:
                done.append((a, at, o))
                return

    for m in _QUOTE.finditer(text):
        c, at = m[0], m.start()
        if c == '"' or c == "'":
            before = text[at - 1] if at else " "
            opening = before.isspace() or before in "([（「“:"
            if not opening or (at + 1 < len(text) and text[at + 1].isspace()):
                if waiting.get(c):
                    close(at, c)
                elif opening:
                    push(at, c)
            else:
                push(at, c)
        elif c in _MATCH_CLOSE and any(waiting.get(o) for o in _MATCH_CLOSE[c]):
            close(at, _MATCH_CLOSE[c])
        elif c in _PAIR:
            push(at, c)
    return done, [at for at, _ in stack]


@lru_cache(50_000)
def _plain(word: str) -> str:
    """A word as it looks, in lower case and without outer dots."""
    if not word.isascii():
        word = normalise(word) or ""
    return word.strip(".").lower()


@lru_cache(50_000)
def _kind(word: str) -> str:
    """Of the word before a dot: bound, open, dose, initial, short, number, word."""
    w = _plain(word)
    if not w or w[-1] in ")]%\"'”’»）】":
        return "word"
    if w in BOUND:
        return "bound"
    if w in DOSE:
        return "dose"
    if w in OPEN_ENDED:
        return "open"
    if w.isdigit():
        return "number"
    if len(w) == 1 and w.isalpha():
        return "initial"
    if "." in w and not w[0].isdigit() and all(0 < len(p) <= (3 if p.isascii() else 5) and (p.isalnum() or not p.isascii()) for p in w.split(".")):
        return "initial"
    tail = re.split(r"[\W_]", w)[-1]
    if tail != w and len(tail) == 1 and w[-2:-1] == "." and word.rstrip(".")[-1:].isupper():
        return "initial"
    if tail != w and len(tail) > 1 and tail in BOUND or re.search(r"(?:vs|cf|fig|ca)$", w) and not w.isascii() or len(w) > 4 and w.endswith("str"):
        return "bound"
    return "word"


@lru_cache(50_000)
def _opening(word: str) -> str:
    """Of the word after a possible end: function, opener, lower, upper, digit, other."""
    w = normalise(word) if not word.isascii() else word
    w = w or word
    c = w[0]
    low = w.lower()
    if c.isdigit():
        return "digit"
    if c.islower():
        return "function" if low in FUNCTION else "lower"
    if c.isupper():
        return "opener" if low in OPENERS else "upper"
    return "other"


def _prior(text: str, start: int) -> str:
    """What stands between white space before a place."""
    e = start
    while e and text[e - 1].isspace():
        e -= 1
    i = e
    while i and not text[i - 1].isspace() and e - i < LONG_WORD:
        i -= 1
    return text[i:e]


def _dot_score(text: str, at: int, end: int, nxt: int, closers: str, word: str, first: str, marks: str) -> float:
    """Score of a sentence that closes with ``word`` and the dot at ``at`` before one that opens with ``first``
    at ``nxt``, behind ``marks``."""
    n = len(text)
    c = text[nxt]
    if nxt == end:
        if c.isdigit() or c in ",;:%/-)" or c == "." or not c.isupper():
            return -9.0 if not ("ऀ" <= c <= "ॿ" and closers) else -3.0
        after = text[nxt + 1] if nxt + 1 < n else " "
        kind = _kind(word)
        if len(word) < 2 and text[at - 1 : at] not in (")", "]", "%", "”", '"') and kind != "number" or kind in ("bound", "initial", "open", "dose"):
            return -9.0
        if "/" in word or "@" in word or "." in word.strip("."):
            return -2.0 if not after.islower() else 1.0
        return 3.0 if after.isalnum() or after.isspace() else 0.0
    how = _opening(first) if first else "other"
    if marks and marks[0] in ",;:)]%":
        return -9.0
    if closers and any(x in "\"'”’»›“」』" for x in closers) and how in ("lower", "function"):
        return -6.0
    kind = _kind(word)
    if kind == "word":
        if how in ("lower", "function") and not closers and word in FUNCTION:
            return -3.0  # no sentence closes with such a word and goes on in lower case
        return 5.0 if how in ("upper", "opener", "digit", "other") else 3.0 if how == "lower" else 1.5
    if kind == "number":
        if first and _plain(first) in GERMAN_MONTHS:
            return -6.0
        if len(_plain(word)) <= 2 and _plain(_prior(text, at - len(word))) in ORDINAL_BEFORE:
            return -4.0
        return 5.0 if how not in ("lower", "function") else 2.0 if how == "lower" else 0.5
    if kind == "initial" and len(_plain(word)) == 1:
        # A unit after a number ("153 h.") is a word; else an initial or a letter of an abbreviation.
        last = _prior(text, at - len(word))
        if word.islower() and re.fullmatch(r"[-\d.,]*\d", last):
            return 4.0 if how not in ("lower", "function") else 2.5 if how == "lower" else 0.5
        return -3.0 if how == "opener" and word.isupper() and len(first) > 1 and last[-1:] != "." else -6.0
    if kind == "bound":
        if how == "opener" and len(first) > 1 and _plain(word) == "no":
            return 1.0
        return -8.0
    if kind == "dose":
        return 4.0 if how in ("upper", "opener", "digit", "other") else 2.0 if how == "lower" and _plain(word) not in ("i.v", "p.o", "i.p", "s.c", "i.m") else -4.0
    if kind == "open":
        w = _plain(word)
        if how == "opener":
            return 2.5
        if how in ("lower", "function"):
            return -5.0
        if w in ("std", "al", "min", "sec", "u.s", "u.k", "e.u", "jan", "feb", "sept", "oct", "nov", "dec"):
            return -4.0 if w != "al" or marks[:1] != "(" else -6.0
        return 2.0
    return -3.0 if how != "opener" else 0.5


def _word(text: str, start: int, at: int) -> str:
    """The word before a dot. Of one over LONG_WORD characters, of a script without spaces, the part from the last
    letter beyond ASCII on; an identifier of that length is a word like any other."""
    if at - start <= LONG_WORD:
        return text[start:at]
    near = text[at - LONG_WORD : at]
    k = next((k for k in range(LONG_WORD - 1, -1, -1) if not near[k].isascii()), 0)
    return near[k:]


def candidates(text: str, thai: bool) -> list[tuple[int, int, int, float, bool]]:
    """Possible ends: (place of the mark, end of the span, start of the next, score of closing and opening words
    together, whether a weak opening behind a mere dot follows)."""
    n = len(text)
    out = []
    last_at, word_start = -1, 0  # of the dot before: its place and where its word began
    first_start, first = -1, ""  # the first word at or behind a place, kept while it is the same
    for m in _CANDIDATE(text):
        at, end = m.start(), m.end()
        begin = end
        while begin < n and text[begin].isspace():
            begin += 1
        nxt = begin  # where the text goes on, for the eye
        while nxt < n and (text[nxt] in _INVISIBLE or text[nxt].isspace()):
            nxt += 1
        if nxt >= n:
            continue
        mark = m[0]
        body = mark.rstrip(_CLOSERS + " \n\t\xa0  " + _INVISIBLE)
        closers = mark[len(body) :].strip()
        c = text[nxt]
        if first_start < nxt:
            w = _NEXT_WORD(text, nxt)
            first_start, first = (w.start(), w[0]) if w else (n, "")
        weak = False
        if thai and "." in body:
            score = -4.0 if nxt > end else -9.0
        elif body in (".", "．"):
            i = at
            while i > last_at + 1 and text[i - 1] not in _BREAKS and not text[i - 1].isspace():
                i -= 1
            if i == last_at + 1 and last_at >= 0 and text[last_at] not in _BREAKS:
                i = word_start
            last_at, word_start = at, i
            score = _dot_score(text, at, end, nxt, closers, _word(text, i, at), first, text[nxt:first_start] if first else c)
            weak = bool(first) and score < 6.0 and nxt > end and not closers and _opening(first) in ("lower", "function", "digit")
        else:
            how = _opening(first) if first else "other"
            if set(body) <= {".", "…"}:
                score = 2.0 if nxt > end and how in ("upper", "opener") else -5.0
            else:
                quoted = any(x in "\"'”’»›“」』" for x in closers)
                if c in ",;:，、；：)）」』”":
                    score = -9.0
                elif quoted and nxt == end and how in ("lower", "function", "other"):
                    score = -6.0  # the sentence goes on right after the quotation
                elif quoted and how in ("lower", "function"):
                    score = -6.0
                elif how in ("lower", "function") and nxt == end and body[-1] in "!?":
                    score = -4.0
                else:
                    score = 6.0
        out.append((at, end, begin, score, weak))
    if thai:
        gaps = [m.span() for m in _THAI_GAP(text)]
        for k, (a, b) in enumerate(gaps):
            before = text[gaps[k - 1][1] if k else 0 : a]
            behind = text[b : gaps[k + 1][0] if k + 1 < len(gaps) else n]
            if a and b < n and _THAI.search(before) and _THAI.search(behind):
                out.append((a, a, b, 4.0, False))
        out.sort()
    return out


class _Spans:
    """What the scores of spans rest on: possible end j closes the spans that open behind end i < j; 0 is the text's
    start, k + 1 its end."""

    def __init__(self, text: str, ends: list[tuple[int, int, int, float, bool]], first: int, stop: int) -> None:
        k = len(ends)
        self.begin = [first] + [e[2] for e in ends]
        self.finish = [0] + [e[1] for e in ends] + [stop]
        self.words = [0.0] + [e[3] for e in ends] + [0.0]  # closing word and what opens behind it
        self.weak = [False] + [e[4] for e in ends]
        # How many quotations and brackets are open at each end. Those that stand by themselves, a sentence or
        # more as a whole, don't hold sentences back.
        self.depth = depth = [0] * (k + 2)
        if not _QUOTE.search(text):
            return
        closed, _ = pairs(text)
        starts = {e[2] for e in ends if e[3] > 0} | {first}
        finishes = {e[1] for e in ends if e[3] > 0} | {stop}
        marks = [e[0] for e in ends]
        for a, b, mark in closed:
            if mark not in "([（【" and a in starts and b + 1 in finishes:
                continue
            lo, hi = bisect_right(marks, a), bisect_left(marks, b)
            while hi > lo and ends[hi - 1][1] > b:
                hi -= 1
            if hi > lo:
                depth[lo + 1] += 1
                depth[hi + 1] -= 1
        for j in range(1, k + 2):
            depth[j] += depth[j - 1]
        depth[k + 1] = 0

    def score(self, i: int, j: int) -> float:
        """Of the span from behind end i to end j, closing and opening words behind it left out."""
        size = self.finish[j] - self.begin[i]
        out = 0.0
        if size < SHORT:
            if size < 3:
                out -= 4.0
            if self.weak[i]:
                out -= 5.0
        elif size > FREE:
            out -= (size - FREE) / FREE
        a, b = self.depth[i], self.depth[j]
        if a or b:
            out -= 8.0 if a != b else 6.0
        return out


def spans(text: str | None) -> list[tuple[int, int]]:
    """[start, end) of each sentence."""
    if not text:
        return []
    first = len(text) - len(text.lstrip())
    stop = len(text.rstrip())
    if first >= stop:
        return []
    ends = candidates(text, _THAI.search(text) is not None)
    if not ends:
        return [(first, stop)]
    sp = _Spans(text, ends, first, stop)
    begin, finish, depth, score = sp.begin, sp.finish, sp.depth, sp.score
    k = len(ends)
    # best[j]: the best chain whose last span closes at possible end j.
    best = [0.0] + [-1e18] * (k + 1)
    back = [0] * (k + 2)
    # Spans over FREE characters lose in proportion to their length, so that of the starts so far back the
    # one of the best score at each depth stands for all; only nearer starts are tried one by one.
    low = finish[:]
    for j in range(k, 0, -1):
        low[j] = min(low[j], low[j + 1])
    far: dict[int, tuple[float, int]] = {}
    near = 0
    for j in range(1, k + 2):
        top, at = -1e18, 0
        while near < j and begin[near] + FREE < low[j]:
            v = best[near] + begin[near] / FREE
            if depth[near] not in far or v > far[depth[near]][0]:
                far[depth[near]] = (v, near)
            near += 1
        for i in (*sorted(x[1] for x in far.values()), *range(near, j)):
            s = best[i] + score(i, j)
            if s > top:
                top, at = s, i
        best[j], back[j] = top + sp.words[j], at
    out = []
    j = k + 1
    while j:
        out.append((begin[back[j]], finish[j]))
        j = back[j]
    return out[::-1]


def split(df: DataFrame) -> DataFrame:
    """(tab, row_key, text) -> (tab, row_key, start_pos, end_pos): one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, ends = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                for a, b in spans(t):
                    at.append(i)
                    starts.append(a)
                    ends.append(b)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["tab", "row_key", "start_pos", "end_pos"])

    return df.select("tab", "row_key", "text").mapInArrow(run, "tab string, row_key long, start_pos int, end_pos int")


def found(articles: DataFrame, relations: DataFrame) -> DataFrame:
    a = articles.select(F.lit("articles").alias("tab"), F.col("article_ord").cast("long").alias("row_key"), F.col("abstract").alias("text"))
    r = relations.select(F.lit("relations").alias("tab"), F.col("rel_ord").cast("long").alias("row_key"), F.col("sentence").alias("text"))
    return split(a.unionByName(r).where(F.col("text").isNotNull()))
