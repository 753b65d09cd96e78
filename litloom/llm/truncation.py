"""Problem 10: text cut off by field limits.

Method: discrete length hazards. For each source the hazard of a length L is the share of texts that
end at L among those that reach it, in characters and in bytes, computed by window
functions over the counts of the distinct lengths. Each hazard is tested against the pooled hazard of
neighbouring lengths, with false-discovery control (Benjamini-Hochberg) over all lengths of the source.
A limit in one unit piles up lengths in the other as well, so the unit of the stronger limits is kept
first and the other is tested on the texts that those limits leave unexplained.

Endings are classed as closed, doubtful (a mark that may stand inside a sentence: a number's or an
abbreviation's dot, a quotation that a sentence may go on behind), bare (whole without a closing mark:
list lines, Thai) or open (mid-word or mid-sentence). Two classes of cut are told apart:

- ``limit``: at a significant length every incomplete ending counts: open, doubtful and bare.
- ``transfer``: a transfer breaks off at any length, so away from significant lengths open endings
  count, and only those.

Defined cases: null, empty and blank texts are not cut and have no part in the length tests, but
in the documents of their source if asked for; null sources form a group of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.session import cut

from .sentences import _INVISIBLE, _kind, _plain, pairs

#: Neighbours of L: lengths from NEAR to FAR away on either side; nearer ones may share its limit.
NEAR, FAR = 16, 60
ALPHA = 0.001
#: A significant length must end at least so many times as many texts as its neighbours let expect.
RATIO = 5.0

# Signs set after a cut.
_MARK = re.compile(r"\s*(?:…|\.\.\.|\[\s*(?:\.\.\.|…)\s*\]|[\[(]\s*(?:truncated|more|cut|continued|abridged|read more|text truncated)\s*[\])])\s*$", re.I)
_FINAL = re.compile(r"[.!?。！？।॥؟][\"'”’»›“)\]」』）】]*\Z|[.!?]\s?[»›]\Z")
_DOT_END = re.compile(r"([^\s(\[{（「『“„«\"'‘,;:]*)\.\Z")
# Lines that close a text without a closing mark.
_LIST_LINE = re.compile(r"(?:Key ?words|See also|Funding|Registered as|Trial registration|Subjects?|Tags|Abbreviations|Correspondence|Mots[- ]clés|Palabras clave|Schlüsselwörter|Schlagwörter|关键词|キーワード)\b", re.I)
_SIGN_OFF = re.compile(r"(?:©|\(c\)\s|Copyright\b|[-–—=*_]{2,}.*[-–—=*_]{2,}\Z)", re.I)
_THAI_END = re.compile(r"[฀-๿]")
_QUOTES = "\"'”’»›“」』"
_STARTS = re.compile(r"[.!?。！？।؟]\W*\s\W*\Z|[。！？]\W*\Z|\n\s*\n\W*\Z|\A\W*\Z")
_UNSPACED_NUMBER = re.compile(r"[^\x00-\x7F]([-\d,]+)\Z")
_BULLET = re.compile(r"(?:[-•*–]|\d{1,2}[.)])\s+\S")

CLOSED, BARE, DOUBTFUL, OPEN = range(4)


def ending(text: str | None, kind: str | None = None) -> int:
    """How a text ends: closed, bare, doubtful or open."""
    if text is None:
        return CLOSED
    t = text.rstrip()
    while t and t[-1] in _INVISIBLE:
        t = t[:-1].rstrip()
    if not t:
        return CLOSED
    m = _MARK.search(t)
    marked = m is not None and m.start() > 0
    if marked:
        t = t[: m.start()].rstrip()
    if t[-1:] == "�":
        return OPEN
    line = t[t.rfind("\n") + 1 :].strip()
    has_lines = "\n" in t
    if (kind or "").strip().lower() == "title" and not marked:
        return CLOSED
    if has_lines and _SIGN_OFF.match(line):
        return CLOSED if len(line) > 12 else BARE
    if has_lines and _LIST_LINE.match(line) and not marked:
        if line.count("[") + line.count("(") > line.count("]") + line.count(")") or line[-1] in ",;/-:–[(":
            return OPEN
        if line.lower().startswith("funding") and line[-1] not in ").":
            return OPEN
        if line.lower().startswith("registered as"):
            return CLOSED if re.search(r"\d{6,}\Z", line) else OPEN
        return CLOSED if line[-1] in "])." else BARE
    if _FINAL.search(t):
        done, unclosed = pairs(t)
        if unclosed:
            # Something opened in the last sentence still waits for its end.
            if "\n\n" not in t[unclosed[-1] :]:
                return OPEN
        d = _DOT_END.search(t)
        if d:
            word = d[1]
            k = _kind(word)
            prior = t[: d.start(1)].split()[-1:] or [""]
            w = _plain(word)
            tail = _UNSPACED_NUMBER.search(word)  # a number behind a script without spaces
            if tail:
                word = w = tail[1]
            if k == "bound" or k == "initial" and not (len(w) == 1 and re.fullmatch(r"[-\d.,]*\d", prior[0])):
                return OPEN
            if k == "open" and w in ("al", "u.s", "u.k", "std", "e.u"):
                return OPEN
            if k == "dose" and w in ("i.v", "p.o", "i.p", "s.c", "i.m"):
                return OPEN
            if re.fullmatch(r"[-\d,]+", word):
                if len(w) <= 2 and _plain(prior[0]) in ("am", "vom", "zum", "im"):
                    return OPEN
                if len(w) != 4:
                    return OPEN if marked else DOUBTFUL
            elif k in ("open", "dose"):
                return OPEN if marked else DOUBTFUL
        elif t[-1] in _QUOTES and _goes_on(t, done):
            return OPEN if marked else DOUBTFUL
        return CLOSED
    if _THAI_END.search(line):
        return OPEN if marked else BARE
    if has_lines and _BULLET.match(line) and not marked:
        return BARE
    return OPEN


def _goes_on(t: str, done: list[tuple[int, int, str]]) -> bool:
    """Whether a quotation that ends the text stands behind words of its own sentence."""
    a = next((a for a, b, mark in done if b == len(t) - 1), None)
    return a is not None and not _STARTS.search(t[:a])


def endings(docs: DataFrame) -> DataFrame:
    """(doc_id, source, chars, bytes, how): one pass over whole texts; only sizes and the class remain. Blank texts have no sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            how = pa.array([ending(t, k) for t, k in zip(b.column(4).to_pylist(), b.column(5).to_pylist())], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], how], names=["doc_id", "source", "chars", "bytes", "how"])

    seen = F.col("text").rlike(r"(?U)\S")
    src = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("source", F.lit("\x00")).alias("source"), F.when(seen, F.length("text").cast("int")).alias("chars"),
        F.when(seen, F.octet_length("text").cast("int")).alias("bytes"), F.col("text").cast("string"), F.col("doc_kind").cast("string"),
    )
    return src.mapInArrow(run, "doc_id long, source string, chars int, bytes int, how int")


def hazard_tests(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """counts (source, unit, size, d) -> those of significant hazard, with risk, expected and log_p.

    The windows hold distinct lengths, not texts, however many texts a source has."""
    each = Window.partitionBy("source", "unit")
    after = each.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    below, above = each.orderBy("size").rangeBetween(-FAR, -NEAR), each.orderBy("size").rangeBetween(NEAR, FAR)
    c = counts.withColumn("risk", F.sum("d").over(after))
    zero = F.lit(0.0)
    near_d = F.coalesce(F.sum("d").over(below), zero) + F.coalesce(F.sum("d").over(above), zero)

    def reach(k: int):
        """Texts at risk, summed over all lengths from size + k on, those at which none ends included."""
        least = F.greatest(F.col("size") + k, F.lit(1))
        longer = each.orderBy(F.desc("size")).rangeBetween(Window.unboundedPreceding, -k)
        return F.coalesce(F.sum(F.col("d") * F.col("size")).over(longer) - (least - 1) * F.sum("d").over(longer), F.lit(0))

    near_risk = reach(-FAR) - reach(1 - NEAR) + reach(NEAR) - reach(FAR + 1)
    # The neighbours' hazard: their ends over the texts that reach them. Near the shortest and the longest
    # text there are fewer neighbours; each that exists is reached by one text at least.
    there = F.least(F.lit(FAR - NEAR + 1), F.greatest(F.col("size") - NEAR, F.lit(0))) + F.least(F.lit(FAR - NEAR + 1), F.greatest(F.max("size").over(each) - F.col("size") - NEAR + 1, F.lit(0)))
    c = c.withColumns({"near_d": near_d, "near_risk": F.greatest(near_risk, there, F.lit(1))})
    c = c.withColumn("expected", F.col("risk") * (F.col("near_d") + 0.5) / F.col("near_risk"))
    lam, d = F.col("expected"), F.col("d").cast("double")
    # Chernoff's bound of the Poisson tail: conservative, so false discoveries stay controlled.
    c = c.withColumn("log_p", F.when(d > lam, -(d * F.log(d / lam) - d + lam)).otherwise(zero))
    # Every length is a test: the count of tests and the ranks of p include those of a single text.
    c = c.withColumn("m", F.count("*").over(each)).withColumn("rank", F.row_number().over(each.orderBy("log_p", "size")))
    c = c.withColumn("ok", F.col("log_p") + F.log(F.col("m") / F.col("rank")) <= F.log(F.lit(alpha)))
    c = c.withColumn("largest", F.max(F.when(F.col("ok"), F.col("log_p"))).over(each))
    return c.where((F.col("log_p") <= F.col("largest")) & (d >= RATIO * lam)).select("source", "unit", "size", "d", "risk", "expected", "log_p")


def significant_lengths(sizes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(source, unit, size, d, risk, expected, log_p) whose hazard stands out from its neighbours'.

    sizes: (source, chars, bytes) a text, pre-aggregated to a row a pair of lengths. Both units are tested; the one whose limits are the stronger stays
    (both, if equal), the other is tested again on texts not at those limits."""
    pairs_ = cut(sizes.where(F.col("chars").isNotNull()).groupBy("source", "chars", "bytes").agg(F.count("*").alias("d")))

    def counts(of: DataFrame) -> DataFrame:
        unit = F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "size")
        return of.select("source", "d", unit).groupBy("source", "unit", "size").agg(F.sum("d").alias("d"))

    both = cut(hazard_tests(counts(pairs_), alpha))
    by_unit = both.groupBy("source").agg(*[F.coalesce(F.sum(F.when(F.col("unit") == u, -F.col("log_p"))), F.lit(0.0)).alias(f"of_{u}") for u in ("chars", "bytes")])
    own, other_unit = (F.when((F.col("unit") == "chars") == F.lit(x), F.col("of_chars")).otherwise(F.col("of_bytes")) for x in (True, False))
    first = both.join(by_unit, "source").where(own >= other_unit).drop("of_chars", "of_bytes")  # both units if they say the same
    rest = pairs_
    for u in ("chars", "bytes"):
        rest = rest.join(first.where(F.col("unit") == u).select("source", F.col("size").alias(u)), ["source", u], "left_anti")
    # Of a source without limits nothing is left to explain; of the others the kept unit isn't tested anew.
    other = counts(rest).join(first.select("source").distinct(), "source", "left_semi").join(first.select("source", "unit").distinct(), ["source", "unit"], "left_anti")
    return first.unionByName(hazard_tests(other, alpha))


def cut_documents(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, source, how, at_limit, has_text, cut) of every document; cut: limit, transfer or null."""
    ends = cut(endings(docs))
    limits = cut(significant_lengths(ends, alpha))
    out = ends
    for u in ("chars", "bytes"):
        out = out.join(limits.where(F.col("unit") == u).select("source", F.col("size").alias(u), F.lit(True).alias(f"at_{u}")), ["source", u], "left")
    out = out.select("doc_id", "source", "how", F.coalesce("at_chars", "at_bytes", F.lit(False)).alias("at_limit"), F.col("chars").isNotNull().alias("has_text"))
    return out.withColumn("cut", F.when(F.col("at_limit") & F.col("how").isin(OPEN, DOUBTFUL, BARE), "limit").when(F.col("how") == OPEN, "transfer"))


def found(docs: DataFrame) -> DataFrame:
    return cut_documents(docs).where(F.col("cut").isNotNull()).select("doc_id")


def sources(docs: DataFrame, blank: bool = False) -> DataFrame:
    """(source, n_docs, n_cut, share, n_at_limit): how often each source truncates, the rest of n_cut being
    transfers; blank: of all its documents, not only of those with text."""
    flags = cut_documents(docs)
    out = (flags if blank else flags.where("has_text")).groupBy("source").agg(F.count("*").alias("n_docs"), F.count("cut").alias("n_cut"), F.count_if(F.col("cut") == "limit").alias("n_at_limit"))
    return out.select(F.nullif("source", F.lit("\x00")).alias("source"), "n_docs", "n_cut", (F.col("n_cut") / F.col("n_docs")).alias("share"), "n_at_limit")
