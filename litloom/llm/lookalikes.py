"""Problem 4: text that looks the same, written with different characters.

Method: a compiled longest-match transducer over grapheme clusters. A mapping of single characters
(widths, spaces, invisible characters, ligatures, look-alike letters) is built once from the Unicode
data by rule, checked for conflicts (its targets hold no sources, so one pass is enough), and
compiled into a pattern whose matches are the longest clusters that need rewriting: a base with its
marks, or a run of mapped characters, or a run of white space. Each cluster is rewritten once and kept.

The form is a key to compare by, not a text to print: letters of other alphabets come out as the Latin
letters that they look like, in words of their own alphabet too. Defined cases: null stays null; blank text becomes empty; letter case, accents and the presence of
hyphens stay as they are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litloom.operators.skew import join_hot
from litloom.session import cut

# Letters of other alphabets drawn like a Latin letter.
CYRILLIC_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
}
GREEK_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o",
}
CHEROKEE_ALIKE = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W", "Ꮪ": "S", "Ꮩ": "V",
    "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
HYPHENS = {"‐": "-", "‑": "-"}
# Compatibility characters drawn differently from what they stand for.
DRAWN_APART = "ſϐϑϒϕϖϰϱϲϴϵϹẚẛ"


@cache
def mapping() -> dict[str, str]:
    """Character -> what it is drawn like. Targets hold no sources and are composed."""
    alike = {**CYRILLIC_ALIKE, **GREEK_ALIKE, **CHEROKEE_ALIKE, **HYPHENS}
    out: dict[str, str] = {}
    for o in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000 or 0xAC00 <= o < 0xD7A4:
            continue
        c = chr(o)
        cat = unicodedata.category(c)
        if cat in ("Cn", "Co"):
            continue
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if c in alike:
            out[c] = alike[c]
        elif cat == "Zs":
            out[c] = " "
        elif cat == "Cf" and not unicodedata.bidirectional(c) == "AN" and not 0x110BD <= o <= 0x110CD:
            out[c] = ""
        elif 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180D or o == 0x034F:
            out[c] = ""  # variation selectors and the grapheme joiner are not drawn
        elif tag == "<font>" and 0x1D400 <= o <= 0x1D7FF:
            out[c] = chr(int(rest, 16))  # mathematical letters: the same letter in another weight or slant
        elif tag in ("<wide>", "<narrow>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>") and c not in DRAWN_APART and not rest.startswith("0020 03"):
            out[c] = "".join(chr(int(x, 16)) for x in rest.split())
        elif unicodedata.normalize("NFC", c) != c:
            out[c] = unicodedata.normalize("NFC", c)
        elif tag and not tag.startswith("<") and (d := unicodedata.normalize("NFD", c))[0] in alike:
            out[c] = alike[d[0]] + d[1:]  # a look-alike with its accent
    for c in out:  # resolve chains, then check
        for _ in range(4):
            out[c] = unicodedata.normalize("NFC", "".join(out.get(x, x) for x in out[c]))
    clash = [c for c, t in out.items() if any(x in out for x in t) or unicodedata.normalize("NFC", t) != t]
    if clash:
        raise ValueError(f"conflicting look-alikes: {clash[:5]}")
    return out


def _char_class(chars) -> str:
    """Ranges of a regular expression's class."""
    codes, parts = sorted(map(ord, chars)), []
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(re.escape(chr(codes[i])) + ("-" + re.escape(chr(codes[j])) if j > i else ""))
        i = j + 1
    return "".join(parts)


class _Clusters(dict):
    def __init__(self, table: dict[str, str]) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, cluster: str) -> str:
        get = self.table.get
        s = unicodedata.normalize("NFC", "".join([get(c, c) for c in cluster]))
        s = re.sub(r"\s+", " ", s)
        if len(self) < 100_000 and len(cluster) < 64:
            self[cluster] = s
        return s


@cache
def transducer():
    table = mapping()
    marks = [chr(o) for o in range(0x300, 0x110000) if not 0xD800 <= o < 0xE000 and unicodedata.combining(chr(o))]
    odd = _char_class(table)
    mark = _char_class([*marks, "ﾞ", "ﾟ"])
    space = r"\s"
    # Longest first: a base with marks (unmarked invisible characters may stand between), else a run of
    # mapped characters and white space, else two or more white spaces or one that isn't a space.
    pattern = re.compile(f"(?:[^{space}{mark}](?:[{odd}]*[{mark}])+|[{odd}]+|{space}{{2,}}|[^\\S ])(?:[{odd}{mark}]|(?<={space}){space}|{space}(?=[{odd}{space}]))*")
    return pattern.sub, _Clusters(table)


def normalise(text: str | None) -> str | None:
    if text is None:
        return None
    sub, clusters = transducer()
    s = sub(lambda m: clusters[m[0]], text)
    return re.sub(r" {2,}", " ", s).strip()


@F.pandas_udf(T.StringType())
def _normalise_wide(s: pd.Series) -> pd.Series:
    return s.map(normalise)


def one_form(x: Column) -> Column:
    """The consistent form of a text column; ASCII stays in the JVM."""
    ascii_only = ~x.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, F.trim(F.regexp_replace(x, r"[\s\x1c-\x1f]+", " "))).otherwise(_normalise_wide(F.when(~ascii_only, x)))


def canonical_values(df: DataFrame, id_col: str, fields: list[str], scope: str | None = None) -> DataFrame:
    """(field, scope, id, raw, form): each value beside its consistent form, empty if it has nothing to see."""
    values = df.select(F.col(id_col).cast("long").alias("id"), (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields])).alias("v"))
    values = values.select("id", "scope", "v.field", "v.raw").where(F.col("raw").isNotNull() & F.col("scope").isNotNull())
    # No filter on the form here: pushed below, it would normalise every value twice.
    return values.where(F.trim("raw") != "").select("field", "scope", "id", "raw", one_form(F.col("raw")).alias("form"))


def forms(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field, id, form): the consistent form of each value; null stays null, blank is empty."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields]))
    values = df.select(F.col(id_col).cast("long").alias("id"), each.alias("v"))
    return values.select("v.field", "id", one_form(F.col("v.raw")).alias("form"))


def same_look(values: DataFrame) -> DataFrame:
    """(field, id_a, id_b): rows that look like the least id of their class but are stored otherwise.

    Only digests are written and shuffled. Classes are found with map-side combining, and those with one stored
    value are dropped before the join, in which no class is hot: a class of a third of all rows is no hot task.
    """
    digests = values.select("field", "id", F.unhex(F.md5(F.concat_ws("\x1f", "scope", "form"))).alias("k"), F.unhex(F.md5("raw")).alias("r"), (F.col("form") == "").alias("blank"))
    digests = cut(digests).where("NOT blank").drop("blank")
    classes = digests.groupBy("field", "k").agg(F.min(F.struct("id", "r")).alias("first"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    classes = classes.select("field", "k", "n", F.col("first.id").alias("id_a"), F.col("first.r").alias("r_a"))
    return join_hot(digests, classes, ["field", "k"], "n").where("r <> r_a").select("field", "id_a", F.col("id").alias("id_b"))


def found(articles: DataFrame, entities: DataFrame) -> DataFrame:
    a = canonical_values(articles, "article_ord", ["title", "abstract"])
    return same_look(a.unionByName(canonical_values(entities, "entity_id", ["normalized"], "pmid")))
