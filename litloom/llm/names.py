"""Problem 5: variant spellings of names typed by people, linked to an authority list.

Method: suffix blocking. The suffixes of a name's tokens, from ``MIN_SUFFIX`` letters up to the whole
token, are its block keys; a shorter token is a key as a whole, refined from the start. A suffix that too
many listed names share isn't discarded outright: it is refined with the initials of the name's other
tokens, and every name of a refined key is kept, however many share it. Keys are made in the JVM.

Names that share a key are compared by the ratio of their longest common subsequence: twice its length
over the letters of both, summed over the parts that stand for each other, and linked if it reaches
``RATIO``. What spellings do to names are features of the comparison: a nickname is compared as the name
it stands for, an initial or abbreviation by the letters that it has, reordered parts in each order
that they may have; contradictions (another known given name, another second initial, slips in both
parts) rule a pair out.

Each distinct spelling is linked once and joined back without hot keys, so a name that fills a third of
the rows costs one comparison. Defined cases: null, blank and letterless names mean nobody; a spelling that
equals its listed form isn't a variant; of equally good listed names ``links`` gives all, marked as
ambiguous, and ``found`` none; repeated rows link each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.operators.skew import join_hot
from litloom.session import cut

MIN_SUFFIX = 4
#: A suffix of more listed names than this is refined.
COMMON = 8
#: Least ratio of the whole name, and of a token of a title; calibrated on slips made at random (tests).
RATIO, TOKEN_RATIO = 0.72, 0.75

# Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sandy xander lex alec", "anthony": "tony ant", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby",
    "edward": "ed eddie ted teddy ned", "elizabeth": "liz lizzie beth betty eliza libby betsy", "francisco": "paco pancho frank curro", "giuseppe": "beppe pino peppe",
    "gregory": "greg", "james": "jim jimmy jamie", "johannes": "hans jan", "joseph": "joe joey", "katherine": "kate kathy katie kat kitty", "margaret": "maggie meg peggy marge greta",
    "michael": "mike mick mickey", "nicholas": "nick nicky", "patricia": "pat patty trish tricia patsy", "rebecca": "becky becca", "richard": "dick rick rich ricky",
    "robert": "bob bobby rob robbie bert", "samuel": "sam sammy", "susan": "sue susie suzy", "thomas": "tom tommy", "victoria": "vicky vicki tori", "william": "bill billy will willy liam",
    "andrew": "andy drew", "benjamin": "ben", "catherine": "cathy cate", "charles": "charlie chuck", "david": "dave", "john": "johnny jack", "matthew": "matt", "peter": "pete",
    "stephen": "steve", "steven": "steve", "timothy": "tim", "kenneth": "ken", "lawrence": "larry", "jennifer": "jen jenny", "jessica": "jess", "pamela": "pam", "barbara": "barb",
}
FULL_OF = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        FULL_OF.setdefault(_s, set()).add(_full)
TITLES = set("dr prof professor mr mrs ms md phd msc mph rn dsc frcp sir dame jr sr ii iii".split())
SMALL = set("the of in and for on a an de la".split())
ACRONYMS = {"wp": ["working", "party"], "sg": ["study", "group"], "rn": ["research", "network"], "cons": ["consortium"], "grp": ["group"], "dis": ["disease"]}


@lru_cache(100_000)
def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", s.casefold()).replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("ı", "i")
    return "".join([c for c in s if not unicodedata.combining(c)])


def tokens(s: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", fold(s))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


@lru_cache(200_000)
def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def alike(a: str, b: str, least: float) -> bool:
    """Whether the common subsequence leaves out one letter at most of the longer, or its ratio is high."""
    if a == b:
        return True
    common, longer = lcs(a, b), max(len(a), len(b))
    return common >= longer - 1 and longer > 1 or 2.0 * common >= least * (len(a) + len(b))


@lru_cache(200_000)
def _listed_person(listed: str) -> tuple[str, tuple[str, ...]]:
    last, _, first = listed.partition(",")
    return "".join(tokens(last)), tuple(tokens(first))


@lru_cache(20_000)
def _parses(typed: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(surname, given names) in each order that a typed name may have."""
    head, comma, tail = fold(typed.strip()).partition(",")
    given = tokens(tail)
    if comma and given and not set(given) <= TITLES:
        return (("".join(t for t in tokens(head) if t not in TITLES), tuple(t for t in given if t not in TITLES or len(t) == 1)),)
    toks = tokens(typed)
    while toks and toks[0] in TITLES:
        toks = toks[1:]
    trimmed = toks
    while len(trimmed) > 2 and trimmed[-1] in TITLES:
        trimmed = trimmed[:-1]
    out = {}
    for t in (trimmed, toks):
        if len(t) > 1:
            out |= {(t[-1], tuple(t[:-1])): None, (t[0], tuple(t[1:])): None}
    return tuple(out)


def _given(typed: tuple[str, ...], listed: tuple[str, ...], known: str) -> tuple[float, float, bool] | None:
    """(twice the common letters, letters of both, whether there is a slip) of given names; None: they contradict."""
    first, want = typed[0], listed[0]
    if len(typed) == 1 and len(first) == 2 and len(listed) == 2 and first == want[0] + listed[1][0]:
        return 4.0, 4.0, False  # initials written together
    others = [t[0] for t in typed[1:]], [t[0] for t in listed[1:]]
    if others[0] and others[1] and others[0][0] != others[1][0]:
        return None
    extra = float(abs(len(typed) - len(listed)))  # a second name that only one side has counts by its initial
    if len(first) == 1:
        return (2.0, 2.0 + extra, False) if first == want[0] else None
    if first == want or want in FULL_OF.get(first, ()) or FULL_OF.get(first, set()) & FULL_OF.get(want, set()):
        return 2.0 * len(want), 2.0 * len(want) + extra, False
    if f" {first} " in known or len(want) < 3 or not alike(first, want, 0.85):
        return None
    return 2.0 * lcs(first, want), len(first) + len(want) + extra, True


def person_score(typed: str, listed: str, known: str) -> float:
    """The ratio of a person's name; known: which typed tokens are listed people's given names, between blanks."""
    want_last, want_first = _listed_person(listed)
    best = 0.0
    for sur, giv in _parses(typed):
        if not sur or not giv or not want_first:
            continue
        if sur == want_last:
            common = 2.0 * len(sur)
        elif len(want_last) > 3 and alike(sur, want_last, 0.9):
            common = 2.0 * lcs(sur, want_last)
        else:
            continue
        g = _given(giv, want_first, known)
        if g is not None and not (g[2] and sur != want_last):
            best = max(best, (common + g[0]) / (len(sur) + len(want_last) + g[1]))
    return best


@lru_cache(200_000)
def _title_tokens(s: str) -> tuple[str, ...]:
    s = re.sub(r"[\[(][^\])]*[\])]\s*\.?\s*$", "", s.strip())
    head, comma, tail = s.partition(",")
    if comma and tail.strip():
        s = f"{tail} {head}"
    out: list[str] = []
    for t in tokens(s.replace("&", " and ")):
        if t not in SMALL:
            out += ACRONYMS.get(t, [t])
    return tuple(out)


def title_score(typed: str, listed: str) -> float:
    """The ratio of a group's or journal's name: tokens stand for each other in order, an abbreviation for its
    letters; a token whose own ratio is under ``TOKEN_RATIO`` contradicts."""
    a, b = _title_tokens(typed), _title_tokens(listed)
    if len(a) != len(b) or not b or len(a[0]) < 3:
        return 0.0
    common = letters = 0.0
    for x, y in zip(a, b):
        if y.startswith(x):
            common, letters = common + 2.0 * len(x), letters + 2.0 * len(x)
            continue
        if ratio(x, y) < TOKEN_RATIO or len(y) < 4 and not alike(x, y, 1.0):
            return 0.0
        common, letters = common + 2.0 * lcs(x, y), letters + len(x) + len(y)
    return common / letters


# --- keys, in the JVM -------------------------------------------------------------------------------


@cache
def _letters() -> tuple[str, str]:
    """Letters beyond ASCII whose folded form is one ASCII letter, and these."""
    pairs = [(c, fold(c)) for o in range(0x80, 0x20000) if not 0xD800 <= o < 0xE000 and (c := chr(o)).isalpha()]
    pairs = [(c, f) for c, f in pairs if len(f) == 1 and f.isascii()]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


def token_column(name: Column) -> Column:
    """The tokens of a name as an array, folded; titles and small words left out."""
    low = F.lower(name)
    plain = F.regexp_replace(F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), *_letters()), r"\p{M}+", "")
    toks = F.regexp_extract_all(F.when(low.rlike(r"[^\x00-\x7F]"), plain).otherwise(low), F.lit(r"(\p{L}+)"), 1)
    return F.filter(toks, lambda t: ~t.isin(*sorted(TITLES | SMALL)))


def key_column(name: Column) -> Column:
    """[{suffix, refined}]: block keys of a name. Of tokens under MIN_SUFFIX letters both are the token refined by
    another one's initial; single letters are no keys."""
    toks = token_column(name)

    def of_token(t: Column, i: Column) -> Column:
        initials = F.array_distinct(F.transform(F.filter(toks, lambda u, j: j != i), lambda u: F.left(u, F.lit(1))))
        initials = F.when(F.size(initials) > 0, initials).otherwise(F.array(F.lit("")))
        n = F.length(t)
        ends = F.when(n >= MIN_SUFFIX, F.transform(F.sequence(F.lit(MIN_SUFFIX), n), lambda k: F.right(t, k))).when(n > 1, F.array(t)).otherwise(F.array().cast("array<string>"))

        def refined(e: Column) -> Column:
            return F.transform(initials, lambda x: F.struct(F.when(n >= MIN_SUFFIX, e).otherwise(F.concat(e, F.lit("+"), x)).alias("suffix"), F.concat(e, F.lit("+"), x).alias("refined")))

        return F.flatten(F.transform(ends, refined))

    return F.array_distinct(F.flatten(F.transform(toks, of_token)))


def spellings(articles: DataFrame) -> DataFrame:
    """(article_ord, slot, kind, name) of each typed author (slot from 0) and journal (slot -1)."""
    a = articles.select("article_ord", F.posexplode("authors").alias("slot", "name"), F.lit("author").alias("kind"))
    j = articles.select("article_ord", F.lit(-1).alias("slot"), F.col("journal").alias("name"), F.lit("journal").alias("kind"))
    return a.unionByName(j).where(F.col("name").isNotNull() & (F.trim("name") != "")).select("article_ord", "slot", "kind", "name")


def authority(author_ref: DataFrame, journal_ref: DataFrame) -> DataFrame:
    """(ref_id, kind, sort, listed)."""
    a = author_ref.select(F.col("author_id").alias("ref_id"), F.lit("author").alias("kind"), F.col("kind").alias("sort"), F.col("full_name").alias("listed"))
    return a.unionByName(journal_ref.select(F.col("journal_id").alias("ref_id"), F.lit("journal").alias("kind"), F.lit("journal").alias("sort"), F.col("full_title").alias("listed")))


def _with_keys(names: DataFrame, *carried: str) -> DataFrame:
    """(kind, name, carried, suffix, refined) of distinct (kind, name)."""
    return names.select("kind", "name", *carried, F.explode(key_column(F.col("name"))).alias("k")).select("kind", "name", *carried, "k.suffix", "k.refined")


def block_index(refs: DataFrame) -> DataFrame:
    """(kind, key, listed): rare suffixes by themselves, common ones refined."""
    k = _with_keys(refs.select("kind", F.col("listed").alias("name")).distinct())
    plain = k.select("kind", "suffix", "name").distinct().groupBy("kind", "suffix").agg(F.count("*").alias("n"))
    k = k.join(plain, ["kind", "suffix"])
    return k.select("kind", F.when(F.col("n") <= COMMON, F.col("suffix")).otherwise(F.col("refined")).alias("key"), F.col("name").alias("listed")).distinct()


def with_known(typed: DataFrame, refs: DataFrame) -> DataFrame:
    """typed with ``known``: those of a name's tokens that are given names of listed people, between blanks."""
    given = refs.where("sort = 'person'").select(F.explode(token_column(F.split_part("listed", F.lit(","), F.lit(2)))).alias("t")).where(F.length("t") > 2).distinct()
    each = typed.where("kind = 'author'").select("kind", "name", F.explode(F.array_distinct(token_column(F.col("name")))).alias("t"))
    known = each.join(given, "t", "left_semi").groupBy("kind", "name").agg(F.concat(F.lit(" "), F.concat_ws(" ", F.collect_set("t")), F.lit(" ")).alias("known"))
    return typed.join(known, ["kind", "name"], "left").withColumn("known", F.coalesce("known", F.lit("")))


def links(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(kind, name, n, ref_id, score, ambiguous): distinct spellings with the listed name of the greatest ratio, or
    each of them if several are equally good; n: the rows of the spelling. Exact forms are left out."""
    typed = names.groupBy("kind", "name").agg(F.count("*").alias("n")).join(refs.select("kind", F.col("listed").alias("name")), ["kind", "name"], "left_anti")
    wanted = _with_keys(with_known(typed, refs), "known", "n").select("kind", "name", "known", "n", F.explode(F.array_distinct(F.array("suffix", "refined"))).alias("key"))
    pairs = wanted.join(block_index(refs), ["kind", "key"]).select("kind", "name", "known", "n", "listed").distinct().join(refs, ["kind", "listed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            typed_, listed, known, sort = (b.column(i).to_pylist() for i in range(4))
            score = pa.array([person_score(t, x, k) if s == "person" else title_score(t, x) for t, x, k, s in zip(typed_, listed, known, sort)], pa.float64())
            out = pa.RecordBatch.from_arrays([b.column(4), b.column(0), b.column(5), b.column(6), score], names=["kind", "name", "n", "ref_id", "score"])
            yield out.filter(pa.compute.greater_equal(score, RATIO))

    good = cut(pairs.select("name", "listed", "known", "sort", "kind", "n", "ref_id").mapInArrow(run, "kind string, name string, n long, ref_id long, score double"))
    top = good.groupBy("kind", "name").agg(F.max("score").alias("score"))
    best = good.join(top, ["kind", "name", "score"])
    one = best.groupBy("kind", "name").agg((F.min("ref_id") != F.max("ref_id")).alias("ambiguous"))
    return best.join(one, ["kind", "name"]).select("kind", "name", "n", "ref_id", "score", "ambiguous").distinct()


def found(articles: DataFrame, author_ref: DataFrame, journal_ref: DataFrame) -> DataFrame:
    names = spellings(articles)
    sure = links(names, authority(author_ref, journal_ref)).where("NOT ambiguous").select("kind", "name", "n", "ref_id")
    return join_hot(names, sure, ["kind", "name"], "n").select("article_ord", "slot", "ref_id")
