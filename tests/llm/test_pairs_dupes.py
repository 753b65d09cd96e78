"""Pairs and duplicates against plain versions; large baskets, hot groups, nulls, ties, empty tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from litloom.llm import dupes, pairs

ART = "pmid string, mesh_terms array<string>, keywords array<string>, field string, basket string"


def plain_pairs(rows):
    baskets = {"mesh_terms": defaultdict(set), "keywords": defaultdict(set)}
    for pmid, mesh, words, *_ in rows:
        if pmid is None or not re.fullmatch(r"[0-9]{1,8}", pmid):
            continue
        for f, items in (("mesh_terms", mesh), ("keywords", words)):
            for x in items or []:
                if x is not None:
                    x = " ".join(x.lower().split())
                    x = x.split(" / ")[0].strip() if f == "mesh_terms" else x
                    if x:
                        baskets[f][pmid].add(x)
    out = {}
    for f, b in baskets.items():
        n = Counter(x for s in b.values() for x in s)
        ab = Counter(p for s in b.values() for p in itertools.combinations(sorted(s), 2))
        for (x, y), k in ab.items():
            out[f, x, y] = (k, n[x], n[y], len(b))
    return out


def test_pairs_with_large_baskets(spark):
    random.seed(1)
    vocabulary = [f"i{k}" for k in range(40)] + ["Ä b", "é"]
    rows = [(str(random.randrange(60)), random.choices(vocabulary, k=random.randrange(30)), random.choices(["X / y", " x ", "Y", "", None], k=3), None, "z") for _ in range(150)]
    rows += [("7", vocabulary, vocabulary, None, None), (None, ["a", "b"], None, None, None), ("123456789", ["a", "b"], [], None, None), ("1x", ["a", "b"], [], None, None), ("8", None, None, None, None)]
    items = pairs.baskets(spark.createDataFrame(rows, ART))
    want = plain_pairs(rows)
    for chunk, least in ((4, 1), (64, 1), (7, 5)):
        got = {(r.field, r.item_a, r.item_b): r.n_ab for r in pairs.pair_counts(items, least, chunk).collect()}
        assert got == {k: v[0] for k, v in want.items() if v[0] >= least}
    scored = {(r.field, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.total) for r in pairs.associations(items, 1).collect()}
    assert scored == want
    found = {(r.field, r.item_a, r.item_b) for r in pairs.found(spark.createDataFrame(rows, ART), 2, 1).collect()}
    assert found == {k for k, (n, a, b, t) in want.items() if n >= 2 and n * t >= a * b}


def test_pairs_of_nothing(spark):
    assert pairs.found(spark.createDataFrame([], ART)).count() == 0


ENT = "entity_id long, pmid string, sent_ord int, entity_type string, text string, id string"
REL = "rel_ord long, subject string, predicate string, object string, pmid string, polarity string, key string"


def letters(s):
    return None if s is None else "".join(c for c in s.casefold() if c.isalnum())


def plain_copies(ents, rels):
    groups = defaultdict(list)
    for i, pmid, sent, kind, text, _ in ents:
        groups["entities", pmid, sent, kind, letters(text)].append(i)
    for i, s, p, o, pmid, pol, _ in rels:
        s, p, o = letters(s), letters(p), letters(o)
        if p in dupes.SYMMETRIC and s is not None and o is not None:
            s, o = sorted((s, o))
        groups["relations", pmid, pol, p, s, o].append(i)
    return groups


@pytest.mark.parametrize("capacity", [5, 40, 100_000])
def test_duplicates(spark, capacity):
    random.seed(capacity)
    forms = ["KLV53", "klv-53", " KLV 53.", "*klv_53*", "KLV54", "TGF-β1", "tgf β1", "ΤGF", "é x", "", "...", None, "x" * 3000, "X " * 3000]
    ents = [(i, random.choice(["1", "12", None]), random.randrange(2), random.choice(["A", None]), random.choice(forms), "c") for i in range(300)]
    ents += [(1000 + i, "9", 1, "G", "KLV53", None) for i in range(200)]  # a hot group
    rels = [(i, random.choice(forms[:7]), random.choice(["associated_with", "Associated with", "inhibits", "interacts-with"]), random.choice(forms[:7]), random.choice(["1", "2"]), "positive", "k") for i in range(300)]
    groups = plain_copies(ents, rels)
    want = {(k[0], min(v), i) for k, v in groups.items() for i in v if i != min(v)}
    e, r = spark.createDataFrame(ents, ENT), spark.createDataFrame(rels, REL)
    assert {tuple(x) for x in dupes.found(e, r, capacity).collect()} == want
    counts = {(x.tab, x.id): x.n_copies for x in dupes.copies(dupes.entity_keys(e).unionByName(dupes.relation_keys(r)), capacity).collect()}
    assert counts == {(k[0], min(v)): len(v) for k, v in groups.items()}


def test_duplicates_of_nothing(spark):
    assert dupes.found(spark.createDataFrame([], ENT), spark.createDataFrame([], REL)).count() == 0
