"""Names: keys that lose no one, ties, slips made at random."""

from __future__ import annotations

import random

from litloom.llm import names

PEOPLE = "author_id long, kind string, full_name string"
JOURNALS = "journal_id long, full_title string"
ARTICLES = "article_ord long, authors array<string>, journal string"


def linked(spark, people, typed):
    p = spark.createDataFrame([(i, "person", n) for i, n in enumerate(people)], PEOPLE)
    a = spark.createDataFrame([(i, [t], None) for i, t in enumerate(typed)], ARTICLES)
    return {r.article_ord: r.ref_id for r in names.found(a, p, spark.createDataFrame([], JOURNALS)).collect()}


def test_short_names(spark):
    people = ["Li, Wei", "Kim, Jae", "Wu, Xiu Ying", "Ng, Ada"]
    typed = {"W. Li": 0, "Li W": 0, "Wei Li": 0, "Kim, J.": 1, "Jae Kim": 1, "Wu, X. Y.": 2, "Dr. Ada Ng": 3, "J. Li": None, "Lo, Wei": None}
    assert linked(spark, people, list(typed)) == {i: m for i, m in enumerate(typed.values()) if m is not None}


def test_suffix_of_a_thousand_listed_names(spark):
    r = random.Random(4)
    heads = sorted({"".join(r.sample("abdefghlmnoprtuvyz", 9)) for _ in range(1000)})
    people = [f"{h.title()}stantinopolis, Oksana" for h in heads]
    typed = [f"O. {(h[:6] + h[7] + h[6] + h[8]).title()}stantinopolis" for h in heads]
    assert linked(spark, people, typed) == {i: i for i in range(len(heads))}


def test_ties_are_given_with_a_flag(spark):
    p = names.authority(spark.createDataFrame([(1, "person", "Borg, Ada"), (2, "person", "Borg, Abel"), (3, "person", "Cole, Eva")], PEOPLE), spark.createDataFrame([], JOURNALS))
    n = spark.createDataFrame([("author", "A. Borg"), ("author", "A. Borg"), ("author", "E. Cole"), ("author", None), ("author", "Ada Borg")], "kind string, name string")
    got = {(x.name, x.ref_id, x.ambiguous, x.n) for x in names.links(n.where("name IS NOT NULL"), p).collect()}
    assert got == {("A. Borg", 1, True, 2), ("A. Borg", 2, True, 2), ("E. Cole", 3, False, 1), ("Ada Borg", 1, False, 1)}


def test_python_and_jvm_fold_alike(spark):
    odd = ["Šimunić-Łuksza", "ØRSTED", "Groß", "Ｔａｎ", "Nguyễn", "İnan", "Müller", "Ðorđe"]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select("x", names.token_column(names.F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == {x: names.tokens(x) for x in odd}


def slip(r: random.Random, s: str) -> str:
    i = r.randrange(1, len(s) - 1)
    return r.choice([s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + r.choice("aeiourst") + s[i + 1 :]])


def test_ratio_is_calibrated_on_labelled_pairs():
    """Pairs with one slip are linked, pairs of different people aren't: the threshold separates them."""
    r = random.Random(11)
    parts = "ba de fi go lu ma ne po ra si ta vu wen kor lin mas tor".split()
    word = lambda k: "".join(r.choice(parts) for _ in range(k)).title()
    people = sorted({f"{word(r.randint(2, 4))}, {word(r.randint(2, 3))}" for _ in range(400)})
    known = " " + " ".join({names.fold(p.split(", ")[1]) for p in people}) + " "
    same = [names.person_score(f"{slip(r, p.split(', ')[0])}, {p.split(', ')[1]}", p, known) for p in people] + [names.person_score(f"{p.split(', ')[1][0]}. {slip(r, p.split(', ')[0])}", p, known) for p in people]
    other = [names.person_score(f"{a.split(', ')[1]} {a.split(', ')[0]}", b, known) for a, b in zip(people, r.sample(people, len(people))) if a != b]
    assert sum(x >= names.RATIO for x in same) >= 0.97 * len(same) and sum(x >= names.RATIO for x in other) <= 0.01 * len(other)
