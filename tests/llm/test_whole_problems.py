"""The registered queries of the corpus operators do the whole of their problems."""

import random

from litloom.llm import names, registry, sentences, truncation


def test_every_pair_comes_out(spark, tmp_path):
    rows = [("1", ["a", "b"], []), ("2", ["a", "c"], ["x", "y"]), ("3", ["a", "b"], None)]
    spark.createDataFrame(rows, "pmid string, mesh_terms array<string>, keywords array<string>").write.parquet(str(tmp_path / "articles.parquet"))
    got = {(r.field, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.total, r.lift) for r in registry.queries()["p1_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("mesh_terms", "a", "b"): (2, 3, 2, 3, 1.0), ("mesh_terms", "a", "c"): (1, 3, 1, 3, 1.0), ("keywords", "x", "y"): (1, 1, 1, 1, 1.0)}


def test_forms_of_all_fields(spark, tmp_path):
    spark.createDataFrame([(1, "х  y", "ﬁber"), (2, None, " ")], "article_ord long, title string, abstract string").write.parquet(str(tmp_path / "articles.parquet"))
    spark.createDataFrame([(1, None, "k​l﻿v­53"), (2, "1", "klv53")], "entity_id long, pmid string, normalized string").write.parquet(str(tmp_path / "entities.parquet"))
    got = sorted(tuple(r) for r in registry.queries()["p4_forms"](spark, str(tmp_path)).collect())
    assert got == [("abstract", 1, "fiber"), ("abstract", 2, ""), ("normalized", 1, "klv53"), ("normalized", 2, "klv53"), ("title", 1, "x y"), ("title", 2, None)]


def test_shares_rest_on_all_documents(spark, tmp_path):
    rows = [(1, "It was the", "s"), (2, "It ended.", "s"), (3, "", "s"), (4, None, "s"), (5, " \n\u00a0", "t"), (6, None, None)]
    docs = spark.createDataFrame([(*r, "abstract") for r in rows], "doc_id long, text string, source string, doc_kind string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in registry.queries()["p10_sources"](spark, str(tmp_path)).collect()}
    assert got == {("s", 4, 1, .25, 0), ("t", 1, 0, 0.0, 0), (None, 1, 0, 0.0, 0)}
    assert {tuple(r) for r in truncation.sources(docs).collect()} == {("s", 2, 1, .5, 0)}
    assert [r.doc_id for r in truncation.found(docs).collect()] == [1]


def test_limit_where_few_texts_are_left(spark):
    # A limit takes 1,000 of 1,040 texts; all of the 40 left end at another one shortly behind it.
    sizes = [240] * 1000 + [270] * 40
    got = truncation.significant_lengths(spark.createDataFrame([("s", n, n) for n in sizes], "source string, chars int, bytes int")).collect()
    assert {(r.unit, r["size"]) for r in got} == {(u, n) for u in ("chars", "bytes") for n in (240, 270)}
    for r in got:  # risk times the neighbours' ends over their texts at risk
        near = [r["size"] + k for k in range(-truncation.FAR, truncation.FAR + 1) if abs(k) >= truncation.NEAR]
        risks = [sum(s >= n for s in sizes) for n in (r["size"], *near)]
        assert abs(r.expected - risks[0] * (sum(map(sizes.count, near)) + 0.5) / sum(risks[1:])) < 1e-9


def test_sentence_of_many_possible_ends():
    values = "The values were " + ", ".join(f"{k}.5" for k in range(200)) + "."
    parts = ["It began.", values, "It ended."]
    t = " ".join(parts)
    assert len(sentences.candidates(t, False)) > 200
    assert [t[a:b] for a, b in sentences.spans(t)] == parts


def test_slips_in_names_of_a_common_key(spark):
    # 100 listed people share a surname's last letters and an initial; only those letters survive the slip.
    random.seed(8)
    heads = ["".join(random.sample("abdefghlmnoprtuvyz", 8)) for _ in range(100)]
    people = spark.createDataFrame([(i, "person", f"{h.title()}wick, Oksana") for i, h in enumerate(heads)], "author_id long, kind string, full_name string")
    typed = [f"O. {(h[:6] + h[7] + h[6]).title()}wick" for h in heads]
    art = spark.createDataFrame([(i, [t], None) for i, t in enumerate(typed)], "article_ord long, authors array<string>, journal string")
    got = {r.article_ord: r.ref_id for r in names.found(art, people, spark.createDataFrame([], "journal_id long, full_title string")).collect()}
    assert got == {i: i for i in range(100)}
