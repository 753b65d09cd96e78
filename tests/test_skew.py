"""Joins without hot keys."""

from litloom.operators.skew import join_hot, product


def test_join_hot_equals_plain_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}" if i % 7 else None) for i in range(3000)], "id int, k string")
    sizes = rows.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n")
    twice = sizes.selectExpr("k", "n", "explode(array(1, 2)) AS v")
    want = sorted((r.id, r.k, r.v) for r in rows.join(twice.drop("n"), "k").collect())
    for share in (2, 10, 100_000):  # one hot key, some, all
        got = join_hot(rows, twice, ["k"], "n", share)
        assert sorted((r.id, r.k, r.v) for r in got.select("id", "k", "v").collect()) == want
    assert join_hot(rows.limit(0), twice, ["k"], "n").count() == 0 and join_hot(rows, twice.limit(0), ["k"], "n").count() == 0


def test_left_join_keeps_all_rows(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}" if i % 7 else None) for i in range(900)], "id int, k string")
    table = rows.where("k IS NOT NULL AND k <> 'k5'").groupBy("k").count().selectExpr("k", "count AS n", "length(k) AS v")
    want = sorted((r.id, r.k, r.v) for r in rows.join(table.drop("n"), "k", "left").collect() if r.k) + [None] * rows.where("k IS NULL").count()
    for share in (2, 10, 100_000):
        got = join_hot(rows, table, ["k"], "n", share, how="left").collect()
        assert sorted((r.id, r.k, r.v) for r in got if r.k) + [None] * sum(r.k is None for r in got) == want and all(r.v is None for r in got if r.k is None)


def test_product_in_cells(spark):
    left = spark.createDataFrame([(i, "hub" if i % 2 else f"k{i % 9}") for i in range(600)], "a int, k string")
    right = spark.createDataFrame([(i, "hub" if i % 3 else f"k{i % 9}") for i in range(400)], "b int, k string")
    want = sorted(tuple(r) for r in left.join(right, "k").select("a", "b", "k").collect())
    for chunk in (7, 64, 10_000):
        assert sorted(tuple(r) for r in product(left, right, "k", chunk).select("a", "b", "k").collect()) == want
    cells = product(left, right, "k", 32)
    assert cells.count() == len(want) and product(left.limit(0), right, "k").count() == 0
