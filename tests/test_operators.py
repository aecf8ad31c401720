"""Operators against brute-force Python or plain Spark equivalents."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import (attach_scalar, count_join_rows, drop_all_duplicates, keep_first,
                              rank_within_groups)

INT32 = st.one_of(st.none(), st.integers(-2 ** 31, 2 ** 31 - 1), st.integers(-3, 3))


def _survivor(rows):
    """First row under (d DESC NULLS LAST, a ASC NULLS LAST)."""
    def key(r):
        d, a = r
        return (d is None, -(d or 0), a is None, a or 0)
    return sorted(rows, key=key)[0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), INT32, INT32), min_size=1, max_size=40))
def test_keep_first_matches_sort(spark, data):
    df = spark.createDataFrame(data, "k int, d int, a int")
    got = {r.k: (r.d, r.a) for r in keep_first(df, ["k"], "d", "a").collect()}
    groups = {}
    for k, d, a in data:
        groups.setdefault(k, []).append((d, a))
    assert got == {k: _survivor(v) for k, v in groups.items()}


def test_keep_first_is_a_hash_aggregate(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k int, d int, a int")
    plan = keep_first(df, ["k"], "d", "a")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_drop_all_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5), ("c", 6)],
                               "k string, v int")
    got = sorted(r.v for r in drop_all_duplicates(df, "k").collect())
    assert got == [3, 4, 5, 6]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(0, 2)), max_size=30),
       st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(0, 2),
                          st.integers(0, 3)), max_size=30))
def test_count_join_rows_equals_direct_join(spark, left, right):
    l = spark.createDataFrame(left, "k string, j int")
    r = spark.createDataFrame(right, "k string, j int, g int")
    got = {(x.k, x.g): x.n for x in
           count_join_rows(l, r, on=["k", "j"], by=["k", "g"], name="n", right_by=["g"]).collect()}
    want = {}
    for lk, lj in left:
        for rk, rj, g in right:
            if lk is not None and lk == rk and lj == rj:
                want[(lk, g)] = want.get((lk, g), 0) + 1
    assert got == want


def _window_rank(df, by, order):
    w = Window.partitionBy(*by).orderBy(*order)
    return {(r.id, r.rank, r.size) for r in df.select(
        "id", F.row_number().over(w).alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("size")).collect()}


def test_rank_within_groups_hot_and_null_groups(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 != 0 else rnd.choice(["a", "b", None])
        rows.append((i, g, rnd.choice([None, rnd.random(), 0.5])))
    df = spark.createDataFrame(rows, "id int, g string, s double").repartition(6)
    order = [F.col("s").desc_nulls_first(), F.col("id").asc()]
    ranked = rank_within_groups(df, ["g"], order, rank_col="rank", size_col="size",)
    got = {(r.id, r.rank, r.size) for r in ranked.collect()}
    assert got == _window_rank(df, ["g"], order)


def test_rank_within_groups_shuffle_fallback(spark, eager_splitting):
    df = spark.createDataFrame([(i, i % 5, float(i % 7)) for i in range(200)],
                               "id int, g int, s double")
    order = [F.col("s").desc(), F.col("id")]
    ranked = rank_within_groups(df, ["g"], order, rank_col="rank", size_col="size")
    assert {(r.id, r.rank, r.size) for r in ranked.collect()} == _window_rank(df, ["g"], order)


def test_attach_scalar(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    out = attach_scalar(df, df.agg(F.sum("x").alias("total")))
    assert sorted((r.x, r.total) for r in out.collect()) == [(1, 3), (2, 3)]


@pytest.fixture
def eager_splitting(spark):
    """AQE settings under which small skewed joins are split."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "20",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _is_split(df) -> bool:
    """The plan that ran split a skewed join."""
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_join_unique_matches_plain_join(spark, how, eager_splitting):
    from tarmac.operators.skew import join_unique
    rnd = random.Random(3)
    big = [(("hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None])), i % 4 if i % 7 else None, i)
           for i in range(600)]
    small = [("hot", 0, "H0"), ("hot", 1, "H1"), ("a", 0, "A0"), ("b", 2, "B2"), (None, 0, "N0")]
    b = spark.createDataFrame(big, "k string, j int, v int")
    s = spark.createDataFrame(small, "k string, j int, w string")
    got = join_unique(b, s, ["k", "j"], how=how)
    want = b.join(s, ["k", "j"], how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def _hot_big(spark, n=30_000):
    """A third of the rows share a key, another third have none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("t"), F.col("id")))
    return spark.range(n, numPartitions=8).select(key.alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_join_unique_splits_a_hot_key(spark, how, eager_splitting):
    """Against an aggregate a plain join is not split, join_unique is; no task
    of the join has more than a few times the mean of rows."""
    from tarmac.operators.skew import join_unique
    big = _hot_big(spark)
    per_key = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = big.join(per_key, ["k"], how)
    plain.collect()
    assert not _is_split(plain)
    got = join_unique(big, per_key, ["k"], how).withColumn("task", F.spark_partition_id())
    tasks = [r.task for r in got.collect()]
    assert _is_split(got)
    assert len(tasks) == plain.count()
    if tasks and how != "left_anti":
        counts = [tasks.count(t) for t in set(tasks)]
        assert max(counts) < 0.2 * len(tasks)


def test_drop_all_duplicates_hot_tag(spark, eager_splitting):
    rows = [("HOT", i) for i in range(300)] + [(f"t{i}", i) for i in range(300)] + \
           [("dup", 1), ("dup", 2)] + [(None, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = drop_all_duplicates(df, "k")
    assert got.columns == ["k", "v"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(f"t{i}", i) for i in range(300)] + [(None, i) for i in range(50)], key=repr)
    hot = drop_all_duplicates(_hot_big(spark), "k")
    assert hot.count() == 20_000


def test_drop_all_duplicates_hot_group_of_identical_copies(spark, eager_splitting):
    from tarmac.operators import skew
    rows = [("COPY", 7)] * 400 + [(f"t{i}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(8)
    assert sorted(map(tuple, drop_all_duplicates(df, "k").collect())) == \
        sorted((f"t{i}", i) for i in range(200))
    big = spark.createDataFrame(rows, "k string, v int").repartition(8)
    small = spark.createDataFrame([("COPY", "c")] + [(f"t{i}", "x") for i in range(200)],
                                  "k string, w string")
    got = skew.join_unique(big, small, ["k"], how="left")
    assert got.count() == 600 and got.filter("w = 'c'").count() == 400


def test_spread_sort_splits_identical_copies(spark):
    """A third of the rows are identical; no partition of the sort holds more
    than about twice the median."""
    from tarmac.operators.ranking import spread_sort
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        v = F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id") % 1000)
        df = spark.range(60_000, numPartitions=24).select(v.cast("int").alias("v"))
        got = spread_sort(df, F.col("v").asc()).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.v for r in got] == sorted(r.v for r in got)
    sizes = sorted([r.part for r in got].count(p) for p in {r.part for r in got})
    assert sizes[-1] <= 2.2 * sizes[len(sizes) // 2]


def test_rank_within_groups_in_order(spark):
    rows = [(i, f"g{i % 5}" if i % 7 else None, float(i * 37 % 101)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, s double").repartition(6)
    got = rank_within_groups(df, ["g"], [F.col("s").desc(), F.col("id")], rank_col="rank", in_order=True)
    out = [(r.g, r["rank"]) for r in got.collect()]
    assert out == sorted(out, key=lambda x: (x[0] is None, x[0] or "", x[1]))
    assert len(out) == 400


def test_rank_within_groups_identical_copies(spark):
    rows = [(1, "hot", 0.5)] * 400 + [(i, "cold", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, g string, s double").repartition(8)
    order = [F.col("s").desc(), F.col("id")]
    got = rank_within_groups(df, ["g"], order, rank_col="rank", size_col="size")
    hot = sorted(r.rank for r in got.filter("g = 'hot'").collect())
    assert hot == list(range(1, 401))
    assert {r.size for r in got.collect()} == {400, 50}


def test_small_tasks_restores_the_session(spark):
    from tarmac.session import TASK_BYTES, small_tasks
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for before, inside in ((None, str(TASK_BYTES)), ("64m", str(TASK_BYTES)), ("16k", "16k")):
        if before is not None:
            spark.conf.set(name, before)
        try:
            with pytest.raises(KeyError), small_tasks(spark):
                assert spark.conf.get(name) == inside
                raise KeyError
            assert spark.conf.get(name, None) == before
        finally:
            spark.conf.unset(name)


def test_facts_are_built_in_small_tasks(spark, tmp_path, monkeypatch):
    from minidata import mini_tables
    from tarmac.plans import facts
    from tarmac.session import TASK_BYTES
    seen, real = [], facts.compute
    monkeypatch.setattr(facts, "compute", lambda t: seen.append(
        spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) or real(t))
    facts.FlightFacts(spark, str(tmp_path / "f")).build(mini_tables(spark).cleaned())
    assert seen == [str(TASK_BYTES)]
