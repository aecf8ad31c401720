"""Maintained tag counts against counting all bags, and daily runs with them
against the full batch."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import Counter

import pytest

from minidata import MON, SUN, mini_tables
from tarmac.plans import scoring
from tarmac.plans.cleaning import TAG
from tarmac.plans.facts import FlightFacts
from tarmac.plans.tag_counts import TagCounts
from tarmac.sources.published import PublishedTable
from tarmac.streaming import start_daily_ranking
from tarmac.streaming.daily import rank_dates, restrict_to_dates
from test_golden import RANK_COLS, rows

DATE = "scheduled_departure_date_local"
DAYS = [dt.date(2024, 1, d) for d in range(1, 6)] + [None]


def bag_frame(spark, pairs):
    return spark.createDataFrame(pairs, f"{TAG} string, {DATE} date")


def stored(counts):
    return {r["tag"]: (r["n"], r["day"]) for r in counts.store.read().collect()}


def counted(pairs):
    n = Counter(t for t, _ in pairs if t is not None)
    return {t: (k, next(d for x, d in pairs if x == t) if k == 1 else None) for t, k in n.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_a_full_count(spark, tmp_path, seed):
    rng = random.Random(seed)
    counts = TagCounts(spark, str(tmp_path / "c"), buckets=7)
    held = []
    for batch in range(5):
        # one tag holds a third of a batch, and some bags have none
        new = [(rng.choice(["hot", None, *[f"t{i}" for i in range(60)], *[f"t{i}" for i in range(20)]])
                if rng.random() > .3 else "hot", rng.choice(DAYS)) for _ in range(30)]
        before, held = counted(held), held + new
        after = counted(held)
        want = {day for t, (n, day) in before.items() if n == 1 and after[t][0] > 1}
        frame = bag_frame(spark, new).repartition(3)
        assert set(counts.merge(frame, ("s", batch))) == want
        assert stored(counts) == after
        assert set(counts.merge(frame, ("s", batch))) == want and stored(counts) == after    # a repeated batch
    tags = [("t1", DAYS[0]), ("hot", DAYS[0]), ("never", DAYS[1]), (None, None)]
    assert {r[0] for r in counts.repeated(bag_frame(spark, tags)).collect()} == {
        t for t, _ in tags if t in after and after[t][0] > 1}


def test_rebuild_replaces_everything(spark, tmp_path):
    counts = TagCounts(spark, str(tmp_path / "c"), buckets=4)
    counts.merge(bag_frame(spark, [("a", DAYS[0]), ("b", DAYS[0])]))
    counts.rebuild(bag_frame(spark, [("b", DAYS[1])]))
    assert stored(counts) == {"b": (1, DAYS[1])}
    # a table keeps its own number of buckets
    assert TagCounts(spark, counts.store.path, buckets=99).merge(bag_frame(spark, [("b", DAYS[2])])) == [DAYS[1]]
    assert stored(counts) == {"b": (2, None)}


def test_only_buckets_of_the_batch_are_read_and_replaced(spark, tmp_path):
    counts = TagCounts(spark, str(tmp_path / "c"), buckets=32)
    counts.merge(bag_frame(spark, [(f"t{i}", DAYS[0]) for i in range(500)]))
    before = counts.store.manifest().partitions
    counts.merge(bag_frame(spark, [("t3", DAYS[1]), ("t4", DAYS[1])]))
    after = counts.store.manifest().partitions
    assert set(before) == set(after) and 1 <= sum(before[p] != after[p] for p in after) <= 2
    (bucket,) = counts._bucket_numbers(bag_frame(spark, [("t3", DAYS[1])]), TAG, 32)
    read = counts.repeated(bag_frame(spark, [("t3", DAYS[1])]))
    assert {re.search(r"bucket=(\d+)", f).group(1) for f in read.inputFiles()} == {str(bucket)}


def test_merge_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    counts = TagCounts(spark, str(tmp_path / "c"), buckets=3)
    counts.merge(bag_frame(spark, [("a", DAYS[0])]), ("s", 0))
    with monkeypatch.context() as m:
        m.setattr(PublishedTable, "_put", lambda self, manifest: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            counts.merge(bag_frame(spark, [("a", DAYS[1])]), ("s", 1))
    assert stored(counts) == {"a": (1, DAYS[0])}
    assert counts.merge(bag_frame(spark, [("a", DAYS[1])]), ("s", 1)) == [DAYS[0]]


def test_no_bags(spark, tmp_path):
    counts = TagCounts(spark, str(tmp_path / "c"))
    assert counts.merge(bag_frame(spark, [])) == [] and counts.merge(bag_frame(spark, [(None, DAYS[0])])) == []
    assert counts.repeated(bag_frame(spark, [("a", None)])).collect() == []


# ----------------------------------------------------------------- daily runs

def with_bags(spark, raw, bags):
    new = spark.createDataFrame([tuple(b.get(f.name) for f in raw.bags.schema.fields) for b in bags], raw.bags.schema)
    return raw.replace(bags=lambda: raw.bags.unionByName(new)), new


def ranking(spark, path):
    return rows(scoring.read_flight_difficulty(spark, path), *RANK_COLS)


def test_a_tag_repeated_later_reranks_the_earlier_date(spark, tmp_path):
    raw, out = mini_tables(spark), str(tmp_path / "out")
    bag = dict(flight_number="101", bag_tag_unique_number="X1", bag_type="Transfer")
    raw, first = with_bags(spark, raw, [{**bag, DATE: SUN}])
    counts = TagCounts(spark, str(tmp_path / "c"), buckets=5)
    none = raw.flights.filter("false")
    rank_dates(raw, raw.flights, out, counts=counts, new_bags=raw.bags, batch=("d", 0))
    assert ranking(spark, out) == rows(scoring.daily_ranking(raw.cleaned(), sort=False), *RANK_COLS)
    raw, second = with_bags(spark, raw, [{**bag, DATE: MON}])
    want = rows(scoring.daily_ranking(raw.cleaned(), sort=False), *RANK_COLS)
    assert want != ranking(spark, out)
    rank_dates(raw, none, out, counts=counts, new_bags=second, batch=("d", 1))
    assert ranking(spark, out) == want


def test_run_reads_bags_of_its_dates_and_buckets_of_their_tags(spark, tmp_path):
    raw = mini_tables(spark)
    base = str(tmp_path / "bags")
    raw.bags.write.partitionBy(DATE).parquet(base)
    t = raw.replace(bags=lambda: spark.read.schema(raw.bags.schema).parquet(base))
    counts = TagCounts(spark, str(tmp_path / "c"), buckets=64)
    counts.rebuild(raw.bags)
    mine = restrict_to_dates(t, [SUN], counts).bags
    plan = mine._jdf.queryExecution().explainString(
        spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [s for s in re.split(r"\n\n", plan) if "Scan parquet" in s.split("\n")[0] and base in s]
    assert scans and all(re.search(r"PartitionFilters: \[.*2\d{3}-", s) or "PartitionFilters: [" in s for s in scans)
    read = {re.search(r"bucket=(\d+)", f).group(1) for f in mine.inputFiles() if "bucket=" in f}
    tags = raw.bags.filter(raw.bags[DATE] == SUN)
    assert read <= {str(b) for b in counts._bucket_numbers(tags, TAG, 64)} and len(read) < 64
    key = lambda df: sorted(map(repr, df.select(DATE, TAG, "bag_type").collect()))
    cleaned = raw.cleaned().bags
    assert key(mine) == key(cleaned.filter(cleaned[DATE] == SUN))


@pytest.mark.parametrize("days", [None, 30])
def test_stream_of_flights_and_bags_equals_the_batch(spark, tmp_path, days):
    """With and without stored facts."""
    raw = mini_tables(spark)
    dirs = {n: str(tmp_path / n) for n in ("flights", "bags", "out", "ckpt", "counts", "facts")}
    facts = FlightFacts(spark, dirs["facts"], days_per_part=days) if days else None
    counts = TagCounts(spark, dirs["counts"], buckets=5)

    def tables():
        return raw.replace(bags=lambda: spark.read.schema(raw.bags.schema).parquet(dirs["bags"]),
                           flights=lambda: spark.read.schema(raw.flights.schema).parquet(dirs["flights"]))

    extra = [dict(flight_number="101", bag_tag_unique_number="X9", bag_type="Transfer", **{DATE: d}) for d in (SUN, MON)]
    for day, bag in zip((SUN, MON), extra):
        raw.flights.filter(raw.flights[DATE] == day).write.mode("append").parquet(dirs["flights"])
        _, new = with_bags(spark, raw, [bag])
        raw.bags.filter(raw.bags[DATE] == day).unionByName(new).write.mode("append").parquet(dirs["bags"])
        q = start_daily_ranking(spark, dirs["flights"], tables, dirs["out"], dirs["ckpt"], available_now=True,
                                counts=counts, new_bags_dir=dirs["bags"], facts=facts)
        q.awaitTermination(300)
        assert ranking(spark, dirs["out"]) == rows(scoring.daily_ranking(tables().cleaned(), sort=False), *RANK_COLS)
        if facts:
            assert rows(scoring.ranking_from(facts.inputs(), scoring.P.SCORE_PRESET, sort=False),
                        *RANK_COLS) == ranking(spark, dirs["out"])
