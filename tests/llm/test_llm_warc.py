import gzip
import hashlib
import io
import os
import random

from cases import EXTRA, _EXTRA_ROW, rows_of
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmac.llm import warc
from tarmac.llm.common import materialize
from tarmac.session import scratch_path


def make(spark, rows):
    return spark.createDataFrame([(i, u, h, *_EXTRA_ROW) for i, u, h in rows],
                                 "page_id long, url string, html string, " + EXTRA)


PAGES = [(1, "http://a.example.com/x", "p" * 2000), (2, "https://b.example.com/", "short"), (3, None, None),
         (4, "http://www.a.example.com:80/X#f", "p" * 2000), (5, "http://c/é?q=1", "p" * 2000),
         (6, "not a url\r\nWARC-Type: x", "short"), (7, "http://[bad", ""), (8, "http://d/", "\r\n\r\nWARC/1.1\r\n" * 300),
         (9, "http://d/", "\r\n\r\nWARC/1.1\r\n" * 300), (None, "http://e/", "p" * 2000), (None, None, None),
         (10, "http://f/", "ü" * 500), (11, "http://f/", "ü" * 500), (12, "", "ü" * 499),
         (13, "http://g/", "ü" * 499), (13, "http://g/", "ü" * 499)]


def expected(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        keep = max((j for j, _, g in rows if j is not None and (g or "") == (h or "")), default=None)
        revisit = len(body) >= 1000 and i is not None and i < keep
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response",
                    keep if revisit else None))
    return sorted(out, key=repr)


def digest(df):
    return sorted(rows_of(df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")), key=repr)


def test_edges(spark):
    df = make(spark, PAGES).repartition(3)
    assert digest(warc.capture_index(df)) == expected(PAGES)


def test_empty(spark):
    assert rows_of(warc.capture_index(make(spark, []))) == []


def test_index_is_globally_ordered(spark):
    """A third of the captures share one URL; many runs, many ranges."""
    rng = random.Random(2)
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{rng.randrange(50)}.example/{i}", f"page {i}" * 50)
            for i in range(900)]
    rng.shuffle(rows)
    df = make(spark, rows).repartition(6)
    got = warc.capture_index(df, archive_bytes=20_000, range_rows=100).orderBy("range", "position").collect()
    keys = [(r.url_key, r.date, r.page_id) for r in got]
    assert len(keys) == 900 and keys == sorted(keys)
    assert len({r.archive for r in got}) > 10 and len({r["range"] for r in got}) > 5
    assert max(sum(r["range"] == k for r in got) for k in {r["range"] for r in got}) < 400


def test_captures_of_one_url_come_in_the_order_of_their_times(spark):
    """Shuffled times, some equal and some missing; splitters part the hot URL by time."""
    rng = random.Random(4)
    rows = [(i, "http://hot.example/", f"page {i}", None if i % 50 == 0 else f"2024-0{rng.randint(1, 9)}-1{i % 10} 0{i % 7}:00:00")
            for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, t string").withColumn(
        "t", F.col("t").cast("timestamp_ntz")).repartition(5)
    got = warc.capture_index(df, archive_bytes=20_000, range_rows=300, date_col="t").orderBy("range", "position").collect()
    want = sorted((warc.EPOCH if t is None else t.replace(" ", "T") + "Z", i) for i, _, _, t in rows)
    assert [(r.date, r.page_id) for r in got] == want
    ends = [[r.date for r in got if r["range"] == k] for k in sorted({r["range"] for r in got})]
    assert len(ends) > 3 and all(a[-1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_splitters_of_repeated_captures(spark):
    """Almost all captures are copies of one: the sample is taken from all of them."""
    rows = [(1, "http://a/", "x")] * 3000 + [(i, f"http://b{i}/", "x") for i in range(40)]
    cuts = warc.splitters(make(spark, rows), "page_id", "url", "html", 8, len(rows), sample=30)
    assert len(cuts) == 7 and cuts == sorted(cuts)


def test_archives_are_readable_members(spark):
    """Each record is a gzip member of its own and starts with its type."""
    folder = scratch_path(spark, "warc-test")
    marked = warc.mark_revisits(make(spark, PAGES[:4]).coalesce(1), "page_id", "url", "html")
    got = materialize(warc.write_archives(marked, folder), "archives").collect()
    assert sum(r.records for r in got) == 4
    path = folder.removeprefix("file:")
    raw = b"".join(open(os.path.join(path, r.archive), "rb").read() for r in got)
    records = list(warc.parse_records(io.BytesIO(gzip.decompress(raw))))
    assert sorted(h["warc-type"] for h, _ in records) == ["response"] * 3 + ["revisit"]
    assert all(b.startswith(b"HTTP/1.1 200 OK\r\n") for _, b in records)


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.Blog.Example.com:443/A/b?Q=1#top") == "com,example,blog)/a/b?q=1"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key("urn:page:3") == "urn:page:3"
