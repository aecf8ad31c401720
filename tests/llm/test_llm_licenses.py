import re

from cases import edge_docs, rows_of, sf_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm import licenses


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_scan(text):
    """n_words, base places, best edits per label, by trying all spans of words."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, best = [], {}
    for p in licenses.PHRASES:
        for i in range(len(words)):
            for n in range(1, 8):
                span = " ".join(words[i:i + n])
                if i + n > len(words) or abs(len(span) - len(p.text)) > p.edits:
                    continue
                d = distance(span, p.text)
                if d == 0:
                    places.append((p.label, i))
                if d <= p.edits:
                    best[p.label] = min(best.get(p.label, 9), d)
    score = max([1 - d / len(p.text) for p in licenses.PHRASES for label, d in best.items() if label == p.label],
                default=0.0)
    return len(words), sorted(places), sorted(best), score


def test_edges_and_empty(spark):
    docs = edge_docs(spark, [r for r in edge_docs.__defaults__[0] if r[1] is None or len(r[1]) < 1000])
    got = sorted(rows_of(licenses.digest(licenses.scan(docs))), key=repr)
    want = []
    for r in docs.collect():
        n, places, labels, score = plain_scan(r.text)
        at = [w for _, w in places]
        want.append((r.doc_id, n, len(places), min(at, default=None), max(at, default=None),
                     ",".join(sorted({x for x, _ in places})), ",".join(labels), score))
    assert got == sorted(want, key=repr)
    assert rows_of(licenses.scan(edge_docs(spark, []))) == []


def test_time_follows_the_length(spark):
    """Megabytes of repeated notices, exact and fuzzy, and what a short repeat gives."""
    import time
    find = licenses.scanner(licenses.PHRASES)
    notice = "mit license see the gnu genral public licence "
    for n in (3, 20):
        words, places, spans, best = find((notice * n).encode())
        assert (words, places, sorted({s[0] for s in spans}), best) == plain_scan(notice * n)
    words, places, spans, _ = find((notice * 20).encode())
    took = {}
    for n in (4_000, 16_000):
        start = time.process_time()
        many = find((notice * n).encode())
        took[n] = time.process_time() - start
        assert many[0] == n * words // 20 and len(many[1]) == n
        assert len(many[2]) == n * len(spans) // 20
    assert took[16_000] < 8 * took[4_000] + 1


def test_long_text(spark):
    docs = edge_docs(spark, [r for r in edge_docs.__defaults__[0] if r[1] and len(r[1]) > 1000])
    got = rows_of(licenses.digest(licenses.scan(docs)))
    assert len(got) == docs.count() and all(r[1] > 100_000 and r[5] == "" for r in got)


def test_spans_are_reported(spark):
    docs = spark.createDataFrame([(1, "Under the GNU Genral Publik License; see mit licence.")],
                                 "doc_id long, text string")
    spans = licenses.scan(docs).first().spans
    assert [tuple(s) for s in spans] == [("gpl", 2, 4, 2), ("mit", 7, 2, 1)]


def test_real_table_has_hits(spark):
    assert licenses.digest(licenses.scan(sf_docs(spark))).filter("labels <> ''").count() > 0


WORDS = ["mit", "license", "licence", "cc", "by", "apache", "apachee", "gnu", "general", "public", "generl", "x",
         "licensé", "mitlicense", "b", "y", "é"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=14), st.sampled_from([" ", "-", ". "]))
def test_scan_equals_brute_force(words, sep):
    text = sep.join(words)
    n, places, spans, best = licenses.scanner(licenses.PHRASES)(text.encode())
    assert (n, places, sorted({s[0] for s in spans}), best) == plain_scan(text)
