"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest
from cases import EDGE_TEXTS, SF, edge_docs, rows_of, sf_docs
from test_llm_packing import check_layout, plain_pieces
from test_llm_simhash import plain_components, plain_fingerprint

import corpus_pipeline as cp
from tarmac.llm.common import materialize, read_table
from tarmac.llm.queries import predict_language, queries, score_quality


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage on the smallest tables."""
    docs, out = sf_docs(spark), []
    for name, f in cp.STAGES:
        after = materialize(f(spark, docs, SF), "test-stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "language ID", "exact dedup", "SimHash near-dedup",
                                         "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_classifiers_keep_what_they_accept(spark, stages):
    _, before, after = stages[0]
    scored = score_quality(before, read_table(spark, SF, "labels")).collect()
    assert ids(after) == sorted(r.doc_id for r in scored if r.predicted == 1)
    _, before, after = stages[1]
    found = predict_language(before).collect()
    assert ids(after) == sorted(r.doc_id for r in found if r.lang_pred != "und")


def test_dedup_stages(stages):
    _, before, after = stages[2]
    first = {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert ids(after) == sorted(first.values())
    _, before, after = stages[3]
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()]
    assert ids(after) == sorted({*plain_components(rows)})


def test_last_stage_and_run(spark, stages):
    _, before, after = stages[4]
    rows = rows_of(after)
    assert sorted((r[:5] for r in rows), key=repr) == plain_pieces([(r.doc_id, r.text) for r in before.collect()])
    check_layout(rows, 4096)
    assert sorted(rows_of(queries()["pipeline"](spark, SF))) == sorted(rows)


def test_stages_on_edge_rows(spark):
    docs = edge_docs(spark)
    for _, f in cp.STAGES[:-1]:
        after = f(spark, docs, SF)
        assert after.dtypes == docs.dtypes
        assert after.count() <= docs.count()
        empty = f(spark, docs.limit(0), SF)
        assert empty.dtypes == docs.dtypes and empty.count() == 0
    assert rows_of(cp.STAGES[-1][1](spark, docs.limit(0), SF)) == []


def test_dedup_stages_keep_one_row_of_each_group(spark):
    """Repeated rows, rows without an id, and ids that rows of other texts share."""
    texts = EDGE_TEXTS + [
        (None, "no id on either row"), (None, "no id on either row"), (20, "one row twice over"),
        (20, "one row twice over"), (20, "other words below the same id"), (21, "the cat sat on the mat"),
        (21, "words that only this row has"), (None, "one row twice over")]
    docs = edge_docs(spark, texts).repartition(5)

    def survivors(group_of):
        groups = {}
        for (i, t), g in zip(texts, group_of):
            groups.setdefault(g, []).append((i is None, i or 0))
        return sorted((None if none else i) or -1 for none, i in map(min, groups.values()))

    def left(df):
        return sorted(r.doc_id or -1 for r in df.select("doc_id").collect())

    exact = cp.drop_exact_copies(spark, docs, SF)
    assert left(exact) == survivors([re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in texts])
    assert exact.dtypes == docs.dtypes
    # components by the row's place: every row has an id of its own
    near = plain_components([(n, plain_fingerprint(t)) for n, (_, t) in enumerate(texts)])
    assert left(cp.drop_near_copies(spark, docs, SF)) == survivors(near)
    clash = docs.withColumn("row_key", docs["doc_id"])
    assert left(cp.drop_exact_copies(spark, clash, SF)) == left(exact)


def test_language_filter_keeps_unsure_documents(spark):
    """Short texts, and texts in two languages, among languages that share most words."""
    langs = {f"l{k}": [f"{c}{c}{c}" for c in "abcdefgh"[2 * k:2 * k + 2]] for k in range(4)}
    rows = [(100 * k + n, " ".join(["the", "common", "words", *(w if n % 2 else [])] * (1 + n % 3)), name)
            for k, (name, w) in enumerate(langs.items()) for n in range(40)]
    clean = [(1000 + n, t, "l0") for n, t in enumerate(
        ["the", "common", "words", "the common words", "aaa bbb ccc ddd", "aaa ccc eee ggg", "the aaa words ggg"])]
    gone = [(2000, "12 34 !!", "l0"), (2001, "", "l0"), (2002, None, "l0")]
    docs = spark.createDataFrame(rows + clean + gone, "doc_id long, text string, lang string")
    scores = {r.doc_id: r.score for r in predict_language(docs).collect()}
    assert min(scores[i] for i, _, _ in clean) < 0.5
    assert ids(cp.language_filter(spark, docs, SF)) == sorted(i for i, _, _ in rows + clean)
