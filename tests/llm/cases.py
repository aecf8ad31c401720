"""Shared inputs of the training-data tests."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

#: Columns that clash with names the operators use themselves.
EXTRA = ("chunk long, bucket int, fp long, u long, v string, id string, label int, cell long, "
         "rank int, kept string, score string, length long, salt int, query boolean, n_chars long")
_EXTRA_ROW = (1, 2, 3, 4, "v", "i", 5, 6, 7, "k", "s", 8, 9, True, 10)

LONG = "lorem ipsum dolor " * 60_000 + "Ende"

EDGE_TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "the  cat\tsat\non the mat"), (5, "the cat sat on the mat"),
    (6, "the cat sat on the mat"), (6, "the cat sat on the mat"), (None, "the cat sat on the mat"),
    (None, None), (7, LONG), (8, LONG + " "), (9, "Größe Ça <|endoftext|> <|ENDOFTEXT|>x y   it's 42!"),
    (10, "licensed under the MIT licence, CC-BY, and the Apache  License"), (11, "́ é ΑΣ ΣΑΣ İ"),
    (12, "MIT License"), (13, "12 34 !!"), (14, "x"), (15, " the cat sat on the mat "),
]


def edge_docs(spark, rows=EDGE_TEXTS):
    data = [(i, t, "en", "src0", *_EXTRA_ROW) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + EXTRA)


def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
