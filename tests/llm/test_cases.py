"""Nulls in any column, repeated rows, empty tables, long texts and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeframe.llm import chat, extraction, licenses, mixing, neighbours, packing, quality, repeats, simhash, warc

LONG = "word " * 40_000
ROWS = [(1, "some text of a few words that is long enough to be kept here", "en", "src0", 60), (1, "some text of a few words that is long enough to be kept here", "en", "src0", 60), (None, "x", "en", "src0", 1), (2, None, "en", "src0", None), (3, "", None, None, 0), (4, LONG, "en", "src1", len(LONG)), (None, None, None, None, None)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("kept", "fingerprint", "component_id", "labels", "score", "copies", "domain", "start", "offset", "u", "v", "key", "rank", "n_words", "metric", "bin")


@pytest.fixture(params=["plain", "clashing"])
def odd(spark, request):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df if request.param == "plain" else df.withColumns({c: F.lit("other") for c in CLASHES})


TOKENIZER = packing.default_tokenizer()
OPERATORS = {
    "licenses": licenses.license_scan,
    "simhash": simhash.near_duplicates,
    "quality": quality.quality_rules,
    "repeats": repeats.removals,
    "mixing": lambda df: mixing.mix(df, budget_percent=200),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(odd, name):
    assert sorted(str(r[0]) for r in OPERATORS[name](odd).collect()) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_packing_covers_each_row(odd):
    rows = packing.pack(odd, tokenizer=TOKENIZER).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS)
    assert packing.pack(odd.limit(0), tokenizer=TOKENIZER).count() == 0


def test_stages_keep_the_columns(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and out.count() <= len(ROWS), name
        empty = stage(spark, odd.limit(0), "")
        assert empty.columns == odd.columns and empty.count() == 0, name


def test_keeping_one_of_repeated_rows(odd):
    kept = simhash.keep_one(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "4", "None", "None"]


def test_pages_conversations_and_vectors(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>" * 3000, "y"), (1, None, None, "x")], "page_id bigint, url string, html string, text string")
    assert extraction.extract(pages).count() == 3 and extraction.extract(pages.limit(0)).count() == 0
    assert warc.derivatives(warc.responses(pages), id_col="page_id").count() == 6
    assert warc.derivatives(warc.responses(pages.limit(0)), id_col="page_id").count() == 0
    talk = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (None, None, None, None, None)], "conv_id bigint, turn bigint, role string, text string, rendered string")
    assert chat.format_chats(talk).count() == 2
    vectors = spark.createDataFrame([(20, [1.0, 0.0], "x"), (21, [1.0, 0.0], "x"), (21, [1.0, 0.0], "x"), (40, None, None), (None, [1.0, 1.0], None)], "vec_id bigint, embedding array<double>, score string")
    rows = neighbours.search(vectors, is_query=F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(20, 1, 21, 1.0), (20, 2, 21, 1.0)]
    assert neighbours.search(vectors.limit(0), is_query=F.lit(True)).count() == 0
