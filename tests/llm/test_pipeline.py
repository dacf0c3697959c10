"""Each stage of the pipeline on what the one before it kept, against a brute-force version."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from check import open_tables, spark_result, sql_result
from test_operators import docs, duplicate_groups, linked_documents, table  # noqa: F401

import corpus_pipeline
from jobtrail.llm import cube, queries

FOLDER = "/root/testdata/sf0.01"
ORIGINAL = ["doc_id", "text", "lang", "source"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The input, then the output of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    found = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], FOLDER).write.parquet(str(folder / str(place)))
        found.append(spark.read.parquet(str(folder / str(place))))
    return found


def rows(df):
    return [tuple(row) for row in df.select(*ORIGINAL).collect()]


def test_stages_return_documents(tables):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding",
    ]
    for df in tables[1:-1]:
        assert df.columns == tables[0].columns
    assert all(df.count() for df in tables)


def test_quality_keeps_clean_documents(spark, tables):
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {row[0] for row in rows(tables[1])}
    assert {key for key, quality in labels.items() if quality == 1} <= kept
    junk = [key for key, quality in labels.items() if quality == 0]
    assert sum(key in kept for key in junk) <= 0.03 * len(junk)
    assert set(rows(tables[1])) <= set(rows(tables[0]))


def test_one_copy_stays(tables):
    want = {key for key, _, _, kept, _ in duplicate_groups(rows(tables[1])) if kept}
    assert sorted(row[0] for row in rows(tables[2])) == sorted(want)


def test_one_near_copy_stays(tables):
    want = {key for key, _, component in linked_documents(rows(tables[2])) if key == component}
    assert sorted(row[0] for row in rows(tables[3])) == sorted(want)


def test_near_copies_go_by_row(spark):
    """Ids that repeat or are null take no other row with them, and keep no second copy."""
    base = [f"word{i}" for i in range(60)]

    def near(n):
        return " ".join(base[:-1] + [f"other{n}"])

    alone = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcd"]
    given = [
        (1, near(0)), (5, near(1)), (5, alone[0]), (7, near(2)), (7, near(3)), (None, near(4)), (None, alone[1]),
        (None, alone[2] + " x"), (None, alone[2] + " y"), (9, alone[3] + " x"), (9, alone[3] + " y"), (3, ""), (None, None),
    ]
    df = spark.createDataFrame([(key, text, "en", "s") for key, text in given], "doc_id long, text string, lang string, source string")
    kept = Counter((row.doc_id, row.text) for row in corpus_pipeline.drop_near_copies(spark, df.withColumn("uid", F.lit(0)), FOLDER).collect())
    twice = {(None, alone[2] + " x"), (None, alone[2] + " y")}, {(9, alone[3] + " x"), (9, alone[3] + " y")}
    assert all(sum(kept[row] for row in pair) == 1 for pair in twice)
    rest = {row: n for row, n in kept.items() if not any(row in pair for pair in twice)}
    assert rest == dict.fromkeys([(1, near(0)), (5, alone[0]), (None, alone[1]), (3, ""), (None, None)], 1)


def test_mix_takes_documents_as_often_as_wanted(tables):
    times = {row.doc_id: row.times for row in cube.mix(tables[3]).collect()}
    assert Counter(row[0] for row in rows(tables[4])) == Counter({key: n for key, n in times.items() if n})


def test_ids_decode_to_the_text(tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    text = {row[0]: row[1] for row in rows(tables[4])}
    found = tables[5].collect()
    assert len(found) == tables[4].count()
    for row in found:
        assert row.ids == library.encode(text[row.doc_id]) and row.n_tokens == len(row.ids) and row.whole


def test_stages_take_awkward_documents(spark, table, docs):  # noqa: F811
    """Null, empty and long texts, null languages and sources, hot groups, a column with a clashing name."""
    kept = table.withColumns({"quality": F.lit(1), "a.b": F.lit(2), "ids": F.lit("x")}).cache()
    for _, stage in corpus_pipeline.STAGES[1:]:
        kept = stage(spark, kept, FOLDER)
    assert kept.count() > 0 and {"quality", "a.b", "ids", "ids_"} <= set(kept.columns)
    judged = corpus_pipeline.keep_quality(spark, table, FOLDER)
    assert judged.columns == table.columns and judged.count() <= len(docs)


def test_stages_take_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_run_equals_the_stages(spark, tables):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == tables[-1].columns
    key = [row.doc_id for row in got.select("doc_id").collect()]
    assert sorted(key) == sorted(row.doc_id for row in tables[-1].select("doc_id").collect())


@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_equal_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    got_schema, got = spark_result(spark, name, folder)
    want_schema, want = sql_result(open_tables(folder), name)
    assert got_schema == want_schema
    assert got == want and got
