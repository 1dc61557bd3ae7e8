"""Stages carry every column of the caller, judge rows by their own texts, and take deep urls."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import decontam, linedup, neardup, quality, queries, topk, urls

SF = "/root/testdata/sf0.001"
#: Names that operators use inside.
INNER = """_id _stretch _row _dropped _first _lines _removed _gone _quality _leaking _text_hash _text _item component_id
  carried_0 carried_1 n_lines_ word line id score gone""".split()


@pytest.fixture(scope="module")
def docs(spark):
    given = queries.table(spark, SF, "documents")
    return given.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INNER})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_the_caller_pass_every_stage(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    plain = {r["doc_id"]: r["text"] for r in stage(spark, docs.drop(*INNER), SF).collect()}
    rows = out.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == plain
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in INNER)


def test_operators_with_counts_of_the_caller(spark, docs):
    some = docs.limit(30).withColumns({"n_lines": F.lit("x"), "N_Removed_": F.lit("y")})
    out = linedup.remove_lines(some)
    assert out.schema["n_lines"].dataType.simpleString() == "bigint" and "N_Removed_" in out.columns
    assert neardup.keep_one(some).columns == some.columns
    assert quality.keep_good(some, queries.table(spark, SF, "labels")).columns == some.columns


def test_rows_of_files_are_not_stored_again(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (1, "other words"), (2, text + " more"), (None, text), (3, None), (3, ""), (4, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("x"))
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    assert neardup.file_places(df) is None
    twice = files.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    assert neardup.file_places(twice) is None
    assert neardup.file_places(files.unionByName(files)) is None
    assert neardup.file_places(files) is not None
    seen = lambda out: sorted((r["doc_id"] or 0, r["text"] or "-", r["_row"]) for r in out.collect())
    left = [(0, text, "x"), (1, "other words", "x"), (1, text, "x"), (3, "", "x"), (3, "-", "x")]
    left = sorted((i, t or "-", x) for i, t, x in left)
    assert seen(neardup.keep_one(files, neardup.file_places(files))) == left
    assert seen(neardup.keep_one(files)) == left
    # rows without an id or a text are kept, each of them
    both = sorted(left + [r for r in left if r[0] in (0, 3)])
    assert seen(corpus_pipeline.near_dedup(spark, twice, SF)) == both


def test_leaks_go_by_the_text_of_a_row(spark):
    item = " ".join(f"w{k}" for k in range(20))
    half, rest = " ".join(f"w{k}" for k in range(12)), " ".join(f"w{k}" for k in range(8, 20))
    texts = [(None, f"before {item} after"), (None, "clean one"), (1, item), (1, "clean two"), (2, half), (2, rest)]
    texts += [(3, None), (4, item), (4, item), (5, "clean three"), (5, "clean three")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in decontam.remove_leaks(rows, benchmark).collect())
    assert left == sorted(
        [(0, "clean one"), (1, "clean two"), (2, half), (2, rest), (3, ""), (5, "clean three"), (5, "clean three")]
    )
    # the report keeps to documents: rows of one id are one document
    assert {r["doc_id"] for r in decontam.leaks(rows, benchmark).collect()} == {None, 1, 2, 4}


def test_one_deep_url_does_not_drive_the_run(spark):
    deep = "/".join(f"s{k}" for k in range(2000))
    pages = [(k, f"http://a.net/shop/x{k}") for k in range(40)] + [(99, f"http://a.org/{deep}"), (98, "http://a.org/other")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    began = time.monotonic()
    out = {r["page_id"]: r for r in urls.judge(df, queries.RULES).collect()}
    assert time.monotonic() - began < 60
    assert len(out) == 42 and out[99]["verdict"] == "allow" and out[99]["template"].count("/") == 2000
    assert {out[k]["verdict"] for k in range(40)} == {"block"}


def test_finite_components_of_any_size(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [1e10, 0.0]), (3, [-1e10, 1.0]), (4, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r["query_id"], r["vec_id"]) for r in topk.top_k(df, F.col("vec_id") < 2, 5).collect()}
    assert out == {(0, 1), (1, 0)}
