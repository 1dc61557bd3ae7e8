"""The pipeline against plain versions of its stages, and the registration of all queries."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after every stage."""
    docs, out = queries.table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        out.append((docs, after))
        docs = after
    return out


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier",
        "line dedup",
        "near-duplicate removal",
        "benchmark decontamination",
        "source mixing",
    ]
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_run_equals_the_plain_stages(spark, stages):
    """From the classifier's decisions on, every stage is computed plainly."""
    docs = {r["doc_id"]: r for r in stages[0][1].collect()}
    source = {d: r["source"] for d, r in docs.items()}
    texts = [(d, r["text"]) for d, r in docs.items()]
    deduped = brute.without_lines(texts)
    texts = [(d, t) for d, (t, removed) in deduped.items() if not removed or brute.words(t)]
    assert sorted(texts) == sorted(rows(stages[1][1], "doc_id", "text"))
    texts = [(d, t) for d, t in texts if brute.components(texts)[d][2]]
    assert sorted(texts) == sorted(rows(stages[2][1], "doc_id", "text"))
    bad = {d for d, _ in brute.leaks(texts, rows(queries.table(spark, SF, "benchmark"), "item_id", "text"))}
    texts = [(d, t) for d, t in texts if d not in bad]
    expected = brute.mix([(d, source[d], t) for d, t in texts])
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert out.keys() == expected.keys()
    for d, (size, source_size, target, taken) in expected.items():
        assert (out[d]["size"], out[d]["source_size"], out[d]["taken"]) == (size, source_size, taken)
        assert out[d]["target"] == pytest.approx(target)


def test_stated_length_follows_the_text(stages):
    assert stages[1][1].filter(F.col("n_chars") != F.length("text")).count() <= (
        stages[1][0].filter(F.col("n_chars") != F.length("text")).count()
    )


def test_stages_take_nulls_and_no_rows(spark):
    docs = queries.table(spark, SF, "documents")
    nothing = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, SF).count() == 0, name
        assert stage(spark, odd.withColumn("id", F.lit(1)), SF).columns == [*docs.columns, "id"], name
    assert corpus_pipeline.mix(spark, nothing, SF).count() == 0
    assert corpus_pipeline.mix(spark, odd, SF).count() == 2


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
