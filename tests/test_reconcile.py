from collections import Counter

import pytest
from fixtures import event, NOON, bronze, records
from pyspark.sql import functions as F

from ledgerlake.operators import expect, reconcile
from ledgerlake.operators.bronze import bronze_rows
from ledgerlake.sources import outbox, readers


@pytest.mark.parametrize("chunk", [1_000_000, 2])
def test_table_diff_is_a_multiset_difference(spark, monkeypatch, chunk):
    monkeypatch.setattr(reconcile, "_CHUNK", chunk)
    a = [(1, "x")] * 7 + [(2, None)] * 2 + [(3, "z")]
    b = [(1, "x")] * 2 + [(2, None)] * 3 + [(3, "z"), (4, "w")]
    schema = "i int, s string"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = Counter(tuple(r) for r in reconcile.table_diff(left, right, "a", "b").collect())
    expected = Counter({("a", *k): n for k, n in (Counter(a) - Counter(b)).items()})
    expected += Counter({("b", *k): n for k, n in (Counter(b) - Counter(a)).items()})
    assert got == expected
    builtin = left.exceptAll(right).count() + right.exceptAll(left).count()
    assert sum(got.values()) == builtin


def test_bronze_matches_topic(spark):
    topic = records(spark, [event(f"e{i}", "checked_in", NOON) for i in range(5)] + ["junk", None])
    stored = bronze_rows(topic)
    clean = reconcile.bronze_vs_topic(topic, stored).first()
    assert tuple(clean) == (7, 7, 0, 0, 0)
    off = reconcile.bronze_vs_topic(topic, stored.filter("kafka_offset > 0").unionAll(stored.filter("kafka_offset = 1")))
    assert tuple(off.first()) == (7, 7, 1, 1, 1)
    assert reconcile.duplicate_positions(stored).isEmpty()


def test_record_diff_is_a_multiset_difference(spark):
    topic = records(spark, [event(f"e{i}", "checked_in", NOON) for i in range(5)] + ["junk", None, ""])
    stored = bronze_rows(topic)
    assert reconcile.record_diff(topic, stored).isEmpty()
    changed = F.when(F.col("kafka_offset") == 2, F.lit("other")).otherwise(F.col("payload"))
    off = stored.filter("kafka_offset > 0").unionAll(stored.filter("kafka_offset IN (1, 6)")).withColumn("payload", changed)
    got = sorted((r.difference, r.kafka_offset, str(r.payload)[:5]) for r in reconcile.record_diff(topic, off).collect())
    assert [(d, o) for d, o, _ in got] == [("bronze_only", 1), ("bronze_only", 2), ("bronze_only", 6), ("topic_only", 0), ("topic_only", 2)]
    builtin = reconcile.table_diff(*reconcile._recorded(topic, off), "topic_only", "bronze_only")
    assert sorted((r.difference, r.kafka_offset, str(r.payload)[:5]) for r in builtin.collect()) == got


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (lambda t, s, i: (t.filter("offset < 0"), s, i), "no records"),
        (lambda t, s, i: (t, s.filter("kafka_offset > 0"), i), "missing=1"),
        (lambda t, s, i: (t, s.unionAll(s.filter("kafka_offset = 1")), i), "extra=1, duplicate_positions=1"),
        (lambda t, s, i: (t, s, i.filter("event_id <> 'e1'")), "ids_unexpected=1"),
        (lambda t, s, i: (t, s, i.selectExpr("concat(event_id, 'x') event_id").unionAll(i)), "ids_missing=3"),
        (lambda t, s, i: (t, s, i.limit(0)), "list of expected ids is empty"),
    ],
)
def test_bronze_that_does_not_reconcile_is_refused(spark, change, reason):
    topic = records(spark, [event(f"e{i}", "checked_in", NOON) for i in range(3)])
    ids = spark.createDataFrame([(f"e{i}",) for i in range(3)], "event_id string")
    kinds = reconcile.verify_bronze(topic, bronze_rows(topic), ids)
    assert [tuple(r) for r in kinds.collect()] == [("checked_in", 3)]
    with pytest.raises(expect.CheckFailed, match=reason):
        reconcile.verify_bronze(*change(topic, bronze_rows(topic), ids))


def test_records_without_an_id_do_not_reconcile(spark):
    topic = records(spark, [event("e0", "checked_in", NOON), "junk"])
    ids = spark.createDataFrame([("e0",)], "event_id string")
    with pytest.raises(expect.CheckFailed, match="ids_unexpected=1"):
        reconcile.verify_bronze(topic, bronze_rows(topic), ids)


def test_empty_tables_reconcile_to_zero(spark):
    topic = records(spark, ["{}"]).filter("offset < 0")
    assert tuple(reconcile.bronze_vs_topic(topic, bronze_rows(topic)).first()) == (0, 0, 0, 0, 0)


def test_id_list_and_differences(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a\n\n  b \nb\nc\n   \n")
    wanted = readers.id_list(spark, str(tmp_path / "ids.txt"))
    assert {r.event_id for r in wanted.collect()} == {"a", "b", "c"}
    stored = bronze(spark, [event("b", "t", NOON), event("d", "t", NOON), event("d", "t", NOON), "{}"])
    found = reconcile.event_ids(stored)
    assert {r.event_id for r in reconcile.ids_missing(wanted, found).collect()} == {"a", "c"}
    diff = {(r.event_id, r.difference) for r in reconcile.id_diff(wanted, found).collect()}
    # a record without a readable id is unexpected, a NULL in the list is no id
    assert diff == {("a", "missing"), ("c", "missing"), ("d", "unexpected"), (None, "unexpected")}
    with_null = wanted.unionByName(spark.createDataFrame([(None,)], "event_id string"))
    assert {(r.event_id, r.difference) for r in reconcile.id_diff(with_null, found).collect()} == diff
    kinds = {r.event_type: r["count"] for r in reconcile.event_type_counts(stored).collect()}
    assert kinds == {"t": 3, None: 1}


def test_foreign_keys_ignore_missing_children(spark):
    child = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 9)], "id int, shop_id int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    rows = reconcile.fk_violations(child, parent, ["shop_id"], ["id"]).collect()
    assert [tuple(r) for r in rows] == [(9, 1)]


def test_slots_take_the_first_active_ids(spark):
    shops = spark.createDataFrame([(1, False), (2, True), (3, True), (4, True)], "id int, is_active boolean")
    services = spark.createDataFrame(
        [(10, 2, 500, False), (12, 2, 700, True), (11, 2, 600, True), (13, 3, 1, True), (14, 1, 1, True)],
        "id int, shop_id int, list_price_krw int, is_active boolean",
    )
    staffs = spark.createDataFrame([(5, 2, True), (4, 2, True), (3, 2, False), (1, 1, True)], "id int, shop_id int, is_active boolean")
    rows = reconcile.bookable_slots(shops, services, staffs).collect()
    assert [tuple(r) for r in rows] == [(2, 11, 4, 600)]
    assert reconcile.first_bookable_slot(shops, services, staffs).count() == 1


def test_outbox_records_and_recovery(spark):
    rows = spark.createDataFrame(
        [("e1", "3", '{"event_id":"e1"}'), ("e2", "3", '{"event_id":"e2"}')],
        "event_id string, partition_key string, payload string",
    )
    sent = outbox.outbox_to_records(rows, "topic").orderBy("value").collect()
    assert [(bytes(r.key), bytes(r.value), r.topic, r.headers[0].key, bytes(r.headers[0].value)) for r in sent] == [
        (b"3", b'{"event_id":"e1"}', "topic", "id", b"e1"),
        (b"3", b'{"event_id":"e2"}', "topic", "id", b"e2"),
    ]
    stored = bronze(spark, ['{"event_id":"e1"}'])
    (lost,) = outbox.lost_records(rows, stored).collect()
    assert bytes(lost.value) == b'{"event_id":"e2"}'


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", -1), (None, None, None), (None, "a", 7)], "k int, s string, n int")
    assert expect.not_null(df, "k", "n").count() == 2
    assert [tuple(r) for r in expect.unique(df, "k").collect()] == [(1, 2)]
    assert expect.duplicates(df, "k").count() == 2
    assert [tuple(r) for r in expect.accepted_values(df, "s", ["a"]).collect()] == [("b", 1)]
    assert expect.check(df, "positive", F.col("n") > 0).select("n", "violation").collect() == [(-1, "positive")]
    assert [r.k for r in expect.disagreeing(df, "k", "s").collect()] == [1]
    marks = expect.row_checks(df, {"positive": F.col("n") > 0, "small": F.col("n") < 6})
    assert sorted((r.n, r.violation) for r in marks.collect()) == [(-1, "positive"), (7, "small")]


def test_key_coverage(spark):
    source = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    output = spark.createDataFrame([(1,), (2,), (2,), (4,)], "k int")
    rows = expect.key_coverage(source, output, "k").collect()
    assert sorted(tuple(r) for r in rows) == [(2, 1, 2), (3, 1, 0), (4, 0, 1)]
    with pytest.raises(expect.CheckFailed):
        expect.require_none(expect.key_coverage(source, output, "k"), "keys differ")


def test_summary_with_booking(spark):
    payments = spark.createDataFrame([(1, 5, 9, "paid"), (2, 6, 9, "unpaid"), (3, 7, 9, "paid")], "payment_id int, booking_id int, shop_id int, payment_status string")
    bookings = spark.createDataFrame([(5, 1, "checked_in"), (6, 1, "checked_in")], "booking_id int, shop_id int, status string")
    rows = reconcile.payments_with_booking(payments, bookings, "paid").collect()
    assert [(r.payment_id, r.shop_id, r.booking_status) for r in rows] == [(1, 1, "checked_in")]
