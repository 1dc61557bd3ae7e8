"""Registered queries: every operator over the whole given tables.

Results are rendered for comparison: timestamps, dates and bytes as text.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schemas
from ledgerlake.functions.ordering import EARLIEST_DELIVERY
from ledgerlake.operators import bookings, dq, envelope, expect, gold, offsets, payments, reconcile, suite
from ledgerlake.operators.bronze import bronze_rows, copy_table
from ledgerlake.operators.reports import counts_by, orphan_share, reject_reasons
from ledgerlake.plans import derived, domains, joined, stages
from ledgerlake.plans.derived import AS_OF, redelivered
from ledgerlake.sources import buckets, catalog, outbox
from ledgerlake.sources.files import file_summary
from ledgerlake.sources.packing import PACKED, lean
from ledgerlake.sources.readers import id_list, record_files_stream
from ledgerlake.sources.scratch import discard, scratch, stored
from ledgerlake.streaming import fanout, ingest, progress, recover

FIRST_RUN, SECOND_RUN = datetime(2024, 2, 1), datetime(2024, 2, 2)


def rendered(df: DataFrame) -> DataFrame:
    def text(field: T.StructField):
        column = F.col(field.name)
        match field.dataType:
            case T.TimestampType() | T.TimestampNTZType():
                column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
            case T.DateType() | T.BinaryType():
                column = column.cast("string")
        return column.alias(field.name)

    return df.select(
        *(text(f) for f in df.schema if not isinstance(f.dataType, T.ArrayType))
    )


# --- inputs ----------------------------------------------------------------------


def booking_bronze(spark, sf):
    return derived.booking_bronze(spark, sf)


def booking_parsed(spark, sf):
    return envelope.parse(booking_bronze(spark, sf))


def booking_events(spark, sf):
    return envelope.dedupe(booking_parsed(spark, sf))


def booking_candidates(spark, sf):
    return bookings.candidates(booking_events(spark, sf))


def booking_clean(spark, sf):
    return bookings.clean(booking_candidates(spark, sf))


def bookings_now(spark, sf):
    return bookings.current(booking_clean(spark, sf))


def payment_events(spark, sf):
    """Parsed once and stored, so that ids are counted and rows read without making them again."""
    parsed = stored(envelope.parse(derived.payment_bronze(spark, sf)), "payment-parsed", "zstd")
    return envelope.dedupe(parsed, sparse=True)


def payment_candidates(spark, sf, strict=False):
    return payments.candidates(payment_events(spark, sf), strict)


def payment_clean(spark, sf):
    return payments.clean(payment_candidates(spark, sf))


def payments_now(spark, sf):
    return payments.current(payment_clean(spark, sf))


def shops(spark, sf):
    loaded = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return copy_table(derived.shops(spark, sf), loaded)


def dimension(spark, sf):
    return gold.dim_shops(shops(spark, sf))


def dq_candidates(spark, sf, at=FIRST_RUN):
    """Rejects of both booking stages, as one run over Bronze would record them."""
    parsed = booking_parsed(spark, sf)
    typed = bookings.candidates(envelope.dedupe(parsed))
    seen = F.lit(at)
    return dq.dq_rows(parsed, schemas.EVENTS_STAGE, seen, 1).unionByName(
        dq.dq_rows(typed, schemas.BOOKINGS_STAGE, seen, 1)
    )


def booking_stream(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a stream of topic records; the glob lets a single file be streamed."""
    schema = derived.table(spark, sf, "events").schema
    events = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/event[s].parquet")
    )
    return derived.booking_records(events)


def _ingest(spark, sf, root):
    return ingest.ingest_available(
        booking_stream(spark, sf),
        f"{root}/bronze/booking_events",
        f"{root}/checkpoints/booking_events",
        ingested_at=F.col("timestamp"),
    )


# --- bronze ----------------------------------------------------------------------


def bronze_bookings(spark, sf):
    return booking_bronze(spark, sf)


def bronze_rows_count_by_partition(spark, sf):
    return counts_by(booking_bronze(spark, sf), "kafka_topic", "kafka_partition")


def bronze_event_type_counts(spark, sf):
    return reconcile.event_type_counts(booking_bronze(spark, sf)).withColumnRenamed("count", "n")


def bronze_shops(spark, sf):
    return shops(spark, sf)


# --- envelope --------------------------------------------------------------------


def envelope_errors(spark, sf):
    return counts_by(booking_parsed(spark, sf), "validation_error")


def events_clean(spark, sf):
    return booking_events(spark, sf)


def events_clean_ranked(spark, sf):
    rows = envelope.accepted(booking_parsed(spark, sf)).select(*schemas.EVENTS_CLEAN)
    return joined.first_per_key_ranked(rows, "event_id", EARLIEST_DELIVERY)


def payment_events_envelope(spark, sf):
    return counts_by(payment_events(spark, sf), "event_type")


def duplicate_positions(spark, sf):
    """Bronze in which the redelivered records were ingested a second time."""
    bronze = booking_bronze(spark, sf)
    again = bronze.filter(redelivered("kafka_offset"))
    found = reconcile.duplicate_positions(bronze.unionAll(again))
    return found.withColumnRenamed("count", "n")


def payload_conflicts(spark, sf):
    """Some redeliveries carry another text for the same event."""
    event_id = F.expr("kafka_offset div 2")
    altered = F.when(redelivered("kafka_offset") & (event_id % 7 == 0), F.concat("payload", F.lit(" "))).otherwise(
        F.col("payload")
    )
    return envelope.conflicts(envelope.parse(booking_bronze(spark, sf).withColumn("payload", altered)))


def delivery_audit(spark, sf):
    audited = envelope.dedupe(booking_parsed(spark, sf), audit=True)
    return counts_by(audited, envelope.DELIVERIES, envelope.CONFLICT)


def settled_events(spark, sf):
    settled = envelope.settle(booking_parsed(spark, sf))
    return settled.select(
        envelope.REJECTED,
        "event_id",
        "validation_error",
        "kafka_partition",
        "kafka_offset",
        envelope.DELIVERIES,
        envelope.CONFLICT,
    )


# --- bookings --------------------------------------------------------------------


def booking_errors(spark, sf):
    return counts_by(booking_candidates(spark, sf), "event_type", "validation_error")


def booking_events_clean(spark, sf):
    return booking_clean(spark, sf)


def booking_type_counts(spark, sf):
    return counts_by(booking_clean(spark, sf), "event_type", "status")


def bookings_current(spark, sf):
    return bookings_now(spark, sf)


def bookings_current_join_twin(spark, sf):
    return joined.bookings_current(booking_clean(spark, sf))


def bookings_status_counts(spark, sf):
    return counts_by(bookings_now(spark, sf), "status")


def booking_orphans(spark, sf):
    """Bookings whose creation never arrived: the creations are withheld for odd bookings."""
    clean = booking_clean(spark, sf)
    lost = (F.col("event_type") == "booking_created") & (F.col("booking_id") % 2 == 1)
    current = bookings.current(clean.filter(~lost))
    return current.filter("is_orphan").select("booking_id", "status", "start_at", "customer_id")


def booking_transition_violations(spark, sf):
    return bookings.transition_violations(booking_clean(spark, sf))


# --- payments --------------------------------------------------------------------


def payment_errors(spark, sf):
    return counts_by(payment_candidates(spark, sf), "event_type", "validation_error")


def payment_reject_reasons(spark, sf):
    return reject_reasons(payment_candidates(spark, sf))


def payment_errors_strict(spark, sf):
    return counts_by(payment_candidates(spark, sf, strict=True), "event_type", "validation_error")


def payment_events_clean(spark, sf):
    return payment_clean(spark, sf)


def payment_null_status_accepted(spark, sf):
    clean = payment_clean(spark, sf)
    return clean.filter("payment_status IS NULL").select("event_id", "payment_id", "amount_krw")


def payment_tx_duplicates(spark, sf):
    """Movement ids cut to hundreds, so that the movements of a payment share an id."""
    moved = payments.transactions(payment_clean(spark, sf)).withColumn(
        "payment_transaction_id", F.expr("payment_transaction_id div 100")
    )
    found = expect.duplicates(moved, "payment_transaction_id")
    return found.withColumnRenamed("count", "n")


def payment_request_disagreement(spark, sf):
    """Requests under bookings: a booking with several payments has several amounts."""
    return expect.disagreeing(payment_clean(spark, sf), "booking_id", "request_amount_krw")


def payments_current(spark, sf):
    return payments_now(spark, sf)


def payments_current_join_twin(spark, sf):
    return joined.payments_current(payment_clean(spark, sf))


def payment_orphans(spark, sf):
    """Payments whose request never arrived: the requests of even payments are withheld."""
    clean = payment_clean(spark, sf)
    lost = (F.col("event_type") == "payment_requested") & (F.col("payment_id") % 2 == 0)
    return orphan_share(payments.current(clean.filter(~lost)))


def payment_status_counts(spark, sf):
    return counts_by(payments_now(spark, sf), "payment_status", "is_orphan")


def payment_transaction_errors(spark, sf):
    validated = payments.transaction_candidates(payment_events(spark, sf))
    return counts_by(validated, "event_type", "validation_error")


def payment_transactions_legacy(spark, sf):
    return payments.transactions_legacy(payments.transaction_candidates(payment_events(spark, sf)))


def payment_transactions_view(spark, sf):
    return payments.transactions(payment_clean(spark, sf)).select(
        "payment_transaction_id", "payment_id", "transaction_type", "amount_krw", "event_time"
    )


def ledger_reconciliation(spark, sf):
    return reconcile.payment_ledger_of_events(payment_clean(spark, sf))


def ledger_replay(spark, sf):
    return payments.ledger_replay(payment_clean(spark, sf))


def summary_violations(spark, sf):
    """Summary rules applied to every typed payment event, rejected ones included."""
    return payments.summary_violations(payment_candidates(spark, sf)).select(
        "event_id", "payment_id", "violation"
    )


# --- data quality ----------------------------------------------------------------


def dq_rows(spark, sf):
    return dq_candidates(spark, sf)


def dq_latest_per_key(spark, sf):
    return dq.latest_per_key(dq_candidates(spark, sf))


def dq_by_stage(spark, sf):
    return counts_by(dq_candidates(spark, sf), "validation_stage", "validation_error")


def _settled(spark, sf):
    """Both sides of one parse, written once for the stages that read it."""
    return stored(envelope.settle(booking_parsed(spark, sf)), "settled")


def _run_rejects(settled, at=FIRST_RUN, version=1):
    """What a run records: one row per rejected key of the envelope, and the typed rejects."""
    typed = bookings.candidates(settled.filter(~F.col(envelope.REJECTED)))
    seen = F.lit(at)
    return dq.dq_rows(settled, schemas.EVENTS_STAGE, seen, version).unionByName(
        dq.dq_rows(typed, schemas.BOOKINGS_STAGE, seen, version)
    )


def dq_merge_first_run(spark, sf):
    return dq.merge_dq(None, _run_rejects(_settled(spark, sf)))


def dq_merge_rerun(spark, sf):
    """Two runs that share a partition and together cover all: first 0 and 1, then 1 and 2."""
    settled = _settled(spark, sf)
    early = _run_rejects(settled).filter("kafka_partition <= 1")
    late = _run_rejects(settled, SECOND_RUN, 2).filter("kafka_partition >= 1")
    return dq.merge_dq(dq.merge_dq(None, early), late)


def dq_merge_incremental(spark, sf):
    """The runs of ``dq_merge_rerun`` into a table by buckets, of which each rewrites what it touches."""
    settled, table = _settled(spark, sf), scratch(spark, "dq")
    stages.merge_rejects(_run_rejects(settled).filter("kafka_partition <= 1"), table)
    stages.merge_rejects(_run_rejects(settled, SECOND_RUN, 2).filter("kafka_partition >= 1"), table)
    return buckets.current(spark, table, schemas.EVENT_DQ)


# --- gold ------------------------------------------------------------------------


def dim_shops(spark, sf):
    return dimension(spark, sf)


def shop_date_violations(spark, sf):
    """Shops whose closing date was entered as the opening date minus ten days."""
    wrong = F.when(F.col("shop_id") % 2 == 0, F.date_sub("opened_on", 10)).otherwise(F.col("closed_on"))
    return expect.shop_dates(dimension(spark, sf).withColumn("closed_on", wrong))


def shop_calendar(spark, sf):
    return gold.shop_calendar(dimension(spark, sf), AS_OF)


def shop_daily_booking_metrics(spark, sf):
    return gold.shop_daily_metrics(booking_clean(spark, sf), dimension(spark, sf), AS_OF)


# --- reconciliation --------------------------------------------------------------


def id_missing(spark, sf):
    """Outbox ids that cannot be found in the Bronze payloads."""
    found = reconcile.event_ids(booking_bronze(spark, sf))
    return reconcile.ids_missing(derived.outbox(spark, sf), found)


def id_unexpected(spark, sf):
    """Bronze ids that never became clean booking events."""
    found = reconcile.event_ids(booking_bronze(spark, sf)).filter("event_id IS NOT NULL")
    return reconcile.ids_missing(found, booking_clean(spark, sf))


def id_diff(spark, sf):
    """Clean booking events against the outbox rows of version one."""
    wanted = derived.outbox(spark, sf).filter("schema_version = 1")
    return reconcile.id_diff(wanted, booking_clean(spark, sf))


def _partial_bronze(spark, sf):
    """Bronze that lost the redeliveries and ingested partition 0 twice."""
    kept = booking_bronze(spark, sf).filter(~redelivered("kafka_offset"))
    return kept.unionAll(kept.filter("kafka_partition = 0"))


def topic_bronze_diff(spark, sf):
    records = derived.booking_records(derived.table(spark, sf, "events"))
    diff = reconcile.record_diff(records, _partial_bronze(spark, sf))
    return diff.select("difference", "kafka_partition", "kafka_offset", "payload")


def bronze_vs_topic(spark, sf):
    records = derived.booking_records(derived.table(spark, sf, "events"))
    return reconcile.bronze_vs_topic(records, _partial_bronze(spark, sf))


def bronze_reconciliation(spark, sf):
    """All figures of the reconciliation: records, positions, ids in both directions."""
    records = derived.booking_records(derived.table(spark, sf, "events"))
    return reconcile.bronze_reconciliation(records, _partial_bronze(spark, sf), derived.outbox(spark, sf))


def bronze_verified_kinds(spark, sf):
    """Records per kind of a Bronze that reconciles with its topic."""
    records = derived.booking_records(derived.table(spark, sf, "events"))
    return reconcile.verify_bronze(records, booking_bronze_copy(records)).withColumnRenamed("count", "n")


def booking_bronze_copy(records):
    return stored(bronze_rows(records, F.col("timestamp")), "bronze")


def offset_gaps(spark, sf):
    """Missing ranges of a Bronze from which ranges were withheld, at both ends of the topic too."""
    topic = derived.dense_positions(spark, sf)
    bounds = topic.groupBy(*offsets.STREAM).agg(
        F.min("kafka_offset").alias("first_offset"), F.max("kafka_offset").alias("last_offset")
    )
    return offsets.offset_gaps(topic.filter(~derived.withheld("kafka_offset")), bounds)


def ids_not_in_outbox(spark, sf):
    """Bronze ids the outbox never sent; NULL stands for records without a readable id."""
    found = reconcile.event_ids(booking_bronze(spark, sf))
    return reconcile.id_diff(derived.outbox(spark, sf), found).filter("difference = 'unexpected'").select("event_id")


def id_list_missing(spark, sf):
    """Outbox ids written as a text list, read back and looked for in Bronze."""
    path = scratch(spark, "ids")
    derived.outbox(spark, sf).select("event_id").write.text(path)
    return reconcile.ids_missing(id_list(spark, path), reconcile.event_ids(booking_bronze(spark, sf)))


def model_diff(spark, sf):
    clean = booking_clean(spark, sf)
    diff = reconcile.table_diff(
        bookings.current(clean), joined.bookings_current(clean), "aggregated", "joined"
    )
    return diff.select("difference", "booking_id", "status")


def strictness_diff(spark, sf):
    columns = ["event_id", "payment_id", "payment_status"]
    events = payment_events(spark, sf)
    default = payments.clean(payments.candidates(events)).select(*columns)
    strict = payments.clean(payments.candidates(events, strict=True)).select(*columns)
    return reconcile.table_diff(default, strict, "default_only", "strict_only")


def fk_violations(spark, sf):
    """Payments whose booking has no event."""
    return reconcile.fk_violations(
        payments_now(spark, sf), bookings_now(spark, sf), ["booking_id"], ["booking_id"]
    )


def bookable_slots(spark, sf):
    return reconcile.bookable_slots(
        derived.shops(spark, sf), derived.services(spark, sf), derived.staffs(spark, sf)
    )


def first_bookable_slot(spark, sf):
    return reconcile.first_bookable_slot(
        derived.shops(spark, sf), derived.services(spark, sf), derived.staffs(spark, sf)
    )


def paid_payments_with_booking(spark, sf):
    found = reconcile.payments_with_booking(payments_now(spark, sf), bookings_now(spark, sf), "paid")
    return found.select("payment_id", "booking_id", "shop_id", "booking_status", "paid_amount_krw")


# --- data tests ------------------------------------------------------------------


def not_null_violations(spark, sf):
    candidates = booking_candidates(spark, sf)
    return expect.not_null(candidates, "status", "event_time").select("event_id", "event_type")


def unique_violations(spark, sf):
    found = expect.unique(booking_parsed(spark, sf), "event_id")
    return found.withColumnRenamed("count", "n")


def accepted_values_violations(spark, sf):
    """Payment statuses outside the documented ones, rejected events included."""
    known = ("unpaid", "paid", "partially_refunded", "refunded")
    found = expect.accepted_values(payment_candidates(spark, sf), "payment_status", known)
    return found.withColumnRenamed("count", "n")


def contract_violations(spark, sf):
    """Contract of the clean table applied to all typed booking events."""
    return expect.booking_contract(booking_candidates(spark, sf)).select("event_id", "event_type")


def key_coverage(spark, sf):
    clean = booking_clean(spark, sf)
    created = clean.filter(F.col("event_type") == "booking_created")
    return expect.key_coverage(clean, created, "booking_id")


def expected_type_counts(spark, sf):
    expected = {kind: 100 for kind in schemas.BOOKING_EVENT_TYPES} | {"payment_requested": 0}
    return expect.counts(booking_clean(spark, sf), "event_type", expected)


def row_constraint_violations(spark, sf):
    """Table constraints over services, bookings, shops and outbox rows."""
    services = expect.row_checks(derived.services(spark, sf), expect.service_constraints())
    priced = expect.row_checks(booking_candidates(spark, sf), expect.booking_constraints())
    dated = expect.row_checks(dimension(spark, sf), expect.shop_constraints())
    sent = expect.row_checks(derived.outbox(spark, sf), expect.outbox_constraints())
    moved = expect.row_checks(payment_candidates(spark, sf), expect.movement_constraints())
    parts = [
        services.select(F.lit("services").alias("relation"), "violation"),
        priced.select(F.lit("bookings").alias("relation"), "violation"),
        dated.select(F.lit("shops").alias("relation"), "violation"),
        sent.select(F.lit("outbox").alias("relation"), "violation"),
        moved.select(F.lit("movements").alias("relation"), "violation"),
    ]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionAll(part)
    return counts_by(everything, "relation", "violation")


def test_suite_report(spark, sf):
    """All data tests of the clean bookings, and two stricter ones, on all typed events."""
    extra = [
        suite.unique("booking_id", "event_type"),
        suite.AgreementTest("one service per booking", ("booking_id",), "service_id"),
    ]
    return suite.report(booking_candidates(spark, sf), stages.booking_tests() + extra)


def one_payment_per_booking(spark, sf):
    found = expect.unique(payments_now(spark, sf), "booking_id")
    return found.withColumnRenamed("count", "n")


# --- outbox ----------------------------------------------------------------------


def outbox_records(spark, sf):
    records = outbox.outbox_to_records(derived.outbox(spark, sf))
    header = F.col("headers")[0]
    return records.select(
        "key", "value", "topic", header["key"].alias("header"), header["value"].alias("header_value")
    )


def lost_outbox_records(spark, sf):
    return outbox.lost_records(derived.outbox(spark, sf), booking_bronze(spark, sf)).select(
        "key", "value"
    )


# --- streaming, versions, domain runs ----------------------------------------------


def stream_bronze_count(spark, sf):
    root = scratch(spark, "stream")
    _ingest(spark, sf, root)
    stored = ingest.read_bronze(spark, f"{root}/bronze/booking_events")
    return counts_by(stored, "ingest_date", "kafka_partition")


def stream_bronze_rows(spark, sf):
    root = scratch(spark, "stream")
    _ingest(spark, sf, root)
    stored = ingest.read_bronze(spark, f"{root}/bronze/booking_events")
    return stored.select("payload", "kafka_key", "kafka_partition", "kafka_offset", "bronze_ingested_at")


def stream_resume(spark, sf):
    """Rows stored after each of two runs on one checkpoint."""
    root = scratch(spark, "stream")
    after = []
    for run in (1, 2):
        _ingest(spark, sf, root)
        stored = ingest.read_bronze(spark, f"{root}/bronze/booking_events")
        after.append(stored.agg(F.lit(run).alias("run"), F.count("*").alias("n")))
    return after[0].unionAll(after[1])


def stream_progress(spark, sf):
    """Batches of three runs on one checkpoint; before each the records of one more partition arrive."""
    root = scratch(spark, "stream")
    records = derived.booking_records(derived.table(spark, sf, "events"))
    with progress.logged(spark, f"{root}/progress") as log:
        for partition in range(3):
            records.filter(F.col("partition") == partition).write.mode("append").parquet(f"{root}/topic")
            ingest.ingest_available(
                record_files_stream(spark, f"{root}/topic"), f"{root}/bronze", f"{root}/checkpoint", log
            )
    return progress.read_progress(spark, f"{root}/progress").select("batch_id", "input_rows")


def _fanned_out(spark, sf):
    """Three batches, each with the records of one more partition."""
    root = scratch(spark, "stream")
    records = derived.booking_records(derived.table(spark, sf, "events"))
    for partition in range(3):
        records.filter(F.col("partition") == partition).write.mode("append").parquet(f"{root}/topic")
        stream = record_files_stream(spark, f"{root}/topic")
        fanout.start(stream, f"{root}/bronze", f"{root}/checkpoint", ingested_at=F.col("timestamp")).awaitTermination()
    return root, records


def stream_fanout_rows(spark, sf):
    """Bronze written batch by batch, after the second batch was stored once more."""
    root, records = _fanned_out(spark, sf)
    again = records.filter("partition = 1")
    fanout.store_batch(again, 1, f"{root}/bronze", 4, ingested_at=F.col("timestamp"))
    last = fanout.committed_batch(spark, f"{root}/checkpoint")
    stored = fanout.read_batches(spark, f"{root}/bronze", last)
    return stored.select("payload", "kafka_key", "kafka_partition", "kafka_offset", "bronze_ingested_at")


def bronze_as_of_batch(spark, sf):
    """Bronze as it was after its first batch, read after two more."""
    root, _ = _fanned_out(spark, sf)
    stored = fanout.read_batches(spark, f"{root}/bronze", 0)
    return counts_by(stored, "ingest_batch", "ingest_date", "kafka_partition")


def recovered_bronze(spark, sf):
    """A Bronze that lacks a tenth of the events, and after each of two recoveries."""
    root = scratch(spark, "stream")
    topic, target, checkpoint = f"{root}/topic", f"{root}/bronze", f"{root}/checkpoint"
    sent = derived.outbox(spark, sf)
    records = derived.booking_records(derived.table(spark, sf, "events"))
    records.filter(F.expr("offset div 2 % 10 <> 3")).write.parquet(topic)
    readable = sent.filter(F.get_json_object("payload", "$.event_id") == F.col("event_id"))
    figures = []
    for run in range(3):
        if run:
            recover.recover(spark, sent, topic, target, checkpoint, 3, ingested_at=F.col("timestamp"))
        else:
            stream = record_files_stream(spark, topic)
            ingest.ingest_available(stream, target, checkpoint, ingested_at=F.col("timestamp"))
        bronze = ingest.read_bronze(spark, target)
        missing = reconcile.ids_missing(readable, reconcile.event_ids(bronze))
        parts = (bronze.agg(F.count("*")), missing.agg(F.count("*")), reconcile.duplicate_positions(bronze).agg(F.count("*")))
        for name, part in zip(("stored", "missing", "repeated_positions"), parts, strict=True):
            figures.append(part.toDF("n").select(F.lit(run).alias("run"), F.lit(name).alias("figure"), "n"))
    everything = figures[0]
    for part in figures[1:]:
        everything = everything.unionAll(part)
    return everything


def bronze_files(spark, sf):
    """Rows of the data files of every ingest day."""
    root = scratch(spark, "stream")
    _ingest(spark, sf, root)
    found = file_summary(ingest.read_bronze(spark, f"{root}/bronze/booking_events"), "ingest_date")
    return found.select(
        "ingest_date", "rows", (F.col("files") > 0).alias("has_files"), (F.col("bytes") >= F.col("largest")).alias("sized")
    )


def _created(spark, root):
    """A Bronze table of the session's catalog, partitioned by day."""
    namespace = f"ledger_{root.rsplit('-', 1)[-1]}"
    catalog.ensure_namespace(spark, namespace, f"{root}/namespace")
    day = T.StructField(ingest.INGEST_DATE, T.DateType())
    columns = T.StructType([f for f in schemas.BRONZE if f.name != "kafka_headers"] + [day])
    for _ in range(2):  # the second time does nothing
        catalog.ensure_table(
            spark, f"{namespace}.bronze", columns, [ingest.INGEST_DATE], {"layer": "bronze"}, f"{root}/bronze"
        )
    return f"{namespace}.bronze"


def created_table_columns(spark, sf):
    """Columns of the created table and how many rows of Bronze have a value there."""
    table = _created(spark, scratch(spark, "catalog"))
    _append(spark, sf, table)
    columns = [(c.name, c.dataType, c.isPartition) for c in spark.catalog.listColumns(table)]
    listed = spark.createDataFrame(columns, "name string, type string, is_partition boolean")
    filled = spark.table(table).agg(*(F.count(name).alias(name) for name, _, _ in columns))
    filled = filled.unpivot([], [name for name, _, _ in columns], "name", "filled")
    return listed.join(filled, "name")


def _append(spark, sf, table):
    rows = booking_bronze(spark, sf).withColumn(ingest.INGEST_DATE, F.to_date("bronze_ingested_at"))
    catalog.append(rows.drop("kafka_headers"), table)


def appended_rows(spark, sf):
    """Bronze appended twice to a created table, the second time with narrower positions."""
    table = _created(spark, scratch(spark, "catalog"))
    _append(spark, sf, table)
    rows = booking_bronze(spark, sf).withColumn(ingest.INGEST_DATE, F.to_date("bronze_ingested_at"))
    narrow = rows.drop("kafka_headers").withColumn("kafka_offset", F.col("kafka_offset").cast("int"))
    catalog.append(narrow.select(*sorted(narrow.columns)), table)
    return counts_by(spark.table(table), ingest.INGEST_DATE, "kafka_partition")


def _run(spark, sf, *names):
    root = scratch(spark, "lake")
    _ingest(spark, sf, root)
    reports = []
    for name in names:
        if name == "gold":
            run = stages.Run(spark, stages.Layout(root), AS_OF, FIRST_RUN)
            reports.append(stages.bronze_shops(run, derived.shops(spark, sf)))
        reports += domains.run(spark, root, name, AS_OF, FIRST_RUN)
    return root, domains.report(spark, reports)


def booking_domain_run(spark, sf):
    _, report = _run(spark, sf, "booking", "gold")
    return report.drop("source_version")


def booking_chain_run(spark, sf):
    _, report = _run(spark, sf, "booking_chain")
    return report.drop("source_version")


def selected_run(spark, sf):
    """All that reads or is read by the typed events; no shop was loaded, so the metrics are skipped."""
    root = scratch(spark, "lake")
    _ingest(spark, sf, root)
    found = domains.run_selected(spark, root, "+booking_events_clean+ dim_shops", AS_OF, FIRST_RUN)
    return domains.outcomes(spark, found).drop("reason")


def booking_domain_dq(spark, sf):
    root, _ = _run(spark, sf, "booking")
    table = buckets.current(spark, f"{root}/silver/event_dq", schemas.EVENT_DQ)
    return table.drop("source_snapshot_id")


def payment_domain_run(spark, sf):
    """Payment records published as topic files, streamed into Bronze, then rebuilt."""
    root = scratch(spark, "lake")
    with lean(spark):
        records = derived.payment_records(
            derived.table(spark, sf, "orders"), derived.table(spark, sf, "lineitem")
        )
        topic = stored(records, "topic", options=PACKED)
    ingest.ingest_available(
        record_files_stream(spark, topic._scratch, max_files=1000),
        f"{root}/bronze/booking_events",
        f"{root}/checkpoints/booking_events",
        ingested_at=F.lit(FIRST_RUN),
    )
    discard(topic)
    reports = domains.run(spark, root, "payment", AS_OF, FIRST_RUN)
    return domains.report(spark, reports).drop("source_version")


QUERIES = [
    bronze_bookings,
    bronze_rows_count_by_partition,
    bronze_event_type_counts,
    bronze_shops,
    envelope_errors,
    events_clean,
    events_clean_ranked,
    payment_events_envelope,
    duplicate_positions,
    payload_conflicts,
    delivery_audit,
    settled_events,
    booking_errors,
    booking_events_clean,
    booking_type_counts,
    bookings_current,
    bookings_current_join_twin,
    bookings_status_counts,
    booking_orphans,
    booking_transition_violations,
    payment_errors,
    payment_reject_reasons,
    payment_errors_strict,
    payment_events_clean,
    payment_null_status_accepted,
    payment_tx_duplicates,
    payment_request_disagreement,
    payments_current,
    payments_current_join_twin,
    payment_orphans,
    payment_status_counts,
    payment_transaction_errors,
    payment_transactions_legacy,
    payment_transactions_view,
    ledger_reconciliation,
    ledger_replay,
    summary_violations,
    dq_rows,
    dq_latest_per_key,
    dq_by_stage,
    dq_merge_first_run,
    dq_merge_rerun,
    dq_merge_incremental,
    dim_shops,
    shop_date_violations,
    shop_calendar,
    shop_daily_booking_metrics,
    id_missing,
    id_unexpected,
    id_diff,
    topic_bronze_diff,
    bronze_vs_topic,
    bronze_reconciliation,
    bronze_verified_kinds,
    offset_gaps,
    ids_not_in_outbox,
    id_list_missing,
    model_diff,
    strictness_diff,
    fk_violations,
    bookable_slots,
    first_bookable_slot,
    paid_payments_with_booking,
    not_null_violations,
    unique_violations,
    accepted_values_violations,
    contract_violations,
    key_coverage,
    expected_type_counts,
    row_constraint_violations,
    test_suite_report,
    one_payment_per_booking,
    outbox_records,
    lost_outbox_records,
    stream_bronze_count,
    stream_bronze_rows,
    stream_resume,
    stream_progress,
    stream_fanout_rows,
    bronze_as_of_batch,
    recovered_bronze,
    bronze_files,
    created_table_columns,
    appended_rows,
    booking_domain_run,
    booking_chain_run,
    selected_run,
    booking_domain_dq,
    payment_domain_run,
]


def _registered(query):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rendered(query(spark, sf_dir))

    call.__name__, call.__doc__ = query.__name__, query.__doc__
    return call


def catalogue():
    return {query.__name__: _registered(query) for query in QUERIES}
