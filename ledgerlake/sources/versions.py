"""Write, then switch: a run's table becomes visible only when it is complete and not refused.

A version is a directory of Parquet files; a small JSON entry in ``_versions`` makes it the
current one. The entry is created last and never overwritten, so a failed or refused run leaves
the previous table in place. One writer per table at a time. Folders of older versions stay until
whoever runs the domains deletes them, because a reader may still hold one. This is no table format: append,
history, snapshots and merges are those of a v2 catalog (``publish_catalog``, ``pin_catalog``,
``merge_catalog``) where one is configured.
"""

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake.sources.packing import PACKED, lean

REJECTED = "rejected"


@dataclass(frozen=True)
class Version:
    id: int
    path: str
    split: bool = False
    schema: StructType | None = None

    def _rows(self, spark: SparkSession, path: str) -> DataFrame:
        return (spark.read if self.schema is None else spark.read.schema(self.schema)).parquet(path)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.split:
            return self._rows(spark, f"{self.path}/{REJECTED}=false").drop("validation_error")
        return self._rows(spark, self.path)

    def rejects(self, spark: SparkSession) -> DataFrame | None:
        """Rejected rows written together with a split version, None when there are none."""
        folder = f"{self.path}/{REJECTED}=true"
        return self._rows(spark, folder) if self.split and exists(spark, folder) else None


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath, _ = _fs(spark, path)
    return fs.exists(hpath)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder."""
    fs, hpath, _ = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hpath)]


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small file in one step from the driver; without ``overwrite`` it must not exist."""
    fs, entry, _ = _fs(spark, path)
    out = fs.create(entry, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def pin(spark: SparkSession, table: str, schema: StructType | None = None) -> Version | None:
    """The current version; resolve once and read only it for the whole run.

    It is read with the declared ``schema`` where one is given.
    """
    fs, folder, _ = _fs(spark, f"{table}/_versions")
    if not fs.exists(folder):
        return None
    ids = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder)]
    if not ids:
        return None
    path = version(table, max(ids)).path
    return Version(max(ids), path, exists(spark, f"{path}/{REJECTED}=false"), schema)


def last_batch(spark: SparkSession, table: str) -> int | None:
    """Last micro-batch committed to a streaming Parquet sink."""
    fs, folder, _ = _fs(spark, f"{table}/_spark_metadata")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName().split(".")[0] for s in fs.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=None)


def version(table: str, number: int) -> Version:
    return Version(number, f"{table}/v{number}")


def current(spark: SparkSession, table: str, schema: StructType | None = None) -> DataFrame | None:
    pinned = pin(spark, table, schema)
    return None if pinned is None else pinned.read(spark)


def publish(
    df: DataFrame,
    table: str,
    operation: str = "replace",
    guard: Callable[[DataFrame], None] | None = None,
) -> Version:
    """Write ``df`` as the next version and make it current.

    ``guard`` sees the written rows and may raise to refuse the commit.
    """
    spark = df.sparkSession
    new = replace(_next(spark, table), schema=df.schema)
    counted = Observation()
    rows = df.observe(counted, F.count("*").alias("rows"))
    rows.write.mode("overwrite").options(**PACKED).parquet(new.path)  # leftovers of a refused run
    return _guarded(spark, table, new, operation, guard, counted)


def publish_split(
    validated: DataFrame,
    table: str,
    settled: Callable[[], None],
    guard: Callable[[DataFrame], None] | None = None,
) -> Version:
    """Like :func:`publish` for rows with a boolean ``rejected``: one write, two folders.

    The table is the accepted folder; the rejected rows stay with the version.
    ``settled`` runs after the write and must refuse a version without accepted rows.
    """
    spark = validated.sparkSession
    target = _next(spark, table)
    written = StructType([f for f in validated.schema if f.name != REJECTED])
    new = Version(target.id, target.path, split=True, schema=written)
    counted = Observation()
    rows = validated.observe(counted, F.count_if(~F.col(REJECTED)).alias("rows"))
    with lean(spark):
        rows.write.mode("overwrite").options(**PACKED).partitionBy(REJECTED).parquet(new.path)
    settled()
    return _guarded(spark, table, new, "replace", guard, counted)


def _next(spark: SparkSession, table: str) -> Version:
    before = pin(spark, table)
    return version(table, 1 if before is None else before.id + 1)


def _guarded(spark, table, new, operation, guard, counted: Observation) -> Version:
    written = new.read(spark)
    if guard is not None:
        guard(written)
    _commit(spark, table, new, operation, counted.get["rows"])
    return new


def _commit(spark: SparkSession, table: str, new: Version, operation: str, rows: int) -> None:
    body = {
        "id": new.id,
        "committed_at": datetime.now(timezone.utc).isoformat(),
        "operation": operation,
        "row_count": rows,
        "path": new.path,
    }
    # fails if another writer committed this id
    write_text(spark, f"{table}/_versions/{new.id}.json", json.dumps(body), overwrite=False)


def publish_catalog(df: DataFrame, identifier: str, properties: dict[str, str] | None = None) -> None:
    """Atomic replace of a table in a v2 catalog."""
    writer = df.writeTo(identifier)
    for name, value in (properties or {}).items():
        writer = writer.tableProperty(name, value)
    writer.createOrReplace()


def pin_catalog(spark: SparkSession, identifier: str, snapshot_id: int) -> DataFrame:
    """A pinned snapshot of a catalog table."""
    return spark.read.option("snapshot-id", snapshot_id).table(identifier)


def merge_assignments(columns: Sequence[str], key: str, preserve: Sequence[str] = ()) -> dict[str, Column]:
    """What a matched row takes from the source: all but the key and the preserved columns."""
    return {c: F.col(f"source.{c}") for c in columns if c != key and c not in preserve}


def merge_catalog(df: DataFrame, identifier: str, key: str, preserve: Sequence[str] = ()) -> None:
    """Upsert of ``df`` (one row per key) by the catalog's own merge: only touched files change."""
    (
        df.alias("source")
        .mergeInto(identifier, F.col(f"{identifier}.{key}") == F.col(f"source.{key}"))
        .whenMatched()
        .update(merge_assignments(df.columns, key, preserve))
        .whenNotMatched()
        .insertAll()
        .merge()
    )
