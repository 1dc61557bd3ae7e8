"""How large tables are written: small on disk, without sorting rows into their folders.

Raw events are kept as text in every table of a domain, so a run holds each payload several times.
``PACKED`` makes a copy half to a third as large as Spark's default does: stronger compression, and
numbers and ids stored as differences. The columns and rows are the same.

``lean`` is for what the writer has no option for. Rows for several folders (``partitionBy``) are
sorted by folder within every task, and rows with payloads are wide, so a large task spills most of
them for that; instead the files of a few folders stay open side by side. Files of shuffles stay on
the disks until the driver happens to collect garbage; instead they go with the job that wrote them.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Options of a Parquet writer.
PACKED = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "6",
    "parquet.writer.version": "v2",
}
#: Session options of a block of :func:`lean`. Streams hand their Parquet writer only those of the session.
LEAN = {
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    **{name: value for name, value in PACKED.items() if name.startswith("parquet.")},
}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Jobs of the block write into up to four folders a task unsorted and keep no shuffle files.

    Options that the session was given are left alone; the others are taken back at the end. A
    DataFrame that was run in the block and is run again makes its shuffles again.
    """
    put = {name: value for name, value in LEAN.items() if spark.conf.get(name, None) is None}
    for name, value in put.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in put:
            spark.conf.unset(name)
