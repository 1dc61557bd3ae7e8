"""Where intermediate tables of a run go: the shared folder named by the session."""

import uuid

from pyspark.sql import DataFrame, SparkSession

HIDDEN = ".scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a hidden folder of the warehouse stands in, which is refused when
    it is a local path and the session runs on more than one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{HIDDEN}"
        refuse_local(spark.sparkContext.master, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def refuse_local(master: str, base: str) -> None:
    """Executors of other machines cannot see a ``file:`` folder; only ``local`` masters may use one."""
    if base.startswith(("file:", "/")) and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{base} is local to one machine; set spark.checkpoint.dir to a shared folder")


def stored(
    df: DataFrame, name: str, compression: str | None = None, options: dict[str, str] | None = None
) -> DataFrame:
    """The rows written once as Parquet and read back: later readers neither repeat the work nor lose it."""
    path = scratch(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path, compression=compression)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
