"""Session helpers: lineage cuts in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted and takes at most so many bytes as rows.
BROADCAST_BYTES = 32 << 20
#: Tables that `cut_lineage` wrote and nothing has dropped, by session and innermost first by `scratch`.
_TABLES: list[list[tuple[SparkSession, str]]] = [[]]


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session within one machine (tests) gets a temporary one where nothing
    is set; elsewhere that raises, as a machine's own folder is not shared.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it from there.

    Unlike a checkpoint of rows the table is compressed, later reads take only
    the columns they need, and its size is known to the optimizer. The files
    outlive executors. They stay until `drop_tables`, or the end of the
    surrounding `scratch`.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES[-1].append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = (df.sparkSession, path)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a frame that `cut_lineage` gave, when nothing will read it again."""
    if (entry := getattr(df, "_table", None)) is not None:
        for tables in _TABLES:
            if entry in tables:
                tables.remove(entry)
        _delete([entry])


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        if spark.sparkContext._jsc is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables() -> None:
    """Delete the tables of `cut_lineage`. Call it when the results that read them are written."""
    _delete(_TABLES[-1])


@contextmanager
def scratch():
    """Tables of `cut_lineage` made within are deleted at the end: write the results before that."""
    _TABLES.append([])
    try:
        yield
    finally:
        _delete(_TABLES.pop())


def maybe_broadcast(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """Hint a broadcast if the counted number of rows, each of about `width` bytes, is within the bound."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df
