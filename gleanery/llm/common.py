"""What the operators share: reading tables, the shared scratch folder, and bounded slices of a batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one vectorised step inside a task looks at together; it bounds a worker's memory.
SLICE_CHARS = 250_000
#: Rows of an Arrow batch, where the session leaves Spark's default.
BATCH_ROWS = 1000
#: A key of at least this part of all rows is hot.
HOT_SHARE = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts with fewer rows than Spark's default of 10,000; another setting of the user's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none and runs on one machine, a folder under /tmp/checkpoints is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no DataFrame still to be run reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df._scratch)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` and ``table`` (one row a key; ``weight``: how many of the ``total`` rows have it) joined.

    Keys of at least 1 / HOT_SHARE of the rows, of which there are HOT_SHARE at most, are broadcast, so their rows stay where they are.
    """
    hot = F.broadcast(table.filter(F.col(weight) * HOT_SHARE >= max(1, total)))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(table, keys))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from the columns of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows of ``batches`` whose texts (null: empty) hold about ``limit`` UTF-8 bytes, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in column.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start), [t or "" for t in column.slice(start).to_pylist()]
