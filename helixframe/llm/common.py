"""What the training-data operators share: reading, batches, checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from helixframe.lineage import ensure_checkpoint_dir, stash  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _drop(files, place) -> None:
    """Deletes a folder; the folder stays if the JVM is gone."""
    with contextlib.suppress(Exception):
        files.delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """Like stash, as compressed Parquet in the same shared folder: for large tables that are read more than once. The
    table is deleted when the application ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder.rstrip('/')}/helixframe-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_drop, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes in an Arrow batch that goes to a worker.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with batches bounded in bytes: the session's limit is lowered where it is larger, since 10,000
    long texts in a batch would not fit in a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def map_columns(df: DataFrame, function: Callable[..., dict], schema: str) -> DataFrame:
    """Applies `function(*columns as Python lists) -> {name: list}` to Arrow batches of df, in batches of bounded bytes.

    The function runs once per slice of at most about 4 MB of input (one row at least), so neither very long texts
    nor many rows at a time raise a worker's memory beyond a few times the longest text.
    """
    from pyspark.sql.types import StructType

    return map_rows(df, function, StructType.fromDDL(schema))


def map_rows(df: DataFrame, function: Callable[..., dict], fields) -> DataFrame:
    """map_columns with the result's StructType."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)
        for batch in batches:
            for piece in slices(batch):
                found = function(*(column.to_pylist() for column in piece.columns))
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type) for f in arrow], schema=arrow)

    return map_batches(df, run, fields)


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice holds about `most` bytes, one row at least."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, min(rows, int(rows * most / max(1, batch.nbytes))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)
