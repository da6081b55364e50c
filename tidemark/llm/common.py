"""What the corpus operators share: durable cut points, word rules and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_tables: list[tuple[SparkSession, str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that this application may write to.

    It is read from the session. Only a local session without the setting gets a folder of its own,
    as driver and executors then are one process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, dropped by `sweep`."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _tables.append((spark, path, ""))
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write `df` once to the shared folder and read it from there: lineage ends, every later use sees the same rows."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str = "bucketed") -> DataFrame:
    """Like `cut`, but stored in buckets of `key`, as many as the shuffle is wide: what groups or joins by `key` later reads it without an exchange."""
    path, name = new_path(df.sparkSession, label), f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(df.sparkSession), key).option("path", path).saveAsTable(name)
    _tables[-1] = (df.sparkSession, path, name)
    return df.sparkSession.table(name)


def tables() -> list[str]:
    """The paths that `cut`, `bucketed` and `new_path` have given out and `sweep` has not dropped."""
    return [path for _, path, _ in _tables]


def sweep(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete what `cut` has written in this session, or the given paths of it. Call it once the results that depend on them are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for entry in [x for x in _tables if x[0] is spark and (paths is None or x[1] in set(paths))]:
        if entry[2]:
            spark.sql(f"DROP TABLE IF EXISTS {entry[2]}")
        where = jvm.org.apache.hadoop.fs.Path(entry[1])
        where.getFileSystem(conf).delete(where, True)
        _tables.remove(entry)


def partitions(spark: SparkSession) -> int:
    """The shuffle width of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Rows of an Arrow batch that Python objects are made of at once.
ROWS_AT_ONCE = 1024


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], dict | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function from a few rows to columns (None: nothing to give)."""
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                if (columns := rows(batch.slice(start, ROWS_AT_ONCE))) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


# Hot keys: rows that share a key within a batch need not all travel to the task of that key.

ALONE, FIRST, FURTHER = 0, 1, 2
#: An odd number whose multiples lie far apart.
STRIDE = 0x9E3779B97F4A7C15 - (1 << 64)


def meeting(keys: Sequence[np.ndarray], order: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number to deal by, state) of each row of a batch, so that a key that very many rows have loads its task with one row a batch.

    A key is all of `keys` together, dealt by the first. Of the rows of one key the smallest by `order` goes to
    the key's task (ALONE, or FIRST where the batch has more of them); what the batch itself shows of the
    others (FURTHER) needs no meeting, and they are spread by `salt`.
    """
    place = np.lexsort((order, *keys[::-1]))
    first = np.zeros(len(place), bool)
    first[:1] = True
    for key in keys:
        first[1:] |= key[place][1:] != key[place][:-1]
    sizes = np.diff(np.append(np.flatnonzero(first), len(place)))
    state = np.empty(len(place), np.int8)
    state[place] = np.where(first, np.repeat(np.where(sizes > 1, FIRST, ALONE), sizes), FURTHER)
    return np.where(state == FURTHER, salt, keys[0]), state
