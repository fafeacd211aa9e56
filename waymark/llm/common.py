"""Plumbing shared by the text operators: reading tables, per-batch text columns, checkpoints.

Conventions that hold for every operator of this subpackage:

* a null text counts as the empty text;
* an operator reads only the id and text columns it is told about, so extra
  columns never matter; a column whose name an operator itself produces is
  replaced by the operator's own;
* repeated rows are separate rows and get equal values;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one call of a batch function sees at most; bounds a Python worker's memory.
ROWS_AT_ONCE = 512
#: Upper bound in bytes of anything that these operators broadcast.
BROADCAST_LIMIT = 16 << 20
#: Keys that a join treats as hot at most.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def share(spark: SparkSession, value, n_bytes: int) -> Broadcast:
    """Broadcast a value whose size the caller has measured; larger ones are refused."""
    if n_bytes > BROADCAST_LIMIT:
        raise ValueError(f"{n_bytes} bytes are too many to broadcast (limit {BROADCAST_LIMIT})")
    return spark.sparkContext.broadcast(value)


def append_from_text(
    df: DataFrame,
    column: str,
    fields: T.StructType,
    make: Callable[[], Callable[[list], Sequence[pa.Array]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append ``fields`` computed from one text or binary column, a slice of a batch at a time.

    ``make`` runs once a task and returns a function from a list of values
    (nulls included) to one Arrow array a field. ``keep`` names the columns to
    carry along, by default all; those named like a new field are replaced.
    """
    names = fields.fieldNames()
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(column)).alias("\u0001value"))
    out_names = [*kept, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                values = batch.column(batch.num_columns - 1).to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *work(values)], names=out_names)

    schema = T.StructType([*source.schema.fields[:-1], *fields.fields])
    return source.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
    local session (tests) takes a temporary folder; on a cluster, whose
    executors don't share one, that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right``, whatever part of ``left`` has one key.

    Keys with more than one in HOT_KEYS of the rows of ``left`` are HOT_KEYS at
    most; they are broadcast, so rows that have one stay where they are. The
    others are shuffled. Both sides should be checkpointed.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("\u0001n"))
    hot = counts.where(F.col("\u0001n") > left.count() // HOT_KEYS).select(key)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return left.join(few, key).unionByName(rest)
