"""What the corpus operators share: tables in the shared folder and Arrow batches in tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, types as T

from skyloom.session import workspace

# An Arrow batch holds at most this much, whatever the length of a text.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def by_value(module: str) -> None:
    """Send the functions of ``module`` to the tasks by value: executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, lost executors cost nothing."""
    path = workspace(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, '' for null."""
    return [t if t is not None else "" for t in column.to_pylist()]


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def with_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``fields``, computed per Arrow batch, to the columns ``keep`` (default: all).

    ``make`` runs once in each task and returns a function that takes the Arrow columns named
    in ``inputs`` and returns one list or Arrow array per field. A kept column that has the name
    of a new one is replaced by it.
    """
    bounded_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*[df[c] for c in dict.fromkeys([*kept, *inputs])])
    schema = T.StructType([*(source.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if batch.num_rows:
                made = compute(*(batch.column(c) for c in inputs))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)],
                    names=[*kept, *(f.name for f in fields)],
                )
        give_back()

    return source.mapInArrow(run, schema)


def process_store(name: str, make: Callable[[], object]):
    """An object kept in this Python process under ``name``: workers live on from task to task."""
    holder = sys.modules.setdefault("_skyloom_store", type(sys)("_skyloom_store"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
