"""What several operators share: reading a table and cutting lineage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where it names none, one below the warehouse is
    set, which executors share as well."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that a lost executor costs a reread and not the work."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path in the shared folder, for tables between steps."""
    return f"{_checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """A folder of tables between steps, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, as what a worker makes of texts is larger than they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    give_back()


#: What this worker process keeps from task to task, by operator and name.
_kept: dict[str, dict[Hashable, object]] = {}


def kept[T](operator: str, name: Hashable, make: Callable[[], T]) -> T:
    """What an operator keeps in a worker from task to task, made at first. A worker outlives an operator's tasks, so it
    keeps what is one operator's alone: begin() of another one lets it go."""
    own = _kept.setdefault(operator, {})
    if name not in own:
        own[name] = make()
    return own[name]


def begin(operator: str) -> None:
    """For the start of an operator's task in a worker: what other operators kept there goes."""
    others = [o for o in _kept if o != operator]
    for other in others:
        del _kept[other]
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Memory that is free, but held back by this process's allocators, goes to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column; case doesn't count."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out() -> Column:
    """True for the third of the rows that no classifier learns labels from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
