"""What several operators share: reading, shared tables, folds, per-worker caches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import new_shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def hash_sample(ids: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` ids in the order of their hash: spread evenly and the same in any run."""
    return ids.select(column).orderBy(F.xxhash64(column), column).limit(rows)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; bytes.lower() leaves every other character alone."""
    return text.encode("utf-8", "replace").lower() if text else b""


def with_columns(
    df: DataFrame, kinds: dict[str, T.DataType], per_batch: Callable[[pa.RecordBatch], Iterable]
) -> DataFrame:
    """Append columns that ``per_batch`` makes of an Arrow batch; a column of that name is replaced.

    Rows, their order within a partition and all other columns stay as they are.
    """
    small_batches(df.sparkSession)
    kept = df.drop(*kinds)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            made = [pa.array(v, to_arrow_type(t)) for v, t in zip(per_batch(batch), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *kinds])

    return kept.mapInArrow(run, schema)


BATCH_ROWS = 1_000  # of texts in an Arrow batch, so that a worker holds a few MB of them


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size for the long texts of this subpackage."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def worker_cache(name: str, make: Callable[[], object]):
    """An object that outlives a task in a reused Python worker, such as a tokenizer.

    A worker holds one of them: the next operator's takes its place, so that a pipeline's stages do not add up.
    """
    kept = sys.__dict__.setdefault("_panelspark_llm", {})
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]


def forget_caches() -> None:
    """For operators that keep their own tables in a task: a reused worker lets go of the last operator's."""
    sys.__dict__.setdefault("_panelspark_llm", {}).clear()


class Bounded(dict):
    """A cache that stops to grow at ``limit`` entries; frequent keys arrive first and stay."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value
