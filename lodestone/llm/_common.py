"""Helpers shared by the operators: input tables, the shared work folder, Arrow batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is there only then
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at once. Spark's 64 MB are held by the JVM twice while they grow, and by the worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends texts in batches of about BATCH_BYTES, or one row; a bound that its user has set stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, a folder of this session (local mode) or of the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        made = f"file://{tempfile.mkdtemp(prefix='lodestone-')}" if local else spark.conf.get("spark.sql.warehouse.dir") + "/_lodestone"
        spark.sparkContext.setCheckpointDir(made)
    return made.rstrip("/")


def free_name(wanted: str, taken: list[str]) -> str:
    """The name, or the first of name_1, name_2, ... that no column has."""
    low, k = {c.lower() for c in taken}, 0
    while (name := wanted if not k else f"{wanted}_{k}").lower() in low:
        k += 1
    return name


def packed(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """All columns (or these) as one struct, so that their names can't clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in (docs.columns if columns is None else columns))) if (columns is None or columns) else F.struct(F.lit(None).alias("none"))


class Workspace:
    """Tables written to the shared folder: they cut lineage and survive lost executors. A table goes when another takes its name or free() is called; the rest stay until the folder is cleared, since results still read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df as Parquet and reads it back; a second table of the same name replaces the first."""
        path = f"{self.root}/{name}-{len(self.made)}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        old = self.made.get(name)
        self.made[name] = path
        if old:
            self._delete(old)
        out = self.spark.read.schema(df.schema).parquet(path)
        del df
        self.spark.sparkContext._jvm.System.gc()  # shuffle files of plans that are written out go now
        return out

    def free(self, *names: str) -> None:
        for n in names:
            if path := self.made.pop(n, None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def utf8_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value; null counts as empty."""
    return [v if v is not None else b"" for v in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` text bytes, or one row. Memory that Arrow holds free goes back at the end: workers live on."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        lens = pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False) if not pa.types.is_null(col.type) else [0] * b.num_rows
        start, size = 0, 0
        for i, n in enumerate(lens):
            if size and size + n > most:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield b.slice(start)
    pa.default_memory_pool().release_unused()
