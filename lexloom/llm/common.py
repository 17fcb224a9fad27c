"""Shared helpers: table reading, lineage cuts in the shared folder, batch iteration."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 2 << 20  # of the Arrow batches that go to Python


def small_batches(spark: SparkSession) -> None:
    """From now on a task hands its rows to Python in batches of about BATCH_BYTES (Spark: up to 64 MB, and buffers that double as they fill).

    The rows and the results are the same; both sides of a task hold less of them at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's step that ends by handing freed memory back to the system: Spark's workers live on, and their allocators keep the largest task's."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return ended


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and every executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of tables made by `cut` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def rest_bucket(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 marks the held-out fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1_000_000) -> Iterator[dict[str, list]]:
    """Columns of the batches as lists, in slices of about `most` characters (a longer text stands alone); null texts become empty.

    Only a slice at a time is made into lists: a batch of 10,000 long texts stays in Arrow's memory alone.
    """
    for batch in batches:
        for part in slices(batch, batch.column(batch.schema.names.index(text)), most):
            columns = part.to_pydict()
            columns[text] = [x or "" for x in columns[text]]
            yield columns


def slices(rows: pa.RecordBatch | pa.Array, texts: pa.Array, most: int = 1_000_000) -> Iterator[pa.RecordBatch | pa.Array]:
    """The rows in slices of about `most` characters of their texts, without copies."""
    start = size = 0
    for k, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if k > start and size + n > most:
            yield rows.slice(start, k - start)
            start, size = k, 0
        size += n
    if len(texts):
        yield rows.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups from batches that are sorted by long keys, each with the row numbers where its groups begin and the table ends."""
    rest: pa.Table | None = None
    last = None

    def marks(table: pa.Table) -> np.ndarray:
        k = np.stack([table.column(c).to_numpy() for c in keys], axis=1)
        return np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first = tuple(table.column(c)[0].as_py() for c in keys)
        cuts = marks(table)
        # a group that goes on gathers its batches and is put together once
        if held and first == last and not len(cuts):
            held.append(table)
            continue
        end = int(cuts[-1]) if len(cuts) else 0
        rest = pa.concat_tables([*held, table.slice(0, end)]) if held else table.slice(0, end)
        if rest.num_rows:
            yield rest, [0, *marks(rest).tolist(), rest.num_rows]
        held, last = [table.slice(end)], tuple(table.column(c)[table.num_rows - 1].as_py() for c in keys)
    if held:
        rest = pa.concat_tables(held)
        yield rest, [0, *marks(rest).tolist(), rest.num_rows]
