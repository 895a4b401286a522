"""What the corpus operators share: reading tables and cutting lineage through a shared folder."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the corpus contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read only through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that is
    unset (a local session, as in tests) a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
    if at is None:
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="veilgrid-")
        shared_dir.own = at
    return at.rstrip("/")


#: Bytes of a Parquet row group, and rows of whole texts that a reader decodes at once. Each task holds
#: a group and a batch of its input and a group of its output on the heap, beside what Spark manages.
ROW_GROUP_BYTES, READ_ROWS = 16 << 20, 1000


def bound_tables(spark: SparkSession) -> None:
    """Let this session write row groups of ROW_GROUP_BYTES and read READ_ROWS rows at once, where nothing else is set.

    It counts when a plan runs, so it stays set afterwards.
    """
    given = spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size")
    if given is None and spark.conf.get("parquet.block.size", None) is None:
        spark.conf.set("parquet.block.size", str(ROW_GROUP_BYTES))
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READ_ROWS:
        spark.conf.set(name, str(READ_ROWS))


class Scratch:
    """Tables written to the shared folder, to cut lineage and to read a result more than once.

    Unlike cached blocks they outlive the executor that made them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/veilgrid/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        bound_tables(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whole texts that may share an Arrow batch, and bytes of one.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once in an application."""
    app = spark.sparkContext.applicationId
    if app in ship.sent:
        return
    ship.sent.add(app)
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():
        return  # it runs from an archive that was sent already
    archive = Path(tempfile.mkdtemp(prefix="veilgrid-")) / "veilgrid_source.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


ship.sent = set()


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, for a Python map: the package is shipped; Arrow batches and what the JVM holds of tables are bounded for whole texts.

    Lower settings stay. They count when a plan runs, so they stay set afterwards.
    """
    ship(df.sparkSession)
    bound_tables(df.sparkSession)
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}", None)
        digits = str(now).lower().removesuffix("b")
        if now is None or not digits.isdigit() or not 0 < int(digits) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def give_back() -> None:
    """Return a finished task's free memory to the system, for workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def forget_others(owner: str) -> None:
    """Let go what the operators of other modules than ``owner`` remember between a worker's tasks.

    A worker lives through all stages of a pipeline, and would in the end hold the
    tables of each. Its own operator's stay, for the next task.
    """
    for name, module in list(sys.modules.items()):
        if name != owner and name.startswith(__package__ + ".") and hasattr(module, "forget"):
            module.forget()


def map_texts(df: DataFrame, each: Callable, schema: T.StructType) -> DataFrame:
    """``df.mapInPandas(each, schema)`` where the schema's first field is the first column of ``df``, an id.

    Ids travel as text, so a null among them does not turn the others into floats.
    """
    key, kind = schema[0].name, schema[0].dataType
    owner = each.__module__

    def task(frames: Iterator) -> Iterator:
        forget_others(owner)
        yield from each(frames)
        give_back()

    texts = df.select(F.col(df.columns[0]).cast("string"), *df.columns[1:])
    out = bound_batches(texts).mapInPandas(task, T.StructType([T.StructField(key, T.StringType()), *schema.fields[1:]]))
    return out.withColumn(key, F.col(key).cast(kind))


#: log2 of the bits that stand for a set of ids.
ID_BITS = 22


def mark_ids(scratch: Scratch, rows: DataFrame, id_col: str, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a flag that is true on all rows whose id is among ``ids``, and on few others.

    The ids, a one-column table, are folded into a table of bits whose size does not
    depend on their number (at most 2**ID_BITS / 63 rows of two longs), so it can be
    sent to every task and the rows stay where they are. An exact join of the flagged
    rows has to follow.
    """
    (name,) = ids.columns
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << ID_BITS))
    cells = ids.select(place(name).alias("p")).groupBy(F.expr("p div 63").alias("cell_")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 63 AS int)))").alias("bits_"))
    marked = rows.withColumn("place_", place(id_col)).join(F.broadcast(scratch.keep(cells)), F.expr("place_ div 63 = cell_"), "left")
    return marked.withColumn(flag, F.expr("coalesce(shiftright(bits_, cast(place_ % 63 AS int)) & 1 = 1, false)")).drop("place_", "cell_", "bits_")


def keep_rows(docs: DataFrame, columns: list[str], judge: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The rows whose values of ``columns`` the judge accepts, with all columns as they were.

    ``judge`` is called once in a task and gives the function to call on each row;
    a column that ``docs`` lacks is None. Batches pass through Arrow and are only filtered.
    """
    owner = judge.__module__

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        accepts = judge()
        for batch in batches:
            held = [(x.as_py() for x in batch.column(c)) if c in batch.schema.names else [None] * batch.num_rows for c in columns]
            yield batch.filter(pa.array([accepts(*row) for row in zip(*held)], pa.bool_()))
        give_back()

    return bound_batches(docs).mapInArrow(each, docs.schema)
