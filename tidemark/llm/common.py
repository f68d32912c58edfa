"""What the operators of this subpackage share: text splitting, shared-folder tables, labelled samples."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of an Arrow batch sent to Python; whole texts can be long, so batches are kept short.
ARROW_ROWS = 512
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder, by a reader that any Hadoop file system serves."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder, or, for a local master only, a temporary one that this call sets."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() has written, by Hadoop's own client."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation before it. The path lives until remove() or the end of the program."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_quiet_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def _quiet_remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Short Arrow batches, unless the session has a setting of its own: batches of Spark's usual length took 600 MB more of an executor's memory."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(ARROW_ROWS))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most ARROW_ROWS rows, whatever the session's setting: Python objects are made of one piece at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ARROW_ROWS):
            yield b.slice(at, ARROW_ROWS)


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with the first number that makes it none of the taken column names (whatever their case)."""
    low = {c.lower() for c in taken}
    return next(n for k in itertools.count() if (n := f"{name}{k or ''}").lower() not in low)


class Memo(dict):
    """What make() gives for the chunks met so far. Kept are chunks of up to LONGEST characters, until they fill about `most` bytes: a text without blanks
    is one chunk, and may be of any length."""

    LONGEST = 64

    def __init__(self, make: Callable[[str], tuple], most: int = 48 << 20) -> None:
        super().__init__()
        self.make, self.left = make, most

    def __missing__(self, chunk: str) -> tuple:
        made = self.make(chunk)
        if len(chunk) <= self.LONGEST and self.left > 0:
            self.left -= 200 + 4 * len(chunk) + 40 * len(made)
            self[chunk] = made
        return made


def by_batch(df: DataFrame, start: Callable[[], Callable[[list[list]], list[tuple]]], schema: str) -> DataFrame:
    """mapInArrow over lists of column values. start() runs once a task and returns a function from the columns of a batch to the output's columns, as (values, Arrow type) pairs."""
    small_batches(df.sparkSession)
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in make([c.to_pylist() for c in b.columns])], names=names)

    return df.mapInArrow(run, schema)


def append_column(docs: DataFrame, keep: list[str], start: Callable[[], Callable[[str | None], object]], name: str, kind: T.DataType) -> DataFrame:
    """`keep` columns of docs as they are, and `name`: what the function that start() makes once a task gives for each whole text."""
    small_batches(docs.sparkSession)
    cols = [docs[f"`{c}`"].alias(f"__k{i}") for i, c in enumerate(keep)]
    at = keep.index("text") if "text" in keep else len(keep)
    if at == len(keep):
        cols.append(docs["text"].alias("__text"))
    schema = T.StructType([*(T.StructField(f"__k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("__made", kind)])
    arrow, n = to_arrow_type(kind), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for b in slices(batches):
            made = pa.array([one(t) for t in b.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], made], names=schema.names)

    return docs.select(*cols).mapInArrow(run, schema).toDF(*keep, name)


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8; a null text has none. bytes.lower() and bytes.split() know ASCII only, which is just that."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def is_held_out(doc_id: str) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is not held out (and has no labels to learn from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, tie, y: the rows of at most `most` labelled ids that are not held out, the first by a hash of the id; tie is a hash of the text. Every
    label row is considered; the bound is on what a model is fitted on. A document with labels that disagree counts as 1 if any says 1."""
    picked = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    picked = picked.where(~is_held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").where("text is not null")
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("tie"), "y")


def parts(lists: pa.ListArray) -> list[np.ndarray]:
    """Each list as a view of the array's own values, nothing copied; no list is null."""
    values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in itertools.pairwise(bounds.tolist())]


def fitted(examples: DataFrame, most: int, fit: Callable[[pa.Table], np.ndarray]) -> np.ndarray:
    """The weights that fit() makes of the first `most` rows of examples by (hash of doc_id, doc_id, tie), in one task of an executor: an id may repeat any
    number of times in documents, so the bound is set again on rows. Only the weights come to the driver."""
    bounded = examples.orderBy(F.xxhash64("doc_id"), "doc_id", "tie").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        made = [fit(pa.Table.from_batches(got)).astype("<f8").tobytes()] if got else []
        # the worker lives on for other tasks, and what its allocator holds back counts as the executor's
        got.clear()
        pa.default_memory_pool().release_unused()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["weights"])

    rows = bounded.mapInArrow(run, "weights binary").collect()
    return np.frombuffer(bytes(rows[0][0]), dtype="<f8") if rows else fit(pa.table({}))
