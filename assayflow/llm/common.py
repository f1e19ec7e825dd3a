"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.session import scratch_dir

#: Rows of ids that may be broadcast (a long each); beyond it the same join is shuffled.
BROADCAST_IDS = 2_000_000
#: Counted rows of a few numbers each that are broadcast rather than shuffled together with what they are joined to.
BROADCAST_ROWS = 100_000
#: Rows for each task of a table whose rows are counted.
TASK_ROWS = 2000
#: Rows turned into Python objects at a time inside a task.
SLICE_ROWS = 256


#: Rows of a batch that Spark hands to a Python worker; texts can be long, and a batch is held whole.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of the batches sent to Python workers, unless the session already asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def remainder(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


#: Whether the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: computed once, lineage cut.

    The shuffle files behind it go with the write: later reads take the table, so nothing asks for them again.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_dir(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once all that was computed from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """A narrow frame computed once.  Written as a table rather than checkpointed: a checkpoint keeps the constraints
    that the optimizer inferred for its plan, and in loops of joins those multiply."""
    return saved(df, "cut")


def aside(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is broadcast if its counted ``rows`` are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """A frame of at most ``rows`` rows in few tasks, if those are few: each task and each file costs time of its own."""
    return df.coalesce(8 + rows // TASK_ROWS)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows (reads no more than one row beyond)."""
    return df.limit(rows + 1).count() <= rows


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``ids`` (one column).  Null ids stay.

    The id list is broadcast only after its row count was checked; beyond the
    bound the same anti join is shuffled.
    """
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).filter("__gone is not null").distinct()
    gone = cut(gone)
    side = F.broadcast(gone) if at_most(gone, BROADCAST_IDS) else gone
    return docs.join(side, docs[id_col] == F.col("__gone"), "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (one column of distinct ids, already computed)."""
    want = ids.select(F.col(ids.columns[0]).alias("__want"))
    side = F.broadcast(want) if at_most(want, BROADCAST_IDS) else want
    return docs.join(side, docs[id_col] == F.col("__want"), "left_semi")


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[dict[str, list]]:
    """The columns of Arrow batches as Python lists, a bounded number of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def map_columns(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Apply ``fn`` (lists of column values -> lists of column values) inside tasks, batch by batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches):
            out = fn(cols)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of each word, remembered for the words met lately (bounded)."""

    LIMIT = 80_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out = out * MULTIPLIER + hashes[i : i + n]
    return mixed(out)


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


#: ASCII letters are lower-cased, other ASCII characters that are no digit become blanks, bytes of other characters stay.
PLAIN_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
