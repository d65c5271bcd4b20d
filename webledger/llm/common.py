"""What the operators of this subpackage share: reading inputs, held-out rows, shared files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webledger.scale import work_dir

# ASCII white space, the only separators of words in the contracts.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of an Arrow batch, where the session still has Spark's own number: 10,000 long texts at a time
# are more than a Python worker should hold.
BATCH_ROWS = 256
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text in UTF-8 (null: empty); whatever other columns there are stay out of the way."""
    if docs.sparkSession.conf.get(_BATCH) == _SPARKS_OWN:
        docs.sparkSession.conf.set(_BATCH, BATCH_ROWS)
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def fold(modulus: int, key: str = "doc_id") -> Column:
    """The remainder of crc32(key as text); a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


_held: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """In a task: let go of what other operators left in this Python worker.

    Workers are used again for the next job; the tables of one operator at a time are enough.
    """
    for other in [n for n in _held if n != name]:
        _held.pop(other)()
    _held[name] = clear


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short batches, so that long texts become Python objects a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    del batches
    pa.default_memory_pool().release_unused()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run under the shared one, as a URI that executors can write to."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str):
    """(file system, path) of a shared folder, inside a task."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)
