"""Helpers shared by the corpus operators: reading, word hashing, shared-folder tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: White space as the contracts define it: the blank and the bytes 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: Java pattern that separates words.
SPLIT = r"[\x20\x09-\x0D]+"

#: Arrow batches are cut into pieces of about so many bytes of text before Python works on them.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local session (as in tests) gets a temporary folder once; on a cluster that
    would be a folder which executors don't see, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.larkspur.shared.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.larkspur.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, so a
    lost executor costs a reread and not a recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    # the table stands for all that led to it, so the write's shuffle files may go at its end
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, None)
    spark.conf.set(tidy, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(tidy, before) if before is not None else spark.conf.unset(tidy)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`stored` once nothing reads it any more."""
    path = getattr(df, "_larkspur_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size (``PIECE_BYTES`` unless given); a single longer text is a
    batch by itself."""
    size = size or PIECE_BYTES
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(lengths).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Give back to the system what a task has freed: workers stay for later tasks, and would keep it beside
    the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, as one archive, for they may not have it."""
    sc = spark.sparkContext
    if getattr(sc, "_larkspur_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="larkspur-")) / "larkspur.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._larkspur_sent = True


def bound_batches(spark: SparkSession) -> None:
    """What Python work on executors needs: the package, and Arrow batches that are small in bytes too (unless
    the session has a limit of its own)."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "", "-1", "0", str((1 << 63) - 1), str((1 << 31) - 1)):
        spark.conf.set(key, str(8 * PIECE_BYTES))


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", size: int | None = None) -> DataFrame:
    """``mapInArrow`` over bounded pieces of the input."""
    bound_batches(df.sparkSession)

    def run(batches):
        for piece in pieces(batches, text, size):
            yield work(piece)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the row offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that aren't white space."""
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[raw]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands.

    Words of up to 8 bytes are packed; longer ones fold 8 bytes at a time, all words in step.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, shape=(len(raw) + 1, 8), strides=(1, 1))
    length = (ends - starts).astype(np.int64)
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    out = mix(length.astype(np.uint64) * _BASE)
    out ^= np.ascontiguousarray(eight[starts]).view("<u8").ravel() & masks[np.minimum(length, 8)]
    out = mix(out)
    at, todo = 8, np.flatnonzero(length > 8)
    while len(todo):
        part = np.ascontiguousarray(eight[starts[todo] + at]).view("<u8").ravel() & masks[np.minimum(length[todo] - at, 8)]
        out[todo] = mix(out[todo] * _BASE + part)
        at += 8
        todo = todo[length[todo] > at]
    return out


def texts_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``raw, starts, ends, first, offsets``: the bytes of all rows, the spans of their words and, by
    row, the number of its first word (one entry more than rows). Rows never share a word."""
    raw, offsets = text_bytes(column)
    # a blank after every row keeps the last word of one row apart from the first of the next
    spaced = np.full(len(raw) + len(offsets) - 1, 32, dtype=np.uint8)
    at = np.arange(len(raw), dtype=np.int64)
    rows = np.diff(offsets)
    at += np.repeat(np.arange(len(rows)), rows)
    spaced[at] = raw
    begin = offsets + np.arange(len(offsets))
    starts, ends = word_spans(spaced)
    first = np.searchsorted(starts, begin)
    return spaced, starts, ends, first, begin


def clear_of(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add under the same names."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])

