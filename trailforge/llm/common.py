"""What the operators of this subpackage share: scratch tables, files, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters that str.split() cuts at, but which are no white space here.
_NO_CUT = [c for c in map(chr, range(0x3001)) if c.isspace() and not " " >= c > "\x1f" and not "\t" <= c <= "\r"]
_NO_CUT_ASCII = [c for c in _NO_CUT if c.isascii()]


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased."""
    text = ascii_lower(text or "")
    if any(c in text for c in (_NO_CUT_ASCII if text.isascii() else _NO_CUT)):
        return WORD.findall(text)
    return text.split()



def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is missing (tests, local mode) a folder is made.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="trailforge-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


class Scratch:
    """Owns the scratch folders that are made in its ``with`` block; only release() deletes them, and no others.

    Results that are still lazy read them: release when what needs them is stored. Folders made outside any block
    belong to nobody and stay.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._outer = _owner.set(self)
        return self

    def __exit__(self, *_) -> None:
        _owner.reset(self._outer)

    def release(self, spark: SparkSession) -> None:
        while self.paths:
            delete(spark, self.paths.pop())


_owner: ContextVar[Scratch | None] = ContextVar("scratch owner", default=None)


def owner() -> Scratch | None:
    """Whose block this is."""
    return _owner.get()


def scratch(spark: SparkSession, name: str, owned: bool = True) -> str:
    """A new folder name under the shared folder."""
    path = f"{shared_dir(spark)}/trailforge/{name}-{uuid.uuid4().hex}"
    if owned and (own := owner()) is not None:
        own.paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, in rows and bytes.

    The limits are the same for all operators, so that it doesn't matter which one is planned last before a lazy plan runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def quoted(name: str) -> Column:
    """A column of this very name, dots and all."""
    return F.col("`{}`".format(name.replace("`", "``")))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can clash."""
    return F.struct(*map(quoted, docs.columns))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those that Spark can't hash (maps, at any depth) as JSON."""
    kinds = dict(docs.dtypes)
    return F.xxhash64(*(F.to_json(F.struct(quoted(c))) if "map<" in kinds[c] or kinds[c] == "variant" else quoted(c) for c in docs.columns))


def open_fs(uri: str):
    """(file system, path) of a URI, for Python code on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SEEDS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def seeds(n: int) -> np.ndarray:
    return _SEEDS[:n]


_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                t = np.full(size, base, np.uint64)
                t[0] = 1
                _powers[name] = np.multiply.accumulate(t)
    return _powers["up"], _powers["down"]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lower-cased words of several texts.

    data: the UTF-8 bytes of the texts one after another; starts: where each
    begins, and the end of the last. Returns the hashes in order and, for each
    text, the number of its first word (with the total at the end).
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_table(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=total[1:])
        h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(begin, starts)


def arrow_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, values = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8)[starts[0] : starts[-1]] if values is not None and len(values) else np.empty(0, np.uint8)
    return data, starts - starts[0]


def tidy() -> None:
    """Give a worker's free memory back to the system: workers live on after their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidily(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker gives its memory back after each task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            tidy()

    return run


def pieces(batches: Iterator, most_bytes: int = 1 << 20, column: str = "text") -> Iterator:
    """Cut Arrow batches so that the texts of one piece have about most_bytes at most (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts = arrow_texts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(starts, starts[at] + most_bytes, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
