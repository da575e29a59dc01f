"""Packing token sequences into fixed windows: best-fit decreasing on a segment tree.

A document is its token ids and an end id. Overlong documents are first cut
into full windows; what is left, and every shorter document, is one piece. Pieces
are dealt into groups of ``group_pieces`` that are ranges of their order; in each
group they are placed, longest first, into the open window with the least remaining
capacity that still holds them, and windows are numbered by the mean place of their
tokens. So sequence_id follows the order of the documents: that of their files' names
and rows if ``stored_order`` is asked for (a mix that was written as Parquet), else
that of the tasks. A segment tree over remaining capacities finds that
window in log2(window) steps. A group's padding is that of a few windows, so
groups keep tasks bounded and cost almost no density.

Defined results: a null or empty text is the end id alone; repeated rows are
packed once each; an empty table gives no rows; a null identifier is kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, store, tables, text_or_empty, tidily
from .tokens import encode, public_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, __n long"


class CapacityTree:
    """Open windows by remaining capacity; finds the tightest that holds a length."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window of at least length."""
        node = length + self.size
        while not self.count[node]:
            while node & 1:  # a right child: nothing larger under this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node *= 2
            if not self.count[node]:
                node += 1
        capacity = node - self.size
        window = self.open[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its window and its offset there."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, windows = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = (window, windows)
            windows += 1
        capacity, w = found
        where[i], offset[i] = w, window - capacity
        if capacity > n:
            tree.add(capacity - n, w)
    return where, offset


def in_stored_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __at) of a table just read from files: a row's place in the order of the files' numbers, names and rows."""
    place = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", place["file_path"].alias("__file"), place["row_index"].alias("__row"))
    files = rows.groupBy("__file").agg((F.max("__row") + 1).alias("n"))
    number = F.expr(r"try_cast(regexp_extract(__file, '.*part-([0-9]+)', 1) AS bigint)")
    files = files.withColumn("__before", F.sum("n").over(Window.orderBy(number, "__file")) - F.col("n")).select("__file", "__before")
    return rows.join(F.broadcast(files), "__file").select("doc_id", "text", (F.col("__before") + F.col("__row")).alias("__at"))


def cut_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, window: int = 4096, keep_ids: bool = False, split: str | None = None, stored_order: bool = False) -> DataFrame:
    """The pieces of every document (columns doc_id and text): full windows, then the rest."""

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            rows, ids_of = [], []
            places = batch.column("__at").to_pylist()
            for doc, place, ids in zip(batch.column("doc_id").to_pylist(), places, encode(tokenizer_file, batch.column("text").to_pylist(), end_id, split), strict=True):
                data = ids.astype("<u4")
                for at in range(0, len(data), window):
                    part = data[at : at + window].tobytes()
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), len(data), task + n if place is None else (place << 20) + at // window))
                    n += 1
                    if keep_ids:
                        ids_of.append(part)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "__n"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids_of, pa.binary())] if keep_ids else [])], names + ["ids"] * keep_ids)

    bound_batches(docs.sparkSession)
    place = F.col("__at") if stored_order else F.lit(None).cast("long").alias("__at")
    docs = in_stored_order(docs) if stored_order else docs
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), place).mapInArrow(tidily(cut), PIECES + ", ids binary" * keep_ids)


def pack(pieces: DataFrame, window: int = 4096, group_pieces: int = 65_536) -> DataFrame:
    """Place the pieces of a stored table, in groups that are ranges of __n; adds sequence_id and offset."""
    kept = [c for c in pieces.columns if c != "__n"]
    narrow = pieces.select("__n", "length") if "ids" in kept else pieces
    rows = store(narrow.repartitionByRange("__n").sortWithinPartitions("__n").withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__id", 33)
    parts = rows.groupBy(part.alias("__part")).agg(F.min("__id").alias("low"), F.count("*").alias("n"))
    parts = parts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n") - F.col("low")).alias("__shift"))
    rank = F.col("__id") + F.col("__shift")
    narrow = rows.withColumn("__part", part).join(F.broadcast(parts), "__part").withColumn("__group", F.floor(rank / group_pieces)).drop("__id", "__part", "__shift")

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__n", ignore_index=True)
        length = part["length"].to_numpy()
        where, offset = best_fit_decreasing(length, window)
        middle = np.bincount(where, weights=length * np.arange(len(part))) / np.bincount(where, weights=length)
        where = np.argsort(np.argsort(middle, kind="stable"))[where]
        out = part.drop(columns="__group")
        out["sequence_id"], out["offset"] = where + (int(part["__group"].iloc[0]) << 32), offset
        return out if "ids" not in kept else out[["__n", "sequence_id", "offset"]]

    if "ids" in kept:
        placed = narrow.groupBy("__group").applyInPandas(place, "__n long, sequence_id long, offset long")
        return pieces.join(placed, "__n").select(*kept, "sequence_id", "offset")
    nullable = narrow.groupBy("__group").applyInPandas(lambda part: place(part).astype({"doc_id": "Int64"}), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, __n long, sequence_id long, offset long")
    return nullable.drop("__n")


def sequences(packed: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves (pieces must have kept their ids): sequence_id, ids, n_tokens.

    Padded to the window, but a sequence whose length is a power of two is left as it is.
    """

    def join(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(part.sort_values("offset")["ids"]), "<u4").astype(np.int32)
        n = len(ids)
        if n & (n - 1):
            ids = np.concatenate([ids, np.full(window - n, pad_id, np.int32)])
        return pd.DataFrame({"sequence_id": [part["sequence_id"].iloc[0]], "n_tokens": [n], "ids": [ids]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, n_tokens long, ids array<int>")


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int, window: int = 4096, split: str | None = None, stored_order: bool = False) -> DataFrame:
    return pack(store(cut_pieces(docs, tokenizer_file, end_id, window, split=split, stored_order=stored_order), "pieces"), window)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(tables(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), 2, split="white_space")
