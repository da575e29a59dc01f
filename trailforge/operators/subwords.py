"""Token tables by a subword tokenizer's file, in the form that spans and scores take."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import kinds

#: Texts that one call of the library encodes.
AT_ONCE = 64
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a worker, without its own cuts and padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def subword_tokens(texts: DataFrame, path: str, max_len: int | None = 4096, begin: int | None = None, key: str = "traj_id") -> DataFrame:
    """(key, pos, token_id, start, end) of the tokens of texts (key, text), whole texts encoded some at a time.

    start and end are places of characters in the text. Tokens that share one character have the same places. begin is the id of a special
    token put before each text; it has no width and stands at (0, 0), so it belongs to a span only if that starts with the
    text. At most max_len tokens of a text are kept, that one included. A null text is empty. Where texts have a column spans, tokens also have
    their type, found where the text is: they need not be shuffled to meet the spans.
    """
    typed = "spans" in texts.columns

    def encode(batches):
        import pyarrow as pa

        t = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = t.encode_batch([x or "" for x in part.column("text").to_pylist()], add_special_tokens=False)
                first = [] if begin is None else [begin]
                ids = [(first + e.ids)[:max_len] for e in found]
                places = [([(0, 0)] * len(first) + e.offsets)[:max_len] for e in found]
                n = [len(x) for x in ids]
                flat = np.array([p for x in places for p in x], np.int32).reshape(-1, 2)
                columns = {
                    key: part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))),
                    "pos": pa.array(np.concatenate([np.arange(x) for x in n]).astype(np.int32)),
                    "token_id": pa.array([i for x in ids for i in x], pa.int32()),
                    "start": pa.array(flat[:, 0].copy()),
                    "end": pa.array(flat[:, 1].copy()),
                }
                if typed:
                    types, ends = [], np.cumsum(n)
                    for spans, low, high in zip(part.column("spans").to_pylist(), ends - n, ends, strict=True):
                        labels = [x["label"] for x in spans or []] + ["reasoning"]
                        types += [labels[k] for k in kinds(flat[low:high, 0], flat[low:high, 1], spans or []).tolist()]
                    columns["type"] = pa.array(types, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = texts.select(key, F.col("text").cast("string").alias("text"), *(["spans"] if typed else []))
    return rows.mapInArrow(encode, f"{key} {rows.schema[key].dataType.simpleString()}, pos int, token_id int, start int, end int" + (", type string" if typed else ""))


def decoded(tokens: DataFrame, path: str, key: str = "traj_id") -> DataFrame:
    """(key, text, n, last_end, n_without_width) from a token table: what its tokens say in order, special ones left out."""
    rows = tokens.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"]).alias("ids"),
        F.max("end").alias("last_end"),
        F.count_if(F.col("start") == F.col("end")).alias("n_without_width"),
    )

    def decode(batches):
        import pyarrow as pa

        t = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                ids = part.column("ids").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(t.decode_batch(ids, skip_special_tokens=True), pa.string()), pa.array([len(x) for x in ids], pa.int32()), part.column("last_end"), part.column("n_without_width")], names=[key, "text", "n", "last_end", "n_without_width"])

    return rows.mapInArrow(decode, f"{key} {rows.schema[key].dataType.simpleString()}, text string, n int, last_end int, n_without_width long")
