"""Token counts of whole texts: overlapping chunks of huge documents, spliced where the library must cut anyway.

A text of up to ``chunk`` characters is encoded in one call. A longer one is cut into chunks that overlap; they are
dealt out over the cluster and encoded with their offsets. Two neighbours are spliced at the first place of their overlap

* between two characters that stand side by side in no piece of the vocabulary, so that no merge can ever join them
  and what stands on one side can't change the tokens of the other (this is the proof), and
* at which both encodings have a boundary (this is checked).

So each token is counted by one chunk, and a chunk's edges, which the library encodes otherwise than in the whole
text, are never counted. Where an overlap has no such place, the document is cut again with chunks and overlaps
eight times as long, while other documents are done; at last one chunk is the whole text. The proof needs a BPE model that leaves
the text as it is but for white space marks; texts of other models are encoded whole.

Defined results: a null text is empty and has no tokens; rows that repeat are counted each by itself; ties don't occur; an empty table
gives no rows; a null doc_id is kept. Only doc_id and text are read, so other columns can't clash. A text is held by one task
while it is cut, as Spark holds it in one cell; its chunks are encoded by many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces, store, tables, text_or_empty, tidily
from .tokens import public_path

_loaded: dict[str, Pieces] = {}


class Pieces:
    """A model file of the sentencepiece library, and where its encodings can be cut."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.sp = SentencePieceProcessor(model_file=path)
        about = ModelProto.FromString(self.sp.serialized_model_proto())
        kind, how = about.trainer_spec.model_type, about.normalizer_spec
        #: Whether encodings can be spliced at all.
        self.splices = kind == about.trainer_spec.BPE and not how.precompiled_charsmap and not how.remove_extra_whitespaces and how.escape_whitespaces and not about.trainer_spec.treat_whitespace_as_suffix
        kinds = about.SentencePiece
        words = (p.piece for p in about.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED))
        self.joined = {pair for w in words for pair in zip(w, w[1:])}

    @classmethod
    def of(cls, path: str) -> Pieces:
        """Loaded once in a worker."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.sp.encode(texts, return_type="numpy", num_threads=1)]

    def first_cut(self, text: str, low: int, high: int) -> int | None:
        """The first place in (low, high), both its characters in [low, high), that no piece can span."""
        marked = text[low:high].replace(" ", "▁")
        for i, pair in enumerate(zip(marked, marked[1:])):
            if pair not in self.joined:
                return low + i + 1
        return None

    def between(self, text: str, low: int | None, high: int | None) -> int | None:
        """Tokens of a chunk between two places (None: its edge); None if there is no boundary at one of them."""
        got = self.sp.encode(text, return_type="offset_mapping")["offsets"]
        begins, ends = (np.array([x[i] for x in got], np.int64) for i in (0, 1))

        def before(place: int) -> int | None:  # all bytes of a character that has no piece end where it ends
            n = int(np.searchsorted(ends, place, "right"))
            return n if n and ends[n - 1] == place and (n == len(ends) or begins[n] >= place) else None

        first, last = 0 if low is None else before(low), len(ends) if high is None else before(high)
        return None if first is None or last is None else last - first


def _counted(path: str, chunk: int):
    """(doc_id, text) to (doc_id, n_tokens) and, for a text that is to be cut, (row, n_chars, text) instead of the count."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        model, row = Pieces.of(path), TaskContext.get().partitionId() << 33
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            huge = [model.splices and len(x) > chunk for x in texts]
            counts = iter(model.counts([x for x, h in zip(texts, huge, strict=True) if not h]))
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([None if h else next(counts) for h in huge], pa.int64()),
                "row": pa.array([row + i for i in range(len(texts))], pa.int64()),
                "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                "n_bytes": batch.column("n_bytes"),
                "text": pa.array([x if h else None for x, h in zip(texts, huge, strict=True)], pa.string()),
            }
            row += len(texts)
            yield pa.RecordBatch.from_pydict(columns)

    return tidily(run)


def _cut(chunk: int, overlap: int):
    """(row, text) to chunks (row, part, ends, text): a chunk has the overlap with the next one at its end."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = max(1, -(-len(text) // chunk))
                for part in range(parts):
                    own = text[part * chunk : (part + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "part": pa.array([part], pa.int64()), "is_last": pa.array([part == parts - 1]), "text": pa.array([own], pa.string())})

    return run


def _spliced(path: str, chunk: int, overlap: int):
    """Chunks to (row, covered, n_tokens): the characters and tokens between a chunk's splices; null where one isn't found."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Pieces.of(path)
        for batch in batches:
            covered: list[int | None] = []
            counts: list[int | None] = []
            for part, is_last, text in zip(*(batch.column(c).to_pylist() for c in ("part", "is_last", "text")), strict=True):
                low = model.first_cut(text, 0, min(overlap, len(text))) if part else None
                high = None if is_last else model.first_cut(text, chunk, min(chunk + overlap, len(text)))
                n = None if (part and low is None) or (not is_last and high is None) else model.between(text, low, high)
                counts.append(n)
                covered.append(None if n is None else (len(text) if high is None else high) - (low or 0))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "covered": pa.array(covered, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})

    return tidily(run)


def count_tokens(docs: DataFrame, path: str, chunk: int = 32_768, overlap: int = 256, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, rounds) of each row of docs (doc_id, text); rounds: how often it was cut, 0 for texts encoded at once."""
    if not 2 <= overlap <= chunk:
        raise ValueError("the overlap is from 2 characters to a chunk")
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = store(rows.mapInArrow(_counted(path, chunk), f"doc_id {kind}, n_tokens long, row long, n_chars long, n_bytes long, text string"), "token-counts")
    done = seen.where("text is null").select("doc_id", "n_bytes", "n_tokens", F.lit(0).alias("rounds"))
    left, rounds = seen.where("text is not null"), 0
    while not left.isEmpty():
        rounds += 1
        parts = left.select("row", "text").mapInArrow(_cut(chunk, overlap), "row long, part long, is_last boolean, text string").repartition("row", "part")
        found = parts.mapInArrow(_spliced(path, chunk, overlap), "row long, covered long, n_tokens long")
        sums = found.groupBy("row").agg(F.count_if(F.col("n_tokens").isNull()).alias("failed"), F.sum("covered").alias("covered"), F.sum("n_tokens").alias("sum"))
        # parts whose splices agree cover the text once
        tried = store(left.drop("n_tokens", "text").join(sums, "row").withColumn("ok", (F.col("failed") == 0) & (F.col("covered") == F.col("n_chars"))), "token-splices")
        done = done.unionByName(tried.where("ok").select("doc_id", "n_bytes", F.col("sum").alias("n_tokens"), F.lit(rounds).alias("rounds")))
        left = left.join(tried.where("not ok").select("row"), "row", "left_semi")
        chunk, overlap = 8 * chunk, 8 * overlap
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "rounds")


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(tables(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))
