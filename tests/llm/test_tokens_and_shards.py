from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailforge.llm import packing, sstable
from trailforge.llm.common import scratch
from trailforge.llm.tokens import encode, public_path, tokenizer

FILES = (("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "white_space"))
TEXTS = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\n", "x\ny", "x\n y", "it's ok  'll\t\tq", "<|endoftext|> <|endoftext|>", "a\0b c\nd", "\x1c a\x1cb", "é ́x", "ΑΣ ΑΣΑ Σ", "İ i̇", "\r\nx\r\ny", "日本 語\n字", "a b c", "🙂 🙂\n🙂", "1 23 4.5", "word " * 500, "x" * 300 + " y"]


@pytest.mark.parametrize(("name", "split"), FILES)
def test_chunks_give_the_ids_of_whole_texts(name, split):
    path = public_path(name)
    for a, b, text in zip(encode(path, TEXTS, 7), encode(path, TEXTS, 7, split), TEXTS, strict=True):
        assert a.tolist() == b.tolist() == [*tokenizer(path).encode(text, add_special_tokens=False).ids, 7], text


@pytest.mark.parametrize(("name", "split"), FILES)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé \n\t\r.1日 \x1f", max_size=30), min_size=1, max_size=5))
def test_chunks_of_any_text(name, split, texts):
    path = public_path(name)
    assert [x.tolist() for x in encode(path, texts, 0)] == [x.tolist() for x in encode(path, texts, 0, split)]


def test_shard_file_by_key_and_in_order():
    out = io.BytesIO()
    w = sstable.Writer(out, block_bytes=64)
    keys = [None, -5, -1, 0, 0, 1, 2, 255, 256, 1 << 40, (1 << 63) - 1]
    values = [np.arange(i, dtype=np.uint32) + (70_000 if i == 3 else 0) for i in range(len(keys))]
    for k, v in zip(keys, values, strict=True):
        w.add(sstable.key_of(k), v)
    w.finish()
    r = sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [(sstable.id_of(k), v.tolist()) for k, v in r] == [(k, v.tolist()) for k, v in zip(keys, values, strict=True)]
    assert len(r.blocks) > 2
    for k in set(keys):
        assert [v.tolist() for v in r.get(sstable.key_of(k))] == [v.tolist() for x, v in zip(keys, values, strict=True) if x == k]
    assert r.get(sstable.key_of(77)) == []
    with pytest.raises(ValueError):
        w2 = sstable.Writer(io.BytesIO())
        w2.add(sstable.key_of(2), values[0])
        w2.add(sstable.key_of(1), values[0])
    with pytest.raises(ValueError):
        bad = bytearray(out.getvalue())
        bad[-sstable.FOOTER.size - 3] ^= 1
        sstable.Reader(io.BytesIO(bytes(bad)), len(bad))


def test_an_empty_shard_file():
    out = io.BytesIO()
    sstable.Writer(out).finish()
    r = sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert list(r) == [] and r.get(sstable.key_of(1)) == []


ROWS = [(5, "b a", "x"), (-2, None, "x"), (3, "", "x"), (None, "null id", "x"), (5, "b a", "x"), (4, "long " * 9000, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, ids string").repartition(3)


def test_shards_of_a_table(spark, docs):
    path, split = public_path("byte_bpe_50k.json"), "byte_level"
    shards = sstable.write_shards(docs, scratch(spark, "sst"), path, 0, split=split).cache()
    rows = sstable.read_shards(shards).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -2, 3, 4, 5, 5]
    at = 0
    for r in rows:
        text = next(t or "" for i, t, _ in ROWS if i == r.doc_id)
        ids = np.array([*tokenizer(path).encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    found = sstable.lookup(shards, [5, 99])
    assert len(found[5]) == 2 and found[99] == []
    ranges = [(bytes(r.first_key), bytes(r.last_key)) for r in shards.orderBy("shard").collect()]
    assert all(a <= b for a, b in ranges) and all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    assert sstable.lookup(shards, []) == {} and len(sstable.lookup(shards, [None])[None]) == 1
    assert sstable.write_shards(docs.limit(0), scratch(spark, "sst"), path, 0).count() == 0


def test_best_fit():
    lengths = np.array([5, 5, 4, 3, 3, 2, 8, 8])
    where, offset = packing.best_fit_decreasing(lengths, 8)
    used = {}
    for n, w, o in sorted(zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True), key=lambda x: (x[1], x[2])):
        assert used.get(w, 0) == o
        used[w] = o + n
    assert max(used.values()) <= 8 and len(used) == 5  # 38 of 40


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_is_the_tightest(lengths):
    """Against a plain search over all open windows."""
    where, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 16)
    room: dict[int, int] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [c for c in room.values() if c >= lengths[i]]
        before = room.get(int(where[i]), 16)
        assert offset[i] == 16 - before
        assert before == (min(fits) if fits else 16)
        room[int(where[i])] = before - lengths[i]


def test_packed_documents(spark, docs):
    path = public_path("word_bpe_49k.json")
    packed = packing.pack_documents(docs, path, 2, window=256, split="white_space").collect()
    assert sum(r.length for r in packed) == sum(len(tokenizer(path).encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    seqs: dict[int, list] = {}
    for r in packed:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 256
    long = sorted((r.start, r.length) for r in packed if r.doc_id == 4)
    assert long[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(long, long[1:], strict=False))
    assert packing.pack_documents(docs.limit(0), path, 2).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    from trailforge.llm.common import store

    path = public_path("word_bpe_49k.json")
    pieces = store(packing.cut_pieces(docs.where("doc_id = 5 or doc_id = 4"), path, 2, 256, keep_ids=True, split="white_space"), "pieces")
    packed = packing.pack(pieces, 256)
    rows = packing.sequences(packed, 256).collect()
    assert all(len(r.ids) == (256 if r.n_tokens & (r.n_tokens - 1) else r.n_tokens) for r in rows)
    assert sum(r.n_tokens for r in rows) == packed.agg(F.sum("length")).first()[0]
