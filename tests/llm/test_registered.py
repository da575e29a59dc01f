"""The registered queries, as they are called, on the smallest tables against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from trailforge.llm.queries import QUERIES
from trailforge.llm.tokens import public_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(name, texts, end):
    t = Tokenizer.from_file(public_path(name))
    return {i: t.encode(x, add_special_tokens=False).ids + [end] for i, x in texts.items()}


def test_op1_ids_of_every_document_and_where_they_start(spark, docs):
    ids, at, want = encoded("byte_bpe_50k.json", docs, 0), 0, {}
    for i in sorted(docs):
        want[i] = (at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])
    got = QUERIES["op1_sstable"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_op3_neighbours_and_their_scores(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}
    cosine = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    got: dict = {}
    for r in QUERIES["op3_ann"](spark, SF).collect():
        assert r.score == pytest.approx(cosine(rows[r.query_id], rows[r.vec_id]), abs=1e-12)
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    hits = 0
    for q in (i for i in rows if i % 50 == 0):
        want = sorted((-cosine(rows[q], v), i) for i, v in rows.items() if i != q)[:5]
        mine = [got[q][k] for k in sorted(got[q])]
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and mine == sorted(mine, key=lambda x: (-x[0], x[1]))
        hits += len({i for _, i in want} & {i for _, i in mine})
    assert hits >= 0.9 * 5 * len(got) and set(got) == {i for i in rows if i % 50 == 0}


def test_op4_features_and_verdicts(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        words, seen, dup = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams: dict = {}
        for k in range(len(words) - 2):
            grams.setdefault(tuple(words[k : k + 3]), []).append(k)
        repeated = len({k + j for places in grams.values() if len(places) > 1 for k in places for j in range(3)})
        base = len(words) < 50 or 100 * repeated > 50 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeated, base)
        assert r.kept == (not base and not (r.cutoff is not None and r.score > r.cutoff))


def test_op6_bytes_that_are_left(spark, docs):
    data, places = {i: t.encode() for i, t in docs.items()}, {}
    for i, b in data.items():
        for k in range(len(b) - 199):
            places.setdefault(hashlib.blake2b(b[k : k + 200], digest_size=12).digest(), []).append((i, k))
    gone = {i: np.zeros(len(b), bool) for i, b in data.items()}
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                gone[i][k : k + 200] = True
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_suffix_dedup"](spark, SF).collect()}
    want = {i: (len(b), int(gone[i].sum()), int((np.diff(np.r_[0, gone[i].astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[i]].tobytes()).hexdigest()) for i, b in data.items()}
    assert got == want and any(x[1] for x in want.values())


def test_op7_components(spark, docs):
    sets = {}
    for i, text in docs.items():
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op7_minhash"](spark, SF).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_op8_records(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last: dict = {}
    for i, b in pages.items():
        last[b] = max(i, last.get(b, i))
    want = {i: (len(b), hashlib.sha1(b).hexdigest(), *(("revisit", last[b]) if len(b) >= 1000 and last[b] != i else ("response", None))) for i, b in pages.items()}
    got = QUERIES["op8_warc"](spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(want)


def test_op9_keeps_every_document_and_its_turn(spark):
    got = QUERIES["op9_mixing"](spark, SF).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.source for r in got} == source and len(got) == len(source)
    assert len({(r.slot, r.in_block) for r in got}) == len(got)
    blocks = {(r.source, r.source_block): r.slot for r in got}
    assert sorted(blocks.values()) == list(range(len(blocks)))  # each slot is one block of one source
    for name in set(source.values()):
        turns = [blocks[k] for k in sorted(k for k in blocks if k[0] == name)]
        assert turns == sorted(turns)


def test_op10_pieces_hold_each_id_once(spark, docs):
    ids = encoded("word_bpe_49k.json", docs, 2)
    pieces: dict = {}
    sequences: dict = {}
    for r in QUERIES["op10_packing"](spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, whole in ids.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at and n > 0
            at += n
        assert at == len(whole)
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(map(len, ids.values()))
    assert len(sequences) <= 1.02 * -(-total // 4096) + 1
