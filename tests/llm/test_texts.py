from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailforge.llm import common, graph, lm, minhash, quality, suffixes
from trailforge.llm.gru import Adam, Model, Shape

W = re.compile(r"[^\x20\x09-\x0D]+")


def vary(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, short and odd ones."""
    rng = np.random.default_rng(1)
    base = [[f"v{x}" for x in rng.integers(0, 3000, rng.integers(60, 200))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(vary(rng, base[i % 6], int(rng.integers(1, 12)))) for i in range(60)]
    passage = " ".join(f"p{x}" for x in rng.integers(0, 99, 80))
    texts += [f"{' '.join(base[i][:30])} {passage} {i}" for i in range(8, 20)]
    texts += [texts[0]] * 5 + ["", None, " \n ", "one", "One", "two words", "TWO words", "é" * 300, "ab" * 400, "\n".join(["same line here"] * 30)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, i) for i, t in corpus], "doc_id long, text string, lang string, n_words int").repartition(5)


def brute_components(corpus, words, percent):
    sets = {i: minhash.shingle_set(t, words) for i, t in corpus}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, corpus, words):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=words).collect()}
    assert got == brute_components(corpus, words, 80)


@pytest.mark.parametrize(("edits", "blocks"), [((6, 9), {}), ((7, 10), {"block_rows": 100, "block_shingles": 20_000})])
def test_crowded_buckets_are_finished_exactly(spark, edits, blocks):
    """A family around one text, most pairs just below 0.8: its few links are hardly ever those of pivots."""
    rng = np.random.default_rng(5)
    base = [f"v{x}" for x in rng.integers(0, 3000, 200)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(200, rng.integers(*edits), replace=False):
            words[at] = f"w{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=2, **blocks).collect()}
    want = brute_components(rows, 2, 80)
    assert 20 < len({c for _, c in want.values()}) < 400 and got == want


@pytest.mark.parametrize(("main", "others", "most"), [(30, 200, 20), (200, 30, 20), (5, 5, 20), (1, 60, 7), (90, 1, 7)])
def test_each_pair_of_components_meets_in_one_block(spark, main, others, most):
    rows = [(7, i, 0 if i < main else i) for i in range(main + others)] + [(8, i, 5) for i in range(50)] + [(9, i, i) for i in range(3)]
    placed = minhash.in_blocks(spark.createDataFrame(rows, "bucket long, cid long, root long"), "bucket", F.lit(1), most).collect()
    met: dict = {}
    blocks: dict = {}
    for r in placed:
        blocks.setdefault((r.bucket, r.block), []).append(r)
    for held in blocks.values():
        assert len(held) < 4 * most
        for x, a in enumerate(held):
            for b in held[:x]:
                if a.root != b.root and (a.side != b.side or a.side == minhash.BOTH):
                    pair = (a.bucket, min(a.cid, b.cid), max(a.cid, b.cid))
                    met[pair] = met.get(pair, 0) + 1
    roots = {(k, c): r for k, c, r in rows if k != 8}
    want = {(k, a, b) for (k, a), x in roots.items() for (j, b), y in roots.items() if j == k and a < b and x != y}
    assert set(met) == want and set(met.values()) <= {1}


def test_blocks_are_bounded_where_ten_thousand_members_stay_apart(spark):
    rows = spark.range(10_000).selectExpr("1L AS bucket", "id AS cid", "if(id < 1000, 0L, id) AS root")
    placed = minhash.in_blocks(rows, "bucket", F.lit(1), 1024)
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.expr("side = 0")).alias("a"), F.count_if(F.expr("side = 1")).alias("b"), F.count_if(F.col("side") == minhash.BOTH).alias("c"))
    total = sizes.agg(F.max("n"), F.sum("n"), F.sum(F.expr("a * b + c * (c - 1) / 2"))).first()
    assert total[0] < 2 * 1024 * 1.2  # two tiles
    assert total[1] < 10_000 * 12 and total[2] == 9_000 * 8_999 // 2 + 9_000 * 1_000


def test_a_very_long_text_and_its_near_copy(spark):
    words = [f"v{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-300])), (3, " ".join(words[:100]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (59_996, 1), 2: (59_696, 1), 3: (96, 3)}


def test_near_duplicates_with_nulls_and_repeats(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, None), (None, "alone here")], "doc_id long, text string")
    rows = minhash.near_duplicates(df, words=2).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted([(None, 4), (4, 4), (4, 4), (9, 9), (None, None)], key=str)
    kept = minhash.drop_near_duplicates(df, words=2).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(4, text), (9, None)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 230)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got}
    assert {x for p in pairs if p[0] != p[1] for x in p} <= set(got)


def brute_removed(corpus, length):
    counts = Counter()
    data = {i: (t or "").encode() for i, t in corpus}
    for b in data.values():
        counts.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard_contexts", [4096, 3])
def test_repeats(docs, corpus, shard_contexts, monkeypatch):
    """Also with every gram split over several shards, where runs are merged by binary search."""
    rows, changed = suffixes.remove_repeats(docs, 200, shard_contexts)
    joined = rows.join(changed, "key", "left").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed or 0, r.n_spans or 0, r.kept_sha256 or hashlib.sha256((r.text or "").encode()).hexdigest()) for r in joined}
    assert got == brute_removed(corpus, 200)
    assert F is not None


def test_very_long_texts_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefgh é"), 400_000))
    corpus = [(1, long), (2, "x" + long[100_000:100_700] + "y"), (3, "z" * 5000), (4, long[:90])]
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    rows, changed = suffixes.remove_repeats(df)
    got = {r.doc_id: (r.n_bytes, r.n_removed or 0, r.n_spans or 0) for r in rows.join(changed, "key", "left").collect()}
    want = brute_removed(corpus, 200)
    assert got == {i: x[:3] for i, x in want.items()}
    kept = {r.doc_id: r.text for r in suffixes.without_repeats(df).collect()}
    assert kept[2] == "xy" and kept[4] == long[:90]
    assert suffixes.without_repeats(df.limit(0)).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t = rng.integers(0, int(rng.integers(2, 5)), int(rng.integers(1, 90))).astype(np.int16)
        sa, key = suffixes.suffix_array(t)
        text = t.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == want
        lcp = suffixes.common_prefixes(t, sa, key).tolist()
        for j in range(1, len(want)):
            a, b = text[want[j - 1] :], text[want[j] :]
            assert lcp[j] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def model_features(text):
    text = text or ""
    words = W.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_counts(docs, corpus, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality_verdicts(docs, labels).collect()}
    for i, t in corpus:
        r = rows[i]
        want = model_features(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (r.base_failed, r.kept, r.cutoff) == (failed, not failed, None)
    assert sorted(quality.quality_filter(docs, labels).columns) == sorted(docs.columns)
    assert quality.quality_verdicts(docs.limit(0), labels).count() == 0


def test_risk_control():
    n = 1000
    exact = sum(math.comb(n, k) * 0.01**k * 0.99 ** (n - k) for k in range(4))
    assert quality.binomial_cdf(3, n, 0.01) == pytest.approx(exact)
    zeros = [0] * len(quality.CUTOFFS)
    assert quality.choose_cutoff(zeros, 1000, [0, 0, 5] + [5] * 12, 5, 0.01, 0.01) == quality.CUTOFFS[2]
    assert quality.choose_cutoff(zeros, 100, [5] * 15, 5, 0.01, 0.01) is None  # too few to be sure
    rising = [0, 0, 0, 0, 50] + [100] * 10
    assert quality.choose_cutoff(rising, 1000, list(range(15)), 15, 0.01, 0.01) == quality.CUTOFFS[3]


def test_false_rejections_over_many_draws():
    """Rules reject good documents at random; over many holdouts few admitted cutoffs lose more than 1 %."""
    rng = np.random.default_rng(4)
    true = np.linspace(0.001, 0.03, len(quality.CUTOFFS))
    broken = 0
    for _ in range(400):
        score = rng.random(1500)
        cutoff = quality.choose_cutoff([int((score < t).sum()) for t in true], 1500, list(range(15)), 15, 0.01, 0.05, price=0.0)
        broken += cutoff is not None and true[quality.CUTOFFS.index(cutoff)] > 0.01
    assert broken <= 400 * 0.05 + 3 * (400 * 0.05 * 0.95) ** 0.5


def test_labels_and_texts_count_once(spark):
    """Labels given twice, contradictory ones and copies of a text add no trials; null and empty strata are apart."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, text(i), "en") for i in range(40)] + [(100 + i, text(0), "en") for i in range(500)] + [(700 + i, text(700 + i), lang) for i, lang in enumerate([None, ""] * 20)]
    rows += [(5, text(5000), "en")]  # an identifier with two texts
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = [(i, 1) for i, _, _ in rows] * 3 + [(7, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.cutoffs(quality.scored(docs), labels, 0.01, 0.05)
    counts = {r["__stratum"]: r.n_good for r in found[1].collect()}
    texts = {t for i, t, lang in rows if lang == "en" and i not in (5, 7)}
    assert set(counts) <= {"sen", "n", "s"} and {"n", "s"} <= set(counts) and counts["n"] + counts["s"] < 40
    assert 0 < counts["sen"] < len(texts)


def test_columns_with_the_operators_own_names(spark):
    odd = "rules string, mid0 string, wide0 string, __cutoff string, __row string, __q string, __id string, __stratum string, __text string, kept string"
    df = spark.createDataFrame([(1, "a " * 60, "en", *["x"] * 10), (2, None, None, *["x"] * 10)], f"doc_id long, text string, lang string, {odd}")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.doc_id for r in quality.quality_verdicts(df, labels).collect()} == {1, 2}
    assert quality.quality_filter(df, labels).columns == df.columns
    assert minhash.drop_near_duplicates(df).columns == df.columns
    assert suffixes.without_repeats(df).columns == df.columns
    assert lm.lm_scores(df.withColumn("row", df.rules).withColumn("codes", df.rules)).count() == 2


def test_verdicts_keep_good_documents(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        words = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        rows.append((i, " ".join(w + ("***" if bad and i % 7 else "") for w in words), "en"))
        labels.append((i, int(not bad), 0))
    found = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert all(r.kept for r in found if r.doc_id % 5)
    assert not any(r.kept for r in found if r.doc_id % 5 == 0 and r.doc_id % 7)


def test_language_model_counts_and_gain(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        lang = "ab"[i % 2]
        rows.append((i, " ".join(f"{lang}{x}" for x in (rng.zipf(1.3, 60) % 500)) + (f" rare{i}Z" if i % 9 == 0 else "")))
    rows += [(900, None), (901, ""), (None, "a1 A1"), (902, "x" * 90 + " a1"), (5, rows[5][1])]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most_words=200, rounds=2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*W.findall(common.ascii_lower(t or "")), "\n"]
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_without_training_rows(spark):
    row = lm.lm_scores(spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (3, 0, 0, True)
    assert math.isfinite(row.score)
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_network_gradients_and_state():
    shape = Shape(5, 2, 3, 3, 4)
    rng = np.random.default_rng(0)
    flat = shape.start(np.ones(shape.n_classes), np.ones(5))
    texts = [rng.integers(0, 8, n).astype(np.int32) for n in (3, 50, 7)]
    model = Model(shape, flat)
    whole = model.run(texts, 0)
    assert whole == pytest.approx([model.run([t], 0)[0] for t in texts], rel=1e-4)  # windows and slots don't matter
    # all continuations of a prefix by one code of each class and word sum to one
    prefix = texts[0]
    p = sum(math.exp(model.run([np.append(prefix, np.int32(x))], 0)[0] - model.run([prefix], 0)[0]) for x in range(8))
    assert p == pytest.approx(1, rel=1e-3)

    class Keep(Adam):
        def step(self, params, tokens):
            self.kept = self.flat.copy()

    keep = Keep(shape)
    text = [rng.integers(0, 8, 12).astype(np.int32)]
    model.run(text, 0, keep)
    for i in rng.choice(len(flat), 25, replace=False):
        up, down = flat.astype(np.float32).copy(), flat.astype(np.float32).copy()
        up[i] += 0.02
        down[i] -= 0.02
        slope = -(Model(shape, up).run(text, 0)[0] - Model(shape, down).run(text, 0)[0]) / 0.04
        assert keep.kept[i] == pytest.approx(slope, abs=0.02)


def test_texts_in_a_slot_leave_each_other_alone():
    """A text has the score, and gives the gradients, that it has alone, whatever comes after it in its slot."""
    shape = Shape(40, 16, 10, 5, 6)
    rng = np.random.default_rng(3)
    flat = rng.normal(0, 0.6, shape.size()).astype(np.float32)
    texts = [np.append(rng.integers(1, 50, int(rng.integers(0, 70))), 0).astype(np.int32) for _ in range(60)]
    model = Model(shape, flat)
    assert model.run(texts, 0) == pytest.approx([model.run([t], 0)[0] for t in texts], rel=1e-4)

    class Sum(Adam):
        def __init__(self, shape):
            super().__init__(shape)
            self.sums = np.zeros(shape.size())

        def step(self, params, tokens):
            self.sums += self.flat

    short = [t[-15:] for t in texts]
    together, alone = Sum(shape), Sum(shape)
    for t in short:
        model.run([t], 0, alone)
    for many in (short, short[::-1]):
        together.sums[:] = 0
        lengths = model.run(many, 0, together)
        assert len(lengths) == 60
        # gradients stop where windows end, so they agree but for texts that two windows share
        assert np.corrcoef(together.sums, alone.sums)[0, 1] > 0.99


def test_language_model_keeps_its_size():
    import inspect

    default = {k: p.default for k, p in inspect.signature(lm.lm_scores).parameters.items()}
    assert default["n_words"] >= 256 and default["n_rare"] >= 88 and min(default["state"], default["embed"]) >= 12


def test_words_and_lower_case():
    for text in ["A b\tc\nÀÉ Z\x1cy \xa0x　q\x0bw\x85e", "ABC abc", "ÄB Ab  c\r\n", "", " \n", None, "\x1f a", "é È K"]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        assert common.words_of(text) == W.findall(low) and common.ascii_lower(text or "") == low
    assert [lm.rounds_for(n) for n in (0, 10**6, 1 << 22, 1 << 23, 1 << 40)] == [2, 2, 2, 3, 20]
