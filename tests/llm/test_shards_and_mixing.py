from __future__ import annotations

import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailforge.llm import minhash, mixing, sharding
from trailforge.llm.common import scratch


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"text {i} " * 20, "s0" if i % 3 else "s1", None if i % 5 else "x") for i in range(200)] + [(None, None, None, "path"), (7, "", "s1", "again"), (7, "", "s1", "again")], "doc_id long, text string, source string, path string")


def test_compaction_keeps_rows_and_versions(spark, docs):
    shards = sharding.ShardStore(spark, scratch(spark, "shards"), docs.schema, target_bytes=6000, min_merge=3)
    for i in range(4):
        shards.append(docs.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 4 == i).repartition(3))
    first = shards.manifest().count()
    assert shards.version() == 4 and first == 12
    rounds = shards.compact()
    assert rounds >= 1 and shards.manifest().count() < first
    assert shards.plan().count() == 0
    key = lambda df: sorted(map(str, df.collect()))
    assert key(shards.read()) == key(docs)
    assert shards.manifest().agg(F.sum("rows")).first()[0] == docs.count()
    files = lambda: {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{shards.folder}/data").select("path").collect()}
    live = {r.path for r in shards.manifest().collect()}
    assert live < files() and shards.vacuum() == 0  # young files stay
    assert key(shards.read(4)) == key(docs)  # a reader that holds a version from before the merges
    shards.vacuum(keep_versions=1, min_age_s=0)
    assert files() == live and key(shards.read()) == key(docs)
    assert not shards._publish("another", shards.version())


def test_two_writers_lose_nothing(spark, docs):
    """A second writer commits between the first one's reading of the manifest and its commit."""
    folder = scratch(spark, "shards")
    one, two = (sharding.ShardStore(spark, folder, docs.schema, target_bytes=10**6, min_merge=2) for _ in range(2))
    publish, raced = one._publish, []

    def late(table, version):
        if not raced:
            raced.append(two.append(docs.where("doc_id >= 100")))
        return publish(table, version)

    one._publish = late
    assert one.append(docs.where("doc_id < 100 or doc_id is null")) == 2 and raced == [1]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one.read()) == key(two.read()) == key(docs)
    raced.clear()
    two.append(docs.limit(5))
    before = key(two.read())

    def merged_first(table, version):
        if not raced:
            raced.append(two.compact())
        return publish(table, version)

    one._publish = merged_first  # both merge the same shards: one wins, the other plans anew
    one.compact()
    assert raced and key(one.read()) == before and one.plan().count() == 0


def test_arrivals_in_one_append_and_an_empty_table(spark, docs):
    shards = sharding.ShardStore(spark, scratch(spark, "shards"), docs.schema)
    shards.append(docs.coalesce(1), F.col("doc_id") % 4)
    assert shards.manifest().count() == 5  # null is an arrival of its own
    shards.compact()
    assert shards.read().count() == docs.count() and shards.manifest().count() <= 2
    empty = sharding.ShardStore(spark, scratch(spark, "shards"), docs.schema)
    assert empty.read().count() == 0 and empty.compact() == 0
    empty.append(docs.limit(0))
    assert empty.read().count() == 0 and empty.read().columns == docs.columns


def pfair(counts):
    """Slots of a period: at each, of the released blocks the one due first."""
    size, done, out = sum(counts), [0] * len(counts), []
    for t in range(size):
        ready = [(-(-(done[s] + 1) * size // n), s) for s, n in enumerate(counts) if done[s] < n and done[s] * size // n <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=6))
def test_a_period_is_fair(counts):
    slots = mixing.period_slots(counts)
    size = sum(counts)
    owner = sorted((t, s) for s, x in enumerate(slots) for t in x.tolist())
    assert [s for _, s in owner] == pfair(counts)
    done = [0] * len(counts)
    for t, s in owner:
        done[s] += 1
        assert all(abs(done[i] - counts[i] * (t + 1) / size) < 1 for i in range(len(counts)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.floats(0.1, 10)), min_size=1, max_size=5))
def test_the_plan_is_a_permutation_with_small_deviation(sources):
    blocks, weights = [b for b, _ in sources], [w for _, w in sources]
    rows = mixing.plan(blocks, weights, 64)
    slots = {}
    for r in rows:
        for b in range(r["first"], r["last"]):
            k = b - r["first"]
            n = len(r["slots"])
            slot = r["slot"] + k // n * r["size"] + r["slots"][k % n]
            assert slot not in slots
            slots[slot] = (r["source"], b)
    assert sorted(slots) == list(range(sum(blocks)))
    last = [-1] * len(blocks)
    for t in sorted(slots):
        s, b = slots[t]
        assert b == last[s] + 1
        last[s] = b
    # the first phase follows the quantized weights
    counts = mixing.quantize(weights, max(64, 4 * len(blocks))) if len(blocks) > 1 else [1]
    end = min((r["slot"] for r in rows if r["phase"] == 1), default=len(slots))
    done = [0] * len(blocks)
    for t in range(end):
        done[slots[t][0]] += 1
        assert all(abs(done[i] - counts[i] * (t + 1) / sum(counts)) < 1 for i in range(len(blocks)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.floats(1e-6, 10)), min_size=1, max_size=6))
def test_exact_slots_follow_the_target_weights(sources):
    blocks, weights = [b for b, _ in sources], [Fraction(w) for _, w in sources]
    slots, phases = mixing.exact_slots(blocks, [w for _, w in sources])
    assert [len(x) for x in slots] == blocks
    owner = sorted((t, s, p) for s in range(len(blocks)) for t, p in zip(slots[s].tolist(), phases[s].tolist(), strict=True))
    assert [t for t, _, _ in owner] == list(range(sum(blocks)))
    used, phase = [0] * len(blocks), -1
    for t, s, p in owner:
        if p != phase:
            phase, start, active, done = p, t, [i for i in range(len(blocks)) if used[i] < blocks[i]], [0] * len(blocks)
            total = sum(weights[i] for i in active)
        done[s] += 1
        used[s] += 1
        assert all(abs(done[i] - weights[i] / total * (t + 1 - start)) < 1 for i in active)


def test_blocks_grow_where_they_would_be_too_many(spark):
    assert mixing.block_size([1000, 10], 64, 1 << 20) == 64
    assert mixing.block_size([], 64, 10) == 64
    for rows in ([10**10, 3, 5 * 10**9], [7] * 900, [10**6]):
        size = mixing.block_size(rows, 1, 1000)
        assert sum(-(-n // size) for n in rows) <= 1000
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    rows = mixing.mix_sources(df, {"a": 2.0, "b": 1.0}, block_docs=1, most_blocks=32)
    assert rows.count() == 3000
    per = rows.groupBy("__slot").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"), F.countDistinct("__in_block").alias("d")).collect()
    assert len(per) <= 32 and all(r.s == 1 and r.d == r.n <= 100 for r in per)


def test_a_table_follows_the_target_weights(spark):
    """A weight far below a period's 1/1024 does not get a block of every period."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "a").otherwise("b").alias("source"))
    rows = mixing.mix_sources(df, {"a": 1.0, "b": 1e-4}, block_docs=1).where("__phase = 0").orderBy("__slot").collect()
    assert len(rows) >= 2500
    b = 0
    for t, r in enumerate(rows, 1):
        b += r.source == "b"
        assert abs(b - t * 1e-4 / 1.0001) < 1


def test_quantize():
    assert sum(mixing.quantize([1, 2, 3.5], 100)) == 100
    assert min(mixing.quantize([1e-9, 1, 1], 64)) == 1


def test_mixing_a_table(spark, docs):
    rows = mixing.mix_sources(docs.repartition(5), {"s0": 3.0, "s1": 1.0, "other": None}, block_docs=4, period=16).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.source, {}).setdefault(r["__source_block"], []).append(r)
    for source, blocks in by.items():
        n = sum(map(len, blocks.values()))
        assert sorted(blocks) == list(range(math.ceil(n / 4)))
        assert all(len(b) == 4 for k, b in blocks.items() if k < n // 4)
        assert all(len({r["__slot"] for r in b}) == 1 for b in blocks.values())
        ids = [r.doc_id for k in sorted(blocks) for r in sorted(blocks[k], key=lambda r: r["__in_block"])]
        assert ids == sorted(ids, key=lambda i: (i is not None, i)), source
    want = mixing.plan([math.ceil(sum(map(len, by[s].values())) / 4) for s in (None, "s0", "s1")], [1.0, 3.0, 1.0], 16)
    assert {r["__slot"] for r in rows} == set(range(sum(p["last"] - p["first"] for p in want)))
    order = mixing.mixed(docs, weights={"s0": 3.0, "s1": 1.0}, block_docs=4, period=16)
    assert order.columns == docs.columns and order.count() == docs.count()
    assert mixing.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, max_sources=2)
    clashing = docs.withColumns({"__slot": F.lit("x"), "__at": F.lit("y")})
    assert mixing.mix_sources(clashing).where("__slot = 0 and __at = 'y'").count() > 0
    assert mixing.mixed(clashing).columns == clashing.columns


def test_columns_that_cannot_be_hashed(spark):
    df = spark.createDataFrame([(1, "a", "s", {"k": 1}), (1, "a", "s", {"k": 2}), (2, "b", None, None)], "doc_id long, text string, source string, extra map<string,int>")
    assert sorted(r.doc_id for r in mixing.mixed(df).collect()) == [1, 1, 2]
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(df, words=1).collect()) == [1, 2]
