"""Near-duplicates by MinHash with tensored banding, verified on whole shingle sets.

Two collections of ``groups`` small hashes (each of ``depth`` minhashes) are
computed; a table is a pair of one hash of either collection. So groups**2 tables
of 2*depth minhashes come from 2*groups*depth minhashes. Documents at
similarity s share a table with probability (1 - (1 - s**depth)**groups)**2;
with 20 groups of 4 that is 0.99995 at 0.8.

Documents with equal shingle sets are one class, picked before the shuffle. Small
hashes that only one class has can't be in a shared table and are left out
before tables are formed. A table's bucket is not expanded into pairs:

1. In each of ``rounds`` rounds every bucket that still holds several components takes one
   pivot (its least class first, a class by a hash afterwards), and each class is compared with
   the pivot it differs least from in 128 bits of minhashes. That is at most one comparison
   for each class and round, and brings most of a large group together.
2. What is left is finished exactly. Components that have members in one bucket which agree in
   set size and in most of the bits (at similarity 0.8 all but 5 in 100,000 do) are kin;
   families are the components of kinship over all buckets. In a family every two members of
   different components that pass the same filters are compared on their full shingle sets,
   nearest first, those that links found meanwhile have joined left out. Both steps work in
   blocks of bounded size: where a bucket (family) is larger than a block, its main component and the
   others are dealt into tiles, and a block has two tiles, or one, whose members meet. Each pair
   meets in one block, but for those in the main component, which needn't; a member is sent to as many blocks as there are tiles it meets.

So every pair that shares a table and passes the filters is compared or joined. Only for a
family whose members stay apart does the work in step 2 grow with the square of
its size.

Defined results: null or empty texts, and texts of white space, have no shingles,
are linked with nothing and stay; an empty table gives no rows; texts are read whole, however
long; repeated rows are copies of each other; of equals the smallest identifier names the
component; a null identifier is never a component's name unless all of the component are null
(then the name is null); columns beyond doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_texts, bound_batches, mix, pieces, row_hash, seeds, store, tables, tidily, whole_row, word_hashes, words_of
from .graph import components

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int) -> set[tuple[str, ...]]:
    """The exact shingles of a whole text; fewer words than a shingle has are one shingle."""
    w = words_of(text)
    if len(w) < words:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(words)), strict=False))


def shingle_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text, from its words' hashes."""
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(min(len(h), words)))
    for i in range(min(words, len(h))):
        out = mix(out * _STEP + h[i : i + n])
    return np.unique(out)


def small_hashes(s: np.ndarray, groups: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The 2*groups small hashes of a set, the first half being one collection, and one bit of each of BITS minhashes, packed."""
    n = 2 * groups * depth
    a, b = seeds(2 * n)[:n, None], seeds(2 * n)[n:, None] | np.uint64(1)
    least = np.full(n, ~np.uint64(0))
    for i in range(0, len(s), 2048):
        np.minimum(least, ((s[None, i : i + 2048] ^ a) * b).min(axis=1), out=least)
    out = seeds(2 * groups).copy()
    for column in least.reshape(2 * groups, depth).T:
        out = mix(out * _STEP + column)
    bits = np.packbits((np.resize(least, BITS) & np.uint64(1)).astype(np.uint8)).view(np.uint64)
    return out, bits


#: Minhashes of which one bit each is kept with the classes in tables.
BITS = 128


def most_different(percent: int) -> int:
    """Bits that sets at the least similarity differ in at most, but for 5 in 100,000."""
    q = (1 - percent / 100) / 2
    return int(BITS * q + 4.2 * (BITS * q * (1 - q)) ** 0.5)


def signatures(docs: DataFrame, words: int, groups: int, depth: int) -> DataFrame:
    """doc_id, thash, n_shingles, set_id (null without shingles), halves, b0, b1."""

    def sign(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            data, starts = arrow_texts(batch.column("text"))
            with np.errstate(over="ignore"):
                h, first = word_hashes(data, starts)
                sets = [shingle_hashes(h[a:b], words) for a, b in zip(first[:-1], first[1:], strict=True)]
                signed = [small_hashes(s, groups, depth) if len(s) else None for s in sets]
                halves = [x and x[0].view(np.int64) for x in signed]
                bits = np.array([x[1] if x else (0, 0) for x in signed], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("thash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array(halves, pa.list_(pa.int64())), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
                ["doc_id", "thash", "n_shingles", "set_id", "halves", "b0", "b1"],
            )

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(tidily(sign), "doc_id long, thash long, n_shingles long, set_id binary, halves array<long>, b0 long, b1 long")


def similar(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, text_a, text_b) whose exact sets reach percent."""

    def check(batches):
        import pyarrow as pa

        cache: OrderedDict[int, set] = OrderedDict()

        def shingles(key, text):
            if key not in cache:
                cache[key] = shingle_set(text, words)
                if len(cache) > 32:
                    cache.popitem(last=False)
            cache.move_to_end(key)
            return cache[key]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                x, y = shingles(a, x), shingles(b, y)
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    bound_batches(pairs.sparkSession)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(tidily(check), "a long, b long")


def whole_groups(batches, names: tuple[str, ...], least_rows: int = 1):
    """Tables of whole groups (rows that agree in the named integer columns), from batches sorted by them; with where each group begins, and the end."""
    import pyarrow as pa

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [np.asarray(t.column(c)) for c in names]
        return t, np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0), [True]]))

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least_rows:
            t, begin = out()
            if len(begin) > 2:
                yield t.slice(0, begin[-2]), begin[:-1]
                held, rows = t.slice(begin[-2]).to_batches(), t.num_rows - int(begin[-2])
    if held:
        yield out()


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Labels (label[x] is the least number of x's component) after joining i with j."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _columns(t, names: tuple[str, ...]) -> list[np.ndarray]:
    return [np.asarray(t.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in names]


MARKS = ("cid", "root", "side", "n_shingles", "b0", "b1")

#: The side of rows that all meet in their block.
BOTH = 2


def _differ(b0, b1, i, j):
    return np.bitwise_count((b0[i] ^ b0[j]).view(np.uint64)) + np.bitwise_count((b1[i] ^ b1[j]).view(np.uint64))


def _passes(root, side, n, b0, b1, i, j, percent: int) -> np.ndarray:
    """Of the pairs i, j those in different components that sizes and bits don't rule out (rows of one side, 0 or 1, don't meet here)."""
    ok = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == BOTH))
    ok &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
    ok[ok] = _differ(b0, b1, i[ok], j[ok]) <= most_different(percent)
    return ok


def kin(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that hold together the roots of each bucket and block whose members pass the filters."""

    def work(batches):
        import pyarrow as pa

        for t, begin in whole_groups(batches, ("bucket", "block"), 8192):
            _, root, side, n, b0, b1 = _columns(t, MARKS)
            group = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            roots, own = np.unique(root, return_inverse=True)
            label, held, size = np.arange(len(roots)), [], 0
            i, step = np.arange(len(root) - 1), 1
            while len(i):  # all pairs that are step apart in one group
                i = i[: np.searchsorted(i, len(root) - step)]
                i = i[group[i] == group[i + step]]
                ok = _passes(own, side, n, b0, b1, i, i + step, percent)
                held.append((own[i[ok]], own[i[ok] + step]))
                size += len(held[-1][0])
                if size > 200_000:
                    unite(label, *map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
                step += 1
            if held:
                unite(label, *map(np.concatenate, zip(*held, strict=True)))
            joined = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(roots[joined]), pa.array(roots[label[joined]])], ["a", "b"])

    rows = placed.select("bucket", "block", *MARKS).repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return rows.mapInArrow(tidily(work), "a long, b long")


def family_links(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): links by which components of each family and block come together, all of them confirmed on full sets."""

    def common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(others)
        at = np.minimum(np.searchsorted(own, both), len(own) - 1)
        return np.add.reduceat((own[at] == both).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))

    def links(cid, root, side, n, b0, b1, sets):
        _, label, count = np.unique(root, return_inverse=True, return_counts=True)
        every, whole = np.arange(len(cid)), bool(len(side)) and side[0] == BOTH
        outside = label != np.argmax(count) if whole else side == 1
        for x in np.flatnonzero(outside).tolist():
            rest = every[~outside | (every > x)] if whole else every[~outside]
            rest = rest[_passes(label, side, n, b0, b1, np.full(len(rest), x), rest, percent)]
            rest = rest[np.argsort(_differ(b0, b1, np.full(len(rest), x), rest), kind="stable")]
            while len(rest):
                now, rest = rest[:32], rest[32:]
                both = common(sets[x], [sets[y] for y in now.tolist()])
                for y in now[100 * both >= percent * (n[x] + n[now] - both)].tolist():
                    if label[y] != label[x]:
                        yield cid[x], cid[y]
                        label[label == label[y]] = label[x]
                rest = rest[label[rest] != label[x]]

    def work(batches):
        import pyarrow as pa

        for t, begin in whole_groups(batches, ("family", "block")):
            marks = _columns(t, MARKS)
            sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
            found = [p for lo, hi in zip(begin[:-1], begin[1:], strict=True) for p in links(*(m[lo:hi] for m in marks), sets[lo:hi])]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = placed.select("family", "block", *MARKS, "shingles").repartition("family", "block").sortWithinPartitions("family", "block")
    return rows.mapInArrow(tidily(work), "a long, b long")


def in_blocks(rows: DataFrame, key: str, size, most: int) -> DataFrame:
    """Rows (key, cid, root, ...) of the keys with several roots, with block and side.

    A key of up to most in size is one block, in which all meet (side BOTH). Else its main root and the other rows are dealt into
    tiles of about most: a tile of the main root and one of the others meet in a block (sides 0 and 1), and so do two tiles of the others; the
    rows of one tile of the others meet in a block of their own (BOTH). A block's size is about twice most.
    """
    roots = rows.groupBy(key, "root").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    keys = roots.groupBy(key).agg(F.max_by(F.struct("root", "size"), F.struct("n", "root")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("n")).where("n > 1")
    tiles = lambda of: F.greatest(F.ceil(of / most), F.lit(1)).cast("long")
    keys = keys.select(key, F.col("main.root").alias("main"), (F.col("size") <= most).alias("whole"), tiles(F.col("main.size")).alias("mains"), tiles(F.col("size") - F.col("main.size")).alias("others"))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    spot = lambda block, side: F.struct(block.alias("block"), side.cast("int").alias("side"))
    tile = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    a, b = tile("mains"), tile("others")
    of_main = F.transform(up_to("others"), lambda j: spot(a * F.col("others") + j, F.lit(0)))
    with_main = F.transform(up_to("mains"), lambda i: spot(i * F.col("others") + b, F.lit(1)))
    first = F.col("mains") * F.col("others")
    with_others = F.transform(up_to("others"), lambda j: spot(first + F.least(b, j) * F.col("others") + F.greatest(b, j), F.when(j == b, BOTH).when(b < j, 0).otherwise(1)))
    spots = F.when(F.col("whole"), F.array(spot(F.lit(0).cast("long"), F.lit(BOTH)))).when(F.col("root") == F.col("main"), of_main).otherwise(F.concat(with_main, with_others))
    placed = rows.join(keys, key).withColumn("spot", F.explode(spots))
    return placed.select(*rows.columns, "spot.block", "spot.side")


def class_sets(texts: DataFrame, words: int) -> DataFrame:
    """(cid, shingles): the sorted hashes of a class's shingles, from its text."""

    def work(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            data, starts = arrow_texts(batch.column("text"))
            with np.errstate(over="ignore"):
                h, first = word_hashes(data, starts)
                sets = [shingle_hashes(h[a:b], words).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return texts.select("cid", "text").mapInArrow(tidily(work), "cid long, shingles binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, groups: int = 20, depth: int = 4, rounds: int = 2, block_rows: int = 2048, block_shingles: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("thash", F.xxhash64("text"))
    rows = store(signatures(docs, words, groups, depth), "signatures")
    first = Window.partitionBy("set_id").orderBy(F.col("doc_id").asc_nulls_last(), "thash")
    classes = rows.where("set_id is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    classes = store(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    mark = ("cid", "n_shingles", "b0", "b1")
    small = classes.select(*mark, F.posexplode("halves").alias("pos", "h"))
    shared = small.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    own = small.join(shared, "h").groupBy(*mark).agg(F.collect_list(F.struct("pos", "h")).alias("own"))
    half = lambda test: F.transform(F.filter("own", lambda x: test(x["pos"])), lambda x: x["h"])
    own = own.select(*mark, half(lambda p: p < groups).alias("left"), half(lambda p: p >= groups).alias("right"))
    table = own.select(*mark, F.explode("left").alias("l"), "right").select(*mark, "l", F.explode("right").alias("r")).select(*mark, F.xxhash64("l", "r").alias("bucket"))
    crowded = table.groupBy("bucket").agg(F.min("cid").alias("c0"), F.max("cid").alias("c1")).where("c0 < c1").select("bucket")
    buckets = store(table.join(crowded, "bucket"), "buckets")

    live = buckets.select("cid").distinct()
    wanted = classes.join(live, "cid").select("cid", "doc_id", "thash")
    found = docs.alias("d").join(wanted.alias("w"), (F.col("d.thash") == F.col("w.thash")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("cid", "text")
    texts = store(found.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy("cid"))).where("nth = 1").drop("nth"), "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.withColumnRenamed("b", "cid").join(texts.withColumnRenamed("text", "text_b"), "cid")
        return similar(with_b.withColumnRenamed("cid", "b"), words, percent)

    size, other = F.col("n_shingles"), F.col("lead.n_shingles")
    differ = F.bit_count(F.col("b0").bitwiseXOR(F.col("lead.b0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("lead.b1")))
    near = (differ <= most_different(percent)) & (F.least(size, other) * 100 >= F.greatest(size, other) * percent)

    rooted = lambda rows, roots: rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    links = roots = None
    for turn in range(rounds):
        held = rooted(buckets, roots) if turn else buckets.withColumn("root", F.col("cid"))
        order = F.xxhash64("cid", "bucket", F.lit(turn)) if turn else F.col("cid")
        leads = held.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by(F.struct(*mark, "root"), order).alias("lead")).where("r0 < r1").select("bucket", "lead")
        open_ = held.join(leads, "bucket")
        open_ = store(open_, "open") if turn else open_
        met = open_.where("root <> lead.root").where(near).groupBy("cid").agg(F.min_by("lead.cid", F.struct(differ, "lead.cid")).alias("lead"))
        found = store(confirm(met.select(F.greatest("cid", "lead").alias("a"), F.least("cid", "lead").alias("b")).distinct()), "links")
        links = links.union(found) if turn else found
        roots = components(links)
        buckets = open_.select("bucket", *mark) if turn else buckets

    # the rest exactly
    held = rooted(buckets, roots)
    related = store(kin(in_blocks(held, "bucket", F.lit(1), block_rows), percent).distinct(), "kin")
    families = components(related).select(F.col("node").alias("root"), F.col("root").alias("family"))
    members = store(held.select(*mark, "root").distinct().join(families, "root"), "members")
    sets = class_sets(texts.join(members.select("cid"), "cid", "left_semi"), words)
    found = store(family_links(in_blocks(members.join(sets, "cid"), "family", size, block_shingles), percent), "links")
    roots = components(found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    named = classes.select("cid", "set_id", "doc_id").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("set_id", "doc_id", F.coalesce("root", "cid").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "root").select("set_id", "component_id")
    return rows.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One document of each group (that with the group's name), with the columns of docs; of repeated rows one."""
    marked = near_duplicates(docs.select("doc_id", "text"), **how)
    lost = marked.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = docs.join(lost, "doc_id", "left_anti")
    rows = kept.select(whole_row(kept).alias("__row"), "doc_id", F.xxhash64("text").alias("__text"), row_hash(kept).alias("__hash"))
    same = Window.partitionBy("doc_id", "__text").orderBy("__hash")
    return rows.withColumn("__nth", F.row_number().over(same)).where((F.col("__nth") == 1) | F.col("doc_id").isNull()).select("__row.*")


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(tables(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
