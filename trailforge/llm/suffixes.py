"""Removal of byte strings that occur elsewhere, by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts at another
place (of the same or another text) is removed. Texts never join: no string
spans two of them.

How the rows are found:

1. Equal texts are one text with a count, picked before the shuffle.
2. In every window of ``length`` bytes the least of its ``GRAM``-byte grams (by
   hash) is its anchor. Equal windows have equal anchors, so windows whose
   anchor's gram occurs once in all texts can't repeat and are passed over.
3. The rest of the text, as contexts (an anchor's windows in a row), is dealt out by
   the anchor's gram into shards. Each shard gets a suffix array by
   Larsson-Sadakane refinement and common prefixes by Kasai's rule (in its
   permuted form, where only irreducible values are compared); neighbours that
   share ``length`` bytes are the repeats. Equal contexts are one with a count.
4. The contexts of a gram that more than ``shard_contexts`` places share are
   split over several shards. Windows that one such shard has once are
   looked for by binary search in the merged sorted runs of all shards; the runs
   are dealt out by ranges of their digests.
5. The spans found are united for each text and cut out.

Defined results: a null text is empty; texts shorter than ``length`` keep all; very long texts are read whole, in
slices that overlap; repeated rows are copies of each other and lose everything; of equal strings none is
preferred: all go; an empty table gives no rows; identifiers and other columns are only carried along, and
their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, _power_table, arrow_texts, bound_batches, mix, pieces, store, tables, text_or_empty, tidily, whole_row

GRAM = 24
_INDEX_BITS = 24
_SLICE = 1 << 17


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of symbols 0..510 by Larsson-Sadakane refinement, and the packed 7-symbol keys."""
    n = len(t)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(7, np.int64)])  # 0: past the end
    for i in range(7):
        key = (key << 9) | padded[i : i + n]
    sa = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    at, order, sorted_key, h = np.arange(n), sa, key[sa], 7
    while len(at):
        first = np.empty(len(at), bool)
        first[0] = True
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=first[1:])
        begin = np.flatnonzero(first)
        sizes = np.diff(np.append(begin, len(at)))
        rank[order] = np.repeat(at[begin], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        if not len(at):
            break
        order = sa[at]
        both = rank[order] * (n + 1) + rank[np.minimum(order + h, n)] + 1
        by = np.argsort(both)
        order, sorted_key = order[by], both[by]
        sa[at] = order
        h *= 2
    return sa, key


def common_prefixes(t: np.ndarray, sa: np.ndarray, key: np.ndarray) -> np.ndarray:
    """lcp[j]: common prefix of the suffixes sa[j-1] and sa[j] (lcp[0] = 0), by Kasai's rule.

    The prefix at text position i is at least that at i - 1 less one, and exactly
    that where the symbols before both suffixes are equal; only the other
    (irreducible) positions are compared.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    open_ = np.ones(n, bool)
    has = (before > 0) & (i > 0)
    open_[has] = t[i[has] - 1] != t[before[has] - 1]
    a = np.flatnonzero(open_ & (before >= 0))
    b = before[a]
    value = np.zeros(n, np.int64)
    left, right = np.append(key, -1), np.append(key, -2)
    symbols_a, symbols_b = np.append(t.astype(np.int64), -1), np.append(t.astype(np.int64), -2)
    live = np.arange(len(a))
    found = np.zeros(len(a), np.int64)
    while len(live):
        same = left[np.minimum(a[live] + found[live], n)] == right[np.minimum(b[live] + found[live], n)]
        rest = live[~same]
        for _ in range(6):
            rest = rest[symbols_a[np.minimum(a[rest] + found[rest], n)] == symbols_b[np.minimum(b[rest] + found[rest], n)]]
            found[rest] += 1
        live = live[same]
        found[live] += 7
    value[a] = found
    reach = np.where(open_, value + i, 0)
    plcp = np.maximum(np.maximum.accumulate(reach) - i, 0)
    plcp[sa[0]] = 0
    return plcp[sa]


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For several texts: (text, anchor, gram, lo, hi) of each run of windows with one anchor.

    Positions count from the text's beginning; windows lo..hi of the text have
    the anchor. starts: where each text begins in data, and the end of the last.
    """
    parts = []
    i = 0
    sizes = np.diff(starts)
    while i < len(sizes):
        if sizes[i] < length:
            i += 1
            continue
        j = i + 1
        while j < len(sizes) and starts[j + 1] - starts[i] <= _SLICE:
            j += 1
        lo, hi = int(starts[i]), int(starts[j])
        text_starts = starts[i : j + 1]
        for at in range(lo, hi, _SLICE):  # one turn, unless a text is very long
            part = _anchors(data[at : min(hi, at + _SLICE + length - 1)], length)
            if part is not None:
                a, gram, first = part
                p = np.arange(len(a)) + at
                text = np.searchsorted(text_starts, p, "right") - 1
                ok = p + length <= text_starts[text + 1]
                p, a, text, gram = p[ok], a[ok] + at, text[ok], gram[ok]
                if len(p):
                    new = np.ones(len(p), bool)
                    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
                    b = np.flatnonzero(new)
                    e = np.append(b[1:], len(p)) - 1
                    base = text_starts[text[b]]
                    parts.append((text[b] + i, a[b] - base, gram[b], p[b] - base, p[e] - base))
        i = j
    if not parts:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _anchors(data: np.ndarray, length: int):
    """The anchor of each window and its gram's hash."""
    n = len(data)
    if n < length:
        return None
    up, down = _power_table(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = np.uint64((1 << _INDEX_BITS) - 1)
    m = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    wide, most = 1, length - GRAM + 1
    while wide * 2 <= most:
        m = np.minimum(m[:-wide], m[wide:])
        wide *= 2
    if wide < most:
        m = np.minimum(m[: len(m) - (most - wide)], m[most - wide :])
    a = (m & low).astype(np.int64)
    return a, grams[a], None


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def shard_repeats(contexts: list[bytes], counts: np.ndarray, length: int):
    """(flag of each symbol place: a repeated window starts there, first place of each context, class of each place, -1 if no window).

    A place's window counts as often as its context does.
    """
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    t = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int16) + 1
    t[begin + sizes] = 0
    sa, key = suffix_array(t)
    lcp = common_prefixes(t, sa, key)
    left = np.repeat(begin + sizes, sizes + 1) - np.arange(len(t))
    cls = np.empty(len(t), np.int64)
    cls[sa] = np.cumsum(lcp < length)
    window = left >= length
    weight = np.bincount(cls[window], weights=np.repeat(counts, sizes + 1)[window], minlength=int(cls.max(initial=0)) + 1)
    cls[~window] = -1
    return window & (weight[cls] >= 2), begin, cls


PLACE = np.dtype([("key", "V16"), ("lo", "<i4")])
#: Digests without zero bytes, so that numpy orders them as strings.
DIGEST = "S16"
FOUND = "kind int, gram long, part int, key binary, body binary, places binary"


def _emit(schema, rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def spans_of(contexts: DataFrame, length: int, block_bytes: int = 1 << 20) -> DataFrame:
    """Rows of kind 0: (key, body): packed (start, end) spans to remove from the text key; of kind 1: a sorted
    run of window digests of a split gram: (gram, part, body, places), places packed, with lo -1 where the window is settled."""

    def work(batches):
        import pyarrow as pa

        schema = pa.schema([("kind", pa.int32()), ("gram", pa.int64()), ("part", pa.int32()), ("key", pa.binary()), ("body", pa.binary()), ("places", pa.binary())])
        held: list[tuple] = []
        size, last = 0, None

        def settle():
            merged: dict[tuple, list] = {}
            for gram, sub, subs, ctx, n, places in held:
                x = merged.setdefault((gram, ctx), [0, [], sub, subs])
                x[0] += n
                x[1].append(places)
            names = list(merged)
            flags, begin, cls = shard_repeats([c for _, c in names], np.array([merged[x][0] for x in names]), length)
            spans: dict[bytes, list] = {}
            runs: dict[tuple, list] = {}
            for (gram, ctx), b in zip(names, begin, strict=True):
                n, parts, _, subs = merged[gram, ctx]
                windows = len(ctx) - length + 1
                own = flags[b : b + windows]
                if own.any():
                    f, e = _runs(own)
                    both = np.stack([f, e + length], axis=1)
                    for key, lo in np.frombuffer(b"".join(parts), PLACE).tolist():
                        spans.setdefault(key, []).append(both + lo)
                if subs > 1:
                    first = np.frombuffer(parts[0], PLACE)[0]
                    for p in range(windows):
                        digest = hashlib.blake2b(ctx[p : p + length], digest_size=16).digest().replace(b"\0", b"\1")
                        runs.setdefault((gram, int.from_bytes(digest[:4], "big") * subs >> 32), {})[digest] = (first["key"].item(), int(first["lo"]) + p) if not own[p] else (b"\0" * 16, -1)
            rows = [(0, None, None, key, np.concatenate(x).astype("<i4").tobytes(), None) for key, x in spans.items()]
            for (gram, part), found in runs.items():
                digests = sorted(found)
                rows.append((1, gram, part, None, b"".join(digests), np.array([found[d] for d in digests], PLACE).tobytes()))
            return _emit(schema, rows)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "sub", "subs", "ctx", "n", "places")), strict=True):
                if size >= block_bytes and row[:2] != last:
                    yield settle()
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[3])
        if held:
            yield settle()

    return contexts.repartition("gram", "sub").sortWithinPartitions("gram", "sub").mapInArrow(tidily(work), FOUND)


def merge_runs(found: DataFrame, length: int) -> DataFrame:
    """Spans of windows that are alone in their shard but are in another shard of the same gram."""

    def merge(group):
        import pyarrow as pa

        schema = pa.schema([("key", pa.binary()), ("body", pa.binary())])
        runs = [np.frombuffer(b, DIGEST) for b in group.column("body").to_pylist()]
        places = [np.frombuffer(b, PLACE) for b in group.column("places").to_pylist()]
        rows: dict[bytes, list] = {}
        merged = np.sort(np.concatenate(runs))  # a run has a digest once, so one that is there twice is in two shards
        for r, own in zip(runs, places, strict=True):
            asked = np.flatnonzero(own["lo"] >= 0)
            hit = np.searchsorted(merged, r[asked], "right") - np.searchsorted(merged, r[asked]) > 1
            for key, lo in own[asked[hit]].tolist():
                rows.setdefault(key, []).append((lo, lo + length))
        return pa.table([pa.array(list(rows), pa.binary()), pa.array([np.array(x, "<i4").tobytes() for x in rows.values()], pa.binary())], schema=schema)

    return found.where("kind = 1").select("gram", "part", "body", "places").groupBy("gram", "part").applyInArrow(merge, "key binary, body binary")


def _with_counts(places: DataFrame, shared: DataFrame, common: int, most_broadcast: int = 1 << 20) -> DataFrame:
    """places with the counts of their grams: grams with more than ``common`` places by a broadcast, up to most_broadcast
    of them (16 MB), so that their places aren't gathered; the others by a join, where none has more rows than that."""
    hot = shared.where(F.col("n") > common)
    if not 0 < hot.count() <= most_broadcast:
        return places.join(shared, "gram")
    hot = F.broadcast(hot)
    return places.join(hot, "gram").unionByName(places.join(hot, "gram", "left_anti").join(shared, "gram"))


#: Keys of repeated texts (16 bytes each) up to which they are broadcast.
MOST_COPIED = 1 << 20


def remove_repeats(docs: DataFrame, length: int = 200, shard_contexts: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(rows, changed): docs with key and n_bytes, and for each key whose text loses bytes
    (key, n_removed, n_spans, kept_sha256, kept): join them by key, left."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.withColumn("text", text_or_empty()).withColumns({"key": F.unhex(F.md5(F.col("text").cast("binary"))), "n_bytes": F.octet_length("text").cast("long")})
    long = rows.where(F.col("n_bytes") >= length)
    copies = long.groupBy("key").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes")).where("copies > 1")
    copies = store(copies, "copies")
    again = copies.select("key")
    again = F.broadcast(again) if copies.count() <= MOST_COPIED else again
    # only texts that come again are shuffled to pick one of each
    nth = F.row_number().over(Window.partitionBy("key").orderBy("n_bytes"))
    one = long.select("key", "text", "n_bytes").join(again, "key", "left_semi").withColumn("nth", nth).where("nth = 1").select("key", "text")
    texts = store(long.select("key", "text").join(again, "key", "left_anti").unionByName(one), "texts")

    def find(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            data, starts = arrow_texts(batch.column("text"))
            text, a, gram, _, _ = anchors(data, starts, length)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(text)), pa.array(a.astype(np.int32)), pa.array(gram.view(np.int64))], ["key", "anchor", "gram"])

    places = store(texts.mapInArrow(tidily(find), "key binary, anchor int, gram long"), "anchors")
    shared = store(places.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    suspects = _with_counts(places, shared, shard_contexts).groupBy("key").agg(F.collect_list(F.struct("anchor", "n")).alias("suspects"))

    def cut(batches):
        import pyarrow as pa

        schema = pa.schema([("gram", pa.int64()), ("sub", pa.int32()), ("subs", pa.int32()), ("ctx", pa.binary()), ("n", pa.int64()), ("places", pa.binary())])
        for batch in pieces(batches):
            data, starts = arrow_texts(batch.column("text"))
            keys = batch.column("key").to_pylist()
            wanted = batch.column("suspects")
            flat = wanted.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(wanted.value_lengths()))
            code = (owner << 32) + np.asarray(flat.field("anchor"))
            by = np.argsort(code)
            code, times = code[by], np.asarray(flat.field("n"))[by]
            text, a, gram, lo, hi = anchors(data, starts, length)
            mine = (text << 32) + a
            at = np.minimum(np.searchsorted(code, mine), max(0, len(code) - 1))
            ok = np.flatnonzero(code[at] == mine) if len(code) else []
            found: dict[tuple, list] = {}
            raw = data.tobytes()
            for i in ok:
                base = int(starts[text[i]])
                ctx = raw[base + int(lo[i]) : base + int(hi[i]) + length]
                found.setdefault((int(gram[i].astype(np.int64)), -(-int(times[at[i]]) // shard_contexts), ctx), []).append((keys[text[i]], int(lo[i])))
            rows = [(g, hash_of(p[0], subs), subs, ctx, len(p), np.array(p, PLACE).tobytes()) for (g, subs, ctx), p in found.items()]
            yield _emit(schema, rows)

    contexts = texts.join(suspects, "key").mapInArrow(tidily(cut), "gram long, sub int, subs int, ctx binary, n long, places binary")
    found = store(spans_of(contexts, length), "found")
    spans = found.where("kind = 0").select("key", "body").union(merge_runs(found, length))
    spans = spans.groupBy("key").agg(F.collect_list("body").alias("spans"))

    def apply(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for batch in batches:
            out = []
            for key, text, bodies in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                s = np.concatenate([np.frombuffer(b, "<i4").reshape(-1, 2) for b in bodies])
                s = s[np.argsort(s[:, 0], kind="stable")]
                end = np.maximum.accumulate(s[:, 1])
                new = np.flatnonzero(np.concatenate([[True], s[1:, 0] > end[:-1]]))
                first, last = s[new, 0].tolist(), end[np.append(new[1:], len(s)) - 1].tolist()
                kept = b"".join(raw[a:b] for a, b in zip([0, *last], [*first, len(raw)], strict=True))
                out.append((key, len(raw) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept))
            yield _emit(schema, out)

    cut_texts = texts.join(spans, "key").join(copies, "key", "left_anti").mapInArrow(tidily(apply), "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    gone = copies.select("key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    return rows, cut_texts.union(gone)


def hash_of(place: tuple[bytes, int], subs: int) -> int:
    """The shard of a split gram that a context goes to."""
    return int.from_bytes(hashlib.blake2b(place[0] + place[1].to_bytes(4, "little"), digest_size=4).digest(), "big") % subs


def _decoded(b: pd.Series) -> pd.Series:
    return b.map(lambda x: bytes(x).decode("utf-8", "ignore"))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with the repeated strings cut out of text; characters that a cut leaves incomplete go too."""
    marked = docs.select(whole_row(docs).alias("__row"), "text")
    rows, changed = remove_repeats(marked, length)

    decode = F.pandas_udf(_decoded, "string")
    kept = changed.select("key", decode("kept").alias("__kept"))
    joined = rows.join(kept, "key", "left")
    return joined.select(*(F.coalesce("__kept", "__row.text").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    rows, changed = remove_repeats(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = rows.join(changed.drop("kept"), "key", "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"))
