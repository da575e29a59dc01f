"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks in the order of their identifiers. With
share w of the weights, a source's k-th block of a phase is released at
floor((k-1)/w) and due at ceil(k/w), in whole numbers without rounding, and each
slot goes to the released block with the earliest deadline. So after any number
of slots of a phase every source has had its weight's share of that phase to within less than
one block, however long the phase is. When a source is used up, the others go on
with their weights scaled up (a new phase, whose count begins anew: over p phases the
deviations add up to less than p blocks). Nothing is dropped or repeated.

With a ``period`` weights are rounded to blocks of a period instead and one
period's table repeats: deviations hold against the rounded weights only.

The driver handles a row for each source (at most ``max_sources``, else an error)
and a slot for each block. Blocks have ``block_docs`` documents, and more in proportion where
there would otherwise be over ``most_blocks`` of them, so that the driver's work is
bounded; the deviation stays within one such block. Rows of documents are
numbered on executors from a range-partitioned table and a count for each
partition and source, so a source with a third of all rows is dealt out like
any other.

Defined results: a null source is a source of its own; sources without a weight,
or with one that is null, negative or zero, share the smallest positive weight
(1 if there is none); rows with equal identifiers are put in the order of their
hash; an empty table gives no rows; input columns with the names of the new ones
are replaced.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, store, tables, whole_row


def quantize(weights: list[float], period: int) -> list[int]:
    """Blocks of each source in a period: largest remainders, one at least."""
    spare = period - len(weights)
    exact = [w / math.fsum(weights) * spare for w in weights]
    out = [1 + int(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (int(exact[i]) - exact[i], i))[: period - sum(out)]:
        out[i] += 1
    return out


def period_slots(counts: list[int]) -> list[np.ndarray]:
    """For each source the slots of its blocks in a period of sum(counts) slots: earliest deadline first."""
    period = sum(counts)
    slots: list[list[int]] = [[] for _ in counts]
    waiting: list[list[int]] = [[] for _ in range(period + 1)]  # by release
    for s, n in enumerate(counts):
        if n:
            waiting[0].append(s)
    ready: list[tuple[int, int]] = []
    for t in range(period):
        for s in waiting[t]:
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // counts[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if (k := len(slots[s])) < counts[s]:
            waiting[max(t + 1, k * period // counts[s])].append(s)
    return [np.array(x, np.int64) for x in slots]


def plan(blocks: list[int], weights: list[float], period: int = 1024) -> list[dict]:
    """Rows (phase, source, first, last, slot, size, slots): blocks first..last-1 of a source in a phase.

    Block b has slot + (b - first) // n * size + slots[(b - first) % n], n = len(slots).
    """
    done, at, rows, phase = [0] * len(blocks), 0, [], 0
    while active := [s for s in range(len(blocks)) if done[s] < blocks[s]]:
        size = max(period, 4 * len(active)) if len(active) > 1 else 1
        counts = quantize([weights[s] for s in active], size)
        tables_ = period_slots(counts)

        def slot_of(i: int, b: int, counts=counts, tables_=tables_, size=size) -> int:
            return b // counts[i] * size + int(tables_[i][b % counts[i]])

        length = min(slot_of(i, blocks[s] - done[s] - 1) for i, s in enumerate(active)) + 1
        for i, s in enumerate(active):
            full, rest = divmod(length, size)
            n = full * counts[i] + int(np.searchsorted(tables_[i], rest))
            if n:
                rows.append({"phase": phase, "source": s, "first": done[s], "last": done[s] + n, "slot": at, "size": size, "slots": tables_[i].tolist()})
            done[s] += n
        at, phase = at + length, phase + 1
    return rows


def whole_weights(weights: list[float]) -> list[int]:
    """The weights in the same proportions, as whole numbers: nothing is rounded."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


def exact_slots(blocks: list[int], weights: list[float]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each source the slots and the phases of its blocks: earliest deadline first, from the unrounded weights."""
    whole, at, phase = whole_weights(weights), 0, 0
    slots, phases = [array("q") for _ in blocks], [array("i") for _ in blocks]
    while active := [s for s in range(len(blocks)) if len(slots[s]) < blocks[s]]:
        total = sum(whole[s] for s in active)
        done, t = dict.fromkeys(active, 0), 0
        ready = [(-(-total // whole[s]), s) for s in active]  # by deadline
        heapq.heapify(ready)
        waiting: list[tuple[int, int]] = []  # by release
        while True:
            while waiting and waiting[0][0] <= t:
                _, s = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(done[s] + 1) * total // whole[s]), s))
            _, s = heapq.heappop(ready)
            slots[s].append(at + t)
            phases[s].append(phase)
            done[s] += 1
            t += 1
            if len(slots[s]) == blocks[s]:
                break
            heapq.heappush(waiting, (done[s] * total // whole[s], s))
        at, phase = at + t, phase + 1
    return [np.array(x, np.int64) for x in slots], [np.array(x, np.int32) for x in phases]


def periodic_slots(blocks: list[int], weights: list[float], period: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same from plan()."""
    slots, phases = [[] for _ in blocks], [[] for _ in blocks]
    for r in plan(blocks, weights, period):
        k, table = np.arange(r["last"] - r["first"]), np.array(r["slots"], np.int64)
        slots[r["source"]].append(r["slot"] + k // len(table) * r["size"] + table[k % len(table)])
        phases[r["source"]].append(np.full(len(k), r["phase"], np.int32))
    return [np.concatenate(x) for x in slots], [np.concatenate(x) for x in phases]


def block_size(rows: list[int], block_docs: int, most_blocks: int) -> int:
    """Documents in a block: the last block of a source may be short, so each source takes one block off the bound."""
    return max(block_docs, -(-sum(rows) // max(most_blocks - len(rows), 1)))


def source_key(source):
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def schedule_table(spark, keys: list[str], slots: list[np.ndarray], phases: list[np.ndarray]) -> DataFrame:
    """A stored row for each block."""
    import pyarrow as pa

    schema = pa.schema([("__key", pa.string()), ("__source_block", pa.int64()), ("__slot", pa.int64()), ("__phase", pa.int32())])
    parts = [pa.table([pa.array([k] * len(x), pa.string()), np.arange(len(x)), x, p], schema=schema) for k, x, p in zip(keys, slots, phases, strict=True)]
    return store(spark.createDataFrame(pa.concat_tables(parts) if parts else schema.empty_table()), "schedule")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block_docs: int = 64, period: int | None = None, max_sources: int = 1000, most_blocks: int = 1 << 20) -> DataFrame:
    """docs with __source_block, __slot, __in_block and __phase; order by (__slot, __in_block) for the mix.

    Without weights a source's weight is the given power of its number of documents.
    """
    spark = docs.sparkSession
    new = ("__source_block", "__slot", "__in_block", "__phase")
    order = ("__key", "__doc", "__hash")
    rows = docs.select(whole_row(docs).alias("__row"), source_key(F.col("source")).alias("__key"), F.col("doc_id").alias("__doc"), row_hash(docs).alias("__hash"))
    rows = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__row", "__key", F.monotonically_increasing_id().alias("__at")), "numbered")
    part = F.shiftright("__at", 33)
    parts = rows.groupBy("__key", part.alias("__part")).agg(F.min("__at").alias("__low"), F.count("*").alias("n"))
    parts = parts.withColumn("__before", F.sum("n").over(Window.partitionBy("__key").orderBy("__part")) - F.col("n")).select("__key", "__part", (F.col("__before") - F.col("__low")).alias("__shift"))
    sizes = [(r["__key"], r["n"]) for r in rows.groupBy("__key").agg(F.count("*").alias("n")).orderBy("__key").limit(max_sources + 1).collect()]
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources or group them")
    if weights is None:
        share = [n**power for _, n in sizes]
    else:
        named = {"n" if k is None else f"s{k}": w for k, w in weights.items() if w is not None and w > 0}
        share = [named.get(k, min(named.values(), default=1.0)) for k, _ in sizes]
    block_docs = block_size([n for _, n in sizes], block_docs, most_blocks)
    blocks = [-(-n // block_docs) for _, n in sizes]
    slots, phases = exact_slots(blocks, share) if period is None else periodic_slots(blocks, share, period)
    table = schedule_table(spark, [k for k, _ in sizes], slots, phases)
    rank = F.col("__at") + F.col("__shift")
    numbered = rows.withColumn("__part", part).join(parts, ["__key", "__part"]).withColumns({"__source_block": F.floor(rank / block_docs), "__in_block": rank % block_docs})
    placed = numbered.join(table, ["__key", "__source_block"])
    return placed.select(*(F.col("__row")[c].alias(c) for c in docs.columns if c not in new), *new)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents in the order of the mix: partitions are ranges of it."""
    rows = docs.select(whole_row(docs).alias("__all"), "doc_id", "source")
    return mix_sources(rows, **how).repartitionByRange("__slot", "__in_block").sortWithinPartitions("__slot", "__in_block").select("__all.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix_sources(tables(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select("doc_id", "source", F.col("__source_block").alias("source_block"), F.col("__slot").alias("slot"), F.col("__in_block").cast("long").alias("in_block"), F.col("__phase").alias("phase"))
