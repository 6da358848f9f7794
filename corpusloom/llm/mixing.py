"""Mixing of sources to target weights by a Pfair schedule.

Time is cut into slots of one block of documents. Block j (from 1) of a source
with weight w of the total is released at slot floor((j - 1) / w) and due by
slot ceil(j / w). Taking in each slot the released block that is due first
keeps every source within less than one block of its weight at any time. As
weights are whole shares of a cycle, the schedule repeats after one cycle: it
is worked out once for a cycle and joined to the documents.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut, ranked, slim, table, widened

BLOCK_DOCS = 4
CYCLE = 1_000         # slots in a cycle, the resolution of the weights
MAX_SOURCES = 10_000  # each has at least one slot in a cycle
_LOT = 1_000


def cycle_slots(shares: dict[str | None, int]) -> list[tuple]:
    """Schedule of one cycle: (source, its block in the cycle, slot), from 0.

    ``shares`` are whole numbers of blocks per cycle, at least one; the cycle
    has as many slots as their sum. Ties go to the larger share, then by name.
    """
    cycle = sum(shares.values())
    # release and deadline of all blocks; every slot gets exactly one
    waiting: dict[int, list[tuple]] = {}
    for name, share in shares.items():
        for j in range(share):
            due = -(-(j + 1) * cycle // share)
            waiting.setdefault(j * cycle // share, []).append(
                (due, -share, name is not None, name or "", j))
    ready, slots = [], []
    for slot in range(cycle):
        for block in waiting.get(slot, []):
            heapq.heappush(ready, block)
        due, _, known, name, j = heapq.heappop(ready)
        assert slot < due, "a block missed its deadline"
        slots.append((name if known else None, j, slot))
    return slots


def target_shares(counts: dict[str | None, int], power: float,
                  cycle: int = CYCLE) -> dict[str | None, int]:
    """Shares of a cycle in proportion to count ** power, each at least one.

    power 1 keeps the natural mix, below 1 lifts small sources, 0 is uniform.
    Left-over slots go by largest remainder, then by name.
    """
    names = sorted(counts, key=lambda n: (n is not None, n or ""))
    cycle = max(cycle, len(names))
    raw = [counts[n] ** power for n in names]
    free, total = cycle - len(names), sum(raw)
    exact = [free * r / total for r in raw]
    shares = [1 + int(e) for e in exact]
    order = sorted(range(len(names)),
                   key=lambda i: (int(exact[i]) - exact[i], i))
    for i in order[:cycle - sum(shares)]:
        shares[i] += 1
    return dict(zip(names, shares, strict=True))


def mix(docs: DataFrame, power: float = 0.9,
        weights: dict[str | None, float] | None = None,
        key: str = "doc_id", source: str = "source",
        block: int = BLOCK_DOCS) -> DataFrame:
    """Rows of ``docs`` with position (from 0), epoch and slot in the mix.

    Targets are ``weights`` by source (others get none and raise), else
    counts ** power. The mix goes on until every document of every source has
    had its place once; sources with too few documents for their weight begin
    again (epoch 1, 2, ...). So no row is dropped, and rows of small sources
    repeat. Every block is full, so positions have no gap. Within a source the
    order is that of the key, slice by slice of a key hash. A null source is a
    source of its own; rows that repeat a key are placed like any others; an empty table gives an empty mix. Columns of
    ``docs`` that already have one of the new names are replaced.
    """
    docs = docs.drop("position", "epoch", "slot")
    spark, named = docs.sparkSession, {"key": key, "source": source}
    rows = slim(docs, named)
    found = (rows.groupBy(F.col("source").alias("name"))
             .agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1)
             .collect())
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = {r["name"]: r["n"] for r in found}
    sizes, schedule, cycle = _plan(counts, power, weights, block)
    sizes = spark.createDataFrame(
        sizes, "_name string, _n long, _share long, _blocks long")
    schedule = spark.createDataFrame(
        schedule, "_slot_of string, _j long, _at long")
    # the schedule is made of keys; whole rows, equal ones told apart by number,
    # move once to their places
    tied = rows.withColumn("_tie", F.xxhash64("*")).withColumn(
        "_more", F.xxhash64(F.lit(1), *rows.columns))
    light = cut(tied.select("key", "source", "_tie", "_more"))
    equal = Window.partitionBy("_tie", "_more")
    # a source's blocks have _blocks * block places, which its documents fill
    # again and again; two steps keep each array short
    last = F.expr(f"(_blocks * {block} - 1 - _rank) div _n")
    placed = (
        ranked(light, "source", ["key", "_tie", "_more"], name="_rank")
        .withColumn("_copy", F.row_number().over(equal.orderBy("_rank")))
        .join(F.broadcast(sizes), F.col("source").eqNullSafe(F.col("_name")))
        .withColumn("_last", last)
        .withColumn("_lot", F.explode(F.expr(
            f"sequence(0L, _last div {_LOT})")))
        .withColumn("epoch", F.explode(F.expr(
            f"sequence(_lot * {_LOT}, "
            f"least(_last, _lot * {_LOT} + {_LOT - 1}))")))
        .withColumn("_place", F.col("_rank") + F.col("epoch") * F.col("_n"))
        .withColumn("_block", F.expr(f"_place div {block}"))
        .join(F.broadcast(schedule),
              F.col("source").eqNullSafe(F.col("_slot_of"))
              & (F.expr("_block % _share") == F.col("_j")))
        .withColumn("slot", F.expr(f"_block div _share * {cycle} + _at"))
        .withColumn("position", F.expr(
            f"slot * {block} + _place % {block}"))
        .select(F.col("_tie").alias("_t"), F.col("_more").alias("_m"),
                F.col("_copy").alias("_c"), "position", "epoch", "slot"))
    whole = tied.withColumn("_copy", F.row_number().over(equal.orderBy(
        F.lit(1))))
    # a difference is no join key, so both sides stay where the window put them
    placed = whole.join(placed, F.expr(
        "_tie = _t and _more = _m and _copy - _c = 0"))
    return widened(placed, docs.columns, named, "position", "epoch", "slot")


def _plan(counts: dict, power: float, weights: dict | None, block: int):
    """Per source (name, documents, share, blocks), the cycle, its length."""
    if not counts:
        return [], [], 1
    if weights is None:
        shares = target_shares(counts, power)
    else:
        lost = [n for n in counts if weights.get(n, 0) <= 0]
        if lost:
            raise ValueError(f"no weight for sources {lost[:5]}")
        shares = target_shares({n: weights[n] for n in counts}, 1.0)
    slots, cycle = cycle_slots(shares), sum(shares.values())
    at: dict = {}
    for name, _, slot in slots:
        at.setdefault(name, []).append(slot)
    # the mix ends with the block that brings the last unseen document
    end = 0
    for name, n in counts.items():
        turns, rest = divmod(-(-n // block) - 1, shares[name])
        end = max(end, turns * cycle + at[name][rest] + 1)
    whole, rest = divmod(end, cycle)
    sizes = [(name, n, shares[name],
              whole * shares[name] + bisect_left(at[name], rest))
             for name, n in counts.items()]
    return sizes, slots, cycle


def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Whole mix: a row per place, with the document that stands there."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return mix(docs).select("position", "slot", "epoch", "source", "doc_id")
