"""Best-fit packing of documents into sequences by linear grouping.

Large pieces are sorted by length and cut into groups of equal number; each
counts as long as the longest of its group. For these few sizes, sequences are
filled by configurations found by dynamic programming, each used as often as
its sizes last. Then the real pieces take the places of their group, and small
pieces go, longest first, where they leave the least room.

Only histograms over lengths reach the driver: at most ``capacity`` numbers,
however many documents there are. The plan is a list of runs of places; each
piece finds its place by its rank, so no task holds a group.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut, in_pieces, ranked, table
from corpusloom.llm.tokenize import encoder

CAPACITY = 2048
GROUPS = 128
SMALL = 256   # longer pieces are large
END_ID = 0


def cut_pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; all but the first one are full."""
    n = len(ids)
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, path: str, key: str = "doc_id",
              text: str = "text", capacity: int = CAPACITY,
              keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: key, piece, start, length, ids_crc32.

    Each document is its ids and the end id; a null text is the end id alone.
    ``keep_ids`` adds the ids themselves as little-endian bytes.
    """
    schema = (f"{key} {docs.schema[key].dataType.simpleString()}, piece int, "
              "start long, length long, ids_crc32 long")
    schema += ", ids binary" if keep_ids else ""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in in_pieces(batches):
            rows = []
            for doc, body in zip(batch.iloc[:, 0], batch.iloc[:, 1],
                                 strict=True):
                ids = np.append(encode(body) if body else [], END_ID)
                ids = ids.astype("<u4")
                for i, (start, size) in enumerate(cut_pieces(ids, capacity)):
                    part = ids[start:start + size].tobytes()
                    rows.append((doc, i, start, size, zlib.crc32(part))
                                + ((part,) if keep_ids else ()))
            yield pd.DataFrame(rows, columns=[
                key, "piece", "start", "length", "ids_crc32"]
                + (["ids"] if keep_ids else []), dtype=object)

    return docs.select(key, text).mapInPandas(pieces, schema)


def grouped_sizes(counts: dict[int, int], groups: int
                  ) -> list[tuple[int, int]]:
    """(rounded size, number) of large pieces, longest first.

    The pieces, sorted by length, fall into groups of equal number; groups
    with the same longest piece are one.
    """
    total = sum(counts.values())
    per_group, sizes, seen, done = -(-total // groups), [], 0, 0
    for length in sorted(counts, reverse=True):
        seen += counts[length]
        while done < total and done < seen:  # a group begins at this length
            n = min(per_group, total - done)
            if sizes and sizes[-1][0] == length:
                sizes[-1] = (length, sizes[-1][1] + n)
            else:
                sizes.append((length, n))
            done += n
    return sizes


def _fill(sizes: list[int], left: list[int], first: int, capacity: int
          ) -> list[int]:
    """Indices of the sizes for one sequence that holds size ``first``.

    Dynamic programming over the room that is left: the fullest sequence that
    the remaining sizes allow.
    """
    room = capacity - sizes[first]
    open_ = [k for k in range(len(sizes)) if left[k] > (k == first)
             and sizes[k] <= room]
    best = np.full(room + 1, -1, np.int64)  # the size that reaches a sum
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    edge = np.array([0])
    while open_ and len(edge):
        new = []
        for k in open_:
            sums = edge[edge <= room - sizes[k]] + sizes[k]
            sums = sums[~reached[sums]]
            reached[sums] = True
            best[sums] = k
            new.append(sums)
        edge = np.concatenate(new)
    at, chosen = int(np.flatnonzero(reached)[-1]), [first]
    while at:
        chosen.append(int(best[at]))
        at -= sizes[chosen[-1]]
    if all(chosen.count(k) <= left[k] for k in set(chosen)):
        return chosen
    chosen, spare = [first], left.copy()  # few are left of one: greedily
    spare[first] -= 1
    for k in open_:
        while spare[k] and sizes[k] <= room:
            chosen.append(k)
            spare[k] -= 1
            room -= sizes[k]
    return chosen


def configurations(sizes: list[tuple[int, int]], capacity: int
                   ) -> tuple[np.ndarray, int]:
    """Runs (from, each, sequence) over pieces by rank, and the sequences used.

    Pieces are numbered longest first. From ``from`` on, each ``each`` pieces
    go to one sequence, the first to ``sequence``.
    """
    size, left = [s for s, _ in sizes], [n for _, n in sizes]
    at = [0, *np.cumsum(left).tolist()]
    runs, sequence = [], 0
    for first in range(len(size)):
        while left[first]:
            chosen = _fill(size, left, first, capacity)
            each = {k: chosen.count(k) for k in chosen}
            times = min(left[k] // n for k, n in each.items())
            for k, n in each.items():
                runs.append((at[k], n, sequence))
                at[k] += n * times
                left[k] -= n * times
            sequence += times
    return np.array(sorted(runs), np.int64).reshape(-1, 3), sequence


def best_fit(counts: dict[int, int], room: dict[int, int], capacity: int
             ) -> tuple[np.ndarray, int]:
    """Runs (from, room, place) over small pieces, and the sequences added.

    ``room`` counts sequences by the room they have. From rank ``from`` on,
    one piece each goes to the sequences of that room, in order of their place
    among these. Added sequences are those of room ``capacity + 1``.
    """
    spare: dict[int, list] = defaultdict(list)  # room now: (room, from, to)
    for free, n in room.items():
        spare[free].append((free, 0, n))
    runs, at, added = [], 0, 0
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            fit = min((f for f in spare if f >= length and spare[f]),
                      default=None)
            if fit is None:
                n = -(-todo // (capacity // length))
                spare[capacity].append((capacity + 1, added, added + n))
                added += n
                continue
            kind, low, high = spare[fit].pop()
            n = min(todo, high - low)
            runs.append((at, kind, low))
            if low + n < high:
                spare[fit].append((kind, low + n, high))
            if fit > length:
                spare[fit - length].append((kind, low, low + n))
            at += n
            todo -= n
    return np.array(runs, np.int64).reshape(-1, 3), added


def _with_run(df: DataFrame, runs: np.ndarray, schema: str) -> DataFrame:
    """Add the run that each row's ``order`` falls in, as columns."""
    names = [c.split()[0] for c in schema.split(",")]
    shared = df.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf(schema)
    def find(order: pd.Series) -> pd.DataFrame:
        runs = shared.value
        hit = np.searchsorted(runs[:, 0], order.to_numpy(), "right") - 1
        return pd.DataFrame(runs[hit], columns=names)

    return df.withColumn("_run", find("order")).select("*", "_run.*").drop(
        "_run")


def _ordered(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Number pieces 0..n-1, longest first, as ``order``."""
    starts, at = [], 0
    for length in sorted(counts, reverse=True):
        starts.append((length, at))
        at += counts[length]
    first = pieces.sparkSession.createDataFrame(
        starts, "_length long, _first long")
    # a row for each length, so at most capacity rows
    return (ranked(pieces, "length", ["_row"], name="_rank")
            .join(F.broadcast(first), F.col("length") == F.col("_length"))
            .withColumn("order", F.col("_first") + F.col("_rank"))
            .drop("_length", "_first", "_rank"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS,
         small: int = SMALL) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` up to capacity.

    Sequences are numbered from 0 and filled without gaps from offset 0; none
    is longer than ``capacity``. Pieces that are alike in all columns are
    packed like any others. An empty table gives an empty result.
    """
    pieces = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in
              pieces.groupBy("length").count().collect()}  # <= capacity rows
    large = {k: n for k, n in counts.items() if k > small}
    little = {k: n for k, n in counts.items() if k <= small}
    slim = pieces.select("_row", "length")

    runs, used = configurations(grouped_sizes(large, groups), capacity)
    big = _ordered(slim.where(F.col("length") > small), large)
    if len(runs):
        big = _with_run(big, runs, "at long, each long, first long")
    else:
        big = big.selectExpr("*", "0L at", "1L each", "0L first")
    big = cut(big.select("_row", "length", F.expr(
        "first + (order - at) div each").alias("sequence_id")))

    rooms = (big.groupBy("sequence_id").agg(F.sum("length").alias("_used"))
             .select("sequence_id", (F.lit(capacity) - F.col("_used"))
                     .alias("room")).where("room > 0"))
    rooms = cut(rooms)
    room = {r[0]: r[1] for r in rooms.groupBy("room").count().collect()}
    runs, _ = best_fit(little, room, capacity)
    tiny = _ordered(slim.where(F.col("length") <= small), little)
    if len(runs):
        tiny = _with_run(tiny, runs, "at long, kind long, low long")
    else:
        tiny = tiny.selectExpr("*", "0L at", "0L kind", "0L low")
    tiny = tiny.withColumn("place", F.col("low") + F.col("order")
                           - F.col("at"))
    seats = ranked(rooms, "room", ["sequence_id"], name="seat")
    tiny = tiny.join(seats, (F.col("kind") == F.col("room"))
                     & (F.col("place") == F.col("seat")), "left").select(
        "_row", "length", F.coalesce("sequence_id", F.lit(used)
                                     + F.col("place")).alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy("_row").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = big.unionByName(tiny).withColumn(
        "offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return pieces.join(placed.drop("length"), "_row").drop("_row")


def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf, "documents")
    return pack(tokenized(docs, public_tokenizers.path("byte_bpe_50k.json")))
