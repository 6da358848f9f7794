"""Cheapest repair of the turns of conversations.

A conversation should have the roles ``(system? (user assistant)+)?``. Edits
are Delete (4; a must for blank and repeated rows), Insert of an empty user or
assistant row (3), Keep (0) and Rerole to user or assistant (3); a row that is
not deleted although its text breaks off adds 3. Among the cheapest repairs the
one whose audit, the initials of its edits in order, comes first in ASCII is
taken.

Cost DP: with four states (nothing yet, after system, after user, after
assistant) each row is a 4 x 4 matrix of costs, and rows multiply in the
(min, +) sense, so costs are a scan and need no walk along a conversation.
Conversations are cut into segments of at most SEGMENT rows. A segment's matrix
is made where its rows are; a sweep over segments, last one first, gives the
cost from each segment's end; then all arcs of a segment that lie on a cheapest
repair are known.

Prefix doubling: each such arc is ranked by its first edit, and from the ranks
by 2 ** k edits and the pointer that many edits ahead come those for 2 ** (k+1).
Ranks choose the least arc of each node, and the doubled pointers give every
edit of the chosen path at once, for each state a segment may start in. A last
sweep, first segment first, picks the state and writes the repaired rows.

A segment is cut by its place in the sorted table, so a conversation with a
third of all rows is many segments. Its rows are read in order by one task at
last, one batch in memory at a time, as their order is the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut, table

SEGMENT = 4096   # most rows of a segment
CHUNK = 1 << 15  # rows whose segments are worked on together
BLANKS = " \t\n\x0b\x0c\r"

# Costs of the edits, and their initials in ASCII order.
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
BREAKS_OFF = 3

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])  # by Insert or Rerole
FAR = 1 << 40  # more than any cost

# Codes of rows: class of the role, then flags.
ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
BLANK, REPEATED, BROKEN = 4, 8, 16
FAULTS = {BLANK: "blank", REPEATED: "duplicate", BROKEN: "truncated"}


def _closure() -> np.ndarray:
    """Cost from state to state by inserts alone."""
    out = np.full((4, 4), FAR)
    for state in range(4):
        now, cost = state, 0
        while cost < out[state, now]:
            out[state, now] = cost
            now, cost = int(NEXT[now]), cost + COST[INSERT]
    return out


INSERTS = _closure()
AT_END = np.minimum(INSERTS[:, START], INSERTS[:, ASSISTANT])


def _row_arcs(codes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(letter, target state, cost) of Delete, Keep, Rerole by row and state.

    An edit that is not allowed costs FAR.
    """
    n = len(codes)
    role = codes & 3
    worse = np.where(codes & BROKEN, BREAKS_OFF, 0)
    gone = (codes & (BLANK | REPEATED)) > 0
    delete = (np.tile(np.arange(4), (n, 1)), np.full((n, 4), COST[DELETE]))
    keep = np.full((n, 4), FAR)
    for state in range(4):
        fits = role == NEXT[state]
        if state == START:
            fits |= role == SYSTEM
        keep[:, state] = np.where(fits & ~gone, COST[KEEP] + worse, FAR)
    rerole = np.where(gone, FAR, COST[REROLE] + worse)
    return [(0, *delete),
            (2, np.repeat(role[:, None], 4, 1).astype(np.int64), keep),
            (3, np.tile(NEXT, (n, 1)), np.repeat(rerole[:, None], 4, 1))]


def row_matrices(codes: np.ndarray) -> np.ndarray:
    """Costs [row, state before, state after], inserts before the row too."""
    rows = np.arange(len(codes))[:, None]
    step = np.full((len(codes), 4, 4), FAR)
    for _, target, cost in _row_arcs(codes):
        at = (rows, np.arange(4)[None, :], target)
        step[at] = np.minimum(step[at], cost)
    return _times(np.broadcast_to(INSERTS, step.shape), step)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), FAR)


def suffix_products(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Product of the matrices from each row to the end of its segment."""
    out = row_matrices(codes)
    left = np.concatenate([np.arange(n, 0, -1) for n in lengths])
    step = 1
    while step < lengths.max():
        at = np.flatnonzero(left > step)
        out[at] = _times(out[at], out[at + step])
        step *= 2
    return out


def segment_audits(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray,
                   last: np.ndarray) -> list[tuple[list[str], list[int]]]:
    """Audit and state at the end, for each segment and state at its start.

    ``ends`` holds the cost from each state at the segment's end, ``last``
    whether the conversation ends there.
    """
    segments = len(lengths)
    # nodes: a place before each row and one after the last, by state
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    places = int(first[-1])
    segment_of_row = np.repeat(np.arange(segments), lengths)
    place = np.arange(len(codes)) + segment_of_row
    cost = np.empty((places, 4), np.int64)
    cost[place] = (suffix_products(codes, lengths)
                   + ends[segment_of_row][:, None, :]).min(2)
    cost[first[1:] - 1] = ends

    # arcs that lie on a cheapest repair: node, letter, target node
    found = []
    state = np.arange(4)[None, :]
    for letter, target, price in _row_arcs(codes):
        good = price + cost[place[:, None] + 1, target] == cost[place]
        source = (place[:, None] * 4 + state)[good]
        found.append((source, np.full(len(source), letter),
                      ((place[:, None] + 1) * 4 + target)[good]))
    inner = np.ones(places, bool)
    inner[first[1:] - 1] = last
    open_ = np.flatnonzero(inner)[:, None]
    good = COST[INSERT] + cost[open_, NEXT[None, :]] == cost[open_, state]
    source = (open_ * 4 + state)[good]
    found.append((source, np.full(len(source), 1),
                  (open_ * 4 + NEXT[None, :])[good]))
    node, letter, target = (np.concatenate(x) for x in zip(*found,
                                                           strict=True))
    arcs = len(node)  # one more stands for the end and follows itself

    def least(rank: np.ndarray) -> np.ndarray:
        """Arc of least rank that leaves each node; the end, if none does."""
        order = np.lexsort((rank[:arcs], node))
        starts = np.flatnonzero(np.diff(node[order], prepend=-1))
        out = np.full(places * 4, arcs)
        out[node[order][starts]] = order[starts]
        return out

    rank = np.append(letter + 1, 0)
    ahead = [np.append(least(rank)[target], arcs)]
    longest = 3 * int(lengths.max()) + 2  # at most two inserts for each row
    while 1 << len(ahead) <= longest:
        pair = rank * (arcs + 2) + rank[ahead[-1]]
        _, rank = np.unique(pair, return_inverse=True)
        ahead.append(ahead[-1][ahead[-1]])

    # every arc of the four chosen paths of a segment, by doubled pointers
    start = least(rank)[(first[:-1, None] * 4 + state)].ravel()
    room = np.repeat(3 * lengths + 2, 4)
    at = np.repeat(start, room)
    begin = np.concatenate(([0], np.cumsum(room)))
    number = np.arange(begin[-1]) - np.repeat(begin[:-1], room)
    for bit, pointer in enumerate(ahead):
        at = np.where(number >> bit & 1, pointer[at], at)
    real = at < arcs
    names = np.frombuffer(b"DIKR", np.uint8)
    letters = names[letter[at[real]]].tobytes().decode()
    many = np.add.reduceat(real, begin[:-1])
    stop = np.cumsum(many)
    exits = np.where(many > 0, target[at[real]][np.maximum(stop, 1) - 1] % 4,
                     np.tile(np.arange(4), segments))
    audits = [letters[e - n:e] for n, e in zip(many.tolist(), stop.tolist(),
                                               strict=True)]
    return [(audits[4 * i:4 * i + 4], exits[4 * i:4 * i + 4].tolist())
            for i in range(segments)]


# -- in Spark ----------------------------------------------------------------

def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def _sorted_rows(turns: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, numbered along the table."""
    key = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(),
           F.col("role").asc(), F.col("head").asc(), F.col("hash").asc(),
           F.col("_id").asc()]
    return cut(turns.withColumn("head", F.substring("text", 1, 100))
               .withColumn("hash", F.xxhash64("text"))
               .withColumn("_id", F.monotonically_increasing_id())
               .repartitionByRange(*key).sortWithinPartitions(*key)
               .withColumn("seq", F.monotonically_increasing_id())
               .select("seq", "conv", "turn", "role", "text"))


def _coded(rows: DataFrame) -> DataFrame:
    """(seq, conv, code) of each row, and (seq, null, -1) of first mentions."""
    kept = _trimmed(F.col("text"))
    initial = F.left("role", F.lit(1))
    code = (sum((F.when(initial == letter, of).otherwise(0)
                 for letter, of in ROLES.items()), F.lit(0))
            + F.when(kept == "", BLANK).when(
                ~F.right(kept, F.lit(1)).isin(".", "!", "?"), BROKEN)
            .otherwise(0))
    said = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role",
                                   "text"), 256))
    firsts = (rows.where(kept != "").groupBy("conv", said.alias("said"))
              .agg(F.min("seq").alias("seq")))
    return (rows.select("seq", "conv", code.cast("int").alias("code"))
            .unionByName(firsts.select("seq", "conv",
                                       F.lit(-1).alias("code"))))


def _segments(coded: DataFrame, kind: str) -> DataFrame:
    """(seq of the first row, conv, codes, matrix) of each segment."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, object, bytearray]] = []
        block = conv = mentioned = None
        n = 0

        def rows() -> pa.RecordBatch:
            lengths = np.array([len(x[2]) for x in found])
            codes = np.frombuffer(b"".join(x[2] for x in found),
                                  np.uint8).astype(np.int64)
            products = suffix_products(codes, lengths)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            batch = pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], conv_type),
                pa.array([bytes(x[2]) for x in found], pa.binary()),
                pa.array(list(products[starts].reshape(-1, 16)),
                         pa.list_(pa.int64()))],
                names=["seq", "conv", "codes", "matrix"])
            found.clear()
            return batch

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for seq, who, code in zip(*(c.to_pylist() for c in batch.columns),
                                      strict=True):
                if code < 0:  # sorted before the row that it speaks of
                    mentioned = seq
                    continue
                if block != seq // SEGMENT or who != conv:
                    if n >= CHUNK:
                        yield rows()
                        n = 0
                    block, conv = seq // SEGMENT, who
                    found.append((seq, who, bytearray()))
                if not code & BLANK and seq != mentioned:
                    code = code & ~BROKEN | REPEATED
                found[-1][2].append(code)
                n += 1
        if found:
            yield rows()

    block = F.expr(f"seq div {SEGMENT}")
    return (coded.repartition(block).sortWithinPartitions("seq", "code")
            .select("seq", "conv", "code").mapInArrow(
        collect, f"seq long, conv {kind}, codes binary, matrix array<long>"))


def _with_audits(segments: DataFrame, kind: str) -> DataFrame:
    """Add, for each state at a segment's start, its audit and last state."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        n, end, conv, begun = 0, AT_END, None, False

        def rows() -> pa.RecordBatch:
            done = segment_audits(
                np.frombuffer(b"".join(x["codes"] for x in found),
                              np.uint8).astype(np.int64),
                np.array([len(x["codes"]) for x in found]),
                np.array([x["end"] for x in found]),
                np.array([x["last"] for x in found]))
            batch = pa.RecordBatch.from_arrays([
                pa.array([x["seq"] for x in found], pa.int64()),
                pa.array([x["conv"] for x in found], conv_type),
                pa.array([x["codes"] for x in found], pa.binary()),
                pa.array([d[0] for d in done], pa.list_(pa.string())),
                pa.array([d[1] for d in done], pa.list_(pa.int32()))],
                names=["seq", "conv", "codes", "audits", "exits"])
            found.clear()
            return batch

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for row in batch.to_pylist():
                last = not begun or row["conv"] != conv
                begun, conv = True, row["conv"]
                row["last"] = last
                row["end"] = AT_END if last else end
                matrix = np.array(row["matrix"]).reshape(4, 4)
                end = (matrix + row["end"][None, :]).min(1)
                found.append(row)
                n += len(row["codes"])
                if n >= CHUNK:
                    yield rows()
                    n = 0
        if found:
            yield rows()

    return (segments.repartition("conv")
            .sortWithinPartitions("conv", F.desc("seq")).mapInArrow(
        sweep, f"seq long, conv {kind}, codes binary, "
        "audits array<string>, exits array<int>"))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """All rows of the conversations with their edits, and inserted rows.

    Returns conv, ``edit`` (D, I, K or R), ``fault`` (blank, duplicate,
    truncated or null), ``turn``, ``old_role``, ``role`` and ``text``. Deleted
    rows have no ``role``; inserted ones no ``turn`` and ``old_role``, and an
    empty text. All rows of a conversation are in one partition, in order.

    Rows go by turn, those without one first; rows of the same turn by role and
    text (its first 100 characters, then a hash), so equal rows are neighbours.
    A null role or text is one space. Rows with a null conversation are one
    conversation. A row is blank without a character that is no ASCII blank; it
    is a duplicate if role and text came before; it is truncated if its last
    such character is none of ``.!?``. A role counts by its initial s, u or a;
    other roles, and empty ones, can't be kept. Other columns are left out.
    """
    kind = turns.schema[conv].dataType.simpleString()
    when = turns.schema[turn].dataType.simpleString()
    space = F.lit(" ")
    rows = _sorted_rows(turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text")))
    pieces = _with_audits(_segments(_coded(rows), kind), kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv_now, begun = START, None, False
        audit, codes, at, row, exits = "", b"", 0, 0, START
        names = ["user", "assistant"]

        for batch in batches:
            out: list[list] = [[] for _ in range(7)]

            def put(*values: object, out: list[list] = out) -> None:
                for column, value in zip(out, values, strict=True):
                    column.append(value)

            for got in batch.to_pylist():
                if got["codes"] is not None:
                    if not begun or got["conv"] != conv_now:
                        state = START
                    begun, conv_now = True, got["conv"]
                    audit, exits = got["audits"][state], got["exits"][state]
                    codes, at, row = got["codes"], 0, 0
                    continue
                while True:
                    edit = audit[at]
                    at += 1
                    if edit != INSERT:
                        break
                    put(conv_now, INSERT, None, None, None,
                        names[state == USER], "")
                    state = int(NEXT[state])
                code = codes[row]
                row += 1
                new = None
                if edit == KEEP:
                    new, state = got["role"], code & 3
                elif edit == REROLE:
                    new, state = names[state == USER], int(NEXT[state])
                put(conv_now, edit, FAULTS.get(code & ~3), got["turn"],
                    got["role"], new, got["text"])
                if row == len(codes):
                    for _ in audit[at:]:
                        put(conv_now, INSERT, None, None, None,
                            names[state == USER], "")
                        state = int(NEXT[state])
                    state = exits
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], batch.schema.field("conv").type),
                     *[pa.array(c, pa.string()) for c in out[1:3]],
                     pa.array(out[3], batch.schema.field("turn").type),
                     *[pa.array(c, pa.string()) for c in out[4:]]],
                    names=["conv", "edit", "fault", "turn", "old_role",
                           "role", "text"])

    both = pieces.unionByName(rows, allowMissingColumns=True)
    return (both.repartition("conv")
            .sortWithinPartitions("conv", "seq", F.col("codes").isNull())
            .mapInArrow(write, f"conv {kind}, edit string, fault string, "
                               f"turn {when}, old_role string, role string, "
                               "text string")
            .withColumnRenamed("conv", conv))


def report(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of what ``repair`` returned, read as it lies.

    gaps, the three faults, illegal, cost, audit and repaired_sha256. It reads
    each partition in order and must come straight after ``repair``.
    """
    kind = repaired.schema[conv].dataType.simpleString()
    counts = ["gaps", *FAULTS.values(), "illegal", "cost"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_now, begun, pair, found = None, False, "", {}
        audit: list[str] = []
        digest = hashlib.sha256()
        low = high = None
        distinct = lines = 0

        def row() -> list:
            values = found | {"gaps": 0 if low is None
                              else high - low + 1 - distinct}
            return [conv_now, *[values[c] for c in counts], "".join(audit),
                    digest.hexdigest()]

        for batch in batches:
            out = []
            for got in batch.to_pylist():
                if not begun or got["conv"] != conv_now:
                    if begun:
                        out.append(row())
                    begun, conv_now, pair = True, got["conv"], None
                    found, audit = dict.fromkeys(counts, 0), []
                    digest, low, high = hashlib.sha256(), None, None
                    distinct = lines = 0
                edit, fault, when = got["edit"], got["fault"], got["turn"]
                audit.append(edit)
                found["cost"] += COST[edit]
                if edit != INSERT:
                    if pair is not None and pair + got["old_role"][:1] not in (
                            "su", "ua", "au"):
                        found["illegal"] += 1
                    pair = got["old_role"][:1]
                    if fault:
                        found[fault] += 1
                        if edit != DELETE and fault == FAULTS[BROKEN]:
                            found["cost"] += BREAKS_OFF
                    if when is not None:
                        low = when if low is None else low
                        distinct += when != high
                        high = when
                if edit != DELETE:
                    line = f"{got['role']}:{got['text']}"
                    digest.update(("\n" * bool(lines) + line).encode(
                        "utf-8", "surrogatepass"))
                    lines += 1
            if out:
                yield batch_of(out, batch.schema.field("conv").type)
        if begun:
            yield batch_of([row()], batch.schema.field("conv").type)

    def batch_of(rows: list[list], conv_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], conv_type),
             *[pa.array(c, pa.int64()) for c in columns[1:-2]],
             *[pa.array(c, pa.string()) for c in columns[-2:]]],
            names=["conv", *counts, "audit", "repaired_sha256"])

    return repaired.withColumnRenamed(conv, "conv").mapInArrow(
        read, f"conv {kind}, {', '.join(f'{c} long' for c in counts)}, "
        "audit string, repaired_sha256 string").withColumnRenamed("conv", conv)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults by crc32(``conv_id:turn``) % 20.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4
    makes its role user. A null role, text or part of the key is one space.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space)
                             for c in ("conv_id", "turn")])
    text, role = (F.coalesce(F.col(c), space) for c in ("text", "role"))
    fault = F.col("fault")
    return (turns.select("conv_id", "turn", role.alias("role"),
                         text.alias("text"),
                         (F.crc32(key) % 20).cast("int").alias("fault"))
            .where(fault != 0)
            .withColumn("text", F.when(fault == 1, "").when(
                fault == 2, F.translate("text", ".!?", ""))
                .otherwise(F.col("text")))
            .withColumn("role", F.when(fault == 4, "user")
                        .otherwise(F.col("role")))
            .withColumn("_", F.explode(F.when(fault == 3, F.array(
                F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", "role", "text"))


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults, cheapest repair and its digest for every conversation."""
    turns = table(spark, sf, "conversations")
    found = report(repair(damaged(turns))).withColumnRenamed("conv_id", "_id")
    every = turns.select("conv_id").distinct()
    met = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return met.select("conv_id", *[
        F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c)
        for c in found.columns[1:]])
