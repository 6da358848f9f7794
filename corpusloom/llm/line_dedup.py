"""Removal of repeated and nearly repeated lines, in DataFrame functions.

Lines are normalised and hashed; equal ones are one class. Each class gets a
64-bit SimHash of its distinct words; if each occurrence counted, the few very
common words of a language would make all of its long lines alike. Two lines
whose SimHashes differ in at most DISTANCE bits agree in two of DISTANCE + 2
blocks (pigeonhole), so classes meet on pairs of blocks.

One changed word turns many bits of a short line's SimHash. Lines of SHORT to
LONG words are therefore also cut into two or three parts by words: if fewer
words are changed than there are parts, one part is left as it was, and classes
meet on equal parts (pigeonhole again). There SimHashes only have to be within
FAR bits.

Classes that meet are verified by the edit similarity of their texts; of each
connected group one occurrence stays.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import (components, counted, cut, free_name,
                                   may_be_in, table)

DISTANCE = 3
SIMILARITY = 0.9
SHORT, LONG = 6, 400  # words of the lines that meet on equal parts too
THIRDS = 12           # words from which on a line has three parts, not two
FAR = 20              # bits; lines that share but half their words are farther
FILTER_WORDS = 1 << 19
BLANKS = " \t\x0B\f\r"
_LONG = 32_768  # words; counters of 16 bits hold less
_BOUNDS = [64 * i // (DISTANCE + 2) for i in range(DISTANCE + 3)]


PAIRS = (DISTANCE + 2) * (DISTANCE + 1) // 2  # of blocks


def _block_masks() -> list[int]:
    """Bits of each pair of blocks, as signed numbers."""
    sums = [sum((1 << _BOUNDS[i + 1]) - (1 << _BOUNDS[i]) for i in pair)
            for pair in combinations(range(DISTANCE + 2), 2)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def normalised(line: Column) -> Column:
    """Lower case, runs of blanks as one space, none at the ends."""
    # most lines have none, and a plain search is much faster than the pattern
    runs = F.contains(line, F.lit("  "))
    for blank in BLANKS[1:]:
        runs |= F.contains(line, F.lit(blank))
    return F.lower(F.trim(F.when(runs, F.regexp_replace(
        line, r"[\t\x0B\f\r ]{2,}|[\t\x0B\f\r]", " ")).otherwise(line)))


def _counts(x: str, lanes: int) -> list[str]:
    """The bits of x, ``lanes`` of them to a number, a counter each.

    Number g has bits g, g + width, g + 2 * width and so on, so sums of these
    numbers count how often each bit is set.
    """
    width = 64 // lanes
    mask = sum(1 << width * i for i in range(lanes))
    return [f"(shiftrightunsigned({x}, {g}) & {mask}L)" for g in range(width)]


def _majority(sums: list[str], n: str, lanes: int) -> str:
    """64 bits, each set if more than half of n counted ones were."""
    width = 64 // lanes
    return " | ".join(
        f"shiftleft(cast(2 * (shiftrightunsigned({s}, {width * lane}) & "
        f"{(1 << width) - 1}L) > {n} as bigint), {g + width * lane})"
        for g, s in enumerate(sums) for lane in range(lanes))


def _long_simhash(words: str) -> Column:
    """SimHash of an array of any length, without a shuffle."""
    sums = ", ".join(f"aggregate({words}, 0L, (a, w) -> a + {c})"
                     for c in _counts("xxhash64(w)", 2))
    bits = _majority([f"s[{g}]" for g in range(32)], f"size({words})", 2)
    # a lambda over one element names the sums, so they are made once
    return F.expr(f"transform(array(array({sums})), s -> {bits})[0]")


def _parts(words: str) -> Column:
    """Hashes of the parts of a line by words, none of very short ones."""
    n, third, half = (f"size({words}){x}" for x in ("", " div 3", " div 2"))

    def part(i: int, start: str, many: str) -> str:
        return (f"xxhash64({i}, slice({words}, cast({start} as int), "
                f"cast({many} as int)))")

    three = [part(1, "1", third), part(2, f"{n} - {third} + 1", third),
             part(3, f"{third} + 1", f"{n} - 2 * ({third})")]
    two = [part(4, "1", half), part(5, f"{n} - {half} + 1", half)]
    return F.expr(
        f"case when {n} between {THIRDS} and {LONG} then "
        f"array({', '.join(three)}) when {n} between {SHORT} and {THIRDS - 1} "
        f"then array({', '.join(two)}) else cast(array() as array<bigint>) end")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that are not blank: row, key, line_no (from 0), norm, hash."""
    return (docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
        # a filter on the normalised line would normalise it once more
        .where(F.btrim("line", F.lit(BLANKS)) != "")
        .select("row", "key", "line_no", normalised(F.col("line"))
                .alias("norm"))
        .withColumn("hash", F.xxhash64("norm")))


def _with_simhash(lines: DataFrame) -> DataFrame:
    """Row per line: key, line_no, hash, len, sim, parts."""
    split = (lines.withColumn("all", F.split("norm", " "))
             .withColumn("words", F.array_distinct("all"))
             .withColumn("parts", _parts("all")).drop("all"))
    far = F.when(F.size("words") >= _LONG, _long_simhash("words"))
    near = F.when(F.size("words") < _LONG, F.col("words")).otherwise(
        F.array(F.lit("")))
    ids = ["row", "key", "line_no", "hash", "len", "far", "parts"]
    sums = [F.sum(F.expr(c)).alias(f"s{g}")
            for g, c in enumerate(_counts("x", 4))]
    summed = (split.withColumn("far", far)
              .withColumn("len", F.length("norm"))
              .select(*ids, F.explode(near).alias("word"))
              .select(*ids, F.xxhash64("word").alias("x"))
              .groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), *sums))
    return summed.select(
        "key", "line_no", "hash", "len", "parts", F.coalesce("far", F.expr(
            _majority([f"s{g}" for g in range(16)], "n", 4))).alias("sim"))


def _blocks(classes: DataFrame) -> DataFrame:
    """Row per class and pair of blocks: sign, place, hash, sim, len. The parts
    of a line have the places from PAIRS on."""
    signs = F.array(*[F.xxhash64(F.lit(i), F.col("sim").bitwiseAND(F.lit(m)))
                      for i, m in enumerate(_block_masks())])
    return classes.select("hash", "sim", "len", F.posexplode(
        F.concat(signs, "parts")).alias("place", "sign"))


def _most_edits(one: str, two: str, similarity: float) -> str:
    return f"cast(floor({1 - similarity:.6f} * greatest({one}, {two})) as int)"


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str,
              similarity: float) -> DataFrame:
    """Pairs (a, b) of classes with at least so much edit similarity."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("hash"))
                 .distinct())
    texts = may_be_in(lines_of(docs, key, text).select("hash", "norm"),
                      "hash", wanted).groupBy("hash").agg(
        F.max("norm").alias("norm"))
    texts = cut(texts.join(wanted, "hash"))
    most = _most_edits("length(ta)", "length(tb)", similarity)
    # edits word by word are enough edits, and quickly counted; only if they
    # are too many, or the words not as many, the least number is sought
    by_words = ("aggregate(zip_with(split(ta, ' '), split(tb, ' '), (x, y) -> "
                "if(x = y, 0, levenshtein(x, y))), 0, (n, d) -> n + d)")
    return cut(pairs.join(texts.toDF("a", "ta"), "a")
               .join(texts.toDF("b", "tb"), "b")
               .where(f"abs(length(ta) - length(tb)) <= {most}")
               .where(f"{by_words} <= {most} or "
                      f"levenshtein(ta, tb, {most}) >= 0")
               .select("a", "b"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   similarity: float = SIMILARITY) -> DataFrame:
    """Row per line of a group: key, line_no, keep_id, keep_line, removed.

    Lines end at a line feed. A group has lines that are equal after
    normalisation, or whose SimHashes differ in at most DISTANCE bits and whose
    edit distance is at most 1 - similarity of the longer length; and all that
    are connected by such links. So has a line with an equal part and that edit
    distance; in a part that many lines share, each is compared with one of
    them only. The occurrence with the smallest (key,
    line_no) stays. Lines without a partner, blank lines and null or empty
    texts give no row. A row with a null key takes part and comes first; rows
    that repeat a key and have the line at the same place are not told apart,
    so they stay or go together. Two different lines of a corpus of a billion
    lines share a 64-bit hash, and are then taken as equal, with a chance of 3
    percent.
    """
    rows = cut(_with_simhash(lines_of(docs, key, text)))
    classes = cut(rows.groupBy("hash").agg(
        F.min("sim").alias("sim"), F.min("len").alias("len"),
        F.min("parts").alias("parts"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("key", "line_no")).alias("first")))
    signs = _blocks(classes)
    shared = cut(signs.groupBy("sign").agg(
        F.count(F.lit(1)).alias("size"), F.min("hash").alias("a"),
        F.max("hash").alias("b"),
        (F.min("place") >= PAIRS).alias("part")).where("a < b"))
    hubs = shared.where("size > 2").select("sign", "a", "part")
    members = cut(may_be_in(signs, "sign", hubs, FILTER_WORDS)
                  .join(hubs, "sign"))
    sims = classes.select("hash", "sim", "len")
    stars = cut(shared.where("size = 2").select("a", "b", "part").union(
        members.where("hash <> a").select("a", "hash", "part"))
        .groupBy("a", "b").agg(F.max("part").alias("part"))
        .join(sims.toDF("a", "xa", "la"), "a")
        .join(sims.toDF("b", "xb", "lb"), "b")
        .where(f"bit_count(xa ^ xb) <= if(part, {FAR}, {DISTANCE}) and "
               "abs(la - lb) <= " + _most_edits("la", "lb", similarity))
        .select("a", "b"))
    links = _verified(stars, docs, key, text, similarity)
    label = components(links)
    open_, n_open = counted(_open_pairs(members.where(~F.col("part")), label,
                                        stars, similarity))
    if n_open:
        label = components(links.union(_verified(open_, docs, key, text,
                                                 similarity)))
    named = (classes.join(label, F.col("hash") == F.col("node"), "left")
             .withColumn("component", F.coalesce("component", "hash")))
    groups = named.groupBy("component").agg(
        F.sum("n").alias("lines"), F.min("first").alias("keep")).where(
        "lines > 1")
    kept = cut(named.join(groups, "component").select("hash", "keep"))
    found = may_be_in(rows.select("key", "line_no", "hash"), "hash", kept,
                      FILTER_WORDS).join(kept, "hash")
    return found.select(
        F.col("key").alias(key), "line_no", F.col("keep.key")
        .alias("keep_id"), F.col("keep.line_no").alias("keep_line"),
        (~(F.col("key").eqNullSafe(F.col("keep.key"))
           & (F.col("line_no") == F.col("keep.line_no")))).alias("removed"))


def _open_pairs(members: DataFrame, label: DataFrame, stars: DataFrame,
                similarity: float) -> DataFrame:
    """Close pairs in blocks that still hold different components.

    A pair is made in the first pair of blocks that it agrees in alone.
    """
    named = cut(members.select("sign", "place", "hash", "sim", "len").join(
        label.withColumnRenamed("node", "hash"), "hash", "left")
        .withColumn("component", F.coalesce("component", "hash")))
    open_ = (named.groupBy("sign").agg(F.min("component").alias("lo"),
                                       F.max("component").alias("hi"))
             .where("lo < hi").select("sign"))
    rest = cut(named.join(open_, "sign"))
    first = " ".join(f"when (x.sim ^ y.sim) & {m}L = 0 then {i}"
                     for i, m in enumerate(_block_masks()))
    pairs = rest.alias("x").join(rest.alias("y"), F.expr(
        "x.sign = y.sign and x.hash < y.hash and x.component <> y.component "
        f"and bit_count(x.sim ^ y.sim) <= {DISTANCE} "
        f"and abs(x.len - y.len) <= {_most_edits('x.len', 'y.len', similarity)} "
        f"and x.place = case {first} end")).select(
        F.col("x.hash").alias("a"), F.col("y.hash").alias("b"))
    return pairs.join(stars, ["a", "b"], "left_anti")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text"
                    ) -> DataFrame:
    """``docs`` with the removed lines taken out of the texts."""
    gone = (repeated_lines(docs, key, text).where("removed").groupBy(key)
            .agg(F.collect_set("line_no").alias("_gone"))
            .withColumnRenamed(key, "_key"))
    lines = free_name(docs.columns, "_lines")
    left = docs.join(gone, F.col(key).eqNullSafe(F.col("_key")), "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.coalesce(
        F.array_contains("_gone", i), F.lit(False)))
    return (left.withColumn(lines, F.array_join(kept, "\n"))
            .select(*[F.col(lines).alias(text) if c == text else F.col(c)
                      for c in docs.columns]))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines(table(spark, sf, "documents"))
