"""Periodic runs of words in texts, and texts with each run cut to one period.

A run is a stretch of consecutive words with smallest period q, so that words q
apart are equal, of at least max(12, 2q) words, which no neighbouring word
extends. Runs are found by descending-LCP Kruskal: the suffixes of a text start
as classes of their own, neighbours of the suffix array are united in order of
falling longest common prefix (LCP), and each class holds its positions in
order. When two classes unite at an LCP of l, any two positions i < j that
become neighbours in the order and lie at most l apart are the seed of a run of
period j - i that ends with word j + l - 1. Two positions with a third of their
class between them are none, as the third gives a smaller period. A seed whose
words before i and j differ (or i = 0) is the run's first position, so each run
is met once. A run of at least max(12, 2q) words has an LCP of at least
SHORTEST / 2 at its seed, so classes are united no further than that, and a
text in which no six words repeat has no run.

Each text is worked on by itself, in one task, within memory in proportion to
its words; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import table

SHORTEST = 12  # words of the shortest run

Run = tuple[int, int, int]  # start, length, period


def _may_repeat(codes: np.ndarray, width: int) -> bool:
    """Whether ``width`` words may occur twice; never false if they do."""
    n = len(codes) - width + 1
    if n < 2:
        return False
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + n]
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def _levels(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... words.

    The last level tells all suffixes apart; a suffix that ends earlier comes
    first and equals no other.
    """
    n = len(codes)
    ranks, width = [codes.astype(np.int64)], 1
    while True:
        key = ranks[-1] * (n + 1)
        key[:n - width] += ranks[-1][width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        steps = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = steps
        ranks.append(rank)
        width *= 2
        if steps[-1] == n - 1:
            return ranks


def _neighbours(codes: np.ndarray, least: int
                ) -> tuple[list[int], list[int], list[int]]:
    """Suffix array neighbours (i, j, LCP) by falling LCP of ``least`` on."""
    ranks = _levels(codes)
    n = len(codes)
    places = np.empty(n, np.int64)
    places[ranks[-1]] = np.arange(n)
    a, b = places[:-1], places[1:]
    common = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(a, b) + common < n
        at_a, at_b = (np.minimum(x + common, n - 1) for x in (a, b))
        same = inside & (ranks[level][at_a] == ranks[level][at_b])
        common += same << level
    order = np.argsort(-common, kind="stable")
    order = order[:np.count_nonzero(common >= least)]
    return a[order].tolist(), b[order].tolist(), common[order].tolist()


def _united(into: list[int], new: list[int]) -> Iterator[tuple[int, int]]:
    """Merge two ordered position sets; pairs that are neighbours since."""
    last = len(new) - 1
    for t, x in enumerate(new):
        k = bisect_left(into, x)
        if k and not (t and into[k - 1] == new[t - 1]):
            yield into[k - 1], x
        if k < len(into) and (t == last or new[t + 1] > into[k]):
            yield x, into[k]
        into.insert(k, x)


def find_runs(codes: np.ndarray, shortest: int = SHORTEST) -> list[Run]:
    """All runs (start, length, period) of numbered words, by start and period.

    ``codes`` numbers the words 0, 1, ... by value.
    """
    least = max(1, (shortest + 1) // 2)
    if len(codes) < max(2, shortest) or not _may_repeat(
            codes.astype(np.uint64), least):
        return []
    root: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    word, runs = codes.tolist(), []

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for a, b, common in zip(*_neighbours(codes, least), strict=True):
        one, two = find(a), find(b)
        into, new = places.pop(one, [one]), places.pop(two, [two])
        if len(into) < len(new):
            one, two, into, new = two, one, new, into
        root[two] = one
        for i, j in _united(into, new):
            if (j - i <= common and j - i + common >= shortest
                    and (not i or word[i - 1] != word[j - 1])):
                runs.append((i, j - i + common, j - i))
        places[one] = into
    return sorted(runs, key=lambda r: (r[0], r[2]))


def number_words(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words without those that follow the first period inside a run."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return [w for w, out in zip(words, gone.tolist(), strict=True) if not out]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text"
                  ) -> DataFrame:
    """Row per row of ``docs``: key, ``n_words``, ``runs``, ``collapsed``.

    ``runs`` is an array of (start, length, period) in words from 0, by start
    and then period; ``collapsed`` has the words that are left when each run
    keeps its first period, joined by one space. Words are what the six ASCII
    blanks part, in whole texts. A null or empty text has no words, no runs
    and collapses to an empty string. Rows with a null key and rows that
    repeat a key are rows like others. Other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()),
                     ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, kept = [], [], []
            for body in batch.column(1):
                raw = body.as_py()
                words = (raw or "").encode("utf-8", "surrogatepass").split()
                runs = find_runs(number_words(words))
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r,
                                       strict=True)) for r in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()),
                 pa.array(found, pa.list_(run)),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["key", "n_words", "runs", "collapsed"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")
                       ).mapInArrow(
        search, f"key {kind}, n_words long, runs array<struct<start:long, "
        "length:long, period:long>>, collapsed string"
    ).withColumnRenamed("key", key)


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten repeats a stretch to its end.

    With h = crc32(doc_id as text), g = h div 10 and n words, documents with
    h % 10 = 0 have word a + (i - a) % p in place of each word i >= a, where a =
    g % n and p = 1 + (n - a) div (3 + g % 8). A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")),
                                 F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    at = "if(i < a, i, a + (i - a) % p)"
    return (docs.select("doc_id", "text", h.alias("h"))
            .withColumn("w", F.when(F.expr("h % 10 = 0"), words))
            .withColumn("g", F.expr("h div 10"))
            .withColumn("n", F.when(F.size("w") > 0, F.size("w")))
            .withColumn("a", F.expr("g % n"))
            .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
            .select("doc_id", F.when(F.col("n").isNull(), F.col("text"))
                    .otherwise(F.expr(
                        "array_join(transform(sequence(0L, n - 1L), i -> "
                        f"get(w, cast({at} as int))), ' ')")).alias("text")))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The longest run of each document, and digests of runs and rest."""
    found = periodic_runs(made_periodic(table(spark, sf, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, "
                  "-r.start as start, -r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', "
                    "r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
