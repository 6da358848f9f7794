"""N-gram Jaccard join by parity sketches.

Two sets with a Jaccard similarity of at least 0.8 differ in at most a quarter
of the smaller set. A sketch deals the hashed shingles of a set to k blocks and
keeps the XOR of each block; every shingle that only one of two sets has
changes one block, so the number of unequal blocks never exceeds the symmetric
difference. With more filled blocks than the difference allows, two similar
sets must agree in a filled block (pigeonhole), and a join on blocks finds
them. k depends on the size, so sets meet in bands of similar size: a set is in
the band of its own size and in the next one if a larger partner may be there.

Large bands use fewer blocks: k such that two sets at the very threshold agree
in at least EXPECTED filled blocks on average, which leaves a pair unmet with a
chance below exp(-EXPECTED). Sets for which neither rule holds, and sets below
32 shingles, use each shingle as a block of its own, where the pigeonhole rule
always holds. A second sketch of BITS bits, in which each shingle flips one
bit, drops most pairs that met by chance: its Hamming distance, too, never
exceeds the symmetric difference. All other pairs are verified on the shingles
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import (components, counted, cut, discard,
                                   in_pieces, may_be_in, slim, table, widened)
from corpusloom.llm.shingles import mixed, shingle_set

EXPECTED = 14.0
FIRST_BAND = 32
RATIO = 1.6
BIG = 64     # a block that more sets share is looked at last
BITS = 1024
_LONGS = range(BITS // 64)
_U = np.uint64


def blocks_of(top: int) -> int:
    """Number of blocks of the band whose largest sets have ``top`` shingles."""
    apart = 2 * top // 9
    exact = int(1.15 * apart) + 8
    k = 1
    while k < exact and k * np.exp(-apart / k) < EXPECTED:
        k += 1
    return k


_bands: dict[int, tuple[int, int, int]] = {}


def _band(j: int) -> tuple[int, int, int]:
    """First size, last size and blocks of band j (from 1)."""
    if j not in _bands:
        first = FIRST_BAND
        for _ in range(j - 1):
            first = int(first * RATIO)
        top = int(first * RATIO) - 1
        _bands[j] = first, top, blocks_of(top)
    return _bands[j]


def _own_band(n: int) -> int:
    j = 0
    while n >= _band(j + 1)[0]:
        j += 1
    return j


def _keyed(values: np.ndarray, band: int, fine: bool) -> np.ndarray:
    return mixed(values ^ mixed(np.array([2 * band + fine + 1], _U)))


def sketches(found: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(band, spare, signatures) of a set for each band that it belongs to.

    ``spare`` is how many of the signatures may be ignored without losing a
    partner. Sets that can only be similar to equal ones have no sketch.
    """
    n, out = len(found), []
    if n // 4 == 0:
        return out
    own = _own_band(n)
    for band in (own, own + 1):
        first, top, k = _band(band) if band else (1, FIRST_BAND - 1, 0)
        if band > own and 10 * n < 8 * first:
            continue
        apart = min(n // 4, (n + top) // 9)
        if not band:
            out.append((band, n - apart - 1, _keyed(found, band, True)))
            continue
        # spread anew, as the sorted order says something about the hash
        value = mixed(found ^ _U(0x5851F42D4C957F2D))
        block = (value >> _U(33)) % _U(k)
        order = np.argsort(block, kind="stable")
        block, value = block[order], value[order]
        starts = np.flatnonzero(np.diff(block, prepend=_U(k)))
        parity = np.bitwise_xor.reduceat(value, starts)
        filled = len(starts)
        spare = max(filled - apart - 1,
                    filled - int(np.ceil(EXPECTED * np.exp(apart / k))))
        signatures = _keyed(parity ^ mixed(block[starts] + _U(1)), band,
                            False)
        if spare < 0:
            signatures = np.concatenate(
                [signatures, _keyed(found, band, True)])
            spare = n - apart - 1
        out.append((band, spare, signatures))
    return out


def parity_bits(found: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit numbers; each shingle flips one of them."""
    at = (mixed(found + _U(7)) >> _U(40)) % _U(BITS)
    odd = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Row per document: n, fingerprint f1 and f2 of its set, sketches."""
    kind = docs.schema[key].dataType.simpleString()

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_pieces(batches):
            rows = []
            for doc, body, md5 in zip(*(batch[c] for c in batch.columns),
                                      strict=True):
                found = shingle_set(body)
                rows.append((doc, md5, len(found), *fingerprint(found),
                             parity_bits(found), [
                    {"band": b, "spare": s, "signatures": x.view(np.int64)}
                    for b, s, x in sketches(found)]))
            yield pd.DataFrame(rows, columns=["key", "text_md5", "n", "f1", "f2",
                                              "bits", "bands"], dtype=object)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                       F.md5(F.coalesce(F.col(text), F.lit("")))
                       .alias("md5")).mapInPandas(
        describe, f"key {kind}, text_md5 string, n int, f1 long, f2 long, "
        "bits array<long>, bands array<struct<band:int, spare:int, "
        "signatures:array<long>>>")


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    both = np.array([found.sum(dtype=_U),
                     np.bitwise_xor.reduce(mixed(found + _U(1)))
                     if len(found) else _U(0)], _U).view(np.int64)
    return int(both[0]), int(both[1])


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_pieces(batches):
            rows = []
            for doc, body in zip(batch.iloc[:, 0], batch.iloc[:, 1],
                                 strict=True):
                found = shingle_set(body)
                rows.append((doc, *fingerprint(found), found.view(np.int64)))
            yield pd.DataFrame(rows, columns=["key", "f1", "f2", "shingles"],
                               dtype=object)

    return docs.select(key, text).mapInPandas(
        shingle, f"key {kind}, f1 long, f2 long, shingles array<long>")


def _close(one: str, two: str) -> Column:
    """Whether sizes and sketches of two classes allow a similarity of 0.8."""
    apart = " + ".join(f"bit_count({one}.bits[{i}] ^ {two}.bits[{i}])" for i in _LONGS)
    return F.expr(f"10 * least({one}.n, {two}.n) >= "
                  f"8 * greatest({one}.n, {two}.n) and "
                  f"9 * ({apart}) <= {one}.n + {two}.n")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame,
              key: str, text: str) -> DataFrame:
    """Pairs (a, b) of classes whose sets have a Jaccard of at least 0.8."""
    cids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = cut(classes.join(cids, "cid").select(
        "cid", "n", "f1", "f2", F.col("first").alias("key")))
    texts = may_be_in(docs.select(key, text), key, wanted.select(
        F.col("key").alias(key)))
    sets = cut(_sets(texts, key, text).alias("s").join(
        wanted.alias("w"), F.col("s.key").eqNullSafe(F.col("w.key"))
        & (F.col("s.f1") == F.col("w.f1")) & (F.col("s.f2") == F.col("w.f2")))
        .select("cid", "n", "shingles").dropDuplicates(["cid"]))
    both = F.size(F.array_intersect("sa", "sb"))
    found = cut(pairs.join(sets.toDF("a", "na", "sa"), "a")
                .join(sets.toDF("b", "nb", "sb"), "b").withColumn("both", both)
                .where("100L * both >= 80L * (na + nb - both)")
                .select("a", "b"))
    discard(wanted, sets)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Row per row of ``docs``: key, n_shingles, component_id, text_md5, group.

    Documents link at a Jaccard similarity of 0.8 on sets of five-word
    shingles; component_id is the smallest key reachable by links. Texts with
    the same set are one class and compared once. A null or empty text, or one
    of blanks only, has no shingles and links with nothing; so does its copy.
    A row with a null key takes part; where it has no partner with a key its
    component_id is null. Rows that repeat a key are rows of their own, told
    apart by ``text_md5``; ``group`` is a number of the component (null without
    shingles), as components can then have the same smallest key.

    Blocks shared by more than two classes are not expanded into pairs: each
    class is compared with the most central one, whose blocks are shared most.
    Only where a block then still holds different components are classes of
    different components compared, first by their sketches inside the join;
    blocks with more than BIG classes are left out of this for every class
    that can lose them by the pigeonhole rule.
    """
    features = cut(_features(docs, key, text))
    classes = cut(
        features.where("n > 0").groupBy("n", "f1", "f2")
        .agg(F.min("key").alias("first"))
        .withColumn("cid", F.monotonically_increasing_id()))
    heads = cut(features.where("size(bands) > 0").alias("f").join(
        classes.alias("c"), F.col("f.key").eqNullSafe(F.col("c.first"))
        & (F.col("f.f1") == F.col("c.f1")) & (F.col("f.f2") == F.col("c.f2")))
        .select("cid", "f.n", "bits", "bands"))
    rows = cut(features.drop("bits", "bands"))
    discard(features)
    signs = (heads.select("cid", F.explode("bands").alias("band"))
             .select("cid", "band.*")
             .select("cid", "band", "spare",
                     F.explode("signatures").alias("sign")))
    blocks = cut(signs.groupBy("sign").agg(
        F.count(F.lit(1)).alias("size"), F.min("cid").alias("a"),
        F.max("cid").alias("b")).where("a < b"))
    shared = blocks.where("size > 2").select("sign", "size")
    members = cut(may_be_in(signs, "sign", shared).join(shared, "sign"))
    sketch = cut(heads.select("cid", "n", "bits").join(
        blocks.select(F.explode(F.array("a", "b")).alias("cid"))
        .union(members.select("cid")).distinct(), "cid")
        .dropDuplicates(["cid"]))
    discard(heads)

    stars = cut(_stars(blocks, members).alias("p").join(sketch.alias("x"), F.expr(
        "p.a = x.cid")).join(sketch.alias("y"), F.expr("p.b = y.cid")
                             & _close("x", "y")).select("p.a", "p.b"))
    discard(blocks)
    links = _verified(stars, classes, docs, key, text)
    label = components(links)

    rest = _unresolved(members, label, sketch)
    discard(members, sketch, links)
    pairs, n_pairs = counted(rest.alias("x").join(rest.alias("y"), F.expr(
        "x.sign = y.sign and x.cid < y.cid and x.component <> y.component")
        & _close("x", "y"))
        .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        .distinct().join(stars, ["a", "b"], "left_anti"))
    discard(rest, stars)
    if n_pairs:
        more, found = counted(_verified(pairs, classes, docs, key, text))
        label = _joined(label, more) if found else label
    discard(pairs)
    return _labelled(rows, classes, label, key)


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """Components after more links between nodes."""
    for end in ("a", "b"):
        more = (more.join(label.toDF(end, "of"), end, "left")
                .withColumn(end, F.coalesce("of", end)).drop("of"))
    top = components(more).toDF("component", "top")
    moved = (label.join(top, "component", "left")
             .select("node", F.coalesce("top", "component")
                     .alias("component")))
    # nodes that had no link before
    return moved.unionByName(top.toDF("node", "component").join(
        label, "node", "left_anti"))


def _stars(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: both of two, or the centre with each other one."""
    central = members.groupBy("cid").agg(F.sum("size").alias("weight"))
    centre = (members.join(central, "cid").groupBy("sign").agg(
        F.max(F.struct("weight", "cid"))["cid"].alias("hub")))
    rays = members.join(centre, "sign").where("cid <> hub").select(
        F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"))
    return blocks.where("size = 2").select("a", "b").union(rays).distinct()


def _unresolved(members: DataFrame, label: DataFrame, sketch: DataFrame
                ) -> DataFrame:
    """Rows (sign, cid, component) of blocks with several components, with
    their sketches."""
    named = cut(members.join(label.withColumnRenamed("node", "cid"), "cid",
                             "left")
                .withColumn("component", F.coalesce("component", "cid")))
    lost = (named.where(F.col("size") > BIG).groupBy("cid", "band", "spare")
            .agg(F.count(F.lit(1)).alias("lost")).where("lost > spare")
            .select("cid", "band"))
    big = named.where(F.col("size") > BIG).join(lost, ["cid", "band"],
                                             "left_semi")
    kept = named.where(F.col("size") <= BIG).unionByName(big.select(
        named.columns))
    open_ = (kept.groupBy("sign").agg(F.min("component").alias("lo"),
                                      F.max("component").alias("hi"))
             .where("lo < hi").select("sign"))
    rest = cut(kept.join(open_, "sign").select("sign", "cid", "component")
               .join(sketch, "cid"))
    discard(named)
    return rest


def _labelled(features: DataFrame, classes: DataFrame, label: DataFrame,
              key: str) -> DataFrame:
    of = (classes.join(label, F.col("cid") == F.col("node"), "left")
          .withColumn("component", F.coalesce("component", "cid")))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.join(least, "component").select("n", "f1", "f2", "component",
                                               "component_id")
    rows = features.select("key", "text_md5", "n", "f1", "f2").join(
        named, ["n", "f1", "f2"], "left")
    return rows.select(
        F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("key"))
        .otherwise(F.col("component_id")).alias("component_id"),
        "text_md5", F.col("component").alias("group"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id",
                            text: str = "text") -> DataFrame:
    """``docs`` with one row left of each group of linked rows.

    It is the row with the smallest key, then text digest; texts without
    shingles all stay. Rows that repeat a key are judged one by one; of rows
    that repeat key and text one stays. Other columns pass as they are.
    """
    rows = cut(near_duplicates(docs, key, text).where("group is not null")
               .select(F.col(key).alias("key"), "text_md5", "group"))
    keep = rows.groupBy("group").agg(
        F.min(F.struct("key", "text_md5")).alias("keep"),
        F.count(F.lit(1)).alias("rows")).where("rows > 1")
    own = F.struct("key", "text_md5")
    gone = (rows.join(keep, "group").where(~own.eqNullSafe(F.col("keep")))
            .select("key", "text_md5").distinct())
    twice = (rows.groupBy("key", "text_md5").agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("key", "text_md5"))
    named = {"key": key, "text": text}
    slimmed = slim(docs, named).withColumn("md5", F.md5(F.coalesce(
        "text", F.lit(""))))

    def same(other: DataFrame) -> Column:
        return (slimmed["key"].eqNullSafe(other["key"])
                & (slimmed["md5"] == other["text_md5"]))

    first = Window.partitionBy("key", "md5").orderBy(F.lit(1))
    left = slimmed.join(gone, same(gone), "left_anti").join(
        twice.withColumn("again", F.lit(True)).withColumnsRenamed(
            {"key": "_key", "text_md5": "_md5"}),
        F.col("key").eqNullSafe(F.col("_key")) & (F.col("md5")
                                                  == F.col("_md5")), "left")
    one = left.where("again").withColumn("n", F.row_number().over(first)
                                         ).where("n = 1")
    columns = ["key", "text", "rest"]
    return widened(left.where("again is null").select(columns).unionByName(
        one.select(columns)), docs.columns, named)


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))
