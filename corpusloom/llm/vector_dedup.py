"""Near-duplicate vectors by an inverted index with product quantisation.

A coarse quantiser deals unit vectors to lists; what is left of a vector after
its list's centre is coded by a product quantiser. Every vector looks for
partners of its own label in the lists nearest to it. There, table look-ups
give its distance to each coded vector; as the coding error of each is stored,
the triangle inequality says which pairs can be close, and only those are
compared exactly, in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import components, cut, discard, in_pieces, table

THRESHOLD = 0.93
PROBES = 8
MAX_LISTS = 4096
SAMPLE = 50_000  # most vectors that the quantisers are fitted on
BLOCK = 1024     # most vectors on either side of one comparison
PARTS, CODES = 8, 256


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all centres."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T
                      + (centres * centres).sum(1))


def _nearest(x: np.ndarray, centres: np.ndarray, rows: int = 2048
             ) -> np.ndarray:
    """Nearest centre of each row, with few distances in memory at a time."""
    return np.concatenate([_distances(x[i:i + rows], centres).argmin(1)
                           for i in range(0, len(x), rows)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5
           ) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None],
                           centres)
    return centres


@dataclass
class Index:
    """Centres of the lists, and a codebook for each part of a residual."""

    centres: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Index:
        centres = kmeans(x, lists)
        near = _nearest(x, centres)
        parts = np.array_split(np.arange(x.shape[1]),
                               min(PARTS, x.shape[1]))
        rest = x - centres[near]
        return cls(centres, [kmeans(rest[:, p], CODES) for p in parts])

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        at = np.cumsum([b.shape[1] for b in self.books])[:-1]
        return np.split(x, at, axis=1)

    def place(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each vector, nearest first."""
        far = _distances(x, self.centres)
        probes = min(probes, far.shape[1])
        some = np.argpartition(far, probes - 1, 1)[:, :probes]
        order = np.take_along_axis(far, some, 1).argsort(1, kind="stable")
        return np.take_along_axis(some, order, 1)

    def encode(self, x: np.ndarray, home: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and how far each is from its vector."""
        codes, missed = [], np.zeros(len(x))
        for part, book in zip(self.split(x - self.centres[home]),
                              self.books, strict=True):
            code = _distances(part, book).argmin(1)
            missed += ((part - book[code]) ** 2).sum(1)
            codes.append(code)
        return np.stack(codes, 1), np.sqrt(missed)

    def table_distances(self, x: np.ndarray, home: int, codes: np.ndarray
                        ) -> np.ndarray:
        """Squared distances of x to the coded vectors of one list."""
        total = np.zeros((len(x), len(codes)))
        for i, (part, book) in enumerate(zip(
                self.split(x - self.centres[home]), self.books,
                strict=True)):
            total += _distances(part, book)[:, codes[:, i]]
        return total


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for pairs of 0..n-1."""
    label = np.arange(n)
    while len(pairs):
        low = label.copy()
        np.minimum.at(low, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], label[pairs[:, 0]])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    return label


def compare(index: Index, rows: pd.DataFrame, threshold: float
            ) -> pd.DataFrame:
    """Links found in one list between one block of queries and of members.

    Each linked pair is counted in one place only: pairs with the same home by
    the query with the smaller id; others, if both look into the other's list,
    in the list with the smaller number. Returns (cid, links, root), root being
    a class it is linked with, directly or not.
    """
    asks, base = rows[rows.ask], rows[~rows.ask]
    empty = pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
    if asks.empty or base.empty:
        return empty
    x, y = unit(asks.embedding), unit(base.embedding)
    here = int(base.home.iloc[0])
    codes, missed = index.encode(y, np.full(len(y), here))
    reach = np.sqrt(2 - 2 * threshold) + missed + 1e-6
    near = np.sqrt(index.table_distances(x, here, codes)) <= reach
    i, j = np.nonzero(near)
    exact = np.concatenate(
        [np.einsum("ij,ij->i", x[i[s:s + 65536]], y[j[s:s + 65536]])
         for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
    i, j = i[exact >= threshold], j[exact >= threshold]
    a, b = asks.cid.to_numpy(), base.cid.to_numpy()
    home = asks.home.to_numpy()
    back = np.zeros((len(base), index.centres.shape[0]), bool)
    for n, lists in enumerate(base.probes):
        back[n, lists] = True
    mine = np.where(home[i] == here, a[i] < b[j],
                    ~back[j, home[i]] | (here < home[i]))
    i, j = i[mine], j[mine]
    if not len(i):
        return empty
    ids, at = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    links = np.bincount(at, np.concatenate(
        [base.copies.to_numpy()[j], asks.copies.to_numpy()[i]]))
    root = roots(len(ids), at.reshape(2, -1).T)
    return pd.DataFrame({"cid": ids, "links": links.astype(np.int64),
                         "root": ids[root]})


def _usable(vector: str, label: str):
    x = F.col(vector)
    return (F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                       & (F.abs(v) < float("inf")))
            & F.exists(x, lambda v: v != 0))


def near_vectors(vectors: DataFrame, key: str = "vec_id",
                 vector: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD, probes: int = PROBES
                 ) -> DataFrame:
    """Row per vector: key, n_links, component_id, kept.

    Vectors of equal label and length link at a cosine of ``threshold`` or
    more. Equal vectors are one class, compared once and counted with their
    number. Vectors that are null, empty, zero or hold a null or a non-finite
    component, and those without a label, link with nothing, not even with
    their copies. Rows that repeat a key are rows of their own; a null key is
    never a component_id where there is another. An empty table gives an empty
    result.

    The quantisers are fitted on the driver on at most SAMPLE vectors of each
    length; every vector is indexed. The number of lists grows with the root
    of the number of vectors per label. Lists are compared in blocks of BLOCK
    vectors, so that no task holds a list.
    """
    rows = cut(vectors.select(
        F.col(key).alias("key"), F.col(vector).alias("embedding"),
        F.col(label).alias("label"), _usable(vector, label).alias("usable")))
    classes = cut(
        rows.where("usable").groupBy("label", "embedding")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first"))
        .withColumn("cid", F.monotonically_increasing_id()))
    found, parts = None, []
    for (width,) in classes.select(F.size("embedding")).distinct().collect():
        part, placed = _links(classes.where(F.size("embedding") == width),
                              threshold, probes)
        parts.append(placed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("key").alias(key),
                           F.lit(0).cast("long").alias("n_links"),
                           F.col("key").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = cut(found)
    discard(*parts)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = components(found.selectExpr("cid a", "root b"))
    of = (classes.join(links, "cid", "left")
          .join(comps.withColumnRenamed("node", "cid"), "cid", "left")
          .withColumn("component", F.coalesce("component", "cid"))
          .withColumn("n_links", F.coalesce("links", F.lit(0))
                      + F.col("copies") - 1))
    least = of.groupBy("component").agg(F.min("first").alias("least"))
    of = of.join(least, "component").select("label", "embedding", "n_links",
                                            "least")
    good = rows.where("usable").join(of, ["label", "embedding"]).select(
        "key", "n_links", F.col("least").alias("component_id"))
    alone = rows.where("not usable").select(
        "key", F.lit(0).cast("long").alias("n_links"),
        F.col("key").alias("component_id"))
    return good.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id",
        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, threshold: float, probes: int
           ) -> tuple[DataFrame, DataFrame]:
    """(cid, links, root) for classes whose vectors have the same length, and
    the table that this still reads."""
    n, labels = classes.agg(F.count(F.lit(1)),
                            F.approx_count_distinct("label")).first()
    lists = int(min(MAX_LISTS, max(1, np.ceil(np.sqrt(n / max(1, labels))))))
    some = (classes.select("embedding").orderBy(F.xxhash64("embedding"))
            .limit(SAMPLE).toPandas())
    index = Index.fit(unit(some.embedding), lists)
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def place(batches):
        for batch in in_pieces(batches, 1024):
            if len(batch):
                lists = shared.value.place(unit(batch.embedding), probes)
                yield batch.assign(home=lists[:, 0].astype(np.int32),
                                   probes=list(lists.astype(np.int32)))

    kind = classes.schema["embedding"].dataType.simpleString()
    of = classes.schema["label"].dataType.simpleString()
    placed = cut(classes.select("label", "cid", "copies", "embedding")
                 .mapInPandas(place, f"label {of}, cid long, copies long, "
                              f"embedding {kind}, home int, "
                              "probes array<int>"))
    asks = placed.withColumn("list", F.explode("probes")).withColumn(
        "ask", F.lit(True))
    base = placed.withColumn("list", F.col("home")).withColumn(
        "ask", F.lit(False))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("label", "list").agg(
            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    size = blocks(base, "nb").join(blocks(asks, "na"), ["label", "list"])
    every = asks.unionByName(base).join(size, ["label", "list"])
    # a row stands in one block of its side and meets all of the other side
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("ask"), F.col("na"))
                 .otherwise(F.col("nb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(
        F.col("ask"), F.col("nb")).otherwise(F.col("na")) - 1))
    every = (every.withColumn("own", own).withColumn("other", other)
             .withColumn("qa", F.when(F.col("ask"), F.col("own"))
                         .otherwise(F.col("other")))
             .withColumn("qb", F.when(F.col("ask"), F.col("other"))
                         .otherwise(F.col("own"))))
    return (every.select("label", "list", "qa", "qb", "ask", "cid", "copies",
                         "home", "probes", "embedding")
            .groupBy("label", "list", "qa", "qb").applyInPandas(
                lambda rows: compare(shared.value, rows, threshold),
                "cid long, links long, root long")), placed


def op9_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))
