"""Phrases of a dictionary table contained in texts, by rare n-grams.

A text that contains a phrase contains all of its n-grams, so it is enough to
join texts and phrases on one n-gram of each phrase, the one that the fewest
texts have, and to look for the phrase itself in what meets. Phrases from six
characters on meet on 6-grams, which few other texts have; shorter ones on
3-grams. Phrases below three characters have none; they come as one array to
every row.

A dictionary within MOST_PHRASES and MOST_CELLS goes to the tasks as a whole,
and texts are looked up in place (`phrases.py`): no rows for n-grams.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import filled
from corpusloom.operators.common import has_at_most, require_columns
from corpusloom.operators.phrases import Phrases

GRAM, LONG_GRAM = 3, 6
# of a dictionary that each task holds: phrases, and those times the longest
MOST_PHRASES, MOST_CELLS = 100_000, 1 << 23


def with_grams(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``(keep..., gram)``: a row per run of GRAM and of LONG_GRAM characters,
    repeated ones too. Array reads inside generated code, no pattern."""
    size = F.size("_c")
    places = (df.select(*keep, F.split(text, "").alias("_c"))
              .select(*keep, "_c", F.explode(F.when(size >= GRAM, F.sequence(
                  F.lit(0), size - GRAM))).alias("_i")))

    def gram(n: int) -> Column:
        return F.when(F.col("_i") + n <= size, F.concat(*[
            F.get("_c", F.col("_i") + k) for k in range(n)]))

    return (places.select(*keep, F.explode(F.array(
        gram(GRAM), gram(LONG_GRAM))).alias("gram"))
        .where(F.col("gram").isNotNull()))


def _phrases(dim: DataFrame) -> DataFrame:
    """``(phrase, place)``: each phrase once, at its first place."""
    return (dim.where(F.col("phrase").isNotNull()).groupBy("phrase")
            .agg(F.min("place").alias("place")))


def candidates(texts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """``(key, place, phrase)`` of texts that have a phrase's rarest n-gram.

    ``texts`` is ``(key, low)``. An n-gram is rare if it is seldom in the
    texts; a phrase with an n-gram that no text has is in no text. Only n-grams
    of the dictionary are counted.
    """
    # rows that repeat a key are texts of their own
    texts = texts.withColumn("_row", F.monotonically_increasing_id())
    phrases = _phrases(dim).where(F.char_length("phrase") >= GRAM)
    size = F.when(F.char_length("phrase") >= LONG_GRAM, LONG_GRAM).otherwise(
        GRAM)
    of_phrase = (with_grams(phrases, "phrase", "phrase", "place")
                 .where(F.char_length("gram") == size).distinct())
    known = of_phrase.select("gram").distinct()
    in_text = (with_grams(texts, "low", key, "_row")
               .join(known, "gram", "left_semi"))
    rarity = in_text.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (of_phrase.join(rarity, "gram", "left")
              .groupBy("phrase", "place")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"),
                                  "gram")).alias("best"))
              .where("best.n > 0")
              .select("phrase", "place", F.col("best.gram").alias("gram")))
    return (in_text.join(rarest, "gram").select(key, "_row", "place", "phrase")
            .distinct().drop("_row"))


def _looked_up(df: DataFrame, phrases: DataFrame, key: str, text: str
               ) -> DataFrame:
    """``df`` with ``skills``, from few phrases that all tasks hold."""
    long = F.char_length("phrase") >= GRAM
    listed = [tuple(r) for r in phrases.select(
        long, "place", "phrase").collect()]
    known = Phrases([p for _, _, p in listed])

    @F.arrow_udf("array<int>")
    def look(texts: pa.Array) -> pa.Array:
        return known.found(texts)

    spark = df.sparkSession
    kind = phrases.schema["place"].dataType.simpleString()
    each = f"array<struct<long: boolean, place: {kind}, phrase: string>>"
    names = spark.createDataFrame([(listed,)], f"names {each}").scalar()
    # rows of one key give their phrases to each other, without a key to none
    alike = Window.partitionBy(key, F.when(F.col(key).isNull(),
                                           F.xxhash64("_own")))
    own = F.col("_own")
    every = F.when(F.size("_every") == F.size(own), own).otherwise(F.filter(
        "_every", lambda i: F.array_contains(own, i)))
    named = F.transform(every, lambda i: F.get(F.col("_names"), i))
    short = F.transform(own, lambda i: F.get(F.col("_names"), i))
    both = F.concat(
        F.when(F.col(key).isNull(), F.array().cast(each)).otherwise(
            F.filter(named, lambda p: p["long"])),
        F.filter(short, lambda p: ~p["long"]))
    found = F.transform(both, lambda p: F.struct(p["place"], p["phrase"]))
    return (df.withColumn("_own", look(F.lower(filled(F.col(text)))))
            .withColumn("_every", F.flatten(F.collect_list("_own").over(alike)))
            .withColumn("_names", names)
            .withColumn("skills", F.transform(F.array_sort(found),
                                              lambda p: p["phrase"]))
            .drop("_own", "_every", "_names"))


def find_phrases(df: DataFrame, dim: DataFrame, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Add ``skills``: the phrases contained in the lower-cased text.

    ``dim`` is ``(domain, phrase, place)``, place rising in the order of the
    dictionary; a phrase that stands in it more than once counts at its first
    place, and phrases are found in that order, each once. A text without any,
    and a null text, has an empty array. ``key`` tells the rows apart.
    """
    require_columns(df, key, text)
    require_columns(dim, "domain", "phrase", "place")
    # by key once: the steps below read that, on as many cores as there are
    df = df.repartition(key)
    phrases = _phrases(dim)
    n, longest = phrases.limit(MOST_PHRASES + 1).agg(
        F.count(F.lit(1)), F.max(F.char_length("phrase"))).first()
    if n <= MOST_PHRASES and n * (longest or 0) <= MOST_CELLS:
        return _looked_up(df, phrases, key, text)
    texts = df.select(key, F.lower(filled(F.col(text))).alias("low"))
    met = candidates(texts, dim, key).groupBy(key).agg(
        F.collect_list(F.struct("place", "phrase")).alias("met"))
    # at most as many as there are strings of one or two characters in use
    short = _phrases(dim).where(F.char_length("phrase") < GRAM).agg(
        F.collect_list(F.struct("place", "phrase")).alias("short")).scalar()
    both = F.concat(F.coalesce("met", F.array()), "_short")
    low = F.lower(filled(F.col(text)))
    found = F.filter(both, lambda p: F.contains(F.col("_low"), p["phrase"]))
    return (df.join(met, key, "left").withColumn("_low", low)
            .withColumn("_short", short)
            .withColumn("skills", F.transform(
                F.array_sort(found), lambda p: p["phrase"]))
            .drop("met", "_low", "_short"))


def group_phrases(found: DataFrame, dim: DataFrame, key: str = "doc_id"
                  ) -> DataFrame:
    """Add ``skill_groups``: ``array<struct<label, phrases>>`` by domain.

    Domains in the order of their first place; phrases keep the order of
    ``skills``, and one of two domains stands in both.
    """
    require_columns(found, key, "skills")
    # lists by text and domain, and by text, are then made where the texts lie
    found = found.repartition(key)
    first = dim.groupBy("domain").agg(F.min("place").alias("of_domain"))
    member = (dim.where(F.col("phrase").isNotNull())
              .select("domain", "phrase").distinct().join(first, "domain"))
    if has_at_most(dim, MOST_PHRASES):
        member = F.broadcast(member)
    label = F.initcap(F.replace("domain", F.lit("_"), F.lit(" ")))
    groups = (found.select(key, F.posexplode("skills").alias("at", "phrase"))
              .join(member, "phrase").groupBy(key, "domain", "of_domain")
              .agg(F.sort_array(F.collect_list(F.struct("at", "phrase")))
                   .alias("in_order"))
              .groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
                  "of_domain", label.alias("label"),
                  F.col("in_order.phrase").alias("phrases"))))
                  .alias("groups")))
    return (found.join(groups, key, "left")
            .withColumn("skill_groups", F.coalesce(F.transform(
                "groups", lambda g: F.struct(g["label"].alias("label"),
                                             g["phrases"].alias("phrases"))),
                F.array())).drop("groups"))
