"""URL filter: rules first, then trust and distrust over the link graph.

A rule names a host and the start of a path. Pages without a rule are judged by
their host: personalised PageRank from hosts that rules allow spreads trust
along links, and the same from blocked hosts against the links spreads
distrust, as pages that link to blocked ones are suspect. All in DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut, discard, slim, table, widened

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block")]
DAMPING = 0.85
ROUNDS = 60       # 0.85 ** 60 leaves less than 1e-4 of any weight
TOLERANCE = 1e-4  # rounds end when no score changes by more
THRESHOLD = 0.1  # a host is blocked where distrust exceeds trust by so much
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ANCHOR = r"(?i)<a\b[^>]*+"  # gives nothing back: linear whatever the page
_LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^\"'\s>/?#]+)"


def host_of(url: Column) -> Column:
    """Host, A-Z as a-z; empty if there is none or the url is null."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")),
                       _CAPITALS, _CAPITALS.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def suffixes(host: Column, most: Column) -> Column:
    """The host's domains of at most so many labels, itself included."""
    return F.transform(F.sequence(F.lit(1), F.least(labels_of(host), most)),
                       lambda i: F.call_function("substring_index", host,
                                                 F.lit("."), -i))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = ", ".join("('{}', '{}', '{}')".format(
        *[part.replace("\\", "\\\\").replace("'", "\\'") for part in rule])
        for rule in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule and rule_verdict, the longest rule that fits (else null).

    ``pages`` has host and path. Rules are looked up once for each distinct
    host, by its domains, so neither side is scanned for the other. Of rules
    that are alike but for the verdict, block wins.
    """
    hosts = pages.select("host").where("host <> ''").distinct()
    known = rules.select(F.col("host").alias("domain"),
                         F.col("path").alias("start"), "verdict").distinct()
    # no domain of more labels than a rule's host can fit
    most = rules.agg(F.coalesce(F.max(labels_of(F.col("host"))), F.lit(1))
                     ).scalar()
    fit = (hosts.withColumn("most", most)
           .select("host", F.explode(suffixes(F.col("host"), F.col("most")))
                   .alias("domain"))
           .join(known, "domain")
           .groupBy("host").agg(F.collect_list(F.struct(
               (F.length("domain") + F.length("start")).alias("size"),
               (F.col("verdict") == "block").alias("blocks"),
               "start", F.concat("domain", "start").alias("rule"),
               "verdict")).alias("_fit")))
    best = F.array_max(F.filter("_fit", lambda r: F.startswith(
        F.col("path"), r["start"])))
    # a host's rules come with the path check on each of its pages
    return (pages.join(fit, "host", "left").withColumn("_best", best)
            .withColumn("rule", F.col("_best.rule"))
            .withColumn("rule_verdict", F.col("_best.verdict"))
            .drop("_fit", "_best"))


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links between hosts: (src, dst, links).

    Links are the absolute addresses in the pages, counted once a page. As a
    host and the domain above it answer for each other, they count as linked
    both ways.
    """
    targets = F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")),
                             F.lit(_ANCHOR), F.lit(0)),
        lambda a: F.translate(F.regexp_extract(a, _LINK, 1), _CAPITALS,
                              _CAPITALS.lower())))
    targets = F.filter(targets, lambda h: h != "")
    linked = (pages.where("host <> ''")
              .select(F.col("host").alias("src"),
                      F.explode(targets).alias("dst"))
              .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links")))
    every = pages.select("host").union(linked.select("dst")).where(
        "host <> ''").distinct()
    above = (every.where("host like '%.%.%'")
             .select("host", F.regexp_extract("host", r"^[^.]*\.(.*)$", 1)
                     .alias("domain")))
    kin = (above.toDF("src", "dst").union(above.select("domain", "host"))
           .withColumn("links", F.lit(1).cast("long")))
    return (linked.union(kin).where("src <> dst").groupBy("src", "dst")
            .agg(F.sum("links").alias("links")))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS,
              damping: float = DAMPING, tolerance: float = TOLERANCE
              ) -> DataFrame:
    """Trust and distrust of every host reached: (host, trust, distrust).

    ``seeds``: host, weight from -1 (blocked) to 1 (trusted). Each round a
    host passes on ``damping`` of what it has, in proportion to its links:
    trust along them, distrust against them. What has nowhere to go is lost.
    Rounds go on until no score changes by more than ``tolerance``, at most
    ``rounds``.
    """
    ways = (edges.select(F.lit(1).alias("way"), F.col("src").alias("host"),
                         "dst", "links")
            .union(edges.select(F.lit(-1), "dst", "src", "links")))
    total = ways.groupBy("way", "host").agg(F.sum("links").alias("total"))
    ways = cut(ways.join(total, ["way", "host"]).select(
        "way", "host", "dst", (F.col("links") / F.col("total"))
        .alias("share")))
    start = cut(seeds.where("weight <> 0").select(
        F.signum("weight").cast("int").alias("way"), "host",
        (F.abs("weight") * (1 - damping)).alias("score")))
    score, nothing = start, F.lit(0.0).alias("before")
    for _ in range(rounds):
        passed = ways.join(score, ["way", "host"]).select(
            "way", F.col("dst").alias("host"),
            (F.col("score") * F.col("share") * damping).alias("score"), nothing)
        before = score.select("way", "host", F.lit(0.0), "score")
        moved, seen = F.col("score") - F.col("before"), Observation()
        # rounded, as sums of doubles depend on their order
        after = (passed.union(start.select("*", nothing)).union(before)
                 .groupBy("way", "host").agg(
                     F.round(F.sum("score"), 12).alias("score"),
                     F.max("before").alias("before")))
        after = cut(after.observe(seen, F.max(F.abs(moved)).alias("change"))
                    .drop("before"))
        if score is not start:
            discard(score)
        score = after
        if (seen.get["change"] or 0.0) <= tolerance:
            break
    side = F.sum(F.when(F.col("way") == 1, F.col("score"))
                 .otherwise(0.0)).alias("trust")
    other = F.sum(F.when(F.col("way") == -1, F.col("score"))
                  .otherwise(0.0)).alias("distrust")
    return score.groupBy("host").agg(side, other)


def filter_urls(pages: DataFrame, rules: DataFrame | None = None,
                url: str = "url", html: str = "html",
                rounds: int = ROUNDS, threshold: float = THRESHOLD
                ) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust.

    The verdict is the longest fitting rule's. Other pages are blocked where
    their host's distrust exceeds its trust by ``threshold``, and allowed
    elsewhere: also where the url is null or has no host. A host's seed weight
    is the share of its pages that rules allow less the share they block. An
    empty table gives an empty result; rows that repeat are each judged;
    columns of ``pages`` with one of the new names are replaced.
    """
    new = ["host", "path", "rule", "verdict", "trust", "distrust"]
    pages = pages.drop(*new)
    rules = rule_table(pages.sparkSession) if rules is None else rules
    own = {"url": url, "html": html}
    named = (slim(pages, own).withColumn("host", host_of(F.col("url")))
             .withColumn("path", path_of(F.col("url"))))
    judged = with_rules(named, rules)
    verdict = F.col("rule_verdict")
    seeds = (with_rules(named.select("host", "path"), rules)
             .where("host <> ''").groupBy("host").agg(F.avg(
                 F.when(verdict == "allow", 1.0)
                 .when(verdict == "block", -1.0).otherwise(0.0))
                 .alias("weight")))
    scores = propagate(seeds, cut(host_edges(named.select("host", "html"))),
                       rounds)
    scores = scores.withColumnRenamed("host", "_host")
    zero = F.lit(0.0)
    done = (judged.join(scores, F.col("host") == F.col("_host"), "left")
            .withColumn("trust", F.coalesce("trust", zero))
            .withColumn("distrust", F.coalesce("distrust", zero))
            .withColumn("verdict", F.coalesce(
                verdict, F.when(F.col("distrust") - F.col("trust")
                                >= threshold, "block").otherwise("allow"))))
    return widened(done, pages.columns, own, *new)


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", "host", "path", "rule",
                                     "verdict")
