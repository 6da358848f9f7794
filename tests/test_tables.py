"""Dictionary, stop words, dense vectors, quantiles and skew: plans and rows
against brute force."""

import math
import random
import re
import statistics
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import cleaning, fixed
from corpusloom.operators import (bow, centroid, common, compose, dictionary,
                                  ngrams, preprocess, profile, token_rows)
from corpusloom.sources import corpus as source


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- dictionary --------------------------------------------------------------

def test_dictionary_against_brute_force(spark):
    rng = random.Random(1)
    letters = "abcé "
    domains = {f"domain_{d}": ["".join(rng.choices(letters, k=rng.randint(
        1, 7))) for _ in range(60)] for d in range(4)}
    domains["domain_1"] += ["c++", "a", "\U0001f600 x", "R&D"]
    domains["domain_3"] += ["c++", domains["domain_0"][0], "r&d"]
    rows = [(d, p, i) for i, (d, p) in enumerate(
        (d, p) for d, ps in domains.items() for p in ps)]
    dim = spark.createDataFrame(rows, "domain string, phrase string, place int")
    texts = ["".join(rng.choices("ABCÉ abcé", k=rng.randint(0, 120)))
             for _ in range(150)]
    texts += [None, "", "C++ and R&D", "x\U0001f600 X y", "a" * 50_000 + "r&d"]
    df = spark.createDataFrame(list(enumerate(texts)),
                               "doc_id long, text string")
    found = dictionary.group_phrases(dictionary.find_phrases(df, dim), dim)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        low, want = (text or "").lower(), []
        for phrases in domains.values():
            for phrase in phrases:
                if phrase in low and phrase not in want:
                    want.append(phrase)
        assert got[i].skills == want
        groups = [(d.replace("_", " ").title(), [p for p in want
                                                 if p in domains[d]])
                  for d in domains]
        assert [(g.label, g.phrases) for g in got[i].skill_groups] == [
            g for g in groups if g[1]]
    assert "CartesianProduct" not in plan(found)


def test_documents_by_a_dictionary_table(spark):
    """The built-in dictionary as a table gives the built-in documents."""
    rows = [(d, p, i) for i, (d, p) in enumerate(
        (d, p) for d, ps in fixed.SKILLS.items() for p in ps)]
    dim = spark.createDataFrame(rows, "domain string, phrase string, place int")
    people = spark.createDataFrame(
        [(1, "Testing", "Python and SQL, 5 years, Docker, C++ and R"),
         (2, "HR", ""), (3, None, None), (4, "x", "KUBERNETES 3 yrs")],
        "doc_id long, category string, text string")
    want = compose.generate(people).select("doc_id", "document", "skills")
    got = compose.generate(people, dictionary=dim).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_dictionary_meets_on_rare_grams(spark):
    dim = spark.createDataFrame(
        [("d", "the quixotic", 0), ("d", "the absent", 1)],
        "domain string, phrase string, place int")
    df = spark.createDataFrame(
        [(i, "the other thing" + (" the quixotic" if i % 50 == 0 else ""))
         for i in range(500)], "doc_id long, low string")
    met = dictionary.candidates(df, dim, "doc_id").collect()
    assert {(r.doc_id, r.phrase) for r in met} == {
        (i, "the quixotic") for i in range(0, 500, 50)}


# -- stop words --------------------------------------------------------------

def test_stop_word_table(spark):
    rows = [(1, "The cat the THE sat", "x"), (2, "the of", None), (3, "", "z"),
            (4, "on cat on cat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, cleaned string, extra string")
    words = spark.createDataFrame([("THE",), ("of",), ("On",), (None,), ("of",)],
                                  "word string")
    done = preprocess.with_tokens(df, stopwords=words).orderBy("doc_id")
    assert [(r.doc_id, r.cleaned, r.extra, r.processed)
            for r in done.collect()] == [
        (1, rows[0][1], "x", "cat sat"), (2, "the of", None, ""),
        (3, "", "z", ""), (4, rows[3][1], "x", "cat cat")]
    listed = preprocess.with_tokens(df, stopwords=["the", "of", "on"])
    assert sorted(r.processed for r in listed.collect()) == sorted(
        r.processed for r in done.collect())
    assert "LeftAnti" in plan(token_rows.drop_listed(
        df.withColumn("tokens", F.split("cleaned", " ")), words))


# -- dense vectors -----------------------------------------------------------

@pytest.mark.parametrize("bound", [3, None])
def test_dense_cosines(spark, monkeypatch, bound):
    rng = random.Random(2)
    rows = [(i, f"l{i % 3}", [rng.gauss(0, 1) for _ in range(5)])
            for i in range(60)] + [(60, "l1", [0.0] * 5)]
    df = spark.createDataFrame(rows, "k long, label string, v array<float>")
    monkeypatch.setattr(centroid, "DENSE_LABELS", 3 if bound else 1)
    means = centroid.dense_centroids(df, "k", "v", "label")
    scores = centroid.dense_scores(df, means, "k", "v", bound)
    vectors = {r.k: r.v for r in df.collect()}
    mean = {}
    for label in ("l0", "l1", "l2"):
        own = [vectors[k] for k, name, _ in rows if name == label]
        mean[label] = [sum(x) / len(own) for x in zip(*own, strict=True)]
    got = {(r.k, r.category): r.score for r in scores.collect()}
    assert len(got) == 61 * 3
    for (k, label), score in got.items():
        size = math.hypot(*vectors[k]) * math.hypot(*mean[label])
        want = math.sumprod(vectors[k], mean[label]) / size if size else 0
        assert math.isclose(score, want, abs_tol=2e-9)
    if bound:  # scored vectors are read once, and not spread over rows
        scored = plan(scores).split("Subquery")[0]
        assert "posexplode" not in scored


# -- quantiles and labels ----------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 5, 1000, 4001])
def test_quantiles_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random() * 1e6, 7.0, -3.5]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = profile.quantiles(df, "v", (0, .25, .5, .75, 1)).first()[0]
    if n > 1:
        want = [min(values), *statistics.quantiles(
            values, n=4, method="inclusive"), max(values)]
    else:
        want = values * 5
    assert all(math.isclose(a, b, rel_tol=1e-12)
               for a, b in zip(got, want, strict=True))
    assert profile.quantiles(df.limit(0), "v", (.5,)).first()[0] is None
    shown = profile.describe(df, ["v"])
    assert "percentile" not in plan(shown) and shown.first()["count"] == n


def test_labels_are_numbered_in_slices(spark):
    df = spark.createDataFrame([(f"label{i % 700:04d}",) for i in range(3000)],
                               "category string")
    encoded = bow.label_encode(df)
    assert [r.label_idx for r in encoded.orderBy("label").collect()] == list(
        range(700))
    parts = bow.label_map(encoded, 100).collect()
    assert sorted(r.part for r in parts) == list(range(7))
    assert {k: v for r in parts for k, v in r.mapping.items()} == {
        i: f"label{i:04d}" for i in range(700)}
    assert not re.search(r"windowspecdefinition\(label", plan(encoded))


# -- skew and scans ----------------------------------------------------------

def test_only_hot_keys_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(common, "SALT_ROWS", 100)
    big = spark.createDataFrame(
        [("hot", i) for i in range(950)] + [(f"k{i % 40}", i)
                                            for i in range(400)],
        "term string, n int")
    sizes = big.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    small = sizes.select("term", F.length("term").alias("size"))
    joined = common.join_small(big, small, "term", None, sizes=sizes)
    assert sorted(joined.collect()) == sorted(
        big.join(small, "term").collect())
    assert "_salt" in plan(joined)
    monkeypatch.setattr(common, "SALT_ROWS", 10**6)
    assert common.join_small(big, small, "term", None,
                             sizes=sizes).count() == 1350


def test_vocabulary_of_any_size_salts_by_df(spark, monkeypatch):
    """One term in all documents: the rows are those of a plain join."""
    docs = spark.createDataFrame(
        [(i, "a", ["common", f"own{i}"]) for i in range(200)],
        "doc_id long, category string, tokens array<string>")
    counts = ngrams.term_counts(docs, ngram_range=(1, 1))
    words = ngrams.number_terms(ngrams.corpus_counts(counts), None)
    want = sorted(ngrams.matrix(counts, words, None).collect())
    monkeypatch.setattr(common, "SALT_ROWS", 50)
    found = ngrams.matrix(counts, words, None)
    assert sorted(found.collect()) == want and len(want) == 400


def test_bag_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(
        [(i, "x", "alpha beta gamma delta", 0) for i in range(30)],
        "doc_id long, category string, text string, n int").write.parquet(path)
    docs = source.read_parquet(spark, path)
    bag = bow.BagOfNgrams.fit(preprocess.prepare(docs, min_chars=None),
                              max_df=1.0)
    frame = bag.matrix.groupBy("doc_id").count()
    assert {r["count"] for r in frame.collect()} == {7}
    # the other uses of the tokens read the shuffle that the first has made
    assert "ReusedExchange" in plan(frame)


# -- mail --------------------------------------------------------------------

def test_mail_pattern_is_linear_and_equal(spark):
    plain = re.compile(r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b")
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab1._+-@ é,", weights=[
        6, 6, 2, 6, 1, 2, 2, 7, 2, 1, 1], k=rng.randint(1, 60)))
        for _ in range(4000)]
    texts += ["a@b.com.x@d.org", "a@b.com-x@d.org", "..a@b.cc", "+-@b.cc",
              "a@b@c.com", "x@y.comé", "a@b.co1 c@d.ee"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(
        cleaning.strip_emails(F.col("t"))).collect()]
    assert got == [plain.sub(" ", t) for t in texts]
    long = spark.createDataFrame(
        [("a.b-" * 250_000 + "@",), ("a" * 1_000_000 + "@x",),
         ("a@" * 500_000,)], "t string").coalesce(1)
    start = time.perf_counter()
    long.select(F.length(cleaning.strip_emails(F.col("t")))).collect()
    assert time.perf_counter() - start < 5


def test_folding_makes_three_tokens_of_a_character_at_most():
    """What the bound on the tokens of a query counts on."""
    _, one, several = cleaning._fold_tables()
    assert set(map(len, one)) <= {1}
    assert max(len(re.findall("[a-zA-Z]+|[0-9]+", x))
               for x in several.values()) <= 3


def test_texts_processed_elsewhere(spark):
    df = spark.createDataFrame(
        [(1, "a", "Some alpha, beta x"), (2, "a", None), (3, None, "é")],
        "doc_id long, category string, text string")
    done = preprocess.with_tokens(preprocess.with_cleaned(df))
    got = preprocess.from_processed(done).select("doc_id", "tokens")
    want = preprocess.prepare(df, min_chars=None).select("doc_id", "tokens")
    assert sorted(got.collect()) == sorted(want.collect())


def test_source_partitions(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(100).selectExpr("id as doc_id", "'x' as category",
                                "'some text' as text").coalesce(1).write.parquet(
        path)
    assert source.read_parquet(spark, path).rdd.getNumPartitions() == 1
    dealt = source.read_parquet(spark, path, partitions=5)
    assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 100
    (tmp_path / "c.csv").write_text("Category,Resume\nHR,one\nHR,two\n")
    rows = source.read_csv(spark, str(tmp_path / "c.csv"),
                           ["Category", "Resume"], partitions=3)
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 2


def test_long_phrases_meet_few_texts_that_lack_them(spark):
    """All 3-grams of a phrase in a text are not enough to meet."""
    dim = spark.createDataFrame([("d", "abcdef", 0), ("d", "xyz", 1)],
                                "domain string, phrase string, place long")
    texts = spark.createDataFrame([(1, "abc bcd cde def"), (2, "-abcdef-xyz")],
                                  "doc_id long, low string")
    met = dictionary.candidates(texts, dim, "doc_id").collect()
    assert sorted((r.doc_id, r.phrase) for r in met) == [
        (2, "abcdef"), (2, "xyz")]


def test_grams_are_made_without_patterns(spark):
    texts = spark.createDataFrame([(1, "aé\U0001F600aé\U0001F600b"), (2, "ab"),
                                   (3, "")], "doc_id long, low string")
    rows = dictionary.with_grams(texts, "low", "doc_id")
    text = texts.first().low
    assert sorted(r.gram for r in rows.collect()) == sorted(
        text[i:i + n] for n in (3, 6) for i in range(len(text) - n + 1))
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan(
        ).toString()


@pytest.mark.parametrize("most", [dictionary.MOST_PHRASES, 0])
def test_few_phrases_are_looked_up_in_place(spark, monkeypatch, most):
    """The same rows with and without rows for n-grams, also where keys repeat
    or are missing; without, texts meet no n-grams in a join."""
    monkeypatch.setattr(dictionary, "MOST_PHRASES", most)
    dim = spark.createDataFrame(
        [("d", "quixotic", 5), ("e", "the", 1), ("d", "x", 0), ("e", "ixo", 3),
         ("d", "the quixotic knight", 4), ("e", "quixotic", 2), ("e", "", 9),
         ("e", None, 8)], "domain string, phrase string, place int")
    texts = [(1, "The QUIXOTIC knight"), (2, "the"), (2, "the"), (3, None),
             (None, "the x"), (4, "quixoti"), (5, "é" * 70_000 + "quixotic")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = dictionary.find_phrases(df, dim)
    got = sorted(((r.doc_id, r.skills) for r in found.collect()), key=str)
    assert got == sorted([
        (1, ["x", "the", "quixotic", "ixo", "the quixotic knight", ""]),
        (2, ["the", "the", ""]), (2, ["the", "the", ""]), (3, [""]),
        (None, ["x", ""]), (4, ["x", "ixo", ""]),
        (5, ["x", "quixotic", "ixo", ""])], key=str)
    assert ("gram" in plan(found)) == (most == 0)
