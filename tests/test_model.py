"""Model, matcher, bag of words, profile, sources and stream, checked
against brute force in plain Python on small data."""

import dataclasses
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import (bow, matcher, ngrams, postings, preprocess,
                                  profile, slabs, tfidf)
from corpusloom.operators.common import (NotFittedError, dense_index,
                                         require_columns)
from corpusloom.plans.model import CorpusModel
from corpusloom.sources import corpus as source
from corpusloom.streaming import scoring

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(i, rng.choice(["red", "blue", "green"]),
            " ".join(rng.choices(WORDS, k=rng.randint(3, 12))))
           for i in range(40)]
    out.append((40, "blue", "unheard strange vocabulary"))
    out.append((41, "grey", "tiny"))          # too short to be kept
    out += [(50 + i, "red", out[3][2]) for i in range(4)]  # exact copies
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, category string, "
                                       "text string")


def brute(rows, limit):
    """TF-IDF of the kept rows: vocabulary, idf and unit vectors."""
    kept = [(i, c, t.split()) for i, c, t in rows if len(t) > 10]
    grams = {i: Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
             for i, _, t in kept}
    cf, df = Counter(), Counter()
    for counts in grams.values():
        cf.update(counts)
        df.update(counts.keys())
    top = sorted(cf, key=lambda g: (-cf[g], g))[:limit]
    idf = {g: math.log((1 + len(kept)) / (1 + df[g])) + 1 for g in top}
    return kept, idf, {i: unit(c, idf) for i, c in grams.items()}


def unit(counts, idf):
    raw = {g: (1 + math.log(n)) * idf[g] for g, n in counts.items()
           if g in idf}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {g: v / norm for g, v in raw.items()} if norm else {}


def dot(a, b):
    return sum(v * b.get(g, 0.0) for g, v in a.items())


LIMIT = 25


@pytest.fixture(scope="module")
def model(docs):
    return CorpusModel.fit(docs, max_features=LIMIT)


def test_weights(model, rows):
    _, idf, vectors = brute(rows, LIMIT)
    got = tfidf.with_terms(model.weights, model.vocabulary).collect()
    want = {(i, g): v for i, vec in vectors.items() for g, v in vec.items()}
    assert {(r.doc_id, r.term) for r in got} == set(want)
    assert all(math.isclose(r.weight, want[r.doc_id, r.term]) for r in got)
    names = [r.term for r in model.vocabulary.where("term_idx >= 0")
             .orderBy("term_idx").collect()]
    assert names == sorted(idf)


def labels_of(kept, vectors):
    cents = {}
    for i, c, _ in kept:
        cents.setdefault(c, []).append(vectors[i])
    return {c: {g: sum(v.get(g, 0.0) for v in vs) / len(vs)
                for g in {g for v in vs for g in v}}
            for c, vs in cents.items()}


def test_classify_all_labels(model, docs, rows):
    kept, idf, vectors = brute(rows, LIMIT)
    cents = labels_of(kept, vectors)
    got = {}
    for r in model.classify(docs, 3).collect():
        got.setdefault(r.doc_id, []).append((r.rank, r.category, r.score))
    assert len(got) == len(rows)
    for i, _, t in rows:
        toks = t.split()
        vec = unit(Counter(toks + [f"{a} {b}" for a, b in
                                   zip(toks, toks[1:])]), idf)
        scores = {c: round(dot(vec, m) / math.sqrt(dot(m, m)), 9)
                  for c, m in cents.items()}
        want = sorted(scores, key=lambda c: -scores[c])  # dict order on ties
        assert [c for _, c, _ in sorted(got[i])] == want
        for _, c, s in got[i]:
            assert math.isclose(s, scores[c], abs_tol=2e-9)


def test_unknown_text_goes_to_first_label(spark, model, rows):
    texts = spark.createDataFrame([(1, "zzz qqq"), (2, "")],
                                  "doc_id long, text string")
    got = model.classify(texts, 1).collect()
    assert {(r.category, r.score) for r in got} == {(rows[0][1], 0.0)}
    report = model.classify_report(texts).orderBy("doc_id").collect()
    assert [r.processed for r in report] == ["zzz qqq", ""]
    assert [len(r.top_k) for r in report] == [3, 3]


@pytest.mark.parametrize("indexed", [False, True])
@pytest.mark.parametrize("label", [None, "red", "green", "none of them"])
def test_match_against_full_ranking(spark, model, docs, rows, label, indexed):
    model = model.indexed() if indexed else model
    kept, idf, vectors = brute(rows, LIMIT)
    asked = ["alpha beta gamma", "kappa", "zzz", rows[3][2]]
    queries = spark.createDataFrame(
        [(q, t, 15, label) for q, t in enumerate(asked)],
        "query_id long, text string, top_n int, category_filter string")
    got = {}
    for r in model.match(queries).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for q, t in enumerate(asked):
        toks = t.split()
        vec = unit(Counter(toks + [f"{a} {b}" for a, b in
                                   zip(toks, toks[1:])]), idf)
        full = [(round(dot(vec, vectors[i]), 9)
                 if label is None or c == label else -1.0, i)
                for i, c, _ in kept]
        want = sorted(full, reverse=True)[:15]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 16))
        assert [i for _, i, _ in mine] == [i for _, i in want]
    shown = model.match(queries, docs)
    assert shown.columns == ["query_id", "rank", "Category",
                             "similarity_pct", "resume_snippet"]
    if label == "none of them":
        assert {r.similarity_pct for r in shown.collect()} == {-100.0}


def test_index_makes_few_pairs(spark):
    """Same rows as without an index, from a small part of the pairs."""
    rng = random.Random(5)
    common, *topics = [["".join(rng.choices("abcdefghij", k=8))
                        for _ in range(12)] for _ in range(61)]
    texts = [(i, f"label{i % 3}", " ".join(rng.sample(
        topics[i % 60] * 2 + common, 30))) for i in range(1200)]
    texts += [(5000 + i, None, texts[7][2]) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, category string, "
                                        "text string")
    queries = spark.createDataFrame(
        [(q, f"{texts[31 * q][2]} {common[0]}", None if q % 3 else "label1")
         for q in range(30)],
        "query_id long, text string, category_filter string")
    direct = CorpusModel.fit(docs)
    model = direct.indexed()
    want = sorted(direct.match(queries, top_n=4).collect())
    assert sorted(model.match(queries, top_n=4).collect()) == want

    asked = matcher.normalize_queries(queries)
    ready = preprocess.prepare_texts(asked, key="query_id")
    sought = tfidf.terms_only(direct.vectorize(ready, "query_id").join(
        asked.select("query_id", "category_filter"), "query_id")
        ).withColumnRenamed("weight", "qw")
    every = matcher.similarities(direct.weights, sought.withColumnRenamed(
        "qw", "weight")).count()
    made = sum(model.index.scores(sought, part, None).count()
               for part in model.index.chosen(sought, 4, None))
    assert made < 0.25 * every
    assert made >= len(want) - 4 * 30
    # a list is made where its block lies: weights never shuffle by term
    plan = postings.PostingIndex.build(direct.weights).postings
    shown = plan._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in shown.splitlines() if "hashpartitioning(" in x]
    assert any("hashpartitioning(block" in x for x in shuffles)
    assert not any("term_idx" in x.split("hashpartitioning(")[1].split(")")[0]
                   for x in shuffles)


def test_match_without_broadcast(spark, model, monkeypatch):
    """Past the size bound the same rows come out of an ordinary join."""
    queries = spark.createDataFrame([(1, "alpha beta gamma delta")],
                                    "query_id long, text string")
    small = model.match(queries).collect()
    monkeypatch.setattr(matcher, "query_bounds", lambda q: (5, None))
    assert sorted(model.match(queries).collect()) == sorted(small)


def test_classify_without_broadcast(model, docs):
    """Past the size bound of the centroids the salted join does it."""
    loose = dataclasses.replace(model, centroid_rows=None)
    plan = loose.classify(docs, 2)
    assert sorted(plan.collect()) == sorted(model.classify(docs, 2).collect())


def test_own_document_is_best(model, docs):
    queries = docs.where("doc_id < 10").select(
        F.col("doc_id").alias("query_id"), "text")
    best = model.match(queries, top_n=1).collect()
    assert all(math.isclose(r.score, 1.0, abs_tol=1e-8) for r in best)


def test_save_and_load(spark, model, docs, tmp_path):
    path = str(tmp_path / "model")
    stored = model.save(path)
    assert sorted(stored.classify(docs, 2).collect()) == sorted(
        model.classify(docs, 2).collect())
    queries = docs.select(F.col("doc_id").alias("query_id"), "text")
    assert sorted(stored.match(queries).collect()) == sorted(
        model.match(queries).collect())
    with pytest.raises(NotFittedError):
        CorpusModel.load(spark, str(tmp_path / "nothing"))


def test_empty_vocabulary(spark, tmp_path):
    empty = spark.createDataFrame([(1, "a", "the of and the of and")],
                                  "doc_id long, category string, text string")
    with pytest.raises(ValueError):
        CorpusModel.fit(empty).save(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        bow.BagOfNgrams.fit(preprocess.prepare(empty, min_chars=None)).check()
    with pytest.raises(Exception, match="no terms remain"):
        bow.BagOfNgrams.fit(preprocess.prepare(empty, min_chars=None)
                            ).matrix.collect()


def test_bag_limits_and_ties(spark):
    texts = ["aa bb", "aa bb", "aa cc", "aa dd"] + ["aa"] * 16
    df = spark.createDataFrame(
        [(i, "x" if i % 2 else "y", t) for i, t in enumerate(texts)],
        "doc_id long, category string, text string")
    ready = preprocess.prepare(df, min_chars=None)
    bag = bow.BagOfNgrams.fit(ready)           # aa is in 100 % of documents
    assert [r.term for r in bag.feature_names().orderBy("term").collect()
            ] == ["aa bb", "bb"]
    exact = bow.BagOfNgrams.fit(ready, min_df=1, max_df=0.1,
                                ngram_range=(1, 1))
    assert {r.term for r in exact.vocabulary.collect()} == {"bb", "cc", "dd"}
    top = ngrams.most_frequent(ngrams.corpus_counts(ngrams.term_counts(
        ready, ngram_range=(1, 1))), 2)
    assert [r.term for r in top.collect()] == ["aa", "bb"]
    ties = exact.top_ngrams(3).collect()
    assert [r.ngram for r in ties] == ["bb", "dd", "cc"]
    assert bag.features().count() == 20
    with pytest.raises(ValueError):
        bag.top_ngrams_of("absent")
    assert {r.ngram for r in bag.top_ngrams_of("x").collect()} == {
        "bb", "aa bb"}
    free = bow.BagOfNgrams.fit(ready, max_features=None, min_df=1, max_df=1.0)
    index = {r.term: r.term_idx for r in free.feature_names().collect()}
    assert [index[t] for t in sorted(index)] == list(range(len(index)))


def test_histogram_and_keywords(spark):
    same = spark.createDataFrame([(3,)] * 5, "v int")
    bins = profile.histogram(same, "v").collect()
    assert len(bins) == 40 and sorted(r.cnt for r in bins)[-2:] == [0, 5]
    spread = spark.range(0, 401).select(F.col("id").alias("v"))
    counts = {r.bin: r.cnt for r in profile.histogram(spread, "v").collect()}
    assert sum(counts.values()) == 401 and counts[39] == 11
    df = spark.createDataFrame(
        [(2, "a", "later words"), (1, "a", "Early, words words This gone")],
        "doc_id long, category string, text string")
    got = profile.top_keywords(df).orderBy("rank").collect()
    assert [(r.keyword, r.cnt) for r in got] == [("words", 3), ("gone", 1),
                                                 ("later", 1)]


def test_dense_index_on_a_hot_range(spark):
    ids = [*range(500), *range(10_000, 10_040), 99_999_999]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: r.row_index for r in dense_index(df, "doc_id").collect()}
    assert [got[i] for i in ids] == list(range(len(ids)))


def test_sources(spark, tmp_path):
    bad, good = tmp_path / "bad.csv", tmp_path / "good.csv"
    bad.write_text("a,b\n1,2\n")
    good.write_text('Category,Resume\nHR,"two\nlines, ""quoted"""\n'
                    "NA,text\nSales,\nSales,plain\n")
    got = source.load_corpus(spark, [str(tmp_path / "none.csv"), str(bad),
                                     str(good)]).orderBy("doc_id").collect()
    assert [(r.category, r.text) for r in got] == [
        ("HR", 'two\nlines, "quoted"'), ("Sales", "plain")]
    inline = source.load_corpus(spark, [str(bad)])
    assert sorted(r["count"] for r in inline.groupBy("category").count()
                  .collect()) == [2, 3, 3, 3, 3, 3]
    with pytest.raises(ValueError):
        require_columns(inline, "nope")
    out = str(tmp_path / "docs")
    docs = spark.createDataFrame([("Data Science", "one\ntwo")],
                                 "category string, document string")
    source.write_documents(docs, out)
    assert (tmp_path / "docs" / "file_key=JD_Data_Science").is_dir()


def test_stream_equals_batch(spark, docs, tmp_path):
    stored = CorpusModel.fit(docs, max_features=LIMIT).save(
        str(tmp_path / "m"))
    texts = docs.select("doc_id", "text")
    inbox = str(tmp_path / "in")
    texts.repartition(3).write.parquet(inbox)
    stream = scoring.read_texts(spark, inbox, files_per_batch=1)
    out = str(tmp_path / "out")
    run = scoring.classify_stream(stream, stored, out,
                                  str(tmp_path / "ckpt"), k=2)
    run.awaitTermination()
    got = scoring.read_results(spark, out)
    assert got.select("batch_id").distinct().count() == 3
    short = F.length("text") < 20
    assert {r.doc_id for r in got.collect()} == {
        r.doc_id for r in texts.collect()}
    assert sorted(got.where("status = 'accepted'").drop("batch_id", "status")
                  .collect()) == sorted(
        stored.classify(texts.where(~short), 2).collect())
    refused = got.where("status = 'rejected'").collect()
    assert sorted(r.doc_id for r in refused) == sorted(
        r.doc_id for r in texts.where(short).collect())
    assert {(r["rank"], r.category, r.score) for r in refused} == {
        (None, None, None)}

    asked = docs.select(F.col("doc_id").alias("query_id"), "text",
                        F.lit(3).alias("top_n"),
                        F.lit("All").alias("category_filter"))
    asked.coalesce(1).write.parquet(str(tmp_path / "q"))
    stream = scoring.read_texts(spark, str(tmp_path / "q"),
                                scoring.QUERY_SCHEMA)
    scoring.match_stream(stream, stored, docs, str(tmp_path / "mo"),
                         str(tmp_path / "mc")).awaitTermination()
    want = stored.match(asked.where(F.length("text") >= 10), docs)
    found = scoring.read_results(spark, str(tmp_path / "mo"))
    assert sorted(found.where("status = 'accepted'").drop("batch_id", "status")
                  .collect()) == sorted(want.collect())
    assert {r.query_id for r in found.collect()} == {
        r.query_id for r in asked.collect()}

    # a batch of rejected queries only is written too
    spark.createDataFrame([(1, "tiny", 3, None), (2, None, 3, None)],
                          scoring.QUERY_SCHEMA).coalesce(1).write.parquet(
        str(tmp_path / "q2"))
    scoring.match_stream(
        scoring.read_texts(spark, str(tmp_path / "q2"), scoring.QUERY_SCHEMA),
        stored, docs, str(tmp_path / "m2"), str(tmp_path / "c2")
    ).awaitTermination()
    assert sorted((r.query_id, r.status, r["rank"]) for r in
                  scoring.read_results(spark, str(tmp_path / "m2")).collect()
                  ) == [(1, "rejected", None), (2, "rejected", None)]


def test_stored_model_keeps_its_parameters(spark, docs, tmp_path):
    fitted = CorpusModel.fit(docs, max_features=None, ngram_range=(1, 3),
                             normalize="stem", extra_stopwords={"beta"})
    stored = fitted.save(str(tmp_path / "m"))
    again = CorpusModel.load(spark, str(tmp_path / "m"))
    assert (again.max_features, again.ngram_range) == (None, (1, 3))
    assert dict(again.options) == {"normalize": "stem",
                                   "extra_stopwords": ["beta"]}
    texts = docs.select("doc_id", "text").where("doc_id < 5")
    want = fitted.classify(texts, 2).orderBy("doc_id", "rank").collect()
    for model in (stored, again):
        got = model.classify(texts, 2).orderBy("doc_id", "rank").collect()
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert [r.score for r in got] == pytest.approx(
            [r.score for r in want])
    with pytest.raises(NotFittedError):
        CorpusModel.load(spark, str(tmp_path / "m" / "weights"))


def test_unlimited_vocabulary_is_the_whole_of_a_large_one(docs):
    ready = preprocess.prepare(docs)
    whole = tfidf.fit_vocabulary(ready, max_features=None)
    large = tfidf.fit_vocabulary(ready, max_features=100_000)
    assert sorted(whole.collect()) == sorted(large.select(
        whole.columns).collect())


def test_documents_without_label_follow_masked(spark):
    corpus = spark.createDataFrame(
        [(1, "red", "alpha beta gamma delta"),
         (2, None, "alpha beta gamma epsilon"),
         (3, None, "zeta eta theta iota")],
        "doc_id long, category string, text string")
    asked = spark.createDataFrame([(1, "alpha beta gamma", 3, "red")],
                                  "query_id long, text string, top_n int, "
                                  "category_filter string")
    got = CorpusModel.fit(corpus).match(asked).orderBy("rank").collect()
    assert [(r.doc_id, r.score < 0) for r in got] == [
        (1, False), (3, True), (2, True)]


def test_corpus_without_labels_skips_the_filter(spark):
    corpus = spark.createDataFrame(
        [(1, "alpha beta gamma delta"), (2, "zeta eta theta iota")],
        "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta gamma", 2, "red")],
                                  "query_id long, text string, top_n int, "
                                  "category_filter string")
    got = CorpusModel.fit(corpus).match(asked, corpus).orderBy(
        "rank").collect()
    assert [r.Category for r in got] == ["?", "?"]
    assert got[0].similarity_pct > 0 and got[1].similarity_pct == 0


def test_prompt_may_hold_the_whole_text(spark):
    from corpusloom.operators import compose
    df = spark.createDataFrame([("x" * 5000,)], "text string")
    cut, whole = df.select(compose.prompt(F.col("text")), compose.prompt(
        F.col("text"), max_chars=None)).first()
    assert len(whole) - len(cut) == 2000


def test_terms_are_counted_within_the_row(spark):
    """Rows of one document count together; nothing is grouped by term."""
    docs = spark.createDataFrame(
        [(1, "a", ["bb", "cc", "bb", "cc"]), (1, "a", ["bb"]), (2, None, []),
         (None, "b", ["cc"])], "doc_id long, category string, "
                               "tokens array<string>").repartition("doc_id")
    counts = ngrams.term_counts(docs, mark_docs=True)
    assert set(map(tuple, counts.collect())) == {
        (1, "a", "", 2), (1, "a", "bb", 3), (1, "a", "cc", 2),
        (1, "a", "bb cc", 2), (1, "a", "cc bb", 1), (2, None, "", 1),
        (None, "b", "", 1), (None, "b", "cc", 1)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" not in plan


@pytest.mark.parametrize("buckets, n", [(256, 6), (1 << 12, 6), (256, 16)])
def test_frequent_counts_are_exact_and_leave_rare_terms_out(
        spark, monkeypatch, buckets, n):
    rng = random.Random(3)
    rows = [(i % 55, "x", rng.choices(WORDS, k=8) + [f"rare{i}a", f"rare{i}b"])
            for i in range(60)]  # some documents are two rows
    df = spark.createDataFrame(rows, "doc_id long, category string, "
                                     "tokens array<string>")
    every = {tuple(r) for r in ngrams.corpus_counts(ngrams.term_counts(
        df, mark_docs=True)).collect()}
    monkeypatch.setattr(ngrams, "BUCKETS", buckets)
    found = {tuple(r) for r in ngrams.frequent_counts(df, n).collect()}
    kept = {tuple(r) for r in ngrams.frequent_counts(
        df, n, kept=lambda c: c.where("df < 40")).collect()}
    order = sorted((t for t in every if t[0]), key=lambda t: (-t[1], t[0]))
    assert found <= every and set(order[:n]) <= found
    few = [t for t in order if t[2] < 40]
    assert kept <= every and set(few[:n]) <= kept
    assert {t for t in every if not t[0]} <= found & kept
    assert len(found) < len(every) / 2


def test_a_fit_does_not_shuffle_rare_terms(spark):
    rows = [(i, "x", WORDS + [f"once{i}"]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, category string, "
                                     "tokens array<string>")
    for counts in (ngrams.frequent_counts(df, 5), ngrams.frequent_counts(
            df, 5, kept=lambda c: c.where("df >= 2"))):
        assert not counts.where("term like 'once%'").count()
    assert bow.BagOfNgrams.fit(df, max_df=1.0).vocabulary.count() == 19
    assert spark.range(1).select(ngrams.doc_count(df.union(df))).first()[0] == 30


def test_index_scores_remaining_blocks_where_they_lie(spark, model, docs,
                                                      monkeypatch):
    indexed = dataclasses.replace(model, index=postings.PostingIndex.build(
        model.weights, 2))
    queries = docs.where("doc_id < 12").select(
        F.col("doc_id").alias("query_id"), "text",
        F.when(F.col("doc_id") % 3 == 0, "red").alias("category_filter"))
    found = indexed.match(queries, top_n=2)
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in shown.splitlines() if "hashpartitioning(" in x
                and "term_idx" in x.split("hashpartitioning(")[1].split(
                    ")")[0] and "block" in x]
    here = sorted(found.collect(), key=str)
    monkeypatch.setattr(postings, "FEW_ROWS", 0)
    assert here == sorted(indexed.match(queries, top_n=2).collect(), key=str)


def test_many_queries_are_matched_in_slabs(spark, docs, rows, model,
                                           monkeypatch):
    # query 3 has a text for each of two filters; the last query shares nothing
    asked = spark.createDataFrame(
        [(i, rows[i][2], [None, "red", "grey", "none"][i % 4], 1 + i % 6)
         for i in range(12)] + [(3, rows[20][2], None, 4),
                                (3, rows[21][2], "blue", 4),
                                (99, "nothing of it", None, 2)],
        "query_id long, text string, category_filter string, top_n int")
    want = model.match(asked)
    monkeypatch.setattr(matcher, "BROADCAST_ROWS", 0)

    def no_pairs(*args):
        raise AssertionError("rows for all pairs that share a term")

    monkeypatch.setattr(matcher, "similarities", no_pairs)
    for per in (4, 1_000):
        monkeypatch.setattr(slabs, "DOCS_PER_SLAB", per)
        monkeypatch.setattr(slabs, "QUERIES_PER_BLOCK", per + 1)
        assert sorted(model.match(asked).collect()) == sorted(want.collect())


def test_parts_of_a_slab(monkeypatch):
    monkeypatch.setattr(slabs, "CELLS", 6)
    terms, weights = np.array([5, 9, 9, 5, 7]), np.arange(1.0, 6.0)
    parts = slabs._laid_out(terms, weights, np.array([2, 1, 2]))
    assert [(first, known.tolist(), cells.tolist())
            for first, known, cells in parts] == [
        (0, [5, 9], [[1.0, 0.0], [2.0, 3.0]]), (2, [5, 7], [[4.0], [5.0]])]
    assert slabs._best(np.array([0.5, 0.0, 0.7, 0.5, 0.5]), 3).tolist() == [
        2, 0, 3]
