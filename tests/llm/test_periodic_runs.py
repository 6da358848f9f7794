"""Periodic runs against a brute-force search over periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import periodic_runs as pr
from tests.llm.test_operators import SF, documents, needs_data


def brute(words, shortest=12):
    """Runs by comparing words for each period; smallest periods only."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            if length >= max(shortest, 2 * q):
                # a multiple of a smaller period spans the same stretch
                found.setdefault((i, length), q)
            i = end
    return sorted(((s, n_, q) for (s, n_), q in found.items()),
                  key=lambda r: (r[0], r[2]))


def brute_row(key, text):
    words = (text or "").encode().split()
    n = len(words)
    if key is not None:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (key, len(runs), *(best[0:1] + best[1:2] + best[2:3] if best
                              else (None, None, None)),
            best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest())


def rows(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        "runs_sha256", "collapsed_sha256").collect()), key=repr)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    for n in [0, 1, 11, 12, 13, 24, 40, 90, 200]:
        for _ in range(12):
            words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
            for _ in range(rng.randrange(4)):  # planted stretches
                if n > 20:
                    at, q = rng.randrange(n - 10), rng.randrange(1, 9)
                    for i in range(at + q, min(n, at + 6 * q)):
                        words[i] = words[i - q]
            assert pr.find_runs(pr.number_words(words)) == brute(words)


def test_fibonacci_word_and_long_texts():
    a, b = b"a", b"ab"
    while len(b) < 600:
        a, b = b, b + a
    words = [bytes([c]) for c in b]
    assert pr.find_runs(pr.number_words(words)) == brute(words)
    # very long texts: one word, three words, no repeat at all
    n = 200_000
    assert pr.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert pr.find_runs(np.arange(n) % 3) == [(0, n, 3)]
    assert pr.find_runs(np.arange(n)) == []


def test_six_words_in_a_row_are_needed():
    assert pr.find_runs(pr.number_words([b"x"] * 11)) == []
    assert pr.find_runs(pr.number_words([b"x"] * 12)) == [(0, 12, 1)]
    assert pr.find_runs(pr.number_words([b"x", b"y"] * 6)) == [(0, 12, 2)]


def test_operator_rows(spark):
    texts = {1: None, 2: "", 3: " \n\t", 4: "a b " * 9 + "c", 5: "é\xa0x " * 14,
             6: "z\x0b" * 30, 7: "one two"}
    docs = documents(spark, [(k, t, "en", "s") for k, t in texts.items()]
                     + [(None, "q " * 12, None, None), (4, "w", None, None)])
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed)
           for r in pr.periodic_runs(docs).collect()}
    assert got == {(1, 0): ([], ""), (2, 0): ([], ""), (3, 0): ([], ""),
                   (4, 19): ([(0, 18, 2)], "a b c"),
                   (5, 14): ([(0, 14, 1)], "é\xa0x"),
                   (6, 30): ([(0, 30, 1)], "z"), (7, 2): ([], "one two"),
                   (None, 12): ([(0, 12, 1)], "q"), (4, 1): ([], "w")}
    assert pr.periodic_runs(docs.limit(0)).count() == 0


@needs_data
def test_query_against_brute_force(spark):
    want = sorted((brute_row(r.doc_id, r.text) for r in spark.read.parquet(
        f"{SF}/documents.parquet").collect()), key=repr)
    assert rows(pr.op12_periodic_runs(spark, SF)) == want
    assert sum(r[1] > 0 for r in want) > 10


def test_made_periodic_of_null_and_short(spark, tmp_path):
    keys = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:6]
    texts = [None, "", "a", "a b", "a b c d e f g h i j k l m n o p q r s", " "]
    spark.createDataFrame([(k, t) for k, t in zip(keys, texts, strict=True)]
                          + [(None, "x y")], "doc_id long, text string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((brute_row(k, t) for k, t in
                   [*zip(keys, texts, strict=True), (None, "x y")]), key=repr)
    assert rows(pr.op12_periodic_runs(spark, str(tmp_path))) == want
