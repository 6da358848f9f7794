"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1. For each position a binary linear
classifier over character n-grams tells the languages with +1 from those with
-1. A text is decoded to the language whose codeword has the smallest loss
against the classifiers' margins, each position weighted by how well it did for
that language in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import free_name, table

BUCKETS = 1 << 14           # hashed character n-grams
SAMPLE_PER_LANGUAGE = 1_000  # most texts per language that a fit reads
MAX_LANGUAGES = 256
AMBIGUOUS = 0.6             # below this score the two best are too close
UNDETERMINED = "und"
# Multipliers of the n-gram hash, any odd numbers will do.
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_CHUNK = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once in each process."""
    if not _letters:
        _letters.append(np.fromiter(
            (chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_codes(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all letters, pairs and triples of a whole text, in chunks.

    Anything but letters counts as a blank; n-grams begin and end with at
    least one letter in them. A text without letters gives no codes.
    """
    if not text:
        return
    text, letters = text.lower(), _is_letter()
    for start in range(0, len(text), _CHUNK):
        # two characters of overlap, so that no triple is lost
        part = text[max(0, start - 2):start + _CHUNK]
        code = np.frombuffer(
            f"  {part}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(letters[code], code, np.uint32(0))
        if start:
            code = code[2:]
        if start + _CHUNK < len(text):
            code = code[:-2]
        a, b, c = code[:-2], code[1:-1], code[2:]
        one, two, three = (m * x for m, x in zip(_MULTIPLIERS, (c, b, a),
                                                 strict=True))
        last = c > 0
        pair, triple = one + two, one + two + three
        found = np.concatenate([
            one[last], (pair ^ np.uint32(0x55555555))[last | (b > 0)],
            (triple ^ np.uint32(0x33333333))[(b > 0) & ((a > 0) | last)]])
        mixed = (found ^ (found >> np.uint32(15))) * np.uint32(2246822519)
        yield (mixed >> np.uint32(18)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An n x bits matrix of +1 and -1.

    Up to six languages get the exhaustive code; more get the random code of
    ceil(12 log2 n) bits whose closest two words are farthest apart among 100
    drawn with a fixed seed.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        bits = np.arange(1, 1 << (n - 1))
        rows = [np.ones(len(bits), int)] + [
            np.where(bits >> i & 1, -1, 1) for i in range(n - 1)]
        return np.array(rows, float)
    rng, best, apart = np.random.default_rng(seed), None, -1
    width = int(np.ceil(12 * np.log2(n)))
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, width))
        code[0, np.abs(code.sum(0)) == n] *= -1
        gap = int(((width - code @ code.T) / 2 + width * np.eye(n)).min())
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass
class Model:
    """Languages, codewords, n-gram weights per bit, and decoding weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, text: str | None) -> np.ndarray | None:
        """Mean log-odds of each bit over all n-grams of the whole text."""
        total, n = np.zeros(self.code.shape[1]), 0
        for codes in ngram_codes(text):
            if len(codes) > BUCKETS:
                total += np.bincount(codes, minlength=BUCKETS) @ self.weights
            else:
                total += self.weights[codes].sum(0)
            n += len(codes)
        return total / n if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether it is ambiguous."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        margin = self.margins(text)
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = (self.trust * np.logaddexp(0, -4 * self.code * margin)).sum(1)
        odds = np.exp(-8 * (loss - loss.min()))
        best = int(odds.argmax())  # ties: the first in order of the alphabet
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, score < AMBIGUOUS


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def sample(labelled: DataFrame, key: str, lang: str, text: str,
           per_language: int) -> DataFrame:
    """At most ``per_language`` labelled texts each, picked by a key hash.

    The picks are keys only; their texts are fetched by a join, so no text is
    sorted.
    """
    order = Window.partitionBy(lang).orderBy(F.xxhash64(key), key)
    picked = (labelled.select(key, lang)
              .withColumn("_n", F.row_number().over(order))
              .where(F.col("_n") <= per_language)
              .select(F.col(key).alias("_key")).distinct())
    # at most per_language keys for each of MAX_LANGUAGES languages
    return (labelled.join(F.broadcast(picked), F.col(key) == F.col("_key"))
            .select(F.col(lang).alias("lang"), F.col(text).alias("text")))


def fit(labelled: DataFrame, key: str = "doc_id", lang: str = "lang",
        text: str = "text", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on the rows of ``labelled`` with a language; rows without are left.

    It reads the whole texts of a bounded sample: ``per_language`` for each of
    at most MAX_LANGUAGES languages, else it raises. Spark counts the n-grams
    per language; the driver gets one count per language and bucket. Without
    any label the model knows no language and answers ``und``.
    """
    labelled = labelled.where(F.col(lang).isNotNull())
    texts = sample(labelled, key, lang, text, per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.lang, batch.text, strict=True):
                into = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                for codes in ngram_codes(body):
                    into += np.bincount(codes, minlength=BUCKETS)
        for name, into in sums.items():
            at = np.flatnonzero(into)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": into[at]})

    counted = (texts.mapInPandas(count, "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    names = sorted(r[0] for r in labelled.select(lang).distinct()
                   .limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = counted.toPandas()  # at most MAX_LANGUAGES * BUCKETS numbers
    share = np.zeros((len(names), BUCKETS))
    index = {name: i for i, name in enumerate(names)}
    share[rows.lang.map(index).astype(int), rows.bucket] = rows.n
    share /= np.maximum(1, share.sum(1, keepdims=True))
    code = codewords(len(names))
    weights = np.zeros((BUCKETS, code.shape[1]))
    if len(names) > 1:
        plus, minus = (code > 0).astype(float), (code < 0).astype(float)
        weights = np.log(
            (share.T @ plus / plus.sum(0) + 1e-6)
            / (share.T @ minus / minus.sum(0) + 1e-6))
    model = Model(names, code, weights.astype(np.float32),
                  np.ones(code.shape) / max(1, code.shape[1]))
    if len(names) > 1:
        model.trust = _trust(model, texts)
    return model


def _trust(model: Model, texts: DataFrame) -> np.ndarray:
    """How often each bit was right for each language; rows sum to one."""
    index = {name: i for i, name in enumerate(model.languages)}
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        right = np.zeros(model.code.shape)
        for batch in batches:
            for name, body in zip(batch.lang, batch.text, strict=True):
                margin = model.margins(body)
                if margin is not None:
                    right[index[name]] += model.code[index[name]] * margin > 0
        at = np.nonzero(right)
        yield pd.DataFrame({"i": at[0], "bit": at[1], "n": right[at]})

    rows = (texts.mapInPandas(judge, "i int, bit int, n double")
            .groupBy("i", "bit").agg(F.sum("n").alias("n")).toPandas())
    trust = np.full(model.code.shape, 1e-3)
    trust[rows.i, rows.bit] += rows.n
    return trust / trust.sum(1, keepdims=True)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and ambiguous to every row of ``docs``.

    Null and empty texts, and texts without a letter, are ``und`` with score 0
    and ambiguous. Long texts are read whole, in chunks. Columns of ``docs``
    that already have one of the three names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decode(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts],
                            columns=["lang_pred", "score", "ambiguous"])

    found = free_name(docs.columns, "_found")
    return (docs.withColumn(found, decode(F.col(text)))
            .select(*docs.columns, f"{found}.*"))


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    apart = held_out(F.col("doc_id"))
    model = fit(docs.where(~apart))
    return identify(docs.select("doc_id", apart.alias("held_out"), "text"),
                    model).drop("text")
