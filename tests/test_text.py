"""Cleaning, tokens, stems, lemmas and extraction on hand-made rows."""

import math
import re
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import (cleaning, extraction, fixed, stemming, text,
                                  tokens)
from corpusloom.operators import compose, lemma, preprocess


def column(spark, values, fn, name="text"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"id int, {name} string")
    return [r[0] for r in df.orderBy("id").select(fn(F.col(name))).collect()]


def test_clean_edges(spark):
    cases = {
        None: "", "": "", " \n\t ": "",
        "Mail a.b+c@x-y.org now": "mail now",
        "jean@site.fré": "jean site fre",          # no word edge after the tld
        "a@b.com.c@d.net": "",                    # two addresses in one run
        "call +1 (555)\n123-4567 today": "call today",
        "2015 - 2018": "",                         # long enough for a phone
        "2015-18": "2015 18",
        "see http://x.y/z?q=1, www.foo and bar.IO/x": "see and",
        "x.common": "",                            # holds .com
        "ﬁne ½ straße ÅΩ": "fine 12 strae a",
        "𝐁old nb sp": "bold nb sp",
        "C++ / C#": "c c",
    }
    assert column(spark, list(cases), cleaning.clean) == list(cases.values())


def test_clean_keeps_case_and_is_stable(spark):
    values = ["Some Words HERE", "plain words only"]
    assert column(spark, values, lambda c: cleaning.clean(c, False)) == values
    once = column(spark, values, cleaning.clean)
    assert column(spark, once, cleaning.clean) == once


def test_fold_every_code_point(spark):
    chars = [chr(c) for c in range(0x80, 0x110000)
             if not 0xD800 <= c < 0xE000]
    chunks = ["|".join(chars[i:i + 4096]) for i in range(0, len(chars), 4096)]
    want = [unicodedata.normalize("NFKD", c).encode("ascii", "ignore")
            .decode() for c in chunks]
    assert column(spark, chunks, cleaning.fold_ascii) == want


def test_space_classes_match_python(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    blank = column(spark, chars, lambda c: c.rlike(f"^{fixed.NONSPACE}\\z"))
    assert [c for c, b in zip(chars, blank) if b == c.isspace()] == []
    word = column(spark, chars, lambda c: c.rlike(f"^{fixed.WORD}\\z"))
    # the Unicode tables of the JVM are older: compare what both know
    odd = [c for c, w in zip(chars, word)
           if w != bool(re.match(r"\w", c)) and w]
    assert odd == []


def test_long_runs_stay_fast(spark):
    values = ["x" * 200_000, "1" * 200_000 + " y", "a." * 100_000]
    assert len(column(spark, values, cleaning.clean)) == 3


def test_tokenizers(spark):
    line = "i cannot use word3 gonna pythons x The THE"
    got = column(spark, [line], tokens.tokens_word)[0]
    assert got[:3] == ["i", "can", "not"] and "word3" in got
    assert got[got.index("gon") + 1] == "na"
    regex = column(spark, [line], lambda c: tokens.process_tokens(c))[0]
    assert regex == ["cannot", "use", "word", "gonna", "pythons"]
    word = column(spark, [line], lambda c: tokens.process_tokens(
        c, tokenizer="word", extra_stopwords=["USE"]))[0]
    assert word == ["gon", "na", "pythons"]
    with pytest.raises(ValueError):
        tokens.tokenize(F.lit(""), "other")


STEMS = """caresses caress ponies poni ties tie caress caress cats cat feed
feed agreed agre plastered plaster bled bled motoring motor sing sing conflated
conflat troubled troubl sized size hopping hop tanned tan falling fall hissing
hiss fizzed fizz failing fail filing file happy happi sky sky relational relat
conditional condit rational ration valenci valenc digitizer digit conformabli
conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness
good revival reviv allowance allow inference infer airliner airlin gyroscopic
gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt homologou homolog communism
commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll
roll dying die news news as as enjoy enjoy toys toy by by theology theolog
edition edit""".split()


def test_stem(spark):
    words, want = STEMS[::2], STEMS[1::2]
    got = column(spark, [" ".join(words)], lambda c: stemming.stem_tokens(
        F.split(c, " ")))[0]
    assert dict(zip(words, got)) == dict(zip(words, want))


def test_lemma(spark):
    forms = ["cats", "women", "boxes", "classes", "flies", "geese", "as",
             "unknowns", "wolves", "s", "caresses"]
    forms_df = spark.createDataFrame([(f,) for f in forms], "form string")
    lexicon = spark.createDataFrame([(w,) for w in (
        "cat woman box class fly goose wolf cares a caress".split())],
        "lemma string")
    irregular = spark.createDataFrame([("geese", "goose")],
                                      "form string, lemma string")
    got = {r.form: r.lemma for r in lemma.lemma_map(
        forms_df, lexicon, irregular).collect()}
    assert got == {"cats": "cat", "women": "woman", "boxes": "box",
                   "classes": "class", "flies": "fly", "geese": "goose",
                   "as": "a", "unknowns": "unknowns", "wolves": "wolf",
                   "s": "s", "caresses": "caress"}


def test_lemma_in_place(spark):
    df = spark.createDataFrame([(1, "cats and boxes chase cats"), (2, "")],
                               "doc_id long, cleaned string")
    lexicon = spark.createDataFrame([("cat",), ("box",)], "lemma string")
    rows = preprocess.with_tokens(df, lexicon=lexicon).orderBy("doc_id")
    assert [r.processed for r in rows.collect()] == ["cat box chase cat", ""]


def test_lemmas_read_the_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "cats box"), (1, "box cats"), (None, "dogs"),
                           (2, "")], "doc_id long, cleaned string"
                          ).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([("cat",), ("dog",)], "lemma string").write.parquet(
        f"{tmp_path}/words")
    rows = preprocess.with_tokens(
        spark.read.parquet(f"{tmp_path}/docs"),
        lexicon=spark.read.parquet(f"{tmp_path}/words")).select("processed")
    # rows of one key are one document
    assert sorted(r.processed for r in rows.collect()) == [
        "", "box cat box cat", "dog"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert sum("FileScan" in line and "/docs" in line
               for line in final.splitlines()) == 1


def test_bound_of_changed_forms(spark):
    some, many = (spark.range(n).toDF("lemma") for n in (300_000, 600_000))
    assert lemma._changed_bound(some, many) is not None
    assert lemma._changed_bound(many, None) is None


def test_years(spark):
    cases = {"0 years": "0", "": "1", "5+ yrs 12 years": "12",
             "10 Years": "10", "007 yr": "7", "٣ years": "3",
             "9" * 50 + "years": "9" * 50, "12 months": "1", None: "1"}
    assert column(spark, list(cases), extraction.years_digits) == list(
        cases.values())
    assert column(spark, ["9" * 50 + " years"], extraction.years) == [None]
    assert column(spark, ["9" * 38 + " years"], extraction.years) == [
        Decimal("9" * 38)]


def test_text_helpers(spark):
    assert column(spark, ["ab"], text.snippet) == ["ab..."]
    assert column(spark, ["x" * 300], text.snippet) == ["x" * 250 + "..."]
    assert column(spark, [" a b\x1fc ", None], text.word_count) == [3, 0]
    assert column(spark, ["　 " + "a" * 20, "a" * 19 + "\n"],
                  lambda c: text.guard_status(c, 20)) == ["accepted",
                                                          "rejected"]


def test_document_defaults_and_groups(spark):
    rows = [(1, None, "ID"), (2, "Nowhere", "docker 3 years, JUnit"),
            (3, "HR", "scikit-learn")]
    df = spark.createDataFrame(rows, "doc_id long, category string, "
                                     "text string")
    got = {r.doc_id: r for r in compose.generate(df).collect()}
    assert got[1].title == "Software Engineer" and got[1].skills == []
    assert "  - Strong software engineering fundamentals" in got[1].document
    assert "TECH STACK\n  General technical skills" in got[1].document
    assert "1+ years of experience" in got[1].document
    labels = [g.label for g in got[2].skill_groups]
    assert labels == ["Data Science", "Backend", "Devops", "Java", "Testing"]
    assert got[2].title == "DevOps / Platform Engineer"
    assert got[3].title == "HR Business Partner"
    assert got[1].document.count("─" * 50) == 3
    for row in got.values():
        assert "{" not in row.document


def test_prompt_response_fallback(spark):
    long = "y" * 4000
    prompt = column(spark, [long], lambda c: compose.prompt(c, F.lit("HR")))[0]
    assert "Predicted category: HR." in prompt and prompt.endswith("y" * 3000)
    assert prompt.count("y" * 3001) == 0
    none = column(spark, ["t"], lambda c: compose.prompt(c))[0]
    assert "Predicted" not in none
    bodies = ['{"content":[{"type":"text","text":" a"},{"type":"x"},'
              '{"type":"text","text":"b "}]}', "{}", "not json",
              '{"content":[{"type":"text"}]}']
    assert column(spark, bodies, compose.parse_response) == ["a\nb", "", None,
                                                             None]
    docs = spark.createDataFrame([(i, "rule") for i in range(4)],
                                 "doc_id long, document string")
    resp = spark.createDataFrame(
        [(0, "ok", bodies[0]), (1, "ok", "{}"), (2, "failed", bodies[0])],
        "doc_id long, status string, body string")
    out = compose.with_fallback(docs, resp).orderBy("doc_id").collect()
    assert [r.document for r in out] == ["a\nb", "", "rule", "rule"]


def test_percent_rounds_half_up(spark):
    got = spark.range(1).select(text.percent(F.lit(0.1225)),
                                text.clamp(F.lit(1.5))).first()
    assert math.isclose(got[0], 12.3) and got[1] == 1.0
