"""Documents assembled from extracted facts and dimension tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import extraction, fixed
from corpusloom.functions.text import filled, stripped
from corpusloom.operators import dictionary as tables
from corpusloom.operators.common import require_columns

RESPONSE_SCHEMA = "content array<struct<type: string, text: string>>"


def title_dim(spark: SparkSession, titles: Mapping[str, str] = fixed.TITLES
              ) -> DataFrame:
    return spark.createDataFrame(list(titles.items()),
                                 "category string, title string")


def template_dim(spark: SparkSession) -> DataFrame:
    """``(category, summary, resp, offers)``; null columns mean default."""
    names = {**fixed.SUMMARIES, **fixed.RESPONSIBILITIES, **fixed.OFFERS}
    rows = [(c, fixed.SUMMARIES.get(c), fixed.RESPONSIBILITIES.get(c),
             fixed.OFFERS.get(c)) for c in names if c is not None]
    return spark.createDataFrame(
        rows, "category string, summary string, resp array<string>, "
              "offers array<string>")


def extract(people: DataFrame, dictionary: extraction.Dictionary | DataFrame
            = fixed.SKILLS, key: str = "doc_id") -> DataFrame:
    """Add ``skills``, ``years`` (digits) and ``skill_groups``.

    ``dictionary`` is a mapping of some hundred phrases, or a table ``(domain,
    phrase, place)`` of any size; ``key`` must then tell the rows apart.
    """
    require_columns(people, "text")
    if isinstance(dictionary, DataFrame):
        found = tables.group_phrases(tables.find_phrases(
            people, dictionary, key), dictionary, key)
        return found.withColumn("years", extraction.years_digits(
            F.lower(filled(F.col("text")))))
    lowered = people.withColumn("_low", F.lower(filled(F.col("text"))))
    found = lowered.withColumn(
        "skills", extraction.find_phrases(F.col("_low"), dictionary))
    return (found.withColumn("years", extraction.years_digits(F.col("_low")))
            .withColumn("skill_groups", extraction.group_phrases(
                F.col("skills"), dictionary))
            .drop("_low"))


def with_title(extracted: DataFrame, titles: DataFrame | None = None
               ) -> DataFrame:
    """Add ``title``. The title table has one row per known category."""
    require_columns(extracted, "category", "skills")
    dim = (title_dim(extracted.sparkSession) if titles is None else titles)
    # the built-in table is fixed; a caller's own is left to run-time sizes
    side = F.broadcast(dim) if titles is None else dim
    return (extracted.join(side.withColumnRenamed("title", "_mapped"),
                           "category", "left")
            .withColumn("title", extraction.pick_title(
                F.col("category"), F.col("_mapped"), F.col("skills")))
            .drop("_mapped"))


def _lines(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(
        F.lit(fixed.BULLET), x)), "\n")


def _texts(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def stack_line(skills: Column) -> Column:
    return F.when(F.size(skills) > 0, F.array_join(skills, ", ")
                  ).otherwise(F.lit(fixed.NO_STACK))


def requirement_items(years: Column, groups: Column) -> Column:
    by_group = F.transform(groups, lambda g: F.concat(
        g["label"], F.lit(": "), F.array_join(g["phrases"], ", ")))
    return F.concat(
        F.array(F.concat(years, F.lit(fixed.YEARS_LINE))),
        F.when(F.size(groups) > 0, by_group).otherwise(
            _texts([fixed.NO_SKILL_LINE])),
        _texts(fixed.CLOSING_LINES))


def summary_text(template: Column, title: Column, years: Column) -> Column:
    filled_in = F.replace(F.coalesce(template, F.lit(fixed.SUMMARIES[None])),
                          F.lit("{title}"), title)
    return F.replace(filled_in, F.lit("{years}"), years)


def document_text(template: Column, resp: Column, offers: Column) -> Column:
    """The whole document, from the columns that :func:`with_title` leaves."""
    head, gap = fixed.HEADINGS, "\n\n"
    rule = fixed.RULE
    title, years = F.col("title"), F.col("years")
    pieces = [
        f"{rule}\n{head['title']}", title, f"\n{rule}{gap}",
        f"{head['summary']}\n", summary_text(template, title, years), gap,
        f"{head['responsibilities']}\n", _lines(F.coalesce(
            resp, _texts(fixed.RESPONSIBILITIES[None]))), gap,
        f"{head['requirements']}\n", _lines(requirement_items(
            years, F.col("skill_groups"))), gap,
        f"{head['stack']}\n  ", stack_line(F.col("skills")), gap,
        f"{head['offers']}\n", _lines(F.coalesce(
            offers, _texts(fixed.OFFERS[None]))), f"\n{rule}"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def with_document(titled: DataFrame, templates: DataFrame | None = None
                  ) -> DataFrame:
    """Add ``document``: one left join to a table of templates."""
    dim = template_dim(titled.sparkSession) if templates is None else templates
    side = F.broadcast(dim) if templates is None else dim
    return (titled.join(side, "category", "left")
            .withColumn("document", document_text(
                F.col("summary"), F.col("resp"), F.col("offers")))
            .drop("summary", "resp", "offers"))


def generate(people: DataFrame, titles: DataFrame | None = None,
             templates: DataFrame | None = None,
             dictionary: extraction.Dictionary | DataFrame = fixed.SKILLS
             ) -> DataFrame:
    """``text`` and ``category`` in, ``document`` and its facts added."""
    return with_document(with_title(extract(people, dictionary), titles),
                         templates)


def prompt(text: Column, category: Column | None = None,
           max_chars: int | None = fixed.PROMPT_CHARS) -> Column:
    """The text to send to a generation service, one per row.

    The text is cut to ``max_chars`` characters, ``None`` sends all of it.
    """
    hint = F.lit("")
    if category is not None:
        hint = F.when(category != "", F.concat(
            F.lit("Predicted category: "), category, F.lit("."))
        ).otherwise(F.lit(""))
    body = filled(text)
    if max_chars is not None:
        body = F.substring(body, 1, max_chars)
    return F.concat(F.lit(fixed.PROMPT_HEAD), hint, F.lit(fixed.PROMPT_BODY),
                    body)


def parse_response(body: Column) -> Column:
    """Text blocks of a response body, joined by newlines and stripped.

    Null if the body is not JSON or a text block has no text: such a response
    has failed. No text block at all is an empty text.
    """
    blocks = F.from_json(body, RESPONSE_SCHEMA)["content"]
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"),
                        lambda b: b["text"])
    broken = (F.get_json_object(body, "$").isNull()
              | F.coalesce(F.exists(texts, F.isnull), F.lit(False)))
    return F.when(~broken, stripped(F.array_join(texts, "\n")))


def with_fallback(documents: DataFrame, responses: DataFrame,
                  key: str = "doc_id") -> DataFrame:
    """Use a successful response, else the rule-based ``document``.

    An empty text is a success too. ``responses``: key, status, body.
    """
    good = responses.where(F.col("status") == "ok").select(
        key, parse_response(F.col("body")).alias("_written"))
    return (documents.join(good, key, "left")
            .withColumn("source", F.when(F.col("_written").isNotNull(),
                                         F.lit("response"))
                        .otherwise(F.lit("rules")))
            .withColumn("document", F.coalesce("_written", "document"))
            .drop("_written"))
