"""Dictionary lemmas for noun forms, driven by a lexicon table.

``lexicon(lemma)`` lists the base forms; ``exceptions(form, lemma)`` lists
irregular ones. A form maps to its shortest known candidate; unknown forms
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.operators.common import (BROADCAST_ROWS, has_at_most,
                                         join_small)
from corpusloom.operators.token_rows import gathered, spread


def _shorter(form: Column) -> Column:
    """Every candidate one ending away, in the order of the ending table."""
    return F.array_compact(F.array(*[
        F.when(form.endswith(old), F.concat(
            F.substring(form, F.lit(1), F.length(form) - len(old)),
            F.lit(new)))
        for old, new in fixed.NOUN_ENDINGS]))


def _candidates(form: Column) -> Column:
    """``array<struct<round, candidate>>`` in the order they are tried.

    Round 1 is the form itself and one ending less. Later rounds take off
    more; they run until no ending is left, at most once per letter.
    """
    def tag(forms: Column, number: Column) -> Column:
        return F.transform(forms, lambda f: F.struct(
            number.cast("int").alias("round"), f.alias("candidate")))

    first = F.struct(
        _shorter(form).alias("forms"),
        tag(F.concat(F.array(form), _shorter(form)), F.lit(1)).alias("all"))

    def again(state: Column, number: Column) -> Column:
        forms = F.flatten(F.transform(state["forms"], _shorter))
        return F.struct(forms.alias("forms"),
                        F.concat(state["all"], tag(forms, number)).alias("all"))

    def step(state: Column, number: Column) -> Column:
        return F.when(F.size(state["forms"]) > 0, again(state, number)
                      ).otherwise(state)

    return F.aggregate(F.sequence(F.lit(2), F.length(form) + 2), first, step,
                       lambda state: state["all"])


def lemma_map(forms: DataFrame, lexicon: DataFrame,
              exceptions: DataFrame | None = None) -> DataFrame:
    """``(form, lemma)`` for a table of distinct ``form`` values."""
    form = F.col("form")
    regular = (forms.select("form", F.posexplode(_candidates(form))
                            .alias("turn", "c"))
               .select("form", "c.round", "turn", "c.candidate"))
    if exceptions is None:
        proposed = regular
    else:
        # a listed form has itself and its listed lemmas as only candidates
        listed = (forms.join(exceptions, "form")
                  .select("form", F.lit(1).alias("round"),
                          F.lit(1).alias("turn"),
                          F.col("lemma").alias("candidate")))
        itself = (forms.join(exceptions, "form", "left_semi")
                  .select("form", F.lit(1).alias("round"),
                          F.lit(0).alias("turn"), form.alias("candidate")))
        proposed = (regular.join(exceptions, "form", "left_anti")
                    .unionByName(itself).unionByName(listed))
    known = proposed.join(
        lexicon.select(F.col("lemma").alias("candidate")), "candidate",
        "left_semi")
    best = known.groupBy("form").agg(F.min(F.struct(
        "round", F.length("candidate").alias("size"), "turn", "candidate"))
        .alias("best"))
    return (forms.join(best, "form", "left")
            .select("form", F.coalesce("best.candidate", "form")
                    .alias("lemma")))


def lemmatize_tokens(df: DataFrame, lexicon: DataFrame,
                     exceptions: DataFrame | None = None,
                     key: str = "doc_id") -> DataFrame:
    """Replace ``tokens`` by their lemmas, keeping order and empty rows.

    The rules run once per distinct token. Rows move once, by ``key``, and both
    the distinct tokens and the token rows read that shuffle. With a small
    lexicon the forms that change are few and are broadcast, so token rows stay
    where they are; else the hot ones are dealt out over salts by their own
    number.
    """
    # a generator of one row looks at all columns, so that both uses read one
    # shuffle, whichever columns they need
    placed = df.repartition(key).select("*", F.explode(F.array(F.xxhash64(
        *df.columns))).alias("_n")).drop("_n")
    # an inner explode would put a filter on the tokens below the shuffle, which
    # is then another one, and makes the tokens twice
    counts = (placed.select(F.explode_outer("tokens").alias("form"))
              .where(F.col("form").isNotNull()).groupBy("form")
              .agg(F.count(F.lit(1)).alias("df")))
    changed = (lemma_map(counts.select("form"), lexicon, exceptions)
               .where(F.col("form") != F.col("lemma")))
    rows = spread(placed, key).withColumnRenamed("token", "form")
    named = join_small(rows, changed, "form",
                       _changed_bound(lexicon, exceptions), "left", counts)
    return gathered(named.select(key, "pos", "rest", F.coalesce(
        "lemma", "form").alias("token")), df.columns, key)


def _changed_bound(lexicon: DataFrame, exceptions: DataFrame | None
                   ) -> int | None:
    """About the most forms that change, if that is small: the listed ones, and
    two for each lemma, as no lemma has the tail of more than two endings. Forms
    with several endings are few."""
    if not has_at_most(lexicon, BROADCAST_ROWS // 4) or (
            exceptions is not None
            and not has_at_most(exceptions, BROADCAST_ROWS // 2)):
        return None
    return BROADCAST_ROWS
