"""The same results in plain SQL, for comparison in DuckDB.

Written apart from the operators: patterns are in RE2 syntax, weights are
joins over n-gram rows, ranks are full windows without any shortcut.
"""

from __future__ import annotations

from corpusloom.functions import fixed
from corpusloom.functions.extraction import dictionary_phrases
from corpusloom.plans.catalog import (EXTRA_STOPWORDS, FILTERS, LEXICON_DOCS,
                                      PEOPLE_CATEGORIES)
from corpusloom.sources.corpus import INLINE_ROWS

WORD = r"\p{L}\p{N}_"
BLANK = (r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, 'g')"


def no_mail(x: str) -> str:
    return sub(x, rf"\b[{WORD}.+-]+@[{WORD}-]+\.[a-zA-Z]{{2,}}\b", " ")


def no_phone(x: str) -> str:
    return sub(x, rf"\+?\p{{Nd}}[\p{{Nd}}{BLANK}\-().]{{7,}}\p{{Nd}}", " ")


def no_url(x: str) -> str:
    return sub(x, rf"(?i)https?://[^{BLANK}]+|www\.[^{BLANK}]+"
                  rf"|[^{BLANK}]+\.(?:com|org|net|io|edu|gov)[^{BLANK}]*", " ")


def fold(x: str) -> str:
    return sub(f"strip_accents({x})", r"[^\x00-\x7F]", "")


def cleaned(x: str, lower: bool = True) -> str:
    out = fold(no_url(no_phone(no_mail(f"coalesce({x}, '')"))))
    out = sub(sub(out, r"[^a-zA-Z0-9\s]", " "), r"\s+", " ")
    return f"trim(lower({out}))" if lower else f"trim({out})"


def letters(x: str) -> str:
    return f"regexp_extract_all({x}, '[a-zA-Z]+')"


def unstopped(x: str, extra=()) -> str:
    words = sorted(set(fixed.STOPWORDS) | {w.lower() for w in extra})
    listed = ", ".join(lit(w) for w in words)
    return f"list_filter({x}, lambda w: lower(w) NOT IN ({listed}))"


def processed(x: str) -> str:
    return f"list_filter({unstopped(letters(x))}, lambda w: length(w) >= 2)"


def by_blank(x: str) -> str:
    for a, b in fixed.FUSED_WORDS:
        x = sub(x, rf"(?i)\b({a})({b})\b", r"\1 \2")
    return f"regexp_extract_all({x}, '[^ ]+')"


def joined(x: str, sep: str = " ") -> str:
    return f"array_to_string({x}, {lit(sep)})"


def stripped(x: str) -> str:
    return sub(x, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def corpus(label: str = "lang") -> str:
    return (f"corpus AS (SELECT doc_id, {label} AS category, text FROM "
            f"documents WHERE {label} IS NOT NULL AND text IS NOT NULL)")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def digest(x: str, source: str = "corpus") -> str:
    return (f"SELECT doc_id, md5(v) AS digest, length(v)::INT AS n_chars FROM "
            f"(SELECT doc_id, {x} AS v FROM {source})")


def token_digest(x: str) -> str:
    return (with_(corpus(), "c AS (SELECT doc_id, "
                  f"{cleaned('text')} AS cleaned FROM corpus)")
            + "SELECT doc_id, len(t)::INT AS n_tokens, "
              f"md5({joined('t')}) AS digest FROM "
              f"(SELECT doc_id, {x} AS t FROM c)")


def token_rows(name: str, source: str, key: str = "doc_id",
               keep: str = ", category", min_chars: int | None = None) -> str:
    """CTE with the tokens of every row of ``source``."""
    where = ("" if min_chars is None
             else f" WHERE length({joined('t')}) > {min_chars}")
    return (f"{name} AS MATERIALIZED (SELECT * FROM (SELECT {key}{keep}, "
            f"{processed(cleaned('text'))} AS t FROM {source}){where})")


def gram_rows(name: str, source: str, key: str = "doc_id",
              keep: str = ", category") -> str:
    return (f"{name} AS (SELECT {key}{keep}, unnest(t) AS term FROM {source} "
            f"UNION ALL SELECT {key}{keep}, t[i] || ' ' || t[i + 1] FROM "
            f"(SELECT {key}{keep}, t, unnest(range(1, len(t))) AS i "
            f"FROM {source}))")


def count_rows(name: str, source: str, key: str = "doc_id",
               keep: str = ", category") -> str:
    return (f"{name} AS MATERIALIZED (SELECT {key}{keep}, term, count(*) AS "
            f"tf FROM {source} GROUP BY {key}{keep}, term)")


BASE = [corpus(), token_rows("toks", "corpus"), gram_rows("grams", "toks"),
        count_rows("tfs", "grams"),
        "dfs AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM tfs "
        "GROUP BY term)"]
BAG = BASE + [
    "kept AS (SELECT * FROM dfs WHERE df >= 2 AND df <= 0.95 * "
    "(SELECT count(*) FROM corpus) ORDER BY cf DESC, term LIMIT 20000)",
    "vocab AS MATERIALIZED (SELECT term, (row_number() OVER (ORDER BY term) "
    "- 1)::INT AS term_idx, cf, df FROM kept)",
    "bag AS MATERIALIZED (SELECT doc_id, category, term_idx, term, tf FROM "
    "tfs JOIN vocab USING (term))"]


def weights(name: str, source: str, key: str = "doc_id",
            keep: str = "") -> str:
    """Unit-length TF-IDF rows of a count table."""
    return (f"{name} AS MATERIALIZED (SELECT {key}{keep}, term, term_idx, tf,"
            f" raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS w FROM"
            f" (SELECT {key}{keep}, term, term_idx, tf, (1 + ln(tf)) * idf "
            f"AS raw FROM {source} JOIN vocab USING (term)))")


def fit(label: str = "lang", source: str | None = None) -> list[str]:
    return [
        source or corpus(label),
        token_rows("toks", "corpus", min_chars=10),
        gram_rows("grams", "toks"), count_rows("tfs", "grams"),
        "vocab AS MATERIALIZED (SELECT term, (row_number() OVER (ORDER BY "
        "term) - 1)::INT AS term_idx, cf, df, ln((1 + (SELECT count(*) FROM "
        "toks)) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf)::BIGINT AS "
        "cf, count(*) AS df FROM tfs GROUP BY term ORDER BY cf DESC, term "
        "LIMIT 10000))",
        weights("wts", "tfs", keep=", category"),
        "lab AS (SELECT category, count(*) AS n, min(doc_id) AS first_id "
        "FROM toks GROUP BY category)",
        "cen AS MATERIALIZED (SELECT category, term, term_idx, sum(w) / n "
        "AS cw FROM wts JOIN lab USING (category) GROUP BY category, n, "
        "term, term_idx)",
        "cnorm AS (SELECT category, sqrt(sum(cw * cw)) AS norm FROM cen "
        "GROUP BY category)"]


def vectors(source: str, key: str) -> list[str]:
    return [token_rows("qtoks", source, key, ""),
            gram_rows("qgrams", "qtoks", key, ""),
            count_rows("qtfs", "qgrams", key, ""),
            weights("qw", "qtfs", key)]


def scores(key: str = "doc_id") -> str:
    """Every text of ``qtoks`` against every label."""
    return (f"sc AS (SELECT q.{key}, l.category, l.first_id, "
            "round(coalesce(d.dot / c.norm, 0.0), 9) AS score "
            "FROM qtoks q CROSS JOIN lab l LEFT JOIN cnorm c ON "
            f"c.category = l.category LEFT JOIN (SELECT {key}, category, "
            "sum(w * cw) AS dot FROM qw JOIN cen USING (term) GROUP BY "
            f"{key}, category) d ON d.{key} = q.{key} AND d.category = "
            "l.category)")


def ranked(key: str = "doc_id") -> str:
    return (f"rk AS (SELECT {key}, category, score, (row_number() OVER "
            f"(PARTITION BY {key} ORDER BY score DESC, first_id))::INT AS "
            "rank FROM sc)")


TURNS = "SELECT conv_id * 100000 + turn AS {} , text FROM conversations"
BENCH = "bench AS (SELECT item_id AS query_id, text FROM benchmark)"


def long_turns(name: str, key: str, n: int) -> str:
    return (f"{name} AS (SELECT * FROM ({TURNS.format(key)}) WHERE "
            f"length({stripped('text')}) >= {n})")


def matches(asked: str, extra: list[str]) -> list[str]:
    """Full ranking of all documents for all queries of ``asked``, which has
    query_id, text, top_n and flt."""
    return fit() + extra + vectors(asked, "query_id") + [
        "sims AS (SELECT query_id, doc_id, sum(q.w * d.w) AS s FROM qw q "
        "JOIN wts d USING (term) GROUP BY query_id, doc_id)",
        "pairs AS (SELECT a.query_id, a.top_n, t.doc_id, t.category, CASE "
        "WHEN a.flt IS NULL OR a.flt = t.category THEN "
        "round(coalesce(s, 0.0), 9) ELSE -1.0 END AS score "
        f"FROM {asked} a CROSS JOIN toks t LEFT JOIN sims USING (query_id, "
        "doc_id))",
        "best AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER "
        "BY score DESC, doc_id DESC))::INT AS rank FROM pairs QUALIFY rank "
        "<= top_n)"]


# -- composed inputs ---------------------------------------------------------

def nth(values, number: str) -> str:
    return f"({items(values)})[({number}) % {len(values)} + 1]"


PHRASES = dictionary_phrases(fixed.SKILLS)
PEOPLE = f"""people AS (SELECT c_custkey AS doc_id,
 CASE WHEN c_custkey % 11 <> 10 THEN {nth(PEOPLE_CATEGORIES, 'c_custkey')} END
 AS category,
 CASE WHEN c_custkey % 17 = 0 THEN 'Id ' || c_custkey ELSE
 'Record of ' || c_name || ' in ' || c_mktsegment || CASE c_custkey % 5
 WHEN 0 THEN '' WHEN 1 THEN ', ' || (c_custkey % 20) || '+ years'
 WHEN 2 THEN ', ' || (c_custkey % 13) || ' yrs and ' || c_nationkey ||
 ' years' WHEN 3 THEN ', 0 years' ELSE ', ' || c_nationkey || ' Years' END
 || ' with ' || {nth(PHRASES, 'c_custkey * 7')} || ' and ' ||
 upper({nth(PHRASES, 'c_custkey * 13 + c_nationkey')}) END AS text
 FROM customer)"""

RESPONSES = """responses AS (SELECT c_custkey AS doc_id,
 CASE WHEN c_custkey % 4 = 3 THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN c_custkey % 6 = 0 THEN '{}'
 WHEN c_custkey % 6 = 1 THEN '{"content": []}'
 ELSE '{"content": [{"type": "text", "text": "  ' || c_name ||
 '"}, {"type": "tool", "text": "no"}, {"type": "text", "text": "' ||
 c_mktsegment || ' "}]}' END AS body FROM customer)"""

WRITTEN = """written AS (SELECT doc_id, status, trim(array_to_string(
 list_transform(list_filter(coalesce(CAST(json_extract(body, '$.content[*]')
 AS JSON[]), []), lambda b: b->>'$.type' = 'text'),
 lambda b: b->>'$.text'), chr(10))) AS txt FROM responses)"""

SKILLS = (f"list_filter({items(PHRASES)}, lambda p: "
          "contains(lower(text), p))")
YEARS = ("coalesce(list_max(list_transform(regexp_extract_all(lower(text), "
         r"'(\d+)\+?\s*(?:years?|yrs?)', 1), lambda n: n::HUGEINT)), 1)")


def groups() -> str:
    """List of 'Domain: a, b' lines, empty domains left out."""
    parts = []
    for domain, phrases in fixed.SKILLS.items():
        label = domain.replace("_", " ").title()
        hit = f"list_filter(skills, lambda p: list_contains({items(phrases)}, p))"
        parts.append(f"CASE WHEN len({hit}) > 0 THEN {lit(label + ': ')} || "
                     f"{joined(hit, ', ')} END")
    return ("list_filter([" + ", ".join(parts)
            + "], lambda g: g IS NOT NULL)")


def by_category(table: dict, render) -> str:
    cases = " ".join(f"WHEN {lit(c)} THEN {render(v)}"
                     for c, v in table.items() if c is not None)
    default = render(table[None]) if None in table else "NULL"
    return f"CASE category {cases} ELSE {default} END"


def title_sql() -> str:
    rules = " ".join(
        f"WHEN list_has_any(skills, {items(ps)}) THEN {lit(t)}"
        for ps, t in fixed.TITLE_BY_SKILL)
    return (f"coalesce({by_category(fixed.TITLES, lit)}, CASE {rules} ELSE "
            f"{lit(fixed.DEFAULT_TITLE)} END)")


def bullets(values) -> str:
    return lit("\n".join(fixed.BULLET + v for v in values))


def document_sql() -> str:
    h, rule = fixed.HEADINGS, fixed.RULE
    summary = (f"replace(replace({by_category(fixed.SUMMARIES, lit)}, "
               "'{title}', title), '{years}', years::VARCHAR)")
    lines = (f"[years::VARCHAR || {lit(fixed.YEARS_LINE)}] || CASE WHEN "
             f"len(groups) > 0 THEN groups ELSE {items([fixed.NO_SKILL_LINE])}"
             f" END || {items(fixed.CLOSING_LINES)}")
    bulleted = joined(f"list_transform({lines}, lambda x: "
                      f"{lit(fixed.BULLET)} || x)", "\n")
    stack = (f"CASE WHEN len(skills) > 0 THEN {joined('skills', ', ')} ELSE "
             f"{lit(fixed.NO_STACK)} END")
    parts = [
        lit(f"{rule}\n{h['title']}"), "title",
        lit(f"\n{rule}\n\n{h['summary']}\n"), summary,
        lit(f"\n\n{h['responsibilities']}\n"),
        by_category(fixed.RESPONSIBILITIES, bullets),
        lit(f"\n\n{h['requirements']}\n"), bulleted,
        lit(f"\n\n{h['stack']}\n  "), stack, lit(f"\n\n{h['offers']}\n"),
        by_category(fixed.OFFERS, bullets), lit(f"\n{rule}")]
    return " || ".join(f"({p})" for p in parts)


def facts(source: str = "people") -> list[str]:
    return [
        f"found AS (SELECT *, {SKILLS} AS skills, {YEARS} AS years FROM "
        f"{source})",
        f"titled AS (SELECT *, {title_sql()} AS title, {groups()} AS groups "
        "FROM found)",
        f"docs AS (SELECT *, {document_sql()} AS document FROM titled)"]


# -- stemming and lemmas -----------------------------------------------------

V, C = "[aeiouy]", "[^aeiouy]"
M1, M2 = f"{V}{C}", f"{V}{C}.*{V}{C}"
CVC = f"(?:{C}{V}[^aeiouywxY]|^{V}{C})$"


def cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def ends(suffix: str) -> str:
    return f"suffix(w, {lit(suffix)})"


def case(branches, default: str = "w") -> str:
    return ("CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
            + f" ELSE {default} END")


def suffix_step(rules, measure: str) -> str:
    out = []
    for suffix, new in rules:
        n = len(suffix)
        stem = cut("w", n - 1 if suffix == "logi" else n)
        ok = has(stem, measure)
        if suffix == "ion":
            ok += " AND " + has(cut("w", n), "[st]$")
        out.append((ends(suffix), f"CASE WHEN {ok} THEN {cut('w', n)} || "
                                  f"{lit(new)} ELSE w END"))
    return case(out)


def stem_sql() -> str:
    last, before = "right(s, 1)", "left(right(s, 2), 1)"
    repair = case([
        (has("s", "(?:at|bl|iz)$"), "s || 'e'"),
        (f"length(s) > 1 AND lower({last}) = lower({before}) AND "
         + has("s", f"{C}$"),
         f"CASE WHEN {has('s', '[lsz]$')} THEN s ELSE {cut('s', 1)} END"),
        (f"{has('s', M1)} AND NOT {has('s', M2)} AND {has('s', CVC)}",
         "s || 'e'")], "s")
    ies = f"CASE WHEN length(w) = 4 THEN {cut('w', 1)} ELSE {cut('w', 2)} END"
    stem_e = cut("w", 1)
    steps = [
        case([(ends("ies"), ies), (ends("sses"), cut("w", 2)),
              (ends("ss"), "w"), (ends("s"), cut("w", 1))]),
        case([(ends("ied"), ies),
              (ends("eed"), f"CASE WHEN {has(cut('w', 3), M1)} THEN "
                            f"{cut('w', 1)} ELSE w END"),
              (f"{ends('ed')} AND {has(cut('w', 2), V)}",
               f"{cut('w', 2)} || '+'"),
              (f"{ends('ing')} AND {has(cut('w', 3), V)}",
               f"{cut('w', 3)} || '+'")]),
        f"CASE WHEN suffix(w, '+') THEN (SELECT {repair} FROM (SELECT "
        f"{cut('w', 1)} AS s)) ELSE w END",
        case([(has("w", f".{C}[yY]$"), f"{cut('w', 1)} || 'i'")]),
        case([(f"{ends('alli')} AND {has(cut('w', 4), M1)}", cut("w", 2))]),
        suffix_step(fixed.PORTER_STEP2, M1),
        suffix_step(fixed.PORTER_STEP3, M1),
        suffix_step([(s, "") for s in fixed.PORTER_STEP4], M2),
        case([(f"{ends('e')} AND ({has(stem_e, M2)} OR ({has(stem_e, M1)} "
               f"AND NOT {has(stem_e, CVC)}))", stem_e)]),
        case([(f"{ends('ll')} AND {has(stem_e, M2)}", stem_e)])]
    mark = sub(sub("form", "(^|[aeiou])y", r"\1Y"), "yy", "yY")
    ctes = [corpus(), token_rows("toks", "corpus"),
            "forms AS (SELECT DISTINCT unnest(t) AS form FROM toks)",
            f"s0 AS (SELECT form, {mark} AS w FROM forms)"]
    for i, step in enumerate(steps):
        ctes.append(f"s{i + 1} AS (SELECT form, {step} AS w FROM s{i})")
    irregular = " ".join(f"WHEN {lit(a)} THEN {lit(b)}"
                         for a, b in fixed.PORTER_IRREGULAR.items())
    return with_(*ctes) + (
        f"SELECT form, CASE form {irregular} ELSE CASE WHEN length(form) <= 2"
        f" THEN form ELSE lower(w) END END AS stem FROM s{len(steps)}")


def lemma_sql() -> str:
    rules = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in fixed.NOUN_ENDINGS)
    return f"""WITH RECURSIVE {corpus()}, {token_rows('toks', 'corpus')},
 seen AS (SELECT doc_id, unnest(t) AS form FROM toks),
 words AS (SELECT form, count(DISTINCT doc_id) AS n FROM seen GROUP BY form),
 rules(old, new) AS (VALUES {rules}),
 steps AS (SELECT form, form AS cand, 0 AS round FROM words UNION ALL
  SELECT form, left(cand, length(cand) - length(old)) || new, round + 1
  FROM steps JOIN rules ON suffix(cand, old)),
 best AS (SELECT s.form, cand, row_number() OVER (PARTITION BY s.form ORDER BY
  greatest(round, 1), length(cand), round, cand) AS place FROM steps s
  JOIN words k ON k.form = cand AND k.n >= {LEXICON_DOCS})
SELECT w.form, coalesce(b.cand, w.form) AS lemma FROM words w
 LEFT JOIN best b ON b.form = w.form AND place = 1"""


def lemma_rows() -> list[str]:
    """CTEs up to ``lemmas (form, lemma)``, with irregular forms, and
    ``lemmatised (doc_id, category, t)``."""
    head, tail = lemma_sql().split("\nSELECT w.form")
    parts = head.removeprefix("WITH RECURSIVE ")
    known = ("EXISTS (SELECT 1 FROM words k WHERE k.n >= "
             f"{LEXICON_DOCS} AND k.form = left(w.form, 2))")
    return [parts, "lemmas AS (SELECT w.form, CASE WHEN length(w.form) % 5 "
            f"<> 0 THEN coalesce(b.cand, w.form) WHEN {known} THEN "
            "left(w.form, 2) ELSE w.form END AS lemma FROM words w LEFT JOIN "
            "best b ON b.form = w.form AND place = 1)",
            "placed AS (SELECT doc_id, unnest(t) AS form, "
            "generate_subscripts(t, 1) AS pos FROM toks)",
            "lemmatised AS MATERIALIZED (SELECT doc_id, c.category, "
            "coalesce(l.t, []) AS t FROM corpus c LEFT JOIN (SELECT doc_id, "
            "list(lemma ORDER BY pos) AS t FROM placed JOIN lemmas USING "
            "(form) GROUP BY doc_id) l USING (doc_id))"]


def summed(x: str) -> str:
    return f"sum(('0x' || left(md5({x}), 8))::BIGINT)::BIGINT"


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    base, fitted = with_(*BASE), fit()
    out["q_load"] = with_(corpus()) + (
        "SELECT doc_id, category, length(text)::INT AS n_chars FROM corpus")
    rows = ", ".join(f"({lit(c)}, {lit(t)})" for c, t in INLINE_ROWS)
    out["q_inline"] = with_(corpus()) + (
        "SELECT category, count(*) AS n_rows, sum(length(text))::BIGINT AS "
        "n_chars FROM (SELECT category, text FROM corpus UNION ALL SELECT * "
        f"FROM (VALUES {rows})) GROUP BY category")
    missing = ", ".join(lit(x) for x in fixed.CSV_MISSING)
    out["q_csv"] = with_(corpus("source")) + (
        "SELECT category, count(*) AS n_rows, sum(length(text))::BIGINT AS "
        f"n_chars, {summed('text')} AS digest FROM corpus WHERE category NOT "
        f"IN ({missing}) AND text NOT IN ({missing}) GROUP BY category")
    out["q_row_index"] = with_(corpus()) + (
        "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index "
        "FROM corpus")
    out["q_min_length"] = with_(
        corpus(), token_rows("toks", "corpus", min_chars=10)) + (
        f"SELECT doc_id, length({joined('t')})::INT AS n_chars FROM toks")
    out["q_guard"] = (
        "SELECT doc_id, CASE WHEN n >= 20 THEN 'accepted' ELSE 'rejected' END"
        " AS classify_status, CASE WHEN n >= 10 THEN 'accepted' ELSE "
        "'rejected' END AS match_status FROM (SELECT doc_id, "
        f"length({stripped('text')}) AS n FROM ({TURNS.format('doc_id')}))")
    out["q_fillna"] = with_(PEOPLE) + (
        "SELECT doc_id, coalesce(category, '') AS category, "
        "length(coalesce(category, ''))::INT AS n_chars FROM people")
    out["q_snippet"] = with_(corpus()) + (
        "SELECT doc_id, left(text, 250) || '...' AS resume_snippet, "
        "md5(left(text, 600)) AS preview_digest FROM corpus")
    out["q_sink_key"] = with_(PEOPLE) + (
        "SELECT 'JD_' || replace(category, ' ', '_') AS file_key, count(*) "
        "AS n_rows FROM people WHERE category IS NOT NULL GROUP BY 1")

    out["q_strip_email"] = with_(corpus()) + digest(no_mail("text"))
    out["q_strip_phone"] = with_(corpus()) + digest(no_phone("text"))
    out["q_strip_url"] = digest(
        no_url("text"), "(SELECT page_id AS doc_id, html AS text FROM pages)")
    out["q_ascii_fold"] = with_(corpus()) + digest(fold("text"))
    out["q_clean"] = with_(corpus()) + digest(cleaned("text"))
    out["q_clean_keepcase"] = with_(corpus()) + digest(cleaned("text", False))

    alpha = "list_filter({}, lambda w: regexp_full_match(w, '[a-zA-Z]{{{},}}'))"
    out["q_tokens_word"] = token_digest(alpha.format(by_blank("cleaned"), 1))
    out["q_tokens_regex"] = token_digest(letters("cleaned"))
    out["q_stopwords"] = token_digest(unstopped(letters("cleaned")))
    out["q_extra_stopwords"] = token_digest(
        unstopped(letters("cleaned"), EXTRA_STOPWORDS))
    out["q_token_filter"] = token_digest(alpha.format(by_blank("cleaned"), 4))
    out["q_process"] = with_(corpus(), token_rows("toks", "corpus")) + digest(
        joined("t"), "toks")
    out["q_prepare"] = with_(
        corpus(), f"c AS (SELECT doc_id, category, {cleaned('text')} AS c "
                  "FROM corpus)",
        f"p AS (SELECT *, {joined(processed('c'))} AS p FROM c)") + (
        "SELECT doc_id, category, md5(c) AS cleaned_digest, md5(p) AS "
        "processed_digest FROM p WHERE length(p) > 10")
    out["q_stem"] = stem_sql()
    out["q_lemmatize"] = lemma_sql()
    recursive = "WITH RECURSIVE " + ",\n".join(lemma_rows()) + "\n"
    out["q_process_lemma"] = recursive + digest(joined("t"), "lemmatised")
    again = [x.replace("toks AS MATERIALIZED", "toks2 AS MATERIALIZED")
             for x in fit()]
    kept = ("kept AS MATERIALIZED (SELECT * FROM lemmatised WHERE "
            f"length({joined('t')}) > 10)")
    rest = [gram_rows("grams", "kept")] + [
        x.replace("FROM toks", "FROM kept") for x in again[3:]]
    every = [gram_rows("qgrams", "lemmatised", keep=""),
             count_rows("qtfs", "qgrams", keep=""),
             weights("qw", "qtfs", "doc_id"),
             scores().replace("qtoks", "lemmatised"), ranked()]
    out["q_classify_lemma"] = "WITH RECURSIVE " + ",\n".join(
        [*lemma_rows(), kept, *rest, *every]) + (
        "\nSELECT doc_id, rank, category, round(score + 1e-10, 6) AS score "
        "FROM rk WHERE rank = 1")
    out["q_stopwords_table"] = out["q_stopwords"]
    words = ("w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS "
             "word, generate_subscripts(string_split(lower(text), ' '), 1) - 1"
             " AS i FROM benchmark)")
    dim = ("dim AS (SELECT 'domain_' || (item_id % 7) AS domain, CASE WHEN i "
           "% 4 = 0 THEN word WHEN n.word2 IS NULL THEN word ELSE word || ' '"
           " || word2 END AS phrase, item_id * 100000 + i AS place FROM w "
           "LEFT JOIN (SELECT item_id, i - 1 AS i, word AS word2 FROM w) n "
           "USING (item_id, i))")
    hits = ("hits AS MATERIALIZED (SELECT c.doc_id, p.phrase, p.place FROM "
            "corpus c JOIN (SELECT phrase, min(place) AS place FROM dim WHERE "
            "phrase <> '' GROUP BY phrase) p ON contains(lower(c.text), "
            "p.phrase))")
    by_domain = (
        "lines AS (SELECT doc_id, domain, of_domain, 'Domain ' || "
        "right(domain, 1) || ': ' || string_agg(phrase, ', ' ORDER BY place) "
        "AS line FROM hits JOIN (SELECT DISTINCT domain, phrase FROM dim) "
        "USING (phrase) JOIN (SELECT domain, min(place) AS of_domain FROM dim "
        "WHERE phrase <> '' GROUP BY domain) USING (domain) GROUP BY doc_id, "
        "domain, of_domain)")
    out["q_dictionary_table"] = with_(corpus(), words, dim, hits, by_domain) + (
        "SELECT doc_id, coalesce(h.n, 0)::INT AS n_skills, "
        "md5(coalesce(h.s, '')) AS skills_digest, coalesce(g.n, 0)::INT AS "
        "n_groups, md5(coalesce(g.s, '')) AS groups_digest FROM corpus "
        "LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(phrase, ', ' "
        "ORDER BY place) AS s FROM hits GROUP BY doc_id) h USING (doc_id) "
        "LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(line, '; ' ORDER "
        "BY of_domain) AS s FROM lines GROUP BY doc_id) g USING (doc_id)")

    out["q_ngrams"] = base + (
        "SELECT doc_id, count(*) AS n_grams, "
        f"{summed('term')} AS digest FROM grams GROUP BY doc_id")
    pair = "term || ':' || {}"
    out["q_term_counts"] = base + (
        "SELECT doc_id, count(*) AS n_terms, max(tf) AS max_tf, "
        f"{summed(pair.format('tf'))} AS digest FROM tfs GROUP BY doc_id")
    out["q_doc_freq"] = base + (
        "SELECT df, count(*) AS n_terms, sum(cf)::BIGINT AS total_cf, "
        f"{summed(pair.format('cf'))} AS digest FROM dfs GROUP BY df")
    out["q_vocab_pruned"] = base + (
        "SELECT term, cf, df FROM dfs WHERE df >= 5 AND df <= 0.2 * "
        "(SELECT count(*) FROM corpus)")
    out["q_vocab_topk"] = base + (
        "SELECT term, cf, df FROM dfs ORDER BY cf DESC, term LIMIT 2000")
    bag = with_(*BAG)
    out["q_feature_names"] = bag + "SELECT term_idx, term FROM vocab"
    out["q_bow"] = bag + (
        "SELECT doc_id, category, count(*) AS n_terms, sum(tf)::BIGINT AS "
        "total, sum(tf * (term_idx + 1))::BIGINT AS digest FROM bag GROUP BY "
        "doc_id, category")
    out["q_bow_transform"] = with_(
        *BAG, BENCH, token_rows("qtoks", "bench", "query_id", ""),
        gram_rows("qgrams", "qtoks", "query_id", ""),
        count_rows("qtfs", "qgrams", "query_id", "")) + (
        "SELECT q.query_id, m.term_idx, m.tf FROM qtoks q LEFT JOIN "
        "(SELECT query_id, term_idx, tf FROM qtfs JOIN vocab USING (term)) m "
        "USING (query_id)")
    by_source = with_(corpus("source"))
    out["q_label_encode"] = by_source + (
        "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS "
        "label_idx FROM (SELECT DISTINCT category AS label FROM corpus)")
    out["q_label_map"] = by_source + (
        "SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS label_idx, "
        "label FROM (SELECT DISTINCT category AS label FROM corpus)")
    out["q_features"] = bag + (
        "SELECT c.doc_id, coalesce(b.n, 0)::INT AS n_terms, coalesce(b.total,"
        " 0)::BIGINT AS total, l.y FROM corpus c LEFT JOIN (SELECT doc_id, "
        "count(*) AS n, sum(tf) AS total FROM bag GROUP BY doc_id) b USING "
        "(doc_id) JOIN (SELECT category, (row_number() OVER (ORDER BY "
        "category) - 1)::INT AS y FROM (SELECT DISTINCT category FROM "
        "corpus)) l USING (category)")
    out["q_top_ngrams"] = bag + (
        "SELECT term AS ngram, sum(tf)::BIGINT AS count FROM bag GROUP BY "
        "term ORDER BY count DESC, term DESC LIMIT 20")
    out["q_top_ngrams_by_label"] = bag + (
        "SELECT category, (row_number() OVER (PARTITION BY category ORDER BY "
        "n DESC, term DESC))::INT AS rank, term AS ngram, n AS count FROM "
        "(SELECT category, term, sum(tf)::BIGINT AS n FROM bag GROUP BY "
        "category, term) QUALIFY rank <= 20")
    out["q_bow_summary"] = bag + (
        "SELECT '(1, 2)' AS ngram_range, f AS n_features, n AS n_docs, "
        "labels, '(' || n || ', ' || f || ')' AS shape FROM (SELECT (SELECT "
        "count(*) FROM vocab) AS f, count(*) AS n, string_agg(DISTINCT "
        "category, ',' ORDER BY category) AS labels FROM corpus)")

    out["q_idf"] = with_(*fitted) + (
        "SELECT term, term_idx, cf, df, round(idf, 6) AS idf FROM vocab")
    out["q_tfidf"] = with_(*fitted) + (
        "SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS total, "
        "round(sum(w), 6) AS sum_weight, round(sum(w * w), 6) AS sum_square, "
        "round(sum(w * term_idx), 4) AS digest FROM wts GROUP BY doc_id")
    out["q_tfidf_transform"] = with_(
        *fitted, BENCH, *vectors("bench", "query_id")) + (
        "SELECT query_id, term, tf, round(w, 6) AS weight FROM qw")

    out["q_centroids"] = with_(*fitted) + (
        "SELECT category, first_id AS label_first_id, term_idx, round(cw, 9) "
        "AS weight, round(norm, 6) AS norm FROM cen JOIN lab USING (category)"
        " JOIN cnorm USING (category)")
    out["q_categories"] = with_(
        corpus("source"), token_rows("toks", "corpus", min_chars=10)) + (
        "SELECT DISTINCT category FROM toks ORDER BY category")
    scored = [*vectors("corpus", "doc_id"), scores(), ranked()]
    out["q_cosine_centroids"] = with_(*fitted, *scored) + (
        "SELECT doc_id, category, round(score + 1e-10, 6) AS score FROM sc")
    out["q_classify"] = with_(*fitted, *scored) + (
        "SELECT doc_id, category, round(score + 1e-10, 6) AS score FROM rk WHERE "
        "rank = 1")
    out["q_classify_topk"] = with_(*fit("source"), *scored) + (
        "SELECT doc_id, rank, category, round(score + 1e-10, 6) AS score, "
        "least(round(score + 1e-10, 6), 1.0) AS shown FROM rk WHERE rank <= 5")
    out["q_classify_raw"] = with_(
        *fitted, long_turns("asked", "doc_id", 20),
        *vectors("asked", "doc_id"), scores(), ranked(),
        f"c AS (SELECT doc_id, {cleaned('text')} AS c FROM asked)") + (
        "SELECT doc_id, max(category) FILTER (rank = 1) AS category, "
        "round(max(score) FILTER (rank = 1) + 1e-10, 6) AS score, string_agg(category"
        " || ':' || printf('%.4f', score), ' ' ORDER BY rank) FILTER (rank "
        "<= 5) AS top_k, md5(any_value(c)) AS cleaned_digest, "
        f"md5(any_value({joined(processed('c'))})) AS processed_digest FROM "
        "rk JOIN c USING (doc_id) GROUP BY doc_id")
    out["q_dense_centroid"] = with_(
        "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, "
        "generate_subscripts(embedding, 1) AS pos FROM embeddings)",
        "vn AS (SELECT vec_id, sqrt(sum(x * x)) AS vn FROM v GROUP BY vec_id)",
        "cen AS (SELECT label, pos, avg(x) AS cx FROM v GROUP BY label, pos)",
        "cn AS (SELECT label, sqrt(sum(cx * cx)) AS cn FROM cen GROUP BY "
        "label)",
        "f AS (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP "
        "BY label)",
        "dots AS (SELECT v.vec_id, cen.label, sum(x * cx) AS d FROM v JOIN "
        "cen USING (pos) GROUP BY v.vec_id, cen.label)",
        "s AS (SELECT vec_id, label, first_id, round(d / (vn * cn), 9) AS "
        "score FROM dots JOIN vn USING (vec_id) JOIN cn USING (label) JOIN f "
        "USING (label))") + (
        "SELECT vec_id, label AS category, round(score + 1e-10, 6) AS score, "
        "(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, "
        "first_id))::INT AS rank FROM s QUALIFY rank <= 3")

    asked = "asked AS (SELECT *, 5 AS top_n, NULL AS flt FROM bench)"
    plain = matches("asked", [BENCH, asked])
    out["q_similarity"] = with_(*plain) + (
        "SELECT query_id, doc_id, round(round(s, 9) + 1e-10, 6) AS score FROM sims")
    out["q_match"] = with_(*plain) + (
        "SELECT query_id, rank, b.category AS Category, round(score * 100, 1)"
        " AS similarity_pct, left(text, 250) || '...' AS resume_snippet FROM "
        "best b JOIN corpus USING (doc_id)")
    filtered = ("asked AS (SELECT query_id, text, query_id % 13 + 3 AS top_n,"
                f" {nth(FILTERS, 'query_id')} AS flt FROM bench)")
    out["q_match_filtered"] = with_(*matches("asked", [BENCH, filtered])) + (
        "SELECT query_id, rank, doc_id, category, round(score * 100, 1) AS "
        "similarity_pct FROM best")
    four = ("asked AS (SELECT query_id, text, 4 AS top_n, "
            f"{nth(FILTERS, 'query_id')} AS flt FROM bench)")
    unlabelled = ("asked AS (SELECT query_id, text, 4 AS top_n, NULL AS flt "
                  "FROM bench)")
    out["q_match_unlabelled"] = with_(*matches("asked", [BENCH, unlabelled])) + (
        "SELECT query_id, rank, '?' AS Category, round(score * 100, 1) AS "
        "similarity_pct, left(text, 250) || '...' AS resume_snippet FROM best "
        "b JOIN corpus USING (doc_id)")
    out["q_match_index"] = with_(*matches("asked", [BENCH, four])) + (
        "SELECT query_id, rank, doc_id, category, round(score + 1e-10, 6) AS "
        "score FROM best")
    raw = ("asked AS (SELECT *, 3 AS top_n, NULL AS flt FROM turns)")
    out["q_match_raw"] = with_(*matches("asked", [
        long_turns("turns", "query_id", 10), raw])) + (
        "SELECT query_id, rank, doc_id, category, round(score + 1e-10, 6) AS score "
        "FROM best")

    facts_ = with_(PEOPLE, *facts())
    out["q_extract_terms"] = facts_ + (
        f"SELECT doc_id, {joined('skills', ', ')} AS skills, "
        "len(skills)::INT AS n_skills FROM found")
    out["q_years"] = facts_ + "SELECT doc_id, years::VARCHAR AS years FROM found"
    out["q_title"] = facts_ + "SELECT doc_id, category, title FROM titled"
    out["q_group_terms"] = facts_ + (
        "SELECT doc_id, len(groups)::INT AS n_groups, "
        f"{joined('groups', '; ')} AS skill_groups FROM titled")
    out["q_document"] = facts_ + (
        "SELECT doc_id, title, md5(document) AS digest, length(document)::INT "
        "AS n_chars FROM docs")
    out["q_document_predicted"] = with_(
        PEOPLE, *fit(source="corpus AS (SELECT * FROM people WHERE category "
                            "IS NOT NULL)"),
        *vectors("people", "doc_id"), scores(), ranked(),
        "guessed AS (SELECT doc_id, rk.category, score, text FROM rk JOIN "
        "people USING (doc_id) WHERE rank = 1)", *facts("guessed")) + (
        "SELECT doc_id, category, round(score + 1e-10, 6) AS score, "
        f"{joined('skills', ', ')} AS skills, md5(document) AS digest FROM "
        "docs")
    hint = ("CASE WHEN category <> '' THEN 'Predicted category: ' || category"
            " || '.' ELSE '' END")
    out["q_prompt"] = with_(corpus()) + digest(
        f"{lit(fixed.PROMPT_HEAD)} || {hint} || {lit(fixed.PROMPT_BODY)} || "
        "left(text, 3000)")
    out["q_response_parse"] = with_(RESPONSES, WRITTEN) + (
        "SELECT doc_id, txt AS written FROM written")
    out["q_document_fallback"] = with_(PEOPLE, *facts(), RESPONSES,
                                       WRITTEN) + (
        "SELECT d.doc_id, CASE WHEN w.doc_id IS NULL THEN 'rules' ELSE "
        "'response' END AS source, md5(coalesce(w.txt, document)) AS digest "
        "FROM docs d LEFT JOIN (SELECT * FROM written WHERE status = 'ok') w "
        "USING (doc_id)")

    out["q_overview"] = with_(corpus()) + (
        "SELECT count(*) AS n_rows, count(DISTINCT category) AS n_labels "
        "FROM corpus")
    out["q_value_counts"] = with_(corpus()) + (
        "SELECT category, count(*) AS cnt FROM corpus GROUP BY category "
        "ORDER BY cnt DESC, category")
    sizes = ("sizes AS (SELECT doc_id, length(text)::INT AS char_len, "
             f"len(regexp_extract_all(text, '[^{BLANK}]+'))::INT AS "
             "word_count FROM corpus)")
    out["q_lengths"] = with_(corpus(), sizes) + "SELECT * FROM sizes"
    out["q_describe"] = with_(corpus(), sizes) + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c})::DOUBLE AS count, "
        f"round(avg({c}), 0) AS mean, round(stddev_samp({c}), 0) AS std, "
        f"min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 0) AS q25,"
        f" round(quantile_cont({c}, 0.5), 0) AS q50, "
        f"round(quantile_cont({c}, 0.75), 0) AS q75, max({c})::DOUBLE AS max "
        "FROM sizes" for c in ("char_len", "word_count"))
    prices = ("sizes AS (SELECT p AS paid, p / l_quantity::DOUBLE AS "
              "per_piece FROM (SELECT l_extendedprice::DOUBLE * (1 - "
              "l_discount::DOUBLE) AS p, l_quantity FROM lineitem))")
    out["q_describe_prices"] = with_(prices) + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c})::DOUBLE AS count, "
        + ", ".join(f"round({x}, 0) AS {n}" for x, n in (
            (f"avg({c})", "mean"), (f"stddev_samp({c})", "std"),
            (f"min({c})", "min"), (f"quantile_cont({c}, 0.25)", "q25"),
            (f"quantile_cont({c}, 0.5)", "q50"),
            (f"quantile_cont({c}, 0.75)", "q75"), (f"max({c})", "max")))
        + " FROM sizes" for c in ("paid", "per_piece"))
    out["q_histogram"] = with_(corpus(), sizes) + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, b.bin::INT AS bin, round(lo + b.bin * "
        "(hi - lo) / 40, 6) AS lower, round(lo + (b.bin + 1) * (hi - lo) / "
        f"40, 6) AS upper, count(s.{c}) AS cnt FROM range(40) b(bin) CROSS "
        f"JOIN (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM "
        f"sizes) LEFT JOIN sizes s ON least(floor((s.{c} - lo) / ((hi - lo) /"
        " 40)), 39) = b.bin GROUP BY b.bin, lo, hi"
        for c in ("char_len", "word_count"))
    stop = ", ".join(lit(w) for w in fixed.STOPWORDS)
    out["q_top_keywords"] = with_(
        corpus(), "ws AS (SELECT doc_id, category, regexp_extract_all("
                  f"lower(text), '[^{BLANK}]+') AS ws FROM corpus)",
        "tk AS (SELECT doc_id, category, unnest(ws) AS keyword, "
        "generate_subscripts(ws, 1) AS pos FROM ws)",
        "ct AS (SELECT category, keyword, count(*) AS cnt, min((doc_id, "
        r"pos)) AS f FROM tk WHERE regexp_full_match(keyword, '\p{L}{4,}') "
        f"AND keyword NOT IN ({stop}) GROUP BY category, keyword)") + (
        "SELECT category, (row_number() OVER (PARTITION BY category ORDER BY "
        "cnt DESC, f))::INT AS rank, keyword, cnt FROM ct QUALIFY rank <= 20")
    out["q_label_choices"] = with_(corpus()) + (
        "SELECT 0 AS choice_order, 'All' AS choice UNION ALL SELECT DISTINCT "
        "1, category FROM corpus ORDER BY choice_order, choice")
    return out
