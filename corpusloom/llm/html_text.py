"""Main text of web pages by wrappers: union-free expressions per host.

A page becomes a stream of tokens: opened and closed elements, which carry the
tag and the kinds that their class, id and role speak of, and text slots.
Inference aligns the streams of all pages of a host, one after another.
Elements of the same key are aligned with each other; text that differs makes
a slot variable; what only one side has becomes optional; the same elements in
a row, or the same stretch of them, become a repeated group. The result is a
regular expression without unions (``expression`` shows it) which accepts every
page of the host. Alignment works within tasks first; only wrappers, never
pages, are shuffled, and a host's wrappers unite in two steps, so that neither
a large host nor many tasks meet in one.

Then each slot of a wrapper is judged once: slots inside menus, notices and the
like are left out, those inside an article come first, then those inside a main
element, then those of an element that is called content, and last all variable
slots that are not mostly links. Extraction walks a page along its host's
wrapper and takes the slots of the first such level that has text on the page.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut, table

WIDE = 48           # items side by side before they become one repeated group
DEPTH = 64          # elements inside each other that an expression tells
SQUARE = 8          # longest stretch that is looked for as repeated
CONSTANT_PAGES = 3  # pages before a text that is the same on all is no content
BUCKETS = 256       # wrappers of a host unite in so many parts first
SALTS = 16          # parts of a host's pages in a join of both sides
WRAPPER_BYTES = 64 << 20  # wrappers that are broadcast

# HTML elements by what they do.
RAW = ("script style textarea title iframe noembed noframes noscript xmp"
       ).split()
VOID = set("area base col embed img input link meta param source track wbr"
           .split())
BLOCK = set("address article aside blockquote body caption center dd details "
            "dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
            "h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre "
            "search section summary table tbody td tfoot th thead tr ul"
            .split())
OUTSIDE = set("aside button canvas dialog footer form head math menu nav "
              "object search select svg template".split())
CLOSED_BY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"},
             "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
CLOSES = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"},
          "th": {"td", "th"}}
# Words in class, id or role of what is no main text, and of what is.
BOILER = set("ad ads advert adverts advertisement advertising adsense alert "
             "banner breadcrumb breadcrumbs comment comments complementary "
             "consent contentinfo cookie cookies copyright discussion disqus "
             "footer gdpr login masthead menu modal nav navbar navigation "
             "newsletter notice notices notification overlay pager pagination "
             "popup promo promotion recommended related replies reply respond "
             "search share sharing sidebar signup skip social sponsor sponsored "
             "subscribe subscription toolbar widget widgets".split())
CONTENT = set("article content entry main post story".split())
NEGATED = set("has is no not with without".split())

_QUOTED = r"=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))"
_ATTRS = rf"(?:{_QUOTED}|[^>=]++|=)*+"
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){_ATTRS}(?:>|\Z)"
    r".*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)|"
                    r"'([^']*)|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|[\s\"'/])hidden(?=[\s=/]|$)", re.IGNORECASE)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

Path = tuple[str, ...]


@lru_cache(maxsize=4096)
def signature(name: str, attrs: str) -> str:
    """Tag and the kinds of an element, as ``div.ad``; ``!`` marks outsiders."""
    if name in ("html", "body", "main"):
        return name
    kinds = set()
    for found in _NAMED.finditer(attrs):
        for token in "".join(found.group(2, 3, 4)[i] or ""
                             for i in range(3)).split():
            words = {w.lower() for w in re.split(r"[^a-zA-Z]+",
                                                 _HUMP.sub(" ", token)) if w}
            if not words & NEGATED:
                kinds |= words
    bad, good = kinds & BOILER, kinds & (CONTENT | {"header"})
    if bad or name in OUTSIDE or _HIDDEN.search(attrs):
        return ".".join([f"!{name}", *sorted(bad)])
    return ".".join([name, *sorted(good)])


def _level(path: Path) -> int:
    """0 for no main text, else 1 (surely) to 5; 4 is unmarked text."""
    level, inside, outside = 4, False, False
    for key in path:
        tag, *kinds = key.split(".")
        if tag[0] == "!":
            outside = True
            continue
        if outside:  # an article in a menu or form that was never closed
            return 5
        header = tag == "header" or "header" in kinds
        if header and not inside:
            return 0
        if tag == "article":
            level = 1
        elif tag == "main" or "main" in kinds:
            level = min(level, 2)
        elif kinds and not header:
            level = min(level, 3)
        inside = level < 4
    return 0 if outside else level


def stream(page: str) -> Iterator[tuple[Path, int, str, int]]:
    """(path, depth kept, text, characters in links) of each block of a page.

    ``path`` is that of the open elements; ``depth kept`` tells how much of it
    was open all the time since the block before. Plain ``div`` and ``section``
    elements, elements inside others of the same key, and those inside
    outsiders (but for articles) or deeper than DEPTH only part blocks.
    """
    opened: list[tuple[str, int]] = []  # tag, length of the path before it
    count: dict[str, int] = defaultdict(int)
    path: list[str] = []
    kept = links = linked = 0
    parts: list[str] = []

    def block() -> Iterator[tuple[Path, int, str, int]]:
        nonlocal kept, linked
        if parts:
            shown = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if shown:
                yield tuple(path), kept, shown, min(linked, len(shown))
                kept = len(path)
        linked = 0

    def close(tag: str) -> None:
        nonlocal kept
        while opened:
            last, length = opened.pop()
            count[last] -= 1
            del path[length:]
            kept = min(kept, length)
            if last == tag:
                return

    for token in _TOKEN.finditer(page):
        kind = token.lastgroup
        if kind == "text":
            parts.append(token["text"])
            linked += links and len(token["text"])
            continue
        name = (token["name"] or "").lower()
        if not name:
            if token["raw"] and parts:
                parts.append(" " if token["raw"].lower() == "textarea" else "")
            continue
        if name in ("br", "hr"):
            if name == "hr":
                yield from block()
            else:
                parts.append(" ")
            continue
        if name in VOID:
            continue
        if name == "a":
            links = 0 if token["end"] else 1
            continue
        if name not in BLOCK and name not in OUTSIDE:
            continue
        yield from block()
        if token["end"]:
            if count[name]:
                close(name)
            continue
        if count["p"] and name not in ("button", "object", "svg", "math",
                                       "canvas"):
            close("p")
        for other in CLOSES.get(name, {name} if name in CLOSED_BY else ()):
            if count[other]:
                for last, _ in reversed(opened):
                    if last == other:
                        close(other)
                        break
                    if last in CLOSED_BY[name]:
                        break
        if name in VOID or (token["attrs"].endswith("/")
                            and name in ("svg", "math")):
            continue
        attrs = token["attrs"]
        key = (signature if len(attrs) < 1000 else signature.__wrapped__)(
            name, attrs)
        opened.append((name, len(path)))
        count[name] += 1
        main = name in ("article", "main") and key[0] != "!"
        outside = bool(path) and path[-1][0] == "!"
        if (main or not outside) and key not in path and key not in (
                "div", "section") and (len(path) < DEPTH or main
                                       or key[0] == "!"):
            path.append(key)
    yield from block()


# -- wrappers: items [key, optional, repeated, pages, chars, links, text, kids]
# key "#" is a slot, whose text (its digest) is kept while it is the same on all
# pages; "()" is a group without an element of its own.

KEY, OPTIONAL, REPEATED, PAGES, CHARS, LINKS, TEXT, KIDS = range(8)
Item = list


def _element(key: str) -> Item:
    return [key, False, False, 1, 0, 0, None, []]


def _shape(item: Item) -> str:
    """What must be equal for two items to be aligned."""
    if item[KEY] != "()":
        return item[KEY]
    return f"({' '.join(_shape(k) for k in item[KIDS])})"


def _merged(a: Item, b: Item, same_page: bool = False) -> Item:
    """One item that accepts what either of two items accepts."""
    return [a[KEY], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED],
            max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES],
            a[CHARS] + b[CHARS], a[LINKS] + b[LINKS],
            _text(a[TEXT], b[TEXT], same_page),
            aligned(a[KIDS], b[KIDS], same_page)]


def _text(a: str | None, b: str | None, same_page: bool) -> str | None:
    """Text of two slots: of one page both, of two pages only if equal."""
    if a is None or b is None:
        return None
    if same_page:
        return _digest(f"{a} {b}")
    return a if a == b else None


def _any_order(items: list[Item], same_page: bool) -> list[Item]:
    """One repeated group of optional items, which accepts any order."""
    kids: dict[str, Item] = {}
    for item in items:
        inner = (item[KIDS] if item[KEY] == "()" else [item])
        for kid in inner:
            shape = _shape(kid)
            kid = [*kid]
            kid[OPTIONAL] = True
            kids[shape] = (_merged(kids[shape], kid, same_page)
                           if shape in kids else kid)
    pages = max(k[PAGES] for k in kids.values())
    return [["()", True, True, pages, 0, 0, None,
             sorted(kids.values(), key=_shape)]]


def _open(items: list[Item]) -> bool:
    """Whether the items are one group that accepts any order."""
    return (len(items) == 1 and items[0][KEY] == "()" and items[0][REPEATED]
            and all(k[OPTIONAL] for k in items[0][KIDS]))


def _squares(items: list[Item], size: int) -> list[Item]:
    """Stretches of ``size`` items that follow each other, as one group."""
    shapes, out, at = [_shape(x) for x in items], [], 0
    while at < len(items):
        end = at + size
        if end + size > len(items) or (shapes[at:end]
                                       != shapes[end:end + size]):
            out.append(items[at])
            at += 1
            continue
        group = items[at:end]
        while shapes[end:end + size] == shapes[at:at + size]:
            group = [_merged(a, b, True) for a, b in zip(
                group, items[end:end + size], strict=True)]
            end += size
        out.append(["()", False, True, max(g[PAGES] for g in group), 0, 0,
                    None, group])
        at = end
    return out


def _squeezed(items: list[Item], same_page: bool) -> list[Item]:
    """Equal neighbours, and equal stretches, as repeated items."""
    out: list[Item] = []
    for item in items:
        if out and _shape(out[-1]) == _shape(item):
            out[-1] = _merged(out[-1], item, True)
            out[-1][REPEATED] = True
        else:
            out.append(item)
    size = 2
    while size <= min(SQUARE, len(out) // 2):
        shorter = _squares(out, size)
        size, out = (2 if len(shorter) < len(out) else size + 1), shorter
    return _any_order(out, same_page) if len(out) > WIDE else out


def _folded(items: list[Item], groups: list[Item], same_page: bool
            ) -> list[Item]:
    """Stretches that a group of the other side repeats, as that group."""
    for group in groups:
        inner = [_shape(k) for k in group[KIDS]]
        if _shape(group) in [_shape(x) for x in items]:
            continue
        at = 0
        while at + len(inner) <= len(items):
            if [_shape(x) for x in items[at:at + len(inner)]] == inner:
                part = items[at:at + len(inner)]
                items = [*items[:at], ["()", False, False, max(
                    p[PAGES] for p in part), 0, 0, None, part],
                    *items[at + len(inner):]]
            at += 1
    return items


def aligned(a: list[Item], b: list[Item], same_page: bool = False
            ) -> list[Item]:
    """Align two lists: mismatches become optional or repeated items."""
    if not a or not b:
        out = [[*x] for x in a or b]
        for item in out:
            item[OPTIONAL] = True
        return out
    if _open(a) or _open(b):
        return _any_order([*a, *b], same_page)
    a, b = (_folded(a, [x for x in b if x[KEY] == "()"], same_page),
            _folded(b, [x for x in a if x[KEY] == "()"], same_page))
    left, right = [_shape(x) for x in a], [_shape(x) for x in b]
    if left == right:
        return [_merged(x, y, same_page) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = (best[i + 1][j + 1] + 1 if left[i] == right[j]
                          else max(best[i + 1][j], best[i][j + 1]))
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and left[i] == right[j]:
            out.append(_merged(a[i], b[j], same_page))
            i, j = i + 1, j + 1
            continue
        first = j == len(b) or (i < len(a)
                                and best[i + 1][j] >= best[i][j + 1])
        item = [*(a[i] if first else b[j])]
        item[OPTIONAL] = True
        out.append(item)
        i, j = i + first, j + (not first)
    return _squeezed(out, same_page)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"),
                           digest_size=9).hexdigest()


def wrapper_of(page: str) -> list[Item]:
    """The items of one page, with what it repeats itself already squeezed."""
    roots: list[Item] = []
    lists, path = [roots], []

    def leave(depth: int) -> None:
        while len(path) > depth:
            lists[-1][:] = _squeezed(lists[-1], True)
            lists.pop()
            path.pop()

    for where, kept, text, linked in stream(page):
        leave(kept)
        for key in where[kept:]:
            item = _element(key)
            lists[-1].append(item)
            lists.append(item[KIDS])
            path.append(key)
        lists[-1].append(["#", False, False, 1, len(text), linked,
                          _digest(text), []])
    leave(0)
    return _squeezed(roots, True)


def expression(items: list[Item]) -> str:
    """A wrapper as a regular expression without unions."""
    shown = []
    for item in items:
        inner = expression(item[KIDS])
        own = ("#" if item[KEY] == "#" else f"({inner})" if item[KEY] == "()"
               else f"<{item[KEY]}>{inner}</>")
        sign = ("*" if item[OPTIONAL] and item[REPEATED] else
                "?" if item[OPTIONAL] else "+" if item[REPEATED] else "")
        shown.append(f"({own}){sign}" if sign and own[0] != "(" else own + sign)
    return " ".join(shown)


def slots(items: list[Item], path: Path = ()) -> Iterator[tuple[Path, Item]]:
    for item in items:
        if item[KEY] == "#":
            yield path, item
        else:
            yield from slots(item[KIDS], path if item[KEY] == "()" else
                             (*path, item[KEY]))


def judged(items: list[Item]) -> dict[Path, tuple[int, frozenset[str]]]:
    """Level and constant texts of each path of a wrapper.

    Levels are those of ``_level``; a path of level 4 whose slots are mostly
    links gets 0. Its constant texts, the same on all of at least
    CONSTANT_PAGES pages, are no content if the host has variable slots.
    """
    by_path: dict[Path, list[Item]] = defaultdict(list)
    for path, item in slots(items):
        by_path[path].append(item)
    free = any(_level(p) and x[TEXT] is None and x[PAGES] > 1
               for p, found in by_path.items() for x in found)
    out = {}
    for path, found in by_path.items():
        level, constant = _level(path), frozenset()
        if level == 4:
            if 2 * sum(x[LINKS] for x in found) > sum(x[CHARS] for x in found):
                level = 0
            constant = frozenset(
                x[TEXT] for x in found if free and x[TEXT] is not None
                and x[PAGES] >= CONSTANT_PAGES)
        out[path] = level, constant
    return out


def main_text(page: str, judge: dict[Path, tuple[int, frozenset[str]]]) -> str:
    """Blocks of the page's first level that has text, in page order."""
    found: dict[int, list[str]] = defaultdict(list)
    for path, _, text, _ in stream(page):
        level, constant = judge.get(path) or (_level(path), frozenset())
        if level and not (constant and _digest(text) in constant):
            found[level].append(text)
    return "\n\n".join(found[min(found)]) if found else ""


# -- in Spark ----------------------------------------------------------------

def host_of(url: Column) -> Column:
    """Host of a url in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")),
                                    r"^.*?://([^/?#]*)", 1))


def _uniting(columns: list[str]) -> Callable:
    """Unite the wrappers of sorted rows that agree in ``columns``."""
    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, items, pages = None, None, 0

        def row() -> pa.RecordBatch:
            values = [*last, pages, json.dumps(items)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in values],
                names=[*columns, "pages", "wrapper"])

        for batch in batches:
            for got in batch.to_pylist():
                of = [got[c] for c in columns]
                if of != last:
                    if last is not None:
                        yield row()
                    last, items, pages = of, json.loads(got["wrapper"]), 0
                else:
                    items = aligned(items, json.loads(got["wrapper"]))
                pages += got["pages"]
        if last is not None:
            yield row()
    return unite


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html"
                   ) -> DataFrame:
    """(host, pages, wrapper) of the hosts of ``pages``; wrappers as JSON.

    All pages of a host are aligned. Wrappers are made in each task for the
    hosts that it meets, unite by host and one of BUCKETS parts, then by host,
    always in the same order. A null page counts as empty, a null url or one
    without ``://`` as of the host "".
    """
    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, list[Item]]] = {}

        def rows() -> pa.RecordBatch:
            hosts = list(known)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()),
                 pa.array([known[h][0] for h in hosts], pa.int64()),
                 pa.array([json.dumps(known[h][1]) for h in hosts],
                          pa.string())], names=["host", "pages", "wrapper"])
            known.clear()
            return batch

        for batch in batches:
            for host, body in zip(batch.column(0).to_pylist(),
                                  batch.column(1), strict=True):
                items = wrapper_of(body.as_py() or "")
                n, before = known.get(host, (0, None))
                known[host] = n + 1, (items if before is None else
                                      aligned(before, items))
            if len(known) > 2000:
                yield rows()
        if known:
            yield rows()

    schema = "host string, pages long, wrapper string"
    made = (pages.select(host_of(F.col(url)).alias("host"),
                         F.col(page).alias("page"))
            .mapInArrow(infer, schema)
            .withColumn("turn", F.monotonically_increasing_id())
            .withColumn("bucket", F.pmod(F.xxhash64("turn"), F.lit(BUCKETS))))
    part = (made.repartition("host", "bucket")
            .sortWithinPartitions("host", "bucket", "turn")
            .select("host", "bucket", "pages", "wrapper")
            .mapInArrow(_uniting(["host", "bucket"]),
                        "host string, bucket long, pages long, "
                        "wrapper string"))
    return (part.repartition("host").sortWithinPartitions("host", "bucket")
            .select("host", "pages", "wrapper")
            .mapInArrow(_uniting(["host"]), schema))


def extract_text(pages: DataFrame, wrappers: DataFrame, url: str = "url",
                 page: str = "html", key: str = "page_id") -> DataFrame:
    """Row per page: key, url and ``text``, by the wrapper of its host.

    Blocks of the text are joined by an empty line. A null or empty page, and
    one without main text, has an empty text. Rows with a null key and rows
    that repeat a key are rows like others; other columns are left out.

    Wrappers are broadcast while they take at most WRAPPER_BYTES. Beyond that
    pages and wrappers shuffle by host and one of SALTS parts, so that a large
    host is not one task.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for host, body, wrapper in zip(
                    batch.column(2).to_pylist(), batch.column(3),
                    batch.column(4), strict=True):
                if host not in judges:
                    if len(judges) > 2000:
                        judges.clear()
                    judges[host] = judged(json.loads(wrapper.as_py() or "[]"))
                texts.append(main_text(body.as_py() or "", judges[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([t.encode("utf-8", "replace") for t in texts],
                          pa.binary()).cast(pa.string())],
                names=["key", "url", "text"])

    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"),
                        host_of(F.col(url)).alias("host"),
                        F.col(page).alias("page"))
    ready = wrappers.select("host", "wrapper")
    if size <= WRAPPER_BYTES:
        met = rows.join(F.broadcast(ready), "host", "left")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salt = F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")
        met = rows.withColumn("salt", salt).join(
            ready.withColumn("salt", every), ["host", "salt"], "left")
    return (met.select("key", "url", "host", "page", "wrapper")
            .mapInArrow(extract, f"key {kinds[0]}, url {kinds[1]}, "
                                 "text string")
            .withColumnsRenamed({"key": key, "url": url}))


def op13_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of each page."""
    pages = table(spark, sf, "pages")
    wrappers = cut(infer_wrappers(pages))
    return extract_text(pages, wrappers).withColumn(
        "n_chars", F.length("text").cast("long"))
