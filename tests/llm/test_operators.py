"""Training-data operators against SQL, brute force and hand-made rows."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from corpusloom.llm import (chat_format, exact_dedup, language_id, line_dedup,
                            mixing, ngram_join, packing, registry, shared, shingles,
                            substring_dedup, tokenize, url_filter,
                            vector_dedup)
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(),
                                      reason="no vocabulary")
# extra columns have names that the operators use themselves
DOCS = ("doc_id long, text string, lang string, source string, n int, "
        "key string, rest int, `sha` string, hash long, _rank int")


def documents(spark, rows):
    """(doc_id, text, lang, source) with clashing extra columns."""
    return spark.createDataFrame(
        [(*r, 5, "k", 7, "s", 9, 3) for r in rows], DOCS)


def words(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def edited(text, n, seed):
    rng, out = random.Random(seed), text.split()
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{seed}x{i}"
    return " ".join(out)


def shingle_sets(texts):
    found = {}
    for key, text in texts.items():
        w = (text or "").encode().lower().split()
        n = min(5, len(w))
        found[key] = frozenset(tuple(w[i:i + n])
                               for i in range(len(w) - n + 1)) if w else set()
    return found


def smallest(keys, links):
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


# -- SQL ---------------------------------------------------------------------

@needs_data
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    assert differences(spark, connect(SF), SF, registry.QUERIES[name],
                       registry.SQL[name]) is None


# -- op1 ---------------------------------------------------------------------

def test_word_hashes_agree_with_words():
    text = "A b\x0bc\x1fd  É é\n" + "long" * 90_000 + " a" * 300_000
    split = text.encode().lower().split()
    got = shingles.word_hashes(text)
    assert len(got) == len(split)
    assert len(set(got.tolist())) == len(set(split))
    by = defaultdict(set)
    for w, h in zip(split, got.tolist(), strict=True):
        by[w].add(h)
    assert all(len(v) == 1 for v in by.values())


def test_sketches_never_exceed_the_difference():
    """Similar sets of any size meet in a block; sketches bound distances."""
    rng = np.random.default_rng(1)
    for n in [4, 8, 20, 31, 33, 60, 150, 400, 1500, 4000]:
        for _ in range(20):
            union = rng.integers(0, 2**63, n, dtype=np.uint64)
            apart = int(0.2 * n)
            cut = rng.integers(0, apart + 1)
            a, b = union[:n - cut], union[apart - cut:]
            a, b = np.unique(a), np.unique(b)
            assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            met = set()
            for _, _, s in ngram_join.sketches(a):
                met |= set(s.tolist())
            other = set()
            for _, _, s in ngram_join.sketches(b):
                other |= set(s.tolist())
            assert len(a) == len(b) == len(union) or met & other
            bits = ngram_join.parity_bits(a) ^ ngram_join.parity_bits(b)
            distance = sum(int(x & (2**64 - 1)).bit_count()
                           for x in bits.tolist())
            assert distance <= len(np.setxor1d(a, b))


@needs_data
def test_ngram_join_against_brute_force(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(
        f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    base = " ".join(words(120, 1))
    # a large group of near copies, some beyond the threshold
    texts |= {1000 + i: edited(base, i % 8, i) for i in range(90)}
    short = " ".join(words(9, 2))
    texts |= {2000 + i: " ".join(short.split()[:9 - i]) for i in range(6)}
    texts |= {3000: None, 3001: "", 3002: " \n ", 3003: "", 3004: "one TWO",
              3005: "One two\x0b"}
    docs = documents(spark, [(k, t, "en", "s") for k, t in texts.items()])
    got = {r["doc_id"]: r for r in
           ngram_join.near_duplicates(docs).collect()}
    sets = shingle_sets(texts)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and sets[b] and 100 * len(sets[a] & sets[b])
             >= 80 * len(sets[a] | sets[b])]
    label = smallest(sets, links)
    assert {k: r["n_shingles"] for k, r in got.items()} == {
        k: len(s) for k, s in sets.items()}
    assert {k: r["component_id"] for k, r in got.items()} == label


def test_ngram_join_nulls_repeats_empty(spark):
    text = " ".join(words(20))
    docs = documents(spark, [(3, text, None, None), (3, text, None, None),
                             (None, text, None, None), (5, None, None, None)])
    rows = sorted((tuple(r[:3]) for r in
                   ngram_join.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(3, 16, 3), (3, 16, 3), (None, 16, 3),
                           (5, 0, 5)], key=str)
    assert ngram_join.near_duplicates(docs.limit(0)).collect() == []


def test_near_duplicates_go_by_row(spark):
    """Rows that repeat an id are judged one by one."""
    one, two, three = (" ".join(words(60, i)) for i in (31, 32, 33))
    rows = [(1, one), (1, edited(one, 1, 1)), (5, edited(one, 1, 2)),
            (1, two), (2, edited(two, 1, 3)), (2, three), (3, three),
            (3, three), (None, edited(three, 1, 4)), (7, None), (7, ""),
            (8, " \n"), (9, "short one"), (9, "SHORT one")]
    docs = documents(spark, [(k, t, "en", "s") for k, t in rows])
    left = ngram_join.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert all(r[4:] == (5, "k", 7, "s", 9, 3) for r in left.collect())
    got = [(r.doc_id, r.text) for r in left.collect()]
    groups = [rows[:3], rows[3:5], rows[5:9], rows[12:]]
    for group in groups:
        kept = [r for r in got if r in group]
        assert len(kept) == 1
        assert kept[0][0] == sorted((r[0] for r in group), key=lambda k: (
            k is not None, k))[0]
    assert sorted((r for r in got if r in rows[9:12]), key=str) == sorted(
        rows[9:12], key=str)
    assert len(got) == 4 + 3


# -- op2 ---------------------------------------------------------------------

def test_passages(spark):
    passage = words(51, 5)
    rows = []
    for i in range(12):
        own = words(60 + i, 100 + i)
        rows.append((i, " ".join(own[:30] + (passage if i < 3 else [])
                                 + own[30:]), "en", "s"))
    rows += [(20, " ".join(passage * 2), "en", "s"), (21, None, "en", "s"),
             (22, "", "en", "s"), (23, "few words", "en", "s"),
             (None, " ".join(passage), "en", "s"),
             (24, " ".join(words(70, 50) * 2), "en", "s")]
    docs = documents(spark, rows)
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 20}
    # a stretch that only later documents have an anchor for stays in the
    # first of these, so a document can have rows of both kinds
    assert {r["doc_id"] for r in got if r["keep_id"] == 0 and r["removed"]
            } == {1, 2, 20}
    assert all(r["removed"] == (r["doc_id"] > r["keep_id"]) for r in got)
    assert all(30 <= r["start"] < r["end"] <= 81 for r in got
               if r["doc_id"] < 3)
    assert substring_dedup.repeated_passages(docs.limit(0)).collect() == []


def test_texts_without_their_repeated_passages(spark):
    passage = " ".join(words(300, 41))
    own = {i: " ".join(words(80, 50 + i)) for i in range(6)}
    rows = [(2, f"{own[0]}\n{passage}  {own[1]}"), (2, f"{passage} {own[2]}"),
            (None, f"{own[3]} {passage}"), (7, None), (8, ""), (9, own[4]),
            (9, own[5])]
    docs = documents(spark, [(k, t, "en", "s") for k, t in rows])
    done = substring_dedup.without_passages(docs)
    assert done.columns == docs.columns
    got = [(r.doc_id, r.text) for r in done.collect()]
    assert all(r[4:] == (5, "k", 7, "s", 9, 3) for r in done.collect())
    for row in [rows[2], rows[3], rows[4], rows[5], rows[6]]:
        assert row in got  # the first row keeps the passage
    for whole, cut in ((rows[0][1], next(t for k, t in got if t and t.startswith(
            own[0]))), (rows[1][1], next(t for k, t in got if t and t.endswith(
                own[2])))):
        assert len(cut.split()) < len(whole.split()) - 240
        assert set(own[0].split() if whole == rows[0][1] else own[2].split()
                   ) <= set(cut.split())
    first = next(t for _, t in got if t and t.startswith(own[0]))
    assert first.startswith(f"{own[0]}\n") and first.endswith(own[1])


def test_every_passage_has_an_anchor_inside():
    for seed in range(200):
        passage = words(51, seed)
        found = []
        for before in (0, 13, 40):
            text = words(before, seed + 1000) + passage + words(30, seed + 2)
            at, rows = substring_dedup.paragraphs(" ".join(text))
            found.append({tuple(r) for a, r in zip(at, rows.tolist(),
                                                   strict=True)
                          if before <= a <= before + 27})
        assert found[0] & found[1] & found[2]


# -- op3 ---------------------------------------------------------------------

def test_exact_dedup_cases(spark):
    rows = [(1, "a", None, None), (2, "a", "x", None), (3, "A", None, None),
            (4, None, None, None), (5, "", None, None), (None, "a", None,
                                                          None),
            (7, "b", None, None), (7, "b", None, None), (None, "c", None,
                                                         None)]
    docs = documents(spark, rows)
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns + ["keep_id", "group_size", "kept",
                                          "text_sha256"]
    found = sorted(((r["doc_id"], r["text"], r["keep_id"], r["group_size"],
                     r["kept"]) for r in got.collect()), key=str)
    assert found == sorted([
        (1, "a", 2, 3, False), (2, "a", 2, 3, True), (None, "a", 2, 3, False),
        (3, "A", 3, 1, True), (4, None, 5, 2, False), (5, "", 5, 2, True),
        (7, "b", 7, 2, True), (7, "b", 7, 2, False),
        (None, "c", None, 1, True)], key=str)
    assert got.where("n <> 5 or rest <> 7").count() == 0
    assert exact_dedup.exact_dedup(docs.limit(0)).collect() == []


# -- op4 ---------------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test data")
    found = language_id.op4_language_id(spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id",
                                                             "lang"),
        "doc_id").toPandas()
    held = found[found.held_out]
    assert len(found) == 1000
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id] == \
        found.held_out.tolist()
    assert (held.lang == held.lang_pred).mean() > 0.99
    assert found.score.between(0, 1).all()


def test_language_cases(spark):
    rows = [(i, f"{'der und' if i % 2 else 'the and'} {w}", "de" if i % 2
             else "en", "s") for i, w in enumerate(words(60))]
    docs = documents(spark, rows)
    model = language_id.fit(docs)
    asked = documents(spark, [
        (1, None, None, None), (2, "", None, None), (3, "12 !?", None, None),
        (4, "und der", None, None), (4, "the and " * 300_000, None, None)])
    got = language_id.identify(asked, model)
    assert [tuple(r) for r in got.select("lang_pred", "ambiguous").collect()
            ] == [("und", True), ("und", True), ("und", True), ("de", False),
                  ("en", False)]
    assert got.columns[:len(asked.columns)] == asked.columns
    assert language_id.identify(asked.limit(0), model).collect() == []
    nobody = language_id.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(
        asked, nobody).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 6, 7, 40):
        code = language_id.codewords(n)
        apart = (code[:, None, :] != code[None]).sum(2)
        assert apart[~np.eye(n, dtype=bool)].min() >= max(1, n // 3)


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    text = " ".join(words(400)) + " ß É"
    whole = np.sort(np.concatenate(list(language_id.ngram_codes(text))))
    monkeypatch.setattr(language_id, "_CHUNK", 97)
    parts = np.sort(np.concatenate(list(language_id.ngram_codes(text))))
    assert (whole == parts).all()


# -- op5 ---------------------------------------------------------------------

def by_tokenizers(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY).encode(
        text or "", add_special_tokens=False).ids


@needs_vocabulary
def test_ids_are_those_of_tokenizers():
    fast = tokenize.encoder(VOCABULARY)
    mark = "<|endoftext|>"
    for text in ["Is and  it's\n\n\tdon't 'S ", "é ß 漢字 \U0001f600  x",
                 f"a {mark} b", mark, f"{mark}{mark} {mark[:-1]}", "   ",
                 "1234 5,6", "x" * 3000, "tail  ", "\u3000 \xa0 q",
                 f"x{' ' * 1_000_000}{mark}y", "\n" * 1_000_000]:
        assert fast(text).tolist() == by_tokenizers(text)


@needs_vocabulary
def test_packing_cases(spark):
    long = " ".join(words(2500))
    rows = [(1, None, None, None), (2, "", None, None), (3, long, None, None),
            (3, long, None, None), (4, "a <|endoftext|>b", None, None),
            (5, " " * 600_000, None, None), (None, "a b", None, None)]
    rows += [(10 + i, " ".join(words(1 + 13 * i, i)), None, None)
             for i in range(60)]
    docs = documents(spark, rows)
    got = packing.pack(packing.tokenized(docs, VOCABULARY)).toPandas()
    want = []
    for key, text, *_ in rows:
        ids = [*by_tokenizers(text), 0]
        # from the end, as only the first piece may be short
        ends = list(range(len(ids), 0, -2048))[::-1]
        for i, end in enumerate(ends):
            part = ids[ends[i - 1] if i else 0:end]
            raw = b"".join(x.to_bytes(4, "little") for x in part)
            want.append((key, i, end - len(part), len(part), zlib.crc32(raw)))
    have = [(None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in
            got[["doc_id", "piece", "start", "length", "ids_crc32"]
                ].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    total = 0
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [
            0, *np.cumsum(part.length)[:-1].tolist()]
        assert part.length.sum() <= 2048
        total += 1
    assert total <= -(-got.length.sum() // 2048) + 2
    assert packing.pack(packing.tokenized(docs.limit(0), VOCABULARY)
                        ).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(3000):
        counts[rng.choice([rng.randint(257, 2048), 2048, 1100])] += 1
    sizes = packing.grouped_sizes(counts, 64)
    assert sum(n for _, n in sizes) == 3000
    runs, used = packing.configurations(sizes, 2048)
    order = [k for k in sorted(counts, reverse=True)
             for _ in range(counts[k])]
    filled = defaultdict(int)
    for i, length in enumerate(order):
        at, each, first = runs[np.searchsorted(runs[:, 0], i, "right") - 1]
        filled[first + (i - at) // each] += length
    assert len(filled) == used and max(filled.values()) <= 2048
    least = max(-(-sum(order) // 2048), sum(k > 1024 for k in order))
    assert used <= least * 1.06 + 5


# -- op6 ---------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(8))
def test_schedule_stays_within_a_block(seed):
    rng = random.Random(seed)
    shares = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 12))}
    slots, total = mixing.cycle_slots(shares), sum(shares.values())
    assert sorted(t for _, _, t in slots) == list(range(total))
    seen = dict.fromkeys(shares, 0)
    for i, (name, j, _) in enumerate(slots, 1):
        assert j == seen[name]
        seen[name] += 1
        for s, share in shares.items():
            assert abs(seen[s] - Fraction(i * share, total)) < 1


def test_mix_cases(spark):
    rows = [(i, "t", None, "big") for i in range(200)] + [
        (1000 + i, "t", None, "small") for i in range(7)] + [
        (None, None, None, None), (5, "t", None, "big")]
    docs = documents(spark, rows)
    got = mixing.mix(docs, power=0.5)
    assert got.columns == docs.columns + ["position", "epoch", "slot"]
    rows = sorted(got.select("position", "epoch", "slot", "source", "doc_id")
                  .collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert all(r[2] == r[0] // mixing.BLOCK_DOCS for r in rows)
    shares = mixing.target_shares({"big": 201, "small": 7, None: 1}, 0.5)
    for slot in range(0, len(rows) // 4):
        seen = [r[3] for r in rows if r[2] <= slot]
        for name, share in shares.items():
            assert abs(seen.count(name) / 4
                       - (slot + 1) * share / 1000) < 1
    assert {r[4] for r in rows} == {None, *range(200), *range(1000, 1007)}
    assert sum(r[4] == 5 for r in rows) == 2 + sum(
        r[4] == 5 and r[1] > 0 for r in rows)
    assert mixing.mix(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"big": 1.0})


# -- op7 ---------------------------------------------------------------------

def test_lines(spark):
    line = " ".join(words(60, 3))
    near = edited(line, 1, 9)
    rows = [(1, f"{line}\nown line\n\n", None, None),
            (2, f"other\n{line.upper()}  ", None, None),
            (3, f"{near}\nown\tline", None, None), (4, None, None, None),
            (5, "", None, None), (6, "alone " * 40_000 + "\nx", None, None),
            (7, "alone  " * 40_000, None, None), (None, "x", None, None)]
    docs = documents(spark, rows)
    got = sorted((tuple(r) for r in
                  line_dedup.repeated_lines(docs).collect()), key=str)
    want = [(1, 1, 1, 1, False), (3, 1, 1, 1, True), (6, 0, 6, 0, False),
            (7, 0, 6, 0, True), (6, 1, None, 0, True),
            (None, 0, None, 0, False), (1, 0, 1, 0, False),
            (2, 1, 1, 0, True)]
    fuzzy = [(3, 0, 1, 0, True)]
    assert got == sorted(want + fuzzy, key=str)
    left = {r[0]: r[1] for r in line_dedup.without_repeats(docs).select(
        "doc_id", "text").collect()}
    assert left[2] == "other" and left[1] == rows[0][1] and left[4] is None
    assert line_dedup.repeated_lines(docs.limit(0)).collect() == []


def edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b))


def test_recall_of_fuzzy_lines(spark):
    """Against brute-force edit similarity, and nothing below it."""
    rng = random.Random(12)
    common = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
              for _ in range(300)]
    texts = {}
    for i in range(120):
        line = rng.choices(common, k=rng.randint(8, 30))
        other = list(line)
        for _ in range(rng.choice([1, 1, 2])):  # letters changed or dropped
            at = rng.randrange(len(other))
            spot = rng.randrange(len(other[at]))
            other[at] = (other[at][:spot] + rng.choice(["z", ""])
                         + other[at][spot + 1:]) or "z"
        texts[2 * i], texts[2 * i + 1] = " ".join(line), " ".join(other)
    links = [(2 * i, 2 * i + 1) for i in range(120)
             if edit_similarity(texts[2 * i], texts[2 * i + 1]) >= 0.9]
    docs = documents(spark, [(k, t, None, None) for k, t in texts.items()])
    group = {r.doc_id: r.keep_id for r in
             line_dedup.repeated_lines(docs).collect()}
    found = sum(group.get(b) == a for a, b in links)
    assert len(links) > 100 and found >= 0.9 * len(links)
    for key, keep in group.items():
        assert key == keep or edit_similarity(texts[key], texts[keep]) >= 0.9


def test_simhash_of_close_lines(spark):
    """Majority bits, also beyond the counters' room, and blocks that meet."""
    many = ["w%d" % (i % 7) for i in range(40_000)]
    lines = [" ".join(words(60, 3)), " ".join(many), " ".join(many[:100]),
             " ".join(f"v{i}" for i in range(40_000))]
    docs = documents(spark, [(i, t, None, None)
                             for i, t in enumerate(lines)])
    rows = line_dedup._with_simhash(line_dedup.lines_of(
        docs, "doc_id", "text")).orderBy("key").collect()
    hashes = {r[0]: r[1] for r in spark.createDataFrame(
        [(w,) for w in {w for t in lines for w in t.split()}],
        "w string").selectExpr("w", "xxhash64(w)").collect()}
    for r, text in zip(rows, lines, strict=True):
        split = set(text.split())
        want = 0
        for bit in range(64):
            ones = sum(hashes[w] >> bit & 1 for w in split)
            want |= (2 * ones > len(split)) << bit
        assert r["sim"] & (2**64 - 1) == want


# -- op8 ---------------------------------------------------------------------

def test_trees(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, "user", "q <b>& \\ x", 0.0),
         (1, 2, 1, "assistant", "a</turn>\n&lt;", 1.0),
         (1, 3, 1, "assistant", None, 5.0),
         (1, 4, 2, "us>er\n", "more", 9.0),
         (1, 5, 4, "assistant", "<turn user>\nend", None),
         (2, 1, 2, "x", "ring", 1.0), (2, 2, 1, "x", "ring", 1.0),
         (3, 1, 99, None, "", 1.0)],
        "tree long, node long, parent long, role string, text string, "
        "score double")
    done = chat_format.format_trees(nodes, top=2)
    got = {(r["tree"], r["branch"]): r for r in done.select(
        "tree", "branch", "leaf",
        chat_format.read_turns(done.formatted).alias("turns"),
        chat_format.read_loss(done.formatted, done.loss_spans).alias("loss"))
        .collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 1)}
    assert [tuple(t) for t in got[1, 1]["turns"]] == [
        ("user", "q <b>& \\ x"), ("assistant", "a</turn>\n&lt;"),
        ("us>er\n", "more"), ("assistant", "<turn user>\nend")]
    assert got[1, 1]["loss"] == "a</turn>\n&lt;<turn user>\nend"
    assert got[1, 2]["leaf"] == 3 and got[1, 2]["loss"] == ""
    assert [tuple(t) for t in got[3, 1]["turns"]] == [("", "")]
    assert chat_format.format_trees(nodes.limit(0)).collect() == []


def test_long_chain_and_repeated_turns(spark):
    turns = spark.createDataFrame(
        [(1, i // 2, "user", f"t{i}") for i in range(100)]
        + [(None, None, None, None)],
        "conv_id long, turn long, role string, text string")
    done = chat_format.format_trees(chat_format.as_tree(turns))
    got = {r[0]["id"] if not r[0]["none"] else None: [t["text"] for t in r[1]]
           for r in done.select("tree", chat_format.read_turns(
               done.formatted)).collect()}
    assert got == {None: [""], 1: [
        t for i in range(0, 100, 2)
        for t in sorted([f"t{i}", f"t{i + 1}"])]}


# -- op9 ---------------------------------------------------------------------

def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    rows, key = [], 0
    for i, v in enumerate(base):
        for j in range(1 + 3 * (i % 7)):
            noise = 0 if j % 4 == 3 else 0.06 * rng.normal(size=24)
            x = (v + noise) * (1 if isinstance(noise, int) else j + 1)
            rows.append((key, [float(np.float32(a)) for a in x], i % 3))
            key += 1
    odd = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 24, 1),
           (9003, [float("nan")] * 24, 1), (9004, [float("inf")] * 24, 1),
           (9005, [None] * 24, 1), (9006, rows[0][1], None),
           (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1)]
    vectors = spark.createDataFrame(
        rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in
           vector_dedup.near_vectors(vectors).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if rows[a][2] == rows[b][2] and x[a] @ x[b] >= 0.93]
    label = smallest(range(len(rows)), links) | {
        k: k for k in range(9000, 9008)} | {9008: 9007}
    degree = defaultdict(int, {9007: 1, 9008: 1})
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    recall = sum(got[k]["n_links"] for k in label) / sum(degree.values())
    assert recall >= 0.9
    assert all(got[k]["n_links"] <= degree[k] for k in label)
    if recall == 1:
        assert {k: r["component_id"] for k, r in got.items()} == label
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert vector_dedup.near_vectors(vectors.limit(0)).collect() == []


# -- op10 --------------------------------------------------------------------

def test_url_rules(spark):
    rows = [(1, "https://WWW.Example.com/en/1?q=/x", None),
            (2, "http://a.example.com/en/", None),
            (3, "http://example.com/EN/", None), (4, "x.net/es/", None),
            (5, "ftp://x.net/es/a#b", None), (6, None, None),
            (7, "http://net/fr/", None), (8, "://xnet/es/", None),
            (9, "a://b.com?x=://c.net/es/", None), (10, "", ""),
            (11, "http://b.com", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html "
                                  "string").selectExpr(
        "*", "1 as host", "2 as _best", "3 as rest", "'v' as rule_verdict")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in url_filter.filter_urls(pages).collect()}
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("a.example.com", "/en/", "example.com/en/", "block"),
        3: ("example.com", "/EN/", "com/", "allow"),
        4: ("", "", None, "allow"), 5: ("x.net", "/es/a", "net/es/", "block"),
        6: ("", "", None, "allow"), 7: ("net", "/fr/", "net/fr/", "block"),
        8: ("xnet", "/es/", None, "allow"), 9: ("b.com", "", None, "allow"),
        10: ("", "", None, "allow"), 11: ("b.com", "", None, "allow")}
    kept = url_filter.filter_urls(pages).select("rule_verdict", "rest")
    assert {tuple(r) for r in kept.collect()} == {("v", 3)}
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_distrust_goes_against_links(spark):
    link = '<a class="x" href="{}">t</a>'.format
    rows = [("http://bad.net/es/1", ""),
            ("http://farm.org/1", link("https://BAD.net/es/1")),
            ("http://good.com/1", link("//fine.org/x")),
            ("http://fine.org/1", link("/own")),
            ("http://far.org/1", "")]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {r["host"]: r for r in url_filter.filter_urls(pages).collect()}
    assert got["farm.org"]["verdict"] == "block"
    assert got["farm.org"]["distrust"] == pytest.approx(0.85 * 0.15)
    assert got["fine.org"]["trust"] == pytest.approx(0.85 * 0.15)
    assert got["fine.org"]["verdict"] == got["far.org"]["verdict"] == "allow"


# -- shared ------------------------------------------------------------------

def ranks_by_hand(seeds, edges, way):
    """Personalised PageRank by plain iteration, far beyond convergence."""
    links = defaultdict(float)
    for a, b, n in edges:
        links[(a, b) if way > 0 else (b, a)] += n
    total = defaultdict(float)
    for (a, _), n in links.items():
        total[a] += n
    start = {h: 0.15 * abs(w) for h, w in seeds if w * way > 0}
    score = dict(start)
    for _ in range(300):
        after = defaultdict(float, start)
        for (a, b), n in links.items():
            after[b] += 0.85 * score.get(a, 0) * n / total[a]
        score = after
    return score


def test_ranks_converge(spark):
    """Against plain iteration, on a chain longer than any fixed few rounds."""
    rng = random.Random(8)
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(30)]
    edges += [(f"h{rng.randrange(30)}", f"h{rng.randrange(30)}",
               rng.randint(1, 4)) for _ in range(25)]
    edges = [(a, b, n) for a, b, n in dict.fromkeys(edges) if a != b]
    seeds = [("h0", 1.0), ("h30", -1.0), ("h7", 0.4), ("h12", 0.0)]
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(
        spark.createDataFrame(seeds, "host string, weight double"),
        spark.createDataFrame(edges, "src string, dst string, links long"),
        tolerance=1e-7).collect()}
    for place, way in ((0, 1), (1, -1)):
        want = ranks_by_hand(seeds, edges, way)
        for host, score in want.items():
            assert abs(got.get(host, (0, 0))[place] - score) < 1e-5
    assert got["h20"][0] > 0 and got["h3"][1] > 0


def test_links_behind_long_attributes_and_hosts_of_many_labels(spark):
    long = "x" * 5000
    rows = [(1, "http://farm.org/", f'<a title="{long}" href="http://b.net/">'
             + "<a " * 20_000), (2, "http://b.net/es/", None),
            (3, f"http://{'a.' * 20_000}net/es/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert got[1].distrust > 0.1 and got[1].verdict == "block"
    assert got[3].rule == "net/es/"


def test_clean_sources_name_no_local_folder():
    root = Path(language_id.__file__).parent
    for path in root.glob("*.py"):
        text = path.read_text()
        assert not re.search(r"localCheckpoint|crossJoin", text), path


@pytest.mark.parametrize("few", [substring_dedup.FEW, 1])
def test_no_linked_paragraphs_are_left_out(spark, monkeypatch, few):
    """Groups against all pairs of paragraphs: by pairs, and by subsets."""
    monkeypatch.setattr(substring_dedup, "FEW", few)
    rng, base = random.Random(4), words(60, 9)
    texts = []
    for kind in (base, (base[:7] * 9)[:60]):
        for _ in range(30):
            text = list(kind)
            for at in rng.sample(range(60), rng.choice([2, 4])):
                text[at] = words(1, rng.randrange(10**9))[0]
            texts.append(" ".join(text))
    units = [(i, int(at), set(row.tolist())) for i, t in enumerate(texts)
             for at, row in zip(*substring_dedup.paragraphs(t), strict=True)]
    group = list(range(len(units)))
    for x, (_, _, a) in enumerate(units):
        for y, (_, _, b) in enumerate(units[:x]):
            if 100 * len(a & b) >= 80 * len(a | b) and group[x] != group[y]:
                old = group[x]
                group = [group[y] if g == old else g for g in group]
    keys = defaultdict(set)
    for (i, _, _), g in zip(units, group, strict=True):
        keys[g].add(i)
    want = {(i, at + k) for (i, at, _), g in zip(units, group, strict=True)
            for k in range(24) if len(keys[g]) > 1}
    docs = spark.createDataFrame(list(enumerate(texts)),
                                 "doc_id long, text string")
    got = {(r.doc_id, k) for r in substring_dedup.repeated_passages(
        docs).collect() for k in range(r.start, r.end)}
    assert got == want and len({i for i, _ in want}) > 20


def test_lines_are_normalised_once_and_alike(spark):
    texts = ["A  b\n\t\n \x0b\f\r \nC\td\n x ", " one two \n\n\r", "É  è",
             "plain line", "", None, "a\x0bb\fc\rd  e \t f"]
    docs = spark.createDataFrame(list(enumerate(texts)),
                                 "doc_id long, text string")
    lines = line_dedup.lines_of(docs, "doc_id", "text")
    blank = re.compile("[\t\x0b\f\r ]{2,}|[\t\x0b\f\r]")
    want = {(k, i, norm) for k, t in enumerate(texts) if t is not None
            for i, line in enumerate(t.split("\n"))
            if (norm := blank.sub(" ", line).strip(" ").lower())}
    assert {(r.key, r.line_no, r.norm) for r in lines.collect()} == want
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_close_lines_by_word_and_by_letter(spark):
    body = " ".join(f"word{i}" for i in range(12))
    texts = [body, body.replace("word3", "wort3"), body.replace("word4 ", "word4"),
             body.replace("word1", "xyzab")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)],
                                 "doc_id long, text string")
    ids = {t: spark.sql("select xxhash64(?)", args=[t]).first()[0]
           for t in texts}
    pairs = spark.createDataFrame(
        [(ids[texts[0]], ids[t]) for t in texts[1:]], "a long, b long")
    got = {r.b for r in line_dedup._verified(
        pairs, docs, "doc_id", "text", 0.9).collect()}
    # of 73 letters 7 may change: one letter, a lost blank, not 15 letters
    assert got == {ids[t] for t in texts[1:3]}


def test_subsets_in_passes_and_sketches(spark):
    """Crowds are linked in parts, with the links that one part gives, and
    sketches of linked sets differ in few bits."""
    rng, base = random.Random(3), list(range(1, 21))
    sets = [sorted(rng.sample(base, 18) + [100 + i, 200 + i])
            for i in range(20)] + [base[:18] + [50, i] for i in (51, 52, 53)]
    df = spark.createDataFrame(
        [(i, 20, s, [20]) for i, s in enumerate(sets)],
        "same long, n int, shingles array<long>, sizes array<int>")
    few = substring_dedup._by_subsets(df, 10**9)
    many = substring_dedup._by_subsets(df, 1_500)
    assert len(few) == 1 and len(many) == -(-23 * 190 // 1_500)
    pairs = [{(r.a, r.b) for t in parts for r in t.collect()}
             for parts in (few, many)]
    assert pairs[0] == pairs[1] and {(20, 21), (20, 22)} <= pairs[0]
    size, _, sketch = substring_dedup._smallest(np.array(
        [base, base[:18] + [50, 51], base[:19] + [19]], np.uint64))
    assert list(size) == [20, 20, 19]
    assert int(sketch[0] ^ sketch[1]).bit_count() <= 4
    assert int(sketch[0] ^ sketch[2]).bit_count() == 1


def test_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager(
        ).diskBlockManager()
    had = disk.getAllBlocks().mkString(" ").count("shuffle_")
    option = spark.conf.get(shared._CLEANUP, None)
    kept = shared.cut(spark.range(1000).repartition(5, "id").groupBy(
        "id").count())
    for _ in range(50):  # they are removed behind the job
        if (left := disk.getAllBlocks().mkString(" ").count(
                "shuffle_")) <= had:
            break
        time.sleep(0.1)
    assert left <= had and spark.conf.get(shared._CLEANUP, None) == option
    assert kept.count() == 1000
    shared.discard(kept)
