"""Repair of conversations against a search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import conversation_repair as cr
from tests.llm.test_operators import SF, needs_data

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
           "cost", "audit", "repaired_sha256"]
BLANK = re.compile(r"[\x20\x09-\x0D]")


def faults_of(rows):
    """Fault of each (turn, role, text), rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        plain = BLANK.sub("", text)
        out.append("blank" if not plain else "duplicate" if (role, text)
                   in seen else "" if plain[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns) by trying every edit, from the last row back."""
    after = {None: "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {q: (0, "", ()) if q in (None, "a") else None for q in after}

    def with_inserts(best):
        best = dict(best)
        for _ in range(3):
            for q in after:
                for r in after[q]:
                    if r != "s" and best[r]:
                        cost, audit, kept = best[r]
                        new = (cost + 3, "I" + audit,
                               (f"{names[r]}:", *kept))
                        best[q] = min(filter(None, (best[q], new)),
                                      key=lambda x: x[:2])
        return best

    best = with_inserts(best)
    for (_, role, text), fault in reversed(list(zip(rows, faults,
                                                    strict=True))):
        found = {}
        for q in after:
            cost, audit, kept = best[q]
            options = [(cost + 4, "D" + audit, kept)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for r in after[q]:
                    cost, audit, kept = best[r]
                    if role[:1] == r:
                        options.append((cost + more, "K" + audit,
                                        (f"{role}:{text}", *kept)))
                    if r != "s":
                        options.append((cost + 3 + more, "R" + audit,
                                        (f"{names[r]}:{text}", *kept)))
            found[q] = min(options, key=lambda x: x[:2])
        best = with_inserts(found)
    return best[None]


def expected(table):
    """Rows of the query for (conv_id, turn, role, text) rows."""
    kept, out = defaultdict(list), []
    for conv, turn, role, text in table:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        rows = kept[conv]
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text
                                            ) if h == 2 else text
            rows += [(turn, "user" if h == 4 else role, text)] * (1 + (h == 3))
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        faults = faults_of(rows)
        cost, audit, turns = cheapest(rows, faults)
        known = [r[0] for r in rows if r[0] is not None]
        pairs = zip(rows, rows[1:], strict=False)
        out.append((
            conv, max(known) - min(known) + 1 - len(set(known)) if known
            else 0, *[faults.count(f) for f in ("blank", "duplicate",
                                                "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                for a, b in pairs), cost, audit,
            hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(spark, folder):
    got = cr.op11_conversation_repair(spark, str(folder))
    return sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr)


def write(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows],
                          "conv_id long, turn long, role string, text string, "
                          "seq int, codes string, conv string"
                          ).write.parquet(f"{folder}/conversations.parquet")


@needs_data
def test_query_against_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(
        f"{SF}/conversations.parquet").select("conv_id", "turn", "role",
                                              "text").collect()]
    assert result(spark, SF) == expected(table)


def random_rows(n, conversations, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "u2", "", None]
    texts = ["Yes.", "no", "", " \t", "Why?", "é!", None, "a. "]
    out = []
    for _ in range(n):
        conv = rng.choice([*range(conversations), None])
        turn = rng.choice([None, *range(30)])
        text = rng.choice(texts)
        if text and rng.random() < 0.7:
            text = f"{rng.random():.3f} {text}"
        out.append((conv, turn, rng.choices(roles, [9, 9, 3, 1, 1, 0, 1])[0],
                    text))
    return out


def test_random_conversations(spark, tmp_path):
    rows = random_rows(1500, 150, 1)
    rows += [(900, 5, "user", "x"), (901, None, None, None)]
    lost = next(i for i in range(2000, 3000)
                if not zlib.crc32(f"{i}:0".encode()) % 20)
    rows.append((lost, 0, "user", "gone"))
    write(spark, tmp_path, rows)
    want = expected(rows)
    assert result(spark, tmp_path) == want
    nothing = hashlib.sha256(b"").hexdigest()
    assert (lost, 0, 0, 0, 0, 0, 0, "", nothing) in want


def test_one_conversation_over_many_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 16)
    monkeypatch.setattr(cr, "CHUNK", 64)
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]),
             rng.choice(["Yes.", "no", f"{i}.", f"{i}", ""]))
            for i in range(1500)]
    rows += random_rows(300, 40, 4)
    write(spark, tmp_path, rows)
    assert result(spark, tmp_path) == expected(rows)


def test_rows_of_the_repair(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", ""),
            (1, 2, "user", "Yes!"), (1, 3, "user", "Yes!"), (2, 0, "user", "a")]
    turns = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string")
    got = cr.repair(turns)
    shown = [tuple(r) for r in got.collect()]
    assert [r for r in shown if r[0] == 1] == [
        (1, "I", None, None, None, "user", ""),
        (1, "K", None, 0, "assistant", "assistant", "Hello."),
        (1, "D", "blank", 1, "user", None, ""),
        (1, "K", None, 2, "user", "user", "Yes!"),
        (1, "D", "duplicate", 3, "user", None, "Yes!"),
        (1, "I", None, None, None, "assistant", "")]
    assert [r for r in shown if r[0] == 2] == [
        (2, "D", "truncated", 0, "user", None, "a")]


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [])
    assert result(spark, tmp_path) == []


@pytest.mark.parametrize("seed", range(4))
def test_scan_and_ranks_of_random_codes(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 40, 30)
    codes = rng.choice([0, 1, 2, 3, 6, 11, 18, 19, 16], int(lengths.sum()))
    done = cr.segment_audits(codes, lengths, np.tile(cr.AT_END, (30, 1)),
                             np.ones(30, bool))
    start = 0
    for n, (audits, exits) in zip(lengths.tolist(), done, strict=True):
        part = codes[start:start + n].tolist()
        start += n
        rows = [(0, " sua"[c & 3], "") for c in part]
        faults = [cr.FAULTS.get(c & ~3, "") for c in part]
        assert audits[cr.START] == cheapest(rows, faults)[1]
        assert exits[cr.START] in (cr.START, cr.ASSISTANT)
