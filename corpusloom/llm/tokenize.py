"""Token ids of whole texts by a public vocabulary, for use inside tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# The pattern that splits text before byte-level BPE, and the
# printable stand-ins that vocabulary files use for bytes.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
         r"|\s+(?!\S)|\s+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return ({chr(b): b for b in PRINTABLE}
            | {chr(256 + i): b for i, b in enumerate(rest)})


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Function from a text to its ids (uint32) by the tokenizer at ``path``.

    The ids are those of tokenizers with ``add_special_tokens=False``: none is
    added, but a special string inside a text is its own id. A plain byte-level
    BPE is run by tiktoken on the file's own vocabulary, three times as fast
    with the same ids; what it can't split (blanks by the hundred thousand), and
    all other files, are run by tokenizers.
    """
    @lru_cache(maxsize=1)  # most workers never need it
    def whole() -> Tokenizer:
        return Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(whole().encode(text, add_special_tokens=False).ids,
                        np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = spec.get("added_tokens", [])
    plain = (before.get("type") == "ByteLevel" and model["type"] == "BPE"
             and before.get("use_regex", True) and not spec.get("normalizer")
             and not before.get("add_prefix_space")
             and not any(t[flag] for t in added for flag in (
                 "single_word", "lstrip", "rstrip", "normalized")))
    if not plain:
        return slow
    byte_of = _byte_of()
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in token): i
             for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks,
                             special_tokens={})
    marks = re.compile("|".join(map(re.escape, sorted(
        special, key=len, reverse=True))) or r"(?!)")

    def part(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its pattern runs out of stack on long blanks
            return slow(text)

    def encode(text: str) -> np.ndarray:
        found, at = [], 0
        for mark in marks.finditer(text):
            found += [part(text[at:mark.start()]),
                      np.array([special[mark[0]]], np.uint32)]
            at = mark.end()
        return (np.concatenate([*found, part(text[at:])]) if found
                else part(text))

    return encode
