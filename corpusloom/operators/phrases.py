"""Phrases of a bounded dictionary in texts, without rows for n-grams.

The bytes of many texts lie one after another, and every place of them is looked
up at once: eight bytes (four, two or one for shorter phrases) are one number.
Each phrase is met on that stretch of it that the fewest phrases have, and then
compared as a whole. Nothing leaves the task but the numbers of the phrases that
a text contains.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

WIDTHS = (8, 4, 2, 1)
PLACES = 1 << 18  # places looked up at once
_BITS = 18
_U = np.uint64


def _numbers(data: np.ndarray, width: int) -> np.ndarray:
    """The number of the ``width`` bytes from each place on."""
    n = max(0, len(data) - width + 1)
    return np.ndarray((n,), f"<u{width}", data, strides=(1,)).astype(_U)


def _slot(values: np.ndarray) -> np.ndarray:
    return ((values * _U(0x9E3779B97F4A7C15)) >> _U(64 - _BITS)).astype(np.intp)


class Phrases:
    """``listed``: distinct phrases, told by their place in it. An empty one is
    in every text."""

    def __init__(self, listed: list[str]):
        self.listed = listed

    def __reduce__(self):
        return Phrases, (self.listed,)

    @cached_property
    def _classes(self) -> list[tuple]:
        raw = [p.encode("utf-8", "surrogatepass") for p in self.listed]
        out = []
        for width in WIDTHS:
            ids = [i for i, p in enumerate(raw) if len(p) >= width and (
                width == 8 or len(p) < 2 * width)]
            if not ids:
                continue
            parts = [_numbers(np.frombuffer(raw[i], np.uint8), width)
                     for i in ids]
            value, count = np.unique(np.concatenate(
                [np.unique(p) for p in parts]), return_counts=True)
            at = [int(count[np.searchsorted(value, p)].argmin())
                  for p in parts]
            met = np.array([p[a] for p, a in zip(parts, at)], _U)
            order = np.argsort(met, kind="stable")
            names, first, many = np.unique(met[order], return_index=True,
                                           return_counts=True)
            size = np.array([len(raw[i]) for i in ids])[order]
            # places of a phrase that together are all of it
            steps = -(-int(size.max()) // width)
            off = np.minimum(np.arange(steps)[None, :] * width,
                             size[:, None] - width)
            want = np.stack([parts[j][o] for j, o in zip(order, off)])
            known = np.zeros(1 << _BITS, bool)
            known[_slot(names)] = True
            out.append((width, known, names, first, many,
                        np.array(ids)[order], np.array(at)[order], size, off,
                        want))
        return out

    def found(self, texts: pa.Array) -> pa.Array:
        """``list<int>``: the phrases in each text, in order; none in null."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, ends, body = texts.buffers()
        n = len(texts)
        ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + n + 1]
        data = np.frombuffer(body, np.uint8)[:ends[-1]] if (
            body is not None and n) else np.zeros(0, np.uint8)
        empty = [i for i, p in enumerate(self.listed) if not p]
        hits = [np.arange(n) * len(self.listed) + i for i in empty] + [
            np.zeros(0, np.int64)]
        for one in self._classes:
            width = one[0]
            begin = int(ends[0]) if n else 0
            for i in range(begin, len(data) - width + 1, PLACES):
                value = _numbers(data[i:i + PLACES + width - 1], width)
                hits.append(self._hits(data, ends, i, value, one))
        every = np.unique(np.concatenate(hits))
        text, phrase = np.divmod(every, max(1, len(self.listed)))
        starts = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts),
                                        pa.array(phrase.astype(np.int32)))

    def _hits(self, data: np.ndarray, ends: np.ndarray, begin: int,
              value: np.ndarray, one: tuple) -> np.ndarray:
        """Number of the text times all phrases, plus that of the phrase."""
        width, known, names, first, many, ids, at, size, off, want = one
        place = np.flatnonzero(known[_slot(value)])
        name = np.minimum(np.searchsorted(names, value[place]), len(names) - 1)
        right = names[name] == value[place]
        place, name = place[right], name[right]
        out, step = [], max(1, PLACES // int(many.max()))
        for i in range(0, len(place), step):
            here, which = place[i:i + step] + begin, name[i:i + step]
            times = many[which]
            last = np.cumsum(times)
            # every phrase that is met on this stretch
            row = (np.arange(last[-1]) - np.repeat(last - times, times)
                   + np.repeat(first[which], times))
            start = np.repeat(here, times) - at[row]
            text = np.searchsorted(ends, start, "right") - 1
            inside = (start >= ends[0]) & (start + size[row] <= ends[
                np.minimum(text + 1, len(ends) - 1)])
            row, start, text = row[inside], start[inside], text[inside]
            numbers = np.ndarray((max(0, len(data) - width + 1),),
                                 f"<u{width}", data, strides=(1,))
            for k in range(off.shape[1]):
                same = numbers[start + off[row, k]] == want[row, k]
                row, start, text = row[same], start[same], text[same]
            out.append(np.unique(text * len(self.listed) + ids[row]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)
