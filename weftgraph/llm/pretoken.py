"""Pre-tokens of byte-level BPE over whole Arrow batches.

PATTERN (a fixed value of the public vocabularies) is evaluated without a regex engine: boundaries follow from the
classes letter, number, space and other of neighbouring characters. Other patterns go through the regex module.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import regex

from .words import byte_hash

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(lo, hi)))
        for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(what, text):
                out[lo + m.start() : lo + m.end()] = kind
    return out


def split(data: np.ndarray, offsets: np.ndarray, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all pre-tokens in order; first[i]:first[i + 1] are those of row i."""
    if pattern != PATTERN:
        starts, ends, first = [], [], [0]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            at = int(a)
            for x in regex.findall(pattern, data[a:b].tobytes().decode()):
                starts.append(at)
                at += len(x.encode())
                ends.append(at)
            first.append(len(starts))
        return np.array(starts, np.int64), np.array(ends, np.int64), np.array(first, np.int64)
    n_bytes = len(data)
    if not n_bytes:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    char = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    byte = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _classes()[char]
    n = len(char)
    opens = np.zeros(n + 1, bool)  # the first character of a row
    opens[np.searchsorted(byte, offsets[offsets < n_bytes])] = True
    opens[n] = True
    space = kind == SPACE
    begin = opens[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    blank = char == 32
    held = np.zeros(n, bool)  # a blank before this character belongs to it
    held[1:] = blank[:-1] & ~space[1:] & ~opens[1:n]
    begin &= ~held
    last = space.copy()  # the last space before something else
    last[:-1] &= ~space[1:] & ~opens[1:n]
    last[-1] = False
    begin |= last
    quote = np.flatnonzero((char == 39) & begin)
    if len(quote):
        padded, shut = np.append(char, np.zeros(3, np.uint32)), np.append(opens, [True, True])
        one, two = padded[quote + 1], padded[quote + 2]
        near = ~shut[quote + 1]
        single = near & np.isin(one, [ord(c) for c in "stmd"])
        double = near & ~shut[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        begin[quote[single | double] + 1] = False
        after = np.concatenate([quote[single] + 2, quote[double] + 3])
        after = after[after < n]
        begin[after[kind[after] == LETTER]] = True
    start = byte[begin]
    end = np.append(start[1:], n_bytes)
    return start, end, np.searchsorted(start, offsets)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """data[start:start + length] of all, one after another."""
    total = int(length.sum())
    return data[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)]


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of the distinct pre-tokens in order of appearance, and the number of each; compared byte by byte."""
    h = byte_hash(data, start, end)
    code, found = pd.factorize(h)
    where = np.zeros(len(found), np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    length = end - start
    same = bool((length == length[where][code]).all())
    for lo in range(0, len(code), 1 << 18):
        if not same:
            break
        a, n = start[lo : lo + (1 << 18)], length[lo : lo + (1 << 18)]
        same = bool((gather(data, start[where][code[lo : lo + (1 << 18)]], n) == gather(data, a, n)).all())
    if not same:  # two different pre-tokens of one hash
        code, _ = pd.factorize(np.array([data[a:b].tobytes() for a, b in zip(start, end, strict=True)], object))
        where = np.unique(code, return_index=True)[1]
    return start[where], length[where], h[where], code.astype(np.uint32)
