"""Code points of UTF-8 rows: letters, lower case and letter words as arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

from gridpulse.llm._text import mix

_LAST = 0x110000
_NAMED = 0x33480  # no letters are assigned above


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, its lower case) by code point; one code point maps to one."""
    letter = np.zeros(_LAST, bool)
    lower = np.arange(_LAST, dtype=np.uint32)
    for k in range(_NAMED):
        c = chr(k)
        if c.isalpha():
            letter[k] = True
            small = c.lower()
            if len(small) == 1:
                lower[k] = ord(small)
    return letter, lower


def codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row bounds) with a line feed after every row."""
    raw = data.tobytes()
    try:
        text = raw.decode()
        at = np.append(0, np.cumsum((data & 0xC0) != 0x80))[bounds]
    except UnicodeDecodeError:
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        text, at = "".join(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    found = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.insert(found, at[1:], 10), at + np.arange(len(at))


def letter_words(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points, starts, ends, rows) of all runs of letters."""
    letter, lower = tables()
    full = letter[points]
    edge = np.diff(np.concatenate([[0], full.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return lower[points], starts, ends, np.searchsorted(bounds, starts, "right") - 1


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the code points of every run."""
    width = ends - starts
    out = np.zeros(len(starts), np.uint64)
    live = np.arange(len(starts))
    for k in range(int(width.max()) if len(width) else 0):
        live = live[width[live] > k]
        if len(live) < 64:
            break
        out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C55) + points[starts[live] + k])
    else:
        live = live[:0]
    for j in live:  # the few longest runs
        h = out[j : j + 1]
        for x in points[starts[j] + k : ends[j]]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C55) + np.uint64(x))
        out[j] = h[0]
    return out
