"""Suffix sorting in two stages.

A suffix is of the small type if it is smaller than its successor. Stage one sorts these directly; stage two induces
all others by scans over first-byte buckets in ascending order: whatever stands in a bucket places its predecessor,
where that is of the large type, at the front of the predecessor's bucket. The scan runs a bucket at a time on arrays.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, big-endian, zeros beyond the end."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    out = padded[: len(text)].copy()
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[k : len(text) + k]
    return out


def small_type(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=bool)
    differs = np.append(text[1:] != text[:-1], True)
    # the next place where neighbours differ decides for the whole run before it
    place = np.where(differs, np.arange(n), n)
    place = np.minimum.accumulate(place[::-1])[::-1]
    following = np.minimum(place + 1, n - 1)
    return (place + 1 < n) & (text[place] < text[following])


def sort_directly(text: np.ndarray, data: bytes, words: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """The chosen suffixes by their first `depth` bytes: two words by array sort, ties by their further bytes."""
    beyond = np.zeros(len(text) + 8, dtype=np.uint64)
    beyond[: len(text)] = words
    order = chosen[np.lexsort((beyond[np.minimum(chosen + 8, len(text))], words[chosen]))]
    first, second = words[order], beyond[np.minimum(order + 8, len(text))]
    same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    if not same.any():
        return order
    tied = np.concatenate((same, [False])) | np.concatenate(([False], same))
    places = np.flatnonzero(tied)
    group = np.cumsum(np.concatenate(([True], ~same)))[places]
    keys = [g.to_bytes(5, "big") + data[i + 16 : i + depth] for g, i in zip(group.tolist(), order[places].tolist(), strict=True)]
    order[places] = order[places[sorted(range(len(keys)), key=keys.__getitem__)]]
    return order


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """All suffixes by their first `depth` bytes (16 at least); the order of such ties is not defined."""
    text = np.frombuffer(data, dtype=np.uint8)
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    small = small_type(text)
    words = words_at(text)
    direct = sort_directly(text, data, words, np.flatnonzero(small), max(16, depth))
    counts = np.bincount(text, minlength=256)
    starts = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(n, dtype=np.int64)
    of = np.searchsorted(text[direct], np.arange(257))
    for c in range(256):
        own = direct[of[c] : of[c + 1]]
        out[starts[c + 1] - len(own) : starts[c + 1]] = own
    heads = starts[:-1].copy()

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        edges = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(before, edges) if len(before) else ():
            c = text[part[0]]
            out[heads[c] : heads[c] + len(part)] = part
            heads[c] += len(part)

    induce(np.array([n]))  # the empty suffix stands first: its predecessor is the last byte
    for c in range(256):
        done = starts[c]
        while done < heads[c]:
            end = heads[c]
            induce(out[done:end])
            done = end
        if len(range(of[c], of[c + 1])):
            induce(direct[of[c] : of[c + 1]])
    return out


def common_prefixes(data: bytes, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, `most` at most (a multiple of 8)."""
    text = np.frombuffer(data, dtype=np.uint8)
    n = len(text)
    words = np.concatenate((words_at(text), np.zeros(most + 8, dtype=np.uint64)))
    out = np.zeros(len(left), dtype=np.int64)
    alive = np.arange(len(left))
    for at in range(0, most, 8):
        x = words[left[alive] + at] ^ words[right[alive] + at]
        full = x == 0
        rest = alive[~full]
        # the leading zero bytes of the difference
        x = x[~full]
        zeros = np.zeros(len(x), dtype=np.int64)
        for k in range(8):
            zeros += (x >> np.uint64(8 * (7 - k))) == 0
        out[rest] += zeros
        out[alive[full]] += 8
        alive = alive[full]
        if not len(alive):
            break
    return np.minimum(out, np.minimum(n - left, n - right))
