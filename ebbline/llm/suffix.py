"""Suffix-array dedup of bytes.

Shards hold the spans that several documents share (see spans). Each shard's suffix array comes from Larsson-Sadakane
refinement (ranks double their depth, only groups that are not yet single are sorted again), Kasai's algorithm in
vector form gives common prefixes, runs of neighbours with `length` common bytes are equal windows, and windows of
different shards of one key meet by binary search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ebbline.llm.spans import remove_earlier

#: Bytes in one suffix array; a task takes about 100 bytes of memory for each.
SHARD_BYTES = 1 << 20
#: Bytes of the hashes that anchors come from.
ANCHOR_BYTES = 20


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of the suffixes of several strings by Larsson-Sadakane refinement; equal ones stand by position.

    Each string ends with a 0, other symbols are 1 to 256; left: symbols before that 0. Ranks by the first h symbols
    sort each group by the rank of the suffix h further on; h doubles and groups of one are left alone.
    """
    n, h = len(text), 7
    packed = np.zeros(n, np.uint64)
    for i in range(h):
        packed <<= np.uint64(9)
        if i < n:
            packed[: n - i] |= np.where(left[: n - i] > i, text[i:], 0).astype(np.uint64)
    order = np.argsort(packed, kind="stable")
    new = np.append(True, packed[order][1:] != packed[order][:-1])
    rank = np.empty(n, np.int64)
    while True:
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, n))
        rank[order] = np.repeat(heads, sizes)
        live = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(live) or h > left.max():
            return order
        suffix = order[live]
        ahead = np.where(left[suffix] > h, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        again = np.lexsort((ahead, rank[suffix]))
        suffix, ahead = suffix[again], ahead[again]
        order[live] = suffix
        new[live[1:]] |= ahead[1:] != ahead[:-1]
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's common prefixes of neighbours in the order, by text position.

    A prefix is one less than that of the position before wherever the two symbols before are equal; the others are
    compared symbol by symbol, all at once.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = (before > 0) & (at > 0)
    follows[follows] = (text[at[follows] - 1] == text[before[follows] - 1]) & (text[at[follows] - 1] != 0)
    own = at[~follows]
    prefix = np.zeros(n, np.int64)
    live, h = own[before[own] >= 0], 0
    while len(live):
        a, b = live + h, before[live] + h
        live = live[(text[a] == text[b]) & (text[a] != 0)]
        prefix[live] += 1
        h += 1
    last = np.maximum.accumulate(np.where(follows, 0, at))
    return prefix[last] - (at - last)


def shards_of(order: np.ndarray, keys: np.ndarray, n: np.ndarray, shard_bytes: int):
    """Rows in groups of shards that have no key in common: whole keys up to shard_bytes are one shard, a larger key is several."""
    heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(order) else np.zeros(0, np.int64)
    held, size = [], 0
    for rows in np.split(order, heads[1:]) if len(heads) else []:
        total = int(n[rows].sum())
        if held and size + total > shard_bytes:
            yield [np.concatenate(held)]
            held, size = [], 0
        if total > shard_bytes:
            begins, filled = [], 0
            for i, x in enumerate(n[rows].tolist()):
                if filled and filled + x > shard_bytes:
                    begins.append(i)
                    filled = 0
                filled += x
            yield np.split(rows, begins)
        else:
            held.append(rows)
            size += total
    if held:
        yield [np.concatenate(held)]


def array_resolver(shard_bytes: int):
    """Equal windows have equal keys, so only the shards of one key meet, and a task holds no others."""

    def sorted_windows(units, at, n, ids, length, rows):
        """Of one shard: position and document of each window in order, the run of equal ones that it is in, and each run's least document."""
        sizes = n[rows]
        ends = np.cumsum(sizes + 1)
        where = np.arange(ends[-1]) - np.repeat(ends - sizes - 1, sizes + 1) + np.repeat(at[rows], sizes + 1)
        stop = np.zeros(len(where), bool)
        stop[ends - 1] = True
        text = np.where(stop, 0, units[np.minimum(where, len(units) - 1)].astype(np.int16) + 1).astype(np.uint16)
        left = np.repeat(ends - 1, sizes + 1) - np.arange(len(where))
        order = suffix_array(text, left)
        # A suffix too short for a window has a short prefix with any other, so it ends a run.
        same = common_prefixes(text, order)[order] >= length
        some = left[order] >= length
        order, same = order[some], same[some]
        heads = np.flatnonzero(~same)
        doc = np.repeat(ids[rows], sizes + 1)[order]
        least = np.minimum.reduceat(doc, heads) if len(order) else doc[:0]
        return where[order], doc, np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order)))), heads, least

    def resolve(units, at, keys, ids, length) -> np.ndarray:
        n, all_hits = np.diff(at), []
        for shards in shards_of(np.lexsort((ids, keys)), keys, n, shard_bytes):
            found = [sorted_windows(units, at, n, ids, length, rows) for rows in shards]
            if len(found) > 1:
                every = np.lib.stride_tricks.sliding_window_view(units, length)
                names = [every[position[heads]].view(f"S{length}").ravel() if len(heads) else np.zeros(0, f"S{length}") for position, _, _, heads, _ in found]
            for i, (position, doc, run, _, least) in enumerate(found):
                lowest = least.copy()
                for j, (*_, other_least) in enumerate(found):
                    if i != j and len(names[j]) and len(names[i]):
                        place = np.minimum(np.searchsorted(names[j], names[i]), len(names[j]) - 1)
                        met = names[j][place] == names[i]
                        lowest[met] = np.minimum(lowest[met], other_least[place[met]])
                all_hits.append(position[lowest[run] < doc] if len(run) else position)
        return np.unique(np.concatenate(all_hits)) if all_hits else np.zeros(0, np.int64)

    return resolve


def suffix_array_dedup(docs: DataFrame, length: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove each byte that a window of `length` bytes covers which also starts in a document with a smaller doc_id.
    Columns and edge cases: see spans.remove_earlier; units are UTF-8 bytes, kept is binary (a cut may fall inside a
    character). Needs columns doc_id and text; others are ignored."""
    return remove_earlier(docs, array_resolver(shard_bytes), "bytes", length, min(ANCHOR_BYTES, length))
