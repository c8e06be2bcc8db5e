"""Substring dedup of words by suffix automata of reference shards.

Shards hold the spans that several documents share (see spans). A generalized suffix automaton is built of a shard's
spans in document order, so that a state knows the first document its strings stand in; every span of the key is then
streamed through it for matching statistics, and a match of `length` words or more whose first document is smaller
marks a window. A key with more text than one shard is cut into several automata and its spans run through each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ebbline.llm.spans import remove_earlier

#: Words in one automaton; it takes about 0.4 kB a word.
SHARD_WORDS = 100_000
#: Words of the hashes that anchors come from.
ANCHOR_WORDS = 8


class SuffixAutomaton:
    """Of several strings; each state keeps the first document that its strings stand in."""

    def __init__(self):
        self.next, self.link, self.len, self.doc = [{}], [-1], [0], [-1]

    def _copy(self, state: int, length: int) -> int:
        self.next.append(self.next[state].copy())
        self.link.append(self.link[state])
        self.len.append(length)
        self.doc.append(self.doc[state])
        return len(self.len) - 1

    def add(self, string: list[int], doc: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for c in string:
            target = nxt[last].get(c)
            if target is not None and length[target] == length[last] + 1:
                last = target
                continue
            if target is None:
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                self.doc.append(doc)
                made = len(length) - 1
                at = last
                while at >= 0 and c not in nxt[at]:
                    nxt[at][c] = made
                    at = link[at]
            else:
                made, at = -1, last
            if at >= 0:
                q = nxt[at][c]
                if length[q] != length[at] + 1:
                    clone = self._copy(q, length[at] + 1)
                    while at >= 0 and nxt[at].get(c) == q:
                        nxt[at][c] = clone
                        at = link[at]
                    link[q] = clone
                    q = clone
                if made >= 0:
                    link[made] = q
                else:
                    made = q
            last = made

    def earlier(self, string: list[int], doc: int, least: int) -> list[int]:
        """Where windows of `least` units start that stand in a document before `doc`."""
        nxt, link, length = self.next, self.link, self.len
        state, run, found = 0, 0, []
        for i, c in enumerate(string):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                run += 1
            if run >= least:
                while length[link[state]] >= least:
                    state = link[state]
                    run = length[state]
                if self.doc[state] < doc:
                    found.append(i - least + 1)
        return found


def automaton_resolver(shard_words: int):
    def resolve(units, at, keys, ids, length) -> np.ndarray:
        units = np.unique(units, return_inverse=True)[1]
        order = np.lexsort((ids, keys))
        found, i = [], 0
        while i < len(order):
            # A shard: whole keys up to shard_words; a larger key alone.
            j, n = i, 0
            while j < len(order):
                k = j
                while k < len(order) and keys[order[k]] == keys[order[j]]:
                    n += at[order[k] + 1] - at[order[k]]
                    k += 1
                if j > i and n > shard_words:
                    break
                j = k
            rows = order[i:j][np.argsort(ids[order[i:j]], kind="stable")]
            strings = [units[at[r] : at[r + 1]].tolist() for r in rows]
            shards, size = [[]], 0
            for x, s in enumerate(strings):
                if size and size + len(s) > shard_words:
                    shards.append([])
                    size = 0
                shards[-1].append(x)
                size += len(s)
            for shard in shards:
                automaton = SuffixAutomaton()
                for x in shard:
                    automaton.add(strings[x], int(ids[rows[x]]))
                for x in range(shard[0], len(rows)):
                    found += [at[rows[x]] + p for p in automaton.earlier(strings[x], int(ids[rows[x]]), length)]
            i = j
        return np.unique(np.array(found, np.int64))

    return resolve


def substring_dedup(docs: DataFrame, length: int = 50, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Remove each white-space separated word that a window of `length` words covers which also starts in a document
    with a smaller doc_id. Columns and edge cases: see spans.remove_earlier; units are words, kept is UTF-8 text of
    the kept words joined by one space. Needs columns doc_id and text; others are ignored."""
    return remove_earlier(docs, automaton_resolver(shard_words), "words", length, min(ANCHOR_WORDS, length))
