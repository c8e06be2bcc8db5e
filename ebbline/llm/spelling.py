"""Spelling variants: words one edit apart, found by probing generated edits against broadcast Bloom filters.

The vocabulary is dealt into shards by word length. A shard's filter has blocks of 256 bits; a word sets eight bits of one
block. Filters of some shards at a time are broadcast, never more than FILTER_BYTES together, so that a larger vocabulary
takes more rounds and not more memory; a shard above that is cut into slices by hash. Each word's edits are generated in
numpy, with their hashes computed from the word's own prefix and suffix hashes: deletions (which also find insertions, from the longer
word) and replacements by a greater letter (which also find those by a smaller one, from the other word). Only edits that
a filter lets pass are shuffled to a join with the vocabulary, which removes the false ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.storage import discard, materialize
from ebbline.llm.text import LOWER, ascii_lower

#: Bytes of all filters that are broadcast at once; bits for each word; longer words share one shard.
FILTER_BYTES, BITS_PER_WORD, LONGEST = 32 << 20, 16, 64
#: Edits that a task holds at once; words of a task.
EDITS, TASK_WORDS = 1 << 20, 50_000
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK_SHAPE = "shard int, slice int, block long, w0 long, w1 long, w2 long, w3 long"


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads a polynomial hash over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]))


def hashes(codes: np.ndarray) -> np.ndarray:
    """A polynomial hash of each row of code points: sum of code * BASE ** (places behind it)."""
    return (codes.astype(np.uint64) * powers(codes.shape[1] - 1)[::-1]).sum(1, dtype=np.uint64)


def shard_of(length: int) -> int:
    return min(length, LONGEST)


def place(h: np.ndarray, slices: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, block and eight bit numbers (two of each of four longs) of mixed hashes."""
    low = h & np.uint64(0xFFFFFFFF)
    index = (low * np.uint64(slices * blocks)) >> np.uint64(32)
    bits = (h[:, None] * np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)) >> np.uint64(58)
    return (index // np.uint64(blocks)).astype(np.int64), (index % np.uint64(blocks)).astype(np.int64), bits


def masks(bits: np.ndarray) -> np.ndarray:
    one = np.uint64(1) << bits
    return np.stack([one[:, 2 * k] | one[:, 2 * k + 1] for k in range(4)], 1)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and a matrix of code points for the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        step = max(1, EDITS // int(n))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            codes = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32)
            yield part, codes.reshape(len(part), n)


def filter_blocks(sizes: dict[int, tuple[int, int]]):
    """Over batches of words: the block and the bits that each word sets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in by_length(batch.column(0).to_pylist()):
                shard = shard_of(codes.shape[1])
                slices, blocks = sizes[shard]
                piece, block, bits = place(mixed(hashes(codes)), slices, blocks)
                words = masks(bits).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), shard, np.int32)), pa.array(piece.astype(np.int32)), pa.array(block), *[pa.array(words[:, k].copy()) for k in range(4)]],
                    names=["shard", "slice", "block", "w0", "w1", "w2", "w3"],
                )

    return task


def probed(h: np.ndarray, shard: int, sizes: dict[int, tuple[int, int]], filters: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Which hashes a filter of this round lets pass."""
    found = np.zeros(len(h), bool)
    if shard not in sizes or not any(s == shard for s, _ in filters):
        return found
    slices, blocks = sizes[shard]
    h = mixed(h)
    index = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(slices * blocks)) >> np.uint64(32)
    piece = index // np.uint64(blocks)
    for (s, k), words in filters.items():
        if s == shard:
            here = np.flatnonzero(piece == k) if slices > 1 else np.arange(len(h))
            for a in range(0, len(here), 1 << 16):
                some = here[a : a + (1 << 16)]
                _, block, bits = place(h[some], slices, blocks)
                # The first pair of bits rules out most edits; the others are looked up for what is left.
                for j in range(4):
                    word = words[block, j]
                    ok = ((word >> bits[:, 2 * j]) & (word >> bits[:, 2 * j + 1]) & np.uint64(1)).astype(bool)
                    some, block, bits = some[ok], block[ok], bits[ok]
                found[some] = True
    return found


def edits_of(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length of the edits, word, place, letter or 0 for a deletion, hash) in pieces of about EDITS; letters only replace smaller ones."""
    n, length = codes.shape
    wide, power = codes.astype(np.uint64), powers(length)
    terms = wide * power[:length][::-1]
    whole = terms.sum(1, dtype=np.uint64)
    if length > 1:
        # Of a deletion at i: what stands before i moves one place down, what stands behind it stays.
        behind = whole[:, None] - np.cumsum(terms, 1, dtype=np.uint64)
        before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(wide[:, :-1] * power[: length - 1][::-1], 1, dtype=np.uint64)], 1)
        # Of equal neighbours the deletions are equal; one is enough.
        first = np.concatenate([np.ones((n, 1), bool), codes[:, 1:] != codes[:, :-1]], 1)
        word, at = np.nonzero(first)
        yield length - 1, word, at, np.zeros(len(word), np.uint32), before[word, at] + behind[word, at]
    step = max(1, EDITS // max(1, n * len(letters)))
    for a in range(0, length, step):
        part = codes[:, a : a + step]
        word, at, letter = np.nonzero(letters[None, None, :] > part[:, :, None])
        to = letters[letter]
        change = to.astype(np.uint64) - wide[word, a + at]
        yield length, word, a + at, to, whole[word] + change * power[length - 1 - (a + at)]


def candidates(sizes: dict[int, tuple[int, int]], filters, letters: np.ndarray):
    """Over batches of (word, n): with each edit that a filter of this round lets pass."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filters.value
        tables = {k: np.frombuffer(v, np.uint64).reshape(-1, 4) for k, v in held.items()}
        wanted = {s for s, _ in tables}
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for part, codes in by_length(words):
                length = codes.shape[1]
                if not wanted & {shard_of(length), shard_of(length - 1)}:
                    continue
                step = max(1, EDITS // (length * len(letters) + 1))
                for a in range(0, len(part), step):
                    out_at, out_edit = [], []
                    for n, word, at, to, h in edits_of(codes[a : a + step], letters):
                        ok = np.flatnonzero(probed(h, shard_of(n), sizes, tables))
                        for w, i, c in zip(word[ok].tolist(), at[ok].tolist(), to[ok].tolist(), strict=True):
                            text = words[part[a + w]]
                            out_at.append(part[a + w])
                            out_edit.append(text[:i] + (chr(c) if c else "") + text[i + 1 :])
                    if out_at:
                        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in out_at]), pa.array(counts[out_at]), pa.array(out_edit)], names=["word", "n", "edit"])

    return task


def rounds(sizes: dict[int, tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """(shard, slice) of each round: as many filters as fit into FILTER_BYTES."""
    out, free = [], 0
    for shard, (slices, blocks) in sorted(sizes.items()):
        for k in range(slices):
            if blocks * 32 > free:
                out.append([])
                free = FILTER_BYTES
            out[-1].append((shard, k))
            free -= blocks * 32
    return out


def sized(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Slices and blocks a slice by shard; a slice has FILTER_BYTES at most."""
    out = {}
    for shard, n in counts.items():
        blocks = max(1, -(-n * BITS_PER_WORD // 256))
        slices = -(-blocks * 32 // FILTER_BYTES)
        out[shard] = (slices, -(-blocks // slices))
    return out


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of all words exactly one inserted, deleted or replaced code point apart, each pair once; vocabulary: word (distinct), n, written already."""
    spark = vocabulary.sparkSession
    shard = F.least(F.char_length("word"), F.lit(LONGEST))
    counts = {r.shard: r.n for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    sizes = sized(counts)
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()
    letters = np.array(sorted(ord(r.c) for r in letters), np.uint32)
    found = None
    words = vocabulary.select("word")
    tasks = -(-sum(counts.values()) // TASK_WORDS) or 1
    if sizes:
        blocks = words.mapInArrow(filter_blocks(sizes), BLOCK_SHAPE).groupBy("shard", "slice", "block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])
        blocks = materialize(blocks, "filters")
    for at_once in rounds(sizes):
        filters = {k: np.zeros((sizes[k[0]][1], 4), np.uint64) for k in at_once}
        chosen = blocks.filter(F.concat_ws(":", "shard", "slice").isin([f"{s}:{k}" for s, k in at_once]))
        for key, part in chosen.toArrow().to_pandas().groupby(["shard", "slice"]):
            filters[tuple(int(x) for x in key)][part["block"].to_numpy()] = part[["w0", "w1", "w2", "w3"]].to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast({k: v.tobytes() for k, v in filters.items()})
        passed = materialize(vocabulary.select("word", "n").repartition(tasks).mapInArrow(candidates(sizes, sent, letters), "word string, n long, edit string"), "edits")
        sent.destroy()
        found = passed if found is None else found.unionByName(passed)
    if found is None:
        found = spark.createDataFrame([], "word string, n long, edit string")
    exact = found.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "edit").join(vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("n_b")), "edit")
    return exact.select("a", F.col("edit").alias("b"), "n_a", "n_b")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: from word along (word, form) to the last. Each step multiplies n by RATIO, so a chain is short; each round doubles the steps."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.filter("moved").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, moved = now, now.drop("moved").join(further, "root", "left")
        now = materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(before)
    return now.drop("moved")


def damaged_run(run: Column, doc_id: Column) -> Column:
    """The run less the code point at h % length, if 31 divides h, the crc32 of `<doc_id>:<run>`; a null doc_id is empty there."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary_of(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the runs of letters of all texts, after damage; of at least so many code points and occurrences.

    A run shorter than min_length can't give a word, so the pattern finds only longer ones (a run is maximal: greedy, and what
    stands before it is no letter)."""
    runs = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(rf"[{LOWER[0]}-{LOWER[-1]}À-ÿ]{{{min_length},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select(damaged_run(F.col("run"), F.col("doc_id")).alias("word"))
    return words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def spelling_variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (doc_id, text).

    A form is the near word of largest n (ties: least in code-point order) with n at least ratio times the word's; else null.
    Null and empty texts have no words, rows without a doc_id are damaged as by an empty one, repeated rows count each, other
    columns are ignored; no words give no rows. Words of any length are kept; a task holds one batch of words and EDITS edits.
    """
    vocabulary = materialize(vocabulary_of(docs), "vocabulary")
    pairs = near_pairs(vocabulary)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), "n_a", F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n_a"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"), F.first("n_a").alias("n"))
    form = F.col("best.k") <= -ratio * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.k")).alias("form_n")), "near")
    roots = last_forms(best.filter("form is not null"))
    out = vocabulary.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
