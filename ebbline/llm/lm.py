"""Language-model scoring by Brown's class-based n-grams.

P(text) is the product over tokens of P(class | class before) * P(word | class). Exchange clustering puts words into
classes: the most frequent ones in rounds over their pair counts, then every other word that occurs LEAST_COUNT times
or more by its contexts among those. Rarer and unseen words are in a class by their length, and so are words that never
stand beside a frequent one. Every document of the training part counts, for words, pairs, contexts and transitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.kernels import ASCII_LOWER, Prefixes, slices, utf8, words
from ebbline.llm.spans import binaries
from ebbline.llm.storage import discard, materialize

#: Words whose pairs are counted and exchanged in rounds: the most frequent ones, at most so many. The others follow them.
CLUSTERED = 8192
#: Words that the tasks get broadcast (18 bytes each): the most frequent ones, at most so many. Others are joined.
COUNTED = 400_000
#: Words that occur less often don't tell their class by their contexts.
LEAST_COUNT = 3
CLASSES = 64
#: Classes of words by length: 1 ... LENGTHS bytes or more.
LENGTHS = 12
ROUNDS = 4
#: Pseudo-count of the class distribution in each transition row.
PRIOR = 20.0
#: The token that ends a text.
END = np.uint64(0x51ED270B35A7C2D1)
#: Partial counts that a task holds before it passes them on.
HELD = 1_000_000
#: Contexts that are weighed against all classes at once (8 bytes for each class, some arrays of them).
WEIGHED = 1 << 15


def tokens(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of each lower-cased word, then one end (length 0), of each text; and where documents begin."""
    flat, at = utf8(part.column("text"))
    start, end, first = words(flat, at)
    hashes = Prefixes(ASCII_LOWER[flat]).of(start, end)
    return np.insert(hashes, first[1:], END), np.insert(end - start, first[1:], 0), first + np.arange(len(first))


def training(batches):
    for batch in batches:
        batch = batch.filter(pa.compute.invert(batch.column("held_out")))
        yield from slices(batch, "text")


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys, their counts summed, and what else stands with a key. Empties the list, so that its arrays can be freed."""
    columns = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
    parts.clear()
    order = np.argsort(columns[0])
    columns = [c[order] for c in columns]
    del order
    keys, counts, *others = columns
    heads = np.flatnonzero(np.append(np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))
    return (keys[heads], np.add.reduceat(counts, heads, dtype=np.int64) if len(heads) else counts.astype(np.int64), *(c[heads] for c in others))


def held(stream):
    """Merges partial counts and yields them when they are many and at the end."""
    parts, size = [], 0
    for x in stream:
        parts.append(x)
        size += len(x[0])
        if size > 2 * HELD:
            parts = [merged(parts)]
            size = len(parts[0][0])
            if size > HELD:
                yield parts[0]
                parts, size = [], 0
    if parts:
        yield merged(parts)


def word_counts(batches):
    def each():
        for part in training(batches):
            h, n, _ = tokens(part)
            names, first, count = np.unique(h, return_index=True, return_counts=True)
            yield names, count, n[first]

    for names, count, n in held(each()):
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(count), pa.array(n)], ["word", "n", "length"])


def looked_up(h: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among the sorted names, and whether it is there."""
    if not len(names):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    place = np.minimum(np.searchsorted(names, h), len(names) - 1)
    return place, names[place] == h


def inner_pairs(at: np.ndarray, n: int) -> np.ndarray:
    """Of the n - 1 pairs of neighbours, which stand in one document."""
    inside = np.ones(max(n - 1, 0), bool)
    inside[at[1:-1] - 1] = False
    return inside


def pair_counts(names):
    """Neighbours of clustered words in the training part: first * size + second, and how often."""

    def run(batches):
        size = np.int64(len(names.value))

        def each():
            for part in training(batches):
                h, _, at = tokens(part)
                place, there = looked_up(h, names.value)
                both = there[1:] & there[:-1] & inner_pairs(at, len(h))
                yield np.unique(place[:-1][both] * size + place[1:][both], return_counts=True)

        for keys, count in held(each()):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count)], ["pair", "n"])

    return run


def class_contexts(size: int, classes):
    """Per word, as first and as second of a pair: how often it stands with each class."""

    def run(batches):
        of = classes.value
        c = int(of.max()) + 1 if len(of) else 1

        def each():
            for batch in batches:
                keys, counts = np.asarray(batch.column("pair")), np.asarray(batch.column("n"))
                first, second = keys // size, keys % size
                cells = np.append(first * c + of[second], (size + second) * c + of[first])
                yield merged([(cells, np.append(counts, counts))])

        for cells, n in held(each()):
            word = cells // c
            yield pa.RecordBatch.from_arrays([pa.array((word // size).astype(np.int32)), pa.array(word % size), pa.array((cells % c).astype(np.int32)), pa.array(n)], ["side", "word", "class", "n"])

    return run


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def better_classes(classes, matrix):
    """For the words of one block: the class that raises the likelihood of class pairs most, and by how much.

    Likelihood: sum over pairs of classes of N log N, less the same of row and column sums. Taking a word out of its
    class and putting it into another changes two rows and two columns; self pairs are left out of the gain.
    """

    def run(table: pa.Table) -> pa.Table:
        of, n = classes.value, matrix.value.astype(float)
        c = len(n)
        word, place = np.unique(np.asarray(table.column("word")), return_inverse=True)
        contexts = np.zeros((2, len(word), c))
        np.add.at(contexts, (np.asarray(table.column("side")), place, np.asarray(table.column("class"))), np.asarray(table.column("n")))
        best, gains = of[word].copy(), np.zeros(len(word))
        for i, w in enumerate(word.tolist()):
            own, after, before = int(of[w]), contexts[0, i], contexts[1, i]
            out = n.copy()
            out[own] -= after
            out[:, own] -= before
            np.maximum(out, 0, out=out)
            rows, cols = out.sum(axis=1), out.sum(axis=0)
            gain = (xlogx(out + after) - xlogx(out)).sum(axis=1) + (xlogx(out + before[:, None]) - xlogx(out)).sum(axis=0)
            gain -= xlogx(rows + after.sum()) - xlogx(rows) + xlogx(cols + before.sum()) - xlogx(cols)
            best[i] = int(np.argmax(gain))
            gains[i] = gain[best[i]] - gain[own]
        return pa.table({"word": word, "class": best.astype(np.int32), "gain": gains})

    return run


def nearest_classes(profiles):
    """For the words of one block: the class whose profile makes the word's contexts most likely. profiles: logs by side, class, context."""

    def run(table: pa.Table) -> pa.Table:
        logs = profiles.value
        word, place = np.unique(np.asarray(table.column("word")), return_inverse=True)
        contexts = np.zeros((2, len(word), logs.shape[2]))
        np.add.at(contexts, (np.asarray(table.column("side")), place, np.asarray(table.column("class"))), np.asarray(table.column("n")))
        return pa.table({"word": word, "class": np.argmax(contexts[0] @ logs[0].T + contexts[1] @ logs[1].T, axis=1).astype(np.int32)})

    return run


def profile_logs(sums: np.ndarray) -> np.ndarray:
    """Smoothed log shares of each class's contexts."""
    overall = sums.sum(axis=1, keepdims=True)
    overall = overall / np.maximum(overall.sum(axis=2, keepdims=True), 1)
    return np.log((sums + PRIOR * overall + 1e-9) / (sums.sum(axis=2, keepdims=True) + PRIOR))


def exchange(spark, pairs: DataFrame, rank: np.ndarray, classes: int, rounds: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the clustered words, and the counts of class pairs; rank: place of each word by frequency. What the
    driver holds is bounded by their number and classes**2.

    Start: each of the most frequent words is a class, the others join the one with the likest neighbours (the most
    frequent words are the contexts), twice again with the classes' own profiles. Then rounds of exchange, in each of
    which half of the words may move. Words move at once, so a round can lower the likelihood: then the half of its
    moves that gained most is tried instead.
    """
    size = len(rank)
    block = (F.col("word") % blocks).cast("int")

    def contexts(labels: np.ndarray, name: str) -> DataFrame:
        cells = pairs.mapInArrow(class_contexts(size, spark.sparkContext.broadcast(labels)), "side int, word long, class int, n long")
        return materialize(cells.groupBy("side", "word", "class").agg(F.sum("n").alias("n")), name)

    def sums(cells: DataFrame, labels: np.ndarray, width: int) -> np.ndarray:
        names = spark.createDataFrame([(w, c) for w, c in enumerate(labels.tolist()) if c >= 0], "word long, own int")
        out = np.zeros((2, classes, width))
        for r in cells.join(F.broadcast(names), "word").groupBy("side", "own", "class").agg(F.sum("n").alias("n")).collect():
            out[r["side"], r["own"], r["class"]] = r["n"]
        return out

    of = rank % classes
    if size > classes:
        cells = contexts(np.minimum(rank, classes - 1), "neighbours")
        labels = np.where(rank < classes, rank, -1)
        for _ in range(3):
            logs = spark.sparkContext.broadcast(profile_logs(sums(cells, labels, classes)))
            near = cells.groupBy(block.alias("block")).applyInArrow(nearest_classes(logs), "word long, class int").toPandas()
            labels = of.copy()
            labels[near["word"].to_numpy(int)] = near["class"].to_numpy(int)
        of = labels
        discard(cells)
    best, kept, moves = -math.inf, (of, np.zeros((classes, classes))), None
    for turn in range(rounds + 1):
        cells = contexts(of, "contexts")
        matrix = sums(cells.filter("side = 0"), of, classes)[0] if size else np.zeros((classes, classes))
        likelihood = float(xlogx(matrix).sum() - xlogx(matrix.sum(axis=0)).sum() - xlogx(matrix.sum(axis=1)).sum())
        if likelihood > best:
            best, kept = likelihood, (of, matrix)
            if turn < rounds and size > classes:
                found = cells.filter(F.col("word") % 2 == turn % 2).groupBy(block.alias("block")).applyInArrow(better_classes(spark.sparkContext.broadcast(of), spark.sparkContext.broadcast(matrix)), "word long, class int, gain double")
                moves = found.filter("gain > 0").toPandas().sort_values(["gain", "word"], ascending=False)
        elif moves is not None:
            moves = moves.head(len(moves) // 2)
        discard(cells)
        if moves is None or not len(moves):
            break
        of = kept[0].copy()
        of[moves["word"].to_numpy(int)] = moves["class"].to_numpy(int)
    return kept


def other_contexts(lexicon, classes: int, least_count: int):
    """Of the words that aren't clustered: how often each stands before (cell = class) and after (cell = classes + class) each class."""

    def run(batches):
        x = lexicon.value

        def known():
            for part in training(batches):
                h, length, at = tokens(part)
                place, there = looked_up(h, x.names)
                of = np.where(there, x.classes[place], -1) if len(x.names) else np.full(len(h), -1)
                free = (of < 0) & (length > 0) & (~there | (x.counts[place] >= least_count) if len(x.names) else True)
                inside = inner_pairs(at, len(h))
                before, after = inside & free[:-1] & (of[1:] >= 0), inside & free[1:] & (of[:-1] >= 0)
                word = np.append(np.flatnonzero(before), np.flatnonzero(after) + 1)
                cell = np.append(of[1:][before], classes + of[:-1][after]).astype(np.int64)
                far = ~there[word]
                if far.any():
                    rows.append((h[word[far]], cell[far]))
                yield np.unique(place[word[~far]] * (2 * classes) + cell[~far], return_counts=True)

        rows: list = []
        for keys, n in held(known()):
            yield pa.RecordBatch.from_arrays([pa.array(x.names[keys // (2 * classes)].view(np.int64)), pa.array((keys % (2 * classes)).astype(np.int32)), pa.array(n)], ["word", "cell", "n"])
            for h, cell in rows:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cell.astype(np.int32)), pa.array(np.ones(len(h), np.int64))], ["word", "cell", "n"])
            rows.clear()

    return run


def joined_classes(matrix):
    """The class that raises the likelihood of class pairs most if a word of the given contexts joins it."""

    def run(batches):
        n = matrix.value.astype(float)
        c = len(n)
        # Column k: the counts that change if a word joins each class and stands before (k < c) or after (k >= c) class k.
        grown = np.concatenate([n, n.T], axis=1)
        rows, cols = n.sum(axis=1), n.sum(axis=0)
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column("contexts").value_lengths()), dtype=np.int64)
            i = 0
            while i < len(ends):
                # Whole words, up to WEIGHED contexts.
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + WEIGHED, "right")))
                part = batch.slice(i, j - i)
                lists = part.column("contexts")
                flat, sizes = lists.flatten(), np.asarray(lists.value_lengths())
                cell, count = np.asarray(flat.field(0)), np.asarray(flat.field(1)).astype(float)
                at = np.append(0, np.cumsum(sizes))[:-1]
                old = grown.T[cell]
                gain = np.add.reduceat(xlogx(old + count[:, None]) - xlogx(old), at)
                for side, sums in ((cell < c, rows), (cell >= c, cols)):
                    added = np.add.reduceat(np.where(side, count, 0.0), at)[:, None]
                    gain -= xlogx(sums + added) - xlogx(sums)
                yield pa.RecordBatch.from_arrays([part.column("word"), pa.array(np.argmax(gain, axis=1).astype(np.int32))], ["word", "class"])
                i = j

    return run


@dataclass
class Lexicon:
    """What tasks know of the most frequent words: sorted hashes, counts, classes (-1: none learned)."""

    names: np.ndarray
    counts: np.ndarray
    classes: np.ndarray


def length_class(length: np.ndarray, classes: int) -> np.ndarray:
    """Class of a word that has no learned one; the end (length 0) has the last."""
    return np.where(length == 0, classes + LENGTHS, classes + np.clip(length, 1, LENGTHS) - 1)


#: Stands for a token that isn't among the broadcast words.
FAR = np.uint16(0xFFFF)


def sequences(lexicon, emission, classes: int):
    """Per text: the class of each token (FAR if it must be looked up), sums over the others, and hash and length of the far ones."""

    def run(batches):
        x, logs = lexicon.value, emission.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                h, length, at = tokens(part)
                place, there = looked_up(h, x.names)
                there |= length == 0
                of = x.classes[place] if len(x.names) else np.full(len(h), -1)
                of = np.where((of >= 0) & (length > 0), of, length_class(length, classes))
                far = np.flatnonzero(~there)
                n = np.where(there, x.counts[place] if len(x.names) else 0, 0)
                total = lambda v: np.add.reduceat(v, at[:-1]) if len(v) else v
                far_at = np.append(0, np.cumsum(~there))[at].astype(np.int32)
                k = len(at) - 1
                ends = np.where(there, of, FAR).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + k)),
                        part.column("doc_id"),
                        part.column("held_out"),
                        binaries(ends.view(np.uint8), at * 2),
                        pa.array(total((n > 0).astype(np.int64))),
                        pa.array(total(np.where(there, np.log10(n + 1.0), 0.0))),
                        pa.array(total(np.where(there, logs.of(of, n), 0.0))),
                        pa.ListArray.from_arrays(pa.array(far_at), pa.StructArray.from_arrays([pa.array(h[far].view(np.int64)), pa.array(length_class(length[far], classes).astype(np.int32))], ["word", "class"])),
                    ],
                    ["row", "doc_id", "held_out", "classes", "known", "base", "emitted", "far"],
                )
                row += k

    return run


@dataclass
class Emission:
    """log10 P(word | class): counts of a class's tokens, distinct words of each class by length (one more is unseen)."""

    totals: np.ndarray
    distinct: np.ndarray
    learned: int

    def of(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        by_length = np.log10(n + 1.0) - np.log10(self.totals[c] + self.distinct[c] + 1)
        learned = np.log10(np.maximum(n, 1)) - np.log10(np.maximum(self.totals[c], 1))
        return np.where(c < self.learned, learned, np.where(c == len(self.totals) - 1, 0.0, by_length))


def completed(emission):
    """Puts the looked-up classes into the sequences, in order, and adds their logs."""

    def run(batches):
        logs = emission.value
        for batch in batches:
            data, at = utf8(batch.column("classes"))
            of = np.ascontiguousarray(data).view("<u2").copy()
            lists = batch.column("found")
            flat = lists.flatten()
            base, emitted, known = (np.asarray(batch.column(c)).copy() for c in ("base", "emitted", "known"))
            if len(flat):
                c, n = np.asarray(flat.field(1)), np.asarray(flat.field(2))
                of[np.flatnonzero(of == FAR)] = c
                row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
                add = lambda v: np.bincount(row, weights=v, minlength=batch.num_rows)  # noqa: B023, E731
                base, emitted, known = base + add(np.log10(n + 1.0)), emitted + add(logs.of(c, n)), known + add(n > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), binaries(of.view(np.uint8), at), pa.array(known), pa.array(base), pa.array(emitted)], ["doc_id", "held_out", "classes", "known", "base", "emitted"])

    return run


def class_pairs(batch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token and of the one before it (the end before the first), and where documents begin."""
    data, at = utf8(batch.column("classes"))
    of, at = np.ascontiguousarray(data).view("<u2").astype(np.int64), at // 2
    before = np.empty_like(of)
    before[1:] = of[:-1]
    before[at[:-1]] = end
    return before, of, at


def transition_counts(total: int):
    def run(batches):
        sums = np.zeros(total * total, np.int64)
        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch.column("held_out")))
            before, of, _ = class_pairs(batch, total - 1)
            sums += np.bincount(before * total + of, minlength=total * total)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[cell])], ["cell", "n"])

    return run


def scores(transition):
    def run(batches):
        logs = transition.value
        for batch in batches:
            before, of, at = class_pairs(batch, len(logs) - 1)
            moved = np.add.reduceat(logs[before, of], at[:-1]) if len(of) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(at)), batch.column("known"), batch.column("base"), pa.array(moved + np.asarray(batch.column("emitted")))],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score"],
            )

    return run


@dataclass
class Model:
    """A trained model: words (word, n, length, class; null: by length), log10 transitions between classes, emissions."""

    words: DataFrame
    classes: int
    transition: np.ndarray
    emission: Emission
    train_tokens: int
    distinct: int


def score_documents(
    docs: DataFrame, held_out: Column, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS, counted: int = COUNTED, least_count: int = LEAST_COUNT
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    held_out: a boolean column; the model learns from all other rows. Tokens: white-space separated words with A-Z in
    lower case, then one end. Base: add-one unigrams, (count + 1) / (train_tokens + distinct + 1). Null texts are
    empty. A null held_out counts as false. Repeated rows count and are scored each. With no training rows both
    scores are those of an empty model. Needs doc_id and text; other columns are ignored.
    """
    return train_and_score(docs, held_out, clustered, classes, rounds, counted, least_count)[1]


def train_and_score(
    docs: DataFrame, held_out: Column, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS, counted: int = COUNTED, least_count: int = LEAST_COUNT
) -> tuple[Model, DataFrame]:
    """The model, and what score_documents returns."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = docs.mapInArrow(word_counts, "word long, n long, length long").groupBy("word").agg(F.sum("n").alias("n"), F.max("length").alias("length"))
    counts = materialize(counts, "words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, n_distinct = total["n"] or 0, total["v"]

    # The least count that leaves at most `counted` words, from a histogram of at most some hundred steps.
    step = F.floor(F.log2("n") * 8)
    cut, so_far = 2**62, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        so_far += r["v"]
        if so_far > counted:
            break
        cut = r["least"]
    frequent = counts.filter(F.col("n") >= cut).toPandas()
    names = frequent["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    names, n, length = names[order], frequent["n"].to_numpy(np.int64)[order], frequent["length"].to_numpy(np.int64)[order]
    del frequent
    ranked = np.lexsort((names, -n))
    ranked = ranked[length[ranked] > 0]
    chosen = np.sort(ranked[:clustered])
    # Clustered words by rank, with their hashes sorted for lookups.
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = docs.mapInArrow(pair_counts(share(names[chosen])), "pair long, n long")
    pairs = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    places = np.empty(len(names), np.int64)
    places[ranked] = np.arange(len(ranked))
    of = np.full(len(names), -1, np.int16)
    of[chosen], matrix = exchange(spark, pairs, places[chosen], classes, rounds, blocks)
    discard(pairs)

    # Every other word joins the class that fits its contexts best.
    found = docs.mapInArrow(other_contexts(share(Lexicon(names, n, of)), classes, least_count), "word long, cell int, n long")
    found = found.repartition("word").groupBy("word", "cell").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("contexts"))
    found = found.join(counts.filter(F.col("n") >= least_count).select("word"), "word", "left_semi")
    joined = materialize(found.mapInArrow(joined_classes(share(matrix)), "word long, class int"), "joined")
    near = joined.join(counts.filter(F.col("n") >= cut).select("word"), "word", "left_semi").toPandas()
    of[np.searchsorted(names, near["word"].to_numpy(np.int64).view(np.uint64))] = near["class"].to_numpy(np.int16)
    del near

    # The clustered words' classes are the driver's; all others are in `joined`.
    core = spark.createDataFrame([(int(w), int(c)) for w, c in zip(names[chosen].view(np.int64), of[chosen], strict=True)], "word long, class int")
    vocabulary = materialize(counts.join(joined.union(core), "word", "left"), "vocabulary")
    discard(joined, counts)
    by_length = F.when(F.col("length") == 0, F.lit(classes + LENGTHS)).otherwise(F.least("length", F.lit(LENGTHS)) + (classes - 1)).cast("int")
    size = classes + LENGTHS + 1
    totals, distinct = np.zeros(size), np.zeros(size)
    for r in vocabulary.groupBy(F.coalesce("class", by_length).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        totals[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    emission = Emission(totals, distinct, classes)

    shared = share(emission)
    rows = docs.mapInArrow(sequences(share(Lexicon(names, n, of)), shared, classes), "row long, doc_id long, held_out boolean, classes binary, known long, base double, emitted double, far array<struct<word:long,class:int>>")
    rows = materialize(rows, "sequences")
    far = rows.select("row", F.posexplode("far").alias("pos", "token")).select("row", "pos", "token.word", F.col("token.class").alias("by_length"))
    far = far.join(vocabulary.filter(F.col("n") < cut).select("word", "n", "class"), "word", "left")
    far = far.select("row", F.struct("pos", F.coalesce("class", "by_length").alias("class"), F.coalesce("n", F.lit(0).cast("long")).alias("n")).alias("token"))
    looked = far.groupBy("row").agg(F.sort_array(F.collect_list("token")).alias("found"))
    whole = rows.filter(F.size("far") > 0).drop("far").join(looked, "row", "left").unionByName(rows.filter(F.size("far") == 0).drop("far").withColumn("found", F.lit(None).cast("array<struct<pos:int,class:int,n:long>>")))
    whole = whole.select("doc_id", "held_out", "classes", "known", "base", "emitted", "found").mapInArrow(completed(shared), "doc_id long, held_out boolean, classes binary, known long, base double, emitted double")
    whole = materialize(whole, "whole")
    discard(rows)

    steps = np.zeros((size, size))
    for r in whole.mapInArrow(transition_counts(size), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        steps[r["cell"] // size, r["cell"] % size] = r["n"]
    by_class = steps.sum(axis=0)
    overall = (by_class + 1) / (by_class.sum() + size)
    transition = np.log10((steps + PRIOR * overall) / (steps.sum(axis=1, keepdims=True) + PRIOR))

    out = whole.mapInArrow(scores(share(transition)), "doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    out = out.select(
        "doc_id", "held_out", "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(n_train + n_distinct + 1)).alias("base_score"),
        "score",
    )
    return Model(vocabulary, classes, transition, emission, n_train, n_distinct), out
