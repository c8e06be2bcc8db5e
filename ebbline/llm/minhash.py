"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.graph import components
from ebbline.llm.kernels import Prefixes, mix, slices, utf8, word_hashes
from ebbline.llm.spans import binaries
from ebbline.llm.storage import broadcast_up_to, discard, materialize

#: Values that a sketch retains.
SKETCH = 64


def shingles(part, n: int) -> tuple[np.ndarray, ...]:
    """Sorted distinct hashes of all n-word shingles of each text (lower case), where each document's begin, hashes of all words, and the words from and up to which each shingle goes."""
    units, at = word_hashes(*utf8(part.column("text")), lower=True)
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - n + 1, np.minimum(sizes, 1)))
    count = np.bincount(doc, minlength=len(sizes))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + at[doc]
    end = np.minimum(start + n, at[doc + 1])
    hashes = Prefixes(units).of(start, end)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(sizes) + 1)), units, start[order][new], end[order][new]


def shingle_sets(part, n: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(part, n)[:2]


def sketch_batches(n: int, k: int):
    """Of each document: size of its shingle set, two sums that identify the set, and its k least hashes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingle_sets(part, n)
                sizes = np.diff(at)
                total = lambda x: np.diff(np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))[at]).view(np.int64)
                low = np.arange(len(values)) - np.repeat(at[:-1], sizes) < k
                kept = np.append(0, np.cumsum(np.minimum(sizes, k)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.array(total(values)), pa.array(total(mix(values))), binaries(values[low].view(np.uint8), kept * 8)],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
                )

    return run


def list_keys(sketch: np.ndarray, at: np.ndarray, sizes: np.ndarray, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the inverted lists that each sketch is in (document, key).

    Sets of more than k hashes: each run of three consecutive retained values. Where 100 * intersection >= percent *
    union, a retained value of the union is in both sets with that chance, so that 64 values without such a run come
    about once in 10**10 links at 80 percent. Sets of at most 100 * k / percent hashes: each pair of values from the
    least n - ceil(percent / 100 * n) + 2, of which two sets so similar share two at least, so no link is lost.
    """
    docs, keys = [], []
    long = np.flatnonzero(sizes > k)
    if len(long):
        base = at[long][:, None] + np.arange(k - 2)
        docs.append(np.repeat(long, k - 2))
        keys.append(mix(sketch[base] ^ mix(sketch[base + 1] ^ mix(sketch[base + 2]))).ravel())
    for size in np.unique(sizes[(sizes >= 2) & (sizes * percent <= 100 * k)]).tolist():
        i, j = np.triu_indices(min(size, size - -(-percent * size // 100) + 2), 1)
        short = np.flatnonzero(sizes == size)
        docs.append(np.repeat(short, len(i)))
        keys.append(mix(sketch[at[short][:, None] + i] ^ mix(sketch[at[short][:, None] + j] + np.uint64(1))).ravel())
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(keys)


def least_estimate(k: int, percent: int) -> float:
    """Six standard deviations below the limit: a pair at the limit falls short about once in 10**9."""
    p = percent / 100
    return p - 6 * math.sqrt(p * (1 - p) / k)


def local_lists(batches, k: int, percent: int):
    """The inverted lists of up to HELD sketches at a time: reps, sizes, met, and of each entry document, key, hub of its list in this task.

    met: how many other entries a document meets over all these lists; the hub of a list meets most. A list with at
    most LONG_LIST entries here goes on as it is: then every entry is its own hub.
    """

    def lists(held):
        sketch = np.concatenate([np.ascontiguousarray(utf8(b.column("sketch"))[0]).view(np.uint64) for b in held])
        sizes, reps = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("n_shingles", "rep"))
        at = np.append(0, np.cumsum(np.minimum(sizes, k)))
        doc, key = list_keys(sketch, at, sizes, k, percent)
        _, place, n = np.unique(key, return_inverse=True, return_counts=True)
        met = np.bincount(doc, weights=n[place] - 1, minlength=len(reps)).astype(np.int64)
        order = np.lexsort((reps[doc], -met[doc], key))
        doc, key, place = doc[order], key[order], place[order]
        first = np.append(0, np.cumsum(n))[:-1]
        hub = np.where(n[place] > LONG_LIST, doc[first[place]], doc)
        return reps, sizes, met, doc, key, hub

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= HELD:
            yield lists(held)
            held, size = [], 0
    if size:
        yield lists(held)


def hub_batches(k: int, percent: int):
    """Rows of lists; of a list that is long in a task only its hub, so that a list with a third of all documents is small before it is shuffled."""

    def run(batches):
        for reps, sizes, met, doc, key, hub in local_lists(batches, k, percent):
            own = hub == doc
            doc, key = doc[own], key[own]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(reps[doc]), pa.array(sizes[doc]), pa.array(met[doc])], ["key", "rep", "size", "met"])

    return run


def star_batches(k: int, percent: int):
    """Pairs of a task's hubs with the other members of their long lists, and how many lists each pair shares so."""

    def run(batches):
        for reps, sizes, _, doc, _, hub in local_lists(batches, k, percent):
            other = hub != doc
            pair, shared = np.unique(hub[other] * len(reps) + doc[other], return_counts=True)
            a, b = pair // len(reps), pair % len(reps)
            differ = reps[a] != reps[b]
            a, b, shared = a[differ], b[differ], shared[differ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (reps[a], sizes[a], reps[b], sizes[b], shared)], ["hub", "hub_size", "rep", "size", "shared"])

    return run


def estimates(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Jaccard similarity of each pair of rows by the bottom k of the union's sketch (exact if the union has no more). Rows are padded with the greatest value."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != np.iinfo(both.dtype).max
    twin = np.zeros(both.shape, bool)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twin, axis=1)
    return (twin & (rank <= k)).sum(axis=1) / np.clip(rank[:, -1], 1, k)


def padded(column, k: int) -> np.ndarray:
    """Sketches of 32-bit values as rows of k."""
    data, at = utf8(column)
    values, n = np.ascontiguousarray(data).view(np.uint32), np.diff(at) // 4
    out = np.full((len(n), k), np.iinfo(np.uint32).max, np.uint32)
    out[np.arange(k) < n[:, None]] = values
    return out


def estimated_pairs(k: int, least: float):
    def run(batches):
        for batch in batches:
            keep = estimates(padded(batch.column("sketch_a"), k), padded(batch.column("sketch_b"), k), k) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def high_halves(batches):
    """Sketches of the upper 32 bits of each value: the order stays, and for an estimate they tell values apart well enough."""
    for batch in batches:
        data, at = utf8(batch.column("sketch"))
        values = (np.ascontiguousarray(data).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([batch.column("rep"), binaries(values.view(np.uint8), at // 2)], ["rep", "sketch"])


def repeated_shingles(n: int):
    """Shingles that several sets of one task have, and how many; also cells of words that several of their shingles begin with (word: true)."""

    def counted(held, word):
        values = np.concatenate(held)
        held.clear()
        values, count = np.unique(values, return_counts=True)
        some = count > 1
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), word)), pa.array(values[some].astype(np.int64)), pa.array(count[some])], ["word", "name", "n"])

    def run(batches):
        held, words, size = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                values, _, units, start, _ = shingles(part, n)
                held.append(values)
                words.append(cells(units)[start])
                size += len(values)
                if size > COUNTED:
                    yield counted(held, False)
                    yield counted(words, True)
                    size = 0
        if held:
            yield counted(held, False)
            yield counted(words, True)

    return run


def cells(units: np.ndarray) -> np.ndarray:
    return (units >> np.uint64(64 - CELL_BITS)).astype(np.uint32)


def rarity(units: np.ndarray, start: np.ndarray, end: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sum of the levels (logarithms of how often) of each shingle's words."""
    sums = np.append(0, np.cumsum(levels[cells(units)], dtype=np.int64))
    return sums[end] - sums[start]


def levels_of(words: DataFrame) -> np.ndarray:
    """The level of each cell, in a byte; a cell without a row is as one with a count of 1."""
    low = F.struct((F.col("name") % 4096).cast("short").alias("low"), F.round(4 * F.log2("n")).cast("short").alias("level"))
    rows = words.groupBy(F.shiftright("name", 12).alias("high")).agg(F.collect_list(low).alias("lows")).toArrow().combine_chunks()
    levels, lists = np.zeros(1 << CELL_BITS, np.uint8), rows.column("lows").combine_chunks()
    flat = lists.flatten()
    levels[np.repeat(np.asarray(rows.column("high")), np.asarray(lists.value_lengths())) * 4096 + np.asarray(flat.field(0))] = np.asarray(flat.field(1))
    return levels


def prefix_batches(n: int, percent: int, names: np.ndarray, counts: np.ndarray, levels: np.ndarray):
    """The first shingles of each set in one order of all shingles (frequent ones last): sets of similarity percent or more share one.

    Any order that is the same for all sets will do. Shingles without a count stand by their words: those of rare words first.

    A set of x shingles shares at least percent % of x with any set that it links with, and 2 p / (1 + p) of its x
    with any that isn't smaller. So of two linked sets the smaller has one of its first x - ceil(2 p x / (1 + p)) + 1
    among the first x - ceil(p x) + 1 of the other.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, at, units, start, end = shingles(part, n)
                place = np.minimum(np.searchsorted(names, values), max(len(names) - 1, 0))
                often = np.where(names[place] == values, counts[place], 0) if len(names) else np.zeros(len(values), np.int64)
                level = rarity(units, start, end, levels)
                sizes = np.diff(at)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((values, level, often, doc))
                pos = np.arange(len(values)) - np.repeat(at[:-1], sizes)
                probed, indexed = (sizes - -(-percent * sizes // 100) + 1)[doc], (sizes - -(-2 * percent * sizes // (100 + percent)) + 1)[doc]
                keep = pos < probed
                doc = doc[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(values[order][keep].view(np.int64)),
                        part.column("rep").take(pa.array(doc)),
                        part.column("component").take(pa.array(doc)),
                        pa.array(sizes[doc]),
                        pa.array(pos[keep]),
                        pa.array((pos < indexed)[keep]),
                    ],
                    ["shingle", "rep", "component", "size", "pos", "indexed"],
                )

    return run


def pairs_of_list(k: int, percent: int, least: float):
    """Pairs of one long list that pass the bounds by size and place (as for short lists) and the estimate."""

    def run(table: pa.Table) -> pa.Table:
        size = np.asarray(table.column("size"))
        order = np.lexsort((np.asarray(table.column("rep")), size))
        table = table.combine_chunks().take(pa.array(order))
        reps, comps, size, pos = (np.asarray(table.column(c)) for c in ("rep", "component", "size", "pos"))
        sketch, rest = padded(table.column("sketch"), k), size - pos
        out, held, n = [np.zeros((2, 0), np.int64)], [], 0

        def tried():
            pairs = np.concatenate(held, axis=1)
            out.append(pairs[:, estimates(sketch[pairs[0]], sketch[pairs[1]], k) >= least])

        # The smaller set (or of equal ones the one with the smaller id) comes first.
        for x in np.flatnonzero(np.asarray(table.column("indexed").to_numpy())).tolist():
            y = np.arange(x + 1, np.searchsorted(size, 100 * size[x] // percent, "right"))
            y = y[(comps[y] != comps[x]) & ((100 + percent) * np.minimum(rest[x], rest[y]) >= percent * (size[x] + size[y]))]
            if len(y):
                held.append(np.stack([np.full(len(y), x), y]))
                n += len(y)
            if n > TRIED:
                tried()
                held, n = [], 0
        if held:
            tried()
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": reps[a], "b": reps[b]})

    return run


def links_of_queries(percent: int):
    """Exact links of a block of queries with a block of members of one group, one for each query and component it meets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        reps, comps, query = np.asarray(table.column("rep")), np.asarray(table.column("component")), np.asarray(table.column("query").to_numpy())
        data, at = utf8(table.column("hashes"))
        names, ids = np.unique(np.ascontiguousarray(data).view(np.uint64), return_inverse=True)
        at = at // 8
        sizes, mark = np.diff(at), np.zeros(len(names), np.int64)
        out_a, out_b = [reps[:0]], [reps[:0]]
        for x in np.flatnonzero(query).tolist():
            own = ids[at[x] : at[x + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids], at[:-1])
            mark[own] = 0
            found = np.flatnonzero(~query & (comps != comps[x]) & (100 * both >= percent * (sizes + len(own) - both)))
            found = found[np.unique(comps[found], return_index=True)[1]]
            out_a.append(np.full(len(found), reps[x]))
            out_b.append(reps[found])
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def set_batches(n: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingle_sets(part, n)
                yield pa.RecordBatch.from_arrays([part.column("rep"), binaries(values.view(np.uint8), at * 8)], ["rep", "hashes"])

    return run


def verified_pairs(percent: int):
    def run(batches):
        for batch in batches:
            (da, ta), (db, tb) = utf8(batch.column("set_a")), utf8(batch.column("set_b"))
            da, db, ta, tb = np.ascontiguousarray(da).view(np.uint64), np.ascontiguousarray(db).view(np.uint64), ta // 8, tb // 8
            keep = []
            for i in range(batch.num_rows):
                x, y = da[ta[i] : ta[i + 1]], db[tb[i] : tb[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Bytes (as JSON) of the ids that are broadcast to fetch their texts.
BROADCAST_IDS = 32 << 20
#: Sketches whose lists a task joins before it passes them on, and entries from which on it passes on a list's hub alone.
HELD = 20_000
LONG_LIST = 64
#: Documents that share a shingle of their prefixes give all their pairs up to so many; more are compared inside tasks, in blocks of so many shingles.
SHORT_LIST = 32
BLOCK = 1 << 19
#: A group's lists give its pairs one by one, if so many times (rows of lists x length) is less than (sets outside the largest
#: component x shingles of the group): else one set in many lists would be moved to very many blocks. Pairs estimated at once.
LIST_COST = 64
TRIED = 8192
#: The order of prefixes is by the number of sets that have a shingle, if more than OFTEN and 1 / FREQUENT of the sets in
#: question: at most FREQUENT * (mean size of a set) shingles are known so. Tasks count up to COUNTED shingles at a time.
#: Other shingles are ordered by the frequency of their words, counted in 2**CELL_BITS cells; a level is a quarter of a power of two.
FREQUENT = 5000
OFTEN = 8
CELL_BITS = 22
COUNTED = 4_000_000


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id).

    Links: 100 * intersection >= percent * union of the sets of lower-cased (A-Z) white-space words' shingles; fewer
    words than a shingle make one shingle, no words make an empty set that links with nothing. percent: 80 or more.
    Null texts are empty. Rows with a null id: component null, kept. Rows of one id and one set are one document; of one
    id and different sets, each row is in the component of its own set. Needs doc_id and text; other columns are ignored.

    1. Sketches; equal sets fall together first, so that groups of copies cost one row each.
    2. Inverted lists of retained values (see list_keys), joined inside each task first. A list gives pairs of its hub,
       the member that meets most others, with the rest; each set is tried with the hub that shares most lists with
       it, then with its others between components. Pairs that pass the union sketch's estimate are verified on whole sets.
    3. Lists that still join different components could hide links between two members that aren't the hub. Their
       sets meet by the prefixes of their shingles in an order of rarity, which loses no link; estimate and
       verification follow as before. Where many sets share the rarest shingles that they have, the sets that such
       shingles join are one group. Edits of one text that are about as far from each other as the limit share many
       lists, so a group's sets outside its largest component are queries against all of it, in blocks inside tasks.
       Where lists only chain sets to a large group, this would grow with its square: there each list gives its pairs
       inside a task, with sketches beside its rows, and pairs that pass the estimate are verified.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    least = least_estimate(k, percent)
    sketched = materialize(docs.mapInArrow(sketch_batches(shingle, k), "doc_id long, n_shingles long, set_a long, set_b long, sketch binary"), "sketches")
    filled = sketched.filter("n_shingles > 0 and doc_id is not null")
    reps = materialize(filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "representatives")
    distinct = filled.join(reps.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["set_a", "set_b", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "sketch", "set_a", "set_b")
    distinct = materialize(distinct.dropDuplicates(["set_a", "set_b"]).drop("set_a", "set_b"), "distinct")

    lists = distinct.mapInArrow(hub_batches(k, percent), "key long, rep long, size long, met long")
    all_of = Window.partitionBy("key")
    lists = lists.withColumn("hub", F.max(F.struct("met", (-F.col("rep")).alias("first"), "rep", "size")).over(all_of)).withColumn("n", F.count("*").over(all_of))
    stars = lists.filter("rep <> hub.rep").select("hub.rep", "hub.size", "rep", "size", "n").toDF("hub", "hub_size", "rep", "size", "n")
    stars = stars.groupBy("hub", "hub_size", "rep", "size").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
    local = distinct.mapInArrow(star_batches(k, percent), "hub long, hub_size long, rep long, size long, shared long").withColumn("n", F.lit(LONG_LIST).cast("long"))
    stars = stars.unionByName(local).groupBy("hub", "hub_size", "rep", "size").agg(F.sum("shared").alias("shared"), F.max("n").alias("n"))
    # In a list of two, the only pair is tried; a longer one can hide others.
    stars = stars.withColumn("hidden", F.col("n") > 2)
    stars = materialize(stars.withColumn("alike", 100 * F.least("hub_size", "size") >= percent * F.greatest("hub_size", "size")), "stars")
    sketches = distinct.select("rep", "sketch").mapInArrow(high_halves, "rep long, sketch binary")

    def estimated(pairs: DataFrame) -> DataFrame:
        pairs = broadcast_up_to(materialize(pairs, "pairs"), BROADCAST_IDS)
        both = sketches.withColumnsRenamed({"rep": "a", "sketch": "sketch_a"}).join(pairs, "a").join(sketches.withColumnsRenamed({"rep": "b", "sketch": "sketch_b"}), "b")
        return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(estimated_pairs(k, least), "a long, b long")

    def texts(ids: DataFrame) -> DataFrame:
        """Texts by rep; ids: a written table. All texts are shuffled only where the ids have more than BROADCAST_IDS bytes."""
        return docs.withColumnRenamed("doc_id", "rep").join(broadcast_up_to(ids, BROADCAST_IDS), "rep")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "estimated")
        named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "named")
        sets = materialize(texts(named).select("rep", "text").mapInArrow(set_batches(shingle), "rep long, hashes binary"), "sets")
        both = sets.withColumnsRenamed({"rep": "a", "hashes": "set_a"}).join(broadcast_up_to(pairs, BROADCAST_IDS), "a").join(sets.withColumnsRenamed({"rep": "b", "hashes": "set_b"}), "b")
        links = materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(verified_pairs(percent), "a long, b long"), "links")
        discard(pairs, named, sets)
        return links

    def labelled(pairs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            pairs = pairs.join(labels.withColumnsRenamed({"node": c, "component": f"{c}_component"}), c, "left").withColumn(f"{c}_component", F.coalesce(f"{c}_component", c))
        return pairs

    best = materialize(stars.filter("alike").groupBy("rep").agg(F.max(F.struct("shared", (-F.col("hub")).alias("first"), "hub")).alias("best")).select(F.col("best.hub").alias("a"), F.col("rep").alias("b")), "best")
    links = verified(estimated(best))
    rest = labelled(stars.filter("alike"), components(links, "a", "b"), "hub", "rep").filter("hub_component <> rep_component").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    links = materialize(links.union(verified(estimated(rest.join(best, ["a", "b"], "left_anti")))), "links")
    labels = components(links, "a", "b")

    # A list is its members' pairs with their task's hubs and those with the list's hub, so all are within three steps of a pair that didn't join.
    open_pairs = materialize(labelled(stars.filter("hidden"), labels, "hub", "rep").select("hub", "rep", (F.col("hub_component") != F.col("rep_component")).alias("apart")), "pairs")
    hard = materialize(open_pairs.filter("apart").select(F.explode(F.array("hub", "rep")).alias("rep")).distinct(), "hard")
    for _ in range(3):
        near = open_pairs.join(hard, "rep", "left_semi").select("hub").union(open_pairs.join(hard.withColumnRenamed("rep", "hub"), "hub", "left_semi").select("rep"))
        hard = materialize(hard.union(near).distinct(), "hard")
    number = hard.count()
    if number:
        with_text = texts(materialize(labelled(hard, labels, "rep").withColumnRenamed("rep_component", "component"), "labelled"))
        repeated = materialize(with_text.select("text").mapInArrow(repeated_shingles(shingle), "word boolean, name long, n long").groupBy("word", "name").agg(F.sum("n").alias("n")), "repeated")
        often = repeated.filter(~F.col("word") & (F.col("n") > max(OFTEN, number / FREQUENT))).toPandas()
        names = often["name"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(names)
        first = with_text.select("rep", "component", "text").mapInArrow(
            prefix_batches(shingle, percent, names[order], often["n"].to_numpy(np.int64)[order], levels_of(repeated.filter("word"))), "shingle long, rep long, component long, size long, pos long, indexed boolean"
        )
        first = materialize(first, "prefixes")
        shared = first.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("indexed").alias("met")).filter("low < high and met")
        mixed = materialize(first.join(shared.select("shingle", "n"), "shingle"), "mixed")
        short = mixed.filter(F.col("n") <= SHORT_LIST).drop("n")
        x, y = short.filter("indexed").drop("indexed").alias("x"), short.drop("indexed").alias("y")
        # x is the smaller set (or of equal ones the one with the smaller id); what follows a shared shingle bounds how many more are shared.
        col = F.col
        smaller = (col("x.size") < col("y.size")) | (col("x.size") == col("y.size")) & (col("x.rep") < col("y.rep"))
        bound = F.least(col("x.size") - col("x.pos"), col("y.size") - col("y.pos"))
        enough = (100 + percent) * bound >= percent * (col("x.size") + col("y.size"))
        met = x.join(y, (col("x.shingle") == col("y.shingle")) & smaller & enough & (col("x.component") != col("y.component")))
        links = links.union(verified(estimated(met.select(col("x.rep").alias("a"), col("y.rep").alias("b")).distinct())))

        # Sets that share such a shingle, also through others, are one group.
        long = mixed.filter(F.col("n") > SHORT_LIST)
        joined = long.select("rep", "component", "size", "n", F.min("rep").over(Window.partitionBy("shingle")).alias("least"))
        joined = materialize(joined.groupBy("rep", "component", "size", "least").agg(F.sum("n").alias("n")), "long")
        groups = components(joined.select("least", "rep"), "least", "rep").select(F.col("node").alias("rep"), F.col("component").alias("hub"))
        heavy = materialize(joined.groupBy("rep", "component", "size").agg(F.sum("n").alias("n")).join(groups, "rep"), "heavy")
        groups = heavy
        largest = groups.groupBy("hub", "component").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("components")).filter("components > 1")
        groups = groups.join(largest.select("hub", F.col("most.component").alias("largest")), "hub").withColumn("outside", F.col("component") != F.col("largest"))
        blocks = groups.groupBy("hub").agg(
            F.ceil(F.sum("size") / BLOCK).cast("int").alias("members"),
            F.ceil(F.sum(F.when(F.col("outside"), F.col("size"))) / BLOCK).cast("int").alias("queries"),
            (LIST_COST * F.sum("n") < F.count_if("outside") * F.sum("size")).alias("by_list"),
        )
        groups = materialize(groups.drop("n").join(blocks, "hub"), "groups")

        # Pairs inside the lists: what is moved grows with the lists' rows, not with pairs.
        listed = broadcast_up_to(materialize(groups.filter("by_list").select("rep"), "listed"), BROADCAST_IDS)
        rows = long.drop("n").join(sketches.join(listed, "rep"), "rep")
        by_list = rows.groupBy("shingle").applyInArrow(pairs_of_list(k, percent, least), "a long, b long").distinct()
        links = links.union(verified(by_list))

        # All of a group in blocks.
        groups = groups.filter("not by_list").withColumns({"i": F.pmod(F.xxhash64("rep"), F.col("queries")).cast("int"), "j": F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("members")).cast("int")})
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = groups.filter("outside").withColumn("j", every("members")).withColumn("query", F.lit(True)).union(groups.withColumn("i", every("queries")).withColumn("query", F.lit(False)))
        sets = materialize(texts(materialize(groups.select("rep"), "grouped")).select("rep", "text").mapInArrow(set_batches(shingle), "rep long, hashes binary"), "sets")
        found = dealt.select("hub", "i", "j", "rep", "component", "query").join(sets, "rep").groupBy("hub", "i", "j").applyInArrow(links_of_queries(percent), "a long, b long")
        links = materialize(links.union(found.distinct()), "links")
        discard(first, repeated, mixed, joined, heavy, sets)
        labels = components(links, "a", "b")
    discard(best, open_pairs, hard)

    named = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    named = materialize(named, "named")
    discard(stars, distinct, reps)
    out = sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
