"""Passages that also stand in an earlier document: what substring and suffix-array dedup share.

A window is `length` consecutive units (words or bytes) of one document. To find the windows that also start in a
document with a smaller id, without moving every window:

1. Each window owns an anchor (see kernels.Anchors), so equal windows meet under equal keys. Map tasks send, per
   anchor, 11 bytes: the key and a hash of the span of text that the anchor's windows cover. Equal texts in one
   slice are sent once, so a text with a third of all rows sends no more than one copy per task.
2. A bucket of keys decides: a span that equals one of a smaller document is removed whole; where different spans
   share a key, the span is *open*; others have no partner. Only this verdict travels back.
3. Only open spans travel as text, to shards by key, where a resolver (suffix automaton or suffix array) compares them.
   A key with more than WIDE different spans (a passage in very many different surroundings) would make one shard of
   them all: its windows become keys of their own, told apart by their hashes, and go through step 2 once more.
   Neighbouring windows share a bucket by the units that all of them have, so a document sends fewer, longer rows.
4. Verdicts return to the documents. These, the open spans and the windows are read from one exchange: no filter may
   be one that the optimizer could push below it, as the texts would be shuffled again.

Rows of equal text and different ids: the smallest id is judged, the others are covered wholly by it.
Null texts are empty. Rows with a null id are kept whole and are no reference. Rows that repeat (id and text) give
equal results each. Rows with one id and different texts are no earlier documents for each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.kernels import Anchors, Prefixes, mix, slices, utf8, word_hashes, words
from ebbline.llm.storage import materialize

KEY_BYTES, SPAN_BYTES = 5, 6
FULL, OPEN, SPLIT = 1, 2, 3
#: Different spans of one key that a shard compares; a key with more is split by windows.
WIDE = 4096
#: Windows of an anchor that share a bucket when its key is split.
NEIGHBOURS = 4
#: Bytes of text for each bucket, at most, where the shuffle's partitions are too few.
BUCKET_BYTES = 64 << 20
#: Entries of a bucket that are sorted at a time, about.
DECIDED = 1 << 18


def narrow(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n])


def wide(short: np.ndarray) -> np.ndarray:
    n = short.shape[1]
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :n] = short
    return out.view("<u8").ravel()


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(data)
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("one batch of spans has more than 2 GiB")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


@dataclass
class Entries:
    """What meets by key and is compared by span: document (in its slice), bucket, key, span, and the units that it covers."""

    doc: np.ndarray
    bucket: np.ndarray
    key: np.ndarray
    span: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def verdicts(self, lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """What step 2 says of each entry: a list per document of (bucket, a byte for each entry of that bucket)."""
        out = np.zeros(len(self.bucket), np.uint8)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten()
        if not len(flat):
            return out
        doc, bucket = np.repeat(np.arange(len(sizes)), sizes), np.asarray(flat.field(0))
        data, data_at = utf8(flat.field(1))
        group = self.doc * (1 << 32) + self.bucket
        order = np.argsort(group, kind="stable")
        begin = np.searchsorted(group[order], doc * (1 << 32) + bucket)
        n = np.diff(data_at)
        out[order[np.repeat(begin - data_at[:-1], n) + np.arange(len(data))]] = data
        return out

    def batch(self, h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """All entries by bucket, in as few bytes as possible."""
        order = np.argsort(self.bucket, kind="stable")
        doc, bucket = self.doc[order], self.bucket[order]
        keys, spans = narrow(self.key[order] >> np.uint64(20), KEY_BYTES), narrow(self.span[order], SPAN_BYTES)
        change = np.ones(len(order), bool)
        change[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
        runs = np.flatnonzero(change)
        sizes = np.diff(np.append(runs, len(order))).astype(np.int32)
        have = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        cut, run_cut = np.append(have, len(order)), np.append(np.searchsorted(runs, have), len(runs))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[have]),
                binaries(keys, cut * KEY_BYTES),
                binaries(spans, cut * SPAN_BYTES),
                binaries(h[doc[runs]].view(np.uint8), run_cut * 8),
                binaries(g[doc[runs]].view(np.uint8), run_cut * 8),
                binaries(ids[doc[runs]].view(np.uint8), run_cut * 8),
                binaries(sizes.view(np.uint8), run_cut * 4),
            ],
            ["bucket", "keys", "spans", "h", "g", "ids", "sizes"],
        )


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFF)) % np.uint64(buckets)).astype(np.int32)


class Units:
    """The units of a slice of documents and its anchors."""

    def __init__(self, part, kind: str, length: int, gram: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.flat, self.bytes_at = utf8(part.column("text"))
        self.units, self.at = word_hashes(self.flat, self.bytes_at) if kind == "words" else (self.flat, self.bytes_at)
        a = self.anchors = Anchors(self.units, self.at, length, gram)
        self.entries = Entries(a.doc, bucket_of(a.key, buckets), a.key, a.span, a.flat_start, a.flat_end)

    def windows(self, which: np.ndarray) -> Entries:
        """The single windows of some anchors, in order."""
        a = self.anchors
        n = a.windows[which]
        begin = np.repeat(a.flat_start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        prefixes, near = Prefixes(self.units), min(NEIGHBOURS, self.length)
        key = prefixes.of(begin, begin + self.length)
        # Equal windows own equal grams at equal distances, so they have equal cores.
        gram_at = np.repeat(a.gram_at[which], n)
        core = gram_at - (gram_at - begin) // near * near
        bucket = bucket_of(prefixes.of(core, core + self.length - near + 1), self.buckets)
        return Entries(np.repeat(a.doc[which], n), bucket, key, mix(key ^ np.uint64(0x5851F42D4C957F2D)), begin, begin + self.length)


def anchor_blobs(kind: str, length: int, gram: int, buckets: int) -> Callable:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, g, ids = (np.asarray(part.column(c)) for c in ("h", "g", "doc_id"))
                first = least_of_each(h, g, ids)
                if len(first) < len(h):
                    part = part.take(pa.array(first))
                    h, g, ids = h[first], g[first], ids[first]
                u = Units(part, kind, length, gram, buckets)
                if len(u.entries.bucket):
                    yield u.entries.batch(h, g, ids)

    return run


def window_blobs(kind: str, length: int, gram: int, buckets: int) -> Callable:
    """The windows of keys that are too wide for a shard."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                u = Units(part, kind, length, gram, buckets)
                wide = u.windows(np.flatnonzero(u.entries.verdicts(part.column("marks")) == SPLIT))
                if len(wide.bucket):
                    yield wide.batch(*(np.asarray(part.column(c)) for c in ("h", "g", "doc_id")))

    return run


def least_of_each(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of the rows of each text, one with the least id."""
    order = np.lexsort((ids, g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    return np.sort(order[new])


def verdicts_of(key: np.ndarray, span: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of all entries of some keys."""
    order = np.lexsort((doc, span, key))
    k, s, d = key[order], span[order], doc[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new_span = new_key | np.append(True, s[1:] != s[:-1])
    heads = np.flatnonzero(new_key)
    group = np.cumsum(new_key) - 1
    least = d[np.flatnonzero(new_span)][np.cumsum(new_span) - 1]
    spans = np.add.reduceat(new_span.astype(np.int64), heads)
    several = (spans > 1) & (np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads))
    out = np.zeros(len(key), np.uint8)
    out[order] = np.where(d > least, FULL, np.where(several[group], np.where(spans[group] > WIDE, SPLIT, OPEN), 0))
    return out


def decide(table: pa.Table) -> pa.Table:
    """Step 2 for one bucket, by ranges of keys, so that about DECIDED entries at a time are sorted. Windows that meet by key have one span, so that all of them are settled here."""
    joined = lambda name: np.ascontiguousarray(utf8(table.column(name))[0])
    keys, spans = joined("keys").reshape(-1, KEY_BYTES), joined("spans").reshape(-1, SPAN_BYTES)
    h, g, ids = (joined(c).view(np.int64) for c in ("h", "g", "ids"))
    sizes = joined("sizes").view(np.int32)
    judged = np.zeros(len(h), bool)
    judged[least_of_each(h, g, ids)] = True
    entry = np.repeat(np.arange(len(h), dtype=np.int32), sizes)
    verdict = np.zeros(len(keys), np.uint8)
    parts = min(256, len(keys) // DECIDED + 1)
    part = (keys[:, -1].astype(np.uint16) * parts >> 8).astype(np.uint8)
    for p in range(parts):
        kept = np.flatnonzero((part == p) & judged[entry])
        if len(kept):
            verdict[kept] = verdicts_of(wide(keys[kept]), wide(spans[kept]), ids[entry[kept]])
    ends = np.cumsum(sizes.astype(np.int64))
    some = np.flatnonzero((np.add.reduceat(verdict, ends - sizes, dtype=np.int64) > 0) & judged) if len(sizes) else np.zeros(0, np.int64)
    told = np.zeros(len(h), bool)
    told[some] = True
    return pa.table(
        {
            "h": h[some],
            "g": g[some],
            "bucket": np.full(len(some), table.column("bucket")[0].as_py(), np.int32),
            "verdict": binaries(verdict[told[entry]], np.append(0, np.cumsum(sizes[some].astype(np.int64)))),
            "split": np.maximum.reduceat(verdict, ends - sizes)[some] == SPLIT if len(some) else told[:0],
        }
    )


def open_spans(kind: str, length: int, gram: int, buckets: int) -> Callable:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                u = Units(part, kind, length, gram, buckets)
                which = np.flatnonzero(u.entries.verdicts(part.column("marks")) == OPEN)
                if not len(which):
                    continue
                a, one = u.anchors, u.units.dtype.itemsize
                start, n = a.flat_start[which], a.flat_end[which] - a.flat_start[which]
                at = np.append(0, np.cumsum(n))
                data = u.units[np.repeat(start - at[:-1], n) + np.arange(at[-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(u.entries.bucket[which]),
                        pa.array(a.key[which].view(np.int64)),
                        pa.array(np.asarray(part.column("h"))[a.doc[which]]),
                        pa.array(np.asarray(part.column("g"))[a.doc[which]]),
                        pa.array(np.asarray(part.column("doc_id"))[a.doc[which]]),
                        pa.array(a.first[which]),
                        binaries(data.view(np.uint8), at * one),
                    ],
                    ["bucket", "key", "h", "g", "doc_id", "first", "span"],
                )

    return run


def resolved(resolver: Callable, kind: str, length: int) -> Callable:
    """Step 3 for one shard: resolver(units, offsets, keys, ids) tells for each position whether its window starts in a smaller document too."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data, at = utf8(table.column("span"))
        if kind == "words":
            data, at = np.ascontiguousarray(data).view(np.uint64), at // 8
        hit = resolver(data, at, np.asarray(table.column("key")), np.asarray(table.column("doc_id")), length)
        span = np.searchsorted(at, hit, "right") - 1
        some, n = np.unique(span, return_counts=True)
        offsets = (hit - at[span]).astype(np.int32)
        return pa.table(
            {
                "h": np.asarray(table.column("h"))[some],
                "g": np.asarray(table.column("g"))[some],
                "first": np.asarray(table.column("first"))[some],
                "windows": binaries(offsets.view(np.uint8), np.append(0, np.cumsum(n)) * 4),
            }
        )

    return run


def covered(u: Units, part, length: int) -> np.ndarray:
    """Which units of a slice stand in a window that an earlier document has too."""
    edge = np.zeros(len(u.units) + 1, np.int64)
    verdict = u.entries.verdicts(part.column("marks"))
    wide = u.windows(np.flatnonzero(verdict == SPLIT))
    for entries, full in ((u.entries, verdict == FULL), (wide, wide.verdicts(part.column("wide")) == FULL)):
        np.add.at(edge, entries.start[full], 1)
        np.add.at(edge, entries.end[full], -1)
    lists = part.column("hits")
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    if len(flat):
        data, data_at = utf8(flat.field(1))
        base = u.at[np.repeat(np.arange(len(sizes)), sizes)] + np.asarray(flat.field(0))
        at = np.repeat(base, np.diff(data_at) // 4) + np.ascontiguousarray(data).view(np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
    copy = np.asarray(part.column("copy").fill_null(False).to_numpy(zero_copy_only=False)) & (np.diff(u.at) >= length)
    np.add.at(edge, u.at[:-1][copy], 1)
    np.add.at(edge, u.at[1:][copy], -1)
    return np.cumsum(edge[:-1]) > 0


def kept_bytes(u: Units, gone: np.ndarray, kind: str) -> pa.Array:
    keep = ~gone
    if kind == "bytes":
        return binaries(u.flat[keep], np.append(0, np.cumsum(keep))[u.at])
    start, end, _ = words(u.flat, u.bytes_at)
    n = (end - start + 1)[keep]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(start[keep] - (ends - n), n)
    out = np.append(u.flat, np.uint8(32))[np.minimum(index, len(u.flat))]
    out[ends - 1] = 32
    byte_at = np.append(0, ends)[np.append(0, np.cumsum(keep))[u.at]]
    last = byte_at[1:][np.diff(byte_at) > 0] - 1
    keep_byte = np.ones(total, bool)
    keep_byte[last] = False
    return binaries(out[keep_byte], np.append(0, np.cumsum(keep_byte))[byte_at])


def removals(kind: str, length: int, gram: int, buckets: int) -> Callable:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                u = Units(part, kind, length, gram, buckets)
                gone = covered(u, part, length)
                total = np.append(0, np.cumsum(gone))
                begins, ends = gone.copy(), gone.copy()
                begins[1:] &= ~gone[:-1]
                ends[:-1] &= ~gone[1:]
                inner = u.at[1:-1][(u.at[1:-1] > 0) & (u.at[1:-1] < len(gone))]
                begins[inner], ends[inner - 1] = gone[inner], gone[inner - 1]
                at_begin, at_end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                cut = np.searchsorted(at_begin, u.at)
                base = np.repeat(u.at[:-1], np.diff(cut))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x - base))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(u.at)),
                        pa.array(np.diff(total[u.at])),
                        pa.array(np.diff(cut).astype(np.int64)),
                        lists(at_begin),
                        lists(at_end),
                        kept_bytes(u, gone, kind),
                    ],
                    ["doc_id", "n_units", "n_removed", "n_spans", "span_starts", "span_ends", "kept"],
                )

    return run


#: A text is hot from this share of all rows on, so there are at most 1,000 hot texts, which are broadcast.
HOT_SHARE = 1 / 1000


def remove_earlier(docs: DataFrame, resolver: Callable, kind: str, length: int, gram: int) -> DataFrame:
    """One row per document: doc_id, n_units, n_removed, n_spans, span_starts, span_ends (in units), kept (binary)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})
    known = docs.filter("doc_id is not null")
    firsts = known.groupBy("h", "g").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes"))
    firsts = materialize(firsts, "firsts")
    total, volume = firsts.agg(F.sum("n"), F.sum("bytes")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((volume or 0) / BUCKET_BYTES))
    args = (kind, length, gram, buckets)

    packed, told = "bucket int, keys binary, spans binary, h binary, g binary, ids binary, sizes binary", "h long, g long, bucket int, verdict binary, split boolean"
    listed = lambda verdicts, name: verdicts.groupBy("h", "g").agg(F.collect_list(F.struct("bucket", "verdict")).alias(name), F.max("split").alias("split"))
    verdicts = materialize(known.mapInArrow(anchor_blobs(*args), packed).groupBy("bucket").applyInArrow(decide, told), "verdicts")
    marks = listed(verdicts, "marks")

    hot = firsts.filter(F.col("n") >= max(2.0, (total or 0) * HOT_SHARE)).select("h", "g", F.col("least_id").alias("hot_id"))
    # Copies of a hot text need no verdict, so they go to partitions by id.
    docs = docs.join(F.broadcast(hot), ["h", "g"], "left").withColumn("away", F.coalesce(F.col("doc_id") > F.col("hot_id"), F.lit(False)))
    docs = docs.withColumn("h", F.when(F.col("away"), F.xxhash64("doc_id")).otherwise(F.col("h"))).withColumn("g", F.when(F.col("away"), F.lit(0)).otherwise(F.col("g")))
    judged = docs.join(firsts.select("h", "g", "least_id"), ["h", "g"], "left").join(marks, ["h", "g"], "left")
    least = ~F.col("away") & (F.col("doc_id") == F.col("least_id"))
    judged = judged.select(
        "doc_id", "text", "h", "g",
        (F.col("away") | F.coalesce(F.col("doc_id") > F.col("least_id"), F.lit(False))).alias("copy"),
        F.when(least, F.col("marks")).alias("marks"),
        F.when(least & F.col("split"), F.col("marks")).alias("split"),
    )
    spans = judged.select("doc_id", "h", "g", "text", "marks").filter("marks is not null").mapInArrow(open_spans(*args), "bucket int, key long, h long, g long, doc_id long, first long, span binary")
    hits = spans.groupBy("bucket").applyInArrow(resolved(resolver, kind, length), "h long, g long, first long, windows binary")
    hits = hits.groupBy("h", "g").agg(F.collect_list(F.struct("first", "windows")).alias("hits"))
    found = judged.join(hits, ["h", "g"], "left").withColumn("hits", F.when(F.col("marks").isNotNull(), F.col("hits")))
    if verdicts.filter("split").limit(1).count():
        windows = judged.select("doc_id", "h", "g", "text", F.col("split").alias("marks")).filter("marks is not null").mapInArrow(window_blobs(*args), packed).groupBy("bucket").applyInArrow(decide, told)
        found = found.join(listed(windows, "wide").drop("split"), ["h", "g"], "left").withColumn("wide", F.when(F.col("split").isNotNull(), F.col("wide")))
    else:
        found = found.withColumn("wide", F.lit(None).cast("array<struct<bucket:int,verdict:binary>>"))
    return found.select("doc_id", "text", "copy", "marks", "hits", "wide").mapInArrow(
        removals(*args), "doc_id long, n_units long, n_removed long, n_spans long, span_starts array<long>, span_ends array<long>, kept binary"
    )
