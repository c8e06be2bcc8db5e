"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every `window - gram + 1` consecutive gram hashes keep their least one, so documents and benchmark items that share
`window` words share a kept hash (a fingerprint) for certain. Fingerprints are joined, and each hit is extended: the
windows around it are compared, word by word, with the items' windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.storage import broadcast_up_to, materialize
from ebbline.llm.text import NOT_ALNUM, ascii_lower

#: Bytes of a fingerprint or window table of the benchmark that may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 64 << 20


def word_table(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, words, n (their number) and hashes (one for each word); a null text has none."""
    lowered = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = table.select(*keys, F.array_remove(F.split(lowered, NOT_ALNUM), "").alias("words"))
    return out.withColumns({"n": F.size("words"), "hashes": F.transform("words", lambda w: F.xxhash64(w))})


def phrase(at: Column, length: Column | int) -> Column:
    return F.array_join(F.slice("words", at + 1, length), " ")


def fingerprints(table: DataFrame, keys: list[str], window: int, gram: int) -> DataFrame:
    """Keys, n, words, at (of the kept gram) and mark (its hash); and a row with at = -1 for each text."""
    w = window - gram + 1
    # A hash's low six bits give way to its place, so that the least one also tells where it stands.
    gram_at = lambda i: F.xxhash64(F.slice("hashes", i + 1, gram)).bitwiseAND(F.lit(-64)).bitwiseOR(i.bitwiseAND(F.lit(63)).cast("long"))
    marks = F.when(F.col("n") >= window, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - gram, F.lit(0))), gram_at))
    rows = table.select(*keys, "n", "words", marks.alias("marks"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n") - window, F.lit(-1)))).alias("s"))
    least = lambda shift: F.least(*[F.get("marks", F.col("s") + (j + shift)) for j in range(w)])
    rows = rows.select(*keys, "n", "words", "s", least(0).alias("kept"), F.when(F.col("s") > 0, least(-1)).alias("kept_before"))
    rows = rows.filter((F.col("s") < 0) | F.col("kept_before").isNull() | (F.col("kept") != F.col("kept_before")))
    at = F.col("s") + F.pmod(F.col("kept").bitwiseAND(F.lit(63)) - F.col("s"), F.lit(64)).cast("int")
    return rows.select(*keys, "n", "words", F.when(F.col("s") < 0, F.lit(-1)).otherwise(at).alias("at"), F.when(F.col("s") >= 0, F.col("kept").bitwiseAND(F.lit(-64))).alias("mark"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurrence of an item's window), item_ids (sorted
    strings of the items whose windows occur), contaminated (n_hit > 0).

    Words: runs of digits, letters and characters beyond ASCII, A-Z in lower case. A window is `window` consecutive
    words of an item; an item of fewer words is one window; one without words has none, as null texts. Items with a
    null id count as hits but are not listed. Repeated rows give a row each. Needs doc_id, text and item_id, text;
    other columns are ignored.
    """
    items = materialize(word_table(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), ["item_id"]).filter("n > 0"), "items")
    long, short = items.filter(F.col("n") >= window), items.filter(F.col("n") < window)
    phrases = long.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.col("n") - window)).alias("c")).select("item_id", phrase(F.col("c"), window).alias("phrase"))
    phrases = phrases.union(short.select("item_id", phrase(F.lit(0), window).alias("phrase")))
    phrases = materialize(phrases.groupBy("phrase").agg(F.collect_set("item_id").alias("items")), "phrases")
    marks = materialize(fingerprints(long, ["item_id"], window, gram).filter("at >= 0").select("mark").distinct(), "marks")
    written = marks
    marks, known = broadcast_up_to(marks, broadcast_bytes), broadcast_up_to(phrases, broadcast_bytes)
    small = marks is not written

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    texts = word_table(docs, ["doc_id", "h"])
    places = fingerprints(texts, ["doc_id", "h"], window, gram)
    if small:
        found = places.join(marks.withColumn("met", F.lit(True)), "mark", "left").filter("at < 0 or met").select("doc_id", "h", "n", "words", "at")
    else:
        # Only places and marks are shuffled; those that meet are collected per document and go back to its words once.
        met = places.filter("at >= 0").select("doc_id", "h", "at", "mark").join(marks, "mark", "left_semi")
        met = met.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set("at").alias("ats"))
        found = texts.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
        found = found.select("doc_id", "h", "n", "words", F.explode(F.concat(F.array(F.lit(-1)), F.coalesce("ats", F.array().cast("array<int>")))).alias("at"))
    around = F.sequence(F.greatest(F.col("at") - (window - gram), F.lit(0)), F.least("at", F.col("n") - window))
    around = F.when(F.col("at") < 0, F.array(F.lit(-1))).otherwise(around)
    seen = found.select("doc_id", "h", "n", "words", F.explode(around).alias("c"))
    # Each document's own row (c = -1) has a key of its own that no phrase equals, so that they don't meet in one partition.
    own = F.concat(F.lit("\n"), F.hex("h"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    seen = seen.select("doc_id", "h", "n", "c", F.lit(window).alias("length"), F.when(F.col("c") >= 0, phrase(F.col("c"), window)).otherwise(own).alias("phrase"))

    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # fewer than `window` numbers
    if lengths:
        heads = broadcast_up_to(materialize(short.select(F.col("n").alias("length"), F.array_join("words", " ").alias("phrase")).distinct(), "short"), broadcast_bytes)
        places = texts.select("doc_id", "h", "n", "words", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("c"))
        places = places.select("doc_id", "h", "n", "words", "c", F.explode(F.array(*map(F.lit, lengths))).alias("length")).filter("c + length <= n")
        places = places.select("doc_id", "h", "n", "c", "length", phrase(F.col("c"), F.col("length")).alias("phrase"))
        seen = seen.union(places.join(heads, ["length", "phrase"], "left_semi").select(*seen.columns))

    seen = seen.join(known, "phrase", "left").filter("c < 0 or items is not null")
    hit = F.col("c") >= 0
    out = seen.groupBy("doc_id", "h").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count(F.when(~hit, 1)).cast("int").alias("rows"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("c", "length")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda a, x: F.struct(F.greatest(a.end, x.c + x.length).alias("end"), (a.total + F.greatest(x.c + x.length - F.greatest(a.end, x.c), F.lit(0))).alias("total"))
    out = out.withColumn("n_hit", F.aggregate("hits", zero, step, lambda a: a.total))
    return out.select(F.explode(F.array_repeat(F.lit(0), F.col("rows"))), "*").select("doc_id", "n_words", "n_hit", "item_ids", (F.col("n_hit") > 0).alias("contaminated"))
