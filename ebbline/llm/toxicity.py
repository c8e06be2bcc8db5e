"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Lexicons are learned from the labels: words, and stems of longer words, that stand in toxic documents far more often than in
others. A text's features are lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates; no
word count of the text enters by itself but its logarithm. Rows that a model is fitted on are cross-fitted: their features come
from lexicons that were learned without their own fold. The trees are fitted on all folds but one, the calibration on that one.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.storage import broadcast_up_to, materialize

#: Labelled rows that are fitted on at most (about: they are drawn by hash), and lexicon entries of each kind.
FIT_ROWS, LEXICON_WORDS = 20_000, 10_000
#: Folds of the labelled rows, the last of which calibrates; least z of an entry's log-odds; letters of a stem.
FOLDS, LEAST_Z, STEM = 4, 3.0, 5
TREES, DEPTH, STEP, SEED = 30, 3, 0.2, 7
#: Share of the raw probability in a score, which orders texts within a step of the calibration.
TIE_BREAK = 0.001
NEAR = 5
#: Common insults and second-person pronouns of four languages.
INSULTS = frozenset("""idiot idiots moron morons stupid dumb loser losers trash garbage scum clown clowns pathetic worthless disgusting fool fools jerk imbecile
ugly filthy vermin coward dummkopf blödmann trottel abschaum arschloch dreckskerl widerlich erbärmlich connard imbécile crétin abruti ordure salaud minable
estúpido imbécil basura escoria cabrón asqueroso inútil payaso""".split())  # fmt: skip
SECOND_PERSON = frozenset("""you your yours yourself yourselves u ur thou thee du dich dir dein deine deinen deiner euch euer tu te toi ton ta tes vous votre vos
tú ti tuyo usted ustedes vosotros vuestro""".split())  # fmt: skip
LEET = str.maketrans("01345789@$!|€", "oieastbgasiie")
NAMES = (
    "log_words word_density word_most word_hits word_distinct stem_density stem_most stem_hits insult_density insult_hits second_person hits_near_you nearest_you "
    "capitals shouted exclamations questions doubled punctuation obfuscated hidden_hits stretched"
).split()


def tokens(text: str) -> list[str]:
    """Runs of anything but white space."""
    return text.split()


EDGES, MASKED, SPELLED = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"[^\W\d_][\d@$!*#|€]+[^\W\d_]"), re.compile(r"(\w[.\-_*]){3,}\w?\W*")
NO_LETTERS, TWICE, THRICE, THREE = re.compile(r"[\W\d_]+"), re.compile(r"(.)\1+"), re.compile(r"(.)\1{2,}"), re.compile(r"([^\W\d_])\1\1")
#: Characters up to LATIN: which are letters, which are capitals.
LATIN = 0x250
IS_LETTER, IS_UPPER = (np.array([f(chr(c)) for c in range(LATIN)]) for f in (str.isalpha, str.isupper))


def plain(token: str) -> str:
    """Lower-cased, without what isn't a letter or digit at either end."""
    core = token.strip(string.punctuation)
    return core.lower() if core.isalpha() else EDGES.sub("", token.lower())


def stem(word: str) -> str | None:
    return word[:STEM] if len(word) > STEM else None


def unmasked(word: str) -> list[str]:
    """What a word with digits or signs inside, or with stretched letters, may stand for."""
    letters = NO_LETTERS.sub("", word.translate(LEET))
    return [x for x in dict.fromkeys((letters, THRICE.sub(r"\1\1", letters), TWICE.sub(r"\1", letters))) if x != word and len(x) > 2]


def character_counts(text: str) -> tuple[np.ndarray, int, int]:
    """How often each character below LATIN stands in a text, its letters and its capitals."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = codes < LATIN
    counts = np.bincount(codes[near], minlength=LATIN)
    far = Counter(codes[~near].tolist())
    letters = int(counts[IS_LETTER].sum()) + sum(n for c, n in far.items() if chr(c).isalpha())
    return counts, letters, int(counts[IS_UPPER].sum()) + sum(n for c, n in far.items() if chr(c).isupper())


class Featurizer:
    """Features of a text by the lexicons of one fold."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems
        self.facts = lru_cache(1 << 18)(self._facts)

    def _facts(self, token: str) -> tuple[float, float, bool, bool, bool, bool, bool, bool]:
        """Weights as a word and a stem, insult, second person, obfuscated, hidden entry, stretched, all capitals."""
        word = plain(token)
        obfuscated = not word.isalpha() and (bool(MASKED.search(token)) or bool(SPELLED.fullmatch(token)))
        stretched = bool(THREE.search(word))
        weight, insult, hidden = self.words.get(word, 0.0), word in INSULTS, False
        if (obfuscated or stretched) and not weight and not insult:
            for other in unmasked(word):
                if found := max(self.words.get(other, 0.0), 1.0 * (other in INSULTS)):
                    weight, insult, hidden = found, other in INSULTS, True
                    break
        return weight, self.stems.get(stem(word), 0.0), insult, word in SECOND_PERSON, obfuscated, hidden, stretched, len(token) > 1 and token.isupper()

    def features(self, text: str) -> list[float]:
        seq = tokens(text)
        n = max(len(seq), 1)
        total = [0.0] * 13
        bad, you = set(), set()
        for token, k in Counter(seq).items():
            weight, by_stem, insult, second, obfuscated, hidden, stretched, shouted = self.facts(token)
            if weight:
                total[0] += k * weight
                total[1] = max(total[1], weight)
                total[2] += k
                total[3] += 1
            if by_stem:
                total[4] += k * by_stem
                total[5] = max(total[5], by_stem)
                total[6] += k
            if weight or insult:
                bad.add(token)
            if second:
                you.add(token)
                total[8] += k
            total[7] += k * insult
            total[9] += k * obfuscated
            total[10] += k * hidden
            total[11] += k * stretched
            total[12] += k * shouted
        close, nearest = 0, 0.0
        if bad and you:
            at_bad = np.array([i for i, t in enumerate(seq) if t in bad])
            at_you = np.array([i for i, t in enumerate(seq) if t in you])
            after = np.searchsorted(at_you, at_bad)
            gap = np.minimum(np.abs(at_you[np.minimum(after, len(at_you) - 1)] - at_bad), np.abs(at_you[np.maximum(after - 1, 0)] - at_bad))
            close, nearest = int((gap <= NEAR).sum()), 1.0 / (1 + int(gap.min()))
        counts, letters, upper = character_counts(text)
        of = lambda signs: int(counts[[ord(c) for c in signs]].sum())
        marks = [of("!"), of("?"), text.count("!!") + text.count("??"), of(".,;:-*#%&$")]
        return [
            math.log1p(len(seq)), total[0] / n, total[1], math.log1p(total[2]), total[3], total[4] / n, total[5], math.log1p(total[6]), total[7] / n, math.log1p(total[7]),
            total[8] / n, close / n, nearest, upper / max(letters, 1), total[12] / n, *[m / n for m in marks], total[9] / n, total[10] / n, total[11] / n,
        ]


def word_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (text, toxic, fold): the distinct words and stems of each text."""
    for batch in batches:
        texts, toxic, fold = (batch.column(k).to_pylist() for k in range(3))
        kinds, entries, rows = [], [], []
        for i, text in enumerate(texts):
            words = {w for t in set(tokens(text)) if (w := plain(t))}
            stems = {s for w in words if (s := stem(w))}
            for kind, found in (("word", words), ("stem", stems)):
                kinds += [kind] * len(found)
                entries += found
                rows += [i] * len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(entries, pa.string()), pa.array([toxic[i] for i in rows], pa.int32()), pa.array([fold[i] for i in rows], pa.int32())],
            names=["kind", "entry", "toxic", "fold"],
        )


def learned_lexicons(fitted: DataFrame) -> list[tuple[dict[str, float], dict[str, float]]]:
    """(words, stems) with log-odds, learned without fold 0, 1, ..., and last with all; fitted: text, toxic, fold. The driver gets LEXICON_WORDS of each kind."""
    sizes = {(r.toxic, r.fold): r.n for r in fitted.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    used = [*range(FOLDS), -1]
    rows = lambda toxic, left_out: sum(n for (t, f), n in sizes.items() if t == toxic and f != left_out)
    pieces = fitted.select("text", F.col("toxic").cast("int").alias("toxic"), "fold").mapInArrow(word_pieces, "kind string, entry string, toxic int, fold int")
    each = [F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), 1).otherwise(0)).alias(f"n{t}_{f}") for t in (0, 1) for f in range(FOLDS)]
    counts = pieces.groupBy("kind", "entry").agg(*each)

    def weighed(left_out: int) -> tuple[Column, Column]:
        toxic, clean = (sum((F.col(f"n{t}_{f}") for f in range(FOLDS) if f != left_out), F.lit(0)) + 0.5 for t in (1, 0))
        odds = F.log(toxic / (rows(1, left_out) + 1.0)) - F.log(clean / (rows(0, left_out) + 1.0))
        return odds, odds / F.sqrt(1 / toxic + 1 / clean)

    columns = [F.when(weighed(f)[1] >= LEAST_Z, weighed(f)[0]).otherwise(0.0).alias(f"w{k}") for k, f in enumerate(used)]
    out = []
    found = materialize(counts.select("kind", "entry", weighed(-1)[1].alias("z"), *columns).filter(f"z >= {LEAST_Z}"), "lexicon")
    kept = {kind: found.filter(F.col("kind") == kind).orderBy(F.desc("z"), "entry").limit(LEXICON_WORDS).collect() for kind in ("word", "stem")}
    for k in range(len(used)):
        out.append(tuple({r.entry: r[f"w{k}"] for r in kept[kind] if r[f"w{k}"] > 0} for kind in ("word", "stem")))
    return out


def featurized(df: DataFrame, lexicons: list, schema: str) -> DataFrame:
    """The columns of df but text and fold (the lexicons to use, -1 for all), which come last, and their features."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [Featurizer(*x) for x in lexicons]
        for batch in batches:
            texts, folds = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            values = [makers[f].features(t or "") for t, f in zip(texts, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(values, pa.list_(pa.float64()))], names=[*batch.schema.names[:-2], "features"])

    return df.mapInArrow(task, schema + ", features array<double>").withColumn("features", array_to_vector("features"))


def drawn_rows(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """text, toxic, fold of about FIT_ROWS labelled documents that aren't held out, one row per doc_id, drawn by hash of doc_id."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(~held_out).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id"))
    total = known.count()
    share = min(1.0, FIT_ROWS / max(total, 1))
    drawn = known.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    drawn = materialize(drawn.select(F.col("doc_id").alias("known_id"), "toxic", F.pmod(F.shiftright("h", 24), F.lit(FOLDS)).cast("int").alias("fold")), "drawn")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.join(broadcast_up_to(drawn, 16 << 20), F.col("doc_id") == F.col("known_id"))
    return materialize(met.groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text")).select("text", "toxic", "fold"), "fitted")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5).

    labels: doc_id, toxic (0 or 1; of several the greatest, nulls count as none); held_out is a condition on doc_id, of whose rows no label
    is used. Null and empty texts are texts without words; rows without a doc_id and repeated rows are scored each; other columns are
    ignored; an empty table gives no rows. Where the rows to fit on don't have both labels in the fitted folds and the one that
    calibrates, all scores are the smoothed share of toxic ones.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = texts.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text", F.lit(-1).alias("fold"))
    fitted = drawn_rows(docs, labels.select("doc_id", "toxic"), F.coalesce(held_out, F.lit(False)))
    seen = {(r.toxic, r.last): r.n for r in fitted.groupBy("toxic", (F.col("fold") == FOLDS - 1).alias("last")).agg(F.count("*").alias("n")).collect()}
    if len(seen) < 4:
        share = (sum(n for (t, _), n in seen.items() if t) + 0.5) / (sum(seen.values()) + 1)
        return scored.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    lexicons = learned_lexicons(fitted)
    rows = materialize(featurized(fitted.select(F.col("toxic").cast("double").alias("label"), F.col("fold").alias("part"), "text", "fold"), lexicons, "label double, part int"), "features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, minInstancesPerNode=3).fit(rows.filter(F.col("part") < FOLDS - 1))
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="step").fit(raw(rows.filter(F.col("part") == FOLDS - 1)).select("raw", "label"))
    out = raw(featurized(scored, lexicons, "doc_id long, held_out boolean"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - TIE_BREAK) * F.col("step") + TIE_BREAK * F.col("raw")))
    return steps.transform(out.select("doc_id", "held_out", "raw")).select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
