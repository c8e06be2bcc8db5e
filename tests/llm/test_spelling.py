import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import spelling

SHAPE = "doc_id long, text string"


def apart(a, b):
    """Whether exactly one insertion, deletion or replacement leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, ratio=10):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= ratio * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def texts(rng, n):
    base = ["".join(rng.choice("abcdeéÀß") for _ in range(rng.randint(6, 12))) for _ in range(25)]
    words = list(base)
    for _ in range(200):
        w = rng.choice(words)
        i, c = rng.randrange(len(w)), rng.choice("abcxÿ×")
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    weights = [rng.choice([1, 1, 3, 30, 400]) for _ in words]
    rows = []
    for d in range(n):
        chosen = [w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randint(0, 300))]
        rows.append((d, rng.choice([" ", "-", "\n", "0"]).join(chosen)))
    rows.append((n + 2, " ".join(["chainabc"] * 2 + ["chainabd"] * 30 + ["chainaed"] * 400 + ["chaaned"] * 9000)))
    long = "ab" * 3000
    return rows + [(None, long + " " + long), (n, long[:-1] + " " + long[:-1]), (None, None), (n + 1, ""), rows[3], rows[3]]


@pytest.mark.parametrize("size", [32 << 20, 64])
def test_equals_all_pairs(spark, monkeypatch, size):
    """With 64 bytes of filters at once, each filter is a slice of a shard and there are many rounds."""
    monkeypatch.setattr(spelling, "FILTER_BYTES", size)
    rows = texts(random.Random(size), 40)
    docs = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("word", "n", "run", "edit", "shard", "form", "a", "b")}).repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
    assert got == variants(rows)
    assert any(r[0] and r[1] != r[0] for r in got.values())
    assert size > 64 or len(spelling.rounds(spelling.sized({8: 100}))) > 3


def test_edits_are_all_edits():
    rng = random.Random(2)
    letters = np.array([97, 98, 0xE9], np.uint32)
    for _ in range(30):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
        codes = np.array([[ord(c) for c in word]], np.uint32)
        got = {}
        for n, _, at, to, h in spelling.edits_of(codes, letters):
            for i, c, x in zip(at.tolist(), to.tolist(), h.tolist(), strict=True):
                edit = word[:i] + (chr(c) if c else "") + word[i + 1 :]
                assert len(edit) == n and x == int(spelling.hashes(np.array([[ord(k) for k in edit]], np.uint32))[0])
                assert edit not in got
                got[edit] = x
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} - {""}
        want |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abé" if c > word[i]}
        assert got.keys() == want


def test_filters_lose_no_word_and_pass_few_others():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(0, 1 << 63, 20_000, np.uint64), rng.integers(0, 1 << 63, 20_000, np.uint64)
    sizes = spelling.sized({9: len(keys)})
    piece, block, bits = spelling.place(spelling.mixed(keys), *sizes[9])
    words = np.zeros((sizes[9][1], 4), np.uint64)
    np.bitwise_or.at(words, block, spelling.masks(bits))
    assert spelling.probed(keys, 9, sizes, {(9, 0): words}).all() and not piece.any()
    assert spelling.probed(others, 9, sizes, {(9, 0): words}).mean() < 0.01


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, "short")]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, SHAPE)).count() == 0
