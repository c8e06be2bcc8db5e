import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbline.llm import chat, decontaminate, graph, html, kernels, lm, minhash, mixing, quality, sharding, spans, substring, suffix
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string"
ROWS = brute.documents()
PLAIN = [(r[0], r[1]) for r in ROWS]
CLASHING = "h g bucket key span marks hits copy rep component n words hashes salt size shard slot tokens draw range offset id away least_id bundle lh lg count large_shard copies mix_id bad_id".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    """With columns of the names that the operators use inside."""
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("shard", [60, 100_000])
def test_substring_dedup(wide, shard):
    got = substring.substring_dedup(wide, 50, shard).collect()
    assert order([(r.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept) for r in got if r.doc_id is not None]) == order(brute.removed(PLAIN, lambda t: t.encode().split(), 50))
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]
    assert all(sum(b - a for a, b in zip(r.span_starts, r.span_ends, strict=True)) == r.n_removed for r in got)


@pytest.mark.parametrize("shard", [200, 1 << 20])
def test_suffix_array_dedup(wide, shard):
    got = suffix.suffix_array_dedup(wide, 50, shard).collect()
    assert order([(r.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept) for r in got if r.doc_id is not None]) == order(brute.removed(PLAIN, lambda t: t.encode(), 50))


@pytest.mark.parametrize("wide", [2, 64])
def test_one_passage_in_all_documents(spark, monkeypatch, wide):
    """Every document has the passage in other surroundings, so its edges make one key of very many spans."""
    monkeypatch.setattr(spans, "WIDE", wide)
    rng = random.Random(6)
    passage = brute.sentence(rng, 75)
    rows = [(i, " ".join(f"u{rng.random()}" for _ in range(rng.randint(0, 60))) + " " + passage + " " + " ".join(f"v{rng.random()}" for _ in range(rng.randint(0, 60)))) for i in range(90)]
    rows += [(200 + i, passage[: 300 + i] + " " + passage[7 * i :]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for run, units in ((substring.substring_dedup, lambda t: t.encode().split()), (suffix.suffix_array_dedup, lambda t: t.encode())):
        got = run(docs).collect()
        assert order([(r.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept) for r in got]) == order(brute.removed(rows, units, 50))


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Also where keys are split by windows, the documents are read from one exchange."""
    monkeypatch.setattr(spans, "WIDE", 2)
    passage = brute.sentence(random.Random(6), 75)
    docs = spark.createDataFrame([(i, f"{'u' * 60}{i} {passage} {'v' * 60}{i}") for i in range(9)], "doc_id long, text string").repartition(3)
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        for run in (substring.substring_dedup, suffix.suffix_array_dedup):
            plan = docs.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(run(docs)._jdf.queryExecution(), "formatted")
            exchanges = re.findall(r"^\(\d+\) Exchange[^\n]*\nInput[^\n]*?: \[(.*?)\]\nArguments: hashpartitioning\(h#", plan, re.M)
            assert sum("text#" in x for x in exchanges) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kind, gram", [("bytes", 20), ("words", 8)])
def test_windows_share_buckets(kind, gram):
    """Equal windows meet in one bucket wherever they stand; an anchor's windows go to few of them."""
    rng = random.Random(8)
    passage = brute.sentence(rng, 90)
    texts = [f"{brute.sentence(rng, rng.randint(0, 60))} {passage} {brute.sentence(rng, 60)}".strip() for _ in range(20)]
    u = spans.Units(pa.table({"text": texts}), kind, 50, gram, 1000)
    w = u.windows(np.arange(len(u.anchors.key)))
    assert len(set(zip(w.key.tolist(), w.bucket.tolist(), strict=True))) == len(set(w.key.tolist())) < len(w.key)
    n = u.anchors.windows
    at = np.append(0, np.cumsum(n))
    assert all(len(set(w.bucket[a:b].tolist())) <= (b - a) // spans.NEIGHBOURS + 2 for a, b in zip(at[:-1], at[1:], strict=True))


def test_resolvers_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.choice([3, 5, 8])
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(n, 25))) for _ in range(rng.randint(1, 8))]
        ids, keys = np.array([rng.randint(0, 4) for _ in strings]), np.zeros(len(strings), int)
        at = np.append(0, np.cumsum([len(s) for s in strings]))
        flat = np.frombuffer(b"".join(strings), np.uint8)
        want = {at[i] + p for i, s in enumerate(strings) for p in range(len(s) - n + 1) if any(ids[j] < ids[i] and s[p : p + n] in t for j, t in enumerate(strings))}
        for shard in (10, 40, 1000):
            assert set(suffix.array_resolver(shard)(flat, at, keys, ids, n).tolist()) == want
            assert set(substring.automaton_resolver(shard)(flat.astype(np.uint64), at, keys, ids, n).tolist()) == want


def peak_of(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_bucket_is_decided_in_little_memory():
    """Entries of very many documents, most alone in this bucket: as on a large table."""
    rng = np.random.default_rng(2)
    n = 1 << 20
    entries = spans.Entries(np.arange(n) // 2, np.zeros(n, np.int32), rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 40, n, np.uint64), *[np.zeros(n, np.int64)] * 2)
    entries.key[1::4], entries.span[5::8] = entries.key[3::4], entries.span[7::8]
    h, g, ids = (rng.integers(0, 1 << 62, n // 2) for _ in range(3))
    table = pa.Table.from_batches([entries.batch(h, g, ids)])
    assert peak_of(lambda: spans.decide(table)) < 90 * n
    got = {(r["h"], r["verdict"]) for r in spans.decide(table).to_pylist()}
    want = set()
    for x, y in zip(range(1, n, 4), range(3, n, 4), strict=True):
        a, b = sorted((x, y), key=lambda e: ids[e // 2])
        same = entries.span[x] == entries.span[y]
        for e, v in ((a, 0 if same else spans.OPEN), (b, spans.FULL if same else spans.OPEN)):
            if v:
                want.add((int(h[e // 2]), bytes([0, v])))
    assert got == want


def test_shards_with_other_keys_are_not_held():
    """Equal windows have equal keys, so a task's memory follows a shard and not its bucket."""
    rng = np.random.default_rng(2)
    rows = 40_000
    text = rng.integers(97, 123, rows * 80).astype(np.uint8)
    at, keys, ids = np.arange(rows + 1) * 80, np.arange(rows) // 4, np.arange(rows)
    for x in range(0, rows, 4):
        text[at[x + 1] + 10 : at[x + 1] + 70] = text[at[x] : at[x] + 60]
        text[at[x] + 60], text[at[x + 1] + 70] = 65, 66
    found = []
    assert peak_of(lambda: found.append(suffix.array_resolver(1 << 18)(text, at, keys, ids, 50))) < 60 << 20
    assert found[0].tolist() == [at[x + 1] + 10 + p for x in range(0, rows, 4) for p in range(11)]


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(9)]
    text = np.array([c for s in strings for c in [*(ord(x) - 96 for x in s), 0]], np.uint16)
    left = np.array([k for s in strings for k in range(len(s), -1, -1)])
    got = suffix.suffix_array(text, left)
    tail = lambda i: tuple(text[i : i + left[i]])
    assert got.tolist() == sorted(range(len(text)), key=lambda i: (tail(i), i))
    lcp = suffix.common_prefixes(text, got)
    for a, b in zip(got, got[1:], strict=False):
        x, y = tail(a), tail(b)
        assert lcp[b] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(wide, n):
    got = minhash.near_duplicates(wide, n).collect()
    want = brute.components(PLAIN, n)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert len(got) == len(ROWS)


@pytest.mark.parametrize("changes,held,frequent,long,short,block", [(12, 20_000, 5000, 64, 32, 1 << 21), (18, 20, 5000, 4, 5, 3000), (24, 16, 3, 2, 1, 9000)])
def test_lists_of_many_sets_lose_no_link(spark, monkeypatch, changes, held, frequent, long, short, block):
    """Sets around a source that isn't there: some link with the hub, some only with each other, most with nothing."""
    monkeypatch.setattr(minhash, "HELD", held)
    monkeypatch.setattr(minhash, "FREQUENT", frequent)
    monkeypatch.setattr(minhash, "LONG_LIST", long)
    monkeypatch.setattr(minhash, "SHORT_LIST", short)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(90):
        words = list(base)
        for i in rng.sample(range(300), max(0, rng.randint(changes - 6, changes + 6))):
            words[i] = f"x{rng.random()}"
        rows.append((d, " ".join(words)))
        if d % 9 == 0:  # a near copy of a set that need not be near the source
            words[rng.randrange(300)] = "other"
            rows.append((1000 + d, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2).collect()
    want = brute.components(rows, 2)
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}


def test_lists_that_chain_sets_give_their_pairs_without_blocks(spark, monkeypatch):
    """Blocks of a group grow with the square of its sets; pairs of lists lose no link either."""
    monkeypatch.setattr(minhash, "SHORT_LIST", 2)
    monkeypatch.setattr(minhash, "LONG_LIST", 4)
    monkeypatch.setattr(minhash, "TRIED", 50, raising=False)
    monkeypatch.setattr(minhash, "LIST_COST", 0, raising=False)

    def no_blocks(percent):
        def run(table):
            raise ValueError("a group was dealt in blocks")

        return run

    monkeypatch.setattr(minhash, "links_of_queries", no_blocks)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(90):
        words = list(base)
        for i in rng.sample(range(300), rng.randint(12, 24)):
            words[i] = f"x{rng.random()}"
        rows.append((d, " ".join(words)))
        if d % 9 == 0:
            words[rng.randrange(300)] = "other"
            rows.append((1000 + d, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2).collect()
    want = brute.components(rows, 2)
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}


def test_prefixes_begin_with_shingles_of_rare_words():
    """Else sets that have nothing but frequent shingles in common meet by them, more often the more sets there are."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"often{x}" if rng.random() < 0.7 else f"rare{rng.random()}" for x in rng.integers(0, 20, 200)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array(texts)], ["rep", "component", "text"])
    levels = np.zeros(1 << minhash.CELL_BITS, np.uint8)
    cell, n = np.unique(minhash.cells(kernels.word_hashes(*kernels.utf8(batch.column("text")))[0]), return_counts=True)
    levels[cell] = np.rint(4 * np.log2(n))
    (out,) = minhash.prefix_batches(2, 80, np.zeros(0, np.uint64), np.zeros(0, np.int64), levels)([batch])
    assert Counter(Counter(out.column("shingle").to_pylist()).values()).keys() == {1}


def test_estimates_are_of_the_union():
    rng = np.random.default_rng(3)
    for size in (10, 40, 300):
        x = rng.choice(2**31, size, replace=False).astype(np.uint32)
        y = np.unique(np.append(x[: size * 4 // 5], rng.choice(2**31, size // 5).astype(np.uint32)))
        k = 64
        rows = [np.pad(np.sort(s)[:k], (0, max(0, k - len(s))), constant_values=2**32 - 1)[None] for s in (x, y)]
        union = sorted({*x.tolist(), *y.tolist()})[:k]
        want = len({*x.tolist()} & {*y.tolist()} & set(union)) / len(union)
        assert minhash.estimates(*rows, k)[0] == pytest.approx(want)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


ITEMS = [(1, "Bara, deto FIMU gola hune jari keso lipa mona nuvo pari rabe"), (2, None), (3, "!!!"), (4, "one"), (5, brute.sentence(random.Random(5), 70)), (10, "zéla Ñuro zéla"), (None, "two words"), (7, "bara " * 15)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contamination(spark, wide, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(wide, items, broadcast_bytes=limit).collect()
    assert order([(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got]) == order(brute.hits(PLAIN, ITEMS))
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_quality_rules(docs, wide):
    got = quality.quality_report(wide).collect()
    assert quality.quality_filter(wide.withColumns({"row": F.lit(1), "failed_rule": F.lit("x")})).columns == [*wide.columns, "row", "failed_rule"]
    kept = sorted(str(r.doc_id) for r in quality.quality_filter(docs).collect())
    assert kept == sorted(str(r.doc_id) for r in got if r.kept)
    texts = Counter()
    for d, t in PLAIN:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        texts[(d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts


def test_order_of_rules_is_by_rejection_per_cost(docs):
    order = quality.measured_order(docs)
    ratios = [share / max(cost, 1e-6) for _, cost, share in order]
    assert ratios == sorted(ratios, reverse=True) and len(order) == len(quality.RULES)


PAGE = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></ul></nav><div class="ad">Buy!</div><article><h1>A &amp; B</h1><p>First <b>bold</b>text.<br><p>{}</article><div><p>Legal text of this site</div><footer>&copy;</footer>'


def test_html_extraction(spark):
    rows = [(i, "https://A.example/x", PAGE.format(f"page {i} &lt;3"), "extra") for i in range(8)]
    rows += [(20, "http://b.example/", "<body><div>Only <i>here</i></div><aside>no</aside>", ""), (21, None, None, ""), (22, "http://c.example", "", ""), (23, "http://d.example", "plain & simple < text", ""), (0, "https://A.example/x", PAGE.format("page 0 &lt;3"), "")]
    rows += [(30 + i, "https://plain.example/x", f"<body><div class=x>Same part</div><div>Own {i}</div>", "") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template string")
    for hosts in (1 << 20, 0):
        got = html.extract_main_text(pages, broadcast_bytes=hosts).collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == len(rows)
        assert by[3] == "A & B First boldtext. page 3 <3" and by[0] == "A & B First boldtext. page 0 <3"
        assert by[20] == "Only here" and by[21] == by[22] == "" and by[23] == "plain & simple < text"
        assert by[32] == "Own 2"  # what recurs on the host's pages is gone


def texts_of(spark, *htmls, url="https://one.example/x"):
    pages = spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in sorted(html.extract_main_text(pages).collect(), key=lambda r: r.page_id)]


def test_html_keeps_the_text_of_articles(spark):
    assert texts_of(spark, *["<main><h1>Head</h1><p>All of it.</p></main>"] * 6) == ["Head All of it."] * 6
    assert texts_of(spark, *['<article><div class="body"><p>All of it.</p></div></article>'] * 6) == ["All of it."] * 6
    assert texts_of(spark, *[f"<article><div><p>Same opening.</p></div><p>Page {i}</p></article>" for i in range(6)]) == [f"Same opening. Page {i}" for i in range(6)]
    inner = '<div class="post-header"><h1>H</h1></div><p class="social">S</p><div id="notice-period"><p>N</p></div><section class="related-work"><h2 id="related-work">R</h2></section><header>T</header>'
    assert texts_of(spark, f"<article>{inner}</article>") == ["H S N R T"]
    gone = '<div class="comment-list">x</div><section class="comments">x</section><div class="ad">x</div><ul class="share-buttons"><li>x</ul><div class="cookie-notice">x</div><aside>x</aside><footer>x</footer><form>x</form>'
    assert texts_of(spark, f"<article><p>A</p>{gone}<article class=comment>x</article></article>") == ["A"]


def test_html_finds_the_article(spark):
    teaser = "<article><h2>Teaser</h2></article>"
    assert texts_of(spark, f"<div><p>Text</p></div><aside>{teaser}</aside>") == ["Text"]
    assert texts_of(spark, f"<main><p>Text</p></main><div>{teaser}</div>") == ["Text"]
    assert texts_of(spark, f"<main><div>x</div><article>Text</article></main><div>{teaser}</div>") == ["Text"]
    menus = [f"<div><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></div><div><p>Own text {i} of the page</p></div>" if i % 10 == 0 else f"<div><p>Own text {i}</p></div>" for i in range(60)]
    assert texts_of(spark, *menus) == [f"Own text {i} of the page" if i % 10 == 0 else f"Own text {i}" for i in range(60)]


def test_html_of_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "deep" + "</b>" * 20_000
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    assert texts_of(spark, deep, long) == ["deep", " ".join(["word & word"] * 50_000)]


def test_html_equals_a_plain_walk(spark):
    """Against html.parser with a counter per host, on well-formed pages of random blocks."""
    rng = random.Random(8)
    pages = []
    for i in range(80):
        host = rng.choice("abc")
        body = [f"<nav><a href=/>{w}</a></nav>" for w in rng.sample(brute.VOCABULARY, 2)]
        body += [f"<div class=x><p>site {host} block</p></div>"] * rng.randint(0, 1)
        body += ["<article>" + "".join(f"<p>{brute.sentence(rng, rng.randint(1, 9))} <b>x</b>&lt;</p>" for _ in range(rng.randint(1, 4))) + "</article>"] if rng.random() < 0.6 else [f"<div><p>{brute.sentence(rng, 12)}</p></div>"]
        pages.append((i, f"https://{host}.example/{i}", "<html><body>" + "".join(body) + "<footer>f</footer></body></html>"))
    pages += [(100 + i, "https://a.example/", pages[0][2]) for i in range(9)]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == brute.main_texts(pages, html.LEAST_PAGES, html.LEAST_SHARE, html.LEAST_TEXT_SHARE)


def test_chat_formatting(spark):
    convs = {1: "abc", 2: "ab", 3: "abd", 4: "abc", 5: "x", 6: "xy", 7: "", 8: "b"}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x, "n") for c, s in convs.items() for t, x in enumerate(s)]
    rows += [(9, None, None, None, ""), (None, 0, "user", "<|im_end|>", ""), (10, 5000, "user", "late", ""), (10, 1, "user", "early", "")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string")).collect()}
    assert set(got) == {1, 3, 6, 8, 9, 10, None}
    assert got[1].n_copies == 2 and got[1].n_turns == 3
    assert got[3].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"
    assert got[None].rendered == "<|im_start|>user\n<| im_end|><|im_end|>\n"
    assert got[10].rendered.index("early") < got[10].rendered.index("late")


def filled(sizes, weights, budget, most):
    targets, free, left = {}, set(sizes), budget
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if sizes[s] * most <= level * weights[s]}
        if not full:
            return targets | {s: level * weights[s] for s in free}
        targets |= {s: float(sizes[s] * most) for s in full}
        left -= sum(sizes[s] * most for s in full)
        free -= full
    return targets


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, brute.sentence(rng, rng.randint(1, 30)), rng.choice(["a", "b", "b", "b", "c", "dé", None])) for i in range(2000)]
    rows += [(5000, None, "a"), (5001, "", "only empty"), (None, "x y z", "c"), rows[0]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, draw string, size int")
    got, again = mixing.mix(docs, [3, 1, 2]).collect(), mixing.mix(docs.repartition(7), [3, 1, 2]).collect()
    shown = lambda rows: Counter((r.doc_id, r.size, r.taken, r.target) for r in rows)
    assert shown(got) == shown(again) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 15 for s in sizes)


def test_sharding(docs, wide):
    got = sharding.shard_documents(wide.withColumn("text2", F.col("text")), 4).collect()
    assert len(got) == len(ROWS)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in got)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    by_text = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_sharding_equals_plain_packing(spark):
    rng = random.Random(7)
    rows = [(rng.choice([i, i, None]), brute.sentence(rng, rng.randint(1, 40)), "x") for i in range(150)] + [(500 + i, "the same text", "x") for i in range(60)] + [(7, None, "x"), (8, "", "x"), (9, "long " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sharding.shard_documents(docs.repartition(3), 4).collect()
    keys = {r.t: (r.h, r.g) for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g")).collect()}
    loads = {}
    for _, t, _ in rows:
        b, w, n = loads.get(t or "", (0, 0, 0))
        loads[t or ""] = (b + len((t or "").encode()) + 1, w + len((t or "").split()), n + 1)
    totals = [sum(v[i] for v in loads.values()) for i in range(3)]
    left, shard = [[1.0] * 3 for _ in range(4)], {}
    for t in sorted(loads, key=lambda t: (-loads[t][0], keys[t])):
        share = [loads[t][i] / totals[i] * 4 for i in range(3)]
        best = max(range(4), key=lambda s: (round(sum(left[s][i] * share[i] * sharding.IMPORTANCE[i] for i in range(3)), 12), -s))
        left[best] = [left[best][i] - share[i] for i in range(3)]
        shard[t] = best
    assert {r.text or "": r.shard for r in got} == shard
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_packing_balances_all_three():
    rng = np.random.default_rng(1)
    loads = np.column_stack([rng.lognormal(7, 1, 5000), rng.lognormal(5, 1, 5000), np.ones(5000)])
    shard = sharding.pack(loads, 16, np.array(sharding.IMPORTANCE))
    sums = np.array([loads[shard == s].sum(axis=0) for s in range(16)])
    assert sums[:, 0].max() / sums[:, 0].min() < 1.01 and (sums.max(axis=0) / sums.min(axis=0)).max() < 1.3


def test_class_language_model(spark):
    rng = random.Random(4)
    kinds = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]]
    texts = [" ".join(rng.choice(kinds[(i + d) % 2]) for i in range(rng.randint(5, 60))) for d in range(300)] + [None, "", "New a1 unseen"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, word string")
    # counted=20: most words must be joined; clustered=12: the others join by their contexts
    model, scored = lm.train_and_score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, clustered=12, classes=6, counted=20)
    got = {r.doc_id: r for r in scored.collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(counts.values()), len(counts)
    for i, x in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(counts[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x))
    out = [i for i in tokens if held[i]]
    assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out) + 0.2 * sum(len(tokens[i]) for i in out)

    # The score, word by word, from counts of the classes that the model learned.
    size, last = 6 + lm.LENGTHS + 1, 6 + lm.LENGTHS
    words = sorted(w for w in counts if w)
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    hashes = dict(zip(words, lm.Prefixes(flat).of(np.append(0, ends[:-1]), ends).view(np.int64).tolist(), strict=True))
    learned = {r.word: r["class"] for r in model.words.collect()}
    of = lambda w: last if w is None else learned.get(hashes.get(w)) if learned.get(hashes.get(w)) is not None else 6 + min(len(w), lm.LENGTHS) - 1
    assert {learned[hashes[w]] is not None for w in words if counts[w] >= lm.LEAST_COUNT} == {True}
    steps, totals, distinct = Counter(), Counter(), Counter()
    for i, x in tokens.items():
        if not held[i]:
            steps.update(zip([last, *map(of, x)], map(of, x), strict=False))
    for w, k in counts.items():
        totals[of(w)] += k
        distinct[of(w)] += 1
    overall = {c: (sum(steps[b, c] for b in range(size)) + 1) / (sum(steps.values()) + size) for c in range(size)}
    step = {(b, c): (steps[b, c] + lm.PRIOR * overall[c]) / (sum(steps[b, x] for x in range(size)) + lm.PRIOR) for b in range(size) for c in range(size)}
    emit = lambda w: 1.0 if w is None else counts[w] / totals[of(w)] if of(w) < 6 else (counts[w] + 1) / (totals[of(w)] + distinct[of(w)] + 1)
    for i, x in tokens.items():
        assert got[i].score == pytest.approx(sum(math.log10(step[b, of(w)] * emit(w)) for b, w in zip([last, *map(of, x)], x, strict=False)))
    # From each class, all words (and one unseen word of each length) have a probability of one together.
    in_class = Counter()
    for w in counts:
        in_class[of(w)] += emit(w)
    for c in range(6, last):
        in_class[c] += 1 / (totals[c] + distinct[c] + 1)
    used = [c for c in range(size) if totals[c] or c >= 6]
    assert all(in_class[c] == pytest.approx(1) for c in used)
    assert np.allclose((10**model.transition).sum(axis=1), 1)


def test_joining_classes_takes_bounded_memory():
    """A batch of many words with many contexts is weighed in parts, with the result of each word alone."""
    rng = np.random.default_rng(5)
    classes, words, each = 64, 6000, 40
    matrix = type("Shared", (), {"value": rng.integers(0, 1000, (classes, classes))})
    sizes = rng.integers(1, 2 * each, words)
    cells = np.concatenate([rng.choice(2 * classes, n, replace=False) for n in sizes]).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(cells), pa.array(rng.integers(1, 50, len(cells)))], ["cell", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), struct)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(words)), lists], ["word", "contexts"])
    run = lm.joined_classes(matrix)
    tracemalloc.start()
    got = pa.Table.from_batches(list(run([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert got["word"].to_pylist() == list(range(words))
    alone = [next(run([batch.slice(i, 1)])).column("class")[0].as_py() for i in range(0, words, 17)]
    assert got["class"].to_pylist()[::17] == alone


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        substring.substring_dedup(docs), suffix.suffix_array_dedup(docs), minhash.near_duplicates(docs), decontaminate.contamination(docs, items), quality.quality_report(docs), quality.quality_filter(docs),
        html.extract_main_text(pages), chat.format_chats(turns), mixing.mix(docs, [1]), sharding.shard_documents(docs), lm.score_documents(docs, F.lit(False)),
    ):
        assert out.count() == 0
    assert decontaminate.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).first().n_hit == 0


def test_kept_text_digest(docs):
    got = substring.substring_dedup(docs).select("doc_id", F.sha2("kept", 256).alias("s"), "kept").collect()
    assert all(r.s == hashlib.sha256(r.kept).hexdigest() for r in got)


def test_html_templates_need_no_names(spark):
    """Menus, notices and footers without telling tags or names go by recurrence alone; a page's own advert goes by its class."""
    page = '<body><div class="x1"><ul><li><a href=/a>Alpha</a></li><li><a href=/b>Beta</a></li></ul></div><div class="q7">We store things.</div><div class="ad">Buy {0}</div><article><p>Story {0} of the day.</p></article><div class="zz"><p>Imprint, rights</p></div></body>'
    rows = [(i, "https://one.example/x", page.format(i)) for i in range(12)] + [(50 + i, "https://few.example/x", page.format(i)) for i in range(2)]
    bare = [(100 + i, "https://bare.example/x", page.format(i).replace("<article>", "<div>").replace("</article>", "</div>")) for i in range(12)]
    pages = spark.createDataFrame(rows + bare, "page_id long, url string, html string")
    with_lists, without = ({r.page_id: r for r in html.extract_main_text(pages, lists=x).collect()} for x in (True, False))
    for i in range(12):
        assert with_lists[i].text == without[i].text == f"Story {i} of the day."
        assert without[i].template_chars == len("AlphaBetaWe store things.Imprint, rights") == with_lists[i].template_chars
        assert with_lists[i].ruled_chars == len(f"Buy {i}") and without[i].ruled_chars == 0
        assert with_lists[100 + i].text == f"Story {i} of the day." and without[100 + i].text == f"Buy {i} Story {i} of the day."
    assert with_lists[50].template_chars == 0 and with_lists[50].ruled_chars == len("Buy 0")
