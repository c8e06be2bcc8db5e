"""Plain versions of the operators, and documents with every kind of edge case."""

import itertools
import random
import re
from collections import Counter
from html.parser import HTMLParser

VOCABULARY = "bara deto fimu gola hune jari keso lipa mona nuvo pari rabe seto tiva vole wuna xari yodo zéla Ñuro".split()


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def documents():
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, shared passages, white space of all kinds."""
    rng = random.Random(5)
    shared, base = sentence(rng, 70), sentence(rng, 120).split()
    texts = [None, "", "   \n\t ", "one", "two words", shared, sentence(rng, 40) + "\n" + shared + "  " + sentence(rng, 30)]
    texts += [shared.upper(), sentence(rng, 20) + " " + shared, " ".join(base), " ".join(base)]
    for i in (3, 40, 77):
        near = list(base)
        near[i] = "changed"
        texts.append(" ".join(near))
    texts += [sentence(rng, 3000) + " " + shared, "aa " * 400, "aa " * 60, "a" * 300, "é" * 120 + shared]
    texts += [sentence(rng, 90) for _ in range(12)]
    rows = [(i * 3 + 1, t, "en", f"src{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]
    return [*rows, rows[9], (None, shared, None, None), (None, None, "xx", "src1")]


def removed(rows, units_of, length):
    """doc_id, units, removed, runs, kept units of each row with an id."""
    units = [(d, units_of(t or "")) for d, t in rows if d is not None]
    starts = {}
    for d, u in units:
        for i in range(len(u) - length + 1):
            w = bytes(u[i : i + length]) if isinstance(u, bytes) else tuple(u[i : i + length])
            starts[w] = min(d, starts.get(w, d))
    out = []
    for d, u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            w = bytes(u[i : i + length]) if isinstance(u, bytes) else tuple(u[i : i + length])
            if starts[w] < d:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        out.append((d, len(u), sum(gone), runs, bytes(kept) if isinstance(u, bytes) else b" ".join(kept)))
    return sorted(out)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def components(rows, n, percent=80):
    """doc_id -> (size of set, least doc_id reachable)."""
    sets = {d: shingles(t, n) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def item_words(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def hits(rows, items, length=10):
    """doc_id, words, hit words, sorted items of each row."""
    windows = {}
    for item, text in items:
        w = item_words(text)
        for i in range(max(len(w) - length + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + length]), set()).add(item)
    out = []
    for d, t in rows:
        w, hit, met = item_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    met |= found
        out.append((d, len(w), len(hit), sorted(str(m) for m in met if m is not None)))
    return out


class Tree(HTMLParser):
    """A nested list of (tag, children) for well-formed pages."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.root = ("#", [])
        self.stack = [self.root]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def below(node):
    yield node
    for x in node[1]:
        if not isinstance(x, str):
            yield from below(x)


def plain(node, gone):
    if node[0] in ("nav", "footer") or repr(node) in gone:
        return ""
    inner = "".join(x if isinstance(x, str) else plain(x, gone) for x in node[1])
    return inner if node[0] == "b" else f" {inner} "


def main_texts(pages, least_pages, share, text_share):
    """page_id -> text, for pages of nav, article, div, p, b and footer with a host before the first dot."""
    trees, seen, counts, sizes = {}, set(), Counter(), Counter()
    for page, url, text in pages:
        tree = trees[page] = Tree(text).root
        host = url.split("/")[2]
        if (host, text) in seen:
            continue
        seen.add((host, text))
        sizes[host] += 1
        articles = {id(y) for x in below(tree) if x[0] in ("article", "nav", "footer") for y in below(x)}
        counts.update({(host, x[0] in ("p", "b"), repr(x)) for x in below(tree) if id(x) not in articles and x[0] in ("div", "p", "b")})
    out = {}
    for page, url, _ in pages:
        host = url.split("/")[2]
        gone = {r for (h, line, r), n in counts.items() if h == host and n >= least_pages and n >= sizes[h] * (text_share if line else share)}
        parts = [x for x in below(trees[page]) if x[0] == "article"]
        found = " ".join("".join(plain(x, set() if parts else gone) for x in parts or [trees[page]]).split())
        out[page] = found or " ".join(plain(trees[page], set()).split())
    return out
