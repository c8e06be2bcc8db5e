"""Main text of web pages by site template removal.

Every element's subtree is hashed. Spark counts, per host, on how many different pages each hash occurs; subtrees that
recur on many pages of a host, whatever their tags and classes, are its template and are deleted first. What is left and is no
article text by its tag or class goes as well: a page's own adverts, a reader's comments, all of a host with too few pages.
What an article holds is protected: there only lists of links can be template, and class names count only whole.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.storage import broadcast_up_to, materialize

#: A subtree is template from so many different pages of a host on, and from such a share of its pages: blocks, and single lines of text.
LEAST_PAGES = 5
LEAST_SHARE = 0.05
LEAST_TEXT_SHARE = 0.3
#: Bytes of the template table that may be broadcast; beyond it the join shuffles, pages of a host dealt SALT ways.
BROADCAST_BYTES = 64 << 20
SALT = 64
#: Counts that a task holds before it passes them on.
HELD = 200_000

# Element names of HTML and words that mark parts of a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strike strong sub sup time tt u var wbr img ins del".split())
NEVER = frozenset("head script style title noscript template iframe svg canvas object embed form nav footer aside menu dialog button select textarea input".split())
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split()) | INLINE
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article body".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe signup popup modal "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments respond disqus share sharing social related login toolbar widget pagination".split()
)
#: Inside an article, names are marks if all their parts are marks or these.
HELPERS = frozenset("area bar block box button buttons container form inner items link links list panel post posts section slot stories unit wrap wrapper".split())
CONTAINERS = frozenset("div section ul ol dl table details figure aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog".split())
KEPT_TAGS = frozenset("html body article main".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z""", re.S)
MARKED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.S | re.I)
WORD = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"[ \t\n\r\f\v]+")


def marked(name: str) -> bool:
    """Whether a class name of an element inside an article says that it's no article text: comment-list does, post-header and related-work don't."""
    parts = WORD.findall(name)
    ours = MARKS - {"header", "masthead"}
    return any(p in ours for p in parts) and all(p in ours or i and p in HELPERS for i, p in enumerate(parts))


class Page:
    """Elements of one page: tag, whether tag or class rule it out, parent; and its texts with the element each is in."""

    def __init__(self, html: str):
        self.tags, self.out, self.parents, self.marks = ["#"], [False], [-1], [""]
        self.texts: list[tuple[int, str]] = []
        self._open, self._count = [0], Counter()
        at = 0
        while at < len(html):
            m = TAG.search(html, at)
            self._text(html[at : m.start() if m else len(html)])
            if not m:
                break
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._close({tag}, ())
            else:
                self._start(tag, attributes)
                if tag in RAW and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = end.start() if end else len(html)
        # Parents come before children: what is in a ruled-out element is ruled out.
        for i in range(1, len(self.out)):
            self.out[i] = self.out[i] or self.out[self.parents[i]]

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._open[-1], references.unescape(text) if "&" in text else text))

    def _close(self, tags, scopes) -> None:
        if not any(self._count[t] for t in tags):
            return
        for i in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[i]]
            if tag in tags:
                if tag not in INLINE:
                    self.texts.append((self._open[i], " "))
                self._count.subtract(self.tags[x] for x in self._open[i:])
                del self._open[i:]
                return
            if tag in scopes:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, SCOPES)
        if tag in CLOSES_SAME:
            self._close(CLOSES_SAME[tag], SCOPES)
        inside = self._count["article"] > 0
        marks, out = "", tag in NEVER or tag == "header" and not inside
        if attributes and "=" in attributes:
            for name, *values in MARKED.findall(attributes):
                name, value = name.lower(), "".join(values).lower()
                marks += f" {name}={value}"
                found = set(WORD.findall(value))
                if tag == "article":
                    out = out or bool(found & {"comment", "comments"})
                elif tag not in KEPT_TAGS and name == "role":
                    out = out or bool(found & ROLES)
                elif tag not in KEPT_TAGS and not inside:
                    out = out or bool(found & MARKS)
                elif tag in CONTAINERS and name == "class":
                    out = out or any(map(marked, value.split()))
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.marks.append(marks)
        self.out.append(out)
        if tag not in INLINE:
            self.texts.append((node, " "))
        if tag not in VOID:
            self._open.append(node)
            self._count[tag] += 1

    def inside(self, tag: str) -> list[bool]:
        """Of each element: whether it or one around it has the tag and isn't ruled out."""
        found = []
        for i, own in enumerate(self.tags):
            found.append(own == tag and not self.out[i] or i > 0 and found[self.parents[i]])
        return found

    def hashes(self, wanted: list[int]) -> list[bytes]:
        """Of each wanted subtree, and those in it: tag, class, id, role, and all text and elements in it."""
        need = [False] * len(self.tags)
        for i in wanted:
            need[i] = True
        for i in range(1, len(need)):
            need[i] = need[i] or need[self.parents[i]]
        parts: list[list[bytes]] = [[] for _ in self.tags]
        order: list[list[tuple[int, int]]] = [[] for _ in self.tags]
        for k, (i, text) in enumerate(self.texts):
            order[i].append((k, -1))
        first = {}
        for k, (i, _) in enumerate(self.texts):
            while i >= 0 and i not in first:
                first[i] = k
                i = self.parents[i]
        for i in range(1, len(self.tags)):
            order[self.parents[i]].append((first.get(i, len(self.texts)), i))
        out = [b""] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            if not need[i]:
                continue
            for k, child in sorted(order[i]):
                parts[i].append(out[child] if child >= 0 else SPACE.sub(" ", self.texts[k][1]).encode())
            out[i] = hashlib.blake2b(b"\x00".join([self.tags[i].encode(), self.marks[i].encode(), *parts[i]]), digest_size=8).digest()
        return out

    def link_lists(self) -> list[bool]:
        """Of each element: whether at least half of its text is in links."""
        size, linked = [0] * len(self.tags), [0] * len(self.tags)
        for i, text in self.texts:
            size[i] += len(text.strip())
        for i in range(len(self.tags) - 1, 0, -1):
            if self.tags[i] == "a":
                linked[i] = size[i]
            size[self.parents[i]] += size[i]
            linked[self.parents[i]] += linked[i]
        return [n > 0 and 2 * k >= n for n, k in zip(size, linked, strict=True)]

    def countable(self) -> list[int]:
        """Elements that template removal may take, also those that tag or class rule out: inside an article only blocks of links, as an article's own text may recur."""
        article, links = self.inside("article"), self.link_lists()
        return [i for i, tag in enumerate(self.tags) if i and tag not in KEPT_TAGS and (not article[i] or tag not in TEXT_ELEMENTS and links[i])]

    def main_text(self, template: frozenset[int], lists: bool = True) -> tuple[str, int, int]:
        """The text, characters that recurrence removed and characters that only tag or class ruled out."""
        recurring, out = [False] * len(self.tags), self.out if lists else [False] * len(self.tags)
        if template:
            countable = self.countable()
            hashes = self.hashes(countable)
            for i in countable:
                recurring[i] = int.from_bytes(hashes[i], "little", signed=True) in template
            for i in range(1, len(recurring)):
                recurring[i] = recurring[i] or recurring[self.parents[i]]
        text = self._joined([a or b for a, b in zip(recurring, out, strict=True)]) or self._joined(out)
        sizes = [(len(t.strip()), i) for i, t in self.texts]
        return text, sum(n for n, i in sizes if recurring[i]), sum(n for n, i in sizes if out[i] and not recurring[i])

    def _joined(self, gone: list[bool]) -> str:
        """Texts of the articles in main, else of main, else of articles, else of the page: the first that has any."""
        article, main = self.inside("article"), self.inside("main")
        for within in ([a and b for a, b in zip(article, main, strict=True)], main, article, [True] * len(gone)):
            text = SPACE.sub(" ", "".join(t for i, t in self.texts if within[i] and not gone[i])).strip(" ")
            if text:
                return text
        return ""


def subtree_counts(batches):
    """Of each host and subtree: the number of different pages (equal pages share a weight of 1) that a task has seen it on."""

    def passed(held):
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([held[k] for k in keys], pa.float64())],
            ["host", "subtree", "line", "n"],
        )

    held: dict = {}
    for batch in batches:
        for host, html, copies in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("copies").to_pylist(), strict=True):
            page = Page(html.as_py() or "")
            countable = page.countable()
            hashes = page.hashes(countable)
            for x, line in {(int.from_bytes(hashes[i], "little", signed=True), page.tags[i] in TEXT_ELEMENTS) for i in countable}:
                held[host, x, line] = held.get((host, x, line), 0.0) + 1 / copies
            if len(held) > HELD:
                yield passed(held)
                held = {}
    yield passed(held)


def extracted(lists: bool):
    def run(batches):
        sets: dict[str, frozenset[int]] = {}
        for batch in batches:
            found = []
            for host, html, template in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("template"), strict=True):
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = frozenset(template.as_py() or ())
                found.append(Page(html.as_py() or "").main_text(sets[host], lists))
            texts, recurring, ruled = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(recurring, pa.int64()), pa.array(ruled, pa.int64())],
                ["page_id", "url", "text", "template_chars", "ruled_chars"],
            )

    return run


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """host and template (hashes of the subtrees that recur). pages: host, html. Equal pages of one host count as one page."""
    pages = pages.withColumns({"h": F.xxhash64("html"), "g": F.xxhash64(F.lit(1), "html")})
    same = materialize(pages.groupBy("host", "h", "g").agg(F.count("*").alias("copies")), "pages")
    several = materialize(same.filter("copies > 1"), "copies")
    weighed = pages.join(broadcast_up_to(several, broadcast_bytes), ["host", "h", "g"], "left").select("host", "html", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    counted = weighed.mapInArrow(subtree_counts, "host string, subtree long, line boolean, n double").groupBy("host", "subtree", "line").agg(F.round(F.sum("n")).alias("n")).filter(F.col("n") >= least_pages)
    sizes = same.groupBy("host").agg(F.count("*").alias("pages"))
    share = F.when(F.col("line"), F.greatest(F.lit(LEAST_TEXT_SHARE), F.lit(least_share))).otherwise(F.lit(least_share))
    recurring = counted.join(sizes, "host").filter(F.col("n") >= F.col("pages") * share)
    # At most (elements of a page) / least_share hashes for a host, whatever the number of its pages.
    return recurring.groupBy("host").agg(F.collect_list("subtree").alias("template"))


def extract_main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_bytes: int = BROADCAST_BYTES, lists: bool = True) -> DataFrame:
    """One row per page: page_id, url, host, text (empty if none), template_chars and ruled_chars (characters that recurrence
    removed, and those that only tag or class ruled out; with lists=False nothing is ruled out so).

    Main text: what the articles in main hold (else main, else articles, else the whole page), less template and
    ruled-out elements; template removal never empties a page that has text. Character references are decoded, white
    space becomes one space, blocks are joined by one space. Null html is empty; a null url has host ''. Repeated rows,
    and different pages of a host with equal html, give a row each and count as one page of the host. Needs page_id,
    url, html; other columns are ignored.
    """
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    templates = materialize(site_templates(pages.select("host", "html"), least_pages, least_share, broadcast_bytes), "templates")
    known = broadcast_up_to(templates, broadcast_bytes)
    if known is templates:
        pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        pages = pages.join(salted, ["host", "salt"], "left")
    else:
        pages = pages.join(known, "host", "left")
    out = pages.select("page_id", "url", "host", "html", "template").mapInArrow(extracted(lists), "page_id long, url string, text string, template_chars long, ruled_chars long")
    return out.withColumn("host", host)
