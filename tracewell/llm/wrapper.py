"""Main text of web pages by wrapper induction: the pages of a host are aligned by simple tree matching, and what stays
the same in a slot, or is a menu on most pages, is template."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title iframe object svg canvas audio video select button textarea".split())
RAW = frozenset(("script", "style"))
BLOCKS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: Elements that an element of this name closes, and those that shield them.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements, ARIA roles and class or id words that mark what is not the article.
APART = frozenset("nav footer aside menu dialog".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Whole class names that count everywhere, within the article too.
APART_INSIDE = frozenset("ad ads advert adverts advertisement advertising sponsored comments comment-list commentlist comments-area disqus cookie-notice cookie-banner newsletter newsletter-signup share-buttons social-share related-posts".split())
#: Outside the article a class name counts if all its words are among these, and one at least among the first.
APART_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar rail aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended trending popular comment comments commentlist reply replies disqus widget widgets pagination pager skip copyright legal search tags toolbar".split())
PLAIN_WORDS = frozenset("site main page top bottom left right primary secondary global local list box bar area container wrapper wrap section links link block slot unit form buttons button inner item items post posts content group row col".split())
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[\s/=]+|[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?)*+)>""")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TELLS = re.compile(r"class|id|role|hidden|inert", re.I)
_OPENS = re.compile(r"<[/!?A-Za-z]")
_NUMBER = re.compile(r"\d+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    __slots__ = ("apart", "children", "held", "linked", "name", "quiet", "tag", "text")

    def __init__(self, tag: str, name: str, apart: bool = False, quiet: bool = False):
        self.tag, self.name, self.apart, self.quiet, self.children, self.text, self.linked, self.held = tag, name, apart, quiet, [], "", 0, None


def _marked(attrs: dict[str, str], inside: bool) -> bool:
    """True where attributes say that an element is apart from the article."""
    if "hidden" in attrs or "inert" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in APART_ROLES:
        return True
    for key in ("class", "id"):
        for w in attrs.get(key, "").lower().split():
            if w in APART_INSIDE:
                return True
            if not inside:
                parts = [p for p in re.split("[-_]+", w) if p and not p.isdigit()]
                if any(p in APART_WORDS for p in parts) and all(p in APART_WORDS or p in PLAIN_WORDS for p in parts):
                    return True
    return False


class _Builder:
    """A tree of block elements. Each run of inline text between blocks is a leaf of its own, in page order.

    A silent or hidden inline element is read like others and left out at its end tag, with the run around it going
    on. One without end tag ends with what encloses it: its text up to the first block is left out, its blocks are
    not. Work per tag does not depend on the depth: where keeps the places of open elements by name.
    """

    def __init__(self):
        self.root = Node("#root", "#root")
        self.path, self.run, self.linked, self.in_link = [self.root], [], 0, False
        self.where: dict[str, list[int]] = defaultdict(list)
        self.quiet: list[int] = []
        self.unsure: list[Node] = []  # open headers and forms that go unless they hold a headline or the article

    def flush(self):
        if self.run:
            text = _SPACE.sub(" ", "".join(self.run)).strip(" ")
            if text:
                linked = 0 if self.path[-1].tag in HEADINGS else min(self.linked, len(text))
                leaf = Node("#text", "#link" if 2 * linked >= len(text) else "#text")
                leaf.text, leaf.linked = text, linked
                self.path[-1].children.append(leaf)
            self.run = []
        self.linked = 0

    def _pop(self) -> Node:
        node = self.path.pop()
        self.where[node.tag].pop()
        if node.quiet:
            self.quiet.pop()
        if self.unsure and self.unsure[-1] is node:
            self.unsure.pop()
        return node

    def close(self, at: int):
        while len(self.path) > at:
            self.flush()
            node = self._pop()
            if node.quiet:
                self.run, self.linked = node.held
                first = next((i for i, c in enumerate(node.children) if c.tag != "#text"), None)
                if first is not None:
                    self.flush()
                    self.path[-1].children += node.children[first:]

    def _push(self, node: Node):
        if node.quiet:
            self.quiet.append(len(self.path))
            node.held = (self.run, self.linked)
            self.run, self.linked = [], 0
        self.where[node.tag].append(len(self.path))
        self.path.append(node)

    def _last(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where[t]), default=0)

    def start(self, tag: str, raw: str):
        if tag in SILENT or self.quiet and self.path[self.quiet[-1]].tag == tag and tag not in BLOCKS:
            self._push(Node(tag, tag, quiet=True))
            return
        if tag == "br":
            self.run.append(" ")
            return
        if tag in ("html", "head", "body"):
            self.flush()
            return
        attrs = {}
        if raw and _TELLS.search(raw):
            for m in _ATTR.finditer(raw):
                attrs.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        inside = bool(self.where["article"] or self.where["main"])
        found = bool(attrs) and tag not in ("article", "main") and _marked(attrs, inside)
        if tag not in BLOCKS:
            if tag == "a":
                self.in_link = True
            if found and tag not in VOID:
                self._push(Node(tag, tag, quiet=True))
            return
        shield = self.quiet[-1] if self.quiet else 0
        if tag in CLOSES_P and self.where["p"] and self.where["p"][-1] > max(shield, self._last("td", "th", "table")):
            self.close(self.where["p"][-1])
        if tag in CLOSES:
            closed, shields = CLOSES[tag]
            at = self._last(*closed)
            if at > max(shield, self._last(*shields)):
                self.close(at)
        self.flush()
        if tag in VOID:
            return
        node = Node(tag, f"{tag}.{_NUMBER.sub('#', attrs.get('class', ''))}", found or tag in APART)
        if tag in ("h1", "article", "main"):
            for n in self.unsure:
                n.apart = False
            self.unsure = []
        elif not found and (tag == "form" or tag == "header" and not inside):
            node.apart = True
            self.unsure.append(node)
        self.path[-1].children.append(node)
        self._push(node)

    def end(self, tag: str):
        if tag == "a":
            self.in_link = False
        if not self.where[tag]:
            return
        at = self.where[tag][-1]
        if self._last("article", "main") > at:
            return
        if self.path[at].quiet:
            held = self.path[at].held
            while len(self.path) > at:
                self._pop()
            self.run, self.linked = held
        else:
            self.close(at)

    def data(self, text: str):
        if "&" in text:
            text = entities.unescape(text)
        self.run.append(text)
        if self.in_link:
            self.linked += len(text)


def parse(html: str | None) -> Node:
    """The page's tree, in time linear in its length. A comment without end ends at its first >; a tag
    that is not closed at the end of the page is none; < that opens no tag is text."""
    html = html or ""
    b, at, last, gone = _Builder(), 0, html.rfind(">"), set()
    while True:
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            cut = _OPENS.search(html, at)
            b.data(html[at : cut.start() if cut else None])
            break
        if lt > at:
            b.data(html[at:lt])
        m = _TAG.match(html, lt)
        if m:
            at, tag = m.end(), m[2].lower()
            raw = tag in RAW and tag not in gone and not m[1]
            ended = _ENDS[tag].search(html, at) if raw else None
            if raw and not ended:
                gone.add(tag)
            if m[1]:
                b.end(tag)
            elif ended:
                at = ended.end()
            elif tag not in SILENT or not m[3].endswith("/"):
                b.start(tag, m[3])
        elif html.startswith("<!--", lt):
            end = html.find("-->", lt + 4) if "--" not in gone else -1
            if end < 0:
                gone.add("--")
                at = html.find(">", lt) + 1
            else:
                at = end + 3
        elif html[lt + 1 : lt + 2] in ("!", "?", "/") or html[lt + 1 : lt + 2].isalpha():
            at = html.find(">", lt) + 1
        else:
            b.data("<")
            at = lt + 1
    b.close(1)
    b.flush()
    return b.root


def flatten(root: Node) -> tuple[list[int], list[str], list[str], list[int], list[int]]:
    """(depths, names) of the page's skeleton in pre-order and (texts, nodes, linked) of its leaves.

    In the skeleton a run of sibling elements of equal structure is one node, and a leaf is #link if half of its
    characters are links, else #text; each leaf tells the skeleton's node that it stands for and how many of its
    characters are links. What is apart has no leaves and no inner structure.
    """
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        if n.apart:
            n.children = []
        todo += n.children
    kinds, size, kind = {}, [], {}
    for n in reversed(order):
        kids, before = [], None
        for c in n.children:
            k = kind[id(c)]
            if k != before:
                kids.append(k)
                before = k
        key = (n.name, *kids)
        k = kinds.get(key)
        if k is None:
            k = kinds[key] = len(size)
            size.append(1 + sum(size[x] for x in kids))
        kind[id(n)] = k
    total = size[kind[id(root)]]
    depths, names = [0] * total, [""] * total
    texts, nodes, linked = [], [], []
    todo = [(root, 0, 0)]
    while todo:
        n, at, depth = todo.pop()
        depths[at], names[at] = depth, n.name
        if n.tag == "#text":
            texts.append(n.text)
            nodes.append(at)
            linked.append(n.linked)
            continue
        inner, begun, before = at + 1, at + 1, None
        placed = []
        for c in n.children:
            k = kind[id(c)]
            if k != before:
                begun, before = inner, k
                inner += size[k]
            placed.append((c, begun, depth + 1))
        todo += placed[::-1]
    return depths, names, texts, nodes, linked


class Skeleton:
    """A skeleton as a tree, its subtrees numbered by structure in kinds, which the skeletons of a comparison share."""

    def __init__(self, depths, names, kinds: dict, of: list):
        self.kids: list[list[int]] = [[] for _ in names]
        self.names, open_ = list(names), []
        for i, d in enumerate(depths):
            del open_[d:]
            if open_:
                self.kids[open_[-1]].append(i)
            open_.append(i)
        self.kind, self.size = [0] * len(names), [1] * len(names)
        for i in range(len(names) - 1, -1, -1):
            key = (names[i], *(self.kind[c] for c in self.kids[i]))
            if key not in kinds:
                kinds[key] = len(of)
                of.append(key)
            self.kind[i] = kinds[key]
            self.size[i] += sum(self.size[c] for c in self.kids[i])


def _last_row(xs: list[int], weights: dict[int, np.ndarray], m: int, rows: np.ndarray | None = None) -> np.ndarray:
    row = np.zeros(m + 1, np.int64)
    for i, x in enumerate(xs):
        new = np.zeros(m + 1, np.int64)
        new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[x]))
        row = new
        if rows is not None:
            rows[i + 1] = row
    return row


def heaviest(xs: list[int], ys: list[int], score) -> tuple[int, list[tuple[int, int]]]:
    """The in-order pairs of xs and ys of the largest total score(x, y), exact. Rows of the table are made at once;
    a large table is split in halves, so that memory stays linear."""
    head = 0
    while head < min(len(xs), len(ys)) and xs[head] == ys[head]:
        head += 1
    tail = 0
    while tail < min(len(xs), len(ys)) - head and xs[-1 - tail] == ys[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)] + [(len(xs) - t, len(ys) - t) for t in range(tail, 0, -1)]
    total = sum(score(xs[i], ys[j]) for i, j in pairs)
    todo = [(head, len(xs) - tail, head, len(ys) - tail)]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        part = np.array(ys[c:d])
        own, inverse = np.unique(part, return_inverse=True)
        weights = {x: np.array([score(x, int(y)) for y in own], np.int64)[inverse] for x in set(xs[a:b])}
        if (b - a) * (d - c) > 1_000_000 and b - a > 1:
            half = (a + b) // 2
            front = _last_row(xs[a:half], weights, d - c)
            back = _last_row(xs[half:b][::-1], {x: w[::-1] for x, w in weights.items()}, d - c)[::-1]
            cut = c + int((front + back).argmax())
            todo += [(a, half, c, cut), (half, b, cut, d)]
            continue
        rows = np.zeros((b - a + 1, d - c + 1), np.int64)
        total += int(_last_row(xs[a:b], weights, d - c, rows)[-1])
        i, j = b - a, d - c
        while i and j:
            if rows[i, j] == rows[i - 1, j]:
                i -= 1
            elif rows[i, j] == rows[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((a + i, c + j))
    return total, sorted(pairs)


class Matcher:
    """Simple tree matching of skeletons: pairs of nodes of equal name, order and ancestry kept, as many as can be.
    Scores are kept by pair of structures, and found from the leaves up without recursion."""

    def __init__(self):
        self.kinds, self.of, self.memo = {}, [], {}
        self.sizes: list[int] = []

    def skeleton(self, depths, names) -> Skeleton:
        made = Skeleton(depths, names, self.kinds, self.of)
        for key in self.of[len(self.sizes) :]:
            self.sizes.append(1 + sum(self.sizes[k] for k in key[1:]))
        return made

    def score(self, a: int, b: int) -> int:
        todo, memo, of = [(a, b)], self.memo, self.of
        while todo:
            x, y = todo[-1]
            if (x, y) in memo or x == y or of[x][0] != of[y][0]:
                todo.pop()
                continue
            need = [(u, v) for u in set(of[x][1:]) for v in set(of[y][1:]) if u != v and of[u][0] == of[v][0] and (u, v) not in memo]
            if need:
                todo += need
                continue
            memo[x, y] = 1 + heaviest(of[x][1:], of[y][1:], self._known)[0]
            todo.pop()
        return self._known(a, b)

    def _known(self, x: int, y: int) -> int:
        if x == y:
            return self.sizes[x]
        return self.memo[x, y] if self.of[x][0] == self.of[y][0] else 0

    def match(self, one: Skeleton, two: Skeleton) -> list[int | None]:
        """For each node of one its partner in two, or None."""
        out: list[int | None] = [None] * len(one.names)
        if one.names[0] != two.names[0]:
            return out
        self.score(one.kind[0], two.kind[0])
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if one.kind[a] == two.kind[b]:
                out[a : a + one.size[a]] = range(b, b + one.size[a])
                continue
            out[a] = b
            xs, ys = one.kids[a], two.kids[b]
            todo += [(xs[i], ys[j]) for i, j in heaviest([one.kind[x] for x in xs], [two.kind[y] for y in ys], self._known)[1]]
        return out


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for v in values for x in v], kind))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the last, and the parts of the page in the last; its html ends here."""
    names = ["depths", "names", "texts", "nodes", "linked"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    for batch in batches:
        rows = [flatten(parse(x.as_py())) for x in batch.column(batch.num_columns - 1)]
        cols = [_lists([[s.encode("utf-8", "replace").decode() for s in r[i]] if k == pa.string() else r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], *names])


def _slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each skeleton of a host the slots of its nodes: the wrapper's node that it is aligned with or, where the
    wrapper has none, a negative number for the names of the elements that it stands in."""
    for pdf in frames:
        out = []
        for depths, names, to_depths, to_names in zip(pdf["depths"], pdf["names"], pdf["to_depths"], pdf["to_names"], strict=True):
            m = Matcher()
            found = m.match(m.skeleton(depths, names), m.skeleton(to_depths, to_names))
            slots, path = [], []
            for d, name, partner in zip(depths, names, found, strict=True):
                del path[d:]
                up = path[-1] if path else 0
                path.append(hash_names(up, name.split(".")[0]))
                slots.append(-1 - path[-1] if partner is None else partner)
            out.append(slots)
        yield pd.DataFrame({"host": pdf["host"], "sk": pdf["sk"], "slots": out})


def _region(slots: list[int], chars: list[int], depths: list[int], names: list[str], share: float) -> int | None:
    """The wrapper's node whose subtree is the article: the innermost one that holds share of the varying text or, where
    that is one kind of paragraph, the element around it. None where that is the body itself."""
    held, up, path = np.zeros(len(depths)), [-1] * len(depths), []
    for i, d in enumerate(depths):
        del path[d:]
        up[i] = path[-1] if path else -1
        path.append(i)
    for slot, n in zip(slots, chars, strict=True):
        held[slot] += n
    total = held.sum()
    inner = [0] * len(depths)
    for i in range(len(depths) - 1, 0, -1):
        held[up[i]] += held[i]
        inner[up[i]] += names[i] != "#text" and names[i] != "#link"
    best = max((i for i in range(len(depths)) if total and held[i] >= share * total), key=lambda i: (depths[i], -i), default=None)
    while best is not None and best > 0 and (names[best][0] == "#" or not inner[best]):
        best = up[best]
    return None if best is None or names[best].split(".")[0] in ("#root", "html", "body") else best


def _regions(share: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [_region(*row, share) for row in zip(pdf["slots"], pdf["chars"], pdf["to_depths"], pdf["to_names"], strict=True)]
            yield pd.DataFrame({"host": pdf["host"], "region": pd.array(found, "Int64")})

    return run


def _within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which nodes of each skeleton stand in an article element or in the host's region."""
    for pdf in frames:
        out = []
        for depths, names, slots, region in zip(pdf["depths"], pdf["names"], pdf["slots"], pdf["region"], strict=True):
            inside, path = [], []
            for d, name, slot in zip(depths, names, slots, strict=True):
                del path[d:]
                path.append((path[-1] if path else False) or name.split(".")[0] == "article" or slot == region)
                inside.append(path[-1])
            out.append(inside)
        yield pd.DataFrame({"host": pdf["host"], "sk": pdf["sk"], "inside": out})


def hash_names(above: int, tag: str) -> int:
    """A number under 2^61 for a path of element names, the same in every process."""
    h = above
    for byte in tag.encode("utf-8", "replace"):
        h = (h * 1_000_003 + byte + 1) % ((1 << 61) - 1)
    return (h * 1_000_003) % ((1 << 61) - 1)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.8, least: int = 4, linked: float = 0.5, short: int = 60) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages.

    Every page is read once: a tree of block elements, whose leaves are runs of inline text (references decoded, white
    space made one space, trimmed). Elements, roles and classes for menus, footers, adverts, forms, notices and
    comments are left out, and so are page headers and forms without a headline and elements that show no text
    (SILENT). Within article and main only whole class names of APART_INSIDE count.

    Wrapper: a page's skeleton is its tree without texts, runs of equal siblings made one. A host's commonest skeleton
    is its wrapper, and each other one is aligned with it by simple tree matching, so leaves of all pages of a host
    come to stand in the same slots; nodes that the wrapper lacks have the slot of their element names. Over the
    different articles of all pages of the host (copies count once, pages without text not at all), a text that share
    of them hold in one slot is template, and a slot is a menu if half of them fill it with texts that are links by
    linked of their characters and of short characters in the mean (headings excepted). Both need least articles: a
    host with fewer has no template. All else is content, in page order, joined by a blank line; and so is whatever
    stands inside an article element, or inside the host's region: the innermost element of the wrapper, below the body,
    that holds share of the text that varies and is no menu. There headings, paragraphs and lists of links stay, recur
    as they may.

    Alignments are made per distinct skeleton, counts per (host, slot, text); nothing is grouped by host but what was
    found to be template, and the texts are joined with that once. Null or empty html: empty text. Null or malformed
    urls share the empty host. Repeated rows stay. Other columns are not read. Very deep, long or wide pages are read
    whole: no step recurses, and only the alignment of two lists of different siblings is quadratic in their length.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit(""))).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    ints, words = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(n, t) for n, t in (("depths", ints), ("names", words), ("texts", words), ("nodes", ints), ("linked", ints)))])
    read = materialise(src.mapInArrow(_parsed, schema).withColumn("sk", F.xxhash64("depths", "names")))

    skeletons = materialise(read.where(F.size("texts") > 0).groupBy("host", "sk").agg(F.count("*").alias("n"), F.first("depths").alias("depths"), F.first("names").alias("names")))
    wrapper = skeletons.groupBy("host").agg(F.max_by(F.struct(F.col("depths").alias("to_depths"), F.col("names").alias("to_names")), F.struct("n", "sk")).alias("w")).select("host", "w.*")
    slots = materialise(skeletons.join(wrapper, "host").select("host", "sk", "depths", "names", "to_depths", "to_names").mapInPandas(_slots, "host string, sk long, slots array<long>"))

    narrow = read.where(F.size("texts") > 0).select("host", "sk", F.xxhash64("texts").alias("article"), F.transform("texts", lambda t, i: F.struct(F.xxhash64(t).alias("text"), F.length(t).alias("chars"), F.get("linked", i).alias("linked"), F.get("nodes", i).alias("node"))).alias("leaves"))
    leaf = narrow.dropDuplicates(["host", "sk", "article"]).join(slots, ["host", "sk"]).select("host", "article", "slots", F.explode("leaves").alias("l"))
    leaf = leaf.select("host", F.get("slots", F.col("l.node")).alias("slot"), "article", F.col("l.text").alias("text"), F.col("l.chars").alias("chars"), F.col("l.linked").alias("linked"))
    told = materialise(leaf.groupBy("host", "slot", "text", "article").agg(F.max("chars").alias("chars"), F.max("linked").alias("linked")))
    of_host = materialise(told.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") >= least))
    often = materialise(told.groupBy("host", "slot", "text").agg(F.count("*").alias("articles"), F.max("chars").alias("chars")).where(F.col("articles") >= least).join(of_host, "host").where(F.col("articles") >= F.col("all") * share))
    constant = often.groupBy("host").agg(F.collect_list(F.xxhash64("slot", "text")).alias("constant"))
    filled = materialise(told.groupBy("host", "slot", "article").agg(F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).groupBy("host", "slot").agg(F.count("*").alias("articles"), F.sum("texts").alias("texts"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")))
    menus = filled.join(of_host, "host").where((F.col("articles") * 2 >= F.col("all")) & (F.col("linked") >= F.col("chars") * linked) & (F.col("chars") <= F.col("texts") * short))
    menu = menus.groupBy("host").agg(F.collect_list("slot").alias("menu"))
    fixed = often.groupBy("host", "slot").agg(F.sum(F.col("articles") * F.col("chars")).alias("fixed"))
    # As many rows as a host's wrapper has nodes.
    varying = filled.where("slot >= 0").join(menus.select("host", "slot"), ["host", "slot"], "left_anti").join(fixed, ["host", "slot"], "left")
    varying = varying.select("host", "slot", (F.col("chars") - F.coalesce("fixed", F.lit(0))).alias("chars")).join(of_host.select("host"), "host", "left_semi")
    varying = varying.groupBy("host").agg(F.collect_list("slot").alias("slots"), F.collect_list("chars").alias("chars"))
    region = varying.join(wrapper, "host").mapInPandas(_regions(share), "host string, region long")
    marks = constant.join(menu, "host", "full").join(region, "host", "left")
    within = slots.join(skeletons, ["host", "sk"]).join(marks.select("host", "region"), "host").select("host", "sk", "depths", "names", "slots", "region").mapInPandas(_within, "host string, sk long, inside array<boolean>")
    template = materialise(slots.join(marks, "host").join(within, ["host", "sk"]).select("host", "sk", "slots", "constant", "menu", "inside"))

    none = F.array().cast("array<long>")
    joined = read.join(template, ["host", "sk"], "left").select("page_id", "url", "texts", "nodes", "slots", F.coalesce("constant", none).alias("constant"), F.coalesce("menu", none).alias("menu"), "inside")
    slot = lambda i: F.get("slots", F.get("nodes", i))
    content = F.filter("texts", lambda t, i: F.coalesce(F.get("inside", F.get("nodes", i)), F.lit(False)) | ~(F.array_contains("menu", slot(i)) | F.array_contains("constant", F.xxhash64(slot(i), F.xxhash64(t)))))
    text = F.array_join(F.when(F.col("slots").isNull(), F.col("texts")).otherwise(content), "\n\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
