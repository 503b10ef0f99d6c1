"""HTML extraction by wrapper induction.

Pages of one host share a template. Every page becomes a small tree in which repeated neighbours of the same kind (tag, class, id) are one
node that knows the own texts of all of them; other children of one kind stay apart. Trees of a host are aligned two by two by simple tree matching, which
maps the most nodes in order and level by level, and of equal mappings takes the one with most equal texts. A template node counts on how many pages each of its
most frequent texts was met. A text met on at least `SHARE` of the node's own pages, and on two distinct pages or more, is constant and belongs to the template, so
a page with another language, year or an empty slot does not end it; what else the node holds are slots. Near copies on a host (`families`) are one page of
evidence, so an article that is published twice with another title is not taken for a template. Templates are merged where pages are
read and then in rounds of `FAN` per host, so a host of any size spreads over many tasks. A page is aligned
with its host's template, its content is every slot that is not ruled out, in order; what joins them (their lowest common ancestor) adds no text of its own. Ruled out
are the template's constants and elements that say that they are no content: by tag (menus, forms, scripts, ...; a `header` outside `article` and `main`), by role or as hidden, or by
a whole class name all of whose words name such a block (`cookie-notice`, not `entry-header`). Ids and the classes of headings rule nothing out.

A host's template holds every node that any of its pages has, however many they are: one that was met once may be met again by the last page. A node's counts are
kept for `KEPT` texts, or eight times the most one page has there, with the error of that (Misra and Gries: at most one page in `KEPT`, for runs of neighbours one in eight, never
too high). Children of more than `CELLS` pairs are aligned row by row in little memory, with the same result. No page's text is cut.

Cases: a null or empty html gives an empty text; a page that is alone on its host is judged by kinds alone; a null or odd url is a host of its own;
repeated rows are extracted again but count once as evidence of constancy; elements may nest to any depth, and a page may be of any length; an empty table gives an empty result; unclosed
elements end with their parent; other columns are ignored."""

from __future__ import annotations

import html as html_lib
import json
import re
import sys
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import keep

FAN, HOSTS_HELD, KEPT, CELLS = 64, 512, 64, 250_000
BANDS, ROWS = 4, 6
LEAST_PAGES, SHARE = 2, 0.8
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
                  "tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "html", "head", "body"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table select article section div body html main nav aside footer header form".split())
# End of fixed values.
NEVER = frozenset("script style noscript template iframe svg object head title nav footer aside form button select textarea dialog menu search "
                  "xmp noembed noframes video audio".split())
NO_CONTENT = frozenset("ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner sidebar cookie cookies consent gdpr "
                       "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
                       "breadcrumb breadcrumbs nav navbar navigation menu menubar footer header masthead toolbar comment comments disqus respond reply replies "
                       "pagination pager widget skip".split())
ABOUT_ARTICLES = frozenset("comment comments reply replies ad ads advert sponsored promo related".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "kind", "parts", "out", "is_header", "is_main")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.parts, self.out, self.is_header = tag, [], tag in NEVER, tag == "header"
        self.kind, self.is_main = tag, tag in ("article", "main")
        if attrs.strip():
            values = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)}
            names = f"{values.get('class', '')} {values.get('id', '')}"
            words = set(_WORDS.findall(names))
            blocks = [set(_WORDS.findall(c)) for c in values.get("class", "").split()]
            if tag not in ("body", "html", "article", "main"):
                self.out |= tag not in HEADINGS and any(b and b <= NO_CONTENT for b in blocks) or values.get("role") in ROLES or "hidden" in values or values.get("aria-hidden") == "true" \
                    or "display:none" in values.get("style", "").replace(" ", "")
            elif tag == "article":
                self.out |= any(b and b <= ABOUT_ARTICLES for b in blocks)
            self.kind = f"{tag}.{'.'.join(sorted(words))}" if words else tag
            self.is_main |= values.get("role") == "main" or values.get("itemprop") == "articlebody"


def parse(source: str) -> Node:
    """The page's tree; `parts` holds strings and nodes in order."""
    root = Node("#page", "")
    stack, at, end = [root], 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            stack[-1].parts.append(html_lib.unescape(source[at:lt]))
        if lt == end:
            break
        at = lt
        if source.startswith("<!--", at):
            close = source.find("-->", at + 4)
            at = end if close < 0 else close + 3
            continue
        if source.startswith(("<!", "<?"), at):
            close = source.find(">", at)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(source, at)
        if m is None:
            if at + 1 < end and (source[at + 1].isalpha() or source[at + 1] == "/"):
                close = source.find(">", at)
                at = end if close < 0 else close + 1  # a tag that never ends, or no tag at all
            else:
                stack[-1].parts.append("<")
                at += 1
            continue
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "body") and tag not in ("html", "body"):
                    break
            continue
        if tag in ENDS_P:
            _close(stack, {"p"})
        if tag in ENDS:
            _close(stack, ENDS[tag])
        node = Node(tag, attrs)
        stack[-1].parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}", re.I).search(source, at)
            inside = source[at : close.start() if close else end]
            if tag in ("textarea", "title"):
                node.parts.append(html_lib.unescape(inside))
            at = end if close is None else close.start()
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in SCOPE:
            return


class Shape:
    """A node of a small tree: kind, children, pages it was met on, and on how many of them each hash of an own text was (`most`: the most texts of one page)."""

    __slots__ = ("kind", "kids", "pages", "texts", "most", "nodes", "own")

    def __init__(self, kind: str, kids: list, pages: int, texts: dict, most: int, nodes=None, own=None):
        self.kind, self.kids, self.pages, self.texts, self.most, self.nodes, self.own = kind, kids, pages, texts, most, nodes, own

    def dump(self) -> str:
        """The nodes in page order, each with the number of its children; flat, so that no depth is too great."""
        rows, stack = [], [self]
        while stack:
            s = stack.pop()
            rows.append([s.kind, len(s.kids), s.pages, s.most, list(s.texts), list(s.texts.values())])
            stack += reversed(s.kids)
        return json.dumps(rows)

    @staticmethod
    def load(raw: str) -> Shape:
        open_nodes: list[tuple[Shape, int]] = []
        root = None
        for kind, kids, pages, most, texts, counts in json.loads(raw):
            s = Shape(kind, [], pages, dict(zip(texts, counts)), most)
            if root is None:
                root = s
            else:
                while len(open_nodes[-1][0].kids) == open_nodes[-1][1]:
                    open_nodes.pop()
                open_nodes[-1][0].kids.append(s)
            open_nodes.append((s, kids))
        return root

    def count(self) -> int:
        n, stack = 0, [self]
        while stack:
            stack += stack.pop().kids
            n += 1
        return n

    def constant(self) -> dict:
        return {h: n for h, n in self.texts.items() if n >= SHARE * self.pages}

    @property
    def text(self) -> int:
        """The most frequent constant text; 0 where there is no text at all, -1 where it varies."""
        same = self.constant()
        return max(same, key=same.get) if same else -1 if self.most else 0


def shape(nodes: list[Node]) -> Shape:
    """Neighbours of one kind as one node."""
    runs, own = [], []
    for n in nodes:
        words = []
        for p in n.parts:
            if isinstance(p, str):
                if not p.isspace():
                    words.append(p)
            elif p.tag not in ("script", "style"):
                if runs and runs[-1][0].kind == p.kind:
                    runs[-1].append(p)
                else:
                    runs.append([p])
        text = " ".join(" ".join(words).split())
        own.append(zlib.crc32(text.encode("utf-8", "surrogatepass")) + 1 if text else 0)
    texts = {h: 1 for h in own if h}
    return Shape(nodes[0].kind, [shape(r) for r in runs], 1, texts, len(texts), nodes, own)


def _align(a: Shape, b: Shape, memo: dict) -> tuple[int, list]:
    """Pairs of nodes in the largest mapping, times 2**20, plus those of them with an equal text; and the pairs of children."""
    key = (id(a), id(b))
    if key not in memo:
        here = (1 << 20) + (not a.texts.keys().isdisjoint(b.texts))
        # a child whose kind the other side lacks maps to nothing, so a large template costs what it shares with the page
        kinds = {x.kind for x in a.kids} & {y.kind for y in b.kids}
        left, right = [i for i, x in enumerate(a.kids) if x.kind in kinds], [j for j, y in enumerate(b.kids) if y.kind in kinds]
        rows, cols = len(left), len(right)
        if rows * cols > CELLS:
            total, pairs = _align_long(a.kids, b.kids)
            memo[key] = (total + here, pairs)
            return memo[key]
        best = [[0] * (cols + 1) for _ in range(rows + 1)]
        gain = [[0] * cols for _ in range(rows)]
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                gain[i][j] = _align(a.kids[x], b.kids[y], memo)[0] if a.kids[x].kind == b.kids[y].kind else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain[i][j])
        # of equal mappings the one that the table over all children gives: in a column left out above, the way back goes up first
        ends = [-1, *right, len(b.kids)]
        apart = [ends[j + 1] - ends[j] > 1 for j in range(cols + 1)]
        pairs, i, j, new = [], rows, cols, True
        while i and j:
            if new and apart[j] and best[i][j] == best[i - 1][j]:
                i -= 1
            elif gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
                i, j, new = i - 1, j - 1, True
                pairs.append((left[i], right[j]))
            elif best[i][j] == best[i - 1][j]:
                i, new = i - 1, False
            else:
                j, new = j - 1, True
        memo[key] = (best[rows][cols] + here, pairs[::-1])
    return memo[key]


def _align_long(a: list[Shape], b: list[Shape]) -> tuple[int, list]:
    """`_align` of long rows of children: the table is filled row by row, every so many rows are held, and those between are made again on the way back."""
    same, deep, texts = {}, {}, {}
    for j, y in enumerate(b):
        same.setdefault(y.kind, []).append(j)
        if y.kids:
            deep.setdefault(y.kind, []).append(j)
        for h in y.texts:
            texts.setdefault((y.kind, h), []).append(j)
    same, texts = ({k: np.array(js) for k, js in of.items()} for of in (same, texts))

    def gains(x: Shape) -> np.ndarray:
        row = np.zeros(len(b), np.int64)
        if x.kind in same:
            row[same[x.kind]] = 1 << 20
        for h in x.texts:
            if (x.kind, h) in texts:
                row[texts[x.kind, h]] = (1 << 20) + 1
        for j in deep.get(x.kind, ()) if x.kids else ():
            row[j] = _align(x, b[j], {})[0]
        return row

    def below(best: np.ndarray, gain: np.ndarray) -> np.ndarray:
        out = np.zeros_like(best)
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + gain), out=out[1:])
        return out

    step, held, best = isqrt(len(a)) + 1, [], np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a):
        if i % step == 0:
            held.append(best)
        best = below(best, gains(x))
    pairs, i, j = [], len(a), len(b)
    while i and j:
        first = (i - 1) // step * step
        rows, gain = [held[first // step]], []
        for x in a[first:i]:
            gain.append(gains(x))
            rows.append(below(rows[-1], gain[-1]))
        while i > first and j:
            k = i - first
            if gain[k - 1][j - 1] and rows[k][j] == rows[k - 1][j - 1] + gain[k - 1][j - 1]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif rows[k][j] == rows[k - 1][j]:
                i -= 1
            else:
                j -= 1
    return int(best[-1]), pairs[::-1]


def match(a: Shape, b: Shape, memo: dict) -> tuple[int, list]:
    """Simple tree matching: the number of pairs of the largest mapping of two trees with equal roots, and the pairs of children in it."""
    total, pairs = _align(a, b, memo)
    return total >> 20, pairs


def merge(a: Shape, b: Shape, memo: dict | None = None) -> Shape:
    """The template of both: matched nodes are one, with their pages and texts' counts added; the others stay beside."""
    memo = {} if memo is None else memo
    kids, i, j = [], 0, 0
    for x, y in [*match(a, b, memo)[1], (len(a.kids), len(b.kids))]:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            kids.append(merge(a.kids[x], b.kids[y], memo))
        i, j = x + 1, y + 1
    texts, most = dict(a.texts), max(a.most, b.most)
    for h, n in b.texts.items():
        texts[h] = texts.get(h, 0) + n
    if len(texts) > (kept := max(KEPT, 8 * most)):
        cut = sorted(texts.values(), reverse=True)[kept]
        texts = {h: n - cut for h, n in texts.items() if n > cut}
    return Shape(a.kind, kids, a.pages + b.pages, texts, most)


def _joined(total: Shape | None, s: Shape) -> Shape:
    return s if total is None else merge(total, s)


def families(root: Node) -> list[int]:
    """Keys that near copies are likely to share: `BANDS` groups of `ROWS` weighted samples of the page's texts, each text as likely as its length.

    Two pages with nine tenths of their text in common share one of the keys with a probability of 0.95; pages that share half of it, by their
    template, with one of 0.06."""
    weights: dict[int, int] = {}
    stack = [root]
    while stack:
        n = stack.pop()
        for p in n.parts:
            if isinstance(p, Node):
                if p.tag not in ("script", "style"):
                    stack.append(p)
            elif not p.isspace():
                text = " ".join(p.split())
                weights[zlib.crc32(text.encode("utf-8", "surrogatepass"))] = len(text)
    if not weights:
        return [0] * BANDS
    h, w = np.array(list(weights), np.uint64), np.array(list(weights.values()), float)
    seed = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = (h[None, :] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) ^ seed
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    samples = h[np.argmin(-np.log(u + 1e-18) / w, axis=1)].reshape(BANDS, ROWS)
    return [zlib.crc32(band.tobytes()) for band in samples]


def _deep() -> None:
    """Trees of any depth: calls between functions of this module take no more than memory."""
    sys.setrecursionlimit(10_000_000)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, the small tree of every page, and its family keys."""
    _deep()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            roots = [parse(page.as_py() or "") for page in b.column(1)]
            trees = [shape([r]).dump() for r in roots]
            keys = list(zip(*map(families, roots))) or [()] * BANDS
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.string()), *[pa.array(k, pa.int64()) for k in keys]],
                                             names=["host", "tree", *[f"family{k}" for k in range(BANDS)]])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of the hosts met, merged where they were read: host, part, template."""
    _deep()
    held: dict[str, Shape] = {}
    part = TaskContext.get().partitionId()

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array([s.dump() for s in held.values()], pa.string())],
            names=["host", "part", "template"])

    for b in batches:
        for host, tree in zip(b.column(0).to_pylist(), b.column(1)):
            held[host] = _joined(held.get(host), Shape.load(tree.as_py()))
            if len(held) > HOSTS_HELD:
                yield out()
                held = {}
    yield out()


def _merge_group(rows: pd.DataFrame) -> pd.DataFrame:
    _deep()
    rows = rows.sort_values(["part", "template"])
    total = None
    for t in rows["template"]:
        total = _joined(total, Shape.load(t))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [int(rows["part"].iloc[0]) // FAN], "template": [total.dump()]})


def fitted(s: Shape) -> Shape:
    """The template with its constants only."""
    return Shape(s.kind, [fitted(k) for k in s.kids], s.pages, s.constant() if s.pages >= LEAST_PAGES else {}, s.most)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _deep()
    for b in batches:
        done = [fitted(Shape.load(t.as_py())).dump() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["host", "template"])


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def induce(pages: DataFrame) -> DataFrame:
    """host, template: one row per host."""
    schema = "host string, tree string, " + ", ".join(f"family{k} long" for k in range(BANDS))
    trees = pages.select(_host().alias("host"), "html").mapInArrow(_trees, schema)
    for k in range(BANDS):  # of near copies the first tree counts, in the order of the trees
        trees = trees.groupBy("host", f"family{k}").agg(F.min(F.struct("tree", *[f"family{j}" for j in range(k + 1, BANDS)])).alias("first")).select("host", "first.*")
    trees = trees.sortWithinPartitions("host", "tree")
    rows = keep(trees.mapInArrow(_learn, "host string, part long, template string"), "templates")
    while rows.groupBy("host").count().where("count > 1").limit(1).count():
        rows = rows.withColumn("bucket", F.floor(F.col("part") / FAN))
        rows = keep(rows.groupBy("host", "bucket").applyInPandas(
            lambda pdf: _merge_group(pdf), "host string, part long, template string"), "templates")
    return keep(rows.select("host", "template").mapInArrow(_fit, "host string, template string"), "templates")


def constants(page: Shape, template: Shape | None) -> set[int]:
    """Ids of the page's nodes whose own text is the template's."""
    out: set[int] = set()
    if template is None or template.kind != page.kind or template.pages < LEAST_PAGES:
        return out
    memo: dict = {}

    def walk(p: Shape, t: Shape) -> None:
        same = t.constant() if t.pages >= LEAST_PAGES else {}
        out.update(id(n) for n, h in zip(p.nodes, p.own) if h in same)
        for i, j in match(p, t, memo)[1]:
            walk(p.kids[i], t.kids[j])

    walk(page, template)
    return out


def _emit(n: Node, fixed: set[int], inside: bool, out: list[str]) -> None:
    block = n.tag in BLOCK
    if block:
        out.append(" ")
    own = not (id(n) in fixed)
    inside = inside or n.is_main
    for p in n.parts:
        if isinstance(p, str):
            if own:
                out.append(p)
        elif not p.out and (inside or not p.is_header):
            _emit(p, fixed, inside, out)
    if block:
        out.append(" ")


def extract(source: str, template: Shape | None = None) -> str:
    """The main text of one page."""
    _deep()
    root = parse(source)
    fixed = constants(shape([root]), template)
    out: list[str] = []
    _emit(root, fixed, False, out)
    return " ".join("".join(out).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _deep()
    known: dict[str, Shape] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b, texts = whole.slice(at, 512), []
            for page, t in zip(b.column(2), b.column(3).to_pylist()):
                if t is not None and t not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[t] = Shape.load(t)
                texts.append(extract(page.as_py() or "", known.get(t)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    templates = induce(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("host")).join(templates, "host", "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
