"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements, with a leaf for every run of text.  Each node
has a hidden state, content or not; unary potentials read its tag, its class, id and role
words, its length and its share of links, and pairwise potentials tie children to parents.
Sum-product messages go up and then down the tree; runs whose marginal favours content make
the text.  All potentials are counted on labelled pages: a bounded sample of pages whose
own markup names the article and what is not part of it, with pseudo-counts for words and
elements that name either by convention.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordrate.session import cut_lineage

from .batches import bounded

TRAIN_PAGES = 2000

# Fixed values of the HTML language: elements by the way they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript iframe".split())
CODE = frozenset("script style".split())  # without a close tag the rest of the page is theirs
#: Closed, what they hold is not shown; one that is never closed is read like any other block.
UNSHOWN = frozenset("template canvas audio video".split())
FOREIGN = frozenset("svg math".split())  # "/>" closes an element only in these
SPACED = frozenset("svg object text".split())  # inline, but never part of a word
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
#: A start tag of the first closes an open element of the second, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"button", "label", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "select", "textarea"}
SCOPE = frozenset("ul ol dl table select article section div main aside nav body html td th li".split())

# Words that pages use, by convention, in the names of their parts.
OTHER_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar side aside ad ads advert advertisement sponsor sponsored banner promo cookie cookies consent notice alert popup modal form login signup newsletter subscribe share social related recommended breadcrumb breadcrumbs pagination comment comments reply replies disqus toolbar widget copyright legal skip search".split())
MAIN_WORDS = frozenset("article main content post entry body story text page".split())
OTHER_TAGS = frozenset("#unshown nav aside footer header form menu button select option textarea label fieldset dialog search".split())
MAIN_TAGS = frozenset("article main".split())

_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(>|(?=<)|\Z))""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Page:
    """Nodes in document order (a parent before its children)."""

    __slots__ = ("parent", "tag", "names", "text", "linked")

    def __init__(self):
        self.parent, self.tag, self.names, self.text, self.linked = [], [], [], [], []

    def add(self, parent: int, tag: str, names=(), text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """The block tree of a page; broken, unclosed and cut-off markup is read as browsers do
    in outline: a start tag closes what it can't be inside of, the end closes everything."""
    page = Page()
    stack = [(page.add(-1, "#root"), "#root")]
    run, linked, links, foreign = [], 0, 0, 0

    def flush():
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                page.add(stack[-1][0], "#text", (), text, min(linked, len(text)))
            run.clear()
        linked = 0

    def put(piece):
        nonlocal linked
        run.append(piece)
        if links:
            linked += len(piece.strip())

    def close(tags, scope):
        """Close the innermost open element of ``tags`` unless one of ``scope`` is inside of it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][1] in tags:
                flush()
                del stack[i:]
                return
            if stack[i][1] in scope:
                return

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            put(source[at:])
            break
        if lt > at:
            put(source[at:lt])
        m = _TAG.match(source, lt)
        if m is None:
            put("<")
            at = lt + 1
            continue
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        if not m.group(5) and at >= n:
            break  # the page ends inside of a tag
        name = name.lower()
        if m.group(2):
            if name == "a":
                links = max(0, links - 1)
            elif name == "p" and not any(t == "p" for _, t in stack):
                flush()
            elif name in BLOCK:
                close({name}, ())
            elif name in UNSHOWN:
                node = next((i for i, t in reversed(stack) if t == name), None)
                close({name}, SCOPE)
                if node is not None and all(i != node for i, _ in stack):
                    page.tag[node] = "#unshown"
            elif name in FOREIGN:
                foreign = max(0, foreign - 1)
            if name in SPACED:
                put(" ")
            continue
        alone = m.group(4).rstrip().endswith("/")
        if name in SPACED:
            put(" ")
        if name == "br" or name == "hr":
            put(" ")
            if name == "hr":
                flush()
        elif name in VOID:
            pass
        elif name in FOREIGN:
            foreign += not alone
        elif foreign and alone:
            pass
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n if name in CODE else at
        elif name in UNSHOWN:
            flush()
            stack.append((page.add(stack[-1][0], name), name))
        elif name == "a":
            links += 1
        elif name in BLOCK:
            flush()
            links = foreign = 0
            if name in CLOSES_P:
                close({"p"}, SCOPE - {"li"})
            if name in CLOSES:
                close(CLOSES[name], SCOPE - {"li", "td", "th"} if name != "li" else SCOPE - {"li"})
            names = tuple(sorted({w for g in _NAMES.findall(m.group(4)) for w in _WORDS.findall("".join(g).lower())})) if m.group(4) else ()
            stack.append((page.add(stack[-1][0], name, names), name))
    flush()
    return page


def _bucket(n: float) -> int:
    return min(12, int(math.log2(n + 1)))


def features(page: Page, i: int) -> list[str]:
    tag = page.tag[i]
    if tag == "#text":
        n = len(page.text[i])
        return [f"len:{_bucket(n)}", f"link:{round(4 * page.linked[i] / n)}", f"in:{page.tag[page.parent[i]]}"]
    return [f"tag:{tag}", *(f"name:{w}" for w in page.names[i])]


def parts(page: Page) -> list[str]:
    """For every node, what the nearest element from it upwards with a conventional name or
    tag stands for: "main", "other", or "" where none has one."""
    out = [""] * len(page.tag)
    for i in range(1, len(out)):
        t, names = page.tag[i], page.names[i]
        if t in OTHER_TAGS or OTHER_WORDS.intersection(names):
            out[i] = "other"
        elif t in MAIN_TAGS or MAIN_WORDS.intersection(names):
            out[i] = "main"
        else:
            out[i] = out[page.parent[i]]
    return out


def _edges(page: Page) -> list[str]:
    """The kind of every node's edge to its parent: which part the parent is in, and
    whether the node is a block or a text run."""
    part = parts(page)
    return [f"{part[page.parent[i]] if i else ''}:{'leaf' if t == '#text' else 'block'}" for i, t in enumerate(page.tag)]


def labels(page: Page) -> list[int] | None:
    """States that the page's own markup gives, None if it names no article."""
    if not any(t in MAIN_TAGS for t in page.tag):
        return None
    out = [0] * len(page.tag)
    for i in range(1, len(out)):
        t, up = page.tag[i], out[page.parent[i]]
        if t in MAIN_TAGS:
            out[i] = 1
        elif t in OTHER_TAGS or OTHER_WORDS.intersection(page.names[i]):
            out[i] = 0
        else:
            out[i] = up
    return out


def _counts(batches):
    total: Counter = Counter()
    for batch in batches:
        for source in batch.column(0).to_pylist():
            page = parse(source or "")
            state = labels(page)
            if state is None:
                continue
            edge = _edges(page)
            for i in range(1, len(state)):
                kind = "leaf" if page.tag[i] == "#text" else "block"
                total[f"edge:{edge[i]}:{state[page.parent[i]]}", state[i]] += 1
                for f in features(page, i):
                    total[f, state[i]] += 1
                total[f"all:{kind}", state[i]] += 1
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["feature", "state", "n"])


class Model:
    """Log ratios of the features and 2 x 2 potentials of the edges."""

    PRIOR = 50  # pseudo-counts of a conventional name or element
    #: Log ratios are limited by kind: names and elements that are conventional say most, the
    #: shape of a text run least, so that the tree around it decides.
    LIMIT = {"name": 6.0, "tag": 1.0, "len": 1.0, "link": 2.0, "in": 0.5}
    SURE = 6.0

    def __init__(self, counts: dict[tuple[str, int], int]):
        n = Counter(counts)
        for words, tags, state in ((OTHER_WORDS, OTHER_TAGS, 0), (MAIN_WORDS, MAIN_TAGS, 1)):
            for w in words:
                n[f"name:{w}", state] += self.PRIOR
            for t in tags:
                n[f"tag:{t}", state] += self.PRIOR
        for t in ("p", "blockquote", "pre", "h1", "h2", "h3"):
            n[f"tag:{t}", 1] += 2
        total = {}
        for kind, prefixes in (("block", ("tag:", "name:")), ("leaf", ("len:", "link:", "in:"))):
            both = [n[f"all:{kind}", s] + 2 for s in (0, 1)]
            for p in prefixes:
                total[p] = both
        self.weight = {}
        for f in {k for k, _ in n if k.split(":")[0] + ":" in total}:
            t = total[f.split(":")[0] + ":"]
            r = math.log((n[f, 1] + 0.5) / t[1]) - math.log((n[f, 0] + 0.5) / t[0])
            kind, _, word = f.partition(":")
            most = self.SURE if kind == "tag" and word in MAIN_TAGS | OTHER_TAGS else self.LIMIT[kind]
            self.weight[f] = max(-most, min(most, r))
        # edge[kind][parent][child]; what lies in a part named as something else stays outside
        self.edge = {}
        for part, change in (("", 8), ("main", 8), ("other", 400)):
            for kind, stay in (("block", 8), ("leaf", 20)):
                rows = ((max(stay, change), 1), (1, stay))
                key = f"{part}:{kind}"
                self.edge[key] = []
                for up in (0, 1):
                    c = [n[f"edge:{key}:{up}", s] + rows[up][s] for s in (0, 1)]
                    # never so sure that the nodes' own features can't speak
                    p = min(0.995, max(0.005 if part != "other" else 0.0005, c[1] / (c[0] + c[1])))
                    self.edge[key].append((1 - p, p))

    def marginals(self, page: Page) -> list[float]:
        """Log odds of content of every node, by messages up and down the tree."""
        n = len(page.tag)
        own = [0.0] * n
        for i in range(1, n):
            own[i] = sum(self.weight.get(f, 0.0) for f in features(page, i))
        own[0] = -2.0
        up = [0.0] * n
        belief = own[:]
        kinds = [self.edge[e] for e in _edges(page)]
        for i in range(n - 1, 0, -1):  # children come after their parents
            (a, b), (c, d) = kinds[i]
            x = math.exp(max(-50.0, min(50.0, belief[i])))
            up[i] = math.log((d * x + c) / (b * x + a))
            belief[page.parent[i]] += up[i]
        for i in range(1, n):
            (a, b), (c, d) = kinds[i]
            p = math.exp(max(-50.0, min(50.0, belief[page.parent[i]] - up[i])))
            belief[i] += math.log((d * p + b) / (c * p + a))
        return belief

    def text(self, source: str) -> str:
        page = parse(source)
        odds = self.marginals(page)
        return "\n\n".join(page.text[i] for i in range(len(odds)) if page.tag[i] == "#text" and odds[i] > 0)


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> dict[tuple[str, int], int]:
    """Counts of the potentials from at most ``train_pages`` pages, those with the smallest
    hash of their id; pages that name no article are left out."""
    ids = cut_lineage(pages.filter("page_id is not null").select("page_id").distinct()
                      .orderBy(F.xxhash64(F.col("page_id").cast("string")), "page_id").limit(train_pages))
    sample = pages.join(bounded(ids), "page_id", "left_semi").select(F.col("html").cast("string").alias("html"))
    counted = sample.mapInArrow(_counts, "feature string, state int, n long").groupBy("feature", "state").agg(F.sum("n").alias("n"))
    return {(r["feature"], r["state"]): r["n"] for r in counted.collect()}  # words of train_pages pages at most


def main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text (blocks joined by
    two newlines, '' if none), n_chars (its code points).

    Null html is empty.  Character references are decoded, white space inside a block is one
    space.  Null or repeated ids are rows of their own; other columns are ignored.
    """
    counts = train(pages, train_pages)

    @F.arrow_udf("string")
    def extract(col: pa.Array) -> pa.Array:
        model = Model(counts)
        return pa.array([model.text(s) if s else "" for s in col.to_pylist()], pa.string())

    out = pages.select("page_id", "url", extract(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
