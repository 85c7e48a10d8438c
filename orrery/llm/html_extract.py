"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every run of text is a node that is content or not. A node has a potential from what it
is (element, names, lengths, links), each edge one from the states of parent and child and the kind
of the child. Sum-product messages upward and downward give the marginals exactly, since the graph
is a tree. Potentials are fitted by gradient ascent of the labelled pages' likelihood, whose
gradient is what the labels count less what the marginals expect.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.html_pages import labelled_pages

#: Fixed values of HTML: elements by how they parse and lay out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
PLAIN = frozenset("title textarea xmp iframe noembed noframes".split())
UNSEEN = RAW | {"title", "iframe", "noembed", "noframes", "template", "head"}
CONTAINER = frozenset("html body div section article main aside nav header footer form ul ol dl table tbody thead tfoot tr figure details dialog fieldset noscript menu center frameset hgroup search select".split())
BLOCK = CONTAINER | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre blockquote figcaption hr address summary legend option optgroup title textarea button".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "option", "optgroup", "legend", "select", "body", "html", "title", "textarea", "noscript"}
#: An opening tag of the key ends an open element of the values, if nothing of the third kind is between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z", re.DOTALL)
#: One attribute after the other: a name, and its value if it has one.
ATTRIBUTE = re.compile(r"""([^\s/=][^\s/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*)))?|=""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Parts of names that an article's wrapper has.
ARTICLE_NAMES = frozenset("article content post entry story".split())
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str  # "#" for text
    parent: int
    names: str = ""
    text: str = ""
    label: int = 0
    children: list[int] = field(default_factory=list)
    unseen: bool = False
    length: int = 0
    linked: int = 0
    direct: int = 0
    parts: frozenset[str] = frozenset()
    wraps: bool = False


def attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for a in ATTRIBUTE.finditer(raw):
        if a[1]:
            found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
    return found


def parse(page: str, labelled: bool = False) -> list[Node]:
    """Nodes in page order; the first is the root. Scripts, styles, comments and titles leave no text.

    ``data-label`` is read from labelled pages only, where the model is fitted; in any other page it is an
    attribute without meaning.
    """
    nodes = [Node("html", -1)]
    stack, at, n = [0], 0, len(page)
    # How many elements of each kind are open: an end tag that closes none costs no walk.
    opened = Counter({"html": 1})

    def cut(d: int) -> None:
        opened.subtract(nodes[k].tag for k in stack[d:])
        del stack[d:]

    def put(node: Node) -> int:
        node.unseen = nodes[node.parent].unseen or node.tag in UNSEEN
        nodes.append(node)
        nodes[node.parent].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def text(raw: str) -> None:
        if raw and not nodes[stack[-1]].unseen:
            put(Node("#", stack[-1], text=html.unescape(raw), label=nodes[stack[-1]].label))

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for d in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if nodes[stack[d]].tag == tag:
                    cut(d)
                    break
                if nodes[stack[d]].tag in CONTAINER and tag not in CONTAINER:
                    break  # an end tag of a phrase doesn't close a section
            continue
        found = attributes(m[3]) if m[3] else {}
        if tag in ("html", "body") and opened[tag]:
            if labelled and tag == "html":
                nodes[0].label = int(found.get("data-label", 0))
            continue
        if tag == "body" and nodes[stack[-1]].tag == "head":
            cut(len(stack) - 1)
        if tag in CLOSES_P and opened["p"]:
            for d in range(len(stack) - 1, 0, -1):
                if nodes[stack[d]].tag == "p":
                    cut(d)
                    break
                if nodes[stack[d]].tag in CONTAINER or nodes[stack[d]].tag in ("td", "th", "button"):
                    break
        if tag in ENDS and any(opened[t] for t in ENDS[tag][0]):
            ended, fence = ENDS[tag]
            for d in range(len(stack) - 1, 0, -1):
                if nodes[stack[d]].tag in ended:
                    cut(d)
                    break
                if nodes[stack[d]].tag in fence:
                    break
        label = nodes[stack[-1]].label
        if labelled and "data-label" in found:
            label = int(found["data-label"])
        names = " ".join(v for k in ("class", "id", "role") if (v := found.get(k))) + (" hidden" if "hidden" in found else "")
        k = put(Node(tag, stack[-1], names=names, label=label))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW or tag in PLAIN:
            close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            if tag == "textarea":
                put(Node("#", k, text=html.unescape(page[at : close.start() if close else n]), label=label))
            at = close.end() if close else n
            continue
        stack.append(k)
        opened[tag] += 1
    for k in range(len(nodes) - 1, 0, -1):
        x = nodes[k]
        if x.tag == "#":
            x.length = x.direct = len(x.text.strip())
        elif x.names:
            x.parts = frozenset(p.lower() for p in NAME_PARTS.findall(x.names))
        up = nodes[x.parent]
        up.length += x.length
        up.linked += x.length if x.tag == "a" else x.linked
        up.direct += 0 if x.tag in CONTAINER else x.direct
        up.wraps |= x.wraps or x.tag in ("article", "main") or x.tag in CONTAINER and not ARTICLE_NAMES.isdisjoint(x.parts)
    return nodes


def kind(node: Node) -> int:
    """Of an edge, by its child: 0 text, 1 phrase, 2 block, 3 container."""
    return 0 if node.tag == "#" else 3 if node.tag in CONTAINER else 2 if node.tag in BLOCK else 1


def traits(nodes: list[Node], k: int) -> list[str]:
    """The node's features. Those of text and phrases are few: they follow their parents."""
    x = nodes[k]
    if x.tag == "#":
        return ["text"]
    out = ["tag " + x.tag]
    out += ["name " + p for p in sorted(x.parts)]
    if x.tag in CONTAINER:
        up = nodes[x.parent].tag if x.parent >= 0 else ""
        out.append(f"in {x.tag} {up}")
        out.append(f"size {min(4, len(str(x.length)))}" if x.length else "size none")
        if x.length:
            out.append(f"links {4 * x.linked // x.length}")
            whole = x.tag if x.tag in ("html", "body") else "part"
            out.append(f"direct {4 * x.direct // x.length} {'around an article' if x.wraps else 'alone'} {whole}")
    elif x.length and x.linked > 0.8 * x.length:
        out.append("mostly links")
    return out


@dataclass
class ContentModel:
    weights: dict[str, float]
    edges: list[list[list[float]]]  # by kind of the child: states of the parent, then of the child

    def marginals(self, nodes: list[Node], own: list[list[str]] | None = None) -> tuple[list[float], list[tuple[float, ...]]]:
        """P(content) of each node, and for each edge the joint of parent and child as (00, 01, 10, 11)."""
        get, n = self.weights.get, len(nodes)
        tables = [[[math.exp(v) for v in row] for row in t] for t in self.edges]
        one, zero = [0.0] * n, [1.0] * n  # beliefs from below, scaled
        up = [(1.0, 1.0)] * n
        for k in range(n):
            s = sum(get(f, 0.0) for f in (own[k] if own else traits(nodes, k)))
            one[k] = math.exp(max(-30.0, min(30.0, s)))
        kinds = [kind(x) for x in nodes]
        for k in range(n - 1, 0, -1):
            (a, b), (c, d) = tables[kinds[k]]
            z, o = zero[k], one[k]
            m0, m1 = a * z + b * o, c * z + d * o
            s = m0 + m1
            up[k] = m0, m1 = m0 / s, m1 / s
            p = nodes[k].parent
            zero[p] *= m0
            one[p] *= m1
            s = zero[p] + one[p]
            if s < 1e-200 or s > 1e200:
                zero[p], one[p] = zero[p] / s + 1e-300, one[p] / s + 1e-300
        belief = [0.0] * n
        down = [(1.0, 1.0)] * n
        joints: list[tuple[float, ...]] = [()] * n
        for k in range(n):
            z, o = zero[k] * down[k][0], one[k] * down[k][1]
            s = z + o
            z, o = (z / s, o / s) if s > 0 else (0.5, 0.5)
            belief[k] = o
            for c in nodes[k].children:
                m0, m1 = up[c]
                r0, r1 = z / max(m0, 1e-300), o / max(m1, 1e-300)
                t = tables[kinds[c]]
                j = (r0 * t[0][0] * zero[c], r0 * t[0][1] * one[c], r1 * t[1][0] * zero[c], r1 * t[1][1] * one[c])
                s = sum(j) or 1.0
                joints[c] = j = tuple(v / s for v in j)
                d0, d1 = r0 * t[0][0] + r1 * t[1][0], r0 * t[0][1] + r1 * t[1][1]
                s = d0 + d1 or 1.0
                down[c] = d0 / s, d1 / s
        return belief, joints

    def text(self, page: str) -> str:
        nodes = parse(page)
        belief, _ = self.marginals(nodes)
        blocks: list[str] = []
        run: list[str] = []

        def flush() -> None:
            if run:
                if block := SPACE.sub(" ", "".join(run)).strip():
                    blocks.append(block)
                run.clear()

        # Walk without recursion: page order, closing marks where a block ends.
        stack = [(0, False)]
        while stack:
            k, ends = stack.pop()
            x = nodes[k]
            if x.tag == "#":
                if belief[k] > 0.5:
                    run.append(x.text)
                continue
            if x.tag in BLOCK:
                flush()
            elif x.tag == "br":
                run.append(" ")
            if not ends:
                stack.append((k, True))
                stack += [(c, False) for c in reversed(x.children)]
        flush()
        return " ".join(blocks)


def fit(pages: list[str], rounds: int = 60, rate: float = 0.15, shrink: float = 1e-4) -> ContentModel:
    """Adam's ascent of the likelihood of all node labels, by exact marginals."""
    model = ContentModel(defaultdict(float), [[[0.5, -0.5], [-0.5, 0.5]] for _ in range(4)])
    trees = [parse(p, labelled=True) for p in pages]
    own = [[traits(t, k) for k in range(len(t))] for t in trees]
    first: dict = defaultdict(float)
    second: dict = defaultdict(float)
    for step in range(1, rounds + 1):
        gradient: dict = defaultdict(float)
        for t, features in zip(trees, own, strict=True):
            belief, joints = model.marginals(t, features)
            for k, x in enumerate(t):
                for f in features[k]:
                    gradient[f] += x.label - belief[k]
                if k:
                    e, s = kind(x), 2 * t[x.parent].label + x.label
                    for i, p in enumerate(joints[k]):
                        gradient[e, i] += (i == s) - p
        for key, g in gradient.items():
            now = model.weights[key] if isinstance(key, str) else model.edges[key[0]][key[1] // 2][key[1] % 2]
            g = g / len(trees) - shrink * now
            first[key] = 0.9 * first[key] + 0.1 * g
            second[key] = 0.98 * second[key] + 0.02 * g * g
            now += rate * (first[key] / (1 - 0.9**step)) / (math.sqrt(second[key] / (1 - 0.98**step)) + 1e-8)
            if isinstance(key, str):
                model.weights[key] = now
            else:
                model.edges[key[0]][key[1] // 2][key[1] % 2] = now
    return ContentModel(dict(model.weights), model.edges)


@functools.cache
def default_model() -> ContentModel:
    """Fitted once in a process on the labelled pages that come with the operator."""
    return fit(labelled_pages())


def extract(pages: DataFrame, model: ContentModel | None = None, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    text is what the model holds to be the article: character references decoded, white space inside a
    block one space, blocks in page order joined by one space. A page without a wrapper around its article
    (bare paragraphs, plain text) is read as the article where nothing says otherwise. A null or empty page,
    or one without an article, has an empty text. Repeated rows come out each; a null id or url stays null;
    other columns, whatever their names, play no part. An empty table gives no rows. No shuffle.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(markup).cast("string"), F.lit("")).alias("html"))
    return narrow.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
