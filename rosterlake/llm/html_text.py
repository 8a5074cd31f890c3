"""Main text of web pages by composite text density.

A page becomes a tree of its elements. Each element has a density: its
characters per tag, raised or lowered by how much of them are links, compared
with the whole body. The subtree whose children's densities have the largest
sum is the main text; its siblings on the way to the body belong to it if their
density reaches the least one on the path from the body to it. Tags only help:
an article or main element around that subtree is taken whole, for nothing of an
article is to be dropped, and of what lies beside it only articles and sections
are held against the threshold, for any short paragraph would reach it; beside
the only article of a page no section is taken that has a name or a heading of
its own, for such are what readers say. If the subtree lies in none but holds
some, the largest stands for it, unless that has less than a tenth of its text;
so does the only one of a page, wherever it lies, unless the subtree has the h1.

Elements that are never main text (menus, page headers, footers, asides, forms,
scripts and what is hidden) are left out before anything is counted. So are
those whose class, id, role or label names one of these, an advert, a notice or
comments, unless the page's main text lies in them: an article, main or h1, or
most of the body's text besides links. A class names such a thing if all its
parts do or stand for a mere place ("ad-slot", "site-footer"), so "has-sidebar"
and "legal-analysis" name none. Words for what is only found beside an article
("related", "share") count for nothing within one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, table

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>
      | <[!?/][^>]*+(?:>|\Z)
      | <[a-zA-Z][^>]*+\Z""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAME = re.compile(r"\b(?:id|class)\s*=", re.I)
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_JOINTS = re.compile(r"[-_]+")
_HEADER = frozenset(["header"])
_NAMED = frozenset("class id role aria-label".split())

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of the first kinds, if none of the second lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NO_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SCOPE = frozenset("body html table td th caption button object".split())

# Elements and the words in class, id or role that are not main text.
LEFT_OUT = frozenset("head nav footer aside form button select dialog menu svg canvas object audio video template label fieldset".split())
WORDS_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments commentlist disqus reply replies respond contentinfo complementary outbrain taboola".split()
)
BESIDE_OUT = frozenset("banner notification subscription widget widgets related recommended recommendations share sharing social feedback toolbar pagination pager login search legal copyright disclaimer skip tags".split())
PLACES = frozenset("site page top bottom left right center main primary secondary global bar box slot unit area block section container wrapper wrap inner outer list item items links panel row col column content body form thread".split())
MARKED = ("article", "main")
#: Elements that quote, and words that a quotation within an article may well have.
QUOTES, QUOTED = frozenset("blockquote q p pre figure figcaption".split()), frozenset("reply replies respond popup notice".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OF_ARTICLES_OUT = frozenset("comment reply ad advert advertisement sponsored promo related teaser".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "links", "tags", "link_tags", "density", "total", "doubtful", "named")

    def __init__(self, tag: str, parent: Node | None, doubtful: bool = False, named: bool = False) -> None:
        self.tag, self.parent, self.parts, self.doubtful, self.named = tag, parent, [], doubtful, named
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _names(word: str, among: frozenset[str]) -> bool:
    """Whether a class is one of these words, or made of them and of PLACES."""
    if word in among:
        return True
    parts = [p for p in _JOINTS.split(word) if p]
    return len(parts) > 1 and any(p in among for p in parts) and all(p in among or p in PLACES for p in parts)


def _standing(tag: str, rest: str, in_article: bool) -> tuple[bool, bool]:
    """(left out whatever lies in it, left out unless the main text lies in it)."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return True, False
    if not rest or tag in ("html", "body", "main"):
        return False, False
    words: set[str] = set()  # whole classes and the like
    for name, value in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if name in _NAMED:
            words.update(value.strip("\"'").lower().split())
        elif name == "hidden" or name == "aria-hidden" and value.strip("\"'").lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True, False
    if tag == "h1":
        return False, False
    if tag == "article":
        return False, any(_names(w, OF_ARTICLES_OUT) for w in words)
    if in_article and tag in QUOTES:
        words -= QUOTED
    return False, any(_names(w, WORDS_OUT) or not in_article and (_names(w, BESIDE_OUT) or _names(w, _HEADER)) for w in words)


def _settle(root: Node) -> None:
    """Takes out the doubtful elements in which the main text does not lie."""
    nodes = list(_walk(root))
    last = {id(n): i for i, n in enumerate(nodes)}  # the place of the last node below each
    plain, marks, texts = ({id(n): 0 for n in nodes} for _ in range(3))  # characters besides links; article, main and h1; article and main
    for node in reversed(nodes):
        me = id(node)
        plain[me] = 0 if node.tag == "a" else plain[me] + sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
        if node.parent is not None:
            mine = int(not node.doubtful and plain[me] > 0)
            plain[id(node.parent)] += plain[me]
            marks[id(node.parent)] += marks[me] + mine * (node.tag in ("article", "main", "h1"))
            texts[id(node.parent)] += texts[me] + mine * (node.tag in ("article", "main"))
            last[id(node.parent)] = max(last[id(node.parent)], last[me])
    above: dict[int, int] = {id(root): 0}  # article and main elements around a node
    out: list[Node] = []
    until = -1
    for i, node in enumerate(nodes):
        if node.parent is not None:
            above[id(node)] = above[id(node.parent)] + int(node.parent.tag in ("article", "main") and not node.parent.doubtful)
        if node.doubtful and i > until and not marks[id(node)]:
            elsewhere = texts[id(root)] > above[id(node)]  # the page marks a text that is not around this one
            if elsewhere or 2 * plain[id(node)] <= plain[id(root)]:
                out.append(node)
                until = last[id(node)]
    gone = {id(n) for n in out}
    for parent in {id(n.parent): n.parent for n in out}.values():
        parent.parts = [p for p in parent.parts if id(p) not in gone]


def parse(page: str) -> Node:
    """The tree of a page, without what is left out. parts: text and elements in page order."""
    root = Node("html", None)
    stack: list[tuple[str, Node | None]] = [("html", root)]  # None: within something left out
    opened: Counter[str] = Counter()
    at, size, any_doubtful = 0, len(page), False

    def text(lo: int, hi: int) -> None:
        if hi > lo and stack[-1][1] is not None:
            stack[-1][1].parts.append(html.unescape(page[lo:hi]))

    def close(n: int) -> None:
        opened.subtract(t for t, _ in stack[n:])
        del stack[n:]

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(at, size)
            break
        text(at, m.start())
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            for i in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name == "html" or name == "body" and opened["body"]:
            continue
        if name == "body":
            close(1)
        if name in _NO_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        if name in ENDS:
            ends, walls = ENDS[name]
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                if stack[i][0] in walls:
                    break
                if stack[i][0] in ends:
                    close(i)
                    if name != "tr":
                        break
        above = stack[-1][1]
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if above is not None:
                above.parts.append(Node(name, above) if name == "hr" else " " if name == "br" else "")
                above.tags += 1
            continue
        node = None
        if above is not None:
            never, doubtful = _standing(name, rest, opened["article"] + opened["main"] > 0)
            if not never:
                node = Node(name, above, doubtful, name == "section" and _NAME.search(rest) is not None)
                above.parts.append(node)
                any_doubtful |= doubtful
        if not rest.endswith("/") or name in BLOCK:
            stack.append((name, node))
            opened[name] += 1
    if any_doubtful:
        _settle(root)
    return root


def measure(root: Node) -> list[Node]:
    """All elements, parents first, with their densities and the sums of their children's."""
    nodes = [root]
    for node in nodes:
        nodes += [p for p in node.parts if isinstance(p, Node)]
    for node in reversed(nodes):
        node.chars += sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.links = node.chars
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.links / max(1, body.chars)
    for node in nodes:
        if not node.chars:
            continue
        c, t = node.chars, max(1, node.tags)
        ratio = c / max(1, node.links) * t / max(1, node.link_tags)
        base = math.log(c / max(1, c - node.links) * node.links + share * c + math.e)
        node.density = c / t * math.log(1 + ratio) / math.log(1 + base)
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node))
    return nodes


def main_nodes(root: Node) -> list[Node]:
    """The elements of the main text, in page order."""
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    below = [n for n in nodes if n.chars and (n is body or n.parent is not None)]
    if not below:
        return []
    best = max(below, key=lambda n: n.total)
    if not best.total:
        return [body]
    within, up = False, best
    while up is not None:
        within, up = within or up.tag in MARKED, up.parent
    marked = _marked(root)
    if not within:  # the densest subtree may be one that holds an article beside others, or what readers say of the only one
        inside = [n for n in _walk(best) if n.tag in MARKED]
        if len(marked) == 1 and not any(n.tag == "h1" for n in _walk(best)):
            inside = marked
        top = max(inside, key=lambda n: n.chars - n.links, default=None)
        if top is not None and 10 * (top.chars - top.links) >= best.chars - best.links:
            best = top
    path, up = [], best
    while up is not None and up is not body:
        path.append(up)
        up = up.parent
    least = min(n.density for n in [*path, body])
    whole = next((n for n in reversed(path) if n.tag in MARKED), best)
    if whole in (body, root):
        return [whole]
    taken: list[Node] = [whole]
    for node in path[path.index(whole) :]:
        beside = [p for p in (node.parent.parts if node.parent else ()) if isinstance(p, Node) and p is not node and p.chars and p.links * 2 <= p.chars]
        if whole.tag in MARKED:
            beside = [p for p in beside if p.density >= least and p.tag in ("article", "section")]
            taken += [p for p in beside if p.tag == "article" or len(marked) > 1 or not p.named and not any(n.tag in HEADINGS for n in _walk(p))]
        else:
            taken += [p for p in beside if p.density >= least or p.tag in ("h1", "h2", "h3")]
    order = {id(n): i for i, n in enumerate(_walk(root))}
    return sorted(taken, key=lambda n: order[id(n)])


def _marked(root: Node) -> list[Node]:
    """The article and main elements with text that lie in no other."""
    out, stack = [], [root]
    while stack:
        top = stack.pop()
        if top.tag in MARKED and top.chars:
            out.append(top)
        else:
            stack += [p for p in top.parts if isinstance(p, Node)]
    return out


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        top = stack.pop()
        yield top
        stack += [p for p in reversed(top.parts) if isinstance(p, Node)]


def blocks(node: Node) -> Iterator[str]:
    """The text of each block in page order, with single spaces."""
    held: list[str] = []
    work: list[Node | str | None] = [node]
    while work:
        top = work.pop()
        if isinstance(top, str):
            held.append(top)
            continue
        if (top is None or top.tag in BLOCK) and held:
            line = " ".join("".join(held).split())
            held.clear()
            if line:
                yield line
        if top is not None:
            work += [*([None] if top.tag in BLOCK else []), *reversed(top.parts)]
    line = " ".join("".join(held).split())
    if line:
        yield line


def main_text(page: str | None) -> str:
    """The main text of a whole page; a page without one, and null, give the empty text."""
    return "\n".join(line for node in main_nodes(parse(page)) for line in blocks(node)) if page else ""


def extract(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of html_col in column out (replaced if there is one); html_col itself goes.

    One row for each row, in the same place; null pages give the empty text.
    """
    kept = [c for c in df.columns if c != html_col and c.lower() != out.lower()]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.StringType(), False)])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=schema.names)

    return df.select(*kept, html_col).transform(mapped, run, schema)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Each page's main text and its length in code points; a null page has the empty text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
