"""Main-text extraction from HTML by minimum-cut labelling of text blocks.

A tolerant scanner splits a page into text blocks with features of their tags,
class names and links. A logistic classifier, trained here on synthetic blocks
with known labels, turns features into the two terminal capacities of each
block. Smoothness edges join each block to the one before it and to the one
before it in the same container, and weigh more the nearer they are in the
tree. A maximum flow splits the blocks into content and boilerplate, so that
stray paragraphs follow their surroundings.

Defined results: a null, empty or textless page has empty text. Tags are read by
the tokenising rules of the HTML standard: a quote opens a value only right
after an equals sign. Unclosed elements, cut-off pages and unknown or cut-off
references are read as browsers do, as far as text goes; a quoted value without
its closing quote ends at white space or the tag's end, so that no text is lost.
Other columns and repeated rows pass as they come. One page is held in memory at
a time; scanning is linear in it, however deep elements nest.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import require, sliced

# HTML elements by what they mean for text.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SKIP = frozenset("script style noscript template iframe svg math object head title select button textarea option canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _RAW}
#: A start tag of these ends an open p.
_ENDS_P = _BLOCK - frozenset("html body dd dt li td th tr tbody thead tfoot legend summary figcaption".split())
_VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))"""
_ATTR = re.compile(rf"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+{_VALUE})?+")
_ATTRS = re.sub(r"\((?!\?)", "(?:", _ATTR.pattern)
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</(?![A-Za-z])[^>]++>?|<(/?)([A-Za-z][^\s/>]*+)((?>[\s/]++|{_ATTRS})*+)>?", re.S)

_BAD_TAGS = frozenset("nav footer aside form menu header dialog".split())
_GOOD_TAGS = frozenset("article main".split())
_BAD_NAME = re.compile(
    r"(?<![a-z])(nav|navbar|navigation|menu|header|masthead|footer|foot|sidebar|side|aside|ads?|advert\w*|banner|promo\w*|sponsor\w*|cookie\w*|"
    r"consent|notice|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|share|social|related|recommend\w*|comments?|commentlist|discuss\w*|"
    r"disqus|reply|replies|respond|reader\w*|breadcrumbs?|pagination|pager|tags?|widget|copyright|legal|toolbar|skip|hidden|form|alert|disclaimer|gdpr)(?![a-z])"
)
_GOOD_NAME = re.compile(r"(?<![a-z])(article\w*|content|main|post|entry|story|text|body|prose)(?![a-z])")


class Node:
    """An open element with what it and its ancestors say."""

    __slots__ = ("bad_name", "bad_tag", "block", "closed", "depth", "good_name", "good_tag", "name", "up")

    def __init__(self, name: str, up: Node | None, bad_tag: bool = False, bad_name: bool = False, good_tag: bool = False, good_name: bool = False):
        self.name, self.up, self.depth, self.closed = name, up, up.depth + 1 if up else 0, False
        self.block: Node = self if up is None or name in _BLOCK else up.block  # the nearest block element
        self.bad_tag = bad_tag or bool(up and up.bad_tag)
        self.bad_name = bad_name or bool(up and up.bad_name)
        self.good_tag = good_tag or bool(up and up.good_tag)
        self.good_name = good_name or bool(up and up.good_name)


@dataclass
class Block:
    """A run of text without a block boundary, and the element it begins in."""

    text: str
    node: Node
    features: tuple[float, ...]


FEATURES = ("bias", "bad_tag", "bad_name", "good_tag", "good_name", "heading", "paragraph", "list_item", "link_share", "log_words", "few_words", "stops", "copyright")


def _attributes(raw: str) -> tuple[str, bool]:
    """Names that say what an element is for, and whether it is hidden."""
    names, hidden = [], False
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            names.append(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        hidden = hidden or name == "hidden" or name == "style" and bool(re.search(r"(?i)display\s*:\s*none", value))
    return " ".join(names), hidden


# Elements that a start tag of the key ends, unless one of the fence lies between; what head may hold; what a block ends.
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = ("ul", "ol", "dl", "table", "select", "menu")
_HEAD = frozenset("title meta link script style base noscript template".split())
_ENDED = ("select", "svg", "math")


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    if not page:
        return out
    stack, where, parts, linked, skip, in_link = [Node("", None)], defaultdict(list), [], 0, 0, 0
    first: Node | None = None  # where the text at hand begins

    def flush() -> None:
        nonlocal linked, first
        text = " ".join("".join(parts).split())
        parts.clear()
        chars, linked, node, first = linked, 0, first, None
        if text:
            node = node or stack[-1]
            out.append(Block(text, node, _features(text, node, chars / len(text))))

    def say(raw: str) -> None:
        nonlocal linked, first
        if where["head"] and skip == 1 and stack[-1].name == "head" and not raw.isspace():
            close("head")
        if not skip and raw:
            text = html.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(" ".join(text.split()))
            if first is None and not text.isspace():
                first = stack[-1]

    def close(name: str) -> None:
        nonlocal skip, in_link
        if not where[name]:
            return
        at = where[name][-1]
        if name not in _BLOCK and name not in _SKIP and stack[-1].block.depth > at:
            # Formatting that ends inside a block which it doesn't hold goes on without it.
            where[name].pop()
            stack[at].closed = True
            in_link -= name == "a"
            return
        if stack[-1].block.depth >= at:
            flush()
        while len(stack) > at:
            o = stack.pop()
            if not o.closed:
                where[o.name].pop()
                in_link -= o.name == "a"
            skip -= o.name in _SKIP

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _BLOCK and not where[name]:
                flush()
            close(name)
            continue
        if where["head"] and name not in _HEAD:
            close("head")
        if name in _RAW:
            # Nothing inside counts as markup; a page cut off here ends.
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            elif name == "br":
                say(" ")
            continue
        if name in _BLOCK:
            for o in _ENDED:
                close(o)
        if name in _ENDS_P:
            close("p")
        elif name == "a":
            close("a")
        if name in _ENDS:
            fence = max((where[o][-1] for o in _FENCE if where[o]), default=0)
            same = max(((where[o][-1], o) for o in _ENDS[name] if where[o]), default=(0, ""))
            if same[0] > fence:
                close(same[1])
        if name in _BLOCK:
            flush()
        up, (names, hidden) = stack[-1], _attributes(m[3]) if m[3] and not m[3].isspace() else ("", False)
        where[name].append(len(stack))
        stack.append(
            Node(
                name, up, bad_tag=name in _BAD_TAGS or hidden, bad_name=bool(names and _BAD_NAME.search(names)),
                good_tag=name in _GOOD_TAGS, good_name=bool(names and not up.good_tag and _GOOD_NAME.search(names)),
            )
        )
        skip += name in _SKIP
        in_link += name == "a"
        if m[3].endswith("/") and name not in _BLOCK:
            close(name)
    flush()
    return out


_STOPS = frozenset("the of and to in is that it for der die und den von zu le la les de et en un une du que el los las y".split())


def _features(text: str, node: Node, link_share: float) -> tuple[float, ...]:
    words, near = text.split(), node.block.name
    stops = sum(w.strip(".,;:!?").lower() in _STOPS for w in words) / len(words)
    sure = min(1.0, link_share)
    return (
        1.0, float(node.bad_tag), float(node.bad_name), float(node.good_tag), float(node.good_name),
        float(len(near) == 2 and near[0] == "h" and near[1].isdigit()), float(near in ("p", "blockquote", "pre")), float(near in ("li", "td", "th", "dd", "dt")),
        sure, math.log1p(len(words)) / 4, float(len(words) <= 5), stops, float("©" in text or "all rights reserved" in text.lower()),
    )


# The classifier


def _training_pages(n: int, seed: int) -> Iterator[tuple[str, list[int]]]:
    """Synthetic pages of the usual parts with a label for each text block (1: content)."""
    import random

    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(2, 9))) for _ in range(300)] + sorted(_STOPS) * 4
    say = lambda a, b: " ".join(rng.choice(vocab) for _ in range(rng.randint(a, b)))
    for _ in range(n):
        page, labels = ["<html><body>"], []

        def add(markup: str, *ys: int) -> None:
            page.append(markup)
            labels.extend(ys)

        def junk(kind: str) -> None:
            style = rng.random()
            if kind == "menu":
                k = rng.randint(2, 8)
                items = "".join(f"<li><a href=/x>{say(1, 3)}</a></li>" for _ in range(k))
                wrap = ("<nav>", "</nav>") if style < 0.5 else ("<div class=menu>", "</div>") if style < 0.8 else ("<header>", "</header>")
                add(f"{wrap[0]}<ul>{items}</ul>{wrap[1]}", *[0] * k)
            elif kind == "note":
                name = rng.choice(["ad", "advert", "cookie-notice", "sidebar", "newsletter", "related", "share", "banner", "promo"])
                tag = rng.choice(["div", "aside", "section"])
                add(f'<{tag} class="{name}"><p>{say(3, 40)}</p></{tag}>', 0)
            elif kind == "comments":
                k = rng.randint(1, 4)
                add('<section id="comments">' + "".join(f"<div class=comment><p>{say(4, 40)}</p></div>" for _ in range(k)) + "</section>", *[0] * k)
            elif kind == "form":
                add(f"<form><label>{say(1, 4)}</label><input name=q></form>", 0)
            else:
                add(f"<footer>&copy; {say(2, 12)}</footer>" if style < 0.7 else f"<div class=footer><p>&copy; {say(2, 12)}</p></div>", 0)

        junk("menu")
        for kind in rng.sample(["note", "form", "note"], rng.randint(0, 3)):
            junk(kind)
        kind = rng.random()
        start, end = ("<article>", "</article>") if kind < 0.5 else ("<main>", "</main>") if kind < 0.65 else ('<div class="content">', "</div>") if kind < 0.9 else ("<div>", "</div>")
        page.append(start)
        add(f"<h1>{say(2, 12)}</h1>", 1)
        for _ in range(rng.randint(1, 12)):
            r = rng.random()
            if r < 0.1:
                add(f"<h2>{say(1, 6)}</h2>", 1)
            elif r < 0.2:
                k = rng.randint(1, 4)
                add("<ul>" + "".join(f"<li>{say(2, 15)}</li>" for _ in range(k)) + "</ul>", *[1] * k)
            elif r < 0.27:
                junk("note")
            else:
                add(f"<p>{say(1, 90)}</p>", 1)
        page.append(end)
        for kind in rng.sample(["comments", "note", "menu", "form"], rng.randint(0, 3)):
            junk(kind)
        junk("footer")
        yield "".join(page) + "</body></html>", labels


@cache
def weights(pages: int = 300, seed: int = 11, rounds: int = 400) -> tuple[float, ...]:
    """Logistic weights of ``FEATURES``, fitted to synthetic pages by gradient descent."""
    import numpy as np

    xs, ys = [], []
    for page, labels in _training_pages(pages, seed):
        found = blocks(page)
        if len(found) == len(labels):
            xs += [b.features for b in found]
            ys += labels
    x, y = np.array(xs), np.array(ys, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 2.0 * (x.T @ (p - y) / len(y) + 1e-4 * w)
    return tuple(w.tolist())


# The cut


class Flow:
    """Maximum flow by shortest augmenting paths on a small graph (Dinic)."""

    def __init__(self, n: int):
        self.to: list[list[int]] = [[] for _ in range(n)]
        self.end: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.to[x].append(len(self.end))
            self.end.append(y)
            self.room.append(c)

    def _levels(self, s: int) -> list[int]:
        level, queue = [-1] * len(self.to), [s]
        level[s] = 0
        for v in queue:
            for e in self.to[v]:
                if self.room[e] > 1e-9 and level[self.end[e]] < 0:
                    level[self.end[e]] = level[v] + 1
                    queue.append(self.end[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """After the flow is at its maximum: which vertices the source still reaches."""
        while (level := self._levels(s))[t] >= 0:
            at, path = [0] * len(self.to), []
            v = s
            while True:
                if v == t:
                    least = min(self.room[e] for e in path)
                    cut = 0
                    for i, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                        if self.room[e] <= 1e-9 and not cut:
                            cut = i + 1
                    del path[cut - 1 :]
                    v = self.end[path[-1]] if path else s
                    continue
                edges = self.to[v]
                while at[v] < len(edges):
                    e = edges[at[v]]
                    if self.room[e] > 1e-9 and level[self.end[e]] == level[v] + 1:
                        break
                    at[v] += 1
                if at[v] < len(edges):
                    path.append(edges[at[v]])
                    v = self.end[path[-1]]
                elif not path:
                    break
                else:
                    v = self.end[path.pop() ^ 1]
                    at[v] += 1
        return [x >= 0 for x in self._levels(s)]


#: Smoothness of neighbours on the page, and of neighbours in a container; less for each element between them.
SMOOTH, SMOOTH_TREE = 1.5, 0.5


def _apart(a: Node, b: Node) -> int:
    """Steps from one element to another in the tree; over a page's blocks in turn as many as it has tags at most."""
    steps = 0
    while a is not b:
        steps += 1
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return steps


def content(page: str | None, model: tuple[float, ...]) -> list[str]:
    """Texts of the blocks on the content side of the minimum cut."""
    found = blocks(page)
    if not found:
        return []
    n = len(found)
    flow, last = Flow(n + 2), {}
    for i, b in enumerate(found):
        score = max(-8.0, min(8.0, sum(w * f for w, f in zip(model, b.features, strict=True))))
        # Cost of a label is minus the logarithm of its probability.
        flow.edge(n, i, math.log1p(math.exp(score)))
        flow.edge(i, n + 1, math.log1p(math.exp(-score)))
        if i:
            near = SMOOTH / (1 + _apart(found[i - 1].node, b.node))
            flow.edge(i - 1, i, near, near)
        container = b.node.block.up or b.node.block
        j = last.get(id(container), i)
        if j < i - 1:
            flow.edge(j, i, SMOOTH_TREE, SMOOTH_TREE)
        last[id(container)] = i
    side = flow.source_side(n, n + 1)
    return [b.text for i, b in enumerate(found) if side[i]]


def main_text(page: str | None, model: tuple[float, ...] | None = None) -> str:
    return "\n".join(content(page, model or weights()))


def extract(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out`` instead of the markup."""
    require(pages, html_column)
    model = weights()
    rest = [c for c in pages.columns if c not in (html_column, out)]
    quoted = [F.col(f"`{c}`") for c in [*rest, html_column]]
    schema = T.StructType([pages.schema[c] for c in rest]).add(out, "string")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches, html_column):
            texts = [main_text(v.as_py(), model) for v in batch[html_column]]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(texts, pa.string())], [*rest, out])

    return pages.select(*quoted).mapInArrow(run, schema)
