"""Main text of web pages: a tree-structured graphical model over DOM nodes, solved by sum-product message passing."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.llm.common import modest_batches

START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: One attribute's name, up to its value if it has one.
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=]*+)(?:\s*+=\s*+)?+")
BARE = re.compile(r"[^\s>]*+")
NAMED = frozenset(["class", "id", "role"])
PART = re.compile(r"[a-z]+")
COMMENT_END = re.compile(r"--!?>")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a start tag of the key ends, if one is open within the current container.
ENDS = {t: frozenset(["p"]) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
ENDS |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
#: Tags that say themselves what they are, whatever they stand in.
SPEAKING = frozenset("article main aside nav header footer form section body button select label".split())
WALLS = frozenset("html body div section article main aside nav header footer table ul ol dl td th form blockquote li figure".split())

@dataclass
class Node:
    tag: str
    parent: int
    names: frozenset[str] = frozenset()
    words: int = 0
    linked: int = 0
    label: int | None = None


class Scanner:
    """Finds marks from left to right; what isn't found once is never looked for again, so a page takes linear time."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, set()

    def find(self, mark: str, at: int) -> int:
        if mark in self.gone:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.gone.add(mark)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """(attributes, whether the tag closes itself, where it ends) of a tag whose name ends at `at`; -1 if it doesn't end."""
        page, found, closed = self.page, {}, False
        if self.find(">", at) < 0:
            return found, closed, -1
        while True:
            if at < len(page) and page[at] == ">":
                return found, closed, at + 1
            m = ATTRIBUTE.match(page, at)
            name, equals, end = m[1].lower(), m.end() > m.end(1) and page[m.end(1) : m.end()].strip() == "=", m.end() if m[1] or page[m.end(1) : m.end()] else m.end(1)
            closed = not name and page[end - 1 : end] == "/"
            if not equals:
                if end == at:  # a stray sign
                    end += 1
                if end >= len(page):
                    return found, closed, -1
                at = end
                found.setdefault(name, "")
                continue
            quote = page[end : end + 1]
            if quote in ('"', "'") and quote:
                stop = self.find(quote, end + 1)
                if stop >= 0:
                    found.setdefault(name, page[end + 1 : stop])
                    at = stop + 1
                    continue
            m = BARE.match(page, end)  # also a value whose quote is never closed
            found.setdefault(name, m[0])
            at = m.end()
            if at >= len(page):
                return found, closed, -1


class OpenTags:
    """The open elements, with the places of each tag and of containers, so that no search goes through all of them."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {}
        self.walls = [0]

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in WALLS:
            self.walls.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        """The place of the innermost open element of the tag; 0 for none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            self.nodes.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in WALLS:
                self.walls.pop()


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in document order (parents first), and the text runs as (node, text); node -1 marks the border of a block.

    Linear in the page's length, however broken it is: a tag, comment or raw element that never ends takes the rest of the page.
    """
    nodes, runs, at = [Node("#root", -1)], [], 0
    scan, open_ = Scanner(page), OpenTags()

    def text(piece: str) -> None:
        if piece:
            runs.append((open_.nodes[-1], piece))

    while at < len(page):
        lt = scan.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = START.match(page, lt)
        if m is None:
            if page.startswith(("<!", "<?"), lt):
                text(page[at:lt])
                if page.startswith("<!--", lt):  # "<!-->" is a whole comment
                    end = COMMENT_END.search(page, lt + 2)
                    at = end.end() if end else len(page)
                else:
                    end = scan.find(">", lt + 2)
                    at = len(page) if end < 0 else end + 1
            else:  # a sign of its own
                text(page[at : lt + 1])
                at = lt + 1
            continue
        text(page[at:lt])
        tag, attributes, closed = m[2].lower(), {}, False
        at = scan.find(">", m.end())
        if at < 0:
            break
        inside = page[m.end() : at]
        if "=" in inside:
            attributes, closed, at = scan.attributes(m.end())
            if at < 0:
                break
        else:
            closed, at = inside.endswith("/"), at + 1
        if tag not in INLINE:
            runs.append((-1, ""))
        elif tag == "br":
            text(" ")
        if m[1]:
            place = open_.last(tag)
            # An end tag without its start ends nothing; an inline one ends no container.
            if place and (tag not in INLINE or open_.walls[-1] < place):
                open_.close(place)
            continue
        if tag in ENDS:
            place = max(open_.last(t) for t in ENDS[tag])
            if place and place >= open_.walls[-1]:
                open_.close(place)
        node = Node(tag, open_.nodes[-1])
        if attributes:
            node.names = frozenset(p for k in NAMED for p in PART.findall(attributes.get(k, "").lower()))
            if attributes.get("data-y") in ("0", "1"):
                node.label = int(attributes["data-y"])
        nodes.append(node)
        if tag in RAW:
            if not closed:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*+>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
        elif tag not in VOID and not closed:
            open_.push(len(nodes) - 1, tag)
    for i, piece in runs:
        if i >= 0:
            n = len(piece.split())
            nodes[i].words += n
            nodes[i].linked += n * (nodes[i].tag == "a")
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.words += node.words
        up.linked += node.words if up.tag == "a" else node.linked
    return nodes, runs


def features(node: Node) -> list[tuple]:
    """What a label emits: the tag (of blocks once more with their share of links), each word of class, id and role, and the size of blocks; nothing where there is no word of text."""
    if not node.words:
        return []
    own = [("tag", node.tag), ("named", bool(node.names)), *(("name", x) for x in sorted(node.names))]
    if node.tag in INLINE:
        return own
    share = node.linked / node.words
    return [
        *own,
        ("block", node.tag, 0 if not node.linked else 1 if share < 0.25 else 2 if share < 0.75 else 3),
        ("size", 1 if node.words < 4 else 2 if node.words < 12 else 3 if node.words < 60 else 4),
    ]


#: Labels of nodes: wrappers hold whatever their children are, content and boilerplate pass their label on.
WRAPPER, CONTENT, BOILER = range(3)
STATES = (WRAPPER, CONTENT, BOILER)


def scaled(xs: list[float]) -> list[float]:
    total = sum(xs)
    return [x / total for x in xs]


@dataclass
class PageModel:
    edge: dict[str, list[list[float]]]  # by kind of child: P(child's label | parent's label)
    emit: dict[tuple, list[float]]  # P(feature | label), unseen values by ("tag", None) etc.

    def potentials(self, nodes: list[Node]) -> list[list[float]]:
        """How each node's features speak for its labels. Of k nodes alike, by the features of all that they stand in, together
        as much as 1 + ln k of one: a hundred equal buttons are hardly more evidence than one."""
        told, chain, known = [], [], {}
        for node in nodes:
            told.append(tuple(features(node)))
            chain.append(known.setdefault((chain[node.parent] if node.parent >= 0 else -1, told[-1]), len(known)))
        alike, seen, found = Counter(chain), {}, []
        for own, c in zip(told, chain, strict=True):
            if (own, alike[c]) not in seen:
                p, w = [1.0] * 3, (1 + math.log(alike[c])) / alike[c]
                for f in own:
                    # A word that no labelled page has says nothing.
                    e = self.emit.get(f) or (None if f[0] == "name" else self.emit[(f[0], None)])
                    if e:
                        p = scaled([x * y**w for x, y in zip(p, e)])
                seen[own, alike[c]] = p
            found.append(seen[own, alike[c]])
        return found

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node: messages from leaves to the root, a wrapper, then from the root to leaves."""
        below, sent = self.potentials(nodes), [[1.0] * 3] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            b, t, up = below[i], self.edge[kind(nodes[i])], nodes[i].parent
            sent[i] = m = [row[0] * b[0] + row[1] * b[1] + row[2] * b[2] for row in t]
            below[up] = scaled([x * y for x, y in zip(below[up], m)])
        belief = [[1.0, 0.0, 0.0]]
        for i in range(1, len(nodes)):
            b, t, m, p = below[i], self.edge[kind(nodes[i])], sent[i], belief[nodes[i].parent]
            c = [x / y for x, y in zip(p, m)]
            belief.append(scaled([b[y] * (c[0] * t[0][y] + c[1] * t[1][y] + c[2] * t[2][y]) for y in STATES]))
        return [x[CONTENT] for x in belief]


def kind(node: Node) -> str:
    """What sort of child: one whose tag or names say something of their own, or a part of its parent."""
    if node.names or node.tag in SPEAKING:
        return "marked"
    if node.tag in INLINE or node.tag in RAW:
        return "inline"
    return "div" if node.tag == "div" else "part"


def train(pages: list[str], smooth: float = 0.2, doubt: float = 0.001) -> PageModel:
    """Counts over labelled pages: data-y="1" marks content and "0" boilerplate, inherited until marked anew; what is not marked is a wrapper.

    `doubt` is the share of every chance that is given to what labelled pages don't show, so that no single feature and no
    single child decides alone.
    """
    emits, totals = Counter(), [0, 0, 0]
    edges = {k: [[smooth] * 3 for _ in STATES] for k in ("inline", "part", "div", "marked")}
    for page in pages:
        nodes, _ = parse(page)
        nodes[0].label = WRAPPER
        for node in nodes[1:]:
            node.label = nodes[node.parent].label if node.label is None else CONTENT if node.label == 1 else BOILER
            edges[kind(node)][nodes[node.parent].label][node.label] += 1
        for node in nodes:
            totals[node.label] += node.words > 0
            emits.update((f, node.label) for f in features(node))
    known = {f for f, _ in emits}
    values = Counter(f[0] for f in known)
    def chance(f: tuple) -> list[float]:
        own = [(emits[(f, y)] + smooth) / (totals[y] + smooth * (values[f[0]] + 1)) for y in STATES]
        return [(1 - doubt) * x + doubt * max(own) for x in own]

    return PageModel({k: [[(1 - doubt) * x + doubt / 3 for x in scaled(row)] for row in t] for k, t in edges.items()}, {f: chance(f) for f in known} | {(name, None): chance((name, None)) for name in values})


def labelled_pages(count: int = 400, seed: int = 11) -> list[str]:
    """Labelled pages to learn from: articles in many containers, amid menus, headers, notices, adverts, forms, sidebars, comments and footers."""
    rng = random.Random(seed)
    words = "the of and lake stone river sun walks over under small bright news old tree garden city light moves".split()
    say = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/{rng.randrange(99)}">{say(a, b)}</a>'
    pick = rng.choice

    def inline() -> str:
        t = say(4, 40)
        return pick([t, t, f"{t} {link()} {say(2, 15)}", f"<b>{say(1, 6)}</b> {t}", f"{t} <em>{say(1, 4)}</em> {say(1, 9)}", f"<b>{t}<br>", f"{t}<br>{say(3, 20)}", f"<span>{t}</span>", say(1, 4) + "."])

    def block() -> str:
        return pick([
            lambda: f"<p>{inline()}</p>", lambda: f"<p>{inline()}</p>", lambda: f"<p>{inline()}", lambda: f"<p>{inline()}</p>", lambda: f"<h2>{say(1, 8)}</h2>", lambda: f"<h3>{say(1, 5)}</h3>",
            lambda: "<ul>" + "".join(f"<li>{say(3, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", lambda: "<ol>" + "".join(f"<li>{say(2, 9)}" for _ in range(3)) + "</ol>",
            lambda: f"<blockquote><p>{inline()}</p></blockquote>", lambda: f"<pre><code>{say(3, 15)}</code></pre>", lambda: f"<div>{inline()}</div>", lambda: f"<section><h2>{say(1, 6)}</h2><p>{inline()}</p></section>",
            lambda: f"<p>{link(1, 5)}</p>", lambda: f"<p>{link(2, 8)} {link(1, 4)}</p>", lambda: f"<hr><p>{inline()}</p>", lambda: f"<script>{say(1, 9)}</script><p>{inline()}</p>", lambda: f"<details><summary>{say(1, 5)}</summary><p>{inline()}</p></details>",
            lambda: f"<button data-y=0>{say(1, 2)}</button>" * rng.choice([1, 1, 3, 9]) + f"<p>{inline()}</p>", lambda: f"<form data-y=0><label>{say(1, 3)}</label><input><button>{say(1, 2)}</button></form>",
            lambda: "<table>" + "".join(f"<tr><td>{say(1, 4)}</td><td>{say(1, 6)}</td></tr>" for _ in range(3)) + "</table>", lambda: f"<figure><img src=x><figcaption>{say(2, 9)}</figcaption></figure>",
        ])()

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
        return pick([f"<nav data-y=0><ul>{items}</ul></nav>", f'<div data-y=0 class="menu"><ul>{items}</ul></div>', f'<ul data-y=0 id="nav">{items}</ul>', f"<div data-y=0><ul>{items}</ul></div>", f'<div data-y=0 class="breadcrumbs">{link()} &gt; {link()}</div>', f"<nav data-y=0>{link()} {link()} {link()}</nav>"])

    def header() -> str:
        return pick([f"<header data-y=0><h1>{say(1, 3)}</h1><p>{say(2, 8)}</p></header>", f'<div data-y=0 id="header"><p>{say(1, 9)}</p></div>', f'<div data-y=0 class="masthead">{link()}</div>', f"<header data-y=0>{link()}{menu()}</header>"])

    def aside() -> str:
        return pick([
            f"<aside data-y=0><h3>{say(1, 3)}</h3><ul><li>{link()}</li><li>{link(2, 9)}</li></ul></aside>", f'<div data-y=0 class="sidebar"><h3>{say(1, 3)}</h3><p>{say(5, 30)}</p></div>', f"<aside data-y=0><p>{say(5, 40)}</p></aside>",
            f'<div data-y=0 class="ad">{say(3, 30)}</div>', f'<div data-y=0 class="advert"><p>{say(3, 30)}</p></div>', f'<div data-y=0 class="sponsored">{link()} {say(2, 12)}</div>', f'<div data-y=0 id="banner">{say(2, 12)}</div>',
            f'<div data-y=0 class="cookie-notice"><p>{say(5, 25)}</p><button>{say(1, 2)}</button></div>', f'<div data-y=0 class="notice">{say(4, 25)}</div>', f'<div data-y=0 role="dialog" class="popup">{say(4, 25)}</div>',
            f'<form data-y=0 action="/s"><label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button><select><option>{say(1, 2)}<option>{say(1, 2)}</select></form>', f'<div data-y=0 class="newsletter"><form><p>{say(4, 14)}</p><input><button>{say(1, 2)}</button></form></div>',
            f'<div data-y=0 class="share">{link()} {link()}</div>', f'<div data-y=0 class="related"><h3>{say(1, 3)}</h3><ul><li>{link(3, 8)}</li><li>{link(3, 8)}</li></ul></div>',
        ])

    def comments() -> str:
        each = "".join(pick([f"<li><p>{say(3, 40)}</p></li>", f'<div class="comment"><p>{say(3, 40)}</p></div>', f"<article><p>{say(3, 40)}</p></article>"]) for _ in range(rng.randint(1, 4)))
        return pick([f'<section data-y=0 id="comments"><h2>{say(1, 2)}</h2>{each}</section>', f'<div data-y=0 class="comments">{each}</div>', f'<ol data-y=0 class="comment-list">{each}</ol>'])

    def footer() -> str:
        return pick([f"<footer data-y=0>&copy; {say(1, 20)}</footer>", f"<footer data-y=0><p>{say(3, 25)}</p>{menu()}</footer>", f'<div data-y=0 id="footer"><p>{say(3, 20)}</p></div>', f'<div data-y=0 class="copyright">{say(2, 9)}</div>'])

    pages = []
    for _ in range(count):
        head = pick(["", f"<h1>{say(2, 12)}</h1>", f"<h1>{say(2, 12)}</h1>"])
        body = head + "".join(block() for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.2:
            body += pick([menu, aside])() + block()
        main = pick([f"<article data-y=1>{body}</article>", f"<article data-y=1>{body}</article>", f"<main data-y=1>{body}</main>", f"<main data-y=1><article>{body}</article></main>", f'<div data-y=1 class="content">{body}</div>', f'<div data-y=1 id="post">{body}</div>', f'<div data-y=1 class="entry-content">{body}</div>', f'<div data-y=1><div class="story">{body}</div></div>', f"<div data-y=1>{body}</div>", f"<section data-y=1>{body}</section>"])
        before = "".join(pick([menu, header, aside])() for _ in range(rng.randint(0, 3)))
        after = "".join(pick([comments, comments, aside, footer])() for _ in range(rng.randint(0, 3)))
        wrap = pick(["{}", "{}", "<div>{}</div>", "<div><div>{}</div></div>", '<div id="page"><div class="wrapper">{}</div></div>'])
        pages.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{say(1, 9)}</title><style>p{{}}</style></head><body>{wrap.format(before + main + after)}{pick(['', footer()])}</body></html>")
    return pages


def main_text(model: PageModel, page: str | None) -> str:
    """Blocks of content nodes in page order, one per line."""
    if not page:
        return ""
    nodes, runs = parse(page)
    content = model.marginals(nodes)
    blocks, open_ = [], []
    for i, piece in [*runs, (-1, "")]:
        if i >= 0:
            if content[i] > 0.5:
                open_.append(piece)
        elif open_:
            blocks.append(" ".join(entities.unescape("".join(open_)).split()))
            open_ = []
    return "\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, model: PageModel | None = None, html_col: str = "html") -> DataFrame:
    """pages with `text`: the main text of each whole page, whatever its length.

    Each page is parsed and solved alone, with messages over its own tree: no shuffle. Null or empty
    html, and pages without content, give empty text. Broken markup is read as far as it goes: end
    tags without start are skipped, open elements end with their container. Repeated rows agree.
    """
    modest_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))

    @pandas_udf("string")
    def text_of(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(shared.value, h) for h in htmls], dtype=object)

    return pages.select(*[c for c in pages.columns if c != "text"], text_of(F.col(html_col)).alias("text"))


def op8_page_text(spark, sf_dir: str) -> DataFrame:
    found = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
