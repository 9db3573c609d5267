"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Each block element gets features of itself (tag, depth, attribute tokens), its subtree (text, links, density), its
ancestors and siblings. The trees give log-odds of holding main text. Decoding takes the best set of nodes that has
every node's ancestors in it, so that no node inside a refused one is taken. Training pages are generated here.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .trees import Boosted, boost

#: Pages that training generates.
TRAINING_PAGES = 600

#: Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details summary dialog menu".split()
FURNITURE_TAGS = set("nav footer aside form fieldset menu dialog address button select template".split())
FURNITURE = set("ad ads adv advert advertisement banner breadcrumb breadcrumbs button caption comment comments cookie cookies consent copyright disqus footer form gdpr header hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice notices pagination popup promo promoted reader reply related replies rss search share sharing sidebar signup site social sponsor sponsored subscribe tags toolbar topbar widget alert respond discussion feedback".split())
#: Elements inside a line or a block: nodes that don't end a paragraph. Those of the other languages, and what ends these.
EMBEDDED = set("noscript template iframe object select button canvas video audio svg".split())
FOREIGN, HTML_INSIDE, MATH_TEXT = {"svg", "math"}, {"foreignobject", "desc", "annotation-xml"}, set("mi mo mn ms mtext".split())
BREAKOUT = (set(TAGS) | INLINE | VOID) - {"a", "font"}
CONTENT = set("article body content entry main post story text prose maincontent articlebody postcontent".split())

#: A quote opens a value only behind =, and only if it is closed. All repeats are possessive, so a match never goes back.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PARTS = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")
SHUT = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
NEXT = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in EMBEDDED}


class Page:
    """Block elements of a page in page order, and its texts: (node, text, is in a link)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.bad, self.good, self.hidden = [-1], [-1], [0], [0], [0], [0]
        self.n_tags = [0]
        self.texts: list[tuple[int, int, str, bool]] = []
        names, stack, links, at, block = ["html"], [0], 0, 0, 0
        # where each name is open, and which openings are or end a foreign language: no look back over all that is open
        where: dict[str, list[int]] = {"html": [0]}
        worlds: list[str] = []

        def push(name: str, node: int) -> None:
            where.setdefault(name, []).append(len(names))
            names.append(name)
            stack.append(node)
            if name in FOREIGN or name in HTML_INSIDE:
                worlds.append(name)

        def pop() -> str:
            name = names.pop()
            stack.pop()
            where[name].pop()
            if name in FOREIGN or name in HTML_INSIDE:
                worlds.pop()
            return name

        skip_to = 0
        unclosed: set[str] = set()
        for m in TOKEN.finditer(source):
            if m.start() < skip_to:
                continue
            if m.start() > at:
                self._text(stack[-1], block, source[at : m.start()], links > 0)
            at = m.end()
            name = m.group(2)
            if not name:
                continue
            name = name.lower()
            if m.group(1):
                if name == "a":
                    links = max(0, links - 1)
                elif name not in INLINE and name not in VOID:
                    # math is part of its line
                    math = where.get("math")
                    block += not (name == "math" or math and where.get(name) and where[name][-1] >= math[0])
                    if where.get(name):
                        while len(names) > 1 and pop() != name:
                            pass
                continue
            empty = m.group(3).endswith("/")
            if worlds and worlds[-1] in FOREIGN and name in BREAKOUT and names[-1] not in MATH_TEXT:
                # HTML in an svg or math that wasn't closed: it ends there
                while worlds and worlds[-1] in FOREIGN:
                    block += worlds[-1] == "svg"
                    while pop() not in FOREIGN:
                        pass
            foreign = worlds[-1] if worlds else None
            inside = foreign in FOREIGN
            if name in RAW:
                if inside and empty:
                    continue
                end = None if name in unclosed else SHUT[name].search(source, at)
                if not end:
                    unclosed.add(name)
                at = skip_to = end.end() if end else at if inside else len(source)
                continue
            if empty and (inside or name in FOREIGN):
                continue
            if inside and name not in INLINE and name not in VOID or name == "math":
                # elements of the other languages aren't nodes; their text belongs to the svg, or to what the math is in
                block += foreign == "svg" and name != "math"
                push(name, stack[-1])
                continue
            if name in VOID:
                if name == "br":
                    self.texts.append((stack[-1], block, " ", False))
                elif name == "hr":
                    block += 1
                self.n_tags[stack[-1]] += 1
                continue
            if name in INLINE:
                links += name == "a"
                self.n_tags[stack[-1]] += 1
                continue
            if name in EMBEDDED:
                # one without an end tag before the next of its kind holds nothing: what follows is the page's
                end = None if name in unclosed else NEXT[name].search(source, at)
                if not end:
                    unclosed.add(name)
                if not end or not end.group(1):
                    self.n_tags[stack[-1]] += 1
                    if name == "svg":
                        push(name, stack[-1])
                    continue
            block += 1
            if name not in EMBEDDED:
                links = 0
            if names[-1] == "p" and name not in EMBEDDED:
                pop()
            shuts = CLOSES.get(name)
            while shuts and len(names) > 1 and names[-1] in shuts:
                pop()
            if name == "body" and where.get("body") or name == "html":
                continue
            tokens = PARTS.findall(" ".join(v for _, v in ATTRIBUTE.findall(m.group(3))).lower()) if m.group(3) else ()
            self.tag.append(TAGS.index(name) if name in TAGS else len(TAGS))
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.bad.append(sum(t in FURNITURE for t in tokens) + (2 if name in FURNITURE_TAGS else 1 if name == "header" else 0))
            self.good.append(sum(t in CONTENT for t in tokens) + (2 if name in ("article", "main") else 0))
            self.hidden.append(1 if m.group(3) and HIDDEN.search(m.group(3)) else 0)
            self.n_tags.append(1)
            push(name, len(self.tag) - 1)
        if at < len(source):
            self._text(stack[-1], block, source[at:], links > 0)

    def _text(self, node: int, block: int, raw: str, link: bool) -> None:
        self.texts.append((node, block, html.unescape(raw) if "&" in raw else raw, link))

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, linked, sentences = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, _, text, link in self.texts:
            size = len(text.strip())
            own[node] += size
            if link:
                linked[node] += size
            sentences[node] += text.count(". ") + text.count(".\n") + text.rstrip().endswith(".")
        text, links, marks, tags, kids = own.copy(), linked.copy(), sentences.copy(), np.array(self.n_tags, float), np.zeros(n)
        parent = np.array(self.parent)
        above_bad, above_good = np.zeros(n), np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            text[p] += text[i]
            links[p] += links[i]
            marks[p] += marks[i]
            tags[p] += tags[i]
            kids[p] += 1
        same: dict[tuple[int, int], int] = {}
        place, alike, before = np.zeros(n), np.zeros(n), np.zeros(n)
        seen = np.zeros(n)
        for i in range(1, n):
            p = self.parent[i]
            above_bad[i] = max(above_bad[p], self.bad[p], 2 * self.hidden[p])
            above_good[i] = max(above_good[p], self.good[p])
            place[i] = same.get((p, -1), 0)
            same[p, -1] = place[i] + 1
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
            before[i] = seen[p]
            seen[p] += text[i]
        for i in range(1, n):
            alike[i] = same[self.parent[i], self.tag[i]]
        up = np.maximum(parent, 0)
        total = max(1.0, text[0])
        cols = [np.array(self.tag, float), np.array(self.depth, float), np.array(self.bad, float), np.array(self.good, float), np.array(self.hidden, float)]
        cols += [above_bad, above_good, np.log1p(text), np.log1p(own), links / np.maximum(text, 1), text / np.maximum(tags, 1), marks / np.maximum(tags, 1), kids]
        cols += [place, alike, text / np.maximum(text[up], 1), before / np.maximum(text[up], 1), text / total, (text[up] - text) / np.maximum(kids[up], 1)]
        return np.stack(cols, 1)

    def taken(self, log_odds: np.ndarray) -> np.ndarray:
        """The best set of nodes that holds every member's ancestors."""
        n = len(self.tag)
        best = log_odds.astype(float).copy()
        best[0] = max(best[0], 0.0)
        for i in range(n - 1, 0, -1):
            if best[i] > 0:
                best[self.parent[i]] += best[i]
        out = np.zeros(n, bool)
        out[0] = True
        for i in range(1, n):
            out[i] = out[self.parent[i]] and best[i] > 0
        return out

    def text(self, keep: np.ndarray) -> str:
        parts, last = [], None
        for node, block, text, _ in self.texts:
            if keep[node]:
                if block != last:
                    parts.append([])
                    last = block
                parts[-1].append(text)
        blocks = (BLANK.sub(" ", "".join(p)).strip() for p in parts)
        return " ".join(b for b in blocks if b)


def _made_page(r: random.Random) -> tuple[str, set[str]]:
    """A page of random furniture around an article, and the words of its article; every block has words of its own."""
    count = [0]
    main: set[str] = set()

    def words(n: int, keep: bool, stop: bool = True) -> str:
        out = []
        for _ in range(max(1, n)):
            count[0] += 1
            out.append(f"{'m' if keep else 'x'}{count[0]}{'q' * r.randint(0, 6)}")
        if keep:
            main.update(out)
        text = " ".join(w + ("." if stop and r.random() < 0.1 else "") for w in out)
        return text + ("." if stop else "")

    def link_list(n: int, size: int = 1) -> str:
        shape = r.choice(["<ul>{}</ul>", "<div>{}</div>", "{}"])
        item = r.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<span><a href='#'>{}</a></span> | "])
        return shape.format("".join(item.format(words(size, False, False)) for _ in range(n)))

    def tagged(names: list[str], inner: str, tags=("div", "section")) -> str:
        name = r.choice(names)
        return f"<{(t := r.choice(tags))} {r.choice(['class', 'id'])}=\"{name}{r.choice(['', '-box', ' wide', '-1'])}\">{inner}</{t}>"

    def furniture(kind: str) -> str:
        if kind == "nav":
            return r.choice([f"<nav>{link_list(r.randint(2, 12))}</nav>", tagged(["menu", "nav", "navbar", "breadcrumb"], link_list(r.randint(2, 10)), ("div", "ul"))])
        if kind == "header":
            return f"<header>{r.choice(['<h2>{}</h2>', '<p>{}</p>', '<div>{}</div>']).format(words(r.randint(1, 6), False, False))}{link_list(3) if r.random() < 0.5 else ''}</header>"
        if kind == "footer":
            inner = f"&copy; site &middot; {words(r.randint(3, 25), False)}"
            return r.choice([f"<footer>{inner}</footer>", f"<footer><p>{inner}</p>{link_list(3)}</footer>", tagged(["footer", "copyright", "legal"], f"<p>{inner}</p>")])
        if kind == "ad":
            return tagged(["ad", "ads", "advert", "promo", "sponsored", "banner"], r.choice(["{}", "<p>{}</p>"]).format(words(r.randint(3, 40), False)), ("div", "aside"))
        if kind == "aside":
            return r.choice([f"<aside><h3>{words(2, False, False)}</h3>{link_list(4, 4)}</aside>", f"<aside><p>{words(r.randint(5, 50), False)}</p></aside>", tagged(["sidebar", "related", "widget"], f"<h3>{words(2, False, False)}</h3>{link_list(5, 4)}")])
        if kind == "notice":
            return tagged(["cookie", "notice", "consent", "alert", "newsletter", "subscribe"], f"<p>{words(r.randint(5, 40), False)}</p><a href='#'>{words(1, False, False)}</a>")
        if kind == "form":
            return f"<form action='/s'><label>{words(2, False, False)}</label><input name='q'><p>{words(r.randint(1, 8), False)}</p></form>"
        entries = "".join(r.choice(["<li><p>{}</p></li>", "<div class='comment'><p>{}</p></div>", "<p>{}</p>"]).format(words(r.randint(3, 60), False)) for _ in range(r.randint(1, 6)))
        return tagged(["comments", "comment-list", "replies", "discussion"], f"<h3>{words(2, False, False)}</h3>{entries}", ("div", "section", "ol"))

    def paragraph() -> str:
        n = int(r.paretovariate(0.9) * 4) if r.random() < 0.5 else r.randint(10, 120)
        text = words(min(n, 300), True)
        if r.random() < 0.15:
            text = text.replace(" ", " <a href='/l'>", 1) + "</a>"
        kind = r.random()
        if kind < 0.8:
            return f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}"
        if kind < 0.85:
            return f"<p><b>{text}<br>"
        return r.choice(["<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<pre>{}</pre>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>"]).format(text)

    body = [paragraph() for _ in range(min(40, int(r.paretovariate(0.8))))]
    kinds = ["nav", "header", "footer", "ad", "aside", "notice", "form", "comments"]
    if r.random() < 0.3:
        body.insert(r.randint(0, len(body)), furniture(r.choice(["ad", "notice", "form", "aside"])))
    heading = r.choice(["<h1>{}</h1>", "<h1><a href='/t'>{}</a></h1>", ""]).format(words(r.randint(2, 12), True, False))
    inner = heading + "".join(body)
    main_part = r.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<div id='main'><div class='post entry'>{}</div></div>", "<section class='article-body'>{}</section>", "<div>{}</div>"]).format(inner)
    top = [furniture(k) for k in r.sample(["nav", "header", "ad", "notice", "form", "aside"], r.randint(0, 4))]
    bottom = [furniture(k) for k in r.sample(kinds[2:], r.randint(0, 5))]
    whole = "".join([*top, main_part, *bottom])
    if r.random() < 0.3:
        whole = f"<div class='{r.choice(['page', 'wrapper', 'container', 'site'])}'>{whole}</div>"
    return f"<html><head><title>t</title></head><body>{whole}</body></html>", main


@lru_cache(maxsize=2)
def train(pages: int = TRAINING_PAGES, seed: int = 11) -> Boosted:
    """Boosted trees fitted to the nodes of generated pages: label 1 for nodes with main text in their subtree."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source, main = _made_page(r)
        page = Page(source)
        label = np.zeros(len(page.tag))
        for node, _, text, _ in page.texts:
            if any(w.rstrip(".") in main for w in text.split()):
                while node > 0 and not label[node]:
                    label[node] = 1
                    node = page.parent[node]
        x = page.features()
        xs.append(x[1:])
        ys.append(label[1:])
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract(source: str | None, model: Boosted) -> str:
    page = Page(source or "")
    return page.text(page.taken(model.raw(page.features())))


def main_text(pages: DataFrame, html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """(row, text) for every row: all columns in `row`, the page's main text in `text`.

    Null and empty pages give the empty string, as do pages of which no node is taken. Bytes without any tag are the
    text of the page. Repeated rows each come back.
    """
    small_batches(pages.sparkSession)
    rows, column = pages.select(F.struct("*").alias("row")), pages.columns.index(html_col)
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    schema = rows.select("row", F.lit("").alias("text")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            parsed = [Page(x or "") for x in pc.struct_field(batch.column(0), [column]).to_pylist()]
            features = [p.features() for p in parsed]
            odds = fitted.raw(np.concatenate(features)) if features else np.empty(0)
            out, at = [], 0
            for page, x in zip(parsed, features, strict=True):
                out.append(page.text(page.taken(odds[at : at + len(x)])))
                at += len(x)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    return rows.mapInArrow(read, schema)
