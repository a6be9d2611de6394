"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that no kept node lies in a dropped one.

A page becomes a tree of its block elements, and of inline elements that have a class, id or role. Each node has
features of its subtree (text, link and tag density, sentence marks), its attribute tokens, its depth, its siblings
and its ancestors. The trees give each node the log odds of holding article text. One pass from the leaves up
then finds the most likely labelling among those where everything below a dropped node is dropped as well.

The model is trained here, on seeded pages that training_page() lays out with known labels: no page of the
corpus is needed, and the sample is bounded by its parameter.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.boosting import Trees, fit_trees
from tidewater.llm.common import map_texts

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What stands between a tag's name and its end, with quoted values that may hold the sign of the end.
INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# fixed values: how HTML defines its elements
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "canvas", "object", "textarea", "title", "select", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "button",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover",
}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"},
}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "blockquote"}
TAGS = {
    "nav": {"nav", "menu"}, "header": {"header"}, "footer": {"footer"}, "aside": {"aside", "dialog"}, "form": {"form", "fieldset", "button", "label"},
    "article": {"article", "main"}, "section": {"section", "div"}, "para": {"p", "blockquote", "pre", "address"},
    "heading": {"h1", "h2", "h3", "h4", "h5", "h6"}, "list": {"ul", "ol", "dl"}, "item": {"li", "dt", "dd"},
    "table": {"table", "tr", "td", "th", "tbody", "thead", "caption"}, "figure": {"figure", "figcaption", "details", "summary"},
}
#: Parts of class, id and role names, by what they usually name.
NAMES = {
    "nav": "nav menu breadcrumb crumb pagination pager toolbar skip toc tabs",
    "header": "header masthead banner topbar top-bar logo branding",
    "footer": "footer foot copyright colophon legal contentinfo",
    "side": "sidebar side aside complementary widget rail related recommend popular trending more-",
    "ad": "advert sponsor promo banner-ad adsense dfp outbrain taboola",
    "notice": "cookie consent notice alert gdpr modal popup overlay toast",
    "form": "form search login signup subscribe newsletter register",
    "comment": "comment reply replies disqus discussion respond feedback",
    "share": "share social follow tweet like-",
    "article": "article content post entry story main body text prose",
}
WHOLE = {"ad": {"ad", "ads", "adv"}, "side": {"more"}}
MARKS = re.compile(r"[.!?;,](?:\s|$)")


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of the tags of a page, and of comments and declarations, which
    have no name. The caller may send() the place from which to read on.

    A tag ends at the first > outside quotes or, if the rest of the page has none, at the first > at all; where no > is
    left, < is text. One pass: a place outside quotes from which no end was found is remembered, so that a start that
    can't be closed doesn't make the next one read the same rest again.
    """
    last = {c: source.rfind(c) for c in ">\"'"}
    endless: set[int] = set()

    def end_of(at: int) -> int:
        if not endless and (m := INSIDE.match(source, at)):
            return m.end()
        seen, place = [], at
        while place <= last[">"] and place not in endless:
            seen.append(place)
            m = STOP.search(source, place)
            if m[0] == ">":
                return m.end()
            if m.end() > last[m[0]]:
                break
            place = source.index(m[0], m.end()) + 1
        endless.update(seen)
        endless.add(place)
        return source.index(">", at) + 1

    at = 0
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if start > last[">"]:
            return
        closes = source.startswith("/", start + 1)
        name = NAME.match(source, start + 1 + closes)
        if name:
            at = end_of(name.end())
            jump = yield start, at, name[0].lower(), closes, source[name.end() : at - 1]
            if jump is not None:
                at = jump
                yield at, at, "", False, ""
        elif source[start + 1 : start + 2] in ("!", "?", "/"):
            at = source.index(">", start) + 1
            yield start, at, "", False, ""
        else:
            at = start + 1


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}", re.I)


class Page:
    """The tree of one page, in page order: parents come before their children.

    Reading takes time in proportion to the page, however it is nested: open elements are counted by tag within every
    block and within every scope, so that no search runs over elements that it doesn't close.
    """

    def __init__(self, source: str):
        self.tag, self.names, self.parent, self.depth, self.inline = ["body"], [""], [-1], [0], [False]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []  # (block node, [(node, text)])
        self.links: list[int] = [0]
        self._run: list[tuple[int, str]] = []
        self._stack: list[tuple[str, int]] = [("body", 0)]  # open elements with their nodes
        self._blocks = [0]  # places of block elements in the stack
        self._open_tags = Counter()  # all open elements
        self._inline = [Counter()]  # inline elements, by the innermost block around them
        self._scopes = [Counter()]  # block elements, by the innermost scope around them
        self._in_link = 0
        self._read(source)
        self._end_block()

    def _end_block(self) -> None:
        if any(t.strip() for _, t in self._run):
            self.blocks.append((self._run[0][0], self._run))
        self._run = []

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        node = self._stack[-1][1]
        self._run.append((node, text))
        if self._in_link:
            self.links[node] += len(text.strip())

    def _open(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        names = ""
        if attributes and "=" in attributes:
            names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).lower()
        if not inline:
            self._end_block()
            if self._in_link and tag in ("p", "div", "article", "section", "footer"):
                self._in_link = 0
            self._close_implied(tag)
        node = self._stack[-1][1]
        if not inline or names:
            self.tag.append(tag)
            self.names.append(names)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.inline.append(inline)
            self.links.append(0)
            node = len(self.tag) - 1
        self._push(tag, node)
        self._in_link += tag == "a"

    def _push(self, tag: str, node: int) -> None:
        self._open_tags[tag] += 1
        if tag in INLINE:
            self._inline[-1][tag] += 1
        else:
            self._blocks.append(len(self._stack))
            self._inline.append(Counter())
            self._scopes[-1][tag] += 1
            if tag in SCOPE:
                self._scopes.append(Counter())
        self._stack.append((tag, node))

    def _pop_to(self, at: int) -> bool:
        """Closes the elements from a place in the stack on; whether a link was one of them."""
        link = False
        while len(self._stack) > at:
            tag, _ = self._stack.pop()
            self._open_tags[tag] -= 1
            link |= tag == "a"
            if tag in INLINE:
                self._inline[-1][tag] -= 1
            else:
                self._blocks.pop()
                self._inline.pop()
                if tag in SCOPE:
                    self._scopes.pop()
                self._scopes[-1][tag] -= 1
        return link

    def _close_implied(self, tag: str) -> None:
        """Closes an open paragraph, and what else a block element ends, up to the scope around it."""
        implied = CLOSES.get(tag, set())
        level = len(self._blocks) - 1
        while level > 0 and (self._scopes[-1]["p"] > 0 or any(self._scopes[-1][t] > 0 for t in implied)):
            at = self._blocks[level]
            open_tag = self._stack[at][0]
            if open_tag == "p" or open_tag in implied:
                self._pop_to(at)
            elif open_tag in SCOPE or not implied:
                return
            level -= 1

    def _close(self, tag: str) -> None:
        held = self._inline[-1] if tag in INLINE else self._open_tags
        if not held[tag]:
            return
        at = len(self._stack) - 1
        while self._stack[at][0] != tag:
            at -= 1
        if tag not in INLINE:
            self._end_block()
        if self._pop_to(at) and self._in_link:
            self._in_link -= 1

    def _read(self, source: str) -> None:
        at, found = 0, tags(source)
        for start, end, tag, closes, attributes in found:
            if start > at:
                self._text(source[at:start])
            at = end
            if not tag:
                continue
            if closes:
                self._close(tag)
            elif tag in RAW:
                if attributes.endswith("/"):
                    continue
                m = _closing(tag).search(source, at)
                at = m.start() if m else len(source)
                found.send(at)
                if tag != "textarea" and tag != "select":
                    self._run.append((self._stack[-1][1], ""))
            elif tag == "br" or tag == "hr":
                self._end_block()
            elif tag in ("html", "body", "head"):
                continue
            elif tag not in VOID:
                self._open(tag, attributes)
                if attributes.endswith("/") and tag not in ("p", "div", "li"):
                    self._close(tag)
        if at < len(source):
            self._text(source[at:])

    def features(self) -> np.ndarray:
        """One row a node."""
        n = len(self.tag)
        own = np.zeros((n, 4))  # text, link text, sentence marks, blocks
        own[:, 1] = self.links
        for node, run in self.blocks:
            own[node, 3] += 1
            for at, text in run:
                own[at, 0] += len(text.strip())
                own[at, 2] += len(MARKS.findall(text))
        total, size, kids = own.copy(), np.ones(n), np.zeros(n)
        parent = np.array(self.parent)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            total[p] += total[i]
            size[p] += size[i]
            kids[p] += 1
        tags, names = _tag_table(), np.stack([_name_vector(x) for x in self.names])
        kinds = np.stack([tags.get(t, tags[""]) for t in self.tag])
        above = np.zeros((n, kinds.shape[1] + names.shape[1]))
        mine = np.concatenate([kinds, names], axis=1)
        order, same, seen = np.zeros(n), np.zeros(n), {}
        for i in range(1, n):
            p = parent[i]
            above[i] = np.maximum(above[p], mine[p])
            order[i] = seen.get(p, 0)
            seen[p] = order[i] + 1
            same[i] = seen[(p, self.tag[i])] = seen.get((p, self.tag[i]), 0) + 1
        text, links = total[:, 0], total[:, 1]
        up = np.maximum(parent, 0)
        stats = np.stack(
            [
                np.log1p(text), np.log1p(own[:, 0]), links / (text + 1), total[:, 2] / (text + 20) * 100, np.log1p(total[:, 3]),
                size / (text + 50) * 50, np.log1p(size), np.array(self.depth), order, order / np.maximum(kids[up], 1), kids[up],
                same, text / (text[up] + 1), text / (text[0] + 1), total[up, 2] / (text[up] + 20) * 100, links[up] / (text[up] + 1),
                np.array(self.inline, dtype=float), (text + 1) / (total[:, 3] + 1),
            ],
            axis=1,
        )
        return np.concatenate([stats, mine, above], axis=1)

    def text(self, keep: np.ndarray) -> str:
        """The kept blocks in page order, white space within a block as one space."""
        out = []
        for _, run in self.blocks:
            words = "".join(t for node, t in run if keep[node]).split()
            if words:
                out.append(" ".join(words))
        return " ".join(out)

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """The likeliest labels among those that keep no node below a dropped one; the body itself is kept."""
        n = len(self.tag)
        yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
        keep_value, drop_value = yes.copy(), no.copy()
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            keep_value[p] += max(keep_value[i], drop_value[i])
            drop_value[p] += drop_value[i]
        keep = np.zeros(n, dtype=bool)
        keep[0] = True
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and keep_value[i] > drop_value[i]
        return keep


@functools.cache
def _tag_table() -> dict[str, np.ndarray]:
    kinds = list(TAGS)
    table = {t: np.array([float(k == kind) for k in kinds]) for kind in kinds for t in TAGS[kind]}
    return table | {"": np.zeros(len(kinds))}


@functools.lru_cache(maxsize=20_000)
def _name_vector(names: str) -> np.ndarray:
    words = re.split(r"[\s_]+", names)
    pieces = {p for w in words for p in [w, *w.split("-")]}
    return np.array([float(any(k in w for k in NAMES[kind].split() for w in words) or bool(pieces & WHOLE.get(kind, set()))) for kind in NAMES])


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A laid-out page and the words of its article; every word of a training page is unlike any other."""
    count = iter(range(10**9))
    article: set[str] = set()

    def words(n: int, keep: bool, marks: bool = True) -> str:
        out = []
        for _ in range(n):
            word = "".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(rng.randint(1, 4))) + f"q{next(count)}z"
            if keep:
                article.add(word)
            out.append(word + (rng.choice([".", ",", ".", "!"]) if marks and rng.random() < 0.12 else ""))
        return " ".join(out) + ("." if marks and rng.random() < 0.8 else "")

    def tagged(tag: str, body: str, *names: str) -> str:
        attribute = ""
        if names and rng.random() < 0.85:
            attribute = f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'
        return f"<{tag}{attribute}>{body}</{tag}>"

    def links(n: int, keep: bool = False) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(rng.randint(1, 3), keep, False)}</a></li>' for _ in range(n)) + "</ul>"

    def short(keep: bool = False) -> str:
        return words(rng.randint(1, 25), keep)

    junk = {
        "nav": lambda: tagged(rng.choice(["nav", "nav", "div"]), links(rng.randint(2, 12)), "nav", "menu", "main-menu", "navbar", "breadcrumbs"),
        "header": lambda: tagged(rng.choice(["header", "div"]), tagged("h1", words(rng.randint(1, 4), False, False)) * (rng.random() < 0.4) + rng.choice([short(), links(3), tagged("p", short())]), "header", "site-header", "masthead"),
        "ad": lambda: tagged(rng.choice(["div", "div", "aside", "section"]), rng.choice([short(), tagged("p", short()), f'<a href="#">{short()}</a>']), "ad", "advert", "ads", "sponsored", "promo"),
        "side": lambda: tagged(rng.choice(["aside", "aside", "div"]), tagged("h3", words(2, False, False)) * (rng.random() < 0.7) + rng.choice([links(5), tagged("p", short()), short()]), "sidebar", "side", "widget", "related", "recommended"),
        "notice": lambda: tagged(rng.choice(["div", "section", "dialog"]), rng.choice([short(), tagged("p", short())]) + "<button>ok</button>" * (rng.random() < 0.5), "cookie-notice", "notice", "consent", "alert", "popup"),
        "form": lambda: tagged("form", f"<label>{words(2, False, False)}</label><input name=q>" + rng.choice(["", tagged("p", short())]) + f"<button>{words(1, False, False)}</button>", "search", "newsletter", "login"),
        "comments": lambda: tagged(rng.choice(["section", "div", "ol"]), "".join(tagged(rng.choice(["div", "article", "li"]), tagged("p", words(rng.randint(3, 60), False)), "comment", "reply") for _ in range(rng.randint(1, 6))), "comments", "comment-list", "replies"),
        "share": lambda: tagged("div", links(3), "share", "social"),
        "footer": lambda: tagged(rng.choice(["footer", "footer", "div"]), "&copy; " + short() + rng.choice(["", links(4), tagged("p", short())]), "footer", "site-footer", "copyright"),
    }

    def piece() -> str:
        kind = rng.random()
        if kind < 0.70:
            body = words(rng.choice([rng.randint(1, 6), rng.randint(10, 60), rng.randint(40, 200)]), True)
            body = f"<b>{body}</b>" if rng.random() < 0.1 else body
            return f"<p>{body}" + rng.choice(["</p>", "</p>", "<br></p>", ""])
        if kind < 0.80:
            return tagged(rng.choice(["h2", "h3"]), words(rng.randint(1, 8), True, False))
        if kind < 0.87:
            return tagged(rng.choice(["ul", "ol"]), "".join(f"<li>{words(rng.randint(1, 20), True)}</li>" for _ in range(rng.randint(1, 6))))
        if kind < 0.91:
            return tagged("blockquote", tagged("p", words(rng.randint(4, 40), True)))
        if kind < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(rng.randint(1, 4), True, False)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return rng.choice([tagged("pre", words(12, True, False)), "<figure><figcaption>" + words(8, True) + "</figcaption></figure>"])

    pieces = [tagged("h1", words(rng.randint(1, 12), True, False))] * (rng.random() < 0.85)
    pieces += [piece() for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 15]))]
    if len(pieces) < 2:
        pieces.append(f"<p>{words(rng.randint(1, 80), True)}</p>")
    for kind in ("ad", "share", "side", "form"):
        if rng.random() < 0.15:
            pieces.insert(rng.randint(1, len(pieces)), junk[kind]())
    if rng.random() < 0.08:  # bare paragraphs, with little or nothing around them
        pieces = pieces[: rng.randint(1, 3)]
        article = {w.strip(".,!") for w in re.sub("<[^>]*>", " ", "".join(pieces)).split()} & article
        main = "".join(pieces)
    else:
        main = tagged(rng.choice(["article", "article", "main", "div", "section"]), "".join(pieces), "article", "content", "post", "entry-content", "story")
    around = rng.choice([0.0, 0.2, 0.45, 0.45, 0.45])
    before = [junk[k]() for k in ("header", "nav", "notice", "ad", "form", "side") if rng.random() < around]
    after = [junk[k]() for k in ("share", "side", "ad", "comments", "form", "notice", "footer") if rng.random() < around * (1.8 if k == "footer" else 1)]
    rng.shuffle(before)
    body = "".join(before) + main + "".join(after)
    if rng.random() < 0.4:
        body = tagged("div", body, "wrapper", "page", "container")
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{body}</body></html>", article


@functools.cache
def fit_model(pages: int = 800, seed: int = 11) -> Trees:
    """Trees over the nodes of that many training pages. A node's label: whether its text, or most of it, is the article's."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source, article = training_page(rng)
        page = Page(source)
        got = np.zeros((len(page.tag), 2))
        for _, run in page.blocks:
            for node, text in run:
                found = [w.strip(".,!") in article for w in text.split()]
                got[node] += [sum(found), len(found) - sum(found)]
        below = got.copy()
        for i in range(len(page.tag) - 1, 0, -1):
            below[page.parent[i]] += below[i]
        has = below.sum(axis=1) > 0
        has[0] = False
        xs.append(page.features()[has])
        ys.append((below[has, 0] > 0).astype(float))
    return fit_trees(np.concatenate(xs), np.concatenate(ys), trees=60, depth=5)


def extract(sources: list[str | None], model: Trees) -> list[str]:
    pages = [Page(s or "") for s in sources]
    parts = [p.features() for p in pages]
    margins = model.margin(np.concatenate(parts)) if parts else np.zeros(0)
    out, at = [], 0
    for page, part in zip(pages, parts, strict=True):
        out.append(page.text(page.decode(margins[at : at + len(part)])))
        at += len(part)
    return out


def main_text(pages: DataFrame, *, training_pages: int = 800, seed: int = 11) -> DataFrame:
    """One row per input row: page_id, url, text (empty if the page has no article text or is null), n_chars.

    Pages are read whole, a slice of a batch at a time; nothing is shuffled. Markup that is never closed is read in one
    pass like any other. Repeated rows and null ids stay, an empty table gives no rows, other columns are not read.
    """
    model = fit_model(training_pages, seed)

    def of(sources: list[str]) -> list[list]:
        texts = extract(sources, model)
        return [texts, [len(t) for t in texts]]

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_texts(narrow, "html", "text string, n_chars long", of)
