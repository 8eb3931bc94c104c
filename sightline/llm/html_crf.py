"""Main text of web pages by a linear-chain conditional random field.

The chain is a page's leaf blocks in page order: runs of text between block-level tags.
Features are the ancestors' tags and the words of their class, id and role, the nearest
ones twice, and the text's own looks (length, links, punctuation, digits). Weights are
trained by stochastic gradient on the log likelihood over labelled pages; labels are
decoded by Viterbi. The labelled pages are made here by rule (`labelled_page`: many
layouts, PAGES of them by default); `train` takes any others.

White space, no-break spaces too, becomes one space inside a block; <br> is white space.
Scripts, styles, templates, titles, embedded pages, comments and the head hold no text. As
in browsers, the head ends at <body>, at the first tag that can't be in a head, or at
text; a script or style never closed takes the rest of the page; a title, text area or
embedded page never closed ends at the next tag, and a template never closed is no
template. Tags inside <svg> and <math> are inline; whether their text, that of <noscript> or
of <object> is main text is for the field to say. Unclosed tags are closed as browsers do
for paragraphs, list items and cells; a stray `<` is text; a tag ends at the first `>`
outside quotes, or, if the quotes are never closed, at the first `>`. Numeric references
without a character become U+FFFD.

Reading a page takes time in proportion to its length: open elements are indexed by tag,
path features are summed along the tree once, and quotes are paired once a page. Null and
empty html give the empty text, and so do pages without a main block, unless text stands in
the body by itself, which is then taken. A page is parsed and decoded
whole, in one row, a very long one too; rows that repeat are decoded alike; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

PAGES, ROUNDS, RATE, L2 = 500, 6, 0.2, 1e-4
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_EVEN = re.compile(r"[^\"']*+(?:\"[^\"]*+\"[^\"']*+|'[^']*+'[^\"']*+)*+")
_ATTR = re.compile(r"\b(class|id|role|data-main)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$")
_FAR = re.compile(r"&#(?:0*[0-9]{8,}|[xX]0*[0-9a-fA-F]{7,});?")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark math nobr object picture q rp rt ruby s samp small source span strike strong sub sup svg time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is read up to their end tag, without tags in it; SILENT ones of them hold no text.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_SILENT = frozenset("script style title iframe noembed noframes".split())
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option", "p")}
_SCOPE = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table tbody ul".split())
_PLAIN = _INLINE | frozenset("html body p h1 h2 h3 h4 h5 h6 pre blockquote div".split())
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in [*_RAW, "template"]}


class Node:
    """An open element: its names as features, the two nearest that shape the page, its mark."""

    __slots__ = ("tag", "names", "near", "up", "mark", "sums")

    def __init__(self, tag, words, mark, up):
        self.tag, self.up, self.sums = tag, up, None
        self.mark = mark if mark is not None else up.mark if up else None
        before = up.near if up else ()
        if tag in ("html", "body") or tag in _INLINE:
            self.names, self.near = (), before
        else:
            self.names = (f"in:{tag}", *[f"name:{w}" for w in words])
            self.near = (tuple(["near" + n.removeprefix("in").removeprefix("name") if n.startswith("in:") else "near-" + n for n in self.names]), *before[:1])


class Block:
    __slots__ = ("text", "node", "linked", "main")

    def __init__(self, text, node, linked, main):
        self.text, self.node, self.linked, self.main = text, node, linked, main


def _decoded(raw: str) -> str:
    if "&" not in raw:
        return raw
    return entities.unescape(_FAR.sub("\ufffd", raw) if "&#" in raw else raw)


class _Tags:
    """Where the tags of a page end."""

    def __init__(self, page: str):
        self.page, self.next, self.marks, self.ends = page, -1, None, None

    def end(self, lt: int) -> int:
        """The place of the > that ends the tag at lt; -1 if there is none."""
        if self.next < lt and self.next != len(self.page):
            self.next = self.page.find(">", lt)
            if self.next < 0:
                self.next = len(self.page)
        if self.next == len(self.page):
            return -1
        inside = self.page[lt : self.next]
        if ('"' not in inside and "'" not in inside) or _EVEN.fullmatch(inside):
            return self.next
        if self.ends is None:  # from the right: where a tag ends that goes on outside quotes at a mark
            self.marks = [m.start() for m in re.finditer(r"[\"'>]", self.page)]
            self.ends, later = [-1] * (len(self.marks) + 1), {}
            for i in range(len(self.marks) - 1, -1, -1):
                c = self.page[self.marks[i]]
                if c == ">":
                    self.ends[i] = self.marks[i]
                else:
                    if c in later:
                        self.ends[i] = self.ends[later[c] + 1]
                    later[c] = i
        far = self.ends[bisect_left(self.marks, lt)]
        return far if far >= 0 else self.next


class _Open:
    """The open elements, with the places of each tag."""

    def __init__(self):
        self.stack: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.solid: list[int] = []
        self.scopes: list[int] = []

    def top(self) -> Node | None:
        return self.stack[-1] if self.stack else None

    def count(self, tag: str) -> int:
        return len(self.at.get(tag, ()))

    def push(self, node: Node) -> None:
        i = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(i)
        if node.tag not in _INLINE:
            self.solid.append(i)
        if node.tag in _SCOPE:
            self.scopes.append(i)

    def cut(self, i: int) -> None:
        """Closes all from place i on."""
        while len(self.stack) > i:
            self.at[self.stack.pop().tag].pop()
        for places in (self.solid, self.scopes):
            while places and places[-1] >= i:
                places.pop()

    def close(self, tag: str) -> None:
        places = self.at.get(tag)
        if places and not (tag in _INLINE and self.solid and self.solid[-1] > places[-1]):
            self.cut(places[-1])

    def make_room(self, tag: str) -> None:
        """Closes what a block-level tag closes, inside the nearest element that holds blocks."""
        scope = self.scopes[-1] if self.scopes else -1
        found = []
        for t in _CLOSES.get(tag, ("p",)):
            places = self.at.get(t)
            if places and places[-1] > scope:
                found.append(places[bisect_right(places, scope)])
        if found:
            self.cut(min(found))


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    held: list[tuple[str, bool]] = []
    open_, tags, endless = _Open(), _Tags(page), set()

    def flush():
        if held:
            text = " ".join("".join([t for t, _ in held]).split())
            if text:
                node = open_.top()
                linked = sum(len(t.strip()) for t, a in held if a)
                out.append(Block(text, node, linked / len(text), node.mark == "1" if node and node.mark is not None else None))
            held.clear()

    def hear(raw):
        if not raw or open_.count("template"):
            return
        if open_.count("head"):
            if raw.isspace():
                return
            open_.close("head")
        held.append((_decoded(raw), open_.count("a") > 0))

    def end_of(tag, at):
        if tag not in endless:
            if m := _ENDS[tag].search(page, at):
                return m.start()
            endless.add(tag)
        return -1

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            hear(page[at:])
            break
        if lt > at:
            hear(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt)
        end = tags.end(lt) if m else -1
        if end < 0:
            hear("<")
            at = lt + 1
            continue
        at, tag, rest = end + 1, m[2].lower(), page[m.end() : end]
        if tag == "br":
            hear(" ")
            continue
        inline = tag in _INLINE or open_.count("svg") > 0 or open_.count("math") > 0
        if m[1]:
            if not inline:
                flush()
            open_.close(tag)
            continue
        if tag not in _HEAD and open_.count("head") and not open_.count("template"):
            open_.close("head")
        if not inline:
            flush()
            open_.make_room(tag)
        if tag in _RAW:
            end = end_of(tag, at)
            if tag in ("script", "style"):
                at = n if end < 0 else end
                continue
            end = end if end >= 0 else page.find("<", at)
            end = n if end < 0 else end
            if tag not in _SILENT:
                open_.push(Node(tag, (), None, open_.top()))
                hear(page[at:end])
                flush()
                open_.close(tag)
            at = end
            continue
        if tag in _VOID or _EMPTY.search(rest) or (tag == "template" and end_of(tag, at) < 0):
            continue
        attrs = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(rest)} if "=" in rest else {}
        words = tuple(dict.fromkeys(w for k in ("class", "id", "role") if k in attrs for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs[k]).lower())))
        open_.push(Node(tag, words, attrs.get("data-main"), open_.top()))
    flush()
    return out


def looks(found: list[Block], i: int) -> list[str]:
    """The features of a block besides its path: its nearest elements and its text."""
    b = found[i]
    n, near = len(b.text.split()), b.node.near if b.node else ()
    f = ["bias", *dict.fromkeys(x for names in near for x in names)]
    f += ["alone"] * (len(near) < 2)
    f.append("words:" + ("1" if n < 2 else "4" if n < 5 else "12" if n < 13 else "30" if n < 31 else "more"))
    f.append("links:" + ("none" if b.linked == 0 else "some" if b.linked < 0.5 else "most"))
    f.append("ends:" + ("stop" if b.text[-1] in ".!?…:;\"'”»" else "open"))
    return f + ["first"] * (i == 0) + ["last"] * (i == len(found) - 1) + ["copyright"] * ("©" in b.text) + ["digits"] * (sum(c.isdigit() for c in b.text) * 4 > len(b.text))


def features(found: list[Block]) -> list[list[str]]:
    """All features of each block, the names along its path each once."""
    out = []
    for i, b in enumerate(found):
        names, node = {}, b.node
        while node:
            names.update(dict.fromkeys(node.names))
            node = node.up
        out.append([*looks(found, i), *names])
    return out


def _sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Crf:
    """Two labels (0 aside, 1 main); weights by feature, moves[a][b] between labels, ends by the page's first and last label."""

    def __init__(self):
        self.weights: dict[str, list[float]] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0]]
        self.start = [0.0, 0.0]

    def scores(self, page: list[list[str]]) -> list[list[float]]:
        none, out = (0.0, 0.0), []
        for names in page:
            rows = [self.weights.get(x, none) for x in names]
            out.append([sum(r[0] for r in rows), sum(r[1] for r in rows)])
        return out

    def path_score(self, node: Node | None) -> tuple[float, float, frozenset]:
        """The weights of the names along a path, each once, and which of them are known;
        kept at the node, so that a page's tree is summed once."""
        todo = []
        while node and node.sums is None:
            todo.append(node)
            node = node.up
        got = node.sums if node else (0.0, 0.0, frozenset())
        for x in reversed(todo):
            new = [k for k in dict.fromkeys(x.names) if k in self.weights and k not in got[2]]
            if new:
                rows = [self.weights[k] for k in new]
                got = (got[0] + sum(r[0] for r in rows), got[1] + sum(r[1] for r in rows), got[2].union(new))
            x.sums = got
        return got

    def labels(self, found: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks, parsed for this field."""
        near, s = self.scores([looks(found, i) for i in range(len(found))]), []
        for b, (x, y) in zip(found, near, strict=True):
            u, v, _ = self.path_score(b.node)
            s.append([x + u, y + v])
        return self.viterbi(s)

    def decode(self, page: list[list[str]]) -> list[int]:
        return self.viterbi(self.scores(page))

    def viterbi(self, s: list[list[float]]) -> list[int]:
        """The likeliest labels of blocks with these scores."""
        if not s:
            return []
        back = []
        best = [self.start[y] + s[0][y] for y in (0, 1)]
        for now in s[1:]:
            come = [[best[a] + self.moves[a][b] for a in (0, 1)] for b in (0, 1)]
            back.append([0 if c[0] >= c[1] else 1 for c in come])
            best = [max(come[b]) + now[b] for b in (0, 1)]
        out = [0 if best[0] >= best[1] else 1]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]

    def step(self, page: list[list[str]], labels: list[int], rate: float, l2: float) -> None:
        """One step up the gradient of the page's log likelihood (forward and backward sums)."""
        if not page:
            return
        s, n, m = self.scores(page), len(page), self.moves
        ahead = [[self.start[y] + s[0][y] for y in (0, 1)]]
        for now in s[1:]:
            p = ahead[-1]
            ahead.append([_sum(p[0] + m[0][b], p[1] + m[1][b]) + now[b] for b in (0, 1)])
        after = [[0.0, 0.0]]
        for now in reversed(s[1:]):
            q = after[-1]
            after.append([_sum(m[a][0] + now[0] + q[0], m[a][1] + now[1] + q[1]) for a in (0, 1)])
        after.reverse()
        z = _sum(*ahead[-1])
        pull = [[math.exp(min(0.0, ahead[i][y] + after[i][y] - z)) for y in (0, 1)] for i in range(n)]
        moved = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(1, n):
            for a in (0, 1):
                for b in (0, 1):
                    moved[a][b] -= math.exp(min(0.0, ahead[i - 1][a] + m[a][b] + s[i][b] + after[i][b] - z))
            moved[labels[i - 1]][labels[i]] += 1
        for a in (0, 1):
            self.start[a] += rate * ((labels[0] == a) - pull[0][a])
            for b in (0, 1):
                m[a][b] += rate * (moved[a][b] / n - l2 * m[a][b])
        for i, names in enumerate(page):
            d = rate * ((labels[i] == 1) - pull[i][1])
            if abs(d) < 1e-6:
                continue
            for x in names:
                w = self.weights.setdefault(x, [0.0, 0.0])
                w[0] -= d + rate * l2 * w[0]
                w[1] += d - rate * l2 * w[1]


def train(pages: Iterable[str], rounds: int = ROUNDS, rate: float = RATE, l2: float = L2, seed: int = 1) -> Crf:
    """A field trained on pages whose elements carry data-main="1" or "0"; the nearest
    mark counts, and blocks without one are aside."""
    data = []
    for page in pages:
        found = blocks(page)
        data.append((features(found), [int(bool(b.main)) for b in found]))
    crf, rng = Crf(), random.Random(seed)
    for k in range(rounds):
        rng.shuffle(data)
        for x, y in data:
            crf.step(x, y, rate / (1 + k), l2)
    return crf


def labelled_page(rng: random.Random) -> str:
    """A page of a layout drawn at random, with its labels."""
    word = lambda: "".join(rng.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it".split()) for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    text = lambda a=1, b=6: " ".join(some(2, 14).capitalize() + "." for _ in range(rng.randint(a, b)))
    pick = rng.choice
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    named = lambda names: f'{pick(("class", "class", "id"))}="{pick(("", "", pick(("main-", "site-", "page-", "top-", "the-", "box "))))}{pick(names.split())}{pick(("", "", "-inner", "-box", " clearfix"))}"'

    def aside(names: str, inner: str, tags: str = "div div section") -> str:
        tag = pick(tags.split())
        return f'<{tag} {named(names)} data-main="0">{inner}</{tag}>'

    items = lambda n: "<ul>" + "".join(f"<li>{link(some(1, 3))}</li>" for _ in range(rng.randint(2, n))) + "</ul>"
    loose = lambda: pick((f"<p>{text(1, 3)}</p>", text(1, 2), f"<p>{some(2, 8)}</p>", f"<h3>{some(1, 4)}</h3><p>{text(1, 2)}</p>", f"<p>{link(some(2, 6))}</p>"))
    ad = lambda: aside("ad ads advert advertisement banner promo sponsor sponsored adsense", loose())
    notice = lambda: aside("notice cookie cookies consent alert gdpr newsletter subscribe popup modal warning message", loose() + pick(("", f"<button>{some(1, 2)}</button>")))
    side = lambda: (f'<aside data-main="0">{loose()}{items(5)}</aside>' if rng.random() < 0.5 else aside("sidebar side widget related recommended popular trending rail", loose() + items(6)))
    form = lambda: f'<form data-main="0"><label>{some(1, 3)}</label><input name="q"><select><option>{word()}<option>{word()}</select><textarea>{some(1, 5)}</textarea><button>{word()}</button><p>{text(1, 1)}</p></form>'
    remark = lambda: f'<div class="{pick(("comment", "reply", "comment-body", "response"))}"><p>{some(1, 2)}</p><p>{text(1, 3)}</p></div>'
    remarks = lambda: aside("comments comment responses discussion replies disqus respond", f"<h3>{some(1, 3)}</h3>" + "".join(pick((remark(), f"<li><p>{text(1, 3)}</p></li>")) for _ in range(rng.randint(1, 5))))
    share = lambda: aside("share social tags breadcrumb breadcrumbs byline meta pagination pager author", pick((items(4), some(1, 4), loose())))
    nav = lambda: pick((f'<nav data-main="0">{items(8)}</nav>', aside("menu nav navbar navigation topbar links", items(8)), f'<nav data-main="0">{some(1, 6)}</nav>'))
    head = lambda: pick((f'<header data-main="0"><h1>{some(1, 3)}</h1><p>{text(1, 1)}</p></header>', aside("header masthead logo branding", f"<h2>{some(1, 3)}</h2>{loose()}"), f'<header data-main="0">{link(some(1, 2))}{items(4)}</header>'))
    foot = lambda: pick((f'<footer data-main="0">&copy; {some(1, 3)} &middot; {text(1, 1)}</footer>', f'<footer data-main="0">{items(5)}<p>{text(1, 2)}</p></footer>', aside("footer copyright legal bottom colophon", loose())))
    p = lambda: pick((f"<p>{text()}</p>",) * 6 + (f"<p>{some(1, 3)}.</p>", f"<p><b>{text(1, 2)}<br>", f"<p>{text(1, 2)} {link(some(1, 3))} {text(1, 2)}", f"<ul><li>{text(1, 1)}</li><li>{some(1, 6)}</li></ul>", f"<ol><li>{text(1, 2)}<li>{some(2, 5)}</ol>", f"<blockquote>{text(1, 3)}</blockquote>", f"<h2>{some(1, 7)}</h2>", f"<h3>{some(1, 7)}</h3>", f"<pre>{some(4, 20)}</pre>", f"<table><tr><td>{some(1, 4)}</td><td>{word()}</td></tr></table>", f"<figure><img src=x><figcaption>{some(2, 9)}</figcaption></figure>", f"<dl><dt>{some(1, 2)}<dd>{text(1, 1)}</dl>", f"<div>{text()}</div>"))
    alone = rng.random() < 0.15  # a page of little else than its article
    inside = "".join(pick((p,) * 12 + (ad, share, side, notice) * (not alone))() for _ in range(rng.randint(1, 4) if alone else rng.randint(2, 14)))
    title = f"<h1>{some(2, 9)}</h1>" if not alone or rng.random() < 0.5 else ""
    wrap = pick(("article", "article", "article", "main", "div", "div", "section", "body", "bare"))
    if wrap in ("div", "section"):
        body = f'<{wrap} {named("content post entry article story text body main")} data-main="1">{title}{inside}</{wrap}>'
    elif wrap == "body":
        body = f'<div data-main="1">{title}{inside}</div>'
    elif wrap == "bare":
        body = title + inside
    else:
        body = f'<{wrap} data-main="1">{title}{inside}{pick(("", "", remarks(), form()))}</{wrap}>'
    if rng.random() < 0.3 and wrap != "bare":
        body = f'<main data-main="0">{pick(("", share()))}{body.replace(" data-main=", " data-main=", 1)}{pick(("", side()))}</main>'
    off = lambda: f'<noscript data-main="0">{loose()}</noscript>'
    before = [x() for x in (nav, head, ad, notice, side, form, share) if rng.random() < 0.45] + [off()] * (rng.random() < 0.1)
    after = [x() for x in (remarks, side, ad, foot, form, notice, nav) if rng.random() < 0.45] + [foot()] * (rng.random() < 0.7)
    rng.shuffle(before)
    if alone:
        before, after = before[:1] * (rng.random() < 0.3), after[:1] * (rng.random() < 0.3)
    return f"<!DOCTYPE html><html><head><title>{some(1, 5)}</title><style>p{{}}</style></head><body{' data-main="1"' * (wrap == "bare")}>{''.join(before)}{body}{''.join(after)}</body></html>"


@functools.lru_cache(maxsize=4)
def fitted(pages: int = PAGES, seed: int = 11) -> Crf:
    """The field trained on `pages` labelled pages made by rule, once a process."""
    rng = random.Random(seed)
    return train(labelled_page(rng) for _ in range(pages))


def main_blocks(page: str | None, crf: Crf) -> list[str]:
    """The page's main blocks. Where the field finds none, those that stand in the body by
    themselves and aren't links."""
    found = blocks(page or "")
    labels = crf.labels(found)
    if not any(labels):
        labels = [int(b.linked < 0.5 and (not b.node or len(b.node.near) < 2 and not any(n.startswith("name:") for n in b.node.names) and b.node.tag in _PLAIN)) for b in found]
    return [b.text for b, y in zip(found, labels, strict=True) if y]


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; a map over rows, no shuffle."""
    sent = pages.sparkSession.sparkContext.broadcast(crf or fitted())  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(h, sent.value)) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
