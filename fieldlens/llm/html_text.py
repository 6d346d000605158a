"""HTML extraction with a tree-structured graphical model.

Block elements of a page and its runs of text are the nodes of a tree; each is content or not. Node
potentials are log-linear in what the node looks like, parent-child potentials in the pair of labels
and the child's kind. Sum-product messages upward and downward give each node's content marginal, and
the runs of text above one half are the main text. Weights come from the exact gradient of the
likelihood of labelled pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of HTML elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset(("script", "style"))
RAW = frozenset("script style noscript template iframe textarea title svg math object select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl div article section aside nav main body form header footer blockquote".split())
#: What words in class, id and role names tell.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising banner promo promoted sponsor sponsored sponsors",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header masthead topbar logo branding site",
    "side": "sidebar side aside related recommended trending popular widget widgets more complementary",
    "talk": "comment comments reply replies respond disqus discussion reader readers feedback thread",
    "note": "cookie cookies consent notice notices popup modal overlay newsletter subscribe signup gdpr alert paywall toast",
    "share": "share sharing social tools toolbar meta byline tags tag login search form",
    "main": "article content main post entry story text body prose copy",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z""", re.S)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Nodes in page order, parents before children. Text nodes have a text and no children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    hints: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)

    def add(self, parent: int, tag: str, hints: tuple[str, ...] = (), text: str | None = None, linked: float = 0.0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hints.append(hints)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def _hints(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    found = {HINT_OF[w] for m in NAMED.findall(attrs) for w in WORD.findall(m.lower()) if w in HINT_OF}
    if "hidden" in attrs.lower() and re.search(r"""(?:^|[\s"'])hidden(?:$|[\s"'=])|aria-hidden\s*=\s*["']?true""", attrs, re.I):
        found.add("hidden")
    return tuple(sorted(found))


def parse(page: str | None) -> Tree:
    """The page's tree. Markup that is cut off at the end, comments and raw elements leave no text.

    A raw element without an end is passed over, and what follows is read; only a script or a style goes
    on to the end of the page.
    """
    page = page or ""
    tree = Tree()
    stack = [tree.add(-1, "page")]  # open blocks
    names = ["page"]
    inline: list[str] = []  # open inline elements of the innermost block
    run: list[tuple[str, bool]] = []  # pieces of text, and if they are linked
    in_link = 0

    def flush() -> None:
        if run:
            whole = " ".join("".join(x for x, _ in run).split())
            if whole:
                links = sum(len(x.strip()) for x, linked in run if linked)
                tree.add(stack[-1], "#text", (), whole, links / len(whole))
            run.clear()

    def close(upto: int) -> None:
        flush()
        del stack[upto:], names[upto:]

    def say(x: str) -> None:
        run.append((html.unescape(x), in_link > 0))

    at = 0
    end = len(page)
    open_ended: set[str] = set()  # raw elements without an end from here on
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if not (m[1] or m[4]):
            attrs = m[3] or m[6] or ""
            if name in RAW:
                if not attrs.rstrip().endswith("/") and name not in open_ended:
                    stop = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*>", re.I).search(page, at)
                    if stop:
                        at = stop.end()
                    elif name in UNREAD:
                        break
                    else:
                        open_ended.add(name)
                continue
            if name == "br" or name == "wbr":
                run.append((" " if name == "br" else "", False))
                continue
            if name in INLINE:
                inline.append(name)
                in_link += name == "a"
                continue
            flush()
            if name in VOID:
                continue
            if name in CLOSES_P and "p" in names:
                k = len(names) - 1 - names[::-1].index("p")
                if not any(x in SCOPE for x in names[k + 1 :]):
                    close(k)
            for other in SAME_CLOSE.get(name, ()):
                k = len(names) - 1
                while k > 0 and names[k] != other and names[k] not in SCOPE:
                    k -= 1
                if k > 0 and names[k] == other:
                    close(k)
            inline.clear()
            in_link = 0
            stack.append(tree.add(stack[-1], name, _hints(attrs)))
            names.append(name)
        elif name in INLINE:
            if name in inline:
                k = len(inline) - 1 - inline[::-1].index(name)
                del inline[k]
                in_link -= name == "a"
        elif name in names[1:]:
            k = len(names) - 1 - names[::-1].index(name)
            close(k)
            inline.clear()
            in_link = 0
    flush()
    return tree


def _size(n: int) -> str:
    return "0" if n < 25 else "1" if n < 60 else "2" if n < 120 else "3" if n < 300 else "4"


def describe(tree: Tree, i: int) -> list[str]:
    """Names of a node's features."""
    text = tree.text[i]
    if text is None:
        return ["bias", f"tag:{tree.tag[i]}", *(f"hint:{h}" for h in tree.hints[i])]
    link = tree.linked[i]
    owner = tree.tag[tree.parent[i]]
    out = ["text", f"in:{owner}", f"link:{0 if link == 0 else 1 if link < 0.5 else 2}", f"size:{_size(len(text))}"]
    if text[-1] in ".!?:;,\"')”»…":
        out += ["ends", f"ends in:{owner}"]
    if "©" in text or "cookie" in text.lower():
        out.append("legal")
    return out


def _kind(tree: Tree, i: int) -> str:
    return "text" if tree.text[i] is not None else "marked" if tree.hints[i] or tree.tag[i] in ("nav", "aside", "footer", "header", "article", "main", "form") else "plain"


Weights = dict[str, float]


def marginals(tree: Tree, w: Weights) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Sum-product over the tree: each node's content marginal, and each node's joint with its parent (as parent, child: 00, 01, 10, 11)."""
    n = len(tree.parent)
    exp = math.exp
    pair = {k: tuple(exp(w.get(f"pair:{k}:{ab}", 0.0)) for ab in ("00", "01", "10", "11")) for k in ("text", "marked", "plain")}
    up0, up1 = [1.0] * n, [1.0] * n
    for i in range(n):
        s = 0.0
        for f in describe(tree, i):
            s += w.get(f, 0.0)
        s = max(-30.0, min(30.0, s))
        up1[i] = exp(s)
    kinds = [_kind(tree, i) for i in range(n)]
    m0, m1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, -1, -1):
        t = up0[i] + up1[i]
        up0[i] /= t
        up1[i] /= t
        p = tree.parent[i]
        if p >= 0:
            a, b, c, d = pair[kinds[i]]
            x, y = up0[i] * a + up1[i] * b, up0[i] * c + up1[i] * d
            m0[i], m1[i] = x / (x + y), y / (x + y)
            u0, u1 = up0[p] * m0[i], up1[p] * m1[i]
            t = u0 + u1
            up0[p], up1[p] = u0 / t, u1 / t
    out, joint = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
    full0, full1 = up0[:], up1[:]
    for i in range(n):
        p = tree.parent[i]
        if p >= 0:
            a, b, c, d = pair[kinds[i]]
            q0, q1 = full0[p] / m0[i], full1[p] / m1[i]
            j = (q0 * a * up0[i], q0 * b * up1[i], q1 * c * up0[i], q1 * d * up1[i])
            t = sum(j)
            j = (j[0] / t, j[1] / t, j[2] / t, j[3] / t)
            joint[i] = j
            full0[i], full1[i] = j[0] + j[2], j[1] + j[3]
        t = full0[i] + full1[i]
        full0[i], full1[i] = max(full0[i] / t, 1e-300), max(full1[i] / t, 1e-300)
        out[i] = full1[i]
    return out, joint


def train(pages: list[tuple[Tree, list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Weights:
    """Gradient ascent on the log likelihood of labelled trees: seen minus expected features."""
    w: Weights = {}
    for epoch in range(epochs):
        step = rate / (1 + epoch / 4)
        for tree, gold in pages:
            prob, joint = marginals(tree, w)
            change: Weights = {}
            for i, y in enumerate(gold):
                g = y - prob[i]
                if abs(g) > 1e-4:
                    for f in describe(tree, i):
                        change[f] = change.get(f, 0.0) + g
                p = tree.parent[i]
                if p >= 0:
                    k = _kind(tree, i)
                    for ab, q in zip(("00", "01", "10", "11"), joint[i], strict=True):
                        f = f"pair:{k}:{ab}"
                        change[f] = change.get(f, 0.0) + (ab == f"{gold[p]}{y}") - q
            for f, g in change.items():
                w[f] = w.get(f, 0.0) * (1 - decay) + step * max(-3.0, min(3.0, g))
    return w


def labelled_pages(n: int = 300, seed: int = 11) -> list[tuple[Tree, list[int]]]:
    """Made-up pages whose content is known: layouts, names and texts vary, each element is marked as it is written."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        source = _page(rng)
        if rng.random() < 0.15:  # some pages are cut off
            source = source[: rng.randint(len(source) // 3, len(source))]
        tree = parse(source.replace("\x01", "").replace("\x02", ""))
        marked = parse(source)
        gold = [0] * len(tree.parent)
        for i, t in enumerate(marked.text):
            if t is not None and "\x01" in t:
                gold[i] = 1
                p = tree.parent[i]
                while p > 0 and not gold[p]:
                    gold[p] = 1
                    p = tree.parent[p]
        gold[0] = int(any(gold))
        pages.append((tree, gold))
    return pages


def _words(rng: random.Random, a: int, b: int) -> str:
    return " ".join("".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))


def _page(rng: random.Random) -> str:
    """One page; \\x01 starts what is content."""
    say = lambda a, b: _words(rng, a, b)
    sentence = lambda a=4, b=40: say(a, b).capitalize() + rng.choice((*".....!?", ""))
    attr = lambda names: "" if rng.random() < 0.15 else f' {rng.choice(("class", "id", "class", "role"))}="{rng.choice(names.split())}{rng.choice(("", "", "-box", " x1", "_area"))}"'
    links = lambda k: "".join(f'<li><a href="/{say(1, 1)}">{say(1, 2)}</a></li>' for _ in range(k))

    def menu() -> str:
        tag = rng.choice(("nav", "nav", "div", "ul"))
        return f"<{tag}{attr(HINTS['nav']) if tag != 'nav' else rng.choice(('', attr(HINTS['nav'])))}><ul>{links(rng.randint(2, 8))}</ul></{tag}>"

    def advert() -> str:
        tag = rng.choice(("div", "aside", "section", "div"))
        return f'<{tag} class="{rng.choice(HINTS["ad"].split())}">{sentence(2, 25) if rng.random() < 0.6 else f"<p>{sentence(2, 25)}</p>"}</{tag}>'

    def notice() -> str:
        return f'<div class="{rng.choice(HINTS["note"].split())}"><p>{sentence(4, 30)}</p></div>' if rng.random() < 0.7 else f'<div id="{rng.choice(HINTS["note"].split())}">{sentence(3, 25)}</div>'

    def side() -> str:
        inside = f"<h3>{say(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul>" if rng.random() < 0.6 else f"<p>{sentence(4, 30)}</p>"
        return f"<aside{attr(HINTS['side'])}>{inside}</aside>" if rng.random() < 0.6 else f'<div class="{rng.choice(HINTS["side"].split())}">{inside}</div>'

    def talk() -> str:
        one = lambda: f"<{(t := rng.choice(('p', 'div', 'li', 'article')))}{rng.choice(('', ' class=comment'))}>{sentence(3, 40)}</{t}>"
        tag = rng.choice(("section", "div", "ol"))
        return f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(HINTS["talk"].split())}">{rng.choice(("", "<h3>" + say(1, 2) + "</h3>"))}{"".join(one() for _ in range(rng.randint(1, 5)))}</{tag}>'

    def form() -> str:
        return f'<form action="/{say(1, 1)}"><label>{say(1, 3)}</label><input name="q"><p>{sentence(2, 12)}</p><button>{say(1, 1)}</button></form>'

    def head() -> str:
        return f"<header{attr(HINTS['head'])}>{rng.choice((f'<h1>{say(1, 3)}</h1>', f'<div>{say(1, 4)}</div>', f'<p>{sentence(2, 10)}</p>'))}{menu() if rng.random() < 0.5 else ''}</header>"

    def foot() -> str:
        inside = f"&copy; {say(1, 3)} &middot; {sentence(2, 40)}"
        return f"<footer{rng.choice(('', attr(HINTS['foot'])))}>{inside if rng.random() < 0.6 else f'<p>{inside}</p>'}</footer>" if rng.random() < 0.75 else f'<div class="{rng.choice(HINTS["foot"].split())}">{inside}</div>'

    def body() -> str:
        out = []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            r = rng.random()
            if r < 0.62:
                t = f"\x01{sentence(1, 70)}"
                if rng.random() < 0.2:
                    t += f' <a href="/{say(1, 1)}">{say(1, 3)}</a> {sentence(2, 20)}'
                out.append(f"<p>{t}</p>" if rng.random() < 0.7 else f"<p><b>{t}<br>" if rng.random() < 0.5 else f"<p>{t}")
            elif r < 0.72:
                out.append(f"<h{(k := rng.randint(2, 4))}>\x01{say(1, 6)}</h{k}>")
            elif r < 0.8:
                out.append(f"<{(k := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>\x01{sentence(2, 16)}</li>" for _ in range(rng.randint(1, 5))) + f"</{k}>")
            elif r < 0.85:
                out.append(f"<blockquote><p>\x01{sentence()}</p></blockquote>" if rng.random() < 0.5 else f"<blockquote>\x01{sentence()}</blockquote>")
            elif r < 0.89:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>\x01{say(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif r < 0.92:
                out.append(f"<pre>\x01{say(2, 20)}</pre>" if rng.random() < 0.5 else f"<div>\x01{sentence()}</div>")
            else:
                out.append(rng.choice((advert, side, notice, form, talk))())
        return "".join(out)

    title = f"<h1>\x01{say(1, 12)}</h1>" if rng.random() < 0.85 else ""
    where = rng.random()
    inner = title + body()
    if rng.random() < 0.25:
        inner += talk()
    if where < 0.6:
        main = f"<article{attr(HINTS['main']) if rng.random() < 0.4 else ''}>{inner}</article>"
    elif where < 0.75:
        main = f"<main>{inner}</main>"
    elif where < 0.93:
        main = f'<div class="{rng.choice(HINTS["main"].split())}">{inner}</div>'
    else:
        main = inner
    before = [f() for f in rng.sample((menu, advert, head, notice, form, side), rng.randint(0, 4))]
    after = [f() for f in rng.sample((foot, talk, side, advert, notice, menu), rng.randint(0, 4))]
    if rng.random() < 0.2:  # a fragment
        return "".join(before) + main + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{say(1, 5)}</title><script>var a='</p>';</script></head><body>{''.join(before)}<!-- x -->{main}{''.join(after)}</body></html>"


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return train(labelled_pages())


def extract(page: str | None, w: Weights, joint: str = "\n") -> str:
    tree = parse(page)
    prob, _ = marginals(tree, w)
    return joint.join(t for t, p in zip(tree.text, prob, strict=True) if t is not None and p > 0.5)


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars. No shuffle; whole pages.

    Blocks of the text are two newlines apart. Null, empty and textless pages have an empty text. Repeated rows give repeated results; extra
    columns are not read.
    """
    w = weights or default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, w, "\n\n") for h in b["html"].to_pylist()]
            yield pa.record_batch({"page_id": b["page_id"], "url": b["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
