"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed once from left to right into its leaf blocks (text between block-level tags) with their ancestors.
Features of a block are its tag, its ancestors' tags, the words of their class, id and role, and the shape of its text.
A two-state chain (main text or not) over the blocks of a page is decoded by Viterbi.

*Labelled pages.* The chain is trained on generated pages of many layouts (``training_pages``), whose blocks are
labelled as they are written, and on a bounded sample of the given pages (``sample`` of them) whose blocks stand inside
elements that name their role themselves (article and main against nav, aside, footer and so on).
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .blocks import pieces

# HTML's elements by how they are read.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MATH = set("math maction annotation annotation-xml menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo "
           "mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr "
           "munder munderover none semantics".split())  # read as inline text
RAW = set("script style iframe title textarea".split())  # read up to their end tag, whatever stands in them
DROPPED = set("template noscript object svg select button canvas audio video datalist".split())  # elements, left out
LEAVES_SVG = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu "
                 "meta ol p pre ruby s small span strong strike sub sup table tt u ul var".split())  # start tags that end it
CELLS = {"td", "th", "tr"}
SVG_HTML = {"foreignobject", "desc", "title"}  # elements of svg that hold HTML
CLOSES = {  # a start tag closes an open element of these kinds first
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
               "header hr main menu nav ol pre section table ul".split())
SCOPE = set("table ul ol dl section article div body".split())  # what an implied end tag doesn't leave
OWN_ROLE_MAIN, OWN_ROLE_REST = {"article", "main"}, set("nav aside footer header form menu".split())
HINTS = set("cookie cookies copyright subscribe newsletter login register privacy terms reply comments share tweet "
            "advertisement sponsored related read follow search menu home contact".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|"
                 r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""", re.I)
WORD = re.compile(r"[a-z]+")
TAIL = re.compile(r"<(?:[A-Za-z/!?][^<>]*)?\Z")
CLOSERS = {tag: re.compile(rf"</{tag}\b[^<>]*>?", re.I) for tag in RAW}
DIMENSIONS = 1 << 14


class Block:
    __slots__ = ("text", "path", "tag", "linked")

    def __init__(self, text, path, tag, linked):
        self.text, self.path, self.tag, self.linked = text, path, tag, linked


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text in page order; character references decoded, white space runs turned into one space, trimmed.

    Text inside an element of DROPPED is left out while the element is open: up to its end tag, or the end tag of an
    element around it. It doesn't break the block it stands in.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []  # open elements: tag, features
    path: tuple = ()
    parts: list[str] = []
    linked = depth_a = 0
    hidden: list[str] = []  # an open element of DROPPED and the elements open inside it
    inline: dict[str, int] = {}  # numbers of open inline elements outside of that
    at, n = 0, len(page)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(("".join(parts)).split())
            if text:
                out.append(Block(text, path, stack[-1][0] if stack else "", linked / len(text)))
            parts.clear()
        linked = 0

    def pop_to(i):
        nonlocal path
        del stack[i:]
        path = tuple(f for _, own in stack for f in own)

    def drawing():
        """Whether the innermost open element is one of an svg itself, not HTML inside it."""
        return next((t == "svg" for t in reversed(hidden) if t == "svg" or t in SVG_HTML), False)

    def stays_hidden(tag, closing, empty):
        """Take a tag in while ``hidden``; False if it ends what is hidden and counts outside."""
        if closing:
            if tag in hidden:
                while hidden.pop() != tag:
                    pass
            elif inline.get(tag) or any(t == tag for t, _ in stack):
                hidden.clear()
                return False
            return True
        while tag in LEAVES_SVG and drawing():
            while hidden.pop() != "svg":
                pass
        if tag in CELLS and "table" not in hidden and any(t in CELLS for t, _ in stack):
            hidden.clear()  # the next cell of the table around it
        if hidden and tag not in VOID and not (empty and (tag in ("svg", "math") or drawing())):
            hidden.append(tag)
        return bool(hidden)

    while at < n:
        m = TAG.search(page, at)
        text = page[at:m.start()] if m else TAIL.sub("", page[at:])
        if text and not hidden:
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            if depth_a:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), (m[1] or m[4]) == "/"
        attributes = m[3] or m[6]
        empty = not closing and bool(attributes) and attributes.rstrip().endswith("/")
        if tag in RAW and not (hidden and (closing or drawing())):
            if not closing:
                end = CLOSERS[tag].search(page, at)
                at = end.end() if end else n
            continue
        if hidden and stays_hidden(tag, closing, empty):
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE or tag in MATH:
            if tag not in VOID and not (empty and tag in MATH):
                inline[tag] = max(0, inline.get(tag, 0) + (-1 if closing else 1))
            if tag == "a":
                depth_a = 0 if closing else 1
            continue
        if tag in DROPPED:
            if not closing and not (empty and tag == "svg"):
                hidden.append(tag)
            continue
        flush()
        depth_a = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            continue
        if tag in VOID:
            continue
        ends = CLOSES.get(tag) or ({"p"} if tag in CLOSES_P else ())
        if ends:
            cut = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    cut = i
                elif stack[i][0] in SCOPE:
                    break
            if cut < len(stack):
                pop_to(cut)
        own = ["t:" + tag]
        if attributes:
            for a in ATTRIBUTE.finditer(attributes):
                if a[5]:
                    own.append("c:hidden")
                else:
                    own += ["c:" + w for w in WORD.findall((a[2] or a[3] or a[4] or "").lower())]
        stack.append((tag, tuple(own)))
        path = path + tuple(own)
    flush()
    return out


def features(block: Block, nth: int, total: int) -> list[str]:
    words = block.text.split(" ", 61)
    n = len(words)
    out = ["bias", "tag:" + block.tag, f"n:{0 if n < 4 else 1 if n < 9 else 2 if n < 21 else 3 if n < 61 else 4}",
           f"a:{0 if not block.linked else 1 if block.linked <= .3 else 2 if block.linked <= .7 else 3}",
           f"at:{min(4, 5 * nth // total)}"]
    out += set(block.path)
    if block.text[-1] in ".!?:;…»\"”":
        out.append("stop")
    if "©" in block.text:
        out.append("©")
    if n < 30:
        out += {"w:" + w for w in WORD.findall(block.text.lower()) if w in HINTS}
    return out


def _place(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray

    def logits(self, pages: list[list[Block]]) -> list[list[float]]:
        known, weight, out = {}, self.weights, []
        for page in pages:
            own = []
            for i, block in enumerate(page):
                x = 0.0
                for f in features(block, i, len(page)):
                    w = known.get(f)
                    if w is None:
                        w = known[f] = float(weight[_place(f)])
                    x += w
                own.append(x)
            out.append(own)
        return out

    def main_text(self, pages: list[str]) -> list[str]:
        """The blocks of each page decoded as main text, joined by a line break."""
        blocks, move = [leaf_blocks(p) for p in pages], self.move.tolist()
        return ["\n".join(b.text for b, state in zip(page, crf.viterbi(x, move)) if state)
                for page, x in zip(blocks, self.logits(blocks))]


def training_pages(n: int = 400, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Generated pages of varying layouts, each with the texts of its main blocks."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéñüß"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(2, 10)))
    line = lambda a, b: " ".join(word() for _ in range(r.randrange(a, b)))
    sentence = lambda a=5, b=60: line(a, b).capitalize() + r.choice([".", ".", ".", "!", "?", ""])
    links = lambda k: "".join(f'<li><a href="/{word()}">{line(1, 4)}</a></li>' for _ in range(k))
    some = lambda p, x: x() if r.random() < p else ""
    named = lambda *names: f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'
    box = lambda tags, *names: (t := r.choice(tags), f"<{t}{named(*names) if t == 'div' or r.random() < .5 else ''}>", f"</{t}>")[1:]

    def nav():
        a, b = r.choice([("<nav>", "</nav>"), box(["div", "nav"], "menu", "nav", "navbar", "main-menu", "breadcrumb", "topbar")])
        return a + r.choice([f"<ul>{links(r.randrange(3, 9))}</ul>", " | ".join(f'<a href="#">{line(1, 3)}</a>' for _ in range(5))]) + b

    def header():
        a, b = box(["header", "div"], "header", "site-header", "masthead", "banner")
        return a + r.choice([f"<h1>{line(1, 4)}</h1>", f"<p>{line(2, 7)}</p>", f"<div>{line(1, 5)}</div>"]) + some(.5, nav) + b

    def advert():
        a, b = box(["div", "aside", "section"], "ad", "advert", "ads", "sponsored", "promo", "advertisement")
        return a + r.choice([sentence(3, 25), f"<p>{sentence(3, 25)}</p>", f'<a href="#">{line(3, 9)}</a>']) + b

    def side():
        a, b = box(["aside", "div"], "sidebar", "side", "widget", "related", "secondary", "recommended")
        return a + some(.6, lambda: f"<h3>{line(1, 4)}</h3>") + r.choice([f"<ul>{links(5)}</ul>", f"<p>{sentence(4, 30)}</p>"]) + b

    def notice():
        a, b = box(["div", "section"], "cookie", "notice", "cookie-banner", "alert", "consent", "message", "popup", "gdpr")
        return a + f"<p>{sentence(5, 30)}</p>" + some(.5, lambda: f'<a href="#">{line(1, 3)}</a>') + b

    def form():
        return f"<form{some(.5, lambda: named('search', 'newsletter', 'subscribe', 'login'))}><p>{sentence(2, 12)}</p>" \
               f"<label>{line(1, 4)}</label><input name=q></form>"

    def comments():
        a, b = box(["section", "div"], "comments", "comment-list", "discussion", "responses", "replies")
        one = lambda: r.choice([f'<div class="comment"><p>{sentence(3, 40)}</p></div>',
                                f'<li class="reply"><b>{word()}</b><p>{sentence(3, 40)}</p></li>'])
        return a + some(.6, lambda: f"<h3>{line(1, 3)}</h3>") + "".join(one() for _ in range(r.randrange(1, 5))) + b

    def footer():
        a, b = box(["footer", "footer", "div"], "footer", "site-footer", "bottom", "copyright")
        return a + r.choice(["&copy; " + line(1, 6) + " &middot; " + sentence(3, 9), f"<p>{sentence(3, 12)}</p>", f"<ul>{links(4)}</ul>"]) + b

    def body(main):
        """Main blocks, with boilerplate in between at times."""
        out = []

        def add(markup, text):
            main.add(text)
            out.append(markup)

        heading = line(2, 12)
        if r.random() < .8:
            add(f"<h1>{heading}</h1>", heading)
        for _ in range(r.randrange(1, 14)):
            kind, text = r.random(), sentence(*r.choice([(1, 6), (5, 30), (10, 80)]))
            if kind < .1:
                add(f"<h2>{(t := line(1, 6))}</h2>", t)
            elif kind < .2:
                items = [sentence(2, 15) for _ in range(3)]
                main.update(items)
                out.append("<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>")
            elif kind < .27:
                add(f"<blockquote><p>{text}</p></blockquote>", text)
            elif kind < .32:
                rows = [sentence(1, 6) for _ in range(4)]
                main.update(rows)
                out.append("<table><tr>" + "</tr><tr>".join(f"<td>{t}</td>" for t in rows) + "</tr></table>")
            elif kind < .37:
                add(f"<figure><figcaption>{text}</figcaption></figure>", text)
            elif kind < .47:
                add(f"<p><b>{text}<br>", text)
            elif kind < .52:
                add(f"<pre>{text}</pre>", text)
            elif kind < .6:
                first, second = text, line(1, 4)
                add(f'<p>{first} <a href="/x">{second}</a></p>', f"{first} {second}")
            else:
                add(r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p>{text}</p>", f"<div>{text}</div>"]), text)
            if r.random() < .06:
                out.append(r.choice([advert, side, notice, form])())
        return "".join(out)

    pages = []
    for _ in range(n):
        main: set[str] = set()
        a, b = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                         box(["div"], "content", "post", "entry-content", "article-body", "story", "post-content", "main", "text", "article")])
        inside = body(main) + some(.25, comments) + some(.1, form) + some(.1, side)
        before = "".join(some(p, f) for p, f in ((.5, header), (.7, nav), (.5, advert), (.3, notice), (.25, side)))
        after = "".join(some(p, f) for p, f in ((.3, comments), (.35, side), (.2, form), (.25, advert), (.9, footer), (.2, notice)))
        wrap = r.choice([("", ""), ('<div id="page">', "</div>"), ('<div class="container">', "</div>")])
        pages.append((f"<html><head><title>{line(2, 5)}</title></head><body>{wrap[0]}{before}{a}{inside}{b}{after}{wrap[1]}</body></html>", main))
    return pages


def own_roles(blocks: list[Block]) -> list[int] | None:
    """Labels of a page all of whose blocks stand in elements that name their role, else None."""
    out = []
    for b in blocks:
        tags = {f[2:] for f in b.path if f[:2] == "t:"}
        classes = {f for f in b.path if f[:2] == "c:"}
        if tags & OWN_ROLE_REST or classes & {"c:ad", "c:advert", "c:sidebar", "c:comments"}:
            out.append(0)
        elif tags & OWN_ROLE_MAIN:
            out.append(1)
        else:
            return None
    return out


def train(pages: DataFrame, sample: int = 200, sample_chars: int = 20_000, id_col: str = "page_id",
          html_col: str = "html") -> Model:
    """Fit the chain on the generated pages and on the ``sample`` pages, of at most ``sample_chars`` characters, with the
    smallest hashes of their ids, as far as their elements name their roles. An empty table leaves the generated ones."""
    given = (pages.where((F.length(html_col) > 0) & (F.length(html_col) <= sample_chars))
             .select(F.xxhash64(F.col(id_col)).alias("h"), F.col(html_col).alias("html"))
             .orderBy("h", "html").limit(sample).collect())
    labelled = []
    for page, main in training_pages():
        blocks = leaf_blocks(page)
        labelled.append((blocks, [int(b.text in main) for b in blocks]))
    for row in given:
        blocks = leaf_blocks(row["html"])
        labels = own_roles(blocks)
        if labels is not None:
            labelled.append((blocks, labels))
    labelled = [x for x in labelled if x[0]]
    rows, columns, n = [], [], 0
    for blocks, _ in labelled:
        for i, b in enumerate(blocks):
            f = {_place(x) for x in features(b, i, len(blocks))}
            rows += [n] * len(f)
            columns += f
            n += 1
    rows, columns = np.array(rows), np.array(columns)
    label = np.array([y for _, labels in labelled for y in labels])
    first = np.r_[0, np.cumsum([len(b) for b, _ in labelled])]
    weights, move = crf.fit(
        np.zeros(DIMENSIONS), np.zeros((2, 2)),
        lambda w: np.bincount(rows, weights=w[columns], minlength=n),
        lambda gap: np.bincount(columns, weights=gap[rows], minlength=DIMENSIONS), label, first,
        rounds=120, rate=0.1, penalty=1e-5)
    return Model(weights, move)


def extract_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """One row per page: (page_id, url, text, n_chars).

    Defined cases: null and empty html and pages without main text give an empty text; a page cut off inside a tag is
    read up to it; null and repeated ids and urls are passed through; an empty table gives an empty result; other
    columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights

    def extract(batches):
        for batch in pieces(batches, 2):
            text = shared.value.main_text(batch.column(2).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
