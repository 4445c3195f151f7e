"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read once into leaf blocks: runs of text that no block-level tag interrupts, with the tags and class, id and role words of
their ancestors. Each block has indicator features (ancestors, own tag, hints by word group, link density, length, punctuation, place);
two neighbours have a transition weight by whether they share a parent. Weights are the maximum of the penalised conditional
likelihood of labelled pages, by forward and backward sums; a page is decoded by Viterbi, and its blocks labelled as content are joined.

Labelled pages are the table's own pages that have an article element (its blocks are content unless an ancestor in it is an aside,
nav, form or footer) and pages composed here: prose, links and layouts in varied markup, so that what was put in as article is known. At
most SAMPLE pages of at most SAMPLE_CHARS characters, those of the least hashes, are collected for that; every page is scored whole.

Defined cases: null and empty pages, and pages without content, give an empty text; repeated rows and equal keys give a row each; an
empty table is fitted on composed pages alone and gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read

SAMPLE, SAMPLE_CHARS, COMPOSED = 120, 60_000, 360

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
UNSEEN = frozenset("script style template noscript svg math iframe object canvas audio video select option datalist textarea button title head".split())
#: Elements that can stand in a block's path without being its parent.
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre td th figcaption summary address".split())
TAGS = frozenset("article main section nav header footer aside form table ul ol li dl blockquote figure figcaption pre details dialog fieldset address menu p td th h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role values by what they tell.
HINTS = {
    "content": "content article post entry story text body main prose page",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip sitemap",
    "head": "header head masthead topbar top brand logo",
    "foot": "footer foot colophon copyright legal bottom contentinfo",
    "side": "sidebar side aside rail widget widgets related recommended popular trending teaser teasers complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer paywall toast dialog warning message",
    "form": "form search login signup signin subscribe newsletter register contact",
    "comment": "comment comments reply replies respond discussion disqus thread feedback guestbook",
    "share": "share sharing social follow buttons toolbar tags meta",
    "hidden": "hidden invisible offscreen",
}
HINT_OF = {w: group for group, words in HINTS.items() for w in words.split()}
#: Comments, tags (with quoted values) and other markup; none takes more than one look at a character, whatever is left open.
MARKUP = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]+|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
#: Elements whose text is no markup, with what ends them.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "title", "textarea", "iframe", "noscript")}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGIT = re.compile(r"\d")
SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


class Block(NamedTuple):
    text: str
    features: tuple[str, ...]
    parent: int
    label: bool


def bucket(n: int, *bounds: int) -> int:
    return sum(n > b for b in bounds)


def text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    return [
        f"words={bucket(words, 1, 2, 4, 8, 14, 24, 48)}",
        f"linked={bucket(10 * linked // max(1, len(text) - words + 1), 0, 3, 8)}",
        f"sentences={bucket(len(SENTENCE.findall(text)), 0, 1, 3)}",
        f"ends={'stop' if text[-1] in '.!?…。' else 'colon' if text[-1] in ':»›>' else 'other'}",
        f"mark={'©' in text or '(c)' in text or '·' in text or '|' in text}",
        f"digits={10 * len(DIGIT.findall(text)) > 3 * len(text)}",
        f"commas={bucket(text.count(','), 0, 2)}",
    ]


class Reader:
    """The leaf blocks of one page. With `gold`, blocks below an element with data-gold="1" (and no nearer "0") are labelled as content."""

    def __init__(self, gold: bool = False):
        self.gold, self.blocks, self.nodes = gold, [], 0
        self.stack: list[tuple[str, frozenset, int, bool, bool]] = [("", frozenset(), 0, True, False)]  # tag, features, parent, seen, label
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False

    def read(self, html: str) -> list[Block]:
        at, unclosed = 0, set()
        while found := MARKUP.search(html, at):
            self.data(html[at : found.start()])
            at = found.end()
            ends, tag, rest = found.groups()
            if not tag:
                continue
            tag = tag.lower()
            if ends:
                self.end(tag)
            elif tag not in RAW:
                self.start(tag, rest)
            elif tag not in unclosed:
                self.end_block()
                if closing := RAW[tag].search(html, at):
                    at = closing.start()
                elif tag in ("script", "style"):
                    at = len(html)
                else:
                    unclosed.add(tag)
        self.data(html[at:])
        self.end_block()
        return self.blocks

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag, features, parent, _, label = self.stack[-1]
                self.blocks.append(Block(text, (*sorted(features), f"own={tag}", *text_features(text, self.linked)), parent, label))
            self.parts, self.linked = [], 0

    def start(self, tag: str, rest: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.in_link = any(name.lower() == "href" for name, *_ in ATTRIBUTE.findall(rest))
            return
        if tag in VOID:
            if tag == "hr":
                self.end_block()
            elif tag == "br":
                self.parts.append(" ")
            return
        self.end_block()
        self.close("p")
        _, features, parent, seen, label = self.stack[-1]
        own = {f"in={tag}"} if tag in TAGS else set()
        for name, *values in ATTRIBUTE.findall(rest):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role"):
                words = [w.lower() for w in WORD.findall(value)]
                own |= {f"hint={HINT_OF[w]}" for w in words if w in HINT_OF}
            elif name == "hidden" or (name == "style" and "none" in value):
                own.add("hint=hidden")
            elif self.gold and name == "data-gold":
                label = value == "1"
        self.nodes += 1
        self.stack.append((tag, features | own if own else features, parent if tag in LEAVES else self.nodes, seen and tag not in UNSEEN, label))
        self.open[tag] = self.open.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        """Ends the innermost open element of this tag, with all in it."""
        while self.open.get(tag):
            last = self.stack.pop()[0]
            self.open[last] -= 1
            if last == tag:
                return

    def end(self, tag: str) -> None:
        if tag in INLINE:
            self.in_link = self.in_link and tag != "a"
        elif tag not in VOID:
            self.end_block()
            self.close(tag)

    def data(self, text: str) -> None:
        if text and self.stack[-1][3]:
            text = unescape(text)
            self.parts.append(text)
            if self.in_link:
                self.linked += len("".join(text.split()))


def blocks(html: str, gold: bool = False) -> list[Block]:
    return Reader(gold).read(html)


def placed(found: list[Block]) -> list[tuple[str, ...]]:
    """Features of all blocks of a page, with their place in it."""
    n = len(found)
    return [(*b.features, "bias", f"place={bucket(10 * i // n, 0, 1, 8)}", f"from_end={bucket(n - i, 1, 3)}") for i, b in enumerate(found)]


class Model(NamedTuple):
    weights: dict[str, float]
    #: Scores of (label before, label) for neighbours with different parents, and with one.
    transitions: tuple[tuple[tuple[float, float], ...], ...]

    def decode(self, found: list[Block]) -> list[bool]:
        """The most likely labels of a page's blocks, by Viterbi."""
        back, out, no, yes = [], [], 0.0, 0.0
        for i, f in enumerate(placed(found)):
            score = sum(map(self.weights.get, f, [0.0] * len(f)))
            if not i:
                yes = score
                continue
            t = self.transitions[found[i].parent == found[i - 1].parent]
            back.append((yes + t[1][0] > no + t[0][0], yes + t[1][1] > no + t[0][1]))
            no, yes = max(no + t[0][0], yes + t[1][0]), max(no + t[0][1], yes + t[1][1]) + score
        now = yes > no
        for b in reversed(back):
            out.append(now)
            now = b[now]
        return [*([now] if found else []), *reversed(out)]

    def text(self, html: str | None) -> str:
        found = blocks(html or "")
        return " ".join(b.text for b, kept in zip(found, self.decode(found)) if kept)


def trained(pages: list[list[Block]], rounds: int = 160, rate: float = 0.15, penalty: float = 0.5) -> Model:
    """The conditional random field that fits labelled pages best, by gradient steps (Adam) over all pages at once."""
    pages = sorted((p for p in pages if p), key=len, reverse=True)
    names: dict[str, int] = {}
    flat, of_block, label, same = [], [], [], []
    width, n_blocks = len(pages[0]), 0
    at = np.full((len(pages), width), -1)
    for i, page in enumerate(pages):
        for k, (b, f) in enumerate(zip(page, placed(page))):
            flat += [names.setdefault(x, len(names)) for x in f]
            of_block += [n_blocks] * len(f)
            label.append(b.label)
            same.append(k > 0 and page[k - 1].parent == b.parent)
            at[i, k] = n_blocks
            n_blocks += 1
    flat, of_block, label, same = np.array(flat), np.array(of_block), np.array(label, float), np.array(same, int)
    there, y = at >= 0, np.where(at >= 0, label[at], 0).astype(int)
    kind = np.where(there, same[at], 0)
    n = len(names)
    theta, m, v = np.zeros(n + 8), np.zeros(n + 8), np.zeros(n + 8)
    seen = np.bincount(flat, label[of_block], n)
    seen_steps = np.zeros((2, 2, 2))
    rows, steps = np.nonzero(there[:, 1:])
    np.add.at(seen_steps, (kind[rows, steps + 1], y[rows, steps], y[rows, steps + 1]), 1)
    for step in range(1, rounds + 1):
        emit = np.bincount(of_block, theta[flat], n_blocks)
        e = np.zeros((len(pages), width, 2))
        e[..., 1] = np.where(there, emit[at], 0)
        t = theta[n:].reshape(2, 2, 2)[kind]  # page, place, before, now
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, width):
            new = np.logaddexp(alpha[:, k - 1, 0, None] + t[:, k, 0], alpha[:, k - 1, 1, None] + t[:, k, 1]) + e[:, k]
            alpha[:, k] = np.where(there[:, k, None], new, alpha[:, k - 1])
        for k in range(width - 2, -1, -1):
            ahead = beta[:, k + 1] + e[:, k + 1]
            new = np.logaddexp(t[:, k + 1, :, 0] + ahead[:, 0, None], t[:, k + 1, :, 1] + ahead[:, 1, None])
            beta[:, k] = np.where(there[:, k + 1, None], new, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        chance = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None])
        expected = np.zeros(n_blocks)
        expected[at[there]] = chance[there]
        pair = np.exp(alpha[:, :-1, :, None] + t[:, 1:] + (beta + e)[:, 1:, None, :] - z[:, None, None, None])
        steps_expected = np.stack([(pair * (there[:, 1:] & (kind[:, 1:] == s))[..., None, None]).sum((0, 1)) for s in (0, 1)])
        gradient = np.concatenate([np.bincount(flat, expected[of_block], n) - seen, (steps_expected - seen_steps).ravel()]) + penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = theta[n:].reshape(2, 2, 2)
    return Model({x: float(theta[i]) for x, i in names.items()}, tuple(tuple((float(b[0]), float(b[1])) for b in s) for s in t))


# Labelled pages


class Composer:
    """Pages in varied markup whose article is known, from paragraphs and short texts."""

    def __init__(self, seed: int, prose: list[str], short: list[str]):
        self.rnd = random.Random(seed)
        self.prose, self.short = prose, short

    def one(self, options: str) -> str:
        return self.rnd.choice(options.split("|"))

    def chance(self, p: float) -> bool:
        return self.rnd.random() < p

    def sentences(self, most: int) -> str:
        text = self.rnd.choice(self.prose)
        return " ".join(re.split(r"(?<=[.!?])\s+", text)[: self.rnd.randint(1, most)]) if self.chance(0.7) else text

    def links(self, least: int, most: int) -> list[str]:
        return [f'<a href="/{i}">{self.rnd.choice(self.short)}</a>' for i in range(self.rnd.randint(least, most))]

    def boxed(self, options: str, body: str, gold: str = "0") -> str:
        """body in an element of the form tag, tag.class or tag#id."""
        tag, mark, name = re.fullmatch(r"(\w+)([.#@]?)([\w -]*)", self.one(options)).groups()
        attribute = {"": "", ".": f' class="{name}"', "#": f' id="{name}"', "@": f' role="{name}"'}[mark]
        return f'<{tag}{attribute} data-gold="{gold}">{body}</{tag}>'

    def listed(self, items: list[str]) -> str:
        form = self.rnd.randrange(3)
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if form == 0 else " | ".join(items) if form == 1 else "".join(f"<div>{x}</div>" for x in items)

    def menu(self) -> str:
        return self.boxed("nav|nav|div.menu|div.navbar|div#navigation|ul.nav|div@navigation|div.breadcrumbs|div|td", self.listed(self.links(3, 9)))

    def head(self) -> str:
        return self.boxed("header|header|div.header|div.masthead|div#top|div.site-header|div", f"<{self.one('div|p|h2')}>{self.rnd.choice(self.short)}</div>" + (f"<p>{self.rnd.choice(self.short)} {self.rnd.choice(self.short)}</p>" if self.chance(0.5) else ""))

    def advert(self) -> str:
        return self.boxed("div.ad|div.ad|div.ads|div.advert|aside.ad|div.sponsored|div#ad-top|div.promo|section.advertisement", self.one("%s|<p>%s</p>|<a href='/x'>%s</a>") % self.sentences(3))

    def notice(self) -> str:
        return self.boxed("div.notice|div.cookie-notice|div#cookie-consent|section.alert|div.gdpr-banner|div@dialog|div@alert|aside.notice|p.notice", self.one("%s|<p>%s</p>|<p>%s</p><a href='#'>OK</a>|<div>%s</div><button>OK</button>") % self.sentences(3))

    def form(self) -> str:
        fields = "".join(f"<label>{self.rnd.choice(self.short)}</label><input name='f{i}'>" for i in range(self.rnd.randint(1, 3)))
        return self.boxed("form|form|form.search|form.newsletter|div.subscribe|form#login|div.newsletter", f"{self.one('<p>%s</p>|%s') % self.sentences(2)}{fields}<button>{self.rnd.choice(self.short)}</button>".replace("<input", "<br><input"))

    def side(self) -> str:
        body = f"<h3>{self.rnd.choice(self.short)}</h3>" + self.listed(self.links(2, 6)) + (f"<p>{self.sentences(3)}</p>" if self.chance(0.6) else "")
        return self.boxed("aside|aside|aside.sidebar|div.sidebar|div#side|div.widget|div.related|section.related|div.rail|td.side", body)

    def comments(self) -> str:
        each = self.one("<div class='comment'>%s</div>|<li>%s</li>|<article class='comment'>%s</article>|<div>%s</div>")
        said = "".join(each % (f"<b>{self.rnd.choice(self.short)}</b> <p>{self.sentences(4)}</p>" if self.chance(0.7) else self.sentences(3)) for _ in range(self.rnd.randint(1, 6)))
        return self.boxed("section.comments|div.comments|div#comments|ul.comment-list|ol.comments|div.discussion|section#replies|div.reader-comments", f"<h3>{self.rnd.choice(self.short)}</h3>" * self.chance(0.6) + said + (self.form() if self.chance(0.3) else ""))

    def foot(self) -> str:
        return self.boxed("footer|footer|div.footer|div#footer|div.colophon|div@contentinfo|div.legal", f"&copy; {self.rnd.choice(self.short)} &middot; {self.sentences(2)}" + (self.listed(self.links(1, 5)) if self.chance(0.5) else ""))

    def shares(self) -> str:
        return self.boxed("div.share|ul.social|div.buttons|div.tags", self.listed(self.links(2, 4)))

    def paragraph(self) -> str:
        text = self.sentences(9)
        words = text.split(" ")
        if len(words) > 4 and self.chance(0.3):
            k = self.rnd.randrange(len(words) - 2)
            tag = self.one("a href='/l'|b|i|em|span class='x'")
            words[k : k + 2] = [f"<{tag}>{words[k]} {words[k + 1]}</{tag.split()[0]}>"]
        body, kind = " ".join(words), self.rnd.random()
        if kind < 0.72:
            return f"<p>{body}" + "</p>" * self.chance(0.9)
        if kind < 0.78:
            return f"<h2>{self.rnd.choice(self.short)}</h2><p>{body}</p>"
        if kind < 0.83:
            return f"<blockquote>{body}</blockquote>"
        if kind < 0.89:
            return "<ul>" + "".join(f"<li>{self.sentences(1)}</li>" for _ in range(self.rnd.randint(2, 4))) + "</ul>"
        if kind < 0.92:
            return "<table><tr>" + "".join(f"<td>{self.rnd.choice(self.short)}</td>" for _ in range(4)) + "</tr></table>"
        if kind < 0.95:
            return f"<figure><img src='x.png'><figcaption>{self.sentences(1)}</figcaption></figure>"
        return f"<div>{body}</div>" if kind < 0.98 else f"<pre>{body}</pre>"

    def article(self) -> str:
        title = f"<h1>{self.rnd.choice(self.prose)[: self.rnd.randint(15, 70)]}</h1>"
        body = [self.one("%s|%s|<header>%s</header>") % title if self.chance(0.9) else ""]
        for _ in range(self.rnd.randint(1, 14) if self.chance(0.9) else 0):
            body.append(self.paragraph())
            if self.chance(0.05):
                body.append(self.rnd.choice([self.advert, self.form, self.side, self.shares, self.notice])())
        inner = self.boxed("article|article|article.post|div.content|div.post|div.entry-content|div#content|section.story|div.article-body|div|td.text", "".join(body), "1")
        if self.chance(0.2):
            inner = inner.replace("</article>", self.rnd.choice([self.comments, self.shares])() + "</article>")
        return self.boxed("main|div#main|div.wrapper|div.container|section", inner, "0") if self.chance(0.4) else inner

    def page(self) -> str:
        parts = [f(self) for f, p in ((Composer.head, 0.6), (Composer.menu, 0.8), (Composer.notice, 0.35), (Composer.advert, 0.5), (Composer.side, 0.2)) if self.chance(p)]
        self.rnd.shuffle(parts)
        parts.append(self.article())
        after = [f(self) for f, p in ((Composer.shares, 0.15), (Composer.comments, 0.45), (Composer.side, 0.35), (Composer.form, 0.3), (Composer.advert, 0.2), (Composer.notice, 0.15)) if self.chance(p)]
        self.rnd.shuffle(after)
        parts += after + ([self.foot()] if self.chance(0.85) else [])
        return f"<!DOCTYPE html><html><head><title>{self.rnd.choice(self.short)}</title><style>p{{margin:0}}</style></head><body>{''.join(parts)}<script>var t='<p>x</p>';</script></body></html>"


def filler(rnd: random.Random, words: int) -> str:
    """Made-up prose, for tables whose pages give none."""
    syllables = [a + b for a in "bdfklmnprst" for b in "aeiou"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    out: list[str] = []
    while words > 0:
        n = min(words, rnd.randint(4, 14))
        out.append(" ".join(word() for _ in range(n)).capitalize() + ".")
        words -= n
    return " ".join(out)


def labelled(htmls: list[str], seed: int = 1, composed: int = COMPOSED) -> list[list[Block]]:
    """Pages that have an article element, labelled by it, and `composed` more."""
    own, prose, short = [], [], []
    for html in htmls:
        found = blocks(html)
        inside = [("in=article" in b.features and not {"in=aside", "in=nav", "in=form", "in=footer", "hint=ad", "hint=comment"} & set(b.features)) for b in found]
        if any(inside):
            own.append([b._replace(label=x) for b, x in zip(found, inside)])
        prose += [b.text for b, x in zip(found, inside) if x and len(b.text) < 3000]
        short += [b.text for b, x in zip(found, inside) if not x and len(b.text) < 40]
    rnd = random.Random(seed)
    prose += [filler(rnd, rnd.randint(1, 90)) for _ in range(max(40, len(prose) // 4))]
    short += [filler(rnd, rnd.randint(1, 4)).rstrip(".") for _ in range(max(40, len(short) // 4))]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    composer = Composer(seed, [*map(escape, prose)], [*map(escape, short)])
    return own + [blocks(composer.page(), gold=True) for _ in range(composed)]


def fit(pages: DataFrame, html: str = "html") -> Model:
    size = F.length("_html")
    rows = pages.select(F.col(html).alias("_html")).where((size > 0) & (size <= SAMPLE_CHARS)).orderBy(F.xxhash64("_html"), "_html").limit(SAMPLE).collect()
    return trained(labelled([r["_html"] for r in rows]))


def extract(pages: DataFrame, model: Model, key: str = "page_id", html: str = "html", carried: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the carried columns, text and n_chars of each row of pages."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [held.value.text(h) for h in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], [*own, "text"])

    names = [key, *carried]
    own = [f"_c{k}" for k in range(len(names))]
    kinds = ", ".join(f"{o} {pages.schema[c].dataType.simpleString()}" for o, c in zip(own, names))
    found = pages.select(*(F.col(c).alias(o) for o, c in zip(own, names)), F.col(html).alias("_html")).mapInArrow(run, f"{kinds}, text string")
    return found.select(*(F.col(o).alias(c) for o, c in zip(own, names)), "text", F.length("text").cast("long").alias("n_chars"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


#: What pages hold in their one article element. The field itself is beyond SQL; where pages are of this form, its result is this.
ARTICLE_SQL = r"""with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as t from pages),
b as (select page_id, url, regexp_replace(regexp_replace(t, '</?(b|i|em|strong|a|span)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') as t from a),
c as (select page_id, url, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as t from b),
d as (select page_id, url, trim(regexp_replace(t, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ') as text from c)
select page_id, url, text, length(text) as n_chars from d"""

QUERIES = {"op13_html_extraction": op13_html_extraction}
ORACLE_SQL = {"op13_html_extraction": ARTICLE_SQL}
