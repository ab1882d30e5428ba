"""Main text of HTML pages: boosted trees over DOM nodes, decoded down the tree.

A page is parsed into a tree of elements. Each element has features (its own and its subtree's text, link and tag
density, attribute tokens, depth, siblings, what stands above it), and boosted trees give its log-odds of holding
main text. A pass up and down the tree then picks the best labels of all elements together: outside (may hold the
article), article, or cut out of the article (all below is cut too). So nothing outside hangs below a cut element and no
cut element holds text that is kept. Inline elements without a telling name have no say of their own: they go with what they
stand in, formulas and drawings too. The text of article elements is returned in page order.

The trees are trained on pages composed by rule (`composed`), with the labels that the rule gives: articles in elements of any
kind, in layout tables, in divs without a name, straight in the body and in pages without one, with and without anything beside them.

Defined results: null and empty html give an empty text; character references are decoded by the rules of HTML 5;
runs of white space become one space, between blocks too; broken markup is read as far as it goes, text of any length is
read whole in linear time; equal rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import gbdt, models

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Scripts, styles, forms' fields and what is not shown: never text of an article.
RAW = frozenset("script style noscript template textarea title iframe select option button".split())
TEXT_ONLY = frozenset("script style textarea title".split())
#: Elements that begin and end a block; all others are inline.
BLOCK = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}
#: Fixed cue words in class, id and role.
GOOD = frozenset("article content main post entry story body text page single hentry prose read copy blog news".split())
BAD = frozenset("nav menu sidebar side footer foot header head ad ads advert advertisement adv banner cookie cookies consent notice alert comment comments respond reply discussion disqus promo promotion related recommended recommend share sharing social popup modal newsletter subscribe signup login breadcrumb breadcrumbs widget form search sponsor sponsored tags meta pagination pager toolbar topbar masthead legal copyright navbar links skip hidden overlay gdpr".split())
#: Fixed cue words of notices in texts.
CUES = re.compile(r"(?i)\u00a9|&copy;|copyright|all rights reserved|cookies?\\b|advertisement|sponsored|subscribe|newsletter|log ?in\\b|sign (?:up|in)\\b|share this|privacy policy|terms of")
GROUPS = ("article main section", "div", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "nav menu", "header", "footer", "aside", "form fieldset input label select button textarea", "ul ol dl", "li dt dd", "a", "table tbody thead tr td th", "html body", "head meta link", "script style noscript template iframe svg title", "figure figcaption")
_group = {t: i for i, g in enumerate(GROUPS) for t in g.split()}

_tag = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_rest = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_attr = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_token = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_hidden = re.compile(r"""(?i)\shidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")


class Tree:
    """Elements in page order, parents before children; events: text of an element, or None for the end of a block."""

    __slots__ = ("tag", "parent", "depth", "good", "bad", "events")

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.depth, self.good, self.bad = ["#"], [-1], [0], [0], [0]
        self.events: list[tuple[int, str | None]] = []
        stack, opened, quotes = [0], {"#": 1}, True
        pos, n = 0, len(html)

        def shut(upto: str | None = None, one_of: tuple[str, ...] = ()) -> None:
            while len(stack) > 1:
                t = self.tag[stack.pop()]
                opened[t] -= 1
                if t in BLOCK:
                    self.events.append((stack[-1], None))
                if t == upto or t in one_of:
                    return

        while pos < n:
            m = _tag.search(html, pos)
            if not m:
                self.events.append((stack[-1], html[pos:]))
                break
            if m.start() > pos:
                self.events.append((stack[-1], html[pos : m.start()]))
            if m.group(1):
                end = html.find("-->", m.start() + 4)
                pos = n if end < 0 else end + 3
                continue
            if m.group(2):
                end = html.find(">", m.end())
                pos = n if end < 0 else end + 1
                continue
            r = _rest.match(html, m.end()) if quotes else None
            if r is None:
                quotes = False  # an open quote: none closes after here, so tags end at the next >
                end = html.find(">", m.end())
                end = n if end < 0 else end + 1
            else:
                end = r.end()
            name = m.group(4).lower()
            pos = end
            if m.group(3):
                if opened.get(name):
                    shut(name)
                continue
            if name in CLOSES_P and opened.get("p"):
                k = len(stack) - 1
                while k > 0 and self.tag[stack[k]] not in BLOCK:
                    k -= 1
                if self.tag[stack[k]] == "p":
                    shut("p")
            elif name in CLOSES and self.tag[stack[-1]] in CLOSES[name]:
                shut(None, CLOSES[name])
            attrs = html[m.end() : end]
            good = bad = 0
            if len(attrs) > 4:
                for v in _attr.findall(attrs):
                    own = {t.lower() for t in _token.findall(v[0] or v[1] or v[2])}
                    good += bool(own & GOOD)
                    bad += bool(own & BAD)
                bad += bool(_hidden.search(attrs))
            if name in BLOCK:
                self.events.append((stack[-1], None))
            if name in VOID:
                continue
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.good.append(good)
            self.bad.append(bad)
            if name in TEXT_ONLY:
                e = re.compile(rf"</{name}[\s/>]", re.I).search(html, pos)
                close = e.start() if e else n
                self.events.append((len(self.tag) - 1, html[pos:close]))
                end = html.find(">", close)
                pos = n if end < 0 else end + 1
                continue
            if not attrs.endswith("/>"):
                stack.append(len(self.tag) - 1)
                opened[name] = opened.get(name, 0) + 1


def features(t: Tree) -> np.ndarray:
    n = len(t.tag)
    parent = np.array(t.parent)
    text, punct, cue, here = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    last = 0.0
    for i, s in t.events:
        if s is not None:
            k = len(s) - s.count(" ")
            text[i] += k
            punct[i] += s.count(".") + s.count(",")
            cue[i] += CUES.search(s) is not None
            if not here[i]:
                here[i] = last + 1
            last += k
    group = np.array([_group.get(x, 17) for x in t.tag])
    link = np.where(group == 11, 1.0, 0.0)
    good, bad, depth = np.array(t.good, float), np.array(t.bad, float), np.array(t.depth, float)
    kids, index, tags, ptext = np.zeros(n), np.zeros(n), np.ones(n), np.zeros(n)
    sub, subl, subp, subpara = text.copy(), text * link, punct.copy(), np.where(group == 2, text, 0)
    p = t.parent
    for i in range(n - 1, 0, -1):  # children come after parents
        j = p[i]
        sub[j] += sub[i]
        subp[j] += subp[i]
        subl[j] += sub[i] if link[i] else subl[i]
        subpara[j] += sub[i] if group[i] == 2 else subpara[i]
        tags[j] += tags[i]
        kids[j] += 1
        cue[j] += cue[i]
        if here[i] and (not here[j] or here[i] < here[j]):
            here[j] = here[i]
        if group[i] == 2:
            ptext[j] += sub[i]
    in_good, in_bad, in_link, in_list = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    in_article, in_edge, in_form, count = np.zeros(n), np.zeros(n), np.zeros(n), [0] * n
    for i in range(1, n):
        j = p[i]
        g = group[j]
        index[i] = count[j]
        count[j] += 1
        in_good[i] = in_good[j] + good[j]
        in_bad[i] = in_bad[j] + bad[j]
        in_link[i] = in_link[j] or g == 11
        in_list[i] = in_list[j] or g == 9
        in_article[i] = in_article[j] or g == 0
        in_edge[i] = in_edge[j] or g in (4, 5, 6, 7)
        in_form[i] = in_form[j] or g == 8
    total = max(1.0, sub[0])
    par = np.maximum(parent, 0)
    log = np.log1p
    x = np.stack([group, good, bad, depth, log(text), log(sub), subl / np.maximum(sub, 1), sub / tags, kids, index, kids[par], sub / total, sub / np.maximum(sub[par], 1), subp / np.maximum(sub, 1), log(ptext), in_good, in_bad, in_link, in_list, in_article, in_edge, in_form, group[par], log(sub[par]), subl[par] / np.maximum(sub[par], 1), good[par], bad[par], subpara / np.maximum(sub, 1), tags, np.full(n, log(total)), cue, here / total, (here + sub) / total], 1)
    return x


OUT, IN, CUT = 0, 1, 2


def decode(t: Tree, margin: np.ndarray) -> np.ndarray:
    """The labels of greatest sum: below outside stand outside and article, below article stand article and cut, below
    cut stands cut. Inline elements in running text, without a telling name, weigh nothing, so they get the label of what they stand in."""
    n = len(t.tag)
    running, flows = [False] * n, [False] * n
    for i, s in t.events:
        running[i] |= s is not None and not s.isspace()
    for i in range(1, n):
        flows[i] = t.tag[i] not in BLOCK and not t.bad[i] and (running[t.parent[i]] or flows[t.parent[i]])
    raw = [False] * n
    for i in range(1, n):
        raw[i] = t.tag[i] in RAW or raw[t.parent[i]]
    yes = -np.logaddexp(0, -margin)
    no = -np.logaddexp(0, margin)
    score = []
    for x, a, b, flow in zip(raw, no.tolist(), yes.tolist(), flows, strict=True):
        score.append([a, -1e6, a] if x else [0.0, 0.0, 0.0] if flow else [a, b, a])
    p = t.parent
    for i in range(n - 1, 0, -1):
        o, k, c = score[i]
        up = score[p[i]]
        up[OUT] += max(o, k)
        up[IN] += max(k, c)
        up[CUT] += c
    out = [OUT] * n
    out[0] = IN if score[0][IN] > score[0][OUT] else OUT
    for i in range(1, n):
        o, k, c = score[i]
        above = out[p[i]]
        out[i] = CUT if above == CUT else (IN if k > o else OUT) if above == OUT else (IN if k >= c else CUT)
    return np.array(out)


def text_of(t: Tree, labels: np.ndarray) -> str:
    return " ".join("".join(" " if s is None else unescape(s) if labels[i] == IN else "" for i, s in t.events).split())


MARK = "\x01"


def marked(n: int, seed: int) -> list[tuple[str, str]]:
    """Pages made by rule: (html, main text). Every run of main text starts with MARK. Articles stand in elements of many kinds, with and
    without telling names, and straight in the body, beside and around menus, headers, footers, asides, notices, adverts, forms and
    comments; some pages hold the article alone."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    chance = lambda q: r.random() < q
    word = lambda: "".join(pick(["an", "er", "on", "th", "e", "in", "o", "re", "la", "sch", "qu", "é", "&"]) for _ in range(int(r.integers(1, 4)))) + pick(["", "", "", "", ".", ",", "###", "!!"])
    many = lambda a, b: " ".join(word() for _ in range(int(r.integers(a, b))))
    esc = lambda s: escape(s, False)
    main: list[str] = []

    def keep(s: str) -> str:
        main.append(s)
        return MARK + esc(s)

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{esc(many(1, 4))}</a></li>' for _ in range(k)) + "</ul>"

    def cls(names: str) -> str:
        return f' {pick(["class", "id"])}="{pick(names.split())}"'

    def plain() -> str:
        """No name, or one that tells nothing."""
        return cls("c1 x7 col row wrap left right inner box grid container page") if chance(0.4) else ""

    def notice() -> str:
        return pick(["&copy; 2020 {}", "Copyright 2021 {}", "{}. All rights reserved.", "Subscribe to our newsletter {}", "We use cookies {}", "About us {}", "Privacy policy {}", "Advertisement {}", "Log in {}"]).replace("{}", esc(many(0, 6)))

    def junk() -> str:
        k = int(r.integers(15))
        t = esc(many(2, 25))
        if k == 0:
            return f"<nav{cls('nav menu top-nav') if chance(0.5) else ''}>{links(int(r.integers(2, 9)))}</nav>"
        if k == 1:
            return f"<div{cls('nav menu navbar main-menu breadcrumbs')}>{links(int(r.integers(2, 7)))}</div>"
        if k == 2:
            return f"<div{cls('ad ads advert banner sponsored ad-slot promo')}>" + (f"<p>{t}</p>" if chance(0.4) else t) + "</div>"
        if k == 3:
            return f"<aside{cls('sidebar side widget') if chance(0.6) else ''}><h3>{esc(many(1, 4))}</h3>" + (f"<p>{t}</p>" if chance(0.6) else links(4)) + "</aside>"
        if k == 4:
            return f"<div{cls('cookie cookie-notice notice consent gdpr')}><p>{t}</p><button>OK</button></div>"
        if k == 5:
            return f'<form{cls("search signup newsletter login") if chance(0.6) else ""} action="/go"><label>{t}</label><input name="q"><button>{word()}</button></form>'
        if k == 6:
            tag = pick(["div", "section", "ol", "ul"])
            inner = "li" if tag in ("ol", "ul") else "div"
            one = lambda: f"<{inner} class=\"{pick(['comment', 'reply', 'c'])}\"><p>{esc(many(3, 40))}</p></{inner}>" if chance(0.7) else f"<p>{esc(many(3, 40))}</p>"
            return f"<{tag}{cls('comments comment-list discussion respond')}>" + (f"<h3>{esc(many(1, 4))}</h3>" if tag in ("div", "section") else "") + "".join(one() for _ in range(int(r.integers(1, 6)))) + f"</{tag}>"
        if k == 7:
            return f"<div{cls('related recommended share social tags')}>{links(3)}</div>"
        if k == 8:
            return f'<script>var x="</p>";{word()}</script><style>p{{margin:0}}</style>'
        if k == 9:
            return f"<!-- {t} --><noscript><p>{t}</p></noscript>"
        if k == 10:
            return f"<div{cls('sidebar side-bar widget')}><p>{t}</p>{links(3)}</div>"
        if k == 11:  # links in a row, without a name
            return f"<{(tag := pick(['div', 'p', 'center']))}{plain()}>" + pick([" ", " | ", "<br>"]).join(f'<a href="/{i}">{esc(many(1, 3))}</a>' for i in range(int(r.integers(2, 9)))) + f"</{tag}>"
        if k == 12:
            return f"<div{plain()}>{links(int(r.integers(3, 9)))}</div>"
        return f"<{(tag := pick(['div', 'p', 'small']))}{plain()}>{notice()}</{tag}>"

    def formula() -> str:
        a, b, c = many(3, 15), word(), many(3, 15)
        inner = pick(["<math><mi>{}</mi></math>", "<math><mrow><mo>{}</mo></mrow></math>", "<svg viewBox='0 0 9 9'><text>{}</text></svg>", "<code>{}</code>", "<span>{}</span>", "<canvas>{}</canvas>", "<object>{}</object>", "<x-note>{}</x-note>"])
        return f"<p>{keep(a)} {inner.replace('{}', keep(b))} {keep(c)}</p>"

    def block(short: bool, wide: bool, inside: bool) -> str:
        if inside and chance(0.06):  # articles may speak like notices
            return f"<p>{pick(['', '<b>'])}{keep(unescape(notice()))}" + pick(["</p>", "<br>"])
        k = int(r.integers(15))
        long = (1, 12) if short else (30, 260) if wide else (5, 90)
        if k == 0:
            return f"<h2>{keep(many(1, 8))}</h2>"
        if k == 1:
            return "<ul>" + "".join(f"<li>{keep(many(2, 15))}</li>" for _ in range(int(r.integers(2, 5)))) + "</ul>"
        if k == 2:
            return f"<blockquote><p>{keep(many(4, 30))}</p></blockquote>"
        if k == 3:
            return f"<p><b>{keep(many(3, 20))}<br>"
        if k == 4:
            return f'<p>{keep(many(2, 15))} <a href="/x">{keep(many(1, 3))}</a> {keep(many(2, 15))}</p>'
        if k == 5:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(many(1, 5))}</td>" for _ in range(3)) + "</tr>" for _ in range(int(r.integers(1, 5)))) + "</table>"
        if k == 6:
            return f"<div><p>{keep(many(5, 50))}</p></div>"
        if k == 7:
            return formula()
        if k == 8:
            return f"<pre>{keep(many(3, 30))}</pre>"
        if k == 9:
            return f"<figure><img src='a.png'><figcaption>{keep(many(2, 12))}</figcaption></figure>"
        return f"<p>{keep(many(*long))}" + ("</p>" if chance(0.8) else "")

    def article(loose: bool, inside: bool) -> str:
        """A title and blocks; loose: text with line breaks, without paragraphs."""
        if loose:
            head = f"<h1>{keep(many(1, 8))}</h1>" if chance(0.5) else ""
            return head + pick(["<br>", "<br><br>"]).join(keep(many(5, 80)) for _ in range(int(r.integers(1, 7))))
        body = [f"<h1>{keep(many(1, 8))}</h1>"] if chance(0.75) else []
        if body and chance(0.15):
            body = [f"<header>{body[0]}</header>"]
        short, wide = chance(0.25), chance(0.15)
        for _ in range(int(r.integers(1, 9)) if chance(0.9) else 1):
            if chance(0.1):
                body.append(junk())
            body.append(block(short, wide, inside))
        if chance(0.15):
            body.append(junk())
        if inside and chance(0.15):
            body.append(f"<p>{keep(unescape(notice()))}</p>")
        return "".join(body)

    out = []
    for _ in range(n):
        main.clear()
        named = cls("content article post entry post-body main-content story article-text")
        shell = pick(["<article>", "<article{}>", "<main>", "<main><article>", "<div{}>", "<div{}>", '<div role="main">', "<section{}>", "<div{}><div>", "<div>", "<div>", "<div><div>", "<section>", "<center>", "", "", "", ""]).replace("{}", named if chance(0.7) else plain())
        close = "".join(f"</{re.match('[a-z]+', x)[0]}>" for x in reversed(shell.split("<")[1:]))
        head = [junk() for _ in range(int(r.integers(0, 5)))]
        if chance(0.5):
            head.insert(0, f"<header{cls('header top site-header') if chance(0.5) else ''}><h1>{esc(many(1, 4))}</h1>" + (junk() if chance(0.5) else f"<p>{esc(many(2, 9))}</p>") + "</header>")
        inner = shell + article(chance(0.12), shell != "") + close
        foot = [junk() for _ in range(int(r.integers(0, 4)))]
        if chance(0.6):
            foot.append(f"<footer{cls('footer site-footer') if chance(0.4) else ''}>&copy; {esc(many(2, 20))}</footer>")
        elif chance(0.7):
            foot.append(f"<div{cls('footer copyright legal') if chance(0.5) else plain()}>{notice()}</div>")
        alone = chance(0.15)
        if alone:
            head, foot = [], []
        if not alone and chance(0.12):  # a layout table
            cells = ["".join(head), inner, "".join(foot)]
            page = "<table>" + ("".join(f"<tr><td>{x}</td></tr>" for x in cells) if chance(0.5) else "<tr>" + "".join(f"<td>{x}</td>" for x in cells) + "</tr>") + "</table>"
        else:
            page = "".join(head) + inner + "".join(foot)
        if chance(0.35):
            page = f"<div{plain()}>{page}</div>"
        if chance(0.85):
            page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(many(1, 8))}</title></head><body>{page}</body></html>"
        elif chance(0.5):
            page = f"<body>{page}</body>"
        out.append((page, " ".join(" ".join(main).split())))
    return out


def composed(n: int, seed: int) -> list[tuple[str, str]]:
    return [(html.replace(MARK, ""), main) for html, main in marked(n, seed)]


def train(pages: list[tuple[str, str]]) -> gbdt.Trees:
    """Trees from marked pages. An element counts as article if most of its own text does, or else most of the text below it. Elements
    with more text below weigh more, by the root of its length."""
    xs, ys, ws = [], [], []
    for html, _ in pages:
        t = Tree(html)
        n = len(t.tag)
        has, miss, own = np.zeros(n), np.zeros(n), np.zeros(n)
        for i, s in t.events:
            if s is not None and s.strip():
                size = len(s.replace(MARK, "").strip())
                (has if MARK in s else miss)[i] += size
                own[i] += size if MARK in s else -size
        for i in range(n - 1, 0, -1):
            has[t.parent[i]] += has[i]
            miss[t.parent[i]] += miss[i]
        t.events = [(i, s if s is None else s.replace(MARK, "")) for i, s in t.events]
        xs.append(features(t))
        ys.append(np.where(own > 0, True, (own == 0) & (has > 0) & (has >= 2 * miss)).astype(float))
        ws.append(1 + np.sqrt(has + miss) / 16)
    return gbdt.fit(np.concatenate(xs), np.concatenate(ys), trees=60, depth=5, weight=np.concatenate(ws))


def trained(n: int = 1600, seed: int = 7) -> gbdt.Trees:
    return train(marked(n, seed))


@lru_cache(maxsize=1)
def default_trees() -> gbdt.Trees:
    """The stored trees of trained()."""
    got = models.load("html_text")
    return gbdt.Trees(got["feature"], got["cut"], got["value"], float(got["base"]))


#: Characters of paragraphs outside menus, footers, asides and forms from which a page is taken to have a main text.
PROSE = 120


def _prose(t: Tree) -> int:
    edge, para = [False] * len(t.tag), [False] * len(t.tag)
    for i in range(1, len(t.tag)):
        g = _group.get(t.tag[i], 17)
        edge[i] = edge[t.parent[i]] or g in (4, 6, 7, 8, 11, 15)
        para[i] = para[t.parent[i]] or g == 2
    return sum(len(s.strip()) for i, s in t.events if s and para[i] and not edge[i])


def extract(htmls: list[str], trees: gbdt.Trees) -> list[str]:
    """The main texts. Where names leave nothing of a page with prose, it is read again without its names."""
    parsed = [Tree(h) for h in htmls]
    if not parsed:
        return []
    xs = [features(t) for t in parsed]
    margins = trees.margin(np.concatenate(xs))
    out, at = [], 0
    for t, x in zip(parsed, xs, strict=True):
        text = text_of(t, decode(t, margins[at : at + len(x)]))
        if not text and _prose(t) >= PROSE:
            t.good, t.bad = [0] * len(t.tag), [0] * len(t.tag)
            text = text_of(t, decode(t, trees.margin(features(t))))
        out.append(text)
        at += len(x)
    return out


def main_text(pages: DataFrame, trees: gbdt.Trees | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    trees = trees or default_trees()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                texts = extract([x or "" for x in part.column("html").to_pylist()], trees)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, f"page_id {kinds[key]}, url {kinds[url]}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The given pages hold their main text in one element `article` of paragraphs, so that SQL can say what their text is.
SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&amp<', '&amp;<'), '<b>', ''), '</b>', ''), '</?(?:p|h1|br)>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, url, t AS text, length(t) AS n_chars FROM c
"""
