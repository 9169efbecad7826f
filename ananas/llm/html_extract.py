"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks (runs of text between tags that start or end a block), each with
the tags, class names and roles of its ancestors and features of its text. The field labels the
blocks as article or not, with weights for features and for neighbours' labels; Viterbi finds the
best labels of a page, and the article's blocks are its text.

Labelled pages: a bounded sample of the table's own pages that mark their article themselves
(``article`` or ``main``, without menus and the like in it), and as many pages again that dress
the sampled blocks in other templates, in which a place is known by a class name, a role or the
text alone. Nothing but the sample's texts and the fixed values below goes into those.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages the model learns from, at most, and the longest of them in characters.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 1 << 15
#: Pages dressed from the sample, at most this many blocks each.
DRESSED_PAGES, PAGE_BLOCKS = 480, 120
#: A feature counts if this many blocks of the labelled pages have it.
LEAST_BLOCKS = 3
RIDGE, STEPS, RATE = 0.05, 160, 0.15

# Elements that start and end a block; elements without an end tag; elements whose
# content is no text of the page (the first list's content has no tags, by the HTML standard).
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html ins legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("template noscript svg math select datalist object audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style|data-y)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
_END = ".!?…。！？:;\"'”’»)"


@dataclass
class Block:
    text: str
    tag: str
    around: frozenset[str]
    linked: int
    label: int | None


def _own(tag: str, attrs: str) -> tuple[frozenset[str], int | None]:
    """Features an element gives to what is in it, and its label if it has one."""
    out, label = {f"t:{tag}"}, None
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "data-y":
            label = int(value or 0)
        elif name == "style":
            if "none" in value and "display" in value.replace(" ", ""):
                out.add("x:hidden")
        elif name in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                out.add("x:hidden")
        else:
            out.update(f"c:{w.lower()}" for w in _PART.findall(value))
    return frozenset(out), label


def leaf_blocks(page: str | None, known: Iterable[str] | None = None) -> Iterator[Block]:
    """Leaf blocks in page order; one pass, time and memory in proportion to the page.

    Character references are decoded, white space (line breaks by ``br`` too) becomes one blank.
    A tag that the page ends in, and an unfinished comment, script or style, has no text.
    ``known``: the only ancestor features to keep (else a page could have any number of them).
    """
    page = page or ""
    root: tuple[str, frozenset[str], int | None] = ("", frozenset(), None)
    stack, counts = [root], Counter()
    pieces: list[str] = []
    own: dict[tuple[str, str], tuple[frozenset[str], int | None]] = {}
    endless: set[str] = set()
    link, linked, at, end = False, 0, 0, len(page)

    def flush() -> Block | None:
        nonlocal linked
        if not pieces:
            return None
        text, chars = " ".join("".join(pieces).split()), linked
        pieces.clear()
        linked = 0
        top = stack[-1]
        return Block(text, top[0], top[1], chars, top[2]) if text else None

    def pop() -> None:
        counts[stack.pop()[0]] -= 1

    while at < end:
        lt = page.find("<", at)
        text = page[at:] if lt < 0 else page[at:lt]
        if text:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            if link:
                linked += len(text)
        if lt < 0:
            break
        first = page[lt + 1 : lt + 2]
        if first in ("!", "?"):
            stop = page.find("-->", lt + 2) + 2 if page.startswith("<!--", lt) else page.find(">", lt + 2)
            if stop < lt + 2:
                break
            at = stop + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if first == "/" and not page[lt + 2 : lt + 3].isalpha():
                at = (page.find(">", lt) + 1) or end
            elif first == "/" or (first.isalpha() and first.isascii()):
                break
            else:
                pieces.append("<")
                at = lt + 1
            continue
        at, closing, tag = m.end(), bool(m[1]), m[2].lower()
        if tag == "a":
            link = not closing
        elif tag == "br":
            pieces.append(" ")
        elif not closing and (tag in RAW or tag in UNSEEN):
            gone = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at) if tag not in endless else None
            if gone:
                at = gone.end()
            elif tag in RAW:
                break
            else:
                endless.add(tag)
        elif tag in BLOCKS:
            if b := flush():
                yield b
            if closing:
                if counts[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if stack[-1][0] == "p":
                pop()
            while stack[-1][0] in ENDS.get(tag, ()):
                pop()
            if tag in VOID:
                continue
            key = tag, m[3]
            if key not in own:
                if len(own) > 4096:
                    own.clear()
                own[key] = _own(*key)
            more, label = own[key]
            more = more if known is None else more & known
            above = stack[-1]
            stack.append((tag, above[1] if more <= above[1] else above[1] | more, above[2] if label is None else label))
            counts[tag] += 1
    if b := flush():
        yield b


def text_features(blocks: list[Block]) -> list[list[str]]:
    """Features of each block beside those of its ancestors: its own element, length, links, signs,
    its place in the page, and whether a heading, its own or the last one, has a word of ``AFTERS``."""
    out, after = [], False
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        size = sum(words >= x for x in (2, 5, 10, 20, 50))
        links = sum(b.linked >= x * len(b.text) for x in (0.01, 0.4, 0.8))
        f = [f"p:{b.tag}", f"w:{size}", f"l:{links}", f"w:{size}/l:{links}", f"p:{b.tag}/w:{size}"]
        f.append("e:end" if b.text[-1] in _END else "e:open")
        if any(s in b.text for s in "©|·»®"):
            f.append("s:sign")
        if 5 * sum(c.isdigit() for c in b.text[:64]) > min(len(b.text), 64):
            f.append("s:digits")
        f.append("at:first" if k == 0 else "at:last" if k == len(blocks) - 1 else "at:in")
        if b.tag in HEADINGS:
            after = words <= 4 and any(w.lower() in AFTERS for w in _PART.findall(b.text))
            f.append(f"h:{int(after)}")
        elif after:
            f.append("h:under")
        out.append(f)
    return out


@dataclass
class Model:
    """Weights of features for the label article; ``start`` and ``step`` (from, to) for the labels."""

    weights: dict[str, float]
    start: np.ndarray
    step: np.ndarray
    sums: dict[frozenset[str], float] = field(default_factory=dict)

    def labels(self, blocks: list[Block]) -> list[int]:
        """Viterbi: the best labels of a page's blocks; article only where it scores higher."""
        if not blocks:
            return []
        w, sums = self.weights, self.sums
        a0, a1 = float(self.start[0]), float(self.start[1])
        (s00, s01), (s10, s11) = self.step.tolist()
        back = []
        for k, (b, own) in enumerate(zip(blocks, text_features(blocks))):
            score = sums.get(b.around)
            if score is None:
                if len(sums) > 65536:
                    sums.clear()
                score = sums[b.around] = sum(w.get(f, 0.0) for f in sorted(b.around))
            score += sum(w.get(f, 0.0) for f in own)
            if k:
                from0, from1 = a1 + s10 > a0 + s00, a1 + s11 > a0 + s01
                back.append((from0, from1))
                a0, a1 = (a1 + s10 if from0 else a0 + s00), (a1 + s11 if from1 else a0 + s01)
            a1 += score
        out = [int(a1 > a0)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def train(pages: list[list[tuple[list[str], int]]], ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """Maximum likelihood with a ridge penalty, by gradients from the forward-backward sums.

    ``pages``: of each page its blocks as (features, label); pages without a block are left out.
    """
    pages = [p for p in pages if p]
    seen = Counter(f for p in pages for x, _ in p for f in x)
    names = sorted(f for f, n in seen.items() if n >= LEAST_BLOCKS)
    place = {f: i for i, f in enumerate(names)}
    flat = [(x, y) for p in pages for x, y in p]
    row = np.array([r for r, (x, _) in enumerate(flat) for f in x if f in place], dtype=np.int64)
    col = np.array([place[f] for x, _ in flat for f in x if f in place], dtype=np.int64)
    y = np.array([y for _, y in flat], dtype=np.int64)
    size = np.array([len(p) for p in pages], dtype=np.int64)
    if not len(size):
        return Model({}, np.zeros(2), np.zeros((2, 2)))
    longest, n = int(size.max()), len(size)
    slot = np.concatenate([k * longest + np.arange(m) for k, m in enumerate(size)])
    here = np.zeros(n * longest, dtype=bool)
    here[slot] = True
    here = here.reshape(n, longest)
    first, lasting = y[np.r_[0, np.cumsum(size)[:-1]]], np.flatnonzero(np.diff(np.repeat(np.arange(n), size)) == 0)
    want_start = np.bincount(first, minlength=2).astype(float)
    want_step = np.bincount(2 * y[lasting] + y[lasting + 1], minlength=4).astype(float).reshape(2, 2)
    x = np.zeros(len(names) + 6)
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, start, step = x[:-6], x[-6:-4], x[-4:].reshape(2, 2)
        own = np.zeros((n * longest, 2))
        own[slot, 1] = np.bincount(row, weights=w[col], minlength=len(y))
        own = own.reshape(n, longest, 2)
        ahead, behind = np.zeros_like(own), np.zeros_like(own)
        ahead[:, 0] = start + own[:, 0]
        for k in range(1, longest):
            ahead[:, k] = np.where(here[:, k, None], np.logaddexp(ahead[:, k - 1, :1] + step[0], ahead[:, k - 1, 1:] + step[1]) + own[:, k], ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            on = own[:, k + 1] + behind[:, k + 1]
            behind[:, k] = np.where(here[:, k + 1, None], np.logaddexp(step[:, 0] + on[:, :1], step[:, 1] + on[:, 1:]), 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.exp(ahead + behind - total[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + step + (own + behind)[:, 1:, None, :] - total[:, None, None, None])
        pair[~here[:, 1:]] = 0.0
        gap = y - p.reshape(-1, 2)[slot, 1]
        grad = np.r_[np.bincount(col, weights=gap[row], minlength=len(names)), want_start - p[:, 0].sum(axis=0), (want_step - pair.sum(axis=(0, 1))).ravel()] - ridge * x
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        x += RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Model({f: float(v) for f, v in zip(names, x)}, x[-6:-4].copy(), x[-4:].reshape(2, 2).copy())


# Elements and names by which pages mark their parts, and lines that stand in them.
PARTS = {
    "menu": ("nav div ul header", "nav menu navbar navigation main-menu site-nav breadcrumbs pagination toc links"),
    "header": ("header div", "header masthead site-header top-bar branding logo page-head"),
    "footer": ("footer div", "footer site-footer copyright colophon bottom legal imprint"),
    "sidebar": ("aside div section", "sidebar side widget right-column rail related popular recommended trending read-more"),
    "notice": ("div section aside dialog", "notice cookie cookie-banner consent gdpr alert popup modal overlay paywall message toast subscribe warning disclaimer"),
    "advert": ("div aside section ins", "ad ads advert advertisement sponsor sponsored promo promotion adsbygoogle ad-slot"),
    "form": ("form", "search login contact newsletter signup feedback"),
    "comments": ("section div ol ul", "comments comment-list responses replies discussion disqus comment-thread reader-comments"),
    "share": ("div ul p", "share social sharing follow tags meta byline author author-box post-meta"),
}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "search", "notice": "alert"}
PLACES = ("article main div section", "content article post entry main story text page-content article-body post-content entry-content main-content")
LINES = {
    "footer": ["© 2024 All rights reserved.", "Privacy · Terms · Contact", "Imprint | About us"],
    "notice": ["We use cookies to give you the best experience.", "Accept all", "Subscribe to read the full story.", "This site needs JavaScript."],
    "advert": ["Advertisement", "Sponsored", "Buy now and save 20%"],
    "form": ["Search", "Your name", "Your email", "Send", "Sign up"],
    "share": ["Share this", "By the editors", "12 May 2024", "5 min read", "Tags"],
}
TITLES = {"sidebar": ["Related", "Popular", "Most read", "More stories"], "comments": ["Comments", "3 comments", "Leave a reply", "Discussion"]}
AFTERS = frozenset("related popular read stories comments comment reply replies responses discussion share follow newsletter subscribe tags".split())


def _dressed(rng: random.Random, texts: list[str], others: list[str]) -> str:
    """A page in a template of its own, each part marked by ``data-y`` (1: article)."""
    esc = lambda t: entities.escape(t)
    few = lambda: " ".join(rng.choice(others).split()[: rng.randint(1, 3)]) or "x"
    link = lambda: f'<a href="/{rng.randint(1, 99)}">{esc(few())}</a>'
    plain = rng.random() < 0.1  # nothing but the text tells; else its length may mislead

    def para() -> str:
        words = rng.choice(texts).split()
        if not plain and rng.random() < 0.5:
            at, n = rng.randrange(len(words)), rng.randint(1, 14)
            words = words[at : at + n]
        out = esc(" ".join(words))
        if rng.random() < 0.2:  # a link within the text
            out += f" {link()} " + esc(" ".join(words[:3]))
        return out

    def line() -> str:
        return para() if not plain and rng.random() < 0.3 else esc(rng.choice(others))


    def part(kind: str, inner: str) -> str:
        tags, names = PARTS[kind]
        tag, mark = rng.choice(tags.split()), ""
        bare = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        if plain:
            tag = "form" if kind == "form" else "div"
        elif not bare or rng.random() < 0.5:
            name = rng.choice(names.split())
            mark = f' {rng.choice(["class", "class", "id"])}="{name}"'
            if kind in ROLES and rng.random() < 0.15:
                mark = f' role="{ROLES[kind]}"'
        return f'<{tag}{mark} data-y="0">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>" if rng.random() < 0.7 else " | ".join(link() for _ in range(n))

    def lines(kind: str) -> str:
        found = [f"<p>{esc(t) if rng.random() < 0.6 else line()}</p>" for t in rng.sample(LINES[kind], rng.randint(1, 2))]
        if kind == "form":
            found = [f'<label>{esc(t)}</label><input name="q">' for t in rng.sample(LINES[kind], 2)] + ["<button>OK</button>"]
        return "".join(found)

    def comments() -> str:
        one = lambda: rng.choice(["div", "li", "article"])
        out = [f"<h3>{rng.choice(TITLES['comments'])}</h3>"] if rng.random() < 0.7 else []
        for _ in range(rng.randint(1, 4)):
            tag, mark = one(), rng.choice(["", ' class="comment"', ' class="reply"', ' class="comment-body"'])
            out.append(f"<{tag}{'' if plain else mark}><p>{esc(few())}</p><p>{para() if rng.random() < 0.7 else line()}</p></{tag}>")
        return part("comments", "".join(out))

    def aside() -> str:
        body = links(rng.randint(2, 6)) if rng.random() < 0.6 else f"<p>{line()}</p><p>{para()}</p>" if not plain else f"<p>{link()}</p>"
        return part("sidebar", f"<h3>{rng.choice(TITLES['sidebar'])}</h3>{body}")

    title = esc(rng.choice(others + texts)[:80])
    head = f"<h1>{title}</h1>"
    if not plain and rng.random() < 0.25:
        head = f'<header class="{rng.choice(["entry-header", "post-header", "article-header"])}">{head}</header>'
    main = [head]
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.72:
            main.append(f"<p>{para()}</p>")
        elif kind < 0.78:
            main.append(f"<h2>{esc(few())}</h2><p>{para()}</p>")
        elif kind < 0.83:
            main.append("<ul>" + "".join(f"<li>{line() if rng.random() < 0.5 else para()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
        elif kind < 0.87:
            main.append(f"<blockquote>{para()}</blockquote>")
        elif kind < 0.9:
            main.append(f"<p><b>{esc(few())}<br><p>{para()}</p>")
        elif kind < 0.93:
            main.append(f'<figure><img src="a"><figcaption>{line()}</figcaption></figure>')
        elif kind < 0.96:
            main.append(f"<table><tr><td>{esc(few())}</td><td>{line()}</td></tr></table>")
        else:
            main.append(part(rng.choice(["advert", "share", "notice", "form"]), lines(rng.choice(["advert", "share", "notice"]))))
    if rng.random() < 0.2:
        main.insert(1, part("share", lines("share")))
    if rng.random() < 0.25:
        main.append(comments())
    if rng.random() < 0.15:
        main.append(aside())
    tag, name = rng.choice(PLACES[0].split()), rng.choice(PLACES[1].split())
    mark = "" if plain or (tag in ("article", "main") and rng.random() < 0.6) else f' {rng.choice(["class", "id"])}="{name}"'
    tag = "div" if plain else tag
    body = f'<{tag}{mark} data-y="1">{"".join(main)}</{tag}>'
    if not plain and tag != "main" and rng.random() < 0.2:
        body = f"<main>{body}{comments() if rng.random() < 0.4 else ''}{aside() if rng.random() < 0.4 else ''}</main>"
    top = [part("notice", lines("notice"))] if rng.random() < 0.3 else []
    if rng.random() < 0.5:
        top.append(part("header", f"<p>{esc(few())}</p>" + (links(3) if rng.random() < 0.4 else "")))
    if rng.random() < 0.85:
        top.append(part("menu", links(rng.randint(2, 8))))
    for kind, chance in (("advert", 0.4), ("form", 0.3)):
        if rng.random() < chance:
            top.append(part(kind, lines(kind)))
    after = [part("share", lines("share"))] if rng.random() < 0.2 else []
    after += [aside()] if rng.random() < 0.4 else []
    after += [comments()] if rng.random() < 0.35 else []
    after += [part("form", lines("form"))] if rng.random() < 0.2 else []
    after += [part("notice", lines("notice"))] if rng.random() < 0.2 else []
    if rng.random() < 0.85:
        after.append(part("footer", rng.choice([f"© {rng.randint(1999, 2030)} {esc(few())} · {line()}", lines("footer"), links(3)])))
    sides = [aside()] if rng.random() < 0.15 else []
    return f'<html><head><title>{title}</title></head><body data-y="0">{"".join(top + sides)}{body}{"".join(after)}</body></html>'


_NOT_ARTICLE = frozenset(f"t:{t}" for t in "nav aside footer form dialog".split())
_ARTICLE = frozenset(["t:article", "t:main"])


def _marked(page: str) -> list[tuple[Block, int]]:
    """Blocks of a page labelled by its own ``article`` or ``main`` elements; none if it has neither."""
    blocks = list(leaf_blocks(page))
    out = [(b, int(bool(b.around & _ARTICLE) and not b.around & _NOT_ARTICLE)) for b in blocks]
    return out if any(y for _, y in out) else []


def labelled_pages(pages: list[str], dressed: int = DRESSED_PAGES, seed: int = 11) -> list[list[tuple[list[str], int]]]:
    """Pages to learn from, as ``train`` takes them: those of ``pages`` that mark their article, and
    ``dressed`` more in other templates. Without any, the fixed lines fill the templates."""
    marked = [m[:PAGE_BLOCKS] for m in (_marked(p) for p in pages) if m]
    texts = sorted({b.text for m in marked for b, y in m if y}) or ["A sentence of an article, long enough to be told from a menu or a line of links."]
    others = sorted({b.text for m in marked for b, y in m if not y} | {x for v in LINES.values() for x in v})
    rng = random.Random(seed)
    out = []
    for m in marked:
        features = text_features([b for b, _ in m])
        out.append([(f + sorted(b.around), y) for f, (b, y) in zip(features, m)])
    for _ in range(dressed):
        blocks = list(leaf_blocks(_dressed(rng, texts, others)))[:PAGE_BLOCKS]
        out.append([(f + sorted(b.around), b.label or 0) for f, b in zip(text_features(blocks), blocks)])
    return out


def train_on(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    """A model for the templates of ``pages``, from at most ``sample`` of them: those of least hash over
    the row, so that copies of a page under many ids have no more than their share. Only about four
    times as many rows, by a bound on the hash, leave their tasks."""
    share = min(1.0, 4 * sample / max(pages.count(), 1))
    x = F.pmod(F.xxhash64(*[c for c, kind in pages.dtypes if "map<" not in kind]), F.lit(1 << 62))
    rows = pages.select(F.col(html).alias("h"), x.alias("x")).filter(F.col("x") < int(share * (1 << 62)))
    found = rows.filter(F.length("h").between(1, SAMPLE_CHARS)).orderBy("x", "h").limit(sample).collect()  # at most ``sample`` pages
    return train(labelled_pages(sorted({r["h"] for r in found})))


def extract_blocks(pages: DataFrame, model: Model, ident: str = "page_id", html: str = "html") -> DataFrame:
    """(ident, block, tag, main, text): every leaf block of every page, numbered from 0, with its label."""
    model, known = Model(model.weights, model.start, model.step), frozenset(model.weights)

    def run(batches):
        for batch in batches:
            for key, page in zip(batch.column(0), batch.column(1)):
                blocks = list(leaf_blocks(page.as_py(), known))
                labels = model.labels(blocks)
                for s in range(0, len(blocks), 4096):
                    part = blocks[s : s + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(part), key.type), pa.array(range(s, s + len(part)), pa.int32()), pa.array([b.tag for b in part], pa.string()), pa.array([y == 1 for y in labels[s : s + 4096]]), pa.array([b.text for b in part], pa.string())],
                        names=["id", "block", "tag", "main", "text"],
                    )

    kind = pages.schema[ident].dataType.simpleString()
    return pages.select(ident, html).mapInArrow(run, f"id {kind}, block int, tag string, main boolean, text string").withColumnRenamed("id", ident)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars): the article's blocks of each page in page order, joined by an empty line.

    One row for each row of ``pages``, repeated rows too; other columns are not looked at. Null or
    empty html, and a page without an article: an empty text. Whole pages, whatever their length.
    """
    model, known = Model(model.weights, model.start, model.step), frozenset(model.weights)
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches):
        for batch in batches:
            start, held, size = 0, [], 0
            for k in range(batch.num_rows):
                blocks = list(leaf_blocks(batch.column(2)[k].as_py(), known))
                held.append("\n\n".join(b.text for b, y in zip(blocks, model.labels(blocks)) if y))
                size += len(held[-1])
                if size > 1 << 22 or k + 1 == batch.num_rows:
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(held, pa.string()), pa.array([len(t) for t in held], pa.int64())], names=names)
                    start, held, size = k + 1, [], 0

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def learn_and_extract(pages: DataFrame) -> DataFrame:
    """Train on a sample of ``pages`` and extract the main text of all; see ``extract``."""
    return extract(pages, train_on(pages.select("page_id", "url", "html")))
