"""The main text of web pages by a linear-chain conditional random field.

A page is the sequence of its leaf blocks, runs of text that no block element
interrupts. Features are the tags, classes and ids of the ancestors and counts
of the text; the field is trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that lend their texts to the labelled pages at most, those with the least hash.
MAX_LABELLED = 150
VARIANTS = 6
#: Pages of other layouts that few lending pages make at least.
MIN_LAYOUTS = 300
EPOCHS, RATE, PENALTY = 8, 0.8, 1e-5
MAX_TRAIN_BLOCKS = 60

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr br img input button select textarea ruby rt rp".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"}, "optgroup": {"option", "optgroup"},
}
_SCOPE = frozenset("ul ol dl table article section div body main aside nav footer header form blockquote select".split())

#: Marks the blocks of labelled pages that are main text.
LABEL = ""


@dataclass
class Block:
    text: str
    tag: str
    tags: tuple[str, ...]
    names: frozenset[str]
    inner: frozenset[str]
    link_share: float
    main: bool = False


#: Comments and declarations, then tags with quoted values, then tags whose quotes do not close.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"""|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>"""
    r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)(?:>|\Z|(?=<))", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "title", "textarea")}
_NO_NAMES: frozenset[str] = frozenset()


def leaf_blocks(html: str | None, labelled: bool = False) -> list[Block]:
    """The page's runs of text in order, references decoded, white space in a block made one blank.

    End tags that stand for nothing are passed over, a block element ends the
    paragraph around it, and comments, scripts, styles, the head and what the
    end of the page cuts off a tag are no text. In a ``labelled`` page
    :data:`LABEL` marks main text, elsewhere it is a character like others.
    """
    html = html or ""
    stack: list[tuple[str, frozenset[str]]] = []
    blocks: list[Block] = []
    parts: list[str] = []
    links = chars = skipped = in_link = at = 0

    def say(data: str) -> None:
        nonlocal links, chars
        parts.append(unescape(data) if "&" in data else data)  # no reference goes on behind a tag
        n = len(data.strip())
        chars += n
        links += n * bool(in_link)

    def flush() -> None:
        nonlocal links, chars
        if not parts:
            return
        text = " ".join("".join(parts).split())
        if text:
            main = labelled and text[0] == LABEL
            outer = [t for t, _ in stack if t not in _INLINE]
            named = [n for _, n in stack if n]
            blocks.append(Block(
                text.lstrip(LABEL).strip() if main else text, outer[-1] if outer else "", tuple(dict.fromkeys(t for t, _ in stack)),
                _NO_NAMES.union(*named), named[-1] if named else _NO_NAMES, links / max(1, chars), main))
        parts.clear()
        links = chars = 0

    def pop_to(i: int) -> None:
        nonlocal skipped, in_link
        for tag, _ in stack[i:]:
            skipped -= tag in _SKIP
            in_link -= tag == "a"
        del stack[i:]

    size = len(html)
    while at < size:
        found = _MARKUP.search(html, at)
        start = found.start() if found else size
        if start > at and not skipped:
            say(html[at:start])
        if not found:
            break
        at = found.end()
        slash, tag, attrs = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if slash:
            if not inline and tag not in _VOID:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if inline and stack[i][0] not in _INLINE:
                    break
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if not inline:
            flush()
            closes = _CLOSES.get(tag, _NO_NAMES)
            for i in range(len(stack) - 1, -1, -1):
                open_ = stack[i][0]
                if open_ in closes or open_ == "p":
                    pop_to(i)
                elif open_ in _SCOPE:
                    break
        if attrs.endswith("/") and not inline and tag not in _RAW:
            continue
        names = _NO_NAMES
        if "=" in attrs:
            words = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).lower()
            names = frozenset(re.findall("[a-z]+", words)) if words else _NO_NAMES
        if tag in _RAW:  # no markup inside
            end = _RAW[tag].search(html, at)
            if tag == "textarea" and not skipped:
                say(html[at : end.start() if end else size])
            at = end.start() if end else size
            continue
        stack.append((tag, names))
        skipped += tag in _SKIP
        in_link += tag == "a"
    flush()
    return blocks


# Words that notices, forms and footers tend to have.
_CUES = ("©", "copyright", "cookie", "subscri", "newsletter", "sign up", "log in", "privacy", "advert", "sponsor", "share", "comment")
_CUE_CHARS = 160


def context_features(block: Block) -> list[str]:
    """What the elements around a block say of it."""
    return ["", f"tag {block.tag}", *[f"in {t}" for t in block.tags], *[f"name {w}" for w in block.names],
            *[f"inner {w}" for w in block.inner]]


def text_features(block: Block, place: int, n: int) -> list[str]:
    """What the text and its place on the page say."""
    words, text = block.text.count(" ") + 1, block.text
    out = [f"words {min(6, words.bit_length())}", f"links {math.ceil(4 * block.link_share)}", f"ends {text[-1] in '.!?:;'}",
           f"place {5 * place // n}", f"long {words > 12} {block.link_share > 0.3}"]
    if len(text) < _CUE_CHARS:
        low = text.lower()
        out += [f"cue {c}" for c in _CUES if c in low]
    return out


@dataclass
class Field:
    """Weights of features and of steps between labels; 1 is main text."""

    weights: dict[str, float] = field(default_factory=dict)
    steps: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def scores(self, blocks: list[Block]) -> list[float]:
        get, n, out, known = self.weights.get, len(blocks), [], {}
        for i, b in enumerate(blocks):
            key = (b.tags, b.tag, b.names, b.inner)
            if key not in known:
                known[key] = sum([get(f, 0.0) for f in context_features(b)])
            out.append(known[key] + sum([get(f, 0.0) for f in text_features(b, i, n)]))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The best labelling by Viterbi: score of main text per block against 0 for the rest, and steps."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.steps
        rest, main, back = 0.0, 0.0, []
        for i, s in enumerate(self.scores(blocks)):
            if i:
                from_rest, from_main = (rest + aa >= main + ba), (rest + ab >= main + bb)
                back.append((from_rest, from_main))
                rest, main = (rest + aa if from_rest else main + ba), (rest + ab if from_main else main + bb)
            main += s
        label = main > rest
        out = [label]
        for from_rest, from_main in reversed(back):
            label = not (from_main if label else from_rest)
            out.append(label)
        return out[::-1]

    def extract(self, html: str | None) -> str:
        blocks = leaf_blocks(html)
        return "\n".join(b.text for b, main in zip(blocks, self.decode(blocks)) if main)


def _marginals(scores: list[float], steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of main text per block, and expected counts of the four steps."""
    e = np.zeros((len(scores), 2))
    e[:, 1] = scores
    t = np.array(steps)
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[0] = e[0]
    for i in range(1, len(e)):
        forward[i] = e[i] + np.logaddexp(forward[i - 1][0] + t[0], forward[i - 1][1] + t[1])
    for i in range(len(e) - 2, -1, -1):
        x = t + e[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(x[:, 0], x[:, 1])
    whole = np.logaddexp(*forward[-1])
    main = np.exp(forward[:, 1] + backward[:, 1] - whole)
    pairs = np.exp(forward[:-1, :, None] + t[None] + (e + backward)[1:, None, :] - whole).sum(axis=0)
    return main, pairs


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 5) -> Field:
    """The field for labelled pages (:data:`LABEL` before each block of main text), by gradient steps per page on the likelihood."""
    data = []
    for html in pages:
        blocks = leaf_blocks(html, labelled=True)
        # a window of a very long page says as much; this bounds the steps, not what is extracted
        for at in range(0, len(blocks), MAX_TRAIN_BLOCKS):
            part = blocks[at : at + MAX_TRAIN_BLOCKS]
            features = [context_features(b) + text_features(b, at + i, len(blocks)) for i, b in enumerate(part)]
            data.append((features, [int(b.main) for b in part]))
    out, order = Field(), random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(data)
        rate = RATE / (1 + epoch / 2)
        for features, labels in data:
            w = out.weights
            main, pairs = _marginals([sum(w.get(f, 0.0) for f in fs) for fs in features], out.steps)
            for fs, y, p in zip(features, labels, main.tolist()):
                by = rate * (y - p)
                if abs(by) > 1e-4:
                    for f in fs:
                        w[f] = (1 - PENALTY) * w.get(f, 0.0) + by / 2
            for a, b in zip(labels, labels[1:]):
                out.steps[a][b] += 0.1 * rate
            for a in (0, 1):
                for b in (0, 1):
                    out.steps[a][b] -= 0.1 * rate * float(pairs[a, b])
    return out


# Names that pages commonly give to their parts.
_MAIN = (
    ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"),
    ("div", "post-content"), ("section", "entry-content"), ("div", "story"), ("div", "main-text"), ("article", "hentry"),
)
_PARTS = {
    "menu": (("nav", ""), ("nav", "menu"), ("div", "menu"), ("ul", "navigation"), ("div", "navbar"), ("div", "breadcrumbs"),
             ("nav", "breadcrumb"), ("div", "topbar"), ("div", "tags"), ("ol", "pagination")),
    "header": (("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "banner")),
    "aside": (("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"),
              ("section", "recommended"), ("div", "popular"), ("aside", "teaser"), ("div", "author-bio"), ("div", "trending")),
    "notice": (("div", "cookie"), ("div", "cookie-notice"), ("div", "notice"), ("div", "consent"), ("div", "alert"),
               ("div", "gdpr"), ("section", "paywall"), ("div", "popup"), ("div", "modal"), ("div", "disclaimer"), ("dialog", "")),
    "ad": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "advertisement"), ("div", "sponsored"), ("div", "promo"),
           ("ins", "adsbygoogle"), ("div", "banner-ad"), ("section", "promotion"), ("div", "sponsor")),
    "form": (("form", ""), ("form", "search"), ("form", "newsletter"), ("div", "newsletter"), ("div", "signup"), ("form", "login"),
             ("div", "subscribe")),
    "comments": (("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment-list"), ("div", "disqus"),
                 ("section", "replies"), ("div", "responses"), ("div", "discussion"), ("section", "reader-comments")),
    "share": (("div", "share"), ("div", "social"), ("ul", "social-links"), ("div", "toolbar")),
    "footer": (("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "legal"), ("footer", "colophon")),
}


def _element(tag_name: tuple[str, str], inside: str, pick: random.Random) -> str:
    tag, name = tag_name
    attr = "" if not name else f' {pick.choice(("class", "class", "id"))}="{name}"'
    return f"<{tag}{attr}>{inside}</{tag}>"


def labelled_page(texts: list[str], other: list[str], pick: random.Random) -> str:
    """A page around the blocks ``texts`` with parts made of ``other`` texts; main text is marked.

    Parts have the same kind of prose as the article, so that markup and shape
    have to tell them apart, and stand before, beside, in and behind it.
    """
    def say() -> str:
        return pick.choice(other) if other else "a"

    def part(kind: str) -> str:
        if kind in ("menu", "share"):
            words = (say().split() or ["a"])[:8]
            inside = "".join(f'<li><a href="/x">{w}</a></li>' for w in words) if pick.random() < 0.7 else " ".join(
                f'<a href="/x">{w}</a>' for w in words)
            inside = f"<ul>{inside}</ul>" if "<li>" in inside else inside
        elif kind == "form":
            inside = f"<label>{say()[:40]}</label><input name=q><button>{say()[:12]}</button>" + pick.choice(["", f"<p>{say()}</p>"])
        elif kind == "header":
            inside = f'<a href="/">{say()[:30]}</a>' + pick.choice(["", f"<p>{say()[:60]}</p>", part("menu")])
        elif kind == "footer":
            inside = pick.choice([f"&copy; {say()[:80]}", f"<p>&copy; {say()}</p>", f'<p>{say()}</p><a href="/y">{say()[:20]}</a>'])
        elif kind == "aside":
            inside = f"<h3>{say()[:30]}</h3>" + pick.choice(
                [f"<p>{say()}</p>", "".join(f'<p><a href="/z">{say()[:60]}</a></p>' for _ in range(3)), f"<p>{say()}</p><p>{say()}</p>"])
        elif kind == "comments":
            one = lambda: pick.choice([f"<p>{say()}</p>", f"<div><b>{say()[:12]}</b><p>{say()}</p></div>", f"<article><p>{say()}</p></article>"])
            inside = pick.choice(["", f"<h2>{say()[:20]}</h2>"]) + "".join(one() for _ in range(pick.randint(1, 4)))
        else:
            inside = pick.choice([say(), f"<p>{say()}</p>", f'<p>{say()} <a href="/k">{say()[:15]}</a></p>'])
        return _element(pick.choice(_PARTS[kind]), inside, pick)

    body = []
    for i, t in enumerate(texts):
        tag = "h1" if not i and pick.random() < 0.8 else pick.choice(("p",) * 12 + ("h2", "li", "blockquote", "div"))
        block = f"<{tag}>{LABEL}{t}</{tag}>"
        body.append(f"<header>{block}</header>" if tag == "h1" and pick.random() < 0.2 else
                    f"<ul>{block}</ul>" if tag == "li" else block)
        if pick.random() < 0.15:
            body.append(part(pick.choice(("ad", "aside", "share", "form", "notice"))))
    if pick.random() < 0.3:
        body.append(part("comments"))
    main = _element(pick.choice(_MAIN), "".join(body), pick)
    front = [part(k) for k in ("notice", "header", "menu", "ad") if pick.random() < 0.6]
    behind = [part(k) for k in ("share", "comments", "aside", "form", "ad") if pick.random() < 0.5]
    if pick.random() < 0.3:
        front.append(part("aside"))
    last = [part("footer")] if pick.random() < 0.9 else []
    inside = "".join([*front, main, *behind, *last])
    if pick.random() < 0.4:
        inside = _element(("div", pick.choice(("", "page", "wrapper", "container"))), inside, pick)
    return f"<html><head><title>{say()[:30]}</title></head><body>{inside}</body></html>"


_PLAIN = frozenset("nav aside footer form".split())
#: Words of a block of prose at least.
PROSE_WORDS = 15

# Texts that are lent to layouts when a table has none.
_TEXTS = (
    ("How the harbour was built", "The first stones were laid in the spring, when the river was low and the ground was dry.",
     "For nine years the work went on, and in the end ships of every size could land there.", "Old plans", "They hang in the town hall today."),
    ("A walk through the hills", "Start at the mill and follow the stream until the path turns left behind the last farm, where the woods begin.",
     "From the top you can see both valleys, the lake and, on clear days, the mountains far behind it."),
    ("Bread at home", "Mix flour, water, salt and a little yeast the evening before, cover the bowl and leave it in a cool place until morning.",
     "Heat the oven well.", "Bake the loaf for forty minutes, then let it rest on a rack so that the crust stays firm."),
    ("What the survey found", "Of the two thousand people who were asked, more than half said that they read every day, most of them in the evening.",
     "Younger readers chose stories; older ones chose history and travel.", "The survey will be repeated next year."),
)


def _is_prose(block: Block) -> bool:
    return block.text.count(" ") + 1 >= PROSE_WORDS and block.link_share < 0.3 and not _PLAIN & set(block.tags)


def labelled_pages(pages: DataFrame, max_labelled: int = MAX_LABELLED, variants: int = VARIANTS, seed: int = 11) -> list[str]:
    """Labelled pages from the texts of at most ``max_labelled`` different ones of the given pages.

    A page whose author marked the article lends the article's blocks, another
    one its long blocks of prose. They become pages of other layouts with parts
    of every kind, whose labels are known by construction. If no page has
    either, fixed texts are lent.
    """
    pages = pages.select("html", F.xxhash64("html").alias("__h")).filter("html is not null")
    chosen = pages.select("__h").distinct().orderBy("__h").limit(max_labelled)  # copies count once
    rows = pages.join(F.broadcast(chosen), "__h").groupBy("__h").agg(F.min("html").alias("html")).orderBy("__h").collect()
    pick, out, own, other = random.Random(seed), [], [], []
    for row in rows:
        every = leaf_blocks(row["html"])
        blocks = every[:MAX_TRAIN_BLOCKS]
        inside = [b.text for b in blocks if "article" in b.tags and not _PLAIN & set(b.tags)]
        if not inside:
            inside = [b.text for b in every if _is_prose(b)][:MAX_TRAIN_BLOCKS]
        if inside:
            own.append(inside)
            other += [b.text for b in blocks if len(b.text) < 300]
    if not own:
        own = [list(x) for x in _TEXTS]
    other = other or [t for x in own for t in x]
    variants = max(variants, -(-MIN_LAYOUTS // len(own)))
    for inside in own:
        plain = "".join(f"<p>{LABEL}{_escape(t)}</p>" for t in inside)
        menu = "".join(f'<li><a href="/a">{_escape(w)}</a></li>' for w in pick.choice(other).split()[:6])
        out.append(f'<html><body><nav><ul>{menu}</ul></nav><div class="ad">{_escape(pick.choice(other))}</div><article>{plain}</article>'
                   f"<footer>&copy; {_escape(pick.choice(other))}</footer></body></html>")
        for _ in range(variants):
            texts = [_escape(t) for t in inside]
            out.append(labelled_page(texts, [_escape(pick.choice(other)) for _ in range(30)], pick))
    return out


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def learn(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> Field:
    return train(labelled_pages(pages, max_labelled))


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """``page_id``, ``url``, ``text`` and its code points ``n_chars``; a null or empty page has an empty text.

    All of the html is read, malformed and cut off markup included. Other
    columns are not read; repeated rows give repeated results.
    """
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
