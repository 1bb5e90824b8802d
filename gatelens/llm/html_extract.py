"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A block is a run of text that no block-level tag interrupts. Its features are its ancestors' tags, the words of their class
and id attributes, and figures of its text (length, share of link text, closing mark, place on the page); no feature is a
word of the text. The field is trained on labelled pages (``labelled_pages``: laid out by rule in many ways, every block
labelled; a fixed number, so training doesn't grow with the corpus) and decoded by Viterbi for each page.

Scripts, styles, templates, images, comments and the head are no text. A head without end tag goes as far as its own kinds of tags do, an
image without one up to the next block; scripts and styles without one run to the end of the page, of templates and noscript
parts only the tag is left out then. A '<' that begins no tag is text, except as the last character of a page. Of blocks nested
more than DEEPEST deep every ancestor counts, equal ones once. White space inside a block is one space, character
references are decoded, blocks are joined by a line feed. A null or empty page, or one without blocks, gives an empty text with 0
characters. Pages are read whole, cut-off ones up to where they end. Rows are independent, so repeated rows
repeat their result; columns named like a result are replaced, extra columns stay where they are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns

BLOCK_TAGS = frozenset("html body div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption section article aside nav header footer main form fieldset legend label button select option textarea blockquote pre figure figcaption address details summary dialog hr center menu iframe video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open one of these kinds when no other block stands between.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {t: ("p",) for t in ("div", "ul", "ol", "table", "section", "article", "aside", "nav", "header", "footer", "main", "form", "h1", "h2", "h3", "h4", "blockquote", "pre")}
DEEPEST = 64
#: Block tags, and others that end foreign content; those that an image may hold itself do not.
BREAKS = "|".join(sorted((BLOCK_TAGS | set("b big br code em embed font i img s small span strike strong sub sup tt u var".split())) - set("iframe video audio canvas".split())))
ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""


def _whole(tags: str) -> str:
    """Elements of these tags with all that is in them; without groups, which possessive repeats would spoil. Without its end tag
    one runs to the end of the page, so no place is searched from twice."""
    return "|".join(rf"<{t}(?=[\s/>])[^>]*>.*?(?:</{t}\s*>|\Z)" for t in tags.split())


#: The first head, after its name: up to its end tag if no block comes before it, else as far as its own kinds of tags go.
HEAD = re.compile(
    rf"""[^>]*>(?:
    (?:[^<]++|<!--.*?(?:-->|\Z)|{_whole("script style noscript template title svg")}|<(?!/?(?:{"|".join(sorted(BLOCK_TAGS))})[\s/>]|/head\s*>))*+</head\s*>
    |(?:\s++|<!--.*?(?:-->|\Z)|{_whole("script style noscript template title noframes")}|</?(?:meta|link|base|basefont|bgsound)(?=[\s/>]){ATTRIBUTES}(?:>|\Z)|<[!?][^>]*(?:>|\Z))*+
    )""",
    re.S | re.I | re.X,
)
SVG = rf"""<svg(?=[\s/>]){ATTRIBUTES}(?:(?<=/)>|>(?:[^<]++|<!--.*?-->|{_whole("style script")}|<(?!/?(?:{BREAKS})[\s/>]|/svg\s*>))*+(?:</svg\s*>)?)"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |{SVG}
    |<(?P<raw>script|style)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    |<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<named>{ATTRIBUTES})(?:>|\Z)
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<named2>[^>]*)(?:>|\Z)""",
    re.S | re.I | re.X,
)
#: Left out with all that is in them where they are closed.
CLOSED = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("noscript", "template")}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


class Open:
    """The open blocks: tag and path part (tag and the words of class and id) of each, and how often each is open."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []
        self.tags: Counter[str] = Counter()
        self.parts: dict[str, int] = {}

    def push(self, tag: str, part: str) -> None:
        self.stack.append((tag, part))
        self.tags[tag] += 1
        self.parts[part] = self.parts.get(part, 0) + 1

    def pop(self) -> str:
        tag, part = self.stack.pop()
        self.tags[tag] -= 1
        self.parts[part] -= 1
        if not self.parts[part]:
            del self.parts[part]
        return tag

    def close(self, tag: str) -> None:
        """Ends the innermost block of this tag, and all in it; nothing where none is open."""
        while self.tags[tag] and self.pop() != tag:
            pass

    def path(self) -> tuple[str, ...]:
        """The parts from the outermost on. Of more than DEEPEST, each part once and the innermost at the end: the features are the same."""
        return tuple(p for _, p in self.stack) if len(self.stack) <= DEEPEST else (*self.parts, self.stack[-1][1])


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of ancestors, text, characters of link text) for each leaf block, in page order."""
    out: list = []
    blocks = Open()
    text: list[str] = []
    linked, in_link, at = 0, 0, 0

    def end_block() -> None:
        nonlocal linked, text
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                out.append((blocks.path(), block, linked))
            text = []
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text.append(raw)
            if in_link:
                linked += len(raw.strip())

    unclosed: set[str] = set()  # tags that are not closed any more; a second head is none
    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = (m["end"] or m["end2"]) == "/"
        if not closing and tag not in unclosed:
            if tag in CLOSED:
                if closed := CLOSED[tag].search(page, at):
                    at = closed.end()
                    continue
                unclosed.add(tag)
            elif tag == "head":
                unclosed.add(tag)
                if head := HEAD.match(page, m.start() + len("<head")):
                    at = head.end()
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK_TAGS:
            end_block()
            in_link = 0
            if tag in VOID:
                continue
            if closing:
                blocks.close(tag)
                continue
            ends = CLOSES.get(tag, ())
            while blocks.stack and blocks.stack[-1][0] in ends:
                blocks.pop()
            names = " ".join(v.strip("\"'") for v in NAMED.findall(m["named"] or m["named2"] or ""))
            words = sorted({w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower()) if len(w) > 1})
            blocks.push(tag, " ".join([tag, *words]))
    add(re.sub(r"</?\Z", "", page[at:]))
    end_block()
    return out


def path_features(path: tuple[str, ...]) -> list[str]:
    out = {"bias"}
    for part in path:
        tag, *names = part.split(" ")
        out.add(f"tag:{tag}")
        out |= {f"name:{w}" for w in names}
    if path:
        out.add("parent:" + path[-1].split(" ")[0])
    return sorted(out)


def text_features(text: str, linked: int, index: int, n: int) -> list[str]:
    words = text.count(" ") + 1
    size = "1" if words < 3 else "3" if words < 8 else "8" if words < 20 else "20" if words < 60 else "60"
    link = linked / max(1, len(text))
    return [f"words:{size}", "linked:" + ("none" if link == 0 else "part" if link < 0.5 else "most"), "ends" if text[-1] in ".!?…\"”»" else "open", "mark" if text[0] in "©|»«•·" or "©" in text else "plain", "place:" + ("first" if index < 2 else "last" if index >= n - 2 else "inner")]


# What sites call their regions.
MAIN_NAMES = "content main-content article post entry-content post-body story article-body text page-content body-text".split()
AWAY_NAMES = {
    "nav": "nav navbar menu main-menu breadcrumbs breadcrumb topnav navigation pagination".split(),
    "header": "header site-header masthead banner topbar logo branding".split(),
    "footer": "footer site-footer bottom copyright colophon legal".split(),
    "aside": "sidebar side widget related recommended trending popular tags".split(),
    "div notice": "cookie-notice cookie consent gdpr notice alert newsletter subscribe popup modal paywall".split(),
    "div ad": "ad ads advert advertisement sponsored sponsor promo banner-ad ad-slot".split(),
    "section comments": "comments comment comment-list disqus respond replies user-comments".split(),
    "form": "search login signup contact-form search-form".split(),
    "div share": "share social share-buttons follow toolbar byline-tools".split(),
}


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[list, list[int]]]:
    """(blocks, labels) of n pages laid out by rule; label 1: main text. Words are random letters, so no word can be learnt."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    run = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda lo=4, hi=24: run(lo, hi).capitalize() + rng.choice(".....?!")
    prose = lambda: " ".join(sentence() for _ in range(rng.randint(1, 6)))
    link = lambda lo=1, hi=4: f"<a href='/{word()}'>{run(lo, hi)}</a>"

    def away(kind: str) -> str:
        tag, _, what = kind.partition(" ")
        name = rng.choice(AWAY_NAMES[kind])
        plain = rng.random() < (0.4 if tag in ("nav", "header", "footer", "aside", "form") else 0.0)
        open_tag = f"<{tag}>" if plain else f"<{tag if rng.random() < 0.5 or what else 'div'} {rng.choice(['class', 'class', 'id'])}='{name}'>"
        close = "</" + re.match(r"<(\w+)", open_tag)[1] + ">"
        inner = {
            "nav": lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>",
            "header": lambda: rng.choice([link(), f"<div>{run(1, 4)}</div>", f"<p>{sentence()}</p>", f"<h1>{run(1, 3)}</h1>"]),
            "footer": lambda: rng.choice([f"&copy; {word()}.example &middot; {sentence()}", f"<p>© {run(2, 5)}</p>", f"<p>{sentence()}</p>{link()}", f"{sentence()} {sentence()}"]),
            "aside": lambda: "".join(rng.choice([f"<h3>{run(1, 3)}</h3>", f"<p>{prose()}</p>", f"<ul><li>{link(2, 7)}</li><li>{link(2, 7)}</li></ul>"]) for _ in range(rng.randint(1, 3))),
            "div notice": lambda: rng.choice([f"<p>{prose()}</p>", sentence(), f"{sentence()} <button>{word()}</button>"]),
            "div ad": lambda: rng.choice([sentence(), link(2, 8), f"<p>{sentence()}</p>", prose()]),
            "section comments": lambda: f"<h3>{run(1, 2)}</h3>" + "".join(f"<div class='{rng.choice(['comment', 'comment-body', 'reply'])}'><p>{prose()}</p></div>" for _ in range(rng.randint(1, 4))),
            "form": lambda: f"<label>{run(1, 3)}</label><input><button>{word()}</button>" + rng.choice(["", f"<p>{sentence()}</p>", "<select><option>a</option></select>"]),
            "div share": lambda: "".join(link(1, 2) for _ in range(rng.randint(1, 4))),
        }[kind]()
        return open_tag + inner + close

    def main() -> str:
        parts = [f"<h1>{run(2, 10)}</h1>"] if rng.random() < 0.8 else []
        kinds = {
            40: lambda: f"<p>{prose()}</p>",
            6: lambda: f"<h2>{run(1, 6)}</h2>",
            5: lambda: f"<ul><li>{sentence(2)}</li><li>{run(2, 8)}</li></ul>",
            3: lambda: f"<blockquote><p>{prose()}</p></blockquote>",
            2: lambda: rng.choice([f"<pre>{run(2, 9)}</pre>", f"<figure><figcaption>{sentence(3)}</figcaption></figure>", f"<table><tr><td>{run(1, 3)}</td><td>{run(1, 2)}</td></tr></table>"]),
            7: lambda: f"<p>{sentence()} {link()} {sentence()}</p>",
            4: lambda: f"<p>{run(1, 3)}</p>",
            8: lambda: f"<div>{prose()}</div>",
        }
        return "".join([*parts, *(rng.choices([*kinds.values()], [*kinds])[0]() for _ in range(rng.randint(1, 12)))])

    pages = []
    for _ in range(n):
        before = [("x", away(k)) for k in rng.sample(["nav", "header", "div notice", "div ad", "form", "aside", "div share"], rng.randint(0, 4))]
        after = [("x", away(k)) for k in rng.sample(["footer", "aside", "section comments", "div ad", "div notice", "form", "nav", "div share"], rng.randint(0, 4))]
        wrap = rng.choice(["article", "article", "article", "main", "main article", f"div class='{rng.choice(MAIN_NAMES)}'", f"div id='{rng.choice(MAIN_NAMES)}'", f"main class='{rng.choice(MAIN_NAMES)}'", "section", ""])
        inner = [("m", main())]
        if rng.random() < 0.25:
            inner.insert(rng.randint(0, 1), ("x", away(rng.choice(["div ad", "div share", "div notice", "aside", "form"]))))
        tags = ["main", "article"] if wrap == "main article" else [wrap] if wrap else []
        head, tail = "".join(f"<{t}>" for t in tags), "".join(f"</{t.split()[0]}>" for t in reversed(tags))
        shell = rng.choice(["", "<div class='wrapper'>", "<div id='page'>", "<div>"])
        pieces = [*before, ("", head), *inner, ("", tail), *after]
        blocks, labels, prefix = [], [], f"<html><body>{shell}"
        # the blocks of a page are those of its pieces, so each piece's kind labels the blocks that it adds
        sofar = prefix
        for kind, piece in pieces:
            sofar += piece
            found = blocks_of(sofar)
            labels += [int(kind == "m")] * (len(found) - len(labels))
            blocks = found
        pages.append((blocks, labels[: len(blocks)]))
    return pages


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(1)
def train(n_pages: int = 500, rounds: int = 12, rate: float = 0.3, penalty: float = 1e-4) -> tuple[dict[str, float], np.ndarray]:
    """Feature weights for main text (the other label's are their negatives) and the label transitions, by AdaGrad on
    the conditional likelihood; gradients from forward and backward sums."""
    pages = [(b, y) for b, y in labelled_pages(n_pages) if b]
    names: dict[str, int] = {}
    data = []
    for blocks, labels in pages:
        rows = [[names.setdefault(f, len(names)) for f in path_features(p) + text_features(t, k, i, len(blocks))] for i, (p, t, k) in enumerate(blocks)]
        data.append((rows, np.array(labels)))
    w, trans = np.zeros(len(names)), np.zeros((2, 2))
    gw, gt = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for k in rng.permutation(len(data)):
            rows, y = data[k]
            s = np.array([w[r].sum() for r in rows])
            emit = np.stack([-s, s], 1)
            n = len(y)
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = emit[0]
            for i in range(1, n):
                forward[i] = emit[i] + _log_sum(forward[i - 1][:, None] + trans, 0)
            for i in range(n - 2, -1, -1):
                backward[i] = _log_sum(trans + emit[i + 1] + backward[i + 1], 1)
            z = _log_sum(forward[-1], 0)
            p = np.exp(forward + backward - z)
            grad_t = np.zeros((2, 2))
            for i in range(1, n):
                grad_t -= np.exp(forward[i - 1][:, None] + trans + emit[i] + backward[i] - z)
                grad_t[y[i - 1], y[i]] += 1
            grad_w = np.zeros(len(w))
            for r, one, q in zip(rows, y, p[:, 1]):
                grad_w[r] += 2 * (one - q)
            grad_w -= penalty * w
            gw += grad_w**2
            gt += grad_t**2
            w += rate * grad_w / np.sqrt(gw)
            trans += rate * grad_t / np.sqrt(gt)
    return {f: float(w[i]) for f, i in names.items()}, trans


def decode(scores: list[float], trans: list[list[float]]) -> list[int]:
    """Viterbi: the likeliest labels of a chain."""
    best, back = (-scores[0], scores[0]), []
    for s in scores[1:]:
        a0, a1 = best[0] + trans[0][0], best[1] + trans[1][0]
        b0, b1 = best[0] + trans[0][1], best[1] + trans[1][1]
        back.append((int(a1 > a0), int(b1 > b0)))
        best = (max(a0, a1) - s, max(b0, b1) + s)
    label = int(best[1] > best[0])
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


class Extractor:
    def __init__(self, weights: dict[str, float], trans: np.ndarray):
        self.weights, self.trans, self.paths = weights, trans.tolist(), {}

    def labels(self, blocks: list) -> list[int]:
        scores = []
        for i, (path, text, linked) in enumerate(blocks):
            if (base := self.paths.get(path)) is None:
                base = sum(self.weights.get(f, 0.0) for f in path_features(path))
                if len(self.paths) < 50_000:
                    self.paths[path] = base
            scores.append(base + sum(self.weights.get(f, 0.0) for f in text_features(text, linked, i, len(blocks))))
        return decode(scores, self.trans) if scores else []

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page) if page else []
        return "\n".join(b[1] for b, main in zip(blocks, self.labels(blocks)) if main)


def main_text(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (None: all columns), text and n_chars. The model is a few thousand weights, trained on the driver."""
    weights, trans = train()

    def make():
        extractor = Extractor(weights, trans)

        def each(pages: list) -> list[pa.Array]:
            texts = [extractor.text(p) for p in pages]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return each

    return add_columns(df, html_col, keep, "text string, n_chars bigint", make)
