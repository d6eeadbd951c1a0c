"""Main text of web pages, by a recurrent labeller of the page's blocks.

A page is read as the sequence of its blocks: runs of text between block-level tags. A block is seen
as a vector made from the tags, classes and ids on its path, from its hashed words, and from a few
measures (length, share of link text). A bidirectional LSTM in numpy reads the sequence both ways, so
every block is labelled as main text or not in the light of the whole page.

The labeller is trained here, on a bounded sample of the table's pages (``train_pages``). Their blocks
are dealt anew into layouts whose labels are known by construction: the page's own, and others with
menus, headers, sidebars, notices, adverts, forms, related links and reader comments around the
article, under common names of tags, classes and ids, or names that tell nothing, and with lists of
links inside the article. So it knows more layouts than the sample has.

Whole pages are read: nothing is dropped or capped. Scripts, styles and the like end at their own end
tag, whatever they hold; formulas are text, the choices of forms are not. Character references are
decoded, white space in a block becomes one blank. Defined results: NULL or empty html gives an empty
text; a page without main text too; unclosed and stray tags are tolerated; repeated rows each give a
row; an empty table gives no rows (and trains nothing); columns other than page_id, url and html are
not looked at.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 240
LAYOUTS_A_PAGE = 4
EPOCHS = 10
PATH_BUCKETS = 2048
WORD_BUCKETS = 1024
MEASURES = 4
INPUT = 16
HIDDEN = 16
_ENTRIES_AT_ONCE = 1 << 18

_TAG = re.compile(r"</?([a-zA-Z][^\s/><]*+)")
_TO_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_QUOTED = re.compile(r"""\"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)""")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")

# HTML's elements without content, with raw content, and those that do not end a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg annotation annotation-xml".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in _RAW}
# Of these an end tag is looked for, but a page that lacks it goes on after the start tag.
_RAW_IF_ENDED = frozenset("noscript template svg annotation annotation-xml".split())
# Choices of forms: their text, up to the next tag of a block, is not page text.
_CHOICES = frozenset("select option optgroup datalist".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small"
    " span strike strong sub sup time tt u var wbr"
    " annotation annotation-xml math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms"
    " mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
_MAIN_TAGS = frozenset({"article", "main"})
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " nav ol p pre section table ul".split()
)


@dataclass
class Block:
    path: int  # bit b: an open element's tag or name falls in bucket b
    text: str
    link_chars: int
    in_article: bool  # an article or main element is open


class _TagEnds:
    """Where tags end: at the first ``>`` outside quotes, found in time linear in the page.

    A way from a place outside quotes is outside, in double or in single quotes at any later place,
    and a quote only swaps two of these. So ways that never end do not meet, there are three at
    most, and a tag that begins outside the quotes of one of them does not end either.
    """

    def __init__(self, page: str):
        self._page = page
        self._endless: list[tuple[int, list[int], list[int]]] = []  # from where, and its quoted stretches

    def find(self, place: int) -> int:
        """The place after the ``>``, or -1."""
        for first, starts, ends in self._endless:
            at = bisect_left(starts, place) - 1
            if place >= first and (at < 0 or ends[at] <= place):
                return -1
        end = _TO_TAG_END.match(self._page, place).end()
        if self._page.startswith(">", end):
            return end + 1
        quoted = [match.span() for match in _QUOTED.finditer(self._page, place)]
        self._endless.append((place, [a for a, _ in quoted], [b for _, b in quoted]))
        return -1


class _Open:
    """The open elements; every step takes the same time, or that of the elements it closes."""

    def __init__(self) -> None:
        self._stack: list[tuple[str, int, bool]] = []
        self._places: dict[str, list[int]] = {}
        self._blocks: list[int] = []  # places of elements that are not inline

    def path(self) -> tuple[int, bool]:
        return self._stack[-1][1:] if self._stack else (0, False)

    def last(self) -> str | None:
        return self._stack[-1][0] if self._stack else None

    def push(self, name: str, own: int) -> None:
        path, in_article = self.path()
        at = len(self._stack)
        # Elements that add nothing share the number of the one around them.
        self._stack.append((name, path if path | own == path else path | own, in_article or name in _MAIN_TAGS))
        self._places.setdefault(name, []).append(at)
        if name not in _INLINE:
            self._blocks.append(at)

    def close(self, name: str) -> None:
        """Close the innermost ``name`` and all in it; an inline end tag never closes blocks in it."""
        places = self._places.get(name)
        if not places or name in _INLINE and self._blocks and self._blocks[-1] > places[-1]:
            return
        at = places[-1]
        while len(self._stack) > at:
            closed = self._stack.pop()[0]
            self._places[closed].pop()
            if closed not in _INLINE:
                self._blocks.pop()


def blocks(page: str | None) -> list[Block]:
    """The page's blocks with visible text, in order; takes time linear in the page, whatever it holds."""
    page = page or ""
    found: list[Block] = []
    elements, tag_ends = _Open(), _TagEnds(page)
    run: list[str] = []
    links = link_chars = place = 0
    in_choice = False
    unended: set[str] = set()

    def end_block() -> None:
        nonlocal link_chars
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            path, in_article = elements.path()
            found.append(Block(path, text, link_chars, in_article))
        run.clear()
        link_chars = 0

    while place < len(page):
        begin = place
        if page[begin] == "<":
            if page.startswith(("<!", "<?"), begin):
                mark = "-->" if page.startswith("<!--", begin) else ">"
                end = page.find(mark, begin + (4 if mark == "-->" else 2))
                place = end + len(mark) if end >= 0 else len(page)
                continue
            tag = _TAG.match(page, begin)
            place = tag_ends.find(tag.end()) if tag else -1
        else:
            tag, place = None, page.find("<", begin)
            place = len(page) if place < 0 else place
        if tag is None or place < 0:  # text, or a "<" that begins no tag
            place = begin + 1 if place < 0 else place
            if not in_choice:
                text = entities.unescape(page[begin:place])
                run.append(text)
                if links:
                    link_chars += len(text.strip())
            continue
        name = tag[1].lower()
        closing = page[begin + 1] == "/"
        if name not in _INLINE:
            in_choice = not closing and name in _CHOICES
            end_block()
        if closing:
            if name == "a" and links:
                links -= 1
            elements.close(name)
            continue
        if name in _VOID:
            if name == "br":
                run.append(" ")
            continue
        if name in _RAW:
            if page[place - 2] != "/" and name not in unended:
                # What lies between is no markup: only the element's own end tag counts.
                end = _RAW_END[name].search(page, place)
                if end is not None:
                    place = end.end()
                elif name in _RAW_IF_ENDED:
                    unended.add(name)
                else:
                    break
            continue
        if name in _CHOICES:
            continue
        if name in _CLOSES_P:
            elements.close("p")
        elif name in ("li", "dt", "dd", "tr", "td", "th") and elements.last() == name:
            elements.close(name)
        own = _bit(name)
        if place - begin > len(name) + 2:
            for kind, *values in _NAMES.findall(page[begin:place]):
                for part in _NAME_PART.findall("".join(values).lower()):
                    own |= _bit(f"{kind[0].lower()}:{part}")
        if name == "a":
            links += 1
        elements.push(name, own)
    end_block()
    return found


def _bucket(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % buckets


@lru_cache(maxsize=1 << 14)
def _bit(name: str) -> int:
    return 1 << _bucket(name, PATH_BUCKETS)


def _bits(path: int) -> np.ndarray:
    packed = np.frombuffer(path.to_bytes(PATH_BUCKETS // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(packed, bitorder="little")).astype(np.uint16)


class Features:
    """Hash buckets and measures of the blocks of some pages, as flat arrays."""

    def __init__(self, pages: Sequence[Sequence[Block]]):
        which_path, words, measures = [], [], []
        n_words = []
        paths: dict[int, int] = {}
        word_buckets: dict[str, int] = {}
        for page in pages:
            for block in page:
                which_path.append(paths.setdefault(block.path, len(paths)))
                found = _WORD.findall(block.text)
                for word in found:
                    at = word_buckets.get(word)
                    if at is None:
                        at = word_buckets[word] = _bucket(word, WORD_BUCKETS)
                    words.append(at)
                n_words.append(len(found))
                size = len(block.text)
                ends = block.text[-1] in ".!?:;\"'”’»"
                measures.append((np.log1p(size) / 8, np.log1p(len(found)) / 6, min(1.0, block.link_chars / size), ends))
        # Buckets of each distinct path, and which of them a block has.
        buckets = [_bits(path) for path in paths]
        self.paths = np.concatenate(buckets) if buckets else np.zeros(0, np.uint16)
        self.n_paths = np.array([len(own) for own in buckets], np.int64)
        self.which_path = np.array(which_path, np.int64)
        self.words, self.n_words = np.array(words, np.int64), np.array(n_words, np.int64)
        self.measures = np.array(measures, np.float32).reshape(-1, MEASURES)
        self.sizes = np.array([len(page) for page in pages], np.int64)

    @classmethod
    def joined(cls, parts: Sequence[Features]) -> Features:
        """The features of the pages of all ``parts``, in order."""
        whole = cls([])
        for name in ("paths", "n_paths", "words", "n_words", "measures", "sizes"):
            setattr(whole, name, np.concatenate([getattr(part, name) for part in parts]))
        before = np.cumsum([0] + [len(part.n_paths) for part in parts[:-1]])
        whole.which_path = np.concatenate([part.which_path + first for part, first in zip(parts, before)])
        return whole


def _added(rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sum of the ``rows`` of each of ``n`` indices."""
    columns = [np.bincount(index, weights=column, minlength=n) for column in rows.T]
    return np.stack(columns, axis=1).astype(np.float32)


def _sums(table: np.ndarray, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the table's rows ``index`` for each run of ``counts`` entries."""
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    filled = np.flatnonzero(counts)
    starts = np.cumsum(counts[filled]) - counts[filled]
    first = 0
    while first < len(filled):  # in pieces, so that many words at once take no more memory than few
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _ENTRIES_AT_ONCE)))
        stop = starts[last] if last < len(filled) else len(index)
        rows = table[index[starts[first] : stop]]
        out[filled[first:last]] = np.add.reduceat(rows, starts[first:last] - starts[first], axis=0)
        first = last
    return out / np.maximum(counts, 1)[:, None].astype(np.float32)


def _trust(n_words: np.ndarray) -> np.ndarray:
    return (n_words / (n_words + 10)).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors; ``weights`` are plain arrays, so it is easily sent to tasks."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        normal = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {
            "path": (draw.standard_normal((PATH_BUCKETS, INPUT)) * 0.3).astype(np.float32),
            "word": (draw.standard_normal((WORD_BUCKETS, INPUT)) * 0.1).astype(np.float32),
            "measure": normal(MEASURES, INPUT),
            "out": normal(2 * HIDDEN, 1),
            "out_bias": np.zeros(1, np.float32),
        }
        for way in ("f", "b"):
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.weights |= {f"x{way}": normal(INPUT, 4 * HIDDEN), f"h{way}": normal(HIDDEN, 4 * HIDDEN), f"c{way}": bias}

    def _inputs(self, features: Features) -> np.ndarray:
        w = self.weights
        path = (_sums(w["path"], features.paths, features.n_paths) * np.sqrt(features.n_paths)[:, None])[features.which_path]
        # A few words say little: their mean counts in full only where there are many.
        words = _sums(w["word"], features.words, features.n_words) * _trust(features.n_words)[:, None]
        return np.tanh(path + words + features.measures @ w["measure"])

    @staticmethod
    def _padded(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(steps, pages, width), zeros after a page's end."""
        out = np.zeros((sizes.max(initial=0), len(sizes), flat.shape[1]), np.float32)
        at = 0
        for page, size in enumerate(sizes):
            out[:size, page] = flat[at : at + size]
            at += size
        return out

    def _read(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states of one direction, and (``keep``) what the way back needs."""
        w = self.weights
        steps, pages = x.shape[:2]
        hidden = np.zeros((steps, pages, HIDDEN), np.float32)
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros((pages, HIDDEN), np.float32)
        given = x @ w[f"x{way}"] + w[f"c{way}"]
        trace = []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ w[f"h{way}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if keep:
                trace.append((t, h, c, i, f, o, g, tanh_c, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * tanh_c) + (1 - m) * h
            hidden[t] = h
        return hidden, trace

    def scores(self, features: Features) -> np.ndarray:
        """Probability that a block is main text, for all blocks in order."""
        out = np.zeros(int(features.sizes.sum()), np.float32)
        if not len(out):
            return out
        flat = self._inputs(features)
        starts = np.concatenate([[0], np.cumsum(features.sizes)[:-1]])
        order = np.argsort(features.sizes, kind="stable")  # pages of like length together: little padding
        order = order[features.sizes[order] > 0]
        at = 0
        while at < len(order):
            longest = at + 1
            while longest < len(order) and (longest - at + 1) * features.sizes[order[longest]] <= 1 << 15:
                longest += 1
            some = order[at:longest]
            sizes = features.sizes[some]
            rows = np.concatenate([np.arange(starts[p], starts[p] + features.sizes[p]) for p in some])
            x = self._padded(flat[rows], sizes)
            mask = (np.arange(x.shape[0])[:, None] < sizes).astype(np.float32)
            both = np.concatenate([self._read(x, mask, way)[0] for way in ("f", "b")], axis=2)
            logits = both @ self.weights["out"][:, 0] + self.weights["out_bias"][0]
            out[rows] = _sigmoid(logits.T[mask.T > 0])
            at = longest
        return out

    def gradients(self, features: Features, labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss and its gradients by the weights' names."""
        w = self.weights
        flat = self._inputs(features)
        x = self._padded(flat, features.sizes)
        mask = (np.arange(x.shape[0])[:, None] < features.sizes).astype(np.float32)
        y = self._padded(labels[:, None].astype(np.float32), features.sizes)[:, :, 0]
        reads = {way: self._read(x, mask, way, keep=True) for way in ("f", "b")}
        both = np.concatenate([reads["f"][0], reads["b"][0]], axis=2)
        p = _sigmoid(both @ w["out"][:, 0] + w["out_bias"][0])
        n = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        d_logit = mask * (p - y) / n
        grads = {"out": np.einsum("tph,tp->h", both, d_logit)[:, None], "out_bias": d_logit.sum(keepdims=True).reshape(1)}
        d_both = d_logit[:, :, None] * w["out"][:, 0]
        d_x = np.zeros_like(x)
        for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            d_hidden = d_both[:, :, part]
            d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
            d_c = np.zeros_like(d_h)
            g_x, g_h, g_b = (np.zeros_like(w[f"{k}{way}"]) for k in ("x", "h", "c"))
            for t, h, c, i, f, o, g, tanh_c, m in reversed(reads[way][1]):
                d_h = d_h + d_hidden[t]
                own_h = m * d_h
                own_c = m * d_c + own_h * o * (1 - tanh_c**2)
                d_z = np.concatenate(
                    [own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * tanh_c * o * (1 - o), own_c * i * (1 - g**2)],
                    axis=1,
                )
                g_x += x[t].T @ d_z
                g_h += h.T @ d_z
                g_b += d_z.sum(0)
                d_x[t] += d_z @ w[f"x{way}"].T
                d_h = (1 - m) * d_h + d_z @ w[f"h{way}"].T
                d_c = (1 - m) * d_c + own_c * f
            grads |= {f"x{way}": g_x, f"h{way}": g_h, f"c{way}": g_b}
        d_flat = d_x.transpose(1, 0, 2)[mask.T > 0] * (1 - flat**2)
        grads["measure"] = features.measures.T @ d_flat
        d_path = _added(d_flat, features.which_path, len(features.n_paths))
        for name, index, counts, scale, change in (
            ("path", features.paths, features.n_paths, 1 / np.sqrt(np.maximum(features.n_paths, 1)), d_path),
            ("word", features.words, features.n_words, _trust(features.n_words) / np.maximum(features.n_words, 1), d_flat),
        ):
            grads[name] = _added(np.repeat(change * scale[:, None], counts, axis=0), index, len(w[name]))
        return loss, grads


# Names that layouts go by.
_MAIN_NAMES = (
    '<article>', '<main>', '<div class="content">', '<div id="content">', '<div class="post-body">', '<div id="main">',
    '<section class="article-text">', '<div class="entry-content">', '<div class="story">', '<div role="main">', "<div>",
    '<main class="page"><article class="post">', "<section>",
)
_AROUND = {
    "menu": ('<nav>', '<div class="menu">', '<div id="navbar">', '<ul class="nav">', '<div role="navigation">', '<div class="breadcrumb">'),
    "header": ('<header>', '<div id="header">', '<div class="site-header">', '<div class="masthead">', '<div class="banner">'),
    "footer": ('<footer>', '<div id="footer">', '<div class="site-footer">', '<div class="copyright">', '<div class="legal">'),
    "sidebar": ('<aside>', '<div class="sidebar">', '<div id="sidebar">', '<section class="related">', '<div class="widget">', '<div class="recommended">', '<div class="share social">'),
    "notice": ('<div class="cookie-notice">', '<div id="consent">', '<div class="notice">', '<div class="popup modal">', '<div class="alert">', '<div class="newsletter subscribe">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div id="advert">', '<div class="promo">', '<div class="sponsored">', '<ins class="adsbygoogle">', '<div class="advertisement">'),
    "form": ('<form>', '<form class="search">', '<form id="login">', '<form class="signup">'),
    "comments": ('<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="commentlist">', '<div class="discussion replies">', '<div class="responses">'),
}

# What menus and the ends of pages commonly say.
_BOUNDARY = {
    "menu": ("Home", "About us", "Contact", "News", "Archive", "Search", "Log in", "Sign up", "Help", "Products", "Services", "Blog"),
    "footer": (
        "Copyright YEAR", "© YEAR All rights reserved.", "Copyright © YEAR", "Terms of use", "Privacy policy", "Imprint", "Contact",
        "Follow us", "Back to top", "Sitemap", "All rights reserved",
    ),
}
_UNNAMED = frozenset({"<div>", "<section>"})


def _end(opening: str) -> str:
    return "".join(f"</{name}>" for name in reversed(re.findall(r"<([a-z0-9]+)", opening)))


def _untold(draw: random.Random) -> str:
    """An opening tag whose name tells nothing."""
    name = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 7)))
    return draw.choice((f'<div class="{name}">', f'<div id="{name}">', f'<section class="{name}">', "<div>"))


def _layout(main: list[str], short: list[str], draw: random.Random) -> tuple[str, list[bool]]:
    """A page around the paragraphs ``main``, with the label of each block in order."""
    parts: list[str] = []
    labels: list[bool] = []

    def around(kind: str) -> None:
        # Menus and footers are known by their words and place, too: some have names that tell nothing.
        untold = kind in _BOUNDARY and draw.random() < 0.25
        opening = _untold(draw) if untold else draw.choice(_AROUND[kind])
        own = _BOUNDARY[kind] if untold or kind in _BOUNDARY and draw.random() < 0.3 else short
        inside = []
        for _ in range(draw.randint(1, 5)):
            text = entities.escape(draw.choice(main if kind == "comments" else own if untold or draw.random() < 0.8 else main))
            text = text.replace("YEAR", str(draw.randint(1995, 2030)))
            tag = draw.choice(("li", "p", "div", "h3") if kind != "form" else ("label", "p", "button", "div"))
            text = f'<a href="/x">{text}</a>' if draw.random() < (0.8 if kind in ("menu", "sidebar") else 0.15) else text
            inside.append(f"<{tag}>{text}</{tag}>")
        block = opening + "".join(inside) + _end(opening)
        labels.extend([False] * len(blocks(block)))
        parts.append(block)

    for kind in draw.sample(("header", "menu", "notice", "advert", "form", "sidebar"), draw.randint(1, 4)):
        around(kind)
    opening = _untold(draw) if draw.random() < 0.1 else draw.choice(_MAIN_NAMES)
    inside = []
    for at, text in enumerate(main):
        if at and opening not in _UNNAMED and draw.random() < 0.1:  # a list of links that belongs to the text
            words = text.split(" ")
            items = [" ".join(words[i : i + draw.randint(1, 8)]) for i in range(0, min(len(words), 24), 8)]
            items = [item for item in items if item.strip()]
            inside.append("<ul>" + "".join(f'<li><a href="/x">{entities.escape(item)}</a></li>' for item in items) + "</ul>")
            labels.extend([True] * len(items))
        if at and draw.random() < 0.12:
            kind = draw.choice(("advert", "sidebar", "notice", "form"))
            ad = draw.choice(_AROUND[kind])
            block = f"{ad}<p>{entities.escape(draw.choice(short))}</p>{_end(ad)}"
            labels.append(False)
            inside.append(block)
        if draw.random() < 0.2:  # length alone says little: main text has very short blocks, too
            text = " ".join(text.split(" ")[: draw.randint(1, 3)])
        tag = "h1" if not at and draw.random() < 0.7 else draw.choice(("p", "p", "p", "p", "p", "h2", "li", "blockquote", "div"))
        inside.append(f"<{tag}>{entities.escape(text)}</{tag}>")
        labels.append(True)
    parts.append(opening + "".join(inside) + _end(opening))
    for kind in draw.sample(("sidebar", "comments", "advert", "menu", "form", "notice"), draw.randint(0, 4)):
        around(kind)
    if draw.random() < 0.8:
        around("footer")
    return "<html><body>" + "".join(parts) + "</body></html>", labels


def training_set(
    pages: Sequence[str], seed: int = 11, layouts: int = LAYOUTS_A_PAGE
) -> tuple[list[list[Block]], list[list[bool]]]:
    """Blocks and labels: each page as it is where it names its article, and dealt into ``layouts`` others."""
    draw = random.Random(seed)
    read = [blocks(page) for page in pages]
    sequences, labels = [], []
    short = [b.text for page in read for b in page if not b.in_article and len(b.text) < 80] or ["menu"]
    for page in read:
        main = [block.text for block in page if block.in_article]
        if not main:
            continue
        sequences.append(page)
        labels.append([block.in_article for block in page])
        for _ in range(layouts):
            first = draw.randrange(len(main))
            some = main[first : first + draw.randint(1, 12)]
            made, own = _layout(some, short, draw)
            found = blocks(made)
            if len(found) == len(own):
                sequences.append(found)
                labels.append(own)
    return sequences, labels


def train(pages: Sequence[str], epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """A labeller fitted by Adam on ``training_set(pages)``; the same pages give the same labeller."""
    model = Labeller(seed)
    # Few pages are dealt into more layouts each, so that every labeller sees about as many.
    sequences, labels = training_set(pages, layouts=max(LAYOUTS_A_PAGE, -(-LAYOUTS_A_PAGE * TRAIN_PAGES // max(1, len(pages)))))
    if not sequences:
        return model
    read = [Features([sequence]) for sequence in sequences]
    draw = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs)
        by_size = sorted(draw.permutation(len(sequences)), key=lambda i: len(sequences[i]) // 8)
        batches = [by_size[i : i + 32] for i in range(0, len(by_size), 32)]
        for at in draw.permutation(len(batches)):
            some = batches[at]
            features = Features.joined([read[i] for i in some])
            _, grads = model.gradients(features, np.concatenate([labels[i] for i in some]))
            step += 1
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for name, grad in grads.items():
                grad = grad * min(1.0, 5.0 / (size + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.99 * second[name] + 0.01 * grad**2
                change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                model.weights[name] = (model.weights[name] - rate * change).astype(np.float32)
    return model


def main_texts(pages: Sequence[str | None], model: Labeller) -> list[str]:
    """Main text of each page: its blocks labelled so, one a line."""
    read = [blocks(page) for page in pages]
    chosen = model.scores(Features(read)) > 0.5
    out, at = [], 0
    for page in read:
        out.append("\n".join(block.text for block, main in zip(page, chosen[at : at + len(page)]) if main))
        at += len(page)
    return out


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Labeller:
    """A labeller trained on about ``train_pages`` pages, picked by the hash of their id."""
    share = min(1.0, train_pages / max(1, pages.count()))
    picked = F.pmod(F.xxhash64(F.col("page_id").cast("long")), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    rows = pages.where(picked).orderBy("page_id", "html").select("html").limit(2 * train_pages).collect()
    return train([row["html"] or "" for row in rows])


def extract(pages: DataFrame, model: Labeller, at_once: int = 512) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                texts = main_texts(part.column("html").to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(text) for text in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
