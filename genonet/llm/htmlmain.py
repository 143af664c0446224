"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with its
tag path. A block's vector sums hashed vectors of the tags, classes and ids on its path, the mean
hashed vector of its words, and a few measures (length, share of linked text, place). A
bidirectional LSTM in numpy reads the whole sequence, so that each block is classified with the
document on both sides in view; blocks labelled as article are joined.

The model is trained on the driver, from generated pages whose blocks are labelled by
construction, at most ``TRAIN_PAGES`` of them, with a fixed seed: the same weights each time. They are about
60,000 numbers whatever the data, and go to the executors by broadcast. Pages are labelled inside
tasks, in groups of like length; nothing is shuffled.

Defined results: null or empty html, or a page without article blocks, gives an empty text and 0
characters. A tag ends at the first > outside a quoted value that is closed. Character references are decoded; white space inside a block becomes one space; <br>
counts as white space. Broken markup is read as far as it goes: unclosed tags end with their
container or the page. Equal rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut

PATH_SIZE, WORD_SIZE, EXTRA, HIDDEN = 64, 16, 8, 24
SIZE = PATH_SIZE + WORD_SIZE + EXTRA
TRAIN_PAGES, EPOCHS, BATCH, SEED = 640, 10, 16, 7

#: An attribute: a name, and maybe a value. A quote counts only where a value begins, and only if it is closed; elsewhere it is part of a name.
_ATTRIBUTE = r"""=?[^\s/>=]+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))?"""
_REST = rf"(?:[\s/]++|{_ATTRIBUTE}|=)*+"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<svg(?=[\s/>]){_REST}(?<=/)>|<(script|style|noscript|template|textarea|svg|iframe)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?"
    rf"|</(?:>|[^a-z>][^>]*>?)|<(/?)([a-z][^\s/>]*)({_REST})(?:>|\Z)", re.S | re.I)  # fmt: skip
_NAMES = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end at the next one of their kind.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_WORD = re.compile(r"\w+")


class Path(Sequence):
    """Tags and .names from the root to an open element. It holds its own names, the path above and the running sum of their vectors, so that depth costs neither time nor memory."""

    __slots__ = ("above", "names", "size", "sum", "tag")

    def __init__(self, above: Path | None, tag: str, names: list[str]) -> None:
        self.above, self.tag, self.names = above, tag, (tag, *("." + x for x in names))
        self.size, total = (above.size, above.sum) if above else (0, np.zeros(PATH_SIZE, np.float32))
        self.size += len(self.names)
        for x in self.names:
            total = total + _path_vector(x)
        self.sum = total

    def __len__(self) -> int:
        return self.size

    def whole(self) -> tuple[str, ...]:
        parts, here = [], self
        while here:
            parts.append(here.names)
            here = here.above
        return tuple(x for names in reversed(parts) for x in names)

    def __getitem__(self, k):
        return self.whole()[k]

    def __eq__(self, other) -> bool:
        return tuple(self) == tuple(other)

    def __hash__(self) -> int:
        return hash(self.whole())

    def __bool__(self) -> bool:
        return True


def blocks(page: str | None) -> list[tuple[str, Sequence[str], float]]:
    """Text, tag path (tags and .names) and share of linked characters of every leaf block."""
    out: list[tuple[str, Sequence[str], float]] = []
    stack: list[Path] = []
    open_: Counter = Counter()
    parts: list[str] = []
    linked = inside = 0

    def pop() -> str:
        tag = stack.pop().tag
        open_[tag] -= 1
        return tag

    def end() -> None:
        nonlocal linked
        if parts and (text := " ".join(references.unescape("".join(parts)).split())):
            out.append((text, stack[-1] if stack else (), min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if inside:
                linked += len(text.strip())

    at, page = 0, page or ""
    for m in _TOKEN.finditer(page):
        said(page[at : m.start()])
        at = m.end()
        if not (tag := (m[3] or "").lower()):
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                inside = 0 if m[2] else 1
            continue
        end()
        inside = 0
        if m[2]:
            if open_[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in VOID or m[4].rstrip().endswith("/"):
            continue
        while stack and (stack[-1].tag in SIBLINGS.get(tag, ()) or stack[-1].tag == "p"):
            pop()
        names = [x for n in _NAMES.finditer(m[4]) if n[1].lower() in ("class", "id", "role") for x in re.split(r"[\s_-]+", (n[2] or n[3] or n[4] or "").lower()) if x]
        stack.append(Path(stack[-1] if stack else None, tag, names))
        open_[tag] += 1
    said(page[at:])
    end()
    return out


@lru_cache(4096)
def _path_vector(name: str) -> np.ndarray:
    return np.random.default_rng(zlib.crc32(name.encode())).standard_normal(PATH_SIZE).astype(np.float32) / 4


@cache
def _word_table() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((4096, WORD_SIZE)).astype(np.float32)


def features(page: list[tuple[str, Sequence[str], float]]) -> np.ndarray:
    """One vector for each block."""
    x = np.zeros((len(page), SIZE), np.float32)
    table, n = _word_table(), max(1, len(page) - 1)
    for k, (text, path, linked) in enumerate(page):
        if path:
            x[k, :PATH_SIZE] = np.clip(path.sum, -3, 3)
        words = _WORD.findall(text.lower())
        if words:
            x[k, PATH_SIZE : PATH_SIZE + WORD_SIZE] = table[[zlib.crc32(w.encode()) & 4095 for w in words]].mean(0)
        size = len(text)
        x[k, -EXTRA:] = (np.log1p(size) / 8, np.log1p(len(words)) / 6, linked, text[-1] in ".!?\"", (text.count(",") + text.count(".")) / size * 10, k / n, len(path) / 12, np.log1p(len(page)) / 6)
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        u = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {d + "w": u(SIZE, 4 * HIDDEN), d + "u": u(HIDDEN, 4 * HIDDEN), d + "c": np.zeros(4 * HIDDEN, np.float32)}
            self.p[d + "c"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p |= {"o": u(2 * HIDDEN, 1), "z": np.zeros(1, np.float32)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction; x is steps x pages x SIZE. Steps beyond a page's end leave its state alone."""
        steps, n, _ = x.shape
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, HIDDEN), np.float32)
        pre = x @ self.p[d + "w"] + self.p[d + "c"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = pre[t] + h @ self.p[d + "u"]
            g = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            s = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * s
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, s, th, m))
            c, h = np.where(m, new, c), np.where(m, o * th, h)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        f = self._run("f", x, mask, keep["f"] if keep else None)
        b = self._run("b", x, mask, keep["b"] if keep else None)
        both = np.concatenate((f, b), axis=2)
        if keep is not None:
            keep["both"] = both
        return (both @ self.p["o"])[:, :, 0] + self.p["z"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, back through time."""
        keep: dict = {"f": [], "b": []}
        z = self.logits(x, mask, keep)
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()).astype(np.float32)
        g = {"o": np.tensordot(keep["both"], dz, ((0, 1), (0, 1)))[:, None], "z": np.array([dz.sum()], np.float32)}
        back = dz[:, :, None] * self.p["o"][:, 0]
        for d, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
            gu, da_all = np.zeros_like(self.p[d + "u"]), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros(part.shape[1:], np.float32), np.zeros(part.shape[1:], np.float32)
            for t, h0, c0, i, f, o, s, th, m in reversed(keep[d]):
                dh = dh + part[t]
                at, dn = dh * m, dc * m
                dn = dn + at * o * (1 - th * th)
                da = np.concatenate((dn * s * i * (1 - i), dn * c0 * f * (1 - f), at * th * o * (1 - o), dn * i * (1 - s * s)), axis=1)
                da_all[t] = da
                gu += h0.T @ da
                dh = np.where(m, da @ self.p[d + "u"].T, dh)
                dc = np.where(m, dn * f, dc)
            g |= {d + "u": gu, d + "w": np.tensordot(x, da_all, ((0, 1), (0, 1))), d + "c": da_all.sum((0, 1))}
        return g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01) -> Labeller:
        rng, first, second, step = np.random.default_rng(SEED), {}, {}, 0
        by_size = np.array_split(np.argsort([len(x) for x in pages], kind="stable"), max(1, len(pages) // BATCH))
        for epoch in range(epochs):
            for k in rng.permutation(len(by_size)):
                x, mask = padded([pages[i] for i in by_size[k]])
                y, _ = padded([labels[i][:, None] for i in by_size[k]])
                step += 1
                for name, g in self.gradients(x, mask, y[:, :, 0]).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                    move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
                    self.p[name] = (self.p[name] - rate * (0.85**epoch) * move).astype(np.float32)
        return self

    def labels(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Whether each block is article; pages of like length go together, at most ``cells`` blocks at once or one page."""
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable").tolist() if len(pages[i])]
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(pages[order[to]]) <= cells:
                to += 1
            z = self.logits(*padded([pages[i] for i in order[at:to]]))
            for k, i in enumerate(order[at:to]):
                out[i] = z[: len(pages[i]), k] > 0
            at = to
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Steps x pages x size, and which cells are in use."""
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# ---- generated training pages ----

_MARK = ""
_SYLLABLES = ("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(), "sch ung keit heit lich ver ein er en st ge be ch au zu ie tz pf ü ä ö ß".split(), "eau tion ment que elle ier aux oi ou ai an en re le è é ê ç".split(), "ción ado mente ez os as ar ía ña que rr ll co do ta ra".split())
_BOILER = (
    "nav|", "div|nav", "ul|menu", "div|menu main-menu", "header|", "div|header site-header", "div|masthead", "footer|", "div|footer", "div|site-footer", "aside|", "aside|sidebar",
    "div|sidebar", "div|widget", "div|related", "section|related-posts", "div|ad", "div|ads", "div|advert", "div|advertisement", "div|banner ad-banner", "div|sponsored", "div|promo",
    "div|cookie", "div|cookie-notice", "div|cookie-banner", "div|notice", "div|alert", "div|popup modal", "div|newsletter", "div|subscribe", "form|", "form|search", "form|login",
    "div|social share", "div|share-buttons", "div|breadcrumb", "div|breadcrumbs", "div|pagination", "div|comments", "section|comments", "div|comment", "ol|comment-list", "div|copyright", "div|legal disclaimer",
)
_MAIN = ("article|", "article|post", "article|article", "main|", "main|content", "div|content", "div|post-content", "div|entry-content", "div|article-body", "div|article", "div|post", "div|story", "section|content", "div|main", "div|text body")
_INNER = ("div|ad", "aside|", "div|advert", "div|sponsored", "div|share", "div|related", "form|newsletter", "div|promo", "aside|sidebar", "div|comments", "section|comments")


def generated(n: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """Pages whose article text carries a mark at each block's start."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]

    def sentence(low: int, high: int) -> str:
        own = pick(_SYLLABLES)
        words = ["".join(pick(own) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(low, high)))]
        return " ".join(words).capitalize() + pick((".", ".", ".", "", "!"))

    def tag(what: str, body: str) -> str:
        name, _, classes = what.partition("|")
        attribute = "" if not classes else f' {pick(("class", "class", "id"))}="{classes}"'
        return f"<{name}{attribute}>{body}</{name}>"

    def links() -> str:
        items = [f'<a href="/{k}">{sentence(1, 3)}</a>' for k in range(int(rng.integers(1, 8)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.6 else " ".join(items)

    def boiler(what: str) -> str:
        kind = rng.random()
        if "form" in what:
            return tag(what, f"<label>{sentence(1, 4)}</label><input><select><option>{sentence(1, 2)}<option>{sentence(1, 2)}</select><button>{sentence(1, 3)}</button>" + (f"<p>{sentence(3, 15)}</p>" if kind < 0.4 else ""))
        if "comment" in what or kind < 0.35:
            body = "".join(f"<p>{sentence(3, 40)}</p>" if rng.random() < 0.7 else f"<div>{sentence(2, 30)}</div>" for _ in range(int(rng.integers(1, 6))))
        elif kind < 0.65:
            body = links()
        else:
            body = sentence(2, 25)
        if rng.random() < 0.2:
            body = f"<h3>{sentence(1, 4)}</h3>" + body
        return tag(what, body)

    def article() -> str:
        out = [f"<h1>{_MARK}{sentence(2, 14)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 14))):
            kind, text = rng.random(), _MARK + sentence(1, 60) + (" " + sentence(3, 60) if rng.random() < 0.5 else "")
            if kind < 0.66:
                out.append(f"<p>{text}</p>")
            elif kind < 0.74:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.8:
                out.append(f"<h2>{_MARK}{sentence(1, 8)}</h2>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{_MARK}{sentence(2, 14)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.93:
                out.append(f"<p>{_MARK}{sentence(3, 9)} <a href='#'>{sentence(1, 4)}</a> {sentence(3, 20)}</p>")
            elif kind < 0.95:
                out.append(f"<table><tr><td>{_MARK}{sentence(1, 4)}</td><td>{_MARK}{sentence(1, 4)}</td></tr></table>")
            else:
                out.append(boiler(pick(_INNER)))
        body = "".join(out)
        what = pick(_MAIN) if rng.random() < 0.7 else "article|"
        body = tag(what, body)
        return tag(pick(("div|wrapper", "div|container", "div|page", "main|")), body) if rng.random() < 0.3 else body

    pages = []
    for _ in range(n):
        before = [boiler(pick(_BOILER)) for _ in range(int(rng.integers(0, 5)))]
        after = [boiler(pick(_BOILER)) for _ in range(int(rng.integers(0, 5)))]
        page = f"<!DOCTYPE html><html><head><title>{sentence(2, 10)}</title><style>p{{}}</style></head><body>" + "".join(before) + (article() if rng.random() < 0.97 else "") + "".join(after) + "</body></html>"
        pages.append(page[: int(rng.integers(len(page) // 2, len(page)))] if rng.random() < 0.12 else page)
    return pages


def labelled(pages: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors and labels of generated pages."""
    xs, ys = [], []
    for page in pages:
        found = blocks(page)
        if found:
            xs.append(features([(t.replace(_MARK, "") or " ", p, a) for t, p, a in found]))
            ys.append(np.array([_MARK in t for t, _, _ in found], np.float32))
    return xs, ys


@cache
def model() -> Labeller:
    return Labeller().fit(*labelled(generated()))


def texts(pages: list[str | None], own: Labeller) -> list[str]:
    """The main text of every page."""
    found = [blocks(p) for p in pages]
    keep = own.labels([features(b) for b in found])
    return ["\n".join(t for (t, _, _), k in zip(b, ks, strict=True) if k) for b, ks in zip(found, keep, strict=True)]


def extract(pages: DataFrame, own: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(own or model())
    wanted = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 256):
            found = texts(batch.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return wanted.mapInArrow(run, f"page_id {wanted.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
