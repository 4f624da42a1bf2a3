"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks. A bidirectional LSTM in numpy reads each block's tag path and hashed words in the
context of the whole page and says whether it belongs to the article. It is trained here, on a bounded sample of pages: on
their own blocks, labelled by the landmarks that they carry, with landmarks hidden at random; and on pages composed from
their paragraphs with menus, notices, forms, sidebars and comments around them, whose labels are known.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import tuned

#: Pages that the labeller is trained on at most, drawn by a hash of page_id.
SAMPLE = 300
HIDDEN, EPOCHS, RATE, BATCH = 16, 12, 0.01, 32
PATH, WORDS, NUMBERS = 64, 32, 9

# The elements of HTML whose content is no markup and no text, to the end of the page if they stay open; those
# whose content is no text of the page if they are closed, and which of these hold their own kind; what a head may hold, and
# the elements that end no block, and that never close.
RAW = frozenset("script style".split())
SILENT = (*sorted(RAW), *"textarea title noscript template svg iframe select button audio video".split())
NESTING = frozenset("svg template".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript template title".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("svg object canvas math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same kind, or of those named, closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks that end an open paragraph.
AFTER_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(SILENT) + r")(?![\w:.-])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: The next opening or close of an element; an svg that closes itself opens nothing.
_NEXT = {name: re.compile(rf"<(/?){name}(?![\w:.-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(/?)>", re.I) for name in SILENT if name not in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PIECES = re.compile(r"[a-z]+")

# Words of class names, ids and roles that mark what is no article, and what is one; used for labels of training pages only.
_ASIDE = frozenset("ad ads advert advertisement banner sponsor promo nav menu breadcrumb sidebar side widget related share social cookie consent notice alert popup modal newsletter subscribe signup login form search comment comments reply discussion respond footer header copyright pager pagination tags".split())
_MAIN = frozenset("article main content post entry story body".split())


def _close(page: str, name: str, at: int) -> int | None:
    """Where the element that opened before `at` has closed; None where it has no close before another of its kind opens."""
    if name in RAW:
        return m.end() if (m := _END[name].search(page, at)) else None
    depth = 1
    for m in _NEXT[name].finditer(page, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif name not in NESTING:
            return None
        elif not m[2]:
            depth += 1
    return None


@dataclass
class Block:
    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text between tags that end a block, references decoded, white space as one space.

    Only script and style run to the end of the page where they aren't closed, and a title to the next tag; others of SILENT
    are text like any element then. A head ends where its body begins, with an end tag or without.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = at = 0
    head, open_ended = False, set()

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(stack), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    while m := _TAG.search(page, at):
        if m.start() > at:
            raw = page[at : m.start()]
            parts.append(raw)
            head = head and raw.isspace()
            if links:
                linked += len(raw)
        at = m.end()
        name, close, own = (m[1], "", m[2]) if m[1] else (m[4], m[3], m[5])
        if not name:
            continue
        name = name.lower()
        if m[1] and name not in open_ended and not (name == "svg" and own.endswith("/")):
            if stop := _close(page, name, at):
                at = stop
                continue
            if name in RAW:
                at = len(page)
                break
            if name in NESTING:  # searched once a page: it may nest for long
                open_ended.add(name)
            if name == "title":  # as far as it can be: no title holds an element
                at = tag if (tag := page.find("<", at)) >= 0 else len(page)
                continue
        if name == "head":
            end()
            head = not close
            continue
        if head and (close or name in IN_HEAD):
            continue
        head = False
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = 0 if close else 1
            continue
        end()
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        closes = CLOSES.get(name)
        while stack and (closes and stack[-1][0] in closes or stack[-1][0] == "p" and name in AFTER_P):
            stack.pop()
        if name not in VOID and not own.endswith("/"):
            names = tuple(w for a in _NAMES.findall(own) for w in _PIECES.findall("".join(a).lower())) if own else ()
            stack.append((name, names))
    if at < len(page):
        parts.append(page[at:])
    end()
    return out


_PATHS: dict = {}


def _path_vector(path) -> np.ndarray:
    """Hashed elements and names of a tag path; the last element counts once more by itself."""
    found = _PATHS.get(path)
    if found is None:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        found = np.zeros(PATH, np.float32)
        for tag, names in path:
            for key in (tag, *("." + n for n in names)):
                found[zlib.crc32(key.encode()) % PATH] += 1
        if path:
            found[zlib.crc32(("/" + path[-1][0]).encode()) % PATH] += 1
        _PATHS[path] = np.minimum(found, 2, out=found)
    return found


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), PATH + WORDS + NUMBERS), np.float32)
    for i, b in enumerate(page):
        words = b.text.encode("utf-8", "replace").lower().split()
        n = len(words)
        x[i, :PATH] = _path_vector(b.path)
        x[i, PATH : PATH + WORDS] = np.bincount([zlib.crc32(w) % WORDS for w in words], minlength=WORDS) / n**0.5
        t = b.text
        x[i, PATH + WORDS :] = (np.log1p(len(t)) / 4, np.log1p(n) / 3, b.linked / len(t), (t.count(".") + t.count(",")) / n, t[-1:] in ".!?", t[:1].isupper(), i / len(page), len(b.path) / 8, np.log1p(len(page)) / 5)
    return x


def _landmark(b: Block) -> bool:
    """Whether a training block is article text, by its landmarks."""
    names = {n for _, ns in b.path for n in ns}
    tags = {t for t, _ in b.path}
    return bool(tags & {"article", "main"} or names & _MAIN) and not (tags & {"nav", "aside", "footer", "form"} or names & _ASIDE)


class Lstm:
    """One direction. Rows beyond a sequence's end leave the state as it is."""

    def __init__(self, d: int, rng):
        self.p = [rng.normal(0, d**-0.5, (d, 4 * HIDDEN)).astype(np.float32), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32), np.zeros(4 * HIDDEN, np.float32)]
        self.p[2][HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x, mask, steps):
        n, h = len(x), HIDDEN
        proj, out = x @ self.p[0] + self.p[2], np.zeros((*x.shape[:2], h), np.float32)
        state, cell, self.tape = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in steps:
            z = proj[:, t] + state @ self.p[1]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            th, m = np.tanh(new), mask[:, t, None]
            self.tape.append((t, state, cell, i, f, o, g, th, m))
            state, cell = m * (o * th) + (1 - m) * state, m * new + (1 - m) * cell
            out[:, t] = state
        return out

    def backward(self, x, above):
        dwx, dwh, db = (np.zeros_like(p) for p in self.p)
        ds, dc = np.zeros_like(above[:, 0]), np.zeros_like(above[:, 0])
        for t, state, cell, i, f, o, g, th, m in reversed(self.tape):
            ds = ds + above[:, t]
            own, keep = ds * m, ds * (1 - m)
            dn = own * o * (1 - th * th) + dc * m
            dz = np.concatenate([dn * g * i * (1 - i), dn * cell * f * (1 - f), own * th * o * (1 - o), dn * i * (1 - g * g)], axis=1)
            dwx += x[:, t].T @ dz
            dwh += state.T @ dz
            db += dz.sum(axis=0)
            ds, dc = dz @ self.p[1].T + keep, dn * f + dc * (1 - m)
        return [dwx, dwh, db]


class Labeller:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = PATH + WORDS + NUMBERS
        self.ways = [Lstm(d, rng), Lstm(d, rng)]
        self.out = [rng.normal(0, 0.2, (2 * HIDDEN, 1)).astype(np.float32), np.zeros(1, np.float32)]

    @staticmethod
    def _padded(pages: list[np.ndarray]):
        most = max(map(len, pages))
        x, mask = np.zeros((len(pages), most, PATH + WORDS + NUMBERS), np.float32), np.zeros((len(pages), most), np.float32)
        for k, v in enumerate(pages):
            x[k, : len(v)], mask[k, : len(v)] = v, 1
        return x, mask

    def _forward(self, x, mask):
        most = x.shape[1]
        h = np.concatenate([self.ways[0].forward(x, mask, range(most)), self.ways[1].forward(x, mask, range(most - 1, -1, -1))], axis=2)
        return h, 1 / (1 + np.exp(-np.clip((h @ self.out[0] + self.out[1])[:, :, 0], -30, 30)))

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Pages of like lengths run together."""
        result: list = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        for lo in range(0, len(order), 64):
            group = [k for k in order[lo : lo + 64] if len(pages[k])]
            for k in order[lo : lo + 64]:
                result[k] = np.zeros(0)
            if group:
                p = self._forward(*self._padded([pages[k] for k in group]))[1]
                for row, k in zip(p, group, strict=True):
                    result[k] = row[: len(pages[k])]
        for way in self.ways:
            way.tape = []
        return result

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 12) -> Labeller:
        rng = np.random.default_rng(seed)
        params = [*self.ways[0].p, *self.ways[1].p, *self.out]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), BATCH):
                group = order[lo : lo + BATCH]
                x, mask = self._padded([pages[k] for k in group])
                y = np.zeros_like(mask)
                for r, k in enumerate(group):
                    y[r, : len(labels[k])] = labels[k]
                x = x * np.repeat(rng.random((len(group), 1, x.shape[2])) > 0.05, x.shape[1], axis=1)
                h, p = self._forward(x, mask)
                err = ((p - y) * mask / mask.sum())[:, :, None]
                dh = err @ self.out[0].T
                grads = [*self.ways[0].backward(x, dh[:, :, :HIDDEN]), *self.ways[1].backward(x, dh[:, :, HIDDEN:]), np.einsum("nth,nto->ho", h, err), err.sum(axis=(0, 1))]
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                for w, g, a, b in zip(params, grads, first, second, strict=True):
                    g = g / max(1.0, size)
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        for way in self.ways:
            way.tape = []
        return self


def _hidden(page: list[Block]) -> list[Block]:
    """A page without landmarks: plain containers, no names."""
    return [Block(tuple(("div" if t in ("article", "main", "section") else t, ()) for t, _ in b.path), b.text, b.linked) for b in page]


def _composed(paragraphs: list[str], rng) -> tuple[list[Block], np.ndarray]:
    """An article of some paragraphs between things that are none."""
    pick = lambda n: [html.escape(paragraphs[k]) for k in rng.integers(0, len(paragraphs), n)]
    some = lambda n, k: " ".join(" ".join(pick(1)).split()[: rng.integers(1, n)] or ["x"]) if k else ""
    words = lambda n: some(n, 1)
    link = lambda: f'<li><a href="#">{words(4)}</a></li>'
    extras = [
        lambda: f"<nav><ul>{''.join(link() for _ in range(rng.integers(2, 9)))}</ul></nav>",
        lambda: f'<header><div class="logo">{words(5)}</div><p>{words(9)}</p></header>',
        lambda: f'<div class="cookie-notice"><p>{words(25)}</p><button>{words(3)}</button></div>',
        lambda: f'<div class="ad">{words(20)}</div>',
        lambda: f'<aside class="sidebar"><h3>{words(4)}</h3><ul>{"".join(link() for _ in range(rng.integers(1, 6)))}</ul><p>{words(20)}</p></aside>',
        lambda: f'<form><label>{words(4)}</label><input name="q"><p>{words(8)}</p></form>',
    ]
    tail = [
        lambda: f'<section class="comments"><h3>{words(3)}</h3>' + "".join(f'<div class="comment"><p>{words(30)}</p></div>' for _ in range(rng.integers(1, 6))) + "</section>",
        lambda: f'<div class="related"><h4>{words(4)}</h4><ul>{"".join(link() for _ in range(rng.integers(1, 6)))}</ul></div>',
        lambda: f"<footer><p>&copy; {words(12)}</p></footer>",
        lambda: f'<div class="share">{words(5)}</div>',
    ]
    mark = "\x02"
    body = f"<h1>{mark}{words(9)}</h1>" + "".join(f"<p>{mark}{p}</p>" if rng.random() < 0.9 else f"<h2>{mark}{words(8)}</h2>" for p in pick(int(rng.integers(1, 12))))
    if rng.random() < 0.3:
        body = body.replace("</p><p>", f"</p>{extras[rng.integers(2, len(extras))]()}<p>", 1)
    shell = [("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<div class="post-content">', "</div>"), ('<div id="content">', "</div>"), ("<main>", "</main>"), ("<div><div>", "</div></div>")][rng.integers(0, 6)]
    front = [extras[k]() for k in rng.permutation(len(extras))[: rng.integers(1, 4)]]
    back = [tail[k]() for k in rng.permutation(len(tail))[: rng.integers(1, 4)]]
    page = blocks("".join([*front, shell[0], body, shell[1], *back]))
    y = np.array([mark in b.text for b in page], np.float32)
    for b in page:
        b.text = b.text.replace(mark, "") or "x"
    return page, y


def trained(sample: list[str], seed: int = 13) -> Labeller:
    """The same labeller for the same pages."""
    rng = np.random.default_rng(seed)
    pages, labels, paragraphs = [], [], []
    for page in map(blocks, sample):
        y = np.array([_landmark(b) for b in page], np.float32)
        if y.any():
            paragraphs += [b.text for b, own in zip(page, y, strict=True) if own]
            pages += [page, _hidden(page)][: 2 if rng.random() < 0.3 else 1]
            labels += [y] * (len(pages) - len(labels))
    if not paragraphs:
        paragraphs = ["An article has sentences, and they end in full stops.", "A few words, then some more words.", "Text."]
    for _ in range(max(60, len(pages) // 2)):
        page, y = _composed(paragraphs, rng)
        pages.append(page)
        labels.append(y)
    return Labeller().train([vectors(p) for p in pages], labels)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    A null or empty page, or one without article blocks, has empty text; a null url stays null; every row is read, repeated
    ones alike; an empty table gives no rows; other columns are ignored. Pages are read whole.
    """
    spark = tuned(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("page_id", F.lit(4)), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).orderBy("page_id", "html").limit(2 * sample).select("html").toArrow()
    model = spark.sparkContext.broadcast(trained(drawn.column(0).to_pylist()))

    def run(batches):
        for batch in batches:
            found = [blocks(t) for t in batch.column(2).to_pylist()]
            kept = model.value.probabilities([vectors(p) for p in found])
            texts = ["\n".join(b.text for b, q in zip(p, k, strict=True) if q > 0.5) for p, k in zip(found, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
