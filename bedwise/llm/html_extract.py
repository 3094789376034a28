"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, each with its path of open tags and their classes. A
bidirectional LSTM in numpy reads the sequence of a page's blocks, as hashed path parts, hashed words and a few numbers,
and labels each block as article or not with the whole page as context. Blocks of the article are joined in page order.

The model is trained on a bounded sample of the pages themselves: blocks that their own structure marks (inside or
outside an article element), and the same contents set anew into made layouts with menus, notices, adverts, forms, sidebars and
comments, whose labels are known because they were made. Pages are read whole; only the training sample is bounded.

Defined results. Null or empty html, or no article block: empty text. Broken markup (open tags, cut pages) is read as far as
it goes. Repeated rows give equal rows; ids may be null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedwise.llm.common import LOWER, prefix_hash, span_hash, word_spans, word_table

SAMPLE, LONGEST = 240, 60_000
MADE_PER_PAGE = 4
SEED = 11
PATH_BUCKETS, WORD_BUCKETS, WIDTH, HIDDEN, NUMBERS = 2048, 1024, 24, 24, 8
STEPS, BATCH, RATE = 260, 32, 0.01
LETTER = word_table(lambda b: 97 <= b <= 122 or 48 <= b <= 57 or b >= 128)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PARTS = re.compile(r"[a-z]+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Blocks of a page: texts, paths of open tags (outermost first) with their names, and the share of text in links."""

    def __init__(self, source: str):
        self.texts, self.paths, self.linked = [], [], []
        stack: list[tuple[str, ...]] = []
        pieces: list[str] = []
        links, in_link, at = 0, 0, 0

        def close():
            nonlocal links
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                self.texts.append(text)
                self.paths.append(tuple(stack))
                self.linked.append(min(1.0, links / len(text)))
            pieces.clear()
            links = 0

        for m in MARKUP.finditer(source):
            if m.start() > at:
                pieces.append(source[at:m.start()])
                links += (m.start() - at) * (in_link > 0)
            at = m.end()
            if m[1]:
                close()
                continue
            name = (m[3] or "").lower()
            if not name:
                continue
            if name in INLINE:
                in_link += (name == "a") * (-1 if m[2] else 1)
                in_link = max(0, in_link)
                continue
            close()
            in_link = 0
            if m[2]:
                for level in range(len(stack) - 1, -1, -1):
                    if stack[level][0][1:] == name:
                        del stack[level:]
                        break
            elif name not in EMPTY:
                if stack and (stack[-1][0] == "<p" or stack[-1][0] == f"<{name}" and name in ("li", "option", "dd", "dt", "tr", "td", "th")):
                    stack.pop()
                parts = [f"<{name}"]
                for found in NAMES.finditer(m[4] or ""):
                    value = found[1] or found[2] or found[3] or ""
                    parts += [p.lower() for word in PARTS.findall(value) for p in CAMEL.split(word)]
                stack.append(tuple(parts))
        if at < len(source):
            pieces.append(source[at:])
        close()


def path_parts(path: tuple[tuple[str, ...], ...]) -> set[str]:
    return {part for parts in path for part in parts}


_buckets: dict[tuple, list[int]] = {}


def path_buckets(path: tuple[tuple[str, ...], ...]) -> list[int]:
    """Buckets of a path's parts, with their distance from the block and without; kept for the next block."""
    found = _buckets.get(path)
    if found is None:
        if len(_buckets) > 50_000:
            _buckets.clear()
        named = [f"{min(level, 3)}{part}" for level, parts in enumerate(reversed(path)) for part in parts] + [part for parts in path for part in parts]
        found = _buckets[path] = [zlib.crc32(part.encode()) % PATH_BUCKETS for part in named]
    return found


def word_hash(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    buf = LOWER[np.frombuffer(b"".join(data), np.uint8)]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    starts, ends, first = word_spans(buf, off, LETTER)
    return (span_hash(prefix_hash(buf), starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64), first


class Blocks:
    """Inputs of the labeller for the blocks of several pages, one after another."""

    def __init__(self, pages: list[Page]):
        texts = [t for p in pages for t in p.texts]
        self.sizes = np.array([len(p.texts) for p in pages], np.int64)
        paths = [path_buckets(x) for p in pages for x in p.paths]
        self.path, self.path_at = np.array([b for x in paths for b in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in paths])]).astype(np.int64)
        self.words, self.words_at = word_hash(texts)
        n_words = np.diff(self.words_at)
        length = np.array([len(t) for t in texts], float)
        place = np.concatenate([np.arange(n) / max(1, n - 1) for n in self.sizes.tolist()]) if len(texts) else np.zeros(0)
        linked = np.array([x for p in pages for x in p.linked])
        marks = np.array([sum(map(t.count, ".,;!?")) for t in texts], float)
        depth = np.diff(self.path_at) / 2.0
        self.numbers = np.stack([
            np.log1p(length) / 6, linked, place, 1 - place, np.minimum(n_words, 200) / 50, marks / np.maximum(n_words, 1), np.minimum(depth, 20) / 20, np.ones(len(texts))], axis=1)


def bag_mean(table: np.ndarray, items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of the rows of ``table`` named by each bag."""
    out = np.zeros((len(at) - 1, table.shape[1]))
    size = np.diff(at)
    full = np.flatnonzero(size)
    if len(full):
        # Bags of words are long: gathered in runs to bound memory.
        for lo in range(0, len(full), 4096):
            some = full[lo:lo + 4096]
            a, b = at[some[0]], at[some[-1] + 1]
            out[some] = np.add.reduceat(table[items[a:b]], at[some] - a, axis=0) / size[some, None]
    return out


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Bidirectional LSTM over block vectors, one logistic output per block."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @staticmethod
    def fresh(seed: int = SEED) -> "Labeller":
        rng = np.random.default_rng(seed)
        wide = 2 * WIDTH + NUMBERS
        p = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, WIDTH)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WIDTH))}
        for side in "fb":
            p[f"w{side}"] = rng.normal(0, 0.2, (wide + HIDDEN, 4 * HIDDEN))
            p[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["out"] = rng.normal(0, 0.2, 2 * HIDDEN + wide)
        p["bias"] = np.zeros(1)
        return Labeller(p)

    def vectors(self, b: Blocks) -> np.ndarray:
        return np.concatenate([bag_mean(self.p["path"], b.path, b.path_at), bag_mean(self.p["word"], b.words, b.words_at), b.numbers], axis=1)

    def _pass(self, x: np.ndarray, there: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """One direction over padded sequences [page, block, vector]."""
        w, c0 = self.p[f"w{side}"], self.p[f"c{side}"]
        n, t_max, wide = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        fed = x @ w[:wide] + c0
        out = np.zeros((n, t_max, HIDDEN))
        for t in range(t_max) if side == "f" else range(t_max - 1, -1, -1):
            a = fed[:, t] + h @ w[wide:]
            gates, g = sigmoid(a[:, :3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN:])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            new_c = f * c + i * g
            new_h = o * np.tanh(new_c)
            m = there[:, t, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, new_c, m))
            h, c = np.where(m, new_h, h), np.where(m, new_c, c)
            out[:, t] = np.where(m, new_h, 0)
        return out

    def scores(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._pass(x, there, "f"), self._pass(x, there, "b"), x], axis=2)
        return h @ self.p["out"] + self.p["bias"]

    def label(self, pages: list[Page]) -> list[np.ndarray]:
        """Which blocks of each page belong to the article."""
        b = Blocks(pages)
        flat = self.vectors(b)
        start = np.concatenate([[0], np.cumsum(b.sizes)])
        out = [np.zeros(0, bool)] * len(pages)
        order = np.argsort(b.sizes, kind="stable")
        order = order[b.sizes[order] > 0]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * b.sizes[order[hi]] <= 40_000:
                hi += 1
            some = order[lo:hi]
            lo = hi
            x, there = padded(flat, start, some)
            s = self.scores(x, there)
            for r, i in enumerate(some.tolist()):
                out[i] = s[r, :b.sizes[i]] > 0
        return out

    def fit(self, pages: list[Page], labels: list[np.ndarray], seed: int = SEED) -> "Labeller":
        rng = np.random.default_rng(seed)
        p = self.p
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        every = Blocks(pages)
        start = np.concatenate([[0], np.cumsum(every.sizes)])
        truth = np.concatenate(labels).astype(float)
        usable = np.flatnonzero(every.sizes > 0)
        for step in range(1, STEPS + 1):
            some = rng.choice(usable, min(BATCH, len(usable)), replace=False)
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in some])
            sub = self._some(every, rows, every.sizes[some])
            flat = self.vectors(sub)
            first = np.concatenate([[0], np.cumsum(sub.sizes)])
            x, there = padded(flat, first, np.arange(len(some)))
            y, _ = padded(truth[rows][:, None], first, np.arange(len(some)))
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            kept: dict[str, list] = {"f": [], "b": []}
            h = np.concatenate([self._pass(x, there, "f", kept["f"]), self._pass(x, there, "b", kept["b"]), x], axis=2)
            d = (sigmoid(h @ p["out"] + p["bias"]) - y[:, :, 0]) * there / there.sum()
            grads["out"] = np.einsum("bt,bth->h", d, h)
            grads["bias"] = np.array([d.sum()])
            dh_all = d[:, :, None] * p["out"]
            dx = dh_all[:, :, 2 * HIDDEN:].copy()
            wide = x.shape[2]
            for k, side in enumerate("fb"):
                w, gw, gc = p[f"w{side}"], grads[f"w{side}"], grads[f"c{side}"]
                dh, dc = np.zeros((len(some), HIDDEN)), np.zeros((len(some), HIDDEN))
                for t, h0, c0, i, f, o, g, c1, m in reversed(kept[side]):
                    th = np.tanh(c1)
                    dn = (dh + dh_all[:, t, k * HIDDEN:(k + 1) * HIDDEN]) * m
                    dcn = dc * m + dn * o * (1 - th * th)
                    da = np.concatenate([dcn * g * i * (1 - i), dcn * c0 * f * (1 - f), dn * th * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
                    gw[:wide] += x[:, t].T @ da
                    gw[wide:] += h0.T @ da
                    gc += da.sum(axis=0)
                    dx[:, t] += da @ w[:wide].T
                    dh = np.where(m, da @ w[wide:].T, dh)
                    dc = np.where(m, dcn * f, dc)
            back = np.concatenate([dx[r, :n] for r, n in enumerate(sub.sizes.tolist())])
            for name, items, at, cols in (("path", sub.path, sub.path_at, slice(0, WIDTH)), ("word", sub.words, sub.words_at, slice(WIDTH, 2 * WIDTH))):
                size = np.diff(at)
                np.add.at(grads[name], items, np.repeat(back[:, cols] / np.maximum(size, 1)[:, None], size, axis=0))
            for key, g in grads.items():
                m, v = moments[key]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p[key] -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self

    @staticmethod
    def _some(b: Blocks, rows: np.ndarray, sizes: np.ndarray) -> Blocks:
        out = Blocks.__new__(Blocks)
        out.sizes, out.numbers = sizes, b.numbers[rows]
        for items, at in (("path", "path_at"), ("words", "words_at")):
            old, pos = getattr(b, items), getattr(b, at)
            setattr(out, items, np.concatenate([old[pos[r]:pos[r + 1]] for r in rows]) if len(rows) else old[:0])
            setattr(out, at, np.concatenate([[0], np.cumsum((pos[1:] - pos[:-1])[rows])]))
        return out


def padded(flat: np.ndarray, start: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = (start[1:] - start[:-1])[some]
    x = np.zeros((len(some), int(size.max()), flat.shape[1]))
    there = np.arange(x.shape[1]) < size[:, None]
    for r, i in enumerate(some.tolist()):
        x[r, :size[r]] = flat[start[i]:start[i + 1]]
    return x, there


# --- training pages -----------------------------------------------------------------------------------------------

def marked(page: Page) -> np.ndarray | None:
    """Labels that the page's own structure gives; None where it has no article element."""
    inside = np.array([bool({"<article", "<main"} & path_parts(p)) for p in page.paths], bool)
    aside = np.array([bool({"<nav", "<aside", "<footer", "<form"} & path_parts(p)) for p in page.paths], bool)
    return inside & ~aside if inside.any() else None


def made_page(rng: np.random.Generator, content: list[str], words: list[str]) -> tuple[str, str]:
    """A page in a made layout: its source, with article blocks marked by a sign at their start, which is also returned."""
    pick = lambda *x: x[rng.integers(len(x))]
    sign = ""
    say = lambda n: html.escape(" ".join(words[rng.integers(len(words))] for _ in range(max(1, int(n)))))
    lines = lambda: rng.integers(3, 40)
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{say(1)}</a></li>' for k in range(rng.integers(2, 9))) + "</ul>"

    def wrap(names, tag="div"):
        name = pick(*names)
        how = rng.integers(3)
        return f"<{tag} class=\"{name}\">" if how == 0 else f"<{tag} id=\"{name}\">" if how == 1 else f"<{tag} class=\"{pick('box', 'widget', 'block', 'col')} {name}\">"

    above = [
        lambda: f"<nav>{menu()}</nav>", lambda: f"<header><h1>{say(3)}</h1>{pick('', '<p>' + say(6) + '</p>')}{menu()}</header>", lambda: f"{wrap(('menu', 'navbar', 'top-nav', 'breadcrumb'))}{menu()}</div>",
        lambda: f"{wrap(('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo'))}{say(lines())}</div>", lambda: f"{wrap(('notice', 'cookie-notice', 'alert', 'consent', 'cookie-banner', 'message'))}{pick('<p>', '')}{say(lines())}</div>",
        lambda: f"<form>{pick('', '<label>' + say(2) + '</label>')}<input name=q><button>{say(1)}</button></form>", lambda: f"{wrap(('header', 'masthead', 'site-header'))}{say(5)}</div>",
        lambda: f"{wrap(('sidebar', 'side', 'related'), pick('div', 'aside'))}<h3>{say(2)}</h3><p>{say(lines())}</p></aside></div>",
    ]
    under = [
        lambda: f"<footer>&copy; {say(rng.integers(3, 20))}</footer>", lambda: f"{wrap(('footer', 'copyright', 'site-footer'))}<p>{say(lines())}</p></div>",
        lambda: f"<aside>{pick('<h3>' + say(2) + '</h3>', '')}<p>{say(lines())}</p>{menu()}</aside>", lambda: f"{wrap(('sidebar', 'related', 'recommended', 'more'))}<p>{say(lines())}</p></div>",
        lambda: f"{wrap(('comments', 'comment-list', 'reader-comments', 'discussion', 'responses'), pick('div', 'section'))}<h3>{say(2)}</h3>" + "".join(
            f"<div class=\"comment\"><p>{say(lines())}</p></div>" for _ in range(rng.integers(1, 4))) + "</section></div>",
        lambda: f"{wrap(('newsletter', 'subscribe', 'login', 'contact-form'), 'form')}<p>{say(8)}</p><input><button>{say(1)}</button></form>",
        lambda: f"{wrap(('ad', 'advertisement', 'banner', 'sponsor'))}{say(lines())}</div>", lambda: f"{wrap(('share', 'social', 'tags', 'pagination'))}{menu()}</div>",
    ]
    within = [
        lambda: f"{wrap(('ad', 'advert', 'promo', 'sponsored'))}{say(lines())}</div>", lambda: f"<aside>{say(lines())}</aside>", lambda: f"{wrap(('notice', 'alert', 'newsletter'))}<p>{say(lines())}</p></div>",
        lambda: f"<form><p>{say(6)}</p><input></form>", lambda: f"{wrap(('comments', 'comment-list'))}<p>{say(lines())}</p></div>", lambda: f"<nav>{menu()}</nav>",
    ]
    open_, shut = pick(
        ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"),
        ('<div class="post entry-content">', "</div>"), ('<section class="article-body">', "</section>"), ('<div id="content"><div class="text">', "</div></div>"), ('<td class="story">', "</td>"))
    out = ['<!DOCTYPE html><html><head><meta charset="utf-8"><title>x</title><style>p{}</style><script>var a="<p>";</script></head><body>']
    out += [above[k]() for k in rng.choice(len(above), rng.integers(0, 4), replace=False)]
    out.append(open_)
    for k, text in enumerate(content):
        text = sign + html.escape(text)
        out.append(pick(f"<h1>{text}</h1>", f"<header><h1>{text}</h1></header>") if k == 0 and rng.random() < 0.7 else pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<h2>{text}</h2>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li></ul>", f"<div>{text}</div>"))
        if rng.random() < 0.12:
            out.append(within[rng.integers(len(within))]())
    out.append(shut)
    out += [under[k]() for k in rng.choice(len(under), rng.integers(0, 5), replace=False)]
    return "".join(out) + "</body></html>", sign


def training_set(sources: list[str], seed: int = SEED) -> tuple[list[Page], list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    pages, labels, contents, words = [], [], [], []
    for source in sources:
        page = Page(source)
        label = marked(page)
        if label is not None and label.any():
            pages.append(page)
            labels.append(label)
            contents.append([t for t, y in zip(page.texts, label) if y])
            words += [w for t in contents[-1] for w in t.split()[:60]]
    words = words or ["text", "word", "line", "page", "more", "about"]
    for content in contents or [["a line of text", "and one more line of it, somewhat longer than the first"]] * 8:
        for _ in range(MADE_PER_PAGE):
            part = content[rng.integers(0, max(1, len(content) - 1)):][:rng.integers(1, 14)]
            source, sign = made_page(rng, part, words)
            page = Page(source)
            label = np.array([t.startswith(sign) for t in page.texts], bool)
            page.texts = [t.lstrip(sign) or "x" for t in page.texts]
            pages.append(page)
            labels.append(label)
    return pages, labels


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Fit on at most ``sample`` pages of at most LONGEST characters, chosen by a hash."""
    usable = pages.where(f"length(html) BETWEEN 1 AND {LONGEST}").select("html", F.xxhash64("html").alias("h"))
    # The hashes are ordered without the pages, so that a task sends numbers to the driver and only the sample's pages follow.
    least = usable.select("h").distinct().orderBy("h").limit(sample)
    chosen = usable.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"])  # ``sample`` numbers
    return Labeller.fresh().fit(*training_set([r["html"] for r in sorted(chosen.collect(), key=lambda r: r["h"])]))


def main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                read = [Page(h or "") for h in some.column(2).to_pylist()]
                texts = [" ".join(t for t, y in zip(p.texts, keep) if y) for p, keep in zip(read, shared.value.label(read))]
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
