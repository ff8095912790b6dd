"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the list of its text blocks (runs of text between block-level tags) with the tags and classes above
them. The field scores each block's features and each change between neighbours; Viterbi finds the best labelling.
It is trained here, by gradient ascent on the exact likelihood, on labelled pages that `labelled_pages` makes up.

A null or empty page has an empty text; broken or cut markup closes where the page ends; form controls and hidden
elements have no text; a page is read in time linear in its length; repeated rows are extracted
each; pages of any length are read whole.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.common import only, slices

# HTML's void, raw-text and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
#: Form controls and their captions: never text. Form itself is a feature, as some sites put whole pages in one.
CONTROLS = frozenset("button select datalist optgroup option label legend output progress meter".split())
_HIDDEN = re.compile(r"(?<![\w-])hidden(?=[\s/]|\Z|\s*=)|(?<![\w-])style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
#: A class that begins so tells what a page has or lacks, not what the element is.
STATES = frozenset("no not non without has with is".split())
#: Tags and words in class, id or role that are features of the blocks below them.
KEY_TAGS = tuple("article main section nav header footer aside form head title menu button select label figure figcaption table ul ol li p h1 h2 h3 h4 blockquote pre dialog".split())
KEY_WORDS = tuple("ad ads advert advertisement sponsor promo banner cookie consent notice alert popup modal newsletter subscribe nav menu navbar breadcrumb sidebar side widget related recommended share social footer header masthead comment comments reply disqus discussion login search tags pagination copyright article content post entry story body text main".split())
# A quote delimits a value only behind an equals sign; elsewhere it is a character like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
#: The same where a quote runs to the page's end: from there on tags end at the next bracket.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\s ]+")
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
_WORDS, _TAGS = frozenset(KEY_WORDS), frozenset(KEY_TAGS)


def blocks(page: str) -> list[tuple[str, frozenset[str], float]]:
    """(text, features of the tags above, share of its characters in links) of every text block, in page order."""
    out: list[tuple[str, frozenset, float]] = []
    # Of each open element: name, features of it and all above, and whether its text is left out.
    stack: list[tuple[str, frozenset, bool]] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    token = _TOKEN
    linked = at = links = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text and not (stack and stack[-1][2]):
            out.append((text, stack[-1][1] if stack else frozenset(), min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if links:
                linked += len(raw.strip())

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while at < len(page):
        m = token.search(page, at)
        if m and m[2] and not m[4] and token is _TOKEN:
            token = _PLAIN
            m = token.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        if m[2] and not m[4]:  # a tag cut at the page's end
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            end = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (len(page) if not m[3].endswith("/") else at)
            continue
        if name == "a":
            links = max(0, links - 1) if m[1] else links + 1
        if name in INLINE:
            continue
        close()
        if name in VOID or m[3].endswith("/"):
            continue
        if m[1]:
            if opened.get(name):
                while pop() != name:
                    pass
        else:
            if name in _CLOSES or name not in ("html", "body", "head"):
                gone = _CLOSES.get(name, {"p"})
                while stack and stack[-1][0] in gone:
                    pop()
            own = {f"t:{name}"} if name in _TAGS else set()
            for a in _NAMED.findall(m[3]):
                for one in "".join(a).lower().split():
                    words = _PART.findall(one)
                    if words and words[0] not in STATES:
                        own |= {f"w:{w}" for w in words if w in _WORDS}
            _, above, off = stack[-1] if stack else ("", frozenset(), False)
            stack.append((name, above if own <= above else above | own, off or name in CONTROLS or bool(m[3] and _HIDDEN.search(m[3]))))
            opened[name] = opened.get(name, 0) + 1
        links = 0 if m[1] and name != "a" else links
    close()
    return out


NAMES = ("bias", "len<30", "len<100", "len>=100", "len>=300", "stop", "links>.5", "links>0", "first", "last", "mark", *[f"t:{t}" for t in KEY_TAGS], *[f"w:{w}" for w in KEY_WORDS])
_AT = {n: i for i, n in enumerate(NAMES)}


def features(found: list[tuple[str, frozenset, float]]) -> np.ndarray:
    x = np.zeros((len(found), len(NAMES)))
    for i, (text, above, share) in enumerate(found):
        own = ["bias", *above]
        n = len(text)
        own.append("len<30" if n < 30 else "len<100" if n < 100 else "len>=100")
        if n >= 300:
            own.append("len>=300")
        if text[-1] in ".!?":
            own.append("stop")
        if share > 0:
            own.append("links>0")
        if share > 0.5:
            own.append("links>.5")
        if "©" in text:
            own.append("mark")
        if i == 0:
            own.append("first")
        if i == len(found) - 1:
            own.append("last")
        x[i, [_AT[f] for f in own]] = 1
    return x


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Made-up pages with a label (1: main text) for each block."""
    rnd = random.Random(seed)
    syllables = "ba ne ri to ku la mi so ve da ch th er on".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(a, b)))

    def sentence(a: int = 1, b: int = 60) -> str:
        return words(a, b).capitalize() + rnd.choice([".", ".", ".", "", "!!", " ***"])

    def menu(k: int) -> tuple[str, list[int]]:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k)) + "</ul>", [0] * k

    def junk(kind: str) -> tuple[str, list[int]]:
        k = rnd.randint(1, 6)
        body, y = rnd.choice([lambda: (f"<p>{sentence()}</p>" * k, [0] * k), lambda: (sentence(2, 30), [0]), lambda: menu(k)])()
        if kind in ("nav", "header", "footer", "aside", "form", "menu"):
            return f"<{kind}>{body}</{kind}>", y
        tag = rnd.choice(["div", "section", "div"])
        return f'<{tag} {rnd.choice(["class", "class", "id"])}="{kind}">{body}</{tag}>', y

    def plain() -> tuple[str, list[int]]:
        """A page of div elements alone: links as menus, prose as text."""
        page, y = ["<html><body>"], []
        for _ in range(rnd.randint(0, 3)):
            page.append("<div>" + " ".join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(rnd.randint(1, 8))) + "</div>")
            y.append(0)
        for _ in range(rnd.randint(1, 8)):
            page.append(f"<div>{words(12, 90).capitalize()}.</div>")
            y.append(1)
        return "".join(page) + "</body></html>", y

    bad = ["nav", "header", "footer", "aside", "form", "menu", *[w for w in KEY_WORDS if w not in ("article", "content", "post", "entry", "story", "body", "text", "main")]]
    out = []
    for _ in range(n):
        if rnd.random() < 0.15:
            out.append(plain())
            continue
        page, y = [f"<html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>"], [0]
        for _ in range(rnd.randint(0, 4)):
            h, l = junk(rnd.choice(bad))
            page.append(h)
            y += l
        tag = rnd.choice(["article", "article", "main", 'div class="content"', 'div class="post entry"', 'div id="story"', 'section class="article-body"'])
        page.append(f"<{tag}>")
        if rnd.random() < 0.8:
            page.append(f"<h1>{sentence(1, 14)}</h1>")
            y.append(1)
        for _ in range(rnd.randint(0, 14)):
            r = rnd.random()
            if r < 0.1:
                h, l = junk(rnd.choice([b for b in bad if b not in ("nav", "header", "footer", "menu")]))
            elif r < 0.2:
                h, l = f"<ul><li>{sentence(1, 12)}</li><li>{sentence(1, 12)}</li></ul>", [1, 1]
            elif r < 0.3:
                inner = rnd.choice(["h2", "h3", "blockquote", "pre"])
                h, l = f"<{inner}>{sentence(1, 9)}</{inner}>", [1]
            elif r < 0.4:
                h, l = f"<p><b>{sentence(1, 12)}<br><p>{sentence()}", [1, 1]
            else:
                h, l = f"<p>{sentence(1, 90)}</p>", [1]
            page.append(h)
            y += l
        page.append(f"</{tag.split()[0]}>")
        for _ in range(rnd.randint(0, 4)):
            h, l = junk(rnd.choice(bad))
            page.append(h)
            y += l
        page.append(rnd.choice([f"<footer>&copy; {words(1, 4)} &middot; {sentence(1, 9)}</footer>", ""]))
        y += [0] if page[-1] else []
        text = "".join(page) + rnd.choice(["</body></html>", ""])
        if len(blocks(text)) == len(y):  # broken markup may join blocks; such pages have no sure labels
            out.append((text, y))
    return out


def train(pages: list[tuple[str, list[int]]], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(features x 2 weights, 2 x 2 transition weights) at about the greatest penalised likelihood, by Adam."""
    xs, ys = [features(blocks(p)) for p, _ in pages], [np.array(y) for _, y in pages]
    top, n = max(map(len, ys)), len(pages)
    lens = np.array([len(y) for y in ys])
    x = np.zeros((n, top, len(NAMES)))
    y = np.zeros((n, top), int)
    for i in range(n):
        x[i, : lens[i]], y[i, : lens[i]] = xs[i], ys[i]
    on = np.arange(top)[None, :] < lens[:, None]
    gold = np.eye(2)[y] * on[..., None]
    gold_t = np.einsum("pia,pib->ab", gold[:, :-1], gold[:, 1:])
    w, t = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, t)]
    for step in range(1, rounds + 1):
        s = x @ w
        alpha, beta = np.zeros((n, top, 2)), np.zeros((n, top, 2))
        alpha[:, 0] = s[:, 0]
        for i in range(1, top):
            new = s[:, i] + np.logaddexp.reduce(alpha[:, i - 1, :, None] + t, axis=1)
            alpha[:, i] = np.where(on[:, i, None], new, alpha[:, i - 1])
        for i in range(top - 2, -1, -1):
            new = np.logaddexp.reduce(t + (s[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
            beta[:, i] = np.where(on[:, i + 1, None], new, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        one = np.exp(alpha + beta - z[:, None, None]) * on[..., None]
        two = np.exp(alpha[:, :-1, :, None] + t + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        for v, g, m in ((w, np.einsum("pif,pia->fa", x, gold - one) / n - decay * w, moments[0]), (t, (gold_t - two.sum(axis=(0, 1))) / n - decay * t, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            v += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return w, t


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages())


def decode(x: np.ndarray, w: np.ndarray, t: np.ndarray) -> list[int]:
    """Viterbi."""
    s = (x @ w).tolist()
    (t00, t01), (t10, t11) = t.tolist()
    a, b = s[0]
    back = []
    for c, d in s[1:]:
        back.append((a + t00 < b + t10, a + t01 < b + t11))
        a, b = c + max(a + t00, b + t10), d + max(a + t01, b + t11)
    y = [int(b > a)]
    for step in reversed(back):
        y.append(int(step[y[-1]]))
    return y[::-1]


def main_text(page: str, w: np.ndarray, t: np.ndarray) -> str:
    found = blocks(page)
    return " ".join(f[0] for f, y in zip(found, decode(features(found), w, t)) if y) if found else ""


def extract(pages: DataFrame, weights: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    w, t = weights or model()

    def run(batches):
        for b in slices(batches, column="html"):
            texts = [main_text(h or "", w, t) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
