"""Main text of HTML pages by a linear-chain conditional random field over the leaf blocks.

A page is read tag by tag into leaf blocks: runs of text between the borders of block-level elements,
with the names, classes and roles of all ancestors.  Every block is content or not; a chain over the blocks
of a page scores features of each block and the change from one to the next, and Viterbi decoding picks
the best labelling.  Features are ancestor tags, words of ancestor classes, and the text (length, share
of links, marks, position, neighbours).

The pages teach the model themselves: where a page names its parts (``article`` or ``main``, beside
``nav``, ``footer``, ``aside`` and the like) its blocks are labelled by them.  At most ``MOST`` such pages
are learned from (those whose hashed ids are least), each once as it is and once with the naming tags
hidden, so that class words and texts are learned too.  Weights have a Gaussian prior around ``EXPECT``,
which speaks where the learned pages have no such feature.

Defined cases: null html counts as empty and gives empty text; a page without content blocks gives
empty text; without labelled pages the prior alone decides; ids may be null or repeated; an unclosed
comment, tag, script or style reaches to the end; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small, whole

MOST, EPOCHS, RATE, RIDGE = 400, 6, 0.3, 0.02

BORDERS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe svg math object canvas audio video head title textarea select datalist noframes noembed xmp".split())
#: An opening tag of these ends an open one of the same group.
ENDS = {t: g for g in ("p", "li", "dd dt", "option", "tr", "td th") for t in g.split()}
#: Elements that hold blocks, so they end an open paragraph.
HOLDERS = BORDERS - {"br", "button", "option", "optgroup", "select", "textarea"}
CONTENT = frozenset("article main".split())
ASIDE = frozenset("nav footer aside header form menu button dialog fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent footer header masthead menu modal nav navbar navigation newsletter "
    "notice popup promo promoted related recommended share sharing sidebar signup social sponsor sponsored subscribe toolbar widget disqus replies reply".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
#: Where a weight is expected without evidence.
EXPECT = (
    {f"t:{t}": -10.0 for t in ASIDE} | {f"c:{w}": -5.0 for w in ASIDE_WORDS} | {f"t:{t}": 2.5 for t in CONTENT}
    | {f"c:{w}": 2.0 for w in "article content post entry story body text main".split()}
    | {"b:p": 1.0, "b:li": -0.5, "b:td": -0.3, "len:0": -0.5, "len:3": 1.0, "len:4": 1.5, "link:3": -2.0, "copyright": -2.0, "stay": 0.6, "bias": -0.5}
)

_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_RIGHTS = re.compile(r"©|copyright|\(c\)\s*\d{4}|all rights reserved", re.I)


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    words: frozenset[str]
    linked: int
    features: list[str] = field(default_factory=list)


@dataclass
class _Open:
    tag: str
    words: frozenset[str]
    called: bool = False  # has a class, id or role that is an aside word, no longer name round one


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order; text that no reader sees is left out."""
    out: list[Block] = []
    paths: list[tuple[_Open, ...]] = []
    firsts: dict[str, tuple[_Open, ...]] = {}
    stack: list[_Open] = []
    text: list[str] = []
    linked, link, at, size, last = 0, 0, 0, len(page), page.rfind(">")

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            tags = tuple(o.tag for o in stack)
            if "header" in tags and CONTENT & set(tags[: tags.index("header")]):
                tags = tuple("title" if t == "header" else t for t in tags)  # an article's own heading
            out.append(Block(joined, tags, frozenset(), linked))
            paths.append(tuple(stack))
        text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = entities.unescape(raw)
            text.append(plain)
            linked += len(plain.strip()) if link else 0

    def close(upto: int) -> None:
        del stack[upto:]

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        follows = page[lt + 1 : lt + 2]
        if not (follows.isascii() and (follows.isalpha() or follows in ("/", "!", "?"))) or not follows:
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4) if not page.startswith("<!-->", lt) else lt + 2
            at = size if end < 0 else end + 3
            continue
        if lt > last:
            break  # the tag never ends
        if follows in "!?":
            at = page.index(">", lt) + 1
            continue
        closing = follows == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            at = page.index(">", lt) + 1
            continue
        tag = name[0].lower()
        rest = _REST.match(page, name.end())
        end = rest.end() if rest else page.index(">", lt) + 1
        attributes, at = page[name.end() : end - 1], end
        border = tag in BORDERS
        if border:
            flush()
        if closing:
            if tag == "a":
                link = 0
            elif border and tag != "br":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
            continue
        if tag in UNSEEN and not attributes.endswith("/"):
            at = _behind(page, tag, at)
            continue
        if tag == "a":
            link = 1
        if not border or tag in VOID:
            continue
        link = 0
        for i in range(len(stack) - 1, -1, -1):  # elements that this one ends
            open_tag = stack[i].tag
            if tag in ENDS and ENDS.get(open_tag) == ENDS[tag] or open_tag == "p" and tag in HOLDERS:
                close(i)
                break
            if open_tag in ("ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body", "td", "th", "blockquote"):
                break
        found = " ".join(g for m in _ATTR.finditer(attributes) for g in m.groups() if g) if attributes else ""
        found = found.lower()
        stack.append(_Open(tag, frozenset(_WORDS.findall(found)), not ASIDE_WORDS.isdisjoint(found.split())))
        if tag in CONTENT:
            firsts.setdefault(tag, tuple(stack))
    flush()
    around = _wrappers(out, paths, firsts)
    for b, path in zip(out, paths):
        b.words = frozenset().union(*(o.words - ASIDE_WORDS if o.tag in ("html", "body") or id(o) in around else o.words for o in path))
    return out


def _wrappers(found: list[Block], paths: list[tuple[_Open, ...]], firsts: dict[str, tuple[_Open, ...]]) -> set[int]:
    """Identities of the elements round the page's content, whose words say nothing of their blocks.

    The first ``main`` and what encloses it, and the first ``article`` and what encloses it as far as they hold over half
    of the text in such elements (a list of related articles or of comments does not).  Where there is an article, also
    what lies inside it, else any element (inside ``main``, where there is one), if it holds over half of that text and
    longer names alone bring its aside words (``with-sidebar``, ``widget-body``).  Those of comments stay: there may be
    more of them than of the article.
    """
    named = any(CONTENT & set(b.tags) for b in found)
    sizes: dict[int, int] = {}
    total = 0
    article = firsts.get("article", ())
    for b, path in zip(found, paths):
        if not named or CONTENT & set(b.tags):
            total += len(b.text)
            for o in path:
                sizes[id(o)] = sizes.get(id(o), 0) + len(b.text)
    around = {id(o) for o in firsts.get("main", ())} | {id(o) for o in article if 2 * sizes.get(id(o), 0) > total}
    of_article = bool(article) and id(article[-1]) in around
    whole_text = sizes[id(article[-1])] if of_article else total
    for path in paths:
        within = not of_article
        for o in path:
            if within and not o.called and o.words.isdisjoint(COMMENT_WORDS) and 2 * sizes.get(id(o), 0) > whole_text:
                around.add(id(o))
            within = within or o is article[-1]
    return around


def _behind(page: str, tag: str, at: int) -> int:
    """Where the unseen element that opened before ``at`` ends; nested ones of its name are counted."""
    if tag in _RAW_END:
        end = _RAW_END[tag].search(page, at)
        return len(page) if not end else (page.find(">", end.end()) + 1 or len(page))
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])|<(?:/head|body)(?=[\s/>])" if tag == "head" else rf"<(/?){tag}(?=[\s/>])", re.I).finditer(page, at):
        if m[1] is None:
            return m.start()
        depth += -1 if m[1] else 1
        if not depth:
            return page.find(">", m.end()) + 1 or len(page)
    return len(page) if tag != "head" else at


def describe(found: list[Block], hide: bool = False) -> list[list[str]]:
    """Feature names of every block; ``hide`` leaves out what names the parts."""
    named = CONTENT | ASIDE
    out = []
    for i, b in enumerate(found):
        n, words = len(b.text), b.text.count(" ") + 1
        tags = [t for t in dict.fromkeys(b.tags) if not (hide and t in named)]
        f = ["bias", *(f"t:{t}" for t in tags if t not in ("html", "body")), f"b:{tags[-1] if tags else ''}"]
        f += [f"c:{w}" for w in sorted(b.words) if not (hide and w in ASIDE_WORDS)]
        f += [f"len:{min(4, (n // 20).bit_length())}", f"link:{min(3, 4 * b.linked // max(n, 1))}", f"at:{4 * i // len(found)}"]
        if b.text[-1] in ".!?":
            f.append("full")
        if words < 4:
            f.append("few")
        if _RIGHTS.search(b.text):
            f.append("copyright")
        if i and found[i - 1].tags == b.tags:
            f.append("as-before")
        out.append(f)
    return out


def taught(found: list[Block]) -> list[int] | None:
    """Labels of a page that names its parts, else None."""
    if not any(CONTENT & set(b.tags) for b in found):
        return None
    return [int(bool(CONTENT & set(b.tags)) and not ASIDE & set(b.tags) and not ASIDE_WORDS & b.words) for b in found]


class Chain:
    """Two labels; a block's score for label 1 is the sum of its weights, ``stay`` the gain of no change."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = dict(EXPECT) if weights is None else weights

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        w = self.weights
        return np.array([sum(w.get(f, 0.0) for f in fs) for fs in features])

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not features:
            return []
        stay, back, best = self.weights.get("stay", 0.0), [], (0.0, 0.0)
        for e in self.emissions(features).tolist():
            to0 = (best[0] + stay, 0) if best[0] + stay >= best[1] else (best[1], 1)
            to1 = (best[1] + stay, 1) if best[1] + stay >= best[0] else (best[0], 0)
            back.append((to0[1], to1[1]))
            best = (to0[0], to1[0] + e)
        label = int(best[1] > best[0])
        out = [label]
        for b in reversed(back[1:]):
            label = b[label]
            out.append(label)
        return out[::-1]

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, float]:
        """P(label 1) of each block, and the expected number of unchanged neighbours."""
        stay, n = self.weights.get("stay", 0.0), len(e)
        move = np.array([[stay, 0.0], [0.0, stay]])
        emit = np.stack([np.zeros(n), e], 1)
        fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = emit[0]
        for i in range(1, n):
            fore[i] = np.logaddexp.reduce(fore[i - 1][:, None] + move, axis=0) + emit[i]
        for i in range(n - 2, -1, -1):
            aft[i] = np.logaddexp.reduce(move + (emit[i + 1] + aft[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(fore[-1])
        both = fore[:-1, :, None] + move[None] + (emit + aft)[1:, None, :] - total
        return np.exp(fore[:, 1] + aft[:, 1] - total), float(np.exp(both[:, 0, 0]).sum() + np.exp(both[:, 1, 1]).sum())


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS) -> dict[str, float]:
    """Maximum a posteriori weights by adaptive gradient steps, a page at a time."""
    chain, squares = Chain(), {}
    for _ in range(epochs):
        for features, labels in pages:
            p, stays = chain.marginals(chain.emissions(features))
            gradient: dict[str, float] = {"stay": sum(a == b for a, b in zip(labels, labels[1:])) - stays}
            for fs, error in zip(features, np.array(labels) - p):
                for f in fs:
                    gradient[f] = gradient.get(f, 0.0) + float(error)
            for f, g in gradient.items():
                g -= RIDGE * (chain.weights.get(f, 0.0) - EXPECT.get(f, 0.0))
                squares[f] = squares.get(f, 1e-6) + g * g
                chain.weights[f] = chain.weights.get(f, 0.0) + RATE * g / squares[f] ** 0.5
    return chain.weights


def fit(pages: DataFrame, most: int = MOST) -> dict[str, float]:
    place = F.xxhash64("page_id")
    able = pages.filter(F.col("page_id").isNotNull() & F.col("html").rlike("(?i)<(article|main)")).select("page_id", F.xxhash64("html").alias("key"), "html")

    def teaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.select(["page_id", "key"]).filter(pa.array([taught(blocks(page)) is not None for page in b.column(2).to_pylist()], pa.bool_()))

    kind = pages.schema["page_id"].dataType.simpleString()
    ids = able.mapInArrow(teaching, f"page_id {kind}, key long").groupBy("page_id").agg(F.min("key").alias("key")).orderBy(place, "page_id").limit(most)
    # at most ``most`` ids; a repeated id gives one page
    rows = able.join(F.broadcast(ids), ["page_id", "key"]).groupBy("page_id").agg(F.min("html").alias("html"))
    rows = rows.repartition(1).sortWithinPartitions(place, "page_id").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = []
        for b in small(batches):
            for page in b.column(0).to_pylist():
                found = blocks(page or "")
                labels = taught(found)
                if labels is not None:
                    learned += [(describe(found, hide), labels) for hide in (False, True)]
        weights = train(learned)
        yield pa.RecordBatch.from_arrays([pa.array(weights.keys(), pa.string()), pa.array(weights.values(), pa.float64())], ["feature", "weight"])

    return {r.feature: r.weight for r in rows.mapInArrow(run, "feature string, weight double").collect()} or dict(EXPECT)


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, chain.decode(describe(found))) if keep)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``."""
    rows = pages.select("page_id", "url", whole(F.col("html")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(weights)
        for b in small(batches):
            texts = [main_text(page, chain) for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
