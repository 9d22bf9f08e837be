"""HTML extraction: a maximum-scoring subsequence over words and tags.

The page becomes one sequence of tokens in page order.  A word scores by how likely
words like it are main text, a tag by how often it stands outside of main text, so
words of text score positive and tags negative.  The weights come from labelled
pages: two logistic regressions and a count of tags (:class:`Weights`).

1. *Scores.*  A word's score is ``2 p - 1`` of the mean log-odds of two regressions: one
   over what stands near it (the block it is in, its length, whether it is a sentence, how
   much of it are links), one over its place alone (the elements around it with their names,
   and their shape: rows of like elements as replies and teasers are, small divisions between
   paragraphs).  Neither sees ``article``, ``main`` or divisions around a word.
2. *Tags.*  A tag costs by how often elements of it that hold main text begin or end outside of
   it; ``article``, ``main`` and others that always do can't be crossed.  A division that holds
   most of the page's likely text costs ``EDGE`` words to enter or leave.
3. *Region.*  One linear scan finds the contiguous region with the highest sum
   (:func:`best_region`); where it begins and ends, the main text does.  A page of a few words
   without a positive region is scanned once more with the log-odds of the words' places.
4. *Holes.*  Texts in the region whose place has log-odds below ``CUT`` (menus, adverts, notices,
   replies) are left out.  An element with nothing but such texts costs the region that goes
   across it ``HOLE`` words at most, so what follows an advert isn't lost.

Names of classes count as learned: the whole name, its last part and, less telling, its
first; those of the elements around a block count against it only, its own also for it.

Labelled pages are those of :mod:`.html_pages` and, with :func:`fit`, a bounded sample
of the table itself: ``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` characters with
exactly one ``article`` element, labelled by that structure.

Scripts, styles and other elements without text of their own are skipped whole;
comments and declarations are no tokens.  Character references are decoded,
white space inside a block becomes one space, blocks are joined by two line
feeds.  A line break element is white space.

Defined results: a null or empty page, or one without a positive region, has the
empty text; unclosed elements end with the page, unclosed tags and comments
swallow the rest of it, as browsers do; pages of any length and any nesting are read
whole in time linear in their length; repeated rows get equal results; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .html_pages import PAGES, mark, page_text

#: Elements whose content is no page text.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title head button datalist map applet noembed noframes xmp".split())
#: Of those, elements whose content holds no tags.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end when one of these begins.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
SCOPE = frozenset("ul ol dl table article section div main aside nav footer header form body blockquote".split())
#: Inline elements that are only kept on the stack if they say something about their place.
PLACES = frozenset("a label".split())
#: Elements around a word that no regression sees.
NEUTRAL = frozenset("html body div section main article span center".split())
#: From how many on like elements are a row, whatever they hold (two are, if they hold less than half of the page); divisions that are a box among paragraphs while they have fewer words.
IN_A_ROW, BOXES, BOX_WORDS = 3, frozenset("div section aside".split()), 60

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>?", re.S
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLASS = re.compile(r"(?<![\w-])class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: End tags of elements without tags inside; start and end tags of the other skipped ones.
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_NESTED = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>?", re.I) for t in SKIPPED - RAW}

#: Cost of a tag that stands outside of main text e times as often as inside, of any tag, and of one that
#: the labelled pages have never inside, but at least so often outside: no region goes beyond it.
TAG_SCALE, TAG_LEAST, TAG_NEVER, TAG_SEEN = 3.0, 0.02, 10_000.0, 4
#: Log-odds of a place below which its text is cut.
CUT = -0.7
#: What a hole, an element all of whose texts are cut, costs the region that goes across it at most.
HOLE = 0.5
#: What it costs to enter or leave a division that holds most of the page's likely text.
EDGE, DIVISIONS = 30.0, frozenset("div section td table center blockquote".split())
#: A short text straight in a division, where most text stands in paragraphs, is odd.
ODD_WORDS, ODD_BLOCKS = 40, frozenset("div td section center".split())
#: Bound of the table's labelled sample, and what it weighs beside the other labelled pages.
SAMPLE_PAGES, SAMPLE_CHARS, SAMPLE_SHARE = 64, 100_000, 0.5
PENALTY = 3e-4

_LENGTHS = (2, 5, 10, 20, 40)
_ENDS = tuple(".!?:;…。！？\"”»)")


def attribute_features(attrs: str) -> list[str]:
    """Features of an element's names, role and visibility."""
    out = []
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for name in value.split():
                parts = [x.lower() for x in _NAME.findall(name)]
                if parts:
                    out.append(f"h:{parts[-1]}")
                if len(parts) > 1:
                    out += [f"f:{parts[0]}", f"n:{'-'.join(parts)}"]
        elif key == "role":
            out.append(f"r:{value.strip().lower()}")
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("x:hidden")
        elif key == "hidden" or value.lower() == "true":
            out.append("x:hidden")
    return out


@dataclass(frozen=True)
class Weights:
    """Log-odds of a word's features, near it and of its place alone, and costs of tags."""

    near: dict[str, float] = field(default_factory=dict)
    place: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region [first, last) with the highest positive sum, (0, 0) if there is none; one scan."""
    best = total = 0.0
    start = first = last = 0
    for i, score in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


class Page:
    """The tokens of a page.

    ``texts`` holds (text, words, features around it, (own block's tag, its names), in a
    link, block, element); ``tokens`` the texts' numbers and, between them, the tags as
    (tag, element), the element being -1 where it isn't kept."""

    def __init__(self, page: str, known):
        self.texts: list[tuple] = []
        self.tokens: list = []
        self.parent, self.name, self.kind = [0], [""], [""]
        self._read(page, known)
        self.shape = self._shape()

    def _shape(self) -> list[tuple[str, ...]]:
        """What an element's surroundings say of it, names apart: it or one around it is one of a
        row of like elements (replies, teasers), or a small division between paragraphs (a box)."""
        size = len(self.name)
        words, paragraphs, before = [0] * size, [0] * size, [0] * size
        for _, n, _, _, _, _, node in self.texts:
            words[node] += n
        for i in range(size - 1, 0, -1):  # elements are numbered in page order, so inner ones come first here
            words[self.parent[i]] += words[i]
        for i in range(1, size):
            before[i] = paragraphs[self.parent[i]]
            if self.name[i] == "p":
                paragraphs[self.parent[i]] += words[i]
        alike, of_row = Counter(), Counter()
        for i in range(1, size):
            if self.kind[i] and words[i]:
                alike[self.parent[i], self.kind[i]] += 1
                of_row[self.parent[i], self.kind[i]] += words[i]
        rows = {k for k, n in alike.items() if n >= IN_A_ROW or n == 2 and 2 * of_row[k] < words[0]}
        out: list[tuple[str, ...]] = [()]
        for i in range(1, size):
            found = out[self.parent[i]]
            if words[i] and (self.parent[i], self.kind[i]) in rows and "s:row" not in found:
                found = (*found, "s:row")
            if self.name[i] in BOXES and "s:box" not in found and 0 < words[i] < BOX_WORDS and before[i] > 0 and paragraphs[self.parent[i]] - before[i] > 0 and paragraphs[self.parent[i]] >= 2 * words[i] + BOX_WORDS:
                found = (*found, "s:box")
            out.append(found)
        return out

    def _read(self, page: str, known) -> None:
        texts, tokens = self.texts, self.tokens
        # open elements: tag, features around, own block, in a link, element, open inline elements of this scope
        stack: list[tuple] = [("", frozenset(), ("body", ()), False, 0)]
        inline: list[Counter] = [Counter()]  # open elements other than SCOPE ones, by scope
        scopes: Counter = Counter()
        block = 0
        at, size = 0, len(page)
        search = _TOKEN.search

        def drop(upto: int) -> None:
            # from the top, so that a scope's counter goes before its outer one is used
            while len(stack) > upto:
                tag = stack.pop()[0]
                if tag in SCOPE:
                    scopes[tag] -= 1
                    inline.pop()
                else:
                    inline[-1][tag] -= 1

        def last_of(tags) -> int:
            i = len(stack) - 1
            while stack[i][0] not in tags:
                i -= 1
            return i

        while at < size:
            m = search(page, at)
            begin = m.start() if m else size
            if begin > at:
                raw = page[at:begin]
                text = html.unescape(raw) if "&" in raw else raw
                _, seen, own, link, node = stack[-1]
                tokens.append(len(texts))
                texts.append((text, len(text.split()), seen, own, link, block, node))
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in SKIPPED:
                    continue
                node = -1
                if scopes[tag] if tag in SCOPE else inline[-1][tag]:
                    i = last_of((tag,))
                    node = stack[i][4]
                    drop(i)
                tokens.append(("/" + tag, node))
            elif tag in SKIPPED:
                if not m[3].endswith("/"):
                    at = skip(page, tag, at)
                continue
            elif tag == "br":
                tokens.append(len(texts))
                texts.append((" ", 0, *stack[-1][1:4], block, stack[-1][4]))
                continue
            elif tag not in VOID:
                if tag in ENDS or tag in BLOCKS:  # ends an open paragraph, with what is open inside; items end items
                    ends = [t for t in (*ENDS.get(tag, ()), "p") if inline[-1][t]]
                    if ends:
                        drop(min(last_of((t,)) for t in ends) if len(ends) > 1 else last_of(ends))
                if tag in BLOCKS or tag in PLACES or m[3]:
                    _, seen, own, link, _ = stack[-1]
                    new, names = known(tag, m[3], seen)
                    if not new <= seen:
                        seen = seen | new
                    self.parent.append(stack[-1][4])
                    self.name.append(tag)
                    named = _CLASS.search(m[3]) if m[3] else None
                    self.kind.append(f"{tag} {_DIGITS.sub('', named[1] or named[2] or named[3] or '')}" if named else "")
                    stack.append((tag, seen, (tag, names) if tag in BLOCKS else own, link or tag == "a", len(self.name) - 1))
                    if tag in SCOPE:
                        scopes[tag] += 1
                        inline.append(Counter())
                    else:
                        inline[-1][tag] += 1
                    tokens.append((tag, len(self.name) - 1))
                else:
                    tokens.append((tag, -1))
            else:
                tokens.append((tag, -1))
            if tag in BLOCKS:
                block += 1

    def near(self) -> list[tuple[str, ...]]:
        """Features of each text's block: shape of what is around, length, sentence end, links, oddness."""
        words, links, last = Counter(), Counter(), {}
        kinds: Counter = Counter()
        for text, n, _, own, link, block, _ in self.texts:
            if n:
                words[block] += n
                kinds[own[0]] += n
                last[block] = text
                if link:
                    links[block] += n
        mostly_p = 2 * kinds["p"] > sum(kinds.values())
        made: dict[tuple, tuple[str, ...]] = {}
        out = []
        for _, n, _, own, _, block, node in self.texts:
            if not n:
                out.append(())
                continue
            key = (block, own, self.shape[node])
            if key not in made:
                w = words[block]
                f = [f"b:{own[0]}", *own[1], *self.shape[node], f"l:{sum(w > x for x in _LENGTHS)}"]
                if last[block].rstrip().endswith(_ENDS):
                    f.append("e:1")
                if 2 * links[block] > w:
                    f.append("k:1")
                if mostly_p and own[0] in ODD_BLOCKS and w < ODD_WORDS:
                    f.append(f"odd:{own[0]}")
                made[key] = tuple(f)
            out.append(made[key])
        return out


#: Features of :meth:`Page.near` that tell a place.
PLACE_KINDS = ("b:", "o:", "odd:", "s:")


def skip(page: str, tag: str, at: int) -> int:
    """Behind the end tag of an element that is skipped, or the end of the page."""
    if tag in RAW:
        m = _END[tag].search(page, at)
        return m.end() if m else len(page)
    depth = 1
    for m in _NESTED[tag].finditer(page, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return at if tag in ("head", "button", "map", "object") else len(page)


def around(tag: str, attrs: str, seen: frozenset) -> tuple[frozenset, tuple[str, ...]]:
    """Features that an element gives to the words in it, and those of its names to its own."""
    out = attribute_features(attrs) if attrs else []
    names = tuple(dict.fromkeys(f"o:{f[2:]}" for f in out if f.startswith("h:")))
    if tag == "a":
        out.append("t:a-in-p" if "t:p" in seen else "t:a")
    elif tag not in NEUTRAL:
        out.append(f"t:{tag}")
    return frozenset(out), names


def labelled_rows(page: str) -> tuple[Counter, Counter]:
    """Words by (features near, features of the place, label), and tags by (tag, label), of a page
    whose main text stands between ``[[`` and ``]]``; the label None is that of tags of elements
    that hold no main text."""
    read = Page(page, around)
    near = read.near()
    rows: Counter = Counter()
    tags: Counter = Counter()
    label, at = 0, []
    good = [False] * len(read.name)
    for token in read.tokens:
        if isinstance(token, tuple):
            at.append((token, label))
            continue
        text, _, seen, own, *_ = read.texts[token]
        for piece in re.split(r"(\[\[|\]\])", text):
            if piece in ("[[", "]]"):
                label = int(piece == "[[")
            elif n := len(piece.split()):
                good[read.texts[token][6]] |= label == 1
                place = {f for f in near[token] if f.startswith(PLACE_KINDS)}
                rows[frozenset(seen | {*near[token]}), frozenset(seen | place), label] += n
    for i in range(len(good) - 1, 0, -1):
        good[read.parent[i]] |= good[i]
    for (tag, node), label in at:
        tags[tag, label if node < 0 or good[node] else None] += 1
    return rows, tags


#: Features that may only count against a word: the names of elements around it.
AGAINST = ("n:", "h:", "f:")


def regress(rows: list[tuple[frozenset, int, float]]) -> dict[str, float]:
    """Weights of a logistic regression of the label on the features; names around that would count
    for a word are left out and the rest is fitted again."""
    names = {f for fs, _, _ in rows for f in fs}
    while True:
        found = newton(rows, sorted(names))
        over = {f for f, v in found.items() if v > 0 and f.startswith(AGAINST)}
        if not over:
            return {f: v for f, v in found.items() if abs(v) > 1e-3 or not f}
        names -= over


def newton(rows: list[tuple[frozenset, int, float]], names: list[str]) -> dict[str, float]:
    number = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for i, (fs, _, _) in enumerate(rows):
        x[i, [number[f] for f in fs if f in number]] = 1
    x[:, -1] = 1
    y = np.array([label for _, label, _ in rows], dtype=float)
    weight = np.array([n for _, _, n in rows])
    weight = weight / weight.sum()
    w = np.zeros(len(names) + 1)
    penalty = np.full(len(w), PENALTY)
    penalty[-1] = PENALTY / 100
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return {"": float(w[-1]), **{f: float(v) for f, v in zip(names, w, strict=False)}}


def train(sample: tuple[str, ...] = ()) -> Weights:
    """Weights from the labelled pages and a sample of further ones."""
    near: Counter = Counter()
    place: Counter = Counter()
    tags: Counter = Counter()
    parts = [[labelled_rows(page_text(p)) for p in PAGES], [labelled_rows(p) for p in sample]]
    size = [sum(n**0.5 for rows, _ in part for n in rows.values()) for part in parts]
    for part, total, share in zip(parts, size, (1.0, SAMPLE_SHARE), strict=True):
        each = share * size[0] / total if total else 0.0
        for rows, found in part:
            for (a, b, label), n in rows.items():
                near[a, label] += each * n**0.5
                place[b, label] += each * n**0.5
            for key, n in found.items():
                tags[key] += each * n
    costs = {}
    for t in {t for t, _ in tags}:
        outside, inside = tags[t, 0], tags[t, 1]
        if not outside and not inside:  # only of elements without main text
            outside = tags[t, None]
        never = not inside and outside >= TAG_SEEN
        costs[t] = TAG_NEVER if never else TAG_LEAST + TAG_SCALE * max(0.0, float(np.log((outside + 0.5) / (inside + 0.5))))
    models = [regress([(fs, label, n) for (fs, label), n in sorted(rows.items(), key=lambda r: (sorted(r[0][0]), r[0][1]))]) for rows in (near, place)]
    return Weights(*models, costs)


@functools.cache
def plain_weights() -> Weights:
    return train()


class Extractor:
    def __init__(self, weights: Weights | None = None):
        self.weights = weights or plain_weights()
        self.known = set(self.weights.near) | set(self.weights.place)
        self.by_attrs: dict[tuple[str, str, bool], tuple] = {}
        self.sums: dict[frozenset, tuple[float, float]] = {}

    def around(self, tag: str, attrs: str, seen: frozenset) -> tuple[frozenset, tuple[str, ...]]:
        key = (tag, attrs, tag == "a" and "t:p" in seen)
        found = self.by_attrs.get(key)
        if found is None:
            new, names = around(tag, attrs, seen)
            found = frozenset(f for f in new if f in self.known), tuple(f for f in names if f in self.known)
            if len(self.by_attrs) < 50_000 and len(attrs) < 200:
                self.by_attrs[key] = found
        return found

    def judged(self, read: Page) -> tuple[list[float], list[float]]:
        """Scores of the tokens, and log-odds of the texts' places."""
        near, place, tags = self.weights.near, self.weights.place, self.weights.tags
        sums = self.sums
        score_of, place_of = [], []
        made: dict[tuple, tuple[float, float]] = {}
        for (_, n, seen, *_), extra in zip(read.texts, read.near(), strict=True):
            if not n:
                score_of.append(0.0)
                place_of.append(0.0)
                continue
            found = made.get((seen, extra))
            if found is None:
                if seen not in sums:
                    if len(sums) > 50_000:
                        sums.clear()
                    sums[seen] = sum(near.get(f, 0.0) for f in seen) + near[""], sum(place.get(f, 0.0) for f in seen) + place[""]
                a, b = sums[seen]
                a += sum(near.get(f, 0.0) for f in extra)
                b += sum(place.get(f, 0.0) for f in extra if f.startswith(PLACE_KINDS))
                found = made[seen, extra] = (2 / (1 + np.exp(-(a + b) / 2)) - 1, b)
            score_of.append(n * float(found[0]))
            place_of.append(float(found[1]))
        holes, edges = self.holes(read, place_of)
        out = []
        for t in read.tokens:
            if isinstance(t, tuple):
                out.append(-TAG_LEAST if t[1] > 0 and holes[t[1]] else -EDGE if t[1] in edges else -tags.get(t[0], TAG_LEAST))
            elif place_of[t] < CUT and (n := holes[read.texts[t][6]]):
                out.append(-read.texts[t][1] * min(1.0, HOLE / n))
            else:
                out.append(score_of[t])
        return out, place_of

    @staticmethod
    def holes(read: Page, place: list[float]) -> tuple[list[int], set[int]]:
        """Of elements all of whose texts are cut, the words of the outermost such element (at least 1), 0 of
        others; and the divisions that hold more than half of the words that aren't cut."""
        size = len(read.name)
        words, good = [0] * size, [0] * size
        for (_, n, *_, node), p in zip(read.texts, place, strict=True):
            words[node] += n
            if p >= CUT:
                good[node] += n
        for i in range(size - 1, 0, -1):
            words[read.parent[i]] += words[i]
            good[read.parent[i]] += good[i]
        out, edges = [0] * size, set()
        for i in range(1, size):
            if not good[i]:
                out[i] = out[read.parent[i]] or max(1, words[i])
            elif 2 * good[i] > good[0] and read.name[i] in DIVISIONS:
                edges.add(i)
        return out, edges

    def chosen(self, read: Page) -> list[int]:
        """Numbers of the texts that are the main text: those of the best region but for what is cut."""
        scores, place = self.judged(read)
        first, last = best_region(scores)
        if not last:  # nothing but a few words: their places alone decide
            tags = self.weights.tags
            first, last = best_region([-tags.get(t[0], TAG_LEAST) / TAG_SCALE if isinstance(t, tuple) else read.texts[t][1] * place[t] for t in read.tokens])
        return [t for t in read.tokens[first:last] if not isinstance(t, tuple) and place[t] >= CUT]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        read = Page(page, self.around)
        blocks: list[str] = []
        parts: list[str] = []
        at = None
        for t in self.chosen(read):
            text, block = read.texts[t][0], read.texts[t][5]
            if block != at:
                if done := " ".join("".join(parts).split()):
                    blocks.append(done)
                parts, at = [], block
            parts.append(text)
        if done := " ".join("".join(parts).split()):
            blocks.append(done)
        return "\n\n".join(blocks)


def fit(pages: DataFrame, *, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> Weights:
    """Weights from the labelled pages and a bounded sample of the table, labelled by its ``article`` elements."""
    fits = pages.where(F.char_length(html_col) <= sample_chars).where(F.lower(html_col).contains("<article"))
    # equal pages once, in the order of their hashes
    few = fits.select(F.col(html_col).alias("html")).groupBy(F.md5("html").alias("m")).agg(F.min("html").alias("html")).orderBy("m").limit(sample_pages).collect()
    return train(tuple(x for x in (mark(r["html"]) for r in few) if x))


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """page_id, url, main text and its code points, in one pass."""
    weights = weights or plain_weights()

    def make():
        extractor = Extractor(weights)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extractor.text(h) for h in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

        return fn

    return map_batches(pages.select(id_col, url_col, html_col), make, SCHEMA)
