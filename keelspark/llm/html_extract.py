"""Main text of web pages by wrapper induction.

Pages of a host with the same layout (the elements below their first fork) share a wrapper.  A bounded number of them (SAMPLES, chosen by hashes,
pages with the same longest block as one) is parsed and aligned pairwise by simple tree matching.  A block whose aligned partners have the same
text in CONSTANT of the other pages is template; the others, and nodes with no partner, are slots.  The container that holds the slots' text, found
from the root downwards, is the content region.  A page is then read by its wrapper: the region's blocks in page order without the template's.

What HTML itself calls no article (menu, header, footer, sidebar, form, script and style elements, and such roles) is never read.  Class names that
say advert, notice, comment and so on are a further hint inside the region, never against the region the wrapper found.  A page without a wrapper (the
only one of its layout), or whose tree lacks the region, is read by the region found in it alone; fewer than three different pages induce a region but
no template, because two equal texts may as well be one article copied.

Sampling is an aggregate with one row per host, layout and seed, combined before the shuffle, so a host with a third of all pages is no hot
group.  Pages over SAMPLE_BYTES are sampled only where a layout has too few smaller ones.  Wrappers are a path and some hashes; they are broadcast
while their counted size is below BROADCAST_BYTES, else joined by host and salt.

Defined results: null or empty html has an empty text; a null url is a host of its own; broken markup is read as browsers do (open
paragraphs end at the next block, stray end tags are ignored, a lone `<` is text); repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
import sys
from bisect import bisect_left
from collections import Counter
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLES, SAMPLE_BYTES, BROADCAST_BYTES = 6, 65_536, 8 << 20
#: share of the other sampled pages that must repeat a block's text for it to be template
CONSTANT = 0.8
SALTS = 16

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_BLOCK_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption tr ul ol dl table tbody thead".split())
#: elements whose open paragraph ends at them
_ENDS_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
#: an element of the key ends an open one of the value
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
_DROP = frozenset("script style nav header footer aside form noscript template iframe object embed svg canvas button select textarea input menu dialog head title link meta audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_HINTS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion sidebar comment comments disqus notice notices cookie cookies consent banner share sharing social related newsletter subscribe breadcrumb breadcrumbs menu nav navbar navigation footer header popup modal widget login signup toolbar pagination".split()
)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    """drop: not article by its tag or role; hint: not article by its names; sign: tag and names, numbers left out unless siblings differ in them."""

    __slots__ = ("tag", "kids", "drop", "hint", "sign", "raw", "held")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.held = tag, [], None
        self.drop, self.hint, self.sign = tag in _DROP, False, tag
        self.raw = tag
        if attrs:
            for m in _ATTR.finditer(attrs):
                value = (m[2] or m[3] or m[4] or "").lower()
                kind = m[1].lower()
                if kind == "role":
                    self.drop |= value in _ROLES
                else:
                    self.hint |= not _HINTS.isdisjoint(re.split(r"[^a-z]+", value)) and tag not in ("html", "body")
                    name = ("." if kind == "class" else "#") + (value.split()[0].replace("/", "") if value.split() else "")
                    self.raw += name
                    self.sign += re.sub(r"\d+", "0", name)


def parse(source: str) -> Node:
    root = Node("")
    stack = [root]
    at, end = 0, len(source)
    find = _TOKEN.search
    while at < end:
        m = find(source, at)
        if m is None:
            if at < end:
                stack[-1].kids.append(entities.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    # a misnested inline element ends alone, the blocks opened inside it stay open
                    if tag in _INLINE and any(n.tag not in _INLINE for n in stack[i + 1 :]):
                        del stack[i]
                    else:
                        del stack[i:]
                    break
            continue
        if tag in _ENDS_P:
            _close(stack, {"p"}, {"article", "section", "div", "td", "th", "li", "body", "blockquote", "button"})
        if tag in _ENDS:
            _close(stack, _ENDS[tag], _LISTS[tag])
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            if tag in ("textarea", "title"):
                node.kids.append(entities.unescape(source[at : stop.start() if stop else end]))
            at = stop.end() if stop else end
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], these: set[str], within: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in these:
            del stack[i:]
            if "p" in these:
                return
            return _close(stack, these, within)
        if stack[i].tag in within:
            return


def elements(node: Node) -> list[Node]:
    """The block elements directly below node, those inside its inline elements too."""
    if node.held is None:
        out, todo = [], list(reversed(node.kids))
        while todo:
            k = todo.pop()
            if not isinstance(k, str) and not k.drop:
                if k.tag in _INLINE:
                    todo += reversed(k.kids)
                else:
                    out.append(k)
        kinds: dict[str, set[str]] = {}
        for k in out:
            kinds.setdefault(k.sign, set()).add(k.raw)
        for k in out:
            if len(kinds.get(k.sign, ())) > 1:
                k.sign = k.raw
        node.held = out
    return node.held


def read(node: Node, path: str = "", hints: bool = True) -> list[tuple[str, Node, str]]:
    """The text blocks below node in page order, white space folded: (path of the element that owns it, that element, text).  Elements that are no
    article are left out; hints: those hinted at too."""
    out, run = [], []

    def flush(path: str, owner: Node) -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append((path, owner, text))

    # depth-first with an explicit stack: markup may nest deeper than Python's own
    elements(node)
    todo: list = [(k, path, node) for k in reversed(node.kids)]
    while todo:
        k, path, owner = todo.pop()
        if k is None:
            flush(path, owner)
        elif isinstance(k, str):
            run.append(k)
        elif k.drop or hints and k.hint:
            if k.tag not in _INLINE:
                flush(path, owner)
        elif k.tag == "br":
            run.append(" ")
        elif k.tag in _INLINE:
            todo += [(x, path, owner) for x in reversed(k.kids)]
        else:
            flush(path, owner)
            elements(k)
            inner = f"{path}/{k.sign}"
            todo.append((None, inner, k))
            todo += [(x, inner, k) for x in reversed(k.kids)]
    flush(path, node)
    return out


def owned(root: Node) -> dict[int, list[str]]:
    """The texts each element owns, by the element's id."""
    out: dict[int, list[str]] = {}
    for _, owner, text in read(root, hints=False):
        out.setdefault(id(owner), []).append(text)
    return out


#: the score of one matched pair of elements, in units of one equal text
_PAIR = 1 << 32


def align(a: Node, b: Node, texts: tuple[dict, dict] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the largest order-keeping match of two trees, and its pairs.  Equal texts (texts: as owned() tells them) count a
    little more, so that of equally large matches the one with most equal texts is taken.  Exact for trees of any size."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    shapes, numbers = Shapes(), {}
    sides = texts or (owned(a), owned(b))
    told = [{(n.sign, tuple(own[id(n)])) for n in _nodes(root) if id(n) in own} for root, own in zip((a, b), sides)]
    known = {t: i for i, t in enumerate(told[0] & told[1])}
    for root, own in zip((a, b), sides):
        for n in reversed(_nodes(root)):
            numbers[id(n)] = shapes.number(n.sign, known.get((n.sign, tuple(own.get(id(n), ())))), tuple(numbers[id(k)] for k in elements(n)))
    score = shapes.score(numbers[id(a)], numbers[id(b)])
    pairs, todo = [], [(a, b)] if score else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        left, right = elements(x), elements(y)
        inner = shapes.match([numbers[id(k)] for k in left], [numbers[id(k)] for k in right])[1]
        todo += [(left[i], right[j]) for i, j in reversed(inner)]
    return score // _PAIR, pairs


def _nodes(root: Node) -> list[Node]:
    """The elements of a tree, parents first."""
    out, todo = [], [root]
    while todo:
        out.append(todo.pop())
        todo += elements(out[-1])
    return out


class Shapes:
    """The best order-keeping matches of subtrees, by number: subtrees of equal signs and equal texts have one.  A text that the other tree does not
    have at such an element makes no difference to any match and is left out, so that long lists have few numbers."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.rows: list[tuple] = []
        self.whole: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}
        self.matches: dict[tuple, tuple] = {}

    def number(self, sign: str, text: int | None, kids: tuple[int, ...]) -> int:
        got = self.known.setdefault((sign, text, kids), len(self.rows))
        if got == len(self.rows):
            self.rows.append((sign, text, kids))
            # what it scores against itself, the most it can score
            self.whole.append(_PAIR + (text is not None) + sum(self.whole[k] for k in kids))
        return got

    def score(self, a: int, b: int) -> int:
        if a == b:
            return self.whole[a]
        if (a, b) not in self.scores:
            (sign, text, kids), (other, theirs, others) = self.rows[a], self.rows[b]
            self.scores[a, b] = 0 if sign != other else _PAIR + (text is not None and text == theirs) + (self.match(kids, others)[0] if kids and others else 0)
        return self.scores[a, b]

    def texts(self, a: int) -> set[int]:
        out, seen, todo = set(), {a}, [a]
        while todo:
            _, text, kids = self.rows[todo.pop()]
            out.add(text)
            todo += set(kids) - seen
            seen.update(kids)
        return out - {None}

    def bare(self, a: int, keep: frozenset[int], memo: dict[int, int]) -> int:
        """The subtree without the texts that are not in keep."""
        if a not in memo:
            sign, text, kids = self.rows[a]
            memo[a] = self.number(sign, text if text in keep else None, tuple([self.bare(k, keep, memo) for k in kids]))
        return memo[a]

    def match(self, left, right) -> tuple[int, list[tuple[int, int]]]:
        """The best order-keeping match of two child lists: its score and the places of its pairs."""
        key = tuple(left), tuple(right)
        if key not in self.matches:
            left, right = key
            # equal children at both ends can always be matched with each other, for nothing scores more than a subtree against itself
            n = m = 0
            short = min(len(left), len(right))
            while n < short and left[n] == right[n]:
                n += 1
            while m < short - n and left[-1 - m] == right[-1 - m]:
                m += 1
            score, pairs = self._middle(left[n : len(left) - m], right[n : len(right) - m])
            ends = [(i, i) for i in range(n)], [(len(left) - i, len(right) - i) for i in range(m, 0, -1)]
            score += sum(self.whole[left[i]] for e in ends for i, _ in e)
            self.matches[key] = score, [*ends[0], *((n + i, n + j) for i, j in pairs), *ends[1]]
        return self.matches[key]

    def _middle(self, left: tuple[int, ...], right: tuple[int, ...], turned: bool = False) -> tuple[int, list[tuple[int, int]]]:
        """turned: left and right have changed places, for the shorter list to be the rows."""
        n, m = len(left), len(right)
        if not n or not m:
            return 0, []
        if n == 1 or m == 1:
            got = [self.score(a, b) for a in left for b in right]
            at = got.index(max(got))
            return (got[at], [(0, at) if n == 1 else (at, 0)]) if got[at] else (0, [])
        if n > m:
            score, pairs = self._middle(right, left, not turned)
            return score, [(i, j) for j, i in pairs]
        gain = self._gains(left, right)
        mine, yours = [self.whole[k] for k in left], [self.whole[k] for k in right]
        all_mine, all_yours, low, high = sum(mine), sum(yours), min(mine), min(yours)
        wide = 16
        while True:
            # a band about the diagonal; a match that leaves it skips so many children on both sides that its score has a bound
            under, over = wide + max(0, n - m), wide + max(0, m - n)
            got = _banded(n, m, under, over, gain)
            bound = max(min(all_mine - (over + 1 - m + n) * low, all_yours - (over + 1) * high), min(all_mine - (under + 1) * low, all_yours - (under + 1 - n + m) * high))
            if got[0] > bound or under >= n and over >= m:
                return got[0], _pairs(n, m, under, over, gain, got[1], turned)
            wide *= 4

    def _gains(self, left: tuple[int, ...], right: tuple[int, ...]):
        """A function from a place on the left to its scores against a run of places on the right.  Texts that few pairs of children share are looked at for
        those pairs alone: to all others they make no difference."""
        us, vs = list(dict.fromkeys(left)), list(dict.fromkeys(right))
        held = [{u: self.texts(u) for u in us}, {v: self.texts(v) for v in vs}]
        at: list[dict[int, list[int]]] = [{}, {}]
        for side, place in zip(held, at):
            for u, some in side.items():
                for t in some:
                    place.setdefault(t, []).append(u)
        times = Counter(left), Counter(right)
        both = {t: sum(times[0][u] for u in at[0][t]) * sum(times[1][v] for v in at[1][t]) for t in at[0] if t in at[1]}
        often = frozenset(t for t, n in both.items() if n > len(left) + len(right))
        special: dict[int, set[int]] = {}
        for t in both:
            if t not in often:
                for u in at[0][t]:
                    special.setdefault(u, set()).update(at[1][t])
        memo: dict[int, int] = {}
        plain = {u: self.bare(u, often, memo) for u in [*us, *vs]}
        kinds = list(dict.fromkeys(plain[v] for v in vs))
        kind = {v: i for i, v in enumerate(kinds)}
        column = np.array([kind[plain[v]] for v in right])
        places: dict[int, list[int]] = {}
        for j, v in enumerate(right):
            places.setdefault(v, []).append(j)
        table = {u: np.array([self.score(u, k) for k in kinds], dtype=np.int64) for u in {plain[u] for u in us}}

        def row(i: int, a: int, b: int) -> np.ndarray:
            out = table[plain[left[i]]][column[a:b]]
            for v in special.get(left[i], ()):
                some = places[v]
                for j in some[bisect_left(some, a) : bisect_left(some, b)]:
                    out[j - a] = self.score(left[i], v)
            return out

        return row


def _strip(i: int, m: int, under: int, over: int) -> tuple[int, int]:
    return max(1, i - under), min(m, i + over)


def _step(best: np.ndarray, i: int, m: int, under: int, over: int, gain) -> np.ndarray:
    """The next row of the table of best scores, in place; returns its part within the band."""
    a, b = _strip(i, m, under, over)
    if a <= b:
        row = np.maximum(best[a - 1 : b] + gain(i - 1, a - 1, b), best[a : b + 1])
        row[0] = max(row[0], best[a - 1])
        np.maximum.accumulate(row, out=best[a : b + 1])
    return best[a - 1 : b + 1]


def _banded(n: int, m: int, under: int, over: int, gain) -> tuple[int, list[np.ndarray]]:
    """The best score of a match within the band, and every so many rows of the table."""
    best, kept, every = np.zeros(m + 1, dtype=np.int64), [], isqrt(n) + 1
    for i in range(1, n + 1):
        if (i - 1) % every == 0:
            a, b = _strip(i, m, under, over)
            kept.append(best[a - 1 : b + 1].copy())
        _step(best, i, m, under, over, gain)
    return int(best[m]), kept


def _pairs(n: int, m: int, under: int, over: int, gain, kept: list[np.ndarray], turned: bool) -> list[tuple[int, int]]:
    """The pairs of the best match, from its end; the rows between those kept are made again."""
    out, i, j, every = [], n, m, isqrt(n) + 1
    for block in range(len(kept) - 1, -1, -1):
        first = block * every
        if not i or not j or i <= first:
            continue
        a, b = _strip(first + 1, m, under, over)
        best = np.zeros(m + 1, dtype=np.int64)
        best[a - 1 : b + 1] = kept[block]
        rows = [(a - 1, kept[block])] + [(_strip(r, m, under, over)[0] - 1, _step(best, r, m, under, over, gain).copy()) for r in range(first + 1, i + 1)]

        def at(i: int, j: int) -> int:
            start, row = rows[i - first]
            return row[j - start] if 0 <= j - start < len(row) else -1 if j else 0

        while i > first and j:
            score = at(i, j)
            if not score:
                return out[::-1]
            up, back = score == at(i - 1, j), score == at(i, j - 1)
            if up and not (turned and back):
                i -= 1
            elif back:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
    return out[::-1]


def region(root: Node, weight: dict[int, float] | None = None) -> tuple[str, ...]:
    """The path of the container that holds most of the text; weight: by id of a node, the text in its slots (all own text if None)."""
    if weight is None:
        weight = {i: float(sum(map(len, t))) for i, t in owned(root).items()}
    for hints in (True, False):
        total: dict[int, float] = {}
        order, todo = [], [root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += [k for k in elements(node) if not (hints and k.hint)]
        for node in reversed(order):
            total[id(node)] = weight.get(id(node), 0.0) + sum(total.get(id(k), 0.0) for k in elements(node))
        if total[id(root)]:
            break
    path, node = [], root
    while True:
        inner = [k for k in elements(node) if k.tag not in _BLOCK_TEXT]
        best = max(inner, key=lambda k: total.get(id(k), 0.0), default=None)
        if best is None or total.get(id(best), 0.0) <= 0.7 * total[id(node)]:
            return tuple(path)
        path.append(best.sign)
        node = best


def layout(root: Node) -> int:
    """What pages of one layout have in common: the path down to the first fork, and what stands there."""
    path, node = [], root
    while True:
        inner = [k for k in elements(node) if k.tag not in _BLOCK_TEXT]
        if len(inner) != 1:
            break
        node = inner[0]
        path.append(node.sign)
    return _mark("/".join(path), *sorted({k.sign for k in inner}))


def _mark(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def induce(pages: list[str]) -> tuple[str, list[int]]:
    """The wrapper of some pages of one layout: the path of the content region, and the marks of the template's blocks."""
    trees = list({tuple((p, t) for p, _, t in read(root, hints=False)): root for root in map(parse, dict.fromkeys(pages))}.values())
    texts = [owned(t) for t in trees]
    votes: Counter = Counter()
    template: set[int] = set()
    others = len(trees) - 1
    for i, tree in enumerate(trees):
        hits: Counter = Counter()
        for j, other in enumerate(trees):
            if i != j:
                for a, b in align(tree, other, (texts[i], texts[j]))[1]:
                    theirs = texts[j].get(id(b), ())
                    hits.update((id(a), t) for t in set(texts[i].get(id(a), ())) if t in theirs)
        slots: dict[int, float] = {}
        for path, owner, text in read(tree, hints=False):
            if others and hits[id(owner), text] >= CONSTANT * others:
                if others > 1:
                    template.add(_mark(path, text))
            else:
                slots[id(owner)] = slots.get(id(owner), 0.0) + len(text)
        votes[region(tree, slots if slots else None)] += 1 + sum(slots.values())
    return ("/".join(max(sorted(votes), key=lambda p: votes[p])), sorted(template)) if votes else ("", [])


def extract(source: str | None, wrappers: dict[int, tuple[str, list[int]]] | None) -> str:
    """The main text of a page under the wrappers of its host, by layout."""
    if not source:
        return ""
    root = parse(source)
    path, template = wrappers.get(layout(root), ("", ())) if wrappers else ("", ())
    found = _at(root, path.split("/")) if path else []
    if not found:
        path = "/".join(region(root))
        found = _at(root, path.split("/")) if path else [root]
    told = frozenset(template)
    rows = (r for node in found for r in read(node, "/" + path if path else ""))
    return "\n\n".join(text for where, _, text in rows if not told or _mark(where, text) not in told)


def _at(root: Node, path) -> list[Node]:
    level = [root]
    for sign in path:
        level = [k for node in level for k in elements(node) if k.sign == sign]
    return level if path else []


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def wrappers(pages: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """host, layout, path, template: one row per host and layout that has two different pages at least."""
    common.prepare(pages.sparkSession)
    rows = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).where("html <> ''")
    marks = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("mark", pa.int64()), ("html", pa.string())])

    def mark(batch: pa.RecordBatch) -> dict[str, list]:
        out = []
        for source in batch.column("html").to_pylist():
            root = parse(source)
            out.append((layout(root), _mark(max((t for _, _, t in read(root)), key=len, default=""))))
        return {"host": batch.column("host"), "layout": [x for x, _ in out], "mark": [x for _, x in out], "html": batch.column("html")}

    told = common.map_batches(rows, mark, "host string, layout long, mark long, html string", marks)
    key = lambda i: F.struct(F.octet_length("html") > SAMPLE_BYTES, F.xxhash64("mark", F.lit(i)), F.xxhash64("html", F.lit(i)))
    picked = told.groupBy("host", "layout").agg(*[F.min_by("html", key(i)).alias(f"h{i}") for i in range(samples)]).where("h0 <> " + f"least({', '.join(f'h{i}' for i in range(samples))}) or h0 <> " + f"greatest({', '.join(f'h{i}' for i in range(samples))})" if samples > 1 else "true")
    types = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("path", pa.string()), ("template", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        sources = zip(*(batch.column(f"h{i}").to_pylist() for i in range(samples)))
        made = [induce([s for s in some if s]) for some in sources]
        return {"host": batch.column("host"), "layout": batch.column("layout"), "path": [p for p, _ in made], "template": [t for _, t in made]}

    return common.map_batches(picked, run, "host string, layout long, path string, template array<long>", types)


_TYPES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame, samples: int = SAMPLES, most: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    made = common.staged(wrappers(pages, samples), "wrappers")
    size = made.agg(F.sum(F.octet_length("path") + 8 * F.size("template") + 64)).first()[0] or 0
    by_host = made.groupBy("host").agg(F.collect_list(F.struct("layout", "path", "template")).alias("wrappers"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    if size <= most:
        joined = rows.join(F.broadcast(by_host), "host", "left")
    else:
        salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        known: dict[str, dict] = {}
        texts = []
        for host, source, some in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("wrappers")):
            if host not in known:
                known[host] = {w["layout"]: (w["path"], w["template"]) for w in some.as_py() or ()}
            texts.append(extract(source, known[host]))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return common.map_batches(joined.select("page_id", "url", "host", "html", "wrappers"), run, "page_id long, url string, text string, n_chars long", _TYPES)
