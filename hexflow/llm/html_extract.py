"""Main text of web pages by wrappers inferred per host.

A page becomes a tree of block elements whose inline content is text.  A wrapper is a union-free
regular expression over such trees: every element holds a sequence of items, each one element,
text slot or group, perhaps optional, perhaps repeated.  Wrappers of a host's pages are aligned one
after another: equal items merge, tandem repeats fold into repeated items or groups, items that one
side lacks become optional, and text that differs becomes a slot.

The wrapper then decides what a page's article is.  Text in slots, links aside, is a wrapper item's
mass; the region is found by descending to the item that holds nearly all of it, and the headings on
the way that differ from page to page belong to it.  Blocks that say the same on most pages of the
host are template, and so is everything outside the region.  Element and class names only support
this: an ``article`` or ``main`` weighs more, names of page furniture take a block out of the region
unless the wrapper shows that it holds the article itself.

Nothing here recurses, and the tokeniser reads every character a bounded number of times, so
neither deep nor malformed pages are a danger.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from bisect import bisect_left
from collections.abc import Generator, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm.scratch import Scratch
from hexflow.llm.text import slices

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("nav aside footer form button dialog menu head fieldset noscript template svg select option object math".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold blocks; the region is one of these.
CONTAINERS = frozenset("#root html body div section article main header center table tbody thead tr td th form fieldset figure details".split())
#: Elements that the wrapper may take for the article's frame in spite of their name.
FRAMES = frozenset(("form", "fieldset"))
#: Blocks that are template where they say the same on most pages.
BLOCKS = frozenset("div section ul ol dl table header figure details center address".split())
#: Words of class, id and role values that mark page furniture, and words that say nothing beside them.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments disqus replies pagination pager widget".split()
)
PLAIN = frozenset("box boxes list bar block wrapper wrap section container content item items area site page main top bottom left right inner outer slot unit post posts article articles story stories form links link button buttons icons text body reader readers user gdpr policy the and head header row col column panel".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

_OPENS = re.compile(r"<(/?)([a-zA-Z][^\s>/]*)")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_VALUE_FOLLOWS = re.compile(r"=\s*$")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_CLASS_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s>/])", re.I) for name in RAW}
_DIGITS = re.compile(r"\d+")
#: Pairs of siblings up to which two sequences are aligned at best; beyond, each finds its next partner in order.
_ALIGN_CELLS = 250_000
_hinted: dict[str, bool] = {}


def _furniture(token: str) -> bool:
    """Whether a class or id names page furniture: one word does, and all others are plain ones."""
    found = _hinted.get(token)
    if found is None:
        words = [w.lower() for w in _CLASS_WORDS.findall(token) if len(w) > 1]
        found = any(w in FURNITURE for w in words) and all(w in FURNITURE or w in PLAIN for w in words)
        if len(_hinted) >= 100_000:
            _hinted.clear()
        _hinted[token] = found
    return found


def _marks(attrs: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if "=" in attrs else {}


def _hint(name: str, marks: dict[str, str]) -> bool:
    if name in SKIPPED or marks.get("role", "").lower() in ROLES:
        return True
    return name not in MAIN and name not in ("body", "html") and any(_furniture(t) for k in ("class", "id") for t in marks.get(k, "").split())


class Element:
    """A block element: ``kids`` are elements and (text, characters inside links); ``hint`` marks furniture by name."""

    __slots__ = ("sig", "name", "kids", "hint")

    def __init__(self, name: str, marks: dict[str, str], hint: bool):
        self.name, self.kids, self.hint = name, [], hint
        self.sig = ".".join([name, *(_DIGITS.sub("0", marks[k]) for k in ("class", "role") if marks.get(k))])


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes), ("close", name, "") and ("raw", name, content) of a page, in one pass.

    Scripts, styles, titles and the like are raw; comments and declarations give nothing.  A quote
    that is never closed quotes nothing, and behind the last ">" everything is text.
    """
    at, text_from, n = 0, 0, len(page)
    quotes = {'"': True, "'": True}  # whether one may still follow
    strict = True
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        m = _OPENS.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                if end < 0:
                    break
                end += 1
            else:
                at = lt + 1
                continue
            if lt > text_from:
                yield "text", page[text_from:lt], ""
            at = text_from = end
            continue
        start = m.end()
        end = page.find(">", start)
        if end < 0:
            break
        if strict and (page.find('"', start, end) >= 0 or page.find("'", start, end) >= 0):
            i = start
            while (q := _QUOTE_OR_END.search(page, i)) is not None and q[0] != ">":
                i = q.end()
                if quotes[q[0]] and _VALUE_FOLLOWS.search(page, max(start, q.start() - 64), q.start()):
                    close = page.find(q[0], i)
                    quotes[q[0]] = close >= 0
                    i = close + 1 if close >= 0 else i
            if q is None:
                strict = False  # only quoted ">" follow: from here on quotes count for nothing
            else:
                end = q.start()
        if lt > text_from:
            yield "text", page[text_from:lt], ""
        name = m[2].lower()
        at = text_from = end + 1
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            closing = _RAW_ENDS[name].search(page, at)
            yield "raw", name, page[at : closing.start() if closing else n]
            if closing is None:
                text_from = n
                break
            end = page.find(">", closing.end())
            at = text_from = n if end < 0 else end + 1
        else:
            yield "open", name, page[start:end]
    if text_from < n:
        yield "text", page[text_from:], ""


def parse(page: str) -> list[Element]:
    """All elements of a page, each before those inside it; the first is the root."""
    root = Element("#root", {}, False)
    order, stack, text = [root], [root], []
    open_: dict[str, int] = {}
    link, linked = False, 0

    def flush() -> None:
        nonlocal linked, link
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                stack[-1].kids.append((joined, min(linked, len(joined))))
            text.clear()
        linked, link = 0, False

    def pop_to(size: int) -> None:
        for element in stack[size:]:
            open_[element.name] -= 1
        del stack[size:]

    for kind, name, attrs in tokens(page):
        if kind == "text":
            text.append(name)
            if link:
                linked += len(name)
            continue
        if kind == "raw":
            continue
        inline = name in INLINE
        if kind == "close":
            if name == "a":
                link = False
            if inline and not open_.get(name):
                continue
            if open_.get(name):
                flush()
                at = len(stack) - 1
                while stack[at].name != name:
                    at -= 1
                pop_to(at)
            elif not inline:
                flush()
            continue
        marks = _marks(attrs) if attrs else {}
        hint = _hint(name, marks)
        if inline and (name in VOID or not hint and not open_.get(name)):
            link = link or name == "a"
            continue
        flush()
        if name in CLOSES_P and stack[-1].name == "p":
            pop_to(len(stack) - 1)
        elif name in SIBLINGS and stack[-1].name in SIBLINGS[name]:
            pop_to(len(stack) - 1)
        if name in VOID:
            continue
        element = Element(name, marks, hint or name == "header" and stack[-1].name in ("#root", "html", "body"))
        stack[-1].kids.append(element)
        order.append(element)
        stack.append(element)
        open_[name] = open_.get(name, 0) + 1
    flush()
    return order


class Item:
    """An item of a wrapper.

    ``text``: hash of a text that all pages share, None for a slot; ``show`` its beginning; ``optional``,
    ``repeated``, ``group``; ``chars`` and ``links``: characters of text seen, and of those inside links;
    ``pages`` that have it, at least.  After marking: ``region`` of the article, ``title`` for a heading
    before it, ``drop`` for template inside it, ``keep`` for furniture by name that holds the article.
    """

    FIELDS = ("sig", "name", "hint", "text", "show", "optional", "repeated", "group", "chars", "links", "pages", "region", "title", "drop", "keep")
    __slots__ = (*FIELDS, "kids", "_places")

    def __init__(self, sig: str, name: str, kids: list[Item], **more):
        self.sig, self.name, self.kids = sig, name, kids
        self.hint = self.optional = self.repeated = self.group = self.region = self.title = self.drop = self.keep = False
        self.text, self.show, self.chars, self.links, self.pages = None, "", 0, 0, 1
        self._places = None
        for k, v in more.items():
            setattr(self, k, v)

    def copy(self, **more) -> Item:
        return Item(self.sig, self.name, more.pop("kids", self.kids), **{k: getattr(self, k) for k in self.FIELDS[2:]} | more)

    def place(self, at: int, sig: str) -> tuple[int, Item | None]:
        """The first item of this signature from place ``at``, else from the start, also inside groups."""
        if self._places is None:
            self._places = {}
            for k, kid in enumerate(self.kids):
                for x in _inside_groups(kid):
                    spots, items = self._places.setdefault(x.sig, ([], []))
                    if not spots or spots[-1] != k:
                        spots.append(k)
                        items.append(x)
        spots, items = self._places.get(sig, ((), ()))
        if not spots:
            return at, None
        k = bisect_left(spots, at)
        k = 0 if k == len(spots) else k
        return spots[k], items[k]


def _inside_groups(item: Item) -> Iterator[Item]:
    todo = [item]
    while todo:
        x = todo.pop()
        if x.group:
            todo += reversed(x.kids)
        else:
            yield x


def pack(wrapper: Item) -> bytes:
    """A wrapper as bytes: its items in order with their depths, so nesting is no matter."""
    rows, todo = [], [(0, wrapper)]
    while todo:
        depth, item = todo.pop()
        rows.append((depth, *(getattr(item, f) for f in Item.FIELDS)))
        todo += [(depth + 1, k) for k in reversed(item.kids)]
    return zlib.compress(pickle.dumps(rows), 1)


def unpack(packed: bytes) -> Item:
    path: list[Item] = []
    for depth, sig, name, *rest in pickle.loads(zlib.decompress(packed)):
        item = Item(sig, name, [], **dict(zip(Item.FIELDS[2:], rest, strict=True)))
        del path[depth:]
        if path:
            path[-1].kids.append(item)
        path.append(item)
    return path[0]


Step = Generator["Step", object, object]


def _run(step: Step):
    """Runs steps that yield further steps and receive their results; the stack is a list."""
    stack, value = [step], None
    while stack:
        try:
            step, value = stack[-1].send(value), None
            stack.append(step)
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def page_item(order: list[Element]) -> Item:
    """The wrapper of one page alone."""
    made: dict[int, Item] = {}
    for element in reversed(order):
        kids = []
        for kid in element.kids:
            if isinstance(kid, tuple):
                kids.append(Item("#", "#", [], text=xxhash.xxh3_64_intdigest(kid[0]), show=kid[0][:40], chars=len(kid[0]), links=kid[1]))
            else:
                kids.append(made.pop(id(kid)))
        kids = _run(_fold(kids)) if len(kids) > 1 else kids
        made[id(element)] = Item(element.sig, element.name, kids, hint=element.hint, chars=sum(k.chars for k in kids), links=sum(k.links for k in kids))
    return made[id(order[0])]


def _merge(a: Item, b: Item, apart: bool) -> Step:
    """The item that describes both (of one signature); ``apart`` if they come from different pages."""
    return _both(a, b, (yield _align(a.kids, b.kids, apart)) if a.kids or b.kids else [], apart)


def _simple(a: Item, b: Item) -> bool:
    """Whether both are texts, or hold one text and nothing else."""
    return not a.kids and not b.kids or len(a.kids) == len(b.kids) == 1 and a.kids[0].sig == b.kids[0].sig == "#"


def _merge_simple(a: Item, b: Item, apart: bool) -> Item:
    return _both(a, b, [_both(a.kids[0], b.kids[0], [], apart)] if a.kids else [], apart)


def _both(a: Item, b: Item, kids: list[Item], apart: bool) -> Item:
    if a.sig != "#" or a.text is None or b.text is None:
        text = None
    elif apart:
        text = a.text if a.text == b.text else None
    else:  # the texts of one page follow one another
        text = xxhash.xxh3_64_intdigest(f"{a.text} {b.text}")
    return Item(
        a.sig, a.name, kids, hint=a.hint and b.hint, text=text, show=a.show, optional=a.optional or b.optional, repeated=a.repeated or b.repeated, group=a.group,
        chars=a.chars + b.chars, links=a.links + b.links, pages=a.pages + b.pages if apart else max(a.pages, b.pages),
    )


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: the longest one, or for very long sequences one found in a single pass."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    out = [(k, k) for k in range(lead)]
    if x and y and len(x) * len(y) <= _ALIGN_CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append((lead + i, lead + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    elif x and y:
        spots: dict[str, list[int]] = {}
        for j, sig in enumerate(y):
            spots.setdefault(sig, []).append(j)
        j = 0
        for i, sig in enumerate(x):
            where = spots.get(sig, ())
            k = bisect_left(where, j)
            if k < len(where):
                out.append((lead + i, lead + where[k]))
                j = where[k] + 1
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _align(a: list[Item], b: list[Item], apart: bool) -> Step:
    """One sequence for both; what one side lacks is optional."""
    out, i, j = [], 0, 0
    for x, y in [*_matched([k.sig for k in a], [k.sig for k in b]), (len(a), len(b))]:
        out += [k if k.optional else k.copy(optional=True) for k in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merge_simple(a[x], b[y], apart) if _simple(a[x], b[y]) else (yield _merge(a[x], b[y], apart)))
        i, j = x + 1, y + 1
    return (yield _fold(out)) if len(out) > 1 else out


def _fold(items: list[Item]) -> Step:
    """Tandem repeats of one to three items become one repeated item or group."""
    for period in (1, 2, 3):
        out: list[Item] = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * period and all(out[-k].sig == out[-k - period].sig for k in range(1, period + 1)):
                last, before = out[-period:], out[-2 * period : -period]
                del out[-2 * period :]
                both = []
                for x, y in zip(before, last, strict=True):
                    both.append(_merge_simple(x, y, False) if _simple(x, y) else (yield _merge(x, y, False)))
                if period == 1:
                    both[0].repeated = True
                    out += both
                else:
                    out.append(Item("(" + " ".join(x.sig for x in both) + ")", "", both, repeated=True, group=True, chars=sum(x.chars for x in both), links=sum(x.links for x in both), pages=max(x.pages for x in both)))
            if period > 1 and len(out) > period and out[-period - 1].group and [x.sig for x in out[-period - 1].kids] == [x.sig for x in out[-period:]]:
                group, kids = out[-period - 1], []
                for x, y in zip(group.kids, out[-period:], strict=True):
                    kids.append(_merge_simple(x, y, False) if _simple(x, y) else (yield _merge(x, y, False)))
                del out[-period - 1 :]
                out.append(group.copy(kids=kids, chars=sum(x.chars for x in kids), links=sum(x.links for x in kids)))
        items = out
    return items


def merge(a: Item, b: Item) -> Item:
    """The wrapper of the pages of both."""
    return _run(_merge(a, b, True))


def expression(w: Item) -> str:
    """The wrapper as a regular expression, for people."""

    def step(w: Item) -> Step:
        if w.sig == "#":
            body = "#TEXT" if w.text is None else repr(w.show)
        else:
            inner = []
            for k in w.kids:
                inner.append((yield step(k)))
            body = f"({' '.join(inner)})" if w.group else f"<{w.sig}>{' '.join(inner)}</>"
        return f"({body}){'*' if w.optional and w.repeated else '+' if w.repeated else '?'}" if w.optional or w.repeated else body

    return _run(step(w))


def infer(pages: list[str]) -> Item:
    """One wrapper of all ``pages``, with the article's region marked."""
    wrapper = None
    for page in pages or [""]:
        tree = page_item(parse(page))
        wrapper = tree if wrapper is None else merge(wrapper, tree)
    return mark(wrapper, max(1, len(pages)))


def mark(wrapper: Item, pages: int) -> Item:
    """Finds the article's region in the wrapper of ``pages`` pages; returns the wrapper."""
    order: list[Item] = []
    todo = [wrapper]
    while todo:
        item = todo.pop()
        order.append(item)
        todo += reversed(item.kids)
    slot: dict[int, int] = {}  # characters of text that differs between pages or that a single page has
    bare: dict[int, int] = {}  # the same outside links
    framed: dict[int, int] = {}  # of that, inside article and main
    for item in reversed(order):
        k = id(item)
        if item.sig == "#":
            slot[k] = item.chars if item.text is None or item.pages < 2 else 0
            bare[k], framed[k] = max(0, slot[k] - item.links), 0
        else:
            slot[k], bare[k], framed[k] = (sum(of[id(c)] for c in item.kids) for of in (slot, bare, framed))
            framed[k] = bare[k] if item.name in MAIN else framed[k]
    mass: dict[int, int] = {}  # characters outside links and outside blocks named as furniture
    named: dict[int, int] = {}  # of that, inside articles, or inside main where it has no article
    for item in reversed(order):
        k = id(item)
        if item.hint:  # a name is no reason to leave out what holds most of the host's text
            item.keep = 2 * bare[k] > bare[id(wrapper)] and (item.name in FRAMES or 2 * framed[k] > bare[k])
        mass[k] = bare[k] if item.sig == "#" else 0 if item.hint and not item.keep else sum(mass[id(c)] for c in item.kids)
        named[k] = 0 if item.hint and not item.keep else sum(named[id(c)] for c in item.kids)
        if item.name == "article" or item.name == "main" and not named[k]:
            named[k] = mass[k]

    def weight(item: Item) -> int:
        return mass[id(item)] + 99 * named[id(item)]

    if not mass[id(wrapper)]:
        return wrapper
    at = wrapper
    while at.name != "article":
        kids = [c for c in _content(at) if mass[id(c)]]
        heaviest = max(kids, key=weight)
        if at.name == "main" and not named[id(heaviest)]:
            break
        if heaviest.name not in CONTAINERS or heaviest.repeated and heaviest.name not in MAIN or 10 * weight(heaviest) < 9 * sum(map(weight, kids)):
            break
        if heaviest.name in MAIN:
            for c in kids:
                c.region = c.name == heaviest.name
        elif not named[id(heaviest)]:
            for c in kids[: kids.index(heaviest)]:
                c.title = c.name in HEADINGS
        at = heaviest
    at.region = True
    if at.name not in MAIN:
        todo = list(at.kids)
        while todo:
            item = todo.pop()
            if item.name in BLOCKS and item.chars and not slot[id(item)] and item.pages >= 3 and 2 * item.pages >= pages:
                item.drop = True
            elif not item.hint or item.keep:
                todo += item.kids
    return wrapper


def _content(item: Item) -> list[Item]:
    """The items directly inside, those of groups included, without furniture."""
    return [x for k in item.kids for x in _inside_groups(k) if not x.hint or x.keep]


def extract(page: str, wrapper: Item) -> list[str]:
    """Blocks of the article, in page order; a page that the wrapper finds nothing in is its own host."""
    order = parse(page)
    return _extract(order[0], wrapper) or _extract(order[0], mark(page_item(order), 1))


def _extract(tree: Element, wrapper: Item) -> list[str]:
    """Blocks of the region and of the headings before it; none where the page lacks the region."""
    out: list[str] = []
    met = wrapper.region
    stack: list[list] = [[iter(tree.kids), wrapper, wrapper.region, 0]]
    while stack:
        frame = stack[-1]
        kids, item, inside, at = frame
        kid = next(kids, None)
        if kid is None:
            stack.pop()
        elif isinstance(kid, tuple):
            if inside:
                out.append(kid[0])
            if item is not None:
                frame[3] = item.place(at, "#")[0]
        else:
            match = None
            if item is not None:
                frame[3], match = item.place(at, kid.sig)
            if kid.hint and not (match is not None and match.keep) or match is not None and match.drop:
                continue
            here = match is not None and match.region
            met = met or here
            stack.append([iter(kid.kids), match, inside or here or match is not None and match.title, 0])
    return out if met else []


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_PARTIAL = "host string, task long, seq long, pages long, wrapper binary"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the pages of one task, by host; several of a host if the task meets very many hosts."""
    task, seq = TaskContext.get().partitionId(), 0
    held: dict[str, tuple[int, Item]] = {}

    def out() -> pa.RecordBatch:
        rows = [(host, task, seq, n, pack(w)) for host, (n, w) in held.items()]
        held.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], ["host", "task", "seq", "pages", "wrapper"])

    for batch in batches:
        for part in slices(batch, "html", 4 << 20):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                tree = page_item(parse(page))
                n, wrapper = held.get(host, (0, None))
                held[host] = (n + 1, tree if wrapper is None else merge(wrapper, tree))
            if len(held) > 4096:
                yield out()
                seq += 1
    yield out()


def _joined(rows: pd.DataFrame) -> Item:
    wrapper = None
    for packed in rows.sort_values(["task", "seq"])["wrapper"]:
        more = unpack(packed)
        wrapper = more if wrapper is None else merge(wrapper, more)
    return wrapper


def wrappers(pages: DataFrame, fan_in: int = 64) -> DataFrame:
    """(host, wrapper): inferred from all pages of each host that have html.

    Every task aligns its own pages; wrappers of ``fan_in`` neighbouring tasks are merged, then those,
    so that a host with pages in every task isn't merged in one go.  The order is that of the tasks.
    """

    def some_tasks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "task": [key[1]], "seq": [0], "pages": [int(rows["pages"].sum())], "wrapper": [pack(_joined(rows))]})

    def one_host(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [pack(mark(_joined(rows), int(rows["pages"].sum())))]})

    some = pages.select(host_of().alias("host"), "html").filter("length(html) > 0")
    parts = some.mapInArrow(_partial, _PARTIAL).withColumn("task", F.expr(f"task div {fan_in}"))
    parts = parts.groupBy("host", "task").applyInPandas(some_tasks, _PARTIAL)
    return parts.groupBy("host").applyInPandas(one_host, "host string, wrapper binary")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, blocks) for every row of ``pages`` (page_id, url, html).

    The whole html is read; null or empty gives an empty text.  Pages whose url is null or has no
    host share one wrapper.  Repeated rows give repeated results; extra columns are ignored; an
    empty table gives an empty result.  Character references are decoded, white space inside a
    block becomes one space, and blocks are joined by one space.
    """
    scratch = Scratch(pages.sparkSession, "html")
    by_host = scratch.save(wrappers(pages), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Item] = {}
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                blocks = []
                for page, host, packed in zip(*(part.column(c).to_pylist() for c in ("html", "host", "wrapper")), strict=True):
                    if not page:
                        blocks.append([])
                        continue
                    if host not in known:
                        if len(known) > 256:
                            known.clear()
                        known[host] = unpack(packed)
                    blocks.append(extract(page, known[host]))
                texts = [" ".join(b) for b in blocks]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(blocks, pa.list_(pa.string()))],
                    ["page_id", "url", "text", "n_chars", "blocks"],
                )

    rows = pages.select("page_id", "url", "html", host_of().alias("host")).join(by_host, "host", "left")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, blocks array<string>")
