"""Page scanning for ``mapInArrow`` (the batch path's only Python step).

``Pages`` looks at the bytes of a whole Arrow batch at once: numpy finds every
``<`` and the ``>`` that ends its tag, wherever all quotes up to there plainly
delimit attribute values. The few other tags are matched one by one, by a pattern
that never backtracks. What is found follows the HTML5 tokeniser: a quote
delimits a value only after ``=``; ``-->`` and ``--!>`` end a comment, ``<!-->`` and
``<!--->`` are whole ones; ``script``, ``style`` and their like hold text without
entities, ``title`` and ``textarea`` text with them; a tag, comment or value that
is never ended takes the rest of the page. Only tags cost Python steps, and text
is decoded only where a selector listens.

Nesting is made for the page shapes that the jobs read: void elements have no
content, an open ``td``/``th``/``tr``/``li``/``p`` ends at the start of a sibling, an
end tag closes back to its open element but never across a table. The places of
open elements are kept per tag name, so an end tag without one costs nothing and
what is searched is closed: the scan is linear in the page.

* detail rows: for every table (document order) and every ``tr`` inside it
  (nested tables included), the text of the row's first ``strong`` and the first
  text node of its first ``span.t-text.-right``. Rows without a ``strong`` are
  skipped.
* properties: for each term, the value of the last row whose lower-cased label
  holds it. A row lies in all tables around it, and the last of these is the
  innermost, so each row is looked at once; its label goes through one
  Aho-Corasick automaton of all terms. Of pages with the same body, a worker
  scans one (``Repeated``), here and for links.
* links: elements that match a chain of nested elements, with their ``href`` and
  the first text node of a name element.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa

# FIXED VALUES of HTML: elements without content, elements whose content is text,
# start tags that end open elements (and where the search for those stops).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RAW_ENTITIES = frozenset("title textarea".split())
_ENDS = {"td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
         "tr": (("tr",), ("table",)), "li": (("li",), ("ul", "ol", "table")),
         **{t: (("tbody", "thead", "tfoot"), ("table",)) for t in ("tbody", "thead", "tfoot")}}
_ENDS_P = frozenset(("address article aside blockquote div dl fieldset footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main nav ol p pre section table ul").split())
_STOP_P = ("table", "td", "th", "button")

_NAME = re.compile(rb"[A-Za-z][^ \t\n\f\r/>]*+")  # longer ones than numpy compares
# the rest of a tag; an unended quoted value runs to the page's end, where no > follows
_REST = re.compile(rb"""(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"""
                   rb"""(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)"""
                   rb"""|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+|(?=>)))?+)*+>""")
_ATTR = re.compile(r"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)"""
                   r"""(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+)|))?""")
_COMMENT_END = re.compile(rb"--!?>")
_RAW_END = {t: re.compile(rb"</" + t.encode() + rb"(?=[ \t\n\f\r/>])", re.I) for t in RAW | RAW_ENTITIES}
# a script may hold a commented script, whose end tag is not its own
_SCRIPT = re.compile(rb"<!--|-->|<(/?)script(?=[ \t\n\f\r/>])", re.I)
_BLANKS = re.compile(r"[ \t\n\f\r]+")

_DELIMITS = np.zeros(256, bool)  # no part of an attribute's name
_DELIMITS[[0x20, 0x09, 0x0A, 0x0C, 0x0D, 0x2F, 0x3C, 0x3E, 0x22, 0x27, 0x3D]] = True
_ENDS_NAME = np.zeros(256, bool)
_ENDS_NAME[[0x20, 0x09, 0x0A, 0x0C, 0x0D, 0x2F, 0x3E, 0x00]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


@dataclass(frozen=True)
class Compound:
    """What an element must be: tag, classes it has, attributes it has."""
    tag: str
    classes: tuple = ()
    attrs: tuple = ()  # ((name, value), ...)


# FIXED VALUES: selectors of the source site's listing and detail pages.
LISTING_LINKS = (Compound("div", (), (("data-bb-view", "list-aZ-stream"),)),
                 Compound("table", ("m-table", "-firstlevel")),
                 Compound("a", ("u-hidden", "-xs")))
LISTING_NAME = Compound("span", ("t-text",))
DETAIL_LABEL = Compound("strong")
DETAIL_VALUE = Compound("span", ("t-text", "-right"))
NAV_LINKS = (Compound("nav"), Compound("a"))


# --- tags of a batch of pages

def _bytes(html: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch (nulls as empty) and its n+1 offsets."""
    html = html.cast(pa.large_binary())
    if not len(html):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if html.null_count:
        html = html.fill_null(b"")
    _, offsets, data = html.buffers()
    off = np.frombuffer(offsets, np.int64)[html.offset:html.offset + len(html) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Pages:
    """The pages of an Arrow batch. ``page(i)``: the bytes of a page, where its
    ``<`` lie, for each the place after its tag if that is plain, else -1, and the
    tags with their names."""

    def __init__(self, html: pa.Array):
        self.raw, self.off = _bytes(html)
        self.starts = np.flatnonzero(self.raw == 0x3C)
        self.cut = np.searchsorted(self.starts, self.off)
        self.ends = self._plain_ends()
        self.tags, self.names = self._tags()

    def _tags(self) -> tuple[np.ndarray, list[str]]:
        """For every ``<`` its tag: twice the name's number in the list, one more for
        an end tag; -1 if no name of up to eight bytes follows."""
        lt, size = self.starts, len(self.raw)
        if not len(lt):
            return np.zeros(0, np.int64), []
        raw = np.concatenate([self.raw, np.zeros(10, np.uint8)])
        closing = raw[lt + 1] == 0x2F
        at = lt + 1 + closing
        # up to eight bytes and what follows; a page's end ends them, too
        name = raw[at[:, None] + np.arange(9)]
        page_end = np.repeat(self.off[1:], np.diff(self.cut))
        over = _ENDS_NAME[name] | (at[:, None] + np.arange(9) >= page_end[:, None])
        length = np.where(over.any(axis=1), over.argmax(axis=1), 9)
        name = np.where(_UPPER[name], name | 0x20, name)
        name[np.arange(9) >= length[:, None]] = 0
        known, number = np.unique(np.ascontiguousarray(name[:, :8]).view(np.uint64).ravel(), return_inverse=True)
        names = [k.tobytes().rstrip(b"\0").decode("utf-8", "replace") for k in known]
        is_tag = _LETTER[raw[at]] & (at < np.minimum(page_end, size)) & (length < 9)
        return np.where(is_tag, 2 * number + closing, -1), names

    def _plain_ends(self) -> np.ndarray:
        raw, lt = self.raw, self.starts
        if not len(lt):
            return np.zeros(0, np.int64)
        page_end = np.repeat(self.off[1:], np.diff(self.cut))
        gt = np.flatnonzero(raw == 0x3E)
        at = np.searchsorted(gt, lt)
        close = np.where(at < len(gt), gt[np.minimum(at, len(gt) - 1)] if len(gt) else 0, len(raw))
        plain = close < page_end
        # the quotes before that > come in pairs, each opened by a name and =, and
        # there are no other values: then none of them is open at the >
        quote = np.flatnonzero((raw == 0x22) | (raw == 0x27))
        if len(quote):
            equal = np.flatnonzero(raw == 0x3D)
            named = (raw[np.maximum(quote - 1, 0)] == 0x3D) & (quote > 1) & ~_DELIMITS[raw[np.maximum(quote - 2, 0)]]
            single = raw[quote] == 0x27
            before = np.searchsorted(equal, quote)
            a, b = np.searchsorted(quote, lt), np.searchsorted(quote, np.minimum(close, len(raw)))

            def sums(x: np.ndarray, parity: int) -> np.ndarray:
                """Prefix sums over the quotes of one parity."""
                y = np.zeros(len(quote) + 1, np.int64)
                y[1 + parity::2] = x[parity::2]
                return np.cumsum(y)
            inside = np.append(before[1:], len(equal)) - before  # = up to the next quote
            odd = a % 2 == 1
            unnamed = [sums(~named, p) for p in (0, 1)]
            held = [sums(inside, p) for p in (0, 1)]
            singles = np.concatenate([[0], np.cumsum(single)])

            def between(s: list) -> np.ndarray:
                return np.where(odd, s[1][b] - s[1][a], s[0][b] - s[0][a])
            equals = np.searchsorted(equal, np.minimum(close, len(raw))) - np.searchsorted(equal, lt)
            plain &= ((b == a) | (((b - a) % 2 == 0) & (singles[b] == singles[a]) & (between(unnamed) == 0)
                                  & (equals - between(held) == (b - a) // 2)))
        return np.where(plain, close + 1 - np.repeat(self.off[:-1], np.diff(self.cut)), -1)

    def __len__(self) -> int:
        return len(self.off) - 1

    def page(self, i: int) -> tuple[bytes, list[int], list[int], list[int], list[str]]:
        a, b = self.cut[i], self.cut[i + 1]
        return (self.raw[self.off[i]:self.off[i + 1]].tobytes(), (self.starts[a:b] - self.off[i]).tolist(),
                self.ends[a:b].tolist(), self.tags[a:b].tolist(), self.names)


def _raw_end(name: str, html: bytes, at: int) -> int:
    """Where the text content of a raw element ends."""
    if name != "script":
        m = _RAW_END[name].search(html, at)
        return m.start() if m else len(html)
    state = 0  # 1: in a comment, 2: in a script in it
    for m in _SCRIPT.finditer(html, at):
        what = m[0][:3]
        if what == b"<!-":
            state = state or 1
        elif what == b"-->":
            state = 0
        elif m[1]:
            if state < 2:
                return m.start()
            state = 1
        elif state == 1:
            state = 2
    return len(html)


# --- elements

class Element:
    """An element while it is open: what a scan keeps with it."""
    __slots__ = ("tag", "html", "at", "end", "data", "text")

    def __init__(self, tag: str, html: bytes, at: int, end: int):
        self.tag, self.html, self.at, self.end = tag, html, at, end
        self.data = self.text = None

    def attributes(self) -> dict:
        """The first of duplicate names wins; entities are decoded."""
        out: dict = {}
        source = self.html[self.at:self.end].decode("utf-8", "replace")
        for name, double, single, bare in _ATTR.findall(source):
            out.setdefault(name.lower(), unescape(double or single or bare))
        return out

    def matches(self, c: Compound) -> bool:
        if self.tag != c.tag:
            return False
        if not c.classes and not c.attrs:
            return True
        a = self.attributes()
        return set(c.classes) <= set(_BLANKS.split(a.get("class", ""))) and all(a.get(k) == v for k, v in c.attrs)


class Text:
    """The text nodes inside an element, by their numbers."""
    __slots__ = ("nodes", "first", "end")

    def __init__(self, nodes: list[str]):
        self.nodes, self.first, self.end = nodes, len(nodes), None

    def all(self) -> str:
        return "".join(self.nodes[self.first:self.end])

    def node(self) -> str | None:
        """The first text node."""
        return self.nodes[self.first] if self.first < (len(self.nodes) if self.end is None else self.end) else None


class Scan:
    """One page: ``run`` calls ``opened`` and ``closed`` for every element whose tag
    is in ``watched``."""
    watched: frozenset = frozenset()

    def __init__(self):
        self.stack: list[str] = []  # tags of the open elements
        self.open: list[Element] = []  # the watched ones
        self.where: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
        self.nodes: list[str] = []
        self.listening = 0

    def opened(self, e: Element) -> None:
        """``e`` starts."""

    def closed(self, e: Element) -> None:
        """``e`` ends."""

    def listen(self, e: Element) -> Text:
        """Keep the text nodes of ``e``, which starts."""
        if e.text is None:
            e.text = Text(self.nodes)
            self.listening += 1
        return e.text

    def _top(self, tags: tuple) -> int:
        """Place of the innermost open element of these tags, or -1."""
        at = -1
        for t in tags:
            places = self.where.get(t)
            if places and places[-1] > at:
                at = places[-1]
        return at

    def _close(self, tags: tuple, stop: tuple) -> None:
        at = self._top(tags)
        if at >= 0 and at > self._top(stop):
            self._cut(at)

    def _cut(self, to: int) -> None:
        """End all open elements down to this place."""
        stack, where = self.stack, self.where
        while len(stack) > to:
            tag = stack.pop()
            where[tag].pop()
            if tag in self.watched:
                self._end(self.open.pop())

    def _end(self, e: Element) -> None:
        if e.text is not None:
            e.text.end = len(self.nodes)
            self.listening -= 1
        self.closed(e)

    def _say(self, pieces: list[bytes], entities: bool = True) -> None:
        text = b"".join(pieces).decode("utf-8", "replace")
        if text:
            if "\r" in text:
                text = text.replace("\r\n", "\n").replace("\r", "\n")
            self.nodes.append(unescape(text) if entities and "&" in text else text)

    def run(self, html: bytes, starts: list[int], ends: list[int], tags: list[int], names: list[str]) -> None:
        at = 0  # all before is done; text since then is pending
        size = len(html)
        pieces: list[bytes] = []  # of the pending text node
        stack, where, watched, unnested = self.stack, self.where, self.watched, _ENDS.keys() | _ENDS_P
        for lt, end, tag in zip(starts, ends, tags):
            if lt < at:  # inside a comment, a value or raw text
                continue
            if tag >= 0:
                closing = tag & 1
                tag = names[tag >> 1]
                name_end = lt + 1 + closing + len(tag)
            else:
                closing = html.startswith(b"/", lt + 1)
                m = _NAME.match(html, lt + 1 + closing)
                if m is None:
                    at = self._no_tag(html, lt, at, pieces)
                    continue
                tag, name_end = m[0].lower().decode("utf-8", "replace"), m.end()
            if self.listening:
                self._say([*pieces, html[at:lt]])
            if pieces:
                pieces.clear()
            if end < 0:
                rest = _REST.match(html, name_end)
                if rest is None:  # never ended: the rest of the page is the tag
                    at = size
                    break
                end = rest.end()
            at = end
            if closing:
                if stack and stack[-1] == tag:
                    stack.pop()
                    where[tag].pop()
                    if tag in watched:
                        self._end(self.open.pop())
                elif where.get(tag):
                    self._close((tag,), () if tag == "table" else ("table",))
                continue
            if tag in unnested:
                if tag in _ENDS:
                    self._close(*_ENDS[tag])
                if tag in _ENDS_P and where.get("p"):
                    self._close(("p",), _STOP_P)
            if tag in watched:
                e = Element(tag, html, name_end, end - 1)
                self.opened(e)
                if tag in VOID:
                    self._end(e)
                    continue
                self.open.append(e)
            elif tag in VOID:
                continue
            if tag in where:
                where[tag].append(len(stack))
            else:
                where[tag] = [len(stack)]
            stack.append(tag)
            if tag in RAW or tag in RAW_ENTITIES:
                at = _raw_end(tag, html, end)
                if self.listening:
                    text = html[end:at]
                    if tag == "textarea" and text[:1] == b"\n":
                        text = text[1:]
                    self._say([text], tag in RAW_ENTITIES)
                if at == size:
                    break
            elif tag == "plaintext":
                if self.listening:
                    self._say([html[end:]], False)
                at = size
                break
        if self.listening and at < size:
            self._say([*pieces, html[at:]])
        self._cut(0)

    def _no_tag(self, html: bytes, lt: int, at: int, pieces: list[bytes]) -> int:
        """What a ``<`` without a tag name is: a comment, nothing, or text. Returns the
        place after what is done."""
        c = html[lt + 1:lt + 2]
        if html.startswith(b"/>", lt + 1):  # </> is nothing
            if self.listening:
                pieces.append(html[at:lt])
            return lt + 3
        if not (c in (b"!", b"?") or (c == b"/" and lt + 2 < len(html))):
            return at
        if self.listening:
            self._say([*pieces, html[at:lt]])
        pieces.clear()
        if not html.startswith(b"!--", lt + 1):
            done = html.find(b">", lt + 1)
            return len(html) if done < 0 else done + 1
        if html.startswith((b">", b"->"), lt + 4):
            return html.index(b">", lt + 4) + 1
        found = _COMMENT_END.search(html, lt + 4)
        return found.end() if found else len(html)


class Row:
    """A table row: its label, its value and the innermost table around it."""
    __slots__ = ("around", "label", "value", "number")


class DetailScan(Scan):
    """The labelled rows of a detail page. ``places``: remember for each row its
    (table, row) in every table around it."""
    watched = frozenset(("table", "tr", DETAIL_LABEL.tag, DETAIL_VALUE.tag))

    def __init__(self, places: bool = False):
        super().__init__()
        self.tables: list[list[int]] = []  # open: [number, rows so far]
        self.n_tables = 0
        self.rows: list[Row] = []
        self.wanting: tuple[list[Row], list[Row]] = ([], [])  # open rows without label, without value
        self.places = places

    def opened(self, e: Element) -> None:
        tag = e.tag
        if tag == "tr":
            if self.tables:
                row = Row()
                row.label = row.value = None
                row.number = len(self.rows)
                row.around = [tuple(t) for t in self.tables] if self.places else self.tables[-1][0]
                if self.places:
                    for t in self.tables:
                        t[1] += 1
                self.rows.append(row)
                for w in self.wanting:
                    w.append(row)
                e.data = row
        elif tag == "table":
            self.tables.append([self.n_tables, 0])
            self.n_tables += 1
        elif tag == DETAIL_LABEL.tag:
            if self.wanting[0] and e.matches(DETAIL_LABEL):
                text = self.listen(e)
                for row in self.wanting[0]:
                    row.label = text
                self.wanting[0].clear()
        elif tag == DETAIL_VALUE.tag and self.wanting[1] and e.matches(DETAIL_VALUE):
            text = self.listen(e)
            for row in self.wanting[1]:
                row.value = text
            self.wanting[1].clear()

    def closed(self, e: Element) -> None:
        if e.tag == "tr":
            for w in self.wanting:  # rows end innermost first
                if w and w[-1] is e.data:
                    w.pop()
        elif e.tag == "table":
            self.tables.pop()


class LinkScan(Scan):
    """Elements at the end of a chain of nested elements."""

    def __init__(self, chain: tuple, name: Compound | None):
        super().__init__()
        self.chain, self.name = chain, name
        self.watched = frozenset(c.tag for c in (*chain, *([name] if name else [])))
        self.steps = [0]  # of the chain, met by the open elements up to each
        self.found: list[list] = []  # [href, text of the name]
        self.wanting: list[list] = []  # open links without a name

    def opened(self, e: Element) -> None:
        step = self.steps[-1]
        last = len(self.chain) - 1
        if self.name is not None and self.wanting and e.matches(self.name):
            text = self.listen(e)
            for link in self.wanting:
                link[1] = text
            self.wanting.clear()
        if step == last and e.matches(self.chain[last]):
            e.data = [e.attributes().get("href"), None if self.name is not None else self.listen(e)]
            self.found.append(e.data)
            if self.name is not None:
                self.wanting.append(e.data)
        elif step < last and e.matches(self.chain[step]):
            step += 1
        self.steps.append(step)

    def closed(self, e: Element) -> None:
        self.steps.pop()
        if e.data is not None and self.wanting and self.wanting[-1] is e.data:
            self.wanting.pop()


# --- scans of batches

class Repeated:
    """What scans said of the bodies they saw last, by a 16-byte digest: a site serves
    the same body at many URLs (its last page for all later numbers), and a
    crawler stores those side by side. Kept in a worker, for ``most`` bodies and
    ``most_values`` values in all."""

    def __init__(self, most: int = 4096, most_values: int = 1 << 18):
        self.most, self.most_values = most, most_values
        self.held: OrderedDict[tuple, list] = OrderedDict()
        self.values = self.scanned = 0

    def each(self, html: pa.Array, how: Hashable, scan: Callable[[Pages], Iterable[list]]) -> list[list]:
        """The result of every body of a batch; ``scan`` sees each new one once."""
        raw, off = _bytes(html)
        at = off.tolist()
        keys = [(how, blake2b(raw[x:y], digest_size=16).digest()) for x, y in zip(at[:-1], at[1:])]
        new = {k: i for i, k in enumerate(keys) if k not in self.held}
        got = dict(zip(new, scan(Pages(html.take(pa.array(list(new.values()), pa.int64())))))) if new else {}
        self.scanned += len(new)
        out = [got[k] if k in got else self.held[k] for k in keys]
        for k, values in got.items():
            self.held[k] = values
            self.values += len(values) + 1
        for k in dict.fromkeys(keys):
            self.held.move_to_end(k)
        while len(self.held) > self.most or self.values > self.most_values:
            self.values -= len(self.held.popitem(last=False)[1]) + 1
        return out


_repeated = Repeated()


def _one(html: str) -> pa.Array:
    return pa.array([html], pa.large_string())


def detail_rows_of(pages: Pages) -> Iterator[list[tuple[int, int, str, str | None]]]:
    """Per page, (table_ord, row_ord, label, value) for every labelled table row;
    a row counts in every table around it."""
    for i in range(len(pages)):
        scan = DetailScan(places=True)
        scan.run(*pages.page(i))
        out = [(t, r, row.label.all(), row.value.node() if row.value else None)
               for row in scan.rows if row.label is not None for t, r in row.around]
        yield sorted(out, key=lambda x: x[:2])


class Terms:
    """Which of some terms a label holds, lower-cased: an automaton of all terms,
    and what it said of the labels seen (bounded)."""

    def __init__(self, terms: tuple[str, ...]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for k, term in enumerate(terms):
            same.setdefault(term, []).append(k)
        for term, numbers in same.items():
            self.automaton.add_word(term, numbers)
        self.automaton.make_automaton()
        self.known: dict[str, list[int]] = {}

    def of(self, label: str) -> list[int]:
        got = self.known.get(label)
        if got is None:
            got = sorted({k for _, numbers in self.automaton.iter(label.lower()) for k in numbers})
            if len(label) <= 256:
                if len(self.known) > 4096:
                    self.known.clear()
                self.known[label] = got
        return got


@lru_cache(maxsize=8)
def _terms(terms: tuple[str, ...]) -> Terms:
    """One automaton per worker."""
    return Terms(terms)


def properties_of(html: pa.Array, terms: tuple[str, ...]) -> list[list[str | None]]:
    """Per page and term, the value of the last row whose label holds the term, by
    (table, row); None if that row has no value."""
    automaton = _terms(terms)

    def scan(pages: Pages) -> Iterator[list[str | None]]:
        for i in range(len(pages)):
            page = DetailScan()
            page.run(*pages.page(i))
            best: list = [None] * len(terms)
            for row in page.rows:
                if row.label is not None:
                    for k in automaton.of(row.label.all()):
                        # rows come in document order, so only an inner table's row can be later
                        if best[k] is None or row.around >= best[k].around:
                            best[k] = row
            yield [row.value.node() if row is not None and row.value is not None else None for row in best]
    return _repeated.each(html, terms, scan)


def links_of(html: pa.Array, chain: tuple = LISTING_LINKS, name: Compound | None = LISTING_NAME
             ) -> list[list[tuple[int, str | None, str | None]]]:
    """Per page, (link_ord, href, name) for every element matching ``chain``; the
    name is the first text node of the first ``name`` element inside (or of the
    link itself when ``name`` is None)."""
    def scan(pages: Pages) -> Iterator[list[tuple[int, str | None, str | None]]]:
        for i in range(len(pages)):
            page = LinkScan(chain, name)
            page.run(*pages.page(i))
            yield [(k, href, text.node() if text is not None else None) for k, (href, text) in enumerate(page.found)]
    return _repeated.each(html, (chain, name), scan)


def detail_rows(html: str) -> list[tuple[int, int, str, str | None]]:
    """``detail_rows_of`` one page."""
    return next(detail_rows_of(Pages(_one(html))))


def links(html: str, chain: tuple = LISTING_LINKS,
          name: Compound | None = LISTING_NAME) -> list[tuple[int, str | None, str | None]]:
    """``links_of`` one page."""
    return links_of(_one(html), chain, name)[0]
