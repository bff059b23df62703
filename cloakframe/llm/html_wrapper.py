"""Main text of web pages through wrappers: union-free regular expressions inferred from pages of the same host.

The tag streams of a host's sample pages are folded (a run that repeats becomes a repeated group) and then aligned
one after another: what only some pages have becomes an optional group, and text becomes a slot. Every text of a page is
bound to the slot of the expression that takes it, by a position automaton (linear in the page); a page that the
expression does not cover (a truncated page, a new section) is aligned with it first, as one more sample would be, but
only for itself. Slots decide what is main text:

* A text that stands in its slot on every page that has the slot is template. Without article and main elements two
  pages with different articles show that; inside them it takes four and a class, id or role on the element or one
  around it (plain paragraphs stay).
* The content region is the article or main element if such slots hold at least half of the text, else the page.
* Names of classes and ids are a prior. Names that leave no doubt (adverts, comments, notices) rule a text out, unless
  an element so named holds nearly all text of the region, other text on each page. For names that articles use too
  (share, side, header), the slot decides: prose that changes from page to page stays.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.runtime import frugal, ship, written

# Elements by their part in a page.
SKIP = set("script style noscript template nav header footer aside form button select option textarea iframe svg menu dialog title object audio video canvas".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
VOID = set("area base br col embed hr img input link meta param source track wbr !doctype".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = ("article", "main")
# Parts of class names and ids beside the main text; those that articles use too; parts that say nothing.
STRONG = re.compile(
    r"ads?|advert\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|banners?|sidebar|menus?|nav|navbar|navigation|breadcrumbs?|masthead|"
    r"comments?|commentlist|respond|replies|disqus|newsletter|subscribe|popup|modal"
)
WEAK = re.compile(r"side|share|sharing|social|header|footer|promos?|promotions?|related|recommended|signup|login|widgets?|overlay|reply")
PLAIN = re.compile(r"box|bar|bars|links?|list|wrap|wrapper|container|block|section|area|item|items|inner|outer|panel|buttons?|icons?|top|bottom|left|right|main|site|page|post|articles?|content|[0-9]*")
PROSE = 12  # words from which a text under a weak name can be prose

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*|!doctype)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, extra) of a page: ("open", tag, class and id), ("close", tag, ""), ("text", text, "")."""
    out, at = [], 0
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not text.isspace():
            out.append(("text", html.unescape(text), ""))
        elif text:
            out.append(("space", " ", ""))
        if not m:
            return out
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            out.append(("close", tag, ""))
            continue
        label = " ".join(next(x for x in g if x) for g in LABEL.findall(m[3]) if any(g))
        out.append(("open", tag, label))
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            out.append(("close", tag, ""))


def symbols(page: list[tuple[str, str, str]], at: list[int] | None = None) -> list[str]:
    """A page's stream for alignment: tags with their labels, and # for text (once for neighbours).

    at gets the symbol (its number) of each entry of the stream.
    """
    out = []
    for kind, name, extra in page:
        s = f"<{name}{'.' + extra if extra else ''}>" if kind == "open" else f"</{name}>" if kind == "close" else "#" if kind == "text" else ""
        if s and not (s == "#" and out and out[-1] == "#"):
            out.append(s)
        if at is not None:
            at.append(len(out) - 1)
    return out


# A node is a symbol, ("+", nodes) or ("?", nodes).


def fold(nodes: list, widest: int = 8) -> list:
    """Runs of equal neighbours as repeated groups, short periods first."""
    for width in range(1, widest + 1):
        out, i = [], 0
        while i < len(nodes):
            part, j = nodes[i : i + width], i + width
            while len(part) == width and nodes[j : j + width] == part:
                j += width
            if j > i + width:
                group = ("+", tuple(part)) if not (width == 1 and isinstance(part[0], tuple)) else part[0]
                out.append(group)
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _body(n) -> tuple:
    return n[1] if isinstance(n, tuple) else (n,)


def _choices(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place of two sequences of numbers (bits, a row per entry of a): is leaving out the entry of a no loss?

    Row by row from the end, the longest common subsequence is the running maximum of what the row before allows.
    """
    below = np.zeros(len(b) + 1, np.int32)
    out = np.zeros((len(a), (len(b) + 7) // 8), np.uint8)
    for i in range(len(a) - 1, -1, -1):
        row = below.copy()
        np.maximum(row[:-1], below[1:] + (b == a[i]), out=row[:-1])
        row = np.maximum.accumulate(row[::-1])[::-1]
        out[i] = np.packbits(below[:-1] >= row[1:])
        below = row
    return out


def align(a: list, b: list, source: list[int | None] | None = None) -> list:
    """The smallest common wrapper by longest common subsequence: the rest of either side becomes optional.

    Two nodes can stand in the same place if their bodies agree. source gets the number of each node in a (None: only
    b has it).
    """
    source = [] if source is None else source
    number: dict[tuple, int] = {}
    x, y = (np.array([number.setdefault(_body(n), len(number)) for n in nodes], np.int64) for nodes in (a, b))
    head = 0
    while head < min(len(a), len(b)) and x[head] == y[head]:
        head += 1
    choices = _choices(x[head:], y[head:])
    out, i, j = [], 0, 0

    def optional(run: list, first: int | None) -> None:
        for k, n in enumerate(run):
            out.append(n if isinstance(n, tuple) and n[0] == "?" else ("?", (n,)))
            source.append(None if first is None else first + k)

    while i < len(a) and j < len(b):
        if x[i] == y[j]:
            kinds = {n[0] for n in (a[i], b[j]) if isinstance(n, tuple)}
            if a[i] == b[j]:
                out.append(a[i])
            elif kinds == {"+", "?"}:
                out.append(("?", (("+", _body(a[i])),)))
            else:
                out.append((kinds.pop(), _body(a[i])))
            source.append(i)
            i, j = i + 1, j + 1
        elif choices[i - head, (j - head) >> 3] >> (7 - (j - head & 7)) & 1:
            optional([a[i]], i)
            i += 1
        else:
            optional([b[j]], None)
            j += 1
    optional(a[i:], i)
    optional(b[j:], None)
    return out


class Automaton:
    """The positions of an expression (its symbols, each in its place), and which may follow which.

    bind() steps through a stream with the set of positions it can be at, so that its time is bounded by the stream
    times the positions, however groups are nested.
    """

    def __init__(self, nodes: list, source: list[int | None]):
        self.slot: list[str | None] = []  # of each position: node of the wrapper and place within it
        self.symbol: list[str] = []
        self.follow: list[dict[str, list[int]]] = []
        first, last, self.empty = [], [], True
        for n, origin in zip(nodes, source):
            begin = len(self.symbol)
            f, e, none = self._add(n)
            self.slot += [None if origin is None else f"{origin}.{k}" for k in range(len(self.symbol) - begin)]
            self._link(last, f)
            first, last = first + f if self.empty else first, last + e if none else e
            self.empty = self.empty and none
        self.start, self.last = self._by_symbol(first), set(last)

    def _by_symbol(self, positions: list[int]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for p in positions:
            out.setdefault(self.symbol[p], []).append(p)
        return out

    def _link(self, last: list[int], first: list[int]) -> None:
        for p in last:
            for s, q in self._by_symbol(first).items():
                held = self.follow[p].setdefault(s, [])
                held += [x for x in q if x not in held]

    def _add(self, n) -> tuple[list[int], list[int], bool]:
        """First and last positions of a node, and whether it can be left out."""
        if isinstance(n, str):
            self.symbol.append(n)
            self.follow.append({})
            return [len(self.symbol) - 1], [len(self.symbol) - 1], False
        first, last, empty = [], [], True
        for x in n[1]:
            f, e, none = self._add(x)
            self._link(last, f)
            first, last = first + f if empty else first, last + e if none else e
            empty = empty and none
        if n[0] == "+":
            self._link(last, first)
        return first, last, empty or n[0] == "?"

    def bind(self, line: list[str]) -> list[int] | None:
        """The position that takes each symbol (of several ways, the one by the earliest positions); None if there is no way."""
        back: list[dict[int, int]] = []
        at: dict[int, int] = {}
        for i, s in enumerate(line):
            at = dict.fromkeys(self.start.get(s, ()), -1) if i == 0 else {q: p for p in sorted(at, reverse=True) for q in self.follow[p].get(s, ())}
            if not at:
                return None
            back.append(at)
        if not line:
            return [] if self.empty else None
        ends = self.last & at.keys()
        if not ends:
            return None
        out = [min(ends)]
        for step in reversed(back[1:]):
            out.append(step[out[-1]])
        return out[::-1]


def doubt(label: str) -> str:
    """What the class, id and role of an element say: "strong" or "weak" (beside the main text), or "" (nothing)."""
    found = ""
    for name in label.split():
        parts = [p for p in re.split(r"[-_:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
        if any(STRONG.fullmatch(p) for p in parts):
            return "strong"
        if any(WEAK.fullmatch(p) for p in parts) and all(WEAK.fullmatch(p) or PLAIN.fullmatch(p) for p in parts):
            found = "weak"
    return found


def _named(tag: str, label: str) -> str:
    return f"{tag}.{re.sub('[0-9]+', '0', label)}"


@dataclass
class Text:
    """A text of a page: its number in the stream, what rules it out and what is known of its place."""

    at: int
    text: str
    gone: bool  # by an element that is never main text
    off: str  # the outermost element whose name rules it out, or ""
    weak: bool  # in an element with a name that articles use too
    inside: tuple[str, ...]  # article and main elements around it
    marked: bool  # it, or an element around it within the innermost of those, has a class, id or role
    block: int = 0


def texts(page: list[tuple[str, str, str]]) -> tuple[list[Text], list[int]]:
    """The texts of a page, and the number of the block that each entry of the stream falls into."""
    stack: list[tuple[str, bool, str, bool, bool]] = []  # tag, gone, off, weak, marked
    found, block, n = [], [], 0
    for i, (kind, name, extra) in enumerate(page):
        if kind in ("open", "close") and name not in INLINE:
            n += 1
        block.append(n)
        if kind == "open" and name not in VOID:
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and any(x[0] == name for x in stack):
                last = max(k for k, x in enumerate(stack) if x[0] == name)  # an end tag left out
                if not any(x[0] in ("ul", "ol", "table", "dl", "blockquote", "div", "section", "article") for x in stack[last:]):
                    del stack[last:]
            say = doubt(extra) if extra and name not in ("html", "body", *CONTENT) else ""
            stack.append((name, name in SKIP, _named(name, extra) if say == "strong" else "", say == "weak", bool(extra)))
        elif kind == "close":
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is not None:
                del stack[at:]
        elif kind == "text":
            inside = tuple(x[0] for x in stack if x[0] in CONTENT)
            depth = max((k + 1 for k, x in enumerate(stack) if x[0] in CONTENT), default=0)
            off = next((x[2] for x in stack if x[2]), "")
            found.append(Text(i, " ".join(name.split()), any(x[1] for x in stack), off, any(x[3] for x in stack), inside, any(x[4] for x in stack[depth:])))
    return found, block


def _different(pages: list[list[tuple[str, str]]], fixed: set[tuple[str, str]]) -> set[int]:
    """Pages whose text beside the fixed texts is a tenth of theirs at least, and not a near copy of another such page's."""
    kept: dict[int, set[str]] = {}
    for n, page in enumerate(pages):
        own = [t for s, t in page if (s, t) not in fixed]
        words = set(" ".join(own).split())
        if words and sum(map(len, own)) >= 0.1 * sum(len(t) for _, t in page) and all(2 * len(words & w) < len(words | w) for w in kept.values()):
            kept[n] = words
    return set(kept)


def infer(pages: list[str]) -> str:
    """A host's wrapper as JSON.

    nodes: its expression; fixed: template texts by slot; region: where main text is; main: strong names overruled;
    prose: slots under weak names that hold prose of their own on each page.
    """
    parsed = [tokens(p) for p in dict.fromkeys(pages)]
    nodes: list | None = None
    for p in parsed:
        folded = fold(symbols(p))
        nodes = folded if nodes is None else align(nodes, folded)
    spec = {"nodes": nodes or [], "region": "", "fixed": [], "main": [], "prose": []}
    w = Wrapper(json.dumps(spec))
    bound = [(texts(p)[0], w.slots(p)) for p in parsed]
    slotted = [[(slots[x.at], x) for x in seen if not x.gone and slots and slots[x.at] is not None] for seen, slots in bound]
    values: dict[str, list[set[str]]] = {}  # of each slot, its texts on each page that has it
    for page in slotted:
        of: dict[str, set[str]] = {}
        for s, x in page:
            of.setdefault(s, set()).add(x.text)
        for s, found in of.items():
            values.setdefault(s, []).append(found)
    same = {(s, t) for s, pages in values.items() if len(pages) > 1 for t in set.intersection(*pages)}
    mass = Counter()
    for page in slotted:  # the region that holds most text which is not the same everywhere
        for s, x in page:
            if (s, x.text) not in same:
                mass.update({r: len(x.text) for r in {"", *x.inside}})
    spec["region"] = next((r for r in CONTENT if mass[r] >= 0.5 * max(1, mass[""])), "")

    in_region = [[(s, x) for s, x in page if not spec["region"] or spec["region"] in x.inside] for page in slotted]
    held: dict[str, list[str]] = {}
    for page in in_region:
        size = Counter()
        for _, x in page:
            size[x.off] += len(x.text)
        for off, n in size.items():
            if off and n >= 0.8 * size.total():
                held.setdefault(off, []).append("\n".join(x.text for _, x in page if x.off == off))
    spec["main"] = sorted(off for off, own in held.items() if 2 * len(set(own)) > len(parsed) > 1)
    kept = [[(s, x) for s, x in page if not x.off or x.off in spec["main"]] for page in in_region]
    marked = {(s, x.text) for page in kept for s, x in page if x.marked}
    least = 4 if spec["region"] else 2
    fixed = {(s, t) for s, t in same if len(values[s]) >= least and (not spec["region"] or (s, t) in marked)}
    plain = [[(s, x.text) for s, x in page] for page in kept]
    different = _different(plain, fixed)
    spec["fixed"] = sorted((s, t) for s, t in fixed if sum((s, t) in plain[n] for n in different) >= least)
    changing = {s for s, pages in values.items() if len(set(map(frozenset, pages))) > 1}
    spec["prose"] = sorted({s for page in kept for s, x in page if x.weak and s in changing and len(x.text.split()) >= PROSE})
    return json.dumps(spec)


def _frozen(n):
    return n if isinstance(n, str) else (n[0], tuple(_frozen(x) for x in n[1]))


class Wrapper:
    def __init__(self, spec: str | None):
        d = json.loads(spec) if spec else {"nodes": [], "region": "article", "fixed": [], "main": [], "prose": []}
        self.nodes, self.region, self.main, self.prose = [_frozen(n) for n in d["nodes"]], d["region"], frozenset(d["main"]), frozenset(d["prose"])
        self.fixed = {(s, t) for s, t in d["fixed"]}
        self.fixed_texts = {t for _, t in self.fixed}
        self.automaton = Automaton(self.nodes, list(range(len(self.nodes))))

    def slots(self, stream: list[tuple[str, str, str]]) -> list[str | None] | None:
        """The slot of each entry of a page's stream (None: the wrapper has none for it); None if nothing covers the page."""
        at: list[int] = []
        line = symbols(stream, at)
        automaton = self.automaton
        places = automaton.bind(line)
        if places is None:
            source: list[int | None] = []
            nodes = align(self.nodes, fold(line), source)
            automaton = Automaton(nodes, source)
            places = automaton.bind(line)
        return None if places is None else [automaton.slot[places[s]] if s >= 0 else None for s in at]

    def chosen(self, stream: list[tuple[str, str, str]], found: list[Text]) -> list[Text]:
        """The texts whose slots hold main text. Where a page has a slot of its own, its names and elements alone count."""
        regions = {r for x in found for r in x.inside}
        region = self.region if self.region in regions else next((r for r in CONTENT if r in regions), "")
        found = [x for x in found if not x.gone and (not region or region in x.inside) and (not x.off or x.off in self.main)]
        slots = self.slots(stream)
        covered = slots is not None
        slots = slots if covered else [None] * len(stream)
        # a page that nothing covers has no slots: there a template text goes wherever it stands
        template = lambda x: (slots[x.at], x.text) in self.fixed if covered else x.text in self.fixed_texts and (not region or x.marked)
        prose = lambda x: slots[x.at] in self.prose or slots[x.at] is None and len(x.text.split()) >= PROSE
        # what stands in one block with other text (a word in bold, a link) belongs to it
        own = {x.block for x in found if not template(x)}
        words = [x for x in found if x.block in own]
        whole = {x.block for x in words if x.weak and prose(x)}
        return [x for x in words if not x.weak or x.block in whole]

    def text(self, page: str) -> str:
        stream = tokens(page)
        found, block = texts(stream)
        for x in found:
            x.block = block[x.at]
        held: dict[int, list[str]] = {}
        kept = {x.at for x in self.chosen(stream, found)}
        some = {block[i] for i in kept}
        for i, (kind, name, _) in enumerate(stream):
            if block[i] in some and (i in kept or kind == "space" or (kind == "open" and name == "br")):
                held.setdefault(block[i], []).append(name if i in kept else " ")
        lines = (" ".join("".join(parts).split()) for parts in held.values())
        return "\n".join(x for x in lines if x)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_text(pages: DataFrame, samples: int = 12) -> DataFrame:
    """page_id, url and text of every page: its main text, blocks in page order joined by one newline.

    A wrapper is inferred for each host from at most `samples` of its pages: one from each of as many hash classes
    of page_id, the least by hash. The choice is a mergeable minimum, so that no task sees a whole host.
    Null and empty html give an empty text; a null url counts as a host of its own; repeated rows are each
    answered; further columns are not carried.
    """
    ship(pages.sparkSession)
    kinds = dict(pages.dtypes)
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    order = F.xxhash64(F.col("page_id").cast("string"), F.lit(5))
    picked = pages.where("html is not null").groupBy("host", F.pmod(order, F.lit(samples)).alias("class")).agg(F.min(F.struct(order.alias("h"), "page_id")).alias("pick"))
    # as written tables both small sides have a known size, by which Spark broadcasts them or not
    picked = written(picked.select("host", F.col("pick.page_id").alias("page_id")), "picked", few=True)
    chosen = pages.join(picked, ["host", "page_id"]).select("host", "page_id", "html")

    def wrap(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("page_id").to_pylist(), table.column("html").to_pylist()), key=lambda r: (str(r[0]), r[1]))
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([infer([h for _, h in rows])], pa.string())})

    wrappers = written(chosen.groupBy("host").applyInArrow(wrap, "host string, wrapper string"), "wrappers", few=True)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = []
                for page, spec in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    if spec not in known:
                        if len(known) > 500:
                            known.clear()
                        known[spec] = Wrapper(spec)
                    texts.append(known[spec].text(page or ""))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string")
