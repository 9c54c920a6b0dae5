"""HTML extraction by wrapper induction.

A page's text comes in units, a paragraph, a list, a table or a run of text each, that lie in boxes
of its DOM tree.  Box trees are aligned by simple tree matching: boxes of one key match, in the order
of siblings, so that as many boxes as possible and as many equal units as possible do.

Of each host up to REFERENCES pages of different layout, those of the least hashes, are references.
All pages of the host are aligned with each reference, and it is counted how many have a box of it,
and how many of these have each unit of it: among all pages, and among those of the reference's own
layout (the same boxes).  Units that all such pages have in a box are template; what varies is
content, of which each page gives its own.  A page that no other resembles loses nothing.

Which pages are references depends on the pages' hashes alone, and counts are sums, so the order and
the partitions of the pages make no difference; and what is held of a host is its references'
size, however many pages it has.

Never article, by tag: menus, footers, asides, scripts, forms and the like; a form that holds the page's
article, or most of its text, loses its controls only.  Of the content, boxes
whose whole name says advert, notice, comments and the like go if they are small against the page or
stand beside its article.  A constant heading between two parts of the content stays.

A box counts if two different pages have it at least.  On two or
three pages that says little: such text is dropped only from a page of which more is left than
dropped.  A page of nothing but template keeps it.

What moves: hashes, 16 for each host and task; references; and counts, one for each box and unit of
a task's references.  References are broadcast while they are small and joined by a shuffle
otherwise.  Pages stay where they are.

Defined results: a null or empty html gives an empty text; a null URL counts as a host of its own
name; repeated rows are extracted one by one, and copies of one page alone make no template; extra columns don't matter; html is
read whole.  Boxes more than 40 deep count as their ancestor's part, and beyond 64 runs of siblings
order doesn't count: neither drops text.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaloom.sources.durable import Tables
from qaloom.llm.url_filter import parts

REFERENCES = 16  # pages of a host that its others are compared with, of different layout each
SURE_PAGES = 4  # so many pages that agree are enough to drop what is most of a page
MOST_BROADCAST = 8 << 20  # characters of templates that are broadcast
HELD = 2_000_000  # counts that a task holds before it sends them on
ALIGNED_DEPTH = 40  # deeper boxes count as their ancestor's part
ORDERED_KIDS = 64  # runs of siblings that are aligned in order

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody tr td th figure b i em strong a span br".split())
BOXES = frozenset("div section article main table".split())
DROPPED = frozenset("script style noscript template nav footer aside button select textarea input label legend datalist option iframe svg canvas object menu dialog head title noembed noframes".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert banner popup modal "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead toolbar pagination pager search comment comments disqus respond replies "
    "share sharing social related recommended newsletter subscribe subscription contentinfo complementary dialog skip".split()
)
#: Words that, beside a dropped one, only say where or what kind of box it is: main-menu, ad-box, cookie-bar.
QUALIFIERS = frozenset("main site page top bottom left right primary secondary global box widget area block bar list links buttons form".split())
NEVER_LISTED = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())
SMALL, SMALL_BOX = 10, 3  # a listed node goes if its text is a tenth of the page's; a third if it has no paragraphs
_CLOSED_BY = {  # a start tag closes an open element of these tags, up to a boundary
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
_P_BOUNDARY = ("td", "th", "table", "button", "object", "caption")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_QUOTED = re.compile(r"""\"[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"""(?:^|[\s/"'])hidden(?=[\s=/]|$)""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("boxes", "gone", "key", "kids", "listed", "prose", "size", "skip", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids = tag, []
        said = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if "=" in attrs else {}
        named = f"{said.get('class', '')} {said.get('id', '')}".lower()
        self.key = f"{tag}.{' '.join(sorted(set(_WORD.findall(named))))}"
        hidden = "display:none" in said.get("style", "").replace(" ", "").lower() or said.get("aria-hidden") == "true" or ("hidden" in attrs.lower() and _HIDDEN.search(_QUOTED.sub('""', attrs)) is not None)
        self.skip = tag in DROPPED or hidden
        self.listed = bool(said) and tag not in NEVER_LISTED and any(map(_names_a_box, f"{named} {said.get('role', '')}".lower().split()))
        self.size, self.prose, self.boxes, self.gone = 0, False, False, False


def _names_a_box(token: str) -> bool:
    """Whether a whole class, id or role is a dropped word, alone or with others and qualifiers."""
    words = set(_WORD.findall(token))
    return not DROPPED_WORDS.isdisjoint(words) and words <= DROPPED_WORDS | QUALIFIERS


def judge(root: Node) -> Node:
    """Mark listed nodes that are small against the page, and those beside its article that have no paragraphs or aren't most of it."""
    order: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    for node, _, inside in order:  # grows as it is walked; parents come first
        order.extend((x, node, inside or node.tag in ("article", "main")) for x in node.kids if not isinstance(x, str) and not x.skip)
    holds: set[int] = set()
    for node, parent, _ in reversed(order):
        node.size += sum(len(x.strip()) for x in node.kids if isinstance(x, str))
        node.prose |= node.tag == "p" and node.size > 0
        if parent:
            parent.size += node.size
            parent.prose |= node.prose
            parent.boxes |= node.boxes or node.tag in BOXES
            if node.size and (node.tag in ("article", "main") or id(node) in holds):
                holds.add(id(parent))
    total = root.size
    declared = id(root) in holds
    for node, _, inside in order:
        node.skip |= node.tag == "form" and id(node) not in holds and node.size * 2 <= total
        if node.listed and id(node) not in holds:
            small = node.size * SMALL <= total or (not node.prose and node.size * SMALL_BOX <= total)
            node.gone = small or (declared and not inside and (not node.prose or node.size * 2 <= total))
    return root


def parse(text: str) -> Node:
    """The DOM tree of a page, however it is nested; text nodes are decoded strings."""
    root = Node("#root")
    stack, at, n = [root], 0, len(text)
    last_quote = max(text.rfind('"'), text.rfind("'"))

    def close(tags: tuple[str, ...], boundary: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in boundary:
                return

    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].kids.append(entities.unescape(text[at:lt]))
        if lt == n:
            break
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if text[lt + 1 : lt + 2] in ("!", "?"):
            end = text.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(text, lt + 1)
        if not name:
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        rest = _REST.match(text, name.end()) if last_quote > lt else None
        end = rest.end() if rest else text.find(">", name.end()) + 1
        if end <= 0:
            break  # a tag that the page doesn't end
        tag, attrs, at = name[0].lower(), text[name.end() : end - 1], end
        if tag[0] == "/":
            tag = tag[1:]
            if tag not in VOID:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            continue
        if tag in _CLOSED_BY:
            close(*_CLOSED_BY[tag])
        if tag in BLOCKS:
            close(("p",), _P_BOUNDARY)
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            found = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            if not found:
                break
            at = text.find(">", found.start()) + 1 or n
        elif tag not in VOID:
            stack.append(node)
    return root


def _has_heading(node: Node) -> bool:
    todo = [node]
    while todo:
        for x in todo.pop().kids:
            if not isinstance(x, str):
                if x.tag in ("h1", "h2"):
                    return True
                todo.append(x)
    return False


class Box:
    """A box of a page or, merged, of many: ``n`` pages have it, and all of these the units of ``same`` in it.

    ``lo`` and ``hi`` are the least and greatest hash of such a page: equal if it is one page again and again.
    """

    __slots__ = ("hi", "key", "kids", "lo", "n", "same")

    def __init__(self, key: str, n: int = 1, lo: int = 0, hi: int = 0, same: Sequence[int] = (), kids: Sequence[list] = ()):
        self.key, self.n, self.lo, self.hi, self.same = key, n, lo, hi, set(same)
        self.kids = [Box(*x) for x in kids]

    def packed(self) -> list:
        return [self.key, self.n, self.lo, self.hi, sorted(self.same), [x.packed() for x in self.kids]]


class Unit:
    """Text blocks that belong together, the box around them, and whether a name tells that they are no article."""

    __slots__ = ("box", "gone", "heading", "mark", "texts")

    def __init__(self, box: Box, key: str, gone: bool):
        self.box, self.mark, self.gone, self.texts = box, key, gone, []
        self.heading = key[:1] == "h" and key[1:2].isdigit()


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def units(top: Node) -> tuple[Box, list[Unit]]:
    """The boxes below a node that hold text, and its text by units, in order.

    A paragraph, list, table and the like is one unit, unless it holds boxes; so is a run of text beside them.
    Neighbours of one key are one box: a list of cards is a box of all their units.
    """
    out: list[Unit] = []
    held: list[str] = []
    root = Box(top.key)
    boxes = [root]
    gone = 0  # open nodes that a name tells to be no article
    whole = 0  # the depth at which a unit of several blocks is open
    last: dict[int, str] = {}  # by box, the key of the child seen last

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                if not whole:
                    out.append(Unit(boxes[-1], "", gone > 0))
                out[-1].texts.append(text)
            held.clear()

    todo: list[tuple[Node, Iterator]] = [(top, iter(top.kids))]
    while todo:
        node, kids = todo[-1]
        for x in kids:
            if isinstance(x, str):
                held.append(x)
                continue
            block = x.tag in BLOCKS
            if x.skip or (x.tag == "header" and not (_within(todo) and _has_heading(x))):
                if block:
                    flush()
                continue
            if x.tag in ("br", "td", "th", "img", "wbr"):
                held.append("" if x.tag == "wbr" else " ")
            if block or x.gone:
                flush()
            todo.append((x, iter(x.kids)))
            gone += x.gone
            one = block and not whole and x.tag in PROSE and not x.boxes
            here = boxes[-1]
            if block and not whole and not one and len(boxes) < ALIGNED_DEPTH:
                if last.get(id(here)) != x.key:
                    here.kids.append(Box(x.key))
                    last[id(here)] = x.key
                here = here.kids[-1]
            boxes.append(here)
            if one:
                whole = len(todo)
                out.append(Unit(here, x.key, gone > 0))
            break
        else:
            if node.tag in BLOCKS or node.gone or len(todo) == 1:
                flush()
            elif node.tag in ("td", "th"):
                held.append(" ")
            if len(todo) == whole:
                whole = 0
            gone -= node.gone
            todo.pop()
            boxes.pop()
    out = [x for x in out if x.texts]
    for x in out:
        x.mark = _hash(x.mark + "\n" + "\n".join(x.texts))
        x.box.same.add(x.mark)
    into: dict[int, Box] = {}
    _prune(root, into)
    for x in out:
        x.box = into.get(id(x.box), x.box)
    return root, out


def _prune(box: Box, into: dict[int, Box]) -> bool:
    """Take boxes without text away; whether one is left.  ``into``: boxes that became part of another one."""
    if len(box.kids) > ORDERED_KIDS:  # order no longer counts: one key, one box
        first: dict[str, Box] = {}
        for x in box.kids:
            y = first.setdefault(x.key, x)
            if x is not y:
                y.same |= x.same
                y.kids += x.kids
                into[id(x)] = y
        box.kids = list(first.values())
    box.kids = [x for x in box.kids if _prune(x, into)]
    return bool(box.same or box.kids)


def _within(todo: list[tuple[Node, Iterator]]) -> bool:
    return any(node.tag in ("article", "main") for node, _ in todo)


def read(page: str) -> tuple[Box, list[Unit]]:
    """A page's boxes, each with the hash of the page, and its units."""
    root, found = units(judge(parse(page)))
    own = _hash(",".join(str(u.mark) for u in found))
    todo = [root]
    while todo:
        box = todo.pop()
        box.lo = box.hi = own
        todo += box.kids
    return root, found


def match(a: Box, b: Box, known: dict) -> int:
    """Simple tree matching: how many boxes and equal units two trees share in order; ``known`` gets the pairs of children."""
    if a.key != b.key:
        return 0
    score = 1 + len(a.same & b.same)
    if not a.kids or not b.kids:
        known[id(a), id(b)] = []
        return score
    if max(len(a.kids), len(b.kids)) > ORDERED_KIDS:
        of = {}
        for x in b.kids:
            of.setdefault(x.key, x)
        pairs, met = [], set()
        for x in a.kids:
            if x.key in of and x.key not in met:
                met.add(x.key)
                pairs.append((x, of[x.key]))
                score += match(x, of[x.key], known)
        known[id(a), id(b)] = pairs
        return score
    each = [[match(x, y, known) for y in b.kids] for x in a.kids]
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, row in enumerate(each):
        for j, w in enumerate(row):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
    pairs, i, j = [], len(a.kids), len(b.kids)
    while i and j:
        w = each[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            pairs.append((a.kids[i], b.kids[j]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    known[id(a), id(b)] = pairs[::-1]
    return score + best[-1][-1]


def layout(box: Box) -> int:
    """The hash of a tree's boxes."""

    def paths(x: Box) -> str:
        return f"{x.key}({','.join(map(paths, x.kids))})"

    return _hash(paths(box)) or 1


class Tally:
    """A reference's boxes and units, and how many of the pages that it is compared with have each.

    A slot for each box, with the least and greatest hash of such a page, and for each of its units;
    all of it twice: for all pages, and for those of the reference's layout.
    """

    def __init__(self, tree: Box, kind: int):
        self.tree, self.kind, self.slots = tree, kind, {}
        todo, n = [tree], 0
        while todo:
            box = todo.pop()
            self.slots[id(box)] = n, {mark: n + 2 + 2 * k for k, mark in enumerate(sorted(box.same))}
            n += 2 + 2 * len(box.same)
            todo += box.kids
        self.n = np.zeros(n, np.int64)
        self.lo, self.hi = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)

    def add(self, page: Box, kind: int) -> None:
        known: dict = {}
        match(self.tree, page, known)
        todo = [(self.tree, page)] if self.tree.key == page.key else []
        own = page.lo
        while todo:
            x, y = todo.pop()
            box, marks = self.slots[id(x)]
            for slot in (box, box + 1)[: 1 + (kind == self.kind)]:
                self.lo[slot], self.hi[slot] = min(self.lo[slot], own), max(self.hi[slot], own)
            for at in (box, *[marks[m] for m in x.same & y.same]):
                self.n[at] += 1
                self.n[at + 1] += kind == self.kind
            todo += known.get((id(x), id(y)), [])

    def template(self, own: int) -> Box:
        """The reference with the units that all pages have which have the box, of all pages (0) or of its layout (1)."""

        def one(box: Box) -> Box:
            at, marks = self.slots[id(box)]
            n = int(self.n[at + own])
            out = Box(box.key, n, int(self.lo[at + own]), int(self.hi[at + own]), [m for m, k in marks.items() if n and self.n[k + own] == n])
            out.kids = [one(x) for x in box.kids]
            return out

        return one(self.tree)

    def templates(self) -> list[tuple[int, Box]]:
        return [(0, self.template(0)), (self.kind, self.template(1))]


def induce(pages: Sequence[str]) -> list[tuple[int, Box]]:
    """(layout, tree) of pages of one host; layout 0 is for all of them."""
    trees = [read(p)[0] for p in pages]
    first: dict[int, Box] = {}
    for _, tree in sorted({_hash(p): t for p, t in zip(pages, trees, strict=True)}.items())[:REFERENCES]:
        first.setdefault(layout(tree), Box(*tree.packed()))
    tallies = [Tally(tree, kind) for kind, tree in first.items()]
    for tree in trees:
        for t in tallies:
            t.add(tree, layout(tree))
    return [x for t in tallies for x in t.templates()]


def extract(page: str | None, wrapper: Sequence[tuple[int, Box]] = ()) -> str:
    """A page's text: its units but for its host's template and for what a name tells to be no article."""
    if not page:
        return ""
    root, found = read(page)
    own = layout(root)
    sure: set[tuple[int, int]] = set()
    weak: set[tuple[int, int]] = set()
    for kind, template in wrapper:
        if kind in (0, own):
            known: dict = {}
            match(template, root, known)
            todo = [(template, root)] if template.key == root.key else []
            while todo:
                x, y = todo.pop()
                if x.lo < x.hi:
                    (sure if x.n >= SURE_PAGES else weak).update((id(y), mark) for mark in x.same)
                todo += known.get((id(x), id(y)), [])
    said = [u for u in found if not u.gone]
    for template in (sure | weak, sure):
        left = _varying(said, template)
        kept, most = (sum(len(t) for u in us for t in u.texts) for us in (left, said))
        if 2 * kept > most or (kept and template.isdisjoint(weak)):
            return _joined(left)
    return _joined(said)


def _varying(said: list[Unit], template: set[tuple[int, int]]) -> list[Unit]:
    """Units that aren't template, and headings between two of them in one box."""
    fresh = [(id(u.box), u.mark) not in template for u in said]
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for k, u in enumerate(said):
        if fresh[k]:
            first.setdefault(id(u.box), k)
            last[id(u.box)] = k
    return [u for k, u in enumerate(said) if fresh[k] or (u.heading and first.get(id(u.box), k) < k < last.get(id(u.box), k))]


def _joined(found: list[Unit]) -> str:
    return "\n\n".join(t for u in found for t in u.texts)


COUNTS = "host string, layout long, slot int, n long, lo long, hi long"


def _tree(text: str) -> Box:
    return Box(*json.loads(text))


def _known(held: dict, host: str | None, rows: pa.ListScalar) -> list[Tally]:
    if host not in held:
        held[host] = [Tally(_tree(x["tree"]), x["layout"]) for x in rows.as_py() or ()]
    return held[host]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, layout, tree) of pages (host, hash, html)."""
    for batch in batches:
        trees = [read(x.as_py())[0] for x in batch.column(2)]
        cols = [batch.column(0), batch.column(1), pa.array(map(layout, trees), pa.int64()), pa.array([json.dumps(t.packed(), separators=(",", ":")) for t in trees], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["host", "hash", "layout", "tree"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages (host, html, references) have of their host's references, summed up over the task."""
    held: dict[str | None, list[Tally]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for host, tallies in held.items():
            for t in tallies:
                at = np.flatnonzero(t.n)
                cols = [pa.array([host] * len(at), pa.string()), pa.array(np.full(len(at), t.kind)), pa.array(at.astype(np.int32)), pa.array(t.n[at]), pa.array(t.lo[at]), pa.array(t.hi[at])]
                yield pa.RecordBatch.from_arrays(cols, names=["host", "layout", "slot", "n", "lo", "hi"])
        held.clear()

    size = 0
    for batch in batches:
        for host, html, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if host not in held:
                size += sum(len(t.n) for t in _known(held, host, found))
            page = read(html.as_py())[0]
            kind = layout(page)
            for t in _known(held, host, found):
                t.add(page, kind)
            if size >= HELD:
                yield from rows()
                size = 0
    yield from rows()


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, layout, tree) of templates, from references (host, layout, tree) with their counts."""
    for batch in batches:
        out = []
        for host, kind, tree, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            t = Tally(_tree(tree), kind)
            for x in counts.as_py():
                t.n[x["slot"]], t.lo[x["slot"]], t.hi[x["slot"]] = x["n"], x["lo"], x["hi"]
            out += [(host, k, json.dumps(box.packed(), separators=(",", ":"))) for k, box in t.templates()]
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["host", "layout", "tree"])


def _small(df: DataFrame, size: str) -> DataFrame:
    """Broadcast, if its characters together are few."""
    held = df.agg(F.sum(F.expr(size))).first()[0] or 0
    return F.broadcast(df) if held <= MOST_BROADCAST else df


def _trees_of(rows: DataFrame, name: str) -> DataFrame:
    """(_host, name): all trees of a host, 2 * REFERENCES at most."""
    return rows.groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct("layout", "tree")).alias(name))


def templates(pages: DataFrame) -> DataFrame:
    """(_host, wrapper): templates by layout of each host of pages (host, html)."""
    tables = Tables(pages.sparkSession)
    each = pages.where("html <> ''").select("host", "html", F.xxhash64("html").alias("hash"))
    least = Window.partitionBy("host").orderBy("hash")  # of many pages a task sends the least hashes only
    chosen = each.select("host", "hash").withColumn("_nth", F.dense_rank().over(least)).where(F.col("_nth") <= REFERENCES).select("host", "hash").distinct()
    chosen = tables.save(chosen)
    wanted = _small(chosen.select(F.col("host").alias("_h"), F.col("hash").alias("_x")), "length(_h) + 8")
    found = each.join(wanted, F.col("host").eqNullSafe(F.col("_h")) & (F.col("hash") == F.col("_x"))).select("host", "hash", "html").dropDuplicates(["host", "hash"])
    one = Window.partitionBy("host", "layout").orderBy("hash")  # REFERENCES rows of a host at most
    parsed = found.mapInArrow(_parsed, "host string, hash long, layout long, tree string")
    references = tables.save(parsed.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select("host", "layout", "tree"))
    given = _small(_trees_of(references, "references"), "aggregate(references, 0L, (a, x) -> a + length(x.tree))")
    counted = each.join(given, F.col("host") == F.col("_host")).select("host", "html", "references").mapInArrow(_counted, COUNTS)
    sums = counted.groupBy("host", "layout", "slot").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by_reference = sums.groupBy(F.col("host").alias("_h"), F.col("layout").alias("_l")).agg(F.collect_list(F.struct("slot", "n", "lo", "hi")).alias("counts"))  # as many as the reference has boxes and units, twice
    both = references.join(by_reference, (F.col("host") == F.col("_h")) & (F.col("layout") == F.col("_l"))).select("host", "layout", "tree", "counts")
    made = tables.save(_trees_of(both.mapInArrow(_made, "host string, layout long, tree string"), "wrapper"))
    tables.drop(chosen, references)
    return made


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: id, url, text (blocks joined by two newlines) and n_chars (code points)."""
    url = F.col(f"`{url_col}`").cast("string")
    pages = df.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    pages = pages.withColumn("host", parts(F.col("url"))[0])
    found = _small(templates(pages), "aggregate(wrapper, 0L, (a, x) -> a + length(x.tree))")
    joined = pages.join(found, F.col("host") == F.col("_host"), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, Box]]] = {}
        for batch in batches:
            texts = []
            for html, host, wrapper in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[host] = [(x["layout"], _tree(x["tree"])) for x in wrapper.as_py() or ()]
                texts.append(extract(html.as_py(), known[host]))
            counts = pa.array(np.array([len(t) for t in texts], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=["id", "url", "text", "n_chars"])

    kind = dict(df.dtypes)[id_col]
    out = joined.select("id", "url", "html", "host", "wrapper").mapInArrow(work, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
