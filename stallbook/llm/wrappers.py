"""Main text of web pages by wrappers: union-free expressions inferred from the pages of a host."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.urls import host_of
from stallbook.session import written

#: Elements that belong to the text around them.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr""".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it is left out.
RAW = frozenset("script style title textarea iframe noscript noframes xmp template svg math object".split())
#: Elements that end an open paragraph.
ENDS_PARAGRAPH = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split())
#: Elements that end an open one of the same kind, up to the element in the value.
ENDS_OWN = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
#: Elements and words of class, id and role that mark what is not the article.
AROUND = frozenset("nav header footer aside form button select dialog menu head".split())
AROUND_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager
pagination popup promo promoted recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored
subscribe subscription toolbar widget""".split())
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post postbody story".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)""", re.DOTALL)
_HINTS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TEXT = "#"
#: Inline elements whose text belongs to a form.
MUTED = frozenset("label input".split())
#: Different pages that say the same before a text counts as part of the host's template.
SAME_PAGES = 3


@dataclass
class Node:
    """One item of a wrapper: an element or a text slot; `plus`: repeated, `optional`: not on every page.

    mass: characters of text directly in it, over all pages merged. text: hash of a slot's text while it is the same
    wherever it was met, empty once it varies. parts: child lists still to be aligned; one when the node is settled.
    """

    label: str
    parts: list[list[Node]] = field(default_factory=list)
    plus: bool = False
    optional: bool = False
    mass: int = 0
    text: str = ""

    @property
    def children(self) -> list[Node]:
        return self.parts[0] if self.parts else []

    def pack(self) -> list:
        """The nodes in order, each before its children, without nesting."""
        out, left = [], [self]
        while left:
            node = left.pop()
            out.append([node.label, int(node.plus), int(node.optional), node.mass, node.text, len(node.children)])
            left.extend(reversed(node.children))
        return out

    @staticmethod
    def unpack(rows: list) -> Node:
        done: list[Node] = []
        for label, plus, optional, mass, text, n in reversed(rows):
            children = [done.pop() for _ in range(n)]
            done.append(Node(label, [children] if children else [], bool(plus), bool(optional), mass, text))
        return done[0]


def _hash(*parts: str) -> str:
    return blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).hexdigest()


# ---- token streams ----------------------------------------------------------------------------------------------

def _label(name: str, attributes: str) -> str:
    """The element with the words of its attributes that say what it is for."""
    words: set[str] = set()
    if attributes:
        for kind, value in _HINTS.findall(attributes):
            kind, value = kind.lower(), value.strip("\"'")
            if kind == "style":
                words |= {"hidden"} if re.search(r"display\s*:\s*none", value) else set()
            elif kind in ("hidden", "aria-hidden"):
                words |= {"hidden"} if kind == "hidden" or value == "true" else set()
            else:
                words |= {w.lower() for w in _WORDS.findall(value)}
    words &= AROUND_WORDS | MAIN_WORDS | {"hidden"}
    return ".".join([name, *sorted(words)])


@dataclass
class Page:
    """A page as a tree, and flat: per element its place (hash of the labels from the root), its parent, and whether it, or
    one around it, surrounds articles; and the blocks of text with the element each stands in."""

    root: Node
    places: list[str]
    parents: list[int]
    around: list[bool]
    blocks: list[tuple[int, str]]


def read_page(html: str) -> Page:
    """Reads the markup in one pass; the work grows with the page, whatever its depth."""
    page = Page(Node("page", [[]]), [_hash("page")], [-1], [False], [])
    stack, numbers, names, text = [page.root], [0], ["page"], []
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack, by name
    muted: list = []  # an inline element whose text is left out: name, how often it is open, depth around it

    def flush() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            stack[-1].parts[0].append(Node(TEXT, mass=len(block), text=_hash(block)))
            page.blocks.append((numbers[-1], block))

    def close(to: int) -> None:
        flush()
        for name in names[to:]:
            opened[name].pop()
        del stack[to:], numbers[to:], names[to:]
        if muted and len(names) <= muted[2]:
            muted.clear()

    def add(piece: str) -> None:
        if piece and not muted:
            text.append(unescape(piece))  # a reference does not reach across markup

    at, n = 0, len(html)
    while at < n:
        found = _TAG.search(html, at)
        if not found:
            add(html[at:])
            break
        add(html[at:found.start()])
        at = found.end()
        if not found[2]:
            continue
        closing, name, attributes = found[1], found[2].lower(), found[3]
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
        elif name == "br":
            add(" ")
        elif name in INLINE:
            if muted:
                if name == muted[0] and name not in VOID:
                    muted[1] += -1 if closing else 1
                    if not muted[1]:
                        muted.clear()
            elif not closing and name not in VOID and (name in MUTED or is_around(_label(name, attributes))):
                muted += [name, 1, len(names) - 1]
        elif closing:
            if opened[name]:
                close(opened[name][-1])
            else:
                flush()
        else:
            if name in ENDS_PARAGRAPH and opened["p"]:
                close(opened["p"][-1])
            if name in ENDS_OWN and opened[name]:
                own = opened[name][-1]
                if not any(opened[x] and opened[x][-1] > own for x in ENDS_OWN[name].split()):
                    close(own)
            flush()
            if name not in VOID:
                label = _label(name, attributes)
                node = Node(label, [[]])
                stack[-1].parts[0].append(node)
                page.places.append(_hash(page.places[numbers[-1]], label))
                page.parents.append(numbers[-1])
                page.around.append(page.around[numbers[-1]] or is_around(label))
                opened[name].append(len(names))
                stack.append(node)
                numbers.append(len(page.places) - 1)
                names.append(name)
    close(1)
    return page


def is_around(label: str) -> bool:
    name, *words = label.split(".")
    return name in AROUND or "hidden" in words or not AROUND_WORDS.isdisjoint(words)


# ---- inference --------------------------------------------------------------------------------------------------

def _copy(a: Node) -> Node:
    return Node(a.label, [[_copy(x) for x in a.children]] if a.label[0] == "(" else list(a.parts), a.plus, a.optional, a.mass, a.text)


def _absorb(a: Node, b: Node, plus: bool = False) -> Node:
    """a with b merged into it: child lists wait to be aligned, but the fixed items of a group are merged one by one."""
    if a.label[0] == "(":
        for x, y in zip(a.children, b.children, strict=True):
            _absorb(x, y)
    else:
        a.parts += b.parts
    a.plus, a.optional, a.mass = a.plus or b.plus or plus, a.optional or b.optional, a.mass + b.mass
    a.text = a.text if a.text == b.text else ""
    return a


def _merged(a: Node, b: Node, plus: bool = False) -> Node:
    return _absorb(_copy(a), b, plus)


def _repeats(items: list[Node]) -> list[Node]:
    """Runs of one label become a repeated item; a sequence of up to four items that comes again becomes a repeated group."""
    out: list[Node] = []
    grown = None
    for x in items:
        if out and out[-1].label == x.label:
            if out[-1] is not grown:
                grown = out[-1] = _copy(out[-1])
            _absorb(grown, x, True)
        else:
            out.append(x)
        for k in (2, 3, 4):
            if len(out) >= 2 * k and [n.label for n in out[-k:]] == [n.label for n in out[-2 * k:-k]]:
                group = Node("(" + " ".join(n.label for n in out[-k:]) + ")", [[_merged(a, b) for a, b in zip(out[-2 * k:-k], out[-k:], strict=True)]], True)
                del out[-2 * k:]
                if out and out[-1].label == group.label:
                    group = _merged(out.pop(), group, True)
                out.append(group)
                break
            if len(out) > k and out[-k - 1].label == "(" + " ".join(n.label for n in out[-k:]) + ")":
                group = Node(out[-k - 1].label, [[_merged(a, b) for a, b in zip(out[-k - 1].children, out[-k:], strict=True)]], True, out[-k - 1].optional)
                out[-k - 1:] = [group]
                break
    return out


def _single(items: list[Node], groups: Iterable[Node]) -> list[Node]:
    """Items in which one pass through a group of the other side counts as that group."""
    for group in groups:
        wanted = [n.label for n in group.children]
        k, i = len(wanted), 0
        while i + k <= len(items):
            if items[i].label == wanted[0] and [n.label for n in items[i:i + k]] == wanted:
                items = [*items[:i], Node(group.label, [items[i:i + k]], True), *items[i + k:]]
            i += 1
    return items


def _common(xs: list[str], ys: list[str]) -> Iterator[tuple[int, int]]:
    """Places of a longest common sequence, last first; rows of the table are whole numbers, a bit for each x."""
    whole = (1 << len(xs)) - 1
    at: defaultdict[str, int] = defaultdict(int)
    for i, x in enumerate(xs):
        at[x] |= 1 << i
    rows, row = [], whole
    for y in ys:
        hit = row & at[y]
        row = ((row + hit) | (row - hit)) & whole
        rows.append(row)
    i, j = len(xs), len(ys)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                yield i, j


def align(xs: list[Node], ys: list[Node]) -> list[Node]:
    """One expression for two: items that match are merged, the others become optional, and repeats are folded."""
    xs, ys = _single(xs, [y for y in ys if y.label[0] == "("]), _single(ys, [x for x in xs if x.label[0] == "("])
    a = 0
    while a < min(len(xs), len(ys)) and xs[a].label == ys[a].label:
        a += 1
    b = 0
    while b < min(len(xs), len(ys)) - a and xs[-1 - b].label == ys[-1 - b].label:
        b += 1
    mx, my = xs[a:len(xs) - b], ys[a:len(ys) - b]
    maybe = lambda n: Node(n.label, n.parts, n.plus, True, n.mass, n.text)
    middle: list[Node] = []
    i, j = len(mx), len(my)
    for p, q in [*_common([n.label for n in mx], [n.label for n in my]), (-1, -1)]:
        middle += [maybe(n) for n in reversed(my[q + 1:j])] + [maybe(n) for n in reversed(mx[p + 1:i])]
        if p >= 0:
            middle.append(_merged(mx[p], my[q]))
        i, j = p, q
    out = [_merged(x, y) for x, y in zip(xs[:a], ys[:a], strict=True)] + middle[::-1]
    out += [_merged(x, y) for x, y in zip(xs[len(xs) - b:], ys[len(ys) - b:], strict=True)]
    return _repeats(out)


def _one(parts: list[list[Node]]) -> list[Node]:
    """One expression for all child lists.

    Where all lists have the same labels they match item by item. Else repeats are folded, equal layouts are merged item
    by item, and only different ones are aligned.
    """
    for fold in (False, True):
        layouts: dict[tuple[str, ...], list[Node]] = {}
        for part in parts:
            part = _repeats(part) if fold else part
            key = tuple(n.label for n in part)
            if key not in layouts:
                layouts[key] = [_copy(n) for n in part]
            else:
                for x, y in zip(layouts[key], part, strict=True):
                    _absorb(x, y)
        if len(layouts) < 2:
            return next(iter(layouts.values()), [])
    keys = sorted(layouts, key=lambda k: (-len(k), k))
    out = layouts[keys[0]]
    for key in keys[1:]:
        out = align(out, layouts[key])
    return out


def settle(root: Node) -> Node:
    """Aligns what waits in a node and in all below it, from the top down, without recursion."""
    left = [root]
    while left:
        node = left.pop()
        if node.label != TEXT and node.label[0] != "(":
            node.parts = [_one(node.parts)]
        left.extend(node.children)
    return root


def wrapper_of(*pages: Node) -> Node:
    """The wrapper of some pages, or of wrappers."""
    return settle(Node(pages[0].label, [part for p in pages for part in p.parts], False, False, sum(p.mass for p in pages)))


def expression(wrapper: Node) -> str:
    """The wrapper as a regular expression over tags and text slots."""
    order, left = [], [wrapper]
    while left:
        order.append(node := left.pop())
        left.extend(node.children)
    done: dict[int, str] = {}
    for node in reversed(order):
        inner = " ".join(done.pop(id(c)) for c in node.children)
        own = node.label if node.label == TEXT else f"({inner})" if node.label[0] == "(" else f"<{node.label}> {inner} </{node.label.split('.')[0]}>"
        done[id(node)] = f"({own})+" * node.plus + own * (not node.plus) + "?" * node.optional
    return done[id(wrapper)]


# ---- the article in a wrapper -----------------------------------------------------------------------------------

@dataclass
class Rules:
    """What a wrapper says: the places of the article, and the texts (place, hash) that are template."""

    heads: list[str]
    template: list[tuple[str, str]]


def article_rules(wrapper: Node, same: bool) -> Rules:
    """Where the article is. same: enough different pages went in for texts that never vary to be the host's own.

    What varies decides: the outermost article elements with a text slot that varies; without one main elements or
    such as are named like it; else the innermost element around all slots that vary, less the texts in it that are the
    same on every page. Nothing inside or named like a menu, header, footer and so on counts. Where nothing varies, all
    text counts.
    """
    nodes: list[tuple[Node, int, str, str | None, bool]] = []  # node, parent, place, kind, inside of that kind
    left: list[tuple[Node, int, str, frozenset, bool]] = [(wrapper, -1, "", frozenset(), False)]
    while left:
        node, parent, place, inside, maybe = left.pop()
        group = node.label[0] == "("
        maybe = maybe or node.optional
        if node.label == TEXT:
            nodes.append((node, parent, place, None, maybe))
            continue
        if not group and is_around(node.label):
            continue
        here = place if group else _hash(place, node.label) if parent >= 0 else _hash(node.label)
        name, *words = node.label.split(".")
        kind = None if group else "article" if name == "article" else "main" if name == "main" or "main" in words else "named" if not MAIN_WORDS.isdisjoint(words) else None
        nodes.append((node, parent, here, None if kind in inside else kind, maybe))
        at = len(nodes) - 1
        left.extend((c, at, here, inside | {kind} if kind else inside, maybe) for c in reversed(node.children))

    fixed = [same and n.label == TEXT and bool(n.text) and not n.plus and not maybe for n, _, _, _, maybe in nodes]
    if all(f for (n, *_), f in zip(nodes, fixed, strict=True) if n.label == TEXT):
        fixed = [False] * len(nodes)
    mass = [n.mass if n.label == TEXT and not f else 0 for (n, *_), f in zip(nodes, fixed, strict=True)]
    some = [m > 0 for m in mass]
    for at in range(len(nodes) - 1, 0, -1):
        mass[nodes[at][1]] += mass[at]
    for kind in ("article", "main", "named"):
        heads = sorted({place for (_, _, place, own, _), m in zip(nodes, mass, strict=True) if own == kind and m})
        if heads:
            return Rules(heads, [])
    # From the root down as long as one child holds all that varies.
    around: int | None = None
    for at, (node, parent, _, _, _) in enumerate(nodes):
        if mass[at] == mass[0] and node.label != TEXT and (parent < 0 or parent == around):
            around = at
    template = sorted({(place, n.text) for (n, _, place, _, _), f in zip(nodes, fixed, strict=True) if f})
    return Rules([nodes[around][2]] if any(some) and around is not None else [], template)


def article_text(page: Page, rules: Rules) -> str:
    """The blocks below one of the places, in nothing that surrounds an article and not template, one a line."""
    heads, template = set(rules.heads), set(rules.template)
    inside = []
    for place, parent in zip(page.places, page.parents, strict=True):
        inside.append(place in heads or (parent >= 0 and inside[parent]))
    return "\n".join(text for at, text in page.blocks if inside[at] and not page.around[at] and not (template and (page.places[at], _hash(text)) in template))


# ---- on Spark ---------------------------------------------------------------------------------------------------

#: Wrappers of a host that are aligned together.
TOGETHER = 64
SALTS = 32


class _Host:
    """Pages and wrappers of one host on their way to one wrapper, and up to SAME_PAGES hashes of different pages."""

    def __init__(self) -> None:
        self.waiting: list[Node] = []
        self.seen: set[str] = set()

    def add(self, node: Node, seen: Iterable[str]) -> None:
        self.waiting.append(node)
        self.seen = set(sorted(self.seen | set(seen))[:SAME_PAGES])
        if len(self.waiting) >= TOGETHER:
            self.waiting = [wrapper_of(*self.waiting)]

    def row(self, host: str | None, salt: int) -> tuple:
        return host, salt, json.dumps(wrapper_of(*self.waiting).pack()), sorted(self.seen)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    host, salt, wrapper, seen = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(salt, pa.int32()), pa.array(wrapper, pa.string()), pa.array(seen, pa.list_(pa.string()))],
                                      ["host", "salt", "wrapper", "seen"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, seen) from (host, html): every page of a host takes part.

    Each task aligns its pages into one wrapper a host, so what is shuffled is small even for a host with a third of
    all pages; these are aligned in SALTS groups a host, and the groups then into one.
    """
    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: defaultdict[str | None, _Host] = defaultdict(_Host)
        salt = 0
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                hosts[host].add(wrapper_of(read_page(html).root), [_hash(html)])
                salt = (salt * 31 + len(html)) % SALTS
        for host, found in hosts.items():
            yield _batch([found.row(host, salt)])

    def of_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, None
        for b in batches:
            for host, salt, wrapper, seen in zip(*(b.column(c).to_pylist() for c in ("host", "salt", "wrapper", "seen")), strict=True):
                if found is None or key != (host, salt):
                    if found is not None:
                        yield _batch([found.row(*key)])
                    key, found = (host, salt), _Host()
                found.add(Node.unpack(json.loads(wrapper)), seen)
        if found is not None:
            yield _batch([found.row(*key)])

    schema = "host string, salt int, wrapper string, seen array<string>"
    rows = pages.select("host", "html").where("html is not null").mapInArrow(of_pages, schema)
    rows = rows.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(of_wrappers, schema)
    rows = rows.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(of_wrappers, schema)
    return rows.select("host", "wrapper", "seen")


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page: the article found by the wrapper of its host.

    Blocks of the article in page order, one a line; inside a block white space is one space and character references
    are decoded, piece by piece between tags. Inline parts that are hidden, adverts or labels of forms are left out
    like blocks of that kind. Where a page has nothing at the wrapper's place (another layout), the wrapper of the page
    alone decides. Null and empty pages have an empty text, as have pages without text outside of menus and the like. Pages
    with a null URL or one without a host form one group. Copies of a page count once in what varies, and are returned
    as often as they come; an empty table gives no rows; other columns are not read. Pages may nest as deep as they like.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [article_rules(Node.unpack(json.loads(w)), len(s) >= SAME_PAGES) for w, s in zip(b.column("wrapper").to_pylist(), b.column("seen").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([json.dumps([r.heads, r.template]) for r in found], pa.string())], ["host", "rules"])

    # A written table has a known size: the join sends it to the tasks if it is small, and else deals both sides.
    found = written(infer_wrappers(rows).mapInArrow(places, "host string, rules string"), "wrappers")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, rules in zip(b.column("html").to_pylist(), b.column("rules").to_pylist(), strict=True):
                page = read_page(source or "")
                heads, template = json.loads(rules or "[[], []]")
                out.append(article_text(page, Rules(heads, [tuple(x) for x in template]))
                           or article_text(page, article_rules(wrapper_of(page.root), False)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    joined = rows.join(found, "host", "left").select(F.col("page_id").cast("long"), "url", "html", "rules")
    return joined.mapInArrow(texts, "page_id long, url string, text string")
