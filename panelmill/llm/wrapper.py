"""Main text of web pages by wrappers: union-free expressions inferred from all pages of a host."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import shuffle_partitions, slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^<>]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag on the left ends an open element on the right, unless one of the scopes stands between.
_ENDS_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption html body option optgroup".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("article aside body div footer header html main nav ol section table td th ul dl form".split())
#: What is never main text: by tag, by role, and by a word of class or id.
_CHROME_TAGS = frozenset("nav header footer aside form script style noscript template button select textarea iframe svg title head dialog menu object canvas video audio input".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_CHROME_WORDS = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|header|footer|sidebar|side|aside|ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|"
    r"popup|modal|overlay|newsletter|subscribe|social|share|sharing|related|recommend\w*|breadcrumb\w*|pagination|pager|comment\w*|disqus|respond|replies|widget|skip|login|search|form)(?:$|[-_\s])", re.I)
#: Below this depth the tree is flat: texts and breaks between blocks hang on the element at this depth, chrome stays told apart.
DEPTH = 150
MANY = 2
#: Elements that lay out a page; one without class, id and role is told from its neighbours by what it holds.
_BARE = frozenset("div section center".split())
_LAYOUT = _BARE | frozenset("html body main article table tbody tr td".split())
_PROSE = frozenset("p pre blockquote dl table ul ol h3 h4 h5 h6".split())
#: Share of a level's varying text that one element must hold to be where the main text lies.
DECISIVE = 0.6


class Node:
    """An element: ``sig`` is tag, class, id and role; children are elements and texts; ``key`` adds what a bare one holds."""

    __slots__ = ("sig", "key", "children")

    def __init__(self, sig: str):
        self.sig, self.key, self.children = sig, sig, []


def _signature(tag: str, attributes: str) -> str:
    if not attributes or tag not in _BLOCK and tag != "span":
        return tag
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    return f"{tag}|" + "|".join(re.sub(r"\d+", "N", " ".join(found.get(k, "").split())) for k in ("class", "id", "role")) if found else tag


def parse(page: str) -> Node:
    """The page's token stream, bracketed into elements; tags that are left open end where HTML lets them."""
    root = Node("")
    stack = [root]

    hidden = None   # place in the stack of the outermost chrome below DEPTH

    def close(k: int) -> None:
        nonlocal hidden
        if len(stack) > DEPTH and any(n.sig.partition("|")[0] in _BLOCK for n in stack[max(k, DEPTH):]):
            stack[DEPTH - 1].children.append(Node("hr"))
        del stack[k:]
        hidden = None if hidden is not None and hidden >= k else hidden

    def add(child: Node | str) -> None:
        if hidden is not None:
            around = Node(stack[hidden].sig)
            around.children.append(child)
            child = around
        stack[min(len(stack), DEPTH) - 1].children.append(child)

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                add(m[0])
            continue
        tag = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k].sig.partition("|")[0]
                if open_tag == tag:
                    close(k)
                    break
                if open_tag in _SCOPES and tag not in _SCOPES:
                    break
            continue
        ends = _ENDS.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            open_tag = stack[k].sig.partition("|")[0]
            if open_tag in ends or open_tag == "p" and tag in _ENDS_P:
                close(k)
                break
            if open_tag in _SCOPES and not (ends and open_tag in ("td", "th") and tag in ("tr", "td", "th")):
                break
        node = Node(_signature(tag, m[3]))
        opens = tag not in _RAW and tag not in _VOID and not m[3].rstrip().endswith("/")
        if len(stack) < DEPTH or not opens:
            add(node)
        elif tag in _BLOCK:
            add(Node("hr"))
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node.children.append("")
            at = end.end() if end else len(page)
        elif opens:
            stack.append(node)
            if hidden is None and len(stack) > DEPTH and chrome(node.sig):
                hidden = len(stack) - 1
    _hold(root)
    return root


def _hold(node: Node) -> tuple[bool, bool, bool]:
    """Signs bare elements by what they hold: links only (a), text (t) or blocks with text (b); returns (text, text that is no link, blocks)."""
    text = plain = blocks = False
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                text = plain = True
        else:
            has, is_plain, inner = _hold(c)
            text, plain = text or has, plain or is_plain
            blocks = blocks or has and (inner or c.sig.partition("|")[0] in _BLOCK)
    if node.sig in _BARE and text:
        node.key = f"{node.sig}:{'a' if not plain else 'b' if blocks else 't'}"
    return text, plain and node.sig.partition("|")[0] != "a", blocks


# -- wrappers: [sig, least, most, children]; "#" is a text slot, "()" a group; least 0 is optional, most MANY repeats


def _merge_nodes(a: list, b: list) -> list:
    return [a[0], min(a[1], b[1]), max(a[2], b[2]), merge(a[3], b[3])]


def _optional(n: list) -> list:
    return [n[0], 0, n[2], n[3]]


def _key(n: list) -> str:
    return n[0] if n[0] != "()" else "(" + " ".join(_key(c) for c in n[3]) + ")"


def fold(nodes: list[list]) -> list[list]:
    """Repeats side by side become one node or group that repeats; two bare elements with blocks are no repeat as yet."""
    out: list[list] = []
    for key, run in groupby(nodes, _key):
        same = list(run)
        if key.endswith(":b") and len(same) == 2:
            out += same
            continue
        first, *more = same
        for n in more:
            first = [n[0], 1, MANY, merge(first[3], n[3])]
        out.append(first)
    for period in (2, 3, 4):
        keys, i, folded = [_key(n) for n in out], 0, []
        while i < len(out):
            j = i + period
            body = out[i:j]
            while len(body) == period and keys[i:i + period] == keys[j:j + period]:
                body = [_merge_nodes(x, y) for x, y in zip(body, out[j:j + period])]
                j += period
            if j > i + period:
                folded.append(["()", 1, MANY, body])
                i = j
            else:
                folded.append(out[i])
                i += 1
        out = folded
    return out


def _grouped(nodes: list[list], other: list[list]) -> list[list]:
    """Once what ``other`` has as a repeated group becomes that group as well."""
    for g in other:
        if g[0] == "()":
            body = [_key(n) for n in g[3]]
            keys = [_key(n) for n in nodes]
            for i in range(len(nodes) - len(body) + 1):
                if keys[i:i + len(body)] == body:
                    nodes = [*nodes[:i], ["()", 1, 1, nodes[i:i + len(body)]], *nodes[i + len(body):]]
                    break
    return nodes


def longest_common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; rows of the table are bits of one integer, so no length is too long."""
    bits: dict[str, int] = {}
    for j, k in enumerate(y):
        bits[k] = bits.get(k, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, row = [], full
    for k in x:
        hit = row & bits.get(k, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def merge(a: list[list], b: list[list]) -> list[list]:
    """One expression for what either matches: aligned nodes are merged, the mismatched become optional."""
    if a == b:
        return a
    a, b = _grouped(a, b), _grouped(b, a)
    x, y = [_key(n) for n in a], [_key(n) for n in b]
    pairs = longest_common(x, y)
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [_optional(n) for n in a[i:p]] + [_optional(n) for n in b[j:q]]
        if p < len(a):
            out.append(_merge_nodes(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold_optional(out)


def fold_optional(nodes: list[list]) -> list[list]:
    """Neighbours of one signature are one node that repeats; it stays optional only if all of them were."""
    out: list[list] = []
    for n in nodes:
        if out and _key(out[-1]) == _key(n) and not (n[0].endswith(":b") and n[1] and out[-1][1]):
            out[-1] = [n[0], max(out[-1][1], n[1]), MANY, merge(out[-1][3], n[3])]
        else:
            out.append(n)
    return out


def skeleton(node: Node) -> list[list]:
    """The expression of a single page: elements, text slots and folded repeats."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            if c.strip() and not (out and out[-1][0] == "#"):
                out.append(["#", 1, 1, []])
        else:
            out.append([c.key, 1, 1, skeleton(c)])
    return fold(out)


def chrome(sig: str) -> bool:
    """Signs of chrome in tag, class, id or role."""
    tag, _, rest = sig.partition("|")
    if tag in _CHROME_TAGS:
        return True
    if not rest or tag in ("body", "html", "main", "article"):
        return False
    name, ident, role = (rest.split("|") + ["", ""])[:3]
    return role.lower() in _CHROME_ROLES or bool(_CHROME_WORDS.search(name) or _CHROME_WORDS.search(ident))


def main(sig: str) -> bool:
    """Signs of a main container."""
    tag, _, rest = sig.partition("|")
    return tag in ("article", "main") or rest.endswith("|main")


class Place:
    """A node of a wrapper; groups are dissolved into their parts. ``ident`` counts places from the front."""

    __slots__ = ("key", "ident", "many", "kids", "at", "role", "mass", "pages", "kinds")

    def __init__(self, key: str, ident: int, many: bool):
        self.key, self.ident, self.many, self.kids, self.at, self.role = key, ident, many, [], {}, "body"
        self.mass = self.pages = self.kinds = 0

    @property
    def tag(self) -> str:
        return self.key.partition("|")[0].partition(":")[0]

    def match(self, children: list) -> list[Place | None]:
        """The place of each child of an element that has this place; texts have none."""
        keys = [None if isinstance(c, str) else c.key for c in children]
        found = [self.kids[self.at[k][0]] if k in self.at and len(self.at[k]) == 1 else None for k in keys]
        unsure = [i for i, k in enumerate(keys) if k in self.at and len(self.at[k]) > 1]
        if unsure:
            known = [i for i, k in enumerate(keys) if k in self.at]
            pairs = {known[i]: j for i, j in longest_common([keys[i] for i in known], [p.key for p in self.kids])}
            last = -1
            for i in known:
                if i in pairs:
                    last = pairs[i]
                elif not (last >= 0 and self.kids[last].key == keys[i] and self.kids[last].many):
                    last = next((j for j in self.at[keys[i]] if j > last), self.at[keys[i]][-1])
                if i in unsure or i in pairs:
                    found[i] = self.kids[last]
        return found


def places(wrapper: list[list]) -> Place:
    """The wrapper's places below a root; equal wrappers give equal numbers."""
    count = 0

    def grow(into: Place, nodes: list[list], many: bool) -> None:
        nonlocal count
        for n in nodes:
            if n[0] == "()":
                grow(into, n[3], True)
            elif n[0] != "#":
                count += 1
                p = Place(n[0], count, many or n[2] > 1)
                grow(p, n[3], False)
                into.at.setdefault(p.key, []).append(len(into.kids))
                into.kids.append(p)

    root = Place("", 0, False)
    grow(root, wrapper, False)
    return root


def slots(page: str, root: Place) -> dict[int, str]:
    """Text that is no link, by the place of the block it stands in."""
    out: dict[int, list[str]] = {}

    def walk(node: Node, place: Place, block: int) -> None:
        for c, p in zip(node.children, place.match(node.children)):
            if isinstance(c, str):
                if c.strip():
                    out.setdefault(block, []).append(c)
            elif p is not None and p.tag != "a":
                walk(c, p, p.ident if p.tag in _BLOCK else block)

    walk(parse(page), root, 0)
    return {k: " ".join("".join(v).split()) for k, v in out.items()}


def roles(wrapper: list[list], seen: list[tuple[int, int, int, int]]) -> list:
    """What each place of a wrapper is, as [key, role, many, places below]; role is chrome, main or body.

    ``seen`` has for each place the characters of its different texts on the host's pages, the number of pages, and that of
    different texts. Text that pages share counts once, so from the root down the main text lies in the element that holds
    most (``DECISIVE``) of a level's varying text; all beside it is chrome, and so are menus of links and, inside, short
    blocks with the same text on nearly all of five or more pages. Signs in tag, class, id and role rule elements out, and
    point to the main text only where no element of a level is decisive. Then the body is kept, less its chrome.
    """
    root = places(wrapper)
    nodes = {n.ident: n for n in _all(root)}
    for ident, mass, pages, kinds in seen:
        nodes[ident].mass, nodes[ident].pages, nodes[ident].kinds = mass, pages, kinds
    forms = dict(zip((n.ident for n in _all(root)), _forms(wrapper)))

    def total(p: Place) -> int:
        return 0 if p.role == "chrome" else p.mass + sum(total(k) for k in p.kids)

    def mark(p: Place, role: str) -> None:
        for n in _all(p):
            n.role = role if n.role != "chrome" else "chrome"

    for n in nodes.values():
        if n.ident and (chrome(n.key) or n.tag in ("ul", "ol", "div") and _only_links(forms[n.ident]) and _repeats(forms[n.ident])):
            n.role = "chrome"
    at = root
    while True:
        below = [k for k in at.kids if k.role != "chrome"]
        whole = total(at)
        prose = sum(total(k) for k in below if k.tag in _PROSE or k.tag not in _BLOCK) + at.mass
        title = any(k.tag in ("h1", "h2") and 2 * k.kinds > k.pages for k in below)
        best = max(below, key=total, default=None)
        if not title and 10 * prose < whole and best.tag in _LAYOUT and not best.many and total(best) >= DECISIVE * whole:
            at = best
            continue
        break
    marked = [k for k in below if main(k.key)]
    if marked and not title and 10 * prose < whole:
        for k in marked:
            mark(k, "main")
    elif at.tag not in ("", "html", "body"):
        mark(at, "main")
    inside = [n for n in nodes.values() if n.role == "main"]
    if any(2 * n.kinds > n.pages for n in inside):
        for n in inside:
            if n.pages >= 5 and 5 * n.kinds <= n.pages and n.tag in _BARE | {"p"} and not n.many and not n.kids:
                n.role = "chrome"
    return _pack(root)


def _all(p: Place) -> Iterator[Place]:
    yield p
    for k in p.kids:
        yield from _all(k)


def _forms(wrapper: list[list], top: bool = True) -> Iterator[list]:
    """Nodes of the wrapper in the order of its places."""
    if top:
        yield ["", 1, 1, wrapper]
    for n in wrapper:
        if n[0] not in ("#", "()"):
            yield n
        yield from _forms(n[3], False)


def _pack(p: Place) -> list:
    """Places below one whose roles are all its own need not be told apart."""
    alike = all(n.role == p.role for n in _all(p)) and p.role != "body" or p.role == "chrome"
    return [p.key, p.role, int(p.many), [] if alike else [_pack(k) for k in p.kids]]


def unpack(tree: list) -> Place:
    """The places that ``roles`` told apart."""
    p = Place(tree[0], 0, bool(tree[2]))
    p.role = tree[1]
    for t in tree[3]:
        p.at.setdefault(t[0], []).append(len(p.kids))
        p.kids.append(unpack(t))
    return p


def _only_links(n: list, link: bool = False) -> bool:
    link = link or n[0] == "a"
    return all(link if c[0] == "#" else _only_links(c, link) for c in n[3])


def _repeats(n: list) -> bool:
    return any(c[2] > 1 and (c[0] == "a" or _has_link(c)) or _repeats(c) for c in n[3])


def _has_link(n: list) -> bool:
    return any(c[0] == "a" or _has_link(c) for c in n[3])


def extract(page: str, root: Place | None) -> str:
    """The page's main text: what its wrapper's main places hold, or where the page has none, its body without chrome.

    Blocks are joined by a line break; inside one, references are decoded and white space (a ``br`` as well) is one blank.
    Without a wrapper all text is kept.
    """
    blocks: list[tuple[bool, str]] = []
    held: list[str] = []

    def flush(is_main: bool) -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append((is_main, text))

    def walk(node: Node, place: Place | None, is_main: bool) -> None:
        for c, p in zip(node.children, place.match(node.children) if place and place.kids else [None] * len(node.children)):
            if isinstance(c, str):
                held.append(c)
                continue
            tag = c.sig.partition("|")[0]
            role = p.role if p else "main" if is_main else "body"
            if tag == "br":
                held.append(" ")
            block = tag in _BLOCK or role == "main" and not is_main
            if block:
                flush(is_main)
            if role != "chrome":
                walk(c, p, role == "main")
            if block:
                flush(role == "main")

    walk(parse(page), root, False)
    flush(False)
    some = any(m for m, _ in blocks)
    return "\n".join(t for m, t in blocks if m or not some)


def host_of(url) -> F.Column:
    """Host of a url column in lower case; empty where there is none."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.lower(F.coalesce(rest, F.lit("")))


def _fold_rows(frame: DataFrame, partitions: int, salted: bool) -> DataFrame:
    """Merge the expressions of each (host, salt), one at a time; a task holds one expression."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper, last = None, None, None
        for batch in batches:
            for host, salt, text in zip(*[c.to_pylist() for c in batch.columns[:3]]):
                if now != (host, salt):
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([json.dumps(wrapper)])], names=["host", "wrapper"])
                    now, wrapper, last = (host, salt), json.loads(text), text
                elif text != last:
                    wrapper, last = merge(wrapper, json.loads(text)), text
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([json.dumps(wrapper)])], names=["host", "wrapper"])

    salt = F.pmod(F.xxhash64("wrapper"), F.lit(32)) if salted else F.lit(0).cast("long")
    rows = frame.select("host", salt.alias("salt"), "wrapper")
    return rows.repartition(partitions, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(run, "host string, wrapper string")


def infer(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): for every host the union-free expression of all its pages, as JSON.

    A page becomes an expression in its task and equal ones of a host count once, which leaves few rows whatever the size
    of a host. Those are aligned one after the other within 32 salted parts of a host, and the parts' wrappers once more.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                seen = sorted({(h, json.dumps(skeleton(parse(p or "")))) for h, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist())})
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string())], names=["host", "wrapper"])

    frame = pages.select(host_of(F.col(url)).alias("host"), F.col(page).cast("string").alias("page"))
    partitions = shuffle_partitions(pages.sparkSession)
    single = frame.mapInArrow(run, "host string, wrapper string").distinct()
    return _fold_rows(_fold_rows(single, partitions, True), partitions, False)


def _met(pages: DataFrame, wrappers: DataFrame, url: str, page: str, keep: tuple[str, ...], what: str) -> DataFrame:
    """Pages beside ``what`` of their host, in a join of whole tables on the host, whose hot hosts AQE can split."""
    told = wrappers.select(F.col("host").alias("__host"), F.col(what).alias("__told"))
    rows = pages.select(F.col(page).cast("string").alias("__page"), F.col(url).alias("url"), *keep, host_of(F.col(url)).alias("__own"))
    return rows.join(told, rows["__own"] == told["__host"], "left")


def place_roles(pages: DataFrame, wrappers: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, roles): every page is read through its host's wrapper, texts are counted by place, and ``roles`` decides.

    Texts are digested and counted in the tasks before they are shuffled; what is left of a host is one row for a place.
    """
    kind = pa.schema([("host", pa.string()), ("place", pa.int64()), ("digest", pa.int64()), ("chars", pa.int64()), ("pages", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Place] = {}
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                seen: dict[tuple, list[int]] = {}
                for p, w, host in zip(*[c.to_pylist() for c in part.columns]):
                    if w not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[w] = places(json.loads(w))
                    for place, text in slots(p or "", known[w]).items():
                        row = seen.setdefault((host, place, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)), [len(text), 0])
                        row[1] += 1
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (*k, *v))) for k, v in seen.items()], schema=kind)

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, forms, seen = (c.to_pylist() for c in batch.columns)
            told = [json.dumps(roles(json.loads(w), [(r["place"], r["mass"], r["pages"], r["kinds"]) for r in s or []])) for w, s in zip(forms, seen)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(told, pa.string())], names=["host", "roles"])

    met = _met(pages, wrappers, url, page, (), "wrapper").select("__page", "__told", "__own")
    texts = met.mapInArrow(count, "host string, place long, digest long, chars long, pages long").groupBy("host", "place", "digest").agg(F.max("chars").alias("chars"), F.sum("pages").alias("pages"))
    sums = texts.groupBy("host", "place").agg(F.sum("chars").alias("mass"), F.sum("pages").alias("pages"), F.count("*").alias("kinds"))
    lists = sums.groupBy("host").agg(F.collect_list(F.struct("place", "mass", "pages", "kinds")).alias("seen"))
    return wrappers.join(lists, "host", "left").select("host", "wrapper", "seen").mapInArrow(decide, "host string, roles string")


def main_text(pages: DataFrame, url: str = "url", page: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, url, text and n_chars (code points) of every page, read through its host's wrapper.

    Null or empty html, and a page without main text, give an empty text. Pages without a host share one wrapper. Repeated
    rows each get a result, an empty table gives an empty result.
    """
    told = settle(place_roles(pages, settle(infer(pages, url, page)), url, page))
    met = _met(pages, told, url, page, keep, "roles").select("__page", "__told", "url", *keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Place | None] = {}
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                texts = []
                for p, w in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if w not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[w] = unpack(json.loads(w)) if w else None
                    texts.append(extract(p, known[w]) if p else "")
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*part.schema.names[2:], "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema[2:])
    return met.mapInArrow(run, f"{kinds}, text string, n_chars long")
