"""Main text of web pages by wrappers that are inferred for each host.

A wrapper is a union-free regular expression over the tokens of a host's pages, kept as a nested list:
elements, each mandatory, optional ``( )?`` or repeated ``( )+``, and texts, each fixed or a slot. A page is a
wrapper without any of these; two wrappers are aligned sequence by sequence (longest common subsequence of
their elements): where texts differ the text becomes a slot, where one side lacks an element it
becomes optional, where equal elements follow each other they become one repeated group. A
sequence that alternates for long becomes a repeated group of optional elements. So a wrapper's size depends
on the template and not on the pages, and aligning is done in any order: all pages of a partition
first, host by host, then the parts in two steps; a hot host is one small part per partition.

A page is read along its host's expression, element by element. What varies over the host's pages and isn't links is
prose; what is the same on all pages (of which ``FIXED_PAGES`` must differ, as copies are no evidence of a template) or is
mostly links is template. The article is the marked container (``article``, ``main``, usual names) if the expression shows
enough of the host's prose in it (``TRUST``), else the whole body without the template. Menus, adverts, forms, reader comments and
the like are containers that go by tag, role and name. Names that may as well mean parts of an article (``_UNSURE``), and
names of paragraphs, headings and other texts, only count where the expression shows template; names inside a line never do.

Defined results: a null page is an empty one and has the empty text. Pages without a host (null or odd
addresses) share the host ''. Pages that fit no container of their host are taken by the second rule.
Rows are pages: repeated or null ids stay. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkveil.functions.lineage import written

PARTS = 64
LONGEST = 24
FIXED_PAGES = 3
#: Longer texts stand in the expression as their length and a digest.
FIXED_CHARS = 300
#: Share of the host's prose that a marked container must hold, by how surely it is one (named, ``main``, ``article``).
TRUST = (0.5, 0.25, 0.1)
HOSTS_HELD = 2000
#: Longer names of an element are reduced in its key.
NAME_CHARS = 100
#: Elements nested deeper are read as siblings; their texts stay.
DEPTH = 120
BROADCAST_BYTES = 32 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input fieldset iframe object svg canvas audio video map dialog menu".split())
#: Names of classes, ids and roles that mark what is not the article, and what is.
_OTHER = frozenset(
    "ad ads adbox adsense adslot advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright "
    "dialog disqus footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promotion recommendations recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
#: Of these, names that parts of articles have too.
_UNSURE = frozenset("header related replies reply respond".split())
#: Elements that hold a text and not a part of the page.
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption dl dt dd table tbody thead tfoot tr td th caption summary".split())
_MAIN = frozenset("article articlebody articletext content entry main maincontent maintext post postbody postcontent story storybody".split())
_ABOUT = frozenset("has with no without overflow".split())
#: An element's start ends these open ones.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("html body div article section main ul ol dl table tr td th nav aside header footer form blockquote".split())
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")


class Node:
    """An element of a page, or of a wrapper: then with ``opt`` and ``rep``, and what its pages hold."""

    __slots__ = ("key", "chars", "items", "links", "opt", "pages", "prose", "rep")

    def __init__(self, key: str, items=None, opt=False, rep=False, pages=1, chars=0, links=0):
        self.key, self.items, self.opt, self.rep = key, items if items is not None else [], opt, rep
        self.pages, self.chars, self.links, self.prose = pages, chars, links, 0

    def plain(self) -> list:
        return [self.key, int(self.opt), int(self.rep), self.pages, self.chars, self.links, [x.plain() if isinstance(x, Node) else x for x in self.items]]

    @staticmethod
    def of(plain: list) -> Node:
        key, opt, rep, pages, chars, links, items = plain
        return Node(key, [Node.of(x) if isinstance(x, list) else x for x in items], bool(opt), bool(rep), pages, chars, links)


# Texts in a sequence are strings; a slot is None.


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.beyond = 0

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            self._end(_CLOSES[tag])
        elif tag not in _INLINE:
            self._end(("p",))
        node = Node(_key(tag, dict(attrs)))
        self.open[-1].items.append(node)
        if tag in _VOID:
            return
        if len(self.open) < DEPTH:
            self.open.append(node)
        else:
            self.beyond += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.beyond:
            self.beyond -= 1
            return
        for i in range(len(self.open) - 1, 0, -1):
            if _tag(self.open[i].key) == tag:
                del self.open[i:]
                return

    def _end(self, tags):
        """Close the nearest of ``tags`` unless a container lies between."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = _tag(self.open[i].key)
            if tag in tags:
                del self.open[i:]
                return
            if tag in _SCOPES:
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


def _tag(key: str) -> str:
    return key.partition(".")[0]


def _key(tag: str, attrs: dict) -> str:
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return f"{tag}.hidden"
    names = " ".join(filter(None, (attrs.get("class"), attrs.get("id"), attrs.get("role"), attrs.get("itemprop"))))
    names = re.sub(r"\d+", "0", _CAMEL.sub("-", names)).lower()
    if len(names) > NAME_CHARS:
        names = _short(names)
    return f"{tag}.{names}" if names else tag


@functools.lru_cache(1 << 14)
def _short(names: str) -> str:
    """Long names as the marker words among them and a number, which holds no word, that tells them apart."""
    number = int.from_bytes(hashlib.blake2b(names.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
    return " ".join((*sorted(_named(f".{names}") & (_OTHER | _MAIN)), str(number)))


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _ignored(key: str) -> bool:
    return _tag(key) in ("script", "style", "noscript", "template", "head", "br", "svg")


def page_wrapper(node: Node, linked: bool = False) -> Node:
    """The wrapper of one page: no inline elements, texts folded, neighbours of one kind grouped."""
    items, chars, links = [], 0, 0
    for x in _inlined(node, linked or _tag(node.key) == "a"):
        if isinstance(x, Node):
            sub = page_wrapper(x)
            chars, links = chars + sub.chars, links + sub.links
            items.append(sub)
        else:
            text, is_link = x
            text = " ".join(text.split())
            if text:
                chars, links = chars + len(text), links + len(text) * is_link
                if items and not isinstance(items[-1], Node):
                    items[-1] = None
                else:
                    items.append(_said(text))
    return Node(node.key, _grouped(items), chars=chars, links=links)


def _said(text: str) -> str:
    """A text as it stands in an expression."""
    if len(text) <= FIXED_CHARS:
        return text
    return f"\0{len(text)} {hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def _length(said: str) -> int:
    return int(said[1:].partition(" ")[0]) if said.startswith("\0") else len(said)


def _inlined(node: Node, linked: bool) -> Iterator:
    """The block elements and texts below; inline elements are opened (a stack, as pages may nest deeply)."""
    stack = [(iter(node.items), linked)]
    while stack:
        x = next(stack[-1][0], None)
        if x is None:
            stack.pop()
        elif not isinstance(x, Node):
            yield x, stack[-1][1]
        elif _tag(x.key) in _INLINE and not _hidden(x.key):
            stack.append((iter(x.items), stack[-1][1] or _tag(x.key) == "a"))
        elif not _ignored(x.key):
            yield x


def _grouped(items: list) -> list:
    """Neighbours with the same key become one repeated group; long alternations too."""
    out: list = []
    for x in items:
        if out and isinstance(x, Node) and isinstance(out[-1], Node) and out[-1].key == x.key:
            out[-1] = _merged(out[-1], x, same_page=True)
        else:
            out.append(x)
    if len(out) <= LONGEST:
        return out
    kinds: dict[str, Node] = {}
    for x in out:
        if isinstance(x, Node):
            kinds[x.key] = _merged(kinds[x.key], x, same_page=True) if x.key in kinds else x
            kinds[x.key].opt = kinds[x.key].rep = True
    return [None] * any(not isinstance(x, Node) for x in out) + list(kinds.values())


def _merged(a: Node, b: Node, same_page: bool = False) -> Node:
    pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    items = aligned(a.items, b.items)
    return Node(a.key, items, a.opt or b.opt, a.rep or b.rep or same_page, pages, a.chars + b.chars, a.links + b.links)


def _kind(x) -> str:
    return x.key if isinstance(x, Node) else "#"


def aligned(a: list, b: list) -> list:
    """One sequence for two: common elements merge, the others become optional, differing texts slots."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _kind(a[i]) == _kind(b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and _kind(a[i]) == _kind(b[j]):
            x, y = a[i], b[j]
            out.append(_merged(x, y) if isinstance(x, Node) else x if x == y else None)
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return _grouped([x for k, x in enumerate(out) if isinstance(x, Node) or k == 0 or isinstance(out[k - 1], Node)])


def _optional(x):
    if isinstance(x, Node):
        x.opt = True
        return x
    return None


@functools.lru_cache(1 << 14)
def _named(key: str) -> frozenset:
    """The words of an element's names, and each name without its separators; not of names like ``has-sidebar`` or ``overflow-hidden``."""
    split = [re.split("[^a-z]+", name) for name in key.partition(".")[2].split()]
    return frozenset(w for words in split if not _ABOUT & set(words) for w in (*words, "".join(words)) if w)


def _marks_main(key: str) -> int:
    """How surely an element is the article's container: 0 not at all."""
    tag, names = _tag(key), _named(key)
    if names & _OTHER:
        return 0
    return 3 if tag == "article" or "articlebody" in names else 2 if tag == "main" or "main" in names else 1 if names & _MAIN and tag not in _INLINE and tag not in ("html", "body") else 0


def _hidden(key: str) -> bool:
    return key.endswith(".hidden")


def _unwanted(key: str, inside: bool, holds_main: bool, template: bool) -> bool:
    """``template``: the host's expression shows that the element has the same text on all pages, or links for the most part."""
    tag = _tag(key)
    if tag in _DROPPED or _hidden(key) or (tag == "header" and not inside and not _named(key) & _MAIN):
        return True
    if holds_main or tag in ("html", "body") or tag in _INLINE:
        return False
    other = _named(key) & _OTHER
    return bool(other) and (template or (tag not in _TEXTS and bool(other - _UNSURE)))


class Wrapper:
    """What the host's regular expression says about its pages: paths are keys from the top, joined by ``>``."""

    def __init__(self, root: Node, contents: int):
        self.grade, self.fixed, self.link_groups, self.template = 0, set(), set(), set()
        self.pages, self.enough = root.pages, contents >= FIXED_PAGES
        self._weigh(root, True)
        self.held = [0, 0, 0]
        self.total = 0
        self._learn(root, "", False, True, False)
        for grade in (3, 2, 1):
            if self.held[grade - 1] and self.held[grade - 1] >= TRUST[grade - 1] * self.total:
                self.grade = grade
                break

    def _weigh(self, node: Node, always: bool) -> int:
        """Sets ``prose``: characters of all pages that are no links and not the same everywhere."""
        always = always and not node.opt and node.pages == self.pages
        own, own_links, same = node.chars, node.links, 0
        node.prose = 0
        for x in node.items:
            if isinstance(x, Node):
                own, own_links = own - x.chars, own_links - x.links
                node.prose += self._weigh(x, always)
            elif x is not None and self.enough and node.pages >= FIXED_PAGES and always:
                same += _length(x) * node.pages
        node.prose += max(0, own - max(own_links, same))
        return node.prose

    def _learn(self, node: Node, path: str, out: bool, always: bool, marked: bool) -> None:
        """``always``: the element is on all pages. ``marked``: a container holds it."""
        always = always and not node.opt and node.pages == self.pages
        for x in node.items:
            if isinstance(x, Node):
                at, mark = f"{path}>{x.key}", _marks_main(x.key)
                if x.chars and (2 * x.links > x.chars or (self.enough and 10 * x.prose < x.chars)):
                    self.template.add(at)
                gone = out or (not mark and _unwanted(x.key, marked, _holds_main(x), at in self.template))
                if not gone:
                    # A container must hold text, so an empty marked one does not hide the article.
                    if mark and x.chars:
                        self.held[mark - 1] += max(1, x.prose)
                    if x.chars and 2 * x.links > x.chars and not _has_paragraph(x):
                        self.link_groups.add(at)
                self._learn(x, at, gone, always, marked or bool(mark))
            elif x is not None and always and self.enough and not node.rep:
                self.fixed.add((path, x))
        if not out:
            inner = sum(x.prose for x in node.items if isinstance(x, Node))
            self.total += node.prose - inner


def _has_paragraph(node: Node) -> bool:
    return any(isinstance(x, Node) and _tag(x.key) == "p" and x.chars and 2 * x.links <= x.chars for x in node.items)


def _holds_main(node: Node) -> bool:
    return any(isinstance(x, Node) and (_marks_main(x.key) >= 2 or _holds_main(x)) for x in node.items)


@functools.lru_cache(256)
def _wrapper(plain: str) -> Wrapper:
    contents, root = json.loads(plain)
    return Wrapper(Node.of(root), contents)


def extract(html: str | None, wrapper: Wrapper) -> str:
    root = parse(html)
    blocks: list[str] = []
    if wrapper.grade:
        _walk(root, "", wrapper, False, blocks)
    if not blocks:
        _walk(root, "", wrapper, None, blocks)
    return "\n".join(blocks)


def _walk(node: Node, path: str, wrapper: Wrapper, inside: bool | None, blocks: list[str]) -> None:
    """Collect blocks; ``inside`` the marked container, or None if there is none to look for."""
    held: list[str] = []

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text and inside is not False and not (inside is None and (path, _said(text)) in wrapper.fixed):
            blocks.append(text)

    stack = [iter(node.items)]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
        elif not isinstance(x, Node):
            held.append(x)
        elif _tag(x.key) == "br":
            held.append(" ")
        else:
            line = _tag(x.key) in _INLINE
            at = path if line else f"{path}>{x.key}"
            if _unwanted(x.key, bool(inside), inside is not True and not line and _holds_main(x), not line and at in wrapper.template):
                if not line:
                    flush()
            elif line:
                stack.append(iter(x.items))
            else:
                flush()
                if inside is None and at in wrapper.link_groups and _linked(x):
                    continue
                _walk(x, at, wrapper, inside if inside is not False else _marks_main(x.key) == wrapper.grade, blocks)
    flush()


def _linked(node: Node) -> bool:
    own = page_wrapper(node)
    return 2 * own.links > own.chars


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of a partition's pages, host by host; written out early if there are many hosts."""
    held: dict[str, Node] = {}

    def batch_of() -> pa.RecordBatch:
        plain = [json.dumps(n.plain(), ensure_ascii=False, separators=(",", ":")) for n in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(plain, pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = page_wrapper(parse(html.as_py()))
            held[host] = _merged(held[host], own) if host in held else own
            if len(held) >= HOSTS_HELD:
                yield batch_of()
                held.clear()
    if held:
        yield batch_of()


def _united(frame: pd.DataFrame) -> pd.DataFrame:
    found = None
    for plain in sorted(frame["wrapper"]):
        own = Node.of(json.loads(plain))
        found = own if found is None else _merged(found, own)
    plain = json.dumps(found.plain(), ensure_ascii=False, separators=(",", ":"))
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [plain]})


def infer(pages: DataFrame) -> DataFrame:
    """``host`` and ``wrapper`` of ``pages`` (``host``, ``html``), from all of them, written.

    A wrapper is a JSON array: how many different pages the host has, and the expression.
    """
    contents = pages.select("host", F.xxhash64("html").alias("content")).distinct().groupBy("host").agg(F.count("*").alias("contents"))
    parts = written(pages.select("host", "html").mapInArrow(_partial, "host string, wrapper string"))
    some = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    some = some.groupBy("host", "part").applyInPandas(_united, "host string, wrapper string")
    whole = some.groupBy("host").applyInPandas(_united, "host string, wrapper string")
    return written(whole.join(contents, "host").select("host", F.format_string("[%d,%s]", "contents", "wrapper").alias("wrapper")))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = zip(batch.column("html"), batch.column("wrapper"), strict=True)
        texts = [extract(html.as_py(), _wrapper(wrapper.as_py())) for html, wrapper in pages]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: id, address, main text and its length in code points."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(page).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"), host.alias("host"))
    wrappers = infer(rows)
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host")
    found = joined.select("page_id", "url", "html", "wrapper").mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
    return found.withColumnsRenamed({"page_id": page, "url": url})
