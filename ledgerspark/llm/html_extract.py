"""Operator 1, main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching (Yang 1991) with one
reference page of the host, the one with the smallest hash, and the texts of
each aligned text node are counted. These counts tell constant nodes
(template) from varying slots (content): a text that fills the same node on
``TEMPLATE_SHARE`` of a host's different pages, of which there must be
``TEMPLATE_PAGES`` at least, is template, and is dropped at that node only.
Counting takes one row per node and distinct page, not per pair of pages, and
never gathers a host's pages in one task.

Slots lie in regions. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts and reader comments often vary from page to page too, so slots
in regions with such a role (tag, ARIA role, class or id) are no content, and
if the page has article or main regions, only slots in them are, in page order.
A class or id never drops the only main region. ``header`` in an article is
kept, as it holds the headline.

Contract cases: null and empty pages give an empty text; a null url, or one
without a host, is a host of its own; broken or unclosed markup is read as
far as it goes, in time linear in the page but for the alignment of siblings,
which has a bound; repeated rows count once for the template.
"""

from __future__ import annotations

import html as entities
import marshal
import re
import zlib
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, small_side, written

#: Different pages that a host must have, and the share of them that must hold a text at the same node, for a template.
TEMPLATE_PAGES = 8
TEMPLATE_SHARE = 0.5

# HTML element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe noembed noframes".split())
CHROME = set("nav footer aside form script style noscript template svg iframe button select textarea title head dialog menu object canvas math datalist option label fieldset legend audio video map".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = set("ul ol dl table select body html article section div main aside nav header footer form td th".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
CHROME_WORDS = set(
    "nav navbar navigation menu submenu topbar breadcrumb breadcrumbs footer sidebar sidebars rail widget widgets ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices popup modal overlay comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup "
    "login pagination pager masthead skip toolbar search searchform tags taboola outbrain copyright legal".split()
)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)")
_ATTR = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
_VALUE = re.compile(r"\"[^\"]*+\"|'[^']*+'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")
_LETTERS = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
#: Class names with such a part say what an element has, not what it is.
BESIDE = {"has", "with", "no", "without", "hide", "main"}
#: Tags whose quotes have no end that are looked at to the end of the page; the rest of the page's tags end at the next ``>``.
OPEN_QUOTES = 16
#: Depth of the block tree; blocks below it are aligned in page order under their ancestor of that depth.
DEPTH = 40
#: Children times children up to which siblings are aligned by dynamic programming; beyond it, the k-th of a shape meets the k-th.
CELLS = 250_000
_MASK = (1 << 64) - 1


class Node:
    __slots__ = ("tag", "kids", "chrome", "main")

    def __init__(self, tag: str, chrome: int = 0, main: bool = False):
        self.tag, self.kids, self.chrome, self.main = tag, [], chrome, main


def _is_chrome_name(value: str) -> bool:
    """Whether one of the class or id names stands for chrome."""
    for name in value.split():
        parts = _LETTERS.findall(name)
        if not CHROME_WORDS.isdisjoint(parts) and BESIDE.isdisjoint(parts):
            return True
    return False


def _role(tag: str, attrs: str, inside_main: bool) -> tuple[int, bool]:
    """(chrome: 0 no, 1 by tag or role, 2 by class or id; is a main region) of an element."""
    main = tag in ("article", "main")
    chrome = int(tag in CHROME or (tag == "header" and not inside_main))
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                if not chrome and tag not in ("html", "body", "article", "main") and _is_chrome_name(value):
                    chrome = 2
            elif name == "role":
                main = main or value in ("main", "article")
                chrome = 1 if value in ROLES else chrome
            elif name == "itemprop" and value == "articlebody":
                main = True
            elif name == "aria-hidden" and value == "true":
                chrome = 1
    if attrs and "hidden" in attrs and _HIDDEN.search(_VALUE.sub("", attrs)):
        chrome = 1
    return chrome, main and not chrome


class _Open:
    """The open elements, with the places of each tag, so that no end tag has to search them."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.mains = [root], {}, [0], 0

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.mains += node.main
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()
            self.mains -= node.main


def parse(page: str) -> Node:
    """A forgiving tree in time linear in the page: implied ends of p, li, table cells; stray ends are ignored; text kids are str.

    A tag without ``>`` ends the page; one whose quotes have no end stops at
    the next ``>``.
    """
    root = Node("#root")
    held, pos, failed, closers = _Open(root), 0, 0, {}
    end, last = len(page), page.rfind(">")
    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            held.stack[-1].kids.append(page[pos:])
            break
        if lt > pos:
            held.stack[-1].kids.append(page[pos:lt])
        if page.startswith("<!--", lt):
            pos = _COMMENT.match(page, lt).end()
            continue
        if page[lt + 1 : lt + 2] in ("!", "?") and lt < last:
            pos = page.index(">", lt) + 1
            continue
        m = _NAME.match(page, lt + 1)
        if m is None:
            held.stack[-1].kids.append("<")
            pos = lt + 1
            continue
        if m.end() > last:
            break
        quoted = _QUOTED.match(page, m.end()) if failed < OPEN_QUOTES else None
        failed += quoted is None
        stop = quoted.end() if quoted else page.index(">", m.end())
        attrs, pos, tag = page[m.end() : stop], stop + 1, m[2].lower()
        if m[1]:
            place = held.last((tag,))
            if place and (tag not in INLINE or place > held.blocks[-1]):
                held.close(place)
            continue
        if tag in CLOSES_P:
            place = held.last(("p",))
            if place and place == held.blocks[-1]:
                held.close(place)
        if tag in SAME:
            place = held.last(SAME[tag])
            if place and place >= held.last(SCOPE):
                held.close(place)
        node = Node(tag, *_role(tag, attrs, held.mains > 0))
        held.stack[-1].kids.append(node)
        if attrs.rstrip().endswith("/") or tag in VOID:
            continue
        if tag in RAW:
            if tag not in closers or 0 <= closers[tag][0] < pos:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                closers[tag] = (close.start(), close.end()) if close else (-1, end)
            pos = closers[tag][1]
            continue
        held.push(node)
    return root


def _clean(text: str) -> str:
    return _BLANK.sub(" ", entities.unescape(text)).strip()


def _regions(root: Node, names: bool) -> list[Node]:
    """The outermost main regions outside chrome, in page order; ``names``: chrome by class or id does not count."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.main:
            found.append(node)
            continue
        todo.extend(k for k in reversed(node.kids) if type(k) is Node and (not k.chrome or names and k.chrome == 2))
    return found


def _step(parent: int, tag: str, nth: int) -> int:
    """The key of the nth child with a tag."""
    x = ((parent ^ zlib.crc32(tag.encode(errors="replace"))) * 0x9E3779B97F4A7C15 + nth) & _MASK
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & _MASK
    return x ^ (x >> 32)


def blocks(root: Node) -> tuple[list[str], list]:
    """The texts of the page's slots in page order, and their tree.

    A block is the text between two block-level tags; inline tags leave no
    mark and a line break is white space. A node of the tree is [tag, children,
    numbers of its blocks, key, depth], and has a block below it.
    """
    out: list[str] = []
    tree: list = ["#", [], [], 1, 0]
    run: list = []

    def flush(line):
        if run:
            text = _clean("".join(run))
            run.clear()
            if text:
                line[-1][2].append(len(out))
                out.append(text)

    for regions in (_regions(root, False) or _regions(root, True), [root]):
        for region in regions:
            # an explicit stack, as unclosed tags can nest deeper than Python's own
            frames = [(region, iter(region.kids), tree, {})]
            while frames:
                node, kids, at, seen = frames[-1]
                for k in kids:
                    if type(k) is str:
                        run.append(k)
                    elif k.chrome:
                        if k.tag not in INLINE:
                            flush((at,))
                    elif k.tag == "br":
                        run.append(" ")
                    elif k.tag in INLINE:
                        frames.append((k, iter(k.kids), at, seen))
                        break
                    else:
                        flush((at,))
                        below = at
                        if at[4] < DEPTH:
                            nth = seen[k.tag] = seen.get(k.tag, 0) + 1
                            below = [k.tag, [], [], _step(at[3], k.tag, nth), at[4] + 1]
                            at[1].append(below)
                        frames.append((k, iter(k.kids), below, {}))
                        break
                else:
                    frames.pop()
                    if node.tag not in INLINE:
                        flush((at,))
            flush((tree,))
        if out:
            break
    return out, _skeleton(tree)


def _skeleton(tree: list) -> tuple:
    """(tag, children, numbers of blocks, key, shape) of the tree without nodes that have no block; its depth is bounded."""
    kids = [x for x in map(_skeleton, tree[1]) if x[1] or x[2]]
    shape = zlib.crc32(tree[0].encode(errors="replace"))
    for k in kids:
        shape = _step(shape, "", k[4])
    return (tree[0], kids, tree[2], tree[3], _step(shape, "#", len(tree[2])))


def _aligned(x: list, y: list, memo: dict) -> list[tuple[int, int]]:
    """Pairs of places of two lists of siblings, in order, with the greatest sum of matches."""
    lo, n, m = 0, len(x), len(y)
    while lo < min(n, m) and x[lo][4] == y[lo][4]:
        lo += 1
    while min(n, m) > lo and x[n - 1][4] == y[m - 1][4]:
        n, m = n - 1, m - 1
    pairs = [(i, i) for i in range(lo)] + [(n + i, m + i) for i in range(len(x) - n)]
    if (n - lo) * (m - lo) > CELLS:
        held: dict = {}
        for i in range(lo, n):
            held.setdefault(x[i][4], []).append(i)
        turn = {k: iter(v) for k, v in held.items()}
        return pairs + [(i, j) for j in range(lo, m) if (i := next(turn.get(y[j][4], iter(())), None)) is not None]
    w = [[_weight(p, q, memo) for q in y[lo:m]] for p in x[lo:n]]
    best = [[0] * (m - lo + 1) for _ in range(n - lo + 1)]
    for i, wi in enumerate(w, 1):
        row, up = best[i], best[i - 1]
        for j, v in enumerate(wi, 1):
            row[j] = max(up[j], row[j - 1], up[j - 1] + v)
    i, j = n - lo, m - lo
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            pairs.append((lo + i - 1, lo + j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs


def _weight(a: tuple, b: tuple, memo: dict) -> int:
    """Simple tree matching: the number of nodes that two trees have in common; equal shapes are worked out once."""
    if a[0] != b[0]:
        return 0
    key = (a[4], b[4])
    if key not in memo:
        memo[key] = 1 + sum(_weight(a[1][i], b[1][j], memo) for i, j in _aligned(a[1], b[1], memo))
    return memo[key]


def match(a: tuple, b: tuple, memo: dict, keys: dict) -> dict:
    """block of b -> key of its node: that of the aligned node of a, or its own."""
    for n, block in enumerate(b[2]):
        keys[block] = _step(a[3], "", n) if n < len(a[2]) else _step(b[3], "?", n)
    pairs = dict((j, i) for i, j in _aligned(a[1], b[1], memo))
    for j, q in enumerate(b[1]):
        if j in pairs and a[1][pairs[j]][0] == q[0]:
            match(a[1][pairs[j]], q, memo, keys)
        else:
            _own(q, keys)
    return keys


def _own(b: tuple, keys: dict) -> None:
    for n, block in enumerate(b[2]):
        keys[block] = _step(b[3], "?", n)
    for q in b[1]:
        _own(q, keys)


def _key(*parts) -> int:
    return int.from_bytes(blake2b(repr(parts).encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


#: Reference trees that a task keeps unpacked.
HOSTS_IN_MIND = 2000
#: Bytes of packed trees and templates that are broadcast.
BROADCAST_BYTES = 64 << 20


def _packed(batches):
    for b in batches:
        out = [marshal.dumps(blocks(parse(src.as_py() or ""))[1]) for src in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, pa.binary())], names=["host", "ref"])


def references(pages: DataFrame) -> DataFrame:
    """host, ref: the packed block tree of the host's page with the smallest hash, whatever the partitions."""
    mark = F.struct(F.xxhash64("html").alias("k"), F.xxhash64(F.lit(1), "html").alias("k2"))
    least = pages.where("html is not null").groupBy("host").agg(F.min(mark).alias("least"))
    least = written(least, "least").select(F.col("host").alias("of"), "least")
    rows = pages.where("html is not null").join(small_side(least), (F.col("host") == F.col("of")) & (mark == F.col("least"))).select("host", "html")
    packed = written(rows.mapInArrow(_packed, "host string, ref binary"), "references")
    return packed.groupBy("host").agg(F.min("ref").alias("ref"))


def _small(df: DataFrame, size) -> DataFrame:
    """Broadcast hint behind a check of the bytes; larger sides are left to a shuffle join, whose hot hosts are split."""
    bytes_ = df.agg(F.coalesce(F.sum(size), F.lit(0)) + 64 * F.count("*")).first()[0]
    return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df


def _named(src, ref, host, trees: dict) -> list[tuple[str, int]]:
    """(text, key of the aligned node) of the blocks of a page."""
    texts, tree = blocks(parse(src or ""))
    if not texts:
        return []
    if host not in trees:
        if len(trees) >= HOSTS_IN_MIND:
            trees.clear()
        trees[host] = marshal.loads(ref) if ref else tree
    keys = match(trees[host], tree, {}, {})
    return [(t, keys[i]) for i, t in enumerate(texts)]


def _nodes(batches):
    """A row for each aligned block of each page: host, mark (of the node and its text), page (all hashed)."""
    trees: dict = {}
    for b in batches:
        host, mark, page = [], [], []
        for h, src, ref in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("ref").to_pylist(), strict=True):
            found = _named(src, ref, h, trees)
            whole = _key([t for t, _ in found])
            for t, key in found:
                host.append(h), mark.append(_key(key, t)), page.append(whole)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(mark, pa.int64()), pa.array(page, pa.int64())], names=["host", "mark", "page"])


def wrappers(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """host, template: hashes of the nodes, with their text, that are constant on the host. From columns host and html."""
    rows = pages.join(_small(refs, F.length("ref")), "host", "left").select("host", "html", "ref")
    nodes = written(rows.mapInArrow(_nodes, "host string, mark long, page long").distinct(), "nodes")
    many = nodes.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= TEMPLATE_PAGES)
    held = nodes.groupBy("host", "mark").agg(F.count("*").alias("held")).where(F.col("held") >= TEMPLATE_PAGES * TEMPLATE_SHARE)
    constant = held.join(many, "host").where(F.col("held") >= F.col("pages") * TEMPLATE_SHARE)
    return constant.groupBy("host").agg(F.collect_set("mark").alias("template"))


def _texts(batches):
    trees: dict = {}
    for b in batches:
        out = []
        for src, tpl, ref, h in zip(*[b.column(c).to_pylist() for c in ("html", "template", "ref", "host")], strict=True):
            if tpl:
                drop = set(tpl)
                kept = [t for t, key in _named(src, ref, h, trees) if _key(key, t) not in drop]
            else:
                kept = blocks(parse(src or ""))[0]
            out.append(" ".join(kept))
        keep = [n for n in b.schema.names if n not in ("html", "template", "ref", "host")]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(out, pa.string())], names=[*keep, "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and main text of each page."""
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    refs = written(references(src), "trees")
    tpl = written(wrappers(src, refs).join(refs, "host"), "wrappers")
    tpl = _small(tpl, F.length("ref") + 8 * F.size("template"))
    rows = src.join(tpl, "host", "left").select("page_id", "url", "html", "host", "template", "ref")
    return rows.mapInArrow(_texts, f"page_id {dict(src.dtypes)['page_id']}, url string, text string")


def op1(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
