"""Main text of pages by wrapper induction: pages of one host are aligned, what never changes is template.

A page's tree is folded to a skeleton: siblings that look alike (tag, class
and id words) are one node with many values.  Each host has a pivot, the page
of about median length.  Every page of the host is aligned with it by simple
tree matching, top down: the most pairs of equal nodes in equal order.  Over
the different pages of the host, a pivot node that has text on most of them,
on two at least, and always the same, is template; any other is a slot.  These
counts are combined by host and node before they are shuffled, and each page
meets only its host's skeleton, so a host may hold any share of the pages.

A slot is no content if it is marked or shaped as page furniture: menus,
headers, footers, sidebars, notices, adverts, forms, comments, or mostly links.
If the pivot has a slot marked as an article, what a page has there is its
content, all of it, without such parts inside, which there are told by a whole
class, id or role and not by one word of it; so is an article of the page that
has no counterpart.  Otherwise the content is all that varies from page
to page or has no counterpart.  A page without peers has its article, or else
all that isn't furniture.

Null and empty pages have the text "".  Pages without a host have no peers.
Repeated rows are peers as well but count once; where all pages of a host are
equal, or differ only in what the pivot lacks, all their text counts as varying.  Empty tables give empty tables; columns that
are not named are not read.  Trees of any depth are folded and aligned whole.
"""

import json
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.dom import Node, blocks, parse
from folioscope.llm.shared import by_batches, chunks_of, stored

#: Stands for a whole page among its nodes.
ALL = -1
#: Share of a slot's characters inside links from which it is a menu.
LINKS = 0.5

#: Elements that are never main text, roles that say so, and words of class and id that do.
FURNITURE_TAGS = frozenset(
    "head script style template noscript iframe object embed svg math canvas nav footer aside form button select textarea input datalist "
    "dialog title menu search audio video map noembed noframes".split())
FURNITURE_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr "
    "notice notices notification notifications popup modal overlay sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe "
    "subscription signup login pagination pager widget widgets skip toolbar banner banners".split())
#: What a part of a page is called beside such a word: with them alone it is still a name of furniture.
PART_WORDS = frozenset(
    "area articles bar block box btn button buttons container count form icon icons inner item items link links list outer panel posts row slot "
    "stories tools tray unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: These count outside an article only: an article may have a header of its own.
PAGE_ONLY_WORDS = frozenset("header topbar".split())
ARTICLE_ROLES = frozenset("main article".split())
ARTICLE_ITEMS = frozenset("articlebody".split())


def furniture(node, inside):
    """Whether an element is marked as something else than main text.

    ``inside`` an article a header is its own, and one word of a longer name
    says nothing: it may be that of a section, such as related-work.
    """
    if node.tag in FURNITURE_TAGS or node.tag == "header" and not inside:
        return True
    if node.tag in ("body", "html", "article", "main"):
        return False
    for name, word in node.marks:
        if name == "role":
            if word in FURNITURE_ROLES or word == "banner" and not inside:
                return not inside or any(named(node.tag, *n) for n in node.names())
        elif name in ("class", "id") and (word in FURNITURE_WORDS or word in PAGE_ONLY_WORDS and not inside):
            return not inside or any(named(node.tag, *n) for n in node.names())
    return False


def named(tag, name, words):
    """Whether a whole class, id or role is a name of furniture; the id of a heading is made of its text and is none."""
    if name == "role":
        return len(words) == 1 and words[0] in FURNITURE_ROLES
    if name == "itemprop" or name == "id" and tag in HEADINGS:
        return False
    return not FURNITURE_WORDS.isdisjoint(words) and all(w in FURNITURE_WORDS or w in PART_WORDS for w in words)


def is_article(node):
    return node.tag in ("article", "main") or any(
        (name == "role" and word in ARTICLE_ROLES) or (name == "itemprop" and "".join(w for n, w in node.marks if n == name) in ARTICLE_ITEMS)
        for name, word in node.marks if name in ("role", "itemprop"))


def articles(root):
    """Outermost articles that are not inside furniture; a main element that holds articles gives way to them."""
    return [a for node in _outermost([root], is_article) for a in (
        node.tag != "article" and _outermost(node.children, lambda n: n.tag == "article") or [node])]


def _outermost(nodes, wanted):
    """Wanted elements in order, without those inside another or inside furniture."""
    found, stack = [], list(reversed(nodes))
    while stack:
        node = stack.pop()
        if isinstance(node, str) or furniture(node, False):
            continue
        if wanted(node):
            found.append(node)
        else:
            stack += reversed(node.children)
    return found


def sign(node):
    """What makes siblings look alike: tag and marks."""
    return ".".join([node.tag, *sorted({f"{name}={word}" for name, word in node.marks})]) if "=" in node.raw else node.tag


def unsigned(name):
    """An element with the tag and marks of a sign."""
    tag, *marks = name.split(".")
    node = Node(tag, "", None)
    node._marks = tuple(tuple(m.split("=")) for m in marks)
    return node


class Skeleton:
    """A folded tree as lists: sign, parent, children in order; members are the page's elements of each node."""

    def __init__(self):
        self.signs, self.children, self.members = [], [], []

    @classmethod
    def of(cls, root):
        self = cls()
        todo = [(self.add("#page"), [root])]
        while todo:
            at, nodes = todo.pop()
            self.members[at] = nodes
            groups = {}
            for node in nodes:
                for child in node.children:
                    if isinstance(child, Node):
                        groups.setdefault(sign(child), []).append(child)
            for name, members in groups.items():
                child = self.add(name)
                self.children[at].append(child)
                todo.append((child, members))
        return self

    def add(self, name):
        self.signs.append(name)
        self.children.append([])
        self.members.append([])
        return len(self.signs) - 1

    def dumped(self):
        return json.dumps([self.signs, self.children])

    @classmethod
    def loaded(cls, text):
        self = cls()
        self.signs, self.children = json.loads(text)
        return self


def match(a, b, known=None):
    """Simple tree matching: the most pairs of nodes of two trees, equal nodes in equal order.

    The number; ``known`` gets (number, pairs of children) of all pairs of
    nodes that stand below equal ones.
    """
    known = {} if known is None else known
    if a.signs[0] != b.signs[0]:
        return 0
    # from the roots down every pair that may count, then back up
    pairs = [(0, 0, *_sides(a, b, 0, 0))]
    for _, _, left, right in pairs:
        names = {}
        for q in right:
            names.setdefault(b.signs[q], []).append(q)
        pairs += [(p, q, *_sides(a, b, p, q)) for p in left for q in names[a.signs[p]]]
    for i, j, left, right in reversed(pairs):
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for x, p in enumerate(left):
            row, up = best[x + 1], best[x]
            for y, q in enumerate(right):
                most = max(row[y], up[y + 1])
                if a.signs[p] == b.signs[q]:
                    most = max(most, up[y] + known[p, q][0])
                row[y + 1] = most
        chosen, x, y = [], len(left), len(right)
        while x and y:
            if best[x][y] == best[x - 1][y]:
                x -= 1
            elif best[x][y] == best[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                chosen.append((left[x], right[y]))
        known[i, j] = (best[-1][-1] + 1, chosen[::-1])
    return known[0, 0][0]


def _sides(a, b, i, j):
    """Children of i and of j whose signs the other one has too."""
    names = {b.signs[y] for y in b.children[j]}
    left = [x for x in a.children[i] if a.signs[x] in names]
    names = {a.signs[x] for x in left}
    return left, [y for y in b.children[j] if b.signs[y] in names]


def aligned(page, pivot):
    """The pivot's node for each node of the page that has a counterpart."""
    known = {}
    if not match(page, pivot, known=known):
        return {}
    out, todo = {}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        todo += known[i, j][1]
    return out


def own_text(nodes):
    """Text directly within the elements, in order, white space made one blank."""
    return " ".join(" ".join(c for n in nodes for c in n.children if isinstance(c, str)).split())


def in_links(page):
    """Whether each node of a page is a link or inside one."""
    found = [False] * len(page.signs)
    for i, children in enumerate(page.children):  # a child comes after its parent
        found[i] = found[i] or page.members[i][0].tag == "a"
        for c in children:
            found[c] = found[i]
    return found


def observed(page, pivot):
    """(pivot node, hash of its text, characters, characters in links) of a page, for aligned nodes with text, and once for the page."""
    yield ALL, 0, 0, 0
    links = in_links(page)
    for i, j in aligned(page, pivot).items():
        text = own_text(page.members[i])
        if text:
            yield j, zlib.crc32(text.encode()) | len(text) << 32, len(text), len(text) if links[i] else 0


class Wrapper:
    """What is known of a host: its pivot, which of its nodes are template, menus, or articles."""

    def __init__(self, pivot=None, nodes=()):
        self.pivot, self.template, self.menus, self.regions = pivot, set(), set(), set()
        if pivot is None:
            return
        self.regions = set(self.marked())
        own = {n["node"]: n for n in nodes or ()}
        total = own.pop(ALL, {"pages": 0})["pages"]
        if all(n["constant"] for n in own.values()):
            return  # equal pages tell nothing
        self.template = {i for i, n in own.items() if n["constant"] and n["pages"] > max(1, total / 2)}
        # menus: nodes whose text, that of their children included, is mostly links
        chars = [own[i]["chars"] if i in own else 0 for i in range(len(pivot.signs))]
        links = [own[i]["links"] if i in own else 0 for i in range(len(pivot.signs))]
        order = [0]
        for i in order:
            order += pivot.children[i]
        for i in reversed(order):
            chars[i] += sum(chars[c] for c in pivot.children[i])
            links[i] += sum(links[c] for c in pivot.children[i])
        self.menus = {i for i in order if chars[i] and links[i] > LINKS * chars[i]}

    def marked(self):
        """Pivot nodes marked as articles, outermost ones, articles before the main element around them."""
        nodes = [unsigned(name) for name in self.pivot.signs]
        for at in self._outermost(nodes, 0, is_article):
            yield from nodes[at].tag != "article" and self._outermost(nodes, at, lambda n: n.tag == "article") or [at]

    def _outermost(self, nodes, at, wanted):
        found, stack = [], list(self.pivot.children[at])
        while stack:
            i = stack.pop()
            if furniture(nodes[i], False):
                continue
            if wanted(nodes[i]):
                found.append(i)
            else:
                stack += self.pivot.children[i]
        return found

    def main_text(self, root):
        """Blocks of the main text of a page."""
        found = articles(root)
        page = Skeleton.of(root) if self.pivot else None
        pairs = aligned(page, self.pivot) if self.pivot else {}
        content = {id(n): n for i, j in pairs.items() if j in self.regions for n in page.members[i]}
        content.update((id(n), n) for n in found)
        if content:
            return [b for node in in_order(root, content) for b in blocks(node, lambda n: furniture(n, True))]
        dropped = set()
        for i, j in pairs.items():
            if j in self.menus or j in self.template and not page.children[i]:
                dropped.update(map(id, page.members[i]))
            elif j in self.template:  # its own text is template, its children are judged by themselves
                for node in page.members[i]:
                    node.children = [" " if isinstance(c, str) else c for c in node.children]
        return blocks(root, lambda n: id(n) in dropped or furniture(n, False))


def in_order(root, wanted):
    """Wanted elements in page order, without those inside another."""
    stack = [root]
    while stack:
        node = stack.pop()
        if id(node) in wanted:
            yield node
        else:
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages):
    """(host, pivot, nodes): each host's pivot skeleton and what its nodes held over all pages.

    ``pages``: host, page, html.  Hosts of one page have no wrapper.
    """
    sized = pages.where("host <> ''").select("host", "page", F.char_length("html").alias("size"), F.xxhash64("html").alias("key"))
    middle = sized.groupBy("host").agg(F.percentile_approx("size", 0.5).alias("middle"), F.count("*").alias("n")).where("n > 1")
    # stored, so that a host of many pages can be split where these are joined
    middle = stored(middle, "middles")
    pick = sized.join(middle, "host").groupBy("host").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("middle")), F.col("page").isNull(), "page", "key")).alias("pick"))
    pick = stored(pick.select("host", F.col("pick.page").alias("p"), F.col("pick.key").alias("k")), "picks")
    pivots = pages.withColumn("key", F.xxhash64("html")).join(
        pick, (pages["host"] == pick["host"]) & F.col("page").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), "left_semi")

    def folded(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [Skeleton.of(parse(h or "")).dumped() for h in batch.column(1).to_pylist()], pa.string())], names=["host", "pivot"])

    pivots = stored(pivots.select("host", "html").mapInArrow(folded, "host string, pivot string")
                    .groupBy("host").agg(F.min("pivot").alias("pivot")), "pivots")

    def watched(batches):
        known = {}
        for batch in batches:
            hosts, pivots = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for start, chunk in chunks_of(batch, 1):
                rows = []
                for i, data in enumerate(chunk, start):
                    if hosts[i] not in known:
                        known.clear() if len(known) > 256 else None
                        known[hosts[i]] = Skeleton.loaded(pivots[i])
                    rows += [(hosts[i], *x) for x in observed(Skeleton.of(parse((data or b"").decode())), known[hosts[i]])]
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4))], names=["host", "node", "hash", "chars", "links"])

    # equal pages say the same, and only different ones bear witness to a template
    different = pages.where("host <> ''").select("host", "html").distinct()
    seen = by_batches(
        different.join(pivots, "host").select("host", "html", "pivot"), watched, "host string, node long, hash long, chars long, links long")
    nodes = seen.groupBy("host", "node").agg(
        F.count("*").alias("pages"), (F.min("hash") == F.max("hash")).alias("constant"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    # at most as many nodes as the pivot has, and one
    nodes = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "constant", "chars", "links")).alias("nodes"))
    return stored(pivots.join(nodes, "host", "left"), "wrappers")


def extracted(pages, page="page_id", url="url", html="html"):
    """page, url and ``text``, the main text of every page: blocks joined by line ends."""
    rows = pages.select(F.col(page).alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("host", _host(F.col("url")))
    made = wrappers(rows.select("host", "page", F.coalesce("html", F.lit("")).alias("html")))
    rows = rows.join(made, "host", "left").select("page", "url", "html", "host", "pivot", "nodes")
    schema = T.StructType([rows.schema["page"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        known = {}
        for batch in batches:
            hosts, pivots, nodes = (batch.column(i) for i in (3, 4, 5))
            for start, chunk in chunks_of(batch, 2):
                texts = []
                for i, data in enumerate(chunk, start):
                    host = hosts[i].as_py()
                    if host not in known:
                        known.clear() if len(known) > 256 else None
                        known[host] = Wrapper(Skeleton.loaded(pivots[i].as_py()), nodes[i].as_py()) if pivots[i].is_valid else Wrapper()
                    texts.append("\n".join(known[host].main_text(parse((data or b"").decode()))))
                part = batch.slice(start, len(chunk))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page", "url", "text"])

    return by_batches(rows, run, schema)
