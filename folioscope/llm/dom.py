"""A small tree of an HTML page: elements, text, and the blocks of text a reader sees."""

import html as entities
import re
from bisect import bisect_left

#: Fixed values of the HTML language: elements without content, elements whose content is no markup, elements that start a block of text,
#: and for an element the open ones that it ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead "
    "title tr ul".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section table ul".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}

#: What a mark-up character begins: a comment, a declaration, or a tag: its name, and its rest if that is plain.  Rests that are longer or
#: stranger are scanned by ``TagEnds``.
OPENING = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:([^<>"']*(?:(?:"[^"<>]{0,200}"|'[^'<>]{0,200}')[^<>"']*){0,50})>)?""", re.S)
SPECIAL = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    """An element: its tag, the marks that say what it is for, and its children, elements and strings in order."""

    __slots__ = ("tag", "raw", "children", "parent", "_marks")

    def __init__(self, tag, raw, parent):
        self.tag, self.raw, self.children, self.parent, self._marks = tag, raw, [], parent, None

    @property
    def marks(self):
        """Words of class, id, role and itemprop: (name, word) pairs, without digits, in lower case."""
        if self._marks is None:
            found = []
            if "=" in self.raw:
                for name, *values in ATTRIBUTE.findall(self.raw):
                    value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", entities.unescape("".join(values)))
                    found += [(name.lower(), w) for w in re.split(r"[^a-z]+", value.lower()) if w]
            self._marks = tuple(found)
        return self._marks


    def names(self):
        """The values of the same attributes, parted at white space only: (name, words) pairs of whole names."""
        for name, *values in ATTRIBUTE.findall(self.raw):
            for value in entities.unescape("".join(values)).split():
                value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)
                yield name.lower(), [w for w in re.split(r"[^a-z]+", value.lower()) if w]


class TagEnds:
    """Where tags of one page end: at the first ``>`` outside quotes, or at the first of all where quotes don't close.

    A scan goes from quote to closing quote; what follows depends on the place
    alone, so it is remembered for each place, and all scans of a page together
    take as many steps as it has quotes.
    """

    def __init__(self, text):
        self.text = text
        self.at = [m.start() for m in SPECIAL.finditer(text)]
        self.places = {mark: [p for p in self.at if text[p] == mark] for mark in "\"'>"}
        self.known = {}

    def _next(self, mark, start):
        places = self.places[mark]
        i = bisect_left(places, start)
        return places[i] if i < len(places) else -1

    def _outside(self, start):
        passed, end = [], -1
        while True:
            i = bisect_left(self.at, start)
            if i == len(self.at):
                break
            place = self.at[i]
            if place in self.known:
                end = self.known[place]
                break
            passed.append(place)
            mark = self.text[place]
            if mark == ">":
                end = place
                break
            close = self._next(mark, place + 1)
            if close < 0:
                break
            start = close + 1
        for place in passed:
            self.known[place] = end
        return end

    def after(self, start):
        """Where the tag whose name ends at ``start`` ends, or -1."""
        end = self._outside(start)
        return end if end >= 0 else self._next(">", start)


class Path:
    """The open elements from the page down, with the depths at which each tag is open; no step looks at more than it closes."""

    def __init__(self, root):
        self.nodes, self.depths = [root], {}

    def open(self, node):
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, tags, stops=()):
        """Closes the nearest open element with one of the tags, unless a stop is nearer; whether there was one."""
        depths, depth = self.depths, 0
        for tag in tags:
            at = depths.get(tag)
            if at and at[-1] > depth:
                depth = at[-1]
        if not depth:
            return False
        for tag in stops:
            at = depths.get(tag)
            if at and at[-1] > depth:
                return False
        nodes = self.nodes
        while len(nodes) > depth:
            depths[nodes.pop().tag].pop()
        return True


P_STOPS = ("table", "td", "th", "button")


def parse(text):
    """The tree of a page in time that grows with its length; any text gives one.  Elements that are not closed end where their parent does."""
    root = Node("#page", "", None)
    path, at, n, ends = Path(root), 0, len(text), None
    find, said, nodes = OPENING.search, 0, path.nodes
    while at < n:
        m = find(text, at)
        if m is None:
            break
        start, at = m.span()
        slash, name, raw = m.groups()
        if name and raw is None:
            ends = ends or TagEnds(text)
            stop = ends.after(at) + 1
            if not stop:  # no tag, since nothing ends it
                at = start + 1
                continue
            raw, at = text[at:stop - 1], stop
        if start > said:
            nodes[-1].children.append(text[said:start])
        said = at
        if not name:
            continue
        tag = name.lower()
        if slash:
            path.close((tag,))
            continue
        if tag in ENDS_P:
            path.close(("p",), P_STOPS)
        if tag in ENDS:
            while path.close(*ENDS[tag]):
                pass
        now = nodes[-1]
        node = Node(tag, raw, now)
        now.children.append(node)
        if tag in VOID or raw.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            # the first end tag counts if anything closes it; if not, no later one is closed either
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            close = text.find(">", end.end()) if end else -1
            stop = end.start() if close >= 0 else n
            if stop > at:
                node.children.append(text[at:stop])
            at = said = close + 1 if close >= 0 else n
            continue
        path.open(node)
    if said < n:
        nodes[-1].children.append(text[said:])
    return root


def blocks(node, skipped):
    """Blocks of text below a node in page order: references decoded, white space made one blank; ``skipped(node)`` parts are left out."""
    out, inline = [], []

    def end():
        if inline:
            words = entities.unescape("".join(inline)).split()
            if words:
                out.append(" ".join(words))
            inline.clear()

    stack = [iter((node,))]
    closing = []
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if closing and closing.pop():
                end()
            continue
        if isinstance(child, str):
            inline.append(child)
        elif child.tag == "br":
            inline.append(" ")
        elif skipped(child):
            if child.tag in BLOCK:
                end()
        else:
            block = child.tag in BLOCK
            if block:
                end()
            stack.append(iter(child.children))
            closing.append(block)
    end()
    return out
