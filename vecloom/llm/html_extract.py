"""Main text of web pages by wrapper induction.

Pages become trees of block elements in which neighbouring siblings with one label (element, role and classes
without digits; ids name one node of one page) are a group. The trees of a host that are unlike each other
outside articles are its wrappers, one for a layout (of its 64 most frequent trees, 8 at most); every other of
these trees is merged, by simple tree matching (the largest order- and parent-preserving match of equal labels),
into the wrapper most like it, whose nodes it lacks and which lacks some of its own: those become optional
nodes. Each page's tree is then aligned with its wrapper in the same way; nodes that the wrapper lacks are told
by their path of labels, so that constant blocks of any page can be seen.

A wrapper node whose text is the same on most pages of the host is template; slots whose text varies are
content. Copies of a page speak once: texts are counted over distinct contents (the article's text, or all text
of a page without one), so that a text is template only beside text that varies, and every page that has the
node counts, alone in its run or not. An article of which only headings would be left is returned whole. Groups
of siblings inside the article vary in number and text by nature and always are content.

Alignment cannot tell an article from other text that varies. What the article element (or main) holds comes
before the rest, if a page has one; menus, footers, asides and forms go by their element or role; outside an
article, blocks of mostly links go in a slot that is a run of such siblings on most pages of the host, some the
same on most. Class and id names decide last and least: whole names only, never those of html, body, main,
article or a node around the main article, and inside an article only names of adverts, reader comments, share
buttons, teasers and the like (see ``marked``, ``spare``).

Statistics of templates are counts over all distinct contents of a host; a host with a third of all pages is
counted in parts by content first, and the wrappers (small trees) are joined by broadcast up to 32 MB, which
are checked, and beyond that by a salted join.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined in page order by a line break; a ``br`` is white space. Tags follow HTML: quotes count only behind =, an unclosed tag or quoted value runs to the end.

Edge cases: null or empty html, or a page without content, gives the empty text; a null or odd url belongs
to the host ''; broken nesting is repaired the usual way (a block start ends an open paragraph; end tags
without a start are ignored); levels beyond the 100th stand side by side, in page order; an unclosed comment or script runs to the end; repeated rows are returned
each; an empty table gives an empty result; other columns are ignored here.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import OrderedDict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.textkit import strings
from vecloom.runtime import Scratch, ship, table

#: A tag ends at the first > outside a quoted value; quotes count only behind =, and nothing here is tried twice.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?+""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul button select option label template svg object video audio canvas".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"html", "body", "table", "ul", "ol", "dl", "div", "article", "section", "main", "nav", "aside", "blockquote"}
NEVER = {"head", "nav", "aside", "footer", "form", "button", "select", "option", "label", "fieldset", "template", "svg", "object", "video", "audio", "canvas", "menu", "dialog", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
DIGIT = re.compile(r"\d")
MARKS = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|sidebar|side|widget|cookies?|consent|notice|notification|alert|popup|modal|overlay|comments?|replies|respond|disqus|discussion|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|pagination|pager|toolbar|copyright|legal|disclaimer)\d*",
    re.I,
)
PLACES = {"site", "global", "top", "bottom", "left", "right", "main", "primary", "secondary", "area", "list", "box", "container", "wrapper", "wrap", "bar", "links"}
#: Marks that say nothing of a block inside an article, where text can be about them.
OUTER = re.compile(r"(?:banner|masthead|header|footer|side|sidebar|widget|notice|notification|alert|popup|modal|overlay|toolbar|copyright|legal|disclaimer)\d*", re.I)
OTHERS = re.compile(r"comments?|replies|respond|disqus|discussion|related|recommended", re.I)
ARTICLE = re.compile(r"(?:article|main)(?:$|[.@])|.*@main$", re.S)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEAST_PAGES, SHARE = 3, 0.6
#: Deeper levels of a page stand side by side.
DEEP = 100
#: Trees of a host that are looked at for layouts, the most layouts of a host, and the likeness that makes one layout of two trees.
SHAPES, LAYOUTS, ALIKE = 64, 8, 0.6
BROADCAST_BYTES = 32 << 20
SALT = 32


class Node:
    __slots__ = ("tag", "label", "parts", "parent", "off", "mark", "inside", "level", "home", "tail")

    def __init__(self, tag: str, label: str, parent, off: bool):
        self.tag, self.label, self.parent, self.off, self.mark = tag, label, parent, off, ""
        self.inside = is_article(self) or (parent is not None and parent.inside)
        self.level, self.home, self.tail = 0, None, self  # home: the node that holds this one and all deeper ones; tail: takes the text
        self.parts: list = []  # child nodes, and (text, is_link) in between

    def say(self, text: str, link: bool) -> None:
        if self.home is not None and self.home.parts[-1] is not self.tail:
            self.tail = Node(self.tag, "~", self, False)
            self.home.parts.append(self.tail)
        self.tail.parts.append((text, link))

    def add(self, node: Node) -> None:
        """Take a child; levels beyond DEEP stand side by side, in page order."""
        if self.level < DEEP:
            self.parts.append(node)
            node.level = self.level + 1
            node.home = self if node.level == DEEP else None
        else:
            self.home.parts.append(node)
            node.level, node.home = DEEP, self.home
        if node.level == DEEP:
            node.label = "~"


def parse(html: str) -> Node:
    """The tree of block elements; inline elements leave only their text."""
    root = Node("#", "#", None, False)
    at, links, pos, n = root, 0, 0, len(html)
    articles: list[Node] = []
    signs = False
    while pos < n:
        m = TOKEN.search(html, pos)
        if m is None:
            at.say(html[pos:], links > 0)
            break
        if m.start() > pos:
            at.say(html[pos : m.start()], links > 0)
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                walk = at
                while walk is not root and walk.tag != tag:
                    walk = walk.parent
                if walk is not root:
                    at, links = walk.parent, 0
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, pos)
            if end is None:
                break
            pos = html.find(">", end.start()) + 1 or n
            continue
        if tag == "br":
            at.say(" ", False)
        if tag == "a":
            links += 1
        if tag not in BLOCK:
            continue
        shut = CLOSES.get(tag)
        walk = at
        while walk is not root and walk.tag not in SCOPE:
            if walk.tag == "p" or (shut and walk.tag in shut):
                at, links = walk.parent, 0
            walk = walk.parent
        said: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(m[3]) if m[3] else ():
            if a[1].lower() in ("class", "id", "role"):
                said.setdefault(a[1].lower(), entities.unescape(a[2] or a[3] or a[4] or ""))
        role, mark = said.get("role", "").strip().lower(), f"{said.get('class', '')} {said.get('id', '')}".strip()
        # ids, and classes with digits, name one node of one page: labels are without them
        kinds = sorted(c for c in said.get("class", "").split() if not DIGIT.search(c))
        off = tag in NEVER or role in ROLES or (tag == "header" and not at.inside)
        node = Node(tag, f"{tag}{'.' + ' '.join(kinds) if kinds else ''}{'@' + role if role else ''}", at, off)
        if mark and tag not in ("html", "body") and not is_article(node):
            node.mark = marked(mark, at)
            signs = signs or bool(node.mark)
        if is_article(node):
            articles.append(node)
        at.add(node)
        if tag not in VOID and not m[3].endswith("/"):
            at = node
    if signs:
        spare(articles)
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.parts:
            if type(c) is Node:
                c.off = c.parent.off or c.off or bool(c.mark)
                todo.append(c)
    return root


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.label.endswith("@main")


def marked(names: str, at: Node) -> str:
    """The classes and ids that name no content: a mark, alone or with other marks and names of places only."""
    found = []
    for name in names.split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if any(MARKS.fullmatch(p) for p in parts) and all(p.lower() in PLACES or MARKS.fullmatch(p) for p in parts):
            if not at.inside or any(MARKS.fullmatch(p) and not OUTER.fullmatch(p) for p in parts):
                found.append(name)
    return " ".join(found)


def spare(articles: list[Node]) -> None:
    """Clear the marks of nodes that hold main or the page's articles; comments and teasers, which can be articles, keep theirs."""

    def above(node: Node) -> list[Node]:
        out = []
        while (node := node.parent) is not None:
            if node.mark:
                out.append(node)
        return out

    over = [(a, above(a)) for a in articles]
    for a, marks in over:
        if a.tag != "article":
            for m in marks:
                m.mark = ""
    if all(any(m.mark for m in marks) for _, marks in over):
        for _, marks in over:
            for m in marks:
                if not OTHERS.search(m.mark):
                    m.mark = ""


def tidy(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


class Group:
    """Neighbouring siblings with one label, taken together."""

    __slots__ = ("label", "members", "children")

    def __init__(self, label: str, members: list[Node]):
        self.label, self.members = label, members
        runs: list[list[Node]] = []
        for m in members:
            for c in m.parts:
                if type(c) is Node:
                    if runs and runs[-1][0].label == c.label:
                        runs[-1].append(c)
                    elif len(members) > 1 and (same := next((r for r in runs if r[0].label == c.label), None)):
                        same.append(c)
                    else:
                        runs.append([c])
        self.children = [Group(r[0].label, r) for r in runs]

    def shape(self) -> list:
        return [self.label, [c.shape() for c in self.children]]

    def outline(self) -> Group:
        """The tree without what is inside articles, which varies by nature and is no layout."""
        new = Group(self.label, [])
        if not ARTICLE.match(self.label):
            new.children = [c.outline() for c in self.children]
        return new

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def grown(shape: list) -> Group:
    """The tree of a shape, without members."""
    new = Group(shape[0], [])
    new.children = [grown(c) for c in shape[1]]
    return new


def alike(a: Group, b: Group) -> float:
    """Share of the nodes of two trees that match."""
    return 2 * match(a, b.shape())[0] / (a.size() + b.size())


class Layouts:
    """The wrappers of a host, one for each of its layouts."""

    def __init__(self, shapes: list[list]):
        self.shapes = shapes
        self.outlines = [grown(x).outline() for x in shapes]

    def nearest(self, outline: Group) -> tuple[float, int]:
        return max(((alike(outline, o), -i) for i, o in enumerate(self.outlines)), default=(0.0, 0))

    def of(self, page: Group) -> int:
        return -self.nearest(page.outline())[1] if len(self.shapes) > 1 else 0


def merge(tree: Group, wrapper: list) -> None:
    """Generalise a wrapper by a tree: nodes that only the tree has become optional nodes of the wrapper, in their place.

    The inside of articles varies by nature and is left as it is.
    """
    pairs = match(tree, wrapper)[1]
    known = {id(g): w for g, w in pairs}
    for g, w in pairs:
        if ARTICLE.match(g.label):
            continue
        at = 0
        for c in g.children:
            if id(c) in known:
                at = next(k for k, x in enumerate(w[1]) if x is known[id(c)]) + 1
            else:
                w[1].insert(at, c.shape())
                at += 1


def induced(shapes: list[str]) -> list[list]:
    """The wrappers of a host's trees, most frequent first: each tree is merged into the wrapper most like it, and one
    that is unlike all wrappers before it is one more."""
    found = Layouts([])
    for text in shapes:
        shape = json.loads(text)
        outline = grown(shape).outline()
        near, which = found.nearest(outline)
        if near < ALIKE and len(found.shapes) < LAYOUTS:
            found.shapes.append(shape)
            found.outlines.append(outline)
        elif near >= ALIKE:
            merge(grown(shape), found.shapes[-which])
            found.outlines[-which] = grown(found.shapes[-which]).outline()
    return found.shapes


def match(a: Group, b: list) -> tuple[int, list]:
    """Simple tree matching of two trees with equal roots: size, and the pairs (group, wrapper node)."""
    xs, ys = a.children, b[1]
    best = [[(0, ())] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            top = max(best[i][j + 1], best[i + 1][j], key=lambda p: p[0])
            if x.label == y[0]:
                size, pairs = match(x, y)
                if best[i][j][0] + size > top[0]:
                    top = (best[i][j][0] + size, (best[i][j][1], pairs))
            best[i + 1][j + 1] = top
    size, chain = best[-1][-1]
    pairs = [(a, b)]
    while chain:
        chain, got = chain
        pairs += got
    return size + 1, pairs


def number(wrapper: list, out: dict | None = None) -> dict[int, int]:
    """Each wrapper node's place in depth-first order, by identity."""
    out = {} if out is None else out
    out[id(wrapper)] = len(out)
    for c in wrapper[1]:
        number(c, out)
    return out


def aligned(page: Group, layouts: Layouts) -> dict[int, tuple[int, bool]]:
    """Slot of each DOM node of a page, by identity of the DOM node, and whether the node is alone in its run.

    A slot is a node of the page's layout or, for nodes that the layout lacks, the path of labels below one.
    """
    which = layouts.of(page)
    wrapper = layouts.shapes[which]
    place = number(wrapper)
    slots = {id(g): which << 32 | place[id(w)] for g, w in match(page, wrapper)[1]}
    found: dict[int, tuple[int, bool]] = {}
    todo = [(page, 0)]
    while todo:
        g, above = todo.pop()
        slot = slots.get(id(g))
        if slot is None:
            slot = -1 - (xxhash.xxh64_intdigest(f"{above}\n{g.label}") >> 1)
        for m in g.members:
            found[id(m)] = slot, len(g.members) == 1
        todo += [(c, slot) for c in g.children]
    return found


def own_text(node: Node) -> str:
    return tidy([p[0] if type(p) is tuple else " " for p in node.parts])


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


#: In the place of a text's digest: the slot is a run of siblings that are mostly links.
LINKS = digest("\0links")


def mostly_links(node: Node, text: str) -> bool:
    return len(tidy([p[0] if type(p) is tuple and p[1] else " " for p in node.parts])) * 2 > len(text)


class Wrappers:
    """Layouts by host, parsed once while they are in use."""

    def __init__(self, most: int = 512):
        self.known: OrderedDict[str, Layouts] = OrderedDict()
        self.most = most

    def get(self, text: str) -> Layouts:
        w = self.known.get(text)
        if w is None:
            if len(self.known) >= self.most:
                self.known.popitem(last=False)
            w = self.known[text] = Layouts(json.loads(text))
        return w


def blocks(root: Node) -> list[tuple[str, int, bool, Node]]:
    """The blocks of text of a page in order, without nodes that are off: text, characters in links, inside the article, node."""
    out: list[tuple[str, int, bool, Node]] = []

    def walk(node: Node) -> None:
        if node.off:
            return
        pieces: list[str] = []
        linked: list[str] = []

        def flush():
            text = tidy(pieces)
            if text:
                out.append((text, len(tidy(linked)), node.inside, node))
            pieces.clear()
            linked.clear()

        for p in node.parts:
            if type(p) is tuple:
                pieces.append(p[0])
                if p[1]:
                    linked.append(p[0])
            else:
                flush()
                walk(p)
        flush()

    walk(root)
    return out


def content(root: Node) -> int:
    """Digest of what a page says: its article, or all its text. Copies of an article have one digest."""
    said = blocks(root)
    return digest("\n".join([b[0] for b in said if b[2]] or [b[0] for b in said]))


def observed(root: Node, layouts: Layouts) -> set[tuple[int, int | None]]:
    """What a page tells of its host's template: (slot, text digest), and (slot, None) for the slot itself."""
    place = aligned(Group("#", [root]), layouts)
    out: set[tuple[int, int | None]] = set()
    runs: dict[int, list[bool]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        text = own_text(node)
        if text:
            slot, single = place[id(node)]
            if single or not node.inside:
                out.add((slot, digest(text)))
            out.add((slot, None))
            if not single and not node.inside:
                runs.setdefault(slot, []).append(mostly_links(node, text))
        todo += [p for p in node.parts if type(p) is Node]
    return out | {(slot, LINKS) for slot, links in runs.items() if len(links) > 1 and all(links)}


def extract(html: str, layouts: Layouts, template: set[tuple[int, int]]) -> str:
    """The content blocks of a page, joined by line breaks."""
    root = parse(html)
    place = aligned(Group("#", [root]), layouts) if template else {}

    def fixed(node: Node, inside: bool) -> bool:
        if not template or (inside and node.tag in HEADINGS):
            return False
        slot, single = place[id(node)]
        return (single or not inside) and (slot, digest(own_text(node))) in template

    said = blocks(root)
    main = [b for b in said if b[2]]
    if main:
        kept = [b for b in main if not fixed(b[3], True)]
        if all(b[3].tag in HEADINGS for b in kept):
            kept = main
    else:
        menus = {slot for slot, d in template if d == LINKS} & {slot for slot, d in template if d != LINKS}
        kept = [b for b in said if not fixed(b[3], False) and not (b[1] * 2 > len(b[0]) and menus and place[id(b[3])][0] in menus)]
    return "\n".join(b[0] for b in kept)


def _with_small(pages: DataFrame, small: DataFrame) -> DataFrame:
    """Left join by host of all pages with one row per host: by broadcast up to a checked size."""
    size = F.octet_length("wrapper") + (F.lit(16) * F.greatest(F.size("fixed"), F.lit(0)) if "fixed" in small.columns else F.lit(0)) + 64
    if small.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        return pages.join(F.broadcast(small), "host", "left")
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(spread, ["host", "salt"], "left").drop("salt")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "html-extract")
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def shapes(batches):
        for b in batches:
            seen = [json.dumps(Group("#", [parse(t)]).shape(), separators=(",", ":")) for t in strings(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(seen, pa.string())], names=["host", "shape"])

    counted = scratch.save(rows.select("host", "html").mapInArrow(shapes, "host string, shape string").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")), "counted")

    def induce(batches):
        for b in batches:
            found = [induced([x["shape"] for x in top]) for top in b.column("top").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([json.dumps(f, separators=(",", ":")) for f in found], pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["host", "wrapper", "layouts"])

    # the limit applies before the shuffle; trees of one frequency come in the order of a digest
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.xxhash64("shape"), "shape")
    top = counted.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SHAPES)
    top = top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "shape"))).alias("top"))
    wrappers = top.mapInArrow(induce, "host string, wrapper string, layouts int").join(counted.groupBy("host").agg(F.sum("n").alias("pages")), "host")
    wrappers = scratch.save(wrappers, "wrappers")

    def observe(batches):
        known = Wrappers()
        for b in batches:
            out: list[tuple] = []
            for h, t, w in zip(b.column("host").to_pylist(), strings(b.column("html")), b.column("wrapper").to_pylist()):
                root = parse(t)
                said = content(root)
                out += [(h, k, d, said) for k, d in sorted(observed(root, known.get(w)), key=str)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "node", "digest", "said"])

    # a host needs LEAST_PAGES pages before anything on it can be a template
    told = _with_small(rows.select("host", "page_id", "html"), wrappers).where(F.col("pages") >= LEAST_PAGES).select("host", "html", "wrapper").mapInArrow(observe, "host string, node long, digest long, said long")
    sums = told.groupBy("host", "node", "digest").agg(F.count_distinct("said").alias("n")).where((F.col("n") >= LEAST_PAGES) | F.col("digest").isNull())
    sums = scratch.save(sums, "sums")
    whole = sums.where("digest IS NULL").select("host", "node", F.col("n").alias("all"))
    fixed = sums.where("digest IS NOT NULL").join(whole, ["host", "node"]).where(F.col("n") >= F.col("all") * SHARE)
    fixed = fixed.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("fixed"))
    small = scratch.save(wrappers.join(fixed, "host", "left").select("host", "wrapper", "fixed"), "small")

    def take(batches):
        known = Wrappers()
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                texts = [extract(t, known.get(w), {(x["node"], x["digest"]) for x in f or ()}) for t, w, f in zip(strings(part.column("html")), part.column("wrapper").to_pylist(), part.column("fixed").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return _with_small(rows, small).select("page_id", "url", "html", "wrapper", "fixed").mapInArrow(take, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
