"""Main text of web pages by wrapper induction: same-host pages are aligned as trees, constant nodes are template, varying slots content."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapcast.llm.common import mapped
from lapcast.llm.urls import host_of
from lapcast.plans.skew import lookup_join, salted_join
from lapcast.session import broadcast_rows, written

#: A host's pages are all aligned with one of them, its reference: of those with at most so many tags, or else the fewest.
REFERENCE_TAGS = 3000
#: References of more text than this are joined, not broadcast.
BROADCAST_TEXT = 64 << 20
#: Known pairs of subtrees of one reference; the table is emptied when it is full.
KNOWN_PAIRS = 200_000
#: A task keeps the references of so many hosts as trees.
OPEN_HOSTS = 32
#: A block is template if it has the same text in this share of the pages with its path, and in so many at least.
CONSTANT, LEAST_PAGES = 0.6, 3
#: The content slot is the deepest element that holds this share of the varying text.
SLOT = 0.8

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes template xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
DROPPED = RAW | frozenset("head nav footer aside form button select input dialog menu object canvas audio video applet".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
MARKS = frozenset(
    "ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo "
    "promotion related replies share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: What may stand beside a mark in a compound class name, as in ``site-footer`` or ``comment_list``.
PARTS = frozenset(
    "area article bar block body bottom box column container content global group head inline inner item items left link links list "
    "main mobile outer page panel post primary right row secondary section site slot story text top unit wrap wrapper".split()
)
#: Paths longer than this go on from a digest of themselves.
LONG_PATH = 1500
#: An open element of the first kind ends where one of the second begins.
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
_ENDING = frozenset().union(*IMPLIED.values())
_CELLS = frozenset(("td", "th"))
_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>?|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Node:
    """An element; ``children`` are elements and decoded texts in page order, ``content`` says that an article or main holds it."""

    __slots__ = ("tag", "label", "children", "dropped", "content")

    def __init__(self, tag: str, label: str, dropped: bool, content: bool = False) -> None:
        self.tag, self.label, self.children, self.dropped, self.content = tag, label, [], dropped, content

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def _marked(names: str) -> bool:
    """Whether a class or id is a mark, or made of marks and parts of pages only: ``ad``, ``ad-slot``, not ``ad-hoc``."""
    for name in names.split():
        words = re.findall(r"[a-z]+", name)
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in PARTS for w in words):
            return True
    return False


def _step(path: str, label: str) -> str:
    """The path of an element below ``path``; long ones start anew from a digest, so that deep pages stay small."""
    if len(path) > LONG_PATH:
        path = hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return f"{path}/{label}"


def _element(tag: str, source: str, inside_content: bool) -> Node:
    label, dropped = tag, tag in DROPPED or (tag == "header" and not inside_content)
    if source and not source.isspace():
        found = {}
        for m in _ATTRIBUTE.finditer(source):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        names = f"{found.get('class', '')} {found.get('id', '')}".lower()
        label = ".".join([tag, *sorted(set(names.split()))])
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        marked = tag not in ("html", "body", "main") and _marked(names)
        dropped = dropped or hidden or marked or found.get("role", "").lower() in ROLES
        if found.get("role", "").lower() == "main":
            tag = "main"
    return Node(tag, label, dropped, inside_content)


def parsed(page: str) -> Node:
    """The page as a tree; unclosed, crossed and stray tags are mended the way browsers do it for blocks."""
    root = Node("", "", False)
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        token, tag = m[0], m[2]
        if tag is None:
            if not token.startswith(("<!", "<?")):
                stack[-1].children.append(html.unescape(token) if "&" in token else token)
            continue
        tag = tag.lower()
        if m[1]:
            _close(stack, tag)
            continue
        _imply(stack, tag)
        holder = stack[-1]
        node = _element(tag, m[3], holder.content or holder.tag in ("article", "main"))
        stack[-1].children.append(node)
        if tag in RAW:
            over = _ENDS[tag].search(page, at)
            close = page.find(">", over.end()) if over else -1
            at = close + 1 if close >= 0 else end
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("path", "g")):
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag in INLINE and stack[i].tag not in INLINE or stack[i].tag in _CELLS and tag not in ("tr", "table", "tbody", "thead", "tfoot"):
            return


def _imply(stack: list[Node], tag: str) -> None:
    if tag not in INLINE and tag not in VOID | RAW or tag == "hr":
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag not in INLINE:
                break
    if tag not in _ENDING:
        return
    for i in range(len(stack) - 1, 0, -1):
        known = IMPLIED.get(stack[i].tag)
        if known and tag in known:
            del stack[i:]
            return
        if stack[i].tag in ("ul", "ol", "dl", "table", "select", "article", "section", "div", "body"):
            return


def blocks_of(node: Node, path: str = "") -> list[tuple[str, str]]:
    """(path, text) of the blocks below an element in page order, without dropped elements."""
    out: list[tuple[str, str]] = []
    held: list[str] = []

    def flush(where: str) -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((where, text))
        held.clear()

    # Open elements: what is left of their children, the path of the block they are in, and how they end.
    open_ = [(iter(node.children), path, "block")]
    while open_:
        children, where, kind = open_[-1]
        child = next(children, None)
        if child is None:
            open_.pop()
            if kind == "block":
                flush(where)
            elif kind == "cell":
                held.append(" ")
        elif isinstance(child, str):
            held.append(child)
        elif child.dropped:
            held.append(" ")
            if kind == "block" and child.tag not in INLINE:
                flush(where)
        elif child.tag in INLINE and child.tag not in VOID or child.tag in _CELLS and kind != "block":
            open_.append((iter(child.children), where, "inline"))
        elif child.tag in _CELLS:
            held.append(" ")
            open_.append((iter(child.children), where, "cell"))
        elif child.tag in VOID:
            held.append(" ")
            if kind == "block" and child.tag != "br" and child.tag not in INLINE:
                flush(where)
        else:
            flush(where)
            open_.append((iter(child.children), _step(where, child.label), "block"))
    return out


def _outermost(node: Node, wanted, path: str = "") -> list[tuple[Node, str]]:
    """The elements that pass, none inside another, outside dropped ones; with their paths."""
    found, todo = [], [(node, path)]
    while todo:
        at, where = todo.pop()
        if at.dropped:
            continue
        if wanted(at, where):
            found.append((at, where))
            continue
        todo += [(c, _step(where, c.label)) for c in reversed(at.elements())]
    return found


class Aligner:
    """Simple tree matching of trees with a reference: the largest top-down, order-keeping pairing of equally labelled elements.

    How two subtrees pair up depends on their shapes alone (labels and order), so it is worked out once for each two shapes,
    and equal shapes pair up whole. Time and memory for a page grow with its size times the reference's at most.
    """

    def __init__(self, reference: Node) -> None:
        self.reference, self.order = reference, [n for n, _ in _paths(reference)]
        self.place = {id(n): i for i, n in enumerate(self.order)}
        self.own = [_own(n) for n in self.order]
        self._clear()

    def _clear(self) -> None:
        # Shapes by label and shapes of children, their sizes, the pairs that are known: size of the pairing and children by number.
        self.shapes: dict[tuple, int] = {}
        self.parts: list[tuple[int, ...]] = []
        self.labels: list[str] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.of_reference = self._shaped(self.reference)

    def _shaped(self, tree: Node) -> dict[int, int]:
        """The shape of every element."""
        nodes = [tree]
        for node in nodes:
            nodes += node.elements()
        out: dict[int, int] = {}
        for node in reversed(nodes):
            parts = tuple(out[id(c)] for c in node.elements())
            shape = self.shapes.setdefault((node.label, parts), len(self.parts))
            if shape == len(self.parts):
                self.parts.append(parts)
                self.labels.append(node.label)
                self.sizes.append(1 + sum(self.sizes[p] for p in parts))
            out[id(node)] = shape
        return out

    def _weight(self, a: int, b: int) -> int:
        return self.sizes[a] if a == b else self.known[a, b][0]

    def _learn(self, a: int, b: int) -> None:
        """Pairs of shapes that can meet, parents first; then a pair when all its children's are known."""
        labels, todo = self.labels, [(a, b, False)]
        while todo:
            a, b, ready = todo.pop()
            if a == b or (a, b) in self.known:
                continue
            left, right = self.parts[a], self.parts[b]
            if not ready:
                todo.append((a, b, True))
                todo += {(x, y, False) for x in set(left) for y in set(right) if x != y and labels[x] == labels[y] and (x, y) not in self.known}
                continue
            best = [[0] * (len(right) + 1)]
            for x in left:
                above, row = best[-1], [0]
                for j, y in enumerate(right):
                    most = max(above[j + 1], row[j])
                    if labels[x] == labels[y]:
                        most = max(most, above[j] + self._weight(x, y))
                    row.append(most)
                best.append(row)
            i, j, together = len(left), len(right), []
            while i and j:
                x, y = left[i - 1], right[j - 1]
                if labels[x] == labels[y] and best[i][j] == best[i - 1][j - 1] + self._weight(x, y):
                    i, j = i - 1, j - 1
                    together.append((i, j))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            self.known[a, b] = best[-1][-1] + 1, together

    def pairs(self, tree: Node) -> list[tuple[Node, Node]]:
        """(element of the reference, element of the tree)."""
        if self.reference.label != tree.label:
            return []
        if len(self.known) > KNOWN_PAIRS or len(self.parts) > KNOWN_PAIRS:
            self._clear()
        shape, of_reference = self._shaped(tree), self.of_reference
        self._learn(of_reference[id(self.reference)], shape[id(tree)])
        out = [(self.reference, tree)]
        for one, other in out:
            left, right, a, b = one.elements(), other.elements(), of_reference[id(one)], shape[id(other)]
            out += zip(left, right, strict=True) if a == b else [(left[i], right[j]) for i, j in self.known[a, b][1]]
        return out

    def votes(self, tree: Node) -> list[tuple[int, int, bool]]:
        """(place, length, same) of the elements the tree has in common: number in the reference, own text's length, whether it is the reference's."""
        out = []
        for one, other in self.pairs(tree):
            at, own = self.place[id(one)], _own(other)
            out.append((at, len(own), own == self.own[at]))
        return out


def matching(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest top-down, order-keeping pairing of equally labelled elements."""
    return Aligner(a).pairs(b)


def _paths(node: Node, path: str = "") -> Iterator[tuple[Node, str]]:
    todo = [(node, path)]
    while todo:
        at, where = todo.pop()
        yield at, where
        todo += [(c, _step(where, c.label)) for c in reversed(at.elements()) if not c.dropped]


def _skeleton(node: Node) -> Node:
    """The tree of block elements, without inline and dropped ones; what the matching aligns."""
    out = Node(node.tag, node.label, False)
    made = [(node, out)]
    for source, copy in made:
        copy.children = [Node(c.tag, c.label, False) if isinstance(c, Node) else c for c in source.children if isinstance(c, str) or not c.dropped]
        made += zip([c for c in source.elements() if not c.dropped], copy.elements(), strict=True)
    # Children come after their parents, so inline elements are already flat when their parent takes them up.
    for _, copy in reversed(made):
        if any(c.tag in INLINE for c in copy.elements()):
            copy.children = [x for c in copy.children for x in (c.children if isinstance(c, Node) and c.tag in INLINE else [c])]
    return out


def _own(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def slot_of(reference: Node, same: list[int], seen: list[int], pages: int) -> tuple[str, list[str]]:
    """The content slot's path ('' without one) and the template's blocks, from counts over a host's pages for every element.

    ``same``: pages whose own text is the reference's, ``seen``: length of all own texts. An element's own text that stays the same in
    ``CONSTANT`` of the pages is template; the others vary, and the slot is the deepest element with ``SLOT`` of their text.
    """
    if pages < 3:
        return "", []
    least = max(3, CONSTANT * pages)
    template, varying, order = [], {}, list(_paths(reference))
    for at, (node, path) in enumerate(order):
        own = _own(node)
        fixed = own and same[at] >= least
        if fixed:
            template.append(f"{path}\t{own}")
        varying[id(node)] = 0 if fixed else seen[at]
    for node, _ in reversed(order):
        varying[id(node)] += sum(varying[id(c)] for c in node.elements())
    slot, at, path = "", reference, ""
    total = varying[id(reference)]
    while total:
        best = max(at.elements(), key=lambda c: varying[id(c)], default=None)
        if best is None or varying[id(best)] < SLOT * total or best.tag in ("p", "li", "td", "h1"):
            break
        at, path = best, _step(path, best.label)
        slot = path
        if best.tag in ("article", "main"):
            break
    return slot, template


def induced(pages: list[str]) -> tuple[str, list[str]]:
    """A host's wrapper from its pages: the content slot's path ('' without one) and the template's blocks.

    The first page is the reference; every page is matched to it.
    """
    trees = [_skeleton(parsed(p)) for p in pages]
    if len(trees) < 3:
        return "", []
    aligner = Aligner(trees[0])
    same, seen = [0] * len(aligner.order), [0] * len(aligner.order)
    for tree in trees:
        for at, length, alike in aligner.votes(tree):
            same[at] += alike
            seen[at] += length
    return slot_of(trees[0], same, seen, len(trees))


def _name(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\t".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(page: str, slot: str = "", template: frozenset[str] = frozenset(), names: frozenset[int] = frozenset()) -> str:
    """The blocks of the page's content slot less the template's, which are told as path and text or by their ``_name``.

    The wrapper's slot decides; articles, or else a main element, narrow it where they lie inside. They stand in for it,
    and after them the body, on pages that do not have the slot.
    """
    root = parsed(page)
    found = _outermost(root, lambda _, path: path == slot) if slot else []
    found = found or [(root, "")]
    for tag in ("article", "main"):
        inside = [x for node, path in found for x in _outermost(node, lambda n, _, t=tag: n.tag == t, path)]
        if inside:
            found = inside
            break
    kept = [b for node, path in found for b in blocks_of(node, path) if f"{b[0]}\t{b[1]}" not in template and not (names and _name(*b) in names)]
    return "\n".join(text for _, text in kept)


def references(pages: DataFrame) -> DataFrame:
    """``host, reference`` for every host of ``host, html``: the page of lowest hash among those with at most ``REFERENCE_TAGS`` tags,
    or else with the fewest. Only numbers are compared, and they combine before the shuffle."""
    tags = F.greatest(F.length("html") - F.length(F.replace("html", F.lit("<"), F.lit(""))), F.lit(REFERENCE_TAGS))
    lowest = pages.select("host", F.struct(tags.alias("tags"), F.xxhash64("html").alias("hash")).alias("x")).groupBy("host").agg(F.min("x").alias("x"))
    chosen = lowest.select("host", F.col("x.hash").alias("hash"))
    return lookup_join(pages.withColumn("hash", F.xxhash64("html")), chosen, ["host", "hash"]).groupBy("host").agg(F.min("html").alias("reference"))


def read_pages(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """``host, paths, blocks, votes``: every different page of a host, its blocks by name and its votes on the host's reference.

    Pages with the same blocks count once. A vote is a number: place, then length, then whether the text is the reference's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligners: dict[str, Aligner] = {}
        for batch in batches:
            pages_of, paths, blocks, votes = [], [], [], []
            for host, source, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "reference")), strict=True):
                tree = parsed(source)
                found = blocks_of(tree)
                pages_of.append(_name(*[x for b in found for x in b]))
                held = {_name(*b): _name(b[0]) for b in found}
                blocks.append(list(held))
                paths.append(list(held.values()))
                if host not in aligners:
                    if len(aligners) >= OPEN_HOSTS:
                        aligners.pop(next(iter(aligners)))
                    aligners[host] = Aligner(_skeleton(parsed(reference)))
                votes.append([(at << 32) + 2 * length + same for at, length, same in aligners[host].votes(_skeleton(tree))])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(pages_of, pa.int64()), pa.array(paths, longs), pa.array(blocks, longs), pa.array(votes, longs)],
                ["host", "page", "paths", "blocks", "votes"],
            )

    about = chosen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("reference")), F.lit(0)).alias("text")).first()
    few = about["n"] <= broadcast_rows(pages.sparkSession) and about["text"] <= BROADCAST_TEXT
    beside = pages.join(F.broadcast(chosen), "host") if few else salted_join(pages, chosen, ["host"])
    found = mapped(beside.select("host", "html", "reference"), read, "host string, page long, paths array<long>, blocks array<long>, votes array<long>", rows=500)
    different = found.groupBy("host", "page").agg(F.max(F.struct("paths", "blocks", "votes")).alias("b"))
    return written(different.select("host", "b.*"), "wrapper-pages")


def wrappers(different: DataFrame, chosen: DataFrame) -> DataFrame:
    """``host, slot`` for every host: the slot that all its different pages give by their votes (:func:`read_pages`)."""
    vote = different.select("host", F.explode("votes").alias("v"))
    low = F.col("v").bitwiseAND(0xFFFFFFFF)
    counted = vote.groupBy("host", F.shiftright("v", 32).alias("at")).agg(F.sum(low % 2).alias("same"), F.sum(F.shiftright(low, 1)).alias("seen"))
    # One row an element of the reference.
    of_host = counted.groupBy("host").agg(F.collect_list(F.struct("at", "same", "seen")).alias("counts"))
    known = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(of_host, "host").join(chosen, "host")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = []
            for n, counts, reference in zip(*(batch.column(c).to_pylist() for c in ("pages", "counts", "reference")), strict=True):
                tree = _skeleton(parsed(reference))
                same = [0] * sum(1 for _ in _paths(tree))
                seen = list(same)
                for c in counts:
                    same[c["at"]], seen[c["at"]] = c["same"], c["seen"]
                slots.append(slot_of(tree, same, seen, n)[0])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(slots, pa.string())], ["host", "slot"])

    return mapped(known, fit, "host string, slot string", rows=500)


def templates(different: DataFrame) -> DataFrame:
    """``host, template``: the names of the blocks that are constant among all of a host's pages that have their path.

    Counts combine before every shuffle.
    """
    spread = different.select("host", F.explode(F.arrays_zip(F.col("paths").alias("path"), F.col("blocks").alias("block"))).alias("x"))
    often = spread.groupBy("host", "x.path", "x.block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    often = written(often, "wrapper-blocks")
    with_path = different.select("host", F.explode(F.array_distinct("paths")).alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    constant = lookup_join(often, with_path, ["host", "path"]).where(F.col("n") >= CONSTANT * F.col("pages"))
    return constant.groupBy("host").agg(F.collect_list("block").alias("template"))


def main_texts(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per input row: ``id, url, text``.

    Null and empty pages have an empty text; pages without a host (a null url, or no ``://``) share the empty host's wrapper.
    Repeated rows keep one result each. Only the three named columns are read.
    """
    plain = df.select(df[key].cast("long").alias("id"), df[url].cast("string").alias("url"), F.coalesce(df[page].cast("string"), F.lit("")).alias("html"))
    pages = plain.withColumn("host", host_of(F.col("url")))
    chosen = written(references(pages.select("host", "html")), "references")
    different = read_pages(pages, chosen)
    constant = written(templates(different), "templates")
    fitted = written(wrappers(different, chosen).join(constant, "host", "left"), "wrappers")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, slot, template in zip(*(batch.column(c).to_pylist() for c in ("html", "slot", "template")), strict=True):
                texts.append(main_text(source, slot or "", names=frozenset(template or ())))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    return mapped(lookup_join(pages, fitted, ["host"], "left"), extract, "id long, url string, text string", rows=500)
