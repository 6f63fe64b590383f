"""Main text of web pages by wrapper induction over all pages of a host.

1. Every page becomes an outline: its tree of block elements as labels and depths, and a hash for each block of text.
2. The outline is aligned with that of one page of the host by simple tree matching: nodes with equal labels match in
   order, so that as many as possible do, equal texts first. A matched node is a slot of the wrapper; a node without a partner is a
   slot by the labels above it.
3. Texts of slots are counted over all pages of the host in a grouped sum. Copies of a page count once: pages are told apart by their
   longest block. A text that fills its slot on at least ``SHARE`` of the host's different pages is a constant of the template; what
   varies is content.
4. Pages are read again without the blocks that are template.

Elements whose role says that they are no article (menus, headers, footers, sidebars, notices, adverts, forms,
comments) never are content, whether they vary or not. Where a page marks its article, only that is read, and a block in it is
template only on the stronger evidence of ``FIRM_SHARE``: passages may be quoted by many pages of a host.

Only outlines are shuffled, not pages. They meet the one of their host in sorted streams, so a task holds one tree and one batch. A host
with many pages is split into parts, each with its own copy of it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import freeing, reachable, staged, text_of

#: Hosts with at least a 4096th of all pages are split.
PARTS = 4096
#: Least number and share of a host's different pages with a constant; the same in articles that pages mark.
LEAST, SHARE, FIRM_LEAST, FIRM_SHARE = 2, 0.3, 4, 0.9
#: Rows of an Arrow batch that are handled at a time.
ROWS = 64
#: Of a block of text: counted only, content unless it is template, content of a marked article.
COUNTED, OPEN, MARKED = 0, 1, 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript xmp".split())
FOREIGN = frozenset(("svg", "math"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("nav header footer aside form button select dialog menu head fieldset option label svg template annotation annotation-xml".split()) | RAW
#: Never skipped by a role: what holds the whole page or its article.
WHOLE = frozenset(("html", "body", "main", "article"))
#: Whole names of roles, with a word of place before them or of make after them.
_ROLE = re.compile(
    r"(?i)(?:(?:site|main|page|global|top|bottom|left|right|primary|secondary|social)[_-])?"
    r"(?:nav|navbar|navigation|menu|breadcrumbs?|masthead|footer|sidebar|ads?|advert|advertisement|sponsored|cookies?|consent|popup|modal|newsletter|"
    r"comments?|share|sharing|pagination|contentinfo|complementary|(?:site|page|global|top)[_-]header|related[_-](?:posts|articles|links|stories))"
    r"(?:[_-](?:notice|banner|consent|bar|box|block|wrapper|container|area|list|links|buttons?|menu|widget|section|form|slot|unit|left|right|top|bottom|[0-9]+))*")
#: Values of the attribute role alone.
_ARIA = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?i)(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements whose start ends an open one of the same group.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    """An element. ``parts`` holds text and block elements in page order; in a tree made from an outline, ``text`` is the hash of
    the first block of text, 0 for none."""

    __slots__ = ("tag", "label", "parts", "skipped", "text")

    def __init__(self, tag: str, label: str | int = "", skipped: bool = False, text: int = 0):
        self.tag, self.label, self.skipped, self.text = tag, label, skipped, text
        self.parts: list[str | Node] = []

    def blocks(self) -> list[Node]:
        return [x for x in self.parts if not isinstance(x, str)]


def foreign(stack: list[tuple[str, Node]]) -> int:
    """The place of the innermost open foreign element, 0 for none; HTML inside one is none of it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in FOREIGN:
            return i
        if stack[i][0] in BLOCKS or stack[i][0] == "foreignobject":
            return 0
    return 0


def parse(page: str) -> Node:
    """A tree of block elements; unclosed and stray tags are put right as browsers roughly do."""
    root = Node("#root")
    stack: list[tuple[str, Node]] = [("#root", root)]
    at, hidden = 0, 0
    tokens = _TOKEN.search
    while True:
        m = tokens(page, at)
        text = page[at:m.start() if m else len(page)]
        if text and not hidden:
            stack[-1][1].parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                del stack[depth:]
            elif tag == "p":
                stack[-1][1].parts.append(Node("p"))
            continue
        if m.group(0).endswith("/>") and (tag in FOREIGN or foreign(stack)):
            continue  # closed by itself
        if tag in RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>]|\Z)").search(page, at)
            if end or tag in ("script", "style"):
                at = end.start() if end else len(page)
            continue
        if tag in VOID:
            stack[-1][1].parts.append(Node(tag) if tag == "hr" else " ")
            continue
        if tag in BLOCKS:
            # A block ends foreign elements that were left open.
            if inside := foreign(stack):
                del stack[inside:]
            ends = _ENDS.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                open_ = stack[i][0]
                if open_ == "p" or open_ in ends:
                    del stack[i:]
                    break
                if open_ in BLOCKS and open_ not in ends:
                    break
        values = [(k.lower(), a or b or c) for k, a, b, c in _NAMED.findall(m.group(3))] if m.group(3) else []
        named = " ".join(v for _, v in values)
        role = tag not in WHOLE and any(
            _ROLE.fullmatch(x) or k == "role" and x.lower() in _ARIA for k, v in values for x in v.split())
        skipped = role or tag in SKIPPED
        if tag == "header" and any(t in ("article", "main") for t, _ in stack):
            skipped = role
        if tag in BLOCKS or skipped:
            node = Node(tag, f"{tag} {named}", skipped)
            stack[-1][1].parts.append(node)
            stack.append((tag, node))
        else:
            stack.append((tag, stack[-1][1]))  # inline: its text belongs to the block around it


def _depth_free(step: Iterator):
    """The result of a recursion that yields its calls, on a stack of its own."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest order-keeping match of two trees with equal roots, and its pairs. Pairs with
    equal texts count twice."""
    size, tree = _depth_free(_align(a, b))
    pairs, open_ = [], [tree]
    while open_:
        pair, below = open_.pop()
        pairs.append(pair)
        open_ += below
    return size, pairs


def _weight(a: Node, b: Node) -> int:
    return 2 if a.text and a.text == b.text else 1


def _align(a: Node, b: Node) -> Iterator:
    """Returns the size and the pair (a, b) with the matches below it."""
    left, right = a.blocks(), b.blocks()
    own = _weight(a, b)
    if not left or not right:
        return own, ((a, b), [])
    cell = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(left):
        row, above = cell[i + 1], cell[i]
        for j, y in enumerate(right):
            best = max(row[j], above[j + 1])
            if x.label == y.label:
                simple = not x.parts or not y.parts or all(isinstance(p, str) for p in x.parts) or all(isinstance(p, str) for p in y.parts)
                got = (_weight(x, y), None) if simple else (yield _align(x, y))
                found[i, j] = got
                best = max(best, above[j] + got[0])
            row[j + 1] = best
    below: list[tuple] = []
    i, j = len(left), len(right)
    while i and j:
        got = found.get((i - 1, j - 1))
        if got and cell[i][j] == cell[i - 1][j - 1] + got[0]:
            below.append(got[1] or ((left[i - 1], right[j - 1]), []))
            i, j = i - 1, j - 1
        elif cell[i][j] == cell[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return own + cell[-1][-1], ((a, b), below)


def _articles(root: Node) -> list[Node]:
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == wanted and not node.skipped:
                found.append(node)
            elif not node.skipped:
                stack += reversed(node.blocks())
        if found:
            return found
    return [root]


def _texts(top: Node, out: list[tuple[Node, str]]) -> None:
    """Blocks of text below a node, in page order, without skipped elements."""
    if top.skipped:
        return
    stack: list[tuple[Node, Iterator, list[str]]] = [(top, iter([*top.parts, None]), [])]
    while stack:
        node, parts, open_ = stack[-1]
        for part in parts:
            if isinstance(part, str):
                open_.append(part)
            elif node.tag == "tr" and part is not None and not part.skipped and not part.blocks():
                open_ += [" ", *part.parts, " "]
            else:
                if text := " ".join("".join(open_).split()):
                    out.append((node, text))
                open_.clear()
                if part is None:
                    stack.pop()
                elif not part.skipped:
                    stack.append((part, iter([*part.parts, None]), []))
                    break


def _content(root: Node) -> list[tuple[Node, str]]:
    """Blocks of text that roles and marks leave, in page order."""
    blocks: list[tuple[Node, str]] = []
    for node in _articles(root):
        _texts(node, blocks)
    return blocks


def main_text(page: str, template: list[int]) -> str:
    """Text of a page without the blocks at some places, which are template."""
    return "\n".join(t for i, (_, t) in enumerate(_content(parse(page))) if i not in template)


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))


def _signed(values: list[int]) -> list[int]:
    return np.array(values, np.uint64).view(np.int64).tolist()


def outline(page: str) -> dict:
    """Depths and label hashes of a page's elements in page order; of each block of text its element, hash, use and place in the content.

    ``body`` is the hash of the longest block of content, None without content.
    """
    root = parse(page)
    depth, label, number, stack = [], [], {}, [(root, 0)]
    while stack:
        node, level = stack.pop()
        number[id(node)] = len(depth)
        depth.append(level), label.append(_hash(node.label))
        stack += [(x, level + 1) for x in reversed(node.blocks())]
    content, everything = _content(root), []
    _texts(root, everything)
    use = MARKED if any(x.tag == "article" for x in _articles(root)) else OPEN
    seen = {id(n) for n, _ in content}
    blocks = [(number[id(n)], _hash(t), use, i) for i, (n, t) in enumerate(content)]
    blocks += [(number[id(n)], _hash(t), COUNTED, -1) for n, t in everything if id(n) not in seen]
    longest = max(content, key=lambda x: len(x[1]), default=None)
    return {"depth": depth, "label": _signed(label), "node": [b[0] for b in blocks], "hash": _signed([b[1] for b in blocks]),
            "use": [b[2] for b in blocks], "place": [b[3] for b in blocks], "body": _signed([_hash(longest[1])])[0] if longest else None}


def _tree(depth: list[int], label: list[int], node: list[int], hashes: list[int]) -> list[Node]:
    """The elements of an outline as a tree, in page order."""
    first = dict(zip(reversed(node), reversed(hashes)))
    out, open_ = [], []
    for i, (level, name) in enumerate(zip(depth, label)):
        out.append(Node("", name, text=first.get(i, 0)))
        del open_[level:]
        if open_:
            open_[-1].parts.append(out[-1])
        open_.append(out[-1])
    return out


def slots(own: list[Node], wrapper: list[Node], node: list[int], hashes: list[int]) -> list[int]:
    """For each block of text of a page, a hash of its slot in the host's wrapper and its text."""
    place = {id(x): i for i, x in enumerate(wrapper)}
    partner = {id(a): place[id(b)] for a, b in align(own[0], wrapper[0])[1]}
    path, open_ = {id(own[0]): 0}, [own[0]]
    while open_:
        x = open_.pop()
        for below in x.blocks():
            path[id(below)] = _hash(f"{path[id(x)]}/{below.label}")
            open_.append(below)
    found = []
    for i, h in zip(node, hashes):
        x = own[i]
        slot = f"s{partner[id(x)]}" if id(x) in partner else f"p{path[id(x)]}"
        found.append(_hash(f"{slot}:{h}"))
    return _signed(found)


def _list(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            found = [outline(x) for x in part.column(3).to_pylist()]
            lists = [_list([x[k] for x in found], pa.int32() if k in ("depth", "node", "use", "place") else pa.int64()) for k in _LISTS]
            yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array([x["body"] for x in found], pa.int64()), *lists],
                                  names=["h", "h2", "host", "body", *_LISTS])


_LISTS = ("depth", "label", "node", "hash", "use", "place")
_OUTLINE = "h long, h2 long, host string, body long, depth array<int>, label array<bigint>, node array<int>, hash array<bigint>, use array<int>, place array<int>"


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of the outlines of a stream sorted by host and part, in which the wrapper's outline comes first."""
    wrapper: list[Node] = []
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            columns = {k: part.column(k).to_pylist() for k in ("kind", "depth", "label", "node", "hash")}
            at, found = [], []
            for i, kind in enumerate(columns["kind"]):
                own = _tree(*(columns[k][i] for k in ("depth", "label", "node", "hash")))
                if kind == 0:
                    wrapper = own
                else:
                    at.append(i), found.append(slots(own, wrapper, columns["node"][i], columns["hash"][i]))
            index = pa.array(at, pa.int64())
            yield pa.record_batch([*(part.column(k).take(index) for k in ("h", "h2", "host", "body", "use", "place")), _list(found, pa.int64())],
                                  names=["h", "h2", "host", "body", "use", "place", "slot"])


_MATCHED = "h long, h2 long, host string, body long, use array<int>, place array<int>, slot array<bigint>"


def _aligned(outlines: DataFrame) -> DataFrame:
    """Every outline with the slots of its blocks, by the wrapper of its host: the outline with the least hash."""
    sizes = outlines.groupBy("host").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 1
    # At most PARTS hosts.
    large = F.broadcast(sizes.filter(F.col("n") * PARTS >= total).select("host", F.ceil(F.col("n") * PARTS / total).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    columns = ("h", "h2", "body", *_LISTS)
    one = F.struct("h", "h2", *(F.col(c) for c in columns[2:])).alias("one")
    first = outlines.groupBy("host").agg(F.min_by(one, F.struct(F.xxhash64("h"), "h2")).alias("one")).join(large, "host", "left").select(
        "host", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), "one.*")
    then = outlines.join(large, "host", "left").select("host", F.pmod("h", parts).cast("int").alias("part"), F.lit(1).alias("kind"), *columns)
    stream = first.unionByName(then).repartition("host", "part").sortWithinPartitions("host", "part", "kind")
    return stream.mapInArrow(_matched, _MATCHED)


def template(aligned: DataFrame) -> DataFrame:
    """Columns host, slot and firm: the constants of each host, and whether they hold in marked articles, too.

    A host has at most 1 / ``SHARE`` times as many of them as a page has blocks.
    """
    texts = aligned.select("host", "body", F.explode("slot").alias("slot")).distinct()
    counted = texts.groupBy("host", "slot").agg(F.count("body").alias("c")).filter(F.col("c") >= LEAST)
    pages = aligned.select("host", "body").distinct().groupBy("host").agg(F.count("body").alias("n"))
    return counted.join(pages, "host").filter(F.col("c") >= SHARE * F.col("n")).select(
        "host", "slot", ((F.col("c") >= FIRM_LEAST) & (F.col("c") >= FIRM_SHARE * F.col("n"))).alias("firm"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id``, url, text and n_chars for each row of ``pages``.

    Null and empty pages, and those without content, have an empty text. A page without a url, or alone on its host, is read by roles
    and marks alone. Repeated rows have equal texts and count once, ids are not used. Other columns are left out; an empty table gives an empty one.
    """
    spark = reachable(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(pages[url].cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    rows = pages.select(pages[page_id].alias("_id"), pages[url].alias("_url"), host.alias("host"), text_of(pages, html).alias("page"))
    rows = rows.select("_id", "_url", "host", F.xxhash64("host", "page").alias("h"), F.xxhash64("page", "host", F.lit(1)).alias("h2"), "page")
    with freeing(spark) as keep:
        outlines = staged(rows.filter("host <> ''").select("h", "h2", "host", "page").mapInArrow(_outlines, _OUTLINE))
        aligned = staged(_aligned(outlines))
        constants = staged(template(aligned))
        content = aligned.select("h", "h2", "host", F.explode(F.arrays_zip("use", "place", "slot")).alias("x")).select("h", "h2", "host", "x.*").filter(
            F.col("use") > COUNTED)
        # One row for each different page of a host that has something to leave out.
        found = keep(staged(content.join(constants, ["host", "slot"]).filter((F.col("use") == OPEN) | F.col("firm"))
                            .groupBy("h", "h2").agg(F.collect_set("place").alias("places"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [main_text(page, places or ()) for page, places in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                      names=["_id", "_url", "text", "n_chars"])

    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (page_id, url))
    return rows.join(found, ["h", "h2"], "left").select("_id", "_url", "page", "places").mapInArrow(
        run, f"_id {id_type}, _url {url_type}, text string, n_chars long").select(F.col("_id").alias(page_id), F.col("_url").alias(url), "text", "n_chars")
