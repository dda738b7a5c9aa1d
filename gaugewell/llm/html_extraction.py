"""Main text of web pages by wrapper induction over the pages of a host.

Pages of one host are dealt into chunks; within a chunk the trees are aligned with one of them by simple tree
matching. A slot, the path of a node's labels, is constant where nearly all aligned pages of the host say the same:
template. Slots that vary are content. Elements that the page itself marks as menus, headers, footers, sidebars,
notices, adverts, forms, scripts or comments are left out whether they vary or not, since such parts often do. What the
page marks as an article is content, whatever repeats in it, and varying text beside it is not, unless there is more of
it than of marked text: then the marks do not hold the article, and it is content too. Text that is only in a marked
main part has to vary, and cards, articles with a block of links that stand beside other text, are left out.

Pages become skeletons (labels and text hashes) before they are shuffled by host and salt; equal skeletons count once.
Pages that have a slot are summed over all chunks by (host, slot), those that say a text there by (host, slot, text), so
that a host of any size is spread over tasks, a text is held against all pages of the host, and its template is a few rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.html_tree import BLOCK, RAW, Matcher, Node, clean, parse
from gaugewell.llm.session import cut, written
from gaugewell.llm.spread import join_unique

CHUNK = 24
#: Template entries up to which all templates are broadcast; past that only those of hot hosts are.
BROADCAST_ENTRIES = 1_000_000
#: A host of a given size is spread over as many groups, whatever its share of all pages.
SALTS = 64
#: Different pages of a host that must be aligned at a slot, and the share of them that must agree, for a template.
LEAST_PAGES = 4
CONSTANT = 0.8
#: A block whose letters are mostly those of links is a menu.
LINK_SHARE = 0.6
CHROME_TAGS = frozenset("head nav aside footer form button dialog menu search fieldset".split()) | RAW
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article.
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus form gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related recommended reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
EDGE_NAMES = frozenset("footer header masthead topbar".split())


PAGE_TAGS = frozenset("article main body html".split())
#: Chrome tags that some pages put around all of themselves.
WRAPPERS = frozenset("form fieldset".split())


def is_chrome(node: Node, in_article: bool, holds_main: Callable[[Node], bool]) -> bool:
    """Whether the page marks ``node`` as something other than its article.

    Page, main part and article are what their tags say, save for an article whose class or id as a whole is a chrome word
    (a comment). Elsewhere such a name marks chrome; a word in a longer name, and a form, do so unless ``holds_main``: the
    element is around most of the page's marked text.
    """
    if node.tag in PAGE_TAGS:
        return node.tag == "article" and (node.role in CHROME_ROLES or not CHROME_NAMES.isdisjoint(node.says))
    if node.role in CHROME_ROLES or not CHROME_NAMES.isdisjoint(node.says) or node.tag in CHROME_TAGS:
        return not (node.tag in WRAPPERS or node.role == "form") or not CHROME_NAMES.isdisjoint(node.says) or not holds_main(node)
    if not CHROME_NAMES.isdisjoint(node.hints):
        return not holds_main(node)
    return not in_article and (node.tag == "header" or not EDGE_NAMES.isdisjoint(node.says) or not EDGE_NAMES.isdisjoint(node.hints) and not holds_main(node))


def marked_letters(root: Node) -> dict[int, int]:
    """Of each element, by its ``id``, the letters in articles and main parts in it or around it that are no chrome themselves."""
    found: dict[int, int] = {}
    todo: list = [(root, False, False)]
    while todo:
        node, inside, ready = todo.pop()
        own = inside or is_main(node) and not (node.tag == "article" and is_chrome(node, False, lambda _: True))
        if ready:
            found[id(node)] = sum((len(x) if own else 0) if isinstance(x, str) else found[id(x)] for x in node.parts)
        elif node.tag in RAW:
            found[id(node)] = 0
        else:
            todo.append((node, inside, True))
            todo += [(x, own, False) for x in node.parts if not isinstance(x, str)]
    return found


def is_main(node: Node) -> bool:
    """Whether the page marks ``node`` as its article."""
    return node.tag == "main" or node.role == "main" or is_exact(node)


def is_exact(node: Node) -> bool:
    """Whether all of ``node`` is marked as article, and not only as the part of the page that holds it."""
    return node.tag == "article" or node.role in ("article", "articlebody")


def digest(text: str) -> int:
    """A 63-bit hash of a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


@lru_cache(maxsize=100_000)
def below(path: int, label: str) -> int:
    """The slot of a node with ``label`` under the slot ``path``; 0 is the page. A hash, so that depth costs nothing."""
    return digest(f"{path}/{label}")


class Text:
    """A block of text: the path of its slot, its words, the letters of its links, the outermost marked part it is in, and whether it is in an article."""

    __slots__ = ("path", "parts", "linked", "article", "exact")

    def __init__(self, path: int, article: Node | None, exact: bool) -> None:
        self.path, self.parts, self.linked, self.article, self.exact = path, [], 0, article, exact


def text_blocks(root: Node) -> list[Text]:
    """The blocks of a page outside marked chrome, in page order; an article in an article belongs to the outer one."""
    blocks = [Text(0, None, False)]
    letters: dict[int, int] = {}

    def holds_main(node: Node) -> bool:
        if not letters:
            letters.update(marked_letters(root))
        return 2 * letters[id(node)] > letters[id(root)]

    todo: list = [(root, 0, None, False, False, True)]
    while todo:
        node, path, article, exact, link, opening = todo.pop()
        if isinstance(node, str):
            if blocks[-1].path != path or blocks[-1].article is not article or blocks[-1].exact != exact:
                blocks.append(Text(path, article, exact))
            blocks[-1].parts.append(node)
            blocks[-1].linked += len(node.strip()) if link else 0
            continue
        if not opening or node.tag in BLOCK and node.tag != "#page":
            blocks.append(Text(path, article, exact))
            if not opening:
                continue
        if node.tag == "br":
            blocks[-1].parts.append(" ")
            continue
        if is_chrome(node, article is not None, holds_main):
            continue
        held = exact
        if node.tag in BLOCK:
            inside = below(path, node.label)
            outer, article = article, article or (node if is_main(node) else None)
            held = exact or is_exact(node)
            todo.append((node, path, outer, exact, False, False))
        else:
            inside = path
        todo += [(part, inside, article, held, link or node.tag == "a", True) for part in reversed(node.parts)]
    return blocks


def extract(source: str, template: frozenset[tuple[int, int]] = frozenset()) -> str:
    """Main text of a page, given the (slot, text hash) pairs of its host's template."""
    found = [(block, clean("".join(block.parts))) for block in text_blocks(parse(source)) if block.parts]
    found = [(block, text) for block, text in found if text]
    menus = [block.linked > LINK_SHARE * len(text) for block, text in found]
    varying = [not menu and (block.path, digest(text)) not in template for (block, text), menu in zip(found, menus, strict=True)]
    marked, cards, telling = Counter(), set(), set()
    for (block, text), menu, varies in zip(found, menus, varying, strict=True):
        if block.article is not None:
            marked[id(block.article)] += len(text)
            if menu and is_exact(block.article):
                cards.add(id(block.article))
            if block.exact or varies:
                telling.add(id(block.article))
    chosen = set(marked) - cards
    # An article with most of the marked text is none of the cards; where there are only cards, they are the text.
    if marked:
        best, most = marked.most_common(1)[0]
        if 2 * most > sum(marked.values()):
            chosen.add(best)
    chosen = chosen or set(marked)
    # In a main part without article or varying text the marks alone decide.
    inside = [id(b.article) in chosen and (b.exact or varies or id(b.article) not in telling) if b.article is not None else False for (b, _), varies in zip(found, varying, strict=True)]
    beside = [b.article is None and varies for (b, _), varies in zip(found, varying, strict=True)]
    letters = lambda some: sum(len(text) for (_, text), one in zip(found, some, strict=True) if one)
    if letters(beside) > letters(inside):
        inside = [one and id(b.article) not in cards or other for (b, _), one, other in zip(found, inside, beside, strict=True)]
    return "\n\n".join(text for (_, text), one in zip(found, inside, strict=True) if one)


def _flat(root: Node) -> str:
    """A tree as lines ``depth label hashes``, for the shuffle; a block has one hash for each run of its own text.

    Inline elements are part of the block around them, and runs end where :func:`text_blocks` ends a block.
    """
    lines, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        runs, inner, walk = [[]], [], list(reversed(node.parts))
        while walk:
            part = walk.pop()
            if isinstance(part, str):
                runs[-1].append(part)
            elif part.tag in BLOCK:
                runs.append([])
                if part.tag != "head":
                    inner.append(part)
            elif part.tag == "br":
                runs[-1].append(" ")
            elif part.tag not in CHROME_TAGS:
                walk += reversed(part.parts)
        texts = [text for text in (clean("".join(run)) for run in runs) if text]
        lines.append(f"{depth} {node.label} {','.join(str(digest(text)) for text in texts)}")
        todo += [(part, depth + 1) for part in reversed(inner)]
    return "\n".join(lines)


class _Slot(Node):
    """A node of a skeleton."""

    __slots__ = ("texts", "path", "name")

    def __init__(self, name: str, texts: list[int], path: int) -> None:
        self.name, self.texts, self.path, self.parts = name, texts, path, []

    @property
    def label(self) -> str:
        return self.name


def _grown(lines: str) -> tuple[_Slot, int]:
    stack: list[_Slot] = []
    count = 0
    for line in lines.split("\n"):
        depth, name, texts = line.split(" ")
        del stack[int(depth) :]
        node = _Slot(name, [int(x) for x in texts.split(",") if x], below(stack[-1].path, name) if stack else 0)
        if stack:
            stack[-1].parts.append(node)
        stack.append(node)
        count += 1
    return stack[0], count


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Copies in one batch are dropped before the shuffle, the others where they meet.
        found = dict.fromkeys((host, _flat(parse(x))) for host, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        hosts, flat = [host for host, _ in found], [tree for _, tree in found]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([digest(x) % SALTS for x in flat], pa.int32()), pa.array(flat, pa.string())], names=["host", "salt", "tree"])


def _chunk_slots(host: str, trees: list[str]) -> list[tuple[str, int, int, int]]:
    """(host, slot, text, pages that say it there) of one chunk; with text 0, the pages aligned at the slot.

    A page counts once for a slot and once for a text in it.
    """
    grown = sorted((_grown(tree) for tree in trees), key=lambda x: x[1])
    pages = [root for root, _ in grown]
    middle = pages.pop(len(pages) // 2)
    matcher = Matcher([middle, *pages])
    counts: Counter = Counter()
    for page in [middle, *pages]:
        counts.update({(slot.path, text) for slot, node in matcher.matched(middle, page) for text in (0, *node.texts)})
    return [(host, path, text, n) for (path, text), n in counts.items()]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("slot", pa.int64()), ("text", pa.int64()), ("pages", pa.int64())])
    now, trees = None, []

    def out() -> pa.RecordBatch:
        rows = _chunk_slots(now, trees) if trees else []
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    last = None
    for batch in batches:
        for host, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (host, tree) == last:
                continue
            last = host, tree
            if host != now or len(trees) == CHUNK:
                yield out()
                now, trees = host, []
            trees.append(tree)
    yield out()


def induced_templates(pages: DataFrame) -> DataFrame:
    """Template of every host: ``host`` and ``template``, an array of (slot, text) of its constant nodes.

    ``pages`` has ``host`` and ``html``. Pages of one skeleton count once; hosts of fewer than :data:`LEAST_PAGES`
    different pages have no template.
    """
    trees = pages.mapInArrow(_skeletons, "host string, salt int, tree string")
    dealt = trees.repartition("host", "salt").sortWithinPartitions("host", "salt", "tree").select("host", "tree")
    slots = dealt.mapInArrow(_slots, "host string, slot long, text long, pages long")
    # Read twice below: written once, so that trees are aligned once.
    sums = written(slots.groupBy("host", "slot", "text").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= CONSTANT * LEAST_PAGES), "slots")
    # Of a slot with enough pages no text that fewer say can be constant.
    aligned = sums.where((F.col("text") == 0) & (F.col("pages") >= LEAST_PAGES)).select("host", "slot", F.col("pages").alias("aligned"))
    constant = sums.where(F.col("text") != 0).join(aligned, ["host", "slot"]).where(F.col("pages") >= CONSTANT * F.col("aligned"))
    return constant.groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("template"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, frozenset] = {}
    for batch in batches:
        texts = []
        for host, source, template in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = frozenset((x["slot"], x["text"]) for x in template.as_py() or ())
            texts.append(extract(source, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (``page_id``, ``url``, ``html``): ``page_id``, ``url``, ``text``.

    Blocks are joined in page order by a blank line; character references are decoded, runs of white space in a
    block are one space. A null or empty page, or one without main text, gives the empty string. Rows without url
    form a host of their own; repeated rows and ids give a row each. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(host.alias("host"), "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    templates = cut(induced_templates(rows.select("host", "html")))
    few = (templates.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_ENTRIES
    met = join_unique(rows, templates, "host", "left", few).select("host", "page_id", "url", "html", "template")
    return met.mapInArrow(_extracted, "page_id long, url string, text string")
