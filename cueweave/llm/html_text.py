"""Main text of web pages by site template removal (operator 10).

Every block element outside the article, and every block inside it that is mostly links, is hashed as a subtree (tag,
class, id, text and what is below). Spark counts on how many different pages of a host each subtree stands; copies of
one page count once. A subtree on at least ``LEAST`` pages and ``SHARE`` of the host's pages belongs to the template and
is deleted, as are elements that say what they are: scripts, styles, menus, headers, footers, sidebars, forms, notices,
adverts and reader comments by tag, class, id or role. Of what is left the main text is the largest ``article``, else
``main``, else an element named as content, else the body. Running text inside an article is never deleted for
recurring: passages that articles share are content.

The templates of a host are at most 1 / SHARE times the subtrees of a page, so one row per host holds them; hosts are
spread over ``SALTS`` keys for the join with pages, so that a hot host is no hot key.

Defined results: null or empty HTML gives an empty text; a null URL has an empty host; broken markup is read to its end,
an unfinished tag or comment at the end is no text; repeated rows get a row each; other columns are never read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import broadcast_if_small
from .common import prepare, query, stored, table
from .url_rules import host_path

#: Pages, and share of the host's pages, on which a subtree of the template stands.
LEAST, SHARE = 4, 0.05
#: Open elements at a time, as in browsers.
DEPTH = 512
#: Keys of a host in the join of pages with templates.
SALTS = 16

# Elements of HTML by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt option optgroup legend summary".split())
#: Start tag -> open elements that it ends, up to one of the elements that hold them.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
P_HOLDERS = {"td", "th", "button", "object", "table"}
DROPPED = RAW | frozenset("head nav header footer aside form button select input dialog menu object canvas audio video label datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of a class or id that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu "
    "topbar masthead header footer breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "widget widgets toolbar pagination pager".split()
)
CONTENT = frozenset("content article story post entry main body text".split())
KEPT = frozenset({"html", "body", "article", "main"})

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
WORDS = re.compile(r"[A-Za-z0-9]+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "size", "links", "main")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.size = self.links = 0
        self.main = tag in ("article", "main")


def parse(text: str) -> Node:
    """Tree of the page: children are nodes and texts with references decoded. Below ``DEPTH`` elements nest no further."""
    root = Node("#root", {}, None)
    stack, position, end = [root], 0, 0

    def end_up_to(tags: set[str], holders: set[str]) -> None:
        """End the open element of ``tags`` that is highest, with all in it, without leaving one of ``holders``."""
        last = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in holders:
                break
            if stack[i].tag in tags:
                last = i
        if last:
            del stack[last:]

    while m := TOKEN.search(text, position):
        if m.start() > end:
            stack[-1].children.append(entities.unescape(text[end : m.start()]))
        position = end = m.end()
        if m[1]:
            end_tag = m[1].lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == end_tag:
                    del stack[i:]
                    break
            continue
        if not m[2]:
            continue
        if not m[4]:  # the page ends inside a tag
            return root
        tag = m[2].lower()
        if tag in CLOSES_P:
            end_up_to({"p"}, P_HOLDERS)
        if tag in SIBLINGS:
            end_up_to(*SIBLINGS[tag])
        attributes = {}
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                attributes.setdefault((a[1] or a[5]).lower(), entities.unescape(a[2] or a[3] or a[4] or ""))
        node = Node(tag, attributes, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW and not (tag in ("svg", "math") and m[3].rstrip().endswith("/")):
            shut = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, end)
            position = end = shut.end() if shut else len(text)
        elif tag not in VOID and tag not in RAW and len(stack) < DEPTH:
            stack.append(node)
    if end < len(text):
        stack[-1].children.append(entities.unescape(text[end:]))
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes below, parents first; no recursion, markup may be nested deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if type(c) is Node)
    return out


def words_of(node: Node) -> set[str]:
    a = node.attributes
    return {w.lower() for w in WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")} if a else set()


def dropped(node: Node) -> bool:
    """Whether an element says that it is no part of the article; one that holds the article stays."""
    if node.tag in DROPPED:
        return True
    a = node.attributes
    if not a or node.tag in KEPT or node.main:
        return node.tag == "article" and bool(words_of(node) & {"comment", "comments", "reply"})
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in DROPPED_ROLES:
        return True
    return "none" in a.get("style", "") and bool(re.search(r"display\s*:\s*none", a["style"])) or bool(words_of(node) & MARKS)


def measured(root: Node) -> list[Node]:
    """All nodes, with the characters below each, those in links, and whether an article is below."""
    every = nodes(root)
    for node in reversed(every):
        own = sum(len(c.strip()) for c in node.children if type(c) is str) if node.tag not in RAW else 0
        node.size += own
        if node.tag == "a":
            node.links = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.main |= node.main and not node.tag == "#root"
    return every


def subtree_hashes(root: Node) -> list[tuple[Node, int]]:
    """Candidates for the template with their hashes: blocks outside the article, and blocks of links inside it."""
    every = measured(root)
    sums: dict[int, int] = {}
    inside: set[int] = set()
    for node in every:
        if node.tag in ("article", "main") or id(node.parent) in inside:
            inside.add(id(node))
    out = []
    for node in reversed(every):
        h = xxhash.xxh64(f"{node.tag} {node.attributes.get('class', '')} {node.attributes.get('id', '')}".encode("utf-8", "surrogatepass"))
        for c in node.children:
            h.update(" ".join(c.split()).encode("utf-8", "surrogatepass") if type(c) is str else sums[id(c)].to_bytes(8, "little"))
        sums[id(node)] = h.intdigest()
        if node.tag in BLOCK and node.tag not in KEPT and node.size and node.tag not in DROPPED:
            if (id(node) in inside and 2 * node.links >= node.size) or (id(node) not in inside and not node.main):
                out.append((node, sums[id(node)] - (1 << 63)))
    return out


def main_text(root: Node, gone: set[int]) -> str:
    """Text of the article, ``gone`` being ids of nodes of the template."""
    every, out = nodes(root), set()
    for node in every:
        if id(node.parent) in out or id(node) in gone or dropped(node):
            out.add(id(node))
    left = [n for n in every if id(n) not in out]
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.attributes.get("role") == "main", lambda n: n.tag in BLOCK and words_of(n) & CONTENT):
        found = [n for n in left if wanted(n)]
        if found:
            root = max(found, key=lambda n: n.size)
            break
    blocks, run = [], []
    todo: list = [root]
    while todo:
        c = todo.pop()
        if type(c) is str:
            run.append(c)
        elif c is None:
            blocks.append("".join(run))
            run = []
        elif id(c) not in out:
            if c.tag == "br":
                run.append(" ")
            if c.tag in BLOCK:
                todo.append(None)
            todo.extend(reversed(c.children))
            if c.tag in BLOCK:
                todo.append(None)
    blocks.append("".join(run))
    return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def site_templates(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host, template: hashes of the subtrees that recur on the host. ``pages`` has host and html."""

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, whole = [], []
            for page in batch.column(1).to_pylist():
                hashes.append(sorted({h for _, h in subtree_hashes(parse(page or ""))}))
                whole.append(xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["host", "page", "hashes"])

    rows = stored(pages.select("host", "html").mapInArrow(subtrees, "host string, page bigint, hashes array<bigint>"), "page-subtrees")
    rows = rows.groupBy("host", "page").agg(F.first("hashes").alias("hashes"))  # copies of a page count once
    of_host = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = rows.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    often = seen.join(of_host, "host").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("pages")))
    return often.groupBy("host").agg(F.collect_set("hash").alias("template"))


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text."""
    prepare(pages.sparkSession)
    host, _ = host_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    templates = stored(site_templates(rows, least, share), "templates").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(broadcast_if_small(templates), ["host", "salt"], "left").select("page_id", "url", "html", "template")
    kind = rows.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                root, known = parse(page or ""), set(template or ())
                out.append(main_text(root, {id(n) for n, h in subtree_hashes(root) if h in known}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return found.mapInArrow(texts, f"page_id {kind}, url string, text string")


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
