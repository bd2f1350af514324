"""HTML extraction: element subtrees that recur on many pages of a host are its template and are deleted."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import row_blocks
from isotherm.llm.tables import staged

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPACE = re.compile(r"\s+")

# Fixed values of the HTML standard: elements without an end tag, elements whose content is not markup, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
# Elements that are never main text, and words in class, id or role that mark such parts.
ASIDE = frozenset(
    "head title script style noscript template iframe svg nav header footer aside form menu dialog button select input textarea"
    " label fieldset object embed canvas audio video".split()
)
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup"
    " modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget related recommended share sharing social"
    " newsletter subscribe subscription signup login comment comments reply replies discussion disqus footer header masthead topbar toolbar"
    " search form pagination pager skip copyright hidden contentinfo complementary".split()
)
_COMMENTS = frozenset("comment comments reply replies discussion disqus".split())
# Words that beside a mark name the same part: "cookie-banner", "footer-inner".
_BESIDE = frozenset("area bar bottom box button buttons container inner left links list right section site top wrap wrapper".split())
_WORD = re.compile(r"[a-z]+")
_MAIN = frozenset(("article", "main"))
# Elements that may be template inside a main element too; paragraphs, headings and lists there are its text.
INNER = frozenset("div section table aside".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}


class Node:
    """``sure``: is or holds a main element. ``holds``: holds the main part of the page, so its tag or mark does not count."""

    __slots__ = ("tag", "marked", "comments", "parts", "sure", "holds", "key")

    def __init__(self, tag: str, marked: bool, comments: bool = False):
        self.tag, self.marked, self.comments, self.parts, self.sure, self.holds, self.key = tag, marked, comments, [], False, False, 0


def has_mark(names: list[str], marks: frozenset[str]) -> bool:
    """Is one of the names a mark, or made of marks and words that stand beside them ("has-sidebar" is not)?"""
    return any(n in marks or (own := set(_WORD.findall(n))) and own & marks and own <= MARKS | _BESIDE for n in names)


def weigh(root: Node) -> None:
    """Tell which elements are or hold the main elements, or else most of the text in paragraphs; without recursion.

    Articles inside a part of comments are comments, unless nothing but that part has main elements or paragraphs.
    """
    order, todo = [], [(root, False, False)]
    while todo:
        node, spoken, para = todo.pop()
        spoken, para = spoken or node.comments, para or node.tag == "p"
        order.append((node, spoken, para))
        todo += [(p, spoken, para) for p in node.parts if isinstance(p, Node) and p.tag not in RAW]
    for talk in (False, True):
        mains: dict[int, int] = {}
        letters: dict[int, int] = {}
        for node, spoken, para in reversed(order):
            counts = talk or not spoken
            below = [p for p in node.parts if isinstance(p, Node)]
            mains[id(node)] = (counts and node.tag in _MAIN) + sum(mains.get(id(p), 0) for p in below)
            own = sum(len(p.strip()) for p in node.parts if isinstance(p, str)) if counts and para else 0
            letters[id(node)] = own + sum(letters.get(id(p), 0) for p in below)
        if mains[id(root)] or letters[id(root)]:
            break
    else:
        talk = False
    for node, _, _ in order:
        node.sure = mains[id(node)] > 0
        if mains[id(root)]:
            node.holds = mains[id(node)] == mains[id(root)]
        else:
            node.holds = 2 * letters[id(node)] > letters[id(root)] and node.tag != "p"
        node.holds |= node.tag in ("html", "body")
        node.comments &= not (talk and node.holds) and node.tag not in ("html", "body")


def parse(page: str) -> Node:
    """A tree of elements and texts; start tags without end end with what encloses them."""
    root = Node("", False)
    stack, at = [root], 0

    def close(upto: int) -> None:
        del stack[max(upto, 1) :]

    def text(raw: str) -> None:
        if raw:
            stack[-1].parts.append(html.unescape(raw) if "&" in raw else raw)

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if found:
                close(found)
            continue
        if tag in BLOCKS and stack[-1].tag != "":
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph with all that is in it
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in _CLOSES.get(tag, ()):
                close(i)
                break
            if stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                break
        attributes = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        named = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split()
        marked = has_mark(named, MARKS) or "hidden" in m[3].lower().split() or attributes.get("aria-hidden") == "true"
        node = Node(tag, marked, has_mark(named, _COMMENTS))
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    text(page[at:])
    weigh(root)
    return root


def hash_subtrees(root: Node) -> None:
    """Give every element a key of its tag, texts and children; leaves first, without recursion."""
    import xxhash

    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(p, False) for p in node.parts if isinstance(p, Node)]
            continue
        shape = "\x01".join(_SPACE.sub(" ", p) if isinstance(p, str) else f"\x02{p.key:x}" for p in node.parts)
        node.key = xxhash.xxh3_64_intdigest(f"{node.tag}\x00{shape}") >> 1


def candidates(root: Node) -> set[tuple[int, int | None]]:
    """Keys of the subtrees that may be template, and the key of the main element that they lie in.

    Outside the main elements that is all that does not hold one; inside, INNER elements only, with ~key for key. A
    main element has an entry for itself, with the key -1. A page without article or main element has no main
    element; there all but html and body may be template.
    """
    out, todo = set(), [(root, None)]
    while todo:
        node, main = todo.pop()
        for p in node.parts:
            if not isinstance(p, Node) or p.tag == "head":
                continue
            within = main
            if p.tag in _MAIN and p.sure:
                within = p.key if main is None else main
                out.add((-1, within))
            elif p.tag not in ("html", "body") and not p.sure and (main is None or p.tag in INNER):
                out.add((p.key if main is None else ~p.key, main))
            todo.append((p, within))
    return out


def dropped(node: Node, in_main: bool, template: frozenset[int]) -> bool:
    """Is the element no part of the main text: comments, an aside, or a template of the host?"""
    if node.comments:
        return True
    if node.tag in _MAIN and node.sure:
        return False
    if not node.holds and (node.tag in ASIDE or node.marked and not node.sure):
        return True
    return not node.sure and (node.tag in INNER and ~node.key in template if in_main else node.key in template)


def blocks(root: Node, template: frozenset[int]) -> list[str]:
    """Texts of the blocks in page order; only the main elements where there are some, without template and asides."""
    out, held = [], []

    def flush() -> None:
        block = _SPACE.sub(" ", "".join(held)).strip()
        if block:
            out.append(block)
        held.clear()

    todo = [(root, not root.sure)]  # inside: a main element has begun, or there is none
    while todo:
        node, inside = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                held.append(node)
        elif node.tag == "br":
            held.append(" ")
        elif not dropped(node, inside and root.sure, template):
            inside = inside or node.tag in _MAIN
            block = node.tag in BLOCKS
            todo += [(None, inside)] * block + [(p, inside) for p in reversed(node.parts)] + [(None, inside)] * block
    flush()
    return out


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("_host"))


def templates(pages: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """``_host, _keys``: for each host the subtrees on at least ``least_pages`` pages and more than ``ratio`` of them.

    Those inside main elements are counted once for each distinct main element, so copies of one do not make it template.
    """

    def keys(batches):
        for batch in row_blocks(batches, "html"):
            out = []
            for page in batch.column("html").to_pylist():
                root = parse(page or "")
                hash_subtrees(root)
                out.append([{"key": k, "main": m} for k, m in candidates(root)])
            yield pa.record_batch([batch.column("_host"), pa.array(out, pair)], names=["_host", "_keys"])

    pair = pa.list_(pa.struct([("key", pa.int64()), ("main", pa.int64())]))
    rows = _with_host(pages).select("_host", "html").mapInArrow(keys, "_host string, _keys array<struct<key: long, main: long>>")
    # One pass: a page's own row has no key, so a host's pages are counted beside its subtrees, and its main elements by the key -1.
    each = rows.select("_host", F.explode(F.concat(F.col("_keys"), F.expr("array(named_struct('key', CAST(NULL AS BIGINT), 'main', CAST(NULL AS BIGINT)))"))).alias("_pair"))
    once = each.groupBy("_host", F.col("_pair.key").alias("_key"), F.col("_pair.main").alias("_main")).agg(F.count("*").alias("_n"))
    counted = once.groupBy("_host", "_key").agg(F.sum(F.when(F.col("_main").isNull(), F.col("_n")).otherwise(1)).alias("_n"))
    counted = staged(counted.where((F.col("_n") >= least_pages) | F.col("_key").isNull() | (F.col("_key") == -1)), "subtrees")
    total = "_key IS NULL OR _key = -1"
    totals = counted.where(total).select("_host", F.col("_key").isNotNull().alias("_inner"), F.col("_n").alias("_pages"))
    return (
        counted.where(f"NOT ({total})").withColumn("_inner", F.col("_key") < 0).join(totals, ["_host", "_inner"])
        .where(F.col("_n") > F.lit(ratio) * F.col("_pages"))
        .groupBy("_host").agg(F.collect_list("_key").alias("_keys"))
    )


def extract(pages: DataFrame, ratio: float = 0.2, least_pages: int = 5) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each row of ``pages`` (page_id, url, html).

    Deleted are subtrees that recur on the host, parts that are never main text (navigation, forms, scripts ...)
    and parts whose class, id or role says so, but not if they hold the main elements (or, where there are none, more
    than half of the text in paragraphs). Where a page has article or main elements, its text is what stands in them,
    without comments and without div, section, table and aside elements in them that recur in the host's distinct
    main elements; other repeated text in them is kept. A null or empty page has an empty text; pages without a
    readable host form one host; repeated rows are pages of their own.
    """
    found = staged(templates(pages, ratio, least_pages), "templates")

    def texts(batches):
        for batch in row_blocks(batches, "html"):
            out = []
            for page, keys in zip(batch.column("html").to_pylist(), batch.column("_keys").to_pylist()):
                root = parse(page or "")
                if keys:
                    hash_subtrees(root)
                out.append("\n".join(blocks(root, frozenset(keys or ()))))
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = _with_host(pages).join(found, "_host", "left").select("page_id", "url", "html", "_keys")
    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
