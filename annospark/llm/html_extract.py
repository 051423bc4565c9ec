"""Main text of web pages by a site style tree.

Each page is read into elements; an element's style is the path of tag names
and classes from the root.  The trees of all pages of one host are merged: for
each style of a host, how many pages have it, what it looks like there, and for
each text under it, on how many pages that text occurs.  A style's importance is

* presentation: the entropy of its looks over the pages (the tags of its
  elements' children and the order of magnitude of their own text), to the base
  of the number of pages;
* content: one minus the mean entropy of its texts over the pages (a text on
  one page only is as important as can be, one on all pages not at all);

joined as 1 - (1 - presentation / 2) * (1 - content).  Blocks directly in a
style of low importance that enough pages have are removed; the branch below
it goes with them only if the most important style of the branch is low too.

A style's weight is the number of its words, each counted by the importance of
its text.  A container that comes once on a page and whose branch holds half of
the host's weight is a main branch; main branches lie inside one another.  The
branches beside a main one that hold less than a tenth of the host's weight are
removed from the pages that have the main branch (headings stay).  So the tree
removes menus, adverts and footers also where their texts differ from page to
page.

Two lists of kinds help the tree: elements that never hold text of the page
(scripts, forms and so on) do not enter it, and elements whose kind says that
they are beside the article (navigation, footers; classes and ids all of whose
words name adverts, notices or comments) are removed also where a host has too
few pages for statistics.  Headers inside an article belong to it.

Statistics are sums over (host, style, text hash); pages get their host's list
of removed styles by a join.

Defined results: null or empty html gives the empty text; pages without a host
share one tree; repeated pages are extracted each, but count once in the
statistics of their host (pages with the same texts outside dropped kinds); cut-off pages are read as far
as they go; unknown tags count as inline.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.llm.common import let, slices, stored
from annospark.llm.url_filter import split_url

LEAST_IMPORTANCE, LEAST_PAGES = 0.35, 8
MAIN_SHARE, LEAST_SHARE = 0.5, 0.1  # of the host's weight: a main branch, and branches beside it that stay
BROADCAST_CHARS = 8_000_000  # removed styles are broadcast up to here; beyond, a join whose large hosts Spark splits (AQE)
# Kinds of elements.
DROPPED = set("head script style noscript template form iframe object embed svg canvas button "
              "select textarea option input label dialog audio video map".split())
BESIDE = set("nav header footer aside menu".split())
HIDDEN_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
NOISE_WORDS = set("ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion "
                  "cookie cookies consent notice notices alert popup modal newsletter subscribe signup login nav navbar "
                  "navigation menu breadcrumb breadcrumbs sidebar widget footer header masthead toolbar social share "
                  "sharing related recommended comment comments reply replies respond disqus pagination pager".split())
PLACE_WORDS = set("site page main top bottom left right user reader box bar block wrapper wrap container content inner outer "
                  "section area list item items slot unit links link buttons form thread text body row column".split())
IN_ARTICLE = set("header masthead banner".split())  # kinds that belong to an article when inside it
BLOCKS = set("form nav header footer aside dialog menu address article blockquote body caption dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
             "hr html li main ol p pre section summary table tbody td tfoot th thead tr ul center".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
# an open element that the start of one of these closes
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
           "th": {"table", "tr"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
                    re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME_WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "style", "kind", "children", "in_article")

    def __init__(self, tag: str, style: str, kind: int, in_article: bool):
        self.tag, self.style, self.kind, self.children, self.in_article = tag, style, kind, [], in_article


WHAT = ["own", "branch", "main", "beside"]  # kinds of styles that pages get from their host's tree
TEXT, ASIDE, NEVER = 0, 1, 2  # kinds of blocks: no known kind, beside the article, never text of the page


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if "=" in text else {}


def _names_noise(name: str, in_article: bool) -> bool:
    words = set(_NAME_WORDS.findall(name))
    noise = words & (NOISE_WORDS - IN_ARTICLE if in_article else NOISE_WORDS)
    return bool(noise) and words <= NOISE_WORDS | PLACE_WORDS


def _kind(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    role = attrs.get("role", "").lower()
    if tag in DROPPED or attrs.get("aria-hidden") == "true":
        return NEVER
    if tag in ("html", "body", "article", "main"):
        return TEXT
    if (tag in BESIDE or role in HIDDEN_ROLES) and not (in_article and {tag, role} & IN_ARTICLE):
        return ASIDE
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    return ASIDE if any(_names_noise(name, in_article) for name in names) else TEXT


def read_page(page: str | None) -> tuple[list[tuple[str, str, int]], dict[str, list[str]]]:
    """Blocks (style, text, kind) in page order, and for each style the child tags of each of its elements."""
    blocks: list[tuple[str, str, int]] = []
    children: dict[str, list[str]] = {}
    if not page:
        return blocks, children
    stack = [Element("", "", TEXT, False)]
    words: list[str] = []

    def holder() -> Element:
        return next((e for e in reversed(stack) if e.tag in BLOCKS or e.kind or not e.tag), stack[0])

    def flush():
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                at = holder()
                blocks.append((at.style, text, at.kind))

    def close(depth: int):
        while len(stack) > depth:
            e = stack[-1]
            if e.tag in BLOCKS or e.kind:
                flush()
            stack.pop()
            children.setdefault(e.style, []).append(" ".join(e.children))

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            words.append(html_lib.unescape(page[at:]))
            break
        if m.start() > at:
            words.append(html_lib.unescape(page[at:m.start()]))
        at = m.end()
        if not m[2]:
            continue  # comment or declaration
        tag = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                close(depth)
            continue
        if tag == "br":
            words.append(" ")
            continue
        for k in range(len(stack) - 1, 0, -1):  # end tags left out
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                close(k)
                break
            if stack[k].tag in HOLDERS.get(tag, ()) or stack[k].tag in BLOCKS and stack[k].tag not in CLOSED_BY:
                break
        attrs = _attributes(m[3])
        parent = stack[-1]
        kind = max(parent.kind, _kind(tag, attrs, parent.in_article))
        if tag in BLOCKS or kind > parent.kind:
            flush()
        parent.children.append(tag)
        if tag in VOID or m[3].endswith("/"):
            continue
        names = ".".join(sorted(attrs.get("class", "").lower().split()))
        stack.append(Element(tag, f"{parent.style}/{tag}{'.' + names if names else ''}", kind,
                             parent.in_article or tag in ("article", "main")))
        if tag in RAW:  # up to the end tag there is no markup inside
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
    close(1)
    flush()
    return blocks, children


def above(style: str) -> list[str]:
    """The style and the styles that it lies in, without the root."""
    parts = style.split("/")
    return ["/".join(parts[:d]) for d in range(2, len(parts) + 1)]


def style_rows(pages: DataFrame) -> DataFrame:
    """(host, style, text, words, look, elements, page): a row per block (hash of its text, its words) and per style
    (hash of its look and number of its elements; text null); ``page`` is a hash of the page's texts, equal for copies."""
    schema = "host string, style string, text long, words long, look long, elements long, page long"

    def run(batches):
        for batch in slices(batches, 128):
            out = [[] for _ in range(7)]
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks, children = read_page(page)
                blocks = [(s, t) for s, t, kind in blocks if kind != NEVER]
                own: dict[str, int] = {}
                for style, text in blocks:
                    own[style] = own.get(style, 0) + len(text.split())
                rows = [(s, zlib.crc32(t.encode()), len(t.split()), None, None) for s, t in set(blocks)]
                for style in {a for s in own for a in above(s) or [s]}:
                    tags = children.get(style, [])
                    look = f"{'|'.join(tags)} {own.get(style, 0).bit_length()}"
                    rows.append((style, None, None, zlib.crc32(look.encode()), len(tags)))
                whole = "\n".join(t for _, t in blocks).encode()
                key = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True)
                for row in rows:
                    for column, value in zip(out, (host, *row, key)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.string() if k < 2 else pa.int64()) for k in range(7)],
                                             names=["host", "style", "text", "words", "look", "elements", "page"])

    return pages.select("host", "html").mapInArrow(run, schema)


def importance(pages: DataFrame, copies: bool = True) -> DataFrame:
    """(host, style, n_pages, elements, presentation, content, importance, weight) of every style of every host; without
    ``copies``, pages of a host with the same texts count as one.  A style without own text has no content (null), and
    its importance is that of its presentation."""
    styles = style_rows(pages)
    counts = (styles if copies else styles.distinct()).groupBy("host", "style", "text", "words", "look", "elements").agg(
        F.count("*").alias("c"))
    # looks that differ only in the number of elements do not occur: a look tells its elements
    is_look, c_log_c = F.col("text").isNull(), F.col("c") * F.log("c")
    # plain sums, so a style that fills a large host is summed before the shuffle
    sums = counts.groupBy("host", "style").agg(
        F.sum(F.when(is_look, F.col("c"))).alias("n_pages"), F.sum(F.when(is_look, c_log_c)).alias("looks"),
        F.sum(F.col("c") * F.col("elements")).alias("n_elements"),
        F.sum(F.when(~is_look, F.col("c"))).alias("n_texts"), F.sum(F.when(~is_look, c_log_c)).alias("texts"),
        F.sum(F.col("words") * F.col("c")).alias("n_words"), F.sum(F.col("words") * c_log_c).alias("word_logs"))
    base = F.log(F.greatest(F.col("n_pages"), F.lit(2)))
    # entropy of shares c / n: log(n) - sum(c log(c)) / n
    presentation = (F.log("n_pages") - F.col("looks") / F.col("n_pages")) / base
    # a text that occurs evenly on c of n pages has entropy log(c) / log(n); weighted by its occurrences
    content = 1 - F.col("texts") / F.col("n_texts") / base
    weight = F.coalesce(F.greatest(F.col("n_words") - F.col("word_logs") / base, F.lit(0.0)), F.lit(0.0))
    joined = 1 - (1 - F.col("presentation") / 2) * (1 - F.coalesce("content", F.lit(0.0)))
    return (sums.select("host", "style", "n_pages", (F.col("n_elements") / F.col("n_pages")).alias("elements"),
                        presentation.alias("presentation"), content.alias("content"), weight.alias("weight"))
            .withColumn("importance", joined))


def removed_styles(styles: DataFrame) -> DataFrame:
    """(host, style, what) of :func:`importance`: ``own`` (the style's own blocks go), ``branch`` (all below goes too),
    ``main`` (a main branch, the innermost only) and ``beside`` (branches that go where the main one is)."""
    paths = let(F.split("style", "/"), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/")))
    each = styles.select("host", "style", "n_pages", "elements", "importance", "weight",
                         F.col("content").isNotNull().alias("has_text"), F.explode(paths).alias("at"))
    own = F.col("style") == F.col("at")
    # a style's own values and the largest importance and the weight of its branch, in one grouping
    branch = each.groupBy("host", "at").agg(
        F.max(F.when(own, F.col("n_pages"))).alias("n_pages"), F.max(F.when(own, F.col("elements"))).alias("elements"),
        F.max(F.when(own & F.col("has_text"), F.col("importance"))).alias("importance"),
        F.max(F.when(F.col("has_text"), F.col("importance"))).alias("most"),
        F.sum(F.when(own, F.col("weight"))).alias("own_weight"), F.sum("weight").alias("weight"))
    branch = stored(branch, "style-branches")
    enough = F.col("n_pages") >= LEAST_PAGES
    low = branch.where(enough & (F.col("importance") < LEAST_IMPORTANCE)).select(
        "host", F.col("at").alias("style"), F.when(F.col("most") < LEAST_IMPORTANCE, "branch").otherwise("own").alias("what"))
    whole = branch.where(F.col("at") == "").select(F.col("host").alias("h"), F.col("weight").alias("all"))
    shares = branch.where(F.col("at") != "").join(whole, F.col("host").eqNullSafe(F.col("h"))).select(
        "host", "at", F.regexp_replace("at", "/[^/]*$", "").alias("parent"), "n_pages",
        (F.col("weight") < F.col("all") * LEAST_SHARE).alias("light"),
        (enough & (F.col("elements") < 1.05) & (F.col("weight") > F.col("all") * MAIN_SHARE)
         & (F.col("own_weight") < F.col("weight") * 0.5)).alias("main"))
    mains = shares.where("main").groupBy("host").agg(  # at most one at each depth, all on one path
        F.max(F.struct(F.length("at").alias("n"), F.col("at").alias("inner"))).alias("m"), F.collect_set("parent").alias("parents"))
    mains = mains.select(F.col("host").alias("h"), "m.inner", "parents")
    beside = (shares.where(F.col("light") & enough & ~F.regexp_extract("at", "([^/.]*)[^/]*$", 1).rlike("^h[1-6]$"))
              .join(mains, F.col("host").eqNullSafe(F.col("h")) & F.array_contains("parents", F.col("parent")))
              .select("host", F.col("at").alias("style"), F.lit("beside").alias("what")))
    return low.unionByName(beside).unionByName(
        mains.select(F.col("h").alias("host"), F.col("inner").alias("style"), F.lit("main").alias("what")))


def main_blocks(blocks: list[tuple[str, str, int]], own, branch, main, beside) -> list[str]:
    """Texts of the blocks that stay, by the lists of the host's removed styles (None: none)."""
    gone, below = set(own or ()) | set(branch or ()), tuple(g + "/" for g in branch or ())
    main = tuple(m + "/" for m in main or ())
    if any((s + "/").startswith(main) for s, _, kind in blocks if not kind):
        below += tuple(g + "/" for g in beside or ())
    return [t for s, t, kind in blocks if not kind and s not in gone and not (s + "/").startswith(below)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the important blocks of every whole page, joined by two line ends."""
    host, _ = split_url(F.col(url_col).cast("string"))
    rows = pages.select(pages[id_col], pages[url_col], host.alias("host"), F.col(html_col).cast("string").alias("html"))
    styles = stored(removed_styles(importance(rows, copies=False)), "removed-styles")
    chars = styles.agg(F.sum(F.length("host") + F.length("style"))).first()[0] or 0
    removed = styles.groupBy("host").agg(  # styles of one host on LEAST_PAGES pages each
        *[F.collect_set(F.when(F.col("what") == what, F.col("style"))).alias(what) for what in WHAT])
    if chars <= BROADCAST_CHARS:
        removed = F.broadcast(removed)  # the pages of a large host stay where they are
    joined = rows.join(removed, "host", "left").select(id_col, url_col, "html", *WHAT)
    schema = T.StructType([joined.schema[0], joined.schema[1], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in slices(batches, 128):
            texts = []
            for page, *what in zip(*[batch.column(k).to_pylist() for k in range(2, 3 + len(WHAT))]):
                texts.append("\n\n".join(main_blocks(read_page(page)[0], *what)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[f.name for f in schema])

    return joined.mapInArrow(run, schema)
