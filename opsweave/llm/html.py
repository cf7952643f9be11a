"""Main text of web pages: templates deduced from pages of one host, and the slots that remain."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsweave.llm.common import written

#: Pages that a template must be seen on, and tokens that an equivalence class must have.
MIN_PAGES, MIN_TOKENS = 5, 3

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*(?:>|\Z)"
                  r"|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li",
         "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td",
         "tfoot", "th", "thead", "tr", "ul", "caption"}
#: Elements whose end tag may be left out: the next block ends them.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: Elements that hold no main text, and words of class, id and role that say so of others.
ASIDE = {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "button", "select", "menu", "dialog", "svg",
         "canvas", "object", "video", "audio", "fieldset"}
#: Words that stand beside them in such names and change nothing.
PLACE_WORDS = set("""site page main top bottom left right global primary secondary inner outer box bar block slot unit area container
    wrapper wrap list links text inline mobile desktop sticky fixed small big""".split())
#: Elements that are aside by their own class at most if it says what they are, not what they hold.
OWN = {"html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE_ASIDE = {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "comment", "reply", "related", "recommended"}
ASIDE_WORDS = set("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu
    nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice alert popup modal
    overlay newsletter subscribe subscription share sharing social related recommended comment comments reply replies
    disqus widget login signup search searchbox pagination pager toolbar complementary contentinfo hidden""".split())


class Block:
    """A run of text between block tags: its words, where it stands, and what to make of it."""

    __slots__ = ("path", "text", "aside", "main", "linked")

    def __init__(self, path: str, text: str, aside: bool, main: bool, linked: bool):
        self.path, self.text, self.aside, self.main, self.linked = path, text, aside, main, linked


def _says_aside(name: str, token: str) -> bool:
    """Whether one class, id or role names an aside: its words all do, or only say where it is."""
    parts = _WORD.findall(token.lower())
    if name == "article":
        return len(parts) == 1 and parts[0] in ARTICLE_ASIDE
    return bool(parts) and not ASIDE_WORDS.isdisjoint(parts) and all(p in ASIDE_WORDS or p in PLACE_WORDS for p in parts)


def _is_aside(name: str, attributes: str) -> bool:
    """By the element's name, or by a class, id or role as a whole: `site-footer` is, `content-sidebar-wrap` and `has-sidebar`
    are not, as they name what holds an aside, not the aside."""
    if name in ASIDE:
        return True
    if name in OWN or "=" not in attributes:
        return False
    return any(_says_aside(name, token) for found in _ATTRIBUTE.finditer(attributes)
               for token in (found[2] or found[3] or found[4] or "").split())


def parse(html: str) -> tuple[list[str], list[Block]]:
    """Tag tokens in page order (path and class of each opened element), and the blocks of text.

    Tolerates what pages do: missing end tags, stray end tags, cut-off ends, unquoted
    attributes. Comments, scripts, styles and titles are no text; character references are
    decoded; white space becomes one space; a line break is white space. Text is taken with the state it is read
    under: an aside within a line drops its own words only, and one that is not closed ends with its parent.
    """
    tags: list[str] = []
    blocks: list[Block] = []
    stack: list[str] = []
    words: list[str] = []
    plain = linked = 0  # characters outside and inside links
    skip, depth, floor, main, in_link = "", 0, 0, 0, 0  # an aside ends when its parent, at `floor`, is closed

    def flush() -> None:
        nonlocal plain, linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                blocks.append(Block("/".join(stack), text, skip in BLOCK, main > 0, linked > plain))
            words.clear()
        plain = linked = 0

    at, end = 0, len(html)
    while at < end:
        found = _TAG.search(html, at)
        upto = found.start() if found else end
        if upto > at:
            text = unescape(html[at:upto])
            if skip and skip not in BLOCK:
                words.append(" ")  # an aside within a line
            else:
                words.append(text)
                if in_link:
                    linked += len(text)
                else:
                    plain += len(text)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:  # an end tag
            if name in BLOCK:
                flush()
            if name == skip:
                depth -= 1
                if not depth:
                    skip = ""
            if name in ("article", "main") and main and not skip:
                main -= 1
            if name == "a" and in_link:
                in_link -= 1
            if name in stack:
                while stack.pop() != name:
                    pass
                if skip and len(stack) < floor:
                    skip, depth = "", 0
            continue
        attributes = found[3]
        if name in BLOCK:
            flush()
            if skip in LOOSE or (skip in ("nav", "header") and name in ("article", "main")) or (skip == "head" and name == "body"):
                skip = ""
            if stack and stack[-1] in LOOSE and (stack[-1] == "p" or stack[-1] == name):
                stack.pop()
                if skip and len(stack) < floor:
                    skip, depth = "", 0
        kind = name
        if "class" in attributes and (c := _ATTRIBUTE.search(attributes)) and c[1].lower() == "class":
            kind += "." + (c[2] or c[3] or c[4] or "")
        tags.append("/".join(stack) + "/" + kind)
        if name == "br":
            words.append(" ")
        if name in VOID or attributes.endswith("/"):
            continue
        if skip:
            depth += name == skip
        elif _is_aside(name, attributes) and name not in ("html", "body"):
            skip, depth, floor = name, 1, len(stack)
        elif name in ("article", "main"):
            main += 1
        if name in RAW:
            close = re.compile(rf"</{name}", re.I).search(html, at)
            at = close.start() if close else end
            if skip == name:
                skip = ""
            continue
        if name == "a":
            in_link += 1
        if name in BLOCK:
            stack.append(name)
    flush()
    return tags, blocks


def main_blocks(blocks: list[Block]) -> list[Block]:
    """What is not aside: of pages that mark an article its blocks, of others those that are not mostly links."""
    kept = [b for b in blocks if not b.aside]
    return [b for b in kept if b.main] or [b for b in kept if not b.linked]


def _token(kind: str, content: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\x00{content}".encode("utf-8", "surrogatepass")) - (1 << 63)


def text_token(block: Block) -> int:
    return _token("text", f"{block.path}\x00{block.text}")


#: Stands for the page itself: it occurs once on every page.
PAGE = _token("page", "")


def page_tokens(html: str) -> list[tuple[int, bool, int, int, int]]:
    """(token, is it text, occurrences, first and last place) of a page's distinct tokens."""
    tags, blocks = parse(html)
    seen: dict[int, list] = {PAGE: [False, 1, -1, -1]}
    tokens = [(_token("tag", t), False) for t in tags] + [(text_token(b), True) for b in blocks]
    for place, (token, is_text) in enumerate(tokens):
        entry = seen.setdefault(token, [is_text, 0, place, place])
        entry[1] += 1
        entry[3] = place
    return [(token, *entry) for token, entry in seen.items()]


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """(row, host, token, is_text, n, first, last) of pages (row, host, html); equal rows count once."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(row, host, *entry) for row, host, html in zip(pdf["row"], pdf["host"], pdf["html"])
                   for entry in page_tokens(html)]
            yield pd.DataFrame(out, columns=["row", "host", "token", "is_text", "n", "first", "last"])

    return (pages.select("row", "host", "html")
            .mapInPandas(run, "row long, host string, token long, is_text boolean, n int, first int, last int"))


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """(host, token, is_text, vector, support): the tokens of classes that may make up a template.

    An occurrence vector says how often a token occurs on each page of the host; tokens with one
    vector are a class. Vectors are compared by a digest that tasks combine (the exclusive or
    of a hash of every page and count), so a host's pages never meet in one task. A class
    counts with at least MIN_TOKENS tokens, tags among them, on at least MIN_PAGES pages.
    """
    vectors = tokens.groupBy("host", "token", "is_text").agg(
        F.bit_xor(F.xxhash64("row", "n")).alias("vector"), F.count(F.lit(1)).alias("support"), F.sum("n").alias("total"))
    wide = (vectors.where(F.col("support") >= MIN_PAGES).groupBy("host", "vector", "support", "total")
            .agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("is_text")).alias("tags"))
            .where((F.col("size") >= MIN_TOKENS) & (F.col("tags") > 0)))
    return vectors.join(wide, ["host", "vector", "support", "total"]).select("host", "token", "is_text", "vector", "support", "total")


def template_texts(tokens: DataFrame) -> DataFrame:
    """(host, token) of the text tokens that belong to the host's template.

    The template's root is the class of the page itself: what occurs once on every page. A class
    is valid if its tokens come in the same order on all pages, and nested if all of it lies
    in one and the same gap between tokens of the root. Text is the template's if its class is
    the root, or is valid, nested and led by tags.
    """
    classes = equivalence_classes(tokens)
    roots = classes.where(F.col("token") == PAGE).select("host", F.col("vector").alias("root"), F.col("support").alias("pages"))
    members = written(tokens.join(classes.select("host", "token", "vector", "total", "support"), ["host", "token"])
                      .join(roots, "host"), "members")
    on_page = Window.partitionBy("row")
    placed = (members.where(F.col("token") != PAGE)
              .withColumn("place", F.explode(F.array_distinct(F.array("first", "last"))))
              .withColumn("gap", F.count_if((F.col("vector") == F.col("root")) & (F.col("place") == F.col("first")))
                          .over(on_page.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    spread = placed.groupBy("host", "vector").agg(F.min("gap").alias("low"), F.max("gap").alias("high"))
    orders = (members.where(F.col("token") != PAGE).groupBy("host", "vector", "row")
              .agg(F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("first", "token"))), lambda x: x["token"])).alias("order"))
              .groupBy("host", "vector").agg(F.min("order").alias("a"), F.max("order").alias("b")))
    valid = (orders.where("a = b").join(spread, ["host", "vector"]).join(roots, "host")
             .where((F.col("vector") == F.col("root")) | (F.col("low") == F.col("high")))
             .select("host", "vector"))
    return classes.where("is_text").join(valid, ["host", "vector"]).select("host", "token")


def in_template(block: Block, drop: set[int]) -> bool:
    """Whether a block goes with the template: outside a marked article if the template has it; inside never, however
    many pages have it, as the mark says what the page is about."""
    return not block.main and text_token(block) in drop


def extract_text(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page, url, text of every row: the main text, its blocks joined by newlines in page order.

    Texts that belong to the template deduced from the pages of the host (see :func:`in_template`), and blocks
    outside the article, are left out. Of a page that would lose all its text to the template (a host of
    copies) nothing is left out. A null or empty html has empty text; rows without a url share the empty
    host; repeated rows get one row each and count once for the template. Other columns
    are not read. An empty table gives an empty result.
    """
    rows = pages.select(F.col(page).alias("id"), F.col(url).alias("address"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = rows.withColumn("row", F.xxhash64("id", "address", "html")).withColumn("host", host_of(F.col("address")))
    tokens = written(occurrences(keyed).dropDuplicates(["row", "host", "token"]), "tokens")
    template = template_texts(tokens)
    drops = written(tokens.where("is_text").join(template, ["host", "token"]).groupBy("row")
                    .agg(F.collect_set("token").alias("drop")), "drops")
    none = F.array().cast("array<long>")
    if drops.isEmpty():  # no host's template has text: spare the join
        given = keyed.withColumn("drop", none)
    else:
        given = keyed.join(drops, "row", "left").withColumn("drop", F.coalesce("drop", none))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = []
            for content, drop in zip(pdf["html"], pdf["drop"]):
                blocks = main_blocks(parse(content)[1])
                if len(drop):
                    gone = set(drop)
                    blocks = [b for b in blocks if not in_template(b, gone)] or blocks
                texts.append("\n".join(b.text for b in blocks))
            yield pd.DataFrame({"id": pdf["id"], "address": pdf["address"], "text": texts})

    kind = rows.schema["id"].dataType.simpleString()
    found = given.select("id", "address", "html", "drop").mapInPandas(run, f"id {kind}, address string, text string")
    return found.select(F.col("id").alias(page), F.col("address").alias(url), "text")
