"""HTML page jobs.

Spark has no HTML parser, so a small helper walks a page's tags with the
stdlib tokenizer and an explicit stack of open tags and emits its text pieces
as rows: where each piece stands, not what is made of it.  Joining pieces to
blocks, sections, definition lists and main-content candidates, choosing
among them, the length gates and the clean-up are DataFrame code.

A piece belongs to its nearest block once.  (The original repeats a nested
or unclosed block's text in every enclosing one, which grows with the square
of the nesting.)
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.strings import strip

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP_TEXT = {"script", "style", "template"}
# Classes of non-article blocks removed before sectioning.
UNWANTED_CLASSES = ["navbox", "ambox", "hatnote", "thumb", "gallery", "reflist", "refbegin", "references",
                    "citation", "cite", "mw-editsection", "printfooter", "catlinks", "sistersitebox", "external"]
UNWANTED_TAG_CLASS = [("sup", "reference"), ("table", "metadata"), ("table", "infobox")]
# Article containers of a directly fetched page in priority order
# (attribute, value; the last one is a part of any class, in lower case).
CONTAINERS = [("class", "mw-parser-output"), ("id", "mw-content-text"), ("class", "mw-content-ltr"), ("part", "content")]
# Main-content selectors in priority order (tag, class or None).
CONTENT_SELECTORS = [("div", "opinion-content"), ("div", "case-content"), ("div", "opinion"),
                     ("div", "decision-content"), ("main", None), ("article", None), (None, "case-text"),
                     (None, "opinion-text")]
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"p", "li", "dt", "dd"}
#: Text pieces that a task holds at once, about.
AT_ONCE = 8192
LISTS = {"ul", "ol", "dl"}

PIECES = ("seq int, text string, block int, kind string, list int, dropped boolean, body boolean, has_body boolean, "
          "containers int, selectors int, tabs array<int>, paragraph int")


class _Walker(HTMLParser):
    """Text pieces of one page.  Every open tag holds what its text inherits."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.n = 0
        self.pieces: list[tuple] = []
        self.tabs = self.paragraphs = 0
        self.taken_containers = self.taken_selectors = 0
        self.has_body = False
        # tag, number, block, kind, list, dropped, skipped, body, containers, selectors, tabs, paragraph
        self.open: list[tuple] = [("", 0, -1, "", -1, False, False, False, 0, 0, (), -1)]

    def handle_starttag(self, tag, attrs):
        top = self.open[-1]
        self.n += 1
        _, _, block, kind, inside, dropped, skipped, body, containers, selectors, tabs, paragraph = top
        named = {k: v or "" for k, v in attrs}
        classes = named.get("class", "").split()
        if tag in BLOCKS:
            block, kind = self.n, "heading" if tag in HEADINGS else tag
            # items count for the list they are a direct child of, terms for the list around them
            inside = (top[1] if top[0] in ("ul", "ol") else -1) if tag == "li" else top[4] if tag in ("dt", "dd") else -1
        elif tag in LISTS:
            block, kind, inside = -1, "", self.n if tag == "dl" else inside
        if tag == "p":
            paragraph, self.paragraphs = self.paragraphs, self.paragraphs + 1
        dropped = dropped or any(c in UNWANTED_CLASSES for c in classes) or any(tag == t and c in classes for t, c in UNWANTED_TAG_CLASS)
        if tag == "body" and not self.has_body:
            body = self.has_body = True
        if tag == "div":
            for i, (what, value) in enumerate(CONTAINERS):
                hit = (value in classes if what == "class" else named.get("id") == value if what == "id"
                       else any(value in c.lower() for c in classes))
                if hit and not self.taken_containers >> i & 1:
                    self.taken_containers |= 1 << i
                    containers |= 1 << i
            if "tab-opinion" in named.get("id", ""):
                tabs, self.tabs = (*tabs, self.tabs), self.tabs + 1
        for i, (t, c) in enumerate(CONTENT_SELECTORS):
            if (t is None or tag == t) and (c is None or c in classes) and not self.taken_selectors >> i & 1:
                self.taken_selectors |= 1 << i
                selectors |= 1 << i
        if tag not in VOID:
            self.open.append((tag, self.n, block, kind, inside, dropped, skipped or tag in SKIP_TEXT, body, containers,
                              selectors, tabs, paragraph))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        text = data.strip()
        _, _, block, kind, inside, dropped, skipped, body, containers, selectors, tabs, paragraph = self.open[-1]
        if text and not skipped:
            self.n += 1
            self.pieces.append((self.n, text, block, kind, inside, dropped, body, containers, selectors, list(tabs), paragraph))


def _frames(batches: Iterator[pd.DataFrame], id_col: str, html_col: str) -> Iterator[pd.DataFrame]:
    """The pieces of pages in frames that end with the page that fills them, so that a task holds
    ``AT_ONCE`` pieces and a page's, not those of all pages it was sent together."""
    names, rows = [id_col, *[c.split()[0] for c in PIECES.split(", ")]], []
    for pdf in batches:
        for page, html in zip(pdf[id_col], pdf[html_col], strict=True):
            w = _Walker()
            w.feed(html or "")
            w.close()
            rows += [(page, *p[:7], w.has_body, *p[7:]) for p in w.pieces]
            if len(rows) >= AT_ONCE:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def text_pieces(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per non-empty text piece of every page (``PIECES``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(batches, id_col, html_col)

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} long, {PIECES}")


def _joined(sep: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), sep)


def html_to_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", direct: bool = False) -> DataFrame:
    """Headings → ``=== H ===``, paragraphs over 10 chars, list items →
    ``• x``, definition lists → ``term: def``; blank runs collapsed; when
    nothing is found, all text (if over 100 chars, cut to 10 000).

    The content is the body, or of a directly fetched page (``direct``) the
    first container of ``CONTAINERS`` that the page has, and nothing without
    one."""
    page = F.col(id_col)
    rows = text_pieces(pages, id_col, html_col)
    if direct:
        has = rows.groupBy(id_col).agg(F.bit_or("containers").alias("has"))
        first = F.col("has").bitwiseAND(-F.col("has"))  # the lowest bit: the first rule that matched
        rows = rows.join(has, id_col).filter(F.col("containers").bitwiseAND(first) != 0)
    else:
        rows = rows.filter(F.col("body") | ~F.col("has_body"))
    rows = rows.filter(~F.col("dropped"))
    blocks = rows.filter("block >= 0").groupBy(id_col, "block", "kind", "list").agg(_joined().alias("text"))

    single = blocks.filter("kind = 'heading' OR (kind = 'p' AND length(text) > 10)").select(
        page, F.col("block").alias("at"), F.when(F.col("kind") == "heading", F.concat(F.lit("\n=== "), "text", F.lit(" ===\n")))
        .otherwise(F.concat("text", F.lit("\n"))).alias("part")).filter(~F.col("part").startswith("\n=== [edit]"))
    item = F.struct(F.col("block").alias("seq"), F.concat(F.lit("• "), "text").alias("text"))
    lines = lambda xs: F.concat(F.array_join(F.transform(F.array_sort(xs), lambda x: x["text"]), "\n"), F.lit("\n"))
    lists = blocks.filter("kind = 'li' AND list >= 0").groupBy(page, F.col("list").alias("at")).agg(
        lines(F.collect_list(item)).alias("part"))
    entry = F.array_sort(F.collect_list(F.struct(F.col("block").alias("seq"), "kind", "text")))

    def with_definition(xs: Column) -> Column:
        """Each term with the first definition after it; terms without one go."""
        after = lambda t: F.get(F.filter(xs, lambda d: (d["kind"] == "dd") & (d["seq"] > t["seq"])), F.lit(0))
        pairs = F.transform(F.filter(xs, lambda t: t["kind"] == "dt"), lambda t: F.struct(
            t["seq"].alias("seq"), F.concat(t["text"], F.lit(": "), after(t)["text"]).alias("text")))
        return F.filter(pairs, lambda p: p["text"].isNotNull())

    terms = blocks.filter("kind IN ('dt', 'dd') AND list >= 0").groupBy(page, F.col("list").alias("at")).agg(entry.alias("xs"))
    terms = terms.select(page, "at", with_definition(F.col("xs")).alias("xs")).filter(F.size("xs") > 0).select(
        page, "at", lines(F.col("xs")).alias("part"))
    parts = single.unionByName(lists).unionByName(terms)
    full = parts.groupBy(id_col).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("full"))
    everything = rows.groupBy(id_col).agg(_joined().alias("all"))
    text = strip(F.regexp_replace(F.regexp_replace(F.coalesce("full", F.lit("")), r"\n\s*\n\s*\n+", "\n\n"), r"[ \t]+", " "))
    fallback = F.when(F.length("all") > 100, F.substring(F.regexp_replace("all", r"\s+", " "), 1, 10_000)).otherwise(F.lit(""))
    return (pages.select(id_col).join(full, id_col, "left").join(everything, id_col, "left")
            .select(id_col, F.when(text != "", text).otherwise(F.coalesce(fallback, F.lit(""))).alias("text")))


def content_candidates(rows: DataFrame, id_col: str) -> DataFrame:
    """(page, source, idx, text) candidates of the main-content rules, from text pieces."""
    bits = F.array(*[F.when(F.col("selectors").bitwiseAND(1 << i) != 0, F.struct(F.lit("selector").alias("source"), F.lit(i).alias("idx")))
                     for i in range(len(CONTENT_SELECTORS))])
    tabs = F.transform("tabs", lambda t: F.struct(F.lit("tab").alias("source"), t.alias("idx")))
    body = F.array(F.when(F.col("body"), F.struct(F.lit("body").alias("source"), F.lit(0).alias("idx"))))
    of = F.filter(F.concat(bits, tabs, body), lambda x: x.isNotNull())
    plain = rows.select(id_col, "seq", "text", F.explode(of).alias("of")).groupBy(id_col, "of.source", "of.idx").agg(_joined().alias("text"))
    one = rows.filter("paragraph >= 0").groupBy(id_col, "paragraph").agg(_joined().alias("text"))
    joined = one.groupBy(id_col).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return plain.unionByName(joined.select(id_col, F.lit("paragraphs").alias("source"), F.lit(0).alias("idx"), "text"))


def html_main_content(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Longest opinion tab; if under 1000 chars, the longest of it and the
    content selectors (first wins ties); if under 100, the joined
    paragraphs; if still under 100, the body text; then clean-up."""
    cands = content_candidates(text_pieces(pages, id_col, html_col), id_col)
    rank = F.when(F.col("source") == "tab", 0).otherwise(1)

    def best_of(cond):
        # strictly longer replaces: longest, ties to the earliest candidate
        return F.max_by(F.when(cond, F.col("text")), F.when(cond, F.struct(F.length("text"), -rank, -F.col("idx"))))

    agg = pages.select(id_col).join(cands, id_col, "left").groupBy(id_col).agg(
        best_of(F.col("source") == "tab").alias("tab"),
        best_of(F.col("source").isin("tab", "selector")).alias("sel"),
        F.max(F.when(F.col("source") == "paragraphs", F.col("text"))).alias("par"),
        F.max(F.when(F.col("source") == "body", F.col("text"))).alias("body"))
    tab = F.coalesce(F.col("tab"), F.lit(""))
    step1 = F.when(F.length(tab) < 1000, F.coalesce(F.col("sel"), tab)).otherwise(tab)
    step2 = F.when((F.length(step1) < 100) & F.col("par").isNotNull(), F.col("par")).otherwise(step1)
    step3 = F.when((F.length(step2) < 100) & F.col("body").isNotNull(), F.col("body")).otherwise(step2)
    rule = (F.when(step3 == F.coalesce(F.col("body"), F.lit("\u0000")), "body")
            .when(step3 == F.coalesce(F.col("par"), F.lit("\u0000")), "paragraphs")
            .when(step3 == tab, "tab").otherwise("selector"))
    cleaned = F.regexp_replace(F.regexp_replace(step3, r"\n\s*\n\s*\n+", "\n\n"), r"[ \t]+", " ")
    return agg.select(id_col, strip(cleaned).alias("content"), F.when(step3 == "", "").otherwise(rule).alias("rule"))
