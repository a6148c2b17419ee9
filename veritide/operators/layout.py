"""Page layout: headings, document metadata, and the choice between embedded and recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions import patterns as p
from veritide.functions.text import trim

SPARSE_CHARS = 200


def mark_headings(blocks: DataFrame) -> DataFrame:
    """blocks (document_id, page, text, font_size, bold) with heading.

    The body size of a page is the median size of its blocks of 40 characters or more, else of all
    with a size, else 0. A heading is one short line without a final stop that is larger, bold,
    or numbered.
    """
    line = trim(F.col("text"))
    page = Window.partitionBy("document_id", "page")
    sized = F.when(F.col("font_size") > 0, F.col("font_size"))
    body = F.coalesce(F.median(F.when(F.length(line) >= 40, sized)).over(page), F.median(sized).over(page), F.lit(0.0))
    shape = (line != "") & ~line.contains("\n") & (F.length(line) <= 120) & ~F.substring(line, -1, 1).isin(*p.HEADING_STOPS)
    size, at = F.col("font_size"), F.col("body_size")
    prominent = (size >= at * 1.15) | (F.coalesce("bold", F.lit(False)) & (size >= at))
    numbered = line.rlike(p.NUMBERED_HEADING) & (size >= at * 0.95)
    return blocks.withColumn("body_size", body).withColumn("heading", F.coalesce(shape & (prominent | numbered), F.lit(False)))


def mark_pages(pages: DataFrame) -> DataFrame:
    """pages (source_path, page, headings, blocks, ...) with the headings that their blocks' layout gives, in order; a page without blocks keeps its own."""
    blocks = pages.where("blocks is not null").select(F.col("source_path").alias("document_id"), "page", F.posexplode("blocks").alias("pos", "b")).select("document_id", "page", "pos", "b.*")
    told = mark_headings(blocks).groupBy(F.col("document_id").alias("source_path"), "page").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("heading"), F.struct("pos", "text")))), lambda x: x["text"]).alias("__told")
    )
    return pages.join(told, ["source_path", "page"], "left").withColumn("headings", F.coalesce("__told", "headings")).drop("__told")


#: Markup without readable text of the page's own, and the tags that begin or end a block of text.
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<nav\b.*?</nav>|<footer\b.*?</footer>"
BLOCK_TAG = r"(?i)<(/?(?:h[1-6]|p|li|ul|ol|dl|dt|dd|div|article|section|main|aside|header|table|tr|td|th|blockquote|pre|body|html|br))\b[^>]*>"
SIZES = {"h1": 24.0, "h2": 20.0, "h3": 16.0, "h4": 13.0, "h5": 12.0, "h6": 11.0}
BODY_SIZE = 10.0
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks (document_id, page, pos, text, font_size, bold) of web pages (document_id, html), each one page of text.

    Block-level tags part the text; a heading tag gives the text behind it its size, a bold tag at the start
    of a block makes it bold. Scripts, styles, comments, heads, navigation and footers are no text. Null and empty pages have no block.
    """
    parted = F.regexp_replace(F.regexp_replace(F.translate("html", "\u0001\u0002", ""), UNREAD, " "), BLOCK_TAG, "\u0001$1\u0002")
    rows = pages.select("document_id", F.posexplode(F.split(parted, "\u0001")).alias("pos", "part"))
    raw = F.regexp_extract("part", "(?s)^(?:[^\u0002]*\u0002)?(.*)$", 1)
    text = F.regexp_replace(raw, "<[^>]*>", "")
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    tag = F.lower(F.regexp_extract("part", "^([^\u0002]*)\u0002", 1))
    size = F.lit(BODY_SIZE)
    for name, value in SIZES.items():
        size = F.when(tag == name, value).otherwise(size)
    found = rows.select("document_id", F.lit(1).alias("page"), "pos", trim(F.regexp_replace(text, f"{p.SPACE}+", " ")).alias("text"), size.alias("font_size"), raw.rlike(r"(?i)^\s*<(?:b|strong)\b[^>]*>").alias("bold"))
    return found.where("text <> ''")


def block_pages(blocks: DataFrame) -> DataFrame:
    """Pages (document_id, page, text, headings) of blocks: their texts as paragraphs, and those that mark_headings() tells."""
    marked = mark_headings(blocks)
    parts = F.sort_array(F.collect_list(F.struct("pos", "text", "heading")))
    rows = marked.groupBy("document_id", "page").agg(parts.alias("parts"))
    texts = lambda x: F.transform(x, lambda b: b["text"])
    return rows.select("document_id", "page", F.array_join(texts(F.col("parts")), "\n\n").alias("text"), texts(F.filter("parts", lambda b: b["heading"])).alias("headings"))


def text_pages(documents: DataFrame, lines_per_page: int, heading: str) -> DataFrame:
    """Pages (document_id, filename, page, text, headings) of plain texts (document_id, filename, text), so many lines each.

    A line that matches heading, a pattern for whole lines, is a heading. A null text has no page, an empty one a blank page.
    """
    if lines_per_page < 1:
        raise ValueError("lines_per_page must be positive")
    page = F.posexplode(F.transform(F.sequence(F.lit(0), ((F.size("lines") - 1) / lines_per_page).cast("int")), lambda i: F.slice("lines", i * lines_per_page + 1, F.lit(lines_per_page))))
    rows = documents.where("text is not null").select("document_id", "filename", F.split("text", "\n").alias("lines")).select("document_id", "filename", page.alias("at", "part"))
    return rows.select("document_id", "filename", (F.col("at") + 1).alias("page"), F.array_join("part", "\n").alias("text"), F.filter("part", lambda x: x.rlike(heading)).alias("headings"))


def _cleaned(value: Column) -> Column:
    inner = F.regexp_replace(trim(value), "^\u0000+|\u0000+$", "")
    return F.when(inner != "", inner)


def parse_metadata(raw: DataFrame) -> DataFrame:
    """raw (title, author, subject, keywords, creation_date) with meta: title, authors, year, doi."""
    found = lambda text, pattern: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0), F.lit(""))
    author = _cleaned(F.col("author"))
    authors = F.filter(F.transform(F.split(author, p.AUTHOR_SPLIT), trim), lambda x: x != "")
    doi = found(F.concat_ws(" ", _cleaned(F.col("subject")), _cleaned(F.col("keywords"))), p.DOI)
    return raw.withColumn(
        "meta",
        F.struct(
            _cleaned(F.col("title")).alias("title"),
            F.coalesce(authors, F.array().cast("array<string>")).alias("authors"),
            found(_cleaned(F.col("creation_date")), p.YEAR).cast("int").alias("year"),
            F.regexp_replace(doi, "[.,;)]+$", "").alias("doi"),
        ),
    )


def choose_text(text: Column, recognised: Column, available: Column) -> Column:
    """struct(text, replaced, warning): recognised text replaces a sparse page's own only when it is longer."""
    own, other = F.length(trim(F.coalesce(text, F.lit("")))), F.length(trim(F.coalesce(recognised, F.lit(""))))
    sparse = own < SPARSE_CHARS
    better = sparse & available & (other > own)
    warning = F.when(~sparse, F.lit(None).cast("string")).when(~available, "recognition unavailable").when(better, "replaced by recognised text").otherwise("recognition found no more")
    return F.struct(F.when(better, recognised).otherwise(text).alias("text"), better.alias("replaced"), warning.alias("warning"))
