"""Citation markers: parsing, stripping, validation, bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions import patterns as p
from veritide.functions.text import fingerprint_holds, trim

NOT_CANONICAL = "citation marker must use canonical [[REF:citation_id]] syntax"
EMPTY, INVALID = "empty citation identifier", "invalid citation identifier"


def _pattern(mode: str) -> str:
    return {"compat": p.MARKER, "canonical": p.CANONICAL_MARKER}[mode]


def parse_markers(text: Column, mode: str = "compat") -> Column:
    """array<struct<raw, citation_id, start, end, malformed, reason>>, offsets in code points.

    In compat mode any "ref", even within a word, opens a candidate that runs to "]" or the end of
    the line; in canonical mode only the full form is a marker.
    """
    pattern = _pattern(mode)
    group = lambda m, i: F.regexp_extract(m, pattern, i)
    nothing = F.array().cast("array<struct<raw:string,start:int,end:int>>")

    def place(acc: Column, raw: Column) -> Column:
        begin = F.call_function("locate", raw, text, acc["at"] + 1) - 1
        end = begin + F.length(raw)
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(raw.alias("raw"), begin.alias("start"), end.alias("end")))).alias("found"))

    raws = F.regexp_extract_all(text, F.lit(pattern), 0)
    placed = F.aggregate(raws, F.struct(F.lit(0).alias("at"), nothing.alias("found")), place)["found"]

    def judge(m: Column) -> Column:
        body = trim(group(m["raw"], 3))
        canonical = (group(m["raw"], 1) == "[[") & (group(m["raw"], 2) == ":") & (group(m["raw"], 4) == "]]")
        reason = F.when(~canonical, NOT_CANONICAL).when(body == "", EMPTY).when(~body.rlike(p.CITATION_ID), INVALID)
        return F.struct(m["raw"].alias("raw"), F.nullif(body, F.lit("")).alias("citation_id"), m["start"].alias("start"), m["end"].alias("end"), reason.isNotNull().alias("malformed"), reason.alias("reason"))

    return F.transform(placed, judge)


def strip_markers(text: Column, mode: str = "compat") -> Column:
    """text without any marker, malformed ones included."""
    return F.regexp_replace(text, _pattern(mode), "")


def cited_ids(text: Column, mode: str = "compat") -> Column:
    """Distinct well-formed ids in order."""
    sound = F.filter(parse_markers(text, mode), lambda m: ~m["malformed"] & m["citation_id"].isNotNull())
    return F.array_distinct(F.transform(sound, lambda m: m["citation_id"]))


def first_of_each(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(__id, ref) of the chunks that asked (__id) names, without their vectors: of several, the least by source, page and text.

    Only the cited chunks are shuffled, never the whole store.
    """
    order = [c for c in ("source_path", "page", "text") if c in chunks.columns]
    others = [c for c in chunks.columns if c != "embedding"]
    cited = chunks.join(asked, F.col("citation_id") == F.col("__id"), "left_semi")
    ref = F.struct(*[F.col(f"`{c}`") for c in others])
    return cited.groupBy(F.col("citation_id").alias("__id")).agg(F.min_by(ref, F.struct(*[F.col(c) for c in order])).alias("ref"))


def validate_markers(markers: DataFrame, chunks: DataFrame, listing: DataFrame) -> DataFrame:
    """markers (any columns, and marker) with valid and issues, an array of struct(failure, message).

    chunks is the store; listing (source_path, current_hash) says which sources exist now and what
    they hold. One join on the citation id, one on the path; a chunk's extra page_count column bounds pages.
    """
    asked = markers.where(~F.col("marker.malformed")).select(F.col("marker.citation_id").alias("__id")).distinct()
    stored = first_of_each(chunks, asked)
    live = listing.select(F.col("source_path").alias("__path"), F.col("current_hash").alias("__hash"))
    rows = markers.join(stored, (F.col("marker.citation_id") == F.col("__id")) & ~F.col("marker.malformed"), "left")
    rows = rows.join(live, F.col("ref.source_path") == F.col("__path"), "left")
    issue = lambda when, failure, message: F.when(when, F.struct(F.lit(failure).alias("failure"), F.lit(message).alias("message")))
    page = F.col("ref.page")
    beyond = page > F.col("ref.page_count") if "page_count" in chunks.columns else F.lit(False)
    malformed = F.struct(F.lit("MALFORMED_CITATION").alias("failure"), F.coalesce("marker.reason", F.lit("malformed marker")).alias("message"))
    unknown = F.struct(F.lit("UNKNOWN_CITATION").alias("failure"), F.lit("citation was not found").alias("message"))
    found = F.array_compact(
        F.array(
            issue(F.col("__path").isNull(), "MISSING_DOCUMENT", "source document is missing"),
            issue(F.col("__path").isNotNull() & (F.col("__hash") != F.col("ref.document_hash")), "CHANGED_DOCUMENT", "source document hash changed"),
            issue(page.isNull() | (page < 1) | F.coalesce(beyond, F.lit(False)), "INVALID_PAGE", "citation page is outside the indexed document"),
            issue(
                ~fingerprint_holds(F.col("ref.document_id"), page, F.col("ref.text"), F.col("ref.fingerprint")),
                "CHUNK_MISMATCH",
                "chunk fingerprint does not match document ID, page, and exact stored text",
            ),
        )
    )
    issues = F.when(F.col("marker.malformed") | F.col("marker.citation_id").isNull(), F.array(malformed)).when(F.col("__id").isNull(), F.array(unknown)).otherwise(found)
    return rows.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0).drop("__id", "__path", "__hash")


def bibliography_line(authors: Column, title: Column, year: Column, filename: Column, source_path: Column, page: Column, citation_id: Column) -> Column:
    """One entry; nothing that is not known is made up."""
    some = lambda x: F.nullif(x, F.lit(""))
    creator = F.coalesce(some(F.array_join(authors, ", ")), some(filename), some(source_path), F.lit("Unknown source"))
    when = F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(").")), F.lit("."))
    named = F.coalesce(F.concat(F.lit(" "), some(title), F.lit(".")), F.lit(""))
    place = F.coalesce(F.concat(F.lit(" p. "), page.cast("string"), F.lit(".")), F.lit(""))
    return F.replace(F.concat(creator, when, named, place, F.lit(" ["), citation_id, F.lit("]")), F.lit(".."), F.lit("."))


def bibliography(references: DataFrame, formatter=bibliography_line) -> DataFrame:
    """(citation_id, entry) of references (pos and the chunk's columns): the first by pos of each id, sorted by id."""
    first = Window.partitionBy("citation_id").orderBy("pos")
    rows = references.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    c = F.col
    return rows.select("citation_id", formatter(c("authors"), c("title"), c("year"), c("filename"), c("source_path"), c("page"), c("citation_id")).alias("entry")).orderBy("citation_id")
