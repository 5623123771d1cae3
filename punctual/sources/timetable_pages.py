"""Timetable extraction from HTML pages (IO5, re-aimed as a job over a
``pages(page_id, url, html)`` table; fetching is out of scope).

A page's blocks (headings h1-h6, tables, and any other run of text) are
pulled out with ``regexp_extract_all`` into one array.  A section starts at
an h4-h6 heading containing 'Trip Details' and runs to the next h4-h6
heading; its route is the nearest earlier h1-h6 heading without 'Trip
Details'.  Sections are cut from the array by higher-order functions: one
scan, no window and no shuffle of HTML.  Inside a section: table rows with
>= 3 cells and a digits-only first cell, or text blocks '<no> <time>
<destination...>', each yield one trip (numbers beyond an int are NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions.cleaning import strip_ws
from punctual.functions.features import clean_destination, digits_to_int, direction_from_route, is_digits, normalise_time_text

# Every repeated group is possessive: Java then loops instead of recursing, and nothing is tried twice, so a
# page takes linear time whatever is left open in it.  An open comment, script or table reaches to the page's end.
# Left out before anything else: comments and elements without visible text.
HIDDEN_PATTERN = (r"(?is)<!--(?:[^-]++|-(?!->))*+(?:-->|\z)|<(script|style)(?:\s[^>]*+)?>(?:[^<]++|<(?!/\1\s*+>))*+(?:</\1\s*+>|\z)|"
                  r"<(svg|head)(?:\s[^>]*+)?>(?:[^<]++|<(?!/?\2[\s>]))*+</\2\s*+>")
# A heading, a table, or a run of text with inline tags up to the next block tag (which has no text itself).
BLOCK_TAGS = r"(?:h[1-6]|table|p|li|ul|ol|dl|dt|dd|div|section|article|main|header|footer|nav|aside|body|html|br|hr|pre|blockquote)"
BLOCK_PATTERN = (r"(?is)(<h[1-6](?:\s[^<>]*+)?>(?:[^<]++|<(?!/?h[1-6][\s>]))*+(?:</h[1-6]\s*+>|(?=<)|\z)|"
                 r"<table(?:\s[^<>]*+)?>(?:[^<]++|<(?!/table\s*+>))*+(?:</table\s*+>|\z)|"
                 r"[^<]++(?:<(?!/?" + BLOCK_TAGS + r"(?:[\s/>]))(?!/span\s*+>\s*+<span)[^<>]*+>[^<]*+)*+|<[^<>]*+>)")
ROW_PATTERN = r"(?is)<tr(?:\s[^<>]*+)?>((?:[^<]++|<(?!/tr\s*+>))*+)(?:</tr\s*+>|\z)"
CELL_PATTERN = r"(?is)<td(?:\s[^<>]*+)?>((?:[^<]++|<(?!/td\s*+>))*+)(?:</td\s*+>|\z)"
SECTION_TITLE = "trip details"
SECTION_WORD = "details"  # of a title whose words may stand apart in the markup

# Character references of running text; the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def tag_text(c) -> F.Column:
    """Visible text of an HTML fragment: tags removed, the common
    entities decoded, whitespace collapsed and stripped."""
    t = F.regexp_replace(c, r"<[^<>]++>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return strip_ws(F.regexp_replace(t, r"\s+", " "))


def extract_timetable(pages: DataFrame, origin: str = "rak") -> DataFrame:
    html = F.regexp_replace("html", HIDDEN_PATTERN, " ")
    pages = pages.where(F.lower("html").contains(SECTION_WORD)).select(html.alias("html"))
    found = F.transform(F.regexp_extract_all("html", F.lit(BLOCK_PATTERN), 1), lambda block, i: F.struct(
        i.alias("pos"), block.alias("block"), F.regexp_extract(block, r"(?is)^<h([1-6])", 1).try_cast("int").alias("h"),
        F.lower(F.regexp_extract(block, r"(?is)^<(table)", 1)).alias("tag"), tag_text(block).alias("text")))
    blocks = pages.select(F.filter(found, lambda x: x.text != "").alias("blocks"))
    is_title = lambda x: F.lower(x.text).contains(SECTION_TITLE)
    # One row per section title; everything else of a section is found in the page's own array.
    titles = blocks.select("blocks", F.explode(F.filter("blocks", lambda x: (x.h >= 4) & is_title(x))).alias("title"))
    start = F.col("title.pos")
    end = F.array_min(F.transform(F.filter("blocks", lambda x: (x.h >= 4) & (x.pos > start)), lambda x: x.pos))
    route = F.try_element_at(F.filter("blocks", lambda x: x.h.isNotNull() & ~is_title(x) & (x.pos < start)), F.lit(-1)).text
    sections = titles.select(F.coalesce(route, F.lit("Unknown Route")).alias("route"), "blocks", start.alias("start"), end.alias("end"))
    inside = F.filter("blocks", lambda x: x.h.isNull() & (x.pos > F.col("start")) & (F.col("end").isNull() | (x.pos < F.col("end"))))
    body = sections.select("route", F.explode(inside).alias("b")).select("route", "b.block", "b.tag", "b.text")

    # table layout
    rows = body.where(F.col("tag") == "table").select(
        "route", F.explode(F.regexp_extract_all("block", F.lit(ROW_PATTERN), 1)).alias("tr"))
    cells = rows.select("route", F.transform(F.regexp_extract_all("tr", F.lit(CELL_PATTERN), 1), tag_text)
                        .alias("td"))
    from_table = cells.where((F.size("td") >= 3) & is_digits(F.col("td")[0])).select(
        "route", F.col("td")[0].alias("no"), F.col("td")[1].alias("time"), F.col("td")[2].alias("dest"))

    # text layout: '<no> <time> <destination words>'
    words = F.split(F.col("text"), " ")
    from_text = body.where((F.col("tag") != "table") & (F.size(words) >= 3) & is_digits(words[0])).select(
        "route", words[0].alias("no"), words[1].alias("time"),
        F.array_join(F.slice(words, F.lit(3), F.size(words)), " ").alias("dest"))

    trips = from_table.unionByName(from_text)
    out = trips.select(
        "route", direction_from_route(F.col("route"), origin).alias("direction"),
        digits_to_int(F.col("no")).alias("trip_no"),
        normalise_time_text(F.col("time")).alias("departure_time"),
        clean_destination(F.col("dest")).alias("destination"))
    return out.distinct()


def timetable_pages(timetable: DataFrame, origin_label: str = "RAK") -> DataFrame:
    """Render a timetable as pages, one per (route, direction): a route
    heading, a 'Trip Details' heading, then a table (direction From) or one
    paragraph per trip (otherwise).  Used to test the extraction on pages
    derived from data; rows per page are bounded by the timetable."""
    heading = F.when(F.col("direction") == "From", F.concat(F.lit(f"{origin_label} to "), F.col("route"))) \
        .otherwise(F.concat(F.col("route"), F.lit(f" to {origin_label}")))
    t = timetable.withColumn("heading", heading)
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("trip_no").cast("string")),
                   cell(F.replace("departure_time", F.lit(":"), F.lit("."))),
                   cell(F.concat(F.lit("("), F.col("destination"), F.lit(")"))), F.lit("</tr>"))
    para = F.concat(F.lit("<p>"), F.col("trip_no").cast("string"), F.lit(" "), F.col("departure_time"), F.lit(" "),
                    F.col("destination"), F.lit("</p>"))
    t = t.withColumn("frag", F.when(F.col("direction") == "From", row).otherwise(para))
    pages = t.groupBy("heading", "direction").agg(F.array_join(F.sort_array(F.collect_list("frag")), "")
                                                  .alias("body"))
    html = F.concat(F.lit("<html><body><h3>"), F.col("heading"), F.lit("</h3><h5>Trip Details</h5>"),
                    F.when(F.col("direction") == "From", F.concat(F.lit("<table>"), F.col("body"),
                                                                  F.lit("</table>")))
                    .otherwise(F.col("body")), F.lit("<h5>Contact</h5><p>1 2 ignored after section</p></body></html>"))
    return pages.select(F.xxhash64("heading").alias("page_id"), F.concat(F.lit("local:"), F.col("heading"))
                        .alias("url"), html.alias("html"))
