"""Markdown to front matter, blocks and sections.

Lines carry their ordinals; blocks are islands of lines found by window functions, sections are
running counts of headings.  Everything is keyed by document, so a shuffle on that key serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import strip

BLOCK = "struct<block:int,kind:string,level:int,text:string,items:array<string>,header:array<string>,rows:array<array<string>>>"
_SEPARATOR = "^[-: ]+$"


def split_front_matter(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with fm (map of the quoted fields, the last of a name wins) and body."""
    pieces = F.split(F.col(text), "---", 3)
    headed = F.col(text).startswith("---") & (F.size(pieces) == 3)
    lines = F.split(F.get(pieces, F.lit(1)), r"\R")
    field = lambda g: lambda x: F.regexp_extract(F.trim(x), r'^(\w+):\s*"(.*)"', g)
    good = F.filter(lines, lambda x: F.trim(x).rlike(r'^\w+:\s*".*"'))
    pairs = F.transform(good, lambda x: F.struct(field(1)(x).alias("key"), field(2)(x).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    none = F.create_map().cast("map<string,string>")
    return docs.withColumn("fm", F.when(headed, F.map_from_entries(last)).otherwise(none)).withColumn("body", F.when(headed, F.get(pieces, F.lit(2))).otherwise(F.col(text)))


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(strip(line), r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"\|", -1), strip)


def lines_of(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, line_no, line, kind) of the lines that aren't blank or a top title."""
    lines = docs.select(key, F.posexplode(F.split(F.col(body), r"\R")).alias("line_no", "line"))
    line, bare = F.rtrim(F.col("line")), F.ltrim(F.col("line"))
    kind = (
        F.when(strip(line) == "", "blank").when(line.startswith("### "), "h3").when(line.startswith("## "), "h2").when(line.startswith("# "), "title")
        .when(bare.startswith("|"), "table").when(bare.startswith("- "), "bullets").otherwise("para")
    )
    return lines.withColumn("kind", kind)


def blocks_of(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, block, kind, level, text, items, header, rows), block by block, in order.

    Runs of table lines and of bullets are one block; a table without a row that isn't a separator
    is none.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    runs = F.col("kind").isin("table", "bullets") & (F.lag("kind").over(order) == F.col("kind"))
    marked = lines_of(docs, key, body).withColumn("first", F.when(F.coalesce(runs, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("first").over(order).cast("int"))
    marked = marked.where(~F.col("kind").isin("blank", "title"))
    value = F.when(F.col("kind") == "h3", strip(F.substring("line", 5, 1 << 30))).when(F.col("kind") == "h2", strip(F.substring("line", 4, 1 << 30)))
    value = value.when(F.col("kind") == "bullets", strip(F.substring(F.ltrim("line"), 3, 1 << 30))).otherwise(strip(F.col("line")))
    grouped = (
        marked.select(key, "block", "kind", F.struct("line_no", value.alias("value"), F.when(F.col("kind") == "table", _cells(F.col("line"))).alias("cells")).alias("x"))
        .groupBy(key, "block", "kind").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    )
    table = F.filter(F.transform("xs", lambda x: x["cells"]), lambda r: ~F.forall(r, lambda c: c.rlike(_SEPARATOR)))
    is_ = lambda k: F.col("kind") == k
    heading = F.col("kind").isin("h2", "h3")
    return (
        grouped.withColumn("table", F.when(is_("table"), table))
        .where(~is_("table") | (F.size("table") > 0))
        .select(
            key, "block",
            F.when(heading, "heading").otherwise(F.col("kind")).alias("kind"),
            F.when(is_("h2"), 2).when(is_("h3"), 3).alias("level"),
            F.when(heading | is_("para"), F.col("xs")[0]["value"]).alias("text"),
            F.when(is_("bullets"), F.transform("xs", lambda x: x["value"])).alias("items"),
            F.col("table")[0].alias("header"),
            F.slice("table", 2, F.greatest(F.size("table") - 1, F.lit(0))).alias("rows"),
        )
    )


def sections_of(blocks: DataFrame, key: str) -> DataFrame:
    """(key, section, heading, level, parent, content): a heading and the blocks up to the next.

    What stands before the first heading belongs to no section.  ``parent`` is the last heading of
    level 2 for one of level 3, else empty.
    """
    order = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("kind") == "heading"
    numbered = blocks.withColumn("section", F.sum(is_heading.cast("int")).over(order)).withColumn("above", F.last(F.when(F.col("level") == 2, F.col("text")), True).over(order)).where("section > 0")
    content = F.struct("block", "kind", "level", "text", "items", "header", "rows")
    heads = F.max(F.when(is_heading, F.struct("text", "level", F.coalesce("above", F.lit("")).alias("above"))))
    grouped = numbered.groupBy(key, "section").agg(heads.alias("head"), F.array_sort(F.collect_list(F.when(~is_heading, content)), lambda a, b: a["block"] - b["block"]).alias("content"))
    parent = F.when(F.col("head.level") == 3, F.col("head.above")).otherwise("")
    return grouped.select(key, "section", F.col("head.text").alias("heading"), F.col("head.level").alias("level"), parent.alias("parent"), "content")


def segment(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Front matter fields and sections of markdown documents."""
    split = split_front_matter(docs, text)
    sections = sections_of(blocks_of(split, key), key)
    field = lambda n: F.coalesce(F.try_element_at(F.col("fm"), F.lit(n)), F.lit(""))
    heads = split.select(F.col(key).alias("_key"), field("doc_id").alias("doc_id"), field("source_pdf").alias("source_doc"), field("title").alias("title"))
    return heads.join(sections, F.col("_key") == F.col(key)).drop("_key" if key != "doc_id" else key)


def section_text(heading: Column, content: Column) -> Column:
    """A section as one string for retrieval: cells by ' | ', bullets by '- '."""
    row = lambda r: F.array_join(r, " | ")
    part = lambda b: (
        F.when(b["kind"] == "para", F.array(b["text"])).when(b["kind"] == "bullets", F.transform(b["items"], lambda i: F.concat(F.lit("- "), i)))
        .when(b["kind"] == "table", F.concat(F.array(row(b["header"])), F.transform(b["rows"], row))).otherwise(F.array().cast("array<string>"))
    )
    return F.array_join(F.concat(F.array(heading), F.flatten(F.transform(content, part))), "\n")
