"""From text lines with geometry to clean markdown.

Lines stay rows until a page's visual rows are known; rows of one heading's section become markdown
in one grouped call of bounded size, a section of one document.
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import front_matter, is_footer, squeeze_blank_lines, title_of

# Sizes in points, fonts and glyphs that carry no content.
LEAST_SPAN = 6.0
DROPPED_FONTS = ("Type3", "CourierNew", "Nirmala", "Georgia")
GLYPHS = ("✦", "✓", "•", "▪", "")
ROW_TOLERANCE = 5.0
ANCHOR_TOLERANCE = 22.0
HEADER_STEP, HEADER_CUTOFF = 18.0, 200.0
REFERENCE = r"Ref:\s*SGH-"
BOLD = 16


def span_kept(size: Column, font: Column, text: Column) -> Column:
    """Whether a span carries content."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    out = (size >= LEAST_SPAN) & (bare != "") & ~bare.isin(list(GLYPHS))
    for part in DROPPED_FONTS:
        out &= ~F.contains(font, F.lit(part))
    return out


def lines_from_spans(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, line, x0, y0, y1, h, text, bold, all_bold) from spans (doc, page, line, span, size, font, flags, text, x0, y0, x1, y1)."""
    kept = spans.where(span_kept(F.col("size"), F.col("font"), F.col("text")))
    bold = F.col("flags").bitwiseAND(BOLD) != 0
    rolled = kept.groupBy(doc, "page", "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        F.array_sort(F.collect_list(F.struct("span", "text"))).alias("parts"),
        F.min_by(bold, "span").alias("bold"), F.bool_and(bold).alias("all_bold"),
    )
    text = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), ""), r"\s+", " "))
    return rolled.withColumns({"text": text, "h": F.col("y1") - F.col("y0")}).where("text <> ''").drop("parts")


def split_header(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """``lines`` and in_header: the first page down to the first wide gap below the reference line.

    Without a reference line the header ends at a fixed height.
    """
    of_doc = Window.partitionBy(doc)
    ref = F.min(F.when((F.col("page") == 0) & F.col("text").rlike(REFERENCE), F.struct("line", "y0"))).over(of_doc)
    marked = lines.withColumn("_ref", ref["y0"])
    down = Window.partitionBy(doc).orderBy("_at", "line")
    below = (F.col("page") == 0) & (F.col("y0") >= F.col("_ref") - 1)
    run = marked.withColumn("_at", F.when(below, F.col("y0")))
    before = F.lag("_at").over(down)
    wide = (F.col("_at") - F.greatest(F.coalesce(before, F.col("_ref")), F.col("_ref")) >= HEADER_STEP).cast("int")
    run = run.withColumn("_wide", F.when(F.col("_at").isNotNull(), wide)).withColumn("_gaps", F.sum("_wide").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.greatest(F.max(F.when(F.col("_at").isNotNull() & (F.col("_gaps") == 0), F.col("y1"))).over(of_doc), F.col("_ref"))
    end = F.when(F.col("_ref").isNull(), F.lit(HEADER_CUTOFF)).otherwise(end)
    return run.withColumn("in_header", (F.col("page") == 0) & (F.col("y0") < end)).drop("_ref", "_at", "_wide", "_gaps")


def header_fields(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, doc_id, issued, rev, dept, valid_until) from the right-hand column of the header."""
    right = lines.where("in_header and x0 > 200").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("y0", "line", "text"))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["text"]), " ")
    return right.withColumn("_text", text).select(doc, *[c.alias(n) for n, c in front_matter(F.col("_text")).items()])


def visual_rows(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """``lines`` and row: lines of a page within a tolerance of the row's first line, by height and then x.

    The first line is the anchor, not the one before, so the rows are a fold over a page's lines.
    """
    of_page = lines.groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct(F.round("y0", 1).alias("at"), "x0", "line", "y0"))).alias("xs"))
    none = F.array().cast("array<struct<line:int,row:int>>")
    state = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("anchor"), none.alias("out"))

    def place(s: Column, x: Column) -> Column:
        new = s["anchor"].isNull() | (F.abs(x["y0"] - s["anchor"]) > ROW_TOLERANCE)
        row = s["row"] + new.cast("int")
        item = F.struct(x["line"].cast("int").alias("line"), row.alias("row"))
        return F.struct(row.alias("row"), F.when(new, x["y0"]).otherwise(s["anchor"]).alias("anchor"), F.concat(s["out"], F.array(item)).alias("out"))

    rows = of_page.select(doc, "page", F.inline(F.aggregate("xs", state, place, lambda s: s["out"])))
    return lines.join(rows, [doc, "page", "line"])


def roll_up(placed: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, row, y0, y1, h, n_cells, text, all_bold, cells): a visual row, cells from left to right."""
    cell = F.struct("x0", "line", "text", "bold")
    rolled = placed.groupBy(doc, "page", "row").agg(
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.median("h").alias("h"), F.count("*").cast("int").alias("n_cells"),
        F.array_sort(F.collect_list(cell)).alias("cells"), F.bool_and("all_bold").alias("all_bold"),
    )
    return rolled.withColumn("text", F.array_join(F.transform("cells", lambda c: c["text"]), " "))


def anchors(points: DataFrame, group: str, x: str, tolerance: float = ANCHOR_TOLERANCE) -> DataFrame:
    """(group, anchor_no, anchor, n): runs of points no further than a tolerance from the one before, and their means."""
    order = Window.partitionBy(group).orderBy(x)
    gap = F.coalesce((F.col(x) - F.lag(x).over(order) > tolerance).cast("int"), F.lit(0))
    marked = points.withColumn("_gap", gap).withColumn("anchor_no", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "anchor_no").agg(F.avg(x).alias("anchor"), F.count("*").alias("n"))


def nearest_anchor(points: DataFrame, found: DataFrame, group: str, key: str, x: str) -> DataFrame:
    """(group, key, anchor_no) of the nearest anchor, the first of equally near ones."""
    listed = found.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("anchor_no", "anchor"))).alias("as"))
    near = lambda c: F.transform("as", lambda a: F.struct(F.abs(c - a["anchor"]).alias("d"), a["anchor_no"].alias("anchor_no")))
    return points.join(listed, group).select(group, key, F.array_min(near(F.col(x)))["anchor_no"].alias("anchor_no"))


def is_heading() -> Column:
    return (F.col("n_cells") == 1) & F.col("all_bold") & (F.length("text") < 110)


# Below, a section's rows, which are few, become markdown lines.


def _columns(rows: Sequence[dict]) -> list[float]:
    """Column anchors of a table's cells."""
    groups: list[list[float]] = []
    for x in sorted(c["x0"] for r in rows for c in r["cells"]):
        if groups and x - groups[-1][-1] <= ANCHOR_TOLERANCE:
            groups[-1].append(x)
        else:
            groups.append([x])
    return [sum(g) / len(g) for g in groups]


def table_lines(rows: Sequence[dict]) -> list[str]:
    """A markdown table: cells go to their nearest column, wrapped rows to the one above; none with one column."""
    columns = _columns(rows)
    if len(columns) < 2:
        return []
    heights = [r["h"] for r in rows if r["h"] > 0]
    wrap = 1.6 * statistics.median(heights) if heights else 0.0
    grid: list[list[list[str]]] = []
    above = None
    for r in rows:
        if above is None or r["page"] != above["page"] or r["y0"] - above["y0"] >= wrap:
            grid.append([[] for _ in columns])
        for c in r["cells"]:
            distances = [abs(c["x0"] - a) for a in columns]
            grid[-1][distances.index(min(distances))].append(c["text"])
        above = r
    written = ["| " + " | ".join(" ".join(cell).strip() for cell in row) + " |" for row in grid]
    return ["", written[0], "| " + " | ".join(["---"] * len(columns)) + " |", *written[1:], ""]


def prose_lines(rows: Sequence[dict]) -> list[str]:
    """Paragraphs of wrapped lines; a short line that doesn't end like a sentence is a bullet."""
    out: list[str] = []
    open_, above = False, None
    for r in rows:
        text = r["text"]
        if r["n_cells"] == 1 and len(text) < 90 and text.rstrip()[-1:] not in (".", ":", ",", ";", "") and not r["all_bold"]:
            out.append(f"- {text}")
            open_, above = False, None
            continue
        joins = open_ and not r["cells"][0]["bold"] and r["page"] == above["page"] and r["y0"] - above["y1"] < 0.9 * r["h"]
        if joins:
            out[-1] += f" {text}"
        else:
            out += ["", text]
        open_, above = True, r
    return out


def section_lines(rows: Sequence[dict]) -> list[str]:
    """A section as a table, prose, or runs of both: one wide cell among rows of cells is prose."""
    if sum(r["n_cells"] >= 2 for r in rows) < 2:
        return prose_lines(rows)
    out: list[str] = []
    run: list[dict] = []
    wide_run = False
    for r in [*rows, None]:
        wide = r is not None and r["n_cells"] == 1 and len(r["text"]) > 60
        if run and (r is None or wide != wide_run):
            out += (table_lines(run) if not wide_run and len(run) >= 2 else []) or prose_lines(run)
            run = []
        if r is not None:
            run, wide_run = [*run, r], wide
    return out


def clean_documents(lines: DataFrame, doc: str = "doc", letterheads: Sequence[str] = (), banner: str | None = None) -> DataFrame:
    """(doc, title and header fields, body) of lines (doc: the file's name)."""
    headed = split_header(lines, doc)
    fields = header_fields(headed, doc)
    body = headed.where(~F.col("in_header") & ~is_footer(F.col("text"), letterheads, banner=banner))
    rows = roll_up(visual_rows(body, doc), doc)
    order = Window.partitionBy(doc).orderBy("page", "row")
    numbered = rows.withColumn("heading", is_heading()).withColumn("part", F.sum(F.col("heading").cast("int")).over(order))

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        records = pdf.sort_values(["page", "row"]).to_dict("records")
        out: list[str] = []
        if records[0]["heading"]:
            title = records.pop(0)["text"]
            out += ["", ("### " if title.rstrip().endswith("?") else "## ") + title]
        return pd.DataFrame({doc: [pdf[doc].iloc[0]], "part": [pdf["part"].iloc[0]], "body": ["\n".join(out + section_lines(records))]})

    kind = dict(lines.dtypes)[doc]
    parts = numbered.select(doc, "part", "page", "row", "y0", "y1", "h", "n_cells", "text", "all_bold", "heading", "cells")
    parts = parts.groupBy(doc, "part").applyInPandas(render, f"{doc} {kind}, part long, body string")
    whole = parts.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias("xs"))
    text = squeeze_blank_lines(F.regexp_replace(F.array_join(F.transform("xs", lambda x: x["body"]), "\n"), r"^\s+|\s+$", ""))
    names = lines.select(doc).distinct()
    return names.join(fields, doc, "left").na.fill("").join(whole.select(doc, text.alias("body")), doc, "left").withColumn("title", title_of(F.col(doc)))


def markdown(clean: DataFrame, doc: str = "doc") -> DataFrame:
    """``clean`` and markdown: quoted front matter, a top title and the body."""
    quote = lambda name, c: F.concat(F.lit(f'{name}: "'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    fields = [quote("source_pdf", F.col(doc)), *[quote(n, F.col(n)) for n in ("doc_id", "title", "dept", "issued", "rev", "valid_until")]]
    title = F.when(F.coalesce("title", F.lit("")) == "", F.col(doc)).otherwise(F.col("title"))
    text = F.concat_ws("\n", F.lit("---"), *fields, F.lit("---"), F.lit(""))
    return clean.withColumn("markdown", F.concat(text, F.lit("# "), title, F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")))


def decode_pdfs(files: DataFrame, decoder: Callable[[bytes], list[dict]], slugs: DataFrame) -> DataFrame:
    """Spans of the PDF files (path, content) whose names ``slugs`` (file_name, slug) knows, by a decoder given as a seam."""
    named = files.withColumn("doc", F.regexp_extract("path", r"([^/]+)$", 1)).join(F.broadcast(slugs), F.col("doc") == F.col("file_name"))
    schema = "doc string, slug string, page int, line int, span int, size double, font string, flags int, text string, x0 double, y0 double, x1 double, y1 double"
    names = [re.split(r"\s+", x.strip())[0] for x in schema.split(",")]

    def work(pdfs):
        for pdf in pdfs:
            rows = [{"doc": d, "slug": s, **span} for d, s, raw in zip(pdf["doc"], pdf["slug"], pdf["content"], strict=True) for span in decoder(raw)]
            yield pd.DataFrame(rows, columns=names)

    return named.select("doc", "slug", "content").mapInPandas(work, schema)


def whole_texts(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, text) of (doc, page, text): pages in order, joined by line breaks."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(doc).agg(ordered.alias("xs")).select(doc, F.array_join(F.transform("xs", lambda x: x["text"]), "\n").alias("text"))
