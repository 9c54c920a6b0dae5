"""Question-answer pairs from sections: FAQ headings, prose stems and table templates.

Templates are data: (needs, question, answer, type).  A table takes the first rule whose columns
its header has; {site} is the institution's name and {0}, {1}, ... are the cells of a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import answer_type, fee, strip, ungrounded


@dataclass(frozen=True)
class Template:
    """A question and an answer over a row's cells; ``kind`` null: by the answer.  ``least``: the cells a row needs."""

    question: str
    answer: str
    kind: str | None = None


@dataclass(frozen=True)
class Rule:
    """``header``: names that the header holds; ``like``: parts of which some name has each; ``exact``: the whole header, cells joined by ' | '; ``start``: what that begins with."""

    templates: tuple[Template, ...]
    header: tuple[str, ...] = ()
    like: tuple[str, ...] = ()
    exact: str | None = None
    first: str | None = None
    start: str | None = None
    fees: tuple[int, ...] = field(default=())


# The templates, in order of precedence.
RULES: tuple[Rule, ...] = (
    Rule(
        (
            Template("What is the estimated cost of {0} at {site}?", "The estimated cost is {2} (LKR).", "numeric"),
            Template("What is the typical hospital stay for {0} at {short}?", "{3}."),
            Template("Which surgical specialty performs {0} at {site}?", "{1}."),
        ),
        header=("Procedure",), like=("Estimated Cost",),
    ),
    Rule(
        (
            Template("On which days is the {0} clinic held at the {short} OPD?", "{1}."),
            Template("What are the OPD consultation hours for {0} at {short}?", "{2}.", "numeric"),
            Template("What is the estimated waiting time for a booked {0} appointment at {short}?", "{3}.", "numeric"),
        ),
        header=("Specialty",), like=("Wait",),
    ),
    Rule((Template("What is the consultation fee for a {0} at {site}?", "{1}.", "numeric"),), header=("Fee (LKR)",), first="Category", fees=(1,)),
    Rule((Template("What is the consultation fee for a {0} at {site}?", "{1}.", "numeric"),), start="Category | Fee", fees=(1,)),
    Rule(
        (
            Template("What is the turnaround time for {0} tests at the {short} laboratory?", "{2}.", "numeric"),
            Template("Which tests are included under {0} at {short}'s laboratory?", "{1}."),
        ),
        header=("Examples", "Turnaround"),
    ),
    Rule(
        (
            Template("What preparation is required before a {0} at {short}?", "{1}.", "procedural"),
            Template("How long does the {0} report take at {site}?", "{2}.", "numeric"),
        ),
        header=("Modality",),
    ),
    Rule((Template("Is fasting required for a {0} at {site}?", "{fasting}."),), header=("Fasting Required",)),
    Rule((Template("Does {site} offer direct billing with {0}?", "{1}. Pre-authorisation: {2}."),), header=("Insurer",)),
    Rule((Template("Can I pay by {0} at {site}, and where?", "Yes, at {1}.{note}"),), header=("Method",), like=("Available",)),
    Rule(
        (
            Template(
                "At {short}'s emergency department, what does Triage Level {0} ({1}) mean, and how quickly should the patient be seen by a doctor?",
                "{2}. Target: seen {lower3}.", "numeric",
            ),
        ),
        header=("Level",), like=("Target",),
    ),
    Rule((Template("What is the fee for {0} at {short}'s emergency department?", "{1}.", "numeric"),), exact="Item | Fee (LKR)", fees=(1,)),
    Rule((Template("Where is the {0} at {site} and what are its hours?", "{1}; open {2}."),), header=("Pharmacy", "Location")),
    Rule((Template("How long does a {0} take at the {short} pharmacy?", "{1}.", "numeric"),), header=("Request Type",)),
)
GENERIC = ("For {0} at {site}, what is the {name}?", "{value}.")
FIRST_WORDS = r"\b(Ward|Room|Suite)\b"


def table_text(header: Column, rows: Column) -> Column:
    """A table on one line: cells by ' | ', rows by ' ;; '."""
    return F.array_join(F.transform(F.concat(F.array(header), rows), lambda r: F.array_join(r, " | ")), " ;; ")


def _filled(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced, once, in order."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if k % 2 == 0 else values[x] for k, x in enumerate(parts) if k % 2 or x])


_PAIR = "array<struct<question:string,answer:string,evidence:string,answer_type:string>>"


def _pair(question: Column, answer: Column, evidence: Column, kind: Column) -> Column:
    kind = F.coalesce(kind, answer_type(strip(answer)))
    return F.struct(strip(question).alias("question"), strip(answer).alias("answer"), strip(evidence).alias("evidence"), kind.alias("answer_type"))


def table_pairs(header: Column, rows: Column, site: str, short: str, rules: Sequence[Rule] = RULES) -> Column:
    """array of pairs of a table, in order: whole-table rules first, then row templates, then one pair per named cell."""
    null = F.lit(None).cast("string")
    names = {"site": F.lit(site), "short": F.lit(short)}
    has = lambda n: F.array_contains(header, n)
    some = lambda part: F.exists(header, lambda h: F.contains(h, F.lit(part)))
    cell = lambda r, k: F.coalesce(F.get(r, F.lit(k)), F.lit(""))

    def of_row(rule: Rule):
        def pairs(r: Column) -> Column:
            cells = {str(k): fee(cell(r, k)) if k in rule.fees else cell(r, k) for k in range(4)}
            yes = F.lower(cell(r, 1)).startswith("yes")
            more = {
                "fasting": F.when(yes, F.concat(cell(r, 1), F.lit(" — "), cell(r, 2))).otherwise(cell(r, 1)),
                "note": F.when((cell(r, 2) != "") & (F.lower(cell(r, 2)) != "none"), F.concat(F.lit(" Note: "), cell(r, 2), F.lit("."))).otherwise(""),
                "lower3": F.lower(cell(r, 3)),
            }
            values = names | cells | more
            ask = lambda t: _pair(_filled(t.question, values), _filled(t.answer, values), F.array_join(r, " | "), F.lit(t.kind).cast("string"))
            return F.array(*[ask(t) for t in rule.templates])

        return pairs

    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.size(header) - F.size(r), F.lit(0)))))

    def generic(r: Column) -> Column:
        values = lambda j: names | {"0": cell(r, 0), "name": F.get(header, j), "value": F.get(r, j)}
        columns = F.filter(F.sequence(F.lit(1), F.greatest(F.size(header) - 1, F.lit(1))), lambda j: (F.coalesce(F.get(header, j), F.lit("")) != "") & (F.coalesce(F.get(r, j), F.lit("")) != ""))
        return F.transform(columns, lambda j: _pair(_filled(GENERIC[0], values(j)), _filled(GENERIC[1], values(j)), F.array_join(r, " | "), null))

    out = F.flatten(F.transform(padded, generic))
    for rule in reversed(rules):
        fits = F.lit(True)
        for n in rule.header:
            fits &= has(n)
        for part in rule.like:
            fits &= some(part)
        if rule.exact is not None:
            fits &= F.array_join(header, " | ") == rule.exact
        if rule.start is not None:
            fits &= F.array_join(header, " | ").startswith(rule.start)
        if rule.first is not None:
            fits &= F.get(header, F.lit(0)) == rule.first
        out = F.when(fits, F.flatten(F.transform(padded, of_row(rule)))).otherwise(out)

    whole = table_text(header, rows)
    column = lambda k: F.array_join(F.filter(F.transform(rows, lambda r: cell(r, k)), lambda x: x != ""), "; ")
    first, note = F.get(rows, F.lit(0)), F.coalesce(F.get(rows, F.lit(1)), F.array(F.lit(""), F.lit("")))
    hotline = _pair(_filled("What is the emergency hotline number for {site}?", names), F.concat(cell(first, 0), F.lit(" (available "), cell(note, 0), F.lit(").")), whole, F.lit("numeric"))
    dispatch = F.replace(F.concat(cell(first, 1), F.lit(" ("), cell(note, 1), F.lit(").")), F.lit(" ()."), F.lit("."))
    ambulance = _pair(_filled("What is the ambulance dispatch number at {site}?", names), dispatch, whole, F.lit("numeric"))
    out = F.when(has("Emergency Hotline") & (F.size(rows) > 0), F.when(F.size(first) > 1, F.array(hotline, ambulance)).otherwise(F.array(hotline))).otherwise(out)
    covered = [
        _pair(_filled(f"What is ordinarily {word} at {{site}}?", names), F.concat(column(k), F.lit(".")), whole, null)
        for k, word in enumerate(("covered under insurance", "excluded from insurance coverage"))
    ]
    out = F.when((F.get(header, F.lit(0)) == "Ordinarily Covered") & (F.size(header) >= 2), F.array(*covered)).otherwise(out)

    def ward(r: Column) -> Column:  # the header row is data
        ev = F.array_join(r, " | ")
        deposit = _pair(_filled("What is the admission deposit for a {0} at {site}?", names | {"0": cell(r, 0)}), F.concat(cell(r, 1), F.lit(" LKR.")), ev, F.lit("numeric"))
        included = _pair(_filled("What is included with a {0} at {site}?", names | {"0": cell(r, 0)}), F.concat(cell(r, 2), F.lit(".")), ev, null)
        return F.when(cell(r, 2) != "", F.array(deposit, included)).otherwise(F.array(deposit))

    wards = cell(header, 0).rlike(FIRST_WORDS) & (F.size(header) >= 3) & cell(header, 1).rlike(r"^[\d,]+$")
    return F.when(wards, F.flatten(F.transform(F.concat(F.array(header), rows), ward))).otherwise(out).cast(_PAIR)


def _prose(content: Column, tables: bool) -> Column:
    """Paragraphs, bullets and, for FAQ answers, tables, as one text."""
    part = lambda b: F.when(b["kind"] == "para", b["text"]).when(b["kind"] == "bullets", F.array_join(b["items"], "; "))
    full = (lambda b: part(b).when(b["kind"] == "table", table_text(b["header"], b["rows"]))) if tables else part
    return strip(F.array_join(F.filter(F.transform(content, full), lambda x: x.isNotNull()), " "))


def derive_pairs(sections: DataFrame, stems: DataFrame, site: str, short: str, faq_prefix: str = "SGH-FAQ", least: int = 40) -> DataFrame:
    """Pairs of all sections (doc_id, source_doc, section, heading, level, parent, content), in the order of a document.

    stems: (stem_doc, stem_heading, stem), stem_doc null for all documents; a document's own stem wins.
    FAQ documents ask their level-3 headings that end in '?'; others ask the stems of prose sections of
    ``least`` characters or more; tables of all documents take the templates.
    """
    faq = F.col("doc_id").startswith(faq_prefix)
    answer = _prose(F.col("content"), tables=True)
    asked = sections.where(faq & (F.col("level") == 3) & F.rtrim(F.col("heading")).endswith("?")).withColumn("answer", answer).where("answer <> ''")
    base = ["doc_id", "source_doc"]
    first = asked.select(*base, F.lit(0).alias("pass_no"), "section", F.lit(0).alias("at"), F.col("parent").alias("in_section"), F.col("heading").alias("question"), "answer", F.col("answer").alias("evidence"), answer_type(F.col("answer")).alias("answer_type"))
    own = stems.where("stem_doc is not null").select("stem_doc", F.col("stem_heading").alias("h1"), F.col("stem").alias("s1"))
    common = stems.where("stem_doc is null").select(F.col("stem_heading").alias("h2"), F.col("stem").alias("s2"))
    prose = sections.where(~faq).withColumn("answer", _prose(F.col("content"), tables=False)).where(F.length("answer") >= least)
    prose = prose.join(own, (F.col("doc_id") == F.col("stem_doc")) & (F.col("heading") == F.col("h1")), "left").join(common, F.col("heading") == F.col("h2"), "left")
    place = F.when(F.col("parent") != "", F.col("parent")).otherwise(F.col("heading"))
    second = prose.withColumn("question", F.coalesce("s1", "s2")).where("question is not null").select(*base, F.lit(0).alias("pass_no"), "section", F.lit(0).alias("at"), place.alias("in_section"), "question", "answer", F.col("answer").alias("evidence"), answer_type(F.col("answer")).alias("answer_type"))
    tables = sections.select(*base, "section", "heading", F.inline("content")).where("kind = 'table'").select(*base, "section", "heading", "block", F.posexplode(table_pairs(F.col("header"), F.col("rows"), site, short)).alias("nth", "p"))
    third = tables.select(*base, F.lit(1).alias("pass_no"), "section", (F.col("block") * 10_000 + F.col("nth")).alias("at"), F.col("heading").alias("in_section"), "p.question", "p.answer", "p.evidence", "p.answer_type")
    return first.unionByName(second).unionByName(third)


def number_pairs(pairs: DataFrame, topics: DataFrame, authored: DataFrame | None = None) -> DataFrame:
    """Pairs with id, topic and flags; authored pairs (ord, doc_id, section, question, answer, evidence, answer_type) of known documents follow."""
    cols = ["doc_id", "source_doc", "pass_no", "section", "at", "in_section", "question", "answer", "evidence", "answer_type"]
    rows = pairs.select(*cols)
    if authored is not None:
        docs = pairs.select("doc_id", "source_doc").distinct()
        rows = rows.unionByName(authored.join(docs, "doc_id").select("doc_id", "source_doc", F.lit(2).alias("pass_no"), F.lit(0).alias("n"), F.col("ord").alias("at"), F.col("section").alias("in_section"), "question", "answer", "evidence", F.coalesce("answer_type", answer_type(F.col("answer"))).alias("answer_type")).withColumnRenamed("n", "section"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pass_no", "section", "at"))
    named = rows.withColumn("id", F.format_string("%s-q%03d", F.lower("doc_id"), nth)).join(topics, "doc_id", "left")
    return named.select(
        "id", "doc_id", "source_doc", F.col("in_section").alias("section"), "question", "answer", "evidence", F.coalesce("topic", F.lit("general")).alias("topic"), "answer_type",
        ungrounded(F.col("answer"), F.col("evidence")).alias("needs_attention"), F.lit(False).alias("verified"), F.lit("").alias("verify_note"),
    )


def review_order(pool: DataFrame) -> DataFrame:
    """The pool as a reviewer reads it: by document, flagged pairs first."""
    return pool.orderBy("doc_id", F.desc("needs_attention"), "id")
