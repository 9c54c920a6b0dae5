from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from qaloom.operators import derive, segment

DOC = """---
doc_id: "D-1"
title: "old"
title: "T"
---
# T

before the first heading

## A
text one
- x
- y

| h1 | h2 |
| --- | --- |
| 1 | 2 |

### Why?
because
#### four
## B
| --- | --- |
"""


def parsed(spark, text=DOC):
    docs = spark.createDataFrame([(1, text)], "no int, text string")
    split = segment.split_front_matter(docs)
    blocks = segment.blocks_of(split, "no")
    return split, blocks


def test_blocks(spark):
    split, blocks = parsed(spark)
    assert split.first()["fm"] == {"doc_id": "D-1", "title": "T"}
    rows = blocks.orderBy("block").collect()
    assert [(r["kind"], r["level"], r["text"]) for r in rows] == [
        ("para", None, "before the first heading"), ("heading", 2, "A"), ("para", None, "text one"), ("bullets", None, None), ("table", None, None),
        ("heading", 3, "Why?"), ("para", None, "because"), ("para", None, "#### four"), ("heading", 2, "B"),
    ]
    assert rows[3]["items"] == ["x", "y"] and rows[4]["header"] == ["h1", "h2"] and rows[4]["rows"] == [["1", "2"]]


def test_sections(spark):
    _, blocks = parsed(spark)
    rows = segment.sections_of(blocks, "no").orderBy("section").collect()
    assert [(r["heading"], r["level"], r["parent"], len(r["content"])) for r in rows] == [("A", 2, "", 3), ("Why?", 3, "A", 2), ("B", 2, "", 0)]
    text = segment.sections_of(blocks, "no").where("heading = 'A'").select(segment.section_text(F.col("heading"), F.col("content")).alias("t")).first()["t"]
    assert text == "A\ntext one\n- x\n- y\nh1 | h2\n1 | 2"


def test_a_header_only_table_has_no_rows(spark):
    _, blocks = parsed(spark, "## A\n| a | b |\n|---|---|")
    assert [(r["header"], r["rows"]) for r in blocks.where("kind = 'table'").collect()] == [(["a", "b"], [])]


def pairs_of(spark, header, rows):
    df = spark.createDataFrame([(header, rows)], "h array<string>, r array<array<string>>")
    return df.select(derive.table_pairs(F.col("h"), F.col("r"), "Example House", "Example").alias("p")).first()["p"]


def test_table_templates(spark):
    got = pairs_of(spark, ["Procedure", "Specialty", "Estimated Cost (LKR)", "Stay"], [["Repair", "Surgery", "1,000", "2 days"]])
    assert [(p["question"], p["answer"], p["answer_type"]) for p in got] == [
        ("What is the estimated cost of Repair at Example House?", "The estimated cost is 1,000 (LKR).", "numeric"),
        ("What is the typical hospital stay for Repair at Example?", "2 days.", "numeric"),
        ("Which surgical specialty performs Repair at Example House?", "Surgery.", "factual"),
    ]
    assert got[0]["evidence"] == "Repair | Surgery | 1,000 | 2 days"
    wards = pairs_of(spark, ["General Ward", "25,000", "meals"], [["Suite", "80,000", ""]])
    assert [p["answer"] for p in wards] == ["25,000 LKR.", "meals.", "80,000 LKR."]
    covered = pairs_of(spark, ["Ordinarily Covered", "Excluded"], [["a", "b"], ["c", ""]])
    assert [p["answer"] for p in covered] == ["a; c.", "b."]
    lines = pairs_of(spark, ["Emergency Hotline", "Ambulance"], [["1990", "1991"], ["24h", ""]])
    assert [p["answer"] for p in lines] == ["1990 (available 24h).", "1991."]
    generic = pairs_of(spark, ["Key", "", "Floor"], [["Desk", "x", "2"], ["Short"]])
    assert [(p["question"], p["answer"]) for p in generic] == [("For Desk at Example House, what is the Floor?", "2.")]
    method = pairs_of(spark, ["Method", "Available At", "Notes"], [["Cash", "all desks", "None"], ["Card", "desk 1", "no fee"]])
    assert [p["answer"] for p in method] == ["Yes, at all desks.", "Yes, at desk 1. Note: no fee."]


TABLES = [
    (
        ["Specialty", "Days", "Hours", "Wait Time"], [["Eye", "Mon, Wed", "9-12", "20 min"]],
        [
            ("On which days is the Eye clinic held at the Example OPD?", "Mon, Wed.", None), ("What are the OPD consultation hours for Eye at Example?", "9-12.", "numeric"),
            ("What is the estimated waiting time for a booked Eye appointment at Example?", "20 min.", "numeric"),
        ],
    ),
    (["Category", "Note", "Fee (LKR)"], [["Adult", "1,500", "x"]], [("What is the consultation fee for a Adult at Example House?", "1,500 LKR.", "numeric")]),
    (["Category", "Fee per visit"], [["Child", "50% off"], ["Senior", "900"]], [("What is the consultation fee for a Child at Example House?", "50% off.", "numeric"), ("What is the consultation fee for a Senior at Example House?", "900 LKR.", "numeric")]),
    (
        ["Test", "Examples", "Turnaround"], [["Blood", "FBC, ESR", "2 h"]],
        [("What is the turnaround time for Blood tests at the Example laboratory?", "2 h.", "numeric"), ("Which tests are included under Blood at Example's laboratory?", "FBC, ESR.", None)],
    ),
    (
        ["Modality", "Preparation", "Report"], [["CT", "fast 4 h", "1 day"]],
        [("What preparation is required before a CT at Example?", "fast 4 h.", "procedural"), ("How long does the CT report take at Example House?", "1 day.", "numeric")],
    ),
    (
        ["Test", "Fasting Required", "Duration"], [["Sugar", "Yes", "8 hours"], ["Iron", "No", "-"]],
        [("Is fasting required for a Sugar at Example House?", "Yes — 8 hours.", "numeric"), ("Is fasting required for a Iron at Example House?", "No.", "factual")],
    ),
    (["Insurer", "Direct", "Pre"], [["Acme", "Yes", "needed"]], [("Does Example House offer direct billing with Acme?", "Yes. Pre-authorisation: needed.", None)]),
    (
        ["Level", "Name", "Meaning", "Target"], [["1", "Red", "Life at risk", "At Once"]],
        [("At Example's emergency department, what does Triage Level 1 (Red) mean, and how quickly should the patient be seen by a doctor?", "Life at risk. Target: seen at once.", "numeric")],
    ),
    (["Item", "Fee (LKR)"], [["Dressing", "300"], ["Stitch", "free"]], [("What is the fee for Dressing at Example's emergency department?", "300 LKR.", "numeric"), ("What is the fee for Stitch at Example's emergency department?", "free.", "numeric")]),
    (["Pharmacy", "Location", "Hours"], [["Main", "Floor 1", "24 h"]], [("Where is the Main at Example House and what are its hours?", "Floor 1; open 24 h.", None)]),
    (["Request Type", "Time"], [["refill", "15 min"]], [("How long does a refill take at the Example pharmacy?", "15 min.", "numeric")]),
    (["Key", "A", "B"], [["k", "", "2"], ["only"]], [("For k at Example House, what is the B?", "2.", None)]),
    (["Procedure", "Price"], [["Scan", "9"]], [("For Scan at Example House, what is the Price?", "9.", None)]),
]


@pytest.mark.parametrize(("header", "rows", "want"), TABLES)
def test_every_template(spark, header, rows, want):
    got = pairs_of(spark, header, rows)
    assert [(p["question"], p["answer"]) for p in got] == [(q, a) for q, a, _ in want]
    assert all(kind is None or p["answer_type"] == kind for p, (_, _, kind) in zip(got, want, strict=True))
    padded = [[*r, *[""] * (len(header) - len(r))] for r in rows]
    assert all(p["evidence"] in {" | ".join(r) for r in padded} for p in got)


def test_pairs_are_numbered_in_order(spark):
    text = DOC.replace("text one", "text one is long enough to be asked about here")
    docs = spark.createDataFrame([(1, text), (2, text.replace("D-1", "SGH-FAQ-9"))], "no int, text string")
    sections = segment.segment(docs, "no").drop("no")
    stems = spark.createDataFrame([(None, "A", "What of A?"), ("D-1", "A", "Own?")], "stem_doc string, stem_heading string, stem string")
    topics = spark.createDataFrame([("D-1", "one")], "doc_id string, topic string")
    authored = spark.createDataFrame([(1, "D-1", "S", "Q?", "A 7", "no number", None), (2, "nobody", "S", "Q?", "A", "A", None)], "ord int, doc_id string, section string, question string, answer string, evidence string, answer_type string")
    pool = derive.number_pairs(derive.derive_pairs(sections, stems, "Example House", "Example"), topics, authored).orderBy("id").collect()
    assert [(r["id"], r["question"], r["topic"], r["needs_attention"]) for r in pool] == [
        ("d-1-q001", "Own?", "one", False), ("d-1-q002", "For 1 at Example House, what is the h2?", "one", False), ("d-1-q003", "Q?", "one", True),
        ("sgh-faq-9-q001", "Why?", "general", False), ("sgh-faq-9-q002", "For 1 at Example House, what is the h2?", "general", False),
    ]
    assert pool[0]["answer"] == "text one is long enough to be asked about here x; y" and pool[3]["answer"] == "because #### four"
