import json

from pyspark.sql import functions as F

from paperloom.operators import listing as L
from paperloom.sources import intake as I

SCHEMA = "source string, branch string, year int, semester int, question_bank boolean, path array<string>, name string, url string"


def test_classification(spark):
    rows = [
        ("a", "CSE", 2, None, False, ["Year 2", "CSE", "4. dbms", "CIE papers"], "CIE_2 may 2021.pdf", "u1"),
        ("a", "ISE", 2, None, False, ["Year 2", "ISE", "DBMS", "CIE papers"], "CIE_2 may 2021.pdf", "u1"),
        ("a", "CSE", 2, None, False, ["Year 2", "CSE", "operating systems & design"], "Module 1 notes.pdf", "u2"),
        ("a", "Civil", 3, None, False, ["Year 3", "Civil", "SOIL MECHANICS OF CLAY", "5th sem", "2020 batch"], "SEE 2019.jpg", "u3"),
        ("a", "CSE", 1, None, False, ["First year", "CSE stream", "Chemistry cycle", "Maths", "question papers"], "june 2022.png", "u4"),
        ("a", None, None, None, True, ["Question bank", "Sem 3", "1. Transforms"], "unit.docx", "u5"),
        ("a", "CSE", 2, None, False, ["Year 2", "CSE", "ds"], "see.exe", "u6"),
    ]
    papers = L.classify(spark.createDataFrame(rows, SCHEMA))
    got = {r.url: r for r in L.merge_shared(papers).collect()}
    assert sorted(got) == ["u1", "u3", "u4", "u5"]
    assert (got["u1"].subject, got["u1"].exam_type, got["u1"].year, got["u1"].month, got["u1"].branch) == ("Database Management Systems", "CIE 2", 2021, "May", "CSE, ISE")
    assert (got["u3"].subject, got["u3"].exam_type, got["u3"].year, got["u3"].semester, got["u3"].kind, got["u3"].dept) == ("Soil Mechanics of Clay", "SEE", 2019, 5, "image", "CV")
    assert (got["u4"].subject, got["u4"].semester, got["u4"].study_year, got["u4"].month) == ("Mathematics", 2, 1, "Jun")
    assert (got["u5"].subject, got["u5"].exam_type, got["u5"].kind) == ("Mathematics Transforms", "Question bank", "doc")


def test_course_matching(spark):
    c = spark.createDataFrame([("C1", "Database Management Systems", "CSE", 4, 0), ("C2", "Data Structures", "CSE", 3, 1), ("C3", "Data Structures", "ISE", 3, 2)], "code string, title string, dept string, semester int, place int")
    p = spark.createDataFrame([(1, "Database Management", "CSE", 5), (2, "DS", "CSE", None), (3, "dsa", "ISE", 3), (4, "Data Structures", "CSE", 7), (5, "Botany", "CSE", 3)], "paper_id long, subject string, dept string, semester int")
    m = L.match_courses(p, c)
    assert {r.paper_id: r.course_code for r in m.collect()} == {1: "C1", 2: "C2", 3: "C3", 4: None, 5: None}
    assert tuple(L.match_rate(p, m).first()) == (5, 5, 3)


def test_intake(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "first_paper-2020.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "sub" / "scan.PNG").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "in" / "fake.pdf").write_bytes(b"hello")
    (tmp_path / "in" / "notes.docx").write_bytes(b"PK")
    files = I.scan_folder(spark, str(tmp_path / "in"))
    got = {r.path.rsplit("/", 1)[1]: (r.mime, r.title, r.refused) for r in I.gate(I.wanted(files)).collect()}
    assert got == {"first_paper-2020.pdf": ("application/pdf", "first paper 2020", None), "scan.PNG": ("image/png", "scan", None), "fake.pdf": (None, "fake", "type")}
    assert I.skipped(files).count() == 1 and {r.refused for r in I.gate(I.wanted(files), 5).collect()} == {"size", "type"}
    (tmp_path / "m.json").write_text("﻿" + json.dumps([{"file": "sub/scan.PNG", "url": "https://x"}]), encoding="utf-8")
    linked = I.with_manifest(I.wanted(files), spark, str(tmp_path / "m.json"), str(tmp_path / "in"))
    assert sorted(r.source_url or "" for r in linked.collect()) == ["", "", "https://x"]


def test_json_sources_and_links(spark, tmp_path):
    scheme = {"program": "P", "scheme": "2024", "semester": 5, "courses": [{"code": "ab1", "title": "T", "credits": {"L": 3, "T": 0, "P": 1, "total": 4}}]}
    (tmp_path / "s.json").write_text(json.dumps(scheme))
    r = I.scheme_courses(spark, str(tmp_path / "s.json")).first()
    assert (r.code, r.semester, r.credits.total) == ("AB1", 5, 4)
    (tmp_path / "e.json").write_text(json.dumps({"papers": [{"url": "u"}, {"url": "v", "year": 2020}]}))
    assert [tuple(x) for x in I.external_papers(spark, str(tmp_path / "e.json"), "url: string, year: int").orderBy("url").collect()] == [("u", None), ("v", 2020)]
    page = '<h2>Stream A</h2><h3>Cycle &amp; one</h3><a class="x" href="https://h/folders/abc-1">Maths &quot;I&quot;</a><h3>Two</h3><a href="/f.pdf"> File </a>'
    p = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = I.links(p).orderBy("pos").collect()
    assert [(x.title, x.folder_id, x.is_folder) for x in got] == [('Maths "I"', "abc-1", True), ("File", None, False)]
    assert [(x.h1, x.h2, x.h3, x.title) for x in I.links_under_headings(p).orderBy("pos").collect()] == [(None, "Stream A", "Cycle & one", 'Maths "I"'), (None, "Stream A", "Two", "File")]
    assert p.select(F.lit(1)).count() == 1
