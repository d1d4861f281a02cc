"""Office files made by hand, the review flow from the command line, and lists, numbers and spans beside plain versions."""

import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from umbra import cli
from umbra.functions import scalars as S
from umbra.operators import entities as E
from umbra.operators import mask as M
from umbra.operators import ner
from umbra.operators import review as R
from umbra.plans import samples
from umbra.sources import office, ooxml

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rels(*targets):
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{kind}{k}" Target="{t}"/>' for i, (k, t) in enumerate(targets)) + "</Relationships>"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


def para(*runs):
    return "<w:p>" + "".join(f"<w:r><w:rPr><w:b/></w:rPr><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


DOCX = zipped(
    {
        "_rels/.rels": rels(("officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": rels(("header", "header1.xml"), ("footer", "footer1.xml"), ("hyperlink", "x")),
        "word/header1.xml": f"<w:hdr {W}>{para('Head Acme')}</w:hdr>",
        "word/footer1.xml": f"<w:ftr {W}>{para('Foot')}</w:ftr>",
        "word/document.xml": f"""<w:document {W} xmlns:mc="urn:mc" mc:Ignorable="w14"><w:body>{para("Ac", "me Ltd")}{para("  ")}
          <w:p><w:r><w:t>a</w:t><w:tab/><w:br/></w:r><w:hyperlink r:id="r2"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="r0"/></w:sectPr></w:pPr></w:p>
          <w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{para("wide")}</w:tc></w:tr>
          <w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>{para("tall Acme")}</w:tc><w:tc>{para("c")}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>{para("")}</w:tc><w:tc>{para("d")}</w:tc></w:tr></w:tbl>
          {para("end")}<w:sectPr><w:footerReference w:type="default" r:id="r1"/></w:sectPr></w:body></w:document>""",
        "word/media/b.PNG": ooxml.blank("PNG", 2), "word/media/a.jpg": b"\xff\xd8x", "word/media/c.png": ooxml.blank("PNG", 2),
    }
)
XLSX = zipped(
    {
        "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/s1.xml"), ("worksheet", "/xl/worksheets/s2.xml"), ("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")),
        "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="One" r:id="r0"/><sheet name="Two" r:id="r1"/></sheets></workbook>',
        "xl/sharedStrings.xml": f"<sst {X}><si><t>Acme at 12 Baker Road</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {X}><fills count="1"><fill/></fills><cellXfs count="1"><xf fillId="0"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": f'<worksheet {X}><sheetData><row r="1"><c r="B1" t="s"><v>1</v></c><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2504</v></c></row><row r="2"><c r="A2" t="str"><f>A1&amp;"Acme"</f><v>x</v></c><c r="AA2" t="str"><v>plain</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet {X}><sheetData><row><c t="inlineStr"><is><t>second</t></is></c><c t="b"><v>1</v></c></row></sheetData></worksheet>',
    }
)
SHAPE = "<p:sp>{ph}<p:txBody><a:p><a:r><a:t>{0}</a:t></a:r><a:r><a:t>{1}</a:t></a:r></a:p></p:txBody></p:sp>"
PPTX = zipped(
    {
        "ppt/_rels/presentation.xml.rels": rels(("slide", "slides/slide2.xml"), ("slide", "slides/slide1.xml")),
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r0"/></p:sldIdLst></p:presentation>',
        "ppt/slides/slide1.xml": f"<p:sld {P}><p:cSld><p:spTree><p:grpSp>{SHAPE.format('grou', 'ped', ph='')}</p:grpSp><p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>cell</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame></p:spTree></p:cSld></p:sld>",
        "ppt/slides/slide2.xml": f"<p:sld {P}><p:cSld><p:spTree>{SHAPE.format('Ac', 'me', ph='')}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": rels(("notesSlide", "../notesSlides/n.xml")),
        "ppt/notesSlides/n.xml": f"<p:notes {P}><p:cSld><p:spTree>{SHAPE.format('no', 'tes', ph='<p:nvSpPr><p:nvPr><p:ph type=' + chr(34) + 'body' + chr(34) + '/></p:nvPr></p:nvSpPr>')}</p:spTree></p:cSld></p:notes>",
    }
)


def read(data, ext):
    return [tuple(s) for s in ooxml.segments(data, ext)]


def test_readers():
    assert read(DOCX, ".docx") == [("body", "s", "Acme Ltd"), ("body", "s", "a\t\nlink"), ("body", "s", "end"), ("table", "s", "wide"), ("table", "s", "wide"), ("table", "s", "tall Acme"), ("table", "s", "c"),
                                   ("table", "s", "tall Acme"), ("table", "s", "d"), ("header", "s", "Head Acme"), ("header", "s", "Head Acme"), ("footer", "s", "Foot")]
    assert read(XLSX, ".xlsx") == [("One", "s", "Acme at 12 Baker Road"), ("One", "s", "rich text"), ("One", "n", "2504"), ("One", "f", '=A1&"Acme"'), ("One", "s", "plain"), ("Two", "s", "second"), ("Two", "b", "1")]
    assert read(PPTX, ".pptx") == [("1", "s", "grouped"), ("1", "s", "cell"), ("1", "s", "notes"), ("2", "s", "Acme")]
    with pytest.raises(ValueError):
        read(b"", ".txt")


def test_rewriting_keeps_the_rest():
    change = office._change([("Acme Ltd", "Client $A", False), ("Acme", "X", True)])
    new = ooxml.rewrite(DOCX, ".docx", change)
    assert [s[2] for s in read(new, ".docx")] == ["Client $A", "a\t\nlink", "end", "wide", "wide", "tall X", "c", "tall X", "d", "Head X", "Head X", "Foot"]
    xml = zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml").decode()
    assert 'mc:Ignorable="w14"' in xml and xml.count('<w:highlight w:val="lightGray"/>') == 1 and "<w:b/>" in xml
    new = ooxml.rewrite(XLSX, ".xlsx", change)
    assert [s[2] for s in read(new, ".xlsx")] == ["X at 12 Baker Road", "rich text", "2504", '=A1&"Acme"', "plain", "second", "1"]
    z = zipfile.ZipFile(io.BytesIO(new))
    assert 's="1"' in z.read("xl/worksheets/s1.xml").decode() and "B0B0B0" in z.read("xl/styles.xml").decode() and z.read("xl/sharedStrings.xml") == zipfile.ZipFile(io.BytesIO(XLSX)).read("xl/sharedStrings.xml")
    new = ooxml.rewrite(PPTX, ".pptx", change)
    assert [s[2] for s in read(new, ".pptx")] == ["grouped", "cell", "notes", "X"] and "808080" in zipfile.ZipFile(io.BytesIO(new)).read("ppt/slides/slide2.xml").decode()


def test_images():
    assert [n for n, _ in ooxml.images(DOCX, ".docx")] == ["word/media/a.jpg", "word/media/b.PNG", "word/media/c.png"]
    new, n = ooxml.replace_images(DOCX, ["word/media/a.jpg", "word/media/b.PNG", "nothing"])
    kept = dict(ooxml.images(new, ".docx"))
    assert n == 2 and kept["word/media/a.jpg"] == ooxml.blank("JPEG") and kept["word/media/b.PNG"] == ooxml.blank("PNG") and kept["word/media/c.png"] == ooxml.blank("PNG", 2)
    assert ooxml.blank("JPEG").startswith(b"\xff\xd8\xff\xe0") and ooxml.blank("JPEG").endswith(b"\xff\xd9") and ooxml.prepared(b"\xff\xd8y", "JPEG") == b"\xff\xd8y"


def test_command_line(spark, tmp_path, capsys):
    """Scan, a person's edit, apply and verify of files in a folder; one file is broken, one is of another kind, one is blank."""
    (tmp_path / "in").mkdir()
    for name, data in (("Acme +1.docx", DOCX), ("b.xlsx", XLSX), ("c.pptx", PPTX), ("d.docx", b"no zip"), ("e.txt", b"x"), ("f.docx", samples.build(".docx", []))):
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "list.csv").write_text('﻿value,category\n\n  Acme Ltd , Client\nAcme,=Azure\n"no, such",\n', encoding="utf-8")
    names = sorted(str(x) for x in (tmp_path / "in").iterdir())
    assert cli.main(["extract-text", *names, "--out-dir", str(tmp_path / "text")], spark) == 0
    assert (tmp_path / "text" / "b.txt").read_text() == "Acme at 12 Baker Road\nrich text\nplain\nsecond"
    assert cli.main(["extract-images", *names, "--out-dir", str(tmp_path / "images")], spark) == 0
    manifest = json.loads((tmp_path / "images" / "images_manifest.json").read_text())
    assert [(m["id"], m["all_ids"], m["count"]) for m in manifest] == [("word/media/a.jpg", ["word/media/a.jpg"], 1), ("word/media/b.PNG", ["word/media/b.PNG", "word/media/c.png"], 2)]
    review = tmp_path / "review.json"
    assert cli.main(["scan", *names, "--known-entities", str(tmp_path / "list.csv"), "--out", str(review)], spark) == 2
    err = capsys.readouterr().err
    assert "unsupported file type .txt" in err and "d.docx: can't be read: BadZipFile" in err and "f.docx: no extractable text found" in err
    data = json.loads(review.read_text())
    got = [(i["id"], i["file_index"], i["text"], i["category"], i["placeholder"], i.get("sheet")) for i in data["items"]]
    assert got == [(0, 0, "Acme Ltd", "Client", "Client A", None), (1, 0, "Acme", "Custom", "Azure", None), (2, 1, "Acme", "Custom", "Azure", "One"), (3, 1, "12 Baker Road", "Address", "Address", "One"), (4, 2, "Acme", "Custom", "Azure", None)]
    assert [f["file_name"] for f in data["files"]] == ["Acme +1.docx", "b.xlsx", "c.pptx", "d.docx", "f.docx"]
    data["images"] = [{"file_index": 0, "id": "word/media/b.PNG", "action": "replace"}]
    data["items"][4]["include"] = False
    review.write_text(json.dumps(data))
    out = tmp_path / "out"
    assert cli.main(["apply", str(review), "--output-dir", str(out)], spark) == 0
    assert sorted(x.name for x in out.iterdir() if not x.name.startswith(".")) == ["Azure +1.docx", "b.xlsx", "mapping_log.json", "outcomes.json"]
    assert read((out / "b.xlsx").read_bytes(), ".xlsx")[0][2] == "Azure at Address"
    assert json.loads((out / "mapping_log.json").read_text()) == [{"original": "Acme Ltd", "placeholder": "Client A"}, {"original": "Acme", "placeholder": "Azure"}, {"original": "12 Baker Road", "placeholder": "Address"}]
    said = capsys.readouterr().out
    assert "4 text(s) and 1 image(s) replaced in 2 file(s)" in said and "c.pptx: nothing to mask" in said and "d.docx: nothing to mask" in said
    assert cli.main(["verify", str(out / "Azure +1.docx"), str(out / "b.xlsx"), "--known-entities", str(tmp_path / "list.csv")], spark) == 0
    (tmp_path / "p.pdf").write_bytes(b"%PDF Acme Ltd")
    capsys.readouterr()
    assert cli.main(["verify", names[3], str(tmp_path / "p.pdf"), names[4], names[5], str(out / "b.xlsx"), "--known-entities", str(tmp_path / "list.csv")], spark) == 2
    said = capsys.readouterr()
    assert "d.docx: can't be read" in said.err and "NOT CHECKED" in said.err and "p.pdf: can't be read: there is no reader for PDF" in said.err and "skipped" in said.err
    assert "clean: " in said.out and "d.docx" not in said.out and "p.pdf" not in said.out and "f.docx" in said.out
    assert cli.main(["verify", str(out / "b.xlsx"), names[2], names[3], "--known-entities", str(tmp_path / "list.csv")], spark) == 1


def test_names_of_saved_files(spark, tmp_path):
    rows = [(0, "a.txt", b"1"), (1, "a.txt", b"2"), (2, "a.txt", None), (3, "b", b"")]
    office.save_files(spark.createDataFrame(rows, "file_index long, file_name string, content binary"), str(tmp_path))
    assert {x.name: x.read_bytes() for x in tmp_path.iterdir()} == {"a.txt": b"1", "a (1).txt": b"2", "b": b""}


def test_lists_of_any_length(spark, monkeypatch):
    """A long list by an equi-join claims what a short one in the plan does; repeated texts, nulls, one-letter entities, joined words."""
    r = random.Random(3)
    letters = ["a", "B", "ab", "Bed Rock", "bed", "(x)", "É", "e f g", "a-b", "rock, ab", "_a"]
    texts = [None, "", "BedRock bed  ROCK bedrocks"] + ["".join(r.choice(["a", "b", "B", " ", "\n", "bed", "rock", "(x)", "é", "e", "f", "g", "-", ",", "_"]) for _ in range(r.randint(1, 60))) for _ in range(60)] + ["a b"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = sorted(map(tuple, M.claims(docs, [(v, v) for v in letters], use_regex=False).collect()), key=repr)
    monkeypatch.setattr(E, "LITERAL", 2)
    long = sorted(map(tuple, M.claims(docs, [(v, v) for v in letters], use_regex=False).collect()), key=repr)
    assert short == long and len(short) > 100
    assert sorted(map(tuple, M.verify(docs, [(v, v) for v in letters]).collect()), key=repr)
    names = spark.createDataFrame([(v, " ") for v in letters] + [(" ", "x"), (None, "x")], "value string, category string")
    assert M.known_entities(names).count() == len(letters)
    monkeypatch.undo()
    assert [v for v, _ in M.known_entities(names)][:2] == ["Bed Rock", "rock, ab"] and {c for _, c in M.known_entities(names)} == {"Entity"}


def test_spans_beside_plain_versions(spark):
    r = random.Random(9)
    sizes = [[r.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 500)]
    got = spark.createDataFrame(list(enumerate(sizes)), "i int, x array<int>").select("i", M.before(F.col("x")).alias("s")).orderBy("i").collect()
    assert [x.s for x in got] == [[sum(s[:k]) for k in range(len(s))] for s in sizes]
    many = " ".join("x" * r.randint(1, 3) + "@b.co" * r.randint(0, 1) for _ in range(900))
    claims = M.claims(spark.createDataFrame([(1, many)], "doc_id long, text string"), detectors=("Email",)).collect()
    assert [(c.start, c.text) for c in claims] == [(m.start(), m[0]) for m in re.finditer(r"x+@b\.co", many)] and len(claims) > 300
    spans = [[(a := r.randint(0, 40), a + r.randint(1, 9)) for _ in range(r.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(spans)), "i int, s array<struct<start:int,end:int>>").select("i", M.arbitrate(F.col("s")).alias("a"), M.longest_spans(F.col("s")).alias("l")).orderBy("i")
    for s, row in zip(spans, df.collect(), strict=True):
        for have, order in ((row.a, s), (sorted((tuple(x) for x in row.l)), sorted(s, key=lambda x: (x[0] - x[1], x)))):
            kept = []
            for a, b in order:
                if all(b <= c or a >= d for c, d in kept):
                    kept.append((a, b))
            assert [tuple(x) for x in have] == (kept if order is s else sorted(kept))


def test_numbers(spark):
    """Places in groups by numeric and string keys, and letters of any length."""
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randint(-9000, 90000), r.choice(["", "abcd", "abcde", "b", "é"]) + str(r.randint(0, 99)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, s string, o int")
    for key, col in (("k", 1), ("s", 2)):
        got = {x.o: x.n for x in M.numbered(df, ["g"], key, ["o"], "n").collect()}
        for g in "ab":
            own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[col].encode() if col == 2 else x[col], x[3]))
            assert [got[x[3]] for x in own] == list(range(1, len(own) + 1))
    assert M.numbered(df.limit(0), [], "k", ["o"], "n").count() == 0

    def plain(n):
        return "" if not n else plain((n - 1) // 26) + chr(65 + (n - 1) % 26)

    big = [1, 26, 27, 702, 703, 26**7, 26**7 * 2 + 5, 10**12, 2**62, 2**63 - 1]
    assert [x[0] for x in spark.createDataFrame([(n,) for n in big], "n long").select(S.letters(F.col("n"))).collect()] == [plain(n) for n in big]


def by_words(parts):
    """A tagger by rule: words and their places; digits are numbers, all else proper nouns."""
    words = F.expr(r"regexp_extract_all(chunk, '\\S+', 0)")
    gaps = F.expr(r"split(chunk, '\\S+', -1)")
    own = parts.withColumn("w", words).withColumn("at", M.before(F.transform(gaps, lambda g, i: F.length(g) + F.coalesce(F.length(F.get("w", i)), F.lit(0)))))
    token = lambda x, i: F.struct(x.alias("text"), (F.get("at", i) + F.length(F.get(gaps, i))).alias("start"), F.when(x.rlike(r"^\d"), "NUM").otherwise("PROPN").alias("pos"), F.lit(False).alias("punct"))
    own = own.withColumn("tokens", F.transform("w", token))
    pair = lambda x, i: F.when(x.rlike("^City") & F.get("w", i + 1).rlike("^Of"), F.struct(i.alias("first"), (i + 2).alias("last"), F.lit("GPE").alias("label")))
    return own.withColumn("ents", F.filter(F.transform("w", pair), lambda e: e.isNotNull()))


def test_tagger_on_chunks(spark):
    """Streets beyond the first chunk keep their places in the whole text; empty texts have none; keys may be null or shared."""
    text = "x" * 99_990 + "\n" * 20 + "12 Baker Street"
    docs = spark.createDataFrame([(1, text), (2, ""), (None, None), (None, "7 Jalan Besar"), (None, "7 Jalan Besar")], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text or "", [(x.text, x.start, x.end) for x in r.found]) for r in ner.tagged(docs, by_words).collect())
    street = [("Jalan Besar", 2, 13)]
    assert out == [(0, "", []), (0, "7 Jalan Besar", street), (0, "7 Jalan Besar", street), (1, text, [("12 Baker Street", 100_010, 100_025)]), (2, "", [])]


@pytest.mark.parametrize(("size", "overlap"), [(100, 400), (150, 500), (400, 700)])
def test_chunks_find_what_the_whole_text_has(spark, size, overlap):
    """Entities and streets across every cut are found once and whole; the hard cut loses some."""
    r = random.Random(size)
    texts = [" ".join(r.choice(["12 Baker Street", "City1 Of1 048624", "Jalan Besar", "City2 Of", "word", "and", "9 The Old Kent Road , City3 Of2", "b" * 9]) for _ in range(60)) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tell = lambda **k: {x.doc_id: sorted(tuple(f)[2:] + tuple(f)[:2] for f in x.found) for x in ner.tagged(docs, by_words, **k).collect()}
    whole = tell()
    assert tell(size=size, overlap=overlap) == whole and tell(size=size, overlap=0) != whole and sum(map(len, whole.values())) > 100


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    """A loader that counts: as many loads as workers, not as tasks; no call has more characters than asked, but for one text alone."""
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            open(f"{folder}/call-{sum(map(len, texts)) if len(texts) > 1 else 0}-{uuid.uuid4().hex}", "w").close()
            return [([{"text": t[:5], "start": 0, "pos": "PROPN", "punct": False}], [{"first": 0, "last": 1, "label": "GPE"}]) for t in texts]

        return model

    docs = spark.range(400).selectExpr("id as doc_id", "concat('Paris ', repeat('x', id)) as text").repartition(40)
    found = ner.tagged(docs, ner.provider(load, 1000), overlap=0)
    for _ in range(2):
        assert found.where("found[0].text = 'Paris'").count() == 400
    names = [p.name.split("-") for p in tmp_path.iterdir()]
    pids = [n[1] for n in names if n[0] == "load"]
    assert len(pids) == len(set(pids)) <= 16 and max(int(n[1]) for n in names if n[0] == "call") <= 1000


def test_reviews_without_items(spark):
    files = spark.createDataFrame([], R.FILES)
    f, i, m = R.review_rows(R.review_json(files, spark.createDataFrame([], R.ITEMS)))
    assert f.count() == i.count() == m.count() == 0
    t = R.totals(spark.createDataFrame([], R.ITEMS)).first()
    assert (t.n_items, t.n_images, t.n_files) == (0, 0, 0)
