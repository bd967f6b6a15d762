import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.sources import compatibility, files, package, quarantine, sinks

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
T = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def rels(*xs):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{T}{t}" Target="{g}"/>' for i, t, g in xs) + "</Relationships>"


def shape(name, text="", ph="", kind="sp", extra="", font="Carlito"):
    body = f'<p:txBody><a:p><a:r><a:rPr sz="1800" b="1" lang="en-US"><a:latin typeface="{font}"/></a:rPr><a:t>{text}</a:t></a:r></a:p></p:txBody>' if text else ""
    return f'<p:{kind}><p:nv{"Sp" if kind == "sp" else "Pic"}Pr><p:cNvPr id="1" name="{name}"/><p:nvPr>{ph}</p:nvPr></p:nv{"Sp" if kind == "sp" else "Pic"}Pr>{extra}<p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="100" cy="200"/></a:xfrm><a:solidFill/></p:spPr>{body}</p:{kind}>'


def slide(*objects):
    return f"<p:sld {NS}><p:cSld><p:spTree>{''.join(objects)}</p:spTree></p:cSld></p:sld>"


GROUP = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="g"/></p:nvGrpSpPr><p:grpSpPr/>{shape("inner", "in")}{shape("inner2")}</p:grpSp>'
TABLE = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="3" name="t"/></p:nvGraphicFramePr><a:graphic><a:graphicData uri="t"><a:tbl><a:tblGrid><a:gridCol/><a:gridCol/></a:tblGrid><a:tr/><a:tr/><a:tr/></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
PIC = shape("pic", kind="pic", extra='<p:blipFill><a:blip r:embed="rId9"/></p:blipFill>')


def core(revision, title="t"):
    return f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties"><cp:revision>{revision}</cp:revision><title>{title}</title></cp:coreProperties>'


def deck(**changes):
    parts = {
        "[Content_Types].xml": "<Types/>",
        "_rels/.rels": rels(("rId1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId id="2" r:id="rId2"/><p:sldId id="1" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/a.xml"), ("rId2", "slide", "slides/b.xml"), ("rId3", "slideMaster", "slideMasters/m.xml")),
        "ppt/slides/a.xml": slide(shape("title", "Hello", '<p:ph type="title"/>'), GROUP, TABLE),
        "ppt/slides/b.xml": slide(PIC, shape("x", "World", font="Comic")),
        "ppt/slides/_rels/b.xml.rels": rels(("rId9", "image", "../media/i.png"), ("rId8", "notesSlide", "../notes/n.xml")),
        "ppt/slideMasters/m.xml": f'<p:sldMaster {NS}><p:cSld name="Main"/></p:sldMaster>',
        "ppt/media/i.png": "PNG",
        "ppt/media/unused.png": "PNG2",
        "ppt/notes/n.xml": "<n/>",
        "docProps/core.xml": core(1),
    } | changes
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("decks")
    for name, content in {"one.pptx": deck(), "same.pptx": deck(**{"docProps/core.xml": core(2)}), "other.pptx": deck(**{"ppt/notes/n.xml": "<n>x</n>"}), "bad.pptx": b"no zip", "evil.pptx": deck(**{"../x": "y"})}.items():
        (d / name).write_bytes(content)
    p = package.packages(spark, str(d))
    part = package.parts(p).cache()
    one = part.filter("package_id = 'one.pptx'")
    rel = package.relationships(one).cache()
    return p, part, one, rel, package.slides(one, rel).cache()


def test_slides_nodes_and_order(read):
    _, _, one, rel, slides = read
    assert [(r.slide, r.part_name) for r in slides.orderBy("slide").collect()] == [(1, "ppt/slides/b.xml"), (2, "ppt/slides/a.xml")]
    n = {r.node_id: r for r in package.nodes(one, rel, slides).collect()}
    assert set(n) == {"s1:n0", "s1:n1", "s2:n0", "s2:n1", "s2:n1.0", "s2:n1.1", "s2:n2"}
    assert n["s1:n0"].kind == "picture" and n["s1:n0"].asset == "ppt/media/i.png" and n["s1:n0"].cy == 200
    assert n["s2:n0"].kind == "placeholder" and n["s2:n0"].placeholder_type == "title" and n["s2:n0"].runs[0].asDict() == {"text": "Hello", "font": "Carlito", "size": 1800, "bold": True, "italic": None, "language": "en-US"}
    assert n["s2:n1"].kind == "group" and n["s2:n1"].runs == [] and n["s2:n1.1"].z_index == 1 and n["s2:n1.0"].depth == 2
    assert (n["s2:n2"].kind, n["s2:n2"].table_rows, n["s2:n2"].table_cols) == ("table", 3, 2)
    assert package.nodes(one, rel, slides.filter("slide = 1")).count() == 2


def test_parts_of_the_deck(read):
    _, part, one, rel, slides = read
    assert package.media(one).count() == 2
    assert {r.font for r in package.typefaces(one).collect()} == {"Carlito", "Comic"}
    assert [(r.level, r.name) for r in package.layout_names(one).collect()] == [("Master", "Main")]
    assert {r.slide: (r.notes, r.comments) for r in package.notes_and_comments(rel, slides).collect()} == {1: (True, False), 2: (False, False)}
    assert {r.part_name for r in package.orphans(one, rel).collect()} == {"ppt/media/unused.png", "docProps/core.xml"}


def test_digests_and_safety(read):
    p, part, *_ = read
    d = {r.package_id: r for r in package.package_digest(part).collect()}
    assert d["one.pptx"].digest == d["same.pptx"].digest != d["other.pptx"].digest
    assert d["one.pptx"].bytes_digest != d["same.pptx"].bytes_digest
    v = {r.package_id: r.verdict for r in quarantine.safety(p).collect()}
    assert v == {"one.pptx": "ok", "same.pptx": "ok", "other.pptx": "ok", "bad.pptx": "not a ZIP", "evil.pptx": "unsafe name"}


TYPES = "[Content_Types].xml"


def workbook(**changes):
    parts = {TYPES: quarantine.WORKBOOK_TYPE.decode(), "xl/workbook.xml": "<w/>"} | changes
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


SHEETS = {TYPES: f"<Types>{quarantine.SHEET_TYPE.decode()}</Types>"}
WRONG = {
    "empty": b"", "not a ZIP": b"no zip", "unreadable": deck().replace(b"<Types/>", b"<Types#>"), "unsafe name": deck(**{"a/../b.xml": ""}), "name not NFC": deck(**{"e\u0301.xml": ""}),
    "executable": deck(**{"x.PS1": "y"}), "nested archive": deck(**{"x.zip": "y"}), "active content": deck(**{"ppt/activeX/a.xml": ""}), "active content type": deck(**{TYPES: "macroEnabled"}),
    "external relationship": deck(**{"x.rels": "<r targetmode = 'external'/>"}), "hidden OLE": deck(**{"ppt/media/x.png": quarantine.OLE + b"x"}), "embedded: not a workbook": deck(**SHEETS, **{"ppt/embeddings/a.bin": "x"}),
    "embedded: not a ZIP": deck(**SHEETS, **{"ppt/embeddings/a.xlsx": "x"}), "embedded: missing xl/workbook.xml": deck(**SHEETS, **{"ppt/embeddings/a.xlsx": workbook(**{"xl/workbook.xml": ""}).replace(b"xl/workbook", b"xl/workbooc")}),
    "embedded: ratio too high": deck(**SHEETS, **{"ppt/embeddings/a.xlsx": workbook(**{"xl/a.xml": "x" * 100_000})}), "embedded: nested package": deck(**SHEETS, **{"ppt/embeddings/a.xlsx": workbook(**{"xl/embeddings/b.bin": "x"})}),
    "embedded: external relationship": deck(**SHEETS, **{"ppt/embeddings/a.xlsx": workbook(**{"xl/a.rels": 'TargetMode="External"'})}), "0 slides": deck(), "ok": deck(**SHEETS, **{"ppt/slides/slide1.xml": slide(), "ppt/embeddings/a.xlsx": workbook()}),
}


def test_verdicts():
    limit = quarantine.Limits()
    for want, content in WRONG.items():
        assert quarantine.verdict(content, limit, 0 if want == "0 slides" else None).replace("4 slides", "0 slides") == ("ok" if want == "0 slides" else want)
    assert quarantine.verdict(deck(), limit, 5) == "0 slides"
    assert quarantine.verdict(deck(), quarantine.Limits(members=3)) == "too many parts" and quarantine.verdict(deck(), quarantine.Limits(size=100)) == "too large"
    with_sheet = WRONG["ok"]
    assert quarantine.verdict(with_sheet, quarantine.Limits(members=14)) == "too many parts"


def test_bad_packages_and_parts_fail_alone(spark):
    bomb = workbook(**{"a.xml": "x" * 1_000_000})
    broken = deck(**{"ppt/slides/b.xml": "<p:sld", "ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/a.xml"), ("rId2", "slide", "slides/b.xml")), "x.rels": "<"})
    torn = deck().replace(b"<Types/>", b"<Types#>")
    df = spark.createDataFrame([("bomb", bomb), ("broken", broken), ("torn", torn), ("none", None), ("fine", deck())], "package_id string, content binary")
    part = package.parts(df).cache()
    assert {(r.package_id, r.part_name): r.problem for r in part.filter("problem is not null").collect()} == {("bomb", None): "ratio too high", ("torn", TYPES): "unreadable", ("none", None): "empty"}
    good = part.filter("problem is null")
    rel = package.relationships(good)
    seen = package.nodes(good, rel, package.slides(good, rel)).groupBy("package_id", "slide").count().collect()
    assert {(r.package_id, r.slide) for r in seen} == {("broken", 2), ("torn", 1), ("torn", 2), ("fine", 1), ("fine", 2)}
    assert {(r.package_id, r.part_name, r.problem) for r in package.xml_problems(good).collect()} == {("broken", "ppt/slides/b.xml", "malformed XML"), ("broken", "x.rels", "malformed XML")}
    assert package.package_digest(part).count() == 3


def test_slide_lists_by_namespace(spark):
    other = deck()[:0] + deck(**{"ppt/presentation.xml": f'<q:presentation {NS.replace("xmlns:p", "xmlns:q").replace("xmlns:r", "xmlns:rel")}><q:sldIdLst><q:sldId rel:id=\'rId1\' id="1"/></q:sldIdLst></q:presentation>', "ppt/slideMasters/m.xml": f"<q:sldMaster {NS.replace('xmlns:p', 'xmlns:q')}><q:cSld name='Other &amp; more'/></q:sldMaster>"})
    lists = {"other": other, "twice": deck(**{"ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/a.xml"), ("rId2", "slide", "slides/a.xml"))}), "lost": deck(**{"ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/a.xml"), ("rId2", "image", "slides/b.xml"))}), "gone": deck(**{"ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/a.xml"), ("rId2", "slide", "slides/z.xml"))}), "none": deck(**{"ppt/presentation.xml": f"<p:presentation {NS}/>"})}
    part = package.parts(spark.createDataFrame(list(lists.items()), "package_id string, content binary")).cache()
    rel = package.relationships(part)
    assert [(r.slide, r.part_name) for r in package.slides(part, rel).filter("package_id = 'other'").collect()] == [(1, "ppt/slides/a.xml")]
    assert [r.name for r in package.layout_names(part).filter("package_id = 'other'").collect()] == ["Other & more"]
    assert {r.package_id: r.problem for r in package.slide_problems(part, rel).collect()} == {"twice": "slide part twice", "lost": "slide id without a slide", "gone": "slide part missing", "none": "no slides"}


def test_occurrences_and_looks(spark):
    look = shape("pic", kind="pic", extra='<p:blipFill><a:blip r:embed="rId9"/><a:srcRect l="1000" b="25"/></p:blipFill>').replace("<a:solidFill/>", '<a:prstGeom prst="ellipse"/><a:solidFill><a:srgbClr val="0"><a:alpha val="40500"/></a:srgbClr></a:solidFill><a:ln><a:noFill/></a:ln><a:effectLst><a:innerShdw/></a:effectLst>')
    content = deck(**{"ppt/slides/b.xml": slide(shape("a"), look, shape("b"), GROUP)})
    part = package.parts(spark.createDataFrame([("d", content)], "package_id string, content binary"))
    rel = package.relationships(part)
    n = {r.node_id: r for r in package.nodes(part, rel, package.slides(part, rel).filter("slide = 1")).collect()}
    top = "/p:sld/p:cSld/p:spTree"
    assert {k: (r.z_index, r.occurrence, r.locator) for k, r in n.items()} == {"s1:n0": (0, 1, f"{top}/p:sp[1]"), "s1:n1": (1, 1, f"{top}/p:pic[1]"), "s1:n2": (2, 2, f"{top}/p:sp[2]"), "s1:n3": (3, 1, f"{top}/p:grpSp[1]"), "s1:n3.0": (0, 1, f"{top}/p:grpSp[1]/p:sp[1]"), "s1:n3.1": (1, 2, f"{top}/p:grpSp[1]/p:sp[2]")}
    p = n["s1:n1"]
    assert (p.crop.asDict(), p.cropped_to_shape, p.fill, p.opacity, p.stroke, p.shadow) == ({"l": 1000, "t": 0, "r": 0, "b": 25}, True, "solidFill", "0.405", False, True)
    assert (n["s1:n0"].crop, n["s1:n0"].cropped_to_shape, n["s1:n0"].opacity) == (None, False, "1")


@pytest.mark.parametrize("branches", ["<mc:Choice Requires='n'/>", "<mc:Fallback/>", "<mc:Choice Requires=''/>", "<mc:Fallback/><mc:Choice Requires='n'/>", "<mc:Choice Requires='n'/><mc:Fallback/><mc:Fallback/>", "<mc:Choice Requires='n'/><x/>"])
def test_alternatives_that_cannot_be_resolved(branches):
    xml = f"<a xmlns:mc='{package.MC[1:-1]}' xmlns:n='urn:n'><mc:AlternateContent>{branches}</mc:AlternateContent></a>".encode()
    assert len(compatibility.resolve(xml)) == 0
    with pytest.raises(compatibility.NotUnderstood):
        compatibility.resolve(xml, strict=True)


def test_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/deck.yaml").write_text('---\n{"id": "a", "tier": 1}\n---\n[{"id": "b", "tier": 2}, {"id": "c", "tier": 3}]\n')
    got = files.multi_documents(spark, str(tmp_path / "c"), "id string, tier int").orderBy("document", "item").collect()
    assert [(r.id, r.tier) for r in got] == [("a", 1), ("b", 2), ("c", 3)]
    md = spark.createDataFrame([("d", '<!-- {"v": 1} -->\n# Head\n\nIntro line\nmore:\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```\ncode\n```\n### SLIDE 1: First\nbody\n### SLIDE 2: Second\nmore')], "k string, t string")
    assert json.loads(md.select(files.json_header("t")).first()[0]) == {"v": 1}
    assert [(r.slide, r.title, r.body) for r in files.sections(md, "t", ["k"]).collect()] == [(1, "First", "body"), (2, "Second", "more")]
    strict = files.strict_json(spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "b": 2}',), ("{}",), ("x",)], "j string"), "j", "a int", ("a",))
    assert [r.problem for r in strict.collect()] == [None, "unknown b", "missing a", "not an object"]
    t = files.tree(spark, f"file:{tmp_path}")
    assert [(r.path, r.length) for r in t.collect()] == [("c/deck.yaml", (tmp_path / "c/deck.yaml").stat().st_size)]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        info = tarfile.TarInfo("x/y")
        info.size, info.mode = 3, 0o755
        tar.addfile(info, io.BytesIO(b"abc"))
        tar.addfile(tarfile.TarInfo("../z"), io.BytesIO(b""))
    got = {r.path: r for r in files.tar_members(spark.createDataFrame([("t", out.getvalue())], "archive string, content binary")).collect()}
    assert got["x/y"].executable and got["x/y"].length == 3 and got["../z"].problem == "leaves the archive"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (1920).to_bytes(4, "big") + (1080).to_bytes(4, "big")
    (tmp_path / "slide-07.png").write_bytes(png)
    r = files.images(spark, str(tmp_path)).first()
    assert (r.slide, r.width, r.height) == (7, 1920, 1080)
    pdf = files.pdf_boxes(spark.createDataFrame([("p", b"%PDF /MediaBox [0 0 960.009448818898 540] /CropBox[0 0 10 20]")], "k string, content binary")).collect()
    assert [(r.kind, float(r.width), float(r.height)) for r in pdf] == [("Media", 960.009448818898, 540), ("Crop", 10, 20)]


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([(1, 0.5), (2, None)], "id long, score double")
    sinks.append_unique(runs, str(tmp_path / "runs"), ["id"])
    with pytest.raises(ValueError):
        sinks.append_unique(runs, str(tmp_path / "runs"), ["id"])
    with pytest.raises(ValueError):
        sinks.append_unique(runs.union(runs), str(tmp_path / "other"), ["id"])
    assert [r.summary for r in sinks.text_summary(runs, "score", F.col("score") > 0.4).orderBy("id").collect()] == ["PASS 0.5000", "INCOMPLETE"]
    html = sinks.html_report(spark.createDataFrame([("d", "b", "<x>"), ("d", "a", None)], "k string, i string, v string"), ["k"], ["i", "v"]).first().html
    assert html.index("<td>a</td>") < html.index("<td>b</td><td>&lt;x&gt;</td>")
    blobs = spark.createDataFrame([("sha256:ab1", "x"), ("sha256:ab1", "x"), ("sha256:cd2", "y")], "sha256 string, body string")
    assert sinks.publish(blobs, str(tmp_path / "cas")).count() == 2 and sinks.publish(blobs, str(tmp_path / "cas")).count() == 2
    sinks.json_report(runs, str(tmp_path / "json"))
    log = sinks.delivery_log(spark.createDataFrame([(1, "u", "b"), (2, "down", "b")], "delivery_id long, url string, body string"), lambda url, body: 503 if url == "down" else 204)
    got = log.collect()
    assert [(r.delivery_id, r.attempt, r.outcome) for r in got] == [(1, 1, "delivered")] + [(2, n, "failed") for n in (1, 2, 3, 4)]
    signed = sinks.delivery_log(spark.createDataFrame([(1, "u", "b")], "delivery_id long, url string, body string"), lambda url, body, sign: 204 if sign == sinks.signature("s", 111, "b") else 503, waits=(1, 10, 20), secret="s", clock=100)
    assert [r.status for r in signed.collect()] == [503, 204]
    many = spark.range(30).selectExpr("id as k", "id as v")
    with pytest.raises(ValueError):
        sinks.check_output(many, 10)
    found = json.loads(sinks.check_output(many, 10, str(tmp_path / "changes"))[1])
    assert found["changed_objects"] == 30 and len(found["changes"]) == 10 and spark.read.json(found["all_changes"]).count() == 30
    listed = sinks.manifest(spark.createDataFrame([("b", "x"), ("a", "é")], "path string, body string"), "path", "body").collect()
    assert [(r.path, r.size) for r in listed] == [("a", 2), ("b", 1)]
    items = spark.createDataFrame([("d", "y", True), ("d", "x", None)], "deck_id string, id string, passed boolean")
    text = sinks.report(spark.createDataFrame([("d", 0.5)], "deck_id string, fidelity double"), items, items.limit(0).select("deck_id", F.col("id").alias("rule_id"), F.col("id").alias("disposition")), ["deck_id"]).first().report
    assert json.loads(text) == {"deck_id": "d", "fidelity": 0.5, "items": [{"id": "x"}, {"id": "y", "passed": True}]}
    assert sinks.check_output(runs.filter("false")) == (0, '{"status": "same", "changed_objects": 0, "changes": []}')
    assert sinks.check_output(runs.filter("id = 1"))[0] == 1
