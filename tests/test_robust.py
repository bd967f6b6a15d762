"""Unusual and hostile parts: each fails alone."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F
from test_package import NS, deck, rels, shape, slide

from plumbline import api
from plumbline.functions import lineage
from plumbline.sources import compatibility, datasource, files, markup, package

DEEP = "<p:grpSp>" * 3000 + "</p:grpSp>" * 3000


def tables(spark, **changes):
    part = package.parts(spark.createDataFrame([("d", deck(**changes)), ("fine", deck())], "package_id string, content binary")).cache()
    rel = package.relationships(part.filter("problem is null"))
    return part, rel, package.slides(part, rel)


def test_attributes_in_other_forms(spark):
    look = shape("a").replace('<a:off x="1" y="2"/>', '<a:off x="1.5" y="2pt"/>').replace("<a:solidFill/>", '<a:solidFill><a:srgbClr val="0"><a:alpha val="50%"/></a:srgbClr></a:solidFill>')
    cut = shape("b", kind="pic", extra='<p:blipFill><a:srcRect l="12.5%" t="x" r="99999999999"/></p:blipFill>')
    part, rel, slides = tables(spark, **{"ppt/slides/b.xml": slide(look, cut)})
    n = {r.node_id: r for r in package.nodes(part, rel, slides.filter("package_id = 'd' and slide = 1")).collect()}
    a, b = n["s1:n0"], n["s1:n1"]
    assert (a.x, a.y, a.opacity, a.problems) == (None, 25_400, "0.5", ["x=1.5"])
    assert (b.crop.asDict(), sorted(b.problems)) == ({"l": 12_500, "t": 0, "r": 0, "b": 0}, ["r=99999999999", "t=x"])
    assert package.nodes(part, rel, slides.filter("package_id = 'fine'")).filter("size(problems) > 0").count() == 0


@pytest.mark.parametrize("value,forms,want", [("75000", {}, 75_000), (" -3 ", {}, -3), ("75%", {"thousandths": True}, 75_000), ("0.001%", {"thousandths": True}, 1), ("2.5cm", {"measure": True}, 900_000), ("1in", {"measure": True}, 914_400), ("", {}, None), (None, {}, None)])
def test_numbers(value, forms, want):
    assert markup.whole_number(value, **forms) == want


@pytest.mark.parametrize("value,forms", [("75%", {}), ("1.5", {"measure": True}), ("1e3", {}), ("١", {}), ("9" * 40, {}), ("NaN", {"thousandths": True})])
def test_no_numbers(value, forms):
    with pytest.raises((ValueError, AssertionError)):
        assert isinstance(markup.whole_number(value, **forms), int) and value.isascii()


def test_deep_and_encoded_parts(spark):
    utf16 = f'<?xml version="1.0" encoding="UTF-16"?><p:sldMaster {NS}><p:cSld name="Main"/><a:latin typeface="Wide"/></p:sldMaster>'.encode("utf-16")
    odd = '<?xml version="1.0" encoding="no-such"?><a typeface="Lost"/>'
    changes = {"ppt/slides/b.xml": slide(DEEP), "ppt/slideMasters/m.xml": utf16, "ppt/odd.xml": odd, "ppt/bytes.xml": b"\xff\xfe\x00", "docProps/core.xml": "<a>" * 500 + "</a>" * 500}
    part, rel, slides = tables(spark, **changes)
    good = part.filter("problem is null")
    assert {(r.part_name, r.problem) for r in package.xml_problems(good).collect()} == {("ppt/slides/b.xml", "nested too deep"), ("ppt/odd.xml", "malformed XML"), ("ppt/bytes.xml", "malformed XML"), ("docProps/core.xml", "nested too deep")}
    assert {r.slide for r in package.nodes(good, rel, slides).filter("package_id = 'd'").collect()} == {2}
    assert "Wide" in {r.font for r in package.typefaces(good).collect()} and package.package_digest(part).count() == 2
    for xml in (b"<a>" * 5000 + b"</a>" * 5000, b"", b"<?xml version='1.0' encoding='no-such'?><a/>"):
        with pytest.raises(compatibility.ET.ParseError):
            compatibility.resolve(xml)


@pytest.mark.parametrize("source,target,want", [("ppt/slides/a.xml", "../media/a%20b.png", "ppt/media/a b.png"), ("", "ppt/p.xml", "ppt/p.xml"), ("ppt/a.xml", "/x/y.xml", "x/y.xml"), ("ppt/a.xml", "../../x", None), ("ppt/a.xml", "%2e%2e/%2e%2e/x", None), ("ppt/a.xml", "http://x/y", None), ("ppt/a.xml", "mailto:x", None), ("ppt/a.xml", "//h/x", None), ("ppt/a.xml", "b.xml#x", None), ("ppt/a.xml", "%ff", None), ("ppt/a.xml", "", None), ("ppt/a.xml", "..", None), ("ppt/a.xml", None, None)])
def test_targets(source, target, want):
    assert markup.target_of(source, target) == want


def test_a_target_that_leaves_the_package(spark):
    part, rel, _ = tables(spark, **{"ppt/slides/_rels/b.xml.rels": rels(("rId9", "image", "../../../media/i.png"), ("rId7", "image", "../media/i%2Epng"))})
    got = {r.rel_id: (r.target, r.problem) for r in rel.filter("package_id = 'd' and source = 'ppt/slides/b.xml'").collect()}
    assert got == {"rId9": (None, "target is no part"), "rId7": ("ppt/media/i.png", None)}


def test_broken_tar_files(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for body in (b"one", b"two"):
            info = tarfile.TarInfo("same")
            info.size = 3
            tar.addfile(info, io.BytesIO(body))
    whole = out.getvalue()
    df = spark.createDataFrame([("ok", whole), ("none", None), ("text", b"no tar file"), ("cut", whole[:1600])], "archive string, content binary")
    got = [(r.archive, r.path, r.problem) for r in files.tar_members(df).collect()]
    assert got[:2] == [("ok", "same", None), ("ok", "same", "repeated name")] and {("none", None, "unreadable"), ("text", None, "unreadable")} <= set(got) and ("cut", None, "unreadable") in got


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("opc")
    (d / "more").mkdir()
    for name, content in {"one.pptx": deck(), "more/two.pptx": deck(**{"ppt/slides/b.xml": slide(shape("x", "Two"))}), "bad.pptx": b"no zip", "torn.pptx": deck().replace(b"<Types/>", b"<Types#>")}.items():
        (d / name).write_bytes(content)
    return str(d)


def test_source_gives_the_parts(spark, folder):
    got = datasource.parts(spark, folder)
    want = package.parts(package.packages(spark, folder))
    rows = lambda df: sorted(map(str, df.select("package_id", "part_name", "content", F.when(F.col("problem").startswith("not"), "not a ZIP").otherwise(F.col("problem")).alias("problem")).collect()))
    assert rows(got) == rows(want)
    a = {(r.package_id, r.slide): r.part_name for r in got.filter("slide is not null").collect()}
    assert a["one.pptx", 1] == "ppt/slides/b.xml" and a["two.pptx", 2] == "ppt/slides/a.xml"
    assert {tuple(r) for r in got.filter("slide = 1 and package_id = 'one.pptx'").select("part_name", "targets").collect()[0].targets.items()} == {("rId9", "ppt/media/i.png"), ("rId8", "ppt/notes/n.xml")}


def test_source_gives_the_nodes_without_a_join(spark, folder):
    part = datasource.parts(spark, folder)
    old = package.parts(package.packages(spark, folder)).filter("problem is null")
    rel = package.relationships(old)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(datasource.nodes(part)) == rows(package.nodes(old, rel, package.slides(old, rel)))
    plan = datasource.nodes(part.filter("slide = 2"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("condition,most", [("true", 99), ("slide = 1", 4), ("slide in (1, 2)", 6), ("part_name = 'ppt/media/i.png'", 4), ("startswith(part_name, 'ppt/media/')", 5), ("part_name like '%.rels' and package_id = 'one.pptx'", 5), ("part_name is null", 0), ("package_id = 'nowhere'", 0), ("slide is null and endswith(part_name, 'core.xml')", 3)])
def test_pushed_filters_decide_what_is_inflated(spark, folder, condition, most, monkeypatch):
    """The same rows as without pushing; and no more members inflated than needed, counted in this process."""
    df = datasource.parts(spark, folder)
    wanted = [tuple(r) for r in df.filter(F.expr(condition)).select("package_id", "part_name").collect()]
    plain = [tuple(r) for r in lineage.cut(df).filter(F.expr(condition)).select("package_id", "part_name").collect()]
    assert sorted(map(str, wanted)) == sorted(map(str, plain))
    reader, read, opened = datasource.PackageReader({"path": folder}), [], []
    one = datasource.EqualTo, datasource.In, datasource.StringStartsWith, datasource.StringEndsWith, datasource.IsNull
    filters = {
        "slide = 1": [one[0](("slide",), 1)], "slide in (1, 2)": [one[1](("slide",), [1, 2])], "part_name = 'ppt/media/i.png'": [one[0](("part_name",), "ppt/media/i.png")], "startswith(part_name, 'ppt/media/')": [one[2](("part_name",), "ppt/media/")],
        "part_name like '%.rels' and package_id = 'one.pptx'": [one[3](("part_name",), ".rels"), one[0](("package_id",), "one.pptx")], "part_name is null": [one[4](("part_name",))], "package_id = 'nowhere'": [one[0](("package_id",), "nowhere")], "slide is null and endswith(part_name, 'core.xml')": [one[4](("slide",)), one[3](("part_name",), "core.xml")],
    }
    assert list(reader.pushFilters(filters.get(condition, []))) == []
    inflate, start = datasource.zipfile.ZipFile.read, datasource.zipfile.ZipFile.__init__
    monkeypatch.setattr(datasource.zipfile.ZipFile, "read", lambda z, i, *a: read.append((len(opened), getattr(i, "filename", i))) or inflate(z, i, *a))
    monkeypatch.setattr(datasource.zipfile.ZipFile, "__init__", lambda z, f, *a, **k: opened.append(f) or start(z, f, *a, **k))
    got = [row[:2] for p in reader.partitions() for row in reader.read(p)]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    of = max((sum(z == x for x, _ in read) for z in {z for z, _ in read}), default=0)
    assert len(opened) <= 4 and (condition == "true" or of <= most)


def test_partitions_by_size(folder):
    assert len(datasource.PackageReader({"path": folder, "partition_bytes": "1"}).partitions()) == 4
    assert len(datasource.PackageReader({"path": f"file://{folder}"}).partitions()) == 1
    names = datasource.PackageReader({"path": f"{folder}/one.pptx", "content": "false"})
    assert [r[4] for p in names.partitions() for r in names.read(p)] == [None] * 12


def test_decks_open_each_package_once(spark, folder):
    decks = api.Decks(spark, folder)
    assert {r.package_id for r in decks.nodes.collect()} == {"one.pptx", "two.pptx", "torn.pptx"}
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (decks.nodes, decks.relationships, decks.slides, decks.media, decks.names, decks.digests, decks.problems)]
    assert not any("opc_parts" in p or "binaryFile" in p for p in plans)
