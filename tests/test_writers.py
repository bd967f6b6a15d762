import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_package import NS, deck

from plumbline.operators import selectors as S
from plumbline.sources import commits, package, writers


def test_resolved_packages_are_the_same_bytes(spark):
    mc = f'<p:sld {NS} xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:new="urn:new"><p:cSld><p:spTree><mc:AlternateContent><mc:Choice Requires="new"><p:sp/></mc:Choice><mc:Fallback><p:pic/></mc:Fallback></mc:AlternateContent></p:spTree></p:cSld></p:sld>'
    chart = '<c><axId val="77"/><axId val="5"/><crossAx val="77"/></c>'
    content = deck(**{"ppt/slides/c.xml": mc, "ppt/charts/x.xml": chart})
    df = spark.createDataFrame([("a", content), ("b", content)], "package_id string, content binary")
    a, b = (bytes(r.content) for r in writers.resolved_packages(package.parts(df)).collect())
    assert a == b
    z = zipfile.ZipFile(io.BytesIO(a))
    assert z.namelist() == sorted(z.namelist()) and b"AlternateContent" not in z.read("ppt/slides/c.xml") and b"pic" in z.read("ppt/slides/c.xml")
    assert z.read("ppt/charts/x.xml") == b'<c><axId val="1"/><axId val="2"/><crossAx val="1"/></c>'


def test_png_and_heads(spark, tmp_path):
    got = writers.difference_images(spark.createDataFrame([(1, [0, 1, 2, 3], [0, 2, 2, 30])], "key long, a array<int>, b array<int>"), 2).first()
    assert bytes(got.image) == writers.png(np.array([[0, 10], [0, 255]], np.uint8)) and bytes(got.image).startswith(b"\x89PNG")
    path = str(tmp_path / "heads.json")
    commits.accept_head(path, "c", 2, "x")
    commits.accept_head(path, "c", 3, "y")
    for n, sha in ((2, "x"), (3, "z")):
        with pytest.raises(ValueError):
            commits.accept_head(path, "c", n, sha)


def test_affected_slides(spark):
    reg = S.Registry()
    sha = reg.register({"selector_id": "noted", "version": 1}, S.notes_or_comments)
    with pytest.raises(ValueError):
        reg.register({"selector_id": "noted", "version": 2}, S.notes_or_comments, sha)
    tables = {"notes": spark.createDataFrame([("d", 1, True, False), ("d", 2, False, False), ("d", 9, False, True)], "deck_id string, slide int, notes boolean, comments boolean"), "slides": spark.createDataFrame([("d", k) for k in (1, 2, 3, 9)], "deck_id string, slide int")}
    rows = [("d", "a", 2, False, ["x"], None, None, None, None), ("d", "b", None, False, ["x", "y"], None, [7, 3, 1, 1], None, None), ("d", "c", None, False, ["x"], "named_selector", None, "noted", sha), ("d", "no", 4, True, ["x"], None, None, None, None), ("d", "none", 4, False, [], None, None, None, None), ("d", "deck", None, False, ["x"], None, [], None, None)]
    f = spark.createDataFrame(rows, "deck_id string, id string, slide int, passed boolean, automatic_fail_if array<string>, affected_mode string, affected_slides array<int>, selector_id string, selector_sha256 string")
    got = {r.id: (r.affected, r.tier_affected) for r in S.affected(f, reg, tables, [1, 2, 3, 4, 5]).collect()}
    assert got == {"a": ([2], [2]), "b": ([1, 3, 7], [1, 3]), "c": ([1, 9], [1]), "deck": ([], [])}
    assert {r.id: r.tier_affected for r in S.affected(f, reg, tables).collect()}["c"] == [1, 9]
    for other in (f.withColumn("selector_sha256", F.lit("sha256:0")), f.withColumn("selector_id", F.lit("new"))):
        with pytest.raises(Exception, match="unknown selector or other hash"):
            S.affected(other.filter("id = 'c'"), reg, tables, [1]).collect()
    e = spark.createDataFrame([("x", "p", "s", 1.0), ("y", "p", "s", 1.0)], "cohort string, pages string, scene string, score double")
    g = spark.createDataFrame([("x", "p", "t", 1.0)], "cohort string, pages string, scene string, score double")
    assert {r.cohort: r.differs for r in S.canary(e, g).collect()} == {"x": "scene", "y": "pages,scene,score"}
