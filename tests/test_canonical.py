import hashlib
import io
import random
import zipfile

import pytest
from test_package import core

from plumbline.sources import canonical as C
from plumbline.sources import markup
from plumbline.sources.package import MC

CASES = {
    # Examples of Canonical XML 1.0, section 3, without DTDs and comments.
    '<?xml version="1.0"?>\n\n<?xml-stylesheet   href="doc.xsl"\n   type="text/xsl"   ?>\n\n<doc>Hello, world!<!-- Comment 1 --></doc>\n\n<?pi-without-data     ?>\n\n<!-- Comment 2 -->\n\n<!-- Comment 3 -->': '<?xml-stylesheet href="doc.xsl"\n   type="text/xsl"   ?>\n<doc>Hello, world!</doc>\n<?pi-without-data?>',
    "<doc>\n   <clean>   </clean>\n   <dirty>   A   B   </dirty>\n   <mixed>\n      A\n      <clean>   </clean>\n      B\n   </mixed>\n</doc>": "<doc>\n   <clean>   </clean>\n   <dirty>   A   B   </dirty>\n   <mixed>\n      A\n      <clean>   </clean>\n      B\n   </mixed>\n</doc>",
    '<doc><e1   /><e2   ></e2><e3   name = "elem3"   id="elem3"   /><e5 a:attr="out" b:attr="sorted" attr2="all" attr="I\'m" xmlns:b="http://www.ietf.org" xmlns:a="http://www.w3.org" xmlns="http://example.org"/><e6 xmlns="" xmlns:a="http://www.w3.org"><e7 xmlns="http://www.ietf.org"><e8 xmlns="" xmlns:a="http://www.w3.org"><e9 xmlns="" xmlns:a="http://www.ietf.org"/></e8></e7></e6></doc>': '<doc><e1></e1><e2></e2><e3 id="elem3" name="elem3"></e3><e5 xmlns="http://example.org" xmlns:a="http://www.w3.org" xmlns:b="http://www.ietf.org" attr="I\'m" attr2="all" b:attr="sorted" a:attr="out"></e5><e6 xmlns:a="http://www.w3.org"><e7 xmlns="http://www.ietf.org"><e8 xmlns=""><e9 xmlns:a="http://www.ietf.org"></e9></e8></e7></e6></doc>',
    "<doc><text>First line&#x0d;&#10;Second line</text><value>&#x32;</value><compute><![CDATA[value>\"0\" && value<\"10\" ?\"valid\":\"error\"]]></compute><norm attr=' &apos;   &#x20;&#13;&#xa;&#9;   &apos; '/></doc>": "<doc><text>First line&#xD;\nSecond line</text><value>2</value><compute>value&gt;\"0\" &amp;&amp; value&lt;\"10\" ?\"valid\":\"error\"</compute><norm attr=\" '    &#xD;&#xA;&#x9;   ' \"></norm></doc>",
    '<a xml:lang="de" xmlns:unused="urn:u"><b xml:lang="en" xmlns:unused="urn:u"/></a>': '<a xmlns:unused="urn:u" xml:lang="de"><b xml:lang="en"></b></a>',
}


@pytest.mark.parametrize("xml", CASES)
def test_canonical_form(xml):
    assert C.c14n(markup.read(xml.encode())).decode() == CASES[xml]
    again = C.c14n(markup.read(CASES[xml].encode()))
    assert again.decode() == CASES[xml] == C.c14n(markup.read(xml.encode("utf-16"))).decode() if not xml.startswith("<?xml ") else again


@pytest.mark.parametrize("xml", ["<a:b/>", "<a x:y='1'/>", '<a b="1" b="2"/>', '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>', "<a>", "", '<a xmlns:p="u" xmlns:q="u" p:x="1" q:x="2"/>'])
def test_not_well_formed(xml):
    with pytest.raises(markup.ET.ParseError):
        markup.read(xml.encode())


MAIN = "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"


def parts(**changes):
    return {
        "[Content_Types].xml": f'<Types xmlns="{C.TYPES[1:-1]}"><Default Extension="rels" ContentType="{C.LINKS_TYPE}"/><Default Extension="png" ContentType="image/png"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/><Override PartName="/ppt/presentation.xml" ContentType="{MAIN}"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{LINKS}"><Relationship Id="rId2" Type="{LINKS}/metadata/core-properties" Target="docProps/core.xml"/><Relationship Id="rId1" Type="{C.MAIN}" Target="ppt/presentation.xml"/></Relationships>',
        "docProps/core.xml": core(1),
        "ppt/presentation.xml": '<p:presentation xmlns:p="urn:p"><p:list b="2" a="1"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{LINKS}"><Relationship Id="a" Type="{OFFICE}/image" Target="media/i.png"/></Relationships>',
        "ppt/media/i.png": "PNG",
    } | changes


def packed(content, seed=0):
    out, names = io.BytesIO(), list(content)
    random.Random(seed).shuffle(names)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if seed else zipfile.ZIP_STORED) as z:
        for k, name in enumerate(names):
            z.writestr(zipfile.ZipInfo(name, (2020 + k, 1, 1, 0, 0, seed % 60)), content[name])
    return out.getvalue()


GOLD = parts()
ALTERNATIVE = f'<p:presentation xmlns:p="urn:p" xmlns:mc="{MC[1:-1]}"><mc:AlternateContent><mc:Choice Requires="n" xmlns:n="urn:n"><n:new/></mc:Choice><mc:Fallback><p:list b="2" a="1"/></mc:Fallback></mc:AlternateContent></p:presentation>'
SAME = {
    "exact": packed(GOLD), "repacked": packed(GOLD, 1), "saved again": packed(parts(**{"docProps/core.xml": core(99)}), 2),
    "attributes": packed(parts(**{"ppt/presentation.xml": "<p:presentation xmlns:p='urn:p'><p:list a='1'   b='2'></p:list><!-- x --></p:presentation>"}), 3),
    "links": packed(parts(**{"_rels/.rels": f'<Relationships xmlns="{LINKS}"><Relationship Target="/ppt/%70resentation.xml" Id="rId1" Type="{C.MAIN}"/>\n<Relationship Id="rId2" TargetMode="Internal" Type="{LINKS}/metadata/core-properties" Target="./docProps/core.xml"/></Relationships>'}), 4),
    "types": packed(parts(**{"[Content_Types].xml": GOLD["[Content_Types].xml"].replace('<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>', "").replace("</Types>", f'<Default Extension="rels" ContentType="{C.LINKS_TYPE}"/></Types>')}), 5),
}
OTHER = {
    "changed": packed(parts(**{"ppt/presentation.xml": '<p:presentation xmlns:p="urn:p"><p:list b="2" a="2"/></p:presentation>'})), "picture": packed(parts(**{"ppt/media/i.png": "PNG2"})),
    "prefix": packed(parts(**{"ppt/presentation.xml": '<q:presentation xmlns:q="urn:p"><q:list b="2" a="1"/></q:presentation>'})), "title": packed(parts(**{"docProps/core.xml": core(1, "other")})),
}
WRONG = {
    "no types": {k: v for k, v in GOLD.items() if k != "[Content_Types].xml"}, "orphan": parts(**{"ppt/media/j.png": "x"}), "untyped": parts(**{"ppt/x.bin": "x"}), "gone": {k: v for k, v in GOLD.items() if k != "ppt/media/i.png"},
    "dtd": parts(**{"ppt/presentation.xml": "<!DOCTYPE p><p/>"}), "external": parts(**{"ppt/_rels/presentation.xml.rels": GOLD["ppt/_rels/presentation.xml.rels"].replace('Target="', 'TargetMode="External" Target="')}),
    "twice": parts(**{"_rels/.rels": GOLD["_rels/.rels"].replace("rId2", "rId1")}), "no main": parts(**{"_rels/.rels": GOLD["_rels/.rels"].replace("officeDocument", "other")}), "core": parts(**{"docProps/core.xml": "<x/>"}), "unsafe": parts(**{"../x": ""}),
}


def test_verdicts(spark):
    rows = [*SAME.items(), *OTHER.items(), *((k, packed(v)) for k, v in WRONG.items()), ("no zip", b"x"), ("null", None)]
    found = C.identities(spark.createDataFrame(rows, "package_id string, content binary"))
    gold = C.identities(spark.createDataFrame([("gold", packed(GOLD)), ("gold again", packed(GOLD))], "package_id string, content binary"))
    got = {r.package_id: r for r in C.copies(found, gold).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"exact": "same bytes"} | dict.fromkeys([k for k in SAME if k != "exact"], "same canonical form") | dict.fromkeys(OTHER, "clear") | dict.fromkeys([*WRONG, "no zip", "null"], "not decided")
    assert all(r.original == ("gold" if k in SAME else None) for k, r in got.items()) and all((r.problem is None) == (r.canonical_sha256 is not None) for r in got.values())
    assert got["orphan"].problem == "a part that nothing leads to: ppt/media/j.png" and got["null"].bytes_sha256 == hashlib.sha256(b"").hexdigest()


def test_profiles():
    content = {k: v.encode() for k, v in parts(**{"ppt/presentation.xml": ALTERNATIVE}).items()}
    base, all_parts = C.Profile(), {k: v.encode() for k, v in GOLD.items()}
    old, new = C.digest(content, base), C.digest(content, C.Profile(understood=frozenset({"urn:n"})))
    assert len({old, new, C.digest(all_parts, base)}) == 3 and C.digest(all_parts, C.Profile(domain=b"x")) != C.digest(all_parts, base)
    written = C.c14n(C.replace(doc := markup.read(ALTERNATIVE.encode()), root=__import__("plumbline.sources.compatibility", fromlist=["x"]).resolved(doc)))
    assert written.decode() == f'<p:presentation xmlns:mc="{MC[1:-1]}" xmlns:p="urn:p"><p:list a="1" b="2"></p:list></p:presentation>'
    with pytest.raises(C.Unacceptable, match="unmapped"):
        C.digest(all_parts, C.Profile(mapped=frozenset({(MAIN, "other")})))
    with pytest.raises(C.Unacceptable, match="content type"):
        C.digest(all_parts, C.Profile(accepted=frozenset({MAIN})))
    assert C.digest(all_parts, C.Profile(mapped=frozenset({(MAIN, "{urn:p}presentation")}))) == C.digest(all_parts, base)
