"""OPC packages (ZIP of XML): parts, relationships, slides, flattened object trees, media, fonts.

Packages are read by the binaryFile source, or by the source of datasource.py, which inflates only
what filters ask for. A recursive tree can't be a column, so nodes are rows with their path. Python
only opens the ZIP and walks the XML; everything after that is DataFrame code. No part fails a job: a
part that can't be parsed has a row in xml_problems, an attribute without a legal value is null and
named in the node's problems.
"""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.markup import TooDeep, parsed, target_of, tree_of, whole_number
from plumbline.sources.quarantine import BROKEN, Limits, opened, unsafe_name, weight_problem

#: Namespaces of the formats.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
CHART_URI = "http://schemas.openxmlformats.org/drawingml/2006/chart"

PART = "package_id string, part_name string, content binary, problem string"
NODE = """package_id string, slide int, part_name string, path array<int>, parent_path array<int>, depth int, node_id string, z_index int, occurrence int, locator string, kind string, name string,
    x long, y long, cx long, cy long, rotation long, placeholder_type string, placeholder_idx int, table_rows int, table_cols int, chart boolean,
    field_types array<string>, fill string, opacity string, stroke boolean, shadow boolean, crop struct<l:int,t:int,r:int,b:int>, cropped_to_shape boolean, hyperlinks array<string>, asset string,
    runs array<struct<text:string,font:string,size:int,bold:boolean,italic:boolean,language:string>>, problems array<string>"""


def packages(spark: SparkSession, path: str) -> DataFrame:
    """package_id, content of every package under the path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("package_id"), "content")


def members(z: zipfile.ZipFile | str, limits: Limits, wanted: Callable[[str], bool] = lambda name: True) -> Iterator[tuple]:
    """(name, content, problem) of a package's members that are wanted; only these are inflated."""
    problem = z if isinstance(z, str) else weight_problem(z.infolist(), limits)
    if problem:
        yield None, None, problem
        return
    seen: set[str] = set()
    for info in z.infolist():
        if info.is_dir():
            continue
        name = info.filename
        problem = "encrypted" if info.flag_bits & 1 else unsafe_name(name) or ("repeated name" if name.lower() in seen else None)
        seen.add(name.lower())
        if not wanted(name):
            continue
        body = None
        if problem != "encrypted":
            try:
                body = z.read(info)
            except BROKEN:
                problem = problem or "unreadable"
        yield name, body, problem


def parts(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each member of the packages (package_id, content), with its problem if any.

    A package over the limits is not inflated and has one row without a name; a member that can't be
    read has no content.
    """

    def read(batches):
        for batch in batches:
            rows = [(pid, *m) for pid, content in zip(batch["package_id"], batch["content"], strict=True) for m in members(opened(content if content is None else bytes(content)), limits)]
            yield pd.DataFrame(rows, columns=["package_id", "part_name", "content", "problem"])

    return df.select("package_id", "content").mapInPandas(read, PART)


def xml_problems(part: DataFrame, strict: bool = False) -> DataFrame:
    """package_id, part_name, problem of XML parts that are malformed, nested too deep or, if strict, use
    markup compatibility in a way that can't be resolved."""
    from plumbline.sources.compatibility import NotUnderstood, resolve

    def read(batches):
        for batch in batches:
            rows = []
            for pid, name, content in zip(batch["package_id"], batch["part_name"], batch["content"], strict=True):
                try:
                    resolve(content, strict=True) if strict else tree_of(content)
                except TooDeep:
                    rows.append((pid, name, "nested too deep"))
                except ET.ParseError:
                    rows.append((pid, name, "malformed XML"))
                except NotUnderstood as e:
                    rows.append((pid, name, f"not understood: {e}"))
            yield pd.DataFrame(rows, columns=["package_id", "part_name", "problem"])

    xml = part.filter("problem is null and (part_name like '%.xml' or part_name like '%.rels')")
    return xml.select("package_id", "part_name", "content").mapInPandas(read, "package_id string, part_name string, problem string")


def source_of(name: str) -> str:
    """The part whose relationships a part holds."""
    return re.sub(r"(^|/)_rels/([^/]*)\.rels$", r"\1\2", name)


def links_of(source: str, content: bytes) -> list[tuple]:
    """(rel_id, type, target, external, problem) of a relationship part."""
    tree, rows = parsed(content), []
    for r in tree.iter(f"{REL}Relationship") if tree is not None else ():
        external = r.get("TargetMode") == "External"
        target = r.get("Target") if external else target_of(source, r.get("Target"))
        rows.append((r.get("Id"), r.get("Type", "").rsplit("/", 1)[-1].lower(), target, external, None if target is not None else "target is no part"))
    return rows


def relationships(part: DataFrame) -> DataFrame:
    """package_id, source, rel_id, type (last segment), target, external, problem; in order of ids. A target
    that leaves the package or is no part's name is null and has a problem."""

    def read(batches):
        for batch in batches:
            rows = [(pid, source_of(name), *link) for pid, name, content in zip(batch["package_id"], batch["part_name"], batch["content"], strict=True) for link in links_of(source_of(name), content)]
            yield pd.DataFrame(rows, columns=["package_id", "source", "rel_id", "type", "target", "external", "problem"])

    found = part.filter("problem is null and part_name like '%.rels'").select("package_id", "part_name", "content")
    return found.mapInPandas(read, "package_id string, source string, rel_id string, type string, target string, external boolean, problem string")


PRESENTATION = "ppt/presentation.xml"


def slide_ids(content: bytes) -> list[str | None]:
    """Relationship ids of a presentation's slide list in its order."""
    tree = parsed(content)
    return [el.get(f"{R}id") for el in tree.iter(f"{P}sldId")] if tree is not None else []


def slide_list(part: DataFrame) -> DataFrame:
    """package_id, slide (from 1), rel_id: the slide list of each presentation in its order."""

    def read(batches):
        for batch in batches:
            rows = [(pid, n, rel) for pid, content in zip(batch["package_id"], batch["content"], strict=True) for n, rel in enumerate(slide_ids(content), 1)]
            yield pd.DataFrame(rows, columns=["package_id", "slide", "rel_id"])

    return part.filter(F.col("part_name") == PRESENTATION).select("package_id", "content").mapInPandas(read, "package_id string, slide int, rel_id string")


def listed(part: DataFrame, rels: DataFrame) -> DataFrame:
    """The slide list with the part each entry leads to, null where it leads to no slide."""
    of = rels.filter((F.col("source") == PRESENTATION) & (F.col("type") == "slide")).select("package_id", "rel_id", F.col("target").alias("part_name"))
    return slide_list(part).join(of, ["package_id", "rel_id"], "left")


def slides(part: DataFrame, rels: DataFrame) -> DataFrame:
    """package_id, slide (from 1, in the order of the slide list), part_name; entries without a part are left out."""
    return listed(part, rels).filter("part_name is not null").select("package_id", "slide", "part_name")


def slide_problems(part: DataFrame, rels: DataFrame) -> DataFrame:
    """package_id, problem: why a package's slide list isn't normative (no slides, an entry without a
    slide, a slide part twice, or one that isn't there)."""
    there = part.filter("problem is null").select("package_id", "part_name", F.lit(True).alias("_there"))
    x = listed(part, rels).join(there, ["package_id", "part_name"], "left")
    g = x.groupBy("package_id").agg(F.count(F.lit(1)).alias("n"), F.count("part_name").alias("known"), F.count_distinct("part_name").alias("distinct"), F.count("_there").alias("there"))
    from plumbline.operators.rules import first_failure

    g = part.select("package_id").distinct().join(g, "package_id", "left")
    fine, why = first_failure((F.col("n").isNull(), "no slides"), (F.col("known") < F.col("n"), "slide id without a slide"), (F.col("distinct") < F.col("known"), "slide part twice"), (F.col("there") < F.col("known"), "slide part missing"))
    return g.select("package_id", why.alias("problem")).filter(~fine)


KINDS = {f"{P}sp": "shape", f"{P}pic": "picture", f"{P}graphicFrame": "frame", f"{P}cxnSp": "connector", f"{P}grpSp": "group"}


def kind_of(el: ET.Element) -> str:
    """Priority of kinds: table, chart, placeholder, picture, connector, group, field, text, shape."""
    base = KINDS[el.tag]
    if base == "frame":
        if el.find(f".//{A}tbl") is not None:
            return "table"
        data = el.find(f".//{A}graphicData")
        return "chart" if data is not None and data.get("uri") == CHART_URI else "shape"
    if base in ("picture", "connector", "group"):
        return base
    if el.find(f"{P}nvSpPr/{P}nvPr/{P}ph") is not None:
        return "placeholder"
    if el.find(f".//{A}fld") is not None:
        return "field"
    return "text" if any((t.text or "").strip() for t in el.iter(f"{A}t")) else "shape"


#: Fills and shadows among the properties of a shape.
FILLS = tuple(f"{A}{x}" for x in ("solidFill", "gradFill", "pattFill", "noFill", "blipFill"))
SHADOWS = (f"{A}outerShdw", f"{A}innerShdw")


def ratio(thousandths: int) -> str:
    """Thousandths of a percent as a plain decimal without trailing zeros."""
    text = f"{Decimal(thousandths) / 100_000:f}"
    return (text.rstrip("0").rstrip(".") if "." in text else text) or "0"


def node(el: ET.Element, path: list[int], z: int, targets: dict[str, str]) -> dict:
    """One object's row; what isn't there is null, and so is what isn't legal, which problems names."""
    problems: list[str] = []

    def number(el, key, bits=63, **forms):
        value = el.get(key) if el is not None else None
        try:
            n = whole_number(value, **forms)
            if n is None or -(1 << bits) <= n < 1 << bits:
                return n
        except ValueError:
            pass
        problems.append(f"{key}={value[:40]}")
        return None

    c = next((x for x in el.iter(f"{P}cNvPr")), None)
    box = next((x for x in el.iter() if x.tag in (f"{A}xfrm", f"{P}xfrm")), None)
    off, ext = (box.find(f"{A}off"), box.find(f"{A}ext")) if box is not None else (None, None)
    ph = el.find(f"./*/{P}nvPr/{P}ph")
    table = el.find(f".//{A}tbl")
    own = el.find(f"{P}spPr") if el.find(f"{P}spPr") is not None else el.find(f"{P}grpSpPr")
    fill = next((x for x in (own if own is not None else ()) if x.tag in FILLS), None)
    alpha = number(next((x for x in fill.iter(f"{A}alpha") if x.get("val")), None), "val", thousandths=True) if fill is not None else None
    line, cut, form = own.find(f"{A}ln") if own is not None else None, el.find(f".//{A}srcRect"), el.find(f".//{A}prstGeom")
    blip = el.find(f"{P}blipFill/{A}blip")
    flag = lambda r, k: None if r is None or r.get(k) is None else r.get(k) in ("1", "true", "on")
    runs = []
    if el.tag != f"{P}grpSp":
        for r in (x for x in el.iter() if x.tag in (f"{A}r", f"{A}fld")):
            pr, t = r.find(f"{A}rPr"), r.find(f"{A}t")
            latin = pr.find(f"{A}latin") if pr is not None else None
            runs.append({"text": (t.text or "") if t is not None else "", "font": latin.get("typeface") if latin is not None else None, "size": number(pr, "sz", 31), "bold": flag(pr, "b"), "italic": flag(pr, "i"), "language": pr.get("lang") if pr is not None else None})
    return {
        "path": path, "parent_path": path[:-1], "depth": len(path), "z_index": z, "kind": kind_of(el), "name": c.get("name") if c is not None else None,
        "x": number(off, "x", measure=True), "y": number(off, "y", measure=True), "cx": number(ext, "cx", measure=True), "cy": number(ext, "cy", measure=True), "rotation": number(box, "rot"),
        "placeholder_type": ph.get("type", "obj") if ph is not None else None, "placeholder_idx": number(ph, "idx", 31),
        "table_rows": len(table.findall(f"{A}tr")) if table is not None else None, "table_cols": len(table.findall(f"{A}tblGrid/{A}gridCol")) if table is not None else None,
        "chart": kind_of(el) == "chart", "field_types": sorted({f.get("type", "") for f in el.iter(f"{A}fld")}),
        "fill": fill.tag.removeprefix(A) if fill is not None else "inherited", "opacity": ratio(alpha) if alpha is not None else "1",
        "stroke": line is not None and line.find(f"{A}noFill") is None, "shadow": own is not None and any(x.tag in SHADOWS for x in own.iter()),
        "crop": {side: number(cut, side, 31, thousandths=True) or 0 for side in "ltrb"} if cut is not None else None, "cropped_to_shape": form is not None and form.get("prst", "rect") != "rect",
        "hyperlinks": sorted({targets.get(h.get(f"{R}id")) or "" for h in el.iter(f"{A}hlinkClick")}), "asset": targets.get(blip.get(f"{R}embed")) if blip is not None else None, "runs": runs, "problems": problems,
    }


NODE_COLUMNS = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", NODE)]


def objects(pid: str, slide: int, name: str, content: bytes, targets: dict[str, str], strict: bool) -> Iterator[dict]:
    """Rows of a slide's objects; none where it can't be parsed."""
    from plumbline.sources.compatibility import NotUnderstood, resolve

    try:
        tree = resolve(content, strict=strict).find(f"{P}cSld/{P}spTree")
    except (ET.ParseError, NotUnderstood):
        return
    waiting = [(tree, [], "/p:sld/p:cSld/p:spTree")] if tree is not None else []
    while waiting:
        parent, path, above = waiting.pop()
        seen: dict[str, int] = {}
        for el in (x for x in parent if x.tag in KINDS):
            z = sum(seen.values())
            seen[el.tag] = seen.get(el.tag, 0) + 1
            at, locator = [*path, z], f"{above}/p:{el.tag.removeprefix(P)}[{seen[el.tag]}]"
            own = {"package_id": pid, "slide": slide, "part_name": name, "node_id": f"s{slide}:n{'.'.join(map(str, at))}", "occurrence": seen[el.tag], "locator": locator}
            yield own | node(el, at, z, targets)
            if el.tag == f"{P}grpSp":
                waiting.append((el, at, locator))


def slide_nodes(todo: DataFrame, strict: bool = False) -> DataFrame:
    """The object trees of slides (package_id, part_name, slide, content, targets) as rows."""

    def read(batches):
        for batch in batches:
            rows = [row for pid, name, n, content, targets in batch.itertuples(index=False) for row in objects(pid, int(n), name, content, dict(targets) if targets is not None else {}, strict)]
            yield pd.DataFrame(rows, columns=NODE_COLUMNS)

    return todo.select("package_id", "part_name", "slide", "content", "targets").mapInPandas(read, NODE)


def nodes(part: DataFrame, rels: DataFrame, slide: DataFrame, strict: bool = False) -> DataFrame:
    """The object trees of the given slides as rows; a filter on `slide` is a filter on what is parsed.

    path counts from 0 in each parent, z_index over the supported kinds only; occurrence counts from 1
    among the siblings with the same element, and locator is the path of these. A slide that can't be
    parsed has no rows (xml_problems names it); if strict, nor has one whose alternatives can't be resolved.
    """
    once = rels.filter("rel_id is not null and target is not null").groupBy("package_id", F.col("source").alias("part_name"), "rel_id").agg(F.min("target").alias("target"))
    links = once.groupBy("package_id", "part_name").agg(F.map_from_entries(F.collect_list(F.struct("rel_id", "target"))).alias("targets"))
    todo = slide.join(part.select("package_id", "part_name", "content"), ["package_id", "part_name"]).join(links, ["package_id", "part_name"], "left")
    return slide_nodes(todo, strict)


ELEMENT = "package_id string, part_name string, path array<int>, model string, children array<string>, attributes map<string,string>"


def elements(part: DataFrame, strict: bool = False) -> DataFrame:
    """Every element of the XML parts, alternatives resolved: its path (places among its siblings, empty for the
    root), model (its name), the names of its children in order, and its attributes. Parts that can't be
    parsed have none."""

    def flat(pid, name, content):
        from plumbline.sources.compatibility import NotUnderstood, resolve

        try:
            waiting = [([], resolve(content, strict=strict))]
        except (ET.ParseError, NotUnderstood):
            return
        while waiting:
            path, el = waiting.pop()
            inside = [c for c in el if c.tag is not ET.ProcessingInstruction]
            yield pid, name, path, el.tag, [c.tag for c in inside], dict(el.attrib)
            waiting.extend(([*path, k], c) for k, c in enumerate(inside))

    def read(batches):
        for batch in batches:
            for pid, name, content in zip(batch["package_id"], batch["part_name"], batch["content"], strict=True):
                yield pd.DataFrame(flat(pid, name, content), columns=["package_id", "part_name", "path", "model", "children", "attributes"])

    xml = part.filter("problem is null and part_name like '%.xml'")
    return xml.select("package_id", "part_name", "content").mapInPandas(read, ELEMENT)


def content_types(part: DataFrame) -> DataFrame:
    """package_id, part_name, content_type of every part: the override of its name, else the default of its extension."""

    def read(batches):
        for batch in batches:
            rows = []
            for pid, content in zip(batch["package_id"], batch["content"], strict=True):
                tree = parsed(content)
                for el in tree if tree is not None else ():
                    name, extension, kind = (el.get("PartName") or "").removeprefix("/"), (el.get("Extension") or "").lower(), el.get("ContentType")
                    if kind and (name or extension):
                        rows.append((pid, name or None, None if name else extension, kind))
            yield pd.DataFrame(rows, columns=["package_id", "part_name", "extension", "content_type"])

    said = part.filter("problem is null and part_name = '[Content_Types].xml'").select("package_id", "content").mapInPandas(read, "package_id string, part_name string, extension string, content_type string")
    of = lambda key: said.filter(f"{key} is not null").groupBy("package_id", key).agg(F.min("content_type").alias(f"_{key}"))
    own = part.select("package_id", "part_name", F.lower(F.regexp_extract("part_name", r"\.([^./]+)$", 1)).alias("extension"))
    met = own.join(of("part_name"), ["package_id", "part_name"], "left").join(of("extension"), ["package_id", "extension"], "left")
    return met.select("package_id", "part_name", F.coalesce("_part_name", "_extension").alias("content_type"))


def media(part: DataFrame) -> DataFrame:
    """SHA-256 of every media part."""
    return part.filter(F.col("part_name").startswith("ppt/media/")).select("package_id", "part_name", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def typefaces(part: DataFrame) -> DataFrame:
    """Distinct typefaces named in any XML part under ppt/, without theme references (+...); parts that can't
    be parsed name none."""

    def read(batches):
        for batch in batches:
            rows = []
            for pid, content in zip(batch["package_id"], batch["content"], strict=True):
                tree = parsed(content)
                rows += [(pid, font) for font in ({el.get("typeface") for el in tree.iter()} if tree is not None else ())]
            yield pd.DataFrame(rows, columns=["package_id", "font"])

    x = part.filter("part_name like 'ppt/%.xml'").select("package_id", "content").mapInPandas(read, "package_id string, font string")
    return x.filter("font <> '' and not startswith(font, '+')").distinct()


def layout_names(part: DataFrame) -> DataFrame:
    """Names of layouts and masters: that of the slide data, else the part's, by part."""
    x = part.filter(F.col("part_name").rlike(r"^ppt/slide(Layout|Master)s/[^/]+\.xml$"))

    def read(batches):
        for batch in batches:
            names = []
            for name, content in zip(batch["part_name"], batch["content"], strict=True):
                tree = parsed(content)
                data = tree.find(f"{P}cSld") if tree is not None else None
                names.append((data.get("name") if data is not None else None) or name)
            yield pd.DataFrame({"package_id": batch["package_id"], "part_name": batch["part_name"], "name": names})

    found = x.select("package_id", "part_name", "content").mapInPandas(read, "package_id string, part_name string, name string")
    return found.select("package_id", F.regexp_extract("part_name", "^ppt/slide(Layout|Master)s", 1).alias("level"), "part_name", "name")


def notes_and_comments(rels: DataFrame, slide: DataFrame) -> DataFrame:
    """Whether a slide has notes or comments, by its relationships' types."""
    r = rels.groupBy("package_id", F.col("source").alias("part_name")).agg(F.bool_or(F.col("type") == "notesslide").alias("notes"), F.bool_or(F.col("type").isin("comments", "comment")).alias("comments"))
    return slide.join(r, ["package_id", "part_name"], "left").select("package_id", "slide", F.coalesce("notes", F.lit(False)).alias("notes"), F.coalesce("comments", F.lit(False)).alias("comments"))


def orphans(part: DataFrame, rels: DataFrame) -> DataFrame:
    """Parts that no chain of relationships from the package leads to (relationship parts don't count)."""
    from plumbline.operators.evidence import reachable

    key = lambda p, n: F.concat_ws("!", p, n)
    edges = rels.filter("not external").select(key("package_id", "source").alias("source"), key("package_id", "target").alias("target"))
    roots = part.select(key("package_id", F.lit("")).alias("node")).distinct()
    found = reachable(part.sparkSession, edges, roots)
    body = part.filter("part_name <> '[Content_Types].xml' and part_name not like '%.rels'").withColumn("node", key("package_id", "part_name"))
    return body.join(found, "node", "left_anti").select("package_id", "part_name")


#: The part, and the elements in it, whose text changes with every save.
VOLATILE_PART = "docProps/core.xml"
VOLATILE = (
    "{http://purl.org/dc/terms/}created",
    "{http://purl.org/dc/terms/}modified",
    "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}lastModifiedBy",
    "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}revision",
)


def canonical_part(name: str, content: bytes) -> bytes:
    """Canonical XML without comments, and without volatile text; other and malformed parts as they are."""
    if not name.endswith((".xml", ".rels")):
        return content
    if name == VOLATILE_PART:
        root = parsed(content)
        if root is None:
            return content
        for el in root.iter():
            if el.tag in VOLATILE:
                el.text = None
        content = ET.tostring(root, "utf-8")
    return content if parsed(content) is None else ET.canonicalize(content).encode()


def package_digest(part: DataFrame, domain: bytes = b"package v1\0") -> DataFrame:
    """digest over domain and (uint32 length, name, uint64 length, content) in byte order of names,
    content canonical; and the digest of the same frames with all bytes as they are."""

    def fold(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        whole, canon = hashlib.sha256(domain), hashlib.sha256(domain)
        for name, content in sorted(zip(p["part_name"], p["content"], strict=True), key=lambda x: x[0].encode()):
            for digest, body in ((whole, content), (canon, canonical_part(name, content))):
                digest.update(len(name.encode()).to_bytes(4, "big") + name.encode() + len(body).to_bytes(8, "big") + body)
        return pd.DataFrame([{"package_id": key[0], "digest": f"sha256:{canon.hexdigest()}", "bytes_digest": f"sha256:{whole.hexdigest()}"}])

    return part.filter("problem is null").groupBy("package_id").applyInPandas(fold, "package_id string, digest string, bytes_digest string")
