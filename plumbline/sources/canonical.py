"""Canonical XML 1.0 (inclusive, without comments), the identity of a package, and verdicts on copies.

The identity is a digest over (uint32 length, name, uint64 length, content) of all parts in byte order of
their names, after a domain. Content is as it is for binary parts. XML parts are canonical, after their
alternatives were resolved if they are relevant ones; content types are sorted; relationships are sorted
by id and lead to whole part names; volatile texts are empty. So neither packing nor the order of what has
none, nor times of saving, are part of it. A package that breaks a rule of the profile has a problem
instead. Each package is read, canonicalized and digested where it lies: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources import package
from plumbline.sources.markup import Scoped, read, target_of
from plumbline.sources.quarantine import Limits, opened

#: Control parts and their formats.
TYPES_PART, ROOT_LINKS = "[Content_Types].xml", "_rels/.rels"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
LINKS_TYPE = "application/vnd.openxmlformats-package.relationships+xml"
MAIN = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
CORE = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}coreProperties"


class Unacceptable(ValueError):
    """What a package's profile doesn't allow."""


@dataclass(frozen=True)
class Profile:
    """domain: digested first. accepted: content types (None: any). understood: namespaces for alternatives.
    mapped: (content type, root) that relevant parts may have (None: any)."""

    domain: bytes = b"package v2\0"
    accepted: frozenset[str] | None = None
    understood: frozenset[str] = frozenset()
    mapped: frozenset[tuple[str, str]] | None = None


def escaped(text: str, attribute: bool) -> str:
    """Text as Canonical XML has it: what would not survive reading is a character reference."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), *((('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;")) if attribute else ((">", "&gt;"),)), ("\r", "&#xD;")):
        text = text.replace(a, b)
    return text


def instruction(el: ET.Element) -> str:
    return f"<?{el.text}?>"


def c14n(doc: Scoped) -> bytes:
    """A document as Canonical XML 1.0 without comments."""
    out: list[str] = []

    def write(el: ET.Element, shown: dict[str, str]) -> None:
        if el.tag is ET.ProcessingInstruction:
            out.append(instruction(el))
            return
        name, attributes, own = doc.names[el]
        scope, shown = doc.scopes[el], dict(shown)
        # What is declared here, and what is used here and was declared on an element that went.
        used = {q.partition(":")[0] if ":" in q else "" for q in (name,)} | {q.partition(":")[0] for key, q in attributes.items() if ":" in q and key in el.attrib}
        wanted = {p: scope.get(p, "") for p in {*own, *used} if p != "xml"}
        new = {p: uri for p, uri in wanted.items() if shown.get(p, "") != uri}
        shown.update(new)
        rest = sorted((key[1:].partition("}")[::2] if key[0] == "{" else ("", key), attributes.get(key, key), value) for key, value in el.attrib.items())
        out.append(f"<{name}" + "".join(f' xmlns{":" * bool(p)}{p}="{escaped(new[p], True)}"' for p in sorted(new)) + "".join(f' {q}="{escaped(value, True)}"' for _, q, value in rest) + ">")
        out.append(escaped(el.text or "", False))
        for c in el:
            write(c, shown)
            out.append(escaped(c.tail or "", False))
        out.append(f"</{name}>")

    out += [f"{instruction(x)}\n" for x in doc.before]
    write(doc.root, {})
    out += [f"\n{instruction(x)}" for x in doc.after]
    return "".join(out).encode()


def parse(name: str, content: bytes) -> Scoped:
    try:
        return read(content)
    except ET.ParseError as e:
        raise Unacceptable(f"{name}: {e}") from e


def types_of(parts: dict[str, bytes], profile: Profile) -> tuple[dict[str, str], Scoped]:
    """The content type of every part, and the part that declares them."""
    if TYPES_PART not in parts:
        raise Unacceptable("no content types")
    doc, default, override = parse(TYPES_PART, parts[TYPES_PART]), {}, {}
    if doc.root.tag != f"{TYPES}Types":
        raise Unacceptable("content types of another root")
    for el in doc.root:
        kind, extension, part = el.get("ContentType"), (el.get("Extension") or "").lower(), el.get("PartName") or ""
        into, key = {f"{TYPES}Default": (default, extension), f"{TYPES}Override": (override, part[1:] if part.startswith("/") else "")}.get(el.tag, (None, ""))
        if into is None or not kind or not key or key in into:
            raise Unacceptable("a content type that is repeated or malformed")
        into[key] = kind
    if lost := sorted(set(override) - set(parts)):
        raise Unacceptable(f"a content type of a part that isn't there: {lost[0]}")
    found = {name: override.get(name) or default.get(name.rsplit(".", 1)[-1].lower() if "." in name else "") for name in parts if name != TYPES_PART}
    for name, kind in found.items():
        if kind is None or profile.accepted is not None and kind not in profile.accepted:
            raise Unacceptable(f"{name}: content type {kind}")
    return found, doc


def links_of(name: str, doc: Scoped, parts: dict[str, bytes]) -> list[tuple[str, str, str]]:
    """(id, type, part) of a relationship part, by id."""
    found: dict[str, tuple[str, str, str]] = {}
    if doc.root.tag != f"{package.REL}Relationships":
        raise Unacceptable(f"{name}: another root")
    for el in doc.root:
        key, kind = el.get("Id"), el.get("Type")
        if el.tag != f"{package.REL}Relationship" or not key or not kind or key in found:
            raise Unacceptable(f"{name}: a relationship that is repeated or malformed")
        if el.get("TargetMode", "Internal") != "Internal":
            raise Unacceptable(f"{name}: external target")
        target = target_of(package.source_of(name), el.get("Target"))
        if target not in parts:
            raise Unacceptable(f"{name}: target isn't there")
        found[key] = key, kind, target
    return sorted(found.values(), key=lambda x: x[0].encode())


def reached(links: dict[str, list[tuple[str, str, str]]]) -> set[str]:
    """Parts that chains of relationships lead to from the package, and their relationship parts."""
    of, found, waiting = {package.source_of(name): name for name in links}, {TYPES_PART}, [""]
    while waiting:
        name = of.get(waiting.pop())
        if name is None or name in found:
            continue
        found.add(name)
        for _, _, target in links[name]:
            if target not in found:
                found.add(target)
                waiting.append(target)
    return found


def rebuilt(doc: Scoped, links: list[tuple[str, str, str]]) -> Scoped:
    """A relationship part with these relationships only, in their order, to whole part names."""
    name, _, own = doc.names[doc.root]
    root, prefix = ET.Element(doc.root.tag), name.rpartition(":")[0]
    names, scopes = {root: (name, {}, own)}, {root: doc.scopes[doc.root]}
    for key, kind, target in links:
        el = ET.SubElement(root, f"{package.REL}Relationship", {"Id": key, "Type": kind, "Target": f"/{target}"})
        names[el], scopes[el] = (f"{prefix}:Relationship" if prefix else "Relationship", {}, {}), scopes[root]
    return replace(doc, root=root, names=names, scopes=scopes)


def canonical(name: str, content: bytes, kind: str, profile: Profile) -> bytes:
    """The content of a part other than content types and relationships."""
    from plumbline.sources.compatibility import NotUnderstood, resolved

    if name == package.VOLATILE_PART:
        doc = parse(name, content)
        if doc.root.tag != CORE:
            raise Unacceptable(f"{name}: another root")
        for el in doc.root.iter():
            if el.tag in package.VOLATILE:
                if len(el):
                    raise Unacceptable(f"{name}: a volatile element with children")
                el.text = ""
        return c14n(doc)
    if not (kind.endswith("+xml") or kind in ("application/xml", "text/xml")):
        return content
    doc = parse(name, content)
    if name.startswith("ppt/") and name.endswith(".xml") and "/_rels/" not in name:
        try:
            doc = replace(doc, root=resolved(doc, profile.understood, strict=True))
        except NotUnderstood as e:
            raise Unacceptable(f"{name}: {e}") from e
        if profile.mapped is not None and (kind, doc.root.tag) not in profile.mapped:
            raise Unacceptable(f"{name}: unmapped part")
    return c14n(doc)


def digest(parts: dict[str, bytes], profile: Profile) -> str:
    kinds, types = types_of(parts, profile)
    docs = {name: parse(name, parts[name]) for name, kind in kinds.items() if kind == LINKS_TYPE}
    links = {name: links_of(name, doc, parts) for name, doc in docs.items()}
    if sum(kind == MAIN for _, kind, _ in links.get(ROOT_LINKS, ())) != 1:
        raise Unacceptable("not one main part")
    if lost := sorted(set(parts) - reached(links)):
        raise Unacceptable(f"a part that nothing leads to: {lost[0]}")
    types.root[:] = sorted(types.root, key=lambda el: (el.tag, (el.get("Extension") or "").encode(), (el.get("PartName") or "").encode()))
    whole = hashlib.sha256(profile.domain)
    for name in sorted(parts, key=str.encode):
        body = c14n(types) if name == TYPES_PART else c14n(rebuilt(docs[name], links[name])) if name in docs else canonical(name, parts[name], kinds[name], profile)
        whole.update(len(name.encode()).to_bytes(4, "big") + name.encode() + len(body).to_bytes(8, "big") + body)
    return whole.hexdigest()


def identity(content: bytes | None, profile: Profile, limits: Limits) -> tuple[str | None, str | None]:
    """(digest, problem) of a package."""
    parts: dict[str, bytes] = {}
    for name, body, problem in package.members(opened(content), limits):
        if problem or body is None:
            return None, problem or "unreadable"
        parts[name] = body
    try:
        return digest(parts, profile), None
    except Unacceptable as e:
        return None, str(e)


def identities(packages: DataFrame, profile: Profile = Profile(), limits: Limits = Limits()) -> DataFrame:
    """package_id, bytes_sha256, canonical_sha256 and problem (why there is no canonical one) of packages (package_id, content)."""

    def made(batches):
        for batch in batches:
            found = [identity(c if c is None else bytes(c), profile, limits) for c in batch["content"]]
            yield pd.DataFrame({"package_id": batch["package_id"], "bytes_sha256": batch["bytes_sha256"], "canonical_sha256": [d for d, _ in found], "problem": [p for _, p in found]})

    rows = packages.select("package_id", "content", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("bytes_sha256"))
    return rows.mapInPandas(made, "package_id string, bytes_sha256 string, canonical_sha256 string, problem string")


def copies(found: DataFrame, originals: DataFrame) -> DataFrame:
    """identities() with original (the smallest id of an original that it is a copy of) and verdict: same bytes, same canonical
    form, clear, or not decided where there is no canonical form and the bytes are no original's."""
    of = lambda key: originals.filter(f"{key} is not null").groupBy(key).agg(F.min("package_id").alias(f"_{key}"))
    x = found.join(of("bytes_sha256"), "bytes_sha256", "left").join(of("canonical_sha256"), "canonical_sha256", "left")
    verdict = F.when(F.col("_bytes_sha256").isNotNull(), "same bytes").when(F.col("_canonical_sha256").isNotNull(), "same canonical form").when(F.col("canonical_sha256").isNull(), "not decided").otherwise("clear")
    return x.select("package_id", "bytes_sha256", "canonical_sha256", "problem", F.coalesce("_bytes_sha256", "_canonical_sha256").alias("original"), verdict.alias("verdict"))
