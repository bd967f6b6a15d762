"""Markup compatibility (ECMA-376 part 3): alternatives, ignorable and processed content.

resolve() returns the tree that a reader sees who understands the given namespaces: of
alternatives the first choice whose required namespaces are all understood, else the fallback;
elements and attributes of ignorable namespaces that aren't understood go, but the content of
elements named in ProcessContent stays in their place. What an ancestor declares holds below it.
A namespace in MustUnderstand that isn't understood is an error.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from plumbline.sources.markup import Scoped, read
from plumbline.sources.package import MC


class NotUnderstood(ValueError):
    pass


def namespace(tag: str) -> str:
    return tag[1:].partition("}")[0] if tag.startswith("{") else ""


def alternatives_problem(el: ET.Element) -> str | None:
    """Why the branches of an AlternateContent aren't well ordered."""
    tags = [c.tag for c in el if c.tag is not ET.ProcessingInstruction]
    if set(tags) - {f"{MC}Choice", f"{MC}Fallback"}:
        return "unexpected branch"
    if f"{MC}Choice" not in tags:
        return "no choice"
    if f"{MC}Fallback" in tags[:-1]:
        return "a branch after the fallback"
    return None


def resolve(xml: bytes, understood: frozenset[str] = frozenset(), strict: bool = False) -> ET.Element:
    """The tree of a part without markup compatibility. Alternatives of which no branch can be used vanish; if
    strict they, and branches out of order or without Requires, are an error."""
    return resolved(read(xml), understood, strict)


def resolved(doc: Scoped, understood: frozenset[str] = frozenset(), strict: bool = False) -> ET.Element:
    """resolve() of a part that was read; its tree is changed."""
    scopes = doc.scopes

    def names(el: ET.Element, attribute: str) -> list[tuple[str, str]]:
        """(namespace, local name or '') of the prefixes or qualified names that an attribute lists."""
        out = []
        for word in el.get(f"{MC}{attribute}", "").split():
            prefix, _, local = word.partition(":")
            if prefix not in scopes[el]:
                raise NotUnderstood(f"{attribute}: unknown prefix {prefix}")
            out.append((scopes[el][prefix], local))
        return out

    def visit(el: ET.Element, ignorable: frozenset, process: frozenset) -> list[ET.Element]:
        if el.tag is ET.ProcessingInstruction:
            return [el]
        for ns, _ in names(el, "MustUnderstand"):
            if ns not in understood:
                raise NotUnderstood(ns)
        ignorable = ignorable | {ns for ns, _ in names(el, "Ignorable")}
        process = process | set(names(el, "ProcessContent"))
        ns, local = namespace(el.tag), el.tag.rpartition("}")[2]
        dropped = ns in ignorable and ns not in understood
        if dropped and not {(ns, local), (ns, "*")} & process:
            return []
        if el.tag == f"{MC}AlternateContent":
            if strict and (problem := alternatives_problem(el)):
                raise NotUnderstood(problem)
            if strict and not all(c.get("Requires", "").split() for c in el if c.tag == f"{MC}Choice"):
                raise NotUnderstood("a choice requires nothing")
            pick = next((c for c in el if c.tag == f"{MC}Choice" and all(scopes[c].get(p) in understood for p in c.get("Requires", "").split())), None)
            pick = el.find(f"{MC}Fallback") if pick is None else pick
            if strict and pick is None:
                raise NotUnderstood("no branch can be used")
            return [] if pick is None else [x for c in pick for x in visit(c, ignorable, process)]
        inner = [x for c in list(el) for x in visit(c, ignorable, process)]
        if dropped:
            return inner
        for name in list(el.attrib):
            if namespace(name) == MC[1:-1] or namespace(name) in ignorable and namespace(name) not in understood:
                del el.attrib[name]
        el[:] = inner
        return [el]

    out = visit(doc.root, frozenset(), frozenset())
    if len(out) != 1:
        raise NotUnderstood("the root went")
    return out[0]
