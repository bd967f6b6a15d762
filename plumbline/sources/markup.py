"""XML of untrusted parts: trees of limited depth, attribute values in all their legal forms, targets."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from decimal import Decimal
from urllib.parse import unquote_to_bytes
from xml.parsers import expat

#: Elements within each other at most.
MOST_DEPTH = 256
#: EMU in the units that a coordinate may name.
EMU = {"mm": 36_000, "cm": 360_000, "in": 914_400, "pt": 12_700, "pc": 152_400, "pi": 152_400}
INTEGER, PERCENT, MEASURE = re.compile(r"[+-]?\d{1,18}"), re.compile(r"[+-]?\d{1,15}(?:\.\d{1,15})?%"), re.compile(r"-?\d{1,12}(?:\.\d{1,12})?(?:mm|cm|in|pt|pc|pi)")


class TooDeep(ET.ParseError):
    """More than MOST_DEPTH elements within each other."""


def deeper(depth: int) -> int:
    if depth >= MOST_DEPTH:
        raise TooDeep(f"more than {MOST_DEPTH} elements within each other")
    return depth + 1


class _Builder(ET.TreeBuilder):
    depth = 0

    def start(self, tag, attrs):
        self.depth = deeper(self.depth)
        return super().start(tag, attrs)

    def end(self, tag):
        self.depth -= 1
        return super().end(tag)


def tree_of(content: bytes | None) -> ET.Element:
    """The tree of a part; ET.ParseError where it is malformed or too deep."""
    try:
        content = content or b""
        if content.count(b"<") <= MOST_DEPTH:
            return ET.fromstring(content)
        return ET.fromstring(content, ET.XMLParser(target=_Builder()))
    except (ValueError, LookupError) as e:  # an encoding that isn't known, or bytes that aren't in it
        raise ET.ParseError(str(e)) from e


def parsed(content: bytes | None) -> ET.Element | None:
    """The tree, or None where there is none."""
    try:
        return tree_of(content)
    except ET.ParseError:
        return None


@dataclass(frozen=True)
class Scoped:
    """A tree with its prefixes: scopes (those in scope at each element), names (of each element its name as written,
    its attributes' by their keys, and what it declares), and the instructions before and after the root."""

    root: ET.Element
    scopes: dict[ET.Element, dict[str, str]]
    names: dict[ET.Element, tuple[str, dict[str, str], dict[str, str]]]
    before: list[ET.Element]
    after: list[ET.Element]


def read(content: bytes | None) -> Scoped:
    """A part with its prefixes and instructions; ET.ParseError where it is malformed, too deep or has a DTD."""
    stack: list[ET.Element] = []
    roots: list[ET.Element] = []
    scopes, names, before, after = {}, {}, [], []
    parser = expat.ParserCreate()
    parser.ordered_attributes, parser.buffer_text = True, True

    def key_of(name: str, scope: dict[str, str], attribute: bool) -> str:
        prefix, colon, local = name.rpartition(":")
        if colon and prefix not in scope:
            raise ET.ParseError(f"unknown prefix {prefix}")
        uri = scope[prefix] if colon else "" if attribute else scope.get("", "")
        return f"{{{uri}}}{local}" if uri else local

    def start(name, attributes):
        deeper(len(stack))
        pairs = list(zip(attributes[::2], attributes[1::2], strict=True))
        own = {k[6:]: v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        above = scopes[stack[-1]] if stack else {"xml": "http://www.w3.org/XML/1998/namespace"}
        scope = {**above, **own} if own else above
        written = {key_of(k, scope, True): k for k, _ in pairs if k != "xmlns" and not k.startswith("xmlns:")}
        values = {key_of(k, scope, True): v for k, v in pairs if k != "xmlns" and not k.startswith("xmlns:")}
        if len(values) + len(own) < len(pairs):
            raise ET.ParseError("an attribute twice")
        el = ET.Element(key_of(name, scope, False), values)
        scopes[el], names[el] = scope, (name, written, own)
        (stack[-1].append if stack else roots.append)(el)
        stack.append(el)

    def text(data):
        if len(stack[-1]):
            stack[-1][-1].tail = (stack[-1][-1].tail or "") + data
        else:
            stack[-1].text = (stack[-1].text or "") + data

    def instruction(target, data):
        pi = ET.ProcessingInstruction(target, data or None)
        (stack[-1] if stack else after if roots else before).append(pi)

    def doctype(*_):
        raise ET.ParseError("DTD")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), text
    parser.ProcessingInstructionHandler, parser.StartDoctypeDeclHandler = instruction, doctype
    try:
        parser.Parse(content or b"", True)
    except (expat.ExpatError, ValueError, LookupError) as e:
        raise ET.ParseError(str(e)) from e
    return Scoped(roots[0], scopes, names, before, after)


def whole_number(value: str | None, thousandths: bool = False, measure: bool = False) -> int | None:
    """An attribute as an integer: digits; a percentage in thousandths of a percent, or a length with its
    unit in EMU, where these are legal. ValueError for anything else, None for none."""
    if value is None or not (value := value.strip()):
        return None
    if INTEGER.fullmatch(value):
        return int(value)
    if thousandths and PERCENT.fullmatch(value):
        return int(Decimal(value[:-1]) * 1000)
    if measure and MEASURE.fullmatch(value):
        return int(Decimal(value[:-2]) * EMU[value[-2:]])
    raise ValueError(value)


def target_of(source: str, target: str | None) -> str | None:
    """The part that a relationship of a source part leads to: percent-decoded, relative to the source's
    folder or, with a slash before it, to the package. None for what has a scheme, a host, a query, a
    fragment or no path, isn't UTF-8, or leaves the package."""
    if not target or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", target) or "?" in target or "#" in target:
        return None
    try:
        path = unquote_to_bytes(target).decode()
    except UnicodeDecodeError:
        return None
    path = posixpath.normpath(path.lstrip("/") if path.startswith("/") else posixpath.join(posixpath.dirname(source), path))
    return None if path in (".", "..") or path.startswith("../") or "\\" in path or "\0" in path else path
