import xml.etree.ElementTree as ET

import pytest

from plumbline.sources.compatibility import NotUnderstood, resolve

HEAD = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:n="urn:new" xmlns:o="urn:other"'


def text(xml, *understood):
    return ET.canonicalize(ET.tostring(resolve(xml.encode(), frozenset(understood))))


def test_choices_and_fallback():
    xml = f'<r {HEAD}><mc:AlternateContent><mc:Choice Requires="n o"><a/></mc:Choice><mc:Choice Requires="n"><b/></mc:Choice><mc:Fallback><c/><d/></mc:Fallback></mc:AlternateContent></r>'
    assert text(xml) == "<r><c></c><d></d></r>"
    assert text(xml, "urn:new") == "<r><b></b></r>"
    assert text(xml, "urn:new", "urn:other") == "<r><a></a></r>"


def test_ignorable_is_inherited_and_content_processed():
    xml = f'<r {HEAD} mc:Ignorable="n" mc:ProcessContent="n:keep"><x n:attr="1" id="2"><n:gone><y/></n:gone><n:keep><z/></n:keep></x></r>'
    assert text(xml) == '<r><x id="2"><z></z></x></r>'
    assert "gone" in text(xml, "urn:new")


def test_must_understand():
    xml = f'<r {HEAD}><x mc:MustUnderstand="o"/></r>'
    assert text(xml, "urn:other") == "<r><x></x></r>"
    with pytest.raises(NotUnderstood):
        text(xml)
    with pytest.raises(NotUnderstood):
        text(f'<r {HEAD} mc:Ignorable="zz"/>')
