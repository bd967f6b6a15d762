import zlib
from decimal import Decimal as D

import pytest

from plumbline.sources import pdf

BOX = (D(0), D(0), D("960.009448818898"), D("540"))


def plain(objects: dict[int, str], root=1, extra="") -> bytes:
    out, at = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for n, body in objects.items():
        at[n] = len(out)
        out += f"{n} 0 obj\n{body}\nendobj\n".encode("latin-1")
    start = len(out)
    out += f"xref\n0 {max(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{at[n]:010d} 00000 n \n".encode() if n in at else b"0000000000 00000 f \n" for n in range(1, max(objects) + 1))
    return out + f"trailer << /Size {max(objects) + 1} /Root {root} 0 R {extra} >>\nstartxref\n{start}\n%%EOF".encode()


def compressed(objects: dict[int, str], predictor=True) -> bytes:
    """All objects in one object stream, cross-references in a stream."""
    last, body, heads = max(objects), "", ""
    for n, text in objects.items():
        heads += f"{n} {len(body)} "
        body += text + " "
    out = b"%PDF-1.5\n"
    packed = zlib.compress((heads + body).encode())
    first = len(out)
    out += f"{last + 1} 0 obj << /Type /ObjStm /N {len(objects)} /First {len(heads)} /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream endobj\n"
    start = len(out)
    places = {0: (0, 0, 255), last + 1: (1, first, 0), last + 2: (1, start, 0)} | {n: (2, last + 1, k) for k, n in enumerate(objects)}
    rows = [bytes([a]) + b.to_bytes(3) + bytes([c]) for a, b, c in (places.get(n, (0, 0, 0)) for n in range(last + 3))]
    if predictor:  # each row as its difference from the one above
        rows = [b"\x02" + bytes((x - y) % 256 for x, y in zip(row, above, strict=True)) for row, above in zip(rows, [bytes(5), *rows], strict=False)]
    table = zlib.compress(b"".join(rows))
    parms = "/DecodeParms << /Predictor 12 /Columns 5 >>" if predictor else ""
    return out + f"{last + 2} 0 obj << /Type /XRef /Size {last + 3} /W [1 3 1] /Root 1 0 R /Filter /FlateDecode {parms} /Length {len(table)} >>\nstream\r\n".encode() + table + f"\nendstream endobj\nstartxref\n{start}\n%%EOF".encode()


TREE = {
    1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Count 3 /MediaBox [0 0 960.009448818898 540] /Kids [3 0 R 4 0 R] >>", 3: "<< /Type /Page /Parent 2 0 R /CropBox [ 0 0 10 .5 ] % note\n/Title (a \\) ( b ) /MediaBox [0 0 1 1]) >>",
    4: "<< /Kids [6 0 R 5 0 R] /Rotate 90 /Parent 2 0 R >>", 5: "<< /Type /Page /Rotate -90 /MediaBox 7 0 R >>", 6: "<< /Type /Page /Resources << /Font << /F#31 [ true null <AB> ] >> >> >>", 7: "[-1.5 +2 3. 4]",
}
WANT = [(1, BOX, (D(0), D(0), D(10), D(".5")), 0, None), (2, BOX, BOX, 90, None), (3, (D("-1.5"), D(2), D(3), D(4)), (D("-1.5"), D(2), D(3), D(4)), 270, None)]


@pytest.mark.parametrize("content", [plain(TREE), compressed(TREE), compressed(TREE, False), plain(TREE).replace(b"\n", b"\n")], ids=["table", "predicted", "stream", "again"])
def test_pages(content):
    assert pdf.geometry(content) == WANT


def test_updates():
    base = plain(TREE)
    at = len(base) + 1
    new = b"\n3 0 obj << /Type /Page /CropBox [0 0 1 2] >> endobj\n"
    update = base + new + f"xref\n3 1\n{at:010d} 00000 n \ntrailer << /Size 8 /Root 1 0 R /Prev {base.rfind(b'xref', 0, base.rfind(b'startxref'))} >>\nstartxref\n{len(base) + len(new)}\n%%EOF".encode()
    assert pdf.geometry(update)[0][2] == (D(0), D(0), D(1), D(2)) and len(pdf.geometry(update)) == 3


RING = TREE | {4: "<< /Kids [2 0 R] >>"}
BAD = {
    "not a PDF": b"hello", "": None, "a page tree with a ring": plain(RING), "a page without a box": plain(TREE | {2: "<< /Kids [3 0 R] >>"}), "a box that isn't four numbers": plain(TREE | {7: "[1 2 3]"}), "a page that isn't there": plain(TREE | {2: "<< /Kids [99 0 R] >>"}),
    "no root": plain(TREE, 9), "references in a ring": plain(TREE | {7: "7 0 R"}), "cross-references that lead nowhere or back": plain(TREE, extra="/Prev 999999"), "values nested too deep": plain(TREE | {7: "[" * 500 + "]" * 500}), "cut": compressed(TREE)[:-60],
}


def test_broken_files_have_a_problem(spark):
    df = spark.createDataFrame([*BAD.items(), ("fine", plain(TREE))], "file string, content binary")
    got = {}
    for r in pdf.pages(df).collect():
        got.setdefault(r.file, []).append(r)
    assert len(got) == len(BAD) + 1 and [r.page for r in got["fine"]] == [1, 2, 3] and got["fine"][0].media_box.x1 == BOX[2]
    assert all(len(rows) == 1 and rows[0].page is None and rows[0].problem for k, rows in got.items() if k != "fine")
    assert all(rows[0].problem == k for k, rows in got.items() if k not in ("fine", "", "cut"))


def test_any_cut_or_changed_byte_only_gives_a_problem():
    for whole in (plain(TREE), compressed(TREE)):
        for k in range(0, len(whole), 3):
            assert pdf.geometry(whole[:k]) and pdf.geometry(whole[:k] + b"<" + whole[k + 1 :])


def test_geometry_problems(spark):
    page = "<< /Type /Page >>"
    right = lambda n, box="[0 0 960.009448818898 540]", more="": plain({1: "<< /Pages 2 0 R >>", 2: f"<< /MediaBox {box} {more} /Kids [{' '.join(f'{k + 3} 0 R' for k in range(n))}] >>"} | {k + 3: page for k in range(n)})
    files = {"fine": right(2), "few": right(1), "turned": right(2, more="/Rotate 90"), "small": right(2, "[0 0 960 540]"), "cut": right(2, more="/CropBox [0 0 1 1]"), "broken": b"x"}
    found = pdf.problems(pdf.pages(spark.createDataFrame(list(files.items()), "file string, content binary")), 2, "960.009448818898", "540")
    assert sorted(map(str, ((r.file, r.page, r.problem) for r in found.collect()))) == sorted(map(str, [("few", None, "1 pages"), ("broken", None, "not a PDF"), *((f, n, why) for f, why in (("turned", "rotated"), ("small", "media box"), ("cut", "crop box")) for n in (1, 2))]))
