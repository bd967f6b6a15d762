"""Queries against brute force on small tables that reach past what the driver tables have."""

import hashlib
import re

import pytest

from plumbline import catalog


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Writes tables (name -> rows, schema) and runs a query on them."""

    def run(name, **tables):
        sf = tmp_path_factory.mktemp("tables")
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{t}.parquet")
        return catalog.queries()[name](spark, str(sf)).collect()

    return run


def documents(*texts):
    return list(enumerate(texts)), "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


LONG = "the end. A start. of a | code a the | text.\nNext. the last. " * 60


def test_code_blocks_of_long_texts(table):
    blocks = lambda t: re.findall(r"(?s)\. .*?\. ", t)
    texts = ("a. b. c", LONG, None)
    want = {(k, None, None) if t is None else (k, len(blocks(t)), blocks(t) == blocks(t.replace("\n", " "))) for k, t in enumerate(texts)}
    assert len(LONG) > 2000 and {(r.doc_id, r.blocks, r.same) for r in table("code_blocks", documents=documents(*texts))} == want


def test_paraphrase_of_long_texts(table):
    def brute(t):
        parts = re.split("(`[^`]*`)", t.replace(" | ", "`"))
        return sha("".join(p if k % 2 else p.replace("the", "a").replace("a", "one") for k, p in enumerate(parts))), len(parts) // 2

    texts = ("the | a | a", LONG, None)
    want = {(k, *((None, None) if t is None else brute(t))) for k, t in enumerate(texts)}
    assert {(r.doc_id, r.sha, r.spans) for r in table("paraphrase", documents=documents(*texts))} == want


def test_hard_tokens_of_whole_texts(table):
    (got,) = table("hard_tokens", documents=documents('plain\n#a0B1c2 and deck.pptx\n12.5cm, 3° "two words" `code` شكل 図形'))
    want = sorted(["#a0B1c2", "deck.pptx", "12.5cm", "3°", '"two words"', "`code`", "شكل", "図形"])
    assert (got.n, got.tokens) == (8, " ".join(want))


def test_strip_markup_escapes_whole_pages(table):
    import html

    page = "<p class='a'>A & B</p>" * 50
    (got,) = table("strip_markup", pages=([(1, page)], "page_id long, html string"))
    assert got.escaped_sha == sha(html.escape(page))


def test_unitize_lines_past_999(table):
    got = sorted(table("unitize_lines", documents=documents("\n".join(f"line {k}" for k in range(1, 1205)))), key=lambda r: r.n)
    assert [r.id for r in got] == [f"d0.prompt-r{k:03d}" for k in range(1, 1205)]


def test_projection_has_the_nodes_of_every_supplier(table):
    rows = [(997, 1, 7, 2), (997, 2, 8, 3), (5, 1, 9, 4)]
    got = {r.subject for r in table("projection_equality", lineitem=(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"))}
    assert got == {f'{{"l_orderkey":997,"l_linenumber":{n},"l_partkey":{p}}}' for n, p in ((1, 7), (11, 7), (2, 8), (12, 8))}


def test_brands_are_unique_over_all_parts(table):
    got = table(
        "integrity_violations",
        orders=([(1, 1)], "o_orderkey long, o_custkey long"),
        customer=([(1, 0.0)], "c_custkey long, c_acctbal double"),
        lineitem=([(1, 1, 0.0, 0.0)], "l_orderkey long, l_linenumber int, l_tax double, l_discount double"),
        part=([(1, "a", 9), (60, "b", 9), (70, "b", 9), (80, "a", 9), (90, "c", 9)], "p_partkey long, p_brand string, p_size int"),
    )
    assert sorted((r.broken_rule, r.subject) for r in got) == [("unique brand", "a"), ("unique brand", "b")]
