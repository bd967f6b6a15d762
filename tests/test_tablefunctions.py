import pytest

from plumbline.operators import tablefunctions as X


@pytest.fixture(scope="module")
def hashes(spark):
    notes = [(d, s, (d + s) % 3 == 0, d == 2 and s == 5) for d in range(4) for s in range(1, 7)] * 2 + [(3, None, True, True)]
    spark.createDataFrame(notes, "deck_id long, slide int, notes boolean, comments boolean").repartition(5).createOrReplaceTempView("notes")
    runs = [(1, 1, [("Carlito",), ("+mn-lt",)]), (1, 2, [("Comic",)]), (2, 1, None), (2, 2, [(None,), ("",)])]
    spark.createDataFrame(runs, "deck_id long, slide int, runs array<struct<font:string>>").createOrReplaceTempView("runs")
    return X.register(spark)


def test_selectors_in_sql(spark, hashes):
    got = spark.sql(f"select * from selector(table(notes) partition by (deck_id), 'notes-comments', '{hashes['notes-comments']}')").collect()
    assert sorted(map(tuple, got)) == [(d, s) for d in range(4) for s in range(1, 7) if (d + s) % 3 == 0 or (d, s) == (2, 5)]
    got = spark.sql(f"select * from selector(table(runs) partition by (deck_id), 'non-bundled-font', '{hashes['non-bundled-font']}')").collect()
    assert list(map(tuple, got)) == [(1, 2)]
    assert spark.sql(f"select * from selector(table(select * from notes where false) partition by (deck_id), 'notes-comments', '{hashes['notes-comments']}')").count() == 0


@pytest.mark.parametrize("table,selector,sha,why", [("notes", "notes-comments", "sha256:0", "hash differs"), ("notes", "other", None, "unknown selector"), ("notes", "non-bundled-font", None, "has no runs"), ("runs", "notes-comments", None, "has no notes, comments")])
def test_what_is_wrong_fails_in_analysis(spark, hashes, table, selector, sha, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"select * from selector(table({table}) partition by (deck_id), '{selector}', '{sha or hashes.get(selector, 'x')}')")


def test_a_changed_descriptor_has_another_hash(spark, hashes):
    changed = ({**X.SELECTORS[0][0], "version": 2}, X.SELECTORS[0][1])
    assert X.register(spark, (changed,), "selector2")["notes-comments"] != hashes["notes-comments"]
