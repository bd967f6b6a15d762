"""Selectors for SQL: SELECT * FROM selector(TABLE(t) PARTITION BY (deck_id), 'notes-comments', 'sha256:...').

A selector is a descriptor and a test of a row; it is called by its id and the hash of its descriptor. Both
are constants, and a wrong one fails when the query is analyzed, before anything runs. The table has
deck_id, slide and the columns that the descriptor names. One partition is one deck; what is kept of it
are the slides found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from plumbline.operators.checklist import FONTS
from plumbline.operators.selectors import descriptor_hash

Test = Callable[[Row], bool]

_BUNDLED = frozenset(FONTS)


def _unlisted_font(row: Row) -> bool:
    fonts = (r["font"] for r in row["runs"] or ())
    return any(f and not f.startswith("+") and f.lower() not in _BUNDLED for f in fonts)


#: Descriptors (selector_id, version, columns) and their tests.
SELECTORS: tuple[tuple[dict, Test], ...] = (
    ({"selector_id": "notes-comments", "version": 1, "columns": ["notes", "comments"]}, lambda row: bool(row["notes"] or row["comments"])),
    ({"selector_id": "non-bundled-font", "version": 1, "columns": ["runs"]}, _unlisted_font),
)


def register(spark: SparkSession, selectors: tuple[tuple[dict, Test], ...] = SELECTORS, name: str = "selector") -> dict[str, str]:
    """Registers the table function with these selectors. The hash of each selector's descriptor by its id."""
    known = {d["selector_id"]: (descriptor_hash(d), tuple(d["columns"]), test) for d, test in selectors}

    class Selector:
        def __init__(self):
            self.deck, self.found = None, set()

        @staticmethod
        def analyze(table: AnalyzeArgument, selector_id: AnalyzeArgument, sha256: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the first argument must be a table")
            if not selector_id.isConstantExpression or selector_id.value not in known:
                raise ValueError(f"{selector_id.value}: unknown selector")
            expected, columns, _ = known[selector_id.value]
            if not sha256.isConstantExpression or sha256.value != expected:
                raise ValueError(f"{selector_id.value}: descriptor hash differs")
            if lost := [c for c in ("deck_id", "slide", *columns) if c not in table.dataType.fieldNames()]:
                raise ValueError(f"{selector_id.value}: the table has no {', '.join(lost)}")
            return AnalyzeResult(T.StructType([table.dataType["deck_id"], T.StructField("slide", T.IntegerType())]))

        def eval(self, row: Row, selector_id: str, sha256: str):
            if known[selector_id][2](row):
                self.deck = row["deck_id"]
                self.found.add(row["slide"])

        def terminate(self):
            for slide in sorted(x for x in self.found if x is not None):
                yield self.deck, slide

    spark.udtf.register(name, udtf(Selector))
    return {k: sha for k, (sha, _, _) in known.items()}
