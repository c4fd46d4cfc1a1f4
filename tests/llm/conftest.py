from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def run(spark):
    """Rows of a registered query at sf0.01, as tuples by id."""
    from climatrix.llm.queries import QUERIES

    kept = {}

    def rows(name):
        if name not in kept:
            kept[name] = sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=lambda r: r[:2])
        return kept[name]

    return rows


#: Rows with nulls, empty and one very long text, repeats, ties and columns whose names the operators use themselves.
ODD = [
    (1, "one two three four five six seven eight nine ten " * 3, "x"),
    (2, "one two three four five six seven eight nine ten " * 3, None),
    (3, None, "x"),
    (4, "", "y"),
    (5, "   \n\t ", "y"),
    (6, "word " * 60_000, "z"),
    (7, "Licensed under the MIT License", "z"),
    (7, "Licensed under the MIT License", "z"),
    (8, "mail me at a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, +49 (30) 1234-5678 é", "z"),
    (None, "a text without an id", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id long, text string, row string"
    rows = spark.createDataFrame(ODD, schema)
    return rows.selectExpr("doc_id", "text", "row", "row AS gone_row", "row AS term_row", "row AS terms", "row AS gone_id", "row AS n", "row AS chunk", "row AS score", "row AS key")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
