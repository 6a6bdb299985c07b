from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from newsgraph.session import build  # noqa: E402

FIXTURES = Path(__file__).resolve().parent / "fixtures"


@pytest.fixture(scope="session")
def spark():
    session = build(
        "tests", "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def gazetteer(spark):
    rows = [("Jane", "PERSON"), ("Jane Doe", "PERSON"), ("Ann Lee", "PERSON"),
            ("Acme Corp", "ORGANIZATION"), ("Springfield", "LOCATION"), ("Ohio", "LOCATION")]
    return spark.createDataFrame(rows, "entity string, type string")


@pytest.fixture(scope="session")
def site_pages(spark):
    """The landed pages of tests/fixtures/pages; the first line of a file is
    a comment with its address."""
    rows = []
    for path in sorted((FIXTURES / "pages").glob("*.html")):
        first, html = path.read_text().split("\n", 1)
        rows.append((first.removeprefix("<!-- ").removesuffix(" -->"), html))
    return spark.createDataFrame(rows, "url string, html string")


def rows(df, *columns):
    """Sorted tuples of a frame."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
