"""Queries over releases whose pages repeat urls: the page with the least page_id stands for its url."""

import duckdb
import pytest

from tests.test_sql_twins import same_rows
from tomeline.plans import registry


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """240 pages over 118 urls, greatest page_id first; pages of one url differ in html and length."""
    d = str(tmp_path_factory.mktemp("repeated"))
    c = duckdb.connect()
    c.sql(f"""copy (SELECT i AS page_id, 'http://h' || CAST(i % 7 % 2 AS VARCHAR) || '.example.org/en/' || CAST(i % 59 AS VARCHAR) AS url,
        '<p>' || repeat('word ' || CAST(i AS VARCHAR), 50 + i * 3) || '</p>' AS html FROM range(240) t(i) ORDER BY i DESC) to '{d}/pages.parquet'""")
    c.sql(f"create view pages as select * from '{d}/pages.parquet'")
    return d, c


@pytest.mark.parametrize("name", ["c12_lookup_document", "c13_check_invariants", "c15_ingestion_report", "c3_apply_delta", "c3_apply_delta_chunks", "c6_snapshot_manifest"])
def test_first_page_of_a_url(spark, repeated, name):
    d, db = repeated
    same_rows(registry.QUERIES[name](spark, d), db.sql(registry.ORACLES[name]))
