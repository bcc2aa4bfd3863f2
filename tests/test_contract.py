import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = ["merge_intervals", "slot_activity", "inbox", "pair_requests", "media_events", "catalog_filter", "month_coverage", "index_records", "upsert_requests", "time_blocks"]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_flagship(spark):
    assert entry.entry(spark).count() == 25 * 120


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_its_sql_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{entry.SMOKE_DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, entry.SMOKE_DIR)
    other = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in other.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, other.fetchall()))


def test_no_forced_plans_hide_in_the_library():
    from pathlib import Path
    text = "\n".join(p.read_text() for p in (Path(entry.__file__).parent / "colloquia").rglob("*.py"))
    assert "localCheckpoint" not in text and "crossJoin" not in text
