"""The driver's functions, and queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["segments", "byte_histogram", "block_pairs", "bloom_words", "cand_combined", "cand_unpaired", "cand_hash1024", "many_patterns", "cand_stored", "append_records", "blocked_membership", "crc_of_block", "index_of_changes", "append_equals_rebuild", "change_set", "stream_blocks", "pair_hash_table", "required_count", "cand_inverted", "cand_inverted_long", "bitmap_membership", "record_block_range", "transport_pieces", "stream_appended", "index_versions", "truncate_many_files", "pattern_places", "benchmark_places", "watch_polls"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "documents pages benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_is_as_its_sql_says(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = tables.execute(entry.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    want = sorted(str([r[found.index(k)] for k in columns]) for r in cursor.fetchall())
    assert sorted(str([r[k] for k in columns]) for r in df.collect()) == want
