"""Registered queries against their SQL, a part of them unless ALL_QUERIES is set."""

import os

import pytest
from compare import connection, difference

import __spark_entry__ as entry

# One query or more per module; ``tests/check.py`` runs them all.
CORE = (
    "a26_lake_source p3_approx_profile p4_exact_distinct p7_uniqueness p8_composite_key p9_empty_tables "
    "i3_primary_keys i6_foreign_keys i7_all_inclusions j9_inclusion a3_postgres_tables a7_postgres_foreign "
    "a16_oracle_foreign a24_sqlserver_volumes f3_field_name f4_free_text l1_catalogue_order l2_page r5_edges "
    "w5_best_match g7_table_info d1_decode d5_statements d19_altered_keys w4_last_create w1_adaptive_batches "
    "t1_payloads t3_token_chunks t5_json_arrays i9_validated_answers n3_key_flags n6_column_descriptions "
    "a27_read_documents a28_read_store k7_request_status x1_format_size"
).split()

ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf_dir, con, name):
    assert difference(entry.queries()[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 17


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_partition_count_changes_nothing(spark, sf_dir):
    def rows():
        q = entry.queries()
        return [sorted(map(str, q[n](spark, sf_dir).collect())) for n in ("r5_edges", "w1_adaptive_batches")]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
