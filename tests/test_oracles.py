"""Queries against DuckDB on the smallest tables; LEAFSTACK_ALL=1 runs every one."""

import decimal
import os

import duckdb
import pytest

from leafstack.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
SAMPLE = ("I2_id_to_timestamp I8_safe_filename B5_default_fields B8_date_range_join B13_full_search G1_stable_multi_sort H1_reachable H2_preorder_paths "
          "H4_redirect_chains F1_sibling_positions F7_first_reference D5_children_lists G4_sort_children A19_layout_paths C8_unindexed_files L11_all_checks "
          "L3_move_items L6_recycle_items L8_delete_items A13_export_manifest H7_rebuild_folders J1_fast_text J6_page_metadata J9_externalised_pages "
          "C11_refresh_classes A2_shard_merge A4_text_shards A8_member_classes N1_incremental_index").split()
NAMES = sorted(ORACLES) if os.environ.get("LEAFSTACK_ALL") else SAMPLE


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of(columns, cur.fetchall())
