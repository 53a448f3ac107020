"""Registry invariants, and a fast sample of the queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["K1_reflect_pad", "K9_sobel", "F1_laplacian", "W2_best_two", "A8_normal_translation", "J6_mask_overlap", "Q4_ssim_map", "Y7_remap", "U5_agreement", "S3_decode_pixels"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", SAMPLE)
def test_sample(spark, con, key):
    note, wrong = compare(spark, con, key, FOLDER)
    assert not wrong, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
