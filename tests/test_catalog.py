"""Registered queries against their SQL. All of them with QUILLMARK_ALL=1, else a quick choice."""

import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("QUILLMARK_TABLES", "/root/testdata/sf0.001")
QUICK = """
clean_text word_tokens type_frequency_profile pos_tags document_sentiment tree_depth code_profile
markup_depth sample_per_source stratified_split pair_turns balanced_pair positional_zip word_tfidf
classification_report annotate_documents annotate_sentences stream_annotate
""".split()
NAMES = list(entry.oracle_sql()) if os.environ.get("QUILLMARK_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def ordered(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    rows = [tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = tables.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got) == ordered(want)
