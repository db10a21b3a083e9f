"""The registered queries against DuckDB SQL where it expresses them, and against each other, on the small tables."""

import os
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

from tabforge.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql_agrees(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([dict(zip(want.columns, x, strict=True))[c] for c in cols]) for x in want.fetchall())


def test_every_document_has_a_row(spark, con):
    ids = sorted(x[0] for x in con.sql("SELECT doc_id FROM documents").fetchall())
    for name in ("op1_fingerprints", "op2_mixing", "op5_toxicity", "op6_pii", "op7_secrets", "op8_bpe", "op10_quality"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, DATA).select("doc_id").collect()) == ids, name


def test_held_out_rows_and_scores(spark):
    for r in queries.op5_toxicity(spark, DATA).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_token_counts_agree_with_the_library(spark, con):
    lib = Tokenizer.from_file(queries.TOKENIZER)
    want = sorted(len(lib.encode(t or "", add_special_tokens=False).ids) for (t,) in con.sql("SELECT text FROM documents").fetchall())
    assert sorted(r.n_tokens for r in queries.op8_bpe(spark, DATA).collect()) == want
    assert sorted(r.n_tokens for r in queries.op9_token_counts(spark, DATA).collect()) == want
