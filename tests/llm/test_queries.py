import zlib

import duckdb
import numpy as np
import pytest

from check_oracle import TABLES, rows_of
from pagewright.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_token_blocks_hold_what_the_tokenizer_gives(spark, sf, duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r for r in QUERIES["op8_token_blocks"](spark, sf).collect()}
    start = 0
    for ident, text in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        row = found.pop(ident)
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not found


def test_other_queries_have_a_row_for_each_document(spark, sf, duck):
    (count,) = duck.execute("SELECT count(*) FROM documents").fetchone()
    for name in ("op1_mix_sources", "op4_toxicity", "op6_near_duplicates", "op9_piece_segmentation"):
        assert QUERIES[name](spark, sf).select("doc_id").distinct().count() == count
    report = QUERIES["op9_piece_segmentation"](spark, sf)
    assert report.where("NOT round_trip OR best_score < second_score").count() == 0
