"""Corrections of chunks that carry vectors, and streams of tables kept as folders."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import embedding
from pagewright.operators.embedding import embed
from pagewright.operators.index import apply_corrections, with_chunk_id
from pagewright.registry import QUERIES


def test_every_vector_is_that_of_its_text_after_corrections(spark):
    chunks = with_chunk_id(
        spark.createDataFrame(
            [(6, "math", "Math", "m.pdf", i, f"chunk number {i} withh a slip", i, i) for i in range(4)],
            "grade int, subject string, book_title string, source_file string, chunk_index int, text string, "
            "page_start int, page_end int",
        )
    ).withColumn("embedding", embed(F.col("text")))
    page = "grade int, subject string, book_title string, source_file string, page int, text string"
    patches = spark.createDataFrame([(6, "math", "Math", "m.pdf", 3, "a patch by hand")], page)
    repairs = spark.createDataFrame([(6, "math", "Math", "m.pdf", 4, "a page read again")], page)
    fixes = spark.createDataFrame(
        [("m.pdf", 1, 0, "withh", "with"), ("m.pdf", 2, 0, "absent", "none")],
        "source_file string, chunk_index int, position int, wrong string, right string",
    )
    rows = apply_corrections(chunks, patches, fixes, repairs).withColumn("fresh", embed(F.col("text"))).collect()
    assert len(rows) == 6
    assert all(r["embedding"] == r["fresh"] for r in rows)
    assert {r["chunk_index"]: r["text"] for r in rows}[1] == "chunk number 1 with a slip"


def test_sessions_stream_from_a_folder_of_part_files(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/conversations.parquet").repartition(3).write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    rows = [tuple(r) for r in QUERIES["stream_sessions"](spark, str(tmp_path)).collect()]
    assert rows and sorted(rows) == sorted(tuple(r) for r in QUERIES["session_history"](spark, sf).collect())


def test_vectors_count_words_and_remember_few_of_them(spark, monkeypatch):
    texts = ["Ab ab\nc", "", "   \n", None, "tab\there İI", " x  y ", " ".join(f"w{i}" for i in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(1).orderBy("i")
    found = [r["v"] for r in rows.select("i", embed(F.col("text"), 16).alias("v")).orderBy("i").collect()]
    for text, vector in zip(texts, found):
        if text is None:
            assert vector is None
            continue
        counts = np.zeros(16)
        for word in filter(None, re.split(r"[ \n]+", text.lower())):
            counts[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 16] += 1
        norm = np.sqrt((counts**2).sum())
        assert vector == (counts / norm if norm else counts).astype(np.float32).tolist()
    monkeypatch.setattr(embedding, "REMEMBERED", 10)
    slots = embedding._Slots(16)
    first = [slots[f"w{i}"] for i in range(300)]
    assert len(slots) <= 10 and first == [slots[f"w{i}"] for i in range(300)]
