"""A turn of the conversation: commands, questions and what they leave behind."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.operators import feedback as fb
from pagewright.operators.embedding import embed
from pagewright.operators.generation import OfflineClient, RateLimited
from pagewright.plans import answering
from pagewright.plans import tutoring as tu
from pagewright.settings import Settings
from pagewright.streaming.channels import outgoing
from pagewright.streaming.sessions import deliver

MESSAGES = "channel string, user_id string, arrival bigint, text string, display_name string, is_private boolean"
SESSIONS = "channel string, user_id string, grade int, subject string, last_answer_id bigint"


class Echo:
    """Answers from the first passage; fails for one question and classifies by a word."""

    def complete(self, model, messages, settings):
        prompt = messages[-1]["content"]
        if "danh sách (" in prompt:
            return "KHAC" if "những môn" in prompt else "Toán" if "phân số" in prompt else ""
        if "lỗi lạ" in prompt:
            raise KeyError("unforeseen")
        if "chờ" in prompt:
            raise RateLimited
        source = prompt.split("(Nguồn: ", 1)[1].split(")", 1)[0]
        return f"Theo {source}"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, "Phân số là số có tử và mẫu", "Toán", 6, "toan.pdf", 0),
        (2, "Chiến thắng năm 938", "Lịch sử", 6, "su.pdf", 0),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string, subject string, grade int, source_file string, chunk_index int")
    chunks = chunks.withColumns(
        {"embedding": embed(F.col("text")), "book_title": F.col("subject"), "page_start": F.lit(5), "page_end": F.lit(5)}
    )
    offsets = spark.createDataFrame([("toan.pdf", 1), ("su.pdf", 0)], "source_file string, offset int")
    return chunks, offsets


def log_of(spark, rows=()):
    kinds = dict(c.strip().split(" ") for c in fb.ANSWER_COLUMNS.split(","))
    full = [tuple(r.get(c) for c in kinds) for r in rows]
    return spark.createDataFrame(full, fb.ANSWER_COLUMNS)


def turns(spark, corpus, texts, sessions=(), log=(), **options):
    rows = [("c", u, i, t, f"name {u}", True) for i, (u, t) in enumerate(texts)]
    messages = spark.createDataFrame(rows, MESSAGES).repartition(3)
    known = spark.createDataFrame(list(sessions), SESSIONS)
    return tu.tutor_turns(messages, known, log_of(spark, log), *corpus, make_client=Echo, **options)


def test_a_conversation(spark, corpus):
    texts = [
        ("u", "phân số là gì"),  # 0: no grade yet
        ("u", "/lop 6"),
        ("u", "phân số là gì"),  # 2: subject found by the classifier
        ("u", "/baosai sai rồi"),
        ("u", "/chamdiem 5 4"),
        ("u", "/mon lich su"),  # 5: clears the history
        ("u", "/baosai"),
        ("u", "năm 938"),
        ("u", "/chamdiem 9 1"),
        ("u", "/chamdiem 3"),  # 9
        ("u", "/lop 6"),  # the same grade: nothing is forgotten
        ("u", "/baosai"),
        ("u", "/xoa"),
        ("u", "/chamdiem 1 1"),
        ("v", "/toi"),  # 14
        ("v", "bạn hỗ trợ những môn nào"),
        ("v", "/baosai #7"),
        ("v", "/baosai #999"),
        ("v", "  "),
        ("v", "/abc"),  # 19
        ("v", "/lop 99"),
        ("v", "/mon xyz"),
        ("w", "/baosai"),  # 22: its last answer is from before the batch
        ("w", "/phanhoi"),
        ("admin", "/phanhoi"),
        ("w", "không rõ zzz qqq"),
    ]
    sessions = [("c", "v", 6, None, None), ("c", "w", 1, None, 7), ("d", "u", 9, "Toán", 1)]
    log = [{"answer_id": 7, "channel": "c", "user_id": "w", "citations": "Toán, trang 9", "grounded": 1}]
    summary = spark.createDataFrame([("tổng kết",)], "text string")
    out = turns(spark, corpus, texts, sessions, log, settings=Settings(admin_user_ids="admin, boss"), summary=summary)
    got = {r["arrival"]: r for r in out.collect()}
    assert len(got) == len(texts)
    assert got[0]["reply"] == tu.NO_GRADE and got[0]["answer_id"] is None
    assert (got[1]["grade"], got[1]["subject"]) == (6, None) and "lớp 6" in got[1]["reply"]
    assert (got[2]["answer_id"], got[2]["asked_subject"]) == (8, "Toán")
    assert got[2]["reply"].startswith("Theo Toán, trang 4") and "trang 4 để kiểm tra lại" in got[2]["reply"]
    assert got[3]["report"]["answer_id"] == 8 and got[3]["accepted"] and "trang 4" in got[3]["reply"]
    assert got[4]["accepted"] and got[4]["reply"] == tu.RATING_THANKS
    assert (got[5]["subject"], got[5]["epoch"] - got[4]["epoch"]) == ("Lịch sử", 1)
    assert got[6]["reply"] == tu.NOTHING_TO_REPORT
    assert got[7]["answer_id"] == 9 and "Lịch sử, trang 5" in got[7]["answer"]
    assert got[8]["reply"] == tu.RATING_USAGE and not got[8]["accepted"]
    assert got[9]["accepted"] and got[9]["rating"]["answer_id"] == 9
    assert got[11]["report"]["answer_id"] == 9 and got[11]["accepted"]
    assert got[12]["reply"] == tu.CLEARED and got[13]["reply"] == tu.NOTHING_TO_REPORT
    assert got[14]["reply"] == "Bạn đang học lớp 6."
    assert "• Lịch sử\n• Toán" in got[15]["reply"] and got[15]["answer_id"] is None
    assert got[16]["accepted"] and "Toán, trang 9" in got[16]["reply"]
    assert got[17]["reply"] == tu.UNKNOWN_ANSWER and not got[17]["accepted"]
    assert got[18]["reply"] == tu.EMPTY_QUESTION and "/abc" in got[19]["reply"]
    assert got[20]["reply"] == tu.GRADE_USAGE and got[20]["grade"] == 6 and got[21]["reply"] == tu.SUBJECT_USAGE
    assert got[22]["report"]["answer_id"] == 7 and got[22]["accepted"]
    assert got[23]["reply"] == tu.NOT_ADMITTED and got[24]["reply"] == "tổng kết"
    assert got[25]["reply"] == tu.NO_SUBJECT  # grade 1 has no book
    # What the turns leave behind.
    profiles = spark.createDataFrame([("c", "v", 6, None), ("c", "x", 3, "Toán")], "channel string, user_id string, grade int, subject string")
    after = {(r[0], r[1]): (r[2], r[3]) for r in tu.changed_profiles(profiles, out).collect()}
    assert after == {("c", "u"): (6, "Lịch sử"), ("c", "v"): (6, None), ("c", "x"): (3, "Toán")}
    logged = {r["answer_id"]: r for r in tu.logged_answers(out).collect()}
    assert sorted(logged) == [8, 9] and logged[8]["subject"] == "Toán" and logged[8]["display_name"] == "name u"
    assert {(r["answer_id"], r["reporter_id"], r["note"]) for r in tu.accepted_reports(out).collect()} == {
        (8, "u", "sai rồi"), (9, "u", None), (7, "v", None), (7, "w", None),
    }
    assert {(r["answer_id"], r["clarity"], r["guidance"]) for r in tu.accepted_ratings(out).collect()} == {(8, 5, 4), (9, 3, None)}


def test_failures_end_one_question_only(spark, corpus):
    texts = [("u", "lỗi lạ phân số"), ("v", "chờ phân số"), ("w", "phân số")]
    out = turns(spark, corpus, texts, [("c", u, 6, "Toán", None) for u in "uvw"])
    got = {r["user_id"]: r for r in out.collect()}
    assert got["u"]["answer"] == fv.SERVICE_ERROR_ANSWER and not got["u"]["grounded"]
    assert got["v"]["answer"] == fv.RATE_LIMIT_ANSWER
    assert got["w"]["answer"].startswith("Theo Toán") and got["w"]["answer_id"] == 3


class Accents:
    def complete(self, model, messages, settings):
        return messages[-1]["content"].split(": ", 1)[1].replace("phan so", "phân số")


def test_questions_are_rewritten_before_they_are_searched(spark, corpus):
    out = turns(spark, corpus, [("u", "phan so la gi")], [("c", "u", 6, "Toán", None)], restore=Accents)
    assert out.first()["question"] == "phân số la gi"


def test_stream_of_messages_is_delivered(spark, corpus, tmp_path):
    """Micro-batches go through the turn; profiles and log carry over; a batch written twice counts once."""
    profiles_at, log_at, replies_at = (str(tmp_path / n) for n in ("profiles", "log", "replies"))
    schema = MESSAGES
    empty = spark.createDataFrame([], SESSIONS)
    empty.drop("last_answer_id").write.parquet(f"{profiles_at}/0")
    log_of(spark).write.parquet(f"{log_at}/batch=-1")
    state = {"profiles": f"{profiles_at}/0"}

    def handle(batch):
        profiles = spark.read.parquet(state["profiles"])
        log = spark.read.parquet(log_at).drop("batch")
        last = log.groupBy("channel", "user_id").agg(F.max("answer_id").alias("last_answer_id"))
        sessions = profiles.join(last, ["channel", "user_id"], "left")
        out = tu.tutor_turns(batch, sessions, log, *corpus, make_client=Echo)
        state["turns"], state["before"] = out, profiles
        return outgoing(out.select("channel", "user_id", "arrival", F.col("reply").alias("message")), "discord")

    def sink(replies, batch_id):
        replies.write.mode("overwrite").parquet(f"{replies_at}/batch={batch_id}")
        tu.logged_answers(state["turns"]).write.mode("overwrite").parquet(f"{log_at}/batch={batch_id}")
        changed = f"{profiles_at}/{batch_id + 1}"
        tu.changed_profiles(state["before"], state["turns"]).write.mode("overwrite").parquet(changed)
        state["profiles"] = changed

    def arrive(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        names = [c.split()[0] for c in schema.split(", ")]
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        query = deliver(stream, str(tmp_path / "checkpoint"), handle, sink)
        query.processAllAvailable()
        query.stop()

    arrive("1.json", [("c", "u", 1, "/lop 6", None, True), ("c", "u", 2, "/mon toan", None, True)])
    arrive("2.json", [("c", "u", 3, "phân số", None, True)])
    arrive("3.json", [("c", "u", 4, "/baosai", None, True)])
    replies = {r["arrival"]: r["text"] for r in spark.read.parquet(replies_at).collect()}
    assert sorted(replies) == [1, 2, 3, 4] and replies[3].startswith("Theo Toán, trang 4") and "trang 4" in replies[4]
    assert [r["answer_id"] for r in spark.read.parquet(log_at).collect()] == [1]


def test_gapless_rank_of_sparse_values(spark, monkeypatch):
    """Ranks have no gaps, and the ranges they are given in are even however far apart the values lie."""
    from pagewright.plans import ordered

    kept, store = [], ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, name: kept.append(store(df, name)) or kept[-1])
    values = [i * 10**12 + i % 7 for i in range(2_000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = ordered.gapless_rank(df, "v", "rank").collect()
        sizes = [r["count"] for r in kept[0].groupBy("__range").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [r["v"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(values)
    assert sorted(r["rank"] for r in got) == list(range(2_000))
    assert len(sizes) >= 8 and max(sizes) < 3 * 2_000 / 8


def test_chunks_are_not_searched_when_every_question_has_its_subject(spark, monkeypatch):
    def searched(*_, **__):
        raise AssertionError("searched")

    monkeypatch.setattr(answering, "retrieve", searched)
    monkeypatch.setattr(answering, "classify_subject", lambda rows, *_: rows.withColumn("detected", F.lit("Toán")))
    questions = spark.createDataFrame([("1", "phân số là gì", 6)], "qid string, question string, grade int")
    chunks = spark.createDataFrame([(1, "Toán", 6)], "chunk_id bigint, subject string, grade int")
    (row,) = answering.detect_subjects(questions, chunks, OfflineClient).collect()
    assert (row["qid"], row["subject"]) == ("1", "Toán") and "detected" not in row
