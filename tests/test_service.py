import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions.messages import may_read_feedback
from pagewright.operators import evaluation as ev
from pagewright.operators import feedback as fb
from pagewright.operators import generation as ge
from pagewright.operators import sessions as ss
from pagewright.operators.routing import route
from pagewright.plans.answering import answer_questions, detect_subjects, run_benchmark
from pagewright.operators.retrieval import passage_key
from pagewright.settings import Settings
from pagewright.sources.tables import feedback_sheet, write_csv
from pagewright.streaming.channels import incoming, outgoing, webhook_deliveries
from pagewright.streaming.sessions import _Latest, latest_states, run_to_table, track_scope

ANSWERS = "answer_id bigint, created_at string, channel string, user_id string, display_name string, grade int, subject string, question string, answer string, citations string, grounded int"


def answers(spark):
    rows = [
        (1, "2026-01-01T08:00:00", "c", "u1", None, 6, "Toán", "q1", "a1", "T, trang 1\nT, trang 2", 1),
        (2, "2026-01-01T09:00:00", "c", "u1", "An", 6, "Toán", "q2", "a2", "", 0),
        (3, "2026-01-01T10:00:00", "c", "u2", None, 7, "Toán", "q3", "a3", "T, trang 3", 1),
        (4, "2026-01-01T11:00:00", "c", "u1", "An Bình", 6, "Toán", "q4", "a4", "", 1),
    ]
    return spark.createDataFrame(rows, ANSWERS)


def test_feedback(spark, tmp_path):
    known = answers(spark)
    old = spark.createDataFrame([(1, 1, "t1", "u1"), (2, 3, "t2", "u2"), (3, 99, "t3", "u1")], "report_id bigint, answer_id bigint, created_at string, reporter_id string")
    reports = fb.accept_reports(fb.with_later_columns(old, "note", "reporter_name"), known)
    arrived = [(1, "s1", 5, None, 1), (1, "s1", 2, 3, 2), (1, "s2", 4, 4, 3), (2, "s1", 9, 1, 4), (99, "s1", 1, 1, 5)]
    ratings = fb.accept_ratings(spark.createDataFrame(arrived, "answer_id bigint, user_id string, clarity int, guidance int, seq int"), known, ["seq"])
    assert sorted((r["user_id"], r["clarity"], r["guidance"]) for r in ratings.collect()) == [("s1", 2, 3), ("s2", 4, 4)]
    s = fb.summary(known, reports, ratings).first()
    assert (s["answers"], s["grounded_answers"], s["refusals"], s["reports"], s["reporters"], s["ratings"], s["raters"]) == (4, 3, 1, 2, 2, 2, 2)
    assert (s["average_clarity"], s["average_guidance"], s["report_rate"]) == (3.0, 3.5, 0.5)
    empty = fb.summary(known.limit(0), reports.limit(0), ratings.limit(0)).first()
    assert (empty["answers"], empty["grounded_answers"], empty["average_clarity"], empty["report_rate"]) == (0, 0, None, 0.0)
    newest = fb.recent_reports(reports, known, 1).collect()
    assert [(r["report_id"], r["reporter"], r["question"]) for r in newest] == [(2, "(mã u2)", "q3")]
    both = {r["report_id"]: (r["reporter"], r["display_name"]) for r in fb.recent_reports(reports, known).collect()}
    assert both == {1: ("An Bình", "An Bình"), 2: ("(mã u2)", None)}
    write_csv(feedback_sheet(fb.recent_reports(reports, known)), str(tmp_path / "sheet"))
    sheet = spark.read.option("header", "true").csv(str(tmp_path / "sheet"))
    assert len(sheet.columns) == 12 and {r["trang_sach"] for r in sheet.collect()} == {"T, trang 1; T, trang 2", "T, trang 3"}


def test_admission(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("a", None)], "u string, p boolean")
    gate = lambda ids: [r[0] for r in df.select(may_read_feedback(F.col("u"), F.col("p"), ids)).collect()]
    assert gate(["a"]) == [True, False, False, False] and gate([]) == [False] * 4


class Scripted:
    """Replies by model name: a text, a list of successive texts, or an error class."""

    def __init__(self, script):
        self.script = {k: (list(v) if isinstance(v, list) else v) for k, v in script.items()}

    def complete(self, model, messages, settings):
        reply = self.script[model]
        if isinstance(reply, type):
            raise reply()
        return reply.pop(0) if isinstance(reply, list) else reply


@pytest.mark.parametrize(
    "script, expected",
    [
        ({"m": "xin chào"}, "xin chào"),
        ({"m": ge.RateLimited, "n": "thay thế"}, "thay thế"),
        ({"m": ge.RateLimited, "n": ge.RateLimited}, fv.RATE_LIMIT_ANSWER),
        ({"m": ge.ServiceError, "n": "không tới"}, fv.SERVICE_ERROR_ANSWER),
        ({"m": ["", "lần hai"]}, "lần hai"),
        ({"m": ["", ""], "n": "không tới"}, ""),
    ],
)
def test_fallback(script, expected):
    assert ge.ask(Scripted(script), Settings(model="m", fallback_models=" n, m ,"), []) == expected


def test_client_registry():
    assert ge.client_for(Settings()) is ge.OfflineClient
    with pytest.raises(ValueError):
        ge.client_for(Settings(provider="unknown"))
    ge.register_client("Test ", ge.OfflineClient)
    assert ge.client_for(Settings(provider=" TEST")) is ge.OfflineClient


class Refusing:
    def complete(self, model, messages, settings):
        assert messages[0]["role"] == "system" and "(Nguồn: " in messages[-1]["content"]
        return "Mình chưa tìm thấy thông tin này"


class Silent:
    def complete(self, model, messages, settings):
        return ""


def test_answers_end_to_end(spark):
    chunks = spark.createDataFrame(
        [(1, "Phân số là số dạng a/b. Câu sau.", 6, "Toán", "Toán 6", "a.pdf", 0, 13, 14, [1.0, 0.0]), (2, "Khác", 6, "Toán", "Toán 6", "a.pdf", 1, 20, 20, [0.9, 0.1])],
        "chunk_id bigint, text string, grade int, subject string, book_title string, source_file string, chunk_index int, page_start int, page_end int, embedding array<float>",
    ).withColumn("passage", passage_key(F.col("source_file"), F.col("chunk_index"), F.col("text")))
    questions = spark.createDataFrame([("q1", "Phân số là gì?", 6, "Toán", [1.0, 0.0]), ("q2", "Gì đó?", 6, "Lịch sử", [1.0, 0.0])], "qid string, question string, grade int, subject string, embedding array<float>")
    offsets = spark.createDataFrame([("a.pdf", 1)], "source_file string, offset int")
    got = {r["qid"]: r for r in answer_questions(questions, chunks, offsets).collect()}
    assert got["q1"]["answer"] == "Theo sách Toán 6, trang 12-13: Phân số là số dạng a/b"
    assert got["q1"]["grounded"] and got["q1"]["citations"] == ["Toán 6, trang 12-13"] and "mở sách Toán 6, trang 12-13" in got["q1"]["message"]
    assert got["q2"]["answer"] == fv.NO_CONTEXT_ANSWER == got["q2"]["message"] and not got["q2"]["grounded"] and got["q2"]["citations"] == []
    refused = {r["qid"]: r for r in answer_questions(questions, chunks, offsets, make_client=Refusing).collect()}
    assert not refused["q1"]["grounded"] and refused["q1"]["citations"] == [] and refused["q1"]["message"] == refused["q1"]["answer"]
    silent = {r["qid"]: r for r in answer_questions(questions, chunks, offsets, make_client=Silent).collect()}
    assert silent["q1"]["answer"] == fv.NO_CONTEXT_ANSWER and not silent["q1"]["grounded"]


class Classifier:
    def complete(self, model, messages, settings):
        return "Môn toan." if "phân số" in messages[-1]["content"] else "KHAC"


def test_classification_and_diacritics(spark):
    df = spark.createDataFrame([("phân số?", ["Toán", "Vật lí"]), ("chào", ["Toán"]), ("chào", [])], "question string, subjects array<string>")
    assert [r["detected"] for r in ge.classify_subject(df, Classifier).collect()] == ["Toán", fv.NOT_SUBJECT_SPECIFIC, None]
    assert [r["question"] for r in ge.restore_diacritics(df).collect()] == ["phân số?", "chào", "chào"]
    assert [r["question"] for r in ge.restore_diacritics(df, Silent).collect()] == ["phân số?", "chào", "chào"]


def test_verdicts(spark):
    kind = "array<struct<subject:string,grade:int,page_start:int,page_end:int,citation:string>>"
    ok = [("Toán", 6, 12, 12, "T, trang 12")]
    rows = [
        ("pass", True, ["ước"], "Ước ở trang 12", ok), ("refuse", True, [], fv.NO_CONTEXT_ANSWER, ok), ("page", True, [], "trang 87", ok),
        ("range", True, [], "trang 12-13", ok), ("human", True, ["bội"], "trang 12", ok), ("out-ok", False, [], "không tìm thấy nội dung", []),
        ("out-bad", False, [], "là 4", []), ("error", True, [], fv.RATE_LIMIT_ANSWER, []), ("scope", True, [], "ok", [("Sử", 6, 1, 1, "S")]),
        ("high", True, [], "ok", [("Toán", 9, 1, 1, "T")]), ("low", True, [], "ok", [("Toán", 1, 1, 1, "T")]),
    ]
    df = spark.createDataFrame(rows, f"question string, in_textbook boolean, keywords array<string>, answer string, passages {kind}")
    scored = ev.with_verdict(ev.score(df.withColumn("grade", F.lit(6)).withColumn("subject", F.lit("Toán"))))
    got = {r["question"]: (r["verdict"], r["handled_correctly"], r["in_scope"]) for r in scored.collect()}
    assert got["pass"] == (fv.VERDICT_PASS, True, True) and got["refuse"] == (fv.VERDICT_WRONG_REFUSAL, False, True)
    assert got["page"][0] == got["range"][0] == fv.VERDICT_WRONG_PAGE and got["human"][0] == fv.VERDICT_HUMAN
    assert got["out-ok"] == (fv.VERDICT_REFUSED_RIGHTLY, True, True) and got["out-bad"] == (fv.VERDICT_HALLUCINATION, False, True)
    assert got["error"] == (fv.VERDICT_ERROR, False, True)
    assert not got["scope"][2] and not got["high"][2] and got["low"][2]
    r = ev.report(scored).first()
    assert (r["questions"], r["in_textbook"], r["provider_errors"], r["in_book_asked"], r["wrong_refusals"], r["hallucinations"], r["needs_human_review"]) == (11, 9, 1, 8, 1, 1, 1)


def test_sessions(spark):
    rows = [("u", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(20)] + [("v", 0, "user", "x")]
    df = spark.createDataFrame(rows, "user_id string, seq bigint, role string, content string")
    got = {r["user_id"]: [m["content"] for m in r["history"]] for r in ss.history(df, ["user_id"], "seq", "role", "content", 12).collect()}
    assert got == {"u": [f"m{i}" for i in range(8, 20)], "v": ["x"]}
    stored = spark.createDataFrame([("c", "a", 6, "Toán"), ("c", "b", 7, None)], "channel string, user_id string, grade int, subject string")
    changes = spark.createDataFrame([("c", "a", 8, "Toán", False, 1), ("c", "a", 9, None, False, 2), ("c", "b", None, None, True, 3), ("d", "a", 1, None, False, 4)], "channel string, user_id string, grade int, subject string, reset boolean, seq int")
    saved = {tuple(r) for r in ss.save_profiles(stored, changes, ["seq"]).collect()}
    assert saved == {("c", "a", 9, None), ("d", "a", 1, None)}


def test_streamed_scope(spark, tmp_path):
    schema = "channel string, user_id string, seq bigint, grade int, subject string, role string, content string, answer_id bigint, clear boolean"
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def arrive(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        names = [c.split()[0] for c in schema.split(", ")]
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        stream = spark.readStream.schema(schema).json(inbox)
        run_to_table(track_scope(stream, 3), out, checkpoint)

    arrive("1.json", [("c", "u", 1, 6, None, None, None, None), ("c", "u", 2, None, None, "user", "a", 10), ("d", "u", 1, None, None, "user", "z", None)])
    arrive("2.json", [("c", "u", 3 + i, None, None, "user", f"b{i}", None) for i in range(4)])
    arrive("3.json", [("c", "u", 9, 6, None, None, None, None), ("c", "u", 10, None, "Toán", None, None, None), ("c", "u", 11, None, None, "user", "mới", 12)])
    arrive("4.json", [("c", "u", 12, None, None, None, None, None, True), ("c", "u", 13, None, None, "user", "sau", None)])
    states = spark.read.parquet(out).orderBy("batch_id").where("channel = 'c'").collect()
    assert [(r["grade"], r["subject"], r["last_answer_id"], list(r["contents"])) for r in states] == [
        (6, None, 10, ["a"]), (6, None, 10, ["b1", "b2", "b3"]), (6, "Toán", 12, ["mới"]), (6, "Toán", None, ["sau"]),
    ]


def test_streamed_scope_keeps_the_order_of_messages(spark, tmp_path):
    schema = "channel string, user_id string, seq bigint, grade int, subject string, role string, content string, answer_id bigint, clear boolean"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for name, seqs in (("1.json", [5, 6, 1, 2, 3, 4]), ("2.json", [0, 7])):
            rows = [{"channel": "c", "user_id": "u", "seq": i, "role": "user", "content": f"m{i}", "grade": 6 if i else 9} for i in seqs]
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))
            stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
            run_to_table(track_scope(stream, 3), str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    states = spark.read.parquet(str(tmp_path / "out")).orderBy("batch_id").collect()
    assert [(r["grade"], list(r["contents"])) for r in states] == [(6, ["m4", "m5", "m6"]), (6, ["m5", "m6", "m7"])]


def test_streamed_scope_takes_late_messages_of_later_batches(spark, tmp_path):
    schema = "channel string, user_id string, seq bigint, grade int, subject string, role string, content string, answer_id bigint, clear boolean"
    batches = [
        ([(5, {}), (6, {"grade": 6, "answer_id": 60})], (6, 60, ["m6"])),
        # An older setting of the same grade moves the change of scope back.
        ([(1, {}), (2, {"grade": 6})], (6, 60, ["m2", "m5", "m6"])),
        ([(3, {}), (4, {})], (6, 60, ["m4", "m5", "m6"])),
        ([(5.5, {"clear": True, "content": None})], (6, 60, ["m6"])),
        ([(7, {"grade": 9})], (9, None, ["m7"])),
        ([(6.5, {"answer_id": 65})], (9, None, ["m7"])),
    ]
    for number, (rows, wanted) in enumerate(batches):
        base = {"channel": "c", "user_id": "u", "role": "user"}
        lines = [{**base, "seq": int(seq * 10), "content": f"m{seq}", **more} for seq, more in rows]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(map(json.dumps, lines)))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        run_to_table(track_scope(stream, 3), str(tmp_path / "out"), str(tmp_path / "cp"))
        (row,) = latest_states(spark, str(tmp_path / "out"), ["channel", "user_id"]).collect()
        assert (row["grade"], row["last_answer_id"], list(row["contents"])) == wanted, number


def test_newest_settings_add_up_in_any_order(monkeypatch):
    rng = random.Random(2)
    for _ in range(200):
        events = [(s, rng.choice("ab")) for s in range(12)]
        wanted = max((i for i in range(12) if i == 0 or events[i][1] != events[i - 1][1]), default=-1)
        rng.shuffle(events)
        known = _Latest([], [], None, -1)
        while events:
            some, events = events[:3], events[3:]
            known.add(*map(list, zip(*some)))
            known = _Latest(*known.row())
        assert known.changed() == wanted
    monkeypatch.setattr(_Latest, "ROOM", 4)
    known = _Latest([], [], None, -1)
    known.add(list(range(20)), ["a"] * 17 + ["b"] * 3)
    assert known.row() == ([16, 17, 18, 19], ["a", "b", "b", "b"], "a", 15) and known.changed() == 17
    known.add([3], ["c"])
    assert known.value() == "b" and known.changed() == 17


def test_settings(monkeypatch):
    assert Settings().history_messages == 12
    for bad in ({"top_k": 0}, {"top_k": 21}, {"chunk_size": 300, "chunk_overlap": 300}, {"max_distance": 0}, {"session_max_turns": 0}, {"chunk_size": 10}):
        with pytest.raises(ValueError):
            Settings(**bad)
    monkeypatch.setenv("PAGEWRIGHT_TOP_K", "5")
    assert Settings.from_env().top_k == 5


def test_routing(spark):
    texts = ["/lop 6", "/lop 99", "/mon toan", "/mon xyz", "/xoa", "/baosai #3 sai", "/chamdiem 5 4", "/chamdiem 9", "Phân số là gì?", " ", "/abc"]
    df = spark.createDataFrame([("c", "u", i, t, 7) for i, t in enumerate(texts)], "channel string, user_id string, seq bigint, text string, last_answer_id bigint")
    got = {r["text"]: r for r in route(df).collect()}
    assert (got["/lop 6"]["action"], got["/lop 6"]["grade"], got["/lop 6"]["valid"]) == ("set_grade", 6, True)
    assert got["/lop 99"]["grade"] is None and not got["/lop 99"]["valid"]
    assert got["/mon toan"]["subject"] == "Toán" and not got["/mon xyz"]["valid"] and got["/mon xyz"]["subject"] is None
    assert got["/xoa"]["clear"] and not got["/lop 6"]["clear"]
    assert tuple(got["/baosai #3 sai"]["report"]) == (3, "sai") and tuple(got["/chamdiem 5 4"]["rating"]) == (7, 5, 4, None)
    assert not got["/chamdiem 9"]["valid"] and got["/abc"]["action"] == "unknown"
    assert (got["Phân số là gì?"]["action"], got["Phân số là gì?"]["question"], got[" "]["valid"]) == ("question", "Phân số là gì?", False)


def test_channels(spark):
    raw = spark.createDataFrame([("u", "hi", False), ("bot", "spam", True), ("v", "  ", False)], "user_id string, text string, is_bot boolean")
    assert [r["user_id"] for r in incoming(raw, "discord").collect()] == ["u"]
    body = '{"event_name":"user_send_text","sender":{"id":"u1"},"message":{"text":"chào"}}'
    good = hmac.new(b"s", body.encode(), hashlib.sha256).hexdigest()
    deliveries = spark.createDataFrame([(body, good), (body, "bad"), ("{", None)], "body string, signature string")
    accepted, refused = webhook_deliveries(deliveries, "s")
    assert [(r["channel"], r["user_id"], r["text"]) for r in accepted.collect()] == [("zalo", "u1", "chào")] and refused.count() == 2
    replies = spark.createDataFrame([("u", "x" * 4500)], "user_id string, message string")
    assert [(r["piece"], len(r["text"])) for r in outgoing(replies, "discord").orderBy("piece").collect()] == [(0, 2000), (1, 2000), (2, 500)]


def test_subject_detection_and_benchmark(spark):
    chunks = spark.createDataFrame(
        [(1, "Phân số là số dạng a/b. Câu sau.", 6, "Toán", "Toán 6", "a.pdf", 0, 13, 13, [1.0, 0.0]), (2, "Khởi nghĩa năm 938", 6, "Lịch sử", "Sử 6", "b.pdf", 0, 5, 5, [0.0, 1.0])],
        "chunk_id bigint, text string, grade int, subject string, book_title string, source_file string, chunk_index int, page_start int, page_end int, embedding array<float>",
    ).withColumn("passage", passage_key(F.col("source_file"), F.col("chunk_index"), F.col("text")))
    asked = spark.createDataFrame([("a", "phân số?", 6, [0.0, 1.0]), ("b", "chào", 6, [1.0, 0.0]), ("c", "điều gì xảy ra?", 6, [0.1, 0.9])], "qid string, question string, grade int, embedding array<float>")
    got = {r["qid"]: r["subject"] for r in detect_subjects(asked, chunks, Doubtful).collect()}
    assert got == {"a": "Toán", "b": fv.NOT_SUBJECT_SPECIFIC, "c": "Lịch sử"}
    questions = spark.createDataFrame(
        [("a", "Phân số là gì?", 6, "Toán", True, ["số"], [1.0, 0.0]), ("b", "Tích phân là gì?", 6, "Vật lí", False, [], [1.0, 0.0])],
        "qid string, question string, grade int, subject string, in_textbook boolean, keywords array<string>, embedding array<float>",
    )
    offsets = spark.createDataFrame([("a.pdf", 1)], "source_file string, offset int")
    outcomes, totals = run_benchmark(questions, chunks, offsets)
    assert {r["qid"]: r["verdict"] for r in outcomes.collect()} == {"a": fv.VERDICT_PASS, "b": fv.VERDICT_REFUSED_RIGHTLY}
    row = totals.first()
    assert (row["answered"], row["refused_rightly"], row["answers_citing_a_page"], row["invented_citations"]) == (1, 1, 1, 0)


class Doubtful:
    def complete(self, model, messages, settings):
        text = messages[-1]["content"]
        return "Toán" if "phân số" in text else "KHAC" if "chào" in text else "không rõ"


def test_streamed_scope_of_many_sessions_in_few_groups(spark, tmp_path):
    schema = "channel string, user_id string, seq bigint, grade int, subject string, role string, content string, answer_id bigint, clear boolean"
    rng = random.Random(5)
    rows = []
    for user in range(30):
        for seq in range(rng.randint(1, 9)):
            kind = rng.choice(["grade", "subject", "clear", "content", "content", "answer_id"])
            value = {"grade": rng.choice([6, 7]), "subject": "Toán", "clear": True, "content": f"m{seq}", "answer_id": seq}[kind]
            rows.append({"channel": "cd"[user % 2], "user_id": str(user // 2), "seq": seq, "role": "user", kind: value})
    rng.shuffle(rows)
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(map(json.dumps, rows[part::3])))

    def states(groups):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = str(tmp_path / f"out{groups}")
        run_to_table(track_scope(stream, 3, groups), out, str(tmp_path / f"cp{groups}"))
        return sorted(map(str, latest_states(spark, out, ["channel", "user_id"]).collect()))

    assert states(1) == states(3) == states(1_000) and len(states(2)) == 30
