import hashlib
import hmac

from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import answers as an
from pagewright.functions import audit as au
from pagewright.functions import messages as ms
from pagewright.functions import webhook as wh


def test_refusals(evaluate):
    refusals = [
        "Mình chưa tìm thấy thông tin này trong sách giáo khoa của bạn.",
        "Mình KHÔNG TÌM THẤY nội dung đó.",
        "Phần này không có trong sách giáo khoa.",
        "Câu hỏi ngoài phạm vi lớp 6.",
        "Nội dung không thuộc chương trình.",
        fv.NO_CONTEXT_ANSWER,
    ]
    answers = ["Theo sách Toán 6, trang 79: phân số là...", "Trang 12 nói về quang hợp."]
    assert evaluate(an.looks_like_refusal, refusals + answers) == [True] * 6 + [False] * 2
    assert evaluate(an.grounded, ["Sách không tìm thấy phần này", "không tìm thấy phần này, nhưng trang 30 có"]) == [False, True]
    assert evaluate(an.is_provider_error, [fv.RATE_LIMIT_ANSWER + " ", "x"]) == [True, False]


def test_pages(evaluate):
    assert evaluate(an.pages_named, ["trang 79, Trang 12-14", "trang 9-3", "trang 5 – 99", "không"]) == [
        [12, 13, 14, 79], [9], [5], [],
    ]
    assert evaluate(an.invented_pages, [("trang 87 và trang 12-13", [12])], "string; array<int>") == [[13, 87]]
    assert evaluate(an.keywords_found, [("Có Ước chung", ["ước", "bội"])], "string; array<string>") == [["ước"]]


def test_wording(evaluate):
    got = evaluate(
        an.hide_internal_wording,
        ["[Đoạn 1] Xem đoạn 2 trong ngữ cảnh nhé", "Nhìn vào **Đoạn 1** và **Đoạn 2** nhé", "**Đoạn 1** và **Đoạn 2** nói rõ",
         "Ngữ cảnh được cung cấp", "Xong.\n- Đoạn 1, đoạn 3 hoặc Đoạn 2"],
    )
    assert got == ["Xem đoạn này trong sách nhé", "Nhìn vào những đoạn dưới đây nhé", "Những đoạn dưới đây nói rõ", "Sách",
                   "Xong.\n- Những đoạn dưới đây"]


def test_invented_references(evaluate):
    rows = [
        ("Phân số ở trang 9 rất hay và dễ nhớ.", [12]),
        ("Phân số ở trang 12 rất hay.", [12]),
        ("Câu một hay. Xem thêm trang 900 nhé.\n\n- mục", [12]),
        ("Theo sách Toán 6, trang 71: đúng.", [12]),
        ("Xem ở **trang 7** và ở trang 71 cũng có nói.", [71]),
    ]
    got = evaluate(an.drop_invented_page_refs, rows, "string; array<int>")
    assert got == [
        "Phân số rất hay và dễ nhớ.", "Phân số ở trang 12 rất hay.", "Câu một hay.\n\n- mục",
        "Theo sách Toán 6, trang 71: đúng.", " và ở trang 71 cũng có nói.",
    ]
    polished = evaluate(an.polish_answer, [("Xem thêm trang 900 nhé.", [1]), ("x^2 ở đoạn 1", [1])], "string; array<int>")
    assert polished == ["Xem thêm trang 900 nhé.", "x² ở đoạn này"]


def test_exponents(evaluate):
    got = evaluate(an.render_exponents, ["x^2 + 2xy + y^2", "B ^ 2", "10^-3 m", "a^(n+1)", "none"])
    assert got == ["x² + 2xy + y²", "B²", "10⁻³ m", "a^(n+1)", "none"]


def test_subject_match(evaluate):
    names = ["Toán", "Lịch sử", "Khoa học", "Khoa học tự nhiên"]
    rows = [(t, names) for t in ["toan", "Môn học là: Lịch sử.", "Toán hoặc Lịch sử", "", "Khoa học tự nhiên", " khac "]]
    got = evaluate(an.parse_classification, rows, "string; array<string>")
    assert got == ["Toán", "Lịch sử", None, None, None, fv.NOT_SUBJECT_SPECIFIC]


def test_same_book_and_reminder(evaluate):
    rows = [(["A, trang 1", "B, trang 2", "A, trang 1", " ", "A, trang 3", "A, trang 9"],), ([],)]
    assert evaluate(an.same_book_as_best, rows, "array<string>") == [["A, trang 1", "A, trang 3"], []]
    shown = evaluate(an.page_check_reminder, rows, "array<string>")
    assert "A, trang 1; A, trang 3" in shown[0] and shown[1] == ""


def test_commands(evaluate):
    got = evaluate(ms.parse_command, ["/lop 6", "/LOP 6", "/lop@AnyBot 6", "/ lop 8", "/trogiup", "xin chào", "", "/ "])
    assert [(g["command"], g["argument"]) if g else None for g in got] == [
        ("lop", "6"), ("lop", "6"), ("lop", "6"), ("lop", "8"), ("trogiup", ""), None, None, None,
    ]
    assert evaluate(ms.command_action, ["lop", "nope", None]) == ["set_grade", "unknown", "question"]


def test_report_and_rating(evaluate):
    reports = evaluate(ms.parse_report, [("#12 công thức  sai", 7), ("12", 7), ("câu này sai rồi", 7), ("", None)], "string; bigint")
    assert [tuple(r) for r in reports] == [(12, "công thức sai"), (12, None), (7, "câu này sai rồi"), (None, None)]
    ratings = evaluate(ms.parse_rating, [("5 4", 7), ("5", 7), ("5 4 hơi dài", 7), ("#12 5 4", 7), ("hay", 7), ("5 4 3", None)], "string; bigint")
    assert [tuple(r) for r in ratings] == [
        (7, 5, 4, None), (7, 5, None, None), (7, 5, 4, "hơi dài"), (12, 5, 4, None), (7, None, None, "hay"), (None, 5, 4, "3"),
    ]


def test_split_message(evaluate):
    long_lines = "\n".join(["a" * 30] * 10)
    texts = ["short", long_lines, "b" * 250, "w " * 120, ""]
    got = evaluate(lambda c: ms.split_message(c, 100), texts)
    assert got[0] == ["short"] and got[4] == [""]
    assert all(len(p) <= 100 for pieces in got for p in pieces)
    assert "\n".join(got[1]) == long_lines and "".join(got[2]) == texts[2]


def test_webhook(evaluate):
    body = '{"event_name":"user_send_text","sender":{"id":"u1"},"message":{"text":"hi"},"x":1}'
    good = hmac.new(b"secret", body.encode(), hashlib.sha256).hexdigest()
    rows = [(body, good), (body + " ", good), (body, None), (body, "")]
    assert evaluate(lambda b, s: wh.signature_ok(b, s, "secret"), rows, "string; string") == [True, False, False, False]
    assert evaluate(lambda b, s: wh.signature_ok(b, s, "other"), rows[:1], "string; string") == [False]
    events = [body, "not json", '{"event_name":"user_send_image","sender":{"id":"u"}}', '{"event_name":"user_send_text","sender":{"id":""}}']
    assert evaluate(lambda b: wh.is_text_message(wh.parse_event(b)), events) == [True, False, False, False]


def test_scan_page(evaluate):
    pad = " lorem ipsum dolor" * 10
    pages = [
        "Ta có a - b = b - a và c-d=d-c." + pad,
        "ta gọi = là một phân số" + pad,
        "Tổng quát, ta có định nghĩa: Nhận xét" + pad,
        "A? ~B? + C* = D" + pad,
        "s6 m0t l1 H2 CO2 s6tu t0an v1et" + pad,
        "§¶" * 40 + pad,
        "a - b = b - a",
        "clean" + pad,
    ]
    got = evaluate(au.scan_page, pages)
    kinds = [[i["kind"] for i in g] for g in got]
    assert kinds == [
        [fv.KIND_SWAPPED_MINUS] * 2, [fv.KIND_FRACTION], [fv.KIND_DEFINITION_BOX], [fv.KIND_LOST_EXPONENT],
        [fv.KIND_DIGIT_WORD], [fv.KIND_GARBLED], [], [],
    ]
    assert got[0][0]["snippet"].startswith("Ta có a - b = b - a")
    assert got[4][0]["snippet"] == "m0t, CO2, s6tu, t0an, v1et"


def test_references_of_a_sentence_are_looked_for_once(spark, evaluate):
    answer = an.drop_invented_page_refs(F.col("t"), F.array(F.lit(3)))
    plan = spark.createDataFrame([("x",)], "t string").select(answer.alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(fv.PASSING_PAGE_REFERENCE[:40]) == 1
    texts = [
        "Em đọc kĩ phần này ở trang 3 nhé.  Các bạn xem lại cả bài xem thêm trang 9 nhé.",
        "Trang 5 có hình.   Hai dấu cách.", "Câu một ở trang 7. Câu hai rất dài đó bạn.\nXem trang 8.\ntrang đầu  có hai. Ý!", "",
    ]
    assert evaluate(lambda c: an.drop_invented_page_refs(c, F.array(F.lit(3))), texts) == [
        "Em đọc kĩ phần này ở trang 3 nhé. Các bạn xem lại cả bài nhé.", texts[1], "Câu hai rất dài đó bạn.\n\ntrang đầu  có hai. Ý!", "",
    ]
