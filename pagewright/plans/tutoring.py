"""From messages to replies and their effects, for all sessions of a batch at once.

Every message has an effect: a command sets grade or subject, empties the
history, reports or rates an answer, asks for the profile or the summary; any
other text is a question.  What a message sees is worked out as running values
over its session: the last grade and subject set before it (the stored profile
where none was), the last answer since the last change of scope.  Questions of
all sessions are answered together, by one retrieval and one pass through the
service.  Effects come out as rows, which the functions below turn into changes
of the profile table, the answer log, the reports and the ratings.

Questions of one batch do not see each other's answers as history; the history
given is that from before the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import answers as an
from pagewright.functions import messages as ms
from pagewright.functions import text as tx
from pagewright.operators import feedback as fb
from pagewright.operators.embedding import embed
from pagewright.operators.generation import (
    AnswerClient,
    OfflineClient,
    RateLimited,
    ServiceError,
    restore_diacritics,
)
from pagewright.operators.retrieval import list_subjects
from pagewright.operators.sessions import save_profiles
from pagewright.plans.answering import answer_questions, detect_subjects
from pagewright.plans.materialize import materialize
from pagewright.plans.ordered import last_known, prefix_sum
from pagewright.settings import Settings

KEYS = ["channel", "user_id"]

WELCOME = (
    "Chào bạn! Mình là gia sư trả lời theo sách giáo khoa. "
    "Bạn cho mình biết lớp bằng /lop, ví dụ /lop 6, rồi hỏi nhé."
)
HELP = (
    "Các lệnh: /lop chọn lớp, /mon chọn môn, /toi xem lựa chọn, /baosai báo câu sai, "
    "/chamdiem chấm điểm 1-5, /xoa xoá lịch sử."
)
NO_GRADE = "Bạn cho mình biết lớp trước nhé, ví dụ: /lop 6"
NO_SUBJECT = "Mình chưa rõ bạn hỏi môn nào. Bạn chọn môn bằng /mon nhé, ví dụ: /mon Toán"
EMPTY_QUESTION = "Bạn nhắn câu hỏi cho mình nhé!"
GRADE_USAGE = "Lớp là một số từ 1 đến 12, ví dụ: /lop 8"
SUBJECT_USAGE = "Mình chưa có môn này trong sách. Bạn nhập tên môn, ví dụ: /mon Ngữ văn"
CLEARED = "Mình đã xoá lịch sử trò chuyện. Bạn hỏi tiếp nhé!"
NOTHING_TO_REPORT = "Chưa có câu trả lời nào để báo hoặc chấm. Bạn hỏi một câu trước nhé!"
UNKNOWN_ANSWER = "Mình không tìm thấy câu trả lời đó nữa."
RATING_USAGE = "Bạn chấm từ 1 đến 5, ví dụ: /chamdiem 5 4"
RATING_THANKS = "Cảm ơn bạn đã chấm điểm!"
NOT_ADMITTED = "Phần này chỉ dành cho người phụ trách."
PRIVATE_ONLY = "Phản hồi có tên người báo nên mình chỉ gửi trong tin nhắn riêng."


class Guarded:
    """A client whose unforeseen failures end one question, not the batch."""

    def __init__(self, make_client: Callable[[], AnswerClient]) -> None:
        self.client = make_client()

    def complete(self, model: str, messages: list[dict], settings: Settings) -> str:
        try:
            return self.client.complete(model, messages, settings)
        except (RateLimited, ServiceError):
            raise
        except Exception as failure:
            raise ServiceError(str(failure)) from failure


def _optional(messages: DataFrame) -> DataFrame:
    defaults = {"display_name": F.lit(None).cast("string"), "is_private": F.lit(False)}
    return messages.withColumns({n: c for n, c in defaults.items() if n not in messages.columns})


def with_scope(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with action, argument, grade and subject after them, and epoch: changes of scope so far."""
    parsed = (
        _optional(messages)
        .withColumn("__c", ms.parse_command(F.col("text")))
        .withColumn("action", ms.command_action(F.col("__c.command")))
        .withColumn("command", F.col("__c.command"))
        .withColumn("argument", F.coalesce("__c.argument", F.lit("")))
        .drop("__c")
    )
    named = tx.normalize_subject(F.col("argument"))
    sets_grade = F.when(F.col("action") == "set_grade", tx.validate_grade(F.col("argument")))
    sets_subject = F.when((F.col("action") == "set_subject") & tx.is_known_subject(named), named)
    start = sessions.select(
        *KEYS, F.col("grade").alias("__grade"), F.col("subject").alias("__subject"),
        F.col("last_answer_id").alias("__answer"),
    )
    rows = parsed.withColumns({"sets_grade": sets_grade, "sets_subject": sets_subject}).join(start, KEYS, "left")
    rows = last_known(rows, KEYS, "arrival", F.col("sets_grade"), "__g", include_current=False)
    rows = last_known(rows, KEYS, "arrival", F.col("sets_subject"), "__s", include_current=False)
    before = {"__g": F.coalesce("__g", "__grade"), "__s": F.coalesce("__s", "__subject")}
    rows = rows.withColumns(before)
    moved = (
        (F.col("sets_grade").isNotNull() & ~F.col("sets_grade").eqNullSafe(F.col("__g")))
        | (F.col("sets_subject").isNotNull() & ~F.col("sets_subject").eqNullSafe(F.col("__s")))
        | (F.col("action") == "clear_history")
    )
    rows = rows.withColumn("__moved", moved.cast("bigint"))
    rows = prefix_sum(rows, KEYS, "arrival", F.col("__moved"), "__epoch")
    return rows.select(
        *messages.columns,
        *[c for c in ("display_name", "is_private") if c not in messages.columns],
        "action", "command", "argument", "sets_grade", "sets_subject",
        F.coalesce("sets_grade", "__g").alias("grade"),
        F.coalesce("sets_subject", "__s").alias("subject"),
        (F.col("__epoch") + F.col("__moved")).alias("epoch"),
        F.col("__answer").alias("earlier_answer_id"),
    )


def _answers(
    scoped: DataFrame, log: DataFrame, chunks: DataFrame, offsets: DataFrame, settings: Settings,
    make_client: Callable[[], AnswerClient], embedder: Callable[[Column], Column],
    restore: Callable[[], AnswerClient] | None, history: DataFrame | None,
) -> DataFrame:
    """arrival, asked_subject, and for answered questions answer_id, answer, grounded, citations and message."""
    client = lambda: Guarded(make_client)
    asked = scoped.where(
        (F.col("action") == "question") & ~tx.is_blank(F.col("text")) & F.col("grade").isNotNull()
    ).select(*KEYS, "arrival", F.col("arrival").cast("string").alias("qid"), tx.strip(F.col("text")).alias("question"), "grade", "subject")
    if history is not None:
        asked = asked.join(history.select(*KEYS, "history"), KEYS, "left")
    # Questions are rewritten once, before the embedder and the service read them.
    asked = materialize(restore_diacritics(asked, restore and (lambda: Guarded(restore)), settings), "questions")
    asked = asked.withColumn("embedding", embedder(F.col("question")))
    pinned = asked.where(F.col("subject").isNotNull())
    found = detect_subjects(asked.where(F.col("subject").isNull()).drop("subject"), chunks, client, settings)
    every = materialize(pinned.unionByName(found, allowMissingColumns=True), "asked")
    real = every.where(F.col("subject").isNotNull() & (F.col("subject") != fv.NOT_SUBJECT_SPECIFIC))
    answered = materialize(
        answer_questions(real, chunks, offsets, settings, client, "history" if history is not None else None),
        "answered",
    )
    numbered = fb.with_answer_ids(log, answered, "arrival").select(
        "arrival", "answer_id", "answer", "grounded", "citations", "message", "question"
    )
    return every.select("arrival", F.col("subject").alias("asked_subject")).join(numbered, "arrival", "left")


def tutor_turns(
    messages: DataFrame,
    sessions: DataFrame,
    log: DataFrame,
    chunks: DataFrame,
    offsets: DataFrame,
    settings: Settings = Settings(),
    make_client: Callable[[], AnswerClient] = OfflineClient,
    embedder: Callable[[Column], Column] = embed,
    restore: Callable[[], AnswerClient] | None = None,
    history: DataFrame | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Each message with its reply and effects, as a stored table.

    ``messages``: channel, user_id, arrival (a whole number, unique in the batch),
    text and optionally display_name, is_private.  ``sessions``: channel, user_id,
    grade, subject, last_answer_id, one row each.  ``log``: the answer log.
    ``history``: channel, user_id, history.  ``summary``: one row with ``text``.
    """
    scoped = materialize(with_scope(messages, sessions), "scoped")
    answers = _answers(scoped, log, chunks, offsets, settings, make_client, embedder, restore, history)
    rows = materialize(scoped.join(answers, "arrival", "left"), "turns-answered")
    rows = last_known(rows, [*KEYS, "epoch"], "arrival", F.col("answer_id"), "__last", include_current=False)
    last = F.coalesce("__last", F.when(F.col("epoch") == 0, F.col("earlier_answer_id")))
    rows = rows.withColumn("__last", last).withColumns(
        {
            "report": F.when(F.col("action") == "report", ms.parse_report(F.col("argument"), F.col("__last"))),
            "rating": F.when(F.col("action") == "rate", ms.parse_rating(F.col("argument"), F.col("__last"))),
        }
    )
    rows = rows.withColumn("about", F.coalesce("report.answer_id", "rating.answer_id"))
    # An answer of this batch exists for the messages behind it.
    cited = log.select(F.col("answer_id").alias("about"), F.lit(-1).cast("bigint").alias("__born"), tx.decode_lines(F.col("citations")).alias("__cited"))
    fresh = rows.where(F.col("answer_id").isNotNull()).select(
        F.col("answer_id").alias("about"), F.col("arrival").alias("__born"), F.col("citations").alias("__cited")
    )
    rows = rows.join(cited.unionByName(fresh), "about", "left")
    exists = F.col("__born").isNotNull() & (F.col("__born") < F.col("arrival"))
    in_range = ms.rating_in_range(F.col("rating.clarity")) & ms.rating_in_range(F.col("rating.guidance"))
    accepted = (
        F.when(F.col("action") == "report", exists)
        .when(F.col("action") == "rate", exists & F.col("rating.clarity").isNotNull() & in_range)
        .otherwise(F.lit(False))
    )
    rows = rows.withColumns({"accepted": accepted, "__exists": exists})
    offered = list_subjects(chunks, rows.where(F.col("grade").isNotNull())).groupBy("grade").agg(
        F.sort_array(F.collect_list("subject")).alias("__subjects")
    )
    rows = rows.join(offered, "grade", "left")
    admins = [a.strip() for a in settings.admin_user_ids.split(",") if a.strip()]
    admitted = F.col("user_id").cast("string").isin(admins) if admins else F.lit(False)
    text = (summary or log.sparkSession.createDataFrame([("",)], "text string")).select(
        F.lit("feedback_summary").alias("action"), F.col("text").alias("__summary")
    )
    rows = rows.join(text, "action", "left")
    return materialize(rows.withColumn("reply", _reply(admitted)), "turns").drop(
        "__last", "__born", "__cited", "__exists", "__subjects", "__summary", "about", "earlier_answer_id"
    )


def _reply(admitted: Column) -> Column:
    grade, subject = F.col("grade").cast("string"), F.col("subject")
    chosen = F.concat(F.lit("lớp "), grade, F.coalesce(F.concat(F.lit(", môn "), subject), F.lit("")))
    none = F.array().cast("array<string>")
    nothing = F.coalesce("report.answer_id", "rating.answer_id").isNull()
    by_action = {
        "welcome": F.lit(WELCOME),
        "help": F.lit(HELP),
        "set_grade": F.when(F.col("sets_grade").isNull(), GRADE_USAGE).otherwise(
            F.concat(F.lit("Đã chọn "), chosen, F.lit("."))
        ),
        "set_subject": F.when(F.col("sets_subject").isNull(), SUBJECT_USAGE)
        .when(F.col("grade").isNull(), F.concat(F.lit("Đã chọn môn "), subject, F.lit(". "), F.lit(NO_GRADE)))
        .otherwise(F.concat(F.lit("Đã chọn "), chosen, F.lit("."))),
        "show_scope": F.when(F.col("grade").isNull(), NO_GRADE).otherwise(
            F.concat(F.lit("Bạn đang học "), chosen, F.lit("."))
        ),
        "clear_history": F.lit(CLEARED),
        "report": F.when(nothing, NOTHING_TO_REPORT)
        .when(~F.col("__exists"), UNKNOWN_ANSWER)
        .otherwise(an.feedback_thanks(F.coalesce("__cited", none), F.col("report.note").isNotNull())),
        "rate": F.when(nothing, NOTHING_TO_REPORT)
        .when(~F.col("accepted") & F.col("__exists"), RATING_USAGE)
        .when(F.col("rating.clarity").isNull(), RATING_USAGE)
        .when(~F.col("accepted"), UNKNOWN_ANSWER)
        .otherwise(RATING_THANKS),
        "feedback_summary": F.when(~admitted, NOT_ADMITTED)
        .when(~F.coalesce("is_private", F.lit(False)), PRIVATE_ONLY)
        .otherwise(F.col("__summary")),
        "question": F.when(tx.is_blank(F.col("text")), EMPTY_QUESTION)
        .when(F.col("grade").isNull(), NO_GRADE)
        .when(
            F.col("asked_subject") == fv.NOT_SUBJECT_SPECIFIC,
            an.capability_message(F.col("grade"), F.coalesce("__subjects", none)),
        )
        .when(F.col("asked_subject").isNull(), NO_SUBJECT)
        .otherwise(F.col("message")),
    }
    reply = F.concat(F.lit("Mình chưa hiểu lệnh /"), F.col("command"), F.lit(". Bạn xem các lệnh bằng /trogiup nhé!"))
    for action, text in by_action.items():
        reply = F.when(F.col("action") == action, text).otherwise(reply)
    return reply


# ---- Effects ---------------------------------------------------------------------------


def changed_profiles(profiles: DataFrame, turns: DataFrame) -> DataFrame:
    """``profiles`` (channel, user_id, grade, subject) after the commands of a batch."""
    changes = turns.where(F.col("action").isin("set_grade", "set_subject")).select(
        *KEYS, "grade", "subject", "arrival", F.lit(False).alias("reset")
    )
    return save_profiles(profiles, changes, ["arrival"])


def logged_answers(turns: DataFrame) -> DataFrame:
    """The answers of a batch as rows of the answer log."""
    return turns.where(F.col("answer_id").isNotNull()).select(
        "answer_id", F.current_timestamp().alias("created_at"), "channel", "user_id", "display_name", "grade",
        F.col("asked_subject").alias("subject"), "question", "answer", tx.encode_lines(F.col("citations")).alias("citations"),
        F.col("grounded").cast("int").alias("grounded"),
    )


def accepted_reports(turns: DataFrame) -> DataFrame:
    """arrival, answer_id, reporter_id, reporter_name and note of the reports of a batch that count."""
    return turns.where(F.col("accepted") & (F.col("action") == "report")).select(
        "arrival", "report.answer_id", F.col("user_id").alias("reporter_id"),
        F.col("display_name").alias("reporter_name"), "report.note",
    )


def accepted_ratings(turns: DataFrame) -> DataFrame:
    """The newest rating that counts of each answer and person."""
    given = turns.where(F.col("accepted") & (F.col("action") == "rate")).select(
        "rating.answer_id", "user_id", "arrival", "rating.clarity", "rating.guidance", "rating.comment",
        F.col("display_name").alias("user_name"),
    )
    return fb.latest(given, ["answer_id", "user_id"], ["arrival"])
