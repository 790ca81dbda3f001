"""Queries over conversation state."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import generation as ge
from pagewright.operators import sessions as ss
from pagewright.plans.materialize import scratch_path
from pagewright.registry.common import query, table
from pagewright.streaming.sessions import files_per_batch, latest_states, message_stream, run_to_table, track_history, track_scope

#: Messages kept per session; conversations have up to eight.
_KEEP = 4

_SQL_HISTORY = f"""
    kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
    placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM kept WHERE n <= {_KEEP})
"""


@query(f"WITH {_SQL_HISTORY} SELECT conv_id, position, turn, role, text FROM placed")
def session_history(spark, sf_dir):
    """The last messages of every session."""
    kept = ss.last_messages(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", _KEEP)
    return kept.select("conv_id", "position", "turn", "role", "text")


@query(f"WITH {_SQL_HISTORY} SELECT conv_id, position, turn, role, text FROM placed")
def stream_sessions(spark, sf_dir):
    """The same, from a file stream with keyed state; the last state of each session counts."""
    name = "conversations.parquet"
    stored = table(spark, sf_dir, "conversations")
    # A table may be one file of that name, or a folder of part files.
    one_file = all(file.endswith(f"/{name}") for file in stored.inputFiles())
    folder, pattern = (sf_dir, name) if one_file else (f"{sf_dir.rstrip('/')}/{name}", "*.parquet")
    messages = message_stream(spark, folder, stored.schema, pattern)
    out, checkpoint = scratch_path(spark, "sessions"), scratch_path(spark, "sessions-checkpoint")
    run_to_table(track_history(messages, "conv_id", "turn", "role", "text", _KEEP), out, checkpoint)
    states = spark.read.parquet(out).groupBy("conv_id").agg(
        F.max_by(F.struct("seqs", "roles", "contents"), "batch_id").alias("s")
    )
    rows = F.arrays_zip(F.col("s.seqs").alias("turn"), F.col("s.roles").alias("role"), F.col("s.contents").alias("text"))
    return states.select("conv_id", F.posexplode(rows).alias("__p", "m")).select(
        "conv_id", (F.col("__p") + 1).alias("position"), "m.turn", "m.role", "m.text"
    )


@query(
    f"""
    WITH said AS (
        SELECT user_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN event_id % 3 + 6 END AS grade,
               CASE WHEN event_type = 'purchase' THEN 's' || (event_id % 2) END AS subject, event_type = 'error' AS clear,
               CASE WHEN event_type IN ('click', 'view') THEN event_type || ' ' || event_id END AS content,
               CASE WHEN event_type = 'view' THEN event_id END AS answer_id FROM events),
    grades AS (SELECT *, grade IS DISTINCT FROM lag(grade) OVER (PARTITION BY user_id ORDER BY seq) AS moved FROM said WHERE grade IS NOT NULL),
    subjects AS (SELECT *, subject IS DISTINCT FROM lag(subject) OVER (PARTITION BY user_id ORDER BY seq) AS moved FROM said WHERE subject IS NOT NULL),
    since AS (
        SELECT user_id, max(seq) AS since FROM (
            SELECT user_id, seq FROM grades WHERE moved UNION ALL SELECT user_id, seq FROM subjects WHERE moved
            UNION ALL SELECT user_id, seq FROM said WHERE clear) GROUP BY user_id),
    kept AS (
        SELECT user_id, seq, content FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS n FROM said WHERE content IS NOT NULL)
        WHERE n <= {_KEEP})
    SELECT s.user_id::VARCHAR AS user_id, (SELECT arg_max(grade, seq) FROM grades g WHERE g.user_id = s.user_id)::INTEGER AS grade,
           (SELECT arg_max(subject, seq) FROM subjects g WHERE g.user_id = s.user_id) AS subject,
           (SELECT CASE WHEN max(a.seq) >= coalesce(any_value(since), 0) THEN arg_max(a.answer_id, a.seq) END
            FROM said a WHERE a.user_id = s.user_id AND a.answer_id IS NOT NULL) AS last_answer_id,
           coalesce((SELECT string_agg(content, '; ' ORDER BY seq) FROM kept k WHERE k.user_id = s.user_id AND k.seq >= coalesce(since, 0)), '') AS history
    FROM (SELECT DISTINCT user_id FROM events) s LEFT JOIN since USING (user_id) GROUP BY s.user_id, since
    """
)
def stream_scope(spark, sf_dir):
    """Profile, history and last answer of every user, from a stream whose messages come in any order."""
    kind, number = F.col("event_type"), F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.lit("chat").alias("channel"),
        F.col("user_id").cast("string").alias("user_id"),
        number.alias("seq"),
        F.when(kind == "signup", number % 3 + 6).cast("int").alias("grade"),
        F.when(kind == "purchase", F.concat(F.lit("s"), (number % 2).cast("string"))).alias("subject"),
        (kind == "error").alias("clear"),
        F.lit("user").alias("role"),
        F.when(kind.isin("click", "view"), F.concat_ws(" ", kind, number.cast("string"))).alias("content"),
        F.when(kind == "view", number).alias("answer_id"),
    )
    inbox, out, checkpoint = (scratch_path(spark, f"scope-{n}") for n in ("inbox", "states", "checkpoint"))
    # Three micro-batches of as many files as all slots write; their messages are drawn from the whole time.
    events.repartition(max(3, spark.sparkContext.defaultParallelism), "seq").write.parquet(inbox)
    files = files_per_batch(spark, inbox, 3)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(inbox)
    run_to_table(track_scope(stream, _KEEP), out, checkpoint)
    states = latest_states(spark, out, ["channel", "user_id"])
    return states.select("user_id", "grade", "subject", "last_answer_id", F.array_join("contents", "; ").alias("history"))


@query(
    """
    WITH changed AS (
        SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS c FROM events),
    epochs AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM changed)
    SELECT event_id, user_id, epoch FROM epochs
    """
)
def session_epochs(spark, sf_dir):
    """History epochs: a new one starts whenever the scope (here the event type) changes."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ss.scope_epochs(events, ["user_id"], "event_id", F.col("event_type")).select("event_id", "user_id", "epoch")


@query(
    """
    WITH changed AS (
        SELECT *, CASE WHEN user_id % 3 <> 0 AND event_type = 'signup' THEN 1 ELSE 0 END AS c FROM events),
    epochs AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM changed),
    kept AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY event_id DESC) AS n,
                    max(epoch) OVER (PARTITION BY user_id) AS newest FROM epochs)
    SELECT user_id, event_id FROM kept WHERE n <= 12 AND epoch = newest
    """
)
def current_history(spark, sf_dir):
    """What each user's history holds at the end: twelve messages at most, none from before the last scope change."""
    from pyspark.sql import Window

    from pagewright.plans.ordered import prefix_sum

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    change = ((F.col("user_id") % 3 != 0) & (F.col("event_type") == "signup")).cast("bigint")
    rows = prefix_sum(events, ["user_id"], "event_id", change, "before").withColumn("epoch", F.col("before") + change)
    # The newest epoch holds the newest messages, so twelve per user are enough before it is picked.
    kept = ss.last_messages(rows, ["user_id"], "event_id", 12)
    newest = F.max("epoch").over(Window.partitionBy("user_id"))
    return kept.withColumn("newest", newest).where(F.col("epoch") == F.col("newest")).select("user_id", "event_id")


@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
           OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_answer_id FROM events"""
)
def last_answer(spark, sf_dir):
    """The answer a bare report would refer to at each point of a conversation."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return ss.last_answer(events, ["user_id"], "event_id", view).select("event_id", "last_answer_id")


@query(
    """
    WITH newest AS (SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) AS e FROM events WHERE event_type <> 'view' GROUP BY user_id)
    SELECT 'chat' AS channel, u.c_custkey AS user_id, CASE WHEN n.e IS NULL THEN c_custkey % 12 + 1 ELSE e % 12 + 1 END AS grade,
           CASE WHEN n.e IS NULL THEN c_mktsegment ELSE kind END AS subject
    FROM customer u LEFT JOIN newest n ON n.user_id = u.c_custkey WHERE kind IS NULL OR kind <> 'error'
    UNION ALL SELECT 'chat', user_id, e % 12 + 1, kind FROM newest WHERE kind <> 'error' AND user_id NOT IN (SELECT c_custkey FROM customer)
    """
)
def profiles(spark, sf_dir):
    """Stored profiles (customers) after the changes and resets (errors) in the event log."""
    stored = table(spark, sf_dir, "customer").select(
        F.lit("chat").alias("channel"), F.col("c_custkey").alias("user_id"),
        (F.col("c_custkey") % 12 + 1).cast("int").alias("grade"), F.col("c_mktsegment").alias("subject"),
    )
    changes = table(spark, sf_dir, "events").where("event_type <> 'view'").select(
        F.lit("chat").alias("channel"), "user_id", (F.col("event_id") % 12 + 1).cast("int").alias("grade"),
        F.col("event_type").alias("subject"), (F.col("event_type") == "error").alias("reset"), "event_id",
    )
    return ss.save_profiles(stored, changes, ["event_id"])


@query(
    f"""
    WITH {_SQL_HISTORY},
    asked AS (SELECT conv_id, arg_max(text, turn) AS question FROM conversations GROUP BY conv_id),
    past AS (SELECT conv_id, string_agg(role || ':' || md5(text), ' ' ORDER BY position) AS past, count(*) AS n FROM placed GROUP BY conv_id)
    SELECT conv_id, n + 2 AS messages, past,
           md5('[Đoạn 1] (Nguồn: Sách ' || conv_id || ', trang 1)' || chr(10) || question) AS context
    FROM asked JOIN past USING (conv_id)
    """
)
def prompt_messages(spark, sf_dir):
    """System message, history and question with its context for every session."""
    conversations = table(spark, sf_dir, "conversations")
    past = ss.history(conversations, ["conv_id"], "turn", "role", "text", _KEEP)
    asked = conversations.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    passages = F.array(
        F.struct(F.concat(F.lit("Sách "), "conv_id", F.lit(", trang 1")).alias("citation"), F.col("question").alias("text"))
    )
    rows = asked.join(past, "conv_id").withColumn("passages", passages)
    messages = ge.build_messages(F.col("question"), F.lit(6), F.lit("Toán"), F.col("passages"), F.col("history"))
    shown = rows.withColumn("m", messages)
    middle = F.slice("m", F.lit(2), F.size("m") - 2)
    return shown.select(
        "conv_id",
        F.size("m").cast("bigint").alias("messages"),
        F.array_join(F.transform(middle, lambda x: F.concat_ws(":", x["role"], F.md5(x["content"]))), " ").alias("past"),
        F.md5(ge.context_block(F.col("passages"))).alias("context"),
    )
