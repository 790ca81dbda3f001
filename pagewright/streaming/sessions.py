"""Conversation state kept while messages stream in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import nlargest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = (
    "seen bigint, grade int, subject string, last_answer_id bigint, "
    "seqs array<bigint>, roles array<string>, contents array<string>"
)


def message_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """Messages from files appearing in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def track_history(messages: DataFrame, key: str, order: str, role: str, content: str, keep: int) -> DataFrame:
    """Streaming form of ``last_messages``: after each batch the kept messages of touched sessions.

    State per session is the ``keep`` messages with the greatest order value, so
    it is bounded, and files arriving out of order give the same result.  A
    session's new messages are read as an iterator of batches, never as one frame.
    """
    output = f"{key} bigint, seqs array<bigint>, roles array<string>, contents array<string>"

    def update(keys, batches: Iterator[pd.DataFrame], state: GroupState):
        _, _, _, _, seqs, roles, contents = state.get if state.exists else (0, None, None, None, [], [], [])
        held = list(zip(seqs, roles, contents))
        for batch in batches:
            fresh = zip(batch[order].tolist(), batch[role].tolist(), batch[content].tolist())
            held = sorted([*held, *fresh], key=lambda m: m[0])[-keep:]
        columns = [list(c) for c in zip(*held)]
        state.update((len(held), None, None, None, *columns))
        yield pd.DataFrame([(keys[0], *columns)], columns=[key, "seqs", "roles", "contents"])

    return (
        messages.select(key, order, role, content)
        .groupBy(key)
        .applyInPandasWithState(update, output, STATE, "update", GroupStateTimeout.NoTimeout)
    )


def _known(value) -> bool:
    """Whether a value read from a frame is not null (pandas gives None or NaN)."""
    return value is not None and value == value


class _Latest:
    """Values set at sequence numbers, the newest ``ROOM`` of them, in order.

    ``base`` is the value the oldest of them replaced.  Adding values is the same
    in any order, unless more than ``ROOM`` newer ones are known already.
    """

    ROOM = 64

    def __init__(self, seqs: list[int], values: list, base, base_seq: int) -> None:
        self.at = dict(zip(seqs, values))
        self.base, self.base_seq = base, base_seq

    def add(self, seqs: list[int], values: list) -> None:
        self.at.update((s, v) for s, v in zip(seqs, values) if s > self.base_seq)
        if len(self.at) > self.ROOM:
            *old, last = sorted(self.at)[: len(self.at) - self.ROOM]
            self.base, self.base_seq = self.at[last], last
            for seq in [*old, last]:
                del self.at[seq]

    def value(self):
        return self.at[max(self.at)] if self.at else self.base

    def changed(self) -> int:
        """Where the value took its present state, -1 if before all that is known."""
        where, held = -1, self.base
        for seq in sorted(self.at):
            if self.at[seq] != held:
                where, held = seq, self.at[seq]
        return where

    def row(self) -> tuple:
        seqs = sorted(self.at)
        return seqs, [self.at[s] for s in seqs], self.base, self.base_seq


_SCOPE = (
    "channel:string,user_id:string,grade_seqs:array<bigint>,grades:array<int>,grade_base:int,grade_base_seq:bigint,"
    "subject_seqs:array<bigint>,subjects:array<string>,subject_base:string,subject_base_seq:bigint,"
    "cleared:bigint,answer_seq:bigint,answer_id:bigint,"
    "seqs:array<bigint>,roles:array<string>,contents:array<string>"
)
SCOPE_STATE = f"sessions array<struct<{_SCOPE}>>"
#: Groups that sessions are dealt to by hash; the state of a group is that of its sessions.
GROUPS = 4_096


class _Session:
    """What is known of a session: the newest settings, messages and answer, the last clearing."""

    def __init__(self, held: tuple) -> None:
        self.keys = tuple(held[:2])
        self.grades, self.subjects = _Latest(*held[2:6]), _Latest(*held[6:10])
        self.cleared, self.answered, self.answer = held[10:13]
        self.messages = dict(zip(held[13], zip(held[14], held[15])))
        self.rest()

    @classmethod
    def new(cls, keys: tuple) -> _Session:
        return cls((*keys, [], [], None, -1, [], [], None, -1, -1, -1, None, [], [], []))

    def rest(self) -> None:
        self.given, self.chosen, self.said = ([], []), ([], []), {}

    def see(self, seq, grade, subject, clear, role, content, answer_id) -> None:
        if _known(grade):
            self.given[0].append(seq)
            self.given[1].append(int(grade))
        if _known(subject):
            self.chosen[0].append(seq)
            self.chosen[1].append(subject)
        if _known(clear) and clear and seq > self.cleared:
            self.cleared = seq
        if _known(answer_id) and seq > self.answered:
            self.answered, self.answer = seq, int(answer_id)
        if _known(content):
            self.said.setdefault(seq, (role, content))

    def fold(self, keep: int) -> None:
        """Takes in what was seen since the last time."""
        self.grades.add(*self.given)
        self.subjects.add(*self.chosen)
        self.messages |= {seq: self.said[seq] for seq in nlargest(keep, self.said)}
        for seq in sorted(self.messages)[:-keep]:
            del self.messages[seq]
        self.rest()

    def row(self) -> tuple:
        seqs = sorted(self.messages)
        roles, contents = ([self.messages[s][i] for s in seqs] for i in (0, 1))
        known = (self.cleared, self.answered, self.answer)
        return (*self.keys, *self.grades.row(), *self.subjects.row(), *known, seqs, roles, contents)

    def shown(self) -> tuple:
        since = max(self.cleared, self.grades.changed(), self.subjects.changed())
        contents = [self.messages[s][1] for s in sorted(self.messages) if s >= since]
        answer = self.answer if self.answered >= since else None
        return (*self.keys, self.grades.value(), self.subjects.value(), answer, contents)


def track_scope(events: DataFrame, keep: int, groups: int = GROUPS) -> DataFrame:
    """Profile, history and last answer per (channel, user_id), cleared when the scope changes.

    ``events``: channel, user_id, seq, grade, subject (NULL unless the message
    sets them), clear (true for a command that empties the history), role,
    content, answer_id.  One row per touched session and batch.

    The state is that of all messages so far in the order of ``seq``, in whatever
    order, batch or micro-batch they came: it holds the newest ``keep`` messages,
    the newest settings of grade and subject, the last clearing and the last
    answer, each with its number.  A late message finds its place among them, and
    what the history shows is what lies behind the last change of scope.  Each
    Arrow batch is folded into this state, so a session's messages are never held
    together.  Of grade and subject, the ``_Latest.ROOM`` newest settings are told apart.

    Handing one group's rows and state to Python costs as much as folding many
    messages, so sessions are dealt to ``groups`` groups by hash: there are never
    more calls than that in a micro-batch, however many sessions there are.  Keep
    ``groups`` for the life of a checkpoint.
    """
    output = "channel string, user_id string, grade int, subject string, last_answer_id bigint, contents array<string>"
    names = ["channel", "user_id", "grade", "subject", "last_answer_id", "contents"]
    columns = ["channel", "user_id", "seq", "grade", "subject", "clear", "role", "content", "answer_id"]

    def update(_, batches: Iterator[pd.DataFrame], state: GroupState):
        held = {tuple(s[:2]): s for s in (state.get[0] if state.exists else [])}
        touched: dict[tuple, _Session] = {}
        for batch in batches:
            seen = {}
            for channel, user_id, *message in zip(*(batch[c].tolist() for c in columns)):
                keys = (channel, user_id)
                session = touched.get(keys)
                if session is None:
                    session = touched[keys] = _Session(held[keys]) if keys in held else _Session.new(keys)
                seen[keys] = session
                session.see(*message)
            for session in seen.values():
                session.fold(keep)
        held |= {keys: session.row() for keys, session in touched.items()}
        state.update((list(held.values()),))
        shown = zip(*(session.shown() for session in touched.values()))
        yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(names, shown)})

    dealt = events.withColumn("__group", F.pmod(F.xxhash64("channel", "user_id"), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandasWithState(
        update, output, SCOPE_STATE, "update", GroupStateTimeout.NoTimeout
    )


def latest_states(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The newest row of each session in a table written by :func:`run_to_table`."""
    rows = spark.read.parquet(table)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*rest), "batch_id").alias("__s")
    return rows.groupBy(*keys).agg(newest).select(*keys, "__s.*")


def files_per_batch(spark: SparkSession, folder: str, batches: int) -> int:
    """How many of a folder's files make up one of so many micro-batches."""
    return max(1, -(-len(spark.read.parquet(folder).inputFiles()) // batches))


def run_to_table(stream: DataFrame, table: str, checkpoint: str, name: str | None = None) -> None:
    """Process what is available now into ``table``, one folder per batch.

    A batch retried after a failure overwrites its own folder, so the table holds
    every batch once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def deliver(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """Answer each micro-batch with ``handle`` and pass the replies to ``sink(replies, batch_id)``.

    Delivery is at least once; a sink keyed by (batch_id, message id) makes it exactly once.
    """
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: sink(handle(batch), batch_id))
        .start()
    )
