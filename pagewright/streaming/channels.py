"""Messages of the chat channels, in and out; works on batches and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import fixed_values as fv
from pagewright.functions import messages as ms
from pagewright.functions import text as tx
from pagewright.functions import webhook as wh

MESSAGE_LIMITS = {"discord": fv.DISCORD_MESSAGE_LIMIT, "telegram": fv.TELEGRAM_MESSAGE_LIMIT}


def incoming(raw: DataFrame, channel: str) -> DataFrame:
    """Messages people wrote: those of bots and empty ones are left out.

    ``raw``: user_id, text and optionally display_name, is_private, is_bot.
    """
    optional = {
        "display_name": F.lit(None).cast("string"),
        "is_private": F.lit(False),
        "is_bot": F.lit(False),
    }
    full = raw.withColumns({n: c for n, c in optional.items() if n not in raw.columns})
    return (
        full.where(~F.coalesce("is_bot", F.lit(False)) & ~tx.is_blank(F.col("text")))
        .drop("is_bot")
        .withColumn("channel", F.lit(channel))
    )


def webhook_deliveries(deliveries: DataFrame, secret: str) -> tuple[DataFrame, DataFrame]:
    """(text messages, refused deliveries) of signed webhook requests: body, signature.

    Deliveries that are signed and well-formed but carry no text are neither.
    """
    checked = deliveries.withColumn("event", wh.parse_event(F.col("body"))).withColumn(
        "ok",
        wh.signature_ok(F.col("body"), F.col("signature"), secret) & F.col("event").isNotNull(),
    )
    messages = checked.where(F.col("ok") & wh.is_text_message(F.col("event"))).select(
        F.lit("zalo").alias("channel"),
        F.col("event.sender.id").alias("user_id"),
        F.col("event.message.text").alias("text"),
    )
    return messages, checked.where(~F.col("ok")).select("body", "signature")


def outgoing(replies: DataFrame, channel: str, text: str = "message") -> DataFrame:
    """Replies cut to the channel's limit: one row per piece, numbered from 0."""
    limit = MESSAGE_LIMITS.get(channel)
    body = F.array(F.col(text)) if limit is None else ms.split_message(F.col(text), limit)
    rest = [c for c in replies.columns if c != text]
    return replies.select(*rest, F.posexplode(body).alias("piece", "text"))
