"""Inbound messages: de-duplication, intent, route and log rows. All of it works on static and streaming frames."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed_values import FALLBACK_INTENT, GREETINGS, INTENT_TOKENS, UPLOAD_WORDS
from ledgerloom.functions.text import phone_digest


def drop_retries(messages: DataFrame, delay: str = "1 hour", time: str = "created_at") -> DataFrame:
    """A stream without repeated message ids; ids are remembered for `delay` of event time."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["message_id"])


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def intent(text: Column) -> Column:
    """The first rule one of whose words occurs anywhere in the text, also inside other words."""
    lower = F.lower(F.trim(text))
    result = F.lit(FALLBACK_INTENT)
    for name, words in reversed(INTENT_TOKENS):
        result = F.when(_any_of(lower, words), name).otherwise(result)
    return result


def route(text: Column, whitelisted: Column) -> Column:
    """Greeting, then access, then upload words; everything else goes to the assistant."""
    lower = F.lower(F.trim(text))
    return (
        F.when(lower.isin(*GREETINGS), "help")
        .when(~whitelisted, "not_whitelisted")
        .when(_any_of(lower, UPLOAD_WORDS), "upload_link")
        .otherwise(FALLBACK_INTENT)
    )


def log_rows(messages: DataFrame) -> DataFrame:
    """Rows for the message log: trimmed, non-empty, whole, with intent and hashed phone."""
    text = F.trim(F.coalesce(F.col("message_text"), F.lit("")))
    return messages.filter(text != "").select(
        "message_id", "user_id", "phone_number", phone_digest(F.col("phone_number")).alias("phone_hash"),
        "direction", text.alias("message_text"),
        F.when(F.col("direction") == "inbound", intent(text)).alias("intent_detected"), "created_at",
    )
