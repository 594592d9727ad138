"""Redaction in front of a chat model or an embedding model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.redaction import redacted_text


def chat_redacted(messages: DataFrame, redactor=None, *, user_only: bool = True, role: str = "role", text: str = "text") -> DataFrame:
    """messages with the text redacted before it is sent: of the user alone, or of all roles. Answers that come later are not touched."""
    sent = F.col(text) if not user_only else F.when(F.col(role) == "user", F.col(text))
    return messages.withColumn(text, F.coalesce(redacted_text(sent, redactor), F.col(text)))


def embedding_inputs(values: DataFrame, redactor=None, *, text: str = "text") -> DataFrame:
    """Every input redacted; null becomes empty."""
    return values.withColumn(text, F.coalesce(redacted_text(F.col(text), redactor), F.lit("")))


def redaction(redactor=None, *, text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform."""
    return lambda df: df.withColumn(text, redacted_text(F.col(text), redactor))
