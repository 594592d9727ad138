"""Finding and replacing personal data and secrets."""

from docloom.operators.redaction.engine import Redactor, Result, Span
from docloom.operators.redaction.udf import redact_column, redacted, redacted_text, register

__all__ = ["Redactor", "Result", "Span", "redact_column", "redacted", "redacted_text", "register"]
