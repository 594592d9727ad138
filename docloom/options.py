"""Options of scans, redaction and chunking, checked when they are made."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class Recursion(Enum):
    TOP_ONLY = "top-only"
    ALL_NESTED = "all-nested"


class Level(Enum):
    OFF = "off"
    STANDARD = "standard"
    AGGRESSIVE = "aggressive"


class OutputFormat(Enum):
    CSV = "csv"
    JSON = "json"
    JSON_LINES = "jsonl"
    PARQUET = "parquet"


@dataclass(frozen=True)
class CustomRule:
    """A pattern of the caller's. The token is ``[CATEGORY]`` in upper case if none is given."""

    category: str
    pattern: str
    token: str | None = None
    ignore_case: bool = False

    def __post_init__(self) -> None:
        if not (self.category or "").strip():
            raise ValueError("a custom rule needs a category")
        if not self.pattern:
            raise ValueError(f"the custom rule {self.category!r} needs a pattern")
        self.compiled()

    def compiled(self) -> re.Pattern[str]:
        """The pattern for Python: named groups and the end anchor of other dialects are rewritten."""
        text = re.sub(r"\(\?<(?![=!])", "(?P<", self.pattern).replace(r"\z", r"\Z")
        if r"\p{" in text or r"\P{" in text:
            raise ValueError(f"the custom rule {self.category!r} uses a Unicode class, which is not supported: {self.pattern}")
        try:
            return re.compile(text, re.IGNORECASE if self.ignore_case else 0)
        except re.error as e:
            raise ValueError(f"the custom rule {self.category!r} has a bad pattern: {e}") from e

    @property
    def replacement(self) -> str:
        return self.token or f"[{self.category.upper()}]"


@dataclass(frozen=True)
class RedactorOptions:
    level: Level = Level.STANDARD
    disabled: frozenset[str] = frozenset()
    tokens: Mapping[str, str] = field(default_factory=dict)
    allow: frozenset[str] = frozenset()
    deny: Sequence[str] = ()
    deny_token: str = "[REDACTED]"
    custom: Sequence[CustomRule] = ()
    stable_tokens: bool = False
    token_salt: str | None = None
    reveal_last: Mapping[str, int] = field(default_factory=dict)
    mask_char: str = "*"

    def __post_init__(self) -> None:
        if len(self.mask_char) != 1:
            raise ValueError("mask_char is one character")
        set_ = object.__setattr__
        set_(self, "disabled", frozenset(x.lower() for x in self.disabled))
        set_(self, "allow", frozenset(x.lower() for x in self.allow))
        set_(self, "tokens", {k.lower(): v for k, v in self.tokens.items()})
        set_(self, "reveal_last", {k.lower(): v for k, v in self.reveal_last.items()})
        set_(self, "deny", tuple(x for x in self.deny if x))
        set_(self, "custom", tuple(self.custom))

    def is_disabled(self, category: str) -> bool:
        return category.lower() in self.disabled


@dataclass(frozen=True)
class ChunkOptions:
    max_chars: int = 1000
    overlap_chars: int = 100
    respect_word_boundaries: bool = True

    def __post_init__(self) -> None:
        if self.max_chars <= 0:
            raise ValueError("max_chars must be positive")
        if not 0 <= self.overlap_chars < self.max_chars:
            raise ValueError("overlap_chars must be at least 0 and less than max_chars")

    @property
    def step(self) -> int:
        return self.max_chars - self.overlap_chars


@dataclass(frozen=True)
class ReadOptions:
    """max_files, max_bytes_per_file and max_text_length: 0 is no limit. An explicit redactor goes before the level."""

    recursion: Recursion = Recursion.ALL_NESTED
    max_files: int = 1000
    max_bytes_per_file: int = 10 * 1024 * 1024
    max_text_length: int = 20_000
    parallelism: int = 1
    include_extensions: frozenset[str] = frozenset()
    exclude_paths: frozenset[str] = frozenset()
    extractors: Sequence[Any] = ()
    redaction: Level = Level.OFF
    redactor: Any = None
    content_hash: bool = False
    on_diagnostic: Callable[[Any], None] | None = None

    def __post_init__(self) -> None:
        set_ = object.__setattr__
        normal = frozenset((x if x.startswith(".") else "." + x).lower() for x in self.include_extensions if x)
        set_(self, "include_extensions", normal)
        set_(self, "exclude_paths", frozenset(self.exclude_paths))
        set_(self, "extractors", tuple(self.extractors))
        set_(self, "parallelism", max(1, self.parallelism))
