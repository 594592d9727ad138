"""The exact redaction of one text: rules claim spans in order, and no claim may touch an earlier one."""

from __future__ import annotations

import hashlib
import re
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache

from docloom.operators.redaction.rules import RULES, TOKENS
from docloom.options import Level, RedactorOptions

MASK = "\ufffd"
#: A custom pattern may run so long on one text.
TIMEOUT_S = 1.0


@dataclass(frozen=True)
class Span:
    start: int
    length: int
    category: str


@dataclass(frozen=True)
class Result:
    text: str | None
    counts: dict[str, int] = field(default_factory=dict)
    spans: list[Span] = field(default_factory=list)


class _TimedOut(Exception):
    pass


@contextmanager
def _limited(seconds: float) -> Iterator[None]:
    """Ends the pattern matching in its block after that time, where signals can be had (the main thread; elsewhere see ``_matches``)."""
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        yield
        return

    def stop(*_: object) -> None:
        raise _TimedOut

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


@lru_cache(maxsize=256)
def _timed(pattern: re.Pattern[str]):
    """The pattern for a library that ends by itself after a time, or None if there is none or it cannot read it."""
    try:
        import regex

        return regex.compile(pattern.pattern, regex.V0 | (regex.IGNORECASE if pattern.flags & re.IGNORECASE else 0))
    except Exception:
        return None


def _matches(pattern: re.Pattern[str], text: str, custom: bool) -> Iterator:
    """Matches of a rule; one of the caller's is stopped after TIMEOUT_S: by a signal, or off the main thread by the library."""
    own = _timed(pattern) if custom and threading.current_thread() is not threading.main_thread() else None
    if own is None:
        yield from pattern.finditer(text)
        return
    try:
        yield from own.finditer(text, timeout=TIMEOUT_S)
    except TimeoutError:
        raise _TimedOut from None


def stable_code(value: str, salt: str | None) -> str:
    """Eight hex digits that equal values share."""
    return hashlib.sha256(f"{salt or ''}\0{value}".encode("utf-8", "surrogatepass")).hexdigest()[:8]


def with_code(token: str, code: str) -> str:
    return f"{token[:-1]}_{code}]" if len(token) >= 2 and token[0] == "[" and token[-1] == "]" else f"{token}_{code}"


def masked(value: str, reveal: int, mask: str) -> str:
    """The last letters and digits stay, others become the mask; signs and spaces stay where they are."""
    out, kept = list(value), 0
    for i in range(len(out) - 1, -1, -1):
        if out[i].isalpha() or out[i].isdecimal():
            if kept >= reveal:
                out[i] = mask
            kept += 1
    return "".join(out)


class Redactor:
    """Reusable and picklable; patterns are compiled once a process."""

    def __init__(self, options: RedactorOptions | Level | None = None) -> None:
        if options is None or isinstance(options, Level):
            options = RedactorOptions(level=options or Level.STANDARD)
        self.options = options
        for rule in options.custom:
            rule.compiled()

    def __getstate__(self) -> dict:
        return {"options": self.options}

    def _rules(self) -> list[tuple]:
        known = self.__dict__.get("_compiled")
        if known is None:
            o = self.options
            known = [(r.compiled(), r.category, None, True) for r in o.custom if not o.is_disabled(r.category)]
            known += [
                (r.compiled(), r.category, r.check, False)
                for r in RULES
                if not o.is_disabled(r.category) and (not r.aggressive or o.level is Level.AGGRESSIVE)
            ]
            self.__dict__["_compiled"] = known
        return known

    def token(self, category: str) -> str:
        """An override, else the last custom rule's of that category, else the deny token or the built-in one."""
        o = self.options
        if (found := o.tokens.get(category.lower())) is not None:
            return found
        for rule in reversed(o.custom):
            if rule.category == category:
                return rule.replacement
        return o.deny_token if category == "Custom" else TOKENS[category]

    def render(self, category: str, value: str) -> str:
        o = self.options
        reveal = o.reveal_last.get(category.lower(), -1)
        if reveal >= 0:
            return masked(value, reveal, o.mask_char)
        token = self.token(category)
        return with_code(token, stable_code(value, o.token_salt)) if o.stable_tokens else token

    def spans(self, text: str) -> list[Span]:
        """Claimed spans in reading order."""
        taken, work, spans = bytearray(len(text)), text, []

        def claim(start: int, end: int, category: str) -> bool:
            if start >= end or any(taken[start:end]):
                return False
            taken[start:end] = b"\x01" * (end - start)
            spans.append(Span(start, end - start, category))
            return True

        for term in self.options.deny:
            for m in re.finditer(re.escape(term), text, re.IGNORECASE):
                claim(m.start(), m.end(), "Custom")
        work = _veiled(text, taken) if spans else text
        for pattern, category, check, custom in self._rules():
            new = False
            try:
                with _limited(TIMEOUT_S) if custom else _free():
                    for m in _matches(pattern, work, custom):
                        value = m.group()
                        if check is not None and not check(value) or value.lower() in self.options.allow:
                            continue
                        new |= claim(m.start(), m.end(), category)
            except _TimedOut:
                pass
            if new:
                work = _veiled(text, taken)
        return sorted(spans, key=lambda s: s.start)

    def redact(self, text: str | None) -> Result:
        if not text or self.options.level is Level.OFF:
            return Result(text)
        spans = self.spans(text)
        if not spans:
            return Result(text)
        out, counts, at = [], {}, 0
        for s in spans:
            out += [text[at : s.start], self.render(s.category, text[s.start : s.start + s.length])]
            counts[s.category] = counts.get(s.category, 0) + 1
            at = s.start + s.length
        return Result("".join(out) + text[at:], counts, spans)


@contextmanager
def _free() -> Iterator[None]:
    yield


def _veiled(text: str, taken: bytearray) -> str:
    """The text with claimed characters hidden behind one that no rule knows."""
    out, at = [], 0
    while at < len(text):
        start = taken.find(1, at)
        if start < 0:
            break
        end = taken.find(0, start)
        end = len(text) if end < 0 else end
        out += [text[at:start], MASK * (end - start)]
        at = end
    return "".join(out) + text[at:]
