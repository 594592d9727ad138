"""Redaction steps that run inside the JVM: the gate before the exact engine, and single categories."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.operators.redaction.rules import BY_NAME, RULES
from docloom.options import CustomRule, Level, RedactorOptions

_OPEN, _CLOSE = "\ue000", "\ue001"


#: What must be in a text for a rule to match, so that the rule's pattern runs on few texts: signs, one of which must be there, or a short pattern.
_SIGNS: dict[str, tuple[str, ...]] = {
    "private_key": ("-----BEGIN",), "jwt": ("eyJ",), "connection": ("://",), "api_key_aws": ("AKIA", "ASIA"), "api_key_google": ("AIza",), "api_key_github": ("gho_", "ghp_", "ghr_", "ghs_", "ghu_"),
    "api_key_slack": ("xox",), "email": ("@",), "mac": (":", "-"), "secret_assignment": (":", "="),
}
_SHORT: dict[str, str] = {"ipv6": ":[0-9A-Fa-f:]", "secret_entropy": "[-+/0-9A-Z_a-z]{32}"}
#: Rules that need digits.
_DIGITS = ("card", "iban", "ssn", "ipv4", "phone", "geo", "dob", "long_number")


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | part
    return out


def _builtin(text: Column, names: list[str], flag: str) -> Column:
    """Whether a rule matches. flag: for the meaning of the classes; an ASCII text needs none."""
    match = lambda name: text.rlike(flag + BY_NAME[name].pattern)
    parts = []
    for name in names:
        if name in _SIGNS:
            parts.append(_any([text.contains(x) for x in _SIGNS[name]]) & match(name))
        elif name in _SHORT:
            parts.append(text.rlike(_SHORT[name]) & match(name))
        elif name not in _DIGITS:
            parts.append(match(name))
    digits = [match(name) for name in names if name in _DIGITS]
    return _any(parts + ([text.rlike(flag + r"\d") & _any(digits)] if digits else []))


def loosened(rule: CustomRule) -> str | None:
    """A pattern for the JVM that finds all that a rule of the caller's does, and perhaps more; None if there is none.

    What the two dialects may see differently is made wider: look-arounds, anchors and
    word boundaries are left out, and classes become unions or any character.
    """
    def char(code: int) -> str:
        return f"\\x{{{code:x}}}"

    def members(items) -> str | None:
        out = ""
        for kind, value in items:
            name = str(kind)
            if name == "NEGATE":
                return None
            if name == "LITERAL":
                out += char(value)
            elif name == "RANGE":
                out += f"{char(value[0])}-{char(value[1])}"
            elif name == "CATEGORY" and str(value) in _CLASSES:
                out += _CLASSES[str(value)]
            else:
                return None
        return out

    def one(item) -> str:
        kind, value = str(item[0]), item[1]
        if kind == "LITERAL":
            return char(value)
        if kind == "IN":
            inside = members(value)
            return "(?s:.)" if inside is None else f"[{inside}]"
        if kind in ("ANY", "NOT_LITERAL"):
            return "(?s:.)"
        if kind in ("AT", "ASSERT", "ASSERT_NOT"):
            return ""
        if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            return f"(?:{whole(body)}){{{low},{'' if str(high) == 'MAXREPEAT' else high}}}"
        if kind == "SUBPATTERN":
            if value[1] or value[2]:
                raise ValueError("flags within a pattern")
            return f"(?:{whole(value[3])})"
        if kind == "ATOMIC_GROUP":
            return f"(?:{whole(value)})"
        if kind == "BRANCH":
            return "(?:" + "|".join(whole(x) for x in value[1]) + ")"
        raise ValueError(kind)

    def whole(items) -> str:
        return "".join(map(one, items))

    compiled = rule.compiled()
    if rule.ignore_case and not compiled.pattern.isascii():
        return None
    if compiled.flags & ~(re.IGNORECASE | re.UNICODE):
        return None
    try:
        return ("(?iuU)" if rule.ignore_case else "(?U)") + whole(re._parser.parse(compiled.pattern))
    except (ValueError, RecursionError):
        return None


_CLASSES = {"CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w\p{N}", "CATEGORY_SPACE": r"\s\x1c-\x1f"}


def gate(text: Column, options: RedactorOptions) -> Column:
    """Whether any enabled pattern is in the raw text. Where it is false, redaction changes nothing: a first claim is made on unmasked text."""
    if options.level is Level.OFF:
        return F.lit(False)
    names = [r.name for r in RULES if not options.is_disabled(r.category) and (not r.aggressive or options.level is Level.AGGRESSIVE)]
    hit = F.when(F.length(text) == F.octet_length(text), _builtin(text, names, "")).otherwise(_builtin(text, names, "(?U)"))
    for rule in options.custom:
        pattern = loosened(rule)
        hit = hit | (F.lit(True) if pattern is None else text.rlike(pattern))
    for term in options.deny:
        hit = hit | text.rlike("(?iu)" + re.escape(term))
    return F.coalesce(hit, F.lit(False))


def replaced(text: Column, rule: str, token: str | None = None) -> Column:
    """One rule without a check, on its own."""
    r = BY_NAME[rule]
    return F.regexp_replace(text, F.lit(r.jvm), F.lit((token or r.token).replace("$", r"\$")))


def mapped(text: Column, pattern: str, change) -> Column:
    """Each match of a pattern replaced by change(match), a column expression of it."""
    marked = F.regexp_replace(text, F.lit(f"(?U)({pattern.removeprefix('(?U)')})"), F.lit(f"{_OPEN}$1{_CLOSE}"))
    pieces = F.split(marked, _OPEN)

    def one(piece: Column) -> Column:
        value, rest = F.substring_index(piece, _CLOSE, 1), F.substring_index(piece, _CLOSE, -1)
        return F.when(F.contains(piece, F.lit(_CLOSE)), F.concat(change(value), rest)).otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))


def luhn(value: Column) -> Column:
    n = F.length(digits(value))
    return (n >= 13) & (n <= 16) & F.call_function("luhn_check", digits(value))


def cards(text: Column, change=None) -> Column:
    """Card numbers with a right check digit."""
    change = change or (lambda _: F.lit("[CARD]"))
    return mapped(text, BY_NAME["card"].pattern, lambda v: F.when(luhn(v), change(v)).otherwise(v))


def entropy(value: Column) -> Column:
    """Bits a character."""
    n = F.length(value).cast("double")
    letters = F.split(value, "")
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return -F.aggregate(shares, F.lit(0.0), lambda total, p: total + p * F.log2(p))


def looks_random(value: Column) -> Column:
    return (F.length(value) >= 32) & value.rlike(r"[A-Za-z]") & value.rlike("[0-9]") & (entropy(value) >= 4.0)


def mask_last(value: Column, keep: int, mask: str = "*") -> Column:
    """All letters and digits but the last few hidden."""
    letter = r"[\p{L}\p{Nd}]"
    if keep <= 0:
        return F.regexp_replace(value, F.lit(letter), F.lit(mask))
    return F.regexp_replace(value, F.lit(f"{letter}(?=(?:[^\\p{{L}}\\p{{Nd}}]*{letter}){{{keep}}})"), F.lit(mask))


def stable_code(value: Column, salt: str | None = None) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt or ""), F.chr(F.lit(0)), value), 256), 1, 8)
