"""The built-in rules, most specific first, in one spelling for Python and one for the JVM.

The order is part of the meaning: an earlier rule's match takes its text before a later
rule looks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

#: White space as all dialects used here agree on it.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
NOT_SPACE_BUT = "[^{}\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    token: str
    pattern: str
    aggressive: bool = False
    check: Callable[[str], bool] | None = None

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern)

    @property
    def jvm(self) -> str:
        """For rlike and regexp_replace; (?U) gives the classes their Unicode meaning."""
        return "(?U)" + self.pattern


def luhn(value: str) -> bool:
    """13 to 16 digits, separators aside, with a right check digit."""
    digits = [int(c) for c in value if c.isdecimal()]
    if not 13 <= len(digits) <= 16:
        return False
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[::-2])) % 10 == 0


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    return len(value) >= 32 and any(c.isalpha() for c in value) and any(c.isdecimal() for c in value) and entropy(value) >= 4.0


def _v6() -> str:
    """All eight groups, or one run of zero groups written as two colons."""
    group = "[0-9A-Fa-f]{1,4}"
    head, tail = f"(?:{group}:)", f"(?::{group})"
    forms = [head + "{7}" + group, head + "{1,7}:", head + "{1,6}:" + group]
    forms += [f"{head}{{1,{7 - n}}}{tail}{{1,{n}}}" for n in range(2, 6)]
    forms += [f"{group}:{tail}{{1,6}}", f":{tail}{{1,7}}"]
    return r"(?<![:\w])(?:" + "|".join(forms) + r")(?![:\w])"


def _pem() -> str:
    edge = "-----{} (?:[0-9A-Z ]+ )?PRIVATE KEY-----"
    return edge.format("BEGIN") + r"(?s:.*?)" + edge.format("END")


def _jwt() -> str:
    part = r"[\w-]+".replace(r"\w", "0-9A-Z_a-z")
    return r"\b" + r"\.".join(["eyJ" + part, "eyJ" + part, part]) + r"\b"


def _uri() -> str:
    secret = NOT_SPACE_BUT.format("/:@") + "+"
    return rf"\b[a-z][-+.0-9a-z]*:/{{2}}{secret}:{secret}@" + NOT_SPACE_BUT.format("/") + "+"


def _octets() -> str:
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    return rf"\b(?:{octet}\.){{3}}{octet}\b"


def _phone() -> str:
    gap = "[- .]"
    country, area = rf"(?:\+?\d{{1,3}}{gap}?)?", rf"(?:[(]\d{{2,4}}[)]{gap}?)?"
    return rf"(?<!\d){country}{area}\d{{3,4}}{gap}\d{{3,4}}(?:{gap}\d{{2,4}})?(?!\d)"


def _degrees() -> str:
    one = r"[+-]?\d{1,3}\.\d{3,}"
    return f"{one}{SPACE}*,{SPACE}*{one}"


def _assignment() -> str:
    keys = ["pass(?:wd|word)?", "pwd", "secret", "token", *(f"{k}[ _-]?key" for k in ("api", "access")), "client[ _-]?secret"]
    value = NOT_SPACE_BUT.format("\"',;{}".replace("{", "{{").replace("}", "}}").format()) + "{6,}"
    return rf"(?i:\b(?:{'|'.join(keys)})\b){SPACE}*[:=]{SPACE}*[\"']?{value}"


def _blob() -> str:
    letter = "[-+/0-9A-Z_a-z]"
    return f"(?<!{letter}){letter}{{32,}}={{0,2}}(?!{letter})"


def _long(prefix: str, letters: str, count: str) -> str:
    return rf"\b{prefix}[{letters}]{{{count}}}\b"


RULES: tuple[Rule, ...] = (
    Rule("private_key", "PrivateKey", "[PRIVATE_KEY]", _pem()),
    Rule("jwt", "JWT", "[JWT]", _jwt()),
    Rule("connection", "ConnectionString", "[CONNECTION_STRING]", _uri()),
    Rule("api_key_aws", "ApiKey", "[API_KEY]", _long("A[KS]IA", "0-9A-Z", "16")),
    Rule("api_key_google", "ApiKey", "[API_KEY]", _long("AIza", "-0-9A-Z_a-z", "35")),
    Rule("api_key_github", "ApiKey", "[API_KEY]", _long("gh[oprsu]_", "0-9A-Za-z", "36,")),
    Rule("api_key_slack", "ApiKey", "[API_KEY]", _long("xox[abprs]-", "-0-9A-Za-z", "10,")),
    Rule("email", "Email", "[EMAIL]", r"\b[%+.\-0-9A-Z_a-z]+@[.\-0-9A-Za-z]+\.[A-Za-z]{2,}\b"),
    Rule("card", "Card", "[CARD]", r"\b(?:\d[- ]?){13,16}\b", check=luhn),
    Rule("iban", "IBAN", "[IBAN]", rf"\b[A-Z]{{2}}\d{{2}}(?:{SPACE}?[0-9A-Z]){{11,30}}\b"),
    Rule("ssn", "SSN", "[SSN]", r"\b" + "-".join(rf"\d{{{n}}}" for n in (3, 2, 4)) + r"\b"),
    Rule("mac", "MAC", "[MAC]", r"\b(?:[0-9A-Fa-f]{2}[-:]){5}[0-9A-Fa-f]{2}\b"),
    Rule("ipv4", "IP", "[IP]", _octets()),
    Rule("ipv6", "IP", "[IP]", _v6()),
    Rule("phone", "Phone", "[PHONE]", _phone()),
    Rule("geo", "Geo", "[GEO]", _degrees(), True),
    Rule("dob", "DateOfBirth", "[DATE]", r"\b(?:\d{1,2}[-./]){2}(?:20|19)\d{2}\b", True),
    Rule("secret_assignment", "Secret", "[SECRET]", _assignment(), True),
    Rule("long_number", "LongNumber", "[NUMBER]", r"\b\d{7,}\b", True),
    Rule("secret_entropy", "Secret", "[SECRET]", _blob(), True, looks_random),
)
BY_NAME = {r.name: r for r in RULES}
CATEGORIES = tuple(dict.fromkeys(r.category for r in RULES)) + ("Custom",)
TOKENS = {r.category: r.token for r in RULES}
