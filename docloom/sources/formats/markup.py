"""Plain text, HTML and RTF."""

from __future__ import annotations

import re

from docloom.sources.formats.base import Content, decoded, properties, unescaped


class PlainText:
    extensions = frozenset(".txt .md .csv .log .json .xml".split())

    def can_handle(self, extension: str) -> bool:
        return extension in self.extensions

    def extract(self, name: str, data: bytes) -> Content:
        return Content({}, decoded(data))


_FLAGS = re.IGNORECASE | re.DOTALL
_HIDDEN = re.compile(r"<(style|script)\b[^>]*>.*?</\1\s*>", _FLAGS)
_REMARK = re.compile(r"<!--.*?-->", re.DOTALL)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", _FLAGS)
_TAG = re.compile(r"<[^>]+>")


def _tidy(text: str) -> str:
    return " ".join(unescaped(text).split())


class Html:
    def can_handle(self, extension: str) -> bool:
        return extension in (".htm", ".html")

    def extract(self, name: str, data: bytes) -> Content:
        page = decoded(data)
        first = _TITLE.search(page)
        title = _tidy(_TAG.sub(" ", first[1])) if first else None
        for part in (_HIDDEN, _REMARK, _TITLE, _TAG):
            page = part.sub(" ", page)
        return Content(properties(Title=title), _tidy(page))


_BLOCK = re.compile(r"</?(?:blockquote|section|br|div|h[1-6]|li|p|tr)\b[^>]*>", re.IGNORECASE)
_HIDDEN_STRICT = re.compile(r"<(style|script)\b[^>]*>.*?</\1>", _FLAGS)


def block_text(page: str) -> str:
    """Text of an XHTML chapter: a line for each block, single spaces within lines."""
    for part, new in ((_HIDDEN_STRICT, " "), (_BLOCK, "\n"), (_TAG, " ")):
        page = part.sub(new, page)
    page = re.sub(r"[\t\x0b\f ]+", " ", unescaped(page))
    return re.sub(r"\n+", "\n", re.sub(r" *\n *", "\n", page)).strip()


class Rtf:
    """A walk over groups, control words and text. Groups of control data give no text."""

    silent = frozenset(
        "annotation colorschememapping colortbl datastore field fonttbl footer footerl footerr footnote generator header headerl headerr "
        "info listoverridetable listtable object pict revtbl rsidtbl stylesheet themedata xmlnstbl".split()
    )
    written = {
        "par": "\n", "line": "\n", "sect": "\n", "row": "\n", "tab": "\t", "cell": " ", "nestcell": " ", "bullet": "•",
        "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”",
    }
    part = re.compile(r"\\(?:(?P<sign>[\\{}])|'(?P<hex>[0-9A-Fa-f]{2})?|(?P<word>[^\W\d_]+)(?P<number>-?\d*) ?|(?P<other>.))|(?P<group>[{}])|(?P<skip>[\r\n])|(?P<text>[^\\{}\r\n]+)", re.DOTALL)
    fallback = re.compile(r"\\'.{2}|[^{}]", re.DOTALL)

    def can_handle(self, extension: str) -> bool:
        return extension == ".rtf"

    def extract(self, name: str, data: bytes) -> Content:
        source, out = decoded(data), []
        depth, quiet, skips, at = 0, None, 1, 0
        while m := self.part.match(source, at):
            at, new = m.end(), None
            if m["group"] == "{":
                depth += 1
            elif m["group"]:
                quiet = None if quiet == depth else quiet
                depth -= 1
            elif m["text"]:
                new = m["text"]
            elif m["sign"]:
                new = m["sign"]
            elif m["hex"]:
                new = chr(int(m["hex"], 16))
            elif m["word"]:
                word, number = m["word"], m["number"]
                if word in self.silent:
                    quiet = depth if quiet is None else quiet
                elif word == "uc":
                    skips = max(0, int(number)) if number.strip("-") else 0
                elif word == "u" and number.strip("-"):
                    new = chr(int(number) % 0x10000)
                    for _ in range(skips):
                        if not (f := self.fallback.match(source, at)):
                            break
                        at = f.end()
                else:
                    new = self.written.get(word)
            elif m["other"]:
                if m["other"] == "*":
                    quiet = depth if quiet is None else quiet
                new = {"~": " ", "_": "-", "-": "-"}.get(m["other"])
            if new is not None and quiet is None:
                out.append(new)
        text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        text = re.sub(r"[^\S\n]+", " ", text)
        return Content({}, text.replace(" \n", "\n").replace("\n ", "\n").strip())
