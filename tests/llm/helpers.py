"""Small tables with every awkward case, and plain versions of words and shingles."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _at string, row string, size string, u string, label string, n string, key string, slice string, at string, h string"
CLASHES = ("_at", "row", "size", "u", "label", "n", "key", "slice", "at", "h")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = words(lower(text))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def prose(seed, n):
    g = random.Random(seed)
    return " ".join("".join(g.choice(["ka", "to", "mi", "re", "su", "né"]) for _ in range(g.randint(1, 4))) for _ in range(n))


def texts():
    """(doc_id, text): copies, near copies, short, empty and blank texts, nulls, one long text, shared lines, repeated rows."""
    base = prose(1, 120)
    w = base.split(" ")
    out = [(1, base), (2, base), (3, " ".join(w[:60] + ["changed"] + w[61:])), (4, " ".join(w[:118])), (5, base.upper().replace("É", "é"))]
    out += [(10, ""), (11, None), (12, " \t\n "), (13, "one"), (14, "One"), (15, "a b c d"), (16, "a b c e"), (None, prose(2, 40)), (None, None)]
    out += [(20, prose(3, 4000)), (21, "Shared Line \n" + prose(4, 30)), (22, "x\n shared line\n\ny"), (23, "shared line")]
    out += [(30 + k, "  SHARED line\r\n" + prose(50 + k, 25) + "\n\n") for k in range(10)]
    out += [(60, prose(9, 30)), (60, prose(9, 30)), (61, "ümläut " + prose(10, 10) + "\x00\x1c end"), (62, "same\nsame\nsame\n#tag $5 <b>")]
    out += [(70 + k, prose(70 + k, 8 * (k + 1))) for k in range(8)]
    return out


def documents(spark, rows=None):
    """The texts as documents with a hot source, a null source and columns whose names operators use themselves."""
    rows = texts() if rows is None else rows
    full = []
    for k, (i, t) in enumerate(rows):
        source = None if k % 11 == 7 else "hot" if k % 3 else f"src{k % 5}"
        full.append((i, t, [None, "en", "de"][k % 3], source, len(t or "")) + ("clash",) * len(CLASHES))
    return spark.createDataFrame(full, SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df):
    return [tuple(r) for r in df.collect()]

