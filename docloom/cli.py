"""``python -m docloom.cli scan FOLDER``: a folder as a table on standard output or in a file."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any, NoReturn

from docloom.options import CustomRule, Level, OutputFormat, ReadOptions, Recursion, RedactorOptions

VERSION = "0.1.0"
_FORMATS = {"csv": OutputFormat.CSV, "json": OutputFormat.JSON, "jsonl": OutputFormat.JSON_LINES, "ndjson": OutputFormat.JSON_LINES, "parquet": OutputFormat.PARQUET}


class UsageError(ValueError):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> NoReturn:
        raise UsageError(message)


def _count(text: str) -> int:
    if not text.isdecimal():
        raise argparse.ArgumentTypeError(f"must be a whole number from 0 on, not {text!r}")
    return int(text)


def _level(text: str) -> Level:
    try:
        return Level(text.lower())
    except ValueError:
        raise argparse.ArgumentTypeError(f"must be standard, aggressive or off, not {text!r}") from None


def _format(text: str) -> OutputFormat:
    if text.lower() not in _FORMATS:
        raise argparse.ArgumentTypeError(f"must be csv, json, jsonl or parquet, not {text!r}")
    return _FORMATS[text.lower()]


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="docloom", description="Scans a folder into a table of clean, redacted text.", allow_abbrev=False)
    p.add_argument("folder", nargs="?", help="the folder to scan")
    p.add_argument("--format", type=_format, help="csv (default), json, jsonl, ndjson or parquet; else by the ending of --out")
    p.add_argument("--out", help="a file (for parquet: a folder) to write; standard output if none is named")
    p.add_argument("--redact", nargs="?", type=_level, const=Level.STANDARD, help="replace personal data and secrets (--redact=aggressive: more)")
    p.add_argument("--rules", help="a JSON file of rules, allow, deny, disable, stableTokens, tokenSalt, revealLast, maskChar; implies --redact")
    p.add_argument("--recurse", dest="recurse", action="store_true", default=True, help="with subfolders (default)")
    p.add_argument("--no-recurse", dest="recurse", action="store_false")
    p.add_argument("--hash", action="store_true", help="add the SHA-256 of each file")
    p.add_argument("--include", action="append", default=[], help="extensions by commas")
    p.add_argument("--since", help="a manifest; only what changed since is read")
    p.add_argument("--manifest", help="where to write the manifest of this scan")
    p.add_argument("--max-files", type=_count, default=1000)
    p.add_argument("--max-bytes", type=_count, default=10 * 1024 * 1024)
    p.add_argument("--max-text", type=_count, default=20_000)
    p.add_argument("--local-time", action="store_true", help="times with the local offset instead of UTC")
    return p


def parse(arguments: list[str]) -> argparse.Namespace:
    """Options of a scan. A bare --redact never takes the next argument."""
    safe = ["--redact=standard" if a == "--redact" else a for a in arguments]
    found = parser().parse_args(safe)
    if found.format is None:
        ending = os.path.splitext(found.out or "")[1].lstrip(".").lower()
        found.format = _FORMATS.get(ending, OutputFormat.CSV)
    if found.folder is None:
        raise UsageError("no folder is named")
    if found.format is OutputFormat.PARQUET and found.out is None:
        raise UsageError("parquet cannot go to standard output; name --out")
    found.include = [x.strip() for part in found.include for x in part.split(",") if x.strip()]
    return found


def redactor_options(rules: dict[str, Any], level: Level | None) -> RedactorOptions:
    """Options of a rules file; names of keys are read in any case."""

    def low(d: dict[str, Any]) -> dict[str, Any]:
        return {k.lower(): v for k, v in d.items()}

    top = low(rules)
    custom = []
    for rule in map(low, top.get("rules") or []):
        custom.append(CustomRule(rule.get("category") or "", rule.get("pattern") or "", rule.get("token"), bool(rule.get("ignorecase"))))
    return RedactorOptions(
        level=level or Level.STANDARD, custom=custom, allow=frozenset(top.get("allow") or ()), deny=tuple(top.get("deny") or ()), disabled=frozenset(top.get("disable") or ()),
        stable_tokens=bool(top.get("stabletokens")), token_salt=top.get("tokensalt"), reveal_last=top.get("reveallast") or {}, mask_char=top.get("maskchar") or "*",
    )


def read_options(found: argparse.Namespace) -> ReadOptions:
    from docloom.operators.redaction import Redactor

    redactor = None
    if found.rules is not None:
        with open(found.rules, encoding="utf-8") as source:
            redactor = Redactor(redactor_options(json.load(source), found.redact))
    own = frozenset(os.path.abspath(p) for p in (found.out, found.manifest, found.since) if p)
    return ReadOptions(
        recursion=Recursion.ALL_NESTED if found.recurse else Recursion.TOP_ONLY, max_files=found.max_files, max_bytes_per_file=found.max_bytes, max_text_length=found.max_text,
        include_extensions=frozenset(found.include), exclude_paths=own, redaction=found.redact or Level.OFF, redactor=redactor, content_hash=found.hash,
    )


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("docloom").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _scan(found: argparse.Namespace, spark=None) -> int:
    from docloom.operators import summary
    from docloom.plans import sinks
    from docloom.plans.engine import Engine
    from docloom.sources import manifest

    options = read_options(found)
    if not os.path.isdir(found.folder):
        raise UsageError(f"no such folder: {found.folder}")
    spark = spark or _session()
    engine, removed = Engine(spark, options), None
    if found.since is not None:
        if os.path.exists(found.since):
            baseline = manifest.load(spark, found.since)
        else:
            print(f"no manifest at {found.since}; all files count as new", file=sys.stderr)
            baseline = manifest.empty(spark)
        rescan = engine.read_changes(found.folder, baseline)
        records, removed, entries = rescan.changed.cache(), rescan.removed, rescan.manifest
    else:
        records = engine.read(found.folder).cache()
        entries = engine.new_manifest(records)
    zone = None
    if found.local_time:
        zone = os.environ.get("TZ") or spark._jvm.java.util.TimeZone.getDefault().getID()
    if found.format is OutputFormat.PARQUET:
        sinks.write_parquet(records, os.path.abspath(found.out))
    elif found.out is None:
        sinks.write_to(records, found.format.value, sys.stdout, utc=not found.local_time, zone=zone)
    else:
        with open(found.out, "w", encoding="utf-8", newline="") as out:
            sinks.write_to(records, found.format.value, out, utc=not found.local_time, zone=zone)
    if found.manifest is not None:
        manifest.save_file(entries, found.manifest)
    s = summary.run_summary(records, removed).first()
    gone = f", {s['removed']} removed" if found.since is not None else ""
    print(f"{s['files']} files, {s['redacted']} values redacted, {s['with_warnings']} with warnings{gone}", file=sys.stderr)
    records.unpersist()
    return 0


def main(arguments: list[str] | None = None, spark=None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    if not arguments or arguments[0] in ("--help", "-h", "help"):
        print(parser().format_help().replace("docloom ", "docloom scan ", 1))
        return 0
    if arguments[0] in ("--version", "-v"):
        print(VERSION)
        return 0
    try:
        if arguments[0].lower() != "scan":
            raise UsageError(f"unknown command {arguments[0]!r}")
        return _scan(parse(arguments[1:]), spark)
    except (UsageError, OSError, ValueError) as e:
        print(f"error: {e}\nTry --help.", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
