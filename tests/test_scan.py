import hashlib
import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from docloom import cli
from docloom.operators import incremental, middleware, summary
from docloom.options import ChunkOptions, CustomRule, Level, OutputFormat, ReadOptions, Recursion
from docloom.plans import sinks
from docloom.plans.engine import Engine
from docloom.sources import folder, formats, manifest
from docloom.streaming import scan
from tests import builders


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "in"
    (at / "sub").mkdir(parents=True)
    (at / "a.txt").write_text("mail  jane@x.org\n\nfrom 10.0.0.1")
    (at / "b.bin").write_bytes(b"\0\1")
    (at / "sub" / "c.HTML").write_text("<title>me@y.org</title><p>body</p>")
    (at / "sub" / "bad.docx").write_bytes(b"no zip")
    (at / "long.md").write_text("word " * 6000)
    (at / "big.csv").write_text("x" * 3000)
    (at / "d.docx").write_bytes(builders.docx("Hello"))
    return str(at)


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_records(spark, root):
    out = by_name(Engine(spark, ReadOptions(redaction=Level.STANDARD, content_hash=True, max_bytes_per_file=100_000)).read(root))
    a, c = out["a.txt"], out["c.HTML"]
    assert (a.text, a.redactions, a.folder, a.extension, a.type_bucket, a.warnings) == ("mail [EMAIL] from [IP]", {"Email": 1, "IP": 1}, "in", ".txt", "Text", [])
    assert a.path == os.path.join(root, "a.txt") and a.size_bytes == os.path.getsize(a.path) and a.content_hash == hashlib.sha256(open(a.path, "rb").read()).hexdigest()
    assert c.metadata == {"Title": "[EMAIL]"} and c.redactions == {"Email": 1} and c.text == "body" and c.extension == ".html"
    assert out["b.bin"].text == "" and out["b.bin"].type_bucket == "Other" and out["b.bin"].content_hash and out["b.bin"].warnings == []
    assert out["bad.docx"].warnings == ["extract-failed: BadZipFile"] and out["bad.docx"].text == ""
    assert out["long.md"].warnings == ["text-clipped"] and len(out["long.md"].text) == 20_000
    assert out["d.docx"].metadata["Title"] == "The Title" and abs(a.modified.timestamp() - os.path.getmtime(a.path)) < 1


def test_limits_and_filters(spark, root):
    big = by_name(Engine(spark, ReadOptions(max_bytes_per_file=2000, content_hash=True)).read(root))["big.csv"]
    assert big.warnings == ["skipped-content: 3000 bytes over limit"] and big.content_hash is None and big.text == ""
    assert set(by_name(Engine(spark, ReadOptions(include_extensions={"TXT", ".md"})).read(root))) == {"a.txt", "long.md"}
    assert set(by_name(Engine(spark, ReadOptions(recursion=Recursion.TOP_ONLY)).read(root))) == {"a.txt", "b.bin", "long.md", "big.csv", "d.docx"}
    assert set(by_name(Engine(spark, ReadOptions(exclude_paths={os.path.join(root, "a.txt")}, max_files=0)).read(root))) == {"b.bin", "long.md", "big.csv", "d.docx", "c.HTML", "bad.docx"}
    assert [r["name"] for r in Engine(spark, ReadOptions(max_files=2)).read_stream(root)] == ["a.txt", "b.bin"]
    assert Engine(spark, ReadOptions(include_extensions={".none"})).read(root).count() == 0
    with pytest.raises(FileNotFoundError):
        Engine(spark).read(root + "/missing")
    assert folder.read_parallel(spark, root, ReadOptions(parallelism=3)).rdd.getNumPartitions() <= 3


def test_contents_are_read_once_and_only_where_needed(spark, root, monkeypatch):
    """A listing opens nothing; a scan opens each file that an extractor takes, or that is hashed, once."""
    os.mkfifo(root + "/pipe.bin")  # would never end, if it were opened
    assert "pipe.bin" in by_name(folder.listing(spark, root)) and by_name(Engine(spark).read(root))["pipe.bin"].text == ""
    os.remove(root + "/pipe.bin")
    plan = Engine(spark).read(root)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and plan.count("Scan") == 1
    seen = []

    def counting(path):
        seen.append(os.path.basename(path))
        return open(path, "rb").read()

    monkeypatch.setattr(folder.listed, "opener", lambda: counting)
    rows = folder._described(folder.listed.files(spark, root, True)).toArrow().to_batches()
    for options, want in ((ReadOptions(max_bytes_per_file=2000), ["a.txt", "bad.docx", "c.HTML", "d.docx"]), (ReadOptions(content_hash=True), ["a.txt", "b.bin", "bad.docx", "big.csv", "c.HTML", "d.docx", "long.md"])):
        seen.clear()
        list(folder._open(options)(iter(rows)))
        assert sorted(seen) == want


def test_all_names_empty_files_and_files_that_go(spark, root):
    for name in ("_u.txt", ".d.txt", "sub/_v.md", "empty.txt"):
        with open(f"{root}/{name}", "w") as f:
            f.write("" if name == "empty.txt" else name)
    os.symlink(root + "/nowhere", root + "/gone.txt")
    os.symlink(root, root + "/sub/loop")
    engine = Engine(spark, ReadOptions(content_hash=True))
    out = by_name(engine.read(root))
    assert out["_u.txt"].text == "_u.txt" and out[".d.txt"].text == ".d.txt" and out["_v.md"].folder == "sub" and out["empty.txt"].size_bytes == 0
    assert out["empty.txt"].content_hash == hashlib.sha256(b"").hexdigest() and len(out) == 12
    gone = out["gone.txt"]
    assert gone.warnings == ["stat-failed", "hash-failed", "extract-failed: FileNotFoundError"] and gone.size_bytes == 0 and gone.content_hash is None
    before = engine.new_manifest(engine.read(root)).cache()
    assert before.count() == 12
    open(root + "/a.txt", "w").close()
    found = engine.read_changes(root, before)
    assert set(by_name(found.changed)) == {"a.txt"} and found.removed.count() == 0


def test_oversize_files_without_an_extractor_have_no_warning(spark, root):
    with open(root + "/x.zip", "wb") as f:
        f.write(b"0" * 3000)
    out = by_name(Engine(spark, ReadOptions(max_bytes_per_file=1000, content_hash=True)).read(root))
    assert out["x.zip"].warnings == [] and out["x.zip"].content_hash is None and out["big.csv"].warnings == ["skipped-content: 3000 bytes over limit"]
    files = spark.read.format("binaryFile").load(root + "/x.zip").withColumnsRenamed({"length": "size_bytes", "modificationTime": "modified"})
    assert folder.extracted(folder._described(files), ReadOptions(max_bytes_per_file=1000)).first().warnings == []
    events = summary.diagnostics(Engine(spark, ReadOptions(max_bytes_per_file=1000)).read(root))
    assert [r.event for r in events.collect() if r.path.endswith("x.zip")] == ["read"]


def test_many_folders_are_shared_out(spark, tmp_path):
    want = set()
    for k in range(90):
        at = tmp_path / f"d{k % 70}" / f"e{k % 7}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{k}.txt").write_text(str(k))
        want.add(str(at / f"f{k}.txt"))
    got = [r.path for r in folder.listing(spark, str(tmp_path)).collect()]
    assert len(got) == 90 and set(got) == want
    assert folder.listing(spark, "file://" + str(tmp_path), ReadOptions(recursion=Recursion.TOP_ONLY)).count() == 0
    assert Engine(spark, ReadOptions(parallelism=3)).read(str(tmp_path)).rdd.getNumPartitions() == 3


def test_plain_texts_are_decoded_alike_in_the_jvm(spark, tmp_path):
    cases = {"a.txt": "ünï😀".encode(), "b.txt": b"bad \xff\xc3 x\xe2\x82", "c.csv": b"\xef\xbb\xbfmark", "d.log": "hé".encode("utf-16"), "f.json": b"\xfe\xff\x00h"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    out = by_name(Engine(spark).read(str(tmp_path)))
    assert set(out) == set(cases)
    for name, data in cases.items():
        assert out[name].text == formats.PlainText().extract(name, data).text, name


class Shout:
    def can_handle(self, extension):
        return extension in (".txt", ".bin")

    def extract(self, name, data):
        if name.endswith(".bin"):
            raise KeyError("x")
        return formats.Content({"K": "v"}, "SHOUT")


def test_extractors_of_the_callers(spark, root):
    out = by_name(Engine(spark, ReadOptions(extractors=(Shout(),))).read(root))
    assert out["a.txt"].text == "SHOUT" and out["a.txt"].metadata == {"K": "v"} and out["b.bin"].warnings == ["extract-failed: KeyError"] and out["d.docx"].text == "Hello"


def test_a_redactor_of_the_callers(spark, root):
    class Own:
        def redact(self, text):
            from docloom.operators.redaction import Result

            return Result((text or "").replace("mail", "<m>"), {"Mail": 1} if "mail" in (text or "") else {}, [])

    out = by_name(Engine(spark, ReadOptions(redactor=Own(), redaction=Level.AGGRESSIVE)).read(root))
    assert out["a.txt"].text.startswith("<m> jane@x.org") and out["a.txt"].redactions == {"Mail": 1}


def test_re_scan(spark, root):
    engine = Engine(spark, ReadOptions(content_hash=True))
    first = engine.new_manifest(engine.read(root)).cache()
    first.count()
    with open(root + "/a.txt", "a") as f:
        f.write(" more")
    os.utime(root + "/d.docx", (time.time() + 50, time.time() + 50))
    os.remove(root + "/b.bin")
    with open(root + "/new.txt", "w") as f:
        f.write("new")
    found = engine.read_changes(root, first)
    assert set(by_name(found.changed)) == {"a.txt", "d.docx", "new.txt"}
    assert [os.path.basename(r.path) for r in found.removed.collect()] == ["b.bin"]
    old = {r.path: r for r in first.collect()}
    entries = {r.path: r for r in found.manifest.collect()}
    assert len(entries) == 7 and entries[root + "/big.csv"] == old[root + "/big.csv"] and entries[root + "/a.txt"].content_hash != old[root + "/a.txt"].content_hash
    assert Engine(spark, ReadOptions(include_extensions={".txt"})).read_changes(root, first).removed.count() == 6
    assert Engine(spark).read_changes(root, engine.empty_manifest()).changed.count() == 7
    with pytest.raises(ValueError):
        engine.read_changes(root, None)


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.sql("select 'z\tq' as path, 1L as size_bytes, timestamp'2026-07-19 10:00:00.123456' as modified, cast(null as string) as content_hash union all select 'a', 2L, timestamp'1999-01-01 00:00:00', 'h'")
    path = str(tmp_path / "m.txt")
    manifest.save_file(rows, path)
    lines = open(path).read().split("\n")
    assert lines[0].startswith("# ") and lines[1].endswith("\ta") and lines[-1] == ""
    assert sorted(manifest.load(spark, path).collect()) == sorted(rows.collect())
    manifest.save(rows, str(tmp_path / "m"))
    assert sorted(manifest.load(spark, str(tmp_path / "m")).collect()) == sorted(rows.collect())
    bad = spark.createDataFrame([("",), ("# c",), ("1\t2\t3",), ("x\t1\t\tp",), ("1\t-5\t\tp",), ("1\t99999999999999999999\t\tp",), ("7\t621355968000000000\t\tp",), ("8\t621355968000000000\th\tp",)], "value string")
    assert [(r.path, r.size_bytes, r.content_hash) for r in manifest.parsed(bad.coalesce(1)).collect()] == [("p", 8, "h")]


def test_sinks(spark, root, tmp_path):
    records = Engine(spark, ReadOptions(redaction=Level.STANDARD)).read(root).cache()
    for kind in ("csv", "json", "jsonl"):
        out = io.StringIO()
        sinks.write_to(records, kind, out)
        text = out.getvalue()
        if kind == "csv":
            assert text.split("\r\n")[0] == sinks.CSV_HEADER and text.endswith("\r\n") and text.count("\r\n") == 8
        else:
            rows = json.loads(text) if kind == "json" else [json.loads(x) for x in text.splitlines()]
            assert len(rows) == 7 and list(rows[0]) == "path name extension folder sizeBytes modified typeBucket metadata text redactions warnings contentHash".split()
            assert rows[0]["redactions"] == {"Email": 1, "IP": 1} and rows[0]["contentHash"] is None
    sinks.write_parquet(records, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.columns == [n for _, n in sinks.FLAT] and back.where("Redactions = 'Email:1;IP:1'").count() == 1
    sinks.write_parquet(folder.empty_records(spark), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    sinks.write_csv(records, str(tmp_path / "c"))
    sinks.write_json_lines(sinks.record_json(records), str(tmp_path / "j"), "path")
    assert spark.read.text(str(tmp_path / "j")).count() == 7
    row = spark.createDataFrame([('q"\\\n\t\u001fé/', {"Author": "J"})], "text string, metadata map<string,string>").selectExpr("'p' as path", "'n' as name", "'Text' as type_bucket", "0 as index", "1 as count", "0 as start_offset", "text", "metadata")
    line = sinks.chunk_json(row).first().value
    assert json.loads(line)["text"] == 'q"\\\n\t\x1fé/' and "u001f" in line and "é/" in line
    assert sinks.memory_rows(row).first().asDict() == {"chunk_id": "p#chunk0", "text": 'q"\\\n\t\u001fé/', "description": "n", "metadata_json": '{"Author":"J"}'}


def test_import_hands_batches_to_a_store(spark, root, tmp_path):
    at = str(tmp_path / "store")
    os.mkdir(at)

    def save(rows):
        import uuid

        with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(r["chunk_id"] for r in rows))

    Engine(spark).import_folder(root, save, ChunkOptions(max_chars=5000))
    ids = [x for n in os.listdir(at) for x in open(f"{at}/{n}").read().split("\n")]
    assert len([i for i in ids if "long.md#chunk" in i]) == 5 and not any("b.bin" in i for i in ids)
    sinks.upsert(folder.empty_records(spark), lambda rows: 1 / 0)


def test_summary_and_events(spark, root):
    records = Engine(spark, ReadOptions(redaction=Level.STANDARD)).read(root).cache()
    assert summary.run_summary(records).first().asDict() == {"files": 7, "redacted": 3, "with_warnings": 2, "removed": 0}
    assert summary.leak_gate(records).first().failed is True and summary.leak_gate(records.limit(0)).first().failed is False
    assert {r.category: r.n_values for r in summary.counts_by_category(records).collect()} == {"Email": 2, "IP": 1}
    events = summary.diagnostics(records, spark.createDataFrame([("u",)], "path string"))
    got = [(os.path.basename(r.path), r.event, r.message, r.is_warning) for r in events.orderBy("path", "ordinal").collect()]
    assert ("a.txt", "read", "Text, 22 chars", False) in got and ("u", "unchanged", "as in the manifest", False) in got
    assert [g[1:] for g in got if g[0] == "bad.docx"] == [("extract-failed", "extract-failed: BadZipFile", True)]
    assert [g[1] for g in got if g[0] == "long.md"] == ["text-clipped", "read"]
    seen = []
    summary.log(events, sink=seen.append)
    assert len(seen) == len(got)
    summary.log(events)


def test_one_engine_a_session(spark):
    one = Engine.get_or_create(spark, lambda s: ReadOptions(max_files=5))
    assert Engine.get_or_create(spark, ReadOptions(max_files=9)) is one and one.options.max_files == 5


def test_stream_takes_new_files_once(spark, root, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    save = lambda df, _: df.select("name", "text").write.mode("append").parquet(out)
    for want in (7, 8):
        scan.run_available(scan.record_stream(spark, root, ReadOptions(redaction=Level.STANDARD)), mark, save).awaitTermination()
        assert spark.read.parquet(out).count() == want
        with open(root + "/later.txt", "w") as f:
            f.write("later")
    assert spark.read.parquet(out).where("name = 'a.txt'").first().text == "mail [EMAIL] from [IP]"


def test_middleware(spark):
    rows = [("user", "a@b.com"), ("assistant", "a@b.com"), ("system", None), ("user", "")]
    df = spark.createDataFrame(rows, "role string, text string")
    assert [r.text for r in middleware.chat_redacted(df).collect()] == ["[EMAIL]", "a@b.com", None, ""]
    assert [r.text for r in middleware.chat_redacted(df, user_only=False).collect()] == ["[EMAIL]", "[EMAIL]", None, ""]
    assert [r.text for r in middleware.embedding_inputs(df).collect()] == ["[EMAIL]", "[EMAIL]", "", ""]
    assert df.transform(middleware.redaction()).where("text = '[EMAIL]'").count() == 2


def test_merge_prefers_new_entries(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2)], "path string, size_bytes long").withColumn("modified", F.current_timestamp()).withColumn("content_hash", F.lit("x"))
    assert {r.path: r.size_bytes for r in incremental.merged(a, a.where("path = 'p'").withColumn("size_bytes", F.lit(9).cast("long"))).collect()} == {"p": 9, "q": 2}


def run_cli(spark, capsys, *args):
    code = cli.main(list(args), spark)
    got = capsys.readouterr()
    return code, got.out, got.err


def test_command_line(spark, root, tmp_path, capsys):
    code, out, err = run_cli(spark, capsys, "scan", root, "--format", "jsonl", "--redact", "--hash")
    rows = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and len(rows) == 7 and rows[0]["text"] == "mail [EMAIL] from [IP]" and rows[0]["contentHash"] and "7 files, 3 values" in err
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"Rules": [{"category": "Greeting", "pattern": "mail", "ignoreCase": True}], "disable": ["ip"], "allow": ["jane@x.org"], "deny": ["body"]}))
    target, mark = str(tmp_path / "t.csv"), str(tmp_path / "m.txt")
    assert run_cli(spark, capsys, "scan", root, "--rules", str(rules), "--out", target, "--manifest", mark, "--include=txt,html", "--local-time")[0] == 0
    text = open(target, newline="").read()
    assert text.startswith("Path,Name") and "[GREETING] jane@x.org from 10.0.0.1" in text and "[REDACTED]" in text and text.count("\r\n") == 3
    assert len(open(mark).read().splitlines()) == 3
    code, out, err = run_cli(spark, capsys, "scan", root, "--since", mark, "--format=json", "--include", "txt", "--no-recurse")
    assert code == 0 and out == "[]" and "1 removed" in err
    assert "all files count as new" in run_cli(spark, capsys, "scan", root, "--since", str(tmp_path / "none"), "--max-files", "1")[2]
    assert run_cli(spark, capsys, "scan", root, "--out", str(tmp_path / "x.parquet"))[0] == 0 and spark.read.parquet(str(tmp_path / "x.parquet")).count() == 7


@pytest.mark.parametrize("args", [("scan",), ("other",), ("scan", "/nope/nope"), ("scan", ".", "--format", "xml"), ("scan", ".", "--format=parquet"), ("scan", ".", "--max-files=-1"), ("scan", ".", "--redact=loud"), ("scan", ".", "b"), ("scan", ".", "--what"), ("scan", ".", "--out")])
def test_bad_arguments(spark, capsys, args):
    code, out, err = run_cli(spark, capsys, *args)
    assert code == 1 and not out and err.startswith("error: ")


def test_help_and_parsing(spark, capsys):
    for args in ((), ("--help",), ("--version",)):
        assert run_cli(spark, capsys, *args)[0] == 0
    assert cli.parse(["d", "--out", "x.ndjson"]).format is OutputFormat.JSON_LINES and cli.parse(["d", "--out", "x.json", "--format=csv"]).format is OutputFormat.CSV
    assert cli.parse(["--redact", "d"]).folder == "d" and cli.parse(["--redact=aggressive", "d"]).redact is Level.AGGRESSIVE
    o = cli.redactor_options({"STABLETOKENS": True, "tokenSalt": "s", "revealLast": {"Card": 4}, "maskChar": "#", "rules": [{"category": "A", "pattern": "b"}]}, None)
    assert o.stable_tokens and o.token_salt == "s" and o.reveal_last == {"card": 4} and o.mask_char == "#" and o.custom == (CustomRule("A", "b"),)
