"""Files from end to end: scanning, errors, sinks, detection, command line."""

import io
import json
import sqlite3
import struct
import zipfile

import pytest
import yaml

from flatspark import cli
from flatspark.operators.detect import detect
from flatspark.operators.infer import infer_frame, infer_layout
from flatspark.operators.rules import check
from flatspark.operators.validate import rejects, validate, values_of
from flatspark.plans.layout import LIBRARY, LayoutError, build_layout
from flatspark.sinks.text import write_single
from flatspark.sources.flat import InvalidRecords, read_flat, scan
from flatspark.sources import framed
from flatspark.sources.framed import frames, scan_frames
from flatspark.sources.lines import first_lines, scan_lines

AR = f"{LIBRARY}/jde_ar.yaml"


def ar(key=1, name="ACME", date="20250115", amount="00012345", currency="USD"):
    return f"{key:010d}{name:<15}{date}{amount:>8}{currency}".encode("cp850")


def field(name, start, length, kind="string", **more):
    return {"name": name, "start": start, "length": length, "type": kind, **more}


def layout(fields, **more):
    return build_layout({"format": "t", "version": "1", "codepage": "utf-8", "fields": fields, **more})


@pytest.fixture
def ar_file(tmp_path):
    path = tmp_path / "ar.txt"
    path.write_bytes(b"\n".join([ar(1), ar(2, date="20251301", amount="12X4"), b"0000000003", ar(4, "O'BRIEN CO", amount="-9900")]) + b"\n")
    return str(path)


def test_lines_are_physical(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_bytes(b"a\r\n\n  \n\r\n\xff\x00b\rc\nlast")
    got = scan_lines(spark, str(path)).orderBy("line").collect()
    assert [(r.line, bytes(r.record)) for r in got] == [(1, b"a"), (3, b"  "), (5, b"\xff\x00b\rc"), (6, b"last")]


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_bytes(b"".join(b"\n" if i % 7 == 0 else b"%s%d\n" % (name.encode(), i) for i in range(1, 3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = scan_lines(spark, [str(tmp_path / n) for n in "ab"], skip_first=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2 * (2999 - 428 - 1)
    assert all(r.line == int(bytes(r.record)[1:]) and r.line > 1 for r in got)


def test_errors_are_cumulative(spark, ar_file):
    from flatspark.plans.layout import load_layout

    lay = load_layout(AR)
    checked = validate(scan(spark, ar_file, lay), lay)
    assert [r.line for r in checked.where("ok").orderBy("line").collect()] == [1, 4]
    bad = {r.line: r.error for r in rejects(checked).collect()}
    assert bad[2].count("; ") == 1 and "month must be" in bad[2] and "'    12X4'" in bad[2]
    assert bad[3].startswith("length 10 != record_length 44; ") and bad[3].count("out of range (short line)") == 4
    assert [str(r[3]) for r in values_of(checked).orderBy("id").collect()] == ["123.45", "-99.00"]
    report = check(checked, lay)
    assert (report.total, report.ok, report.errors) == (4, 2, 2)


def test_read_flat_modes(spark, ar_file):
    with pytest.raises(InvalidRecords, match="line 2"):
        read_flat(spark, ar_file, AR)
    assert read_flat(spark, ar_file, AR, on_error="ignore").count() == 2
    with pytest.raises(Exception, match="line 2"):
        read_flat(spark, ar_file, AR, on_error="fail_lazily").collect()
    assert len(read_flat(spark, ar_file, on_error="ignore", backend="pandas")) == 2  # layout detected
    with pytest.raises(ValueError, match="unsupported backend"):
        read_flat(spark, ar_file, AR, backend="x")


def test_undecodable_bytes(spark, tmp_path):
    lay = layout([field("a", 0, 2)], record_length=2)
    (tmp_path / "f").write_bytes(b"ok\n\xff\xfe\n")
    records = scan(spark, str(tmp_path / "f"), lay)
    with pytest.raises(Exception, match="undecodable"):
        values_of(validate(records, lay)).collect()
    assert [(r.line, r.ok) for r in validate(records, lay, on_decode_error="record").orderBy("line").collect()] == [(1, True), (2, False)]


def test_delimited(spark, tmp_path):
    lay = build_layout({"format": "delimited", "version": "1", "codepage": "utf-8", "delimiter": "||", "has_header": True, "fields": [{"name": "a", "type": "string"}, {"name": "n", "type": "decimal", "scale": 2}]})
    (tmp_path / "f").write_bytes(b'\nh1||h2\n"x"|| 100 \nonly\n a ||1.5||z\n')
    got = validate(scan(spark, str(tmp_path / "f"), lay), lay).orderBy("line").collect()
    assert [(r.line, r.ok) for r in got] == [(3, True), (4, False), (5, False)]
    assert (got[0].value.a, str(got[0].value.n)) == ('"x"', "1.00")
    assert got[1].errors == ["field 'n': missing column (1 columns in line)"]
    assert got[2].errors == ["3 columns in line, schema expects 2"]


@pytest.mark.parametrize(
    "change,message",
    [({"version": None}, "version"), ({"codepage": "klingon"}, "codepage"), ({"fields": []}, "fields"), ({"record_length": 3}, "a"), ({"table": "1x"}, "table"), ({"rules": [{"type": "odd"}]}, "rule"), ({"rules": [{"type": "sum"}]}, "sum"), ({"parser": 5}, "parser")],
)
def test_layout_errors(change, message):
    data = {"format": "t", "version": "1", "codepage": "utf-8", "record_length": 4, "fields": [field("a", 0, 4)]} | change
    with pytest.raises(LayoutError, match=message):
        build_layout({k: v for k, v in data.items() if v is not None})


def test_layout_overlap():
    with pytest.raises(LayoutError, match="b"):
        layout([field("a", 0, 4), field("b", 2, 2)], record_length=4)


def test_frames(spark, tmp_path):
    good = b"".join(struct.pack(">H", len(p)) + p for p in (b"ab", b"", b"xyz"))
    (tmp_path / "g").write_bytes(good)
    assert [(r.line, bytes(r.record)) for r in scan_frames(spark, str(tmp_path / "g")).orderBy("line").collect()] == [(1, b"ab"), (3, b"xyz")]
    for cut in (good[:-1], good + b"\x00"):
        with pytest.raises(ValueError, match="truncated"):
            list(frames(io.BytesIO(cut)))


def test_detection(spark, tmp_path, ar_file):
    assert detect(spark, ar_file).path == AR
    (tmp_path / "free").write_text("hello world\n")
    assert detect(spark, str(tmp_path / "free")) is None


def test_inference(spark, tmp_path):
    (tmp_path / "f.csv").write_text("date,amount,customer,currency\n20250101,10.50,A,USD\n20250102,7-,B,EUR\n\nx\n")
    got = infer_layout(spark, str(tmp_path / "f.csv"))
    assert [(f["name"], f["type"], f.get("scale")) for f in got["fields"]] == [("date", "date", None), ("amount", "decimal", 2), ("customer", "string", None), ("currency", "string", None)]
    assert got["has_header"] and build_layout(got).delimiter == ","
    for lines in ([], ["single"], ["a,b", "c"]):
        with pytest.raises(ValueError):
            infer_frame(spark.createDataFrame(list(enumerate(lines)), "n bigint, text string"), "f")


@pytest.mark.parametrize(
    "text,delimiter,header,fields",
    [
        ("a;b\n1;x\n", ";", True, [("a", "decimal", 0), ("b", "string", None)]),
        ("1;x\n2;y\n", ";", False, [("column_0", "decimal", 0), ("column_1", "string", None)]),
        ("n,nan\n1.5-,inf\n", ",", False, [("column_0", "string", None), ("column_1", "decimal", 0)]),
        ("k\tK\n1\t2\n", "\t", False, [("column_0", "string", None), ("column_1", "string", None)]),
        ("a|b|c\n1.25|20250230|\n.5|20250228|\n", "|", True, [("a", "decimal", 2), ("b", "decimal", 0), ("c", "string", None)]),
        ("x, \n1,2\n", ",", False, [("column_0", "string", None), ("column_1", "decimal", 0)]),
        ("d,v\n20250101,1_000\n20250102, 7 \n", ",", True, [("d", "date", None), ("v", "decimal", 0)]),
    ],
)
def test_inferred_columns(spark, tmp_path, text, delimiter, header, fields):
    (tmp_path / "f").write_text(text)
    for sample in (50, None):
        got = infer_layout(spark, str(tmp_path / "f"), sample_lines=sample)
        assert (got["delimiter"], got["has_header"]) == (delimiter, header)
        assert [(f["name"], f["type"], f.get("scale")) for f in got["fields"]] == fields


def test_heads_read_one_split(spark, tmp_path):
    """Detection and inference look at the first lines only, in one task however large the file is."""
    (tmp_path / "big").write_bytes((ar(1) + b"\n") * 20_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.sparkContext.setJobGroup("head", "head")
    try:
        assert spark.read.text(str(tmp_path / "big")).rdd.getNumPartitions() > 8
        assert len(first_lines(spark, str(tmp_path / "big"), 5, True)) == 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.sparkContext.setJobGroup("", "")
    seen = spark.sparkContext.statusTracker()
    stages = [i for job in seen.getJobIdsForGroup("head") for i in seen.getJobInfo(job).stageIds]
    assert [seen.getStageInfo(i).numTasks for i in stages] == [1]


def test_scan_reads_files_twice_and_keeps_its_splits(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"".join(b"%d\n" % i for i in range(1, 20_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.sparkContext.setJobGroup("scan", "scan")
    try:
        lines = scan_lines(spark, str(tmp_path / "f"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    splits = lines.rdd.getNumPartitions()
    assert splits > 8
    assert lines.where("CAST(record AS string) = CAST(line AS string)").count() == 20_000
    spark.sparkContext.setJobGroup("", "")
    seen = spark.sparkContext.statusTracker()
    tasks = [seen.getStageInfo(i).numTasks for job in seen.getJobIdsForGroup("scan") for i in seen.getJobInfo(job).stageIds if seen.getStageInfo(i) and seen.getStageInfo(i).numCompletedTasks]
    assert tasks.count(splits) == 2  # one pass for the counts, one for the rows


def test_texts_are_computed_once(spark):
    lay = layout([field("a", 0, 10), field("d", 10, 8, "date", format="YYYYMMDD"), field("n", 18, 9, "decimal", scale=2), field("m", 27, 9, "decimal", scale=2), field("c", 36, 3)], record_length=39, codepage="cp850")
    records = spark.createDataFrame([("s", 1, b"x" * 39)], "source string, line bigint, record binary")
    plan = values_of(validate(records, lay))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 1 and plan.count("trim(") <= 4 * 5 and len(plan) < 20_000


def test_frames_of_large_files_are_streamed(spark, tmp_path, monkeypatch):
    (tmp_path / "g").write_bytes(b"".join(struct.pack(">H", 3) + b"abc" for _ in range(500)))
    whole = scan_frames(spark, str(tmp_path / "g")).orderBy("line").collect()
    monkeypatch.setattr(framed, "WHOLE", 100)
    streamed = scan_frames(spark, str(tmp_path / "g")).orderBy("line").collect()
    assert [(r.line, r.record) for r in whole] == [(r.line, r.record) for r in streamed] and len(whole) == 500


PLUGIN = """
class Reader:
    def __init__(self, layout, path):
        self.path = path

    def records(self, skip_first=False):
        with open(self.path, "rb") as f:
            for n, part in enumerate(f.read().split(b"#"), 1):
                if not (skip_first and n == 1):
                    yield n, part
"""


def test_plugins(spark, tmp_path, capsys):
    folder = tmp_path / "plugins"
    folder.mkdir()
    (folder / "hashes.py").write_text(PLUGIN)
    (folder / "_hidden.py").write_text("")
    (folder / "empty.py").write_text("x = 1")
    assert [p.name for p in framed.discover(str(folder))] == ["empty", "hashes"]
    with pytest.raises(framed.PluginError, match="not found"):
        framed.load_reader("none", str(folder))
    with pytest.raises(framed.PluginError, match="Reader"):
        framed.load_reader("empty", str(folder))
    lay = layout([field("a", 0, 2)], parser="hashes")
    (tmp_path / "f").write_bytes(b"ab##cd")
    got = scan(spark, str(tmp_path / "f"), lay, str(folder)).orderBy("line").collect()
    assert [(r.line, bytes(r.record)) for r in got] == [(1, b"ab"), (3, b"cd")]
    assert [r.a for r in read_flat(spark, str(tmp_path / "f"), lay, plugins_dir=str(folder)).collect()] == ["ab", "cd"]
    (tmp_path / "p.yaml").write_text(yaml.safe_dump({"format": "x", "version": "1", "parser": "nowhere", "fields": [field("a", 0, 2)]}))
    assert cli.main(["--schema", str(tmp_path / "p.yaml"), "--input", str(tmp_path / "f"), "--output", str(tmp_path / "o"), "--plugins-dir", str(folder)]) == cli.ERROR
    assert "plugin error" in capsys.readouterr().err


def test_generate_schema_command(spark, tmp_path, capsys):
    (tmp_path / "f.csv").write_text("id,amount\nA,1.5\nB,2\n")
    out = tmp_path / "s.yaml"
    assert cli.main(["generate-schema", str(tmp_path / "f.csv"), "--output", str(out), "--name", "t"]) == cli.OK
    made = yaml.safe_load(out.read_text())
    assert made["table"] == "t" and made["has_header"] and [f["type"] for f in made["fields"]] == ["string", "decimal"]
    assert cli.main(["--schema", str(out), "--input", str(tmp_path / "f.csv"), "--output", str(tmp_path / "o.json")]) == cli.OK
    assert json.load(open(tmp_path / "o.json")) == [{"id": "A", "amount": 1.5}, {"id": "B", "amount": 0.2}]
    assert cli.main(["generate-schema", str(tmp_path / "f.csv"), "--output", str(out), "--no-header"]) == cli.OK
    assert [f["name"] for f in yaml.safe_load(out.read_text())["fields"]] == ["column_0", "column_1"]
    (tmp_path / "free").write_text("no delimiter here\n")
    assert cli.main(["generate-schema", str(tmp_path / "free"), "--output", str(out)]) == cli.ERROR
    assert "generate-schema error" in capsys.readouterr().err


def test_registry_command(spark, tmp_path, capsys):
    assert cli.main(["registry", str(tmp_path)]) == cli.ERROR
    text = open(AR).read()
    (tmp_path / "a.yaml").write_text(text)
    (tmp_path / "b.yaml").write_text(text)
    assert cli.main(["registry", str(tmp_path)]) == cli.OK
    said = capsys.readouterr()
    assert "duplicate jde_fixed_width@1.0.0" in said.err and said.out.splitlines()[0].split() == ["format", "version", "len", "table", "fields", "source"] and len(said.out.splitlines()) == 3
    (tmp_path / "c.yaml").write_text("format: x\n")
    assert cli.main(["registry", str(tmp_path)]) == cli.SCHEMA
    assert "INVALID" in capsys.readouterr().err


def test_web(spark, tmp_path, ar_file):
    from http.server import ThreadingHTTPServer
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen
    import threading

    from flatspark.web import Handler

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, **body):
        try:
            with urlopen(Request(at + path, json.dumps(body).encode())) as got:
                return got.status, json.load(got)
        except HTTPError as e:
            return e.code, json.load(e)

    try:
        assert b"<h1>" in urlopen(at).read()
        (tmp_path / "f.csv").write_text("id;n\na;1\n")
        status, made = ask("/api/generate", input=str(tmp_path / "f.csv"))
        assert status == 200 and made["delimiter"] == ";" and made["has_header"]
        status, done = ask("/api/convert", input=str(tmp_path / "f.csv"), schema=made["schema"], format="json")
        assert status == 200 and done["exit_code"] == cli.OK and done["preview"] == [{"id": "a", "n": 1.0}]
        status, done = ask("/api/convert", input=ar_file, schema=open(AR).read(), format="csv")
        assert done["exit_code"] == cli.VALIDATION and "line 3" in done["stderr"]
        assert ask("/api/convert", input=ar_file, schema="format: x")[1]["exit_code"] == cli.SCHEMA
        assert ask("/api/convert", input="/no/such")[0] == 400
        assert ask("/api/none")[0] == 404
    finally:
        server.shutdown()


def test_distributed_conversion(spark, tmp_path, ar_file):
    from flatspark.plans.conversion import convert_distributed
    from flatspark.plans.layout import load_layout

    report = convert_distributed(spark, ar_file, load_layout(AR), "ndjson", f"file://{tmp_path}/out")
    assert (report.total, report.ok, report.errors) == (4, 2, 2)
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_audit_digests(tmp_path):
    import hashlib

    from flatspark.audit import sha256_of

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"1")
    (tmp_path / "d" / "b").write_bytes(b"2")
    (tmp_path / "d" / "_SUCCESS").write_bytes(b"3")
    assert sha256_of(str(tmp_path / "d")) == sha256_of(f"file://{tmp_path}/d") == hashlib.sha256(b"12").hexdigest()
    with pytest.raises(OSError):
        sha256_of(str(tmp_path / "none"))


def test_exit_code_of_a_batch(spark, tmp_path):
    (tmp_path / "1.txt").write_bytes(ar(1) + b"\n")
    (tmp_path / "2.txt").write_bytes(b"short\n")
    args = ["--input", str(tmp_path / "*.txt"), "--output", "x", "--output-dir", str(tmp_path)]
    assert cli.main(["--schema", AR, *args]) == cli.VALIDATION
    assert cli.main(args) == cli.ERROR  # the second file has no layout
    assert cli.main(["--schema", AR, *args[:4]]) == cli.ERROR


@pytest.mark.parametrize("fmt", ["json", "csv", "ndjson", "sql", "singer", "excel", "parquet"])
def test_sinks(spark, tmp_path, ar_file, fmt):
    from flatspark.plans.layout import load_layout

    lay = load_layout(AR)
    out = str(tmp_path / f"out.{fmt}")
    write_single(validate(scan(spark, ar_file, lay), lay), lay, fmt, out)
    names = [f.name for f in lay.fields]
    if fmt == "parquet":
        assert sorted(str(r[3]) for r in spark.read.parquet(out).collect()) == ["-99.00", "123.45"]
        return
    if fmt == "excel":
        with zipfile.ZipFile(out) as z:
            assert "O'BRIEN CO" in "".join(z.read(n).decode() for n in z.namelist() if n.endswith(".xml"))
        return
    text = open(out, encoding="utf-8").read()
    if fmt == "json":
        assert [r[names[3]] for r in json.loads(text)] == [123.45, -99.0] and text.startswith("[\n  {")
    elif fmt == "ndjson":
        assert [json.loads(x)[names[3]] for x in text.splitlines()] == [123.45, -99.0]
    elif fmt == "csv":
        assert text.splitlines()[0] == ",".join(names) and text.splitlines()[2].split(",")[3] == "-99.0"
    elif fmt == "singer":
        assert [json.loads(x)["type"] for x in text.splitlines()] == ["SCHEMA", "RECORD", "RECORD", "STATE"]
    else:
        db = sqlite3.connect(":memory:")
        db.execute(f'CREATE TABLE "{lay.table or "export"}" ({", ".join(names)})')
        db.executescript(text)
        assert db.execute(f'SELECT "{names[1]}" FROM "{lay.table or "export"}"').fetchall() == [("ACME",), ("O'BRIEN CO",)]


def test_command_line(spark, tmp_path, ar_file, capsys):
    good = tmp_path / "good.txt"
    good.write_bytes(ar(1) + b"\n" + ar(2) + b"\n")
    out = str(tmp_path / "o.json")
    assert cli.main(["--schema", AR, "--input", str(good), "--output", out, "--checksum"]) == cli.OK
    assert len(json.load(open(out))) == 2 and "records_ok" in open(out + ".sha256").read()
    assert cli.main(["--input", ar_file, "--output", out, "--verbose"]) == cli.VALIDATION
    assert "line 3" in capsys.readouterr().err
    assert cli.main(["--schema", str(tmp_path / "none.yaml"), "--input", str(good), "--output", out]) == cli.SCHEMA
    assert cli.main(["--schema", AR, "--input", str(tmp_path / "none"), "--output", out]) == cli.ERROR
    assert cli.main(["--input", str(tmp_path / "*.zzz"), "--output", out]) == cli.ERROR
    (tmp_path / "d").mkdir()
    assert cli.main(["--schema", AR, "--input", str(tmp_path / "*.txt"), "--output", "x", "--output-dir", str(tmp_path / "d"), "--format", "csv"]) == cli.VALIDATION
    assert (tmp_path / "d" / "good.csv").exists()
    assert cli.main(["registry", LIBRARY]) == cli.OK
    dry = tmp_path / "dry.json"
    assert cli.main(["--schema", AR, "--input", str(good), "--output", str(dry), "--dry-run"]) == cli.OK and not dry.exists()


def test_rules_and_exit_code(spark, tmp_path):
    data = yaml.safe_load(open(AR)) | {"rules": [{"type": "sum", "field": "amount", "expected": 246.9}]}
    data["rules"][0]["field"] = next(f["name"] for f in data["fields"] if f.get("type") == "decimal")
    (tmp_path / "r.yaml").write_text(yaml.safe_dump(data))
    (tmp_path / "a.txt").write_bytes(ar(1) + b"\n" + ar(2) + b"\n")
    args = ["--schema", str(tmp_path / "r.yaml"), "--input", str(tmp_path / "a.txt"), "--output", str(tmp_path / "o")]
    assert cli.main(args) == cli.OK
    data["rules"][0]["expected"] = 1
    (tmp_path / "r.yaml").write_text(yaml.safe_dump(data))
    assert cli.main(args) == cli.VALIDATION


def test_standard_output(spark, ar_file, tmp_path):
    from flatspark.plans.conversion import convert
    from flatspark.plans.layout import load_layout

    out = io.StringIO()
    done = convert(spark, ar_file, load_layout(AR), "ndjson", "-", stdout=out)
    assert len(out.getvalue().splitlines()) == 2 == done.report.errors


def test_whole_file_inference_takes_two_passes(spark, tmp_path):
    """Each line of a whole file is read twice, however many splits the file has."""
    (tmp_path / "whole").write_text("id,day,amount\n" + "".join(f"{i},202501{i % 28 + 1:02d},{i}.5\n" for i in range(20_000)) + "7,20250101,1.125\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.sparkContext.setJobGroup("whole", "whole")
    try:
        splits = spark.read.text(str(tmp_path / "whole")).rdd.getNumPartitions()
        got = infer_layout(spark, str(tmp_path / "whole"), sample_lines=None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.sparkContext.setJobGroup("", "")
    assert [(f["name"], f["type"], f.get("scale")) for f in got["fields"]] == [("id", "decimal", 0), ("day", "date", None), ("amount", "decimal", 3)]
    seen = spark.sparkContext.statusTracker()
    stages = {i for job in seen.getJobIdsForGroup("whole") for i in seen.getJobInfo(job).stageIds}
    assert splits > 8 and [n for i in stages if (n := seen.getStageInfo(i).numCompletedTasks) >= splits] == [splits] * 2


def test_inference_over_files(spark, tmp_path):
    """Each file's first filled line may be its header, whatever lines are blank before it."""
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_text("k;v\n1;x\n")
    (tmp_path / "d" / "b").write_text(" \n\nk;v\n2.25;\n" + "3;y\n" * 50)
    got = infer_layout(spark, str(tmp_path / "d"), sample_lines=None)
    assert got["has_header"] and [(f["name"], f["type"], f.get("scale")) for f in got["fields"]] == [("k", "decimal", 2), ("v", "string", None)]


@pytest.mark.parametrize(
    "cell,kind,scale",
    [("i_nf", "decimal", 0), ("_1", "decimal", 0), (" 1.50-", "decimal", 2), ("+.5e1", "decimal", 3), ("\u20031\u2003", "decimal", 0), ("snan12", "decimal", 0), ("1-5", "string", None), ("--", "string", None), ("20250229", "decimal", 0), ("00000101", "decimal", 0), ("2024022\u0669", "string", None), (" 20240229", "decimal", 0), ("20240229", "date", None), ("\x7f1", "string", None), ("\x85", "string", None)],
)
def test_inferred_cells(spark, cell, kind, scale):
    got = infer_frame(spark.createDataFrame([(0, "a|b"), (1, f"x|{cell}"), (2, "y|")], "n bigint, text string"), "f")
    assert (got["has_header"], got["fields"][1]["type"], got["fields"][1].get("scale")) == (True, kind, scale)
