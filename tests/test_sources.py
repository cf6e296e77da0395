"""Sources and sinks (2.1)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from proofloom.sources import items as SRC
from proofloom.sources import sinks as SNK


def item(i, **over):
    d = {"id": f"it_{i}", "topic": "algebra.basic", "english": {"statement": f"s{i}", "steps": ["first step here"]},
         "lean": {"imports": [], "theorem": f"theorem t{i} : True := trivial"}}
    d.update(over)
    return json.dumps(d, ensure_ascii=False)


def write(path, lines, trailing_newline=True):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + ("\n" if trailing_newline else ""))
    return path


def test_scan_items_skips_blank_lines(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "a.jsonl"), [item(1), "", "   ", item(2), item(3)], trailing_newline=False)
    df = SRC.scan_items(spark, p)
    assert sorted(r.id for r in df.collect()) == ["it_1", "it_2", "it_3"]


def test_missing_imports_is_empty_list(spark, tmp_dir):
    d = json.loads(item(1))
    del d["lean"]["imports"]
    p = write(os.path.join(tmp_dir, "a.jsonl"), [json.dumps(d)])
    assert SRC.scan_items(spark, p).first().lean.imports == []
    assert SRC.scan_strict(spark, p).first().lean.imports == []


def test_missing_path(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        SRC.scan_items(spark, os.path.join(tmp_dir, "nope.jsonl"))


def test_strict_reports_line_number(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "a.jsonl"), [item(1), "", item(2), "{not json", item(4)])
    with pytest.raises(ValueError, match=r"line 4"):
        SRC.scan_strict(spark, p)


@pytest.mark.parametrize(
    "bad,reason",
    [
        (lambda: item(1, id=5), "id: expected a string"),
        (lambda: item(1, lean={"imports": None, "theorem": "theorem x : True := trivial"}), "lean.imports"),
        (lambda: item(1, lean={"imports": ["A", 3], "theorem": "theorem x : True := trivial"}), "lean.imports"),
        (lambda: item(1, id="bad id"), "Invalid ID format"),
        (lambda: item(1, english={"statement": "s", "steps": ["ok step", "tiny"]}), "Step 2 is too short"),
        (lambda: item(1, english={"statement": "s", "steps": []}), "at least one step"),
        (lambda: item(1, lean={"imports": [], "theorem": "def x := 1"}), "must start with"),
        (lambda: "[1, 2]", "id: expected a string"),
    ],
)
def test_corrupt_reasons(spark, tmp_dir, bad, reason):
    p = write(os.path.join(tmp_dir, "a.jsonl"), [item(0), bad(), item(2)])
    rows = SRC.scan_corrupt(spark, p).collect()
    assert len(rows) == 1 and rows[0].line_number == 2
    assert any(reason in r for r in rows[0].reasons), rows[0].reasons


def test_numbered_across_blocks(spark, tmp_dir):
    lines_a = [f"line a {i}" + ("" if i % 7 else "") for i in range(400)]
    lines_b = ["", "x", "", "y"] * 50
    pa = write(os.path.join(tmp_dir, "a.txt"), lines_a)
    pb = write(os.path.join(tmp_dir, "b.txt"), lines_b)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many blocks per file
    try:
        rows = SRC.scan_numbered(spark, f"{tmp_dir}/*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(os.path.basename(r.file), r.line_number): r.value for r in rows}
    want = {("a.txt", i + 1): v for i, v in enumerate(lines_a)} | {("b.txt", i + 1): v for i, v in enumerate(lines_b)}
    assert got == want


def test_sink_roundtrip(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "a.jsonl"), [item(1, topic="lógica"), item(2)])
    df = SRC.scan_items(spark, p)
    out = os.path.join(tmp_dir, "out", "deep")
    SNK.sink_jsonl(df, out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.startswith("part-"))
    assert "lógica" in text and '"imports":[]' in text
    back = SRC.scan_strict(spark, out)
    assert back.count() == 2


def test_sink_splits(spark, tmp_dir):
    from proofloom.operators.splits import assign_splits

    p = write(os.path.join(tmp_dir, "a.jsonl"), [item(i) for i in range(10)])
    tagged = assign_splits(SRC.scan_items(spark, p))
    out = os.path.join(tmp_dir, "splits")
    SNK.sink_splits(tagged, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("split=")) == ["split=dev", "split=test", "split=train"]
    assert SRC.scan_items(spark, f"{out}/split=train").count() == 6


def test_strict_reads_twice_and_names_the_first_bad_line(spark, tmp_dir):
    """Two reads: the pass that checks and counts, and the rows; over many
    blocks the first bad line has its own number, blank lines counted."""
    lines = [item(i) if i % 5 else "" for i in range(300)]
    good = write(os.path.join(tmp_dir, "good.jsonl"), lines)
    bad = write(os.path.join(tmp_dir, "bad.jsonl"), [*lines[:250], "{broken", *lines[250:], "[1]"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        df = SRC.scan_strict(spark, good)
        rows = df.collect()
        assert [r.line_number for r in sorted(rows, key=lambda r: r.line_number)] == [i + 1 for i in range(300) if i % 5]
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan text") == 1
        with pytest.raises(ValueError, match="line 251 of bad.jsonl: Invalid JSON"):
            SRC.scan_strict(spark, bad)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_parse_keeps_the_item(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "a.jsonl"), [item(0), item(1, id=5), '{"id": "x"', "null", item(2, extra={"a": [1]})])
    rows = {r.line_number: r for r in SRC.scan_checked(spark, p).collect()}
    assert rows[1].reasons == [] == rows[5].reasons and rows[1].english.steps == SRC.scan_items(spark, write(os.path.join(tmp_dir, "b.jsonl"), [item(0)])).first().english.steps
    assert rows[2].reasons == ["id: expected a string"] and rows[3].reasons == ["Invalid JSON"] and len(rows[4].reasons) >= 4


def test_numbers_run_on_over_the_parts_of_a_file(spark, tmp_dir):
    lines = [f"line {i}" if i % 5 else "" for i in range(300)]
    for name, rows in (("a", lines), ("b", ["x", "", "y"])):
        os.makedirs(os.path.join(tmp_dir, name))
        for k in range(0, len(rows), 70):
            write(os.path.join(tmp_dir, name, f"part-{k // 70:05d}.txt"), rows[k : k + 70])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # many blocks per part
    try:
        rows = SRC.scan_numbered(spark, f"{tmp_dir}/*", parts=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(os.path.basename(r.file), r.line_number): r.value for r in rows}
    want = {("a", i + 1): v for i, v in enumerate(lines)} | {("b", i + 1): v for i, v in enumerate(["x", "", "y"])}
    assert got == want and len(rows) == len(want)


def test_no_task_writes_a_whole_numbered_file(spark, tmp_dir, monkeypatch):
    import glob

    from proofloom.plans import catalog_io as IO
    from proofloom.session import scratch_folder

    os.makedirs(os.path.join(tmp_dir, "sf"))
    docs = spark.range(700).selectExpr("id * 7 AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'s' AS source")
    docs.write.parquet(os.path.join(tmp_dir, "sf", "documents.parquet"))
    monkeypatch.setattr(IO, "LINES", 20)
    rows = IO.q_scan_numbered(spark, os.path.join(tmp_dir, "sf")).collect()
    assert sorted((r.line_number, r.written_number, r.doc_id) for r in rows) == [(i + 1, i + 1, i * 7) for i in range(700)]
    written = max(glob.glob(f"{scratch_folder(spark)}/scan_numbered-*"), key=os.path.getmtime)
    sizes = [sum(1 for _ in open(p)) for p in glob.glob(f"{written}/bucket=0/part-*")]
    assert sum(sizes) == 700 and max(sizes) <= 80
