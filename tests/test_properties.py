"""Property tests: Spark column functions vs their DuckDB spellings on random
strings built from an alphabet of the rules' tricky pieces.  All examples of
a test are checked in one Spark job."""

import random

import duckdb

from proofloom import schema as S
from proofloom.functions import errors as ER
from proofloom.functions import text as TX
from proofloom.operators import checks as CK
from proofloom.plans import duck as D

PIECES = [
    "```", "```lean", "\n", "\n\n", "Lean:", " ", "  ", "\t", "\r\n", "theorem", "lemma", " := ", "by", "by ",
    "(", ")", "[", "]", "{", "}", '"', "é", "ü", "∀", "→", "ℕ", "⟨", "⟩", "₁", "★", "😀", "_", "x", "foo", "1",
    " ", " ", "　", "\x1c", "\x85", " ", "'", "unknown identifier 'a.b'", "type mismatch",
    "expected ')'", "unsolved goals", ":12:5:", "c.lean:3:4: error:", "étheorem", "theorem_", "baby ",
] + list(S.WS_CHARS[:6])


def samples(seed: int, n: int = 400, max_len: int = 14) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, max_len))) for _ in range(n)]


def in_duckdb(data, select):
    """Rows of ``select`` over the table s(i, s), by DuckDB's spelling of the
    rules."""
    con = duckdb.connect()
    con.execute("CREATE TABLE s (i INT, s VARCHAR)")
    con.executemany("INSERT INTO s VALUES (?, ?)", list(enumerate(data)))
    return dict((r[0], r[1:]) for r in con.execute(f"SELECT i, {select} FROM s").fetchall())


def test_extract_and_validate(spark):
    data = samples(1)
    want = in_duckdb(data, f"{D.extract_code('s')}, {D.code_errors('s')}")
    df = spark.createDataFrame([(i, s) for i, s in enumerate(data)], "i int, s string")
    for r in df.select("i", TX.extract_code("s").alias("c"), TX.code_errors("s").alias("e")).collect():
        assert (r.c, list(r.e)) == want[r.i], repr(data[r.i])


def test_hash_and_strip(spark):
    data = samples(2)
    want = in_duckdb(data, f"{D.sha16(D.collapse('s'))}, {D.strip('s')}")
    df = spark.createDataFrame([(i, s) for i, s in enumerate(data)], "i int, s string")
    for r in df.select("i", TX.normalized_hash("s").alias("h"), TX.py_strip("s").alias("t")).collect():
        assert (r.h, r.t) == want[r.i], repr(data[r.i])


def test_classify(spark):
    lines = [s.replace("\n", " ") for s in samples(3)]
    want = in_duckdb(lines, D.classify_line("s"))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, l string")
    for r in df.select("i", ER.classify_line("l").alias("c")).collect():
        assert (r.c,) == want[r.i], repr(lines[r.i])


def test_id_rule(spark):
    rng = random.Random(4)
    alphabet = ["a", "Z", "9", "_", "-", ".", " ", "é", "٣", "!", "\n", "ß"]
    ids = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ids)], "i int, s string")
    for r in df.select("i", CK.id_error("s").alias("e")).collect():
        s = ids[r.i]
        ok = bool(s) and s.replace("_", "").replace("-", "").replace(".", "").isalnum()
        assert (r.e is None) == ok, repr(s)
