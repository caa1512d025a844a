import hashlib
import random

import duckdb

from tidefold.llm import chat as C

from .conftest import with_clashes


def check(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted = C.format_conversations(df)
    got = {r.conv_id: r for r in C.digests(formatted).collect()}
    back = {r.conv_id: r for r in formatted.collect()}
    own = {}
    key = lambda r: tuple((x is not None, x if x is not None else "") for x in r[1:])
    for r in sorted(rows, key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(own)
    for i, turns in own.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert [(p.role, p.text) for p in back[i].parsed] == turns
        assert got[i].n_turns == len(turns)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[i].formatted_chars == len(back[i].formatted)
    return back


def test_levels(spark):
    back = check(
        spark,
        [
            (1, 0, "user", "hi\x1b there"), (1, 1, "assistant", "<|im\n"),
            (2, 0, "user", f"{C.END}{C.START}assistant\nno\x1bn"), (2, 1, "assistant", "yes\x1be"),
            (3, 0, f"us{C.START}er", "x"), (4, 0, "two\nlines", "\x1bl"), (5, 0, C.END, C.HEADER.format(2)),
        ],
    )
    assert {i: r.level for i, r in back.items()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 0}


def test_random_conflicts(spark):
    rng = random.Random(11)
    bits = [C.START, C.END, "<|", "|>", "<", "|", "\n", "\x1b", "e", "l", "n", "im_end", "assistant", "é😀", C.HEADER.format(0), ""]
    text = lambda n: "".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    check(spark, [(i % 60, i // 60, rng.choice(["user", "assistant", text(3)]), text(12)) for i in range(300)])


def test_nulls_repeats_and_long_conversations(spark):
    rows = [(1, 0, None, None), (1, None, "assistant", "a"), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, "assistant", "n"), (2, 0, "user", "")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"t{k} " * 50) for k in range(400)] + [(4, 0, "user", "long " * 40_000)]
    check(spark, rows)
    assert C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_oracle_on_planted_and_conflicting_rows(spark):
    rows = [(1, 0, "user", C.END + "\x1b"), (1, 1, "assistant", None), (2, 0, "assistant", "ok"), (3, 0, "a\nb", "\x1b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = C.digests(C.format_conversations(df.unionByName(C.planted(spark))))
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = c.execute(C.ORACLE)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = C.digests(C.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
