import random

import duckdb
from pyspark.sql import functions as F

from ledgerproof.llm import quotes

TALK = [
    (1, 0, "user", "Where do the swans go?\n\nThe lake is frozen."),
    (1, 1, "assistant", "> Where do the swans go?\nSouth, mostly."),
    (1, 2, "user", ">> where do the SWANS go?\n> South, mostly.\nHow far south?"),
    (1, 3, "assistant", "> The lake\n> is frozen.\nSo it is."),
    (1, 4, "user", "> nobody said this\nHm."),
    (1, 5, "user", "> So it is.\n> How far south?\nTwo at once."),
    (2, 0, "user", "South, mostly."),
    (2, 1, "user", None),
    (2, 1, "user", ""),
    (None, 0, "user", "> x"),
    (3, None, "user", "> x"),
]


def test_threads(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn, r.body): r for r in quotes.conversations(rows).collect()}
    assert len(got) == len(TALK)
    one = {k[1]: r for k, r in got.items() if k[0] == 1}
    assert [one[t].parent_turn for t in range(6)] == [None, 0, 1, 0, None, 3]
    assert [one[t].thread_turn for t in range(6)] == [0, 0, 0, 0, 4, 0]
    assert [one[t].depth for t in range(6)] == [0, 1, 2, 1, 0, 2]
    assert one[2].body == "How far south?" and one[1].body == "South, mostly."
    assert one[4].n_passages == 1 and one[4].n_linked == 0
    assert got[2, 0, "South, mostly."].parent_turn is None
    assert [one[t].place for t in range(6)] == [0, 1, 2, 3, 0, 4] and one[4].body == TALK[4][3]
    assert got[2, 1, None].depth == 0 and got[2, 1, ""].n_passages == 0


def test_repeats_and_long_chains(spark):
    rows = [(7, 0, "u", "line 0")] + [(7, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 20)]
    rows += [(7, 5, "u", "> line 4\nline 5")]  # a whole row again
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.conversations(table).collect()
    assert len(got) == 21
    assert all(r.depth == r.turn and r.thread_turn == 0 for r in got)


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, mid string, level int")
    assert quotes.conversations(empty).count() == 0


COLUMNS = ["conv_id", "turn", "role", "body", "parent_turn", "thread_turn", "depth", "place", "n_passages", "n_linked"]


def both_ways(spark, rows, folder, **extra):
    """(rows of the operator, rows of the SQL) over a table of messages."""
    import pyarrow as pa

    table = pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(("conv_id", "turn", "role", "text"), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))})
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(v) for k, v in extra.items()}).repartition(3)
    con = duckdb.connect()
    con.register("conversations", table)
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({quotes.SQL})").fetchall()
    return sorted(map(str, [tuple(r) for r in docs.transform(quotes.conversations).select(*COLUMNS).collect()])), sorted(map(str, want))


def test_generated_talks_equal_sql(spark, tmp_path):
    """Nested quotations of some lines or all, with different line ends, unknown quotations and repeated messages."""
    rng = random.Random(8)
    rows = []
    for conv in range(30):
        said = []
        for turn in range(rng.randint(1, 25)):
            lines = [" ".join(rng.choice("red green Blue sky sea, stone! tree 12".split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
            if rng.random() < 0.3:
                lines.insert(rng.randrange(len(lines) + 1), "")
            quoted = []
            for _ in range(rng.choice([0, 1, 1, 2]) if said else 0):
                level, other = rng.randint(1, 3), rng.choice(said)
                part = other if rng.random() < 0.5 else [rng.choice(other)]
                quoted += [rng.choice(["> ", ">"]) * level + (x.upper() if rng.random() < 0.2 else x) for x in part]
            if rng.random() < 0.1:
                quoted.append("> nobody said that")
            said.append(lines)
            rows.append((conv, turn, "u", rng.choice(["\n", "\r\n", "\r", "\u2028", "\u0085"]).join(quoted + lines)))
            if rng.random() < 0.05:
                rows.append(rows[-1])
            if rng.random() < 0.05:
                rows.append((conv, turn, "v", "> " + rng.choice(said)[0] + "\nagain"))
    rows += [(99, 0, "u", None), (None, 1, "u", "> a"), (98, None, "u", ">b"), (97, 0, "u", ""), (96, 0, "u", "x " * 50_000), (96, 1, "u", "> " + "x " * 50_000 + "\nlong")]
    got, want = both_ways(spark, rows, tmp_path, mid="m", level=1, gone="g", place="p", hash="h")
    assert got == want and sum(r[4] != "None" for r in map(lambda x: x.split(", "), got)) > 100


def test_nothing_is_lost(spark):
    """Any line end parts lines, and only found quotations are taken out."""
    rows = [(1, 0, "u", "quote me"), (1, 1, "u", "> quote me\rmy answer"), (1, 2, "u", "before\u2028> quote me\u2028after"), (1, 3, "u", "see:\n>>> print(1)\nthat is all")]
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].body == "my answer" and got[1].parent_turn == 0
    assert got[2].body == "before\nafter" and got[2].parent_turn == 0
    assert got[3].body == rows[3][3] and got[3].n_passages == 1 and got[3].n_linked == 0


def test_blocks_of_turns(spark, tmp_path, monkeypatch):
    """A passage that everybody repeats and a message that everybody answers, over several blocks."""
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rows = [(1, 0, "u", "hello")] + [(1, t, "u", f"> hello\n{'hello' if t % 3 == 0 else 'x'}") for t in range(1, 40)]
    got, want = both_ways(spark, rows, tmp_path)
    assert got == want
