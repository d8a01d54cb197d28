"""op4: quotes, links and threads against the SQL answer and planted replies."""

import random

import duckdb

from metricloom.llm import chats

ROWS = "conv_id long, turn long, role string, text string, thread int, body string"


def planted():
    """Conversations whose messages quote earlier ones, up to three levels deep."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(12):
            own = [" ".join(rng.choices(words, k=rng.randint(4, 9))) for _ in range(rng.randint(1, 3))]
            text = own
            if texts and rng.random() < 0.7:
                source = rng.choice(texts).split("\n")
                if rng.random() < 0.3:
                    source = [rng.choice(source)]
                mark = rng.choice(["> ", ">", " > "])
                text = [mark + line.upper() for line in source] + rng.choice([[], [""]]) + own
                if rng.random() < 0.3:
                    text = own[:1] + text
            texts.append("\n".join(text))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), texts[-1]))
    rows += [(50, 0, "user", None), (50, 1, None, ""), (50, 2, "user", "> \n>"), (50, 3, "user", "> not said")]
    rows += [(51, t, "user", ("> " if t else "") + "the very same words again") for t in range(30)]
    rows += [(52, 0, "user", "a\n\nb  c d e\n> q"), (52, 1, "user", "> a B c\tD\n> b c d e\n\n ok \n")]
    rows += [(53, 0, "u", "x" * 50_000), (53, 1, "u", "> " + "x" * 50_000), (53, 2, "u", "> > > deep")]
    # A chain in which each message answers the one before it.
    rows += [(54, t, "user", f"{f'> this is message {t - 1}' + chr(10) if t else ''}this is message {t}") for t in range(40)]
    # Excerpts: short lines, runs of lines out of the middle, longer ones, and lines that others said before.
    long = [f"line {k}" for k in range(12)]
    rows += [(55, 0, "u", "ok"), (55, 1, "u", "Hello all\nTomorrow at 9\nok\nbye"), (55, 2, "u", "> Tomorrow at 9\nfine")]
    rows += [(55, 3, "u", "> Tomorrow at 9\n> ok\nyes"), (55, 4, "u", "\n".join(long)), (55, 5, "u", "> at 9\nno")]
    rows += [(55, 6, "u", "\n".join("> " + x for x in long[2:9])), (55, 7, "u", "> ok\nagain")]
    rows += [(55, 8, "u", "\n".join("> " + x for x in [*long[2:6], "other", *long[6:9]]))]
    return rows


def both(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "b") for r in rows], ROWS)
    mine = chats.reply_ordered(frame)
    database = duckdb.connect()
    database.register("conversations", frame.select("conv_id", "turn", "role", "text").toArrow())
    answer = database.execute(chats.OP4_SQL)
    names = [c[0] for c in answer.description]
    return mine, sorted(map(tuple, mine.select(*names).collect()), key=repr), sorted(
        answer.fetchall(), key=repr
    )


def test_links_equal_sql(spark):
    mine, rows, answers = both(spark, planted())
    assert rows == answers
    by_key = {(r.conv_id, r.turn): r for r in mine.collect()}
    assert all(by_key[54, t].reply_to == t - 1 and by_key[54, t].thread == 0 for t in range(1, 40))
    assert by_key[54, 7].body == "this is message 7" and by_key[54, 7].n_quoted_lines == 1
    assert by_key[52, 1].reply_to == 0 and by_key[52, 1].body == "ok"
    assert by_key[53, 2].max_level == 3 and by_key[53, 2].reply_to is None
    assert [by_key[55, t].reply_to for t in range(9)] == [None, None, 1, 1, None, None, 4, 0, None]
    assert sum(r.n_linked > 0 for r in by_key.values()) > 80


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, 0, "u", "said by nobody known"), (None, 1, "u", "> said by nobody known")]
    rows += [(1, None, "u", "> x"), (2, 0, "u", "one two three four"), (2, 0, "u", "one two three four")]
    rows += [(2, 1, "u", "> one two three four")] * 2
    frame = spark.createDataFrame([(*r, 1, "b") for r in rows], ROWS)
    found = sorted((r.conv_id, r.turn, r.reply_to) for r in chats.reply_ordered(frame).collect() if r.conv_id)
    assert [f[2] for f in found if f[0] == 2] == [None, None, 0, 0]
    assert chats.reply_ordered(frame).count() == len(rows)
    assert chats.reply_ordered(frame.limit(0)).count() == 0


def test_order_and_native_plan(spark, tmp_path):
    frame = spark.createDataFrame([(*r, 1, "b") for r in planted()], ROWS)
    ordered = chats.reply_ordered(frame)
    plan = ordered._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    chats.write_ordered(ordered, f"{tmp_path}/out")
    seen = set()
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("conv_id", "thread", "turn").collect():
        assert r.reply_to is None or (r.conv_id, r.reply_to) in seen
        seen.add((r.conv_id, r.turn))
