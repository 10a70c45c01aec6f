"""The state machine of operator 4 on templates and orders of its own."""

import random

from engramix.llm import chat_format
from pyspark.sql import functions as F


def walk(spark, convs, template=chat_format.CHATML):
    df = spark.createDataFrame([(i, rs) for i, rs in enumerate(convs)], "i int, roles array<string>")
    return [(r["w"]["state"], r["w"]["bad_turn"]) for r in df.withColumn("w", chat_format.walk(F.col("roles"), template)).orderBy("i").collect()]


def test_order_stays_broken(spark):
    assert walk(spark, [["system", "assistant", "user", "assistant"], ["user", "assistant"], [], ["user", None]]) == [(None, 2), ("answered", None), ("start", None), (None, 2)]


def test_states_need_not_be_named_after_roles(spark):
    t = chat_format.Template(start="s", moves={"s": {"user": "asked"}, "asked": {"user": "twice", "assistant": "done"}, "twice": {"assistant": "done"}}, final=("done",))
    # the same role leads to different states: what the previous role was does not tell the state
    assert walk(spark, [["user", "assistant"], ["user", "user", "assistant"], ["user", "user", "user"], ["user", "assistant", "user"]], t) == [("done", None), ("done", None), (None, 3), (None, 3)]
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")]
    got = {r["conv_id"]: r["valid"] for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t).collect()}
    assert got == {1: True, 2: False}


def test_machine_against_a_plain_walk(spark):
    r = random.Random(3)
    convs = [[r.choice(["user", "assistant", "system", "tool", "x"]) for _ in range(r.randint(0, 6))] for _ in range(200)]

    def plain(roles):
        state = "start"
        for i, x in enumerate(roles, 1):
            state = chat_format.CHATML.moves[state].get(x)
            if state is None:
                return None, i
        return state, None

    assert walk(spark, convs) == [plain(c) for c in convs]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "z", 3)], "conv_id long, turn long, role string, text string, _turns string, segments int")
    assert chat_format.format_conversations(df).count() == 1 and chat_format.format_conversations(df.limit(0)).count() == 0
