import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulens.llm import chat

TURN = "conv_id long, turn long, role string, text string, key string, formatted string"


def read(spark, rows):
    out = chat.format_conversations(spark.createDataFrame([(*r, "k", "f") for r in rows], TURN))
    done = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    return {r.conv_id: r for r in done.collect()}


def test_order_merge_and_mask(spark):
    got = read(spark, [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "d"), (2, 0, "system", None)])
    assert got[1].formatted == "### user: a<turn>b</turn>\n### assistant: c<turn>d</turn>\n"
    assert got[1].learned == "cd"
    assert [tuple(t) for t in got[2].turns] == [("system", "")] and got[2].learned == ""


def test_nulls_ties_and_repeats(spark):
    got = read(spark, [(None, None, None, "z"), (None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a")])
    assert [tuple(t) for t in got[None].turns] == [("user", "a"), ("user", "a"), ("user", "b"), ("", "z")]


def test_empty_table(spark):
    assert read(spark, []) == {}


def test_long_text(spark):
    text = "x</turn>#" * 50_000
    got = read(spark, [(1, 0, "assistant", text)])
    assert got[1].learned == text


CONTROL = st.lists(st.sampled_from(["\\", "#", "### ", ": ", "<turn>", "</turn>", "</turn>\n", "<", "/turn>", "\n", "$1", "é", "😀", "a"]), max_size=8).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "### x", "\\", ":"]), CONTROL), min_size=1, max_size=12))
def test_round_trip(spark, turns):
    got = read(spark, [(1, i, r, t) for i, (r, t) in enumerate(turns)])[1]
    assert [tuple(t) for t in got.turns] == turns
    assert got.learned == "".join(t for r, t in turns if r == "assistant")


def test_query_against_plain_reading(spark, sf_dir):
    got = {r.conv_id: r for r in chat.op9_chat_format(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = {}
    for r in rows:
        said.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    said[-7] = [("user", chat.PLANTED), ("assistant", chat.PLANTED)]
    assert set(got) == set(said)
    for k, turns in said.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())


@pytest.mark.parametrize("name", ["op9_chat_format", "op6_quality_rules"])
def test_native(spark, sf_dir, name):
    from tabulens.llm.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
