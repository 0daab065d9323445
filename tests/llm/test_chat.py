import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm.chat import expand_examples, format_conversations, read_replies, read_turns, with_context
from quantloom.llm.queries import OP7_SQL, op7_chat_formatting

CONTROL = st.text(alphabet=st.sampled_from("<|\\/im_startend>\n aé😀"), max_size=25)


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


def round_trip(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = format_conversations(df)
    got = made.select("conv_id", read_turns(F.col("formatted")).alias("t"), read_replies(F.col("formatted"), F.col("examples")).alias("r"), "formatted").collect()
    want = by_conversation(rows)
    assert {r.conv_id: [(t.role, t.text) for t in r.t] for r in got} == want
    assert {r.conv_id: r.r for r in got} == {c: [t for role, t in turns if role == "assistant"] for c, turns in want.items()}
    assert all(r.formatted.count("<|im_start|>") == len(r.t) == r.formatted.count("<|im_end|>") for r in got)
    return made


def test_control_strings_come_back(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["user", "assistant", "a\\n<|", "x\ny\\"]), CONTROL), min_size=10, max_size=60))
    def run(turns):
        round_trip(spark, [(c, k, role, text) for k, (c, role, text) in enumerate(turns)])

    run()


def test_nulls_ties_repeats(spark):
    round_trip(spark, [(None, 1, "user", "a"), (None, 2, "assistant", None), (1, None, None, "x"), (1, 3, "user", "b"), (1, 3, "assistant", "a"), (1, 3, "assistant", "a"), (2, 0, "user", "")])
    assert format_conversations(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).collect() == []


def test_every_assistant_turn_is_an_example_with_all_before_it(spark):
    made = round_trip(spark, [(7, k, "assistant" if k % 2 else "user", f"said\n<|{k}") for k in range(301)])
    whole = made.first().formatted
    rows = sorted(with_context(made).collect(), key=lambda r: r.example)
    assert len(rows) == 150
    for k, r in enumerate(rows):
        assert r.reply == f"said\n<\\|{2 * k + 1}" and r.context.endswith("<|im_start|>assistant\n") and r.context.count("<|im_start|>") == 2 * k + 2
        assert whole.startswith(r.context + r.reply + "<|im_end|>\n")
    assert [r.reply for r in sorted(expand_examples(made).collect(), key=lambda r: r.example)] == [r.reply for r in rows]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    df = op7_chat_formatting(spark, folder)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({OP7_SQL})").fetchall())
    probe = df.where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert probe.loss_chars == len(said) and probe.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
