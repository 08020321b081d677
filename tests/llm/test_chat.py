import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewell.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, score string"


def read_back(spark, rows):
    made = chat.best_conversations(chat.chained(spark.createDataFrame(rows, SCHEMA)))
    return {r["conv_id"]: r for r in chat.parsed(made).collect()}, made


ROWS = [
    (1, 1, "assistant", "b \\### Assistant: </turn> ok", "x"),
    (1, 0, "user", "a\\", "x"),
    (2, 0, "us: er", "### x: y</turn>\n### assistant: z</turn>\n", "x"),
    (2, 1, "assistant", "", "x"),
    (2, 2, "assistant", None, "x"),
    (3, 0, None, None, "x"),
    (None, 0, "assistant", "\\h\\e\\b", "x"),
    (4, 0, "assistant", "tie", "x"),
    (4, 0, "assistant", "tie", "x"),
]


def test_turns_and_loss_come_back(spark):
    got, _ = read_back(spark, ROWS)
    turns = {k: [tuple(t) for t in r["turns"]] for k, r in got.items()}
    assert turns == {
        1: [("user", "a\\"), ("assistant", "b \\### Assistant: </turn> ok")],
        2: [("us: er", ROWS[2][3]), ("assistant", ""), ("assistant", "")],
        3: [("", "")],
        None: [("assistant", "\\h\\e\\b")],
        4: [("assistant", "tie"), ("assistant", "tie")],
    }
    assert {k: r["loss"] for k, r in got.items()} == {1: "b \\### Assistant: </turn> ok", 2: "", 3: "", None: "\\h\\e\\b", 4: "tietie"}
    for r in got.values():
        for span in r["mask"]:
            assert chat.END not in r["text"][span["start"] : span["start"] + span["length"]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(st.sampled_from("\\#</turn>: \nbehc"), max_size=12), st.text(st.sampled_from("\\#</turn>: \nbehcé😀"), max_size=30)), min_size=1, max_size=30))
def test_any_text_comes_back(spark, turns):
    got, _ = read_back(spark, [(k, 0, role, text, "") for k, (role, text) in enumerate(turns)])
    assert [tuple(got[k]["turns"][0]) for k in range(len(turns))] == turns


def test_digests(spark):
    _, made = read_back(spark, ROWS[:2])
    row = chat.digests(chat.parsed(made)).first()
    said = "user\na\\\nassistant\nb \\### Assistant: </turn> ok\n"
    loss = "b \\### Assistant: </turn> ok"
    assert tuple(row) == (1, 2, hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(made.first()["text"]))


def tree(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, msg long, parent long, role string, text string, score double")


def test_branches_are_ranked(spark):
    rows = tree(spark, [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", "high", 5.0), (1, 4, 2, "user", "more", 2.0), (1, 5, 4, "assistant", "end", None), (2, 9, 77, "user", "orphan", 1.0)])
    steps = chat.paths(rows, top=None).collect()
    found = {}
    for r in sorted(steps, key=lambda r: -r["back"]):
        found.setdefault((r["conv_id"], r["leaf"], r["rank"], r["score"]), []).append(r["msg"])
    assert found == {(1, 3, 1, 5.0): [1, 3], (1, 5, 2, 3.0): [1, 2, 4, 5], (2, 9, 1, 1.0): [9]}
    best = {r["conv_id"]: r["text"] for r in chat.formatted(rows, chat.paths(rows)).collect()}
    assert best == {1: "### user: q</turn>\n### assistant: high</turn>\n", 2: "### user: orphan</turn>\n"}


def test_ties_go_to_the_smaller_leaf_and_cycles_to_nobody(spark):
    rows = tree(spark, [(1, 1, None, "u", "", 0.0), (1, 3, 1, "u", "", 1.0), (1, 2, 1, "u", "", 1.0), (1, 10, 11, "u", "", 9.0), (1, 11, 10, "u", "", 9.0), (1, 12, 11, "u", "", 9.0)])
    assert {r["leaf"] for r in chat.paths(rows).collect()} == {2}
    assert {r["leaf"] for r in chat.paths(rows, top=None).collect()} == {2, 3}


def test_long_conversation(spark):
    got, _ = read_back(spark, [(1, k, "user", f"t{k}", "") for k in range(700)])
    assert [t["text"] for t in got[1]["turns"]] == [f"t{k}" for k in range(700)]


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.parsed(chat.best_conversations(chat.chained(empty))).count() == 0
    rows = spark.createDataFrame(ROWS, SCHEMA)
    plan = chat.digests(chat.parsed(chat.formatted(chat.chained(rows), chat.paths(chat.chained(rows)))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
