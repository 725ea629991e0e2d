import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from terrafold.llm import chat
from terrafold.llm.chat import format_conversations, format_turns, read_turns, root_to_leaf_paths, unescape

text = st.lists(st.sampled_from(["\\", "#", "### ", "<", "</turn>", "\n", ":", "a", " ", "Assistant: ", "é", "😀"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), text), text), max_size=6))
def test_turns_come_back(turns):
    formatted, spans = format_turns(turns)
    assert read_turns(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count("</turn>") == len(turns)


def brute_paths(messages, top):
    """(conv, leaf) -> path from the root, for the best leaves."""
    by = defaultdict(dict)
    for c, m, p, s in messages:
        by[c][m] = (p, s or 0.0)
    out = {}
    for c, ms in by.items():
        parents = {p for p, _ in ms.values()}
        found = []
        for leaf in ms:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in ms and at not in path:
                path.append(at)
                at = ms[at][0]
            found.append((-sum(ms[x][1] for x in path), leaf, path[::-1]))
        for _, leaf, path in sorted(found)[:top]:
            out[c, leaf] = path
    return out


def test_paths_against_brute_force(spark):
    rows = [(1, i, i - 1 if i else None, 0.5) for i in range(37)]
    rows += [(2, 0, None, 1.0), (2, 1, 0, 2.0), (2, 2, 0, 3.0), (2, 3, 1, 2.0), (2, 4, 1, 2.0), (2, 5, 2, None), (2, 6, 99, 9.0)]
    rows += [(None, 1, None, 1.0), (None, 2, 1, 1.0)]
    rows += [(4, 1, 2, 1.0), (4, 2, 1, 1.0), (4, 3, 2, 1.0)]  # a cycle and what hangs on it
    for top in (1, 3):
        got = defaultdict(list)
        for r in root_to_leaf_paths(spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, score double"), top).collect():
            got[r["conv_id"], r["leaf_id"]].append((-r["back"], r["msg_id"]))
        want = {k: v for k, v in brute_paths(rows, top).items() if k[0] != 4}
        assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == want


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### User: x</turn>\n"), (1, 1, "assistant", "a tie"), (2, 0, "system", None), (None, 3, "user", "q"), (3, 0, None, "x"), (3, None, "assistant", "first")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    c = "\\### Assistant: </turn> ok"
    convs = defaultdict(list)
    for i, t, r, x in rows:
        convs[i].append((-1 if t is None else t, r or "", x or ""))
    convs[-7] = [(0, "user", c), (1, "assistant", c)]
    assert set(got) == set(convs)
    for i, turns in convs.items():
        turns = sorted(turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        r = got[i]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    assert format_conversations(df).count() == 0


def test_repeated_messages_count_once(spark):
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "yes", 1.0), (1, 2, 1, "assistant", "yes", 1.0), (1, 3, 2, "user", "so", 0.5)]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double").withColumn("back", F.lit(1)).withColumn("a.b", F.lit(2))
    got = format_conversations(df).collect()
    assert [read_turns(r["formatted"]) for r in got] == [[("user", "hi"), ("assistant", "yes"), ("user", "so")]]
    assert format_conversations(df.limit(0)).count() == 0
