"""Chat formatting of reply trees.

Messages form trees by parent. Pointers to ancestors are doubled by self-joins
(parent, grandparent, the fourth ancestor, ...), which sums scores to the root
in as many joins as the depth has binary digits. Branches are ranked by score in
their tree, and the chosen leaves are walked back to the root with the same
pointers: each distance is one sum of powers of two, so each node of a path is
found once. A path's rows are then formatted as one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

# template, fixed values
TURN_START = "### "
TURN_END = "</turn>\n"
ESCAPED = "\\#<"
_CODES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_CHARS = {v[1]: k for k, v in _CODES.items()}
_TURN = re.compile(r"### ([^:]*): ([^<]*)</turn>\n")


def escape(text: str, characters: str = ESCAPED) -> str:
    """Backslash codes for the characters that control strings are made of, so none is left in the text."""
    return re.sub(f"[{re.escape(characters)}]", lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _CHARS[m[1]], text)


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans (in code points) of the escaped texts that loss is taken on."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN_START}{escape(role, ESCAPED + ':')}: ", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + TURN_END)
        at += len(out[-1])
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the opposite of format_turns."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def one_of_each_message(messages: DataFrame) -> DataFrame:
    """conv_id, msg_id, parent_id, role, text and score, once for each conv_id and msg_id: the first of the others' values, in order."""
    fields = [c for c in ("parent_id", "score", "role", "text") if c in messages.columns]
    return messages.groupBy("conv_id", "msg_id").agg(F.min(F.struct(*fields)).alias("m")).select("conv_id", "msg_id", "m.*")


def root_to_leaf_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, leaf_id, path_rank, path_score, msg_id, depth: the rows of the ``top`` branches of each conversation.

    messages has conv_id, msg_id, parent_id and score; messages that repeat both
    ids count once. A parent that does not exist makes its child a root; messages on a
    cycle belong to no path. A null score is 0; ties go to the smaller leaf id.
    """
    same = lambda a, b, x, y: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    m = stored(one_of_each_message(messages.select("conv_id", "msg_id", "parent_id", "score")).select("conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "messages")
    roots_and_up = m.alias("a").join(m.alias("b"), same("a", "b", "parent_id", "msg_id"))
    # jumps[k]: messages with an ancestor 2 ** k above them, and the scores on the way to it
    jumps = [stored(roots_and_up.select("a.conv_id", "a.msg_id", F.col("b.msg_id").alias("up"), F.col("a.score").alias("total")), "jump")]
    most = m.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while 2 ** len(jumps) <= most:
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        higher = stored(a.join(b, same("a", "b", "up", "msg_id")).select("a.conv_id", "a.msg_id", "b.up", (F.col("a.total") + F.col("b.total")).alias("total")), "jump")
        if not higher.limit(1).count():
            break
        jumps.append(higher)
    parents = jumps[0].select("conv_id", F.col("up").alias("msg_id")).distinct().alias("p")
    at = m.alias("l").join(parents, same("l", "p", "msg_id", "msg_id"), "left_anti").select("conv_id", F.col("msg_id").alias("leaf_id"), "msg_id", F.lit(0.0).alias("total"))
    for jump in reversed(jumps):  # the longest jump that is left, then the next: each leaf arrives at its root
        s, u = at.alias("s"), jump.alias("u")
        at = s.join(u, same("s", "u", "msg_id", "msg_id"), "left").select("s.conv_id", "s.leaf_id", F.coalesce("u.up", "s.msg_id").alias("msg_id"), (F.col("s.total") + F.coalesce("u.total", F.lit(0.0))).alias("total"))
    s, r = at.alias("s"), m.alias("r")
    root = s.join(r, same("s", "r", "msg_id", "msg_id")).select("s.conv_id", "s.leaf_id", "s.msg_id", (F.col("s.total") + F.col("r.score")).alias("total")).alias("t")
    leaves = root.join(jumps[0].alias("j"), same("t", "j", "msg_id", "msg_id"), "left_anti")  # what never arrives is on a cycle
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "leaf_id"))
    chosen = leaves.select("conv_id", "leaf_id", F.col("total").alias("path_score"), rank.alias("path_rank")).where(F.col("path_rank") <= top)
    rows = stored(chosen.withColumn("msg_id", F.col("leaf_id")).withColumn("back", F.lit(0)), "paths")
    for k in reversed(range(len(jumps))):
        s, u = rows.alias("s"), jumps[k].alias("u")
        more = s.join(u, same("s", "u", "msg_id", "msg_id")).select("s.conv_id", "s.leaf_id", "s.path_score", "s.path_rank", F.col("u.up").alias("msg_id"), (F.col("s.back") + 2**k).alias("back"))
        rows = stored(rows.unionByName(more), "paths")
    return rows.select("conv_id", "leaf_id", "path_rank", "path_score", "msg_id", "back")


def format_conversations(messages: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """conv_id, leaf_id, path_rank, path_score, formatted, loss_spans: one row per chosen path.

    messages has conv_id, msg_id, parent_id, role, text and score; null roles
    and texts are empty. loss_spans are (start, end) in code points of
    formatted. A path is one value of one row, and so has to fit a task.
    Messages that repeat both ids count once; an empty table gives no rows, and
    other columns are ignored.
    """
    paths = root_to_leaf_paths(messages, top).alias("p")
    m = one_of_each_message(messages).alias("m")
    j = paths.join(m, F.col("p.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("p.msg_id") == F.col("m.msg_id")))
    turn = F.struct((-F.col("p.back")).alias("at"), F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))
    grouped = j.groupBy("p.conv_id", "p.leaf_id", "p.path_rank", "p.path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", "leaf_id", "path_rank", "path_score", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [format_turns(list(zip(r, t)), loss_role) for r, t in zip(b.roles, b.texts)]
            out = b[["conv_id", "leaf_id", "path_rank", "path_score"]].copy()
            out["formatted"] = [x[0] for x in made]
            out["loss_spans"] = [[{"start": s, "end": e} for s, e in x[1]] for x in made]
            yield out

    types = {f.name: f.dataType.simpleString() for f in grouped.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in ("conv_id", "leaf_id", "path_rank", "path_score"))
    return grouped.mapInPandas(fill, f"{schema}, formatted string, loss_spans array<struct<start:int,end:int>>")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(b.conv_id, b.formatted, b.loss_spans):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def linear_messages(rows: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each message replies to the one before it."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", place.alias("msg_id"), "role", "text").withColumn("parent_id", F.col("msg_id") - 1).withColumn("score", F.lit(0.0))


def op5_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return conversation_digests(format_conversations(stored(linear_messages(rows.unionByName(extra)), "turns")))
