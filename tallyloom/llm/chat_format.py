"""Chat formatting of reply trees.

Messages (tree_id, msg_id, parent_id, role, text, score) form trees. Iterative self-joins double the known part of every
path: after round k each message knows its ancestor 2^k steps up and the sum of scores on the way, so a tree of depth d
takes log2(d) rounds. Leaves are ranked in their tree by the mean score of their path (ties: the least msg_id), the best
`branches` of each tree are chosen, their paths are enumerated by the same doubled jumps, and each chosen path becomes one string.

Template, one turn after another: <|im_start|>role, newline, text, <|im_end|>, newline. Control strings inside roles and texts
are escaped reversibly: the escape sign E (U+241B) becomes E0, and each control string gets E1 after its first character (a
newline in a role becomes E2). The loss mask has the code point spans of the assistant's texts.

Null roles and texts count as empty, null scores as 0. A message whose parent is null or unknown is a root. Messages of a null tree
are left out, as are those on a cycle (they have no root). Repeated msg_ids of a tree are an error of the input that keeps the
row with the least (role, text). Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import drop, ready, save

SIGN = "␛"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The tree of the turns without a conv_id, among ids as text.
NO_ID = "null"
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(c):
    c = F.replace(c, F.lit(SIGN), F.lit(SIGN + "0"))
    for x in CONTROL:
        c = F.replace(c, F.lit(x), F.lit(f"{x[0]}{SIGN}1{x[1:]}"))
    return c


def unescape(text: str) -> str:
    return text.replace(f"{SIGN}1", "").replace(f"{SIGN}2", "\n").replace(f"{SIGN}0", SIGN)


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, branch, score, msg_id, pos): the messages of each chosen path from its root (pos 0) to its leaf."""
    rows = messages.where("tree_id IS NOT NULL AND msg_id IS NOT NULL").groupBy("tree_id", "msg_id").agg(F.min("parent_id").alias("parent_id"), F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"))
    parents = rows.select("tree_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("there"))
    jump = save(rows.join(parents, ["tree_id", "parent_id"], "left").select("tree_id", "msg_id", F.expr("IF(there, parent_id, NULL)").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("len")), "jumps")
    leaves = jump.select("tree_id", "msg_id").join(jump.where("up IS NOT NULL").select("tree_id", F.col("up").alias("msg_id")), ["tree_id", "msg_id"], "left_anti")
    jumps, limit = [jump], jump.count()
    # up: the ancestor 2^k steps up; total and len: of the path from the message to just below it. Only messages that have one go on.
    while jump.where("up IS NOT NULL").limit(1).count() and 1 << len(jumps) <= 2 * limit:
        above = jump.select("tree_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("len").alias("len2"))
        going = jump.where("up IS NOT NULL").join(above, ["tree_id", "up"]).select("tree_id", "msg_id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("len") + F.col("len2")).alias("len"))
        jump = save(going.unionByName(jump.where("up IS NULL")), "jumps")
        jumps.append(jump)
    scored = jump.where("up IS NULL").join(leaves, ["tree_id", "msg_id"], "left_semi").select("tree_id", F.col("msg_id").alias("leaf"), (F.col("total") / F.col("len")).alias("score"), "len")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf"))
    chosen = scored.withColumn("branch", rank).where(F.col("branch") <= branches)
    paths = chosen.select("tree_id", "branch", "score", F.col("leaf").alias("msg_id"), (F.col("len") - 1).alias("pos"))
    for k in reversed(range(len(jumps) - 1)):
        # Members so far are 2^(k+1) steps apart; their ancestors 2^k steps up lie between.
        step = jumps[k].where("up IS NOT NULL").select("tree_id", "msg_id", "up")
        paths = save(paths.unionByName(paths.join(step, ["tree_id", "msg_id"]).select("tree_id", "branch", "score", F.col("up").alias("msg_id"), (F.col("pos") - (1 << k)).alias("pos"))), "paths")
    return paths


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree_id, branch, n_turns, formatted, loss_spans): one conversation per chosen path; spans are [start, end) in code points."""
    texts = messages.groupBy("tree_id", "msg_id").agg(F.min(F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).alias("m"))
    turns = paths.join(texts, ["tree_id", "msg_id"]).select("tree_id", "branch", "pos", F.concat(F.lit(OPEN), F.replace(escape(F.col("m.role")), F.lit("\n"), F.lit(f"{SIGN}2")), F.lit("\n")).alias("head"), escape(F.col("m.text")).alias("body"), (F.col("m.role") == "assistant").alias("loss"))
    before = Window.partitionBy("tree_id", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(CLOSE + "\n")))
    at = F.coalesce(F.sum(F.length("turn").cast("long")).over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("start", at).select("tree_id", "branch", F.struct("pos", "turn", "loss", "start", (F.col("start") + F.length("body")).alias("end")).alias("t"))
    out = placed.groupBy("tree_id", "branch").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return out.select("tree_id", "branch", F.size("ts").cast("long").alias("n_turns"), F.concat_ws("", F.transform("ts", lambda t: t["turn"])).alias("formatted"), F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["start"], t["end"])).alias("loss_spans"))


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    return format_paths(messages, best_paths(messages, branches))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = [x.removeprefix(OPEN).partition("\n") for x in formatted.split(f"{CLOSE}\n")[:-1]]
    return [(unescape(role), unescape(text)) for role, _, text in turns]


def read_back(formatted: DataFrame) -> DataFrame:
    """From the formatted strings and spans alone: tree_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ready(formatted.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for tree, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((None if tree in (None, NO_ID) else int(tree), len(turns), sha("".join(f"{role}\n{said}\n" for role, said in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each turn replies to the one before. Rows that share a turn follow one another by role and text. Rows of a null conv_id are one conversation, so tree_id is text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", "turn", "role", "text").withColumn("msg_id", n).select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(NO_ID)).alias("tree_id"), "msg_id", F.expr("IF(msg_id = 1, NULL, msg_id - 1)").alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation, formatted, written to the shared folder and read back."""
    messages = save(chains(conversations), "messages")
    out = save(format_trees(messages), "formatted")
    drop(messages)
    return read_back(out)
