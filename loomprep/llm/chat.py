"""Conversations from reply trees, with a reversible chat template and a loss mask.

Messages form trees by their parent. Iterative self-joins enumerate the path of every leaf: in round k each path row
jumps 2^k messages up, and the jump table joins itself, so the rounds grow with the logarithm of the depth. Branches of a
tree are ranked by the mean score of their messages, and each chosen path is formatted as one conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomprep.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"
# Strings that steer a chat model, here and in other templates. A text never holds one after escaping.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """A backslash becomes \\0 and control string number k becomes \\k: what is left holds none, and nothing is lost."""
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for number, control in enumerate(CONTROL, 1):
        out = F.replace(out, F.lit(control), F.lit(f"\\{number}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for number, control in enumerate(CONTROL, 1):
        out = F.replace(out, F.lit(f"\\{number}"), F.lit(control))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As a text, and on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "inner") -> DataFrame:
    """Join in which equal keys may be null; the right keys are dropped."""
    renamed = right.select([F.col(c).alias(f"_{c}") if c in pairs.values() else F.col(c) for c in right.columns])
    on = [left[a].eqNullSafe(renamed[f"_{b}"]) for a, b in pairs.items()]
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"_{b}" for b in pairs.values()]) if how in ("inner", "left") else joined


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, id, up): every message of every root-to-leaf path, ``up`` steps above its leaf.

    A message whose parent does not exist is a root. Raises where parents form a circle.
    """
    links = nodes.where(F.col("parent").isNotNull()).select("tree", "id", "parent")
    known = nodes.select("tree", F.col("id").alias("parent"))
    jumps = written(same(links, known, {"tree": "tree", "parent": "parent"}, "left_semi"), "chat-jumps")
    leaves = same(nodes.select("tree", "id"), jumps.select("tree", "parent"), {"tree": "tree", "id": "parent"}, "left_anti")
    paths = written(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("bigint").alias("up")), "chat-paths")
    total, step = nodes.count(), 1
    if total and not paths.take(1):
        raise ValueError("parents form a circle")
    while jumps.take(1):
        if step > total:
            raise ValueError("parents form a circle")
        higher = same(paths, jumps, {"tree": "tree", "id": "id"}).select("tree", "leaf", F.col("parent").alias("id"), (F.col("up") + step).alias("up"))
        paths = written(paths.unionByName(higher), "chat-paths")
        again = jumps.select("tree", F.col("id").alias("parent"), F.col("parent").alias("top"))
        jumps = written(same(jumps, again, {"tree": "tree", "parent": "parent"}).select("tree", "id", F.col("top").alias("parent")), "chat-jumps")
        step *= 2
    return paths


def conversations(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, score, n_turns, segments, formatted) per chosen path of (tree, id, parent, role, text, score).

    ``segments`` are the parts of ``formatted`` in order, each with ``loss``: true for the text of an assistant's turn,
    false for marks and other turns. Branch 1 of a tree is the path with the highest mean score, then the longest, then
    the smallest leaf; ``branches`` None keeps all. Null texts and roles are empty, null scores count as zero, a null tree is
    a tree of its own. Messages without an id take no part; an id must be unique in its tree. No messages, no rows.
    """
    own = messages.where(F.col("id").isNotNull())
    nodes = written(own.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")
    paths = leaf_paths(nodes.drop("score"))
    scored = same(paths, nodes.select("tree", "id", "score"), {"tree": "tree", "id": "id"})
    per_leaf = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_turns"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), "leaf")
    ranked = per_leaf.withColumn("branch", F.row_number().over(best))
    ranked = written(ranked if branches is None else ranked.where(F.col("branch") <= branches), "chat-ranked")
    chosen = same(paths, ranked.select("tree", "leaf"), {"tree": "tree", "leaf": "leaf"}, "left_semi")
    texts = own.select(
        "tree", "id", escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"),
        (F.coalesce("role", F.lit("")) == TRAINED).alias("loss"),
    )
    turns = same(chosen, texts, {"tree": "tree", "id": "id"})
    joined = turns.groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text", "loss"))).alias("turns")
    )
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    mark = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit(START), t["role"], F.lit("\n")), mark), part(t["text"], t["loss"]), part(F.lit(f"{END}\n"), mark)
            ),
        )
    )
    formatted = joined.select("tree", "leaf", segments.alias("segments"))
    named = same(ranked, formatted, {"tree": "tree", "leaf": "leaf"})
    return named.select("tree", "leaf", "branch", "score", "n_turns", "segments", F.array_join("segments.text", "").alias("formatted"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, read back."""
    marked = F.split(formatted, re.escape(END) + "\n")
    bodies = F.transform(F.filter(marked, lambda x: x != ""), lambda x: F.substr(x, F.lit(len(START) + 1)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.char_length(role) + 2)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
