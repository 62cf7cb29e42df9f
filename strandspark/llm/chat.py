"""Chat formatting of reply trees: paths from root to leaf, ranked by score, each one conversation.

Messages name the message that they reply to. Self-joins by doubling (each message's ancestor 1, 2, 4, ...
replies up, and the scores summed on the way) reach every root in as many rounds as the deepest path has
binary digits; a leaf's branch then has the sum of its messages' scores. The best branches of a tree are
ranked without a window over the tree: first by slices of its leaves, then the slices' best against each other.
Paths of the chosen leaves only are enumerated, again by doubling: a path's messages at distances 0 to 2**k - 1,
and those 2**k further up. So a bushy tree's paths are never all written out. Text joins last, once.

A turn is ``<|role|>``, a line end, its text, ``</s>`` and a line end. Control strings (CONTROLS) inside roles and
texts get a backslash after their first character, and backslashes are doubled before; ``unescape`` takes both back,
so no text can end a turn or begin one, and ``read_back`` gets roles and texts from the formatted text alone.
``loss`` has the spans of trained roles' texts, escaped, in code points.

Defined results: a null role, text or score is empty, empty or 0; a null tree id is a tree; a message whose
parent is null, missing or itself is a root; repeated rows of a message, which have the same tree and id, are one
message, the one with the smallest role and text; a message without an id is its own root and nobody's parent;
branches of equal score rank by their leaf's id, role and text; a reply cycle has no root and raises
ValueError; an empty table gives an empty table; extra columns are not read. A conversation is one text and so
meets in one row, whatever its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandspark.session import materialise

#: Control strings of common chat templates, none of which ends as another begins.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, SHUT, CLOSE = "<|", "|>\n", "</s>\n"
TRAINED = ("assistant",)
#: Slices of a tree's leaves that are ranked apart.
SLICES = 64


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def message_table(messages: DataFrame, tree_col: str, id_col: str, parent_col: str, role_col: str, text_col: str, score_col: str | None) -> DataFrame:
    """(node, up, tree, role, text, score): one row a message under a number of its own, written once; ``up`` is null at roots."""
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    rows = messages.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), score.alias("score"))
    named = rows.where("id is not null").groupBy("tree", "id").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "id", "m.*")
    alone = rows.where("id is null").select("tree", "id", "role", "text", F.lit(None).cast(rows.schema["parent"].dataType).alias("parent"), "score")
    numbered = materialise(named.unionByName(alone).withColumn("node", F.monotonically_increasing_id()), "chat-messages")
    places = numbered.where("id is not null").select(F.col("tree").alias("to_tree"), F.col("id").alias("to"), F.col("node").alias("up"))
    replies = numbered["tree"].eqNullSafe(places["to_tree"]) & (numbered["parent"] == places["to"])
    linked = numbered.join(places, replies, "left")
    return materialise(linked.select("node", F.when(F.col("up") != F.col("node"), F.col("up")).alias("up"), "tree", "id", "role", "text", "score"), "chat-linked")


def chain_table(messages: DataFrame, tree_col: str, order: list[str], role_col: str, text_col: str) -> DataFrame:
    """The same for conversations without replies: each row answers the one before it, by ``order``, role and text."""
    named = messages.select(F.col(tree_col).alias("tree"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    numbered = materialise(named.withColumn("node", F.monotonically_increasing_id()), "chat-messages")
    before = F.lag("node").over(Window.partitionBy("tree").orderBy(*[f"o{k}" for k in range(len(order))], "role", "text", "node"))
    return materialise(numbered.select("node", before.alias("up"), "tree", F.lit(None).cast("long").alias("id"), "role", "text", F.lit(0.0).alias("score")), "chat-linked")


def ancestors(linked: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (node, up) of ancestors 1, 2, 4, ... replies up, and (node, score): the sum from each message to its root."""
    most = linked.count()
    now = linked.select("node", "up", "score")
    climbing, there = now.where("up is not null"), now.where("up is null")
    steps: list[DataFrame] = []
    while not climbing.isEmpty():
        if 2 ** len(steps) > most:
            raise ValueError("messages reply to each other in a cycle, which has no root")
        steps.append(climbing.select("node", "up"))
        above = climbing.unionByName(there).select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("score").alias("more"))
        joined = climbing.join(above, climbing["up"] == above["at"])
        now = materialise(joined.select("node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score")), "chat-ancestors")
        # who has reached a root climbs no further, so a few long paths don't move all messages again
        climbing, there = now.where("up is not null"), there.unionByName(now.where("up is null"))
    return steps, there.select("node", "score")


def best_branches(linked: DataFrame, scores: DataFrame, branches: int) -> DataFrame:
    """(leaf, branch, total): the ``branches`` best leaves of each tree, ranked from 1."""
    if branches < 1:
        raise ValueError("at least one branch of a tree is formatted")
    parents = linked.select(F.col("up").alias("node")).where("node is not null")
    leaves = linked.select("node", "tree", "id", "role", "text").join(parents, "node", "left_anti").join(scores.withColumnRenamed("score", "total"), "node")
    order = [F.desc("total"), "id", "role", "text", "node"]
    sliced = leaves.withColumn("slice", F.pmod(F.xxhash64("node"), F.lit(SLICES)))
    few = sliced.withColumn("k", F.row_number().over(Window.partitionBy("tree", "slice").orderBy(*order))).where(F.col("k") <= branches)
    ranked = few.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("branch") <= branches)
    return ranked.select(F.col("node").alias("leaf"), "branch", "total")


def enumerate_paths(chosen: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(leaf, node, up): every message of the chosen leaves' paths, ``up`` replies above its leaf."""
    paths = chosen.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, step in enumerate(steps):
        higher = paths.join(step.withColumnRenamed("up", "next"), "node").select("leaf", F.col("next").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths = paths.unionByName(materialise(higher, "chat-paths"))
    return paths


def format_branches(linked: DataFrame, branches: int = 1, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(tree, branch, score, formatted, loss) of the ``branches`` best paths of each tree in ``linked``."""
    steps, scores = ancestors(linked)
    chosen = materialise(best_branches(linked, scores, branches), "chat-branches")
    turns = enumerate_paths(chosen, steps).join(linked.select("node", "tree", "role", "text"), "node")
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(SHUT))
    turn = F.struct((-F.col("up")).alias("at"), F.concat(head, text, F.lit(CLOSE)).alias("turn"), F.length(head).alias("head"), F.col("role").isin(*trained).alias("trained"))
    # sorted in a column of its own: else Spark may sort again for each use
    joined = turns.select("leaf", "tree", turn.alias("turn")).groupBy("leaf").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        stop = acc["at"] + F.length(t["turn"])
        span = F.struct((acc["at"] + t["head"]).alias("start"), (stop - len(CLOSE)).alias("stop"))
        return F.struct(stop.alias("at"), F.when(t["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    out = joined.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["turn"]), "")).withColumn("loss", F.aggregate("turns", start, add)["spans"])
    return out.join(chosen, "leaf").select("tree", "branch", F.col("total").alias("score"), "formatted", "loss")


def format_trees(messages: DataFrame, tree_col: str = "tree_id", id_col: str = "message_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str | None = "score", branches: int = 1, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(tree, branch, score, formatted, loss): the ``branches`` best paths of each reply tree as conversations."""
    return format_branches(message_table(messages, tree_col, id_col, parent_col, role_col, text_col, score_col), branches, trained)


def format_chains(messages: DataFrame, tree_col: str = "conv_id", order: tuple[str, ...] = ("turn",), role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """The same for conversations whose turns have an order and no replies: a tree of one path each."""
    return format_branches(chain_table(messages, tree_col, list(order), role_col, text_col), 1, trained)


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    whole = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(piece: Column) -> Column:
        shut = F.instr(piece, SHUT)
        return F.struct(unescape(F.substring(piece, F.lit(len(OPEN) + 1), shut - len(OPEN) - 1)).alias("role"), unescape(F.substring(piece, shut + len(SHUT), F.length(piece))).alias("text"))

    return F.transform(whole, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
