"""The prefix trie of conversations, and what sharing their beginnings saves.

A node is a sequence of turns with which some conversation begins. It is told by the
sum of the digests of its turns, each taken with its place, so that the digests of all
prefixes are running sums and a conversation of any length can be spread over tasks.
Heavy paths: every node goes on to its child with most conversations. A conversation
leaves a heavy path at most log2(conversations) times, as the child that it goes to has
at most half of the node's. Sums over subtrees are suffix sums along the paths, path by
path from the deepest level, and the total of a path is added to the node it hangs from
before the level above is summed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.llm.running import MASK, digest_of_lists, running
from manyview.llm.scratch import Scratch
from manyview.llm.text_columns import word_count

#: What tells a node.
KEY = ["depth", "k1", "k2"]
#: SHA-256 of nothing.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def sequences(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, a, b, words): turns in order from 1, by a digest of role and text.

    Null turns come first, ties by that digest. Null roles and texts are empty. Rows
    without ``conv_id`` are of no known conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    number = lambda begin: F.conv(F.substring(digest, begin, 15), 16, 10).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), number(1).alias("a"), number(16).alias("b"), word_count(text).alias("words")
    )
    rows = scratch.table(rows.withColumn("one", F.lit(1).cast("long")), "turns")
    return running(rows, scratch, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], {"depth": "one"}).select("conv_id", "depth", "a", "b", "words")


def with_shared_starts(rows: DataFrame, scratch: Scratch, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations of which the first turns are those of another: (rows, lengths).

    Conversation c takes the first h turns of c - c % ``every`` in place of its own first
    h, h = crc32(c) % ``most``; fewer if that one has fewer, none if it is not there.
    """
    lengths = scratch.table(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    convs = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h)
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = scratch.table(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    own = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "words")
    heads = rows.where(F.col("depth") < most).withColumnRenamed("conv_id", "base").join(convs, "base").where("depth <= taken")
    return own.unionByName(heads.select("conv_id", "depth", "a", "b", "words")), convs.select("conv_id", "length")


def prefix_trie(rows: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each node of the trie of ``rows`` (conv_id, depth, a, b, words), depths from 1.

    ``lengths`` (conv_id, length) names every conversation, those without turns too; they
    are members of the root, which has depth 0 and no turn. Columns: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 and level, the number of times the way from the root leaves a heavy path.
    No conversation, no node. Repeated conversations share all their nodes.
    """
    prefixes = _prefixes(rows, scratch)
    nodes = _nodes(prefixes, lengths, scratch)
    members = prefixes.select("conv_id", *KEY).join(nodes.select(*KEY, "node", "light"), KEY)
    members = scratch.table(members.select("conv_id", "depth", "node", "light"), "members")
    summed = _subtrees(_on_paths(members, nodes, scratch), scratch)

    last = members.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("node", "depth", "conv_id")
    root = nodes.where("depth = 0").select("node")
    turnless = lengths.where("length = 0").join(F.broadcast(root)).select("node", F.lit(0).cast("long").alias("depth"), "conv_id")  # one root at most
    ends = digest_of_lists(last.unionByName(turnless), scratch, ["node", "depth"], "conv_id")
    return summed.join(ends, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY)).alias("ends_sha256"), "level"
    )


def _prefixes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, words, k1, k2, p1, p2): digests of every prefix and of the one before it."""
    salted = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(MASK))
    turns = rows.select("conv_id", "depth", "words", salted("depth", "a", "b").alias("g1"), salted("b", "a", "depth").alias("g2"))
    turns = scratch.table(turns, "places")
    summed = running(turns, scratch, ["conv_id"], [F.col("depth")], {"k1": "g1", "k2": "g2"}, digests=("k1", "k2"))
    before = [(F.col(k) - F.col(g)).bitwiseAND(F.lit(MASK)).alias(p) for k, g, p in (("k1", "g1", "p1"), ("k2", "g2", "p2"))]
    return scratch.table(summed.select("conv_id", "depth", "words", "k1", "k2", *before), "prefixes")


def _nodes(prefixes: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct prefixes under their smallest member, with children and whether the parent's heavy path leaves them out."""
    zero = F.lit(0).cast("long")
    nodes = prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("words", "p1", "p2")])
    root = lengths.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in KEY], "node", "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = scratch.table(nodes.unionByName(root), "nodes")

    of_parent = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    largest = F.min(F.struct((-F.col("n_convs")).alias("less"), F.col("node").alias("heavy")))
    kids = of_parent.agg(F.count("*").alias("n_children"), largest.alias("largest")).select(*KEY, "n_children", "largest.heavy")
    known = scratch.table(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "known")
    above = known.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    out = known.drop("heavy").join(above, ["depth", "p1", "p2"], "left").withColumn("light", F.col("node") != F.col("chosen"))
    return scratch.table(out.drop("chosen", "p1", "p2"), "flagged")


def _on_paths(members: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes with the head of their heavy path and its level, in a folder for each level.

    Both are read off one conversation of the node, the smallest: the last node at which
    it left a heavy path, and how often it did.
    """
    light = F.col("light")
    steps = members.select("conv_id", "depth", "node", light.cast("long").alias("one"), F.when(light, F.col("node")).alias("h1"), F.when(light, F.col("depth")).alias("h2"))
    seen = running(steps, scratch, ["conv_id"], [F.col("depth")], {"level": "one"}, last={"head": "h1", "head_depth": "h2"})
    own = seen.where("conv_id = node").select("node", "depth", "level", "head", "head_depth")
    root = nodes.where("depth = 0").select(F.col("node").alias("root"))
    out = nodes.join(own, ["node", "depth"], "left").join(F.broadcast(root))  # one root at most
    out = out.withColumns({"level": F.coalesce("level", F.lit(0).cast("long")), "head": F.coalesce("head", "root"), "head_depth": F.coalesce("head_depth", F.lit(0).cast("long"))})
    return scratch.table(out.drop("root", "light", "k1", "k2"), "paths", by=["level"])


def _subtrees(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds n_leaves and saved_tokens, level by level from the deepest."""
    deepest = nodes.agg(F.max("level")).first()[0]
    done, hanging = [], None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        mine = nodes.where(F.col("level") == level)
        leaves, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
        if hanging is not None:
            mine = mine.join(hanging, ["node", "depth"], "left")
            leaves, saved = leaves + F.coalesce("below_leaves", F.lit(0)), saved + F.coalesce("below_saved", F.lit(0))
        mine = mine.withColumns({"leaves": leaves, "saved": saved}).drop("below_leaves", "below_saved")
        sums = running(mine, scratch, ["head", "head_depth"], [F.desc("depth")], {"n_leaves": "leaves", "saved_tokens": "saved"})
        done.append(scratch.table(sums, "level"))
        heads = done[-1].where("depth = head_depth").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("depth"))
        hanging = heads.agg(F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))
    if not done:
        return nodes.withColumns({"n_leaves": F.lit(0).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    return reduce(DataFrame.unionByName, done)
