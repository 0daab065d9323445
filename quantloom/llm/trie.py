"""Prefix trie of conversations, rolled up by depth bands.

Every distinct sequence of a conversation's first d turns is a node of depth d under the textless
root. A node is named by a 128-bit prefix key: per lane, the running sum of 32-bit hashes of
(depth, role, text), so the key of depth d follows from that of d - 1 in a window, and two
different turn sequences share a key with a chance of about 2^-120.

Subtree totals use fixed-height bands of ``band`` depths. A node adds its value only to its
ancestors in its own band (at most ``band`` rows a node, taken from a bounded window), which
gives every node its total over the part of its subtree inside the band. Band roots (depth a
multiple of ``band``) are then completed from the deepest band up, one round a band: a band root's
total is its band total plus the totals of the band roots one band below it; these totals then
reach the other nodes of the band through the same bounded lists. Rounds grow with the depth
divided by ``band``, rows with the nodes times ``band``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.hot import salted_join
from quantloom.session import materialise

BAND = 8  # depths a band holds
ROOT = "0:0:0:0:0"
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, role, text)``: turns by turn (null first), then role and text; pos from 0.

    Null role or text becomes empty; rows without a conv_id belong to no conversation and go.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def rebuilt(conversations: DataFrame, group: int = 20, lead: int = 4) -> DataFrame:
    """``(conv_id, depth, role, text)`` of every conversation c, rebuilt; depth from 1.

    The first h = crc32(decimal c) % ``lead`` turns of conversation c - c % ``group`` (all of them
    if fewer, none if it is absent), then c's own turns after its first h. Ids of all
    conversations, even those left with no turn, come as a row of depth 0 with null texts.
    """
    turns = ordered_turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % lead
    base = F.col("conv_id") - F.col("conv_id") % group
    ids = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), base.alias("base"))
    heads = turns.where(F.col("pos") < lead - 1).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    borrowed = heads.join(ids, "base").where(F.col("pos") < F.col("h")).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "role", "text"
    )
    taken = heads.groupBy("base").agg(F.count("*").alias("found"))
    own = turns.where(F.col("pos") >= h).withColumn("h", h).withColumn("base", base)
    counts = own.groupBy("base").agg(F.count("*").alias("n")).join(taken, "base", "left")
    placed = salted_join(own, counts, ["base"], "n", F.xxhash64("conv_id", "pos"))
    shift = F.least(F.col("h"), F.coalesce(F.col("found"), F.lit(0))) - F.col("h")
    mine = placed.select("conv_id", (F.col("pos") + shift + 1).alias("depth"), "role", "text")
    starts = ids.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return borrowed.unionByName(mine).unionByName(starts)


def _lanes() -> list[Column]:
    first = F.xxhash64("depth", "role", "text")
    second = F.xxhash64(F.lit("second lane"), "depth", "role", "text")
    mask = F.lit(0xFFFFFFFF)
    return [F.shiftrightunsigned(first, 32), first.bitwiseAND(mask), F.shiftrightunsigned(second, 32), second.bitwiseAND(mask)]


def _ends_digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's conv_ids, comma-joined; rows come sorted by key and id.

    The digest is updated row by row and kept across batches, so a key of any size needs
    constant memory.
    """
    key, digest, first = None, None, True
    for frame in frames:
        keys, out = [], []
        for k, c in zip(frame["key"], frame["conv_id"], strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    out.append(digest.hexdigest())
                key, digest, first = k, hashlib.sha256(), True
            digest.update((b"" if first else b",") + str(int(c)).encode())
            first = False
        if keys:
            yield pd.DataFrame({"key": keys, "ends_sha256": out})
    if key is not None:
        yield pd.DataFrame({"key": [key], "ends_sha256": [digest.hexdigest()]})


def prefix_nodes(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node of the rebuilt conversations ``(conv_id, depth, role, text)``.

    Columns: key, conv_id (least member), depth, parent_conv_id (null at the root), n_convs
    (members), n_children, n_leaves (childless nodes of its subtree, itself included),
    saved_tokens (over its subtree, each node's (n_convs - 1) times the words of its last
    text; none at the root), ends_sha256 (conversations of exactly its depth, as ids
    ascending and comma-joined; the empty string's digest if none). No conversation: no row.
    """
    if band < 1:
        raise ValueError("band must be at least 1")
    by_depth = Window.partitionBy("conv_id").orderBy("depth")
    running = by_depth.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(lane).over(running) for lane in _lanes()]
    keyed = turns.withColumn("key", F.when(F.col("depth") == 0, F.lit(ROOT)).otherwise(F.concat_ws(":", "depth", *sums)))
    rows = materialise(
        keyed.select(
            "conv_id",
            "depth",
            "key",
            "text",
            F.lag("key").over(by_depth).alias("parent"),
            F.lead("key").over(by_depth).isNull().alias("is_end"),
            F.collect_list("key").over(by_depth.rowsBetween(-band, Window.currentRow)).alias("near"),
        ),
        "trie-rows",
    )
    nodes = rows.groupBy("key").agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("text").alias("text"),
        F.first("near").alias("near"),
    )
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = materialise(
        nodes.join(children, "key", "left").select(
            "key",
            "conv_id",
            "depth",
            "parent",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            (F.col("n_children").isNull()).cast("bigint").alias("leaf"),
            ((F.col("n_convs") - 1) * F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).cast("bigint").alias("tokens"),
            "near",
        ),
        "trie-nodes",
    )

    # Totals inside each band: a node reaches its ancestors from the band's top down to itself.
    step = F.col("depth") % band
    within = F.slice("near", -(step + 1), step + 1)
    banded = materialise(
        nodes.select(F.explode(within).alias("key"), "leaf", "tokens")
        .groupBy("key")
        .agg(F.sum("leaf").alias("band_leaves"), F.sum("tokens").alias("band_tokens")),
        "trie-bands",
    )
    roots = nodes.where(step == 0).select("key", "depth", F.when(F.col("depth") > 0, F.col("near")[0]).alias("up"), F.slice("near", 1, band).alias("prev"))
    roots = materialise(roots.join(banded, "key"), "trie-roots")

    # Band roots from the deepest band up: their own band plus the completed roots below.
    deepest = roots.agg(F.max("depth")).first()[0]
    done, last = None, None
    level = deepest if deepest is not None else -1
    while level >= 0:
        these = roots.where(F.col("depth") == level)
        if last is not None:
            below = last.groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
            these = these.join(below, "key", "left")
        else:
            these = these.withColumn("more_leaves", F.lit(0)).withColumn("more_tokens", F.lit(0))
        last = materialise(
            these.select(
                "key",
                "up",
                "prev",
                (F.col("band_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("band_tokens") + F.coalesce("more_tokens", F.lit(0))).alias("saved_tokens"),
            ),
            "trie-level",
        )
        done = last if done is None else done.unionByName(last)
        level -= band
    if done is None:
        return nodes.sparkSession.createDataFrame(
            [], "key string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
        )

    # Every node: its band total plus the completed roots of the next band below it.
    carried = (
        done.where(F.col("up").isNotNull())
        .select(F.explode("prev").alias("key"), "n_leaves", "saved_tokens")
        .groupBy("key")
        .agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
    )
    totals = banded.join(carried, "key", "left").select(
        "key",
        (F.col("band_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("band_tokens") + F.coalesce("more_tokens", F.lit(0))).alias("saved_tokens"),
    )

    ends = (
        rows.where("is_end")
        .select("key", "conv_id")
        .repartition("key")
        .sortWithinPartitions("key", "conv_id")
        .mapInPandas(_ends_digest, "key string, ends_sha256 string")
    )
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    linked = salted_join(nodes.drop("near"), parents, ["parent"], "n", F.xxhash64("key"), how="left")
    return (
        linked.join(totals, "key")
        .join(ends, "key", "left")
        .select(
            "key",
            "conv_id",
            F.col("depth").cast("bigint").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )
