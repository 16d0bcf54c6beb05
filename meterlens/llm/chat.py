"""Chat formatting: snapshots of growing conversations collapse to the longest, which is rendered.

A conversation that was logged after every turn leaves prefixes of itself behind. The hash of a
prefix combines keyed hashes of (place, role, text) of its turns, 128 bits in all, so that it can
be carried on from block to block of a long conversation. A conversation whose hash is that of a
shorter prefix of another is a snapshot and goes; of equal conversations the smallest id stays.

A conversation is cut into blocks of ``BLOCK`` turns. Only one small row a block is ever
looked at per conversation, so a conversation may hold a third of all rows; prefixes that many
conversations share are merged before the shuffle, and no pair of conversations is formed.

Defined cases: turns come by number (null first), then role and text; exact repeats of a row count
once. A null id, role or text is a value of its own; a null role is rendered ``unknown``, a null
text empty. Markers inside a text are broken up (``<|`` becomes ``< |``), so a text cannot open a
turn. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.operators.chunks import running_total
from meterlens.session import settle

BLOCK = 1024


def rendered(role: Column, text: Column) -> Column:
    """One turn in the ChatML layout."""
    def safe(c):
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    return F.concat(F.lit("<|im_start|>"), safe(F.coalesce(role, F.lit("unknown"))), F.lit("\n"),
                    safe(F.coalesce(text, F.lit(""))), F.lit("<|im_end|>\n"))


def placed_turns(turns: DataFrame) -> DataFrame:
    """Distinct rows with their block and place in the block, written once.

    A turn's place in its conversation is a running total over range partitions, so turns of one number, or
    without one, are spread over blocks like any others.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct().withColumns(
        {"known": F.col("conv_id").isNotNull(), "conversation": F.coalesce(F.col("conv_id"), F.lit(0))})
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    ranked = running_total(rows, ["known", "conversation"], order, F.lit(1).cast("long"), "rank")
    return settle(ranked.select("conv_id", "turn", "role", "text", F.floor(F.col("rank") / BLOCK).alias("block"),
                                (F.col("rank") % BLOCK + 1).cast("int").alias("inside")))


def prefix_hashes(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, a, b) of every prefix, and (conv_id, block, part, before, n, a, b) of every block."""
    by_block = Window.partitionBy("conv_id").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "block", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        (F.row_number().over(by_block) - 1).alias("part"))

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["conv_id"].eqNullSafe(right["conv_id"]) & (left["block"] == right["block"])

    sizes = settle(sizes)
    terms = placed.join(sizes, same(placed, sizes)).select(
        placed["conv_id"], placed["block"], "inside", (F.col("before") + F.col("inside")).alias("place"), "role", "text")
    # Nulls do not change xxhash64, so they are told apart by a flag of their own.
    parts = [F.col("place"), F.col("role"), F.col("role").isNull(), F.col("text"), F.col("text").isNull()]
    hashed = terms.select("conv_id", "block", "inside", "place",
                          F.xxhash64(F.lit("a"), *parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))
    running = Window.partitionBy("conv_id", "block").orderBy("inside").rowsBetween(Window.unboundedPreceding, 0)
    running_hashes = settle(hashed.select("conv_id", "block", "place", *[F.bit_xor(c).over(running).alias(c) for c in "ab"]))
    # The last prefix of a block is the block's own hash.
    whole = running_hashes.groupBy("conv_id", "block").agg(*[F.max_by(c, "place").alias(c) for c in "ab"])
    blocks = settle(sizes.join(whole, same(sizes, whole)).select(
        sizes["conv_id"], sizes["block"], "part", "before", "n",
        *[F.coalesce(F.bit_xor(c).over(earlier_of(sizes)), F.lit(0)).alias(f"{c}0") for c in "ab"], "a", "b"))
    prefixes = running_hashes.join(blocks.drop("a", "b"), same(running_hashes, blocks)).select(
        running_hashes["conv_id"], "place", *[F.col(c).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "ab"])
    return prefixes, blocks


def earlier_of(frame: DataFrame):
    return Window.partitionBy(frame["conv_id"]).orderBy(frame["block"]).rowsBetween(Window.unboundedPreceding, -1)


def maximal_conversations(prefixes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of conversations that are no snapshot of another."""
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    first = F.struct(F.col("conv_id").isNotNull().alias("known"), F.col("conv_id"))
    distinct = whole.groupBy("n_turns", "a", "b").agg(F.min(first)["conv_id"].alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = prefixes.join(whole.select("conv_id", "n_turns"), prefixes["conv_id"].eqNullSafe(whole["conv_id"])).where(
        "place < n_turns").select(F.col("place").alias("n_turns"), "a", "b").distinct()
    return distinct.join(proper, ["n_turns", "a", "b"], "left_anti").select("conv_id", "n_turns", "copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, text): one row a block of each conversation that stays, most have one."""
    placed = placed_turns(turns)
    prefixes, blocks = prefix_hashes(placed)
    kept = settle(maximal_conversations(prefixes, blocks))
    stays = placed.join(kept, placed["conv_id"].eqNullSafe(kept["conv_id"])).select(
        placed["conv_id"], "block", "inside", "copies", rendered(F.col("role"), F.col("text")).alias("said"))
    parts = stays.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("n_turns"), F.max("copies").alias("copies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inside", "said"))), lambda x: x["said"]), "").alias("text"))
    return parts.join(blocks, parts["conv_id"].eqNullSafe(blocks["conv_id"]) & (parts["block"] == blocks["block"])).select(
        parts["conv_id"], F.col("part").cast("long").alias("part"), "n_turns", "copies", "text")


ORACLE = """
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
                FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
said AS (SELECT conv_id, place, replace(coalesce(role, 'unknown'), '<|', '< |') AS who, replace(coalesce(text, ''), '<|', '< |') AS what,
                md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')) AS term FROM placed),
prefixes AS (SELECT conv_id, place, string_agg(term, ' ') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM said),
whole AS (SELECT conv_id, max(place) AS n_turns, max_by(prefix, place) AS prefix FROM prefixes GROUP BY conv_id),
firsts AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM whole GROUP BY prefix, n_turns),
shorter AS (SELECT DISTINCT p.prefix FROM prefixes p JOIN whole w USING (conv_id) WHERE p.place < w.n_turns),
kept AS (SELECT * FROM firsts WHERE prefix NOT IN (SELECT prefix FROM shorter))
SELECT s.conv_id, ((s.place - 1) // 1024)::BIGINT AS part, count(*) AS n_turns, max(k.copies) AS copies,
       string_agg('<|im_start|>' || who || chr(10) || what || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM said s JOIN kept k ON s.conv_id = k.conv_id GROUP BY 1, 2"""
