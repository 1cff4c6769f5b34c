"""Prefix trie of conversations: one ROLLUP over positional turn columns finds every shared prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.joins import lookup_join, number_rows
from meterline.llm.frames import pick, written

BLOCK_TURNS = 8
CHAIN = 256
LIST_IDS = 4_096
ROOT = "X'00'"
WORD = r"[^\x20\x09-\x0D]+"


def digest(value: Column) -> Column:
    """The first 128 bits of the SHA-256."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def identified_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, turn_id (a digest of role and text) and words of every row that has a conv_id; the text stays behind."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role keeps ("a", "bc") and ("ab", "c") apart.
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = pick(turns, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest(named).alias("turn_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def spliced(turns: DataFrame, group: int = 20, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first turns taken from the first conversation of its group of ids.

    `turns` are identified turns. Conversation c starts with the first h turns of
    conversation c - c % `group` (a remainder has the sign of c) and goes on with
    its own turns after the first h, where h = crc32(decimal c) % (`longest` + 1).
    Returns the turns, whose `turn` is the place they had, and all conversation ids.
    """
    in_order = [F.col("turn").asc_nulls_first(), F.col("turn_id")]
    placed = written(number_rows(turns, ["conv_id"], in_order, "place")).drop("turn")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    ids = written(placed.select("conv_id").distinct())
    own = placed.filter(F.col("place") > taken)
    heads = placed.filter(F.col("place") <= longest).withColumnRenamed("conv_id", "first_id")
    # A group has at most 2 * `group` - 1 members, so no first turn is copied more often.
    members = ids.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % group).withColumn("taken", taken)
    borrowed = members.join(heads, "first_id").filter("place <= taken").select(*placed.columns)
    return own.unionByName(borrowed).withColumnRenamed("place", "turn"), ids


def chained(items: DataFrame) -> DataFrame:
    """Adds to items (conv_id, n, digest, words) the key of what comes before, the key after, and the words before.

    Equal prefixes of items have equal keys. `CHAIN` items of a conversation are
    chained at a time and their digests one level higher, so that no task holds
    a whole conversation.
    """
    grouped = items.withColumn("_group", F.expr(f"n div {CHAIN}"))
    inside = Window.partitionBy("conv_id", "_group").orderBy("n")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    listed = grouped.select(
        "*",
        F.collect_list("digest").over(before).alias("_earlier"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_words"),
    )
    highest = items.agg(F.max("n").alias("n")).first().n
    if highest is None or highest < CHAIN:
        joined = listed.withColumns({"_key": F.expr(ROOT), "_after": F.lit(None).cast("binary"), "_base": F.lit(0)})
    else:
        together = F.sort_array(F.collect_list(F.struct("n", "digest")))
        upper = grouped.groupBy("conv_id", F.col("_group").alias("n")).agg(
            digest(F.array_join(F.transform(together, lambda x: F.hex(x["digest"])), "").cast("binary")).alias("digest"),
            F.sum("words").alias("words"),
        )
        above = chained(written(upper)).select(
            "conv_id",
            F.col("n").alias("_group"),
            F.col("key").alias("_key"),
            F.col("next_key").alias("_after"),
            F.col("before").alias("_base"),
        )
        joined = listed.join(above, ["conv_id", "_group"])

    def key(digests: Column) -> Column:
        text = F.array_join(F.transform(digests, F.hex), "")
        return F.when(F.size(digests) == 0, F.col("_key")).otherwise(digest(F.concat(F.hex("_key"), F.lit("/"), text).cast("binary")))

    through = key(F.array_append("_earlier", F.col("digest")))
    last = (F.col("n") % CHAIN == CHAIN - 1) & F.col("_after").isNotNull()
    return joined.select(
        *items.columns,
        key(F.col("_earlier")).alias("key"),
        F.when(last, F.col("_after")).otherwise(through).alias("next_key"),
        (F.col("_base") + F.col("_words")).alias("before"),
    )


def turn_blocks(numbered: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation and `BLOCK_TURNS` turns: key, next_key, p1, p2, ... (turn ids) and c0, c1, ... (words up to there).

    A conversation without turns has one row without turn ids.
    """
    place = F.struct(((F.col("depth") - 1) % BLOCK_TURNS).alias("at"), "turn_id", "words")
    parts = numbered.groupBy("conv_id", F.expr(f"(depth - 1) div {BLOCK_TURNS}").alias("n")).agg(
        F.sort_array(F.collect_list(place)).alias("part")
    )
    parts = written(
        parts.select(
            "conv_id",
            "n",
            "part",
            digest(F.array_join(F.transform("part", lambda x: F.hex(x["turn_id"])), "").cast("binary")).alias("digest"),
            F.aggregate("part", F.lit(0).cast("long"), lambda total, x: total + x["words"]).alias("words"),
        )
    )
    keys = chained(parts.drop("part")).select("conv_id", "n", "key", "next_key", "before")
    joined = parts.join(keys, ["conv_id", "n"])
    turnless = ids.join(parts.filter("n = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id",
        F.lit(0).cast("long").alias("n"),
        F.lit(None).cast(parts.schema["part"].dataType).alias("part"),
        F.expr(ROOT).alias("key"),
        F.expr(ROOT).alias("next_key"),
        F.lit(0).cast("long").alias("before"),
    )
    every = joined.select(*turnless.columns).unionByName(turnless)
    turn_ids = [F.get("part", F.lit(i))["turn_id"].alias(f"p{i + 1}") for i in range(BLOCK_TURNS)]
    words = [F.coalesce(F.get("part", F.lit(i))["words"], F.lit(0)) for i in range(BLOCK_TURNS)]
    totals = [F.col("before").alias("c0")]
    running = F.col("before")
    for i, word in enumerate(words):
        running = running + word
        totals.append(running.alias(f"c{i + 1}"))
    return every.select("conv_id", F.col("n").alias("block"), "key", "next_key", *turn_ids, *totals)


def rolled_up(blocks: DataFrame, measures: dict[str, str]) -> DataFrame:
    """One row per node: pid, parent_pid, depth and the measures (name: SQL aggregate) over the conversations through it.

    All prefixes of a block are aggregated together by one ROLLUP; the grouping
    columns that are not rolled up say how deep a row lies. A block starts at the
    node where the one before it ended, whose id is its key.
    """
    turns = [f"p{i}" for i in range(1, BLOCK_TURNS + 1)]
    depth_in_block = " + ".join(f"1 - grouping({p})" for p in turns)
    rollup = ", ".join(turns[:-1]) + f", ({turns[-1]}, next_key)"
    aggregates = ", ".join(f"{how} as {name}" for name, how in measures.items())
    rows = blocks.sparkSession.sql(
        f"select block, key, next_key, {', '.join(turns)}, cast({depth_in_block} as int) as at, {aggregates} "
        f"from {{blocks}} group by block, key, rollup({rollup})",
        blocks=blocks,
    )
    real = (F.col("at") == 0) & (F.col("block") == 0) | F.get(F.array(*turns), F.col("at") - 1).isNotNull()

    def path(upto: Column) -> Column:
        pieces = [F.when(upto >= i, F.hex(p)).otherwise("") for i, p in enumerate(turns, 1)]
        return digest(F.concat(F.hex("key"), *pieces).cast("binary"))

    at = F.col("at")
    pid = F.when(at == 0, F.col("key")).when(at == BLOCK_TURNS, F.col("next_key")).otherwise(path(at))
    parent = F.when(at == 1, F.col("key")).when(at > 1, path(at - 1))
    return rows.filter(F.coalesce(real, F.lit(False))).select(
        pid.alias("pid"),
        parent.alias("parent_pid"),
        (F.col("block") * BLOCK_TURNS + at).alias("depth"),
        "at",
        *measures,
    )


def hashed_lists(ends: DataFrame) -> DataFrame:
    """ends_sha256 of the ascending conv_ids of each pid, joined by commas.

    Ids are numbered within their node and joined in pieces of `LIST_IDS`; the
    digest runs over the pieces of a node in order, so a list of any length
    passes through in bounded memory.
    """
    numbered = number_rows(ends, ["pid"], [F.col("conv_id")], "nth")
    pieces = numbered.groupBy("pid", F.expr(f"(nth - 1) div {LIST_IDS}").alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            found, shas = [], []
            for pid, ids in zip(batch.column("pid").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if pid == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    found.append(node)
                    shas.append(state.hexdigest())
                node, state = pid, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(shas, pa.string())], ["pid", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["pid", "ends_sha256"]
            )

    by_node = pieces.repartition("pid").sortWithinPartitions("pid", "piece")
    return by_node.select("pid", "ids").mapInArrow(digests, "pid binary, ends_sha256 string")


def trie_of(identified: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The trie of identified turns; `ids` are all conversations, if some may have no turn."""
    in_order = [F.col("turn").asc_nulls_first(), F.col("turn_id")]
    numbered = written(number_rows(identified, ["conv_id"], in_order, "depth"))
    members = ids if ids is not None else numbered.select("conv_id").distinct()
    blocks = written(turn_blocks(numbered, members))
    turns = [f"p{i}" for i in range(1, BLOCK_TURNS + 1)]
    totals = [f"c{i}" for i in range(BLOCK_TURNS + 1)]
    paths = ["block", "key", "next_key", *turns]
    # Copies of a path become one row before the prefixes multiply it. Words up to a node are the same for all its members.
    distinct = blocks.groupBy(*paths).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("smallest"), *[F.max(c).alias(c) for c in totals]
    )
    counted = rolled_up(
        distinct, {"n_convs": "sum(n)", "conv_id": "min(smallest)", **{f"w{i}": f"max({c})" for i, c in enumerate(totals)}}
    )
    upto = F.array(*[f"w{i}" for i in range(BLOCK_TURNS + 1)])
    through = F.get(upto, F.col("at"))
    before = F.when(F.col("at") > 0, F.get(upto, F.col("at") - 1)).otherwise(F.lit(0))
    nodes = written(
        counted.select("pid", "parent_pid", "depth", "conv_id", "n_convs", before.alias("before"), (through - before).alias("words"))
    )
    children = nodes.filter("depth > 0").groupBy(F.col("parent_pid").alias("pid")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "pid", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # A conversation owns the nodes of which it is the smallest member: the end of its path. Every node has one owner, so sums over
    # owners are sums over distinct nodes.
    owned = nodes.groupBy("conv_id").agg(
        F.sum("words").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaves")
    )
    measures = blocks.groupBy("conv_id").agg(F.max("block").alias("last_block"), F.max(totals[-1]).alias("total"))
    measures = written(measures.join(owned, "conv_id", "left").na.fill(0, ["own", "leaves"]))
    measured = written(lookup_join(blocks, measures, ["conv_id"]))
    sums = {f"sum_{m}": f"sum({m})" for m in ("total", "own", "leaves")}
    weighed = measured.groupBy(*paths).agg(*[F.sum(m).alias(m) for m in ("total", "own", "leaves")])
    below = rolled_up(weighed, sums).select("pid", *sums)

    count = sum((F.col(p).isNotNull().cast("int") for p in turns), F.lit(0))
    last = F.when(count == 0, F.col("key")).when(count == BLOCK_TURNS, F.col("next_key"))
    last = last.otherwise(digest(F.concat(F.hex("key"), *[F.coalesce(F.hex(p), F.lit("")) for p in turns]).cast("binary")))
    ends = hashed_lists(measured.filter("block = last_block").select(last.alias("pid"), "conv_id"))

    parents = nodes.filter("n_children > 0").select(F.col("pid").alias("parent_pid"), F.col("conv_id").alias("parent_conv_id"))
    owners = measures.select("conv_id", (F.col("total") - F.col("own")).alias("lead"))
    known = lookup_join(nodes, parents, ["parent_pid"])
    known = lookup_join(known, owners, ["conv_id"])
    full = known.join(below, "pid").join(ends, "pid", "left")
    # Words of all members from here on, less the words of the distinct nodes from here on.
    every = F.col("sum_total") - F.col("n_convs") * F.col("before")
    once = F.col("sum_own") + F.col("lead") - F.col("before")
    return full.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("sum_leaves")).alias("n_leaves"),
        (every - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Trie of conversations (conv_id, turn, role, text): one row per distinct sequence of first turns.

    Turns are ordered by `turn`, null first; ties by a digest of role and text.
    Returns conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens (words that storing each
    node of the subtree once saves) and ends_sha256 (of the members that end
    here). A null role or text counts as empty, rows without conv_id belong to no
    conversation, repeated rows are turns of their own, an empty table has no
    node, further columns are ignored. Turns compare by 128 bits of SHA-256.
    """
    return trie_of(identified_turns(turns))


def spliced_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt by `spliced`; other cases as in `prefix_trie`."""
    return trie_of(*spliced(identified_turns(turns)))
