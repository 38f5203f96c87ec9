"""Prefix trie of conversations, with subtree totals by a rollup in depth bands.

A node is a distinct sequence of first turns. It is known by its depth and two
64-bit XORs of its turns' hashes (each hash covers the turn's place, role and
text), so a conversation's nodes are running XORs over its turns, and equal
sequences meet by grouping: no text is compared or moved past the scan.

Subtree totals would need every node under each of its ancestors. Instead
depths are cut into bands of ``BAND``. Within a band a node explodes only to
its ancestors there (at most ``BAND`` rows). The nodes at the bands' tops, with
the totals of their bands as weights, form a trie of a ``BAND``-th of the
depth, which is rolled up the same way; then the completed total of each band
top goes to its ancestors in the band above (again at most ``BAND`` rows). So a
trie of depth D takes log(D) / log(``BAND``) rounds, and rows grow by at most
``BAND`` in the first and less in all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import checkpointed

#: Depths of a band.
BAND = 8
#: Turns that running XORs take at once; a longer conversation's stretches are joined by their totals.
STRETCH = 1024
#: Members of a node are listed by stretches of so many neighbouring conversation numbers (a power of two).
LISTED = 4096

_NODE = ("depth", "x", "y")


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (0, 1, ... within the conversation), digest (of role and text) and n_bytes (of the text) of every row.

    Rows without a conversation number are left out. Null turns come first;
    equal ones are in order of their digests (rows equal in that, too, are
    alike). Only numbers and digests are sorted, in ranges over all
    conversations, so that one of any length is cut.
    """
    said, spoken = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    marked = F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, F.lit(":"), spoken)
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.md5(marked.cast("binary")).alias("digest"),
        F.octet_length(spoken).cast("long").alias("n_bytes"),
    )
    # tells equal rows apart, so that a range can be cut among them
    rows = checkpointed(rows).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("row").asc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(sorted_rows.select("conv", "digest", "n_bytes", F.monotonically_increasing_id().alias("at")))
    # a conversation lies in neighbouring ranges: how many of its rows came in those before
    shares = placed.groupBy("conv", F.shiftright("at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    upto = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    return (
        placed.withColumn("range", F.shiftright("at", 33))
        .join(shares.select("conv", "range", "first", "before"), ["conv", "range"])
        .select("conv", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "digest", "n_bytes")
    )


def rebuilt_turns(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as their family's first one does: (conv, n_turns) and (conv, place, digest, n_bytes).

    Conversation c takes the first h turns of c - c % ``family`` (all if it has
    fewer, none if it is absent) and its own turns after its first h; h is the
    CRC-32 of c's digits modulo ``heads``.
    """
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.withColumns({"h": head, "base": F.col("conv") - F.col("conv") % family})
    bases = convs.where("conv = base").select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    taken = F.least("h", F.coalesce("base_turns", F.lit(0)))
    convs = checkpointed(convs.join(bases, "base", "left").select("conv", "base", "h", "own", taken.alias("taken")))
    first = turns.where((F.col("conv") % family == 0) & (F.col("place") < heads - 1)).withColumnRenamed("conv", "base")
    lent = first.join(convs, "base").where("place < h").select("conv", "place", "digest", "n_bytes")
    kept = turns.join(convs, "conv").where("place >= h")
    kept = kept.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "n_bytes")
    sizes = convs.select("conv", (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("taken")).alias("n_turns"))
    return sizes, lent.unionByName(kept)


def prefixes(sizes: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth, from 0: conv, depth, x, y (the node), px, py (its parent), n_bytes, ends."""
    x, y = (F.xxhash64(F.lit(i).cast("long"), F.col("place"), F.col("digest")) for i in (1, 2))
    hashed = turns.select("conv", (F.col("place") + 1).alias("depth"), x.alias("hx"), y.alias("hy"), "n_bytes")
    hashed = hashed.withColumn("stretch", F.floor((F.col("depth") - 1) / STRETCH).cast("long"))
    within = Window.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.withColumns({"x": F.bit_xor("hx").over(within), "y": F.bit_xor("hy").over(within)})
    # the XOR of the stretches before, where there are any
    upto = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy("conv", "stretch").agg(F.bit_xor("hx").alias("tx"), F.bit_xor("hy").alias("ty"))
    totals = totals.select("conv", "stretch", F.bit_xor("tx").over(upto).alias("bx"), F.bit_xor("ty").over(upto).alias("by"))
    joined = running.join(totals.where("bx IS NOT NULL"), ["conv", "stretch"], "left").join(sizes, "conv")
    node = {c: F.col(c).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long"))) for c, b in (("x", "bx"), ("y", "by"))}
    below = joined.select("conv", "depth", node["x"].alias("x"), node["y"].alias("y"), "hx", "hy", "n_bytes", (F.col("depth") == F.col("n_turns")).alias("ends"))
    below = below.select("conv", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "n_bytes", "ends")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = sizes.select(
        "conv", zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("n_bytes"),
        (F.col("n_turns") == 0).alias("ends"),
    )
    return root.unionByName(below)


def _with_paths(rows: DataFrame) -> DataFrame:
    """Adds to rows (conv, depth, x, y) the nodes on the way to each.

    ``path``: those in its band (depths from the last multiple of ``BAND``),
    itself included; ``above``, for a band's top: those of the band over it,
    without that band's top.
    """
    node = F.struct("x", "y")
    band, over = F.floor(F.col("depth") / BAND), F.floor((F.col("depth") - 1) / BAND)
    along = lambda part: F.collect_list(node).over(
        Window.partitionBy("conv", part).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    )
    is_top = (F.col("depth") % BAND == 0) & (F.col("depth") > 0)
    out = rows.withColumns({"band": band, "over": over})
    out = out.withColumn("path", along(F.col("band"))).withColumn("above", F.when(is_top, along(F.col("over"))))
    return out.drop("band", "over")


def rollup(rows: DataFrame, weights: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """Of every node (depth, x, y) the sums of its subtree's weights (its own included).

    ``rows``: conv, depth, x, y for each conversation and depth up to its end;
    ``weights``: a row for each node with the columns ``sums``.
    """
    pathed = _with_paths(rows).groupBy(*_NODE).agg(F.any_value("path").alias("path"), F.any_value("above").alias("above"))
    pathed = checkpointed(pathed.join(weights, [*_NODE]))
    # each node to its ancestors in its band and to itself
    exploded = pathed.select("depth", F.posexplode("path").alias("pos", "to"), *sums)
    top = F.col("depth") - F.col("depth") % BAND
    partial = exploded.groupBy((top + F.col("pos")).alias("depth"), F.col("to.x").alias("x"), F.col("to.y").alias("y"))
    partial = partial.agg(*(F.sum(c).alias(c) for c in sums))
    if deepest < BAND:
        return partial
    partial = checkpointed(partial)
    # the bands' tops, their bands' totals as weights, are a trie of their own
    at_top = (F.col("depth") % BAND == 0).alias("is_top")
    tops = rows.where(at_top).select("conv", (F.col("depth") / BAND).cast("long").alias("depth"), "x", "y")
    top_weights = partial.where(at_top).withColumn("depth", (F.col("depth") / BAND).cast("long"))
    done = rollup(tops, top_weights, sums, deepest // BAND).withColumn("depth", F.col("depth") * BAND)
    done = checkpointed(done)
    # each completed top to its ancestors below the next top
    sent = done.join(pathed.where(F.col("above").isNotNull()).select(*_NODE, "above"), [*_NODE])
    sent = sent.select("depth", F.posexplode(F.slice("above", 1, BAND - 1)).alias("pos", "to"), *sums)
    sent = sent.select((F.col("depth") - (BAND - 1) + F.col("pos")).alias("depth"), F.col("to.x").alias("x"), F.col("to.y").alias("y"), *sums)
    inner = partial.where(~at_top).unionByName(sent).groupBy(*_NODE).agg(*(F.sum(c).alias(c) for c in sums))
    return done.unionByName(inner)


def _end_lists(rows: DataFrame) -> DataFrame:
    """depth, x, y and ends_sha256 of the nodes at which conversations end.

    Ids are first joined within stretches of ``LISTED`` neighbouring numbers,
    which bounds what is gathered; then the stretches of a node pass through
    one hash in their order, which SHA-256 needs, a stretch at a time.
    """
    part = F.shiftright("conv", LISTED.bit_length() - 1).alias("part")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    lists = rows.where("ends").groupBy(*_NODE, part).agg(ids.alias("ids"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = lists.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "part").select(*_NODE, "ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in _NODE] + [("ends_sha256", pa.string())])
        node, digest = None, None
        for batch in batches:
            done = []
            for *own, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(schema.types)], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, digest.hexdigest()), schema.types)], schema=schema)

    return lists.mapInArrow(task, "depth long, x long, y long, ends_sha256 string")


def build_trie(sizes: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie's nodes from conversations (conv, n_turns) and turns (conv, place, digest, n_bytes).

    A row for each node: conv_id (smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, members but one times bytes of the node's last text) and
    ends_sha256 (of the ascending, comma-joined ids that end there). Without
    conversations there is no node, the root neither.
    """
    rows = checkpointed(prefixes(sizes, turns))
    nodes = rows.groupBy(*_NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.any_value("px").alias("px"), F.any_value("py").alias("py"),
        F.any_value("n_bytes").alias("n_bytes"),
    )
    nodes = checkpointed(nodes)
    deepest = nodes.agg(F.max("depth").alias("d")).collect()[0].d
    parent = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = checkpointed(nodes.join(children, [*_NODE], "left").fillna(0, ["n_children"]))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("n_bytes")
    weights = nodes.select(*_NODE, leaf.alias("n_leaves"), saved.alias("saved_tokens"))
    totals = rollup(rows.select("conv", *_NODE), weights, ["n_leaves", "saved_tokens"], deepest or 0)
    own = nodes.join(totals, [*_NODE]).join(_end_lists(rows), [*_NODE], "left")
    # a parent may have a third of all nodes as children: both sides come straight from a shuffle, which adaptive execution splits
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    out = checkpointed(own).join(up, ["depth", "px", "py"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame, family: int = 5, heads: int = 9, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Nodes (as ``build_trie``) of the conversations that ``rebuilt_turns`` makes of a table of turns.

    A null role or text is empty; rows without a conversation number belong to
    none. Repeated rows are turns of their own. Texts of any length are read
    once, for their digests. Other columns are not read.
    """
    sizes, rebuilt = rebuilt_turns(checkpointed(ordered_turns(conversations, conv, turn, role, text)), family, heads)
    return build_trie(sizes, rebuilt)
