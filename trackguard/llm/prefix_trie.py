"""Prefix trie of conversations, by hashes of blocks of several turns.

A turn is 128 bits (role and text). A prefix is the exclusive or of its turns' hashes, each mixed with its place, so prefixes of any
length come from running aggregates and a conversation of any length can be cut into chunks.

1. Conversations are grouped by the prefix at the end of each block of BLOCK turns. Equal ones are one block node from here on, with the
   number of its members and the smallest of them, its owner.
2. Blocks whose beginning has one continuation only need no look inside: their turns are nodes with the same members. Blocks whose
   siblings diverge are opened, and their turns grouped.
3. A conversation shares its text up to the first node that it owns. All sums over a subtree follow from that one length per
   conversation and from who owns a childless node: every member adds to a node what it shares beyond it. So no node walks its subtree.
4. The ids that end at a node are packed in order by ranges, in parallel; one stream per node hashes the packs.

A join on a prefix goes through `sides.matched`: keys with very many rows are joined by broadcast, the others by shuffle.

Defined results: rows without conv_id belong to no conversation; null role or text counts as empty; turns come in ascending order, null
first, and equal ones by their hash; repeated rows are turns of their own; an empty table gives no node; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackguard.llm.sides import matched
from trackguard.session import stored

BLOCK = 4               # turns of a block
CHUNK = 512             # blocks of a conversation that one window holds
PACK = 4096             # ids of a pack
KEY = ["depth", "y1", "y2"]
_ALL = Window.unboundedPreceding


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, h1, h2, length): the turns of each conversation from 0 on, as hashes, with their text's code points. Ranges of rows are
    numbered side by side, so a conversation may be longer than what a task holds."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    thin = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(F.lit(1), role, text).alias("h1"),
                                F.xxhash64(F.lit(2), role, text).alias("h2"), F.length(text).cast("long").alias("length")).filter("conv is not null")
    order = ["turn", "h1", "h2", "copy"]
    thin = thin.withColumn("copy", F.monotonically_increasing_id())
    ranged = stored(thin.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()))
    rows = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = rows.select("conv", "part", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(_ALL, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    return ranged.withColumn("at", place).join(before, ["conv", "part"]).select("conv", (F.col("at") + F.col("before")).alias("pos"), "h1", "h2", "length")


def with_shared_beginnings(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """From stored numbered turns: every conversation c takes its first h = crc32(c) % most turns from conversation c - c % every instead of
    its own; (turns, all conversations). Both are stored tables."""
    borrows = F.crc32(F.col("conv").cast("string")) % most
    own = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("source", F.col("conv") - F.col("conv") % every).withColumn("h", borrows)
    first = turns.filter((F.col("conv") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv", "source")
    have = first.groupBy("source").agg(F.count("*").alias("have"))
    plan = stored(own.join(have, "source", "left").select("conv", "source", "h", "n", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")))
    columns = ["conv", "pos", "h1", "h2", "length"]
    borrowed = plan.select("conv", "source", "h").join(first, "source").filter("pos < h").select(*columns)
    late = matched(turns, plan.select("conv", "h", "taken", "n"), ["conv"], "n").filter("pos >= h")
    return stored(borrowed.unionByName(late.withColumn("pos", F.col("taken") + F.col("pos") - F.col("h")).select(*columns))), plan.select("conv")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """Per conversation and block: its turns, the prefix at its start (s1, s2) and end (y1, y2), and the text before it and up to its end."""
    x1, x2 = (F.xxhash64(F.lit(seed), "pos", "h1", "h2") for seed in (3, 4))
    rows = turns.select("conv", F.floor(F.col("pos") / block).alias("b"), F.struct(F.col("pos"), x1.alias("x1"), x2.alias("x2"), F.col("length")).alias("t"))
    rows = rows.groupBy("conv", "b").agg(F.array_sort(F.collect_list("t")).alias("turns"), F.bit_xor("t.x1").alias("z1"), F.bit_xor("t.x2").alias("z2"), F.sum("t.length").alias("l"))
    rows = rows.withColumn("chunk", F.floor(F.col("b") / CHUNK))
    inside = Window.partitionBy("conv", "chunk").orderBy("b").rowsBetween(_ALL, 0)
    upto = [F.bit_xor("z1").over(inside).alias("e1"), F.bit_xor("z2").over(inside).alias("e2"), F.sum("l").over(inside).alias("el")]
    whole = rows.groupBy("conv", "chunk").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.sum("l").alias("l"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(_ALL, -1)
    came = whole.select("conv", "chunk", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(n) for f, c, n in ((F.bit_xor, "z1", "c1"), (F.bit_xor, "z2", "c2"), (F.sum, "l", "cl"))])
    out = rows.select("*", *upto).join(came, ["conv", "chunk"])
    y1, y2, upto = F.col("e1").bitwiseXOR(F.col("c1")), F.col("e2").bitwiseXOR(F.col("c2")), F.col("el") + F.col("cl")
    return out.select("conv", "b", (F.col("b") * block + F.size("turns")).alias("depth"), y1.alias("y1"), y2.alias("y2"), y1.bitwiseXOR(F.col("z1")).alias("s1"),
                      y2.bitwiseXOR(F.col("z2")).alias("s2"), "turns", upto.alias("upto"), (upto - F.col("l")).alias("before"))


def _steps(gain: Column | None = None) -> Column:
    """The nodes inside a block: depth, prefix, the parent's prefix and the text of the last turn."""
    def after(i: Column, start: str, x: str) -> Column:
        return F.aggregate(F.slice("turns", F.lit(1), i + 1), F.col(start), lambda a, t: a.bitwiseXOR(t[x]))

    def step(t: Column, i: Column) -> Column:
        y1, y2 = after(i, "s1", "x1"), after(i, "s2", "x2")
        more = [] if gain is None else [(t["length"] * gain).alias("gain")]
        return F.struct((t["pos"] + 1).alias("depth"), y1.alias("y1"), y2.alias("y2"), y1.bitwiseXOR(t["x1"]).alias("p1"), y2.bitwiseXOR(t["x2"]).alias("p2"), t["length"].alias("length"), *more)
    return F.transform("turns", step)


def _opened(forked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with siblings, turn by turn: their nodes, and per block its steps with what its members save there (gain), and the text that
    its owner shares inside it (inner)."""
    rows = stored(forked.select(*[F.col(k).alias(f"block_{k}") for k in KEY], "owner", "n", "b", "before", F.explode(_steps()).alias("s")).select("*", "s.*").drop("s"))
    nodes = stored(rows.groupBy(*KEY).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("length").alias("length"), F.min("owner").alias("conv"), F.sum("n").alias("n_convs"), F.count("*").alias("ways")))
    owned = matched(rows, nodes.select(*KEY, "conv", "ways"), KEY, "ways")
    shares = F.col("owner") != F.col("conv")
    gain = F.col("length") * (F.col("n") - 1 + shares.cast("long"))
    step = F.struct(*KEY, "p1", "p2", "length", gain.alias("gain"))
    blocks = owned.groupBy(*[f"block_{k}" for k in KEY]).agg(F.first("owner").alias("owner"), F.first("b").alias("b"), F.first("before").alias("before"),
                                                             F.coalesce(F.sum(F.when(shares, F.col("length"))), F.lit(0)).alias("inner"), F.array_sort(F.collect_list(step)).alias("steps"))
    return nodes.drop("ways"), blocks.withColumnsRenamed({f"block_{k}": k for k in KEY})


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of numbered turns (conv, pos, h1, h2, length); conversations (conv) may have none. Per node: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (text shared in its subtree), ends_sha256."""
    blocks = stored(_blocks(turns, block))
    found = stored(blocks.groupBy(*KEY).agg(F.min("conv").alias("owner"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("b", "s1", "s2", "before", "turns")]))
    by_start = found.groupBy("b", "s1", "s2").agg(F.count("*").alias("k"), F.first(F.struct(*[c for c in found.columns if c not in ("b", "s1", "s2")])).alias("only"))
    alone = stored(by_start.filter("k = 1").select("b", "s1", "s2", "only.*"))
    opened, parted = _opened(found.join(alone.select(*KEY), KEY, "left_anti"))
    steps = alone.select(*KEY, "owner", "n", "b", "before", F.lit(0).cast("long").alias("inner"), _steps(F.col("n") - 1).alias("steps"))
    settled = stored(steps.drop("n").unionByName(parted))
    inside = steps.select("owner", "n", F.explode("steps").alias("s")).select("s.*", F.col("owner").alias("conv"), F.col("n").alias("n_convs")).drop("gain")
    root = conversations.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *[F.lit(v).cast("long").alias(c) for c, v in (("y1", 0), ("y2", 0), ("p1", None), ("p2", None), ("length", 0))], "conv", "n_convs")
    nodes = inside.unionByName(opened).unionByName(root)
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("y1"), F.col("p2").alias("y2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # per conversation: the text before its first own node, whether it owns a childless node, and where it ends
    owners = settled.groupBy(F.col("owner").alias("conv")).agg(F.min_by(F.col("before") + F.col("inner"), "b").alias("shared"))
    leaves = nodes.filter("n_children = 0 and depth > 0").select("conv", F.lit(1).alias("leaf"))
    last = F.max_by(F.struct(*KEY), "b")
    each = blocks.groupBy("conv").agg(F.max("upto").alias("all"), F.count("*").alias("n"), last.alias("end"))
    each = stored(each.join(owners, "conv", "left").join(leaves, "conv", "left").select("conv", "n", "end.*", F.coalesce("shared", "all").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")))

    beyond = F.sum(F.greatest(F.lit(0), F.col("shared") - F.col("upto")))
    sums = matched(blocks.select("conv", *KEY, "upto"), each.select("conv", "n", "shared", "leaf"), ["conv"], "n").groupBy(*KEY).agg(beyond.alias("beyond"), F.sum("leaf").alias("leaves"))
    saved = F.transform("steps", lambda s, i: F.struct(*[s[k].alias(k) for k in KEY], (F.col("beyond") + F.aggregate(F.slice("steps", i + 1, F.size("steps")), F.lit(0).cast("long"), lambda a, t: a + t["gain"])).alias("saved")))
    values = settled.join(sums, KEY).select("leaves", F.explode(saved).alias("s")).groupBy("s.depth", "s.y1", "s.y2").agg(F.sum("leaves").alias("n_leaves"), F.sum("s.saved").alias("saved_tokens"))
    whole = nodes.select(F.expr("int(n_children = 0)").alias("leaf"), F.lit(0).cast("long").alias("shared")).unionByName(each.select(F.lit(0).alias("leaf"), "shared"))
    above = whole.agg(F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens")).select(*[F.lit(0).cast("long").alias(k) for k in KEY], "n_leaves", "saved_tokens")
    ends = conversations.join(each.select("conv", *KEY), "conv", "left").select("conv", *[F.coalesce(k, F.lit(0)).alias(k) for k in KEY])
    out = nodes.join(values.unionByName(above), KEY).join(_ends(ends), KEY, "left")
    out = stored(out.select("conv", *KEY, "p1", "p2", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    shown = [F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("y1").alias("p1"), F.col("y2").alias("p2"), F.col("conv").alias("parent_conv_id"), "n_children")
    below = matched(out.filter("depth > 0").withColumnRenamed("n_children", "own_children"), parents, ["depth", "p1", "p2"], "n_children").withColumnRenamed("own_children", "n_children")
    return below.select(*shown).unionByName(out.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*shown))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of consecutive rows of one node."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(k).to_numpy() for k in KEY]
            cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _ends(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids of the conversations that end there, ascending, joined by commas."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows in _runs(batches):
            ids = rows.column("conv").to_pylist()
            out += [(*key, ids[at], ",".join(map(str, ids[at:at + PACK]))) for at in range(0, len(ids), PACK)]
            if len(out) >= PACK:
                yield packed(out)
                out = []
        yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[*KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, slices in groupby(_runs(batches), key=lambda r: r[0]):
            sha, comma = hashlib.sha256(), b""
            for _, rows in slices:
                for ids in rows.column("ids").to_pylist():
                    sha.update(comma + ids.encode())
                    comma = b","
            out.append((*key, sha.hexdigest()))
            if len(out) >= PACK:
                yield hashed(out)
                out = []
        yield hashed(out)

    def hashed(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()])], names=[*KEY, "ends_sha256"])
    key = "depth long, y1 long, y2 long"
    packs = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(pack, f"{key}, first long, ids string")
    return packs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{key}, ends_sha256 string")
