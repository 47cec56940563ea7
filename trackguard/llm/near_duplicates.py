"""Near duplicates: documents whose sets of word shingles have a Jaccard similarity of at least `percent` / 100, and all that
are linked through others.

1. Every document gets its set's size, a 128-bit key of the set, and a HyperMinHash sketch. Documents with equal sets are one class;
   only classes go on.
2. Bands of registers put classes into buckets. In each bucket every class is paired with the one of smallest id. Pairs with a class of
   fewer than SMALL shingles, and pairs whose corrected estimate is not below the threshold by more than MARGIN, are confirmed on the
   full sets; confirmed links give first components.
3. Buckets that still hold several components are searched completely: every pair of classes of different components, each pair in the
   first bucket it shares, estimate first (not for small classes), full sets then. Large buckets are dealt in pairs of blocks, so no task holds more than two
   blocks. Links only have to join components, so a unit reports at most one per pair of components it joins.

No step writes a row per pair of a group: copies meet in their class, near copies at the bucket's first class. A pair at the threshold
can still share no band: in a simulation with these registers 0 of 40,000 pairs of 5 and 4 shingles and 1 of 160,000 pairs of 50 and 40
had none, too few for a rate. The margin is eight standard errors of the estimate of a large class.

Defined results: a text without words (or null) has an empty set and is linked with nothing; rows without id are reported unlinked with
component null and kept; rows that repeat an id are documents of their own, and one of smallest id and text hash stays of a group; empty tables give empty results; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackguard.llm import hyperminhash as H, words as W
from trackguard.llm.components import components
from trackguard.llm.sides import side
from trackguard.session import stored

SHINGLE, PERCENT, MARGIN = 5, 80, 0.3
SMALL = 512             # shingles below which registers repeat too often for an estimate; the full sets decide
BLOCK = 2048            # classes of one block of a bucket


def _key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, the text's hash, n_shingles, node (the set's key, null if empty) and registers of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            value, bounds = H.shingles(W.texts_of(batch.column("text")), shingle)
            regs = H.registers(value, bounds)
            n = np.diff(bounds)
            node = [_key(value[a:b]) if b > a else None for a, b in zip(bounds, bounds[1:])]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(n), pa.array(node, pa.binary()), pa.array([r.tobytes() if k else None for r, k in zip(regs, node)], pa.binary())],
                                  names=["doc_id", "text_hash", "n_shingles", "node", "regs"])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node binary, regs binary")


def _banded(classes: DataFrame) -> DataFrame:
    """One row per class and band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = H.bands(_registers(batch.column("regs"))).view(np.int64)
            offsets = pa.array(np.arange(len(keys) + 1) * H.BANDS, pa.int32())
            yield pa.record_batch([batch.column("node"), batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["node", "id", "bands"])
    wide = classes.select("node", "id", "regs").mapInArrow(run, "node binary, id long, bands array<long>")
    return wide.select("node", "id", F.posexplode("bands").alias("number", "band"))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, H.BUCKETS)


def _within(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows whose key is in keys (one row per key): by broadcast if keys is small, else by a shuffle."""
    return rows.join(side(keys), on, "left_semi")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """Members of all buckets with two classes or more."""
    banded = _banded(classes)
    shared = stored(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"))
    return stored(_within(banded, shared, "band"))


def _estimates(a: pa.Array, b: pa.Array, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return H.corrected(_registers(a), _registers(b), n_a, n_b)


def _sizes_fit(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def likely(pairs: DataFrame, classes: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes fit, and whose estimate is at least this or one of which is small."""
    own = classes.select("node", "regs", "n_shingles")
    wide = pairs.join(own.toDF("a", "regs_a", "n_a"), "a").join(own.toDF("b", "regs_b", "n_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                good = (np.minimum(n_a, n_b) < SMALL) | (_estimates(batch.column("regs_a"), batch.column("regs_b"), n_a, n_b) >= least)
                yield batch.select(["a", "b"]).filter(pa.array(good & _sizes_fit(n_a, n_b, percent)))
    return wide.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(run, "a binary, b binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets reach the similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are links by their full sets."""
    wide = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(batch.column("set_a"), batch.column("set_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return wide.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of the classes named, computed again from the text of each class's first document; nodes is (node, id)."""
    ids = stored(nodes.select(F.col("id").alias("doc_id")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            value, bounds = H.shingles(W.texts_of(batch.column("text")), shingle)
            sets = [value[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]
            yield pa.record_batch([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])
    return _within(docs, ids, "doc_id").select("doc_id", "text").mapInArrow(run, "node binary, set binary").dropDuplicates(["node"])


# -- the complete search of buckets with several components ---------------------------------------------------------------


def _units(members: DataFrame, block: int) -> DataFrame:
    """members (band, number, node, component, ...) dealt into units: a bucket of k blocks has a unit per pair of blocks."""
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    rows = members.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("k")).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("k", "other")


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")


def _each_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of one unit, as tables; a unit may span batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "i", "j")], 1)
        cuts = np.concatenate([[0], np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1, [len(unit)]])
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(unit[a])
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of(unit: pa.Table, least: float, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different components that this unit has to look at, most similar first within a row: they lie in the unit's two
    blocks, share no earlier band, their sizes fit, and their estimate reaches `least` or one of them is small."""
    regs = np.frombuffer(b"".join(unit.column("regs").to_pylist()), np.uint16).reshape(-1, H.BUCKETS)
    n = unit.column("n_shingles").to_numpy()
    own, number = unit.column("own").to_numpy(), unit.column("number")[0].as_py()
    component = unit.column("component").combine_chunks().dictionary_encode()
    component = (component.combine_chunks() if isinstance(component, pa.ChunkedArray) else component).indices.to_numpy()
    two = unit.column("i")[0].as_py() != unit.column("j")[0].as_py()
    for x in range(len(n) - 1):
        near = (component[x + 1:] != component[x]) & _sizes_fit(n[x], n[x + 1:], percent)
        if two:
            near &= own[x + 1:] != own[x]
        y = np.flatnonzero(near) + x + 1
        if len(y):
            same = regs[y] == regs[x]
            first = same.reshape(len(y), H.BANDS, H.ROWS).all(2).argmax(1) == number
            y, same = y[first], same[first]
        if len(y):
            chance = H.collision(np.full(len(y), float(n[x])), n[y].astype(float))
            est = (same.mean(1) - chance) / (1 - chance)
            order = np.argsort(-est, kind="stable")
            good = (est >= least) | (np.minimum(n[x], n[y]) < SMALL)
            yield from ((x, int(k)) for k in y[order][good[order]])


def _suspects(units: DataFrame, least: float, percent: int) -> DataFrame:
    """Members that have any pair to confirm in their unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _each_unit(batches):
            rows = sorted({k for pair in _pairs_of(unit, least, percent) for k in pair})
            if rows:
                yield from unit.take(pa.array(rows)).combine_chunks().to_batches()
    return _gathered(units).mapInArrow(run, units.schema)


def _joining(suspects: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links that join components within a unit, by full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _each_unit(batches):
            sets_ = [np.frombuffer(s.as_buffer(), np.uint64) for s in unit.column("set")]
            node, component = unit.column("node").to_pylist(), unit.column("component").to_pylist()
            parent = {c: c for c in component}

            def root(c):
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c
            out = []
            for x, y in _pairs_of(unit, least, percent):
                a, b = root(component[x]), root(component[y])
                if a != b and linked(sets_[x], sets_[y], percent):
                    parent[a] = b
                    out.append((node[x], node[y]))
            if out:
                yield pa.record_batch([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
    return _gathered(suspects.join(sets, "node")).mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between classes, enough to join all that belong together."""
    least = percent / 100 - margin
    members = shared_buckets(classes)
    centre = members.groupBy("band").agg(F.min(F.struct("id", "node")).alias("c"))
    star = members.join(centre, "band").select(F.col("c.node").alias("a"), F.col("node").alias("b")).filter("a != b").distinct()
    sets = stored(full_sets(docs, members.select("node", "id").distinct(), shingle))
    first = stored(confirmed(likely(star, classes, least, percent), sets, percent))
    found = components(first)
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(placed)
    several = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("band")
    rest = _within(placed, stored(several), "band").join(classes.select("node", "regs", "n_shingles"), "node")
    suspects = stored(_suspects(_units(rest, block), least, percent))
    return first.unionAll(stored(_joining(suspects, sets, least, percent)))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, **more) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, component_id (the smallest id reachable) and kept."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = stored(sketched(rows, shingle))
    classes = stored(seen.filter("doc_id is not null and node is not null").groupBy("node")
                     .agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
                     .select("node", F.col("least.doc_id").alias("id"), "least", "n_shingles", "regs"))
    found = stored(components(links(rows, classes, shingle, percent, **more)))
    ids = classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("least").alias("stays"))
    named = stored(ids.join(least, "component").select("node", F.col("stays.doc_id").alias("component_id"), F.col("stays.text_hash").alias("stays_text")))
    out = seen.select("doc_id", "text_hash", "n_shingles", "node").join(side(named), "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    kept = F.col("doc_id").isNull() | F.col("node").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("stays_text")))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs with one row of each group. Rows without id and rows without words stay, all of them."""
    found = stored(duplicates(docs, doc_id, text, **more))

    same = (F.col(doc_id).cast("long") == F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_text"))
    named = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), "kept", "n_shingles")
    gone = stored(named.filter("not kept").select("_id", "_text").distinct())
    out = docs.join(side(gone), same, "left_anti")
    # copies of a kept row with its id: one stays
    again = stored(named.filter("kept and _id is not null and n_shingles > 0").groupBy("_id", "_text").agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_text"))
    if again.isEmpty():
        return out
    return out.join(side(again), same, "left_anti").unionByName(out.join(side(again), same, "left_semi").dropDuplicates([doc_id, text]))
