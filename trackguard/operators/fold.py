"""Order-dependent state over a long time line, cut into chunks that run side by side.

Rules such as "at most one alert per 20 s since the last alert" need the rows in order. A key's
rows are never collected in one place: every (key, chunk) runs on its own from an empty state and
returns the state it ends in. A chunk whose predecessor ended in a state other than the one it
started from runs again from that state, until every chunk started where the one before it ended.
That fixpoint is the serial result. States forget what can no longer matter, so in quiet time they
are empty and one round is enough; a long incident costs one extra round per chunk it spans, over
those chunks only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trackguard.functions.timeline import chunk_of
from trackguard.session import is_small, stored

Step = Callable[[dict, Iterable[dict]], tuple[dict, list[dict]]]
BATCH_ROWS = 8192


def fold_in_time(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out: str,
                 on: str = "tick", size: float = 4096, lazily: bool = False) -> DataFrame:
    """Runs `step(state, rows) -> (state, outputs)` over each key's rows in order; gives the outputs.

    rows   the events that matter for the rule, already reduced by joins and windows
    step   small pure function; state is a JSON-able dict, `{}` at the start. It sees one chunk.
    out    DDL of the output columns (the keys are added in front)
    lazily a chunk's rows come as an iterator, so that a task holds one Arrow batch of them

    Rows are spread by (key, chunk) and sorted; a task walks through its chunks in Arrow batches and
    holds one chunk's rows at a time, unless the step takes them lazily.
    """
    group, names = [*keys, "_chunk"], [f.name for f in T.StructType.fromDDL(out).fields]
    rounds, ends = _settle(rows, keys, order, step, out, on, size, lazily)
    result = rounds[0].filter("_row >= 0")
    if len(rounds) > 1:
        result = result.withColumn("_round", F.lit(0))
        for number, made in enumerate(rounds[1:], 1):
            result = result.unionByName(made.filter("_row >= 0").withColumn("_round", F.lit(number)))
        last = ends.select(*group, "_round")
        result = result.join(F.broadcast(last) if is_small(last) else last, [*group, "_round"], "left_semi")
    return result.select(*keys, *names)


def fold_states(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out: str,
                on: str = "tick", size: float = 4096) -> DataFrame:
    """(keys, state): the state, as JSON, that each key's rows end in; empty where nothing is to be remembered."""
    _, ends = _settle(rows, keys, order, step, out, on, size)
    return ends.groupBy(*keys).agg(F.max_by("_exit", "_chunk").alias("state"))


def _settle(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out: str, on: str, size: float,
            lazily: bool = False) -> tuple[list[DataFrame], DataFrame]:
    """What every round of `fold_in_time` wrote, and for each chunk the state it ends in and the round that counts."""
    group = [*keys, "_chunk"]
    rows = stored(rows.withColumn("_chunk", chunk_of(on, size)))
    made_fields = T.StructType.fromDDL(out).fields
    schema = T.StructType([rows.schema[k] for k in group] + [
        T.StructField("_row", T.IntegerType()), T.StructField("_entry", T.StringType()),
        T.StructField("_exit", T.StringType()), *made_fields])
    arrow = to_arrow_schema(schema)

    def one_chunk(key: tuple, given: Iterator[dict]) -> list[dict]:
        first = next(given)
        entry, given = first.get("_want") or "", chain([first], given)
        state, made = step(json.loads(entry) if entry else {}, given if lazily else list(given))
        head = dict(zip(group, key))
        end = {**head, "_row": -1, "_entry": entry, "_exit": json.dumps(state, sort_keys=True) if state else ""}
        return [end, *({**head, "_row": i, **r} for i, r in enumerate(made))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = []
        given = (r for batch in batches for r in batch.to_pylist())
        for key, chunk in groupby(given, lambda r: tuple(r[g] for g in group)):
            ready += one_chunk(key, chunk)
            if len(ready) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                ready = []
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)

    def run(df: DataFrame) -> DataFrame:
        return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(walk, schema)

    def ends_of(made: DataFrame, number: int) -> DataFrame:
        return made.filter("_row = -1").select(*group, "_entry", "_exit", F.lit(number).alias("_round"))

    # a round writes only the chunks it repeats; the last round of a chunk is the one that counts
    rounds = [stored(run(rows))]
    ends = stored(ends_of(rounds[0], 0))
    previous = F.coalesce(F.lag("_exit").over(W.partitionBy(*keys).orderBy("_chunk")), F.lit(""))
    while True:
        wrong = stored(ends.withColumn("_want", previous).filter("_want <> _entry").select(*group, "_want"))
        if wrong.isEmpty():
            break
        rounds.append(stored(run(rows.join(F.broadcast(wrong) if is_small(wrong) else wrong, group))))
        ends = stored(ends.join(wrong, group, "left_anti").unionByName(ends_of(rounds[-1], len(rounds) - 1)))
    return rounds, ends


def cooldown(events: DataFrame, keys: Sequence[str], gap: float, on: str = "tick",
             tie: Sequence[str] = (), size: float = 4096) -> DataFrame:
    """Keeps an event when at least `gap` has passed since the last event kept."""
    payload = [f for f in events.schema.fields if f.name not in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payload)
    names = [f.name for f in payload]

    def step(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        last, kept, end = state.get("last"), [], None
        for r in rows:
            end = r[on]
            if last is None or r[on] - last >= gap:
                last = r[on]
                kept.append({n: r[n] for n in names})
        edge = (end // size + 1) * size          # the next chunk starts here
        return ({"last": float(last)} if last is not None and edge - last < gap else {}), kept

    return fold_in_time(events, keys, [on, *tie], step, ddl, on, size)
