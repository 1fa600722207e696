"""Aggregates in Python that combine rows before the shuffle.

An aggregate lifts rows to states, merges states of a group and finishes them. Tasks
lift Arrow batches and merge as they go, so that what is shuffled is a state for each
group and task, however many rows a group has; one more merge and the finish follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

HELD_GROUPS = 100_000  # groups of a task that are merged before they go out


@dataclass(frozen=True)
class Aggregate:
    """``lift`` maps a batch's columns to state columns, ``merge`` names how each state column is combined (an Arrow aggregation: sum, min, max, ..), ``finish`` maps merged state columns to the result."""

    state: dict[str, str]  # the state columns' types
    merge: dict[str, str]
    result: str  # the result's type
    lift: Callable[[pa.Table], dict[str, pa.ChunkedArray]]
    finish: Callable[[pa.Table], pa.ChunkedArray]


def _merged(states: pa.Table, by: list[str], agg: Aggregate) -> pa.Table:
    found = states.group_by(by).aggregate([(c, how) for c, how in agg.merge.items()])
    return found.select([*by, *(f"{c}_{how}" for c, how in agg.merge.items())]).rename_columns([*by, *agg.merge])


def partial_states(df: DataFrame, by: list[str], columns: list[str], agg: Aggregate) -> DataFrame:
    """by and state columns: a row for each group and task, or several where a task has more than HELD_GROUPS groups."""
    narrow = df.select(*by, *columns)
    kinds = [StructField(c, _parse_datatype_string(t)) for c, t in agg.state.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            lifted = agg.lift(rows.select(columns))
            states = pa.table([*(rows[c] for c in by), *(lifted[c] for c in agg.state)], names=[*by, *agg.state])
            held = _merged(pa.concat_tables([held, states]) if held is not None else states, by, agg)
            if held.num_rows > HELD_GROUPS:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return narrow.mapInArrow(run, StructType([*(narrow.schema[c] for c in by), *kinds]))


def aggregated(df: DataFrame, by: list[str], columns: list[str], agg: Aggregate, out: str) -> DataFrame:
    """by, ``out``: the aggregate of each group. Nulls of ``by`` are a group; an empty table gives no rows."""
    states = partial_states(df, by, columns, agg)

    def run(states: pa.Table) -> pa.Table:
        found = _merged(states, by, agg)
        return pa.table([*(found[c] for c in by), agg.finish(found.select(list(agg.state)))], names=[*by, out])

    return states.groupBy(*by).applyInArrow(run, StructType([*(states.schema[c] for c in by), StructField(out, _parse_datatype_string(agg.result))]))


def _both(a: pa.ChunkedArray, b: pa.ChunkedArray, x: pa.ChunkedArray) -> pa.ChunkedArray:
    """``x`` where neither of a and b is null, else 0."""
    return pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), x, 0.0)


def weighted_mean(value: str, weight: str) -> Aggregate:
    """The mean of ``value`` by ``weight``, over rows that have both; null without weight."""

    def lift(rows: pa.Table) -> dict:
        v, w = (rows[c].cast(pa.float64()) for c in (value, weight))
        return {"s": _both(v, w, pc.multiply(v, w)), "w": _both(v, w, w)}

    return Aggregate({"s": "double", "w": "double"}, {"s": "sum", "w": "sum"}, "double", lift, lambda t: pc.divide(t["s"], pc.if_else(pc.equal(t["w"], 0.0), None, t["w"])))


def geometric_mean(value: str) -> Aggregate:
    """exp of the mean logarithm of the positive values; null without any."""

    def lift(rows: pa.Table) -> dict:
        v = rows[value].cast(pa.float64())
        some = pc.fill_null(pc.greater(v, 0.0), False)
        return {"s": pc.if_else(some, pc.ln(pc.if_else(some, v, 1.0)), 0.0), "n": some.cast(pa.int64())}

    return Aggregate({"s": "double", "n": "long"}, {"s": "sum", "n": "sum"}, "double", lift, lambda t: pc.exp(pc.divide(t["s"], pc.if_else(pc.equal(t["n"], 0), None, t["n"].cast(pa.float64())))))
