"""Plateau detection over a metric: exponential average, best value, stagnant windows; as a fold and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BETA, MIN_STEPS, WINDOW, MIN_DELTA, PATIENCE = 0.9, 20, 10, 0.01, 3


def ema(values: Column, beta: float = BETA) -> Column:
    """The average after each value of an ordered array: the first value, then beta * average + (1 - beta) * value."""

    @F.pandas_udf("array<double>")
    def run(arrays: pd.Series) -> pd.Series:
        out = []
        for a in arrays:
            now, row = None, []
            for v in a:
                now = v if now is None else beta * now + (1 - beta) * v
                row.append(now)
            out.append(row)
        return pd.Series(out)

    return run(values)


def update(state: tuple | None, step: int, value: float) -> tuple[float, float, int, int]:
    """(average, best, stagnant windows, step of the stop or -1) after one more value."""
    if state is None:
        return value, value, 0, -1
    average, best, stale, stopped = state
    average = BETA * average + (1 - BETA) * value
    if stopped < 0 and step >= MIN_STEPS and step % WINDOW == 0:
        if average - best > MIN_DELTA * abs(best):
            best, stale = average, 0
        else:
            stale += 1
            stopped = step if stale >= PATIENCE else -1
    return average, best, stale, stopped


SCHEMA = "run bigint, step bigint, average double, best double, stale int, stopped bigint"


def plateau(df: DataFrame) -> DataFrame:
    """(run, step, average, best, stale, stopped) after the last value of each run; input run, step, value.

    A run's values are folded in order of their steps; repeated steps keep the smallest value. The fold needs one row per
    step of one run in a task, eight bytes each.
    """
    one = df.filter("run is not null and step is not null and value is not null").groupBy("run", "step").agg(F.min("value").alias("value"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        state, step = None, 0
        for step, value in g.sort_values("step")[["step", "value"]].itertuples(index=False):
            state = update(state, int(step), float(value))
        return pd.DataFrame([(int(g["run"].iloc[0]), int(step), *state)], columns=["run", "step", "average", "best", "stale", "stopped"])

    return one.groupBy("run").applyInPandas(fold, SCHEMA)


def plateau_stream(stream: DataFrame) -> DataFrame:
    """The same on a stream, one state per run; steps must arrive in order, late ones are left out."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, now = -1, None
        if state.exists:
            last, *now = state.get
        rows = pd.concat(list(frames)).groupby("step", as_index=False)["value"].min().sort_values("step")
        for step, value in rows[["step", "value"]].itertuples(index=False):
            if step > last:
                now, last = update(tuple(now) if now else None, int(step), float(value)), int(step)
        if now is not None:
            state.update((last, *now))
            yield pd.DataFrame([(key[0], last, *now)], columns=["run", "step", "average", "best", "stale", "stopped"])

    return stream.groupBy("run").applyInPandasWithState(advance, SCHEMA, "last bigint, average double, best double, stale int, stopped bigint", "update", GroupStateTimeout.NoTimeout)
