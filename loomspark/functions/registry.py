"""Named extension points: reward functions, advantage estimators, losses, extractors, checkers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class Registry:
    """Functions by name; a name is given once, and an unknown one fails with those that exist."""

    def __init__(self, kind: str):
        self.kind, self.items = kind, {}

    def register(self, name: str) -> Callable:
        def add(f):  # noqa: ANN001, ANN202
            if name in self.items:
                raise ValueError(f"{self.kind} {name!r} exists")
            self.items[name] = f
            return f

        return add

    def get(self, name: str) -> Callable:
        if name not in self.items:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {sorted(self.items)}")
        return self.items[name]


REWARDS = Registry("reward")
ESTIMATORS = Registry("estimator")
EXTRACTORS = Registry("extractor")
LOSSES = Registry("policy loss")
MANAGERS = Registry("reward manager")


@REWARDS.register("zero")
def zero(response: Column, truth: Column) -> Column:
    return F.lit(0.0)


@REWARDS.register("exact")
def exact(response: Column, truth: Column) -> Column:
    return F.coalesce((F.trim(response) == F.trim(truth)).cast("double"), F.lit(0.0))


def custom_reward(f: Callable[[str, str], float], name: str) -> Callable[[Column, Column], Column]:
    """A plain Python scorer as a reward, run in Arrow batches; null on either side gives 0."""

    @REWARDS.register(name)
    def reward(response: Column, truth: Column) -> Column:
        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([float(f(x, y)) if isinstance(x, str) and isinstance(y, str) else 0.0 for x, y in zip(a, b)], dtype=float)

        return run(response, truth)

    return reward


def score_by(df: DataFrame, key: str, response: Column, truth: Column, names: dict[str, str]) -> DataFrame:
    """df with `score`: the reward whose name the key maps to; keys without one fail."""
    score = F.raise_error(F.concat(F.lit("no reward for "), F.coalesce(F.col(key), F.lit("null")))).cast("double")
    for value, name in names.items():
        score = F.when(F.col(key) == value, REWARDS.get(name)(response, truth)).otherwise(score)
    return df.withColumn("score", score)


@udtf(returnType="position int, shingle string")
class Shingles:
    """Table function: the word shingles of a text with their positions."""

    def eval(self, text: str, size: int):  # noqa: ANN201
        words = (text or "").split()
        for i in range(len(words) - size + 1):
            yield i, " ".join(words[i : i + size])


def repeatness(s: str) -> float:
    """The share of a text's substrings that repeat another, by the number of distinct ones (suffix automaton)."""
    if len(s) <= 1:
        return 0.0
    nxt, link, length, last, distinct = [{}], [-1], [0], 0, 0
    for c in s:
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(length)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = copy
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
        distinct += length[cur] - length[link[cur]]
        last = cur
    total = len(s) * (len(s) + 1) / 2
    return (total - distinct) / total


def merge(base: dict, over: dict) -> dict:
    """A configuration over its base: mappings are merged, anything else is replaced."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def resolve(configs: dict[str, dict], name: str) -> dict:
    """A configuration with those that `_base_` names, however deep."""
    own = dict(configs[name])
    base = own.pop("_base_", None)
    return merge(resolve(configs, base), own) if base else own
