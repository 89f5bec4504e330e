"""A sample whose shares follow target categories, by min-cost flow over cross-classified cell counts.

Records are counted by cell (split and labels, folded onto the vocabulary of the targets, so that the number of cells is
bounded by the targets, not by the data). For a plan of n rows the network is source -> plan (n rows; more only where the
floors alone need more) -> target (one arc for its floor, one for the rest of its quota) -> matching cell (how many of its
rows the target takes) -> sink (how many rows the cell has); a slack arc from the plan to the sink takes what cannot be
met. Quotas share n in proportion; where floors lift some targets, the others give up rows in proportion.

Prices are whole numbers. The arcs into cells are priced so that a target takes its cells in proportion; odd rows are
settled by random prices, which draws the integer quotas at random (by a seed). The rest of a quota is dearer than any
path over the cells, so floors are filled first, and slack is dearer than both together: rows that exist are never
reported as missing. The quotas are then drawn from the records by hash rank, found through counts of hash buckets, so
that no cell is ever sorted as a whole.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = ("domain", "difficulty", "topic")
OTHER = "\x00other"
#: Prices of a row in a cell: the odd row of a fair quota (ODD to twice that, at random), rows beyond it (each doubling STEP dearer).
ODD, BEYOND, STEP = 1_000, 4_000, 100


def fold_label(value: Column) -> Column:
    """A label without case, spaces, `_` and `-`."""
    return F.lower(F.regexp_replace(value, r"[\s_\-]+", ""))


def fold_text(value: str | None) -> str | None:
    return None if value is None else "".join(c for c in value if not c.isspace() and c not in "_-").lower()


class Flow:
    """Min-cost flow by successive shortest paths with potentials; costs are whole numbers and not negative."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, p in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(p)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.cap[arc ^ 1]

    def run(self, source: int, sink: int) -> None:
        potential: dict[int, int] = defaultdict(int)
        while True:
            dist, via, done, heap = {source: 0}, {}, set(), [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if x in done:
                    continue
                done.add(x)
                for e in self.out[x]:
                    if self.cap[e] > 0 and self.to[e] not in done:
                        n = d + self.cost[e] + potential[x] - potential[self.to[e]]
                        if self.to[e] not in dist or n < dist[self.to[e]]:
                            dist[self.to[e]], via[self.to[e]] = n, e
                            heapq.heappush(heap, (n, self.to[e]))
            if sink not in dist:
                return
            far = dist[sink]
            for x in list(self.out):
                potential[x] += min(dist.get(x, far), far)
            push, x = None, sink
            while x != source:
                e = via[x]
                push = self.cap[e] if push is None else min(push, self.cap[e])
                x = self.to[e ^ 1]
            x = sink
            while x != source:
                self.cap[via[x]] -= push
                self.cap[via[x] ^ 1] += push
                x = self.to[via[x] ^ 1]


@dataclass
class Target:
    target_id: int
    plan: str
    split: str
    labels: tuple[str | None, ...]
    share: float
    floor: int
    need: int
    rows: int

    def matches(self, cell: tuple) -> bool:
        return all(want is None or want == have for want, have in zip(self.labels, cell))


def _unit(*parts: object) -> float:
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 16**12


def floor_product(a: float, b: float) -> int:
    """floor(a * b), not misled by the binary form of a decimal share."""
    return math.floor(round(a * b, 9))


def quotas(targets: list[Target], n: int, seed: str) -> dict[int, int]:
    """Whole rows of each target: n shared in proportion above the floors, odd rows drawn by larger chance.

    Where all floors together exceed n, each target gets its floor.
    """
    shares = {t.target_id: Fraction(max(0.0, t.share)).limit_denominator(10**9) for t in targets}
    floors = {t.target_id: t.floor for t in targets}
    total = min(Fraction(1), sum(shares.values(), Fraction(0)))
    left, free = Fraction(math.floor(total * n)), set(shares)
    if sum(floors.values()) >= left:
        return floors
    fair: dict[int, Fraction] = {}
    while free:
        weight = sum((shares[t] for t in free), Fraction(0))
        lifted = {t for t in free if weight == 0 or shares[t] * left / weight < floors[t]}
        if not lifted:
            fair.update({t: shares[t] * left / weight for t in free})
            break
        free -= lifted
        for t in lifted:
            fair[t] = Fraction(floors[t])
            left -= floors[t]
    out = {t: math.floor(x) for t, x in fair.items()}
    odd = round(sum(fair.values(), Fraction(0))) - sum(out.values())
    chance = {t: float(fair[t] - out[t]) for t in out if fair[t] > out[t]}
    for t in sorted(chance, key=lambda t: -math.log(max(1e-12, _unit(seed, t))) / chance[t])[:odd]:
        out[t] += 1
    return out


def solve(targets: list[Target], cells: dict[tuple, int], asked: dict[int, int], seed: str) -> tuple[dict[int, int], dict[tuple[int, tuple], int]]:
    """(rows missing of each target's quota, rows that a target takes of a cell) of one plan."""
    flow, source, sink, plan = Flow(), 0, 1, 2
    node = {t.target_id: 3 + i for i, t in enumerate(targets)}
    order = sorted(cells)
    at = {c: 3 + len(targets) + i for i, c in enumerate(order)}
    arcs, into = [], {}
    # No path enters more cells than there are targets; whatever it pays there is less than `rest`, and both than `slack`.
    rest = (BEYOND + 64 * STEP) * (len(targets) + 1)
    slack = 4 * rest
    wanted = sum(asked.values())
    flow.arc(source, plan, wanted, 0)
    flow.arc(plan, sink, wanted, slack)
    for c in order:
        flow.arc(at[c], sink, cells[c], 0)
    for t in targets:
        low = min(t.floor, asked[t.target_id])
        into[t.target_id] = [flow.arc(plan, node[t.target_id], low, 0), flow.arc(plan, node[t.target_id], asked[t.target_id] - low, rest)]
        own = [c for c in order if t.matches(c)]
        total = sum(cells[c] for c in own)
        fair = {c: Fraction(min(asked[t.target_id], total) * cells[c], total) for c in own if cells[c]}
        chance = {c: float(x - math.floor(x)) for c, x in fair.items() if x > math.floor(x)}
        drawn = sorted(chance, key=lambda c: -math.log(max(1e-12, _unit(seed, t.target_id, c))) / chance[c])
        price = {c: ODD + ODD * k // len(drawn) for k, c in enumerate(drawn)}
        for c, x in fair.items():
            steps = [(math.floor(x), 0)]
            if c in price:
                steps.append((1, price[c]))
            have, cost = sum(n for n, _ in steps), BEYOND
            while have < cells[c]:
                more = min(cells[c] - have, max(1, have))
                steps.append((more, cost))
                have, cost = have + more, min(cost + STEP, BEYOND + 63 * STEP)
            arcs += [(t.target_id, c, flow.arc(node[t.target_id], at[c], n, p)) for n, p in steps if n]
    flow.run(source, sink)
    taken: dict[tuple[int, tuple], int] = defaultdict(int)
    for t, c, e in arcs:
        if flow.used(e):
            taken[t, c] += flow.used(e)
    return {t: asked[t] - sum(map(flow.used, e)) for t, e in into.items()}, dict(taken)


class Mixture:
    def __init__(self, pool: DataFrame, targets: DataFrame, seed: str = "mix", id_col: str = "sample_id", split_col: str = "split", labels: tuple[str, ...] = LABELS):
        """Counts the cells of the pool and reads the targets.

        Null ids are left out; an id delivered again counts once (with the smallest of its label rows). A null label
        matches no target that names one. Empty pools leave every target that asks for rows unmet.
        """
        self.pool, self.seed, self.labels = pool, seed, labels
        # The targets are the specification of the job: they are read whole, as its parameters are.
        rows = targets.select("target_id", "plan_name", F.lower(F.trim("split")).alias("split"), "sample_fraction", *labels, "target_share", "min_rows").filter("target_id is not null").collect()
        words = {x: sorted({fold_text(r[x]) for r in rows} - {None}) for x in labels}
        folded = []
        for x in labels:
            y = fold_label(F.col(x).cast("string"))
            folded.append((F.when(y.isNull(), F.lit(OTHER)).when(y.isin(words[x]), y).otherwise(F.lit(OTHER)) if words[x] else F.lit(OTHER)).alias(f"c_{x}"))
        split = F.lower(F.trim(F.col(split_col)))
        one = pool.select(F.col(id_col).cast("string").alias("sample_id"), split.alias("c_split"), *folded)
        one = one.filter(F.col("sample_id").isNotNull() & F.col("c_split").isin(sorted({r.split for r in rows if r.split})))
        self.cell_columns = ["c_split", *[f"c_{x}" for x in labels]]
        self.records = one.groupBy("c_split", "sample_id").agg(F.min(F.struct(*[f"c_{x}" for x in labels])).alias("l")).select("sample_id", "c_split", "l.*")
        self.cells: dict[str, dict[tuple, int]] = defaultdict(dict)
        for r in self.records.groupBy(*self.cell_columns).count().collect():  # bounded by the targets' vocabulary
            self.cells[r["c_split"]][tuple(r[c] for c in self.cell_columns[1:])] = r["count"]
        self.targets = []
        for r in rows:
            total = sum(self.cells[r.split].values())
            n = floor_product(r.sample_fraction or 0.0, total)
            need = max(floor_product(r.target_share or 0.0, n), r.min_rows or 0)
            self.targets.append(Target(r.target_id, r.plan_name, r.split, tuple(fold_text(r[x]) for x in labels), r.target_share or 0.0, max(0, r.min_rows or 0), need, n))

    def unmet(self) -> list[int]:
        """Targets that miss rows when each has all its cells to itself: its floor and quota against a flow of its own."""
        return [t.target_id for t in self.targets if solve([t], self._own(t), {t.target_id: t.need}, self.seed)[0][t.target_id] > 0]

    def _own(self, t: Target) -> dict[tuple, int]:
        return {c: n for c, n in self.cells[t.split].items() if t.matches(c)}

    def plans(self) -> dict[tuple[str, str], tuple[dict[int, int], dict[int, int], dict[tuple[int, tuple], int]]]:
        """(plan, split) -> (asked, missing, taken), with all targets of a plan in a split sharing the cells."""
        by_plan: dict[tuple[str, str], list[Target]] = defaultdict(list)
        for t in self.targets:
            by_plan[t.plan, t.split].append(t)
        out = {}
        for (plan, split), targets in by_plan.items():
            seed = f"{self.seed}:{plan}"
            asked = quotas(targets, targets[0].rows, seed)
            cells = {c: n for c, n in self.cells[split].items() if any(t.matches(c) for t in targets)}
            out[plan, split] = (asked, *solve(targets, cells, asked, seed))
        return out


def unmet_targets(pool: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """(target_id) of the targets that the pool cannot meet."""
    ids = Mixture(pool, targets, seed).unmet()
    return pool.sparkSession.createDataFrame([(i,) for i in ids], "target_id bigint")


def mixture_report(pool: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """(target_id, plan_name, need, asked, available, drawn, shortfall) of every target when its plan is drawn.

    need: the greater of its share and its floor; asked: its quota within the rows of the plan, below `need` where floors
    of other targets take rows; shortfall: rows of the quota that are not there or went to other targets.
    """
    mix = Mixture(pool, targets, seed)
    plans = mix.plans()
    rows = []
    for t in mix.targets:
        asked, missing, _ = plans[t.plan, t.split]
        rows.append((t.target_id, t.plan, t.need, asked[t.target_id], sum(mix._own(t).values()), asked[t.target_id] - missing[t.target_id], missing[t.target_id]))
    return pool.sparkSession.createDataFrame(rows, "target_id bigint, plan_name string, need bigint, asked bigint, available bigint, drawn bigint, shortfall bigint")


def draw_mixture(pool: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """(plan_name, target_id, sample_id): the drawn records; within a plan a record of a split is drawn once."""
    mix = Mixture(pool, targets, seed)
    quotas = []
    for (plan, split), (_, _, taken) in mix.plans().items():
        upto: dict[tuple, int] = defaultdict(int)
        for (target, cell), n in sorted(taken.items()):
            quotas.append((plan, target, split, *cell, upto[cell], upto[cell] + n))
            upto[cell] += n
    columns = ", ".join(f"{c} string" for c in mix.cell_columns)
    spark = pool.sparkSession
    quota = spark.createDataFrame(quotas, f"plan_name string, target_id bigint, {columns}, low bigint, high bigint")
    tops = quota.groupBy("plan_name", *mix.cell_columns).agg(F.max("high").alias("top"))
    rows = mix.records.join(tops, mix.cell_columns)  # Spark broadcasts the quotas if they are small
    digest = F.sha2(F.concat_ws(":", F.lit(seed), "plan_name", "sample_id"), 256)
    rows = rows.withColumn("rank_key", digest).withColumn("bucket", F.conv(F.substring("rank_key", 1, 3), 16, 10).cast("int"))
    group = ["plan_name", *mix.cell_columns]
    sizes = rows.groupBy(*group, "bucket").count()
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    sizes = sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rows = rows.join(sizes, [*group, "bucket"]).filter("before < top")
    inside = Window.partitionBy(*group, "bucket").orderBy("rank_key", "sample_id")
    rows = rows.withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    return rows.join(quota, group).filter("rank >= low and rank < high").select("plan_name", "target_id", "sample_id")
