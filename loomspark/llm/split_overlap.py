"""Evaluation records that also stand, exactly or nearly, in training splits.

Two prompts overlap if the edit distance of their words is at most a sixth of the longer one's words. Exact search:

1. Both sides are reduced to their distinct texts; equal texts meet in an equi-join.
2. An evaluation text of n words can have at most k = n // 5 edits against any partner, so of k + 1 disjoint shingles at
   least one survives: the rarest such choice (by dynamic programming over a count-min sketch of training shingles, of
   fixed size) is its prefix in the index.
3. Training texts probe the index with their shingles. A bitmap of the index's shingles, of fixed size, is applied before
   anything is shuffled, so that only shingles leave a task that are in the index (and few others). A candidate passes the
   length filter, the position filter (the shingle moved by no more than the allowed edits), the prefix filter (with e
   edits allowed for this pair, one of the rarest e + 1 chosen shingles is shared, so the others do not count) and the
   word filter (an edit changes at most two bits of the 128 that the words of a text set).
4. Candidates are verified: by the words that only the longer text has (a lower bound), then by the bounded edit distance.

Pairs of texts are expanded to pairs of records at the end. A shingle is spread over parts of the training side in
proportion to its count in the sketch; hot texts (many records with one prompt) over parts in proportion to their size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.rolling import WordCodes, coded_texts, is_set, rolling, rolling_of, slots
from loomspark.session import checkpoint

SKETCH_BITS = 18
#: Bits of the map of shingles in the index.
INDEX_BITS = 24
#: Training shingles of one hash that a part of the join takes.
SHINGLES_PER_PART = 50_000
RECORDS_PER_PART = 20_000
#: Words of an evaluation text whose shingles are chosen together.
WINDOW = 1_000
#: Cells of a table of choices (8 bytes each): so many windows are chosen together.
CELLS = 500_000
#: Texts whose words are coded together.
TEXTS_AT_ONCE = 1_000
#: Rows up to which a checkpointed side of a join is broadcast.
FEW_ROWS = 200_000
EVAL, TRAIN = ("val", "test"), ("sft", "opd")


def words(text: Column) -> Column:
    """Runs of letters and digits, without case, by spaces."""
    return F.trim(F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]+", " "))


def shingle_size(n: int) -> int:
    return 4 if n >= 20 else 3 if n >= 10 else 2


def probed(n: np.ndarray) -> dict[int, np.ndarray]:
    """For each size of shingles, which texts of n words can be near to a text whose shingles have that size."""
    low, high = -(-5 * n // 6), 6 * n // 5
    return {2: (low < 10) & (high >= 5), 3: (low < 20) & (high >= 10), 4: high >= 20}


def choose_rarest(costs: np.ndarray, q: int, need: int) -> np.ndarray:
    """Starts of `need` disjoint shingles of q words with the smallest sum of costs, for each row of costs."""
    rows, n = len(costs), costs.shape[1] + q - 1
    best = np.full((n + 1, rows, need + 1), np.inf)
    best[:, :, 0] = 0
    for i in range(1, n + 1):
        best[i] = best[i - 1]
        if i >= q:
            np.minimum(best[i, :, 1:], best[i - q, :, :-1] + costs[:, i - q, None], out=best[i, :, 1:])
    every, out = np.arange(rows), np.zeros((rows, need), np.int64)
    i, c = np.full(rows, n), np.full(rows, need)
    while (c > 0).any():
        take = best[i, every, c] < best[np.maximum(i - 1, 0), every, c]
        out[every[take], c[take] - 1] = i[take] - q
        i = np.where(c > 0, np.where(take, i - q, i - 1), i)
        c = c - take
    return out


def prefixes(costs: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """For each text the starts of k + 1 disjoint shingles, the rarest first, where k edits are the most it can have.

    Of every window of a text the rarest choice, and of these the rarest; windows of one length are chosen together.
    """
    windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, n in enumerate(sizes):
        edges = np.linspace(0, n, -(-n // WINDOW) + 1).astype(int).tolist()
        for a, b in zip(edges, edges[1:]):
            windows.setdefault((b - a, shingle_size(n)), []).append((t, a))
    chosen: list[list[np.ndarray]] = [[] for _ in sizes]
    for (n, q), places in windows.items():
        at_once = max(1, CELLS // (n * (n // 5 + 1)))
        for some in (places[x : x + at_once] for x in range(0, len(places), at_once)):
            starts = choose_rarest(np.stack([costs[t][a : a + n - q + 1] for t, a in some]), q, n // 5 + 1)
            for (t, a), own in zip(some, starts):
                chosen[t].append(own + a)
    out = []
    for c, n, own in zip(costs, sizes, chosen):
        at = np.concatenate(own)
        out.append(at[np.argsort(c[at], kind="stable")][: n // 5 + 1])
    return out


def within(a: list[str], b: list[str], k: int) -> bool:
    """Is the edit distance of two word lists at most k?"""
    if abs(len(a) - len(b)) > k:
        return False
    far = k + 1
    row = {j: j for j in range(min(len(b), k) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            if j == 0:
                new[0] = i
                continue
            d = row.get(j - 1, far) + (x != b[j - 1])
            d = min(d, row.get(j, far) + 1, new.get(j - 1, far) + 1)
            new[j] = d
        if min(new.values()) > k:
            return False
        row = new
    return row.get(len(b), far) <= k


@F.pandas_udf(T.BooleanType())
def _within(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
    """Are two texts at most k edits apart? They are not if the longer one has more than k words of its own."""
    out = []
    for x, y, z in zip(a, b, k):
        x, y = x.split(" "), y.split(" ")
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        out.append(len(set(x) - set(y)) <= z and (Counter(x) - Counter(y)).total() <= z and within(x, y, int(z)))
    return pd.Series(out, dtype=bool)


def _marks(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each text, in two whole numbers, set by its words."""
    bit, none = np.uint64(1) << (codes & np.uint64(63)), np.uint64(0)
    upper = (codes >> np.uint64(6) & np.uint64(1)).astype(bool)
    starts = np.cumsum(sizes) - sizes
    return tuple(np.bitwise_or.reduceat(np.where(half, bit, none), starts).astype(np.int64) for half in (upper, ~upper))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most TEXTS_AT_ONCE rows, none empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def sketch_of(texts: DataFrame) -> np.ndarray:
    """Counts of the shingles of texts (t) in 2**SKETCH_BITS buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, total = WordCodes(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in _slices(batches):
            codes, sizes = coded_texts(batch.column(0).to_pylist(), coded)
            for q, wanted in probed(sizes).items():
                total += np.bincount(slots(rolling_of(codes, sizes, wanted, q)[0], SKETCH_BITS), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sketch = np.zeros(1 << SKETCH_BITS)
    counts = texts.select("t").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2**18 rows
    sketch[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return sketch


def parts_of(heat: np.ndarray) -> np.ndarray:
    return (heat // SHINGLES_PER_PART).astype(np.int64) + 1


def index_of(texts: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(gram, part, left_key, left_n, left_at, place, left_high, left_low): the prefix of each text, for all parts."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = WordCodes()
        for batch in _slices(batches):
            out: list[list] = [[] for _ in range(8)]
            codes, sizes = coded_texts(batch.column(1).to_pylist(), coded)
            ends, n = np.cumsum(sizes).tolist(), sizes.tolist()
            grams = [rolling(codes[e - m : e], shingle_size(m)) for e, m in zip(ends, n)]
            heat = [shared.value[slots(g, SKETCH_BITS)] for g in grams]
            marks = [m.tolist() for m in _marks(codes, sizes)]
            for t, (key, starts) in enumerate(zip(batch.column(0).to_pylist(), prefixes(heat, n))):
                parts = parts_of(heat[t][starts]).tolist()
                for place, (at, gram, count) in enumerate(zip(starts.tolist(), grams[t][starts].astype(np.int64).tolist(), parts)):
                    for part in range(count):
                        for column, x in zip(out, (gram, part, key, n[t], at, place, marks[0][t], marks[1][t])):
                            column.append(x)
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(out, types)], names)

    schema = "gram bigint, part int, left_key binary, left_n int, left_at int, place int, left_high bigint, left_low bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    return texts.select("key", "t").mapInArrow(run, schema)


def bitmap_of(index: DataFrame) -> np.ndarray:
    """The shingles of the index as a packed bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots(batch.column(0).to_numpy().astype(np.uint64), INDEX_BITS)).astype(np.int32))], ["slot"])

    bits = np.zeros(1 << INDEX_BITS, bool)
    for batch in index.select("gram").mapInArrow(run, "slot int").distinct().toArrow().to_batches():  # at most 2**24 slots
        bits[batch.column(0).to_numpy()] = True
    return np.packbits(bits)


def probes_of(texts: DataFrame, sketch: np.ndarray, bitmap: np.ndarray) -> DataFrame:
    """(gram, part, right_key, n, at, high, low): the shingles of texts that the index may hold."""
    shared = texts.sparkSession.sparkContext.broadcast((sketch, bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, (sketch, bitmap) = WordCodes(), shared.value
        for batch in _slices(batches):
            codes, sizes = coded_texts(batch.column(1).to_pylist(), coded)
            found = []
            for q, wanted in probed(sizes).items():
                gram, row, at = rolling_of(codes, sizes, wanted, q)
                known = is_set(bitmap, slots(gram, INDEX_BITS))
                found.append((gram[known], row[known], at[known]))
            gram, row, at = map(np.concatenate, zip(*found))
            lead = np.array([int.from_bytes(k[:4], "big") for k in batch.column(0).to_pylist()], np.int64)
            part = lead[row] % parts_of(sketch[slots(gram, SKETCH_BITS)])
            high, low = _marks(codes, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.astype(np.int64)), pa.array(part.astype(np.int32)), batch.column(0).take(pa.array(row)), pa.array(sizes[row].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(high[row]), pa.array(low[row])],
                ["gram", "part", "right_key", "n", "at", "high", "low"],
            )

    return texts.select("key", "t").mapInArrow(run, "gram bigint, part int, right_key binary, n int, at int, high bigint, low bigint")


def few(df: DataFrame) -> DataFrame:
    """A checkpointed side of a join: broadcast if it was counted to be small, shuffled otherwise."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def overlapping_texts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_key, right_key) of near but unequal texts; both sides have (key, t, n) of distinct texts, their words by spaces."""
    a, b = left.filter("n >= 5"), right.filter("n >= 5")
    sketch = sketch_of(b)
    index = checkpoint(index_of(a, sketch))
    met = probes_of(b, sketch, bitmap_of(index)).join(index, ["gram", "part"])
    met = met.withColumn("k", F.floor(F.greatest("left_n", "n") / 6).cast("int"))
    met = met.filter("place <= k and abs(left_n - n) <= k and abs(left_at - at) <= k and bit_count(left_high ^ high) + bit_count(left_low ^ low) <= 2 * k and left_key <> right_key")
    candidates = checkpoint(met.select("left_key", "right_key", "k").distinct())

    def texts(side: DataFrame, name: str) -> DataFrame:
        side = side.select(F.col("key").alias(f"{name}_key"), F.col("t").alias(f"{name}_text"))
        return side.join(few(candidates.select(f"{name}_key")), f"{name}_key", "left_semi")

    near = few(candidates).join(texts(a, "left"), "left_key").join(texts(b, "right"), "right_key")
    return near.filter(_within("left_text", "right_text", "k")).select("left_key", "right_key")


def split_overlaps(df: DataFrame, id_col: str = "sample_id", split_col: str = "split", text_col: str = "prompt", eval_splits: tuple[str, ...] = EVAL, train_splits: tuple[str, ...] = TRAIN) -> DataFrame:
    """(eval_id, train_id) of every overlapping pair of records; ids are strings.

    Null ids, and null prompts or prompts without letter or digit, count for nothing. An id that is delivered again counts
    once. Split names are compared without case and padding. Empty sides give no rows.
    """
    split = F.lower(F.trim(F.col(split_col)))
    rows = df.select(F.col(id_col).cast("string").alias("id"), split.isin(*eval_splits).alias("held"), F.col(text_col).alias("t")).filter(split.isin(*eval_splits, *train_splits))
    rows = rows.filter("id is not null and t is not null").select("id", "held", words(F.col("t")).alias("t")).filter("t <> ''")
    rows = checkpoint(rows.withColumn("key", F.unhex(F.md5(F.col("t").cast("binary")))))
    texts = checkpoint(rows.groupBy("held", "key").agg(F.first("t").alias("t"), F.count("*").alias("copies")))
    texts = texts.withColumn("n", F.size(F.split("t", " ")))
    left, right = texts.filter("held"), texts.filter("not held")
    equal = left.select(F.col("key").alias("left_key")).join(right.select(F.col("key").alias("right_key")), F.col("left_key") == F.col("right_key"))
    pairs = equal.unionByName(overlapping_texts(left, right))

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.select(F.col("key").alias(f"{name}_key"), F.ceil(F.col("copies") / RECORDS_PER_PART).cast("int").alias(f"{name}_parts"))

    pairs = pairs.join(parts(left, "left"), "left_key").join(parts(right, "right"), "right_key")
    # Each pair of texts is repeated for the parts of its sides; a record lies in one part of its text.
    pairs = pairs.withColumn("left_part", F.explode(F.sequence(F.lit(0), F.col("left_parts") - 1))).withColumn("right_part", F.explode(F.sequence(F.lit(0), F.col("right_parts") - 1)))
    pairs = few(checkpoint(pairs.select("left_key", "right_key", "left_part", "right_part")))

    def records(held: bool, name: str, out: str) -> DataFrame:
        side = rows.filter(F.col("held") == held).select(F.col("id").alias(out), F.col("key").alias(f"{name}_key")).distinct()
        side = side.join(parts(texts.filter(F.col("held") == held), name), f"{name}_key")
        return side.select(out, f"{name}_key", F.pmod(F.xxhash64(out), F.col(f"{name}_parts")).cast("int").alias(f"{name}_part"))

    found = pairs.join(records(True, "left", "eval_id"), ["left_key", "left_part"]).join(records(False, "right", "train_id"), ["right_key", "right_part"])
    return found.select("eval_id", "train_id").filter("eval_id <> train_id").distinct()


def overlap_report(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(eval_split, train_split, source, n_pairs, n_eval_records): overlaps by splits and source of the evaluation record."""
    first = df.filter("sample_id is not null").groupBy(F.col("sample_id").cast("string").alias("id")).agg(F.min(F.struct(F.lower(F.trim("split")).alias("split"), "source")).alias("r"))
    a = first.select(F.col("id").alias("eval_id"), F.col("r.split").alias("eval_split"), F.col("r.source").alias("source"))
    b = first.select(F.col("id").alias("train_id"), F.col("r.split").alias("train_split"))
    return pairs.join(a, "eval_id").join(b, "train_id").groupBy("eval_split", "train_split", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval_records"))
