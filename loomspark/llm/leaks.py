"""Evaluation passages inside training text.

The normalized words of the held-out items form one generalised suffix automaton. Each document is streamed through it word
by word; the automaton's longest match length at every word gives the exact runs that the document shares with items, each
run as long as it is for its item. Runs that can be part of a passage are verified by edit distance along the item.

A passage is a stretch of the item of which at least `min_words` words (all words of a shorter item) are there in order,
with at most one edit - a word replaced, missing or added - for every `tolerance` words of the stretch. A longer stretch
always holds one of fewer than 28 words (13 words there, one edit in 8: of its two halves one has no more than its share of
edits), so the search for at most 3 edits on both sides of a run is exact.

What the rule asks about other items - which openings are stock lines, which words are distinctive - is counted over all
items by aggregations before the automaton is built. The items are read in blocks of about `BLOCK_WORDS` words (a bound on
what is broadcast and built, whatever the number of items); the size of the blocks does not change the result. With several
blocks a first pass keeps the documents that share any seed with any item, through a bitmap of fixed size, and only these
meet the blocks one after the other. All passes are narrow.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.rolling import WordCodes, is_set, rolling, slots
from loomspark.session import checkpoint

BLOCK_WORDS = 200_000
MIN_WORDS, TOLERANCE = 13, 8
#: An opening of at least so many words that at least so many different items share is a stock line.
STOCK_WORDS, STOCK_ITEMS = 4, 3
#: Words that at most so many different items hold are distinctive.
DISTINCTIVE = 2
#: Bits of the map of seeds.
SEED_BITS = 24
#: Markup (a name, and attributes with values) and note numbers are skipped; a hyphen at a line's end joins the parts of a word.
_TOKEN = re.compile(r"</?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))*\s*/?>|\[\^?\d{1,4}\]|([^\W_⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:(?:[-‐]\s*[\n\r\x85]\s*|\xad\s*)[^\W_⁰¹²³⁴⁵⁶⁷⁸⁹]+)*)")
_JOIN = re.compile(r"[^\w]+")


def words_of(text: str | None) -> list[str]:
    """Normalized words of a text: case, white space, punctuation, markup, note numbers, line-break hyphens ignored."""
    if not text:
        return []
    found = [w for w in _TOKEN.findall(text) if w]
    low = "\0".join(found).lower()
    out = low.split("\0") if found else []
    if "\n" in low or "\r" in low or "\xad" in low or "\x85" in low:
        out = [w if w.isalnum() else _JOIN.sub("", w) for w in out]
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the words of `words_of`."""
    return [m.span(1) for m in _TOKEN.finditer(text) if m.group(1)]


class Automaton:
    """Generalised suffix automaton over the words of items: (key, words, which of the words are distinctive)."""

    def __init__(self, items: list[tuple[object, list[str], set[str]]], min_words: int = MIN_WORDS, tolerance: int = TOLERANCE):
        self.min_words, self.tolerance = min_words, tolerance
        self.keys = [key for key, _, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.items = [[self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w] for _, w, _ in items]
        self.marks = [[x in rare for x in w] for _, w, rare in items]
        self.reversed = [w[::-1] for w in self.items]
        self.edits = edits_of(min_words, tolerance)
        self.seeds = [seed_of(len(w), min_words, tolerance) for w in self.items]
        self.shortest = min(self.seeds, default=1)
        #: With the standard bounds (13 words, one edit in 8), see `_promising`.
        self.lone_run = 8 if (min_words, tolerance) == (MIN_WORDS, TOLERANCE) else None
        if self.lone_run:
            self.shortest = min(self.shortest, 4)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, ends = [-1], [0], [[]]
        for k, w in enumerate(self.items):
            last = 0
            for j, c in enumerate(w):
                last = self._extend(last, c, ends)
                ends[last].append((k, j))
        # Occurrences (item, last word) of every state long enough to seed.
        self.ends = ends
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in reversed(order):
            p = self.link[s]
            if p > 0 and self.length[p] >= self.shortest:
                ends[p].extend(ends[s])
        # Does every occurrence of a state and of its suffixes (of seed length) go on with the same word?
        self.alike = [False] * len(self.length)
        for s in order:
            if self.length[s] >= self.shortest:
                p = self.link[s]
                self.alike[s] = self.alike[p] if p > 0 and self.length[p] >= self.shortest else self._goes_on(s)

    def _goes_on(self, state: int) -> bool:
        after = {self.items[k][j + 1] if j + 1 < len(self.items[k]) else None for k, j in self.ends[state]}
        return len(after) == 1 and None not in after

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q, ends)
        cur = self._state(self.length[last] + 1, ends)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q, ends)
        return cur

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int, ends: list) -> int:
        clone = self._state(self.length[p] + 1, ends)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def runs(self, words: list[int]) -> Iterator[tuple[int, int, int, int | None]]:
        """(last word, length, state, next word) wherever an exact run of at least the shortest seed ends for some item."""
        nxt, link, length, least, alike = self.next, self.link, self.length, self.shortest, self.alike
        state = size = 0
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            if to is not None:
                if size >= least and not alike[state]:
                    yield i - 1, size, state, w
                state, size = to, size + 1
                continue
            if size >= least:
                yield i - 1, size, state, w
            while state:
                state = link[state]
                to = nxt[state].get(w)
                if to is not None:
                    break
            if to is None:
                state = size = 0
            else:
                size, state = length[state] + 1, to
        if size >= least:
            yield len(words) - 1, size, state, None

    def spans(self, words: list[str], whole: bool = True) -> dict[int, list[tuple[int, int]]]:
        """item number -> document word ranges [from, to) of its passages (only one of them, if not `whole`)."""
        get = self.vocabulary.get
        doc = [get(w, -1) for w in words]
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        link, length, ends, shortest, items = self.link, self.length, self.ends, self.shortest, self.items
        for last, size, state, then in self.runs(doc):
            # Suffixes of the run occur in further items, along the suffix links; those that go on are met again.
            seen: set[tuple[int, int]] = set()
            while state > 0 and size >= shortest:
                for at in ends[state]:
                    k, j = at
                    if (j + 1 == len(items[k]) or items[k][j + 1] != then) and at not in seen:
                        by_item.setdefault(k, []).append((last - size + 1, j - size + 1, size))
                        seen.add(at)
                state = link[state]
                size = length[state]
        found: dict[int, list[tuple[int, int]]] = {}
        back = doc[::-1] if by_item else []
        for k, runs in by_item.items():
            done: list[tuple[int, int, int, int]] = []
            for first, at, size in sorted(self._promising(k, runs), key=lambda r: -r[2]):
                if any(a <= first and first + size <= b and lo <= at and at + size <= hi for a, b, lo, hi in done):
                    continue
                if span := self._passage(doc, back, k, first, at, size):
                    done.append(span)
                    found.setdefault(k, []).append(span[:2])
                    if not whole:
                        break
        return found

    def _promising(self, k: int, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs that can seed a passage of item k.

        A passage has at least 13 words there, and 7 for every edit. So if none of its runs has 8 words, two near runs of
        4 or more have 10 together (else it would need more edits than it may have).
        """
        if len(self.items[k]) < self.min_words or self.lone_run is None:
            return [r for r in runs if r[2] >= self.seeds[k]]
        out = {r for r in runs if r[2] >= self.lone_run}
        if len(runs) > 1:
            apart = self.edits + 6  # a third run of fewer than 4 words may lie between
            runs.sort()
            for x, (first, at, size) in enumerate(runs):
                for after, then, more in runs[x + 1 :]:
                    if after - first - size > apart:
                        break
                    if size + more >= 10 and after > first and 0 < then - at <= size + apart:
                        out.add((first, at, size) if size >= more else (after, then, more))
        return [r for r in out if r[2] >= self.seeds[k]]

    def _passage(self, doc: list[int], back: list[int], k: int, first: int, at: int, size: int) -> tuple[int, int, int, int] | None:
        """(from, to, item from, item to) of the longest passage of item k around an exact run, if there is one."""
        item, marks, n, m = self.items[k], self.marks[k], len(doc), len(self.items[k])
        short = m < self.min_words
        edits = m // self.tolerance if short else self.edits
        right = furthest(doc, item, first + size, at + size, edits)
        left = furthest(back, self.reversed[k], n - first, m - at, edits)
        best = None
        for x, (i, a, lost) in enumerate(left):
            for y, (j, b, gone) in enumerate(right[: edits - x + 1]):
                lo, hi, used = m - a, b, x + y
                there = hi - lo - len(lost) - len(gone)
                if used * self.tolerance > hi - lo or (hi - lo < m if short else there < self.min_words):
                    continue
                # A stretch of which all distinctive words are among the edits is stock text.
                marked = sum(marks[lo:hi])
                if marked and marked == sum(marks[m - 1 - e] for e in lost) + sum(marks[e] for e in gone):
                    continue
                if best is None or hi - lo > best[3] - best[2]:
                    best = n - i, j, lo, hi
        return best


def edits_of(min_words: int, tolerance: int) -> int:
    """The most edits that a passage needs to have which holds no shorter one."""
    half = min_words
    while half - half // tolerance < min_words:
        half += 1
    return (2 * half - 1) // tolerance


def seed_of(n: int, min_words: int, tolerance: int) -> int:
    """The exact run that every passage of an item of n words holds at least."""
    if n < min_words:
        sizes = [(n, n // tolerance)]
    else:
        most = edits_of(min_words, tolerance)
        sizes = [(m, e) for m in range(min_words, (most + 1) * tolerance) for e in range(most + 1) if e <= m // tolerance and m - e >= min_words]
    return max(1, min(-(-(m - e) // (e + 1)) for m, e in sizes))


def furthest(doc: list[int], item: list[int], i: int, j: int, edits: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """How far the item can be followed from doc[i], item[j] with 0, 1, ... edits: (document place, item place, lost words)."""
    n, m = len(doc), len(item)

    def slide(i: int, j: int) -> tuple[int, int]:
        while i < n and j < m and doc[i] == item[j]:
            i, j = i + 1, j + 1
        return i, j

    front = {0: (*slide(i, j), ())}
    out = [front[0]]
    for _ in range(edits):
        new: dict[int, tuple[int, int, tuple[int, ...]]] = {}
        for i, j, lost in front.values():
            if j == m:
                continue
            steps = [(i, j + 1, (*lost, j))]  # missing
            if i < n:
                steps += [(i + 1, j + 1, (*lost, j)), (i + 1, j, lost)]  # replaced, added
            for x, y, z in steps:
                x, y = slide(x, y)
                if x - y not in new or (y, -len(z)) > (new[x - y][1], -len(new[x - y][2])):
                    new[x - y] = x, y, z
        if not new:
            break
        front = new
        out.append(max(front.values(), key=lambda f: (f[1], -len(f[2]), -f[0])))
    return out


def distinct_items(items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(key, words, rare words) of the distinct items without stock openings, and (key, item_id).

    An opening that many different items share is stock; words that few items hold are distinctive. Both are counted over
    all items.
    """
    rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null")
    schema = T.StructType([rows.schema["item_id"], T.StructField("words", T.ArrayType(T.StringType())), T.StructField("heads", T.ArrayType(T.BinaryType()))])

    def heads(words: list[str]) -> list[bytes]:
        """Hashes of the openings of STOCK_WORDS words and more."""
        h, out = hashlib.blake2b(digest_size=16), []
        for i, w in enumerate(words, 1):
            h.update(w.encode() + b" ")
            if i >= STOCK_WORDS:
                out.append(h.copy().digest())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string())), pa.array(map(heads, lists), pa.list_(pa.binary()))], ["item_id", "words", "heads"])

    def key() -> Column:
        return F.md5(F.array_join("words", " ").cast("binary"))

    rows = checkpoint(rows.mapInArrow(run, schema).filter("size(words) > 0").withColumn("whole", key()))
    opened = rows.dropDuplicates(["whole"]).select("whole", F.posexplode("heads").alias("at", "head"))
    shared = opened.groupBy("head").agg(F.count("*").alias("n")).filter(F.col("n") >= STOCK_ITEMS).select("head")
    stock = opened.join(shared, "head").groupBy("whole").agg((F.max("at") + STOCK_WORDS).alias("stock"))
    rows = rows.join(stock, "whole", "left").withColumn("stock", F.when(F.col("stock") < F.size("words"), F.col("stock")).otherwise(0))
    rows = rows.select("item_id", F.expr("slice(words, stock + 1, size(words))").alias("words")).withColumn("key", key())
    texts = checkpoint(rows.groupBy("key").agg(F.first("words").alias("words")))
    held = texts.select("key", F.explode(F.array_distinct("words")).alias("word"))
    rare = held.join(held.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") <= DISTINCTIVE).select("word"), "word")
    texts = texts.join(rare.groupBy("key").agg(F.collect_set("word").alias("rare")), "key", "left")
    return texts.select("key", "words", F.coalesce("rare", F.array().cast("array<string>")).alias("rare")), rows.select("key", "item_id").distinct()


def item_blocks(texts: DataFrame, block_words: int) -> list[DataFrame]:
    """The distinct items in blocks of about `block_words` words."""
    texts = checkpoint(texts)
    count = max(1, -(-(texts.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))
    return [texts.filter(F.pmod(F.xxhash64("key"), F.lit(count)) == k) for k in range(count)]


def seeds_of(texts: DataFrame, min_words: int, tolerance: int) -> tuple[list[int], np.ndarray]:
    """The lengths of the items' seeds, and a bitmap of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, places = WordCodes(), set()
        for batch in batches:
            for words in batch.column(0).to_pylist():
                q = seed_of(len(words), min_words, tolerance)
                places.update((q, x) for x in slots(rolling(coded(words), q), SEED_BITS).tolist())
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in places], pa.int32()), pa.array([x for _, x in places], pa.int32())], ["q", "slot"])

    bits, sizes = np.zeros(1 << SEED_BITS, bool), set()
    for batch in texts.select("words").mapInArrow(run, "q int, slot int").distinct().toArrow().to_batches():  # at most 2**24 slots a length
        sizes.update(batch.column(0).to_pylist())
        bits[batch.column(1).to_numpy()] = True
    return sorted(sizes), np.packbits(bits)


_AUTOMATA: dict[str, Automaton] = {}


class Search:
    """One block of items as tasks see it: the automaton is built once in a Python worker."""

    def __init__(self, block: DataFrame, min_words: int, tolerance: int):
        rows = [(r.key, r.words, set(r.rare)) for r in block.collect()]
        self.shared, self.key, self.bounds = block.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex, (min_words, tolerance)

    def automaton(self) -> Automaton:
        if self.key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[self.key] = Automaton(self.shared.value, *self.bounds)
        return _AUTOMATA[self.key]


def sharing_seeds(docs: DataFrame, texts: DataFrame, min_words: int, tolerance: int) -> DataFrame:
    """The documents (doc_id, text) that share a seed with any item, and few others."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds_of(texts, min_words, tolerance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (sizes, bits), coded = shared.value, WordCodes()

        def shares(text: str) -> bool:
            codes = coded(words_of(text))
            return any(is_set(bits, slots(rolling(codes, q), SEED_BITS)).any() for q in sizes)

        for batch in batches:
            yield batch.filter(pa.array(map(shares, batch.column(1).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def find_leaks(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_words: int = MIN_WORDS, tolerance: int = TOLERANCE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id) of every document that carries a passage of an item.

    Null and empty texts on either side give no rows; ids of equal items all appear; repeated rows give one pair. Items
    without words have no passages. Texts of any length are read whole.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    texts, ids = distinct_items(items, item_id, item_text)
    blocks = item_blocks(texts, block_words)
    if len(blocks) > 1:
        docs = checkpoint(sharing_seeds(docs, texts, min_words, tolerance))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("key", T.StringType())])
    found = None
    for block in blocks:
        search = Search(block, min_words, tolerance)

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            sam = search.automaton()
            for batch in batches:
                docs, hits = [], []
                for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for k in sam.spans(words_of(text), whole=False):
                        docs.append(d)
                        hits.append(sam.keys[k])
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(hits, pa.string())], ["doc_id", "key"])

        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.join(ids, "key").select("doc_id", "item_id").distinct()


def remove_leaks(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    max_coverage: float = 0.5, min_words: int = MIN_WORDS, tolerance: int = TOLERANCE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, text, removed_words): texts without the spans that carry item passages.

    A text of which more than `max_coverage` of the words are leaked becomes null. Null texts stay null.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast("array<int>").alias("spans"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.IntegerType()))])
    blocks = item_blocks(distinct_items(items, item_id, item_text)[0], block_words)

    def cut(text: str | None, spans: list[int]) -> tuple[str | None, int]:
        if not spans:
            return text, 0
        where, keep, chars, last, count = word_spans(text), [], 0, 0, 0
        for a, b in sorted(zip(spans[::2], spans[1::2])):
            a = max(a, last)
            if a < b:
                count, last = count + b - a, b
                keep.append(text[chars : where[a][0]])
                chars = where[b - 1][1]
        return (None if count > max_coverage * len(where) else "".join(keep) + text[chars:]), count

    for k, block in enumerate(blocks):
        search = Search(block, min_words, tolerance)

        def run(batches: Iterator[pa.RecordBatch], search=search, last=k == len(blocks) - 1) -> Iterator[pa.RecordBatch]:
            sam = search.automaton()
            for batch in batches:
                texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for text, known in zip(texts, spans):
                    known += [x for ranges in sam.spans(words_of(text)).values() for span in ranges for x in span] if text else []
                if last:
                    texts, removed = zip(*map(cut, texts, spans)) if texts else ((), ())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["doc_id", "text", "removed_words"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32()))], ["doc_id", "text", "spans"])

        if k == len(blocks) - 1:
            schema = T.StructType([*schema.fields[:2], T.StructField("removed_words", T.IntegerType())])
        docs = docs.mapInArrow(run, schema)
        if k < len(blocks) - 1:
            docs = checkpoint(docs)
    return docs
