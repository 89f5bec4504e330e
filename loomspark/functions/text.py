"""Text functions as Column expressions. Nulls give null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 13
MIN_CONTAINED = 48
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
#: White space of Python's str.split, which regular expressions know only in part.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same, as characters.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def explode_once(df: DataFrame, array: Column, name: str, *kept: str) -> DataFrame:
    """The kept columns and one row per element of a computed array.

    A plain explode makes Catalyst infer a filter on the array's size, which computes the array a second time; the outer
    form does not, and the row that it adds for an empty array is filtered.
    """
    return df.select(*kept, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a costly column that later filters and projections read: Catalyst would else compute it in each of them."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: an expression inside a lambda is else computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def normalize(text: Column) -> Column:
    """Lower-case letters a-z and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def strip(text: Column) -> Column:
    """Without white space at both ends, in the sense of Python."""
    return F.btrim(text, F.lit(SPACES))


def split_words(text: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    return let(strip(text), lambda body: F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"{SPACE}+")))


def prompt_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def ngrams(words: Column, size: int) -> Column:
    """All runs of `size` words, joined by spaces; empty for fewer words."""

    def grams(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<string>"))

    return let(words, grams)


def gram_hashes(words: Column, size: int) -> Column:
    """Distinct 64-bit hashes of all runs of `size` words: to find candidates, which are then compared by their words."""

    def grams(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    return let(words, grams)


def shingles(normalized: Column, size: int = SHINGLE) -> Column:
    """Distinct word shingles of normalized text."""
    return F.array_distinct(ngrams(F.filter(F.split(normalized, " "), lambda w: w != ""), size))


def jaccard(left: Column, right: Column) -> Column:
    """Share of common elements of two arrays of distinct elements; 0 if one is empty."""

    def score(p: Column) -> Column:
        a, b, common = F.size(p["a"]), F.size(p["b"]), F.size(F.array_intersect(p["a"], p["b"]))
        return F.when((a == 0) | (b == 0), 0.0).otherwise(common / (a + b - common))

    return let(F.struct(left.alias("a"), right.alias("b")), score)


def contained(a: Column, b: Column, least: int = MIN_CONTAINED) -> Column:
    """Does one of two texts of at least `least` characters hold the other?"""
    return (F.least(F.length(a), F.length(b)) >= least) & (F.contains(a, b) | F.contains(b, a))


def repetition_rate(words: Column, size: int = 32) -> Column:
    """Share of n-gram positions that repeat an earlier n-gram; 0 for shorter texts."""
    return let(ngrams(words, size), lambda g: F.when(F.size(g) == 0, 0.0).otherwise((F.size(g) - F.size(F.array_distinct(g))) / F.size(g)))


def reasoning(response: Column) -> Column:
    """The text before the first closing think tag, without opening tags; empty without a closing tag."""
    at = F.instr(response, THINK_CLOSE)
    return F.when(at > 0, F.replace(F.substring(response, F.lit(1), at - 1), F.lit(THINK_OPEN), F.lit(""))).otherwise(F.when(response.isNotNull(), ""))


def answer(response: Column) -> Column:
    """The text after the first closing think tag, or all of it."""
    at = F.instr(response, THINK_CLOSE)
    return F.when(at > 0, F.substring(response, at + len(THINK_CLOSE), F.length(response))).otherwise(response)


def boxed(text: Column) -> Column:
    r"""The content of the last \boxed{...} (or \fbox{...} if there is none), braces matched; null if not closed."""

    def after(marker: str) -> Column:
        return F.when(F.instr(text, marker) > 0, F.substring_index(text, marker, -1))

    rest = F.coalesce(after("\\boxed{"), after("\\fbox{"))
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(F.when(s["depth"] == 0, 0).otherwise(depth).alias("depth"), F.when(s["depth"] == 0, s["size"]).otherwise(s["size"] + 1).alias("size"))

    end = F.aggregate(F.split(rest, ""), state, step)
    return F.when(end["depth"] == 0, F.substring(rest, F.lit(1), end["size"] - 1))


def normalize_number(value: Column) -> Column:
    """Without white space, commas and dollars; whole numbers in canonical form, anything else in lower case."""
    bare = F.regexp_replace(value, r"[\s,$]", "")
    digits = F.regexp_replace(bare, r"^([+-]?)0+(?=\d)", "$1")
    whole = F.regexp_replace(F.regexp_replace(digits, r"^\+", ""), "^-0$", "0")
    return F.when(bare.rlike(r"^[+-]?\d+$"), whole).otherwise(F.lower(bare))


def final_letter(text: Column, choices: str = "ABCD") -> Column:
    """The boxed letter, or else the last letter of the choices that stands alone."""
    inside = F.regexp_extract(F.upper(boxed(text)), rf"^\W*([{choices}])\W*$", 1)
    alone = F.try_element_at(F.regexp_extract_all(F.upper(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])([{choices}])(?![\p{{L}}\p{{N}}_])"), F.lit(1)), F.lit(-1))
    return F.when(F.coalesce(inside, F.lit("")) != "", inside).otherwise(alone)


def extract_code(text: Column) -> Column:
    """The last fenced block, or the whole text."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)```(?:python)?\s*(.*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(blocks, F.lit(-1)), text)


def messages_text(messages: Column, role: str, separator: str) -> Column:
    """Contents of a role's messages, joined."""
    return F.array_join(F.transform(F.filter(messages, lambda m: F.lower(F.trim(m["role"])) == role), lambda m: F.coalesce(m["content"], F.lit(""))), separator)


def first_content(messages: Column, role: str) -> Column:
    """The content of the first message of a role."""
    return F.get(F.filter(messages, lambda m: F.lower(F.trim(m["role"])) == role), 0)["content"]


def unwrap_answer(raw: Column) -> Column:
    """The first element of an answer written as a JSON list; any other answer without white space at its ends."""
    body = strip(raw)
    return F.when(body.startswith("[") & body.endswith("]"), F.coalesce(F.get_json_object(body, "$[0]"), body)).otherwise(body)


def constraint_count(constraint: Column) -> Column:
    """Non-blank pieces between tabs."""
    return F.size(F.filter(F.split(constraint, "\t"), lambda x: F.trim(x) != ""))


def constraint_families(text: Column) -> Column:
    """Sorted distinct families (before the colon) of constraint ids in a written-out structure."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"'([a-z_]+):[a-z_\-]+'"), F.lit(1))))


def strip_wrapper(text: Column, prefix: str, suffix: str) -> Column:
    """The part after the first prefix and before the last suffix."""
    inner = F.when(F.instr(text, prefix) > 0, F.substring(text, F.instr(text, prefix) + len(prefix), F.length(text))).otherwise(text)
    tail = F.substring_index(inner, suffix, -1)
    cut = F.substring(inner, F.lit(1), F.length(inner) - F.length(tail) - len(suffix))
    return strip(F.when(F.instr(inner, suffix) > 0, cut).otherwise(inner))


def reconstruct_question(mode: Column, bare: Column, prefix: Column, suffix: Column, lead: Column, trail: Column) -> Column:
    """The question of a placeholder: written as it stood (`exact`), or in the canonical wrapping."""
    exact = F.concat(F.coalesce(lead, F.lit("")), bare, F.coalesce(trail, F.lit("")))
    return F.when(mode == "exact", exact).otherwise(F.concat(F.coalesce(prefix, F.lit("")), bare, F.coalesce(suffix, F.lit(""))))


def sample_id(split: Column, domain: Column, source: Column, source_id: Column) -> Column:
    return F.concat(split, F.lit("_"), domain, F.lit("_"), F.substring(F.sha2(F.concat_ws(":", split, source, source_id), 256), 1, 16))


def media_parts(text: Column) -> Column:
    """A text cut at <image> and <video> placeholders into typed parts."""
    parts = F.filter(F.split(text, r"(?=<image>|<video>)|(?<=<image>|<video>)"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), p.alias("value")))


def truncate_tokens(tokens: Column, size: int, side: str) -> Column:
    """At most `size` tokens, cutting on the left, the right or in the middle; `error` fails for longer ones."""
    n = F.size(tokens)
    left, right = size // 2, size - size // 2
    if side == "left":
        cut = F.slice(tokens, F.greatest(n - (size - 1), F.lit(1)), size)
    elif side == "right":
        cut = F.slice(tokens, 1, size)
    elif side == "middle":
        cut = F.concat(F.slice(tokens, 1, left), F.slice(tokens, F.greatest(n - (right - 1), F.lit(1)), right))
    elif side == "error":
        return F.when(n > size, F.raise_error(F.concat(F.lit("too many tokens: "), n.cast("string"))).cast("array<string>")).otherwise(tokens)
    else:
        raise ValueError(f"unknown side {side!r}")
    return F.when(n > size, cut).otherwise(tokens)


def metric_value(line: Column, key: str) -> Column:
    """The number after `key:` in a console line `step:1 - key:value - ...`; null if absent."""
    return F.regexp_extract(line, rf"(?:^|\s){key}:(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
