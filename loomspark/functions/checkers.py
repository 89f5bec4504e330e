"""Instruction checkers: does a response follow a constraint? Each is a Column over the response.

Arguments must be given (nothing is drawn at random). Sentences, words and emoji have plain definitions (`sentences`,
`tokens`, `EMOJI`), which are no trained tokenizers; rules that need part-of-speech tags or syllables are in `UNSUPPORTED`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import SPACE, let, split_words, strip

# Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CONJUNCTIONS = ["and", "but", "for", "nor", "or", "so", "yet"]
PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97]
MULTIPLES = ["14", "21", "28", "35", "42", "49"]
NAMES = (
    "Emma, Liam, Sophia, Jackson, Olivia, Noah, Ava, Lucas, Isabella, Mason, Mia, Ethan, Charlotte, Alexander, Amelia, Benjamin, Harper, Leo, Zoe, Daniel, Chloe, Samuel, Lily, Matthew, Grace, Owen, Abigail, Gabriel, Ella, Jacob, Scarlett, Nathan, Victoria, Elijah, Layla, Nicholas, Audrey, David, Hannah, Christopher, Penelope, Thomas, Nora, Andrew, Aria, Joseph, Claire, Ryan, Stella, Jonathan"
).split(", ")
TEMPLATE = ["My Answer:", "My Conclusion:", "Future Outlook:"]

CAPITALS = (
    "Reykjavik, Helsinki, Oslo, Tallinn, Stockholm, Riga, Moscow, Copenhagen, Vilnius, Minsk, Dublin, Berlin, Amsterdam, Warsaw, London, Brussels, Prague, Luxembourg, Paris, Vienna, Bratislava, Budapest, Vaduz, Chisinau, Bern, Ljubljana, Zagreb"
).split(", ")
PRONOUNS = (
    "i me we us you he him she her it they them my mine our ours your yours his hers its their theirs myself ourselves yourself yourselves himself herself itself themselves this that these those who whom whose which what whoever whomever whatever whichever "
    "anybody anyone anything everybody everyone everything nobody nothing somebody someone something each either neither both all some any none"
).split()
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
CITY_HEADER = ["ID", "Country", "City", "Year", "Count"]
PRODUCT_HEADER = ["ProductID", "Category", "Brand", "Price", "Stock"]
STUDENT_HEADER = ["StudentID", "Subject", "Grade", "Semester", "Score"]
#: Blocks of code points that are emoji (a plain definition, not the registry's list of sequences).
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23FA}\x{1F1E6}-\x{1F1FF}\x{FE0F}]"

UNSUPPORTED = {
    "words:start_verb": "needs part-of-speech tags",
    "words:odd_even_syllables": "needs syllable counts",
}


def bare(t: Column) -> Column:
    """Without ASCII punctuation."""
    return F.translate(t, PUNCTUATION, "")


def trimmed(w: Column) -> Column:
    """A word without punctuation at its ends."""
    cls = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
    return F.regexp_replace(w, f"^{cls}+|{cls}+$", "")


def words(t: Column) -> Column:
    return split_words(t)


def plain_words(t: Column) -> Column:
    return split_words(bare(t))


def every(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.forall(items, test)


def sentences(t: Column) -> Column:
    """Pieces between sentence-final marks followed by white space (a plain definition, not a trained one)."""
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def lines(t: Column) -> Column:
    return F.split(t, "\n")


def adjacent(items: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Does the test hold for all neighbours?"""
    return let(items, lambda a: F.forall(F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.size(a)), test), lambda x: x))


def word_count_range(t: Column, low: int, high: int) -> Column:
    return F.regexp_count(t, F.lit(r"(?U)\w+")).between(low, high)


def unique_words(t: Column, least: int) -> Column:
    return F.size(F.array_distinct(F.transform(words(F.lower(t)), trimmed))) >= least


def conjunctions(t: Column, least: int) -> Column:
    return F.size(F.array_distinct(F.filter(words(t), lambda w: F.lower(trimmed(w)).isin(CONJUNCTIONS)))) >= least


def person_names(t: Column, least: int) -> Column:
    return sum((t.rlike(rf"\b{n}\b").cast("int") for n in NAMES), F.lit(0)) >= least


def _trigrams(t: Column) -> Column:
    """Distinct runs of three characters, put together from the characters (a substring would seek from the start)."""

    def runs(c: Column) -> Column:
        two = F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda a, b: F.concat(a, b))
        three = F.zip_with(two, F.slice(c, 3, F.greatest(F.size(c), F.lit(1))), lambda a, b: F.concat(a, b))
        return F.array_distinct(F.array_compact(three))

    return let(F.filter(F.split(t, ""), lambda c: c != ""), runs)


def trigram_overlap(t: Column, reference: Column, percent: float) -> Column:
    """Share of the response's distinct character trigrams that the reference has, within two points of a percentage."""
    share = let(_trigrams(t), lambda a: 100 * F.size(F.array_intersect(a, _trigrams(reference))) / F.greatest(F.size(a), F.lit(1)))
    return share.between(percent - 2, percent + 2)


def numbers(t: Column, n: int) -> Column:
    return F.regexp_count(bare(t), F.lit(r"\d+")) == n


def alphabet_loop(t: Column) -> Column:
    """Each word begins with the letter after that of the word before, z before a."""
    code = lambda w: F.ascii(F.lower(F.substring(w, 1, 1)))
    ws = plain_words(t)
    return every(ws, lambda w: F.lower(F.substring(w, 1, 1)).rlike("^[a-z]$")) & adjacent(ws, lambda a, b: (code(a) - 96) % 26 == (code(b) - 97) % 26)


def few_vowels(t: Column) -> Column:
    return (F.size(F.filter(F.split(strip(t), "\n"), lambda x: F.trim(x) != "")) == 1) & (F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[aeiou]"), F.lit(0)))) <= 3)


def consonant_clusters(t: Column) -> Column:
    return every(words(F.lower(t)), lambda w: w.rlike("[bcdfghjklmnpqrstvwxyz]{2}"))


def palindromes(t: Column, least: int = 10, size: int = 5) -> Column:
    return F.size(F.filter(plain_words(F.lower(t)), lambda w: (F.length(w) >= size) & (w == F.reverse(w)))) >= least


def punctuation_cover(t: Column) -> Column:
    """All of . , ! ? ; : and one interrobang, which may be written as !? or ?!."""
    rest = F.regexp_replace(t, r"^((?s:.*?))(?:‽|!\?|\?!)", "$1")
    ok = rest != t
    for c in ".,!?;:":
        ok = ok & F.contains(rest, F.lit(c))
    return ok


def nested_parentheses(t: Column, depth: int = 5) -> Column:
    """Does a group that reached the depth close again? A mismatch begins anew."""
    pairs = {")": "(", "]": "[", "}": "{"}
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("deep"), F.lit(False).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        opened = c.isin("(", "[", "{")
        match = F.lit(False)
        for close, open_ in pairs.items():
            match = match | ((c == close) & s["stack"].endswith(open_))
        closing = c.isin(*pairs)
        stack = F.when(opened, F.concat(s["stack"], c)).when(match, F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - 1)).when(closing, F.lit("")).otherwise(s["stack"])
        deep = F.when(opened, F.greatest(s["deep"], F.length(s["stack"]) + 1)).when(closing & ~match, F.lit(0)).otherwise(s["deep"])
        done = match & (s["deep"] >= depth)
        return F.struct(stack.alias("stack"), F.when(match & (F.length(s["stack"]) == 1), 0).otherwise(deep).alias("deep"), (s["ok"] | done).alias("ok"))

    return F.aggregate(F.split(F.regexp_replace(t, r"[^()\[\]{}]", ""), ""), start, step)["ok"]


def prime_lengths(t: Column) -> Column:
    return every(plain_words(t), lambda w: F.length(w).isin(PRIMES))


def option_response(t: Column, options: list[str], strict: bool) -> Column:
    """Is the response one of the options? Unless strict, case, and punctuation and spaces at the ends, do not count."""
    ends = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~ ]"
    norm = (lambda x: x) if strict else (lambda x: F.lower(F.regexp_replace(x, f"^{ends}+|{ends}+$", "")))
    return norm(t).isin(*[norm(F.lit(o)) for o in options]) if strict else F.array_contains(F.array(*[norm(F.lit(o)) for o in options]), norm(t))


def newline_words(t: Column) -> Column:
    return F.size(F.filter(lines(bare(t)), lambda x: strip(x) != "")) == F.size(plain_words(t))


def nth_word_japanese(t: Column, n: int) -> Column:
    nth = F.filter(F.transform(words(t), lambda w, i: F.when((i + 1) % n == 0, trimmed(w))), lambda w: w.isNotNull())
    return every(nth, lambda w: (w == "") | w.rlike(r"^\d+$") | w.rlike("[\u3040-\u30ff\u4e00-\u9fff]"))


def word_repeats(t: Column, most: int) -> Column:
    ws = plain_words(F.lower(t))
    return let(ws, lambda a: F.forall(F.array_distinct(a), lambda w: F.size(F.filter(a, lambda x: x == w)) <= most))


def paragraph_first_last(t: Column) -> Column:
    ends = F.filter(F.transform(lines(F.lower(t)), plain_words), lambda w: F.size(w) > 0)
    return every(ends, lambda w: F.get(w, 0) == F.try_element_at(w, F.lit(-1)))


def no_consecutive_initials(t: Column) -> Column:
    return adjacent(plain_words(F.lower(t)), lambda a, b: F.substring(a, 1, 1) != F.substring(b, 1, 1))


def quote_explained(t: Column) -> Column:
    tight = F.regexp_replace(t, f"{SPACE}+", "")
    return ~F.contains(tight, F.lit('""')) & ~F.contains(tight, F.lit("”“")) & ~tight.rlike('["”]$')


def marker_list(t: Column, marker: str) -> Column:
    return (F.length(t) - F.length(F.replace(t, F.lit(marker), F.lit("")))) / len(marker) >= 2


def italics_thesis(t: Column) -> Column:
    return t.rlike(r"(?s)<(i|em)>\s*[^<\s].*?</\1>\s*\S")


def sub_bullets(t: Column) -> Column:
    return let(F.split(t, r"\*"), lambda a: every(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), lambda x: F.contains(x, F.lit("-"))))


def multiples(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)) == F.array(*[F.lit(x) for x in MULTIPLES])


def reversed_phrase(t: Column) -> Column:
    return F.contains(F.lower(t), F.lit("elgae dlab"))


def date_list(t: Column) -> Column:
    part = lambda d, k: F.regexp_extract(d, r"^(\d{4})-(\d{2})-(\d{2})$", k).try_cast("int")
    last = lambda m: F.when(m == 2, 29).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = lambda d: part(d, 1).between(1769, 1821) & part(d, 2).between(1, 12) & part(d, 3).between(1, last(part(d, 2)))
    return every(F.transform(F.split(t, ","), lambda d: F.trim(d)), lambda d: F.coalesce(ok(d), F.lit(False)))


def keyword_counts(t: Column, keywords: list[str], counts: tuple[int, ...] = (1, 2, 3, 5, 7)) -> Column:
    ok = F.lit(True)
    for k, n in zip(keywords, counts):
        ok = ok & ((F.length(t) - F.length(F.replace(F.lower(t), F.lit(k.lower()), F.lit("")))) / len(k) == n)
    return ok


def repeat_changed(t: Column, request: Column) -> Column:
    tail = lambda c: let(words(c), lambda a: F.slice(a, 2, F.greatest(F.size(a), F.lit(1))))
    return (t != request) & (tail(t) == tail(request))


def repeat_simple(t: Column, request: Column) -> Column:
    return F.lower(strip(t)) == F.lower(strip(request))


def repeat_span(t: Column, request: Column, start: int, end: int) -> Column:
    return F.lower(strip(t)) == F.lower(strip(F.substring(request, start + 1, end - start + 1)))


def output_template(t: Column) -> Column:
    ok = F.lit(True)
    for x in TEMPLATE:
        ok = ok & F.contains(t, F.lit(x))
    return ok


def no_whitespace(t: Column) -> Column:
    return ~t.rlike(SPACE)


def sentence_type_ratio(t: Column) -> Column:
    s = sentences(t)
    end = lambda c: F.size(F.filter(s, lambda x: x.endswith(c)))
    return end(".") == 2 * end("?")


def sentence_balance(t: Column) -> Column:
    s = sentences(t)
    end = lambda c: F.size(F.filter(s, lambda x: x.endswith(c)))
    return (end(".") == end("?")) & (end("?") == end("!"))


def keyword_in_sentence(t: Column, keyword: str, n: int) -> Column:
    return F.coalesce(F.get(sentences(t), n - 1).rlike(rf"(?i)\b{keyword}\b"), F.lit(False))


def last_first(t: Column) -> Column:
    ends = F.transform(sentences(F.lower(t)), plain_words)
    return adjacent(ends, lambda a, b: F.try_element_at(a, F.lit(-1)) == F.get(b, 0))


def growing_sentences(t: Column, n: int) -> Column:
    return adjacent(F.transform(sentences(t), lambda s: F.size(plain_words(s))), lambda a, b: b == a + n)


def three_equal_sentences(t: Column) -> Column:
    s = F.transform(sentences(t), lambda x: F.length(strip(x)))
    return (F.size(s) == 3) & (F.size(F.array_distinct(s)) == 1)


def alphabet_sentences(t: Column) -> Column:
    s = F.transform(sentences(t), lambda x: F.lower(F.substring(x, 1, 1)))
    return F.array_join(s, "") == "abcdefghijklmnopqrstuvwxyz"


def indent_stairs(t: Column) -> Column:
    """Lines (without blank ones) indent further and further."""
    kept = F.filter(lines(t), lambda x: strip(x) != "")
    return adjacent(F.transform(kept, lambda x: F.length(x) - F.length(F.ltrim(x))), lambda a, b: b > a)


def nested_quotes(t: Column, levels: int = 3) -> Column:
    """Single and double quotes open inside each other, and `levels` of them close again from the deepest there was."""
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("deep"), F.lit(False).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        closes = s["stack"].endswith(c) & (s["stack"] != "")
        stack = F.when(closes, F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - 1)).otherwise(F.concat(s["stack"], c))
        return F.struct(stack.alias("stack"), F.greatest(s["deep"], F.length(stack)).alias("deep"), (s["ok"] | (closes & (s["deep"] - F.length(stack) >= levels))).alias("ok"))

    return F.aggregate(F.filter(F.split(F.regexp_replace(t, "[^'\"]", ""), ""), lambda c: c != ""), start, step)["ok"]


def _table(t: Column) -> Column:
    """Lines of a table; the line end after the last one opens no further line."""
    return F.split(F.regexp_replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), r"\n\z", ""), "\n")


def _fields(line: Column, separator: str) -> Column:
    """The number of fields; quoted ones may hold separators."""
    return F.regexp_count(F.regexp_replace(line, '"[^"]*"', ""), F.lit(separator)) + 1


def _header(names: list[str], between: str) -> str:
    return "^" + between.join(f'(?:{n}|"{n}")' for n in names) + "$"


def csv_city(t: Column) -> Column:
    """The header of `CITY_HEADER` and seven rows of five fields."""
    return let(_table(t), lambda a: (F.size(a) == 8) & F.get(a, 0).rlike(_header(CITY_HEADER, ",")) & every(a, lambda x: (x != "") & (_fields(x, ",") == 5)))


def csv_special_character(t: Column) -> Column:
    """The header of `PRODUCT_HEADER` and fourteen rows, of five fields up to one with a special character in quotes."""

    def first(a: Column) -> Column:
        flags = F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x: F.when(_fields(x, ",") != 5, "short").when(x.rlike(r'(?U)(?:^|,)"[^"]*[^\d\w\s"][^"]*"'), "special").otherwise("plain"))
        return F.coalesce(F.get(F.filter(flags, lambda f: f != "plain"), 0) == "special", F.lit(False))

    return let(_table(t), lambda a: (F.size(a) == 15) & strip(F.get(a, 0)).rlike(_header(PRODUCT_HEADER, r",[ \t]*")) & first(a))


def csv_quotes(t: Column) -> Column:
    """The header of `STUDENT_HEADER`, tabs between fields, three rows, and all fields in double quotes."""
    quoted = r'^ *"[^"\t]*" *(?:\t *"[^"\t]*" *){4}$'
    return let(_table(t), lambda a: (F.size(a) == 4) & strip(F.get(a, 0)).rlike(_header(STUDENT_HEADER, r"\t *")) & every(a, lambda x: x.rlike(quoted)))


def tokens(t: Column) -> Column:
    """Words, hyphenated ones whole, and single marks (a plain definition, not a trained tokenizer)."""
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}\p{M}_]+(?:['’-][\p{L}\p{N}\p{M}_]+)*|[^\p{L}\p{N}\p{M}_\s]"), F.lit(0))


def _is_word(w: Column) -> Column:
    return w.rlike(r"^[\p{L}\p{N}\p{M}_]")


def stop_word_share(t: Column, percent: float) -> Column:
    """At most so many percent of the words are stop words; no words, no share."""
    ws = F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    return let(ws, lambda a: (F.size(a) > 0) & (F.size(F.filter(a, lambda w: w.isin(STOP_WORDS))) * 100 / F.greatest(F.size(a), F.lit(1)) <= percent))


def pronouns(t: Column, least: int) -> Column:
    return F.size(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0)), lambda w: w.isin(PRONOUNS))) >= least


def growing_alliteration(t: Column) -> Column:
    """Every sentence has more words in runs of one first letter than the one before."""

    def runs(sentence: Column) -> Column:
        initials = F.filter(F.transform(words(F.lower(sentence)), lambda w: F.substring(F.regexp_replace(w, r"^[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~ ]+", ""), 1, 1)), lambda c: c != "")
        same = lambda a: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), lambda x, y: x == y)
        # A run of n words has n - 1 equal neighbours; the first of them counts for two words.
        return let(let(initials, same), lambda f: F.size(F.filter(f, lambda x: x)) + F.size(F.filter(f, lambda x, i: x & ((i == 0) | ~F.coalesce(F.get(f, i - 1), F.lit(False))))))

    return adjacent(F.transform(sentences(t), runs), lambda a, b: a < b)


def ends_with_emoji(t: Column) -> Column:
    """An emoji at the end of every sentence, or at the beginning of the next."""
    bared = F.transform(sentences(t), lambda s: strip(bare(s)))
    near = lambda a: F.transform(a, lambda x, i: F.right(x, F.lit(2)).rlike(EMOJI) | F.coalesce(F.left(F.get(a, i + 1), F.lit(1)).rlike(EMOJI), F.lit(False)))
    return let(bared, lambda a: every(a, lambda x: x != "") & every(near(a), lambda ok: ok))


def ascii_fold(t: Column) -> Column:
    """Letters without marks; what has no plain form is left out."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")

    return fold(t)


def countries_backwards(t: Column, least: int = 52) -> Column:
    """From the line of Zimbabwe on, at least so many lines in descending order, without marks on letters."""
    ends = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~ ]"
    kept = F.filter(F.transform(lines(ascii_fold(t)), lambda x: F.regexp_replace(x, f"^{ends}+|{ends}+$", "")), lambda x: x != "")

    def ordered(a: Column) -> Column:
        return let(F.slice(a, F.greatest(F.array_position(F.transform(a, lambda x: F.contains(x, F.lit("Zimbabwe"))), True), F.lit(1)).cast("int"), F.greatest(F.size(a), F.lit(1))), lambda b: (F.size(b) >= least) & F.contains(F.get(b, 0), F.lit("Zimbabwe")) & adjacent(b, lambda x, y: x >= y))

    return F.coalesce(let(kept, ordered), F.lit(False))


def capitals_sorted(t: Column) -> Column:
    """The capitals of `CAPITALS` in their order, between commas."""
    given = F.filter(F.transform(F.split(ascii_fold(t), ","), strip), lambda x: x != "")
    return given == F.array(*map(F.lit, CAPITALS))


def reversed_sentence(t: Column) -> Column:
    """Read backwards, word by word, one sentence about the bald eagle."""
    back = F.array_join(F.reverse(words(bare(F.lower(strip(t))))), " ")
    return F.contains(back, F.lit("bald eagle"))


def some_bullets(t: Column) -> Column:
    """At least two sentences, then at least two lines that start with an asterisk, and nothing else after them."""

    def shape(a: Column) -> Column:
        flags = F.transform(a, lambda x: strip(x).startswith("*"))
        first = F.array_position(flags, True)
        before = F.aggregate(F.slice(a, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int")), F.lit(0), lambda n, x: n + F.size(sentences(strip(x))))
        # A blank line among the leading lines ends the sentences: only bullets may follow it.
        blank = F.exists(F.slice(a, F.lit(1), F.greatest(first - 2, F.lit(0)).cast("int")), lambda x: strip(x) == "")
        bullets = F.size(a) - first + 1
        return (first > 0) & (before >= 2) & ~blank & (bullets >= 2) & every(F.slice(flags, F.greatest(first, F.lit(1)).cast("int"), F.size(a)), lambda f: f)

    return let(lines(t), shape)


def growing_questions(t: Column, questions: int = 4, options: int = 5) -> Column:
    """Nothing but so many numbered questions with so many options each, every question longer than the one before."""
    blocks = F.filter(F.transform(F.split(t, r"\n*Question \d+[.|):;]?\s*"), strip), lambda x: x != "")
    is_option = lambda x: strip(x).rlike(r"(?U)^[A-Ea-e][.|)]\s*\w+")

    def size(block: Column) -> Column:
        flags = F.transform(lines(block), is_option)
        first = F.array_position(flags, True)
        asked = F.slice(lines(block), F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))
        return F.when(F.size(F.filter(flags, lambda f: f)) == options, F.length(strip(F.array_join(F.transform(asked, strip), " "))))

    return t.startswith("Question") & let(F.transform(blocks, size), lambda a: (F.size(a) == questions) & every(a, lambda x: x.isNotNull()) & adjacent(a, lambda x, y: x < y))


def keyword_at(t: Column, keyword: str, sentence: int, word: int) -> Column:
    """The word at a place (from 1) of a sentence; marks are no words."""
    ws = F.filter(tokens(F.get(sentences(t), sentence - 1)), _is_word)
    return F.coalesce(F.lower(F.get(ws, word - 1)) == keyword.lower(), F.lit(False))


def words_at_both_ends(t: Column, keyword: str) -> Column:
    """The second word and the second to last (a closing mark aside) are the keyword."""

    def both(a: Column) -> Column:
        back = F.when(_is_word(F.try_element_at(a, F.lit(-1))), F.try_element_at(a, F.lit(-2))).otherwise(F.try_element_at(a, F.lit(-3)))
        return (F.lower(F.get(a, 1)) == keyword.lower()) & (F.lower(back) == keyword.lower())

    return F.coalesce(let(tokens(t), both), F.lit(False))


def title_case(t: Column) -> Column:
    """No word begins in lower case; one that mixes cases otherwise is let pass."""
    return every(F.filter(tokens(t), lambda w: w.rlike(r"^\p{L}")), lambda w: ~w.rlike(r"^\p{Ll}(?:[^\p{Lu}]*|[^\p{Ll}]*)$"))


#: Checkers whose arguments come with each row: id -> (text, arguments by name) -> Column.
WITH_ARGUMENTS: dict[str, Callable[[Column, Callable[[str], Column]], Column]] = {
    "count:word_count_range": lambda t, arg: word_count_range(t, arg("min_words").cast("int"), arg("max_words").cast("int")),
    "count:unique_word_count": lambda t, arg: unique_words(t, arg("N").cast("int")),
    "count:conjunctions": lambda t, arg: conjunctions(t, arg("small_n").cast("int")),
    "count:numbers": lambda t, arg: numbers(t, arg("N").cast("int")),
    "count:pronouns": lambda t, arg: pronouns(t, arg("N").cast("int")),
    "ratio:stop_words": lambda t, arg: stop_word_share(t, arg("percentage").cast("double")),
    "words:repeats": lambda t, arg: word_repeats(t, arg("small_n").cast("int")),
    "sentence:increment": lambda t, arg: growing_sentences(t, arg("small_n").cast("int")),
}


def follows(instruction: Column, t: Column, arguments: Column) -> Column:
    """Does a response follow the instruction of its row, with the row's arguments (a map)? Others than those above fail."""
    arg = lambda name: F.try_element_at(arguments, F.lit(name))
    out = F.raise_error(F.concat(F.lit("no checker for "), F.coalesce(instruction, F.lit("null")))).cast("boolean")
    for name, check in WITH_ARGUMENTS.items():
        out = F.when(instruction == name, check(t, arg)).otherwise(out)
    return out


def loose_variants(t: Column) -> Column:
    """The eight forms of which one has to pass: without first or last lines, with or without asterisks."""
    ls = lines(t)

    def forms(a: Column) -> Column:
        n = F.size(a)
        cut = [a, F.slice(a, 2, F.greatest(n, F.lit(1))), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.slice(a, 2, F.greatest(n - 2, F.lit(0)))]
        texts = [strip(F.array_join(c, "\n")) for c in cut]
        texts[0] = t
        return F.array(*texts, *[F.replace(x, F.lit("*"), F.lit("")) for x in texts])

    return let(ls, forms)


def strict(t: Column, check: Callable[[Column], Column]) -> Column:
    return (strip(t) != "") & check(t)


def loose(t: Column, check: Callable[[Column], Column]) -> Column:
    return F.exists(loose_variants(t), lambda v: (strip(v) != "") & check(v))
