"""Defects of question-answer pairs in chat messages.

A pair is a user message and the assistant message right after it. Defects, of which a pair has the first that holds:

* `empty`: no assistant message follows, or nothing is left after think blocks, markup and placeholders.
* `truncated`: an open think block, code fence, formula, table row, emphasis or list marker at the end; or an ending
  without final punctuation to which a model of text endings gives a low likelihood.
* `refusal`: a short answer whose first sentences decline, in the first person, to answer, and that says little beside.
* `copied_question`: nearly all words of the answer stand in runs of the question, nearly all of which it gives back,
  and no answer of its own follows.
* `other_language`: the language posteriors of question and answer (character n-gram naive Bayes, over the sentences)
  say that they probably differ, and the answer is mainly in a language that the question does not name.

The ending model holds word and character n-gram counts of sentence ends against other positions, over all responses. A
first pass judges the pairs and leaves open those that the model has to decide; a second counts the words, and the word
pairs that open endings ask for (a bitmap of `SLOTS` bits tells which), combined within each task and summed by a
shuffle; the open endings are joined to the sums. Broadcast are the bitmap and the language model, which is fitted on a
bounded number of labelled texts (`TRAIN_ROWS`).
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm import langid
from loomspark.session import checkpoint

TRAIN_ROWS = 3_000
#: Bits of the map of word pairs that are asked for; different pairs that share one are told apart by the join.
SLOTS = 1 << 20
#: Word pairs that a task holds before it passes them on.
PAIRS_AT_ONCE = 200_000
#: Rows that are judged together.
ROWS_AT_ONCE = 1_000
_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))*\s*/?>|<\|[\w.:-]+\|>")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_FORMULA = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{(\w+\*?)\}.*?\\end\{\1\}|\\[A-Za-z]+", re.S)
_WORD = re.compile(r"[^\W_]+")
#: A brace that closes, one that opens, or one that opens an argument of a command.
_BRACE = re.compile(r"\\[A-Za-z]+(?:\{[^{}]*\})*\{|[{}]")
#: Placeholders that stand for a missing answer.
PLACEHOLDERS = {"", "na", "n a", "null", "none", "nil", "nan", "undefined", "tbd", "todo", "empty", "no answer", "no response", "not available", "not applicable", "placeholder", "answer", "response", "boxed", "text", "python", "endoftext", "pending", "missing", "unknown", "blank", "your answer here", "insert answer here", "answer here", "lorem ipsum"}
#: Ways to decline. The speaker declines to answer or to help; that something is impossible, needed or not
#: allowed in the matter itself declines nothing.
_DECLINE = re.compile(
    r"\bi\b[^.!?]*?\b(?:can(?:'|no)t|can not|won't|will not|unable|not able|not (?:permitted|allowed|authori[sz]ed|going))\b[^.!?]*?\b(?:help|assist|answer|provid|solv|comply|respond|discuss|fulfil|support|shar|engage|complet|do (?:that|this|so)\b)"
    r"|\bi(?:'ll| will| would| must| have to| need to| am going to|'m going to|'d rather)?(?: have to| respectfully| politely)? (?:decline|refuse|pass on)\b"
    r"|\bi(?:'m| am)? (?:do not|don't|not) (?:feel )?comfortable"
    r"|\b(?:against|outside(?: of)?|beyond) (?:my (?:guidelines|rules|policy|policies|principles|instructions|programming|training|scope)|what i)\b"
    r"|\bno (?:answer|solution|help|response) can be (?:given|provided|offered)\b|\b(?:task|thing|topic|something|question|request) (?:that )?i(?: a|')m (?:not|un)"
    r"|\bje dois (?:refuser|décliner)|\bm'est impossible d|\bje ne (?:peux|puis) pas (?:\w+ )?(?:répond|aider|fournir|résoudre|traiter|donner|discuter)|\bje refuse|\bje ne suis pas (?:autorisée?|en mesure)"
    r"|\bno (?:puedo|podré) (?:ayudar|responder|contestar|resolver|proporcionar|dar|cumplir|atender|hablar)|\bno me (?:está permitido|es posible) |\bdebo (?:rechazar|negarme|declinar)|\bme es imposible|\bno estoy autorizad|\bme niego"
    r"|\bich\b[^.!?]*\b(?:nicht|keine?)\b[^.!?]*\b(?:beantwort|helfen|weiterhelfen|antwort|lösen|bearbeit|besprech|liefern|geben|unterstütz)|\b(?:muss|möchte|werde)\b[^.!?]*\b(?:ablehnen|verweigern)|\bich (?:lehne|verweigere)\b"
    r"|не (?:могу|смогу|буду) (?:\w+ )?(?:помоч|ответ|реш|предостав|выполн|обсужд|дать)|вынужден\w* отказ|отказываюсь|не имею права|не вправе|мне (?:нельзя|не разрешено)|нельзя мне"
    r"|(?:我|抱歉|对不起|遗憾)[^。]*?(?:无法|不能|不便|不可以|拒绝)[^。]*?(?:回答|帮|协助|提供|解答|满足|讨论|处理|完成|继续)|我(?:必须)?拒绝"
    r"|(?:お答え|回答|お手伝い|ご協力|対応|お応え)[^。]*?(?:できません|できかねます|いたしかねます)"
)
#: Names of languages in several languages.
LANGUAGE_NAMES = {
    "en": r"english|englisch|anglais|inglés|ingles|английск\w+|英语|英文",
    "de": r"german|deutsch|allemand|alemán|aleman|немецк\w+|德语|德文",
    "fr": r"french|französisch\w*|français|francais|francés|frances|французск\w+|法语|法文",
    "es": r"spanish|spanisch|espagnol|español|espanol|castellano|испанск\w+|西班牙",
    "ru": r"russian|russisch|russe|ruso|русск\w+|俄语|俄文",
    "zh": r"chinese|chinesisch|chinois|chino|mandarin|китайск\w+|中文|汉语|漢語",
    "ja": r"japanese|japanisch|japonais|japonés|японск\w+|日语|日本語",
    "ar": r"arabic|arabisch|arabe|árabe|арабск\w+|العربية",
}
_NAMED = {k: re.compile(rf"(?<!\w)(?:{v})", re.I) for k, v in LANGUAGE_NAMES.items()}
#: Words of a refusal, and of what it says beside declining.
SHORT_REFUSAL, ASIDE = 60, 20
_FINAL = ".!?。！？…\"”»’')]}*`|>_$"


def answer_of(content: str | None) -> str:
    """The text outside closed think blocks."""
    text = _THINK.sub("", content or "")
    low = text.lower()
    if "<think>" not in low and "</think>" in low:  # opened by the chat template
        text = text[low.rindex("</think>") + 8 :]
    return text.strip()


def is_empty(answer: str) -> bool:
    text = _TAG.sub(" ", answer).replace("\\boxed", " ").replace("```python", " ").replace("```text", " ")
    words = _WORD.findall(text.lower())
    return len(words) <= 4 and (" ".join(words) in PLACEHOLDERS) and not (words and re.search(r"\\boxed\{\s*\w", answer))


def is_open(answer: str) -> bool:
    """Does the text end inside a think block, code, formula, table row, emphasis or list marker?"""
    if "<think>" in answer.lower():
        return True
    if answer.count("```") % 2:
        return True
    prose = _CODE.sub(" ", answer)
    if len(re.findall(r"\\begin\{", prose)) > len(re.findall(r"\\end\{", prose)):
        return True
    if prose.count("\\[") > prose.count("\\]") or prose.count("\\(") > prose.count("\\)"):
        return True
    if len(re.findall(r"(?<!\\)\$", prose)) % 2:
        return True
    last = prose.rstrip().rsplit("\n", 1)[-1].strip()
    if prose.count("{") > prose.count("}"):
        opened = []
        for m in _BRACE.finditer(prose):
            if m.group() != "}":
                opened.append(len(m.group()) > 1)
            elif opened:
                opened.pop()
        if any(opened):
            return True
    if not last or answer.rstrip().endswith("```"):  # ends with a whole block of code
        return False
    if last.startswith("|"):
        rows = [x.strip() for x in prose.rstrip().split("\n")]
        above = next((r for r in rows if r.startswith("|")), last)
        if not last.endswith("|") or last.count("|") < above.count("|"):
            return True
    if last.count("**") % 2:
        return True
    return bool(re.fullmatch(r"(?:[-*+•]|\d+[.)]|#+|>)", last)) or last[-1:] in ",;:(=+\\&{["


_ITEM = re.compile(r"\s*[-*•]\s")


def sentences_of(text: str) -> Iterator[list[str]]:
    """The words of each sentence or list item that shows how a text may end.

    A last line without a final mark is what is asked, not evidence: a text that was cut there must not vouch for itself
    or for another cut at the same place.
    """
    lines = _FORMULA.sub(" ", _CODE.sub("\n", _THINK.sub("\n", text))).rstrip().split("\n")
    for at, line in enumerate(lines):
        whole, item = line.strip()[-1:] in ".!?。", _ITEM.match(line)
        if not whole and (not item or at == len(lines) - 1):
            continue
        for sentence in re.split(r"(?<=[.!?。])\s+", line):
            words = _WORD.findall(sentence)
            if words and (item or sentence.rstrip()[-1:] in ".!?。"):
                yield words


class EndingModel:
    """How likely a text ends after its last words: n-gram counts at sentence ends against all positions."""

    def __init__(self, texts: list[str]):
        self.ends1, self.all1, self.ends2, self.all2 = Counter(), Counter(), Counter(), Counter()
        self.tails: Counter = Counter()
        self.inner: Counter = Counter()
        self.starts: set[str] = set()
        for text in texts:
            for sentence in sentences_of(text):
                words = [self.shape(w) for w in sentence]
                for i, w in enumerate(words):
                    before = words[i - 1] if i else "^"
                    self.all1[w] += 1
                    self.all2[before, w] += 1
                if len(words) > 1:
                    self.ends1[words[-1]] += 1
                    self.ends2[words[-2], words[-1]] += 1
        for w in self.all1:
            self.starts.update(w[:n] for n in range(1, len(w)))
            for n in (2, 3, 4):
                if len(w) >= n:
                    self.tails[w[-n:]] += 1
                    for i in range(len(w) - n):
                        self.inner[w[i : i + n]] += 1

    @staticmethod
    def shape(word: str) -> str:
        return "0" if word[0].isdigit() else word.lower()

    @classmethod
    def asked(cls, text: str) -> tuple[str, str] | float:
        """The last two words of a text, or the likelihood of its end where no counts are needed: 1 without words."""
        words = [cls.shape(w) for w in _WORD.findall(text)]
        if not words:
            return 1.0
        if text.rstrip()[-1:] == "-":
            return 0.0
        return words[-2] if len(words) > 1 else "^", words[-1]

    def likelihood(self, text: str) -> float:
        """The likelihood that a text may end here; 1 for a text without words."""
        asked = self.asked(text)
        if isinstance(asked, float):
            return asked
        before, w = asked
        if not self.all1[w]:  # never seen whole: a name, or cut inside
            if w in self.starts:  # a longer word begins like this
                return 0.0
            for n in (4, 3, 2):
                if len(w) >= n and (k := self.tails[w[-n:]] + self.inner[w[-n:]]) >= 3:
                    whole = self.tails[w[-n:]] / k
                    return 0.3 * whole if whole > 0.5 else 0.0
            return 0.0
        seen = self.all2[before, w]
        backoff = (self.ends1[w] + 0.001) / (self.all1[w] + 0.01)
        return (self.ends2[before, w] + 3 * backoff) / (seen + 3)


def is_refusal(answer: str) -> bool:
    """A short answer whose first sentences decline, and which says little beside."""
    words = _WORD.findall(answer)
    if len(words) > SHORT_REFUSAL or (len(words) < 4 and answer.isascii()) or "\\boxed" in answer:
        return False
    text = " ".join(answer.lower().replace("’", "'").replace("‘", "'").replace("`", "'").split())
    sentences = [s for s in re.split(r"(?<=[.!?。！？])\s*", text) if s]
    declined = [bool(_DECLINE.search(s)) for s in sentences]
    return any(declined[:2]) and sum(len(_WORD.findall(s)) for s, d in zip(sentences, declined) if not d) <= ASIDE


def is_copy(question: str, answer: str) -> bool:
    q, a = [w.lower() for w in _WORD.findall(question)], [w.lower() for w in _WORD.findall(answer)]
    if not q or not a or len(a) > 6 * len(q) + 12:
        return False
    if len(q) < 3:
        return a == q
    boxed = re.findall(r"\\boxed\{([^{}]+)\}", answer)
    if boxed and boxed[-1].strip() and f"boxed{{{boxed[-1]}}}" not in question:
        return False

    def covered(x: list[str], y: list[str]) -> list[bool]:
        pairs = set(zip(y, y[1:]))
        out = [False] * len(x)
        for i in range(len(x) - 1):
            if (x[i], x[i + 1]) in pairs:
                out[i] = out[i + 1] = True
        return out

    mine, theirs = covered(a, q), covered(q, a)
    if not any(mine):
        return False
    tail = mine[::-1].index(True)
    return tail <= max(3, len(q) // 12) and sum(mine) >= 0.72 * len(a) and sum(theirs) >= 0.6 * len(q)


def prose_of(text: str) -> str:
    return _FORMULA.sub(" ", _TAG.sub(" ", _CODE.sub("\n", text)))


class Judge:
    def __init__(self, languages: langid.LanguageModel, endings: EndingModel | None = None):
        self.languages, self.endings = languages, endings

    @staticmethod
    def unsure_end(answer: str) -> str | None:
        """The last line of an answer that may be cut there; None after a final mark."""
        end = answer.rstrip()
        return None if end[-1:] in _FINAL or not end else end.rsplit("\n", 1)[-1]

    def defects(self, pairs: list[tuple[str | None, str | None, bool, bool]]) -> list[str | None]:
        """Defects of (question, answer or None, an assistant message follows, flagged as cut by the producer)."""
        kinds, unsure = self.judged(pairs)
        return ["truncated" if i in unsure and self.endings.likelihood(unsure[i][0]) < unsure[i][1] else k for i, k in enumerate(kinds)]

    def judged(self, pairs: list[tuple[str | None, str | None, bool, bool]]) -> tuple[list[str | None], dict[int, tuple[str, float]]]:
        """Defects without the ending model, and where it decides: the last line, and the likelihood below which it is cut."""
        out: list[str | None] = []
        ask: list[int] = []
        unsure: dict[int, tuple[str, float]] = {}
        for i, (q, a, there, flagged) in enumerate(pairs):
            answer = answer_of(a) if there else ""
            kind = None
            if "<think>" in answer.lower():
                kind = "truncated"
            elif not there or is_empty(answer):
                kind = "empty"
            elif is_refusal(answer):
                kind = "refusal"
            elif q and is_copy(q, answer):
                kind = "copied_question"
            elif is_open(answer):
                kind = "truncated"
            else:
                if (line := self.unsure_end(answer)) is not None:
                    unsure[i] = line, 0.15 if flagged else 0.02
                if q:
                    ask.append(i)
            out.append(kind)
        if ask:
            texts = [prose_of(pairs[i][0]) for i in ask] + [prose_of(answer_of(pairs[i][1])) for i in ask]
            p = self.languages.posteriors(texts)
            asked, given = p[: len(ask)], p[len(ask) :]
            apart = 1.0 - (asked * given).sum(axis=1)  # the chance that question and answer differ in language
            for k, i in enumerate(ask):
                lq, la = int(asked[k].argmax()), int(given[k].argmax())
                name = self.languages.langs[la]
                if asked[k].any() and given[k, la] > 0.5 and lq != la and apart[k] > 0.5 and not (name in _NAMED and _NAMED[name].search(pairs[i][0])):
                    out[i] = "other_language"
        return out, unsure


def ending_counts(rows: DataFrame, slots: bytes) -> DataFrame:
    """(before, word, n, ends): how often words stand in sentences of assistant messages and end them.

    before is null for the sums of a word, and else one of the word pairs whose slot is set.
    """
    shared = rows.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, places, ends = shared.value, Counter(), Counter()

        def counted() -> pa.RecordBatch:
            # The words are counted as they are written, and shaped once each here.
            sums: dict[tuple[str | None, str], list[int]] = {}
            for k, counter in enumerate((places, ends)):
                for (b, w), n in counter.items():
                    b, w = b if b == "^" else EndingModel.shape(b), EndingModel.shape(w)
                    for key in ((None, w), (b, w)) if asked_for(bits, b, w) else ((None, w),):
                        sums.setdefault(key, [0, 0])[k] += n
                counter.clear()
            columns = [[b for b, _ in sums], [w for _, w in sums], [n for n, _ in sums.values()], [e for _, e in sums.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["before", "word", "n", "ends"])

        for batch in batches:
            for contents in batch.column(0).to_pylist():
                for text in contents:
                    for words in sentences_of(text or ""):
                        places.update(zip(["^", *words], words))
                        if len(words) > 1:
                            ends[words[-2], words[-1]] += 1
                if len(places) > PAIRS_AT_ONCE:
                    yield counted()
        yield counted()

    said = rows.select(F.expr("filter(messages, m -> lower(trim(m.role)) = 'assistant').content").alias("c"))
    return said.mapInArrow(run, "before string, word string, n bigint, ends bigint").groupBy("before", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def slot_of(before: str, word: str) -> int:
    return zlib.crc32(f"{before} {word}".encode()) % SLOTS


def asked_for(bits: bytes, before: str, word: str) -> bool:
    slot = slot_of(before, word)
    return bool(bits[slot >> 3] >> (slot & 7) & 1)


def with_likelihood(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """asked (before, word) with the likelihood that a text may end there: `EndingModel.likelihood` over counted tables."""
    one = counts.filter("before is null").select("word", F.col("n").alias("n1"), F.col("ends").alias("e1"))
    two = counts.filter("before is not null").select("before", "word", F.col("n").alias("n2"), F.col("ends").alias("e2"))
    pairs = asked.select("before", "word").distinct().join(one, "word", "left").join(two, ["before", "word"], "left")
    backoff = (F.col("e1") + 0.001) / (F.col("n1") + 0.01)
    seen = (F.coalesce("e2", F.lit(0)) + 3 * backoff) / (F.coalesce("n2", F.lit(0)) + 3)
    # Words that were never seen whole: the ends of the seen words against their other parts, the longest part that is common enough.
    unseen = pairs.filter("n1 is null").select("word").distinct()
    parts = unseen.select("word", F.explode(F.expr("transform(filter(array(4, 3, 2), n -> n <= length(word)), n -> substring(word, -n))")).alias("part"))
    every = one.select(F.expr("explode(flatten(transform(filter(array(2, 3, 4), n -> n <= length(word)), n -> transform(sequence(0, length(word) - n), i -> struct(substring(word, i + 1, n) as part, i = length(word) - n as tail)))))").alias("p"))
    sums = every.groupBy("p.part").agg(F.count("*").alias("k"), F.count_if("p.tail").alias("tails")).filter("k >= 3")
    best = parts.join(sums, "part").groupBy("word").agg(F.max_by(F.col("tails") / F.col("k"), F.length("part")).alias("whole"))
    starts = one.filter("length(word) > 1").select(F.explode(F.expr("transform(sequence(1, length(word) - 1), n -> left(word, n))")).alias("word"))
    best = best.join(starts, "word", "left_anti")  # an unseen word with which a longer one begins is cut
    guess = F.when(F.col("whole") > 0.5, 0.3 * F.col("whole")).otherwise(0.0)
    pairs = pairs.join(best, "word", "left").select("before", "word", F.when(F.col("n1").isNull(), guess).otherwise(seen).alias("likelihood"))
    return asked.join(pairs, ["before", "word"])


_JUDGES: dict[str, Judge] = {}


def broken_pairs(
    df: DataFrame, labelled: DataFrame, id_col: str = "response_id", messages_col: str = "messages", finish_col: str | None = "teacher_finish_reason",
    flag_col: str | None = "teacher_truncated", label_text: str = "text", label_col: str = "lang", label_id: str = "doc_id", train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(response_id, turn, defect): one row per defective pair; turn is the 0-based place of the user message.

    Null or empty `messages` and null elements have no pairs. Roles are compared without case and padding. A pair of
    which the question is null can be empty, truncated or a refusal. Of rows with the same id and turn the smallest
    defect stays. `labelled` holds texts with language labels.
    """
    sc = df.sparkSession.sparkContext
    finish = F.coalesce(F.lower(F.col(finish_col)) == "length", F.lit(False)) if finish_col else F.lit(False)
    flag = F.coalesce(F.col(flag_col).cast("boolean"), F.lit(False)) if flag_col else F.lit(False)
    rows = df.select(F.col(id_col).alias("response_id"), F.col(messages_col).alias("messages"), (finish | flag).alias("flagged")).filter("response_id is not null and size(messages) > 0")
    languages = langid.fit(labelled, label_text, label_col, label_id, train_rows)
    shared, key = sc.broadcast(languages), uuid.uuid4().hex
    schema = T.StructType([T.StructField("response_id", rows.schema["response_id"].dataType), T.StructField("turn", T.IntegerType()), T.StructField("defect", T.StringType()), T.StructField("before", T.StringType()), T.StructField("word", T.StringType()), T.StructField("least", T.DoubleType()), T.StructField("slot", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _JUDGES:
            _JUDGES.clear()
            _JUDGES[key] = Judge(shared.value)
        judge = _JUDGES[key]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                pairs, where = [], []
                for response, messages, flagged in zip(*(c.to_pylist() for c in part.columns)):
                    roles = [(m["role"] or "").strip().lower() if m else "" for m in messages]
                    for i, role in enumerate(roles):
                        if role == "user":
                            there = i + 1 < len(roles) and roles[i + 1] == "assistant"
                            pairs.append((messages[i]["content"], messages[i + 1]["content"] if there else None, there, bool(flagged) and i + 2 >= len(roles)))
                            where.append((response, i))
                kinds, unsure = judge.judged(pairs)
                hits: list[tuple] = []
                for i, ((response, turn), kind) in enumerate(zip(where, kinds)):
                    line, least = unsure.get(i, ("", 0.0))
                    asked = EndingModel.asked(line)
                    if isinstance(asked, tuple):
                        hits.append((response, turn, kind, *asked, least, slot_of(*asked)))
                    elif kind := "truncated" if asked < least else kind:
                        hits.append((response, turn, kind, None, None, None, None))
                columns = zip(*hits) if hits else [[]] * len(schema)
                types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    judged = checkpoint(rows.mapInArrow(run, schema))
    sure, unsure = judged.filter("word is null"), judged.filter("word is not null")
    bits = bytearray(SLOTS // 8)
    for slot in unsure.select("slot").distinct().toArrow().column(0).to_pylist():
        bits[slot >> 3] |= 1 << (slot & 7)
    counts = checkpoint(ending_counts(rows, bytes(bits)))
    decided = with_likelihood(unsure, counts).withColumn("defect", F.when(F.col("likelihood") < F.col("least"), "truncated").otherwise(F.col("defect")))
    both = sure.select("response_id", "turn", "defect").unionByName(decided.select("response_id", "turn", "defect")).filter("defect is not null")
    return both.groupBy("response_id", "turn").agg(F.min("defect").alias("defect"))
