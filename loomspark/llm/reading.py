"""Reading level of documents: sentence classifier, then a calibrated document classifier.

Running prose is taken from a text (no code, logs, tables, formulas, headings), cut into sentences, and every sentence
gets a distribution over the levels from a multinomial logistic model, L2-regularised, over the means of its words' word
and character n-gram features and over features of its build (length, commas, subordinators, repeated joins). The
sentence distributions of a document, weighted by their words, are aggregated into a few numbers which a second, equally
regularised logistic model maps to the level; it is fitted on distributions from sentence models that did not see the
document (cross-fitting), which calibrates it.

Both models are fitted on at most `TRAIN_DOCS` rated documents (a bound, chosen by a hash of the id); repeated ratings
count each on its own. The models are broadcast (fixed size). The pass over the corpus is narrow.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm import langid

TRAIN_DOCS = 1_500
LEVELS = (1, 2, 3, 4)
MIN_WORDS = 40
HASHED = 1 << 15
#: Log odds of another language over English from which a sentence counts as foreign.
FOREIGN = 3.0
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"<[^<>\n]{1,80}>")
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$|\\\[.*?\\\]|\\[A-Za-z]+(?:\{[^{}\n]*\})*", re.S)
_LABEL = re.compile(r"^\s*(?:[-*+•>]\s+|\d+[.)]\s+)*(?:(?:Step \d+|Question|Answer|Note|Q|A)\s*[.:]\s+)?")
_CODE_LINE = re.compile(r"^\s*(?:def |class |import |from \S+ import|return\b|for .*:$|while .*:$|if .*:$|else:|elif |print\(|#include|public |private |var |let |const |function |\w+ [-+*/]?= |\w+\(.*\)[;:]?$|[{}\[\]();]+$|\S+ ?[-+*/]?= ?\S+;?$)")
_LOG_LINE = re.compile(r"(?:\S+[:=]-?\d[\d.e+-]*\s*(?:[-|,;]\s*)?){2,}|^\s*\[?\d{4}-\d\d-\d\d|^\s*(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b|^\s*(?:step|epoch|iter)\s*[:=]?\s*\d")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”’)]*\s+")
#: Words that open subordinate clauses or join clauses.
_SUB = {"which", "that", "whose", "whereas", "although", "because", "since", "if", "when", "whenever", "whether", "while", "unless", "insofar", "notwithstanding", "albeit", "than", "then", "so", "whom", "though"}
_JOIN = {"and", "so", "but", "or"}
_BUILD = 24


def prose_lines(text: str) -> tuple[list[str], int, int]:
    """(paragraphs of running prose, their words, words or tokens in code and log lines)."""
    other = 0
    for block in _FENCE.findall(text):
        other += len(block.split())
    text = _FENCE.sub("\n\n", text)
    paragraphs: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now:
            joined = " ".join(now)
            now.clear()
            paragraphs.append(joined)

    for raw in re.split(r"[\n\r\x85 ]", text):
        line = raw.strip()
        if not line:
            close()
            continue
        plain = line[0].isupper() and "=" not in line and "(" not in line and ":" not in line  # surely no code or log
        if not plain and (_LOG_LINE.search(line) or _CODE_LINE.match(raw)):
            other += len(line.split())
            close()
            continue
        if line[0] in "#=|" or line.startswith(("---", "<h", "***")):
            close()
            continue
        marked = _LABEL.match(line)
        if marked and marked.end():
            if line[0] != ">" or not now:
                close()
            line = line[marked.end() :]
        now.append(line)
    close()
    out, words = [], 0
    for p in paragraphs:
        p = re.sub(r"(\w)[-‐] (?=[a-z])", r"\1", p) if "- " in p or "‐ " in p else p
        if "<" in p:
            p = _TAG.sub(" ", p)
        if "$" in p or "\\" in p:
            p = _MATH.sub(" ", p)
        p = p.replace("**", "").replace("_", "")
        n = p.count(" ") + 1
        if n >= 4 and (p.rstrip()[-1:] in ".!?\"”)’:;,…" or n >= 12):
            out.append(p)
            words += n
    return out, words, other


def sentences(text: str | None) -> tuple[list[tuple[str, list[str]]], int]:
    """The prose sentences of a text with their lower-case words, and the size of its code and logs."""
    if not text:
        return [], 0
    paragraphs, _, other = prose_lines(text)
    out = []
    for p in paragraphs:
        for s in _SENTENCE.split(p.lower()):
            words = _WORD.findall(s)
            if words:
                out.append((s, words))
    return out, other


def assemble(n: np.ndarray, commas: np.ndarray, subs: np.ndarray, joins: np.ndarray, mean: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Features of how sentences are built, from their words, commas, subordinators, joins and word lengths."""
    f = np.zeros((len(n), _BUILD), np.float32)
    f[:, 0] = 1.0
    f[:, 1] = np.minimum(n, 60) / 20
    f[:, 2] = np.log1p(n) / 3
    f[:, 3] = np.minimum(commas, 6) / 3
    f[:, 4] = np.minimum(subs, 5) / 2
    f[:, 5] = np.minimum(joins, 5) / 2
    f[:, 6] = mean / 6
    f[:, 7] = longest / 12
    rows = np.arange(len(n))
    f[rows, 8 + np.minimum(n // 6, 7)] = 0.7
    f[rows, 16 + np.minimum(mean.astype(int), 7)] = 0.7
    return f


def traits(word: str) -> tuple[float, float, float]:
    """Length, subordinator, join."""
    return len(word), word in _SUB, word in _JOIN


def build(docs: list[list[tuple[str, list[str]]]]) -> np.ndarray:
    """The features of all sentences of some documents."""
    flat = np.array([traits(w) for doc in docs for _, words in doc for w in words], float)
    sizes = np.array([len(words) for doc in docs for _, words in doc])
    return built_of([s for doc in docs for s, _ in doc], flat, sizes) if len(sizes) else np.zeros((0, _BUILD), np.float32)


def built_of(texts: list[str], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same from the traits of the words of all sentences, one after the other."""
    starts = np.cumsum(sizes) - sizes
    sums = np.add.reduceat(flat, starts)
    return assemble(sizes, np.array([s.count(",") for s in texts]), sums[:, 1], sums[:, 2], sums[:, 0] / sizes, np.maximum.reduceat(flat[:, 0], starts))


class WordTable:
    """Hashed word and character features of words; a sentence has the mean over its words."""

    def __init__(self) -> None:
        self.cache: dict[str, np.ndarray] = {}

    @staticmethod
    def features(word: str) -> list[int]:
        w = f"^{word}$"
        grams = [w[i : i + 3] for i in range(len(w) - 2)] + [w[i : i + 4] for i in range(len(w) - 3)] + [f"={word}"]
        return [zlib.crc32(g.encode()) % HASHED for g in grams]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 300) -> np.ndarray:
    """A dense multinomial logistic model by accelerated gradient descent."""
    n, d = x.shape
    w = v = np.zeros((d, len(LEVELS)))
    target = np.eye(len(LEVELS))[y]
    rate = 1.0 / (0.5 * np.linalg.norm(x.T @ (x * weight[:, None]) / weight.sum(), 2) + l2)
    for t in range(steps):
        g = x.T @ ((_softmax(x @ v) - target) * weight[:, None]) / weight.sum() + l2 * v
        new = v - rate * g
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


class SentenceModel:
    """Word and character weights (hashed) and build weights for each level."""

    def __init__(self, data: list[tuple[list[tuple[str, list[str]]], int]], l2: float = 2e-4, steps: int = 80):
        vocabulary: dict[str, int] = {}
        flat, ends, labels, weights = [], [], [], []
        for doc, level in data:
            for _, words in doc:
                flat += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                ends.append(len(flat))
                labels.append(level - 1)
                weights.append(min(len(words), 30) / max(1, sum(min(len(w), 30) for _, w in doc)))
        self.weights = np.zeros((HASHED, len(LEVELS)))
        self.build = np.zeros((_BUILD, len(LEVELS)))
        if not ends:
            return
        words = sorted(vocabulary, key=vocabulary.__getitem__)
        lists = [WordTable.features(w) for w in words]
        sizes = np.array([len(x) for x in lists])
        index = np.concatenate([np.array(x) for x in lists])
        word_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        scale = 1.0 / np.sqrt(sizes)
        flat, ends = np.array(flat), np.array(ends)
        starts = np.concatenate([[0], ends[:-1]])
        count = (ends - starts).astype(float)
        owner = np.repeat(np.arange(len(ends)), ends - starts)
        b, weight = build([doc for doc, _ in data]).astype(float), np.array(weights)
        target = np.eye(len(LEVELS))[np.array(labels)]
        weight = weight / weight.sum()
        word_owner = np.repeat(np.arange(len(words)), sizes)
        w, u = np.zeros_like(self.weights), np.zeros_like(self.build)
        gw, gu = np.full_like(w, 1e-8), np.full_like(u, 1e-8)
        for _ in range(steps):  # Adagrad on the full batch
            vec = np.add.reduceat(w[index], word_starts) * scale[:, None]
            z = np.add.reduceat(vec[flat], starts) / count[:, None] * 4 + b @ u
            r = (_softmax(z) - target) * weight[:, None]
            spread = (r / count[:, None] * 4)[owner]
            g_vec = np.stack([np.bincount(flat, spread[:, k], len(words)) for k in range(len(LEVELS))], 1) * scale[:, None]
            g = np.stack([np.bincount(index, g_vec[word_owner, k], HASHED) for k in range(len(LEVELS))], 1) + l2 * w
            h = b.T @ r + l2 * u
            gw += g * g
            gu += h * h
            w = w - 0.5 * g / np.sqrt(gw)
            u = u - 0.5 * h / np.sqrt(gu)
        self.weights, self.build = w, u

    def vector(self, word: str) -> np.ndarray:
        f = WordTable.features(word)
        return self.weights[f].sum(axis=0) / np.sqrt(len(f))

    def distributions(self, docs: list[list[tuple[str, list[str]]]]) -> list[np.ndarray]:
        """Per document the level distributions of its sentences."""
        seen: dict[str, int] = {}
        flat = [seen.setdefault(w, len(seen)) for doc in docs for _, words in doc for w in words]
        ends = np.cumsum([len(words) for doc in docs for _, words in doc])
        table = np.stack([self.vector(w) for w in seen]) if seen else np.zeros((0, len(LEVELS)))
        return self.distributions_of(docs, table, np.array(flat, np.int64), ends, build(docs))

    def distributions_of(self, docs: list[list[tuple[str, list[str]]]], table: np.ndarray, flat: np.ndarray, ends: np.ndarray, built: np.ndarray) -> list[np.ndarray]:
        """The same from rows of a table of word vectors: flat[:ends[0]] are those of the first sentence, and so on."""
        if not len(ends):
            return [np.zeros((0, len(LEVELS))) for _ in docs]
        starts = np.concatenate([[0], ends[:-1]])
        p = _softmax(np.add.reduceat(table[flat], starts) / (ends - starts)[:, None] * 4 + built @ self.build)
        out, at = [], 0
        for doc in docs:
            out.append(p[at : at + len(doc)])
            at += len(doc)
        return out


def aggregate(doc: list[tuple[str, list[str]]], p: np.ndarray) -> np.ndarray:
    """A document's numbers from its sentences' distributions."""
    n = np.array([len(w) for _, w in doc], float)
    share = n / n.sum()
    mean = share @ p
    top = np.zeros(len(LEVELS))
    np.add.at(top, p.argmax(axis=1), share)
    log = share @ np.log(np.maximum(p, 1e-4))
    return np.concatenate([[1.0], mean * 3, top * 3, log - log.max()])


class DocumentModel:
    def __init__(self, data: list[tuple[list[tuple[str, list[str]]], int]], folds: int = 3):
        data = [(doc, level) for doc, level in data if doc and level in LEVELS]
        self.sentences = SentenceModel(data)
        self.weights = None
        levels = np.array([level for _, level in data])
        if len(data) < 8 * folds or len(set(levels.tolist())) < 2:
            return
        rows = np.zeros((len(data), 1 + 3 * len(LEVELS)))
        groups: dict[int, int] = {}  # equal texts stay together
        fold = np.array([groups.setdefault(zlib.crc32("\n".join(s for s, _ in doc).encode()), len(groups)) % folds for doc, _ in data])
        for k in range(folds):
            model = SentenceModel([x for x, f in zip(data, fold) if f != k])
            held = np.flatnonzero(fold == k)
            for i, p in zip(held, model.distributions([data[i][0] for i in held])):
                rows[i] = aggregate(data[i][0], p)
        self.weights = fit_logistic(rows, levels - 1, np.ones(len(rows)), 3e-3)

    def levels(self, docs: list[list[tuple[str, list[str]]]], p: list[np.ndarray] | None = None) -> list[int]:
        p = self.sentences.distributions(docs) if p is None else p
        rows = np.stack([aggregate(d, x) for d, x in zip(docs, p)]) if docs else np.zeros((0, 1 + 3 * len(LEVELS)))
        z = rows @ self.weights if self.weights is not None else rows[:, 1 : 1 + len(LEVELS)]
        return [int(LEVELS[k]) for k in z.argmax(axis=1)]


def english_prose(docs: list[list[tuple[str, list[str]]]], languages: langid.LanguageModel) -> list[list[tuple[str, list[str]]]]:
    """The sentences of each document that are not surely in another language than English."""
    flat = [words for doc in docs for _, words in doc]
    scores = languages.sums(flat)
    out, at = [], 0
    en = languages.langs.index("en")
    if len(scores):
        other = np.delete(scores, en, axis=1).max(axis=1) - scores[:, en]
    for doc in docs:
        out.append([s for k, s in enumerate(doc) if other[at + k] < FOREIGN])
        at += len(doc)
    return out


class Reader:
    """Both models over one store of words."""

    def __init__(self, model: DocumentModel, languages: langid.LanguageModel):
        self.model, self.languages = model, languages
        self.table = np.zeros((0, len(LEVELS)), np.float32)
        self.traits = np.zeros((0, 3), np.float32)

    def read(self, texts: list[str | None]) -> list[int | None]:
        """The level of each text; None where there is none."""
        lang = self.languages
        if lang.used > 500_000:
            lang.forget()
            self.table, self.traits = self.table[:0], self.traits[:0]
        found = [sentences(t) for t in texts]
        out: list[int | None] = [None] * len(texts)
        ids: list[int] = []
        for doc, _ in found:
            for _, words in doc:
                ids += lang.index(words)
        if not ids:
            return out
        if len(self.table) < lang.used:
            fresh = lang.words[len(self.table) :]
            self.table = np.vstack([self.table, np.stack([self.model.sentences.vector(w) for w in fresh]).astype(np.float32)])
            self.traits = np.vstack([self.traits, np.array([traits(w) for w in fresh], np.float32)])
        flat = np.array(ids)
        sizes = np.array([len(words) for doc, _ in found for _, words in doc])
        owner = np.repeat(np.arange(len(found)), [len(doc) for doc, _ in found])
        scores = lang.sums_of(flat, np.cumsum(sizes))
        en = lang.langs.index("en")
        english = np.delete(scores, en, axis=1).max(axis=1) - scores[:, en] < FOREIGN
        prose = np.bincount(owner, sizes * english, len(found))
        good = (prose >= MIN_WORDS) & (prose >= [other for _, other in found])
        keep = english & good[owner]
        picked = [i for i in range(len(found)) if good[i]]
        docs, at = [], 0
        for i, (doc, _) in enumerate(found):
            if good[i]:
                docs.append([s for k, s in enumerate(doc) if keep[at + k]])
            at += len(doc)
        if not docs:
            return out
        kept = flat[np.repeat(keep, sizes)]
        built = built_of([s for doc in docs for s, _ in doc], self.traits[kept], sizes[keep])
        p = self.model.sentences.distributions_of(docs, self.table, kept, np.cumsum(sizes[keep]), built)
        for i, level in zip(picked, self.model.levels(docs, p)):
            out[i] = level
        return out


_READERS: dict[str, Reader] = {}


def reading_levels(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level_col: str = "reading_level", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, reading_level) of every document with at least 40 words of English prose that is not mainly code or logs.

    Null, empty and other texts give no row; repeated rows give one row each for a distinct id. Without usable ratings
    no level can be learned and the result is empty. Texts of any length are read whole.
    """
    sc = df.sparkSession.sparkContext
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    rated = labels.select(F.col(id_col).alias("doc_id"), F.col(level_col).cast("int").alias("level")).filter("doc_id is not null and level is not null")
    rated = rated.filter(langid.sample_share(rated.count(), "doc_id", train_docs)).groupBy("doc_id").agg(F.collect_list("level").alias("levels"))
    # One pass over the texts fetches what both models learn from: the languages are counted without reading the texts.
    lang = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sampled = F.col("lang").isNotNull() & langid.sample_share(lang.filter("lang is not null").count(), "doc_id", langid.TRAIN_ROWS)
    rows = lang.filter("text is not null").join(F.broadcast(rated), "doc_id", "left").withColumn("sampled", F.coalesce(sampled, F.lit(False))).filter("sampled or levels is not null").collect()
    train = sorted((r.text, level) for r in rows for level in r.levels or [])
    languages = langid.from_rows([(r.lang, r.text) for r in rows if r.sampled])
    if "en" not in languages.langs:
        languages = langid.LanguageModel([("en", t) for t, _ in train])
    kept = english_prose([sentences(t)[0] for t, _ in train], languages)
    model = DocumentModel([(doc, level) for doc, (_, level) in zip(kept, train)])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("reading_level", T.IntegerType())])
    if not train:
        return df.sparkSession.createDataFrame([], schema)
    languages.forget()
    shared, key = sc.broadcast((model, languages)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READERS:
            _READERS.clear()
            _READERS[key] = Reader(*shared.value)
        reader = _READERS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hits = [(i, level) for i, level in zip(part.column(0).to_pylist(), reader.read(part.column(1).to_pylist())) if level is not None]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], batch.schema.field(0).type), pa.array([h[1] for h in hits], pa.int32())], ["doc_id", "reading_level"])

    return docs.mapInArrow(run, schema).groupBy("doc_id").agg(F.min("reading_level").alias("reading_level"))
