"""Language posteriors from character n-grams (naive Bayes), with scripts as classes of their own.

The model is fitted on a bounded sample of labelled texts (`TRAIN_ROWS`, taken by a hash of the id, so that the sample
does not depend on partitioning); labels may be missing, wrong or spelled in several ways: after a first fit, texts that
the model assigns elsewhere are left out and the model is fitted again.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 3_000
#: The posterior from which a sentence tells its language.
SURE = 0.95
WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?。！？…\n\r\x85]+")
#: First code points of scripts that are told by their characters alone: class, from, to.
SCRIPTS = [("el", 0x370, 0x3FF), ("ru", 0x400, 0x52F), ("he", 0x590, 0x5FF), ("ar", 0x600, 0x6FF), ("hi", 0x900, 0x97F), ("th", 0xE00, 0xE7F), ("ja", 0x3040, 0x30FF), ("zh", 0x3400, 0x9FFF), ("ko", 0xAC00, 0xD7AF)]
#: Spellings of labels.
NAMES = {"english": "en", "eng": "en", "german": "de", "deutsch": "de", "deu": "de", "ger": "de", "french": "fr", "français": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "español": "es", "spa": "es", "castellano": "es"}


def label_of(raw: str | None) -> str | None:
    """The language of a label such as `en-US`, ` EN` or `english`."""
    if not raw or not raw.strip():
        return None
    x = raw.strip().lower()
    return NAMES.get(x, re.split(r"[-_]", x)[0][:3])


def script_of(word: str) -> str | None:
    if word.isascii():
        return None
    c = ord(word[0])
    for name, low, high in SCRIPTS:
        if low <= c <= high:
            return name
    return None


def sample_share(count: int, key: str, rows: int) -> Column:
    """A condition that holds for about `rows` of `count` rows, by a hash of their key."""
    share = min(1.0, rows / max(1, count))
    return F.pmod(F.xxhash64(F.lit(7), F.col(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))


class LanguageModel:
    def __init__(self, labelled: list[tuple[str, str]], smoothing: float = 0.3):
        self.smoothing = smoothing
        texts = [(label, WORD.findall(text.lower())) for label, text in labelled if text]
        texts = [(label, [w for w in words if not script_of(w)]) for label, words in texts]
        texts = [(label, words) for label, words in texts if len(words) >= 8]
        self._fit(texts)
        cleaned = [(label, words) for label, words in texts if self.langs[int(self.sums([words])[0].argmax())] == label]
        if cleaned and len(cleaned) < len(texts):
            self._fit(cleaned)

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)] + [w]

    def _fit(self, texts: list[tuple[str, list[str]]]) -> None:
        words: dict[str, Counter] = defaultdict(Counter)
        for label, ws in texts:
            words[label].update(ws)
        counts: dict[str, Counter] = {}
        for label, c in words.items():
            if label in {s[0] for s in SCRIPTS}:
                continue
            counts[label] = Counter()
            for w, n in c.items():
                for g in self.grams(w):
                    counts[label][g] += n
        self.trained = sorted(counts) or ["en"]
        kinds = len(set().union(*counts.values())) + 1 if counts else 1
        self.langs = self.trained + [s[0] for s in SCRIPTS]
        total = {x: sum(counts[x].values()) + self.smoothing * kinds for x in counts}
        seen = set().union(*counts.values()) if counts else set()
        a = self.smoothing
        self.gram = {g: np.array([np.log((counts[x][g] + a) / total[x]) if x in counts else 0.0 for x in self.trained], np.float32) for g in seen}
        self.forget()

    def forget(self) -> None:
        """Empty the store of word vectors, which only saves repeated work."""
        self.cache: dict[str, int] = {}
        self.words: list[str] = []
        self.table = np.zeros((1, len(self.langs)), np.float32)
        self.used = 0

    def _vector(self, word: str) -> np.ndarray:
        v = np.zeros(len(self.langs), np.float32)
        script = script_of(word)
        if script:
            v[self.langs.index(script)] = 4.0 * len(word)
            return v
        k = len(self.trained)
        for g in self.grams(word):
            if (x := self.gram.get(g)) is not None:
                v[:k] += x - x.max()
        v[:k] = np.maximum(v[:k], -8.0)
        v[k:] = -9.0
        return v

    def index(self, words: list[str]) -> list[int]:
        """Rows of the table of word vectors; new words are added, and an overfull table is begun anew by the caller."""
        cache = self.cache
        out = []
        for w in words:
            i = cache.get(w)
            if i is None:
                if self.used == len(self.table):
                    self.table = np.vstack([self.table, np.zeros((max(1024, len(self.table)), len(self.langs)), np.float32)])
                i = cache[w] = self.used
                self.table[i] = self._vector(w)
                self.words.append(w)
                self.used += 1
            out.append(i)
        return out

    def sums(self, lists: list[list[str]]) -> np.ndarray:
        """Summed log likelihoods of each list of lower-case words, one column per language."""
        if self.used > 500_000:
            self.forget()
        flat: list[int] = []
        ends = np.zeros(len(lists), np.int64)
        for i, words in enumerate(lists):
            flat += self.index(words)
            ends[i] = len(flat)
        out = np.zeros((len(lists), len(self.langs)), np.float64)
        if flat:
            out = self.sums_of(np.array(flat), ends)
        return out

    def sums_of(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sums of table rows flat[:ends[0]], flat[ends[0]:ends[1]] and so on."""
        sums = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(self.table[flat], axis=0, dtype=np.float64)])
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """Distribution over the languages of each text: posteriors of its sentences, weighted by their words; zeros if it has none."""
        sentences, owner, weights = [], [], []
        for t, text in enumerate(texts):
            for part in SENTENCE_END.split(text.lower()):
                words = WORD.findall(part)
                if words:
                    sentences.append(words)
                    owner.append(t)
                    weights.append(sum(1 if w.isascii() else max(1, len(w) // 2 if "぀" <= w[0] <= "鿿" else 1) for w in words))
        out = np.zeros((len(texts), len(self.langs)))
        if sentences:
            scores = self.sums(sentences)
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            sure = p.max(axis=1) >= SURE  # a sentence that could be in several languages says nothing
            np.add.at(out, owner, p * (sure * weights)[:, None])
            total = out.sum(axis=1, keepdims=True)
            out = np.divide(out, total, out=np.zeros_like(out), where=total > 0)
        return out


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model from about `rows` labelled texts of df; the labels are counted without reading the texts."""
    labelled = df.filter(F.col(label_col).isNotNull())
    taken = labelled.filter(sample_share(labelled.count(), id_col, rows) & F.col(text_col).isNotNull()).select(F.col(label_col).alias("l"), F.col(text_col).alias("t")).collect()
    return from_rows([(r.l, r.t) for r in taken])


def from_rows(rows: list[tuple[str, str]]) -> LanguageModel:
    """A model from (label as it is written, text), in whatever order."""
    return LanguageModel([(x, t) for label, t in sorted(rows) if (x := label_of(label))])
