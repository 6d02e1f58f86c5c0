"""Language identification with segmentation-marginalised unigrams.

The pieces are all those of a fixed public vocabulary file; only their probabilities per language are
learned. A word's probability is the sum over all its segmentations into pieces of the products of the
pieces' probabilities (a forward algorithm, in logarithms, so that no word underflows); a text's is the
product over its words. Words are counted once per language over all training texts; expectation-
maximisation re-estimates the piece probabilities from expected counts over the same lattice. What reaches
the driver is bounded by pieces x languages.

Texts are lower-cased, split at white space, and every word gets a leading space as in the vocabulary.
Corner cases: null texts and texts without a letter are ``und`` with score 0, as is everything when no
training row has a language; rows with a null language are not learned from; ties go to the language that
sorts first; repeated rows count as often as they occur. Learning from a long word holds two numbers for
each of its bytes. More than ``MOST_LANGUAGES`` languages are refused with an error.
"""

from __future__ import annotations

import base64
import functools
import math
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.runtime import drop, extend_batches, prepare, save

STEPS = 2
SMOOTH = 0.05
#: Bound of the dense table of pieces x languages.
MOST_LANGUAGES = 256
#: Distinct words, and bytes of text, that a worker holds at once.
MEMO_WORDS = 600_000
MEMO_BYTES = 64 << 20
#: Words of one length that go through the lattice together, and the length beyond which each goes alone.
CHUNK = 4_000
TOGETHER = 24
UNKNOWN = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_pieces(path: str) -> list[bytes]:
    """The pieces of the file, in its order; all 256 single bytes are among them."""
    with open(path, "rb") as lines:
        found = [base64.b64decode(x.split()[0]) for x in lines if x.strip()]
    known = set(found)
    return found + [bytes([b]) for b in range(256) if bytes([b]) not in known]


class Pieces(dict):
    """piece -> number, and the same by 64-bit hashes for whole arrays of strings (cuckoo hashing)."""

    SLOTS = 17
    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, found: list[bytes]) -> None:
        super().__init__((x, k) for k, x in enumerate(found))
        #: Length of the longest piece that a word can hold, and the same by the first three bytes.
        self.longest, self.reach = 1, {}
        for x in self:
            if not x[1:].strip() or x[1:].split() == [x[1:]]:
                self.longest = max(self.longest, len(x))
            if len(x) > 2:
                self.reach[x[:3]] = max(self.reach.get(x[:3], 0), len(x))
        self.keys_, self.numbers = np.zeros((2, 1 << self.SLOTS), np.uint64), np.full((2, 1 << self.SLOTS), len(self), np.int32)
        step, full = int(self.STEP), (1 << 64) - 1
        for x, k in self.items():
            h = 0
            for byte in x:
                h = (h + byte + 1) * step & full
            side = 0
            while True:  # whoever is pushed out moves to its place on the other side
                at = self._slot(h, side)
                h_, k_ = int(self.keys_[side, at]), int(self.numbers[side, at])
                self.keys_[side, at], self.numbers[side, at] = h, k
                if k_ == len(self):
                    break
                h, k, side = h_, k_, 1 - side

    def _slot(self, h, side: int):
        if isinstance(h, int):
            return (h >> 64 - self.SLOTS) if not side else (h >> 20) & ((1 << self.SLOTS) - 1)
        if not side:
            return (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        return ((h >> np.uint64(20)) & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the strings with these hashes; ``len(self)`` for those that are no piece."""
        a, b = self._slot(hashes, 0), self._slot(hashes, 1)
        other = np.where(self.keys_[1][b] == hashes, self.numbers[1][b], np.int32(len(self)))
        return np.where(self.keys_[0][a] == hashes, self.numbers[0][a], other)


@functools.lru_cache(maxsize=1)
def load_pieces(path: str) -> Pieces:
    """The pieces of a file, once a worker process."""
    return Pieces(read_pieces(path))


class Model:
    """``p[piece, language]``, and its logarithms."""

    def __init__(self, pieces: Pieces, p: np.ndarray) -> None:
        self.pieces, self.p, self.log_p = pieces, p, np.log(p)

    def _arcs(self, words: list[bytes], n: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """The pieces in words of ``n`` bytes: for every end, (start, rows of the words, pieces)."""
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        hashes, out = np.zeros((n, len(words)), np.uint64), []
        with np.errstate(over="ignore"):
            for j in range(n):
                first = max(0, j + 1 - self.pieces.longest)
                open_ = hashes[first : j + 1]
                open_ += letters[j]
                open_ *= Pieces.STEP
                found = self.pieces.find(open_)
                here = []
                for k in range(len(found)):
                    rows = np.nonzero(found[k] < len(self.pieces))[0]
                    if len(rows):
                        here.append((first + k, rows, found[k][rows]))
                out.append(here)
        return out

    def _word_arcs(self, word: bytes, i: int) -> list[tuple[int, int]]:
        """(end, piece) of the pieces that start at byte ``i`` of a word."""
        top, get = max(2, self.pieces.reach.get(word[i : i + 3], 0)), self.pieces.get
        ends = range(i + 1, min(len(word), i + top) + 1)
        return [(j, k) for j in ends if (k := get(word[i:j])) is not None]

    def _forward(self, arcs, n: int, width: int, log_p: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations of every beginning: (bytes + 1) x words x languages."""
        a = np.full((n + 1, width, log_p.shape[1]), -np.inf)
        a[0] = 0
        for j, here in enumerate(arcs, 1):
            for i, rows, ids in here:
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + log_p[ids])
        return a

    def long_word(self, word: bytes) -> np.ndarray:
        """log P of one word by itself; holds the last positions only."""
        ahead = {0: np.zeros(self.p.shape[1])}
        for i in range(len(word)):
            now = ahead.pop(i)
            for j, k in self._word_arcs(word, i):
                x = now + self.log_p[k]
                ahead[j] = np.logaddexp(ahead[j], x) if j in ahead else x
        return ahead[len(word)]

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """log P(word | language), summed over all segmentations."""
        out = np.empty((len(words), self.p.shape[1]))
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, rows in by.items():
            if n > TOGETHER:
                for k in rows:
                    out[k] = self.long_word(words[k])
                continue
            for at in range(0, len(rows), CHUNK):
                some = rows[at : at + CHUNK]
                out[some] = self._forward(self._arcs([words[k] for k in some], n), n, len(some), self.log_p)[n]
        return out

    def _expected_long(self, word: bytes, count: float, language: int, out: np.ndarray) -> None:
        log_p, n = self.log_p[:, language], len(word)
        a, b, add = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0], lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        for i in range(n):
            for j, k in self._word_arcs(word, i):
                x = a[i] + log_p[k]
                a[j] = x if a[j] == -math.inf else add(a[j], x)
        for i in range(n - 1, -1, -1):
            for j, k in self._word_arcs(word, i):
                x = b[j] + log_p[k]
                b[i] = x if b[i] == -math.inf else add(b[i], x)
                out[k] += count * math.exp(a[i] + x - a[n])

    def expected(self, counts: Counter, language: int) -> np.ndarray:
        """Expected number of uses of every piece in the counted words of one language."""
        out, by = np.zeros(len(self.p)), {}
        log_p = self.log_p[:, language : language + 1]
        for w, c in counts.items():
            if len(w) > TOGETHER:
                self._expected_long(w, c, language, out)
            else:
                by.setdefault(len(w), []).append((w, c))
        for n, got in by.items():
            for at in range(0, len(got), CHUNK):
                some = got[at : at + CHUNK]
                arcs, c = self._arcs([w for w, _ in some], n), np.array([k for _, k in some], float)
                a = self._forward(arcs, n, len(some), log_p)[:, :, 0]
                b = np.full_like(a, -np.inf)
                b[n] = -a[n]
                for j in range(n, 0, -1):
                    for i, rows, ids in arcs[j - 1]:
                        x = b[j, rows] + log_p[ids, 0]
                        b[i, rows] = np.logaddexp(b[i, rows], x)
                        out += np.bincount(ids, c[rows] * np.exp(a[i, rows] + x), len(out))
        return out


class _Numbers(dict):
    """word -> place in the table; a new word gets the next place and waits to be scored."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.waiting.append(word)
        return n


class _State:
    """Scores of the words that a worker process has met, for one model."""

    def __init__(self, path: str, p: np.ndarray) -> None:
        self.model = Model(load_pieces(path), p)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.bytes = _Numbers(), 0
        self.table = np.empty((1 << 16, self.model.p.shape[1]))

    def score(self, lists: list[list[bytes] | None]) -> list[np.ndarray | None]:
        """log P of each list of words, by language."""
        if len(self.numbers) > MEMO_WORDS or self.bytes > MEMO_BYTES:
            self.forget()
        ids = [np.fromiter(map(self.numbers.__getitem__, ws), np.int64, len(ws)) if ws else None for ws in lists]
        words, n = self.numbers.waiting, len(self.numbers)
        self.numbers.waiting = []
        while n > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        if words:
            self.bytes += sum(map(len, words))
            self.table[n - len(words) : n] = self.model.log_words(words)
        return [None if x is None else self.table[x].sum(0) for x in ids]


_states: dict[str, _State] = {}


def _state(token: str, path: str, p: np.ndarray) -> _State:
    if token not in _states:
        _states.clear()
        _states[token] = _State(path, p)
    return _states[token]


def text_words(text: str) -> list[bytes]:
    return [b" " + w for w in text.lower().encode().split()]


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, word, n`` over all ``rows(text, lang)``; words are combined in the task before the shuffle."""
    prepare(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        held: dict[str, Counter] = {}

        def settle():
            langs = [x for x, c in held.items() for _ in range(len(c))]
            words, n = [w for c in held.values() for w in c], [k for c in held.values() for k in c.values()]
            held.clear()
            for at in range(0, len(words), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(langs[cut], pa.string()), pa.array(words[cut], pa.binary()), pa.array(n[cut], pa.int64())], names=["lang", "word", "n"])

        size = 0
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(text_words(text))
                size += len(text)
            if sum(map(len, held.values())) > MEMO_WORDS or size > MEMO_BYTES:
                yield from settle()
                size = 0
        yield from settle()

    return rows.select("text", "lang").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, fold: Column, vocabulary: str | None = None, steps: int = STEPS) -> tuple[list[str], Model]:
    """Languages and their model, from all texts with a language for which ``fold`` holds."""
    path = vocabulary or default_vocabulary()
    pieces = load_pieces(path)
    counts = save(word_counts(docs.filter(fold & F.col("lang").isNotNull() & F.col("text").isNotNull())), "words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(steps if languages else 0):
        uses = _expected_counts(counts, path, languages, p)
        got = uses.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        c = np.full(p.shape, SMOOTH)
        c[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["uses"].to_numpy()
        p = c / c.sum(0)
    drop(counts)
    return languages, Model(pieces, p)


def _expected_counts(counts: DataFrame, path: str, languages: list[str], p: np.ndarray) -> DataFrame:
    """``lang, piece, uses`` of the counted words, one row a task for every piece that occurs."""
    shared = counts.sparkSession.sparkContext.broadcast(p)  # pieces x languages, whatever the size of the corpus
    number = {x: k for k, x in enumerate(languages)}

    def run(batches):
        import pyarrow as pa

        model, held = Model(load_pieces(path), shared.value), [Counter() for _ in languages]
        uses = np.zeros(shared.value.shape)

        def settle():
            for k, words in enumerate(held):
                if words:
                    uses[:, k] += model.expected(words, k)
                    words.clear()

        for batch in batches:
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held[number[lang]][word] += n
            if sum(map(len, held)) > MEMO_WORDS:
                settle()
        settle()
        piece, lang = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(uses[piece, lang])], names=["lang", "piece", "uses"]
        )

    return counts.select("lang", "word", "n").mapInArrow(run, "lang int, piece int, uses double")


def predict(docs: DataFrame, languages: list[str], model: Model, vocabulary: str | None = None) -> DataFrame:
    """Rows of ``docs`` as ``row`` with ``lang_pred`` and ``score``; one narrow pass over whole texts."""
    path = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(model.p)

    token = uuid.uuid4().hex

    def make():
        state = _state(token, path, shared.value)

        def work(texts):
            out = {"lang_pred": [], "score": []}
            lists = [text_words(t) if t and languages and any(map(str.isalpha, t)) else None for t in texts]
            for total in state.score(lists):
                if total is None:
                    out["lang_pred"].append(UNKNOWN)
                    out["score"].append(0.0)
                    continue
                k = int(total.argmax())
                out["lang_pred"].append(languages[k])
                out["score"].append(float(1 / np.exp(total - total[k]).sum()))
            return out

        return work

    return extend_batches(docs, ["text"], make, "lang_pred string, score double")
