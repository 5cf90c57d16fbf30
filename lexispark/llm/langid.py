"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces of the products of their probabilities, by the forward algorithm; a text's is the product over
its words, runs of letters in lower case. Words are scored once and remembered. Probabilities are learned by
expectation maximisation over the same segmentations (forward and backward), on at most FIT_ROWS rows of each language,
those of smallest hash; each language is fitted in a task of its own.

Letters that no piece covers have a probability of their own, FLOOR. The sum of a word of over LINEAR letters is taken of
logarithms, as its probability leaves the range of numbers; it is the same sum.

Defined results: a text that is null or has no letter gets "und" with score 1; a null doc_id is never held out, nor learned from;
rows that repeat an id are rows of their own; of languages that tie, the first by code point is predicted; a word or text of any
length is scored whole; an empty table gives no rows; without rows to learn from every text is "und"; more than
MOST_LANGUAGES languages to learn are refused; further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, columns, only, steps, strings

VOCABULARY = "piece_bpe_32k.model"
FIT_ROWS, ROUNDS = 400, 3
MOST_LANGUAGES = 500
LINEAR = 30
FLOOR = 1e-8
_MEMO_WORDS = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)
_MARK = "▁"  # begins a word, in the vocabulary and here


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of lower-case letters, with or without the mark of a word's beginning."""
    from sentencepiece import SentencePieceProcessor

    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    sp = SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p != _MARK and (q := p.removeprefix(_MARK)).isalpha() and q == q.lower())


class Lattice:
    """All pieces of many words. Positions are letters of mark + word; words are dealt with by length."""

    def __init__(self, pieces: list[str]):
        self.most = max(map(len, pieces), default=1)
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    @staticmethod
    def _key(piece: str) -> int:
        h = len(piece)
        for c in piece:
            h = (h * int(_BASE) + ord(c) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, words: list[str]) -> list[tuple[np.ndarray, dict]]:
        """For each length: places of its words, and {(start, end): piece of each word or -1}, without edges that no word has."""
        lengths = np.array([len(w) + 1 for w in words])
        out = []
        for n in np.unique(lengths).tolist():
            places = np.flatnonzero(lengths == n)
            code = np.frombuffer("".join(_MARK + words[i] for i in places).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(places), n).astype(np.uint64)
            code *= np.uint64(0x9E3779B97F4A7C15)
            found = {}
            for a in range(n):
                for b in range(a + 1, min(n, a + self.most) + 1):
                    h = np.full(len(places), b - a, np.uint64)
                    for k in range(a, b):
                        h = h * _BASE + code[:, k]
                    at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                    piece = np.where(self.keys[at] == h, self.order[at], -1)
                    if b == a + 1 or (piece >= 0).any():
                        found[a, b] = piece
            out.append((places, found))
        return out

    def ends(self, word: str) -> np.ndarray:
        """Of one word, letters x sizes: the piece of size k + 1 that ends with each letter of mark + word, -1 for a letter that is no piece, _NONE for nothing."""
        code = np.frombuffer((_MARK + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        n = len(code)
        out = np.full((n, min(n, self.most)), _NONE, np.int64)
        for size in range(1, out.shape[1] + 1):
            h = np.full(n - size + 1, size, np.uint64)
            for k in range(size):
                h = h * _BASE + code[k : n - size + 1 + k]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out[size - 1 :, size - 1] = np.where(self.keys[at] == h, self.order[at], -1 if size == 1 else _NONE)
        return out


def _forward(found: dict, n: int, probability: np.ndarray, words: int) -> np.ndarray:
    """Sums over segmentations of each word's first letters: (n + 1, words, languages). probability's last row is the floor's."""
    alpha = np.zeros((n + 1, words, probability.shape[1]))
    alpha[0] = 1
    for (a, b), piece in sorted(found.items(), key=lambda x: x[0][1]):
        own = probability[piece]
        if b > a + 1:
            own = own * (piece >= 0)[:, None]
        alpha[b] += alpha[a] * own
    return alpha


_NONE = -2


def _log_forward(ends: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over segmentations of a word's first letters: (letters + 1, languages). ends: Lattice.ends(word)."""
    out = np.zeros((len(ends) + 1, logs.shape[1]))
    for b, row in enumerate(ends, 1):
        size = np.flatnonzero(row != _NONE)
        each = out[b - 1 - size] + logs[row[size]]
        top = each.max(axis=0)
        out[b] = top + np.log(np.exp(each - top).sum(axis=0))
    return out


@dataclass(frozen=True)
class Model:
    """languages; pieces; probability (pieces + 1 x languages), whose last row is the floor's."""

    languages: tuple[str, ...]
    pieces: list[str]
    probability: np.ndarray


def fit_language(counts: dict[str, int], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of pieces, and of the floor, from a language's words with their numbers."""
    lattice = Lattice(pieces)
    short, long_ = (sorted(w for w in counts if (len(w) > LINEAR) == far) for far in (False, True))
    weight = np.array([counts[w] for w in short], float)
    groups = lattice.edges(short)
    far = [(float(counts[w]), lattice.ends(w)) for w in long_]
    probability = np.zeros(len(pieces) + 1)
    for places, found in groups:  # to begin with: every place of a piece counts
        for piece in found.values():
            np.add.at(probability, piece, weight[places] * (piece >= 0))
    for n, ends in far:
        np.add.at(probability, ends[ends >= 0], n)
    for step in range(rounds + 1):
        probability[-1] = 0
        probability[:-1] += 0.01  # a piece that a language doesn't show stays possible
        probability /= probability.sum()
        probability[-1] = FLOOR
        if step == rounds:
            return probability
        expected, column = np.zeros_like(probability), probability[:, None]
        for places, found in groups:
            n = max(b for _, b in found)
            alpha = _forward(found, n, column, len(places))[..., 0]
            beta = np.zeros_like(alpha)
            beta[n] = weight[places] / alpha[n]
            for (a, b), piece in sorted(found.items(), key=lambda x: -x[0][0]):
                own = probability[piece] * ((piece >= 0) | (b == a + 1))
                beta[a] += own * beta[b]
                np.add.at(expected, piece, alpha[a] * own * beta[b])
        logs = np.log(column)
        for n, ends in far:
            alpha = _log_forward(ends, logs)[:, 0]
            beta = np.full(len(ends) + 1, -np.inf)
            beta[-1] = 0
            for b in range(len(ends), 0, -1):
                size = np.flatnonzero(ends[b - 1] != _NONE)
                piece, at = ends[b - 1][size], b - 1 - size
                beta[at] = np.logaddexp(beta[at], logs[piece, 0] + beta[b])
                np.add.at(expected, piece, n * np.exp(alpha[at] + logs[piece, 0] + beta[b] - alpha[-1]))
        probability = expected
    raise AssertionError


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """counts: for each language its words with their numbers."""
    languages = tuple(sorted(counts))
    found = [fit_language(counts[x], pieces, rounds) for x in languages]
    return Model(languages, pieces, np.stack(found, axis=1) if found else np.zeros((len(pieces) + 1, 0)))


class Scorer:
    """Scores texts, remembering words."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.log_probability = np.log(np.maximum(model.probability, 1e-300))
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.model.languages)))

    def _learn(self, new: list[str]) -> None:
        base = len(self.words) - len(new)
        if len(self.words) > len(self.logs):
            grown = np.zeros((max(len(self.words), 2 * len(self.logs)), self.logs.shape[1]))
            grown[:base] = self.logs[:base]
            self.logs = grown
        short = [i for i, w in enumerate(new) if len(w) <= LINEAR]
        place = base + np.array(short, np.int64)
        for places, found in self.lattice.edges([new[i] for i in short]):
            n = max(b for _, b in found)
            self.logs[place[places]] = np.log(_forward(found, n, self.model.probability, len(places))[n])
        for i, w in enumerate(new):
            if len(w) > LINEAR:
                self.logs[base + i] = _log_forward(self.lattice.ends(w), self.log_probability)[-1]

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, and its share of the probability."""
        if len(self.words) > _MEMO_WORDS:
            self._forget()
        flat: list[int] = []
        counts = []
        known, new = self.words, []
        for t in texts:
            before = len(flat)
            for w in words_of(t):
                n = known.get(w)
                if n is None:
                    n = known[w] = len(known)
                    new.append(w)
                flat.append(n)
            counts.append(len(flat) - before)
        if new:
            self._learn(new)
        at, owner = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), counts)
        letters = np.bincount(owner, minlength=len(texts)) > 0
        names = self.model.languages
        if not names:
            return ["und"] * len(texts), [1.0] * len(texts)
        total = np.stack([np.bincount(owner, self.logs[at, k], len(texts)) for k in range(len(names))], axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [names[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())], [float(share[i, k]) if letters[i] else 1.0 for i, k in enumerate(best.tolist())]


_WORDS = "lang string, word string, n long"


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case, that have a letter (marks that count as such to the expression aren't)."""
    return [w for w in _LETTERS.findall(text.lower()) if any(map(str.isalpha, w))]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "text"):
        counts: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), strings(b.column("text"))):
            for w in words_of(text):
                counts[lang, w] += 1
        yield batch(_WORDS, [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())])


def sample(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, text, lang) without nulls, the FIT_ROWS of smallest hash in each language.

    Rows are first cut by the power of two below their hash, at the power that leaves enough of a language's rows, a few
    times FIT_ROWS; so no task gets all rows of a language.
    """
    key = F.xxhash64(F.lit(5), "doc_id").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    rows = rows.withColumn("key", key).withColumn("level", F.floor(F.log2(F.col("key") + 1.0)))
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    levels = sorted(map(tuple, rows.groupBy("lang", "level").agg(F.count("*")).collect()))
    cut, seen = {}, Counter()
    for lang, level, n in levels:
        if seen[lang] < FIT_ROWS:
            cut[lang] = level
        seen[lang] += n
    few = rows.join(F.broadcast(rows.sparkSession.createDataFrame([*cut.items()], "lang string, most long")), "lang").filter("level <= most")
    by = Window.partitionBy("lang").orderBy("key", "doc_id", F.xxhash64("text"), "text")
    return few.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= FIT_ROWS).select("doc_id", "lang", "text")


def fit_model(docs: DataFrame, vocabulary_path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of docs' rows with an id, a text and a language."""
    rows = columns(docs, doc_id=(id_col, None), text=(text_col, None), lang=(lang_col, "string")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counted = sample(rows).mapInArrow(_words, _WORDS).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pieces = vocabulary(vocabulary_path)

    def run(table: pa.Table) -> pa.Table:
        counts = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
        return pa.table({"lang": table.column("lang").slice(0, 1), "probability": pa.array([fit_language(counts, pieces).tobytes()], pa.binary())})

    found = sorted((r["lang"], bytes(r["probability"])) for r in counted.groupBy("lang").applyInArrow(run, "lang string, probability binary").collect())
    return Model(tuple(x for x, _ in found), pieces, np.stack([np.frombuffer(p) for _, p in found], axis=1) if found else np.zeros((len(pieces) + 1, 0)))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: the checksum of its id leaves 2 by 4. Without an id it isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict_held_out(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, by a model of those not held out."""
    plain = columns(docs, doc_id=("doc_id", None), text=("text", None), lang=("lang", None))
    model = fit_model(plain.filter(~held_out(F.col("doc_id"))))
    return predict(plain, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_PREDICTED = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score. Of docs only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        scorer = Scorer(model)
        for b in steps(batches, 1):
            yield batch(_PREDICTED, [b.column(0), *scorer.score(strings(b.column(1)))])

    return columns(docs, doc_id=(id_col, "long"), text=(text_col, None)).mapInArrow(run, _PREDICTED)
