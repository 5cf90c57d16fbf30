"""Quality rules: content and boilerplate lines by a linear-chain conditional random field.

A text's lines are a sequence. Features of each line, and weights of pairs of neighbouring labels, give the likeliest
labels by Viterbi decoding; a text whose content lines hold at least CONTENT_SHARE of its words is kept, unless a base rule
rejects it. The field is fitted here, by gradient ascent on the exact likelihood (forward-backward), on the lines of at
most FIT_ROWS documents of each label, those of smallest hash. Labels are of documents; lines get theirs from texts with
runs of bad documents' lines spliced into them, see learn().

Base rules reject texts of fewer than MIN_WORDS words, or with over MAX_REPEAT % of words in five-word windows that occur
twice or more.

Defined results: a null text has no words and is not kept; rows that repeat an id are rows of their own; an empty table gives
no rows; further columns, whatever their names, are kept by keep_content() and ignored elsewhere. Without labels of both
kinds every line counts as content. Of labellings that tie, a line before another is rather boilerplate, and the last line
too. A text of any length is decoded whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, columns, only, place_of, release, split_words, steps, strings, utf8

MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
CONTENT_SHARE = 0.5
FIT_ROWS = 400
CONTENT_WEIGHT = 0.7
#: Lines of a sequence that training looks at in one go; longer texts are several sequences there, decoding takes them whole.
FIT_LINES = 64
SYMBOLS = "#*$%&|<>"
FEATURES = ("one", "length", "letters", "capitals", "symbols", "calls", "digits", "distinct", "commonest", "closed", "word length", "opens", "repeated", "first", "last")


def _classes() -> np.ndarray:
    """Bits of each BMP code point: letter 1, upper case 2, digit 4, one of SYMBOLS 8, "!" 16, white space 32."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        out[c] = s.isalpha() | s.isupper() << 1 | s.isdigit() << 2 | (s in SYMBOLS) << 3 | (s == "!") << 4
    out[[9, 10, 11, 12, 13, 32]] |= 32
    return out


_CLASSES: list[np.ndarray] = []


@dataclass
class Lines:
    """A chunk of texts: features of the lines with a word, the text and the number of words of each."""

    doc: np.ndarray
    words: np.ndarray
    features: np.ndarray
    word_chars: np.ndarray  # from here on by text
    symbols: np.ndarray
    dup_lines: np.ndarray


def read_lines(texts: list[str]) -> Lines:
    if not _CLASSES:
        _CLASSES.append(_classes())
    lines, doc, n_words, by_words, flags = [], [], [], [], []
    dup_lines = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = [(line, w) for line in t.split("\n") if (w := split_words(utf8(line)))]
        seen: set[str] = set()
        for k, (line, w) in enumerate(own):
            again = line in seen
            seen.add(line)
            dup_lines[i] += again
            lines.append(line)
            doc.append(i)
            n_words.append(len(w))
            top = max(Counter(w).values())
            by_words.append((min(1.0, len(set(w)) / min(len(w), 30)), top / len(w) if len(w) > 1 else 0.0))
            flags.append((line.rstrip()[-1:] in ".?!:;\"”»…", line.lstrip()[:1].isupper(), again, k == 0, k == len(own) - 1))
    code = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) if lines else np.empty(0, np.uint32)
    kind = _CLASSES[0][np.minimum(code, 0xFFFF)]
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines[:-1]]))).astype(np.int64) if lines else np.empty(0, np.int64)
    count = lambda bit: np.add.reduceat(((kind & bit) > 0).astype(np.int64), starts) if len(lines) else np.empty(0, np.int64)
    doc_, words = np.array(doc, np.int64), np.array(n_words, np.int64)
    size = np.array([len(x) for x in lines], np.int64)
    blank = count(32)
    if len(lines):
        blank[:-1] -= 1  # the line ends put between lines
    solid = np.maximum(1, size - blank)
    letters, symbols = count(1), count(8)
    ratio = np.array(by_words, float).reshape(-1, 2)
    flag = np.array(flags, float).reshape(-1, 5)
    features = np.column_stack((
        np.ones(len(lines)), np.minimum(1, words / 20), letters / solid, count(2) / np.maximum(1, letters), np.minimum(1, 5 * symbols / solid), np.minimum(1, 5 * count(16) / solid), count(4) / solid,
        ratio[:, 0], ratio[:, 1], flag[:, 0], np.minimum(1, solid / np.maximum(1, words) / 12), flag[:, 1], flag[:, 2], flag[:, 3], flag[:, 4],
    ))
    n = len(texts)
    # lines without a word have neither words nor, as they are white space, symbols
    return Lines(doc_, words, features, np.bincount(doc_, size - blank, n).astype(np.int64), np.bincount(doc_, symbols, n).astype(np.int64), dup_lines)


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more. Equal hashes only name the windows to compare."""
    if len(words) <= WINDOW:
        return 0
    h = np.array(list(map(hash, words)), np.int64).astype(np.uint64)
    m = len(words) - WINDOW + 1
    mixed = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order][1:] == mixed[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    places = np.flatnonzero(twice).tolist()
    windows = [tuple(words[p : p + WINDOW]) for p in places]
    counts = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for p, w in zip(places, windows):
        if counts[w] > 1:
            covered[p] += 1
            covered[p + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


@dataclass(frozen=True)
class Field:
    """Weights of the features for "content" against "boilerplate", and of neighbouring labels (rows: the earlier; 1 is content)."""

    weights: tuple[float, ...]
    pairs: tuple[tuple[float, float], tuple[float, float]]


ALL_CONTENT = Field((1.0, *[0.0] * (len(FEATURES) - 1)), ((0.0, 0.0), (0.0, 0.0)))


def viterbi(scores: list[float], pairs) -> list[int]:
    """The likeliest labels of a sequence, where scores are for content against boilerplate."""
    (bb, bc), (cb, cc) = pairs
    b, c = 0.0, scores[0]
    back = []
    for s in scores[1:]:
        from_b, from_c = b + bb >= c + cb, b + bc >= c + cc
        back.append((0 if from_b else 1, 0 if from_c else 1))
        b, c = (b + bb if from_b else c + cb), (b + bc if from_c else c + cc) + s
    out = [int(c > b)]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> Field:
    """sequences: features (lines x FEATURES) with each line's label. Exact likelihood, Adam."""
    cut = [(f[a : a + FIT_LINES], y[a : a + FIT_LINES]) for f, y in sequences for a in range(0, len(f), FIT_LINES)]
    if len({k for _, y in cut for k in set(y.tolist())}) < 2:
        return ALL_CONTENT
    n, m, width = len(cut), max(len(f) for f, _ in cut), len(FEATURES)
    x, mask, label = np.zeros((n, m, width)), np.zeros((n, m), bool), np.zeros((n, m), np.int64)
    for i, (f, y) in enumerate(cut):
        x[i, : len(f)], mask[i, : len(f)], label[i, : len(f)] = f, True, y
    # a label's lines weigh the same in all, however many there are, but for CONTENT_WEIGHT: losing a clean text costs more;
    # a sequence has the mean weight of its lines
    each = np.where(label == 1, CONTENT_WEIGHT / mask[label == 1].sum(), (1 - CONTENT_WEIGHT) / max(1, (mask & (label == 0)).sum()))
    share = (each * mask).sum(axis=1) / mask.sum(axis=1)
    theta, first, second = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, steps + 1):
        pairs = theta[width:].reshape(2, 2)
        node = np.zeros((n, m, 2))
        node[..., 1] = x @ theta[:width]
        forward, backward = np.zeros((n, m, 2)), np.zeros((n, m, 2))
        forward[:, 0] = node[:, 0]
        for t in range(1, m):
            now = np.logaddexp(forward[:, t - 1, :1] + pairs[0], forward[:, t - 1, 1:] + pairs[1]) + node[:, t]
            forward[:, t] = np.where(mask[:, t, None], now, forward[:, t - 1])
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(m - 2, -1, -1):
            onward = node[:, t + 1] + backward[:, t + 1]
            now = np.logaddexp(pairs[:, 0] + onward[:, :1], pairs[:, 1] + onward[:, 1:])
            backward[:, t] = np.where(mask[:, t + 1, None], now, 0.0)
        single = np.exp(np.minimum(0, forward[..., 1] + backward[..., 1] - whole[:, None])) * mask
        gradient = np.zeros(width + 4)
        gradient[:width] = np.einsum("i,it,itf->f", share, (label - single) * mask, x)
        both = mask[:, 1:] * share[:, None]
        for a in (0, 1):
            for b in (0, 1):
                expected = np.exp(np.minimum(0, forward[:, :-1, a] + pairs[a, b] + node[:, 1:, b] + backward[:, 1:, b] - whole[:, None]))
                found = (label[:, :-1] == a) & (label[:, 1:] == b)
                gradient[width + 2 * a + b] = (both * (found - expected)).sum()
        gradient -= ridge * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Field(tuple(theta[:width].tolist()), tuple(map(tuple, theta[width:].reshape(2, 2).tolist())))


def splice(good: list[np.ndarray], bad: list[np.ndarray], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts with a run of other lines put into them: features with labels. Each of good gets a run of one of bad."""
    rng, out = np.random.default_rng(seed), []
    for f in good if bad else []:
        other = bad[int(rng.integers(len(bad)))]
        size = int(rng.integers(1, min(len(other), max(2, len(f))) + 1))
        begin, at = int(rng.integers(len(other) - size + 1)), int(rng.integers(len(f) + 1))
        lines = np.concatenate((f[:at], other[begin : begin + size], f[at:]))
        lines[:, FEATURES.index("first")] = np.arange(len(lines)) == 0
        lines[:, FEATURES.index("last")] = np.arange(len(lines)) == len(lines) - 1
        label = np.ones(len(lines), np.int64)
        label[at : at + size] = 0
        out.append((lines, label))
    return out


def learn(good: list[np.ndarray], bad: list[np.ndarray]) -> Field:
    """A field from features of the lines of good and of bad texts.

    Lines of good texts are content. A bad text may have content lines too: a first field, fitted on texts with runs of bad
    texts' lines put into them, says which; but each bad text keeps a boilerplate line at least, its least likely content.
    The final field learns from good texts, bad texts and spliced texts, and so from changes within a text.
    """
    if not good or not bad:
        return ALL_CONTENT
    whole = [(f, np.ones(len(f), np.int64)) for f in good]
    first = fit(whole + [(f, np.zeros(len(f), np.int64)) for f in bad] + splice(good, bad))
    marked = []
    for f in bad:
        scores = f @ np.array(first.weights)
        label = np.array(viterbi(scores.tolist(), ((0.0, 0.0), (0.0, 0.0))), np.int64)
        label[int(np.argmin(scores))] = 0
        marked.append((f, label))
    return fit(whole + marked + splice(good, [f[y == 0] for f, y in marked], seed=1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "text"):
        found = read_lines(strings(b.column("text")))
        ends = np.searchsorted(found.doc, np.arange(b.num_rows + 1))
        yield batch("quality int, features binary", [b.column("quality"), [found.features[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])]])


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field fitted on at most FIT_ROWS documents of each quality (0 or 1), those whose ids have the smallest hashes."""
    order = F.xxhash64(F.lit(11), "doc_id")
    labels = columns(labels, doc_id=("doc_id", None), quality=("quality", "int"))
    some = [labels.filter(F.col("quality") == q).select(F.col("doc_id").alias("__id"), "quality").dropDuplicates(["__id"]).orderBy(F.xxhash64(F.lit(11), "__id"), "__id").limit(FIT_ROWS) for q in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * FIT_ROWS rows
    rows = columns(docs, doc_id=(id_col, None), text=(text_col, None)).join(chosen, F.col("doc_id") == F.col("__id")).orderBy(order, "doc_id", F.xxhash64("text")).limit(2 * FIT_ROWS).select("quality", "text")
    found = sorted((int(r["quality"]), bytes(r["features"])) for r in rows.mapInArrow(_features, "quality int, features binary").collect() if r["features"])
    good, bad = ([np.frombuffer(f).reshape(-1, len(FEATURES)) for q, f in found if q == k] for k in (1, 0))
    return learn(good, bad)


def judge(texts: list[str], field: Field) -> list[dict]:
    """Figures and verdict of each text."""
    lines = read_lines(texts)
    scores = (lines.features @ np.array(field.weights)).tolist()
    ends = np.searchsorted(lines.doc, np.arange(len(texts) + 1)).tolist()
    out = []
    for i, t in enumerate(texts):
        words = split_words(utf8(t))
        a, z = ends[i], ends[i + 1]
        labels = viterbi(scores[a:z], field.pairs) if z > a else []
        content = sum(w for w, label in zip(lines.words[a:z].tolist(), labels) if label)
        repeats = repeat_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT * len(words)
        share = content / len(words) if words else 0.0
        out.append({
            "n_words": len(words), "word_chars": int(lines.word_chars[i]), "n_symbols": int(lines.symbols[i]), "n_dup_lines": int(lines.dup_lines[i]), "n_repeat_words": repeats,
            "base_failed": failed, "kept": not failed and share >= CONTENT_SHARE, "content_share": share, "content_lines": sum(labels), "lines": z - a,
        })
    return out


_JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, content_lines long, lines long"


def judge_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, content_lines, lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for b in steps(batches, 1):
            found = judge(strings(b.column(1)), field)
            yield batch(_JUDGED, [b.column(0), *([f[k] for f in found] for k in [c.split(" ")[0] for c in _JUDGED.split(", ")][1:])])
        release()

    return columns(docs, doc_id=(id_col, "long"), text=(text_col, None)).mapInArrow(run, _JUDGED)


def keep_content(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    at = place_of(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for b in steps(batches, at):
            yield b.filter(pa.array([f["kept"] for f in judge(strings(b.column(at)), field)], pa.bool_()))
        release()

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
