"""Secret scan over a trigram inverted index.

From every rule's regular expression a Boolean query over trigrams is derived: a text that matches must satisfy it. Texts
are indexed in segments: for each trigram that a query names, a postings list of the segment's texts. Queries intersect
and unite postings; only the texts they leave are searched with the expression. Rules without mandatory trigrams search
every text. Trigrams are of UTF-8 bytes with ASCII letters in lower case, for index and queries alike.

The index is stored: a numbered copy of the texts, and for each segment of them its postings as row numbers. Postings are
small and are shuffled by segment; the texts aren't: tasks that read them look up which of their rows are candidates.
One index serves many runs, also of fewer rules; find_secrets() makes one and searches it.

Defined results: a null text counts as empty; a null doc_id is kept; rows that repeat an id are rows of their own; a text of
any length is searched whole; spans that begin together are in the order of the rules; an empty table gives no rows; further
columns are ignored. Spans are in code points, end exclusive, of whole matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RowLists, batch, columns, materialize, numbered_copy, only, steps, strings, utf8

try:
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """kind; expression; the length that a match, or its group, has at least; whether ASCII letters match in either case."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=12, group=2, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs of [0-9a-f]+ are maximal, so those of 16 and more are the same
)
#: Public formats of tokens and keys.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("service_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE_RULES + MORE_RULES

# A query is None (any text), ("and", parts), ("or", parts) or a trigram in bytes.
_MANY = 64


def _and(*parts):
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings) -> object:
    """Query of texts that hold one of the strings."""
    return _or([_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


@dataclass(frozen=True)
class _Info:
    """What is known of an expression's matches: all of them (or None), and a query that holds for each."""

    exact: frozenset | None
    query: object = None


_EMPTY = _Info(frozenset([b""]))


def _join(parts: list[_Info]) -> _Info:
    """One after the other. Runs of parts with known strings are multiplied out as long as they are few."""
    queries, run = [], frozenset([b""])
    whole = True
    for p in parts:
        queries.append(p.query)
        if p.exact is not None and len(run) * len(p.exact) <= _MANY:
            run = frozenset(a + b for a, b in product(run, p.exact))
        else:
            whole = False
            queries.append(_of_strings(run))
            # what follows begins with the ends of the strings there are, or anew
            run = p.exact if p.exact is not None else frozenset([b""])
    return _Info(run if whole else None, _and(*queries, None if whole else _of_strings(run)))


def _set(items, any_case: bool) -> frozenset | None:
    out = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(value)
        elif op is sre.RANGE and value[1] - value[0] < 16:
            out.update(range(value[0], value[1] + 1))
        else:
            return None
    strings = frozenset(utf8(chr(c)).lower() for c in out)
    return strings if len(strings) <= 16 else None


def _walk(tree, any_case: bool) -> _Info:
    parts = []
    for op, value in tree:
        if op is sre.LITERAL:
            parts.append(_Info(frozenset([utf8(chr(value)).lower()])))
        elif op is sre.IN:
            parts.append(_Info(_set(value, any_case)))
        elif op is sre.BRANCH:
            own = [_walk(x, any_case) for x in value[1]]
            exact = frozenset().union(*(x.exact for x in own)) if all(x.exact is not None for x in own) else None
            exact = exact if exact is not None and len(exact) <= _MANY else None
            parts.append(_Info(exact, _or([_and(x.query, _of_strings(x.exact) if x.exact is not None else None) for x in own])))
        elif op is sre.SUBPATTERN:
            parts.append(_walk(value[3], any_case))
        elif op is getattr(sre, "ATOMIC_GROUP", None):
            parts.append(_walk(value, any_case))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            least, most, body = value
            own = _walk(body, any_case)
            if most == 1 and least == 0 and own.exact is not None:
                parts.append(_Info(own.exact | {b""}))
            elif least:
                parts += [own] * min(least, 8)
                if least != most or least > 8:
                    parts.append(_Info(None))
            else:
                parts.append(_Info(None))
        elif op is sre.AT:
            parts.append(_EMPTY)
        else:
            parts.append(_Info(None))  # anything else may match anything
    return _join(parts) if parts else _EMPTY


def trigram_query(rule: Rule):
    """The Boolean query of trigrams that every match of the rule satisfies, or None where there is none."""
    info = _walk(sre_parse.parse(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0)), rule.any_case)
    return _and(info.query, _of_strings(info.exact) if info.exact is not None else None)


def trigrams_of(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class SegmentIndex:
    """Postings of a segment's texts: for each trigram the numbers of the texts that have it, ascending."""

    def __init__(self, texts: list[str], trigrams: list[bytes], table: np.ndarray):
        """table: for each code of three bytes 1 + the trigram's place in trigrams, or 0."""
        self.size = len(texts)
        data = [utf8(t).lower() for t in texts]
        flat = np.frombuffer(b"\0\0".join(data), np.uint8)
        starts = np.cumsum([0] + [len(d) + 2 for d in data[:-1]]) if data else np.empty(0, np.int64)
        self.postings = {t: np.empty(0, np.int64) for t in trigrams}
        if len(flat) < 3 or not trigrams:
            return
        code = flat[:-2].astype(np.uint32)
        code <<= 8
        code |= flat[1:-1]
        code <<= 8
        code |= flat[2:]
        found = table[code]
        at = np.flatnonzero(found)
        which = found[at].astype(np.int64) - 1
        pairs = np.unique(which * self.size + np.searchsorted(starts, at, side="right") - 1)
        for k, own in zip(*self._grouped(pairs // self.size, pairs % self.size)):
            self.postings[trigrams[k]] = own

    @staticmethod
    def _grouped(keys: np.ndarray, values: np.ndarray):
        cut = np.flatnonzero(np.diff(keys)) + 1
        return (keys[np.concatenate(([0], cut))].tolist() if len(keys) else [], np.split(values, cut) if len(keys) else [])

    def select(self, query) -> np.ndarray:
        """Numbers of the texts that satisfy a query."""
        if query is None:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = sorted((self.select(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


@lru_cache(maxsize=4)
def _prepared(rules: tuple[Rule, ...]):
    queries = [trigram_query(r) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_of, queries)))
    table = np.zeros(1 << 24, np.uint16 if len(trigrams) < 1 << 16 else np.uint32)
    for i, t in enumerate(trigrams):
        table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
    return queries, trigrams, table, [r.compiled() for r in rules]


def spans_of(text: str, rules: tuple[Rule, ...], compiled: list[re.Pattern], mask: int) -> list[tuple[int, int, int]]:
    """Spans of a text by the rules of a mask, as (start, number of the rule, end), in this order."""
    out = []
    for k, (rule, pattern) in enumerate(zip(rules, compiled)):
        if mask >> k & 1:
            for m in pattern.finditer(text):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    out.append((m.start(), k, m.end()))
    return sorted(out)


def scan(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Spans of each text of one segment, whose index lives as long as the call."""
    queries, trigrams, table, compiled = _prepared(rules)
    index = SegmentIndex(texts, trigrams, table)
    masks = [0] * len(texts)
    for k, query in enumerate(queries):
        for i in index.select(query).tolist():
            masks[i] |= 1 << k
    return [spans_of(t, rules, compiled, m) for t, m in zip(texts, masks)]


@dataclass(frozen=True)
class StoredIndex:
    """An index that outlives the run that made it: a numbered copy of the texts (doc_id, text, nth), and postings (segment, trigram, rows) of trigrams."""

    copy: DataFrame
    postings: DataFrame
    trigrams: frozenset


_POSTINGS = "segment long, trigram binary, rows binary"


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> StoredIndex:
    """Indexes docs for the trigrams of rules; the index serves any rules whose trigrams are among these. A segment's postings are the numbers of its rows."""
    copy = numbered_copy(columns(docs, doc_id=(id_col, "long"), text=(text_col, None)), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        _, trigrams, table, _ = _prepared(rules)
        for b in steps(batches, 1):
            nth = b.column(2).to_numpy()
            found = [(t, nth[rows].astype("<i8").tobytes()) for t, rows in SegmentIndex(strings(b.column(1)), trigrams, table).postings.items() if len(rows)]
            yield batch(_POSTINGS, [[int(nth[0])] * len(found), [t for t, _ in found], [rows for _, rows in found]])

    return StoredIndex(copy, materialize(copy.mapInArrow(run, _POSTINGS), "postings"), frozenset(_prepared(rules)[1]))


def select_rows(query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """Row numbers of a segment that satisfy a query, which is not None."""
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, np.int64))
    parts = sorted((select_rows(q, postings) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


#: Rules whose candidates share one number as their mask.
MASK_RULES = 60


def candidates(index: StoredIndex, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """nth and mask (a bit for each rule, of which there are MASK_RULES at most) of the rows that rules with trigrams leave: postings are intersected segment by segment."""
    queries = [trigram_query(r) for r in rules]
    if not set().union(*map(trigrams_of, queries)) <= index.trigrams:
        raise ValueError("the index doesn't have all trigrams of the rules")

    def run(table: pa.Table) -> pa.Table:
        postings = dict(zip(table.column("trigram").to_pylist(), (np.frombuffer(r, "<i8") for r in table.column("rows").to_pylist())))
        found = [(k, select_rows(q, postings)) for k, q in enumerate(queries) if q is not None]
        nth = np.unique(np.concatenate([np.empty(0, np.int64), *(rows for _, rows in found)]))
        mask = np.zeros(len(nth), np.int64)
        for k, rows in found:
            mask[np.searchsorted(nth, rows)] |= 1 << k
        return pa.table({"nth": nth, "mask": mask})

    return index.postings.groupBy("segment").applyInArrow(run, "nth long, mask long")


_FOUND = "doc_id long, kinds array<string>, starts array<long>, ends array<long>"


def search_index(index: StoredIndex, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of the index: doc_id, and the kinds, starts and ends of its spans, in order of start, then rule. Expressions search candidates only, but for rules without mandatory trigrams."""
    lists = [RowLists(candidates(index, rules[k : k + MASK_RULES]), "candidates") for k in range(0, len(rules), MASK_RULES)]
    everywhere = sum(1 << k for k, r in enumerate(rules) if trigram_query(r) is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        finders, compiled = [x.finder() for x in lists], _prepared(rules)[3]
        for b in steps(batches, 1):
            texts, masks = strings(b.column(1)), [everywhere] * b.num_rows
            for c, find in enumerate(finders):
                masks = [m | own << MASK_RULES * c for m, own in zip(masks, find(b.column(2).to_numpy()).tolist())]
            found = [spans_of(t, rules, compiled, m) for t, m in zip(texts, masks)]
            yield batch(_FOUND, [b.column(0), [[rules[k].kind for _, k, _ in f] for f in found], [[a for a, _, _ in f] for f in found], [[z for _, _, z in f] for f in found]])

    return index.copy.mapInArrow(run, _FOUND)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """build_index() and search_index() in one: a row per row of docs with its spans."""
    return search_index(build_index(docs, rules, id_col, text_col), rules)


def joined_spans(only: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of a row's spans, comma-joined; of some kinds only if they are named."""
    spans = F.arrays_zip("kinds", "starts", "ends")
    if only is not None:
        spans = F.filter(spans, lambda s: s["kinds"].isin(*only))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
