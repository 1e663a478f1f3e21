"""Full-text search: tokens with positions, English stems, web-style queries and cover-density rank."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import STOP, stem

_TOKEN = re.compile(r"\w+(?:-\w+)*")


def lexemes(text: str | None) -> dict[str, list[int]]:
    """Positions (from 1) by lexeme. A hyphenated word is indexed whole and in parts."""
    out: dict[str, list[int]] = {}
    at = 0
    for m in _TOKEN.finditer((text or "").lower()):
        at += 1
        words = [m[0]] if "-" not in m[0] else [m[0], *m[0].split("-")]
        for k, w in enumerate(words):
            if w not in STOP and w:
                out.setdefault(stem(w), []).append(at + max(0, k - 1))
        at += max(0, len(words) - 2)
    return out


class _Numbers(dict):
    """Numbers of a word's lexeme, from 0, or -1 for a word that is left out; a hyphenated word has -2 less its place among ``joined``, which has the lexemes of its parts."""

    def __init__(self):
        super().__init__()
        self.lexemes: dict[str, int] = {}
        self.joined: list[tuple[int, list[int]]] = []

    def _of(self, word: str) -> int:
        return self.lexemes.setdefault(stem(word), len(self.lexemes)) if word not in STOP else -1

    def __missing__(self, word: str) -> int:
        if "-" in word:
            self.joined.append((self._of(word), [self._of(w) for w in word.split("-")]))
            n = -1 - len(self.joined)
        else:
            n = self._of(word)
        self[word] = n
        return n


def chunk_postings(texts: Iterable[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``lexemes`` gives for each of some texts, as arrays by lexeme: (lexemes, documents, the first document of each lexeme, positions, positions of each document).

    Documents are numbers from 0 in the order of the texts. Each word is stemmed once.
    """
    number, parts = _Numbers(), []
    for doc, text in enumerate(texts):
        found = np.fromiter(map(number.__getitem__, _TOKEN.findall((text or "").lower())), np.int64)
        joined = np.flatnonzero(found < -1)
        width = np.ones(len(found), np.int64)
        width[joined] = [len(number.joined[-2 - n][1]) for n in found[joined].tolist()]
        at = np.cumsum(width) - width + 1
        plain = found >= 0
        lexeme, at_of = [found[plain]], [at[plain]]
        for n, p in zip(found[joined].tolist(), at[joined].tolist(), strict=True):
            whole, each = number.joined[-2 - n]
            some = [(x, p + max(0, k - 1)) for k, x in enumerate([whole, *each]) if x >= 0]
            lexeme.append(np.array([x for x, _ in some], np.int64))
            at_of.append(np.array([x for _, x in some], np.int64))
        parts.append((np.concatenate(lexeme), np.concatenate(at_of), doc))
    lexeme, position = (np.concatenate([np.empty(0, np.int64), *(x[i] for x in parts)]) for i in (0, 1))
    doc = np.repeat(np.array([x[2] for x in parts], np.int64), [len(x[0]) for x in parts])
    order = np.lexsort((position, doc, lexeme))
    lexeme, doc, position = lexeme[order], doc[order], position[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool), (np.diff(lexeme) != 0) | (np.diff(doc) != 0))))
    sizes, owner = np.diff(np.append(first, len(doc))), lexeme[first]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), np.diff(owner) != 0)))
    names = list(number.lexemes)
    return [names[i] for i in owner[starts].tolist()], doc[first], starts, position, sizes


_INDEX = "id string, lexeme string, positions array<int>"


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (id, lexeme, positions) for each document and lexeme."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, lx, at) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for lx, at in lexemes(t).items()]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            kinds = (pa.string(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "lexeme", "positions"])

    return df.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(run, _INDEX)


def parse_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (negated, phrase): terms are joined by and, `or` separates, quotes make phrases, - negates."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', query):
        if m[3] and m[3].lower() == "or":
            out.append([])
            continue
        body, negated = (m[2], bool(m[1])) if m[3] is None else (m[3].lstrip("-"), m[3].startswith("-"))
        phrase = [stem(w) for w in _TOKEN.findall(body.lower()) if w not in STOP]
        if phrase:
            out[-1].append((negated, phrase))
    return [a for a in out if any(not n for n, _ in a)]


def cover_rank(where: dict[str, list[int]], terms: list[str]) -> float:
    """Sum over minimal covers of 0.1 / (1 + words in the cover that are no term)."""
    hits = sorted((p, t) for t in set(terms) for p in where.get(t, []))
    need, total, i = set(terms), 0.0, 0
    while i < len(hits):
        have, j = set(), i
        while j < len(hits) and have != need:
            have.add(hits[j][1])
            j += 1
        if have != need:
            break
        have, k = set(), j - 1  # shrink from the left
        while have != need:
            have.add(hits[k][1])
            k -= 1
        first, last = hits[k + 1][0], hits[j - 1][0]
        total += 0.1 / (1 + max(0, last - first - (len(need) - 1)))
        i = k + 2
    return total


def score(where: dict[str, list[int]], query: list[list[tuple[bool, list[str]]]]) -> float | None:
    """Rank of a document, or None if it doesn't match."""
    best = None
    for alternative in query:
        good, terms = True, []
        for negated, phrase in alternative:
            starts = [p for p in where.get(phrase[0], []) if all(p + k in where.get(w, []) for k, w in enumerate(phrase))]
            if bool(starts) == negated:
                good = False
                break
            terms += [] if negated else phrase
        if good:
            best = max(best or 0.0, cover_rank(where, terms))
    return best


def search(index: DataFrame, query: str, allowed: DataFrame | None = None) -> DataFrame:
    """(id, lexical_score) of matching documents. Only postings of the query's lexemes are read, and only of allowed ids."""
    parsed = parse_query(query)
    words = sorted({w for a in parsed for _, p in a for w in p})
    rows = index.filter(F.col("lexeme").isin(words)) if words else index.limit(0)
    if allowed is not None:
        rows = rows.join(allowed, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, score({x["lexeme"]: list(x["positions"]) for x in w}, parsed)) for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            got = [x for x in got if x[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["id", "lexical_score"])

    grouped = rows.groupBy("id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("w"))  # at most the query's lexemes
    return grouped.mapInArrow(run, "id string, lexical_score double")


def evidence(similarity: Column, lexical_rank: Column, least: float = 0.55) -> Column:
    """Whether any hit is near enough or matches words."""
    return F.bool_or(F.coalesce(similarity >= least, F.lit(False)) | F.coalesce(lexical_rank > 0, F.lit(False)))
