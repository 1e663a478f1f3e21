"""Licence scans by conditional compression.

Blocks of a document that use licence wording are compressed alone and, with each template as a zstandard raw-content
dictionary, given the template. Templates are ranked by the bytes that they save and confirmed down the ranking by the exact wording: a template's words must
stand there in order, all of them for a short notice and nearly all for a long text. A block is taken with as many words around it as the longest template has, so neither
line ends nor the sentences without licence wording at a template's end cut it off. A reduction is told as a share of the cheaper of block and template, so other text in a block
doesn't hide a notice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .license_templates import templates

#: The words of a cue may stand on two lines, the second behind a comment's marks.
CUE = r"(?i)licen[cs]e|copyright|rights_reserved|permission_is_hereby|permission_to_use|redistribution|warrant(y|ies)|\bSPDX\b|public_domain|creative_commons|\bCC(_|-)BY|\bGNU\b|free_software|released_under".replace(
    "_", "[ \\t\\r\\n#*/]+"
)
_CUE = re.compile(CUE)
_UNIT = re.compile(r"\n+|(?<=[.!?;:])\s+")
#: A word may be broken at a hyphen.
_BREAK = r"(?<=-)[ \t]*\r?\n[ \t#*/]*(?=[A-Za-z0-9])"
_WORD = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9.+'-]|{_BREAK})*")
#: Units without a cue that may stand between two with one in a block.
GAP = 3
#: A block whose wording no template confirms is of no template if none saves this share of what the block costs, or the template if that is less. Words of a long template that may differ; a template is long from so many words.
LEAST_REDUCTION, LONG_WORDS, MAY_DIFFER = 0.3, 20, 0.08
#: Words of a document in which wordings are searched at once.
CHUNK = 8192


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of sentences and lines with licence wording."""
    cuts = [(m.start(), m.end()) for m in _UNIT.finditer(text)]
    units, at = [], 0
    for a, b in [*cuts, (len(text), len(text))]:
        if a > at:
            units.append((at, a))
        at = b
    starts = [a for a, _ in units]
    out: list[list[int]] = []
    last = -GAP - 2
    for m in _CUE.finditer(text):
        k, to = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1
        (a, _), (_, b) = units[k], units[to]
        if out and k - last <= GAP + 1:
            out[-1][1] = max(b, out[-1][1])
        elif not out or b > out[-1][1]:
            out.append([max(a, out[-1][1]) if out else a, b])
        last = to
    return [(a, b) for a, b in out]


def places(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of all words."""
    return [(re.sub(_BREAK, "", m[0]).rstrip(".").lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def words(text: str) -> list[str]:
    return [w for w, _, _ in places(text)]


@lru_cache(maxsize=1)
def _compressors() -> tuple:
    every = []
    for name, text in templates():
        d = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        every.append((name, words(text), zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False)))
    return zstandard.ZstdCompressor(level=3, write_content_size=False), every


@lru_cache(maxsize=1)
def _wordings() -> tuple:
    """Numbers of the templates' words; each template's words as numbers, how often it has each, and how many may differ."""
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in want], np.int64) for _, want, _ in _compressors()[1]]
    has = np.stack([np.bincount(x, minlength=len(number)) for x in ids])
    return number, ids, has, [int(MAY_DIFFER * len(x)) if len(x) >= LONG_WORDS else 0 for x in ids]


def _costs(want: np.ndarray, have: np.ndarray) -> Iterator[np.ndarray]:
    """For each prefix of ``want``, at j the fewest words that differ between it and a window of ``have`` that ends before word j."""
    at = np.arange(len(have) + 1)
    row = np.zeros(len(have) + 1, np.int64)
    yield row
    for i, w in enumerate(want.tolist()):
        new = row + 1
        new[1:] = np.minimum(new[1:], np.where(have == w, row[:-1], len(want) + 1))
        new[0] = i + 1
        row = np.minimum.accumulate(new - at) + at
        yield row


def alignment(want: np.ndarray, have: np.ndarray, end: int) -> tuple[int, list[int], list[int]]:
    """(start of the window of ``have`` up to ``end`` that differs least from ``want``, places in ``want`` it lacks, places in ``have`` that ``want`` lacks)."""
    lo = max(0, end - 2 * len(want))  # a longer window differs by more than all of want
    cost = list(_costs(want, have[lo:end]))
    i, j, missing, extra = len(want), end - lo, [], []
    while i:
        if j and want[i - 1] == have[lo + j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            missing.append(i)
        else:
            j -= 1
            extra.append(lo + j)
    return lo + j, missing[::-1], extra[::-1]


def wordings(have: np.ndarray) -> list[tuple[int, int, int, int, list[int], list[int]]]:
    """(score, template, start, end, missing, extra) of all windows of ``have`` that a template's wording confirms, best first.

    The score is how many words match less how many differ, so a longer text goes before one that it contains.
    """
    _, ids, has, may = _wordings()
    out = []
    for lo in range(0, len(have), CHUNK):
        reach = lo - max(map(len, ids)) - max(may)  # a window that ends in this chunk may begin before it
        part, first = have[max(0, reach) : lo + CHUNK], max(0, reach)
        lacks = np.maximum(has - np.bincount(part[part >= 0], minlength=has.shape[1]), 0).sum(axis=1)
        for k in np.flatnonzero(lacks <= may).tolist():
            want = ids[k]
            if may[k]:
                *_, row = _costs(want, part)
                near = np.flatnonzero(row <= may[k])
                ends = [int(run[row[run].argmin()]) for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1) if len(run)]
            else:
                n = max(0, len(part) - len(want) + 1)
                hit = np.ones(n, bool)
                for i, w in enumerate(want.tolist()):
                    hit &= part[i : i + n] == w
                ends = (np.flatnonzero(hit) + len(want)).tolist()
            for end in ends:
                if end + first > lo:
                    start, missing, extra = alignment(want, part, end)
                    out.append((len(want) - 2 * len(missing) - len(extra), k, start + first, end + first, missing, [x + first for x in extra]))
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


def _reductions(text: str, some: list[int] | None = None) -> list[tuple[int, float]]:
    """(bytes that each template saves, or ``some`` of them; their share of the text's cost or the template's own, whichever is less)."""
    plain, every = _compressors()
    data = text.encode()
    alone = len(plain.compress(data))
    saved = [(alone - len(every[k][2].compress(data)), _own_costs()[k]) for k in (range(len(every)) if some is None else some)]
    return [(x, min(1.0, x / min(alone, cost))) for x, cost in saved]


@lru_cache(maxsize=1)
def _own_costs() -> list[int]:
    plain = _compressors()[0]
    return [len(plain.compress(text.encode())) for _, text in templates()]


def ranking(text: str) -> list[int]:
    """All templates by the bytes that each saves of a text, the longer first among equals."""
    ids, saved = _wordings()[1], [x for x, _ in _reductions(text)]
    return sorted(range(len(ids)), key=lambda k: (-saved[k], -len(ids[k]), k))


def regions(own: list[tuple[str, int, int]], blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last + 1) word of the candidate blocks, each with as many words around it as a template may have; those that meet are one."""
    _, ids, _, may = _wordings()
    reach, out = max(map(len, ids)) + max(may), []
    for a, b in blocks:
        lo, hi = max(0, bisect_right(own, a, key=lambda x: x[2]) - reach), min(len(own), bisect_right(own, b, key=lambda x: x[1]) + reach)
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        elif lo < hi:
            out.append((lo, hi))
    return out


def licences(text: str, own: list[tuple[str, int, int]], have: np.ndarray, blocks: list[tuple[int, int]]) -> list[tuple[int, int, int, list[int], list[int]]]:
    """(start, end, template, missing, extra) of the confirmed windows of the candidate blocks, in order.

    A block is compressed with each template, and the templates are confirmed down their ranking, without a cap, by how their wording differs; of windows that
    overlap the one that differs least and is longest stays, then the one ranked higher. What is left on either side is compressed, ranked and confirmed again.
    """
    out, todo = [], regions(own, blocks)
    while todo:
        lo, hi = todo.pop()
        part = text[own[lo][1] : own[hi - 1][2]]
        if not _CUE.search(part):
            continue  # every template has a cue
        place = {k: i for i, k in enumerate(ranking(part))}
        taken: list[tuple] = []
        for _, k, s, e, missing, extra in sorted(wordings(have[lo:hi]), key=lambda x: (-x[0], place[x[1]], x[2])):
            at = bisect_right(taken, lo + s, key=lambda x: x[0])
            if (not at or taken[at - 1][1] <= lo + s) and (at == len(taken) or lo + e <= taken[at][0]):
                taken.insert(at, (lo + s, lo + e, k, missing, [lo + x for x in extra]))
        if taken:
            out += taken
            todo += [(x, y) for x, y in zip([lo, *(t[1] for t in taken)], [*(t[0] for t in taken), hi], strict=True) if x < y]
    return sorted(out)


def rows(text: str, blocks: list[tuple[int, int]]) -> list[tuple]:
    """(block, start, end, licence, reduction, confirmed, missing words, extra words) of each confirmed licence and of each part of a block that they leave
    with licence wording of its own; of templates that save as many bytes the first wins.

    A confirmed licence has its wording's window and the reduction of that, whatever else the block holds. It may begin before the first block's cue or end
    after it; one that several blocks share is of the first.
    """
    _, every = _compressors()
    number = _wordings()[0]
    own = places(text)
    have = np.array([number.get(w, -1) for w, _, _ in own], np.int64)
    out, spans = [], []
    for s, e, k, missing, extra in licences(text, own, have, blocks):
        lo, hi = own[s][1], own[e - 1][2]
        block = min(bisect_right(blocks, lo, key=lambda x: x[1]), len(blocks) - 1)
        spans.append((lo, hi))
        out.append((block, lo, hi, every[k][0], _reductions(text[lo:hi], [k])[0][1], True, [every[k][1][x] for x in missing], [own[x][0] for x in extra]))
    cues = [m.span() for m in _CUE.finditer(text)]
    for block, (a, b) in enumerate(blocks):
        near = [x for x in spans[max(0, bisect_right(spans, (a, -1)) - 1) : bisect_right(spans, (b, b))] if x[0] < b and x[1] > a]
        for lo, hi in zip([a, *(x[1] for x in near)], [*(x[0] for x in near), b], strict=True):
            if near and not any(lo <= s and e <= hi for s, e in cues[bisect_right(cues, (lo, -1)) : bisect_right(cues, (hi, -1))]):
                continue
            part = text[lo:hi]
            if near:
                lo, hi = lo + len(part) - len(part.lstrip()), hi - len(part) + len(part.rstrip())
            saved = _reductions(text[lo:hi])
            some = [k for k, (_, share) in enumerate(saved) if share >= LEAST_REDUCTION]
            if some:
                best = max(some, key=lambda k: (saved[k][0], -k))
                out.append((block, lo, hi, every[best][0], saved[best][1], False, *_differences(own, have, lo, hi, best)))
            else:
                out.append((block, lo, hi, None, max(0.0, *(share for _, share in saved)), False, [], []))
    return sorted(out, key=lambda x: x[:3])


def _differences(own: list[tuple[str, int, int]], have: np.ndarray, a: int, b: int, k: int) -> tuple[list[str], list[str]]:
    """(missing, extra) words of the window that is nearest to template ``k`` among those that end in the characters from ``a`` to ``b`` or up to the template's length after."""
    want, ids = _compressors()[1][k][1], _wordings()[1][k]
    lo = max(0, bisect_right(own, a, key=lambda x: x[2]) - len(ids))
    part = have[lo : bisect_right(own, b, key=lambda x: x[1]) + len(ids)]
    *_, row = _costs(ids, part)
    _, missing, extra = alignment(ids, part, int(row.argmin()))
    return [want[x] for x in missing], [own[lo + x][0] for x in extra]


def classify(block: str) -> tuple[str | None, float, bool, list[str], list[str]]:
    """(licence, reduction, confirmed, missing words, extra words) of a text that is one block; of several licences the first confirmed one."""
    return min(rows(block, [(0, len(block))]), key=lambda x: not x[5])[3:]


_SCHEMA = "doc_id long, block int, start long, end long, license string, reduction double, confirmed boolean, missing array<string>, extra array<string>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
    for b in batches:
        found = [(doc, *r) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(t, candidate_blocks(t))]
        cols = list(zip(*found, strict=True)) or [()] * len(kinds)
        names = ["doc_id", "block", "start", "end", "license", "reduction", "confirmed", "missing", "extra"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each licence whose wording stands in ``docs`` (doc_id, text; others are ignored), and for each rest of a candidate block with other licence
    wording: its block, its place in characters, (best) licence or null, size reduction (see ``rows``), whether the wording confirms it, and the words that differ.

    Texts without licence wording, null texts and empty tables give no rows. Repeated rows and null ids give rows of their own.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.filter(F.col("text").rlike(CUE)).mapInArrow(_run, _SCHEMA)
