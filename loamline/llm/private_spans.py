"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier trained on the outcome decides.

Every text gives its base spans (strict patterns that pass their check) and further candidates: matches that fail it and looser forms, such as addresses with
"at" and "dot", numbers of other groupings, national phone numbers, and addresses of six bytes or more. Labelers vote 1, -1 or nothing on each: the pattern's form, a check
(Luhn, ranges, lengths), gazetteers (top-level domains, calling codes, issuers), the words before and after, and the characters around. For each
kind, expectation-maximisation over the counts of all vote patterns of the corpus estimates how reliable each labeler is (Dawid and Skene, 1979), and what
share of the candidates is true; base spans are known to be, and candidates that fail their check not to be. A logistic classifier of what stands in a span and around
it learns from the outcome. Base spans stay whatever it says; a further candidate that doesn't fail its check is added when both hold it for true.

Vote patterns are at most 3 ** labelers a kind; the classifier learns from a sample of ``TRAIN_SPANS`` spans a kind. Texts are read once: candidates with votes and
features are written, and read again for counts, training and the decision.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .textkit import released

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Candidates of a kind that the classifier learns from, at most about so many, chosen by hash; its weights a kind.
TRAIN_SPANS, WEIGHTS = 4000, 4096
EM_ROUNDS, STEPS, RATE, RIDGE = 60, 150, 0.5, 1e-3
#: Characters before and after a span in which cues are looked for.
BEFORE, AFTER = 40, 20

#: The base patterns; possessive where no shorter match could pass.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"(?i)\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s|\s@\s?|@\s")
_OBSCURED = re.compile(r"(?i)[\w-]{1,63}(?:(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)[\w-]{1,63}){1,5}")
_MARKED_DOT = re.compile(r"(?i)[\[({<]\s?(?:dot|\.)|\sdot\s")
_LOOSE_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s\.\s)[0-9]{1,3}){3}(?![\w.])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")
_LOOSE_CARD = re.compile(r"(?<!\w)[0-9](?:[  .–/_-]{0,2}[0-9]){12,18}(?!\w)")
_LOOSE_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ .-]|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![\w-])")

#: Common top-level domains, calling codes by their first digits, and words before or after a span that speak for its kind or against personal data.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name io co me app dev ai de fr es it nl be at ch uk ie pt pl cz sk hu ro bg gr se no fi dk is ee lv lt ru ua by tr il ae sa in pk cn jp kr tw hk sg my th vn id ph au nz za ng ke eg ma br ar cl mx pe us ca eu test example".split())
CALLING = ("1", "7", "20", "21", "22", "23", "24", "25", "26", "27", "29", "30", "31", "32", "33", "34", "35", "36", "37", "38", "39", "40", "41", "42", "43", "44", "45", "46", "47", "48", "49", "50", "51", "52", "53", "54", "55", "56", "57", "58", "59", "60", "61", "62", "63", "64", "65", "66", "67", "68", "69", "80", "81", "82", "84", "85", "86", "88", "90", "91", "92", "93", "94", "95", "96", "97", "98", "99")
CUES = (
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|kontakt|courriel|correo|write to|reach)\b"),
    re.compile(r"(?i)\b(?:ip|ipv[46]|address|adresse|host|server|client|login|addr|logged|connect\w*|from)\b"),
    re.compile(r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta|payment|charged?)\b"),
    re.compile(r"(?i)\b(?:tel|phone|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|t[ée]l[ée]phone|tel[ée]fono|m[óo]vil|ruf\w*|sms|text)\b"),
)
AGAINST = re.compile(r"(?i)\b(?:version|release|build|v|order|invoice|isbn|issn|doi|serial|sku|part|ticket|ref|reference|id|hash|sha\d*|md5|commit|token|key|page|section|chapter|figure|timestamp|price|total|amount|tracking|account)\b[\s.:#=\"']*$")
UNITS = re.compile(r"(?i)^\s?(?:%|[€$£]|kg|km|mm|cm|ms|mb|gb|kb|bytes|seconds|pages|euros?|dollars?)")

LABELERS = ("form", "check", "gazetteer", "before", "after", "around")
CHECK = LABELERS.index("check")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the local part's characters, an at sign and a domain with a dot, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", domain.end() if domain else at + 1)
    return out


def _passes(kind: int, s: str) -> bool:
    if kind == IP:
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d) if kind == CARD else 9 <= len(d) <= 15 if kind == PHONE else True


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base patterns' matches that pass their check, by kind and start, and of those that fail it."""
    good, bad = [(EMAIL, a, b) for a, b in emails(text)], []
    for kind, pattern in ((IP, _IP), (CARD, _CARD), (PHONE, _PHONE)):
        for m in pattern.finditer(text):
            if _passes(kind, m[0]):
                good.append((kind, *m.span()))
            elif kind == PHONE or (len(m[0]) <= 15 if kind == IP else 12 <= len(_digits(m[0])) <= 19):
                bad.append((kind, *m.span()))
    return good, bad


def _loose(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _AT.finditer(text):
        domain = _OBSCURED.match(text, m.end())
        if domain and (m[0].strip() != "at" or _MARKED_DOT.search(domain[0])):
            start = m.start()
            while start and m.start() - start < 64 and (text[start - 1] in _LOCAL or text[start - 1].isalpha()):
                start -= 1
            if start < m.start():
                yield EMAIL, start, domain.end()
    for kind, pattern in ((IP, _LOOSE_IP), (CARD, _LOOSE_CARD), (PHONE, _LOOSE_PHONE)):
        for m in pattern.finditer(text):
            if kind != PHONE or 9 <= len(_digits(m[0])) <= 15:
                yield kind, *m.span()


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all base spans, and of further candidates that overlap neither these nor each other (the first, then the longest stays)."""
    good, bad = base_spans(text)
    out = [(*c, True) for c in good]
    taken = sorted((s, e) for _, s, e in good)
    last = -1
    i = 0
    most = 0  # the end of the base spans that begin before the candidate
    for k, s, e in sorted({*bad, *_loose(text)}, key=lambda c: (c[1], -c[2], c[0])):
        while i < len(taken) and taken[i][0] < e:
            most = max(most, taken[i][1])
            i += 1
        if most > s or s < last:
            continue
        out.append((k, s, e, False))
        last = e
    return sorted(out)


def _issuer(d: str) -> bool:
    n = len(d)
    return d[0] == "4" and n in (13, 16, 19) or n == 16 and ("51" <= d[:2] <= "55" or "2221" <= d[:4] <= "2720" or d[:4] == "6011" or d[:2] == "65" or "3528" <= d[:4] <= "3589") or n == 15 and d[:2] in ("34", "37") or n == 14 and d[:2] in ("36", "38", "30") or n >= 16 and d[:2] == "62"


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote of each of ``LABELERS``: 1 for personal data, -1 against, 0 for no opinion."""
    span, d = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    sign = lambda x: 1 if x else -1
    if kind == EMAIL:
        domain = re.split(r"[^A-Za-z]+", span)
        form, check, known = 1 if base else 0, sign(len(domain[-1]) >= 2 and span[-1].isalpha()), sign(domain[-1].lower() in TOP_LEVEL)
    elif kind == IP:
        parts = [int(x) if len(x) < 9 else 10**9 for x in re.findall(r"[0-9]+", span)] if ":" not in span else []
        form, check, known = 1 if base else 0, sign(":" in span or len(parts) == 4 and max(parts) <= 255), 0 if ":" in span else sign(1 <= parts[0] <= 239 and max(parts) > 9)
    elif kind == CARD:
        groups = [len(x) for x in re.split(r"[^0-9]+", span)]
        form, check, known = sign(len(groups) == 1 or max(groups) <= 6 and min(groups) >= 2), sign(13 <= len(d) <= 19 and luhn(d)), sign(_issuer(d))
    else:
        form = sign(9 <= len(d) <= 15 and re.search(r"[ ().-]", span))
        check = sign(9 <= len(d) <= 15 and len(set(d)) > 2)
        known = sign(d.startswith(CALLING)) if span[0] == "+" else sign(d.lstrip("0").startswith(CALLING)) if d.startswith("00") else 0
    cue, against = CUES[kind].search(before), AGAINST.search(before)
    unit, next_cue = UNITS.match(after), CUES[kind].search(after)
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    inside = left.isalnum() or right.isalnum() or left in ("_", "-", "=", "/", ".", "@") and left or right in ("_", "-", "=", "/", "@") and right
    return form, check, known, -1 if against else 1 if cue else 0, -1 if unit else 1 if next_cue else 0, -1 if inside else 1


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Sorted numbers (below ``WEIGHTS``) of what stands in a span and around it."""
    span, d = text[start:end][:80], _digits(text[start:end])
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", re.sub(r"\s", " ", span)))
    out = {"bias", f"digits {min(len(d), 24)}", f"first {d[:1]}", f"luhn {luhn(d)}", f"left {_class(text[start - 1 : start] if start else '')}", f"right {_class(text[end : end + 1])}", f"start {_class(span[:1])}"}
    out |= {f"shape {shape[i : i + 3]}" for i in range(max(1, len(shape) - 2))}
    out |= {f"group {min(len(x), 9)}" for x in re.findall(r"[0-9]+", span)} | {f"over {int(x) > 255}" for x in re.findall(r"[0-9]{1,9}", span)}
    out |= {f"before {w.lower()}" for w in re.findall(r"[^\W\d_]+", text[max(0, start - BEFORE) : start])[-3:]} | {f"after {w.lower()}" for w in re.findall(r"[^\W\d_]+", text[end : end + AFTER])[:2]}
    if kind == EMAIL:
        out |= {f"end {re.split(r'[^A-Za-z]+', span)[-1].lower()}", f"at {'@' in span}"}
    return sorted({crc32(x.encode()) % WEIGHTS for x in out})


def _class(c: str) -> str:
    return "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def reliabilities(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Vote patterns (-1, 0, 1) and how often each occurs -> (share of true candidates, P(vote | truth) as [labeler, truth, vote + 1], P(true | pattern)).

    ``known`` has the truth where it is given (1 or 0, else NaN). Expectation-maximisation with pseudo-counts by which a labeler is rather right than wrong; these
    also decide where there is little to learn from.
    """
    known = np.full(len(patterns), np.nan) if known is None else known
    m = patterns.shape[1]
    pseudo = np.tile(np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]]), (m, 1, 1))
    n = counts.astype(np.float64)
    p = np.where(np.isnan(known), 1 / (1 + np.exp(-patterns.sum(axis=1).astype(np.float64))), known)
    for _ in range(EM_ROUNDS):
        share = ((n * p).sum() + 1) / (n.sum() + 2)
        table = pseudo.copy()
        for j in range(m):
            table[j, 1] += np.bincount(patterns[:, j] + 1, weights=n * p, minlength=3)
            table[j, 0] += np.bincount(patterns[:, j] + 1, weights=n * (1 - p), minlength=3)
        table /= table.sum(axis=2, keepdims=True)
        p = np.where(np.isnan(known), posterior(share, table, patterns), known)
    return share, table, p


def posterior(share: float, table: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    odds = np.full(len(patterns), np.log(share) - np.log1p(-share))
    for j in range(patterns.shape[1]):
        odds += np.log(table[j, 1, patterns[:, j] + 1]) - np.log(table[j, 0, patterns[:, j] + 1])
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(rows: list[list[int]], truth: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier of feature numbers for soft labels, by gradient descent with a ridge."""
    w = np.zeros(WEIGHTS)
    if not rows:
        return w
    flat, owner = np.concatenate([np.array(r, np.int64) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    size = np.bincount(flat, minlength=WEIGHTS) + 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[flat], minlength=len(rows)), -30, 30)))
        w -= RATE * (np.bincount(flat, weights=(p - truth)[owner], minlength=WEIGHTS) / size + RIDGE * w)
    return w


class Model:
    """What was learned of each kind: the labelers' reliabilities and the classifier's weights (None where no candidate was seen)."""

    def __init__(self):
        none = reliabilities(np.zeros((1, len(LABELERS)), np.int64), np.zeros(1))
        self.labelers = {k: none[:2] for k in range(len(KINDS))}
        self.weights: dict[int, np.ndarray] = {}

    def scores(self, kind: int, pattern: np.ndarray, found: list[int]) -> tuple[float, float]:
        """(what the labelers hold for the chance that a candidate is true, what the classifier does)."""
        by_votes = float(posterior(*self.labelers[kind], pattern[None, :])[0])
        w = self.weights.get(kind)
        return by_votes, by_votes if w is None else float(1 / (1 + np.exp(-np.clip(w[found].sum(), -30, 30))))


_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("found", pa.list_(pa.int32()))])
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


@released
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t in b.column(1):
            text = t.as_py() or ""
            out.append([{"kind": k, "start": s, "end": e, "base": base, "votes": votes(text, k, s, e, base), "found": features(text, k, s, e)} for k, s, e, base in candidates(text)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(_CANDIDATE))], names=["doc_id", "candidates"])


def learn(read: DataFrame, train_spans: int = TRAIN_SPANS) -> Model:
    """The model of all candidates of ``read`` (doc_id, candidates). Counts of vote patterns, a few thousand at most, and the sample come to the driver."""
    every = read.filter(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.*")
    counts = every.groupBy("kind", "votes", "base").count().collect()
    model, known, sizes = Model(), {}, {}
    for k in {r["kind"] for r in counts}:
        own = sorted((tuple(r["votes"]), r["base"], r["count"]) for r in counts if r["kind"] == k)
        patterns = np.array([v for v, *_ in own], np.int64)
        given = np.array([1.0 if base else 0.0 if v[CHECK] < 0 else np.nan for v, base, _ in own])
        share, table, p = reliabilities(patterns, np.array([n for *_, n in own]), given)
        model.labelers[k] = share, table
        known[k] = {(v, base): x for (v, base, _), x in zip(own, p.tolist(), strict=True)}
        sizes[k] = sum(n for *_, n in own)
    uniform = F.pmod(F.xxhash64("start", "end", "found", F.lit(3)), F.lit(1_000_003)) / F.lit(1_000_003)
    share = F.coalesce(*(F.when(F.col("kind") == k, F.lit(train_spans / n)) for k, n in sizes.items()), F.lit(0.0))
    picked = every.filter(uniform < share).groupBy("kind", "votes", "base", "found").count()  # equal spans come once
    for_kind: dict[int, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["kind"], r["votes"], r["base"], r["found"])):
        for_kind.setdefault(r["kind"], []).append((r["found"], known[r["kind"]][tuple(r["votes"]), r["base"]]))
    for k, own in for_kind.items():
        model.weights[k] = train([x for x, _ in own], np.array([p for _, p in own]))
    return model


def private_spans(docs: DataFrame, train_spans: int = TRAIN_SPANS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, spans) for each row of ``docs`` (doc_id, text; others are ignored): an array of (kind, start, end, base, score) by kind as in ``KINDS``, then start.

    Places count code points; the score is the classifier's. Further candidates overlap neither base spans nor each other. A null or empty text has
    no spans. Repeated rows and null ids give rows of their own, and each counts for what is learned; an empty table gives none. The patterns take time
    linear in a text's length.
    """
    scratch = scratch or Scratch(docs.sparkSession, "private")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, candidates array<struct<kind:int,start:long,end:long,base:boolean,votes:array<int>,found:array<int>>>"
    read = scratch.save(src.mapInArrow(_read, schema), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(learn(read, train_spans))  # a few tables of fixed size

    @released
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for found in b.column(1).to_pylist():
                spans = []
                for c in found:
                    by_votes, score = model.scores(c["kind"], np.array(c["votes"]), c["found"])
                    if c["base"] or c["votes"][CHECK] >= 0 and min(by_votes, score) >= 0.5:
                        spans.append({"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "base": c["base"], "score": score})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return read.mapInArrow(decide, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
