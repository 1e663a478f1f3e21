import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm.token_counts import token_counts
from loamline.llm.tokenization import PieceCounts, WordIds

MODEL, VOCAB = "piece_bpe_32k.model", "word_bpe_49k.json"
ODD = [
    "", " ", "  ", "\n", " \n", "\n ", "a\n\nb", "a b", " a", "a  b ", "a\tb", "▁x ▁ y", "<s>a</s>", "<unk>", "<0x0A>", " x　y", "\r\n x",
    "café ́x", "\U0001f600\U0001f600", "\x00a", "I'M don'T <|endoftext|>x <|startoftext|>", "ΣΣΣ İx", "x" * 5000, " " * 300, "a\x0bb\x1cc\x85d e",
    "漢字 かな。\nA1b22", "ﬁx Å",
]


@pytest.fixture(scope="module")
def tools():
    return PieceCounts(MODEL), WordIds(VOCAB)


def check(tools, t):
    pieces, words = tools
    assert sum(pieces.memo[p] for p in pieces.pre_tokens(t)) == pieces.direct(t), repr(t)
    ids = words.tok.encode(t, add_special_tokens=False).ids
    assert words(t) == b"".join(i.to_bytes(4, "little") for i in ids), repr(t)


def test_odd_texts(tools):
    for t in ODD:
        check(tools, t)
        check(tools, t + " " + t + "\n" + t)


def test_every_letter_before_every_stop(tools):
    """Composed letters that the normaliser takes apart leave a mark that joins the stop."""
    _, words = tools
    letters = [c for c in map(chr, [*range(0x80, 0x3400), *range(0xA000, 0xABFF), *range(0xF900, 0xFFDD), *range(0x10000, 0x11800)]) if c.isalpha()]
    parts = [c + stop for c in letters for stop in ".,!?:;"] + ["ab" + c + "," for c in letters]
    wrong = [p for p, e in zip(parts, words.tok.encode_batch(parts, add_special_tokens=False), strict=True) if words(p) != b"".join(i.to_bytes(4, "little") for i in e.ids)]
    assert not wrong, wrong[:20]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\ta.1'<|>s▁́é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(tools, t):
    check(tools, t)


def test_corpus(tools):
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist():
        check(tools, t)


def test_token_counts(spark, tools):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "a b", None), (7, None, "x"), (7, None, "x")]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL, 40).collect()), key=str)
    want = [(i, len((t or "").encode()), tools[0].direct(t or ""), tools[0].direct(t or "") > 40) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_chunks_and_buckets(spark, tools, monkeypatch):
    """Small chunks, rows and buckets give the library's counts of whole documents, too."""
    from loamline.llm import token_counts as tc

    for name, value in (("CHUNK_PRE", 500), ("CHUNK_ENTRIES", 3000), ("ROW_ENTRIES", 400), ("BUCKET_DOCS", 20)):
        monkeypatch.setattr(tc, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert got == {r.doc_id: tools[0].direct(r.text or "") for r in docs.collect()}
