from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import token_counts

MODEL = "piece_bpe_32k.model"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  ", "  a  b   c    ", "\n", "a\n", "a \n  ", "\n ", "<s> </s> <unk> <0x0A>", "漢字\u3000かな 🙂", "▁a▁▁b ▁", "\x00 \x00",
         "word " * 5000, "x" * 3000, "the quick\tbrown  fox\r\njumps"]


def test_model_can_be_cut():
    assert token_counts.pieces_of(MODEL).cuts


def test_counts_of_odd_texts():
    texts = [t or "" for t in TEXTS]
    assert token_counts.Pieces(MODEL).counts(texts, {}) == [len(x) for x in LIBRARY.encode(texts)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("  ab th\n\t▁é漢🙂<s>in")), max_size=25))
def test_counts_of_random_texts(text):
    assert token_counts.pieces_of(MODEL).counts([text], {}) == [len(LIBRARY.encode(text))]


def test_eviction_keeps_the_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    pieces = token_counts.Pieces(MODEL)
    for text in ("one two three four five", "one six seven", "one two", "eight"):
        assert pieces.counts([text], {"one": 1}) == [len(LIBRARY.encode(text))]


def test_query(spark, folder):
    got = token_counts.count_tokens(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = Counter((r.doc_id, len(r.text.encode()), n := len(LIBRARY.encode(r.text)), n > 4096) for r in docs)
    assert Counter(map(tuple, got)) == want


def test_edge_cases(spark):
    rows = [(f"x{k}", k, t, k) for k, t in enumerate(TEXTS)] + [("", None, "a b", None)] * 2
    df = spark.createDataFrame(rows, "key string, doc_id long, text string, n_tokens int")
    got = Counter(map(tuple, token_counts.count_tokens(df, most=100).collect()))
    assert got == Counter((i, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 100) for _, i, t, _ in rows)
    assert token_counts.count_tokens(df.limit(0)).count() == 0
