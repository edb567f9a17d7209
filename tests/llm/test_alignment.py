import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabloom.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
#: The byte of each character of the byte-level alphabet.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHERS = [b for b in range(256) if b not in PRINTED]
BYTE = {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(OTHERS)}
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [None, "", " ", "a", " a", "a ", "The quick  brown fox\njumps over <|endoftext|> the </s> dog.", "a▁b", "漢字 かな 🙂 é", "tab\tand  two", "\x00 nul",
         "The quick brown fox", "don't we'll 123 4567 'tis", "word " * 3000, "x" * 3000, "\n\n a \r\n b", "fin de l’année —  ok", "　 wide \x85 next"]


def tokens(text):
    """Ids and byte strings of both tokenizers, or None where they do not spell the text."""
    whole = (" " + text).encode()
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    spell_a = [bytes(BYTE[c] for c in A.id_to_token(k)) for k in a]
    spell_b = [bytes([int(B.id_to_piece(k)[3:5], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode() for k in b]
    return (a, b, spell_a, spell_b) if text and b"".join(spell_a) == whole == b"".join(spell_b) else None


def ranges(spelled):
    at = 0
    for s in spelled:
        yield at, at + len(s)
        at += len(s)


def brute(rows):
    """Everything from the definitions: all byte ranges against each other."""
    done, holders = [], Counter()
    for doc_id, text in rows:
        found = tokens(text or "")
        if found is None:
            done.append((doc_id, None, [], ""))
            continue
        a, b, spell_a, spell_b = found
        ra, rb = list(ranges(spell_a)), list(ranges(spell_b))
        near = defaultdict(list)  # B tokens by each byte they cover
        for j, (s, e) in enumerate(rb):
            for x in range(s, e):
                near[x].append(j)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(ra) for j in sorted({j for x in range(s, e) for j in near[x]})]
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = [",".join(str(k) for k, (_, e) in zip(a, ra) if low < e <= high) + "|" + ",".join(str(k) for k, (_, e) in zip(b, rb) if low < e <= high)
                  for low, high in zip([0, *ends], ends)] if len(text) < 5000 else None
        done.append((doc_id, (len(a), len(b), len(ends)), links, groups))
        holders.update(set(links))
    best = Counter()
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, sizes, links, groups in done:
        if sizes is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            digest = None if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((doc_id, *sizes, len(links), sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links), digest))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) if k != 7 else "" for k, x in enumerate(r))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert w[7] is None or g == w


def test_small_corpus(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "The fox"), (7, "The fox"), (7, "The fox")]
    docs = spark.createDataFrame([(*r, "x", 3, [1]) for r in rows], "doc_id long, text string, row string, n_a int, pair array<int>")
    df = alignment.align(docs)
    assert df.columns == COLUMNS
    same(df.collect(), brute(rows))
    assert alignment.align(docs.limit(0)).count() == 0


@pytest.mark.parametrize("head", [0, 500])
def test_rare_pairs_by_the_join(spark, folder, head):
    """The same rows whether pairs are found in the broadcast table, joined, or some of each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted(map(tuple, alignment.align(docs).collect()))
    assert sorted(map(tuple, alignment.align(docs, head=head).collect())) == want


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    same(alignment.align(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("  ab the\n\t▁é漢🙂'<s>1　\x85in")), max_size=60))
def test_stretches_change_nothing(text):
    both = alignment.vocabularies("byte_bpe_50k", "piece_bpe_32k.model")
    found = tokens(text)
    usual, alignment.STRETCH = alignment.STRETCH, 2
    try:
        cut = both.align(text)
    finally:
        alignment.STRETCH = usual
    whole = both.align(text)
    assert cut[:5] == whole[:5] and list(cut[5]) == list(whole[5]) and list(cut[6]) == list(whole[6])
    assert whole[:2] == ((0, 0) if found is None else (len(found[0]), len(found[1])))


def test_memory_is_only_a_memory(monkeypatch):
    both = alignment.Vocabularies("byte_bpe_50k", "piece_bpe_32k.model")
    text = "one two three, four five one two " * 40
    want = both.align(text)
    monkeypatch.setattr(alignment, "MEMORY", 1)
    for _ in range(3):
        assert both.align(text)[:5] == want[:5]
