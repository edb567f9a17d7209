"""Token counts of whole texts by a two-tier lookup on the map side.

A text is cut into pre-tokens at places that no merge can cross. The lengths (in tokens) of frequent pre-tokens come from a
small table that is broadcast; misses are encoded by the library and remembered in a cache of the Python worker. So no
pre-token is ever shuffled, and the counts are those of encoding the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tabloom.llm.common import id_and_text, texts_of

#: Pre-tokens in the broadcast table, at most, taken from at most this many documents (those with the smallest hashes of their
#: ids). Both bound the cost of the table; which pre-tokens it holds has no influence on any count.
TABLE_ENTRIES = 1 << 15
TABLE_ROWS = 2000
#: Further pre-tokens that a worker remembers at most, and the longest one that is remembered.
CACHE_ENTRIES = 400_000
LONGEST = 64

SPACE = "\u2581"
PARTS = re.compile(" *[^ ]+| +")


class Pieces:
    """Pre-tokens of a SentencePiece BPE model and their numbers of pieces.

    A model qualifies if it only marks spaces (no other normalisation), puts one mark before the text, keeps repeated
    spaces, has no user-defined symbols, and if no piece has a mark after another character: then no merge crosses the
    place before a run of marks, and each run with the characters after it can be encoded alone.
    """

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        form, train = model.normalizer_spec, model.trainer_spec
        pieces = [p.piece for p in model.pieces if p.type == 1]
        self.cuts = (train.model_type == 2 and not form.precompiled_charsmap and form.add_dummy_prefix and form.escape_whitespaces
                     and not form.remove_extra_whitespaces and not train.treat_whitespace_as_suffix and train.byte_fallback
                     and not any(p.type == 4 for p in model.pieces) and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces))
        self.known: dict[str, int] = {}

    def keys(self, text: str) -> list[str]:
        """Strings whose counts add up to that of ``text``. A key is encoded with a mark before it; one that starts with a
        line feed stands for the spaces after it, at the end of a text."""
        if not self.cuts:
            return [text]
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ") if text else []
        parts = PARTS.findall(text)
        keys = [parts[0], *(p[1:] for p in parts[1:])]
        if len(parts) > 1 and not parts[-1].strip(" "):
            keys[-1] = "\n" + parts[-1]
        return keys

    def lengths(self, keys: list[str]) -> list[int]:
        """Pieces of each key."""
        tail = [self.cuts and k[:1] == "\n" and not k[1:].strip(" ") and len(k) > 1 for k in keys]
        # After a line feed nothing merges with the mark before it, so mark and line feed count two.
        return [len(ids) - 2 * t for ids, t in zip(self.library.encode(keys, num_threads=1), tail)]

    def counts(self, texts: list[str], table: dict[str, int]) -> list[int]:
        if not self.known or len(self.known) > CACHE_ENTRIES + len(table):
            self.known = dict(table)
        known = self.known
        keys = [self.keys(t) for t in texts]
        misses = list(set(chain.from_iterable(keys)).difference(known))
        known.update(zip(misses, self.lengths(misses)))
        result = [sum(map(known.__getitem__, ks)) for ks in keys]
        for k in misses:
            if len(k) > LONGEST:
                del known[k]
        return result


@cache
def pieces_of(name: str) -> Pieces:
    """One per Python worker."""
    return Pieces(name)


def frequent(texts: DataFrame, model: str) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens in a bounded sample of ``texts(doc_id, text)``."""
    drawn = F.xxhash64(F.col("doc_id"), F.lit(11))
    last = texts.select(drawn.alias("h")).orderBy("h").limit(TABLE_ROWS).agg(F.max("h")).first()[0]
    if last is None:
        return {}

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, times = pieces_of(model), Counter()
        for batch in batches:
            for text in texts_of(batch.column("text")):
                times.update(k for k in pieces.keys(text) if len(k) <= LONGEST)
        top = [k for k, _ in sorted(times.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array(pieces.lengths(top), pa.int64())], ["key", "n"])

    return dict(texts.where(drawn <= last).limit(TABLE_ROWS).mapInArrow(ranked, "key string, n long").limit(TABLE_ENTRIES).collect())


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", most: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per document, by the SentencePiece ``model``.

    Null and empty texts have 0 bytes and 0 tokens, null ids stay null, repeated rows each get their row, and an empty table
    gives none. Special strings are ordinary text, as the library takes them. Other columns are not read.
    """
    texts = id_and_text(docs, id_column, text_column)
    table = docs.sparkSession.sparkContext.broadcast(frequent(texts, model))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = np.array(pieces.counts(texts_of(part.column("text")), table.value), np.int64)
                sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > most)],
                                                 ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
