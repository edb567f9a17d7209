"""SentencePiece segmentations drawn at random: forward filtering, backward sampling over the piece lattice.

The lattice of a text has an edge for every vocabulary piece that fits, and for each character without a piece an edge of its
UTF-8 byte pieces. An edge weighs (r + 1) ** -theta for a piece of rank r, so frequent pieces are likely (this vocabulary
has ranks, not probabilities). Forward filtering sums the weights of all segmentations up to each character; backward
sampling then draws the last piece, the piece before it, and so on, which gives every segmentation its exact share. No
piece crosses the place before a run of space marks, so these stretches are independent: the filter runs once for each
different stretch of a batch, and the draws for each occurrence. A draw depends on the seed, the row key and the place in
the text only, so a segmentation can be repeated whatever the partitioning.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tabloom.llm.common import id_and_text, text_bytes, texts_of
from tabloom.llm.token_counts import pieces_of

MARK, SPACE = 0x2581, 0x20
#: Stands for a mark that is part of the text; it has no piece and so is written as bytes.
LITERAL_MARK = 0x200000
#: Characters that are worked on together.
BATCH_CHARS = 1 << 20
MAYBE_BITS = 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal numbers give equal results on every machine."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattice:
    """The vocabulary of a model, ready to look up all substrings of many strings at once."""

    def __init__(self, name: str):
        if not pieces_of(name).cuts:
            raise ValueError("the model has pieces or a normalisation that this lattice does not cover")
        library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.size = library.vocab_size()
        pieces = [library.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i) or library.is_byte(i))]
        self.byte_id = np.zeros(256, np.int64)
        self.output = [b""] * self.size
        for i in range(self.size):
            if library.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
                self.output[i] = bytes([int(pieces[i][3:5], 16)])
        for i in normal:
            self.output[i] = pieces[i].replace("▁", " ").encode()
        ranked = sorted(normal, key=lambda i: (-library.get_score(i), i))
        self.rank = np.full(self.size, len(ranked), np.int64)
        self.rank[ranked] = np.arange(len(ranked))
        self.longest = max(len(pieces[i]) for i in normal)
        codes = [np.array([ord(c) for c in pieces[i]], np.uint64) for i in normal]
        keys = np.array([list(self.substrings(c, len(c)))[-1][0] for c in codes], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        assert (self.keys[1:] != self.keys[:-1]).all()
        #: By the upper bits of a hash: whether any key has them. Most substrings are no pieces, and few of those pass this.
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - MAYBE_BITS)] = True

    @staticmethod
    def substrings(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        """For length 1, 2, ... the hashes of all substrings of this length."""
        key = np.full(len(codes), _BASE, np.uint64)
        for length in range(1, min(longest, len(codes)) + 1):
            key = (key[:len(codes) - length + 1] ^ codes[length - 1:]) * np.uint64(_BASE)
            key ^= key >> np.uint64(32)
            yield key


@cache
def lattice_of(name: str) -> Lattice:
    """One per Python worker."""
    return Lattice(name)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, with the mark that stands before each non-empty one, and where each text ends."""
    whole = "".join(f" {t}" for t in texts if t)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes == MARK, LITERAL_MARK, np.where(codes == SPACE, MARK, codes))
    return codes, np.cumsum([len(t) + 1 if t else 0 for t in texts])


def stretches(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the independent stretches begin: at marks after another character, and at the beginning of texts."""
    begins = (codes == MARK) & np.r_[True, codes[:-1] != MARK] if len(codes) else np.zeros(0, bool)
    begins[ends[:-1][ends[:-1] < len(codes)]] = True
    return np.flatnonzero(begins)


def distinct(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence of each different stretch, and for all occurrences the number of theirs."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()) - 1, _BASE, np.uint64)])
    offset = np.arange(len(codes)) - np.repeat(begin, size)
    sums = np.add.reduceat(mix(codes.astype(np.uint64)) * powers[offset], begin)
    _, first, number = np.unique(mix(sums + size.astype(np.uint64)), return_index=True, return_inverse=True)
    # A hash only proposes; every character is compared with its representative's.
    if (size[first][number] == size).all() and (codes[np.repeat(begin[first][number], size) + offset] == codes).all():
        return first, number
    return np.arange(len(begin)), np.arange(len(begin))


def forward(vocabulary: Lattice, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, theta: float) -> tuple[np.ndarray, ...]:
    """Filters stretches that follow each other in ``codes``.

    Nodes stand for last characters: first the first characters of all stretches, longest stretch first, then the second ones,
    and so on, so every step of the filter works on slices. Returns the node of each character, ``[node, length - 1]`` the
    piece (-1: byte pieces) and the cumulated share of the pieces that end there, and the logarithm of the total weight of
    each stretch.
    """
    n, most = len(codes), min(vocabulary.longest, int(size.max()))
    by_size = np.argsort(-size, kind="stable")
    rank = np.empty(len(size), np.int64)
    rank[by_size] = np.arange(len(size))
    alive = np.searchsorted(-size[by_size], -np.arange(int(size.max())), side="left")  # stretches that have a t-th character
    base = np.cumsum(alive) - alive
    offset = np.arange(n) - np.repeat(begin, size)
    node = base[offset] + np.repeat(rank, size)
    ids = np.full((n, most), -2, np.int32)
    share = np.full((n, most), -np.inf)
    cost = theta * np.log1p(np.arange(len(vocabulary.keys) + 1))
    for length, key in enumerate(vocabulary.substrings(codes.astype(np.uint64), most), 1):
        last = np.flatnonzero((offset[length - 1:] >= length - 1) & vocabulary.maybe[key >> np.uint64(64 - MAYBE_BITS)])
        key = key[last]
        place = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
        hit = vocabulary.keys[place] == key
        found, at = vocabulary.ids[place[hit]], node[last[hit] + length - 1]
        ids[at, length - 1] = found
        share[at, length - 1] = -cost[vocabulary.rank[found]]
    utf8 = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000) * (codes != LITERAL_MARK)
    bare = np.flatnonzero(ids[node, 0] == -2)
    ids[node[bare], 0] = -1
    share[node[bare], 0] = -cost[-1] * utf8[bare]
    total = np.empty(n)
    for t, (low, width) in enumerate(zip(base.tolist(), alive.tolist())):  # the t-th character of all stretches that have one
        reach = min(t + 1, most)
        parts = share[low:low + width, :reach].copy()
        for length in range(1, min(reach, t) + 1):
            parts[:, length - 1] += total[base[t - length]:base[t - length] + width]
        top = parts.max(axis=1)
        parts = np.exp(parts - top[:, None])
        final = reach - 1 - np.argmax(parts[:, ::-1] > 0, axis=1)
        upto = np.cumsum(parts, axis=1)
        total[low:low + width] = top + np.log(upto[:, -1])
        upto /= upto[:, -1:]
        upto[np.arange(reach)[None, :] >= final[:, None]] = 2.0  # the last possible piece takes any rest
        share[low:low + width, :reach] = upto
        share[low:low + width, reach:] = 2.0
    return node, ids, share, total[node[begin + size - 1]]


def sample(vocabulary: Lattice, texts: list[str], row_keys: np.ndarray, theta: float, seed: int) -> list[np.ndarray]:
    """The drawn piece ids of each text."""
    codes, ends = codes_of(texts)
    if not len(codes):
        return [np.zeros(0, np.int64) for _ in texts]
    begin = stretches(codes, ends)
    size = np.diff(np.r_[begin, len(codes)])
    text_of = np.searchsorted(ends, begin, side="right")
    text_begin = np.r_[0, ends[:-1]]
    place = begin - text_begin[text_of]
    stream = mix(mix(row_keys.astype(np.int64).view(np.uint64) + np.uint64(seed % 2**64)))[text_of]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    while low < len(begin):  # a bounded number of characters at a time, also of a long text
        high = max(low + 1, int(np.searchsorted(begin + size, begin[low] + BATCH_CHARS, side="right")))
        some, base = slice(low, high), begin[low]
        part = codes[base:begin[high - 1] + size[high - 1]]
        first, number = distinct(part, begin[some] - base, size[some])
        own_size = size[some][first]
        own_begin = np.cumsum(own_size) - own_size
        own_codes = part[np.repeat(begin[some][first] - base - own_begin, own_size) + np.arange(int(own_size.sum()))]
        node, ids, share, _ = forward(vocabulary, own_codes, own_begin, own_size, theta)
        active, left = np.arange(low, high), size.copy()
        while len(active):
            last = node[own_begin[number[active - low]] + left[active] - 1]
            draw = mix(stream[active] + (place[active] + left[active]).astype(np.uint64) * np.uint64(_BASE))
            u = (draw >> np.uint64(11)) * 2.0**-53
            row = (u[:, None] >= share[last]).sum(axis=1)
            found.append((begin[active] + left[active] - 1 - row, ids[last, row]))
            left[active] -= row + 1
            active = active[left[active] > 0]
        low = high
    at = np.concatenate([f[0] for f in found])  # first character of each piece; no two pieces share one
    piece_at = np.full(len(codes), -2, np.int64)
    piece_at[at] = np.concatenate([f[1] for f in found])
    at = np.flatnonzero(piece_at != -2)
    chosen = piece_at[at]
    bare = chosen == -1
    raw = [list("▁".encode()) if c == LITERAL_MARK else list(chr(c).encode()) for c in codes[at[bare]].tolist()]
    times = np.ones(len(at), np.int64)
    times[bare] = [len(r) for r in raw]
    out = np.repeat(chosen, times)
    out[np.repeat(bare, times)] = vocabulary.byte_id[[b for r in raw for b in r]] if raw else 0
    cuts = np.r_[0, np.cumsum(times)][np.searchsorted(at, ends)]
    return np.split(out, cuts[:-1])


def decode(vocabulary: Lattice, ids: np.ndarray) -> bytes:
    """The text of piece ids in UTF-8."""
    return b"".join([vocabulary.output[i] for i in ids.tolist()])[1:]


def segment(docs: DataFrame, model: str = "piece_bpe_32k.model", theta: float = 1.0, seed: int = 17, id_column: str = "doc_id", text_column: str = "text",
            with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, lossless)`` (and ``ids`` on request) per document.

    ``ids_crc32`` is over little-endian 32-bit ids, ``decoded_sha256`` over the decoded text, which ``lossless`` compares with the text.
    Null and empty texts have no pieces; a null id draws like the id -1; rows with the same id and text get the same segmentation.
    An empty table gives no rows. Other columns are not read.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice_of(model)
        for batch in batches:
            texts, at = texts_of(batch.column("text")), 0
            while at < batch.num_rows:
                end, chars = at, 0
                while end < batch.num_rows and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                part = batch.slice(at, end - at)
                keys = np.array([-1 if k is None else k for k in part.column("doc_id").to_pylist()], np.int64)
                ids = sample(vocabulary, texts[at:end], keys, theta, seed)
                source = list(text_bytes(part.column("text")))
                back = [decode(vocabulary, x) for x in ids]
                columns = {"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(x) for x in source], pa.int64()), "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                           "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                           "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), "lossless": pa.array([a == b for a, b in zip(source, back)], pa.bool_())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)
                at = end

    kinds = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    return id_and_text(docs, id_column, text_column).mapInArrow(drawn, kinds + (", ids array<long>" if with_ids else ""))
