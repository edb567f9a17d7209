"""Alignment of the tokens of two tokenizers over the same bytes.

A text is tokenised whole by a byte-level BPE (A) and by a SentencePiece BPE (B). Places where tokens of both end, and the next
token of both starts with a space, are anchors: they cut a document into windows of token ids. What a window holds (groups
between shared ends, links between overlapping tokens) depends on its ids alone, so it is worked out once for each
different pair of id tuples and remembered.

How many documents hold a linked pair is counted over the corpus. The documents keep their different pairs with the number of
links; frequent pairs are looked up in a broadcast table of bounded size, the others are joined.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import id_and_text, stored, texts_of
from tabloom.llm.token_counts import pieces_of
from tabloom.llm.tokens import byte_pairs

#: Remembered windows, and words, of a Python worker; beyond this many only the first half stays. It has no influence on results.
MEMORY = 250_000
#: Windows of more tokens and words of more characters than this are worked out each time.
LONGEST = 64
#: Texts are read in stretches of about this many characters that end before a single space between two other characters:
#: neither tokenizer has a token across such a place.
STRETCH = 1 << 19
LONE_SPACE = re.compile(r"(?<=[^\s\x00-\x20▁]) (?=[^\s\x00-\x20▁])")
#: Entries of the broadcast table of frequent pairs.
HEAD = 1 << 18

MARK = "▁"
#: Ids of B are below ``WIDTH``; a pair is one number ``a * WIDTH + b``. Where ids of both stand together, those of B come after ``OFFSET``.
WIDTH = 1 << 17
OFFSET = 1 << 16


def first_half(known: dict) -> dict:
    """What was remembered first: most of it is frequent."""
    return dict(islice(known.items(), MEMORY // 2))


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the windows worked out so far."""

    def __init__(self, a: str, b: str):
        self.a = byte_pairs(a)
        pieces = pieces_of(b)
        self.b, self.cuts = pieces.library, pieces.cuts
        self.a_bytes = [b""] * self.a.size
        for k in range(self.a.encoding.n_vocab):
            self.a_bytes[k] = self.a.encoding.decode_single_token_bytes(k)
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(MARK, " ").encode())
        if len(self.a_bytes) > OFFSET or len(self.b_bytes) > WIDTH:
            raise ValueError(f"{a} has more than {OFFSET} tokens or {b} more than {WIDTH}")
        self.a_length, self.b_length = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        both = [*self.a_bytes, *[b""] * (OFFSET - len(self.a_bytes)), *self.b_bytes]
        self.length, self.spaced = np.array([len(x) for x in both], np.int64), np.array([x[:1] == b" " for x in both])
        #: Each id as text with the sign after it: a comma, or at the end of a group a bar after A and a semicolon after B.
        self.printed = [b"%d%s" % (k, end) for size, last in ((OFFSET, b"|"), (len(self.b_bytes), b";")) for k in range(size) for end in (b",", last)]
        self.printed_length = np.array([len(x) for x in self.printed], np.int64)
        self.words: dict[str, bytes] = {}
        self.windows: dict[bytes, tuple[int, bytes, bytes]] = {}

    def stretches(self, text: str) -> Iterator[str]:
        """Parts of a text with the space between them left out, which both tokenizers put before a text again.

        A pre-token of A never goes on with a space after another character, and it takes a lone space together with what follows. B
        puts a mark before a text and merges nothing across the place before a mark (``cuts``; other models get no stretches).
        """
        at = 0
        while self.cuts and len(text) - at > STRETCH and (found := LONE_SPACE.search(text, at + STRETCH)):
            yield text[at:found.start()]
            at = found.end()
        yield text[at:]

    def tokenised(self, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of A and, ``OFFSET`` higher, of B of one stretch, and both behind each other part by part.

        No token crosses a lone space of a model that can be cut, so what stands between two of them is encoded once and remembered.
        """
        parts = LONE_SPACE.split(text) if self.cuts else [text]
        known = self.words
        found = list(map(known.get, parts))
        new = list({p for p, ids in zip(parts, found) if ids is None})
        if new:
            if len(known) > MEMORY:
                known = self.words = first_half(known)
            plain = self.a.plain
            fresh = {p: array("I", plain(" " + p) + [k + OFFSET for k in ids]).tobytes() for p, ids in zip(new, self.b.encode(new, num_threads=1))}
            found = [fresh[p] if ids is None else ids for p, ids in zip(parts, found)]
            known.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST)
        both = np.frombuffer(b"".join(found), np.uint32)
        of_a = both < OFFSET
        return both[of_a], both[~of_a], found

    def work_out(self, keys: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Number of groups, the groups as text, and the linked pairs of each window, worked out from the ids of all of them at once:
        windows one after the other are aligned like one text, as each ends with both tokenizers."""
        both = np.frombuffer(b"".join(keys), np.uint32).astype(np.int64)
        of_a = both < OFFSET
        a, b = both[of_a], both[~of_a] - OFFSET
        end_a, end_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        first, last = np.searchsorted(end_b, end_a - self.a_length[a], side="right"), np.searchsorted(end_b, end_a)
        links = last - first + 1
        before = np.cumsum(links)
        pairs = np.repeat(a, links) * WIDTH + b[np.arange(before[-1]) + np.repeat(first - before + links, links)]
        shared_a, shared_b = end_b[last] == end_a, np.zeros(len(b), bool)
        shared_b[last[shared_a]] = True
        group_a, group_b = (np.cumsum(x) - x for x in (shared_a, shared_b))
        # The tokens in the order of the text: those of A before those of B in each group.
        code = np.empty(len(both), np.int64)
        code[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + shared_a
        code[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * (b + OFFSET) + shared_b
        text = b"".join(map(self.printed.__getitem__, code.tolist()))
        to_token = np.cumsum([len(k) // 4 for k in keys])
        to_a = np.cumsum(of_a)[to_token - 1]
        groups = np.diff(np.cumsum(shared_a)[to_a - 1], prepend=0).tolist()
        to_text, to_link = np.cumsum(self.printed_length[code])[to_token - 1].tolist(), (8 * before[to_a - 1]).tolist()
        raw = pairs.tobytes()
        return [(n, text[i:k - 1], raw[j:m]) for n, i, k, j, m in zip(groups, [0, *to_text], to_text, [0, *to_link], to_link)]

    def cut(self, text: str) -> tuple[int, int, list[bytes]] | None:
        """Numbers of tokens and the windows of one stretch, each as its ids of A and then of B; None if the tokens of A or B do not spell it."""
        if self.cuts and MARK in text:
            return None  # a mark of the text would read as a space
        a, b, parts = self.tokenised(text)
        whole = (" " + text).encode()
        end_a, end_b = np.cumsum(self.a_length[a]), np.cumsum(self.length[b])
        # Ids of A are merged bytes of the text, and those of a model that can be cut merged pieces, so their lengths tell.
        if end_a[-1] != len(whole) or end_b[-1] != len(whole) or not self.cuts and b"".join(map(self.b_bytes.__getitem__, (b - OFFSET).tolist())) != whole:
            return None
        at_b = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at_b] == end_a)
        last_b = at_b[last_a]
        anchor = np.ones(len(last_a), bool)
        anchor[:-1] = self.spaced[a[last_a[:-1] + 1]] & self.spaced[b[last_b[:-1] + 1]]
        to_a, to_b = last_a[anchor] + 1, last_b[anchor] + 1
        if len(to_a) == len(parts) and np.array_equal(4 * (to_a + to_b), np.cumsum([len(x) for x in parts])):
            return len(a), len(b), parts  # the anchors are where the parts end
        # The ids of a window of A and those of B behind each other, window by window.
        ids = np.empty(len(a) + len(b), np.uint32)
        ids[np.arange(len(a)) + np.repeat(np.append(0, to_b[:-1]), np.diff(to_a, prepend=0))] = a
        ids[np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))] = b
        ends = (4 * (to_a + to_b)).tolist()
        raw = ids.tobytes()
        return len(a), len(b), [raw[i:j] for i, j in zip([0, *ends], ends)]

    def align(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Numbers of tokens of A and B, of groups and links, the digest of the groups, the different pairs and their links."""
        n_a = n_b = n_groups = 0
        digest, pairs, known = hashlib.sha256(), [], self.windows
        for number, stretch in enumerate(self.stretches(text) if text else ()):
            if (found := self.cut(stretch)) is None:
                return NOTHING
            n_a, n_b = n_a + found[0], n_b + found[1]
            if len(known) > MEMORY:
                known = self.windows = first_half(known)
            keys = found[2]
            done = list(map(known.get, keys))
            new = list({key for key, window in zip(keys, done) if window is None})
            if new:
                fresh = dict(zip(new, self.work_out(new)))
                done = [window or fresh[key] for key, window in zip(keys, done)]
                known.update((key, window) for key, window in fresh.items() if len(key) <= 4 * LONGEST)
            counts, texts, links = zip(*done)
            n_groups += sum(counts)
            digest.update(b";" * (number > 0) + b";".join(texts))
            pairs.append(np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True))
        if not n_a:
            return NOTHING
        pair, times = pairs[0]
        if len(pairs) > 1:
            pair, where = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
            times = np.bincount(where, np.concatenate([t for _, t in pairs])).astype(np.int64)
        return n_a, n_b, n_groups, int(times.sum()), digest.hexdigest(), pair, times


NOTHING = 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)


@cache
def vocabularies(a: str, b: str) -> Vocabularies:
    """One per Python worker."""
    return Vocabularies(a, b)


def arrays(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


def align_texts(docs: DataFrame, a: str, b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A stored table with a row per document: counts, digest, its different linked ``pair`` numbers and the ``links`` of each."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(a, b)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(zip(*map(both.align, texts_of(part.column("text")))))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *(pa.array(x, pa.int64()) for x in found[:4]), pa.array(found[4]),
                                                  arrays(found[5], pa.int64()), arrays(found[6], pa.int32())],
                                                 ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "links"])

    texts = id_and_text(docs, id_column, text_column).withColumn("row", F.monotonically_increasing_id())
    return stored(texts.mapInArrow(aligned, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                            "pair array<long>, links array<int>"), "aligned")


def head_of(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The pairs with at least so many documents that no more than ``most`` remain, and that number."""
    power = F.floor(F.log2("n") * 4)
    sizes = {r.power: (r.least, r["count"]) for r in counts.groupBy(power.alias("power")).agg(F.min("n").alias("least"), F.count("*").alias("count")).collect()}
    held, least = 0, None  # a row for each quarter of a power of two
    for k in sorted(sizes, reverse=True):
        held += sizes[k][1]
        if held > most:
            break
        least = sizes[k][0]
    least = 1 << 62 if least is None else least
    return counts.where(F.col("n") >= least), least


def align(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k.model", id_column: str = "doc_id", text_column: str = "text",
          head: int = HEAD) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every document, its text taken whole.

    ``n_best`` are the links whose pair is held by as many documents as any pair of its A id, ``count_sum`` adds up those numbers of
    documents over all links. Null and empty texts, and texts that the tokens of A or B do not spell (a ``▁`` in the text), have no
    tokens: zeros and an empty digest. Null ids stay null; repeated rows are documents of their own and each get their row; an
    empty table gives none. Only id and text are read.
    """
    held = align_texts(docs, a, b, id_column, text_column)
    # A task adds up its pairs before the shuffle, so a pair that all documents hold is one row a task.
    counts = stored(held.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    best_of = counts.groupBy(F.floor(F.col("pair") / WIDTH).alias("a")).agg(F.max("n").alias("best"))
    frequent, least = head_of(counts, head)
    tops = {r.a: r.best for r in best_of.collect()}  # a row for each id of A at most
    best = np.zeros(1 + max(tops, default=0), np.int64)
    best[list(tops)] = list(tops.values())
    table = frequent.toArrow()  # ``head`` rows at most
    order = np.argsort(table["pair"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((table["pair"].to_numpy()[order], table["n"].to_numpy()[order], best))

    def places(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair stands in the table of frequent ones, and whether it does."""
        known = shared.value[0]
        at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        return at, known[at] == pair if len(known) else np.zeros(len(pair), bool)

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = batch.column("pair").value_lengths().to_numpy()
        return np.repeat(np.arange(batch.num_rows), size), batch.column("pair").flatten().to_numpy(), batch.column("links").flatten().to_numpy().astype(np.int64)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, times, top = shared.value
        for batch in batches:
            doc, pair, links = parts(batch)
            at, there = places(pair)
            doc, pair, links, n = doc[there], pair[there], links[there], times[at[there]]
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, doc, np.where(n == top[pair // WIDTH], links, 0))
            np.add.at(total, doc, n * links)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", *KEPT)), pa.array(n_best), pa.array(total)], ["row", *KEPT, "n_best", "count_sum"])

    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, pair, links = parts(batch)
            rest = ~places(pair)[1]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("row").to_numpy()[doc[rest]]), pa.array(pair[rest]), pa.array(links[rest])], ["row", "pair", "links"])

    kept = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    known = held.mapInArrow(looked_up, kept)
    # Each of the other pairs is held by fewer than ``least`` documents; the best of an A id comes along with its count.
    others = (counts.where(F.col("n") < least).withColumn("a", F.floor(F.col("pair") / WIDTH)).join(F.broadcast(best_of), "a")
              .select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best")))
    rest = (held.select("row", "pair", "links").mapInArrow(left_over, "row long, pair long, links long").join(others, "pair")
            .groupBy("row").agg(F.sum(F.col("links") * F.col("is_best")).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")))
    both = known.unionByName(rest, allowMissingColumns=True)
    whole = both.groupBy("row").agg(*(F.max(c).alias(c) for c in KEPT), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


#: Columns of a document that are final once it is aligned.
KEPT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
