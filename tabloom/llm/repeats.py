"""Removal of repeated passages, by blockwise suffix sorting of the places that can repeat.

A byte goes if it lies in a string of ``LENGTH`` bytes (a gram) that also starts in a document with a smaller id.

1. Texts are put into compressed blocks of bounded size, a table bucketed by block, so later joins do not move them.
2. The least hash among the short grams inside a gram (its minimizer) is the same wherever the gram occurs. Each block sends
   the distinct codes of its minimizers to hash buckets, which answer with the codes that other blocks hold as well.
3. For shared codes, a block sends the runs of grams with that code: each distinct string of bytes once, with the
   smallest id that it has there. All occurrences of a gram meet in the bucket of its code.
4. A bucket sorts the suffixes of its strings, one bounded part at a time, with a difference cover (see ``suffixes``), finds
   the grams that are equal, and answers which of them occur in a smaller document. The grams of a code with more than
   ``PART`` of them are dealt out one by one instead, by a hash of the whole gram, each once for a block with its smallest id.
5. The blocks mark the bytes of these grams and give what is left.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import stored
from tabloom.llm.suffixes import cover_ranks, equal_next, leading_words, sort_suffixes
from tabloom.session import shared_folder

LENGTH = 50
#: Bytes of the short grams of which the least hash counts.
SHORT = 24
BLOCK_BYTES = 4 << 20
#: Codes have this many bits, and their upper part is the bucket. Different minimizers with one code only make more candidates.
CODE_BITS = 48
#: Bytes of text for each bucket, which bounds what a bucket's task holds; and suffixes that are sorted at once.
BUCKET_BYTES = 4 << 20
PART = 200_000
#: A block tells how many distinct grams a code has if there are more than this; a run seldom has more.
LISTED = 32
NO_ID = (1 << 63) - 1


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(a).to_bytes(4, "little") + a.dtype.str[1:].encode() + a.tobytes() for a in arrays))


def expand(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at:at + 4], "little"), np.dtype(raw[at + 4:at + 6].decode())
        out.append(np.frombuffer(raw, kind, n, at + 6))
        at += 6 + n * kind.itemsize
    return out


def blocks_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` as blocks: the text, ends of the documents in it and their ids in ``data``, all columns but the text in ``rest``."""
    order = [c for c in docs.columns if c != text_column]
    key = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NO_ID))
    source = docs.select(*[F.col(f"`{c}`") for c in order], F.struct(key.alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).alias("__block"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(parts).combine_chunks()
            inner = table.column("__block").combine_chunks()
            texts = [t or b"" for t in inner.field("text").cast(pa.binary()).to_pylist()]
            whole = b"".join(texts)
            data = squeeze(np.frombuffer(whole, np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64), inner.field("id").to_numpy(zero_copy_only=False).astype(np.int64))
            rest, sink = table.drop_columns(["__block"]).append_column("__null", inner.field("text").is_null()), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rest)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(whole)], pa.int64()), pa.array([data], pa.binary()),
                                               pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "n_bytes", "data", "rest"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # so that a block ends soon after it is full
                parts.append(batch.slice(at, 64))
                size += sum(len(x.as_buffer()) for x in parts[-1].column("__block").field("text") if x.is_valid)
                if size >= BLOCK_BYTES:
                    yield block()
                    parts, size = [], 0
        if parts:
            yield block()

    return source.mapInArrow(packed, "block long, n_bytes long, data binary, rest binary")


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` stored in the shared folder in buckets by ``block``, so a join on it needs no shuffle of this side."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", shared_folder(df.sparkSession, name)).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def runs_of(text: bytes, ends: np.ndarray, code_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring grams of one document with the same minimizer: start, number of grams, code, document."""
    n, width = len(text), LENGTH - SHORT + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none
    begins = np.r_[0, ends[:-1]]
    long = ends - begins >= LENGTH
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    inside, before, was_real = 0, np.zeros(1, np.uint64), False
    step = 1 << 18
    for at in range(0, n - LENGTH + 1, step):  # a part at a time stays in the processor's cache
        upto = min(n - LENGTH + 1, at + step)
        size = upto - at + width - 1
        code = np.zeros(size, np.uint64)
        for k in range(0, SHORT, 8):
            code ^= np.ndarray((size,), "<u8", text, offset=at + k, strides=(1,))
            code *= np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
        have = 1
        while 2 * have <= width:
            code = np.minimum(code[:-have], code[have:])
            have *= 2
        least = np.minimum(code[:upto - at], code[width - have:][:upto - at])
        real = inside + np.cumsum(edge[at:upto], dtype=np.int32) > 0
        fresh = np.r_[least[:1] != before, least[1:] != least[:-1]]
        starts = np.flatnonzero(real & (fresh | ~np.r_[was_real, real[:-1]]))
        stops = np.flatnonzero(~real & np.r_[was_real, real[:-1]])  # one past the last gram of a document
        found.append((starts + at, least[starts], stops + at))
        inside, before, was_real = inside + int(edge[at:upto].sum(dtype=np.int32)), least[-1:], bool(real[-1])
    start, value = (np.concatenate([f[k] for f in found]) for k in range(2))
    closed = np.r_[np.concatenate([f[2] for f in found]), n - LENGTH + 1]
    # A run ends where the next one starts or where its document has no further gram.
    stop = np.minimum(np.r_[start[1:], n], closed[np.searchsorted(closed, start, side="right")]) if len(start) else none
    mixed = value * np.uint64(0x94D049BB133111EB)  # the least hashes crowd at the low end; this spreads them
    return start, stop - start, mixed >> np.uint64(64 - code_bits), np.searchsorted(ends, start, side="right")


def small(numbers: np.ndarray) -> np.ndarray:
    """The same numbers (none negative) in the narrowest type."""
    most = int(numbers.max(initial=0))
    return numbers.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def split_by_bucket(codes: np.ndarray, bits: int, code_bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted codes."""
    bucket = (codes >> np.uint64(code_bits - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(first, np.r_[first[1:], len(bucket)].astype(np.int64) if len(first) else []):
        yield int(bucket[a]), slice(int(a), int(b))


def as_bytes(codes: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each code."""
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def from_bytes(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel().astype(np.uint64)


def words_at(text: bytes, at: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of the grams that begin at ``at``, eight at a time."""
    words = np.ndarray((max(0, len(text) - 7),), "<u8", text, strides=(1,))
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        yield words[at + k].astype(np.uint64)


def gram_hash(text: bytes, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for word in words_at(text, at):
        out ^= word
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def gram_starts(start: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where each gram of the runs begins."""
    return np.repeat(start, grams) + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)


def first_equal(text: bytes, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each gram the index of the first one that equals it; ``codes`` are the grams' hashes. The hash only proposes, so grams
    that differ are never taken for one (then an equal one may be missed, which only sends it twice)."""
    order = np.argsort(codes, kind="stable")
    opens = np.r_[True, codes[order][1:] != codes[order][:-1]] if len(order) else np.zeros(0, bool)
    first = np.empty(len(at), np.int64)
    first[order] = order[np.flatnonzero(opens)][np.cumsum(opens) - 1] if len(order) else order
    equal = np.ones(len(at), bool)
    for own, other in zip(words_at(text, at), words_at(text, at[first])):
        equal &= own == other
    return np.where(equal, first, np.arange(len(at)))


def many_grams(text: bytes, start: np.ndarray, grams: np.ndarray, which: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes (by their index ``which`` of each run) with more than LISTED grams, and how many distinct ones they have."""
    many = np.bincount(which, grams, n_codes) > LISTED
    runs = many[which]
    hashes = gram_hash(text, gram_starts(start[runs], grams[runs]))
    once = np.unique(hashes, return_index=True)[1]  # equal grams have equal codes
    distinct = np.bincount(np.repeat(which[runs], grams[runs])[once], minlength=n_codes)
    return np.flatnonzero(many), distinct[many]


def shared_codes(blocks: DataFrame, bits: int, code_bits: int) -> DataFrame:
    """``(block, codes, hot, n_hot)``: for each block the codes that it shares with another block, in several rows.

    ``hot`` are those of them that may have more than PART distinct grams, counted block by block, over all blocks. The sum of
    ``n_hot`` is no less than the number of grams that all blocks together send for hot codes.
    """
    size = -(-(code_bits - bits) // 8)  # the bucket's number stands for the upper bits

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                text, ends, _ = expand(data.as_py())
                text = text.tobytes()
                start, grams, code, _ = runs_of(text, ends, code_bits)
                codes, which = np.unique(code, return_inverse=True)
                at, amount = many_grams(text, start, grams, which, len(codes))
                parts = list(split_by_bucket(codes, bits, code_bits))
                counts = []
                for _, s in parts:
                    own = slice(*np.searchsorted(at, [s.start, s.stop]))
                    counts.append(np.stack([at[own] - s.start, amount[own]]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()),
                                                  pa.array([as_bytes(codes[s], size) for _, s in parts], pa.binary()), pa.array(counts, pa.binary())],
                                                 ["bucket", "block", "codes", "counts"])

    def answered(table: pa.Table) -> pa.Table:
        numbers = table.column("block").to_numpy()
        upper = np.uint64(table.column("bucket")[0].as_py() << (code_bits - bits))
        parts = [from_bytes(x.as_py(), size) | upper for x in table.column("codes")]
        sizes = [len(p) for p in parts]
        codes, which = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
        amount = np.full(len(codes), LISTED, np.int64)
        for base, listed in zip(np.cumsum(sizes) - sizes, table.column("counts")):
            at, n = np.frombuffer(listed.as_py(), "<u4").reshape(2, -1).astype(np.int64)
            amount[base + at] = n
        order = np.argsort(codes, kind="stable")
        codes, which, amount = codes[order], which[order], amount[order]
        same = codes[1:] == codes[:-1]
        common = np.r_[same, False] | np.r_[False, same]
        codes, which, amount = codes[common], which[common], amount[common]
        change = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        totals = np.add.reduceat(amount, change) if len(codes) else change
        hot = np.repeat(totals > PART, np.diff(np.r_[change, len(codes)]))
        back = np.argsort(which, kind="stable")
        codes, which, hot = codes[back], which[back], hot[back]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, np.int64)
        bounds = list(zip(first, np.r_[first[1:], len(codes)])) if len(which) else []
        n_hot = np.zeros(len(first), np.int64)
        n_hot[:1] = totals[totals > PART].sum()
        return pa.table({"block": pa.array(numbers[which[first]] if len(which) else [], pa.int64()),
                         "codes": pa.array([as_bytes(codes[a:b], code_bits // 8) for a, b in bounds], pa.binary()),
                         "hot": pa.array([as_bytes(codes[a:b][hot[a:b]], code_bits // 8) for a, b in bounds], pa.binary()), "n_hot": pa.array(n_hot)})

    found = blocks.select("block", "data").mapInArrow(sent, "bucket long, block long, codes binary, counts binary")
    return found.groupBy("bucket").applyInArrow(answered, "block long, codes binary, hot binary, n_hot long")


def candidates(blocks: DataFrame, shared: DataFrame, bits: int, code_bits: int, places: bool, deals: int = 1) -> DataFrame:
    """``(block, bucket, data)``: the strings of each block for each bucket or, as ``places``, where they occur in the block.

    The grams of the distinct strings are numbered; a string that occurs again in a block, in a larger document, is settled there.
    Strings of hot codes are sent as their distinct grams, in ``deals`` further buckets; a gram that occurs again in them
    (a twin) gets the answer of the first, which has the smallest id of the block.
    """
    size = -(-(code_bits - bits) // 8)
    joined = blocks.select("block", "data").join(shared.groupBy("block").agg(F.collect_list("codes").alias("codes"), F.collect_list("hot").alias("hot")), "block", "left")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, *lists in zip(batch.column("block").to_pylist(), *(batch.column(c) for c in ("data", "codes", "hot"))):
                rows = list(of_block(data.as_py(), *([from_bytes(c, code_bits // 8) for c in x.as_py() or []] for x in lists)))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                                                  pa.array([r[1] for r in rows], pa.binary())], ["block", "bucket", "data"])

    def of_block(data: bytes, codes: list[np.ndarray], hot: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        text, ends, ids = expand(data)
        text = text.tobytes()
        start, grams, code, doc = runs_of(text, ends, code_bits)
        owner = ids[doc]
        # Shared with another block, or with another document of this one.
        elsewhere = np.isin(code, np.concatenate(codes)) if codes else np.zeros(len(code), bool)
        order = np.lexsort((owner, code))
        first = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(code) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(code)])
        several = owner[order][first] != owner[order][first + sizes - 1] if len(first) else np.zeros(0, bool)
        inside = np.zeros(len(code), bool)
        inside[order] = np.repeat(several, sizes)
        use = np.flatnonzero(elsewhere | inside)
        use = use[np.argsort(owner[use], kind="stable")]
        known: dict[bytes, int] = {}
        string = np.array([known.setdefault(text[s:e], len(known)) for s, e in zip(start[use].tolist(), (start[use] + grams[use] + LENGTH - 1).tolist())], np.int64)
        place = np.unique(string, return_index=True)[1]  # the first has the smallest id
        lead = use[place]
        base = np.cumsum(grams[lead]) - grams[lead]
        again = owner[use] > owner[lead][string]
        dealt = np.isin(code[lead], np.concatenate(hot)) if hot else np.zeros(len(lead), bool)
        loose = lead[dealt]
        at, gram, whose = gram_starts(start[loose], grams[loose]), gram_starts(base[dealt], grams[loose]), np.repeat(owner[loose], grams[loose])
        hashes = gram_hash(text, at)
        first_one = first_equal(text, at, hashes)  # owners ascend, so the first has the smallest id
        if places:
            twin = np.flatnonzero(first_one != np.arange(len(at)))
            yield -1, squeeze(small(start[use]), small(grams[use]), small(base[string]), again.astype(np.uint8), small(gram[twin]),
                              small(gram[first_one[twin]]), (whose[twin] > whose[first_one[twin]]).astype(np.uint8))
            return
        send = np.flatnonzero(first_one == np.arange(len(at)))
        deal = (hashes[send] % np.uint64(deals)).astype(np.int64)
        by_deal = np.argsort(deal, kind="stable")
        send, deal = send[by_deal], deal[by_deal]
        first = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]]) if len(deal) else []
        for a, b in zip(first, np.r_[first[1:], len(deal)].astype(np.int64) if len(first) else []):
            own = send[a:b]
            ids_here, holder = np.unique(whose[own], return_inverse=True)
            yield (1 << bits) + int(deal[a]), squeeze(ids_here, small(holder), small(gram[own]), np.frombuffer(b"".join([text[p:p + LENGTH] for p in at[own].tolist()]), np.uint8))
        by_code = np.argsort(code[lead], kind="stable")
        by_code = by_code[~dealt[by_code]]
        strings = list(known)
        sorted_lead = lead[by_code]
        for bucket, part in split_by_bucket(code[sorted_lead], bits, code_bits):
            which, own = by_code[part], sorted_lead[part]
            ids_here, whose = np.unique(owner[own], return_inverse=True)
            yield bucket, squeeze(np.frombuffer(as_bytes(code[own], size), np.uint8), ids_here, small(whose), small(grams[own]), small(base[which]),
                                  np.frombuffer(b"".join([strings[w] for w in which.tolist()]), np.uint8))

    return joined.mapInArrow(found, "block long, bucket long, data binary")


def repeated_grams(text: bytes, begin: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For all grams of the strings that begin in ``text`` at ``begin``: whether an equal one has a smaller owner."""
    words = leading_words(text)
    whose = np.repeat(np.arange(len(begin)), grams)
    starts = begin[whose] + np.arange(len(whose)) - np.repeat(np.cumsum(grams) - grams, grams)
    ordered = sort_suffixes(words, cover_ranks(words, len(text)), starts)
    place = np.searchsorted(starts, ordered)  # starts ascend
    first = np.flatnonzero(np.r_[True, ~equal_next(words, ordered, LENGTH)])
    least = np.minimum.reduceat(owner[whose[place]], first)
    smaller = np.empty(len(starts), bool)
    smaller[place] = np.repeat(least, np.diff(np.r_[first, len(starts)])) < owner[whose[place]]
    return smaller


def repeated_alone(text: bytes, owner: np.ndarray) -> np.ndarray:
    """For all grams that stand in ``text`` one after the other: whether an equal one has a smaller owner."""
    keys = list(words_at(text, np.arange(len(owner)) * LENGTH))
    order = np.lexsort(keys)
    differs = np.zeros(len(owner) - 1, bool)
    for k in keys:
        differs |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(np.r_[True, differs])
    smaller = np.empty(len(owner), bool)
    smaller[order] = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.r_[first, len(owner)])) < owner[order]
    return smaller


def settled(strings: DataFrame, bits: int, code_bits: int) -> DataFrame:
    """``(block, flags)``: ranges of gram numbers of a block that occur in a smaller document, in several rows."""
    size = -(-(code_bits - bits) // 8)

    def answered(table: pa.Table) -> pa.Table:
        numbers = table.column("block").to_numpy()
        parts = [expand(x.as_py()) for x in table.column("data")]
        if table.column("bucket")[0].as_py() >> bits:  # grams of hot codes
            owner, number = np.concatenate([p[0][p[1]] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
            from_block = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
            smaller = repeated_alone(b"".join([p[3].tobytes() for p in parts]), owner)
            return by_block(numbers, from_block[smaller], number[smaller], number[smaller] + 1)
        code = np.concatenate([from_bytes(p[0].tobytes(), size) for p in parts])  # of one bucket, so the lower bits tell them apart
        owner = np.concatenate([p[1][p[2]] for p in parts])
        grams, base = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (3, 4))
        which = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
        text = b"".join([p[5].tobytes() for p in parts])
        del parts
        begin = np.cumsum(grams + LENGTH - 1) - (grams + LENGTH - 1)
        order = np.argsort(code, kind="stable")
        change = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
        total = np.cumsum(grams[order])
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):  # whole codes, of PART suffixes together or one code alone
            limit = np.searchsorted(total, (total[at - 1] if at else 0) + PART, side="right")
            later = change[change > at]
            fits = later[later <= limit]
            end = int(fits[-1]) if len(fits) and limit < len(order) else len(order) if limit >= len(order) else int(later[0]) if len(later) else len(order)
            own = order[at:end]
            at = end
            pieces = [text[b:b + g + LENGTH - 1] for b, g in zip(begin[own].tolist(), grams[own].tolist())]
            sizes = grams[own] + LENGTH - 1
            smaller = repeated_grams(b"".join(pieces), np.cumsum(sizes) - sizes, grams[own], owner[own])
            number = np.arange(len(smaller)) - np.repeat(np.cumsum(grams[own]) - grams[own], grams[own])
            whose = np.repeat(own, grams[own])
            opens = np.flatnonzero(smaller & (np.r_[True, ~smaller[:-1]] | (number == 0)))
            closes = np.flatnonzero(smaller & (np.r_[~smaller[1:], True] | (number == grams[whose] - 1)))
            out.append((which[whose[opens]], base[whose[opens]] + number[opens], base[whose[opens]] + number[closes] + 1))
        return by_block(numbers, *(np.concatenate([o[k] for o in out]) for k in range(3)))

    def by_block(numbers: np.ndarray, from_block: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Table:
        back = np.argsort(from_block, kind="stable")
        from_block, low, high = from_block[back], low[back], high[back]
        first = np.flatnonzero(np.r_[True, from_block[1:] != from_block[:-1]]) if len(from_block) else np.zeros(0, np.int64)
        bounds = list(zip(first, np.r_[first[1:], len(from_block)])) if len(first) else []
        return pa.table({"block": pa.array(numbers[from_block[first]], pa.int64()),
                         "flags": pa.array([squeeze(small(low[a:b]), small(high[a:b])) for a, b in bounds], pa.binary())})

    return strings.groupBy("bucket").applyInArrow(answered, "block long, flags binary")


def removed_bytes(text: bytes, places: list[np.ndarray], flags: list[list[np.ndarray]]) -> np.ndarray:
    """Which bytes of a block go."""
    start, grams, base, again, twin, of, larger = places
    start, grams, base = (x.astype(np.int32) for x in (start, grams, base))  # a block has far fewer bytes and grams
    n_grams = int((base + grams).max(initial=0))
    edge = np.zeros(n_grams + 1, np.int8)
    for low, high in flags:
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
    flagged = np.cumsum(edge[:-1], dtype=np.int8) > 0  # every gram is flagged once at most
    flagged[twin] = flagged[of] | (larger > 0)
    first = np.cumsum(grams) - grams
    number = np.arange(int(grams.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), grams)
    goes = flagged[np.repeat(base, grams) + number] | np.repeat(again > 0, grams)
    at = (np.repeat(start, grams) + number)[goes]
    del number, goes
    # A gram starts at each place once at most, so no byte lies in more than LENGTH of them.
    edge = np.zeros(len(text) + 1, np.int8)
    edge[at] += 1
    edge[at + LENGTH] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The same marks without those on characters of which a byte stays."""
    edge = np.diff(np.r_[False, gone, False].view(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = lambda at: (text[np.minimum(at, len(text) - 1)] & 0xC0 == 0x80) & (at < len(text))
    for _ in range(3):  # a character has three bytes after its first at most
        start = start + inner(start)
        stop = stop - inner(stop)
    start, stop = start[start < stop], stop[start < stop]
    edge[:] = 0
    edge[start] = 1
    edge[stop] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_column: str, text_column: str, with_text: bool = False, code_bits: int = CODE_BITS) -> DataFrame:
    """All columns of ``docs`` but the text, and the results of each document; on request also ``left``: what is left of the
    text by whole characters (a null text stays null)."""
    spark = docs.sparkSession
    # As many buckets as shuffle partitions, so that the other side of a join is dealt out alike and this side stays in place.
    blocks = bucketed(blocks_of(docs, id_column, text_column), "text_blocks", int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(4, min(24, int(total // BUCKET_BYTES).bit_length()))
    shared = stored(shared_codes(blocks, bits, code_bits), "shared-codes")
    # The strings go straight into a shuffle. Their places are found again for the last step: that takes less disk than
    # writing all of it, and a block gives the same numbers each time.
    deals = int(shared.agg(F.sum("n_hot")).first()[0] or 0) // PART + 1
    flags = settled(candidates(blocks, shared, bits, code_bits, False, deals), bits, code_bits)
    places = candidates(blocks, shared, bits, code_bits, True).select("block", F.col("data").alias("places"))
    joined = (blocks.select("block", "data", "rest").join(places, "block")
              .join(flags.groupBy("block").agg(F.collect_list("flags").alias("flags")), "block", "left"))
    names = [x.split()[0] for x in RESULT.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, rest, place, flag in zip(*(batch.column(c) for c in ("data", "rest", "places", "flags"))):
                text, ends, _ = expand(data.as_py())
                others = pa.ipc.open_stream(rest.as_py()).read_all()
                gone = removed_bytes(text.tobytes(), expand(place.as_py()), [expand(f) for f in flag.as_py() or []])
                begins = np.r_[0, ends[:-1]]
                rises = gone & np.r_[True, ~gone[:-1]] if len(gone) else gone
                at = begins[begins < len(text)]
                rises[at] = gone[at]
                total, spans = (np.r_[np.int32(0), np.cumsum(x, dtype=np.int32)] for x in (gone, rises))
                left = pieces(text, gone, ends)
                table = others.drop_columns(["__null"])
                for name, column in zip(names, (ends - begins, total[ends] - total[begins], spans[ends] - spans[begins])):
                    table = table.append_column(name, pa.array(column.astype(np.int64)))
                table = table.append_column(names[-1], pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()))
                if with_text:
                    texts = pa.array([x.decode() for x in pieces(text, whole_characters(text, gone), ends)], pa.string())
                    table = table.append_column("left", pc.if_else(others.column("__null"), pa.scalar(None, pa.string()), texts))
                yield from table.to_batches()

    schema = T.StructType([f for f in docs.schema if f.name != text_column])
    for x in (RESULT + (", left string" if with_text else "")).split(", "):
        schema = schema.add(*x.split())
    return joined.mapInArrow(cut, schema)


def pieces(text: np.ndarray, gone: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes that stay, by document."""
    kept = text[~gone].tobytes()
    upto = ends - np.r_[np.int32(0), np.cumsum(gone, dtype=np.int32)][ends]
    return [kept[a:b] for a, b in zip(np.r_[0, upto[:-1]].tolist(), upto.tolist())]


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", code_bits: int = CODE_BITS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document; see the module.

    A null text is empty, a null id counts as larger than any other, documents with the same id (repeated rows too) do not
    remove each other's bytes, and an empty table gives no rows. Other columns are not read.
    """
    bare = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return remove_repeats(bare, "doc_id", "text", code_bits=code_bits)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with the repeated passages cut out of the text, by whole characters.

    Rows of which nothing is left go; rows that were empty stay. ``length_column``, if there is one, gets the new number of
    characters where a text changed. All other columns are as they were, whatever they are called.
    """
    others = [c for c in docs.columns if c != text_column]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text_column}`").alias("__text"))
    left = remove_repeats(renamed, f"c{others.index(id_column)}", "__text", with_text=True)
    left = left.where("n_removed = 0 OR left <> ''")
    made = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text_column: F.col("left").cast(docs.schema[text_column].dataType)}
    if length_column in others:
        made[length_column] = F.when(F.col("n_removed") > 0, F.char_length("left")).otherwise(made[length_column]).cast(docs.schema[length_column].dataType)
    return left.select(*[made[c].alias(c) for c in docs.columns])
