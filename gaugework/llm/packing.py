"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity.

A piece of ``s`` tokens goes where the sum over all residual gaps of (number of open
sequences with that gap) squared becomes smallest; moving a sequence from gap ``h`` to ``h - s``
changes it by ``2 * (N[h - s] - N[h]) + 2``, so one vector operation compares all gaps.

Pieces are dealt evenly over partitions and every partition is packed on its own, as a stream:
memory holds the open sequences of one partition.  The only loss against one global packing
are the sequences still open at the end of each partition, and a partition has the size that
adaptive execution aims at (about a million pieces).  Long pieces come first in decreasing
length and the short ones, in hashed order, fill the gaps that are left.

Defined cases: a NULL text is empty; an empty text is one piece that holds the end token;
repeated rows are packed as often as they occur, whatever their ids; NULL ids are kept; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import extended, slices, strings

CAPACITY = 2048
END_ID = 0
#: Pieces up to this share of the capacity are placed last.
SHORT = 8
#: Words whose ids a worker remembers, in each of two generations, and their longest: some 60 MB a generation at most.
REMEMBERED, LONGEST = 200_000, 32

_LOADED: dict[int, tuple] = {}


class Words:
    """The ids of words, as bytes; what has not come up for a whole generation is forgotten."""

    def __init__(self, encode: Callable[[list[str]], dict[str, bytes]]) -> None:
        self.encode, self.young, self.old = encode, {}, {}

    def ids(self, words: list[str]) -> list[bytes]:
        young, old, unknown = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    unknown.append(w)
        new = self.encode(unknown) if unknown else {}
        found = [young[w] if w in young else new[w] for w in words]
        young.update((w, own) for w, own in new.items() if len(w) <= LONGEST)
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return found


def _words(vocabulary: bytes) -> Words:
    """The words of a vocabulary; loaded once per worker."""
    key = zlib.crc32(vocabulary)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(vocabulary)
        tokenizer.encode_special_tokens = True
        names = tokenizer.get_vocab()
        ends = np.zeros(max(names.values()) + 1, bool)
        ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        _LOADED[key] = Words(lambda words: _learn(words, tokenizer, ends))
    return _LOADED[key]


def _learn(words: list[str], tokenizer, ends: np.ndarray) -> dict[str, bytes]:
    """The ids of words.

    Words of letters only are one token group each, so they can be encoded as one text, which
    is several times faster than one by one; the count of word ends proves that it held.
    """
    known: dict[str, bytes] = {}
    letters = [w for w in words if w.isalpha()]
    if letters:
        ids = np.array(tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, np.uint32)
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) == len(letters):
            flat, start = ids.tobytes(), 0
            for word, stop in zip(letters, (4 * stops).tolist(), strict=True):
                known[word] = flat[start:stop]
                start = stop
    rest = [w for w in words if w not in known]
    for word, encoded in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        known[word] = np.array(encoded.ids, np.uint32).tobytes()
    return known


def encode_words(texts: pa.Array, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, ends)``: the ids of all texts in a row, and where each text ends.

    The tokenizer ignores white space and case and never joins tokens across white space or between
    a letter and following punctuation, so texts are cut there and every different word is
    encoded once.
    """
    # The dotted capital I is left out: in lower case it ends with a mark that is no letter.
    apart = pc.replace_substring_regex(
        pc.ascii_lower(texts), pattern=r"([^\P{L}\x{130}])([.,:;!?%*&$#|])", replacement=r"\1 \2"
    )
    words = pc.ascii_split_whitespace(apart)
    index = words.flatten().dictionary_encode()
    distinct = index.dictionary.to_pylist()
    ids = _words(vocabulary).ids(distinct)
    n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), np.uint32)
    at = index.indices.to_numpy(zero_copy_only=False)
    lengths = n[at]
    ends = np.cumsum(lengths)
    gather = np.repeat((np.cumsum(n) - n)[at] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
    offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
    return flat[gather], np.concatenate(([0], ends))[offsets[1:]]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Every text as ids plus the end token, cut every ``capacity`` ids; ``keep_ids`` adds the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = strings(batch.column(1)), batch.column(0)
            for at, many in slices(texts):
                ids, ends = encode_words(texts.slice(at, many), shared.value)
                rows: list[tuple] = []
                start = 0
                for i, end in enumerate(ends.tolist()):
                    own = np.append(ids[start:end], np.uint32(end_id)).astype("<u4")
                    start = end
                    for k in range(0, len(own), capacity):
                        part = own[k : k + capacity]
                        rows.append((i, k // capacity, k, len(part), zlib.crc32(part.tobytes()), part))
                cols = list(zip(*rows, strict=True))
                out = [
                    doc_ids.slice(at, many).take(pa.array(cols[0], pa.int64())),
                    pa.array(cols[1], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in cols[2:5]),
                ]
                if keep_ids:
                    sizes = np.cumsum([0, *cols[3]]).astype(np.int32)
                    flat = pa.array(np.concatenate(cols[5]).astype(np.int32))
                    out.append(pa.ListArray.from_arrays(pa.array(sizes), flat))
                yield pa.RecordBatch.from_arrays(out, names=re.findall(r"(\w+) (?:array<)?\w+", schema))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


class Packer:
    """Online sum-of-squares packing; ``place`` answers ``(sequence, offset)``."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        cap, counts = self.capacity, self.counts
        if not 0 < size <= cap:
            raise ValueError(f"a piece has 1 to {cap} tokens, not {size}")
        # Index: the gap afterwards.  An index is possible if a sequence with gap + size is open;
        # the last one is a new sequence.
        now = counts[size:]
        change = 2 * (counts[: cap + 1 - size] - now) + 2
        change[0] -= 2 * counts[0] + 1
        change[now == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * counts[cap - size] + 1 if size < cap else 0
        gap = int(change.argmin())
        if gap == cap - size:
            sequence, offset = self.made, 0
            self.made += 1
        else:
            sequence, offset = self.open[gap + size].pop(), cap - gap - size
            counts[gap + size] -= 1
        if gap:
            counts[gap] += 1
            self.open[gap].append(sequence)
        return sequence, offset


def pack(items: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``) plus ``sequence_id`` and gapless ``offset``.

    ``key`` names columns that make the order within a partition repeatable.
    """
    items = items.drop("sequence_id", "offset")
    schema = extended(items, sequence_id="bigint", offset="bigint")
    order = [
        F.when(F.col("length") * SHORT > capacity, -F.col("length")).otherwise(F.lit(0)),
        F.xxhash64(*key),
        *(F.col(k) for k in (*key, "length")),
    ]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([base + s for s, _ in placed], pa.int64()),
                    pa.array([o for _, o in placed], pa.int64()),
                ],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    return items.hint("rebalance").sortWithinPartitions(*order).mapInArrow(fill, schema)


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset each is placed at."""
    with open(vocabulary_path, "rb") as file:
        vocabulary = file.read()
    return pack(pieces(docs, vocabulary, capacity, keep_ids=keep_ids), capacity)
