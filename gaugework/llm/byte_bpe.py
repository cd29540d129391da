"""Byte-level BPE by the tiktoken library, with the ranks of a local file, and back to bytes.

Long texts are cut at places where no match of the split pattern can end up on both sides, so
the ids are those of the whole text and the library's regular expression never sees more than
one chunk (it runs out of stack on very long runs of white space):

* before a single space between two word characters;
* around a very long run of white space.  The pattern takes all of a run but the character before
  the next word as one match, so that part is encoded as the single piece it is.

Defined cases: a NULL text is empty and has no ids; a lone run without a safe place stays
one chunk; repeated rows and NULL ids are kept; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored.  Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import slices, strings

CHUNK = 1 << 16
LONG_RUN = 1 << 12
_CUT = re.compile(r"(?<=\w) (?=\w)")
# The white space of the Unicode standard, as the library's pattern has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")

_LOADED: dict[tuple[int, str], object] = {}


def encoding(ranks: bytes, pattern: str):
    """The library's encoder for the content of a rank file; loaded once per worker."""
    key = (zlib.crc32(ranks), pattern)
    if key not in _LOADED:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _LOADED[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _LOADED[key]


def chunks(text: str) -> Iterator[str]:
    """Parts of a text without long runs of white space, cut at safe places."""
    start = 0
    while len(text) - start > CHUNK:
        cut = _CUT.search(text, start + CHUNK)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, encoder) -> list[int]:
    if len(text) <= LONG_RUN:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        for part in chunks(text[start : run.start()]):
            ids += encoder.encode_ordinary(part)
        ids += encoder._encode_single_piece(text[run.start() : stop])
        start = stop
    for part in chunks(text[start:]):
        ids += encoder.encode_ordinary(part)
    return ids


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids``: the ids of every text as little-endian unsigned 32-bit integers.

    ``decoded`` adds the bytes that the ids stand for, made from the ids alone.
    """
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    names = ["doc_id", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value, pattern)
        for batch in batches:
            texts = strings(batch.column(1))
            for at, many in slices(texts):
                ids = [encode_text(t, encoder) for t in texts.slice(at, many).to_pylist()]
                out = [
                    batch.column(0).slice(at, many),
                    pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary()),
                ]
                if decoded:
                    out.append(pa.array([encoder.decode_bytes(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id bigint, ids binary" + (", decoded binary" if decoded else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded`` from the ``ids`` of :func:`encode`; NULL ids give NULL."""
    with open(ranks_path, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [
                    None if x is None else encoder.decode_bytes(np.frombuffer(x, "<u4").tolist())
                    for x in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.binary())], names=["doc_id", "decoded"]
                )

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id bigint, decoded binary")
