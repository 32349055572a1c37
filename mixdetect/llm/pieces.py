"""SentencePiece encoding and decoding through tables of distinct chunks.

A model that cuts at white space has no piece in which another character
stands before a whitespace marker.  A text may then be cut before any marker
that follows another character, and the chunks (marked words) segment
independently of each other.  :func:`check_model` reads this off the model's
pieces and refuses models for which it does not hold.

Each task keeps a table of the chunks it has met.  A chunk is segmented once,
when it enters the table; a document's ids are its chunks' ids joined by their
positions.  Nothing is shuffled: a table shared by all tasks would send every
position through two shuffles and back to its document, several times the
input, to save the segmentation of one word in ten.  A table is emptied when
it holds ``TABLE_CHUNKS`` chunks, and chunks of more than ``LONG_CHUNK``
characters are segmented where they stand, so memory is bounded.

The model is given as a path and never trained here.  The driver reads the
file; its bytes go to the executors as one broadcast (of under
``MAX_MODEL_BYTES``, checked).

Defined results: null and empty texts have no ids and decode to an empty
text; repeated rows give a row each; an empty table gives an empty result;
extra columns are ignored; a text that holds the marker itself (U+2581) is
encoded as the library does, as white space.  Whole texts are encoded, however
long.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
#: Fixed value: the marker that stands for a space in pieces.
MARKER = "▁"
MAX_MODEL_BYTES = 64_000_000
#: Chunks a task's table holds, and characters of the longest chunk in it.
TABLE_CHUNKS = 300_000
LONG_CHUNK = 256

_CUT = re.compile(f"(?<=[^ {MARKER}]) ")
_RUN = re.compile(f"[ {MARKER}] |^ ")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_bounded(path: str, limit: int = MAX_MODEL_BYTES) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(limit + 1)
    if len(raw) > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    return raw


@functools.lru_cache(maxsize=2)
def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(sp) -> None:
    """Refuse a model with a piece that crosses into the next marker, or that changes texts before it cuts them."""
    inner = re.compile(f"[^{MARKER}]{MARKER}")
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if inner.search(p)]
    if crossing:
        raise ValueError(f"pieces such as {crossing[0]!r} cross a whitespace marker, chunks cannot be segmented apart")
    probe = " a  b 　 ﬁ①é\t\n "
    if sp.encode("") or sp.decode(sp.encode(probe)) != probe:
        raise ValueError("the model normalises texts or adds ids of its own, chunks cannot be segmented apart")


def chunks(text: str) -> list[str]:
    """The text's marked words, each without its first marker, which the library adds again."""
    if not text:
        return []
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


def chunk_ids(sp, chunk: str) -> list[int]:
    """Ids of the marker and the chunk after it."""
    return sp.encode(chunk, num_threads=1) if chunk else [sp.piece_to_id(MARKER)]


class ChunkTable(dict):
    """chunk -> (number of ids, the ids, the ids as text): segmented when first asked for."""

    def __init__(self, sp, limit: int = TABLE_CHUNKS):
        super().__init__()
        self.sp, self.limit = sp, limit

    def __missing__(self, chunk: str):
        ids = chunk_ids(self.sp, chunk)
        entry = (len(ids), ids, ",".join(map(str, ids)))
        if len(chunk) <= LONG_CHUNK:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = entry
        return entry

    def document(self, text: str | None) -> tuple[int, list[int], str]:
        found = [self[c] for c in chunks(text or "")]
        return sum(e[0] for e in found), list(chain.from_iterable(e[1] for e in found)), ",".join([e[2] for e in found])


def _mapped(docs: DataFrame, id_col: str, text_col: str, model: str | None, table_chunks: int, row, names: list[str], schema: str) -> DataFrame:
    """One row per document: its id and what ``row(sp, table, text)`` returns."""
    raw = read_bounded(model or tokenizer_path(MODEL))
    check_model(processor(raw))
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(shared.value)
        table = ChunkTable(sp, table_chunks)
        for b in batches:
            rows = [row(sp, table, t.as_py()) for t in b.column(1)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns, types[1:])], [id_col, *names])

    picked = docs.select(docs[id_col], docs[text_col].cast("string"))
    types = [None, *[pa.int64() if kind == "long" else pa.list_(pa.int32()) if kind == "array<int>" else pa.string() for kind in schema.split("; ")]]
    fields = ", ".join(f"`{n}` {kind}" for n, kind in zip([id_col, *names], [picked.dtypes[0][1], *schema.split("; ")], strict=True))
    return picked.mapInArrow(run, fields)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
           table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every document: its ids and the text they decode to."""
    def row(sp, table, text):
        n, ids, _ = table.document(text)
        return n, ids, sp.decode(ids) if ids else ""

    return _mapped(docs, id_col, text_col, model, table_chunks, row, ["n_tokens", "ids", "decoded"], "long; array<int>; string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
            table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every document, digested where it is encoded."""
    def row(sp, table, text):
        n, ids, written = table.document(text)
        decoded = sp.decode(ids) if ids else ""
        return n, hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()

    return _mapped(docs, id_col, text_col, model, table_chunks, row, ["n_tokens", "ids_sha256", "decoded_sha256"], "long; string; string")
