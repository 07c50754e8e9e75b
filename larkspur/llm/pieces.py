"""SentencePiece encoding and decoding over a table of distinct chunks.

The vocabulary's pieces never hold a white-space marker after another character, so no merge can
cross from the end of a word into the next marker. A normalised text therefore falls apart
into chunks (markers, then the word up to the next marker) that are segmented alike wherever they
stand. Each distinct chunk of a task is segmented and decoded once by the library; texts take
their ids from that table by position. :func:`chunkable` checks the property for a model; one
without it is encoded text by text.

Defined results: a null or empty text has the end id only and decodes to the empty text; repeated
rows give equal results. The result has its own columns only, so clashing input names don't matter.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bound_batches, pieces, release

MARK = "▁"
#: Distinct chunks kept by a task; beyond that the table starts anew, which costs time only.
TABLE_ROWS = 200_000

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts that a normaliser other than the identity would change.
_PROBES = ("\ufb01", "\uff46\u3000x", "e\u0301", "a  b ", " x", "A\u00a0b", "\u2460", "\t\n\r", "\u200b", "\ufeff")


def chunkable(processor) -> bool:
    """Whether no piece has the marker after another character, and texts are normalised by writing the
    marker for each blank and one in front, no more."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    plain = all(processor.normalize(t) == MARK + t.replace(" ", MARK) for t in _PROBES)
    return plain and not any(crossing.search(processor.id_to_piece(i)) for i in range(processor.get_piece_size()))


class ChunkTable:
    """Segmentations and decoded texts of distinct chunks. A chunk is kept without its first marker."""

    def __init__(self, model_file: str, rows: int = TABLE_ROWS):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunked, self.rows = chunkable(self.library), rows
        self.ids: dict[str, str] = {}
        #: Decoded texts that differ from their chunk.
        self.texts: dict[str, str] = {}
        self.end = str(self.library.eos_id())

    def _learn(self, chunks: list[str]) -> None:
        # the library puts one marker in front of what it encodes, and takes one off what it decodes
        ids = self.library.encode(chunks, num_threads=1)
        lone = [self.library.piece_to_id(MARK)]
        ids = [i or lone for i in ids]
        for c, i, t in zip(chunks, ids, self.library.decode(ids, num_threads=1)):
            self.ids[c] = " ".join(map(str, i))
            if c != t:
                self.texts[c] = t

    def clear(self) -> None:
        self.ids.clear()
        self.texts.clear()

    @staticmethod
    def split(text: str) -> list[str]:
        """The chunks of a text, without the first marker of each."""
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode_decode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text its ids with the end id as decimals, their number, and the decoded text."""
        if not self.chunked:
            out = []
            for text in texts:
                ids = self.library.encode(text, add_eos=True)
                out.append((" ".join(map(str, ids)), len(ids), self.library.decode(ids)))
            return out
        split = [self.split(t) if t else None for t in texts]
        if len(self.ids) > self.rows:
            self.clear()
        new: set[str] = set()
        for chunks in split:
            if chunks:
                new.update(chunks)
        new.difference_update(self.ids)
        if new:
            self._learn(list(new))
        id_of, text_of, out = self.ids.__getitem__, self.texts.get, []
        for chunks in split:
            if chunks:
                ids = " ".join(map(id_of, chunks)) + " " + self.end
                out.append((ids, ids.count(" ") + 1, " ".join(map(text_of, chunks, chunks))))
            else:
                out.append((self.end, 1, ""))
        return out


@lru_cache(maxsize=2)
def _table(model_file: str) -> ChunkTable:
    return ChunkTable(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _local(model_file: str) -> str:
    import os

    return model_file if os.path.exists(model_file) else SparkFiles.get(os.path.basename(model_file))


def encode(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``; with ``with_ids=False`` the SHA-256 of both instead, so
    that neither leaves the worker. The model is a file that every executor has, as installed with
    the tokenizers' package or sent with ``addFile``."""
    model = model_file or default_model()

    def work(table: ChunkTable, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = table.encode_decode([t or "" for t in batch.column(1).to_pylist()])
        n = pa.array([f[1] for f in found], pa.int64())
        if with_ids:
            values = np.fromstring(" ".join(f[0] for f in found), dtype=np.int32, sep=" ")
            offsets = np.concatenate([[0], np.cumsum(n.to_numpy())]).astype(np.int32)
            cols = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([f[2] for f in found], pa.string())]
            return pa.RecordBatch.from_arrays([batch.column(0), n, *cols], ["doc_id", "n_tokens", "ids", "decoded"])
        cols = [pa.array([hashlib.sha256(f[k].encode()).hexdigest() for f in found], pa.string()) for k in (0, 2)]
        return pa.RecordBatch.from_arrays([batch.column(0), n, *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches):
        table = _table(_local(model))
        for piece in pieces(batches):
            yield work(table, piece)
        # the model stays with the worker, the chunks don't
        table.clear()
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tail = "ids array<int>, decoded string" if with_ids else "ids_sha256 string, decoded_sha256 string"
    bound_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {tail}")
