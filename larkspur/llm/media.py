"""Media columns: byte payloads kept as lossless WebP images, read back into pixel arrays.

A payload is cut into grey images of 64 columns and at most ``ROWS`` rows, one after the other, so that no length is
refused and a long text is read with many images in step. They are written with cross-colour, back-references and
prefix codes of their own, or a palette, and read by the general reader (:mod:`larkspur.llm.webp_many`).

Defined results: a null text counts as empty and is stored as 64 zero bytes; a long text is many images; equal texts
(repeated rows too) give equal media; an empty table gives no rows; no order matters, so there are no ties; the result
has its own columns only, so clashing input names don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.webp_many import decode_many, encode_many
from larkspur.llm.common import map_texts

UNIT = 64
#: Bytes of text worked on at a time: a round of the reader costs less a symbol the more images it has.
TOGETHER = 4 << 20
#: Rows of one image.
ROWS = 64


def padded(data: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return data + b"\0" * ((-len(data)) % UNIT if data else UNIT)


def store_many(payloads: list[bytes]) -> list[bytes]:
    """For each payload, WebP images one after the other whose pixels are its bytes."""
    images = [np.frombuffer(p, np.uint8).reshape(-1, UNIT) for p in payloads]
    tiles = [image[k : k + ROWS] for image in images for k in range(0, len(image), ROWS)]
    done = iter(encode_many(tiles))
    return [b"".join(next(done) for _ in range(0, len(image), ROWS)) for image in images]


def files(media: bytes) -> list[bytes]:
    """The images of one stored payload."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(media[at : at + size])
        at += size
    return out


def restore_many(stored: list[bytes]) -> list[np.ndarray]:
    """For each, the grey plane of all its images; its bytes are the payload."""
    each = [files(m) for m in stored]
    planes = iter([(argb & np.uint32(255)).astype(np.uint8) for argb in decode_many([f for fs in each for f in fs])])
    return [np.concatenate([next(planes) for _ in fs]) for fs in each]


def features(plane: np.ndarray) -> str:
    """Size of the picture, its mean, spread and entropy, from the pixels that were read back."""
    counts = np.bincount(plane.ravel(), minlength=256)
    n = int(counts.sum())
    level = np.arange(256)
    mean = float((counts * level).sum()) / n
    spread = max(0.0, float((counts * level * level).sum()) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    return f"{plane.shape[1]}x{plane.shape[0]};mean={mean:.4f};sd={spread:.4f};bits={abs(-(share * np.log2(share)).sum()):.4f};levels={len(share)}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text as a stored image and what is read back from it; ``with_media`` adds the image itself."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        stored = store_many([padded(t) for t in texts])
        rows = []
        for text, media, plane in zip(texts, stored, restore_many(stored)):
            payload = plane.tobytes()
            row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(plane))
            rows.append((*row, media) if with_media else row)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_media]
        cols = list(zip(*rows))
        names = [c.split()[0] for c in SCHEMA.split(", ")] + ["media"] * with_media
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, work, SCHEMA + ", media binary" * with_media, size=TOGETHER)
