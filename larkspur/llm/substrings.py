"""Substring dedup: words in passages that an earlier document has too, by FM-index shards.

A window is 13 consecutive words. A word is removed if a window that covers it also stands in a
document with a smaller doc_id. Windows are judged on the input.

1. *Routing.* A window's key is the least hash among its 5-word shingles, so equal windows have equal keys
   and neighbouring windows mostly share one; runs of windows with one key are a segment.
   Keys that only one document has can't hold a shared window and go no further: what is
   indexed are segments that may repeat, and each once for each key.
2. *Shards.* Segments are dealt by key. A shard puts the distinct segments of a range of keys into one FM-index
   (:mod:`larkspur.llm.fm_index`) and streams every window of theirs through it by backward search. The
   suffix interval that is left after 13 words gives the smallest document that has the window.
3. *Hot keys.* A key that more than ``HOT`` documents share would make one shard grow with the input. Its windows are
   dealt anew by their whole content instead, and the least document of each is found by a partial
   aggregation before the shuffle and a join that adaptive execution may split. It gives the same result.

Words are compared by 64-bit hash.

Defined results: a null or empty text has no words and its kept text is empty; rows that share a
doc_id are one document, so they don't remove words from each other; rows with a null id
neither remove nor lose words; an empty table gives no rows. The result has its own columns only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bound_batches, hash_spans, map_texts, mix, stored, texts_words
from larkspur.llm.fm_index import FMIndex

WINDOW = 13
WIDTH = 5
#: Documents that may share a key within a shard.
HOT = 1 << 15
#: Words in one FM-index, unless a single key has more (at most HOT segments).
SHARD_WORDS = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _ODD + words[k : k + n]
    return mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


class Windows:
    """Words, windows and keys of a batch of texts."""

    def __init__(self, column: pa.Array, window: int = WINDOW):
        self.raw, self.starts, self.ends, self.first, _ = texts_words(column)
        self.words = hash_spans(self.raw, self.starts, self.ends)
        count = np.maximum(0, np.diff(self.first) - window + 1)
        self.row = np.repeat(np.arange(len(count)), count)
        self.at = np.arange(len(self.row)) + np.repeat(self.first[:-1] - (np.cumsum(count) - count), count)
        if len(self.row):
            key = _sliding_min(_rolled(self.words, WIDTH), window - WIDTH + 1)[self.at]
            self.key = (key >> np.uint64(32)).astype(np.int64)
        else:
            self.key = np.zeros(0, np.int64)
        new = np.ones(len(self.row), bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (self.key[1:] != self.key[:-1])
        self.run = np.flatnonzero(new)  # first window of each segment
        self.size = np.diff(np.append(self.run, len(self.row)))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def keys_table(docs: DataFrame, window: int) -> DataFrame:
    """``(doc_id, keys)``: the distinct keys of each document's windows."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Windows(batch.column(1), window)
        pair = np.unique((w.row[w.run].astype(np.uint64) << np.uint64(32)) | w.key[w.run].astype(np.uint64))
        row = (pair >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(row, minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), _lists((pair & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), counts, pa.int32())], ["doc_id", "keys"])

    return map_texts(docs, work, "doc_id long, keys array<int>")


def _chosen(w: Windows, lists: pa.ListArray) -> np.ndarray:
    """Segments whose key is on the list of their row."""
    listed = np.asarray(lists.flatten()).astype(np.int32).view(np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(lists), dtype=np.uint64), np.asarray(lists.value_lengths()))
    pair = (w.row[w.run].astype(np.uint64) << np.uint64(32)) | w.key[w.run].astype(np.uint64)
    return np.flatnonzero(np.isin(pair, (of << np.uint64(32)) | listed))


def segments(rows: DataFrame, window: int) -> DataFrame:
    """``(key, doc_id, start, words)`` from ``(doc_id, text, keys)``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Windows(batch.column(1), window)
        pick = _chosen(w, batch.column(2))
        first, counts = w.at[w.run[pick]], w.size[pick] + window - 1
        row = w.row[w.run[pick]]
        flat = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        key = w.key[w.run[pick]].astype(np.uint32).view(np.int32)
        start = (first - w.first[row]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), pa.array(start), _lists(w.words[flat].view(np.int64), counts, pa.int64())], ["key", "doc_id", "start", "words"])

    return map_texts(rows, work, "key int, doc_id long, start long, words array<long>")


def hot_windows(rows: DataFrame, window: int) -> DataFrame:
    """``(content, doc_id, start)`` of every window with a hot key, from ``(doc_id, text, keys)``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Windows(batch.column(1), window)
        pick = _chosen(w, batch.column(2))
        size = w.size[pick]
        every = np.arange(size.sum()) + np.repeat(w.run[pick] - (np.cumsum(size) - size), size)
        content = _rolled(w.words, window)[w.at[every]] if len(every) else np.zeros(0, np.uint64)
        start = w.at[every] - w.first[w.row[every]]
        return pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), batch.column(0).take(pa.array(w.row[every])), pa.array(start, pa.int64())], ["content", "doc_id", "start"])

    return map_texts(rows, work, "content long, doc_id long, start long")


def search_shard(doc: np.ndarray, start: np.ndarray, words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, start)`` of the windows that stand in a smaller document of the shard too."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    inner = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
    with np.errstate(over="ignore"):
        mark = np.add.reduceat(mix(words ^ mix((inner + 1).astype(np.uint64) * _ODD)), bounds[:-1])
    # equal segments are indexed once, for their smallest document
    _, one, same = np.unique(mark, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    sizes = counts[one]
    total = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.arange(total[-1]) + np.repeat(bounds[:-1][one] - total[:-1], sizes)
    index = FMIndex(words[flat], total, least)
    many = sizes - window + 1
    begin = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(begin[-1]) + np.repeat(total[:-1] - begin[:-1], many)
    found, places = index.shared_windows(at, window)
    found = np.where(places > 1, found, np.repeat(least, many))
    # back to every segment
    each = many[same]
    of = np.repeat(np.arange(len(doc)), each)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    hit = found[begin[:-1][same][of] + inside] < doc[of]
    return doc[of[hit]], start[of[hit]] + inside[hit]


def search(segs: DataFrame, window: int) -> DataFrame:
    """``(doc_id, starts)`` of windows to be removed. Partitions come sorted by key and are cut between keys."""
    bound_batches(segs.sparkSession)

    def flush(parts):
        tab = pa.Table.from_batches(parts).combine_chunks()
        lists = tab.column("words").chunk(0)
        doc, start = search_shard(
            tab.column("doc_id").to_numpy(), tab.column("start").to_numpy(), np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.value_lengths()).astype(np.int64), window
        )
        if len(doc):
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[begin]), _lists(start, np.diff(np.append(begin, len(doc))), pa.int64())], ["doc_id", "starts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            counts = np.concatenate([[0], np.cumsum(np.asarray(batch.column(3).value_lengths()))])
            if held and held[-1].column(0)[held[-1].num_rows - 1].as_py() == key[0]:
                cuts = cuts[1:]
            done = 0
            for cut in cuts.tolist():
                if size + counts[cut] - counts[done] >= SHARD_WORDS:
                    if cut > done:
                        held.append(batch.slice(done, cut - done))
                    if held:
                        yield from flush(held)
                    held, size, done = [], 0, cut
            if done < batch.num_rows:
                held.append(batch.slice(done))
                size += int(counts[-1] - counts[done])
        if held:
            yield from flush(held)

    return segs.mapInArrow(run, "doc_id long, starts array<long>")


def shared_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, starts)``: windows that stand in a smaller document too; several rows a document."""
    docs = docs.filter("doc_id is not null")
    postings = keys_table(docs, window).select("doc_id", F.explode("keys").alias("key"))
    postings = postings.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("c"))
    shared = stored(postings.filter("lo < hi").select("key", (F.col("c") > HOT).alias("hot")), "keys")
    again = keys_table(docs, window).select("doc_id", F.explode("keys").alias("key"))
    wanted = again.join(shared, "key").groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys")
    )
    wanted = stored(wanted, "wanted")
    cool = docs.join(wanted.filter("size(keys) > 0").select("doc_id", "keys"), "doc_id").select("doc_id", "text", "keys")
    segs = segments(cool, window)
    found = search(segs.repartition(F.col("key")).sortWithinPartitions("key"), window)
    if not shared.filter("hot").isEmpty():
        hot = docs.join(wanted.filter("size(hot_keys) > 0").select("doc_id", F.col("hot_keys").alias("keys")), "doc_id").select("doc_id", "text", "keys")
        windows = stored(hot_windows(hot, window), "hot")
        least = windows.groupBy("content").agg(F.min("doc_id").alias("least"))
        more = windows.join(least, "content").filter("least < doc_id").groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
        found = found.unionByName(more)
    return stored(found, "found")


def _with_starts(docs: DataFrame, window: int) -> DataFrame:
    found = shared_windows(docs, window).groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts")).withColumnRenamed("doc_id", "__id")
    return docs.join(found, docs["doc_id"] == found["__id"], "left").select("doc_id", "text", F.coalesce("starts", F.array().cast("array<long>")).alias("starts"))


def _kept(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """By row: words, removed words, and the kept ones joined by a blank."""
    raw, starts, ends, first, _ = texts_words(batch.column(1))
    counts = np.asarray(batch.column(2).value_lengths())
    begin = np.asarray(batch.column(2).flatten()) + np.repeat(first[:-1], counts)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + window, -1)
    gone = np.cumsum(edge)[:-1] > 0
    n = np.diff(first)
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (n > 0) if len(n) else n
    texts = []
    data = raw.tobytes()
    for a, z, r in zip(first[:-1].tolist(), first[1:].tolist(), removed.tolist()):
        words = data[starts[a] : ends[z - 1]].split() if z > a else []
        if r:
            words = [w for w, g in zip(words, gone[a:z].tolist()) if not g]
        texts.append(b" ".join(words))
    return n, removed, texts


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row; with ``with_text=False`` the SHA-256 of the kept
    text instead of the text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, texts = _kept(batch, window)
        last = pa.array([t.decode() for t in texts], pa.string()) if with_text else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), last], ["doc_id", "n_words", "n_removed", "kept" if with_text else "kept_sha256"])

    return map_texts(_with_starts(docs, window), work, f"doc_id long, n_words long, n_removed long, {'kept' if with_text else 'kept_sha256'} string")
