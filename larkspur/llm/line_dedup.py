"""Line dedup: an exact set-similarity join of all lines of all documents.

A line is the set of its words. It is removed when an earlier line, by doc_id and then line
number, has a Jaccard similarity of 0.9 or more to it (whether that one is removed itself or not).

1. Lines with equal sets are one class; all but its earliest line go.
2. A class's words are put in order of rarity. Rarity comes from word counts over all documents,
   kept in a table of fixed size (2**18 cells, so that it may be sent to all executors); words that
   share a cell share a count, and ties go by hash, which keeps the order common to all lines and so
   the join exact.
3. *Prefix filter:* lines within the threshold share one of the first ``floor(n/10) + 1`` words.
   Lines of under 9 words only match equal sets. *Length filter:* sizes within 9 to 10.
   *Positional filter:* the shared prefix words and what can follow the last of them bound the overlap.
   A 64-bit parity sketch of the sets bounds their difference from below. Lines that no other line of
   a shared prefix word could match by length and sketch go no further.
4. What passes is verified on the words themselves. In each round, the lines that share a prefix word are held
   against the earliest of them only; those not yet matched go on to the next ones, 32 times as many a
   round, until every line is matched or has been held against all earlier ones.

Defined results: a null text has no line, blank lines are neither compared nor removed; a line that
stands several times in one document stays once; of equal lines the earliest stays. A long text is cut into lines
whole, in one task. Rows that share a doc_id are one document whose lines of one number stand side by side: neither is
earlier, and a number is removed from all of them if the line of one goes. Rows with a null id are left alone; an empty
table gives no rows. The result has its own columns only; ``remove_lines`` keeps those of its input, and they may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import bound_batches, discard, hash_spans, map_texts, mix, pieces, stored, texts_words

#: Similarity of 9/10, kept as whole numbers.
NEAR, OF = 9, 10
CELL_BITS = 18
SLICES = 16
MOST_EARLIER = 512
#: How many times as many earlier lines the next round takes.
STEP = 32
#: Rows of a task's sorted postings that are judged at once, a token's end permitting.
HELD = 1 << 14

#: What a line is known by: rows that share an id may have several lines of one number.
KEY = ["doc_id", "line_no", "d1"]

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of words by cell, over all documents. Each task adds up all it reads."""
    bound_batches(docs.sparkSession)
    width = (1 << CELL_BITS) // SLICES

    def count(batches):
        total = np.zeros(1 << CELL_BITS, np.int64)
        for piece in pieces(batches):
            raw, starts, ends, _, _ = texts_words(piece.column(0))
            total += np.bincount(_cells(hash_spans(raw, starts, ends)), minlength=1 << CELL_BITS)
        if total.any():
            parts = [np.minimum(total[k * width : (k + 1) * width], 0xFFFFFFFF).astype(np.uint32).tobytes() for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(part, np.uint32).astype(np.int64)
                sums[k] = sums[k] + more if k in sums else more
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["slice", "counts"])

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary")
    out = np.zeros(1 << CELL_BITS, np.int64)
    for row in parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] += np.frombuffer(row["counts"], np.int64)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts as ranks from 0 to 255, by quarters of a power of two."""
    return np.minimum(4 * np.log2(counts + 1.0), 255).astype(np.uint8)


def line_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, line_no, word_line, hashes``: the row and number of each line of the batch, and for each word
    its line and hash."""
    raw, starts, ends, _, begin = texts_words(column)
    breaks = np.flatnonzero(raw == 10) + 1
    line_start = np.union1d(begin[:-1], breaks)
    row = np.searchsorted(begin, line_start, side="right") - 1
    first = np.searchsorted(line_start, begin[:-1])
    real = row < len(begin) - 1
    line_start, row = line_start[real], row[real]
    line_no = np.arange(len(line_start)) - first[row]
    word_line = np.searchsorted(line_start, starts, side="right") - 1
    return row, line_no, word_line, hash_spans(raw, starts, ends)


def line_sets(column: pa.Array, ranks: np.ndarray) -> dict[str, np.ndarray]:
    """For each line with a word: row, line_no, size, fingerprint, parity sketch, first words in order."""
    row, line_no, word_line, hashes = line_words(column)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return {"row": none, "line_no": none, "n": none, "d1": none, "d2": none, "bits": none, "prefix": pa.array([], pa.list_(pa.int64()))}
    # one sortable key: line, rarity, hash
    spare = 64 - max(1, int(len(row)).bit_length()) - 8
    key = (word_line.astype(np.uint64) << np.uint64(spare + 8)) | (ranks[_cells(hashes)].astype(np.uint64) << np.uint64(spare)) | (hashes >> np.uint64(64 - spare))
    order = np.argsort(key)
    hashes, lines = hashes[order], word_line[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (lines[1:] != lines[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, lines = hashes[new], lines[new]
    begin = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1]]))
    n = np.diff(np.append(begin, len(lines)))
    of = lines[begin]
    wanted = np.where(n >= NEAR, n // OF + 1, 0)
    place = np.arange(len(hashes)) - np.repeat(begin, n)
    first = place < np.repeat(wanted, n)
    prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wanted)]).astype(np.int32)), pa.array(hashes[first].view(np.int64)))
    signed = lambda x: x.view(np.int64)
    return {
        "row": row[of],
        "line_no": line_no[of],
        "n": n,
        "d1": signed(np.add.reduceat(hashes, begin)),
        "d2": signed(np.add.reduceat(mix(hashes ^ _ODD), begin)),
        "bits": signed(np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), begin)),
        "prefix": prefix,
    }


def lines_table(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = line_sets(batch.column(1), sent.value)
        ids = batch.column(0).take(pa.array(s["row"]))
        cols = [pa.array(s["line_no"].astype(np.int32)), pa.array(s["n"].astype(np.int32)), *[pa.array(s[k], pa.int64()) for k in ("d1", "d2", "bits")], s["prefix"]]
        return pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "line_no", "n", "d1", "d2", "bits", "prefix"])

    return map_texts(docs.select("doc_id", "text"), work, "doc_id long, line_no int, n int, d1 long, d2 long, bits long, prefix array<long>")


def _overlap(a, b):
    """Least shared words of lines of these sizes within the threshold."""
    return F.floor((NEAR * (a + b) + NEAR + OF - 1) / (NEAR + OF))


def _similar(a, b, x, y):
    """The length filter, and the parity sketches ``x`` and ``y``: each word that only one line has turns one bit."""
    return (OF * F.least(a, b) >= NEAR * F.greatest(a, b)) & (F.bit_count(x.bitwiseXOR(y)) <= a + b - 2 * _overlap(a, b))


def _differ(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`_similar` for arrays: sketches ``x``, ``y`` and sizes ``a <= b``; True where a pair is ruled out."""
    need = (NEAR * (a + b) + NEAR + OF - 1) // (NEAR + OF)
    return np.bitwise_count(x ^ y) > a + b - 2 * need


def partners(token: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rows, sorted by token and size, that length and parity allow to match another row of their token.

    Row ``i`` meets row ``i + d`` for growing ``d``, all rows in step, as long as the other is no more than 10/9 its size."""
    out = np.zeros(len(token), bool)
    live, d = np.arange(len(token)), 0
    while len(live):
        d += 1
        live = live[live + d < len(token)]
        live = live[(token[live + d] == token[live]) & (OF * n[live] >= NEAR * n[live + d])]
        match = live[~_differ(bits[live], bits[live + d], n[live], n[live + d])]
        out[match] = out[match + d] = True
    return out


def _regions(postings: DataFrame) -> DataFrame:
    """Of ``(token, n, bits, doc_id, line_no, d1)``, the rows that may match another of their token. Rows come sorted, and are
    held only until their token ends; a token of more than ``HELD`` rows is passed on whole, unjudged."""

    def judge(held):
        tab = pa.Table.from_batches(held).combine_chunks()
        keep = partners(*[tab.column(k).to_numpy() for k in (0, 1)], tab.column(2).to_numpy().view(np.uint64))
        return [b for b in tab.filter(pa.array(keep)).to_batches() if b.num_rows]

    def run(batches):
        held, size, passed = [], 0, None  # passed: the token that is being passed on
        for batch in batches:
            token = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]]).tolist()
            for a, z in ((cuts[0], cuts[1]), (cuts[1], cuts[-2]), (cuts[-2], cuts[-1])) if len(cuts) > 2 else ((0, len(token)),):
                if z <= a:
                    continue
                part, first = batch.slice(a, z - a), token[a]
                if passed is not None and first == passed:
                    yield part
                    continue
                passed = None
                same = bool(held) and held[-1].column(0)[held[-1].num_rows - 1].as_py() == first
                if held and not same and size >= HELD:
                    yield from judge(held)
                    held, size = [], 0
                held.append(part)
                size += z - a
                if size >= 16 * HELD and same:
                    # one token fills what is held: judge what came before it, pass on the rest
                    tab = pa.Table.from_batches(held).combine_chunks()
                    at = int(np.searchsorted(tab.column(0).to_numpy(), first))
                    if at:
                        yield from judge(tab.slice(0, at).to_batches())
                    yield from tab.slice(at).to_batches()
                    held, size, passed = [], 0, first
        if held:
            yield from judge(held)

    bound_batches(postings.sparkSession)
    rows = postings.select("token", "n", "bits", "doc_id", "line_no", "d1").repartition(F.col("token")).sortWithinPartitions("token", "n")
    return rows.mapInArrow(run, "token long, n int, bits long, doc_id long, line_no int, d1 long")


def _matches(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The later lines ``(doc_id, line_no, d1)`` of the pairs within the threshold: the positional filter, then the words.
    ``lines`` has prefix and words of all lines in question."""

    def side(s):
        return lines.select(*[F.col(c).alias(f"{s}_{c}") for c in (*KEY, "prefix", "words")])

    rows = pairs.join(side("x"), [f"x_{c}" for c in KEY]).join(side("y"), [f"y_{c}" for c in KEY])
    a, b = F.size("x_words"), F.size("y_words")
    rows = rows.withColumn("__shared", F.array_intersect("x_prefix", "y_prefix")).filter(F.size("__shared") > 0)
    last = F.try_element_at("__shared", F.lit(-1))
    after = F.least(a - F.array_position("x_prefix", last), b - F.array_position("y_prefix", last))
    rows = rows.filter(F.size("__shared") + after >= _overlap(a, b))
    both = F.size(F.array_intersect("x_words", "y_words"))
    near = rows.filter(OF * both >= NEAR * (a + b - both))
    return near.select(*[F.col(f"x_{c}").alias(c) for c in KEY]).distinct()


def _wanted_sets(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, d1, words)`` of the lines in ``needed``, from the texts."""
    numbers = needed.groupBy("doc_id").agg(F.collect_set("line_no").alias("numbers"))
    bound_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, line_no, word_line, hashes = line_words(batch.column(1))
        lists = batch.column(2)
        of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        most = max(int(line_no.max(initial=0)), int(pc_max(lists.values))) + 1
        chosen = np.flatnonzero(np.isin(row * most + line_no, of * most + np.asarray(lists.flatten())))
        begin = np.searchsorted(word_line, chosen)
        end = np.searchsorted(word_line, chosen, side="right")
        sets = [np.unique(hashes[a:z]).view(np.int64) for a, z in zip(begin, end)]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
        d1 = pa.array(np.array([s.view(np.uint64).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[chosen])), pa.array(line_no[chosen].astype(np.int32)), d1, words], ["doc_id", "line_no", "d1", "words"])

    def pc_max(values):
        return np.asarray(values).max(initial=0)

    rows = docs.join(numbers, "doc_id").select("doc_id", "text", "numbers")
    return map_texts(rows, work, "doc_id long, line_no int, d1 long, words array<long>").dropDuplicates(KEY)


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(lines, removed)``: all lines with words as ``(doc_id, line_no)``, and those to be removed."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    lines = stored(lines_table(docs, rarity(word_counts(docs))), "lines")
    # the class's columns follow from its set, so any row's will do
    classes = lines.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    classes = stored(classes.select("at.doc_id", "at.line_no", "n", "d1", "d2", "bits", "prefix"), "classes")

    postings = classes.filter("n >= 9").select(*KEY, "n", "bits", F.explode("prefix").alias("token"))
    state = stored(_regions(postings), "regions")
    # the words of all lines in question, fetched once
    asked = state.select(*KEY).distinct()
    words = _wanted_sets(asked, docs).join(classes.select(*KEY, "prefix"), KEY)
    words = stored(words, "line-words")
    matched, width = None, 1
    while not state.isEmpty():
        place = F.row_number().over(Window.partitionBy("token").orderBy(*KEY))
        early = state.withColumn("__place", place).filter(F.col("__place") <= width).select("token", F.col("doc_id").alias("y_doc_id"), F.col("line_no").alias("y_line_no"), F.col("d1").alias("y_d1"), F.col("n").alias("y_n"), F.col("bits").alias("y_bits"))
        early = stored(early, "early")
        probes = state if matched is None else state.join(matched, KEY, "left_anti")
        # held against each other inside the join: what leaves it is nearly always a match
        pairs = probes.join(early, "token").filter("y_doc_id < doc_id or (y_doc_id = doc_id and y_line_no < line_no)")
        pairs = pairs.filter(_similar(F.col("n"), F.col("y_n"), F.col("bits"), F.col("y_bits")))
        pairs = pairs.select(*[F.col(c).alias(f"x_{c}") for c in KEY], *[f"y_{c}" for c in KEY]).distinct()
        found = stored(_matches(pairs, words), "matched")
        if not found.isEmpty():
            matched = found if matched is None else stored(matched.unionByName(found), "matched")
        # those just used are settled; a group goes on while a line in it is unmatched
        settled = early.select("token", *[F.col(f"y_{c}").alias(c) for c in KEY])
        rest = state.join(settled, ["token", *KEY], "left_anti")
        live = rest if matched is None else rest.join(matched, KEY, "left_anti")
        live = live.groupBy("token").agg(F.count(F.lit(1)).alias("__n")).select("token")
        before, state = state, stored(rest.join(live, "token", "left_semi"), "regions")
        discard(before)
        width = min(STEP * width, MOST_EARLIER)
    keys = classes.select("d1", "d2", "n", F.col("doc_id").alias("f_doc_id"), F.col("line_no").alias("f_line_no"))
    if matched is not None:
        gone = matched.select(F.col("doc_id").alias("f_doc_id"), F.col("line_no").alias("f_line_no"), "d1", F.lit(True).alias("gone"))
        keys = keys.join(gone, ["f_doc_id", "f_line_no", "d1"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    else:
        keys = keys.withColumn("gone", F.lit(False))
    every = lines.select("doc_id", "line_no", "n", "d1", "d2")
    removed = every.join(keys, ["d1", "d2", "n"]).filter("gone or doc_id <> f_doc_id or line_no <> f_line_no").select("doc_id", "line_no")
    return every.select("doc_id", "line_no"), removed


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed_lines)`` for every row: lines with words, how many of them go,
    and their numbers from 0 in ascending order."""
    lines, removed = duplicate_lines(docs, id_col, text_col)
    counts = lines.dropDuplicates(["doc_id", "line_no"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    gone = removed.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(counts, "doc_id", "left").join(gone, "doc_id", "left")
    none = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return rows.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(none).cast("long").alias("n_removed"), none.alias("removed_lines"))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their removed lines; one left without any word by that is gone."""
    _, removed = duplicate_lines(docs, id_col, text_col)
    gone = removed.groupBy("doc_id").agg(F.collect_set("line_no").alias("__gone")).withColumnRenamed("doc_id", "__id")
    rows = docs.join(gone, docs[id_col] == gone["__id"], "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.transform(F.array(lines), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")).getItem(0)
    rows = rows.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(text))
    return rows.filter(F.col("__gone").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
