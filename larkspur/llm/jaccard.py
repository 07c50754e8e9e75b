"""N-gram Jaccard join: exact components of documents whose shingle sets are near.

``d(x, y) = 1 - J(x, y)`` is a metric. The join finds all pairs with ``d <= 0.25`` up to what the
components already say, in these steps.

1. *Classes.* Documents with equal sets are one class, held by its smallest id.
2. *Regions.* Two sets within the radius share a shingle among the first ``floor(n/4) + 1`` of either in any
   common order. Every shingle so used is a region of the classes that have it. The order puts shingles
   that many documents share last. Their frequency comes from a table of fixed size over all documents (counts
   above what chance gives a cell, by powers of two), and ties go by hash; any order gives the same
   result, a finer one smaller regions. Let ``i`` and ``j`` be the places of the first shingle that two sets
   share: they can only be near if ``i <= |x| - o`` and ``j <= |y| - o``, with ``o`` the least overlap of
   sets of these sizes. This is part of every join below, so a pair meets in the regions near its first common shingle
   only, and members that no size in their region lets meet anyone are taken out beforehand.
3. *Pivots.* Each region elects as its pivot the member that shares most with others (an original rather than its
   altered copies), and all members are measured against it, not against each other. Those within the radius
   are linked to it and need no comparison among themselves any more.
4. *Voronoi cells and windows.* A measured class belongs to the cell of its nearest pivot ``p``. Two classes of a
   cell can only be near if ``min(|x & p|, |y & p|) + min(|x - p|, |y - p|)`` reaches the least
   overlap: the triangle inequality, made sharp by the sizes. Cells so become windows of the distance to the pivot, and
   only what lies in a common window meets again.
5. *Recursion.* Components are computed anew, regions that are all in one component are done, and the others elect
   64 times as many pivots as before, spread by hash, each held against the members of other components in
   its windows. Pivots are settled with their region, so the number of rounds grows with the logarithm
   of the largest region, and no round leaves a pair out.

Shingles are compared by 64-bit hash. Regions are never materialised as pairs: conditions are part of plain
equi-joins that adaptive execution splits.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text
of one to four words has one shingle, its whole sequence; a long text is taken whole, and its set is held in one
task. Rows that share an id are one document: it is linked with what any of its texts is linked with, and each row
has the size of its own set. A null id gets a null component and links nothing. Ties between pivots go by
id and never change the result. An empty table gives no rows. The result has its own columns only,
so clashing input names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bound_batches, discard, hash_spans, map_texts, mix, pieces, stored, texts_words
from larkspur.llm.components import components

WIDTH = 5
#: Shingles are counted in cells of so many bits, in slices that are added up apart.
CELL_BITS = 24
SLICES = 64
#: Bits of the table that tells shingles that can't be shared.
SHARED_BITS = 26
#: Ids that may be sent to all executors (8 bytes each); more are joined by a shuffle.
SENT = 1 << 19
#: Pivots of a region in the second round, and how many times as many the next round has.
STEP = 64

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """By row the sorted distinct hashes of its shingles."""
    raw, starts, ends, first, _ = texts_words(column)
    raw = raw.copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    words = hash_spans(raw, starts, ends)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * _MULTIPLY + words[k : k + n]
    rolled = mix(rolled)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= width:
            out.append(np.unique(rolled[a : z - width + 1]))
        elif z > a:
            h = np.uint64(z - a)
            with np.errstate(over="ignore"):
                for w in words[a:z]:
                    h = h * _MULTIPLY + w
            out.append(mix(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    """Shingles of which sets with a similarity of 0.75 must share one."""
    return n // 4 + 1 if n else 0


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _nibbles(values: np.ndarray) -> bytes:
    """Values below 16, two a byte."""
    low = values.astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def _from_nibbles(data) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8)
    out = np.empty(2 * len(packed), np.uint8)
    out[0::2], out[1::2] = packed & 15, packed >> 4
    return out


def excess_ranks(total: np.ndarray, mean: float) -> np.ndarray:
    """Counts of cells as ranks from 0 to 15: powers of two above what chance gives a cell of this mean."""
    over = total - (mean + 3 * np.sqrt(mean) + 1)
    return np.where(over > 0, np.minimum(15, 1 + np.log2(np.maximum(over, 1))), 0).astype(np.uint8)


def frequency_ranks(docs: DataFrame) -> bytes:
    """Ranks of all cells, packed two a byte: 8 MB whatever the input. All documents are counted."""
    bound_batches(docs.sparkSession)
    width = (1 << CELL_BITS) // SLICES

    def count(batches):
        counts, seen = np.zeros(1 << CELL_BITS, np.uint16), 0
        for piece in pieces(batches):
            np.add.at(counts, _cells(np.concatenate(shingle_sets(piece.column(0)))), 1)
            seen += piece.num_rows
            if seen >= 1 << 14:  # a document adds little to a cell, so none overflows before the next cut
                np.minimum(counts, 1 << 15, out=counts)
                seen = 0
        for k in range(SLICES):
            part = counts[k * width : (k + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_nibbles(np.minimum(part, 15))], pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = _from_nibbles(part.as_buffer())
                if k in sums:
                    sums[k] += more
                else:
                    sums[k] = more.astype(np.int32)
        for k, total in sums.items():
            ranks = excess_ranks(total, float(np.median(total)) if total.any() else 0.0)
            if ranks.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_nibbles(ranks)], pa.binary())], ["slice", "counts"])

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary")
    out = bytearray((1 << CELL_BITS) // 2)
    for row in parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():
        out[row["slice"] * width // 2 : (row["slice"] + 1) * width // 2] = row["counts"]
    return bytes(out)


def sets_table(docs: DataFrame, ranks: bytes) -> DataFrame:
    """``(doc_id, n, d1, d2, prefix)``: size, 128-bit fingerprint and first shingles of each set in the common
    order (by rank, then by hash)."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = np.frombuffer(sent.value, np.uint8)
        sizes, d1, d2, firsts = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            d1.append(s.sum(dtype=np.uint64))
            d2.append(mix(s ^ _MULTIPLY).sum(dtype=np.uint64))
            cells = _cells(s)
            rank = (table[cells >> 1] >> ((cells & 1) << 2).astype(np.uint8)) & 15
            k = prefix_size(len(s))
            firsts.append(s[np.argsort(rank, kind="stable")[:k]] if rank.any() else s[:k])
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts).view(np.int64)))
        signed = [pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *signed, prefix], ["doc_id", "n", "d1", "d2", "prefix"])

    return map_texts(docs.select("doc_id", "text"), work, "doc_id long, n long, d1 long, d2 long, prefix array<long>")


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - SHARED_BITS)).astype(np.int64)


def _shared_slots(shared: DataFrame) -> bytes:
    """A table of bits, 8 MB whatever the input: a shingle whose bit is off isn't shared."""
    width = (1 << SHARED_BITS) // SLICES

    def mark(batches):
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy())
            for k in np.unique(slot // width).tolist():
                if k not in bits:
                    bits[k] = np.zeros(width, bool)
                bits[k][slot[slot // width == k] - k * width] = True
        for k, part in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["slice", "bits"])

    part = F.shiftrightunsigned("token", 64 - 6)  # SLICES is 2**6
    out = bytearray((1 << SHARED_BITS) // 8)
    for row in shared.select("token").repartition(SLICES, part).mapInArrow(mark, "slice int, bits binary").collect():
        out[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = row["bits"]
    return bytes(out)


def _postings(reps: DataFrame, slots: bytes) -> DataFrame:
    """``(token, id, n, at)``: the places of prefix shingles that may be shared."""
    sent = reps.sparkSession.sparkContext.broadcast(slots)

    def run(batches):
        table = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            lists = batch.column(2)
            tokens, many = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
            slot = _slots(tokens)
            hit = np.flatnonzero((table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
            row = np.repeat(np.arange(len(many)), many)[hit]
            at = hit - (np.cumsum(many) - many)[row]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[hit]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int64())], ["token", "id", "n", "at"])

    bound_batches(reps.sparkSession)
    return reps.select("id", "n", "prefix").mapInArrow(run, "token long, id long, n long, at long")


def _listed(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be sent to all executors if it is short. The other side of the join, which has texts or
    prefixes, then stays where it is."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


def _overlap(a: Column, b: Column) -> Column:
    """Least shared shingles of sets of these sizes within the radius: ``100 i >= 75 (a + b - i)``."""
    return F.floor((3 * (a + b) + 6) / 7)


def _may_meet(x: str = "", y: str = "_a") -> Column:
    """The filters on sizes and on the places of a common shingle, for columns with these endings."""
    n, m, i, j = F.col(f"n{x}"), F.col(f"n{y}"), F.col(f"at{x}"), F.col(f"at{y}")
    need = _overlap(n, m)
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (i <= n - need) & (j <= m - need)


def _near_prefixes(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that sizes and prefixes don't rule out. Of the two prefixes, the one that ends earlier in
    the common order lies whole within the other set's prefix range, so all but ``n - overlap`` of it are shared."""

    def side(s):
        return reps.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("prefix").alias(f"prefix_{s}"))

    rows = pairs.join(side("b"), "b").join(side("a"), "a").filter("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    need = _overlap(F.col("n_a"), F.col("n_b"))
    least = F.least(*[need - F.col(n) + F.floor(F.col(n) / 4) + 1 for n in ("n_a", "n_b")])
    shared = F.size(F.array_intersect("prefix_a", "prefix_b"))
    return rows.filter(shared >= F.greatest(F.lit(1), least)).select("a", "b").distinct()


def _distances(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``(a, b, inter, n_a, n_b)`` on whole sets: sizes of the intersection and of both."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for piece in pieces(batches, "text_b"):
            ids = piece.column(0).to_numpy()
            new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            # rows that share an id may differ in text
            texts = piece.column(2)
            left = [texts[int(k)].as_py() for k in new]
            sets = dict(zip(new.tolist(), shingle_sets(pa.array(left, pa.string()))))
            inter, sizes_a, sizes_b, own, held = [], [], [], None, None
            for k, s in enumerate(shingle_sets(piece.column(3))):
                if k in sets:
                    own, held = sets[k], texts[k]
                elif texts[k] != held:
                    held = texts[k]
                    own = shingle_sets(pa.array([held.as_py()], pa.string()))[0]
                place = np.minimum(np.searchsorted(own, s), len(own) - 1)
                inter.append(int((own[place] == s).sum()) if len(own) else 0)
                sizes_a.append(len(own))
                sizes_b.append(len(s))
            columns = [pa.array(x, pa.int64()) for x in (inter, sizes_a, sizes_b)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], ["a", "b", "inter", "n_a", "n_b"])

    # whole texts are shuffled for the documents in question only
    ids = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    texts = stored(docs.join(_listed(ids), docs["doc_id"] == ids["id"]).select("id", "text"), "texts")
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, inter long, n_a long, n_b long")
    out = stored(rows, "distances")
    discard(texts)
    discard(ids)
    return out


def _within(rows: DataFrame) -> DataFrame:
    return rows.filter("100 * inter >= 75 * (n_a + n_b - inter)").select("a", "b")


def _mixed(state: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their components, of regions whose members are still in several components; an id without links is
    a component by itself."""
    state = state.drop("component")
    rows = state.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ends = rows.groupBy("token").agg(F.min("component").alias("__lo"), F.max("component").alias("__hi"))
    return stored(rows.join(ends.filter("__lo < __hi").select("token"), "token").select(*state.columns, "component"), "state")


def _nearest(found: DataFrame, reps: DataFrame) -> DataFrame:
    """``(id, cell, inter)``: the nearest pivot of each measured class and what it shares with it. Ids that
    stand for several sets have none, as one distance doesn't hold for all of them."""
    far = (1 - F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("far")
    cells = found.groupBy(F.col("b").alias("id")).agg(F.min(F.struct(far, F.col("a").alias("cell"), "inter")).alias("m"))
    several = reps.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("id")
    several_cells = several.withColumnRenamed("id", "cell")
    return cells.select("id", "m.cell", "m.inter").join(several, "id", "left_anti").join(several_cells, "cell", "left_anti")


def _in_window() -> Column:
    """Classes of one cell have to share enough within their pivot and beyond it; others may meet in any case."""
    inside = F.least("inter", "inter_a") + F.least(F.col("n") - F.col("inter"), F.col("n_a") - F.col("inter_a"))
    return F.coalesce((F.col("cell") != F.col("cell_a")) | (inside >= _overlap(F.col("n"), F.col("n_a"))), F.lit(True))


def _joined(near: DataFrame, docs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Measured pairs, the edges with the new links, and how many these are."""
    found = _distances(near, docs)
    more = _within(found)
    new = more.count()
    if new:
        before, edges = edges, stored(edges.unionByName(more), "edges")
        discard(before)
    return found, edges, new


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = stored(sets_table(docs, frequency_ranks(docs)), "sets")
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.first("prefix").alias("prefix"))
    reps = stored(classes, "reps")
    members = sets.select("doc_id", "n", "d1", "d2").join(reps.select("d1", "d2", "n", "id"), ["d1", "d2", "n"], "left")
    members = stored(members.select("doc_id", "n", F.coalesce("id", "doc_id").alias("id")), "members")
    discard(sets)

    # what a document with several texts links by itself
    ends = members.groupBy("doc_id").agg(F.min("id").alias("__lo"), F.max("id").alias("__hi")).filter("__lo < __hi").select("doc_id")
    edges = members.join(ends, "doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()

    shared = reps.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = stored(shared, "shared")
    slots = _shared_slots(shared)
    all_regions = stored(_postings(reps, slots).join(shared, "token"), "regions")
    discard(shared)
    # members of a region that some size in it lets meet
    least = all_regions.groupBy("token").agg(F.min("n").alias("n_a"))
    partner = F.greatest("n_a", F.ceil(F.col("n") * 3 / 4))
    regions = all_regions.join(least, "token").filter(F.col("at") <= F.col("n") - _overlap(F.col("n"), partner)).drop("n_a")
    weight = (F.sum("c") / (F.floor(F.max("n") / 4) + 1)).alias("weight")
    regions = regions.join(all_regions.groupBy("id").agg(weight), "id").select("token", "id", "n", "at", "weight")
    several = regions.groupBy("token").agg(F.max(F.struct("weight", F.negate("id").alias("__id"), "n", "at")).alias("m"), F.min("id").alias("__lo"), F.max("id").alias("__hi"))
    leads = several.filter("__lo < __hi").select("token", (-F.col("m.__id")).alias("a"), F.col("m.n").alias("n_a"), F.col("m.at").alias("at_a"))
    regions = stored(regions.join(leads, "token"), "leads")
    discard(all_regions)
    kept = stored(regions.select("id").unionByName(regions.select(F.col("a").alias("id"))).distinct(), "ids")
    reps, before = stored(reps.join(_listed(kept), "id", "left_semi").select("id", "n", "prefix"), "reps"), reps
    discard(before)
    discard(kept)

    # first round: everyone against the region's first pivot
    pairs = regions.filter(F.col("id") != F.col("a")).filter(_may_meet()).select("a", F.col("id").alias("b")).distinct()
    near = stored(_near_prefixes(pairs, reps), "pairs")
    found = _distances(near, docs)
    edges = stored(edges.unionByName(_within(found)), "edges")
    discard(near)
    labels = stored(components(edges), "labels")
    state = regions.filter(F.col("id") != F.col("a")).select("token", "id", "n", "at")
    state = _mixed(state.join(_nearest(found, reps), "id", "left").select("token", "id", "n", "at", "cell", "inter"), labels)
    discard(found)
    discard(regions)
    width = STEP
    while not state.isEmpty():
        order = F.xxhash64("id")
        chosen = F.min(F.struct(order.alias("h"), *[F.col(c) for c in ("id", "n", "at", "cell", "inter", "component")])).alias("m")
        pivots = state.groupBy("token", F.pmod(F.xxhash64(order), F.lit(width)).alias("slot")).agg(chosen)
        pivots = stored(pivots.select("token", F.col("m.id").alias("a"), *[F.col(f"m.{c}").alias(f"{c}_a") for c in ("n", "at", "cell", "inter", "component")]), "pivots")
        pairs = state.join(pivots, "token").filter((F.col("id") != F.col("a")) & (F.col("component") != F.col("component_a"))).filter(_may_meet()).filter(_in_window())
        pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        near = stored(_near_prefixes(pairs, reps), "pairs")
        if not near.isEmpty():
            found, edges, new = _joined(near, docs, edges)
            discard(found)
            if new:
                discard(labels)
                labels = stored(components(edges), "labels")
        discard(near)
        # pivots are settled with all members of their region
        rest = state.join(pivots.select("token", F.col("a").alias("id"), F.col("at_a").alias("at")), ["token", "id", "at"], "left_anti")
        before, state = state, _mixed(rest.select(*state.columns), labels)
        discard(before)
        discard(pivots)
        width *= STEP
    discard(state)
    discard(reps)
    discard(edges)
    out = members.join(labels, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component, that with the smallest id; all their columns stay. Rows that share the
    smallest id stay all, and so do rows with a null id."""
    first = link(docs, id_col, text_col).filter("component_id = doc_id or doc_id is null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(first, docs[id_col].eqNullSafe(first["__id"]), "left_semi")
