"""Mixing sources to target weights by capped water-filling (DataFrame expressions only).

Each source gets ``total * weight / sum(weights)`` words, at most ``max_epochs`` times its own
size; what is clamped off is shared among the others by weight until nobody is above its cap.
The fixed point is ``target = min(cap, level * weight)`` and the level comes from one pass over
the sources sorted by ``cap / weight``, so no iteration is needed.

A source's target is then ``w`` whole repetitions of every document and a fraction of one more:
documents are taken in the order of a seeded hash until the fraction is filled, and the document
at the edge is taken in part (its first words), so that a source's taken words equal its target
to the word. The edge is found from sums by hash bucket, so no source is ever sorted as a whole.

Defined results: a null text or source size counts 0 and takes 0; a null source is a source of
its own and sorts last; rows that are equal in id and size are interchangeable, so ties never
change the result; an empty table gives an empty mix. The plan has its own columns only, so clashing input names
don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import SPLIT

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, in percent, and the most repetitions of a source.
TOTAL_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the hash that make up a bucket.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")
    return F.size(words).cast("long")


def targets(sizes: DataFrame, source_col: str = "source", weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From rows ``(source, source_size)`` to ``(source, source_size, weight, target)``.

    One row a source; the windows below run over sources only. Sums stay integers until the
    one division, so the result doesn't depend on the order of addition.
    """
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place + 1).cast("int")))
    # clamped first: the sources with the least room for their weight
    by_room = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col(source_col).asc_nulls_last())
    whole = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.sum("source_size").over(whole).alias("__all"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("__clamped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("__weight_left"),
    )
    # all in hundredths of words: what is left for this source and all after it, were all before it clamped
    left = F.col("__all") * total_percent - F.col("__clamped") * (100 * max_epochs)
    fits = left * F.col("weight") <= F.col("source_size") * (100 * max_epochs) * F.col("__weight_left")
    rows = rows.withColumn("__open", fits)
    level = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col(source_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("__open"), F.struct("__clamped", "__weight_left"))).over(level)
    rows = rows.withColumn("__first", first)
    room = (F.col("__all") * total_percent - F.col("__first.__clamped") * (100 * max_epochs)) * F.col("weight")
    filled = room.cast("double") / (F.col("__first.__weight_left") * 100).cast("double")
    target = F.when(F.col("__first").isNull(), (F.col("source_size") * max_epochs).cast("double")).otherwise(filled)
    return rows.select(source_col, "source_size", "weight", target.alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **options) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``: the words that the mix takes of each row,
    repetitions counted. Texts are counted where they lie; only ids and sizes are shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.withColumn("__order", order).withColumn("__bucket", F.substring("__order", 1, BUCKET_DIGITS))
    # 16**BUCKET_DIGITS rows a source at most, whatever its number of documents
    buckets = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__words"))
    per_source = targets(buckets.groupBy("source").agg(F.sum("__words").alias("source_size")), "source", **options)
    safe = F.when(F.col("source_size") > 0, F.col("source_size")).otherwise(F.lit(1))
    wanted = F.round(F.col("target")).cast("long")
    per_source = per_source.select("source", "source_size", "target", F.floor(wanted / safe).cast("long").alias("__whole"), wanted.alias("__wanted"))
    per_source = per_source.withColumn("__rest", F.col("__wanted") - F.col("__whole") * F.col("source_size")).drop("__wanted")
    up_to = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = buckets.withColumn("__before", F.coalesce(F.sum("__words").over(up_to), F.lit(0)))
    edges = edges.join(per_source.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    edges = edges.withColumnRenamed("source", "__s").withColumnRenamed("__bucket", "__b")
    joined = rows.join(edges, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).drop("__s", "__b")
    # inside the bucket at the edge, and only there, documents are put in order
    at_edge = (F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__words") > F.col("__rest"))
    inside = joined.filter(at_edge)
    place = Window.partitionBy("source", "__bucket").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("__before") + F.coalesce(F.sum("size").over(place), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - ahead))
    inside = inside.withColumn("__part", part.cast("long"))
    outside = joined.filter(~at_edge).withColumn("__part", F.when(F.col("__before") < F.col("__rest"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    out = outside.unionByName(inside)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("__whole") + F.col("__part")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed documents with their own columns: each row as often as it is taken whole, and once more
    cut after its last taken word where it is taken in part. Rows that the mix doesn't take are gone.
    Ids are expected to be unique; rows that share one are taken alike."""
    plan = plan_mix(docs, id_col, source_col, text_col, **options).select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    plan = plan.groupBy("__id").agg(F.max(F.struct("__taken", "__size")).alias("__t")).select("__id", "__t.*")
    rows = docs.join(plan, F.col(id_col).eqNullSafe(F.col("__id")))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPLIT), lambda w: w != "")
    copies = F.when(F.col("__size") > 0, F.ceil(F.col("__taken") / F.col("__size"))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), copies))).filter(F.col("__k") < copies)
    left = F.least(F.col("__size"), F.col("__taken") - F.col("__k") * F.col("__size"))
    cut = F.when(left >= F.col("__size"), F.col(text_col)).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), " "))
    return rows.withColumn(text_col, cut).select(*docs.columns)

