"""Benchmark decontamination: size-partitioned MinHash containment search (DataFrame functions only).

Documents and test items become sets of word shingles. Documents are parted by
set size into classes of doubling size. In the class up to u shingles the hash
range is cut into b bins, b being the power of two next to BINS_PER_SHINGLE * u,
and the sketch of a set keeps the least hash of each bin (one-permutation
MinHash): a long document gets as many bins as its length asks for, so that a
short item inside it still meets it in some bin. Every item is sketched for
every class. With a load of at most half a shingle per bin a shared shingle is
the least of its bin in the document with a chance of 0.78 at least, so that an item of q
shingles of which 0.8 q are shared is missed with a chance below 0.22**(0.8 q).

Items below SHORT_ITEM shingles, which sketches may miss, are looked for by all
shingles of the documents, so none of them is missed.

Equal pairs of class and least hash make candidates; these are verified by the exact
containment of the item's shingles in the document.

Defined results: null and blank texts have no shingles and meet nothing; texts
of 1 to 4 words are one shingle; repeated documents are each reported; repeated
items are each reported, items without an id too; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_shingle_hashes

SHINGLE = 5
CONTAINMENT = 0.8
BINS_PER_SHINGLE = 2
#: Items of fewer shingles are matched by all shingles of the documents.
SHORT_ITEM = 10
#: Size classes: texts of up to 2**31 shingles, more than a row can hold.
CLASSES = 32
#: Rows of the items' sketches and shingles up to which they go to every task (32 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def size_class(size: Column) -> Column:
    """Class c holds the sets of more than 2**(c-1) and at most 2**c shingles."""
    return F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def sketch(sorted_hashes: Column, klass: Column) -> Column:
    """The least hash of each bin of the class; the hashes come sorted, and bins are ranges of hashes."""
    # A bin is what the highest bits of a hash say: b = BINS_PER_SHINGLE * 2**class bins.
    shift = F.lit(64) - (klass + (BINS_PER_SHINGLE.bit_length() - 1))
    return F.filter(
        sorted_hashes,
        lambda h, i: (i == 0) | (F.call_function("shiftright", h, shift) != F.call_function("shiftright", F.get(sorted_hashes, i - 1), shift)),
    )


def _spread(small: DataFrame) -> DataFrame:
    """`small` with a broadcast hint, if its number of rows is within the bound."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """d_id, d_key, i_key: documents and items (each with `hashes`) whose sketches share a least hash, or any shingle where the item is short, once each."""
    sized = docs.withColumn("klass", size_class(F.size("hashes")))
    kept = sized.select("d_id", "d_key", "klass", F.explode_outer(sketch(F.col("hashes"), F.col("klass"))).alias("h"))
    for_class = items.withColumn("klass", F.explode_outer(F.sequence(F.lit(0), F.lit(CLASSES - 1))))
    sketches = for_class.select("i_key", "klass", F.explode_outer(sketch(F.col("hashes"), F.col("klass"))).alias("h"))
    sketches = sketches.where(F.col("h").isNotNull())
    # One key that is never null: Spark would push a test of `klass` for null below the arrays.
    key = F.xxhash64("klass", "h").alias("key")
    kept = kept.where(F.col("h").isNotNull()).select("d_id", "d_key", key)
    sketches = sketches.select("i_key", key)
    found = kept.join(_spread(sketches), "key").select("d_id", "d_key", "i_key")
    short = items.where(F.size("hashes") < SHORT_ITEM).select("i_key", F.explode_outer("hashes").alias("h")).where(F.col("h").isNotNull())
    every = docs.select("d_id", "d_key", F.explode_outer("hashes").alias("h")).where(F.col("h").isNotNull())
    return found.union(every.join(_spread(short), "h").select("d_id", "d_key", "i_key")).distinct()


def contaminated(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """d_id, d_key (hash of the text), i_id, n_item, n_shared: pairs whose containment is `containment` or more; equal rows once."""
    sets = items.select(F.col(item_id).alias("i_id"), F.col(item_text).alias("t"))
    sets = with_shingle_hashes(sets, "t", SHINGLE, "hashes").drop("t").distinct()
    sets = sets.withColumn("i_key", F.xxhash64("i_id", "hashes"))  # ids may be null
    rows = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text).alias("d_key"), F.col(text).alias("t"))
    found = candidates(with_shingle_hashes(rows, "t", SHINGLE, "hashes").drop("t"), sets)

    # Exact check: the shingles of the candidates' documents against those of their items.
    asked = found.groupBy("d_id", "d_key").agg(F.collect_set("i_key").alias("asked"))
    again = rows.join(asked.withColumnsRenamed({"d_id": "a_id", "d_key": "a_key"}), F.col("d_id").eqNullSafe(F.col("a_id")) & (F.col("d_key") == F.col("a_key")))
    again = with_shingle_hashes(again, "t", SHINGLE, "hashes")
    own = again.select("d_id", "d_key", "asked", F.explode_outer("hashes").alias("h"))
    parts = sets.select("i_id", "i_key", F.size("hashes").alias("n_item"), F.explode_outer("hashes").alias("h"))
    shared = own.join(_spread(parts), "h").where(F.array_contains("asked", F.col("i_key")))
    counted = shared.groupBy("d_id", "d_key", "i_key", "i_id", "n_item").agg(F.count_distinct("h").alias("n_shared"))
    return counted.where(F.col("n_shared") >= F.lit(containment) * F.col("n_item")).drop("i_key")


def report(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """`id_col`, `item_id`, n_item_shingles, n_shared and containment, a row for each pair found."""
    found = contaminated(docs, items, containment, id_col, text, item_id)
    return found.select(
        F.col("d_id").alias(id_col), F.col("i_id").alias(item_id), F.col("n_item").cast("long").alias("n_item_shingles"),
        F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents in which no item is contained, all columns as they were."""
    hit = contaminated(docs, items, containment, id_col, text, item_id).select("d_id", "d_key").distinct()
    rows = docs.withColumn("__op6_key", F.xxhash64(text))
    return rows.join(hit, rows[id_col].eqNullSafe(hit["d_id"]) & (rows["__op6_key"] == hit["d_key"]), "left_anti").drop("__op6_key")
