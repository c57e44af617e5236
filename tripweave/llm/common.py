"""Shared pieces of the training-data operators: tables, shared folders, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than space and U+0009 to U+000D.
WORD = re.compile(r"[^ \t-\r]+")
#: The same for Spark's split(): what stands between two words.
BETWEEN_WORDS = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z only.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder (any path that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests), a new local one."""
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running tasks only, and
    what stands above is never computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no later result reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/llm-tables/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of `text`, A-Z lower-cased; null and blank text give an empty array."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS)
    return F.filter(split, lambda w: w != "")


def with_shingle_hashes(df: DataFrame, text: str, n: int, out: str) -> DataFrame:
    """Add `out`: the sorted distinct 64-bit hashes of the n-word shingles of column `text`.

    A text of 1 to n-1 words is one shingle; without words the array is empty.
    The word hashes are a column of their own, so that the window below reads
    them and does not compute them again for each position."""
    at = f"_{out}_words"
    hashed = F.col(f"`{at}`")
    size = F.size(hashed)
    many = F.transform(
        F.sequence(F.lit(1), size - (n - 1)),
        lambda i: F.xxhash64(*[F.get(hashed, i + (k - 1)) for k in range(n)]),
    )
    whole = F.when(size > 0, F.array(F.xxhash64(hashed, F.lit(n)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(at, F.transform(words(F.col(f"`{text}`")), lambda w: F.xxhash64(w)))
    df = df.withColumn(out, F.when(size >= n, many).otherwise(whole)).drop(at)
    return df.withColumn(out, F.sort_array(F.array_distinct(F.col(f"`{out}`"))))


#: Rows that a Python task turns into lists at once; bounds its memory with long texts.
SLICE = 512


def map_rows(df: DataFrame, function, schema: str, rows: int = SLICE) -> DataFrame:
    """mapInArrow with plain lists: function(list per column of `df`) -> list per column of `schema`.

    `function` gets at most `rows` rows; it may return any number of rows, or
    None. A function with a `start` method is first called so, once per task."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        work = function.start() if hasattr(function, "start") else function
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work(*[c.to_pylist() for c in part.columns])
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most `rows` (text, label) pairs, the ones whose ids hash lowest.

    The bound is on what the driver holds and fits on; the ids are chosen from
    the labels alone, so that the documents are read once and not shuffled."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("l_id"))
        .agg(F.max(label).alias("l_label"))
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(rows)
    )
    found = docs.select(F.col(id_col).alias("l_id"), F.col(text).alias("l_text")).join(F.broadcast(chosen), "l_id")
    kept = sorted(found.collect(), key=lambda r: (r.l_id, r.l_text or ""))
    return [(r.l_text or "", int(r.l_label)) for r in kept]
