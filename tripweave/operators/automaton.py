"""Rules whose state depends on the state before, without a loop.

A rule with a small state is a function of the state before for each row; such
functions compose, and composition is associative. Spark's windows compose them
for two states in closed form: a row either sets the state, keeps it or turns
it over, so that the state is what was last set, turned over as often as rows
since then do. Rules with a counter reduce to run lengths. What remains, rules
whose state is a number or a point, is replayed in order (`keep_by_replay`,
`replay`), in stretches between rows that don't depend on what was before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import WindowSpec


def two_state(rows: DataFrame, order: WindowSpec, from_off: Column, from_on: Column, out: str, begins_on: bool = False) -> DataFrame:
    """Add boolean `out`: the state after each row, given what follows on either state before it (null: off).

    `order` has a partition and an order without ties; both windows share it, so that Spark sorts once."""
    off, on = F.coalesce(from_off, F.lit(False)), F.coalesce(from_on, F.lit(False))
    df = rows.withColumns({"_off": off, "_sets": off == on})
    df = df.withColumn("_turns", F.sum((F.col("_off") & ~F.col("_sets")).cast("long")).over(order))
    df = df.withColumn("_set", F.last(F.when(F.col("_sets"), F.struct("_off", "_turns")), ignorenulls=True).over(order))
    turned = (F.col("_turns") - F.coalesce(F.col("_set._turns"), F.lit(0))) % 2 == 1
    return df.withColumn(out, F.coalesce(F.col("_set._off"), F.lit(begins_on)) != turned).drop("_off", "_sets", "_turns", "_set")


def keep_by_replay(rows: DataFrame, key: list[str], order: list[str], starts: Column, inputs: list[str], rule: Callable, columns: list[str]) -> DataFrame:
    """`columns` of the rows that `rule` keeps, stretch by stretch.

    `starts` (over `key`, ordered by `order`) marks rows that are kept whatever was
    before them; the first row of a key is one. Stretches, not keys, are dealt to
    the tasks, and each task streams its rows: rule(state, row) -> (kept, state),
    state None at a start."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(*order)
    df = rows.withColumn("_start", F.coalesce(starts, F.lit(False)) | (F.row_number().over(w) == 1))
    df = df.withColumn("_stretch", F.sum(F.col("_start").cast("long")).over(w))
    names = list(dict.fromkeys([*columns, *inputs, *key, *order, "_start", "_stretch"]))
    dealt = df.select(*names).repartition(*key, "_stretch").sortWithinPartitions(*key, "_stretch", *order)

    def run(batches):
        import pyarrow as pa

        state = None
        for batch in batches:
            kept = []
            for start, *row in zip(*(batch.column(c).to_pylist() for c in ("_start", *inputs)), strict=True):
                ok, state = rule(None if start else state, row)
                kept.append(ok)
            yield batch.filter(pa.array(kept, pa.bool_())).select(columns)

    return dealt.mapInArrow(run, StructType([df.schema[c] for c in columns]))


def replay(rows: DataFrame, key: str, order: str, inputs: list[str], rule: Callable, outputs: str) -> DataFrame:
    """The rows with what `rule` gives for each in the order of its key: rule(state, row) -> (tuple of `outputs`, state), state None at the first.

    Rows are streamed through the tasks, whatever the size of a key."""
    dealt = rows.repartition(key).sortWithinPartitions(key, order)
    added = StructType.fromDDL(outputs)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(added)

    def run(batches):
        import pyarrow as pa

        state, last = None, run  # no key equals it
        for batch in batches:
            got = []
            for at, *row in zip(*(batch.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                if at != last:
                    state, last = None, at
                out, state = rule(state, row)
                got.append(out)
            new = [pa.array([g[i] for g in got], f.type) for i, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *kinds.names])

    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, *added.fields]))
