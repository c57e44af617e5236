"""Near duplicates among embeddings: tiled comparison in the order of principal components.

Equal vectors are one class, so that a large group of copies is compared once.
Unit vectors are turned into the axes of a PCA (of second moments, as cosines
know no mean), where the leading dimensions hold most of every product. Splits
along the leading axes part the vectors into boxes, boxes into blocks of about
BLOCK vectors. A unit vector's cosine with another is 1 - distance^2 / 2, so that
two boxes whose gap is too wide can't hold a pair; all other pairs of blocks are
compared, a task each. Within such a tile the leading dimensions are summed
first; the rest of a product is at most the product of the two suffix norms
(Cauchy-Schwarz), and a pair whose sum plus that bound is below the threshold is
stopped. Products within EPSILON of the threshold are decided by exactly rounded
sums over the input values.

The axes and boxes are fitted on a bounded sample (SAMPLE vectors); they decide
speed and balance alone. All vectors are compared and no pair is left out. A
tile yields sums of links by vector and a spanning forest of its links, never
its pairs, so that a group of n near copies moves n rows a tile.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing; vectors of unlike lengths don't link; repeated rows
are vectors of their own, rows of one id one node of the components; rows without
an id link with nothing, have a null component and are kept; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .jaccard_join import components

#: Vectors in a block; a tile compares two.
BLOCK = 2048
#: Vectors on which axes and boxes are fitted, about.
SAMPLE = 16_384
#: Leading axes along which boxes are cut.
LEAD = 8
#: Products this near to the threshold are computed again from the input values.
EPSILON = 1e-9
#: Rows of a tile that are compared at once with all of the other block.
STRIP = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, in double precision; scaled first, so that no square overflows."""
    v = vectors.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def cosine(a, b) -> float:
    """Cosine of two vectors with exactly rounded sums; scaled by powers of two, so that no square overflows or changes."""
    a, b = (np.ldexp(v.astype(np.float64), -int(np.frexp(np.abs(v.astype(np.float64)).max())[1])) for v in (a, b))
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


class Axes:
    """For each length of vectors in the sample: principal axes and boxes along the leading ones."""

    def __init__(self, sample: list[np.ndarray], rows: int):
        self.basis: dict[int, np.ndarray] = {}
        self.trees: dict[int, list[tuple[int, float, int, int]]] = {}  # (axis, at, left, right) or (-1, 0, box, 0)
        boxes = 0
        for size in sorted({len(v) for v in sample}):
            u = unit(np.array([v for v in sample if len(v) == size]))
            values, vectors = np.linalg.eigh(u.T @ u)
            self.basis[size] = vectors[:, np.argsort(-values)]
            lead = (u @ self.basis[size])[:, :LEAD]
            least = max(16, BLOCK * len(sample) // max(1, rows))
            tree: list = []
            boxes = self._grow(tree, lead, least, boxes)
            self.trees[size] = tree
        self.boxes = boxes

    @staticmethod
    def _grow(tree: list, lead: np.ndarray, least: int, boxes: int) -> int:
        """Cut at medians of the widest axis until a box has about `least` vectors of the sample."""
        todo = [(None, 0, lead)]
        while todo:
            parent, side, part = todo.pop()
            at = len(tree)
            if parent is not None:
                tree[parent][side] = at
            spread = part.max(axis=0) - part.min(axis=0)
            axis = int(spread.argmax())
            cut = float(np.median(part[:, axis]))
            low = part[:, axis] < cut
            if len(part) <= least or not low.any():
                tree.append([-1, 0.0, boxes, 0])
                boxes += 1
            else:
                tree.append([axis, cut, 0, 0])
                todo += [(at, 2, part[low]), (at, 3, part[~low])]
        return boxes

    def turn(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors in the axes of their length (as they are, if the sample has none of it)."""
        u, basis = unit(vectors), self.basis.get(vectors.shape[1])
        return u if basis is None else u @ basis

    def box(self, turned: np.ndarray) -> np.ndarray:
        """The box of each vector; lengths that the sample lacks have one of their own, below zero."""
        tree = self.trees.get(turned.shape[1])
        if tree is None:
            return np.full(len(turned), -turned.shape[1])
        out, todo = np.empty(len(turned), np.int64), [(0, np.arange(len(turned)))]
        while todo:
            at, rows = todo.pop()
            axis, cut, left, right = tree[at]
            if axis < 0:
                out[rows] = left
            elif len(rows):
                low = turned[rows, axis] < cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def _valid(column, size_of: int):
    """(rows, matrix) of the usable vectors of a list column, one for each length."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32 if size_of == 4 else np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        matrix = flat[starts[rows][:, None] + np.arange(size)] + 0.0  # one zero
        ok = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        if ok.any():
            yield rows[ok], matrix[ok]


def _keyed(vectors: DataFrame, axes: Axes, size_of: int) -> DataFrame:
    """id, key (of equal vectors; null where unusable), dim, box, lead (leading coordinates) and vec (bytes) of each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            key, dim, box, lead, vec = ([None] * n for _ in range(5))
            for rows, matrix in _valid(batch.column(1), size_of):
                turned = axes.turn(matrix)
                for i, m, b, t in zip(rows.tolist(), matrix, axes.box(turned).tolist(), turned[:, :LEAD].tolist(), strict=True):
                    vec[i] = m.tobytes()
                    key[i], dim[i], box[i], lead[i] = hashlib.blake2b(vec[i], digest_size=16).digest(), len(m), b, t + [0.0] * (LEAD - len(t))
            arrays = [batch.column(0), pa.array(key, pa.binary()), pa.array(dim, pa.int32()), pa.array(box, pa.int64()), pa.array(lead, pa.list_(pa.float64())), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "dim", "box", "lead", "vec"])

    return vectors.mapInArrow(run, "id long, key binary, dim int, box long, lead array<double>, vec binary")


def _sample(vectors: DataFrame, size_of: int) -> tuple[list[np.ndarray], int]:
    """(about SAMPLE usable vectors, the ones whose hashes are lowest; number of rows)."""
    rows = vectors.count()
    share = min(1.0, SAMPLE / max(1, rows))
    chosen = vectors.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE).select("v").toArrow().column(0)
    found = [m for chunk in chosen.chunks for _, matrix in _valid(chunk, size_of) for m in matrix]
    return found, rows


def tile(x: np.ndarray, y: np.ndarray, threshold: float):
    """Yield (rows, columns, sums) of strips of the tile: pairs of unit vectors whose products may reach the threshold, by leading dimensions first.

    What is left of a product after k dimensions is at most the product of the norms of the two rests."""
    size = x.shape[1]
    steps = [k for k in (8, 16, 32, 64, 128, 256, 512, 1024) if k < size] + [size]
    rest = lambda m: {k: np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", m[:, k:], m[:, k:]))) for k in steps}
    rest_x, rest_y, least = rest(x), rest(y), threshold - EPSILON
    for low in range(0, len(x), STRIP):
        rows, columns = np.arange(low, min(low + STRIP, len(x))), np.arange(len(y))
        sums, done, pairs = np.zeros((len(rows), len(columns))), 0, None
        for k in steps:
            if pairs is None:
                sums += x[rows, done:k] @ y[columns, done:k].T
                alive = sums + rest_x[k][rows][:, None] * rest_y[k][columns][None, :] >= least
                n = int(alive.sum())
                if n * 8 < alive.size or k == size:
                    at, to = np.nonzero(alive)
                    pairs = rows[at], columns[to], sums[at, to]
                else:
                    keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
                    if not (keep_r.all() and keep_c.all()):
                        rows, columns, sums = rows[keep_r], columns[keep_c], sums[np.ix_(keep_r, keep_c)]
            else:
                a, b, s = pairs
                s = s + np.einsum("ij,ij->i", x[a, done:k], y[b, done:k])
                keep = s + rest_x[k][a] * rest_y[k][b] >= least
                pairs = a[keep], b[keep], s[keep]
            done = k
            if pairs is not None and not len(pairs[0]):
                break
        if pairs is not None and len(pairs[0]):
            yield pairs


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """`label` (the least node of each node's tree) after the links (a, b), by hooking to the least and halving paths."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (label[label] != label).any():
            label = label[label]


def compare(blocks: DataFrame, axes: Axes, threshold: float, size_of: int) -> DataFrame:
    """key and n (rows linked to it), or a and b (links of a spanning forest), from all tiles."""
    kind = np.float32 if size_of == 4 else np.float64

    def run(frame):
        import pandas as pd

        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        same = not len(right)
        right = left if same else right
        raw = [np.frombuffer(b"".join(f["vec"]), kind).reshape(len(f), -1) if len(f) else np.zeros((0, 1), kind) for f in (left, right)]
        out_key, out_n, out_a, out_b = [], [], [], []
        if len(left) and len(right):
            x = axes.turn(raw[0])
            y = x if same else axes.turn(raw[1])
            many_x, many_y = left["many"].to_numpy(np.int64), right["many"].to_numpy(np.int64)
            links_x, links_y, offset = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), 0 if same else len(x)
            label = np.arange(offset + len(y))
            for a, b, s in tile(x, y, threshold):
                if same:
                    once = a < b
                    a, b, s = a[once], b[once], s[once]
                near = np.flatnonzero(np.abs(s - threshold) <= EPSILON)
                ok = s >= threshold
                for i in near.tolist():
                    ok[i] = cosine(raw[0][a[i]], raw[1][b[i]]) >= threshold
                a, b = a[ok], b[ok]
                np.add.at(links_x, a, many_y[b])
                np.add.at(links_y, b, many_x[a])
                label = forest(a, b + offset, label)
            if same:
                links_x += links_y
            rep = left["rep"].to_numpy(np.int64) if same else np.concatenate([left["rep"].to_numpy(np.int64), right["rep"].to_numpy(np.int64)])
            for f, links in ((left, links_x),) if same else ((left, links_x), (right, links_y)):
                found = np.flatnonzero(links)
                out_key += f["key"].iloc[found].tolist()
                out_n += links[found].tolist()
            moved = np.flatnonzero((label != np.arange(len(label))) & (rep[label] != rep))
            out_a, out_b = rep[label[moved]].tolist(), rep[moved].tolist()
        return pd.DataFrame({"key": out_key + [None] * len(out_a), "n": pd.array(out_n + [None] * len(out_a), "Int64"), "a": pd.array([None] * len(out_n) + out_a, "Int64"), "b": pd.array([None] * len(out_n) + out_b, "Int64")})

    return blocks.groupBy("i", "j").applyInPandas(run, "key binary, n long, a long, b long")


def _blocks(classes: DataFrame, threshold: float) -> DataFrame | None:
    """The classes with i, j and side: once for each pair of blocks that a class's block is compared in; None without classes.

    Boxes are few (the sample's boxes and one for each length that it lacks), so
    that their bounds are held by the driver; blocks aren't."""
    ends = [f(F.get("lead", F.lit(k))).alias(f"{e}{k}") for k in range(LEAD) for e, f in (("lo", F.min), ("hi", F.max))]
    boxes = classes.groupBy("dim", "box").agg(F.count("*").alias("m"), *ends).orderBy("dim", "box").collect()
    if not boxes:
        return None
    chunks = [-(-r.m // BLOCK) for r in boxes]
    starts = np.concatenate(([0], np.cumsum(chunks)))
    low, high = (np.array([[r[f"{e}{k}"] for k in range(LEAD)] for r in boxes]) for e in ("lo", "hi"))
    dims = np.array([r.dim for r in boxes])
    rows = []
    for at, r in enumerate(boxes):
        gap = np.maximum(0.0, np.maximum(low - high[at], low[at] - high))
        near = np.flatnonzero(((gap * gap).sum(axis=1) <= 2 * (1 - threshold) + EPSILON) & (dims == r.dim))
        rows.append((r.dim, r.box, int(starts[at]), chunks[at], [(int(starts[k]), int(starts[k + 1]) - 1) for k in near]))
    plan = classes.sparkSession.createDataFrame(rows, "dim int, box long, start long, chunks int, near array<struct<first:long,last:long>>")
    own = classes.join(F.broadcast(plan), ["dim", "box"]).withColumn("own", F.col("start") + F.pmod(F.xxhash64("key"), F.col("chunks")))
    span = own.select("key", "rep", "many", "vec", "own", F.explode("near").alias("near"))
    other = span.select("key", "rep", "many", "vec", "own", F.explode(F.sequence("near.first", "near.last")).alias("other"))
    return other.select(
        "key", "rep", "many", "vec", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`id_col`, n_links (other vectors at or above the threshold), component_id (least id that links reach) and kept, a row for each row."""
    element = vectors.schema[vector].dataType.elementType.simpleString()
    size_of = 4 if element == "float" else 8
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v") if size_of == 4 else F.col(vector).cast("array<double>").alias("v"))
    sample, rows = _sample(source, size_of)
    axes = Axes(sample, rows)
    keyed = materialize(_keyed(source, axes, size_of), "vectors-keyed")
    usable = keyed.where(F.col("id").isNotNull() & F.col("key").isNotNull())
    classes = materialize(
        usable.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("many"), *[F.first(c).alias(c) for c in ("dim", "box", "lead", "vec")]), "vectors-classes"
    )
    members, named = keyed.select("id", "key"), classes.select("key", "rep", "many")
    blocks = _blocks(classes, threshold)
    if blocks is None:
        found = named.withColumns({"more": F.lit(0).cast("long"), "component": F.col("rep")})
    else:
        out = materialize(compare(blocks, axes, threshold, size_of), "vectors-links")
        sums = out.where("key is not null").groupBy("key").agg(F.sum("n").alias("more"))
        labels = components(out.where("a is not null").select("a", "b")).toDF("rep", "c")
        found = named.join(sums, "key", "left").join(labels, "rep", "left").select("key", "rep", "many", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("c", "rep").alias("component"))
        found = materialize(found, "vectors-found")
        discard(out)
        discard(classes)
    linked = F.col("id").isNotNull() & F.col("many").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("id"))
    both = members.join(found, "key", "left")
    return both.select(
        F.col("id").alias(id_col), F.when(linked, F.col("many") - 1 + F.col("more")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"),
    )
