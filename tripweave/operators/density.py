"""Density clusters over time: hierarchical clusters, relabelling in time order, stops and their weighted centres."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .clean import by_time
from .lineage import cut

#: Distinct positions of a user in a block; a tile holds two.
BLOCK = 1024
KEY = ["user_id"]


# --- positions and tiles -------------------------------------------------------------------


def positions(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """user_id, pos, block, easting, northing, m: a user's distinct positions in order, and the points at each."""
    spots = points.groupBy("user_id", "easting", "northing").agg(F.count("*").alias("m"))
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("easting", "northing")) - 1
    return spots.withColumn("pos", pos.cast("long")).withColumn("block", F.floor(F.col("pos") / block))


def tiles(spots: DataFrame) -> DataFrame:
    """Each position once for each pair of its user's blocks that its own is in: i, j and side (0 in block i, 1 in block j).

    Every two positions meet in a tile, and no tile holds more than two blocks,
    whatever a user's number of points."""
    most = F.max("block").over(Window.partitionBy("user_id"))
    df = spots.withColumn("_most", most).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), "_most"))).drop("_most")
    df = df.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other"), "side": (F.col("block") > F.col("_other")).cast("int")})
    return df.drop("_other", "block")


def _ordered(frame):
    """A tile's positions in order, so that equal input gives equal output."""
    return frame.sort_values("pos", kind="stable").reset_index(drop=True)


def _cores(e, n, m, min_samples: int):
    """The core distance of each position of a user, in one matrix."""
    need, out = min(min_samples + 1, int(m.sum())), []
    k = min(need, len(m))
    for at in range(0, len(m), 256):
        d = np.sqrt((e[at : at + 256, None] - e) ** 2 + (n[at : at + 256, None] - n) ** 2)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        far = np.take_along_axis(d, near, axis=1)
        order = np.argsort(far, axis=1)
        counts = np.cumsum(np.take_along_axis(m[near], order, axis=1), axis=1)
        out.append(np.take_along_axis(np.take_along_axis(far, order, axis=1), (counts >= need).argmax(axis=1)[:, None], axis=1)[:, 0])
    return np.concatenate(out)


def _tree(e, n, core) -> list[tuple[int, int, float]]:
    """A minimum spanning tree of positions by mutual reachability, after Prim: (places of two positions, the lesser first, and weight)."""
    w = np.maximum(np.sqrt((e[:, None] - e) ** 2 + (n[:, None] - n) ** 2), np.maximum(core[:, None], core))
    w[np.isnan(w)] = np.inf
    least, near, out = np.full(len(e), np.inf), np.zeros(len(e), np.int64), []
    at = 0
    for _ in range(len(e) - 1):
        w[:, at] = least[at] = np.inf  # is in the tree
        row = w[at]
        near[row < least] = at
        np.minimum(row, least, out=least)
        at = int(least.argmin())
        a = int(near[at])
        out.append((min(a, at), max(a, at), float(least[at])))
    return out


def _by_user(spots: DataFrame, run, names: list[str], out: str) -> DataFrame:
    """user_id, easting, northing, m, pos and the columns `out` that `run` gives for the arrays easting, northing and m of each user: for users of one block.

    A user is a row of arrays and Spark deals out batches of rows, so that the
    many small users cost no group, and no stream of their own, each."""
    user = spots.schema["user_id"].dataType.simpleString()
    own = ["easting", "northing", "m"]
    rows = spots.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", *own))).alias("x")).select("user_id", "x.pos", *[f"x.{c}" for c in own])

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = {c: batch.column(c).flatten() for c in ("pos", *own)}
            e, n, m = (flat[c].to_numpy(zero_copy_only=False) for c in own)
            at = batch.column("pos").offsets.to_numpy()
            at = at - at[0]
            found = [run(e[i:j], n[i:j], m[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            users = batch.column("user_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at))))
            more = [pa.array(np.concatenate([f[k] for f in found])) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([users, *[flat[c] for c in own], flat["pos"], *more], ["user_id", *own, "pos", *names])

    return rows.mapInArrow(each, f"user_id {user}, easting double, northing double, m long, pos long, {out}")


def _parted(spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The positions of users of one block and of larger users."""
    every = spots.withColumn("_last", F.max("block").over(Window.partitionBy("user_id")))
    return every.where("_last = 0").drop("_last"), every.where("_last > 0").drop("_last")


def core_distances(spots: DataFrame, min_samples: int = 20) -> DataFrame:
    """The positions with core: the distance to a point's `min_samples`-th neighbour (to its farthest, if a user has fewer), points at the same position counted."""

    def run(frame):
        import pandas as pd

        frame = _ordered(frame)
        xy, m = frame[["easting", "northing"]].to_numpy(), frame["m"].to_numpy(np.int64)
        first = frame["i"].iloc[0] == frame["j"].iloc[0]
        side, out = frame["side"].to_numpy(), []
        for at in range(0, len(xy), 256):
            d = np.sqrt(((xy[at : at + 256, None] - xy[None]) ** 2).sum(axis=2))
            if not first:  # the own block is compared in its own tile
                d[side[at : at + 256, None] == side[None]] = np.inf
            k = min(min_samples + 1, d.shape[1])
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            far = np.take_along_axis(d, near, axis=1)
            for row, cols in zip(far, near, strict=True):
                ok = np.isfinite(row)
                out.append(sorted(zip(row[ok].tolist(), m[cols[ok]].tolist(), strict=True)))
        return pd.DataFrame({"user_id": frame["user_id"], "pos": frame["pos"], "near": [[{"d": d, "m": k} for d, k in r] for r in out]})

    user = spots.schema["user_id"].dataType.simpleString()
    names = ["user_id", "easting", "northing", "m", "pos", "block"]
    one, spots = _parted(spots.select(*names))
    one = _by_user(one, lambda e, n, m: (_cores(e, n, m, min_samples),), ["core"], "core double").withColumn("block", F.lit(0).cast("long"))
    found = tiles(spots).groupBy("user_id", "i", "j").applyInPandas(run, f"user_id {user}, pos long, near array<struct<d:double,m:long>>")
    lists = found.groupBy("user_id", "pos").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    points = F.sum("m").over(Window.partitionBy("user_id"))
    df = spots.withColumn("_need", F.least(F.lit(min_samples + 1).cast("long"), points)).join(lists, ["user_id", "pos"])
    reached = F.aggregate(
        "near", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d")),
        lambda acc, x: F.struct((acc["n"] + x["m"]).alias("n"), F.when(acc["n"] < F.col("_need"), x["d"]).otherwise(acc["d"]).alias("d")),
    )
    return one.select(*names, "core").unionByName(df.withColumn("core", reached["d"]).select(*names, "core"))


def spanning_tree(spots: DataFrame) -> DataFrame:
    """user_id, a, b, w: a minimum spanning tree of each user's positions by mutual reachability, the greatest of distance and both cores.

    A tree of all positions lies in the union of the trees of all tiles (an edge
    that is greatest on a cycle of a tile is so in the whole). Users of one block
    have theirs at once; the others' edges go through Boruvka rounds."""
    user = spots.schema["user_id"].dataType.simpleString()

    def run(frame):
        import pandas as pd

        frame = _ordered(frame)
        e, n, core, pos = (frame[c].to_numpy() for c in ("easting", "northing", "core", "pos"))
        out = [(pos[a], pos[b], w) for a, b, w in _tree(e, n, core)]
        rows = {"user_id": [frame["user_id"].iloc[0]] * len(out), "a": [min(x[:2]) for x in out], "b": [max(x[:2]) for x in out], "w": [x[2] for x in out]}
        return pd.DataFrame(rows | {"last": frame["last"].iloc[0]})

    last = F.max("block").over(Window.partitionBy("user_id"))
    every = cut(tiles(spots.withColumn("last", last)).groupBy("user_id", "i", "j").applyInPandas(run, f"user_id {user}, a long, b long, w double, last long"), "tree-edges")
    return every.where("last = 0").drop("last").unionByName(boruvka(every.where("last > 0").select("user_id", "a", "b", "w").distinct()))


def boruvka(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of the edges (user_id, a, b, w), by rounds: each component takes its least edge (ties by its ends), joined ones become one.

    A round at least halves the components; each is a few joins and is written
    to the shared folder."""
    kept, left = [], cut(edges.select("*", F.col("a").alias("ca"), F.col("b").alias("cb")), "forest-left")
    while not left.isEmpty():
        ends = left.select("user_id", F.col("ca").alias("c"), "w", "a", "b", F.col("cb").alias("to")).union(left.select("user_id", "cb", "w", "a", "b", "ca"))
        least = ends.groupBy("user_id", "c").agg(F.min(F.struct("w", "a", "b", "to")).alias("x")).select("user_id", "c", "x.*")
        least = cut(least, "forest-least")
        kept.append(least.select("user_id", "a", "b", "w").distinct())
        named = components(least.select("user_id", F.col("c").alias("a"), F.col("to").alias("b")))
        for side in ("ca", "cb"):
            left = left.join(named.select("user_id", F.col("node").alias(side), "root"), ["user_id", side]).drop(side).withColumnRenamed("root", side)
        left = cut(left.where("ca <> cb"), "forest-left")
    out = kept[0] if kept else edges.limit(0)
    for more in kept[1:]:
        out = out.union(more)
    return out


def components(links: DataFrame, key: str = "user_id", a: str = "a", b: str = "b") -> DataFrame:
    """`key`, node, root: each node of the links and the least node that it reaches within its key, by rounds of repeated minima and pointer jumping.

    No key is gathered anywhere: a round is an aggregation over links and a join of nodes."""
    both = links.select(key, F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(key, b, a)).distinct()
    both = cut(both, "component-links")
    label = cut(both.groupBy(key, "node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "component-labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "other"), [key, "other"]).groupBy(key, "node").agg(F.min("root").alias("near"))
        step = label.withColumnRenamed("root", "old").join(near, [key, "node"]).withColumn("root", F.least("old", "near"))
        jump = label.select(key, F.col("node").alias("root"), F.col("root").alias("jump"))
        new = cut(step.join(jump, [key, "root"], "left").select(key, "node", F.least("root", "jump").alias("root"), "old"), "component-labels")
        label = new.drop("old")
        if new.where("root <> old").isEmpty():
            return label


# --- the hierarchy -------------------------------------------------------------------------


class Hierarchy:
    """A user's condensed tree from the spanning tree of the positions.

    Positions and edges of equal weight are joined at once, so that ties have
    one result. A position of m points is m points up to its core distance."""

    def __init__(self, m: list[int], core: list[float], edges: list[tuple[int, int, float]], least: int):
        n = len(m)
        self.size, self.weight, self.children = list(m), list(core), [[] for _ in m]
        self.fall: list[tuple[int, float]] = [(0, 0.0)] * n  # cluster and lambda that each position leaves
        top, root = list(range(n)), list(range(n))  # union-find; the tree node of each set

        def find(i):
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        edges, at = sorted(edges, key=lambda e: e[2]), 0
        while at < len(edges):
            w, joined = edges[at][2], {}
            while at < len(edges) and edges[at][2] == w:
                a, b = find(edges[at][0]), find(edges[at][1])
                if a != b:
                    parts = joined.pop(a, [root[a]]) + joined.pop(b, [root[b]])
                    top[b] = a
                    joined[a] = parts
                at += 1
            for a, parts in joined.items():
                root[a] = len(self.size)
                self.size.append(sum(self.size[p] for p in parts))
                self.weight.append(w)
                self.children.append(parts)
        self.n, self.root, self.least = n, root[find(0)], least
        self._condense()

    def _condense(self) -> None:
        self.birth, self.parent, self.stability, self.most = [0.0], [-1], [0.0], [0.0]
        todo = [(self.root, 0)]
        while todo:
            node, c = todo.pop()
            level = 1 / self.weight[node] if self.weight[node] else np.inf
            # A position that joins at its own core distance is so many points until then.
            big = [k for k in self.children[node] if self.size[k] >= self.least and not (k < self.n and self.weight[k] == self.weight[node])]
            self.most[c] = max(self.most[c], level)
            if len(big) < 2:
                todo += [(k, c) for k in big]
            else:
                for k in big:
                    self.birth.append(level)
                    self.parent.append(c)
                    self.stability.append(0.0)
                    self.most.append(0.0)
                    self.stability[c] += (level - self.birth[c]) * self.size[k]
                    todo.append((k, len(self.birth) - 1))
            chosen = set(big)
            small = [k for k in self.children[node] if k not in chosen] if self.children[node] else [node]
            while small:
                k = small.pop()
                if k < self.n:
                    self.fall[k] = (c, level)
                    self.stability[c] += (level - self.birth[c]) * self.size[k]
                else:
                    small += self.children[k]

    def labels(self) -> list[tuple[int, float]]:
        """(cluster or -1, probability) of each position: the clusters of greatest excess of mass, the whole included."""
        count = len(self.birth)
        chosen, total, under = [True] * count, list(self.stability), [0.0] * count
        has = [False] * count
        for c in range(count - 1, -1, -1):  # children come after their parents
            if has[c] and under[c] > total[c]:
                chosen[c], total[c] = False, under[c]
            if c:
                under[self.parent[c]] += total[c]
                has[self.parent[c]] = True
        of = [-1] * count  # the outermost chosen cluster around each
        for c in range(count):
            above = of[self.parent[c]] if c else -1
            of[c] = above if above >= 0 else c if chosen[c] else -1
        single = of[0] == 0
        out = []
        for c, level in self.fall:
            own = of[c]
            if own < 0 or (single and level < self.most[0]):
                out.append((-1, 0.0))
            else:
                most = self.most[own]
                out.append((own, 1.0 if most == 0 or not np.isfinite(level) else min(level, most) / most))
        return out


def _clusters(m: list[int], core: list[float], edges: list[tuple[int, int, float]], least: int, more_than: int) -> tuple[list[int], list[float]]:
    """The cluster (-1: noise, else numbered by the least position) and probability of each of a user's positions."""
    found = [(-1, 0.0)] * len(m) if sum(m) <= more_than else Hierarchy(m, core, edges, least).labels()
    names: dict[int, int] = {}
    return [c if c < 0 else names.setdefault(c, len(names)) for c, _ in found], [p for _, p in found]


def hierarchical(points: DataFrame, min_cluster_size: int = 15, min_samples: int = 20, more_than: int = 10, block: int = BLOCK) -> DataFrame:
    """Points with cluster (-1: noise, else numbered by the least position) and probability: hierarchical density clusters of each user's points.

    Users of one block go through distances, tree and hierarchy at once. For
    larger ones, core distances and spanning trees are computed in tiles of
    positions; what is left for a user is a tree with an edge for each position,
    which one small pass condenses. Users of `more_than` points or fewer are noise."""
    user = points.schema["user_id"].dataType.simpleString()
    spots = cut(positions(points, block), "density-positions")
    one, _ = _parted(spots)

    def whole(e, n, m):
        if m.sum() <= more_than:
            return np.full(len(m), -1), np.zeros(len(m))
        core = _cores(e, n, m, min_samples)
        cluster, probability = _clusters(m.tolist(), core.tolist(), _tree(e, n, core), min_cluster_size, more_than)
        return np.array(cluster, np.int64), np.array(probability, np.float64)

    names = ["user_id", "easting", "northing", "cluster", "probability"]
    placed = _by_user(one, whole, names[3:], "cluster long, probability double").select(*names)
    if not spots.where("block > 0").isEmpty():
        large = spots.join(spots.where("block > 0").select("user_id").distinct(), "user_id", "left_semi")
        placed = placed.unionByName(_large(large, user, min_cluster_size, min_samples, more_than).select(*names))
    return points.join(placed, ["user_id", "easting", "northing"], "left")


def _large(spots: DataFrame, user: str, min_cluster_size: int, min_samples: int, more_than: int) -> DataFrame:
    """Positions of users of more than one block, with cluster and probability."""
    cores = cut(core_distances(spots, min_samples), "density-cores")
    tree = spanning_tree(cores)
    none = F.lit(None)
    nodes = cores.select("user_id", "pos", "m", "core", none.cast("long").alias("b"), none.cast("double").alias("w"))
    both = nodes.unionByName(tree.select("user_id", F.col("a").alias("pos"), none.cast("long").alias("m"), none.cast("double").alias("core"), "b", "w"))

    def run(frame):
        import pandas as pd

        own = frame[frame["b"].isna()].sort_values("pos")
        links = frame[frame["b"].notna()]
        edges = list(zip(links["pos"].tolist(), links["b"].astype("int64").tolist(), links["w"].tolist(), strict=True))
        cluster, probability = _clusters(own["m"].astype("int64").tolist(), own["core"].tolist(), edges, min_cluster_size, more_than)
        return pd.DataFrame({"user_id": own["user_id"].tolist(), "pos": own["pos"].tolist(), "cluster": cluster, "probability": probability})

    labels = both.groupBy("user_id").applyInPandas(run, f"user_id {user}, pos long, cluster long, probability double")
    return spots.select("user_id", "pos", "easting", "northing").join(labels, ["user_id", "pos"])


def certain(points: DataFrame) -> DataFrame:
    """Cluster labels of less than full probability become noise."""
    return points.withColumn("cluster", F.when(F.col("probability") < 1.0, F.lit(-1)).otherwise(F.col("cluster")))


# --- clusters in time ----------------------------------------------------------------------


def relabel_in_time(points: DataFrame, label: str = "cluster", out: str = "stop", streak: int = 4) -> DataFrame:
    """Add `out`: numbers from 0 that go up where the label of two successive clustered points differs, or after exactly `streak` points of noise; noise stays -1.

    The noise counter goes on through clusters, starts anew only where it fires,
    and fires only at a point whose label is that of the clustered point before.
    So it fires at the first such point with 4, 8, 12... points of noise before it,
    as long as no multiple has been missed: a count of multiples met that is still
    equal to the multiple."""
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    noise = F.col(label) == -1
    df = points.withColumns({"_prev": F.last(F.when(~noise, F.col(label)), ignorenulls=True).over(before), "_noise": F.sum(noise.cast("long")).over(by_time())})
    same = ~noise & F.coalesce(F.col(label) == F.col("_prev"), F.lit(True))
    df = df.withColumn("_level", F.when(same & (F.col("_noise") > 0) & (F.col("_noise") % streak == 0), F.col("_noise") / streak))
    df = df.withColumn("_met", F.col("_level").isNotNull() & ~F.col("_level").eqNullSafe(F.last("_level", ignorenulls=True).over(before)))
    df = df.withColumn("_fires", F.col("_met") & (F.sum(F.col("_met").cast("long")).over(by_time()) == F.col("_level")))
    number = F.sum(((~noise & ~same) | F.col("_fires")).cast("long")).over(by_time())
    return df.withColumn(out, F.when(noise, F.lit(-1)).otherwise(number)).drop("_prev", "_noise", "_level", "_met", "_fires")


def stop_points(points: DataFrame, min_s: int, key: str = "stop", compat: bool = True) -> DataFrame:
    """Points of the clusters in time that last `min_s` or longer; a user's last cluster is lost with `compat`, as in the tools at hand."""
    w = Window.partitionBy("user_id", key)
    df = points.where(F.col(key) != -1)
    if compat:
        df = df.withColumn("_last", F.max(key).over(Window.partitionBy("user_id"))).where(F.col(key) < F.col("_last")).drop("_last")
    df = df.withColumn("_lasts", F.max("t").over(w) - F.min("t").over(w))
    return df.where(F.col("_lasts") >= min_s).drop("_lasts")


def nearest_other(spots: DataFrame, key: list[str], start_m: float = 4.0, growth: float = 8.0, few: int = 64) -> DataFrame:
    """`spots` (key, easting, northing, distinct) with nearest: the distance to the nearest other one of the same key; null if there is none.

    Up to `few` spots of a key are compared as one row. Larger keys go through grid
    rings: what is found within a cell's side is final, the rest looks again in
    cells `growth` times as wide. The rings' tables are never sent to the driver."""
    left = cut(spots.withColumn("_many", F.count("*").over(Window.partitionBy(*key))), "rings-left")
    own = [c for c in spots.columns if c not in key]
    groups = left.where(F.col("_many") <= few).groupBy(*key).agg(F.collect_list(F.struct(*own)).alias("_all"))
    groups = groups.select(*key, "_all", F.explode("_all").alias("_x"))
    others = F.filter("_all", lambda o: (o["easting"] != F.col("_x.easting")) | (o["northing"] != F.col("_x.northing")))
    apart = F.transform(others, lambda o: F.sqrt(F.pow(o["easting"] - F.col("_x.easting"), 2) + F.pow(o["northing"] - F.col("_x.northing"), 2)))
    found, side = groups.select(*key, *[F.col(f"_x.{c}").alias(c) for c in own], F.array_min(apart).alias("nearest")), start_m
    every = left = left.where(F.col("_many") > few).drop("_many")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    while not left.isEmpty():
        cell = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")  # noqa: B023, E731
        others = every.select(*key, F.col("easting").alias("oe"), F.col("northing").alias("on"), cell("easting").alias("ci"), cell("northing").alias("cj"))
        around = left.withColumn("_o", steps).withColumns({"ci": cell("easting") + F.col("_o.i"), "cj": cell("northing") + F.col("_o.j")}).drop("_o")
        far = F.expr(geo.planar("easting", "northing", "oe", "on"))
        near = around.join(others.hint("merge"), [*key, "ci", "cj"]).where((F.col("oe") != F.col("easting")) | (F.col("on") != F.col("northing"))).groupBy(*key, "easting", "northing").agg(F.min(far).alias("nearest"))
        near = cut(near.where(F.col("nearest") <= side), "rings-found")
        found = found.unionByName(left.join(near.hint("merge"), [*key, "easting", "northing"]).select(*found.columns))
        left = cut(left.join(near.hint("merge"), [*key, "easting", "northing"], "left_anti"), "rings-left")
        side *= growth
    return found


def weighted_centres(points: DataFrame, key: str = "stop") -> DataFrame:
    """user_id, `key`, easting, northing, n_points: centres in which a point weighs 1 / the distance to its nearest neighbour elsewhere in its cluster (1e16 if it has none)."""
    spots = points.groupBy("user_id", key, "easting", "northing").agg(F.count("*").alias("m"))
    weight = F.col("m") / F.coalesce("nearest", F.lit(1e16))
    df = nearest_other(spots, ["user_id", key]).withColumn("_w", weight)
    mean = lambda c: (F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c)
    return df.groupBy("user_id", key).agg(mean("easting"), mean("northing"), F.sum("m").alias("n_points"))


def semantic_locations(points: DataFrame, min_s: int, block: int = BLOCK) -> DataFrame:
    """user_id, label (cluster0, cluster1...), easting, northing, n_points: the stops of each user by hierarchical density clusters over time."""
    clustered = cut(relabel_in_time(certain(hierarchical(points, block=block))), "density-stops")
    centres = weighted_centres(stop_points(clustered, min_s))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("stop")) - 1
    return centres.withColumn("label", F.concat(F.lit("cluster"), number)).drop("stop")
