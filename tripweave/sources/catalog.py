"""The survey's tables as Parquet in one folder: user buckets, snapshots, atomic replacement by user, persistent ids.

A table is a list of snapshots. A snapshot is a small file that names the schema
and the folders of each bucket; data files are written once and never changed.
A write puts new files aside and then commits by renaming its snapshot file to
the next number, which fails if another writer has been there first. So a reader
sees the table before or after a write, never half of it; a write that dies
leaves files that no snapshot names. Readers pin the snapshot they begin with."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Snapshots that stay readable after a commit.
KEPT_SNAPSHOTS = 3


class UserNotFoundError(LookupError):
    pass


class ConcurrentWriteError(RuntimeError):
    """Another writer has changed the same users' buckets meanwhile."""


class _Files:
    """The few file operations of a commit, on any store that Spark's Hadoop layer knows."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename_new(self, source: str, target: str) -> bool:
        """Rename in one step; False if the target is there already."""
        from py4j.protocol import Py4JJavaError

        fs, a = self._at(source)
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, none)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(a, self._at(target)[1], options)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Catalog:
    """Tables under a folder that all executors share, bucketed by `key`."""

    def __init__(self, spark: SparkSession, root: str, key: str = "user_id"):
        self.spark, self.root, self.key, self.files = spark, root.rstrip("/"), key, _Files(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # --- snapshots -----------------------------------------------------------------------

    def snapshots(self, name: str) -> list[int]:
        """The numbers of the table's readable snapshots, ascending."""
        return sorted(int(f[:-5]) for f in self.files.names(f"{self.path(name)}/snapshots") if f.endswith(".json") and f[:-5].isdigit())

    def _manifest(self, name: str, number: int | None = None) -> tuple[int, dict]:
        if number is None:
            number = max(self.snapshots(name), default=0)
        if not number:
            return 0, {"schema": None, "buckets": {}}
        return number, json.loads(self.files.read(f"{self.path(name)}/snapshots/{number:09d}.json"))

    def exists(self, name: str) -> bool:
        return bool(self.snapshots(name))

    def _frame(self, name: str, manifest: dict, buckets=None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f for b, own in manifest["buckets"].items() if buckets is None or int(b) in buckets for f in own]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path(name)}/{f}" for f in folders])

    def read(self, name: str, snapshot: int | None = None) -> DataFrame:
        """The table as of a snapshot (the newest, if none is given); later writes don't change it."""
        number, manifest = self._manifest(name, snapshot)
        if not number:
            raise LookupError(f"no table {name} in {self.root}")
        return self._frame(name, manifest)

    def user(self, name: str, user_id) -> DataFrame:
        """One user's rows: only the bucket's files are read, and the id prunes their row groups."""
        _, manifest = self._manifest(name)
        kind = StructType.fromJson(manifest["schema"])[self.key].dataType
        bucket = self.spark.range(1).select(self._bucket(F.lit(user_id).cast(kind))).first()[0]
        return self._frame(name, manifest, {bucket}).where(F.col(self.key) == user_id)

    # --- writes --------------------------------------------------------------------------

    @staticmethod
    def _bucket(c):
        return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")

    def _write(self, name: str, df: DataFrame) -> dict[str, list[str]]:
        """New data files of `df`: the folder of each bucket that it has."""
        folder = f"data/{uuid4().hex}"
        out = df.withColumn("bucket", self._bucket(F.col(self.key))).repartition("bucket").sortWithinPartitions(self.key)
        out.write.partitionBy("bucket").parquet(f"{self.path(name)}/{folder}")
        found = [f for f in self.files.names(f"{self.path(name)}/{folder}") if f.startswith("bucket=")]
        return {f.removeprefix("bucket="): [f"{folder}/{f}"] for f in found}

    def _commit(self, name: str, base: tuple[int, dict], schema: StructType, touched: set[str] | None, new: dict[str, list[str]], strict: bool = False) -> int:
        """The number of the new snapshot, in which the `touched` buckets (None: all) are `new` and the others as they are.

        Where another snapshot came in between, the commit is tried on top of it
        if that left the touched buckets alone (never, if `strict`)."""
        number, manifest = base
        while True:
            buckets = {b: f for b, f in manifest["buckets"].items() if touched is not None and b not in touched}
            aside = f"{self.path(name)}/snapshots/_{uuid4().hex}"
            self.files.write(aside, json.dumps({"schema": json.loads(schema.json()), "buckets": buckets | {b: f for b, f in new.items() if f}}))
            if self.files.rename_new(aside, f"{self.path(name)}/snapshots/{number + 1:09d}.json"):
                self._clean(name)
                return number + 1
            self.files.delete(aside)
            number, now = self._manifest(name)
            same = touched is not None and all(now["buckets"].get(b) == manifest["buckets"].get(b) for b in touched)
            if strict or not same or now["schema"] != manifest["schema"]:
                raise ConcurrentWriteError(name)
            manifest = now

    def _clean(self, name: str) -> None:
        """Drop all but the newest snapshots, and the data that only those had."""
        numbers = self.snapshots(name)
        old, kept = numbers[:-KEPT_SNAPSHOTS], numbers[-KEPT_SNAPSHOTS:]
        folders = lambda ns: {f for n in ns for own in self._manifest(name, n)[1]["buckets"].values() for f in own}
        for f in folders(old) - folders(kept) if old else ():
            self.files.delete(f"{self.path(name)}/{f}")
        for n in old:
            self.files.delete(f"{self.path(name)}/snapshots/{n:09d}.json")

    def vacuum(self, name: str) -> int:
        """Delete what writes that never committed have left, and old folders that are empty; the number of folders deleted. No writer may be under way."""
        used = {f.split("/")[1] for n in self.snapshots(name) for own in self._manifest(name, n)[1]["buckets"].values() for f in own}
        gone = [f for f in self.files.names(f"{self.path(name)}/data") if f not in used]
        for f in gone:
            self.files.delete(f"{self.path(name)}/data/{f}")
        for f in self.files.names(f"{self.path(name)}/snapshots"):
            if f.startswith("_"):
                self.files.delete(f"{self.path(name)}/snapshots/{f}")
        return len(gone)

    @staticmethod
    def _merged(old: dict | None, new: StructType) -> StructType:
        """The old schema with the columns that are new, all nullable."""
        fields = StructType.fromJson(old).fields if old else []
        names = {f.name for f in fields}
        out = StructType(fields + [f for f in new.fields if f.name not in names])
        for f in out.fields:
            f.nullable = True
        return out

    def save(self, name: str, df: DataFrame, mode: str = "overwrite", base: tuple[int, dict] | None = None) -> int:
        """Write all rows: in place of the table's (overwrite) or besides them (append). `base`, if given, must still be the newest snapshot."""
        if mode not in ("overwrite", "append"):
            raise ValueError(f"no such mode: {mode}")
        strict, base = base is not None, base or self._manifest(name)
        new = self._write(name, df)
        if mode == "overwrite":
            return self._commit(name, base, self._merged(None, df.schema), None, new, strict)
        both = {b: base[1]["buckets"].get(b, []) + f for b, f in new.items()}
        return self._commit(name, base, self._merged(base[1]["schema"], df.schema), set(new), both, strict)

    def replace_users(self, name: str, df: DataFrame) -> int:
        """Delete and insert in one commit: the users of `df` get its rows, other users keep theirs."""
        return self._replace(name, df, df.select(self.key).distinct())

    def delete_users(self, name: str, users: DataFrame) -> int:
        """Drop the rows of the users in `users`."""
        return self._replace(name, None, users.select(self.key).distinct())

    def clear(self, name: str) -> int:
        """Drop all rows; the table and its schema stay."""
        number, manifest = self._manifest(name)
        return self._commit(name, (number, manifest), StructType.fromJson(manifest["schema"]), set(manifest["buckets"]), {})

    def drop(self, name: str) -> None:
        """Delete a table, its snapshots first, so that no reader begins on half of it."""
        self.files.delete(f"{self.path(name)}/snapshots")
        self.files.delete(self.path(name))

    def _replace(self, name: str, df: DataFrame | None, users: DataFrame) -> int:
        base = self._manifest(name)
        if not base[0]:
            return self.save(name, df)
        touched = {r[0] for r in users.select(self._bucket(F.col(self.key))).distinct().collect()}  # at most BUCKETS
        if not touched:
            return base[0]
        kept = self._frame(name, base[1], touched).join(users, self.key, "left_anti")
        rows = kept if df is None else df.unionByName(kept, allowMissingColumns=True)
        new = self._write(name, rows)
        return self._commit(name, base, self._merged(base[1]["schema"], rows.schema), {str(b) for b in touched}, new)

    # --- users ---------------------------------------------------------------------------

    def require_user(self, survey: str, user_id) -> DataFrame:
        found = self.user(survey, user_id)
        if found.isEmpty():
            raise UserNotFoundError(user_id)
        return found

    def users_with_points(self, survey: str, points: str, limit: int | None = None) -> DataFrame:
        """Survey rows of users that have points; a limit takes the first ids before users without points are passed over."""
        rows = self.read(survey)
        if limit is not None:
            rows = rows.orderBy("user_id").limit(limit)
        return rows.join(self.read(points).select("user_id").distinct(), "user_id", "left_semi")


def with_row_ids(df: DataFrame, order: list[str], start: int = 1, out: str = "id") -> DataFrame:
    """Add gapless ids from `start`, in `order` within ranges of it, without one task for all rows.

    Rows are sorted in ranges and written once; the ranges' sizes (one for each
    partition) give the first id of each."""
    from ..operators.lineage import cut

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "row-ids")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    firsts, at = [], start
    for r in sizes:
        firsts.append((r["_part"], at))
        at += r["n"]
    table = df.sparkSession.createDataFrame(firsts, "_part long, _first long")
    return placed.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(out, F.col("_first") + within).drop("_at", "_part", "_first")


class Ids:
    """Persistent ids of keys: a table that only grows. A key keeps its id, new keys get the next numbers, without gaps."""

    def __init__(self, spark: SparkSession, root: str, name: str = "ids"):
        self.tables, self.name = Catalog(spark, root, key="key"), name

    def assign(self, keys: DataFrame, column: str) -> DataFrame:
        """key and id of all keys known, those in `column` of `keys` (nulls aside) included."""
        base = self.tables._manifest(self.name)
        new = keys.select(F.col(column).cast("string").alias("key")).where("key is not null").distinct()
        start = 1
        if base[0]:
            known = self.tables._frame(self.name, base[1])
            start = (known.agg(F.max("id")).first()[0] or 0) + 1
            new = new.join(known.select("key"), "key", "left_anti")
        numbered = with_row_ids(new, ["key"], start)
        if not numbered.isEmpty() or not base[0]:
            self.tables.save(self.name, numbered.select("key", "id"), "append", base)
        return self.tables.read(self.name)
