"""A keyed table in hash buckets, with versions and the change rows between them.

Plain parquet has no row-level MERGE, so a merge rewrites the buckets that its batch
touches and refers to all others: what an incremental run reads and writes follows the
buckets of its batch and not the table. Every version is one small commit file that
names, for each bucket, the write that holds it:

* ``data/write=W/bucket=B``  whole buckets, sorted by key
* ``changes/write=W``        change rows of that write (insert, update pre and post image)
* ``commits/NNNNNNNN.json``  version, write, bucket -> write

A commit file appears at once and only if its version does not exist yet, so of two
writers of one version one wins. The other keeps its work if the winner left its buckets
alone, and else merges again on the newer version: no write is lost. Written files are
never overwritten; ``vacuum`` removes what only old versions refer to.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribra.operators import bronze as B
from cribra.operators import tallies as TL
from cribra.session import checkpoint_dir

#: A batch of up to so many rows is broadcast by its keys, so the table's side of the merge
#: is scanned where it lies; a larger one is joined by shuffles and its buckets dealt anew.
BROADCAST_ROWS = 1_000_000
COMMIT_SCHEMA = "version long, write string, inserts boolean"


@dataclass(frozen=True)
class KeyedTable:
    """``stamp``: a column that takes the time of writing; it counts as no change of a row."""
    root: str
    schema: T.StructType
    key: str
    buckets: int = 16
    stamp: str | None = None

    @property
    def values(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.name not in (self.key, self.stamp)]

    @property
    def commits(self) -> str:
        return f"{self.root}/commits"


@dataclass(frozen=True)
class Commit:
    version: int
    buckets: int
    held: dict[int, str] = field(default_factory=dict)
    write: str | None = None
    inserts: bool = False


def _fs(spark: SparkSession, path: str):  # noqa: ANN202 - JVM objects
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[attr-defined]
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p  # type: ignore[attr-defined]


def _publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole, unless it exists. Local files are linked, others renamed: both fail
    where the name is taken (of object stores, those whose rename does)."""
    folder, _, name = path.rpartition("/")
    fs, temp = _fs(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    _, final = _fs(spark, path)
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(temp.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(final) and bool(fs.rename(temp, final))
    finally:
        fs.delete(temp, False)


def _text(commit: Commit) -> str:
    return json.dumps({"version": commit.version, "write": commit.write, "inserts": commit.inserts,
                       "n_buckets": commit.buckets, "held": commit.held})


def create(spark: SparkSession, table: KeyedTable) -> None:
    """Version 0, without rows, unless the table has versions. Fixes the number of buckets."""
    fs, p = _fs(spark, table.commits)
    fs.mkdirs(p)
    if not versions(spark, table):
        _publish(spark, f"{table.commits}/{0:08d}.json", _text(Commit(0, table.buckets)))


def versions(spark: SparkSession, table: KeyedTable) -> list[int]:
    fs, p = _fs(spark, table.commits)
    if not fs.exists(p):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def commit_of(spark: SparkSession, table: KeyedTable, version: int | None = None) -> Commit:
    """The commit of a version, the newest by default; of an empty table before the first one."""
    if version is None:
        known = versions(spark, table)
        if not known:
            return Commit(-1, table.buckets)
        version = known[-1]
    fs, p = _fs(spark, f"{table.commits}/{version:08d}.json")
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")  # type: ignore[attr-defined]
    finally:
        stream.close()
    c = json.loads(text)
    return Commit(c["version"], c["n_buckets"], {int(b): w for b, w in c["held"].items()}, c["write"], c["inserts"])


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, table: KeyedTable, commit: Commit, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType([*table.schema.fields, T.StructField("bucket", T.IntegerType())])
    paths = [f"{table.root}/data/write={w}/bucket={b}" for b, w in sorted(commit.held.items())
             if only is None or b in only]
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema).option("basePath", f"{table.root}/data").parquet(*paths)
            .select(*schema.names))


def read(spark: SparkSession, table: KeyedTable, version: int | None = None) -> DataFrame:
    return _read(spark, table, commit_of(spark, table, version)).drop("bucket")


def footer_stats(spark: SparkSession, table: KeyedTable, newest: str) -> DataFrame:
    """``rows`` and the largest ``newest`` (a date or number) of the newest version, from the
    files' footers: no data page is read.

    Spark answers count, min and max from footers in its second reader for parquet only. A
    session of its own turns that on, so the caller's settings stay as they are.
    """
    own = spark.newSession()
    first = own.conf.get("spark.sql.sources.useV1SourceList", "").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in first if x != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return _read(own, table, commit_of(own, table)).agg(
        F.count(F.lit(1)).alias("rows"), F.max(newest).alias("newest"))


def read_key(spark: SparkSession, table: KeyedTable, value) -> DataFrame:  # noqa: ANN001 - of the key's type
    """The row of one key: its bucket alone is listed, and the files' statistics skip row groups."""
    commit = commit_of(spark, table)
    wanted = F.lit(value).cast(table.schema[table.key].dataType)
    bucket = spark.range(1).select(bucket_of(wanted, commit.buckets)).first()[0]
    return B.fetch_study(_read(spark, table, commit, {bucket}), value, table.key).drop("bucket")


def merge(spark: SparkSession, table: KeyedTable, source: DataFrame, order_cols: Sequence[str] = (),
          tries: int = 50) -> Commit:
    """Merge a batch (last by ``order_cols`` wins, see ``merge_upsert``) as the next version.

    ``source`` has the key and all value columns. A batch without rows writes nothing.
    The batch is stored once, so a retry merges the same rows.
    """
    key, values = table.key, table.values
    create(spark, table)
    commit = commit_of(spark, table)
    batch = B.dedupe_latest(source.where(F.col(key).isNotNull()), [key], order_cols or values).select(
        key, *values, bucket_of(F.col(key), commit.buckets).alias("bucket"))
    place = f"{checkpoint_dir(spark).rstrip('/')}/merge-{uuid.uuid4().hex}"
    batch.write.parquet(place)
    batch = spark.read.schema(batch.schema).parquet(place)
    # At most one row per bucket.
    sizes = {r["bucket"]: r["count"] for r in batch.groupBy("bucket").count().collect()}
    if not sizes:
        return commit
    small = sum(sizes.values()) <= BROADCAST_ROWS
    for _ in range(tries):
        write = _write(spark, table, commit, batch, set(sizes), small)
        inserts = not any(b in commit.held for b in sizes)
        while True:
            done = Commit(commit.version + 1, commit.buckets, commit.held | {b: write for b in sizes}, write, inserts)
            if _publish(spark, f"{table.commits}/{done.version:08d}.json", _text(done)):
                return done
            newer = commit_of(spark, table)
            same = all(newer.held.get(b) == commit.held.get(b) for b in sizes)
            commit = newer
            if not same:
                break
    raise RuntimeError(f"{table.root}: {tries} merges met newer versions of their buckets")


def _write(spark: SparkSession, table: KeyedTable, commit: Commit, batch: DataFrame, touched: set[int],
           small: bool) -> str:
    """New files of the touched buckets, and the change rows; returns the write's name."""
    write, key = f"w{uuid.uuid4().hex}", table.key
    target = _read(spark, table, commit, touched)
    merged = B.merge_upsert(target, batch, [key], stamp_col=table.stamp, unique=True, small=small,
                            strategy="keyed" if small else "full_outer").drop(B.ACTION_COL)
    if not small or not any(b in commit.held for b in touched):
        merged = merged.repartition("bucket")
    # Sorted files carry narrow ranges of the key in their statistics, so point reads skip row groups.
    merged.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(
        f"{table.root}/data/write={write}")
    if any(b in commit.held for b in touched):
        keys = batch.select(key)
        before = target.join(F.broadcast(keys) if small else keys, key, "left_semi")
        B.change_feed(before, batch, [key], table.values).write.parquet(f"{table.root}/changes/write={write}")
    return write


def changes_of(spark: SparkSession, table: KeyedTable, commits: Sequence[tuple[int, str, bool]]) -> DataFrame:
    """Change rows of commits (version, write, inserts): key, values, ``change_type``, ``version``.

    A write that met none of its buckets has only inserts, which are its data.
    """
    columns = [table.key, *table.values]
    schema = T.StructType([table.schema[c] for c in columns])
    out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("change_type", T.StringType()),
                                                  T.StructField("version", T.LongType())]))
    # Commits of one kind are one scan; the folder names the write and so the version.
    for folder, inserts in (("changes", False), ("data", True)):
        of = {write: version for version, write, only in commits if write and bool(only) == inserts}
        if not of:
            continue
        read_as = schema if inserts else T.StructType([*schema.fields, T.StructField("change_type", T.StringType())])
        rows = (spark.read.schema(T.StructType([*read_as.fields, T.StructField("write", T.StringType())]))
                .option("basePath", f"{table.root}/{folder}")
                .parquet(*[f"{table.root}/{folder}/write={w}" for w in of]))
        number = F.element_at(F.create_map(*[F.lit(x) for w, v in of.items() for x in (w, v)]), F.col("write"))
        out = out.unionByName(rows.select(
            *columns, (F.lit("insert") if inserts else F.col("change_type")).alias("change_type"),
            number.cast("long").alias("version")))
    return out


def changes(spark: SparkSession, table: KeyedTable, after: int, upto: int | None = None) -> DataFrame:
    """Change rows of the versions behind ``after`` up to ``upto`` (the newest by default)."""
    known = [v for v in versions(spark, table) if v > after and (upto is None or v <= upto)]
    found = [commit_of(spark, table, v) for v in known]
    return changes_of(spark, table, [(c.version, c.write, c.inserts) for c in found if c.write])


def net_changes(rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """What remains of change rows over several versions: the first image against the last.

    Equal to ``change_feed`` on the two versions themselves, without reading either. One
    partial aggregate by key; a key has at most two rows a version.
    """
    image = F.struct("change_type", *values)
    when = F.struct("version", (F.col("change_type") != "update_preimage").alias("late"))
    ends = rows.groupBy(key).agg(F.min_by(image, when).alias("b"), F.max_by(image, when).alias("a"))
    was = F.col("b.change_type") != "insert"
    is_now = F.col("a.change_type") != "delete"
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))

    def row(side: str, kind: str) -> Column:
        return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in values], F.lit(kind).alias("change_type"))

    out = (F.when(is_now & ~was, F.array(row("a", "insert")))
           .when(was & ~is_now, F.array(row("b", "delete")))
           .when(was & is_now & differs, F.array(row("b", "update_preimage"), row("a", "update_postimage"))))
    return ends.select(key, F.explode(out).alias("c")).select(key, "c.*")


def vacuum(spark: SparkSession, table: KeyedTable, keep: int = 2) -> list[int]:
    """Drop all versions but the newest ``keep``, and the files that only they refer to.

    Files that no commit names are left alone: a writer may still be producing them.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    known = versions(spark, table)
    kept = [commit_of(spark, table, v) for v in known[-keep:]]
    needed = {(b, w) for c in kept for b, w in c.held.items()}
    recent = {c.write for c in kept}

    def remove(path: str) -> None:
        fs, p = _fs(spark, path)
        fs.delete(p, True)

    for version in known[:-keep]:
        old = commit_of(spark, table, version)
        for b, w in old.held.items():
            if (b, w) not in needed:
                remove(f"{table.root}/data/write={w}/bucket={b}")
        if old.write and old.write not in recent:
            remove(f"{table.root}/changes/write={old.write}")
        remove(f"{table.commits}/{version:08d}.json")
    return known[:-keep]


# ---- tallies kept up beside the table ---------------------------------------

TALLIES_SCHEMA = "field string, value string, n long"


def tallies_version(spark: SparkSession, table: KeyedTable) -> int | None:
    fs, p = _fs(spark, f"{table.root}/tallies")
    if not fs.exists(p):
        return None
    done = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")]
    known = [int(d.getName()[2:]) for d in done if fs.exists(_fs(spark, f"{d}/_SUCCESS")[1])]
    return max(known, default=None)


def read_tallies(spark: SparkSession, table: KeyedTable, version: int | None = None) -> DataFrame:
    """The stored tallies of a version, the newest by default; none before the first refresh."""
    version = tallies_version(spark, table) if version is None else version
    if version is None:
        return spark.createDataFrame([], TALLIES_SCHEMA)
    return spark.read.schema(TALLIES_SCHEMA).parquet(f"{table.root}/tallies/v={version:08d}")


def refresh_tallies(spark: SparkSession, table: KeyedTable, fields: Sequence[TL.Field]) -> DataFrame:
    """Tallies of the newest version, from the stored ones and the change rows since.

    The fields are fixed with the first refresh. Reads one row per distinct value and the
    changes; the table is read only where a version's changes are its first data.
    """
    head, have = commit_of(spark, table).version, tallies_version(spark, table)
    if head >= 0 and have != head:
        delta = TL.signed(changes(spark, table, -1 if have is None else have, head), fields)
        new = TL.add(read_tallies(spark, table, have), delta)
        new.write.mode("errorifexists").parquet(f"{table.root}/tallies/v={head:08d}")
    return read_tallies(spark, table)
