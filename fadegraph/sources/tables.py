"""Snapshots on storage, and the graph export.

A snapshot is a folder of versions ``v=N``.  A table is dealt to a fixed number
of parts by a hash: topics by id, instances by topic, edges by where they start.
Each write makes a folder of its own with the parts it holds; the version
becomes current when its marker is created, which lists the folders of every
part and which only one writer can create.  A job that dies half-way leaves
folders that no marker lists.

``save_snapshot`` writes whole tables; one that did not change is listed again
and not written again.  ``save_changes`` writes what changed: new rows are
folders added to their parts, and only parts with changed or deleted rows, or
with too many folders, are written again.

Instances are stored with a digest of their content, and each folder with a
Bloom filter of the digests in its parts, so that an import finds out what is
stored without reading contents.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fadegraph.functions.text import digest
from fadegraph.operators.graph import export_edges, export_nodes, export_stats
from fadegraph.schema import Snapshot, typed_like
from fadegraph.session import broadcast_if_small, cut_lineage

_TABLES = ("topics", "instances", "edges")
# What a row is known by, and the column whose hash deals it to a part.
KEYS = {"topics": ["id"], "instances": ["topic_id", "id"], "edges": ["from_topic", "to_topic"]}
_DEALT_BY = {"topics": "id", "instances": "topic_id", "edges": "from_topic"}
# Parts of a new table: as many as let a part be written again by a few tasks.
PARTS = 64
# Folders that may add rows to a part before it is written again as one.
MAX_FOLDERS = 8
_PART = "part__"
_DIGEST = "content_digest"
# Bits of a filter for each row, and places that a row sets: about one in 2,000 absent rows passes.
_FILTER_BITS = 16
_FILTER_HASHES = 8


class VersionConflict(RuntimeError):
    """Another writer has made the version meanwhile."""


@dataclass(frozen=True)
class Version:
    """A complete version: its number, the folders of its tables, and the last batch of each stream in it.

    ``folders`` is by table ``{"parts": number, "schema": ..., "files": {part: [folder, ...]}}``.
    """

    number: int
    folders: dict[str, dict]
    batches: dict[str, int] = field(default_factory=dict)
    snapshot: Snapshot | None = None
    path: str = ""
    spark: SparkSession | None = None

    def read(self, table: str, parts: Iterable[int] | None = None, ending: str = "", schema: str | None = None) -> DataFrame:
        """Rows of a table as stored, of all parts or only of some."""
        made = self.folders[table]
        shape = StructType.fromJson(made["schema"]) if schema is None else schema
        wanted = made["files"] if parts is None else {str(p) for p in parts} & set(made["files"])
        paths = [f"{self.path}/{folder}{ending}/{_PART}={p}" for p in sorted(wanted) for folder in made["files"][p]]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def part_of(self, table: str, column: str | None = None) -> Column:
        return _part(column or _DEALT_BY[table], self.folders[table]["parts"])

    def parts_of(self, table: str, rows: DataFrame, column: str | None = None) -> set[int]:
        """Parts that rows lie in; there are never more than the table has."""
        return {r[0] for r in rows.select(self.part_of(table, column)).distinct().collect()}


@dataclass(frozen=True)
class Changes:
    """Rows to add, rows to put in place of those of the same key, and keys of rows to delete, by table."""

    inserts: dict[str, DataFrame] = field(default_factory=dict)
    upserts: dict[str, DataFrame] = field(default_factory=dict)
    deletes: dict[str, DataFrame] = field(default_factory=dict)


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _storage(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the latest complete version, 0 when there is none."""
    storage, where = _storage(spark, f"{path}/v=*/complete")
    found = storage.globStatus(where) or []
    return max((int(f.getPath().getParent().getName().removeprefix("v=")) for f in found if f.getLen() > 0), default=0)


def load_version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version, by default the latest complete one."""
    number = latest_version(spark, path) if number is None else number
    if not number:
        raise FileNotFoundError(f"no complete snapshot under {path}")
    said = json.loads(spark.read.text(f"{path}/v={number}/complete", wholetext=True).first()[0])
    stored = Version(number, said["folders"], said["batches"], None, path, spark)
    return Version(number, stored.folders, stored.batches, Snapshot(*(stored.read(t).drop(_DIGEST) for t in _TABLES)), path, spark)


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The tables of a version, by default of the latest complete one."""
    return load_version(spark, path, version).snapshot


def _with_digest(table: str, rows: DataFrame) -> DataFrame:
    if table != "instances" or _DIGEST in rows.columns:
        return rows
    return rows.withColumn(_DIGEST, digest(F.col("content")))


def _write_parts(spark: SparkSession, path: str, number: int, table: str, rows: DataFrame, parts: int) -> tuple[str, list[str]]:
    """Write rows to a folder of their own: its name and the parts in it.

    Rebalancing splits a part that holds many rows over several files and tasks.
    """
    folder = f"v={number}/{uuid.uuid4().hex}/{table}"
    dealt = rows.withColumn(_PART, _part(_DEALT_BY[table], parts)).hint("rebalance", _PART)
    dealt.write.partitionBy(_PART).parquet(f"{path}/{folder}")
    storage, where = _storage(spark, f"{path}/{folder}")
    names = (f.getPath().getName() for f in storage.listStatus(where))
    made = sorted(n.removeprefix(f"{_PART}=") for n in names if n.startswith(f"{_PART}="))
    if table == "instances" and made:
        _write_filter(spark, f"{path}/{folder}")
    return folder, made


def _bits(bits: Column, *key: str) -> Column:
    """Places in a filter that a key sets."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *key), bits) for i in range(_FILTER_HASHES)])


def _write_filter(spark: SparkSession, folder: str) -> None:
    """Bloom filters of the (topic_id, content digest) of each part of a written folder, as rows of 64 bits."""
    rows = spark.read.parquet(folder).select(_PART, "topic_id", _DIGEST)
    sizes = rows.groupBy(_PART).agg((F.ceil(F.count(F.lit(1)) * _FILTER_BITS / 64) * 64).alias("bits"))
    places = rows.join(broadcast_if_small(cut_lineage(sizes)), _PART).select(
        _PART, "bits", F.explode(_bits(F.col("bits"), "topic_id", _DIGEST)).alias("at"))
    words = places.groupBy(_PART, "bits", F.expr("at div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value"))
    named = words.withColumns({"folder": F.lit(folder.rsplit("/", 2)[-2]), "part": F.col(_PART)})
    named.hint("rebalance", _PART).write.partitionBy(_PART).parquet(f"{folder}-filter")


_FILTER_SCHEMA = "bits long, word long, value long, folder string, part int"


def maybe_stored(version: Version, candidates: DataFrame) -> DataFrame:
    """Candidates (topic_id, digest, ...) that pass a filter of their part; those left out are not stored for certain."""
    keys = cut_lineage(candidates.select("topic_id", "digest").distinct().withColumn("part", version.part_of("instances")))
    parts = {r[0] for r in keys.select("part").distinct().collect()}
    words = version.read("instances", parts, "-filter", _FILTER_SCHEMA)
    shapes = broadcast_if_small(cut_lineage(words.select("part", "folder", "bits").distinct()))
    asked = keys.join(shapes, "part").select(
        "topic_id", "digest", "part", "folder", F.explode(_bits(F.col("bits"), "topic_id", "digest")).alias("at"))
    hits = asked.withColumn("word", F.expr("at div 64")).join(words.drop("bits"), ["part", "folder", "word"]).filter(
        "value & shiftleft(1L, cast(at % 64 as int)) <> 0")
    passed = hits.groupBy("topic_id", "digest", "folder").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == _FILTER_HASHES)
    return candidates.join(passed.select("topic_id", "digest").distinct(), ["topic_id", "digest"], "left_semi")


def unseen_in(version: Version, candidates: DataFrame) -> DataFrame:
    """Candidates (topic_id, digest, ...) that the version does not hold; no stored content is read.

    Filters rule out nearly all new ones; the others are looked up among the
    digests of the parts they would lie in.
    """
    maybe = cut_lineage(maybe_stored(version, candidates).select("topic_id", "digest").distinct())
    parts = version.parts_of("instances", maybe)
    if not parts:
        return candidates
    stored = version.read("instances", parts).select("topic_id", F.col(_DIGEST).alias("digest")).join(
        broadcast_if_small(maybe), ["topic_id", "digest"], "left_semi")
    return candidates.join(stored, ["topic_id", "digest"], "left_anti")


def _finish(spark: SparkSession, path: str, number: int, folders: dict, batches: dict) -> int:
    """Create the marker, which only one writer of a version can."""
    storage, marker = _storage(spark, f"{path}/v={number}/complete")
    try:
        out = storage.create(marker, False)
    except Py4JJavaError as error:
        raise VersionConflict(f"version {number} of {path} exists") from error
    out.write(bytearray(json.dumps({"version": number, "folders": folders, "batches": batches}).encode()))
    out.close()
    return number


def save_snapshot(snapshot: Snapshot, path: str, after: Version | None = None, batch: tuple[str, int] | None = None,
                  parts: int = PARTS) -> int:
    """Write the next version and return its number.

    ``after`` is the version that ``snapshot`` was made from: tables that are
    still the ones it gave are not written again, and if another version has
    come after it, ``VersionConflict`` is raised and nothing is changed.
    ``batch`` names a stream and the number of its batch; the marker keeps the
    last number of each stream, so a repeated attempt can see that it is done.
    ``parts`` is what a table is dealt to when it is first written.
    """
    spark = snapshot.spark
    if after is None:
        number = latest_version(spark, path)
        after = load_version(spark, path, number) if number else Version(0, {})
    number = after.number + 1
    folders = {}
    for name in _TABLES:
        table = getattr(snapshot, name)
        if after.snapshot is not None and table is getattr(after.snapshot, name):
            folders[name] = after.folders[name]
            continue
        rows = _with_digest(name, table)
        count = after.folders[name]["parts"] if name in after.folders else parts
        folder, made = _write_parts(spark, path, number, name, rows, count)
        folders[name] = {"parts": count, "schema": rows.schema.jsonValue(), "files": {p: [folder] for p in made}}
    return _finish(spark, path, number, folders, after.batches | ({batch[0]: batch[1]} if batch else {}))


def _changed_table(after: Version, number: int, name: str, changes: Changes) -> dict:
    """Write what changed in a table and list its folders."""
    old, keys = after.folders[name], KEYS[name]
    stored = after.read(name)

    def ready(rows: DataFrame) -> DataFrame:
        return cut_lineage(_with_digest(name, rows).select(*typed_like(stored)))

    inserts, upserts = (ready(c[name]) if name in c else stored.limit(0) for c in (changes.inserts, changes.upserts))
    gone = upserts.select(*keys)
    if name in changes.deletes:
        gone = gone.unionByName(changes.deletes[name].select(*keys))
    gone = cut_lineage(gone.distinct())
    added = {str(p) for p in after.parts_of(name, inserts)}
    anew = {str(p) for p in after.parts_of(name, gone)} | {p for p in added if len(old["files"].get(p, [])) >= MAX_FOLDERS}
    kept = after.read(name, anew).join(broadcast_if_small(gone), keys, "left_anti").select(*typed_like(stored))
    folder, made = _write_parts(after.spark, after.path, number, name, kept.unionByName(upserts).unionByName(inserts), old["parts"])
    files = {p: f for p, f in old["files"].items() if p not in anew}
    return old | {"files": files | {p: files.get(p, []) + [folder] for p in made}}


def save_changes(changes: Changes, after: Version, batch: tuple[str, int] | None = None) -> int:
    """Write the next version, in which ``changes`` were made to ``after``, and return its number.

    An upsert takes the place of the row of its key, or is added; a key is
    changed by deleting the old one.  Of a part that only gets new rows nothing
    is written again.  ``batch`` and conflicts are as in ``save_snapshot``.
    """
    number = after.number + 1
    changed = {*changes.inserts, *changes.upserts, *changes.deletes}
    folders = {name: _changed_table(after, number, name, changes) if name in changed else made for name, made in after.folders.items()}
    return _finish(after.spark, after.path, number, folders, after.batches | ({batch[0]: batch[1]} if batch else {}))


def instance_vectors(instances: DataFrame) -> DataFrame:
    """The columns of the instances that clustering reads."""
    return instances.select("id", "content", "content_embedding", "topic_id")


def write_graph(snapshot: Snapshot, path: str) -> None:
    """The export as JSON lines in three folders: nodes, edges and stats."""
    export_nodes(snapshot.topics, snapshot.instances).write.mode("overwrite").json(f"{path}/nodes")
    export_edges(snapshot.edges).write.mode("overwrite").json(f"{path}/edges")
    export_stats(snapshot).write.mode("overwrite").json(f"{path}/stats")


def read_graph(spark: SparkSession, path: str, like: Snapshot) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and stats that ``write_graph`` wrote, with the types of an export of ``like``."""
    exports = {"nodes": export_nodes(like.topics, like.instances), "edges": export_edges(like.edges), "stats": export_stats(like)}
    return tuple(spark.read.schema(e.schema).json(f"{path}/{name}") for name, e in exports.items())


def with_position(values: DataFrame, array: str) -> DataFrame:
    """An array column as rows with their position from 1: (..., value, ord)."""
    others = [c for c in values.columns if c != array]
    exploded = values.select(*others, F.posexplode(array).alias("_at", "value"))
    return exploded.select(*others, "value", (F.col("_at") + 1).alias("ord"))
