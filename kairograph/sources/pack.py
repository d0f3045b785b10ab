"""Portable packs: JSON lines, a manifest and checksums; export, validation, import.

Tables are written and read by Spark through the shared file system.  Checksums
are a sum over row hashes, so they do not depend on the order or number of part
files and no table passes through the driver.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions.keys import fact_key, name_key, uuid5_url
from kairograph.operators.graph import _shared_dir

FORMAT, VERSION = "kairograph-pack", 1
REQUIRED = ("entities", "entity_aliases", "relation_frames", "edges")
MOST_BYTES = 512 << 20


#: Times keep their microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class PackError(ValueError):
    """A pack that cannot be read."""


def scratch(spark: SparkSession, name: str) -> str:
    return f"{_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line in UTF-8; nulls are written."""
    df.write.options(ignoreNullFields="false", **_TIMES).mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Blank lines are skipped; a line that is no object of the schema fails."""
    return spark.read.schema(schema).options(mode="FAILFAST", **_TIMES).json(path)


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, order-independent checksum) in one aggregate."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false", **_TIMES})
    digest = F.sha2(row, 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    got = df.agg(F.count("*").alias("n"), *[p.alias(f"s{i}") for i, p in enumerate(parts)]).first()
    return got.n, "".join(f"{int(got[f's{i}'] or 0) % (1 << 48):012x}" for i in range(4))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def export_pack(tables: dict[str, DataFrame], path: str) -> dict:
    """Writes every table without its embeddings, the manifest and the checksums."""
    spark = next(iter(tables.values())).sparkSession
    sums = {}
    for name, df in tables.items():
        kept = df.drop(*[c for c in df.columns if c.endswith("_embedding")])
        write_jsonl(kept, f"{path}/{name}.jsonl")
        rows, digest = checksum(read_jsonl(spark, f"{path}/{name}.jsonl", kept.schema))
        sums[name] = {"rows": rows, "sum": digest, "schema": kept.schema.simpleString()}
    manifest = {"format": FORMAT, "version": VERSION, "files": sorted(tables)}
    _write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    _write_text(spark, f"{path}/checksums.json", json.dumps(sums, sort_keys=True))
    return manifest


def validate_pack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The pack's tables, after format, files and checksums were found right."""
    manifest, sums = _read_text(spark, f"{path}/manifest.json"), _read_text(spark, f"{path}/checksums.json")
    if manifest is None or sums is None:
        raise PackError("manifest.json or checksums.json is missing")
    manifest, sums = json.loads(manifest), json.loads(sums)
    if manifest.get("format") != FORMAT or manifest.get("version") != VERSION:
        raise PackError(f"unknown format {manifest.get('format')} {manifest.get('version')}")
    if missing := set(REQUIRED) - set(manifest["files"]):
        raise PackError(f"missing {sorted(missing)}")
    out = {}
    for name in manifest["files"]:
        schema = sums[name]["schema"]
        df = read_jsonl(spark, f"{path}/{name}.jsonl", spark.sql(f"select from_json('{{}}', '{schema}') as x").schema["x"].dataType)
        if checksum(df) != (sums[name]["rows"], sums[name]["sum"]):
            raise PackError(f"checksum of {name} differs")
        out[name] = df
    return out


def safe_members(names_and_sizes: list[tuple[str, int]], most: int = MOST_BYTES) -> None:
    """Refuses archives that unpack beyond the cap or outside their folder."""
    if sum(n for _, n in names_and_sizes) > most:
        raise PackError("the archive unpacks to too many bytes")
    for name, _ in names_and_sizes:
        if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or ":" in name:
            raise PackError(f"unsafe path {name}")


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files below a folder, relative, in order; Spark's own marker files are left out."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, out, walk = fs.makeQualified(top).toString(), [], fs.listFiles(top, True)
    while walk.hasNext():
        name = walk.next().getPath().toString()[len(base) :].lstrip("/")
        if not name.rpartition("/")[2].startswith((".", "_")):
            out.append(name)
    return sorted(out)


def zip_exported(spark: SparkSession, path: str, target: str) -> None:
    """Zips an exported pack into a local file that appears under its name only when whole."""
    part = f"{target}.tmp"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for name in _files(spark, path):
            z.writestr(name, _read_text(spark, f"{path}/{name}") or "")
    os.replace(part, target)


def unzip_to(spark: SparkSession, source: str, path: str) -> None:
    """Unpacks an archive into a folder all executors share, after its names and sizes were found safe."""
    with zipfile.ZipFile(source) as z:
        members = [i for i in z.infolist() if not i.is_dir()]
        safe_members([(i.filename, i.file_size) for i in members])
        for i in members:
            _write_text(spark, f"{path}/{i.filename}", z.read(i).decode())


@dataclass(frozen=True)
class Imported:
    entities: DataFrame
    aliases: DataFrame
    edges: DataFrame
    dropped: DataFrame  # edges with an endpoint that is nowhere
    frames: DataFrame  # relation frames of the group to add
    removed: DataFrame  # what the group held and the pack replaces: kind, uuid


def import_pack(pack: dict[str, DataFrame], group: str, entities: DataFrame, edges: DataFrame, frames: DataFrame | None = None, mode: str = "merge") -> Imported:
    """Brings a pack into a group under stable ids, so a second import changes nothing.

    ``merge``: known names keep their id, known facts and frames stay as they
    are.  ``replace``: the group's entities and edges go, the pack's come.
    ``frames`` has the group's own frames: group_id, alias, canonical.
    """
    if mode not in ("merge", "replace"):
        raise PackError(f"unknown mode {mode}")
    own = lambda rows, kind: rows.where(F.col("group_id") == group).select(F.lit(kind).alias("kind"), "uuid")
    removed = own(entities, "entity").union(own(edges, "edge"))
    if mode == "replace":
        entities, edges, frames = entities.limit(0), edges.limit(0), None
    else:
        removed = removed.limit(0)
    known = entities.where(F.col("group_id") == group).groupBy(name_key(F.col("name")).alias("k")).agg(F.min("uuid").alias("old"))
    ents = pack["entities"].withColumn("k", name_key(F.col("name"))).join(known, "k", "left")
    stable = uuid5_url(F.concat_ws(":", F.lit(FORMAT), F.lit(group), F.lit("entity"), F.col("uuid")))
    to = ents.select(F.col("uuid").alias("from"), F.coalesce("old", stable).alias("to"), F.col("old").isNull().alias("new"), "name")
    fresh = to.where("new").select(F.col("to").alias("uuid"), F.lit(group).alias("group_id"), "name").dropDuplicates(["uuid"])
    ids = to.select("from", "to")
    rows = pack["edges"].join(ids.select(F.col("from").alias("source_node_uuid"), F.col("to").alias("s")), "source_node_uuid", "left")
    rows = rows.join(ids.select(F.col("from").alias("target_node_uuid"), F.col("to").alias("t")), "target_node_uuid", "left")
    bad = rows.where("s is null or t is null").select("uuid")
    key = fact_key(F.lit(group), F.col("source_node_uuid"), F.col("name"), F.col("target_node_uuid"))
    good = rows.where("s is not null and t is not null").select(uuid5_url(F.concat_ws(":", F.lit(FORMAT), F.lit(group), F.lit("edge"), F.col("uuid"))).alias("uuid"), F.col("s").alias("source_node_uuid"), "name", F.col("t").alias("target_node_uuid"))
    have = edges.where(F.col("group_id") == group).select(key.alias("k")).distinct()
    new = good.withColumn("k", key).dropDuplicates(["k"]).join(have, "k", "left_anti").drop("k").withColumn("group_id", F.lit(group))
    aliases = pack["entity_aliases"].join(ids.select(F.col("from").alias("entity_uuid"), "to"), "entity_uuid").select("normalized_alias", F.col("to").alias("entity_uuid"), F.lit(group).alias("group_id"))
    own_frames = pack["relation_frames"].select(F.lit(group).alias("group_id"), "alias", "canonical").dropDuplicates(["alias"])
    if frames is not None:
        own_frames = own_frames.join(frames.where(F.col("group_id") == group).select("alias"), "alias", "left_anti").select("group_id", "alias", "canonical")
    return Imported(fresh, aliases, new, bad, own_frames, removed)
