"""Tables stored by key: upserts that rewrite only the buckets they touch.

A table lies in a fixed number of buckets by the hash of its key.  A commit
writes the touched buckets of all its tables to a folder of its own, then one
manifest that names every bucket's folder; readers take the newest manifest.
A commit that breaks off has no manifest and is never read, and tables of one
commit change together.  There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline.sources.files import write_whole


@dataclass(frozen=True)
class Upsert:
    """Rows to store: of a key the row of the latest ``version`` stays; rows
    whose ``gone`` column is true delete their key (until a later version
    comes).  Rows of one version: what is stored goes before what comes, and
    within a batch the choice is fixed by a hash of the row."""

    rows: DataFrame
    keys: tuple[str, ...]
    version: tuple[str, ...]
    gone: str | None = None


class KeyedStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # manifests: {number, buckets, tables: {name: {schema, keys, version, gone, at: {bucket: folder}}}}

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def manifest(self) -> dict:
        """The newest commit; an empty one before the first."""
        from pyarrow import fs

        files, path = self._files()
        found = files.get_file_info(fs.FileSelector(f"{path}/_commits", allow_not_found=True))
        names = [f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith(".")]
        if not names:
            return {"number": 0, "buckets": self.buckets, "tables": {}}
        with files.open_input_stream(max(names)) as f:
            return json.loads(f.read())

    def _read(self, table: dict, name: str, buckets=None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        paths = [f"{self.folder}/{at}/{name}/_bucket={b}" for b, at in sorted(table["at"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """The stored rows of a table, without deleted ones."""
        table = self.manifest()["tables"][name]
        return _alive(self._read(table, name), table["gone"])

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """Stored rows of the given keys; only their buckets are read."""
        manifest = self.manifest()
        table = manifest["tables"][name]
        types = {f.name: f.dataType for f in StructType.fromJson(table["schema"]).fields}
        keys = keys.select(*[F.col(k).cast(types[k]).alias(f"_k_{k}") for k in table["keys"]]).distinct()
        bucket = _bucket([f"_k_{k}" for k in table["keys"]], manifest["buckets"])
        touched = {r[0] for r in keys.select(bucket).distinct().collect()}
        rows = _alive(self._read(table, name, touched), table["gone"])
        same = [rows[k].eqNullSafe(keys[f"_k_{k}"]) for k in table["keys"]]
        return rows.join(keys, same, "left_semi")

    def stage(self, **upserts: Upsert) -> dict:
        """Writes the touched buckets; nothing is visible before ``publish``."""
        manifest = self.manifest()
        commit = f"commit-{uuid.uuid4().hex}"
        out = {"number": manifest["number"] + 1, "buckets": manifest["buckets"], "tables": dict(manifest["tables"])}
        for name, up in upserts.items():
            out["tables"][name] = self._write(manifest, commit, name, up)
        return out

    def _write(self, manifest: dict, commit: str, name: str, up: Upsert) -> dict:
        old = manifest["tables"].get(name)
        rows = up.rows
        if old is not None:
            if (list(up.keys), list(up.version), up.gone) != (old["keys"], old["version"], old["gone"]):
                raise ValueError(f"{name} is stored with keys {old['keys']}, version {old['version']}, gone {old['gone']}")
            schema = StructType.fromJson(old["schema"])
            unknown = set(rows.columns) - set(schema.names)
            if unknown:
                raise ValueError(f"{name} has no columns {sorted(unknown)}")
            have = set(rows.columns)
            rows = rows.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        columns = rows.columns
        clash = {"_bucket", "_row", "_rank"} & set(columns)
        if clash:
            raise ValueError(f"columns with names of the store: {sorted(clash)}")

        def latest(df: DataFrame, *keys: str) -> DataFrame:
            return df.groupBy(*keys).agg(F.max_by("_row", "_rank").alias("_row"), F.max("_rank").alias("_rank"))

        def ranked(df: DataFrame, stored: int) -> DataFrame:
            rank = F.struct(*[F.col(v) for v in up.version], F.lit(stored).alias("_stored"), F.xxhash64(F.to_json(F.struct(*columns))).alias("_hash"))
            return df.select(*up.keys, F.struct(*columns).alias("_row"), rank.alias("_rank"))

        bucket = _bucket(list(up.keys), manifest["buckets"])
        # one row a key, combined before the shuffle: a hot key is one row a task
        coming = latest(ranked(rows, 0), *up.keys).select(bucket.alias("_bucket"), *up.keys, "_row", "_rank")
        coming.write.parquet(f"{self.folder}/{commit}/_incoming-{name}")
        coming = self.spark.read.parquet(f"{self.folder}/{commit}/_incoming-{name}")
        touched = {r[0] for r in coming.select("_bucket").distinct().collect()}
        if old is not None:
            stored = ranked(self._read(old, name, touched), 1).select(bucket.alias("_bucket"), *up.keys, "_row", "_rank")
            coming = coming.unionByName(stored)
        merged = latest(coming.repartition("_bucket"), "_bucket", *up.keys).select("_bucket", "_row.*")
        merged.write.partitionBy("_bucket").parquet(f"{self.folder}/{commit}/{name}")
        files, path = self._files()
        files.delete_dir(f"{path}/{commit}/_incoming-{name}")
        at = {**(old["at"] if old else {}), **{str(b): commit for b in touched}}
        schema = old["schema"] if old else json.loads(rows.schema.json())
        return {"schema": schema, "keys": list(up.keys), "version": list(up.version), "gone": up.gone, "at": at}

    def publish(self, staged: dict) -> int:
        """Makes a staged commit the newest, unless another one came first."""
        if self.manifest()["number"] != staged["number"] - 1:
            raise RuntimeError("another commit came first; stage again")
        write_whole(f"{self.folder}/_commits/{staged['number']:012d}.json", json.dumps(staged).encode())
        return staged["number"]

    def commit(self, **upserts: Upsert) -> int:
        return self.publish(self.stage(**upserts))

    def vacuum(self) -> int:
        """Removes what the newest commit doesn't name: older versions and
        commits that broke off.  Not while others read or write."""
        from pyarrow import fs

        files, path = self._files()
        used = {(at, name, f"_bucket={b}") for name, table in self.manifest()["tables"].items() for b, at in table["at"].items()}
        commits = {at for at, _, _ in used}
        removed = 0
        for commit in files.get_file_info(fs.FileSelector(path)):
            if not commit.base_name.startswith("commit-"):
                continue
            if commit.base_name not in commits:
                files.delete_dir(commit.path)
                removed += 1
                continue
            for entry in files.get_file_info(fs.FileSelector(commit.path, recursive=True)):
                if entry.type == fs.FileType.Directory and entry.base_name.startswith("_bucket="):
                    table = entry.path.rsplit("/", 2)[-2]
                    if (commit.base_name, table, entry.base_name) not in used:
                        files.delete_dir(entry.path)
                        removed += 1
        return removed


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _alive(rows: DataFrame, gone: str | None) -> DataFrame:
    return rows if gone is None else rows.where(~F.coalesce(F.col(gone), F.lit(False)))


# fixed values
PLATFORMS = ("LINUX", "AIX", "SOLARIS", "HPUX", "WINDOWS", "EXADATA", "UNKNOWN")
CATEGORIES = ("DB", "OS", "NETWORK", "STORAGE", "MEMORY", "CLUSTER", "SECURITY", "APPLICATION")
LAYERS = ("INFRA", "OS_TRIGGERED", "ASM", "MEMORY", "NETWORK", "CLUSTER", "DB", "DATAGUARD", "RMAN", "SECURITY", "APPLICATION")
TIERS = ("OS + Infrastructure", "OS + ASM", "OS + Database", "ASM", "Network", "Memory", "Cluster", "Database", "Application")


def learn(store: KeyedStore, incidents: DataFrame) -> int:
    """K9: feedback (error_code, log_snippet, commands, platform, category,
    layer, fix_tier, hostname, learned_at) as chunks and graph nodes, both in
    one commit.  Values outside their lists become UNKNOWN, DB, DB, Database;
    a known code's node gets the latest commands.  A report that is learned
    twice is one chunk, as its id comes from what it says; rows without a code
    are left out."""
    valid = lambda c, of, default, seen=None: F.when((seen if seen is not None else F.col(c)).isin(*of), seen if seen is not None else F.col(c)).otherwise(default)
    rows = incidents.where("error_code is not null").select(
        "error_code", "log_snippet", "commands", F.coalesce("hostname", F.lit("unknown")).alias("hostname"), "learned_at", valid("platform", PLATFORMS, "UNKNOWN", F.upper("platform")).alias("platform"),
        valid("category", CATEGORIES, "DB", F.upper("category")).alias("category"), valid("layer", LAYERS, "DB").alias("layer"), valid("fix_tier", TIERS, "Database").alias("fix_tier"),
    )
    said = F.to_json(F.struct("error_code", "hostname", "log_snippet"))
    chunks = rows.select(
        F.concat(F.lit("learned_"), F.substring(F.sha2(said, 256), 1, 16)).alias("chunk_id"), "platform", "hostname", F.lit("DBA_FEEDBACK").alias("log_source"), F.col("learned_at").alias("timestamp_start"),
        "category", F.lit("LEARNED").alias("sub_category"), F.lit("CRITICAL").alias("severity"), F.col("error_code").alias("ora_code"), F.col("log_snippet").alias("raw_text"),
    )
    node = F.concat(F.lit("oracle_"), F.replace(F.lower("error_code"), F.lit("-"), F.lit("_")))
    nodes = rows.select(node.alias("id"), "layer", "fix_tier", F.concat(F.lit("DBA Fix for "), "error_code").alias("title"), "commands", F.col("learned_at").alias("updated_at"))
    return store.commit(chunks=Upsert(chunks, ("chunk_id",), ("timestamp_start",)), nodes=Upsert(nodes, ("id",), ("updated_at",)))
