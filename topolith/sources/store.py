"""The signature store: a parquet table in version folders, JSON in and out, metadata.

A write makes a new version folder next to the old ones and then moves the ``CURRENT`` pointer, so a reader
keeps the version it opened (a snapshot) and a failed job leaves the store as it was.  The secondary
indexes of a key-value store are columns here; nothing has to be kept in step.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..workspace import children, get_text, put_text, remove

META_FIELDS = ("version", "description", "created_at", "last_updated_at", "source_hash")
SCHEMA_VERSION = "3"
MAX_JSON = 64 * 1024 * 1024


def signature_schema() -> T.StructType:
    """Declared schema of a signature row; files are never inferred."""
    s, i, d, b = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
    words = T.ArrayType(s)
    of = lambda **c: T.StructType([T.StructField(k, v) for k, v in c.items()])
    flow = of(has_infinite_loop=b, has_reconnect_logic=b)
    found = of(required_calls=words, optional_calls=words, string_patterns=words, control_flow=flow)
    meta = of(author=s, created=s, references=words)
    return of(
        id=s, name=s, description=s, severity=s, category=s, topology_hash=s, fuzzy_hash=s, entropy_score=d, entropy_tolerance=d,
        node_count=i, loop_depth=i, identifying_features=found, metadata=meta, obfuscation_score=d,
    )


@dataclass(frozen=True)
class ScanConfig:
    """Threshold and tolerance of a scan, both checked: finite and within [0, 1]."""

    threshold: float = 0.75
    tolerance: float = 0.5

    def __post_init__(self) -> None:
        for name in ("threshold", "tolerance"):
            v = getattr(self, name)
            if not math.isfinite(v) or not 0 <= v <= 1:
                raise ValueError(f"{name} must lie in [0, 1], not {v}")


# ---------------------------------------------------------------- table operations


def with_ids(rows: DataFrame, position: str) -> DataFrame:
    """Rows without an id get ``SFW-AUTO-`` and 16 hex digits from their position, name and hashes."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (position, "name", "topology_hash", "fuzzy_hash") if c in rows.columns]
    digest = F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)
    return rows.withColumn("id", F.when(F.coalesce("id", F.lit("")) != "", F.col("id")).otherwise(F.concat(F.lit("SFW-AUTO-"), digest)))


def last_of_batch(batch: DataFrame, position: str) -> DataFrame:
    """One row per id, the last by ``position``."""
    by = Window.partitionBy("id").orderBy(F.col(position).desc())
    return batch.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")


def upsert(base: DataFrame, batch: DataFrame, position: str) -> DataFrame:
    """Batch rows replace base rows of the same id; within the batch the last one wins.

    A null or empty id must have been filled (``with_ids``); a batch row without a topology hash is an error
    when written through ``Store``.
    """
    new = last_of_batch(batch, position)
    return base.join(new.select("id"), "id", "left_anti").unionByName(new)


def append(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows are added as they come; equal ids live side by side and a lookup takes the last."""
    return base.unionByName(batch)


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("id"), "id", "left_anti")


def mark_false_positive(base: DataFrame, marks: DataFrame, at: Column) -> DataFrame:
    """Add ``FP:<time>:<notes>`` to the references of the marked ids; ``marks(id, notes)``, one per id.

    A marked row without metadata gets some; null notes are empty ones; rows with a null id are never marked.
    """
    note = F.concat(F.lit("FP:"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(":"), F.col("notes"))
    refs = F.coalesce("metadata.references", F.array().cast("array<string>"))
    joined = base.join(marks.select("id", F.coalesce("notes", F.lit("")).alias("notes")), "id", "left")
    fields = [F.array_append(refs, note).alias(f) if f == "references" else F.col(f"metadata.{f}").alias(f) for f in base.schema["metadata"].dataType.fieldNames()]
    return joined.withColumn("metadata", F.when(F.col("notes").isNotNull(), F.struct(*fields)).otherwise(F.col("metadata"))).drop("notes")


def by_id(base: DataFrame, key: str, position: str) -> DataFrame:
    """The row of an id, the last one if there are several; empty if there is none."""
    return base.where(F.col("id") == key).orderBy(F.col(position).desc()).limit(1)


def ids(base: DataFrame) -> DataFrame:
    """Distinct ids in order; a null id is none."""
    return base.select("id").where("id is not null").distinct().orderBy("id")


def first_by_hash(base: DataFrame) -> DataFrame:
    """(topology_hash, id): the least id of every hash."""
    return base.where("topology_hash <> '' and id is not null").groupBy("topology_hash").agg(F.min("id").alias("id"))


def entropy_range(base: DataFrame, low: float, high: float) -> DataFrame:
    """Rows with entropy in [low, high], ordered by entropy to four places, then id.

    A plain range filter: it reaches the scan and prunes by the file statistics.
    """
    return base.where(F.col("entropy_score").between(low, high)).orderBy(F.round("entropy_score", 4), "id")


def statistics(base: DataFrame) -> DataFrame:
    """Rows, and rows in each index: hash, non-empty bucket, entropy."""
    n = lambda c, a: F.count_if(c).alias(a)
    return base.agg(
        F.count(F.lit(1)).alias("signatures"), n(F.coalesce("topology_hash", F.lit("")) != "", "by_hash"), n(F.coalesce("fuzzy_hash", F.lit("")) != "", "by_bucket"), n(F.col("entropy_score").isNotNull(), "by_entropy"),
    )


def index_entries(base: DataFrame) -> DataFrame:
    """(index, key, id): the entries of the three secondary indexes, made anew from the rows.

    Empty hashes and null entropies are not indexed; a row without an id has no entry.
    """
    entry = lambda name, key, keep: F.when(keep, F.struct(F.lit(name).alias("index"), key.alias("key")))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    entries = F.array_compact(F.array(
        entry("hash", F.col("topology_hash"), filled("topology_hash")), entry("bucket", F.col("fuzzy_hash"), filled("fuzzy_hash")),
        entry("entropy", names.entropy_key(F.col("entropy_score"), F.col("id")), F.col("entropy_score").isNotNull()),
    ))
    return base.where(filled("id")).select("id", F.explode(entries).alias("e")).select("e.index", "e.key", "id")


def pivot_metadata(entries: DataFrame) -> DataFrame:
    """One row per ``store`` from ``(store, key, value, position)``: the named fields and a map of the other keys.

    The last value of a key by position counts; a null key is none.
    """
    last = entries.where("key is not null").groupBy("store", "key").agg(F.max_by("value", "position").alias("value"))
    field = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
    other = F.when(~F.col("key").isin(*META_FIELDS), F.struct("key", "value"))
    custom = F.map_from_entries(F.array_sort(F.collect_list(other))).alias("custom")
    return last.groupBy("store").agg(*[field(k) for k in META_FIELDS], custom)


# The file name and the folders a store is looked for in, after an explicit path and the variable.
STORE_NAME, STORE_VARIABLE, STORE_FOLDERS = "signatures.db", "SIGNATURE_STORE", (".", "~", "/usr/local/share", "/var/lib")


def resolve_path(path: str = "", folders: Sequence[str] = STORE_FOLDERS) -> str:
    """The given path, else the variable's, else the first folder with a store in it, else one in the working folder."""
    if given := path or os.environ.get(STORE_VARIABLE, ""):
        return given
    found = (os.path.join(os.path.expanduser(f), STORE_NAME) for f in folders)
    return next((f for f in found if os.path.exists(f)), os.path.join(".", STORE_NAME))


def export_json(base: DataFrame) -> DataFrame:
    """(id, line): one JSON object per signature, in id order; ``Store.export`` wraps them in a document."""
    return base.orderBy("id").select("id", F.to_json(F.struct(*[F.col(c) for c in base.columns])).alias("line"))


# ---------------------------------------------------------------- JSON documents


def read_json(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Signatures of a JSON document ``{version, description, signatures}`` with their position.

    Strict: unknown fields, top-level or in a signature, are an error, and so is a document over
    64 MiB; otherwise unknown top-level fields are ignored.  A missing ``signatures`` is an error in both.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if strict and (size or 0) > MAX_JSON:
        raise ValueError(f"{path} is larger than {MAX_JSON} bytes")
    keys = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path).schema
    if "signatures" not in keys.fieldNames():
        raise ValueError("no signatures in the document")
    if strict:
        declared = signature_schema()
        unknown = set(keys.fieldNames()) - {"version", "description", "signatures"}
        row = keys["signatures"].dataType
        if isinstance(row, T.ArrayType) and isinstance(row.elementType, T.StructType):
            unknown |= _unknown(row.elementType, declared)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
    schema = T.StructType([T.StructField("signatures", T.ArrayType(signature_schema()))])
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.posexplode("signatures").alias("position", "s")).select("s.*", F.col("position").cast("long").alias("position"))


def _unknown(found: T.StructType, declared: T.StructType, at: str = "") -> set[str]:
    extra = {at + f.name for f in found if f.name not in declared.fieldNames()}
    for f in found:
        if f.name in declared.fieldNames() and isinstance(f.dataType, T.StructType) and isinstance(declared[f.name].dataType, T.StructType):
            extra |= _unknown(f.dataType, declared[f.name].dataType, f"{at}{f.name}.")
    return extra


# ---------------------------------------------------------------- the store


class Store:
    """Signatures and metadata in a folder that all executors share.

    ``CURRENT`` holds the number and the folder of the current version.  Every write goes to a folder of its own
    and counts only once the pointer is replaced, in one step; a writer that finds the pointer moved since
    it began is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _current(self) -> tuple[int, str]:
        text = get_text(self.spark, f"{self.path}/CURRENT")
        number, _, folder = (text or "-1 ").partition(" ")
        return int(number), folder

    def version(self) -> int:
        """Number of the current version, -1 for a store never written."""
        return self._current()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows; it stays readable while newer ones are written."""
        self._check_schema()
        number, folder = self._current()
        if version is not None and version != number:
            folder = next((f for f in children(self.spark, self.path) if f.startswith(f"v{version:08d}-")), "")
        if not folder:
            raise ValueError("the store is empty" if number < 0 else f"no version {version}")
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def _check_schema(self) -> None:
        have = self.metadata().get("schema_version", SCHEMA_VERSION)
        if have != SCHEMA_VERSION:
            raise ValueError(f"schema version {have}, this engine reads {SCHEMA_VERSION}")

    def write(self, rows: DataFrame, begun: int | None = None) -> int:
        """Commit ``rows`` as the next version.  Sorted by entropy, so range scans skip files.

        ``begun`` is the version the rows were made from (the current one if not given).
        """
        bad = rows.where(F.coalesce("topology_hash", F.lit("")) == "").limit(1).count()
        if bad:
            raise ValueError("every signature needs a topology hash")
        base = self.version() if begun is None else begun
        folder = f"v{base + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows.sortWithinPartitions("entropy_score").write.parquet(f"{self.path}/{folder}")
        if self.version() != base:
            remove(self.spark, f"{self.path}/{folder}")
            raise RuntimeError(f"version {base} of {self.path} is no longer the current one")
        put_text(self.spark, f"{self.path}/CURRENT", f"{base + 1} {folder}")
        return base + 1

    def compact(self, rows_per_file: int = 1_000_000, keep: int = 1) -> int:
        """Rewrite the current version in few files by ranges of entropy, and delete all but the last ``keep`` versions."""
        rows = self.read()
        number = self.write(rows.repartitionByRange(max(1, -(-rows.count() // rows_per_file)), "entropy_score"))
        for f in children(self.spark, self.path):
            if re.match(r"v\d{8}-\w+$", f) and int(f[1:9]) <= number - keep:
                remove(self.spark, f"{self.path}/{f}")
        return number

    def migrate(self, path: str) -> int:
        """Take over a JSON document, unknown top-level fields and all; equal ids upsert.  Returns the rows read."""
        rows = read_json(self.spark, path, strict=False)
        self.add(rows)
        return rows.count()

    def add(self, batch: DataFrame, position: str = "position") -> int:
        """Upsert a batch; ids are filled in where they are missing."""
        filled, begun = with_ids(batch, position), self.version()
        if begun < 0:
            return self.write(last_of_batch(filled, position), begun)
        return self.write(upsert(self.read(), filled, position), begun)

    def remove(self, ids: list[str]) -> int:
        """Delete by id; an id that is not there is an error."""
        begun, base = self.version(), self.read()
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        missing = gone.join(base, "id", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(missing[0]["id"])
        return self.write(delete(base, gone), begun)

    def get(self, key: str, position: str = "position") -> DataFrame:
        found = by_id(self.read(), key, position)
        if found.isEmpty():
            raise KeyError(key)
        return found

    def export(self, path: str, generated_at: str) -> None:
        """Write one JSON document, rows in id order, as parts that concatenate to it in name order."""
        lines = self.read().drop("position")
        numbered = export_json(lines).select("line")
        head = F.lit(f'{{"version":"{SCHEMA_VERSION}","generated_at":"{generated_at}","signatures":[')
        total = numbered.count()
        rows = numbered.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
        body = self.spark.createDataFrame(rows, "k long, line string").withColumn("line", F.concat(F.when(F.col("k") == 0, head).otherwise(""), F.col("line"), F.when(F.col("k") == total - 1, "]}").otherwise(",")))
        body.select("line").write.text(path)

    # metadata: a small JSON file, one object

    def metadata(self) -> dict[str, str]:
        return json.loads(get_text(self.spark, f"{self.path}/META") or "{}")

    def set_metadata(self, **values: str | None) -> None:
        """Set keys; a value of None deletes its key.  ``created_at`` is kept once set."""
        old = self.metadata()
        new = old | {k: v for k, v in values.items() if not (k == "created_at" and k in old)}
        put_text(self.spark, f"{self.path}/META", json.dumps({k: v for k, v in new.items() if v is not None}, sort_keys=True))

    def set_all_metadata(self, fields: dict[str, str | None], custom: dict[str, str]) -> None:
        """Set the named fields that are not empty and the custom keys; the schema version is always this engine's."""
        unknown = set(fields) - set(META_FIELDS)
        if unknown:
            raise ValueError(f"not a metadata field: {sorted(unknown)}")
        self.set_metadata(**{k: v for k, v in fields.items() if v}, **(custom | {"schema_version": SCHEMA_VERSION}))

    def all_metadata(self) -> dict[str, object]:
        """Named fields, the number of signatures, and every other key under ``custom``."""
        have = self.metadata()
        found: dict[str, object] = {k: have.get(k) for k in META_FIELDS}
        found["signature_count"] = self.read().count() if self.version() >= 0 else 0
        return found | {"custom": {k: v for k, v in have.items() if k not in META_FIELDS}}

    def initialise(self, now: str) -> None:
        self.set_metadata(schema_version=SCHEMA_VERSION, created_at=now, last_updated_at=now)

    def touch(self, now: str) -> None:
        self.set_metadata(last_updated_at=now)
