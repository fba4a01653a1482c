"""Knowledge-base collections: S7, C1, C2, A5, A6, A7.

A knowledge base is one snapshot log (``sources.snapshots``) under a root path on shared storage. A
version names the row batches and the registry events it consists of:

* ``data/batch=<folder>/collection=<name>/``: the chunk rows of one write, partitioned by collection, so
  that stats and search prune to one collection;
* ``data/<folder>/`` of registry events ``(name, description, op, seq)``, where ``seq`` is the version
  that brought the event; the state of a name is its latest event ('create' or 'drop');
* ``data/<folder>/`` of a batch's key filter, if it was appended with ``dedupe_on``.

Rows and the creation of their collections are committed together, and of two writers that build on the
same version one wins and the other decides again on the new one (``SnapshotLog.update``): a name is
created once, and a reader sees a write whole or not at all. A drop is an event: rows of a collection that were
committed before its last drop are not read, and ``compact`` and ``vacuum`` remove them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.sources.snapshots import SnapshotLog

REGISTRY_SCHEMA = "name string, description string, op string, seq bigint"

#: Parts that the keys of a batch's filter are dealt into, bits a key, and bits set for each.
FILTER_PARTS = 256
FILTER_BITS = 12
FILTER_HASHES = 6
FILTER_SCHEMA = "part bigint, bits binary"

#: Files from this size on are rewritten by ``compact`` as they are read; the rows of smaller ones are brought together.
LARGE_FILE = 16 << 20

ROW_COLUMNS = [
    ("id", "string"), ("text", "string"), ("text_key", "string"),
    ("embedding", "array<float>"), ("model_name", "string"), ("dimension", "int"),
    ("start_time", "double"), ("end_time", "double"), ("source_file", "string"),
    ("chunk_index", "int"), ("language", "string"), ("source_url", "string"),
    ("audio_file", "string"), ("total_duration", "double"), ("chunk_length", "int"),
    ("processing_time", "double"), ("extra", "map<string,string>"),
]


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = SnapshotLog(spark, self.root)

    def _stage(self, df: DataFrame, prefix: str = "") -> str:
        folder = prefix + uuid.uuid4().hex
        df.write.parquet(self.log.folder(folder))
        return folder

    def _staged(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.log.folder(self._stage(df)))

    # ---- registry -----------------------------------------------------------------
    def _events(self, document: dict) -> DataFrame:
        paths = [self.log.folder(e["folder"]) for e in document.get("registry", {}).values()]
        if not paths:
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(*paths)

    def _live(self, document: dict) -> DataFrame:
        latest = self._events(document).groupBy("name").agg(F.max_by(F.struct("op", "description"), "seq").alias("e"))
        return latest.where(F.col("e.op") == F.lit("create")).select(
            "name", F.col("e.description").alias("description"))

    def registry(self) -> DataFrame:
        """Live collections: ``(name, description)``."""
        return self._live(self.log.latest()[1])

    def _with_events(self, base: int, document: dict, events: DataFrame) -> dict | None:
        """The document with these events as part of the next version; None if there are none."""
        folder = self._stage(events.select("name", "description", "op", F.lit(base + 1).cast("long").alias("seq")))
        if self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.log.folder(folder)).isEmpty():
            return None
        return {**document, "registry": {**document.get("registry", {}), str(base + 1): {"folder": folder}}}

    def _created(self, document: dict, names: DataFrame) -> DataFrame:
        """Create events for the names ``(name, description)`` that are absent; of several descriptions the smallest."""
        desc = F.coalesce(F.col("description"), F.concat(F.lit("Collection "), F.col("name")))
        return (names.select("name", desc.alias("description"))
                .groupBy("name").agg(F.min("description").alias("description"))
                .join(self._live(document).select("name"), "name", "left_anti").withColumn("op", F.lit("create")))

    def create(self, name: str, description: str | None = None) -> DataFrame:
        """Create-or-get; an existing collection keeps its description.

        Returns ``(name, description, document_count)`` with the given
        description, as the reference returns it.
        """
        self.create_many(self.spark.createDataFrame([(name, description)], "name string, description string"))
        count = self.rows(name).count()
        return self.spark.createDataFrame([(name, description, count)],
                                          "name string, description string, document_count bigint")

    def create_many(self, names: DataFrame) -> int:
        """C1 for a column of names ``(name, description)``: absent ones are created.

        Returns the version that holds them. A name that another writer created meanwhile is left as it is.
        """
        return self.log.update(lambda base, d: self._with_events(base, d, self._created(d, names)))

    def drop_many(self, names: DataFrame) -> int:
        """C2 for a column of names: their registry entries go, and their rows are no longer read."""
        gone = names.select("name").distinct().select(
            "name", F.lit(None).cast("string").alias("description"), F.lit("drop").alias("op"))

        def change(base, d):
            new = self._with_events(base, d, gone)
            return new and {**new, "drops": base + 1}

        return self.log.update(change)

    def drop(self, name: str) -> int:
        """Remove the registry entry and the collection's rows."""
        return self.drop_many(self.spark.createDataFrame([(name,)], "name string"))

    # ---- rows ---------------------------------------------------------------------
    def _batch_rows(self, folders: list[str], large: bool | None = None) -> DataFrame:
        """The rows of these folders; with ``large`` those of the large files only, or of the others."""
        schema = ", ".join(f"{c} {t}" for c, t in ROW_COLUMNS) + ", collection string, batch string"
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = (self.spark.read.option("basePath", f"{self.root}/data").schema(schema)
                .parquet(*[self.log.folder(f) for f in folders]))
        if large is None:
            return rows
        size = F.col("_metadata.file_size")  # files of the other kind are not opened
        return rows.where(size >= LARGE_FILE if large else size < LARGE_FILE)

    def _last_drops(self, document: dict) -> DataFrame:
        return self._events(document).where("op = 'drop'").groupBy("name").agg(F.max("seq").alias("_dropped"))

    def all_rows(self, version: int | None = None) -> DataFrame:
        """The rows of every collection, of the latest or an earlier version."""
        return self._rows_of(self.log.latest()[1] if version is None else self.log.document(version))

    def _rows_of(self, document: dict, large: bool | None = None) -> DataFrame:
        batches = list(document.get("batches", {}).values())
        last = document.get("drops", 0)
        rows = self._batch_rows([b["folder"] for b in batches if b["at"] > last], large)
        older = [b for b in batches if b["at"] <= last]
        if not older:
            return rows
        # a row counts if it was committed after its collection's last drop
        placed = self.spark.createDataFrame([(b["folder"].split("=", 1)[1], b["at"]) for b in older], "batch string, _at bigint")
        drops = self._last_drops(document).withColumnRenamed("name", "collection")
        kept = (self._batch_rows([b["folder"] for b in older], large).join(placed, "batch").join(drops, "collection", "left")
                .where(F.col("_dropped").isNull() | (F.col("_at") > F.col("_dropped"))))
        return rows.unionByName(kept.select(rows.columns))

    def rows(self, name: str) -> DataFrame:
        """Rows of one collection (partition-pruned)."""
        document = self.log.latest()[1]
        last = 0
        if document.get("drops"):
            last = self._last_drops(document).where(F.col("name") == F.lit(name)).agg(F.max("_dropped")).first()[0] or 0
        folders = [b["folder"] for b in document.get("batches", {}).values() if b["at"] > last]
        return self._batch_rows(folders).where(F.col("collection") == F.lit(name))

    def append(self, items: DataFrame, name: str = fv.DEFAULT_COLLECTION,
               dedupe_on: list[str] | None = None) -> None:
        """Add chunk rows (embedding optional); creates the collection if absent.

        Each call gives fresh ids, so adding the same items twice keeps two copies, unless ``dedupe_on``
        names columns that identify a row: items that equal a stored row of the collection in them (null
        equals null), or an earlier item, are left out. Empty input is a no-op: nothing is written and no collection
        is created.
        """
        self._append(items, F.lit(name), uuid.uuid4().hex, dedupe_on=dedupe_on)

    def append_by_column(self, items: DataFrame, collection_col: str, dedupe_on: list[str] | None = None) -> None:
        """S7 where each row names its collection; absent collections are created.

        Rows are rebalanced by collection before the write: small collections share a task, a large one is
        split over several, so the number of files follows the bytes and not tasks x collections.
        """
        self._append(items, F.col(collection_col), uuid.uuid4().hex, rebalance=True, dedupe_on=dedupe_on)

    def write_batch(self, items: DataFrame, name: str, batch_id: str) -> None:
        """Idempotent append: rows of ``batch_id`` replace any earlier write of it.

        Ids derive from the batch id, and the version that holds the new write no longer names the earlier one, so
        re-running a batch (a retried streaming micro-batch) leaves exactly one copy.
        """
        self._append(items, F.lit(name), batch_id, keyed=True)

    def _append(self, items: DataFrame, collection, batch: str, *, keyed: bool = False, rebalance: bool = False,
                dedupe_on: list[str] | None = None) -> None:
        rows = to_rows(items, batch, collection.alias("collection"))
        seen, document = self.log.latest()
        if dedupe_on:
            # stored first: its keys are read several times, and equal items are told apart by their ids
            rows = self._staged(rows.withColumn("collection", F.nullif("collection", F.lit(""))))
            # only ids and keys are compared; whole rows are moved once, and only if some are to be added
            new = self._staged(self._unseen(rows, document, dedupe_on))
            if new.isEmpty():
                return
            rows = rows.join(new, "id", "left_semi")
        elif rebalance:
            rows = rows.hint("rebalance", F.col("collection"))
        folder = self._write_rows(rows)
        written = self._batch_rows([folder])
        if written.isEmpty() and not (keyed and batch in document.get("batches", {})):
            return
        entry = {"folder": folder, "keyed": keyed}
        if dedupe_on:
            entry["filter"] = self._stage(key_filter(written, dedupe_on))
            entry["dedupe_on"] = dedupe_on
        names = written.select(F.col("collection").alias("name"), F.lit(None).cast("string").alias("description")).distinct()

        def change(base, d):
            if dedupe_on and d.get("batches", {}) != document.get("batches", {}):
                raise ConcurrentAppend  # other rows came in: the choice of new rows is out of date
            new = self._with_events(base, d, self._created(d, names)) or d
            return {**new, "batches": {**new.get("batches", {}), batch: {**entry, "at": base + 1}}}

        try:
            self.log.update(change)
        except ConcurrentAppend:
            self._append(items, collection, batch, keyed=keyed, rebalance=rebalance, dedupe_on=dedupe_on)

    def _write_rows(self, rows: DataFrame) -> str:
        folder = f"batch={uuid.uuid4().hex}"
        # texts take up most of a batch: a third less to write and keep than with the default codec
        rows.write.option("compression", "zstd").partitionBy("collection").parquet(self.log.folder(folder))
        return folder

    def _unseen(self, rows: DataFrame, document: dict, keys: list[str]) -> DataFrame:
        """Ids of the rows whose keys no stored row of their collection has; of equal ones the first id.

        Batches that carry a filter of the same keys are read only for the rows that their filter may hold.
        """
        on = ["collection", *keys]
        known = rows.groupBy(*on).agg(F.min("id").alias("id"))
        batches = document.get("batches", {}).values()
        filtered = [b for b in batches if b.get("dedupe_on") == keys]
        stored = self._visible(document, [b for b in batches if b.get("dedupe_on") != keys])
        held = _match(known, stored, on)
        if filtered:
            filters = self.spark.read.schema(FILTER_SCHEMA).parquet(*[self.log.folder(b["filter"]) for b in filtered])
            probable = probable_keys(known, filters, on)
            hits = known.join(probable, "id", "left_semi")
            held = held.unionByName(_match(hits, self._visible(document, filtered), on))
        return known.join(held.distinct(), "id", "left_anti").select("id")

    def _visible(self, document: dict, batches) -> DataFrame:
        """The rows of these batches that count."""
        own = {str(i): b for i, b in enumerate(batches)}
        return self._rows_of({**document, "batches": own})

    def compact(self, settled: bool = False) -> int:
        """Rewrite the rows that count as one batch, put in place by one commit.

        Only rows of small files are shuffled, to bring those of a collection together: a large file holds
        rows of one collection and gives as large files again.

        Batches of ``write_batch`` may be replayed and stay as they are, unless ``settled`` says that none
        will be. Writes and drops that are committed meanwhile keep their effect.
        """
        base, document = self.log.latest()
        old = {k: b for k, b in document.get("batches", {}).items() if settled or not b["keyed"]}
        if not old:
            return base
        large, small = (self._rows_of({**document, "batches": old}, which).drop("batch") for which in (True, False))
        folder = self._write_rows(large.unionByName(small.hint("rebalance", F.col("collection"))))
        entry = {"folder": folder, "keyed": False, "at": base}

        def change(now, d):
            held = d.get("batches", {})
            if any(held.get(k) != b for k, b in old.items()):  # compacted or replayed meanwhile
                return None
            rest = {k: b for k, b in held.items() if k not in old}
            return {**d, "batches": {folder: entry, **rest}}

        return self.log.update(change)

    def vacuum(self, keep: int = 1) -> None:
        """Remove earlier versions and what only they name; readers of those versions must have ended."""
        self.log.vacuum(keep)

    def stats(self, name: str = fv.DEFAULT_COLLECTION) -> DataFrame:
        """A5: ``(name, document_count, db_path)``."""
        return self.rows(name).agg(F.count(F.lit(1)).alias("document_count")).select(
            F.lit(name).alias("name"), "document_count", F.lit(self.root).alias("db_path"))

    def list(self) -> DataFrame:
        """Every live collection with description ('' if none) and row count."""
        counts = self.all_rows().groupBy("collection").agg(F.count(F.lit(1)).alias("document_count"))
        reg = self.registry()
        j = reg.join(counts, reg["name"] == counts["collection"], "left")
        return j.select("name", F.coalesce("description", F.lit("")).alias("description"),
                        F.coalesce("document_count", F.lit(0)).cast("bigint").alias("document_count"))


class ConcurrentAppend(Exception):
    """Another writer added rows while an append that leaves out stored keys was at work."""


def _match(items: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Ids of the items that equal a stored row in these columns (null equals null)."""
    theirs = stored.select(*[F.col(c).alias(f"_{c}") for c in on])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return items.join(theirs, same, "left_semi").select("id")


def _key_hash(on: list[str]):
    # nulls are skipped by the hash, so their places are hashed as well
    return F.xxhash64(*[F.col(c) for c in on], *[F.col(c).isNull() for c in on])


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each hash the bits it sets: a row a hash function (two halves combined)."""
    h = hashes.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.array([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(FILTER_HASHES)])


def _deal(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.withColumn("_hash", _key_hash(on)).withColumn("part", F.pmod(F.shiftright("_hash", 7), F.lit(FILTER_PARTS)))


def key_filter(rows: DataFrame, dedupe_on: list[str]) -> DataFrame:
    """A Bloom filter of the rows' keys in parts dealt by hash, ``FILTER_BITS`` bits a key: ``(part, bits)``."""
    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        hashes = t["_hash"].to_numpy()
        bits = np.zeros(max(64, len(hashes) * FILTER_BITS + 7 & ~7), bool)
        bits[_places(hashes, len(bits)).ravel()] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    keys = _deal(rows, ["collection", *dedupe_on]).select("part", "_hash").distinct()
    return keys.groupBy("part").applyInArrow(build, FILTER_SCHEMA)


def probable_keys(items: DataFrame, filters: DataFrame, on: list[str]) -> DataFrame:
    """Ids of the items that some filter may hold."""
    id_type = dict(items.dtypes)["id"]

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = left["_hash"].to_numpy()
        hit = np.zeros(len(hashes), bool)
        for raw in right["bits"].to_pylist():
            bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
            hit |= bits[_places(hashes, len(bits))].all(axis=0)
        return left.select(["id"]).filter(pa.array(hit))

    dealt = _deal(items, on).select("id", "part", "_hash")
    other = filters.withColumnRenamed("part", "_part")
    return dealt.groupBy("part").cogroup(other.groupBy("_part")).applyInArrow(probe, f"id {id_type}")


def to_rows(items: DataFrame, run_id: str, *extra_cols) -> DataFrame:
    """F20 on insert: the stored row shape, with falsy defaults and a fresh id.

    The id is a hash of the run id and the row's position (task and row in
    it), so equal rows of one append have different ids, and a retried task
    writes the ids of the first attempt.
    """
    cols = set(items.columns)

    def get(name: str, typ: str):
        return F.col(name).cast(typ) if name in cols else F.lit(None).cast(typ)

    ident = F.concat(F.lit(run_id + "/"), F.monotonically_increasing_id().cast("string"))
    text = F.coalesce(get("text", "string"), F.lit(""))
    return items.select(
        F.sha2(ident, 256).substr(1, 32).alias("id"),
        text.alias("text"),
        F.md5(text).alias("text_key"),
        # stored as float32 (as vector stores keep them): half the bytes;
        # distances are computed in double after a cast
        get("embedding", "array<float>").alias("embedding"),
        get("model_name", "string").alias("model_name"),
        get("dimension", "int").alias("dimension"),
        F.coalesce(F.nullif(get("start_time", "double"), F.lit(0.0)), F.lit(0.0)).alias("start_time"),
        F.coalesce(F.nullif(get("end_time", "double"), F.lit(0.0)), F.lit(0.0)).alias("end_time"),
        F.coalesce(get("source_file", "string"), F.lit("")).alias("source_file"),
        F.coalesce(get("chunk_index", "int"), F.lit(0)).alias("chunk_index"),
        get("language", "string").alias("language"),
        F.coalesce(get("source_url", "string"), F.lit("")).alias("source_url"),
        get("audio_file", "string").alias("audio_file"),
        get("total_duration", "double").alias("total_duration"),
        get("chunk_length", "int").alias("chunk_length"),
        get("processing_time", "double").alias("processing_time"),
        (F.col("extra") if "extra" in cols else F.lit(None).cast("map<string,string>")).alias("extra"),
        *extra_cols,
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per transcript plus a total row (transcript_id NULL)."""
    return chunks.rollup("transcript_id").agg(F.count(F.lit(1)).alias("n_chunks"))
