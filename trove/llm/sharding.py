"""Sharding by fixed virtual slots.

Records are hashed into some thousands of slots that never change. Bytes are summed for each slot, a map assigns
slots to shards, and the map is a stored, versioned table: to rebalance or to add a shard, some of its rows are
edited and a new version is written, and only the records of the edited slots move.

Law: `bytes` (shards hold nearly equal bytes). The map has as many rows as there are slots, which bounds what the
driver holds and what is broadcast.

Defined cases: null text counts as empty (size 1); null doc_id is hashed like a value; repeated rows are separate
records; ties in size go to the smaller slot or shard; very long texts count whole; a version of the map that was not
written to its end is passed over; an empty table gives an empty result; other columns are left alone by the operator and may have any name.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trove.llm.common import shared_folder, stage

N_SLOTS = 4096


def record_sizes(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and the record's virtual slot."""
    data = F.coalesce(F.encode(F.col("text"), "utf-8"), F.lit(b""))
    crc = F.crc32(data)
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id"), crc), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of each slot that has records; at most one entry a slot."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in rows}


def assign(slots: dict[int, tuple[int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """A first map: the largest slot goes to the lightest shard, again and again; empty slots are dealt in turn."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for slot in sorted(slots, key=lambda k: (-slots[k][0], k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + slots[slot][0], shard))
    return out | {k: k % n_shards for k in range(n_slots) if k not in out}


def rebalance(old: dict[int, int], slots: dict[int, tuple[int, int]], n_shards: int, slack: float = 0.02) -> dict[int, int]:
    """Edit a map until no shard is over the mean by more than slack, moving as few slots as greed allows.

    Slots of shards that no longer exist move first; then slots leave the heaviest shard for the lightest.
    """
    new = dict(old)
    load = dict.fromkeys(range(n_shards), 0)
    loose = [k for k, s in new.items() if s >= n_shards]
    for k, s in new.items():
        if s < n_shards:
            load[s] += slots.get(k, (0, 0))[0]
    for k in sorted(loose, key=lambda k: (-slots.get(k, (0, 0))[0], k)):
        new[k] = min(load, key=lambda s: (load[s], s))
        load[new[k]] += slots.get(k, (0, 0))[0]
    mean = sum(load.values()) / max(1, n_shards)
    while True:
        top, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        room = (load[top] - load[low]) / 2
        fits = [k for k, s in new.items() if s == top and 0 < slots.get(k, (0, 0))[0] <= room]
        if load[top] <= mean * (1 + slack) or not fits:
            return new
        k = max(fits, key=lambda k: (slots[k][0], -k))
        new[k] = low
        load[top] -= slots[k][0]
        load[low] += slots[k][0]


def store_map(spark: SparkSession, slot_map: dict[int, int], version: int, path: str) -> None:
    """Write one version of the map; earlier versions stay. A version is never overwritten."""
    rows = [(k, v) for k, v in sorted(slot_map.items())]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.parquet(f"{path}/version={version}")


def map_versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """The versions that are there, and whether each was written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return {int(n[8:]): files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")) for n in names if n.startswith("version=")}


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A version of the map, the latest whole one if none is named; version 0 is the empty map."""
    version = max((v for v, whole in map_versions(spark, path).items() if whole), default=0) if version is None else version
    if not version:
        return 0, {}
    table = spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")
    return version, {r.virtual_slot: r.shard for r in table.collect()}


def place(records: DataFrame, slot_map: dict[int, int], slots: dict[int, tuple[int, int]], version: int = 1) -> DataFrame:
    """Each record's shard and its place there, gapless from 0: its slot's offset in the shard plus its rank in the slot."""
    spark = records.sparkSession
    offset: dict[int, int] = {}
    rows = []
    for k in sorted(slot_map):
        rows.append((k, slot_map[k], offset.get(slot_map[k], 0)))
        offset[slot_map[k]] = offset.get(slot_map[k], 0) + slots.get(k, (0, 0))[1]
    table = F.broadcast(spark.createDataFrame(rows, "virtual_slot int, shard int, first long"))  # one row a slot
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("rank", rank).join(table, "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "virtual_slot", F.lit(version).alias("map_version"),
    )


def next_map(spark: SparkSession, slots: dict[int, tuple[int, int]], n_shards: int, n_slots: int, path: str) -> tuple[int, dict[int, int]]:
    """The stored map, first edited for the present bytes and shards if it is off balance; a new map if none is stored."""
    version, old = load_map(spark, path)
    new = rebalance(old, slots, n_shards) if old else assign(slots, n_shards, n_slots)
    if new != old:
        store_map(spark, new, max(map_versions(spark, path), default=0) + 1, path)
        version, new = load_map(spark, path)
    return version, new


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Place all documents by the stored map at map_path (by default a new one in the shared folder), edited if it is off balance."""
    spark = docs.sparkSession
    records = stage(record_sizes(docs, n_slots), "shard-records")
    slots = slot_bytes(records)
    version, slot_map = next_map(spark, slots, n_shards, n_slots, map_path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")
    return place(records, slot_map, slots, version)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by version 1 of a stored map of 8 shards; next_shard: by version 2, the map edited for one shard more."""
    path = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    records = stage(record_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "shard-records")
    slots = slot_bytes(records)
    version, slot_map = next_map(spark, slots, 8, N_SLOTS, path)
    placed = place(records, slot_map, slots, version)
    _, grown = next_map(spark, slots, 9, N_SLOTS, path)
    edited = F.broadcast(spark.createDataFrame(sorted(grown.items()), "virtual_slot int, next_shard int"))  # one row a slot
    return placed.join(edited, "virtual_slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_shard")


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
