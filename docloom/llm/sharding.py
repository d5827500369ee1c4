"""Sharding over fixed virtual slots.

Records hash into thousands of slots, equal texts into the same one.  Bytes are summed for each
slot, and a versioned map says which shard holds a slot; rebalancing edits the map and so moves
whole slots.  A slot with more bytes than a share of a shard (a hot text) is mapped by its units,
parts of the slot by id hash, so that no group of copies has to fit a shard.

Rows are only ever handled by DataFrame functions.  The map is a fixed number of entries that the
driver plans.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import shared_dir, stored


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the assignment of units to shards; unit = slot * units_per_slot + part.

    ``loads`` are the units' bytes.  A slot that isn't in ``split`` is moved as a whole.
    """

    version: int
    shards: int
    units_per_slot: int
    loads: tuple[int, ...]
    split: frozenset[int]
    assignment: tuple[int, ...]

    @classmethod
    def plan(cls, loads: list[int], shards: int, units_per_slot: int, whole_share: float = 0.75) -> SlotMap:
        """Version 1: the largest pieces first, each to the shard with the fewest bytes (ties: lowest number)."""
        empty = cls(1, shards, units_per_slot, tuple(loads), frozenset(), (0,) * len(loads))
        empty = replace(empty, split=empty.hot(whole_share))
        pieces = sorted(empty.pieces(), key=lambda p: (-p[0], p[1]))
        assignment = [0] * len(loads)
        heap = [(0, s) for s in range(shards)]
        for size, units in pieces:
            held, shard = heapq.heappop(heap)
            for u in units:
                assignment[u] = shard
            heapq.heappush(heap, (held + size, shard))
        return replace(empty, assignment=tuple(assignment))

    def hot(self, whole_share: float = 0.75) -> frozenset[int]:
        """Slots with more bytes than a share of a shard."""
        k, most = self.units_per_slot, whole_share * sum(self.loads) / self.shards
        return frozenset(s for s in range(len(self.loads) // k) if sum(self.loads[s * k : (s + 1) * k]) > most)

    def pieces(self) -> list[tuple[int, tuple[int, ...]]]:
        """What the map moves: (bytes, units)."""
        k, out = self.units_per_slot, []
        for s in range(len(self.loads) // k):
            units = tuple(range(s * k, (s + 1) * k))
            if s in self.split:
                out += [(self.loads[u], (u,)) for u in units]
            else:
                out.append((sum(self.loads[u] for u in units), units))
        return out

    def held(self) -> list[int]:
        """Bytes of each shard."""
        out = [0] * self.shards
        for load, shard in zip(self.loads, self.assignment, strict=True):
            out[shard] += load
        return out

    def rebalanced(self, loads: list[int] | None = None, shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version for new bytes or more shards: pieces move from the fullest to the emptiest
        shard, the largest that fits the gap first, until they differ by at most ``tolerance`` of the mean."""
        new = replace(self, version=self.version + 1, loads=tuple(loads or self.loads), shards=shards or self.shards)
        new = replace(new, split=new.split | new.hot())
        assignment, held = list(new.assignment), new.held()
        by_shard: dict[int, list] = {s: [] for s in range(new.shards)}
        for size, units in new.pieces():
            by_shard[assignment[units[0]]].append((size, units))
        for own in by_shard.values():
            own.sort(reverse=True)
        slack = tolerance * sum(held) / new.shards
        for _ in range(len(assignment)):
            low, high = min(range(new.shards), key=held.__getitem__), max(range(new.shards), key=held.__getitem__)
            gap = held[high] - held[low]
            piece = next((p for p in by_shard[high] if 0 < p[0] <= gap / 2), None)
            if gap <= slack or piece is None:
                break
            by_shard[high].remove(piece)
            by_shard[low].append(piece)
            by_shard[low].sort(reverse=True)
            held[high] -= piece[0]
            held[low] += piece[0]
            for u in piece[1]:
                assignment[u] = low
        return replace(new, assignment=tuple(assignment))

    def frame(self, spark: SparkSession) -> DataFrame:
        """``unit, shard``, made by SQL functions of one literal."""
        held = F.split(F.lit(",".join(map(str, self.assignment))), ",")
        units = spark.range(len(self.assignment), numPartitions=1)
        return units.select(F.col("id").alias("unit"), F.element_at(held, (F.col("id") + 1).cast("int")).cast("int").alias("shard"))

    def save(self, spark: SparkSession, path: str) -> str:
        """Writes this version as a table of its own under ``path`` and returns the table's path."""
        path = f"{path}/version={self.version}"
        loads = F.split(F.lit(",".join(map(str, self.loads))), ",")
        rows = self.frame(spark).withColumn("bytes", F.element_at(loads, (F.col("unit") + 1).cast("int")).cast("long"))
        split = F.array(*[F.lit(s) for s in sorted(self.split)]).cast("array<int>")
        rows = rows.withColumns({"shards": F.lit(self.shards), "units_per_slot": F.lit(self.units_per_slot), "is_split": F.array_contains(split, F.floor(F.col("unit") / self.units_per_slot).cast("int"))})
        rows.write.mode("overwrite").parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """The map of ``version``, or the newest, that was saved under ``path``; None if there is none."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        names = [x.getPath().getName() for x in files.listStatus(folder)]
        versions = [int(x.split("=")[1]) for x in names if x.startswith("version=")]
        if not versions or (version is not None and version not in versions):
            return None
        version = max(versions) if version is None else version
        rows = sorted(spark.read.parquet(f"{path}/version={version}").collect(), key=lambda r: r["unit"])  # slots * units_per_slot rows
        per_slot = rows[0]["units_per_slot"]
        split = frozenset(r["unit"] // per_slot for r in rows if r["is_split"])
        return cls(version, rows[0]["shards"], per_slot, tuple(r["bytes"] for r in rows), split, tuple(r["shard"] for r in rows))


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def with_units(documents: DataFrame, *, id_col: str, text_col: str, slots: int, units_per_slot: int) -> DataFrame:
    """``doc_id, size, text_crc32, unit``: the slot by the text's hash, the part by the id's."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slot = F.pmod(F.xxhash64(text), F.lit(slots))
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("part")), F.lit(units_per_slot))
    return documents.select(
        F.col(id_col).alias("doc_id"), text_size(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), (slot * units_per_slot + part).alias("unit")
    )


def shard(
    documents: DataFrame,
    *,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = 4096,
    units_per_slot: int = 16,
    save_map: str | None = None,
) -> tuple[DataFrame, SlotMap]:
    """Each record's ``doc_id, size, text_crc32, shard, slot``, and the map it follows.

    Under ``save_map`` lie the versions of the map.  If there is one for as many slots, the newest is rebalanced for
    the bytes of these records and saved as the next version, so that few slots move; else version 1 is planned.
    Without ``save_map`` the map is saved in a new folder of the shared one.

    ``slot`` counts the records of a shard from 0 without gaps, by unit and in it by id, size and checksum.
    A null or empty text counts 1 byte; null ids are hashed as such; repeated rows are placed side by side;
    an empty table gives no rows and an even map; further columns are ignored.  Equal texts share a shard
    unless their slot exceeds three quarters of a shard.
    """
    spark = documents.sparkSession
    digests = stored(with_units(documents, id_col=id_col, text_col=text_col, slots=slots, units_per_slot=units_per_slot), "digests")
    sums = stored(digests.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "units")
    loads = [0] * (slots * units_per_slot)
    for r in sums.select("unit", "bytes").collect():  # at most slots * units_per_slot rows
        loads[r["unit"]] = r["bytes"]
    path = save_map or f"{shared_dir(spark)}/docloom/slot-map-{uuid.uuid4().hex}"
    last = SlotMap.load(spark, path)
    if last and len(last.loads) == len(loads) and last.units_per_slot == units_per_slot and last.shards <= shards:
        plan = last.rebalanced(loads, shards)
    else:
        plan = SlotMap.plan(loads, shards, units_per_slot)
        plan = replace(plan, version=last.version + 1) if last else plan
    plan.save(spark, path)
    before = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    units = plan.frame(spark).join(F.broadcast(sums.select("unit", "rows")), "unit")
    placed = units.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("unit", "shard", "base")
    order = Window.partitionBy("unit").orderBy("doc_id", "size", "text_crc32")
    numbered = digests.withColumn("place", F.row_number().over(order).cast("long") - 1)
    out = numbered.join(F.broadcast(placed), "unit")  # one row a unit
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot")), plan
