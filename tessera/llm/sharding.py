"""Sharding: minimax contiguous partition of ordered atomic groups, native.

Rows with equal texts form one atomic group. Groups are ordered by the SHA-256
of their text, an order without hot ranges, and cut into ``n_shards``
contiguous pieces whose largest size is as small as possible: a binary search
over the capacity with a greedy check. The driver never holds the groups. It
holds a prefix tree over the digests: sizes per leading hex digits, of which
only the nodes that may contain a cut are opened further, one aggregation per
level (at most about ``n_shards**2 * 256`` rows each, whatever the input).
Cuts are digests, so a row finds its shard by comparing its own digest with
``n_shards - 1`` literals: no join, and a text that holds a third of all rows
is no hot key.

A group larger than an equal share cannot be cut; it gets a shard of its own
and the other groups share the remaining shards, so one giant group does not
raise the capacity, and with it the imbalance, of all shards.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, id_text

FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Rows numbered by one task when slots are dealt.
SLOT_ROWS = 5_000


@dataclass
class Nodes:
    """Consecutive ranges of the digest order: prefixes, start offsets, atomic or not."""

    prefix: list[str]
    start: list[int]      # one more than nodes: the last is the total
    atomic: list[bool]

    @classmethod
    def of(cls, rows: list[tuple[str, int, bool]]) -> Nodes:
        rows = sorted(rows)
        start = [0]
        for _, size, _ in rows:
            start.append(start[-1] + size)
        return cls([r[0] for r in rows], start, [r[2] for r in rows])

    def cuts(self, capacity: int, shards: int, inside: bool) -> list[int]:
        """Greedy ends of the shards. ``inside``: a cut may fall anywhere inside a
        node that is not opened yet (never too small), else only between nodes."""
        at, ends = 0, []
        for _ in range(shards):
            to = min(at + capacity, self.start[-1])
            j = min(bisect_right(self.start, to), len(self.prefix)) - 1
            if to < self.start[-1] and not (inside and not self.atomic[j]):
                to = self.start[j]
            at = max(at, to)
            ends.append(at)
        return ends

    def capacity(self, shards: int, least: int, inside: bool) -> int:
        """The smallest capacity whose greedy cuts reach the end."""
        low, high = least, max(least, self.start[-1])
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, inside)[-1] >= self.start[-1]:
                high = mid
            else:
                low = mid + 1
        return low


def _sizes(groups: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
    rows = (groups.groupBy(F.substring("key", 1, digits).alias("p"))
            .agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect())
    return [(r["p"], r["s"], r["n"] == 1) for r in rows]


def minimax_cuts(groups: DataFrame, shards: int, largest: int) -> list[str]:
    """First digest prefixes of the shards 1 .. of the partition of ``groups``
    (key: hex digest, size) whose largest shard is smallest, cut greedily."""
    known = {p: (s, one) for p, s, one in _sizes(groups, FIRST_DIGITS)}
    digits = FIRST_DIGITS
    while known:
        nodes = Nodes.of([(p, s, one) for p, (s, one) in known.items()])
        least = max(-(-nodes.start[-1] // shards), largest)
        low = nodes.capacity(shards, least, inside=True)
        high = nodes.capacity(shards, least, inside=False)
        first, last = nodes.cuts(low, shards, False), nodes.cuts(high, shards, True)
        unsure = set()
        for a, b in zip(first[:-1], last[:-1]):
            j = max(bisect_right(nodes.start, a) - 1, 0)
            while j < len(nodes.prefix) and nodes.start[j] < b:
                if not nodes.atomic[j] and nodes.start[j + 1] > a:
                    unsure.add(nodes.prefix[j])
                j += 1
        if not unsure:
            at = {s: i for i, s in reversed(list(enumerate(nodes.start[:-1])))}
            return [nodes.prefix[at[e]] if e in at else "g" for e in nodes.cuts(high, shards, False)[:-1]]
        digits = min(len(p) for p in unsure)  # all open nodes of one level at a time
        level = sorted(p for p in unsure if len(p) == digits)
        inner = groups.where(F.substring("key", 1, digits).isin(level))
        for p in level:
            del known[p]
        known.update({p: (s, one) for p, s, one in _sizes(inner, digits + MORE_DIGITS)})
    return []


def _giants(groups: DataFrame, shards: int, total: int) -> list[tuple[str, int]]:
    """Groups larger than an equal share of what remains (fewer than ``shards``)."""
    top = groups.orderBy(F.desc("size"), "key").limit(shards).collect()
    own: list[tuple[str, int]] = []
    for r in top:
        left = shards - len(own)
        if left > 1 and r["size"] * left > total:
            own.append((r["key"], r["size"]))
            total -= r["size"]
        else:
            break
    return own


def _numbered(rows: DataFrame, shards: int) -> DataFrame:
    """``slot``: gapless from 0 in each shard, in two levels."""
    counts = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    parts = F.element_at(F.array(*[F.lit(-(-counts.get(s, 0) // SLOT_ROWS) or 1) for s in range(shards)]),
                         F.col("shard") + 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), parts.cast("long")))
    before = (rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
              .select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part"))
                                        - F.col("n")).alias("before")))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "doc_id", "row"))
    return (rows.withColumn("own", own).join(before, ["shard", "part"])
            .withColumn("slot", F.col("own") - 1 + F.col("before")))


def minimax_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id",
                   text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus ``overhead``; equal texts share a
    shard; ``slot`` runs from 0 without gaps in each shard. Null text: no
    bytes, grouped with empty texts. Null ids and repeated rows are rows like
    any other. Fewer groups than shards: some shards stay empty. Empty table:
    no rows."""
    rows = cut_lineage(id_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length("text") + F.lit(overhead)).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"), F.sha2("text", 256).alias("key"),
        F.monotonically_increasing_id().alias("row")))
    groups = cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size").alias("s")).first()["s"] or 0
    own = _giants(groups, n_shards, total)
    rest = groups.where(~F.col("key").isin([k for k, _ in own])) if own else groups
    largest = rest.agg(F.max("size").alias("m")).first()["m"] or 0
    left = n_shards - len(own)
    shard: Column = F.lit(0)
    for cut in minimax_cuts(rest, left, largest):
        shard = shard + (F.col("key") >= F.lit(cut)).cast("int")
    for i, (key, _) in enumerate(own):
        shard = F.when(F.col("key") == F.lit(key), F.lit(left + i)).otherwise(shard)
    out = _numbered(rows.withColumn("shard", shard.cast("int")), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
