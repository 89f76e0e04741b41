"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints: majority bits of the 64-bit hashes of word shingles. Candidate
pairs come from a covering family of bit masks: bit ``i`` has a vector
``phi(i)`` of ``r + 1`` bits, and mask ``v`` holds the bits with odd
``phi(i) & v``. The vectors of at most ``r`` differing bits span less than the
whole space, so some ``v`` is orthogonal to all of them: in that mask's table
the pair agrees. Every pair within the radius therefore meets in one of the
``2**(r+1) - 1`` tables, and each meeting is checked by its bit distance.

Equal fingerprints are one node before any table is built, so copies never
multiply. Inside a bucket no pairs are written: a breadth-first search over
the bucket's fingerprints gives one row per linked fingerprint. Buckets larger
than ``max_bucket`` are not searched at once: their rows are dealt again by a
second covering family over the bits that the first mask leaves open, which
keeps the guarantee.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import heavy_join, heavy_keys
from .common import cut_lineage, free_name, hex64, id_text, map_batches, map_partitions, ship_by_value
from .components import connected_components

#: Bytes of text split into words at a time; bounds memory for very long texts.
BLOCK_BYTES = 1 << 20
MAX_BUCKET = 20_000
#: A component of this share of the fingerprints, a fingerprint of this share of the rows, is met by broadcast.
SHARES = 1000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _shingle_hashes(text: str, k: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles of a text, block by block."""
    data = text.encode("utf-8")
    at, kept, first = 0, [], True
    while at < len(data) or first:
        stop = _SPACE.search(data, at + BLOCK_BYTES)
        to = stop.start() if stop else len(data)
        # bytes.lower() changes A-Z only; bytes.split() splits at \x20 and \x09-\x0D
        words = kept + data[at:to].lower().split()
        at, last = to, to >= len(data)
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashes = [xxhash.xxh64_intdigest(joined[s:e], seed)
                      for s, e in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())]
            yield np.array(hashes, np.uint64)
            first = False
            kept = words[len(words) - k + 1:]
        else:
            kept = words
            if last and first and words:
                yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
        if last:
            return


def simhash(text: str, k: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in _shingle_hashes(text, k, seed):
        n += len(h)
        for part in np.array_split(h, -(-len(h) // 65536)):
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()) if n else 0


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long. With ``digests`` the text's
    SHA-256 follows as ``digest``."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t, k, seed) for t in batch.column("text").to_pylist()], np.uint64)
        more = ["digest"] if digests else []
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), *map(batch.column, more)],
                                          ["doc_id", "fp", *more])
    rows = id_text(docs, id_col, text_col)
    if not digests:
        return map_batches(rows, one, "doc_id long, fp long")
    return map_batches(rows.withColumn("digest", F.unhex(F.sha2("text", 256))), one, "doc_id long, fp long, digest binary")


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bit positions such that any ``radius`` of them miss one mask."""
    space = 1 << (radius + 1)
    phi = [i % (space - 1) + 1 for i in range(len(bits))]
    return [sum(1 << b for b, p in zip(bits, phi) if (p & v).bit_count() & 1)
            for v in range(1, space)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(index, index of its component's first node) of every node that has a link,
    searched breadth first: each node is compared once with what is not yet reached."""
    out, todo = [], np.arange(len(fps))
    while len(todo):
        root, todo = todo[0], todo[1:]
        queue = [root]
        while queue and len(todo):
            near = np.bitwise_count(fps[todo] ^ fps[queue.pop()]) <= radius
            found = todo[near]
            todo = todo[~near]
            queue.extend(found.tolist())
            out.extend((i, root) for i in found.tolist())
    return out


def _bucket_links(dealt: DataFrame, radius: int, max_bucket: int | None) -> DataFrame:
    """Links inside the buckets (t, w, key) of ``dealt``: a, b. With ``max_bucket``, rows of
    larger buckets come back unsearched with b null and their t."""
    # rows of a bucket become neighbours in one partition
    placed = (dealt.repartition("t", "w", "key")
              .sortWithinPartitions("t", "w", "key", "fp").select("t", "w", "key", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []          # rows of the last bucket seen so far
        n_held, over = 0, False

        def links(rows: np.ndarray) -> pa.RecordBatch | None:
            starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
            sizes = np.diff(np.append(starts, len(rows)))
            fps = rows[:, 3].view(np.uint64)
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            a, b, t = [rows[two + 1, 3]], [rows[two, 3]], [rows[two, 0]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                got = forest(np.ascontiguousarray(fps[s:s + n]), radius)
                if got:
                    i, j = np.array(got).T
                    a.append(rows[s + i, 3]), b.append(rows[s + j, 3])
                    t.append(np.full(len(i), rows[s, 0]))
            a, b, t = map(np.concatenate, (a, b, t))
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(a), pa.array(b)],
                                              ["t", "a", "b"]) if len(a) else None

        def unsearched(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 3])),
                 pa.nulls(len(rows), pa.int64())], ["t", "a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            if held and (rows[0, :3] != held[-1][-1, :3]).any():
                done = np.concatenate(held)
                out = unsearched(done) if over else links(done)
                if out is not None:
                    yield out
                held, n_held, over = [], 0, False
            # the last bucket of the batch may go on in the next one
            same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            tail = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            if tail:
                if held and over:                      # rows of the oversize bucket come first
                    end = int(np.argmin((rows[:, :3] == held[-1][-1, :3]).all(axis=1)))
                    yield unsearched(np.concatenate([*held, rows[:end]]))
                    held, body = [], rows[end:tail]
                else:
                    body = np.concatenate([*held, rows[:tail]])
                if len(body):
                    out = links(body)
                    if out is not None:
                        yield out
                held, n_held, over = [], 0, False
            held.append(rows[tail:])
            n_held += len(rows) - tail
            if max_bucket is not None and n_held > max_bucket:
                over = True
                yield unsearched(np.concatenate(held)[:-1])
                held = [held[-1][-1:]]
        if held:
            done = np.concatenate(held)
            out = unsearched(done) if over else links(done)
            if out is not None:
                yield out

    return map_partitions(placed, run, "t long, a long, b long")


def near_links(nodes: DataFrame, radius: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``nodes`` that join the same
    components as all pairs within ``radius`` bits do."""
    masks = covering_masks(radius, list(range(64)))
    deal = F.explode(F.array(*[
        F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks)]))
    dealt = nodes.select("fp", deal.alias("x")).select("x.t", F.lit(0).cast("long").alias("w"), "x.key", "fp")
    found = cut_lineage(_bucket_links(dealt, radius, max_bucket))
    # oversize buckets: the pair also agrees in one mask over the bits left open
    open_masks = [covering_masks(radius, [i for i in range(64) if not m >> i & 1]) for m in masks]
    second = F.element_at(F.array(*[F.array(*[F.lit(_signed(x)) for x in row]) for row in open_masks]),
                          F.col("t").cast("int") + 1)
    whole = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("t").cast("int") + 1)
    again = (found.where("b is null").select("t", F.col("a").alias("fp"), whole.alias("m"),
                                             F.posexplode(second).alias("w", "m2"))
             .select("t", F.col("w").cast("long").alias("w"),
                     F.col("fp").bitwiseAND(F.col("m").bitwiseOR(F.col("m2"))).alias("key"), "fp"))
    return found.where("b is not null").select("a", "b").union(
        _bucket_links(again, radius, None).select("a", "b"))


def near_dedup(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id",
               text_col: str = "text", seed: int = 42, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links between
    fingerprints that differ in at most ``radius`` bits. Fewer words than
    ``k``: the whole sequence is the one shingle. No words (null, empty or
    blank text): fingerprint zero, linked like any other. Null ids: the row
    takes part and gets its component; null only if no id is in it. Repeated
    rows are in one component. Empty table: no rows."""
    rows = cut_lineage(fingerprints(docs, k, seed, id_col, text_col))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    owner = cut_lineage(_owners(nodes, radius, max_bucket))
    first = owner.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    # large components and fingerprints of many rows are few: they meet their rows by broadcast
    total = nodes.agg(F.sum("n"), F.count("*")).first()
    first = cut_lineage(first)
    large = heavy_keys(first, "fps", SHARES, total[1]).drop("fps")
    named = cut_lineage(heavy_join(owner.select("component", "fp", "n"), first.drop("fps"), ["component"], large))
    common = heavy_keys(named, "n", SHARES, total[0] or 0).select("fp", "component_id")
    return heavy_join(rows, named.select("fp", "component_id"), ["fp"], common).select(
        "doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _owners(nodes: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    """The nodes with ``component``, the smallest fingerprint reachable."""
    parts = connected_components(near_links(nodes, radius, max_bucket)).select(
        F.col("node").alias("fp"), F.col("component").alias("_of"))
    return nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("_of", "fp")).drop("_of")


def keep_representatives(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id",
                         text_col: str = "text", seed: int = 42, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """The input rows that stay, with all their columns: one row of each component, that of the
    smallest id (rows without an id last), at equal ids of the smallest fingerprint and then digest.
    Of rows repeated under one id and text one stays."""
    rows = cut_lineage(fingerprints(docs, k, seed, id_col, text_col, digests=True))
    same = rows.groupBy("doc_id", "fp", "digest").agg(F.count("*").alias("same"))
    nodes = cut_lineage(same.groupBy("fp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "digest", "same")).alias("first")))
    best = _owners(nodes, radius, max_bucket).groupBy("component").agg(F.min("first").alias("best"))
    stay = cut_lineage(best.select(F.col("best.doc_id").alias("_stay_id"), F.col("best.digest").alias("_stay_digest"),
                                   (F.col("best.same") > 1).alias("_repeated"))).alias("k")
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"d.{text_col}").cast("string"), F.lit("")), 256))
    mark = free_name(docs.columns, "_digest")

    def having(some: DataFrame) -> DataFrame:
        on = (digest.eqNullSafe(F.col("k._stay_digest"))
              & F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("k._stay_id")))
        return docs.alias("d").join(some.hint("shuffle_hash"), on, "left_semi")

    once = (having(stay.where("k._repeated")).select("d.*", digest.alias(mark))
            .dropDuplicates([id_col, mark]).drop(mark))
    return having(stay.where("NOT k._repeated")).unionByName(once)


ship_by_value(__name__)
