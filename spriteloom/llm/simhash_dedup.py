"""SimHash near-duplicates by pigeonhole blocks (operator 8).

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word
shingles.  Two fingerprints that differ in at most d bits agree on at least one
of d + 1 blocks, so candidates meet on (block number, block value) and the
Hamming distance is verified there.

Scale.  Equal fingerprints collapse to one row before anything else, so exact
copies never form pairs.  A bucket with more than ``BUCKET`` distinct
fingerprints is not gathered: its members are split again by d + 1 blocks of the
bits that are still free, level by level.  That stays exact (the differing bits
all lie in the free bits, so some sub-block agrees) and is bounded (after the
last level at most 2**11 different fingerprints can share a key).  Inside a
bucket a breadth-first search emits a spanning forest, not all pairs.

Edge cases: a null text is an empty text; a text without words has fingerprint
zero and is linked like any other; fewer words than a shingle give one shingle;
rows with a null doc_id keep their fingerprint and get a null component unless
another document shares it; repeated rows share one component; an empty table
gives an empty result.  Columns other than (doc_id, text) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, scratch, unused, with_rows, without

#: Largest number of distinct fingerprints that one bucket may bring into a task.
BUCKET = 8192
#: Fingerprint bits are counted over this many hashes at a time.
CHUNK = 65536


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of one text, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    starts = np.concatenate(([0], ends[: len(words) - size] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(flat[i:j], seed) for i, j in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((majority(shingle_hashes(t.as_py(), size, seed)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id long, fp long")


def _forest(fp: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph 'at most distance bits apart'."""
    left, right = [], []
    rest = np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), ids[at]))
                right.append(ids[found])
                queue.extend(found)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _bucket_links(distance: int):
    def of(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Links within the runs of equal keys."""
        out_a, out_b = [], []
        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(bounds)
        u = fp.view(np.uint64)
        small = np.repeat(sizes <= 16, sizes)
        for d in range(1, 16):  # small buckets: all offsets at once over the whole batch
            i = np.flatnonzero(small[:-d] & (key[d:] == key[:-d])) if len(key) > d else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[np.bitwise_count(u[i] ^ u[i + d]) <= distance]
            out_a.append(fp[i])
            out_b.append(fp[i + d])
        for k in np.flatnonzero(sizes > 16):
            s = slice(bounds[k], bounds[k + 1])
            a, b = _forest(u[s], fp[s], distance)
            out_a.append(a)
            out_b.append(b)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:  # sorted by key: the last bucket of a batch may go on in the next one
            key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1])) if np.all(key[1:] >= key[:-1]) else 0
            if cut:
                yield of(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield of(key, fp)

    return kernel


def close_links(prints: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between different fingerprints of column ``fp`` at most ``distance`` bits apart.

    The links form, with those that they imply, exactly the components of the full graph.
    """
    cuts = distance + 1
    n_parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shapes = {0: tuple(range(64))}  # which bits are still free, by the blocks chosen so far
    level = prints.select("fp").distinct().select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).alias("shape"))
    found = None
    while True:
        keyed, after = None, {}
        for shape, free in shapes.items():
            options = []
            for k in range(cuts):
                mine = free[len(free) * k // cuts : len(free) * (k + 1) // cuts]
                mask = sum(1 << bit for bit in mine)
                after[new := len(after)] = tuple(bit for bit in free if bit not in mine)
                block = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
                options.append(F.struct(F.xxhash64("path", F.lit(k), block).alias("key"), F.lit(new).alias("shape")))
            one = level.where(F.col("shape") == shape).select("fp", F.explode(F.array(*options)).alias("o")).select("o.key", "fp", "o.shape")
            keyed = one if keyed is None else keyed.union(one)
        heavy = None
        if 2 ** max(map(len, after.values())) > bucket:
            keyed = materialize(keyed, "simhash-blocks")
            heavy = keyed.groupBy("key").count().where(F.col("count") > bucket).select("key")
            heavy = materialize(heavy, "simhash-heavy")
            heavy = heavy if heavy.limit(1).count() else None
        light = keyed.join(heavy, "key", "left_anti") if heavy is not None else keyed
        links = light.select("key", "fp").repartition(n_parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_links(distance), "a long, b long")
        found = links if found is None else found.union(links)
        if heavy is None:
            return found
        level, shapes = keyed.join(heavy, "key", "left_semi").select("fp", F.col("key").alias("path"), "shape"), after


def simhash_components(docs: DataFrame, size: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    prints = materialize(fingerprints(docs, size, seed), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(close_links(prints, distance), "a", "b")
    # only linked fingerprints have a root; the component's smallest doc_id is over all its fingerprints
    lows = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"), "simhash-roots")
    best = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    of = lows.join(best, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """One row of ``docs`` for every component: the first one of the smallest doc_id.

    Rows without a doc_id are not weighed against rows with one: of a component's
    rows without a doc_id one stays too.
    """
    row = f"{unused(docs)}_row"
    with scratch(docs.sparkSession, "rows", "keys"):
        rows = with_rows(docs, row)
        found = materialize(simhash_components(rows.select(F.col(row).alias("doc_id"), "text"), size, distance).select(F.col("doc_id").alias("row"), "component_id"), "simhash-rows")
        ids = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
        best = found.join(ids, "row").groupBy("component_id", F.col("id").isNull()).agg(F.min(F.struct("id", "row")).alias("best"))
        gone = found.join(best.select("best.row"), "row", "left_anti").select("row")
        return without(rows, gone, {"row": F.col(row)}).drop(row)
