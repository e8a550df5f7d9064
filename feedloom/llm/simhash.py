"""SimHash near-duplicates found with the binary Golay code.

A fingerprint's 64 bits form four segments of 16. Two fingerprints within three bits agree
in at least one segment; of the other three, at most one holds more than one error, so of any
two of them one holds at most one. A segment, padded to 23 bits, is decoded together with
all its one-bit neighbours to the perfect (23, 12) Golay code: that gives one codeword index
if it is within two bits of a codeword and six if not, and words at most two bits apart
always have an index in common. A key is an equal segment and the codeword index of
another one. Fingerprints that meet under a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import joined_by_row, stage, text_key
from feedloom.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
# Generator polynomial of the (23, 12) Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
CODE_BITS = 23
SEGMENT_BITS = 16
SEGMENTS = 4
# Fingerprints under one key are compared in blocks of this many.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
        fps = pa.array(np.array(values, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), fps], [*keys, "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, with text_key if `keyed`; fp holds the fingerprint's 64 bits in a long."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows, schema, keys = docs.select("doc_id", "text"), f"doc_id {doc_type}", ["doc_id"]
    if keyed:
        rows = rows.withColumn("text_key", text_key(F.col("text")))
        schema, keys = f"{schema}, text_key long", [*keys, "text_key"]
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle, keys=keys), f"{schema}, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words by the generator polynomial."""
    out = words.copy()
    for bit in range(CODE_BITS - 1, 10, -1):
        high = (out >> bit) & 1
        out ^= high * (GENERATOR << (bit - 11))
    return out


@cache
def golay_indices() -> np.ndarray:
    """Codeword indices of every 16-bit segment and its one-bit neighbours.

    65,536 rows of 6; repeats are filled with -1.
    """
    bits = [0, *(1 << i for i in range(CODE_BITS))]
    errors = {0}
    for _ in range(3):
        errors |= {e | b for e in errors for b in bits}
    patterns = np.array(sorted(errors), np.int64)
    correction = np.zeros(1 << 11, np.int64)
    correction[_remainders(patterns)] = patterns
    near = np.arange(1 << SEGMENT_BITS, dtype=np.int64)[:, None] ^ np.array(bits, np.int64)
    index = np.sort((near ^ correction[_remainders(near.ravel())].reshape(near.shape)) >> 11, axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    return -np.sort(-index, axis=1)[:, :6]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: equal segment and codeword index of each of the next two segments."""
    table = golay_indices()
    segments = [((fps >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(SEGMENTS)]
    rows, keys = [], []
    for i in range(SEGMENTS):
        for j in ((i + 1) % SEGMENTS, (i + 2) % SEGMENTS):
            index = table[segments[j]]
            row, place = np.nonzero(index >= 0)
            rows.append(row)
            keys.append((((i * SEGMENTS + j) << 28) | (segments[i][row] << 12) | index[row, place]).astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for start in range(0, len(fps), 8192):
            part = fps[start : start + 8192]
            rows, keys = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])


class _Forest:
    """Union-find over places in an array."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def spanning_links(left: np.ndarray, right: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what all links within `left`, or between both sides, connect."""
    every = left if right is None else np.concatenate([left, right])
    size = len(left)
    forest, links = _Forest(len(every)), []
    for i in range(size):
        start = i + 1 if right is None else size
        near = np.flatnonzero(np.bitwise_count(every[start:] ^ every[i]) <= max_bits) + start
        links += [(int(every[i]), int(every[j])) for j in near.tolist() if forest.join(i, j)]
    return links


LINK_SCHEMA = "a long, b long, key long, part int"


def _signed(values: list[int | None]) -> pa.Array:
    """64-bit patterns as longs."""
    return pa.array(
        [v if v is None or v < 1 << 63 else v - (1 << 64) for v in values], pa.int64()
    )


def _link_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, key, part = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [_signed(a), _signed(b), pa.array(key, pa.int64()), pa.array(part, pa.int32())],
        ["a", "b", "key", "part"],
    )


def _link_groups(
    batches: Iterator[pa.RecordBatch], max_bits: int, block: int
) -> Iterator[pa.RecordBatch]:
    """Reads (key, fp) sorted by key. Emits the links (a, b) of groups of up to `block` rows;
    of a larger group its rows as (a, null, key, part), for `_link_blocks`.

    Holds little more than a block and a batch, whatever a group's size is.
    """
    out: list[tuple] = []
    held, held_key, parts = np.zeros(0, np.uint64), None, 0

    def finish() -> None:
        if parts:
            out.extend((int(fp), None, held_key, parts + 1) for fp in held)
        elif len(held) == 2:
            if int(held[0] ^ held[1]).bit_count() <= max_bits:
                out.append((int(held[0]), int(held[1]), None, None))
        elif len(held) > 2:
            out.extend((a, b, None, None) for a, b in spanning_links(held, None, max_bits))

    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        fps = batch.column("fp").to_numpy().view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        # A group of one row can't link, but the first and the last may go on elsewhere.
        wanted = {0, len(starts) - 2, *np.flatnonzero(np.diff(starts) > 1).tolist()}
        for group in sorted(wanted):
            key, rows = int(keys[starts[group]]), fps[starts[group] : starts[group + 1]]
            if key == held_key:
                held = np.concatenate([held, rows])
            else:
                finish()
                held, held_key, parts = rows, key, 0
            while len(held) > block:
                parts += 1
                out.extend((int(fp), None, key, parts) for fp in held[:block])
                held = held[block:]
        if out:
            yield _link_batch(out)
            out.clear()
    finish()
    if out:
        yield _link_batch(out)


def _link_blocks(rows: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Links within a block, or between two blocks of a group."""
    first = rows["part"] == rows["low"]
    left = rows.loc[first, "a"].to_numpy(np.int64).view(np.uint64)
    right = rows.loc[~first, "a"].to_numpy(np.int64).view(np.uint64)
    links = spanning_links(left, right if len(right) else None, max_bits)
    ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp`, each within `max_bits` bits, such
    that everything within reach over such links stays within reach.

    A group of n fingerprints under one key gives at most n - 1 links. Groups larger than a
    block are compared block by block, each pair of blocks in a group of its own.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find at most {MAX_BITS} differing bits")
    keyed = fps.select("fp").mapInArrow(_spread, "key long, fp long")
    found = stage(
        keyed.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(partial(_link_groups, max_bits=max_bits, block=block), LINK_SCHEMA),
        "simhash-links",
    )
    members = found.where("part IS NOT NULL").select("key", "part", "a").distinct()
    parts = members.groupBy("key").agg(F.max("part").alias("parts"))
    pairs = (
        members.join(parts, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(1), "parts")))
        .withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
        .groupBy("key", "low", "high")
        .applyInPandas(partial(_link_blocks, max_bits=max_bits), "a long, b long")
    )
    return found.where("part IS NULL").select("a", "b").unionByName(pairs)


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    block: int = BLOCK,
    keyed: bool = False,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; if `keyed`, text_key and label, which names
    components without an id as well.

    Fingerprints link when they differ in at most `max_bits` bits; component_id is the
    smallest doc_id reachable over links, a document's own included. Null and empty texts have
    the fingerprint zero and link as any other. Rows with a null doc_id link others but
    give no component_id; a component of them alone has a null one. Repeated rows give
    repeated rows. Other columns are left out; an empty table gives an empty result.

    Copies meet as one fingerprint before any search, so a group of copies costs one row.
    """
    rows = stage(fingerprints(docs, shingle, keyed), "simhash")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    reached = components(links(distinct, max_bits, block)).withColumnRenamed("node", "fp")
    labelled = distinct.join(reached, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    ids = labelled.join(smallest, "label").select("fp", "component_id", "label")
    return rows.join(ids, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        *["text_key", "label"] * keyed,
    )


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest id; `found` is keyed. Rows without an
    id come last, and of rows with one id that of the smallest text_key stays. Of equal rows one stays.
    """
    names = found.groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "copies")
    first = stage(names.groupBy("label").agg(F.min(order).alias("k")).select("k.*"), "simhash-kept")

    def rows_of(copies: str) -> DataFrame:
        return joined_by_row(docs, first.where(copies).select("doc_id", "text_key"), "left_semi")

    several = rows_of("copies > 1").dropDuplicates(["doc_id", "text"])
    return rows_of("copies = 1").unionByName(several)
