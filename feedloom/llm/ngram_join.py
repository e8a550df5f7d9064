"""N-gram Jaccard join by prefixes of token combinations.

A document's tokens are the hashes of its distinct runs of five words. All tokens stand in one order: the
rare ones first, then the frequent ones, each by hash. Two sets of Jaccard similarity 0.8 or more
miss at most a fifth of each other's tokens. So a prefix of one token more than that fifth holds a
common token, if all of it is rare. If the rare tokens are too few for that, the prefix goes on into the frequent ones;
those are dealt to buckets by hash, and a bucket counts for one token less than the prefix
has of it. As many counts as a pure prefix has tokens, and some bucket holds two common tokens: rare
tokens are indexed alone, frequent ones as pairs of one bucket. How many buckets there are follows the
size of the set, in levels of a quarter more each; sets that can be similar share a level.

Under a key of few sets, each pair of them is counted: how many keys it shares. Of the set whose prefix ends first, every
token of the prefix that the other lacks is one it misses, and a pair that can't afford these goes. Under a key of
many sets, each is tied to one of them, and within what the ties connect all pairs are looked at, block by block.

Both kinds of pairs must also have near sketches. A sketch has a bit for every class of tokens, which tells whether the set
has an odd number of them; two sets differ in at least as many tokens as their sketches do in bits. So no similar
pair is lost, and pairs that merely share a key hardly ever stay; otherwise these would join most sets of a large table
in one cluster. The pairs that are left form clusters. Within these every pair of sets that isn't yet connected is
compared by all its tokens, block by block, and only links are written.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import release, stage
from feedloom.llm.components import components
from feedloom.llm.decontaminate import SIEVE_BITS, build_sieve

SHINGLE = 5
# A token is frequent if more different sets than this have it in a plain prefix; twice as many, four times and so on
# where more than 2^20 tokens would be.
FREQUENT = 32
MOST_FREQUENT = 1 << 20
# Levels begin at powers of 5/4; five tokens of a set of a level's size go to one bucket.
LEVELS = [-(-(5**k) // 4**k) for k in range(130)]
PER_BUCKET = 5
# Sets and tokens of a cluster that are compared with each other in one task, and so many times as many sketches.
BLOCK_SETS = 2_048
BLOCK_TOKENS = 2_000_000
SKETCHES = 4
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Turns the order of unsigned numbers into that of signed ones.
_SIGN = np.uint64(1 << 63)
_MOST = (1 << 63) - 1


def tokens_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of words; of fewer words, of all of them; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(words) - shingle + 1))


def prefix_length(n: int) -> int:
    """One more than the tokens that a set of n may miss: n - ceil(0.8 n) + 1, or 0 without tokens."""
    return n // 5 + 1 if n else 0


def is_frequent(tokens: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    at = tokens & np.uint64(SIEVE_BITS - 1)
    return ((sieve[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = (left ^ (right * _MULTIPLIER)) * _MULTIPLIER
    return out ^ (out >> np.uint64(31))


def bucket_pairs(frequent: np.ndarray, wanted: int, level: int) -> np.ndarray:
    """Keys of the pairs of one bucket among the first of the frequent tokens whose counts come to `wanted`."""
    buckets = max(1, LEVELS[level] // PER_BUCKET)
    bucket = mixed(frequent, np.full(1, level, np.uint64)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], bucket[order])
    earlier = np.empty(len(frequent), np.int64)
    earlier[order] = np.arange(len(frequent)) - starts
    end = int(np.searchsorted(np.cumsum(earlier > 0), wanted)) + 1
    part = order[order < end]
    back = earlier[part]
    # Each token with all earlier ones of its bucket, which stand right before it.
    later = np.repeat(np.arange(len(part)), back)
    step = np.arange(len(later)) - np.repeat(np.cumsum(back) - back, back) + 1
    left, right = frequent[part[later - step]], frequent[part[later]]
    return mixed(mixed(left, right), np.full(1, level, np.uint64))


def index_keys(tokens: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set: rare tokens alone, and pairs of frequent ones where the rare ones are too few."""
    n = len(tokens)
    wanted = prefix_length(n)
    # Sets of one token are similar to equal ones only.
    common = is_frequent(tokens, sieve) if n > 1 else np.zeros(n, bool)
    rare = tokens[~common]
    if len(rare) >= wanted:
        return rare[:wanted], np.zeros(0, np.uint64)
    level = bisect_right(LEVELS, n) - 1
    pairs = [bucket_pairs(tokens[common], wanted - len(rare), at) for at in (level, level + 1)]
    return rare, np.unique(np.concatenate(pairs))


def sketch_bits(n: int) -> int:
    """Size of the sketch of a set of n: a power of two, more than n and at most 2 n, 64 at least."""
    return max(64, 1 << n.bit_length())


def sketch_of(tokens: np.ndarray) -> bytes:
    bits = sketch_bits(len(tokens))
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(n: int, sketch: bytes, other_n: int, other: bytes) -> bool:
    """Sets of Jaccard similarity 0.8 or more differ in a ninth of the sum of their sizes at most."""
    if 5 * min(n, other_n) < 4 * max(n, other_n):
        return False
    if len(sketch) < len(other):
        sketch, other = other, sketch
    long, short, bits = int.from_bytes(sketch, "little"), int.from_bytes(other, "little"), 8 * len(sketch)
    while bits > 8 * len(other):
        bits //= 2
        long = (long >> bits) ^ (long & ((1 << bits) - 1))
    return 9 * (long ^ short).bit_count() <= n + other_n


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Size, digest, plain prefix and sketch of every row's set."""
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            sizes, digests, prefixes, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = tokens_of(text, shingle)
                sizes.append(len(tokens))
                digests.append(_digest(tokens))
                prefixes.append(tokens[: prefix_length(len(tokens))])
                sketches.append(sketch_of(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists(prefixes),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "row_key", "n", "digest", "prefix", "sketch"],
            )


def _chosen_tokens(
    batches: Iterator[pa.RecordBatch], shingle: int, rows: np.ndarray
) -> Iterator[tuple[bytes, np.ndarray]]:
    """Digest and tokens of the rows whose keys the sieve `rows` may hold."""
    for batch in batches:
        keys = batch.column("row_key").to_numpy().view(np.uint64)
        for i in np.flatnonzero(is_frequent(keys, rows)):
            tokens = tokens_of(batch.column("text")[int(i)].as_py(), shingle)
            yield _digest(tokens), tokens


def _all_tokens(batches: Iterator[pa.RecordBatch], shingle: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    digests, arrays, size = [], [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), _lists(arrays)], ["digest", "tokens"])

    for digest, tokens in _chosen_tokens(batches, shingle, rows):
        digests.append(digest)
        arrays.append(tokens)
        size += len(tokens)
        if size > 1 << 18:
            yield flush()
            digests, arrays, size = [], [], 0
    if digests:
        yield flush()


ENTRY = "digest binary, n long, last long, rare array<long>, pairs array<long>"


def _entries(found: list[tuple[bytes, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Index entries of sets. `last` is the last token of the prefix, in an order of signed numbers; the largest one
    of a prefix that goes on behind the rare tokens."""
    last = [_MOST if len(pairs) else int(rare[-1] ^ _SIGN) for _, _, rare, pairs in found]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f[0] for f in found], pa.binary()),
            pa.array([f[1] for f in found], pa.int64()),
            pa.array(np.array(last, np.uint64).view(np.int64)),
            _lists([f[2] for f in found]),
            _lists([f[3] for f in found]),
        ],
        ["digest", "n", "last", "rare", "pairs"],
    )


def _longer_prefixes(
    batches: Iterator[pa.RecordBatch], shingle: int, rows: np.ndarray, sieve: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Entries of the sets whose plain prefix holds frequent tokens."""
    found = []
    for digest, tokens in _chosen_tokens(batches, shingle, rows):
        # The sieve of rows may also let rows of one token through.
        if len(tokens) > 1 and is_frequent(tokens[: prefix_length(len(tokens))], sieve).any():
            found.append((digest, len(tokens), *index_keys(tokens, sieve)))
        if len(found) == 256:
            yield _entries(found)
            found = []
    if found:
        yield _entries(found)


def _plain_prefixes(batches: Iterator[pa.RecordBatch], sieve: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries of the other sets."""
    for batch in batches:
        found = []
        digests, sizes, lists = batch.column("digest").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix")
        values = lists.flatten().to_numpy().view(np.uint64)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts = np.concatenate([[0], np.cumsum(is_frequent(values, sieve))])
        none = np.zeros(0, np.uint64)
        for i in np.flatnonzero((counts[at[1:]] == counts[at[:-1]]) | (np.array(sizes) == 1)):
            found.append((digests[i], sizes[i], values[at[i] : at[i + 1]], none))
        if found:
            yield _entries(found)


def _with_frequent(batches: Iterator[pa.RecordBatch], sieve: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Row keys of the sets whose plain prefix holds frequent tokens."""
    for batch in batches:
        prefix = batch.column("prefix")
        counts = np.concatenate([[0], np.cumsum(is_frequent(prefix.flatten().to_numpy().view(np.uint64), sieve))])
        at = prefix.offsets.to_numpy() - prefix.offsets[0].as_py()
        found = (counts[at[1:]] > counts[at[:-1]]) & (batch.column("n").to_numpy() > 1)
        yield pa.RecordBatch.from_arrays([batch.column("row_key").filter(pa.array(found))], ["row_key"])


class Overlaps:
    """How many tokens a set shares with each of `arrays`, by way of each token's holders."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.sizes = np.array([len(a) for a in arrays])
        owners = np.repeat(np.arange(len(arrays)), self.sizes)
        _, self.tokens = np.unique(np.concatenate(arrays), return_inverse=True)
        self.holders = owners[np.argsort(self.tokens, kind="stable")]
        counts = np.bincount(self.tokens)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hub = int(np.argmax(np.add.reduceat(counts[self.tokens], self.first[:-1]) - self.sizes))

    def similar(self, x: int) -> np.ndarray:
        """The sets of Jaccard similarity 0.8 or more with set x, itself included."""
        mine = self.tokens[self.first[x] : self.first[x + 1]]
        lengths = self.starts[mine + 1] - self.starts[mine]
        at = np.arange(lengths.sum()) + np.repeat(self.starts[mine] - (np.cumsum(lengths) - lengths), lengths)
        common = np.bincount(self.holders[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= 80 * (self.sizes + self.sizes[x] - common))


def link_block(arrays: list[np.ndarray], first_part: int | None = None) -> list[tuple[int, int]]:
    """Links, one fewer than sets at most, that connect what the links of all similar pairs connect.

    The set with most in common with the others comes first. Sets connected with it aren't compared among
    themselves, any other set is compared with all. With `first_part`, the sets before that place
    are compared with those from there on only.
    """
    overlaps = Overlaps(arrays)
    parent = list(range(len(arrays)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    hub = overlaps.hub if first_part is None else None
    for x in [hub, *range(len(arrays))] if hub is not None else range(first_part):
        if hub is not None and links and root(x) == root(hub):
            continue
        for y in overlaps.similar(x):
            if first_part is not None and y < first_part:
                continue
            a, b = root(x), root(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, int(y)))
    return links


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int | None, list[tuple]]]:
    """The rows (part, *columns) of every group (cluster, low, high) of several rows, which come group by group. Of two
    blocks, the rows of the lower one come first, and their number is given."""
    group, rows = None, []

    def whole() -> tuple[int | None, list[tuple]]:
        rows.sort(key=lambda row: row[0])
        return (None if group[1] == group[2] else sum(row[0] == group[1] for row in rows)), rows

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "low", "high")), strict=True)
        values = []
        for name in ["part", *columns]:
            column = batch.column(name)
            if pa.types.is_list(column.type):
                flat, at = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
                values.append([flat[at[i] : at[i + 1]].copy() for i in range(len(column))])
            else:
                values.append(column.to_pylist())
        for key, row in zip(keys, zip(*values, strict=True), strict=True):
            if key != group:
                if len(rows) > 1:
                    yield whole()
                group, rows = key, []
            rows.append(row)
    if len(rows) > 1:
        yield whole()


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every group of sets."""
    for low, rows in _groups(batches, ["digest", "tokens"]):
        found = link_block([tokens for _, _, tokens in rows], low)
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[x][1] for x, _ in found], pa.binary()), pa.array([rows[y][1] for _, y in found], pa.binary())],
            ["a", "b"],
        )


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b"))
        found = pa.array([may_be_similar(*row) for row in zip(*columns, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(found) for c in ("a", "b")], ["a", "b"])


def near_block(sizes: np.ndarray, sketches: list[bytes], first_part: int | None = None) -> list[tuple[int, int]]:
    """Pairs, one fewer than sets at most, that connect what all pairs connect that may be similar. With `first_part`,
    pairs of a set before that place and one from there on only."""
    label, links = np.arange(len(sizes)), []
    width = np.array([len(s) for s in sketches])
    for w in np.unique(width):
        # Sets of a sketch of twice the width are looked at too, with the halves folded.
        own = np.flatnonzero((width == w) | (width == 2 * w))
        own = own[np.argsort(sizes[own], kind="stable")]
        bits = np.zeros((len(own), int(w)), np.uint8)
        for i, x in enumerate(own):
            halves = np.frombuffer(sketches[x], np.uint8).reshape(-1, int(w))
            bits[i] = np.bitwise_xor.reduce(halves, axis=0)
        bits, n = bits.view(np.uint64), sizes[own]
        ends = np.searchsorted(n * 4, n * 5, "right")
        for i in np.flatnonzero(width[own] == w):
            x, others = own[i], slice(i + 1, int(ends[i]))
            differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            found = own[others][9 * differ <= n[others] + n[i]]
            if first_part is not None:
                found = found[(found < first_part) != (x < first_part)]
            for y in found[label[found] != label[x]]:
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    links.append((int(x), int(y)))
    return links


def _near_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every group of sketches."""
    for low, rows in _groups(batches, ["entry", "n", "sketch"]):
        found = near_block(np.array([n for _, _, n, _ in rows], np.int64), [sketch for *_, sketch in rows], low)
        names = np.array([entry for _, entry, _, _ in rows], np.int64)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(names[pairs[:, 0]]), pa.array(names[pairs[:, 1]])], ["a", "b"])


def _sieve_of(df: DataFrame, column: str) -> np.ndarray:
    return build_sieve(df.select(F.col(column).alias("h")))


def frequent_tokens(sets: DataFrame, frequent: int, most: int = MOST_FREQUENT) -> DataFrame:
    """(token, sets) of the tokens in the plain prefixes of more than `frequent` sets, or of more than so many times
    a power of two that `most` tokens are left."""
    places = sets.select(F.explode("prefix").alias("token"))
    often = stage(
        places.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > frequent), "ngram-frequent"
    )
    above = F.floor(F.log2((F.col("sets") - 1) / frequent)).cast("int")
    counts = {r["above"]: r["tokens"] for r in often.groupBy(above.alias("above")).agg(F.count(F.lit(1)).alias("tokens")).collect()}
    doublings = 0
    while sum(n for k, n in counts.items() if k >= doublings) > most:
        doublings += 1
    return often.where(F.col("sets") > frequent << doublings)


def index_of(keyed: DataFrame, sets: DataFrame, shingle: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """(key, is_rare, entry, n, last, length, sets) of the keys that several sets have; entry numbers the sets.
    (entry, digest) of all sets."""
    sieve = _sieve_of(frequent_tokens(sets, frequent), "token")
    touched = sets.select("row_key", "n", "prefix").mapInArrow(partial(_with_frequent, sieve=sieve), "row_key long")
    rows = _sieve_of(touched, "row_key")
    longer = keyed.mapInArrow(partial(_longer_prefixes, shingle=shingle, rows=rows, sieve=sieve), ENTRY)
    plain = sets.select("digest", "n", "prefix").mapInArrow(partial(_plain_prefixes, sieve=sieve), ENTRY)
    # A row that repeats a document repeats its entry.
    entries = plain.unionByName(longer.dropDuplicates(["digest"]))
    entries = stage(entries.withColumn("entry", F.monotonically_increasing_id()), "ngram-entries")
    # Only key and number of the entry, its lowest bit for the kind of key, are sorted; most keys are those of one set.
    number = F.col("entry") * 2
    places = entries.select(F.explode("rare").alias("key"), (number + 1).alias("at")).unionByName(
        entries.select(F.explode("pairs").alias("key"), number.alias("at"))
    )
    counted = places.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("sets > 1")
    shared = stage(counted, "ngram-keys")
    about = entries.select("entry", "n", "last", F.size("rare").cast("long").alias("length"))
    with_kind = shared.select(
        "key", (F.col("at") % 2 == 1).alias("is_rare"), F.floor(F.col("at") / 2).alias("entry"), "sets"
    )
    index = stage(with_kind.join(about, "entry"), "ngram-index")
    numbers = stage(entries.select("entry", "digest"), "ngram-numbers")
    release(entries, shared)
    return index, numbers


def in_blocks(rows: DataFrame, name: str, held: str, block_sets: int, block_held: int | None = None) -> DataFrame:
    """Rows (cluster, low, high, part, name, held) group by group (cluster, low, high): of every two blocks of a
    cluster, and of each alone. `held` is an array or binary, of which a block has about `block_held` in all."""
    group = ["cluster", "low", "high"]
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size(held) if block_held else F.lit(0)).alias("all"))
    parts = F.ceil(F.greatest(F.col("sets") / block_sets, F.col("all") / (block_held or 1))).cast("int")
    dealt = rows.join(sizes.select("cluster", parts.alias("parts")), "cluster").withColumn(
        "part", F.pmod(F.xxhash64(name), F.col("parts")).cast("int")
    )
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cluster",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        "part",
        *[c for c in rows.columns if c != "cluster"],
    )
    return pairs.repartition(*group).sortWithinPartitions(*group)


def pairs_of_few(index: DataFrame, frequent: int) -> DataFrame:
    """(a, b), entries: pairs under keys of at most `frequent` sets that may be similar.

    Their own keys are counted; of keys of more sets, a pair may share all.
    """
    of_many = (
        index.where((F.col("sets") > frequent) & F.col("is_rare")).groupBy("entry").agg(F.count(F.lit(1)).alias("more"))
    )
    few = index.where(F.col("sets") <= frequent).drop("sets")
    other = few.select("key", *[F.col(c).alias(f"b_{c}") for c in ("entry", "n", "last", "length")])
    near = (F.col("n") * 5 >= F.col("b_n") * 4) & (F.col("b_n") * 5 >= F.col("n") * 4)
    common = F.ceil((F.col("n") + F.col("b_n")) * 4 / 9)
    first = F.col("last") <= F.col("b_last")
    length = F.when(first, F.col("length")).otherwise(F.col("b_length"))
    may_miss = F.when(first, F.col("n")).otherwise(F.col("b_n")) - common
    counted = (
        few.join(other, "key")
        .where((F.col("entry") < F.col("b_entry")) & near)
        .groupBy("entry", F.col("b_entry").alias("b"), (length - may_miss).alias("wanted"))
        .agg(F.sum(F.col("is_rare").cast("int")).alias("shared"))
        .join(of_many, "entry", "left")
    )
    return counted.where(F.col("shared") + F.coalesce("more", F.lit(0)) >= F.col("wanted")).select(
        F.col("entry").alias("a"), "b"
    )


def candidates_of(index: DataFrame, sketches: DataFrame, frequent: int, block_sets: int) -> DataFrame:
    """(a, b), entries: pairs that may be similar by their sketches (entry, n, sketch), or some that connect what
    such pairs connect."""
    few = pairs_of_few(index, frequent)
    for side in ("a", "b"):
        of_side = sketches.select(
            F.col("entry").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")
        )
        few = few.join(of_side, side)
    few = stage(few.mapInArrow(_near_pairs, "a long, b long"), "ngram-few")
    many = index.where(F.col("sets") > frequent)
    ties = many.join(many.groupBy("key").agg(F.min("entry").alias("b")), "key").where("entry != b")
    tied = components(ties.select(F.col("entry").alias("a"), "b"))
    # Sets that can be similar share a level; so the blocks of a large group needn't all meet.
    level = F.size(F.filter(F.array(*map(F.lit, LEVELS)), lambda least: least <= F.col("n")))
    tied = tied.select(F.col("node").alias("entry"), "label").join(sketches, "entry")
    tied = tied.withColumn("level", F.explode(F.array(level, level + 1)))
    tied = tied.select(F.struct("label", "level").alias("cluster"), "entry", "n", "sketch")
    blocks = in_blocks(tied, "entry", "sketch", SKETCHES * block_sets)
    return few.unionByName(blocks.mapInArrow(_near_groups, "a long, b long"))


def links_of(keyed: DataFrame, clusters: DataFrame, shingle: int, block_sets: int, block_tokens: int) -> DataFrame:
    """Links (a, b) between the digests of `clusters` (digest, row_key, cluster)."""
    rows = _sieve_of(clusters, "row_key")
    found = keyed.mapInArrow(partial(_all_tokens, shingle=shingle, rows=rows), "digest binary, tokens array<long>")
    tokens = stage(
        # Rows that repeat a document give its tokens again.
        found.join(clusters.select("digest", "cluster"), "digest")
        .groupBy("digest", "cluster")
        .agg(F.first("tokens").alias("tokens")),
        "ngram-tokens",
    )
    blocks = in_blocks(tokens, "digest", "tokens", block_sets, block_tokens)
    return blocks.mapInArrow(_link_groups, "a binary, b binary")


def join(
    docs: DataFrame,
    shingle: int = SHINGLE,
    frequent: int = FREQUENT,
    block_sets: int = BLOCK_SETS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two documents link when their sets have a Jaccard similarity of 0.8 or more; component_id is the smallest
    doc_id reachable over links, a document's own included. Null, empty and blank texts have no set
    and link with nothing. Rows with a null doc_id link others but give no component_id. Rows that repeat
    a doc_id are documents of their own, repeated rows give repeated rows. Other columns are left out; an
    empty table gives an empty result.

    Equal sets meet as one before any search, known by a digest of 128 bits; a token is a hash of 64. Texts are read
    three times: for the prefixes, for longer prefixes of those that need them, and for all tokens of the sets
    in clusters.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    read = stage(
        keyed.mapInArrow(
            partial(_sets, shingle=shingle),
            f"doc_id {id_type}, row_key long, n long, digest binary, prefix array<long>, sketch binary",
        ),
        "ngram-read",
    )
    rows = stage(read.select("doc_id", "n", "digest"), "ngram-rows")
    sets = stage(
        read.where("n > 0")
        .groupBy("digest", "n")
        .agg(F.min("row_key").alias("row_key"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")),
        "ngram-sets",
    )
    release(read)
    index, numbers = index_of(keyed, sets, shingle, frequent)
    names = stage(sets.drop("prefix").join(numbers, "digest"), "ngram-names")
    release(sets, numbers)
    reached = components(candidates_of(index, names.select("entry", "n", "sketch"), frequent, block_sets))
    candidates = reached.select(F.col("node").alias("entry"), F.col("label").alias("cluster"))
    clusters = stage(candidates.join(names, "entry").select("digest", "row_key", "cluster"), "ngram-clusters")
    release(index, names)
    reached = components(links_of(keyed, clusters, shingle, block_sets, block_tokens))
    ids = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    labelled = ids.join(reached.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", "first_id", F.coalesce("label", "digest").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_set = labelled.join(smallest, "label").select("digest", "component_id")
    n_shingles = F.col("n").alias("n_shingles")
    return (
        rows.where("n > 0")
        .join(of_set, "digest")
        .select("doc_id", n_shingles, "component_id")
        .unionByName(rows.where("n = 0").select("doc_id", n_shingles, F.col("doc_id").alias("component_id")))
    )
