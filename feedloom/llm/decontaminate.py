"""Benchmark decontamination by winnowing.

A text's words give one hash per run of k words; of every w neighbouring hashes the
smallest (the last of equal ones) is kept. Two texts that share k + w - 1 words in a row
keep the same hash there, so joining kept hashes misses no shared span of that length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import ascii_lower, stage, text_key, without

SPAN = 10
GRAM = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same in the bytes of lower-cased UTF-8.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# A fixed 1 MiB of bits tells tasks which hashes the benchmark may have.
SIEVE_BITS = 1 << 23
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = (out ^ word_hashes[i : i + n]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def kept(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest hash of every w neighbours, the last of equal ones."""
    if len(hashes) == 0:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(len(hashes))
    w = min(w, len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], w)
    first = windows.argmin(axis=1) + np.arange(len(windows))
    return np.unique(len(hashes) - 1 - first)


def plan_of(lengths: list[int], span: int = SPAN, gram: int = GRAM) -> dict[int, int]:
    """k and w that find every item: spans of `span` words, and short items as a whole."""
    plan = {min(gram, span): span - min(gram, span) + 1}
    for n in lengths:
        if 0 < n < span:
            k = min(gram, n)
            plan[k] = min(plan.get(k, n - k + 1), n - k + 1)
    return plan


def _word_hashes(text: str, seen: dict[bytes, int]) -> np.ndarray:
    words = _WORD.findall(text.encode().lower())
    if len(seen) > 500_000:
        seen.clear()
    out = []
    for word in words:
        value = seen.get(word)
        if value is None:
            value = seen[word] = xxhash.xxh64_intdigest(word)
        out.append(value)
    return np.array(out, np.uint64)


def _kept_of(base: np.ndarray, plan: Mapping[int, int], sieve: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes of one text's words that pass the sieve, and their places."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, w in plan.items():
        grams = gram_hashes(base, k)
        if sieve is not None and len(grams):
            at = grams & np.uint64(SIEVE_BITS - 1)
            hit = (sieve[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            if not hit.any():
                continue
            at = kept(grams, w)
            at = at[hit[at] == 1]
        else:
            at = kept(grams, w)
        hashes.append(grams[at])
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


def _fingerprints(
    batches: Iterator[pa.RecordBatch], plan: Mapping[int, int], sieve: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """Input columns but the text, n_words, and the kept hashes that pass the sieve (h) with their places (pos)."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        counts, hashes, places = [], [], []
        for text in batch.column("text"):
            base = _word_hashes(text.as_py() or "", seen)
            h, at = _kept_of(base, plan, sieve)
            counts.append(len(base))
            hashes.append(h)
            places.append(at)
        names = [n for n in batch.schema.names if n != "text"]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hashes], dtype=np.int64)]).astype(np.int32))
        h = pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64))
        pos = pa.array(np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in names),
                pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(offsets, h),
                pa.ListArray.from_arrays(offsets, pos),
            ],
            [*names, "n_words", "h", "pos"],
        )


def fingerprints(
    texts: DataFrame, plan: Mapping[int, int], sieve: np.ndarray | None = None
) -> DataFrame:
    """Per row of `texts` (text and key columns): number of words, kept hashes and their places."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(
        partial(_fingerprints, plan=dict(plan), sieve=sieve), f"{keys}, n_words long, h array<long>, pos array<int>"
    )


def build_sieve(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes' low ends. At most SIEVE_BITS / 64 words reach the driver."""
    low = F.col("h").bitwiseAND(SIEVE_BITS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(63).cast("int"))
    rows = (
        hashes.select(F.shiftright(low, 6).alias("word"), bit.alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    words = np.zeros(SIEVE_BITS // 64, np.int64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return words.view(np.uint8)


def windows_of(words: Column, span: int) -> Column:
    """(start, text) of every run of `span` words; of a shorter, non-empty list, all of it."""
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - span, F.lit(0))))
    return F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda s: F.array_join(F.slice(words, s + 1, span), " "),
    )


def find(docs: DataFrame, items: DataFrame, span: int = SPAN, keyed: bool = False) -> DataFrame:
    """What each document shares with the items.

    Returns doc_id, n_words, n_hit (words inside any occurrence of an item's window), n_items,
    items_sha256 (of the ids of items with occurring windows, sorted as strings, comma-joined),
    contaminated, and text_key if `keyed`. A window is `span` words in a row; a shorter item is one window.

    Null texts have no words; items without words have no windows. Rows that share doc_id
    and text get the same result each. A null item_id counts as the text "null". Other columns
    are left out. Empty tables work: no items, no hits.

    Documents are read twice: once to count words and for fingerprints, of which only those that may be the
    benchmark's leave the task, once to extend hits to whole windows, compared word by word.
    """
    benchmark = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text"
    )
    item_words = benchmark.withColumn("words", words_of(F.col("text")))
    shorts = item_words.where((F.size("words") > 0) & (F.size("words") < span))
    lengths = [r["n"] for r in shorts.select(F.size("words").alias("n")).distinct().collect()]
    plan = plan_of(lengths, span)
    item_prints = stage(fingerprints(benchmark, plan).select(F.explode("h").alias("h")).distinct(), "item-prints")
    windows = stage(
        item_words.select("item", F.explode(windows_of(F.col("words"), span)).alias("window")).distinct(),
        "item-windows",
    )
    rows = docs.select("doc_id", "text").withColumn("text_key", text_key(F.col("text")))
    sieve = build_sieve(item_prints)
    prints = stage(fingerprints(rows, plan, sieve), "doc-prints")
    anchors = (
        prints.select("doc_id", "text_key", F.explode(F.arrays_zip("h", "pos")).alias("at"))
        .select("doc_id", "text_key", "at.h", "at.pos")
        .join(item_prints, "h", "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("pos").alias("anchors"))
    )
    anchors = stage(anchors, "anchors")
    lengths = sorted({span, *lengths})
    marked = (
        rows.join(
            anchors.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}),
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")),
        )
        .withColumn("words", words_of(F.col("text")))
        .select("doc_id", "text_key", "words", "anchors")
    )
    # A window that holds an anchor starts less than `span` words before it.
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                "anchors",
                lambda p: F.sequence(F.greatest(p - (span - 1), F.lit(0)), p),
            )
        )
    )
    spans = F.array(*[F.lit(n) for n in lengths])
    extended = (
        marked.select("doc_id", "text_key", "words", F.explode(starts).alias("start"))
        .select("doc_id", "text_key", "words", "start", F.explode(spans).alias("n"))
        .where(F.col("start") + F.col("n") <= F.size("words"))
        .select(
            "doc_id",
            "text_key",
            "start",
            "n",
            F.expr("array_join(slice(words, start + 1, n), ' ')").alias("window"),
        )
    )
    hits = stage(
        extended.join(windows.select("window").distinct(), "window", "left_semi"), "hits"
    )
    covered = F.array_distinct(
        F.flatten(F.collect_set(F.expr("sequence(start, start + n - 1)")))
    )
    n_hit = hits.groupBy("doc_id", "text_key").agg(F.size(covered).cast("bigint").alias("n_hit"))
    found = (
        hits.select("doc_id", "text_key", "window")
        .distinct()
        .join(windows, "window")
        .select("doc_id", "text_key", "item")
        .distinct()
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    shared = n_hit.alias("a").join(
        found.alias("b"),
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")),
    ).select(
        F.col("a.doc_id").alias("_id"), F.col("a.text_key").alias("_key"), "n_hit", "items"
    )
    none = F.array().cast("array<string>")
    return (
        prints.select("doc_id", "text_key", "n_words")
        .join(
            shared,
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")),
            "left",
        )
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            *["text_key"] * keyed,
        )
    )


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without any hit; `found` is keyed."""
    return without(docs, found.where("contaminated"))
