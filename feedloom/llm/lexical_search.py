"""Ranked lexical search by presence masks.

Documents are cut into terms once; what is kept of each are its length and how often it holds
terms of the items. Of a block of documents, every term has a bitmap of the documents that
hold it. The bitmaps of an item's terms, read across, give each document's mask: which of the
item's terms it holds. Documents of one mask have one highest possible score, the sum of
its terms' largest impacts. Masks are evaluated from the highest bound down, until no mask
that is left can reach the item's k-th best score. Scores are whole numbers throughout.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from feedloom.llm.common import stage

# Maximal runs of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F], in the bytes of lower-cased UTF-8.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TOP = 10
# Items are searched in groups of about so many terms (with repeats), so that what a task gets
# about them is bounded, whatever the table of items holds.
TERMS_AT_ONCE = 100_000
# Cells of the table of impacts, documents by terms, that a task holds at once (8 bytes each).
CELLS = 4_000_000
MOST_DOCS = 8_192
POSTINGS = "doc_id {id}, n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order, only A-Z lower-cased."""
    return TERM.findall((text or "").encode().lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score; all arguments and results are 64-bit integers."""
    m = 100 - 90 + (90 * lengths * n_docs) // n_terms
    return weights * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


def _postings(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Of every document with terms: its length, and the vocabulary's terms in it with their counts."""
    for batch in batches:
        kept, lengths, terms, tfs = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = terms_of(text)
            if not found:
                continue
            counts = Counter(found)
            known = counts.keys() & vocabulary.keys()
            kept.append(i)
            lengths.append(len(found))
            terms.append([vocabulary[t] for t in known])
            tfs.append([counts[t] for t in known])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(kept, pa.int64())),
                pa.array(lengths, pa.int64()),
                pa.array(terms, pa.list_(pa.int32())),
                pa.array(tfs, pa.list_(pa.int32())),
            ],
            ["doc_id", "n", "terms", "tfs"],
        )


def masks(bitmaps: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct masks (one row of bits each) of the documents that hold any of the terms
    whose bitmaps are given (one row a term), and each document's mask number, -1 without any."""
    present = np.unpackbits(bitmaps, axis=1, count=docs)
    rows = np.flatnonzero(present.any(axis=0))
    number = np.full(docs, -1)
    if len(rows) == 0:
        return np.zeros((0, len(bitmaps)), bool), number
    words = -(-len(bitmaps) // 64)
    packed = np.zeros((len(rows), 8 * words), np.uint8)
    packed[:, : -(-len(bitmaps) // 8)] = np.packbits(present[:, rows], axis=0).T
    keys = packed.view(np.uint64 if words == 1 else np.dtype((np.void, 8 * words))).ravel()
    _, first, number[rows] = np.unique(keys, return_index=True, return_inverse=True)
    return present[:, rows[first]].T.astype(bool), number


class _Best:
    """The k best (score, place) of an item so far; places are in the order that breaks ties."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows: list[tuple[int, tuple]] = []

    def least(self) -> int:
        """A score below this can't enter; every document needs one above 0."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, rows: list[tuple[int, tuple]]) -> None:
        self.rows = sorted([*self.rows, *rows], key=lambda r: (-r[0], r[1]))[: self.k]


def search_block(best: _Best, ids: list, table: np.ndarray, bitmaps: np.ndarray) -> int:
    """Puts the documents of a block that belong there into `best`; returns how many masks were evaluated.

    `table` has the impacts of the item's terms, one row a document; `bitmaps` their presence.
    """
    present, number = masks(bitmaps, len(ids))
    if len(present) == 0:
        return 0
    bounds = present @ table.max(axis=0)
    order = np.argsort(-bounds, kind="stable")
    by_mask = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[by_mask], np.arange(len(present) + 1))
    done = 0
    while done < len(order) and bounds[order[done]] >= best.least():
        # Several masks at once, as long as none is below the score to reach.
        group = order[done : done + 32]
        group = group[bounds[group] >= best.least()]
        done += len(group)
        docs = np.concatenate([by_mask[starts[g] : starts[g + 1]] for g in group])
        scores = table[docs].sum(axis=1)
        docs, scores = docs[scores >= best.least()], scores[scores >= best.least()]
        best.add([(int(s), (ids[d] is None, ids[d])) for d, s in zip(docs, scores, strict=True)])
    return done


def _search(
    batches: Iterator[pa.RecordBatch], items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int
) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score): the k best documents of this task for every item."""
    size = max(1, min(MOST_DOCS, CELLS // max(1, len(weights))))
    best = [_Best(k) for _ in items]
    id_type = pa.int64()
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            ids = part.column("doc_id").to_pylist()
            terms, tfs = part.column("terms"), part.column("tfs").flatten().to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
            terms = terms.flatten().to_numpy()
            lengths = part.column("n").to_numpy()[rows]
            table = np.zeros((len(ids), len(weights)), np.int64)
            table[rows, terms] = impacts(weights[terms], tfs, lengths, n_docs, n_terms)
            bits = np.zeros((len(weights), len(ids)), bool)
            bits[terms, rows] = True
            bits = np.packbits(bits, axis=1)
            for found, of_item in zip(best, items, strict=True):
                search_block(found, ids, table[:, of_item], bits[of_item])
    rows = [(i, d, s) for i, b in enumerate(best) for s, (_, d) in b.rows]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], id_type),
            pa.array([r[2] for r in rows], pa.int64()),
        ],
        ["item", "doc_id", "score"],
    )


def _search_group(docs: DataFrame, items: list[Row], id_of_item: DataType, k: int) -> DataFrame:
    item_terms = [list(dict.fromkeys(terms_of(r["text"]))) for r in items]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for ts in item_terms for t in ts))}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    postings = stage(
        docs.select("doc_id", "text").mapInArrow(
            partial(_postings, vocabulary=vocabulary), POSTINGS.format(id=id_type)
        ),
        "postings",
    )
    total = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    weights = np.zeros(len(vocabulary), np.int64)
    # One row a term of this group of items.
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[row["term"]] = weight(n_docs, row["count"])
    numbers = [np.array([vocabulary[t] for t in ts], np.int64) for ts in item_terms]
    found = postings.mapInArrow(
        partial(_search, items=numbers, weights=weights, n_docs=n_docs, n_terms=n_terms, k=k),
        f"item int, doc_id {id_type}, score long",
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = docs.sparkSession.createDataFrame(
        [(i, r["item_id"]) for i, r in enumerate(items)],
        StructType([StructField("item", IntegerType()), StructField("item_id", id_of_item)]),
    )
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (1 first), doc_id, score: the k documents of highest score above 0 for every item.

    Equal scores rank by ascending doc_id, null last. Rows that repeat a doc_id are documents of
    their own, so they may both be ranked; item rows of equal id and text are one item, rows of
    one item_id with different texts are several items, each with its own ranks. Null and empty
    texts have no terms: such documents count nowhere, such items have no rows. Other columns
    are left out. Empty tables give no rows.

    The items are the stated set of queries. They are taken in groups of about TERMS_AT_ONCE terms; a
    group's terms go to every task, and the documents are read once a group.
    """
    chosen = items.select("item_id", "text").where(F.length("text") > 0).distinct()
    # Words are no longer than texts; a term takes two characters at least with what divides it.
    size = chosen.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    groups = max(1, math.ceil(size / 2 / TERMS_AT_ONCE))
    group = F.pmod(F.xxhash64("text"), F.lit(groups))
    out = None
    for g in range(groups):
        rows = chosen.where(group == g).collect()
        found = _search_group(docs, rows, items.schema["item_id"].dataType, k)
        out = found if out is None else out.unionByName(found)
    return out
