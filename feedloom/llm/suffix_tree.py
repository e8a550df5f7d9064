"""Language-model scores from a probabilistic suffix tree.

The symbols are the bytes of a text's tokens, joined by one space, and an end. Contexts of up
to five symbols are counted over all training texts. A context stays in the tree when
the symbols that follow it differ from those that follow its longest proper suffix by more
than chance explains (a divergence test). Its distribution is smoothed with its suffix's.
A symbol is scored in the state of the longest retained suffix of what stands before it.

Every context that passes the test stays, so the tree is a table that grows with the corpus. A
window (a context of five symbols and the symbol behind it) gets its smoothed share by one join a
level. Texts are scored by their windows: tasks look the most frequent ones up in a table of fixed
size, and the others are counted for each text and joined.

A unigram model over tokens, with half a count for each token, is the base score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import remainder, stage

# Codes: 0 ends a text (and stands before its first symbol), 1 to 62 are the most frequent
# bytes, 63 any other byte.
CODE_BITS = 6
CODES = 1 << CODE_BITS
OTHER = CODES - 1
DEPTH = 5
WINDOW_BITS = (DEPTH + 1) * CODE_BITS
# Contexts up to this depth are so few (64 + 64^2) that their followers are sent to every task.
SENT_DEPTH = 2
# The weight of the shorter context, in counts.
SMOOTHING = 4.0
# A context stays when its divergence beats chance by this many standard deviations.
DEVIATIONS = 4.0
# Most frequent tokens that every task looks up by itself; others are joined.
HEAD = 100_000
# Most frequent windows that every task looks up by itself, in a table of twice as many slots (24 MB
# at most); others are joined.
HEAD_WINDOWS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
FOLDS, HELD_OUT = 5, 1
HALF = 0.5
# What a counting task holds before it sends it on.
HELD_TOKENS = 400_000
SYMBOLS_AT_ONCE = 4_000_000
HELD_WINDOWS = 2_500_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def _symbols(tokens: list[bytes]) -> bytes:
    return b" ".join(tokens)


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(256, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            symbols = np.frombuffer(_symbols(tokens_of(text)), np.uint8)
            counts += np.bincount(symbols, minlength=256)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["byte", "n"])


def alphabet_of(counts: np.ndarray) -> np.ndarray:
    """Code of each byte, by frequency; equal counts by byte."""
    order = sorted(range(256), key=lambda b: (-counts[b], b))
    codes = np.full(256, OTHER, np.int64)
    codes[order[: OTHER - 1]] = np.arange(1, OTHER)
    return codes


def windows_of(codes: np.ndarray) -> np.ndarray:
    """Each place's last DEPTH + 1 codes as one number, its own code lowest."""
    keys = np.zeros(len(codes), np.int64)
    for back in range(DEPTH, -1, -1):
        keys = (keys << CODE_BITS) | np.concatenate([np.zeros(min(back, len(codes)), np.int64), codes[: max(0, len(codes) - back)]])
    return keys


def _coded(tokens: list[bytes], alphabet: np.ndarray) -> np.ndarray:
    symbols = np.frombuffer(_symbols(tokens), np.uint8)
    return np.append(alphabet[symbols], 0)


def _count_units(batches: Iterator[pa.RecordBatch], alphabet: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, window, n, uses): counts of tokens, of windows of symbols, and of ends (both null).

    `n` counts training texts; `uses` counts held-out texts, too, of which only windows are counted.
    """
    tokens: Counter = Counter()
    fresh: list[np.ndarray] = []
    counted = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    size = texts = 0

    def token_rows() -> pa.RecordBatch:
        words = pa.array([t.decode() for t in tokens], pa.string())
        counts = pa.array(tokens.values(), pa.int64())
        return _unit_batch(words, pa.nulls(len(tokens), pa.int64()), counts, counts)

    def window_rows() -> pa.RecordBatch:
        # Windows of held-out texts have one bit more.
        keys, uses = counted
        n = np.where(keys >> WINDOW_BITS, 0, uses)
        windows = keys & ((1 << WINDOW_BITS) - 1)
        return _unit_batch(pa.nulls(len(keys), pa.string()), *map(pa.array, (windows, n, uses)))

    for batch in batches:
        held_out = batch.column("held_out").to_pylist()
        for text, held in zip(batch.column("text").to_pylist(), held_out):
            words = tokens_of(text)
            fresh.append(windows_of(_coded(words, alphabet)) | (held << WINDOW_BITS))
            size += len(fresh[-1])
            if not held:
                tokens.update(words)
                texts += 1
            if len(tokens) > HELD_TOKENS:
                yield token_rows()
                tokens.clear()
            if size > SYMBOLS_AT_ONCE:
                counted, fresh, size = _merged(counted, fresh), [], 0
                if len(counted[0]) > HELD_WINDOWS:
                    yield window_rows()
                    counted = (counted[0][:0], counted[1][:0])
    if tokens:
        yield token_rows()
    counted = _merged(counted, fresh)
    if len(counted[0]):
        yield window_rows()
    if texts:
        ends = pa.array([texts])
        yield _unit_batch(pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), ends, ends)


def _merged(
    counted: tuple[np.ndarray, np.ndarray], fresh: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Adds the windows in `fresh` to (windows, counts)."""
    if not fresh:
        return counted
    keys, counts = np.unique(np.concatenate(fresh), return_counts=True)
    both = np.concatenate([counted[0], keys])
    weights = np.concatenate([counted[1], counts])
    order = np.argsort(both, kind="stable")
    both, weights = both[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[starts], np.add.reduceat(weights, starts)


def _unit_batch(tokens: pa.Array, windows: pa.Array, counts: pa.Array, uses: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [tokens, *(x.cast(pa.int64()) for x in (windows, counts, uses))], ["token", "window", "n", "uses"]
    )


def retained(windows: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """Follower counts (depth, context, symbol, n) of the contexts that stay in the tree.

    `windows` has window and n. The root always stays. The test statistic 2 * sum n * ln(p / q), p and
    q being the followers' shares after the context and after its suffix, is compared with its mean
    and standard deviation under no difference. Every context that passes stays.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("depth") + 1) * CODE_BITS)
    counts = stage(
        windows.select("window", "n", levels)
        .groupBy("depth", F.col("window").bitwiseAND(size - 1).alias("path"))
        .agg(F.sum("n").alias("n"))
        .select(
            "depth",
            F.shiftright("path", CODE_BITS).alias("context"),
            F.col("path").bitwiseAND(CODES - 1).alias("symbol"),
            "n",
        ),
        "suffix-counts",
    )
    totals = counts.groupBy("depth", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    shares = counts.join(totals, ["depth", "context"]).withColumn("share", F.col("n") / F.col("total"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("depth") - 1) * CODE_BITS) - 1
    longer = shares.where("depth > 0").withColumns(
        {"up": F.col("depth") - 1, "suffix": F.col("context").bitwiseAND(mask)}
    )
    shorter = shares.select(
        F.col("depth").alias("up"), F.col("context").alias("suffix"), "symbol", F.col("share").alias("before")
    )
    surprise = 2 * F.sum(F.col("n") * F.ln(F.col("share") / F.col("before")))
    freedom = F.greatest(F.col("kinds") - 1, F.lit(1))
    kept = (
        longer.join(shorter, ["up", "suffix", "symbol"])
        .groupBy("depth", "context", "kinds")
        .agg(surprise.alias("divergence"))
        .where(F.col("divergence") > freedom + deviations * F.sqrt(2 * freedom))
        .select("depth", "context")
    )
    root = counts.where("depth = 0")
    return root.unionByName(counts.join(kept, ["depth", "context"]))


def byte_logs_of(byte_counts: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """What a byte outside the alphabet costs besides: its share among such bytes."""
    rare = alphabet == OTHER
    share = (byte_counts + HALF) / (byte_counts[rare].sum() + HALF * max(1, rare.sum()))
    return np.where(rare, np.log10(share), 0.0)


def _rare_bytes(tokens: list[bytes], codes: np.ndarray, byte_logs: np.ndarray) -> float:
    if not (codes == OTHER).any():
        return 0.0
    return float(byte_logs[np.frombuffer(_symbols(tokens), np.uint8)].sum())


def window_logs(windows: DataFrame, followers: DataFrame) -> DataFrame:
    """Adds `log`, the log10 share of the window's last symbol in the state of the longest retained
    suffix of what stands before it, to `windows` (window and any other columns).

    `followers`: what `retained` returns. A state's share is smoothed with the state of its longest
    retained proper suffix, so one join a level, from the root down, finds a window's share.
    """
    states = followers.groupBy("depth", "context").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("after")
    )
    states = stage(states, "suffix-states")
    symbol = F.col("window").bitwiseAND(CODES - 1)
    seen = F.coalesce(F.try_element_at("after", symbol), F.lit(0))
    out = windows.withColumn("share", F.lit(1 / CODES))
    for depth in range(DEPTH + 1):
        # The root is smoothed with half a count for each symbol.
        weight = SMOOTHING if depth else HALF * CODES
        level = states.where(F.col("depth") == depth).select("context", "total", "after")
        context = F.shiftright("window", CODE_BITS).bitwiseAND((1 << CODE_BITS * depth) - 1)
        smoothed = (seen + weight * F.col("share")) / (F.col("total") + weight)
        out = (
            out.withColumn("context", context)
            .join(F.broadcast(level) if depth <= SENT_DEPTH else level, "context", "left")
            .withColumn("share", F.when(F.col("total").isNull(), F.col("share")).otherwise(smoothed))
            .drop("context", "total", "after")
        )
    return out.withColumn("log", F.log10("share")).drop("share")


class Head:
    """Logs of the most frequent windows, by open addressing in arrays of fixed size."""

    def __init__(self, windows: np.ndarray, logs: np.ndarray) -> None:
        self.bits = max(4, (2 * len(windows) - 1).bit_length()) if len(windows) else 4
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.logs = np.zeros(1 << self.bits, np.float32)
        left, at = np.arange(len(windows)), self._first(windows)
        while len(left):
            # Of windows that want one free slot, the last one written has it.
            free = self.keys[at] == -1
            self.keys[at[free]] = windows[left[free]]
            own = self.keys[at] == windows[left]
            self.logs[at[own]] = logs[left[own]]
            left, at = left[~own], (at[~own] + 1) & (len(self.keys) - 1)

    def _first(self, windows: np.ndarray) -> np.ndarray:
        return ((windows.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, windows: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the logs of the windows that it holds, and the others."""
        total, others, at = 0.0, [], self._first(windows)
        while len(windows):
            held = self.keys[at]
            hit = held == windows
            total += float(self.logs[at[hit]].sum(dtype=np.float64))
            free = held == -1
            if free.any():
                others.append(windows[free])
            on = ~(hit | free)
            windows, at = windows[on], (at[on] + 1) & (len(self.keys) - 1)
        return total, np.concatenate(others) if others else windows


def head_of(logs: DataFrame, most: int) -> Head:
    """The windows used so often that no more than `most` are used as often or more."""
    steps = F.floor(8 * F.log2(F.col("uses"))).cast("int")
    rows = logs.groupBy(steps.alias("step")).agg(F.count(F.lit(1)).alias("windows")).orderBy(F.desc("step")).collect()
    taken, least = 0, None
    for row in rows:
        taken += row["windows"]
        if taken > most:
            break
        least = row["step"]
    if least is None:
        return Head(np.zeros(0, np.int64), np.zeros(0))
    held = logs.where(steps >= least).select("window", "log").toArrow()
    return Head(*(c.to_numpy() for c in held.columns))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """What the head's tokens and windows add to the scores, and the other tokens and windows."""
    head, end_log, windows, alphabet, byte_logs = model.value
    for batch in batches:
        n_tokens, known, base, score, rest, tail, times = [], [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            tokens = tokens_of(text)
            logs = [head.get(t) for t in tokens]
            others = [t.decode() for t, log in zip(tokens, logs) if log is None]
            n_tokens.append(len(tokens) + 1)
            known.append(len(tokens) - len(others))
            base.append(math.fsum(log for log in logs if log is not None) + end_log)
            codes = _coded(tokens, alphabet)
            total, unknown = windows.look_up(windows_of(codes))
            score.append(total + _rare_bytes(tokens, codes, byte_logs))
            rest.append(others)
            for out, values in zip((tail, times), np.unique(unknown, return_counts=True)):
                out.append(values)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(n_tokens, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(score, pa.float64()),
                pa.array(rest, pa.list_(pa.string())),
                pa.array(tail, pa.list_(pa.int64())),
                pa.array(times, pa.list_(pa.int64())),
            ],
            ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest", "windows", "times"],
        )


def score_documents(docs: DataFrame, head_tokens: int = HEAD, head_windows: int = HEAD_WINDOWS) -> DataFrame:
    """Log10 probabilities of every whole text under both models.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1 and returns for each row: doc_id, held_out
    (the remainder is 1), n_tokens (with the end), n_known (tokens seen in training, the
    end included), train_tokens, base_score, score. Null texts count as empty: only the end is scored.
    A null doc_id counts as the empty text. Repeated rows give repeated rows, and train as often. Without
    any training row all tokens are unknown and the tree is its smoothed root. Other columns
    are left out; an empty table gives an empty result.

    Counts are gathered over all training texts. Tasks count tokens and windows of symbols before
    they send them. Scoring looks up frequent tokens and windows in tables of fixed size; the rest,
    which grows with the corpus, is joined by token and by window.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", "text", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    )
    training = rows.where("NOT held_out").select("text")
    byte_counts = np.zeros(256, np.int64)
    for row in (
        training.mapInArrow(_count_bytes, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    ):
        byte_counts[row["byte"]] = row["n"]
    alphabet = alphabet_of(byte_counts)
    units = stage(
        rows.select("text", "held_out")
        .mapInArrow(partial(_count_units, alphabet=alphabet), "token string, window long, n long, uses long")
        .groupBy("token", "window")
        .agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")),
        "lm-counts",
    )
    vocabulary = units.where("token IS NOT NULL").select("token", "n")
    sums = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = units.where("token IS NULL AND window IS NULL").agg(F.sum("n")).first()[0] or 0
    total = (sums[0] or 0) + ends
    kinds = sums[1] + (ends > 0)
    scale = math.log10(total + HALF * (kinds + 1))

    head_rows = vocabulary.orderBy(F.desc("n"), "token").limit(head_tokens).collect()
    head = {r["token"].encode(): math.log10(r["n"] + HALF) - scale for r in head_rows}
    least = head_rows[-1]["n"] if len(head_rows) == head_tokens else 0
    windows = units.where("window IS NOT NULL")
    followers = retained(windows.where("n > 0").select("window", "n"))
    logs = stage(window_logs(windows.select("window", "uses"), followers), "window-logs")
    end_log = math.log10(ends + HALF) - scale
    byte_logs = byte_logs_of(byte_counts, alphabet)
    model = docs.sparkSession.sparkContext.broadcast(
        (head, end_log, head_of(logs, head_windows), alphabet, byte_logs)
    )
    scored = stage(
        rows.mapInArrow(
            partial(_score, model=model),
            f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, "
            "score double, rest array<string>, windows array<long>, times array<long>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "lm-scores",
    )
    # Tokens outside the head are no more frequent than its last one.
    tail = vocabulary.where(F.col("n") <= least) if least else vocabulary.limit(0)
    seen = (
        scored.select("row", F.explode("rest").alias("token"))
        .groupBy("row", "token")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(tail, "token", "left")
    )
    log = F.log10(F.coalesce("n", F.lit(0)) + HALF) - scale
    rest = seen.groupBy("row").agg(
        F.sum(F.col("times") * log).alias("rest_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"),
    )
    # A window that the head doesn't hold is used less often than those that it holds.
    others = (
        scored.select("row", F.explode(F.arrays_zip("windows", "times")).alias("w"))
        .select("row", F.col("w.windows").alias("window"), F.col("w.times").alias("times"))
        .join(logs.select("window", "log"), "window")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("log")).alias("other_log"))
    )
    return scored.drop("rest", "windows", "times").join(rest, "row", "left").join(others, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_log", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("other_log", F.lit(0.0))).alias("score"),
    )
