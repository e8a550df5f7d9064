"""SentencePiece encoding as a shortest path through weighted transducers.

Three machines are compiled from a model file. The normaliser rewrites blanks to the mark
U+2581 and puts one in front. The pieces are arcs from a run of characters to an id. Byte
fallback is an arc from a character without a piece to the ids of its bytes. A text's
composition with them is a lattice over its characters; the encoding is the lattice's
path of least weight, in the semiring whose sum is min and whose product is +.

For a unigram model an arc weighs minus the piece's score. For a BPE model an arc weighs zero
after an arc that it may follow and infinity otherwise: two pieces may follow each other
if merging their joined text by score gives back just these two. Merges in separate
places don't touch each other, so a path of such pairs is what merging the whole text
gives, and there is exactly one; one arc per place is enough to remember.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache, partial
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Kinds of pieces, types of models and field numbers of the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
# Words and pairs of pieces that a task remembers.
REMEMBERED = 500_000
# Longer words are rare, and would fill the memory.
LONG_WORD = 48
WORDS_AT_ONCE = 20_000
# Texts of about this many bytes are encoded together, and so many ids decoded.
CHARS_AT_ONCE = 2_000_000
IDS_AT_ONCE = 500_000
RADIX = 0x9E3779B97F4A7C15
PAIR_SLOTS = 1 << 21
PAIR_MIX = 0x9E3779B1
# What an unknown piece weighs beyond the worst score.
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Transducer:
    """A compiled model: encodes and decodes single texts."""

    def __init__(self, model: bytes) -> None:
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(model):
            if field == PIECES:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
                pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have pieces with scores")
        if normalizer.get(2):
            raise ValueError("models with a character map in the normaliser are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.trims = bool(normalizer.get(4, 1))
        if not normalizer.get(5, 1):
            raise ValueError("models that leave blanks as they are are not supported")
        self.pieces = pieces
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.arcs = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        byte_ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = [byte_ids.get(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = None not in self.byte_ids
        self.longest = max(map(len, self.arcs), default=1)
        self.score = [p[1] for p in pieces]
        self.worst = min((self.score[i] for i in self.arcs.values()), default=0.0)
        # Where no piece holds a mark after another character, words are encoded alone.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.arcs)
        # Neither does a piece join an ASCII character that occurs in no longer piece.
        joined = {c for p in self.arcs if len(p) > 1 for c in p}
        cuts = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined)
        rest = f"[^{MARK}{cuts}]"
        self.words = re.compile(f"{MARK}+{rest}*|{rest}+" + (f"|[{cuts}]" if cuts else ""))
        # What decoding writes for each id. Bytes of longer characters are escaped, to be
        # decoded when they stand together.
        self.written = [self._written(p, kind) for p, _, kind in pieces]
        self.joins = np.array([kind == BYTE and int(p[3:5], 16) > 127 for p, _, kind in pieces])
        self.known: dict[str, bytes] = {}
        if self.kind == BPE:
            self._compile_tables()
        self.may_follow: dict[tuple[str, str], bool] = {}

    @staticmethod
    def _written(piece: str, kind: int) -> str:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)]).decode("utf-8", "surrogateescape")
        return {UNKNOWN: " ⁇ ", CONTROL: ""}.get(kind, piece)

    def normalise(self, text: str) -> str:
        if self.trims:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def _merge(self, symbols: list[str]) -> list[str]:
        """BPE by definition: join the neighbours with the best joint piece, leftmost first."""
        arcs, score = self.arcs, self.score
        joints = [arcs.get(a + b, -1) for a, b in zip(symbols, symbols[1:])]
        while True:
            best, place = -inf, -1
            for i, piece in enumerate(joints):
                if piece >= 0 and score[piece] > best:
                    best, place = score[piece], i
            if place < 0:
                return symbols
            symbols[place : place + 2] = [symbols[place] + symbols[place + 1]]
            del joints[place]
            if place:
                joints[place - 1] = arcs.get(symbols[place - 1] + symbols[place], -1)
            if place < len(joints):
                joints[place] = arcs.get(symbols[place] + symbols[place + 1], -1)

    def _weight(self, left: str, right: str) -> bool:
        """Whether `right` may follow `left` in a BPE path; `left` is empty at the start."""
        pair = (left, right)
        fits = self.may_follow.get(pair)
        if fits is None:
            if len(self.may_follow) >= REMEMBERED:
                self.may_follow.clear()
            merged = self._merge(list(left + right))
            fits = self.may_follow[pair] = merged == ([left, right] if left else [right])
        return fits

    def _last_arc(self, text: str, end: int, last: list[str]) -> str:
        """The last arc of the one BPE path over text[:end], given those of shorter beginnings.

        Every beginning of a text has a path, and only one, so the first arc that fits will do.
        """
        arcs, follow = self.arcs, self.may_follow
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            piece = text[start:end]
            if piece not in arcs and end - start > 1:
                continue
            before = last[start]
            fits = follow.get((before, piece))
            if fits or (fits is None and self._weight(before, piece)):
                return piece
        raise AssertionError("a text without a path")

    def shortest_path(self, text: str) -> list[str]:
        """The least weighted path of arcs over `text`."""
        last = [""]
        if self.kind == BPE:
            for end in range(1, len(text) + 1):
                last.append(self._last_arc(text, end, last))
        else:
            weights = [0.0]
            for end in range(1, len(text) + 1):
                best, arc = inf, ""
                for start in range(max(0, end - self.longest), end):
                    piece = text[start:end]
                    known_id = self.arcs.get(piece)
                    if known_id is not None:
                        weight = weights[start] - self.score[known_id]
                    elif end - start == 1:
                        weight = weights[start] + UNKNOWN_PENALTY - self.worst
                    else:
                        continue
                    if weight < best:
                        best, arc = weight, piece
                weights.append(best)
                last.append(arc)
        path, end = [], len(text)
        while end:
            path.append(last[end])
            end -= len(last[end])
        return path[::-1]

    def _ids(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.shortest_path(text):
            known = self.arcs.get(piece)
            if known is not None:
                out.append(known)
            elif self.fallback:
                out.extend(self.byte_ids[b] for b in piece.encode())
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return tuple(out)

    def _compile_tables(self) -> None:
        """Pieces by hash, and a table of pairs that were tried, for `_paths`."""
        self.powers = np.array([pow(RADIX, n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        hashes: dict[int, int] = {}
        for piece, piece_id in self.arcs.items():
            value = 0
            for c in piece:
                value = (value * RADIX + ord(c) + 1) & ((1 << 64) - 1)
            if hashes.setdefault(value, piece_id) != piece_id:
                raise ValueError("two pieces share a hash")
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.hashed_ids = np.array([hashes[h] for h in sorted(hashes)], np.int64)
        self.tried = np.full(PAIR_SLOTS, -1, np.int64)
        self.fitted = np.zeros(PAIR_SLOTS, bool)

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`_weight` for pairs of ids; `left` is len(pieces) at the start of a word."""
        pairs = left * (len(self.pieces) + 1) + right
        slots = (pairs * PAIR_MIX) % PAIR_SLOTS
        missing = np.unique(pairs[self.tried[slots] != pairs])
        for pair in missing.tolist():
            before, after = divmod(pair, len(self.pieces) + 1)
            first = self.pieces[before][0] if before < len(self.pieces) else ""
            slot = (pair * PAIR_MIX) % PAIR_SLOTS
            self.tried[slot], self.fitted[slot] = pair, self._weight(first, self.pieces[after][0])
        fits = self.fitted[slots]
        # Two pairs of one call may share a slot, which then holds the later one.
        for i in np.flatnonzero(self.tried[slots] != pairs).tolist():
            before, after = divmod(int(pairs[i]), len(self.pieces) + 1)
            first = self.pieces[before][0] if before < len(self.pieces) else ""
            fits[i] = self._weight(first, self.pieces[after][0])
        return fits

    def _paths(self, words: list[str]) -> list[tuple[int, ...]]:
        return [tuple(np.frombuffer(ids, np.int32).tolist()) for ids in self._packed_paths(words)]

    def _packed_paths(self, words: list[str]) -> list[bytes]:
        """`_ids` of many short words at once, for BPE: all lattices grow by one place together.

        A word's ids come as the bytes of an int32 array.
        """
        words_at = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])))
        ordered = [words[i] for i in words_at]
        sizes = np.array([len(w) for w in ordered])
        width = int(sizes[0])
        codes = np.frombuffer("".join(w.ljust(width, "\0") for w in ordered).encode("utf-32-le"), np.uint32)
        codes = codes.reshape(len(ordered), width).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((width + 1, len(ordered)), np.uint64)
        last = np.full((width + 1, len(ordered)), len(self.pieces), np.int64)
        step = np.zeros((width + 1, len(ordered)), np.int64)
        lost = np.zeros(len(ordered), bool)
        for end in range(1, width + 1):
            prefix[end] = prefix[end - 1] * np.uint64(RADIX) + codes[:, end - 1]
            rows = np.flatnonzero((sizes >= end) & ~lost)
            for n in range(1, min(end, self.longest) + 1):
                value = prefix[end, rows] - prefix[end - n, rows] * self.powers[n]
                at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
                known = np.flatnonzero(self.hashes[at] == value)
                if n == 1 and len(known) < len(rows):
                    # A character without a piece: its word goes the slow way.
                    lost[np.delete(rows, known)] = True
                right = self.hashed_ids[at[known]]
                found = rows[known]
                fits = self._fits(last[end - n, found], right)
                last[end, found[fits]] = right[fits]
                step[end, found[fits]] = n
                rest = np.ones(len(rows), bool)
                rest[known[fits]] = False
                rows = rows[rest & ~lost[rows]]
                if not len(rows):
                    break
            lost[rows] = True
        place, path, every = sizes.copy(), [], np.arange(len(ordered))
        while place.any():
            path.append(np.where(place > 0, last[place, every], -1))
            place = place - np.where(place > 0, step[place, every], 0)
            place[lost] = 0
        out = [b""] * len(words)
        table = np.ascontiguousarray(np.array(path[::-1], np.int32).T)
        for i, word, gone, ids in zip(words_at.tolist(), ordered, lost.tolist(), table):
            out[i] = self._packed(word) if gone else ids[ids >= 0].tobytes()
        return out

    def _packed(self, word: str) -> bytes:
        return np.array(self._ids(word), np.int32).tobytes()

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as int32 arrays."""
        normal = [self.normalise(text) for text in texts]
        if not self.by_word:
            return [np.array(self._ids(text), np.int32) for text in normal]
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        split = [self.words.findall(text) for text in normal]
        new = {word for words in split for word in words if word not in known}
        short = [word for word in new if len(word) <= LONG_WORD] if self.kind == BPE else []
        for start in range(0, len(short), WORDS_AT_ONCE):
            part = short[start : start + WORDS_AT_ONCE]
            known.update(zip(part, self._packed_paths(part)))
        long = [word for word in new if word not in known]
        known.update((word, self._packed(word)) for word in long)
        encoded = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]
        for word in long:
            if len(word) > LONG_WORD:
                del known[word]
        return encoded

    def decode(self, ids: np.ndarray) -> str:
        """The inverse transducer: pieces' characters, marks as blanks, runs of byte ids as text."""
        if not len(ids):
            return ""
        text = "".join(map(self.written.__getitem__, ids.tolist())).replace(MARK, " ")
        if self.joins[ids].any():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)



def _pass_on(batch: pa.RecordBatch, name: str, dropped: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != dropped]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, name])


def _portions(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` in order, in parts of about `limit` in size; a larger row is a part."""
    start = size = 0
    for end, n in enumerate(sizes.fill_null(0).to_pylist(), 1):
        size += n
        if size >= limit or end == batch.num_rows:
            yield batch.slice(start, end - start)
            start, size = end, 0


def _encode(batches: Iterator[pa.RecordBatch], model, column: str) -> Iterator[pa.RecordBatch]:
    transducer = compiled(model.value)
    for batch in batches:
        for part in _portions(batch, pc.binary_length(batch.column(column)), CHARS_AT_ONCE):
            texts = part.column(column)
            ids = transducer.encode_all([t or "" for t in texts.to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()), mask=texts.is_null()
            )
            yield _pass_on(part, "ids", column, lists)


def _decode(batches: Iterator[pa.RecordBatch], model, column: str) -> Iterator[pa.RecordBatch]:
    transducer = compiled(model.value)
    for batch in batches:
        for part in _portions(batch, pc.list_value_length(batch.column(column)), IDS_AT_ONCE):
            lists = part.column(column)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            texts = [
                transducer.decode(flat[a:b]) if valid else None
                for a, b, valid in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())
            ]
            yield _pass_on(part, "decoded", column, pa.array(texts, pa.string()))


def _schema(df: DataFrame, dropped: str, added: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != dropped]
    return ", ".join([*kept, added])


def load_model(df: DataFrame, path: str):
    """The model file, sent to every executor once. It has a megabyte or so, whatever the input is."""
    rows = df.sparkSession.read.format("binaryFile").load(path).select("content").collect()
    return df.sparkSession.sparkContext.broadcast(bytes(rows[0]["content"]))


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`df` with column `ids` in place of `text`: the ids of the model at `path`.

    Null texts have null ids, empty texts none. A text of any length is encoded whole.
    Rows stay as they are otherwise; `df` must not have a column `ids` yet.
    """
    if "ids" in df.columns:
        raise ValueError("the input has a column ids already")
    model = load_model(df, path)
    return df.mapInArrow(partial(_encode, model=model, column=text), _schema(df, text, "ids array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`df` with column `decoded` in place of `ids`. Null ids give null.

    Decoding gives back the text that was encoded, where the model has byte fallback and keeps
    blanks, but that U+2581 in a text comes back as a blank.
    """
    if "decoded" in df.columns:
        raise ValueError("the input has a column decoded already")
    model = load_model(df, path)
    return df.mapInArrow(
        partial(_decode, model=model, column=ids), _schema(df, ids, "decoded string")
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids, comma-joined) and decoded_sha256, n_chars of the decoded text.

    Null texts count as empty. Repeated rows give repeated rows; other columns are left out.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = encode(texts, path).withColumns(
        {
            "n_ids": F.size("ids").cast("bigint"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256),
        }
    )
    return decode(encoded, path).select(
        "doc_id",
        "n_ids",
        "ids_sha256",
        F.length("decoded").cast("bigint").alias("n_chars"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
