"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features are rates within one text: hits of a fixed and of a learned lexicon, how close hits are
to words of the second person, capitals, punctuation, and signs of obfuscation (digits and
signs inside words, stretched letters, spelled-out words). The lexicon is learned from one
part of the labelled sample, the trees from another, the calibration from a third.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from feedloom.llm.common import remainder, stage, text_key

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
# At most this many labelled rows are learned from: those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
# A unit must occur in this many toxic texts of the sample, and be this much likelier there.
LEAST_TEXTS, LEAST_ODDS = 3, 6.0
PREFIXES = (4, 5, 6)
# Tenths of the sample for lexicon and trees; the rest calibrates.
LEXICON_TENTHS, TREE_TENTHS = 4, 4
NEAR = 6
# The share of the uncalibrated probability in the score, which tells ties apart.
TIE_SHARE = 0.02

# Insults in English, German, French and Spanish.
INSULTS = frozenset(
    """
    idiot idiots moron morons stupid dumb fool loser losers scum trash garbage clown pathetic
    worthless disgusting ugly filthy liar coward jerk vermin hate
    dumm idioten trottel abschaum widerlich arschloch versager
    imbécile stupide crétin débile connard abruti
    estúpido idiota imbécil asqueroso inútil
    """.split()
)
SECOND_PERSON = frozenset(
    """
    you your yours yourself youre u ur
    du dich dir dein deine deinen ihr euch euer
    tu te toi ton ta tes vous votre vos
    tú ti usted ustedes vosotros tuyo
    """.split()
)
DISGUISES = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\s.,;:?\"()\[\]{}<>|]+")
STRETCHED = re.compile(r"(.)\1{2,}")
INSIDE = re.compile(r"[^\W\d_][\d@$!*#]+[^\W\d_]")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
SPELLED = re.compile(r"(?:\b\w[ .\-_*]){3,}\w\b")

FEATURES = (
    "words", "insult_rate", "insult_count", "learned_rate", "learned_count", "learned_top",
    "learned_kinds", "disguised_rate", "you_rate", "near_you", "capital_rate", "shouted_rate",
    "sign_rate", "exclaimed_rate", "mixed_rate", "stretched_rate", "spelled_rate",
)


def _plain(token: str) -> str:
    return token.strip("!'*-_").lower()


def words_of(text: str) -> list[str]:
    return [_plain(token) for token in WORD.findall(text)]


def units_of(word: str) -> list[str]:
    """A word and its beginnings, which are marked with a dash."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


class _Mark(NamedTuple):
    """What a token adds to the features of a text."""

    word: str
    insult: bool
    disguised: bool
    learned: float
    you: bool
    mixed: int
    stretched: int
    shouted: int


class Marks(dict):
    """Marks of tokens for one lexicon; None for the most, which add nothing but their number.

    No match of INSIDE, SHOUTED or of a stretched letter goes beyond a token.
    """

    def __init__(self, lexicon: Mapping[str, float]) -> None:
        self.lexicon = lexicon

    def __missing__(self, token: str) -> _Mark | None:
        word = _plain(token)
        insult = word in INSULTS
        shown = STRETCHED.sub(r"\1", word.translate(DISGUISES))
        mark = _Mark(
            word,
            insult,
            not insult and shown != word and (shown in INSULTS or shown in self.lexicon),
            max((self.lexicon.get(u, 0.0) for u in units_of(word)), default=0.0),
            word in SECOND_PERSON,
            len(INSIDE.findall(token)),
            len(STRETCHED.findall(token)),
            len(SHOUTED.findall(token)),
        )
        self[token] = mark if any(mark[1:]) else None
        return self[token]


def features_of(text: str | None, lexicon: Mapping[str, float], marks: Marks | None = None) -> list[float]:
    """One value per name in FEATURES; all rates of an empty text are zero.

    `marks` remembers tokens from text to text.
    """
    text = text or ""
    marks = Marks(lexicon) if marks is None else marks
    if len(marks) > REMEMBERED:
        marks.clear()
    tokens = WORD.findall(text)
    n, chars = max(1, len(tokens)), max(1, len(text))
    hits: list[int] = []
    you: list[int] = []
    found: list[_Mark] = []
    for place, mark in enumerate(map(marks.__getitem__, tokens)):
        if mark is not None:
            found.append(mark)
            if mark.insult or mark.disguised or mark.learned:
                hits.append(place)
            if mark.you:
                you.append(place)
    insults = sum(m.insult for m in found)
    learned = [m.learned for m in found if m.learned]
    ascii_part = text.encode("ascii", "ignore")
    others = "" if text.isascii() else "".join(_OTHERS.findall(text))
    letters = len(ascii_part.translate(None, _NO_LETTERS)) + sum(map(str.isalpha, others))
    capitals = len(ascii_part.translate(None, _NO_CAPITALS)) + len(_CAPITAL.findall(others))
    signs = len(ascii_part.translate(None, _NO_SIGNS)) + len(_SIGN.findall(others))
    return [
        math.log1p(len(tokens)),
        insults / n,
        math.log1p(insults),
        sum(learned) / n,
        math.log1p(len(learned)),
        max(learned, default=0.0),
        math.log1p(len({m.word for m in found if m.learned})),
        sum(m.disguised for m in found) / n,
        len(you) / n,
        _near(hits, you),
        capitals / max(1, letters),
        sum(m.shouted for m in found) / n,
        signs / chars,
        (text.count("!") + text.count("?")) / chars,
        sum(m.mixed for m in found) / n,
        (sum(m.stretched for m in found) + len(_STRETCHED_GAP.findall(text))) / n,
        len(SPELLED.findall(text)) / n,
    ]


# Tokens remembered at most between two texts.
REMEMBERED = 200_000
ROWS_AT_ONCE = 256
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SIGN = re.compile(r"[^\w\s]")
_OTHERS = re.compile(r"[^\x00-\x7F]+")
# Three or more equal separators of tokens.
_STRETCHED_GAP = re.compile(r"([^\S\n]|[.,;:?\"()\[\]{}<>|])\1{2,}")
_ASCII = [chr(i) for i in range(128)]
_NO_LETTERS = "".join(c for c in _ASCII if not c.isalpha()).encode()
_NO_CAPITALS = "".join(c for c in _ASCII if not _CAPITAL.match(c)).encode()
_NO_SIGNS = "".join(c for c in _ASCII if not _SIGN.match(c)).encode()


def _near(hits: list[int], you: list[int]) -> float:
    """Share of hits with a word of the second person at most NEAR words away."""
    near, at = 0, 0
    for hit in hits:
        while at < len(you) and you[at] < hit - NEAR:
            at += 1
        near += at < len(you) and you[at] <= hit + NEAR
    return near / max(1, len(hits))


def _featurise(
    batches: Iterator[pa.RecordBatch], keys: list[str], lexicon: Mapping[str, float]
) -> Iterator[pa.RecordBatch]:
    marks = Marks(lexicon)
    for whole in batches:
        # Parts keep what a worker and its executor hold at once small.
        for start in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(start, ROWS_AT_ONCE)
            texts = batch.column("row").field("text") if "row" in keys else batch.column("text")
            rows = [features_of(t.as_py(), lexicon, marks) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), *(pa.array(c, pa.float64()) for c in zip(*rows))],
                [*keys, *FEATURES],
            )


def features(docs: DataFrame, lexicon: Mapping[str, float]) -> DataFrame:
    """The columns of `docs` but text, and one column per feature. The text is that of the struct `row` where there
    is one."""
    keys = [f for f in docs.schema if f.name != "text"]
    schema = StructType([*keys, *(StructField(name, DoubleType()) for name in FEATURES)])
    return docs.mapInArrow(partial(_featurise, keys=[f.name for f in keys], lexicon=lexicon), schema)


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in batches:
        pairs = zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())
        for text, label in pairs:
            units = {u for w in set(words_of(text or "")) for u in units_of(w)}
            (toxic if label else clean).update(units)
    units = [u for u in toxic | clean if u]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(units, pa.string()),
            pa.array([toxic[u] for u in units], pa.int64()),
            pa.array([clean[u] for u in units], pa.int64()),
        ],
        ["unit", "toxic", "clean"],
    )


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log-odds of the words and beginnings that mark toxic texts; `sample` has text and label.

    Copies of a text count once, lest every word of one toxic text look telling.
    """
    sample = sample.dropDuplicates(["text"])
    texts = sample.groupBy().agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    ).first()
    if not texts["toxic"]:
        return {}
    log_odds = F.ln(
        ((F.col("toxic") + 0.5) / (texts["toxic"] + 1))
        / ((F.col("clean") + 0.5) / ((texts["clean"] or 0) + 1))
    )
    rows = (
        sample.mapInArrow(_count_units, "unit string, toxic long, clean long")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= LEAST_TEXTS)
        .withColumn("odds", log_odds)
        .where(F.col("odds") >= math.log(LEAST_ODDS))
        .collect()
    )
    return {r["unit"]: r["odds"] for r in rows}


class Model:
    """A lexicon, trees and their calibration; without trees, fixed insults alone count."""

    def __init__(
        self,
        lexicon: dict[str, float],
        trees: GBTClassificationModel | None,
        calibration: IsotonicRegressionModel | None,
    ) -> None:
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def probability(self, rows: DataFrame) -> DataFrame:
        """Adds the uncalibrated `probability` to featurised rows."""
        if self.trees is None:
            return rows.withColumn("probability", 1 - F.exp(-20 * F.col("insult_rate")))
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)
        return (
            self.trees.transform(assembled)
            .withColumn("probability", vector_to_array("probability")[1])
            .drop("vector", "rawPrediction", "guess")
        )

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds `score` to featurised rows."""
        rows = self.probability(rows)
        if self.calibration is None:
            return rows.withColumn("score", F.col("probability"))
        calibrated: Column = F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0))
        return self.calibration.transform(rows).withColumn(
            "score", (1 - TIE_SHARE) * calibrated + TIE_SHARE * F.col("probability")
        )


def _both_classes(rows: DataFrame) -> bool:
    return rows.select("label").distinct().count() == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled rows outside the held-out fold, `sample_rows` of them at most, repeats of id and text
    counting once. To the calibrated score, a share TIE_SHARE of the uncalibrated probability is
    mixed, which tells rows of one calibration step apart.

    Labels of one document that disagree count as toxic; null labels don't count.
    """
    marked = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(sample_rows)
    )
    tenth = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    # Ids may be repeated with many texts, so the bound is on both; either table has `sample_rows` rows at most.
    name = ["doc_id", "text_key"]
    chosen = (
        rows.select(*name)
        .join(F.broadcast(marked), "doc_id")
        .dropDuplicates(name)
        .orderBy("order", *name)
        .limit(sample_rows)
    )
    sample = stage(
        rows.join(F.broadcast(chosen), name)
        .dropDuplicates(name)
        .select("doc_id", "text", "label")
        .withColumn("tenth", tenth),
        "toxicity-sample",
    )
    lexicon = learn_lexicon(sample.where(F.col("tenth") < LEXICON_TENTHS).select("text", "label"))
    rest = sample.where(F.col("tenth") >= LEXICON_TENTHS).select("text", "label", "tenth")
    rows = stage(features(rest, lexicon), "toxicity-features")
    for_trees = rows.where(F.col("tenth") < LEXICON_TENTHS + TREE_TENTHS)
    if not _both_classes(for_trees):
        return Model(lexicon, None, None)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    trees = GBTClassifier(
        featuresCol="vector",
        labelCol="label",
        predictionCol="guess",
        maxIter=20,
        maxDepth=3,
        stepSize=0.2,
        seed=7,
    ).fit(assembler.transform(for_trees))
    model = Model(lexicon, trees, None)
    for_calibration = rows.where(F.col("tenth") >= LEXICON_TENTHS + TREE_TENTHS)
    if _both_classes(for_calibration):
        model.calibration = IsotonicRegression(
            featuresCol="probability", labelCol="label", predictionCol="calibrated"
        ).fit(model.probability(for_calibration))
    return model


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row.

    held_out: crc32(doc_id as text) mod 4 is 2; such rows are never learned from. Only the text is an
    input of a score. Null and empty texts have all rates zero and are scored by the
    model as such. Without labels of both classes the fixed insults alone decide. A null doc_id
    counts as the empty text for the fold. Repeated rows give repeated rows; other columns
    are left out; an empty table gives an empty result.

    Learning touches a bounded sample; scoring is one pass without a shuffle.
    """
    model = train(docs, labels, sample_rows)
    rows = docs.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text"
    )
    return model.score(features(rows, model.lexicon)).select(
        "doc_id",
        "held_out",
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that aren't predicted to be toxic, with all their columns, whatever those are called.

    Each row carries its columns through the scoring, so nothing is joined or shuffled but the sample.
    """
    model = train(docs, labels, sample_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return model.score(features(rows, model.lexicon)).where(F.col("score") < THRESHOLD).select("row.*")
