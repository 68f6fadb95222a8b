"""Operator 6, language ID: unigram pieces per language, marginalised over all segmentations.

Each language has its own probabilities of the pieces of one fixed public vocabulary, estimated by
expectation-maximisation on labelled training texts.  A text's likelihood under a language is the product of its
words' forward sums over their lattices; the prediction is the language with the largest posterior.

The classifier is fitted on a bounded sample: about DOCS_PER_LANGUAGE labelled rows of each language, drawn by a
hash of the row (the bound is the parameter docs_per_language).  Prediction covers every row and whole texts.

Defined cases: a null text, or one without any letter, is `und` with score 0; rows without a label never train; with
no training rows every text is `und`; equal posteriors go to the language that sorts first; very long texts are read
whole, a long word costing time in proportion to its length; repeated rows are predicted row by row; an empty table gives
an empty result; other columns are ignored (identify) or kept (accepted), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_slices, materialise, remembered, string_array, tidied
from .lattice import Lattice, Remembered, load_pieces
from .lm_scoring import count_words, piece_totals, smoothed, words_of

DOCS_PER_LANGUAGE = 1500
EM_PASSES = 2
UNKNOWN = "und"
#: Bytes of text predicted at once; bounds a worker's memory.
SLICE = 1 << 20


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # pieces by languages
    prior: np.ndarray
    lattice: Broadcast


def fit(docs: DataFrame, training: Column, model_path: str, *, lang_col: str = "lang", text_col: str = "text", docs_per_language: int = DOCS_PER_LANGUAGE, passes: int = EM_PASSES) -> LanguageModel:
    spark = docs.sparkSession
    lattice = spark.sparkContext.broadcast(Lattice(*load_pieces(model_path)))
    rows = docs.filter(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {lang: n for lang, n in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((lattice.value.size, 0)), np.zeros(0), lattice)
    model = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])[F.col("lang")].cast("long")
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, docs_per_language / counts[lang])])[F.col("lang")]
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003
    sample = rows.filter(drawn).select("text", model.alias("m"))
    words = sample.mapInArrow(tidied(count_words("m")), "word string, m long, n long").groupBy("word", "m").agg(F.sum("n").alias("n"))
    words = materialise(words, "language-words")
    logp = None
    for _ in range(passes + 1):
        logp, _end = smoothed(piece_totals(words, lattice, logp, len(languages))[0])
    prior = np.log(np.array([counts[x] for x in languages]) / sum(counts.values()))
    return LanguageModel(languages, logp, prior, lattice)


def _remembered(model: LanguageModel) -> Remembered:
    """One for each model and worker process, so that a task knows the words of those before it."""
    key = ("language ID", hash((model.logp.tobytes(), tuple(model.languages))))
    return remembered(key, lambda: Remembered(model.lattice.value, model.logp))


def _predict(model: LanguageModel, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of the best language (-1: none) and its posterior, for each text."""
    plain = string_array(text)
    lettered = pc.match_substring_regex(plain, r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.languages:
        return np.full(len(plain), -1), np.zeros(len(plain))
    words, parent = words_of(plain)
    coded = words.dictionary_encode()
    worth = _remembered(model)(coded.dictionary)
    code = coded.indices.to_numpy()
    total = np.stack([np.bincount(parent, weights=worth[code, m], minlength=len(plain)) for m in range(len(model.languages))], axis=1)
    total = total + model.prior
    total -= total.max(axis=1, keepdims=True)
    posterior = np.exp(total)
    posterior /= posterior.sum(axis=1, keepdims=True)
    best = posterior.argmax(axis=1)
    return np.where(lettered, best, -1), np.where(lettered, posterior[np.arange(len(best)), best], 0.0)


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE):
                best, score = _predict(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), names.take(pa.array(best % len(names))), pa.array(score)], [id_col, "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run, remembers=True), f"`{id_col}` {id_type}, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, all columns kept as they are, whose language is known with a posterior of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, text_col, SLICE):
                best, score = _predict(model, part.column(text_col))
                yield part.filter(pa.array((best >= 0) & (score >= least)))

    return docs.mapInArrow(tidied(run, remembers=True), docs.schema)
