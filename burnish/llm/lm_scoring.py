"""Operator 1, LM scoring: the marginal probability of a text over all segmentations into vocabulary pieces.

The vocabulary is an existing public one; its file has no unigram scores, so these are estimated by
expectation-maximisation over the table of distinct training words, every pass one distributed sum per piece, until the
words' likelihood settles (SETTLED) or EM_PASSES are made.  A word's lattice has the edges of all pieces that match, an
end-of-word edge, and one edge that spans the whole word if training has seen it:

    P(word) = (c - D) / N + (D V / N) * sum over segmentations of the product of piece scores,

with absolute discount D = (n1 + 1/2) / (n1 + 2 n2 + 1) from the numbers of words seen once and twice, which is below
one; so unseen words get the discounted mass by their spelling and the sum over all texts is at most one.  The pieces spell
words that training has not seen, so each distinct word counts once for them.  The sum over segmentations is the forward
recursion in log space.  A text's score is the sum of its words' log10 P and that of the end token.

Words that are frequent (at most HOT_WORDS of them, a fixed bound) are looked up in the scan; all other words
are joined to the word table by equality.  A word of more than KEY_BYTES is named by its SHA-256 there, so hot words are
found whatever their length.  Nothing is sampled: counts and scores cover all rows.

Defined cases: a null or empty text has no words and one end token; a null id counts as the empty id; very long texts and
words are scored whole; one training row is enough and without any, words are worth their spelling by equal pieces;
repeated rows and repeated ids are scored row by row; an empty table gives an empty result; other columns are ignored.
score() names rows by their place in their partition, so docs should be read from files or a written table, whose
partitions come out the same when a lost task is run again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_slices, materialise, quoted, row_id, string_array, tidied
from .lattice import Lattice, load_pieces

#: Words whose counts are sent to every executor; longer keys than KEY_BYTES are hashed.
HOT_WORDS, KEY_BYTES = 200_000, 64
#: Passes after the first guess at most; a gain in log likelihood of less than this share ends them before.
EM_PASSES, SETTLED = 4, 2e-3


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts with A-Z lower-cased, and the number of the text that each is from."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(string_array(text)))
    words, parent = pc.list_flatten(split), pc.list_parent_indices(split)
    keep = pc.not_equal(words, "")
    return words.filter(keep), parent.filter(keep).to_numpy()


def count_words(group: str, most_words: int = 500_000):
    """For mapInArrow over (text, a long group column): words' counts in each group, summed in the task first."""

    def summed(words: pa.ChunkedArray, groups: np.ndarray, n: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        coded = words.combine_chunks().dictionary_encode()
        width = int(groups.max()) + 1 if len(groups) else 1
        pair, place = np.unique(coded.indices.to_numpy().astype(np.int64) * width + groups, return_inverse=True)
        return coded.dictionary.take(pa.array(pair // width)), pair % width, np.bincount(place, weights=n).astype(np.int64)

    def rows(words: pa.Array, groups: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_arrays([words.slice(i, 20_000).cast(pa.string()), pa.array(groups[i : i + 20_000]), pa.array(n[i : i + 20_000])], ["word", group, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def merge() -> tuple[pa.Array, np.ndarray, np.ndarray]:
            words, groups, n = zip(*held, strict=True)
            return summed(pa.chunked_array(words), np.concatenate(groups), np.concatenate(n))

        for batch in batches:
            for part in bounded_slices(batch, "text"):
                words, parent = words_of(part.column("text"))
                held.append(summed(pa.chunked_array([words]), part.column(group).to_numpy()[parent], np.ones(len(parent))))
                if sum(len(x[0]) for x in held) > most_words:
                    held[:] = [merge()]
                    if len(held[0][0]) > most_words // 2:
                        yield from rows(*held.pop())
        if held:
            yield from rows(*merge())

    return run


def _short_key(word: str) -> str:
    """The word, or a name for a long one; no word starts with a space."""
    raw = word.encode("utf-8", "surrogatepass")
    return word if len(raw) <= KEY_BYTES else f" #{hashlib.sha256(raw).hexdigest()}"


def _keys(words: pa.Array) -> pa.Array:
    """Words as the word table names them."""
    if not (pc.max(pc.binary_length(words)).as_py() or 0) > KEY_BYTES:
        return words
    return pa.array(map(_short_key, words.to_pylist()), words.type)


@dataclass
class Model:
    """words: the table (key, n, worth), n uses in training, worth log10 P; word_end and logp: natural logs of the end-of-word edge's and each piece's score."""

    logp: np.ndarray
    word_end: float
    words: DataFrame
    tokens: int
    distinct: int
    discount: float
    left: float
    ends: int
    end_worth: float


def piece_totals(words: DataFrame, lattice, logp: np.ndarray | None, models: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of every piece over the table (word, m long, n long), one column for each model m, and each model's log likelihood.

    Without logp, plain occurrence counts.  Each task adds up its own words; a row a piece and model is shuffled
    and at most vocabulary-size times models rows reach the driver, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, likely = np.zeros((lattice.value.size, models)), np.zeros(models)
        for batch in batches:
            for part in bounded_slices(batch, "word", 1 << 20):
                word, place = np.unique(np.array(part.column("word").to_pylist(), dtype=object), return_inverse=True)
                weights = np.zeros((len(word), models))
                np.add.at(weights, (place, part.column("m").to_numpy()), part.column("n").to_numpy())
                if logp is None:
                    total += lattice.value.occurrences(word.tolist(), weights)
                else:
                    uses, found = lattice.value.expected(word.tolist(), weights, logp)
                    total, likely = total + uses, likely + found
        piece, model = np.nonzero(total)
        # The likelihood goes as one more piece.
        rows = [np.r_[piece, np.full(models, -1)], np.r_[model, np.arange(models)], np.r_[total[piece, model], likely]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["piece", "model", "uses"])

    rows = words.mapInArrow(tidied(run), "piece long, model long, uses double").groupBy("piece", "model").agg(F.sum("uses").alias("uses")).collect()
    out, likely = np.zeros((lattice.value.size, models)), np.zeros(models)
    for piece, model, uses in rows:
        if piece < 0:
            likely[model] = uses
        else:
            out[piece, model] = uses
    return out, likely


def smoothed(totals: np.ndarray, ends: np.ndarray | float = 0.0, add: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs of piece probabilities (and of the end symbol), with add for each piece."""
    mass = totals.sum(axis=0) + ends + add * (len(totals) + 1)
    return np.log((totals + add) / mass), np.log((ends + add) / mass)


def fit(docs: DataFrame, training: Column, model_path: str, *, text_col: str = "text", passes: int = EM_PASSES) -> Model:
    spark = docs.sparkSession
    lattice = spark.sparkContext.broadcast(Lattice(*load_pieces(model_path)))
    source = docs.select(F.col(quoted(text_col)).alias("text"), F.coalesce(training, F.lit(False)).cast("int").cast("long").alias("train"))
    ends = source.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    counted = source.mapInArrow(tidied(count_words("train")), "word string, train long, n long")
    words = materialise(counted.groupBy("word").agg(F.sum(F.col("n") * F.col("train")).alias("n")), "lm-words")
    seen = F.when(F.col("n") > 0, 1)
    tokens, types, once, twice = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(seen), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).first()
    total, distinct = tokens + ends, types + int(ends > 0)
    discount = (once + 0.5) / (once + 2 * twice + 1)
    left = discount * distinct / total if total else 1.0
    spelt = words.filter("n > 0").select("word", F.lit(0).cast("long").alias("m"), F.lit(1).cast("long").alias("n"))
    logp, end, before = None, None, -math.inf
    for _ in range(passes + 1):
        uses, likely = piece_totals(spelt, lattice, logp)
        first, gain = logp is None, float(likely[0]) - before
        logp, end = smoothed(uses, float(types))
        if not first:
            if gain < SETTLED * abs(float(likely[0])):
                break
            before = float(likely[0])
    word_end, pieces = float(np.ravel(end)[0]), logp

    def lattice_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "word", 1 << 20):
                spelling = lattice.value.log_probability(part.column("word").to_pylist(), pieces)[:, 0] + word_end + math.log(left)
                whole = np.maximum(part.column("n").to_numpy() - discount, 0.0) / max(total, 1)
                with np.errstate(divide="ignore"):
                    worth = np.logaddexp(spelling, np.log(whole)) / math.log(10)
                yield pa.RecordBatch.from_arrays([_keys(part.column("word")), part.column("n"), pa.array(worth)], ["key", "n", "worth"])

    scored = materialise(words.mapInArrow(tidied(lattice_scores), "key string, n long, worth double"), "lm-scores")
    end_worth = math.log10((ends - discount) / total) if ends else math.log10(left) + word_end / math.log(10)
    return Model(pieces[:, 0], word_end, scored, total, distinct, discount, left, ends, end_worth)


def hot_words(words: DataFrame, most: int = HOT_WORDS) -> pa.Table:
    """The words at or above the lowest count that at most `most` words reach."""
    seen = words.filter("n > 0")
    # Counts are put in classes of one sixteenth of a power of two, of which there are at most about a thousand.
    grade = F.floor(F.log2("n") * 16)
    total, least = 0, None
    for g, n in sorted(map(tuple, seen.groupBy(grade.alias("g")).count().collect()), reverse=True):
        if total + n > most:
            break
        total, least = total + n, g
    if least is None:
        return pa.table({"key": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "worth": pa.array([], pa.float64())})
    return seen.filter(grade >= least).toArrow()


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_WORDS) -> DataFrame:
    """A row for each row of docs: the id, n_tokens, n_known, base_score and score (both log10)."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(hot_words(model.words, hot).combine_chunks())
    low = math.log10(1.0 / (model.tokens + model.distinct + 1))
    end_base, end_known, end_score = math.log10(model.ends + 1) + low, int(model.ends > 0), model.end_worth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.value["key"].combine_chunks().cast(pa.large_string())
        count = common.value["n"].to_numpy()
        base, worth = np.log10(count + 1.0), common.value["worth"].to_numpy()
        for batch in batches:
            for part in bounded_slices(batch, "text"):
                words, parent = words_of(part.column("text"))
                rows, coded = part.num_rows, words.dictionary_encode()
                keys = _keys(coded.dictionary)
                at = pc.fill_null(pc.index_in(keys, names), -1).to_numpy()
                code = coded.indices.to_numpy()
                place = at[code] if len(at) else np.zeros(0, dtype=np.int64)
                hit = place >= 0
                per = lambda values: np.bincount(parent[hit], weights=values, minlength=rows)  # noqa: E731, B023
                tokens = np.bincount(parent, minlength=rows)
                sums = [per(np.ones(hit.sum())) + end_known, per(base[place[hit]]) + tokens * low + end_base, per(worth[place[hit]]) + end_score]
                rid = part.column("rid").to_numpy()
                blank = pa.array([f" {r}" for r in rid.tolist()])  # no word starts with a space: meets nothing in the join
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), blank, pa.array(np.zeros(rows, dtype=np.int64)), part.column("id"), pa.array(tokens + 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], NAMES
                )
                pair = parent[~hit].astype(np.int64) * (len(at) + 1) + code[~hit]
                pair, times = np.unique(pair, return_counts=True)
                for start in range(0, len(pair), 20_000):
                    p, t = pair[start : start + 20_000], times[start : start + 20_000]
                    gaps = [pa.nulls(len(p), kind) for kind in (part.column("id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[p // (len(at) + 1)]), keys.take(pa.array(p % (len(at) + 1))).cast(pa.string()), pa.array(t), *gaps], NAMES)

    NAMES = ["rid", "key", "times", "id", "n_tokens", "n_known", "base", "score"]
    id_type = docs.schema[id_col].dataType.simpleString()
    kept = docs.select(row_id().alias("rid"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    parts = kept.mapInArrow(tidied(run), f"rid long, key string, times long, id {id_type}, n_tokens long, n_known long, base double, score double")
    joined = parts.join(model.words.withColumnRenamed("n", "c"), "key", "left")
    c = F.coalesce("c", F.lit(0))
    return (
        joined.groupBy("rid")
        .agg(
            F.max("id").alias(id_col),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.coalesce("n_known", F.when(c > 0, F.col("times")), F.lit(0))).alias("n_known"),
            F.sum(F.coalesce("base", F.col("times") * F.log10(c + 1.0))).alias("base_score"),
            F.sum(F.coalesce("score", F.col("times") * F.col("worth"))).alias("score"),
        )
        .drop("rid")
    )
