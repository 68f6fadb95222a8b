"""Near copies for the pipeline: texts whose sets of word shingles have a Jaccard similarity of LEAST_ALIKE or more.

Candidates come from operator 10 first: SimHash fingerprints of the shingle sets, linked through deletion-variant
signatures.  These reach two bits, and fingerprints of texts at a similarity of 0.8 often differ by up to eleven, which no
choice of segments finds without meeting nearly everything.  So texts also are candidates if they share a MinHash band:
BANDS bands of EACH minima each, of which a pair at 0.8 shares none with a probability of (1 - 0.8 ** 4) ** 28, about 1
in 2.5 million, and a closer pair more rarely.  Every link is verified on the whole shingle sets (of 64-bit hashes).

A band's members are not all compared: first each with the band's smallest, then each with its largest, and components
are formed of the links found.  Members of bands that still hold several components are then joined by their rarest
shingles (prefix filter), which misses no pair, so the components are those of all links among candidates.  There too
members are compared with a few of their list before what is left is compared whole, so neither a large group of near
copies nor a common passage costs the square of its size.

Defined cases: words are split at ASCII white space and A-Z lowered; fewer than WORDS_EACH words make one shingle; texts
without words (null ones too) are copies of each other and of nothing else; very long texts are read whole, their shingles
one array in memory; a null id comes after all others; repeated rows are copies; an empty table gives an empty result;
other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import simhash
from .common import bounded_slices, content_key, materialise, quoted, sized, string_array, tidied, unused
from .simhash import components

SEED = 42
WORDS_EACH = 5
#: As a fraction, so that the comparison is of whole numbers.
LEAST_ALIKE = (4, 5)
BANDS, EACH = 28, 4
#: Rounds at most before what is left is compared whole, and members of a list to compare with in the first.
ROUNDS, CENTRES = 4, 8
#: Shingles whose minima are taken at once.
CHUNK = 1 << 10

_drawn = np.random.default_rng(SEED)
_XORS = _drawn.integers(0, 1 << 32, (BANDS * EACH, 1), dtype=np.uint32)
_ODDS = _drawn.integers(0, 1 << 32, (BANDS * EACH, 1), dtype=np.uint32) | np.uint32(1)
_BAND_SEEDS = _drawn.integers(0, 1 << 64, BANDS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stirred(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def shingles_of(text: bytes) -> np.ndarray:
    """The distinct 64-bit hashes of the text's word shingles, sorted."""
    words = text.lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    each = min(WORDS_EACH, len(words))
    n = len(words) - each + 1
    made = np.zeros(n, dtype=np.uint64)
    for i in range(each):
        made = _stirred(made + hashes[i : i + n])
    return np.unique(made)


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band's minima; none without shingles."""
    if not len(shingles):
        return np.zeros(0, dtype=np.uint64)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * EACH, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(short), CHUNK):
        np.minimum(least, ((short[None, start : start + CHUNK] ^ _XORS) * _ODDS).min(axis=1), out=least)
    made = _BAND_SEEDS.copy()
    for column in least.reshape(BANDS, EACH).T:
        made = _stirred(made + column.astype(np.uint64))
    return made


def fingerprint_of(shingles: np.ndarray) -> int:
    """Majority bits of the set's hashes; zero without any."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(shingles), 1 << 16):
        some = shingles[start : start + (1 << 16)]
        ones += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _over_shingles(rows: DataFrame, added: StructType, columns) -> DataFrame:
    """rows without text, with the columns that columns() makes of a slice's shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text", 1 << 20):
                sets = [shingles_of(t.as_py()) for t in string_array(part.column("text")).cast(pa.large_binary())]
                kept = [i for i, name in enumerate(part.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *columns(sets)], [*[part.schema.names[i] for i in kept], *added.names])

    fields = [f for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(tidied(run), StructType([*fields, *added.fields]))


def _marks(sets: list[np.ndarray]) -> list[pa.Array]:
    keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
    prints = np.array([fingerprint_of(s) for s in sets], dtype=np.uint64).view(np.int64)
    return [pa.array(keys), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints), _lists([bands_of(s) for s in sets])]


_MARKS = StructType([StructField("key", LongType()), StructField("n", IntegerType()), StructField("fp", LongType()), StructField("bands", ArrayType(LongType()))])
_SETS = StructType([StructField("shingles", ArrayType(LongType()))])


def _may_link(n: Column, m: Column) -> Column:
    """Sets of these sizes can be alike enough."""
    up, down = LEAST_ALIKE
    return F.least(n, m) * down >= F.greatest(n, m) * up


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets are alike enough."""
    up, down = LEAST_ALIKE
    one, other = sets.select(F.col("key").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t")).cast("long")
    # common / (|s| + |t| - common) >= up / down
    return pairs.join(one, "a").join(other, "b").filter(common * (up + down) >= (F.size("s") + F.size("t")) * up).select("a", "b")


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    return nodes.join(roots, nodes["key"] == roots["node"], "left").select(*nodes.columns, F.coalesce("root", "key").alias("root"))


def _by_signatures(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints are equal or linked by operator 10, of sizes that can be alike enough."""
    one = F.struct("key", "n")
    prints = materialise(distinct.filter("n > 0").groupBy("fp").agg(F.min(one).alias("low")), "copies-prints")
    equal = distinct.join(prints, "fp").select(one.alias("x"), F.col("low").alias("y"))
    linked = simhash.links(prints.select("fp"))
    near = linked.join(prints.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b").select("x", "y")
    pairs = equal.union(near).filter((F.col("x.key") != F.col("y.key")) & _may_link(F.col("x.n"), F.col("y.n")))
    return materialise(pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")), "copies-signed")


def _links(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified pairs that between them connect all linked keys of distinct (key, n, fp, bands, place); texts has place and text."""
    signed = _by_signatures(distinct)
    indexed = distinct.select("key", "n", F.explode("bands").alias("sig"))
    by_sig = indexed.groupBy("sig").agg(F.count("*").alias("members"), F.min(F.struct("key", "n")).alias("low"), F.max(F.struct("key", "n")).alias("high")).filter("members > 1")
    shared = materialise(indexed.join(by_sig, "sig"), "copies-shared")
    # Sets are made again for candidates alone: those of all texts would take more room than the texts.
    keys = shared.select("key").union(signed.select("a")).union(signed.select("b"))
    wanted = keys.distinct().join(distinct.select("key", "place"), "key").select("key", "place.*")
    sets = materialise(_over_shingles(texts.join(wanted, ["h", "g"]).select("key", "text").dropDuplicates(["key"]), _SETS, lambda s: [_lists(s)]), "copies-sets")

    def starred(end: str) -> DataFrame:
        pairs = shared.filter((F.col("key") != F.col(f"{end}.key")) & _may_link(F.col("n"), F.col(f"{end}.n")))
        return pairs.select(F.least("key", f"{end}.key").alias("a"), F.greatest("key", f"{end}.key").alias("b"))

    stars = materialise(_verified(signed.union(starred("low")).union(starred("high")).distinct(), sets), "copies-stars")
    told = _rooted(shared.select("sig", "key"), stars)
    spread = told.groupBy("sig").agg(F.min("root").alias("r"), F.max("root").alias("q")).filter("r <> q").select("sig")
    open_ = materialise(told.join(spread, "sig").select("key", "root").distinct(), "copies-open")
    return stars.union(_across(open_, sets))


def _rarest(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, root, n, rest, s): the rarest shingles of each open key, so many that near copies share one of them.

    Of n shingles in any common order, n less LEAST_ALIKE of them and one more hold one that every near copy has among
    its own.  Rarest first, a passage that many texts share makes no pairs.
    """
    up, down = LEAST_ALIKE
    words = sets.join(open_, "key").select("key", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = words.groupBy("s").agg(F.count("*").alias("often"))
    ordered = words.join(often, "s").groupBy("key", "root", "n").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("all"))
    first = F.col("n") - F.ceil(F.col("n") * up / down).cast("int") + 1
    placed = ordered.select("key", "root", "n", F.posexplode(F.slice("all", F.lit(1), first)).alias("i", "w"))
    # rest: the shingle itself and those after it, the most that two sets can share if this is the first they do.
    return materialise(placed.filter("w.often > 1").select("key", "root", "n", (F.col("n") - F.col("i")).alias("rest"), "w.s"), "copies-rare")


def _may_share(left: str, right: str) -> Column:
    """Members of a shingle's list (columns named with these endings) that have different roots and can be alike enough."""
    up, down = LEAST_ALIKE
    a, b = (lambda c: F.col(f"{c}{left}")), (lambda c: F.col(f"{c}{right}"))
    enough = F.least(a("rest"), b("rest")) * (up + down) >= (a("n") + b("n")) * up
    return (a("root") != b("root")) & _may_link(a("n"), b("n")) & enough


def _across(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified pairs that connect all open keys (key, root) which link across roots.

    First, in rounds, each member of a shingle's list is compared with a few of the list's most frequent root only, CENTRES
    and in each round four times as many, and roots that turn out linked become one.  What is left, all pairs of different roots
    in one list, is then compared whole, so the rounds decide how much there is to compare, not what is found.
    """
    rare = _rarest(open_, sets)
    links = None
    for r in range(ROUNDS):
        by_root = rare.groupBy("s", "root").agg(F.count("*").alias("members"))
        best = by_root.groupBy("s").agg(F.count("*").alias("roots"), F.max(F.struct("members", "root")).alias("best")).filter("roots > 1").select("s", "best.root")
        drawn = F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("key", "s", F.lit(r)), "key"))
        centres = rare.join(best, ["s", "root"]).withColumn("place", drawn).filter(F.col("place") <= CENTRES << 2 * r)
        centres = centres.select("s", *[F.col(x).alias(f"{x}_c") for x in ("key", "root", "n", "rest")])
        met = rare.join(centres, "s").filter(_may_share("", "_c"))
        pairs = met.select(F.least("key", "key_c").alias("a"), F.greatest("key", "key_c").alias("b")).distinct()
        found = materialise(_verified(pairs, sets), f"copies-round-{r}")
        if not found.count():
            break
        links = found if links is None else links.union(found)
        names = rare.select("key", "root").distinct()
        joined = found.join(names.select(F.col("key").alias("a"), F.col("root").alias("x")), "a").join(names.select(F.col("key").alias("b"), F.col("root").alias("y")), "b")
        merged = components(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
        rare = rare.join(merged, rare["root"] == merged["node"], "left").select("key", F.coalesce(merged["root"], rare["root"]).alias("root"), "n", "rest", "s")
        rare = materialise(rare, f"copies-rare-{r}")
    left, right = (rare.select("s", *[F.col(c).alias(f"{c}_{k}") for c in ("key", "root", "n", "rest")]) for k in "ab")
    pairs = left.join(right, "s").filter((F.col("key_a") < F.col("key_b")) & _may_share("_a", "_b"))
    last = _verified(pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct(), sets)
    return last if links is None else links.union(last)


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, columns as they are: a row with the group's smallest id, null ids after all others.

    A row is known by two hashes of its id and text; of rows that repeat both, any one stays.
    """
    h, g = content_key(id_col, text_col)
    texts = docs.select(F.col(quoted(id_col)).alias("id"), h.alias("h"), g.alias("g"), F.col(quoted(text_col)).alias("text"))
    marked = materialise(_over_shingles(texts, _MARKS, _marks), "copies-rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h", "g")
    distinct = marked.groupBy("key").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    distinct = materialise(distinct.withColumn("place", F.struct("first.h", "first.g")), "copies-distinct")
    rooted = _rooted(distinct.select("key", "first"), _links(distinct, texts.select("h", "g", "text")))
    names = [unused(docs.columns, f"_copies_{c}") for c in "hg"]
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.h").alias(names[0]), F.col("first.g").alias(names[1]))
    rows = docs.withColumn(names[0], h).withColumn(names[1], g).join(sized(materialise(chosen, "copies-chosen")), names, "left_semi")
    return rows.dropDuplicates(names).select(*[F.col(quoted(c)) for c in docs.columns])
