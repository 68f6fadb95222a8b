"""Operator 10, SimHash near-duplicates: deletion-variant signatures over two segments.

Fingerprints of 64 bits link when at most DIFFERING = 2 bits differ; the segments are made for that number.  Cut into two segments of 32 bits, one segment of a linked
pair differs by at most one bit, so the two share a signature: that segment with some one bit made a wildcard.
Distinct fingerprints are indexed under their 64 signatures, met by equality, and verified on all bits.

A signature that more than CROWD fingerprints share emits no pairs.  Its members are linked exactly another way: each
lists itself and its 64 one-bit neighbours, and whoever lists the same value is within two bits of all others who
do, so each is linked to the smallest of them.  A pair that meets in a crowd has both ends among those members.

Classes are the connected components of the links, found by alternating star contraction on tables of links; no
links, components or fingerprints reach the driver.

Defined cases: a null text, or one without words, has fingerprint zero, linked like any other; fewer than three words make
one shingle; very long texts are read whole; repeated rows share a fingerprint and a class; a null id takes no part in the choice of the smallest id
(a class of null ids only has a null class id); an empty table gives an empty result; other columns are ignored
(near_duplicates) or kept (representatives), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_slices, content_key, materialise, quoted, sized, string_array, tidied, unused

SEED = 42
DIFFERING = 2
#: Above so many fingerprints to a signature, pairs give way to one-bit neighbours.
CROWD = 16
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint_of(text: bytes, words_each: int) -> int:
    """Majority bits of the XXH64 hashes of the text's word shingles, repeats included; zero without words."""
    words = text.lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False)) if len(words) >= words_each else iter([b" ".join(words)])
    total = max(1, len(words) - words_each + 1)
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(n)), dtype=np.uint64, count=n)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprinted(rows: DataFrame, *, text_col: str, words_each: int = 3, name: str = "_simhash_fp") -> DataFrame:
    """rows with one more column, the signed 64-bit fingerprint of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, text_col):
                texts = string_array(part.column(text_col)).cast(pa.large_binary())
                got = np.array([fingerprint_of(t.as_py(), words_each) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], [*part.schema.names, name])

    return rows.mapInArrow(tidied(run), StructType([*rows.schema.fields, StructField(name, LongType())]))


def _signatures(fp: Column) -> Column:
    """The 64 values (segment, wildcard place, rest of the segment), each packed into one long."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    made = []
    for segment, value in enumerate((low, high)):
        for bit in range(32):
            wild = value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))
            made.append(wild.bitwiseOR(F.lit((segment * 32 + bit) << 32)))
    return F.array(*made)


def _neighbours(fp: Column) -> Column:
    flips = [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(64)]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(x).cast("long")) for x in flips])


def links(fps: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that between them connect all that link."""
    indexed = fps.select("fp", F.explode(_signatures(F.col("fp"))).alias("sig"))
    # Signatures are counted in the scan first, so a frequent one is in no one task; few are shared, and these alone meet.
    counted = materialise(indexed.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-signatures")
    shared = materialise(indexed.join(sized(counted), "sig"), "simhash-shared")
    met = shared.filter(F.col("n") <= crowd).groupBy("sig").agg(F.sort_array(F.collect_list("fp")).alias("members"))
    # Pairs are verified in the array, and a pair with an equal segment counts under the segment's first signature alone.
    pairs = F.expr(f"""
        flatten(transform(members, (a, i) -> transform(filter(slice(members, i + 2, size(members)), b ->
            bit_count(a ^ b) <= {DIFFERING} AND (((sig >> 32) & 31) = 0 OR ((a ^ b) >> CAST(sig >> 32 AS INT)) & 1 = 1)), b -> struct(a, b))))
    """)
    verified = met.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    # Members of crowds: found through their signatures, then linked through shared one-bit neighbours.
    members = shared.filter(F.col("n") > crowd).select("fp").distinct()
    listed = members.select("fp", F.explode(_neighbours(F.col("fp"))).alias("via"))
    least = listed.groupBy("via").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    starred = listed.join(least, "via").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return verified.union(starred).distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): alternating large-star and small-star until the links are stars."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = materialise(edges.select("a", "b"), "star-0")
    state = None
    for r in range(most_rounds):
        around = both(now)
        least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).filter("a <> b").distinct()
        large = materialise(large, f"star-{r}-large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("b"), "m"), F.struct(F.col("v").alias("b"), "m"))).alias("s"))
        now = materialise(small.select(F.col("s.m").alias("a"), F.col("s.b").alias("b")).filter("a <> b").distinct(), f"star-{r}")
        # A sum over the links changes as long as any link does.
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == state:
            break
        state = told
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def classes(fps: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """(fp, root) for each value of fps (fp, distinct): equal roots for linked fingerprints."""
    roots = components(links(fps.select("fp"), crowd=crowd))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, crowd: int = CROWD) -> DataFrame:
    """The id, fp and component_id (smallest id of the class) of each row."""
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    marked = materialise(fingerprinted(source, text_col="text", words_each=words_each, name="fp").drop("text"), "simhash-fp")
    distinct = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    rooted = distinct.join(classes(distinct.select("fp"), crowd=crowd), "fp")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, crowd: int = CROWD) -> DataFrame:
    """One row of each class, columns as they are: a row with the class's smallest id, null ids after all others.

    A row is known by two hashes of its id and text, so what is kept for the choice is small; of rows that repeat both, any
    one stays.
    """
    h, g = content_key(id_col, text_col)
    source = docs.select(F.col(quoted(id_col)).alias("id"), h.alias("h"), g.alias("g"), F.col(quoted(text_col)).alias("text"))
    marked = materialise(fingerprinted(source, text_col="text", words_each=words_each, name="fp").drop("text"), "simhash-rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h", "g")
    distinct = materialise(marked.groupBy("fp").agg(F.min(order).alias("first")), "simhash-first")
    rooted = distinct.join(classes(distinct.select("fp"), crowd=crowd), "fp")
    names = [unused(docs.columns, f"_simhash_{c}") for c in "hg"]
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.h").alias(names[0]), F.col("first.g").alias(names[1]))
    rows = docs.withColumn(names[0], h).withColumn(names[1], g).join(chosen, names, "left_semi")
    return rows.dropDuplicates(names).select(*[F.col(quoted(c)) for c in docs.columns])
