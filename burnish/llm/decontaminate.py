"""Operator 8, benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed in K-grams, and of each window of SPAN words the smallest K-gram hash is kept.  A window of SPAN
equal words has the same smallest hash wherever it stands, so a document and an item that share SPAN words share a
fingerprint.  Runs of windows with one fingerprint are one posting (hash and place, no text).  Postings that meet a
fingerprint of the benchmark by equality are kept; only then are their documents' words read again, each posting extended
to all windows of its run, and each window compared word for word, again by equality.  An item of fewer words is one
window of its own length; documents' windows of that length meet it by a hash of their words, then word for word.

A benchmark's or the hits' table is broadcast only if its measured bytes are within common.BROADCAST_BYTES; beyond that
joins are shuffled.  Rows are named by two hashes of id and text, which any task finds again.

Defined cases: null and empty texts have no words and no hits; a very long text is read whole, as one array of words in
memory; repeated rows are judged alike, row by row; of equal items each counts; a null item id is left out of the ids but
its windows are hit; an empty table gives an empty result, an empty benchmark no hits; other columns are ignored
(contamination) or kept (clean), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, content_key, materialise, quoted, sized, unused

SPAN, K = 10, 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _places(n: Column, length: int) -> Column:
    """0, 1, ... for each window of the length among n words; none where there are too few."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _gram_hashes(ws: str, k: int, seed: int = 0) -> Column:
    """A hash of each k words in a row; other seeds give other hashes."""
    first = [F.lit(seed)] if seed else []
    return F.transform(_places(F.size(ws), k), lambda i: F.xxhash64(*first, *[F.get(F.col(ws), i + j) for j in range(k)]))


def _window_minima(hashes: str, width: int) -> Column:
    return F.transform(_places(F.size(hashes), width), lambda i: F.least(*[F.get(F.col(hashes), i + j) for j in range(width)]))


def _joined(ws: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(ws, start + 1, length), " ")


def fingerprinted(texts: DataFrame, span: int, k: int) -> DataFrame:
    """Adds minima to a table with ws: the smallest k-gram hash of each window of span words."""
    return texts.withColumn("grams", _gram_hashes("ws", k)).withColumn("minima", _window_minima("grams", span - k + 1)).drop("grams")


class _Items:
    """The benchmark: windows (window, len, wid), links (wid, item), prints (h, len) and the lengths of short items."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, span: int, k: int):
        items = benchmark.select(F.col(quoted(item_col)).cast("string").alias("item"), words(F.col(quoted(text_col))).alias("ws"))
        items = materialise(items.filter(F.size("ws") > 0).select("item", "ws", F.least(F.size("ws"), F.lit(span)).alias("len")), "leak-items")
        each = F.transform(F.sequence(F.lit(0), F.size("ws") - F.col("len")), lambda i: F.array_join(F.slice("ws", i + 1, F.col("len")), " "))
        said = items.select("item", "len", F.explode(each).alias("window")).distinct()
        windows = said.select("window", "len").distinct().select("window", "len", F.struct(F.xxhash64("len", "window").alias("a"), F.xxhash64("window", "len").alias("b")).alias("wid"))
        self.windows = sized(materialise(windows, "leak-windows"))
        links = said.filter(F.col("item").isNotNull()).select(F.struct(F.xxhash64("len", "window").alias("a"), F.xxhash64("window", "len").alias("b")).alias("wid"), "item")
        self.links = materialise(links, "leak-links")
        prints = fingerprinted(items.filter(F.col("len") == span), span, k).select(F.explode("minima").alias("h"), F.lit(span).alias("len")).distinct()
        short = items.filter(F.col("len") < span)
        self.lengths = sorted(r[0] for r in short.select("len").distinct().collect())  # at most span - 1 of them
        for n in self.lengths:
            prints = prints.union(short.filter(F.col("len") == n).select(_gram_hashes("ws", n, n)[0], F.lit(n)).distinct())
        self.prints = sized(materialise(prints, "leak-prints"))


def _postings(docs: DataFrame, items: _Items, id_col: str, text_col: str, span: int, k: int) -> DataFrame:
    """(key, id, h, len, at, runs): a row a run of windows with one fingerprint, one a short window, and one of len 0 whose at is the number of words."""
    h, g = content_key(id_col, text_col)
    source = docs.select(F.struct(h.alias("h"), g.alias("g")).alias("key"), F.col(quoted(id_col)).alias("id"), words(F.col(quoted(text_col))).alias("ws"))
    marked = fingerprinted(source, span, k)
    begins = F.filter(_places(F.size("minima"), 1), lambda i: (i == 0) | (F.get(F.col("minima"), i) != F.get(F.col("minima"), i - 1)))
    marked = marked.withColumn("begins", begins)

    def posting(h: Column, n: Column | int, at: Column, runs: Column) -> Column:
        return F.struct(h.alias("h"), F.lit(n).alias("len"), at.alias("at"), runs.alias("runs"))

    def run(i: Column, j: Column) -> Column:
        return posting(F.get(F.col("minima"), i), span, i, F.coalesce(F.get(F.col("begins"), j + 1), F.size("minima")) - i)

    def short(n: int) -> Column:
        return F.transform(_gram_hashes("ws", n, n), lambda h, i: posting(h, n, i, F.lit(1)))

    # The one of len 0 has a spread key and meets nothing that matters.
    all_ = [F.array(posting(F.col("key.h"), 0, F.size("ws"), F.lit(0))), F.transform("begins", run)]
    for n in items.lengths:
        all_.append(short(n))
    return marked.select("key", "id", F.explode(F.concat(*all_)).alias("p")).select("key", "id", "p.*")


def _hits(docs: DataFrame, met: DataFrame, items: _Items, id_col: str, text_col: str) -> DataFrame:
    """(key, at, stop, wid): the windows of documents that are windows of items."""
    h, g = content_key(id_col, text_col)
    found = met.filter("len > 0").groupBy("key").agg(F.collect_set(F.struct("at", "len", "runs")).alias("runs"))
    found = sized(materialise(found.select(F.col("key.h").alias("h"), F.col("key.g").alias("g"), "runs"), "leak-found"))
    texts = docs.select(h.alias("h"), g.alias("g"), F.col(quoted(text_col)).alias("text")).join(found, ["h", "g"])
    cut = texts.select("h", "g", "runs", words(F.col("text")).alias("ws"))
    said = F.transform("runs", lambda r: F.struct(r["at"].alias("at"), r["len"].alias("len"), F.slice(F.col("ws"), r["at"] + 1, r["runs"] + r["len"] - 1).alias("said")))
    runs = cut.select(F.struct("h", "g").alias("key"), F.explode(said).alias("r")).select("key", "r.*")
    each = runs.select("key", "at", "len", "said", F.explode(F.sequence(F.lit(0), F.size("said") - F.col("len"))).alias("i"))
    windows = each.select("key", (F.col("at") + F.col("i")).alias("at"), "len", _joined(F.col("said"), F.col("i"), F.col("len")).alias("window"))
    hits = windows.join(items.windows, ["window", "len"]).select("key", "at", (F.col("at") + F.col("len")).alias("stop"), "wid")
    return hits.distinct()  # of rows that repeat id and text one speaks


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """id, n_words, n_hit, items (their ids as sorted strings) of each row of docs."""
    items = _Items(benchmark, item_col, item_text_col, span, k)
    postings = _postings(docs, items, id_col, text_col, span, k)
    met = postings.join(items.prints.withColumn("known", F.lit(True)), ["h", "len"], "left").filter("len = 0 OR known").drop("h", "known")
    met = materialise(met, "leak-met")
    hits = materialise(_hits(docs, met, items, id_col, text_col), "leak-hits")
    before = Window.partitionBy("key").orderBy("at", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest("at", F.coalesce(F.max("stop").over(before), F.lit(0))))
    told = hits.withColumn("fresh", covered).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    linked = hits.select("key", "wid").distinct().join(sized(items.links), "wid").select("key", "item").distinct()
    named = linked.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = met.filter("len = 0").select("key", F.col("id").alias(id_col), F.col("at").cast("long").alias("n_words"))
    found = rows.join(told.join(named, "key", "left"), "key", "left")
    return found.select(quoted(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """The rows of docs, columns as they are, without a hit."""
    items = _Items(benchmark, "item_id", "text", span, k)
    postings = _postings(docs, items, id_col, text_col, span, k).filter("len > 0")
    met = materialise(postings.join(items.prints, ["h", "len"], "left_semi").drop("h"), "leak-met")
    names = [unused(docs.columns, f"_leak_{c}") for c in "hg"]
    leaked = _hits(docs, met, items, id_col, text_col).select(F.col("key.h").alias(names[0]), F.col("key.g").alias(names[1])).distinct()
    leaked = sized(materialise(leaked, "leak-leaked"))
    h, g = content_key(id_col, text_col)
    return docs.withColumn(names[0], h).withColumn(names[1], g).join(leaked, names, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
