"""SimHash classes and the whole pipeline, against plain versions."""

import random
import struct
import zlib
from collections import Counter
from functools import cache

import numpy as np
import xxhash
from tokenizers import Tokenizer

from burnish.llm import language_id, mixing, simhash
from burnish.llm.lattice import load_pieces
from burnish.llm.queries import id_remainder, public_path
from corpus_pipeline import STAGES, run
from llm.test_near_copies import plain_kept
from llm.test_operators import plain_forward, plain_hits


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_classes(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_bits(a, b):
    return (a ^ b).bit_count() <= 2


def texts(seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", " \t ", "one", "one two", "One  TWO", "one two three", "é È ß"]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(300)]
        out.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            copy = list(base)
            copy[rnd.randrange(300)] = rnd.choice(words)
            out.append(" ".join(copy))
    return out + out[8:12] + ["long " * 30_000]


def test_near_duplicates(spark):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts())]
    rows += [rows[9], rows[9], (None, rows[12][1], "x"), (None, "alone here now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = [fingerprint(r[1]) for r in rows]
    group = plain_classes(fps, near_bits)
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    wanted = sorted(((r[0], f - (1 << 64) * (f >> 63), least.get(g)) for r, f, g in zip(rows, fps, group, strict=True)), key=str)
    for crowd in (16, 1):
        got = simhash.near_duplicates(df, crowd=crowd).collect()
        assert sorted(map(tuple, got), key=str) == wanted
    kept = simhash.representatives(df).collect()
    assert len(kept) == len(set(group)) and set(kept[0].asDict()) == {"doc_id", "text", "fp"}
    assert {k.doc_id for k in kept} == set(least.values()) | {None}


def test_links_among_close_values(spark):
    """Many values within few bits of each other: the crowd's way and the pairs' way give the same classes."""
    rnd = random.Random(5)
    values = {0}
    while len(values) < 300:
        v = rnd.choice(sorted(values))
        values.add((v ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64)) if rnd.random() < 0.9 else rnd.getrandbits(64))
    listed = sorted(values)
    group = plain_classes(listed, near_bits)
    wanted = Counter(Counter(group).values())
    df = spark.createDataFrame([(v - (1 << 64) * (v >> 63),) for v in listed], "fp long")
    for crowd in (0, 4, 1000):
        got = simhash.classes(df, crowd=crowd).groupBy("root").count().collect()
        assert Counter(r["count"] for r in got) == wanted


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == [] and simhash.representatives(df).collect() == []


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == got[102] == 100


SF = "/root/testdata/sf0.001"


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, counts = docs, [docs.count()]
    for name, stage in STAGES:
        out = stage(spark, kept, SF)
        assert name == "token output" or out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), out.schema)
        counts.append(kept.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[5] == counts[4] > 0
    assert sorted(map(tuple, run(spark, SF).collect())) == sorted(map(tuple, kept.collect()))


# ---- run() against plain versions of its stages ----


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of longs, Booleans and strings; nulls are passed over."""
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v) if isinstance(v, bool) else struct.pack("<q", v) if isinstance(v, int) else v.encode()
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) * (seed >> 63)


def split(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def plain_features(text):
    """Features as the operator numbers them: buckets may hold several starts, so occurrences are counted by bucket."""
    times = Counter(spark_hash(w[:5]) % mixing.BUCKETS for w in split(text))
    return sorted(b * 3 + k for b, n in times.items() for k in range(min(n, 3)))


def plain_mixing(rows, labels):
    """How often each row (id, text) comes out."""
    domain = {}
    for i, quality, toxic in labels:
        q, t = domain.get(i, (1, 0))
        domain[i] = (min(q, quality), max(t, toxic))
    by_text = {}
    for i, text in rows:
        if i in domain:
            q, t = domain[i]
            by_text[text] = max(by_text.get(text, 0), 2 if t else 1 - q)
    counts = np.zeros((2, 3, 3 * mixing.BUCKETS))
    for text, d in by_text.items():
        counts[spark_hash(text) % 2, d, plain_features(text)] += 1

    def ratios(c):
        expected = c.sum(axis=0) * c.sum(axis=1, keepdims=True) / max(c.sum(), 1)
        sure = (c - expected) ** 2 / np.maximum(expected, 0.5)
        out = np.log((c + mixing.SMOOTH) / (expected + mixing.SMOOTH)) * sure / (sure + mixing.CHANCE)
        return out[1:] - out[0]

    def inputs(w, text):
        f = plain_features(text)
        s = w[:, f].sum(axis=1)
        return np.array([*np.stack([s / np.sqrt(len(f) + 10) * 3, np.sign(s) * np.log1p(np.abs(s))], axis=1).ravel(), np.log1p(len(f)) / 5, 1.0])

    crossed = [ratios(counts[1]), ratios(counts[0])]
    x = np.array([inputs(crossed[spark_hash(t) % 2], t) for t in by_text])
    turn = mixing._softmax_fit(x, np.array(list(by_text.values())), np.ones(len(x)))
    whole = ratios(counts.sum(axis=0))
    logits = np.array([turn @ inputs(whole, t) for _, t in rows])
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    n, r = np.array([len(split(t)) for _, t in rows], dtype=float), np.ones(len(rows))
    goal = np.array([0.85, 0.10, 0.05]) * n.sum()
    for _ in range(mixing.STEPS):
        off = p.T @ (n * r) - goal
        if np.abs(off).max() / n.sum() < mixing.CLOSE:
            break
        on = n * (r > 0)
        r = np.maximum(0, r - p @ (np.linalg.pinv((p.T * on) @ p, rcond=1e-9) @ off))
    drawn = [spark_hash(i, i is None, t, t is None) % (1 << 30) / (1 << 30) for i, t in rows]
    return [int(np.floor(a + b)) for a, b in zip(r, drawn, strict=True)]


def made_corpus(seed=11):
    rnd = random.Random(seed)
    vocabulary = {"en": [f"the{x}ing" for x in "abcdefgh"] + "the of and nation house that with people this were".split(), "de": [f"un{x}ung" for x in "abcdefgh"] + "der die das und nicht straße für über eine haus".split()}
    rows, labels = [], []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = [rnd.choice(vocabulary[lang]) for _ in range(rnd.randrange(60, 120))]
        kind = rnd.choice([0, 0, 0, 1, 2])
        if kind:
            for _ in range(12):
                text.insert(rnd.randrange(len(text)), ["click", "vileword"][kind - 1])
        rows.append((i, " ".join(text), lang if i % 7 else None, "s", len(text)))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    passage = "a benchmark question of exactly these many words in one row here"
    rows += [(70, rows[4][1] + " " + passage + " " + rows[7][1], "en", "s", 1), (71, passage.upper(), "en", "s", 1)]
    for i in (3, 8, 20):  # one changed word, and whole copies
        w = rows[i][1].split()
        rows.append((80 + i, " ".join([*w[:30], "changed", *w[31:]]), "en", "s", 1))
        rows.append((100 + i, rows[i][1], "en", "s", 1))
    rows += [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, "12 34 !!", None, "s", 0), rows[5], rows[5], (None, "the nation of the people with that house", None, "s", 1)]
    return rows, labels, [(1, passage), (2, "short of it"), (3, None)]


def test_run_equals_a_plain_version(spark, tmp_path):
    rows, labels, items = made_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Language: posteriors from the fitted piece scores, by the plain forward recursion.
    model = language_id.fit(docs, id_remainder(3) != 1, public_path("piece_bpe_32k.model"))
    pieces, byte_ids = load_pieces(public_path("piece_bpe_32k.model"))
    worth = cache(lambda w: np.array([plain_forward(pieces, byte_ids, w, model.logp[:, m]) for m in range(len(model.languages))]))
    kept = []
    for i, text, *_ in rows:
        if any(c.isalpha() for c in text or ""):
            total = model.prior + sum(worth(w) for w in split(text))
            if np.exp(total.max() - np.logaddexp.reduce(total)) >= 0.5:
                kept.append((i, text))
    assert {i for i, _ in kept} == {r[0] for r in rows} - {90, 91, 92}
    # Near copies: all pairs.
    ids = set(plain_kept(kept))
    kept = list(dict.fromkeys((i, t) for i, t in kept if i in ids))
    assert not {83, 88, 100, 103, 108, 120} & ids
    # Benchmark windows, word for word.
    kept = [r for r, (_, hit, _) in zip(kept, plain_hits([t for _, t in kept], items), strict=True) if not hit]
    assert not {70, 71} & {i for i, _ in kept}
    kept = [r for r, n in zip(kept, plain_mixing(kept, labels), strict=True) for _ in range(n)]
    kept.sort(key=lambda r: (r[0] is not None, r[0]))
    encode = Tokenizer.from_file(public_path("word_bpe_49k.json")).encode
    wanted, at = [], 0
    for i, t in kept:
        found = [*encode(t, add_special_tokens=False).ids, 1]
        wanted.append((i, at, len(found), zlib.crc32(struct.pack(f"<{len(found)}I", *found))))
        at += len(found)
    assert [tuple(r) for r in sorted(run(spark, str(tmp_path)).collect(), key=lambda r: r.start)] == wanted


def test_run_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert run(spark, str(tmp_path)).collect() == []
    rows = [(1, "the nation of the people", "en", "_copies_h"), (2, None, None, None), (1, "the nation of the people", "en", "_copies_h")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, _copies_h string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.start) for r in run(spark, str(tmp_path)).collect()] == [(1, 0)]
