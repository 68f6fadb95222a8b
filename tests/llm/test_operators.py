"""Each operator on small tables with nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import gc
import hashlib
import math
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burnish.llm import chat_format, common, decontaminate, html_text, language_id, lm_scoring, mixing, near_copies, simhash, token_output, url_filter, vector_topk
from burnish.llm import lattice as lattice_module
from burnish.llm.lattice import MARK, Lattice, load_pieces
from burnish.llm.queries import id_remainder, public_path

MODEL = public_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, rid string, word string, n long"
WILD = [None, "", " \t\n", "Hello WORLD hello", "é ß Ünï 日本語 \U0001f600", "x" * 5000, "a b " * 3000, "</s> <|endoftext|> \x01 a\x01b", "the the the"]


def docs(spark, texts=WILD, lang="en"):
    rows = [(i, t, lang, "r", "w", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "the end", lang, "r", "w", 1)], DOCS)


def words(text):
    return (text or "").encode().lower().split()


# ---- op1 and the lattice ----


@pytest.fixture(scope="module")
def lattice():
    return Lattice(*load_pieces(MODEL))


def plain_forward(pieces, byte_ids, word, logp):
    text = MARK + word
    alpha = [0.0] + [-math.inf] * len(text)
    ids = {p: i for i, p in enumerate(pieces) if p}
    for j in range(1, len(text) + 1):
        found = [alpha[i] + logp[ids[text[i:j]]] for i in range(max(0, j - 20), j) if text[i:j] in ids]
        if text[j - 1] not in ids:
            found.append(alpha[j - 1] + sum(logp[byte_ids[b]] for b in text[j - 1].encode()))
        if found:
            alpha[j] = float(np.logaddexp.reduce(found))
    return alpha[-1]


def test_lattice_sums_all_segmentations(lattice):
    pieces, byte_ids = load_pieces(MODEL)
    rnd = np.random.default_rng(0)
    logp = np.log(rnd.dirichlet(np.ones(len(pieces)), size=2).T)
    some = ["the", "a", "nation", "Übergröße", "日本語", "\U0001f600x", "x" * 70, "antidisestablishmentarianism", "\x01"]
    got = lattice.log_probability(some, logp)
    for m in range(2):
        assert np.allclose(got[:, m], [plain_forward(pieces, byte_ids, w, logp[:, m]) for w in some])
    uses, likely = lattice.expected(some, np.ones((len(some), 2)), logp)
    assert np.allclose(likely, got.sum(axis=0))
    spelt = np.array([len((MARK + w)) for w in some]).sum()
    lengths = np.array([len(p) for p in pieces], dtype=float)
    for b in byte_ids:
        lengths[b] = 0
    covered = (uses * lengths[:, None]).sum(axis=0)
    by_bytes = sum(1 for w in some for c in w if c not in pieces)
    assert np.allclose(covered + by_bytes, spelt)


def test_lm_scores(spark):
    df = docs(spark)
    train = id_remainder(7) != 2
    for hot in (200_000, 0):
        model = lm_scoring.fit(df, train, MODEL)
        got = lm_scoring.score(df, model, hot=hot).collect()
        rows = df.collect()
        counts, total = Counter(), 0
        for r in rows:
            if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 != 2:
                w = [*words(r.text), "END"]
                counts.update(w)
                total += len(w)
        assert model.tokens == total and model.distinct == len(counts)
        wanted = []
        for r in rows:
            w = [*words(r.text), "END"]
            wanted.append((r.doc_id, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w), 5)))
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got), key=str) == sorted(wanted, key=str)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    empty = df.filter("false")
    assert lm_scoring.score(empty, lm_scoring.fit(empty, train, MODEL)).collect() == []
    untrained = lm_scoring.score(df, lm_scoring.fit(empty, train, MODEL)).collect()
    assert len(untrained) == len(rows) and all(math.isfinite(r.score) for r in untrained)


def plain_model(texts, pieces, byte_ids, model):
    """log10 P of a word and of the end by the formula, from the piece scores of a fitted model."""
    counts = Counter(w.decode() for t in texts for w in words(t))
    n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
    total, discount = sum(counts.values()) + len(texts), (n1 + 0.5) / (n1 + 2 * n2 + 1)
    left = discount * (len(counts) + 1) / total
    worth = lambda w: math.log10(max(counts[w] - discount, 0) / total + left * math.exp(plain_forward(pieces, byte_ids, w, model.logp) + model.word_end))
    return worth, math.log10((len(texts) - discount) / total)


@pytest.mark.parametrize("texts", [["the cat sat"], [None], ["a a", "a", "b " + "z" * 90, "z" * 90, "é é ß"], WILD[:5] + WILD[7:]])
def test_lm_score_is_the_sum_over_the_lattice(spark, texts):
    pieces, byte_ids = load_pieces(MODEL)
    df = spark.createDataFrame(list(enumerate([*texts, "never seen", "z" * 91])), "doc_id long, text string")
    model = lm_scoring.fit(df, F.col("doc_id") < len(texts), MODEL)
    worth, end = plain_model(texts, pieces, byte_ids, model)
    for hot in (lm_scoring.HOT_WORDS, 0):
        for r in lm_scoring.score(df, model, hot=hot).join(df, "doc_id").collect():
            assert r.score == pytest.approx(sum(worth(w.decode()) for w in words(r.text)) + end, abs=1e-6)


def spellings(piece_ids, word):
    """All segmentations of a marked word into pieces."""
    if not word:
        return [[]]
    return [[piece_ids[word[:k]], *rest] for k in range(1, len(word) + 1) if word[:k] in piece_ids for rest in spellings(piece_ids, word[k:])]


def test_lm_piece_scores_are_those_of_all_segmentations(spark):
    pieces, _ = load_pieces(MODEL)
    piece_ids = {p: i for i, p in enumerate(pieces) if p}
    seen = ["the", "nation", "antics", "aaaa"]
    df = spark.createDataFrame([(0, " ".join(seen)), (1, "the the")], "doc_id long, text string")
    total = np.zeros(len(pieces))
    for w in seen:
        marked = MARK + w
        for i in range(len(marked)):
            for j in range(i + 1, len(marked) + 1):
                if marked[i:j] in piece_ids:
                    total[piece_ids[marked[i:j]]] += 1
    logp = np.log((total + 0.1) / (total.sum() + len(seen) + 0.1 * (len(pieces) + 1)))
    for passes in (1, 2):
        total = np.zeros(len(pieces))
        for w in seen:
            ways = spellings(piece_ids, MARK + w)
            worth = np.exp([logp[way].sum() for way in ways])
            for way, share in zip(ways, worth / worth.sum(), strict=True):
                np.add.at(total, way, share)
        logp = np.log((total + 0.1) / (total.sum() + len(seen) + 0.1 * (len(pieces) + 1)))
        assert np.allclose(lm_scoring.fit(df, F.lit(True), MODEL, passes=passes).logp, logp)


def test_lm_probabilities_of_words_sum_below_one(spark):
    df = docs(spark, ["a b", "a a", "b"])
    model = lm_scoring.fit(df, F.lit(True), MODEL)
    assert sum(10**r.worth for r in model.words.collect()) + 10**model.end_worth <= 1


# ---- op2 ----


def test_top_k(spark):
    rnd = random.Random(3)
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(60)]  # ties
    vectors += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, [0.5, 0.5]), (410, [0.25, 0.5]), (None, vectors[1][1])]
    vectors += [vectors[5], (50, vectors[50][1])]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in vectors], "vec_id long, embedding array<float>, dim int, ids int")
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    wanted = []
    for q, v in {i: v for i, v in fine if i % 50 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v))
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    got = vector_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [1e30, 3.0]), (3, [-1e30, 0.0]), (4, [-1e31, 0.0]), (5, [1e31, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vector_topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(5, 2**63 - 1), (2, 2**63 - 1), (1, 2**63 - 1), (3, -(2**63)), (4, -(2**63))]
    assert vector_topk.top_k(df.filter("false"), F.lit(True)).collect() == []


def test_top_k_query_hidden_by_an_unusable_row(spark):
    df = spark.createDataFrame([(50, [None, 1.0]), (50, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")
    got = vector_topk.top_k(df, F.col("vec_id") == 50).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(50, 1, 131072), (50, 2, 98304)]


def test_top_k_in_parts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "QUERY_BYTES", 500)
    monkeypatch.setattr(vector_topk, "BLOCK", 16)
    test_top_k(spark)


def test_top_k_reads_few_exact_vectors(spark, monkeypatch):
    """The exact file is asked for the rows that the bounds leave, not for all; equal vectors don't change that."""
    rnd = np.random.default_rng(0)
    x = rnd.normal(0, 0.2, (4000, 16))
    x[1000:2500] = x[7]
    asked = []
    whole = vector_topk._read
    monkeypatch.setattr(vector_topk, "_read", lambda wanted, exact, sent: asked.append(wanted.count()) or whole(wanted, exact, sent))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    got = vector_topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    e = np.floor(x * 256)
    wanted = []
    for q in range(0, 4000, 100):
        scores = e @ e[q]
        order = [i for i in np.lexsort((np.arange(4000), -scores)).tolist() if i != q][:5]
        wanted += [(q, r + 1, i, int(scores[i])) for r, i in enumerate(order)]
    assert sorted(map(tuple, got)) == wanted
    assert asked[0] == 40 * 5 and sum(asked) < 40 * 4000 / 50


def test_top_k_bounds_hold():
    rnd = np.random.default_rng(1)
    x = np.floor(rnd.normal(0, 60, (500, 24)))
    low = x.min(axis=0)
    width = np.maximum(1.0, np.ceil((x.max(axis=0) - low + 1) / 8))
    cells = np.minimum((x - low) // width, 7).astype(np.uint8)
    asks = vector_topk.Queries(np.arange(500), x, 3)
    best, seen = x @ x.T, np.zeros((500, 500), dtype=bool)
    for q, row, upper, lower in asks.scan(low, width, np.arange(500), cells):
        assert (lower <= best[q, row]).all() and (best[q, row] <= upper).all()
        seen[q, row] = True
    np.fill_diagonal(best, -np.inf)
    for q in range(500):
        assert seen[q, np.argsort(-best[q])[:3]].all() and asks.least()[q] <= np.sort(best[q])[-3]


# ---- op3 ----

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "user", None), (1, 2, "assistant", "<|end|><|start|>user<|text|>x"), (1, 3, "assistant", r"<\|loss|> \ <\\| [INST] </s> <s>"), (1, 4, None, "[/INST]<"),
    (2, 0, "assistant", "é" * 3000 + "<"), (2, 1, "<|text|>", "|end|>"), (3, 5, "user", "tie"), (3, 5, "assistant", "tie"), (3, 5, "user", "tie"), (None, None, None, None), (4, 0, "user", ""),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, turns string, formatted int")
    out = chat_format.format_conversations(df)
    read = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in out.select("conv_id", chat_format.read_conversations(F.col("formatted")).alias("turns")).collect()}
    by = {}
    for c, turn, role, text in TURNS:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert read == {c: [(r, t, r == "assistant") for _, r, t in sorted(turns)] for c, turns in by.items()}
    for r in out.collect():
        assert sum(m.chars for m in r.mask) + len(chat_format.END) == len(r.formatted)
        at, masked = 0, []
        for m in r.mask:
            masked += [r.formatted[at : at + m.chars]] * m.loss
            at += m.chars
        plain = re.sub(r"([<\[])\\(\\*)(\||/?s>|/?INST\])", r"\1\2\3", "\0".join(masked)).replace("\0", "")
        assert plain == "".join(t for _, role, t in sorted(by[r.conv_id]) if role == "assistant")
    one = chat_format.digest(out).filter("conv_id = 2").first()
    said = "".join(f"{r}\n{t}\n" for _, r, t in sorted(by[2]))
    assert one.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and one.n_turns == 2 and one.loss_chars == 3001
    assert chat_format.format_conversations(df.filter("false")).collect() == []
    # Neighbours of one role share a block.
    assert out.filter("conv_id = 1").first().formatted.count(chat_format.START) == 3


# ---- op4 ----

PAGE = """<html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies on this site for many good reasons, as every site does.</div>%s<aside>Side text, side text, side text, side text</aside>
<section id="comments"><article class="comment"><p>I disagree with all of this, says a reader at length.</p></article></section>
<form><label>Mail</label><input></form><script>if (a</b) {}</script><footer>&copy; Foot</footer></body></html>"""
BODY = "<h2>Head &amp; line</h2><p>First   part of\n the text,<br>long enough&nbsp;to count as main text of this page, yes.</p><div class=ad>Buy now and pay much later than you think, all of you</div><p>Last <b>bo</b>ld.</p>"
TEXT = "Head & line First part of the text, long enough to count as main text of this page, yes. Last bold."


def test_html(spark):
    pages = [PAGE % f"<article>{BODY}</article>", PAGE % f"<div id=content>{BODY}</div>", None, "", "just text", "<p>open<p>end<!-- never closed", "<article><h1>T</h1></article>", "<p>" + "long " * 50_000, "<div class='x", "<ul><li class=ad>Buy<li>One<li>Two</ul>"]
    df = spark.createDataFrame([(i, "u", p, "t", 1) for i, p in enumerate(pages)] + [(0, None, pages[0], "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()]
    wanted = [TEXT, TEXT, "", "", "just text", "open end", "T", ("long " * 50_000).strip(), "<div class='x", "One Two"]
    assert sorted(got) == sorted([(i, t, len(t)) for i, t in enumerate(wanted)] + [(0, TEXT, len(TEXT))])
    assert html_text.extract(df.filter("false")).collect() == []


P = "<p>" + "word " * 40 + "end.</p>"
LONG = ("word " * 40 + "end.").strip()
MENU = "<nav>" + "<a href=x>Menu</a><br>" * 5 + "</nav>"


@pytest.mark.parametrize(("page", "wanted"), [
    (f'<article>{P}<p class="related">Rel par</p><p id="legal">Legal par</p><p><a href=x>all of it a link</a></p><div class="ad">buy</div>{MENU}<p>Short.</p></article>', f"{LONG} Rel par Legal par all of it a link Short."),
    (f"<div id=content>{P}{MENU}<p>Short end.</p></div>", f"{LONG} Short end."),
    (f"{MENU}<article><h1>T</h1>{P}</article><article><h3>Teaser</h3><p>More</p></article>{MENU}<div>Elsewhere</div>", f"T {LONG}"),
    (f"<main><h1>Title</h1><article>{P}</article></main>", f"Title {LONG}"),
    (f"{P}{MENU}<div>Far away</div>", LONG),
    (f"<article><h3>Card</h3></article>{MENU}<div>{P}{P}</div>", f"{LONG} {LONG}"),
    ("<svg/><p>after</p>", "after"), ("<svg><text>no</text></svg><p>yes</p>", "yes"), ("<head><title>t</title><p>body</p>", "body"), ("<script>x", ""),
    ("<p>&#99999999999999999999; &#x41;&amp;lt;</p>", "\ufffd A&lt;"), ("<p>&#" + "1" * 9000 + ";x</p>", "\ufffdx"), ("<b>a<i>b</b>c", "abc"), ("a < b <c", "a < b <c"), ('<a "x>y</a>zzz', "yzzz"), ("<a>y</a>", ""),
])
def test_html_lines_are_weighed(page, wanted):
    assert html_text.main_text(page) == wanted


def plain_stretches(counts, window, surge):
    sums = [sum(counts[i : i + window]) for i in range(len(counts))]
    least = max(1, min(surge, max(sums, default=0)))
    found, i = [], 0
    while i < len(sums):
        j = i
        while j < len(sums) and sums[j]:
            j += 1
        if j > i and max(sums[i:j]) >= least:
            found.append((i, j))
        i = max(j, i + 1)
    return found


def test_html_surges_and_dives():
    rnd = random.Random(4)
    for _ in range(500):
        counts = [rnd.choice([0, 0, 0, rnd.randrange(1, 60)]) for _ in range(rnd.randrange(40))]
        window, surge = rnd.randrange(1, 6), rnd.choice([0, 1, 40, 80, 10_000])
        assert html_text.stretches(counts, window, surge) == plain_stretches(counts, window, surge)


def test_html_windows_decide():
    """Without windows or surges other text comes out, on marked pages too."""
    marked = f"<article>{P}</article><article><p>Teaser</p></article>"
    assert html_text.main_text(marked) == LONG != html_text.main_text(marked, surge=0) == f"{LONG} Teaser"
    spaced = f"<div>{P}</div><nav><p>1</p><p>2</p></nav><div>Near</div>"
    assert html_text.main_text(spaced) == f"{LONG} Near" != html_text.main_text(spaced, window=1) == LONG


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</b>" * 40_000, "<head>" * 400_000, "<!" * 2_000_000, '<a "' * 1_000_000 + '">', "<a '\">" * 700_000, "<div " + "a" * 4_000_000 + ">", "<" * 4_000_000, "<b x='\">" * 500_000, ("<script>" + "</style>") * 250_000, "<p " + " " * 4_000_000 + "x>"])
def test_html_hostile_pages_take_seconds(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 10


# ---- op5 ----


def test_mixing(spark):
    rnd = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        rows.append((i, " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(9)) for _ in range(40)) + (" vile rotten" * (kind == 2)) + (" click here" * (kind == 1)), "x", 0.0))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(None, "a1", "x", 0.0), (900, None, "x", 0.0), (901, "", "x", 0.0), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, rate string, _label_id double")
    known = spark.createDataFrame([*labels, labels[0], (5000, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.rate(df, known).collect()
    assert len(got) == len(rows)
    posteriors = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in got])
    assert np.allclose(posteriors.sum(axis=1), 1)
    right = [posteriors[k].argmax() == r.doc_id % 3 for k, r in enumerate(got) if r.doc_id is not None and r.doc_id < 600]
    assert np.mean(right) > 0.98
    n, rate = np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    assert (rate >= 0).all()
    reached = (posteriors * (n * rate)[:, None]).sum(axis=0) / n.sum()
    assert np.allclose(reached, [0.85, 0.10, 0.05], atol=1e-3)
    # A plain projected gradient from the same start ends where the distributed one does.
    a = posteriors.T * n
    weigh = np.linalg.pinv((a * (1 / np.maximum(n, 1))) @ a.T)
    r = np.ones(len(n))
    for _ in range(40):
        r = np.maximum(0, r - posteriors @ (weigh @ (a @ r - np.array([0.85, 0.10, 0.05]) * n.sum())))
    assert np.allclose(r[n > 0], rate[n > 0], atol=1e-2)
    kept = mixing.mixed(df, known)
    assert kept.columns == df.columns
    times = Counter(x.doc_id for x in kept.collect())
    for x in got:
        if x.doc_id not in (0, None):
            assert math.floor(x.rate) <= times[x.doc_id] <= math.floor(x.rate) + 1
    assert mixing.rate(df.filter("false"), known).collect() == []
    assert {round(x.p_clean, 6) for x in mixing.rate(df, known.filter("false")).collect()} == {0.333333}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mixing_reaches_its_targets_at_every_scale(spark, sf):
    source, known = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    told = known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    rows = mixing.rate(source, known).join(told, "doc_id", "left").collect()
    p = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in rows])
    n, r_ = np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    assert len(rows) == source.count() and len(np.unique(p.round(6), axis=0)) > len(rows) // 3
    assert np.allclose((p * (n * r_)[:, None]).sum(axis=0) / n.sum(), [0.85, 0.10, 0.05], atol=0.005)
    y = np.array([-1 if r.t is None else 2 if r.t else 1 - r.q for r in rows])
    assert (p.argmax(axis=1)[y >= 0] == y[y >= 0]).mean() > (y[y >= 0] == 0).mean() + 0.05


def test_mixing_says_what_it_cannot_reach(spark):
    df = spark.createDataFrame([(i, f"word{i} other") for i in range(20)], "doc_id long, text string")
    with pytest.warns(UserWarning, match="off their target"):
        rows = mixing.rate(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 20


CLASHES = [f"{p}_{c}" for p in ("_leak", "_mix", "_copies", "_simhash", "__leak", "__mix") for c in ("h", "g", "copies")] + ["h", "g", "id", "key", "fp", "ws", "b", "times", "len", "at", "rid", "domain", "n", "bands", "_simhash_content_of", "_leak_key", "_mix_words"]


@pytest.mark.parametrize("keep", [
    lambda df, bench, labels: decontaminate.clean(df, bench), lambda df, bench, labels: mixing.mixed(df, labels),
    lambda df, bench, labels: near_copies.representatives(df), lambda df, bench, labels: simhash.representatives(df),
], ids=["clean", "mixed", "near_copies", "simhash"])
def test_stages_keep_columns_whatever_their_names(spark, keep):
    plain = [(i, f"text number {i} of some with words {i * 7} and {i * 13}") for i in range(12)] + [(None, "no id here"), (50, None)]
    df = spark.createDataFrame(plain, "doc_id long, text string").select("doc_id", "text", *[F.concat(F.lit(c), F.col("text")).alias(c) for c in CLASHES])
    bench = spark.createDataFrame([("x", "text number 3 of some with words 21")], "item_id string, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)], "doc_id long, quality int, toxic int")
    got = keep(df, bench, labels)
    assert got.columns == df.columns
    rows, given = got.collect(), set(map(tuple, df.collect()))
    assert rows and set(map(tuple, rows)) <= given


# ---- op6 ----


def test_language_id(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(source, id_remainder(3) != 1, MODEL)
    held = source.filter(id_remainder(3) == 1)
    got = language_id.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    odd = docs(spark, [None, "", "123 456 !!", "und der die"])
    told = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert told[0] == told[1] == told[2] == ("und", 0.0) and told[3][0] in model.languages
    kept = language_id.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {3, None}
    assert language_id.identify(odd.filter("false"), model).collect() == []
    blank = language_id.fit(odd.filter("false"), F.lit(True), MODEL)
    assert {r.lang_pred for r in language_id.identify(odd, blank).collect()} == {"und"}


def test_language_posteriors_are_sums_over_segmentations(spark):
    pieces, byte_ids = load_pieces(MODEL)
    given = [("en", "the nation and the people of it"), ("en", "an article of the house"), ("de", "der und die das nicht"), ("de", "eine straße für alle"), ("fr", "le et la de une maison"), (None, "nobody knows")]
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(given * 3)], "doc_id long, lang string, text string")
    model = language_id.fit(df, F.lit(True), MODEL)
    asked = ["the house", "Straße die", "une nation", "日本 \U0001f600x", "maison maison 12", "z" * 70]
    told = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(asked):
        worth = [p + sum(plain_forward(pieces, byte_ids, w.decode(), model.logp[:, m]) for w in words(text)) for m, p in enumerate(model.prior)]
        posterior = np.exp(np.array(worth) - np.logaddexp.reduce(worth))
        assert told[i].lang_pred == model.languages[posterior.argmax()] and told[i].score == pytest.approx(posterior.max())
    assert model.languages == ["de", "en", "fr"] and np.allclose(np.exp(model.prior), [6 / 15, 6 / 15, 3 / 15])


def test_remembered_words_are_worth_the_same(lattice, monkeypatch):
    monkeypatch.setattr(lattice_module.Remembered, "KEPT", 40)
    rnd = np.random.default_rng(3)
    logp = np.log(rnd.dirichlet(np.ones(lattice.size), size=2).T)
    remembered = lattice_module.Remembered(lattice, logp)
    for _ in range(12):
        some = sorted({f"w{rnd.integers(60)}" for _ in range(30)} | {"y" * 80})
        assert np.allclose(remembered(pa.array(some, pa.large_string())), lattice.log_probability(some, logp))
        assert len(remembered.words) <= 40 and len(remembered.words) == len(remembered.worth) == len(remembered.hits)


# ---- op7 ----


def test_elias_fano_round_trip():
    rnd = np.random.default_rng(1)
    for counts in ([], [1], [0, 0, 5, 0], rnd.integers(1, 4, 1000), rnd.integers(0, 3000, 300), [1, 100_000, 1]):
        counts = np.array(counts, dtype=np.int64)
        ids = rnd.integers(0, 49_000 if len(counts) != 300 else 1 << 20, int(counts.sum())).astype(np.uint32)
        blob = token_output.encode_shard(ids, np.cumsum(counts))
        shard = token_output.Shard(blob)
        assert [shard.select(i) for i in range(len(counts))] == np.cumsum(counts).tolist()
        assert np.array_equal(shard.ids, ids)
        if len(counts) == 1000:
            assert len(blob) - 2 * len(ids) < 1000  # under eight bits for each document
            assert shard.document(17).tolist() == ids[counts[:17].sum() : counts[:18].sum()].tolist()


def test_token_files(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    assert len(plain.encode("a <|endoftext|> b", add_special_tokens=False).ids) == 3
    df = docs(spark, [*WILD, "a <|endoftext|> b", "x<|STARTOFTEXT|>y", "q<|startoftext|><|endoftext|>", "It's we'll  5a $$$"])
    for shard_ids in (token_output.SHARD_IDS, 50):
        shards = token_output.write_shards(df, public_path("word_bpe_49k.json"), shard_ids=shard_ids)
        got = sorted(token_output.read_documents(shards).collect(), key=lambda r: r.start)
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))  # repeats here repeat the text too
        at = 0
        for r, g in zip(rows, got, strict=True):
            ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            at += len(ids)
    assert token_output.read_documents(token_output.write_shards(df.filter("false"), public_path("word_bpe_49k.json"))).collect() == []


def test_token_files_of_repeated_ids(spark):
    """Equal ids lie beside each other across partitions, each text whole."""
    df = spark.createDataFrame([(i % 3, f"word{i} " * (i % 7)) for i in range(300)], "doc_id long, text string").repartition(8)
    got = sorted(token_output.read_documents(token_output.write_shards(df, public_path("word_bpe_49k.json"), shard_ids=64)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([0, 1, 2] * 100)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))


def test_encoder_memory_follows_its_ids():
    """Beside its ids (4 bytes each) an encoder of words met before needs little; whole columns of 64-bit places took over 40."""
    with open(public_path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_output.Encoder(f.read(), 1)
    text = pa.array([" ".join(["antidisestablishmentarianism"] * 70_000)] * 2)
    first = encoder(text)
    tracemalloc.start()
    ids, counts = encoder(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(ids, first[0]) and ids[: counts[0] - 1].reshape(70_000, -1).std(axis=0).max() == 0 and ids[counts[0] - 1] == 1
    assert len(ids) > 600_000 and peak < 25 * len(ids)


def test_workers_keep_one_operators_words(spark):
    """A worker that has met tasks of op7 and of the language ID does not keep what both remember."""
    df = docs(spark).repartition(8).localCheckpoint()
    model = language_id.fit(df, F.lit(True), MODEL)

    def kept(batches):
        found = sorted({type(x).__name__ for x in gc.get_objects() if isinstance(x, (token_output.Encoder, lattice_module.Remembered))})
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(found)])], ["found"])

    told = []
    for after in (lambda: token_output.write_shards(df, public_path("word_bpe_49k.json")), lambda: language_id.accepted(df, model).collect(), lambda: token_output.write_shards(df, public_path("word_bpe_49k.json"))):
        after()
        told += [r.found for r in df.mapInArrow(kept, "found string").collect()]
    assert {"Encoder", "Remembered"} <= set(told) <= {"", "Encoder", "Remembered"}
    assert {r.found for r in df.mapInArrow(common.tidied(kept), "found string").collect()} == {""}


def test_encoder_without_lower_casing():
    with open(public_path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = token_output.Encoder(f.read(), 1, lower=False)
    ids, counts = encoder(pa.array(["A b", None, "\x01 q\x01"]))
    assert counts[1] == 1 and ids[-1] == 1 and len(ids) == counts.sum()


# ---- op8 ----


def plain_hits(texts, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def test_decontamination(spark):
    rnd = random.Random(2)
    pool = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.choice([1, 3, 9, 10, 11, 40])))) for i in range(30)]
    items += [(90, "Aa, BB; cc!"), (91, "a a a a a a a a a a a"), (92, None), (93, "..."), (None, items[5][1]), (94, items[6][1])]
    texts = [*WILD, "a " * 500, "Straße É aa bb-CC dd"]
    for _ in range(40):
        w = [rnd.choice(pool) for _ in range(rnd.randrange(80))]
        other = rnd.choice(items)[1] or ""
        texts.append(" ".join([*w, *other.split()[rnd.randrange(3) :], *w[:5]]))
    df = docs(spark, texts)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h int")
    rows = df.collect()
    wanted = plain_hits([r.text for r in rows], items)
    got = decontaminate.contamination(df, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == sorted(((r.doc_id, *w) for r, w in zip(rows, wanted, strict=True)), key=str)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(r.text) for r, w in zip(rows, wanted, strict=True) if not w[1])
    assert decontaminate.contamination(df.filter("false"), bench).collect() == []
    assert {r.n_hit for r in decontaminate.contamination(df, bench.filter("false")).collect()} == {0}


def test_decontamination_by_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    test_decontamination(spark)


# ---- op9 ----

URLS = [
    "http://a.example.net/en/1", "HTTPS://Example.NET/EN/1", "https://example.com/de/x?y#z", "https://x.example.com/dex", "http://org/fr/", "http://a.org/fr", "http://net", "http://net/", "http://internet/",
    "http://b.net?x=/y", "no scheme", None, "", "://", "http://sub.free-bets.example.net", "http://free-bets.example.net/en/9", "http://notfree-bets.example.org/", "ftp://a..net/x", "x://q://z.net/", "http://" + "a." * 300 + "net/",
]


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for action, rule in rules:
        of, _, below = rule.partition("/")
        if host and (host == of or host.endswith("." + of)) and ("/" not in rule or path.startswith("/" + below)):
            fits.append((len(rule), rule, action))
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


HOSTS = [("block", "free-bets.example.net"), ("allow", "sub.free-bets.example.net"), ("block", "a..net/x"), ("allow", "net/"), ("block", "org"), ("allow", "z.net/")]


@pytest.mark.parametrize("rules", [url_filter.RULES, [*url_filter.RULES, *HOSTS], [("allow", "net/"), ("block", "net/")], [], [("block", "nowhere.example/")]])
@pytest.mark.parametrize("bits", [8, 1])
def test_url_verdicts(spark, monkeypatch, rules, bits):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", bits)
    df = spark.createDataFrame([(i, u, "k", "h") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, key string, host string")
    got = url_filter.judge(df, rules=rules).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i, h, p, r or "", v) for i, (h, p, r, v) in enumerate(plain_verdict(u, rules) for u in [*URLS, URLS[0]]))
    assert url_filter.judge(df.filter("false"), rules=rules).collect() == []


def test_url_verdicts_of_a_table_of_many_rules(spark):
    """However many keys are listed, the cascades decide."""
    many = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("action"), F.format_string("h%d.example/", "id").alias("rule"))
    df = spark.range(0, 600_000, 2).select(F.col("id").alias("page_id"), F.format_string("https://x.h%d.example/a?b", "id").alias("url"))
    got = url_filter.judge(df, rules=many)
    wrong = got.filter((F.col("verdict") != F.when((F.col("page_id") < 300_000) & (F.col("page_id") % 3 != 0), "block").otherwise("allow")) | (F.col("rule").isNotNull() != (F.col("page_id") < 300_000)))
    assert got.count() == 300_000 and wrong.count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    """Small filters err often, so several levels are needed; together they never do."""
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.filter(F.pmod(F.xxhash64("key"), F.lit(7)) == 0)
    levels = url_filter.build_cascade(universe, listed)
    assert len(levels) >= 3
    got = {r.key for r in universe.filter(url_filter.member(F.col("key"), levels)).collect()}
    assert got == {r.key for r in listed.collect()}
