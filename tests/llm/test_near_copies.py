"""Near copies by five-word shingles, against a plain version that compares all pairs."""

import random

from burnish.llm import near_copies
from burnish.llm.common import table
from corpus_pipeline import one_of_each

SF = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_kept(rows):
    """Ids of the rows (id, text) that stay: the least of each connected group."""
    sets = [plain_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, (i is None, i)), (i is None, i), key=lambda k: (k[0], k[1] or 0))
    return sorted((i for _, i in least.values()), key=str)


def edited(rnd, words, n):
    out = list(words)
    for place in rnd.sample(range(len(words)), n):
        out[place] = f"x{rnd.randrange(10_000)}"
    return out


def texts():
    rnd = random.Random(3)
    out = [None, "", " \t ", "one", "ONE", "one two three four", "one two three  Four", "a b c d e", "e d c b a", "é È ß"]
    for _ in range(12):
        base = [f"w{rnd.randrange(900)}" for _ in range(200)]
        out.append(" ".join(base))
        # Few edits stay above four fifths, many fall below.
        out += [" ".join(edited(rnd, base, n)) for n in (1, 2, 3, 4, 5, 8, 20)]
    chain = [f"c{i}" for i in range(300)]  # each link is near, the ends are not
    for _ in range(12):
        out.append(" ".join(chain))
        chain = edited(rnd, chain, 4)
    crowd = [f"g{i}" for i in range(150)]
    return out + [" ".join(edited(rnd, crowd, 1 + i % 4)) for i in range(60)]


def test_representatives(spark):
    rows = list(enumerate(texts(), 5))
    rows += [rows[12], rows[12], (None, rows[14][1]), (None, "nobody else says these words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in near_copies.representatives(df).collect()]
    assert sorted(got, key=str) == plain_kept(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.representatives(df).collect() == []


def test_stage_of_the_pipeline(spark):
    docs = table(spark, SF, "documents")
    got = one_of_each(spark, docs, SF)
    assert got.columns == docs.columns
    wanted = plain_kept([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert sorted((r.doc_id for r in got.collect()), key=str) == wanted
