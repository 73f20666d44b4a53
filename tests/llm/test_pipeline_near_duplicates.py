import random

import corpus_pipeline
from test_similar_dedup import near_copies, shingles, similar
from test_simhash_dedup import brute_print


def repeating(r):
    """Pages of one line, over and over, with an end of their own: near by SimHash, which counts repeats, not by their sets."""
    vocabulary = [f"r{i}" for i in range(3000)]
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = []
    for _ in range(6):
        again = line(12) * 150
        rows += [" ".join(again + line(14)) for _ in range(4)]
    r.shuffle(rows)
    return [(5000 + i, t, "en", "a") for i, t in enumerate(rows)]


def firsts(rows, linked):
    """The least doc_id of each group, by all pairs of rows."""
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(i, j):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        known = [x for x in (least.get(top(i)), doc) if x is not None]
        least[top(i)] = min(known) if known else None
    return set(least.values())


def test_stage_takes_the_links_of_simhash_and_of_similarity(make, spark, odd_rows):
    rows = repeating(random.Random(5)) + near_copies(random.Random(13)) + odd_rows
    of, prints = [shingles(t) for _, t, *_ in rows], [brute_print(t) for _, t, *_ in rows]
    by_print = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2
    by_set = lambda i, j: similar(of[i], of[j])
    want = firsts(rows, lambda i, j: by_print(i, j) or by_set(i, j))
    assert len(want) < len(firsts(rows, by_set)) and len(want) < len(firsts(rows, by_print))
    kept = corpus_pipeline.distinct(spark, make(rows), "")
    assert kept.columns == make(rows).columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(want)


def test_stage_of_rows_that_nothing_links(make, spark):
    r = random.Random(3)
    rows = [(i, " ".join(f"u{r.randrange(10**6)}" for _ in range(30)), "en", "a") for i in range(20)]
    assert corpus_pipeline.distinct(spark, make(rows), "").count() == 20
    assert corpus_pipeline.distinct(spark, make(rows).limit(0), "").count() == 0
