import random
import re

import numpy as np
import pytest
from ledgerleaf.llm import similar_dedup
from ledgerleaf.llm.simhash_dedup import keep_first


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def firsts(rows):
    """The least doc_id of each group, by all pairs."""
    of = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(of[i], of[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        known = [x for x in (least.get(top(i)), doc) if x is not None]
        least[top(i)] = min(known) if known else None
    return [least[top(i)] for i in range(len(rows))]


def near_copies(r):
    """Texts with copies of 0.6 to 0.99, a chain of them, a large group, a line that most share."""
    vocabulary = [f"v{i}" for i in range(5000)]
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    notice, rows = line(12), []
    for base in range(30):
        words = line(r.choice([12, 40, 150, 400])) + notice
        for copy in range(4):
            edit = list(words)
            for _ in range(copy and r.randint(1, max(1, len(words) // 35))):
                edit[r.randrange(len(edit))] = r.choice(vocabulary)
            rows.append(" ".join(edit))
    words = line(120)
    for _ in range(60):
        edit = list(words)
        for _ in range(r.randint(0, 4)):
            edit[r.randrange(len(edit))] = r.choice(vocabulary)
        rows.append(" ".join(edit))
    for step in range(12):
        words = words[4:] + line(4)
        rows.append(" ".join(words).upper())
    r.shuffle(rows)
    return [(1000 + i, t, "en", "a") for i, t in enumerate(rows)]


@pytest.mark.parametrize("pairs", [8, 0])
def test_groups_are_those_of_all_pairs(make, odd_rows, monkeypatch, pairs):
    monkeypatch.setattr(similar_dedup, "PAIRS", pairs)
    rows = near_copies(random.Random(7)) + odd_rows
    want = firsts(rows)
    got = similar_dedup.near_groups(make(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((d, w) for (d, *_), w in zip(rows, want)), key=str)
    kept = keep_first(make(rows), similar_dedup.near_groups)
    assert kept.columns == make(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_empty(make, odd_rows):
    assert similar_dedup.near_groups(make(odd_rows).limit(0)).count() == 0
    assert keep_first(make(odd_rows).limit(0), similar_dedup.near_groups).count() == 0


def test_pipeline_stage_links_edited_copies(make, spark):
    import corpus_pipeline

    rows = near_copies(random.Random(11))
    kept = corpus_pipeline.distinct(spark, make(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(firsts(rows)))


def test_sketches_never_differ_in_more_than_the_sets():
    r = np.random.default_rng(5)
    for n, m, both in [(0, 0, 0), (1, 0, 0), (146, 146, 120), (146, 30, 30), (5000, 4800, 4700), (9, 9, 9)]:
        x, y, z = (r.integers(0, 1 << 64, size, np.uint64) for size in (n - both, m - both, both))
        a, b = np.concatenate([x, z]), np.concatenate([y, z])
        apart = sum(int(v).bit_count() for v in (similar_dedup.sketch(a) ^ similar_dedup.sketch(b)).view(np.uint64))
        assert apart <= n + m - 2 * both and (n + m - 2 * both - apart) % 2 == 0
