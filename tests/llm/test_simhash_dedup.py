import random
import re

import xxhash
from ledgerleaf.llm.simhash_dedup import fingerprint, keep_first, links, masks, near_groups, signed
from ledgerleaf.operators.graph import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, links_at):
    parent = {v: v for v in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if links_at(a, b):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {v: top(v) for v in values}


def test_fingerprints(odd_rows):
    for _, text, *_ in odd_rows:
        assert fingerprint(text) == brute_print(text)


def test_masks_cover_every_pair():
    tables = masks(2)
    for i in range(64):
        for j in range(i, 64):
            assert any(not m & (1 << i | 1 << j) for m in tables)


def test_links_join_exactly_what_is_near(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) % (1 << 64) for b in base for _ in range(12)} | set(base))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.node: r.component for r in components(links(df)).collect()}
    want = groups([signed(v) for v in values], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {v: found.get(v, v) for v in want} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (202, 201), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200, 202: 200}


def test_groups_and_first_rows(make, odd_rows):
    got = near_groups(make(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    prints = [brute_print(t) for _, t, *_ in odd_rows]
    of = groups(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for (doc, *_), p in zip(odd_rows, prints):
        known = [x for x in (first.get(of[p]), doc) if x is not None]
        first[of[p]] = min(known) if known else None
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((d, first[of[p]]) for (d, *_), p in zip(odd_rows, prints)), key=str)
    kept = keep_first(make(odd_rows))
    assert kept.columns == make(odd_rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_empty(make, odd_rows):
    assert near_groups(make(odd_rows).limit(0)).count() == 0
    assert keep_first(make(odd_rows).limit(0)).count() == 0
