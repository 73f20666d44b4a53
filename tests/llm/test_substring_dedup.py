import hashlib
import random
import re
from collections import Counter

from ledgerleaf.llm.substring_dedup import remove_repeats


def brute(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


def test_against_brute_force(make, odd_rows):
    got = Counter(map(tuple, remove_repeats(make(odd_rows)).collect()))
    assert got == brute(odd_rows, 35)
    assert sum(r[2] * n for r, n in got.items()) > 8000


def test_small_windows_and_branches(make):
    rows = [(1, "a b c d e f g h i j k l", None, None), (2, "z b c d e f g h i y k l", None, None), (3, "c d e f g q", None, None), (4, "a a a a a a a a a", None, None)]
    assert Counter(map(tuple, remove_repeats(make(rows), 5, 2).collect())) == brute(rows, 5)


def test_empty(make, odd_rows):
    assert remove_repeats(make(odd_rows).limit(0)).count() == 0


def thue_morse(a, b, doublings):
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_words_and_sequences_that_break_polynomial_hashes(make):
    """Complementary Thue-Morse sequences, as letters of one word and as words of a window."""
    tail = " ".join(f"t{i}" for i in range(34))
    letters = [f"{w} {tail}" for w in thue_morse("a", "b", 12)]
    words = [w.strip() for w in thue_morse("x ", "y ", 12)]
    rows = [(i, t, None, None) for i, t in enumerate(letters)]
    assert Counter(map(tuple, remove_repeats(make(rows)).collect())) == brute(rows, 35)
    assert all(r.n_removed == 0 for r in remove_repeats(make(rows)).collect())
    rows = [(i, t, None, None) for i, t in enumerate(words)]
    assert Counter(map(tuple, remove_repeats(make(rows)).collect())) == brute(rows, 35)


def test_ids_that_tell_nothing_and_long_texts(make):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, long = line(50), line(150_000)
    texts = [line(40) + " " + shared, shared, line(60), long, long[len(long) // 2 :], "y" * 300_000, None, ""] + [line(36) for _ in range(300)]
    for doc in (None, 7):
        rows = [(doc, t, None, None) for t in texts + texts[:2]]
        assert Counter(map(tuple, remove_repeats(make(rows)).collect())) == brute(rows, 35)
