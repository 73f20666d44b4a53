import random

from ledgerleaf.llm import decontaminate


def test_quotes_of_long_items_at_any_offset(make, spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(100000)}" for _ in range(n)]
    items = {i: words(n) for i, n in enumerate([69, 73, 128, 128, 300, 65, 40])}
    docs, want = [], set()
    for i, item in items.items():
        for at in range(0, max(1, len(item) - 70), 3):
            docs.append((len(docs), " ".join(words(r.randint(0, 150)) + item[at : at + 71] + words(40)), "en", "s"))
            want.add((len(docs) - 1, i))
        for tail in (5, 9):
            docs.append((len(docs), " ".join(words(50) + item[-tail:] + words(50)), "en", "s"))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(make(docs), benchmark).collect()}
    assert got == want
    kept = {x.doc_id for x in decontaminate.clean(make(docs), benchmark).collect()}
    assert kept == {d for d, *_ in docs} - {d for d, _ in want}
