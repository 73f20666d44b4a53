"""Mixing, personal data, I-Match and chat formatting against plain Python."""

import hashlib
import re

import pytest
from ledgerleaf.llm import chat, imatch, mixing, pii

WORD = r"[^\x20\x09-\x0D]+"


def python_plans(df):
    return [w for w in ("Python", "Pandas", "Arrow") if w in df._jdf.queryExecution().executedPlan().toString()]


def test_mix(make, odd_rows):
    rows = [(i, t, lang, s) for i, t, lang, s in odd_rows] + [(100 + i, "a b c", "en", "d") for i in range(50)]
    df = mixing.mix(make(rows))
    got = df.collect()
    assert not python_plans(df) and len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(WORD, t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    assert {r.source_size for r in got} == set(sizes.values())
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}
    assert all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(make(rows)).collect()))
    out = mixing.emit(make(rows))
    assert out.columns == [*make(rows).columns, "copy"]
    assert out.agg({"copy": "max"}).first()[0] <= 3
    assert mixing.mix(make(rows).limit(0)).count() == 0


def find(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


PRIVATE = [
    "write to a.b+c@mail-1.example.com, or x@y@z.org; é a@b.com_x@d.org.uk a@b @c.d a@b.",
    "at 1.2.3.4 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 007.001.255.0 v1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559 4111 1111 1111 1111 4111 12345678901234567890",
    "call +1 (555) 123-4567 or +49 30 1234567. +1 2 +123456789012345678 ++44 20 7946 0958",
    "日本 +1 (555) 123-4567日本 a@b.co 4111111111111111x",
    "mail me: bob [at] example [dot] com (555) 123-4567", "1" * 3000, "a." * 2000, "9 " * 2000,
]


def test_base_spans(make, odd_rows):
    rows = odd_rows + [(100 + i, t, "en", "a") for i, t in enumerate(PRIVATE)]
    df = pii.detect(make(rows))
    got = sorted(df.collect(), key=str)
    assert not python_plans(df)
    want = []
    for doc, text, *_ in rows:
        base = find(text)
        written = ",".join("%s:%d:%d" % s for s in base)
        want.append((doc, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(written.encode()).hexdigest()))
        have = [r.spans for r in got if (r.doc_id, r.base_sha256) == (doc, want[-1][-1])]
        assert have and all(set(written.split(",")) - {""} <= set(h.split(",")) for h in have)
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in got)
    assert pii.detect(make(rows).limit(0)).count() == 0


def test_redact(make):
    rows = [(1, "mail x@y.org now +1 (555) 123-4567!", "en", "a"), (2, None, None, None), (3, "nothing", "en", "a"), (3, "é 1.2.3.4", "en", "a")]
    out = pii.redact(make(rows))
    assert out.columns == make(rows).columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(1, "mail [EMAIL] now [PHONE]!"), (3, "nothing"), (3, "é [IP]")]
    assert pii.redact(make(rows).limit(0)).count() == 0


def codes(text):
    return sorted({hashlib.md5(w.encode()).hexdigest()[:15] for w in re.findall(WORD, text)})


@pytest.mark.parametrize("ranges", [4096, 3])
def test_imatch(make, odd_rows, monkeypatch, ranges):
    monkeypatch.setattr(imatch, "RANGES", ranges)
    monkeypatch.setattr(imatch, "ROWS", 2)
    monkeypatch.setattr(imatch, "MOST_ROWS", 7)
    rows = sorted({r[0]: r for r in odd_rows if r[0] is not None}.values())
    df = imatch.prints(make(rows), 0.1, 0.6)
    got = {r.doc_id: r for r in df.collect()}
    assert not python_plans(df) and len(got) == len(rows)
    texts = [t or "" for _, t, *_ in rows]
    seen = {}
    for t in texts:
        for c in codes(t):
            seen[c] = seen.get(c, 0) + 1
    band = {c for c, n in seen.items() if max(2, 0.1 * len(rows)) <= n <= max(2, 0.6 * len(rows))}

    def prints(text):
        all_codes = codes(text)
        kept = [c for c in all_codes if c in band] or all_codes
        sets = [kept] + [[c for c in kept if all(c[14 - o - s] in q for s in range(k + 1))] for k in range(5) for o in (0, 5) for q in ("0123", "4567", "89ab", "cdef")]
        return [hashlib.md5(",".join(s).encode()).hexdigest()[:8] if s else "-" for s in sets]

    def near(a, b):
        pairs = [(x, y) for x, y in zip(a, b) if (x, y) != ("-", "-")]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    for i, (doc, *_) in enumerate(rows):
        t, n = texts[i], texts[(i + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(prints(t)), "".join(prints(edited)))
        assert r.near_edited == pytest.approx(near(prints(t), prints(edited))) and r.near_next == pytest.approx(near(prints(t), prints(n)))


def test_imatch_odd_rows(make, odd_rows, monkeypatch):
    monkeypatch.setattr(imatch, "ROWS", 2)
    odd_rows = odd_rows + [(None, f"nameless {i}", "en", "a") for i in range(9)]
    got = imatch.prints(make(odd_rows)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in odd_rows), key=str)
    assert imatch.prints(make(odd_rows).limit(0)).count() == 0


ODD = ["", None, "a < b & c > d", "&amp; &lt;turn role=\"user\">", "</turn>\n", '<turn role="assistant">', "x\n\ny", "\\### Assistant: </turn> ok", "&quot;", "日本"]


def test_chat_reads_back(spark):
    rows = [(c, t, ("user", "assistant", "system", None, 'a"b')[(c + t) % 5], ODD[(c * 3 + t) % len(ODD)], "x") for c in range(12) for t in range(c + 1)] + [(None, 0, "user", "no id", "x"), (3, None, "assistant", "first", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    made = chat.formatted(chat.paths(chat.chain(df)))
    assert not python_plans(made)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.formatted(chat.paths(chat.chain(df.limit(0)))).count() == 0


def test_reply_trees_rank_branches(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", "more", 0.5), (1, 5, 2, "user", "thanks", None), (2, 9, 77, "user", "orphan", 1.0), (3, 1, 2, "u", "loop", 0.0), (3, 2, 1, "u", "loop", 0.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    got = sorted((r.tree, r["rank"], r.place, r.text) for r in chat.paths(df, top=2).collect())
    assert got == [(1, 1, 0, "q"), (1, 1, 1, "good"), (1, 1, 2, "thanks"), (1, 2, 0, "q"), (1, 2, 1, "bad"), (1, 2, 2, "more"), (2, 1, 0, "orphan")]
