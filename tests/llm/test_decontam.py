import random

from graphloom.llm import decontam as D
from tests.llm.fixtures import documents, odd_rows, text


def edits_within(t, p, k):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j - 1] + (t[j - 1] != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) if min(row) <= k else None


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, text(rng, rng.randint(6, 40))) for i in range(8)] + [(8, "Über Maß, 日本語 日本語 日本語!"), (9, None), (10, "short"), (11, "")]
    items.append((12, items[0][1]))
    rows = odd_rows()
    for i in range(40):
        w = list(rng.choice(items[:9])[1])
        for _ in range(rng.randint(0, 1 + len(w) // 14)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], ["q"], [w[p], "z"], [w[p].upper(), " ,"]])
        rows.append((1000 + i, f"{text(rng, rng.randint(0, 25))}. {''.join(w)}; {text(rng, rng.randint(0, 25))}"))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = set()
    for d, t in rows:
        doc = D.normal_bytes(t or "").tobytes()
        for i, x in items:
            p = D.normal_bytes(x or "").tobytes().strip()
            if len(p) >= D.Q and (e := edits_within(doc, p, D.edit_budget(len(p)))) is not None:
                want.add((str(d), i, e))
    for block in (10_000, 200):
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        got = {(str(r.doc_id), r.item_id, r.edits) for r in D.find_items(documents(spark, rows), bench).collect()}
        assert got == want and len(want) > 20
    assert D.find_items(documents(spark, rows), bench.limit(0)).count() == 0
    assert D.find_items(documents(spark, []), bench).count() == 0


def test_normalise():
    assert D.normal_bytes("  A,b\n\n#C é!").tobytes().decode() == " a b c é "


def test_string_ids_and_periodic_texts(spark, monkeypatch):
    """Passages that repeat on both sides multiply out in bounded parts, with equal results; ids may be strings."""
    rng = random.Random(6)
    item = "abc def ghi jkl " * 40
    bench = spark.createDataFrame([("p", item), ("q", text(rng, 20)), (None, text(rng, 20))], "item_id string, text string")
    docs = documents(spark, [(1, "x " + "abc def ghi jkl " * 300), (2, "abc def ghi jkl " * 20), (3, text(rng, 50))])
    show = lambda: sorted((r.doc_id, r.item_id, r.edits) for r in D.find_items(docs, bench).collect())
    want = show()
    monkeypatch.setattr(D, "HITS", 1000)
    assert show() == want == [(1, "p", 0)]
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    monkeypatch.setattr(D, "GROUP_BYTES", 500)
    assert show() == want
