import random
import re

import numpy as np
import pyarrow as pa

from graphloom.llm import common, textops
from graphloom.llm import near_dup as N
from graphloom.llm.components import components
from graphloom.shared import FILE_BYTES
from tests.llm.fixtures import WORDS, documents, odd_rows, text

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, rule):
    sets = [shingles(t, rule.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= rule.percent * (len(sets[a]) + len(sets[b]) - inter):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def family(rng, n, first):
    """Copies of one text with more and more words changed, a chain of them, and plain copies."""
    base = text(rng, 120).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append((first + i, " ".join(w)))
    for i in range(8):
        base[rng.randrange(len(base))] = f"new{i}"
        out.append((first + n + i, " ".join(base)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [r for r in odd_rows() if r[0] is not None] + family(rng, 60, 100) + family(rng, 30, 300) + [(500 + i, text(rng, 70)) for i in range(20)]
    rng.shuffle(rows)
    for rule in (N.Rule(3, 85), N.Rule()):
        got = N.near_duplicates(documents(spark, rows), rule).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, rule)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_null_ids_and_empty_table(spark):
    same, alone = text(random.Random(1), 50), text(random.Random(2), 50)
    rows = [(None, same), (7, same), (None, None), (None, alone), (None, alone)]
    got = N.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(7, 7, True), (None, 7, False), (None, None, True), (None, None, True), (None, None, True)], key=str)
    assert N.near_duplicates(documents(spark, [])).count() == 0


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(3)
    a, b = text(rng, 62), text(rng, 62)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (1, a)]
    got = sorted((r.doc_id, r.component_id) for r in N.near_duplicates(documents(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_texts_alike_to_a_linear_hash(spark):
    w = thue_morse(1024)
    other = w.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(documents(spark, [(1, w), (2, other), (3, w.upper())])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    buf = np.frombuffer((w + other).encode(), np.uint8)
    one, two = N.shingle_sets(buf, np.array([0, 1024, 2048]), 5)
    assert set(one.tolist()).isdisjoint(two.tolist())


def test_string_ids_in_mixed_buckets(spark):
    """Two families whose members share band keys with a head that they are not linked with, under ids of type string."""
    rng = random.Random(9)
    base = text(rng, 200).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice([8, 10, 12, 14])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((f"id{i:03d}", " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    run = N.Run(docs, N.Rule(3, 85))
    calls = []
    real, N.linked_across = N.linked_across, lambda *a: calls.append(1) or real(*a)
    try:
        N.links(run)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(docs, N.Rule(3, 85)).collect())
    finally:
        N.linked_across = real
    assert calls and got == brute(rows, N.Rule(3, 85))


def test_scratch_files_follow_size(spark):
    """However many shuffle partitions there are, a small table is written in no more files than there are cores."""
    rng = random.Random(14)
    rows = family(rng, 40, 100) + family(rng, 30, 300) + [(500 + i, text(rng, 70)) for i in range(60)]
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false", common.BATCH_KEY: "64m"}
    before, files, real = {k: spark.conf.get(k) for k in held}, [], common.write_shared

    def counted(s, df, name, *size):
        out, path = real(s, df, name, *size)
        files.append((name, len(out.inputFiles())))
        return out, path

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        common.write_shared = counted
        got = N.near_duplicates(documents(spark, rows).coalesce(1), N.Rule(3, 85)).collect()
        assert spark.conf.get(common.BATCH_KEY) == "64m"
    finally:
        common.write_shared = real
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, N.Rule(3, 85))
    cores = spark.sparkContext.defaultParallelism
    assert len(files) > 15 and not [f for f in files if f[0] != "across" and f[1] > cores]


def test_larger_scratch_tables_have_more_files(spark):
    many, cores = spark.range(0, 1000, 1, 40), spark.sparkContext.defaultParallelism
    for size, files in ((0, cores), (30 * FILE_BYTES - 1, 30), (99 * FILE_BYTES, 40), (None, 40)):
        out, path = common.write_shared(spark, many, "sized", size)
        assert len(out.inputFiles()) == files and out.count() == 1000
        common.drop_shared(spark, path)


def test_recall_of_bands_and_pruning():
    """All pairs at or above the similarity share a band and pass the looks, on stored bytes; unlike long texts are pruned."""
    rng, rule = random.Random(12), N.Rule(3, 85)
    texts = []
    for _ in range(25):
        base = text(rng, rng.randint(30, 900)).split()
        for k in range(6):
            w = list(base)
            for _ in range(k * len(w) // 120):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    sets = [s for _, _, buf, offs in textops.slices(batch, "text") for s in N.shingle_sets(buf, offs, rule.words)]
    times = N._odd(N.HASHES, 23, np.uint32)
    full = np.array([N.signature(s, times) for s in sets])
    sig, keys = N.stored(full), full[:, : rule.rows * N.BANDS].reshape(len(sets), N.BANDS, rule.rows)
    x, y = np.triu_indices(len(sets), 1)
    linked = np.array([N._linked(sets[a], sets[b], rule) for a, b in zip(x, y)])
    met = np.array([(keys[a] == keys[b]).all(axis=1).any() for a, b in zip(x, y)])
    alive = np.zeros(len(x), bool)
    alive[N.pruned(sig, sig, x, y, N._steps(rule))] = True
    assert linked.sum() > 100 and (met & alive)[linked].mean() >= 0.99
    assert alive[~linked].mean() < 0.05


def test_signature_estimates():
    rng = random.Random(2)
    a = text(rng, 400)
    b = " ".join(rng.choice(WORDS) if rng.random() < 0.03 else w for w in a.split())
    batch = pa.RecordBatch.from_arrays([pa.array([a, b])], ["text"])
    _, _, buf, offs = next(textops.slices(batch, "text"))
    x, y = N.shingle_sets(buf, offs, 5)
    real = len(shingles(a, 5) & shingles(b, 5)) / len(shingles(a, 5) | shingles(b, 5))
    times = N._odd(N.HASHES, 23, np.uint32)
    assert len(x) == len(shingles(a, 5))
    assert abs((N.signature(x, times) == N.signature(y, times)).mean() - real) < 0.08


def test_posterior_bound():
    from math import comb

    steps, p = N._steps(N.Rule(5, 80)), 0.8 + 0.2 / 256
    for n, least in steps:
        tail = lambda m: sum(comb(n + 1, k) * p**k * (1 - p) ** (n + 1 - k) for k in range(m + 1))
        assert tail(least) >= N.MISS / len(steps) and (least == 0 or tail(least - 1) < N.MISS / len(steps))
    for rule in (N.Rule(), N.Rule(3, 85)):
        assert (1 - rule.least**rule.rows) ** N.BANDS < 1e-5


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(50)] + [(1, 1), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.u: r.v for r in components(spark, spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
