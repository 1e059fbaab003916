import random

import numpy as np

from graphloom.llm import lm_score as L
from tests.llm.fixtures import WORDS, documents, odd_rows, text


def test_gradient_step_lowers_loss():
    rng = np.random.default_rng(0)
    net = L.Network()
    token = rng.integers(0, 20, 4000)
    context = np.stack([token, (token + 1) % 20, (token + 2) % 20, rng.integers(0, 20, 4000)])
    before = net.score(context, token).mean()
    for i in range(0, 4000, 500):
        net.train(context[:, i : i + 500], token[i : i + 500], L.RATE)
    assert net.score(context, token).mean() > before + 0.5
    every = np.stack([net.score(context[:, :50], np.full(50, w)) for w in range(L.VOCABULARY)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    net.out[:, 3] += 100  # large scores are shifted first
    assert np.isfinite(net.score(context, token)).all()


def test_scores_add_up_and_order(spark):
    rng = random.Random(1)
    rows = odd_rows() + [(2000 + i, " ".join(WORDS[(j * 7 + i) % 40] for j in range(300))) for i in range(60)] + [(5000, " ".join(f"zz{i}" for i in range(100)))]
    docs = documents(spark, rows)
    flat, vocabulary = L.fit(docs, rounds=2)
    got = {(r.doc_id, r.n_tokens): r for r in L.score(docs, flat, vocabulary).collect()}
    net = L.Network(flat)
    for i, t in rows:
        n = len((t or "").split())
        r = got[i, n]
        if not n:
            assert r.log_p == 0 and r.mean_log_p is None
            continue
        data = np.frombuffer((t or "").encode(), np.uint8)
        context, token, _ = L.numbered(data, np.array([0, len(data)]), vocabulary)
        padded = [L.BOUNDARY] * L.WINDOW + token.tolist() + [L.BOUNDARY] * L.WINDOW
        for k in range(min(n, 400)):
            near = padded[k : k + 2 * L.WINDOW + 1]
            assert near[: L.WINDOW] + near[L.WINDOW + 1 :] == context[:, k].tolist()
        one = sum(float(net.score(context[:, k : k + 1], token[k : k + 1])[0]) for k in range(n))
        assert abs(r.log_p - one) < 1e-2 * max(1, n) and abs(r.mean_log_p - r.log_p / n) < 1e-9
    assert min(r.mean_log_p for (i, _), r in got.items() if i and 2000 <= i < 3000) > got[5000, 100].mean_log_p
    assert L.score(documents(spark, []), *L.fit(documents(spark, []))).count() == 0


def test_counts_cover_all_rows(spark):
    rows = [(i, text(random.Random(i), 30)) for i in range(50)]
    total = L.count_words(documents(spark, rows)).agg({"n": "sum"}).first()[0]
    assert total == 50 * 30


def test_every_counted_word_has_its_own_share(spark):
    """The vocabulary follows the counts, and the words of a class share its probability by them."""
    rows = [(i, " ".join(f"w{j}" for j in range(i % 2, 700 * (1 + i % 2))) + " w1399 w1398 once" + str(i)) for i in range(2 * L.LEAST)]
    docs = documents(spark, rows)
    flat, vocabulary = L.fit(docs)
    assert len(vocabulary) == 1400  # 192 before, however many words the rows had
    small = L.fit(documents(spark, rows[: L.LEAST]))[1]
    assert len(small) < len(vocabulary)
    every = [f"w{j}" for j in range(1400)] + [f"once{i}" for i in range(2 * L.LEAST)]
    data = np.frombuffer(" ".join(every).encode(), np.uint8)
    token = L.numbered(data, np.array([0, len(data)]), vocabulary)[1]
    assert len(set(token[:1400].tolist())) == 1400
    net = L.Network(flat)
    context = np.full((2 * L.WINDOW, len(token)), L.BOUNDARY)
    p = dict(zip(every, np.exp(net.score(context, token))))
    # In one context all words sum to one, but for the boundary and a little kept for words that no row had.
    none = np.exp(net.score(context[:, :1], np.array([L.BOUNDARY])))[0]
    assert 0.9 < sum(p.values()) + none < 1.001
    of = {w: int(c) for w, c in zip(every, L.classes(token))}
    often = next(w for w in every[1000:1398] if of[w] >= L.OWN and any(of[x] == of[w] for x in every[1400:]))
    rare = next(x for x in every[1400:] if of[x] == of[often])
    assert abs(np.log(p[often] / p[rare]) - np.log(L.LEAST)) < 0.5  # equal before


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    """Equal weights and scores for any partitions and order of rows, for Arrow batches of any size, with shards averaged in levels."""
    monkeypatch.setattr(L, "SHARD_TOKENS", 1500)
    monkeypatch.setattr(L, "FAN", 2)
    rng = random.Random(5)
    rows = odd_rows() + [(100 + i, text(rng, rng.randint(1, 90))) for i in range(300)] + [(900, "a hot text")] * 60
    docs = documents(spark, rows)
    flat, vocabulary = L.fit(docs.coalesce(1))
    assert not np.array_equal(flat[: L.Network.SIZE], L.Network().flat)
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.log_p, 2))
    want = sorted(L.score(docs, flat, vocabulary).collect(), key=key)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        other = L.fit(documents(spark, rng.sample(rows, len(rows))).repartition(8))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.array_equal(flat, other[0]) and np.array_equal(vocabulary, other[1])
    got = sorted(L.score(docs.repartition(8), *other).collect(), key=key)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(r.doc_id, r.n_tokens) for r in want]
    assert np.allclose([r.log_p for r in got], [r.log_p for r in want], rtol=1e-6)  # sums of a batch round by its size


def test_copies_are_weights():
    """A text of three copies moves the weights like a batch that holds it three times."""
    rng = np.random.default_rng(2)
    context, token = rng.integers(0, 50, (4, 40)), rng.integers(0, 50, 40)
    copies = np.repeat([1.0, 3.0], 20)
    one, many, every = L.Network(), L.Network(), np.repeat(np.arange(40), copies.astype(int))
    one.train(context, token, L.RATE, copies)
    many.train(context[:, every], token[every], L.RATE)
    assert np.allclose(one.flat, many.flat, atol=1e-5)


def test_forward_by_hand():
    """A forward pass written out for one token at a time, and gradients by finite differences."""
    rng = np.random.default_rng(3)
    net = L.Network(rng.normal(0, 0.3, L.Network.SIZE))
    context, token = rng.integers(0, L.VOCABULARY, (4, 6)), rng.integers(0, L.OWN, 6)

    def loss(flat):
        at, parts = 0, []
        for shape in L.Network.SHAPES:
            parts.append(flat[at : at + int(np.prod(shape))].reshape(shape))
            at += int(np.prod(shape))
        embed, bias, out, out_bias = parts
        total = []
        for i in range(6):
            hidden = np.tanh(bias + sum(embed[k, context[k, i]] for k in range(4)))
            scores = hidden @ out + out_bias
            total.append(scores[token[i]] - np.log(np.sum(np.exp(scores))))
        return np.array(total)

    flat = net.flat.astype(np.float64)
    assert np.allclose(net.score(context, token), loss(flat), atol=1e-4)
    before = flat.copy()
    net.train(context, token, 1e-2)
    step = (before - net.flat) / 1e-2
    sizes = np.cumsum([0] + [int(np.prod(s)) for s in L.Network.SHAPES])
    for part in range(4):
        for i in rng.choice(np.flatnonzero(np.abs(step[sizes[part] : sizes[part + 1]]) > 1e-3), 3) + sizes[part]:
            up, down = before.copy(), before.copy()
            up[i] += 1e-4
            down[i] -= 1e-4
            slope = -(loss(up).mean() - loss(down).mean()) / 2e-4
            assert abs(step[i] - (10 if part == 0 else 1) * slope) < 2e-2 * max(1, abs(step[i]))
