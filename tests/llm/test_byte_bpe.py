import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from graphloom.llm import byte_bpe as B
from tests.llm.fixtures import documents, odd_rows

HOW = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tik():
    with open(HOW[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=HOW[1], mergeable_ranks=ranks, special_tokens={})


def test_as_tiktoken(tik):
    rng, bpe = random.Random(4), B.byte_bpe(*HOW)
    alphabet = " \t\n'sdtl re the aaa 1２é日本😀\x1c\x85　.,!꟎\U000323b5<|endoftext|>"
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = bpe.encode([t])[0]
        assert ids == tik.encode_ordinary(t) and bpe.decode(ids) == t


def test_offsets_and_split_characters(spark):
    bpe = B.byte_bpe(*HOW)
    t = "a😀é 日b"
    ids = bpe.encode([t])[0]
    spans = bpe.offsets(t, ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(a[0] <= b[0] for a, b in zip(spans, spans[1:]))
    assert any("�" in bpe.decode([i]) for i in ids) and bpe.decode(ids) == t
    rows = B.encode_rows(documents(spark, [(1, t), (2, None)]), *HOW, with_offsets=True).collect()
    assert {(r.doc_id, tuple(r.ids), tuple(r.starts)) for r in rows} == {(1, tuple(ids), tuple(s for s, _ in spans)), (2, (), ())}


def test_rows(spark, tik):
    rows = odd_rows()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.round_trip(documents(spark, rows), *HOW).collect())
    want = []
    for i, t in rows:
        ids = tik.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert B.round_trip(documents(spark, []), *HOW).count() == 0
    back = B.decode_rows(B.encode_rows(documents(spark, rows), *HOW), *HOW).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)


def test_remembered_pieces_share_ids():
    bpe = B.ByteBpe(*HOW)
    ids = bpe.encode(["zebra quokka", "zebra\nquokka quokkas"])
    assert max(map(max, ids)) > 256
    one = {}
    assert all(one.setdefault(i, i) is i for piece in bpe.seen.values() for i in piece) and len(bpe.seen) > 3
