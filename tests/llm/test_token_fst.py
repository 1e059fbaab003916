import random
import time

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from graphloom.llm import textops, token_fst
from tests.llm.fixtures import documents, odd_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def counts(fst, texts, most):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    return [n for _, _, buf, offs in textops.slices(batch, "text", most) for n in fst.count_slice(buf, offs).tolist()]


def test_random_texts(sp):
    rng = random.Random(1)
    alphabet = "ab theion  \n\t ▁éü日本語ﬁ😀.,'-0123ABCthe<s>"
    texts = ["", " ", None, " " * 40, "x" * 1500, "the" * 400, "a" * 513 + " b", " " * 700 + "x", "<s></s><0x41>"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 700))) for _ in range(150)]
    want = [len(x) for x in sp.encode([t or "" for t in texts])]
    fst = token_fst.Transducer(PATH)
    assert counts(fst, texts, 1 << 20) == counts(fst, texts, 900) == want


def test_full_table_starts_anew(sp):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüß ") for _ in range(600)) for _ in range(40)]
    fst = token_fst.Transducer(PATH, most_cells=200_000)
    assert counts(fst, texts, 2000) == [len(x) for x in sp.encode(texts)]


def test_pairs_left_apart(sp):
    fst = token_fst.Transducer(PATH)
    rng = random.Random(3)
    ids = [t for t in fst.text if len(fst.text[t]) == 1 or t in fst.split]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert fst._apart(a, b) == (fst._tokens(fst.text[a] + fst.text[b]) == [a, b])


def test_rows(spark, sp):
    rows = odd_rows()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_fst.count_tokens(documents(spark, rows), PATH, limit=100).collect())
    want = [(str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows]
    assert got == sorted((*x, x[2] > 100) for x in want)
    assert token_fst.count_tokens(documents(spark, []), PATH).count() == 0


def test_long_texts_without_spaces():
    """Chunks without a resetting place are composed by their state maps, in time about linear in the text."""
    rng = random.Random(8)
    fst = token_fst.transducer(PATH)
    letters = "etaoinshrdlucmfwypvbgk"
    base = "".join(rng.choice(letters) for _ in range(300_000))
    texts = [base, "a" * 20_000, "abc" * 9_000 + base[:5_000] + "=" * 9_000, "é".join(base[:50_000].split("e")), " " * 5_000 + base[:2_000], "日本" * 3_000 + base[:3_000], base[:700]]
    data = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    began = time.monotonic()
    got = fst.count_slice(np.frombuffer(b"".join(data), np.uint8), offs).tolist()
    assert time.monotonic() - began < 60
    assert got == [len(fst.sp.encode(t)) for t in texts]
