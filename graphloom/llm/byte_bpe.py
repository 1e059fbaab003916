"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary comes as ranks of byte strings.  Every byte is mapped to a printable character; every
split of a token into two tokens becomes a merge, in the order of the tokens' ranks, so that the library
joins whatever neighbours form the token of least rank.  Texts are split by the pattern; distinct pieces
of a slice are encoded once and remembered by the Python worker up to ``MOST_PIECES``.  Decoding turns ids
into characters and those back into bytes; a character whose bytes are split over tokens is
whole again once all its tokens are decoded (alone, such a token decodes to a replacement character).

Defined cases: null and empty text give no ids and decode to empty; repeated rows give equal results; other
columns are dropped unless ``keep`` names them; strings of special tokens are ordinary text; texts are
never cut: a slice holds whole texts, and memory is bounded by the slice and the longest text.
"""
from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, textops

MOST_PIECES = 200_000
#: The first code point, and its first UTF-8 byte, of those that younger Unicode versions added as letters or numbers.
NEW_FROM, NEW_BYTE = 0x540, 0xD5


def byte_characters() -> list[str]:
    """The character of each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        chars = byte_characters()
        shown = lambda t: "".join(chars[b] for b in t)
        merges = [(shown(t[:k]), shown(t[k:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.model = Tokenizer(models.BPE({shown(t): r for t, r in ranks.items()}, merges, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # White space is stated as the Unicode property, as tiktoken's engine has it.
        self.source = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.given, self.pattern, self.careful = pattern, regex.compile(self.source), None
        back = {c: b for b, c in enumerate(chars)}
        self.bytes = {r: bytes(back[c] for c in shown(t)) for t, r in ranks.items()}
        self.id = {r: r for r in self.bytes}  # one object per id, which all remembered pieces share
        self.seen: dict[str, tuple[int, ...]] = {}

    @cached_property
    def decimal(self) -> dict[int, str]:
        return {r: str(r) for r in self.bytes}

    def _careful(self):
        """The pattern with letters and numbers as tiktoken's older Unicode tables have them."""
        if self.careful is None:
            import unicodedata

            import regex
            import tiktoken

            known = regex.compile(r"[\p{L}\p{N}]")
            doubtful = [chr(c) for c in range(NEW_FROM, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
            joined: set[str] = set()
            for lead in ("a", "1"):  # a character of the lead's class stays in its piece, where merges make them one token
                ranks = {bytes([b]): b for b in range(256)}
                for c in doubtful:
                    whole = (lead + c).encode()
                    for k in range(2, len(whole) + 1):
                        ranks.setdefault(whole[:k], len(ranks))
                probe = tiktoken.Encoding("probe", pat_str=self.given, mergeable_ranks=ranks, special_tokens={})
                joined |= {c for c in doubtful if len(probe.encode_ordinary(lead + c)) == 1}
            other = "".join(c for c in doubtful if c not in joined)
            source = self.source.replace(r"[^\p{White_Space}\p{L}\p{N}]", "OTHER").replace(r"\p{L}", f"[\\p{{L}}--[{other}]]").replace(r"\p{N}", f"[\\p{{N}}--[{other}]]")
            self.careful = regex.compile(source.replace("OTHER", f"[[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]||[{other}]]"), regex.V1)
        return self.careful

    def encode(self, texts: list[str], newest: bool = True) -> list[list[int]]:
        """Ids of each text; ``newest``: whether characters from ``NEW_FROM`` on may occur."""
        findall = (self._careful() if newest else self.pattern).findall
        pieces = [findall(t) for t in texts]
        seen = self.seen
        new = [p for p in set(chain.from_iterable(pieces)) if p not in seen]
        if len(seen) + len(new) > MOST_PIECES:
            seen.clear()
            new = list(set(chain.from_iterable(pieces)))
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            seen.update(zip(part, (tuple(map(self.id.__getitem__, e.ids)) for e in self.model.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [list(chain.from_iterable(map(seen.__getitem__, p))) for p in pieces]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that form no character become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """The code points each token touches; tokens that share a split character all have it."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        point = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes[i]) for i in ids]).tolist()
        return [(int(point[s]), int(point[e - 1]) + 1) for s, e in zip([0, *ends], ends, strict=False)]


_made: dict[tuple[str, str], ByteBpe] = textops.keep("byte_bpe", {})


def byte_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    textops.claim("byte_bpe")
    if (ranks_path, pattern) not in _made:
        _made[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
        textops.trim()  # the merges as Python objects
    return _made[ranks_path, pattern]


def encode_rows(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_offsets: bool = False, text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` and, if asked, ``starts`` and ``ends`` (code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            for i, j, buf, offs in textops.slices(batch, "__text"):
                texts = _texts(buf, offs)
                ids = bpe.encode(texts, _newest(buf))
                cols = [pa.array(ids, pa.list_(pa.int32()))]
                if with_offsets:
                    spans = [bpe.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                    cols += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *cols], [*keep, "ids", *(["starts", "ends"] if with_offsets else [])])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "ids array<int>", *(["starts array<int>", "ends array<int>"] if with_offsets else [])])
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def _newest(buf: np.ndarray) -> bool:
    return bool(len(buf)) and int(buf.max()) >= NEW_BYTE


def _texts(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    data = buf.tobytes()
    return [data[a:b].decode("utf-8") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def decode_rows(rows: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``text`` of ``ids``; null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "ids").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "text string"]))


def encode_and_check(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids`` and whether the decoded ids are the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            for i, j, buf, offs in textops.slices(batch, "__text"):
                texts = _texts(buf, offs)
                ids = bpe.encode(texts, _newest(buf))
                same = [bpe.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], [*keep, "n_tokens", "ids", "round_trip"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens long, ids array<int>, round_trip boolean"])
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every row, decode its ids, and return the count and both digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for _, _, buf, offs in textops.slices(batch, "__text"):
                for ids in bpe.encode(_texts(buf, offs), _newest(buf)):
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    text_hex.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[key]
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("__text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.ship(spark)
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
