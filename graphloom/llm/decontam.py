"""Benchmark decontamination by the q-gram lemma, with banded alignment.

Texts are normalised: ASCII letters lower-cased, every run of ASCII characters that are no letters or digits
one space; characters are UTF-8 bytes of that.  An item of ``m`` characters may be found with at most
``k = EDITS * m`` edits.  An occurrence within ``k`` edits shares at least ``m - Q + 1 - k * Q`` q-grams with
the item, on diagonals (text position less item position) no further apart than ``2 * k``.  Diagonals are
dealt into overlapping bands, each two steps of ``2 * k + 1`` wide and one step after the last, so one band holds
all of them.  Bands that reach the bound are verified by an alignment that stays within the band.

A benchmark of up to ``BLOCK_BYTES`` is broadcast as one block.  A larger one never passes through the driver: its distinct
texts are dealt into blocks of that size.  An item with ``k`` edits holds ``k + 1`` disjoint q-grams, its anchors, and one edit
touches one of them at most, so a text that holds the item holds one of its anchors.  One scan of the documents keeps rows that hold
an anchor (a Bloom filter of at most ``2 ** BLOOM_BITS`` bits, then an exact join on the hash), and a row meets only
the blocks whose anchors it holds, dealt into groups of about ``GROUP_BYTES``.  A text is never cut; shared q-grams are counted per
slice of whole texts, ``HITS`` pairs of places at a time, so repeated passages on both sides need no more memory.

Defined cases: null and empty texts contain nothing; null items and items under ``Q`` normalised characters
cannot be told from chance and match nothing; equal items and repeated rows are each reported; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, textops

Q = 12
EDITS = 0.05
BLOCK_BYTES = 4_000_000
FILTER_BITS = 22
#: The most bits, as a power of two, and the probes of the filter of anchors.
BLOOM_BITS = 29
PROBES = 3
#: Bytes of texts that meet a block in one group.
GROUP_BYTES = 32_000_000
#: Pairs of places (of a text and an item) that are held at once.
HITS = 2_000_000


def normalise(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes of a slice and their row offsets."""
    b = textops.LOWER[buf]
    word = ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128)
    keep = word.copy()
    if len(b):
        keep[1:] |= word[:-1]  # the first character of a run that is no word
        keep[offs[:-1][offs[:-1] < len(b)]] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return np.where(word, b, np.uint8(32))[keep], at[offs]


def normal_bytes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return normalise(data, np.array([0, len(data)]))[0]


def edit_budget(m: int, edits: float = EDITS) -> int:
    """The edits allowed to an item, fewer where the lemma's bound would fall under one shared q-gram."""
    return max(0, min(int(edits * m), (m - Q) // Q))


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows sorted by all columns but the last, which is summed over equal ones."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    at = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
    return np.concatenate((rows[at, :3], np.add.reduceat(rows[:, 3], at)[:, None]), axis=1)


class Block:
    """The q-grams of some items: a bit table for a first look, and sorted hashes with their places."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float):
        self.ids = [i for i, _ in items]
        self.text = [np.frombuffer(t, np.uint8) for _, t in items]
        size = np.array([len(t) for t in self.text], np.int64)
        self.size, self.k = size, np.array([edit_budget(int(m), edits) for m in size], np.int64)
        self.bound = size - Q + 1 - self.k * Q
        h, item, pos = [], [], []
        for i, t in enumerate(self.text):
            n = len(t) - Q + 1
            h.append(textops.Hashes(t).grams(Q))
            item.append(np.full(n, i))
            pos.append(np.arange(n))
        h, item, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, item, pos))
        order = np.argsort(h, kind="stable")
        h, self.item, self.pos = h[order].astype(np.uint64), item[order].astype(np.int32), pos[order].astype(np.int32)
        self.first, self.times = textops.runs(h)
        self.grams = h[self.first]
        self.shift = np.uint64(64 - FILTER_BITS)
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[self.grams >> self.shift] = True

    def bands(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows of ``(row, item, band, shared q-grams)``, sorted; places on both sides are multiplied out ``HITS`` at a time."""
        none = np.zeros((0, 4), np.int64)
        if len(buf) < Q or not len(self.grams):
            return none
        h = textops.Hashes(buf).grams(Q)
        at = np.flatnonzero(self.table[h >> self.shift])
        g = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        row = np.searchsorted(offs, at, "right") - 1
        same = (self.grams[g] == h[at]) & (at + Q <= offs[row + 1])
        at, g, row = at[same], g[same], row[same]
        total = np.cumsum(self.times[g])
        found, begin = none, 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HITS, "right")))
            found = _merged(np.concatenate((found, self._part(row[begin:end], g[begin:end], at[begin:end]))))
            begin = end
        return found

    def _part(self, row: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = self.times[g]
        place = np.repeat(self.first[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[place].astype(np.int64)
        diagonal = np.repeat(at, n) - self.pos[place]
        return _merged(np.stack((np.repeat(row, n), item, diagonal // (2 * self.k[item] + 1), np.ones(len(item), np.int64)), axis=1))

    def regions(self, bands: np.ndarray) -> list[tuple[int, int, int]]:
        """``(row, item, band's first diagonal)`` of the bands that share enough q-grams with the next one."""
        row, item, band, n = bands.T
        follows = np.zeros(len(row), bool)
        follows[:-1] = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1)
        count = n + np.where(follows, np.append(n[1:], 0), 0)
        ok = count >= self.bound[item]
        return list(zip(row[ok].tolist(), item[ok].tolist(), (band[ok] * (2 * self.k[item[ok]] + 1)).tolist(), strict=True))

    def align(self, buf: np.ndarray, begin: int, end: int, item: int, diagonal: int) -> int:
        """The fewest edits that turn the item into a part of ``buf[begin:end]`` within the band, at most ``k + 1``."""
        t, k = self.text[item], int(self.k[item])
        lo = diagonal - k  # diagonals lo .. lo + width - 1
        width = 2 * (2 * k + 1) + 2 * k
        far = k + 1
        j = lo + np.arange(width)  # text positions reached with no item character read
        row = np.where((j >= begin) & (j <= end), 0, far)
        steps = np.arange(width)
        for i, c in enumerate(t):
            j += 1
            inside = (j > begin) & (j <= end)
            cost = np.where(buf[np.clip(j - 1, 0, len(buf) - 1)] == c, 0, 1)
            new = np.where(inside, row + cost, far)
            new[:-1] = np.minimum(new[:-1], np.where((j[:-1] >= begin) & (j[:-1] <= end), row[1:] + 1, far))
            row = np.minimum(np.minimum.accumulate(new - steps) + steps, far)
            row = np.where((j >= begin) & (j <= end), row, far)
            if row.min() >= far:
                return far
        return int(row.min())

    def find(self, buf: np.ndarray, offs: np.ndarray) -> dict[tuple[int, int], int]:
        """``(row, item): edits`` of all items found in a slice."""
        buf, offs = normalise(buf, offs)
        bands = self.bands(buf, offs)
        if not len(bands):
            return {}
        found: dict[tuple[int, int], int] = {}
        for r, i, d in self.regions(bands):
            if found.get((r, i), 1):
                edits = self.align(buf, int(offs[r]), int(offs[r + 1]), i, d)
                if edits <= self.k[i]:
                    found[r, i] = min(edits, found.get((r, i), edits))
        return found


def prepared(benchmark: DataFrame) -> DataFrame:
    """``item_id, t``: the items whose normalised bytes ``t`` are ``Q`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal_bytes(x).tobytes().strip() if x else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["item_id", "t"])

    rows = benchmark.select("item_id", benchmark["text"].alias("__text"))
    return rows.mapInArrow(run, f"item_id {dict(benchmark.dtypes)['item_id']}, t binary").where(F.octet_length("t") >= Q)


def anchors_of(t: np.ndarray, edits: float) -> np.ndarray:
    """Hashes of ``k + 1`` disjoint q-grams of an item, spread over it: ``k`` edits leave one of them whole."""
    k = edit_budget(len(t), edits)
    at = np.arange(k + 1) * ((len(t) - Q) // max(k, 1))
    return textops.Hashes(t).spans(at, at + Q)


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [textops.mix(h ^ salt) >> np.uint64(64 - bits) for salt in textops.mix(np.arange(1, PROBES + 1, dtype=np.uint64))]


class Bloom:
    """A filter of anchor hashes, bounded in size; its words are made by an aggregation."""

    def __init__(self, anchors: DataFrame):
        bits = self.bits = min(BLOOM_BITS, max(16, (16 * anchors.count()).bit_length()))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(_probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["w", "b"])

        got = anchors.select("h").mapInArrow(places, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2 ** BLOOM_BITS / 64 rows
        self.words = np.zeros(1 << bits - 6, np.uint64)
        self.words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for at in _probes(h, self.bits):
            ok &= (self.words[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def _by_blocks(docs: DataFrame, items: DataFrame, size: int, edits: float, keep: tuple[str, ...], kinds: dict[str, str]) -> DataFrame:
    """``keep`` columns, ``key, edits`` of ``items`` (``key, t``, no two alike), which may be of any number."""
    spark, n = docs.sparkSession, -(-size // BLOCK_BYTES)
    items, _ = common.write_shared(spark, items.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(n))), "items")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [anchors_of(np.frombuffer(x.as_buffer(), np.uint8), edits) for x in batch.column(0)]
            of = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(h) for h in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)), pa.array(of)], ["h", "block"])

    anchors, _ = common.write_shared(spark, items.select("t", "block").mapInArrow(anchored, "h long, block long").distinct(), "anchors")
    bloom = spark.sparkContext.broadcast(Bloom(anchors))
    own = ", ".join(f"`{c}` {kinds[c]}" for c in keep)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.claim("decontam")
        for batch in batches:
            for i, j, buf, offs in textops.slices(batch, "__text"):
                buf, offs = normalise(buf, offs)
                h = textops.Hashes(buf).grams(Q)
                at = np.flatnonzero(bloom.value.holds(h))
                row = np.searchsorted(offs, at, "right") - 1
                inside = at + Q <= offs[row + 1]
                both = np.unique(np.stack((row[inside], h[at[inside]].view(np.int64)), axis=1), axis=0)
                rows, first = np.unique(both[:, 0], return_index=True)
                hits = pa.ListArray.from_arrays(pa.array(np.append(first, len(both)).astype(np.int32)), pa.array(both[:, 1]))
                part = batch.slice(i, j - i).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, hits], [*keep, "__text", "__hits"])

    rows = docs.select(*keep, docs["text"].alias("__text")).mapInArrow(touched, f"{own}, __text string, __hits array<long>")
    rows, _ = common.write_shared(spark, rows.withColumn("__row", F.monotonically_increasing_id()), "touched")
    pairs = rows.select("__row", F.octet_length("__text").alias("size"), F.explode("__hits").alias("h")).join(anchors, "h").select("__row", "size", F.col("block").alias("__block")).distinct()
    pairs, _ = common.write_shared(spark, pairs, "pairs")
    groups = pairs.groupBy("__block").agg(F.ceil(F.sum("size") / GROUP_BYTES).alias("groups"))
    groups, _ = common.write_shared(spark, groups.withColumn("groups", F.greatest("groups", F.lit(1))), "groups")
    groups = common.broadcast_if(groups, n)
    dealt = pairs.join(groups, "__block").select("__row", "__block", F.pmod(F.xxhash64("__row"), "groups").alias("__group")).join(rows.drop("__hits"), "__row").drop("__row")
    block = items.join(groups, F.col("block") == F.col("__block")).select("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("__group"), "key", "t")

    def meet(texts: pa.Table, held: pa.Table) -> pa.Table:
        textops.claim("decontam")
        block = Block(list(zip(held.column("key").to_pylist(), held.column("t").to_pylist(), strict=True)), edits)
        parts = []
        for batch in texts.combine_chunks().to_batches():
            for i, _, buf, offs in textops.slices(batch, "__text"):
                found = block.find(buf, offs)
                at = pa.array([i + r for r, _ in found], pa.int64())
                parts.append(pa.Table.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array([block.ids[x] for _, x in found], pa.string()), pa.array(list(found.values()), pa.int32())], [*keep, "key", "edits"]))
        return pa.concat_tables(parts) if parts else pa.table({**{c: texts.column(c).slice(0, 0) for c in keep}, "key": pa.array([], pa.string()), "edits": pa.array([], pa.int32())})

    by = ["__block", "__group"]
    return dealt.groupBy(*by).cogroup(block.groupBy(*by)).applyInArrow(meet, f"{own}, key string, edits int")


def find_items(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``item_id, edits``: every item found in every row's ``text``; ids may be of any type."""
    spark = docs.sparkSession
    kinds, item_type = dict(docs.dtypes), to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"item_id {dict(benchmark.dtypes)['item_id']}", "edits int"])
    items, path = common.write_shared(spark, prepared(benchmark), "benchmark")
    size = items.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)))).first()[0] or 0
    if size > BLOCK_BYTES:
        keyed = items.withColumn("key", F.sha2("t", 256))
        texts = keyed.select("key", "t").dropDuplicates(["key"])
        total = texts.agg(F.sum(F.octet_length("t"))).first()[0]
        return _by_blocks(docs, texts, total, edits, keep, kinds).join(keyed.select("key", "item_id"), "key").select(*keep, "item_id", "edits")
    held = [(r.item_id, bytes(r.t)) for r in items.collect()]  # bounded by BLOCK_BYTES
    common.drop_shared(spark, path)
    shared = spark.sparkContext.broadcast(Block(held, edits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.claim("decontam")
        block = shared.value
        for batch in batches:
            rows, found_items, n_edits = [], [], []
            for i, _, buf, offs in textops.slices(batch, "__text"):
                for (r, x), n in block.find(buf, offs).items():
                    rows.append(i + r)
                    found_items.append(block.ids[x])
                    n_edits.append(n)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), pa.array(found_items, item_type), pa.array(n_edits, pa.int32())], [*keep, "item_id", "edits"])

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return find_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
