"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text gives the set of its word shingles (64-bit hashes), a MinHash signature (of which a byte per hash is
   kept) and ``BANDS`` band keys.  Texts of equal word sequences (by a 128-bit cryptographic digest) are one class;
   one row stands for a class, and only classes go on.  Classes, not ids, are the nodes, so ids may repeat.
2. Classes that share a band key form a bucket.  A bucket is not expanded into all
   pairs: its members are compared with the bucket's least class.  Equal candidate pairs of several bands are one.
3. A candidate pair's signatures are compared in batches.  With a uniform prior the similarity after
   ``n`` hashes with ``m`` matches has a beta posterior; the pair is pruned when its chance of
   reaching the threshold falls under ``MISS``, which all looks share.  Survivors are verified on the full sets.
4. Links give components by alternating stars.  Buckets whose members are of one component are done.  The others are
   cut into blocks of about ``BLOCK_BYTES``, large components into blocks of their own; pairs of blocks are dealt
   out evenly and compared as arrays: members of different components that are not pruned are verified on their
   sets there, so that only links leave a task.  Then the components are final: no candidate pair of different components is left unchecked.

``rows`` per band is the largest for which a pair at the threshold meets in no band with a chance under 1e-5.

Defined cases: rows are the nodes: rows that repeat an id with other texts have each their own set and links; null or empty texts
and texts without words have no shingles and are linked with nothing; a text
with fewer words than a shingle is one shingle; rows of equal word sequences (copies, repeated rows) share one component
however many; ids may be of any type that can be ordered; a null id is a member like any but never names a component
that has another id: ``kept`` is ``doc_id <=> component_id``, so of a group of null ids alone all rows are kept; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops
from .common import ROW_BYTES
from .components import components

BANDS = 32
BATCH = 32
HASHES = 640
MISS = 1e-5
#: Bytes of signatures, band keys and sets in a block of members.
BLOCK_BYTES = 2_000_000


@dataclass(frozen=True)
class Rule:
    words: int = 5
    percent: int = 80

    @property
    def least(self) -> float:
        return self.percent / 100

    @property
    def rows(self) -> int:
        return max(r for r in range(1, 17) if (1 - self.least**r) ** BANDS < 1e-5)


def _odd(n: int, seed: int, kind: type) -> np.ndarray:
    top = np.iinfo(kind).max
    return np.random.Generator(np.random.PCG64(seed)).integers(0, top, n, dtype=kind) | kind(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a slice."""
    buf = textops.LOWER[buf]
    starts, ends, before = textops.words(buf, offs)
    h = textops.Hashes(buf).spans(starts, ends)
    times = _odd(max(words, 64), 11, np.uint64)
    n = max(len(h) - words + 1, 0)
    windows = np.zeros(n, np.uint64)
    for j in range(words):
        windows += h[j : j + n] * times[j]
    windows = textops.mix(windows)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(windows[a : b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:  # the whole sequence as one shingle
            out.append(textops.mix((h[a:b] * times[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of ``len(times)`` functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(times), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (x[i : i + 256, None] * times).min(axis=0), out=out)
    return out


def digests(buf: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """A digest of each row's word sequence, equal for rows that differ in case and white space only; None without words."""
    low = textops.LOWER[buf]
    word = ~textops.SPACE[buf]
    keep = word.copy()
    keep[1:] |= word[:-1]  # one space behind a word
    first = offs[:-1][offs[:-1] < offs[1:]]
    keep[first] = word[first]
    at = np.concatenate(([0], np.cumsum(keep)))[offs].tolist()
    data = np.where(word, low, np.uint8(32))[keep].tobytes()
    rows = (data[a:b].rstrip(b" ") for a, b in zip(at, at[1:], strict=False))
    return [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in rows]


def _with_row(docs: DataFrame) -> DataFrame:
    """``doc_id, t, text``: ``t`` finds a class's row again without its text."""
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text")


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, t, n, cid, bands, sig`` of every row of ``doc_id, text``; ``cid`` names its class."""
    rows, banded = rule.rows, rule.rows * BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.claim("near_dup")
        times, mixers = _odd(HASHES, 23, np.uint32), _odd(rows, 29, np.uint64)
        salt = textops.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for i, j, buf, offs in textops.slices(batch, "text"):
                sets = shingle_sets(buf, offs, rule.words)
                sig = np.array([signature(s, times) for s in sets]).reshape(j - i, HASHES)
                n = np.array([len(s) for s in sets], np.int64)
                keys = textops.mix((sig[:, :banded].reshape(-1, BANDS, rows).astype(np.uint64) * mixers).sum(axis=2) + salt)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].view(np.int64).ravel()))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(digests(buf, offs), pa.binary()), bands, pa.array([x.tobytes() for x in stored(sig)], pa.binary())], ["doc_id", "t", "n", "cid", "bands", "sig"])

    kind = dict(docs.dtypes)["doc_id"]
    return _with_row(docs).mapInArrow(run, f"doc_id {kind}, t long, n long, cid binary, bands array<long>, sig binary")


def stored(sig: np.ndarray) -> np.ndarray:
    """The byte kept of each hash: least hashes are small numbers, so it is taken from a product that mixes all bits."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def least_matches(n: int, least: float, miss: float = MISS) -> int:
    """The fewest matches among ``n`` stored bytes that leave a chance of ``miss`` to reach the similarity ``least``.

    Bytes of different hashes agree once in 256 times.  The posterior tail under a uniform prior is the chance of at
    most ``m`` successes in ``n + 1`` draws.
    """
    p, total = least + (1 - least) / 256, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _rows_of(frame: DataFrame, reps: DataFrame, n: int, *also: str) -> DataFrame:
    """The rows of ``frame`` that stand for the ``n`` classes ``reps`` (``cid, doc_id, t``)."""
    of = reps.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), *[F.col(c).alias(f"__{c}") for c in also])
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t"))
    for c in also:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return frame.join(common.broadcast_if(of, n), same, "left_semi")


def _pair_up(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    one = values.select(F.col("cid").alias("b"), F.col(column).alias("vb"))
    two = values.select(F.col("cid").alias("a"), F.col(column).alias("va"))
    return pairs.join(one, "b").join(two, "a")


def _steps(rule: Rule) -> list[tuple[int, int]]:
    """After how many hashes how many matches keep a pair; the looks share ``MISS``."""
    return [(n, least_matches(n, rule.least, MISS * BATCH / HASHES)) for n in range(BATCH, HASHES + 1, BATCH)]


def pruned(sa: np.ndarray, sb: np.ndarray, x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs of rows ``x`` of one block and ``y`` of another are never pruned."""
    alive, m, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, least in steps:
        m += (sa[x[alive], at:n] == sb[y[alive], at:n]).sum(axis=1)
        stay = m >= least
        alive, m, at = alive[stay], m[stay], n
    return alive


def _write_small_batches(spark: SparkSession, df: DataFrame, name: str, rows: int = 4, size: float | None = None) -> tuple[DataFrame, str]:
    """Write with few rows to an Arrow batch, as each holds whole sets or blocks of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        return common.write_shared(spark, df, name, size)
    finally:
        spark.conf.set(key, before)


def _sets(docs: DataFrame, reps: DataFrame, n: int, rule: Rule) -> DataFrame:
    """``cid, s``: the sets, as bytes, of the ``n`` classes ``reps``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in textops.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(digests(buf, offs), pa.binary()), pa.array([s.tobytes() for s in shingle_sets(buf, offs, rule.words)], pa.binary())], ["cid", "s"])

    return _rows_of(_with_row(docs), reps, n).select("text").mapInArrow(sets, "cid binary, s binary").dropDuplicates(["cid"])


def _linked(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= rule.percent * (len(both) - inter)


class Run:
    """One job's tables: rows, classes and scratch."""

    def __init__(self, docs: DataFrame, rule: Rule):
        self.spark, self.rule, self.steps = docs.sparkSession, rule, _steps(rule)
        self.docs, self.scratch, self.path = docs.select("doc_id", "text"), [], {}
        self.feats = self.keep(features(self.docs, rule), "features")
        self.rows, shingles = self.feats.agg(F.count(F.lit(1)), F.coalesce(F.avg("n"), F.lit(0.0))).first()
        #: Bytes of a row's set, on average.
        self.set_bytes = 8 * shingles + ROW_BYTES
        first = F.min(F.struct("doc_id", "t")).alias("r")
        reps = self.feats.where("n > 0").groupBy("cid").agg(first, F.min("doc_id").alias("low"), F.min("n").alias("n"))
        #: One row a class: the row that stands for it, and its least id.
        self.reps = self.keep(reps.select("cid", "r.doc_id", "r.t", "low", "n"), "classes", ROW_BYTES * self.rows)

    def keep(self, df: DataFrame, name: str, size: float | None = None) -> DataFrame:
        out, self.path[name] = common.write_shared(self.spark, df, name, size)
        self.scratch.append(self.path[name])
        return out

    def some(self, ids: DataFrame) -> tuple[DataFrame, int]:
        """The rows that stand for the classes ``ids``, and how many they are."""
        out = self.keep(self.reps.join(common.broadcast_if(ids, ids.count()), "cid", "left_semi").select("cid", "doc_id", "t"), "ids", ROW_BYTES * self.rows)
        return out, out.count()

    def values(self, reps: DataFrame, n: int, *columns: str) -> DataFrame:
        return _rows_of(self.feats.select("cid", "doc_id", "t", *columns), reps, n, "cid").dropDuplicates(["cid"]).select("cid", *columns)


def verify(run: Run, pairs: DataFrame, size: float) -> DataFrame:
    """The linked ones of candidate pairs ``a, b``, which are made from ``size`` bytes."""
    steps, rule = run.steps, run.rule
    pairs = run.keep(pairs, "pairs", size)
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("cid")).distinct()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            every = np.arange(len(va))
            at = pa.array(pruned(va, vb, every, every, steps))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    reps, n = run.some(ends(pairs))
    sigs = run.keep(run.values(reps, n, "sig"), "sigs", n * (HASHES + ROW_BYTES))
    size = 2 * (HASHES + ROW_BYTES) * pairs.count()
    pairs = run.keep(_pair_up(pairs, sigs, "sig").select("a", "b", "va", "vb").mapInArrow(prune, "a binary, b binary"), "pruned", size)
    reps, n = run.some(ends(pairs))
    shingled = run.keep(_sets(run.docs, reps, n, rule), "sets", n * run.set_bytes)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if _linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), rule):
                    linked.append(i)
            at = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    out, path = _write_small_batches(run.spark, _pair_up(pairs, shingled, "s").select("a", "b", "va", "vb").mapInArrow(exact, "a binary, b binary"), "linked", 32, 2 * run.set_bytes * pairs.count())
    run.scratch.append(path)
    return out


def linked_across(run: Run, members: DataFrame) -> DataFrame:
    """``a, b``: linked members of one bucket and different components.

    ``members``: ``key, cid, n, c`` of buckets that hold several components.  Blocks hold signatures, band keys and sets, so
    that only links leave a task; a pair is compared in the first of the buckets that it shares.
    """
    steps, rule = run.steps, run.rule
    weight = F.sum(F.col("n") * 8 + HASHES + 8 * BANDS)
    sizes = members.groupBy("key", "c").agg(weight.alias("size"))
    grouped = members.join(sizes, ["key", "c"]).withColumn("g", F.when(F.col("size") >= BLOCK_BYTES // 4, F.col("c")))
    blocks = grouped.groupBy("key", "g").agg(F.ceil(weight / BLOCK_BYTES).alias("blocks"))
    dealt = grouped.join(blocks.withColumnRenamed("g", "g0").withColumnRenamed("key", "k0"), (F.col("key") == F.col("k0")) & F.col("g").eqNullSafe(F.col("g0")))
    block = F.struct(F.col("g").isNotNull().alias("pure"), F.coalesce("g", F.lit(b"")).alias("g"), F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("sub"))
    dealt = run.keep(dealt.select("key", block.alias("id"), "cid", "c"), "dealt", 2 * ROW_BYTES * members.count())
    reps, n = run.some(dealt.select("cid").distinct())
    each = run.set_bytes + HASHES + 8 * BANDS
    values = run.keep(run.values(reps, n, "sig", "bands").join(_sets(run.docs, reps, n, rule), "cid"), "values", n * each)
    # A block is bounded in bytes: its members were dealt by a hash into as many blocks as they need.
    packed = dealt.join(values, "cid").groupBy("key", "id").agg(F.collect_list(F.struct("c", "sig", "bands", "s", "cid")).alias("block"))
    packed = run.keep(packed, "blocks", each * dealt.count())
    one, two = (packed.select("key", F.col("id").alias(f"id{k}")) for k in (1, 2))
    differ = (F.col("id1.pure") != F.col("id2.pure")) | (F.col("id1.g") != F.col("id2.g")) | ~F.col("id1.pure")
    both = one.join(two, "key").where((F.col("id1") <= F.col("id2")) & differ).select("key", "id1", "id2")
    for k in (1, 2):
        both = both.join(packed.select("key", F.col("id").alias(f"id{k}"), F.col("block").alias(f"block{k}")), ["key", f"id{k}"])

    def fields(x: pa.Array) -> tuple:
        halves = lambda k: np.frombuffer(b"".join(x.field(k).to_pylist()), np.uint64).reshape(-1, 2)
        sig = np.frombuffer(b"".join(x.field(1).to_pylist()), np.uint8).reshape(-1, HASHES)
        bands = x.field(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        return halves(0), sig, bands, [np.frombuffer(s.as_buffer(), np.uint64) for s in x.field(3)], x.field(4)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, same = batch.column(0)[i].as_py(), batch.column(3)[i].as_py()
                (ca, sa, ba, ta, ra), (cb, sb, bb, tb, rb) = (fields(batch.column(k)[i].values) for k in (1, 2))
                na, nb = (np.array([len(x) for x in t]) for t in (ta, tb))
                band = int(np.flatnonzero(ba[0] == key)[0])  # a key holds its band
                apart = (ca[:, None] != cb).any(axis=2) & (na[:, None] * rule.percent <= nb * 100) & (nb * rule.percent <= na[:, None] * 100)
                x, y = np.nonzero(np.triu(apart, 1) if same else apart)
                out_a, out_b = [], []
                for k in range(0, len(x), 16_384):
                    xk, yk = x[k : k + 16_384], y[k : k + 16_384]
                    new = ~(ba[xk, :band] == bb[yk, :band]).any(axis=1)  # else met in a bucket of an earlier band
                    xk, yk = xk[new], yk[new]
                    for j in pruned(sa, sb, xk, yk, steps).tolist():
                        if _linked(ta[xk[j]], tb[yk[j]], rule):
                            out_a.append(ra[int(xk[j])].as_py())
                            out_b.append(rb[int(yk[j])].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    rows = both.select("key", "block1", "block2", (F.col("id1") == F.col("id2")).alias("same"))
    found, path = _write_small_batches(run.spark, rows.mapInArrow(compare, "a binary, b binary"), "across")
    run.scratch.append(path)
    return found


def links(run: Run) -> DataFrame:
    """``u, v``: each linked class but a component's least, with that least."""
    spark, percent = run.spark, run.rule.percent
    only = _rows_of(run.feats.select("cid", "doc_id", "t", "n", "bands"), run.reps, run.reps.count(), "cid")
    members = only.select(F.explode("bands").alias("key"), "cid", "n")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    rest = run.keep(members.join(shared, "key").distinct(), "buckets", ROW_BYTES * BANDS * run.rows)
    size = ROW_BYTES * rest.count()
    heads = rest.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("head")).select("key", F.col("head.cid").alias("a"), F.col("head.n").alias("na"))
    fits = (F.col("na") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("na") * 100)
    spokes = rest.join(heads, "key").where((F.col("cid") != F.col("a")) & fits).select("a", F.col("cid").alias("b")).distinct()
    known = verify(run, spokes, size)
    ends = [F.col("a").alias("u"), F.col("b").alias("v")]
    comp = components(spark, known.select(*ends))
    named = rest.join(comp.withColumnRenamed("u", "cid").withColumnRenamed("v", "c"), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    # Heads have been compared with all of their bucket.
    named = named.join(heads, "key").where(F.col("cid") != F.col("a")).select("key", "cid", "n", "c")
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    named = run.keep(named.join(mixed, "key"), "open", size)
    if not named.take(1):
        return comp
    return components(spark, known.unionByName(linked_across(run, named)).select(*ends))


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), keys: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``doc_id, text``; with ``keys`` also ``cid, root, t``.

    ``root`` names the component (null without shingles) and ``t`` is the row's ``xxhash64("text")``.
    """
    batches = common.small_batches(docs.sparkSession)
    try:  # what meets Python workers is written here, the lazy result has none
        run = Run(docs, rule)
        comp = links(run)
    finally:
        docs.sparkSession.conf.set(common.BATCH_KEY, batches)
    size = ROW_BYTES * run.rows
    comp = run.keep(comp, "components", size)
    named = run.reps.select("cid", "low").join(comp.select(F.col("u").alias("cid"), F.col("v").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    grouped = named.join(common.broadcast_if(comp.select(F.col("v").alias("root")).distinct(), comp.count()), "root", "left_semi")
    least = run.keep(grouped.groupBy("root").agg(F.min("low").alias("least")), "least", size)
    named = named.join(common.broadcast_if(least, least.count()), "root", "left").select("cid", "root", F.coalesce("least", "low").alias("component_id"), F.lit(True).alias("some"))
    rows = run.feats.select("doc_id", F.col("n").alias("n_shingles"), "cid", "t")
    common.drop_shared(run.spark, *(set(run.scratch) - {run.path[x] for x in ("features", "classes", "components", "least")}))
    out = rows.join(named, "cid", "left").withColumn("component_id", F.when(F.col("some"), F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *(["cid", "root", "t"] if keys else []))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return near_duplicates(common.table(spark, sf_dir, "documents"), Rule(words=3, percent=85))
