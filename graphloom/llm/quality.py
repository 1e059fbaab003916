"""Quality rules: base counts, and character 4-gram perplexity within bands per language.

Characters fall into ``A`` classes: letters without case, a digit, white space and kinds of punctuation of ASCII, and
beyond ASCII one class a code point up to U+D733 (nearly all scripts); those above share classes with these.
Spark counts the 4-grams over all rows (tasks sum before the shuffle) and makes one interpolated modified Kneser-Ney
model per language by aggregations and joins on grams and contexts, no language meeting in a task: lower orders from
continuation counts, three discounts per order from the counts of counts.  Models of up to ``MODEL_ROWS`` rows are stored
as arrays of hashes (the packed grams) in ascending order beside
log-probabilities, one pair per order; a text's 4-grams are looked up there (a worker puts the highest order into a hash
table) and back off by binary search if missing.  Beyond that the texts' grams are joined with the model's tables.

The bands: the median of the mean log-probability of all rows of a language, and ``BAND`` times a
robust deviation to either side.  A row that is too hard is scored again in pieces (lines, long ones cut), each by the
model of the language that fits it best, so that texts of several languages are measured by models of them.
Rows then outside are rejected, as are rows that fail the base rules.

Defined cases: null text counts as empty (all counts 0, base failed); rows of
null language have a model and a band of their own, as every language has; texts under 4 characters have no perplexity
and pass the bands; repeated rows count as often as they occur; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

ORDER = 4
#: Robust deviations from the median by which a row's perplexity may lie below it (repeated patterns are easier than
#: language) and above it.
BAND = (8.0, 8.0)
#: A wide band, for corpora whose second languages have no rows of their own; the query and the pipeline use ``BAND``.
CORPUS_BAND = (8.0, 40.0)
SYMBOLS = b"#*$%&|<>"
HELD_GRAMS = 2_000_000
#: Grams of all models and orders up to which they go to the driver (20 bytes each) and are broadcast (12 bytes, and 12 a
#: context); beyond it texts meet them in a shuffle.
MODEL_ROWS = 4_000_000
#: 4-grams of a piece at most.
PIECE = 128
#: Models of which a worker keeps the hash table, and the bits of its slots at most (12 MB each).
DENSE_MODELS = 6
SLOT_BITS = 20
#: Classes; ``A**4`` is under 2**63.
A = 55_000


def _classes() -> np.ndarray:
    """The class of every code point."""
    out = (36 + np.arange(-128, 0x110000 - 128) % (A - 36)).astype(np.uint16)
    out[:128] = 35  # other ASCII
    out[97:123] = out[65:91] = np.arange(26)
    out[48:58] = 26
    for k, chars in enumerate((" \t\r\x0b\x0c", "\n", ".", ",", "!?;:", "'\"", "()[]{}", SYMBOLS.decode()), 27):
        out[[ord(c) for c in chars]] = k
    upper = np.array([c for c in range(192, 0x530) if chr(c).lower() != chr(c) and len(chr(c).lower()) == 1])
    out[upper] = out[[ord(chr(c).lower()) for c in upper]]
    return out


CLASS_OF = _classes()


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed 4-grams that lie within a row, their rows, and the number of 4-grams of each row."""
    cps, at = textops.code_points(buf, offs)
    n = np.maximum(np.diff(at) - (ORDER - 1), 0)
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    c = CLASS_OF[cps].astype(np.int64)
    packed = ((c[:-3] * A + c[1:-2]) * A + c[2:-1]) * A + c[3:]
    row = np.repeat(np.arange(len(n)), n)
    return packed[at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)], row, n


def base_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of a slice."""
    starts, ends, before = textops.words(buf, offs)
    hashes = textops.Hashes(buf)
    n_words = np.diff(before)
    lead = (buf & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": n_words, "word_chars": textops.row_sums(lead & ~textops.SPACE[buf], offs), "n_symbols": textops.row_sums(symbol[buf], offs)}
    # Lines with a word; all but the first of equal ones count.
    breaks = np.flatnonzero(buf == 10)
    cut = np.unique(np.concatenate((offs[:-1], breaks + 1)))
    cut = cut[cut < len(buf)]
    row = np.searchsorted(offs, cut, "right") - 1
    stop = np.minimum(np.append(breaks, len(buf))[np.searchsorted(breaks, cut)], offs[row + 1])
    with_word = np.searchsorted(starts, stop) > np.searchsorted(starts, cut)
    cut, stop, row = cut[with_word], stop[with_word], row[with_word]
    line = hashes.exact_ids(cut, stop)
    out["n_dup_lines"] = np.bincount(row, minlength=len(n_words)) - np.bincount(_distinct_rows(row, line), minlength=len(n_words))
    # Windows of three words within a row; those found twice or more mark their words.
    word = hashes.exact_ids(starts, ends)
    row = np.repeat(np.arange(len(n_words)), n_words)
    marked = np.zeros(len(word) + 1, np.int64)
    if len(word) >= 3:
        at = np.flatnonzero(row[:-2] == row[2:])
        distinct = int(word.max()) + 1
        pair = word[at] * distinct + word[at + 1]
        if distinct >= 1 << 21:  # three numbers would not fit into 63 bits
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        window = pair * distinct + word[at + 2]
        order = np.argsort(window, kind="stable")  # equal windows stay in the order of their rows
        x, r = window[order], row[at[order]]
        first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (r[1:] != r[:-1])))) if len(x) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(x)))
        again = at[order[np.repeat(size > 1, size)]]
        np.add.at(marked, again, 1)
        np.add.at(marked, np.minimum(again + 3, len(word)), -1)
    out["n_repeat_words"] = textops.row_sums(np.cumsum(marked[:-1]) > 0, before) if len(word) else np.zeros(len(n_words), np.int64)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _distinct_rows(row: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The row of each distinct (row, number)."""
    if not len(row):
        return row
    order = np.lexsort((of, row))
    r, x = row[order], of[order]
    return r[np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])))]


def languages(docs: DataFrame, lang: str = "lang") -> list[str]:
    """All languages; rows of null language have the number after the last."""
    return sorted(r[0] for r in docs.where(F.col(lang).isNotNull()).select(lang).distinct().collect())


def _lang_rows(batch: pa.RecordBatch, known: list[str]) -> np.ndarray:
    at = {x: i for i, x in enumerate(known)}
    return np.array([at.get(x, len(known)) for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.int64)


def count_grams(docs: DataFrame, known: list[str]) -> DataFrame:
    """``lang, gram, n``: 4-gram counts over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.claim("quality")
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge() -> int:
            for parts in held.values():
                keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
                order = np.argsort(keys, kind="stable")
                at, _ = textops.runs(keys[order])
                parts[:] = [(keys[order][at], np.add.reduceat(n[order], at) if len(at) else n)]
            return sum(len(parts[0][0]) for parts in held.values())

        def out() -> Iterator[pa.RecordBatch]:
            merge()
            for x, ((keys, n),) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), x, np.int32)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        slices = 0
        for batch in batches:
            langs = _lang_rows(batch, known)
            for i, _, buf, offs in textops.slices(batch, "text"):
                packed, row, _ = grams(buf, offs)
                of = langs[i + row]
                for x in np.unique(of).tolist():
                    held.setdefault(x, []).append(textops.unique_counts(packed[of == x]))
                slices += 1
                if slices % 16 == 0 and merge() > HELD_GRAMS:
                    yield from out()
        yield from out()

    counted = docs.select("lang", "text").mapInArrow(count, "lang int, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(t: list[int]) -> list[float]:
    """The modified Kneser-Ney discounts of the counts 1, 2 and 3 or more, from how many grams have the counts 1 to 4."""
    t = [max(x, 1) for x in t]
    y = t[0] / (t[0] + 2 * t[1])
    return [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


class Tables:
    """The models of all languages as one table ``k, lang, g, c, p, w``: a gram of order ``k``, its context, its
    probability and its context's back-off weight."""

    def __init__(self, docs: DataFrame, known: list[str]):
        self.spark, self.scratch = docs.sparkSession, []
        top = self.keep(count_grams(docs, known).select("lang", F.col("gram").alias("g"), "n"))
        counts, most = {ORDER: top}, top.count()  # no lower order has more grams
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before a gram
            counts[k] = counts[k + 1].groupBy("lang", (F.col("g") % A**k).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        lower = self.keep(reduce(DataFrame.unionByName, [counts[k].select(F.lit(k).alias("k"), "lang", "g", "n") for k in range(1, ORDER)]), ORDER * most)
        every = lower.unionByName(top.withColumn("k", F.lit(ORDER)))
        found: dict[tuple[int, int], list[int]] = {}
        for r in every.where("n <= 4").groupBy("k", "lang", "n").agg(F.count(F.lit(1)).alias("t")).collect():  # four numbers a language and order
            found.setdefault((r.k, r.lang), [0] * 4)[r.n - 1] = r.t
        cuts = [(k, x, *_discounts(found.get((k, x), [0] * 4))) for k in range(1, ORDER + 1) for x in range(len(known) + 1)]
        cut = self.spark.createDataFrame(cuts, "k int, lang int, d1 double, d2 double, d3 double")
        rows = every.withColumn("c", F.expr(f"g div {A}")).join(F.broadcast(cut), ["k", "lang"])  # one row a language and order
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        times = [F.sum(F.when(x, 1).otherwise(0)) for x in (F.col("n") == 1, F.col("n") == 2, F.col("n") > 2)]
        gamma = (times[0] * F.first("d1") + times[1] * F.first("d2") + times[2] * F.first("d3")) / F.sum("n")
        contexts = rows.groupBy("k", "lang", "c").agg(F.sum("n").alias("total"), gamma.alias("w"))
        share = rows.withColumn("left", F.col("n") - d).join(contexts, ["k", "lang", "c"]).select("k", "lang", "g", "c", (F.col("left") / F.col("total")).alias("mine"), "w")
        share = self.keep(share, ORDER * most)
        parts: list[DataFrame] = []
        for k in range(1, ORDER + 1):  # one small job each; the order below is read from its table
            mine = share.where(F.col("k") == k)
            if not parts:
                here = mine.withColumn("p", F.col("mine") + F.col("w") * (1.0 / A))
            else:
                under = parts[-1].select(F.col("lang").alias("l"), F.col("g").alias("s"), F.col("p").alias("under"))
                here = mine.join(under, (F.col("lang") == F.col("l")) & (F.col("g") % A ** (k - 1) == F.col("s"))).withColumn("p", F.col("mine") + F.col("w") * F.col("under"))
            parts.append(self.keep(here.select("k", "lang", "g", "c", "p", "w"), most))
        self.table = self.spark.read.schema(parts[0].schema).parquet(*self.scratch[-ORDER:])
        self.rows = self.table.count()

    def keep(self, df: DataFrame, grams: int | None = None) -> DataFrame:
        """``grams``: about how many rows ``df`` has."""
        out, path = common.write_shared(self.spark, df, "grams", None if grams is None else common.ROW_BYTES * grams)
        self.scratch.append(path)
        return out

    def grams(self, k: int) -> DataFrame:
        return self.table.where(F.col("k") == k)

    def load(self) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
        """For each language and order from 1: sorted grams, their log-probabilities, sorted contexts, their log back-off weights."""
        out: dict[int, list] = {}
        for k in range(1, ORDER + 1):
            log = lambda c: F.log(F.greatest(c, F.lit(1e-12))).cast("float").alias(c)
            got = self.grams(k).select("lang", "g", log("p"), log("w")).toArrow()  # bounded by MODEL_ROWS
            lang, g, p, w = (got.column(c).to_numpy() for c in ("lang", "g", "p", "w"))
            order = np.lexsort((g, lang))
            first, size = textops.runs(lang[order])
            for a, n in zip(first.tolist(), size.tolist(), strict=True):
                mine = order[a : a + n]
                contexts = g[mine] // A
                at, _ = textops.runs(contexts)  # grams in order have their contexts in order
                out.setdefault(int(lang[mine[0]]), []).append((g[mine], p[mine], contexts[at], w[mine][at]))
        return out

    def scored(self, wanted: DataFrame) -> DataFrame:
        """``lang, g, lp`` of every row of ``lang, g``, by joins: the log-probability, backed off where a gram is not there."""
        rows = wanted.select("lang", "g", F.lit(None).cast("double").alias("lp"), F.lit(0.0).alias("back"))
        for k in range(ORDER, 0, -1):
            hit = self.grams(k).select(F.col("lang").alias("l"), F.col("g").alias("s"), F.log("p").cast("float").cast("double").alias("hit"))
            rows = rows.join(hit, (F.col("lang") == F.col("l")) & (F.col("g") % A**k == F.col("s")), "left").drop("l", "s")
            rows = rows.withColumn("lp", F.coalesce("lp", F.col("hit") + F.col("back"))).drop("hit")
            step = self.grams(k).groupBy(F.col("lang").alias("l"), F.col("c").alias("s")).agg(F.first(F.log(F.greatest("w", F.lit(1e-12))).cast("float").cast("double")).alias("step"))
            rows = rows.join(step, (F.col("lang") == F.col("l")) & (F.expr(f"(g % {A**k}) div {A}") == F.col("s")), "left").drop("l", "s")
            rows = rows.withColumn("back", F.col("back") + F.coalesce("step", F.lit(0.0))).drop("step")
        return rows.select("lang", "g", F.coalesce("lp", F.col("back") - float(np.log(A))).alias("lp"))

    def drop(self) -> None:
        common.drop_shared(self.spark, *self.scratch)


def _shared(spark: SparkSession, models: dict[int, list]) -> dict[int, Broadcast]:
    """A broadcast of each model, so that a worker loads those of its rows' languages only."""
    return {x: spark.sparkContext.broadcast(m) for x, m in models.items()}


def _release(shared: dict[int, Broadcast]) -> None:
    """Let go of the models a worker holds, if they are many."""
    held = [b for b in shared.values() if hasattr(b, "_value")]
    if len(held) > DENSE_MODELS:
        _dense.clear()
        for b in held:
            del b._value


_dense: dict[int, tuple[list, int, np.ndarray, np.ndarray]] = textops.keep("quality", {})


def _slots(packed: np.ndarray, bits: int) -> np.ndarray:
    return ((packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(model: list) -> tuple[int, np.ndarray, np.ndarray]:
    """Slot bits, grams and log-probabilities of the highest order's hash table, one gram a slot; a worker keeps a few."""
    got = _dense.get(id(model))
    if got is None:
        while len(_dense) >= DENSE_MODELS:
            _dense.pop(next(iter(_dense)))
        keys, logp = model[-1][:2]
        bits = min(SLOT_BITS, max(8, (4 * len(keys)).bit_length()))
        grams_at, logp_at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        at = _slots(keys, bits)
        at, last = np.unique(at, return_index=True)
        grams_at[at], logp_at[at] = keys[last], logp[last]
        got = _dense[id(model)] = (model, bits, grams_at, logp_at)
    return got[1:]


def log_probabilities(model: list, packed: np.ndarray) -> np.ndarray:
    """The log-probability of the last character of each gram given the others."""
    bits, grams_at, logp_at = _hashed(model)
    at = _slots(packed, bits)
    out = logp_at[at].astype(np.float64)
    todo = np.flatnonzero(grams_at[at] != packed)  # no slot of its own, or not in the model
    if len(todo):
        out[todo] = _backed_off(model, packed[todo])
    return out


def _backed_off(model: list, packed: np.ndarray) -> np.ndarray:
    out = np.zeros(len(packed), np.float64)
    todo, backed = np.arange(len(packed)), packed.astype(np.int64)
    for k in range(ORDER, 0, -1):
        keys, logp, contexts, gamma = model[k - 1]
        g = backed[todo]
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = keys[at] == g
        out[todo[hit]] += logp[at[hit]]
        todo, g = todo[~hit], g[~hit]
        if not len(todo):
            return out
        at = np.minimum(np.searchsorted(contexts, g // A), len(contexts) - 1)
        out[todo] += np.where(contexts[at] == g // A, gamma[at], 0)
        backed[todo] = g % A ** (k - 1)
    out[todo] += -np.log(A)
    return out


def fit(docs: DataFrame, known: list[str]) -> dict[int, list]:
    """The models of all languages, for corpora whose models are known to be small."""
    tables = Tables(docs, known)
    models = tables.load()
    tables.drop()
    return models


MEASURES = "row_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang_no int, mean_log_p double"


def measure(docs: DataFrame, models: dict[int, list], known: list[str], key: str = "doc_id") -> DataFrame:
    """Base counts and mean log-probability of every row."""
    shared = _shared(docs.sparkSession, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.claim("quality")
        for batch in batches:
            langs = _lang_rows(batch, known)
            parts = []
            for i, j, buf, offs in textops.slices(batch, "text"):
                part = base_counts(buf, offs)
                packed, row, n = grams(buf, offs)
                logp = np.zeros(len(packed))
                of = langs[i + row]
                for x in np.unique(of).tolist():
                    at = np.flatnonzero(of == x)
                    logp[at] = log_probabilities(shared[x].value, packed[at]) if x in shared else -np.log(A)
                    _release(shared)
                mean = np.bincount(row, logp, len(n)) / np.maximum(n, 1)
                parts.append([*part.values(), langs[i:j].astype(np.int32), np.where(n > 0, mean, np.nan)])
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in ([np.int64] * 5 + [np.int32, np.float64])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols[:-1]), pa.array(cols[-1], mask=np.isnan(cols[-1]))], ["doc_id", *(x.split()[0] for x in MEASURES.split(", "))])
        _dense.clear()

    kind = dict(docs.dtypes)[key]
    return docs.select(docs[key].alias("doc_id"), _row_key(docs, key), "lang", "text").mapInArrow(run, f"doc_id {kind}, {MEASURES}")


def _row_key(docs: DataFrame, key: str = "doc_id") -> Column:
    """Equal rows have equal keys; they have equal verdicts too."""
    return F.xxhash64(docs[key], "lang", "text").alias("row_key")


def _pieces(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The piece of each 4-gram of a slice, from 0 and ascending: a new one in each row, after a line's end, and after ``PIECE`` grams."""
    cps, at = textops.code_points(buf, offs)
    n = np.maximum(np.diff(at) - (ORDER - 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    place = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    line = np.concatenate(([0], np.cumsum(cps == 10)))[place] + row
    first, size = textops.runs(line)
    within = np.arange(len(line)) - np.repeat(first, size)
    return np.cumsum(np.concatenate(([0], (line[1:] != line[:-1]) | (within[1:] % PIECE == 0)))) if len(line) else line


def best_fit(docs: DataFrame, models: dict[int, list]) -> DataFrame:
    """``row_key, best_mean``: the mean log-probability of every row of ``row_key, text`` with each piece scored by the model that fits it best."""
    shared = _shared(docs.sparkSession, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.claim("quality")
        for batch in batches:
            means = [np.zeros(0)]
            for _, _, buf, offs in textops.slices(batch, "text"):
                packed, row, n = grams(buf, offs)
                piece = _pieces(buf, offs)
                best = np.full(int(piece[-1]) + 1 if len(piece) else 0, -np.inf)
                for model in shared.values():
                    np.maximum(best, np.bincount(piece, log_probabilities(model.value, packed), len(best)), out=best)
                    _release(shared)
                of = row[textops.runs(piece)[0]]
                means.append(np.bincount(of, best, len(n)) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(means))], ["row_key", "best_mean"])
        _dense.clear()

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, best_mean double")


def _row_grams(docs: DataFrame, known: list[str], pieces: bool) -> DataFrame:
    """``row_key, lang, piece, g, n``: the grams of every row of ``row_key, lang, text``, counted within the row or piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.claim("quality")
        for batch in batches:
            langs, keys = _lang_rows(batch, known), batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, offs in textops.slices(batch, "text"):
                packed, row, _ = grams(buf, offs)
                piece = _pieces(buf, offs) if pieces else row
                order = np.lexsort((packed, piece))
                packed, row, piece = packed[order], row[order], piece[order]
                at = np.flatnonzero(np.concatenate(([True], (packed[1:] != packed[:-1]) | (piece[1:] != piece[:-1])))) if len(packed) else np.zeros(0, np.int64)
                n = np.diff(np.append(at, len(packed)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + row[at]]), pa.array(langs[i + row[at]].astype(np.int32)), pa.array(piece[at]), pa.array(packed[at]), pa.array(n)], ["row_key", "lang", "piece", "g", "n"])

    return docs.select("row_key", "lang", "text").mapInArrow(run, "row_key long, lang int, piece long, g long, n long")


def means_by_join(docs: DataFrame, tables: Tables, known: list[str]) -> DataFrame:
    """``row_key, mean_log_p`` of every row, for models too large for a broadcast: grams meet the model in a shuffle."""
    rows = _row_grams(docs.withColumn("row_key", _row_key(docs)), known, False)
    p = tables.grams(ORDER).select("lang", "g", F.log("p").cast("float").cast("double").alias("lp"))  # holds every gram of every row
    return rows.join(p, ["lang", "g"]).groupBy("row_key").agg((F.sum(F.col("n") * F.col("lp")) / F.sum("n")).alias("mean_log_p"))


def best_fit_by_join(docs: DataFrame, tables: Tables, known: list[str]) -> DataFrame:
    """As ``best_fit`` without a broadcast: the grams of these few rows are scored in every language."""
    rows = _row_grams(docs.dropDuplicates(["row_key"]), known, True).drop("lang")
    every = F.explode(F.array(*[F.lit(x) for x in range(len(known) + 1)])).alias("lang")
    trained = tables.grams(1).select("lang").distinct()  # languages with a model
    wanted = rows.select("g").distinct().select("g", every).join(F.broadcast(trained), "lang", "left_semi")
    fits = rows.join(tables.scored(wanted), "g").groupBy("row_key", "piece", "lang").agg(F.sum(F.col("n") * F.col("lp")).alias("lp"), F.sum("n").alias("n"))
    best = fits.groupBy("row_key", "piece").agg(F.max("lp").alias("lp"), F.max("n").alias("n"))
    return best.groupBy("row_key").agg((F.sum("lp") / F.sum("n")).alias("best_mean"))


def judge(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Measures and verdict of every row of ``doc_id, lang, text``; ``row_key`` is ``_row_key`` of the row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "lang", "text")
    known = languages(docs)
    tables = Tables(docs, known)
    models = tables.load() if tables.rows <= MODEL_ROWS else None
    if models is None:
        means, path = common.write_shared(spark, means_by_join(docs, tables, known), "means")
        tables.scratch.append(path)
        measured = measure(docs, {}, known).drop("mean_log_p").join(means, "row_key", "left")
    else:
        measured = measure(docs, models, known)
    measured, _ = common.write_shared(spark, measured, "quality")
    size = common.ROW_BYTES * measured.count()
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = measured.withColumn("base_failed", base_failed)
    q = F.percentile_approx("mean_log_p", [0.25, 0.5, 0.75], 10_000)
    bands = rows.where("not base_failed").groupBy("lang_no").agg(q.alias("q"))
    # The deviation of a normal distribution is its quartile distance over 1.349; a floor keeps uniform corpora.
    dev = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(0.02))
    bands = bands.select("lang_no", (F.col("q")[1] - band[1] * dev).alias("least"), (F.col("q")[1] + band[0] * dev).alias("most"))
    rows = rows.join(F.broadcast(bands), "lang_no", "left")  # one band a language
    hard, _ = common.write_shared(spark, rows.where("not base_failed and mean_log_p < least").select("row_key").distinct(), "hard", size)
    again = docs.withColumn("row_key", _row_key(docs)).join(common.broadcast_if(hard, hard.count()), "row_key", "left_semi")
    again, _ = common.write_shared(spark, (best_fit(again, models) if models is not None else best_fit_by_join(again, tables, known)).groupBy("row_key").agg(F.max("best_mean").alias("best_mean")), "again", size)
    tables.drop()
    rows = rows.join(common.broadcast_if(again, again.count()), "row_key", "left")
    low = F.coalesce(F.greatest("mean_log_p", "best_mean"), "mean_log_p")
    inside = F.coalesce((low >= F.col("least")) & (F.col("mean_log_p") <= F.col("most")), F.lit(True))
    return rows.withColumn("perplexity", F.exp(-F.col("mean_log_p"))).withColumn("kept", ~F.col("base_failed") & inside)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    rows = judge(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("perplexity", 4).alias("perplexity"))
