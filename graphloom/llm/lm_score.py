"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Tokens are the lower-cased words of a text.  The most frequent are classes of their own, the others are dealt by
hash to shared classes.  The network predicts the class of every token from the classes of ``WINDOW`` tokens on either
side (the sum of one embedding per place, tanh, softmax).  It is trained on all rows: every distinct text is dealt by
its hash to one of ``ROUNDS`` rounds and there to a logical shard of about ``SHARD_TOKENS`` tokens.  A shard takes the
shared weights through its texts in the order of their hashes by gradient descent, a text of ``n`` copies with weight
``n``; the weights of all shards, by their tokens, are averaged in the order of the shards, ``FAN`` at a time, and the next
round starts from them.  Within its class a word has its share of the class's occurrences in
all rows: every word that occurs ``LEAST`` times or more has a number and a share of its own, so the vocabulary
grows with the input; the rarer words of a class have equal parts of what they occur together.
A text's score is the sum of the log-probabilities of its words given both sides.

The weights follow from the rows alone, however they are split or ordered and whichever executor runs a task; scores
follow from them up to the rounding of 32-bit products.

Defined cases: null and empty texts, and texts without words, have no tokens, score 0 and a null mean; a word that no
row had counts as one more rare word of its class; places beyond a text's ends hold one boundary token; repeated rows
train as one text of more weight and score like any; an empty table leaves the initial weights; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

WINDOW = 2
OWN, SHARED = 192, 63
BOUNDARY, VOCABULARY = OWN + SHARED, OWN + SHARED + 1
HIDDEN = 16
BATCH = 1024
RATE = 0.7
ROUNDS = 3
#: Tokens of all rows to a logical shard of a round; shards averaged by one task.
SHARD_TOKENS = 500_000
FAN = 32
HELD_WORDS = 1_000_000
#: Occurrences from which a word has a number of its own.
LEAST = 50


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (a 64-bit hash), ``n`` over all rows; tasks sum what they hold before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(h, kind="stable")
            at, _ = textops.runs(h[order])
            return h[order][at], np.add.reduceat(n[order], at) if len(at) else n

        def out() -> pa.RecordBatch:
            h, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for _, _, buf, offs in textops.slices(batch, "text"):
                held.append(textops.unique_counts(_word_hashes(buf, offs)[0]))
                if len(held) >= 16:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_WORDS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = textops.LOWER[buf]
    starts, ends, before = textops.words(low, offs)
    return textops.Hashes(low).spans(starts, ends), before


def classes(token: np.ndarray) -> np.ndarray:
    """The classes of numbered words; numbers under ``VOCABULARY`` are classes."""
    return np.where(token < VOCABULARY, token, OWN + (token - VOCABULARY) % SHARED)


class Network:
    """Weights: embeddings by place and class, a bias for the hidden layer, output weights and biases; behind them, if
    fitted, the log-probabilities within their class of a rare word of each shared class and of every numbered word."""

    SHAPES = ((2 * WINDOW, VOCABULARY, HIDDEN), (HIDDEN,), (HIDDEN, VOCABULARY), (VOCABULARY,))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            flat = np.random.Generator(np.random.PCG64(3)).normal(0, 0.1, self.SIZE)
        self.flat, self.within = np.array(flat[: self.SIZE], np.float32), flat[self.SIZE :]
        parts, at = [], 0
        for s in self.SHAPES:
            n = int(np.prod(s))
            parts.append(self.flat[at : at + n].reshape(s))
            at += n
        self.embed, self.bias, self.out, self.out_bias = parts

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden values, scores of every token (those of a row may be shifted alike) and the exponentials of the scores."""
        hidden = self.bias + self.embed[0].take(context[0], axis=0)
        for k in range(1, 2 * WINDOW):
            hidden += self.embed[k].take(context[k], axis=0)
        np.tanh(hidden, out=hidden)
        scores = hidden @ self.out
        scores += self.out_bias
        # Hidden values lie within 1, so the weights bound the scores; only large ones need a shift before the exponential.
        if np.abs(self.out).sum(axis=0).max() + np.abs(self.out_bias).max() > 60:
            scores -= scores.max(axis=1, keepdims=True)
        return hidden, scores, np.exp(scores)

    def train(self, context: np.ndarray, target: np.ndarray, rate: float, weight: np.ndarray | None = None) -> None:
        """One step of gradient descent on the (weighted) mean loss of a batch; ``context``: a row per place."""
        n = len(target)
        share = np.full(n, 1 / n, np.float32) if weight is None else (weight / weight.sum()).astype(np.float32)
        hidden, _, wrong = self.forward(context)
        wrong *= (share / wrong.sum(axis=1))[:, None]
        wrong[np.arange(n), target] -= share
        back = (wrong @ self.out.T) * (1 - hidden * hidden)
        self.out -= rate * (hidden.T @ wrong)
        self.out_bias -= rate * wrong.sum(axis=0)
        self.bias -= rate * back.sum(axis=0)
        for k in range(2 * WINDOW):  # sums by token: sorted rows, then reduced
            order = np.argsort(context[k], kind="stable")
            token = context[k][order]
            at, _ = textops.runs(token)
            # Rare tokens would hardly move under the mean; the step is that of the batch's sum, at most ten times the mean's.
            self.embed[k][token[at]] -= 10 * rate * np.add.reduceat(back.take(order, axis=0), at, axis=0)

    def score(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probabilities of the targets; both arguments may hold classes or numbered words."""
        out = np.empty(len(target), np.float64)
        word, context, target = target, classes(context), classes(target)
        for i in range(0, len(target), BATCH):
            part = target[i : i + BATCH]
            _, scores, e = self.forward(context[:, i : i + BATCH])
            out[i : i + BATCH] = scores[np.arange(len(part)), part] - np.log(e.sum(axis=1))
        if len(self.within):
            shared = np.flatnonzero((word >= OWN) & (word != BOUNDARY))
            at = word[shared].astype(np.int64)
            out[shared] += self.within[np.where(at < VOCABULARY, at - OWN, SHARED + (at - VOCABULARY) // SHARED)]
        return out


def numbered(buf: np.ndarray, offs: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts (a row per place) and numbers of all tokens of a slice, and the tokens before each row.

    ``vocabulary``: sorted hashes of at most ``OWN`` words with a class, then those of the other numbered words, sorted.
    The ``i``-th of these in class ``OWN + c`` is ``VOCABULARY + i * SHARED + c``.
    """
    h, before = _word_hashes(buf, offs)
    own, others = vocabulary[:OWN], vocabulary[OWN:]
    token = (OWN + h % np.uint64(SHARED)).astype(np.int64 if len(others) else np.int16)
    if len(own):
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        hit = own[at] == h
        if len(others):
            rest = np.flatnonzero(~hit)
            k = np.minimum(np.searchsorted(others, h[rest]), len(others) - 1)
            known = others[k] == h[rest]
            token[rest[known]] += VOCABULARY - OWN + k[known] * SHARED
        token[hit] = at[hit]
    context = np.full((2 * WINDOW, len(token)), BOUNDARY, token.dtype)
    starts = before[:-1]
    for k, d in enumerate(d for d in range(-WINDOW, WINDOW + 1) if d):
        if d < 0:
            context[k, -d:] = token[:d]
        else:
            context[k, :-d] = token[d:]
        for j in range(abs(d)):  # the places that lie beyond a row's ends
            at = starts + j if d < 0 else before[1:] - 1 - j
            inside = (at >= starts) & (at < before[1:])
            context[k, at[inside]] = BOUNDARY
    return context, token, before


class Course:
    """One shard's way through its texts: ``BATCH`` tokens a step in the order given, wherever Arrow batches begin."""

    def __init__(self, flat: np.ndarray):
        self.net, self.seen, self.rest = Network(flat), 0, None

    def take(self, context: np.ndarray, token: np.ndarray, weight: np.ndarray, last: bool = False) -> None:
        if self.rest is not None:
            context, token, weight = (np.concatenate(x, axis=-1) for x in zip(self.rest, (context, token, weight), strict=True))
        end = len(token) if last else len(token) - len(token) % BATCH
        for i in range(0, end, BATCH):
            j = min(i + BATCH, end)
            self.net.train(context[:, i:j], token[i:j], RATE, weight[i:j])
        self.seen += end
        self.rest = context[:, end:], token[end:], weight[end:]

    def end(self, shard: int) -> Iterator[pa.RecordBatch]:
        if self.rest is not None:
            none = np.zeros(0, np.int64)
            self.take(np.zeros((2 * WINDOW, 0), np.int64), none, none.astype(np.float64), last=True)
        if self.seen:
            yield _weights(shard, self.seen, self.net.flat.astype(np.float64) * self.seen)


def _weights(shard: int, seen: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["shard", "n", "w"])


WEIGHTS = "shard long, n long, w binary"


def dealt(docs: DataFrame, part: int, rounds: int, shards: int) -> DataFrame:
    """``shard, h, text, n`` of the distinct texts of a round, a shard in one partition and in a fixed order.

    Copies are counted in every Arrow batch before the shuffle, so a text of a third of all rows sends few of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from pa.table([batch.column(0)], ["text"]).group_by("text").aggregate([([], "count_all")]).rename_columns(["text", "n"]).to_batches()

    h = F.xxhash64("text")
    texts = docs.select("text").where(F.col("text").isNotNull() & (F.pmod(h, F.lit(rounds)) == part)).mapInArrow(run, "text string, n long")
    texts = texts.withColumn("h", h).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    return texts.repartition(shards, "shard").groupBy("shard", "h", "text").agg(F.sum("n").alias("n")).sortWithinPartitions("shard", "h", "text")


def averaged(weights: DataFrame, shards: int) -> list:
    """Sums of at most ``FAN`` groups of shards; every sum is taken in the order of shards, so it is the same each time."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = np.zeros(Network.SIZE)
        for w in table.column("w"):
            total += np.frombuffer(w.as_py(), np.float64)
        return pa.Table.from_batches([_weights(table.column("shard")[0].as_py() // FAN, sum(table.column("n").to_pylist()), total)])

    while shards > FAN:
        weights = weights.groupBy(F.floor(F.col("shard") / FAN).alias("g")).applyInArrow(lambda t: add(t.select(["shard", "n", "w"])), WEIGHTS)
        shards = -(-shards // FAN)
    return sorted(weights.collect(), key=lambda r: r.shard)  # at most FAN rows of Network.SIZE numbers


def train(docs: DataFrame, vocabulary: np.ndarray, tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one pass over all distinct texts in ``rounds`` rounds; ``tokens``: how many the rows have."""
    flat, shards = Network().flat, max(1, -(-tokens // (rounds * SHARD_TOKENS)))
    for part in range(rounds):
        given = docs.sparkSession.sparkContext.broadcast((flat, vocabulary))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            flat, vocabulary = given.value
            shard, course = -1, Course(flat)
            for batch in batches:
                of = batch.column(0).to_numpy(zero_copy_only=False)
                at, size = textops.runs(of)
                for a, m in zip(at.tolist(), size.tolist(), strict=True):
                    if of[a] != shard:
                        yield from course.end(shard)
                        shard, course = int(of[a]), Course(flat)
                    rows = batch.slice(a, m)
                    copies = rows.column(2).to_numpy(zero_copy_only=False)
                    for i, j, buf, offs in textops.slices(rows, "text"):
                        context, token, before = numbered(buf, offs, vocabulary)
                        course.take(context, token, np.repeat(copies[i:j], np.diff(before)).astype(np.float64))
            yield from course.end(shard)

        rows = averaged(dealt(docs, part, rounds, shards).select("shard", "text", "n").mapInArrow(run, WEIGHTS), shards)
        given.unpersist()
        if rows:
            flat = (sum(np.frombuffer(r.w, np.float64) for r in rows) / sum(r.n for r in rows)).astype(np.float32)
    return flat


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and vocabulary from all rows of ``text``."""
    counts, path = common.write_shared(docs.sparkSession, count_words(docs), "words")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(OWN).collect()
    own = np.array([r.word for r in top], np.int64).view(np.uint64)
    own_n = np.array([r.n for r in top], np.int64)
    # All occurrences in each class, those of words under LEAST, and the number of these; the hash is unsigned.
    shared = F.expr(f"cast((2 * (shiftrightunsigned(word, 1) % {SHARED}) + (word & 1)) % {SHARED} as int)")
    rare = F.col("n") < LEAST
    sums = np.zeros((3, SHARED))
    for r in counts.groupBy(shared.alias("c")).agg(F.sum("n").alias("n"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("rare_n"), F.count(F.when(rare, 1)).alias("rare")).collect():
        sums[:, r.c] = r.n, r.rare_n, r.rare
    np.subtract.at(sums, (slice(None), (own % np.uint64(SHARED)).astype(np.int64)), np.stack([own_n, np.where(own_n < LEAST, own_n, 0), own_n < LEAST]))
    listed = counts.where(~rare).toPandas()  # grows with the input
    common.drop_shared(docs.sparkSession, path)
    h, n = listed["word"].to_numpy(np.int64).view(np.uint64), listed["n"].to_numpy(np.int64)
    order = np.argsort(h)
    order = order[~np.isin(h[order], own)]
    h, n = h[order], n[order]
    total = sums[0] + 1  # one more for a word that no row had
    within = np.concatenate((np.log((sums[1] + 1) / total / (sums[2] + 1)), np.log(n / total[(h % np.uint64(SHARED)).astype(np.int64)])))
    own = np.sort(own)
    return np.concatenate((train(docs, own, tokens, rounds), within.astype(np.float32))), np.concatenate((own, h))


def score(docs: DataFrame, flat: np.ndarray, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n_tokens, log_p, mean_log_p`` of every row."""
    given = docs.sparkSession.sparkContext.broadcast((flat, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, vocabulary = given.value
        net = Network(flat)
        for batch in batches:
            sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, buf, offs in textops.slices(batch, "text"):
                context, token, before = numbered(buf, offs, vocabulary)
                n = np.diff(before)
                sums.append(np.bincount(np.repeat(np.arange(len(n)), n), net.score(context, token), len(n)))
                counts.append(n)
            total, n = np.concatenate(sums), np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)], ["doc_id", "n_tokens", "log_p", "mean_log_p"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, log_p double, mean_log_p double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, *fit(docs))
