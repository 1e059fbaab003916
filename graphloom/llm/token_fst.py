"""Token counts by a compiled finite-state transducer.

A SentencePiece BPE model is compiled into a deterministic transducer over characters.  The state after a
prefix holds, for every piece still open, its node in the trie of pieces, the last token before it and its
token count less the prefix's; reading a character closes exactly one open piece whose pair with the
token before is one that the model itself would leave apart.  That piece is the prefix's
last token, and the transition emits the change of the prefix's token count (so it may be negative;
the sum over a text is the count of its encoding).  States and transitions are made when first
needed and kept by the Python worker; their number is bounded, beyond it the compilation starts anew.

A text is cut into chunks.  Behind a space that follows a non-space, and behind a character that no longer piece
holds, the state is the same whatever came before, so a chunk with such a place has a constant state map for
what follows it.  The map of any other chunk is kept over its live states, those in which it may be entered.  All chunks
run in lockstep; a prefix scan by doubling composes the maps and gives every chunk's entry state, from which the
constant chunks' heads are run.  Memory is bounded by the slice, not by the corpus.

Defined cases: null and empty text have no tokens; repeated rows count the same; other columns are
dropped; strings of special tokens are ordinary text; no task sees more than a slice at a time.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, textops

CHUNK = 256
#: Cells (4 bytes) of the transition table at which the compilation starts anew.
MOST_CELLS = 24_000_000
#: Emissions are stored as six bits above this number.
SHIFT, LEAST = 6, 32
SPACE_MARK = "▁"
#: Pieces below a trie node up to which a state keeps the set that may still close in place of the token before.
SMALL = 24
#: Remembered answers about pairs.
MOST_PAIRS = 200_000


class Overflow(Exception):
    """The transition table is full."""


class Transducer:
    def __init__(self, model_path: str, most_cells: int = MOST_CELLS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.most_cells = most_cells
        sp, special = self.sp, lambda i: self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)
        pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not special(i)}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece holds a space behind another character; words cannot be told apart")
        if any(c not in pieces for p in pieces for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.text = {i: p for p, i in pieces.items()}
        self.rank = {i: -sp.get_score(i) for i in pieces.values()}
        self.pair = {(pieces[p[:k]], pieces[p[k:]]): self.rank[i] for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces}
        self.split: dict[int, tuple[int, int]] = {}
        self.odd = {i for p, i in pieces.items() if set(p) == {SPACE_MARK}}  # equal ranks; left to the model
        self.children: list[dict[str, int]] = [{}]
        self.token = [-1]
        for p, i in pieces.items():
            if len(p) > 1 and not self._merge(p, i, pieces):
                continue
            at = 0
            for c in p:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                at = self.children[at][c]
            self.token[at] = i
        self.below: list[int] = [0] * len(self.children)
        for at in range(len(self.children) - 1, -1, -1):  # children have larger numbers than their parent
            self.below[at] = sum(self.below[x] + (self.token[x] >= 0) for x in self.children[at].values())
        joined = {c for p in pieces if len(p) > 1 for c in p}
        self.alone = {p for p in pieces if len(p) == 1 and p not in joined}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.ends: dict[int, list] = {}
        self.begins: dict[int, list] = {}
        self.under: dict[int, frozenset[int]] = {}
        self.reset()

    def _tokens(self, marked: str) -> list[int]:
        """The tokens of a text behind a line end, which no piece holds."""
        return self.sp.encode("\n" + marked.replace(SPACE_MARK, " "))[2:]

    def _merge(self, piece: str, i: int, pieces: dict[str, int]) -> bool:
        """Whether a piece is its own encoding; its last merge is noted."""
        parts = [pieces[c] for c in piece]
        while len(parts) > 1:
            best, k = min((self.pair.get(x, float("inf")), k) for k, x in enumerate(zip(parts, parts[1:], strict=False)))
            if best == float("inf"):
                return False
            left, right = parts[k : k + 2]
            parts[k : k + 2] = [pieces[self.text[left] + self.text[right]]]
        self.split[i] = (left, right)
        if any(len(self.text[x]) > 1 and self.rank[x] >= self.rank[i] for x in (left, right)):
            self.odd.add(i)
        return True

    def _spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at an end of ``t`` while it is merged, each with the rank of the merge that takes it up."""
        out, until = [(t, float("inf"))], 0.0
        while t in self.split:
            t, until = self.split[t][side], self.rank[t]
            out.append((t, until))
        return out

    def _leave(self, a: int, b: int) -> bool:
        """Whether the model leaves two neighbouring tokens as they are: no merge across comes before those inside."""
        if a in self.odd or b in self.odd:
            return self._tokens(self.text[a] + self.text[b]) == [a, b]
        lefts, rights = self.ends.get(a), self.begins.get(b)
        if lefts is None:
            lefts = self.ends[a] = self._spine(a, 1)
        if rights is None:
            rights = self.begins[b] = self._spine(b, 0)
        pair = self.pair
        return not any((r := pair.get((x, y))) is not None and r < until and r <= until_y for x, until in lefts for y, until_y in rights)

    def _apart(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = a < 0 or self._leave(a, b)
        return got

    def _behind(self, node: int, before: int) -> int | None:
        """What an open piece must know of the token before it: the token, or (for a small subtree, as a number
        below -1) the set of pieces that may still close behind it; None if none may."""
        if before < -1:
            left = self.sets[-2 - before] & self._pieces(node)
        elif before < 0 or self.below[node] > SMALL:
            return before
        else:
            got = self.behind.get((node, before), 0)
            if got != 0:
                return got
            left = frozenset(t for t in self._pieces(node) if self._leave(before, t))
        got = None
        if left:
            got = self.set_of.setdefault(left, -2 - len(self.sets))
            if got == -2 - len(self.sets):
                self.sets.append(left)
        if before >= 0:
            self.behind[node, before] = got
        return got

    def _pieces(self, node: int) -> frozenset[int]:
        """All pieces strictly below a node."""
        got = self.under.get(node)
        if got is None:
            found, todo = [], [*self.children[node].values()]
            while todo:
                x = todo.pop()
                todo += self.children[x].values()
                if self.token[x] >= 0:
                    found.append(self.token[x])
            got = self.under[node] = frozenset(found)
        return got

    def reset(self) -> None:
        """Forget all states; classes 0 to 4: resetting characters that emit so many tokens, class 5: the space mark."""
        self.columns, self.rows = 64, 1024
        self.sets: list[frozenset[int]] = []
        self.set_of: dict[frozenset[int], int] = {}
        self.behind: dict[tuple[int, int], int | None] = {}
        self.pairs.clear()
        self.table = np.full((self.rows, self.columns), -1, np.int32)
        self.class_of = np.full(0x110000, -1, np.int16)
        self.class_of[[32, ord(SPACE_MARK)]] = 5
        self.chars: list[str] = ["", "", "", "", "", SPACE_MARK]
        self.states: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.spaced: list[bool] = []
        self.start = self._state(((0, -1, 0),), False)
        self.after_space = self._transition(self.start, 5)[0]

    def _state(self, open_pieces: tuple, spaced: bool) -> int:
        key = (open_pieces, spaced)
        i = self.states.get(key)
        if i is None:
            i = self.states[key] = len(self.known)
            self.known.append(open_pieces)
            self.spaced.append(spaced)
            if i >= self.rows:
                if 2 * self.rows * self.columns > self.most_cells:
                    raise Overflow
                self.table = np.concatenate((self.table, np.full((self.rows, self.columns), -1, np.int32)))
                self.rows *= 2
        return i

    def _transition(self, state: int, k: int) -> tuple[int, int]:
        """The next state and the change of the token count."""
        if k < 5:
            return self.start, k
        if k == 5 and not self.spaced[state] and state != self.start:
            return self.after_space, 1
        c, kept, last, change = self.chars[k], [], None, 0
        for node, before, rel in self.known[state]:
            child = self.children[node].get(c)
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and last is None and (t in self.sets[-2 - before] if before < -1 else self._apart(before, t)):
                last, change = t, rel + 1
            if self.below[child] and (behind := self._behind(child, before)) is not None:
                kept.append((child, behind, rel))
        spaced = k == 5
        return self._state((*((n, b, r - change) for n, b, r in kept), (0, last, 0)), spaced), change

    def classes(self, cps: np.ndarray) -> np.ndarray:
        """The class of each character; new characters get theirs now."""
        out = self.class_of[cps]
        if len(out) and out.min() < 0:
            for cp in np.unique(cps[out < 0]).tolist():
                c = chr(cp)
                if c in self.alone:
                    k = 1
                elif c not in self.children[0]:
                    k = len(c.encode("utf-8"))
                else:
                    k = len(self.chars)
                    if k >= self.columns:
                        if 2 * self.rows * self.columns > self.most_cells:
                            raise Overflow
                        self.table = np.concatenate((self.table, np.full((self.rows, self.columns), -1, np.int32)), axis=1)
                        self.columns *= 2
                    self.chars.append(c)
                self.class_of[cp] = k
            out = self.class_of[cps]
        return out

    def run(self, cls: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run lanes ``[start, end)`` from their states in lockstep: exit states and emitted counts."""
        length = end - start
        order = np.argsort(-length, kind="stable")
        pos, s, sizes = start[order], state[order].astype(np.int64), length[order]
        count = np.zeros(len(order), np.int64)
        active = len(order) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), "right")
        for n in active.tolist():
            c = cls[pos[:n]]
            v = self.table.ravel()[s[:n] * self.columns + c]
            if v.min() < 0:
                miss = v < 0
                for x in np.unique(s[:n][miss] * 65536 + c[miss]).tolist():
                    at, k = divmod(x, 65536)
                    to, change = self._transition(at, k)
                    self.table[at, k] = to << SHIFT | change + LEAST
                v = self.table.ravel()[s[:n] * self.columns + c]
            s[:n] = v >> SHIFT
            count[:n] += v & (1 << SHIFT) - 1
            pos[:n] += 1
        out_s, out_n = np.empty_like(s), np.empty_like(count)
        out_s[order], out_n[order] = s, count - LEAST * sizes
        return out_s, out_n

    def count(self, cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row of a slice."""
        cls = self.classes(cps)
        sizes = np.diff(offs)
        chunks = -(-sizes // CHUNK)
        row = np.repeat(np.arange(len(sizes)), chunks)
        if not len(row):
            return np.zeros(len(sizes), np.int64)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = offs[row] + nth * CHUNK
        end = np.minimum(start + CHUNK, offs[row + 1])
        first = nth == 0
        fixed = cls < 5  # behind these the state is known
        fixed[1:] |= (cls[1:] == 5) & (cls[:-1] != 5)
        fixed[offs[:-1][sizes > 0]] &= cls[offs[:-1][sizes > 0]] < 5
        places = np.flatnonzero(fixed)
        at = np.append(places, len(cls))[np.searchsorted(places, start)]
        constant = first | (at < end)
        # Constant maps: from the place (or the row's start, behind its space mark) to the chunk's end.
        begin = np.where(first, start, np.minimum(at, end - 1) + 1)
        here = cls[np.minimum(at, len(cls) - 1)]
        state = np.where(first, self.after_space, np.where(here == 5, self.after_space, self.start))
        total = np.where(first, 1, np.where(here == 5, 1, here)).astype(np.int64) * constant
        leave = np.full(len(row), -1, np.int64)
        leave[constant], n = self.run(cls, begin[constant], end[constant], state[constant])
        total[constant] += n
        if not constant.all():
            self._compose(cls, start, end, constant, leave, total)
        heads = np.flatnonzero(constant & ~first)
        total[heads] += self.run(cls, start[heads], at[heads], leave[heads - 1])[1]
        return np.bincount(row, total, len(sizes)).astype(np.int64)

    def _compose(self, cls: np.ndarray, start: np.ndarray, end: np.ndarray, constant: np.ndarray, leave: np.ndarray, total: np.ndarray) -> None:
        """Exit states and counts of the chunks without a constant map, into ``leave`` and ``total``.

        Such a chunk's map is kept over its live states: those it may be entered in.  The first one is what a run over the
        chunk before it, from the start state, ends in (most texts forget their past within a chunk); more come from exits of
        the maps before.  All chunks apply their new states in one run, then pointer doubling composes the maps, until
        every chunk's entry is among its live states.
        """
        open_ = np.flatnonzero(~constant)
        known: dict[tuple[int, int], int] = {}  # (chunk, live state) -> point
        chunk, exit_, count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        after_fixed = constant[open_ - 1]
        guess = np.where(after_fixed, leave[open_ - 1], -1)
        far = np.flatnonzero(~after_fixed)
        guess[far] = self.run(cls, start[open_[far] - 1], end[open_[far] - 1], np.full(len(far), self.start))[0]
        new = list(zip(open_.tolist(), guess.tolist(), strict=True))
        while new:
            for i, x in enumerate(new):
                known[x] = len(chunk) + i
            at, s = (np.array(x, np.int64) for x in zip(*new, strict=True))
            left, n = self.run(cls, start[at], end[at], s)
            chunk, exit_, count = np.concatenate((chunk, at)), np.concatenate((exit_, left)), np.concatenate((count, n))
            # Each point's successor: the point of the next chunk that is entered in this point's exit state.
            follows = [(c + 1, x) for c, x in zip(chunk.tolist(), exit_.tolist(), strict=True)]
            runs_on = np.append(~constant, False)[chunk + 1] & (np.append(start, -1)[chunk + 1] == end[chunk])
            new = sorted({f for f, r in zip(follows, runs_on.tolist(), strict=True) if r and f not in known})
        jump = np.array([known[f] if r else i for i, (f, r) in enumerate(zip(follows, runs_on.tolist(), strict=True))], np.int64)
        # Prefix scan: which points are reached from the first chunk of a chain, by doubling the steps taken.
        real = np.zeros(len(chunk), bool)
        real[[known[x] for x in zip(open_[after_fixed].tolist(), guess[after_fixed].tolist(), strict=True)]] = True
        while True:
            reached = real.copy()
            reached[jump[real]] = True
            if (reached == real).all():
                break
            real, jump = reached, jump[jump]
        leave[chunk[real]] = exit_[real]
        total[chunk[real]] += count[real]

    def count_slice(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        cps, at = textops.code_points(buf, offs)
        while True:
            try:
                return self.count(cps, at)
            except Overflow:
                if len(self.known) < 2048 or getattr(self, "_anew", None) == (len(cps), int(at[-1])):
                    self.most_cells *= 2  # this slice alone needs more
                self._anew = (len(cps), int(at[-1]))
                self.reset()


_compiled: dict[str, Transducer] = textops.keep("token_fst", {})


def transducer(model_path: str) -> Transducer:
    textops.claim("token_fst")
    if model_path not in _compiled:
        _compiled[model_path] = Transducer(model_path)
    return _compiled[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; the model file is read on each executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model_path)
        for batch in batches:
            n_bytes, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, buf, offs in textops.slices(batch, text):
                n_bytes.append(np.diff(offs))
                n_tokens.append(fst.count_slice(buf, offs))
            tokens = np.concatenate(n_tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_bytes)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[key]
    return docs.select(docs[key].alias("doc_id"), docs[text].alias(text)).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.ship(spark)
    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
