"""LM scoring with a gated recurrent network in numpy.

Counts.  All training tokens are counted (64-bit hashes of lower-cased words,
plus one end token for each document).  Workers are told of the at most HEAD
most frequent ones; the others are the tail.

Model.  A GRU reads token after token; the output softmax is factored by
classes: P(token) = P(class | state) * P(token | class).  The NEURAL most
frequent tokens stand in classes of CLASS tokens, whose inner softmax depends
on the state; the rest of the head stands in classes by frequency and the tail
in one class, whose inner distribution is count + 1 over the class's total (the
tail's total holds one unseen token).  Output biases start from the counts, so
that the untrained model is the class-factored unigram model.

Training is truncated backpropagation through time: STREAMS texts side by side
in windows of WINDOW tokens, the state carried from window to window.  Every
training document is used once, in one of ROUNDS rounds by its hash, on the
executors, each over its own partition; after each round the weights are
averaged, weighted by tokens.  The last stream is padded to the length of the
others; padding has no loss.

Texts are cut into words twice: to count them, and, when the vocabulary is known,
to write their tokens' ranks, which training and scoring read.

Scoring runs the whole of each document, window after window, with the state
carried across; the tail's counts are joined in Spark.

Defined results: a null text is an empty one (the end token alone); repeated
rows give repeated rows; without training rows N and V are 0 and every token is
unseen; extra columns are ignored; nothing is cut off, however long.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, encode, signed, trim, word_hashes, word_hashes_of
from larkspur.llm.jaccard import _expand, _plain, _squeeze, _unplain

#: tokens that workers are told of (16 bytes each)
HEAD = 300_000
NEURAL = 2048
CLASS = 64
#: bits of a token's hash that tell its ending
SHAPE_BITS = 6
SHAPES, TAILS = 1 << SHAPE_BITS, 8
HIDDEN = 16
STREAMS, WINDOW = 512, 16
ROUNDS = 2
FAN = 16
RATE = 0.6
#: the hash that stands for the end token
END = np.uint64(0xE17D0F7E8D000001)
#: tokens that a worker gathers before it sends their counts; a quarter as many are trained on, half as many scored side by side
GATHER = 4_000_000
#: documents of a batch of results
TOGETHER = 512
#: documents whose tokens are counted at once
COUNTED = 64
#: steps and tokens that are scored at once, if the texts are short enough
STEPS, SIDE = 512, 1 << 14
#: rows whose softmax stays in a core's cache, in scoring and in training; tokens that are looked up at once
CACHED, CACHED_BOTH, PART = 2048, 512, 1 << 18
#: a key of more places is summed by itself
MANY = 16


def tokens_of(text: str | None) -> np.ndarray:
    return np.append(word_hashes(encode(text), shape_bits=SHAPE_BITS), END)


def tokens_of_all(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """tokens_of each text, joined, and the number of each."""
    words, sizes = word_hashes_of([t or b"" for t in texts], SHAPE_BITS)
    sizes += 1
    out = np.empty(int(sizes.sum()), np.uint64)
    last = np.zeros(len(out), bool)
    last[np.cumsum(sizes) - 1] = True
    out[last], out[~last] = END, words
    return out, sizes


def shape_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SHAPES - 1)).astype(np.int64)


def tail_of(shape: np.ndarray) -> np.ndarray:
    return shape * TAILS // SHAPES


@dataclass
class Vocabulary:
    """Head tokens sorted by hash; rank by count.  n_by and v_by: all training tokens and distinct ones, by shape."""

    hashes: np.ndarray
    counts: np.ndarray
    n_by: np.ndarray
    v_by: np.ndarray
    ids: np.ndarray = field(init=False)
    buckets: tuple | None = field(init=False, default=None)

    def __post_init__(self):
        self.n, self.v = int(self.n_by.sum()), int(self.v_by.sum())
        order = np.lexsort((self.hashes, -self.counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids = rank
        by_rank, shape = self.counts[order].astype(float), shape_of(self.hashes[order])
        self.neural = min(NEURAL, len(order))
        self.n_classes = -(-self.neural // CLASS)
        is_neural = np.arange(len(order)) < self.neural
        #: class of a head token by rank: its block if neural, else its shape; tails come last
        self.klass = np.where(is_neural, np.arange(len(order)) // CLASS, self.n_classes + shape).astype(np.int64)
        self.first_tail = self.n_classes + SHAPES
        self.classes = self.first_tail + TAILS
        tails = tail_of(np.arange(SHAPES))
        tail_n = np.bincount(tails, self.n_by, TAILS) - np.bincount(tail_of(shape), by_rank, TAILS)
        tail_v = np.bincount(tails, self.v_by, TAILS) - np.bincount(tail_of(shape), minlength=TAILS)
        mass = np.bincount(self.klass, by_rank, self.classes)
        mass[self.first_tail :] = tail_n + 1
        self.class_bias = np.log(np.maximum(mass, 0.5))
        #: log10 of each tail's total: its tokens, one more for each kind, one for the unseen
        self.tail_log10 = np.log10(tail_n + tail_v + 1)
        inner = np.bincount(self.klass, by_rank + 1, self.classes)
        #: log10 of P(token | class) of the head tokens beyond the neural ones, by rank
        self.static = np.where(is_neural, 0, np.log10((by_rank + 1) / inner[self.klass]))
        self.word_bias = np.log(by_rank[: self.neural])
        self.log10_count = np.log10(by_rank + 1)
        #: input ids: neural tokens, then one for each shape and tail
        self.inputs = self.neural + SHAPES + TAILS

    def _bucketed(self) -> tuple:
        """Where the hashes of each value of their first bits start; built where it is used."""
        bits = max(1, int(len(self.hashes) * 4 - 1).bit_length())
        shift = np.uint64(64 - bits)
        starts = np.searchsorted(self.hashes >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return shift, starts, int(np.diff(starts).max())

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each token, or -1 - tail."""
        if len(hashes) > PART:
            return np.concatenate([self.lookup(hashes[at : at + PART]) for at in range(0, len(hashes), PART)])
        out = -1 - tail_of(shape_of(hashes))
        if not len(self.hashes):
            return out
        if self.buckets is None:
            self.buckets = self._bucketed()
        shift, starts, longest = self.buckets
        bucket = (hashes >> shift).astype(np.int32)
        at, end = starts[bucket], starts[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, own = at[left], end[left], hashes[left]
        for _ in range(longest):
            same = self.hashes[at] == own
            out[left[same]] = self.ids[at[same]]
            more = ~same & (at + 1 < end)
            left, at, end, own = left[more], at[more] + 1, end[more], own[more]
        return out

    def klass_of(self, rank: np.ndarray) -> np.ndarray:
        tail = self.first_tail - 1 - rank
        return np.where(rank >= 0, self.klass[rank], tail) if len(self.klass) else tail

    def inputs_of(self, rank: np.ndarray) -> np.ndarray:
        """A neural token's own id, else that of its class."""
        return np.where((rank >= 0) & (rank < self.neural), rank, self.klass_of(rank) - self.n_classes + self.neural)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def _shift(w: np.ndarray, b: np.ndarray, most: float, starts: np.ndarray) -> list:
    """For the columns from each start on: the largest logit that any state reaches, if one shift fits all states, else None.

    No entry of a state is over `most`, so the largest logit of any state lies between two bounds.
    """
    reach = most * np.abs(w).sum(0)
    top, low = np.maximum.reduceat(b + reach, starts), np.maximum.reduceat(b - reach, starts)
    return [t if t - m < 60 else None for t, m in zip(top, low, strict=True)]


def _with_one(states: np.ndarray) -> np.ndarray:
    """A last column of ones, so that one product also adds the biases."""
    out = np.empty((len(states), states.shape[1] + 1), states.dtype)
    out[:, :-1], out[:, -1] = states, 1
    return out


def _over(w: np.ndarray, b: np.ndarray, top) -> np.ndarray:
    """The biases, less the shift if one is known, as the last row of the weights."""
    return np.concatenate([w, (b if top is None else b - top)[None]]).astype(w.dtype, copy=False)


def _softmax(states: np.ndarray, w: np.ndarray, top, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """exp of states @ w (of _with_one, _over), shifted to stay in range (by `top`, from _shift), their sums, and the shifted logits at `rows` of each state."""
    logits = states @ w
    if top is None:
        logits -= logits.max(1, keepdims=True)
    own = None if rows is None else logits[np.arange(len(logits)), rows]
    e = np.exp(logits, out=logits)
    return e, e @ np.ones(e.shape[1], e.dtype), own


def _sums(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum over the places of each: values has the places of the keys as its second axis.

    The keys of few places are summed side by side, first places, second places and so on; np.add.reduceat takes a call for every place.
    """
    by = np.argsort(keys, kind="stable")
    own = keys[by]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(first, append=len(keys))
    order = np.argsort(-size, kind="stable")
    start, size = first[order], size[order]
    over = np.searchsorted(-size, -np.arange(MANY + 1), "left")  # how many keys have more places than that
    many = int(over[MANY])
    out = values.take(by[start], 1)
    for i in range(1, MANY):
        if over[i] == many:
            break
        out[:, many : over[i]] += values.take(by[start[many : over[i]] + i], 1)
    for i in range(many):
        out[:, i] = np.ones(size[i], values.dtype) @ values.take(by[start[i] : start[i] + size[i]], 1)
    return own[start], out


def _by_gate(u: np.ndarray) -> np.ndarray:
    """The weights from state to gates, a matrix for each gate."""
    return np.ascontiguousarray(u.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))


class Gru:
    """Weights: G (input by gates), U (state by gates), Wc, bc (classes), Wv, bv (tokens in their class)."""

    NAMES = ("G", "U", "Wc", "bc", "Wv", "bv")

    def __init__(self, vocabulary: Vocabulary, seed: int = 11):
        rng = np.random.default_rng(seed)
        v, h, f = vocabulary, HIDDEN, np.float32
        self.v = v
        self.G = rng.normal(0, 0.1, (v.inputs, 3 * h)).astype(f)
        self.U = rng.normal(0, h**-0.5 / 2, (h, 3 * h)).astype(f)
        self.Wc, self.bc = rng.normal(0, 0.02, (h, v.classes)).astype(f), v.class_bias.astype(f)
        self.Wv, self.bv = rng.normal(0, 0.02, (h, v.neural)).astype(f), v.word_bias.astype(f)

    def weights(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.NAMES})
        return out.getvalue()

    def load(self, blob: bytes) -> Gru:
        with np.load(io.BytesIO(blob)) as f:
            for k in self.NAMES:
                setattr(self, k, f[k])
        return self

    def step(self, x: np.ndarray, h: np.ndarray):
        a, u = self.G[x], h @ self.U
        g = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r, un = g[:, :HIDDEN], g[:, HIDDEN:], u[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * un)
        return n + z * (h - n), z, r, un, n

    def log_probability(self, states: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Natural log of P(class) * P(token | class) for the neural tokens, of P(class) alone for the others."""
        v = self.v
        klass = v.klass_of(rank)
        out = np.empty(len(rank), states.dtype)
        most = max(1.0, float(np.abs(states).max(initial=0)))
        of_classes, of_words = self._shifts(most)
        ones, wc = _with_one(states), _over(self.Wc, self.bc, of_classes)
        for low in range(0, len(rank), CACHED):
            part = slice(low, low + CACHED)
            _, total, own = _softmax(ones[part], wc, of_classes, klass[part])
            out[part] = own - np.log(total)
        order, ends = self._by_class(klass)
        order = order[: ends[-1]] if len(ends) else order[:0]
        ones, rank, inner = ones.take(order, 0), rank[order], np.empty(len(order), states.dtype)
        start = 0
        for c, end in enumerate(ends):
            low, high = c * CLASS, min((c + 1) * CLASS, v.neural)
            wv = _over(self.Wv[:, low:high], self.bv[low:high], of_words[c]) if end > start else None
            for at in range(start, end, CACHED):
                part = slice(at, min(end, at + CACHED))
                _, total, own = _softmax(ones[part], wv, of_words[c], rank[part] - low)
                inner[part] = own - np.log(total)
            start = end
        out[order] += inner
        return out

    def _shifts(self, most: float) -> tuple:
        """The shifts of the classes' softmax and of each class's own."""
        words = _shift(self.Wv, self.bv, most, np.arange(0, self.v.neural, CLASS)) if self.v.neural else []
        return _shift(self.Wc, self.bc, most, np.array([0]))[0], words

    def _by_class(self, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the neural tokens by class, and the end of each class among them."""
        order = np.argsort(klass.astype(np.int16), kind="stable")
        return order, np.searchsorted(klass[order], np.arange(self.v.n_classes), "right")

    def train(self, inputs: np.ndarray, ranks: np.ndarray, fresh: np.ndarray, rate: float = RATE) -> None:
        """One pass of truncated backpropagation; fresh marks the first token of a text."""
        v, H = self.v, HIDDEN
        streams = STREAMS if len(inputs) >= STREAMS else 1
        length = -(-len(inputs) // streams)
        # time by streams, so that a step reads one row
        padded = lambda a: np.ascontiguousarray(np.concatenate([a, np.zeros(streams * length - len(a), a.dtype)]).reshape(streams, length).T)
        x, y, new, real = padded(inputs), padded(ranks), padded(fresh), padded(np.ones(len(inputs), bool))
        keep = (~new).astype(np.float32)[:, :, None]
        kind = self.U.dtype
        seen = {k: np.full(getattr(self, k).shape, 1e-4, np.float32) for k in self.NAMES}
        h = np.zeros((streams, H), kind)
        grad = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        # each gate of a step stands in one piece: (step, gate, stream, unit), in `gates` (gate, step, stream, unit)
        gate_of = np.arange(3)[:, None]
        room = [np.empty((WINDOW, *shape), kind) for shape in ((streams, H), (streams, H), (streams, H), (streams, H), (3, streams, H), (2, streams, H))]
        all_gates, to_u = np.empty((3, WINDOW, streams, H), kind), np.empty((3, streams, H), kind)
        for at in range(0, length, WINDOW):
            steps = range(at, min(length, at + WINDOW))
            # a gate of all steps stands in one array, so that what needs no later step is worked out at once
            n_steps = len(steps)
            before, states, N, inner, UA, ZR = (a[:n_steps] for a in room)
            by_gate = _by_gate(self.U)
            read = self.G.reshape(-1, H).take(x[at : steps.stop, None] * 3 + gate_of, 0)
            for k, t in enumerate(steps):
                h0 = np.multiply(h, keep[t], out=before[k])
                u = np.matmul(h0, by_gate, out=UA[k])
                z, r = _sigmoid(np.add(read[k, :2], u[:2], out=ZR[k]))
                n = np.multiply(r, u[2], out=N[k])
                n += read[k, 2]
                np.tanh(n, out=n)
                h = np.subtract(h0, n, out=states[k])
                h *= z
                h += n
            S, Y = states.reshape(-1, H), y[at : steps.stop].ravel()
            own_loss = np.flatnonzero(real[at : steps.stop].ravel())
            whole = len(own_loss) == len(S)
            every = S
            if not whole:
                S, Y = S[own_loss], Y[own_loss]
            count = len(Y)
            klass = v.klass_of(Y)
            of_classes, of_words = self._shifts(1.0)
            # the products of a softmax's gradient are made of exp - sum * (own class), and divided by the sum where the arrays are narrow
            ones, wc, both = _with_one(S), _over(self.Wc, self.bc, of_classes), np.zeros((v.classes, H + 1), kind)
            dS = np.empty_like(S)
            for low in range(0, count, CACHED_BOTH):
                part = slice(low, low + CACHED_BOTH)
                p, total, _ = _softmax(ones[part], wc, of_classes)
                p[np.arange(len(p)), klass[part]] -= total
                scale = (1 / (count * total)).astype(kind)[:, None]
                both += p.T @ (ones[part] * scale)
                np.multiply(p @ self.Wc.T, scale, out=dS[part])
            grad["Wc"], grad["bc"] = both[:, :H].T, both[:, H]
            grad["Wv"][:], grad["bv"][:] = 0, 0
            order, ends = self._by_class(klass)
            order = order[: ends[-1]] if len(ends) else order[:0]
            ones, inner_Y, back = ones.take(order, 0), Y.take(order), np.empty((len(order), H), dS.dtype)
            start = 0
            for c, end in enumerate(ends):
                if end > start:
                    low, high = c * CLASS, min((c + 1) * CLASS, v.neural)
                    s, wv = ones[start:end], self.Wv[:, low:high]
                    q, total, _ = _softmax(s, _over(wv, self.bv[low:high], of_words[c]), of_words[c])
                    q[np.arange(end - start), inner_Y[start:end] - low] -= total
                    scale = (1 / (count * total)).astype(kind)[:, None]
                    both = q.T @ (s * scale)
                    grad["Wv"][:, low:high], grad["bv"][low:high] = both[:, :H].T, both[:, H]
                    np.multiply(q @ wv.T, scale, out=back[start:end])
                start = end
            dS[order] += back
            if not whole:
                spread = np.zeros((len(every), H), dS.dtype)
                spread[own_loss] = dS
                dS = spread
            dh = np.zeros_like(h)
            dS = dS.reshape(n_steps, streams, H)
            Z, R, UN = ZR[:, 0], ZR[:, 1], UA[:, 2]
            to_n, to_z, to_r = (1 - Z) * (1 - N * N), (before - N) * Z * (1 - Z), UN * R * (1 - R)
            gates, back_by_gate = all_gates[:, :n_steps], np.ascontiguousarray(by_gate.transpose(0, 2, 1))
            # the last step first
            for k in range(n_steps - 1, -1, -1):
                dh += dS[k]
                dz, dr, dn = gates[:, k]
                np.multiply(dh, to_z[k], out=dz)
                np.multiply(dh, to_n[k], out=dn)
                np.multiply(dn, to_r[k], out=dr)
                np.multiply(dn, R[k], out=inner[k])
                dh *= Z[k]
                for d, back, out in zip((dz, dr, inner[k]), back_by_gate, to_u, strict=True):
                    dh += np.matmul(d, back, out=out)
                dh *= keep[at + k]
            read_by = before.reshape(-1, H).T
            grad["U"] = np.concatenate([read_by @ d.reshape(-1, H) for d in (gates[0], gates[1], inner)], 1)
            # the inputs' rows that this window read
            rows, of_rows = _sums(gates.reshape(3, -1, H), x[at : steps.stop].ravel().astype(np.int16 if v.inputs < 1 << 15 else np.int32))
            of_rows = of_rows.transpose(1, 0, 2).reshape(-1, 3 * H)
            norm = np.sqrt(float((of_rows * of_rows).sum()) + sum(float((g * g).sum()) for k, g in grad.items() if k != "G"))
            shrink = float(min(1.0, 1.0 / (norm + 1e-9)))  # a numpy scalar would widen the weights
            for k in self.NAMES:
                if k == "G":
                    g = of_rows * shrink
                    so_far = seen[k].take(rows, 0) + g * g
                    seen[k][rows] = so_far
                    self.G[rows] -= rate * g / np.sqrt(so_far)
                else:
                    g = grad[k] * shrink
                    seen[k] += g * g
                    setattr(self, k, getattr(self, k) - rate * g / np.sqrt(seen[k]))

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each token array: log10 of the model's probability but for the count + 1 of tail tokens; ranks of all tokens, joined."""
        return self.score_ranks([self.v.lookup(t) for t in texts])

    def score_ranks(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """As score, of tokens that were looked up."""
        v = self.v
        sizes = np.array([len(t) for t in texts])
        rank = np.concatenate(texts)
        starts = np.cumsum(sizes) - sizes
        inputs = v.inputs_of(rank)
        first = int(v.inputs_of(v.lookup(np.array([END], np.uint64)))[0])
        x = np.concatenate([[first], inputs[:-1]])
        x[starts] = first
        order = np.argsort(-sizes, kind="stable")
        h = np.zeros((len(texts), HIDDEN), np.float32)
        total = np.zeros(len(texts))
        descending, most, at = -sizes[order], int(sizes.max()), 0
        by_gate, of_gates, gate_of = _by_gate(self.U), self.G.reshape(-1, HIDDEN), np.arange(3)[:, None]
        while at < most:
            first_live = int(np.searchsorted(descending, -at, "left"))
            steps = np.arange(at, min(most, at + max(1, min(STEPS, SIDE // first_live))))
            lives = np.searchsorted(descending, -steps, "left")  # the texts with more tokens, at each step
            docs = order[:first_live]
            places = starts[docs] + steps[:, None]
            live = np.arange(first_live) < lives[:, None]
            read = of_gates.take(x.take(places, mode="clip")[:, None] * 3 + gate_of, 0)
            states, low = np.empty((int(lives.sum()), HIDDEN), np.float32), 0
            for k, n_live in enumerate(lives.tolist()):
                own, u = h[:n_live], np.matmul(h[:n_live], by_gate)
                gates = read[k, :, :n_live]
                z, r = _sigmoid(np.add(gates[:2], u[:2]))
                n = np.multiply(r, u[2], out=u[2])
                n += gates[2]
                np.tanh(n, out=n)
                own -= n
                own *= z
                own += n
                states[low : low + n_live] = own
                low += n_live
            W, D = places[live], np.broadcast_to(docs, live.shape)[live]
            for low in range(0, len(W), SIDE):
                part = slice(low, low + SIDE)
                total += np.bincount(D[part], self.log_probability(states[part], rank[W[part]]), len(texts))
            at += len(steps)
        total /= np.log(10)
        known = rank >= 0
        static = np.where(known, v.static[rank], -v.tail_log10[np.where(known, 0, -1 - rank)]) if len(v.static) else -v.tail_log10[-1 - rank]
        return total + np.add.reduceat(static, starts), rank


def _counts(texts: DataFrame, buckets: int) -> DataFrame:
    """hash, count of all tokens of the texts."""

    def count(batches):
        def send(held):
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            where = values % np.uint64(buckets)
            order = np.argsort(where, kind="stable")
            ends, start, rows = np.searchsorted(where[order], np.arange(buckets), "right"), 0, []
            for bucket, end in enumerate(ends):
                if end > start:
                    own = order[start:end]
                    rows.append((bucket, _squeeze(values[own]), _plain(counts[own])))
                start = end
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "v", "c"])

        held, load = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, COUNTED):
                held.append(tokens_of_all(batch.column(0).slice(low, COUNTED).cast(pa.binary()).to_pylist())[0])
                load += len(held[-1])
                if load >= GATHER:
                    yield send(held)
                    held, load = [], 0
        if held:
            yield send(held)
        trim()

    def add(frame):
        import pandas as pd

        v = np.concatenate([_expand(b) for b in frame["v"]])
        c = np.concatenate([_unplain(b) for b in frame["c"]])
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        return pd.DataFrame({"hash": signed(v[first]), "count": np.add.reduceat(c, first).astype(np.int64)})

    return texts.mapInArrow(count, "bucket int, v binary, c binary").groupBy("bucket").applyInPandas(add, "hash long, count long")


def _head(counts: DataFrame) -> Vocabulary:
    """The tokens over the least frequency that at most HEAD tokens reach."""
    level = F.floor(F.log2("count") * 16)
    by = counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).orderBy(F.desc("level")).collect()  # 1024 rows at most
    room, least = HEAD, 1 << 30
    for r in by:
        if r["v"] > room:
            break
        room, least = room - r["v"], r["level"]
    n_by, v_by = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in counts.groupBy(F.pmod("hash", F.lit(SHAPES)).alias("shape")).agg(F.count("*").alias("v"), F.sum("count").alias("n")).collect():  # SHAPES rows
        n_by[r["shape"]], v_by[r["shape"]] = r["n"], r["v"]
    got = counts.where(level >= least).toPandas()  # HEAD rows at most
    hashes = got["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], got["count"].to_numpy(np.int64)[order], n_by, v_by)


_UNPACKER = zstandard.ZstdDecompressor()


def _ranks(blob: bytes) -> np.ndarray:
    return np.frombuffer(_UNPACKER.decompress(blob), np.int32)


def _ranked(rows: DataFrame, words) -> DataFrame:
    """rows with, for their text, its ranks (packed), `spot` (a hash that deals texts into rounds) and the hashes of its tail tokens.

    Each text is cut into words and looked up here, once for training and scoring.
    """
    from pyspark.sql.types import StructType

    rows = rows.select(*[c for c in rows.columns if c != "text"], F.xxhash64("text").alias("spot"), "text")
    at = len(rows.columns) - 1
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("ranks binary, tail array<bigint>").fields])

    def run(batches):
        v, packer = words.value, zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for low in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(low, TOGETHER)
                tokens, sizes = tokens_of_all(batch.column(at).cast(pa.binary()).to_pylist())
                rank = v.lookup(tokens).astype(np.int32)
                ends, tail = np.cumsum(sizes), rank < 0
                tails = np.add.reduceat(tail, ends - sizes, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *tails]).astype(np.int32)), pa.array(signed(tokens[tail])))
                packed = [packer.compress(rank[end - n : end].tobytes()) for n, end in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary()), lists], names=[f.name for f in schema])
        trim()

    return rows.mapInArrow(run, schema)


def _trained(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> bytes:
    """Weights after `rounds` rounds, each over its part of the texts (text, or spot and ranks), averaged over partitions."""
    sc = texts.sparkSession.sparkContext
    words = sc.broadcast(vocabulary)
    if "ranks" not in texts.columns:
        texts = _ranked(texts.select("text"), words)
    weights = Gru(vocabulary).weights()
    for turn in range(rounds):
        sent = sc.broadcast(weights)

        def run(batches, sent=sent):
            model, held, done = Gru(words.value).load(sent.value), [], 0

            def learn():
                v = words.value
                rank = np.concatenate(held)
                fresh = np.zeros(len(rank), bool)
                fresh[np.cumsum([0, *(len(t) for t in held[:-1])])] = True
                inputs = v.inputs_of(rank)
                x = np.concatenate([[v.inputs_of(v.lookup(np.array([END], np.uint64)))[0]], inputs[:-1]])
                model.train(x, rank, fresh)
                return len(rank)

            load = 0
            for batch in batches:
                for value in batch.column(0):
                    held.append(_ranks(value.as_py()))
                    load += len(held[-1])
                    if load >= GATHER // 4:
                        done += learn()
                        held, load = [], 0
            if held:
                done += learn()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([done], pa.int64()), pa.array([model.weights()], pa.binary())], names=["part", "n", "w"])

        def mean(frame):
            import pandas as pd

            total, parts = 0, None
            for n, w in zip(frame["n"], frame["w"], strict=True):
                with np.load(io.BytesIO(w)) as f:
                    parts = {k: (parts[k] if parts else 0) + n * f[k].astype(np.float64) for k in Gru.NAMES}
                total += n
            out = io.BytesIO()
            np.savez(out, **{k: (p / total).astype(np.float32) for k, p in parts.items()})
            return pd.DataFrame({"part": [frame["part"].iloc[0]], "n": [total], "w": [out.getvalue()]})

        share = texts.where(F.pmod("spot", F.lit(rounds)) == turn).select("ranks").mapInArrow(run, "part int, n long, w binary")
        level, left = share.withColumn("part", F.spark_partition_id()), max(1, share.rdd.getNumPartitions())
        # a tree of means: no task holds the weights of more than FAN partitions
        while True:
            level = level.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInPandas(mean, "part int, n long, w binary")
            left = -(-left // FAN)
            if left <= 1:
                break
        got = level.collect()
        weights = bytes(got[0]["w"]) if got else weights
    return weights


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    from pyspark.sql.types import StructType

    rows = docs.select(F.col(key).alias("k"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)), F.col(text).alias("text"), learn.alias("learn"))
    training = rows.where("learn").select("text")
    total = rows.count()
    counts = cut(_counts(training, int(min(1_000_000, max(8, total // 20_000)))))
    vocabulary = _head(counts)
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(vocabulary)
    read = cut(_ranked(rows, words))
    weights = _trained(read.where("learn").select("spot", "ranks"), vocabulary)
    sent = sc.broadcast(weights)
    inputs = read.drop("learn", "spot").select(*[c for c in read.columns if c not in ("learn", "spot", "ranks")], "ranks")
    at = len(inputs.columns) - 1
    added = StructType.fromDDL("part int, row bigint, n_tokens bigint, head_known bigint, head_log double, model_log double")
    schema = StructType([*inputs.schema.fields[:-1], *added.fields])

    def run(batches):
        from pyspark import TaskContext

        v, model = words.value, Gru(words.value).load(sent.value)
        number, part = 0, TaskContext.get().partitionId()
        held, texts, load = [], [], 0

        def rows():
            nonlocal number
            model_logs, ranks = model.score_ranks(texts)
            first = at_token = 0
            for batch in held:
                n = batch.num_rows
                own = texts[first : first + n]
                sizes = np.array([len(t) for t in own])
                starts, rank = np.cumsum(sizes) - sizes, ranks[at_token : at_token + int(sizes.sum())]
                known = rank >= 0
                logs = np.where(known, v.log10_count[rank], 0) if len(v.log10_count) else np.zeros(len(rank))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(number, number + n)), pa.array(sizes), pa.array(np.add.reduceat(known, starts, dtype=np.int64)), pa.array(np.add.reduceat(logs, starts)), pa.array(model_logs[first : first + n])],
                    names=[f.name for f in schema],
                )
                number, first, at_token = number + n, first + n, at_token + len(rank)

        for whole in batches:
            for low in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(low, TOGETHER)
                held.append(batch)
                texts += [_ranks(t.as_py()) for t in batch.column(at)]
                load += sum(map(len, texts[-batch.num_rows :]))
                if load >= GATHER // 2:
                    yield from rows()
                    held, texts, load = [], [], 0
        if held:
            yield from rows()
        trim()

    scored = cut(inputs.mapInArrow(run, schema))
    # counts of the tail's tokens
    tail = scored.select("part", "row", F.explode("tail").alias("hash")).groupBy("part", "row", "hash").count().withColumnRenamed("count", "tf")
    found = tail.join(counts, "hash").groupBy("part", "row").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("count") + 1)).alias("tail_log"))
    out = scored.join(found, ["part", "row"], "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return out.select(
        F.col("k").alias(key),
        *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(float(np.log10(vocabulary.n + vocabulary.v + 1)))).alias("base_score"),
        (F.col("model_log") + tail_log).alias("score"),
    )
