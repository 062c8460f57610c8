"""Quality classifier by positive-unlabelled learning.

A text becomes FEATURES numbers about its characters, words and lines.  Trusted
positives and unlabelled texts train a small network by the non-negative
unbiased risk  prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])
with the logistic loss.  The class prior is estimated from positive and
unlabelled scores of plain positive-against-unlabelled fits, each half scored by
the fit on the other half: the least upper-bounded ratio of their tails (best
bin).  Negative labels are not used.

The fit uses at most SAMPLE positives and SAMPLE unlabelled rows, those with
the smallest hash of the features; the tails of the prior are counted over all rows.

Defined results: a null text scores as an empty one; repeated rows give
repeated rows; a document labelled more than once is trusted only if no label
says 0; without positives every score is the estimated prior of 0.5; whole
texts count, however long; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import SPACES, append, cut, encode, word_hashes

SAMPLE = 20_000
HIDDEN = 16
BINS = 1000
STEPS, DECAY, NOISE = 1500, 1e-2, 0.3


def _classes() -> np.ndarray:
    groups = np.full(256, 8)
    for g, members in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10,), b".,;:'\"?-()", b"!", b"|")):
        groups[list(members)] = g
    groups[list(b"#$%&*@^~=+<>{}[]\\/_`")] = 9
    groups[128:] = 10
    return groups


_GROUP = _classes()
GROUPS = 11
FEATURES = GROUPS + 12


def features(text: str | None) -> np.ndarray:
    raw = encode(text)
    x = np.zeros(FEATURES, np.float32)
    counts = np.zeros(GROUPS)
    for at in range(0, len(raw), 1 << 20):
        counts += np.bincount(_GROUP[np.frombuffer(raw[at : at + (1 << 20)], np.uint8)], minlength=GROUPS)
    n = max(1, len(raw))
    x[:GROUPS] = counts / n
    words = word_hashes(raw, SPACES)
    k = len(words)
    lines = [s for s in raw.split(b"\n") if s]
    letters = max(1.0, counts[0] + counts[1] + counts[10])
    x[GROUPS] = np.log1p(k) / 10
    x[GROUPS + 1] = counts[1] / letters
    x[GROUPS + 2] = letters / n
    if k:
        kinds, tally = np.unique(words, return_counts=True)
        x[GROUPS + 3] = len(kinds) / k
        x[GROUPS + 4] = np.log1p(len(kinds)) / np.log1p(k)
        x[GROUPS + 5] = tally.max() / k if k > 5 else 0.2
        x[GROUPS + 6] = (words[1:] == words[:-1]).mean() if k > 1 else 0
        x[GROUPS + 7] = min(30, letters / k) / 30
        x[GROUPS + 8] = (counts[5] + counts[6] + counts[7] + counts[9]) / k
        pairs = words[1:] * np.uint64(31) + words[:-1] if k > 1 else words
        x[GROUPS + 9] = len(np.unique(pairs)) / len(pairs)
    if lines:
        x[GROUPS + 10] = len(set(lines)) / len(lines)
        x[GROUPS + 11] = min(1.0, sum(map(len, lines)) / len(lines) / 500)
    return x


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b) @ self.v + self.c

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = STEPS, batch: int = 1024, rate: float = 0.01, seed: int = 7, decay: float = DECAY, noise: float = NOISE) -> Network:
    """Adam on the non-negative risk; with no prior: on positive against unlabelled, each weighing half."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-3, rng.normal(0, 0.3, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0)
    clipped = lambda x: np.clip((x - net.mean) / net.scale, -8, 8)
    P, U = clipped(positive), clipped(unlabelled)
    params = [net.w, net.b, net.v, np.zeros(1)]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        p, u = P[rng.integers(0, len(P), batch)], U[rng.integers(0, len(U), batch)]
        x = np.concatenate([p, u])
        # noise on the inputs keeps a small sample from being learned by heart
        x = x + noise * rng.normal(size=x.shape)
        h = np.tanh(x @ params[0] + params[1])
        z = h @ params[2] + params[3][0]
        zp, zu = z[:batch], z[batch:]
        if prior is None:
            g = np.concatenate([-sigmoid(-zp), sigmoid(zu)]) / (2 * batch)
        else:
            # derivatives of softplus(-z) and softplus(z)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                g = np.concatenate([prior * (-sigmoid(-zp) - sigmoid(zp)), sigmoid(zu)]) / batch
            else:
                # the negative part is below zero: step back along it only
                g = np.concatenate([prior * sigmoid(zp), -sigmoid(zu)]) / batch
        gh = np.outer(g, params[2]) * (1 - h * h)
        grads = [x.T @ gh + decay * params[0], gh.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
        step = rate * min(1, 3 * (1 - t / (steps + 1)))
        for k, gr in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * gr
            s[k] = 0.999 * s[k] + 0.001 * gr * gr
            params[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    net.w, net.b, net.v, net.c = params[0], params[1], params[2], float(params[3][0])
    return net


def estimate_prior(positive_bins: np.ndarray, unlabelled_bins: np.ndarray) -> float:
    """Best bin: over all upper tails, the least ratio of unlabelled to positive share plus its confidence width."""
    p, u = np.cumsum(positive_bins[::-1]), np.cumsum(unlabelled_bins[::-1])
    if not p[-1] or not u[-1]:
        return 0.5
    share_p, share_u = p / p[-1], u / u[-1]
    width = np.sqrt(np.log(20) / (2 * p[-1])) + np.sqrt(np.log(20) / (2 * u[-1]))
    use = share_p > 0
    best = np.argmin(((share_u + width) / np.maximum(share_p, 1e-9))[use])
    return float(np.clip((share_u[use] / share_p[use])[best], 0.02, 0.98))


@dataclass
class Model:
    network: Network | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.network.score(x) if self.network else np.full(len(x), self.prior)


def featurise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with their features (float32, binary)."""
    return append(docs, [text], lambda texts: [[features(t).tobytes() for t in texts]], "pu_features binary")


def fit(rows: DataFrame, labels: DataFrame, key: str, may_learn: Column, label_key: str | None = None) -> Model:
    """rows: key and pu_features of all documents; labels: label_key (or key), quality."""
    trusted = labels.where("quality is not null").groupBy(F.col(label_key or key).alias("k")).agg(F.min("quality").alias("q")).where("q = 1").select("k")
    pool = rows.where(may_learn)
    positives = pool.join(trusted, pool[key] == trusted["k"], "left_semi")
    some = lambda df: df.select("pu_features").orderBy(F.xxhash64("pu_features"), "pu_features").limit(SAMPLE).toPandas()["pu_features"]
    array = lambda s: np.stack([np.frombuffer(v, np.float32) for v in s]).astype(float) if len(s) else np.empty((0, FEATURES))
    P, U = array(some(positives)), array(some(pool))
    if not len(P) or not len(U):
        return Model(None, 0.5)
    # each half is scored by the network fitted on the other, so that nothing learned by heart counts
    half = lambda v: np.array([zlib.crc32(b) % 2 for b in v], int)
    halves = [half([r.astype(np.float32).tobytes() for r in x]) for x in (P, U)]
    plain = [train(P[halves[0] != f], U[halves[1] != f], None, steps=600) if (halves[0] != f).any() and (halves[1] != f).any() else None for f in (0, 1)]
    if None in plain:
        plain = [train(P, U, None, steps=600)] * 2

    def binned_scores(values):
        if not values:
            return [[]]
        x, which = array(values), half(values)
        both = np.where(which == 0, plain[0].score(x), plain[1].score(x))
        return [np.minimum(BINS - 1, both * BINS).astype(int).tolist()]

    def bins(df: DataFrame) -> np.ndarray:
        binned = append(df.select("pu_features"), ["pu_features"], binned_scores, "bin int")
        out = np.zeros(BINS)
        for r in binned.groupBy("bin").count().collect():  # BINS rows at most
            out[r["bin"]] = r["count"]
        return out

    prior = estimate_prior(bins(positives), bins(pool))
    return Model(train(P, U, prior), prior)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with pu_features) with quality_score."""

    def run(values):
        x = np.stack([np.frombuffer(v, np.float32) for v in values]).astype(float) if values else np.empty((0, FEATURES))
        return [model.score(x).tolist()]

    return append(rows, ["pu_features"], run, "quality_score double")


def classify(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), carry_text: bool = False, label_key: str | None = None) -> DataFrame:
    """key, `keep` columns, with carry_text the text, and quality_score of every row of docs.

    Features are computed once and cut; only with carry_text the texts are read
    a second time, to be scored where they stand, so that no text is shuffled.
    """
    rows = cut(featurise(docs.select(key, *keep, text), text).drop(text))
    model = fit(rows, labels, key, may_learn, label_key)
    if not carry_text:
        return score(rows, model).drop("pu_features")
    run = lambda texts: [model.score(np.stack([features(t) for t in texts]).astype(float)).tolist() if texts else []]
    return append(docs.select(key, *keep, text), [text], run, "quality_score double")
