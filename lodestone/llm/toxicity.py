"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of two inputs: an embedding of the whole word (hashed) and the mean embedding of its character
4-grams (hashed, with word borders). Both directions read windows of WINDOW words, a new one every STRIDE words, so all
words lie in overlapping windows; attention over the states pools a window to one logit. A document's logit is the
largest of all its windows. Words of over 24 bytes are read in pieces of 24.

Training sees at most FIT_TOXIC toxic and FIT_CLEAN clean labelled documents of at most FIT_BYTES bytes (parameters),
chosen by a hash of the id. Each round picks per document the window with the largest logit, so the network learns from
document labels which windows carry them. The final bias puts the decision between the two classes' training logits.

Training starts from a prior (`prior=False` leaves it out): the first dimension of both embeddings is the log odds of a
bucket to stand in a toxic rather than a clean training document, and the first two rounds pick windows by it. All other
weights start at random, and every weight is trained. README has the held-out accuracy with and without it.

Null, empty and wordless texts get the score of the padding window, a low one; texts of any length are read whole.
Without labels of both classes all scores are the share of toxic labels, 0 without any. A repeated id trains once, with
its smallest text; repeated rows are scored each; an empty table gives no rows. Other columns are not read; carried ones
keep their names, and score and predicted get the first free name (score_1, ...) if those are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.llm._common import free_name, packed, slices, small_batches, table, utf8_of

WINDOW, STRIDE, HIDDEN, DIM, PIECE = 32, 24, 8, 8, 24
WORDS, GRAMS = 1 << 14, 1 << 12
FIT_TOXIC, FIT_CLEAN, FIT_BYTES, ROUNDS = 600, 2500, 1 << 14, 8
SLICE = 1 << 18  # bytes of text that a worker scores at once
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(PIECE)], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(_LOWER).split()
    if max(map(len, words), default=0) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, buckets of their 4-grams, and which of these count. Edge punctuation stays in neither."""
    words = [w.strip(b".,;:!?\"'()[]") or w for w in words]
    m = np.array(words, f"S{PIECE}").view(np.uint8).reshape(len(words), PIECE) if words else np.zeros((0, PIECE), np.uint8)
    with np.errstate(over="ignore"):
        word = ((m.astype(np.uint64) * _POWERS).sum(1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 14)
        n = (m != 0).sum(1)
        edged = np.zeros((len(m), PIECE + 2), np.uint32)
        edged[:, 0], edged[:, 1:-1] = 94, m
        edged[np.arange(len(m)), n + 1] = 36
        g = edged[:, :-3] | edged[:, 1:-2] << np.uint32(8) | edged[:, 2:-1] << np.uint32(16) | edged[:, 3:] << np.uint32(24)
        gram = (g * np.uint32(2654435761)) >> np.uint32(32 - 12)
    there = np.arange(gram.shape[1]) < np.maximum(n - 1, 1)[:, None]
    return word.astype(np.int64), gram.astype(np.int64), there


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: start (in all words) and size of each window, and the number of windows per text, one at least."""
    per = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    own = np.repeat(np.arange(len(lengths)), per)
    k = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
    base = np.cumsum(lengths) - lengths
    return base[own] + k * STRIDE, np.minimum(WINDOW, lengths[own] - k * STRIDE), per


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    """From the exponential, which numpy computes in vector registers."""
    return 1 - 2 / (np.exp(np.clip(2 * x, -30, 30)) + 1)


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place."""
    return np.stack([np.bincount(at, c, n) for c in rows.T], 1).astype(np.float32)


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        h = HIDDEN
        draw = lambda *s, scale=0.3: r.normal(0, scale, s).astype(np.float32)
        self.p = {"word": draw(WORDS, DIM, scale=0.05), "gram": draw(GRAMS, DIM, scale=0.05), "wa": draw(2 * h, h), "va": draw(h), "wo": draw(2 * h), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(2 * DIM, 3 * h), f"c{d}": np.zeros(3 * h, np.float32), f"u{d}": draw(h, 3 * h)}

    def vectors(self, word: np.ndarray, gram: np.ndarray, there: np.ndarray) -> np.ndarray:
        mean = (self.p["gram"][gram] * there[:, :, None]).sum(1) / there.sum(1)[:, None]
        return np.concatenate([self.p["word"][word], mean], 1)

    def inputs(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Gate inputs per distinct word and direction; row 0 is the padding."""
        return {d: np.concatenate([np.zeros((1, 3 * HIDDEN), np.float32), x @ self.p[f"w{d}"] + self.p[f"c{d}"]]) for d in "fb"}

    def run(self, a: dict, ids: np.ndarray, keep: bool = False):
        """Logits of windows of word numbers (0: padding)."""
        n, t = ids.shape
        k, h2, mask = HIDDEN, 2 * HIDDEN, (ids > 0).astype(np.float32)[:, :, None]
        states, kept, full = np.empty((t, n, h2), np.float32), {}, bool(mask.all())
        for d, at, steps in (("f", slice(0, k), range(t)), ("b", slice(k, h2), range(t - 1, -1, -1))):
            u, h, done = self.p[f"u{d}"], np.zeros((n, k), np.float32), []
            u_zr, u_n = np.ascontiguousarray(u[:, :h2]), np.ascontiguousarray(u[:, h2:])
            x_zr, x_n = np.ascontiguousarray(a[d][:, :h2]), np.ascontiguousarray(a[d][:, h2:])
            for i in steps:
                zr = _sigmoid(x_zr.take(ids[:, i], 0) + h @ u_zr)
                z, r, q = zr[:, :k], zr[:, k:], h @ u_n
                new = _tanh(x_n.take(ids[:, i], 0) + r * q)
                if keep:
                    done.append((i, h, z, r, q, new))
                change = (1 - z) * (new - h)
                h = h + (change if full else mask[:, i] * change)
                states[i, :, at] = h
            kept[d] = done
        e = _tanh(states @ self.p["wa"])
        s = np.where(mask[:, :, 0].T > 0, e @ self.p["va"], -30)
        s = np.exp(s - s.max(0))
        alpha = s / s.sum(0)
        pooled = (states * alpha[:, :, None]).sum(0)
        logit = pooled @ self.p["wo"] + self.p["bo"]
        return (logit, (mask, states, kept, e, alpha, pooled)) if keep else logit

    def gradients(self, word, gram, there, ids, y) -> tuple[float, dict]:
        x = self.vectors(word, gram, there)
        a = self.inputs(x)
        logit, (mask, states, kept, e, alpha, pooled) = self.run(a, ids, keep=True)
        prob = _sigmoid(logit)
        d_logit = ((prob - y) / len(y)).astype(np.float32)
        g = {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * self.p["wo"]
        d_states = alpha[:, :, None] * d_pool
        d_alpha = (states * d_pool).sum(2)
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(0)) * mask[:, :, 0].T
        g["va"] = np.tensordot(d_s, e, ([0, 1], [0, 1]))
        d_e = d_s[:, :, None] * self.p["va"] * (1 - e * e)
        g["wa"] = np.tensordot(states, d_e, ([0, 1], [0, 1]))
        d_states = d_states + d_e @ self.p["wa"].T
        h2, d_x = 2 * HIDDEN, np.zeros_like(x)
        for d, at in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, h2))):
            u, du, d_in = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"]), np.empty((ids.shape[1], len(ids), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(ids), HIDDEN), np.float32)
            for i, h, z, r, q, new in reversed(kept[d]):
                d_h = d_h + d_states[i, :, at]
                m = mask[:, i]
                d_new = d_h * m * (1 - z) * (1 - new * new)
                d_z = d_h * m * (h - new) * z * (1 - z)
                d_r = d_new * q * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_new * r], 1)
                d_in[i] = np.concatenate([d_z, d_r, d_new], 1)
                du += h.T @ d_hu
                d_h = d_h * (1 - m * (1 - z)) + d_hu @ u.T
            d_a = _scatter(ids.T.ravel(), d_in.reshape(-1, 3 * HIDDEN), len(a[d]))[1:]
            g |= {f"u{d}": du, f"c{d}": d_a.sum(0), f"w{d}": x.T @ d_a}
            d_x += d_a @ self.p[f"w{d}"].T
        rows, cols = np.nonzero(there)
        g["word"] = _scatter(word, d_x[:, :DIM], WORDS)
        g["gram"] = _scatter(gram[rows, cols], (d_x[:, DIM:] / there.sum(1)[:, None])[rows], GRAMS)
        return float(-np.log(np.where(y > 0, prob, 1 - prob) + 1e-9).mean()), g

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """The largest logit of all windows, per text of words."""
        numbers: dict[bytes, int] = {}
        flat = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for t in texts for w in t), np.int64)
        a = self.inputs(np.concatenate([self.vectors(*features([*numbers][i : i + 8192])) for i in range(0, max(1, len(numbers)), 8192)]))
        lengths = np.array([len(t) for t in texts], np.int64)
        start, size, per = windows(lengths)
        best, flat = np.empty(len(start), np.float32), np.append(flat, 0)
        for i in range(0, len(start), 1024):
            at = start[i : i + 1024, None] + np.arange(WINDOW)
            ids = np.where(np.arange(WINDOW) < size[i : i + 1024, None], flat[np.minimum(at, len(flat) - 1)], 0)
            best[i : i + 1024] = self.run(a, ids)
        return np.maximum.reduceat(best, np.cumsum(per) - per) if len(texts) else np.zeros(0, np.float32)


def train(texts: list[bytes], labels: np.ndarray, *, rounds: int = ROUNDS, seed: int = 1, prior: bool = True) -> Network:
    """Document labels in, window network out."""
    net, rng, docs = Network(seed), np.random.default_rng(seed), [words_of(t) for t in texts]
    numbers: dict[bytes, int] = {}
    flat = np.append(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for t in docs for w in t), np.int64), 0)
    word, gram, there = features([*numbers])
    word, gram = word.astype(np.int32), gram.astype(np.int16)
    lengths = np.array([len(t) for t in docs], np.int64)
    start, size, per = windows(lengths)
    first = np.cumsum(per) - per
    own = np.repeat(np.arange(len(docs)), per)
    ids = np.concatenate([np.where(np.arange(WINDOW) < size[i : i + 4096, None], flat[np.minimum(start[i : i + 4096, None] + np.arange(WINDOW), len(flat) - 1)], 0).astype(np.int32) for i in range(0, len(start), 4096)])
    ids, own = np.append(ids, np.zeros((1, WINDOW), ids.dtype), 0), np.append(own, len(docs))  # the padding window, clean
    # start from how much more often a bucket stands in toxic than in clean documents
    y = np.append(labels, 0).astype(np.float32)

    hot, cold = (np.zeros(WORDS), np.zeros(GRAMS)), (np.zeros(WORDS), np.zeros(GRAMS))
    ends = np.cumsum(lengths)
    for i in range(len(docs)):  # in how many documents of either class each bucket stands
        own_words = np.unique(flat[ends[i] - lengths[i] : ends[i]]) - 1
        for k, met in enumerate((word[own_words], gram[own_words][there[own_words]])):
            (hot if y[i] else cold)[k][np.unique(met)] += 1

    def odds(k: int) -> np.ndarray:
        ratio = np.log((hot[k] + 0.5) / (labels.sum() + 1)) - np.log((cold[k] + 0.5) / ((1 - labels).sum() + 1))
        return np.clip(ratio, -1, 3) * (hot[k] + cold[k] > 5)

    w_odds, g_odds = odds(0), odds(1)
    if prior:
        net.p["word"][:, 0], net.p["gram"][:, 0] = w_odds, g_odds
    by_word = np.append(w_odds[word] + np.where(there, g_odds[gram], 0).max(1), 0)[np.r_[len(word), : len(word)]]
    value = np.concatenate([by_word[ids[i : i + 4096]].max(1) for i in range(0, len(ids), 4096)])
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for round_ in range(rounds):
        if round_ >= 2 or not prior:
            a = net.inputs(np.concatenate([net.vectors(word[i : i + 8192], gram[i : i + 8192], there[i : i + 8192]) for i in range(0, len(word), 8192)]))
            value = np.concatenate([net.run(a, ids[i : i + 1024]) for i in range(0, len(ids), 1024)])
        order = np.lexsort((-value, own))
        top = order[first]
        second = order[first + (per > 1)]  # a further hard window of clean documents
        other = first + (rng.random(len(docs)) * per).astype(np.int64)
        clean = np.nonzero(labels == 0)[0]
        pick = np.concatenate([top, second[clean], other[clean], np.full(1 + len(docs) // 100, len(ids) - 1)])
        rng.shuffle(pick)
        for i in range(0, len(pick), 128):
            some = pick[i : i + 128]
            used, local = np.unique(ids[some], return_inverse=True)
            local = local.reshape(ids[some].shape) + (used[0] != 0)
            real = used[used > 0] - 1
            _, g = net.gradients(word[real], gram[real], there[real], local, y[own[some]])
            step += 1
            for k, x in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                x -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    a = net.inputs(np.concatenate([net.vectors(word[i : i + 8192], gram[i : i + 8192], there[i : i + 8192]) for i in range(0, len(word), 8192)]))
    best = np.maximum.reduceat(np.concatenate([net.run(a, ids[i : i + 1024]) for i in range(0, len(ids), 1024)])[:-1], first)
    toxic, clean = np.sort(best[labels > 0]), np.sort(best[labels == 0])
    # fewest errors, a clean document's counting double; of the widest gap without one, the place a third below its toxic end
    marks = np.unique(best)
    low, high = marks[:-1], marks[1:]
    wrong = 2 * (len(clean) - np.searchsorted(clean, high)) + np.searchsorted(toxic, high)
    if wrong.size:
        at = max(np.nonzero(wrong == wrong.min())[0], key=lambda i: high[i] - low[i])
        net.p["bo"] -= np.float32(high[at] - (high[at] - low[at]) / 3)
    return net


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN, most_bytes: int = FIT_BYTES, prior: bool = True) -> Network | float:
    """labels: the rows to learn from. The share of toxic labels instead of a network if a class is missing."""
    marked = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    key = F.xxhash64("id")
    chosen = marked.filter("y = 1").orderBy(key, "id").limit(toxic).unionByName(marked.filter("y = 0").orderBy(key, "id").limit(clean))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text").between(1, most_bytes))
    got = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas()  # at most toxic + clean rows of most_bytes
    got = got.sort_values("id")
    y = got["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    return train([t.encode("utf-8", "replace") for t in got["text"]], y, prior=prior)


def _scored(docs: DataFrame, model: Network | float, text_col: str, kept: list[str], threshold: float) -> DataFrame:
    """row (a struct of the kept columns), score, predicted. Only the texts go to the Python workers, and only scores come back."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        for t in texts:
            found = [np.full(b.num_rows, net) if isinstance(net, float) else _sigmoid(net.logits([words_of(x) for x in utf8_of(b.column(0))]).astype(np.float64)) for b in slices([pa.RecordBatch.from_arrays([t], ["text"])], "text", SLICE)]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    rows = docs.select(packed(docs, kept).alias("row"), scores(F.col(f"`{text_col}`").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, model: Network | float, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (1 if score >= threshold); with carry, these columns of docs instead of the id."""
    kept = [id_col] if carry is None else carry
    out = _scored(docs, model, text_col, kept, threshold)
    return out.select("row.*", F.col("score").alias(free_name("score", kept)), F.col("predicted").alias(free_name("predicted", kept)))


def drop_toxic(docs: DataFrame, model: Network | float, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    return _scored(docs, model, text_col, docs.columns, threshold).filter("predicted = 0").select("row.*")


def held_out(key):
    """A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
