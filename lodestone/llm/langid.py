"""Operator 1: language identification with interpolated Kneser-Ney character models.

Character n-grams of all training rows are counted by a distributed aggregation. For each order the n-grams of all
languages stand in one sorted array of 64-bit hashes, beside a matrix of interpolated log probabilities, one column per
language; context weights likewise. A text gets, per language, its cross-entropy per character over all its characters;
the lowest wins (ties: the smaller name). The score is the softmax of the negative entropies at a temperature; a row is
marked rejected beyond a cross-entropy limit of its language. Both are calibrated on a bounded sample of the training
rows (a tenth at most) with a model that is fitted without them; the final model has all training rows.

Letters are lower-cased, everything else is a word break; letters beyond U+FFFF share 2,048 codes that no other letter has.
Null, empty or letterless text: `und`, score 0, rejected. Texts of any length are read whole, repeated rows are
predicted each, rows without id train. Without training rows every text is `und`; an empty table gives no rows. Other
columns are not read, whatever their names. Only the training rows' texts and languages are read for fitting.
All n-grams are kept: the driver and each executor hold the model, which grows with the distinct n-grams of all languages.
Bound, a parameter: CALIBRATION rows fit temperature and limits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Workspace, slices, table

ORDER, CALIBRATION = 4, 1500
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit character codes of all texts and the bounds of each: lower case, runs of other characters one space, a space at both ends."""
    lower = [t.lower() if t else "" for t in texts]
    a = np.frombuffer((" " + "  ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in lower])
    met = np.unique(a)
    word = np.array([chr(c).isalpha() for c in met])
    letter = word[np.searchsorted(met, a)]
    first = np.zeros(len(a), bool)
    first[ends - [len(t) + 2 for t in lower]] = True
    keep = letter | first | np.concatenate([[True], letter[:-1]])
    code = np.where(a > 0xFFFF, 0xD800 | (a ^ a >> 11) & 0x7FF, a)
    out = np.where(letter, code, _SPACE)[keep].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(keep)[ends - 1]])
    return out, at


def _grams(codes: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams inside each text and their bounds."""
    if len(codes) < order:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    g = codes[: len(codes) - order + 1].copy()
    for k in range(1, order):
        g = g << np.uint64(16) | codes[k : len(codes) - order + 1 + k]
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = own[: len(g)] == own[order - 1 :]
    return g[inside], np.concatenate([[0], np.cumsum(np.bincount(own[: len(g)][inside], minlength=len(bounds) - 1))])


def count_ngrams(train: DataFrame) -> DataFrame:
    """lang, code, n over all rows of (lang, text, apart), and m over those set apart; each task sums its own rows first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(place, np.concatenate([n for _, n in parts]))

        for b in slices(batches, "text"):
            kinds, texts = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)), b.column(1).to_pylist()
            for kind in sorted(set(kinds)):
                g, _ = _grams(*_codes([t for t, k in zip(texts, kinds, strict=True) if k == kind]), ORDER)
                s = np.sort(g)
                cut = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0] if s.size else np.zeros(0, int)
                parts = held.setdefault(kind, [])
                parts.append((s[cut], np.diff(np.append(cut, s.size)).astype(float)))
                if len(parts) > 8:
                    held[kind] = [merged(parts)]
        for (lang, apart), parts in held.items():
            codes, n = merged(parts)
            for i in range(0, len(codes), 100_000):
                part, k = codes[i : i + 100_000], n[i : i + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(k), pa.array(k * apart)], ["lang", "code", "n", "m"])

    return train.select("lang", "text", "apart").mapInArrow(run, "lang string, code long, n long, m long").groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


@dataclass
class Level:
    """Sorted hashes of n-grams with log probabilities, and of contexts with log weights; a column per language."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def _find(sorted_hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places in the sorted array, -1 where absent."""
    if not sorted_hashes.size:
        return np.full(len(codes), -1)
    h = codes * _MIX
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, at, -1)


@dataclass
class Model:
    langs: list[str]
    levels: list[Level]
    base: float
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def logp(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Interpolated log probabilities of n-grams of this order, one column per language."""
        if not order:
            return np.full((len(codes), len(self.langs)), self.base)
        level, mask = self.levels[order - 1], np.uint64((1 << 16 * order) - 1)
        codes = codes & mask
        at = _find(level.grams, codes)
        out = level.logp[np.maximum(at, 0)]
        gone = np.nonzero(at < 0)[0]
        if gone.size:
            low = self.logp(codes[gone], order - 1)
            ctx = _find(level.contexts, codes[gone] >> np.uint64(16))
            out[gone] = low + np.where((ctx >= 0)[:, None], level.weight[np.maximum(ctx, 0)], 0.0)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per n-gram and language, and the number of n-grams."""
        codes, bounds = _codes(texts)
        short = np.diff(bounds) < ORDER
        g, at = _grams(codes, bounds, ORDER)
        n = np.diff(at)
        total = np.zeros((len(texts), len(self.langs)))
        if g.size:
            sums = np.add.reduceat(self.logp(g, ORDER), np.minimum(at[:-1], len(g) - 1), axis=0)
            total[n > 0] = sums[n > 0]
        for i in np.nonzero(short & (np.diff(bounds) > 2))[0]:
            few = codes[bounds[i] : bounds[i + 1]]
            whole = few[0]
            for c in few[1:]:
                whole = whole << np.uint64(16) | c
            total[i], n[i] = self.logp(np.array([whole]), len(few))[0], 1
        return -total / np.maximum(n, 1)[:, None], n


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: language, sorted codes of the highest order, counts."""
    langs = [lang for lang, _, _ in rows]
    symbols = {int(c) & 0xFFFF for _, codes, _ in rows for c in np.unique(codes & np.uint64(0xFFFF))}
    model = Model(langs, [], -float(np.log(len(symbols) + 1)))
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for _, codes, n in rows:
        for order in range(ORDER, 0, -1):
            by_order[order - 1].append((codes, n))
            # continuation counts: in how many distinct n-grams each suffix stands
            codes, n = np.unique(codes & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True) if order > 1 else (codes, n)
            n = n.astype(float)
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([c for c, _ in by_order[order - 1]]))
        contexts = np.unique(union >> np.uint64(16))
        found = np.searchsorted(contexts, union >> np.uint64(16))
        low = np.exp(model.logp(union, order - 1))
        logp, weight = np.zeros((len(union), len(langs))), np.zeros((len(contexts), len(langs)))
        for k, (codes, n) in enumerate(by_order[order - 1]):
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx = np.searchsorted(contexts, codes >> np.uint64(16))
            total, kinds = np.bincount(ctx, n, len(contexts)), np.bincount(ctx, minlength=len(contexts))
            lam = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
            own = np.zeros(len(union))
            own[np.searchsorted(union, codes)] = n - discount
            logp[:, k] = np.log(own / np.maximum(total[found], 1e-300) * (total[found] > 0) + lam[found] * low[:, k])
            weight[:, k] = np.log(lam)
        hashes, ctx_hashes = union * _MIX, contexts * _MIX
        a, b = np.argsort(hashes), np.argsort(ctx_hashes)
        model.levels.append(Level(hashes[a], logp[a], ctx_hashes[b], weight[b]))
    return model


def _softmax(entropies: np.ndarray, temperature: float) -> np.ndarray:
    z = -entropies * temperature
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrate(model: Model, entropies: np.ndarray, truth: np.ndarray, keep: float = 0.995) -> None:
    """The temperature of least log loss, and per language the entropy that `keep` of its own rows stay below."""
    if len(truth):
        loss = {t: -np.log(np.maximum(_softmax(entropies, t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in (0.5, 1, 2, 4, 8, 16, 32)}
        model.temperature = float(min(loss, key=loss.get))
    own = [entropies[truth == k, k] for k in range(len(model.langs))]
    model.limits = np.array([np.quantile(x, keep) * 1.1 if len(x) else np.inf for x in own])


def train_model(train: DataFrame, *, calibration: int = CALIBRATION) -> Model:
    """train: columns lang, text, key (any column to sample by)."""
    train = train.filter("lang is not null and text is not null").select("lang", "text", "key")
    every = max(10, train.count() // calibration)
    train = train.withColumn("apart", F.pmod(F.xxhash64("key"), F.lit(every)) == 0)
    counts = Workspace(train.sparkSession, "langid").keep("counts", count_ngrams(train))
    whole, part = [], []
    for lang in sorted(r.lang for r in counts.select("lang").distinct().collect()):
        g = counts.filter(F.col("lang") == lang).select("code", "n", "m").toPandas()
        codes, n, m = g["code"].to_numpy().view(np.uint64), g["n"].to_numpy(float), g["m"].to_numpy(float)
        order = np.argsort(codes)
        codes, n, m = codes[order], n[order], m[order]
        whole.append((lang, codes, n))
        if (n > m).any():
            part.append((lang, codes[n > m], (n - m)[n > m]))
    if not whole:
        return Model([], [], 0.0, 1.0, np.zeros(0))
    model = fit(whole)
    if not part:
        calibrate(model, np.zeros((0, len(model.langs))), np.zeros(0, int))
        return model
    without = fit(part)
    shared = train.sparkSession.sparkContext.broadcast(without)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text"):
            h, n = m.entropies(b.column(1).to_pylist())
            ok = n > 0
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(b.column(0).to_pylist(), ok, strict=True) if k], pa.string()), pa.array(list(h[ok]), pa.list_(pa.float64()))], ["lang", "h"])

    held = train.filter("apart").select("lang", "text").mapInArrow(run, "lang string, h array<double>").limit(4 * calibration).toPandas()
    held = held[held["lang"].isin(without.langs)]
    calibrate(without, np.array(held["h"].tolist()).reshape(-1, len(without.langs)), np.array([without.langs.index(x) for x in held["lang"]], int))
    limit = dict(zip(without.langs, without.limits, strict=True))
    model.temperature, model.limits = without.temperature, np.array([limit.get(x, np.inf) for x in model.langs])
    return model


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", reject: bool = False) -> DataFrame:
    """One row per document: id, lang_pred, score, cross_entropy, rejected. With reject, a rejected row's lang_pred is `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text", 4 << 20):
            k = b.num_rows
            if m.langs:
                h, n = m.entropies(b.column(1).to_pylist())
                best = h.argmin(1)
                low = h[np.arange(k), best]
                score = np.where(n > 0, _softmax(h, m.temperature)[np.arange(k), best], 0.0)
                out = (n == 0) | (low > m.limits[best])
                name = [m.langs[i] if x and not (reject and o) else "und" for i, x, o in zip(best, n > 0, out, strict=True)]
            else:
                low, score, out, name = np.zeros(k), np.zeros(k), np.ones(k, bool), ["und"] * k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name), pa.array(score), pa.array(low), pa.array(out)], ["id", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("id", id_col)


def fold(key: Column, parts: int) -> Column:
    """The remainder of a key; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_model(docs.filter(fold(F.col("doc_id"), 3) != 1).select("lang", "text", F.col("doc_id").alias("key")))
    return identify(docs, model).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
