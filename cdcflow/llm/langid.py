"""Language identification: first the family, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Features that byte n-grams of 1 to 3 are hashed to; training documents in all and of one language, about.
FEATURES, TRAIN_ROWS, LEAST_ROWS = 1 << 12, 3000, 60
#: Bytes that are scored in one numpy call.
CHUNK = 1 << 21
#: A-Z and non-letters of ASCII become spaces; other bytes stay.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

STEPS, REGULAR = 200, 1e-3


def letters(text: str | None) -> bytes:
    """The text in lower case with a space for every ASCII non-letter; empty if it has no letters at all."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b" "


def codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of the unigram, bigram and trigram that begin at each byte but the last two; FEATURES between words."""
    a, b, c = (data[i : len(data) - 2 + i].astype(np.uint32) for i in range(3))
    mixed = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int32)
    gap = (a == 32) & (b == 32)
    one = mixed(a + np.uint32(1))
    two = mixed(a * np.uint32(257) + b + np.uint32(1 << 16))
    three = mixed(a * np.uint32(65537) + b * np.uint32(257) + c + np.uint32(1 << 25))
    return tuple(np.where(gap, FEATURES, x) for x in (one, two, three))


def profile(text: bytes) -> np.ndarray:
    """Relative frequencies of the features in a whole text."""
    out = np.zeros(FEATURES + 1)
    data = np.frombuffer(text, dtype=np.uint8)
    for start in range(0, max(len(data) - 2, 0), CHUNK):
        for x in codes(data[start : start + CHUNK + 2]):
            out += np.bincount(x, minlength=FEATURES + 1)
    total = out[:FEATURES].sum()
    return (out[:FEATURES] / max(total, 1)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """``families``: languages of each; ``weights`` (features by classifier), ``bias``; classifier pairs by stage."""

    families: list[list[str]]
    weights: np.ndarray
    bias: np.ndarray
    between: list[tuple[int, int]]
    within: list[list[tuple[int, int]]]

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of margins: votes among families, then among the family's languages."""
        at = len(self.between)
        family, sure = _votes(margins[:, :at], self.between, len(self.families))
        names = np.empty(len(margins), dtype=object)
        for f, languages in enumerate(self.families):
            pairs = self.within[f]
            mine = family == f
            best, more = _votes(margins[:, at : at + len(pairs)], pairs, len(languages))
            at += len(pairs)
            names[mine] = np.array(languages, dtype=object)[best[mine]]
            sure = np.where(mine, sure * more, sure)
        return names.tolist(), sure


def _votes(margins: np.ndarray, pairs: list[tuple[int, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class with most votes, ties by its summed margins, and the product of its logistic margins."""
    wins, sums = np.zeros((len(margins), classes)), np.zeros((len(margins), classes))
    for k, (a, b) in enumerate(pairs):
        m = margins[:, k]
        wins[:, a] += m >= 0
        wins[:, b] += m < 0
        sums[:, a] += m
        sums[:, b] -= m
    best = (wins + 1e-3 * np.tanh(sums / max(classes, 1))).argmax(axis=1)
    sure = np.ones(len(margins))
    for k, (a, b) in enumerate(pairs):
        m = np.where(best == a, margins[:, k], np.where(best == b, -margins[:, k], 40.0))
        sure *= 1 / (1 + np.exp(-np.clip(2 * m, -40, 40)))
    return best, sure


def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge) by accelerated gradient steps; y is 1 or -1, classes weighed alike."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w = np.zeros(x1.shape[1], dtype=np.float32)
    probe = np.ones(x1.shape[1], dtype=np.float32)
    for _ in range(12):  # largest curvature, for the step length
        probe = x1.T @ (share * (x1 @ probe))
        size = float(np.linalg.norm(probe))
        probe /= max(size, 1e-12)
    rate = 1 / (2 * size * 1.05 + REGULAR)
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        short = np.maximum(0, 1 - y * (x1 @ ahead))
        new = ahead - rate * (REGULAR * ahead - 2 * x1.T @ (share * y * short))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def families_of(means: np.ndarray, names: list[str]) -> list[list[str]]:
    """About sqrt(n) families: the most similar languages (cosine of mean profiles, average linkage) are joined first."""
    centred = means - means.mean(axis=0)
    unit = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    alike = unit @ unit.T
    groups = [[i] for i in range(len(names))]
    while len(groups) > math.ceil(math.sqrt(len(names))):
        a, b = max(itertools.combinations(range(len(groups)), 2), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return [sorted(names[i] for i in g) for g in groups]


def fit(x: np.ndarray, languages: list[str]) -> Model:
    """Classifiers between families and, one against one, within them; features are scaled by their spread."""
    names = sorted(set(languages))
    label = np.array([names.index(n) for n in languages])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-5
    z = ((x - mean) / spread / math.sqrt(x.shape[1])).astype(np.float32)
    families = families_of(np.stack([x[label == i].mean(axis=0) for i in range(len(names))]), names)
    of = {n: f for f, group in enumerate(families) for n in group}
    family = np.array([of[n] for n in languages])
    columns: list[np.ndarray] = []
    bias: list[float] = []

    def pairs(classes: np.ndarray, values: list[int]) -> list[tuple[int, int]]:
        out = list(itertools.combinations(range(len(values)), 2))
        for a, b in out:
            some = (classes == values[a]) | (classes == values[b])
            w, c = machine(z[some], np.where(classes[some] == values[a], 1, -1).astype(np.float32))
            w = w / spread / math.sqrt(x.shape[1])
            columns.append(w)
            bias.append(c - float(w @ mean))
        return out

    between = pairs(family, list(range(len(families))))
    within = [pairs(label, [names.index(n) for n in group]) for group in families]
    weights = np.stack(columns, axis=1) if columns else np.zeros((x.shape[1], 0))
    return Model(families, weights.astype(np.float32), np.array(bias), between, within)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the languages that ``docs`` (doc_id, text, lang) names outside the held-out part.

    About ``rows`` documents in all, evenly over the languages, chosen by a hash of id and text, train it; their
    profiles of 4,096 numbers are what reaches the driver. None if no document has both a language and letters.
    """
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(LEAST_ROWS, rows // len(counts))
    parts = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) < F.element_at(parts, F.col("lang")) * (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                if data := letters(text.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([profile(data).tobytes()])], ["lang", "profile"])

    found = known.where(drawn).select("lang", "text").mapInArrow(run, "lang string, profile binary").collect()
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    if not found:
        return None
    return fit(np.stack([np.frombuffer(r[1], dtype=np.float32) for r in found]), [r[0] for r in found])


def margins(texts: list[bytes], model: Model) -> np.ndarray:
    """Every classifier's margin for each text: its weights' mean over the features of the whole text."""
    table = np.vstack([model.weights, np.zeros((1, model.weights.shape[1]), dtype=np.float32)])
    out = np.zeros((len(texts), table.shape[1]))
    count = np.zeros(len(texts))
    held, size, first = [], 0, 0

    def add(parts: list[tuple[int, bytes]]) -> None:
        data = np.frombuffer(b"".join(p for _, p in parts), dtype=np.uint8)
        starts = np.cumsum([0, *(len(p) for _, p in parts[:-1])])
        ends = np.append(starts[1:], len(data)) - 2
        own = np.ones(len(data) - 2, dtype=bool)
        for e in ends[:-1]:
            own[e : e + 2] = False  # n-grams that reach into the next text
        rows = [i for i, _ in parts]
        for x in codes(data):
            x = np.where(own, x, FEATURES)
            np.add.at(count, rows, np.add.reduceat((x < FEATURES).astype(np.int64), starts))
            for k in range(table.shape[1]):
                np.add.at(out[:, k], rows, np.add.reduceat(table[:, k][x].astype(np.float64), starts))

    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - 2, 0), CHUNK):
            part = text[start : start + CHUNK + 2]
            held.append((i, part))
            size += len(part)
            if size > CHUNK:
                add(held)
                held, size = [], 0
    if held:
        add(held)
    return out / np.maximum(count, 1)[:, None] + model.bias


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row of ``docs``, from its whole text alone.

    ``und`` with score 0 for null texts, texts without letters and, if nothing was learnt, all texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for start in range(0, batch.num_rows if own else 0, 256):
                texts = [letters(t.as_py()) for t in batch.column(1).slice(start, 256)]
                some = [i for i, t in enumerate(texts) if t]
                if some:
                    found, sure = own.decide(margins([texts[i] for i in some], own))
                    for i, name, score in zip(some, found, sure, strict=True):
                        names[start + i], scores[start + i] = name, score
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang)."""
    return predicted(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
