"""Quality classifier by co-training of two views.

The text view sees measures of the content, the metadata view sees language, source and lengths. Both are ridge
logistic models fitted by Newton steps whose sums are taken over all rows in Spark; only the sums, of a size set by the
number of features, reach the driver. In every round each view labels the unlabelled documents it is confident about
for the other one. Finally both are calibrated together on the labelled rows, and every document is scored.

Labelled rows are taken up to ``most`` in the order of a hash of their ids; unlabelled documents all take part.
Defined results: null and empty texts have all-zero content measures and are scored; null metadata is a value of its
own; repeated rows get equal scores; several labels of one document count as good only if all are; without labels of
both kinds every score is 0.5.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import cut_lineage, whole

BUCKETS = 16
TEXT_FEATURES = 12


def text_measures(text: str) -> list[float]:
    """Shares and logarithms that describe the content."""
    n = len(text)
    if not n:
        return [0.0] * TEXT_FEATURES
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    letters = sum(map(str.isalpha, words)) / max(len(words), 1)
    distinct = len(set(words)) / max(len(words), 1)
    pairs = list(zip(words, words[1:]))
    plain = text.encode("ascii", "ignore").translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ \n.,")
    lower = text.lower()
    return [
        letters, distinct, len(set(pairs)) / max(len(pairs), 1), len(set(lines)) / max(len(lines), 1),
        len(plain) / n, sum(a == b for a, b in pairs) / max(len(pairs), 1),
        sum(map(str.isupper, words)) / max(len(words), 1), sum(a != b for a, b in zip(text[:1], lower[:1])) * 1.0,
        min(n / max(len(words), 1), 40) / 10, np.log1p(len(lines)) / 5, np.log1p(len(words)) / 8,
        text.count("|") / n * 10,
    ]


def meta_measures(lang: str | None, source: str | None, chars: float | None) -> list[float]:
    hashed = [0.0] * (2 * BUCKETS)
    hashed[zlib.crc32(str(lang).encode()) % BUCKETS] = 1.0
    hashed[BUCKETS + zlib.crc32(str(source).encode()) % BUCKETS] = 1.0
    size = np.log1p(max(0.0, chars)) / 8 if chars is not None and chars == chars else 0.0
    return [*hashed, size, size * size, float(chars is None or chars != chars)]


def _measured(frames):
    for frame in frames:
        content = np.array([text_measures(t) for t in frame.text], np.float64).reshape(len(frame), -1)
        meta = np.array([meta_measures(*row) for row in zip(frame.lang, frame.source, frame.n_chars)], np.float64).reshape(len(frame), -1)
        yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "label": frame.label.astype("Int32"),
                            "content": list(content), "meta": list(meta)})


def _design(columns: pd.Series) -> np.ndarray:
    values = np.array(columns.tolist(), np.float64)
    return np.c_[np.ones(len(values)), values.reshape(len(columns), -1)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _newton(rows: DataFrame, weights: list[np.ndarray], targets, ridge: float) -> list[np.ndarray]:
    """One Newton step of several models at once. ``targets(frame)`` gives (design, target, row weight) of each."""
    def sums(frames):
        held = [np.zeros((len(w), len(w) + 1)) for w in weights]
        for frame in frames:
            if len(frame):
                for h, w, (x, y, c) in zip(held, weights, targets(frame)):
                    p = sigmoid(x @ w)
                    h[:, :-1] += x.T @ (x * (c * (p * (1 - p) + 1e-9))[:, None])
                    h[:, -1] += x.T @ (c * (y - p))
        flat = np.concatenate([h.ravel() for h in held])
        yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    total = rows.mapInPandas(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(sum(len(w) * (len(w) + 1) for w in weights))
    flat[total.i.to_numpy()] = total.v.to_numpy()
    after, at = [], 0
    for w in weights:
        h = flat[at:at + len(w) * (len(w) + 1)].reshape(len(w), -1)
        at += h.size
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        after.append(w + np.linalg.solve(h[:, :-1] + penalty, h[:, -1] - penalty @ w))
    return after


def co_train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = 20000, rounds: int = 3,
             steps: int = 4, confident: float = 0.95, pseudo_weight: float = 0.25, ridge: float = 1.0) -> DataFrame:
    """One row per document: doc_id, score (how likely it is good), text_score, meta_score. ``usable`` is a condition
    on doc_id that keeps held-out labels out. ``pseudo_weight`` is what a pseudo-label counts against a label."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    known = known if usable is None else known.where(usable)
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sizes = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), "lang", "source", F.col("n_chars").cast("double"))
    # The labels are at most ``most`` rows, so this side may be broadcast.
    marked = body.join(F.broadcast(drawn), "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "label")
    rows = cut_lineage(marked.mapInPandas(_measured, "doc_id long, label int, content array<double>, meta array<double>"))
    if not (sizes.get(0) and sizes.get(1)):
        half = F.lit(0.5)
        return rows.select("doc_id", half.alias("score"), half.alias("text_score"), half.alias("meta_score"))

    views = [np.zeros(1 + TEXT_FEATURES), np.zeros(4 + 2 * BUCKETS)]

    def labelled(frame):
        frame = frame[frame.label.notna()]
        y = frame.label.to_numpy(np.float64)
        return [(_design(frame[c]), y, np.ones(len(y))) for c in ("content", "meta")]

    # Labelled rows are few: they are written apart, so that the first fit does not read the whole table.
    taught = cut_lineage(rows.where("label is not null"))
    for _ in range(2 * steps):
        views = _newton(taught, views, labelled, ridge)
    for _ in range(rounds):
        teachers = [v.copy() for v in views]

        def exchanged(frame):
            x = [_design(frame[c]) for c in ("content", "meta")]
            p = [sigmoid(m @ t) for m, t in zip(x, teachers)]
            y, has = frame.label.fillna(0).to_numpy(np.float64), frame.label.notna().to_numpy()
            out = []
            for view in (0, 1):
                other = p[1 - view]
                sure = np.maximum(other, 1 - other) >= confident
                out.append((x[view], np.where(has, y, other >= 0.5), np.where(has, 1.0, np.where(sure, pseudo_weight, 0.0))))
            return out

        for _ in range(steps):
            views = _newton(rows, views, exchanged, ridge)

    final = [np.zeros(3)]

    def combined(frame):
        frame = frame[frame.label.notna()]
        logits = [_design(frame[c]) @ v for c, v in zip(("content", "meta"), views)]
        return [(np.c_[np.ones(len(frame)), logits[0], logits[1]], frame.label.to_numpy(np.float64), np.ones(len(frame)))]

    for _ in range(2 * steps):
        final = _newton(taught, final, combined, 1e-3)

    def scored(frames):
        for frame in frames:
            z = [_design(frame[c]) @ v if len(frame) else np.empty(0) for c, v in zip(("content", "meta"), views)]
            both = final[0][0] + final[0][1] * z[0] + final[0][2] * z[1]
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "score": sigmoid(both), "text_score": sigmoid(z[0]), "meta_score": sigmoid(z[1])})

    return rows.select("doc_id", "content", "meta").mapInPandas(scored, "doc_id long, score double, text_score double, meta_score double")
