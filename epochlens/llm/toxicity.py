"""Toxicity by a weighted finite-state pattern grammar.

Small transducers over word classes are composed into one machine, in the max-plus semiring:

* the **lexicon** maps words to classes: insult and threat (with weights), target, negation, reported speech, other;
* **negation** marks insults and threats within three words after a negation word;
* **reported speech** marks what follows a verb of saying in the same clause;
* **scoring** pays for insults and threats, more with a target near by (before or after), less or nothing if marked.

The best path of the composed machine scores a clause, so the same word counts differently by its company. A
document's score is a logistic function of its clause scores. Insult entries beyond the seed words (whole words and
word beginnings) are induced from labelled rows, and the logistic weights are fitted on them.

Defined results: null and empty texts match nothing and get the base score; repeated rows get equal scores; labels
without a document are unused, several labels of one document count as toxic if any is; without both kinds of labels
the seed lexicon is used with fixed weights. Other columns are not inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import cut_lineage, whole

# Seed words by class: insult, threat, target, negation, reported speech.
SEEDS = {
    "i": "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb fool jerk "
         "dummkopf trottel abschaum idioto imbécil estúpido basura crétin ordure minable abruti".split(),
    "t": "kill murder stab shoot strangle töten umbringen erschießen tuer égorger matar degollar".split(),
    "g": "you your yours he him she her they them u du dich dir euch ihr tu toi vous ton vos tú usted ustedes te".split(),
    "n": "not never no nobody isn't aren't don't nicht kein keine niemals pas jamais nunca ningún ninguna".split(),
    "r": "said says claimed quoted wrote called reported sagte schrieb behauptete dit écrit affirme dijo escribió".split(),
}
SHORTEST, LONGEST = 3, 8
SEED_WEIGHT = {"i": 1.0, "t": 0.3}
BASE = np.array([-4.0, 1.5, 1.0, 0.5, 0.5])


@dataclass
class Transducer:
    """(state, symbol) -> [(output, weight, next state)]; ``final`` holds the accepting states."""
    start: object
    arcs: dict = field(default_factory=lambda: defaultdict(list))
    final: set = field(default_factory=set)

    def add(self, state, symbol, output, weight, target) -> None:
        self.arcs[state, symbol].append((output, weight, target))

    def compose(self, other: Transducer) -> Transducer:
        """This machine's output read by the other one; weights add up along a path."""
        out = Transducer((self.start, other.start))
        by_state = defaultdict(list)
        for (state, symbol), arcs in self.arcs.items():
            by_state[state] += [(symbol, *arc) for arc in arcs]
        seen, open_ = {out.start}, [out.start]
        while open_:
            a, b = state = open_.pop()
            if a in self.final and b in other.final:
                out.final.add(state)
            for symbol, middle, weight, a2 in by_state[a]:
                for output, more, b2 in other.arcs.get((b, middle), ()):
                    out.add(state, symbol, output, weight + more, (a2, b2))
                    if (a2, b2) not in seen:
                        seen.add((a2, b2))
                        open_.append((a2, b2))
        return out

    def best(self, symbols: list[tuple[str, float]]) -> float:
        """Weight of the best accepted path over weighted symbols."""
        scores = {self.start: 0.0}
        for symbol, own in symbols:
            after: dict = {}
            for state, score in scores.items():
                for _, weight, target in self.arcs.get((state, symbol), ()):
                    value = score + own + weight
                    if value > after.get(target, -math.inf):
                        after[target] = value
            scores = after
        return max((v for s, v in scores.items() if s in self.final), default=0.0)


def grammar() -> Transducer:
    negation = Transducer(0, final={0, 1, 2, 3})
    for state in range(4):
        negation.add(state, "n", "w", 0.0, 3)
        for symbol in "wrgit":
            negation.add(state, symbol, symbol.upper() if state and symbol in "it" else symbol, 0.0, max(state - 1, 0))
    reported = Transducer(0, final={0, 1})
    for state in range(2):
        reported.add(state, "r", "w", 0.0, 1)
        for symbol in "wgitIT":
            reported.add(state, symbol, "q" if state and symbol in "it" else symbol, 0.0, state)
    # States 0..3: words since a target; "e2", "e1": a target must follow within so many words.
    scoring = Transducer(0, final={0, 1, 2, 3})
    for near in range(4):
        fade = max(near - 1, 0)
        scoring.add(near, "w", "w", 0.0, fade)
        scoring.add(near, "g", "g", 0.0, 3)
        scoring.add(near, "I", "negated", -1.0, fade)
        scoring.add(near, "T", "negated", -0.3, fade)
        scoring.add(near, "q", "reported", -0.6, fade)
        scoring.add(near, "i", "insult", 0.5 if near else 0.0, fade)
        scoring.add(near, "t", "threat", 1.7 if near else 0.0, fade)
        scoring.add(near, "i", "insult", 0.5, "e2")
        scoring.add(near, "t", "threat", 1.7, "e2")
    scoring.add("e2", "w", "w", 0.0, "e1")
    for state in ("e2", "e1"):
        scoring.add(state, "g", "g", 0.0, 3)
    return negation.compose(reported).compose(scoring)


class Matcher(dict):
    """word -> index into ``classes``; filled on first sight, emptied when it grows large."""
    LIMIT = 150_000
    TRIM = re.compile(r"\W+|_+")

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.exact = {w: (c, SEED_WEIGHT.get(c, 0.0)) for c, words in SEEDS.items() for w in words}
        self.begins = {e[:-1]: v for e, v in learned.items() if e.endswith("*")}
        self.exact |= {e: ("i", v) for e, v in learned.items() if not e.endswith("*")}
        # Plain words first, insults and threats last: a maximum tells whether a text has any.
        self.classes = [("w", 0.0, False), ("w", 0.0, True)]
        self.numbers = {entry: i for i, entry in enumerate(self.classes)}
        self.trigger = 1 << 20
        self.machine = grammar()

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        core = self.TRIM.sub("", word) if not word.isalnum() else word
        kind = self.exact.get(core)
        if kind is None:
            kind = next((("i", self.begins[core[:k]]) for k in range(min(LONGEST, len(core)), SHORTEST - 1, -1)
                         if core[:k] in self.begins), ("w", 0.0))
        ends = not word[-1].isalnum() and word.rstrip("\"')]")[-1:] in set(".,;:!?")
        entry = (*kind, ends)
        number = self.numbers.get(entry)
        if number is None:
            number = self.numbers[entry] = len(self.classes) + (self.trigger if kind[0] in "it" else 0)
            self.classes.append(entry)
        self[word] = number
        return number

    def clauses(self, text: str) -> tuple[int, list[tuple[float, str]]]:
        """(words, [(score, clause)]) of the clauses that match."""
        count, found = 0, []
        for line in text.lower().split("\n"):
            words = line.split()
            count += len(words)
            numbers = list(map(self.__getitem__, words))
            if not numbers or max(numbers) < self.trigger:
                continue
            start = 0
            symbols: list[tuple[str, float]] = []
            hit = False
            for i, number in enumerate(numbers):
                kind, weight, ends = self.classes[number & (self.trigger - 1)]
                symbols.append((kind, weight))
                hit |= number >= self.trigger
                if ends or i + 1 == len(numbers):
                    if hit:
                        score = self.machine.best(symbols)
                        if score > 0:
                            found.append((score, " ".join(words[start:i + 1])))
                    start, symbols, hit = i + 1, [], False
        return count, found


def features(words: int, scores: list[float]) -> list[float]:
    total = sum(scores)
    return [1.0, math.log1p(total), max(scores, default=0.0), math.log1p(100 * total / max(words, 20)), float(min(len(scores), 3))]


def _votes(frames):
    """Document counts of words and word beginnings by label."""
    for frame in frames:
        votes: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for label, text in zip(frame.toxic, frame.text):
            words = set(re.findall(r"[^\W\d_]{3,40}", text.lower()))
            seen = {w for w in words if len(w) <= 24}
            seen |= {w[:k] + "*" for w in words for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)}
            votes[int(label)].update(seen)
        entries = list(votes[0] | votes[1])
        if not entries:
            continue
        yield pd.DataFrame({"entry": entries, "clean": [votes[0][e] for e in entries], "toxic": [votes[1][e] for e in entries]})


def induce(sample: DataFrame, toxic: int, clean: int, most: int = 400) -> dict[str, float]:
    """Insult entries whose use differs clearly between the labels, as weights. An entry within a chosen one is left
    out, and one around chosen ones stays only if a third more toxic documents use it. At most ``most`` times eight
    candidates reach the driver."""
    votes = sample.mapInPandas(_votes, "entry string, clean long, toxic long").groupBy("entry").agg(
        F.sum("clean").alias("n"), F.sum("toxic").alias("p")).where(F.col("p") >= max(3, 0.015 * toxic))
    odds = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
    # The likelihood ratio of the two-by-two table of label and use.
    share = (F.col("p") + F.col("n")) / (toxic + clean)

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = 2 * (cell(F.col("p"), share * toxic) + cell(F.col("n"), share * clean)
                + cell(toxic - F.col("p"), (1 - share) * toxic) + cell(clean - F.col("n"), (1 - share) * clean))
    rated = votes.withColumn("odds", odds).withColumn("gain", gain)
    top = rated.where("gain >= 20 and odds >= 1.2").orderBy(F.desc("gain"), F.desc(F.length("entry")), "entry").limit(8 * most).collect()
    chosen: dict[str, float] = {}
    used: dict[str, int] = {}
    for row in top:
        core = row["entry"].rstrip("*")
        within = any(core.startswith(c) for c in used)
        around = max((p for c, p in used.items() if c.startswith(core)), default=0)
        if len(chosen) < most and not within and row["p"] * 3 >= around * 4:
            chosen[row["entry"]] = min(2.0, max(0.5, row["odds"] / 3))
            used[core] = row["p"]
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge-penalised logistic weights by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    learned: dict[str, float]
    weights: np.ndarray


def _measured(learned: dict[str, float]):
    def measured(frames):
        matcher = Matcher(learned)
        for frame in frames:
            rows = []
            for text in frame.text:
                words, found = matcher.clauses(text)
                rows.append(features(words, [s for s, _ in found]))
            out = pd.DataFrame(rows, columns=["x0", "x1", "x2", "x3", "x4"], dtype=float)
            yield out.assign(toxic=frame.toxic.to_numpy())
    return measured


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = 20000) -> Model:
    """Learn from at most ``sample`` labelled documents, taken in the order of a hash of their ids. ``usable`` is a
    condition on doc_id that keeps held-out rows out. Documents with equal texts count once, as toxic if any is."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known if usable is None else known.where(usable)
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers are broadcast; no text moves to find out whether it was drawn.
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(cut_lineage(drawn)), "doc_id").groupBy("text").agg(
        F.max("toxic").alias("toxic"))
    rows = cut_lineage(rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return Model({}, BASE)
    learned = induce(rows, sizes[1], sizes[0])
    held = rows.mapInPandas(_measured(learned), ", ".join(f"x{i} double" for i in range(5)) + ", toxic int").toPandas()
    return Model(learned, logistic(held[[f"x{i}" for i in range(5)]].to_numpy(), held.toxic.to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, score, clauses (how many matched), worst (the clause that matched best)."""
    learned, weights = model.learned, model.weights

    def scored(frames):
        matcher = Matcher(learned)
        for frame in frames:
            rows, worst, counts = [], [], []
            for body in frame.text:
                words, found = matcher.clauses(body)
                rows.append(features(words, [s for s, _ in found]))
                counts.append(len(found))
                worst.append(max(found)[1] if found else None)
            z = np.array(rows, float).reshape(len(rows), len(weights)) @ weights
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))),
                                "clauses": np.array(counts, np.int32), "worst": pd.Series(worst, dtype=object, index=frame.index)})

    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    return body.mapInPandas(scored, "doc_id long, score double, clauses int, worst string")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns; nothing is shuffled."""
    learned, weights = model.learned, model.weights

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(learned)
        for texts in batches:
            rows = [features(n, [s for s, _ in found]) for n, found in map(matcher.clauses, texts)]
            z = np.array(rows, float).reshape(len(rows), len(weights)) @ weights
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.where(F.pandas_udf(scores, "double")(whole(docs["text"])) < threshold)
