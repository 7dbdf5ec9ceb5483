"""Chat formatting: roles recovered by a hidden Markov model, then one canonical rendering per turn.

States are the roles system, user and assistant; an observation is a line of a turn. Emissions come from a speaker
marker at the line's start ("User:", "Q:", "[Bot]", "### Assistant"), the given role if it is one, a question mark and the
line's length; transitions from whether a turn or a marked line begins. Lengths and transitions are counted over all
turns. The best path is found by Viterbi. A conversation may be of any length: its turns are dealt out by ranges of
(conversation, turn), not by conversation, and cut into chunks of at most ``CHUNK`` turns by their place there; every
chunk becomes a max-plus transfer matrix, one pass over the matrices fixes the states at the chunks' borders and each
chunk is then traced back on its own.

Defined results: a null text is the empty text and keeps its turn; turns are ordered by number, then text, a null
number first; turns that repeat in all columns are one turn with ``copies``; a null conversation id is one
conversation; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import cut_lineage, whole

ROLES = ["system", "user", "assistant"]
# Fixed markers of speakers.
MARKERS = {
    "system": "system sys instruction instructions context".split(),
    "user": "user human q question client customer me prompt".split(),
    "assistant": "assistant ai bot a answer agent model gpt response".split(),
}
NAMES = {name: i for i, role in enumerate(ROLES) for name in MARKERS[role]}
# A marker has a colon, or stands in brackets, or alone in a line as a heading or in bold. A bare word is text.
NAMED = "|".join(sorted(NAMES, key=len, reverse=True))
LONG = "|".join(sorted((n for n in NAMES if len(n) > 2 or n == "ai"), key=len, reverse=True))
MARKER = re.compile(
    rf"\s*(?:(?:[#>-]+\s*)?(?:\*\*|__)?({NAMED})(?:\*\*|__)?\s*:(?:\*\*|__)?"
    rf"|<\|\s*({LONG})\s*\|>:?|\[\s*({LONG})\s*\]:?|#+\s*({LONG})\s*$|\*\*({LONG})\*\*\s*$)\s*", re.I)
CHUNK = 256
STAY = np.log(np.where(np.eye(3) > 0, 0.998, 0.001))
MARKED = 9.0
GIVEN = 7.0


def read_lines(text: str) -> list[tuple[int | None, str]]:
    """(role of the marker or none, line without it)."""
    lines = []
    for line in text.split("\n"):
        found = MARKER.match(line)
        lines.append((NAMES[found[found.lastindex].lower()], line[found.end():]) if found else (None, line))
    return lines


def observe(frame: pd.DataFrame, model: dict) -> tuple[np.ndarray, np.ndarray, list[int], list[list[tuple[int | None, str]]]]:
    """Emissions (lines x 3), whether a line may change the speaker, the turn of each line, and the lines."""
    mean, spread = np.array(model["mean"]), np.array(model["spread"])
    scores, starts, turns, parsed = [], [], [], []
    for i, (role, text) in enumerate(zip(frame.role, frame.text)):
        lines = read_lines(text)
        parsed.append(lines)
        size = np.log1p(len(text))
        by_length = np.maximum(-0.5 * ((size - mean) / spread) ** 2 - np.log(spread), -4.0)
        for j, (marker, line) in enumerate(lines):
            score = np.zeros(3)
            if j == 0:
                score += by_length
                if isinstance(role, str) and role.strip().lower() in NAMES:
                    score[NAMES[role.strip().lower()]] += GIVEN
                if line.rstrip().endswith("?"):
                    score[1] += 0.5
            if marker is not None:
                score[marker] += MARKED
            scores.append(score)
            starts.append(j == 0 or marker is not None)
            turns.append(i)
    return np.array(scores).reshape(-1, 3), np.array(starts, bool), turns, parsed


def transfer(scores: np.ndarray, starts: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """Max-plus product of the chunk's steps: best score from the state before it to the state at its end."""
    held = np.where(np.eye(3) > 0, 0.0, -np.inf)
    for score, start in zip(scores, starts):
        held = (held[:, :, None] + (switch if start else STAY)[None]).max(axis=1) + score
    return held


def trace(scores: np.ndarray, starts: np.ndarray, switch: np.ndarray, entry: np.ndarray, end: int) -> list[int]:
    """Best states of a chunk that is entered with scores ``entry`` and left in state ``end``."""
    held, back = entry, []
    for score, start in zip(scores, starts):
        ways = held[:, None] + (switch if start else STAY)
        back.append(ways.argmax(axis=0))
        held = ways.max(axis=0) + score
    path = [end]
    for row in reversed(back[1:]):
        path.append(int(row[path[-1]]))
    return path[::-1]


def counted(turns: DataFrame) -> dict:
    """Mean and spread of log lengths by role and switches between the roles of neighbouring turns, over all rows."""
    role = F.lower(F.trim("role"))
    size = F.log1p(F.length("text"))
    lengths = {r["r"]: r for r in turns.where(role.isin(ROLES)).groupBy(role.alias("r")).agg(
        F.sum("copies").alias("n"), (F.sum(size * F.col("copies")) / F.sum("copies")).alias("m"),
        (F.sum(size * size * F.col("copies")) / F.sum("copies")).alias("q")).collect()}
    mean = [lengths[r]["m"] if r in lengths else 5.0 for r in ROLES]
    spread = [max(0.3, (max(0.0, lengths[r]["q"] - lengths[r]["m"] ** 2)) ** 0.5) if r in lengths else 1.5 for r in ROLES]
    # Neighbours by number: the turn before and after, per conversation.
    first = turns.select("conv_id", F.col("turn").alias("t"), role.alias("a")).where(F.col("a").isin(ROLES))
    after = first.select(F.col("conv_id").alias("c"), (F.col("t") - 1).alias("u"), F.col("a").alias("b"))
    seen = first.groupBy("conv_id", "t").agg(F.min("a").alias("a")).join(
        after.groupBy("c", "u").agg(F.min("b").alias("b")), (F.col("conv_id") == F.col("c")) & (F.col("t") == F.col("u")))
    matrix = np.ones((3, 3))
    for r in seen.groupBy("a", "b").count().collect():
        matrix[ROLES.index(r["a"]), ROLES.index(r["b"])] += r["count"]
    switch = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    return {"mean": mean, "spread": spread, "switch": switch.tolist(), "start": np.log([0.3, 0.6, 0.1]).tolist()}


def _matrices(model: dict):
    def matrices(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        scores, starts, _, _ = observe(frame, model)
        held = transfer(scores, starts, np.array(model["switch"]))
        return pd.DataFrame({"conv": [frame.conv_id.iloc[0]], "chunk": [int(frame.chunk.iloc[0])], "m": [held.ravel().tolist()]})
    return matrices


def _borders(model: dict):
    def borders(frame: pd.DataFrame) -> pd.DataFrame:
        """States at the ends of a conversation's chunks, and the scores each is entered with."""
        frame = frame.sort_values("chunk")
        held, entries, ways = np.array(model["start"]), [], []
        for m in frame.m:
            step = held[:, None] + np.array(m).reshape(3, 3)
            entries.append(held)
            ways.append(step)
            held = step.max(axis=0)
        ends = [int(held.argmax())]
        for step in reversed(ways[1:]):
            ends.append(int(step[:, ends[-1]].argmax()))
        ends = ends[::-1]
        entry = [entries[0]] + [np.where(np.arange(3) == e, 0.0, -np.inf) for e in ends[:-1]]
        return pd.DataFrame({"conv": frame.conv, "chunk": frame.chunk, "entry": [e.tolist() for e in entry], "end": ends})
    return borders


def _rendered(model: dict):
    def rendered(frame: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        scores, starts, turns, parsed = observe(frame, model)
        path = trace(scores, starts, np.array(model["switch"]), np.array(border.entry.iloc[0], float), int(border["end"].iloc[0]))
        out, at = [], 0
        for i, lines in enumerate(parsed):
            roles = path[at:at + len(lines)]
            at += len(lines)
            parts: list[tuple[int, list[str]]] = []
            for role, (_, line) in zip(roles, lines):
                if not parts or parts[-1][0] != role:
                    parts.append((role, []))
                parts[-1][1].append(line)
            for part, (role, body) in enumerate(parts):
                text = "\n".join(body).strip()
                out.append((frame.turn.iloc[i], part, ROLES[role], f"<|{ROLES[role]}|>\n{text}\n<|end|>\n", int(frame.copies.iloc[i])))
        done = pd.DataFrame(out, columns=["turn", "part", "role", "rendered", "copies"])
        return done.assign(conv_id=frame.conv_id.iloc[0])[["conv_id", "turn", "part", "role", "rendered", "copies"]]
    return rendered


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per rendered turn (a turn with several speakers gives several): conv_id, turn, part, role, rendered, copies."""
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), whole().alias("text"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "text", "role")]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    turns = cut_lineage(turns).withColumn("chunk", F.floor(F.col("place") / CHUNK))
    model = counted(turns)
    matrices = turns.groupBy("conv_id", "chunk").applyInPandas(_matrices(model), "conv long, chunk long, m array<double>")
    borders = matrices.groupBy("conv").applyInPandas(_borders(model), "conv long, chunk long, entry array<double>, end int")
    return turns.groupBy("conv_id", "chunk").cogroup(cut_lineage(borders).groupBy("conv", "chunk")).applyInPandas(
        _rendered(model), "conv_id long, turn long, part int, role string, rendered string, copies long")
