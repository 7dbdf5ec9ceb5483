"""Conversation structure repair with a suffix-shared automaton.

A conversation becomes a signature, one symbol per row: the role's initial with the row's fault (sound, truncated) or,
for blank and repeated rows, one symbol for "must go". Reading from the end, signatures with equal ends share the nodes of
one acyclic automaton, and nodes are merged where no reader could tell them apart:

* an arc is looked up by (symbol, node behind it), so an end that was met before costs nothing;
* a node holds, for every state of the role grammar before it and at its end, the least cost and the ASCII-least audit
  of that cost; nodes with equal tables are one node.

Each cost-to-go and audit suffix is so worked out once for a node and a grammar state, whatever number of conversations
runs through it. Distinct signatures are sorted by their reversed symbols over all tasks, which brings equal ends
together. A conversation longer than ``chunk`` rows has several signatures; their tables are combined in groups of
``FAN`` in rounds, so no task holds all of a long conversation. Only the SHA-256 of the repaired text, which is a chain by
definition, reads a conversation in one task, row by row.

The grammar of role initials is ``(s?(ua)+)?``: state 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.

Defined results: a null role or text is one space, a null number in the key that decides on damage is one space too; rows
are ordered by turn (null first), then role, then the SHA-256 of the text; a null conv_id is one conversation; a role
with another initial, or an empty one, fits nowhere and is rerolled or deleted; a conversation that loses all rows keeps
its row with zeros, an empty audit and the hash of the empty text; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import cut_lineage, whole

STATES = 4
ACCEPTING = (0, 3)
# Fixed values of the task: costs of the edits and of a truncated row that stays, blanks, sentence ends.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLANKS = " \t\n\v\f\r"
ENDS = ".!?"
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GONE = "d"
FAN = 128


class Automaton:
    """Nodes by number; ``tables[node][g * STATES + e]`` is (cost, audit) from grammar state g to e, or None."""

    def __init__(self):
        self.tables: list[tuple] = []
        self.by_table: dict[tuple, int] = {}
        self.arcs: dict[tuple[str, int], int] = {}
        self.worked_out = 0
        self.end = self._node(tuple(self._inserted(g, e) for g in range(STATES) for e in range(STATES)))

    def _node(self, table: tuple) -> int:
        if table not in self.by_table:
            self.by_table[table] = len(self.tables)
            self.tables.append(table)
        return self.by_table[table]

    @staticmethod
    def _moves(g: int):
        return [(role, AFTER[g, role]) for role in "ua" if (g, role) in AFTER]

    def _inserted(self, g: int, e: int) -> tuple[int, str] | None:
        """The fewest insertions that lead from g to e."""
        seen, steps = {g}, 0
        while e not in seen:
            more = seen | {t for s in seen for _, t in self._moves(s)}
            if more == seen:
                return None
            seen, steps = more, steps + 1
        return INSERT * steps, "I" * steps

    def before(self, symbol: str, node: int) -> int:
        """The node of ``symbol`` followed by what ``node`` stands for."""
        if (symbol, node) in self.arcs:
            return self.arcs[symbol, node]
        self.worked_out += 1
        rest = self.tables[node]
        role, extra = symbol.lower(), CUT if symbol.isupper() else 0

        def ways(g: int, e: int):
            yield DELETE, "D", rest[g * STATES + e]
            if symbol != GONE:
                if (g, role) in AFTER:
                    yield extra, "K", rest[AFTER[g, role] * STATES + e]
                for _, after in self._moves(g):
                    yield REROLE + extra, "R", rest[after * STATES + e]

        plain = [min(((cost + then[0], op + then[1]) for cost, op, then in ways(g, e) if then), default=None)
                 for g in range(STATES) for e in range(STATES)]
        # Insertions in front of the row: to another state first, then on from there.
        table = []
        for g, e in itertools.product(range(STATES), range(STATES)):
            led = ((self._inserted(g, m), plain[m * STATES + e]) for m in range(STATES))
            table.append(min(((i[0] + p[0], i[1] + p[1]) for i, p in led if i and p), default=None))
        self.arcs[symbol, node] = self._node(tuple(table))
        return self.arcs[symbol, node]


def joined(first: tuple, second: tuple) -> tuple:
    """The table of two runs of rows in a row."""
    table = []
    for g, e in itertools.product(range(STATES), range(STATES)):
        both = ((first[g * STATES + m], second[m * STATES + e]) for m in range(STATES))
        table.append(min(((a[0] + b[0], a[1] + b[1]) for a, b in both if a and b), default=None))
    return tuple(table)


def pack(table: tuple) -> tuple[list, list]:
    return [t[0] if t else None for t in table], [t[1] if t else None for t in table]


def unpack(costs, audits) -> tuple:
    return tuple(None if a is None else (int(c), a) for c, a in zip(costs, audits))


def tables(frames):
    """(sig, costs, audits) of signatures sorted by their reversed symbols: the nodes of the end that a signature shares
    with the one before stand ready on the path, and only the rest is looked up."""
    automaton = Automaton()
    path, before = [automaton.end], ""
    for frame in frames:
        costs, audits = [], []
        for sig in frame.sig:
            backward = sig[::-1]
            shared = next((i for i, (a, b) in enumerate(zip(backward, before)) if a != b), min(len(backward), len(before)))
            del path[shared + 1:]
            for symbol in backward[shared:]:
                path.append(automaton.before(symbol, path[-1]))
            before = backward
            c, a = pack(automaton.tables[path[-1]])
            costs.append(c)
            audits.append(a)
            if len(automaton.arcs) > 200_000:  # bounds a task's memory; what follows is worked out anew
                automaton = Automaton()
                path, before = [automaton.end], ""
        yield pd.DataFrame({"sig": frame.sig, "costs": costs, "audits": audits})


TABLE = "costs array<long>, audits array<string>"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive) after the damage that a hash of (conv_id, turn) decides on. A row that goes stays
    as one that is not alive, so that its conversation is not forgotten."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    return conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (kind != 0).alias("alive"),
        F.when(kind == 3, 2).otherwise(1).alias("times")).withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "again")


def _null_safe(a: DataFrame, b: DataFrame, *names: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition &= a[name].eqNullSafe(b[f"b_{name}"])
    return condition


def faulty(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn folded: conv_id, turn, role, sha, blank, cut, copies, first (of its role and text in the conversation)."""
    ending = F.rtrim(F.col("text"), F.lit(BLANKS))
    folded = rows.where("alive").select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("sha"), (ending == "").alias("blank"),
        (~F.substring(ending, -1, 1).isin(*ENDS)).alias("cut"),
    ).groupBy("conv_id", "turn", "role", "sha", "blank", "cut").agg(F.count("*").alias("copies"))
    folded = cut_lineage(folded)
    first = folded.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn")).alias("b_first")).select(
        *(F.col(c).alias(f"b_{c}") for c in ("conv_id", "role", "sha")), "b_first")
    return folded.join(first, _null_safe(folded, first, "conv_id", "role", "sha")).select(
        *folded.columns, F.col("turn").eqNullSafe(F.col("b_first.turn")).alias("first"))


def _symbols(role: str, blank: bool, cut: bool, first: bool, copies: int):
    """Runs (symbol, how many) of a folded row."""
    if blank or not first:
        return [(GONE, copies)]
    symbol = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return [(symbol.upper() if cut else symbol, 1), (GONE, copies - 1)]


def _chunks(chunk: int):
    """Signatures of at most ``chunk`` rows of one conversation, with the role initials at their ends, out of sorted rows."""
    names = ["conv", "sig", "illegal", "head", "tail"]
    legal = {"su", "ua", "au"}

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def chunks(batches):
        conv, sig, illegal, head, tail = None, "", 0, "", ""
        for batch in batches:
            out = []
            for own, role, blank, cut, first, copies in zip(
                    *(batch.column(c).to_pylist() for c in ("conv_id", "role", "blank", "cut", "first", "copies"))):
                if sig and own != conv:
                    out.append((conv, sig, illegal, head, tail))
                    sig, illegal = "", 0
                conv, initial = own, role[:1]
                for symbol, times in _symbols(role, blank, cut, first, copies):
                    while times:
                        if len(sig) == chunk:
                            out.append((conv, sig, illegal, head, tail))
                            sig, illegal = "", 0
                        part = min(times, chunk - len(sig))
                        if sig:
                            illegal += tail + initial not in legal
                        else:
                            head = initial
                        illegal += (part - 1) * (initial + initial not in legal)
                        sig, tail, times = sig + symbol * part, initial, times - part
            if out:
                yield sent(out)
        if sig:
            yield sent([(conv, sig, illegal, head, tail)])
    return chunks


def _combined(group: pd.DataFrame) -> pd.DataFrame:
    """Consecutive chunks of a conversation as one."""
    group = group.sort_values("place")
    table, illegal = None, int(group.illegal.sum())
    for costs, audits in zip(group.costs, group.audits):
        own = unpack(costs, audits)
        table = own if table is None else joined(table, own)
    for a, b in zip(group["tail"].iloc[:-1], group["head"].iloc[1:]):
        illegal += a + b not in {"su", "ua", "au"}
    costs, audits = pack(table)
    return pd.DataFrame({"conv": group.conv.iloc[:1].astype("Int64"), "place": group.place.iloc[:1], "illegal": [illegal], "head": [group["head"].iloc[0]],
                         "tail": [group["tail"].iloc[-1]], "costs": [costs], "audits": [audits]})


def verdicts(rows: DataFrame, chunk: int = 128) -> DataFrame:
    """(conv, illegal, cost, audit) of every conversation with rows, out of ``faulty`` rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "sha")]
    # Ranges, not conversations, are dealt out: a conversation that holds many rows lies in many tasks.
    chunks = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _chunks(chunk), "conv long, sig string, illegal long, head string, tail string")
    chunks = cut_lineage(chunks.withColumn("place", F.monotonically_increasing_id()))
    backward = F.reverse("sig")
    known = chunks.select("sig").distinct().repartitionByRange(parts, backward).sortWithinPartitions(backward).mapInPandas(
        tables, f"sig string, {TABLE}")
    placed = cut_lineage(chunks.join(known, "sig").drop("sig"))

    counted = placed.groupBy("conv").agg(F.count("*").alias("n"))
    many = counted.where("n > 1").select(F.col("conv").alias("b_conv"))
    done = placed.join(many, placed["conv"].eqNullSafe(many["b_conv"]), "left_anti")
    left = cut_lineage(placed.join(many, placed["conv"].eqNullSafe(many["b_conv"]), "left_semi"))
    schema = f"conv long, place long, illegal long, head string, tail string, {TABLE}"
    # ``place`` is the task's number times 2^33 plus the chunk's within the task: first groups of FAN places within the
    # tasks, then of FAN tasks, until each conversation is one row.
    longest, tasks = left.agg(F.max(F.col("place") % 2**33), F.max(F.shiftright("place", 33))).first()
    if longest is not None:
        spans = [FAN**k for k in range(1, 5) if k == 1 or FAN ** (k - 1) <= longest]
        spans += [2**33 * FAN**k for k in range(1, 4) if k == 1 or FAN ** (k - 1) <= tasks]
        for span in spans:
            left = cut_lineage(left.groupBy("conv", F.floor(F.col("place") / F.lit(span))).applyInPandas(_combined, schema))
    ends = [F.struct(F.get("costs", F.lit(e)).alias("cost"), F.get("audits", F.lit(e)).alias("audit")) for e in ACCEPTING]
    best = F.array_min(F.filter(F.array(*ends), lambda x: x["cost"].isNotNull()))
    return done.unionByName(left).select("conv", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


def replay(audit: str, roles: list[str]) -> list[str | None]:
    """For a stretch of the audit: what becomes of each row. Used by tests and by readers of an audit; the job streams."""
    state = Replay(audit)
    return [state.row(role) for role in roles]


class Replay:
    """Follows an audit row by row. ``row`` gives the row's role after the repair, or None where it goes; ``inserted`` are the
    roles of rows to be put in before it."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.inserted: list[str] = []

    def _next(self) -> str:
        role = "a" if self.state == 2 else "u"
        self.state = AFTER[self.state, role]
        return {"u": "user", "a": "assistant"}[role]

    def insertions(self) -> list[str]:
        out = []
        while self.audit[self.at:self.at + 1] == "I":
            out.append(self._next())
            self.at += 1
        return out

    def row(self, role: str) -> str | None:
        self.inserted = self.insertions()
        op = self.audit[self.at]
        self.at += 1
        if op == "D":
            return None
        if op == "R":
            return self._next()
        self.state = AFTER[self.state, role[:1]]
        return role


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repaired(batches):
    """Rows of whole conversations, in order and each after its header, to one row a conversation."""
    names = ["conv_id", *FACTS, "audit", "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    head, follow, digest, lines = None, None, None, 0

    def put(role: str, text: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        lines += 1

    def close():
        for role in follow.insertions():
            put(role, "")
        return (*head, follow.audit, digest.hexdigest())

    for batch in batches:
        out = []
        for conv, header, role, text, audit, *facts in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "header", "role", "text", "audit", *FACTS))):
            if header:
                if head is not None:
                    out.append(close())
                head, follow, digest, lines = (conv, *facts), Replay(audit), hashlib.sha256(), 0
                continue
            after = follow.row(role)
            for more in follow.inserted:
                put(more, "")
            if after is not None:
                put(after, text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(close(), types)], names=names)


def repair(conversations: DataFrame, chunk: int = 128) -> DataFrame:
    """One row per conversation of a damaged table: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = conversations.sparkSession
    rows = damaged(conversations)
    marked = cut_lineage(faulty(rows))
    gone = F.when(F.col("blank"), 0).otherwise(F.when(F.col("first"), F.col("copies") - 1).otherwise(F.col("copies")))
    facts = marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"), F.sum(gone).alias("duplicate"),
        F.count_if(~F.col("blank") & F.col("first") & F.col("cut")).alias("truncated"))
    found = verdicts(marked, chunk)
    known = facts.join(found, facts["conv_id"].eqNullSafe(found["conv"])).drop("conv")
    every = rows.select(F.col("conv_id").alias("b_conv_id")).distinct()
    header = every.join(known, known["conv_id"].eqNullSafe(every["b_conv_id"]), "left").select(
        F.col("b_conv_id").alias("conv_id"), F.lit(True).alias("header"), F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("string").alias("text"),
        whole("audit").alias("audit"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FACTS))
    none = [F.lit(None).cast("long").alias(c) for c in FACTS]
    body = rows.where("alive").select("conv_id", F.lit(False).alias("header"), "turn", "role", F.sha2("text", 256).alias("sha"), "text",
                                      F.lit(None).cast("string").alias("audit"), *none)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.desc("header"), *(F.col(c).asc_nulls_first() for c in ("turn", "role", "sha"))]
    return header.unionByName(body).repartition(parts, "conv_id").sortWithinPartitions(*order).select(
        "conv_id", "header", "role", "text", "audit", *FACTS).mapInArrow(
        _repaired, "conv_id long, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string")
