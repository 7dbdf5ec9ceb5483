"""Conversation repair, fingerprints and whitening against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.llm import fingerprints, queries, structure, whitening

CHATS = "conv_id long, turn long, role string, text string, sig string, place long, first string"


def cheapest(rows):
    """(cost, audit) over all edit sequences with at most one insertion between rows. rows: (role, must go, truncated)."""
    best = None
    inserts = [("", 0, ""), ("I", 5, "u"), ("I", 5, "a")]
    choices = []
    for role, gone, cut in rows:
        extra = 5 if cut else 0
        own = [("D", 2, "")]
        if not gone:
            own += [("K", extra, role[:1] or "-"), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        choices += [inserts, own]
    for path in itertools.product(*choices, inserts):
        if re.fullmatch("(s?(ua)+)?", "".join(p[2] for p in path)):
            found = (sum(p[1] for p in path), "".join(p[0] for p in path))
            best = found if best is None or found < best else best
    return best


def plain(rows):
    """The contract of the repair, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own, damaged = [r for r in rows if r[0] == conv], []
        for _, turn, role, text in own:
            name = lambda v: " " if v is None else str(v)
            kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
            role, text = name(role), name(text)
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for turn, role, text in damaged:
            body = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = [r[0] for r in damaged if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(damaged, damaged[1:]))
        cost, audit = cheapest([(r[1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(damaged, faults)])
        follow, lines = structure.Replay(audit), []
        for turn, role, text in damaged:
            after = follow.row(role)
            lines += [f"{x}:" for x in follow.inserted] + ([f"{after}:{text}"] if after is not None else [])
        lines += [f"{x}:" for x in follow.insertions()]
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def chats(seed=3):
    draw = random.Random(seed)
    texts = ["One.", "Two!", "Three", "", " \t", "One. ", "Why?\n", None, "🙂"]
    rows = [(conv, draw.choice([None, 0, 1, 2, 2, 7]), draw.choice(["user", "assistant", "system", "tool", "", None, "agent"]), draw.choice(texts))
            for conv in range(60) for _ in range(draw.randint(1, 3))]
    gone = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (gone, 0, "user", "Lost.")]


@pytest.mark.parametrize("chunk", [128, 1])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(structure, "FAN", 2)
    rows = chats()
    table = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], CHATS).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in structure.repair(table, chunk=chunk).collect()}
    assert got == plain(rows)


def test_long_conversation_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(structure, "FAN", 3)
    draw = random.Random(9)
    rows = [(1, t, draw.choice(["user", "assistant", "tool"]), draw.choice(["a.", f"b {t}.", f"c {t}", ""])) for t in range(400)]
    rows += [(2, 5, "user", "again")] * 30
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = (sorted(structure.repair(table, chunk=c).collect()) for c in (1000, 7))
    assert whole == cut and len(whole) == 2 and len(whole[0].audit) > 380 and whole[1].duplicate >= 29
    assert structure.repair(table.limit(0)).count() == 0


def test_automaton_shares_ends():
    automaton, by_hand = structure.Automaton(), 0
    sigs = sorted(("".join(s) for s in itertools.product("suaAd", repeat=5)), key=lambda s: s[::-1])
    for sig in sigs:
        node = automaton.end
        for symbol in reversed(sig):
            node = automaton.before(symbol, node)
            by_hand += 1
        ends = [automaton.tables[node][e] for e in structure.ACCEPTING]
        rows = [(s.lower(), s == "d", s == "A") for s in sig]
        if draw_some(sig):
            assert min(t for t in ends if t) == cheapest_by_states(rows)
    # At most one piece of work for each distinct end, fewer where ends behave alike, and never one for each row.
    assert automaton.worked_out <= sum(5**n for n in range(1, 6)) < by_hand
    assert len(automaton.tables) < automaton.worked_out


def draw_some(sig):
    return zlib.crc32(sig.encode()) % 7 == 0


def cheapest_by_states(rows):
    """The same as ``cheapest`` without insertions, which never pay, row by row from the front with whole audits."""
    held = {0: [(0, "")]}
    for role, gone, cut in rows:
        after = {}
        for state, paths in held.items():
            for cost, audit in paths:
                steps = [("D", 2, state)]
                if not gone:
                    extra = 5 if cut else 0
                    steps += [("K", extra, structure.AFTER[state, role])] if (state, role) in structure.AFTER else []
                    steps += [("R", 1 + extra, structure.AFTER[state, r]) for r in "ua" if (state, r) in structure.AFTER]
                for op, more, to in steps:
                    after.setdefault(to, []).append((cost + more, audit + op))
        held = {s: [min(p)] for s, p in after.items()}
    return min(p for s, paths in held.items() if s in structure.ACCEPTING for p in paths)


def shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(1, 9))) for _ in range(4000)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.choice([3, 4, 5, 6, 40, 90, 300, 900]))) for _ in range(60)]
    return texts + ["", None, "  ", "one", "X Y", "🙂 naïve İstanbul ΟΔΟΣ ΟΔΟΣ x", texts[0], texts[0], "w " * 5000, "q" * 9000]


def test_succession(spark, prose):
    rows = [(3 * i - 20, t) for i, t in enumerate(prose)] + [(None, "no id")]
    table = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, range string, extra int").repartition(7)
    k = 128
    got = {r.doc_id: r for r in fingerprints.succession(table, sample=3).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", got[i]
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for other, near, code in ((changed, r.near_edited, r.edited_fingerprint), (after, r.near_next, None)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < (0.16 if len(a | b) > k else 1e-12)
            assert code is None or code == fingerprints.as_text(fingerprints.sketch(other))
    assert got[-20].fingerprint == got[3 * 66 - 20].fingerprint == got[3 * 67 - 20].fingerprint
    assert fingerprints.succession(table.limit(0)).count() == 0
    alone = fingerprints.succession(table.where("doc_id = -20")).first()
    assert alone.near_next == 1.0


def test_tied_ids_keep_their_rows(spark):
    rows = [(7, "same text here")] * 300 + [(7, "other")] * 3 + [(8, "above"), (6, "below")]
    got = fingerprints.succession(spark.createDataFrame(rows, "doc_id long, text string"), sample=20).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    # All but the last of the equal rows are followed by their like.
    assert sum(r.near_next == 1 for r in got) == 299 + 2


def test_sketch_in_pieces_and_estimates(prose):
    for text in prose:
        text = text or ""
        for piece in (7, 100, 1 << 20):
            assert fingerprints.sketch(text, piece=piece).tolist() == fingerprints.sketch(text).tolist()
        true = len(shingles(text))
        assert abs(fingerprints.distinct(fingerprints.sketch(text), 128) - true) <= 0.35 * true * (true >= 128)
    a, b = prose[-2], prose[-2] + " " + " ".join(f"n{i}" for i in range(50))
    assert fingerprints.containment(fingerprints.sketch(a), fingerprints.sketch(b), 128) == 1.0
    few = fingerprints.sketch("a b c d e f g"), fingerprints.sketch("a b c d e f z")
    assert fingerprints.resemblance(*few, 128) == 2 / 4 and fingerprints.containment(*few, 128) == 2 / 3


def test_sketches_merge(spark, prose):
    table = spark.createDataFrame([(i, t, ["x", "y", None][i % 3]) for i, t in enumerate(prose)], "doc_id long, text string, part string")
    prints = fingerprints.fingerprints(table).join(table.select("doc_id", "part"), "doc_id")
    got = {r.part: r.fingerprint for r in fingerprints.merge(prints, "part").collect()}
    for part, code in got.items():
        own = [fingerprints.sketch(t or "") for i, t in enumerate(prose) if ["x", "y", None][i % 3] == part]
        assert code == fingerprints.as_text(fingerprints.lowest(np.concatenate(own), 128))
    pair = spark.createDataFrame([(got["x"], got["x"]), ("", ""), ("", got["x"])], "p string, q string")
    assert [tuple(r)[2:] for r in fingerprints.compare(pair, "p", "q").collect()] == [(1, 1, 1), (1, 1, 1), (0, 1, 0)]


def test_polar_and_eigen():
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    for values in ([6, 5, 4, 3, 2, 1], [1, 1, 1, 1, 1, 1], [5, 5, 5, 1, 1, 0], [1, 1e-6, 1e-12, 0, 0, 0], [0] * 6, [2, 2 - 1e-14, 2, 1, 1 + 1e-13, -3]):
        v = turn @ np.diag(values) @ turn.T
        v = (v + v.T) / 2
        e, q = whitening.eigen(v)
        scale = max(1, np.abs(values).max())
        assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() < 1e-13 * scale
        assert np.abs(q.T @ q - np.eye(6)).max() < 1e-14 * 6 and np.abs(v @ q - q * e).max() < 1e-13 * scale
    u = whitening.polar(turn @ np.diag([3, 2, 1, -1e-9, -2, -4]) @ turn.T)
    assert np.abs(u @ u - np.eye(6)).max() < 1e-13 and round(np.trace(u)) == 0


def test_whitening(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, [1.0] * 5)] * 3
    rows += [(901, None), (902, [float("nan")] * 5), (903, [None] * 5), (904, [float("inf")] * 5), (905, []), (None, [0.25] * 5)]
    rows += [(1000 + i, [float(i), 2.0 * i]) for i in range(4)] + [(2000, [7.0, 8.0, 9.0])]
    table = spark.createDataFrame([(i, v, "clash", 3) for i, v in rows], "vec_id long, embedding array<double>, v string, dim int").repartition(4)
    got = whitening.whiten(table).toPandas()
    for dim, kept in ((5, 5), (2, 1)):
        own = [(i, v) for i, v in rows if v and len(v) == dim and None not in v and np.isfinite(v).all()]
        x = np.floor(64 * np.array([v for _, v in own])).astype(int) + 1000000
        n, total = len(x), x.sum(axis=0)
        away = x - total / n
        e, q = np.linalg.eigh(away.T @ away / n)
        e, q = e[::-1][:kept], q[:, ::-1][:, :kept]
        want = away @ q / np.sqrt(e)
        part = got[got.n == n]
        assert len(part) == n * kept and part.identity_error.max() < 1e-9
        square = {}
        for (i, _), w, row in zip(own, want, x.tolist()):
            square.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(row, total)), tuple(np.abs(w))))
        for i, group in part.groupby(part.vec_id.astype("object").where(part.vec_id.notna(), None), dropna=False):
            i = None if i is None or i != i else int(i)
            assert len(group) == kept * len(square[i]) and set(group.deviation) == {d for d, _ in square[i]}
            for c in range(kept):
                mine = group[group.component == c + 1].whitened.abs()
                assert np.allclose(mine, square[i][0][1][c], rtol=1e-7, atol=1e-7)
        assert np.allclose(part.groupby("component").explained.first(), e / np.trace(away.T @ away / n), rtol=1e-9)
    assert set(got.n) == {304, 4}  # three equal vectors of other lengths have no component
    assert whitening.whiten(table.limit(0)).count() == 0


def test_exact_sums_of_large_numbers():
    d = np.array([[2**31 - 1, -(2**31)], [2**31 - 1, 5], [3, 4]], np.int64)
    total = sum(np.array(p, dtype=object) for p in whitening.exact_products(d // 2))
    assert total.tolist() == (d // 2).astype(object).T.dot((d // 2).astype(object)).tolist()
    fit = whitening.Fit(10**12, np.zeros(2, np.int64), [5, -7])
    assert whitening.deviations(np.array([[3, 1], [0, 0]], np.int64), fit).to_pylist() == [None, 74]


def test_registered(spark):
    out = queries.op13_whitening(spark, "/root/testdata/sf0.001")
    assert out.where("component = 1").count() == 500 and out.agg(F.max("component")).first()[0] == 32
    assert queries.op12_fingerprints(spark, "/root/testdata/sf0.001").count() == 200
