"""Cases that once failed: sparse partitions, mixed dimensions, bare words in chats, hot or unnumbered conversations,
frequent words that were encoded again and again."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.llm import chat, common, queries, token_counts, toxicity, topk_search


def test_hash_filter_lets_all_members_pass(spark):
    found = common.HashFilter(spark.range(3000).select(F.xxhash64("id").alias("h")))
    every = spark.range(60000)
    got, rest = ({r.id for r in side(every, F.xxhash64("id")).collect()} for side in (found.passing, found.strangers))
    assert got >= set(range(3000)) and len(got) < 3000 + 57000 / 8 and not got & rest and len(got) + len(rest) == 60000
    none = common.HashFilter(spark.range(0).select(F.xxhash64("id").alias("h")))
    assert none.passing(every, F.xxhash64("id")).count() == 0 and none.strangers(every, F.xxhash64("id")).count() == 60000


def test_full_filter_only_lets_more_pass(spark):
    few_bits = common.HashFilter(spark.range(200000).select(F.xxhash64("id").alias("h")), most=12)
    assert few_bits.passing(spark.range(1000), F.xxhash64("id")).count() == 1000 and few_bits.words.count() == 64


def test_components_of_chains_and_stars(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(1000, 1001)] * 3 + [(5, 5)]
    links += [(2000 + draw.randrange(80), 2000 + draw.randrange(80)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {n: root(n) for n in {n for a, b in links if a != b for n in (a, b)}}
    got = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_subtract_ties_and_nulls(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, None), (3, "c")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, any int, __x int")
    told = docs.select("doc_id", F.xxhash64(common.whole("text")).alias("fp")).distinct()
    keep_none = told.where("doc_id is null or doc_id = 2").withColumn("kept", F.lit(False))
    one_of_two = told.where("doc_id = 1").crossJoin(spark.createDataFrame([(True,), (False,)], "kept boolean"))
    left = common.subtract(docs, keep_none.unionByName(one_of_two))
    assert left.columns == docs.columns and Counter((r.doc_id, r.text) for r in left.collect()) == {(1, "a"): 1, (1, "b"): 1, (3, "c"): 1}
    assert common.subtract(docs.limit(0), keep_none).count() == 0


def test_vectors_of_several_dimensions(spark):
    draw = random.Random(1)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(1 + i % 3)]) for i in range(200)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, block=16, group=2, pivots=3)
    want = set()
    for q, v in rows[::10]:
        own = sorted((-int(np.floor(1024 * np.array(v)) @ np.floor(1024 * np.array(w))), i) for i, w in rows if i != q and len(w) == len(v))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(own)}
    assert {tuple(r) for r in got.collect()} == want
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).count() == 0


DOCS = "doc_id long, text string, score double, toxic int, clauses int"


def test_toxicity_on_sparse_and_odd_tables(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = [(1, "you are an idiot."), (2, "a fine day."), (3, ""), (4, None), (5, "12 34 ab"), (6, "a fine day."), (1, "you are an idiot."), (None, "x")]
        docs = spark.createDataFrame([(i, t, 1.0, 1, 1) for i, t in rows], DOCS)
        labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1), (6, None), (99, 1), (None, 1)], "doc_id long, toxic int")
        model = toxicity.fit(docs, labels)
        got = toxicity.score(docs, model).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    same = {}
    for r in got:
        same.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in same.values()) and same[3] == same[4]
    by_hand = toxicity.Matcher(model.learned)
    for r in got:
        words, found = by_hand.clauses(dict(rows)[r.doc_id] or "")
        z = float(np.dot(toxicity.features(words, [s for s, _ in found]), model.weights))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12 and r.clauses == len(found)
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0 == toxicity.reject(empty, model).count()
    assert toxicity.reject(docs, model).columns == docs.columns


def test_equal_texts_with_two_labels_count_as_toxic(spark):
    rows = [(i, "you utter snollygoster, really" if i % 2 else f"plain text number {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(200)], "doc_id long, toxic int")
    first = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = toxicity.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7), labels)
    assert first.learned == again.learned and np.allclose(first.weights, again.weights)


CHATS = "conv_id long, turn long, role string, text string, place long, chunk long"


def rendered(spark, rows):
    got = chat.format_chats(spark.createDataFrame([(*r, 0, 0) for r in rows], CHATS)).collect()
    return got, {(r.conv_id, r.turn, r.part): r.rendered for r in got}


def body_of(text):
    return text.split("\n", 1)[1].rsplit("\n<|end|>", 1)[0]


@pytest.mark.parametrize("text", ["A", "Me", "a > b holds", "Context", "Question", "Pick one:\nA\nB\nC", "system\nof a down", "user friendly", "me\nand you"])
def test_bare_words_stay(spark, text):
    got, _ = rendered(spark, [(1, 0, "user", "Which?"), (1, 1, "assistant", text)])
    kept = "\n".join(body_of(r.rendered) for r in sorted(got, key=lambda r: (r.turn, r.part)) if r.turn == 1)
    assert kept == text


def plain_viterbi(rows, model):
    """The best path over all lines of a conversation at once, rendered turn by turn."""
    import pandas as pd
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    scores, starts, turns, parsed = chat.observe(frame, model)
    switch = np.array(model["switch"])
    whole = np.array(model["start"])
    held = whole
    for s, st in zip(scores, starts):
        held = (held[:, None] + (switch if st else chat.STAY)).max(axis=0) + s
    return chat.trace(scores, starts, switch, whole, int(held.argmax())), turns, parsed


def test_long_and_unnumbered_conversations_equal_one_pass(spark, monkeypatch):
    draw = random.Random(6)
    say = ["Assistant: hello", "User: what?", "Just text", "A", "why\nUser: so\nBot: this", "", "[User] hm", "x " * 60]
    rows = [(1, t, draw.choice([None, "user", "assistant"]), f"{draw.choice(say)} {t}") for t in range(700)]
    rows += [(None, None, "user", f"free {i}") for i in range(600)] + [(2, 4, "user", f"tied {i}") for i in range(300)] + [(3, 0, "system", None)]
    got, texts = rendered(spark, rows)
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.counted(plain.withColumn("copies", F.lit(1)).withColumn("text", common.whole("text")))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[3] or "", r[2] is not None, r[2] or "")
    ordered = sorted(((c, t, r, x or "") for c, t, r, x in rows), key=key)
    want = Counter()
    for conv in {r[0] for r in rows}:
        own = [r for r in ordered if r[0] == conv]
        path, turns, parsed = plain_viterbi(own, model)
        at = 0
        for i, lines in enumerate(parsed):
            roles = path[at:at + len(lines)]
            at += len(lines)
            part, before, body = -1, None, []
            for role, (_, line) in [*zip(roles, lines), (None, (None, ""))]:
                if role != before:
                    if before is not None:
                        part += 1
                        name, text = chat.ROLES[before], "\n".join(body).strip()
                        want[conv, own[i][1], part, name, f"<|{name}|>\n{text}\n<|end|>\n"] += 1
                    before, body = role, []
                body.append(line)
    assert Counter((r.conv_id, r.turn, r.part, r.role, r.rendered) for r in got) == want
    assert chat.format_chats(plain.limit(0)).count() == 0


class CountedTokenizer:
    """The library's tokenizer, which notes what it is asked for; ``split`` is what went through the pre-tokenizer."""

    def __init__(self, library):
        self.library, self.model, self.asked, self.split = library, self, Counter(), set()

    def tokenize(self, letters):
        self.asked[letters.replace("Ġ", " ")] += 1
        return self.library.model.tokenize(letters)

    def encode_batch_fast(self, texts, **options):
        self.asked.update(texts)
        self.split.update(texts)
        return self.library.encode_batch_fast(texts, **options)

    def no_truncation(self):
        self.library.no_truncation()

    no_padding = no_truncation


def test_frequent_words_are_encoded_once_and_plain_ones_whole(monkeypatch):
    import tokenizers

    path = queries.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    counted = CountedTokenizer(library)
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Tokenizer", (), {"from_file": staticmethod(lambda _: counted)}))
    monkeypatch.setattr(token_counts.PieceTable, "ENTRIES", 60)
    encode = token_counts.encoder.__wrapped__(path)
    draw = random.Random(9)
    frequent = [" the", " of", " Well", " 17", ","]
    letters = [chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha()]
    rare = lambda: " " + "".join(draw.choices(letters + list("abcdefghijklmnopqrstuvwxyz") * 20, k=8))
    for _ in range(200):
        text = "".join(w for f in frequent for w in (f, rare(), rare()))
        assert encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    every = [f"{space}x{c}" for c in letters for space in ("", " ", "\n", "  ")] + ["<|endoftext|>", " a<|endoftext|>b", "1²", "x\x1cy", "q" * 60]
    assert [i.tolist() for i in encode(every)] == [library.encode(t, add_special_tokens=False).ids for t in every]
    assert all(counted.asked[w] == 1 for w in frequent)
    assert not counted.split & {" the", " of", " Well", " 17"}
    assert len(encode.__self__) <= 61 and len(encode.__self__.older) <= 61
