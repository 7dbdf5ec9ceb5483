"""The text operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.llm import (bpe, chat, exact_dedup, near_dedup, packing, pii, quality, queries, token_counts, topk_search,
                           toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, suspect string, key string"


def texts(seed=1, count=60):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(300)]
    out = []
    for _ in range(count):
        words = draw.choices(vocabulary, k=draw.randint(6, 60))
        out.append(" ".join(words))
        if draw.random() < 0.4:
            words[draw.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(500, None), (501, ""), (None, "no id at all"), (502, "twice"), (502, "twice"), (503, rows[0][1]),
             (504, "one two"), (505, "x y " * 30000), (506, "🙂 naïve <|endoftext|> text\n\n  end")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rice_code_round_trip():
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    for bits in (1, 40, 53):
        low = values >> np.uint64(30 if bits == 1 else 0)
        low = np.unique(low >> np.uint64(25)) if bits == 1 else low
        if bits == 1:
            low = np.arange(500, dtype=np.uint64) * np.uint64(3)
        assert (near := exact_dedup.rice_decode(exact_dedup.rice_encode(low, bits), len(low), bits)).tolist() == low.tolist(), near


def test_exact(docs, empty):
    found = exact_dedup.duplicates(docs).collect()
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.duplicates(empty).count() == 0


def test_near(docs, empty):
    rows = docs.collect()
    bags = []
    for r in rows:
        words = (r.text or "").lower().split()
        bags.append(Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            if shared and shared / sum((bags[i] | bags[j]).values()) >= 0.8:
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[root(i)].append(r.doc_id)
    want = Counter((i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in classes.values() for i in ids)
    found = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found) == want
    assert sum(r.kept for r in found) == len(classes) == near_dedup.keep_one(docs).count()
    assert near_dedup.near_duplicates(empty).count() == 0


def test_contained_pairs_at_the_threshold(spark):
    # With one component as the only band, a pair that shares a bucket with a smaller third node meets only in the second pass.
    rows, groups = [], 60
    for g in range(groups):
        own = [f"w{g}x{i}" for i in range(14)]
        rows += [(3 * g + k, " ".join(own[:n])) for k, n in enumerate((14, 12, 9))]  # 10, 8 and 5 shingles
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1).collect()}
    bags = near_dedup.shingle_bags([t for _, t in rows], 5)
    first = near_dedup.signatures(*bags, len(rows), 1)[:, 0]
    key = near_dedup.multiset_keys(*bags, len(rows))[0].view(np.int64)
    met = [g for g in range(groups) if first[3 * g] == first[3 * g + 1]]
    assert any(first[3 * g + 2] == first[3 * g] and key[3 * g + 2] < min(key[3 * g], key[3 * g + 1]) for g in met)
    for g in range(groups):
        a, b, c = (found[3 * g + k] for k in range(3))
        assert c == 3 * g + 2 and b == 3 * g + 1 and a == (b if g in met else 3 * g)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    doc = np.repeat([0, 1], 40)
    shingle = np.tile(rng.integers(0, 2**63, 40, dtype=np.uint64), 2)
    weight = rng.integers(1, 9, 80)
    sig = near_dedup.signatures(doc, shingle, weight, 2, 4000)
    a, b = weight[:40], weight[40:]
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library = Tokenizer.from_file(path)
    ids = Counter()
    for r in docs.collect():
        ids[r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids), r.text or ""] += 1
    got = bpe.encoded(docs, path).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == ids
    counted = token_counts.token_counts(docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_bytes) for r in counted) == Counter(
        {(d, len(i), len(t.encode())): n for (d, i, t), n in ids.items()})
    assert bpe.encoded(empty, path).count() == token_counts.token_counts(empty, path).count() == 0


def test_pieces_have_the_tokens_of_the_text():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library, encode = Tokenizer.from_file(path), token_counts.encoder(path)
    assert token_counts.splits_safely(path)
    draw = random.Random(6)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\u00a0", "\u3000", "\u200b", "\ufeff", "!", ",", "(", "_", "-",
             "×", "²", "a", "Bc", "1", "é", "🙂", "\u0378", "'s", "<|", "<|endoftext|>", "q" * 60]
    made = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(3000)]
    made.append("".join(draw.choices(parts, k=40000)))
    assert [ids.tolist() for ids in encode(made)] == [library.encode(t, add_special_tokens=False).ids for t in made]


def test_packing(docs, empty):
    path = queries.vocabulary()
    pieces = packing.pack(docs, path).toPandas()
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        ends = own.length.cumsum()
        assert ends.iloc[-1] <= 2048 and own.offset.tolist() == [0, *ends.tolist()[:-1]]
    total = token_counts.token_counts(docs, path).agg(F.sum("n_tokens"), F.count("*")).first()
    assert pieces.length.sum() == sum(total)
    assert pieces.sequence_id.nunique() == packing.lower_bound(Counter(pieces.length.tolist()), 2048)
    assert packing.pack(empty, path).count() == 0


def test_completion_meets_brute_force():
    draw = random.Random(4)
    for _ in range(20):
        sizes = [draw.randint(1, 10) for _ in range(7)]
        best = len(sizes)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= 10:
                    place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1:]])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        assert sum(n for _, n in packing.complete_bins(Counter(sizes), 10)) == best


def test_search_goes_on_after_a_long_first_descent():
    large = Counter(range(7000, 9500))  # each alone in its bin, and each a filling of its own
    small = Counter([3042, 3266, 3692, 3415, 3311, 3274, 3367, 3598, 3035])  # three whole bins, which best fit misses
    found = packing.complete_bins(large + small, 10000)
    used = Counter()
    for filling, times in found:
        assert sum(filling) <= 10000
        used.update({s: n * times for s, n in Counter(filling).items()})
    assert used == large + small and sum(n for _, n in found) == packing.lower_bound(large + small, 10000) == 2503


def test_fillings_are_the_undominated_ones():
    draw = random.Random(8)
    for _ in range(30):
        room, left = draw.randint(5, 14), Counter(draw.randint(1, 9) for _ in range(7))
        all_ = {()}
        for piece in left.elements():
            all_ |= {tuple(sorted((*f, piece), reverse=True)) for f in all_}
        all_ = {f for f in all_ if sum(f) <= room and not Counter(f) - left}

        def covers(big, small):
            """Whether the pieces of ``small`` can be put into those of ``big``."""
            return not small or any(
                covers((*big[:i], big[i] - small[0], *big[i + 1:]), small[1:]) for i in range(len(big)) if big[i] >= small[0])

        want = {f for f in all_ if not any(g != f and covers(g, f) for g in all_)}
        got = [f for f in packing.fillings(left.__getitem__, sorted(left), room) if f is not None]
        assert len(got) == len(set(got)) and set(got) == want
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_pseudonyms(spark, empty):
    body = ("ann.92@mail2.example.com 97.51.17.173 4539578763621486 9807915762804490 300.1.1.1 +1 (017) 555-7713 1985-02-28 "
            "2023-02-30 DE89 3704 0044 0532 0130 00 version 2.0. ")
    rows = [(1, body), (2, "x " + body), (3, None), (4, ""), (5, "clean text 3.0")]
    got = {r.doc_id: r for r in pii.findings(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got[1].kinds == ["email", "ip", "card", "phone", "date", "iban"] and got[2].text == "x " + got[1].text
    assert got[3].text is None and got[4].text == "" and got[5].text == "clean text 3.0"
    for value in ("ann.92", "97.51.17.173", "4539578763621486", "555-7713", "1985-02-28"):
        assert value not in got[1].text
    for value in ("9807915762804490", "300.1.1.1", "2023-02-30", "version 2.0."):
        assert value in got[1].text
    assert pii.findings(empty, "k").count() == 0


def test_values_next_to_short_tokens(spark):
    cards = ["4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486", "378282246310005", "3782 822463 10005"]
    ibans = ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "BE68539007547034",
             "PL61109010140000071219812874", "SE4550000000058398257466", "DE89 3704 0044 0532 0130 00"]
    rows = [(before, value, after, ["card"]) for value in cards for before, after in (
        ("pay ", " 12/26 or later"), ("pay ", " 123"), ("pay ", " 3 items"), ("no 12 ", " 7"), ("no 2023 ", "."), ("", " 1 2 3 4 5 6 7 8 9"))]
    rows += [(before, value, after, ["iban"]) for value in ibans for before, after in (
        ("", " BIC CAIXESBB"), ("to ", " EUR"), ("to ", " 42"), ("", " A1"), ("ID12 ", ""))]
    rows += [("", cards[1], f" {value}", ["card", kind]) for value, kind in (
        ("10.1.2.3", "ip"), ("1985-02-28", "date"), ("123-45-6789", "ssn"), (cards[0], "card"))]
    rows += [("", ibans[0], f" {cards[1]}", ["iban", "card"]), ("", cards[0], f" 55 {ibans[1]}", ["card", "iban"]),
             ("", ibans[2], f" {ibans[4]}", ["iban", "iban"])]
    rows += [("1 2 " * 4000, cards[0], "", ["card"])]
    table = spark.createDataFrame([(i, "".join(r[:3])) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.findings(table, "k").collect()}
    for i, (before, value, after, kinds) in enumerate(rows):
        assert value not in got[i].text and len(got[i].text) >= len(value), rows[i][:3]
        assert len(kinds) == 1 or after.strip().split()[-1] not in got[i].text, rows[i][:3]
        assert len(before) > 10000 or got[i].kinds == kinds, (rows[i], got[i])


def test_feistel_permutes(spark):
    all_ = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert all_.select(pii.feistel(F.col("v"), pii.LOWER[:10], "t", "k")).distinct().count() == 1000


def test_grammar():
    score = lambda s: sum(x for x, _ in toxicity.Matcher({}).clauses(s)[1])
    assert score("you are an idiot.") > score("what an idiot.") > score("she said what an idiot.")
    assert score("you are not an idiot.") < score("an idiot.") and score("a fine day.") == score("") == 0
    assert score("i will kill you.") > score("kill the process.")


def test_toxicity_held_out(spark):
    out = queries.op1_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = out.merge(labels, on="doc_id").query("held_out")
    assert len(out) == 10000 and ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.97


def test_quality_held_out(spark, empty):
    out = queries.op5_quality_cotraining(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = out.merge(labels, on="doc_id").query("held_out")
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.97
    assert quality.co_train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_chat_roles(spark):
    rows = [(1, 0, None, "User: hi?"), (1, 1, None, "Assistant: hello there\nUser: ok?"), (1, 1, None, "Assistant: hello there\nUser: ok?"),
            (2, 0, "user", None), (None, 0, "assistant", "x")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    one = sorted((r.turn, r.part, r.role, r.copies) for r in got if r.conv_id == 1)
    assert one == [(0, 0, "user", 1), (1, 0, "assistant", 2), (1, 1, "user", 2)] and len(got) == 5


def test_chunked_viterbi_is_exact():
    rng = np.random.default_rng(3)
    scores, starts, switch = rng.normal(size=(9, 3)), rng.random(9) < 0.5, rng.normal(size=(3, 3))
    whole = chat.transfer(scores, starts, switch)
    parts = [chat.transfer(scores[a:b], starts[a:b], switch) for a, b in ((0, 4), (4, 9))]
    assert np.allclose(whole, (parts[0][:, :, None] + parts[1][None]).max(axis=1))


def test_search(spark):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(900, [0.5] * 6)] * 3
    rows += [(901, None), (902, [float("nan")] * 6), (903, [None] * 6), (None, [0.25] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(topk_search.top_k(table, F.col("vec_id") % 100 == 0, block=64, group=2, pivots=4).select("query_id", "rank", "score").collect())
    good = [(i, np.floor(1024 * np.array(v))) for i, v in rows if v and None not in v and not np.isnan(v).any()]
    want = []
    for q, (i, v) in enumerate(good):
        if i is not None and i % 100 == 0:
            scores = sorted((-int(v @ w) for j, (_, w) in enumerate(good) if j != q))[:10]
            want += [(i, r + 1, -s) for r, s in enumerate(scores)]
    assert [tuple(r) for r in got] == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
