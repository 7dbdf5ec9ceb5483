"""The whole pipeline on planted documents: every stage against a plain version of it."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from epochlens.llm import packing, queries, toxicity
from epochlens.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VALUES = {"mail": "ann.92@mail2.example.com", "card": "4539578763621486", "iban": "DE89 3704 0044 0532 0130 00", "ip": "97.51.17.173"}


def planted():
    draw = random.Random(11)
    vocabulary = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(900)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(20, 120))) for _ in range(90)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, f"{texts[i]} you are a stupid idiot. you worthless moron. i will kill you.") for i in range(30)]
    rows += [(200 + i, texts[40 + i % 4]) for i in range(25)]  # exact copies
    for i in range(20):  # near copies: one word changed in a long text
        words = texts[60].split() + texts[61].split() + texts[62].split()
        words[i * 3] = "changed"
        rows.append((300 + i, " ".join(words)))
    rows += [(400 + i, f"{texts[70 + i]} {v} end") for i, v in enumerate(VALUES.values())]
    rows += [(500, None), (501, ""), (502, ""), (None, "no id at all"), (503, "twice"), (503, "twice"), (504, "long " * 9000)]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("planted")
    rows = [(i, t, "en", "web", len(t or "")) for i, t in planted()]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(100 <= i < 130)) for i in [*range(40), *range(100, 130)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """(name, input rows, output rows) of every stage, each written and read again as ``run`` does."""
    out, docs, found = tmp_path_factory.mktemp("stages"), table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{out}/{name}")
        after = spark.read.parquet(f"{out}/{name}")
        found.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in found}


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stage_order_and_columns(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_stage(spark, folder, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, table(spark, folder, "labels"), usable=~queries.held_out())
    matcher, want = toxicity.Matcher(model.learned), Counter()
    for (doc_id, text), n in pairs(before).items():
        words, hits = matcher.clauses(text or "")
        z = float(np.dot(toxicity.features(words, [s for s, _ in hits]), model.weights))
        if 1 / (1 + np.exp(-z)) < 0.5:
            want[doc_id, text] = n
    assert pairs(after) == want
    left = {i for i, _ in want}
    assert not left & set(range(100, 130)) and left >= set(range(90)) | set(range(200, 225)) | {500, 501, None}


def test_exact_stage(stages):
    before, after = stages["exact_dedup"]
    groups = defaultdict(list)
    for (doc_id, text), n in pairs(before).items():
        groups[text or ""] += [(doc_id, text)] * n
    kept = pairs(after)
    assert sum(kept.values()) == len(groups)
    for text, rows in groups.items():
        top = max((i for i, _ in rows if i is not None), default=None)
        assert any((top, t) in kept for i, t in rows if i == top)


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    rows = list(pairs(before).elements())
    bags = []
    for _, text in rows:
        words = (text or "").lower().split()
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
    for i, row in enumerate(rows):
        classes[root(i)].append(row)
    want = Counter(max(own, key=lambda r: (r[0] is not None, r[0] or 0)) for own in classes.values())
    assert pairs(after) == want and sum(300 <= (i or 0) < 320 for i, _ in want) == 1


def test_pii_stage(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages["pii"])
    assert set(before) == set(after)
    carriers = {400 + i: v for i, v in enumerate(VALUES.values())}
    for doc_id, row in after.items():
        if doc_id in carriers:
            assert carriers[doc_id] not in row.text and row.text.startswith(before[doc_id].text.split(carriers[doc_id])[0])
        else:
            assert row.text == before[doc_id].text
        assert row.n_chars == (None if row.text is None else len(row.text))


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    before, after = stages["packing"]
    sizes = Counter()
    for (doc_id, text), n in pairs(before).items():
        sizes[doc_id] += n * (len(library.encode(text or "", add_special_tokens=False).ids) + 1)
    pieces = after.toPandas()
    got = Counter()
    for doc_id, length in zip(pieces.doc_id, pieces.length):
        got[None if doc_id != doc_id else int(doc_id)] += int(length)
    assert got == sizes
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        ends = own.length.cumsum().tolist()
        assert ends[-1] <= 2048 and own.offset.tolist() == [0, *ends[:-1]]
    assert pieces.sequence_id.nunique() == packing.lower_bound(Counter(pieces.length.tolist()), 2048)


def test_run_gives_the_last_stage(spark, folder, stages):
    shape = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert shape(corpus_pipeline.run(spark, folder)) == shape(stages["packing"][1])


def test_run_on_an_empty_table(spark, folder, tmp_path):
    table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, folder, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_values_are_left_alone(stages):
    _, after = stages["pii"]
    assert not [r for r in after.collect() if r.text and re.search(r"idiot|moron", r.text)]
    assert after.agg(F.count("*")).first()[0] > 90
