"""What a worker holds stays bounded whatever the size of an Arrow batch, and the results do not depend on the slices."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from epochlens.catalog.samples import build_zip
from epochlens.formats import pdf, zip as za
from epochlens.functions.batches import batch_slices, row_slices, value_bytes
from epochlens.functions.text import text_scores, utf8_errors
from epochlens.operators.delta import delta_blocks
from epochlens.operators.scan import ScanConfig, extent_metrics, scan_content, suspicious_regions

MB = 1 << 20
rng = np.random.default_rng(7)


class Frame:
    """Stands in for a DataFrame and hands out the function that its batches go through."""
    schema = {"k": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

    def select(self, *_):
        return self

    def mapInArrow(self, fn, _):
        return fn


def extents(n: int) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("block_id", pa.int64()), ("old", pa.binary()), ("new", pa.binary())]))
    rows = [[{"block_id": 8 * i + k, "old": bytes(512), "new": rng.bytes(512)} for k in (0, 1, 2, 5)] for i in range(n)]
    return pa.RecordBatch.from_pydict({"extent_id": pa.array(range(n), pa.int64()), "members": pa.array(rows, kind)})


def contents(n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array(range(n), pa.int64()), "c": pa.array([rng.bytes(2048) for _ in range(n)], pa.binary())})


def texts(n: int) -> pa.RecordBatch:
    files = [b"%%PDF-1.4\n%d 0 obj\n<< /Length 4 >>\nstream\nabcd\nendstream\nendobj\n%%%%EOF" % i + b" " * 2000 for i in range(n)]
    return pa.RecordBatch.from_pydict({"file_path": pa.array([f"/s/{i}.pdf" for i in range(n)]), "content": pa.array(files, pa.binary())})


def archives(n: int) -> pa.RecordBatch:
    files = [build_zip([("a.bin", rng.bytes(2500), 0)]) for _ in range(n)]
    return pa.RecordBatch.from_pydict({"file_path": pa.array([f"/s/{i}.zip" for i in range(n)]), "content": pa.array(files, pa.binary())})


CASES = {
    "delta_blocks": (lambda: delta_blocks(Frame()), extents),
    "detect_regions_fixed": (lambda: suspicious_regions(Frame(), ScanConfig(expand=False)), extents),
    "extent_metrics": (lambda: extent_metrics(Frame(), ScanConfig(expand=False)), extents),
    "fixed_scan": (lambda: scan_content(Frame(), "k", "c", ScanConfig(expand=False)), contents),
    "pdf_whitelist": (lambda: pdf.pieces(Frame()), texts),
    "zip_decisions": (lambda: za.members(Frame()), archives),
}


def plain(batches) -> list[tuple]:
    rows = [row for b in batches for row in b.to_pylist()]
    return [tuple(str(v) for k, v in row.items() if not k.endswith("_seconds")) for row in rows]


@pytest.mark.parametrize("name", CASES)
def test_batch_functions_hold_a_slice(name):
    make, rows = CASES[name]
    run = make()
    few = rows(40)
    assert plain(run([few])) == plain(b for i in range(40) for b in run([few.slice(i, 1)]))
    batch = rows(8000 if rows in (texts, archives) else 1500)
    tracemalloc.start()
    for _ in run([batch]):
        pass
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < {texts: 5, archives: 14}.get(rows, 60) * MB


@pytest.mark.parametrize("score", [utf8_errors, text_scores])
def test_text_scores_hold_a_slice(score):
    raw = [bytes(r) for r in (b"plain text \xff" * 170, "äöü€𝄞".encode() * 100, b"", rng.bytes(1500))] * 2000
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    score(data, off[:5])
    tracemalloc.start()
    got = score(data, off)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [int(score(data, off[i: i + 2])[0]) for i in range(4)] * 2000
    assert held < 100 * MB
    assert score(data, off[:1]).tolist() == []


def test_slices_keep_every_row():
    batch = extents(50).slice(3, 40)
    assert value_bytes(batch.column("members")).tolist() == [4 * (512 + 512 + 8)] * 40
    parts = list(batch_slices(batch, 10_000))
    assert [p.num_rows for p in parts] == [2] * 20 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(row_slices(np.array([5, 50, 0, 5, 5]), 10)) == [(0, 1), (1, 2), (2, 5)]
    assert list(row_slices(np.zeros(10, int), 10, rows=4)) == [(0, 4), (4, 8), (8, 10)] and list(row_slices(np.zeros(0, int))) == []
