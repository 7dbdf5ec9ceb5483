"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. A round looks every adjacent pair up by binary search
in the sorted pair keys, takes the lowest rank of each word, merges all its occurrences from the left at once and
drops the words that have no mergeable pair left. Words seen before come from a bounded per-worker table. Decoding
gathers the tokens' bytes for whole batches.

Defined results: a null text is the empty text (no ids, hash of nothing); the end-of-text string inside a text is its
special id; rows that repeat are encoded each; other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import byte_slices, string_sizes, whole

SLICE_BYTES = 4 << 20
SHIFT = np.int64(20)
NONE = np.int64(1) << np.int64(40)
# The pre-tokenizer's fixed pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0] .. starts[0]+lengths[0]-1, starts[1] .., in one array."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Vocabulary:
    LIMIT = 600_000

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocab: dict[str, int] = content["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        letters = byte_letters()
        number = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = np.array([vocab[letter] for letter in letters], np.int64)
        keys = np.array([(vocab[a] << int(SHIFT)) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(number[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.token_len = np.fromiter(map(len, spelled), np.int64, size)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.decimal = [str(i) for i in range(size)]
        self.find_words = regex.compile(WORDS).findall
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.reset()

    def reset(self) -> None:
        """An empty word table; the special strings are words of one id."""
        self.numbers: dict[str, int] = {}
        self.pool = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids per word)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            last = np.r_[word[1:] != word[:-1], True]
            key = (symbols << SHIFT) | np.r_[symbols[1:], 0]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & ~last, self.ranks[at], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[first, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, first), counts)
            over = lowest == NONE
            if over.any():
                done.append((word[over], symbols[over]))
            take = (rank == lowest) & ~over
            # Neighbours that overlap (the pair of a symbol with itself): every second one, from the left.
            begins = take & ~np.r_[False, take[:-1]]
            run = np.maximum.accumulate(np.where(begins, np.arange(len(take)), 0))
            take &= (np.arange(len(take)) - run) % 2 == 0
            symbols = np.where(take, self.merged[at], symbols)
            keep = ~over & ~np.r_[False, take[:-1]]
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(raw), np.int64)
        word = np.concatenate([w for w, _ in done])
        ids = np.concatenate([s for _, s in done])[np.argsort(word, kind="stable")]
        return ids, np.bincount(word, minlength=len(raw))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text)."""
        if len(self.numbers) > self.LIMIT:
            self.reset()
        fresh: list[str] = []
        numbers = self.numbers
        used: list[int] = []
        sizes = []
        for text in texts:
            before = len(used)
            parts = self.find_special(text) if self.find_special and any(s in text for s in self.special) else [text]
            for part in parts:
                for w in [part] if part in self.special else self.find_words(part):
                    n = numbers.get(w)
                    if n is None:
                        n = numbers[w] = len(numbers)
                        fresh.append(w)
                    used.append(n)
            sizes.append(len(used) - before)
        if fresh:
            ids, lengths = self.merge(["" if w in self.special else w for w in fresh])
            for i, w in enumerate(fresh):
                if w in self.special:
                    ids = np.insert(ids, int(lengths[:i].sum()), self.special[w])
                    lengths[i] = 1
            self.starts = np.r_[self.starts, len(self.pool) + np.cumsum(lengths) - lengths]
            self.lengths = np.r_[self.lengths, lengths]
            self.pool = np.r_[self.pool, ids]
        used = np.array(used, np.int64)
        ids = self.pool[spread(self.starts[used], self.lengths[used])]
        edges = np.r_[0, np.cumsum(self.lengths[used])][np.r_[0, np.cumsum(sizes)].astype(np.int64)]
        return ids, np.diff(edges)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of id sequences that lie in a row."""
        lengths = self.token_len[ids]
        flat = self.token_bytes[spread(self.token_start[ids], lengths)].tobytes()
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)].astype(np.int64)].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker, with its word table."""
    return Vocabulary(path)


def _digests(path: str, with_ids: bool):
    def digests(batches):
        known = vocabulary(path)
        for batch in batches:
            column = batch.column("text")
            for start, stop in byte_slices(string_sizes(column), SLICE_BYTES):
                ids, counts = known.encode(column.slice(start, stop - start).to_pylist())
                texts = known.decode(ids, counts)
                listed, ends = ids.tolist(), np.r_[0, np.cumsum(counts)].tolist()
                shas = [hashlib.sha256(",".join([known.decimal[i] for i in listed[a:b]]).encode()).hexdigest()
                        for a, b in zip(ends, ends[1:])]
                columns = [batch.column("doc_id").slice(start, stop - start), pa.array(counts.astype(np.int64)), pa.array(shas, pa.string()),
                           pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return digests


def encoded(docs: DataFrame, path: str, with_ids: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids and the decoded text."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return body.mapInArrow(_digests(path, with_ids), schema + (", ids array<long>, decoded string" if with_ids else ""))
