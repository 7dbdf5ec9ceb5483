"""Token counts: batches of an Arrow column are encoded and only the lengths are returned.

Batches are balanced by bytes. Texts are split at safe boundaries: before a white-space character that follows another
kind of character. The byte-level pre-tokenizer always starts a token there, so the pieces' tokens are the text's
tokens. Long texts are first cut into parts at such boundaries, then parts into pieces of about a word (also before
punctuation that follows letters). A piece is encoded when it is first met, and a bounded table keeps the ids of short
pieces; pieces that are one pre-token (plain words and numbers) go straight to the library's model. Where the
vocabulary file does not say that this is safe (another pre-tokenizer, a normaliser, a sentencepiece model), whole
texts are encoded.

Defined results: a null text is the empty text (0 bytes, 0 tokens); rows that repeat are counted each; other columns
are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.llm.bpe import byte_letters
from epochlens.llm.common import byte_slices, string_sizes, whole

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 15
# White space as the pre-tokenizer has it: without the four separators that only Python counts.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
BOUNDARY = re.compile(f"(?<={OTHER})(?={SPACE})")
# A run of letters ends a pre-token where ASCII punctuation follows.
LETTER, MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-/:-@\[-`{-~]"
# The first case is the common one, found in one pass; the second would cut it the same way.
PIECES = re.compile(f" ?+{LETTER}++(?={MARK}|{SPACE}|\\Z)|{SPACE}*+(?:{LETTER}++(?={MARK})|{OTHER}++)|{SPACE}+")
# Pieces that the pre-tokenizer leaves whole. No added token is part of one: all begin with punctuation.
SINGLE = re.compile(f" ?(?:{LETTER}+|[0-9]+)")
LETTERS = str.maketrans(dict(enumerate(byte_letters())))


def splits_safely(path: str) -> bool:
    """Whether the tokens of the pieces are the tokens of the text: plain byte-level pre-tokens, and no added token
    that holds or takes in white space, asks for word borders or begins with anything but ASCII punctuation."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    first = content.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    return bool(plain) and not content.get("normalizer") and not any(
        t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) or not re.match(MARK, t["content"])
        for t in content.get("added_tokens") or [])


class PieceTable(dict):
    """Ids of texts by their pieces, as little-endian 32-bit numbers in bytes. Entries not used while a generation of
    ``ENTRIES`` new or used ones came in are forgotten, so frequent pieces stay however many rare ones pass."""
    ENTRIES, LONGEST = 250_000, 48

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        short = len(piece) <= self.LONGEST
        found = self.older.get(piece)
        if found is None:
            if short and SINGLE.fullmatch(piece):
                plain = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(LETTERS)
                ids = [t.id for t in self.model.tokenize(plain)]
            else:
                ids = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        if short:
            self[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = []
        for text in texts:
            ids = []
            for part in safe_pieces(text):
                if len(self) > self.ENTRIES:
                    self.older = dict(self)
                    self.clear()
                ids.append(b"".join(map(self.__getitem__, PIECES.findall(part))))
            found.append(np.frombuffer(b"".join(ids), "<u4"))
        return found


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """texts -> id sequences, for one worker. Threads stay off: Spark already uses every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode_batch(texts):
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return PieceTable(tokenizer).encode if splits_safely(path) else encode_batch


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """The text cut at the first safe boundary after every ``limit`` characters."""
    pieces, start = [], 0
    while len(text) - start > limit:
        cut = BOUNDARY.search(text, start + limit)
        if cut is None:
            break
        pieces.append(text[start:cut.start()])
        start = cut.start()
    return [*pieces, text[start:]]


def _lengths(path: str):
    def lengths(batches):
        encode = encoder(path)
        for batch in batches:
            sizes = string_sizes(batch.column("text"))
            counts = [len(ids) for start, stop in byte_slices(sizes, BATCH_BYTES)
                      for ids in encode(batch.column("text").slice(start, stop - start).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
    return lengths


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    return body.mapInArrow(_lengths(path), "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
