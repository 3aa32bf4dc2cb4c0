"""Token counts and ids of whole texts by a public tokenizer file.

Texts are cut where the tokenizer itself always cuts (white space), each
distinct chunk is handled once per batch, and a bounded cache carries results
from batch to batch.

Counting uses a whole-token shortcut: `whole_tokens` proves, by encoding every
vocabulary string alone, which of them come back as exactly one token. A
pre-token found among them counts 1 without running any merges; only the rest
goes through the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T
from .common import bounded_batches, slices

#: Distinct chunks that a worker remembers, some 150 bytes each.
CACHE = 700_000


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _settings(path: str) -> dict:
    with open(path, encoding="utf-8") as f:  # the vocabulary file, which every machine has
        whole = json.load(f)
    model = {k: v for k, v in whole["model"].items() if k not in ("vocab", "merges")}
    return {"normalizer": whole.get("normalizer"), "pre_tokenizer": whole.get("pre_tokenizer"), "model": model}


def _require(path: str, **expected) -> None:
    """ValueError unless the file splits and normalises as the code that is to read it does."""
    found = _settings(path)
    for key, want in expected.items():
        own = found["model"].get(key) if key in ("type", "end_of_word_suffix", "byte_fallback") else found[key]
        if own != want:
            raise ValueError(f"{path}: {key} is {own!r}; only {want!r} is supported here")


def _byte_level(regex: bool) -> dict:
    return {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": regex}


# Fixed value: the published pre-token pattern of word-end BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[bytes]:
    """The vocabulary strings of a byte-level file that, encoded alone, are one token. Bounded by the vocabulary."""
    tokenizer, chars = _load(path), _byte_chars()
    texts = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(chars[c] for c in piece).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t.encode() for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1)


def _strings(distinct: pa.Array) -> list[bytes]:
    return distinct.to_pylist()


def _mapped(piece: str, table: dict[int, str]) -> str:
    """A pre-token as the merges see it: each of its UTF-8 bytes as its stand-in."""
    return piece.encode().decode("latin-1").translate(table)


class Counter:
    """Number of tokens of chunks; for byte-level files that split text as the GPT-2 pattern does."""

    def __init__(self, path: str, proven: frozenset[bytes] | None = None):
        import regex

        _require(path, type="BPE", normalizer=None, pre_tokenizer=_byte_level(True), end_of_word_suffix=None, byte_fallback=False)
        self.tokenizer = _load(path)
        self.merge = self.tokenizer.model.tokenize
        self.table = {b: c for c, b in _byte_chars().items()}
        self.proven = whole_tokens(path) if proven is None else proven
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Fixed value: the published pre-token pattern of byte-level BPE.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.known: dict[bytes, int] = {}
        self.merged: dict[bytes, int] = {}

    def chunk(self, raw: bytes) -> int:
        whole = raw.decode("utf-8", "replace")
        if "<" in whole and any(s in whole for s in self.special):  # the library finds these before it splits
            return len(self.tokenizer.encode(whole, add_special_tokens=False).ids)
        total = 0
        for piece in self.split(whole):
            key = piece.encode()
            if key in self.proven:
                total += 1
                continue
            n = self.merged.get(key)
            if n is None:
                n = self.merged[key] = len(self.merge(_mapped(piece, self.table)))
            total += n
        return total

    def __call__(self, distinct: list[bytes]) -> np.ndarray:
        for cache in (self.known, self.merged):
            if len(cache) > CACHE:
                cache.clear()
        known, proven = self.known, self.proven
        out = np.ones(len(distinct), dtype=np.int64)
        for i, raw in enumerate(distinct):
            if raw not in proven:
                n = known.get(raw)
                if n is None:
                    n = known[raw] = self.chunk(raw)
                out[i] = n
        return out


class Encoder:
    """Token ids of chunks; for files that lower-case, drop white space and mark word ends."""

    def __init__(self, path: str):
        import regex

        steps = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        _require(path, type="BPE", normalizer={"type": "Sequence", "normalizers": steps}, pre_tokenizer={"type": "Sequence", "pretokenizers": [split, _byte_level(False)]}, end_of_word_suffix="</w>", byte_fallback=False)
        self.tokenizer = _load(path)
        self.merge = self.tokenizer.model.tokenize
        self.table = {b: c for c, b in _byte_chars().items()}
        # Characters that normalisation leaves alone but for case; all other chunks go through the library whole.
        self.plain = regex.compile("[\x21-\x3b\x3d-\x7e\u00c0-\u00ff]+").fullmatch
        self.split = regex.compile(WORD_PATTERN).findall
        self.known: dict[bytes, bytes] = {}
        self.merged: dict[str, list[int]] = {}

    def chunk(self, raw: bytes) -> bytes:
        whole = raw.decode("utf-8", "replace")
        if not self.plain(whole):
            ids = self.tokenizer.encode(whole, add_special_tokens=False).ids
        else:
            ids = []
            for piece in self.split(whole.lower()):
                own = self.merged.get(piece)
                if own is None:
                    own = self.merged[piece] = [t.id for t in self.merge(_mapped(piece, self.table))]
                ids += own
        return np.array(ids, "<u4").tobytes()

    def __call__(self, distinct: list[bytes]) -> list[bytes]:
        for cache in (self.known, self.merged):
            if len(cache) > CACHE:
                cache.clear()
        known, out = self.known, []
        for raw in distinct:
            ids = known.get(raw)
            if ids is None:
                ids = known[raw] = self.chunk(raw)
            out.append(ids)
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and where each text's begin (one more at the end)."""
        codes, distinct, at = T.words(*T.flat(texts))
        lists = self(_strings(distinct))
        lengths = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        pool = np.frombuffer(b"".join(lists), "<u4")
        starts = np.cumsum(lengths) - lengths
        ends = np.concatenate(([0], np.cumsum(lengths[codes])))
        return pool[T.spread(codes, starts, lengths)], ends[at]


@lru_cache(maxsize=2)
def counter_of(path: str, proven: frozenset[bytes] | None = None) -> Counter:
    """One per worker process, so that its cache outlives a task."""
    return Counter(path, proven)


def count_tokens(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens. Null ids stay null. Repeated
    rows give repeated rows; other columns are not read. An empty table gives
    an empty one.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    Counter(path, frozenset())  # refuses a file of another kind here rather than on the executors
    proven = spark.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, proven.value)
        for batch in batches:
            for part in slices(batch, 1):
                data, offsets = T.flat(part.column(1))
                codes, distinct, at = T.chunks(data, offsets)
                ends = np.concatenate(([0], np.cumsum(counter(_strings(distinct))[codes])))
                n = ends[at[1:]] - ends[at[:-1]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(n.astype(np.int64)), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
