"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; the symbols of many pre-tokens lie in one flat
array.  In every round each sequence finds its lowest-ranked adjacent pair and
all sequences apply theirs at once, at all its places from the left; a sequence
without a mergeable pair leaves with its number of symbols.  Pre-tokens recur,
so a task remembers the counts of short ones.

The vocabulary is a byte-level BPE file with word ends, lower case and white
space dropped.  Its special strings inside a text are one token each, as the
library that reads such files does by default.

Defined results: a null text counts as an empty one, with 0 tokens; a very long
text is counted whole, as a piece of its own; null ids, repeated rows and extra
columns, whatever their names, do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamframe.llm import kernels as K

#: Unicode white space; fixed values.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Pre-tokens of the vocabulary file's split rule; fixed pattern.
#: Steps of normalizer and pre-tokenizer, and the pattern of words, that counts follow; fixed values of the file format.
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+")

#: Remembered pre-tokens in a task, and the longest that is remembered.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Characters of texts, and bytes of pre-tokens, that are worked on at once.
PIECE_CHARS, ROUND_BYTES = 1 << 20, 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Merges as sorted pair keys with rank and product; first symbols of bytes inside and at the end of a word."""

    size: int
    keys: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    specials: tuple[str, ...]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def _steps(part: dict | None, name: str) -> list[dict]:
    return [] if part is None else part[name] if part["type"] == "Sequence" else [part]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a vocabulary file on the driver; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    steps = [n["type"] for n in _steps(spec["normalizer"], "normalizers")], [p["type"] for p in _steps(spec["pre_tokenizer"], "pretokenizers")]
    split = next((p["pattern"].get("Regex") for p in _steps(spec["pre_tokenizer"], "pretokenizers") if p["type"] == "Split"), None)
    if model["type"] != "BPE" or steps != STEPS or split != SPLIT:
        raise ValueError(f"{path}: only byte-level pair encoding with the steps {STEPS} and words split at {SPLIT} is counted here")
    ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
    size = max(ids.values()) + 1
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([ids[a] * size + ids[b] for a, b in pairs], dtype=np.int64)
    products = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys)
    letters = byte_letters()
    return Vocabulary(
        size,
        keys[order],
        order.astype(np.int64),
        products[order],
        np.array([ids[c] for c in letters], dtype=np.int64),
        np.array([ids[c + suffix] for c in letters], dtype=np.int64),
        tuple(t["content"] for t in spec["added_tokens"]),
    )


def merged_lengths(words: list[bytes], vocab: Vocabulary) -> np.ndarray:
    """Symbols that remain of each non-empty word after all merges."""
    lens = np.array([len(w) for w in words], dtype=np.int64)
    out = lens.copy()
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    sym = vocab.inner[raw]
    ends = np.cumsum(lens) - 1
    sym[ends] = vocab.final[raw[ends]]
    seq = np.repeat(np.arange(len(words)), lens)
    none = np.int64(1) << 40
    while len(sym):
        key = sym[:-1] * vocab.size + sym[1:]
        at = np.minimum(np.searchsorted(vocab.keys, key), len(vocab.keys) - 1)
        rank = np.full(len(sym), none)
        rank[:-1] = np.where((vocab.keys[at] == key) & (seq[:-1] == seq[1:]), vocab.ranks[at], none)
        starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        sizes = np.diff(np.append(starts, len(seq)))
        lowest = np.minimum.reduceat(rank, starts)
        out[seq[starts]] = sizes
        going = np.repeat(lowest < none, sizes)
        chosen = (rank == np.repeat(lowest, sizes)) & going
        # of overlapping places of one pair, as in a run of equal symbols, every other one is merged, from the left
        places = np.flatnonzero(chosen)
        run = np.concatenate(([True], places[1:] != places[:-1] + 1)) if len(places) else np.zeros(0, dtype=bool)
        first = places[run][np.cumsum(run) - 1] if len(places) else places
        places = places[(places - first) % 2 == 0]
        sym[places] = vocab.products[at[places]]
        going[places + 1] = False
        sym, seq = sym[going], seq[going]
    return out


def lower(text: str) -> str:
    """Composed and lower-cased letter by letter, without the rule for a final sigma."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Counter:
    """Counts tokens of texts, with a bounded memory of pre-tokens."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, int] = {}
        specials = sorted(vocab.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of its special strings."""
        if self.special is None or not self.special.search(text):
            return PRE_TOKEN.findall(lower(text)), 0
        parts = self.special.split(text)
        return [w for part in parts for w in PRE_TOKEN.findall(lower(part))], len(parts) - 1

    def learn(self, words: list[str]) -> dict[str, int]:
        found: dict[str, int] = {}
        i = 0
        while i < len(words):
            some, size = [], 0
            while i < len(words) and (not some or size < ROUND_BYTES):
                some.append(words[i].encode())
                size += len(some[-1])
                i += 1
            found.update(zip(words[i - len(some) : i], merged_lengths(some, self.vocab).tolist(), strict=True))
        return found

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pre_tokens(t) for t in texts]
        new = list({w for words, _ in cut for w in words} - self.known.keys())
        found = self.learn(new)
        rare = {w: n for w, n in found.items() if len(w) > CACHE_CHARS}
        if len(self.known) + len(found) > CACHE_WORDS:
            rare, self.known = {**self.known, **found}, {}
        else:
            self.known.update((w, n) for w, n in found.items() if w not in rare)
        known = self.known
        if rare:
            return [n + sum(rare[w] if w in rare else known[w] for w in words) for words, n in cut]
        return [n + sum(map(known.__getitem__, words)) for words, n in cut]


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, n_bytes, n_tokens and over_limit (more than limit tokens)."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            rows = batch.num_rows
            i = 0
            while i < rows:
                texts, size, j = [], 0, i
                while j < rows and (j == i or size < PIECE_CHARS):
                    texts.append(batch.column(1)[j].as_py() or "")
                    size += len(texts[-1])
                    j += 1
                n = np.array(counter.count(texts), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )
                i = j

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return K.in_batches(rows, count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
