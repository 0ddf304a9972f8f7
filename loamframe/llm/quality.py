"""Quality rules as a short-circuit cascade.

Every rule decides "reject" from one text.  The base figures of a text are always
computed.  On a bounded sample of documents each rule's cost beyond them and its
rejections among the texts that pass the base rule are measured; the rules then
run in the order of rejections per second, and a rule sees only the documents that
the base rule and all earlier rules have passed.  What is known of a text is kept
for later rules.  The verdict is the conjunction of all rules, so it is the same
for any order; only the name of the first failed rule and the time depend on it.

Defined results: a null or empty text has no words and fails the base rule; a very
long text is judged whole, as a piece of its own; null ids, repeated rows and ties
are judged row by row; an empty table gives an empty result; columns other than the
id and the text, whatever their names, are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamframe.llm import kernels as K

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_IS_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123))
_IS_SHOUT = np.isin(np.arange(256), list(b"!?"))
_IS_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)

#: Rows on which costs and selectivities are measured.
SAMPLE_ROWS = 2000
MIN_WORDS = 50
#: Repeated lines below which the share of repeated lines does not count.
LEAST_DUP_LINES = 3


def per_text(compute: Callable[[Texts], np.ndarray]) -> cached_property:
    """A figure for each text, computed when first asked for; a subset takes it from the whole where that has it."""
    name = compute.__name__

    def figure(self: Texts) -> np.ndarray:
        return getattr(self.whole, name)[self.rows] if self.inherits(name) else compute(self)

    return cached_property(figure)


class Texts:
    """A piece of a text column with its features, each computed when first asked for."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n, self.whole, self.rows = buf, offs, len(offs) - 1, None, None

    def subset(self, rows: np.ndarray) -> Texts:
        """Some of the texts; their bytes are gathered only for features that are not known yet."""
        out = Texts.__new__(Texts)
        out.whole, out.rows, out.n = self, rows, len(rows)
        out.offs = np.concatenate(([0], np.cumsum(np.diff(self.offs)[rows])))
        return out

    def knows(self, name: str) -> bool:
        return name in self.__dict__ or self.inherits(name)

    def inherits(self, name: str) -> bool:
        return self.whole is not None and self.whole.knows(name)

    def own_spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans of the whole, given by their rows, are of this subset, and their rows here."""
        new = np.full(self.whole.n, -1, dtype=np.int64)
        new[self.rows] = np.arange(self.n)
        new = new[rows]
        return new >= 0, new[new >= 0]

    def moved(self, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans (starts, ends, rows) of the whole that are of this subset, by its own bytes."""
        starts, ends, rows = spans
        own, new = self.own_spans(rows)
        shift = self.offs[new] - self.whole.offs[rows[own]]
        return starts[own] + shift, ends[own] + shift, new

    @cached_property
    def buf(self) -> np.ndarray:
        whole = self.whole
        return np.concatenate([np.zeros(0, np.uint8), *(whole.buf[whole.offs[i] : whole.offs[i + 1]] for i in self.rows)])

    def byte_counts(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text for which table is true."""
        total = np.concatenate(([0], np.cumsum(table[self.buf])))
        return total[self.offs[1:]] - total[self.offs[:-1]]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.moved(self.whole.words) if self.inherits("words") else K.word_bounds(self.buf, self.offs)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        if self.inherits("word_hashes"):
            return self.whole.word_hashes[self.own_spans(self.whole.words[2])[0]]
        return K.span_hashes(self.buf, *self.words[:2])

    @per_text
    def n_words(self) -> np.ndarray:
        return K.counts_by_row(self.words[2], self.n)

    @per_text
    def word_chars(self) -> np.ndarray:
        table = (np.arange(256) & 0xC0 != 0x80) & ~K.IS_SPACE
        return self.byte_counts(table)

    @per_text
    def n_symbols(self) -> np.ndarray:
        return self.byte_counts(_IS_SYMBOL)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds and rows of the lines that have a word."""
        if self.inherits("lines"):
            return self.moved(self.whole.lines)
        starts, ends, rows = K.word_bounds(self.buf, self.offs, self.buf != 10)
        total = np.concatenate(([0], np.cumsum(~K.IS_SPACE[self.buf])))
        full = total[ends] > total[starts]
        return starts[full], ends[full], rows[full]

    @per_text
    def n_lines(self) -> np.ndarray:
        return K.counts_by_row(self.lines[2], self.n)

    @per_text
    def n_dup_lines(self) -> np.ndarray:
        starts, ends, rows = self.lines
        key = K.mix(K.span_hashes(self.buf, starts, ends) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.unique(key, return_index=True)[1]
        return K.counts_by_row(rows, self.n) - K.counts_by_row(rows[first], self.n)

    @per_text
    def n_repeat_words(self) -> np.ndarray:
        rows = self.words[2]
        h, at = K.window_hashes(self.word_hashes, rows, 3)
        key = K.mix(h + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(rows), dtype=bool)
        for k in range(3):
            covered[at[twice] + k] = True
        return K.counts_by_row(rows[covered], self.n)

    @per_text
    def top_word_count(self) -> np.ndarray:
        """Occurrences of each text's most frequent word."""
        rows = self.words[2]
        key = K.mix(self.word_hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        out = np.zeros(self.n, dtype=np.int64)
        np.maximum.at(out, rows[first], count)
        return out


@dataclass(frozen=True)
class Rule:
    """fails: one boolean per text, true where the text is to be rejected."""

    name: str
    fails: Callable[[Texts], np.ndarray]


def ratio_above(part: Callable[[Texts], np.ndarray], whole: Callable[[Texts], np.ndarray], most: float) -> Callable[[Texts], np.ndarray]:
    return lambda t: part(t) > most * whole(t)


def repeats_lines(t: Texts) -> np.ndarray:
    """A text that repeats a line or two passes, however short it is."""
    return (t.n_dup_lines >= LEAST_DUP_LINES) & (t.n_dup_lines > 0.3 * t.n_lines)


DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("symbols_per_word", ratio_above(lambda t: t.n_symbols, lambda t: t.n_words, 0.1)),
    Rule("repeated_lines", repeats_lines),
    Rule("repeated_windows", ratio_above(lambda t: t.n_repeat_words, lambda t: t.n_words, 0.45)),
    Rule("upper_case", ratio_above(lambda t: t.byte_counts(_IS_UPPER), lambda t: t.byte_counts(_IS_LETTER), 0.4)),
    Rule("shouting", ratio_above(lambda t: t.byte_counts(_IS_SHOUT), lambda t: t.n_words, 0.3)),
    Rule("digits", ratio_above(lambda t: t.byte_counts(_IS_DIGIT), lambda t: t.word_chars, 0.3)),
    Rule("mean_word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)),
    Rule("one_word_dominates", ratio_above(lambda t: t.top_word_count, lambda t: t.n_words, 0.25)),
)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, failed_rule string"
)


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < MIN_WORDS) | (100 * t.n_repeat_words > 50 * t.n_words)


def base_figures(t: Texts) -> list[np.ndarray]:
    return [t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words]


def cascade(t: Texts, rules: Sequence[Rule], alive: np.ndarray) -> np.ndarray:
    """Index of the first rule that rejects each text, -1 where none does; only rows of alive are judged."""
    failed = np.full(t.n, -1, dtype=np.int64)
    rows = np.flatnonzero(alive)
    left = t.subset(rows) if len(rows) < t.n else t
    for k, rule in enumerate(rules):
        if not len(rows):
            break
        out = rule.fails(left)
        if out.any():
            failed[rows[out]] = k
            rows, left = rows[~out], left.subset(np.flatnonzero(~out))
    return failed


def estimate(df: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """One row per rule, in the order to run them: seconds, tried, rejected on a sample of about sample_rows rows.

    The sample is drawn by a hash of the id.  A rule is timed on the texts that pass
    the base rule, with the base figures known and no other rule's features.
    """
    rules = tuple(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, tried = np.zeros(len(rules)), np.zeros(len(rules), dtype=np.int64), 0
        for batch in batches:
            for _, _, buf, offs in K.pieces(batch.column(0)):
                t = Texts(buf, offs)
                base_figures(t)
                passed = np.flatnonzero(~base_failed(t))
                tried += len(passed)
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[k] += int(rule.fails(t.subset(passed)).sum())
                    seconds[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected), pa.array([tried] * len(rules), pa.int64())],
            names=["rule", "seconds", "rejected", "tried"],
        )

    one_in = max(1, df.count() // max(1, sample_rows))
    sample = df.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(one_in)) == 0).select(F.col(text_col).cast("string").alias("text"))
    sums = (
        K.in_batches(sample, measure, "rule int, seconds double, rejected long, tried long")
        .groupBy("rule")
        .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("tried").alias("tried"))
        .toPandas()  # one row per rule
    )
    sums = sums.set_index("rule").reindex(range(len(rules)), fill_value=0).reset_index()
    sums["name"] = [r.name for r in rules]
    sums["per_second"] = sums["rejected"] / sums["seconds"].clip(lower=1e-9)
    return sums.sort_values(["per_second", "rule"], ascending=[False, True]).reset_index(drop=True)


def apply_rules(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of df: id, base figures, base_failed, kept and the first rule that failed (null if none or base_failed)."""
    order = [int(k) for k in estimate(df, rules, id_col, text_col, sample_rows)["rule"]]
    ordered = tuple(rules[k] for k in order)
    names = np.array([r.name for r in ordered] + [None], dtype=object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in K.pieces(batch.column(1)):
                t = Texts(buf, offs)
                figures = base_figures(t)
                bad = base_failed(t)
                failed = cascade(t, ordered, ~bad)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i)]
                    + [pa.array(x, pa.int64()) for x in figures]
                    + [pa.array(bad), pa.array(~bad & (failed < 0)), pa.array(names[failed], pa.string())],
                    names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return K.in_batches(rows, judge, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
