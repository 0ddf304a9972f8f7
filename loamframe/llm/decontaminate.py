"""Benchmark decontamination by template canonicalisation.

Texts become tokens, runs of letters or numbers; runs of digits that one '.' or ','
joins are one number.  Two channels are searched:
the literal one, lower-cased tokens as they are, and the template one, in which
numbers, number words, units after numbers and names (capitalised words inside a sentence) are
typed placeholders.  Whether a capitalised word that begins a sentence is a name cannot be seen from it, so
template windows with such a word come in two variants, with all of these words as literals and with all of them as names.  Windows of WIDTH tokens of the benchmark are hash-joined
with those of the documents; template windows count only if they hold a
placeholder and at least LEAST_LITERALS literal tokens.  Where WIDTH tokens hold
fewer, the window is widened: to the right up to the next literal token that
makes them enough, at the item's end to the left; an item of fewer literal tokens
in all, but at least one, is one template as a whole.

Matched template windows are aligned by the distance of their positions.  Along
one alignment every slot pairs a benchmark value with a document value, and one
benchmark value has one document value; template windows that hold a value with
several do not count.  Two benchmark values may become the same.

A document leaks an item if, with consistent slots, at least `coverage` of the
item's windows are found in it.  `kind` is verbatim if literal windows alone reach
that, else reparameterised.

Only so many of an item's windows can be missing, so a leaking document holds one
of any larger choice of them.  The windows that the fewest items have are this
choice; documents meet items by these alone, and only such pairs are looked up by
all windows.  So a window common to many items, as a shared instruction, does not
pair each document that has it with each of these items.

Defined results: ids are whole numbers, others stop the job; null and empty texts match nothing; very long texts are searched
whole, each as a piece of its own; an item with fewer than WIDTH tokens is one
window of its own length, and below LEAST_LITERALS tokens it is found only as a
whole document; an item without tokens leaks nowhere; rows with one id, in either
table, count as one; null ids take no part; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamframe.llm import bloom
from loamframe.llm import kernels as K
from loamframe.storage import Scratch, written

WIDTH, LEAST_LITERALS = 5, 3
COVERAGE = 0.5

#: Unit words after a number; fixed values.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "kmh mph hz khz mhz ghz w kw mw v a j kj cal kcal c f k percent pct usd eur gbp dollar dollars cent cents euro euros "
    "pound pounds kilometer kilometers meter meters gram grams kilogram kilograms"
).split()

#: Words that are numbers; fixed values.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
#: Two-byte capitals beyond Latin-1, as (first, last, distance to the small letter): Greek and Cyrillic, then pairs of Latin letters whose capital is even or odd.
CAPITALS = ((0x391, 0x3A9, 32), (0x400, 0x40F, 80), (0x410, 0x42F, 32))
CAPITAL_PAIRS = ((0x100, 0x136, 0), (0x139, 0x147, 1), (0x14A, 0x176, 0), (0x179, 0x17D, 1))

_U = np.uint64
_LITERAL, _TEMPLATE, _WHOLE, _WIDE = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344), _U(0xA4093822299F31D0), _U(0x082EFA98EC4E6C89)
_NUM, _UNIT, _NAME = (K.mix(np.array([x], dtype=np.uint64))[0] for x in (11, 22, 33))
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[list(range(48, 58))] = 2
_MARKS = np.array(list(b".,"), dtype=np.uint8)
_IS_TERM = np.isin(np.arange(256), list(b".!?:;\n"))


def fold(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ASCII, Latin, Greek and Cyrillic letters lower-cased, and where a capital starts; lengths stay."""
    out = K.ASCII_LOWER[buf]
    capital = out != buf
    at = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xD0)) if len(buf) > 1 else np.zeros(0, dtype=np.int64)
    if len(at):
        code = (buf[at].astype(np.int64) & 0x1F) << 6 | (buf[at + 1] & 0x3F)
        small = np.where((code >= 0xC0) & (code <= 0xDE) & (code != 0xD7), code + 32, code)
        for first, last, step in CAPITALS:
            small = np.where((code >= first) & (code <= last), code + step, small)
        for first, last, odd in CAPITAL_PAIRS:
            small = np.where((code >= first) & (code <= last) & (code % 2 == odd), code + 1, small)
        large = small != code
        at, small = at[large], small[large]
        out[at], out[at + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
        capital[at] = True
    return out, capital


class Tokens:
    """Tokens of a piece of texts: row, literal hash, template hash, whether a placeholder stands there and whether a capitalised word begins a sentence."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, units: np.ndarray, numbers: np.ndarray):
        low, capital = fold(buf)
        kind = _CLASS[low]
        if len(low) > 2:
            dash = np.flatnonzero((low[:-2] == 0xE2) & ((low[1:-1] == 0x80) | (low[1:-1] == 0x81)))  # general punctuation
            for k in range(3):
                kind[dash + k] = 0
        self.n = len(offs) - 1
        # letters and digits are bounded apart, then put in order
        a, b = (K.word_bounds(low, offs, kind == c) for c in (1, 2))
        starts = np.concatenate((a[0], b[0]))
        order = np.argsort(starts, kind="stable")
        self.starts, ends = starts[order], np.concatenate((a[1], b[1]))[order]
        self.rows = np.concatenate((a[2], b[2]))[order]
        number = order >= len(a[0])
        self.literal = K.span_hashes(low, self.starts, ends)
        #: of each token, its position in its row among runs of letters or digits
        counts = K.counts_by_row(self.rows, self.n)
        self.run = np.arange(len(order)) - (np.cumsum(counts) - counts)[self.rows]
        # digits joined by one mark are one number
        joined = np.zeros(len(order), dtype=bool)
        joined[1:] = number[1:] & number[:-1] & (self.rows[1:] == self.rows[:-1]) & (self.starts[1:] == ends[:-1] + 1)
        at = np.flatnonzero(joined)
        joined[at] = np.isin(buf[ends[at - 1]], _MARKS)
        if joined.any():
            head = np.flatnonzero(~joined)
            length = np.diff(np.append(head, len(order)))
            rank = np.arange(len(order)) - np.repeat(head, length)
            together = K.mix(np.add.reduceat(self.literal * K.powers(int(length.max()))[rank], head))
            self.literal = np.where(length > 1, together, self.literal[head])
            ends = ends[head + length - 1]
            self.starts, self.rows, self.run, number = (x[head] for x in (self.starts, self.rows, self.run, number))
        m = len(self.rows)
        number = number | np.isin(self.literal, numbers)
        same = np.zeros(m, dtype=bool)
        same[1:] = self.rows[1:] == self.rows[:-1]
        after_number = np.zeros(m, dtype=bool)
        after_number[1:] = number[:-1] & same[1:]
        unit = after_number & ~number & np.isin(self.literal, units) if after_number.any() else after_number
        terms = np.concatenate(([0], np.cumsum(_IS_TERM[buf])))
        inside = same.copy()
        inside[1:] &= terms[self.starts[1:]] == terms[ends[:-1]]
        # a title-case word: a capital, then a letter that is none
        wide = np.where(low[self.starts] >= 0x80, 2, 1) if m else self.starts
        second = np.minimum(self.starts + wide, max(0, len(buf) - 1))
        title = capital[self.starts] & (self.starts + wide < ends) & ~capital[second] if m else same
        name = inside & title & ~number & ~unit
        self.initial = title & ~inside & ~number & ~unit
        self.slot = number | unit | name
        self.template = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, self.literal)))

    def named(self) -> Tokens:
        """The variant in which capitalised words that begin sentences are names."""
        out = copy.copy(self)
        out.slot, out.template = self.slot | self.initial, np.where(self.initial, _NAME, self.template)
        return out

    def with_initial(self, start: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Which windows hold a capitalised word that begins a sentence, so that the variants differ."""
        sums = np.concatenate(([0], np.cumsum(self.initial)))
        return sums[start + width] > sums[start]

    def windows(self, widths: list[int], literal: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
        """(hashes, first tokens, width, template) of each channel and width."""
        slots = np.concatenate(([0], np.cumsum(self.slot)))
        for w in widths:
            h, at = K.window_hashes(self.literal, self.rows, w)
            if literal:
                yield K.mix(h ^ _LITERAL ^ _U(w)), at, w, False
            filled = slots[at + w] - slots[at]
            at = at[(filled > 0) & (w - filled >= LEAST_LITERALS)]
            h = np.zeros(len(at), dtype=np.uint64)
            for k in range(w):
                h = K.mix(h * _U(0x9E3779B97F4A7C15) + self.template[at + k])
            yield K.mix(h ^ _TEMPLATE ^ _U(w)), at, w, True

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: literal tokens before it (and in all), first and end token of its row, end of the window
        widened to the right and first token of the one widened to the left, or -1 where the row is too short."""
        m = len(self.rows)
        literals = np.concatenate(([0], np.cumsum(~self.slot)))
        at = np.concatenate((np.flatnonzero(~self.slot), [-1]))
        counts = K.counts_by_row(self.rows, self.n)
        ends = np.cumsum(counts)[self.rows] if m else self.rows
        firsts = ends - counts[self.rows] if m else self.rows
        k = literals[:m] + LEAST_LITERALS - 1
        right = np.where(k < literals[-1], at[np.minimum(k, len(at) - 1)] + 1, -1)
        k = literals[1:] - LEAST_LITERALS
        left = np.where(k >= 0, at[np.maximum(k, 0)], -1)
        return literals, firsts, ends, np.where(right <= ends, right, -1), np.where(left >= firsts, left, -1)

    def span_templates(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Template hash of windows of any width."""
        m = len(self.rows)
        sums = np.zeros(m + 1, dtype=np.uint64)
        np.cumsum(self.template * K.powers(m + 1)[:m], out=sums[1:])
        return K.mix((sums[at + width] - sums[at]) * K.inverse_powers(m + 1)[at] ^ _WIDE ^ K.mix(width.astype(np.uint64)))

    def wide_windows(self, longest: int, wholes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hashes, first tokens, widths) of widened template windows of at most `longest` tokens, and of windows
        of the given widths that hold too few literal tokens."""
        literals, firsts, ends, right, left = self.spans()
        tokens = np.arange(len(self.rows))
        width = right - tokens
        at = np.flatnonzero((right >= 0) & (width > WIDTH) & (width <= longest))
        yield self.span_templates(at, width[at]), at, width[at]
        width = tokens + 1 - left
        last = np.flatnonzero((left >= 0) & (width > WIDTH) & (width <= longest))
        yield self.span_templates(left[last], width[last]), left[last], width[last]
        for w in wholes:
            at = np.flatnonzero(tokens + w <= ends)
            held = literals[at + w] - literals[at]
            at = at[(held > 0) & (held < min(LEAST_LITERALS, w))]
            yield self.span_templates(at, np.full(len(at), w)), at, np.full(len(at), w)

    def wide_places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose template is too short, with the wider one that stands for each: hashes, tokens where the
        narrow and the wide ones begin, and widths."""
        literals, firsts, ends, right, left = self.spans()
        at = np.arange(len(self.rows))
        own = np.minimum(ends - firsts, WIDTH)
        at = at[(own >= LEAST_LITERALS) & (at + own <= ends)]
        own = own[at]
        held, whole = literals[at + own] - literals[at], literals[ends[at]] - literals[firsts[at]]
        poor = (held < LEAST_LITERALS) & (held < own) & (whole > 0)
        at, whole = at[poor], whole[poor]
        last = left[ends[at] - 1]
        start = np.where(whole < LEAST_LITERALS, firsts[at], np.where(right[at] >= 0, at, last))
        end = np.where((whole >= LEAST_LITERALS) & (right[at] >= 0), right[at], ends[at])
        return self.span_templates(start, end - start), at, start, end - start

    def wholes(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the whole text of rows with 1 to longest tokens, and their first token."""
        counts = K.counts_by_row(self.rows, self.n)
        first = np.cumsum(counts) - counts
        rows = np.flatnonzero((counts > 0) & (counts <= longest))
        h = np.zeros(len(rows), dtype=np.uint64)
        for k in range(longest):
            more = counts[rows] > k
            h[more] = K.mix(h[more] * _U(0x9E3779B97F4A7C15) + self.literal[first[rows[more]] + k])
        return K.mix(h ^ _WHOLE), first[rows]


def word_hashes(words: list[str]) -> np.ndarray:
    text = " ".join(words).encode()
    buf = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = K.word_bounds(buf, np.array([0, len(buf)]))
    return np.sort(K.span_hashes(buf, starts, ends))


WINDOW_SCHEMA = "id long, hash long, run int, pos int, start int, width int, span int, template boolean, n_tokens int, slots array<long>"


def window_rows(texts: DataFrame, widths: list[int], shared: Broadcast | None = None, longest: int = 0, wholes: list[int] | None = None) -> DataFrame:
    """Windows of every text (id, text): hash, position among runs of letters or digits and among tokens, width, channel, the text's tokens and the values in slots (0 elsewhere).

    A text of fewer than LEAST_LITERALS tokens gives itself, with width 0.  A widened
    template begins at `start` and has `span` tokens; for `wholes` None each stands
    at the position and width of its narrow window, else at its own.  With a filter
    only windows that it may hold are given.
    """
    units, numbers = word_hashes(UNITS), word_hashes(NUMBER_WORDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in K.pieces(batch.column(1)):
                t = Tokens(buf, offs, units, numbers)
                n = t.named()
                counts = K.counts_by_row(t.rows, t.n)
                first = np.cumsum(counts) - counts
                ids = batch.column(0).slice(i, j - i)

                def found() -> Iterator[tuple]:  # one list of windows at a time
                    for v in (t, n):
                        for h, at, w, template in v.windows(widths, v is t):
                            yield v, h, at, at, np.full(len(at), w), np.full(len(at), w), template
                        if v is t:
                            h, at = t.wholes(LEAST_LITERALS - 1)
                            yield v, h, at, at, np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64), False
                        if wholes is None:
                            h, at, start, span = v.wide_places()
                            yield v, h, at, start, np.minimum(counts[t.rows[at]], WIDTH), span, True
                        else:
                            for h, at, span in v.wide_windows(longest, wholes):
                                yield v, h, at, at, span, span, True

                for v, h, at, start, width, span, template in found():
                    if v is n:
                        new = t.with_initial(start, span)
                        h, at, start, width, span = (x[new] for x in (h, at, start, width, span))
                    if shared is not None:
                        near = bloom.may_hold(shared.value, h)
                        h, at, start, width, span = (x[near] for x in (h, at, start, width, span))
                    if not len(h):
                        continue
                    row = t.rows[at]
                    if template:
                        each = np.arange(span.sum()) + np.repeat(start - (np.cumsum(span) - span), span)
                        slots = K.ragged(np.where(v.slot[each], t.literal[each].view(np.int64), 0), span, pa.int64())
                    else:
                        slots = pa.nulls(len(at), pa.list_(pa.int64()))
                    places = [(x - first[row]).astype(np.int32) for x in (at, start)]
                    columns = [ids.take(pa.array(row)), h.view(np.int64), t.run[at].astype(np.int32), *places, width.astype(np.int32), span.astype(np.int32), np.full(len(at), template), counts[row].astype(np.int32), slots]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "hash", "run", "pos", "start", "width", "span", "template", "n_tokens", "slots"])

    return K.in_batches(texts.where(F.col("id").isNotNull()), work, WINDOW_SCHEMA)


def seeds(entries: DataFrame, n_item: DataFrame, coverage: float) -> DataFrame:
    """hash, template and item of the windows of which every leak holds one: at each item's places whose windows the fewest items have."""
    spread = entries.groupBy("hash", "template").agg(F.count_distinct("item").alias("items"))
    places = entries.join(spread, ["hash", "template"]).groupBy("item", "item_pos").agg(F.max("items").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "item_pos"))
    enough = F.col("n_item") - F.ceil(F.col("n_item") * coverage - 1e-9) + 1
    chosen = places.withColumn("rank", rank).join(n_item, "item").where(F.col("rank") <= enough).select("item", "item_pos")
    return entries.join(chosen, ["item", "item_pos"]).select("hash", "template", "item").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per leaking pair: id, item id, kind, coverage, n_windows (found) and first_token (in the document, counted in runs of letters or digits).

    The work is done when this is called; the result is a table in the shared folder.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        # an item's windows are as wide as its tokens allow; 0 stands for a whole text
        own = F.when(F.col("n_tokens") < LEAST_LITERALS, 0).otherwise(F.least(F.col("n_tokens"), F.lit(WIDTH)))
        entries = scratch.table(
            window_rows(items, list(range(LEAST_LITERALS, WIDTH + 1)))
            .where(F.col("width") == own)
            .select(F.col("id").alias("item"), "hash", "template", "width", "span", F.col("pos").alias("item_pos"), F.col("start").alias("item_start"), "n_tokens", F.col("slots").alias("item_slots")),
            "entries",
        )
        widths = sorted(r.width for r in entries.select("width").distinct().collect() if r.width)  # three at most
        wide = entries.where(F.col("template") & ((F.col("span") > F.col("width")) | (F.size(F.filter("item_slots", lambda v: v == 0)) < LEAST_LITERALS)))
        lengths = [(r.span, r.whole) for r in wide.select("span", (F.size(F.filter("item_slots", lambda v: v == 0)) < LEAST_LITERALS).alias("whole")).distinct().collect()]
        longest, wholes = max((n for n, whole in lengths if not whole), default=0), sorted(n for n, whole in lengths if whole)
        n_item = entries.where("NOT template").groupBy("item").agg(F.count_distinct("item_pos").alias("n_item"))
        packed = bloom.build(entries, "hash", entries.count())
        found = scratch.table(window_rows(texts, widths, scratch.broadcast(packed), longest, wholes).select("id", "hash", "template", "run", "pos", "slots"), "windows")
        seeded = found.select("id", "hash", "template").join(seeds(entries, n_item, coverage), ["hash", "template"]).select("id", "item").distinct()
        pairs = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p.a != 0)
        aligned = (
            seeded.join(entries, "item")
            .join(found, ["id", "hash", "template"])
            .select("id", "item", (F.col("pos") - F.col("item_start")).alias("shift"), "item_pos", "run", "template", F.coalesce(pairs, F.array().cast("array<struct<a:long,b:long>>")).alias("pairs"))
            .groupBy("id", "item", "shift")
            .agg(
                F.collect_set(F.struct("item_pos", "run", "template", F.transform("pairs", lambda p: p.a).alias("values"))).alias("places"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("pairs"),
            )
        )
        # benchmark values with more than one document value
        later = F.slice("pairs", 2, F.greatest(F.size("pairs") - 1, F.lit(0)))
        torn = F.array_compact(F.zip_with("pairs", later, lambda p, q: F.when(p.a == q.a, p.a)))
        places = aligned.select("id", "item", torn.alias("torn"), F.explode("places").alias("place")).where(~(F.col("place.template") & F.arrays_overlap("place.values", "torn")))
        at = F.col("place.item_pos")
        sums = places.groupBy("id", "item").agg(
            F.count_distinct(at).alias("n_windows"),
            F.count_distinct(F.when(~F.col("place.template"), at)).alias("n_literal"),
            F.min("place.run").alias("first_token"),
        )
        share = F.col("n_windows") / F.col("n_item")
        kind = F.when(F.col("n_literal") / F.col("n_item") >= coverage, "verbatim").otherwise("reparameterised")
        out = sums.join(n_item, "item").where(share >= coverage)
        return written(out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), kind.alias("kind"), share.alias("coverage"), "n_windows", "first_token"), "leaks")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that leak an item; rows with a null id stay."""
    key = bloom.free_name(docs)
    found = leaks(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias(key)).distinct()
    return docs.join(found, F.col(id_col) == F.col(key), "left_anti")
