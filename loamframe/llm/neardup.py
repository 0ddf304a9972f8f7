"""Near duplicates by bottom-k sketches from one hash function.

1. A text's set holds the hashes of its distinct word shingles; its sketch the K
   smallest.  Texts with equal sets are represented by the smallest id.
2. Two sets as similar as asked share at least a known number of retained values
   (`least_overlap`; the chance to miss a pair is below MISS).  So they share one
   of the rarest retained values of each, and only these enter the inverted lists.
3. A short list gives all its pairs.  A long one gives its most central set, the
   one whose values are the most common, paired with each other set.
4. The sketch of the union, the K smallest of both sketches, estimates the
   similarity; pairs below the bound are left out.  The full sets, kept once as a
   table, decide the rest.  Each set's best pairs are decided first; pairs that are
   then in one component need no decision.
5. Long lists whose sets are then in several components are searched again by the
   rarest values of the full sets (`crowded`): without the sketch's chance these
   are few, a fifth of a set or less, and sets that share no more than a passage
   have none in common.  What is left meets within its long list and is decided on
   full sets inside the join, so that no link between components is lost and only
   links leave the join.

The work is done when the operator is called; the result is a table in the shared
folder, all other tables are deleted.

Defined results: ids are whole numbers, others stop the job; an empty text or one without words has an empty set and is linked
with nothing; fewer words than a shingle has make one shingle; a very long text is
shingled whole, as a piece of its own; a null id has a null component and is kept;
rows with one id are one document, whatever their texts; ties go to the smallest
id; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.llm import bloom
from loamframe.llm import kernels as K
from loamframe.llm.bloom import free_name
from loamframe.operators.graph import components
from loamframe.storage import Scratch, written

#: Retained values.
RETAINED = 64
#: Chance that a pair at the threshold shares fewer retained values than asked for.
MISS = 1e-9
#: Sets in a list that gives all its pairs.
SHORT_LIST = 24
#: Parts that the sets outside a centre's component are dealt over.
SALTS = 8


@dataclass(frozen=True)
class Similarity:
    """Shingles of `width` words; sets are linked if 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80

    def linked(self, common: Column, n: Column, m: Column) -> Column:
        return 100 * common >= self.percent * (n + m - common)

    def probe(self, n: Column) -> Column:
        """How many of its rarest values a set of n has to show: a linked set that is no larger holds one of them."""
        return n - F.call_function("div", n * self.percent + 99, F.lit(100).cast("long")) + 1

    def at_most(self, shared: Column, n: Column, m: Column) -> Column:
        """How many values two sets can have in common, of which `shared` are among the `probe` first ones of both.

        Past the end of the `probe` first ones that end first, only the rest of that set is left.
        """
        return shared + F.greatest(n - self.probe(n), m - self.probe(m))

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return (100 * n >= self.percent * m) & (100 * m >= self.percent * n)


def tail_bound(k: int, p: float, miss: float) -> int:
    """The largest x for which a binomial variable is below x with a chance of at most miss."""
    chance, x = 0.0, 0
    while x < k:
        chance += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if chance > miss:
            break
        x += 1
    return x


def least_overlap(similarity: Similarity, k: int = RETAINED) -> list[int]:
    """Retained values that a set of n <= k values shares with any set it is linked with, by n; the last entry is for larger sets.

    A whole small set shares its part of the threshold; of that, a larger partner
    may have dropped what it holds beyond k.
    """
    t = similarity.percent / 100
    small = [max(1, min(math.ceil(t * n - 1e-9), math.floor(k - (1 - t) * n / t + 1e-9))) for n in range(k + 1)]
    return [*small, max(1, tail_bound(k, t, MISS))]


def sets_of(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes as ascending int64, text after text, and the size of each text's set."""
    n = len(offs) - 1
    buf = K.ASCII_LOWER[buf]
    starts, ends, rows = K.word_bounds(buf, offs)
    words = K.span_hashes(buf, starts, ends)
    h, at = K.window_hashes(words, rows, width)
    own = rows[at]
    n_words = K.counts_by_row(rows, n)
    first = np.cumsum(n_words) - n_words
    for k in range(1, width):
        short = np.flatnonzero(n_words == k)
        if len(short):
            g = np.full(len(short), k, dtype=np.uint64)
            for i in range(k):
                g = K.mix(g * np.uint64(0x9E3779B97F4A7C15) + words[first[short] + i])
            h, own = np.concatenate((h, g)), np.concatenate((own, short))
    h = h.view(np.int64)
    if len(h) > len(at):  # short texts were put behind the others
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    begin = 0
    for end in np.cumsum(K.counts_by_row(own, n)).tolist():
        h[begin:end].sort()
        begin = end
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], K.counts_by_row(own[new], n)


def head(values: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k values of each run."""
    at = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    return values[at < k], np.minimum(counts, k)


def signatures(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each run, by which equal sets are told."""
    out = []
    for salt in (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(values.view(np.uint64) ^ salt))))
        ends = np.cumsum(counts)
        out.append((total[ends] - total[ends - counts]).view(np.int64))
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """id, n (set size), s1, s2 (signature) and the sketch of every text; docs has id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in K.pieces(batch.column(1)):
                values, counts = sets_of(buf, offs, width)
                s1, s2 = signatures(values, counts)
                sketch = K.ragged(*head(values, counts, RETAINED), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(s1), pa.array(s2), sketch], names=["id", "n", "s1", "s2", "sketch"]
                )

    return K.in_batches(docs, work, "id long, n long, s1 long, s2 long, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """id, n and the whole set of the documents in ids, as a table; a Bloom filter spares the others' work."""
    packed = scratch.broadcast(bloom.build(ids, "id", ids.count()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = bloom.may_hold(packed.value, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            batch = batch.take(pa.array(near))
            for i, j, buf, offs in K.pieces(batch.column(1)):
                values, counts = sets_of(buf, offs, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), K.ragged(values, counts, pa.int64())], names=["id", "n", "values"])

    found = K.in_batches(docs.where(F.col("id").isNotNull()), work, "id long, n long, values array<long>")
    return scratch.table(found.where(F.col("n") > 0).join(ids, "id", "left_semi"), "sets")


def postings(reps: DataFrame, similarity: Similarity, scratch: Scratch) -> DataFrame:
    """The inverted lists' rows (v, rep, n, central): each set's rarest retained values that another set has too.

    Counts of values are a table of their own, so that a join with them can split a value that very many sets hold.
    """
    overlap = F.array(*[F.lit(x) for x in least_overlap(similarity)])
    values = reps.select("rep", "n", F.explode("sketch").alias("v"))
    shared = scratch.table(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    own = Window.partitionBy("rep")
    size = F.least("n", F.lit(RETAINED))
    rows = values.join(shared, "v").select(
        "v",
        "rep",
        "n",
        F.row_number().over(own.orderBy("df", "v")).alias("rank"),
        (size - F.count(F.lit(1)).over(own)).alias("single"),
        (F.sum("df").over(own) / size).alias("central"),
    )
    prefix = size - F.get(overlap, F.least("n", F.lit(RETAINED + 1)).cast("int")) + 1
    return rows.where(F.col("rank") <= prefix - F.col("single")).select("v", "rep", "n", "central")


def estimated(pairs: DataFrame, reps: DataFrame, similarity: Similarity) -> DataFrame:
    """pairs (a, b) whose union sketch allows a link, with the share of its values that both have as est."""
    a = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    b = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, RETAINED)
    common = F.size(F.array_intersect(F.col("union"), F.array_intersect("sa", "sb")))
    found = both.withColumn("union", union).select("a", "b", common.alias("common"), F.size("union").alias("size"))
    enough = F.when(F.col("size") < RETAINED, 100 * F.col("common") >= similarity.percent * F.col("size")).otherwise(F.col("common") >= least_overlap(similarity)[-1])
    return found.where(enough).select("a", "b", (F.col("common") / F.col("size")).alias("est"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """pairs (a, b) that are linked by their full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("values").alias("va"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("values").alias("vb"))
    common = F.size(F.array_intersect("va", "vb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").where(similarity.linked(common, F.col("na"), F.col("nb"))).select("a", "b").distinct()


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b) that are not in one component; an id without a label is its own."""
    la = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    lb = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def crowded(named: DataFrame, sets: DataFrame, similarity: Similarity, scratch: Scratch) -> DataFrame:
    """rep of the sets in named (rep, component) that may be linked with one of another component, and their rare values.

    Values are ordered from the rarest.  Of two linked sets the larger has their
    first common value among its `probe` first ones, and the smaller, whose partner
    has at least its own size, among its `index` first ones.  `rare` are those of
    the `probe` first ones that a set of another component has among its own.
    """
    whole = named.join(sets.select(F.col("id").alias("rep"), "n", "values"), "rep")
    values = whole.select("rep", "component", "n", F.explode("values").alias("v"))
    shared = scratch.table(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    own = Window.partitionBy("rep")
    single = F.col("n") - F.count(F.lit(1)).over(own)
    place = F.row_number().over(own.orderBy("df", "v")) + single
    n, p = F.col("n"), similarity.percent
    index = n - F.call_function("div", 2 * n * p + 99 + p, F.lit(100 + p).cast("long")) + 1
    rows = values.join(shared, "v").withColumn("place", place).where(F.col("place") <= similarity.probe(n)).select("v", "rep", "component", (F.col("place") <= index).alias("first"))
    rows = scratch.table(rows, "rare")
    lists = rows.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("first").alias("meets")).where("lo < hi")
    met = rows.join(scratch.table(lists.select("v", "meets"), "met"), "v")
    return met.groupBy("rep").agg(F.collect_list("v").alias("rare"), F.bool_or("meets").alias("near")).where("near").select("rep", "rare")


def leftover(groups: DataFrame, labels: DataFrame, sets: DataFrame, similarity: Similarity, scratch: Scratch) -> DataFrame | None:
    """Links between components among the sets whose long lists have one centre; groups has centre and rep.

    A set outside the centre's component meets each set outside its own one; the
    full sets are compared inside the join, so that links alone leave it, and only
    where the rare values allow a link.
    """
    named = groups.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    main = named.where("rep = centre").select("centre", F.col("component").alias("main"))
    open_ = named.join(main, "centre").where("component <> main").select("centre").distinct()
    some = scratch.table(named.join(main, "centre").join(open_, "centre", "left_semi"), "open")
    if some.isEmpty():
        return None
    near = scratch.table(crowded(some.select("rep", "component").distinct(), sets, similarity, scratch), "near")
    whole = some.join(near, "rep").join(sets.select(F.col("id").alias("rep"), "n", "values"), "rep")
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")
    x = whole.where("component <> main").select("centre", salt.alias("salt"), F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("values").alias("va"), F.col("rare").alias("ra"))
    every = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    y = whole.select("centre", every.alias("salt"), F.col("rep").alias("b"), F.col("component").alias("cb"), "main", F.col("n").alias("nb"), F.col("values").alias("vb"), F.col("rare").alias("rb"))
    meet = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    na, nb = F.col("na"), F.col("nb")
    most = similarity.at_most(F.size(F.array_intersect("ra", "rb")), na, nb)
    exact = similarity.linked(F.size(F.array_intersect("va", "vb")), na, nb)
    met = x.join(y, (x.centre == y.centre) & (x.salt == y.salt) & meet & similarity.sizes_fit(na, nb) & similarity.linked(most, na, nb) & exact)
    return met.select("a", "b").distinct()


def near_duplicates(df: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, n_shingles, component_id and kept (the id is its component's smallest)."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.table(sketches(docs, similarity.width), "sketches")
        filled = rows.where("n > 0 AND id IS NOT NULL")
        reps = scratch.table(filled.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.any_value("sketch").alias("sketch")), "reps")
        members = filled.select("id", "n", "s1", "s2").join(reps.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("id", "rep").distinct()
        members = scratch.table(members, "members")
        # an id that has several texts connects their representatives
        firsts = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("id", "a")
        links = members.join(firsts, "id").where("rep <> a").select("a", F.col("rep").alias("b"))

        lists = scratch.table(postings(reps.select("rep", "n", "sketch"), similarity, scratch), "lists")
        sizes = lists.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("central", -F.col("rep"), F.col("n"))).alias("top")).where("m > 1")
        sizes = scratch.table(sizes.select("v", "m", (-F.col("top.col2")).alias("centre"), F.col("top.n").alias("nc")), "sizes")
        short = lists.join(sizes.where(F.col("m") <= SHORT_LIST).select("v"), "v").select("v", "rep", "n")
        x, y = short.toDF("v", "a", "na"), short.toDF("v", "b", "nb")
        fit = similarity.sizes_fit(F.col("na"), F.col("nb"))
        few = x.join(y, "v").where((F.col("a") < F.col("b")) & fit).select("a", "b")
        long_ = lists.join(sizes.where(F.col("m") > SHORT_LIST).select("v", "centre", "nc"), "v").select("centre", "nc", "rep", "n").distinct()
        long_ = scratch.table(long_, "long")
        star = long_.where((F.col("rep") != F.col("centre")) & similarity.sizes_fit(F.col("n"), F.col("nc"))).select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        pairs = scratch.table(estimated(few.union(star).distinct(), reps, similarity), "pairs")

        needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(long_.select("rep")).distinct()
        sets = full_sets(docs, scratch.table(needed, "needed"), similarity.width, scratch)
        best = F.row_number().over(Window.partitionBy("b").orderBy(F.col("est").desc(), "a"))
        links = scratch.table(links.union(verified(pairs.withColumn("k", best).where("k <= 2"), sets, similarity)), "links")
        labels = components(links, scratch)
        more = verified(across(pairs, labels), sets, similarity)
        rest = leftover(long_.select("centre", "rep").distinct(), labels, sets, similarity, scratch)
        more = scratch.table(more if rest is None else more.union(rest), "links")
        if not more.isEmpty():
            labels = components(links.union(more), scratch)
        found = members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
        found = found.groupBy("id").agg(F.min("component").alias("component"))
        component = F.coalesce("component", F.col("id"))
        out = rows.select("id", "n").join(found, "id", "left").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        out = out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
        return written(out, "near-duplicates")


def without_near_duplicates(df: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each component, the one with the smallest id; rows with a null id stay."""
    found = near_duplicates(df, similarity, id_col, text_col)
    key = free_name(df)
    dropped = found.where("NOT kept").select(F.col(id_col).alias(key)).distinct()
    return df.join(dropped, F.col(id_col) == F.col(key), "left_anti")
