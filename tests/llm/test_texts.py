"""Kernels, near duplicates, quality rules, token counts and licences against brute force."""

import collections
import json
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamframe.llm import bloom, kernels, licenses, neardup, quality, tokencount

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pieces_keep_every_text():
    texts = pa.array(["ab", "", None, "c" * 10, "dé f", None, "x"])
    for limit in (1, 3, 5, 100):
        out = []
        for i, j, buf, offs in kernels.pieces(texts, limit):
            out += [bytes(buf[offs[k] : offs[k + 1]]).decode() for k in range(j - i)]
        assert out == ["ab", "", "", "c" * 10, "dé f", "", "x"]


def test_words_do_not_cross_texts():
    (_, _, buf, offs), *_ = kernels.pieces(pa.array(["ab", "cd e", "", " f"]))
    starts, ends, rows = kernels.word_bounds(buf, offs)
    assert [(bytes(buf[s:e]).decode(), r) for s, e, r in zip(starts, ends, rows)] == [("ab", 0), ("cd", 1), ("e", 1), ("f", 3)]
    h = kernels.span_hashes(buf, starts, ends)
    assert len(set(h)) == 4 and kernels.window_hashes(h, rows, 2)[1].tolist() == [1]


def test_bloom_has_no_false_negatives(spark):
    keys = np.arange(0, 100_000, 7, dtype=np.int64)
    packed = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "id long"), "id", len(keys))
    assert len(bloom.may_hold(packed, keys)) == len(keys)
    assert len(bloom.may_hold(packed, np.arange(1, 100_000, 7, dtype=np.int64))) < 500


def test_rows_of_dropped_ids_go_and_null_ids_stay(spark, messy):
    kept = neardup.without_near_duplicates(messy.withColumn("_key", F.lit(1)))
    assert "_key" in kept.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in messy.collect() if r.doc_id != 2)


def test_batches_are_bounded(spark):
    sizes = kernels.in_batches(spark.range(20_000).select(F.repeat(F.lit("x"), 1000)), lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 1.5 * kernels.BATCH_BYTES
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    kernels.in_batches(spark.range(1), lambda bs: bs, "id long")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_hashes_do_not_depend_on_runs(monkeypatch):
    (_, _, buf, offs), *_ = kernels.pieces(pa.array(["some words here", "and there", "", "a" * 50]))
    starts, ends, _ = kernels.word_bounds(buf, offs)
    whole = kernels.span_hashes(buf, starts, ends)
    monkeypatch.setattr(kernels, "PIECE_BYTES", 7)
    assert (kernels.span_hashes(buf, starts, ends) == whole).all()


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def brute_components(docs, width, percent):
    """docs: list of (id, text); component of every id by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.integers(len(w))] = f"e{rng.integers(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, width, percent, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 6)  # so that groups go the way of long lists
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{k}" for k in range(400)])
    passage = " ".join(rng.choice(vocabulary, 60))
    docs = []
    for g in range(12):
        base = rng.choice(vocabulary, int(rng.integers(4, 200)))
        docs += [edited(rng, base, int(rng.integers(0, 7))) for _ in range(int(rng.integers(1, 14)))]
    docs += [f"{passage} " + " ".join(rng.choice(vocabulary, int(rng.integers(2, 60)))) for _ in range(40)]
    docs += ["", "one", "one two", "ONE two", None]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(docs)), docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in neardup.near_duplicates(df, neardup.Similarity(width, percent)).collect()}
    expected = brute_components(rows, width, percent)
    assert {i: r.component_id for i, r in found.items()} == expected
    assert all(r.kept == (i == expected[i]) for i, r in found.items())
    assert all(found[i].n_shingles == len(shingles(t, width)) for i, t in rows)


def test_a_common_passage_leaves_no_crowd(spark):
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{k}" for k in range(100))
    texts = [passage + " " + " ".join(f"r{x}" for x in rng.integers(0, 10**6, 100)) for _ in range(150)]
    texts += [edited(rng, texts[0].split(), 4) for _ in range(3)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = neardup.Similarity(5, 80)
    with neardup.Scratch(spark) as scratch:
        ids = df.select(F.col("doc_id").alias("id"))
        sets = neardup.full_sets(df.toDF("id", "text"), ids, 5, scratch)
        near = {r.rep for r in neardup.crowded(ids.select(F.col("id").alias("rep"), F.col("id").alias("component")), sets, s, scratch).collect()}
    assert near == {0, 150, 151, 152}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, s).collect()} == brute_components(rows, 5, 80)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_crowds_lose_no_link(spark, percent):
    rng = np.random.default_rng(percent)
    docs = []
    for g in range(8):
        base = rng.choice([f"w{k}" for k in range(300)], int(rng.integers(20, 160)))
        docs += [edited(rng, base[: rng.integers(len(base) * 3 // 4, len(base) + 1)], int(rng.integers(0, 9))) for _ in range(12)]
    s, sets = neardup.Similarity(3, percent), [shingles(t, 3) for t in docs]
    linked = {k for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= percent * len(a | b) for k in (i, j)}
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    with neardup.Scratch(spark) as scratch:
        ids = df.select("id")
        near = {r.rep for r in neardup.crowded(ids.select(F.col("id").alias("rep"), F.col("id").alias("component")), neardup.full_sets(df, ids, 3, scratch), s, scratch).collect()}
    assert linked <= near and linked


@pytest.mark.parametrize("width", [1, 3, 5])
def test_each_text_is_sorted_by_itself(width, monkeypatch):
    rng = np.random.default_rng(width)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, size)) for size in rng.permutation(np.repeat(np.arange(12), 4))]
    texts += [None, "", " \n", "one", "a a a a a a a a a", " ".join(f"w{x}" for x in range(5000)), "ONE"]

    def whole_sort(*_):
        raise AssertionError("all texts of a piece were sorted together")

    monkeypatch.setattr(np, "lexsort", whole_sort)
    ((_, _, buf, offs),) = kernels.pieces(pa.array(texts))
    values, counts = neardup.sets_of(buf, offs, width)
    ends = np.cumsum(counts)
    assert counts.tolist() == [len(shingles(t, width)) for t in texts] and ends[-1] == len(values)
    for t, i, j in zip(texts, ends - counts, ends):
        ((_, _, own, at),) = kernels.pieces(pa.array([t], pa.string()))
        alone, _ = neardup.sets_of(own, at, width)
        assert (values[i:j] == alone).all() and (alone[1:] > alone[:-1]).all()


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_rare_values_bound_what_sets_share(spark, percent):
    rng = np.random.default_rng(percent)
    passage = [f"p{k}" for k in range(300)]
    docs = [" ".join(passage + [f"r{x}" for x in rng.integers(0, 10**6, int(rng.integers(40, 80)))]) for _ in range(30)]
    for g in range(6):
        base = rng.choice([f"w{k}" for k in range(300)], int(rng.integers(3, 160)))
        docs += [edited(rng, base[: rng.integers(len(base) * 3 // 4, len(base) + 1)], int(rng.integers(0, 7))) for _ in range(12)]
    s, sets = neardup.Similarity(3, percent), [shingles(t, 3) for t in docs]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    with neardup.Scratch(spark) as scratch:
        full = neardup.full_sets(df, df.select("id"), 3, scratch)
        near = neardup.crowded(df.select(F.col("id").alias("rep"), F.col("id").alias("component")), full, s, scratch)
        rows = near.join(full, F.col("id") == F.col("rep")).select("rep", "n", "rare")
        pairs = rows.toDF("a", "na", "ra").join(rows.toDF("b", "nb", "rb"), F.expr("a < b"))
        shared, na, nb = F.size(F.array_intersect("ra", "rb")), F.col("na"), F.col("nb")
        found = pairs.select("a", "b", (shared > 0).alias("meet"), (s.sizes_fit(na, nb) & s.linked(s.at_most(shared, na, nb), na, nb)).alias("may")).collect()
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    may = {(r.a, r.b) for r in found if r.may}
    meet = {(r.a, r.b) for r in found if r.meet}
    assert linked and linked <= may <= meet
    assert percent == 100 or len(may) < len(meet)


def test_crowds_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 2)  # so that groups go the way of long lists
    rng = np.random.default_rng(13)
    passage = [f"p{k}" for k in range(120)]
    bases = [passage + [f"r{x}" for x in rng.integers(0, 10**6, 20)] for _ in range(10)]
    texts = [edited(rng, base, int(rng.integers(0, 9))) for base in bases for _ in range(4)]
    rows = [(k + 100, t) for k, t in enumerate(texts)]
    odd = [rows[0], rows[0], (100, None), (139, "a text of its own"), (7, ""), (8, None), (None, texts[0]), (None, None), (50, texts[5]), (50, texts[39])]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string")
    found = neardup.near_duplicates(df, neardup.Similarity(3, 85)).collect()
    expected = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 3, 85)
    groups = {100 + k: 100 + c for k, c in expected.items()}
    joined = {groups[105], groups[139]}  # document 50 has the texts of both
    assert len(found) == len(rows) + len(odd) and len(set(groups.values())) > 5
    for r in found:
        own = {None: None, 7: 7, 8: 8, 50: 50}.get(r.doc_id, 50 if groups.get(r.doc_id) in joined else groups.get(r.doc_id))
        assert (r.component_id, r.kept) == (own, own is None or own == r.doc_id)


def test_least_overlap_is_safe():
    rng = np.random.default_rng(1)
    s = neardup.Similarity(3, 85)
    bound = neardup.least_overlap(s)
    for n in (5, 20, 40, 60, 64, 70, 100, 400):
        for _ in range(300):
            common = rng.integers(0, 2**62, n)
            extra = int(n / 0.85) - n
            a = np.sort(np.concatenate((common, rng.integers(0, 2**62, rng.integers(0, extra + 1)))))
            b = np.sort(np.concatenate((common, rng.integers(0, 2**62, max(0, n + extra - len(a) - 1)))))
            if 100 * n < 85 * (len(a) + len(b) - n):
                continue
            shared = len(np.intersect1d(a[:64], b[:64]))
            assert shared >= max(bound[min(len(a), 65)], bound[min(len(b), 65)])


def test_near_duplicates_of_messy_rows(spark, messy, no_documents):
    rows = neardup.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {r.component_id for r in by[1]} == {1} and by[2][0].component_id == 1 and not by[2][0].kept
    assert all(r.component_id is None and r.kept for r in by[None])
    assert by[4][0].n_shingles == by[5][0].n_shingles == by[3][0].n_shingles == 0 and by[4][0].kept
    assert by[8][0].n_shingles == by[9][0].n_shingles == 1
    assert neardup.near_duplicates(no_documents).count() == 0
    kept = neardup.without_near_duplicates(messy)
    assert kept.columns == messy.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in messy.collect() if r.doc_id != 2)


def test_one_id_with_several_texts_links_them(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text), (3, "p q r s t u v"), (5, "p q r s t u v"), (9, text)], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(df).collect()} == {3}


def figures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_figures_match_brute_force(spark, messy, no_documents):
    extra = [(100, "a b c a b c\na b c a b c\n\n x \n x \n<#>", "en", "a"), (101, "A a a a a " * 30, "en", "a")]
    df = messy.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in extra], "doc_id long, text string"))
    rows = quality.apply_rules(df).collect()
    expected = sorted((str(r.doc_id), *figures(r.text)) for r in df.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == expected
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.apply_rules(no_documents).count() == 0


def test_cascade_verdict_does_not_depend_on_order(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    verdicts = []
    for rules in (quality.DEFAULT_RULES, quality.DEFAULT_RULES[::-1]):
        texts = df.select("text").toPandas()["text"].tolist()
        out = []
        for _, _, buf, offs in kernels.pieces(pa.array(texts)):
            t = quality.Texts(buf, offs)
            out += (quality.cascade(t, rules, ~quality.base_failed(t)) < 0).tolist()
        verdicts.append(out)
    assert verdicts[0] == verdicts[1]
    order = quality.estimate(df, quality.DEFAULT_RULES)
    assert order["per_second"].is_monotonic_decreasing and set(order["name"]) == {r.name for r in quality.DEFAULT_RULES}


def test_rules_spare_survivors_only():
    seen = []
    rules = [quality.Rule("a", lambda t: t.n_words > 2), quality.Rule("b", lambda t: (seen.append(t.n), t.n_words < 1)[1])]
    (_, _, buf, offs), *_ = kernels.pieces(pa.array(["a b c", "", "x"]))
    assert quality.cascade(quality.Texts(buf, offs), rules, np.ones(3, bool)).tolist() == [0, 1, -1] and seen == [2]


FEATURES = ("words", "word_hashes", "n_words", "word_chars", "n_symbols", "lines", "n_lines", "n_dup_lines", "n_repeat_words", "top_word_count")


@pytest.mark.parametrize("known", [(), FEATURES, ("words", "n_dup_lines"), ("word_hashes", "lines", "n_symbols")])
def test_subsets_keep_what_is_known(spark, sf, known):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text").toPandas()["text"].tolist()[:60] + ["", None, "a\na\n\na b\n"]
    (_, _, buf, offs), *_ = kernels.pieces(pa.array(texts), 1 << 24)
    t = quality.Texts(buf, offs)
    for name in known:
        getattr(t, name)
    rng = np.random.default_rng(1)
    rows = np.flatnonzero(rng.random(t.n) < 0.6)
    some = t.subset(rows)
    some.n_symbols
    again = rows[::2]
    fresh = quality.Texts(*next(iter(kernels.pieces(pa.array([texts[i] for i in again]), 1 << 24)))[2:])
    for name in FEATURES:
        got, want = (getattr(x, name) for x in (some.subset(np.arange(0, len(rows), 2)), fresh))
        assert all(np.array_equal(a, b) for a, b in zip(got, want)) if isinstance(got, tuple) else np.array_equal(got, want), name


def test_the_cascade_judges_fewer_texts_and_splits_them_once(spark, sf, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    order = [quality.DEFAULT_RULES[k] for k in quality.estimate(df, quality.DEFAULT_RULES)["rule"]]
    judged, split = [], []
    counted = [quality.Rule(r.name, lambda t, r=r: (judged.append(t.n), r.fails(t))[1]) for r in order]
    word_bounds = kernels.word_bounds
    monkeypatch.setattr(kernels, "word_bounds", lambda buf, offs, *x: (split.append(len(buf)), word_bounds(buf, offs, *x))[1])
    n = size = 0
    for _, _, buf, offs in kernels.pieces(pa.array(df.select("text").toPandas()["text"])):
        t = quality.Texts(buf, offs)
        quality.base_figures(t)
        quality.cascade(t, counted, ~quality.base_failed(t))
        n, size = n + t.n, size + len(buf)
    assert sum(judged) < 0.9 * n * len(order) and sum(split) == 2 * size  # words and lines, once each


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_match_the_library(spark, sf, messy, no_documents, library):
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), messy):
        rows = tokencount.count_tokens(df, path).collect()
        texts = {}
        for r in df.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        found = {}
        for r in rows:
            found.setdefault(r.doc_id, []).append((r.n_bytes, r.n_tokens, r.over_limit))
        for i, own in texts.items():
            counts = [len(e.ids) for e in library.encode_batch(own, add_special_tokens=False)]
            assert sorted(found[i]) == sorted((len(t.encode()), n, n > 2048) for t, n in zip(own, counts))
    assert tokencount.count_tokens(no_documents, path).count() == 0


@pytest.mark.parametrize(
    "text",
    ["ΑΣ ΣΑΣ İstanbul <|endoftext|>hi <|startoftext|><|endoftext|>", "a" * 5000, "ab" * 3000 + "c", "don't I'LL we've 'sx", "!!!!###$$$ ½ ٣ 漢字かな 😀😀", "<|ENDOFTEXT|> <|endof", "".join(map(chr, range(32, 0x3100)))],
)
def test_token_count_of_odd_texts(text, library):
    counter = tokencount.Counter(tokencount.load_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    assert counter.count([text, "a b", text]) == [len(library.encode(t, add_special_tokens=False).ids) for t in (text, "a b", text)]


_COUNTER = tokencount.Counter(tokencount.load_vocabulary(public_tokenizers.path("word_bpe_49k.json")))


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.one_of(st.sampled_from("abcdeEÉsſ'’ \n\t\u2003<|>123½ßΣİ漢😀\u0301"), st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF)), max_size=60))
def test_token_count_of_any_text(library, text):
    assert _COUNTER.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_small_memory_of_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokencount, "CACHE_CHARS", 4)
    monkeypatch.setattr(tokencount, "ROUND_BYTES", 8)
    counter = tokencount.Counter(tokencount.load_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["some longer words and a few short ones", "a few more", "", "some longer"]
    for _ in range(3):
        assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def dice(a, b):
    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return set(zip(w, w[1:])) if len(w) > 1 else set(map(tuple, [w] if w else []))

    x, y = grams(a), grams(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def pairs(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:]))


def best_license(unit):
    """(-dice, licence) of the best licence whose telling bigrams and version the unit holds."""
    held = {name: set().union(*map(pairs, notices)) for name, notices in licenses.TEMPLATES.items()}
    found = []
    for name, notices in licenses.TEMPLATES.items():
        others = set().union(*(h for n, h in held.items() if n != name))
        version = re.search(r"-(\d+)\.(\d+)$", name)
        for notice in notices:
            telling, own = pairs(notice) - others, pairs(unit)
            if dice(unit, notice) >= licenses.THRESHOLD and 2 * len(telling & own) >= len(telling) and (version is None or version.groups() not in pairs(notice) or version.groups() in own):
                found.append((-dice(unit, notice), name))
    return min(found, default=None)


def test_right_licence_or_none(spark):
    cases = [
        ("SPDX-License-Identifier: BSD-3-Clause", {"BSD"}),
        ("// SPDX-License-Identifier: GPL-2.0-only", {"GPL"}),
        ("SPDX-License-Identifier: LicenseRef-Proprietary", set()),
        ("# spdx-license-identifier: (MIT OR Apache-2.0) AND CC-BY-SA-4.0", {"MIT", "Apache-2.0", "CC-BY-SA"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", {"GPL"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"CC-BY-NC"}),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", {"CC-BY-ND"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", {"CC-BY-NC-SA"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"CC-BY"}),
        (licenses.TEMPLATES["AGPL"][1], {"AGPL"}),
        (licenses.TEMPLATES["LGPL"][1], {"LGPL"}),
        (licenses.TEMPLATES["GPL"][1].replace("program", "work"), {"GPL"}),
        ("Distributed under the Boost Software License, Version 1.0.", {"BSL-1.0"}),
        ("Some words before. Licensed under CC0 1.0. And words that follow it here", {"CC0-1.0"}),
        ("Released under the Unlicense.", {"Unlicense"}),
        ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
        (licenses.TEMPLATES["MIT"][3], {"MIT"}),
        ("Licensed under the Foo License.", set()),
        ("Licensed under the Apache License, Version 1.1.", set()),
        ("Released under the terms of a license that nobody knows", set()),
        ("Released under the MIT License. Released under the BSD License.", {"MIT", "BSD"}),
        ("The driver must hold a public license, version unknown, of the state", set()),
    ]
    rows = []
    for text, wanted in cases:
        rows += [(text, wanted), (f"several words stand here\n{text}\nand several more there", wanted)]
        if "spdx" not in text.lower():
            rows.append((f"on and on it goes for a while {text} until the end of all that", wanted))
    found = collections.defaultdict(set)
    for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect():
        found[r.doc_id].add(r.license)
    assert [(t, found[i]) for i, (t, _) in enumerate(rows)] == rows


def test_licenses_match_brute_force(spark, messy, no_documents):
    texts = [
        "Intro\nLICENSED under the Apache license, version 2.0!\nend",
        "Released under the\nMIT License.",
        "All rights reserved.\nAll rights, reserved\nLicensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licence of no kind\n\nPermission is hereby granted to nobody",
        "para one\n\nLicensed under the\nMozilla Public License,\nVersion 2.0.\n\npara two",
        "rights",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.license): round(r.dice, 9) for r in licenses.scan(df).collect()}
    expected = {}
    for i, t in enumerate(texts):
        units = set(t.split("\n")) | set(re.split(r"\n\s*\n", t)) | {t}
        for unit in units:
            if (best := best_license(unit)) is not None:
                expected[i, best[1]] = max(round(-best[0], 9), expected.get((i, best[1]), 0))
    assert found == expected and len(found) >= 6
    assert licenses.scan(messy).count() == 0 and licenses.scan(no_documents).count() == 0
    assert licenses.scan(df, {}).count() == 0


def test_embedded_and_wrapped_notices(spark):
    filler = "some words of a longer text that go on for a while, and on "
    texts = [
        "Copyright 2020 Foo. All rights reserved.",
        "This file is licensed under the MIT License.",
        filler * 300 + "Released under the BSD License. " + filler * 300,
        f"{filler}\n{filler} this work is\nreleased into the public\ndomain. {filler}\n{filler}",
        filler * 2 + "permission is hereby granted, all rights of others reserved",
    ]
    found = {(r.doc_id, r.license): (round(r.dice, 9), r.n_units) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {(0, "proprietary"): (1.0, 1), (1, "MIT"): (1.0, 1), (2, "BSD"): (1.0, 1), (3, "public-domain"): (1.0, 1)}


def test_telling_parts_miss_no_match():
    rng = np.random.default_rng(3)
    notices = [re.findall(r"[a-z0-9]+", t.lower()) for ts in licenses.TEMPLATES.values() for t in ts]
    pattern = re.compile("|".join("[^a-z0-9]+".join(p) for p in licenses.telling_parts(notices, 0.8)))
    for notice in notices:
        for _ in range(200):
            text = " ".join(w for w in notice if rng.random() > 0.12)
            if dice(text, " ".join(notice)) >= 0.8:
                assert pattern.search(text)


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers

    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    for key, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"})):
        other = tmp_path / f"{key}.json"
        other.write_text(json.dumps(spec | {key: value}), encoding="utf-8")
        with pytest.raises(ValueError, match="is counted here"):
            tokencount.load_vocabulary(str(other))
