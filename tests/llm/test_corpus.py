"""Decontamination, toxicity, archive, sharding, mixing, chat windows and the pipeline."""

import base64
import collections
import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamframe.llm import chat, decontaminate, kernels, mixing, queries, sharding, toxicity, warc
from loamframe.storage import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- decontamination ------------------------------------------------------------


ITEM = "Anna has 3 apples and Bob has 5 apples. How many apples do Anna and Bob have after Anna eats 3 of them?"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ITEM), (2, "tiny item"), (3, "one two three four"), (4, ""), (5, None), (None, "Null id text has enough tokens here"), (6, "The train runs 80 km in 2 hours without any stop at all."), (1, ITEM)]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize(
    "text,kind",
    [
        (ITEM, "verbatim"),
        ("Before. " + ITEM + " After.", "verbatim"),
        (ITEM.upper().replace(" ", "!! "), "verbatim"),
        ("Intro. Carl has 7 apples and Dora has 9 apples. How many apples do Carl and Dora have after Carl eats 7 of them? End", "reparameterised"),
        # names at the beginning of sentences, number words and names in other letters
        ("Dora has 7 apples and Carl has 9 apples. How many apples do Dora and Carl have after Dora eats 7 of them?", "reparameterised"),
        ("Intro. Carl has seven apples and Dora has nine apples. How many apples do Carl and Dora have after Carl eats seven of them?", "reparameterised"),
        ("Иван has 7 apples and Ольга has 9 apples. How many apples do Иван and Ольга have after Иван eats 7 of them?", "reparameterised"),
        # the second slot pattern contradicts the first: Dora and Carl change places
        ("Carl has 7 apples and Dora has 9 apples. How many apples do Dora and Carl have after Dora eats 8 of them?", None),
        ("Some other text about pears and plums that nobody has counted before today, says Anna.", None),
        ("A line. The train runs 95 miles in 3 days without any stop at all.", "reparameterised"),
        ("", None),
        (None, None),
    ],
)
def test_leaks(spark, items, text, kind):
    found = decontaminate.leaks(spark.createDataFrame([(7, text)], "doc_id long, text string"), items).collect()
    assert [r.kind for r in found] == ([kind] if kind else [])


def test_short_items_and_edges(spark, items, messy, no_documents):
    docs = spark.createDataFrame([(3, "TINY!! item"), (4, "a tiny item"), (5, "x one two three four y"), (None, ITEM), (8, ITEM), (8, ITEM)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(3, 2), (5, 3), (8, 1)]
    assert decontaminate.leaks(messy, items).count() == 0 and decontaminate.leaks(no_documents, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    kept = decontaminate.without_leaks(messy.withColumn("text", F.when(F.col("doc_id") == 6, ITEM).otherwise(F.col("text"))), items)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 1


@pytest.mark.parametrize(
    "item,text,kind",
    [
        ("Tom buys 4 pens. Tom sells 2 pens. Tom keeps the rest.", "Ann buys 9 pens. Ann sells 5 pens. Ann keeps the rest.", "reparameterised"),
        ("Tom buys 4 pens. Tom sells 2 pens. Tom keeps the rest.", "Then Ann buys 9 pens. Ann sells 5 pens. Ann keeps the rest.", "reparameterised"),
        ("She walks three miles in ten minutes and then rests.", "She walks five miles in twenty minutes and then rests.", "reparameterised"),
        ("Βασίλης has 3 dogs and Ελένη has 4 dogs.", "Νίκος has 5 dogs and Μαρία has 6 dogs.", "reparameterised"),
        ("Tom buys 4 pens. Tom sells 2 pens. Tom keeps the rest.", "The shop buys pens. It sells 2 boxes. Nobody keeps the change.", None),
        ("Add 12 km and 7 km to 30 km.", "Now: Add 15 km and 9 km to 41 km. Done", "reparameterised"),
        ("Compute 17 + 25 - 3", "Please compute 18 + 21 - 4 now", "reparameterised"),
        ("Compute 17 + 25 - 3 + 9 - 11", "compute 1 + 2 - 4 + 5 - 6", "reparameterised"),
        ("Multiply 3 m by 4 m, 5 m and 6 m, then subtract 7 kg, 8 kg, 9 kg", "We multiply 13 m by 14 m, 15 m and 16 m, then subtract 17 kg, 18 kg, 19 kg", "reparameterised"),
        ("Add 12 km and 7 km to 30 km.", "Add 12 km and 7 km to 30 km.", "verbatim"),
        ("Add 12 km and 7 km to 30 km.", "Take 15 km or 9 km from 41 km.", None),
        ("Compute 17 + 25 - 3", "Please compute 18 + 21 now, says everyone", None),
        ("12 + 25 - 3", "the years 18 21 4 and more", None),
    ],
)
def test_items_dense_in_slots(spark, item, text, kind):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame([(7, text), (8, "")], "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.kind) for r in found] == ([(7, kind)] if kind else [])


@pytest.mark.parametrize(
    "item,text,kind",
    [
        ("Tom buys 4 pens. Tom sells 2 pens. Tom keeps the rest.", "Ann buys 9 pens. Ann sells 5 pens. Ann keeps the rest.", "reparameterised"),
        ("Tom buys 4 pens. Tom sells 2 pens. Tom keeps the rest.", "Then Ann buys 9 pens. Ann sells 5 pens. Ann keeps the rest.", "reparameterised"),
        ("She walks three miles in ten minutes and then rests.", "She walks five miles in twenty minutes and then rests.", "reparameterised"),
        ("Βασίλης has 3 dogs and Ελένη has 4 dogs.", "Νίκος has 5 dogs and Μαρία has 6 dogs.", "reparameterised"),
        ("Tom buys 4 pens. Tom sells 2 pens. Tom keeps the rest.", "The shop buys pens. It sells 2 boxes. Nobody keeps the change.", None),
        # two values become one
        ("Then we bought 3 apples and later 5 apples at the market", "Then we bought 4 apples and later 4 apples at the market", "reparameterised"),
        # decimals and thousands are single numbers
        ("She bought 2.5 kg and 5 boxes of the ripe pears there", "She bought 3.5 kg and 7 boxes of the ripe pears there", "reparameterised"),
        ("A farm sold 12 eggs a day for weeks", "A farm sold 1,200 eggs a day for weeks", "reparameterised"),
        # one contradiction costs only the windows that hold it
        (
            "There were 3 cats here and 8 dogs in the old yard with 9 birds up on the big roof and 3 mice",
            "There were 4 cats here and 6 dogs in the old yard with 7 birds up on the big roof and 5 mice",
            "reparameterised",
        ),
        ("We see 3 cats and then 3 dogs and then 3 birds", "We see 4 cats and then 5 dogs and then 6 birds", None),
    ],
)
def test_slots_of_copies(spark, item, text, kind):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame([(7, "On page 1.5: " + text)], "doc_id long, text string"), items).collect()
    assert [(r.kind, r.first_token >= 4) for r in found] == ([(kind, True)] if kind else [])


def tokens(text):
    return [t for t in re.findall(r"[^\W\d_]+|\d+", text.lower())]


def test_verbatim_leaks_match_brute_force(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    w = decontaminate.WIDTH
    grams = {r.item_id: [tuple(t[i : i + w]) for t in [tokens(r.text)] for i in range(len(t) - w + 1)] for r in bench.collect()}
    expected = set()
    for r in docs.collect():
        t = tokens(r.text or "")
        own = {tuple(t[i : i + w]) for i in range(len(t) - w + 1)}
        expected |= {(r.doc_id, i) for i, g in grams.items() if g and sum(x in own for x in g) / len(g) >= decontaminate.COVERAGE}
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == expected and found


def typed(text, named=False):
    """(value, template token, is a slot) of every token of an ASCII text; `named` types capitalised words at the beginning of sentences as names."""
    out, end, numeric = [], 0, False
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[A-Za-z]+", text or ""):
        word, between = m[0], text[end : m.start()]
        if word[0].isdigit() or word.lower() in decontaminate.NUMBER_WORDS:
            kind = "#"
        elif numeric and word.lower() in decontaminate.UNITS:
            kind = "@"
        elif (named or (out and not re.search(r"[.!?:;\n]", between))) and re.match("[A-Z][a-z]", word):
            kind = "%"
        else:
            kind = None
        out.append((word.lower(), kind or word.lower(), kind is not None))
        end, numeric = m.end(), kind == "#"
    return out


def item_windows(item):
    """Per place of an item: the literal window and, where there is one, the (start, end) of the template window."""
    n = len(item)
    if n < 3:
        return [((0, n), None)] if n else []
    own, free = min(n, decontaminate.WIDTH), [i for i in range(n) if not item[i][2]]
    out = []
    for p in range(n - own + 1):
        held, later = [i for i in free if p <= i < p + own], [i for i in free if i >= p]
        template = (p, p + own)
        if len(held) == own or not free:
            template = None
        elif len(held) < decontaminate.LEAST_LITERALS:
            template = (0, n) if len(free) < 3 else (p, later[2] + 1) if len(later) > 2 else (free[-3], n)
        out.append(((p, p + own), template))
    return out


def brute_leaks(docs, items, coverage=decontaminate.COVERAGE):
    found = {}
    for d, text in docs:
        for i, item_text in items:
            hits = collections.defaultdict(list)
            for item, doc in itertools.product(*([typed(t, named) for named in (False, True)] for t in (item_text, text))):
                windows = item_windows(item)
                for p, (literal, template) in enumerate(windows):
                    for part, span in ((0, literal), (1, template)):
                        if span is None:
                            continue
                        a, b = span
                        want = [t[part] for t in item[a:b]]
                        for q in range(len(doc) - (b - a) + 1):
                            same = [t[part] for t in doc[q : q + b - a]] == want and (len(item) > 2 or len(doc) == len(item))
                            if same and (not part or [t[2] for t in doc[q : q + b - a]] == [t[2] for t in item[a:b]]):
                                pairs = {(x[0], y[0]) for x, y in zip(item[a:b], doc[q : q + b - a]) if x[2]} if part else set()
                                hits[q - a].append((p, part, pairs))
            places, literal_places = set(), set()
            for own in hits.values():
                values = collections.defaultdict(set)
                for _, _, pairs in own:
                    for x, y in pairs:
                        values[x].add(y)
                for p, part, pairs in own:
                    if all(len(values[x]) == 1 for x, _ in pairs):
                        places.add(p)
                        literal_places |= set() if part else {p}
            if windows and len(places) / len(windows) >= coverage:
                found[d, i] = ("verbatim" if len(literal_places) / len(windows) >= coverage else "reparameterised", len(places))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_template_leaks_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    words, names = ["sum", "of", "the", "boxes", "and", "then", "how", "many", "total"], ["Anna", "Bob", "Carl"]

    def piece():
        kind = rng.random()
        if kind < 0.3:
            return str(rng.choice(["3", "5", "12", "2.5", "1,200"])) + (" " + str(rng.choice(["km", "kg"])) if rng.random() < 0.5 else "")
        return str(rng.choice(names if kind < 0.45 else words)) + ("." if rng.random() < 0.1 else "")

    def again(text):
        return re.sub(r"\d[\d.,]*|Anna|Bob|Carl", lambda m: m[0] if rng.random() < 0.5 else str(rng.choice(names)) if m[0][0].isalpha() else str(rng.integers(1, 99)), text)

    items = [(k, " ".join(piece() for _ in range(int(rng.integers(1, 16))))) for k in range(25)]
    docs = [(k, " ".join(piece() for _ in range(int(rng.integers(0, 6)))) + " " + again(items[k % 25][1]) + " " + piece()) for k in range(60)]
    docs += [(100 + k, again(t)) for k, (_, t) in enumerate(items)]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): (r.kind, r.n_windows) for r in found} == expected
    assert {kind for kind, _ in expected.values()} == {"verbatim", "reparameterised"}


def test_a_window_of_all_items_pairs_nothing(spark):
    rule = "Answer the question with a number and explain each step"
    word = lambda *x: "".join(chr(97 + int(c)) for y in x for c in f"{y:04}")
    items = [(k, f"{rule} of " + " ".join(word(k, j) for j in range(14))) for k in range(40)]
    docs = [(k, f"{rule} " + " ".join(word(k, j) for j in range(100, 130))) for k in range(200)] + [(999, items[7][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == {(999, 7)}
    entries = decontaminate.window_rows(bench.toDF("id", "text"), [5]).select(F.col("id").alias("item"), "hash", "template", F.col("pos").alias("item_pos"))
    n_item = entries.where("NOT template").groupBy("item").agg(F.count_distinct("item_pos").alias("n_item"))
    chosen = decontaminate.seeds(entries, n_item, 0.5)
    assert chosen.groupBy("hash").count().agg(F.max("count")).first()[0] == 1 and chosen.select("item").distinct().count() == 40


# --- toxicity -------------------------------------------------------------------


def toxic_set(spark, n=900):
    rng = np.random.default_rng(2)
    calm = [f"calm{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(calm, 8)) for _ in range(int(rng.integers(1, 9)))]
        bad = rng.random() < 0.2
        where = None
        if bad:
            where = int(rng.integers(len(sentences)))
            sentences[where] += " " + str(rng.choice(["Scoundrel", "rotter,", "knave"]))
        rows.append((i, ". ".join(sentences) + ".", where))
        if rng.random() < 0.8:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, bad_sentence int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_generalises_and_locates(spark):
    docs, labels = toxic_set(spark)
    found = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r.held_out} == set(held)
    assert np.mean([found[i].predicted == (truth[i].bad_sentence is not None) for i in held]) > 0.97
    for i, r in found.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        for s in r.sentences:
            assert re.search("scoundrel|rotter|knave", truth[i].text[s.start : s.end].lower())
    clean = toxicity.without_toxic(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in found.items() if not r.predicted}


def test_labels_of_held_out_ids_are_not_learnt(spark):
    docs, labels = toxic_set(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.detect(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_noisy_or_gradient():
    bag, instance, feature, toxic = np.array([0, 0, 1, 3]), np.array([0, 1, 2, 3, 3]), np.array([0, 1, 1, 0, 2]), np.array([1, 0, 1, 0])
    once = np.ones(4)
    w, bias, leak = toxicity.fit(bag, once, instance, feature, toxic, 3, rounds=500)
    p = 1 / (1 + np.exp(-(np.array([w[0], w[1], w[1], w[0] + w[2]]) + bias)))
    assert p[0] > 0.5 and p[1] < 0.3 and p[2] < 0.3 and p[3] < 0.5 and 0 < leak < 0.2
    # a set that two sentences hold counts as two sentences
    twice = toxicity.fit(np.array([0, 1]), np.array([2.0, 1.0]), np.array([0, 1]), np.array([0, 1]), np.array([1, 0]), 2)
    apart = toxicity.fit(np.array([0, 0, 1]), np.ones(3), np.array([0, 1, 2]), np.array([0, 0, 1]), np.array([1, 0]), 2)
    assert np.allclose(twice[0], apart[0]) and np.allclose(twice[1:], apart[1:])


MASK = (1 << 64) - 1


def mixed(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def word_and_prefixes(word):
    """Feature hashes of a word, byte by byte."""
    codes = [int(kernels.BYTE_CODES[b]) for b in word]
    power, total, h, out = 1, 0, 0, []
    for k, code in enumerate(codes):
        total = (total + code * power) & MASK
        power = power * 0x9E3779B97F4A7C15 & MASK
        h = (h + code) * 0x9E3779B97F4A7C15 & MASK
        if 3 <= k + 1 <= 8 and k + 1 < len(codes):
            out.append(mixed(h ^ (k + 1)))
    return {*out, mixed(total ^ (len(codes) * 0xD6E8FEB86659FD93 & MASK))}


def brute_score(text, model):
    weight = dict(zip(model.features.tolist(), model.weights))
    stay = 1 - model.leak
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = re.findall(rb"(?:[a-z0-9']|[\x80-\xff])+", sentence.encode())
        held = {f for w in words for f in word_and_prefixes(w) if f in weight}
        if held:
            stay *= 1 - 1 / (1 + np.exp(-(sum(weight[f] for f in held) + model.bias)))
    return 1 - stay


def test_scores_match_a_brute_force_noisy_or(spark, sf, messy):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = toxicity.known_labels(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "toxic")
    model = toxicity.train(docs, labels)
    assert len(model.features)
    for df in (docs, messy.select(F.col("doc_id").alias("id"), "text")):
        found = sorted((str(r.id), r.score) for r in toxicity.score(df, model).collect())
        expected = sorted((str(r.id), brute_score(r.text, model)) for r in df.collect())
        assert [i for i, _ in found] == [i for i, _ in expected] and np.allclose([x for _, x in found], [x for _, x in expected])


def test_rows_of_one_id_are_one_bag_when_learning(spark):
    texts = ["Calm words here. A knave spoke. A knave spoke.", "More calm words. A knave spoke"]
    features = toxicity.K.span_hashes(np.frombuffer(b"knave", np.uint8), np.array([0]), np.array([5]))
    with toxicity.Scratch(spark) as scratch:
        apart = toxicity.bags(spark.createDataFrame([(0, t) for t in texts] + [(1, None)], "doc long, text string"), features, scratch).collect()
    assert sorted((r.doc, r.features, r.times) for r in apart) == [(0, [], 2), (0, [0], 3), (1, [], 1)]
    docs, labels = toxic_set(spark, 300)
    twice = docs.union(docs.where("doc_id % 7 = 0"))
    found = toxicity.detect(twice, labels).collect()
    scores = collections.defaultdict(set)
    for r in found:
        scores[r.doc_id].add(r.score)
    assert len(found) == twice.count() and all(len(x) == 1 for x in scores.values())


def test_toxicity_of_messy_rows(spark, messy, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (4, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.detect(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.detect(no_documents, labels).count() == 0
    assert toxicity.detect(messy, labels.limit(0)).agg(F.max("score")).first()[0] < 0.3


# --- archive --------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/1", "<p>é 1</p>"), (2, "http://a/2", "<p>é 1</p>"), (9, None, None), (3, "http://b\r\nX: y", ""), (4, "u", "x\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", "x\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "<p>é 1</p>"), (7, "v", "y" * 300_000)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, header int")


def test_archive_round_trip(spark, pages):
    path = fresh_path(spark, "test-archive")
    warc.archive(pages, path)
    rows = warc.read_archive(spark, path).collect()
    texts = [(r.page_id, r.html or "") for r in pages.collect()]
    first = collections.defaultdict(list)
    for i, t in texts:
        first[t].append(i)
    smallest = {t: min((i for i in ids if i is not None), default=None) for t, ids in first.items()}
    assert len(rows) == len(texts)
    assert sorted((str(r.page_id), bytes(r.payload).decode()) for r in rows) == sorted((str(i), t) for i, t in texts)
    for r in rows:
        t = bytes(r.payload).decode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode() and r.payload_bytes == len(r.payload)
        assert r.refers_to == (str(smallest[t]) if r.record_type == "revisit" else None)
        assert bytes(r.header).endswith(b"\r\n\r\n") and bytes(r.header).count(b"\r\n\r\n") == 1
    assert sorted(r.page_id for r in rows if r.record_type == "response") == sorted(str(x) for x in smallest.values())
    assert spark.read.parquet(f"{path}/payloads").count() == len(smallest)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files_hold_the_records(spark, pages, compression):
    path = fresh_path(spark, "test-warc")
    warc.archive(pages, path)
    warc.write_warc(spark, path, path + "-files", records_per_file=3, compression=compression)
    read = sorted((bytes(r.header), bytes(r.block)) for r in warc.read_warc(spark, path + "-files").collect())
    rows = warc.read_archive(spark, path).collect()
    assert read == sorted((bytes(r.header), bytes(r.payload) if r.record_type == "response" else b"") for r in rows)


def test_a_changed_payload_is_found(spark, pages):
    path = fresh_path(spark, "test-broken")
    warc.archive(pages, path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary"))).write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, f"{path}-2").collect()


def test_a_length_that_does_not_fit_is_found(spark, pages):
    path = fresh_path(spark, "test-length")
    warc.archive(pages, path)
    longer = F.regexp_replace(F.col("header").cast("string"), "Content-Length: 0", "Content-Length: 1").cast("binary")
    spark.read.parquet(f"{path}/headers").withColumn("header", longer).write.parquet(f"{path}-2/headers")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{path}-2/payloads")
    with pytest.raises(Exception, match="no sound payload"):
        warc.read_archive(spark, f"{path}-2").collect()


def test_small_payloads_are_never_revisits(spark, pages):
    kinds = {r.page_id: r.record_type for r in warc.typed(warc.records(pages), least_bytes=11).collect()}
    assert set(kinds.values()) <= {"response", "revisit"} and kinds[5] == "revisit" and kinds[9] == kinds[3] == "response"


def test_empty_archive(spark, pages):
    path = fresh_path(spark, "test-none")
    warc.archive(pages.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


# --- sharding -------------------------------------------------------------------


def hilbert(cell, bits):
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        t ^= q - 1 if x[-1] & q else 0
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = 2 * out + ((v ^ t) >> b & 1)
    return out


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 3), (4, 2)])
def test_hilbert_index(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(*[((F.col("id") / (1 << (bits * k))).cast("long") % (1 << bits)).alias(f"c{k}") for k in range(n)])
    rows = sharding.with_hilbert_index(cells, [f"c{k}" for k in range(n)], bits, "h").collect()
    assert all(r.h == hilbert(list(r)[:n], bits) for r in rows) and len({r.h for r in rows}) == len(rows)
    path = sorted(rows, key=lambda r: r.h)
    assert all(sum(abs(a - b) for a, b in zip(list(p)[:n], list(q)[:n])) == 1 for p, q in zip(path, path[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, sf, messy, no_documents, law):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), messy):
        rows = sharding.shard_documents(df, 8, law).collect()
        sizes = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == sizes
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values()) and set(by) <= set(range(8))
        counts = [len(by[s]) for s in range(8)]
        if law == "rows":
            assert max(counts) - min(counts) <= 1
        else:
            total, most = sum(x[1] for x in sizes), max(x[1] for x in sizes)
            assert all(abs(sum(r["size"] for r in by[s]) - total / 8) <= most for s in range(8))
        order = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert all(a.cell <= b.cell for a, b in zip(order, order[1:]))
    assert sharding.shard_documents(no_documents, 8, law).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(messy, 8, "other")


def test_manifest_prunes_and_files_hold_their_shard(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    placed = sharding.shard_documents(df, 8)
    manifest = sharding.manifest(placed)
    level = placed.first()["level_source"]
    kept = {r.shard for r in sharding.prune(manifest, source=level).collect()}
    assert {r.shard for r in placed.where(F.col("level_source") == level).collect()} <= kept and len(kept) < 8
    path = fresh_path(spark, "test-shards")
    sharding.write(df, placed, path)
    back = {r.doc_id: (r.shard, r.slot, r.text) for r in spark.read.parquet(path).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    assert back == {r.doc_id: (r.shard, r.slot, texts[r.doc_id]) for r in placed.collect()}
    path = fresh_path(spark, "test-shards")
    sharding.write(df.withColumn("shard", F.lit("own")).withColumn("slot", F.lit(-1)), placed, path)
    again = {r.doc_id: (r._shard, r._slot, r.shard, r.slot) for r in spark.read.parquet(path).collect()}
    assert again == {r.doc_id: (r.shard, r.slot, "own", -1) for r in placed.collect()}


# --- mixing ---------------------------------------------------------------------


def water_fill(sizes, weights, budget):
    target = {s: 0.0 for s in sizes}
    open_ = set(sizes)
    left = budget
    while True:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > 2 * sizes[s]} if total else set()
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
        if not open_:
            return target
    for s in open_:
        target[s] = left * weights[s] / sum(weights[x] for x in open_)
    return target


def check_mix(df):
    rows = mixing.mix(df).collect()
    texts = df.collect()
    sizes = collections.Counter()
    for r in texts:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal = water_fill(sizes, weights, 1.5 * sum(sizes.values()))
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in texts)
    taken = collections.Counter()
    source = {r.doc_id: r.source for r in texts if r.doc_id is not None}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - goal[source[r.doc_id]]) < 1e-6 * max(1, r.target)
            taken[source[r.doc_id]] += r.taken
    return goal, taken, rows


def test_mix_meets_its_targets(spark, sf, messy, no_documents):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    goal, taken, rows = check_mix(df)
    assert all(abs(taken[s] - goal[s]) <= 0.1 * goal[s] for s in goal)  # ten documents a source
    larger, met, _ = check_mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert all(abs(met[s] - larger[s]) <= 1 for s in larger)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))
    check_mix(messy)
    assert mixing.mix(no_documents).count() == 0
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixing.mixed(messy).columns == messy.columns


def test_fit_is_exact_where_it_can_be():
    rng = np.random.default_rng(4)
    for _ in range(200):
        lengths = np.unique(rng.integers(0, 40, 8))
        counts = rng.integers(1, 6, len(lengths))
        total = int((lengths * counts).sum())
        sums = {0}
        for length, n in zip(lengths, counts):
            sums = {s + length * k for s in sums for k in range(n + 1)}
        budget = int(rng.integers(0, total + 1))
        taken = mixing.fit(lengths, counts, budget, 1)
        got = int((taken * lengths).sum())
        assert (taken >= 0).all() and (taken <= counts).all() and got <= budget
        # within the proportional part that is taken first, the rest is the best sum
        base = np.array([int(c) * budget // total if total else 0 for c in counts])
        rest = {0}
        for length, n in zip(lengths, counts - base):
            rest = {s + length * k for s in rest for k in range(n + 1)}
        assert budget == total or got == int((base * lengths).sum()) + max(s for s in rest if s <= budget - int((base * lengths).sum()))


def test_fit_of_large_budgets():
    rng = np.random.default_rng(6)
    lengths = np.arange(1, 3000)
    counts = rng.integers(1, 500, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    taken = mixing.fit(lengths, counts, budget, 3)
    assert (taken <= counts).all() and int((taken * lengths).sum()) == budget


# --- chat -----------------------------------------------------------------------


ODD = ["", "plain", "a <turn> b </turn>\n c", "\\", "\\l\\b\\n <", "line\n\nbreak", "\\### Assistant: </turn> ok", "<again>x</again>\n", "é漢😀" * 40]


def conversations(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(25):
        roles = ["system"] * int(rng.random() < 0.6) + ["user", "assistant"] * int(rng.integers(0, 9))
        rows += [(c, t, role, str(rng.choice(ODD)) + " word" * int(rng.integers(0, 30))) for t, role in enumerate(roles)]
    rows += [(90, None, "user", None), (90, 1, None, "x"), (90, 1, "assistant", "same"), (90, 1, "assistant", "same"), (None, 0, "assistant", "orphan"), (91, 0, "system", "only")]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, window int, pos int")


@pytest.mark.parametrize("budget,history,history_budget", [(512, 2, 128), (40, 2, 16), (30, 0, 0), (60, 3, 40)])
def test_chat_windows_read_back(spark, budget, history, history_budget):
    rows, df = conversations(spark, budget)
    windows = chat.format_windows(df, budget, history, history_budget)
    found = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    total = collections.Counter()
    for w in windows.collect():
        total[w.conv_id] += len(w.formatted)
        new = len(re.findall("<turn>", w.formatted))
        assert new == w.n_new
        words = sum(2 + len(WORD.findall(x)) for x in re.findall(r"<(?:turn|again)>[^\n]*\n(.*?)</(?:turn|again)>\n", w.formatted, re.S))
        assert words <= budget or new == 1 or w.window == 0 and w.formatted.startswith("<turn>system")
        if w.window and any(role == "system" and k == 0 for k, (_, role, _) in enumerate(sorted(by[w.conv_id]))):
            assert w.formatted.startswith("<again>system\n")
        assert len(re.findall("<again>", w.formatted)) <= history + 1
    assert all(found[c].formatted_chars == total[c] for c in by)
    assert budget == 512 or windows.where("window > 0").count() > 0


def test_tokens_of_a_column_cut_windows(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], "one long text without many words", n) for k, n in enumerate([20, 20, None, 90, 20])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    windows = chat.format_windows(df, 60, 0, 0, tokens_col="n").orderBy("window").collect()
    assert [w.n_new for w in windows] == [3, 1, 1] and chat.format_windows(df, 60, 0, 0).count() == 1


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in ODD + ["\\\\l", "\\n\n"]], "t string")
    assert all(r.t == r.u == r.v for r in df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape(chat.escape(F.col("t"), True)).alias("v")).collect())
    assert df.where(F.contains(chat.escape(F.col("t")), F.lit("<"))).count() == 0


def test_no_conversations(spark):
    _, df = conversations(spark)
    assert chat.format_windows(df.limit(0)).count() == 0


# --- pipeline and queries -------------------------------------------------------


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == columns, name
        path = fresh_path(spark, "test-stage")
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == sizes[3] and set(out.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    leaked = {r.doc_id for r in decontaminate.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert not ids & leaked


def test_pipeline_stages_take_messy_rows(spark, messy, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy, sf).count() >= 1, name
        assert stage(spark, messy.limit(0), sf).count() == 0, name


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = queries.queries()[name](spark, sf)
    rel = con.sql(queries.oracle_sql()[name])
    order = sorted(found.columns)
    assert order == sorted(rel.columns)

    def rows(frame):
        return sorted(json.dumps([None if pd.api.types.is_scalar(x) and pd.isna(x) else x for x in r], default=str) for r in frame[order].astype(object).values.tolist())

    assert rows(found.toPandas()) == rows(rel.df())


@pytest.mark.parametrize("number", [4, 9, 10])
def test_native_operators_run_no_python(spark, sf, number):
    name, query = next((k, q) for k, q in queries.queries().items() if k.startswith(f"op{number}_"))
    text = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InPandas" not in text and "InArrow" not in text, name
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_numbered_queries_are_registered():
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 14))
