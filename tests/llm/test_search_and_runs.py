"""Ranked search, order-sensitive fingerprints and runs against brute force, and their defined results."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import ordermin, packing, periods, pivots, queries, ranked, substrings

DOCS = "doc_id long, text string, rank int, item string"


def make_docs(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, text, 1, "x") for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def random_text(draw, words, vocabulary):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


# Ranked search


def brute_ranking(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})
    terms = lambda text: [t.translate(lower) for t in term.findall(text or "")]
    held = [(i, terms(text)) for i, text in docs if i is not None]
    held = [(i, found, collections.Counter(found)) for i, found in held if found]
    texts, total = len(held), sum(len(found) for _, found, _ in held)
    df = collections.Counter(t for _, _, counts in held for t in counts)
    answer = []
    for item, text in items:
        scores = []
        for i, found, counts in held:
            m = 100 - 90 + (90 * len(found) * texts) // total
            score = sum(
                math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in set(terms(text))
                if t in counts
            )
            if score > 0:
                scores.append((-score, i))
        answer += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(answer)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranked_search_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ranked, "FIRST_STEP", 1)
    monkeypatch.setattr(ranked, "SHARD_TEXTS", 16)
    draw = random.Random(seed)
    texts = [random_text(draw, draw.choice([0, 1, 3, 30, 200]), draw.choice([5, 60, 500])) for _ in range(120)]
    texts += ["Wort GRÖSSE w1", None, "", " .,; ", texts[3], texts[3], "w1 " * 3000]
    items = [(n, random_text(draw, draw.choice([0, 1, 4, 25]), 80)) for n in range(12)]
    items += [(50, None), (51, "W1, w1! größe"), (52, "nowhere"), (2, items[2][1]), (53, "w1 w2 w3 w1")]
    docs = make_docs(spark, texts)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = ranked.search_items(docs, asked, slice_chars=600)  # several slices
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    wanted = brute_ranking(list(enumerate(texts)), items, 10)
    assert sorted(map(tuple, got.collect())) == wanted


def test_ranked_search_ties_nulls_and_empty_tables(spark):
    docs = make_docs(spark, ["same words"] * 14 + ["other"] * 30 + ["same"], [*range(14, 0, -1), *range(20, 50), None])
    items = spark.createDataFrame([(None, "same"), (1, "same other")], "item_id long, text string")
    rows = ranked.search_items(docs, items).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["item_id"] is None] == list(range(1, 11))
    assert sorted(r["rank"] for r in rows if r["item_id"] == 1) == list(range(1, 11))
    assert ranked.search_items(docs.limit(0), items).collect() == []
    assert ranked.search_items(docs, items.limit(0)).collect() == []


def test_search_stops_before_the_ends_of_the_lists():
    draw = np.random.default_rng(5)
    ids = np.arange(20_000)
    lists = []
    for held in (20_000, 9_000, 50):
        docs = draw.choice(20_000, held, replace=False)
        values = np.sort((1e6 / draw.integers(1, 5000, held)).astype(np.int64))[::-1]
        lists.append((docs, values))
    best = ranked.Best(10)
    met = ranked.search_lists(lists, ids, best)
    total = np.zeros(20_000, np.int64)
    for docs, values in lists:
        total[docs] += values
    order = np.lexsort((ids, -total))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == total[order].tolist()
    assert met < 5_000


def test_impacts_beyond_long_products():
    lengths, counts = np.array([3_000_000, 7]), np.array([5, 1])
    texts, terms = 10**11, 5 * 10**13
    wanted = [10**9 * c // (1000 * c + 8 * (10 + 90 * n * texts // terms)) for n, c in zip(lengths.tolist(), counts.tolist())]
    assert ranked.impacts(lengths, counts, texts, terms).tolist() == wanted


# Order-sensitive fingerprints


def brute_fingerprint(text, k=3, parts=64, chosen=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return "0" * 4 * parts
    checks = [zlib.crc32(w.encode()) for w in words] + [0] * k
    n = max(len(words) - k, 0) + 1
    bits, low = n.bit_length(), (1 << 60) - 1
    factors = [(ordermin.GOLDEN * (2 * j + 1)) % (1 << 28) | 1 for j in range(k)]
    hashes = [sum(checks[i + j] * factors[j] for j in range(k)) & low for i in range(n)]
    seen = collections.Counter()
    values = []
    for i, h in enumerate(hashes):
        number = seen[h >> bits]
        seen[h >> bits] += 1
        told = (h + (((number * ordermin.GOLDEN) & ((1 << 30) - 1)) << 30)) & low
        values.append((told >> bits, i))
    values.sort()
    full = [(v << bits) | (i + 1) for v, i in values]
    found = ""
    for part in range(parts):
        at = next((r for r, v in enumerate(full) if v >= part << 54), 0)
        places = sorted(values[(at + c) % n][1] for c in range(chosen))
        found += hashlib.md5(",".join(str(hashes[p]) for p in places).encode()).hexdigest()[:4]
    return found


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_fingerprints_and_edits_equal_brute_force(spark):
    draw = random.Random(4)
    texts = [random_text(draw, draw.choice([0, 1, 2, 3, 4, 40, 300]), draw.choice([2, 9, 400])) for _ in range(40)]
    texts += [None, "", " \t\n", "ß😀 ü é x y", "a " * 500, texts[5], "one two  three\n"]
    ids = [3 * (i * 7 % len(texts)) for i in range(len(texts))]
    got = {r["doc_id"]: r for r in ordermin.edited_fingerprints(make_docs(spark, texts, ids)).collect()}
    order = sorted(zip(ids, [t or "" for t in texts]))
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        row = got[i]
        assert row["text"] == text and row["edited"] == edited(text, after)
        prints = [brute_fingerprint(t) for t in (text, row["edited"], after)]
        assert [row["fingerprint"], row["edited_fingerprint"], row["next_fingerprint"]] == prints
        for name, other in (("near_edited", prints[1]), ("near_next", prints[2])):
            same = sum(prints[0][j : j + 4] == other[j : j + 4] for j in range(0, 256, 4))
            assert row[name] == same / 64


def test_likeness_falls_with_order_and_edits(spark):
    draw = random.Random(8)
    words = [f"w{draw.randrange(3000)}" for _ in range(3000)]
    texts = {
        "whole": words,
        "few": [w if draw.random() > 0.005 else "new" for w in words],
        "moved": words[1500:] + words[:1500],
        "other": [f"v{w}" for w in words],
    }
    rows = spark.createDataFrame([(n, " ".join(t)) for n, t in texts.items()], "name string, text string")
    marked = ordermin.with_fingerprint(rows, "text", "fp")
    whole = marked.where("name = 'whole'").select(F.col("fp").alias("base"))
    near = {r["name"]: r["n"] for r in marked.crossJoin(whole).select("name", ordermin.likeness("fp", "base").alias("n")).collect()}
    assert near["whole"] == 1 and near["other"] == 0
    # Swapped halves keep nearly all k-mers, but about half of the pairs change their order.
    assert near["few"] > 0.8 and 0.25 < near["moved"] < 0.75


def test_edits_of_one_row_of_repeated_ids_and_of_none(spark):
    docs = make_docs(spark, ["one two three four", "five six", "seven"], [9, 9, None])
    rows = ordermin.edited_fingerprints(docs).collect()
    assert sorted(r["text"] for r in rows) == ["five six", "one two three four", "seven"]
    assert next(r for r in rows if r["doc_id"] is None)["edited"] == "sevon"
    single = ordermin.edited_fingerprints(docs.limit(1)).first()
    assert single["near_next"] == 1.0
    assert ordermin.edited_fingerprints(docs.limit(0)).collect() == []


def test_fingerprint_of_a_very_long_text(spark):
    draw = random.Random(1)
    text = random_text(draw, 200_000, 50_000)
    docs = spark.createDataFrame([(text,), (text,)], "text string")
    prints = {r["fp"] for r in ordermin.with_fingerprint(docs, "text", "fp").collect()}
    assert len(prints) == 1 and len(prints.pop()) == 256


# Runs


def brute_runs(words):
    n, found, known = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                if length >= max(6, 4 * q) and (i, length) not in known:  # else a smaller period
                    known.add((i, length))
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    draw = random.Random(seed)
    total = 0
    for n in range(150):
        vocabulary = draw.choice([1, 2, 3, 10, 50])
        words = [draw.randrange(vocabulary) for _ in range(draw.randrange(400))]
        for _ in range(draw.randrange(4)):
            if len(words) > 20:
                a = draw.randrange(len(words) - 10)
                p = draw.randrange(1, max(2, (len(words) - a) // 3))
                for i in range(a + p, draw.randrange(a, len(words))):
                    words[i] = words[i - p]
        if n % 10 == 0:  # runs within runs
            root = [draw.randrange(3) for _ in range(draw.randrange(1, 6))] * 5
            words = (root + [9]) * draw.randrange(1, 40)
        wanted = brute_runs(words)
        assert periods.runs_of(np.array(words, np.int64)) == wanted
        total += len(wanted)
    assert total > 100


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_marked_runs_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(periods, "SCAN_WORDS", 100)
    draw = random.Random(3)
    texts = [random_text(draw, draw.choice([0, 1, 30, 90]), draw.choice([1, 2, 200])) for _ in range(60)]
    long = random_text(draw, 700, 5000)
    texts += [None, "", " \n ", f"{long} " * 30, texts[7], "a b a b a b\ta b", "Ä Ä Ä Ä Ä Ä"]
    marked = periods.mark_runs(make_docs(spark, texts).withColumn("_runs", F.lit("clash")))
    assert marked.columns == ["doc_id", "text", "rank", "item", "_n_words", "_runs", "_collapsed"]
    rows = {r["doc_id"]: r for r in marked.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [(0, 21_000, 700)] if text and text.startswith(long) else brute_runs(words)
        assert [tuple(r) for r in rows[i]["_runs"]] == runs
        assert rows[i]["_n_words"] == len(words) and rows[i]["_collapsed"] == collapsed(words, runs)
    assert periods.mark_runs(make_docs(spark, ["a"]).limit(0)).collect() == []


def test_op13_on_the_documents(spark, folder):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periods"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc, text in docs:
        original = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words, h, n = list(original), zlib.crc32(str(doc).encode()), len(original)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [original[i] if i < a else original[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(words) if n < 2500 else None
        row = got[doc]
        if runs is None:
            runs = periods.runs_of(np.unique(words, return_inverse=True)[1].astype(np.int64))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        wanted = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == wanted
        assert row["n_runs"] == len(runs)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5


# Earlier operators on rows that repeat


def test_pivot_search_of_repeated_ids_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (0, [-1.0, 2.5]), (50, [2.0e7, 1.0]), (7, [-3.0e7, 4.0]), (8, [0.5, 0.5]), (9, [1e300, 0.0])]
    rows += [(10, [2.0e15, 3.0e15]), (11, [-2.0e15, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    quantised = pivots.quantise(table, "vec_id", "embedding")
    asked = quantised.where("id % 50 = 0")
    found = pivots.top_k(quantised, asked, 3, pivots=3).collect()
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i != 9]
    wanted = []
    for query, q in vectors:
        if query % 50 == 0:
            scores = [(max(-(2**63 - 1), min(2**63 - 1, q[0] * v[0] + q[1] * v[1])), i) for i, v in vectors if i != query]
            best = sorted(scores, key=lambda hit: (-hit[0], hit[1]))[:3]
            wanted += [(query, n + 1, i, score) for n, (score, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_equal_rows_are_dealt_to_many_chunks(spark):
    draw = random.Random(2)
    passage = random_text(draw, 45, 4000)
    rows = [(1, passage)] * 2000 + [(i, random_text(draw, 50, 4000)) for i in range(2, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = substrings.mark_repeats(docs, chunk_chars=20_000, shard_chars=50_000).collect()
    assert len(marked) == len(rows)
    assert all((r["_kept"] == "") == (r["doc_id"] == 1) for r in marked)
    assert {s["total"] for r in marked for s in r["_spans"]} == {2000}


def test_counts_beyond_sixteen_bits(spark):
    docs = spark.createDataFrame([(1, "la " * 70_000), (2, "la " * 3000 + "so"), (3, "so so")], "doc_id long, text string")
    marked = {r["doc_id"]: r for r in substrings.mark_repeats(docs).collect()}
    assert {s["total"] for s in marked[1]["_spans"]} == {70_000 - 34 + 3000 - 34}
    assert marked[2]["_kept"] == "so" and marked[3]["_kept"] == "so so"


def test_rows_without_an_id_are_packed_in_many_tasks(spark):
    texts = [f"text {i} " * (1 + i % 40) for i in range(3000)]
    docs = spark.createDataFrame([(None if i % 3 else 5, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    packed = packing.pack_documents(docs, batch_rows=50)
    assert packed.count() == 3000
    tasks = packed.groupBy(F.shiftright("bin_id", 40).alias("task")).count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 1500
