"""The operators against brute force, round trips and their defined results."""

import collections
import gzip
import hashlib
import itertools
import math
import os
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vectorloom.llm import (
    arrays,
    chat,
    components,
    decontaminate,
    licenses,
    packing,
    perplexity,
    pivots,
    sharding,
    simhash,
    substrings,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(frame, *names):
    return {tuple(row) for row in frame.select(*names).collect()}


def make_docs(spark, texts, langs=None, sources=None):
    rows = [
        (i, text, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(text or ""))
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def random_words(seed, count, vocabulary=60):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(count)]


# Components


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    wanted = {(x, root(x)) for x in parent}
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert rows_of(found, "node", "component") == wanted


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6: SimHash


def slow_fingerprint(text):
    words = arrays.SPACED_WORD.findall(arrays.lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "Ää b c", "a b c d", "Été a b c d é f " * 40, "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def slow_components(pairs, max_bits):
    names = {}
    items = sorted(pairs)
    for i, fp in items:
        reach, todo = set(), [fp]
        while todo:
            x = todo.pop()
            if x not in reach:
                reach.add(x)
                todo += [y for _, y in items if bin(x ^ y).count("1") <= max_bits]
        names[i] = min(j for j, y in items if y in reach)
    return names


@pytest.mark.parametrize("limit", [4096, 6])
def test_near_links_span_all_links(spark, limit):
    draw = random.Random(5)
    seeds = [draw.getrandbits(64) for _ in range(12)]
    values = list(seeds)
    for _ in range(150):
        value = draw.choice(values if draw.random() < 0.5 else seeds[:2])
        for bit in draw.sample(range(64), draw.randrange(1, 6)):
            value ^= 1 << bit
        values.append(value)
    fps = sorted(set(values))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), limit=limit).collect()
    unsigned = [(a % (1 << 64), b % (1 << 64)) for a, b in links]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in unsigned)
    wanted = slow_components(list(enumerate(fps)), 4)
    groups = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    found = {row["node"] % (1 << 64): row["component"] for row in groups}
    together = collections.defaultdict(set)
    for i, fp in enumerate(fps):
        together[wanted[i]].add(found.get(fp, ("alone", fp)))
    assert all(len(names) == 1 for names in together.values())
    assert len({next(iter(n)) for n in together.values()}) == len(together)


def test_manhattan_distance_is_a_lower_bound():
    fps = np.array([random.Random(i).getrandbits(64) for i in range(300)], np.uint64)
    pops = simhash.popcounts(fps)
    for a, b in itertools.combinations(range(60), 2):
        low = sum(
            abs(bin(int(fps[a]) >> s & 3).count("1") - bin(int(fps[b]) >> s & 3).count("1"))
            for s in range(0, 64, 2)
        )
        assert int(np.bitwise_count(pops[a] ^ pops[b])) == low <= int(np.bitwise_count(fps[a] ^ fps[b]))


def test_near_groups_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["id"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.near_groups(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i: fp for i, (fp, _) in found.items()} == {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: c for i, (_, c) in found.items()} == slow_components([(i, fp) for i, (fp, _) in found.items()], 4)


def test_keep_first(spark):
    docs = make_docs(spark, ["a b c d e", "a b c d e", None, "", "other words here now"])
    docs = docs.unionByName(docs.where("doc_id = 0")).withColumn("fp", F.lit(1))
    kept = simhash.keep_first(docs, simhash.near_groups(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 0, 2, 4]
    assert simhash.near_groups(docs.limit(0)).count() == 0


# 9: repeated passages


def slow_repeats(texts, window):
    split = [arrays.SPACED_WORD.findall(t or "") for t in texts]
    seen = collections.Counter(
        tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1)
    )
    kept = []
    for words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept.append(" ".join(w for i, w in enumerate(words) if i not in gone))
    return kept


@pytest.mark.parametrize("chunk_chars", [300, 1_000_000])
def test_repeats(spark, chunk_chars):
    passage, other = random_words(1, 9, 1000), random_words(2, 30, 1000)
    texts = [" ".join(random_words(i, 20, 4)) for i in range(10, 20)]
    texts += [" ".join(random_words(i, 5, 999) + passage + random_words(i + 50, 4, 999)) for i in range(20, 30)]
    texts += [" \n".join(other[:20]), "  ".join(other[10:]), " ".join(other), None, "", "one", "a " * 3000]
    docs = make_docs(spark, texts).withColumn("_chunk", F.lit("clash"))
    marked = substrings.mark_repeats(docs, window=6, chunk_chars=chunk_chars, shard_chars=chunk_chars)
    found = {r["doc_id"]: (r["_kept"], r["_n_removed"], r["_n_words"]) for r in marked.collect()}
    kept = slow_repeats(texts, 6)
    for i, text in enumerate(texts):
        words, left = len((text or "").split()), len(kept[i].split())
        assert found[i] == (kept[i], words - left, words)
    paths = substrings.compact_paths(marked).collect()
    assert paths and all(p["verified"] for p in paths if p["occurrences"] == p["total"])
    by_layout = substrings.mark_repeats(docs, window=6, layout=True)
    for row in by_layout.select("doc_id", "_kept").collect():
        assert (row["_kept"] or "").split() == kept[row["doc_id"]].split()
    assert substrings.mark_repeats(docs.limit(0)).count() == 0


# 2: decontamination


def slow_hits(text, items, window):
    words = decontaminate.word_list(text)
    hit, names = set(), set()
    for item, passage in items:
        own = decontaminate.word_list(passage)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    names.add(item)
    return sorted(hit), sorted(n for n in names if n is not None)


@pytest.mark.parametrize("slice_chars", [40, 1_000_000])
def test_decontaminate(spark, slice_chars):
    draw = random.Random(3)
    items = [(str(i), " ".join(random_words(i, draw.randrange(0, 9), 12))) for i in range(12)]
    items += [("x", None), ("y", "SOLO"), (None, "w1 w2 w3 w4")]
    texts = [" ".join(random_words(100 + i, draw.randrange(0, 60), 12)) for i in range(40)]
    texts += [None, "", "a solo, word", "w1-W2_w3! w4"]
    docs = make_docs(spark, texts).withColumn("_hit_items", F.lit(7))
    table = spark.createDataFrame(items, "item_id string, text string")
    marked = decontaminate.mark_hits(docs, table, window=4, slice_chars=slice_chars)
    for row in marked.collect():
        wanted = slow_hits(texts[row["doc_id"]], items, 4)
        assert (row["_hit_words"], row["_hit_items"]) == wanted
    cut = decontaminate.mark_hits(docs, table, window=4, slice_chars=slice_chars, cut=True)
    for row in cut.collect():
        words = decontaminate.word_list(texts[row["doc_id"]])
        kept = [w for i, w in enumerate(words) if i not in set(row["_hit_words"])]
        assert decontaminate.word_list(row["text"]) == kept
    none = decontaminate.mark_hits(docs, table.limit(0))
    assert none.where("size(_hit_words) > 0").count() == 0 and none.count() == len(texts)
    assert decontaminate.drop_contaminated(marked, 0.01).where("size(_hit_words) > 0").count() == 0


# 8: licenses


def test_alignment():
    template = licenses.word_list(licenses.TEMPLATES["MPL-2.0"])
    noisy = [*template[:10], "new", *template[10:20], *template[22:]]
    matched = licenses.align(noisy, template)
    assert all(noisy[a] == template[b] for a, b in matched)
    assert len(matched) == len(template) - 2
    assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(matched))
    assert licenses.increasing([3, 1, 2, 5, 4, 6]) in ([1, 2, 4, 5], [1, 2, 3, 5])


def _longest_common(text, template):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(template) + 1)
    for word in text:
        last = 0
        for at, other in enumerate(template, 1):
            last, row[at] = row[at], last + 1 if word == other else max(row[at], row[at - 1])
    return row[-1]


def test_whole_license_texts(spark):
    def changed(name, seed):
        """A license as projects carry it: a holder, a year, other line ends and a few words of their own."""
        words = licenses.TEXTS[name].split()
        draw = random.Random(seed)
        for _ in range(len(words) // 25):
            words[draw.randrange(len(words))] = draw.choice(["Acme", "the", "Regents,", "2019"])
        lines = ["// " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        return "Copyright (c) 2019 Some Body\n" + "\r\n".join(lines)

    filler = "the software is provided with the above copyright notice in all copies of this file and code "
    names = list(licenses.TEXTS)
    texts = [filler * 40 + changed(name, seed) + "\n" + filler * 40 for seed in range(3) for name in names]
    texts += [changed("MIT", 1) + changed("MIT", 2) + changed("ISC", 3), filler * 3_000]
    half = licenses.TEXTS["MIT"].split()
    texts.append(" ".join(half[: len(half) // 2]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row["id"]: row["spans"] for row in licenses.scan_licenses(docs).collect()}
    for at in range(3 * len(names)):
        assert [span["license"] for span in found[at]] == [names[at % len(names)]]
        words, span = licenses.word_list(texts[at]), found[at][0]
        template = licenses.word_list(licenses.TEXTS[span["license"]])
        common = _longest_common(words[span["first_word"] : span["end_word"]], template) / len(template)
        # Patience alignment is not the longest alignment, but on such texts close to it, and never above.
        assert common - 0.03 <= span["coverage"] <= common
    rest = [[span["license"] for span in found[at]] for at in range(3 * len(names), len(texts))]
    assert rest == [["MIT", "MIT", "ISC"], [], []]


def test_license_scan_equals_alignment_everywhere(spark):
    draw = random.Random(9)
    texts = [None, "", "the license", "word " * 20_000 + "Released under the MIT License."]
    for text in licenses.TEMPLATES.values():
        words = text.split()
        for share in (0, 0.1, 0.3, 0.6):
            kept = [w for w in words if draw.random() >= share]
            texts.append(" ".join([*random_words(1, 30), *kept, *random_words(2, 30)]))
    texts.append("Released under the MIT License. Released under the MIT License.")
    docs = make_docs(spark, texts).withColumn("spans", F.lit(1))
    for row in licenses.scan_licenses(docs).collect():
        words = licenses.word_list(texts[row["id"]])
        wanted = set()
        for name, template in licenses.TEMPLATES.items():
            own = licenses.word_list(template)
            need = math.ceil(0.8 * len(own))
            reach = len(own) + len(own) // 4
            for i in range(0, len(words)) if len(words) < 1000 else range(len(words) - 60, len(words)):
                if len(licenses.align(words[i : i + reach], own)) >= need:
                    wanted.add(name)
        assert {s["license"] for s in row["spans"]} == wanted
    last = licenses.scan_licenses(docs).where(F.col("id") == len(texts) - 1).first()
    assert [(s["first_word"], s["end_word"]) for s in last["spans"]] == [(0, 5), (5, 10)]
    assert licenses.scan_licenses(docs, {"empty": "--"}).where("size(spans) > 0").count() == 0
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


# 10: chat


def test_chat_round_trip(spark):
    control = [*chat.CONTROL, "\\", "\\[INST]", " </s> ", "\n", "", "é", "[INST", "/INST]", "<</s>>"]
    draw = random.Random(4)
    rows = []
    for conv in range(150):
        for turn in range(draw.randrange(1, 6)):
            text = draw.choice(["", " "]).join(draw.choices(control, k=draw.randrange(0, 7)))
            role = draw.choice(["user", "assistant", "system", "tool", "x [SEP] y", "[/ROLE] ", None])
            rows.append((conv, turn, role, draw.choice([text, text, None])))
    rows += [(None, 0, "user", "a"), (None, None, "user", "b"), (7, 0, "user", "z"), (7, 0, "user", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    source = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        source[conv].append((turn is not None, turn or 0, role or "", text or ""))
    found = chat.format_chats(table.withColumn("plain", F.lit(0))).collect()
    assert len(found) == len(source)
    for row in found:
        wanted = [(r, t) for _, _, r, t in sorted(source[row["conv_id"]])]
        assert [tuple(t) for t in row["turns"]] == wanted and row["same"]
        said = "".join(t for r, t in wanted if r == "assistant")
        assert row["loss_text"] == said
    assert any(r["escaped"] for r in found) and not all(r["escaped"] for r in found)
    assert chat.format_chats(table.limit(0)).count() == 0


# 3: shards


def slow_shards(sizes, limit):
    def hashed(key):
        return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:12], 16)

    def split(keys, depth, bits):
        if sum(sizes[k] for k in keys) <= limit or depth == 48:
            return {k: bits for k in keys}
        halves = [[], []]
        for k in keys:
            halves[hashed(k) >> (47 - depth) & 1].append(k)
        return split(halves[0], depth + 1, bits + "0") | split(halves[1], depth + 1, bits + "1")

    return split(list(sizes), 0, "")


@pytest.mark.parametrize("limit", [50, 400, 1_000_000])
def test_shards_equal_recursive_splits(spark, limit):
    draw = random.Random(6)
    texts = ["é" * draw.randrange(0, 20) for _ in range(300)] + [None]
    docs = make_docs(spark, texts).withColumn("bytes", F.lit(0))
    found = sharding.assign_shards(docs, limit=limit).collect()
    wanted = slow_shards({i: len((t or "").encode()) for i, t in enumerate(texts)}, limit)
    assert {r["doc_id"]: r["shard"] for r in found} == {i: f"{bits}/0" for i, bits in wanted.items()}
    sums = collections.Counter()
    for row in found:
        sums[row["shard"]] += row["bytes"]
    assert all(r["shard_bytes"] == sums[r["shard"]] <= limit for r in found)


def test_shards_of_one_hot_key(spark):
    rows = [(1, "x" * 10)] * 40 + [(2, "y" * 10), (3, "z" * 100), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.assign_shards(docs, limit=35).collect()
    assert len(found) == len(rows)
    assert all(r["shard_bytes"] <= 35 or r["shard_rows"] == 1 for r in found)
    assert sharding.assign_shards(docs.limit(0)).count() == 0


# 4: pivots


def test_pivot_search_equals_brute_force(spark):
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(400, 6))
    vectors[50:90] = vectors[50]
    vectors[100:110] *= 30
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 4), (1100, [float("nan")] * 6), (1150, []), (1200, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    quantised = pivots.quantise(table, "vec_id", "embedding")
    found = pivots.top_k(quantised, quantised.where("id % 50 = 0"), 5, pivots=8)
    whole = np.floor(256 * vectors).astype(np.int64)
    wanted = set()
    for q in range(0, 400, 50):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:5]
        wanted |= {(q, rank, int(i), int(scores[i])) for rank, i in enumerate(order, 1)}
    assert rows_of(found, "query_id", "rank", "id", "score") == wanted
    assert pivots.top_k(quantised.limit(0), quantised.limit(0), 5).count() == 0
    few = quantised.where("id < 3")
    assert pivots.top_k(few, few.where("id = 0"), 5).count() == 2


# 5: WARC


def test_warc_round_trip(spark):
    payloads = ["", None, "a", "a", "x\r\n\r\ny\r", "WARC/1.1\r\n", "\r\n", "é\r\r\n", "a", "z" * 300_000, "line\n" * 5]
    rows = [(i, f"http://u/{i}\r\nX: y" if i % 3 else None, p) for i, p in enumerate(payloads)]
    rows += [(None, "u", "a"), (None, None, "lonely"), (2, "again", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    pages = pages.withColumn("payload", F.lit("clash"))
    first = warc.write_archives(warc.responses(pages))
    plain = warc.read_archives(spark, first).collect()
    assert sorted((r["payload"], r["page_id"] is None) for r in plain) == sorted(
        ((p or ""), i is None) for i, _, p in rows
    )
    again = warc.read_archives(spark, warc.deduplicate(first))
    found = warc.resolve(again).collect()
    assert len(found) == len(rows)
    responses = [r for r in found if r["record_type"] == "response"]
    assert len({r["payload_digest"] for r in responses}) == len(responses) == len({p or "" for p in payloads}) + 1
    for row in found:
        if row["record_type"] == "revisit":
            assert row["refers_to"] == (2 if row["payload_bytes"] else 0)
    assert {r["page_id"] for r in responses if r["payload_bytes"] == 1} == {2}
    kept = warc.resolve(warc.read_archives(spark, warc.deduplicate(first, min_bytes=2)))
    assert kept.where("record_type = 'revisit'").count() == 0
    empty = warc.write_archives(warc.responses(pages.limit(0)))
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_records_are_read_in_few_pieces_and_checked_without_payloads(spark, tmp_path):
    payloads = ["\r\n" * n + "x" + "\r\n" * m for n in range(4) for m in range(5)] + ["\r", "a\r\n\r", "\n\r\n"]
    pages = spark.createDataFrame(list(enumerate(payloads)), "page_id long, html string").withColumn("url", F.lit("u"))
    path = warc.write_archives(warc.responses(pages.coalesce(1)))
    found = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path).collect()}
    assert found == dict(enumerate(payloads))
    heads = warc.read_archives(spark, path, payloads=False).collect()
    assert all(r["payload"] is None for r in heads)
    assert {(r["page_id"], r["payload_bytes"]) for r in heads} == {(i, len(p)) for i, p in enumerate(payloads)}

    stream = b""
    for file in (f for f in os.listdir(path) if f.endswith(".gz")):
        with gzip.open(f"{path}/{file}") as source:
            stream += source.read()
    reader = warc._Reader()
    records = [record for piece in stream.split(b"\r\n\r\n") for record in reader.feed(piece)]
    assert [record[4].decode() for record in records] == payloads

    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.gz").write_bytes(gzip.compress(stream[:-20]))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, str(cut), payloads=False).collect()


# 1: perplexity


def slow_model(texts, trusted):
    """The probabilities of the model by plain counting."""
    counts = collections.Counter(w for t, good in zip(texts, trusted, strict=True) if good for w in (t or "").split())
    words = sorted(counts)
    pairs = collections.Counter()
    for t, good in zip(texts, trusted, strict=True):
        own = ["<start>", *(t or "").split()]
        if good and len(own) > 1:
            pairs.update(zip(own[:-1], own[1:], strict=True))

    def cuts(numbers):
        n = [sum(c == i for c in numbers) for i in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [0, *(min(max(v, 0), i) for i, v in enumerate(raw, 1))]

    followers = collections.Counter(b for _, b in pairs)
    high, low = cuts(pairs.values()), cuts(followers.values())
    total = sum(followers.values())
    share = sum(low[min(c, 3)] for c in followers.values()) / total / (len(words) + 1)

    def lowest(w):
        return max(followers[w] - low[min(followers[w], 3)], 0) / total + share

    def log_prob(text, own):
        seq = ["<start>", *text.split()]
        mine = collections.Counter(zip(seq[:-1], seq[1:], strict=True)) if own else {}
        result = 0.0
        for a, b in zip(seq[:-1], seq[1:], strict=True):
            after = {k: c for k, c in pairs.items() if k[0] == a}
            seen = sum(after.values())
            gamma = sum(high[min(c, 3)] for c in after.values()) / seen if seen else 1.0
            left = pairs[(a, b)] - mine.get((a, b), 0)
            top = max(left - high[min(max(left, 0), 3)], 0) / max(seen, 1)
            result += math.log(top + gamma * lowest(b))
        return result

    return log_prob


@pytest.mark.parametrize("frequent", [perplexity.FREQUENT, 9, 0])
def test_perplexity_equals_plain_counting(spark, frequent):
    texts = [" ".join(random_words(i, 40, 25)) for i in range(40)] + ["w1 zz yy w2", None, "", "w1 " * 400, "w1 w2 " * 70_000]
    labels = [(i, 1, 0) for i in range(20)] + [(20, 0, 0), (21, 1, 1), (22, 1, None), (23, None, 0), (24, 1, 0), (24, 0, 0)]
    trusted = [i < 20 or i == 22 for i in range(len(texts))]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make_docs(spark, texts, ["en" if i % 2 else None for i in range(len(texts))])
    found = {r["doc_id"]: r for r in perplexity.classify(docs, table, size=frequent).collect()}
    log_prob = slow_model(texts, trusted)
    assert {i for i, r in found.items() if r["trusted"]} == {i for i, t in enumerate(trusted) if t}
    for i, text in enumerate(texts):
        if text:
            wanted = math.exp(-log_prob(text, trusted[i]) / len(text.split()))
            assert found[i]["perplexity"] == pytest.approx(wanted, rel=1e-9)
        else:
            assert found[i]["perplexity"] is None and not found[i]["rejected"]
    kept = perplexity.keep_good(docs, perplexity.classify(docs, table.limit(0)))
    assert kept.count() == len(texts)
    assert perplexity.classify(docs.limit(0), table).count() == 0


def test_perplexity_in_many_shards_and_slices_leaves_no_shuffle_files(spark, monkeypatch):
    texts = [" ".join(random_words(i, 40, 25)) for i in range(40)] + [None, "", "w1\x1cw2 w3\u00a0w4\x0bw5 é"]
    table = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = make_docs(spark, texts)
    monkeypatch.setattr(perplexity, "SHARD_CHARS", 500)
    stored, key = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffled():
        blocks = stored.getAllFiles()
        return {n for i in range(blocks.size()) if (n := blocks.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(key)
    judged = perplexity.classify(docs, table, size=9)
    assert spark.conf.get(key) == setting
    for _ in range(50):  # files are removed in the background
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    found = {r["doc_id"]: r for r in judged.collect()}
    log_prob = slow_model(texts, [i < 20 for i in range(len(texts))])
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        words = perplexity.words_of(text and text.encode())
        assert found[i]["n_words"] == len(words)
        if words and i < 40:
            assert found[i]["perplexity"] == pytest.approx(math.exp(-log_prob(text, i < 20) / len(words)), rel=1e-9)


def test_classifier_tells_junk_from_prose(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = perplexity.classify(docs, labels).join(labels, "doc_id").toPandas()
    clean = judged[judged.toxic == 0]
    assert clean[clean.quality == 1].rejected.mean() < 0.05
    assert clean[clean.quality == 0].rejected.mean() > 0.4
    assert judged[judged.toxic == 1].rejected.mean() > 0.7


def test_toxic_words_are_evidence_and_columns_may_clash(spark):
    texts = [" ".join(random_words(i, 60, 30)) for i in range(120)]
    texts[100:110] = [f"{t} vile {t} nasty" for t in texts[100:110]]
    docs = make_docs(spark, texts).withColumns({"trusted": F.lit("x"), "place": F.lit(1), "toxic": F.lit(None)})
    labels = [(i, 1, int(i >= 100)) for i in range(105)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in perplexity.classify(docs, table).collect()}
    assert {i for i, r in found.items() if r["toxicity"] > 0} == set(range(100, 110))
    assert all(found[i]["rejected"] for i in range(100, 110))
    assert sum(r["rejected"] for r in found.values()) <= 12


# 7: packing


def slow_place(rows, capacity):
    bins = []
    placed = []
    for doc, source, cluster, words in sorted(rows, key=lambda r: -r[3]):
        fits = [
            (capacity - sum(x[3] for x in b), i)
            for i, b in enumerate(bins)
            if capacity - sum(x[3] for x in b) >= words
            and all(x[1] != source or source is None for x in b)
            and all(x[2] != cluster or cluster is None for x in b)
        ]
        number = min(fits)[1] if fits else len(bins)
        if number == len(bins):
            bins.append([])
        bins[number].append((doc, source, cluster, words))
        placed.append((doc, number))
    return placed


def test_best_fit_equals_full_search():
    draw = random.Random(2)
    rows = [
        (i, draw.choice([None, "a", "a", "a", "b", "c", "d"]), draw.choice([None, 1, 2, i + 10]), draw.randrange(1, 100))
        for i in range(300)
    ]
    found = [(doc, number) for doc, _, _, _, number, _ in packing.pack_batch(rows, 100)]
    assert found == slow_place(rows, 100)


def test_packing_keeps_bounds_and_conflicts(spark):
    texts = [" ".join(random_words(i, i % 90, 50)) for i in range(200)] + ["a b"] * 9 + [None, "", "w " * 1000]
    docs = make_docs(spark, texts, sources=[None if i % 11 == 0 else f"s{i % 4}" for i in range(len(texts))])
    found = packing.pack_documents(docs.withColumn("cluster", F.lit(1)), capacity=128, batch_rows=50).collect()
    words = collections.Counter()
    bins = collections.defaultdict(list)
    for row in found:
        words[row["doc_id"]] += row["n_words"]
        if row["bin_id"] is not None:
            bins[row["bin_id"]].append(row)
    assert dict(words) == {i: len((t or "").split()) for i, t in enumerate(texts)}
    for members in bins.values():
        assert sum(r["n_words"] for r in members) <= 128
        sources = [f"s{r['doc_id'] % 4}" for r in members if r["doc_id"] % 11]
        assert len(sources) == len(set(sources))
        said = [texts[r["doc_id"]] for r in members]
        assert len(said) == len(set(said))
        assert sorted(r["position"] for r in members) == list(range(len(members)))
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lang", ["xx", None])
def test_language_of_one_trusted_document_keeps_its_prose(spark, lang):
    draw = random.Random(11)

    def prose(prefix, size):
        return " ".join(f"{prefix}{draw.randrange(40)}" for _ in range(size))

    texts = [prose("e", draw.randrange(30, 200)) for _ in range(150)] + [prose("x", 80) for _ in range(12)]
    docs = make_docs(spark, texts, ["en"] * 150 + [lang] * 12)
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in [*range(120), 150]], "doc_id long, quality int, toxic int"
    )
    rare = perplexity.classify(docs, labels).where("doc_id >= 150").collect()
    assert [r["doc_id"] for r in rare if r["rejected"]] == []
    assert len({r["perplexity"] for r in rare}) > 1
