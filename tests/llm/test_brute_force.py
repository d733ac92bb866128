"""Operators against plain brute-force versions on small fixtures."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tables import documents, prose
from tokenizers import Tokenizer

from netlens.llm import decontaminate, fingerprint, graph, langid, near_dedup, packing, pii, quality, substring, toxicity
from netlens.llm.queries import QUERIES

LETTERS = decontaminate.LETTERS
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# Decontamination ----------------------------------------------------------------


def brute_hits(text, items, width):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    w = words(text)
    hit, ids = set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(width, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                ids.add(str(item_id))
    return len(w), sorted(hit), sorted(ids)


@pytest.mark.parametrize("letters", [LETTERS, "ab"])
def test_decontamination(spark, letters, monkeypatch):
    """Also with codes of many letters, where matches may begin inside a code."""
    monkeypatch.setattr(decontaminate, "LETTERS", letters)
    rng = random.Random(5)
    items = [(i, prose(100 + i, rng.randrange(1, 30), 40)) for i in range(12)] + [(12, "Éa, the THE"), (13, items_text := prose(100, 25, 40)), (1, items_text)]
    texts = [prose(i, rng.randrange(0, 80), 40) for i in range(30)]
    for i in range(0, 30, 3):
        texts[i] += "; " + items[i % 13][1].upper().replace("É", "É") + " ," + texts[i][:20]
    texts += [None, "", "éa THE the Éa (the) the", texts[0], texts[0]]
    docs = documents(spark, texts)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan(docs, table, 4).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, hit, ids = brute_hits(text, items, 4)
        assert (got[i]["n_words"], got[i]["hit"], got[i]["items"]) == (n, hit, ids)
        covered = " ".join(text[s["start"] : s["end"]] for s in got[i]["spans"]) if text else ""
        assert sum(s["end"] > s["start"] for s in got[i]["spans"]) == len(got[i]["spans"])
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", covered)) == len(hit)
    clean = {r["doc_id"] for r in decontaminate.keep_clean(docs, table, 4).collect()}
    assert clean == {i for i, t in enumerate(texts) if not brute_hits(t, items, 4)[1]}


def test_one_scan_however_many_windows(spark):
    items = spark.createDataFrame([(i, prose(i, 400, 5_000)) for i in range(100)], "item_id long, text string")
    plan = decontaminate.keep_clean(documents(spark, ["a"]), items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    sent = decontaminate.windows_of(items).value
    assert len(sent.rows) == 100 * 391 and {len(w) for w, _, _ in sent.rows} == {20}


# Fingerprints -------------------------------------------------------------------


def brute_fingerprint(text, k, bins, depth, hashed):
    """Sketches as sets of tuples, with a hash given by the test."""
    words = text.split(" ")
    grams = [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    seen, out = {}, {}
    for place, gram in enumerate(grams):
        number = seen[gram] = seen.get(gram, -1) + 1
        v = hashed[gram, number]
        out.setdefault(v % bins, []).append((v, place))
    circle = [(v, place) for b in sorted(out) for v, place in sorted(out[b])]
    found, at = {}, 0
    for b in range(bins):
        taken = [circle[(at + j) % len(circle)] for j in range(min(depth, len(circle)))]
        found[b] = tuple(v for v, _ in sorted(taken, key=lambda x: x[1]))
        at += len(out.get(b, []))
    return found


def test_fingerprint_follows_its_definition(spark):
    texts = [prose(1, 200, 20), prose(2, 3), "", "a", "a b", "a b c d", prose(3, 500, 6), "b a " * 40]
    k, bins, depth = 3, 16, 2
    grams = set()
    for t in texts:
        w, seen = t.split(" "), {}
        for i in range(max(1, len(w) - k + 1)):
            g = tuple(w[i : i + k])
            seen[g] = seen.get(g, -1) + 1
            grams.add((g, seen[g]))
    rows = spark.createDataFrame([(list(g), n) for g, n in grams], "g array<string>, n int")
    inner = F.xxhash64(*[F.xxhash64(F.get("g", F.lit(j))) if False else F.when(F.size("g") > j, F.xxhash64(F.get("g", F.lit(j)))) for j in range(k)])
    hashed = {(tuple(r["g"]), r["n"]): r["h"] for r in rows.select("g", "n", F.xxhash64(inner, F.col("n")).alias("h")).collect()}
    got = documents(spark, texts).select("doc_id", fingerprint.fingerprint(F.col("text"), k, bins, depth).alias("fp")).collect()
    want = {i: brute_fingerprint(t, k, bins, depth, hashed) for i, t in enumerate(texts)}
    tuples = sorted({s for w in want.values() for s in w.values()})
    sig = spark.createDataFrame([(list(t),) for t in tuples], "t array<long>").select("t", F.xxhash64("t").bitwiseAND(65535).alias("s"))
    short = {tuple(r["t"]): r["s"] for r in sig.collect()}
    for r in got:
        assert r["fp"] == [b * 65536 + short[s] for b, s in sorted(want[r["doc_id"]].items())]


def test_order_counts_in_short_texts(spark):
    """Half replaced: about half alike; halves swapped: less alike than equal, at any length."""
    for n in (20, 40, 80, 400):
        pairs = []
        for seed in range(60):
            w, other = prose(seed, n, 100_000).split(), prose(1_000 + seed, n, 100_000).split()
            pairs += [(n, "half", " ".join(w), " ".join(w[: n // 2] + other[n // 2 :])), (n, "swap", " ".join(w), " ".join(w[n // 2 :] + w[: n // 2]))]
        df = spark.createDataFrame(pairs, "n int, kind string, a string, b string")
        like = fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b")))
        mean = {r["kind"]: r["x"] for r in df.groupBy("kind").agg(F.avg(like).alias("x")).collect()}
        assert 0.28 < mean["half"] < 0.6 and 0.5 < mean["swap"] < 0.9, (n, mean)


@pytest.mark.parametrize("ids", [[*range(500), 1 << 60], [s << 40 | c for s in range(20) for c in range(100)], [7] * 900 + list(range(600)), [-(1 << 63), (1 << 63) - 1, 0, 5]])
def test_buckets_of_ids_stay_small_and_in_order(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 8)
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    found = df.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / 64) for i in range(65)])).alias("q"), F.count("*").alias("n")).first()
    bucket = fingerprint.bucket_of(found["q"], found["n"], F.col("doc_id"), F.xxhash64("text"))
    rows = df.select("doc_id", F.xxhash64("text").alias("h"), bucket.alias("b")).orderBy("doc_id", "h").collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    assert max(Counter(r["b"] for r in rows).values()) <= 40
    if len(ids) < 2_000:
        edits = fingerprint.with_edits(df).select("edited").count()
        assert edits == len(ids)


def test_edits_and_neighbours(spark):
    texts = {i * 37 % 1000 - 50: prose(i, 5 + i % 60) + "é" * (i % 3) for i in range(700)} | {7_000_000: "", 7_000_001: "abc"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.with_edits(docs).collect()}
    assert len(got) == len(texts)
    for i, doc_id in enumerate(order):
        text, after = texts[doc_id], order[(i + 1) % len(order)]
        half = len(text) // 2
        assert got[doc_id]["edited"] == text[: len(text) - half] + texts[after][:half]
        assert got[doc_id]["n_chars"] == len(text)
        assert got[doc_id]["next_fingerprint"] == got[after]["fingerprint"]


def test_likeness_falls_with_edits(spark):
    base = prose(11, 2_000, 5_000).split(" ")
    texts = [" ".join(base[:n] + prose(12, 2_000 - n, 90_000).split(" ")) for n in (2_000, 1_600, 1_000, 0)]
    moved = " ".join(base[1_000:] + base[:1_000])
    docs = documents(spark, [*texts, moved])
    fp = fingerprint.fingerprint(F.col("text"))
    one = docs.where("doc_id = 0").select(fp.alias("a"))
    got = {r["doc_id"]: r["x"] for r in docs.withColumn("b", fp).crossJoin(one).select("doc_id", fingerprint.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got[0] == 1.0 and got[3] < 0.1
    assert abs(got[1] - 0.8) < 0.15 and abs(got[2] - 0.5) < 0.2
    assert got[4] < 1.0  # the same words in another order


# PII ----------------------------------------------------------------------------


def test_base_patterns():
    card = "4000 0000 0000 0002"
    text = f"mail a.b@c-d.example.org_x@y.zz or @no.pe; 10.0.0.255 1.2.3.256 01.02.03.004.5; {card}, 4000000000000003, +1 (202) 555-0143 +12 345"
    got = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in got] == [
        ("email", "a.b@c-d.example.org"),
        ("email", "_x@y.zz"),
        ("ip", "10.0.0.255"),
        ("ip", "01.02.03.004"),
        ("card", card),
        ("phone", "+1 (202) 555-0143"),
    ]


def test_base_patterns_equal_the_plain_ones():
    plain = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }
    rng = random.Random(3)
    for _ in range(4_000):
        text = "".join(rng.choice("a@.-_1920+ ()é") for _ in range(rng.randrange(60)))
        want = []
        for kind, pattern in plain.items():
            for m in pattern.finditer(text):
                digits = [int(c) for c in m.group() if c in "0123456789"]
                luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
                good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
                if good[kind]:
                    want.append((kind, *m.span()))
        assert pii.base_spans(text) == want


def test_disclosing_terms(spark):
    texts = [f"{prose(i, 30)} Zebedee wrote {'' if i % 4 else 'zeb@example.org'} {prose(i + 50, 30)}" for i in range(40)]
    texts += [f"{prose(i, 20)} Quixana reads quix@example.org daily {prose(i + 9, 20)}" for i in range(100, 105)] + [None, ""]
    texts += [f"ask Quixana now {prose(7, 10)}"]
    docs = documents(spark, texts)
    near, holds, entity = {}, {}, {}
    for i, t in enumerate(texts):
        for term in set(pii.WORD.findall((t or "").lower())):
            holds.setdefault(term, set()).add(i)
        for e, term in pii.near_terms(t):
            near.setdefault((e, term), set()).add(i)
            entity.setdefault(e, set()).add(i)
    n = sum(t is not None for t in texts)
    want = set()
    for (e, term), both in near.items():
        if len(both) >= 3 and len(entity[e]) < n:
            share = math.log(n * len(both) / (len(entity[e]) * len(holds[term]))) / math.log(n / len(entity[e]))
            if share >= 0.9:
                want.add(term)
    got = {r["term"] for r in pii.disclosing_terms(docs, 3, 0.9).collect()}
    assert got == want and "quixana" in got and "zebedee" not in got
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, 3, 0.9).collect()}
    assert "[EMAIL]" in out[0] and "example.org" not in "".join(t or "" for t in out.values())
    assert "Quixana" not in out[100 - 100 + 40] and "[TERM]" in out[47]
    found = {r["doc_id"]: r for r in pii.find(docs, 3, 0.9).collect()}
    for i, t in enumerate(texts):
        base = pii.listed(pii.base_spans(t))
        assert found[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert found[i]["spans"].startswith(base)
        terms = [s for s in found[i]["spans"].split(",") if s.startswith("term:")]
        assert len(terms) == found[i]["n_term"]
        for s in terms:
            a, b = map(int, s.split(":")[1:])
            assert t[a:b].lower() in want


def test_repeated_rows_disclose_the_same_terms(spark):
    texts = [f"{prose(i, 30)} {'Zebedee' if i % 4 else 'plain'} wrote" for i in range(60)]
    texts += [f"{prose(i, 20)} Quixana reads quix@example.org daily {prose(i + 9, 20)}" for i in range(100, 105)] + [None, ""]
    docs = documents(spark, texts)
    want = {(r["term"], r["share"]) for r in pii.disclosing_terms(docs).collect()}
    assert "quixana" in {t for t, _ in want}
    hot = docs.where("doc_id = 60").crossJoin(spark.range(50).select()).select(*docs.columns)
    for again in (docs.union(docs), docs.union(hot)):
        assert {(r["term"], r["share"]) for r in pii.disclosing_terms(again).collect()} == want


def test_planted_terms_in_the_query(spark, tmp_path):
    texts = [f"{prose(i, 30)} Zebedee wrote {'' if i % 4 else 'zeb@example.org'} {prose(i + 50, 30)}" for i in range(40)]
    texts += [f"{prose(i, 20)} Quixana reads quix@example.org daily {prose(i + 9, 20)}" for i in range(100, 105)] + [None, ""]
    texts += [f"ask Quixana now {prose(7, 10)}"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["spans"] for r in QUERIES["op3_pii"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        marked = {t[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i].split(",") if s) if k == "term"}
        assert ("Quixana" in marked) == ("Quixana" in (t or "")) and "Zebedee" not in marked


# Substrings ---------------------------------------------------------------------


def brute_removal(texts, width):
    """Kept words by document, from the definition."""
    first = {}
    coded = {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(coded):
        for j in range(len(coded[i]) - width + 1):
            first.setdefault(tuple(coded[i][j : j + width]), i)
    out = {}
    for i, w in coded.items():
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        out[i] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
    return out


@pytest.mark.parametrize("many", [200, 2])
def test_substring_removal(spark, many):
    rng = random.Random(8)
    passages = [prose(1_000 + i, n) for i, n in enumerate((13, 14, 20, 60, 200, 12, 5))]
    texts = {}
    for i in range(60):
        parts = [prose(i, rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng.randrange(9_999), rng.randrange(0, 20))]
        texts[i] = "\n".join(parts)
    texts |= {60: texts[3], 61: texts[3], 62: None, 63: "", 64: "x " * 100, 65: "x " * 90, 66: passages[4][100:700], 67: prose(5, 40, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs, many=many, shard_texts=50).collect()}
    want = brute_removal(texts, 13)
    assert {i: r["kept"] for i, r in got.items()} == want
    assert all(r["n_removed"] == r["n_words"] - len(r["kept"].split()) for r in got.values())


# Near-duplicates ----------------------------------------------------------------


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def edited(text, seed, share):
    rng = random.Random(seed)
    words = text.split(" ")
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"e{rng.randrange(10_000)}"
    return " ".join(words)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)  # several blocks in one bucket
    texts = {}
    for g in range(12):
        base = prose(g, 150, 4_000)
        for j in range(8):
            texts[len(texts)] = edited(base, j, (0, 0.01, 0.02, 0.03, 0.05, 0.04, 0.025, 0.06)[j])
    chain = prose(77, 200, 4_000).split(" ")
    for j in range(12):  # each like the next, the ends unlike
        texts[len(texts)] = " ".join(chain[j * 6 : j * 6 + 120])
    line = prose(78, 60, 4_000)
    for j in range(20):  # a shared passage is no link
        texts[len(texts)] = f"{line} {prose(300 + j, 90, 4_000)}"
    texts |= {500: None, 501: "", 502: "one two", 503: "ONE two", 504: "one two three", 505: texts[0].upper(), 506: texts[0]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in near_dedup.classes(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_classes(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_twenty_thousand_near_copies(spark):
    """All of them differ by a word; meetings grow with the members, and one class comes out."""
    base = prose(5, 100, 4_000).split()
    rng = random.Random(7)
    texts = []
    for i in range(20_000):
        own = list(base)
        own[rng.randrange(100)] = f"x{i}"
        texts.append(" ".join(own))
    docs = documents(spark, texts)
    got = near_dedup.classes(docs)
    assert got.where("component_id <> 0 or n_shingles <> 96").isEmpty() and got.where("kept").count() == 1

    buckets = spark.range(20_000).select(F.lit(1).cast("long").alias("key"), "id", F.lit(1.0).alias("w"))
    meetings = near_dedup._linear(buckets)
    assert meetings.count() < 3 * 20_000 + 1_000
    sizes = meetings.groupBy("a", "b", "c").count().agg(F.max("count")).first()[0]
    assert sizes < 3 * near_dedup.BLOCK


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 8 * 1_000)
    rows = spark.range(40).select(F.lit(1).cast("long").alias("key"), "id", near_dedup._weight(F.lit(500)).alias("w"))
    assert near_dedup._linear(rows).select("c").distinct().count() >= 10


def test_odd_sketch_estimates_high_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for similarity in (0.75, 0.85, 0.95):
        errors = []
        for _ in range(60):
            n = 1_000
            both = int(2 * n * similarity / (1 + similarity))
            values = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = values[:n], np.concatenate([values[:both], values[n : 2 * n - both]])
            x, y = (near_dedup.odd_sketch(near_dedup.samples(s)) for s in (a, b))
            different = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            assert different <= near_dedup.MOST_DIFFERENT
            m = near_dedup.SKETCH_BITS
            odd = -m / 2 * math.log(1 - 2 * different / m)
            errors.append(1 - odd / (2 * near_dedup.SAMPLES) - similarity)
        assert abs(sum(errors) / len(errors)) < 0.02


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1_000, 1_100)] + [(2_000, i) for i in range(2_001, 2_100)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Packing ------------------------------------------------------------------------


def test_packing_round_trip(spark):
    texts = [prose(1, 3_000), "", None, "a", "two  spaces \n x", "<|endoftext|> a", "é, ü. ñ! 3? ²,", prose(2, 900) + "\n" + prose(3, 50), "tail ", " ."]
    docs = documents(spark, texts)
    rows = packing.pack(docs, TOKENIZER, 1024).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert list(itertools.chain.from_iterable(r["ids"] for r in own)) == ids
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        assert all(r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0 and r["bucket"] == r["length"] for r in own)
        assert {r["doc_tokens"] for r in own} == {len(ids)}
    with pytest.raises(ValueError):
        packing.pack(docs, TOKENIZER, 1000)


def test_piece_lengths():
    for total in range(1, 5_000):
        pieces = packing.piece_lengths(total, 1024)
        assert sum(pieces) == total and pieces == sorted(pieces, reverse=True)
        assert sum(p < 1024 for p in pieces) <= 10


# Classifiers: held-out rows -----------------------------------------------------


@pytest.fixture(scope="module")
def given(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def accuracy(scored, labels, column, predicted):
    both = scored.join(labels.where(f"{column} is not null"), "doc_id").where("held")
    right = both.agg(F.avg((predicted == F.col(column).cast(predicted_type(column))).cast("int"))).first()[0]
    return right


def predicted_type(column):
    return "string" if column == "lang" else "int"


def test_quality_held_out(spark, given):
    docs, labels = given
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = quality.fit(docs, labels.where(fold != 2).select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(docs, model).withColumn("held", fold == 2)
    assert accuracy(scored, labels, "quality", (F.col("score") >= 0.7).cast("int")) > 0.98
    kept = quality.keep_good(docs, model, 0.7)
    assert kept.count() == scored.where("score >= 0.7").count()


def test_toxicity_held_out(spark, given):
    docs, labels = given
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.fit(docs, labels.where(fold != 0).select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score(docs, model).withColumn("held", fold == 0)
    assert accuracy(scored, labels, "toxic", (F.col("score") >= 0.5).cast("int")) > 0.98


def test_language_held_out(spark, given):
    docs, _ = given
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    scored = langid.predict(docs, langid.fit(docs.where(fold != 0))).withColumn("held", fold == 0)
    assert accuracy(scored, docs.select("doc_id", "lang"), "lang", F.col("lang_pred")) > 0.97
    odd = documents(spark, [None, "", "12 34 !", "the and of the with"])
    got = {r["doc_id"]: r for r in langid.predict(odd, langid.fit(docs)).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[3]["lang_pred"] == "en"


# Grammar and dual coordinate descent --------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("An idiot. Fine", {"insult_plain": 3}),
        ("you idiot", {"insult_targeted": 3}),
        ("what an idiot you are", {"insult_targeted": 3}),
        ("he is not an idiot", {"insult_negated": 3}),
        ("I don’t think you are an idiot", {"insult_negated": 3}),
        ("I didn't call you an idiot", {"insult_negated": 3}),
        ("they said you are an idiot", {"insult_reported": 3}),
        ("not today but you are such a big fat idiot", {"insult_targeted": 3}),
        ("LOWEI x", {"insult_plain": 2}),
        ("I will kill you", {"threat_targeted": 1}),
        ("I'll kill you", {"threat_targeted": 1}),
        ("Kill him now", {"threat_targeted": 1}),
        ("we are going to hurt you, idiot", {"threat_targeted": 1, "insult_targeted": 3}),
        ("I will not hurt you", {"threat_negated": 1}),
        ("I won't hurt you", {"threat_negated": 1}),
        ("he said he would kill you", {"threat_reported": 1}),
        ("ich werde dich töten", {"threat_targeted": 1}),
        ("je vais te tuer", {"threat_targeted": 1}),
        ("te voy a matar", {"threat_targeted": 1}),
        ("kill. you", {}),
        ("you beat the record", {}),
        ("the process will kill time", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_grammar_paths(text, want):
    found = dict(zip(toxicity.PATHS, toxicity.Reader({"idiot": 3.0, "lowe*": 2.0}).features(text), strict=True))
    assert {k: v for k, v in found.items() if v} == {k: pytest.approx(math.log1p(v)) for k, v in want.items()}


def test_transducers_run_one_behind_the_other():
    """Attributes add up, and the composed machine is the same as one transducer after another."""
    reader = toxicity.Reader({"idiot": 3.0})
    words = ["you", "idiot", "not", "said", "i", "will", "kill", "house", "no", "won't", "him"]
    rng = random.Random(4)
    for _ in range(2_000):
        clause = [reader.symbol(rng.choice(words)) for _ in range(rng.randrange(1, 9))]
        marks = [set(s) for s, _ in clause]
        for part in toxicity.Grammar.parts:
            state = part.start
            for i, m in enumerate(marks):
                state, out = part.step(state, frozenset(m))
                marks[i] = set(out)
        seen = False
        for i in reversed(range(len(marks))):
            if seen and marks[i] & {"insult", "threat"}:
                marks[i].add("targeted")
            seen = seen or "target" in marks[i]
        assert [set(s) for s, _ in reader.grammar.read(clause)] == marks
    both = reader.grammar.read([reader.symbol(w) for w in ("you", "are", "not", "an", "idiot")])[-1][0]
    assert {"insult", "targeted", "negated"} <= both


def test_language_scores_are_plain_sums(spark):
    docs = documents(spark, [prose(i, 40) for i in range(40)]).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "aa").otherwise("bb"))
    model = langid.fit(docs)
    for text in ("abc Def, ghé", "x", prose(77, 30)):
        points = [" ", *[c if c.isalpha() else " " for c in text.lower()], " "]
        total = model.log_prior.astype(float).copy()
        for n in langid.LENGTHS:
            for i in range(len(points) - n + 1):
                h = n
                for j in range(n):
                    h = ((h ^ ord(points[i + j])) * int(langid.MULTIPLIERS[j])) % (1 << 32)
                total += model.log_prob[(h ^ (h >> 15)) & (langid.BINS - 1)]
        (name,), (score,) = model.predict([text])
        share = np.exp(total - total.max())
        assert name == model.languages[int(total.argmax())] and score == pytest.approx(share.max() / share.sum(), rel=1e-4)


def test_copies_support_a_word_once(spark):
    toxic = [(prose(i, 30) + f" vile {prose(i + 500, 5)} qqqq", 1) for i in range(60)] + [("zork " + prose(9_999, 10), 1)] * 300
    clean = [(prose(i + 1_000, 36), 0) for i in range(360)]
    rows = spark.createDataFrame(toxic + clean, "text string, label int")
    forms = {r["form"] for r in toxicity.lexicon(rows).collect()}
    assert "vile" in forms and "zork" not in forms


def test_dual_coordinate_descent_separates():
    import numpy as np

    rng = np.random.default_rng(2)
    y = np.where(rng.random(300) < 0.5, 1.0, -1.0)
    rows = [np.unique(np.r_[rng.integers(2, 50, 8), 0 if v > 0 else 1]) for v in y]
    values = [np.full(len(r), len(r) ** -0.5) for r in rows]
    w, b = quality.dual_coordinate_descent(rows, values, y, 50, np.ones(300))
    assert all(v * (w[r] @ x + b) > 0 for r, x, v in zip(rows, values, y, strict=True))
