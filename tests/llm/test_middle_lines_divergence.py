"""Fill-in-middle, line dedup and source divergence against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import DOCS, documents, odd_rows, prose, rows_of, with_clashes

from netlens.llm import divergence, line_runs, middle

# Fill-in-middle -----------------------------------------------------------------

TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "two\nlines", "ends\n", "é\nüß\n😀😀\nx", "a<P>b\nc", "<", "<M", "x\n" * 300,
    "ü" * 77 + "\n" + "y" * 9, "1234567\n", "12345678\n", "123456789\n", "\n1234567", "tail\r\nnext\r\n",
]


def units_of(text: str, unit: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


def transformed(doc_id, text, unit="line", rate=100, spm_rate=50):
    text = text or ""
    units = units_of(text, unit)
    h = middle.draws(doc_id)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in middle.SENTINELS) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < spm_rate:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("options", [{}, {"unit": "code_point"}, {"rate": 60, "spm_rate": 20}, {"spm_rate": 0}])
def test_middle_against_plain_python(spark, options):
    rng = random.Random(5)
    noise = ["".join(rng.choice("ab\n\né😀 ") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts = TEXTS + noise
    got = middle.transform(documents(spark, texts), **options)
    assert rows_of(got) == sorted((transformed(i, t, **options) for i, t in enumerate(texts)), key=repr)
    back = got.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert rows_of(back) == sorted(((i, t or "") for i, t in enumerate(texts)), key=repr)


def test_marks_in_words():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.integers(0, 256, size).astype(np.uint8)
        data[rng.random(size) < 0.2] = 10
        words = middle.as_words(data)
        marks = middle.Marks(middle.newline_marks(words))
        places = np.flatnonzero(data == 10)
        assert marks.rank(np.arange(size + 1)).tolist() == np.r_[0, np.cumsum(data == 10)].tolist()
        assert marks.select(np.arange(len(places))).tolist() == places.tolist()
        inner = middle.Marks(middle.continuation_marks(words))
        assert inner.rank(np.array([size])) == ((data & 0xC0) == 0x80).sum()


def test_sentinels_that_overlap_are_refused(spark):
    for bad in (("<P>", "<P><", "<M>"), ("aba", "ab", "x"), ("", "a", "b"), ("<a", "a>", ">")):
        with pytest.raises(ValueError, match="mistaken"):
            middle.transform(documents(spark, ["x"]), sentinels=bad)
    own = ("[prefix]", "[suffix]", "[middle]")
    got = middle.transform(documents(spark, ["a\nb\nc\n<P>"]), sentinels=own)
    row = got.select("form", "output", middle.restored(F.col("output"), F.col("form"), own).alias("back")).first()
    assert row["form"] != "plain" and row["back"] == "a\nb\nc\n<P>"


# Line dedup ----------------------------------------------------------------------


def key_of(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def deduped(rows, least_chars=20, least_docs=3):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(-(1 << 63) if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        me = -(1 << 63) if doc_id is None else doc_id
        kept = [x for x in lines if len(holders.get(key_of(x), ())) < least_docs or max(holders[key_of(x)]) == me]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lined_rows():
    rng = random.Random(9)
    pool = [f"  Line number {i} OF THE pool, Ünique É \t" for i in range(40)] + ["short", "", "THE VERY COMMON LINE of all documents"]
    rows = []
    for i in range(400):
        lines = [rng.choice(pool) for _ in range(rng.randrange(12))] + [pool[-1]] * (i % 3 == 0) + [f"own line of document {i} and no other"]
        rows.append((i * 7, "\n".join(x if rng.random() < 0.5 else x.lower() for x in lines)))
    rows += [(None, pool[0]), (None, pool[-1]), (5, None), (5, ""), (14, pool[3]), (14, pool[3]), (-3, "\n".join([pool[1]] * 5))]
    return rows


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (8, 4), (9, 3)])
def test_lines_against_plain_python(spark, batches, fanout):
    rows = lined_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(line_runs.drop_repeated_lines(docs, batches=batches, fanout=fanout)) == deduped(rows)


def test_runs_hold_each_key_once_and_are_merged(spark):
    lines = spark.range(0, 600).select(
        (600 - F.col("id")).alias("doc"), (F.col("id") % 50).alias("h1"), F.lit(1).cast("long").alias("h2"), (F.col("id") / 60).cast("int").alias("batch")
    )
    runs = line_runs.Runs(spark, fanout=3)
    levels = []
    for batch in range(10):
        runs.add(lines.where(F.col("batch") == batch))
        levels.append({k: len(v) for k, v in runs.levels.items() if v})
        for table, _ in runs.runs():
            assert spark.table(table).groupBy("h1", "h2").count().where("count > 1").isEmpty()
    assert levels == [{0: 1}, {0: 2}, {1: 1}, {0: 1, 1: 1}, {0: 2, 1: 1}, {1: 2}, {0: 1, 1: 2}, {0: 2, 1: 2}, {2: 1}, {0: 1, 2: 1}]
    got = {r["h1"]: (r["keeper"], r["docs"]) for r in runs.merged().collect()}
    assert got == {k: (600 - k, 12) for k in range(50)}
    tables = [t for t, _ in runs.runs()]
    runs.drop()
    assert not any(spark.catalog.tableExists(t) for t in tables)


def test_a_batch_meets_the_runs_without_another_exchange(spark):
    lines = spark.range(0, 600).select(F.col("id").alias("doc"), (F.col("id") % 50).alias("h1"), F.xxhash64(F.col("id") % 50).alias("h2"))
    runs = line_runs.Runs(spark)
    for _ in range(2):
        runs.add(lines)
    own = lines.groupBy("h1", "h2").count()
    for table, _ in runs.runs():
        own = own.join(spark.table(table).select("h1", "h2").hint("merge"), ["h1", "h2"], "left")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert "PythonUDF" not in plan and "ArrowEval" not in plan
    runs.drop()


def test_no_python_worker_in_line_dedup(spark):
    plan = line_runs.drop_repeated_lines(documents(spark, ["a\nb"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


# Divergence ----------------------------------------------------------------------


def audited(rows, least_docs=10, top=10):
    """Straight from the definition, with Python's integers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def p(found, term, kept=kept):
            return 1 + 10**9 * (found[term] + 2) // (sum(found[t] for t in kept) + 2 * len(kept))

        shares = {s: [p(counts[lang, s], t) for t in kept] for s in sources}
        base = [p(whole, t) for t in kept]
        for s in sources:
            pairs = [(o, sum((a - b) ** 2 // (a + b) for a, b in zip(shares[s], shares[o]))) for o in sources if o != s]
            terms = [(t, (a - b) ** 2 // (a + b)) for t, a, b in zip(kept, shares[s], base) if counts[lang, s][t] > 0 and a > b]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out, key=repr)


def spoken_rows():
    rng = random.Random(2)
    rows = []
    for i in range(600):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if rng.random() < 0.35 else rng.choice(["a", "b", "ü", None, "c"])
        rows.append((lang, source, prose(i, rng.randrange(60), 150).title() + " Ünd 12 é-é"))
    rows += [("fr", "a", "seldom words"), ("fr", "b", None), ("it", "x", ""), ("de", "empty", ""), ("en", "new", "unheard of")]
    return rows


@pytest.mark.parametrize(("block", "tile"), [(4096, 64), (16, 64), (7, 2)])
def test_divergence_against_plain_python(spark, block, tile, monkeypatch):
    monkeypatch.setattr(divergence.pair_values, "__defaults__", (block, tile))
    rows = spoken_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert rows_of(divergence.audit(docs)) == audited(rows)


def test_divergence_odd_tables(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    docs = odd_rows(spark)
    want = audited([(r["lang"], r["source"], r["text"]) for r in docs.collect()], least_docs=2)
    assert rows_of(divergence.audit(docs, least_docs=2)) == want
    assert rows_of(divergence.audit(with_clashes(docs).withColumn("total", F.lit("x")), least_docs=2)) == want


def test_shares_are_exact_for_large_counts():
    counts = [0, 1, 7, 10**9, 10**12 + 3, 4 * 10**15]
    for total in (10**3, 10**13 + 7, 4 * 10**15):
        for terms in (1, 10**6 + 1):
            below = [c for c in counts if c <= total]
            got = divergence.exact_shares(np.array(below), np.int64(total), np.int64(terms))
            assert got.tolist() == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in below]


def test_equal_subtrees_are_one_node_and_priced_once():
    counts = np.zeros((3, 1024), dtype=np.int64)
    counts[0, :512] = np.tile([1, 2, 3, 4], 128)
    counts[1, 512:] = np.tile([1, 2, 3, 4], 128)
    counts[2, 5] = 9
    forest = divergence.Forest(counts)
    assert sum(len(x) for x in forest.left) < 60
    asked = []

    def price(pair, a, b):
        asked.append(len(pair))
        return (a - b) ** 2

    pairs = np.array([[0, 1], [0, 2], [1, 2]])
    want = [int(((counts[i] - counts[j]) ** 2).sum()) for i, j in pairs]
    assert forest.sums(pairs, price).tolist() == want
    assert asked[0] < 30


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 50)
    text = (prose(3, 500) + " " + "x" * 300 + " é, Ü9b\x00").encode()
    whole = [w for words in divergence.term_slices(text) for w in words]
    assert whole == [w.encode() for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.decode())]


def test_counts_of_a_task_are_handed_over(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    docs = documents(spark, [prose(i, 40) for i in range(30)])
    parts = divergence.count_terms(docs)
    want = Counter(w for r in docs.collect() for w in r["text"].split())
    got = {r["term"]: r["n"] for r in parts.groupBy("term").agg(F.sum("count").alias("n")).collect()}
    assert got == dict(want)

