"""Personal data: base patterns, and terms that disclose them by information theory.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Each distinct value is
a protected entity c. Terms are lower-cased words of letters in a window around an entity. Over
all documents, with N documents, n_c that hold c, n_t that hold t and n_ct that hold t near c,

    PMI(c; t) = log(N n_ct / (n_c n_t)),    IC(c) = log(N / n_c),

so PMI reaches IC when t never occurs without c. A term with PMI >= alpha IC for some entity,
seen near it in at least ``support`` documents, gives the entity away: it is a finding wherever it
occurs, and sanitising replaces it by a general mark, as it replaces the base findings.

Counting is distributed: pairs near entities, then document frequencies of the candidate terms
alone. A bitmap of fixed size, broadcast, keeps other words from being shuffled; joins on the
words decide, so the bitmap's false hits change nothing.

Null text counts as empty and gives no finding; sanitising leaves it null. Equal rows are counted
once (by id and text) and each get the same findings. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import bitmap, fold_batches, free_names, map_batches, split_rows, stable

# The base patterns. A lookbehind keeps long runs from being tried at every letter.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL_AT = re.compile(EMAIL)
EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL)
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: What replaces a finding: the kind is kept, the value goes.
MARKS = {k: f"[{k.upper()}]" for k in (*KINDS, TERM)}

WORD = re.compile(r"[^\W\d_]{3,}")
WINDOW = 12  # words on either side of an entity
SUPPORT = 3
#: A term may occur away from its entity in (N / n_c) to the power of 1 - ALPHA documents for each one near it.
ALPHA = 0.9
#: Bits of the bitmap; 512 kB.
BITS = 1 << 22
#: Distinct words that a task counts before it hands on what it has.
COUNT_WORDS = 200_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        m = EMAIL_AT.match(text, at) or EMAIL_RUN.search(text, at)
        if m is None:
            return
        yield m.span()
        at = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start and end of the base findings: by kind in the order of ``KINDS``, then by start."""
    if not text:
        return []
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def term_of(word: str) -> str:
    """A word as it is counted. Words are found before they are lowered: some letters become two."""
    return word.lower()


def near_terms(text: str | None, window: int = WINDOW) -> set[tuple[str, str]]:
    """(entity, term) of the words around each base finding, those inside findings left out."""
    spans = base_spans(text)
    if not spans:
        return set()
    words = [m for m in WORD.finditer(text) if not any(m.start() < b and a < m.end() for _, a, b in spans)]
    starts = [m.start() for m in words]
    out = set()
    for kind, a, b in spans:
        entity = f"{kind}:{text[a:b].lower()}"
        i = bisect.bisect_left(starts, a)
        out.update((entity, term_of(m.group())) for m in words[max(0, i - window) : i + window])
    return out


def _bit(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (BITS - 1)


def term_bitmap(terms: DataFrame) -> np.ndarray:
    """One bit for each hashed term."""
    return bitmap(terms.select(F.crc32("term").bitwiseAND(BITS - 1).cast("int").alias("place")), BITS)


class Candidates:
    """Which words hit the bitmap; remembers the words it has seen."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.memo = bits, {}

    def __call__(self, word: str) -> bool:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            place = _bit(word)
            known = self.memo[word] = bool(self.bits[place >> 3] >> (7 - (place & 7)) & 1)
        return known


def row_key() -> Column:
    """One value for equal rows: the id and a hash of the text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")))


def _key_place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)).cast("int")


def pair_counts(docs: DataFrame, support: int) -> DataFrame:
    """entity, term, n_ct, n_c of the pairs that at least ``support`` documents hold."""

    def start():
        def step(batch: dict) -> dict:
            rows = []
            for key, text in zip(batch["row_key"], batch["text"], strict=True):
                near = near_terms(text)
                rows += [(key, e, t) for e, t in near]
                rows += [(key, e, "") for e in {e for e, _ in near}]
            return {k: [r[i] for r in rows] for i, k in enumerate(("row_key", "entity", "term"))}

        return step

    rows = map_batches(docs.select(row_key().alias("row_key"), "text").where("text is not null"), "row_key string, entity string, term string", start)
    counts = rows.distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    whole = counts.where("term = ''").select("entity", F.col("n").alias("n_c"))
    return counts.where("term <> ''").withColumnRenamed("n", "n_ct").join(whole, "entity")


def document_frequencies(docs: DataFrame, terms: DataFrame, bits: np.ndarray, repeated: DataFrame) -> DataFrame:
    """term, n_t: how many different documents hold each of ``terms``. ``repeated``: the row_key of
    rows that stand there more than once."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def held(text: str | None, candidate: Candidates) -> list[str]:
        return [t for t in set(map(term_of, set(WORD.findall(text or "")))) if candidate(t)]

    def fold(words: Callable[[], Callable[[str], list[str]]]):
        def start():
            of, counts, done = words(), {}, []

            def take(batch: dict) -> None:
                for value in batch["value"]:
                    for word in of(value):
                        counts[word] = counts.get(word, 0) + 1
                if len(counts) > COUNT_WORDS:
                    done.extend(counts.items())
                    counts.clear()

            def end() -> dict:
                rows = [*done, *counts.items()]
                return {"term": [t for t, _ in rows], "n": [n for _, n in rows]}

            return take, end

        return start

    def of_text():
        candidate = Candidates(sent.value)
        return lambda text: held(text, candidate)

    def reduce():
        candidate = Candidates(sent.value)
        return lambda batch: {"row_key": batch["row_key"], "value": [" ".join(sorted(held(t, candidate))) for t in batch["text"]]}

    # rows that may be repeated are reduced to their candidate terms and counted once; the others are single
    rows = docs.select("doc_id", "text").where("text is not null")
    maybe, single = split_rows(rows, _key_place(row_key()), repeated.select(_key_place(F.col("row_key")).alias("place")), BITS)
    once = map_batches(maybe.select(row_key().alias("row_key"), "text"), "row_key string, value string", reduce).distinct()
    sums = fold_batches(single.select(F.col("text").alias("value")), "term string, n long", fold(of_text))
    sums = sums.union(fold_batches(once.select("value"), "term string, n long", fold(lambda: str.split)))
    return sums.groupBy("term").agg(F.sum("n").alias("n_t")).join(terms, "term", "left_semi")


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """The terms that give an entity away: term, and the largest share of IC(c) that PMI reaches."""
    pairs = stable(pair_counts(docs, support))
    terms = pairs.select("term").distinct()
    keys = stable(docs.where("text is not null").groupBy(row_key().alias("row_key")).agg(F.count(F.lit(1)).alias("rows")))
    n = keys.count()
    frequency = document_frequencies(docs, terms, term_bitmap(terms), keys.where("rows > 1").select("row_key"))
    pmi = F.log(F.lit(float(max(n, 1))) * F.col("n_ct") / (F.col("n_c") * F.greatest("n_t", "n_ct")))
    content = F.log(F.lit(float(max(n, 1))) / F.col("n_c"))
    judged = pairs.join(frequency, "term").where(content > 0).withColumn("share", pmi / content)
    return stable(judged.where(F.col("share") >= alpha).groupBy("term").agg(F.max("share").alias("share")))


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """row_key, terms: where the terms occur outside base findings, for the rows that hold any."""
    sent = docs.sparkSession.sparkContext.broadcast(term_bitmap(terms))

    def start():
        candidate = Candidates(sent.value)

        def step(batch: dict) -> dict:
            rows = []
            for key, text in zip(batch["row_key"], batch["text"], strict=True):
                hits = [(t, *m.span()) for m in WORD.finditer(text) if candidate(t := term_of(m.group()))]
                if hits:
                    spans = base_spans(text)
                    rows += [(key, *h) for h in hits if not any(h[1] < b and a < h[2] for _, a, b in spans)]
            return {k: [r[i] for r in rows] for i, k in enumerate(("row_key", "term", "start", "end"))}

        return step

    rows = docs.select(row_key().alias("row_key"), "text").where("text is not null")
    hits = map_batches(rows, "row_key string, term string, start long, end long", start)
    known = hits.join(terms.select("term"), "term", "left_semi")
    return known.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))


def find(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    terms = term_spans(docs, disclosing_terms(docs, support, alpha))

    def start():
        def step(batch: dict) -> dict:
            found = [base_spans(t) for t in batch["text"]]
            texts = [listed(f) for f in found]
            out = {"doc_id": batch["doc_id"], "row_key": batch["row_key"], "base": texts}
            out |= {f"n_{k}": [sum(s[0] == k for s in f) for f in found] for k in KINDS}
            return out | {"base_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]}

        return step

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = map_batches(
        docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), "text"),
        f"doc_id long, row_key string, base string, {counts}, base_sha256 string",
        start,
    )
    joined = rows.join(terms, "row_key", "left")
    own = F.transform("terms", lambda s: F.concat_ws(":", F.lit(TERM), s["start"].cast("string"), s["end"].cast("string")))
    base = F.when(F.col("base") != "", F.array("base")).otherwise(F.array().cast("array<string>"))
    spans = F.array_join(F.concat(base, F.coalesce(own, F.array().cast("array<string>"))), ",")
    n_term = F.coalesce(F.size("terms"), F.lit(0)).cast("long")
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), F.greatest(n_term, F.lit(0)).alias("n_term"))


def masked(text: str | None, terms: list | None) -> str | None:
    """The text with every finding replaced by its mark; of overlapping findings the first, then the longest."""
    if not text:
        return text
    spans = sorted([(a, -b, k) for k, a, b in base_spans(text)] + [(s["start"], -s["end"], TERM) for s in (terms if terms is not None else [])])
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], MARKS[kind]]
            at = -b
        elif -b > at:  # overlaps the mark before: goes with it
            at = -b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """The rows of ``docs``, all columns, with findings in ``text`` replaced by marks."""
    terms = stable(term_spans(docs, disclosing_terms(docs, support, alpha)))

    @F.pandas_udf("string")
    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([masked(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    def marked(part: DataFrame, spans: Column) -> DataFrame:
        return part.withColumn("text", mask(F.col("text"), spans)).select(*[f"`{c}`" for c in docs.columns])

    # only rows that may hold a term meet the table of spans
    maybe, plain = split_rows(docs, _key_place(row_key()), terms.select(_key_place(F.col("row_key")).alias("place")), BITS)
    key, found = free_names(docs, "_row_key", "_terms")
    spans = terms.select(F.col("row_key").alias(key), F.col("terms").alias(found))
    joined = maybe.withColumn(key, row_key()).join(spans, key, "left")
    return marked(joined, F.col(found)).union(marked(plain, F.lit(None).cast("array<struct<start:long,end:long>>")))
