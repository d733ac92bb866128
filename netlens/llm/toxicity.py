"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read a clause word by word, one behind the other: insult, threat, target, negation
and reported speech. Each takes the symbols that the one before puts out and adds an attribute to
those that it accepts, so an insult can come out as negated and targeted at once; composed, they
are one transducer, whose states are built as they are met.

The insult transducer's lexicon, whole words and word beginnings with a weight, is learned from
labelled documents: the log-odds of a form in toxic against clean documents. Its support counts
distinct preceding words, so a text that was copied a thousand times supports its words once. The
threat transducer accepts a verb of harm behind a subject and a modal or a form of going to
("I will", "werde ich"), or as an order at a clause's beginning, and gives it its weight; a verb
of harm alone is none. Target, negation and report have fixed words.

A match is sorted by its strongest attribute: denied (negated) before reported before aimed
(targeted), for insults and threats apart; a threat without a target is none. A document's score is a logistic function of the
weights of its matches by kind; its coefficients start from prior values and are fitted on
the sample.

A null or empty text, and one without a match, gets the score of the intercept. With no row of
one of the classes the lexicon is empty and the prior coefficients hold. Of an id with both
labels the smaller counts; repeated rows are scored each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import bounded_sample, map_batches, one_label

#: Labelled documents of each class that fitting reads at most.
SAMPLE_ROWS = 3_000
#: Lengths of word beginnings in the lexicon, beside whole words.
STEMS = (4, 5, 6)
#: Distinct preceding words that a form needs in toxic documents, and its least odds of toxic
#: against clean contexts, as a multiple of the odds of all contexts.
MIN_SUPPORT = 6
MIN_ODDS = 40.0
#: Size of the model: the strongest forms are kept.
MOST_FORMS = 20_000
MEMO_WORDS = 200_000

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;\n]")
#: Other apostrophes, read as the plain one.
APOSTROPHES = "’‘ʼ＇`´"
ENDS = frozenset(".!?;\n")
# Words of the grammar in English, German, French and Spanish.
HARM = frozenset(
    "kill hurt destroy shoot stab burn strangle murder beat punish töten umbringen verletzen zerstören erschießen verbrennen "
    "tuer blesser détruire frapper brûler tuerai blesserai détruirai matar herir destruir golpear quemar mataré heriré".split()
)
MODAL = frozenset("will would shall should gonna going must want 'll werde werden wird will vais va allons voy va vamos quiero".split())
SELF = frozenset("i we he they someone somebody ich wir er jemand je nous il yo nosotros él alguien voy vamos quiero".split())
TARGET = frozenset(
    "you your yours yourself u du dich dir dein deine ihr euch tu toi te vous votre vos tú ti usted ustedes vosotros "
    "he she they him her them".split()
)
NEGATION = frozenset(
    "not no never neither nor cannot cant dont nicht kein keine niemals nie ne pas jamais aucun nunca jamás ningún".split()
)
REPORT = frozenset(
    "said says say told called quoted wrote claims claimed reported sagte sagt schrieb nannte dit disait écrit appelé "
    "dijo dice escribió llamó".split()
)
#: Words after a negation that it reaches.
REACH = 6
KINDS = ("insult", "threat")
WAYS = ("plain", "targeted", "negated", "reported")
PATHS = (*(f"insult_{way}" for way in WAYS), *(f"threat_{way}" for way in WAYS[1:]))
#: Prior coefficients: the intercept, then one of each path.
PRIOR = np.array([-3.0, 4.0, 6.0, 1.0, 1.0, 4.0, 0.5, 0.5])


@dataclass(frozen=True)
class Transducer:
    """Reads sets of marks and puts out sets of marks.

    ``arcs`` are tried in order: (state, mark that must be there, next state, mark that is added). A
    symbol that no arc of the state takes passes unchanged, to the state ``rest`` (or the same).
    """

    arcs: tuple[tuple[str, str, str, str], ...]
    rest: dict[str, str] = field(default_factory=dict)
    start: str = "0"

    def step(self, state: str, symbol: frozenset) -> tuple[str, frozenset]:
        for at, mark, to, added in self.arcs:
            if at == state and mark in symbol:
                return to, symbol | {added} if added else symbol
        return self.rest.get(state, state), symbol


#: An insult is what the lexicon says.
INSULTS = Transducer((("0", "lexicon", "0", "insult"),))
#: A verb of harm behind self and modal (or modal and self), a few words between; or first in the clause.
THREATS = Transducer(
    (
        ("0", "harm", "in", "threat"), ("0", "promise", "ready", ""), ("0", "self", "self", ""), ("0", "modal", "modal", ""),
        ("in", "promise", "ready", ""), ("in", "self", "self", ""), ("in", "modal", "modal", ""),
        ("self", "modal", "ready", ""), ("self", "self", "self", ""), ("modal", "promise", "ready", ""), ("modal", "self", "ready", ""), ("modal", "modal", "modal", ""),
        ("ready", "harm", "ready", "threat"), ("ready", "self", "ready", ""),
    ),
    rest={"0": "in"},
)
#: A target before or behind the match, in the clause. What comes first marks what follows.
TARGETS = Transducer((("0", "target", "seen", ""), ("seen", "insult", "seen", "targeted"), ("seen", "threat", "seen", "targeted")))
NEGATIONS = Transducer(
    tuple((str(s), "negation", "1", "") for s in range(REACH + 1))
    + tuple((str(s), kind, str(s), "negated") for s in range(1, REACH + 1) for kind in KINDS),
    rest={str(s): str(s + 1) if s < REACH else "0" for s in range(1, REACH + 1)},
)
REPORTS = Transducer((("0", "report", "said", ""), *((("said", kind, "said", "reported")) for kind in KINDS)))


class Grammar:
    """The transducers in sequence as one, its states and arcs built as they are met."""

    parts = (INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS)

    def __init__(self):
        self.table: dict[tuple[tuple[str, ...], frozenset], tuple[tuple[str, ...], frozenset]] = {}

    def step(self, state: tuple[str, ...], symbol: frozenset) -> tuple[tuple[str, ...], frozenset]:
        key = (state, symbol)
        if key not in self.table:
            moved = []
            for part, own in zip(self.parts, state, strict=True):
                own, symbol = part.step(own, symbol)
                moved.append(own)
            self.table[key] = (tuple(moved), symbol)
        return self.table[key]

    def read(self, clause: list[tuple[frozenset, float]]) -> list[tuple[frozenset, float]]:
        """The clause as it comes out, with its weights."""
        state, out = tuple(p.start for p in self.parts), []
        for symbol, weight in clause:
            state, symbol = self.step(state, symbol)
            out.append((symbol, weight))
        # a target behind the match: the same transducer, from the end
        own = TARGETS.start
        for i in range(len(out) - 1, -1, -1):
            own, symbol = TARGETS.step(own, out[i][0])
            out[i] = (symbol, out[i][1])
        return out

    def paths(self, clause: list[tuple[frozenset, float]]) -> dict[str, float]:
        """Summed weight of each path of one clause."""
        found = dict.fromkeys(PATHS, 0.0)
        for symbol, weight in self.read(clause):
            for kind in KINDS:
                if kind in symbol and (kind == "insult" or "targeted" in symbol):
                    way = next((w for w in ("negated", "reported", "targeted") if w in symbol), "plain")
                    found[f"{kind}_{way}"] += weight if kind == "insult" else 1.0
        return found


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]  # whole words, and beginnings marked by a final *
    coefficients: np.ndarray


def tokens(text: str | None) -> list[str]:
    """Words in lower case, and the signs that end clauses."""
    lower = (text or "").lower()
    for sign in APOSTROPHES:
        if sign in lower:
            lower = lower.replace(sign, "'")
    return TOKEN.findall(lower)


class Reader:
    """Path weights of whole texts under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.grammar, self.memo = lexicon, Grammar(), {}

    def symbol(self, word: str) -> tuple[frozenset, float]:
        """Classes of a word, and its weight if it is in the lexicon."""
        if word in ENDS:
            return (frozenset(["end"]), 0.0)
        forms = [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]
        weight = max((self.lexicon.get(f, 0.0) for f in forms), default=0.0)
        stem, _, short = word.partition("'")
        marks = {"lexicon"} if weight else set()
        for mark, known in (("harm", HARM), ("modal", MODAL), ("self", SELF), ("target", TARGET), ("negation", NEGATION), ("report", REPORT)):
            if word in known or (short and (stem in known or f"'{short}" in known)):
                marks.add(mark)
        if word.endswith("n't"):  # isn't, won't, shouldn't
            marks.add("negation")
            marks |= {"modal"} if word[:-3] in ("wo", "would", "should", "sha", "must") else set()
        if {"self", "modal"} <= marks:  # I'll, voy
            marks.add("promise")
        return (frozenset(marks), weight)

    def features(self, text: str | None) -> np.ndarray:
        """One value for each path, growing with the logarithm of its weight."""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        symbols = []
        for word in tokens(text):
            s = memo.get(word)
            if s is None:
                marks, weight = self.symbol(word)
                # 2 ends a clause, 1 makes it worth reading
                s = memo[word] = (marks, weight, 2 if "end" in marks else int("lexicon" in marks or "harm" in marks))
            symbols.append(s)
        sums = np.zeros(len(PATHS))
        kinds = bytes([s[2] for s in symbols])
        at = kinds.find(1)
        while at >= 0:
            begin, end = kinds.rfind(2, 0, at) + 1, kinds.find(2, at)
            end = len(kinds) if end < 0 else end
            sums += list(self.grammar.paths([s[:2] for s in symbols[begin:end]]).values())
            at = kinds.find(1, end)
        return np.log1p(sums)


def probability(coefficients: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(coefficients[0] + x @ coefficients[1:], -40, 40)))


def fit_coefficients(x: np.ndarray, y: np.ndarray, share: float, hold: float = 0.3, steps: int = 50) -> np.ndarray:
    """Logistic regression held to the prior coefficients, rows weighted to the true share of label 1."""
    a = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + hold * (w - PRIOR)
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + hold * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return np.concatenate([w[:1], np.maximum(w[1:], 0)])


def lexicon(sample: DataFrame) -> DataFrame:
    """Forms that mark toxic documents: form, weight. ``sample`` has text and label."""

    def step(batch: dict) -> dict:
        rows = set()
        for text, label in zip(batch["text"], batch["label"], strict=True):
            before = ""
            for word in tokens(text):
                if word in ENDS:
                    continue
                if len(word) > 2:
                    rows.update((f, label, before) for f in [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]])
                before = word
        return {k: [r[i] for r in rows] for i, k in enumerate(("form", "label", "before"))}

    def words(batch: dict) -> dict:
        return {"label": batch["label"], "n": [len(tokens(t)) for t in batch["text"]]}

    def count(label: int):
        return F.sum((F.col("label") == label).cast("long"))

    contexts = map_batches(sample, "form string, label int, before string", lambda: step).distinct()
    counts = contexts.groupBy("form").agg(count(1).alias("toxic"), count(0).alias("clean")).where("toxic > 0")
    whole = map_batches(sample, "label int, n long", lambda: words).groupBy("label").agg(F.sum("n").alias("n")).collect()
    total = {r["label"]: r["n"] for r in whole}
    odds = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * F.lit((total.get(0, 0) + 1) / (total.get(1, 0) + 1))
    marked = counts.where((F.col("toxic") >= MIN_SUPPORT) & (odds >= MIN_ODDS))
    return marked.select("form", F.log(odds).alias("weight")).orderBy(F.desc("weight"), "form").limit(MOST_FORMS)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1); bounded sample of each class."""
    known = one_label(labels)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return ToxicityModel({}, PRIOR)
    chosen = bounded_sample(known, "label", sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    forms = {r["form"]: r["weight"] for r in lexicon(sample).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(forms)

    def start():
        reader = Reader(sent.value)

        def step(batch: dict) -> dict:
            return {"label": batch["label"], "x": [reader.features(t) for t in batch["text"]]}

        return step

    rows = map_batches(sample, "label int, x array<double>", start).toPandas()  # a few numbers for each sampled row
    if rows["label"].nunique() < 2:
        return ToxicityModel(forms, PRIOR)
    share = counts[1] / sum(counts.values())
    return ToxicityModel(forms, fit_coefficients(np.stack(rows["x"]), rows["label"].to_numpy(dtype=float), share))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id, score, and the weight of each path."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = sent.value
        reader = Reader(model.lexicon)

        def step(batch: dict) -> dict:
            x = np.stack([reader.features(t) for t in batch["text"]])
            return {"doc_id": batch["doc_id"], "score": probability(model.coefficients, x)} | {p: x[:, i] for i, p in enumerate(PATHS)}

        return step

    paths = ", ".join(f"{p} double" for p in PATHS)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), f"doc_id long, score double, {paths}", start)
