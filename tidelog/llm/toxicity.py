"""Toxicity by a weighted finite-state pattern grammar over clauses.

The words of a clause are read as symbols: insult (a learned lexicon of words
and word beginnings with weights), threat, its past forms, will and shall,
target, negation, reporting verb, quote, strengthening word, other.  Six
transducers are composed, step by step as their states are met:

``insult``    strengthens insults after a strengthening word;
``threat``    lets threats pass only in a clause that has a target somewhere,
              and past forms ("killed") only after a word like "will" as well;
``target``    two machines: insults and threats after a target, and those that
              a target follows, weigh more;
``negation``  weakens what stands right after a negation;
``report``    weakens what a clause reports, with the reporting verb before or
              after it ("an idiot, said the court"), and what is quoted.

Machines that must know what follows guess it: they go on in two states, of
which one dies where the guess fails, so each clause has one accepting path
through the composed machine.  A clause's score is the sum along that path of
the words' weights times the arcs' weights; what no arc lets pass counts
nothing.  A text's score is a logistic function of its clauses' scores.

Clauses without an insult or a threat score nothing, so the words that start
patterns are found first, by an Aho-Corasick automaton over the whole text,
and only their clauses are cut out and run; time and memory are linear in the
text, however long it or a clause is.  Equal texts have equal scores.

Learned from labelled rows: which words and beginnings are insults, and the
logistic function.  Near copies among these rows count once (candidates
share the smallest hash of their four-word shingles in one of six orders, and
0.8 of the five-word shingles decide), so that a repeated text doesn't make
its words look telling.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .near_copies import similar

#: Labelled rows to learn from, at most; those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
#: A lexicon entry's count among toxic rows must be this unlikely by chance.
MAX_CHANCE = 1e-7
STEMS = range(3, 9)

THREAT = frozenset("kill murder hurt destroy stab shoot strangle beat burn tuer tuerai frapper détruire crever töten umbringen schlagen vernichten erschlagen matar mataré golpear destruir".split())
PAST = frozenset("killed murdered destroyed stabbed shot strangled beaten burned burnt tué frappé détruit getötet umgebracht geschlagen vernichtet erschlagen matado golpeado destruido".split()) - THREAT
WILL = frozenset("will shall gonna i'll we'll he'll she'll they'll wanna vais va allons werde werden wird voy vamos va".split())
TARGET = frozenset("you your yours yourself u ya they them their he she him her those people tu toi te vous ton ta tes votre ils elles eux du dich dir dein deine ihr euch sie ti tus usted ustedes vosotros ellos ellas".split())
NEGATION = frozenset("not no never isn't aren't don't doesn't wasn't nobody without ne pas jamais aucun sans nicht kein keine nie niemals ohne nunca jamás sin ningún".split())
REPORT = frozenset("said says say claimed called reported reportedly alleged according quoted wrote told dit disait affirme selon sagte sagt laut behauptet meint dijo dice según afirma llamó".split())
STRONG = frozenset("such so very total complete utter absolute absolutely really damn tellement vraiment complètement völlig total absolut echt tan muy completamente".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»„]")
_CLAUSE = re.compile(r"[.!?;:\n\r…]+")
INSULT, THREATEN, WAS, WOULD, AIM, NOT, SAID, QUOTE, VERY, OTHER = SYMBOLS = "ITPWANRQVO"
#: Symbols that carry weight.
MARKS = INSULT + THREATEN
_CLASSES = ((THREAT, THREATEN), (PAST, WAS), (TARGET, AIM), (NEGATION, NOT), (REPORT, SAID), (WILL, WOULD), (STRONG, VERY))


class Transducer:
    """A weighted transducer that may guess: ``step(state, symbol)`` gives all ``(state, symbol out, weight)``, none where a guess has failed."""

    def __init__(self, step, start, final):
        self.step, self.start, self.final = step, start, final


class Composed:
    """The machine that feeds what each transducer puts out to the next one; its arcs are worked out once each, when they are met."""

    def __init__(self, parts):
        self.parts = tuple(parts)
        self.start = tuple(t.start for t in self.parts)
        self.arcs: dict = {}

    def step(self, state: tuple, symbol: str) -> list[tuple[tuple, str, float]]:
        found = self.arcs.get((state, symbol))
        if found is None:
            found = [((), symbol, 1.0)]
            for t, s in zip(self.parts, state, strict=True):
                found = [((*done, s2), out, w * v) for done, x, w in found for s2, out, v in t.step(s, x)]
            self.arcs[state, symbol] = found
        return found

    def final(self, state: tuple) -> bool:
        return all(t.final(s) for t, s in zip(self.parts, state, strict=True))

    def score(self, symbols, weights) -> float:
        """The sum of weights along the accepting path."""
        now = {self.start: 0.0}
        for x, weight in zip(symbols, weights, strict=True):
            after: dict = {}
            for state, total in now.items():
                for s, out, keep in self.step(state, x):
                    after[s] = total + weight * keep if out in MARKS else total
            now = after
        (found,) = (total for state, total in now.items() if self.final(state))
        return found


def _after(opens: str, length: int, weight: float, marks: str = MARKS) -> Transducer:
    """Marks within ``length`` symbols after an opening symbol get ``weight``."""

    def step(left: int, x: str):
        return [(length if x in opens else max(0, left - 1), x, weight if left and x in marks else 1.0)]

    return Transducer(step, 0, lambda left: True)


def _before(closes: str, length: int, weight: float) -> Transducer:
    """A mark gets ``weight`` if a closing symbol follows within ``length`` symbols and before the next mark.

    States: 0, or how many symbols are left and whether the closing one is promised.
    """

    def step(state, x: str):
        left, promised = state
        if x in MARKS:
            return [] if promised else [((length, True), x, weight), ((length, False), x, 1.0)]
        if x in closes and left:
            return [((0, False), x, 1.0)] if promised else []
        if left == 1 and promised:
            return []
        left = max(0, left - 1)
        return [((left, promised and left > 0), x, 1.0)]

    return Transducer(step, (0, False), lambda s: not s[1])


def _threat(near: int = 4) -> Transducer:
    """Threats pass if the clause has a target, and become other words if not; past forms need WOULD within ``near`` symbols before them.

    States: what is known of targets (n: none so far, t: one seen, p: promised, x: there will be none), and how long WOULD reaches.
    """

    def step(state, x: str):
        known, reach = state
        left = near if x == WOULD else max(0, reach - 1)
        if x == AIM:
            return [] if known == "x" else [(("t", left), x, 1.0)]
        if x == WAS:
            x = THREATEN if reach else OTHER
        if x != THREATEN:
            return [((known, left), x, 1.0)]
        if known == "n":
            return [(("p", left), THREATEN, 1.0), (("x", left), OTHER, 1.0)]
        return [((known, left), OTHER if known == "x" else THREATEN, 1.0)]

    return Transducer(step, ("n", 0), lambda s: s[0] != "p")


def _report(said: float, quoted: float) -> Transducer:
    """Marks in a clause with a reporting verb get ``said``, those inside quotes ``quoted``.

    States: what is known (0: nothing, 1: a mark and no report will come, p: a report is promised, r: one was seen), and whether a quote is open.
    """

    def step(state, x: str):
        known, open_ = state
        if x == QUOTE:
            return [((known, not open_), x, 1.0)]
        if x == SAID:
            return [] if known == "1" else [(("r", open_), x, 1.0)]
        if x not in MARKS:
            return [(state, x, 1.0)]
        keep = quoted if open_ else 1.0
        if known == "0":
            return [(("1", open_), x, keep), (("p", open_), x, keep * said)]
        return [(state, x, keep if known == "1" else keep * said)]

    return Transducer(step, ("0", False), lambda s: s[0] != "p")


#: The weights of the grammar: how much of its weight an insult or a threat keeps in its place.
SAID_KEEPS, QUOTED_KEEPS, NEGATED_KEEPS, AIMED, FOLLOWED, STRENGTHENED = 0.75, 0.9, 0.6, 1.25, 1.25, 1.1
#: The grammar, in the order of composition.
GRAMMAR = {
    "insult": _after(VERY, 2, STRENGTHENED, INSULT),
    "threat": _threat(),
    "target before": _after(AIM, 4, AIMED),
    "target after": _before(AIM, 3, FOLLOWED),
    "negation": _after(NOT, 3, NEGATED_KEEPS),
    "report": _report(SAID_KEEPS, QUOTED_KEEPS),
}


def machine() -> Composed:
    return Composed(GRAMMAR.values())


def features(text: str) -> set[str]:
    """Distinct words (ending with $) and word beginnings of a text."""
    words = set(_WORD.findall(text.lower()))
    return {w + "$" for w in words} | {w[:k] for w in words for k in STEMS if k < len(w)}


def _tail(n: int, k: int, p: float) -> float:
    """Log of about the chance of k or more hits in n tries."""
    if k <= n * p:
        return 0.0
    q = k / n
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """A lexicon with weights from ``(feature, toxic rows, clean rows)``; everything that tells enough goes in."""
    if not toxic or not clean:
        return {}
    base, log_chance = toxic / (toxic + clean), math.log(MAX_CHANCE)

    def judged(t: int, c: int) -> tuple[float, float]:
        return _tail(t + c, t, base), math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    order = sorted((judged(t, c)[0], -len(f), f, t, c) for f, t, c in counts if t >= 3)
    out: dict[str, float] = {}
    within: dict[str, tuple[int, int]] = {}  # what chosen entries under a beginning account for
    for chance, _, f, t, c in order:
        if chance > log_chance:
            break
        stem = f.rstrip("$")
        if any(stem[:k] in out for k in range(min(STEMS), len(stem) + (f[-1] == "$"))):
            continue
        t0, c0 = within.get(stem, (0, 0)) if f[-1] != "$" else (0, 0)
        chance, weight = judged(max(0, t - t0), max(0, c - c0))
        if weight < 2.5 or chance > log_chance or t - t0 < 3:
            continue
        out[f] = weight
        for k in range(min(STEMS), len(f)):
            x, y = within.get(f[:k], (0, 0))
            within[f[:k]] = (x + t, y + c)
    return out


class Scorer:
    """Clause scores of texts under a lexicon."""

    SCALE = 3.0

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.whole = {f[:-1]: w for f, w in lexicon.items() if f[-1] == "$"}
        self.stems = {f: w for f, w in lexicon.items() if f[-1] != "$"}
        self.fst = machine()
        self.finder = ahocorasick.Automaton()
        for w in THREAT | PAST | self.whole.keys() | self.stems.keys():
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def _class(self, word: str) -> tuple[str, float]:
        weight = self.whole.get(word)
        if weight is None:
            weight = next((self.stems[word[:k]] for k in STEMS if word[:k] in self.stems), None)
        if weight is not None:
            return INSULT, weight
        for group, name in _CLASSES:
            if word in group:
                return name, self.SCALE if name in (THREATEN, WAS) else 0.0
        return (QUOTE if not word[0].isalpha() else OTHER), 0.0

    def clause(self, clause: str) -> float:
        """The score of a clause: the sum along its path through the composed machine."""
        found = [self._class(w) for w in _WORD.findall(clause)]
        return self.fst.score(*zip(*found, strict=True)) if found else 0.0

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """``(start, end, score)`` of every matched clause, in the lower-cased text."""
        low = text.lower()
        out: list[tuple[int, int, float]] = []
        done = -1
        hits = sorted(end - size + 1 for end, size in self.finder.iter(low))
        for at in hits:
            if at < done or at and low[at - 1].isalpha():
                continue
            a = b = at
            while a and not _CLAUSE.match(low, a - 1):
                a -= 1
            m = _CLAUSE.search(low, at)
            b = m.start() if m else len(low)
            done = b
            score = self.clause(low[a:b])
            if score:
                out.append((a, b, score))
        return out

    def stats(self, text: str) -> tuple[float, float, int]:
        """Sum and largest of the clause scores, and how many matched."""
        scores = [s for _, _, s in self.clauses(text)]
        return sum(scores), max(scores, default=0.0), len(scores)


def _inputs(stats: np.ndarray) -> np.ndarray:
    total, most, n = stats[:, 0], stats[:, 1], stats[:, 2]
    return np.stack([np.ones(len(stats)), np.log1p(total), np.minimum(most, 12.0) / 4, (n > 0).astype(float)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Logistic weights by Newton steps; the first column is the constant."""
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * max(1, len(x)) / 100)
    pen[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pen * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Lexicon and logistic weights."""

    def __init__(self, lexicon: dict[str, float], weights: list[float]):
        self.lexicon, self.weights = lexicon, weights


#: Odd multipliers that give independent orders of the shingles' hashes.
_ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_keys(text: str, n: int = 4) -> list[int]:
    """The smallest hashes of a text's word shingles in several orders; texts with one in common may be near copies."""
    words = text.encode().lower().split()
    h = np.array([xxh64_intdigest(b" ".join(words[i : i + n])) for i in range(max(1, len(words) - n + 1))], np.uint64)
    return [int((h * m).min() >> np.uint64(1)) for m in _ORDERS]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from the labelled rows given, at most ``max_labelled`` of them.

    Labels that are null don't count; a row that has several labels has the
    largest.  With one class or none the lexicon is empty.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = common.texts(docs).join(F.broadcast(sample), "doc_id")  # a bounded number of short rows

    def tag(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([shingle_keys(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "text", "label", "keys"])

    steps = common.Scratch(spark)
    tagged = steps.written(common.map_batches(rows, tag, "doc_id long, text string, label int, keys array<long>"), "toxic-rows")
    keys = tagged.select("doc_id", F.posexplode("keys").alias("k", "key"))
    # Written out, so that a key that very many rows share can be split in the join: an aggregate beside it would forbid that.
    firsts = steps.written(keys.groupBy("k", "key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "toxic-firsts")
    met = keys.join(firsts, ["k", "key"]).where("first < doc_id").select("first", "doc_id").distinct()
    pairs = met.join(tagged.select("doc_id", "text"), "doc_id").join(tagged.select(F.col("doc_id").alias("first"), F.col("text").alias("other")), "first").select("doc_id", "text", "other")

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(common.as_bytes(batch.column(1)), common.as_bytes(batch.column(2)), strict=True)
        return batch.select(["doc_id"]).filter(pa.array([similar(a, b) for a, b in both], pa.bool_()))

    copies = common.map_batches(pairs, alike, "doc_id long").distinct()
    once = tagged.join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id"]).drop("keys")
    once = steps.written(once, "toxic-once")
    sizes = {r["label"]: r["count"] for r in once.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    telling = [tuple(r) for r in _telling(_feature_counts(once), toxic, clean).collect()] if toxic and clean else []
    lexicon = choose(telling, toxic, clean)

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = Scorer(lexicon)
        out = [scorer.stats(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([float(x[k]) for x in out]) for k in range(3)] + [batch.column(1)], names=["total", "most", "n", "label"])

    pdf: pd.DataFrame = common.map_batches(once.select("text", "label"), stats, "total double, most double, n double, label int").toPandas()
    y = (pdf["label"].to_numpy() > 0).astype(float)
    weights = _logistic(_inputs(pdf[["total", "most", "n"]].to_numpy(float)), y) if len(y) else np.zeros(4)
    steps.keep()
    return Model(lexicon, weights.tolist())


#: Features that a task counts before it sends the counts on.
PARTIAL = 200_000


def _feature_counts(rows: DataFrame) -> DataFrame:
    """``(feature, t, c)``: the toxic and the clean rows ``(text, label)`` that have it."""

    def sent(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], names=["feature", "t", "c"])
        for c in counts:
            c.clear()
        return out

    def run(batches):
        counts = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label <= 0].update(features(text))
                if sum(map(len, counts)) > PARTIAL:
                    yield sent(counts)
        yield sent(counts)

    return rows.select("text", "label").mapInArrow(run, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _telling(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Features whose count among toxic rows is unlikely enough; see :func:`_tail`."""
    base = toxic / (toxic + clean)
    n, q = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / F.lit(1 - base))).otherwise(0.0)
    return counts.where("t >= 3").where((F.col("t") > n * base) & (-n * (q * F.log(q / F.lit(base)) + rest) <= math.log(MAX_CHANCE) + 1e-6))


def _probabilities(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and clause statistics; one scorer a worker process."""
    scorer = common.worker_state("toxicity", tuple(model.lexicon.items()), lambda: Scorer(model.lexicon))
    stats = np.array([scorer.stats(t) for t in texts], float).reshape(-1, 3)
    return 1 / (1 + np.exp(-np.clip(_inputs(stats) @ np.array(model.weights), -30, 30))), stats


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, n_clauses)`` of every row; texts are never cut. Null and empty texts match nothing.

    Rows are scored one by one: repeated rows, ids or nulls change nothing,
    and an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, stats = _probabilities(model, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(stats[:, 2].astype(np.int64))], names=["doc_id", "score", "n_clauses"])

    return common.map_batches(common.texts(docs), run, "doc_id long, score double, n_clauses long", "toxicity")


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, that score below the threshold."""
    return common.keep_rows(docs, lambda texts: _probabilities(model, [t.decode() for t in texts])[0] < threshold, owner="toxicity")


def held_out(modulus: int = 4, remainder: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_clauses)``; learns from the labels that aren't held out."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")
