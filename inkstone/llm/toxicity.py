"""Operator 6: toxicity by a weighted finite-state pattern grammar.

A lexicon turns words into symbols: insults (fixed seeds and terms learnt from labelled texts: words, backed off to
word beginnings), verbs of harm, intent, targets, negations, verbs of reported speech, ends of clauses and sentences.
Five transducers read the symbols, each what the one before gives. They mark insults and piled-up insults, harm that
is intended, what stands in the scope of a negation, what is reported, and last give at the end of each clause the
kind of the heaviest match in it, and whether the clause has a target. They are composed into one machine.

What is scored is the clause: its kind has a weight, times the chance of the term that it matched. A text's log-odds are
a bias, the weights of its matched clauses (each term at its heaviest clause, so that repeated lines count once) and a
small weight for its most suspicious other word, which ranks the texts without a match. Bias and weights are fitted
together, by logistic regression that leans on prior weights.

Learning takes at most SAMPLE labelled rows of the folds that may be learnt from, in whole texts and without
near copies among them.

Defined cases: a null or empty text, or one without a match, has the score of the bias; without labelled rows the
prior weights hold; rows that repeat are each scored; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_map, crc_mod, labelled_sample, table, utf8_view, without_copies

SAMPLE = 6000
THRESHOLD = 0.7
CACHE = 100_000
#: Lengths of word beginnings that terms are backed off to, and how many texts the shorter one counts as.
STEMS, BACKOFF = (3, 4, 5, 6, 7, 8, 9), 4.0
#: For a term to count as an insult: the least chance that a text with it is toxic, and the least
#: gain in log-likelihood over the share of toxic texts, so that chance finds among all terms don't count.
MIN_CHANCE, MIN_GAIN = 0.6, 13.0
#: The least gain of a hint.
HINT_GAIN = 6.0
#: Texts with a word under an insult's beginning that can tell the word from the others.
MIN_TEXTS = 3
SEED_WEIGHT, SEED_ROWS = 0.8, 2.0

#: Seeds of the grammar.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile bastard dumbass retard scumbag".split()
INSULTS += "idiote imbécile connard salaud crétin dummkopf vollidiot arschloch trottel estúpido imbécil gilipollas cabrón".split()
HARM = "kill murder hurt destroy beat stab tuer frapper töten schlagen matar golpear".split()
INTENT = "will gonna going i'll we'll shall must should vais allons werde werden voy vamos".split()
TARGETS = "you your yours he she they him her them tu toi vous du dich ihr euch sie usted ustedes vosotros".split()
NEGATIONS = "not never no neither nor isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says called calls wrote claimed reported quoted quote alleged dit disait écrit sagte schrieb behauptet dijo escribió".split()

#: Symbols of words: other, insult, harm, intent, target, negation, report, end of clause, end of sentence.
OTHER, ABUSE, VIOLENCE, AIM, TARGET, NEGATION, REPORT, CLAUSE, SENTENCE = "O i h w T N R , .".split()
BASE = (OTHER, ABUSE, VIOLENCE, AIM, TARGET, NEGATION, REPORT, CLAUSE, SENTENCE)
#: Symbols of matches: insult, piled-up insult, threat, harm without intent. Marks: negated, reported, with a target.
INSULT, PILED, THREAT, LOOSE = "I J H V".split()
MATCHES = (INSULT, PILED, THREAT, LOOSE)
NEGATED, REPORTED, AIMED = '-"@'
#: Log-odds that a match adds for a term that is surely bad, before learning, what marks do to them, and the bias.
PRIOR = {INSULT: 7.0, PILED: 8.0, THREAT: 6.0, LOOSE: 1.0}
MARKS = {NEGATED: 0.4, REPORTED: 0.6, AIMED: 1.2}
PRIOR_BIAS, PRIOR_HINT, RIDGE, STEPS = -4.0, 1.0, 0.05, 50
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff][0-9A-Za-z\x80-\xff']*|[.!?;:,\n]")
ENDS = {b".": SENTENCE, b"!": SENTENCE, b"?": SENTENCE, b"\n": SENTENCE, b";": CLAUSE, b":": CLAUSE, b",": CLAUSE}


@dataclass
class Transducer:
    """arcs: (state, symbol) -> (state, symbol given, weight); a pair without an arc stays and copies."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def run(self, symbols) -> list[tuple[str, float]]:
        state, out = self.start, []
        for s in symbols:
            state, given, weight = self.step(state, s)
            out.append((given, weight))
        return out


def compose(a: Transducer, b: Transducer, alphabet) -> Transducer:
    """The machine that feeds what ``a`` gives to ``b``; weights multiply. Only reachable states are built."""
    out, todo, seen = Transducer((a.start, b.start)), [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        p, q = todo.pop()
        for s in alphabet:
            p2, mid, w1 = a.step(p, s)
            q2, given, w2 = b.step(q, mid)
            out.arcs[(p, q), s] = ((p2, q2), given, w1 * w2)
            if (p2, q2) not in seen:
                seen.add((p2, q2))
                todo.append((p2, q2))
    return out


def insult_machine() -> Transducer:
    """Gives an insult for a term of abuse, a piled-up one where its clause has had one before."""
    t = Transducer(0)
    for n in (0, 1):
        t.arcs[n, ABUSE] = (1, PILED if n else INSULT, 1.0)
        for s in (CLAUSE, SENTENCE):
            t.arcs[n, s] = (0, s, 1.0)
    return t


def threat_machine(scope: int = 4) -> Transducer:
    """Gives a threat for a verb of harm among the ``scope`` words after one of intent, else harm without intent."""
    t = Transducer(0)
    for n in range(scope + 1):
        t.arcs[n, AIM] = (scope, OTHER, 1.0)
        t.arcs[n, VIOLENCE] = (max(0, n - 1), THREAT if n else LOOSE, 1.0)
        for s in (OTHER, TARGET, NEGATION, REPORT, INSULT, PILED):
            t.arcs[n, s] = (max(0, n - 1), s, 1.0)
        for s in (CLAUSE, SENTENCE):
            t.arcs[n, s] = (0, s, 1.0)
    return t


def negation_machine(scope: int = 3) -> Transducer:
    """Marks matches among the ``scope`` words after a negation, within the clause."""
    t = Transducer(0)
    for n in range(scope + 1):
        t.arcs[n, NEGATION] = (scope, NEGATION, 1.0)
        for s in (OTHER, TARGET, REPORT):
            t.arcs[n, s] = (max(0, n - 1), s, 1.0)
        for s in MATCHES:
            t.arcs[n, s] = (max(0, n - 1), s + (NEGATED if n else ""), 1.0)
        for s in (CLAUSE, SENTENCE):
            t.arcs[n, s] = (0, s, 1.0)
    return t


def report_machine() -> Transducer:
    """Marks what stands after a verb of reported speech, within the sentence."""
    t = Transducer(0)
    for n in (0, 1):
        t.arcs[n, REPORT] = (1, REPORT, 1.0)
        t.arcs[n, SENTENCE] = (0, SENTENCE, 1.0)
        for s in MATCHES:
            for mark in ("", NEGATED):
                t.arcs[n, s + mark] = (n, s + mark + (REPORTED if n else ""), 1.0)
    return t


def target_machine() -> Transducer:
    """Gives at the end of a clause the kind of its heaviest match, marked where the clause has a target."""
    t = Transducer((False, ""))
    kinds = [m + a + b for m in MATCHES for a in ("", NEGATED) for b in ("", REPORTED)]
    for aimed in (False, True):
        for held in ("", *kinds):
            t.arcs[(aimed, held), TARGET] = ((True, held), TARGET, 1.0)
            for s in (CLAUSE, SENTENCE):
                t.arcs[(aimed, held), s] = ((False, ""), held + (AIMED if aimed and held else "") or s, 1.0)
            for k in kinds:
                t.arcs[(aimed, held), k] = ((aimed, max(held, k, key=lambda x: (prior(x), x))), k, 1.0)
    return t


MACHINES = (insult_machine, threat_machine, negation_machine, report_machine, target_machine)


@cache
def grammar() -> Transducer:
    """The five machines as one."""
    out = MACHINES[0]()
    for machine in MACHINES[1:]:
        out = compose(out, machine(), BASE)
    return out


@cache
def numbered() -> tuple[dict, list]:
    """The grammar with states as numbers: symbol -> (next states, what is given)."""
    arcs = grammar().arcs
    states = {s: i for i, s in enumerate(sorted({s for s, _ in arcs}, key=repr))}
    order = sorted(states, key=states.get)
    return {x: ([states[arcs[s, x][0]] for s in order], [arcs[s, x][1] for s in order]) for x in BASE}, [states[grammar().start]]


@cache
def prior(kind: str) -> float:
    """Log-odds of a kind of clause before learning."""
    w = PRIOR.get(kind[:1], 0.0)
    for mark in kind[1:]:
        w *= MARKS[mark]
    return w


KINDS = tuple(m + a + b + c for m in MATCHES for a in ("", NEGATED) for b in ("", REPORTED) for c in ("", AIMED))


@dataclass
class Model:
    """chance: of words, and of beginnings with a star; a word not in it has that of its longest beginning.

    hints are terms more frequent in toxic texts, but too weak or too rare for the lexicon.
    """

    chance: dict[str, float]
    kinds: dict[str, float] = field(default_factory=lambda: {k: prior(k) for k in KINDS})
    hints: dict[str, float] = field(default_factory=dict)
    bias: float = PRIOR_BIAS
    hint_weight: float = PRIOR_HINT

    def symbol(self, word: str) -> tuple[str, float, float]:
        """(symbol, chance of a match, hint) of a word."""
        terms = backed_off(word)
        known = next((self.chance[x] for x in terms if x in self.chance), 0.0)
        if known >= MIN_CHANCE:
            return ABUSE, known, 0.0
        return *FIXED.get(word, (OTHER, 0.0)), max((self.hints[x] for x in terms if x in self.hints), default=0.0)

    def clauses(self, symbols: list[tuple]) -> list[tuple]:
        """(kind, chance of its heaviest term, terms) of each matched clause."""
        arcs, (state,) = numbered()
        out, held = [], []
        for symbol, chance, word, _ in [*symbols, (SENTENCE, 0.0, "", 0.0)]:
            follow, given = arcs[symbol]
            if chance:
                held.append((chance, word))
            if held and symbol in (CLAUSE, SENTENCE):
                out.append((given[state], max(held)[0], tuple(sorted({w for _, w in held}))))
                held = []
            state = follow[state]
        return out

    def evidence(self, symbols: list[tuple]) -> tuple[dict[str, float], float]:
        """For each kind of clause the sum of the chances of its terms, and the heaviest hint."""
        hint = max((s[3] for s in symbols), default=0.0)
        best: dict[tuple, tuple] = {}
        if any(s[1] for s in symbols):
            for kind, chance, words in self.clauses(symbols):
                x = (prior(kind) * chance, kind, chance)
                best[words] = max(best.get(words, x), x)
        out: dict[str, float] = {}
        for _, kind, chance in best.values():
            out[kind] = out.get(kind, 0.0) + chance
        return out, hint

    def score(self, symbols: list[tuple]) -> float:
        found, hint = self.evidence(symbols)
        margin = self.bias + self.hint_weight * hint + sum(self.kinds[k] * found[k] for k in sorted(found))
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, margin))))


FIXED = {w: (VIOLENCE, 0.9) for w in HARM} | {w: (AIM, 0.0) for w in INTENT} | {w: (TARGET, 0.0) for w in TARGETS}
FIXED |= {w: (NEGATION, 0.0) for w in NEGATIONS} | {w: (REPORT, 0.0) for w in REPORTS}


class Symbols(dict):
    """Symbols of words already seen, emptied where it has grown to CACHE words."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: bytes):
        if len(self) >= CACHE:
            self.clear()
        word = token.decode("utf-8", "replace").lower()
        if token in ENDS:
            found = (ENDS[token], 0.0, "", 0.0)
        else:
            symbol, chance, hint = self.model.symbol(word)
            found = (symbol, chance, word, hint)
        self[token] = found
        return found

    def score(self, text: bytes) -> float:
        return self.model.score([self[t] for t in TOKEN.findall(text)])


def backed_off(word: str) -> list[str]:
    """The word, then its beginnings from the longest to the shortest."""
    return [word, *(word[:k] + "*" for k in reversed(STEMS) if len(word) >= k)]


def _terms(text: str) -> set[str]:
    words = {t.decode("utf-8", "replace").lower() for t in TOKEN.findall(text.encode()) if t not in ENDS}
    return {x for w in words for x in backed_off(w)}


def chances(sample: list[tuple[str, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Chance that a text with a term is toxic, each smoothed towards that of the next shorter beginning.

    Kept are the insults and, under an insult's beginning, what is known of longer terms; then, apart, the hints.
    """
    pos = Counter(x for t, y in sample if y for x in _terms(t))
    neg = Counter(x for t, y in sample if not y for x in _terms(t) if x in pos)
    base = sum(y for _, y in sample) / len(sample)
    shorter = lambda x: next(iter(backed_off(x.rstrip("*"))[1 + x.endswith("*") :]), None)
    out: dict[str, float] = {}

    def chance(x: str | None) -> float:
        if x is None:
            return base
        if x not in out:
            out[x] = (pos[x] + BACKOFF * chance(shorter(x))) / (pos[x] + neg[x] + BACKOFF)
        return out[x]

    def gain(x: str) -> float:
        n, p = pos[x] + neg[x], (pos[x] + 0.5) / (pos[x] + neg[x] + 1.0)
        return pos[x] * math.log(p / base) + (n - pos[x]) * math.log((1 - p) / (1 - base)) if 0 < base < 1 else 0.0

    for x in sorted(pos, key=len):
        chance(x)
    high = {x for x, p in out.items() if p >= MIN_CHANCE and gain(x) >= MIN_GAIN}
    under = lambda x: any(y in high for y in backed_off(x.rstrip("*"))[1 + x.endswith("*") :])
    clean = Counter(x for t, y in sample if not y for x in _terms(t) if x not in pos and under(x))
    neg.update(clean)
    for x in sorted(clean):
        chance(x)
    hints = {x: p for x, p in out.items() if x not in high and not under(x) and p >= 2 * base and gain(x) >= HINT_GAIN}
    return {x: p for x, p in out.items() if x in high or (pos[x] + neg[x] >= MIN_TEXTS and under(x))}, hints


def weighed(found: np.ndarray, y: np.ndarray, lean: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of ``y`` on the columns of ``found``, with a ridge towards ``lean``."""
    w = lean.copy()
    for _ in range(STEPS):
        p = 1.0 / (1.0 + np.exp(-np.clip(found @ w, -35, 35)))
        slope = found.T @ (y - p) - RIDGE * (w - lean)
        curve = (found * (p * (1 - p))[:, None]).T @ found + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(sample: list[tuple[str, int]]) -> Model:
    """Chances of the terms, then bias and weights of the kinds of clause together; seeds count as SEED_ROWS texts."""
    model = Model({w: SEED_WEIGHT for w in INSULTS})
    if not sample:
        return model
    model.chance, model.hints = chances(sample)
    has = Counter((w, y) for t, y in sample for w in _terms(t) & set(INSULTS))
    for w in INSULTS:
        model.chance[w] = (has[w, 1] + SEED_WEIGHT * SEED_ROWS) / (has[w, 0] + has[w, 1] + SEED_ROWS)
    symbols, rows = Symbols(model), np.zeros((len(sample), len(KINDS) + 2))
    for row, (text, _) in zip(rows, sample, strict=True):
        found, row[1] = model.evidence([symbols[t] for t in TOKEN.findall(text.encode())])
        row[0] = 1.0
        for k, x in found.items():
            row[2 + KINDS.index(k)] = x
    lean = np.array([PRIOR_BIAS, PRIOR_HINT, *map(prior, KINDS)])
    w = weighed(rows, np.array([y for _, y in sample], np.float64), lean).tolist()
    # a match is never a sign of a clean text
    model.bias, model.hint_weight, model.kinds = w[0], max(0.0, min(PRIOR_HINT, w[1])), {k: max(0.0, x) for k, x in zip(KINDS, w[2:], strict=True)}
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    symbols = Symbols(model)
    for batch in batches:
        data, off = utf8_view(batch.column(2))
        raw = data.tobytes()
        out = [symbols.score(raw[off[i] : off[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])


def toxicity_scores(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out and score of each row of ``docs``."""
    return arrow_map(docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"), "text"), partial(_score, model=model), "doc_id long, held_out boolean, score double")


def _without(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    symbols = Symbols(model)
    for batch in batches:
        data, off = utf8_view(batch.column(at))
        raw = data.tobytes()
        yield batch.filter(pa.array([symbols.score(raw[off[i] : off[i + 1]]) < THRESHOLD for i in range(batch.num_rows)], pa.bool_()))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold; nothing is shuffled."""
    return arrow_map(docs, partial(_without, model=model, at=docs.columns.index("text")), docs.schema)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return learn(without_copies(labelled_sample(docs, labels, "toxic", 3, 1, SAMPLE)))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, fitted(docs, table(spark, sf_dir, "labels")), crc_mod("doc_id", 3) == 1)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
