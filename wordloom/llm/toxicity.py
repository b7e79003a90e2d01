"""Toxicity: a weighted finite-state pattern grammar over clauses.

Five transducers are composed by one generic composition. Their symbols are word classes (insult, threat, target, negation,
report, other); every arc has an input, an output, a weight and a next state:

* the threat transducer lets a threat pass only after a target or an insult, or turns it into one when a target follows within
  reach; a threat at nobody becomes an other word;
* the insult transducer gives insults and threats their weight (an insult's own comes from the lexicon);
* the target transducer adds weight to what follows a target in its clause;
* the negation transducer takes weight from what follows a negation within REACH words;
* the reported-speech transducer takes weight from what follows a word of saying.

The lexical transducer maps words to symbols. It reads an insult or threat as such or as an other word, so a clause has
several paths; its weight is that of the best path, from the clause's true start to its end. A text's evidence is the sum
over matched clauses; its score is the share of toxic training rows at that much evidence, smoothed and never falling.

Insults are learned: words, and stems that many words of toxic training rows begin with, that stand in many different contexts
there (copies of one text share contexts and count once) and hardly ever in clean rows, with their log-odds as weight. Threats
are learned the same way, from words with a target within REACH words before them, where they are no insults. Texts are
searched whole by one Aho-Corasick pass; only clauses around a hit are walked.

Defined cases: null or empty text has no evidence and the lowest score; labels other than 0 and 1 are not used; rows with a
null id are scored and never learned from; without training rows the fixed words alone decide; words repeat and tie freely;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import packed, saved, ship, small_batches

#: Labelled rows learned from (about; chosen by hash), contexts an insult or threat needs, its least share of toxic contexts.
SAMPLE_ROWS, CONTEXTS, SHARE = 20_000, 8, 0.75
#: Letters of a stem, and the different words that must begin with it.
STEM, STEM_WORDS = range(4, 9), 6
#: Fixed words of the grammar's classes, in English, French, German and Spanish.
TARGETS = {"you", "your", "youre", "yourself", "they", "them", "he", "she", "him", "her", "these", "those", "people", "tu", "toi", "vous", "ils", "elles", "du", "dich", "dir", "ihr", "euch", "sie", "te", "ti", "usted", "ustedes", "ellos"}
NEGATIONS = {"not", "no", "never", "isnt", "arent", "nobody", "ne", "pas", "jamais", "nicht", "kein", "keine", "nie", "nunca", "jamas"}
REPORTS = {"said", "says", "say", "called", "calls", "quoted", "wrote", "claimed", "dit", "disait", "sagte", "sagt", "nannte", "dijo", "dice"}
THREATS = {"kill", "kills", "killing", "murder", "murders", "strangle", "strangles", "stab", "stabs", "slaughter", "slaughters", "exterminate", "exterminates", "tuer", "tuerai", "assassiner", "étrangler", "égorger", "töten", "umbringen", "ermorden", "erwürgen", "erstechen", "matar", "mataré", "asesinar", "estrangular", "degollar"}
INSULT_SEEDS = {"idiot", "moron", "scum", "stupid", "loser", "imbecile"}
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")
SEED_WEIGHT, TARGET_WEIGHT, NEGATED_WEIGHT, REPORTED_WEIGHT, THREAT_WEIGHT = 3.0, 0.7, -1.5, -1.0, 2.0
#: Words that a negation or an announced threat reaches.
REACH = 3
SYMBOLS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = ("other", "insult", "threat", "target", "negation", "report")


@dataclass(frozen=True)
class Transducer:
    """arcs: state -> input -> (output, weight, next state), several for one input where paths part; every state may end."""

    start: object
    arcs: dict[object, dict[str, tuple[tuple[str, float, object], ...]]]


def transducer(start: object, states: Iterable[object], arcs: Iterable[tuple[object, str, str, float, object]], rest=lambda state, symbol: state) -> Transducer:
    """A transducer of the arcs (state, input, output, weight, next); symbols without an arc pass, to the state that rest gives."""
    table: dict[object, dict[str, tuple]] = {s: {} for s in states}
    for state, given, out, weight, then in arcs:
        table[state][given] = (*table[state].get(given, ()), (out, weight, then))
    for state, known in table.items():
        for symbol in SYMBOLS:
            known.setdefault(symbol, ((symbol, 0.0, rest(state, symbol)),))
    return Transducer(start, table)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what first reads and writes what second writes of first's output."""
    start, arcs = (first.start, second.start), {}
    waiting = deque([start])
    while waiting:
        state = waiting.popleft()
        if state in arcs:
            continue
        arcs[state] = {
            symbol: tuple((out, w1 + w2, (then1, then2)) for middle, w1, then1 in found for out, w2, then2 in second.arcs[state[1]][middle])
            for symbol, found in first.arcs[state[0]].items()
        }
        waiting.extend(then for found in arcs[state].values() for _, _, then in found)
    return Transducer(start, arcs)


def _threats() -> Transducer:
    quiet, aimed, said = "quiet", "aimed", tuple(range(1, REACH + 1))
    arcs = [(quiet, THREAT, OTHER, 0.0, REACH), (quiet, TARGET, TARGET, 0.0, aimed), (quiet, INSULT, INSULT, 0.0, aimed)]
    for k in said:
        arcs += [(k, TARGET, THREAT, 0.0, aimed), (k, THREAT, OTHER, 0.0, REACH), (k, INSULT, INSULT, 0.0, aimed)]
    return transducer(quiet, (quiet, aimed, *said), arcs, lambda state, _: (state - 1 or quiet) if state in said else state)


def _modified(mark: str, weight: float) -> Transducer:
    """Insults and threats after the mark weigh more or less, up to the clause's end."""
    return transducer(0, (0, 1), [(0, mark, mark, 0.0, 1), (1, INSULT, INSULT, weight, 1), (1, THREAT, THREAT, weight, 1)])


def _negations() -> Transducer:
    """A negation reaches the next REACH words, but no more than one insult or threat."""
    near = range(1, REACH + 1)
    arcs = [(k, NEGATION, NEGATION, 0.0, REACH) for k in range(REACH + 1)]
    arcs += [(k, x, x, NEGATED_WEIGHT, 0) for k in near for x in (INSULT, THREAT)]
    return transducer(0, range(REACH + 1), arcs, lambda state, _: max(0, state - 1))


def grammar_transducer() -> Transducer:
    insults = transducer(0, (0,), [(0, THREAT, THREAT, THREAT_WEIGHT, 0)])
    return reduce(compose, (_threats(), insults, _modified(TARGET, TARGET_WEIGHT), _negations(), _modified(REPORT, REPORTED_WEIGHT)))


MACHINE = grammar_transducer()


@dataclass(frozen=True)
class Grammar:
    """Insult weights and learned threats (whole words, written with a closing $, and stems), and the score of each amount of evidence."""

    insults: dict[str, float]
    steps: tuple[float, ...] = (0.5,)
    scores: tuple[float, ...] = (0.05, 0.9)
    threats: frozenset[str] = frozenset()

    def readings(self, word: str) -> tuple[tuple[str, float], ...]:
        """The lexical transducer: a word's symbols and their weights."""
        for unit in _units(word):
            if unit in self.insults:
                return (INSULT, self.insults[unit]), (OTHER, 0.0)
        if word in THREATS or any(unit in self.threats for unit in _units(word)):
            return (THREAT, 0.0), (OTHER, 0.0)
        for name, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in words:
                return ((name, 0.0),)
        return ((OTHER, 0.0),)

    def walk(self, clause: str) -> float:
        """Weight of the clause's best path."""
        best = {MACHINE.start: 0.0}
        for word in WORD.findall(clause):
            after: dict[object, float] = {}
            for symbol, own in self.readings(word):
                for state, weight in best.items():
                    for _, arc, then in MACHINE.arcs[state][symbol]:
                        total = weight + own + arc
                        if total > after.get(then, -math.inf):
                            after[then] = total
            best = after
        return max(best.values())

    def machine(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for unit in sorted({*self.insults, *self.threats, *(f"{w}$" for w in THREATS)}, reverse=True):  # a stem after the word it equals
            word = unit.removesuffix("$")
            found.add_word(word, (len(word), unit != word))
        found.make_automaton()
        return found

    def evidence(self, text: str | None, machine: ahocorasick.Automaton) -> float:
        """Sum of the weights of the clauses that hold an insult or a threat."""
        if not text:
            return 0.0
        lower = text.lower()
        done, total = 0, 0.0
        for end, (size, whole) in machine.iter(lower):
            start = end - size + 1
            if start < done or (start and lower[start - 1].isalpha()) or (whole and end + 1 < len(lower) and lower[end + 1].isalpha()):
                continue
            # every character is looked at once: clauses before this one hold no hit
            begin = done
            for cut in CLAUSE_END.finditer(lower, done, start):
                begin = cut.end()
            stop = CLAUSE_END.search(lower, end)
            done = stop.start() if stop else len(lower)
            total += self.walk(lower[begin:done])
        return total

    def score(self, evidence: float) -> float:
        return self.scores[bisect_right(self.steps, evidence)]


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _units(word: str) -> list[str]:
    """The word as a whole and its stems, the shortest first."""
    return [word[:n] for n in STEM if n <= len(word)] + [f"{word}$"]


def _aimed(words: list[str], i: int) -> bool:
    return any(w in TARGETS for w in words[max(0, i - REACH) : i])


def _found(texts: list[str | None], only: dict[str, int] | None):
    """(unit, the word before, the word, the word after) of all units of the texts, or of those in only, by number."""
    known: dict[str, list] = {}
    for text in texts:
        words = _words(text or "")
        for i, w in enumerate(words):
            if w not in known:
                known[w] = [u if only is None else only[u] for u in (*_units(w), f"{w}@") if only is None or u in only]
                at = f"{w}@" if only is None else only.get(f"{w}@")
                known[w] = [u for u in known[w] if u != at], at
            units, at = known[w]
            if at is not None and _aimed(words, i):
                units = [*units, at]
            for u in units:
                yield u, words[i - 1] if i else "", w, words[i + 1] if i + 1 < len(words) else ""


def _bounds(rows: DataFrame) -> DataFrame:
    """unit, most: no unit of rows(text) has more different contexts; sums over batches."""

    def run(batches):
        for batch in batches:
            count: dict[str, int] = {}
            for u, *_ in set(_found(batch.column(0).to_pylist(), None)):
                count[u] = count.get(u, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["unit", "n"])

    return rows.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("most"))


def _ruled_out(rows: DataFrame, only: dict[str, int], limits: list[float]) -> DataFrame:
    """unit (by number): those with more different contexts in rows(text) than their limit, as far as single tasks can tell."""

    def run(batches):
        seen: dict[int, set[int]] = {}
        out: set[int] = set()
        for batch in batches:
            before = len(out)
            new = []
            for u, *at in _found(batch.column(0).to_pylist(), only):
                if u not in out:
                    own = seen.setdefault(u, set())
                    own.add(hash(tuple(at)))
                    if len(own) > limits[u]:
                        # a unit is followed no further than to its limit
                        out.add(u)
                        del seen[u]
                        new.append(u)
            if len(out) > before:
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64())], ["unit"])

    return rows.select("text").mapInArrow(run, "unit long").distinct()


def _contexts(rows: DataFrame, only: dict[str, int]) -> DataFrame:
    """unit (by number), toxic, contexts, words: different neighbourhoods and words of each unit of rows(text, toxic)."""

    def run(batches):
        for batch in batches:
            labels = batch.column(1).to_pylist()
            seen = {(label, *x) for label in (0, 1) for x in _found([t for t, y in zip(batch.column(0).to_pylist(), labels, strict=True) if y == label], only)}
            columns = [pa.array([x[0] for x in seen], pa.int32()), pa.array([x[1] for x in seen], pa.int64()), pa.array([f"{x[2]} {x[4]}" for x in seen], pa.string()), pa.array([x[3] for x in seen], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "unit", "context", "word"])

    rows = rows.select("text", "toxic").mapInArrow(run, "toxic int, unit long, context string, word string")
    rows = rows.select("toxic", "unit", F.xxhash64("context", "word").alias("context"), F.xxhash64("word").alias("word")).distinct()
    return rows.groupBy("toxic", "unit", "word").count().groupBy("toxic", "unit").agg(F.sum("count").alias("contexts"), F.count("*").alias("words"))


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from docs(doc_id, text) and the labels(doc_id, toxic) of training rows.

    Units that bounds rule out - too few contexts in toxic rows, or too many in clean ones - are left before contexts are
    counted exactly.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession, 100)
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    parts = max(1, round(usable.count() / SAMPLE_ROWS))
    chosen = lambda df: df.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(parts)) == 0)
    rows = saved(chosen(docs.select("doc_id", "text")).join(F.broadcast(chosen(usable)), "doc_id").select("text", "toxic"), "labelled")  # about SAMPLE_ROWS
    most = {r["unit"]: r["most"] for r in _bounds(rows.filter("toxic = 1")).filter(F.col("most") >= CONTEXTS).collect()}  # units of the sample
    named = sorted(most)
    if named:
        limits = [most[u] * (1 - SHARE) / SHARE for u in named]
        gone = {r["unit"] for r in _ruled_out(rows.filter("toxic = 0"), {u: i for i, u in enumerate(named)}, limits).collect()}
        named = [u for i, u in enumerate(named) if i not in gone]
    bad: dict[str, int] = {}
    good: dict[str, int] = {}
    for r in _contexts(rows, {u: i for i, u in enumerate(named)}).collect() if named else []:
        u = named[r["unit"]]
        if not r["toxic"]:
            good[u] = r["contexts"]
        elif r["contexts"] >= CONTEXTS and (u[-1] in "$@" or r["words"] >= STEM_WORDS):
            bad[u] = r["contexts"]
    found = {u: c for u, c in bad.items() if c >= SHARE * (c + good.get(u, 0))}
    # a unit under a shorter stem says no more than that stem
    covered = lambda word, own: any(u != own and u in found for u in _units(word))
    insults = {u: math.log((c + 0.5) / (good.get(u, 0) + 0.5)) for u, c in sorted(found.items()) if u[-1] != "@" and not any(u != v and v in found for v in _units(u.removesuffix("$"))[:-1])}
    insults |= {f"{w}$": SEED_WEIGHT for w in INSULT_SEEDS if not any(u in insults for u in _units(w))}
    threats = frozenset(f"{u[:-1]}$" for u in found if u[-1] == "@" and not covered(u[:-1], u) and u[:-1] not in TARGETS | NEGATIONS | REPORTS)
    grammar = Grammar(insults, threats=threats)
    counted = _evidence(rows, grammar, "toxic").groupBy("toxic", F.least(F.floor(F.col("evidence") * 2) / 2, F.lit(40.0)).alias("evidence")).count().collect()
    return calibrated(grammar, [(r["evidence"], r["toxic"], r["count"]) for r in counted])


def calibrated(grammar: Grammar, counts: list[tuple[float, int, int]]) -> Grammar:
    """Steps and scores: the smoothed toxic share of each amount of evidence, pooled where it would fall."""
    by: dict[float, list[float]] = {}
    for at, toxic, c in counts:
        by.setdefault(at, [0.0, 0.0])[toxic] += c
    if not by:
        return grammar
    pools: list[list[float]] = []  # first evidence, clean, toxic
    for at in sorted(by):
        # as much prior as one row: clean without evidence, toxic with it
        clean, toxic = by[at][0] + (at == 0), by[at][1] + (at > 0)
        pools.append([at, clean, toxic])
        while len(pools) > 1 and pools[-2][2] * sum(pools[-1][1:]) >= pools[-1][2] * sum(pools[-2][1:]):
            _, c, t = pools.pop()
            pools[-1][1] += c
            pools[-1][2] += t
    if pools[0][0] > 0:
        pools.insert(0, [0.0, 1.0, 0.0])
    scores = tuple(t / (c + t) for _, c, t in pools)
    return Grammar(grammar.insults, tuple(p[0] for p in pools[1:]), scores, grammar.threats)


def _evidence(docs: DataFrame, grammar: Grammar, *keep: str) -> DataFrame:
    """keep columns and the evidence of docs(text)."""
    kept = docs.select(*keep)

    def run(batches):
        machine = grammar.machine()
        for batch in batches:
            found = [grammar.evidence(x, machine) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.float64())], [*keep, "evidence"])

    schema = kept.schema
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema.add("evidence", "double"))


def score(docs: DataFrame, grammar: Grammar, *keep: str) -> DataFrame:
    """keep columns, evidence and score of docs(text)."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    value = F.lit(grammar.scores[0])
    for at, s in zip(grammar.steps, grammar.scores[1:], strict=True):
        value = F.when(F.col("evidence") >= at, s).otherwise(value)
    rounded = F.floor(F.col("evidence") * 2) / 2
    rows = _evidence(docs, grammar, *keep).withColumn("evidence", F.least(rounded, F.lit(40.0)))
    return rows.select(*keep, "evidence", value.alias("score"))


def filter_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The rows of docs that score below limit, learned from those of docs that labels cover."""
    return score(packed(docs, "text"), learn(docs, labels), "_row").filter(F.col("score") < limit).select("_row.*")
