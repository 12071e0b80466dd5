"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads words (insults: whole words and stems, with weights; threats, targets, negations, reports) and emits the
symbols of SYMBOLS. Three small transducers over symbols follow what governs a word: negation(), report() and target(), each a table of
states; compose() makes one machine of them, read from the left, and target() alone is read from the right, for targets
that follow. What both know at an insult or a threat gives the pattern of PATTERNS that the clause matches (clause()), with the arc's
weight; a document scores by the weighted patterns of its clauses, not by words alone. The arcs of the insult transducer are learned (the fewest words and stems that cover the
toxic training texts and hardly occur in others, besides SEED_INSULTS), and so are the pattern weights (logistic regression
that starts from PRIOR). Stems are prefixes of the UTF-8 bytes of a word, so the arcs apply to any language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import arrow_schema, short_batches, stored

#: Labelled rows that the grammar is fitted on, at most; the rows with the smallest hashes of their doc_id.
MAX_TRAIN = 20_000
STEM_BYTES = (3, 4, 5, 6, 7, 8)
#: Levels of an arc: read once; read again and again: so many times at least, and once in so many words. A stem that also
#: comes up by chance in longer clean texts is told from one that somebody keeps using.
LEVELS = {1: (1, 0), 2: (2, 250), 3: (3, 400)}

#: Small closed classes in the four languages.
SEED_INSULTS = ["idiot", "moron", "scum", "imbecile", "bastard", "asshole", "bitch", "cunt", "retard", "dumbass", "vermin", "subhuman", "arschloch", "wichser", "connard", "salope", "gilipollas", "cabrón"]
THREATS = ["kill", "murder", "strangle", "stab", "lynch", "töten", "umbringen", "tuer", "égorger", "matar", "degollar"]
TARGETS = ["you", "your", "you're", "he", "she", "they", "him", "her", "them", "these", "those", "du", "dich", "ihr", "euch", "sie", "tu", "toi", "vous", "ils", "elles", "tú", "usted", "vosotros", "ellos", "ellas"]
NEGATIONS = ["not", "never", "no", "isn", "aren", "wasn", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "ningún"]
REPORTS = ["said", "says", "called", "calls", "wrote", "writes", "quoted", "quote", "sagte", "nannte", "schrieb", "dit", "écrit", "dijo", "llamó", "escribió"]

PATTERNS = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "clauses")
#: Weights before fitting, of log(1 + matches): two plain insults or one aimed at somebody are toxic, a report is not.
PRIOR = np.array([3.0, 5.0, 0.5, 0.5, 0.5, 3.0, 2.0])
PRIOR_BIAS = -2.5
#: Words between a negation, report or target and what it governs.
REACH = 4
SEPARATORS = tb.byte_set((0, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”«»]")


SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "quote", "end")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(len(SYMBOLS))


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer over SYMBOLS: arcs[state][symbol] is the next state; says[state] what it emits for the symbol read next."""

    arcs: list[list[int]]
    says: list[int]


def machine(start, step, says) -> Machine:
    """The states that step(state, symbol) reaches from start, numbered as they are found; state 0 is the start."""
    number, arcs, order = {start: 0}, [], [start]
    for state in order:
        row = []
        for symbol in range(len(SYMBOLS)):
            to = step(state, symbol)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        arcs.append(row)
    return Machine(arcs, [says(x) for x in order])


def governed_by(trigger: int) -> Machine:
    """1 for the REACH words after a trigger in its clause."""

    def step(left: int, symbol: int) -> int:
        if symbol == END:
            return 0
        return left if symbol == QUOTE else REACH if symbol == trigger else max(0, left - 1)

    return machine(0, step, lambda left: int(left > 0))


def negation() -> Machine:
    return governed_by(NEGATION)


def target() -> Machine:
    return governed_by(TARGET)


def report() -> Machine:
    """1 for the REACH words after a report and for all that is quoted after it, also over the ends of quoted clauses."""

    def step(state: tuple[int, bool, bool], symbol: int) -> tuple[int, bool, bool]:
        left, told, quoted = state
        if symbol == QUOTE:
            return left, told, not quoted
        if symbol == END:
            return state if quoted else (0, False, False)
        return (REACH, True, quoted) if symbol == REPORT else (max(0, left - 1), told, quoted)

    return machine((0, False, False), step, lambda state: int(state[0] > 0 or state[1] and state[2]))


def compose(*machines: Machine) -> Machine:
    """One machine that does the steps of all; it says bit k for the k-th."""
    return machine(
        (0,) * len(machines),
        lambda states, symbol: tuple(m.arcs[x][symbol] for m, x in zip(machines, states)),
        lambda states: sum(m.says[x] << k for k, (m, x) in enumerate(zip(machines, states))),
    )


def clause(symbol: int, before: int, after: int) -> int | None:
    """The pattern of an insult or a threat: before has bits for negated, reported and aimed, after tells of a target that follows."""
    if symbol == THREAT:
        return None if before & 3 else PATTERNS.index("threat_target" if after else "threat")
    return PATTERNS.index("insult_negated" if before & 1 else "insult_reported" if before & 2 else "insult_target" if before & 4 or after else "insult")


BEFORE, AFTER = compose(negation(), report(), target()), target()


@dataclass
class Grammar:
    words: dict[str, tuple[float, int]] = field(default_factory=dict)  # weight and level of whole words, folded
    stems: dict[bytes, tuple[float, int]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = PRIOR_BIAS

    def insult(self, word: str) -> tuple[str | bytes, float, int] | None:
        """The insult arc that reads word, its weight and level."""
        if word in self.words:
            return word, *self.words[word]
        raw = word.encode()
        read = [raw[:k] for k in self.stem_sizes if raw[:k] in self.stems]
        return (read[0], *self.stems[read[0]]) if read else None

    def __post_init__(self) -> None:
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.role = {w: r for r, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}
        self.role |= dict.fromkeys('"“”«»', QUOTE) | dict.fromkeys(".!?;\n", END)

    def symbols(self, text: str) -> tuple[list[int], dict[int, float]]:
        """What the lexical transducer emits for the tokens of text, and the weights of insults by place."""
        tokens = [x if len(x) == 1 and not x.isalpha() else fold(x) for x in TOKEN.findall(text)]
        times = Counter(tokens)
        n_words = sum(n for x, n in times.items() if self.role.get(x, OTHER) not in (QUOTE, END))
        known = {x: arc for x in times if self.role.get(x) not in (QUOTE, END) and (arc := self.insult(x))}
        read: Counter = Counter()
        for x, (arc, _, _) in known.items():
            read[arc] += times[x]
        live = {x: weight for x, (arc, weight, level) in known.items() if level_holds(read[arc], n_words, level)}
        emits = {x: INSULT if x in live else self.role.get(x, OTHER) for x in times}
        out = [emits[x] for x in tokens]
        return out, {i: live[x] for i, x in enumerate(tokens) if x in live} if live else {}

    def matches(self, text: str) -> np.ndarray:
        """log(1 + weight of matches) of each pattern over the clauses of text."""
        symbols, weights = self.symbols(text)
        hits = sorted([*weights, *(i for i, x in enumerate(symbols) if x == THREAT)])
        total = np.zeros(len(PATTERNS))
        if not hits:
            return total
        after, state, arcs, wanted = {}, 0, AFTER.arcs, set(hits)
        for i in range(len(symbols) - 1, hits[0] - 1, -1):
            if i in wanted:
                after[i] = AFTER.says[state]
            state = arcs[state][symbols[i]]
        state, arcs, matched = 0, BEFORE.arcs, False
        for i, symbol in enumerate(symbols):
            if i in wanted:
                pattern = clause(symbol, BEFORE.says[state], after[i])
                if pattern is not None:
                    total[pattern] += weights.get(i, 1.0)
                    matched = matched or pattern not in (2, 3)
            elif symbol == END and matched:
                total[-1] += 1
                matched = False
            state = arcs[state][symbol]
        total[-1] += matched
        return np.log1p(total)

    def score(self, matches: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(matches @ self.weights)))))

    def arc_hashes(self) -> dict[int, np.ndarray]:
        """Sorted hashes of what can begin a match, by bytes read (0: whole words)."""
        whole = [w.encode() for w in {*self.words, *THREATS}]
        by_size = {0: whole} | {k: [s for s in self.stems if len(s) == k] for k in self.stem_sizes}
        return {k: np.sort(hash_of(ws)) for k, ws in by_size.items()}


def level_holds(times: int, n_words: int, level: int) -> bool:
    least, words = LEVELS[level]
    return times >= least and (not words or times * words >= n_words)


def fold(word: str) -> str:
    """Lower case of ASCII letters only, as the byte tables do it."""
    return word.lower() if word.isascii() else "".join(c.lower() if c.isascii() else c for c in word)


def hash_of(words: list[bytes]) -> np.ndarray:
    """Hashes as prefix_hashes() gives them."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
    return _prefixes(data, start, sizes)


def _prefixes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    up, down = tb._power_tables(max(1, len(data)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb._byte_values[tb.ASCII_FOLD[data]] * up[: len(data)])])
    return tb.mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: whether TOKEN takes it as part of a word."""
    if not _letters:
        _letters.append(np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def only_letters(data: np.ndarray) -> np.ndarray:
    """The bytes with all that is not ASCII and no letter of TOKEN read as spaces, so that words end where TOKEN ends them."""
    out = data
    for size, least, most, mask in ((2, 0xC0, 0xDF, 0x1F), (3, 0xE0, 0xEF, 0x0F), (4, 0xF0, 0xF7, 0x07)):
        lead = np.flatnonzero((data >= least) & (data <= most))
        if not len(lead):
            continue
        code = data[lead].astype(np.int64) & mask
        for k in range(1, size):
            code = code << 6 | data[lead + k] & 0x3F
        lead = lead[~letters()[code]]
        if len(lead):
            out = data.copy() if out is data else out
            for k in range(size):
                out[lead + k] = 0x20
    return out


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tb.Words]:
    data = only_letters(data)
    return data, tb.words(data, offsets, SEPARATORS)


def text_arcs(text: str) -> np.ndarray:
    """Distinct hashes of the words and stems of one text; the lowest four bits hold an arc's bytes (0: whole), the next two its level."""
    data, words = word_table(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    if not len(words.start):
        return np.zeros(0, np.uint64)
    size = words.end - words.start
    found = [words.hash & ~np.uint64(63)]
    for k in STEM_BYTES:
        start = words.start[size > k]
        found.append(_prefixes(data, start, np.full(len(start), k)) & ~np.uint64(63) | np.uint64(k))
    arcs, times = np.unique(np.concatenate(found), return_counts=True)
    held = [arcs[(times >= least) & (times * n >= (len(size) if n else 0))] | np.uint64(level << 4) for level, (least, n) in LEVELS.items()]
    return np.sort(np.concatenate(held))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of at most `most` labelled documents that are not held out."""
    picked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(most)
    )
    # most bounds what is broadcast
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").select("text", "toxic")
    return stored(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism), "toxicity-train")


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Grammar:
    """Learns the arcs and weights. Without toxic training rows the seed arcs and prior weights stay."""
    rows = training_rows(docs, labels, most)
    short_batches(rows.sparkSession)
    seeds = Grammar({w: (1.0, 1) for w in SEED_INSULTS})

    def arcs(batches):
        for batch in batches:
            yield pa.record_batch({"arcs": pa.array([text_arcs(x).tobytes() for x in batch.column(0).to_pylist()], pa.binary())})

    bad = rows.where("toxic = 1").select("text").mapInArrow(arcs, "arcs binary")
    n_toxic = rows.where("toxic = 1").count()
    if not n_toxic:
        return seeds
    least = max(3, n_toxic // 200)

    def exploded(batches):
        for batch in batches:
            for x in batch.column(0):
                yield pa.record_batch({"arc": pa.array(np.frombuffer(x.as_py(), np.int64))})

    # arcs of n_toxic / 200 texts: no more than 200 times as many as a text has
    often = bad.mapInArrow(exploded, "arc long").groupBy("arc").agg(F.count("*").alias("n")).where(F.col("n") >= least).toPandas()
    seen, order = np.unique(often.arc.to_numpy(np.int64).view(np.uint64), return_index=True)
    times = often.n.to_numpy(np.int64)[order]

    def clean(batches):
        counts = np.zeros(len(seen), np.int32)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found = text_arcs(x)
                at = np.searchsorted(seen, found)
                at = at[(at < len(seen)) & (seen[np.minimum(at, len(seen) - 1)] == found)] if len(seen) else at[:0]
                counts[at] += 1
        yield pa.record_batch({"counts": pa.array([counts.tobytes()], pa.binary())})

    n_clean = max(1, rows.where("toxic = 0").count())
    clean_times = np.zeros(len(seen), np.int64)
    for r in rows.where("toxic = 0").select("text").mapInArrow(clean, "counts binary").toLocalIterator():
        clean_times += np.frombuffer(r.counts, np.int32)
    pure, least = telling(seen, times, clean_times, n_toxic, n_clean, least)
    kept = seen[pure]

    def held(batches):
        for batch in batches:
            yield pa.record_batch({"arcs": pa.array([np.intersect1d(np.frombuffer(x.as_py(), np.uint64), kept, assume_unique=True).tobytes() for x in batch.column(0)], pa.binary())})

    toxic = [np.searchsorted(kept, np.frombuffer(r.arcs, np.uint64)) for r in bad.mapInArrow(held, "arcs binary").toLocalIterator()]
    chosen = pure[cover(toxic, kept, clean_times[pure], least)].tolist()

    def names(batches):
        wanted: dict[int, list[int]] = {}
        for i in chosen:
            wanted.setdefault(int(seen[i]) & ~48, []).append(i)
        for batch in batches:
            out = {}
            for x in batch.column(0).to_pylist():
                data = only_letters(np.frombuffer(x.encode(), np.uint8))
                words = tb.words(data, np.array([0, len(data)]), SEPARATORS)
                folded = tb.ASCII_FOLD[data].tobytes()
                for size in (0, *STEM_BYTES):
                    s = words.start if not size else words.start[words.end - words.start > size]
                    n = words.end - words.start if not size else np.full(len(s), size)
                    h = (_prefixes(data, s, n) & ~np.uint64(63)) | np.uint64(size)
                    for i in np.flatnonzero(np.isin(h, seen[chosen] & ~np.uint64(48))):
                        for k in wanted[int(h[i])]:
                            out[k] = folded[s[i] : s[i] + n[i]]
            yield pa.record_batch({"i": pa.array(list(out), pa.int64()), "arc": pa.array(list(out.values()), pa.binary())})

    spelled = {r.i: bytes(r.arc) for r in rows.where("toxic = 1").select("text").mapInArrow(names, "i long, arc binary").distinct().toLocalIterator()}
    words, stems = dict(seeds.words), {}
    for i, arc in sorted(spelled.items(), key=lambda x: -(int(seen[x[0]]) >> 4 & 3)):  # the lowest level of an arc stays
        # weight of an arc: how often it means a toxic text, 0.5 to 1
        weight = (times[i] + 1) / (times[i] + 2 + clean_times[i])
        level = int(seen[i]) >> 4 & 3
        if int(seen[i]) & 15:
            stems[arc] = weight, level
        else:
            words[arc.decode()] = weight, level
    grammar = Grammar(words, stems)

    def patterns(batches):
        for batch in batches:
            found = [grammar.matches(x).tolist() for x in batch.column(0).to_pylist()]
            yield pa.record_batch({"toxic": batch.column(1), "found": pa.array(found, pa.list_(pa.float64()))})

    data = rows.mapInArrow(patterns, "toxic int, found array<double>").toPandas()
    return regress(grammar, np.array(data.found.tolist()), data.toxic.to_numpy(float))


def telling(seen: np.ndarray, times: np.ndarray, clean_times: np.ndarray, n_toxic: int, n_clean: int, least: int) -> tuple[np.ndarray, int]:
    """Places of the arcs that tell toxic texts from others, and how many texts such an arc needs at least."""
    share = n_toxic / (n_toxic + n_clean)
    # so many texts don't meet by chance, with as many arcs to choose from
    needed = math.log(100 * max(1, len(seen)))
    n, part = times + clean_times, times / np.maximum(1, times + clean_times)
    gain = n * (part * np.log(np.maximum(part, 1e-300) / share) + (1 - part) * np.log(np.maximum(1 - part, 1e-300) / max(1 - share, 1e-300)))
    pure = (part > share) & (gain > needed) & (times / n_toxic > 40 * clean_times / n_clean)
    return np.flatnonzero(pure), max(least, math.ceil(needed / math.log(1 / share))) if share < 1 else least


def cover(toxic: list[np.ndarray], kept: np.ndarray, clean_times: np.ndarray, least: int) -> list[int]:
    """Places in kept by greedy cover of the toxic texts (each given by its places): most new texts first, then fewest clean ones, then the longest arc."""
    text_of = np.concatenate([np.full(len(at), t) for t, at in enumerate(toxic)]).astype(int)
    arc_of = np.concatenate(toxic).astype(int)
    size = (kept & np.uint64(15)).astype(int)
    rank = np.lexsort((np.where(size == 0, 99, size), -clean_times))  # better last
    value = np.empty(len(kept))
    value[rank] = np.arange(len(kept)) / max(1, len(kept))
    chosen: list[int] = []
    while len(kept):
        new = np.bincount(arc_of, minlength=len(kept)) + 0.0
        best = int(np.argmax(new + value))
        if new[best] < least:
            break
        chosen.append(best)
        covered = np.zeros(len(toxic), bool)
        covered[text_of[arc_of == best]] = True
        left = ~covered[text_of]
        text_of, arc_of = text_of[left], arc_of[left]
    return chosen


def regress(grammar: Grammar, x: np.ndarray, y: np.ndarray) -> Grammar:
    """Newton steps of a logistic regression with a ridge towards the prior."""
    x = np.column_stack([x, np.ones(len(x))])
    prior = np.append(PRIOR, PRIOR_BIAS)
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    grammar.weights, grammar.bias = w[:-1], float(w[-1])
    return grammar


SCHEMA = "doc_id long, score double"


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text).

    Null and empty texts match nothing and score as any text without a match. A null doc_id stays null, repeated rows give
    repeated rows, an empty table an empty result; other columns are not read.
    """
    short_batches(docs.sparkSession)
    out = arrow_schema(docs.sparkSession, SCHEMA)

    def run(batches):
        scorer = Scorer(grammar)
        for batch in batches:
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(scorer(batch.column(1)), pa.float64())], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


class Scorer:
    """Finds the texts that hold an arc of the grammar and reads only those clause by clause."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar, self.arcs = grammar, grammar.arc_hashes()

    def __call__(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.grammar.score(np.zeros(len(PATTERNS))))
        for first, data, offsets in tb.blocks(column):
            data, words = word_table(data, offsets)
            if not len(words.start):
                continue
            size, hit = words.end - words.start, np.zeros(len(words.start), bool)
            for k, arcs in self.arcs.items():
                if not len(arcs):
                    continue
                long = slice(None) if not k else np.flatnonzero(size >= k)
                start = words.start[long]
                found = words.hash if not k else _prefixes(data, start, np.full(len(start), k))
                at = np.minimum(np.searchsorted(arcs, found), len(arcs) - 1)
                hit[long] |= arcs[at] == found
            rows = np.unique(np.searchsorted(words.first, np.flatnonzero(hit), "right") - 1)
            for row in rows.tolist():
                out[first + row] = self.grammar.score(self.grammar.matches(column[first + row].as_py()))
        return out


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; fitted on the labelled rows that are not held out.

    A null doc_id is scored and counts as not held out.
    """
    scored = score(docs, fit(docs, labels, most))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns. Null texts stay."""
    short_batches(docs.sparkSession)

    def run(batches):
        scorer = Scorer(grammar)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column("text")) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
