"""Toxicity by a weighted finite-state pattern grammar.

Two layers of transducers are composed. The lower one, spelling, reads the letters of a word: a trie whose
entries are insults (whole words and word beginnings) learnt from labelled rows, and short fixed tables of
threats, targets, negations and reporting verbs. It maps a word to a class and a weight. The upper one reads
the classes of a clause, from stop to stop, and is the product of three small machines: one counts the words
since a negation, one knows if speech is reported, one if somebody is addressed. At each insult or threat it
emits the states of the three; the clause's end resolves them to a weighted match:

    direct    an insult without further context
    targeted  an insult in a clause with an addressee ("you are a ...")
    threat    a threatening verb in a clause with an addressee
    negated   either of them a few words (NEGATION + 1 at most) behind a negation
    reported  either of them behind a reporting verb or an opening quotation mark

A document's features are, for each kind, the largest and the summed weight of its matches; a logistic model
over them gives the score. Words outside matched clauses do not count. A word's weight is its log odds
between toxic and clean labelled rows; a threat that they do not have weighs 1.

The lexicon and the model are fitted on at most FIT_ROWS labelled rows of each class, those of least hash of
doc_id and text. The model's weights come from features of rows that their lexicon has not seen: in each of
FOLDS parts of the sample, those by the lexicon of the other parts. All documents are scored, whole.

Null and empty texts match nothing and get the model's lowest score, as does every text if the labelled rows
give no entry. Repeated rows are scored alike. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, crc_mod, give_back, small_batches, table, thinned
from .shingles import shingle_sets, signed

FIT_ROWS = 4000
FOLDS = 4
LEAST, MOST = 3, 12  # letters of a learnt word beginning; longer words are learnt by their beginnings and as wholes
SUPPORT, SUPPORT_SHARE = 4, 50  # toxic training rows that an entry is seen in, at least; 1 in so many of them if that is more
LEAST_ODDS = 2.0
THREAT_WEIGHT, LEAST_THREAT = 1.0, 0.1  # of a threat that the sample does not have, and the least of one that it has
KEEP_TOKENS = 150_000  # in a task
CUT = 0.3

#: Words of the grammar in English, German, French and Spanish.
THREATS = "kill hurt destroy beat punish töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your you're youre u du dich dir euch ihr tu toi vous votre tú te usted ustedes vosotros he she they them these those".split()
NEGATIONS = "not no never isn't aren't don't without nicht kein keine nie ohne ne pas jamais sans nunca jamás sin".split()
REPORTS = "said says wrote claimed called reported quoted quote according sagte schrieb nannte laut dit écrit déclaré selon dijo escribió llamó según".split()

KINDS = ("direct", "targeted", "threat", "negated", "reported")
NEGATION = 3
NONE, INSULT, THREAT, TARGET, NEGATE, REPORT, QUOTE, STOP = range(8)
SYMBOLS = range(8)
PARTS = re.compile(r"(?P<word>[^\W\d_]+(?:['’][^\W\d_]+)*)|(?P<stop>[.,;:!?])|(?P<quote>[\"“„«])")
APOSTROPHES = re.compile("['’]")

Entry = tuple[str, bool, float]


class WordMachine:
    """A trie with final weights: '' ends a whole word, '*' accepts whatever follows."""

    def __init__(self, entries: list[Entry]):
        self.root: dict = {}
        for word, open_, weight in entries:
            at = self.root
            for c in word:
                at = at.setdefault(c, {})
            at["*" if open_ else ""] = weight

    def weight(self, word: str) -> float:
        """Of the longest entry that accepts the word, else 0."""
        at, best = self.root, 0.0
        for c in word:
            best = at.get("*", best)
            at = at.get(c)
            if at is None:
                return best
        return at.get("", at.get("*", best))


State = tuple[int, ...]
Step = Callable[[int, int], tuple[int, int]]


def negation(state: int, symbol: int) -> tuple[int, int]:
    """State: words since a negation, up to NEGATION + 1. Output: whether the word is negated."""
    if symbol == NEGATE:
        return 0, 0
    return (state if symbol == QUOTE else min(state + 1, NEGATION + 1)), int(state <= NEGATION)


def report(state: int, symbol: int) -> tuple[int, int]:
    """State and output: whether speech is reported."""
    new = int(state or symbol in (REPORT, QUOTE))
    return new, new


def address(state: int, symbol: int) -> tuple[int, int]:
    """State and output: whether somebody has been addressed."""
    new = int(state or symbol == TARGET)
    return new, new


def compose(machines: list[Step], start: State) -> dict[State, list[tuple[State, State]]]:
    """The product of machines that read the same symbols: for each state that start leads to, a next state and the outputs for each symbol."""
    arcs: dict[State, list[tuple[State, State]]] = {}
    reach = [start]
    while reach:
        state = reach.pop()
        if state not in arcs:
            each = [[step(s, symbol) for step, s in zip(machines, state, strict=True)] for symbol in SYMBOLS]
            arcs[state] = [(tuple(n for n, _ in x), tuple(o for _, o in x)) for x in each]
            reach += [n for n, _ in arcs[state]]
    return arcs


START: State = (NEGATION + 1, 0, 0)
CLAUSES = compose([negation, report, address], START)


def kind_of(symbol: int, negated: int, reported: int, addressed: int) -> str | None:
    """What a match is, from the outputs at its word and the address machine's state at its clause's end."""
    if symbol == THREAT and not addressed:
        return None
    if negated:
        return "negated"
    if reported:
        return "reported"
    return "threat" if symbol == THREAT else "targeted" if addressed else "direct"


#: Index of the kind (or -1) by symbol, negated, reported, addressed.
RESOLVED = {(s, n, r, a): KINDS.index(k) if (k := kind_of(s, n, r, a)) else -1 for s in (INSULT, THREAT) for n in (0, 1) for r in (0, 1) for a in (0, 1)}

Reading = tuple[tuple[int, float], ...]


class Grammar:
    """Spelling composed with the clause machine. threats: (word, weight)."""

    def __init__(self, insults: list[Entry], threats: dict[str, float] | None = None):
        self.spelling = WordMachine(insults)
        weights = dict.fromkeys(THREATS, THREAT_WEIGHT) | (threats or {})
        self.fixed = {w: (k, 1.0) for k, words in ((TARGET, TARGETS), (NEGATE, NEGATIONS), (REPORT, REPORTS)) for w in words} | {w: (THREAT, x) for w, x in weights.items()}
        self.met: dict[str, Reading] = {}
        self.same: dict[Reading, Reading] = {}  # one object for equal readings

    def word(self, word: str) -> tuple[int, float]:
        weight = self.spelling.weight(word)
        return (INSULT, weight) if weight > 0 else self.fixed.get(word, (NONE, 1.0))

    def read(self, token: str) -> Reading:
        """Classes and weights of all words, stops and quotation marks of a token, in order.

        A word with an apostrophe is one if the grammar has it, else its parts are words of their own.
        """
        found = self.met.get(token)
        if found is None:
            out = []
            for m in PARTS.finditer(token.lower()):
                if m["stop"]:
                    out.append((STOP, 0.0))
                elif m["quote"]:
                    out.append((QUOTE, 0.0))
                elif (whole := self.word(m["word"]))[0] != NONE:
                    out.append(whole)
                else:
                    out += [self.word(x) for x in APOSTROPHES.split(m["word"])]
            found = tuple(out)
            found = self.same.setdefault(found, found)
            if len(self.met) > KEEP_TOKENS:
                self.met.clear()
            self.met[token] = found
        return found

    def matches(self, symbols: Iterator[tuple[int, float]]) -> Iterator[tuple[int, float]]:
        """Kinds and weights of the matches of whole clauses."""
        state, held = START, []

        def resolved() -> Iterator[tuple[int, float]]:
            for symbol, negated, reported, weight in held:
                kind = RESOLVED[symbol, negated, reported, state[2]]
                if kind >= 0:
                    yield kind, weight

        for symbol, weight in symbols:
            if symbol == STOP:
                yield from resolved()
                state, held = START, []
                continue
            state, (negated, reported, _) = CLAUSES[state][symbol]
            if symbol in (INSULT, THREAT):
                held.append((symbol, negated, reported, weight))
        yield from resolved()

    def features(self, texts) -> np.ndarray:
        """Largest and summed weights by kind, a row for each text of an Arrow array.

        Distinct tokens are classified once a batch; only clauses with an insult or threat are run.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.zeros((len(texts), 2 * len(KINDS)))
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        if not len(coded.dictionary):
            return out
        offsets = offsets - offsets[0]
        tokens = [self.read(t) for t in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        calls = np.array([any(k in (INSULT, THREAT) for k, _ in t) for t in tokens])[codes]
        ends = np.array([bool(t) and t[-1][0] == STOP for t in tokens])[codes]
        ends[np.maximum(offsets[1:] - 1, 0)] = True  # a clause ends with its text
        stops = np.flatnonzero(ends)
        for c in np.unique(np.searchsorted(stops, np.flatnonzero(calls))).tolist():
            a, b = (stops[c - 1] + 1 if c else 0), stops[c] + 1
            row = int(np.searchsorted(offsets, a, side="right")) - 1
            for kind, weight in self.matches(x for k in codes[a:b] for x in tokens[k]):
                out[row, kind] = max(out[row, kind], weight)
                out[row, len(KINDS) + kind] += weight
        return out


def odds(t: int, c: int, toxic: int, clean: int) -> float:
    return float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))


def lexicon(found: list[tuple[str, bool, int, int]], toxic: int, clean: int, support: int) -> list[Entry]:
    """Entries from (word or beginning, if it is a beginning, toxic and clean rows with it).

    A beginning stands for all words with it. It gives way to its longer forms and the word itself if
    its other words would not make an entry, and either it has but one form or clean rows have it too.
    """
    begins = {w: (t, c) for w, open_, t, c in found if open_}
    whole = {w: (t, c) for w, open_, t, c in found if not open_}
    longer: dict[str, list[str]] = {}
    for w in sorted(begins):
        longer.setdefault(w[:-1], []).append(w)

    def entries(w: str) -> Iterator[Entry]:
        (t, c), forms = begins[w], longer.get(w, [])
        parts = [begins[f] for f in forms] + ([whole[w]] if w in whole else [])
        t_rest, c_rest = (max(0, x - sum(p[k] for p in parts)) for k, x in enumerate((t, c)))
        rest = t_rest >= support and odds(t_rest, c_rest, toxic, clean) >= LEAST_ODDS
        if not rest and (c > 0 and parts or len(parts) == 1):
            for f in forms:
                yield from entries(f)
            if w in whole:
                yield w, False, odds(*whole[w], toxic, clean)
        else:
            yield w, True, odds(t, c, toxic, clean)

    out = [e for w in begins if w[:-1] not in begins for e in entries(w)]
    out += [(w, False, odds(t, c, toxic, clean)) for w, (t, c) in whole.items() if not any(w[:n] in begins for n in range(LEAST, len(w) + 1))]
    return sorted(out, key=lambda x: (-x[2], x[0]))


class Model:
    def __init__(self, insults: list[Entry], threats: dict[str, float], weights: np.ndarray, bias: float):
        self.insults, self.threats, self.weights, self.bias = insults, threats, weights, bias

    def grammar(self) -> Grammar:
        return Grammar(self.insults, self.threats)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(squash(x) @ self.weights + self.bias, -30, 30)))


def squash(x: np.ndarray) -> np.ndarray:
    return np.log1p(x)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> tuple[np.ndarray, float]:
    """Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0]
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def training(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic of rows labelled documents of each class at most, none held out.

    The labels are sampled first (by a hash of doc_id), so that what is broadcast is bounded.
    """
    small_batches(docs.sparkSession)
    own = labels.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    some, _ = thinned(own, "toxic", 2 * rows, F.col("doc_id"))
    return bounded(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null"), "toxic", rows)


def one_of_copies(docs: DataFrame) -> DataFrame:
    """One row of those that share the least and the greatest hash of five words."""

    def ends(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h, at = shingle_sets(batch.column("text"), 5)
            some = at[1:] > at[:-1]
            low, high = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
            low[some], high[some] = h[at[:-1][some]], h[at[1:][some] - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(low)), pa.array(signed(high))], names=[*batch.schema.names, "low", "high"])

    marked = docs.select("doc_id", "text", "toxic").mapInArrow(ends, "doc_id long, text string, toxic int, low long, high long")
    return marked.groupBy("toxic", "low", "high").agg(F.min_by("text", "doc_id").alias("text"))


def counted(some: DataFrame) -> DataFrame:
    """w, open, t, c: in how many toxic and clean rows of each part words and beginnings are (an array each, by part)."""
    core = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    words = some.select("toxic", "part", F.explode(core).alias("w")).groupBy("w")
    words = words.agg(*[F.count(F.when((F.col("toxic") == y) & (F.col("part") == k), 1)).alias(f"{'ct'[y]}{k}") for y in (0, 1) for k in range(FOLDS)])
    numbers = [c for c in words.columns if c != "w"]
    stems = words.select(F.explode(F.transform(F.sequence(F.lit(LEAST), F.least(F.length("w"), F.lit(MOST))), lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("w"), *numbers)
    begins = stems.groupBy("w").agg(*[F.sum(c).alias(c) for c in numbers]).withColumn("open", F.lit(True))
    both = begins.unionByName(words.withColumn("open", F.lit(False)))
    return both.select("w", "open", *[F.array(*[f"{y}{k}" for k in range(FOLDS)]).alias(y) for y in "tc"])


def fit(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, toxic, a bounded number of rows.

    Of near copies, one row counts: else each rare word of a copied toxic text would look like an insult.
    """
    small_batches(labelled.sparkSession)
    scratch = Scratch(labelled.sparkSession, "toxicity")
    some = scratch.keep(one_of_copies(labelled).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "sample")
    n = np.zeros((2, FOLDS), int)
    for r in some.groupBy("toxic", "part").count().collect():
        n[r["toxic"], r["part"]] = r["count"]
    number = lambda y: F.aggregate(y, F.lit(0).cast("bigint"), lambda s, x: s + x)
    enough = max(SUPPORT, int(n[1].sum() * (FOLDS - 1) / FOLDS) // SUPPORT_SHARE // 2)  # no lexicon has entries of less support
    found = counted(some).where((number("t") >= enough) | (~F.col("open") & F.col("w").isin(THREATS))).orderBy("w", "open").toArrow()
    words, open_ = np.array(found["w"].to_pylist(), object), found["open"].to_numpy().astype(bool)
    counts = np.array([found["t"].to_pylist(), found["c"].to_pylist()], int).reshape(2, len(words), FOLDS)
    threat = np.array([w in THREATS for w in words], bool) & ~open_

    def learnt(use: np.ndarray) -> tuple[list[Entry], dict[str, float]]:
        """The insults and threats of the parts in use."""
        toxic, clean = int(n[1, use].sum()), int(n[0, use].sum())
        if not toxic or not clean:
            return [], {}
        support = max(SUPPORT, toxic // SUPPORT_SHARE)
        t, c = counts[:, :, use].sum(2)
        lead = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        own = np.flatnonzero((t >= support) & (t * clean > 4 * c * toxic) & (lead >= LEAST_ODDS) & ~threat)
        sure = {words[k]: max(LEAST_THREAT, float(lead[k])) for k in np.flatnonzero(threat & (t + c >= SUPPORT))}
        return lexicon([(words[k], bool(open_[k]), int(t[k]), int(c[k])) for k in own], toxic, clean, support), sure

    parts = np.arange(FOLDS)
    insults, sure = learnt(parts)
    if not insults and not sure:
        return Model([], {}, np.zeros(2 * len(KINDS)), -10.0)
    others = [learnt(np.flatnonzero(parts != k)) for k in range(FOLDS)]

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        grammars = [Grammar(*x) for x in others]
        for batch in batches:
            for k, grammar in enumerate(grammars):
                own = batch.filter(pa.array(batch.column("part").to_numpy() == k))
                if own.num_rows:
                    yield pa.RecordBatch.from_arrays([own.column("toxic"), pa.array(list(grammar.features(own.column("text"))), pa.list_(pa.float64()))], names=["toxic", "x"])

    got = some.select("toxic", "part", "text").mapInArrow(features, "toxic int, x array<double>").toArrow()
    x, y = squash(np.array(got["x"].to_pylist())), got["toxic"].to_numpy().astype(float)
    scratch.drop_but()
    return Model(insults, sure, *logistic(x, y))


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs' columns and name, the score (0 to 1)."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    small_batches(docs.sparkSession)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        grammar = model.grammar()
        for batch in batches:
            p = model.score(grammar.features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])
        del grammar
        give_back()

    return docs.mapInArrow(judge, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def clean(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """docs that score below cut."""
    name = "toxicity of " + "".join(docs.columns)  # no column of docs
    return score(docs, model, name).where(F.col(f"`{name}`") < cut).select(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training(docs, table(spark, sf_dir, "labels")))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))
