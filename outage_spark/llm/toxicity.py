"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read a clause as a string of word classes. The reported-speech, negation and target
transducers relabel the insults and threats that pass through them; composed, they are one machine that
emits what was matched: ``insult``, ``insult+target``, ``insult-negated``, ``threat-reported`` and so on.
A document's evidence is the number of clauses per kind of match, so a word counts in its clause only.

Two things are learned, both from labelled rows of the training fold: the insult lexicon (words and
families of words with a common beginning that are significantly bound to toxic rows) and the weight of
each kind of match (logistic regression). Kinds that the labels never show keep their prior weight.

Word counts are reduced in Spark; the lexicon is cut to its ``max_lexicon`` most significant entries (a
bound of the model), so what reaches the driver and the tasks does not grow with the data. Texts are
read whole, in one pass each, and never shuffled.

Defined results: null and empty texts have no evidence and get the score of the intercept; rows with a
null label or ``doc_id`` are not learned from; repeated label rows count as toxic if any of them says
so; repeated documents get equal scores; without labels the lexicon and weights are the priors; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.text import bound_batches, nullable, store, table
from outage_spark.operators.spread import lookup_join

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "I", "H", "T", "N", "R", "O"

# Closed word classes of the grammar.
CLASSES = {
    TARGET: "you your yours yourself youre u they them their he she him her du dich dir dein deine euch ihr sie tu te toi ton ta vous votre vos usted ustedes ti vosotros".split(),
    NEGATION: "not no never none without isnt arent wasnt dont doesnt didnt nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna tampoco sin".split(),
    REPORT: "said says say saying called calls quoted quote quotes claimed reported wrote alleged sagte sagt nannte zitiert schrieb behauptete dit disait appelé cite écrit dijo dice llamó cita escribió".split(),
    THREAT: "kill murder hurt destroy punch stab shoot strangle beat töten umbringen erschlagen verprügeln tuer frapper détruire matar golpear destruir".split(),
}
KINDS = tuple(f"{what}{how}" for what in ("insult", "threat") for how in ("", "+target", "-negated", "-reported"))
# A clause counts as insult or threat, and what the grammar found about it adds or takes away.
PRIOR = {"insult": 4.0, "insult+target": 1.0, "insult-negated": -3.0, "insult-reported": -3.0,
         "threat": 0.5, "threat+target": 2.5, "threat-negated": -0.5, "threat-reported": -0.5}
PRIOR_INTERCEPT = -1.5
NEGATION_REACH = 3
PRODUCTIVE = 5
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
# Rows of a batch whose words are held at once.
PIECE = 256
# Everything in ASCII but letters becomes a blank: runs of what is left hold whole words of WORD, mostly one each.
_RUNS = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step[state][symbol] = (state, output)``; a symbol without an entry passes unchanged."""

    step: dict
    start: int = 0

    def then(self, other: Transducer, alphabet: Iterable[str]) -> Transducer:
        """Composition: the output of this machine is the input of the other."""
        states, todo, step = {(self.start, other.start): 0}, [(self.start, other.start)], {}
        alphabet = list(alphabet)
        while todo:
            a, b = pair = todo.pop()
            row = step[states[pair]] = {}
            for symbol in alphabet:
                a2, middle = self.step.get(a, {}).get(symbol, (a, symbol))
                b2, out = other.step.get(b, {}).get(middle, (b, middle))
                if (a2, b2) not in states:
                    states[a2, b2] = len(states)
                    todo.append((a2, b2))
                row[symbol] = (states[a2, b2], out)
        return Transducer(step)


def _reported() -> Transducer:
    """After a verb of speech, what is said is someone else's."""
    marks = {INSULT: (1, f"{INSULT}r"), THREAT: (1, f"{THREAT}r")}
    return Transducer({0: {REPORT: (1, REPORT)}, 1: marks})


def _negated(reach: int = NEGATION_REACH) -> Transducer:
    """A negation reaches over the next ``reach`` words."""
    step: dict = {0: {NEGATION: (reach, NEGATION)}}
    for left in range(1, reach + 1):
        step[left] = {s: (left - 1, s) for s in (OTHER, TARGET, REPORT, f"{INSULT}r", f"{THREAT}r")}
        step[left] |= {NEGATION: (reach, NEGATION), INSULT: (left - 1, f"{INSULT}n"), THREAT: (left - 1, f"{THREAT}n")}
    return Transducer(step)


def _aimed() -> Transducer:
    """Insults and threats that stand after someone is addressed are aimed at them."""
    marks = {INSULT: (1, f"{INSULT}t"), THREAT: (1, f"{THREAT}t")}
    return Transducer({0: {TARGET: (1, TARGET)}, 1: marks})


def grammar() -> Transducer:
    symbols = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)
    return _reported().then(_negated(), symbols).then(_aimed(), symbols)


EMITS = {
    f"{symbol}{mark}": {what, f"{what}{how}"}
    for symbol, what in ((INSULT, "insult"), (THREAT, "threat"))
    for mark, how in (("", ""), ("t", "+target"), ("n", "-negated"), ("r", "-reported"))
}


@dataclass(frozen=True)
class Lexicon:
    """Gains of whole words, and of beginnings that stand for a family of words."""

    words: dict = field(default_factory=dict)
    beginnings: dict = field(default_factory=dict)

    @cached_property
    def lengths(self) -> tuple[int, ...]:
        return tuple({len(b) for b in self.beginnings})

    def entries(self, word: str) -> Iterator[tuple[float, str]]:
        if word in self.words:
            yield self.words[word], word
        for n in self.lengths:
            if len(word) >= n and word[:n] in self.beginnings:
                yield self.beginnings[word[:n]], f"{word[:n]}*"

    def holds(self, word: str) -> bool:
        return next(self.entries(word), None) is not None


def _significant(toxic: Column, clean: Column, rate: float) -> Column:
    """Log-likelihood ratio of the rows with a word against the overall rate of toxic rows."""
    n = toxic + clean
    share = toxic / n
    gain = toxic * F.log(F.greatest(share, F.lit(1e-9)) / rate) + clean * F.log(F.greatest(1 - share, F.lit(1e-9)) / (1 - rate))
    return F.when(share > rate, gain).otherwise(0.0)


def _rows_of(lists: pa.Array, at: np.ndarray) -> np.ndarray:
    """The rows of a list column to which its flat places ``at`` belong."""
    return np.searchsorted(np.cumsum(lists.value_lengths().fill_null(0).to_numpy()), at, "right")


def _held(words: pa.Array, lexicon: Lexicon) -> list[set[tuple[float, str]]]:
    """Entries of each row of a list column; the lexicon is asked once per different word."""
    coded = words.flatten().dictionary_encode()
    entries = [tuple(lexicon.entries(w)) for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy()
    at = np.flatnonzero(np.array([bool(e) for e in entries], bool)[codes])
    held: list[set] = [set() for _ in range(len(words))]
    for row, code in zip(_rows_of(words, at).tolist(), codes[at].tolist(), strict=True):
        held[row].update(entries[code])
    return held


def _strongest(sets: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``sets`` (y, words) with ``entry``, the lexicon entry of highest gain in the row, or null, and all ``entries``."""
    schema = sets.select("y", "words", F.lit("").alias("entry"), F.array(F.lit("")).alias("entries")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [row for k in range(0, batch.num_rows, PIECE) for row in _held(batch.column(1).slice(k, PIECE), lexicon)]
            best = pa.array([max(es, default=(0, None))[1] for es in held], pa.string())
            entries = pa.array([[e for _, e in es] for es in held], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, best, entries], ["y", "words", "entry", "entries"])

    bound_batches(sets.sparkSession)
    return sets.select("y", "words").mapInArrow(read, nullable(schema))


def _bound_entries(
    sets: DataFrame, max_lexicon: int, min_precision: float, shortest: int, min_family: int
) -> tuple[dict, dict, set]:
    """Words and beginnings whose rows are toxic far more often than chance over the vocabulary allows."""
    counts = store(
        sets.select("y", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    )
    rows, bad = sets.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not bad or bad == rows:
        return {}, {}, set()
    rate, vocabulary = bad / rows, counts.count()

    def best(entries: DataFrame) -> list:
        precise = F.col("toxic") >= min_precision * (F.col("toxic") + F.col("clean"))
        scored = entries.withColumn("gain", _significant(F.col("toxic"), F.col("clean"), rate))
        strong = scored.where(precise & (F.col("gain") >= log(vocabulary) + 1))
        return strong.orderBy(F.desc("gain"), F.desc(F.length("word")), "word").limit(max_lexicon).collect()

    whole = {r.word: r.gain for r in best(counts)}
    # A family's rows are summed over its words, so a row with two of them counts twice; only ratios matter.
    sizes = F.sequence(F.lit(shortest), F.greatest(F.length("word"), F.lit(shortest)))
    starts = counts.where(F.length("word") >= shortest).select(
        "toxic", "clean", F.explode(F.transform(sizes, lambda n: F.substring("word", F.lit(1), n))).alias("word")
    )
    families = starts.groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("family")
    )
    beginnings: dict[str, float] = {}
    productive: set[str] = set()
    for row in best(families.where(F.col("family") >= min_family)):
        if not any(row.word.startswith(b) or b.startswith(row.word) for b in beginnings):
            beginnings[row.word] = row.gain
            if row.family >= PRODUCTIVE:
                productive.add(row.word)
    return whole, beginnings, productive


def learn_lexicon(
    labelled: DataFrame,
    text: str = "text",
    label: str = "toxic",
    max_lexicon: int = 20_000,
    min_precision: float = 0.95,
    shortest: int = 4,
    min_family: int = 3,
    rounds: int = 2,
) -> Lexicon:
    """The insult lexicon.

    Each round looks at the rows that are clean or not explained yet, so rarer insults are weighed
    against what is left to explain. Then an entry stays only if it is the strongest one of at least two
    toxic rows, stands beside three different strongest ones, or is a family of many words: words that merely came along, as in
    copies of one toxic text, are dropped.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"))
    sets = store(labelled.select(F.col(label).alias("y"), F.array_remove(words, "").alias("words")))
    lexicon, left, productive = Lexicon(), sets, set()
    for _ in range(rounds):
        whole, beginnings, large = _bound_entries(left, max_lexicon, min_precision, shortest, min_family)
        lexicon = Lexicon(whole | lexicon.words, beginnings | lexicon.beginnings)
        productive |= large
        explained = _strongest(sets, lexicon)
        left = explained.where((F.col("y") == 0) | F.col("entry").isNull()).select("y", "words")
    toxic_rows = explained.where((F.col("y") == 1) & F.col("entry").isNotNull())
    support = (
        toxic_rows.select(F.col("entry").alias("best"), F.explode("entries").alias("entry"))
        .groupBy("entry")
        .agg(F.sum((F.col("best") == F.col("entry")).cast("int")).alias("own"), F.count_distinct("best").alias("company"))
    )
    # At most as many entries as the lexicon has.
    kept = {r.entry for r in support.where((F.col("own") >= 2) | (F.col("company") >= 3)).collect()}
    return Lexicon(
        {w: g for w, g in lexicon.words.items() if w in kept},
        {b: g for b, g in lexicon.beginnings.items() if f"{b}*" in kept or b in productive},
    )


class Matcher:
    """Counts the clauses of a text by what the grammar matches in them."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.machine = grammar().step
        self.classes = {w: symbol for symbol, words in CLASSES.items() for w in words}
        self.threats = frozenset(CLASSES[THREAT])
        self.whole = pa.array(sorted(self.threats | set(lexicon.words)), pa.string())
        self.starts = [(n, pa.array([b for b in lexicon.beginnings if len(b) == n], pa.string())) for n in lexicon.lengths]

    def matters(self, word: str) -> bool:
        return word in self.threats or self.lexicon.holds(word)

    def marked(self, lowers: list[str]) -> tuple[np.ndarray, set[str]]:
        """(places of the texts with a word that matters, those words); a different word is judged once for all texts."""
        clean = pa.array([t.encode().translate(_RUNS) for t in lowers], pa.binary())
        runs = pc.ascii_split_whitespace(clean.cast(pa.string()))
        coded = runs.flatten().dictionary_encode()
        hot = pc.is_in(coded.dictionary, value_set=self.whole)
        for n, starts in self.starts:
            hot = pc.or_(hot, pc.is_in(pc.utf8_slice_codeunits(coded.dictionary, 0, n), value_set=starts))
        words, hot = set(coded.dictionary.filter(hot).to_pylist()), hot.to_numpy(zero_copy_only=False).copy()
        # A run beyond ASCII may hold several words, or signs and digits that part them.
        odd = np.flatnonzero(~pc.string_is_ascii(coded.dictionary).to_numpy(zero_copy_only=False))
        for place, run in zip(odd.tolist(), coded.dictionary.take(pa.array(odd)).to_pylist(), strict=True):
            if not run.isalpha():
                found = [w for w in WORD.findall(run) if self.matters(w)]
                hot[place] = bool(found)
                words.update(found)
        return np.unique(_rows_of(runs, np.flatnonzero(hot[coded.indices.to_numpy()]))), words

    def clauses(self, text: str | None, marked: set[str] | None = None) -> list[tuple[str, set[str]]]:
        """(clause, kinds of match in it) for the clauses with a match; ``marked`` holds the words that matter, if known."""
        lower = (text or "").lower()
        if marked is None:
            marked = {w for w in set(WORD.findall(lower)) if self.matters(w)}
        found = []
        for clause in CLAUSE.split(lower) if marked else ():
            words = WORD.findall(clause)
            # Only insults and threats are emitted, and every clause starts anew.
            if marked.isdisjoint(words):
                continue
            state, kinds = 0, set()
            for word in words:
                symbol = INSULT if word in marked and self.lexicon.holds(word) else self.classes.get(word, OTHER)
                state, out = self.machine[state][symbol]
                if out in EMITS:
                    kinds |= EMITS[out]
            if kinds:
                found.append((clause, kinds))
        return found

    def evidence(self, text: str | None, marked: set[str] | None = None) -> list[float]:
        counts = Counter(kind for _, kinds in self.clauses(text, marked) for kind in kinds)
        return [float(log(1 + counts[kind])) for kind in KINDS]

    def evidences(self, texts: list[str | None]) -> list[list[float]]:
        """Evidence of every text; only texts with a word that matters are read clause by clause."""
        out = [[0.0] * len(KINDS)] * len(texts)
        for start in range(0, len(texts), PIECE):
            places, marked = self.marked([(t or "").lower() for t in texts[start : start + PIECE]])
            for place in (start + places).tolist():
                out[place] = self.evidence(texts[place], marked)
        return out


def with_evidence(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "evidence") -> DataFrame:
    """``docs`` without its text column, with the log-scaled clause counts in the order of KINDS.

    Only the text goes to Python and only the counts come back; other columns, long ones too, stay with Spark.
    """

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pa.array(matcher.evidences(batch.to_pylist()), pa.list_(pa.float64()))

    bound_batches(docs.sparkSession)
    # As if it were random: a filter on the score would otherwise be moved below and have texts read twice.
    counts = F.arrow_udf(read, "array<double>").asNondeterministic()
    return docs.select(*[c for c in docs.columns if c != text], counts(text).alias(name))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple
    intercept: float

    def score(self, evidence: str = "evidence") -> Column:
        total = F.lit(self.intercept)
        for i, weight in enumerate(self.weights):
            total = total + F.get(evidence, F.lit(i)) * weight
        return F.round(1 / (1 + F.exp(-total)), 9)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``y`` and the text of labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    return lookup_join(docs.select("doc_id", text), known, ["doc_id"], "inner")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", min_rows: int = 20, **options) -> Model:
    """Lexicon, then weights, from the training fold."""
    rows = training_rows(docs, labels, text)
    lexicon = learn_lexicon(rows, text, "y", **options)
    seen = store(with_evidence(rows.select("y", text), lexicon, text))
    shown = [F.sum((F.get("evidence", F.lit(i)) > 0).cast("int")).alias(f"k{i}") for i in range(len(KINDS))]
    n, bad, *support = seen.agg(F.count(F.lit(1)), F.sum("y"), *shown).first()
    used = [i for i, s in enumerate(support) if (s or 0) >= min_rows]
    weights = [PRIOR[kind] for kind in KINDS]
    if not used or not bad or bad == n:
        return Model(lexicon, tuple(weights), PRIOR_INTERCEPT)
    vector = array_to_vector(F.array(*[F.get("evidence", F.lit(i)) for i in used]))
    learned = LogisticRegression(labelCol="y", featuresCol="x", regParam=0.0001, standardization=False).fit(
        seen.select(F.col("y").cast("double"), vector.alias("x"))
    )
    for i, weight in zip(used, learned.coefficients):
        weights[i] = float(weight)
    return Model(lexicon, tuple(weights), float(learned.intercept))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` (0 to 1) and ``n_matched``, the number of kinds of match."""
    found = with_evidence(docs.select(*keep, text), model.lexicon, text, "_evidence")
    kinds = F.size(F.filter("_evidence", lambda x: x > 0)).cast("bigint")
    return found.select(*keep, model.score("_evidence").alias("score"), kinds.alias("n_matched"))


def toxic_clauses(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The matched clauses themselves: ``doc_id, clause, kinds``."""
    schema = docs.select(key, F.lit("").alias("clause"), F.array(F.lit("")).alias("kinds")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for batch in batches:
            found = [(i, c.strip(), sorted(k)) for i, t in enumerate(batch.column(1)) for c, k in matcher.clauses(t.as_py())]
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(pa.string()))],
                [key, "clause", "kinds"],
            )

    return docs.select(key, text).mapInArrow(read, nullable(schema))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matched"
    )
