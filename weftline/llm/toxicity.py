"""Toxicity by a weighted finite-state grammar of clauses.

A clause is a tape of word classes: insult, threat, deed (a threat's verb in the past),
pronouns, negation, reported speech, other. Four transducers rewrite the tape one
after the other: ``negation`` and ``target`` mark the insults and verbs that they reach,
``threat`` writes a match where a verb and whom it is aimed at meet, ``reported`` marks
the whole clause. Their composition is one transducer, built once, which reads each
word once.

The verbs are stems with the endings of their language. The insults are learned: whole
words with their endings, and stems of which labelled toxic documents have many longer
words; a stem that one word alone speaks for is that word.

What a document has of each word counts once, as its most direct match. A logistic
function of three sums of weights (of all matches, of those neither negated nor
reported, of those aimed at someone) is fitted to labelled documents; its weights are
never negative, so that a target raises a score and negation and reported speech lower
it, and they stay near fixed ones where labels say nothing. A threat has a share of its own, by its
kind: the share of toxic documents among those that have it, counted on from a fixed
one. A document is toxic unless neither its insults nor any of its threats make it so.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import text_of

MAX_LABELLED = 40_000  # labelled rows that words and the fit are learned from: those of smallest id hash
STEM = (3, 8)  # letters in a stem that stands for the longer words beginning with it
FORMS = 4  # words that a stem has in toxic documents
ONE_WORD = 0.5  # share of a stem's documents that one of its words may have
SHARPER = (0.9, 0.75)  # a longer stem takes the place of one with this share of its toxic, and at most this share of its clean documents
HARMLESS = 3  # clean documents of a word with a learned stem, fewer of the toxic, that show it to be harmless
MIN_SHARE = 0.01  # of the toxic training documents that have a word or stem
MIN_ODDS = 30.0
CERTAINTY = 2.0  # standard errors that a weight is below its log-odds

# The words of the grammar's closed classes (English, German, French, Spanish).
NEGATION = {"not", "no", "never", "isn", "aren", "don", "won", "nicht", "kein", "keine", "keinen", "nie", "ne", "pas", "jamais", "nunca", "ningún"}
REPORTED = {"said", "says", "wrote", "quoted", "called", "claimed", "sagte", "schrieb", "nannte", "dit", "écrit", "dijo", "escribió", "llamó"}
SUBJECT = {"he", "she", "they", "du", "ihr", "tu", "il", "elle", "ils", "elles", "usted", "ustedes", "ellos", "ellas", "él"}
YOU = {"you", "your", "yourself", "yourselves"}  # a verb's object after it alone
THEE = {"dich", "dir", "euch", "te", "toi", "vous", "os", "ti"}  # on either side of it
THEY = {"him", "her", "them", "ihn", "ihnen"}
LITERAL = {"clown", "trash", "garbage", "loser", "pig", "dog", "rat", "snake", "donkey", "müll", "schwein", "hund", "esel", "ordure", "cochon", "chien", "âne", "payaso", "basura", "cerdo", "perro", "burro"}  # words with an everyday sense
# Stems of verbs with the endings of the present and those of the past.
VERBS = [
    ("kill murder hurt destroy stab strangle punch smash", ("", "s", "ing"), ("ed",)),
    ("beat shoot", ("", "s", "ing"), ("en",)),
    ("töt", ("e", "est", "et", "en"), ("ete", "eten")),
    ("umbring erschieß erwürg verprügel", ("", "e", "t", "en", "st"), ("te", "ten")),
    ("schlag", ("e", "t", "en"), ()),
    ("tu frapp massacr étrangl", ("er", "e", "es", "ent", "erai", "era", "erons", "ez"), ("é", "ée", "és", "ait")),
    ("mat golpe asesin", ("ar", "o", "as", "a", "an", "aré", "ará", "aremos", "arte", "aros"), ("é", "ó", "aron", "ado")),
]
PAST = {"shot", "getötet", "umgebracht", "schlug"}
ENDINGS = ("s", "es", "e", "en", "n", "er")  # of insults learned as whole words
# What the grammar's arcs weigh where labels say nothing.
PRIOR_WEIGHTS = (0.0, 3.0, 1.0)  # of the logarithms of the three sums
PULL = 2.0  # of the fixed weights: what a ridge penalty is multiplied by
PRIOR_SHARE = {"threat": 0.65, "menace": 0.25, "deed": 0.2, "negated": 0.1, "reported": 0.1}  # of toxic documents among those with a threat of this kind
PRIOR_ROWS = 20  # documents that a fixed share counts for
ALONE = 0.1  # of the weight of a literal word that is no target's and is a document's only insult

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
REACH = 3  # words that negation, target and threat reach
CLASSES = ("other", "negation", "report", "subject", "you", "thee", "they", "threat", "deed", "insult")
PRONOUNS = ("subject", "you", "thee", "they")


def verb_forms() -> dict[str, str]:
    """The verbs' forms with their class, threat or deed."""
    forms = dict.fromkeys(PAST, "deed")
    for stems, present, past in VERBS:
        for stem in stems.split():
            forms |= {stem + e: "deed" for e in past} | {stem + e: "threat" for e in present}
    return forms


class Transducer:
    """A deterministic transducer: ``arcs`` maps (state, symbol) to (next state, symbols written); other symbols are written as they are.

    ``idle`` maps each state to the one after a symbol without an arc; ``final`` has the factor of a tape that ends in a state.
    """

    def __init__(self, start, arcs: dict, idle: dict, final: dict | None = None):
        self.start, self.arcs, self.idle, self.final = start, arcs, idle, final or {}

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol)) or (self.idle[state], (symbol,))

    def ending(self, state) -> float:
        return self.final.get(state, 1.0)


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that has ``second`` read what ``first`` writes, over the states that can be reached by ``alphabet``."""
    start = (first.start, second.start)
    arcs, waiting, known = {}, [start], {start}
    while waiting:
        a, b = state = waiting.pop()
        for symbol in alphabet:
            to, written = first.step(a, symbol)
            at, out = b, []
            for s in written:
                at, more = second.step(at, s)
                out += more
            arcs[state, symbol] = ((to, at), tuple(out))
            if (to, at) not in known:
                known.add((to, at))
                waiting.append((to, at))
    return Transducer(start, arcs, {}, {s: first.ending(s[0]) * second.ending(s[1]) for s in known})


def _reaching(triggers: Iterable[str], mark: str, marked: Iterable[str]) -> Transducer:
    """Marks what follows one of ``triggers`` within REACH words."""
    arcs = {}
    for left in range(REACH + 1):
        arcs |= {(left, t): (REACH, (t,)) for t in triggers}
        if left:
            arcs |= {(left, s): (left - 1, (f"{s}/{mark}",)) for s in marked}
    return Transducer(0, arcs, {left: max(left - 1, 0) for left in range(REACH + 1)})


def _threat() -> Transducer:
    """Writes a match (``aimed`` or ``done``, whom it is aimed at, the verb's marks) where a verb and its object meet within REACH words; lone verbs are written as other words."""
    verbs = ("threat", "threat/negated", "deed", "deed/negated")
    objects = ("you", "thee", "they")
    states = [("none", 0)] + [(what, left) for what in ("thee", *verbs) for left in range(1, REACH + 1)]
    arcs = {}

    def match(verb: str, who: str) -> str:
        name, *marks = verb.split("/")
        return "/".join(["aimed" if name == "threat" else "done", "they" if who == "they" else "you", *marks])

    for what, left in states:
        for who in objects:
            to = ("thee", REACH) if who == "thee" else ("none", 0) if what in verbs else (what, left - 1) if left > 1 else ("none", 0)
            arcs[(what, left), who] = (to, (match(what, who), who) if what in verbs else (who,))
        for v in verbs:
            met = what == "thee"
            after = (what, left - 1) if left > 1 else ("none", 0)
            arcs[(what, left), v] = (after if met else (v, REACH), (match(v, "thee"),) if met else ("other",))
    return Transducer(("none", 0), arcs, {(w, n): (w, n - 1) if n > 1 else ("none", 0) for w, n in states})


def _reported() -> Transducer:
    return Transducer("direct", {(s, "report"): ("reported", ("report",)) for s in ("direct", "reported")}, {s: s for s in ("direct", "reported")}, {"reported": 0.0})


def grammar() -> Transducer:
    """The four transducers composed."""
    parts = [_reaching(("negation",), "negated", ("insult", "threat", "deed")), _reaching(PRONOUNS, "targeted", ("insult", "insult/negated")), _threat(), _reported()]
    whole = parts[0]
    for part in parts[1:]:
        whole = compose(whole, part, CLASSES)
    return whole


def kind_of(symbol: str) -> tuple[bool, str] | None:
    """Whether a written symbol is an insult (or else a threat), and its kind; None if it is no match."""
    name, *marks = symbol.split("/")
    if name == "insult":
        return True, "negated" if "negated" in marks else "targeted" if "targeted" in marks else "plain"
    if name in ("aimed", "done"):
        return False, "negated" if "negated" in marks else "deed" if name == "done" else "menace" if "they" in marks else "threat"
    return None


class Grammar:
    """The composed grammar with its words. ``learned`` maps a stem, or a whole word ending in a space, to its weight."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.verbs = verb_forms()
        self.closed = {w: c for c, words in (("subject", SUBJECT), ("they", THEY), ("thee", THEE), ("you", YOU), ("report", REPORTED), ("negation", NEGATION)) for w in words} | self.verbs
        whole = grammar()
        number = {s: k for k, s in enumerate(dict.fromkeys([whole.start, *(s for s, _ in whole.arcs)]))}
        self.arcs: list[dict[str, tuple[int, list]]] = [{} for _ in number]
        for (state, symbol), (to, written) in whole.arcs.items():
            self.arcs[number[state]][symbol] = (number[to], [k for s in written if (k := kind_of(s))])
        self.reported = [whole.ending(s) == 0 for s in number]
        self.known: dict[str, tuple[str, float] | None] = {}

    def insult(self, word: str) -> tuple[str, float] | None:
        """The learned word that a word is a form of, or itself if it begins with a learned stem; and its weight."""
        if word not in self.known:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[word] = self._insult(word)
        return self.known[word]

    def _insult(self, word: str) -> tuple[str, float] | None:
        for end in ("", *ENDINGS):
            whole = word.removesuffix(end) + " "
            if word.endswith(end) and whole in self.learned:
                return (whole.strip(), self.learned[whole]) if self.learned[whole] else None
        for n in range(STEM[0], min(STEM[1] + 1, len(word))):
            if word[:n] in self.learned:
                return word, self.learned[word[:n]]
        return None

    def clause(self, words: list[str]) -> list[tuple[str, str, float]]:
        """Run the grammar over a clause: kind, learned word (empty for threats) and weight of each match."""
        state, found = 0, []
        for word in words:
            symbol = self.closed.get(word)
            own = None if symbol else self.insult(word)
            state, kinds = self.arcs[state][symbol or ("insult" if own else "other")]
            for lexical, kind in kinds:
                found.append((kind, *own) if lexical else (kind if kind in PRIOR_SHARE else "threat", "", 1.0))
        if found and self.reported[state]:
            found = [("reported", w, x) for _, w, x in found]
        return found

    def matches(self, text: str) -> list[tuple[str, str, float, str]]:
        """Kind, learned word, weight and clause of each match of a text."""
        text = text.lower()
        if not any(w in self.verbs or (w not in self.closed and self.insult(w)) for w in set(WORD.findall(text))):
            return []
        return [(*m, part.strip()) for part in CLAUSE.split(text) for m in self.clause(WORD.findall(part))]

    @staticmethod
    def features(found: list[tuple]) -> tuple[list[float], list[str]]:
        """The logarithms of the three sums over a text's insults, and the kinds of its threats."""
        rank = {"negated": 0, "reported": 0, "plain": 1, "targeted": 2}
        best: dict[str, tuple[int, float]] = {}
        for kind, word, weight, *_ in found:
            if word:
                best[word] = max(best.get(word, (0, weight)), (rank[kind], weight))
        if len(best) == 1 and (word := next(iter(best))) in LITERAL and best[word][0] < 2:
            best[word] = (best[word][0], best[word][1] * ALONE)
        sums = [sum(w for r, w in best.values() if r >= least) for least in range(3)]
        return [math.log1p(x) for x in sums], [kind for kind, word, *_ in found if not word]


def held_out() -> Column:
    """Whether an id's rows are kept from learning: crc32 of the id's text (null: empty) divides by five."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic (0 or 1) of at most MAX_LABELLED labelled documents that aren't held out.

    Labels that are null or of unknown ids teach nothing; an id labelled twice takes the greater label.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return documents.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # MAX_LABELLED narrow rows at most


def learn_words(rows: DataFrame) -> dict[str, float]:
    """Words (ending in a space) and stems with the lower bounds of their log-odds among toxic rows, counted by Spark.

    All that pass MIN_SHARE and MIN_ODDS are kept but those that begin with a shorter
    stem that is, and stems that a SHARPER one takes the place of. A stem stands for longer words only, so that a word may be harmless where
    its derivatives are not; it needs FORMS of them, none with more than ONE_WORD of its
    documents. Words of it that are HARMLESS have weight 0. There are no more stems than
    a toxic text has on average, divided by MIN_SHARE, and no more words than MAX_LABELLED rows have.
    """
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return {}
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("w"))
    words = words.groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    stem = F.explode(F.concat(F.array(F.concat("w", F.lit(" "))), F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda k: F.when(F.length("w") > k, F.substring("w", F.lit(1), k)))))
    counted = words.select("t", "n", stem.alias("s")).where("s is not null").groupBy("s").agg(F.sum("t").alias("t"), (F.sum("n") - F.sum("t")).alias("c"), F.count_if(F.col("t") > 0).alias("forms"), F.max("t").alias("most"))
    odds = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    sure = F.log(odds) - CERTAINTY * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    whole = F.col("s").endswith(" ")
    productive = (F.col("forms") >= FORMS) & (F.col("most") <= ONE_WORD * F.col("t"))
    best = counted.where((whole | productive) & (F.col("t") >= max(5, MIN_SHARE * toxic)) & (odds >= MIN_ODDS)).select("s", "t", "c", sure.alias("w")).where("w > 0")
    found = {r.s: r for r in best.collect()}
    sharper = {s[:n] for s, r in found.items() for n in range(STEM[0], len(s)) if s[:n] in found and r.t >= SHARPER[0] * found[s[:n]].t and r.c <= SHARPER[1] * found[s[:n]].c}
    found = {s: r.w for s, r in found.items() if s not in sharper}
    found = {s: w for s, w in found.items() if not any(s[:n] in found for n in range(STEM[0], len(s)))}
    stems = [s for s in found if not s.endswith(" ")]
    if stems:
        harmless = (F.col("n") - F.col("t") >= HARMLESS) & ((F.col("t") + 0.5) / (toxic + 1) < (F.col("n") - F.col("t") + 0.5) / (clean + 1))
        found |= {f"{r.w} ": 0.0 for r in words.where(harmless & F.col("w").rlike(f"^(?:{'|'.join(map(re.escape, stems))})")).collect()}
    return found


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 200) -> np.ndarray:
    """Logistic regression with weights of 0 or more, drawn to ``prior`` (0), and a free intercept (last), by Newton's method.

    A step is halved until it lowers the loss, and weights that it takes below 0 stay
    at 0, so no step can run away, even where the rows are separable.
    """
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    to = np.zeros(x.shape[1]) if prior is None else np.append(prior, 0.0)
    free = np.append(np.zeros(x.shape[1] - 1, bool), True)

    def loss(v):
        z = x @ v
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * (v - to) @ (v - to)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (p - y) + ridge * (w - to)
        moved = free | (w > 0) | (grad < 0)
        hess = ((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)))[np.ix_(moved, moved)]
        step = np.zeros(len(w))
        step[moved] = np.linalg.solve(hess, grad[moved])
        size = 1.0
        while size > 1e-9:
            tried = w - size * step
            tried[~free] = np.maximum(tried[~free], 0)
            if (then := loss(tried)) < now:
                break
            size /= 2
        else:
            break
        done, w, now = now - then < 1e-10 * max(1.0, now), tried, then
        if done:
            break
    return w


class Model:
    """A grammar with the weights of the three sums and the intercept, and the share of each kind of threat."""

    def __init__(self, grammar: Grammar, weights: np.ndarray, shares: dict[str, float]):
        self.grammar, self.weights, self.shares = grammar, weights, shares

    def score(self, found: list[tuple]) -> float:
        """The score of a text with these matches."""
        sums, threats = self.grammar.features(found)
        z = float(np.dot(self.weights[:-1], sums) + self.weights[-1])
        clean = 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        for kind in threats:
            clean *= 1 - self.shares[kind]
        return 1 - clean


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """Words, weights and shares from the training rows. Without any, or where a text without matches would score a half or more, such a text scores a hair below it."""
    rows = training_rows(documents, labels)
    grammar = Grammar(learn_words(rows))
    shared = documents.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        for b in batches:
            g = shared.value
            found = [g.features(g.matches(x.as_py())) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([sorted(set(t)) for _, t in found], pa.list_(pa.string())), b.column(1).cast(pa.int32())], ["x", "threats", "y"])

    got = rows.mapInArrow(run, "x array<double>, threats array<string>, y int").groupBy("x", "threats", "y").count().orderBy("x", "threats", "y").collect()  # MAX_LABELLED rows at most, in one order
    weights = np.array([*PRIOR_WEIGHTS, -1e-6])
    seen = dict.fromkeys(PRIOR_SHARE, (0, 0))
    if got:
        times = [r["count"] for r in got]
        weights = fit(np.repeat([r.x for r in got], times, axis=0), np.repeat([float(r.y) for r in got], times), np.array(PRIOR_WEIGHTS), PULL)
        for r in got:
            for kind in r.threats:
                seen[kind] = seen[kind][0] + r.y * r["count"], seen[kind][1] + r["count"]
    shares, most = {}, 1.0
    for kind, share in PRIOR_SHARE.items():  # from the most direct kind on: no other may have more
        most = shares[kind] = min(most, (seen[kind][0] + PRIOR_ROWS * share) / (seen[kind][1] + PRIOR_ROWS))
    return Model(grammar, np.append(weights[:-1], min(weights[-1], -1e-6)), shares)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the matches (kind, word, weight, clause) of every row of documents (doc_id, text; others are ignored).

    Null texts are empty; empty texts have the score of a text without matches.
    Repeated rows and null ids each give their row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.grammar.matches(x.as_py()) for x in b.column(1)]
            clauses = [[{"kind": k, "word": i, "weight": w, "clause": c} for k, i, w, c in x] for x in found]
            typed = pa.array(clauses, pa.list_(pa.struct([("kind", pa.string()), ("word", pa.string()), ("weight", pa.float64()), ("clause", pa.string())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(x) for x in found], pa.float64()), typed], ["doc_id", "score", "clauses"])

    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, score double, clauses array<struct<kind:string,word:string,weight:double,clause:string>>")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, held_out, score, predicted."""
    return scored(documents, learn(documents, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, all columns, whose text scores below a half. Null and empty texts stay; so do repeated rows and null ids."""
    model = learn(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, at = shared.value, None
        for b in batches:
            at = b.schema.get_field_index("text") if at is None else at
            yield b.filter(pa.array([m.score(m.grammar.matches(x.as_py() or "")) < 0.5 for x in b.column(at)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
