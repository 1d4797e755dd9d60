"""Toxicity: a learned lexicon, matched with misspellings, read in context.

Terms and stems that labelled toxic documents use are put into a trie.  The trie, intersected with Levenshtein
automata, recognises a word that is one edit away from a term; the intersection is made deterministic state by
state, as texts need it.  Every hit is seen in a window of neighbouring words that tells quotation and report
from abuse.  A logistic model over the hits gives the score.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_slices, sampled_ids, store

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that lexicon and weights are fitted on, at most.
LABELLED = 8000
#: How many terms the chance alone may be expected to bring into the lexicon.
BY_CHANCE = 0.5
#: Share of toxic contexts that a term needs, and distinct words that a stem needs.
PURITY, STEM_WORDS = 0.95, 4
#: Letters of a stem; a longer common beginning has a stem of the largest length inside it.
STEM_LENGTHS = range(4, 17)
#: Words of fewer letters must match exactly.
EDITABLE = 5
#: Words on each side of a hit that are read for its context.
WINDOW = 6
#: States of the automaton kept in a worker before it is built anew.
STATES = 100_000

#: Signs written for letters, quotation marks, words that report speech, words that address someone.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
QUOTES = "\"“”„«»‹›‟"
REPORTING = frozenset("said says wrote writes quote quoted called calls term word slur reported dit écrit mot appelle sagte schrieb wort zitat nannte dijo escribió palabra llamó cita".split())
ADDRESSING = frozenset("you your youre u du dich dein ihr tu toi vous ton te tú usted eres".split())
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$") + QUOTES + "…–—¡¿’‘"

FEATURES = ("abuse", "quoted", "addressed", "share", "several")
#: Misspellings are trusted until labelled texts tell otherwise: so many toxic of so many imagined texts.
PRIOR = (9, 10)


def plain(token: str) -> str:
    """A token as the lexicon writes it: lower case, composed, without marks at its edges."""
    word = token.lower().strip(EDGES)
    return word if word.isascii() else unicodedata.normalize("NFC", word)


@dataclass
class Automaton:
    """The trie of the lexicon crossed with Levenshtein automata of one edit, determinised as needed.

    A state is a set of (trie node, edits so far, stem reached).  Terms marked as stems accept any ending.
    """

    terms: list[tuple[str, bool]]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, tuple[int, bool]] = field(default_factory=dict)
    known: dict[frozenset, int] = field(default_factory=dict)
    sets: list[frozenset] = field(default_factory=list)
    steps: list[dict[str, int]] = field(default_factory=list)
    words: dict[str, tuple[int, int] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for number, (term, stem) in enumerate(self.terms):
            node = 0
            for letter in term:
                nxt = self.children[node].get(letter)
                if nxt is None:
                    self.children.append({})
                    nxt = self.children[node][letter] = len(self.children) - 1
                node = nxt
            self.ends.setdefault(node, (number, stem))
        self.reset()

    def reset(self) -> None:
        self.known, self.sets, self.steps = {}, [], []
        self.start = self.state(self.skipping({(0, 0)}))

    def skipping(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Adds the states that leave out one letter of a term."""
        more = {(child, 1) for node, edits in pairs if edits == 0 for child in self.children[node].values()}
        return frozenset(self.thrifty(pairs | more))

    @staticmethod
    def thrifty(pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        return {(node, edits) for node, edits in pairs if edits == 0 or (node, 0) not in pairs}

    def state(self, pairs: frozenset) -> int:
        found = self.known.get(pairs)
        if found is None:
            found = self.known[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
        return found

    def step(self, state: int, letter: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(letter)
            if child is not None:
                pairs.add((child, edits))
            if edits == 0:
                pairs.add((node, 1))  # a letter too many
                pairs.update((other, 1) for other in self.children[node].values())  # another letter
        found = self.steps[state][letter] = self.state(self.skipping(pairs))
        return found

    def search(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term that a word matches."""
        if len(self.sets) > STATES:
            self.reset()
        state, best = self.start, None
        steps = self.steps
        for place, letter in enumerate(word, 1):
            state = steps[state].get(letter) if letter in steps[state] else self.step(state, letter)
            pairs = self.sets[state]
            if not pairs:
                break
            last = place == len(word)
            for node, edits in pairs:
                end = self.ends.get(node)
                if end and (last or end[1]) and (edits == 0 or len(self.terms[end[0]][0]) >= EDITABLE) and (best is None or edits < best[1]):
                    best = (end[0], edits)
            if best and best[1] == 0:
                break
        return best

    def look_up(self, token: str) -> tuple[int, int] | None:
        """Like ``search`` for a raw token, remembered; signs that stand for letters are read as letters too."""
        try:
            return self.words[token]
        except KeyError:
            word = plain(token)
            found = self.search(word) if word else None
            if not (found and found[1] == 0) and not word.isalpha():
                read = word.translate(SIGNS)
                other = self.search(read) if read != word else None
                if other and (found is None or other[1] < found[1]):
                    found = (other[0], max(other[1], 1))
            if len(self.words) > 300_000:
                self.words.clear()
            self.words[token] = found
            return found


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    trust: np.ndarray  # of an edited match of each term
    weights: np.ndarray
    bias: float


def hits(text: str | None, automaton: Automaton) -> list[tuple[int, int, int, bool, bool]]:
    """(place, term, edits, quoted, addressed) of every match in a whole text."""
    if not text:
        return []
    tokens = text.split()
    look, found = automaton.words, []
    for place, token in enumerate(tokens):
        hit = look[token] if token in look else automaton.look_up(token)
        if hit is not None:
            found.append((place, *hit))
    return [(place, term, edits, *context(tokens, place)) for place, term, edits in found]


def context(tokens: list[str], place: int) -> tuple[bool, bool]:
    """Whether the words around a hit quote or report it, and whether they address someone."""
    before, after = tokens[max(0, place - WINDOW) : place], tokens[place + 1 : place + 1 + WINDOW]
    marks = lambda words: sum(word.count(mark) for word in words for mark in QUOTES)
    own = tokens[place]
    enclosed = (own[:1] in QUOTES and own.rstrip(".,;:!?")[-1:] in QUOTES) or (marks([*before, own[:1]]) % 2 == 1 and marks([own[1:], *after]) > 0)
    near = {plain(word) for word in [*before[-3:], *after[:3]]}
    return enclosed or bool(near & REPORTING), bool(near & ADDRESSING)


def features(text: str | None, automaton: Automaton, trust: np.ndarray) -> np.ndarray:
    found = hits(text, automaton)
    row = np.zeros(len(FEATURES))
    if found:
        kinds = set()
        for _, term, edits, quoted, addressed in found:
            value = 1.0 if edits == 0 else float(trust[term])
            row[0] += value * (not quoted)
            row[1] += value * quoted
            row[2] += value * addressed
            if value > 0.5:
                kinds.add(term)
        row[3] = np.log1p(1000 * row[0] / max(len(text), 1))
        row[:3] = np.log1p(row[:3])
        row[4] = np.log1p(max(len(kinds) - 1, 0))
    return row


def contexts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(word, toxic, context): distinct uses of every word in the labelled sample, with a hash of both neighbours.

    Uses are told apart by their neighbours, so a text that is copied many times supports its words once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = [plain(token) for token in (text.as_py() or "").split()]
                padded = ["", *words, ""]
                rows = {}
                for k, word in enumerate(words):
                    if word:
                        rows[word, xxhash.xxh3_64_intdigest(f"{padded[k]} {padded[k + 2]}") - (1 << 63)] = None
                if rows:
                    names, uses = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([toxic] * len(names), pa.int32()), pa.array(uses, pa.int64())], names=["word", "toxic", "use"])

    marked = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")
    return map_slices(marked, run, "word string, toxic int, use long").distinct()


def least_support(support: dict[int, int], base: float) -> int:
    """The least number of uses that chance makes all toxic for at most BY_CHANCE terms; ``support`` counts terms by uses."""
    n = 2
    while sum(c for s, c in support.items() if s >= n) * base**n > BY_CHANCE:
        n += 1
    return n


def learn_terms(docs: DataFrame, sample: DataFrame) -> list[tuple[str, bool]]:
    """The lexicon: (term, is a stem), of words of any length.  What reaches the driver are the terms that pass.

    A term must be used in enough different contexts, nearly all of them toxic, that chance would bring fewer
    than BY_CHANCE such terms.  A stem must besides begin enough different words.  There is no other limit on their
    number; they are words of the labelled sample, whose size bounds them, and do not grow with the corpus.
    """
    counts = store(contexts_of(docs, sample).groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("uses")), "words")
    whole = counts.agg(F.sum("bad"), F.sum("uses")).first()
    if not whole[0] or whole[0] == whole[1]:
        return []
    base = whole[0] / whole[1]

    def enough(rows: DataFrame) -> DataFrame:
        """Rows whose support is beyond chance; the support that takes is found from how many terms have each."""
        most = math.ceil(math.log(BY_CHANCE / max(rows.count(), 1)) / math.log(base)) if base < 1 else 2  # as many uses always suffice
        support = {r["uses"]: r["n"] for r in rows.groupBy(F.least("uses", F.lit(max(most, 2))).alias("uses")).agg(F.count(F.lit(1)).alias("n")).collect()}
        return rows.where((F.col("bad") >= least_support(support, base)) & (F.col("bad") >= F.lit(PURITY) * F.col("uses")))

    words = sorted(r["term"] for r in enough(counts.select(F.col("word").alias("term"), "bad", "uses")).collect())
    cuts = F.explode(F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEM_LENGTHS])).alias("term")
    stems = counts.select("word", "bad", "uses", cuts).where("term is not null").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("n_words"), F.max("bad").alias("top"))
    # no single word may carry a stem: else its beginning is no stem but a piece of that word
    found = sorted((r["term"] for r in enough(stems.where(f"n_words >= {STEM_WORDS} and 2 * top < bad")).collect()), key=lambda s: (len(s), s))
    shortest: dict[str, None] = {}
    begun = lambda word: any(word[:n] in shortest for n in STEM_LENGTHS)
    for stem in found:
        if not begun(stem):
            shortest[stem] = None
    return [(s, True) for s in shortest] + [(w, False) for w in words if not begun(w)]


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Learns lexicon and weights from labelled rows outside the held-out fold.

    Labels without an id or a value are ignored; of several for one id the largest counts.  Without toxic labels
    the lexicon is empty and every score is the same.
    """
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = store(sampled_ids(labelled.where(fold("doc_id", FOLDS) != HELD_OUT), "doc_id", most, "toxic"), "toxicity-sample")  # bounded by ``most``
    terms = learn_terms(own, sample)
    share = sample.agg(F.avg("toxic")).first()[0] or 0.0
    base = float(np.log((min(share, 0.45) + 1e-3) / (1 - min(share, 0.45))))
    if not terms:
        return Model([], np.zeros(0), np.zeros(len(FEATURES)), base)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Terms that a text meets only misspelled, if it has no exact match."""
        automaton = Automaton(terms)
        for batch in batches:
            names, answers = [], []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = hits(text.as_py(), automaton)
                if found and all(edits for _, _, edits, _, _ in found):
                    for term in {term for _, term, *_ in found}:
                        names.append(term)
                        answers.append(toxic)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(answers, pa.int32())], names=["term", "toxic"])

    marked = own.join(F.broadcast(sample), "doc_id").select("text", "toxic", "doc_id")
    trust = np.full(len(terms), PRIOR[0] / PRIOR[1])
    for row in map_slices(marked, edited, "term int, toxic int").groupBy("term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect():
        trust[row["term"]] = (row["bad"] + PRIOR[0]) / (row["n"] + PRIOR[1])
    trust = np.clip(2 * trust - 1, 0, 1)  # even odds are worth nothing

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        for batch in batches:
            values = [features(text.as_py(), automaton, trust).tolist() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "doc_id"])

    # one row for each sampled id, however many rows of the corpus repeat it
    seen = map_slices(marked, rows, "x array<double>, toxic int, doc_id long").groupBy("doc_id").agg(F.max("x").alias("x"), F.max("toxic").alias("toxic")).orderBy("doc_id").toPandas()
    x, y = np.array(seen["x"].tolist()).reshape(-1, len(FEATURES)), seen["toxic"].to_numpy(float)
    weights, bias = logistic(x, y)
    return Model(terms, trust, weights, bias)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, with a small penalty on the weights."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge * 10] * x.shape[1] + [1e-3])
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - penalty @ beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, gradient)
        beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def score(docs: DataFrame, labels: DataFrame | None = None, *, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, n_edited, n_quoted of every whole text, one row per input row.

    Without ``model`` one is fitted on ``docs`` and ``labels``.  Null and empty texts have no hits and get the score
    of a text without hits.  Repeated rows get equal scores; a null doc_id is kept and not held out; columns other
    than doc_id and text are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        automaton = Automaton(own.terms)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                value = text.as_py()
                found = hits(value, automaton) if own.terms else []
                x = features(value, automaton, own.trust) if found else np.zeros(len(FEATURES))
                p = float(1 / (1 + np.exp(-np.clip(x @ own.weights + own.bias, -30, 30))))
                out.append((p, int(p >= 0.5), len(found), sum(h[2] > 0 for h in found), sum(h[3] for h in found)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "score", "predicted", "n_hits", "n_edited", "n_quoted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    out = map_slices(own, run, "doc_id long, score double, predicted int, n_hits long, n_edited long, n_quoted long")
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_hits", "n_edited", "n_quoted")
