"""Toxic language: a learned lexicon, matched with misspellings, weighed by context.

1. The lexicon is learned from labelled documents (a bounded sample): words that are far likelier in toxic ones,
   and stems, which are word beginnings shared by several such words, each weighed by its log-odds.
2. All terms form a trie. Intersected with Levenshtein automata (one edit for words and stems of five letters or
   more, none for shorter ones; a word that only lacks a stem's last letter is no form of it) it becomes one deterministic automaton, whose table all words of a batch
   walk together, a letter per step; words that can no longer match drop out after a few steps. A word that looks
   like a misspelled term, or begins with a stem, but is a word of clean documents is none.
3. A match in quotation marks, or near a word of speech or report, counts as quoted; near a word of address it
   counts as directed. Sums of weights by kind, in which a misspelled term counts ``MISSPELLED`` of its weight, are
   the inputs of a logistic model fitted on the same sample.

Letters are code points: every one of the lexicon is told apart, all others are one letter that no term has.
Labels, language, source and id never enter a score. Missing and empty texts have no match and get the score of
a text without matches; without labels there is no lexicon and every score is the prior's; repeated rows get
equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.boosted_trees import MAX_ROWS, labelled_sample
from tallyframe.llm.tables import doc_remainder, fold, map_texts
from tallyframe.llm.text_arrays import FOLD, LETTER_OR_DIGIT, Texts, Words, chunks, words_of
from tallyframe.session import stage

REMAINDER, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: A term occurs in so many toxic documents at least, and is so many times likelier in them.
LEAST, ODDS = 8, 10.0
#: Lengths of stems, and how many different words in toxic documents a stem must begin.
STEMS, STEM_WORDS = range(4, 9), 5
FUZZY_FROM, MISSPELLED = 5, 0.85

#: Words near a match that speak of speech, and words that address somebody.
REPORTING = ("said", "says", "quoted", "quote", "word", "term", "called", "wrote", "sagte", "zitat", "dijo")
ADDRESS = ("you", "your", "youre", "du", "dich", "ihr", "tu", "toi", "vous", "eres", "usted")
NEAR = 3

EXACT, FUZZY = 2, 1


@dataclass(frozen=True)
class Automaton:
    """``table[state, class]`` is the next state; state 0 accepts nothing any more."""

    points: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    weight: np.ndarray
    start: int

    def match(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For every word the state it ends in: ``accepts`` tells whether that is a term (2), a misspelled one
        (1) or nothing (0), and ``weight`` which weight the term has."""
        out, classes = np.zeros(len(start), dtype=np.int32), self._classes(data)
        alive, state, at = np.arange(len(start)), np.full(len(start), self.start, np.int32), start.copy()
        while len(alive):
            done = at >= end[alive]
            out[alive[done]] = state[done]
            alive, state, at = alive[~done], state[~done], at[~done]
            state = self.table[state, classes[at]]
            keep = state > 0
            alive, state, at = alive[keep], state[keep], at[keep] + 1
        return out

    def _classes(self, data: np.ndarray) -> np.ndarray:
        """Class of every byte: that of the code point that begins there, 1 for bytes that continue one."""
        place = np.minimum(np.searchsorted(self.points, np.arange(128)), max(len(self.points) - 1, 0))
        ascii = np.where(self.points[place] == np.arange(128), place + 2, 0) if len(self.points) else np.zeros(128, np.int64)
        table = np.zeros(256, dtype=np.int32)
        table[:128], table[0x80:0xC0] = ascii, 1
        out = table[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead) and len(self.points):
            b = data[np.minimum(lead[:, None] + np.arange(4), len(data) - 1)].astype(np.int64)
            tail = b[:, 1:] & 0x3F
            point = np.where(b[:, 0] < 0xE0, (b[:, 0] & 0x1F) << 6 | tail[:, 0], np.where(
                b[:, 0] < 0xF0, (b[:, 0] & 0x0F) << 12 | tail[:, 0] << 6 | tail[:, 1],
                (b[:, 0] & 0x07) << 18 | tail[:, 0] << 12 | tail[:, 1] << 6 | tail[:, 2]))
            place = np.minimum(np.searchsorted(self.points, point), len(self.points) - 1)
            out[lead] = np.where(self.points[place] == point, place + 2, 0)
        return out


def automaton(words: dict[str, float], stems: dict[str, float], fuzzy_from: int = FUZZY_FROM,
              crowded: frozenset | set = frozenset()) -> Automaton:
    """One deterministic automaton of all terms with their weights. Class 0 is any code point of no term, class 1 a continuation
    byte, which changes nothing."""
    children: list[dict[int, int]] = [{}, {}, {}]  # node 0: words with edits, node 1: terms without, node 2: stems with
    final: dict[int, str] = {}
    worth: dict[int, float] = {}

    def add(term: str, root: int, kind: str, weight: float) -> None:
        node = root
        for b in map(ord, term):
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        final[node], worth[node] = kind, max(weight, worth.get(node, 0.0))

    for w, weight in words.items():
        add(w, 0 if len(w) >= fuzzy_from else 1, "word", weight)
    for s, weight in stems.items():
        add(s, 2 if len(s) >= fuzzy_from and s not in crowded else 1, "stem", weight)
    letters = sorted({b for c in children for b in c})

    def closed(states: set[tuple[int, int]]) -> frozenset:
        todo = list(states)
        while todo:
            node, left = todo.pop()
            if left:  # a letter of the term is left out, but not the last one of a stem
                for child in children[node].values():
                    if (child, left - 1) not in states and final.get(child) != "stem":
                        states.add((child, left - 1))
                        todo.append((child, left - 1))
        # fewer edits left is no better where the same node is reached with more
        return frozenset(s for s in states if not (s[1] == 0 and (s[0], 1) in states))

    def step(states: frozenset, b: int | None) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, left in states:
            if final.get(node) == "stem":
                out.add((node, left))
            if b is not None and b in children[node]:
                out.add((children[node][b], left))
            if left:
                out.add((node, left - 1))  # a letter too many
                out.update((child, left - 1) for child in children[node].values())  # another letter
        return closed(out)

    first = closed({(0, 1), (1, 0), (2, 1)})
    number = {frozenset(): 0, first: 1}
    table, order = [[0] * (len(letters) + 2)], [first]
    for states in order:
        row = []
        for b in [None, -1, *letters]:
            after = states if b == -1 else step(states, b)
            if after not in number:
                number[after] = len(number)
                order.append(after)
            row.append(number[after])
        table.append(row)
    accepts, weights = np.zeros(len(number), dtype=np.int8), np.zeros(len(number), dtype=np.float32)
    no_edits = _below(children, 1)
    for states, i in number.items():
        ends = [(EXACT if left or node in no_edits else FUZZY, worth[node]) for node, left in states if node in final]
        if ends:
            accepts[i], weights[i] = max(ends)
    return Automaton(np.array(letters, dtype=np.int64), np.array(table, dtype=np.int32), accepts, weights, 1)


def _below(children: list[dict[int, int]], root: int) -> set[int]:
    found, todo = {root}, [root]
    while todo:
        for child in children[todo.pop()].values():
            found.add(child)
            todo.append(child)
    return found


def _plain(text) -> F.Column:
    """Typographic quotation marks as plain ones."""
    return F.translate(text, "“”„«»‘’", '"""""\'\'')


def lexicon(docs: DataFrame, sample: DataFrame, least: int = LEAST, odds: float = ODDS) -> tuple[dict, dict, set, DataFrame]:
    """Words and stems that mark toxic documents, with their log-odds, stems that get no edit, and the usual words of clean documents.
    ``sample`` is bounded, and so are its texts' words."""
    found = F.array_distinct(F.regexp_extract_all(fold(_plain(F.col("text"))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    texts = docs.join(F.broadcast(sample), docs["doc_id"] == sample["labelled_id"]).select("label", F.explode(found).alias("word"))
    toxic, size = sample.agg(F.sum("label"), F.count("*")).first()
    toxic = toxic or 0
    clean = size - toxic
    words = stage(texts.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")))
    likelier = F.log((F.col("toxic") + 0.5) / (toxic + 1.0) / ((F.col("n") - F.col("toxic") + 0.5) / (clean + 1.0)))
    marks = (F.col("toxic") >= least) & (F.col("weight") >= float(np.log(odds)))
    begin = F.explode(F.array(*[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEMS]))
    stems = words.select("toxic", "n", begin.alias("stem")).filter("stem is not null").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("words"),
        F.max("toxic").alias("most")).withColumn("weight", likelier).filter(
        marks & (F.col("words") >= STEM_WORDS) & (F.col("most") < 0.5 * F.col("toxic")))
    chosen: dict[str, float] = {}
    found_stems = sorted(stems.collect(), key=lambda r: (-r["weight"] * np.sqrt(r["toxic"]), r["stem"]))
    for r in found_stems:
        if not any(r["stem"].startswith(c) or c.startswith(r["stem"]) for c in chosen):
            chosen[r["stem"]] = r["weight"]
    # a stem too short for an edit has the longest ones that it begins beside it, which are matched with one
    short = tuple(c for c in chosen if len(c) < FUZZY_FROM)
    longer = {r["stem"]: r["weight"] for r in found_stems if len(r["stem"]) >= FUZZY_FROM and r["stem"].startswith(short)}
    chosen |= {c: w for c, w in longer.items() if not any(o != c and o.startswith(c) for o in longer)}
    # the same rule as for words: where the words within one edit of a stem are usual as a whole, it gets none
    near = [F.when(_begins_nearly(c), F.lit(c)) for c in chosen if len(c) >= FUZZY_FROM]
    crowded = {r["stem"] for r in words.select("toxic", "n", F.explode(F.array(*near)).alias("stem")).filter(
        "stem is not null").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).withColumn(
        "weight", likelier).filter((F.col("n") > F.col("toxic")) & (F.col("weight") < float(np.log(odds)))).collect()} if near else set()
    whole = words.withColumn("weight", likelier).filter(marks).orderBy("word").collect()
    usual = words.withColumn("weight", likelier).filter((F.col("n") > F.col("toxic")) & (F.col("weight") < float(np.log(odds))))
    marked = {r["word"]: r["weight"] for r in whole}
    return marked, chosen, crowded, usual.select("word")


def _begins_nearly(stem: str) -> F.Column:
    """Whether ``word`` begins with something one edit from the stem, but not with the stem."""
    near = [F.levenshtein(F.substring("word", 1, k), F.lit(stem)) == 1 for k in range(len(stem) - 1, len(stem) + 2)]
    return (near[0] | near[1] | near[2]) & (F.length("word") >= len(stem) - 1) & ~F.startswith(F.col("word"), F.lit(stem))


def lookalikes(usual: DataFrame, terms: Automaton) -> np.ndarray:
    """Sorted hashes of usual words that the automaton takes for terms; few, as terms are few."""

    def run(batches):
        for b in batches:
            for texts in chunks(b.column("word")):
                words = words_of(texts, LETTER_OR_DIGIT)
                yield pa.RecordBatch.from_arrays([pa.array(words.hash[terms.accepts[terms.match(
                    FOLD[texts.data], words.start, words.end)] > 0].view(np.int64))], names=["hash"])

    return np.sort(usual.mapInArrow(run, "hash long").toArrow().column("hash").to_numpy().view(np.uint64))


#: Signs per document, and what the prior takes their weights to be.
SIGNS = ("open", "strongest", "misspelled", "quoted", "directed", "density")
PRIOR = np.array([-3.0, 0.3, 0.7, 0.0, -0.1, 0.2, 0.0])


def _hashes(terms: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(terms).encode(), dtype=np.uint8)
    return np.sort(words_of(Texts(data, np.array([0, len(data)]), 0), LETTER_OR_DIGIT).hash)


def signs(texts: Texts, terms: Automaton, usual: np.ndarray) -> np.ndarray:
    words = words_of(texts, LETTER_OR_DIGIT)
    data = FOLD[texts.data]
    state = terms.match(data, words.start, words.end)
    hit = np.flatnonzero(terms.accepts[state])
    hit = hit[~np.isin(words.hash[hit], usual)]
    kind = terms.accepts[state[hit]]
    weight = terms.weight[state[hit]] * np.where(kind == EXACT, 1.0, MISSPELLED)
    quoted = _in_quotes(texts, words, hit) | _near(words, hit, _hashes(REPORTING))
    directed = _near(words, hit, _hashes(ADDRESS)) & ~quoted
    doc, n = words.doc[hit], len(texts)
    total = lambda mask: np.bincount(doc[mask], weight[mask], n)[:n]
    open_hits, misspelled = total(~quoted), total(~quoted & (kind == FUZZY))
    strongest = np.zeros(n)
    np.maximum.at(strongest, doc[~quoted], weight[~quoted])
    return np.column_stack([
        np.minimum(open_hits, 15), strongest, np.minimum(misspelled, 10), np.minimum(total(quoted), 10),
        np.minimum(total(directed), 10),
        np.minimum(20 * open_hits / np.maximum(np.diff(words.bounds), 1), 10)]).astype(np.float32)


def _in_quotes(texts: Texts, words: Words, hit: np.ndarray) -> np.ndarray:
    """A quotation mark right before and one right after the match, or an odd number of marks before it on
    its line."""
    data = np.append(texts.data, np.uint8(32))
    mark = lambda b: (b == 34) | (b == 39)
    tight = mark(data[np.maximum(words.start[hit] - 1, 0)]) & mark(data[words.end[hit]]) & (words.start[hit] > 0)
    marks = np.concatenate([[0], np.cumsum(texts.data == 34)])
    breaks = np.flatnonzero(texts.data == 10) + 1
    line = np.union1d(texts.offsets[:-1], breaks)
    begin = line[np.searchsorted(line, words.start[hit], side="right") - 1] if len(hit) else hit
    return tight | ((marks[words.start[hit]] - marks[begin]) % 2 == 1)


def _near(words: Words, hit: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Whether one of ``terms`` stands within ``NEAR`` words of the match in its text."""
    out = np.zeros(len(hit), dtype=bool)
    for d in (*range(-NEAR, 0), *range(1, NEAR + 1)):
        at = np.clip(hit + d, 0, max(len(words.hash) - 1, 0))
        same = (words.doc[at] == words.doc[hit]) & (at == hit + d)
        place = np.minimum(np.searchsorted(terms, words.hash[at]), len(terms) - 1)
        out |= same & (terms[place] == words.hash[at])
    return out


def fit_logit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (intercept first) of a logistic model whose weights are drawn to ``prior``. Newton steps are halved
    until they gain, and the penalised likelihood has one maximum, also where classes are separated."""
    z = np.column_stack([np.ones(len(x)), x])

    def value(w: np.ndarray) -> float:
        eta = z @ w
        return float(y @ eta - np.logaddexp(0, eta).sum() - 0.5 * strength * ((w - prior) ** 2).sum())

    w = prior.astype(np.float64).copy()
    best = value(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        gradient = z.T @ (y - p) - strength * (w - prior)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + strength * np.eye(len(w))
        move, scale = np.linalg.solve(hessian, gradient), 1.0
        while value(w + scale * move) < best and scale > 1e-8:
            scale /= 2
        gained = value(w + scale * move) - best
        if gained <= 1e-9:
            break
        w, best = w + scale * move, best + gained
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most ``max_rows`` rows of two numbers: small enough to send to every executor
    sample = stage(labelled_sample(labels, "toxic", REMAINDER, HELD_OUT, max_rows))
    marked, stems, crowded, clean = lexicon(rows, sample)
    terms = automaton(marked, stems, crowded=crowded)
    usual = lookalikes(clean, terms)

    def one(batch: pa.RecordBatch, texts: Texts) -> dict[str, pa.Array]:
        x = signs(texts, terms, usual)
        return {"doc_id": batch.column("doc_id"), "x": pa.ListArray.from_arrays(
            pa.array(np.arange(len(x) + 1) * len(SIGNS), pa.int32()), pa.array(x.ravel(), pa.float32()))}

    found = stage(map_texts(rows.withColumn("text", _plain(F.col("text"))), "doc_id long, x array<float>", one))
    known = found.join(F.broadcast(sample), found["doc_id"] == sample["labelled_id"]).select("label", "x").toArrow()
    x = np.array(known.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(SIGNS))
    w = fit_logit(x, known.column("label").to_numpy().astype(np.float64)) if len(x) else PRIOR
    eta = F.lit(float(w[0]))
    for j in range(len(SIGNS)):
        eta = eta + F.col("x")[j].cast("double") * float(w[j + 1])
    return found.select("doc_id", (doc_remainder(REMAINDER) == HELD_OUT).alias("held_out"),
                        (1 / (1 + F.exp(-eta))).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
