"""Toxicity by a weighted finite-state grammar over clauses.

Words get a class: insult (I), an insult that the labels vouch for (S), threat verb (V), target (T), negation (N),
reporting verb (R), quotation mark (Q), other (O). Four transducers are composed into one machine that reads a clause:
negation (an insult or threat up to three words after N is negated), reported speech (one after R, or between Qs, is
reported), target (an insult in a clause with a target is aimed; a threat verb needs one after it) and the scorer.
A document's score is the sum over its matched clauses; REJECT and more is toxic. An aimed insult or threat reaches it in
one clause. What isn't aimed doesn't: four listed insults are needed, or two that the labels vouch for.

S comes from labelled rows: listed insults, other words and word beginnings that mark toxic rows and hardly any other, so
that languages without a word list, and inflected forms, are met too. Of the unlisted those are chosen that mark most
toxic rows in which fewer than two words are marked yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlode.llm import textkernel as tk
from graphlode.llm.wfst import Wfst, build, compose
from graphlode.storage import stash

REJECT = 1.5
SCOPE = 3
#: At most about so many labelled rows of each class are fitted on, chosen by a hash of doc_id.
MAX_TOXIC, MAX_CLEAN = 4_000, 8_000
PREFIXES = (4, 5, 6, 7, 8)
MIN_GAIN, MIN_ODDS = 5, 80.0

INSULTS = """idiot idiots moron morons loser losers scum trash worthless pathetic disgusting stupid clown clowns imbecile
dumbass dimwit bastard scumbag lowlife vermin idiote crétin connard abruti ordure débile trottel dummkopf abschaum
arschloch idiota imbécil estúpido estúpida asqueroso inútil""".split()
THREATS = "kill hurt murder destroy stab shoot strangle tuer töten umbringen matar".split()
TARGETS = "you your yours yourself u he she they him her them tu toi vous du dich dir ihr usted ustedes".split()
NEGATIONS = "not never no isn aren wasn don doesn didn won cannot ne pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says say called calls wrote writes claimed claims quoted tweeted yelled dit sagte dijo".split()

CLASSES = "OISVTNRQ"
_KIND = np.uint64(15)
_LABELS = CLASSES + "isvr"
#: Words that are to be marked in a toxic row of the sample, if it has so many.
MARKS = 2


@lru_cache(maxsize=1)
def grammar() -> Wfst:
    """negation o reported speech o target o scorer over CLASSES."""

    weight = {"I": 0.4, "S": 0.8, "V": 1.6, "A": 1.6, "i": 0.0, "s": 0.0, "r": 0.1, "O": 0.0}

    def negation(left: int, x: str):
        if x == "N":
            return "O", 0.0, SCOPE
        return (x.lower() if left and x in "ISV" else x), 0.0, max(0, left - 1)

    def reported(state: tuple[bool, bool], x: str):
        after, quoted = state
        if x == "Q":
            return "O", 0.0, (after, not quoted)
        if x == "R":
            return "O", 0.0, (True, quoted)
        return ("r" if (after or quoted) and x in "ISVis" else x), 0.0, state

    def target(state: tuple[bool, bool, bool], x: str):
        seen, insult, threatened = state  # a target; the weightiest insult not yet aimed, "" if none; a threat verb
        if x == "T":
            # What the insult weighed where it stood is made up to the weight of an aimed one.
            y, w = ("V", 0.0) if threatened else ("A", -weight[insult]) if insult else ("O", 0.0)
            return y, w, (True, "" if y == "A" else insult, False)
        if x == "V":
            return "O", 0.0, (seen, insult, True)
        if x in "IS":
            return ("A", 0.0, state) if seen else (x, 0.0, (seen, max(x, insult), threatened))
        return ("O" if x == "v" else x), 0.0, state


    def score(state: int, x: str):
        return x, weight[x], state

    machine = compose(build(CLASSES, 0, negation), build(_LABELS, (False, False), reported))
    machine = compose(machine, build(_LABELS, (False, "", False), target))
    return compose(machine, build("OISVAisr", 0, score))


class Lexicon:
    """The word lists' hashes with the class of each, and what was learned: hashes without their lowest 4 bits of whole
    words, and of word beginnings by length, all of class S."""

    def __init__(self, words: list[int] = (), prefixes: dict[int, list[int]] | None = None):
        listed = {}
        for given, label in ((REPORTS, "R"), (NEGATIONS, "N"), (TARGETS, "T"), (THREATS, "V"), (INSULTS, "I")):
            listed |= {tk.hash_word(w): label for w in given}
        self.hash = np.array(sorted(listed), dtype=np.uint64)
        self.code = np.array([CLASSES.index(listed[int(h)]) for h in self.hash], dtype=np.uint8)
        self.words = np.array(sorted(words), dtype=np.uint64)
        self.prefix = {n: np.array(sorted(x & ~15 for x in hs), dtype=np.uint64) for n, hs in (prefixes or {}).items() if hs}

    def classify(self, c: tk.Codes, t: tk.Tokens) -> np.ndarray:
        """The class code of each token."""
        strong = CLASSES.index("S")
        code = np.zeros(len(t.hash), dtype=np.uint8)
        at = np.searchsorted(self.hash, t.hash)
        at[at == len(self.hash)] = 0
        hit = self.hash[at] == t.hash
        code[hit] = self.code[at[hit]]
        code[_among(t.hash & ~_KIND, self.words)] = strong
        for n, known in self.prefix.items():
            which, h = prefix_hashes(c, t, n)
            code[which[_among(h & ~_KIND, known)]] = strong
        return code


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if len(known) == 0:
        return np.zeros(len(h), dtype=bool)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h


def prefix_hashes(c: tk.Codes, t: tk.Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each token of n letters or more, the hash that its first n letters have as a word)."""
    lower, _ = tk.tables()
    which = np.flatnonzero(t.end - t.start >= n)
    start = t.start[which]
    h = np.zeros(len(which), dtype=np.uint64)
    p = tk.powers(n)
    with np.errstate(over="ignore"):
        for j in range(n):
            h += (lower[c.cp[start + j]].astype(np.uint64) + np.uint64(1)) * p[j]
        return which, tk.mix(h)


_ENDS = np.array([ord(x) for x in ".!?;\n\r"], dtype=np.uint32)
_QUOTES = np.array([ord(x) for x in "\"“”«»„"], dtype=np.uint32)


def _is_any(cp: np.ndarray, few: np.ndarray) -> np.ndarray:
    hit = cp == few[0]
    for x in few[1:]:
        hit |= cp == x
    return hit


def score_chunk(c: tk.Codes, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(score, number of matched clauses) of each document of a chunk."""
    n = len(c.at) - 1
    score, matched = np.zeros(n), np.zeros(n, dtype=np.int64)
    t = tk.tokenize(c)
    code = lexicon.classify(c, t)
    loaded = np.flatnonzero((code >= 1) & (code <= 3))
    if not len(loaded):
        return score, matched
    owner = np.searchsorted(t.at, loaded, side="right") - 1
    known: dict[bytes, float] = {}
    for i in np.unique(owner):
        a, b = t.at[i], t.at[i + 1]
        start, end, own = t.start[a:b] - c.at[i], t.end[a:b] - c.at[i], code[a:b]
        cp = c.cp[c.at[i] : c.at[i + 1]]
        clause = np.searchsorted(np.flatnonzero(_is_any(cp, _ENDS)), start)
        quotes = np.flatnonzero(_is_any(cp, _QUOTES))
        lines = np.flatnonzero(cp == 10) if len(quotes) else quotes
        for k in np.unique(clause[(own >= 1) & (own <= 3)]):
            lo, hi = np.searchsorted(clause, k), np.searchsorted(clause, k, side="right")
            if len(quotes):
                total = grammar().run(_with_quotes(own[lo:hi], start[lo:hi], quotes, lines))[0]
            else:
                key = own[lo:hi].tobytes()
                total = known.get(key)
                if total is None:
                    total = known[key] = grammar().run([CLASSES[x] for x in key])[0]
            if total > 0:
                score[i] += total
                matched[i] += 1
    return score, matched


def _with_quotes(codes: np.ndarray, start: np.ndarray, quotes: np.ndarray, lines: np.ndarray) -> list[str]:
    """The labels of a clause with its quotation marks; one comes first if a quotation of the same line is still open."""
    before = np.searchsorted(lines, start[0])
    line = np.searchsorted(quotes, lines[before - 1]) if before else 0
    done = np.searchsorted(quotes, start[0])
    labels = ["Q"] * ((done - line) % 2)
    for x, m in zip(codes, np.searchsorted(quotes, start)):
        labels += ["Q"] * int(m - done)
        done = m
        labels.append(CLASSES[x])
    return labels


def scorer(lexicon: Lexicon):
    """A column function: text -> struct<score double, clauses bigint>."""
    kind = pa.struct([("score", pa.float64()), ("clauses", pa.int64())])

    def run(text: pa.Array) -> pa.Array:
        parts = [score_chunk(c, lexicon) for c in tk.chunks(text)]
        if not parts:
            return pa.array([], type=kind)
        score = np.concatenate([p[0] for p in parts]).round(6)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(np.concatenate([p[1] for p in parts]))], fields=list(kind))

    return F.arrow_udf(run, "struct<score: double, clauses: bigint>")


# -- fitting


def _occurrences(c: tk.Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in the chunk, token, feature) of each token's features. A feature's lowest 4 bits tell its kind: 0 for
    the whole word, else how many letters it begins with."""
    t = tk.tokenize(c)
    tokens, feats = [np.arange(len(t.hash))], [t.hash & ~_KIND]
    for n in PREFIXES:
        which, h = prefix_hashes(c, t, n)
        tokens.append(which)
        feats.append((h & ~_KIND) | np.uint64(n))
    token = np.concatenate(tokens)
    return np.repeat(np.arange(len(c.at) - 1), np.diff(t.at))[token], token, np.concatenate(feats)


def _features(c: tk.Codes) -> tuple[np.ndarray, np.ndarray]:
    """(document in the chunk, feature) for each distinct feature of each document."""
    d, _, f = _occurrences(c)
    order = np.lexsort((f, d))
    d, f = d[order], f[order]
    keep = np.ones(len(d), dtype=bool)
    keep[1:] = (d[1:] != d[:-1]) | (f[1:] != f[:-1])
    return d[keep], f[keep]


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """(text, toxic) of the sample, stashed."""
    per_doc = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    n = {bool(r["__toxic"]): r["n"] for r in per_doc.groupBy((F.col("__toxic") > 0).alias("__toxic")).agg(F.count("*").alias("n")).collect()}
    mille = 1_000_000
    share = {k: min(mille, -(-most * mille // max(1, n.get(k, 0)))) for k, most in ((True, MAX_TOXIC), (False, MAX_CLEAN))}
    draw = F.pmod(F.xxhash64("__id"), F.lit(mille))
    chosen = per_doc.where(draw < F.when(F.col("__toxic") > 0, share[True]).otherwise(share[False]))
    # The sample is bounded by the two parameters (16 bytes a row), whatever the size of labels.
    text = docs.select(docs["doc_id"].cast("long").alias("__id"), docs["text"].cast("string").alias("__text")).where("__text IS NOT NULL")
    joined = text.join(F.broadcast(chosen), "__id").select("__text", (F.col("__toxic") > 0).alias("__toxic"))
    kept = stash(joined, "toxicity-labelled")
    counts = {r["__toxic"]: r["n"] for r in kept.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    return kept, counts.get(True, 0), counts.get(False, 0)


def _count(sample: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(feature, n): documents that have it; only: the features counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(0)):
                _, f = _features(c)
                if only is not None:
                    f = f[_among(f, only)]
                f, n = np.unique(f, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(f)), pa.array(n.astype(np.int64))], names=["feature", "n"])

    return sample.select("__text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _collect(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    f = table["feature"].to_numpy().view(np.uint64)
    order = np.argsort(f)
    return f[order], table["n"].to_numpy()[order]


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of the word lists and of what the labels teach; of the lists alone without a toxic or a clean label."""
    sample, n_toxic, n_clean = _labelled(docs, labels)
    if not n_toxic or not n_clean:
        return Lexicon()
    toxic = sample.where("__toxic")
    known, t = _collect(_count(toxic).where(F.col("n") >= MIN_GAIN))  # bounded by the sample
    f, seen = _collect(_count(sample.where("NOT __toxic"), known))
    clean = np.zeros(len(known), dtype=np.int64)
    clean[np.searchsorted(known, f)] = seen
    odds = ((t + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1))
    good = known[odds >= MIN_ODDS]
    if not len(good):
        return Lexicon()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(0)):
                d, token, f = _occurrences(c)
                hit = _among(f, good)
                d, token, f = d[hit], token[hit], np.searchsorted(good, f[hit])
                for i in np.unique(d):
                    own = d == i
                    yield pa.RecordBatch.from_arrays([pa.array([token[own]], pa.list_(pa.int64())), pa.array([f[own]], pa.list_(pa.int32()))], names=["token", "feature"])

    rows = toxic.select("__text").mapInArrow(members, "token array<long>, feature array<int>").toArrow()  # bounded by the sample
    return _choose(good, odds[odds >= MIN_ODDS], [(t.values.to_numpy(), f.values.to_numpy()) for t, f in zip(rows["token"], rows["feature"])])


def _choose(good: np.ndarray, odds: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> Lexicon:
    """The listed insults among the features, and by greedy covering others until MARKS words of each row are marked.

    rows: (token, feature) of a row's occurrences. A feature gains the rows that lack marks and have it on a word that is
    not yet marked; at equal gain the longer beginning wins, then the better odds.
    """
    if not rows:
        return Lexicon()
    row = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    token, feature = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (0, 1))
    _, word = np.unique(np.stack([row, token]), axis=1, return_inverse=True)  # occurrences of words, numbered
    owner = np.zeros(word.max() + 1, dtype=np.int64)
    owner[word] = row
    length = np.where((good & _KIND) == 0, 9, good & _KIND).astype(int)
    marked = np.zeros(len(owner), dtype=bool)
    chosen: list[int] = []

    def choose(j: int) -> None:
        chosen.append(j)
        marked[word[feature == j]] = True

    listed = np.array(sorted(tk.hash_word(w) & ~15 for w in INSULTS), dtype=np.uint64)
    for j in np.flatnonzero(_among(good, listed) & ((good & _KIND) == 0)):
        choose(int(j))
    while True:
        lacking = np.bincount(owner[marked], minlength=len(rows)) < MARKS
        alive = lacking[row] & ~marked[word]
        pairs = np.unique(feature[alive] * len(rows) + row[alive])
        gain = np.bincount(pairs // len(rows), minlength=len(good))
        best = max(range(len(good)), key=lambda j: (gain[j], length[j], odds[j], -int(good[j])))
        if gain[best] < MIN_GAIN:
            break
        choose(best)
    kinds = {n: [int(good[j]) for j in chosen if int(good[j] & _KIND) == n] for n in (0, *PREFIXES)}
    return Lexicon(kinds.pop(0), kinds)


# -- operators


def toxic_documents(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """One row (doc_id, score, clauses) for each document that scores at least `reject`.

    Null and empty texts score 0. Repeated rows are scored each. Labels with a null doc_id or a null class are passed
    over; one document's contradicting labels count as toxic. Without labels, or with one class only, the word lists
    alone decide. Columns other than doc_id and text are not read.
    """
    s = scorer(fit(docs, labels))
    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), s(docs["text"].cast("string")).alias("__s"))
    return scored.select("doc_id", "__s.score", "__s.clauses").where(F.col("score") >= reject)


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """docs, all columns, without the rows that toxic_documents() would list. Null and empty texts stay, repeated rows go or
    stay together, an empty table stays empty."""
    s = scorer(fit(docs, labels))
    return docs.where(s(docs["text"].cast("string"))["score"] < reject)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
