"""Toxicity scores of texts restored by a noisy-channel decoder.

Obfuscated words (leetspeak, spaced letters, repeated letters) are lattices of
the letters each sign may stand for.  Viterbi decoding finds the reading that
is likeliest under a character trigram model, counted over all documents, and
the channel's costs.  Words as written and words restored then give evidence:
for a word and its beginnings, the lower confidence bound of the log-odds of
appearing in toxic documents.  A document's score is a logistic function of its
strongest evidence, fitted on evidence from folds that did not see it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import Recent, cut, held, in_rows, release, text_of
from tickloom.llm.wordlists import in_bytes, split

# Bound of what is learned from: labelled rows, which bounds the terms of evidence too.  More terms than
# MOST_TERMS are refused, never left out.
LABELLED_ROWS, MOST_TERMS = 10_000, 1_000_000
HELD_OUT_PARTS, CONFIDENCE = 5, 1.5
PREFIXES = (3, 4, 5, 6)

# The letters of the model, and the letters a sign may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüÿß"
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
# Costs in nats: reading a sign as a letter, as a gap, leaving out a repeated letter, closing a gap.
AS_LETTER, AS_GAP, REPEATED, CLOSED = 1.0, 4.0, 1.0, 0.5
KINDS = len(LETTERS) + 1
TEXTS_AT_ONCE = 500
# Tokens a worker keeps the evidence of.
STORED_TOKENS = 250_000
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}

_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[^\w@$!|+€£]+")
_ODD_END = re.compile(r"^[^\w@$!|+€£]+|([^\w\s])\1{2,}$|[^\w@$!|+€£]+$|!+$")
_SIGN = re.compile(r"[\d@$!|+€£]")
_TWICE = re.compile(r"([^\W\d_])\1")
_STOPS = frozenset(".,;:")
_KNOWN = re.compile(f"[{LETTERS}]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+€£])(?:[\s.\-_*]{1,2}(?:[^\W_]|[@$!|+€£])){2,}(?![^\W_])")


def _table() -> np.ndarray:
    classes = np.zeros(0x200, np.uint8)
    for c, k in CLASS.items():
        classes[ord(c)] = k
    return classes


def character_counts(docs: DataFrame) -> DataFrame:
    """(code, n): how often each run of three character classes occurs in all texts; class 0 is all that is no letter."""

    def run(batches):
        classes, total = _table(), np.zeros(KINDS**3, np.int64)
        for batch in in_rows(batches, TEXTS_AT_ONCE):
            joined = f" {'  '.join(batch.column(0).to_pylist()).lower()} "
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
            k = classes[np.minimum(points, len(classes) - 1)].astype(np.int32)
            total += np.bincount((k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["code", "n"])

    found = docs.select(text_of().alias("text")).mapInArrow(run, "code int, n bigint")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of a class after two others, smoothed by that after one."""
    two = counts.sum(axis=0)
    after_one = (two + 1.0) / (two.sum(axis=1, keepdims=True) + KINDS)
    return np.log((counts + 5.0 * after_one[None, :, :]) / (counts.sum(axis=2, keepdims=True) + 5.0)).astype(np.float32)


_flat: list = [None, []]


def _listed(model: np.ndarray) -> list[float]:
    """The model as a list, which is read faster one by one; kept for the last model."""
    if _flat[0] is not model:
        _flat[:] = model, model.ravel().tolist()
    return _flat[1]


def restore(signs: str, model: np.ndarray) -> str:
    """The likeliest reading of a run of signs: letters, with blanks at its gaps.

    The decoding is exact: a state is the last two classes, and as no sign has
    more than four readings, there are never more than some twenty states.
    """
    listed = _listed(model)
    beam = {0: (0.0, "")}
    before = ""
    for sign in signs.lower():
        options = []
        if sign != before and sign in CLASS:
            before, c, new = sign, CLASS[sign], {}
            for state, (score, read) in beam.items():
                to, value = state % KINDS * KINDS + c, score + listed[state * KINDS + c]
                if to not in new or value > new[to][0]:
                    new[to] = (value, read + sign)
            beam = new
            continue
        if sign in CLASS:
            options.append((sign, 0.0))
        elif sign in LEET:
            options += [(c, AS_LETTER) for c in LEET[sign]] + [(" ", AS_GAP)]
        else:
            options += [("", CLOSED), (" ", 0.0)]
        if sign == before and (sign in CLASS or sign in LEET):
            options.append(("", REPEATED))
        before = sign
        new: dict[int, tuple[float, str]] = {}
        for state, (score, read) in beam.items():
            last = state % KINDS
            for letter, cost in options:
                if letter == "" or letter == " " and last == 0:
                    to, value, text = state, score - cost, read
                else:
                    c = CLASS.get(letter, 0)
                    to, value, text = last * KINDS + c, score - cost + listed[state * KINDS + c], read + letter
                if to not in new or value > new[to][0]:
                    new[to] = (value, text)
        beam = new
    return max((score + listed[state * KINDS], read) for state, (score, read) in beam.items())[1].strip()


def obfuscated(token: str) -> list[str]:
    """The parts of a token that may hide a word: all with a sign or a doubled letter, whatever else they hold; signs at the end read and left out."""
    parts = [p for form in {token, _ODD_END.sub("", token)} for p in _PART.split(form)]
    return [p for p in dict.fromkeys(parts) if _SIGN.search(p) or _TWICE.search(p)]


def plain(token: str) -> str | None:
    """The one word of a token of letters, none doubled, with a stop behind it at most; None for other tokens."""
    body = token[:-1] if token[-1:] in _STOPS else token
    return body if body.isalpha() and not _TWICE.search(body) else None


def words(token: str, model: np.ndarray) -> set[str]:
    """The words of a token as written and as restored, in lower case."""
    token = token.lower()
    if (word := plain(token)) is not None:
        return {word}
    found = set(_WORD.findall(token))
    for part in obfuscated(token):
        found.update(_WORD.findall(restore(part, model)))
    return found


def spaced(text: str, model: np.ndarray) -> set[str]:
    """The words that runs of three or more single signs hide, bounded by white space or punctuation; an exclamation mark at the end read and left out."""
    found: set[str] = set()
    for m in _SPACED.finditer(text):
        for run in {m[0], m[0].rstrip("! ")}:
            found.update(_WORD.findall(restore(run, model)))
    return found


def terms(word: str) -> list[str]:
    """A word as a whole, and its beginnings."""
    return ["=" + word, *[word[:k] for k in PREFIXES if len(word) > k]]


def beginnings(word: str) -> set[str]:
    """All that a word of the model's letters can begin with once restored: three letters, doubled ones left out or not."""
    found, before = {""}, ""
    for letter in word:
        grown = {f if len(f) == PREFIXES[0] else f + letter for f in found}
        found = found | grown if letter == before else grown
        before = letter
        if all(len(f) == PREFIXES[0] for f in found):
            break
    return found


class Scorer:
    """Evidence of texts under one or several tables of weights; what tokens give is kept for those met lately."""

    def __init__(self, model: np.ndarray, weights: dict[str, tuple[float, ...]], tables: int):
        self.model, self.weights, self.none = model, weights, (0.0,) * tables
        # A word can only give evidence if some term begins as it does.
        self.starts = {t.removeprefix("=")[: PREFIXES[0]] for t in weights}
        self.tokens = Recent(self.token, STORED_TOKENS)

    def token(self, token: str) -> tuple[float, ...]:
        low = token.lower()
        body = low[:-1] if low[-1:] in _STOPS else low
        if body.isalpha():
            # Only doubled letters can be read in two ways.
            if not _TWICE.search(body):
                return self._most(terms(body)) if body[: PREFIXES[0]] in self.starts else self.none
            if _KNOWN.fullmatch(body) and self.starts.isdisjoint(beginnings(body)):
                return self.none
        return self._most([t for part in token.split() for w in words(part, self.model) for t in terms(w)])

    def _most(self, found: list[str]) -> tuple[float, ...]:
        rows = [self.weights[t] for t in found if t in self.weights]
        return tuple(map(max, zip(self.none, *rows))) if rows else self.none

    def spaced(self, text: str) -> tuple[float, ...]:
        return self._most([t for w in spaced(text, self.model) for t in terms(w)])

    def evidence(self, text: str) -> tuple[float, ...]:
        return tuple(map(max, zip(self.spaced(text), self.none, *map(self.tokens.__getitem__, set(text.split())))))

    def all_evidence(self, texts: pa.Array) -> np.ndarray:
        """The evidence of texts under the first table; each distinct token of the batch is looked up once."""
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        found, bounds = split(texts)
        coded = found.dictionary_encode()
        each = np.fromiter((row[0] for row in map(self.tokens.__getitem__, coded.dictionary.to_pylist())), np.float64, len(coded.dictionary))
        most = np.maximum.reduceat(each[coded.indices.to_numpy()], bounds[:-1])
        return np.maximum(most, [self.spaced(t)[0] for t in texts.to_pylist()])


def part_of(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; 0 is held out of all learning."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT_PARTS))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(part, toxic, text) of at most ``rows`` labelled documents outside the held-out part, chosen by a hash of their id.

    Rows without a label are left out; an id that several rows label is toxic if one says so.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("part", part_of(F.col("doc_id"))).filter("part <> 0")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    # At most LABELLED_ROWS rows of three numbers.
    return cut(texts.join(F.broadcast(cut(chosen)), "doc_id").select("part", "toxic", "text"))


def term_counts(sample: DataFrame, model: np.ndarray) -> DataFrame:
    """Per term the number of documents it occurs in, by part and label."""
    columns = [f"n{part}_{toxic}" for part in range(1, HELD_OUT_PARTS) for toxic in (0, 1)]

    def run(batches):
        known = Recent(lambda token: words(token, model), STORED_TOKENS // 4)
        for batch in batches:
            counts: Counter = Counter()
            for part, toxic, text in zip(*[c.to_pylist() for c in batch.columns]):
                found = set().union(*map(known.__getitem__, set(text.split())), spaced(text, model))
                where = 2 * (part - 1) + toxic
                counts.update((t, where) for t in {t for w in found for t in terms(w)})
            keys = list(counts)
            arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "place", "n"])

    found = sample.select("part", "toxic", "text").mapInArrow(run, "term string, place int, n bigint")
    sums = [F.coalesce(F.sum(F.when(F.col("place") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(columns)]
    return found.groupBy("term").agg(*sums)


def _bound(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    odds = F.log((toxic + 0.5) / (all_toxic + 1.0)) - F.log((clean + 0.5) / (all_clean + 1.0))
    return odds - CONFIDENCE * F.sqrt(1.0 / (toxic + 0.5) + 1.0 / (clean + 0.5))


def fit_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic intercept and slope, by Newton's steps with a small ridge."""
    x = np.stack([np.ones(len(evidence)), evidence], axis=1)
    at, ridge = np.zeros(2), np.array([1e-6, 1e-2])
    for _ in range(200):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (toxic - p) - ridge * at)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> dict:
    """Learn the character model from all of ``docs`` and the evidence from the labelled ones outside the held-out part.

    What comes to the driver is bounded: the character counts by the alphabet,
    the terms by what the labelled rows hold (and MOST_TERMS), the evidence by ``rows``.  Without labelled documents
    of both kinds, every score is below a half.
    """
    counts = np.zeros(KINDS**3)
    for r in character_counts(docs).collect():
        counts[r.code] = r.n
    model = character_model(counts.reshape(KINDS, KINDS, KINDS))
    sample = labelled(docs, labels, rows)
    sizes = {(r.part, r.toxic): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    nothing = {"id": uuid.uuid4().hex, "model": model, "weights": {}, "curve": (-3.0, 1.0)}
    parts = range(1, HELD_OUT_PARTS)
    if not sum(n for (_, toxic), n in sizes.items() if toxic) or not sum(n for (_, toxic), n in sizes.items() if not toxic):
        return nothing
    bounds = []
    for left_out in (0, *parts):  # table 0 leaves nothing out
        seen = [p for p in parts if p != left_out]
        columns = [sum((F.col(f"n{p}_{t}") for p in seen), F.lit(0)) for t in (0, 1)]
        bounds.append(_bound(columns[1], columns[0], *[sum(sizes.get((p, t), 0) for p in seen) for t in (1, 0)]))
    often = sum((F.col(f"n{p}_1") for p in parts), F.lit(0)) >= 2
    table = term_counts(sample, model).filter(often).select("term", *[b.alias(f"w{i}") for i, b in enumerate(bounds)])
    top = table.filter("w0 > 0.5").limit(MOST_TERMS + 1).collect()
    if len(top) > MOST_TERMS:
        raise ValueError("the labelled rows hold too many terms; give fewer rows")
    tables = len(bounds)
    weights = {r.term: tuple(max(0.0, r[f"w{i}"]) for i in range(tables)) for r in top}

    def run(batches):
        scorer = Scorer(model, weights, tables)
        for batch in batches:
            rows_ = zip(*[c.to_pylist() for c in batch.columns])
            out = [(scorer.evidence(text)[part], toxic) for part, toxic, text in rows_]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int32())], names=["e", "toxic"])

    seen = sample.select("part", "toxic", "text").mapInArrow(run, "e double, toxic int").collect()
    curve = fit_curve(np.array([r.e for r in seen]), np.array([r.toxic for r in seen], float))
    return nothing | {"weights": {t: w[:1] for t, w in weights.items()}, "curve": curve}


def _scores(fitted: dict, texts: list[str] | pa.Array) -> np.ndarray:
    """The scores of whole texts, none of them null."""
    if not len(texts):
        return np.empty(0)
    scorer = held(("toxicity", fitted["id"]), lambda: Scorer(fitted["model"], fitted["weights"], 1))
    start, slope = fitted["curve"]
    found = scorer.all_evidence(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    return 1.0 / (1.0 + np.exp(-np.clip(start + slope * found, -700, 700)))


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """doc_id, score and predicted of every document, from its whole text alone; null texts count as empty."""

    def run(batches):
        for batch in in_bytes(batches, 1):
            scores = _scores(fitted, batch.column(1))
            columns = [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])
        release()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")


def reject(docs: DataFrame, fitted: dict) -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns stay as they are."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in in_bytes(batches, at):
            yield batch.filter(pa.array(_scores(fitted, pc.fill_null(batch.column(at), "")) < 0.5))
        release()

    return docs.mapInArrow(run, docs.schema)
