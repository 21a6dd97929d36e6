"""BPE encoding and decoding for vocabularies with word ends, long texts by tree concatenation.

A text of more than LONG characters is turned into the vocabulary's symbols:
its normalised words letter by letter, each last letter marked.  The symbols
are cut in halves until a leaf holds at most LEAF, anywhere, within words too;
leaves are encoded in parallel, and neighbours joined pairwise up the tree.

At a join the tokens on both sides are encoded anew in a window that grows
until its first token is the one the left side has there and its last one the
right side's.  A list of tokens is the vocabulary's encoding if each pair of
neighbours is; pairs within the window are, and those at its edges were found
so by a side.  So the joined tokens are those of the whole.

Shorter texts are encoded word by word, each distinct word once per batch:
white space is dropped, so no token goes over a blank or a line end.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import Recent, cut, in_rows, partitions, text_of
from tickloom.llm.token_files import _LETTER, merges
from tickloom.llm.wordlists import ids_of, in_bytes, lists, runs, split

LONG = 16_384
LEAF = 8_192
WINDOW = 4
STORED_WORDS = 150_000
# Leaves a worker encodes at a time.
LEAVES = 256
RUN_IDS = 1 << 20
SUFFIX = "</w>"
# Marks the last letter of a word in a string of symbols; letters stand for bytes and never are a blank.
STOP = " "
# Added tokens are symbols of their own from here on.
ADDED = 0xE000
# Up to here letters are letters in every edition of Unicode, and lower case is one letter.
_PLAIN = "Ā"


def _joined(strings: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Large strings one after the other in UTF-8, and where each begins and ends."""
    _, offsets, data = strings.buffers()
    return memoryview(data or b""), np.frombuffer(offsets, "<i8", len(strings) + 1, 8 * strings.offset)


def _letters(word: str) -> str:
    """The letters that stand for a word's bytes; ASCII letters are their own."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTER)


class Words:
    """A vocabulary: ids of words, of strings of symbols, and the texts of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        model = json.loads(tokenizer.to_str())["model"]
        joins = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if model["end_of_word_suffix"] != SUFFIX or tokenizer.decoder is not None:
            raise ValueError("not a vocabulary with word ends and no decoder")
        if any((a + b).endswith(SUFFIX) and not b.endswith(SUFFIX) or a.endswith(SUFFIX) for a, b in joins):
            raise ValueError("a merge makes or passes a word's end")
        self.last = tokenizer.model.tokenize  # of words that end
        self.inner = BPE(vocab=model["vocab"], merges=joins).tokenize  # of letters before a word's end
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.names = {name: chr(ADDED + k) for k, name in enumerate(added)}
        self.signs = {chr(ADDED + k): i for k, i in enumerate(added.values())}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        strings = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        self.shown = [s[: -len(SUFFIX)] + STOP if s.endswith(SUFFIX) else s for s in strings]
        for name, sign in self.names.items():
            self.shown[self.signs[sign]] = sign + STOP
        self.strings = pa.array([s + " " for s in strings], pa.large_string())
        self.agenda, _ = merges(tokenizer)
        # Symbols of the letters that stand for bytes, before and at a word's end.
        self.letter, self.ending = (np.full(max(map(ord, _LETTER.values())) + 1, -1, np.int32) for _ in range(2))
        for x in _LETTER.values():
            self.letter[ord(x)], self.ending[ord(x)] = model["vocab"][x], model["vocab"][x + SUFFIX]
        self.pieces = Recent(self.piece, STORED_WORDS // 2, make_many=self.new_pieces)
        self.words = Recent(self.word, STORED_WORDS, make_many=self.new_words)
        self.shapes = Recent(self.word_symbols, STORED_WORDS // 4)
        self.stops = {c: self.piece(c) for c in ".,"}

    def piece(self, letters: str) -> bytes:
        """The ids of a word that ends, given as letters for its bytes."""
        found = [self.signs[letters]] if letters in self.signs else [t.id for t in self.last(letters)]
        return np.array(found, "<i4").tobytes()

    def new_pieces(self, found: list[str]) -> list[bytes]:
        """The ids of words that end, given as letters for their bytes, side by side."""
        points = np.frombuffer("".join(found).encode("utf-16-le"), "<u2")
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        symbols, last = np.where(points < len(self.letter), self.letter[np.minimum(points, len(self.letter) - 1)], -1), np.cumsum(lengths) - 1
        last = last[lengths > 0]
        symbols[last] = np.where(symbols[last] >= 0, self.ending[np.minimum(points[last], len(self.letter) - 1)], -1)
        return [self.piece(p) if x is None else x for p, x in zip(found, self.agenda.words(symbols, lengths))]

    def new_words(self, found: list[str]) -> list[bytes]:
        """The ids of what stands between blanks, for many at once."""
        stops = [self.stops.get(w[-1:], b"") for w in found]
        bodies = [w[:-1] if s else w for w, s in zip(found, stops)]
        letters = [_letters(w.lower()) if w.isalpha() and (w.isascii() or max(w) < _PLAIN) else None for w in bodies]
        distinct = list(dict.fromkeys(letters))
        if None in letters:
            distinct.remove(None)
        ids = dict(zip(distinct, self.pieces.many(distinct)))
        return [self.word(w) if p is None else ids[p] + s for w, p, s in zip(found, letters, stops)]

    def word(self, word: str) -> bytes:
        """The ids of what stands between blanks."""
        body = word[:-1] if word[-1:] in self.stops else word
        if body.isalpha() and max(body) < _PLAIN:
            ids = self.pieces[_letters(body.lower())]
            return ids if body is word else ids + self.stops[word[-1]]
        return self.ids(self.symbols(word)).astype("<i4").tobytes()

    def word_symbols(self, word: str) -> str:
        """The symbols of what stands between blanks."""
        body = word[:-1] if word[-1:] in self.stops else word
        if body.isalpha() and max(body) < _PLAIN:
            letters = _letters(body.lower()) + STOP
            return letters if body is word else letters + word[-1] + STOP
        return self.symbols(word)

    def all_symbols(self, texts: pa.Array) -> list[str]:
        """The symbols of texts, each distinct word turned into them once."""
        found, bounds = split(pc.replace_substring(texts, "\n", " "))
        coded = found.dictionary_encode()
        known = pa.array(list(map(self.shapes.__getitem__, coded.dictionary.to_pylist())), pa.large_string())
        data, ends = _joined(known.take(coded.indices))
        return [str(data[ends[a] : ends[b]], "utf-8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def symbols(self, text: str) -> str:
        """The words of a text, normalised, as letters for their bytes, each with its end marked."""
        split_, normal = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.normalizer.normalize_str
        out: list[str] = []
        for part in self.added.split(text) if self.added else [text]:
            if part in self.names:
                out += [self.names[part], STOP]
            elif part:
                for letters, _ in split_(normal(part)):
                    out += [letters, STOP]
        return "".join(out)

    def all_ids(self, leaves: list[str]) -> list[np.ndarray]:
        """The ids of strings of symbols, their distinct words looked up at once."""
        distinct = list(dict.fromkeys(w for s in leaves for w in s.split(STOP)[:-1]))
        known = dict(zip(distinct, self.pieces.many(distinct)))
        return [self.ids(s, known) for s in leaves]

    def ids(self, symbols: str, known: dict[str, bytes] | None = None) -> np.ndarray:
        """The ids of a string of symbols; behind its last mark the word goes on.  ``known`` has the ids of its words."""
        *ended, rest = symbols.split(STOP)
        found = np.frombuffer(b"".join(map((known or self.pieces).__getitem__, ended)), "<i4")
        return np.append(found, np.array([t.id for t in self.inner(rest)], np.int32)) if rest else found

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of the symbols of ``a`` followed by those of ``b``."""
        width = WINDOW
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            found = self.ids("".join([self.shown[t] for t in (*a[i:].tolist(), *b[:j].tolist())]))
            left = not i or found[0] == a[i]
            right = j == len(b) or found[-1] == b[j - 1]
            if left and right:
                return np.concatenate((a[:i], found, b[j:]))
            width *= 2

    def tree(self, leaves: list[np.ndarray]) -> np.ndarray:
        """The ids of leaves that follow one another."""
        while len(leaves) > 1:
            pairs = [self.join(*leaves[k : k + 2]) for k in range(0, len(leaves) - 1, 2)]
            leaves = pairs + leaves[2 * len(pairs) :]
        return leaves[0] if leaves else np.empty(0, np.int32)

    def texts(self, flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The text of each run of ids, in UTF-8: the vocabulary's tokens with a blank between them."""
        data, ends = _joined(self.strings.take(pa.array(flat)))
        return [bytes(data[ends[p] : max(ends[p], ends[q] - 1)]) for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def halves(symbols: str, leaf: int) -> list[str]:
    """``symbols`` cut in two until no part has more than ``leaf``, a mark staying with its letter; parts of even size, in order."""
    if len(symbols) <= max(2, leaf):
        return [symbols]
    at = len(symbols) // 2
    at += symbols[at] == STOP
    return halves(symbols[:at], leaf) + halves(symbols[at:], leaf)


_loaded: dict[str, Words] = {}


def words(path: str) -> Words:
    """The vocabulary at ``path``, loaded once per worker."""
    if path not in _loaded:
        # One thread per task: Spark runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Words(path)
    return _loaded[path]


# What comes of ids: columns, and the Arrow columns made of a vocabulary and the ids of texts that follow one another.
Made = tuple[str, Callable[[Words, np.ndarray, np.ndarray], list[pa.Array]]]


def _ids(model: Words, flat: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    return [lists(flat, bounds)]


def _digests(model: Words, flat: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    flat, bounds = flat[bounds[0] : bounds[-1]], bounds - bounds[0]
    data = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
    of_ids = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    of_texts = [hashlib.sha256(t).hexdigest() for t in model.texts(flat, bounds)]
    return [pa.array(np.diff(bounds)), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]


IDS: Made = ("ids array<int>", _ids)
DIGESTS: Made = ("n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests)


def _by_words(vocabulary: str, made: Made) -> Callable:
    names = ["doc_id", *[c.split()[0] for c in made[0].split(", ")]]

    def run(batches):
        model = words(vocabulary)
        for batch in in_bytes(batches, 1):
            found, bounds = split(pc.replace_substring(batch.column(1), "\n", " "))
            flat, ends = ids_of(found, model.words.many)
            bounds = ends[bounds]
            for a, b in runs(bounds, RUN_IDS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made[1](model, flat, bounds[a : b + 1])], names=names)

    return run


def _by_tree(rows: DataFrame, vocabulary: str, leaf: int, made: Made) -> DataFrame:
    names = ["doc_id", *[c.split()[0] for c in made[0].split(", ")]]

    def leaves(batches):
        model = words(vocabulary)
        for batch in in_bytes(batches, 2):
            for row, doc_id, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), model.all_symbols(batch.column(2))):
                parts = halves(symbols, leaf)
                columns = [pa.array([row] * len(parts), pa.int64()), pa.array([doc_id] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "at", "symbols"])

    def encoded(batches):
        model = words(vocabulary)
        for part in in_rows(batches, LEAVES):
            ids = model.all_ids(part.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=["row", "doc_id", "at", "ids"])

    def joined(table):
        by, model = table.sort_by("at"), words(vocabulary)
        ids = model.tree([x.values.to_numpy() for x in by.column("ids")])
        return pa.Table.from_arrays([by.column("doc_id").slice(0, 1), *made[1](model, ids, np.array([0, len(ids)]))], names=names)

    # The numbers of rows and the leaves are kept, so a lost task encodes the same leaves again.
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    kept = cut(numbered.mapInArrow(leaves, "row bigint, doc_id bigint, at int, symbols string"))
    coded = kept.repartition(partitions(rows.sparkSession), "row", "at").mapInArrow(encoded, "row bigint, doc_id bigint, at int, ids array<int>")
    return coded.groupBy("row").applyInArrow(joined, f"doc_id bigint, {made[0]}")


def encode(docs: DataFrame, vocabulary: str, long: int = LONG, leaf: int = LEAF, made: Made = IDS) -> DataFrame:
    """doc_id and ids of every document, as the vocabulary's library gives them without special tokens.

    Null texts count as empty and have no ids.  Texts go through whole, those
    of more than ``long`` characters as leaves of at most ``leaf`` symbols.
    Repeated and null doc_ids are documents of their own; an empty table
    gives no rows; other columns are ignored.  ``made`` gives other columns
    in place of the ids, made where these are.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    short = rows.filter(F.length("text") <= long).mapInArrow(_by_words(vocabulary, made), f"doc_id bigint, {made[0]}")
    return short.unionByName(_by_tree(rows.filter(F.length("text") > long), vocabulary, leaf, made))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids, as little-endian 32-bit integers, and of the text they decode to."""
    return encode(docs, vocabulary, made=DIGESTS)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and text of encoded documents; null ids have an empty text."""

    def run(batches):
        model = words(vocabulary)
        for batch in in_rows(batches, 500):
            ids = batch.column(1).fill_null([])
            bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy()))).astype(np.int64)
            texts = [t.decode() for t in model.texts(ids.flatten().to_numpy(), bounds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")
