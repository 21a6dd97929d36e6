"""SentencePiece encoding and decoding of merge-type vocabularies.

Encoding starts from single characters and keeps an agenda of adjacent pairs
whose joint piece is in the vocabulary.  The best-scored pair is joined, the
leftmost first among equals, and its new neighbours join the agenda, until it
is empty.  Characters that stay unknown become their bytes.  The new words of
a batch go side by side: one row of symbols and one of the agenda's costs per
word, a join in every row at a time.  Long and unusual words keep a heap each.

A blank is the piece character U+2581.  No piece of the vocabulary has it
behind another character (checked when it is loaded), so no pair is ever
joined across the start of a word: words are encoded apart, each once per
Arrow batch and kept for the next.  The sentencepiece library encodes the new
words of every batch, too, and must agree; it also decodes all ids of a batch
where texts are asked for.
"""

from __future__ import annotations

import codecs
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.agenda import Agenda
from tickloom.llm.common import Recent, held, release, text_of
from tickloom.llm.wordlists import ended, ids_of, in_bytes, lists, runs, split

BLANK = "▁"
STORED_WORDS, JOINED_WORDS = 250_000, 1000
RUN_IDS = 1 << 20
# Characters up to here have symbols, so that their words go side by side.
TABLED = 0x3000
# What the fast path leaves alone: blanks at the ends or side by side, and the blank's own character.
_ODD = re.compile(f"^ |  | $|{BLANK}")
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*")


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("tickloom_each_byte", _each_byte)


class Pieces:
    """A vocabulary: pieces that pairs may be joined to, with their scores, and the bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        self.bytes = [0] * 256
        shown = []
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                # Stands for the byte until the whole text is put together.
                shown.append(chr(value) if value < 0x80 else chr(0xDC00 + value))
            elif library.is_control(i) or library.is_unknown(i):
                shown.append("" if library.is_control(i) else " ⁇ ")
            else:
                self.ids[piece] = i
                self.cost[piece] = -library.get_score(i)
                shown.append(piece.replace(BLANK, " "))
                if BLANK in piece.lstrip(BLANK) or "\n" in piece:
                    raise ValueError("a piece joins words or lines; they can't be encoded apart")
        self.shown = np.array(shown, object)
        self._pairs(size)
        self.control = np.array([library.is_control(i) for i in range(size)])
        self.end = library.eos_id()
        self.words = Recent(self.word, STORED_WORDS, make_many=self.new_words)
        self.lines = Recent(lambda line: np.array(self.join(line), "<i4").tobytes(), STORED_WORDS // 4)
        self.fresh: list[tuple[str, bytes]] = []

    def join(self, word: str) -> list[int]:
        """The ids of a word that begins with its blanks, by the agenda."""
        cost, n = self.cost.get, len(word)
        # A symbol is a run of characters: where the one that begins here ends (0 once it was joined to the left),
        # and where the one that ends here begins.
        stop, begin = list(range(1, n + 1)), list(range(-1, n))
        agenda = [(c, i, i + 2) for i in range(n - 1) if (c := cost(word[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, end = heappop(agenda)
            middle = stop[i]
            if not middle or middle >= end or stop[middle] != end:
                continue  # a side was joined otherwise since
            stop[i], stop[middle], begin[end] = end, 0, i
            if end < n and (c := cost(word[i : stop[end]])) is not None:
                heappush(agenda, (c, i, stop[end]))
            if i and (c := cost(word[begin[i] : end])) is not None:
                heappush(agenda, (c, begin[i], end))
        out: list[int] = []
        i = 0
        while i < n:
            found = self.ids.get(word[i : stop[i]])
            out += [found] if found is not None else [self.bytes[b] for b in word[i : stop[i]].encode("utf-8", "surrogatepass")]
            i = stop[i]
        return out

    def _pairs(self, size: int) -> None:
        """The symbol of each character, and the agenda of pairs of pieces."""
        self.symbol = np.full(TABLED, -1, np.int32)
        for c, i in self.ids.items():
            if len(c) == 1 and ord(c) < TABLED:
                self.symbol[ord(c)] = i
        # An unknown character of one byte is that byte's piece, which no pair holds; one of more bytes has no symbol.
        lone = np.flatnonzero(self.symbol[:0x80] < 0)
        self.symbol[lone] = np.array(self.bytes, np.int32)[lone]
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = self.cost[piece], i
        self.agenda = Agenda(pairs, size)

    def new_words(self, words: list[str]) -> list[bytes]:
        """The ids of words, each given without its first blank, as bytes of 32-bit integers."""
        points = np.frombuffer("".join([BLANK + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = np.where(points < TABLED, self.symbol[np.minimum(points, TABLED - 1)], -1)
        found = self.agenda.words(symbols, np.fromiter(map(len, words), np.int64, len(words)) + 1)
        for k, x in enumerate(found):
            if x is None:
                found[k] = self.word(words[k])
            else:
                self.fresh.append((words[k], x))
        return found

    def word(self, word: str) -> bytes:
        """The ids of a word, given without its first blank, as bytes of 32-bit integers."""
        first, *lines = word.split("\n")
        # No piece holds a line end, so what stands on either side is apart.
        found = np.array(self.join(BLANK + first), "<i4").tobytes() + b"".join([self.lines["\n" + line] for line in lines])
        self.fresh.append((word, found))
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, without an end id; an empty text has none."""
        if not text:
            return np.empty(0, np.int32)
        if _ODD.search(text):
            words = [w[1:] for w in _WORD.findall(BLANK + text.replace(" ", BLANK))]
        else:
            words = text.split(" ")
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces put together, blanks restored, the first one dropped, control ids left out."""
        stops = np.flatnonzero(self.control[ids])
        # Bytes make a character only where no control id lies between them.
        runs = [run[self.control[run[:1]].sum() :] for run in np.split(ids, stops)]
        runs = [run for run in runs if len(run)]
        text = "".join(map(self._run, runs))
        return text[1:] if runs and self.library.id_to_piece(int(runs[0][0])).startswith(BLANK) else text

    def _run(self, ids: np.ndarray) -> str:
        text = "".join(self.shown[ids].tolist())
        try:
            text.encode()
            return text
        except UnicodeEncodeError:  # bytes beyond ASCII
            return text.encode("utf-8", "surrogateescape").decode("utf-8", "tickloom_each_byte")

    def check(self) -> None:
        """Hold the words encoded since the last check against the library."""
        fresh, self.fresh = self.fresh, []
        # Words with blanks of their own go alone, the others thousands to a text.
        alone, plain = [], []
        for x in fresh:
            (alone if not x[0] or _ODD.search(x[0]) else plain).append(x)
        groups = [[x] for x in alone if x[0]] + [plain[at : at + JOINED_WORDS] for at in range(0, len(plain), JOINED_WORDS)]
        texts = [" ".join([w for w, _ in group]).replace(BLANK, " ") for group in groups]
        for group, theirs in zip(groups, self.library.encode(texts, num_threads=1)):
            if np.frombuffer(b"".join([ids for _, ids in group]), "<i4").tolist() != theirs:
                raise RuntimeError(f"the library encodes otherwise one of the words from {group[0][0]!r} on")


def pieces(path: str) -> Pieces:
    """The vocabulary at ``path``, loaded once per worker and stage."""
    return held(("pieces", path), lambda: Pieces(path))


def _batch(model: Pieces, keys: pa.Array, texts: pa.Array, with_text: bool):
    """Encode a batch, check its new words, and yield its rows in runs whose ids 32-bit offsets can number."""
    odd = pc.or_(pc.match_substring_regex(texts, _ODD.pattern), pc.equal(texts, ""))
    words, bounds = split(pc.if_else(odd, "", texts))
    # An odd text is encoded alone and stands for its one empty word.
    places = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
    apart = {int(bounds[k]): model.encode(texts[k].as_py()).astype("<i4").tobytes() for k in places}
    flat, ends = ids_of(words, model.words.many, apart)
    model.check()
    flat, bounds = ended(flat, ends[bounds], model.end)
    for a, b in runs(bounds, RUN_IDS):
        columns = [keys.slice(a, b - a), lists(flat, bounds[a : b + 1])]
        if with_text:
            columns.append(pa.array(model.library.decode(np.split(flat[bounds[a] : bounds[b]], bounds[a + 1 : b] - bounds[a]), num_threads=1), pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])


def encode(docs: DataFrame, vocabulary: str, with_text: bool = False) -> DataFrame:
    """doc_id and ids (with the end id) of every document; ``with_text`` adds the text these ids decode to.

    Null texts count as empty: the end id alone.  Texts of any length go
    through whole; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        model = pieces(vocabulary)
        for batch in in_bytes(batches, 1):
            yield from _batch(model, *batch.columns, with_text)
        release()

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>" + ", text string" * with_text)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and text of encoded documents; null ids have an empty text."""

    def run(batches):
        model = pieces(vocabulary)
        for batch in batches:
            ids = batch.column(1)
            texts = [model.decode(x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")
