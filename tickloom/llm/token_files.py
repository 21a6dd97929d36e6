"""Token ids of a byte-level BPE vocabulary, stored as directly addressable codes in doc_id order.

Documents are dealt into buckets of consecutive ids; a bucket's documents are
encoded in order and their ids packed into blocks.  The files are Parquet rows
of one block each: the block's place, its documents with their first token,
and the packed ids.  Any token is read from its block without decoding it.

Encoding goes by the pieces between blanks, which the vocabulary's own rule for
cutting words never joins, so a piece is encoded once for all texts of a batch.
Pieces of Latin letters, digits and signs go side by side as arrays of bytes;
a worker encodes other pieces one by one and keeps those met lately.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.llm.agenda import Agenda
from tickloom.llm.common import Recent, text_of
from tickloom.llm.dac import Codes, pack
from tickloom.llm.ordered import bucket_of, edges, in_buckets, order_key
from tickloom.llm.wordlists import gathered, in_bytes, raw, split

END = 2
BLOCK_TOKENS = 1 << 20
STORED_PIECES = 300_000

# A blank after white space may belong to the token before it, any other blank begins a token.
_JOINED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_SPACE = re.compile(r"\s")
# The same for Arrow, whose \s is that of ASCII: every character that may count as white space.
_JOINED_ANY = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
# A line end between characters that aren't white space, and what is put before it where texts are cut: a blank and a mark.
_LINE_END = r"([^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])\n([^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])"
MARK = "\x01"
BATCH_BYTES = 8 << 20
# Longer pieces go to the library whole, so that places of single bytes are kept for short ones only.
LONGEST = 1 << 12


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_LETTER = _byte_letters()
# Beyond the Latin blocks, editions of Unicode may differ on what a letter is.
_LATIN = "\u0250"


# What the vocabulary's rule for cutting words takes a byte for: ASCII's letters, digits and signs, and the bytes of letters from U+00C0 to U+024F.
LETTER, DIGIT, SIGN = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = SIGN
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
# First byte and range of the second of what is no such letter.
_NO_LETTERS = ((0xC3, 0x97, 0x97), (0xC3, 0xB7, 0xB7), (0xC9, 0x90, 0xBF))


def merges(tokenizer) -> tuple[Agenda, np.ndarray]:
    """The agenda of a byte-level vocabulary's merges, and the symbol of each byte."""
    model = json.loads(tokenizer.to_str())["model"]
    vocabulary = model["vocab"]
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs[vocabulary[a], vocabulary[b]] = rank, vocabulary[a + b]
    return Agenda(pairs, max(vocabulary.values()) + 1), np.array([vocabulary[_LETTER[b]] for b in range(256)], np.int32)


class Pieces:
    """The ids of texts, of one as bytes of unsigned 32-bit integers; pieces that went one by one lately are not encoded anew."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.merge = tokenizer.model.tokenize
        self.line_end = self.encoded("\n")
        names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.stops = {c: self.encoded(c) for c in ".,"}
        self.heads = Recent(self.encoded, STORED_PIECES // 4)  # pieces at the start of a line, which have no blank
        self.after_blank = Recent(self.marked, STORED_PIECES)  # pieces behind a blank, or behind a mark
        self.agenda, self.symbol = merges(tokenizer)

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, piece: str) -> bytes:
        """The ids of a blank and Latin letters, which are one word to the vocabulary: its merges alone."""
        shown = (" " + piece).encode().decode("latin-1").translate(_LETTER)
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of a blank and a piece."""
        if piece.isalpha() and max(piece) < _LATIN:
            return self.letters(piece)
        if piece[-1:] in self.stops and piece[:-1].isalpha() and max(piece) < _LATIN:
            # A full stop or comma behind a letter is a word of its own.
            return self.letters(piece[:-1]) + self.stops[piece[-1]]
        first, *lines = piece.split("\n")
        if lines and first and all(lines) and not _SPACE.search(piece.replace("\n", "")):
            # So is a line end between other characters.
            return self.after_blank[first] + b"".join([self.line_end + self.heads[line] for line in lines])
        return self.encoded(" " + piece)

    def marked(self, piece: str) -> bytes:
        """The ids of a blank and a piece, or of a line end and what follows it up to the next blank."""
        if piece[:1] != MARK:
            return self.piece(piece)
        first, *lines = piece[2:].split("\n")
        if not all(lines) or _SPACE.search("".join(lines)):
            return self.encoded(piece[1:])
        return b"".join([self.line_end + self.heads[line] for line in (first, *lines)])

    def distinct(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of marked pieces, where those of each begin and how many it has.

        Pieces of Latin letters, digits and signs are cut into the vocabulary's
        words: runs of one kind, the first with its blank, a line end alone.
        Different words go side by side; other pieces go one by one.
        """
        data, bounds = raw(found)
        kinds = np.append(_KIND[data], np.uint8(0))
        for lead, low, high in _NO_LETTERS:
            at = np.flatnonzero(data[:-1] == lead)
            kinds[at[(data[at + 1] >= low) & (data[at + 1] <= high)]] = 0
        sizes, begins = np.diff(bounds), bounds[:-1]
        marked = np.append(data, np.uint8(0))[begins] == ord(MARK)
        marked &= sizes > 2
        begins, sizes = begins + 2 * marked, sizes - 2 * marked
        # The number of unusual bytes up to each place; an apostrophe before a letter may begin a word of its own.
        unusual = kinds[:-1] == 0
        quotes = np.flatnonzero(data == ord("'"))
        unusual[quotes[kinds[quotes + 1] == LETTER]] = True
        before = np.concatenate((np.zeros(1, np.int32), np.cumsum(unusual, dtype=np.int32)))
        plain = (sizes > 0) & (sizes <= LONGEST) & (before[begins + sizes] == before[begins])
        at, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, first, counts = self.runs(data, kinds, begins[at], sizes[at], marked[at])
        others = self.after_blank.many(found.take(pa.array(alone)).to_pylist())
        starts, numbers = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
        starts[at], numbers[at] = first, counts
        numbers[alone] = n = np.fromiter(map(len, others), np.int64, len(others)) // 4
        starts[alone] = len(ids) + np.cumsum(n) - n
        return np.concatenate((ids, np.frombuffer(b"".join(others), "<i4"))), starts, numbers

    def runs(self, data: np.ndarray, kinds: np.ndarray, begins: np.ndarray, sizes: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces of known kinds of bytes, where those of each begin and how many it has; marked ones have a line end before them, others a blank."""
        heads = np.cumsum(sizes + 1) - sizes - 1
        inside = np.ones(int(sizes.sum()) + len(sizes), bool)
        inside[heads] = False
        letters, kind = np.empty(len(inside), np.uint8), np.empty(len(inside), np.uint8)
        letters[inside], kind[inside] = gathered(data, begins, sizes), gathered(kinds, begins, sizes)
        letters[heads] = np.where(marked, ord("\n"), ord(" "))
        kind[heads] = np.where(marked, 0, kind[heads + 1])
        starts = np.concatenate(([True], kind[1:] != kind[:-1])) if len(kind) else np.empty(0, bool)
        starts[heads] = True
        cuts = np.append(np.flatnonzero(starts), len(letters)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
        place = words.indices.to_numpy()
        each, bounds = raw(words.dictionary)
        ids, first, counts = self.agenda.found(self.symbol[each], np.diff(bounds))
        long = np.flatnonzero(counts == 0)
        more = [np.array([t.id for t in self.merge(w.decode("latin-1").translate(_LETTER))], np.int32) for w in words.dictionary.take(pa.array(long)).to_pylist()]
        counts[long] = n = np.fromiter(map(len, more), np.int64, len(more))
        first[long] = len(ids) + np.cumsum(n) - n
        flat = gathered(np.concatenate((ids, *more)), first[place], counts[place])
        total = np.concatenate(([0], np.cumsum(counts[place])))
        piece = np.searchsorted(cuts, np.append(heads, len(letters)))
        return flat, total[piece[:-1]], np.diff(total[piece])

    def ids(self, text: str) -> bytes:
        if self.added and self.added.search(text) or MARK in text:
            return self.encoded(text)  # an added token's name is one token, with its own rules for the text around it
        if _JOINED.search(text):
            first, *rest = _CUT.split(text)
            rest = [piece[1:] for piece in rest]
        else:
            first, *rest = text.split(" ")
        head = self.heads[first] if first else b""
        return head + b"".join(map(self.after_blank.__getitem__, rest))

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and where those of each text begin and end."""
        odd = pc.or_(pc.match_substring_regex(texts, _JOINED_ANY), pc.match_substring(texts, MARK))
        if self.added:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.added.pattern))
        # A line's first word is a piece of its own, or most pieces with line ends would be met once.
        words, bounds = split(pc.replace_substring_regex(pc.if_else(odd, "", texts), _LINE_END, f"\\1 {MARK}\n\\2"))
        first = words.take(pa.array(bounds[:-1])).to_pylist()
        # Only a text's first piece has no blank before it; an odd text is encoded alone in that place.
        apart = {at: self.heads[w] if w else b"" for at, w in zip(bounds[:-1].tolist(), first)}
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            apart[int(bounds[k])] = self.ids(texts[k].as_py())
        coded = words.dictionary_encode()
        flat, begins, counts = self.distinct(coded.dictionary)
        place = coded.indices.to_numpy().copy()
        place[list(apart)] = np.arange(len(counts), len(counts) + len(apart))
        n = np.fromiter(map(len, apart.values()), np.int64, len(apart)) // 4
        begins, counts = np.concatenate((begins, len(flat) + np.cumsum(n) - n)), np.concatenate((counts, n))[place]
        flat = gathered(np.concatenate((flat, np.frombuffer(b"".join(apart.values()), "<i4"))), begins[place], counts)
        return flat, np.concatenate(([0], np.cumsum(counts)))[bounds]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary at ``path``, loaded once per worker, with the library's own settings."""
    if path not in _loaded:
        # One thread per task: Spark runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Pieces(Tokenizer.from_file(path))
    return _loaded[path]


BLOCKS = "bucket int, block int, start bigint, tokens bigint, doc_ids array<bigint>, starts array<bigint>, codes binary"

NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = END) -> None:
    """Encode ``docs`` and write their ids to ``folder``, in ascending doc_id order.

    Null texts count as empty: the end id alone.  Null ids come first; rows of
    the same id follow in order of their text's hash.  An empty table writes
    files without rows.
    """
    rows = docs.select(
        bucket_of(edges(docs))(order_key()).alias("bucket"), order_key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    placed = in_buckets(rows, "bucket", "key", "tie").select("bucket", "doc_id", "text")

    def run(batches):
        coder, last = pieces(vocabulary), np.array([end], np.int32)
        bucket = start = block = held = None
        doc_ids, starts, parts = [], [], []

        def row():
            codes = pack(np.concatenate(parts).view(np.uint32))
            values = (bucket, block, start, held, doc_ids, starts, codes)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, KINDS)], names=NAMES)

        for batch in in_bytes(batches, 2, BATCH_BYTES):
            flat, bounds = coder.many(batch.column(2))
            for its, doc_id, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if bucket is not None and (its != bucket or held >= BLOCK_TOKENS):
                    yield row()
                    start, block = (start + held, block + 1) if its == bucket else (0, 0)
                    doc_ids, starts, parts, held = [], [], [], 0
                if bucket is None:
                    start, block, held = 0, 0, 0
                bucket = its
                doc_ids.append(doc_id)
                starts.append(held)
                parts += [flat[a:b], last]
                held += b - a + 1
        if bucket is not None:
            yield row()

    placed.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(folder)


def starts(blocks: DataFrame) -> DataFrame:
    """The number of tokens before each bucket; one row per bucket, so one task orders them."""
    totals = blocks.groupBy("bucket").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("bucket", F.coalesce(before, F.lit(0)).alias("base"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    All documents of a block are asked for, so its codes are read in one stretch.
    """
    stored = spark.read.parquet(folder)

    def run(batches):
        for batch in batches:
            for bucket, start, doc_ids, firsts, codes in zip(*[c.to_pylist() for c in batch.columns]):
                found = Codes(codes)
                stops = firsts[1:] + [len(found)]
                ids = found.slice(0, len(found)).astype("<u4", copy=False)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(firsts, stops)]
                n = len(doc_ids)
                columns = [pa.array([bucket] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array([start + a for a in firsts], pa.int64()),
                           pa.array([b - a for a, b in zip(firsts, stops)], pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "doc_id", "within", "n_tokens", "ids_crc32"])

    found = stored.select("bucket", "start", "doc_ids", "starts", "codes").mapInArrow(
        run, "bucket int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return found.join(F.broadcast(starts(stored)), "bucket").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
