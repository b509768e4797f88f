"""Token ids of whole texts as directly addressable codes.

*Codes.* An id is split into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that has one, in order; a
bitmap beside it says which of them go on to level k + 1; a rank directory holds the number of set bits before every
``STEP``-th place. The place of an id on the next level is the rank of its bit, so any token is read in a step per
level without decoding its block.

*Files.* Texts are encoded where they are read and stored as ids, which are then sorted over ranges of text ids. A block holds whole texts (about ``BLOCK`` ids): their ids, token counts and
the codes. Blocks are rows of a table of the shared folder: (file, block, texts, before, tokens, doc_ids, counts, codes), file and
block numbers rising with the id; ``before`` counts the tokens of the file's earlier blocks. A table survives a lost executor as any job's output does.

*Encoding.* White space other than the space before a word is never inside a piece of the byte-level tokenizer, so a text cut
before every run of spaces and line ends encodes to the same ids piece by piece. So does one cut where letters, digits and punctuation meet, but for what
follows an apostrophe and the characters of the tokenizer's own added tokens. A piece is encoded once and its ids kept, by 64-bit hash, in a table of the worker that is
bounded in bytes; a word of letters, which the library's pattern would leave whole, goes to its model at once, other pieces many at a time as one text of lines.
Texts with other white space, and other tokenizers, are encoded whole.

Defined cases: null and empty texts hold the end id alone. Null ids come first, equal ids in order of their text's digest, each row
a text of its own. An empty table has no tokens. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import shuffle_partitions, stored
from tablewright.llm.words import give_back_memory, span_hashes, text_slices

END = 2
BLOCK = 1 << 18
STEP = 512
KEPT_BYTES = 48 << 20
RECENT = 1 << 15
LONGEST_JOINED = 256
AT_ONCE = 1 << 11
TABLE = "file int, block int, texts int, before long, tokens long, doc_ids binary, nulls binary, counts binary, codes binary"

#: Bytes that other white space may start with; a text that has one is looked at.
_ODD = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31, 0xE1, 0xE2, 0xE3])
_OTHER_SPACE = re.compile(r"[^\S \n]")

#: Kinds of bytes: letter, digit, punctuation, apostrophe; 0 is any other.
_LETTER, _DIGIT, _MARK, _QUOTE = 1, 2, 3, 4
_KINDS = np.array([0 if b < 33 or b > 126 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _QUOTE if b == 39 else _MARK for b in range(256)], dtype=np.uint8)
#: Whether a piece may end between two kinds: never next to one unknown, nor after an apostrophe, which may start a contraction.
_APART = np.array([a not in (0, _QUOTE, b) and b != 0 and not (a == _MARK and b == _QUOTE) for a in range(5) for b in range(5)])
#: The character that stands for each byte in a byte-level vocabulary.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARACTERS = {b: chr(b) if b in _SHOWN else chr(256 + b - sum(x < b for x in _SHOWN)) for b in range(256)}


def encode_codes(ids: np.ndarray) -> bytes:
    """The codes of an array of ids below 2**32."""
    rest = ids.astype(np.uint32)
    levels = []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), STEP)))[:-1]]) if len(more) else np.zeros(1)
        levels.append((rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    return struct.pack("<QB", len(ids), len(levels)) + b"".join(levels)


class Codes:
    """A view of encoded ids; nothing is decoded until asked for."""

    def __init__(self, data: bytes):
        n, levels = struct.unpack_from("<QB", data)
        self.length, self.levels, at = n, [], 9
        for _ in range(levels):
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + n)
            steps = max(1, -(-n // STEP))
            ranks = np.frombuffer(data, "<u4", steps, at + n + len(bits))
            at += n + len(bits) + 4 * steps
            self.levels.append((chunks, bits, ranks))
            n = int(ranks[-1]) + int(np.unpackbits(bits[(steps - 1) * STEP // 8 :]).sum())

    def __getitem__(self, place: int) -> int:
        """The id at one place."""
        if not 0 <= place < self.length:
            raise IndexError(place)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[place]) << (8 * k)
            if not bits[place >> 3] >> (place & 7) & 1:
                break
            start = place // STEP * STEP
            inside = np.unpackbits(bits[start >> 3 : (place >> 3) + 1], bitorder="little")[: place - start]
            place = int(ranks[place // STEP]) + int(inside.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id."""
        out = np.zeros(self.length, dtype=np.uint32)
        at = np.arange(self.length)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


class Pieces:
    """Pieces by rising hash: where their ids stand in a store, and how many they are."""

    def __init__(self):
        self.keys, self.offset, self.sizes = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)] == hashes

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes; of hashes that are not there, anything."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.offset[at], self.sizes[at]

    def add(self, keys: np.ndarray, offset: np.ndarray, sizes: np.ndarray) -> None:
        """Take in new hashes, in rising order."""
        place = np.searchsorted(self.keys, keys)
        self.keys, self.offset, self.sizes = np.insert(self.keys, place, keys), np.insert(self.offset, place, offset), np.insert(self.sizes, place, sizes)


class Encoder:
    """Ids of texts by a tokenizer file. Pieces are encoded once; their ids stay in a table of about ``KEPT_BYTES``, the newest in a small one beside it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        before = parts.get("pre_tokenizer") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not parts.get("normalizer")
            and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in parts.get("added_tokens", []))
        )
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        probe = self.tokenizer.encode("a\n b\nc", add_special_tokens=False).ids
        alone = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a", " b", "c")]
        # between pieces without one, a line end is a token of its own, so many pieces can be encoded as one text
        self.between = line_end[0] if self.by_piece and len(line_end) == 1 and probe == [*alone[0], *line_end, *alone[1], *line_end, *alone[2]] else None
        self.kinds = _KINDS.copy()
        added = [t["content"].encode() for t in parts.get("added_tokens", [])]
        self.kinds[[b for t in added for b in t if not chr(b).isalnum()]] = 0  # an added token is never cut
        if any(t.get("single_word") for t in parts.get("added_tokens", [])) or any(self.apart(np.frombuffer(t, np.uint8)).any() or (_KINDS[list(t)] <= _DIGIT).all() for t in added):
            self.kinds[:] = 0
        self.model = self.tokenizer.model
        words = ["a", " Words", "stra\u00dfe", " \u0141\u00f3d\u017a", "\u00c0\u00ff\u0100\u017f"]
        self.by_word = self.by_piece and parts["model"].get("type") == "BPE" and not parts["model"].get("dropout") and all(self.encoded_words([w.encode()])[0].tolist() == self.tokenizer.encode(w, add_special_tokens=False).ids for w in words) and not any(
            (self.letters(np.frombuffer(t, np.uint8)) | (np.frombuffer(t, np.uint8) == 32)).all() for t in added)
        self.forget()

    @staticmethod
    def letters(data: np.ndarray) -> np.ndarray:
        """Which bytes are letters: A-Z, a-z and U+00C0 to U+017F but for the two signs among them."""
        found = _KINDS[data] == _LETTER
        two = (data >= 0xC3) & (data <= 0xC5)
        two[:-1] &= (data[:-1] != 0xC3) | ((data[1:] != 0x97) & (data[1:] != 0xB7))
        found |= two
        found[1:] |= two[:-1]
        return found

    def apart(self, data: np.ndarray) -> np.ndarray:
        """Whether a piece may start at each byte because the kinds of characters before and after differ."""
        kind = self.kinds[data]
        kind[self.letters(data)] = self.kinds[97]
        out = np.zeros(len(data), dtype=bool)
        out[1:] = _APART[5 * kind[:-1] + kind[1:]]
        return out

    def pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every piece of a slice: texts, cut before every run of spaces and line ends and between kinds of characters if that is safe."""
        texts = len(starts) - 1
        first = np.zeros(len(data), dtype=bool)
        first[starts[:-1]] = True
        last = starts[1:] - 1
        if self.by_piece and texts:
            gap = (data == 32) | (data == 10)
            cut = self.apart(data)
            cut[1:] |= gap[1:] & ~gap[:-1]
            odd = _ODD[data]
            odd[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
            for t in np.flatnonzero(np.add.reduceat(odd, starts[:-1])):
                if _OTHER_SPACE.search(data[starts[t] : last[t]].tobytes().decode()):
                    cut[starts[t] : last[t]] = False
            first |= cut
        first[last] = False  # the space that follows a text; so an empty text has no piece
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(data))
        return begin, np.minimum(end, last[np.searchsorted(starts, begin, "right") - 1])

    def looked_up(self, text: bytes, hashes: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pieces (sorted by hash) stand in the store, and how many they are; pieces it lacks are encoded first."""
        if self.bytes() > KEPT_BYTES:
            self.forget()
        new = ~(self.known.has(hashes) | self.recent.has(hashes))
        if new.any():
            own, a, b = hashes[new], begin[new], stop[new]
            offset, sizes = np.empty(len(own), dtype=np.int64), np.empty(len(own), dtype=np.int32)
            alone, together = self.single_words(text, a, b), self.joinable(text, a, b)
            for some, encode in ((np.flatnonzero(alone), self.encoded_words), (np.flatnonzero(together & ~alone), self.encoded_as_one), (np.flatnonzero(~together & ~alone), self.encoded_each)):
                for i in range(0, len(some), AT_ONCE):  # the library's results are large
                    now = some[i : i + AT_ONCE]
                    ids, sizes[now] = encode([text[x:y] for x, y in zip(a[now].tolist(), b[now].tolist())])
                    if self.filled + len(ids) > len(self.store):
                        self.store = np.concatenate([self.store[: self.filled], np.empty(max(len(ids), self.filled // 4, 1 << 16), dtype=np.uint32)])
                    self.store[self.filled : self.filled + len(ids)] = ids
                    offset[now] = self.filled + np.cumsum(sizes[now], dtype=np.int64) - sizes[now]
                    self.filled += len(ids)
            self.recent.add(own, offset, sizes)
            if len(self.recent.keys) > RECENT:
                self.known.add(self.recent.keys, self.recent.offset, self.recent.sizes)
                self.recent = Pieces()
        offset, sizes = self.known.get(hashes)
        late = self.recent.has(hashes)
        offset[late], sizes[late] = self.recent.get(hashes[late])
        return offset, sizes

    def single_words(self, text: bytes, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which pieces are letters alone, after one space at most."""
        if not self.by_word:
            return np.zeros(len(begin), dtype=bool)
        data = np.frombuffer(text, dtype=np.uint8)
        seen = np.append(0, np.cumsum(self.letters(data)))
        first = begin + (data[begin] == 32)
        return (stop > first) & (seen[stop] - seen[first] == stop - first)

    def encoded_words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end and their number per word, from the model alone."""
        tokenize = self.model.tokenize
        ends = list(itertools.accumulate(map(len, pieces), initial=0))
        shown = b"".join(pieces).decode("latin-1").translate(_CHARACTERS)
        ids = [[t.id for t in tokenize(shown[a:b])] for a, b in zip(ends, ends[1:])]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes

    def joinable(self, text: bytes, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which pieces keep their ids when line ends stand around them: short ones without a line end that start with one space at most."""
        if self.between is None:
            return np.zeros(len(begin), dtype=bool)
        data = np.frombuffer(text, dtype=np.uint8)
        ends = np.append(0, np.cumsum(data == 10))
        second = data[np.minimum(begin + 1, stop - 1)]
        return (ends[stop] == ends[begin]) & (stop - begin <= LONGEST_JOINED) & ((data[begin] != 32) | ((second != 32) & (stop - begin > 1)))

    def encoded_as_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end and their number per piece, from one text with a line end between the pieces."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(pieces).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cut = np.append(np.flatnonzero(ids == self.between), len(ids))
        if len(cut) != len(pieces):
            return self.encoded_each(pieces)
        return np.delete(ids, cut[:-1]), np.diff(np.append(-1, cut)) - 1

    def encoded_each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes

    def bytes(self) -> int:
        """Bytes of the table of pieces and their ids."""
        return 20 * (len(self.known.keys) + len(self.recent.keys)) + 4 * len(self.store)

    def forget(self) -> None:
        """Empty the table of pieces."""
        self.known, self.recent, self.store, self.filled = Pieces(), Pieces(), np.empty(0, np.uint32), 0

    def __call__(self, data: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each followed by ``end``, and their number per text."""
        texts = len(starts) - 1
        begin, stop = self.pieces(data, starts)
        which, own = pd.factorize(span_hashes(data, begin, stop))  # by hash table: most pieces come often
        rising = np.argsort(own)
        hashes, place = own[rising], np.empty(len(own), dtype=np.int64)
        place[rising] = np.arange(len(own))
        at, which = np.empty(len(own), dtype=np.int64), place[which]
        at[which[::-1]] = np.arange(len(which))[::-1]
        offset, sizes = self.looked_up(data.tobytes(), hashes, begin[at], stop[at])
        owner = np.searchsorted(starts, begin, "right") - 1
        size = sizes[which]
        before = np.cumsum(size) - size
        place = np.arange(size.sum())
        counts = np.bincount(owner, size, minlength=texts).astype(np.int64) + 1
        out = np.full(int(counts.sum()), end, dtype=np.uint32)
        out[place + np.repeat(owner, size)] = self.store[place + np.repeat(offset[which] - before, size)]
        return out, counts


_ENCODERS: dict[str, Encoder] = {}


def _encode(path: str, end: int):
    """Rows (doc_id, digest, width, ids) in the order the texts come in: ids of two bytes each where they fit, else four."""

    def run(batches: Iterator[pa.RecordBatch]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task; Spark runs the tasks side by side
        give_back_memory()
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            for row, data, starts in text_slices(batch.column(2)):
                out, count = encoder(data, starts, end)
                width = 2 if int(out.max(initial=0)) < 1 << 16 else 4
                ends = pa.py_buffer((np.append(0, np.cumsum(count)) * width).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), len(count), [None, ends, pa.py_buffer(out.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(count)), batch.column(1).slice(row, len(count)), pa.array(np.full(len(count), width, dtype=np.int32)), ids], ["doc_id", "digest", "width", "ids"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Blocks of whole texts, from rows (doc_id, width, ids) in the order of the file."""
    give_back_memory()
    file = TaskContext.get().partitionId()
    names, counts, ids, held, made, before = [], [], [], 0, 0, 0

    def block():
        own, count = pa.concat_arrays(names), np.array(counts, dtype="<u4")
        return pa.RecordBatch.from_arrays([
            pa.array([file], pa.int32()), pa.array([made], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
            pa.array([own.fill_null(0).to_numpy().tobytes()], pa.binary()), pa.array([np.packbits(own.is_null().to_numpy(zero_copy_only=False)).tobytes()], pa.binary()),
            pa.array([count.tobytes()], pa.binary()), pa.array([encode_codes(np.concatenate(ids))], pa.binary()),
        ], [f.split()[0] for f in TABLE.split(", ")])

    for batch in batches:
        start = 0
        for i, width in enumerate(batch.column(1).to_pylist()):
            own = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=f"<u{width}")
            ids.append(own)
            counts.append(len(own))
            held += len(own)
            if held >= BLOCK:
                names.append(batch.column(0).slice(start, i + 1 - start))
                yield block()
                names, counts, ids, held, made, before, start = [], [], [], 0, made + 1, before + held, i + 1
        if start < batch.num_rows:
            names.append(batch.column(0).slice(start))
    if ids:
        yield block()


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """The stored blocks of all texts, in order of their ids. Texts are encoded where they are read; only their ids are sorted."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), F.col(text_col).cast("string").alias("text"))
    rows = stored(texts.mapInArrow(_encode(tokenizer, end), "doc_id long, digest long, width int, ids binary"), "token-ids", compression="zstd")
    placed = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    return stored(placed.select("doc_id", "width", "ids").mapInArrow(_blocks, TABLE), "tokens")


def _digests(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
            counts = np.frombuffer(get("counts"), dtype="<u4").astype(np.int64)
            data = Codes(get("codes")).all().astype("<u4").tobytes()
            ends = np.cumsum(counts)
            null = np.unpackbits(np.frombuffer(get("nulls"), dtype=np.uint8), count=len(counts)).astype(bool)
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(get("doc_ids"), dtype=np.int64), pa.int64(), mask=null), pa.array(get("start") + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_texts(files: DataFrame) -> DataFrame:
    """Row per text, read from its block: doc_id, start (tokens of all texts before), n_tokens, ids_crc32."""
    by_file = files.groupBy("file").agg(F.sum("tokens").alias("all_tokens")).withColumn("file_start", F.sum("all_tokens").over(Window.orderBy("file")) - F.col("all_tokens"))
    starts = F.broadcast(by_file.select("file", "file_start"))  # a row per file, of which there are as many as shuffle partitions; the codes stay where they are
    return files.join(starts, "file").select("doc_ids", "nulls", "counts", "codes", (F.col("file_start") + F.col("before")).alias("start")).mapInArrow(
        _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(files: DataFrame, file: int, block: int, place: int) -> int:
    """One token of one block, by random access."""
    row = files.where((F.col("file") == file) & (F.col("block") == block)).select("codes").first()
    if row is None:
        raise KeyError((file, block))
    return Codes(bytes(row.codes))[place]
