"""Language-model scores of whole texts with a probabilistic suffix tree over words.

*Symbols.* A text is its words, A-Z as a-z, and one end. The end and every training word seen ``LEAST`` times have a symbol each, all
other words share one. A word of the shared symbol gets that symbol's chance times its own share of it; all words never seen are one
word, whose chance is what absolute discounting takes from the seen ones.

*Tree.* A state is a context of up to ``DEPTH`` symbols; before a text stands an end. Level by level, over all training texts, it is
counted how often each symbol follows each context that occurs ``LEAST`` times. A context is kept if its next-symbol distribution
diverges from that of its suffix: the texts it predicts must gain ``DIVERGENCE`` bits, each occurrence left out of its own estimate.
The suffixes of a kept context are kept too. A kept context's distribution is that of all symbols seen after it, smoothed towards
that of its suffix with a weight of ``PULL``.

*Exchange.* Blocks of texts are kept on disk as the numbers of their words and stay where they are. What a block has to count goes out once per distinct key, sorted,
in steps, packed, by ranges of keys: first its words, then the pairs of context and symbol after contexts of one symbol, then those after all longer ones that
two counted contexts make up. The counts come back to the part of the blocks that asked, in the order of its keys, which it makes anew. A context of k symbols
followed by one is a context of k + 1, so a token's context occurs as often as the pair of the token in front of it. Keys are symbol numbers side by side where 64 bits hold them, else hashes of 64 bits.

*Scores.* Each symbol is predicted by the longest state that the text before it ends in; the score is the sum of log10. As the suffixes
of states are states, it is the score of the empty context plus what each state on the way adds. What tokens gain is summed per context; kept contexts are told
to tasks by a filter of 2 ** ``GATE_BITS`` bits, doubled until at most ``INLINE`` others pass it, and by these others.

*Base.* Words counted over all training texts, each end a token.

Training texts are those whose crc32 of the id as text, modulo 7, is not 2. Words count as equal if their 64-bit hashes are.

Defined cases: null and empty texts are an end alone. A null id counts as empty text in the fold. Rows of one id are scored
one by one. An empty table gives an empty one; without training texts all counts are 0, and the end and the shared symbol are equally
likely. Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.shared import shuffle_partitions, stored
from tablewright.llm.words import give_back_memory, mixed, slice_words, text_slices, trim

BITS = 12
SYMBOLS = 1 << BITS  # of a tree in memory
DEPTH = 3
LEAST = 32
DIVERGENCE = 20.0
PULL = 8.0
SENT = 1 << 17
INLINE = 1 << 20
BLOCK = 3 << 18  # tokens of a block
PART = 1 << 24  # bytes of text whose words and pairs a task counts
KEPT = 1 << 25, 1 << 25  # bytes of an array, and of freed ones, that a task keeps while it works on a block
PIECE = 1 << 18  # bytes of a row; larger ones are costly for the JVM
PIECES = 128  # of a part of the blocks, on its way
GATE_BITS = 26
FOLDS, HELD_OUT = 7, 2
END_WORD = 0x0E4D  # stands for the end among word hashes
OTHER_WORD = 0x07E4  # and for all words without a symbol
TURN = 17
END, OTHER = 0, SYMBOLS - 1
FOLD = f"pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), {FOLDS}) = {HELD_OUT}"
END_NUMBER, OTHER_NUMBER = 0, 1
INFO = ["doc_id", "n_tokens", "n_known", "base", "words"]
WORDS = 0  # among kinds of requests; the others are lengths of contexts


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every token of a slice, ends included, in order."""
    text, _, _, hashes = slice_words(data, starts)
    cuts = np.searchsorted(text, np.arange(1, len(starts)))
    return np.insert(text, cuts, np.arange(len(starts) - 1)), np.insert(hashes, cuts, np.uint64(END_WORD))


@dataclasses.dataclass
class Alphabet:
    """Sorted hashes of the words that have a symbol, and the symbols."""

    hashes: np.ndarray
    symbols: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.symbols[place], OTHER)


def contexts(text: np.ndarray, symbols: np.ndarray, levels: list[np.ndarray]) -> list[np.ndarray]:
    """For each level of sorted contexts, the number of the context before every token, -1 where it is none of them.

    A context of k symbols holds the nearest one in its lowest bits. Its number comes from that of the k - 1 farther ones, which stood
    before the token in front. ``levels`` holds, per length, the sorted contexts.
    """
    before = np.empty(len(symbols), dtype=np.int64)
    before[:1], before[1:] = END, symbols[:-1]
    first = np.ones(len(symbols), dtype=bool)
    first[1:] = text[1:] != text[:-1]
    before[first] = END
    out, last = [], np.zeros(len(symbols), dtype=np.int64)  # the empty context
    for k, known in enumerate(levels):
        farther = np.empty_like(last)
        farther[:1], farther[1:] = -1, last[:-1]
        if k == 0:
            farther[:] = 0
        else:
            farther[first] = -1
        number = np.full(len(symbols), -1, dtype=np.int64)
        if len(known):
            ok = farther >= 0
            key = (levels[k - 1][farther[ok]] << BITS if k else 0) | before[ok]
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            number[ok] = np.where(known[place] == key, place, -1)
        out.append(number)
        last = number
    return out


@dataclasses.dataclass
class Tree:
    """Per length: sorted contexts that may lead to a state, whether each is one, the weight of its suffix (log10 of ``PULL`` over
    occurrences plus ``PULL``), and log10 chances of the symbols seen after it. ``root``: log10 chance of every symbol."""

    alphabet: Alphabet
    root: np.ndarray
    levels: list[np.ndarray]
    kept: list[np.ndarray]
    back: list[np.ndarray]
    seen: list[tuple[np.ndarray, np.ndarray]]

    def log_chances(self, text: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log10 of the chance of every token's symbol in the longest state before it."""
        out = self.root[symbols]
        for number, known, kept, back, (pairs, chance) in zip(contexts(text, symbols, self.levels), self.levels, self.kept, self.back, self.seen):
            at = np.flatnonzero((number >= 0) & kept[number] if len(kept) else number >= 0)
            if not len(at):
                continue
            key = known[number[at]] << BITS | symbols[at]
            lower = out[at] + back[number[at]]  # a symbol not seen after the context has its suffix's chance, weighed down
            if len(pairs):
                place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                lower = np.where(pairs[place] == key, chance[place], lower)
            out[at] = lower
        return out


def grow(spark, count_level, alphabet: Alphabet, root_counts: np.ndarray, root: np.ndarray, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE) -> Tree:
    """The tree of a small alphabet in memory, level by level; ``levels`` of the tables below hold the same for any.

    ``count_level(levels)`` gives the stored counts after the contexts of the last level.
    """
    levels: list[np.ndarray] = []
    tables: list[DataFrame] = []
    gains: list[dict[int, float]] = []
    totals: list[dict[int, int]] = []
    candidates = np.flatnonzero(root_counts >= least).astype(np.int64)
    floor = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(10.0**root)], "symbol long, root double")
    for k in range(depth):
        levels.append(np.sort(candidates))
        counts = count_level(levels)
        tables.append(counts)
        rows = counts.select("key", "times", F.shiftright("key", BITS).alias("context"), F.col("key").bitwiseAND(F.lit(SYMBOLS - 1)).alias("symbol"))
        total = rows.groupBy("context").agg(F.sum("times").alias("all"))
        own = rows.join(total, "context").join(floor, "symbol")
        if k:
            short = tables[k - 1].select(F.col("key").alias("short"), F.col("times").alias("short_times"))
            short_all = tables[k - 1].groupBy(F.shiftright("key", BITS).alias("short_context")).agg(F.sum("times").alias("short_all"))
            own = (own.withColumn("short", F.col("key").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))).withColumn("short_context", F.shiftright("short", BITS))
                   .join(short, "short", "left").join(short_all, "short_context", "left"))
            wide = (F.coalesce("short_times", F.lit(0)) + PULL * F.col("root")) / (F.coalesce("short_all", F.lit(0)) + PULL)
        else:
            wide = F.col("root")
        left_out = (F.col("times") - 1 + PULL * wide) / (F.col("all") - 1 + PULL)
        gain = own.groupBy("context").agg(F.sum(F.col("times") * F.log2(left_out / wide)).alias("gain"), F.first("all").alias("all"))
        found = gain.collect()
        gains.append({r.context: r.gain for r in found})
        totals.append({r.context: r["all"] for r in found})
        if k + 1 < depth:
            mask = (1 << BITS * (k + 2)) - 1
            more = counts.where(f"times >= {least}").where((F.col("key").bitwiseAND(F.lit(SYMBOLS - 1)) != END))
            candidates = np.array([r.key & mask for r in more.select("key").collect()], dtype=np.int64)
    keep: list[set[int]] = [set() for _ in range(depth)]
    for k in range(depth - 1, -1, -1):
        for context, gain in gains[k].items():
            if gain >= divergence or context in keep[k]:
                for j in range(k + 1):
                    keep[j].add(context & ((1 << BITS * (j + 1)) - 1))
    kept, back, seen = [], [], []
    for k in range(depth):
        known = levels[k]
        flags = np.array([int(c) in keep[k] and int(c) in totals[k] for c in known], dtype=bool)
        wanted = spark.createDataFrame([(int(c),) for c in known[flags]], "context long")
        rows = tables[k].withColumn("context", F.shiftright("key", BITS)).join(F.broadcast(wanted), "context").select("key", "times").toArrow()
        pairs, times = rows["key"].to_numpy(), rows["times"].to_numpy().astype(float)
        order = np.argsort(pairs)
        pairs, times = pairs[order], times[order]
        place = np.searchsorted(known, pairs >> BITS)
        occurrences = np.bincount(place, times, minlength=len(known))
        # the suffix's chance: its own seen one, or its suffix's, weighed down
        lower = root[pairs & (SYMBOLS - 1)].astype(float)
        for j in range(k):
            short = pairs & ((1 << BITS * (j + 2)) - 1)
            here = np.minimum(np.searchsorted(levels[j], short >> BITS), max(len(levels[j]) - 1, 0))
            is_state = (levels[j][here] == short >> BITS) & kept[j][here] if len(levels[j]) else np.zeros(len(short), dtype=bool)
            own, chance = seen[j]
            if len(levels[j]):
                found_at = np.minimum(np.searchsorted(own, short), max(len(own) - 1, 0))
                known_pair = own[found_at] == short if len(own) else np.zeros(len(short), dtype=bool)
                lower = np.where(is_state, np.where(known_pair, chance[found_at] if len(own) else 0.0, lower + back[j][here]), lower)
        chance = np.log10((times + PULL * 10.0**lower) / (occurrences[place] + PULL)) if len(pairs) else np.empty(0)
        kept.append(flags)
        back.append(np.log10(PULL / (occurrences + PULL)))
        seen.append((pairs, chance))
    return Tree(alphabet, root, levels, kept, back, seen)


def _turned(x: np.ndarray) -> np.ndarray:
    return x << np.uint64(TURN) | x >> np.uint64(64 - TURN)


def _named(contexts: np.ndarray, k: int, width: int, depth: int) -> np.ndarray:
    """Keys of contexts of ``k`` symbols that tell them apart from those of other lengths in one table: the number after a one, where all lengths fit."""
    if depth * width < 64:
        return contexts | np.uint64(1 << k * width)
    return mixed(contexts) ^ mixed(np.array([2**64 - k], dtype=np.uint64))


def _suffixes(keys: np.ndarray, width: int, depth: int) -> np.ndarray:
    """The keys without the farthest symbol of each, 0 where there was one, of keys that are numbers after a one."""
    out = np.zeros_like(keys)
    for k in range(2, depth + 1):
        own = keys >> np.uint64(k * width) == np.uint64(1)
        out[own] = keys[own] & np.uint64((1 << (k - 1) * width) - 1) | np.uint64(1 << (k - 1) * width)
    return out


def _followed(contexts: np.ndarray, bits: int, symbols: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Number of each context of ``bits`` bits followed by a symbol of ``width``, and its bits; where these are more than 64, a hash."""
    if bits + width <= 64:
        return contexts << np.uint64(width) | symbols, bits + width
    return _turned(mixed(contexts)) ^ mixed(symbols + np.uint64(1)), 64


def _scattered(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of ``bits`` bits that spreads them evenly."""
    if bits >= 64:
        return x
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15):
        x = x * np.uint64(odd) & mask
        x = x ^ x >> half
    return x


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return mixed(keys) >> np.uint64(64 - bits)


def gate(keys: DataFrame, size: int = GATE_BITS) -> np.ndarray:
    """Bits, 2 ** ``size`` of them, one of which is set for each of the keys."""

    def run(batches):
        for batch in batches:
            places = np.unique(_places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size))
            word, first = np.unique(places >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first) if len(first) else places
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << size - 6, dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    places = _places(keys, len(bits).bit_length() + 5)
    return bits[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1) == 1


def _among(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is one of the sorted known ones, and where."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[place] == keys, place


@dataclasses.dataclass(frozen=True)
class Facts:
    """Of the training texts: tokens, distinct words, those seen once, symbols, and tokens of other words; the first number of the symbols that each part counted."""

    n: int
    v: int
    once: int
    symbols: int
    other: int
    least: int
    first: np.ndarray

    @property
    def width(self) -> int:
        """Bits of a symbol's number; that of the end is 0, that of all other words 1."""
        return (self.symbols + 1).bit_length()

    @property
    def discount(self) -> float:
        return min(0.9, max(0.1, self.once / max(self.v, 1)))

    @property
    def unseen(self) -> float:
        """The chance of all unseen words."""
        return self.discount * self.v / self.n if self.n else 0.5

    @property
    def shared(self) -> float:
        """The chance of the symbol that all other words share."""
        return (self.other - self.discount * (self.v - self.symbols)) / max(self.n, 1) + self.unseen

    def base(self, times: np.ndarray) -> np.ndarray:
        return np.log10(times + 1.0) - np.log10(self.n + self.v + 1.0)

    def root(self, times: np.ndarray) -> np.ndarray:
        return np.where(times > 0, np.log10(np.maximum(times - self.discount, 1e-12) / max(self.n, 1)), np.log10(self.unseen))


def _packed(x: np.ndarray) -> tuple[int, int, bytes]:
    """Whole numbers from 0 on as the bytes that they use, all lowest ones first, compressed."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(len(x), 8).T[:width]
    return len(x), width, pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: tuple[int, int, bytes]) -> np.ndarray:
    n, width, raw = packed
    out = np.zeros((n, 8), dtype=np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(pa.decompress(raw, n * width, "zstd"), dtype=np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _steps(keys: np.ndarray) -> tuple[int, tuple]:
    """Sorted keys as the first one and the steps between them."""
    return int(keys[0]) if len(keys) else 0, _packed(np.diff(keys))


def _from_steps(steps: tuple[int, tuple], n: int) -> np.ndarray:
    return np.cumsum(np.append(np.uint64(steps[0]), _unpacked(steps[1])), dtype=np.uint64)[:n]


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write(batch)
    return sink.getvalue().to_pybytes()


def _unstreamed(batches):
    for batch in batches:
        for one in batch.column(0):
            yield from pa.ipc.open_stream(one.as_buffer())


def _table(rows: RDD, spark: SparkSession, schema: str) -> DataFrame:
    """The rows of batches that came as bytes."""
    return spark.createDataFrame(rows.map(lambda x: (x,)), "batch binary").mapInArrow(_unstreamed, schema)


def _keeping_memory(run):
    """``run``, which yields, with memory that it frees kept for itself."""

    @functools.wraps(run)
    def kept(*given):
        give_back_memory(*KEPT)
        try:
            yield from run(*given)
        finally:
            give_back_memory()
            trim()

    return kept


def _coded(most: int):
    """(codes, last) of blocks of about ``most`` tokens, in pieces: the block's words, with their times in training texts; which are its tokens; per text its tokens, whether it is for training, and its id."""

    @_keeping_memory
    def run(batches):
        held: list[tuple] = []

        def out():
            words, at, counts = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-np.floor(np.log2(counts)), kind="stable")  # frequent words get small numbers, equally frequent ones stay sorted
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order))
            at, lengths, train = number[at], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            times = np.bincount(at, np.repeat(train, lengths), minlength=len(words)).astype(np.int64)
            codes = _steps(words[order]), _packed(times), _packed(at), _packed(lengths), np.packbits(train).tobytes(), _stream(pa.table([pa.chunked_array([h[3] for h in held])], ["doc_id"]).combine_chunks().to_batches()[0])
            held.clear()
            raw = pickle.dumps(codes)
            cuts = range(0, len(raw), PIECE)
            return pa.RecordBatch.from_arrays([pa.array([raw[k : k + PIECE] for k in cuts], pa.binary()), pa.array([k == cuts[-1] for k in cuts])], ["codes", "last"])

        tokens = 0
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False)
            for row, data, starts in text_slices(batch.column(1)):
                texts = len(starts) - 1
                text, hashes = _words(data, starts)
                held.append((hashes, np.bincount(text, minlength=texts), train[row : row + texts], batch.column(0).slice(row, texts)))
                tokens += len(hashes)
                if tokens >= most:
                    yield out()
                    tokens = 0
        if held:
            yield out()

    return run


def _distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones, sorted, and the place of each key among them."""
    room = len(keys).bit_length()
    if bits + room > 64 or not len(keys):
        return np.unique(keys, return_inverse=True)
    both = keys << np.uint64(room)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()  # sorting numbers is faster than sorting places
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] >> np.uint64(room) != both[:-1] >> np.uint64(room)
    own = both[new] >> np.uint64(room)
    place = np.empty(len(keys), dtype=np.int32)
    both &= np.uint64((1 << room) - 1)
    place[both.view(np.int64)] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return own, place


@dataclasses.dataclass
class Level:
    """Tokens of a block after an admitted context of ``k`` symbols; as long as ``times`` are asked for, also some whose context may not be admitted.

    ``at``: their places; ``context``: the place of each one's context among ``contexts``; ``all``: its occurrences; ``keys``: those of the distinct pairs of
    context and symbol, sorted, numbers of ``bits`` bits; ``pair``: the place of each one's; ``times``: occurrences of its pair.
    """

    k: int
    at: np.ndarray
    context: np.ndarray
    contexts: np.ndarray
    all: np.ndarray
    keys: np.ndarray
    bits: int
    pair: np.ndarray
    times: np.ndarray | None


def _counts(replies: list[tuple], asked: int) -> np.ndarray:
    """What was counted of the keys of a request, part by part."""
    found = np.concatenate([np.zeros(0, dtype=np.uint64), *(_unpacked(x) for _, x, *_ in sorted(replies))]).astype(np.int64)
    if len(found) != asked:
        raise RuntimeError(f"{len(found)} counts for {asked} keys")
    return found


class Words:
    """The distinct words of a block, sorted, and their times in its training texts."""

    def __init__(self, codes: tuple):
        steps, times = codes[:2]
        words = _from_steps(steps, times[0])
        self.order = np.argsort(words)
        self.keys, self.times = words[self.order], _unpacked(times)[self.order]


def _numbered(facts: Facts):
    """(part, piece) of blocks as their tokens' symbols, and per text id, tokens, known tokens, base sum and its words' chances; the words themselves are left behind."""

    @_keeping_memory
    def run(index, pieces):
        out = []
        blocks, replies = zip(*pieces)
        blocks = _whole(blocks)
        own = [[] for _ in blocks]
        for reply in _whole(replies):
            _, number, *counts = pickle.loads(reply)
            own[number].append(tuple(counts))
        for codes, replies in zip(blocks, own):
            codes = pickle.loads(codes)
            words = Words(codes)
            order = np.empty_like(words.order)
            order[words.order] = np.arange(len(order))
            known = _counts(replies, len(order))
            symbol = (known >= facts.least) | (words.keys == np.uint64(END_WORD))
            numbers = np.zeros(len(order), dtype=np.uint64)
            if facts.n:
                numbers[(known > 0) & symbol] = np.concatenate([_unpacked(x) + np.uint64(facts.first[part]) for part, _, x in sorted(replies)])
            numbers[words.keys == np.uint64(END_WORD)] = END_NUMBER
            known, symbol, numbers = known[order], symbol[order], numbers[order]
            _, _, at, lengths, train, ids = codes
            at, starts = _unpacked(at).astype(np.int64), _unpacked(lengths).astype(np.int64)
            text = np.repeat(np.arange(len(starts)), starts)
            sums = [np.bincount(text, x[at], minlength=len(starts)) for x in (known > 0, facts.base(known), facts.root(known))]
            ids = pa.ipc.open_stream(ids).read_next_batch().column(0)
            info = pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], INFO)
            out.append(pickle.dumps((
                _packed(np.append(np.uint64(OTHER_NUMBER), numbers[symbol])), _packed(np.append(facts.other, known[symbol])), _packed(np.where(symbol, np.cumsum(symbol), 0)[at]), lengths, train, _stream(info))))
        yield from ((index, piece) for piece in enumerate(_split(out)))

    return run


class Block:
    """The tokens of many texts: text number, symbol and its chance by itself, and whether it is for training."""

    def __init__(self, codes: tuple, facts: Facts):
        table, seen, at, lengths, train, self.info = codes
        lengths = _unpacked(lengths).astype(np.int64)
        self.facts, self.at, self.table, self.seen = facts, _unpacked(at).astype(np.int32), _unpacked(table), _unpacked(seen).astype(np.int64)
        self.end = int(np.flatnonzero(self.table == np.uint64(END_NUMBER))[0])  # each text has one
        self.texts, self.text = len(lengths), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.first = np.cumsum(lengths) - lengths
        self.training = np.repeat(np.unpackbits(np.frombuffer(train, dtype=np.uint8), count=len(lengths)).astype(bool), lengths)
        self.chance = (self.seen - facts.discount) / max(facts.n, 1)
        self.chance[0] = facts.shared

    def levels(self, replies: list[list[tuple]], depth: int) -> Iterator[Level]:
        """Level by level; ``replies`` by the context's length. Those of two symbols or more can be asked for together: the context of a token
        is the pair of the token in front of it, and it takes two admitted contexts that overlap to make a longer one."""
        width, least = self.facts.width, self.facts.least
        context = np.empty(len(self.at), dtype=np.int32)
        context[1:] = self.at[:-1]
        context[self.first] = self.end
        contexts, bits, occurrences = self.table, width, self.seen[context]
        at = np.flatnonzero(occurrences >= least)
        for k in range(1, depth + 1):
            own, of = _followed(contexts[context[at]], bits, self.table[self.at[at]], width)
            keys, pair = _distinct(_scattered(own, of), of)
            contexts, before = np.zeros(len(keys), dtype=np.uint64), contexts
            contexts[pair] = own
            del own
            found = None
            if k < len(replies):
                found = _counts(replies[k], len(keys))
                on = occurrences[at] >= least if k > 2 else slice(None)  # those of one and two symbols all are
                yield Level(k, at[on], context[at[on]], before, occurrences[at[on]], keys, of, pair[on], found[pair[on]])
                del on
            else:
                yield Level(k, at, context[at], before, occurrences[at], keys, of, pair, None)
                if k == 1:
                    return
            bits = of
            context = np.full(len(self.at), -1, dtype=np.int32)
            after = at + 1 < len(context)
            context[at[after] + 1] = pair[after]
            context[self.first] = -1
            del after, pair, keys, before
            if found is not None:
                occurrences = np.where(context >= 0, found[context] if len(found) else 0, 0)
            at = np.flatnonzero(occurrences >= least) if k == 1 else at[context[at] >= 0]


def _joined(rows: Iterator) -> list[bytes]:
    out, own = [], []
    for row in rows:
        own.append(bytes(row.codes))
        if row.last:
            out.append(b"".join(own))
            own = []
    return out


def _split(x: object) -> Iterator[bytes]:
    """A fixed number of pieces, so that the parts of two tables of such pieces fit together, and none is large for the JVM."""
    raw = pickle.dumps(x)
    step = len(raw) // PIECES + 1
    for k in range(PIECES):
        yield raw[k * step : (k + 1) * step]


def _whole(pieces: Iterator[bytes]) -> list:
    return pickle.loads(b"".join(pieces))


def _by_block(rows: Iterator[tuple[int, tuple | bytes]], kinds: int) -> Iterator[tuple[tuple, list[list[tuple]]]]:
    """Codes and replies, by kind, of each block of a part, from pieces of the blocks and replies."""
    pieces, replies = [], []
    for _, own in rows:
        (replies if isinstance(own, bytes) else pieces).append(own)
    blocks = _whole(piece for _, piece in sorted(pieces)) if pieces else []
    del pieces
    own = [[[] for _ in range(kinds)] for _ in blocks]
    for reply in replies:
        kind, number, *counts = pickle.loads(reply)
        own[number][kind].append(tuple(counts))
    del replies
    for number in range(len(blocks)):
        codes, blocks[number] = blocks[number], None
        yield pickle.loads(codes), own[number]
        own[number] = None
        trim()


def _request(kind: int, index: int, number: int, keys: np.ndarray, bits: int, times: np.ndarray, parts: int) -> Iterator[tuple[int, tuple]]:
    """(part, request): sorted keys by ranges, with their times in training texts."""
    bounds = np.array([(1 << bits) * p // parts for p in range(1, parts)], dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[part], cuts[part + 1])
        yield part, (kind, index, number, part, _steps(keys[own]), _packed(times[own]))


def _asked_words(parts: int):
    @_keeping_memory
    def run(index, pieces):
        for number, codes in enumerate(_whole(pieces)):
            words = Words(pickle.loads(codes))
            yield from _request(WORDS, index, number, words.keys, 64, words.times, parts)

    return run


def _asked(kinds: int, parts: int, facts: Facts, depth: int):
    """Of each block the distinct pairs after contexts of one symbol, or, when these are counted, of all longer ones."""

    @_keeping_memory
    def run(index, pieces):
        for number, (codes, replies) in enumerate(_by_block(pieces, kinds)):
            block = Block(codes, facts)
            for level in block.levels(replies, depth):
                if level.times is None:
                    times = np.bincount(level.pair, block.training[level.at], minlength=len(level.keys)).astype(np.int64)
                    yield from _request(level.k, index, number, level.keys, level.bits, times, parts)

    return run


def _counted(least: int):
    """(part of the blocks, reply): how often each key of a request occurs in all of them; of words also the numbers of symbols. To part -1 go the facts about the words."""

    @_keeping_memory
    def run(requests):
        kinds: dict[int, list[tuple]] = {}
        for _, (kind, *request) in requests:
            kinds.setdefault(kind, []).append(request)
        for kind, asked in kinds.items():
            times = [_unpacked(own) for *_, own in asked]
            keys, at = np.unique(np.concatenate([_from_steps(steps, len(own)) for (_, _, _, steps, _), own in zip(asked, times)]), return_inverse=True)
            total = np.bincount(at, np.concatenate(times)).astype(np.int64)
            if kind == WORDS:
                symbol = (total >= least) | ((keys == np.uint64(END_WORD)) & (total > 0))
                number = np.cumsum(symbol) - 1
                yield -1, pickle.dumps((asked[0][2], int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int(symbol.sum()), int(total[~symbol].sum())))
            cuts = np.cumsum([len(own) for own in times])[:-1]
            for (index, block, part, *_), own in zip(asked, np.split(at, cuts)):
                yield index, pickle.dumps((kind, block, part, _packed(total[own]), *([_packed(number[own][symbol[own]])] if kind == WORDS else [])))

    return run


def _facts(replies: DataFrame, parts: int, least: int) -> Facts:
    found = [pickle.loads(r.reply) for r in replies.where("part = -1").collect()]
    symbols = np.zeros(parts, dtype=np.int64)
    for part, _, _, _, count, _ in found:
        symbols[part] = count
    n, v, once, _, other = (sum(x[j] for x in found) for j in range(1, 6))
    return Facts(n, v, once, int(symbols.sum()), other, least, np.cumsum(symbols) - symbols + 2)  # after the end and the shared symbol


def _stretches(at: np.ndarray, length: int = 1 << 17) -> Iterator[slice]:
    return (slice(k, min(k + length, len(at))) for k in range(0, len(at), length))


def _gains(facts: Facts, depth: int, pull: float):
    """(key, suffix, gain) of contexts: bits that training tokens of a block gain, each left out of its own estimate, over the context's suffix. A suffix that the key tells is not given."""
    told = depth * facts.width < 64

    @_keeping_memory
    def run(pieces):
        for codes, replies in _by_block(pieces, depth + 1):
            block, before = Block(codes, facts), None
            columns = []
            shorter = np.zeros((2, len(block.at)))  # times and occurrences in the suffix
            suffixes = np.zeros(0 if told else len(block.at), dtype=np.int64)
            for level in block.levels(replies, depth):
                gain, seen, suffix = np.zeros(len(level.contexts)), np.zeros(len(level.contexts), dtype=bool), np.zeros(len(level.contexts), dtype=np.uint64)
                for some in _stretches(level.at):
                    own = np.flatnonzero(block.training[level.at[some]]) + some.start
                    at, times, occurrences, context = level.at[own], level.times[own], level.all[own], level.context[own]
                    root = block.chance[block.at[at]]
                    wide = root if level.k == 1 else (shorter[0][at] + pull * root) / (shorter[1][at] + pull)
                    gain += np.bincount(context, np.log2((times - 1 + pull * wide) / (occurrences - 1 + pull) / wide), minlength=len(gain))
                    seen[context] = True
                    if level.k > 1 and not told:
                        suffix[context] = suffixes[at]
                some = np.flatnonzero(seen)
                if level.k > 1 and not told:
                    suffix[some] = _named(before[suffix[some]], level.k - 1, facts.width, depth)
                columns.append((_named(level.contexts[some], level.k, facts.width, depth), suffix[some], gain[some]))
                if level.k < depth:
                    shorter[0][level.at], shorter[1][level.at] = level.times, level.all
                    if not told:
                        suffixes[level.at], before = level.context, level.contexts
                level = None  # gone before the next one is made
            key, suffix, gain = (np.concatenate(x) for x in zip(*columns))
            rows = pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in ([key] if told else [key, suffix])] + [pa.array(gain, pa.float64())], ["key", "gain"] if told else ["key", "suffix", "gain"])
            for some in _stretches(key, 1 << 14):
                yield _stream(rows.slice(some.start, some.stop - some.start))

    return run


def _gained(gains: RDD, spark: SparkSession, facts: Facts, depth: int) -> DataFrame:
    """(key, suffix, gain), each context once."""
    if depth * facts.width >= 64:
        return _table(gains, spark, "key long, suffix long, gain double").groupBy("key").agg(F.max("suffix").alias("suffix"), F.sum("gain").alias("gain"))

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_suffixes(keys, facts.width, depth).view(np.int64)), batch.column(1)], ["key", "suffix", "gain"])

    return _table(gains, spark, "key long, gain double").groupBy("key").agg(F.sum("gain").alias("gain")).mapInArrow(run, "key long, suffix long, gain double")


def kept_states(gained: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the contexts of (key, suffix, gain), those that gain enough and their suffixes: bits that all of them pass, and which others pass too.

    The bits are doubled until at most ``most`` others do.
    """
    states = stored(gained, "states")
    own = kept = states.where(F.col("gain") >= divergence)
    for _ in range(depth - 1):
        wanted = kept.select(F.col("suffix").alias("key")).union(own.select("key")).distinct()
        kept = states.join(wanted, "key", "left_semi")
    kept = stored(kept.select("key"), "kept")
    size, most = GATE_BITS, INLINE if most is None else most
    while True:
        bits = gate(kept, size)
        sent = states.sparkSession.sparkContext.broadcast(bits)

        def run(batches, sent=sent):
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys[passes(sent.value, keys.view(np.uint64))])], ["key"])

        others = stored(states.join(kept, "key", "left_anti").select("key").mapInArrow(run, "key long"), "others")
        sent.unpersist()
        if size >= 30 or others.count() <= most:
            return bits, np.sort(others.toArrow()["key"].to_numpy().astype(np.int64).view(np.uint64))
        size += 1


def _scored(states, facts: Facts, depth: int, pull: float):
    """Of every text id, tokens, known tokens, base sum and score: its words' chances, and what each kept context on the way adds to the chance of the symbol after it."""

    @_keeping_memory
    def run(pieces):
        bits, others = states.value
        for codes, replies in _by_block(pieces, depth + 1):
            block = Block(codes, facts)
            lower, score = block.chance[block.at], np.zeros(block.texts)
            for level in block.levels(replies, depth):
                used = np.flatnonzero(np.bincount(level.context, minlength=len(level.contexts)))
                named, kept = _named(level.contexts[used], level.k, facts.width, depth), np.zeros(len(level.contexts), dtype=bool)
                kept[used] = passes(bits, named) & ~_among(others, named)[0]
                for some in _stretches(level.at):
                    on = np.flatnonzero(kept[level.context[some]]) + some.start
                    at, times, occurrences = level.at[on], level.times[on], level.all[on]
                    before = lower[at]
                    lower[at] = (times + pull * before) / (occurrences + pull)
                    score += np.bincount(block.text[at], np.log10((times / before + pull) / (occurrences + pull)), minlength=block.texts)
                level = None
            info = pa.ipc.open_stream(block.info).read_next_batch()
            yield from zip(*(x.to_pylist() for x in info.columns[:4]), (info.column(4).to_numpy() + score).tolist())

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Blocks of texts are stored and stay where they are. Their distinct words, then pairs of context and symbol, go out by ranges of keys, packed, and the counts
    come back to the part of the blocks that asked, in the same order.
    """
    spark, one = docs.sparkSession, BatchedSerializer(CPickleSerializer(), 1)  # of one size, what is zipped needs no further worker
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = texts.select("doc_id", "text", F.expr(f"not ({FOLD})")).mapInArrow(_coded(BLOCK), "codes binary, last boolean").rdd
    base = blocks.mapPartitions(lambda rows: _split(_joined(rows)))._reserialize(one).persist(StorageLevel.DISK_ONLY)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, count = max(shuffle_partitions(spark), size // PART + 1), max(1, base.getNumPartitions())

    def counted(requests):
        return stored(spark.createDataFrame(requests.partitionBy(parts).mapPartitions(_counted(LEAST)), "part int, reply binary"), "replies", "uncompressed")

    def replies(*tables):
        return functools.reduce(DataFrame.union, tables).where("part >= 0").rdd.map(lambda r: (r.part, bytes(r.reply))).partitionBy(count)

    def beside(own, *tables):
        """The blocks with what was counted for them, part by part as both are dealt out alike."""
        both = own.union(replies(*tables))
        if both.getNumPartitions() != own.getNumPartitions():
            raise RuntimeError("blocks and counts are dealt out differently")
        return both

    words = counted(base.mapPartitionsWithIndex(_asked_words(parts)))
    facts = _facts(words, parts, LEAST)
    own = replies(words)
    more = own.getNumPartitions() - base.getNumPartitions()  # a session may deal out to more parts than asked for
    parted = base.union(spark.sparkContext.parallelize([], more).mapPartitions(lambda _: _split([]))._reserialize(one)) if more > 0 else base
    parted = parted.zip(own.mapPartitions(lambda rows: _split([reply for _, reply in rows]))._reserialize(one))
    numbered = parted.mapPartitionsWithIndex(_numbered(facts)).partitionBy(count)
    pairs = counted(numbered.mapPartitionsWithIndex(_asked(1, parts, facts, DEPTH)))
    base.unpersist()
    longer = counted(beside(numbered, pairs).mapPartitionsWithIndex(_asked(2, parts, facts, DEPTH)))
    joined = beside(numbered, pairs, longer)
    states = spark.sparkContext.broadcast(kept_states(_gained(joined.mapPartitions(_gains(facts, DEPTH, PULL)), spark, facts, DEPTH), DEPTH, DIVERGENCE))
    found = stored(spark.createDataFrame(joined.mapPartitions(_scored(states, facts, DEPTH, PULL)), "doc_id long, n_tokens long, n_known long, base_score double, score double"), "scored")
    return found.select("doc_id", F.expr(FOLD).alias("held_out"), "n_tokens", "n_known", F.lit(facts.n).cast("long").alias("train_tokens"), "base_score", "score")
