"""Benchmark decontamination with a distributed positional inverted index.

*Index.* Texts are cut into blocks of about ``BLOCK`` words (whole texts, so a longer text is a block of its own). A row of the
index is (block, term, positions): where a term stands in the block's running word count. Only terms of the test
set are stored; no other term can be part of a match. A second kind of row lists the block's texts with their first
position and length. The index is a table of the shared folder.

*Search.* A query is a window of a test item: ``window`` consecutive words, or the whole item if it is shorter. In each block,
every window starts from the position list of its rarest term there, shifted by that term's offset, and is intersected with the
offset-adjusted lists of the other terms, rarest first, until nothing or an exact phrase is left. All windows advance together.
Occurrences that agree in their ``NEAR_TERMS`` rarest terms up to ``slop`` positions, but are no exact phrase, are proximity
matches.

The test set is sent to the blocks in slices of about ``SENT_WORDS`` words, so a broadcast never grows with the data; every slice
searches the same stored index, and the hit ranges of all slices are united per text.

Words are runs of digits, letters a-z (A-Z count as a-z) and characters outside ASCII.

Defined cases: null and empty texts have no words, no hits and are not contaminated; null and empty items have no
windows; a null item id counts as an item but is not listed. A repeated id stays a row per text. An empty test set
hits nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored
from tablewright.llm.words import slice_words, text_slices, word_hashes

BLOCK = 1 << 19
SENT_WORDS = 1 << 18
WINDOW = 13
SLOP = 4
NEAR_TERMS = 3
GAP = np.ones(256, dtype=bool)
GAP[48:58] = GAP[97:123] = GAP[128:] = False

INDEX = "block string, term long, positions binary, doc_id long, first long, n_words long"
HITS = "block string, first long, doc_id long, n_words long, n_near long, n_items long, items array<string>, ranges array<struct<a:long,b:long>>"


class TestSet:
    """Windows of test items as arrays, equal windows kept once.

    ``terms``: sorted distinct word hashes; ``at`` (windows x width): index of each word in ``terms``, -1 past the end of a short
    window; ``length`` of each window; ``owners``: the item numbers of each window; ``names``: the items' ids.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        words = [word_hashes(text, gap=GAP) for _, text in items]
        self.names = [name for name, _ in items]
        self.terms = np.unique(np.concatenate([*words, np.empty(0, dtype=np.uint64)]))
        owners: dict[tuple, set[int]] = {}
        for item, own in enumerate(words):
            place = np.searchsorted(self.terms, own).tolist()
            for i in range(max(len(place) - window, 0) + 1 if place else 0):
                owners.setdefault(tuple(place[i : i + window]), set()).add(item)
        self.at = np.full((len(owners), window), -1, dtype=np.int64)
        for i, key in enumerate(owners):
            self.at[i, : len(key)] = key
        self.length = (self.at >= 0).sum(axis=1)
        self.owners = [np.array(sorted(x)) for x in owners.values()]


def _index(terms: np.ndarray):
    def rows(block, data):
        names = [f.split()[0] for f in INDEX.split(", ")]
        term, positions, ids, first, words = data
        k, d = len(term), len(ids)
        return pa.RecordBatch.from_arrays([
            pa.array([block] * (k + d), pa.string()),
            pa.concat_arrays([pa.array(term.view(np.int64), pa.int64()), pa.nulls(d, pa.int64())]),
            pa.concat_arrays([pa.array([p.astype(np.int32).tobytes() for p in positions], pa.binary()), pa.nulls(d, pa.binary())]),
            pa.concat_arrays([pa.nulls(k, pa.int64()), ids]),
            pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(first, pa.int64())]),
            pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(words, pa.int64())]),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]):
        held, ids, counts, made = [], [], [], 0

        def flush():
            nonlocal held, ids, counts, made
            place = np.concatenate(held)
            words = np.concatenate(counts)
            known = np.flatnonzero(place >= 0)
            order = known[np.argsort(place[known], kind="stable")]
            own, at = np.unique(place[order], return_index=True)
            name = f"{TaskContext.get().partitionId()}-{made}"
            out = rows(name, (terms[own], np.split(order, at[1:]) if len(own) else [], pa.concat_arrays(ids), np.cumsum(words) - words, words))
            held, ids, counts, made = [], [], [], made + 1
            return out

        for batch in batches:
            for row, data, starts in text_slices(batch.column(1)):
                text, _, _, words = slice_words(data, starts, gap=GAP)
                place = np.full(len(words), -1, dtype=np.int64)
                if len(terms):
                    near = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
                    hit = terms[near] == words
                    place[hit] = near[hit]
                held.append(place)
                ids.append(batch.column(0).slice(row, len(starts) - 1))
                counts.append(np.bincount(text, minlength=len(starts) - 1))
                if sum(map(len, held)) >= BLOCK:
                    yield flush()
        if ids:
            yield flush()

    return run


def occurrences(tests: TestSet, postings: dict[int, np.ndarray], total: int, first: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact and near occurrences in one block: (window, start) of both kinds, within one text each.

    ``postings``: sorted positions per term number; ``first``: the first position of every text, ``total`` the number of words.
    """
    nothing = np.empty(0, dtype=np.int64)
    counts = np.zeros(len(tests.terms) + 1, dtype=np.int64)
    for term, positions in postings.items():
        counts[term] = len(positions)
    own = np.array(sorted(postings), dtype=np.int64)
    if not len(own) or not len(tests.at):
        return nothing, nothing, nothing, nothing
    starts = np.zeros(len(counts), dtype=np.int64)
    starts[own] = np.cumsum(counts[own]) - counts[own]
    lists = np.concatenate([postings[t] for t in own.tolist()]).astype(np.int64)
    span = total + 1
    keys = np.repeat(own, counts[own]) * span + lists  # every (term, position), sorted
    sizes = np.where(tests.at >= 0, counts[tests.at], np.iinfo(np.int64).max)
    order = np.argsort(sizes, axis=1, kind="stable")  # each window's words, rarest in this block first
    alive = np.flatnonzero(sizes.min(axis=1) > 0)
    rarest = order[alive, 0]
    reach = sizes[alive, rarest]
    window = np.repeat(alive, reach)
    inner = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    start = lists[np.repeat(starts[tests.at[alive, rarest]], reach) + inner] - np.repeat(rarest, reach)
    end = np.append(first[1:], total)
    text = np.searchsorted(first, start, "right") - 1
    inside = (start >= 0) & (text >= 0)
    inside[inside] = start[inside] + tests.length[window[inside]] <= end[text[inside]]
    # the near candidates: each of the next rarest terms within slop of its place
    near_window, near_start = window, start
    for k in range(1, min(NEAR_TERMS, tests.at.shape[1]) if slop else 0):
        offset = order[near_window, k]
        term = tests.at[near_window, offset]
        at = term * span + near_start + offset
        low = np.searchsorted(keys, np.maximum(at - slop, term * span))
        ok = (term < 0) | (low < np.searchsorted(keys, np.minimum(at + slop, term * span + total), "right"))
        near_window, near_start = near_window[ok], near_start[ok]
    window, start = window[inside], start[inside]
    for k in range(1, tests.at.shape[1]):
        if not len(window):
            break
        offset = order[window, k]
        term = tests.at[window, offset]
        at = term * span + start + offset
        ok = (term < 0) | (keys[np.minimum(np.searchsorted(keys, at), len(keys) - 1)] == at)
        window, start = window[ok], start[ok]
    if not slop:
        return window, start, nothing, nothing
    exact = np.isin(near_window * span + near_start, window * span + start)
    return window, start, near_window[~exact], near_start[~exact]


def _search(tests: TestSet, slop: int):
    def run(table: pa.Table) -> pa.Table:
        is_text = np.asarray(table["term"].is_null())
        texts = table.filter(pa.array(is_text)).sort_by("first")
        terms = table.filter(pa.array(~is_text))
        first, n_words = texts["first"].to_numpy(), texts["n_words"].to_numpy()
        total = int(n_words.sum())
        # texts without words share their first position with the next text and can't hold a match
        with_words = np.flatnonzero(n_words)
        place = np.searchsorted(tests.terms, terms["term"].to_numpy().astype(np.int64).view(np.uint64))
        postings = {}
        for t, h, p in zip(place.tolist(), terms["term"].to_pylist(), terms["positions"].to_pylist()):
            if t < len(tests.terms) and int(tests.terms[t]) == h % 2**64:
                postings[t] = np.frombuffer(p, dtype=np.int32)
        window, start, near_window, near_start = occurrences(tests, postings, total, first[with_words], slop)
        cover = np.zeros(total + 1, dtype=np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + tests.length[window], -1)
        covered = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        runs_from, runs_to = edges[::2], edges[1::2]
        ranges: dict[int, list[dict[str, int]]] = {}
        for a, b in zip(runs_from.tolist(), runs_to.tolist()):
            d = int(np.searchsorted(first[with_words], a, "right")) - 1
            while a < b:  # a run of hits may go on into the next text
                stop = min(b, int(first[with_words[d]] + n_words[with_words[d]]))
                ranges.setdefault(int(with_words[d]), []).append({"a": a, "b": stop})
                a, d = stop, d + 1
        found: dict[int, set[int]] = {}
        near: dict[int, int] = {}
        owner = with_words[np.searchsorted(first[with_words], start, "right") - 1] if len(start) else start
        for d, w in set(zip(owner.tolist(), window.tolist())):
            found.setdefault(d, set()).update(tests.owners[w].tolist())
        ok = (near_start >= first[with_words[0]]) & (near_start < total) if len(with_words) else np.zeros(0, dtype=bool)
        close = with_words[np.searchsorted(first[with_words], near_start[ok], "right") - 1] if ok.any() else np.empty(0, dtype=np.int64)
        for d, _ in set(zip(close.tolist(), near_window[ok].tolist())):
            near[d] = near.get(d, 0) + 1
        ids = [sorted(found.get(d, ())) for d in range(len(n_words))]
        return pa.table({
            "block": texts["block"], "first": texts["first"], "doc_id": texts["doc_id"], "n_words": pa.array(n_words, pa.int64()),
            "n_near": pa.array([near.get(d, 0) for d in range(len(n_words))], pa.int64()), "n_items": pa.array([len(x) for x in ids], pa.int64()),
            "items": pa.array([sorted({tests.names[i] for i in x if tests.names[i] is not None}) for x in ids], pa.list_(pa.string())),
            "ranges": pa.array([ranges.get(d, []) for d in range(len(n_words))], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
        })

    return run


def positional_index(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all texts for the given sorted term hashes (see the module's text)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(texts.mapInArrow(_index(terms), INDEX), "positions")


def _slices(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, str | None]]]:
    held, words = [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        held.append((row[0], row[1]))
        words += len(row[1] or "") // 4
        if words >= SENT_WORDS:
            yield held
            held, words = [], 0
    yield held


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP, percent: int = 5) -> DataFrame:
    """Row per text: ``n_words``, ``n_hit`` (words inside an exact match), ``n_near`` (windows matched only nearly), ``n_items`` and
    ``items`` (ids of test items with an exact match, each once; items without an id count their hits only), ``contaminated``: 100 * n_hit >= ``percent`` * n_words, and any hit.
    """
    words = [np.empty(0, dtype=np.uint64)]
    for part in _slices(items, item_id, item_text):
        words = [np.unique(np.concatenate([*words, *(word_hashes(text, gap=GAP) for _, text in part)]))]
    index = positional_index(docs, np.unique(words[0]), id_col, text_col)
    parts = [index.groupBy("block").applyInArrow(_search(TestSet(part, window), slop), HITS) for part in _slices(items, item_id, item_text)]
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.union(part)
        # texts without words may share a first position; they have nothing to unite, so any one of their rows stands for one text
        found = found.groupBy("block", "first", "doc_id", "n_words").agg(
            F.sum("n_near").alias("n_near"), F.sum("n_items").alias("n_items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"))
    # ranges are sorted; what a range adds is its part after the end of all before it
    found = found.withColumn("n_hit", F.expr("aggregate(ranges, named_struct('n', 0L, 'e', -1L), (s, r) -> named_struct('n', s.n + greatest(r.b - greatest(r.a, s.e), 0L), 'e', greatest(s.e, r.b)), s -> s.n)"))
    return found.select("doc_id", "n_words", "n_hit", "n_near", F.size("items").cast("long").alias("n_items"), "items", F.expr(f"n_hit > 0 and 100 * n_hit >= {percent} * n_words").alias("contaminated"))
