"""Secret scans whose false positives a random forest removes.

A candidate is a run of at least ``SHORTEST`` characters of [A-Za-z0-9+/_=.-] with a digit in it; a value of any length and characters,
quoted or unbroken, after a name of secrets with : or =; or the password part of an address. Its features are its length, the
shares of character classes and of changes between them, entropy, how well the letters follow the letter triples of ordinary words,
path and address marks, and the words before it. The dictionary is the number of times each of 26 ** 3 letter triples occurs in the
words of all texts, a table of fixed size.

The forest is trained on labelled findings (id, start, end, secret). ``known_findings`` makes them where there are none: candidates in
formats that are only secrets, or only not, are labelled, and the format itself is no feature. What has the format of no secret but
stands after the name of one is left to the forest, and so is the password part of an address. Training takes at most ``SAMPLE``
findings, those with the smallest hash.

Defined cases: null and empty texts have no candidates. Null ids keep their rows. Repeated rows give repeated findings. Without
both kinds of finding every candidate gets their share (0.5 without findings). Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored
from tablewright.llm.words import spans, text_slices

SHORTEST = 12
SAMPLE = 20000
TREES, TREE_DEPTH = 24, 6
FEATURES = ["length", "digits", "upper", "lower", "marks", "changes", "entropy", "dictionary", "distinct", "slashes", "dots", "only_digits", "hex", "assigned", "quoted", "named", "named_near", "address"]
COLUMNS = ["doc_id", "start", "end", "candidate", *FEATURES]
_ASSIGNED, _NAMED, _ADDRESS = (FEATURES.index(f) for f in ("assigned", "named", "address"))
SCHEMA = "doc_id long, start long, end long, candidate string, " + ", ".join(f"{f} double" for f in FEATURES)

_RUN = re.compile(r"[A-Za-z0-9+/_=.\-]{%d,}" % SHORTEST)
_NAME = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer", re.I)
#: A word with : or = after it, the value there, and the password part of an address, in bytes
_SET = re.compile(rb"(?<![A-Za-z0-9_.\-])([A-Za-z0-9_.\-]++)[\"'`\])]{0,2}\s*+[:=]{1,2}>?\s*+")
_VALUE = re.compile(rb"\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|[\"'`]?([^\s\"'`]\S*)")
_LOGIN = re.compile(rb"://[^\s/?#@:]*:([^\s/?#]+)@")
_AFTER_VALUE = b".,;\"'`)]}>"
_HEX = re.compile(r"[0-9a-f]+")
_OTHER = np.ones(256, dtype=bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 95, 61, 46, 45]] = False
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True

#: Formats with one reading: fixed patterns of key ids, key assignments, and of numbers that are no secrets.
SECRET_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\..*)$"
OTHER_FORMATS = r"^([0-9 .+-]+|v?[0-9]+(\.[0-9]+)+.*|[a-z.]+[0-9]{1,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}.*|(https?|www)[^ ]*)$"
SECRET_CONTEXT = r"(?i)(password|passwd|secret|token|api_?key)\s*[:=]\s*\"?$"


def triple_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the letter triples in some bytes."""
    letter = np.full(256, -1, dtype=np.int64)
    letter[97:123] = letter[65:91] = np.arange(26)
    x = letter[data]
    if len(x) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = np.flatnonzero((x[:-2] >= 0) & (x[1:-1] >= 0) & (x[2:] >= 0))
    return at, x[at] * 676 + x[at + 1] * 26 + x[at + 2]


def _triples(batches: Iterator[pa.RecordBatch]):
    total = np.zeros(26**3, dtype=np.int64)
    for batch in batches:
        for _, data, _ in text_slices(batch.column(0)):
            total += np.bincount(triple_numbers(data)[1], minlength=26**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["triple", "times"])


def dictionary(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log of how often each letter triple occurs in all texts, against an even spread."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_triples, "triple long, times long").groupBy("triple").agg(F.sum("times").alias("times")).collect()
    counts = np.ones(26**3)
    for row in rows:
        counts[row.triple] += row.times
    return np.log2(counts * 26**3 / counts.sum())


def describe(candidate: str, before: str, after: str, triples: np.ndarray) -> list[float]:
    """``FEATURES`` of one candidate."""
    data = np.frombuffer(candidate.encode(), dtype=np.uint8)
    n = len(data)
    kinds = np.select([(data >= 48) & (data < 58), (data >= 65) & (data < 91), (data >= 97) & (data < 123)], [0, 1, 2], 3)
    shares = np.bincount(kinds, minlength=4) / n
    share = np.unique(data, return_counts=True)[1] / n
    _, own = triple_numbers(data)
    words = before.split()
    previous = words[-1] if words and not before[-1:].isspace() else ""
    near = " ".join(words[-3:])
    return [
        float(n), *shares.tolist(), float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0, float(-(share * np.log2(share)).sum()),
        float(triples[own].mean()) if len(own) else -8.0, float(len(share) / n), float(candidate.count("/")), float(candidate.count(".")), float(shares[0] == 1),
        float(bool(_HEX.fullmatch(candidate.split("=")[-1]))), float(bool(re.search(r"[=:]\s*\"?$", before)) or "=" in candidate[1:-2]), float(before[-1:] in "\"'`" and bool(before)),
        float(bool(_NAME.search(previous + candidate.split("=")[0] if "=" in candidate else previous))), float(bool(_NAME.search(near))),
        float("@" in before[-40:].split(" ")[-1] or after[:1] == "@" or "://" in before[-40:].split(" ")[-1]),
    ]


def _named_values(data: bytes, starts: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """First byte and end of every value after a name of secrets, and of the password part of every address, which is told."""
    for found in _SET.finditer(data):
        if _NAME.search(found[1].decode()):
            text = int(np.searchsorted(starts, found.start(), "right"))
            stop = int(starts[text]) - 1
            value = _VALUE.match(data, found.end(), stop) if found.end() < stop else None
            if value:
                kind = value.lastindex
                a, b = value.span(kind)
                if kind == 4:
                    b = a + len(value[4].rstrip(_AFTER_VALUE))
                if b > a:
                    yield a, b, False
    for found in _LOGIN.finditer(data):
        yield *found.span(1), True


def _candidates(triples: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = []
            for row, data, starts in text_slices(batch.column(1)):
                first, last = spans(data, _OTHER)
                digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
                take = (last - first >= SHORTEST) & (digits[last] > digits[first])
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                found = {}  # (first byte, end): after a name of secrets, password part of an address
                for a, b in zip(first[take].tolist(), last[take].tolist()):
                    own = data[a:b].tobytes().decode()
                    # a name and its value, as in password=..., are one run; the value is the candidate
                    cut = own.find("=") + 1
                    if 0 < cut <= len(own) - 8 and _NAME.search(own[:cut]):
                        a, own = a + cut, own[cut:]
                    found[a, a + len(own.rstrip(".="))] = (False, False)
                for a, b, login in _named_values(data.tobytes(), starts):
                    found[a, b] = (True, login or found.get((a, b), (False, False))[1])
                for (a, b), (named, login) in sorted(found.items()):
                    t = int(np.searchsorted(starts, a, "right")) - 1
                    begin, stop = int(starts[t]), int(starts[t + 1]) - 1
                    own = data[a:b].tobytes().decode()
                    before = data[max(begin, a - 80) : a].tobytes().decode(errors="ignore")
                    after = data[b : min(stop, b + 20)].tobytes().decode(errors="ignore")
                    features = describe(own, before, after, triples) if own else [0.0] * len(FEATURES)
                    if named:
                        features[_ASSIGNED] = features[_NAMED] = 1.0
                    if login:  # not the address, but what it hides
                        features[_ADDRESS] = 0.0
                    rows.append((batch.column(0)[row + t].as_py(), int(points[a] - points[begin]), int(points[b] - points[begin]), own, features, bool(re.search(SECRET_CONTEXT, before)), login))
            values = np.array([r[4] for r in rows], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string()),
                *[pa.array(v, pa.float64()) for v in values.T], pa.array([r[5] for r in rows], pa.bool_()), pa.array([r[6] for r in rows], pa.bool_()),
            ], [*COLUMNS, "secret_context", "login"])

    return run


def candidates(docs: DataFrame, triples: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per candidate of every text, stored: doc_id, start, end (code points), candidate, features, whether a name of secrets stands before it, and whether it is the password part of an address."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(texts.mapInArrow(_candidates(triples), SCHEMA + ", secret_context boolean, login boolean"), "candidates")


def known_findings(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, secret) of the candidates whose format or context has one reading only."""
    secret = F.col("candidate").rlike(SECRET_FORMATS) | (F.col("secret_context") & (F.col("length") >= 16) & F.col("candidate").rlike(r"^\S*[0-9]\S*$"))
    other = (F.col("candidate").rlike(OTHER_FORMATS) | (F.col("address") == 1)) & ~F.col("secret_context") & ~F.col("login")
    return found.withColumn("secret", F.when(secret & ~other, 1).when(other & ~secret, 0)).where("secret is not null").select("doc_id", "start", "end", "secret")


def judged(found: DataFrame, findings: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``found`` with ``chance`` and ``secret`` from a forest trained on ``findings`` (doc_id, start, end, secret)."""
    known = findings.where("secret in (0, 1)").groupBy("doc_id", "start", "end").agg(F.max("secret").cast("double").alias("label"))
    rows = found.join(known, ["doc_id", "start", "end"]).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(sample)
    rows = stored(rows.select("label", *FEATURES), "findings")
    kinds = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(kinds) < 2:
        share = next(iter(kinds)) if kinds else 0.5
        return found.withColumn("chance", F.lit(float(share))).withColumn("secret", F.col("chance") >= 0.5)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH, maxBins=32, featureSubsetStrategy="sqrt", seed=7)
    model = forest.fit(vector.transform(rows).select("label", "features"))
    out = model.transform(vector.transform(found)).withColumn("chance", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction").withColumn("secret", F.col("chance") >= 0.5)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """Row per candidate: doc_id, start, end, candidate, chance, secret."""
    found = candidates(docs, dictionary(docs, text_col), id_col, text_col)
    return judged(found, known_findings(found) if findings is None else findings).select("doc_id", "start", "end", "candidate", "chance", "secret")
