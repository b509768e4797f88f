"""Personal data by weak supervision, in DataFrame operations alone.

*Spans.* Strict patterns give the base spans: email, ip, card, phone, leftmost and without overlap per kind, checked after matching.
Looser patterns add candidates: addresses written out with (at) and (dot), and phone and card numbers with other separators.

*Votes.* Every candidate, strict or loose, gets a vote (1, 0, -1) from each labeler: the strict pattern with its check, the
form of its numbers, a gazetteer (domain endings, first digits of issuers, private networks), words before it that announce personal
data, words before it that announce another number, and the characters beside it.

*Reliabilities.* Votes are counted per pattern of votes, a table of at most 4 * 3 ** 6 rows whatever the data. Expectation-maximisation
on that table estimates how each labeler votes on true and on false spans, and each pattern's chance to be true. A logistic span
classifier, trained on the chances, weighs the votes within a kind; a loose candidate that it gives ``ACCEPT`` or more and that
overlaps no base span becomes a span too. Base spans stay, whatever it says.

Texts are read once: each text's candidates with their votes are stored, then judged by an expression.

Defined cases: null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows and null ids keep their
rows. Without candidates nothing is learned and nothing added. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored

KINDS = ["email", "ip", "card", "phone"]
ACCEPT = 0.9
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A match may only start where a run of its first class starts, or where the match before ended; this keeps long runs linear.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # shorter ones fail the check on digits in any case
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?i)(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?[(\[]at[)\]] ?{_LABEL}++(?: ?(?:[(\[]dot[)\]]|\.) ?{_LABEL}++)++",
    "card": r"(?<![0-9./_])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9./_])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
#: What a text must hold for a pattern to be worth looking for.
HINTS = {"email": "[@]", "ip": "[0-9][.][0-9]", "card": "[0-9](?:[ -]?[0-9]){13}", "phone": "[+][0-9]"}
LOOSE_HINTS = {"email": r"(?i)[(\[]at[)\]]", "card": "[0-9]{4}[._/][0-9]{4}[._/]", "phone": "[0-9]{3}[)]? ?[ .-]?[0-9]{3}[ .-][0-9]{4}"}
ENDINGS = "com|net|org|edu|gov|info|biz|io|co|de|fr|es|uk|us|eu|it|nl|ch|at"
CUES = "e-?mail|contact|write|reach|phone|tel|call|fax|mobile|cell|whatsapp|card|visa|master|credit|payment|ip|host|login|from"
OTHER_CUES = "order|invoice|isbn|issn|version|serial|ref|ticket|item|sku|page|article|build"
LABELERS = ["strict", "form", "gazetteer", "cue", "other_cue", "beside"]
_IP = "^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]|$)){4}$"
_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_VALID = {
    "email": "true", "ip": f"x rlike '{_IP}'", "card": f"length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
_FORM = {
    "email": "if(length(x) between 6 and 100, 1, -1)", "ip": f"if(x rlike '{_IP}', 1, -1)",
    "card": f"if(length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS}), 1, -1)", "phone": f"if(length({_DIGITS}) between 10 and 15, if({_DIGITS} rlike '^(.)\\\\1+$', -1, 1), -1)",
}
_GAZETTEER = {
    "email": f"if(lower(x) rlike '[.) ]({ENDINGS})$', 1, 0)", "ip": "if(x rlike '^(0|127|255)[.]', -1, 0)",
    "card": "if(x rlike '^(3[4-7]|4|5[1-5]|6)', 1, -1)", "phone": f"if({_DIGITS} rlike '^(1|2|3|4|5|6|7|8|9)', 0, -1)",
}


def _matches(text: Column, pattern: str, hint: str, name: str) -> list[Column]:
    """The matches of a pattern and the pieces of text between them."""
    none = F.array().cast("array<string>")
    has = text.rlike(hint)
    return [F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m_{name}"), F.when(has, F.split(text, pattern, -1)).otherwise(none).alias(f"p_{name}")]


def _voted(kind: str, name: str, strict: bool) -> Column:
    """Candidates of one pattern: place, kind, whether it is a base span, and the votes."""
    m, p = f"m_{name}", f"p_{name}"
    lengths, pieces = f"ml_{name}", f"pl_{name}"
    start = f"aggregate(slice({pieces}, 1, i + 1), 0, (a, b) -> a + b) + aggregate(slice({lengths}, 1, i), 0, (a, b) -> a + b)"
    before, after = f"right({p}[i], 40)", f"left({p}[i + 1], 2)"
    valid = _VALID[kind] if strict else "false"
    strict_vote = f"if({_VALID[kind]}, 1, -1)" if strict else "0"
    return F.expr(f"""transform({m}, (x, i) -> named_struct('s', cast({start} as int), 'k', {KINDS.index(kind)}, 'e', cast({start} + length(x) as int), 'base', {valid}, 'loose', {str(not strict).lower()},
        'strict', {strict_vote}, 'form', {_FORM[kind]}, 'gazetteer', {_GAZETTEER[kind]}, 'cue', if(lower({before}) rlike '(^|[^a-z])({CUES})[^a-z]', 1, 0),
        'other_cue', if(lower({before}) rlike '(^|[^a-z])({OTHER_CUES})[^a-z]', -1, 0), 'beside', if({before} rlike '[A-Za-z0-9]$' or {after} rlike '^[A-Za-z0-9]', -1, 0)))""")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): every text's candidates, sorted by place; stored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    patterns = [(kind, kind, True, STRICT[kind], HINTS[kind]) for kind in KINDS] + [(kind, f"loose_{kind}", False, LOOSE[kind], LOOSE_HINTS[kind]) for kind in LOOSE]
    rows = rows.select("doc_id", *[c for _, name, _, pattern, hint in patterns for c in _matches(F.col("t"), pattern, hint, name)])
    names = [name for _, name, _, _, _ in patterns]
    rows = rows.select("*", *[F.transform(f"m_{n}", F.length).alias(f"ml_{n}") for n in names], *[F.transform(f"p_{n}", F.length).alias(f"pl_{n}") for n in names])
    return stored(rows.select("doc_id", F.array_sort(F.concat(*[_voted(kind, name, strict) for kind, name, strict, _, _ in patterns])).alias("found")), "candidates")


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], list[list[list[float]]]]:
    """Chance to be true per (kind, votes, times), and per labeler the chances of its votes -1, 0, 1 on false and true spans."""
    chance = [1 / (1 + math.exp(-sum(v))) for _, v, _ in patterns]
    votes: list[list[list[float]]] = []
    for _ in range(rounds):
        votes = [[[1.0] * 3, [1.0] * 3] for _ in LABELERS]
        kinds = {k: [1.0, 1.0] for k, _, _ in patterns}
        for (k, v, n), p in zip(patterns, chance):
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                kinds[k][y] += w
                for j, x in enumerate(v):
                    votes[j][y][x + 1] += w
        votes = [[[x / sum(side) for x in side] for side in labeler] for labeler in votes]
        new = []
        for k, v, _ in patterns:
            side = [math.log(kinds[k][y]) + sum(math.log(votes[j][y][x + 1]) for j, x in enumerate(v)) for y in (0, 1)]
            new.append(1 / (1 + math.exp(max(-50.0, min(50.0, side[0] - side[1])))))
        chance = new
    return chance, votes


def span_classifier(patterns: list[tuple[int, tuple[int, ...], int]], chance: list[float], rounds: int = 50) -> tuple[list[float], list[tuple[float, float]]]:
    """Logistic weights: one per kind, and one per labeler for votes 1 and -1, fitted to soft labels by Newton steps."""
    rows = np.zeros((len(patterns), len(KINDS) + 2 * len(LABELERS)))
    for i, (k, v, _) in enumerate(patterns):
        rows[i, k] = 1
        for j, x in enumerate(v):
            rows[i, len(KINDS) + 2 * j] = x == 1
            rows[i, len(KINDS) + 2 * j + 1] = x == -1
    times, label, weights = np.array([n for _, _, n in patterns], dtype=float), np.array(chance), np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        curve = (rows * (times * p * (1 - p))[:, None]).T @ rows + np.eye(len(weights))
        move = np.linalg.solve(curve, rows.T @ (times * (label - p)) - weights)
        weights = weights + np.clip(move, -2, 2)
    return weights[: len(KINDS)].tolist(), [(float(a), float(b)) for a, b in weights[len(KINDS) :].reshape(-1, 2)]


def train(found: DataFrame) -> tuple[list[float], list[tuple[float, float]]]:
    """The span classifier of all stored candidates."""
    rows = found.select(F.explode("found").alias("c")).groupBy("c.k", *[F.col(f"c.{v}").alias(v) for v in LABELERS]).count().collect()
    patterns = sorted((r["k"], tuple(r[v] for v in LABELERS), r["count"]) for r in rows)
    if not patterns:
        return [0.0] * len(KINDS), [(0.0, 0.0)] * len(LABELERS)
    return span_classifier(patterns, reliabilities(patterns)[0])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per text: doc_id, n_email .. n_phone, base_sha256, spans, and n_added, the spans that the classifier added."""
    found = candidates(docs, id_col, text_col)
    kinds, votes = train(found)
    score = " + ".join([f"element_at(array({', '.join(f'{x!r}D' for x in kinds)}), c.k + 1)", *[f"if(c.{v} = 1, {a!r}D, if(c.{v} = -1, {b!r}D, 0D))" for v, (a, b) in zip(LABELERS, votes)]])
    rows = found.select("doc_id", F.expr("filter(found, c -> c.base)").alias("base"), F.expr(f"filter(found, c -> c.loose and {score} >= {math.log(ACCEPT / (1 - ACCEPT))!r}D)").alias("more"))
    rows = rows.withColumn("more", F.expr("filter(more, c -> not exists(base, b -> b.s < c.e and c.s < b.e))"))
    name = f"element_at(array({', '.join(repr(k) for k in KINDS)}), c.k + 1)"
    listed = "array_join(transform({}, c -> concat(" + name + ", ':', c.s, ':', c.e)), ',')"
    counts = [F.expr(f"cast(size(filter(base, c -> c.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.expr(listed.format("base")), 256).alias("base_sha256"), F.expr(listed.format("array_sort(concat(base, more))")).alias("spans"), F.expr("cast(size(more) as long)").alias("n_added"))
