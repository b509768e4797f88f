"""Awkward inputs that every operator must take, and plain versions of its definitions."""

import hashlib
import re
import zlib

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"w{i % 997}" for i in range(60000))
PROSE = "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood tonight."
TEXTS = [
    (1, PROSE), (2, PROSE), (3, PROSE.upper()), (4, PROSE.replace("fox", "cat")), (5, ""), (6, None), (7, "   \t\n "), (8, "one two"), (9, "one  two\n"), (10, "two one"), (11, LONG), (12, LONG + " end"),
    (13, "same same same same same same\nsame same same\nsame same same"), (14, "x y z　w été"), (15, "mail a.b@c.org, +1 (415) 555-0100, 10.0.0.1, 4111 1111 1111 1111 and 300.1.1.1"), (16, "\U0001f600 a@b.co \U0001f600"),
    (1, PROSE), (2, "another text under an id that was there before"), (None, PROSE), (None, None),
]


def documents(spark, rows=TEXTS):
    data = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS)


def with_clashes(df, *names):
    """``df`` with extra columns named like an operator's own."""
    from pyspark.sql import functions as F

    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("clash"))
    return df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def classes(rows):
    """Smallest id that links reach, per (id, text) row; rows of one id hang together."""
    sets = [(i, shingles(t)) for i, t in rows]
    own = {i: i for i, _ in sets if i is not None}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(i), find(j)
                own[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255 if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def span_digest(text):
    return hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base_spans(text)).encode()).hexdigest()


def rule_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = {}
    for x in windows:
        times[x] = times.get(x, 0) + 1
    hit = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def hits(text, items, n=13):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = plain(text), set(), set()
    for name, item in items:
        v = plain(item)
        size = min(n, len(v))
        for j in range(len(v) - size + 1 if v else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[j : j + size]:
                    hit.update(range(i, i + size))
                    found.add(name)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None), len(hit) > 0 and 20 * len(hit) >= len(w)


def fold(doc_id, n):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % n


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
