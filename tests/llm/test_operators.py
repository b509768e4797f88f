"""Each operator against a plain version of its definition, on the smallest shared tables and on awkward rows."""

import math
import os
import sys
import zlib

import numpy as np
import pytest

pytest.importorskip("tablewright.llm.queries")
sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402
from cases import as_rows, documents, with_clashes  # noqa: E402
from tablewright.llm import decontam, mixing, pii, quality, rules, secret_scan, similar, suffix_tree, tokens, urls  # noqa: E402
from tablewright.llm import queries as Q  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
shared = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables absent")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in Q.table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@shared
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, database, name):
    df = Q.QUERIES[name](spark, FOLDER)
    cursor = database.execute(Q.ORACLES[name])
    columns = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert as_rows(df, *columns) == want and want


# 1. similarity join


@shared
def test_classes_of_whole_table(spark, texts):
    found = as_rows(similar.near_duplicates(Q.table(spark, FOLDER, "documents")), "doc_id", "n_shingles", "component_id")
    assert found == cases.classes(texts)


def test_classes_of_awkward_rows(spark):
    docs = with_clashes(documents(spark), "key", "block", "one", "two", "n", "component", "rep")
    assert as_rows(similar.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == cases.classes(cases.TEXTS)
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def test_a_chain_of_copies_is_one_class(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(100 - k, " ".join(base[: 60 - k] + [f"n{i}" for i in range(k)])) for k in range(0, 40, 2)]
    found = as_rows(similar.near_duplicates(documents(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == cases.classes(rows)


def test_links_between_blocks_match_all_pairs():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[(k % 4) * 60 : (k % 4) * 60 + 70], 60, replace=False)) for k in range(60)]
    block = (np.arange(60), np.array([len(s) for s in sets]), np.concatenate(sets))
    want = {(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert want
    label = list(range(60))
    for _ in range(60):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert similar.linked(block, block, 75) == sorted((i, x) for i, x in enumerate(label) if i != x)


# 2. personal data


def check_spans(found, rows):
    want = []
    for i, t in rows:
        kinds = [s[3] for s in cases.base_spans(t)]
        want.append((i, *(kinds.count(k) for k in pii.KINDS), cases.span_digest(t)))
    assert as_rows(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


@shared
def test_base_spans_of_whole_table(spark, texts):
    found = pii.personal_data(Q.table(spark, FOLDER, "documents"))
    check_spans(found, texts)
    base = {i: {f"{k}:{a}:{b}" for a, _, b, k in cases.base_spans(t)} for i, t in texts}
    assert all(base[r.doc_id] <= set(r.spans.split(",")) for r in found.where("base_sha256 is not null and spans <> ''").collect())


def test_base_spans_of_awkward_rows(spark):
    odd = [(50, "a@b.c_d@e.f"), (51, "+1 222 333 4444+1 222 333 4444"), (52, "1.2.3.4.5.6.7.8 1234.5.6.7 01.002.3.4"), (53, "5500 0055 5555 5559-1234 4111-1111-1111-1111"), (54, "a" * 40000 + "@" + "b." * 20000 + "c"), (55, "9" * 30000), (56, "+1" + " " * 20000)]
    rows = cases.TEXTS + odd
    docs = with_clashes(documents(spark, rows), "found", "base", "more", "t", "spans")
    check_spans(pii.personal_data(docs), rows)
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_reliabilities_recover_planted_ones():
    rng = np.random.default_rng(5)
    accuracy, counts = [0.95, 0.9, 0.8, 0.7, 0.75, 0.85], {}
    for _ in range(6000):
        true = rng.random() < 0.5
        votes = tuple((1 if (rng.random() < a) == true else -1) for a in accuracy)
        counts[0, votes] = counts.get((0, votes), 0) + 1
    _, votes = pii.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert all(abs(votes[j][1][2] - a) < 0.08 for j, a in enumerate(accuracy))


def test_loose_spans_are_added(spark):
    good = [(k, f"please call our phone (415) 555-{1000 + k} or write e-mail me{k}(at)mail.com and a@b.com today") for k in range(40)]
    found = pii.personal_data(documents(spark, good)).collect()
    assert sum(r.n_added for r in found) >= 40 and all(r.n_email == 1 for r in found)


# 3. decision lists


@shared
def test_counts_and_lists(spark, texts):
    found = Q.op3_quality_rules(spark, FOLDER)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert as_rows(found, "doc_id", *names) == sorted(((i, *cases.rule_counts(t)) for i, t in texts), key=repr)
    assert found.where("base_failed <> (n_words < 50 or 100 * n_repeat_words > 50 * n_words) or (base_failed and kept)").count() == 0
    judged = found.join(Q.table(spark, FOLDER, "labels"), "doc_id")
    assert judged.where("(quality = 1) = kept").count() >= 0.85 * judged.count()


def test_counts_of_awkward_rows(spark):
    docs = with_clashes(documents(spark), "n_words", "kept", "label")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert as_rows(rules.statistics(docs), "doc_id", *names) == sorted(((i, *cases.rule_counts(t)) for i, t in cases.TEXTS), key=repr)
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert rules.judged(docs, labels).where("kept = base_failed").count() == 0
    assert rules.judged(docs.limit(0), labels).count() == 0


def test_covering_finds_planted_conjunction():
    rng = np.random.default_rng(1)
    values = rng.random((3000, 3))
    bad = (values[:, 0] > 0.7) & (values[:, 2] < 0.4)
    learned = rules.learn(values, bad, ["a", "b", "c"])
    said = np.zeros(3000, dtype=bool)
    for rule in learned:
        said |= rules._holds(values, ["a", "b", "c"], rule)
    assert (said == bad).mean() > 0.97


# 4. urls


def test_urls_of_awkward_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://WWW.Example.COM/en/1?x"), (5, "https://a.net/es/x#y"), (6, "https://anet/es/x"), (7, "ftp://net/fr/"), (8, "http://example.com/en"), (8, "http://example.com/en"), (None, "http://a.org//b/2020/x"), (9, "x://h?q://z/y")]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string"), "host", "rule", "n", "shape", "html")
    got = as_rows(urls.judged(pages), "page_id", "host", "path", "rule", "verdict")
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (5, "a.net", "/es/x", "net/es/", "block"),
            (6, "anet", "/es/x", None, "allow"), (7, "net", "/fr/", "net/fr/", "block"), (8, "example.com", "/en", "com/", "allow"), (8, "example.com", "/en", "com/", "allow"), (None, "a.org", "//b/2020/x", None, "allow"), (9, "h", "", None, "allow")]
    assert got == sorted(want, key=repr)
    assert urls.judged(pages.limit(0)).count() == 0


def test_a_template_of_blocked_pages_is_rejected(spark):
    rows = [(k, f"http://h.net/es/{k}") for k in range(60)] + [(100 + k, f"http://h.net/de/{k}") for k in range(60)]
    found = urls.judged(spark.createDataFrame(rows, "page_id long, url string"))
    assert {(r.template, r.purity > urls.REJECT) for r in found.select("template", "purity").distinct().collect()} >= {("/es/*number", True)}
    assert found.where("path like '/de/%' and verdict = 'block' and purity < 0.9").count() == 0


# 5. mixing


def check_mix(found, sources):
    rows = found.collect()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert own[0].source_size == sum(r["size"] for r in own) and abs(sum(r.taken for r in own) - own[0].target) < 1
    total, left, targets = sum(o[0].source_size for o in by.values()), dict(sources), {}
    while True:  # share by weight, stop sources at three times their size, share the rest again
        spare = total - sum(targets.values())
        weight = sum(left.values())
        over = [s for s in left if weight and spare * left[s] / weight > 3 * by[s][0].source_size]
        if not over:
            targets.update({s: spare * w / weight for s, w in left.items()})
            break
        for s in over:
            targets[s] = 3.0 * by[s][0].source_size
            del left[s]
    assert all(abs(targets[s] - own[0].target) <= 1e-6 * (1 + targets[s]) for s, own in by.items())


def test_mix(spark):
    rows = [(k, "w " * (1 + k % 7)) for k in range(300)]
    docs = documents(spark, rows)
    check_mix(mixing.mix(docs), {s: i % 3 + 1 for i, s in enumerate(["s0", "s1", "s2", None])})
    uneven = docs.selectExpr("doc_id", "case when source = 's0' then repeat(text, 40) else text end as text", "source", "lang as target", "n_chars as size")
    check_mix(mixing.mix(uneven), {s: i % 3 + 1 for i, s in enumerate(["s0", "s1", "s2", None])})
    check_mix(mixing.mix(documents(spark)), {s: i % 3 + 1 for i, s in enumerate(["s0", "s1", "s2", None])})
    assert as_rows(mixing.mix(docs), "doc_id", "taken") == as_rows(mixing.mix(docs.repartition(5)), "doc_id", "taken")
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_hold_the_budget(spark):
    docs = documents(spark, [(k, f"a  b\tc{k}\n " * (1 + k % 9)) for k in range(200)])
    taken = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + len(cases.words(r.text))
        assert r.n_chars == len(r.text)
    assert got == {s: n for s, n in taken.items() if n}


# 6. decontamination


def check_hits(found, rows, items):
    want = []
    for i, t in rows:
        n, k, names, bad = cases.hits(t, items)
        want.append((i, n, k, names, bad))
    assert as_rows(found, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(want, key=repr)


def test_hits_of_awkward_rows(spark, monkeypatch):
    items = [("a", cases.PROSE), ("b", "one two"), ("c", None), ("d", ""), ("e", "the the the the"), (None, "same same"), ("f", " ".join(f"w{i % 997}" for i in range(500, 560))), ("a", "one two")]
    rows = [(i, t) for i, t in cases.TEXTS if i not in (11, 12)] + [(20, "the the the the the"), (21, "x " * 30 + cases.PROSE + " y" * 500), (22, " ".join(f"w{i}" for i in range(490, 570)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = with_clashes(documents(spark, rows), "n_words", "first", "block", "term", "item_id")
    check_hits(decontam.contamination(docs, bench), rows, items)
    monkeypatch.setattr(decontam, "SENT_WORDS", 10)
    found = decontam.contamination(docs, bench)
    one = [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in found.collect()]
    assert sorted(one, key=repr) == sorted(((i, *cases.hits(t, items)[:2], cases.hits(t, items)[3]) for i, t in rows), key=repr)
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_near_matches(spark):
    words = [f"word{i}" for i in range(13)]
    near = words[:4] + ["extra"] + words[4:]
    found = decontam.contamination(documents(spark, [(1, " ".join(near)), (2, "nothing here")]), spark.createDataFrame([("a", " ".join(words))], "item_id string, text string"))
    assert as_rows(found, "doc_id", "n_hit", "n_near") == [(1, 0, 1), (2, 0, 0)]


# 7. suffix tree


def check_base(found, rows):
    tokens_of = lambda t: [*cases.words(cases.lower(t)), None]
    counts = {}
    for i, t in rows:
        if cases.fold(i, 7) != 2:
            for w in tokens_of(t):
                counts[w] = counts.get(w, 0) + 1
    n, v, want = sum(counts.values()), len(counts), []
    for i, t in rows:
        own = tokens_of(t)
        want.append((i, cases.fold(i, 7) == 2, len(own), sum(w in counts for w in own), n, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own)))
    got = as_rows(found, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    want = sorted(want, key=repr)
    assert [r[:5] for r in sorted(got, key=lambda r: repr(r[:5]))] == [r[:5] for r in sorted(want, key=lambda r: repr(r[:5]))]
    assert np.allclose(sorted(r[5] for r in got), sorted(r[5] for r in want), rtol=1e-9)


@shared
def test_base_scores_and_model(spark, texts):
    found = suffix_tree.scores(Q.table(spark, FOLDER, "documents"))
    check_base(found, texts)
    held = found.where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert held.s > held.b  # the model beats the base on texts it has not seen


def test_base_scores_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SENT", 5)
    docs = with_clashes(documents(spark), "score", "base", "row", "rare", "key")
    check_base(suffix_tree.scores(docs), cases.TEXTS)
    assert suffix_tree.scores(docs.limit(0)).count() == 0


def test_tokens_follow_the_definition():
    import pyarrow as pa
    from tablewright.llm.words import text_slices, word_hashes

    rows = [t for _, t in cases.TEXTS if t is not None]
    for row, data, starts in text_slices(pa.array(rows), 2000):
        text, hashes = suffix_tree._words(data, starts)
        for k in range(len(starts) - 1):
            assert hashes[text == k].tolist() == [*word_hashes(rows[row + k]).tolist(), suffix_tree.END_WORD]


@pytest.fixture(scope="module")
def small_tree(spark):
    """A tree over sequences in which a symbol depends on the two before it."""
    rng = np.random.default_rng(2)
    B, rows = suffix_tree.BITS, []
    for _ in range(400):
        own = [int(rng.integers(1, 6))]
        while len(own) < 30:
            own.append((own[-1] + (own[-2] if len(own) > 1 else 0)) % 5 + 1 if rng.random() < 0.7 else int(rng.integers(1, 6)))
        rows.append([*own, 0])
    text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    symbols = np.concatenate(rows)
    counts = np.bincount(symbols, minlength=suffix_tree.SYMBOLS).astype(float)
    root = np.log10((counts + 1) / (counts + 1).sum())

    def count_level(levels):
        number = suffix_tree.contexts(text, symbols, levels)[-1]
        keys, times = np.unique(levels[-1][number[number >= 0]] << B | symbols[number >= 0], return_counts=True)
        return spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, times)], "key long, times long")

    return suffix_tree.grow(spark, count_level, None, counts, root), rows


def test_states_are_distributions(small_tree):
    tree, rows = small_tree
    assert any(kept.any() for kept in tree.kept[1:])  # longer contexts earn their place here
    every = np.arange(suffix_tree.SYMBOLS)
    for own in rows[:40]:
        for before in (own[:1], own[:2], own[:3], own[3:7]):
            text = np.repeat(every, len(before) + 1)
            symbols = np.concatenate([[*before, s] for s in every])
            last = tree.log_chances(text, symbols)[len(before) :: len(before) + 1]
            assert math.isclose((10.0**last).sum(), 1, abs_tol=1e-6)


def test_longest_state_predicts(small_tree):
    tree, rows = small_tree
    B = suffix_tree.BITS
    state = [{int(c): i for i, c in enumerate(known) if kept[i]} for known, kept in zip(tree.levels, tree.kept)]
    seen = [dict(zip(p.tolist(), c.tolist())) for p, c in tree.seen]

    def chance(before, symbol):
        out = tree.root[symbol]
        for k in range(min(len(before), suffix_tree.DEPTH)):
            key = sum(int(x) << B * i for i, x in enumerate(reversed(before[-k - 1 :])))
            if key in state[k]:
                out = seen[k].get(key << B | int(symbol), out + tree.back[k][state[k][key]])
        return out

    for own in rows[:30]:
        got = tree.log_chances(np.zeros(len(own), dtype=int), np.array(own))
        assert np.allclose(got, [chance([0, *own[:i]], s) for i, s in enumerate(own)])


# 8. quality


def area(score, label):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@shared
def test_held_out_quality(spark):
    found = Q.op8_quality_classifier(spark, FOLDER).join(Q.table(spark, FOLDER, "labels").select("doc_id", "quality"), "doc_id").toPandas()
    held = found[found.held_out]
    assert area(held.score.to_numpy(), held.quality.to_numpy()) > 0.9
    assert ((held.predicted == held.quality).mean()) > 0.85
    assert (found.held_out == [cases.fold(i, 5) == 0 for i in found.doc_id]).all()


def test_quality_of_awkward_rows(spark):
    docs = with_clashes(documents(spark), "score", "label", "stats")
    labels = spark.createDataFrame([(1, 1), (2, 1), (13, 0), (13, 1), (4, 1), (8, 0), (None, 0), (3, None)], "doc_id long, quality int")
    found = quality.line_field_quality(docs, quality.train(docs, labels)).collect()
    assert len(found) == len(cases.TEXTS) and all(0 <= r.score <= 1 for r in found)
    one = quality.line_field_quality(docs, quality.train(docs, labels.where("quality = 1"))).collect()
    assert {r.score for r in one} == {1.0}
    assert {r.score for r in quality.line_field_quality(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.line_field_quality(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(4)
    score, pair, chain = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    chance, _, total = quality._chances(score, chain, pair)
    for c in (0, 1, 2):
        at = np.flatnonzero(chain == c)
        weights = {}
        for m in range(2 ** len(at)):
            y = [m >> k & 1 for k in range(len(at))]
            weights[tuple(y)] = math.exp(sum(score[a] * v for a, v in zip(at, y)) + sum(pair[u, v] for u, v in zip(y, y[1:])))
        z = sum(weights.values())
        for k, a in enumerate(at):
            assert math.isclose(chance[a], sum(w for y, w in weights.items() if y[k]) / z, rel_tol=1e-9)
            assert math.isclose(total[a], math.log(z), rel_tol=1e-9)


# 9. token files


def check_tokens(found, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    want, start = [], 0
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert as_rows(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


@shared
def test_round_trip(spark, texts, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 5000)
    check_tokens(tokens.read_texts(tokens.token_files(Q.table(spark, FOLDER, "documents"), Q.tokenizer_path())), sorted(texts))


def test_tokens_of_awkward_rows(spark):
    odd = [(100, "a<|endoftext|> b  <|endoftext|>c"), (101, "tab\t\there \u00a0 nbsp\u2003em\r\nline"), (102, "  lead\n\n\n trail  \n "), (103, "it's we'll\n'd 12 345!!?? ...  x"), (104, "\x1c a \x85 b"), (105, "\U0001f600\n \n\n\u0301 ")]
    rows = [(i, t) for i, t in cases.TEXTS if i not in (1, 2, None)] + odd
    docs = with_clashes(documents(spark, rows), "file", "block", "codes", "start", "digest")
    check_tokens(tokens.read_texts(tokens.token_files(docs, Q.tokenizer_path())), sorted(rows))
    again = tokens.read_texts(tokens.token_files(documents(spark), Q.tokenizer_path()))
    assert again.count() == len(cases.TEXTS) and again.where("doc_id is null").count() == 2
    assert tokens.read_texts(tokens.token_files(docs.limit(0), Q.tokenizer_path())).count() == 0


@pytest.mark.parametrize("high", [1, 200, 256, 70000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_codes(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, endpoint=True).astype(np.uint32)
    ids[::3] %= 300
    codes = tokens.Codes(tokens.encode_codes(ids))
    assert (codes.all() == ids).all() and codes.length == n
    assert [codes[k] for k in range(0, n, 13)] == ids[::13].tolist()


# 10. secrets


def test_secrets(spark):
    rng = np.random.default_rng(8)
    pick = lambda s, n: "".join(rng.choice(list(s), n))
    rows = [(k, f"the server was set with password={pick('0123456789abcdef', 18)} on that day") for k in range(30)]
    rows += [(100 + k, f"some words and AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)} more words") for k in range(30)]
    rows += [(200 + k, f"it was paid from {pick('0123456789', 16)} to version 1.2.{k}.20240101 today") for k in range(30)]
    found = secret_scan.scan(documents(spark, rows + [(900, None), (901, "")])).collect()
    assert all(r.secret == (r.doc_id < 200) for r in found) and {r.doc_id for r in found} == {i for i, _ in rows}
    for r in found:
        assert dict(rows)[r.doc_id][r.start : r.end] == r.candidate


def test_secrets_of_awkward_rows(spark):
    docs = with_clashes(documents(spark), "length", "label", "candidate", "secret", "features")
    found = secret_scan.scan(docs).collect()
    assert all(0 <= r.chance <= 1 for r in found)
    assert secret_scan.scan(docs.limit(0)).count() == 0


# pipeline


@shared
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = Q.table(spark, FOLDER, "documents")
    bench = [(str(r.item_id), r.text) for r in Q.table(spark, FOLDER, "benchmark").collect()]
    good = P.good_texts(spark, docs, FOLDER).cache()
    assert good.columns == docs.columns and 0.5 * docs.count() < good.count() < docs.count()
    one = P.one_of_each(spark, good, FOLDER).cache()
    classes = cases.classes([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in one.collect()} == {c for _, _, c in classes}
    clean = P.uncontaminated(spark, one, FOLDER).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not cases.hits(r.text, bench)[3]}
    mix = P.mixed(spark, clean, FOLDER)
    assert mix.columns == docs.columns
    check_tokens(P.token_files(spark, mix.where("doc_id % 2 = 0").dropDuplicates(["doc_id"]), FOLDER), sorted((r.doc_id, r.text) for r in mix.where("doc_id % 2 = 0").dropDuplicates(["doc_id"]).collect()))
