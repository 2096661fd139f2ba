"""Fill-in-the-middle, vector codes and quality rules against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import op11_fim, op12_codes, op13_rules, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, n string, s string, t string, w string, form string, held_out string"
ODD = [
    (1, "one\ntwo\nthree\n"), (2, None), (3, ""), (4, "\n\n\n"), (4, "\n\n\n"), (5, "no end of line"), (6, "é\U0001f600\nñ\r\n x\n" * 5), (7, "a <P> b\nc"), (8, "x<S>"), (9, "<M>\n"),
    (10, "<\nP>\n<P\n>\n<"), (None, "no\nid\n"), (11, "line of a long text\n" * 60000), (12, "word " * 40000), (13, "\x00\x00\n\x00"),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", "a", 0, *["x"] * 7) for i, t in rows], DOCS).repartition(3)


def plain_fim(doc_id, text, rate=100, first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < first else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_rank_and_select():
    rng = np.random.default_rng(2)
    for n, share in ((0, 0.5), (1, 1.0), (63, 0.2), (64, 0.9), (511, 0.5), (512, 1.0), (513, 0.01), (5000, 0.003), (5000, 0.0)):
        flags = rng.random(n) < share
        bits, ones = op11_fim.Bits(flags), np.flatnonzero(flags)
        assert bits.rank(np.arange(n + 1)).tolist() == [0, *flags.cumsum().tolist()]
        assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()


@pytest.mark.parametrize(("rate", "first"), [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_fill_in_middle_odd(spark, rate, first):
    samples = op11_fim.fill_in_middle(docs(spark), rate, first)
    got = samples.withColumn("back", op11_fim.restored(F.col("output"), F.col("form"))).collect()
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append(t or "")
    assert len(got) == len(ODD)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], texts[r["doc_id"]][0], rate, first)
        assert r["back"] == texts[r["doc_id"]][0]


def test_fill_in_middle_query(spark, sf_dir):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op11_fill_in_middle"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(given) and len({r["form"] for r in got}) > 1
    for r in got:
        n, form, p, m, output = plain_fim(r["doc_id"], given[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, p, m, hashlib.sha256(output.encode()).hexdigest())
        assert r["restored_sha256"] == hashlib.sha256((given[r["doc_id"]] or "").encode()).hexdigest()


def test_fill_in_middle_empty_table(spark):
    assert op11_fim.digests(op11_fim.fill_in_middle(docs(spark).where("doc_id < 0"))).collect() == []


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, label, vector); plain loops over Python integers."""
    import math

    kept = [(i, label, [math.floor(256 * float(np.float64(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    part = lambda v, k: v[k * width : (k + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))[:entries]
    books = [[part(r[2], k) for r in first] for k in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(part(v, k), e, strict=True)), n) for n, e in enumerate(books[k])) for k in range(parts)] for _, _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(parts):
            for n in range(len(books[k])):
                mine = [part(r[2], k) for r, f in zip(kept, found, strict=True) if f[k][1] == n]
                if mine:
                    books[k][n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    total = defaultdict(int)
    for (_, label, _), e in zip(kept, errors, strict=True):
        total[label] += e
    return sorted(((r[0], "".join(f"{n:02x}" for _, n in f), e, total[r[1]], digest) for r, f, e in zip(kept, found, errors, strict=True)), key=str)


def test_cells_bound_and_find():
    rng = np.random.default_rng(5)
    for width, spread, count in ((4, 60, 64), (1, 3, 64), (4, 0, 5), (3, 1 << 26, 64), (2, 500, 1)):
        entries = rng.integers(-spread, spread + 1, (count, width))
        parts = np.concatenate([rng.integers(-2 * spread - 1, 2 * spread + 2, (300, width)), entries])
        exact = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        cells = op12_codes.Cells(entries)
        lower, upper = cells.bounds(parts)
        assert (lower <= exact).all() and (exact <= upper).all()
        index, distance = cells.nearest(parts)
        assert index.tolist() == exact.argmin(axis=1).tolist() and distance.tolist() == exact.min(axis=1).tolist()


def test_cells_leave_most_entries_out():
    rng = np.random.default_rng(6)
    cells, parts = op12_codes.Cells(rng.integers(-60, 60, (64, 4))), rng.integers(-60, 60, (2000, 4))
    lower, upper = cells.bounds(parts)
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.35


@pytest.mark.parametrize("n", [1, 40, 300])
def test_vector_codes(spark, n):
    rng = np.random.default_rng(n)
    nan, inf = float("nan"), float("inf")
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), [float(np.float32(x)) for x in rng.normal(0, 0.3, 32)]) for i in rng.permutation(n)]
    rows += rows[: n // 4]  # repeated rows
    odd = [(5000, 1, None), (5001, 1, [nan] * 32), (5002, 1, [inf] + [0.0] * 31), (5003, 1, [None] + [0.0] * 31), (5004, 1, [0.0] * 31), (5005, 1, [])]
    zero, nameless = [(5006, 2, [0.0] * 32)], [(None, None, [0.25] * 32), (None, 1, [-0.001] * 32)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows + odd + zero + nameless], "vec_id long, label int, embedding array<float>, code string, ints string").repartition(5)
    got = sorted((tuple(r) for r in op12_codes.compress(frame).collect()), key=str)
    assert got == plain_codes(rows + zero + nameless)


def test_vector_codes_query(spark, sf_dir):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op12_vector_codes"](spark, sf_dir).collect()), key=str) == plain_codes(rows)


def test_vector_codes_decode_near(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = op12_codes.integers(table, 64)
    books = op12_codes.train(rows, 4)
    back = {r["vec_id"]: r for r in op12_codes.decoded(op12_codes.encoded(rows, books), books).collect()}
    for r in table.collect():
        off = np.asarray(r["embedding"]) - np.asarray(back[r["vec_id"]]["vector"])
        assert ((256 * off) ** 2).sum() == pytest.approx(back[r["vec_id"]]["error"], abs=256 * np.abs(off).sum() + 64)


def test_vector_codes_large_and_empty(spark):
    schema = "vec_id long, label int, embedding array<double>"
    assert op12_codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert op12_codes.compress(spark.createDataFrame([(1, 1, None)], schema)).collect() == []
    got = op12_codes.compress(spark.createDataFrame([(1, 1, [1e300] * 17), (2, 1, [-1e300] * 17)], schema)).collect()
    assert sorted((r["vec_id"], r["error"]) for r in got) == [(1, 0), (2, 0)]


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(op13_rules.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7) & (x[:, 9] > 0.2)).astype(float)
    rules = op13_rules.fit(x[:2000], y[:2000])
    assert 0 < len(rules.weights) <= op13_rules.MOST_RULES
    assert ((rules.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    for _, rule in rules.weights:
        assert 1 <= len(rule.parts) <= 2 * op13_rules.DEPTH
        assert op13_rules.LEAST <= rule.covers(x[:2000]).sum()


def test_lasso_meets_its_conditions():
    """At the optimum the gradient is within the penalty where a weight is 0, and opposes its sign by the penalty elsewhere."""
    rng = np.random.default_rng(4)
    z = rng.normal(size=(800, 12))
    y = (rng.random(800) < 1 / (1 + np.exp(-(z[:, 0] - 2 * z[:, 3])))).astype(float)
    w = op13_rules.lasso(z, y, 0.03, np.zeros(13), 3000)
    gradient = z.T @ (1 / (1 + np.exp(-(w[0] + z @ w[1:]))) - y) / 800
    for g, v in zip(gradient, w[1:], strict=True):
        assert abs(g + 0.03 * np.sign(v)) < 1e-6 if v else abs(g) <= 0.03 + 1e-6
    assert w[1] > 0 > w[4] and np.count_nonzero(w[1:]) < 12


def plain_statistics(text):
    text = text or ""
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], [x for x in text.split("\n") if x]
    n, share = len(text), lambda a, b: a / b if b else 0.0
    import unicodedata

    kind = lambda test: sum(map(test, text))
    letters, digits = kind(lambda c: unicodedata.category(c)[0] == "L"), kind(lambda c: c in "0123456789")
    spaces, marks = kind(lambda c: c in " \t\n\x0b\x0c\r"), kind(lambda c: c in ".,;:?'\"()-")
    return {
        "chars": n, "words": len(words), "lines": len(lines), "word_length": share(n - spaces, len(words)), "longest_word": max(map(len, words), default=0), "line_length": share(n, len(lines)),
        "letters": share(letters, n), "capitals": share(kind(lambda c: unicodedata.category(c) == "Lu"), letters), "digits": share(digits, n), "spaces": share(spaces, n), "marks": share(marks, n),
        "symbols": share(n - letters - digits - spaces - marks, n), "distinct_words": share(len(set(words)), len(words)), "distinct_lines": share(len(set(lines)), len(lines)),
        "short_words": share(sum(len(w) <= 3 for w in words), len(words)), "bare_lines": share(sum(len(x) <= 20 for x in lines), len(lines)),
        "ended_lines": share(sum(x[-1] in ".?!" for x in lines), len(lines)), "bars": share(text.count("|"), len(words)),
    }


def test_statistics(spark, sf_dir):
    frame = docs(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    for r in op13_rules.statistics(frame, "doc_id", "text").collect():
        want = plain_statistics(r["text"])
        assert set(want) == set(op13_rules.STATISTICS)
        assert {k: r["s"][k] for k in want} == pytest.approx(want, abs=1e-12)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_quality_rules"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    tested = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in tested) / len(tested) > 0.95


def test_quality_compiled_rules_equal_numpy(spark, sf_dir):
    frame, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = op13_rules.learn(frame, labels)
    rows = op13_rules.statistics(frame, "doc_id").collect()
    want = dict(zip([r["doc_id"] for r in rows], rules.scores(np.array([list(r["s"]) for r in rows])), strict=True))
    scored = op13_rules.score(frame, rules)
    assert {r["doc_id"]: r["score"] for r in scored.collect()} == pytest.approx(want, abs=1e-9)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_labels_are_never_inputs(spark, sf_dir):
    """Labels of held-out documents, lang, source and ids change no score."""
    frame, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(op13_rules.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert str(op13_rules.learn(frame, labels)) == str(op13_rules.learn(frame.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")).repartition(5), turned))


def test_quality_odd(spark):
    labels = "doc_id long, quality int, toxic int"
    rows = [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 7, 0)]
    for known in (rows, []):
        rules = op13_rules.learn(docs(spark), spark.createDataFrame(known, labels))
        got = op13_rules.score(docs(spark), rules).collect()
        assert len(got) == len(ODD) and len({r["score"] for r in got}) == 1 and all(0 < r["score"] < 1 for r in got)
    empty = docs(spark).where("doc_id < 0")
    assert op13_rules.score(empty, op13_rules.learn(empty, spark.createDataFrame(rows, labels))).collect() == []
