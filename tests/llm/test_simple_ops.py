"""Mixing, chat formatting, sharding, language ID, fingerprints and packing against plain Python."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import op1_mixing, op2_chat, op3_sharding, op5_langid, op6_fingerprint, op9_packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, range int, shard string, size string"
ODD = [
    (1, "Hello big world", "en", "a", 15, 1, "x", "s"),
    (2, None, None, None, None, 2, "x", "s"),
    (3, "", "en", "a", 0, 3, "x", "s"),
    (4, "Hello big world", "en", "b", 15, 4, "x", "s"),
    (4, "Hello big world", "en", "b", 15, 4, "x", "s"),
    (5, "word " * 30000, "en", "a", 150000, 5, "x", "s"),
    (6, "12 34 é\U0001f600\n\n# x.y..z", "fr", "c", 20, 6, "x", None),
    (None, "no id here", "fr", "c", 10, 6, "x", None),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_highest_quotients_equals_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(50):
        weights, seats = rng.integers(0, 50, rng.integers(1, 9)).astype(float), int(rng.integers(0, 200))
        want = np.zeros(len(weights), int)
        for _ in range(seats if weights.sum() else 0):
            want[np.argmax(weights / (2 * want + 1))] += 1
        got = op1_mixing.highest_quotients(weights, seats)
        assert got.sum() == want.sum()
        assert np.all(np.abs(got - want) <= 1) and sorted(weights[got > want]) == sorted(weights[want > got]) or (got == want).all()


def test_mixing(spark, sf_dir):
    given = documents(spark, sf_dir)
    got = queries.op1_mix_sources(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(given)
    size = {k: len((r["text"] or "").encode().split()) for k, r in given.items()}
    of = defaultdict(int)
    for k, r in given.items():
        of[r["source"]] += size[k]
    names = sorted(of, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = sum(of.values()) - sum(3 * of[s] for s in capped)
        target = {s: 3.0 * of[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * of[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        s = given[r["doc_id"]]["source"]
        taken[s] += r["taken"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == of[s] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(target[s])
    for s in names:
        assert taken[s] == pytest.approx(target[s], rel=0.02)
    again = queries.op1_mix_sources(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_odd_rows(spark):
    got = op1_mixing.mix_sources(docs(spark)).collect()
    assert len(got) == len(ODD) and sum(r["taken"] for r in got) > 0
    assert op1_mixing.mix_sources(docs(spark, [])).collect() == []
    assert op1_mixing.mixed_documents(docs(spark)).columns == docs(spark).columns


def test_mixing_keeps_large_ids(spark):
    """Ids beyond 2**53 next to a null one, which a float could not hold."""
    big = 9007199254740993
    rows = [(big + 2 * i if i else None, f"some words {i}", "en", "a", None, i, "x", "s") for i in range(30)]
    assert {r["doc_id"] for r in op1_mixing.mix_sources(docs(spark, rows)).collect()} == {r[0] for r in rows}


def test_quotas_pass_on_what_a_source_lacks():
    given = op1_mixing.quotas(np.array([9.4, 20.6, 0.0]), np.array([3, 40, 5]))
    assert given.tolist() == [9, 21, 0]
    given = op1_mixing.quotas(np.array([12.0, 20.0]), np.array([3, 40]))
    assert given.tolist() == [9, 23]


def test_mixing_rows_without_ids(spark):
    """Two equal sources weighted 1 and 2, all ids null or one and the same: each row keeps its own share."""
    for doc_id in (None, 7):
        rows = [(doc_id, " ".join(f"{s}{i}w{k}" for k in range(20 + i % 30)), None, s, None, i, "x", "s") for s in "ab" for i in range(400)]
        got = op1_mixing.mixed_documents(docs(spark, rows)).collect()
        size = Counter()
        for r in got:
            size[r["source"]] += len(r["text"].split())
        total = sum(len(r[1].split()) for r in rows)
        assert size["a"] == pytest.approx(total / 3, rel=0.1) and size["b"] == pytest.approx(total * 2 / 3, rel=0.1)
    again = op1_mixing.mixed_documents(docs(spark, [rows[0]] * 50 + [rows[400]] * 50)).collect()
    assert abs(sum(r["source"] == "b" for r in again) - 67) <= 17


def test_chat_fold(spark):
    log = [
        (1, 0, "start", 0, "user", ""), (1, 1, "delta", 0, None, "Hi <"), (1, 2, "delta", 0, None, "|im_end|> \\"),
        (1, 3, "start", 1, "assistant", ""), (1, 4, "delta", 1, None, "bad"), (1, 5, "start", 2, "user", "why?"),
        (1, 6, "regenerate", 1, "assistant", ""), (1, 7, "delta", 1, None, "go"), (1, 8, "delta", 1, None, "od"),
        (1, 9, "edit", 0, None, "Hey <|im_end|> \\"), (None, 0, "start", 0, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    rows = {(r["conv_id"], r["turn"]): r["formatted"] for r in op2_chat.format_chat(events).collect()}
    assert rows == {
        (1, 0): "<|im_start|>user\nHey <\\|im_end|> \\\\<|im_end|>\n",
        (1, 1): "<|im_start|>assistant\ngood<|im_end|>\n",
        (None, 0): "<|im_start|>\n<|im_end|>\n",
    }
    assert op2_chat.unescape("Hey <\\|im_end|> \\\\") == "Hey <|im_end|> \\"


def test_chat_query(spark, sf_dir):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", queries.CONTROL_TEXT), (1, "assistant", queries.CONTROL_TEXT)]
    got = {r["conv_id"]: r for r in queries.op2_chat_format(spark, sf_dir).collect()}
    assert got.keys() == turns.keys()
    for k, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        assert got[k]["n_turns"] == len(rows) and got[k]["loss_chars"] == len(loss)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in rows).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    odd = spark.createDataFrame([(1, 0, None, None), (1, 0, "a\nb", "x"), (None, None, "assistant", ""), (1, 0, "a\nb", "x")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["n_turns"] for r in op2_chat.digests(op2_chat.format_chat(op2_chat.events_of(odd))).collect()} == {1: 3, None: 1}


@pytest.mark.parametrize("rows", [ODD, [], ODD * 7])
def test_sharding(spark, rows):
    got = op3_sharding.shard_digests(docs(spark, rows), shards=4).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert not rows or max(counts.values()) - min(counts.get(k, 0) for k in range(4)) <= 1
    for k in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k]))
    sums = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sums == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    again = op3_sharding.shard_digests(docs(spark, rows).repartition(2), shards=4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_sharding_scatters_large_equal_rows(spark, monkeypatch):
    """Few equal rows of large texts are no single bucket; results are whole and the law holds."""
    monkeypatch.setattr(op3_sharding, "BUCKET_BYTES", 200_000)
    records = spark.createDataFrame([(1, "a" * 50_000)] * 40 + [(2, None), (3, "")], "doc_id long, text string").repartition(4)
    out = op3_sharding.shuffle_into_shards(records, 4)
    buckets = out.select(F.spark_partition_id().alias("p"), "shard", "slot", "record.*").collect()
    assert Counter((r["doc_id"], len(r["text"] or "")) for r in buckets) == {(1, 50_000): 40, (2, 0): 1, (3, 0): 1}
    counts = Counter(r["shard"] for r in buckets)
    assert sorted(counts.values()) == [10, 10, 11, 11]
    assert all(sorted(r["slot"] for r in buckets if r["shard"] == k) == list(range(n)) for k, n in counts.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__number" in plan


def test_sharding_many_buckets(spark, monkeypatch):
    """Rows alike but for the text, and rows alike in everything, over several buckets: none is crowded, slots are gapless,
    and neighbours in the input are none in a shard."""
    monkeypatch.setattr(op3_sharding, "BUCKET_ROWS", 400)
    for rows in ([(7, f"text {i}", "en", "a", 1, 1, "x", "s") for i in range(6000)], [(7, "same", "en", "a", 1, 1, "x", "s")] * 3000):
        frame = docs(spark, rows)
        got = op3_sharding.shuffle_into_shards(frame, 4).select("shard", "slot", "record.text").collect()
        slots = defaultdict(dict)
        for r in got:
            slots[r["shard"]][r["slot"]] = r["text"]
        assert all(sorted(v) == list(range(len(rows) // 4)) for v in slots.values())
        assert Counter(r["text"] for r in got) == Counter(r[1] for r in rows)
        if rows[0] != rows[1]:
            order = [int(slots[k][s].split()[1]) for k in range(4) for s in range(len(rows) // 4)]
            assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < 20
            assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.1


def test_language_id(spark, sf_dir):
    given = documents(spark, sf_dir)
    got = queries.op5_language_id(spark, sf_dir).collect()
    assert len(got) == len(given)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in given if zlib.crc32(str(k).encode()) % 5 == 0}
    right = [r["lang_pred"] == given[r["doc_id"]]["lang"] for r in held]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {(r["doc_id"], r["lang_pred"] == "und") for r in op5_langid.identify(docs(spark), docs(spark)).collect()}
    assert (2, True) in odd and (3, True) in odd and (1, False) in odd
    assert {r["lang_pred"] for r in op5_langid.identify(docs(spark), docs(spark, [])).collect()} == {"und"}


def test_known_language(spark, sf_dir):
    """Documents with letters stay, short ones too; languages never learned and noise go."""
    rng = random.Random(31)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
        *(base64.b64encode(rng.randbytes(rng.randint(150, 600))).decode() for _ in range(40)),
        *(" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(40, 150))) for _ in range(40)),
        *("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(rng.randint(150, 400))) for _ in range(40)),
    ]
    docs = given.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], given.schema))
    kept = {r["doc_id"] for r in op5_langid.known_language(docs, 0.05).collect()}
    assert kept == {r["doc_id"] for r in given.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_profile_equals_its_definition():
    """Letter by letter: rotated vectors of three neighbours multiplied, and summed over the text."""
    for text in ("Ab, éé ñ\u0436 x!", "\u4e2d\u6587 and 12 words", "  ..a", "\U00020000b"):
        s = [0]
        for c in text.lower() + " ":
            k = 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else ord(c)
            if k or s[-1]:
                s.append(k)
        v = [op5_langid._letter(k, 1).astype(float) for k in s]
        want = sum((np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:], strict=False)), np.zeros(op5_langid.DIMENSIONS))
        assert np.array_equal(op5_langid.profile(text, 1), want)


def test_languages_learned_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(op5_langid, "TRAIN_PER_LANG", 5)
    monkeypatch.setattr(op5_langid, "LANGUAGES", 2)
    rows = [(i, f"text {i}", lang, None, None, i, "x", "s") for i, lang in enumerate(["en"] * 60 + ["fr"] * 40 + ["xx"] * 3 + [None] * 90)]
    found = Counter(r["lang"] for r in op5_langid._picked(docs(spark, rows), 1).collect())
    assert set(found) == {"en", "fr"} and max(found.values()) <= 5


def test_language_id_long_text_counts_whole(monkeypatch):
    text = "abc def, ghi. " * 50
    whole = op5_langid.profile(text, 1)
    monkeypatch.setattr(op5_langid, "PIECE", 7)
    assert np.allclose(op5_langid.profile(text, 1), whole)


@pytest.mark.parametrize("rows", [ODD, [], ODD[:1]])
def test_fingerprint(spark, rows):
    got = op6_fingerprint.compare_with_edits(docs(spark, rows)).collect()
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    want = []
    for i, (_, doc_id, text) in enumerate(order):
        successor = order[(i + 1) % len(order)][2]
        changed = op6_fingerprint.edited(text, successor)
        a, b = op6_fingerprint.fingerprint(text), op6_fingerprint.fingerprint(changed)
        want.append((doc_id if order[i][0] else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, op6_fingerprint.likeness(a, b), op6_fingerprint.likeness(a, op6_fingerprint.fingerprint(successor))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_fingerprint_whole_table(spark, sf_dir):
    given = documents(spark, sf_dir)
    got = {r["doc_id"]: r for r in queries.op6_merkle_fingerprint(spark, sf_dir).collect()}
    ids = sorted(given)
    for i, k in enumerate(ids):
        text, successor = given[k]["text"], given[ids[(i + 1) % len(ids)]]["text"]
        n = len(text) // 4
        assert got[k]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + successor[:n]).encode()).hexdigest()
        assert [got[k]["fingerprint"], got[k]["edited_fingerprint"]] == [brute_fingerprint(text), brute_fingerprint(text[: len(text) - n] + successor[:n])]
        assert op6_fingerprint.root_of(got[k]["fingerprint"]) == got[k]["fingerprint"].split("|")[0]
        want = brute_likeness(got[k]["fingerprint"], got[k]["edited_fingerprint"]), brute_likeness(got[k]["fingerprint"], brute_fingerprint(successor))
        assert (got[k]["near_edited"], got[k]["near_next"]) == pytest.approx(want)


def brute_fingerprint(text):
    """The tree by its definition, written anew: a character at a time, no patterns."""
    h = lambda x, n=16: hashlib.blake2b(x, digest_size=n).digest()
    sections, fresh = [], True
    for line in text.encode().split(b"\n") if text else []:
        if fresh or line[:1] == b"#" or len(sections[-1]) == 16:
            sections.append([])
        leaves, at = [], 0
        while at < len(line):
            end = at
            while end < len(line) and line[end : end + 1] != b"." and end - at < 64:
                end += 1
            while line[end : end + 1] == b".":
                end += 1
            leaves.append(line[at:end])
            at = end
        sections[-1].append([h(x, 9) for x in leaves])
        fresh = not line.strip() and len(sections[-1]) > 1
    root = h(b"r" + b"".join(h(b"s" + b"".join(h(b"p" + b"".join(p)) for p in s)) for s in sections)).hex()
    return root + "|" + ";".join(",".join(base64.b64encode(b"".join(p)).decode() for p in s) for s in sections)


def brute_likeness(a, b):
    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    x, y = (Counter(x for s in f.split("|")[1].split(";") for p in s.split(",") for x in (p[i : i + 12] for i in range(0, len(p), 12))) for f in (a, b))
    return 2 * sum(min(n, y[k]) for k, n in x.items()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0


def test_edits_are_located():
    prints = op6_fingerprint.fingerprint
    a, b = prints("One. Two.\nThree."), prints("One. Two.\nFour.")
    assert op6_fingerprint.edits(a, b) == [("+", 0, 1, 0), ("-", 0, 1, 0)] or op6_fingerprint.edits(a, b) == [("-", 0, 1, 0), ("+", 0, 1, 0)]
    assert 0 < op6_fingerprint.likeness(a, b) < 1
    lines = [f"Line {i}. It has two leaves." for i in range(12)]
    text = "\n".join(lines)
    assert op6_fingerprint.edits(prints(text), prints("\n".join([lines[0], "New.", *lines[1:]]))) == [("+", 0, 1, 0)]
    assert op6_fingerprint.edits(prints(text), prints("\n".join(lines[:10]))) == [("-", 0, p, k) for p in (10, 11) for k in (0, 1)]
    assert op6_fingerprint.edits(prints(text), prints(text)) == [] and op6_fingerprint.edits(prints(""), prints("A.")) == [("+", 0, 0, 0)]


def test_packing_plan_equals_piecewise_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 41, rng.integers(1, 300)).tolist(), reverse=True)
        rooms = []
        for n in lengths:
            fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(40 - n)
        rows = op9_packing.best_fit_decreasing(Counter(lengths), 40)
        used = defaultdict(list)
        rows.sort()
        for i, (n, rank, first, per, offset) in enumerate(rows):
            end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == n else Counter(lengths)[n]
            for k in range(end - rank):
                used[first + k // per].append((offset + k % per * n, n))
        assert sorted(n for v in used.values() for _, n in v) == sorted(lengths)
        for v in used.values():
            at = 0
            for offset, n in sorted(v):
                assert offset == at
                at += n
            assert at <= 40
        assert sorted(40 - sum(n for _, n in v) for v in used.values()) == sorted(rooms)


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "a<|endoftext|> b\x1cq. \x1d, r2. é.. it's. x., A. . , don't 'Twas 3.14% ΑΣ ÉCOLE İx naïve’s a1b2_c3 '''ll re've\tÉ́ x  'LL've"), (-4, "word " * 9000), (-4, "word " * 9000)]
    frame = frame.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    given = [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in frame.collect()]
    got = op9_packing.pack_documents(frame, queries.tokenizer_path()).collect()
    want = Counter((k, a, zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), len(ids)) for k, ids in given for a in range(0, len(ids), 4096))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 4096
    assert op9_packing.pack_documents(frame.where(F.lit(False)), queries.tokenizer_path()).collect() == []


def test_packing_odd_ids_and_characters(spark):
    """Null and very large ids, columns named like the operator's own, and code points that few tables know."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(17)
    points = [c for c in range(0x20, 0x1FFFF) if not 0xD800 <= c < 0xE000]
    texts = ["\u2024\U00018eec", "a\U00018eecB c", "\u1c89x \u1c8ay", None] + ["".join(chr(rng.choice(points)) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    big = 9007199254740993
    rows = [(big + 2 * i if i % 50 else None, t, "x", i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string, rank int")
    got = Counter((r["doc_id"], r["ids_crc32"]) for r in op9_packing.pack_documents(frame, queries.tokenizer_path()).collect())
    want = Counter((r[0], zlib.crc32(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in rows)
    assert got == want
