"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are pieces of a paragraph (up to the next full stop, LEAF_BYTES at most), a paragraph is a line, a section ends
at an empty line, before a `#` heading or after SECTION_LINES paragraphs. A node's digest is the hash of its children's.
The fingerprint is the root digest and, below it, the digest of every leaf, grouped as `root|leaves,leaves;leaves` (`,`
between paragraphs, `;` between sections); all inner digests and the root follow from those. Equal roots mean equal texts;
`edits()` descends where branches differ, `likeness()` is the share of leaves that two trees have in common. Leaf digests
have LEAF_DIGEST bytes (72 bits): two given leaves look equal by chance once in 5e21.

For the query each document also meets its successor by doc_id. Rows are dealt over ranges of ids, as many as the bytes ask for, with bounds from an
approximate quantile; the first document of a range is sent to the range before as well, so the text is shuffled once
and no task holds more than its range. Bounds are at most MAX_RANGES numbers, whatever the input's size.

Defined results: null texts are empty; an empty text has the root of no leaves; a null doc_id comes first; repeated ids
follow each other by text; the last document's successor is the first one (itself, if alone); an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import shuffle_partitions, text_bytes

LEAF_BYTES, SECTION_LINES, LEAF_DIGEST = 64, 16, 9
#: Characters of a leaf's digest as written.
LEAF_CHARS = 4 * LEAF_DIGEST // 3
MAX_RANGES = 65_536
#: Bytes of texts in one partition, about.
PARTITION_BYTES = 64 << 20
_LEAVES = re.compile(rb"[^.]{1,%d}\.*|\.+" % LEAF_BYTES, re.DOTALL)


def _digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def fingerprint(text: str) -> str:
    """The tree of a text as a string; see the module's text."""
    sections: list[list[list[bytes]]] = [[]]
    for line in text.encode("utf-8", "surrogatepass").split(b"\n") if text else ():
        if sections[-1] and (line.startswith(b"#") or len(sections[-1]) >= SECTION_LINES):
            sections.append([])
        sections[-1].append([_digest(x, LEAF_DIGEST) for x in _LEAVES.findall(line)])
        if not line.strip() and len(sections[-1]) > 1:
            sections.append([])
    if not sections[-1]:
        sections.pop()
    nodes = [_digest(b"s" + b"".join(_digest(b"p" + b"".join(p)) for p in s)) for s in sections]
    root = _digest(b"r" + b"".join(nodes)).hex()
    written = lambda p: base64.b64encode(b"".join(p)).decode()
    return f"{root}|" + ";".join(",".join(map(written, s)) for s in sections)


def root_of(prints: str) -> str:
    """The root that follows from a fingerprint's leaves."""
    body = prints.partition("|")[2]
    nodes = [_digest(b"s" + b"".join(_digest(b"p" + base64.b64decode(p)) for p in s.split(","))) for s in body.split(";")] if prints != fingerprint("") else []
    return _digest(b"r" + b"".join(nodes)).hex()


def _leaves(body: str) -> list[str]:
    return [p[i : i + LEAF_CHARS] for s in body.split(";") for p in s.split(",") for i in range(0, len(p), LEAF_CHARS)]


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the common part of the leaves of both trees (twice the common over the sum)."""
    (root, _, left), (other, _, right) = a.partition("|"), b.partition("|")
    if root == other:
        return 1.0
    x, y = _leaves(left), _leaves(right)
    return 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y)) if x and y else 0.0


def _unlike(left: list[tuple], right: list[tuple]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """The parts of two lists of (place, digest) that do not fit together, after aligning equal digests."""
    a = 0
    while a < min(len(left), len(right)) and left[a][1] == right[a][1]:
        a += 1
    b = 0
    while b < min(len(left), len(right)) - a and left[-1 - b][1] == right[-1 - b][1]:
        b += 1
    left, right = left[a : len(left) - b], right[a : len(right) - b]
    for tag, i, j, k, m in SequenceMatcher(None, [x for _, x in left], [x for _, x in right], autojunk=False).get_opcodes():
        if tag != "equal":
            yield left[i:j], right[k:m]


def edits(a: str, b: str) -> list[tuple[str, int, int, int]]:
    """(`-` or `+`, section, paragraph, leaf) of each leaf that only a, or only b, has, descending only where branches
    differ. Children are aligned, so what was moved along by an insertion is no edit."""
    if a.split("|")[0] == b.split("|")[0]:
        return []
    cut = lambda x: [(((k,), s)) for k, s in enumerate(x.partition("|")[2].split(";"))]
    below = lambda nodes, parts: [((*place, k), x) for place, node in nodes for k, x in enumerate(parts(node))]
    leaves = lambda p: [p[i : i + LEAF_CHARS] for i in range(0, len(p), LEAF_CHARS)]
    out = []
    for old, new in _unlike(cut(a), cut(b)):
        for was, now in _unlike(below(old, lambda s: s.split(",")), below(new, lambda s: s.split(","))):
            for gone, come in _unlike(below(was, leaves), below(now, leaves)):
                out += [("-", *place) for place, _ in gone] + [("+", *place) for place, _ in come]
    return sorted(out, key=lambda x: x[1:])


def edited(text: str, successor: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + successor[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (range, guest, doc_id, text); a guest is the first document of a later range and only ends a range."""
    last: tuple | None = None  # range, doc_id, text, its fingerprint

    def result(own: tuple, text: str, prints: str) -> tuple:
        changed = edited(own[2], text)
        altered = fingerprint(changed) if changed != own[2] else own[3]
        return own[1], len(own[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own[3], altered, likeness(own[3], altered), likeness(own[3], prints)

    for batch in batches:
        out = []
        for k, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True):
            if guest and (last is None or last[0] != k):
                continue
            prints = fingerprint(text)
            if last is not None and last[0] == k:
                out.append(result(last, text, prints))
            last = None if guest else (k, doc_id, text, prints)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES.types, strict=True)], schema=_TYPES)


def _range_of(bounds: list[int]) -> Column:
    """Number of bounds that are at or below doc_id, by bisection inside the JVM; a null id is in range 0."""
    if not bounds:
        return F.lit(0)
    held = F.array(*map(F.lit, bounds)) if len(bounds) < 2 else F.expr(f"array({','.join(f'{b}L' for b in bounds)})")
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    step = lambda k, h: F.when((k + h <= len(bounds)) & (F.get(held, k + h - 1) <= F.col("doc_id")), k + h).otherwise(k)
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), F.aggregate(steps, F.lit(0), step)), F.lit(0))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    parts = max(shuffle_partitions(spark), -(-(docs.agg(F.sum(text_bytes())).first()[0] or 0) // PARTITION_BYTES))
    ranges = min(4 * parts, MAX_RANGES)
    cuts = ids.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = sorted(set(cuts or []))
    k = _range_of(bounds)
    firsts = {r["k"]: r["first"] for r in ids.where("doc_id IS NOT NULL").groupBy(k.alias("k")).agg(F.min("doc_id").alias("first")).collect()}
    nulls = ids.where("doc_id IS NULL").limit(1).count() > 0
    used = sorted({*firsts, *([0] if nulls else [])})
    before = dict(zip(used[1:], used, strict=False))
    # the range that a range's first document is also sent to: the one before, or the last for the very first document
    to = F.lit(None).cast("int")
    if used:
        pairs = [(firsts[b], a) for b, a in before.items()] + ([] if nulls else [(firsts[used[0]], used[-1])])
        if pairs:
            lookup = F.map_from_arrays(F.expr(f"array({','.join(f'{a}L' for a, _ in pairs)})"), F.expr(f"array({','.join(str(b) for _, b in pairs)})"))
            to = F.try_element_at(lookup, F.col("doc_id")) if len(pairs) < 64 else _looked_up(pairs)
        if nulls:
            to = F.when(F.col("doc_id").isNull(), F.lit(used[-1])).otherwise(to)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    homes = F.filter(F.array(F.struct(k.alias("range"), F.lit(False).alias("guest")), F.struct(to.alias("range"), F.lit(True).alias("guest"))), lambda x: x["range"].isNotNull())
    dealt = docs.select("doc_id", text, F.inline(homes)).repartition(parts, "range").sortWithinPartitions("range", "guest", "doc_id", "text")
    return dealt.select("range", "guest", "doc_id", "text").mapInArrow(_compare, RESULT)


def _looked_up(pairs: list[tuple[int, int]]) -> Column:
    """The number paired with doc_id, found by bisection in the sorted keys."""
    pairs = sorted(pairs)
    keys, values = F.expr(f"array({','.join(f'{a}L' for a, _ in pairs)})"), F.expr(f"array({','.join(str(b) for _, b in pairs)})")
    at = _range_of([a for a, _ in pairs])
    return F.when(F.get(keys, at - 1) == F.col("doc_id"), F.get(values, at - 1))
