"""Packing token sequences into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows; the pieces then go, longest first, into the tightest open window.
Only lengths matter to that choice and there are at most WINDOW of them, so the plan is made from the count of each
length: windows of equal room are handled together, and a segment tree over the rooms finds the tightest. The plan's
size depends on WINDOW alone; with it each task computes where its pieces lie from their rank among equal lengths.

Tokenizing is the only pass over texts. Words (stretches between ASCII spaces and line feeds) are tokenized once per
worker and then looked up: this tokenizer works on white-space-free stretches, so ids of a text are those of its words.

Defined results: null and empty texts are the end token alone; repeated rows are packed each for itself; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import arrow_rows, cut

WINDOW, END_ID = 4096, 2
#: Words of a generation whose ids a worker keeps, and texts whose words are looked up together.
KEPT_WORDS, TOGETHER = 450_000, 250
#: Rows that Python gets at once.
BATCH = 1000
#: Pieces of one length that are ranked in one group, about, and groups of a length at most (groups then grow).
RANKED_TOGETHER, MOST_GROUPS = 128, 65_536


#: The stretches of a lower-case text that the tokenizer (see its file) encodes each by itself.
_STRETCHES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"


@lru_cache(maxsize=1)
def _newer() -> tuple[re.Pattern, re.Pattern]:
    """Code points that Unicode 3.2 did not assign, about which Python and the tokenizer may disagree; and those of them
    that have another lower case."""

    def pattern(points: list[int]) -> re.Pattern:
        runs: list[list[int]] = []
        for cp in points:
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")

    old = unicodedata.ucd_3_2_0.category
    points = [cp for cp in range(0x110000) if old(chr(cp)) == "Cn"]
    return pattern(points), pattern([cp for cp in points if chr(cp).lower() != chr(cp)])


class Tree:
    """Smallest used room at or above a length, by a segment tree over rooms 0 to size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.used = [False] * (2 * self.leaves)

    def set(self, room: int, used: bool) -> None:
        i = room + self.leaves
        self.used[i] = used
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.used[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, first_window, per_window, offset): pieces of that length from that rank on fill
    consecutive windows, per_window in each, from that offset; the next row of the length (or its count) ends the row.

    Equals piece-by-piece best fit: after a piece goes into the tightest window, that window, if it still has room, is
    the tightest for the next piece of the same length, so windows of equal room are filled one after the other.
    """
    rows, rooms, tree, opened = [], defaultdict(list), Tree(window), 0
    for length in sorted((n for n in counts if counts[n] > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = window, window // length
                need = -(-left // per)
                first, opened = opened, opened + need
                groups = [(first, need)]
            else:
                groups, per = rooms.pop(room), room // length
                tree.set(room, False)
            for n, (first, many) in enumerate(groups):
                full = min(many, left // per)
                parts = [(first, full, per)] if full else []
                if full < many and left - full * per:
                    parts.append((first + full, 1, left - full * per))
                for at, windows, each in parts:
                    rows.append((length, rank, at, each, window - room))
                    rank += windows * each
                    left -= windows * each
                    put = room - each * length
                    if put:
                        rooms[put].append((at, windows))
                        tree.set(put, True)
                done = sum(p[1] for p in parts)
                if done < many:
                    rooms[room].append((first + done, many - done))
                    tree.set(room, True)
                if not left:
                    for rest in groups[n + 1 :]:
                        rooms[room].append(rest)
                        tree.set(room, True)
                    break
    return rows


class WordIds:
    """Ids of whole texts, by words that were met before. Of two generations of words the older one is dropped when the
    younger is full; a word that is met again moves to the younger."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.kept = kept
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> None:
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.young[w] = array("I", e.ids).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Puts words, none of which is in the younger generation, there."""
        young, old = self.young, self.old
        unknown = set()
        for w in words:
            if (ids := old.get(w)) is not None:
                young[w] = ids
            else:
                unknown.add(w)
        newer = _newer()[0].search
        strange = {w for w in unknown if not w.isascii() and newer(w)}
        # a word is the stretches the tokenizer would cut it into, where nothing else would happen to it before that
        cut = {w: _STRETCHES.findall(w) for w in unknown - strange if not w.isalpha() and (w.isascii() or unicodedata.is_normalized("NFC", w)) and w == w.lower()}
        new = unknown.difference(cut)
        for parts in cut.values():
            new.update(part for part in parts if part not in young)
        letters = [w for w in new if w.isalpha() and w not in strange]
        self._encode([w for w in new if not w.isalpha() or w in strange])
        # a word of letters is one stretch and ends with its only end-of-word token, so many are encoded as one text
        groups = [letters[a : a + 256] for a in range(0, len(letters), 256)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(some):
                blob, a = ids.tobytes(), 0
                for w, b in zip(some, ends, strict=True):
                    young[w] = blob[a:b]
                    a = b
            else:
                self._encode(some)
        for w, parts in cut.items():
            young[w] = b"".join([young[part] for part in parts])

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        get = self.young.get
        split, missing = [], set()
        for t in texts:
            # lower case is what the tokenizer makes of its input first; only this letter's depends on its neighbours here
            t = t.lower() if "\u03a3" not in t else t
            # these four count as space for str.split, but not for the tokenizer
            words = t.split() if not any(c in t for c in _SEPARATORS) else [w for line in t.split("\n") for w in line.split(" ") if w]
            found = list(map(get, words))
            if None in found:
                missing.update(w for w, ids in zip(words, found, strict=True) if ids is None)
                split.append((words, None))
            else:
                split.append((None, found))
        self._learn(missing)
        get, cased = self.young.__getitem__, _newer()[1].search
        for text, (words, found) in zip(texts, split, strict=True):
            if any(s in text for s in self.special) or (not text.isascii() and cased(text)):  # those strings are found before words are
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield np.frombuffer(b"".join(map(get, words) if found is None else found), np.uint32)


@lru_cache(maxsize=2)
def _word_ids(path: str, kept: int) -> WordIds:
    return WordIds(path, kept)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, window: int, kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path, kept)
        for batch in batches:
            out = []
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a in range(0, len(texts), TOGETHER):
                some = [t or "" for t in texts[a : a + TOGETHER]]
                for doc_id, own in zip(doc_ids[a : a + TOGETHER], words.ids(some), strict=True):
                    ids = np.append(own, np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            names = [c.split()[0] for c in PIECES.split(", ")]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return pieces


def tokenized_pieces(docs: DataFrame, path: str, window: int = WINDOW, kept: int = KEPT_WORDS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: full windows and a rest."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, window, kept), PIECES)


def _placer(plan: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] * (1 << 48) + plan[:, 1]
        for rows in batches:
            length, rank = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            k = rank - row[:, 1]
            kept = rows.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)], [*kept, "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces (length at most window)."""
    with arrow_rows(pieces.sparkSession, BATCH):
        pieces = cut(pieces, "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    total = sum(counts.values())
    plan = np.array(sorted(best_fit_decreasing(counts, window)), np.int64).reshape(-1, 5)
    spread = max(1, min(MOST_GROUPS, -(-total // RANKED_TOGETHER)))
    # ranks among pieces of one length: those fall into groups by hash, as many groups as the length has rows for
    width = F.greatest(F.lit(1), F.least(F.lit(spread), F.ceil(F.col("n") / RANKED_TOGETHER)))
    per_length = F.broadcast(pieces.groupBy("length").agg(F.count("*").alias("n")))
    dealt = pieces.join(per_length, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), width)).drop("n")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("own") + F.col("base")).cast("long").alias("rank"))
    return ranked.mapInArrow(_placer(plan), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, kept: int = KEPT_WORDS) -> DataFrame:
    """Pieces of all documents with their places. kept: words of a generation that a worker remembers; fewer need less
    memory and more time, and change no result."""
    return pack(tokenized_pieces(docs, path, window, kept), window)
