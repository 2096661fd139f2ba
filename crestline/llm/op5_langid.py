"""Language identification with hyperdimensional profiles.

Letters get random +1/-1 vectors. An n-gram of three symbols is the product of its letters' vectors, the first rotated
twice and the second once; a text is the sum of its n-grams' vectors, and a language's prototype the sum of the unit
vectors of its training texts. A text is compared with every prototype by cosine; of equal cosines the language
first by code point wins. Symbols: letters lower-cased, each with a vector of its own made from its code point; all else is
one boundary symbol (runs of it collapse).

Whole texts are counted, n-gram by n-gram, so a long text costs its characters once and its distinct n-grams times
DIMENSIONS. Prototypes are fitted on at most TRAIN_PER_LANG texts per language, chosen by hash, for the LANGUAGES commonest
labels; there is one prototype row per language, whatever the input's size.

How near a text comes to its language depends on how many different n-grams it has, so `known_language` asks for a
cosine by that number (`variety`). Training texts and their beginnings are compared with the prototype of their language
without themselves; a text has to reach PART of what all but LOWEST of them reach at its variety.

Defined results: texts that are null or hold no letter are `und` with score 0; with nothing to learn from, all are
`und`; repeated rows count each for itself; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import cut

#: Training texts of a language at most (the documented bound of the sample).
TRAIN_PER_LANG = 500
#: Labels that are learned at most, the commonest first: a bound on what reaches the driver.
LANGUAGES = 8192
DIMENSIONS = 512
#: Letters beyond a to z whose vectors a worker keeps, and n-grams that are bound in one go.
KEPT_LETTERS, BOUND = 20_000, 8192
#: Texts are cut for counting into pieces of so many characters that overlap by two; counts are summed.
PIECE = 1 << 20
UNKNOWN = "und"
#: A text of no language: below PART of the cosine that all but LOWEST of the training texts of its variety reach.
PART, LOWEST = 0.5, 0.02
#: Characters of the beginnings that stand for short texts, and the fewest texts that set a floor.
BEGINNINGS, FEWEST = (8, 16, 32, 64, 128, 256, 512), 20


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for none, 1 to 26 for a to z, else the code point of the lower-case letter."""
    table = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else low
    return table


@lru_cache(maxsize=KEPT_LETTERS)
def _letter(symbol: int, seed: int) -> np.ndarray:
    """The vector of a symbol, made from its code point alone."""
    return np.random.default_rng([seed, symbol]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def _bound(letters: np.ndarray, ngrams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    a, b, c = ngrams
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


@lru_cache(maxsize=2)
def _plain(seed: int) -> np.ndarray:
    """The bound vectors of all n-grams of a to z and the boundary."""
    every = np.arange(27**3)
    return _bound(np.array([_letter(k, seed) for k in range(27)]), (every // 729, every // 27 % 27, every % 27)).astype(np.float32)


def _ngram_vectors(seen: np.ndarray, seed: int) -> np.ndarray:
    """The bound vectors of n-grams, as rows of +1/-1."""
    a, b, c = seen >> 42, seen >> 21 & 0x1FFFFF, seen & 0x1FFFFF
    out = np.empty((len(seen), DIMENSIONS), np.float32)
    plain = (a < 27) & (b < 27) & (c < 27)
    out[plain] = _plain(seed)[(a[plain] * 27 + b[plain]) * 27 + c[plain]]
    rest = np.flatnonzero(~plain)
    if len(rest):
        symbols, at = np.unique(np.concatenate([x[rest] for x in (a, b, c)]), return_inverse=True)
        out[rest] = _bound(np.array([_letter(int(k), seed) for k in symbols]), tuple(at.reshape(3, -1)))
    return out


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The n-grams of a whole text (21 bits a symbol) and how often each occurs; None if it has no letter."""
    if not text:
        return None
    seen, counts, carry = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    letters = False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        s = _symbols()[codes]
        letters = letters or bool(s.any())
        s = np.concatenate((carry, s, np.zeros(int(at + PIECE >= len(text)), np.int64)))
        s = s[np.concatenate(([True], (s[1:] | s[:-1]) != 0))]
        if len(s) > 2:
            own, times = np.unique(s[:-2] << 42 | s[1:-1] << 21 | s[2:], return_counts=True)
            if len(seen):
                own, group = np.unique(np.concatenate((seen, own)), return_inverse=True)
                times = np.bincount(group, np.concatenate((counts, times))).astype(np.int64)
            seen, counts = own, times
        carry = s[-2:]
    return (seen, counts) if letters else None


def _bundle(seen: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(seen), BOUND):  # a long text in many scripts has many n-grams
        out += counts[at : at + BOUND].astype(np.float32) @ _ngram_vectors(seen[at : at + BOUND], seed)
    return out


def profile(text: str | None, seed: int) -> np.ndarray | None:
    """The bundled vector of a whole text; None if it has no letter."""
    found = _counts(text)
    return None if found is None else _bundle(*found, seed)


def variety(counts: np.ndarray) -> int:
    """Binary logarithm, rounded down, of how many n-grams a text has if repeated ones count for little: the squared sum
    of the counts over the sum of their squares."""
    wide = counts.astype(np.float64)
    return int(np.log2(max(1.0, wide.sum() ** 2 / max(1.0, (wide * wide).sum()))))


def _sums(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                if (v := profile(text.as_py(), seed)) is not None and (norm := np.linalg.norm(v)) > 0:
                    found[lang] = found.get(lang, 0) + v.astype(np.float64) / norm
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(found), pa.string()), "vector": pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))})

    return sums


def _picked(labelled: DataFrame, seed: int) -> DataFrame | None:
    """text and lang of at most TRAIN_PER_LANG texts of each language; None without any."""
    known = labelled.where("lang IS NOT NULL").select("text", "lang", F.xxhash64(F.lit(seed), "doc_id").alias("key"))
    share = F.pmod("key", F.lit(1 << 40)) / (1 << 40)
    per = known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "of").limit(LANGUAGES)
    per = cut(per, "langid-labels")
    if per.isEmpty():
        return None
    # at most LANGUAGES rows; a share by hash leaves few rows a language, of which the first are taken
    chosen = known.join(F.broadcast(per), F.col("lang") == F.col("of")).where(share < 1.2 * TRAIN_PER_LANG / F.col("n"))
    first = Window.partitionBy("lang").orderBy("key", "text")
    return chosen.withColumn("at", F.row_number().over(first)).where(F.col("at") <= TRAIN_PER_LANG).select("text", "lang")


def _summed(picked: DataFrame | None, seed: int) -> dict[str, np.ndarray]:
    """The sum of the unit vectors of each language's texts, where it is not zero."""
    if picked is None:
        return {}
    vectors = picked.mapInArrow(_sums(seed), "lang string, vector array<double>")
    summed = vectors.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    langs = {}
    for lang, k, x in summed.collect():
        langs.setdefault(lang, np.zeros(DIMENSIONS))[k] = x
    return {k: langs[k] for k in sorted(langs) if np.linalg.norm(langs[k]) > 0}


def _prototypes(langs: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = list(langs)
    # rounded: sums of doubles depend on the order of tasks in their last bits
    return names, np.round(np.array([langs[k] / np.linalg.norm(langs[k]) for k in names]).reshape(len(names), DIMENSIONS), 9)


def fit(labelled: DataFrame, seed: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from at most TRAIN_PER_LANG texts of each."""
    return _prototypes(_summed(_picked(labelled, seed), seed))


def without_itself(text: str | None, total: np.ndarray, seed: int) -> list[tuple[int, float]]:
    """Variety of a training text and of its beginnings, and their cosines with the sum of its language's other texts."""
    found = _counts(text)
    if found is None or not (norm := np.linalg.norm(own := _bundle(*found, seed))):
        return []
    rest = total - own / norm
    if not (size := np.linalg.norm(rest)) > 1e-6:  # nothing else was learned
        return []
    parts = [found, *(_counts(text[:n]) for n in BEGINNINGS if n < len(text))]
    vectors = [(variety(x[1]), _bundle(*x, seed)) for x in parts if x is not None]
    return [(k, round(float(rest @ v / size / norm), 9)) for k, v in vectors if (norm := np.linalg.norm(v))]


def floors(quantiles: dict[int, tuple[int, float]], least: float) -> list[float]:
    """The cosine to reach at each variety, from the number and low quantile of training cosines there; where too few were
    learned from, what holds for less variety, and `least` at least."""
    out = [least]
    for k in range(max(quantiles, default=0) + 1):
        n, low = quantiles.get(k, (0, 0.0))
        out.append(max(least, PART * low) if n >= FEWEST else out[-1])
    return out[1:]


def _fit_floors(picked: DataFrame, langs: dict[str, np.ndarray], least: float, seed: int) -> list[float]:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True) if lang in langs for x in without_itself(text.as_py(), langs[lang], seed)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.float64())], ["variety", "cosine"])

    cosines = picked.mapInArrow(compare, "variety int, cosine double")
    found = cosines.groupBy("variety").agg(F.count("*").alias("n"), F.percentile("cosine", F.lit(LOWEST)).alias("low")).collect()
    return floors({r["variety"]: (r["n"], r["low"]) for r in found}, least)


def _predictor(names: list[str], prototypes: np.ndarray, seed: int, least: list[float] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("__text"):
                found = _counts(text.as_py()) if names else None
                if found is None or not (norm := np.linalg.norm(v := _bundle(*found, seed))):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cosines = prototypes @ v / norm
                    best = int(np.argmax(cosines))
                    near = least is None or cosines[best] >= least[min(variety(found[1]), len(least) - 1)]
                    langs.append(names[best] if near else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            kept = [c for c in batch.schema.names if c != "__text"]
            columns = [batch.column(c) for c in kept] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    return predict


def held_out() -> Column:
    """The documents never learned from: crc32 of the id as text divides by 5."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 5 == 0


def identify(docs: DataFrame, labelled: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, after learning from `labelled`."""
    names, prototypes = fit(labelled, seed)
    given = docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("__text"))
    return given.mapInArrow(_predictor(names, prototypes, seed), "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, least: float, seed: int = 1) -> DataFrame:
    """Documents whose text has letters and comes as near to some language as texts of its variety do, `least` at least;
    columns as given."""
    picked = _picked(docs.where(~held_out()), seed)
    if picked is not None:
        picked = cut(picked, "langid-learned")
    langs = _summed(picked, seed)
    names, prototypes = _prototypes(langs)
    nearest = _fit_floors(picked, langs, least, seed) if langs else None
    columns = docs.columns
    given = docs.select(F.struct(*columns).alias("__row"), F.col("text").alias("__text"))
    schema = given.select("__row").schema.add("lang_pred", "string").add("score", "double")
    scored = given.mapInArrow(_predictor(names, prototypes, seed, nearest), schema)
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("__row.*")
