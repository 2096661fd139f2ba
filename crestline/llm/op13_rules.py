"""Quality scores from a sparse ensemble of rules, compiled into column expressions.

Each text is described by 18 statistics, computed in the JVM. Small trees, each fitted to what those before it left
over, cut the labelled rows by these statistics; every path from a root is a rule, a conjunction of at most DEPTH
comparisons. A logistic model with one weight a rule is then fitted under a lasso penalty, from strong to weak, and the one
that does best on a fifth of the labelled rows kept back from it (at most MOST_RULES rules) is taken. Its rules become
columns: scoring is one projection over the table, without Python and without a shuffle.

Learning takes the SAMPLE labelled ids of least hash (a documented bound; labels and statistics of those alone reach the
driver), seeded; everything else covers all rows. A rerun learns the same rules.

Defined results: null texts count as empty, for which all statistics are 0; a null id hashes like an empty one and has no
label; of several labels of an id the least counts, of several texts of an id one; null labels are ignored; without labels,
or with only one kind, every score is the smoothed share of good ones (0.5 without any); repeated rows are rows of their
own; texts of any length are read whole; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows learned from, at most.
SAMPLE = 16_384
#: Trees, their depth, cuts tried for each statistic, rows a rule must cover, and how much of each tree's answer is kept.
TREES, DEPTH, CUTS, LEAST, RATE = 60, 3, 32, 10, 0.3
#: Rules of the result, steps from the strongest penalty to 1/200 of it, and gradient steps for each.
MOST_RULES, PENALTIES, STEPS = 40, 24, 120
#: From this score on a text counts as good.
GOOD = 0.3
#: White space of words.
_SPACE = r"[\x20\x09-\x0D]+"

STATISTICS = (
    "chars", "words", "lines", "word_length", "longest_word", "line_length", "letters", "capitals", "digits", "spaces", "marks", "symbols",
    "distinct_words", "distinct_lines", "short_words", "bare_lines", "ended_lines", "bars",
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and `s`, a struct of doubles: what the rules are about."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    one = docs.select(*keep, text.alias("t"))
    two = one.select(
        "*", F.filter(F.split("t", _SPACE), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda w: w != "").alias("l"), F.length("t").cast("double").alias("n"),
        (F.length("t") - without(r"\p{L}+")).alias("letters"), (F.length("t") - without(r"\p{Lu}+")).alias("capitals"), (F.length("t") - without(r"[0-9]+")).alias("digits"),
        (F.length("t") - without(r"[\x20\x09-\x0D]+")).alias("spaces"), (F.length("t") - without(r"[.,;:?'\"()-]+")).alias("marks"), (F.length("t") - F.length(F.translate("t", "|", ""))).alias("bars"),
    )
    words, lines, n = F.size("w"), F.size("l"), F.col("n")
    symbols = F.length("t") - F.col("letters") - F.col("digits") - F.col("spaces") - F.col("marks")
    found = {
        "chars": n,
        "words": words,
        "lines": lines,
        "word_length": _share(n - F.col("spaces"), words),
        "longest_word": F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0)),
        "line_length": _share(n, lines),
        "letters": _share(F.col("letters"), n),
        "capitals": _share(F.col("capitals"), F.col("letters")),
        "digits": _share(F.col("digits"), n),
        "spaces": _share(F.col("spaces"), n),
        "marks": _share(F.col("marks"), n),
        "symbols": _share(symbols, n),
        "distinct_words": _share(F.size(F.array_distinct("w")), words),
        "distinct_lines": _share(F.size(F.array_distinct("l")), lines),
        "short_words": _share(F.size(F.filter("w", lambda w: F.length(w) <= 3)), words),
        "bare_lines": _share(F.size(F.filter("l", lambda x: F.length(x) <= 20)), lines),
        "ended_lines": _share(F.size(F.filter("l", lambda x: x.endswith(".") | x.endswith("?") | x.endswith("!"))), lines),
        "bars": _share(F.col("bars"), words),
    }
    return two.select(*keep, F.struct(*[found[s].cast("double").alias(s) for s in STATISTICS]).alias("s"))


@dataclass(frozen=True)
class Rule:
    """All of its comparisons hold: (statistic, whether above, border)."""

    parts: tuple[tuple[int, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, j] > border) == above for j, above, border in self.parts])

    def column(self, s: str = "s") -> Column:
        of = lambda j: F.col(f"{s}.{STATISTICS[j]}")
        return reduce(Column.__and__, [of(j) > border if above else of(j) <= border for j, above, border in self.parts])

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[j]} {'>' if above else '<='} {border:.6g}" for j, above, border in self.parts)


@dataclass
class Rules:
    """A fitted ensemble: log odds are `base` plus the weights of the rules that hold."""

    base: float
    weights: list[tuple[float, Rule]]

    def column(self, s: str = "s") -> Column:
        """The score as one expression over the struct of statistics."""
        odds = reduce(Column.__add__, [F.when(rule.column(s), w).otherwise(0.0) for w, rule in self.weights], F.lit(self.base))
        return 1 / (1 + F.exp(-odds))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum((w * rule.covers(x) for w, rule in self.weights), np.zeros(len(x))))))

    def __str__(self) -> str:
        return "\n".join([f"{self.base:+.3f}", *(f"{w:+.3f} if {rule}" for w, rule in self.weights)])


class _Trees:
    """Regression trees on binned statistics; bins are cut at quantiles."""

    def __init__(self, x: np.ndarray):
        self.borders = [np.unique(np.quantile(column, np.arange(1, CUTS) / CUTS, method="lower")) for column in x.T]
        self.bins = np.stack([np.searchsorted(b, column, "left") for b, column in zip(self.borders, x.T, strict=True)], axis=1)

    def _split(self, rows: np.ndarray, rest: np.ndarray) -> tuple[float, int, int]:
        """Gain, statistic and bin of the cut (bins up to it, bins above it) that lowers the squared error most."""
        best, total, n = (0.0, -1, -1), rest[rows].sum(), len(rows)
        for j in range(self.bins.shape[1]):
            size = len(self.borders[j]) + 1
            count = np.bincount(self.bins[rows, j], minlength=size)[:-1].cumsum()
            summed = np.bincount(self.bins[rows, j], rest[rows], size)[:-1].cumsum()
            fits = (count >= LEAST) & (n - count >= LEAST)
            if fits.any():
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(fits, summed**2 / count + (total - summed) ** 2 / (n - count) - total**2 / n, -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = float(gain[k]), j, k
        return best

    def grow(self, rows: np.ndarray, rest: np.ndarray, out: np.ndarray, path: tuple = (), every: np.ndarray | None = None) -> Iterator[tuple]:
        """Paths to all nodes; adds each leaf's mean to `out` for all rows that reach it, of the tree's sample or not."""
        every = np.arange(len(rest)) if every is None else every
        gain, j, k = self._split(rows, rest) if len(path) < DEPTH and len(rows) >= 2 * LEAST else (0.0, -1, -1)
        if j < 0:
            out[every] += rest[rows].mean() if len(rows) else 0.0
            return
        for above in (False, True):
            longer = (*path, (j, above, float(self.borders[j][k])))
            yield longer
            side = lambda r, above=above: r[(self.bins[r, j] > k) == above]
            yield from self.grow(side(rows), rest, out, longer, side(every))


def _tidy(path: tuple) -> Rule:
    """Of several comparisons of one statistic in one direction the narrowest is enough."""
    narrow: dict[tuple[int, bool], float] = {}
    for j, above, border in path:
        held = narrow.get((j, above))
        narrow[j, above] = border if held is None else max(held, border) if above else min(held, border)
    return Rule(tuple(sorted((j, above, border) for (j, above), border in narrow.items())))


def candidates(x: np.ndarray, y: np.ndarray, seed: int = 1) -> list[Rule]:
    """Rules from the paths of all trees, each once."""
    rng, trees = np.random.default_rng(seed), _Trees(x)
    odds, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(TREES):
        rest = y - 1 / (1 + np.exp(-odds))
        step = np.zeros(len(y))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        for path in trees.grow(rows, rest, step):
            found.setdefault(_tidy(path))
        odds += RATE * 4 * step  # a quarter is the largest slope of the logistic curve
    kept, seen = [], set()
    for rule in found:
        covered = rule.covers(x)
        key = np.packbits(covered).tobytes()
        if LEAST <= covered.sum() <= len(y) - LEAST and key not in seen:  # those that cover the same rows are one
            seen.add(key)
            kept.append(rule)
    return kept


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights (the base first) of least logistic loss plus penalty, by accelerated proximal gradients."""
    slope = 0.25 * np.linalg.norm(z, 2) ** 2 / len(y) + 0.25
    w, look, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        wrong = 1 / (1 + np.exp(-(look[0] + z @ look[1:]))) - y
        moved = look - np.concatenate([[wrong.mean()], z.T @ wrong / len(y)]) / slope
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - penalty / slope, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = moved + (t - 1) / after * (moved - w), moved, after
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Rules:
    """The ensemble for rows of statistics x and labels y (0 or 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    flat = Rules(float(np.log(share / (1 - share))), [])
    if len(y) < 10 * LEAST or y.min() == y.max():
        return flat
    aside = np.random.default_rng(seed).permutation(len(y)) % 5 == 0
    rules = candidates(x[~aside], y[~aside], seed)
    if not rules:
        return flat
    raw = np.stack([rule.covers(x) for rule in rules], axis=1).astype(np.float64)
    spread = raw[~aside].std(axis=0) + 1e-9
    z, centre = (raw - raw[~aside].mean(axis=0)) / spread, raw[~aside].mean(axis=0)
    strongest = np.abs(z[~aside].T @ (y[~aside] - y[~aside].mean())).max() / (~aside).sum()
    w, best = np.zeros(z.shape[1] + 1), None
    w[0] = np.log(y[~aside].mean() / (1 - y[~aside].mean()))
    for penalty in strongest * np.geomspace(1, 1 / 200, PENALTIES):
        w = lasso(z[~aside], y[~aside], penalty, w)
        if np.count_nonzero(w[1:]) > MOST_RULES and best:
            break
        odds = w[0] + z[aside] @ w[1:]
        loss = np.logaddexp(0, -odds * (2 * y[aside] - 1)).mean()
        if best is None or loss < best[0]:
            best = loss, w.copy()
    w = best[1]
    plain = w[1:] / spread
    return Rules(float(w[0] - (plain * centre).sum()), [(float(plain[k]), rules[k]) for k in np.flatnonzero(plain)])


def held_out() -> Column:
    """The documents never learned from: crc32 of the id as text divides by 5."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 1) -> Rules:
    """Rules that tell label 1 from label 0, from documents that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("y")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `sample` pairs of numbers
    rows = statistics(texts, "doc_id", "y").groupBy("doc_id").agg(F.min(F.struct("s", "y")).alias("one")).select("doc_id", "one.y", "one.s.*")
    found = rows.orderBy("doc_id").drop("doc_id").toPandas()  # `sample` rows at most
    return fit(found[list(STATISTICS)].to_numpy(np.float64).reshape(-1, len(STATISTICS)), found["y"].to_numpy(np.float64), seed)


def score(docs: DataFrame, rules: Rules, good: float = GOOD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = statistics(docs.select("doc_id", "text", held_out().alias("held_out")), "doc_id", "held_out").select("doc_id", "held_out", rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= good).cast("int"))
