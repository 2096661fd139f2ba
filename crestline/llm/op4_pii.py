"""Personal data: exact patterns, and a character BiLSTM-CRF for the forms that patterns miss.

The base finds e-mail addresses, IPv4 addresses, card and phone numbers by fixed patterns, in time linear in the text.
The network (a bidirectional LSTM over character classes, emissions into a CRF with learned transitions) is trained here
in numpy, by Adam on the exact CRF likelihood, from labelled spans: generated sentences with national phone numbers,
spelled-out addresses (`name (at) host.org`), dotted cards and bracketed IPs, among numbers that are none of these.
It reads every window that holds a digit, an `@` or a spelled-out `at`; no kind can occur elsewhere. Windows overlap by
half, and each spelled-out `at` has one more, around its address; each is decoded by Viterbi. A span that holds a
spelled-out `at` is completed to the whole address around it, however long, so a window's edge cuts none. Other spans cut
by an edge inside the text are left to the neighbour, and those that no window saw whole are decoded once more in one of
twice the width, centred on them. What remains is reconciled over the whole text: surest first, no overlap among
themselves nor with a base span, and only if the span's characters could be such data at all (digit counts, checksums).
Base spans always stay.

Training is seeded and does not read the tables; the network has some 10,000 numbers, sent with the tasks.

Defined results: null texts are empty and hold nothing; offsets count code points, ends are exclusive; repeated rows
count each for itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
HIDDEN, WINDOW, STRIDE, CONTEXT = 16, 64, 32, 24
#: Least probability of each tag of a span that the network adds.
SURE = 0.8
EPOCHS, BATCH, SENTENCES = 14, 256, 4096

# ---- the base -----------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
_SPELLED_AT = re.compile(r" ?[(\[]at[)\]] ?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _parts_fit(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every pattern match, in order of kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if _parts_fit(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ---- the network --------------------------------------------------------------------------------------------------

_MARKS = "@.-_+%()[] \n/:=\"',|#$*"
_N_CLASSES = 8 + len(_MARKS)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point up to 127, then one for letters and one for the rest; 0 pads."""
    table = np.full(129, 4, np.int64)
    for i in range(128):
        c = chr(i)
        if c.isdigit():
            table[i] = 1
        elif "a" <= c <= "z":
            table[i] = 7 if c in "at" else 2
        elif "A" <= c <= "Z":
            table[i] = 3
        elif c in _MARKS:
            table[i] = 8 + _MARKS.index(c)
    table[128] = 5
    return table


def encode(texts: list[str], length: int = WINDOW) -> np.ndarray:
    out = np.zeros((len(texts), length), np.int64)
    for row, text in zip(out, texts, strict=True):
        codes = np.frombuffer(text[:length].encode("utf-32-le", "surrogatepass"), np.uint32)
        row[: len(codes)] = _classes()[np.minimum(codes, 128)]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"out": scale(2 * HIDDEN, len(TAGS)), "bias": np.zeros(len(TAGS)), "pass": np.zeros((len(TAGS), len(TAGS)))}
    for d in "fb":
        p[f"{d}x"] = rng.normal(0, 0.4, (_N_CLASSES, 4 * HIDDEN))
        p[f"{d}x"][:, HIDDEN : 2 * HIDDEN] += 1  # forget gates start open
        p[f"{d}h"] = scale(HIDDEN, 4 * HIDDEN)
    return p


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    n, steps = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out, kept = np.empty((steps, n, HIDDEN)), []
    for t in range(steps):
        z = wx[x[:, t]] + h @ wh
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, c = (h, c), f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        out[t] = h
        if keep:
            kept.append((before, i, f, o, g, squashed))
    return out, kept


def _lstm_back(x: np.ndarray, wh: np.ndarray, kept: list, d_out: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    d_wx, d_wh = np.zeros((n_classes, 4 * HIDDEN)), np.zeros_like(wh)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(kept) - 1, -1, -1):
        (h, c), i, f, o, g, squashed = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        d_wh += h.T @ dz
        onehot = np.zeros((len(dz), n_classes))
        onehot[np.arange(len(dz)), x[:, t]] = 1
        d_wx += onehot.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return d_wx, d_wh


def emissions(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    ahead, kept_f = _lstm(x, p["fx"], p["fh"], keep)
    back, kept_b = _lstm(x[:, ::-1], p["bx"], p["bh"], keep)
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return both @ p["out"] + p["bias"], (both, kept_f, kept_b)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


def marginals(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over (steps, rows, tags): log partition, tag probabilities, summed expected transitions."""
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, len(e)):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(len(e) - 2, -1, -1):
        beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    pairs = np.zeros_like(trans)
    for t in range(1, len(e)):
        pairs += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    return z, np.exp(alpha + beta - z[:, None]), pairs


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    best, back = e[0], np.zeros(e.shape, np.int8)
    for t in range(1, len(e)):
        scores = best[:, :, None] + trans
        back[t] = scores.argmax(axis=1)
        best = scores.max(axis=1) + e[t]
    path = np.empty(e.shape[:2], np.int64)
    path[-1] = best.argmax(axis=1)
    rows = np.arange(e.shape[1])
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t][rows, path[t]]
    return path


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of tags y (rows, steps), and its gradients."""
    e, (both, kept_f, kept_b) = emissions(p, x, keep=True)
    z, prob, pairs = marginals(e, p["pass"])
    n, steps = x.shape
    rows = np.arange(n)
    gold = sum(e[t][rows, y[:, t]] for t in range(steps)) + p["pass"][y[:, :-1], y[:, 1:]].sum(axis=1)
    de = prob.copy()
    for t in range(steps):
        de[t][rows, y[:, t]] -= 1
    np.subtract.at(pairs, (y[:, :-1], y[:, 1:]), 1)
    de /= n
    d_both = de @ p["out"].T
    g = {"pass": pairs / n, "bias": de.sum(axis=(0, 1)), "out": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, len(TAGS))}
    g["fx"], g["fh"] = _lstm_back(x, p["fh"], kept_f, d_both[:, :, :HIDDEN], len(p["fx"]))
    g["bx"], g["bh"] = _lstm_back(x[:, ::-1], p["bh"], kept_b, d_both[::-1, :, HIDDEN:], len(p["bx"]))
    return float((z - gold).mean()), g


def train(samples: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 1, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Fits the network to texts of up to WINDOW characters with labelled (kind, start, end) spans."""
    x, y = encode([t for t, _ in samples]), np.zeros((len(samples), WINDOW), np.int64)
    for row, (_, spans) in zip(y, samples, strict=True):
        for kind, a, b in spans:
            row[a : min(b, WINDOW)] = 2 + 2 * kind
            if a < WINDOW:
                row[a] = 1 + 2 * kind
    p, rng, step = initial(seed), np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            _, g = gradients(p, x[rows], y[rows])
            norm = np.sqrt(sum((a**2).sum() for a in g.values()))
            step += 1
            for k, a in g.items():
                a = a * min(1, 5 / norm)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a**2
                rate = 0.02 * (0.5 if epoch > epochs // 2 else 1)
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def sample(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A labelled sentence of at most WINDOW characters: words, data of one kind or none, and look-alikes."""
    letters = "abcdefghijklmnopqrstuvwxyzéèüöñ"
    word = lambda low=1, high=9: "".join(rng.choices(letters, k=rng.randint(low, high)))
    plain = lambda low=2, high=9: "".join(rng.choices(letters[:26], k=rng.randint(low, high)))
    num = lambda n: "".join(rng.choices("0123456789", k=n))

    def card(mark: str) -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return mark.join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at = rng.choice(["@", " (at) ", " [at] ", "(at)", "[at]"])
        name = plain(1) + rng.choice(["", num(2), "." + plain(), "_" + plain(1), f"-{plain(1)}.{plain()}"])
        host = plain(1) + rng.choice(["", num(1), "-" + plain(), "." + plain(1)])
        return f"{name}{at}{host}.{rng.choice(['example.com', 'com', 'org', 'net', 'de', 'io'])}"

    def phone() -> str:
        area, mid, end = num(3), num(3), num(4)
        return rng.choice([f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"+{num(1)} ({area}) {mid}-{end}", f"1-{area}-{mid}-{end}", f"+{num(2)} {area} {mid} {end}"])

    def other() -> str:
        return rng.choice([
            num(rng.randint(1, 18)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)}:{num(2)}:{num(2)}", f"${num(3)}.{num(2)}", f"{num(1)}.{num(1)}.{num(2)}",
            "".join(rng.choices("0123456789abcdef", k=rng.randint(8, 40))), f"{num(2)}%", f"@{plain()}", f"{num(3)},{num(3)},{num(3)}", f"v{num(1)}.{num(1)}", f"{plain()}({num(1)})", f"{num(3)}-{num(3)}", f"({num(4)})", f"{num(1)}. {word()}", f"{word()} at {word()}",
        ])

    makers = (email, lambda: rng.choice([".", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4)), lambda: card(rng.choice(["", " ", "-", ".", "_"])), phone)
    text, spans = "", []
    for _ in range(rng.randint(0, 5)):
        text += word() + rng.choice([" ", " ", " ", ", ", ". ", "\n"])
    text = text[rng.randint(0, 3) :]
    for _ in range(rng.randint(1, 3)):
        kind = rng.randrange(8)
        piece = makers[kind]() if kind < 4 else other()
        if len(text) + len(piece) > WINDOW:
            break
        if kind < 4:
            spans.append((kind, len(text), len(text) + len(piece)))
        text += piece + rng.choice([" ", " ", ", ", ". ", "\n"]) + rng.choice(["", word() + " "])
    while len(text) < WINDOW and rng.random() < 0.9:
        text += word() + " "
    return text[:WINDOW], spans


@lru_cache(maxsize=2)
def network(seed: int = 1) -> dict[str, np.ndarray]:
    rng = random.Random(seed)
    return train([sample(rng) for _ in range(SENTENCES)], seed)


# ---- decoding -----------------------------------------------------------------------------------------------------


def plausible(kind: int, text: str) -> bool:
    """Whether such characters could be data of that kind at all."""
    digits = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+(@| ?[(\[]at[)\]] ?)[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}((\.|\[\.\])[0-9]{1,3}){3}", text)) and _parts_fit(text.replace("[.]", "."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"[+0-9(][0-9(). -]*[0-9]", text)) and bool(re.search(r"[0-9][). -]+[0-9]", text))


def spelled_out(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, start and end of the `at`) of every stretch of characters that could be an address with a spelled-out
    at; as for the base, an address does not begin before the end of the one before it."""
    out, before = [], 0
    for m in _SPELLED_AT.finditer(text):
        start = m.start()
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (host := _DOMAIN.match(text, m.end())):
            before = host.end()
            out.append((start, before, *m.span()))
    return out


def windows(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, open on the left, open on the right) of overlapping windows over all stretches near a trigger, and of
    one around each address with a spelled-out at, or around its at if it is longer than a window."""
    stretch: list[int] | None = None

    def cuts(a: int, b: int) -> Iterator[tuple[int, int, bool, bool]]:
        at = a
        while True:
            end = min(at + WINDOW, b)
            yield at, end, at > 0, end < len(text)
            if end == b:
                return
            at += STRIDE

    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if stretch and a <= stretch[1]:
            stretch[1] = b
        else:
            if stretch:
                yield from cuts(*stretch)
            stretch = [a, b]
    if stretch:
        yield from cuts(*stretch)
    for a, b, x, y in spelled_out(text):
        middle = (a + b if b - a <= WINDOW else x + y) // 2
        a, b = max(0, middle - WINDOW // 2), min(len(text), middle + WINDOW // 2)
        yield a, b, a > 0, b < len(text)


def _read(p: dict[str, np.ndarray], texts: list[str], whole: list[list[tuple[int, int, int, int]]], places: list[tuple[int, int, int, bool, bool]], width: int, found: list[list[tuple[float, int, int, int]]]) -> list[tuple[int, int, int]]:
    """Adds to `found` what the network sees in the windows; returns (text, start, end) of the spans that an edge cut."""
    torn = []
    many = 2048 * WINDOW // width
    for at in range(0, len(places), many):
        part = places[at : at + many]
        x = encode([texts[k][a:b] for k, a, b, _, _ in part], width)
        e, _ = emissions(p, x)
        path = viterbi(e, p["pass"])
        hits = np.flatnonzero(path.any(axis=0))
        if not len(hits):
            continue
        _, prob, _ = marginals(e[:, hits], p["pass"])
        for col, w in enumerate(hits):
            k, a, b, left, right = part[w]
            tags = path[: b - a, w]
            t = 0
            while t < len(tags):
                if not tags[t]:
                    t += 1
                    continue
                kind, s = (tags[t] - 1) // 2, t
                t += 1
                while t < len(tags) and tags[t] == 2 + 2 * kind:
                    t += 1
                start, end = a + s, a + t
                n = bisect_left(whole[k], start, key=lambda w: w[2]) if kind == 0 else len(whole[k])
                if n < len(whole[k]) and whole[k][n][3] <= end:
                    start, end = whole[k][n][:2]
                elif (s == 0 and left) or (t == len(tags) and right):
                    torn.append((k, start, end))
                    continue  # a neighbour sees it whole, or a wider window
                sure = float(prob[np.arange(s, t), col, tags[s:t]].min())
                if sure >= SURE and plausible(int(kind), texts[k][start:end]):
                    found[k].append((-sure, int(kind), start, end))
    return torn


def decode(p: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans the network adds to the base spans of each text."""
    found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    whole = [spelled_out(text) if "at" in text else [] for text in texts]
    torn = _read(p, texts, whole, [(k, *w) for k, text in enumerate(texts) for w in windows(text)], WINDOW, found)
    again = set()
    seen = {}
    for k in {k for k, _, _ in torn}:
        starts = sorted((x, y) for _, _, x, y in found[k])
        seen[k] = [x for x, _ in starts], [0, *accumulate((y for _, y in starts), max)]
    for k, a, b in torn:
        starts, ends = seen[k]
        if ends[bisect_left(starts, b)] <= a:  # no whole span reaches into it
            middle = (a + b) // 2
            x, y = max(0, middle - WINDOW), min(len(texts[k]), middle + WINDOW)
            again.add((k, x, y, x > 0, y < len(texts[k])))
    if again:
        _read(p, texts, whole, sorted(again), 2 * WINDOW, found)
    out = []
    for text, spans in zip(texts, found, strict=True):
        taken = [(a, b) for _, a, b in base_spans(text)] if spans else []
        kept = []
        for _, kind, a, b in sorted(spans):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                kept.append((kind, a, b))
        out.append(sorted(kept))
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _finder(p: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    nothing = hashlib.sha256(b"").hexdigest()
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, 0, 0, 0, 0, nothing, "") for i in ids]
            hit = [(n, t) for n, x in enumerate(batch.column("text")) if (t := x.as_py()) and _TRIGGER.search(t)]
            for (n, text), added in zip(hit, decode(p, [t for _, t in hit]), strict=True):
                base = base_spans(text)
                counts = [sum(s[0] == k for s in base) for k in range(4)]
                rows[n] = (ids[n], *counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + added)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return find


def find_personal_data(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, counts of the base, digest of the base, all spans, for every row."""
    return docs.select("doc_id", "text").mapInArrow(_finder(network(seed)), RESULT)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replaces spans by <KIND>; of overlapping ones the first and longest names the whole stretch."""
    out, at = [], 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def _redactor(p: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hit = [n for n, t in enumerate(texts) if t and _TRIGGER.search(t)]
            for n, added in zip(hit, decode(p, [texts[n] for n in hit]), strict=True):
                if spans := base_spans(texts[n]) + added:
                    texts[n] = redact(texts[n], spans)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return clean


def without_personal_data(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows with spans replaced in their texts; n_chars, where given, follows the new text."""
    cleaned = docs.mapInArrow(_redactor(network(seed)), docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
