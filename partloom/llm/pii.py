"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The network, trained here from labelled spans that templates generate, reads
overlapping windows of characters and adds what patterns miss: other phone formats, spaced or masked addresses. Only
windows near a digit, an @ or a masked "at" or "dot" are read, since no kind can do without one; that gate looks at
every character. Each character takes its label from the window in whose middle it is nearest; spans are then read off
the whole text at once, checked for plausibility, and dropped where they meet a base span. Base spans always stay.

Defined results: null and empty texts have no spans; positions are code points, the end exclusive; repeated rows give
repeated results; texts are read whole, in windows of bounded size.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lstm
from .common import alone, prepare, without

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STEP, HIDDEN, EMBED = 80, 40, 24, 16
#: Windows decoded at once.
BATCH = 512
LABELS = ["O", *[f"{b}-{k}" for k in KINDS for b in "BI"]]

_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile("[0-9@]")
_GATE = re.compile(r"[0-9@]|[(\[{<] ?at ?[)\]}>]|\bdot\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by start, then kind; leftmost and non-overlapping within a kind."""
    found: list[tuple[str, int, int]] = []
    if not _DIGIT_OR_AT.search(text):
        return found
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LEFT:
            start -= 1
        if start < at and (m := _RIGHT.match(text, at)):
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() <= 40 and 12 <= len(d := digits(m)) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- the network ----

_SINGLE = "@.+-()[]{}<> \n:/,;_#=\"'%"


def char_classes(text: str) -> np.ndarray:
    """Letters by themselves (case aside), digits together with their neighbourhood left to the network, some marks, the rest."""
    table = _table()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, table[np.minimum(codes, 127)], len(_SINGLE) + 31).astype(np.int64)


@functools.lru_cache(1)
def _table() -> np.ndarray:
    out = np.full(128, len(_SINGLE) + 30, np.int64)
    for i, c in enumerate(_SINGLE):
        out[ord(c)] = i
    for i in range(26):
        out[97 + i] = out[65 + i] = len(_SINGLE) + i
    out[48:58] = len(_SINGLE) + 26
    out[50:54] = len(_SINGLE) + 27  # two groups of digits, so that runs of one digit differ
    return out


N_CLASSES = len(_SINGLE) + 32


def examples(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts from templates: words of random syllables around personal data and things that look like it."""
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = "an ba cor de el fi ga ho in jo ka lo mi nu or pa qui ra so ti un ver wi xo yl zen the of é ñ ü".split()
    letters = lambda: "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(2, 9)))
    word = lambda: letters() if rng.random() < 0.3 else "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 5)))
    prose = lambda: " ".join(word() + pick("", "", "", ",", ".") for _ in range(rng.integers(1, 9)))

    def email() -> str:
        user, host, top = pick(word(), f"{word()}.{word()}", f"{word()}.{num(2)}", f"{word()}_{num(1)}"), pick(word(), f"mail{num(1)}.{word()}", f"{word()}-{word()}"), pick("com", "org", "net", "de", "fr", "es", "io", "co.uk")
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (at) ", "."), ("(at)", "."), (" at ", " dot "), (" @ ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "))
        return user + at + host.replace(".", dot) + dot + top.replace(".", dot)

    def ip() -> str:
        return ".".join(str(rng.integers(0, 256)) for _ in range(4))

    def card() -> str:
        body = [int(x) for x in pick("4", "5", "37", "6011") + num(15)][:15]
        check = next(d for d in range(10) if luhn("".join(map(str, body)) + str(d)))
        d = "".join(map(str, body)) + str(check)
        mark = pick("", "", " ", "-", ".", "/")
        return mark.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}", f"00{rng.integers(10, 99)} {a} {b}{c}", f"1-{a}-{b}-{c}")

    def decoy() -> str:
        return pick(num(rng.integers(1, 7)), f"{rng.integers(1900, 2030)}", f"{num(1)}.{num(1)}.{num(2)}", f"${num(2)}.{num(2)}", f"{num(2)}%", f"{num(2)}:{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"token = \"{''.join('0123456789abcdef'[i] for i in rng.integers(0, 16, 40))}\"", f"@{word()}", f"{word()}@{word()}", f"#{num(5)}", f"v{num(1)}.{num(2)}", f"{num(3)},{num(3)},{num(3)}", f"{num(3)}.{num(3)}", f"{word()} at {word()}", f"{word()} dot {word()}", num(20))

    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = (prose() if rng.random() < 0.85 else pick("", "mail", "call", "contact")), []
        for _ in range(rng.integers(1, 4)):
            text += pick(" ", " ", "\n", ", ", ": ", " (")
            if rng.random() < 0.65:
                kind = pick(*KINDS)
                value = made[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += decoy()
            text += pick(" ", ". ", "\n", ", ", ") ") + prose()
        out.append((text, spans))
    return out


def _labelled(made, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of examples: classes, labels and mask, time first."""
    xs, ys, ms = [], [], []
    for text, spans in made:
        x, y = char_classes(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            y[a], y[a + 1 : b] = k, k + 1
        for i in range(0, max(1, len(x) - STEP), STEP):
            i += int(rng.integers(0, STEP)) if rng.random() < 0.5 else 0  # windows begin and end anywhere
            n = min(WINDOW, len(x) - i) if rng.random() < 0.7 else min(len(x) - i, int(rng.integers(20, WINDOW)))
            if n <= 0:
                continue
            pad = (0, WINDOW - n)
            xs.append(np.pad(x[i : i + n], pad))
            ys.append(np.pad(y[i : i + n], pad))
            ms.append(np.pad(np.ones(n), pad))
    return np.array(xs).T, np.array(ys).T, np.array(ms, np.float32).T


def _emissions(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    ins = tuple((p["embed"] @ p[f"{d}_x"])[x] for d in "fr")
    states, held = lstm.both_ways({k: v for k, v in p.items() if k[:2] in ("f_", "r_")}, ins, mask, keep)
    return states @ p["out"] + p["bias"], states, held


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def _crf_grad(e: np.ndarray, y: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Gradients of the negative log likelihood of label paths: expected less observed counts."""
    steps, batch, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = start + e[0]
    for t in range(1, steps):
        new = _log_sum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        alpha[t] = np.where(mask[t][:, None] > 0, new, alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        new = _log_sum(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None] > 0, new, beta[t + 1])
    z = _log_sum(alpha[-1], 1)
    d_e = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    d_start = d_e[0].sum(0)
    pair = np.exp(alpha[:-1][:, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]) * mask[1:][:, :, None, None]
    d_trans = pair.sum((0, 1))
    rows = np.arange(batch)
    for t in range(steps):
        d_e[t][rows, y[t]] -= mask[t]
        if t:
            np.add.at(d_trans, (y[t - 1], y[t]), -mask[t])
    np.add.at(d_start, y[0], -mask[0])
    return d_e, d_trans, d_start


@functools.lru_cache(4)
def trained(n_examples: int = 2000, epochs: int = 5, seed: int = 7) -> dict[str, np.ndarray]:
    """The network's parameters, fitted on n_examples generated texts; deterministic."""
    rng = np.random.default_rng(seed)
    x, y, mask = _labelled(examples(rng, n_examples), rng)
    k = len(LABELS)
    p = {f"f_{n}": v for n, v in lstm.init(rng, EMBED, HIDDEN).items()} | {f"r_{n}": v for n, v in lstm.init(rng, EMBED, HIDDEN).items()}
    p |= {"embed": rng.normal(0, 0.5, (N_CLASSES, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, k)), "bias": np.zeros(k), "trans": np.zeros((k, k)), "start": np.zeros(k)}
    p = {n: v.astype(np.float32) for n, v in p.items()}
    adam = lstm.Adam(0.015)
    for epoch in range(epochs):
        adam.rate = 0.015 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(x.shape[1])
        for i in range(0, len(order), 64):
            b = order[i : i + 64]
            e, states, held = _emissions(p, x[:, b], mask[:, b], keep=True)
            d_e, d_trans, d_start = _crf_grad(e, y[:, b], mask[:, b], p["trans"], p["start"])
            n = len(b)
            d_e = (d_e / n).astype(np.float32)
            grads, in_f, in_r = lstm.both_back(held, d_e @ p["out"].T)
            grads |= {"out": np.tensordot(states, d_e, ((0, 1), (0, 1))), "bias": d_e.sum((0, 1)), "trans": d_trans / n, "start": d_start / n, "embed": np.zeros_like(p["embed"])}
            for d, g in (("f", in_f), ("r", in_r)):
                by_class = np.zeros((N_CLASSES, 4 * HIDDEN), np.float32)
                np.add.at(by_class, x[:, b].ravel(), g.reshape(-1, 4 * HIDDEN))
                grads[f"{d}_x"] = p["embed"].T @ by_class
                grads["embed"] += by_class @ p[f"{d}_x"].T
            adam.step(p, grads)
    return p


def viterbi(p: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Best label paths of windows (time first)."""
    e, _, _ = _emissions(p, x, mask)
    steps, batch, k = e.shape
    score, back = p["start"] + e[0], np.zeros((steps, batch, k), np.int8)
    for t in range(1, steps):
        each = score[:, :, None] + p["trans"]
        back[t] = each.argmax(1)
        score = np.where(mask[t][:, None] > 0, each.max(1) + e[t], score)
        back[t][mask[t] == 0] = np.arange(k)
    out = np.zeros((steps, batch), np.int64)
    out[-1] = score.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t][np.arange(batch), out[t]]
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows around everything that passes the gate."""
    starts, end = [], -1
    for m in _GATE.finditer(text):
        a, b = max(0, m.start() - STEP), min(len(text), m.end() + STEP)
        if a <= end - STEP:
            a = starts[-1] + STEP
        while not starts or (starts[-1] + WINDOW < b and a < b):
            starts.append(a)
            a += STEP
            if starts[-1] + WINDOW >= b:
                break
        end = starts[-1] + WINDOW
    return starts


_SHAPES = {
    "email": re.compile(r"[\w.%+-]+ ?(?:@|[(\[{<] ?at ?[)\]}>]|\bat\b) ?[\w-]+(?: ?(?:\.|[(\[{<] ?dot ?[)\]}>]|\bdot\b) ?[\w-]+)+", re.I),
    "ip": re.compile(r"(?<!\d)\d{1,3}(?: ?\. ?\d{1,3}){3}(?!\d)"),
    "card": re.compile(r"(?<!\d)\d(?:[ ./_-]?\d){11,18}(?!\d)"),
    "phone": re.compile(r"(?<!\d)[+(]{0,2}\d(?:[ ()./-]{0,2}\d){6,14}(?!\d)"),
}
#: Characters around a labelled run in which its shape may begin and end.
MARGIN = 3


def plausible(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """Where, in a labelled run, the shape of its kind stands; None if there is none."""
    m = _SHAPES[kind].search(text, max(0, start - MARGIN), min(len(text), end + MARGIN))
    if m is None or m.start() >= end or m.end() <= start:
        return None
    digits = re.sub("[^0-9]", "", m.group())
    whole = (m.start() == 0 or not text[m.start() - 1].isalnum()) and (m.end() == len(text) or not text[m.end()].isalnum())
    fine = {"email": True, "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m.group())), "card": luhn(digits or "1"), "phone": len(re.findall("[0-9]+", m.group())) >= 2}[kind]
    lone = m.group().startswith("(") and ")" not in m.group()
    return (m.start() + lone, m.end()) if whole and fine else None


def added_spans(texts: list[str], p: dict) -> list[list[tuple[str, int, int]]]:
    """The network's plausible spans of each text."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    labels: dict[int, np.ndarray] = {}
    depth: dict[int, np.ndarray] = {}
    for i in range(0, len(jobs), BATCH):
        part = jobs[i : i + BATCH]
        x, mask = np.zeros((WINDOW, len(part)), np.int64), np.zeros((WINDOW, len(part)), np.float32)
        for j, (t, s) in enumerate(part):
            c = char_classes(texts[t][s : s + WINDOW])
            x[: len(c), j], mask[: len(c), j] = c, 1
        best = viterbi(p, x, mask)
        for j, (t, s) in enumerate(part):
            n = int(mask[:, j].sum())
            if t not in labels:
                labels[t], depth[t] = np.zeros(len(texts[t]), np.int8), np.full(len(texts[t]), -1, np.int16)
            inside = np.minimum(np.arange(n) if s else np.full(n, WINDOW), np.arange(n)[::-1] if s + n < len(texts[t]) else np.full(n, WINDOW)).astype(np.int16)
            take = inside > depth[t][s : s + n]
            labels[t][s : s + n][take] = best[:n, j][take]
            depth[t][s : s + n][take] = inside[take]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for t, y in labels.items():
        at = np.flatnonzero(y)
        runs = np.split(at, np.flatnonzero((np.diff(at) > 1) | (y[at[1:]] % 2 == 1) | ((y[at[1:]] + 1) // 2 != (y[at[:-1]] + 1) // 2)) + 1) if len(at) else []
        for r in runs:
            kind, a, b = KINDS[(y[r[0]] - 1) // 2], int(r[0]), int(r[-1]) + 1
            if (found := plausible(kind, texts[t], a, b)) and (not out[t] or found[0] >= out[t][-1][2]):
                out[t].append((kind, *found))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def find(texts: list[str | None], p: dict) -> list[list[dict]]:
    """All spans of each text, by start, then kind.

    Where spans were found the patterns look once more at what is left between them: a number that ran into another one
    stands free then. That goes on until nothing new is found.
    """
    texts = [t or "" for t in texts]
    out = []
    for text, text_base, more in zip(texts, map(base_spans, texts), added_spans(texts, p)):
        new = [s for s in more if all(s[2] <= a or s[1] >= b for _, a, b in text_base)]
        fresh, left = text_base + new, list(text)
        while fresh:
            for _, a, b in fresh:
                left[a:b] = "\n" * (b - a)
            fresh = base_spans("".join(left))
            new += fresh
        rows = [(*s, True) for s in text_base] + [(*s, False) for s in new]
        out.append([{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in sorted(rows, key=lambda s: (s[1], KINDS.index(s[0])))])
    return out


def detect(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """docs with all spans of the text: array of (kind, start, end, base)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(trained())  # some 50 kB

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        alone("pii")
        return pa.array(find(texts.to_pylist(), shared.value), type=kind)

    return without(docs, out).withColumn(out, spans(F.col(text)))


def _masked(text: str | None, rows: list[dict] | None) -> str | None:
    if not rows:
        return text
    parts, end = [], 0
    for s in rows:
        if s["start"] >= end:
            parts += (text[end : s["start"]], f"<{s['kind'].upper()}>")
        end = max(end, s["end"])
    return "".join(parts) + text[end:]


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced as one, named by the first."""

    @F.arrow_udf(T.StringType())
    def mask(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array(map(_masked, texts.to_pylist(), found.to_pylist()), type=pa.string())

    return mask(text, spans)


def replaced(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text as `masked` gives it for the spans of `detect`; found and replaced in one Python worker, where the two need one each."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(trained())  # some 50 kB

    @F.arrow_udf(T.StringType())
    def replace(texts: pa.Array) -> pa.Array:
        alone("pii")
        held = texts.to_pylist()
        return pa.array(map(_masked, held, find(held, shared.value)), type=pa.string())

    return docs.withColumn(text, replace(F.col(text)))
