"""Operator 5: personal data, by fixed patterns and by a tagger of characters.

The patterns give the base spans, which always stay. The tagger is a bidirectional LSTM over characters
with CRF transitions, trained here in numpy on made-up labelled spans (`examples`); it finds what the
patterns leave out, such as phone numbers without a plus sign or card numbers behind other digits.
Texts are read in overlapping windows. Every kind holds a digit or an at sign, so only windows with one that
is in no base span can add a span; all others of the text would be decoded as empty and are not run. Spans of
all windows of a text are reconciled together: those that meet a base span or don't have their kind's form go,
and of the rest the set without overlaps that has the greatest confidence is kept.

Defined cases: a null text is empty and has no spans; texts of any length are read whole; repeated rows and null
keys get a row each; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then first and inner of each kind
WINDOW, STRIDE = 96, 48
CONFIDENT = 0.9
EMBED, HIDDEN, EXAMPLES, EPOCHS, BATCH, RATE, SEED = 12, 16, 2400, 10, 48, 6e-3, 7

# ---- base patterns

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: had it matched there, it would have from the run's start.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:  # from the sign outwards, so long runs without one cost nothing
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = done = max(at + 1, done)
    if not re.search("[0-9]", text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


# ---- labelled spans

SYLLABLES = "an er the re in on th ou ea en st ti ha ed ion che ung der ch ein au eau oi el la os ci do ar mi".split()


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Made-up texts of a window's length with their spans."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))

    def email() -> str:
        at = rng.choice(["@", "@", " @ ", "@ ", " @"])
        return f"{word()}{rng.choice(['', '.', '_', '-'])}{rng.choice([word(), digits(2)])}{at}{word()}{rng.choice(['', digits(1)])}.{rng.choice(['com', 'org', 'net', 'example.com', 'de', 'co.uk'])}"

    def address() -> str:
        return rng.choice([".", ".", "[.]", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        body = digits(rng.choice([12, 14, 15, 15, 15, 18]))
        last = next(c for c in "0123456789" if luhn(body + c))
        s, sep = body + last, rng.choice(["", "", " ", "-", ".", "/", "  "])
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0049 {digits(2)} {digits(6)}", f"0{digits(2)}/{digits(7)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"1-{a}-{b}-{c}"])

    def other() -> str:
        return rng.choice([
            str(rng.randint(1, 2100)), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", f"${rng.randint(1, 999)}.{digits(2)}",
            f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(10, 23)}:{digits(2)}:{digits(2)}", f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"',
            f"@{word()}", f"version {rng.randint(1, 9)}", f"{rng.randint(1, 99)},{digits(3)},{digits(3)}", f"{digits(2)}%", f"id={digits(rng.randint(6, 12))}", f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"#{digits(5)}",
            f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.20{digits(2)}", " ".join(digits(rng.randint(1, 4)) for _ in range(3)), digits(rng.randint(5, 24)),
        ])

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            pick = rng.random()
            if pick < 0.12:
                kind = rng.randrange(len(KINDS))
                s = (email, address, card, phone)[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            elif pick < 0.2:
                text += other()
            else:
                w = word()
                text += rng.choice([w, w, w, w.capitalize(), w.upper()])
            text += rng.choice([" ", " ", " ", " ", ", ", ". ", ".\n", "!! ", " | ", "&&& "])
        skip = rng.randint(0, max(0, len(text) - WINDOW))
        cut = [(k, max(0, a - skip), min(WINDOW, b - skip)) for k, a, b in spans if b > skip and a < skip + WINDOW]
        out.append((text[skip : skip + WINDOW], cut))
    return out


# ---- the tagger


def encode(text: str) -> np.ndarray:
    """0 is padding; printable ASCII has its own numbers; other characters go by class."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where((code >= 32) & (code < 127), code - 31, np.where(code < 32, 96, 97))


LETTERS = 98


def padded(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), WINDOW), np.int64)
    for i, t in enumerate(texts):
        x[i, : len(t)] = encode(t)
    return x


def tags_of(spans: list[Span]) -> np.ndarray:
    y = np.zeros(WINDOW, np.int64)
    for kind, a, b in spans:
        y[a:b] = 2 + 2 * kind
        y[a] = 1 + 2 * kind
    return y


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(pre: np.ndarray, wh: np.ndarray, back: bool, keep: bool = False):
    """pre: (rows, steps, 4 hidden) input sums. Returns the hidden states, and what the gradient needs."""
    rows, steps, width = pre.shape
    n = width // 4
    h, c = np.zeros((rows, n), pre.dtype), np.zeros((rows, n), pre.dtype)
    out, trace = np.empty((rows, steps, n), pre.dtype), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        z = pre[:, t] + h @ wh
        s = sigmoid(z[:, : 3 * n])
        g = np.tanh(z[:, 3 * n :])
        i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
        before, c_before = h, c
        c = f * c + i * g
        th = np.tanh(c)
        h = o * th
        out[:, t] = h
        if keep:
            trace.append((t, i, f, o, g, th, before, c_before))
    return out, trace


def lstm_back(grad: np.ndarray, trace: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input sums and of wh."""
    n = wh.shape[0]
    dpre, dwh = np.empty((*grad.shape[:2], 4 * n), grad.dtype), np.zeros_like(wh)
    dh, dc = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
    for t, i, f, o, g, th, before, c_before in reversed(trace):
        dh = dh + grad[:, t]
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dpre[:, t] = dz
        dwh += before.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dpre, dwh


def marginals(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each tag at each step, and the expected number of each transition, by forward and backward sums."""
    rows, steps, tags = e.shape
    ex, tr = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(a)
    f, b = np.empty_like(ex), np.empty_like(ex)
    f[:, 0] = ex[:, 0] / ex[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        x = (f[:, t - 1] @ tr) * ex[:, t]
        f[:, t] = x / x.sum(1, keepdims=True)
    b[:, -1] = 1
    pairs = np.zeros_like(a)
    for t in range(steps - 2, -1, -1):
        v = ex[:, t + 1] * b[:, t + 1]
        x = v @ tr.T
        b[:, t] = x / x.sum(1, keepdims=True)
        scale = (f[:, t] * x).sum(1, keepdims=True)
        pairs += ((f[:, t] / scale).T @ v) * tr
    p = f * b
    return p / p.sum(2, keepdims=True), pairs


def viterbi(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    rows, steps, _ = e.shape
    score, back = e[:, 0], np.empty(e.shape, np.int8)
    for t in range(1, steps):
        x = score[:, :, None] + a
        back[:, t] = x.argmax(1)
        score = x.max(1) + e[:, t]
    path = np.empty((rows, steps), np.int64)
    path[:, -1] = score.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[np.arange(rows), t, path[:, t]]
    return path


def emissions(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    one, _ = lstm((w["embed"] @ w["xf"] + w["bf"])[x], w["hf"], False)
    two, _ = lstm((w["embed"] @ w["xb"] + w["bb"])[x], w["hb"], True)
    return np.concatenate([one, two], axis=2) @ w["out"] + w["bias"]


def train(n: int = EXAMPLES, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = examples(n, seed)
    xs, ys = padded([t for t, _ in data]), np.stack([tags_of(s) for _, s in data])
    cut = rng.random(n) < 0.1  # some windows end early, as a text does
    for i in np.flatnonzero(cut):
        k = rng.integers(8, WINDOW)
        xs[i, k:], ys[i, k:] = 0, 0
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"embed": rng.normal(0, 0.5, (LETTERS, EMBED)).astype(np.float32), "xf": init(EMBED, 4 * HIDDEN), "xb": init(EMBED, 4 * HIDDEN), "hf": init(HIDDEN, 4 * HIDDEN), "hb": init(HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32), "bb": np.zeros(4 * HIDDEN, np.float32), "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    w["bf"][HIDDEN : 2 * HIDDEN] = w["bb"][HIDDEN : 2 * HIDDEN] = 1
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            x, y = xs[order[at : at + BATCH]], ys[order[at : at + BATCH]]
            emb = w["embed"][x]
            one, trace_f = lstm(emb @ w["xf"] + w["bf"], w["hf"], False, True)
            two, trace_b = lstm(emb @ w["xb"] + w["bb"], w["hb"], True, True)
            both = np.concatenate([one, two], axis=2)
            p, pairs = marginals(both @ w["out"] + w["bias"], w["trans"])
            de = p.copy()
            np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
            dtrans = pairs.copy()
            np.add.at(dtrans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
            flat = de.reshape(-1, TAGS)
            g = {"out": both.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(0), "trans": dtrans}
            dboth = de @ w["out"].T
            df, g["hf"] = lstm_back(dboth[:, :, :HIDDEN], trace_f, w["hf"])
            db, g["hb"] = lstm_back(dboth[:, :, HIDDEN:], trace_b, w["hb"])
            flat_emb, ff, fb = emb.reshape(-1, EMBED), df.reshape(-1, 4 * HIDDEN), db.reshape(-1, 4 * HIDDEN)
            g |= {"xf": flat_emb.T @ ff, "xb": flat_emb.T @ fb, "bf": ff.sum(0), "bb": fb.sum(0)}
            demb = np.zeros_like(w["embed"])
            np.add.at(demb, x.ravel(), ff @ w["xf"].T + fb @ w["xb"].T)
            g["embed"] = demb
            norm = np.sqrt(sum(float((a**2).sum()) for a in g.values())) / len(x)
            step += 1
            rate = RATE * min(1, 2 * (1 - epoch / EPOCHS))
            for k, a in g.items():
                a = a / len(x) / max(1, norm / 5)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


@lru_cache(1)
def model() -> dict[str, np.ndarray]:
    """Trained once in a driver's life; the same every time."""
    return train()


def decode(w: dict[str, np.ndarray], windows: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, confidence) of each window; confidence is the mean chance of the span's tags."""
    out: list[list[tuple[int, int, int, float]]] = []
    for at in range(0, len(windows), 256):
        part = windows[at : at + 256]
        e = emissions(w, padded(part))
        path, chance = viterbi(e, w["trans"]), None
        for i, text in enumerate(part):
            found = []
            y = path[i, : len(text)]
            if y.any():
                if chance is None:
                    chance = marginals(e, w["trans"])[0]
                start = 0
                while start < len(y):
                    if y[start] == 0:
                        start += 1
                        continue
                    kind, end = (y[start] - 1) // 2, start + 1
                    while end < len(y) and y[end] == 2 + 2 * kind:
                        end += 1
                    found.append((int(kind), start, end, float(chance[i, np.arange(start, end), y[start:end]].mean())))
                    start = end
            out.append(found)
    return out


# ---- reconciling


def formed(kind: int, s: str) -> bool:
    d = only_digits(s)
    if kind == 0:
        return re.fullmatch(r"[^\s@]{1,64} ?@ ?[^\s@]+\.[^\s@.]{2,}", s) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and not re.search("[^0-9 ./-]", s)
    return 9 <= len(d) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[ ()./-][0-9 ()./-]*[0-9]", s) is not None


def windows_of(text: str, base: list[Span]) -> list[int]:
    """Starts of the windows that hold a digit or at sign outside the base spans."""
    taken = sorted((a, b) for _, a, b in base)
    starts, out = [a for a, _ in taken], set()
    for m in SIGN.finditer(text):
        p = m.start()
        i = bisect_right(starts, p) - 1
        if i >= 0 and any(a <= p < b for a, b in taken[max(0, i - len(KINDS)) : i + 1]):
            continue
        k = p // STRIDE
        out.add(k * STRIDE)
        if k:
            out.add((k - 1) * STRIDE)
    return sorted(out)


def reconcile(text: str, base: list[Span], found: list[tuple[int, int, int, float, bool]]) -> list[Span]:
    """found: (kind, start, end, confidence, cut by its window). The best set of spans that meet neither each other nor base."""
    best: dict[Span, float] = {}
    for kind, a, b, confidence, cut in found:
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if confidence >= CONFIDENT and formed(kind, text[a:b]):
            best[kind, a, b] = max(best.get((kind, a, b), 0), confidence * (0.5 if cut else 1))
    taken = sorted((a, b) for _, a, b in base)
    free = sorted((s for s in best if not any(a < s[2] and s[1] < b for a, b in taken)), key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in free]
    score, choice = [0.0], [()]
    for i, s in enumerate(free):
        j = bisect_right(ends, s[1], 0, i)
        with_it = score[j] + best[s] * (s[2] - s[1])
        score.append(max(score[i], with_it))
        choice.append((j, s) if with_it > score[i] else ())
    out, i = [], len(free)
    while i:
        if choice[i]:
            out.append(choice[i][1])
            i = choice[i][0]
        else:
            i -= 1
    return out[::-1]


def find(texts: list[str], w: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    base = [sorted(base_spans(t)) for t in texts]
    jobs = [(i, a) for i, t in enumerate(texts) for a in windows_of(t, base[i])]
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(jobs), 4096):
        part = jobs[at : at + 4096]
        for (i, a), spans in zip(part, decode(w, [texts[i][a : a + WINDOW] for i, a in part])):
            whole = len(texts[i])
            found[i] += [(k, a + x, a + y, c, (x == 0 and a > 0) or (y == WINDOW and a + y < whole)) for k, x, y, c in spans]
    return [(b, reconcile(t, b, f) if f else []) for t, b, f in zip(texts, base, found)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans and all spans as text, of every row."""
    w = model()

    def rows(batches):
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                got = find([t or "" for t in part.text], w)
                data = {"doc_id": part.doc_id.array}
                data |= {f"n_{kind}": [sum(s[0] == k for s in base) for base, _ in got] for k, kind in enumerate(KINDS)}
                data["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got]
                data["spans"] = [written(base + more) for base, more in got]
                yield pd.DataFrame(data)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInPandas(rows, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans in `text` masked; null texts stay null, and n_chars, where there is one, follows the text."""
    w = model()

    def rows(batches):
        for b in batches:
            names = b.schema.names
            old = b.column(names.index("text")).to_pylist()
            new = [t if t is None else masked(t, base + more) for t, (base, more) in zip(old, find([t or "" for t in old], w))]
            changed = {"text": new}
            if "n_chars" in names:
                known = b.column(names.index("n_chars")).to_pylist()
                changed["n_chars"] = [n if n is None or t is None else len(t) for n, t in zip(known, new)]
            yield pa.RecordBatch.from_arrays([pa.array(changed[n], f.type) if n in changed else c for n, f, c in zip(names, b.schema, b.columns)], schema=b.schema)

    return small_batches(docs).mapInArrow(rows, docs.schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
