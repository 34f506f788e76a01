"""Personal data: pattern spans, and a character-level bidirectional LSTM with CRF.

The network is trained in numpy from labelled spans (here: a seeded generator of
sentences around e-mail addresses, IP addresses, card and phone numbers in many
notations, with look-alikes that carry no label). Windows of WINDOW characters stand
STRIDE apart over every character of the text; emissions of overlapping windows are
averaged, and the best tag path over the whole text decides globally. What the best run
of tags other than O through a character could gain over O alone is bounded from above;
where that is below zero, every best path has O. Such characters part the path into
stretches that do not depend on each other, so only stretches are stepped through, with
the same result (a test compares with the plain best path of every window).
Decoded spans that pass their kind's check and touch no pattern span are added to
the pattern spans.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import text_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# --- pattern spans -----------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain found from the at signs, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind, by start and then kind."""
    spans = [(a, b, "email") for a, b in _emails(text)]
    spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if valid("ip", m[0])]
    spans += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if valid("card", m[0])]
    spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return _ordered(spans)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def valid(kind: str, text: str) -> bool:
    """Whether the characters can be of the kind at all."""
    digits = _digits(text)
    if kind == "email":
        return "@" in text.strip("@") and " " not in text
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not re.search(r"[0-9]{11}", text)


# --- the network -------------------------------------------------------------

WINDOW, STRIDE = 256, 224
#: Windows of training.
TRAIN_WINDOW, TRAIN_STRIDE = 64, 32
_ALPHABET = {c: i + 1 for i, c in enumerate("0123456789@.+-()_ %\n:=\"',;/#&$*|")}
_LETTER, _UPPER, _OTHER, _HEX = (len(_ALPHABET) + i for i in range(1, 5))
N_CHARS = len(_ALPHABET) + 5
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def char_codes(text: str) -> np.ndarray:
    """One small integer per character; 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(code, 0x300)]


_CODE = np.full(0x301, _LETTER, np.uint8)
for _c in range(0x301):
    if chr(_c) in _ALPHABET:
        _CODE[_c] = _ALPHABET[chr(_c)]
    elif chr(_c) in "abcdefABCDEF":
        _CODE[_c] = _HEX
    elif chr(_c).isupper():
        _CODE[_c] = _UPPER
    elif not chr(_c).isalpha():
        _CODE[_c] = _OTHER


class Model(NamedTuple):
    """Weights: embedding, per direction (input, hidden, bias) of the LSTM, output, and CRF transitions."""

    embed: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray
    trans: np.ndarray


def _fresh(rng: np.random.Generator, embed: int, hidden: int) -> Model:
    f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
    b = np.zeros((2, 4 * hidden), np.float32)
    b[:, hidden : 2 * hidden] = 1  # forget gates start open
    return Model(
        f(N_CHARS, embed), f(2, embed, 4 * hidden), f(2, hidden, 4 * hidden), b, f(2 * hidden, len(TAGS)),
        np.zeros(len(TAGS), np.float32), np.zeros((len(TAGS), len(TAGS)), np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states, time first; with `keep`, what the backward pass needs is put there."""
    steps, n, _ = x.shape
    hidden = wh.shape[0]
    pre = x @ wx + b
    h = c = np.zeros((n, hidden), np.float32)
    states = np.empty((steps, n, hidden), np.float32)
    for t in range(steps):
        z = pre[t] + h @ wh
        s = _sigmoid(z[:, : 3 * hidden])
        g = np.tanh(z[:, 3 * hidden :])
        before, c = c, s[:, hidden : 2 * hidden] * c + s[:, :hidden] * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, s, g, tc))
        h = s[:, 2 * hidden :] * tc
        states[t] = h
    return states


def _lstm_back(x, wx, wh, keep, grad):
    steps, n, _ = x.shape
    hidden = wh.shape[0]
    dz = np.empty((steps, n, 4 * hidden), np.float32)
    dh = np.zeros((n, hidden), np.float32)
    dc = np.zeros((n, hidden), np.float32)
    dwh = np.zeros_like(wh)
    for t in reversed(range(steps)):
        h, before, s, g, tc = keep[t]
        i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        d = dz[t]
        d[:, :hidden] = dc * g * i * (1 - i)
        d[:, hidden : 2 * hidden] = dc * before * f * (1 - f)
        d[:, 2 * hidden : 3 * hidden] = dh * tc * o * (1 - o)
        d[:, 3 * hidden :] = dc * i * (1 - g * g)
        dwh += h.T @ d
        dh = d @ wh.T
        dc = dc * f
    flat = dz.reshape(-1, 4 * hidden)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0), dz @ wx.T


def _scores(model: Model, codes: np.ndarray) -> np.ndarray:
    """Tag scores of a batch of windows: windows x characters -> characters x tags x windows, so that all inner loops run along the windows."""
    n, steps = codes.shape
    hidden, embed = model.wh.shape[1], model.embed.shape[1]
    codes, vectors = np.ascontiguousarray(codes.T), np.ascontiguousarray(model.embed.T)
    # sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 2 sigmoid(2 x) - 1, as numpy's exp takes a fraction of the time of its tanh. Signs and factors
    # are in the weights; cell states are kept times -2, hidden states halved, and so the weights of those are doubled.
    factor = np.where(np.arange(4 * hidden) < 3 * hidden, -1, -2).astype(np.float32)[:, None]
    out = np.concatenate((model.out.T * 2, model.out_b[:, None]), axis=1)
    score = np.empty((steps, len(TAGS), n), np.float32)
    states = np.empty((steps, hidden, n), np.float32)
    both = np.ones((2 * hidden + 1, n), np.float32)
    for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
        weights = factor * np.concatenate((model.wh[d].T * 2, model.wx[d].T, model.b[d][:, None]), axis=1)
        given = np.ones((hidden + embed + 1, n), np.float32)
        h, x = given[:hidden], given[hidden:-1]
        h[:] = 0
        c, tc, z = np.zeros((hidden, n), np.float32), np.empty((hidden, n), np.float32), np.empty((4 * hidden, n), np.float32)
        i, f, o, g = z[:hidden], z[hidden : 2 * hidden], z[2 * hidden : 3 * hidden], z[3 * hidden :]
        with np.errstate(over="ignore"):  # 1 / (1 + infinity) is the 0 it should be
            for t in order:
                np.take(vectors, codes[t], axis=1, out=x, mode="clip")
                np.exp(np.matmul(weights, given, out=z), out=z)
                z += 1
                np.reciprocal(z, out=z)
                g *= -4
                g += 2
                c *= f
                i *= g
                c += i
                np.exp(c, out=tc)
                tc += 1
                np.reciprocal(tc, out=tc)
                tc -= 0.5
                np.multiply(o, tc, out=h)
                if d == 0:
                    states[t] = h
                else:
                    both[:hidden], both[hidden:-1] = states[t], h
                    np.matmul(out, both, out=score[t])
    return score


def emissions(model: Model, codes: np.ndarray) -> np.ndarray:
    """Tag scores of a batch of windows: windows x characters -> windows x characters x tags."""
    return _scores(model, codes).transpose(2, 0, 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gradients(model: Model, codes: np.ndarray, tags: np.ndarray) -> tuple[float, Model]:
    """Mean negative log likelihood of the tag paths under the CRF, and its gradients."""
    n, steps = codes.shape
    x = model.embed[codes.T]
    keeps: tuple[list, list] = ([], [])
    ahead = _lstm(x, model.wx[0], model.wh[0], model.b[0], keeps[0])
    back = _lstm(x[::-1], model.wx[1], model.wh[1], model.b[1], keeps[1])[::-1]
    both = np.concatenate((ahead, back), axis=2)
    score = both @ model.out + model.out_b
    gold = tags.T
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0]
    for t in range(1, steps):
        alpha[t] = score[t] + _lse(alpha[t - 1][:, :, None] + model.trans, 1)
    for t in reversed(range(steps - 1)):
        beta[t] = _lse(model.trans + (score[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    rows = np.arange(n)
    path = sum(score[t, rows, gold[t]] for t in range(steps)) + sum(model.trans[gold[t - 1], gold[t]] for t in range(1, steps))
    d_score = np.exp(alpha + beta - z[:, None])
    d_trans = np.zeros_like(model.trans)
    for t in range(1, steps):
        d_trans += np.exp(alpha[t - 1][:, :, None] + model.trans + (score[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(d_trans, (gold[t - 1], gold[t]), 1)
    for t in range(steps):
        d_score[t, rows, gold[t]] -= 1
    d_score /= n
    d_both = d_score @ model.out.T
    hidden = model.wh.shape[1]
    a = _lstm_back(x, model.wx[0], model.wh[0], keeps[0], d_both[:, :, :hidden])
    b = _lstm_back(x[::-1], model.wx[1], model.wh[1], keeps[1], d_both[::-1, :, hidden:])
    d_embed = np.zeros_like(model.embed)
    np.add.at(d_embed, codes.T, a[3] + b[3][::-1])
    made = Model(
        d_embed, np.stack((a[0], b[0])), np.stack((a[1], b[1])), np.stack((a[2], b[2])),
        both.reshape(-1, both.shape[2]).T @ d_score.reshape(-1, len(TAGS)), d_score.sum((0, 1)), d_trans / n,
    )
    return float((z - path).mean()), made


def train(samples: list[tuple[str, list[Span]]], steps: int = 600, batch: int = 64, embed: int = 8, hidden: int = 8, rate: float = 0.02, seed: int = 3) -> Model:
    """Fit a model to labelled spans with Adam; the same samples and seed give the same model."""
    rng = np.random.Generator(np.random.PCG64(seed))
    codes, tags = [], []
    for text, spans in samples:
        tag = np.zeros(len(text), np.int64)
        for start, end, kind in spans:
            first = 1 + 2 * KINDS.index(kind)
            tag[start:end] = first + 1
            tag[start] = first
        code = char_codes(text)
        for at in range(0, max(1, len(text) - TRAIN_STRIDE), TRAIN_STRIDE):
            part = slice(at, at + TRAIN_WINDOW)
            fill = (0, TRAIN_WINDOW - len(code[part]))
            codes.append(np.pad(code[part], fill))
            tags.append(np.pad(tag[part], fill))
    codes, tags = np.array(codes), np.array(tags)
    model = _fresh(rng, embed, hidden)
    first = [np.zeros_like(w) for w in model]
    second = [np.zeros_like(w) for w in model]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(codes), batch)
        _, grads = _gradients(model, codes[pick], tags[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1, step / 20) * (1 - step / (steps + 1))
        updated = []
        for w, g, m, v in zip(model, grads, first, second):
            g = g * min(1, 5 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            updated.append((w - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
        model = Model(*updated)
    return model


def labelled_samples(count: int = 3000, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Sentences of invented words around spans in many notations and around unlabelled look-alikes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    parts = ("an", "ter", "lo", "mi", "sch", "qué", "ou", "ren", "é", "th", "ing", "do", "ba", "el", "ück", "no", "sa")
    word = lambda: "".join(pick(parts) for _ in range(int(rng.integers(1, 4))))

    def filler() -> str:
        w = word()
        w = w.upper() if rng.random() < 0.1 else w.title() if rng.random() < 0.15 else w
        return w + pick(("", "", "", "", ",", ".", "!!", "$$$", "***", ":", ";"))

    def email() -> str:
        local = pick(("", word() + ".")) + word() + pick(("", digits(2), "." + digits(2), "_" + word(), "+" + word()))
        return "".join(c for c in local if c.isascii()) + "x@" + pick(("mail", "post", "web")) + digits(1) + "." + pick(("example.com", "example.org", "test.net", "co.example"))

    def card() -> str:
        body = digits(int(pick((13, 15, 15, 15, 17, 18))))
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return pick((body, body, " ".join(body[i : i + 4] for i in range(0, len(body), 4)), "-".join(body[i : i + 4] for i in range(0, len(body), 4)), ".".join(body[i : i + 4] for i in range(0, len(body), 4))))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b} {c}"))

    def ip() -> str:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))

    def decoy() -> str:
        return pick((
            f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', f"version {digits(1)}.{digits(1)}", str(rng.integers(1900, 2100)), digits(int(rng.integers(1, 8))),
            f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"@{word()}", f"{digits(3)},{digits(3)},{digits(3)}",
            f"id {''.join(pick('0123456789ABCDEF') for _ in range(12))}",
        ))

    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    samples = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(rng.integers(8, 18))):
            roll = rng.random()
            if roll < 0.16:
                kind = pick(KINDS)
                value = made[kind]()
                spans.append((len(text), len(text) + len(value), kind))
                text += value + pick(("", "", ",", ".", "!!"))
            elif roll < 0.3:
                text += decoy()
            else:
                text += filler()
            text += pick((" ", " ", " ", " ", "\n"))
        samples.append((text, spans))
    return samples


_fitted: list[Model] = []


def default_model(spark: SparkSession) -> Model:
    """The model of the default samples; fitted once in a process, in one Spark task, where numpy keeps to one core."""
    if not _fitted:

        def fit(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(train(labelled_samples())))], pa.binary())], ["weights"])

        row = spark.range(1, numPartitions=1).mapInArrow(fit, "weights binary").collect()[0]
        _fitted.append(Model(*pickle.loads(row["weights"])))
    return _fitted[0]


# --- decoding ----------------------------------------------------------------

def grid(length: int) -> range:
    """Starts of the windows over a text; the last one reaches its end."""
    return range(0, max(1, length - (WINDOW - STRIDE)), STRIDE)


class _Bounds(NamedTuple):
    """Upper bounds of what transitions are worth in a run of tags other than O, above those of O.

    `enter` and `stay` are by tag, for the run's first and its further characters;
    `leave` is for its end. What a first tag gains by the step to its second one is
    moved to its entry, so that `stay` does not count it over and over. `edge` covers the
    transitions that a run lacks at the ends of the text.
    """

    enter: np.ndarray
    stay: np.ndarray
    leave: float
    edge: float


def _bounds(trans: np.ndarray) -> _Bounds:
    moved = np.zeros(len(TAGS))
    first = np.arange(1, len(TAGS), 2)
    moved[first] = np.maximum(0, trans[first, first + 1] - trans[first + 1, first + 1])
    even = trans - moved[:, None] + moved - trans[0, 0]
    return _Bounds(even[0, 1:], even[1:, 1:].max(0), float(even[1:, 0].max()), float(2 * np.abs(even).max() + moved.max()))


def _gains(model: Model, texts: list[np.ndarray], batch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By text, the most that each character can gain as a run's first and as a further character, from every window over it."""
    windows = [(i, at) for i, t in enumerate(texts) if len(t) for at in grid(len(t))]
    bounds = _bounds(model.trans.astype(float))
    enter, stay = (x.astype(np.float32)[:, None] for x in (bounds.enter, bounds.stay))
    lap = WINDOW - STRIDE
    gains = [np.empty((2, len(t)), np.float32) for t in texts]
    before = np.zeros((lap, len(TAGS)), np.float32)  # what the window before says of the characters that it shares
    made = np.empty((2, WINDOW, batch), np.float32)
    for first in range(0, len(windows), batch):
        group = windows[first : first + batch]
        score = _scores(model, _block(texts, group))
        ends = score[STRIDE:].copy()
        told = np.concatenate((before[:, :, None], ends[:, :, :-1]), axis=2)
        goes_on = np.array([at > 0 for _, at in group])
        score[:lap] = np.where(goes_on, (score[:lap] + told) / 2, score[:lap])
        before = ends[:, :, -1]
        for t in range(WINDOW):
            np.subtract((score[t, 1:] + enter).max(0), score[t, 0], out=made[0, t, : len(group)])
            np.subtract((score[t, 1:] + stay).max(0), score[t, 0], out=made[1, t, : len(group)])
        for k, (i, at) in enumerate(group):
            size = min(WINDOW, len(texts[i]) - at)
            gains[i][:, at : at + size] = made[:, :size, k]
    yield from gains


def _block(texts: list[np.ndarray], group: list[tuple[int, int]]) -> np.ndarray:
    """The characters of windows, given by text and start; windows beyond a text's end are padded."""
    block = np.zeros((len(group), WINDOW), np.int64)
    for k, (i, at) in enumerate(group):
        part = texts[i][at : at + WINDOW]
        block[k, : len(part)] = part
    return block


def stretches(model: Model, texts: list[np.ndarray], batch: int = 1024) -> list[list[tuple[int, int]]]:
    """By text, [start, end) of the stretches outside which every best path has O."""
    out = []
    bounds = _bounds(model.trans.astype(float))
    for enter, stay in _gains(model, texts, batch):
        if not len(enter):
            out.append([])
            continue
        enter, stay = enter.astype(float), stay.astype(float)
        for end in (0, -1):
            enter[end] += bounds.edge
            stay[end] += bounds.edge
        line = np.cumsum(stay)
        upto = line + np.maximum.accumulate(enter - line)  # the best run that ends here
        after = np.maximum.accumulate(line[::-1])[::-1] - line  # the most that going on adds
        unsure = np.concatenate(([False], upto + np.maximum(after, 0) + bounds.leave > -1e-3, [False]))
        edges = np.flatnonzero(np.diff(unsure)).tolist()
        out.append(list(zip(edges[::2], edges[1::2])))
    return out


#: Longer stretches are cut into chunks of CHUNK characters that step together.
CHUNK = 1024


def _paths(scores: list[np.ndarray], trans: np.ndarray, first: list[np.ndarray], last: list[np.ndarray]) -> list[np.ndarray]:
    """The best tag path of each piece, all stepping together; `first` and `last` are added to the scores of its end tags."""
    sizes = np.array([len(x) for x in scores])
    steps, rows = int(sizes.max()), np.arange(len(scores))
    table = np.zeros((steps, len(scores), trans.shape[0]))
    for k, x in enumerate(scores):
        table[: len(x), k] = x
    best = table[0] + np.array(first)
    back = np.empty(table.shape, np.int8)
    for t in range(1, steps):
        step = best[:, :, None] + trans
        back[t] = step.argmax(1)
        best = np.where((t < sizes)[:, None], step.max(1) + table[t], best)
    path = np.empty((steps, len(scores)), np.int64)
    now = (best + np.array(last)).argmax(1)
    for t in range(steps - 1, -1, -1):
        path[t] = now
        if t:
            now = np.where(t < sizes, back[t][rows, now], now)
    return [path[:n, k] for k, n in enumerate(sizes)]


def _long_path(score: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best path of one long stretch: best scores of every chunk for every tag before and at its end, the best tags at the cuts, then all chunks between them."""
    parts = [score[at : at + CHUNK].astype(float) for at in range(0, len(score), CHUNK)]
    whole = np.array(parts[:-1])
    best = trans[None] + whole[:, 0][:, None, :]
    best[0] = first + whole[0, 0]
    for t in range(1, CHUNK):
        best = (best[:, :, :, None] + trans).max(2) + whole[:, t][:, None, :]
    upto, back = best[0][0], []
    for k in range(1, len(whole)):
        step = upto[:, None] + best[k]
        back.append(step.argmax(0))
        upto = step.max(0)
    tail = trans + parts[-1][0]
    for x in parts[-1][1:]:
        tail = (tail[:, :, None] + trans).max(1) + x
    ends = [int((upto + (tail + last).max(1)).argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    fixed = [np.where(np.arange(len(trans)) == e, 0.0, -np.inf) for e in ends]
    return np.concatenate(_paths(parts, trans, [first, *[trans[e] for e in ends]], [*fixed, last]))


def viterbi(scores: list[np.ndarray], trans: np.ndarray, at_start: list[bool], at_end: list[bool], batch: int = 256) -> list[np.ndarray]:
    """The best tag path of each stretch; the tag before and after it is O, but for the ends of the text."""
    trans = trans.astype(float)
    none = np.zeros(len(trans))
    first, last = [none if x else trans[0] for x in at_start], [none if x else trans[:, 0] for x in at_end]
    paths: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    at = 0
    while at < len(order):
        size = len(scores[order[at]])
        if size > 4 * CHUNK:
            paths[order[at]] = _long_path(scores[order[at]], trans, first[order[at]], last[order[at]])
            at += 1
            continue
        # Stretches of similar length step together.
        group = [i for i in order[at : at + batch] if len(scores[i]) <= min(2 * size, 4 * CHUNK)]
        for i, path in zip(group, _paths([scores[i] for i in group], trans, [first[i] for i in group], [last[i] for i in group])):
            paths[i] = path
        at += len(group)
    return paths


def model_spans(model: Model, texts: list[str], batch: int = 1024) -> list[list[Span]]:
    """Decoded spans of each text, before any check."""
    found: list[list[Span]] = [[] for _ in texts]
    codes = [char_codes(t) for t in texts]
    where = [(i, a, b) for i, own in enumerate(stretches(model, codes, batch)) for a, b in own]
    # Every window that reaches into a stretch, once more: its scores, not only their bounds.
    windows = [(n, at) for n, (i, a, b) in enumerate(where) for at in grid(len(texts[i]))[max(0, -(-(a + 1 - WINDOW) // STRIDE)) : -(-b // STRIDE)]]
    sums = [np.zeros((b - a, len(TAGS)), np.float32) for _, a, b in where]
    seen = [np.zeros((b - a, 1), np.float32) for _, a, b in where]
    for first in range(0, len(windows), batch):
        group = windows[first : first + batch]
        score = _scores(model, _block(codes, [(where[n][0], at) for n, at in group]))
        for k, (n, at) in enumerate(group):
            _, a, b = where[n]
            low, high = max(a, at), min(b, at + WINDOW)
            sums[n][low - a : high - a] += score[low - at : high - at, :, k]
            seen[n][low - a : high - a] += 1
    scores = [total / times for total, times in zip(sums, seen)]
    paths = viterbi(scores, model.trans, [a == 0 for _, a, _ in where], [b == len(texts[i]) for i, _, b in where])
    for (i, a, _), path in zip(where, paths):
        found[i] += path_spans(path, a)
    return found


def path_spans(path: np.ndarray, start: int = 0) -> list[Span]:
    """Spans of a tag path that begins at `start`."""
    kind = (path + 1) // 2
    edge = np.flatnonzero(np.diff(np.concatenate(([0], kind, [0]))) | np.concatenate((path % 2 == 1, [False])))
    return [(start + int(s), start + int(e), KINDS[kind[s] - 1]) for s, e in zip(edge[:-1], edge[1:]) if kind[s]]


def _added(text: str, base: list[Span], decoded: list[Span]) -> list[Span]:
    """Decoded spans, trimmed, that stand alone, pass their check and touch no pattern span."""
    out = []
    for start, end, kind in decoded:
        while start < end and text[start] in " .,-\n:;!":
            start += 1
        while end > start and text[end - 1] in " .,-\n:;!":
            end -= 1
        outside = text[start - 1 : start] + text[end : end + 1]
        if start < end and not any(c.isalnum() or c in "@_+" for c in outside) and valid(kind, text[start:end]) and all(end <= a or b <= start for a, b, _ in base):
            out.append((start, end, kind))
    return out


def text_spans(model: Model, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text."""
    base = [pattern_spans(t) for t in texts]
    return [(b, _ordered(b + _added(t, b, d))) for t, b, d in zip(texts, base, model_spans(model, texts))]


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _spans_of(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, list[str | None], list[tuple[list[Span], list[Span]]]]]:
    """(first, last, texts, spans) for runs of rows of about a megabyte of text."""
    for first, last, _, _ in text_slices(texts, 1 << 20):
        own = texts.slice(first, last - first).to_pylist()
        yield first, last, own, text_spans(model, [t or "" for t in own])


def _find(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, own, spans in _spans_of(model, batch.column("text")):
                made = [spans_text(b) for b, _ in spans], [spans_text(e) for _, e in spans], [t and redacted(t, e) for t, (_, e) in zip(own, spans)]
                columns = [pa.array(x, pa.string()) for x in made]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], ["doc_id", "base_spans", "spans", "redacted"])

    return run


def _redact(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for first, last, own, spans in _spans_of(model, batch.column(at)):
                clean = [t and redacted(t, e) for t, (_, e) in zip(own, spans)]
                yield batch.slice(first, last - first).set_column(at, batch.schema.field(at), pa.array(clean, batch.column(at).type))

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, base_spans, spans (kind:start:end by start and kind, comma-joined; code points) and the redacted text.

    One row per row of `docs`, whole texts, no shuffle; equal rows give equal
    results. A null text has no spans and stays null. Only id and text are read.
    Empty table: no rows.
    """
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pairs.schema["doc_id"].dataType.simpleString()
    return pairs.mapInArrow(_find(model or default_model(docs.sparkSession)), f"doc_id {kind}, base_spans string, spans string, redacted string")


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """`docs` with the personal data in `text_col` replaced by [EMAIL], [IP], [CARD] or [PHONE]; all rows and columns stay, whatever their names.

    Null texts stay null, empty ones empty; texts of any length are read whole; equal
    texts change alike. Empty table: no rows.
    """
    return docs.mapInArrow(_redact(model or default_model(docs.sparkSession), text_col), docs.schema)
