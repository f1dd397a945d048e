"""Personal data by a character-level bidirectional LSTM with a CRF on top.

The model is trained here, in numpy, by back-propagation through time on
sentences that are made up with labelled spans. A text is cut into overlapping
windows of characters; each is run through both directions and decoded by
Viterbi's algorithm. Where windows overlap, each character takes the label of the
window that sees more around it, and runs of a label over the whole text are
the spans, so a span may cross any number of windows.

Gates and cells are squashed by x / (1 + |x|), which costs a fraction of a tanh.
Transitions are never above zero and that from nothing to nothing is zero.
So where nothing is the best label of every character of a window, it is the
best path as well, and no search is needed.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import textbytes as tb

KINDS = ("", "email", "phone", "card", "ip", "secret")
K = len(KINDS)
#: Units of each direction; characters of a window and of what it shares with the next.
UNITS, WINDOW, OVERLAP = 8, 1024, 96
#: Sentences of a step of the training, their characters, steps, and the seed of all that is random.
BATCH, LENGTH, STEPS, SEED = 128, 128, 440, 11
#: Bytes of text run at once.
CHUNK = 1 << 21

#: Symbols: ASCII characters, then any other letter, then any other character.
V = 130
_SYMBOL = np.full(256, 128, np.uint8)
_SYMBOL[:128] = np.arange(128)
_SYMBOL[[0xC2, *range(0xE2, 0xE3), *range(0xF0, 0x100)]] = 129


def symbols(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each character of UTF-8 bytes, and for each byte how many characters start before it."""
    lead = (data & 0xC0) != 0x80
    return _SYMBOL[data[lead]], np.concatenate([[0], np.cumsum(lead)])


# --- labelled sentences -------------------------------------------------------

_SYLLABLES = (
    "th he in er an re nd on en at ou ed ha to or it is hi es ng st ing ion tion ent the and ous ble ly sh wh ch ei sch ung ver ge zu ich der keit lich ü ö ß qu eau eux é è ê ç oi ment aire pa la ción ado ar os es ñ ó á í mente iel rr ja"
).split()
_JUNK = ("###", "%%%", "***", "$$$", "&&&", "!!!", "|", "=", "--", "...", "[x]", "//", "<b>", "{", "}", "@home", "#tag", "\n", "\t")
_HEX = "0123456789abcdef"
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567890123456789"


def _word(r: random.Random) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 5)))
    return w.capitalize() if r.random() < 0.12 else w.upper() if r.random() < 0.02 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _plain(r: random.Random) -> str:
    """A word or something that looks like personal data and isn't."""
    x = r.random()
    if x < 0.86:
        return _word(r) + r.choice(("", "", "", "", "", ",", ".", ".\n", "?", "###", "***", "%%%", "$$$", "&&&"))
    return r.choice(
        (
            lambda: r.choice(_JUNK),
            lambda: _digits(r, r.randint(1, 6)),
            lambda: f"{_digits(r, r.randint(1, 3))}.{_digits(r, r.randint(1, 4))}",
            lambda: f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 30)}",
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
            lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}",
            lambda: f"{r.randint(1, 999)},{_digits(r, 3)}",
            lambda: f"https://www.{_word(r)}.{r.choice(('com', 'org', 'net'))}/{_word(r)}/{_digits(r, 4)}",
            lambda: f"{_word(r)}_{_word(r)}({_word(r)}={r.randint(0, 99)})",
            lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}",
            lambda: f"${r.randint(1, 999)}.{_digits(r, 2)}",
            lambda: f"({r.randint(1, 99)})",
            lambda: f"{_word(r)}{r.randint(0, 99)}",
            lambda: f"{r.choice(('token', 'password', 'key', 'id'))} {_word(r)}",
        )
    )()


def _email(r: random.Random) -> str:
    name = r.choice(("{a}", "{a}.{d}", "{a}.{b}", "{a}_{b}", "{a}{d}", "{a}+{b}", "{a}-{b}")).format(a=_word(r).lower(), b=_word(r).lower(), d=_digits(r, 2))
    host = r.choice(("{a}", "mail{d}", "{a}{d}", "mail{d}.example", "{a}.{b}", "example"))
    ascii_ = lambda: "".join(c for c in _word(r).lower() if c.isascii()) or "box"
    return f"{''.join(c for c in name if c.isascii()) or 'me'}@{host.format(a=ascii_(), b=ascii_(), d=_digits(r, 1))}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'io', 'es'))}"


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+{r.randint(20, 99)} {_digits(r, 2)} {_digits(r, 4)} {c}", f"+1 {a} {b} {c}"))


def _card(r: random.Random) -> str:
    d = r.choice("456") + _digits(r, 15)
    return d if r.random() < 0.7 else r.choice((" ", "-")).join(d[i : i + 4] for i in (0, 4, 8, 12))


def _ip(r: random.Random) -> str:
    return ".".join(str(r.randint(0, r.choice((9, 99, 255, 255)))) for _ in range(4))


def _secret(r: random.Random) -> str:
    hexa = lambda n: "".join(r.choice(_HEX) for _ in range(n))
    return r.choice((lambda: "AKIA" + "".join(r.choice(_ALNUM) for _ in range(16)), lambda: hexa(40), lambda: hexa(r.choice((18, 18, 24, 32, 64))), lambda: "sk-" + hexa(32), lambda: "ghp_" + hexa(36)))()


_MAKE = {1: _email, 2: _phone, 3: _card, 4: _ip, 5: _secret}


def sentence(r: random.Random, length: int = LENGTH) -> tuple[str, list[int]]:
    """A made-up text of the given length and the label of each of its characters."""
    text, labels = "", []
    kinds = [r.randint(1, K - 1) if r.random() < 0.16 else 0 for _ in range(length)]
    if r.random() < 0.35:
        kinds = [0] * length
    for kind in kinds:
        if len(text) >= length:
            break
        if not kind:
            piece = _plain(r) + " "
            text, labels = text + piece, labels + [0] * len(piece)
            continue
        value = _MAKE[kind](r)
        before = after = ""
        if kind == 5 and r.random() < 0.6:
            before, after = r.choice((('token = "', '"'), ("password=", ""), ("key: ", ""), ("secret='", "'"), ("api_key=", "")))
        elif r.random() < 0.12:
            before, after = r.choice((("(", ")"), ("<", ">"), ('"', '"'), ("mailto:", ""), ("tel: ", "")))
        after += r.choice(("", "", "", "", ".", ",", "###", "***", "%%%", "$$$", "&&&", ".\n")) + r.choice((" ", " ", " ", "\n"))
        text += before + value + after
        labels += [0] * len(before) + [kind] * len(value) + [0] * len(after)
    cut = r.randint(0, max(0, len(text) - length)) if r.random() < 0.5 else 0
    return text[cut : cut + length].ljust(length), (labels[cut : cut + length] + [0] * length)[:length]


def _encoded(text: str) -> np.ndarray:
    return symbols(np.frombuffer(text.encode(), np.uint8))[0]


# --- training -----------------------------------------------------------------


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """Derivative of _squash, by its value."""
    return (1 - np.abs(y)) ** 2


def _run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (steps, units, batch) of a direction and what its gradient needs. x: symbols (steps, batch)."""
    units, many = wh.shape[1], x.shape[1]
    h = c = np.zeros((units, many), np.float32)
    out, tape = np.empty((len(x), units, many), np.float32), []
    for t, symbol in enumerate(x):
        z = wx[:, symbol] + wh @ h
        z = _squash(z)
        gate, g = 0.5 + 0.5 * z[: 3 * units], z[3 * units :]
        i, f, o = gate[:units], gate[units : 2 * units], gate[2 * units :]
        before, c_before = h, c
        c = f * c + i * g
        top = _squash(c)
        h = o * top
        out[t] = h
        tape.append((symbol, before, c_before, i, f, o, g, top))
    return out, tape


def _back(dout: np.ndarray, tape: list, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dwx, dwh = np.zeros_like(wx), np.zeros_like(wh)
    dh = dc = np.zeros(dout.shape[1:], np.float32)
    columns, grads = [], []
    for t in range(len(tape) - 1, -1, -1):
        symbol, before, c_before, i, f, o, g, top = tape[t]
        dh = dh + dout[t]
        dc = dc + dh * o * _slope(top)
        gates = np.concatenate([dc * g, dc * c_before, dh * top]) * 0.5 * _slope(2 * np.concatenate([i, f, o]) - 1)
        dz = np.concatenate([gates, dc * i * _slope(g)])
        dwh += dz @ before.T
        columns.append(symbol)
        grads.append(dz)
        dh, dc = wh.T @ dz, dc * f
    one = np.zeros((len(tape) * dout.shape[2], V), np.float32)
    one[np.arange(len(one)), np.concatenate(columns)] = 1
    dwx += np.concatenate(grads, axis=1) @ one
    return dwx, dwh


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf_gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood a batch, and its gradients by the emissions e (steps, labels, batch) and the transitions."""
    steps, labels, many = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    t3 = trans[:, :, None]
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, None] + t3, 0)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(t3 + (e[t + 1] + beta[t + 1])[None], 1)
    total = _logsum(alpha[-1], 0)
    de = np.exp(alpha + beta - total)
    pair = np.exp(alpha[:-1, :, None] + t3 + (e[1:] + beta[1:])[:, None] - total).sum(axis=(0, 3))
    t_, b_ = np.meshgrid(np.arange(steps), np.arange(many), indexing="ij")
    gold = e[t_, y, b_].sum() + trans[y[:-1], y[1:]].sum()
    de[t_, y, b_] -= 1
    np.subtract.at(pair, (y[:-1], y[1:]), 1)
    return float(total.sum() - gold), de, pair.astype(np.float32)


def fresh(units: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (4 * units, V)).astype(np.float32)
        p[f"x{d}"][units : 2 * units] += 1  # forget gates start open
        p[f"h{d}"] = rng.normal(0, 0.3, (4 * units, units)).astype(np.float32)
        p[f"o{d}"] = rng.normal(0, 0.3, (K, units)).astype(np.float32)
    p["bias"] = np.zeros((K, 1), np.float32)
    p["trans"] = np.full((K, K), -1, np.float32)
    np.fill_diagonal(p["trans"], 0)
    return p


def loss_and_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """x: symbols, y: labels, both (steps, batch)."""
    hf, tape_f = _run(x, p["xf"], p["hf"])
    hb, tape_b = _run(x[::-1], p["xb"], p["hb"])
    e = p["of"] @ hf + p["ob"] @ hb[::-1] + p["bias"]
    loss, de, dtrans = crf_gradient(e, y, p["trans"])
    g = {"bias": de.sum(axis=(0, 2))[:, None], "trans": dtrans}
    g["of"] = np.einsum("tkb,tub->ku", de, hf, optimize=True)
    g["ob"] = np.einsum("tkb,tub->ku", de, hb[::-1], optimize=True)
    g["xf"], g["hf"] = _back(p["of"].T @ de, tape_f, p["xf"], p["hf"])
    g["xb"], g["hb"] = _back((p["ob"].T @ de)[::-1], tape_b, p["xb"], p["hb"])
    return loss, g


@lru_cache(maxsize=4)
def trained(steps: int = STEPS, seed: int = SEED, units: int = UNITS) -> "Model":
    """The model after Adam's steps on made-up sentences; the same for the same arguments, and kept for the session."""
    r = random.Random(seed)
    p = fresh(units, seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = [sentence(r) for _ in range(BATCH)]
        x = np.stack([_encoded(t) for t, _ in rows], axis=1).astype(np.int64)
        y = np.array([labels for _, labels in rows]).T
        _, g = loss_and_gradient(p, x, y)
        size = np.sqrt(sum(float((a * a).sum()) for a in g.values())) / BATCH
        rate = 0.03 * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.8
        for k, a in g.items():
            a = a / BATCH / max(1, size / 5)
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a * a - v[k])
            p[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        np.minimum(p["trans"], 0, out=p["trans"])
        p["trans"][0, 0] = 0
    return Model(p)


# --- inference ----------------------------------------------------------------


class Model:
    """The trained weights."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.units = p["hf"].shape[1]
        self.wx, self.wh, self.out = ([np.ascontiguousarray(p[f"{x}{d}"]) for d in "fb"] for x in "xho")
        self.bias, self.trans = p["bias"], p["trans"]

    def emissions(self, s: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Emissions (steps, labels, windows) of windows of the symbols s, the longest first."""
        steps, many, u = int(length[0]), len(start), self.units
        live = (many - np.searchsorted(length[::-1], np.arange(steps), "right")).tolist()  # windows with a step t
        e = np.empty((steps, K, many), np.float32)
        e[:] = self.bias
        index, z, work = np.empty(many, np.intp), np.empty((4 * u, many), np.float32), np.empty((4 * u, many), np.float32)
        for d in (0, 1):
            hidden, cells = np.zeros((u, many), np.float32), np.zeros((u, many), np.float32)
            wx, wh, out = self.wx[d], self.wh[d], self.out[d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                n = live[t]
                at, a, b, c, h = index[:n], z[:, :n], work[:, :n], cells[:, :n], hidden[:, :n]
                if n < many:  # whole rows are faster
                    a, b = z.ravel()[: 4 * u * n].reshape(4 * u, n), work.ravel()[: 4 * u * n].reshape(4 * u, n)
                np.add(start[:n], t, out=at)
                wx.take(s[at], axis=1, out=a, mode="clip")
                a += np.matmul(wh, h, out=b)
                np.abs(a, out=b)
                b += 1
                a /= b
                gate = a[: 3 * u]
                gate *= 0.5
                gate += 0.5
                c *= a[u : 2 * u]
                np.multiply(a[:u], a[3 * u :], out=b[:u])
                c += b[:u]
                np.abs(c, out=b[:u])
                b[:u] += 1
                np.divide(c, b[:u], out=h)
                h *= a[2 * u : 3 * u]
                e[t, :, :n] += out @ h
        return e

    def decode(self, e: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best labels (windows, steps)."""
        steps, _, many = e.shape
        labels = np.zeros((many, steps), np.uint8)
        real = np.arange(steps)[:, None] < length
        some = np.flatnonzero(((e[:, 1:].max(axis=1) > e[:, 0]) & real).any(axis=0))
        if not len(some):
            return labels
        e, n = e[:, :, some], length[some]
        score, back = e[0], np.zeros((steps, K, len(some)), np.uint8)
        for t in range(1, steps):
            ways = score[:, None] + self.trans[:, :, None]
            back[t] = ways.argmax(axis=0)
            score = np.where(t < n, ways.max(axis=0) + e[t], score)
        label = score.argmax(axis=0)
        each = np.arange(len(some))
        found = np.zeros((len(some), steps), np.uint8)
        for t in range(steps - 1, -1, -1):
            found[:, t] = np.where(t < n, label, 0)
            if t:
                label = np.where(t < n, back[t, label, each], label)
        labels[some] = found
        return labels

    def labels(self, s: np.ndarray, bounds: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP) -> np.ndarray:
        """The label of every symbol of the texts s[bounds[r]:bounds[r + 1]]."""
        out = np.zeros(len(s), np.uint8)
        size = np.diff(bounds)
        step = window - overlap
        many = np.where(size > 0, 1 + np.maximum(0, -(-(size - window) // step)), 0)
        row = np.repeat(np.arange(len(size)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = bounds[row] + k * step
        end = np.minimum(start + window, bounds[row + 1])
        left = np.where(k > 0, overlap // 2, 0)
        right = np.where(k < many[row] - 1, overlap - overlap // 2, 0)
        order = np.argsort(start - end, kind="stable")
        for part in np.array_split(order, -(-int((end - start).sum()) // CHUNK)) if len(order) else []:
            length = (end - start)[part]
            found = self.decode(self.emissions(s, start[part], length), length)
            for j in np.flatnonzero(found.any(axis=1)).tolist():
                w = part[j]
                a, b = left[w], length[j] - right[w]
                out[start[w] + a : start[w] + b] = found[j, a:b]
        return out


def _plausible(kind: int, value: str) -> bool:
    """Whether a span can be of its kind at all."""
    digits = sum(c.isdigit() for c in value)
    if kind == 1:
        name, at, host = value.partition("@")
        return bool(name and at and "." in host)
    if kind == 2:
        return 7 <= digits <= 15
    if kind == 3:
        return 13 <= digits <= 19
    if kind == 4:
        parts = value.split(".")
        return len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts)
    return len(value) >= 12 and digits > 0 and not any(c.isspace() for c in value)


_LOOSE = " \t\r\n.,;:!?\"'#%*$&<>[]{}|="


def _whole(kind: int, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The span without loose signs at its ends, or the plausible ones of its words where several of a kind touch."""
    value = text[a:b]
    low = a + len(value) - len(value.lstrip(_LOOSE))
    value = value.strip(_LOOSE)
    if _plausible(kind, value):
        yield low, low + len(value)
    elif any(c.isspace() for c in value):
        for part in re.finditer(r"\S+", value):
            yield from _whole(kind, text, low + part.start(), low + part.end())


def spans_of(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, int, int]]:
    """(row, start, end, kind) of the spans, in characters, by row and start."""
    data, at = tb.buffers(texts)
    s, before = symbols(data)
    bounds = before[at]
    label = model.labels(s, bounds)
    hit = np.flatnonzero(label)
    if not len(hit):
        return
    row = np.searchsorted(bounds, hit, "right") - 1
    new = (np.diff(hit, prepend=-2) > 1) | (np.diff(label[hit].astype(int), prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    values: dict[int, str] = {}
    for r, a, b, kind in zip(row[first].tolist(), hit[first].tolist(), (hit[last] + 1).tolist(), label[hit[first]].tolist()):
        if r not in values:
            values = {r: texts[r].as_py()}
        a, b = a - int(bounds[r]), b - int(bounds[r])
        for x, y in _whole(kind, values[r], a, b):
            yield r, x, y, kind


SPANS = "doc_id long, start int, end int, kind string"


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start, end, kind): a row for every span of personal data or secret, in characters from 0, end exclusive.

    Null and empty texts have none. Rows are answered one by one: repeated rows
    give repeated spans, and a null doc_id is carried along. An empty table gives
    an empty result. Other columns, whatever their names, don't matter.
    """
    model = model or trained()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[i + r], a, b, KINDS[k]) for i, texts in tb.chunks(tb.string_array(batch.column("text")), CHUNK) for r, a, b, k in spans_of(texts, model)]
            columns = list(zip(*found)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "start", "end", "kind"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(emit, SPANS)


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; a null text stays null, other columns stay."""
    model = model or trained()
    names = docs.columns
    where = names.index("text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(where).to_pylist()
            for i, texts in tb.chunks(tb.string_array(batch.column(where)), CHUNK):
                for r, a, b, k in reversed(list(spans_of(texts, model))):
                    values[i + r] = f"{values[i + r][:a]}[{KINDS[k]}]{values[i + r][b:]}"
            columns = [*batch.columns]
            columns[where] = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(emit, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of personal data in the documents."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_pii": op7_pii}
