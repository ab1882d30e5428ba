"""Personal data by rules and by a character BiLSTM with CRF transitions.

Rules find base spans in whole texts. Beside them a bidirectional LSTM over characters, trained in numpy from
labelled spans, gives each character scores for the tags O, B-kind and I-kind. A span must hold a digit or an @, so
only stretches around those characters are scored: every one of them, in windows of WINDOW characters that overlap
by half. Scores of overlapping windows are averaged with weights that fall off towards a window's edges, and one
Viterbi pass over the whole stretch, with the learned transitions, reconciles all windows. A decoded span is extended to the ends of
the words it touches, however long, so that neither a stretch's edge nor a window's cuts it. Spans that pass the kind's check and
touch no base span of their kind are added; base spans are never changed. The trained weights lie in the package (`models`).

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; equal rows get equal
results; texts of any length are processed whole, in bounded batches of windows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import models

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE, HIDDEN, VOCAB = 64, 32, 20, 131
Span = tuple[str, int, int]

_email = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_trigger = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, in time linear in the text."""
    out: list[Span] = []
    end = 0
    if "@" in text:
        for m in _email.finditer(text):
            a = m.start()
            while a > end and _local.match(text[a - 1]):
                a -= 1
            if a < m.start():
                out.append(("email", a, m.end()))
                end = m.end()
    if not _trigger.search(text):
        return out
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _card.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _phone.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def plausible(kind: str, s: str) -> bool:
    """What a decoded span must hold."""
    d = _digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[^@]*\w[^@]*@[^@]*\w[^@]*\.[^@]*\w", s)) and len(s) <= 254
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\s?[.,\[\]()]{1,3}\s?[0-9]{1,3}){3}", s)) and all(int(x) <= 255 for x in re.findall("[0-9]+", s))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15 and bool(re.fullmatch(r"[+(0-9][ ().0-9/+-]*[0-9]", s))


# ---- the model

def encode(text: str) -> np.ndarray:
    """ASCII by itself, then one number for other letters and one for the rest; VOCAB - 1 is padding."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(x < 128, x, 129).astype(np.int16)
    out[(x >= 0xC0) & (x <= 0x24F)] = 128
    return out


@dataclass
class Tagger:
    """wx: a row of gate inputs for each character and direction; wh: recurrent weights; wo, bo: emissions; trans, start: CRF."""

    wx: np.ndarray
    wh: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    @staticmethod
    def fresh(seed: int, hidden: int = HIDDEN) -> Tagger:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        wx = f(2, VOCAB, 4 * hidden)
        wx[:, :, hidden : 2 * hidden] += 1
        return Tagger(wx, f(2, hidden, 4 * hidden), f(2 * hidden, TAGS), np.zeros(TAGS, np.float32), f(TAGS, TAGS), np.zeros(TAGS, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.wo, self.bo, self.trans, self.start]

    def hidden(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """ids: time x batch. Hidden states of both directions; what backward() needs, if keep."""
        steps, n = ids.shape
        size = self.wh.shape[1]
        out, kept = np.empty((steps, n, 2 * size), np.float32), []
        for d in (0, 1):
            h, c, own = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32), []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a = self.wx[d][ids[t]] + h @ self.wh[d]
                s = 1 / (1 + np.exp(-a[:, : 3 * size]))
                g = np.tanh(a[:, 3 * size :])
                before = (h, c)
                c = s[:, size : 2 * size] * c + s[:, :size] * g
                u = np.tanh(c)
                h = s[:, 2 * size :] * u
                out[t, :, d * size : (d + 1) * size] = h
                if keep:
                    own.append((t, s, g, u, *before))
            kept.append(own)
        return out, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self.hidden(ids)[0] @ self.wo + self.bo

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Negative log-likelihood of tags (time x batch) for each character, and its gradients."""
        steps, n = ids.shape
        size = self.wh.shape[1]
        hid, kept = self.hidden(ids, True)
        e = (hid @ self.wo + self.bo).astype(np.float64)
        tr = self.trans.astype(np.float64)
        top = lambda x, axis: (m := x.max(axis, keepdims=True), m.squeeze(axis) + np.log(np.exp(x - m).sum(axis)))[1]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = self.start + e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + top(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = top(tr + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = top(alpha[-1], 1)
        i = np.arange(n)
        gold = self.start[tags[0]] + e[0, i, tags[0]]
        g_tr, one = np.zeros_like(tr), np.eye(TAGS)
        for t in range(1, steps):
            gold = gold + tr[tags[t - 1], tags[t]] + e[t, i, tags[t]]
            pair = np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            g_tr += pair.sum(0)
            np.add.at(g_tr, (tags[t - 1], tags[t]), -1)
        marginal = np.exp(alpha + beta - z[None, :, None])
        de = ((marginal - one[tags]) / (n * steps)).astype(np.float32)
        g_start = (marginal[0] - one[tags[0]]).sum(0) / (n * steps)
        g_wo, g_bo = np.einsum("tbh,tbk->hk", hid, de), de.sum((0, 1))
        dh_all = de @ self.wo.T
        g_wx, g_wh = np.zeros_like(self.wx), np.zeros_like(self.wh)
        for d in (0, 1):
            dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
            for t, s, g, u, h0, c0 in reversed(kept[d]):
                dh = dh + dh_all[t, :, d * size : (d + 1) * size]
                si, sf, so = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
                dc = dc + dh * so * (1 - u * u)
                da = np.concatenate([dc * g * si * (1 - si), dc * c0 * sf * (1 - sf), dh * u * so * (1 - so), dc * si * (1 - g * g)], 1)
                np.add.at(g_wx[d], ids[t], da)
                g_wh[d] += h0.T @ da
                dh, dc = da @ self.wh[d].T, dc * sf
        return float((z - gold).mean() / steps), [g_wx, g_wh, g_wo, g_bo, (g_tr / (n * steps)).astype(np.float32), g_start.astype(np.float32)]


def train(examples: list[tuple[str, list[Span]]], seed: int = 2, epochs: int = 9, batch: int = 96, rate: float = 0.02) -> Tagger:
    """A tagger from texts with labelled spans; each text is one window (longer ones are cut, shorter ones padded)."""
    ids = np.full((len(examples), WINDOW), VOCAB - 1, np.int16)
    tags = np.zeros((len(examples), WINDOW), np.int64)
    for i, (text, spans) in enumerate(examples):
        x = encode(text)[:WINDOW]
        ids[i, : len(x)] = x
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            tags[i, a:b] = k + 1
            tags[i, a : a + 1] = k
    model, r = Tagger.fresh(seed), np.random.default_rng(seed)
    m1, m2, step = [np.zeros_like(p) for p in model.params()], [np.zeros_like(p) for p in model.params()], 0
    total = epochs * (len(examples) // batch)
    for _ in range(epochs):
        order = r.permutation(len(examples))
        for k in range(0, len(order) - batch + 1, batch):
            own = order[k : k + batch]
            _, grads = model.gradients(ids[own].T, tags[own].T)
            step += 1
            now = rate * min(1, 2 * (1 - step / (total + 1)))
            for p, g, a, b in zip(model.params(), grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def labelled_spans(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Texts of WINDOW characters with labelled spans, made by rule: invented words around data of each kind in common
    spellings, and numbers that are none (versions, dates, prices, years, long numbers, hashes)."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    num = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    word = lambda: "".join(pick("etaoinshrdlucmfwypvbgkéüñ") for _ in range(int(r.integers(2, 9))))

    def email() -> str:
        return pick([word() + num(int(r.integers(0, 3))), word() + pick(".-_+") + word(), word() + "." + num(2)]) + pick(["@", "@", "@", " @ ", "@ "]) + pick([word(), word() + num(1) + "." + word()]) + "." + pick(["com", "org", "net", "de", "co.uk"])

    def ip() -> str:
        return pick([".", ".", ".", " . ", "[.]"]).join(str(x) for x in r.integers(0, 256, 4))

    def card() -> str:
        d = num(int(pick([15, 16, 16, 16, 19])) - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        s = pick(["", " ", "-", ".", "  "])
        return s.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        return pick(["+" + num(1) + " ", "+" + num(2) + " ", "", ""]) + pick([f"({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"({num(3)}){num(3)} {num(4)}"])

    def other() -> str:
        return pick([lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.", lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: "$" + num(3) + "." + num(2), lambda: num(int(r.integers(1, 12))), lambda: "v" + ".".join(num(1) for _ in range(3)), lambda: "".join(pick("0123456789abcdef") for _ in range(24)), lambda: "@" + word(), lambda: num(2) + ":" + num(2), lambda: num(int(r.integers(20, 30)))])()

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        lead = int(r.integers(0, 5))
        plan = ["w"] * lead + [pick([*KINDS, "other"])] + ["w"] * int(r.integers(0, 4)) + ([pick([*KINDS, "other"])] if r.random() < 0.4 else []) + ["w"] * 8
        for p in plan:
            s = word() + (pick(".,") if r.random() < 0.15 else "") if p == "w" else other() if p == "other" else make[p]()
            if p in KINDS and at + len(s) <= WINDOW:
                spans.append((p, at, at + len(s)))
            elif p in KINDS:
                break
            parts.append(s + (pick([" ", " ", " ", "\n", ", ", " | "]) if p == "w" or r.random() < 0.8 else pick([".", ",", "!! ", "### ", "$$$ ", ") "])))
            at += len(parts[-1])
        out.append(("".join(parts)[:WINDOW], spans))
    return out


def trained(n: int = 2400, seed: int = 2) -> Tagger:
    return train(labelled_spans(n, seed), seed)


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    """The stored weights of trained()."""
    return Tagger(**models.load("pii"))


# ---- decoding

def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges around all characters that a span must hold, STRIDE characters to either side, merged where they touch."""
    out: list[list[int]] = []
    for m in _trigger.finditer(text):
        a, b = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _legal() -> np.ndarray:
    ok = np.zeros((TAGS, TAGS), np.float32)
    for k in range(2, TAGS, 2):
        for j in range(TAGS):
            if j not in (k - 1, k):
                ok[j, k] = -1e4
    return ok


_bell = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def scored(model: Tagger, ids: list[np.ndarray], windows_at_once: int = 2048) -> Iterator[np.ndarray]:
    """Emissions of each stretch, overlapping windows averaged."""
    job: list[tuple[int, int]] = []
    sums = [np.zeros((len(x), TAGS), np.float32) for x in ids]
    weight = [np.zeros(len(x), np.float32) for x in ids]
    for i, x in enumerate(ids):
        job += [(i, a) for a in range(0, max(1, len(x) - STRIDE), STRIDE)]
    for k in range(0, len(job), windows_at_once):
        own = job[k : k + windows_at_once]
        w = np.full((len(own), WINDOW), VOCAB - 1, np.int16)
        for j, (i, a) in enumerate(own):
            part = ids[i][a : a + WINDOW]
            w[j, : len(part)] = part
        e = model.emissions(w.T)
        for j, (i, a) in enumerate(own):
            n = min(WINDOW, len(ids[i]) - a)
            sums[i][a : a + n] += e[:n, j] * _bell[:n, None]
            weight[i][a : a + n] += _bell[:n]
    for s, w in zip(sums, weight, strict=True):
        yield s / w[:, None]


def viterbi(model: Tagger, emissions: list[np.ndarray], at_once: int = 256) -> list[np.ndarray]:
    """The best legal tags of each stretch as a whole."""
    tr, out = model.trans + _legal(), [np.zeros(0, np.int8)] * len(emissions)
    start = model.start.copy()
    start[2::2] -= 1e4
    order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
    k = 0
    while k < len(order):
        own = order[k : k + max(1, min(at_once, 2_000_000 // max(1, len(emissions[order[min(k + at_once, len(order)) - 1]]))))]
        k += len(own)
        steps = max(len(emissions[i]) for i in own)
        e = np.zeros((steps, len(own), TAGS), np.float32)
        pad = np.zeros((steps, len(own)), bool)
        for j, i in enumerate(own):
            e[: len(emissions[i]), j] = emissions[i]
            pad[len(emissions[i]) :, j] = True
        back = np.zeros((steps, len(own), TAGS), np.int8)
        v, stay = start + e[0], np.arange(TAGS, dtype=np.int8)
        for t in range(1, steps):
            s = v[:, :, None] + tr
            b = s.argmax(1)
            new = np.take_along_axis(s, b[:, None, :], 1)[:, 0] + e[t]
            back[t] = np.where(pad[t][:, None], stay, b)
            v = np.where(pad[t][:, None], v, new)
        tags = np.empty((steps, len(own)), np.int8)
        tags[-1] = v.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(len(own)), tags[t]]
        for j, i in enumerate(own):
            out[i] = tags[: len(emissions[i]), j]
    return out


def _snapped(text: str, kind: str, s: int, t: int, floor: int) -> tuple[int, int]:
    """The span with its last sign of punctuation left off, extended to the ends of the words it touches, not below floor."""
    while t > s and not text[t - 1].isalnum():
        t -= 1
    inside = (lambda c: _local.match(c) or c.isalnum()) if kind == "email" else str.isalnum
    while floor < s < len(text) and inside(text[s - 1]) and inside(text[s]):
        s -= 1
    while 0 < t < len(text) and text[t].isalnum() and text[t - 1].isalnum():
        t += 1
    return s, t


def find(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    where = [(n, a, b) for n, t in enumerate(texts) for a, b in stretches(t)]
    added: list[list[Span]] = [[] for _ in texts]
    ends = [0] * len(texts)
    for k in range(0, len(where), 4096):
        own = where[k : k + 4096]
        e = list(scored(model, [encode(texts[n][a:b]) for n, a, b in own]))
        for (n, a, b), tags in zip(own, viterbi(model, e), strict=True):
            i = 0
            while i < len(tags):
                if tags[i] % 2 == 0:
                    i += 1
                    continue
                j = i + 1
                while j < len(tags) and tags[j] == tags[i] + 1:
                    j += 1
                kind = KINDS[(tags[i] - 1) // 2]
                s, t = _snapped(texts[n], kind, a + i, a + j, ends[n])
                ends[n] = max(ends[n], t)
                if plausible(kind, texts[n][s:t]) and not any(q == kind and x < t and s < y for q, x, y in base[n]):
                    added[n].append((kind, s, t))
                i = j
    return list(zip(base, added, strict=True))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


SCHEMA = ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string, n_added long"


def detect(docs: DataFrame, model: Tagger | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts of base spans by kind, base_spans, spans (base and added), n_added."""
    model = model or default_tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                got = find([x or "" for x in part.column("text").to_pylist()], model)
                cols = [pa.array([sum(k == s[0] for s in b) for b, _ in got], pa.int64()) for k in KINDS]
                yield pa.record_batch([part.column("doc_id"), *cols, pa.array([joined(b) for b, _ in got]), pa.array([joined(b + a) for b, a in got]), pa.array([len(a) for _, a in got], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_added"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def redact(docs: DataFrame, model: Tagger | None = None, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets."""
    model = model or default_tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            new = []
            for t, (b, a) in zip(texts, find([x or "" for x in texts], model), strict=True):
                end, parts = 0, []
                for kind, s, e in sorted(b + a, key=lambda x: (x[1], -x[2])):
                    if s >= end:
                        parts += [(t or "")[end:s], f"<{kind}>"]
                        end = e
                new.append(None if t is None else "".join(parts) + t[end:])
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.encode("base_spans", "utf-8"), 256).alias("base_sha256"), "spans", "n_added")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
