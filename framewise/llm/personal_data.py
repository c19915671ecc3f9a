"""Personal data by rules and by a character-level bidirectional LSTM with a CRF.

The rules find e-mail and IP addresses, card and phone numbers. The model learns from spans labelled by
wider rules (card numbers need no valid check digit) in a bounded sample of texts, ``sample`` of at most
``max_bytes`` bytes, and from written variants of them; it is trained in numpy. A text's characters near
a digit or an @ (every span of these kinds has one) are read in overlapping windows. Each window is
decoded by forward-backward; where windows overlap, their posteriors are averaged by the distance from
the windows' edges, and one Viterbi path over the whole stretch settles the spans. The rules' spans stay;
the model's are added where they meet none of them and look like their kind.

Places count code points, ends are exclusive. Defined results: a null or empty text has no spans; without
sample texts only rules apply; repeated rows each get a row; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Fixed patterns of the kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches: for each @, the run of local characters before it, back to the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        else:
            done = max(done, at + 1) if start < at else done
        at = text.find("@", max(at + 1, done))
    return out


def _ips(text: str) -> list[Span]:
    """Leftmost matches: of numbers with single dots between them, one four after another. Linear, also in a million digits."""
    out = []
    for m in _DOTTED.finditer(text):
        numbers, at = m[0].split("."), m.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append(("ip", at, end))
            at = end + 1
    return out


def base_spans(text: str, strict: bool = True) -> list[Span]:
    """The rules' spans by kind, then place. Not strict: card numbers need no valid check digit."""
    if not _TRIGGER.search(text):
        return []
    out = _emails(text) + _ips(text)
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and (not strict or luhn(digits)):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


@dataclass(frozen=True)
class Tagger:
    sample: int = 600
    max_bytes: int = 50_000
    window: int = 96
    step: int = 48
    embed: int = 12
    hidden: int = 24
    batch: int = 64
    epochs: int = 6
    rate: float = 0.01
    seed: int = 5


#: Tags: 0 outside; then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CHARS = 8 + len(_PUNCTUATION)  # 0 pads


def char_classes(text: str) -> np.ndarray:
    """1 digit, 2 lower and 3 upper ASCII letters, 4 blank, 5 other white space, 6 other letters, 7 the rest, punctuation."""
    table = np.full(128, 7, np.int64)
    table[48:58], table[97:123], table[65:91], table[32] = 1, 2, 3, 4
    table[9:14] = 5
    for k, c in enumerate(_PUNCTUATION):
        table[ord(c)] = 8 + k
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, table[np.minimum(code, 127)], 6)


def stretches(text: str, t: Tagger) -> list[tuple[int, int]]:
    """Merged neighbourhoods of digits and @."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - t.step + 1), min(len(text), m.start() + t.step + 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _forbidden() -> np.ndarray:
    """Large costs for an inside tag that does not continue its kind; the last row is the start."""
    cost = np.zeros((TAGS + 1, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        cost[:, inside] = -1e4
        cost[[inside - 1, inside], inside] = 0
    return cost


class Network:
    """Embedding, two LSTMs, a linear layer and CRF transitions; forward, gradients and posteriors."""

    def __init__(self, t: Tagger):
        rng = np.random.default_rng(t.seed)
        h, d = t.hidden, t.embed
        glorot = lambda a, b: rng.normal(0, (2 / (a + b)) ** 0.5, (a, b))
        self.t, self.h = t, h
        self.p = {"emb": rng.normal(0, 0.3, (CHARS, d)), "out": glorot(2 * h, TAGS), "ob": np.zeros(TAGS), "trans": np.zeros((TAGS + 1, TAGS))}
        for way in "fb":
            self.p |= {f"x{way}": glorot(d, 4 * h), f"h{way}": glorot(h, 4 * h), f"b{way}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        self.cost = _forbidden()

    def _lstm(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """x: (T, B, d) in reading order; a padded step keeps the state."""
        h, n = self.h, x.shape[1]
        state, cell, out, kept = np.zeros((n, h)), np.zeros((n, h)), [], []
        xw = x @ self.p["x" + way] + self.p["b" + way]
        for k in range(len(x)):
            z = xw[k] + state @ self.p["h" + way]
            gate = 1 / (1 + np.exp(-z[:, : 3 * h]))
            i, f, o, g = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :], np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            tanh = np.tanh(new)
            m = mask[k][:, None]
            kept.append((i, f, o, g, cell, tanh, state, m))
            cell, state = np.where(m, new, cell), np.where(m, o * tanh, state)
            out.append(state)
        return np.array(out), kept

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(T, B, tags) scores of (T, B) character classes."""
        mask, x = codes > 0, self.p["emb"][codes]
        f, kf = self._lstm(x, mask, "f")
        b, kb = self._lstm(x[::-1], mask[::-1], "b")
        both = np.concatenate([f, b[::-1]], axis=2)
        if keep is not None:
            keep |= {"x": x, "both": both, "kf": kf, "kb": kb, "codes": codes}
        return both @ self.p["out"] + self.p["ob"]

    def posteriors(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals (T, B, tags), expected transitions (tags + 1, tags) and log partition, by forward-backward."""
        trans = self.p["trans"] + self.cost
        step, first = trans[:-1], trans[-1]
        steps, n, _ = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0] + first
        for k in range(1, steps):
            a = alpha[k - 1]
            top = a.max(axis=1, keepdims=True)
            new = np.log(np.maximum(np.exp(a - top) @ np.exp(step), 1e-300)) + top + e[k]
            alpha[k] = np.where(mask[k][:, None], new, a)
        for k in range(steps - 2, -1, -1):
            b = beta[k + 1] + e[k + 1]
            top = b.max(axis=1, keepdims=True)
            new = np.log(np.maximum(np.exp(b - top) @ np.exp(step).T, 1e-300)) + top
            beta[k] = np.where(mask[k + 1][:, None], new, beta[k + 1])
        z = np.log(np.exp(alpha[-1] - alpha[-1].max(axis=1, keepdims=True)).sum(axis=1)) + alpha[-1].max(axis=1)
        marginal = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
        expected = np.zeros_like(trans)
        expected[-1] = marginal[0].sum(axis=0)
        a = np.exp(np.clip(alpha[:-1] - z[None, :, None] * 0.5, -700, 700))
        b = np.exp(np.clip(beta[1:] + e[1:] - z[None, :, None] * 0.5, -700, 700)) * mask[1:, :, None]
        expected[:-1] = np.einsum("tbi,tbj->ij", a, b) * np.exp(step)
        return marginal, expected, z

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of (T, B) tags and its gradients."""
        keep: dict = {}
        e, mask = self.emissions(codes, keep), codes > 0
        marginal, expected, z = self.posteriors(e, mask)
        steps, n = codes.shape
        at, row = np.meshgrid(np.arange(steps), np.arange(n), indexing="ij")
        true = np.zeros_like(e)
        true[at[mask], row[mask], tags[mask]] = 1
        before = np.concatenate([np.full((1, n), TAGS), tags[:-1]])
        seen = np.zeros_like(expected)
        np.add.at(seen, (before[mask], tags[mask]), 1)
        path = (e * true).sum() + (seen * (self.p["trans"] + self.cost)).sum()
        de = (marginal - true) / n
        g = {"trans": (expected - seen) / n, "ob": de.sum((0, 1)), "out": np.einsum("tbi,tbj->ij", keep["both"], de), "emb": np.zeros_like(self.p["emb"])}
        dboth = de @ self.p["out"].T
        dx = np.zeros_like(keep["x"])
        h = self.h
        for way, dh_all, kept in (("f", dboth[:, :, :h], keep["kf"]), ("b", dboth[::-1, :, h:], keep["kb"])):
            x = keep["x"] if way == "f" else keep["x"][::-1]
            dz_all = np.zeros((steps, n, 4 * h))
            dstate, dcell, gh = np.zeros((n, h)), np.zeros((n, h)), np.zeros((h, 4 * h))
            for k in range(steps - 1, -1, -1):
                i, f, o, c, cell, tanh, state, m = kept[k]
                ds = dstate + dh_all[k]
                on = ds * m
                dnew = on * o * (1 - tanh**2) + dcell * m
                dz = np.concatenate([dnew * c * i * (1 - i), dnew * cell * f * (1 - f), on * tanh * o * (1 - o), dnew * i * (1 - c**2)], axis=1)
                dz_all[k] = dz
                gh += state.T @ dz
                dstate = dz @ self.p["h" + way].T + ds * ~m
                dcell = dnew * f + dcell * ~m
            g |= {f"h{way}": gh, f"x{way}": np.einsum("tbi,tbj->ij", x, dz_all), f"b{way}": dz_all.sum((0, 1))}
            back = dz_all @ self.p["x" + way].T
            dx += back if way == "f" else back[::-1]
        np.add.at(g["emb"], codes, dx)
        return float((z.sum() - path) / n), g


def tag_row(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        if not tags[a:b].any():
            tags[a], tags[a + 1 : b] = k, k + 1
    return tags


def _variants(text: str, span: Span, rng: np.random.Generator) -> tuple[str, int]:
    """Another way to write a span: its text and the shift of its start."""
    kind, a, b = span
    own = text[a:b]
    if kind == "phone" and rng.random() < 0.5:
        return own.lstrip("+"), 0
    if kind == "card" and rng.random() < 0.5:
        digits, by = _NOT_DIGIT.sub("", own), rng.choice(["", " ", "-", "."])
        return str(by).join(digits[k : k + 4] for k in range(0, len(digits), 4)), 0
    return own, 0


def training_windows(texts: list[str], t: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """(n, window) character classes and tags: each stretch of each text, once as it is and once varied."""
    rng = np.random.default_rng(t.seed)
    codes, tags = [], []

    def add(text: str, spans: list[Span]) -> None:
        c, y = char_classes(text), tag_row(len(text), spans)
        for a, b in stretches(text, t):
            for at in range(a, max(a + 1, b - t.step), t.step):
                row = np.zeros((2, t.window), np.int64)
                got = min(t.window, len(c) - at)
                row[0, :got], row[1, :got] = c[at : at + got], y[at : at + got]
                first = row[1, 0]
                if first and first % 2 == 0:  # the window starts within a span
                    row[1, 0] -= 1
                codes.append(row[0]), tags.append(row[1])

    for text in texts:
        spans = sorted(base_spans(text, strict=False), key=lambda s: s[1])
        add(text, spans)
        made, moved, upto = "", [], 0
        for s in spans:
            if s[1] < upto:
                continue
            new, _ = _variants(text, s, rng)
            made += text[upto : s[1]]
            moved.append((s[0], len(made), len(made) + len(new)))
            made, upto = made + new, s[2]
        if moved:
            add(made + text[upto:], moved)
    return np.array(codes, np.int64).reshape(-1, t.window), np.array(tags, np.int64).reshape(-1, t.window)


def train(texts: list[str], t: Tagger = Tagger()) -> Network | None:
    """Adam on batches of windows; None without any window."""
    codes, tags = training_windows(texts, t)
    if not len(codes):
        return None
    net, rng = Network(t), np.random.default_rng(t.seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    done, steps = 0, t.epochs * -(-len(codes) // t.batch)
    for _ in range(t.epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), t.batch):
            pick = order[at : at + t.batch]
            _, g = net.gradients(codes[pick].T, tags[pick].T)
            norm = sum(float((x**2).sum()) for x in g.values()) ** 0.5
            done += 1
            rate = t.rate * (1 - 0.9 * done / steps)
            for k in g:
                x = g[k] * min(1.0, 5.0 / max(norm, 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**done)) / (np.sqrt(v[k] / (1 - 0.999**done)) + 1e-8)
    return net


def _viterbi(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best path over (T, tags) scores; only impossible transitions cost."""
    back = np.zeros(score.shape, np.int64)
    now = score[0] + trans[-1]
    for k in range(1, len(score)):
        ways = now[:, None] + trans[:-1]
        back[k] = ways.argmax(axis=0)
        now = ways[back[k], np.arange(score.shape[1])] + score[k]
    path = [int(now.argmax())]
    for k in range(len(score) - 1, 0, -1):
        path.append(int(back[k][path[-1]]))
    return np.array(path[::-1])


def _looks_right(kind: str, text: str) -> bool:
    digits = len(_NOT_DIGIT.sub("", text))
    if kind == "email":
        return "@" in text.strip("@") and not re.search(r"\s", text)
    if re.search(r"[A-Za-z@\n]", text):
        return False
    return {"ip": 4 <= digits <= 12 and len(re.findall("[0-9]+", text)) == 4, "card": 13 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def model_spans(texts: list[str], net: Network, most: int = 300_000) -> list[list[Span]]:
    """The model's spans in whole texts; texts are read together up to so many characters near triggers."""
    out: list[list[Span]] = [[] for _ in texts]
    group: list[tuple[int, int, int]] = []
    size = 0
    for k, text in enumerate(texts):
        for a, b in stretches(text, net.t):
            group.append((k, a, b))
            size += b - a
            if size >= most:
                _read(texts, group, net, out)
                group, size = [], 0
    _read(texts, group, net, out)
    return out


def _read(texts: list[str], jobs: list[tuple[int, int, int]], net: Network, out: list[list[Span]]) -> None:
    """Adds the spans of stretches (text, start, end) to ``out``."""
    t, windows = net.t, []  # (job, start, classes)
    for job, (k, a, b) in enumerate(jobs):
        classes = char_classes(texts[k][a:b])
        for at in range(0, max(1, b - a - t.step), t.step):
            row = np.zeros(t.window, np.int64)
            part = classes[at : at + t.window]
            row[: len(part)] = part
            windows.append((job, at, row))
    sums = [np.zeros((b - a, TAGS)) for _, a, b in jobs]
    ramp = 1.0 + np.minimum(np.arange(t.window), np.arange(t.window)[::-1])
    for at in range(0, len(windows), 512):
        part = windows[at : at + 512]
        codes = np.array([w[2] for w in part]).T
        e = net.emissions(codes)
        marginal, _, _ = net.posteriors(e, codes > 0)
        for k, (job, start, _) in enumerate(part):
            got = min(t.window, len(sums[job]) - start)
            sums[job][start : start + got] += marginal[:got, k] * ramp[:got, None]
    cost = _forbidden()
    for (k, a, _), total in zip(jobs, sums, strict=True):
        p = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        if p[:, 0].min() > 0.5:
            continue
        path = _viterbi(np.log(np.maximum(p, 1e-9)), cost)
        for s in np.flatnonzero(path % 2 == 1):
            e = s + 1
            while e < len(path) and path[e] == path[s] + 1:
                e += 1
            kind = KINDS[path[s] // 2]
            if p[np.arange(s, e), path[s:e]].mean() >= 0.8 and _looks_right(kind, texts[k][a + s : a + e]):
                out[k].append((kind, a + int(s), a + int(e)))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_personal_data(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, counts and digest of the rules' spans, and all spans, of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            base = [base_spans(x) for x in texts]
            some = [k for k, x in enumerate(texts) if _TRIGGER.search(x)]
            added = dict(zip(some, model_spans([texts[k] for k in some], net), strict=True)) if net else {}
            spans = []
            for k, own in enumerate(base):
                new = [s for s in added.get(k, []) if not any(s[1] < b and a < s[2] for _, a, b in own)]
                spans.append(_written(own + new))
            cols = [batch.column("doc_id")]
            cols += [pa.array([sum(s[0] == kind for s in own) for own in base], pa.int64()) for kind in KINDS]
            cols += [pa.array([hashlib.sha256(_written(own).encode()).hexdigest() for own in base]), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, {counts}, base_sha256 string, spans string")


def fit(docs: DataFrame, t: Tagger = Tagger()) -> Network | None:
    """Train on a bounded sample of the texts that have a digit or an @."""
    known = docs.filter(F.octet_length("text") <= t.max_bytes).filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    chosen = known.select("doc_id", "text").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text").limit(t.sample)  # one pass
    rows = sorted((r["doc_id"], r["text"]) for r in chosen.collect())
    return train([x[1] for x in rows], t)
