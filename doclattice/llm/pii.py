"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

Base kinds come from patterns and checks; those spans always stay. The network (numpy only) is
trained on the driver from labelled spans in contexts from at most TRAIN_DOCS documents: the base
spans that are there, and spans that are written into the contexts, half of them in ways that the
patterns don't know (a spelled or bracketed `at` and `dot`, spaces around the dots of an address,
dots or slashes between the digits of a card, telephone numbers without a plus), besides numbers
that are no personal data. Texts are cut into overlapping windows; each is decoded by Viterbi, and
where windows overlap a character gets the tag of the window whose middle is nearest, so that one
global tagging comes out, from which spans are read.

Addresses, cards and telephone numbers have digits, and emails an @, a bracketed `at` or a spelled
`dot`: windows without any of these signs (SIGN) are all outside and not decoded. Spans that the
network finds apart from base spans are added if they can be what they are said to be: an address
has four numbers up to 255, a card a valid check digit, a telephone number 10 to 15 digits, an email
its two signs.

Nulls: a null text is empty. Places are in code points, ends exclusive. Long runs of any characters
take linear time. Repeated rows are each answered, empty tables give no rows (and an untrained
network, which is not used), further columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.common import table, texts

KINDS = ("email", "ip", "card", "phone")
RUNS = {
    "local": re.compile(r"[A-Za-z0-9._%+-]+"),
    "domain": re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    "numbers": re.compile(r"[0-9]++(?:\.[0-9]++)*+"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TRIGGER = re.compile("[0-9@]")
#: What a window has that is worth decoding.
SIGN = re.compile(r"[0-9@]|[\[({<]\x20?at\x20?[\])}>]|\bdot\b", re.IGNORECASE | re.ASCII)

#: Bounds of what the driver gathers to fit the network: of a longer text a piece is taken.
TRAIN_LOOKED = 1200
TRAIN_DOCS = 600
TRAIN_CHARS = 4_000
TRAIN_WINDOWS = 3600

LENGTH = 96
STRIDE = 48
HIDDEN = 16
CHARS = 130
TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind != "phone" or 10 <= len(_digits(s)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Of each run of local characters that an @ ends, what no earlier match has taken, with the
    domain behind the @. No run is searched twice."""
    end = 0
    for m in RUNS["local"].finditer(text) if "@" in text else ():
        start = max(m.start(), end)
        if start < m.end() and text[m.end() : m.end() + 1] == "@" and (d := RUNS["domain"].match(text, m.end() + 1)):
            end = d.end()
            yield start, end


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Each four numbers in turn of a run of numbers with dots between them."""
    for m in RUNS["numbers"].finditer(text):
        at = m.start()
        numbers = m[0].split(".")
        for i in range(0, len(numbers) - 3, 4):
            size = sum(map(len, numbers[i : i + 4])) + 3
            yield at, at + size
            at += size + 1


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Matches of a kind's pattern, leftmost first, each in time linear in the text."""
    if kind == "email":
        return _emails(text)
    if kind == "ip":
        return _addresses(text)
    return (m.span() for m in RUNS[kind].finditer(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in order."""
    if not TRIGGER.search(text):
        return []
    return sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in _matches(kind, text) if valid(kind, text[a:b]))


def encoded(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, code, 128 + (code > 0x24F)).astype(np.int64)


def window_starts(text: str) -> list[int]:
    """Starts of the windows that touch a sign."""
    last = max(0, -(-(len(text) - LENGTH) // STRIDE))
    found: set[int] = set()
    for m in SIGN.finditer(text):
        for k in range(m.start() // STRIDE, (m.end() - 1) // STRIDE + 1):
            found.update(j for j in (k - 1, k) if 0 <= j <= last)
            if k > last:
                found.add(last)
    return [j * STRIDE for j in sorted(found)]


class Network:
    """Weights and their gradients; forward and backward pass over windows of characters."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, w = HIDDEN, lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        self.w = {f"{n}{d}": v for d in "fb" for n, v in (("x", w(CHARS, 4 * h)), ("u", w(h, 4 * h)))}
        self.w |= {"o": w(2 * h, TAGS), "c": np.zeros(TAGS, np.float32), "t": w(TAGS, TAGS), "s": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.w[f"x{d}"][:, h : 2 * h] += 1  # the forget gate starts open

    def _lstm(self, ids: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, length = ids.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, memory = np.zeros((n, length, HIDDEN), np.float32), []
        x, u = self.w[f"x{d}"][ids], self.w[f"u{d}"]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = x[:, t] + h @ u
            g = np.tanh(z[:, 3 * HIDDEN :])
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            memory.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[:, t] = h
        return out, memory

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        (f, mf), (b, mb) = self._lstm(ids, "f"), self._lstm(ids, "b")
        h = np.concatenate([f, b], axis=2)
        return h @ self.w["o"] + self.w["c"], h, (mf, mb)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of each window, by Viterbi."""
        e, _, _ = self.emissions(ids)
        n, length, _ = e.shape
        score, back = e[:, 0] + self.w["s"], np.zeros((n, length, TAGS), np.int8)
        for t in range(1, length):
            step = score[:, :, None] + self.w["t"]
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + e[:, t]
        tags = np.zeros((n, length), np.int8)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        e, h, memory = self.emissions(ids)
        n, length, _ = e.shape
        trans = self.w["t"]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + self.w["s"]
        for t in range(1, length):
            alpha[:, t] = _logsum(alpha[:, t - 1][:, :, None] + trans, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsum(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        row = np.arange(n)[:, None]
        gold = e[row, np.arange(length), tags].sum() + self.w["s"][tags[:, 0]].sum() + trans[tags[:, :-1], tags[:, 1:]].sum()
        de[row, np.arange(length), tags] -= 1
        np.subtract.at(pair, (tags[:, :-1], tags[:, 1:]), 1)
        g = {"t": pair / n, "s": de[:, 0].sum(axis=0) / n}
        de /= n
        g["c"] = de.sum(axis=(0, 1))
        g["o"] = np.tensordot(h, de, ((0, 1), (0, 1)))
        dh = de @ self.w["o"].T
        for k, d in enumerate("fb"):
            self._back(ids, dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], memory[k], d, g)
        return float((z.sum() - gold) / n), g

    def _back(self, ids: np.ndarray, dh: np.ndarray, memory: list, d: str, g: dict) -> None:
        dx, du = np.zeros((*ids.shape, 4 * HIDDEN), np.float32), np.zeros_like(self.w[f"u{d}"])
        later, dc = np.zeros_like(dh[:, 0]), np.zeros_like(dh[:, 0])
        for t, h, before, i, f, o, gate, tc in reversed(memory):
            now = dh[:, t] + later
            dc = dc + now * o * (1 - tc**2)
            dz = np.concatenate([dc * gate * i * (1 - i), dc * before * f * (1 - f), now * tc * o * (1 - o), dc * i * (1 - gate**2)], axis=1)
            dc = dc * f
            du += h.T @ dz
            later = dz @ self.w[f"u{d}"].T
            dx[:, t] = dz
        flat, table = dx.reshape(-1, 4 * HIDDEN), np.zeros_like(self.w[f"x{d}"])
        order = np.argsort(ids.ravel(), kind="stable")
        values, first = np.unique(ids.ravel()[order], return_index=True)
        table[values] = np.add.reduceat(flat[order], first, axis=0)
        g[f"x{d}"], g[f"u{d}"] = table, du


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(labelled: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 600, rate: float = 0.02, seed: int = 7) -> Network | None:
    """labelled: text and its spans (start, kind's number, end)."""
    ids, tags = [], []
    for text, spans in labelled:
        code, tag = encoded(text), np.zeros(len(text), np.int64)
        for a, k, b in spans:
            tag[a:b], tag[a] = 2 + 2 * k, 1 + 2 * k
        for s in window_starts(text):
            ids.append(np.pad(code[s : s + LENGTH], (0, max(0, LENGTH - len(code) + s))))
            tags.append(np.pad(tag[s : s + LENGTH], (0, max(0, LENGTH - len(code) + s))))
    if not ids:
        return None
    r = np.random.default_rng(seed)
    chosen = r.permutation(len(ids))[: 2 * TRAIN_WINDOWS]
    x, y = np.array(ids)[chosen], np.array(tags)[chosen]
    net = Network(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    for step in range(1, steps + 1):
        part = r.integers(0, len(x), 32)
        _, g = net.gradients(x[part], y[part])
        size = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
        for k, a in g.items():
            a = a * min(1, 5 / max(size, 1e-6))
            m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a**2
            net.w[k] = (net.w[k] - rate * 0.1 ** (step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def read_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a global tagging."""
    out: list[tuple[int, int, int]] = []
    for at in np.flatnonzero(tags).tolist():
        kind, inside = (int(tags[at]) - 1) // 2, tags[at] % 2 == 0
        if inside and out and out[-1][1:] == (kind, at):
            out[-1] = (out[-1][0], kind, at + 1)
        else:
            out.append((at, kind, at + 1))
    return out


def reconciled(length: int, starts: list[int], tags: np.ndarray) -> np.ndarray:
    """One tagging of a text from those of its windows: the nearest middle wins."""
    out, near = np.zeros(length, np.int8), np.full(length, LENGTH)
    away = np.abs(np.arange(LENGTH) - LENGTH // 2)
    for s, tag in zip(starts, tags, strict=True):
        n = min(LENGTH, length - s)
        better = away[:n] < near[s : s + n]
        out[s : s + n][better] = tag[:n][better]
        near[s : s + n] = np.minimum(near[s : s + n], away[:n])
    return out


def model_spans(net: Network, docs: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds in each text; windows of all texts are decoded together."""
    where, ids, out = [], [], []
    for text in docs:
        starts = window_starts(text)
        code = encoded(text) if starts else None
        ids += [np.pad(code[s : s + LENGTH], (0, max(0, LENGTH - len(code) + s))) for s in starts]
        where.append(starts)
    tags = np.concatenate([net.decode(np.array(ids[i : i + 512])) for i in range(0, len(ids), 512)]) if ids else np.zeros((0, LENGTH), np.int8)
    at = 0
    for text, starts in zip(docs, where, strict=True):
        out.append(read_spans(reconciled(len(text), starts, tags[at : at + len(starts)])) if starts else [])
        at += len(starts)
    return out


AT_SIGN = re.compile(r"@|[\[({<]\x20?at\x20?[\])}>]|\x20at\x20", re.IGNORECASE)
DOT_SIGN = re.compile(r"\.|[\[({<]\x20?dot\x20?[\])}>]|\x20dot\x20", re.IGNORECASE)


SHAPES = {"card": re.compile(r"[0-9][\x20./_0-9-]+[0-9]"), "phone": re.compile(r"[+(0-9][\x20()./0-9-]+[0-9]")}


def plausible(kind: str, s: str) -> bool:
    """Whether a span in any notation can be of its kind."""
    if len(s) > LENGTH:
        return False
    if kind == "email":
        at = AT_SIGN.search(s, 1)
        dot = at and DOT_SIGN.search(s, at.end() + 1)
        return bool(dot) and dot.end() < len(s)
    if kind == "ip":
        numbers = re.findall("[0-9]+", s)
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    return SHAPES[kind].fullmatch(s) is not None and valid(kind, s)


def added(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the network's spans that stand apart from base spans, cut no number in two and can be
    what they are said to be."""
    out, i = [], 0
    for a, k, b in found:  # both lists are in order
        while i < len(base) and base[i][0] < b and base[i][2] <= a:
            i += 1
        near = base[max(0, i - len(KINDS)) : i + len(KINDS) + 1]
        broken = a and text[a - 1].isdigit() and text[a].isdigit() or text[b - 1].isdigit() and text[b : b + 1].isdigit()
        if not broken and all(b <= x or y <= a for x, _, y in near) and plausible(KINDS[k], text[a:b]):
            out.append((a, k, b))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _email(r: random.Random, usual: bool) -> str:
    word = lambda n: "".join(r.choice("abcdefghijklmnoprstuvwxyz") for _ in range(r.randint(2, n)))
    name = word(8) + r.choice(["", ".", "_", "-", "+"]).join(["", word(6)]) + r.choice(["", str(r.randint(1, 99))])
    at, dot = ("@", ".") if usual else r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("(at)", "(dot)"), (" @ ", "."), ("@", " dot ")])
    return name + at + word(9) + dot + r.choice(["com", "org", "net", "de", "fr", "es", "io"])


def _ip(r: random.Random, usual: bool) -> str:
    dot = "." if usual else r.choice([" . ", ". ", " .", "[.]", "(.)", " dot "])
    return dot.join(str(r.randint(0, 255)) for _ in range(4))


def _card(r: random.Random, usual: bool) -> str:
    n = r.choice([14, 15, 16, 16, 16, 16, 19])
    digits = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(n - 2))
    digits += next(d for d in "0123456789" if luhn(digits + d))
    sep = r.choice(["", " ", "-"]) if usual else r.choice([".", "/", "  ", " - ", "_"])
    return sep.join(digits[i : i + 4] for i in range(0, n, 4))


def _phone(r: random.Random, usual: bool) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if usual:
        sep = r.choice([" ", "-", ".", ""])
        return f"+{r.randint(1, 99)}" + r.choice([" ", sep, " ("]).join(["", d(3)]) + sep + d(3) + sep + d(4)
    sep = r.choice([" ", "-", "."])
    return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){sep}{d(3)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"00{r.randint(1, 99)}{sep}{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(2)}/{d(8)}"])


def _other(r: random.Random) -> str:
    """Numbers and words that are no personal data."""
    n = lambda a, b: str(r.randint(a, b))
    return r.choice(
        [
            lambda: f"{n(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{n(1, 28)}.{n(1, 12)}.{n(1900, 2099)}", lambda: f"{n(0, 23)}:{r.randint(0, 59):02}",
            lambda: f"{n(0, 20)}.{n(0, 20)}.{n(0, 99)}", lambda: n(0, 99_999), lambda: n(10**9, 10**19), lambda: f"{n(1, 999)},{r.randint(0, 999):03}.{r.randint(0, 99):02}", lambda: f"{n(1, 999)} at {n(1, 99)}",
            lambda: f"{n(1, 9)}.{n(0, 9)}", lambda: f"{n(1, 99)} % of {n(1, 9999)}", lambda: f"the dot at {n(1, 9)}", lambda: f"{n(300, 999)}.{n(300, 999)}.{n(1, 999)}.{n(1, 999)}", lambda: f"@{n(1, 99)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32]))),
        ]
    )()


MAKERS = (_email, _ip, _card, _phone)


def examples(contexts: list[str], n: int, seed: int = 7, usual: float = 0.5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n pieces of contexts with a labelled span, or what is none, written into each. usual: the
    share of spans that the patterns know."""
    r, out = random.Random(seed), []
    for _ in range(n if contexts else 0):
        text = r.choice(contexts)
        at = r.randint(0, max(0, len(text) - 160))
        piece = TRIGGER.sub("", text[at : at + 160])
        cut = r.randint(0, len(piece))
        if r.random() < 0.8 and " " in piece[cut:]:
            cut = piece.index(" ", cut) + 1
        head, tail = piece[:cut] + r.choice(["", "", "", ": ", "(", '"']), r.choice([" ", " ", ", ", ". ", "\n", ")"]) + piece[cut:]
        if r.random() < 0.3:
            out.append((head + _other(r) + tail, []))
            continue
        k = r.randrange(len(KINDS))
        span = MAKERS[k](r, r.random() < usual)
        out.append((head + span + tail, [(len(head), k, len(head) + len(span))]))
    return out


def contexts(docs: DataFrame, seed: int = 42) -> list[str]:
    """Texts, or pieces of TRAIN_CHARS characters of longer ones, of at most TRAIN_DOCS documents.
    About TRAIN_LOOKED documents are looked at, by a hash of their ids; the smallest hashes are taken."""
    total = docs.count()  # from the files' footers
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    some = F.pmod(h, F.lit(1 << 30)) <= (1 << 30) * TRAIN_LOOKED // max(TRAIN_LOOKED, total)
    start = 1 + F.pmod(F.xxhash64("text", F.lit(seed)), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1)))
    able = texts(docs).filter(some & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    picked = able.select(h.alias("h"), "doc_id", F.substring(F.col("text"), start.cast("int"), F.lit(TRAIN_CHARS)).alias("text"))
    return [r.text for r in picked.orderBy("h", "doc_id", F.xxhash64("text")).limit(TRAIN_DOCS).collect()]


def trained(docs: DataFrame) -> Network | None:
    """A network from base spans and written spans in a bounded sample of contexts."""
    found = contexts(docs)
    own = [(t, s) for t in found if (s := base_spans(t))]
    return fit(own + examples(found, TRAIN_WINDOWS)) if found else None


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def report(docs: DataFrame, net: Network | None) -> DataFrame:
    """Digest columns for each document; n_spans: of all kinds, with those that the network adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                docs = part.column(1).to_pylist()
                base = list(map(base_spans, docs))
                found = model_spans(net, docs) if net else [[] for _ in docs]
                counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                sha = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
                every = [b + added(t, b, f) for t, b, f in zip(docs, base, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(sha), pa.array(map(listed, every), pa.string()), pa.array(map(len, every), pa.int64())], [c.split()[0] for c in REPORT.split(", ")])

    return texts(docs).mapInArrow(run, REPORT)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, trained(docs))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_pii that its patterns decide, for comparison with SQL."""
    return report(table(spark, sf_dir, "documents"), None).drop("spans", "n_spans")


def _kind_sql(number: int, kind: str, pattern: str) -> str:
    return f"select k, {number} as ord, '{kind}' as kind, string_split_regex(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as found from d"


_DIGIT_SQL = "cast(digits[length(digits) - i] as int)"
BASE_SQL = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
m as ({_kind_sql(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")} union all {_kind_sql(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")}
  union all {_kind_sql(2, "card", r"[0-9]([\x20-]?[0-9])+")} union all {_kind_sql(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]")}),
s as (select k, ord, kind, unnest(found) as v, unnest(range(len(found))) as i, gaps, found from m),
p as (select k, ord, kind, v, regexp_replace(v, '[^0-9]', '', 'g') as digits,
  cast(list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))), 0) as bigint) as start from s),
b as (select *, case kind when 'email' then true when 'phone' then length(digits) between 10 and 15
    when 'ip' then len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 or cast('0' || right(x, 3) as int) > 255)) = 0
    when 'card' then length(digits) between 14 and 19 and list_sum(list_transform(range(length(digits)),
      lambda i: case when i % 2 = 0 then {_DIGIT_SQL} else 2 * {_DIGIT_SQL} // 10 + 2 * {_DIGIT_SQL} % 10 end)) % 10 = 0 end as good from p),
g as (select k, {", ".join(f"count(*) filter (kind = '{x}') as n_{x}" for x in KINDS)}, string_agg(kind || ':' || start || ':' || (start + length(v)), ',' order by start, ord) as listed from b where good group by k)
select doc_id, {", ".join(f"coalesce(n_{x}, 0) as n_{x}" for x in KINDS)}, sha256(coalesce(listed, '')) as base_sha256 from d left join g using (k)
"""
