"""Personal data with a skip-chain conditional random field.

Base patterns find well-formed e-mail addresses, IPv4 addresses, card and phone numbers.  A CRF then labels
the tokens of a document that can be part of personal data.  Neighbouring tokens share chain potentials;
tokens that repeat each other (the same token, the same long digit string, the local part of an address in the
text) share skip potentials, however far apart.  Loopy sum-product message passing over the whole document
makes labels consistent, so a number that is written in full once is found where it is repeated in part.  A text
without base spans goes through the field as well: a number without its country is found where it is announced or
repeated.  The base spans stay as they are; the CRF adds spans.

Weights are fitted by pseudo-likelihood on generated sentences (``TRAIN_SENTENCES`` of them, fixed seed), so
they are the same everywhere and take no rows of the input.  Repeats are linked to their next occurrence and, as
evidence fades from link to link, to the first base span of each kind that they repeat, so edges are linear in tokens.
Tokens of base spans are given; messages pass until they settle.  Edge cases: null or empty texts have no spans; spans are code points, end exclusive;
extra columns are ignored by :func:`annotate` and kept by :func:`redact`; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
TRAIN_SENTENCES = 1200
#: Messages pass until none changes by more than this.
SETTLED = 1e-3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses.  Each match is anchored at its @, so long runs cost their length once."""
    out, free, sign = [], 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, sign + 1) if start < sign else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = sign + 1
        sign = text.find("@", sign + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = emails(text) if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _only(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only(m[0])) <= 15] if "+" in text else []
    return out


# ---- the graph: nodes are tokens that may be personal data

_PUNCT = ".,;:!?\"'()[]{}<>|*$&%#"
_CUES = {  # fixed values: words that announce personal data
    "email": 1, "e-mail": 1, "mail": 1, "address": 1, "contact": 1, "write": 1,
    "ip": 2, "host": 2, "server": 2, "client": 2,
    "card": 3, "visa": 3, "mastercard": 3, "credit": 3, "payment": 3,
    "phone": 4, "tel": 4, "telephone": 4, "call": 4, "mobile": 4, "fax": 4, "cell": 4,
}
#: A phone number with its area and without its country.
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])")
N_FEATURES = 29


def _shape(token: str, cue: int, base: int, local: bool, forms: int) -> np.ndarray:
    """Features of a token: local if it is the local part of an address in the text, forms how often the national number that it is part of occurs."""
    x = np.zeros(N_FEATURES, np.float32)
    core = token.strip(_PUNCT)
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    groups = core.split(".")
    x[0] = 1
    x[1] = "@" in core
    x[2] = digits > 0 and letters == 0
    x[3] = digits > 0 and letters > 0
    x[4 + min(digits, 12) // 3] = 1  # 4..8
    x[9] = token.startswith("+")
    x[10] = token.startswith("(") and ")" in token
    x[11] = re.fullmatch(r"[0-9]{3,4}-[0-9]{3,4}(-[0-9]{3,4})?", core) is not None
    x[12] = len(groups) == 4 and all(g.isdecimal() and g.isascii() and len(g) < 4 and int(g) < 256 for g in groups)
    x[13] = re.fullmatch(r"[0-9]{4}", core) is not None
    x[14] = digits >= 13 and luhn(_only(core))
    x[15] = re.fullmatch(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}", core) is not None
    if cue:
        x[15 + cue] = 1  # 16..19
    x[20] = base == 0
    if base:
        x[20 + base] = 1  # 21..24
    x[25] = digits == 0 and "@" not in core
    x[26], x[27], x[28] = local, forms > 0, forms > 1
    return x


class Graph:
    """Tokens of one or more texts as one disjoint graph."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []  # text number, start, end
        self.features: list[np.ndarray] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.base: list[int] = []

    def add(self, number: int, text: str, base: list[Span]) -> None:
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        locals_ = {text[s:e].split("@")[0].lower() for k, s, e in base if k == "email"}
        heads = frozenset(locals_)
        numbers = [(*f.span(), _only(f[0])) for f in _NATIONAL.finditer(text)]
        often = Counter(digits for _, _, digits in numbers)
        locals_ = {x for x in locals_ if len(x) >= 5 and any(c in "0123456789._" for c in x)}
        marks = sorted((s, e, 1 + KINDS.index(k)) for k, s, e in base)
        seen: dict[str, int] = {}
        keyed: list[tuple[str, int]] = []
        certain: dict[str, dict[int, int]] = {}  # the first node of each kind of base span, by key
        links: set[tuple[int, int]] = set()
        before, m, f = -2, 0, 0
        for i, (s, e) in enumerate(tokens):
            token = text[s:e]
            core = token.strip(_PUNCT).lower()
            if core not in locals_ and "@" not in token and not _DIGITS.search(token):
                continue
            while m < len(marks) and marks[m][1] <= s:
                m += 1
            own = next((k for a, b, k in marks[m : m + 4] if a < e and s < b), 0)
            while f < len(numbers) and numbers[f][1] <= s:
                f += 1
            forms = often[numbers[f][2]] if f < len(numbers) and numbers[f][0] < e else 0
            cue = 0
            for a, b in reversed(tokens[max(0, i - 3) : i]):
                cue = cue or _CUES.get(text[a:b].strip(_PUNCT).lower(), 0)
            node = len(self.spans)
            self.spans.append((number, s, e))
            self.features.append(_shape(token, cue, own, core in heads, forms))
            self.base.append(own)
            if before == i - 1:
                self.chain.append((node - 1, node))
            before = i
            digits = _only(core)
            keys = {core, core.split("@")[0] if "@" in core else core}
            if len(digits) >= 7:
                keys.add(digits[-7:])
            for key in keys:
                if len(key) >= 3:
                    if key in seen:
                        self.skip.append((seen[key], node))
                        links.add((seen[key], node))
                    seen[key] = node
                    keyed.append((key, node))
                    if own:
                        certain.setdefault(key, {}).setdefault(own, node)
        for key, node in keyed:
            for sure in certain.get(key, {}).values() if not self.base[node] else ():
                link = (min(sure, node), max(sure, node))
                if link not in links:
                    links.add(link)
                    self.skip.append(link)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = lambda e: np.array(e, np.int64).reshape(-1, 2)
        return np.array(self.features, np.float32).reshape(-1, N_FEATURES), edges(self.chain), edges(self.skip)


# ---- the model

def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(graph: Graph, labels: np.ndarray, epochs: int = 400, rate: float = 4.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pseudo-likelihood: each label given the token and the true labels of its chain and skip neighbours.

    Half of the neighbours outside base spans are hidden, as none of them is known when messages start: else
    repeats would explain each other, and nothing were learnt from what the tokens are.
    """
    x, chain, skip = graph.arrays()
    n, k = len(x), len(LABELS)
    one = np.eye(k, dtype=np.float32)[labels]
    shown = one * ((np.array(graph.base) > 0) | (np.random.default_rng(5).random(n) < 0.5))[:, None]

    def gathered(edges: np.ndarray, forward: bool) -> np.ndarray:
        out = np.zeros((n, k), np.float32)
        a, b = (edges[:, 0], edges[:, 1]) if forward else (edges[:, 1], edges[:, 0])
        np.add.at(out, b, shown[a])
        return out

    left, right = gathered(chain, True), gathered(chain, False)
    near = gathered(skip, True) + gathered(skip, False)
    w, t, s = np.zeros((N_FEATURES, k), np.float32), np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for _ in range(epochs):
        p = one - _softmax(x @ w + left @ t + right @ t.T + near @ s)
        w += rate * (x.T @ p / n - decay * w)
        t += rate * ((left.T @ p + p.T @ right) / n - decay * t)
        g = near.T @ p / n
        s += rate * ((g + g.T) / 2 - decay * s)
    return w, t, s


def marginals(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, chain: np.ndarray, skip: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Beliefs after loopy sum-product message passing with damping, for all nodes of all texts at once.

    given: the label of each node that is known, and 0 of others.  A round works on the messages that still move, or
    whose source has changed; only where they never settle do rounds end, at a bound above the length of any path.
    """
    w, t, s = model
    unary, n = x @ w, len(LABELS)
    known = np.eye(n, dtype=np.float32)[given]
    source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    c, k = len(chain), len(skip)
    opposite = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(k) + 2 * c + k, np.arange(k) + 2 * c])
    pairs = np.exp(np.stack([t, t.T, s, s.T]))
    kind = np.repeat(np.arange(4), [c, c, k, k])
    messages = np.zeros((len(source), n), np.float32)
    total, active, moving = unary.astype(np.float64), np.arange(len(source)), np.zeros(len(source), bool)
    for _ in range(50 + 2 * len(x)):
        if not len(active):
            break
        out = _softmax(total[source[active]] - messages[opposite[active]])
        fixed = given[source[active]] > 0
        out[fixed] = known[source[active][fixed]]
        new = np.log(np.einsum("el,elm->em", out, pairs[kind[active]]) + 1e-12)
        new -= new.max(axis=1, keepdims=True)
        step = ((new - messages[active]) / 2).astype(np.float32)
        messages[active] += step
        np.add.at(total, target[active], step)
        far = np.abs(step).max(axis=1) > SETTLED / 2
        moving[:] = False
        moving[active[far]] = True
        changed = np.zeros(len(x), bool)
        changed[target[active[far]]] = True
        active = np.flatnonzero(moving | changed[source] & (given[source] == 0))
    return np.where(given[:, None] > 0, known, _softmax(total))


# ---- generated training sentences

_PHONE_CUES = tuple(k for k, v in _CUES.items() if v == 4)

def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text and its (start, end, label): full forms, partial repeats of them, and numbers that aren't personal."""
    parts: list[tuple[str, int]] = []
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "st", "re", "in", "ou", "le", "de", "ch")) for _ in range(r.randint(1, 4)))
    words = lambda n: [(word() + r.choice(("", "", "", ",", ".")), 0) for _ in range(n)]
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    for _ in range(r.randint(1, 4)):
        parts += words(r.randint(2, 8))
        kind = r.randint(1, 4) if r.random() < 0.6 else r.randint(5, 7)
        if kind > 4:  # numbers without a country: personal where a word announces them or they are repeated
            area, number = d(3), f"{d(3)}-{d(4)}"
            form = [f"({area})", number] if r.random() < 0.5 else [f"{area}-{number}"]
            if kind == 5:
                parts += [(r.choice(_PHONE_CUES) + r.choice(("", ":")), 0), *(words(1) if r.random() < 0.5 else [])]
            label = 4 if kind < 7 else 0
            parts += [(x, label) for x in form]
            for _ in range(r.randint(1, 3) if kind == 6 else 0):
                parts += [*words(r.randint(1, 6)), *((x, label) for x in form)]
            parts += words(1)
        elif kind == 1:
            local = f"{word()}.{r.randint(1, 99)}"
            parts += [(f"{local}@{word()}{r.randint(1, 9)}.example.{r.choice(('com', 'org', 'net'))}", 1)]
            if r.random() < 0.5:
                parts += [*words(r.randint(1, 6)), (local, 1)]
        elif kind == 2:
            ip = ".".join(str(r.randint(0, 255)) for _ in range(4))
            parts += [(ip, 2)]
            if r.random() < 0.3:
                parts += [*words(3), (ip, 2)]
        elif kind == 3:
            head = d(r.randint(12, 15))
            card = next(head + c for c in "0123456789" if luhn(head + c))
            parts += [(card, 3)]
            if r.random() < 0.3:
                parts += [*words(3), (card, 3)]
        else:
            area, number = f"({d(3)})", f"{d(3)}-{d(4)}"
            parts += [(f"+{r.randint(1, 99)}", 4), (area, 4), (number, 4)]
            if r.random() < 0.5:
                parts += [*words(r.randint(1, 6)), (area, 4), (number, 4)]
        for _ in range(r.randint(0, 4)):  # years, versions, counts, identifiers and words with digits
            n = r.randint(0, 7)
            parts += words(r.randint(1, 3))
            if n == 7:  # an identifier, once or repeated
                token = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 16, 32, 40)))) + "0" if r.random() < 0.5 else word() + d(r.randint(1, 3))
                for _ in range(r.choice((1, 2, 5))):
                    parts += [(token, 0), *words(r.randint(1, 3))]
                continue
            parts += [(str(r.randint(1900, 2030)) if n == 0 else f"{r.randint(0, 9)}.{r.randint(0, 20)}" if n == 1 else d(r.randint(1, 12)) if n == 2 else f"{r.randint(1, 28)}-{r.randint(1, 12)}-{r.randint(1990, 2030)}"
                       if n == 3 else word() + d(r.randint(1, 3)) if n == 4 else f"({d(r.randint(1, 4))})" if n == 5 else f"{d(3)}-{d(4)}", 0)]
    text, marks = "", []
    for token, label in parts:
        marks.append((len(text), len(text) + len(token), label))
        text += token + " "
    return text, marks


@functools.lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, graph, labels = random.Random(5), Graph(), []
    for i in range(TRAIN_SENTENCES):
        text, marks = _sentence(r)
        first = len(graph.spans)
        graph.add(i, text, base_spans(text))
        for _, s, e in graph.spans[first:]:
            labels.append(next(k for a, b, k in marks if a <= s and e <= b))
    return fit(graph, np.array(labels))


# ---- spans

#: A label is taken where its belief is this high, and this high where nothing repeats its tokens.
BELIEF, ALONE = 0.8, 0.95
_ENOUGH = {"email": lambda t: True, "ip": lambda t: t.count(".") == 3, "card": lambda t: 12 <= len(_only(t)) <= 19, "phone": lambda t: 7 <= len(_only(t)) <= 15}


def spans_of(texts: list[str], model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; spans by kind as listed, then start."""
    bases, graph = [base_spans(t) for t in texts], Graph()
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        graph.add(i, text, base)
    added: list[list[Span]] = [[] for _ in texts]
    if graph.spans:
        belief = marginals(model, *graph.arrays(), np.array(graph.base))
        sure = belief.max(axis=1)
        label = np.where(sure >= BELIEF, belief.argmax(axis=1), 0)
        linked = np.zeros(len(label), bool)
        for a, b in graph.skip:
            linked[a] = linked[b] = True
        joined = set(graph.chain)
        node = 0
        while node < len(label):
            last = node
            while last + 1 < len(label) and (last, last + 1) in joined and label[last + 1] == label[node] and not graph.base[last + 1] and not graph.base[node]:
                last += 1
            if label[node] and not graph.base[node] and (linked[node : last + 1].any() or sure[node : last + 1].min() >= ALONE):
                number, start, _ = graph.spans[node]
                end = graph.spans[last][2]
                text, kind = texts[number], LABELS[label[node]]
                start, end = _trim(text, start, end)
                if end > start and _ENOUGH[kind](text[start:end]) and not any(a < end and start < b for k, a, b in bases[number] if k == kind):
                    added[number].append((kind, start, end))
            node = last + 1
    order = lambda x: (KINDS.index(x[0]), x[1], x[2])
    return [(b, sorted({*b, *a}, key=order)) for b, a in zip(bases, added, strict=True)]


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    edge = ".,;:!?\"'[]{}<>|*$&%#"
    while end > start and text[end - 1] in edge:
        end -= 1
    while end > start and text[start] in edge:
        start += 1
    return start, end


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_ASK = at.byte_class([(0x30, 0x39), (0x40, 0x40)])


def _flagged(texts: pa.Array) -> list[int]:
    """Rows with a digit or an @: only these can hold a span."""
    raw, off = at.utf8(texts)
    out: list[int] = []
    for a, b in at.slices(off):
        hits = np.concatenate(([0], np.cumsum(_ASK[raw[off[a] : off[b]]])))
        ends = off[a : b + 1] - off[a]
        out += (a + np.flatnonzero(hits[ends[1:]] > hits[ends[:-1]])).tolist()
    return out


def _found(texts: pa.Array, model) -> Iterator[tuple[int, str, list[Span], list[Span]]]:
    rows = _flagged(texts)
    for at_ in range(0, len(rows), 256):
        some = rows[at_ : at_ + 256]
        values = [texts[i].as_py() for i in some]
        for i, text, (base, every) in zip(some, values, spans_of(values, model), strict=True):
            yield i, text, base, every


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of base spans, and all spans, of each row; map-only."""
    model, empty = trained(), hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = at.strings(batch.column(1))
            n = len(texts)
            counts, digest, spans = np.zeros((len(KINDS), n), np.int64), [empty] * n, [""] * n
            for i, _, base, every in _found(texts, model):
                for k, _, _ in base:
                    counts[KINDS.index(k), i] += 1
                digest[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                                             names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at_ = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a < at_:
            at_ = max(at_, b)
            continue
        out += [text[at_:a], f"[{kind.upper()}]"]
        at_ = b
    return "".join([*out, text[at_:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; nulls stay."""
    model, schema = trained(), docs.schema
    where = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(where)
            values = None
            for i, text, _, every in _found(at.strings(column), model):
                if every:
                    values = column.to_pylist() if values is None else values
                    values[i] = redacted(text, every)
            columns = list(batch.columns)
            if values is not None:
                columns[where] = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
