"""Personal data by patterns and a skip-chain conditional random field.

The patterns give base spans. The field labels tokens that hold a digit or an at sign (no other
token can be personal data here, so their label is fixed and they cut the chain): neighbours in
the text share a chain potential, and repeated or similar tokens anywhere in a document (equal
text, equal digits, equal mailbox name) share a skip potential, from each occurrence to the next.
Tokens of base spans are observed; loopy message passing carries their labels to the others, and
a token that is surely personal data becomes a further span. Base spans always stay.

The potentials are trained on the base spans of all documents by pseudo-likelihood. What a token
contributes depends on its features and its neighbours' labels only, so equal contributions are
counted on Spark and the few distinct ones are fitted on the driver. While fitting, features are
dropped at random, so that the links learn to speak for tokens whose own shape says little.
"""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.workers import arrow_map

KINDS = ["email", "ip", "card", "phone"]
#: A token becomes a span if its label has at least this probability.
SURE = 0.98
#: Prior mean of the skip potential between equal labels: occurrences of one token agree.
AGREE = 3.0
ROUNDS = 10

# ---------------------------------------------------------------------------- patterns

_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_EMAIL_HERE = re.compile(rf"{_LOCAL}++@{_DOMAIN}+(?:\.{_DOMAIN}+)+")
#: From the first character of a run only: any later one would fail at the same at sign.
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_EMAIL_HERE.pattern}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    at = 0
    while True:
        # a match may end inside a run, and the next may begin right there
        found = (at and _EMAIL_HERE.match(text, at)) or _EMAIL.search(text, at)
        if not found:
            return
        yield found.span()
        at = found.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and without overlap within a kind."""
    if not _HINT.search(text):
        return []
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------------------- the field

_EDGE_MARKS = ".,;:!?()[]{}<>\"'"
LABELS = 1 + len(KINDS)  # 0: none
N_FEATURES = 18


class Tokens:
    """Tokens with a digit or an at sign: places, feature bits, labels, and links between them."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.places, self.bits, self.labels, self.observed = [], [], [], []
        self.chain, self.skip = [], []
        by_start = sorted((a, b, k + 1) for k, a, b in spans)
        nearest, end, last, at = {}, 0, -1, 0
        reach, found = [], _HINT.search(text)
        while found:
            start = found.start()
            while start > end and not text[start - 1].isspace():
                start -= 1
            end = found.end()
            while end < len(text) and not text[end].isspace():
                end += 1
            token = text[start:end]
            core = token.strip(_EDGE_MARKS)
            if _HINT.search(core):
                a = start + token.index(core)
                b = a + len(core)
                while at < len(by_start) and by_start[at][0] < b:
                    reach.append(by_start[at])
                    at += 1
                reach = [s for s in reach if s[1] > a]
                label = next((k for x, y, k in reach if x < b), 0)
                i = len(self.places)
                self.places.append((a, b))
                self.bits.append(feature_bits(core))
                self.labels.append(label)
                self.observed.append(label > 0)
                if i and start - last <= 2:
                    self.chain.append((i - 1, i))
                for key in _keys(core):
                    if key in nearest and (nearest[key], i) not in self.skip[-3:]:
                        self.skip.append((nearest[key], i))
                    nearest[key] = i
                last = end
            found = _HINT.search(text, end)


def _keys(core: str) -> list[str]:
    keys, digits = [core.lower()], _digits(core)
    if len(digits) >= 7:
        keys.append("#" + digits)
    if core.find("@") > 0:
        keys.append("@" + core.lower().partition("@")[0])
    return keys


def feature_bits(core: str) -> int:
    digits = _digits(core)
    n, marks = len(digits), len(core) - sum(c.isalnum() for c in core)
    name, at, host = core.partition("@")
    parts = core.split(".")
    tests = [
        True, bool(at and name and host), bool(at and not (name and host)), at != "" and "." in host,
        core[0] == "+", n == 0, 1 <= n <= 3, n == 4, 5 <= n <= 7, 8 <= n <= 15, 16 <= n <= 19, n > 19,
        16 <= n <= 19 and luhn(digits), n == len(core), any(c.isalpha() for c in core),
        len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and p.isascii() and int(p) <= 255 for p in parts),
        "-" in core, marks > 3,
    ]
    return sum(1 << i for i, t in enumerate(tests) if t)


def _unfolded(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(N_FEATURES)) & 1).astype(np.float64)


def contributions(tokens: Tokens) -> list[tuple]:
    """(label, feature bits, label before, label after, skip neighbours by label) of each token; -1: no neighbour."""
    y, n = tokens.labels, len(tokens.labels)
    before, after, skip = [-1] * n, [-1] * n, [[0] * LABELS for _ in range(n)]
    for i, j in tokens.chain:
        after[i], before[j] = y[j], y[i]
    for i, j in tokens.skip:
        skip[i][y[j]] += 1
        skip[j][y[i]] += 1
    return [(y[i], tokens.bits[i], before[i], after[i], *skip[i]) for i in range(n)]


class Potentials:
    """Log-potentials: ``own`` by feature and label, ``chain`` by labels in order, ``skip`` by labels."""

    def __init__(self, own: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.own, self.chain, self.skip = own, chain, skip


def fit_potentials(rows: np.ndarray, steps: int = 400, rate: float = 0.05, dropped: float = 0.3) -> Potentials:
    """Maximum pseudo-likelihood; ``rows``: columns of ``contributions``, then how often.

    A Gaussian prior keeps the skip potentials near agreement where no data speak. Without rows
    only that prior is left, and no token is sure unless a like one was observed.
    """
    own, chain, skip = np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), AGREE * np.eye(LABELS)
    if not len(rows):
        return Potentials(own, chain, skip)
    rows = rows[np.lexsort(rows.T[::-1])]
    y, before, after = rows[:, 0], rows[:, 2], rows[:, 3]
    features, near = _unfolded(rows[:, 1]), rows[:, 4:4 + LABELS].astype(np.float64)
    left, right = (np.eye(LABELS + 1)[v][:, :LABELS] for v in (before, after))  # -1 takes the last row
    weight = rows[:, -1] / rows[:, -1].sum()
    target, rng = np.eye(LABELS)[y], np.random.default_rng(7)
    values, prior = [own, chain, skip], [0.0, 0.0, skip.copy()]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        seen = features * (rng.random(features.shape) >= dropped)
        seen[:, 0] = 1
        x = seen @ own + left @ chain + right @ chain.T + near @ skip
        p = np.exp(x - x.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) * weight[:, None]
        slopes = [seen.T @ error, left.T @ error + error.T @ right, (near.T @ error + error.T @ near) / 2]
        for v, c, s, m, q in zip(values, prior, slopes, mean, square, strict=True):  # Adam
            s = s + 1e-4 * (v - c)
            m[:] = 0.9 * m + 0.1 * s
            q[:] = 0.999 * q + 0.001 * s * s
            v -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.999 ** step)) + 1e-8)
    return Potentials(own, chain, skip)


def marginals(tokens: Tokens, potentials: Potentials, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of each token by damped loopy sum-product; observed labels are fixed."""
    own = _unfolded(np.array(tokens.bits, np.int64)) @ potentials.own
    observed = np.array(tokens.observed, bool)
    fixed = np.where(np.eye(LABELS)[tokens.labels] > 0, 0.0, -1e3)
    own = np.where(observed[:, None], fixed, own)
    links = np.array(tokens.chain + tokens.skip, np.int64).reshape(-1, 2)
    belief = own
    if len(links):
        pair = np.concatenate((np.repeat(potentials.chain[None], len(tokens.chain), 0),
                               np.repeat((potentials.skip + potentials.skip.T)[None] / 2, len(tokens.skip), 0)))
        source, to = np.concatenate((links[:, 0], links[:, 1])), np.concatenate((links[:, 1], links[:, 0]))
        pair = np.concatenate((pair, pair.transpose(0, 2, 1)))  # [message, label at source, label at target]
        back = np.concatenate((np.arange(len(links)) + len(links), np.arange(len(links))))
        message = np.zeros((len(to), LABELS))
        for _ in range(rounds):
            x = (belief[source] - message[back])[:, :, None] + pair
            top = x.max(axis=1)
            new = np.log(np.exp(x - top[:, None]).sum(axis=1)) + top
            new -= new.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
            belief = own.copy()
            np.add.at(belief, to, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], potentials: Potentials, sure: float = SURE) -> list[tuple[int, int, int]]:
    """Spans of tokens that are surely personal data and touch no base span."""
    tokens = Tokens(text, base)
    if all(tokens.observed):
        return []
    p = marginals(tokens, potentials)
    out = []
    for (a, b), observed, x in zip(tokens.places, tokens.observed, p, strict=True):
        kind = int(x.argmax())
        if not observed and kind and x[kind] >= sure:
            out.append((kind - 1, a, b))
    return out


# ---------------------------------------------------------------------------- Spark

_CONTRIBUTION = ["label", "bits", "before", "after", *(f"skip{i}" for i in range(LABELS))]


def _hinted(docs: DataFrame, keep: list) -> DataFrame:
    """Texts without a digit and without an at sign hold nothing to find and need no Python."""
    text = F.col("text").cast("string")
    return docs.select(*keep, F.when(text.rlike("[0-9@]"), text).alias("hinted"))


def _count(batches):
    seen = Counter()
    for batch in batches:
        for x in batch.column("hinted"):
            if text := x.as_py():
                seen.update(contributions(Tokens(text, base_spans(text))))
    rows = np.array([(*k, n) for k, n in seen.items()], np.int64).reshape(-1, len(_CONTRIBUTION) + 1)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], names=[*_CONTRIBUTION, "n"])


def fit(docs: DataFrame) -> Potentials:
    """Potentials from the base spans of all ``docs`` (column ``text``)."""
    counted = arrow_map(_hinted(docs, []).where("hinted is not null"), _count, ", ".join(f"{c} long" for c in [*_CONTRIBUTION, "n"]))
    rows = counted.groupBy(*_CONTRIBUTION).agg(F.sum("n").alias("n")).toPandas()
    return fit_potentials(rows[[*_CONTRIBUTION, "n"]].to_numpy(np.int64))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _find(potentials: Potentials, sure: float):
    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column("hinted"):
                text = x.as_py() or ""
                base = base_spans(text)
                added = added_spans(text, base, potentials, sure) if text else []
                rows.append((
                    *(sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))),
                    hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added),
                ))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return run


def found(docs: DataFrame, potentials: Potentials, sure: float = SURE) -> DataFrame:
    """Spans of personal data in each whole text, as ``kind:start:end`` in code points, end exclusive.

    ``n_email`` and its like count base spans, ``n_added`` the field's. ``spans`` lists all by
    kind, then start. A null text counts as empty. Rows that repeat an id are each searched; an
    empty table gives no row; other columns are ignored.
    """
    rows = _hinted(docs, [F.col("doc_id").cast("long").alias("doc_id")])
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return arrow_map(rows, _find(potentials, sure), f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def mask(text: str, spans) -> str:
    """``text`` with each span replaced by its kind; of spans that overlap, the first names the whole."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _mask_rows(potentials: Potentials, sure: float, text_at: int, length_at: int | None):
    def run(batches):
        for batch in batches:
            texts, changed = batch.column(text_at).to_pylist(), {}
            for i, text in enumerate(texts):
                if text and _HINT.search(text):
                    base = base_spans(text)
                    if spans := base + added_spans(text, base, potentials, sure):
                        changed[i] = texts[i] = mask(text, spans)
            if changed:
                batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))
                if length_at is not None:
                    lengths = batch.column(length_at).to_pylist()
                    for i, text in changed.items():
                        lengths[i] = len(text)
                    field = batch.schema.field(length_at)
                    batch = batch.set_column(length_at, field, pa.array(lengths, field.type))
            yield batch

    return run


def masked(docs: DataFrame, potentials: Potentials, sure: float = SURE) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, such as ``[EMAIL]``.

    All rows and columns stay; where a text changes, a whole-number column ``n_chars`` becomes
    its new length. Null texts stay null.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    length_at = names.index("n_chars") if kinds.get("n_chars") in ("int", "bigint") else None
    return arrow_map(docs, _mask_rows(potentials, sure, names.index("text"), length_at), docs.schema)
