"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans, which always stay. The field reads sequences of words (runs of
non-space) around every word that holds a digit or an ``@``, ``CONTEXT`` words on either side. Its
features are word shapes: letters become ``x``, digit runs a class of their length, other characters
stay. It is trained on a small labelled table (seq, pos, token, label) by maximum likelihood and
decoded by Viterbi for many sequences at once. Runs of one label become a span if the kind's own
check accepts its characters and it meets no other span.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from skyloom.llm.common import by_value, table, texts_of, with_columns

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
CONTEXT = 3
TRAIN_ROWS = 20_000  # bound of the labelled table
BATCH_SEQUENCES = 2048

# Fixed patterns of the base spans. The look-behind and the possessive repeats only save time: a
# match that fails at the start of a run of digits fails at every later digit of it.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
ODD = re.compile("[0-9@]")
WORD = re.compile(r"\S+")
SHAPE_PART = re.compile(r"([0-9]+)|([^\W\d_]+)|(.)", re.S)
EDGE = ".,;:!?\"'<>[]{}"


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: each @ looks back over its local part and forward over its domain."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > low and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = low = domain.end()
            found.append((start, end))
        at = text.find("@", end)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, by start and then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
        found.sort()
    return found


def shape(token: str) -> str:
    """Word shape: letter runs ``x``, digit runs by length (1-4 as they are, 5-8, 9-11, 12-19, more), the rest kept."""
    out = []
    for digits, letters, other in SHAPE_PART.findall(token):
        n = len(digits)
        out.append(
            (str(n) if n < 5 else "5" if n < 9 else "9" if n < 12 else "C" if n < 20 else "L")
            if n
            else ("x" if letters else other)
        )
    return "".join(out)


def shape_features(s: str) -> list[str]:
    """What a shape says: the shape itself and properties that unseen shapes share with seen ones."""
    core = s.strip(EDGE)
    made = [f"s={core[:24]}", f"first={core[:1]}", f"last={core[-1:]}"]
    made += [f"has{c}" for c in "@.-+():/_x" if c in core]
    n = sum(c in "12345" for c in core) + 2 * sum(c in "9CL" for c in core)
    made.append(f"digits={min(n, 6)}")
    made.append(f"dots={min(core.count('.'), 4)}")
    if s != core and s[len(s.rstrip(EDGE)) :]:
        made.append("stop")  # the word ends a clause
    if not any(c in "12345" + "9CL@" for c in core):
        made.append("plain")
    return made


@dataclass
class Field:
    """Weights by (place, feature) for each label, transitions, start and end scores."""

    index: dict[str, int]
    weights: np.ndarray  # 3 places x features x labels
    moves: np.ndarray
    start: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)
    scores: list[np.ndarray] = field(default_factory=list)

    def row(self, s: str) -> int:
        """The number of a shape; its scores at the three places are computed once per task."""
        if s not in self.rows:
            known = [self.index[f] for f in shape_features(s) if f in self.index]
            if len(self.rows) > 50_000:  # memory only: scores are computed again
                self.rows.clear()
                self.scores.clear()
            self.rows[s] = len(self.scores)
            self.scores.append(self.weights[:, known].sum(axis=1))
        return self.rows[s]

    def emissions(self, shapes: list[str]) -> np.ndarray:
        by_place = np.array([self.scores_of(s) for s in shapes])  # n x 3 x labels
        out = by_place[:, 1].copy()
        out[1:] += by_place[:-1, 0]
        out[:-1] += by_place[1:, 2]
        return out

    def scores_of(self, s: str) -> np.ndarray:
        k = self.row(s)
        return self.scores[k]

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each sequence of shapes; sequences of like length go through Viterbi together."""
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(sequences)
        for at in range(0, len(order), BATCH_SEQUENCES):
            part = order[at : at + BATCH_SEQUENCES]
            lengths = np.array([len(sequences[k]) for k in part])
            if not lengths.max(initial=0):
                continue
            scores = np.zeros((len(part), lengths.max(), len(LABELS)))
            for r, k in enumerate(part):
                if sequences[k]:
                    scores[r, : lengths[r]] = self.emissions(sequences[k])
            for r, path in enumerate(viterbi(scores, lengths, self.moves, self.start)):
                out[part[r]] = path[: lengths[r]]
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best paths of padded sequences; of equal scores the lower label wins."""
    n, steps, k = scores.shape
    best = scores[:, 0] + start
    back = np.zeros((steps, n, k), dtype=np.int8)
    for t in range(1, steps):
        reach = best[:, :, None] + moves[None]
        back[t] = reach.argmax(axis=1)
        ahead = np.take_along_axis(reach, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[:, t]
        best = np.where((t < lengths)[:, None], ahead, best)
    path = np.zeros((n, steps), dtype=np.int64)
    now = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        path[inside, t] = now[inside]
        now = np.where(inside, back[t][np.arange(n), now], now)
    return path


def train(labelled: DataFrame, steps: int = 150, rate: float = 0.3, l2: float = 0.02) -> Field:
    """Fit the field on a table of at most ``TRAIN_ROWS`` rows (seq, pos, token, label); more is an error.

    Rows with a null are left out. An empty table gives a field that labels nothing.
    """
    rows = labelled.select("seq", "pos", "token", "label").dropna().limit(TRAIN_ROWS + 1).collect()
    if len(rows) > TRAIN_ROWS:
        raise ValueError(f"the labelled table may have {TRAIN_ROWS} rows at most")
    sequences: dict = {}
    for r in sorted(rows, key=lambda r: (r["seq"], r["pos"])):
        sequences.setdefault(r["seq"], []).append((shape(r["token"]), LABELS.index(r["label"])))
    return fit([s for s in sequences.values() if s], steps, rate, l2)


def fit(sequences: list[list[tuple[str, int]]], steps: int, rate: float, l2: float) -> Field:
    names = sorted({f for s in sequences for x, _ in s for f in shape_features(x)})
    index = {f: k for k, f in enumerate(names)}
    n, long, k = len(sequences), max(map(len, sequences), default=0), len(LABELS)
    sides = 3 * len(names)
    if not n:
        return Field({}, np.zeros((3, 0, k)), np.zeros((k, k)), np.eye(k)[0])
    present = np.zeros((n, long, sides), dtype=np.float32)
    gold = np.zeros((n, long), dtype=np.int64)
    lengths = np.array([len(s) for s in sequences])
    for r, s in enumerate(sequences):
        for t, (x, y) in enumerate(s):
            gold[r, t] = y
            for f in shape_features(x):
                for place, at in ((0, t + 1), (1, t), (2, t - 1)):
                    if 0 <= at < len(s):
                        present[r, at, place * len(names) + index[f]] = 1
    real = np.arange(long)[None] < lengths[:, None]
    flat = present[real]
    weights, moves, start = np.zeros((sides, k)), np.zeros((k, k)), np.zeros(k)
    memory = [np.zeros_like(x) for x in (weights, moves, start)]
    for _ in range(steps):
        scores = np.zeros((n, long, k))
        scores[real] = flat @ weights
        gradients = expected_minus_gold(scores, gold, lengths, real, moves, start)
        node = (flat.T @ gradients[0][real]) / n
        for x, g, m in zip((weights, moves, start), (node, gradients[1] / n, gradients[2] / n), memory):
            g = g + l2 * x / n
            m += g * g
            x -= rate * g / (np.sqrt(m) + 1e-8)
    return Field(index, weights.reshape(3, len(names), k), moves, start)


def expected_minus_gold(scores, gold, lengths, real, moves, start):
    """Gradients of the negative log-likelihood at nodes, moves and starts, by forward and backward sums."""
    n, long, k = scores.shape
    ahead, behind = np.zeros((n, long, k)), np.zeros((n, long, k))

    def total(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    ahead[:, 0] = scores[:, 0] + start
    for t in range(1, long):
        ahead[:, t] = total(ahead[:, t - 1][:, :, None] + moves[None], 1) + scores[:, t]
    for t in range(long - 2, -1, -1):
        step = total(moves[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where((t + 1 < lengths)[:, None], step, 0)
    whole = total(ahead[np.arange(n), lengths - 1], 1)
    nodes = np.exp(ahead + behind - whole[:, None, None]) * real[:, :, None]
    pair = np.zeros((k, k))
    for t in range(1, long):
        joint = ahead[:, t - 1][:, :, None] + moves[None] + (scores[:, t] + behind[:, t])[:, None, :]
        pair += (np.exp(joint - whole[:, None, None]) * real[:, t][:, None, None]).sum(axis=0)
    first = nodes[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=k)
    both = real[:, 1:]
    np.subtract.at(pair, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    nodes[real] -= np.eye(k)[gold[real]]
    return nodes, pair, first


def example_rows(seed: int = 7, sequences: int = 400) -> list[tuple[int, int, str, str]]:
    """A small labelled table written by rule: contacts and numbers in running text."""
    pick = random.Random(seed)

    def some(n):
        return "".join(pick.choice("0123456789") for _ in range(n))

    def word():
        return "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randint(2, 9)))

    def ending(parts):
        return [*parts[:-1], parts[-1] + pick.choice(["", "", "", ",", ".", ";"])]

    forms = {
        "email": [
            lambda: [f"{word()}@{word()}.{word()}"],
            lambda: [f"{word()}.{some(2)}@{word()}{some(1)}.{word()}.com"],
            lambda: [f"{word()}_{word()}@{word()}"],
        ],
        "ip": [lambda: [".".join(str(pick.randint(0, 255)) for _ in range(4))]],
        "card": [
            lambda: [some(16)],
            lambda: [some(4), some(4), some(4), some(4)],
            lambda: ["-".join([some(4)] * 4)],
        ],
        "phone": [
            lambda: [f"+{some(1)}", f"({some(3)})", f"{some(3)}-{some(4)}"],
            lambda: [f"({some(3)})", f"{some(3)}-{some(4)}"],
            lambda: [f"{some(3)}-{some(3)}-{some(4)}"],
            lambda: [f"+{some(2)}", some(3), some(7)],
        ],
        "other": [
            lambda: [some(pick.randint(1, 5))],
            lambda: [f"{some(1)}.{some(1)}"],
            lambda: [f"{some(2)}:{some(2)}"],
            lambda: [f"{some(4)}-{some(2)}-{some(2)}"],
            lambda: [f"{word()}{some(2)}"],
            lambda: [f"{some(2)}%"],
            lambda: [f"@{word()}"],
            lambda: [f"{some(4)}-{some(4)}"],
            lambda: [f"{some(3)},{some(3)}"],
            lambda: [f"v{some(1)}.{some(1)}.{some(1)}"],
            lambda: [f"{word()}{some(3)}{word().upper()}{some(4)}{word()}"],
            lambda: [some(pick.randint(20, 30))],
        ],
    }
    rows = []
    for seq in range(sequences):
        kind = pick.choice(["other", "other", *KINDS])
        parts = [(word(), "other") for _ in range(pick.randint(0, CONTEXT))]
        parts += [(x, kind) for x in ending(pick.choice(forms[kind])())]
        parts += [(x, "other") for x in ending([word() for _ in range(pick.randint(1, CONTEXT))])]
        rows += [(seq, pos, token, label) for pos, (token, label) in enumerate(parts)]
    return rows


# What the characters of a span of each label must be.
ACCEPTS = {
    1: lambda s: "@" in s[1:-1],
    2: lambda s: re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) is not None and is_ip(s),
    3: is_card,
    4: lambda s: 7 <= len(digits_of(s)) <= 15 and re.fullmatch(r"[+ ().0-9-]+", s) is not None,
}


def field_spans(texts: list[str], taken: list[list], model: Field) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) that the field adds to the base spans ``taken`` of each text."""
    sequences, places = [], []
    for k, text in enumerate(texts):
        if not ODD.search(text):
            continue
        spans = [m.span() for m in WORD.finditer(text)]
        odd = [i for i, (a, b) in enumerate(spans) if ODD.search(text, a, b)]
        low = high = 0
        for i in [*odd, None]:
            if i is not None and high and i - CONTEXT <= high:
                high = min(len(spans), i + CONTEXT + 1)
                continue
            if high:
                sequences.append([shape(text[a:b]) for a, b in spans[low:high]])
                places.append((k, spans[low:high]))
            if i is not None:
                low, high = max(0, i - CONTEXT), min(len(spans), i + CONTEXT + 1)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (k, spans), labels in zip(places, model.decode(sequences)):
        changes = np.flatnonzero(np.diff(labels, prepend=-1, append=-1))
        for a, b in zip(changes[:-1], changes[1:]):
            label = int(labels[a])
            if label:
                start, end = spans[a][0], spans[b - 1][1]
                while end > start and texts[k][end - 1] in EDGE:
                    end -= 1
                while start < end and texts[k][start] in EDGE:
                    start += 1
                if ACCEPTS[label](texts[k][start:end]) and all(
                    end <= s or e <= start for s, _, e in taken[k]
                ):
                    found[k].append((start, label - 1, end))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def annotated(docs: DataFrame, model: Field, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_email, n_ip, n_card, n_phone, base_sha256, spans`` to every row; null text is empty.

    Columns of these names are replaced; repeated rows each get their result.
    """
    fields = [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def make():
        def compute(column):
            texts = texts_of(column)
            base = [base_spans(t) for t in texts]
            more = field_spans(texts, base, model)
            counts = [[sum(s[1] == k for s in spans) for spans in base] for k in range(len(KINDS))]
            digests = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
            return [*counts, digests, [written(sorted(a + b)) for a, b in zip(base, more)]]

        return compute

    return with_columns(docs, ["text"], fields, make, keep)


def masked(docs: DataFrame, model: Field) -> DataFrame:
    """All rows and columns, every span in ``text`` replaced by its kind in brackets; null stays null."""

    def make():
        def compute(column):
            texts = texts_of(column)
            base = [base_spans(t) for t in texts]
            out = []
            for value, text, a, b in zip(column.to_pylist(), texts, base, field_spans(texts, base, model)):
                parts, at = [], 0
                for start, kind, end in sorted(a + b):
                    if end > at:
                        if start >= at:
                            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
                        at = end  # overlapping spans share the first one's mark
                out.append(value if value is None else "".join([*parts, text[at:]]))
            return [out]

        return compute

    return with_columns(docs, ["text"], [T.StructField("text", T.StringType())], make).select(*docs.columns)


def trained_on_examples(spark) -> Field:
    return train(spark.createDataFrame(example_rows(), "seq int, pos int, token string, label string"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return annotated(table(spark, sf_dir, "documents"), trained_on_examples(spark), keep=["doc_id"])
