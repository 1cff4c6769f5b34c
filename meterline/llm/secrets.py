"""Secret scan: base patterns, and a linear-chain conditional random field for what they miss.

The field tags the white-space tokens of a text as begin, inside or outside of
a secret. A token is seen through its class, the set of its shape features; the
score of a tag adds weights of the classes of the token and of two neighbours on
either side and of features of the whole file. Viterbi decodes every text
whole: where the outside tag leads by more than all transitions could win back,
it is on the best path, so only the stretches between such tokens need the
recursion.

Training labels are the base matches in a bounded sample of documents, repeated
with other random values and other names for the field, so that shape and
neighbours are learned rather than the patterns themselves.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.frames import parts, pick, relabelled, spared

# The base patterns, their least lengths and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
CREDENTIAL = re.compile(r"pass(word|wd|phrase)?$|pwd$|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|bearer|auth$", re.I)
NAMES = ("password", "passwd", "pwd", "secret", "client_secret", "token", "api_key", "private_key", "access_key", "credential", "auth", "bearer")
PREFIXES = ("AKIA", "ghp_", "sk-", "xox", "eyJ", "AIza")
TOKEN = re.compile(r"\S+")
CORE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
ADDRESS = re.compile(r"[\w.+-]+@[\w-]+(\.[\w-]+)+")
SAMPLE_DOCS = 6_000
SPAN = 8
PLAIN_WINDOWS = 2_500
SECRET_WINDOWS = 300
VARIANTS = 5
CACHE_WORDS = 500_000
TAGS = 3  # outside, begin, inside
REACH = (-2, -1, 0, 1, 2)
FILE_FEATURES = 4


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Start and end of the base matches of each kind, leftmost and without overlap; the span is the whole match."""
    low = text.lower()
    found: dict[str, list[tuple[int, int]]] = {"assign": [], "access": [], "hex": []}
    if any(word in low for word in WORDS):
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if LONG_HEX.search(text):
        found["hex"] = [m.span() for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return found


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    order = sorted((start, KINDS.index(kind), end) for kind, places in spans.items() for start, end in places)
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in order)


def shape(token: str) -> tuple[str, ...]:
    """Shape features of a token."""
    core = token.strip("\"'`,;.()[]{}<>")
    if core.isalpha():
        named = ("credential",) if CREDENTIAL.search(core) else ()
        case = "lower" if core.islower() else "upper" if core.isupper() else "title"
        return ("alpha", f"alpha{min(4, len(core) // 6)}", case, *named, *(("quoted",) if token[0] in "\"'" else ()))
    n = len(core)
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    features = [
        f"length{0 if n < 4 else 1 if n < 8 else 2 if n < 12 else 3 if n < 16 else 4 if n < 24 else 5 if n < 40 else 6}",
        f"digits{math.ceil(4 * digits / max(1, n))}",
        f"letters{math.ceil(4 * letters / max(1, n))}",
    ]
    if core and not letters and not digits:
        features.append("marks")
    if core.isdigit():
        features.append("number")
    if letters and digits:
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
        features.append(f"turns{min(4, turns // 2)}")
    if any(c.islower() for c in core) and any(c.isupper() for c in core[1:]):
        features.append("mixed_case")
    counts = Counter(core)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0
    features.append(f"entropy{min(5, int(entropy))}")
    if n >= 8 and all(c in "0123456789abcdef" for c in core):
        features.append("hex")
    if core.startswith(PREFIXES):
        features.append("known_prefix")
    if "://" in core or ADDRESS.fullmatch(core):
        features.append("address")
    if token[:1] in "\"'" and token[-1:] in "\"',;":
        features.append("quoted")
    if token in ("=", ":", ":=", "=>", "==", "->"):
        features.append("sets")
    name, sign, value = core.partition("=") if "=" in core else core.partition(":")
    if sign:
        features.append("has_sign" if value else "ends_sign")
        if CREDENTIAL.search(name.strip("\"'")):
            features.append("credential" if not value else "credential_value")
    return tuple(features)


class Classes:
    """Numbers of the distinct shapes; class 0 is the edge of a text."""

    def __init__(self) -> None:
        self.features: dict[str, int] = {"edge": 0}
        self.shapes: dict[tuple, int] = {("edge",): 0}
        self.rows: list[list[int]] = [[0]]
        self.known: dict[str, int] = {}

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        get = self.known.get
        found = list(map(get, tokens))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.learn(tokens[i])
        return np.array(found, np.int64)

    def learn(self, token: str) -> int:
        seen = shape(token)
        number = self.shapes.get(seen)
        if number is None:
            number = self.shapes[seen] = len(self.rows)
            self.rows.append([self.features.setdefault(name, len(self.features)) for name in seen])
        self.known[token] = number
        return number


class Field(NamedTuple):
    features: dict[str, int]
    weights: np.ndarray  # position in REACH x feature x tag
    file: np.ndarray  # file feature x tag
    transitions: np.ndarray  # from tag x to tag


def file_features(n_tokens: int, text: str) -> np.ndarray:
    """A constant, the length, and the density of code marks and of line breaks."""
    marks = sum(text.count(c) for c in "{};=")
    return np.array([1.0, min(1.0, math.log1p(n_tokens) / 8), min(1.0, 10 * marks / max(1, n_tokens)), min(1.0, 10 * text.count("\n") / max(1, n_tokens))])


class Tagger:
    """Decodes whole texts with a trained field."""

    def __init__(self, field: Field):
        self.field = field
        self.classes = Classes()
        self.table = np.zeros((0, len(REACH), 2))
        spread = field.transitions - field.transitions[0, 0]
        self.most = 2 * max(0.0, float(spread.max() - min(0.0, spread.min()))) + 1e-6

    def scores(self, classes: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Lead of begin and of inside over outside, for each token."""
        if len(self.table) < len(self.classes.rows):
            rows = []
            for numbers in self.classes.rows[len(self.table) :]:
                names = list(self.classes.features)
                known = [self.field.features[names[k]] for k in numbers if names[k] in self.field.features]
                rows.append(self.field.weights[:, known].sum(axis=1))
            new = np.array(rows)
            self.table = np.concatenate([self.table, new[:, :, 1:] - new[:, :, :1]])
        file = features @ self.field.file
        padded = np.concatenate([[0, 0], classes, [0, 0]])
        n = len(classes)
        lead = np.tile(file[1:] - file[0], (n, 1))
        for k in range(len(REACH)):
            lead += self.table[padded[k : k + n], k]
        return lead

    def tags(self, text: str, tokens: list[str]) -> list[tuple[int, int]]:
        """First token and end of each secret."""
        lead = self.scores(self.classes.of(tokens), file_features(len(tokens), text))
        open_at = np.flatnonzero(lead.max(axis=1) > -self.most)
        if not len(open_at):
            return []
        found: list[tuple[int, int]] = []
        breaks = np.flatnonzero(np.diff(open_at) > 1)
        for first, last in zip([0, *(breaks + 1)], [*breaks, len(open_at) - 1], strict=True):
            start = int(open_at[first])
            path = viterbi(lead[start : int(open_at[last]) + 1], self.field.transitions)
            at = None
            for k, tag in enumerate([*path, 0]):
                if at is not None and tag != 2:
                    found.append((at, start + k))
                    at = None
                if tag == 1 or (tag == 2 and at is None):
                    at = start + k
        return found


def viterbi(lead: np.ndarray, transitions: np.ndarray) -> list[int]:
    """Best tags of a stretch that is preceded and followed by outside tags."""
    best = transitions[0] + np.concatenate([[0.0], lead[0]])
    back = []
    for row in lead[1:]:
        ways = best[:, None] + transitions
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + np.concatenate([[0.0], row])
    tag = int((best + transitions[:, 0]).argmax())
    path = [tag]
    for choice in reversed(back):
        tag = int(choice[tag])
        path.append(tag)
    return path[::-1]


def scan(text: str, tagger: Tagger) -> dict[str, list[tuple[int, int]]]:
    """Base spans and the spans that the field adds where no base span lies."""
    found: dict[str, list[tuple[int, int]]] = base_spans(text)
    found["crf"] = []
    tokens = text.split()
    runs = tagger.tags(text, tokens) if tokens else []
    if runs:
        places = [m.span() for m in TOKEN.finditer(text)]
        taken = [span for spans in found.values() for span in spans]
        for first, end in runs:
            left, right = places[first][0], places[end - 1][1]
            inner = text[left:right]
            core = max(CORE.finditer(inner), key=lambda m: len(m[0]), default=None) if end - first == 1 else None
            span = (left + core.start(), left + core.end()) if core else (left, right)
            if all(span[1] <= a or span[0] >= b for a, b in taken):
                found["crf"].append(span)
    return found


def training_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Token windows with tags from about `sample_docs` documents, those with the smallest hashes of their id.

    Every base match gives a window, and up to three tokens with digits outside
    of matches and one random place give windows without a secret.
    """
    narrow = pick(docs, "doc_id", "text").filter("text is not null")
    share = min(1.0, sample_docs / max(1, narrow.count()))
    drawn = narrow.filter(F.shiftrightunsigned(F.xxhash64(F.lit(19), "doc_id"), 32) < int(share * 2**32))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, tags, files = [], [], []
            for text in batch.column("text").to_pylist():
                places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
                if not places:
                    continue
                tokens = text.split()
                starts = [a for a, _ in places]
                marks = [0] * len(tokens)
                centres = []
                for kind, spans in base_spans(text).items():
                    for a, b in spans:
                        if kind == "assign":
                            a = ASSIGN.match(text, a).start(2)
                        k = max(0, int(np.searchsorted(starts, a, side="right")) - 1)
                        centres.append(k)
                        marks[k] = 1
                        while k + 1 < len(starts) and starts[k + 1] < b:
                            k += 1
                            marks[k] = 2
                shifting = random.Random(len(text))
                loose = [i for i, token in enumerate(tokens) if not marks[i] and any(c.isdigit() for c in token)]
                centres += shifting.sample(loose, min(3, len(loose))) + [shifting.randrange(len(tokens))]
                feature = file_features(len(tokens), text).tolist()
                for k in centres[:64]:
                    windows.append(tokens[max(0, k - SPAN) : k + SPAN + 1])
                    tags.append(marks[max(0, k - SPAN) : k + SPAN + 1])
                    files.append(feature)
            kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64())]
            columns = [pa.array(c, k) for c, k in zip((windows, tags, files), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["tokens", "tags", "file"])

    return drawn.select("text").mapInArrow(cut, "tokens array<string>, tags array<long>, file array<double>")


def random_value(chance: random.Random) -> str:
    letters, digits = string.ascii_letters, string.digits
    kind = chance.randrange(5)
    alphabet = ("0123456789abcdef", letters + digits, letters + digits + "+/", letters + digits + "!@#$%^&*-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")[kind]
    prefix = chance.choice(["", "", "", "ghp_", "sk-", "xoxb-"]) if kind == 1 else ""
    return prefix + "".join(chance.choice(alphabet) for _ in range(chance.randint(12, 48)))


def varied(tokens: list[str], tags: list[int], chance: random.Random) -> tuple[list[str], list[int]]:
    """The window with another value for each secret and another way to write the field it is set to."""
    out: list[str] = []
    marks: list[int] = []
    for token, tag in zip(tokens, tags, strict=True):
        if not tag:
            out.append(token)
            marks.append(0)
            continue
        value = random_value(chance)
        name = next((k for k in range(max(0, len(out) - 2), len(out)) if CREDENTIAL.search(out[k].strip("\"':="))), None)
        if name is None:
            out.append(token.replace(max(CORE.findall(token), key=len, default=token), value) if "=" in token else value)
            marks.append(tag)
            continue
        del out[name:], marks[name:]
        field, quote = chance.choice(NAMES), chance.choice(["", '"', "'"])
        written = quote + value + quote
        form = chance.choice([[field, "=", written], [field, ":", written], [f"{field}:", written], [f"{field}=", written], [f"{field}={written}"], [f"{field}:{written}"]])
        out += form
        marks += [0] * (len(form) - 1) + [1]
    return out[: 2 * SPAN + 1], marks[: 2 * SPAN + 1]


def fit_field(windows: list[tuple[list[str], list[int], list[float]]], rounds: int = 120, ridge: float = 2e-4, seed: int = 23) -> Field:
    """Conditional log likelihood by Adam over all windows at once; without windows, a field that tags nothing."""
    chance = random.Random(seed)
    windows = sorted(windows)
    plain = [w for w in windows if not any(w[1])]
    secret = [w for w in windows if any(w[1])]
    if not secret:
        return Field({}, np.zeros((len(REACH), 0, TAGS)), np.array([[20.0, 0.0, 0.0]] + [[0.0] * TAGS] * (FILE_FEATURES - 1)), np.zeros((TAGS, TAGS)))
    plain = chance.sample(plain, min(len(plain), PLAIN_WINDOWS))
    secret = chance.sample(secret, min(len(secret), SECRET_WINDOWS))
    data = plain + secret + [(*varied(t, g, chance), f) for t, g, f in secret for _ in range(VARIANTS)]
    classes = Classes()
    longest = 2 * SPAN + 1
    grid = np.zeros((len(data), longest + 4), np.int64)
    gold = np.zeros((len(data), longest), np.int64)
    length = np.array([len(t) for t, _, _ in data])
    for i, (tokens, tags, _) in enumerate(data):
        grid[i, 2 : 2 + len(tokens)] = classes.of(tokens)
        gold[i, : len(tags)] = tags
    files = np.array([f for _, _, f in data])
    n_features, n_classes = len(classes.features), len(classes.rows)
    incidence = np.zeros((n_classes, n_features))
    for number, row in enumerate(classes.rows):
        incidence[number, row] = 1
    inside = np.arange(longest) < length[:, None]
    weights = np.zeros((len(REACH), n_features, TAGS))
    file, transitions = np.zeros((FILE_FEATURES, TAGS)), np.zeros((TAGS, TAGS))
    parts = [weights, file, transitions]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    gold_hot = np.eye(TAGS)[gold] * inside[:, :, None]
    pairs = (inside[:, 1:] & inside[:, :-1])[:, :, None, None]
    gold_pairs = (np.eye(TAGS)[gold[:, :-1], :, None] * np.eye(TAGS)[gold[:, 1:], None, :] * pairs).sum(axis=(0, 1))
    for step in range(1, rounds + 1):
        scores = np.repeat((files @ file)[:, None, :], longest, axis=1)
        for k in range(len(REACH)):
            scores += (incidence @ weights[k])[grid[:, k : k + longest]]
        scores *= inside[:, :, None]
        forward = np.empty_like(scores)
        backward = np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        log_sum = lambda x, axis: (top := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))
        for t in range(1, longest):
            on = inside[:, t, None]
            forward[:, t] = np.where(on, scores[:, t] + log_sum(forward[:, t - 1, :, None] + transitions, 1), forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            on = inside[:, t + 1, None]
            after = log_sum(transitions + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(on, after, backward[:, t + 1])
        total = log_sum(forward[:, -1], 1)
        marginal = np.exp(np.clip(forward + backward - total[:, None, None], -700, 0)) * inside[:, :, None]
        edge = forward[:, :-1, :, None] + transitions + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        joint = (np.exp(np.clip(edge, -700, 0)) * pairs).sum(axis=(0, 1))
        miss = marginal - gold_hot
        d_weights = np.empty_like(weights)
        for k in range(len(REACH)):
            by_class = np.stack(
                [np.bincount(grid[:, k : k + longest].ravel(), miss[:, :, tag].ravel(), n_classes) for tag in range(TAGS)], axis=1
            )
            d_weights[k] = incidence.T @ by_class
        grads = [d_weights, files.T @ miss.sum(axis=1), joint - gold_pairs]
        for part, grad, (mean, square) in zip(parts, grads, moments, strict=True):
            grad = grad / len(data) + ridge * part
            mean *= 0.9
            mean += 0.1 * grad
            square *= 0.99
            square += 0.01 * grad * grad
            part -= 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(classes.features, weights, file, transitions)


def learn_field(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Train on the driver from windows of a bounded sample."""
    rows = training_windows(docs, sample_docs).collect()
    return fit_field([(list(row["tokens"]), list(row["tags"]), list(row["file"])) for row in rows])


def secret_report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_crf of every document.

    Spans are kind:start:end in code points, end exclusive, of whole matches.
    A null text counts as empty; null ids and repeated rows are kept; an empty
    table gives no rows; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn_field(docs) if field is None else field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in parts(spared(batches)):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = scan(text, tagger)
                base = listed({kind: spans for kind, spans in found.items() if kind != "crf"})
                counts = [len(found[kind]) for kind in ("assign", "access", "hex")]
                rows.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), listed(found), len(found["crf"])))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    narrow = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def blot(text: str, found: dict[str, list[tuple[int, int]]], mark: str = "[SECRET]") -> str:
    """The text with its secrets replaced; an assignment keeps the name of its field."""
    spans = sorted(
        (ASSIGN.match(text, a).start(2) if kind == "assign" else a, b) for kind, places in found.items() for a, b in places
    )
    out, at = [], 0
    for a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """`docs` with every secret replaced in its text and n_chars counted again; all rows and columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_field(docs) if field is None else field)
    plain, place = relabelled(docs)
    label = place["text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in parts(spared(batches)):
            old = batch.column(label).to_pylist()
            new = [None if text is None else blot(text, scan(text, tagger)) for text in old]
            at = batch.schema.get_field_index(label)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    cleaned = plain.mapInArrow(run, plain.schema)
    if "n_chars" in place:
        kind = plain.schema[place["n_chars"]].dataType
        cleaned = cleaned.withColumn(place["n_chars"], F.char_length(label).cast(kind))
    return cleaned.toDF(*docs.columns)
