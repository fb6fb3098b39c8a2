"""Personal data in texts: sure formats, and candidates judged by gradient-boosted trees.

Formats that check themselves (e-mail addresses, IP addresses, card numbers by
Luhn's rule, international phone numbers) are always found.  Generators of
high recall propose further spans, overlapping ones included: what has the
form of these formats but fails its check, as a number with one wrong digit
does (``card_like`` and so on), numbers of the form of social security
numbers, local phone numbers, bank accounts, IPv6 addresses, addresses spelled
with (at).  Boosted trees judge each by its format and by the words around it,
never by the check.  A kind's threshold is the least score that keeps the
wanted precision on documents held out of the fit.  Of overlapping candidates
the one of highest score stays.

The trees are fitted to the corpus: its candidates of self-checking formats
are the labelled rows, those that pass their check against those that fail,
at most ``ROWS`` of each kind and label outside the held-out fold.  Thresholds
of these kinds come from all candidates of the fold; with fewer than
``LEAST_HELD`` that pass, nothing is added.  Formats without a check have no
labels in a corpus; for them there are ``EXAMPLES`` seeded examples, made of
the forms and the neighbourhoods in which such numbers do and don't tell of a
person.

Defined results: a null or empty text has no spans; offsets are code points;
repeated rows are searched one by one; an empty table gives no rows; other
columns are carried along, but one of the added column's name is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import append_column, crc_bucket, numbered_columns, slices, small_batches
from gleaner.scratch import materialize

BASE = ("email", "ip", "card", "phone")
LIKE = tuple(f"{k}_like" for k in BASE)
MORE = ("ssn", "local_phone", "iban", "ipv6", "spelled_email")
KINDS = BASE + LIKE + MORE
FAMILIES = BASE + MORE
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())]))

# Bounds of the fit, and the precision that each kind's threshold keeps on seeded examples and on the corpus.
EXAMPLES, ROWS, ROUNDS, LEVELS, RATE, PRECISION, CORPUS_PRECISION = 6000, 2000, 40, 3, 0.3, 0.98, 0.9
#: One of ``FOLDS`` documents is held out of the fit; candidates of a kind in it that must pass; bins of scores and of a feature's values.
FOLDS, LEAST_HELD, BINS, CUTS = 4, 10, 1000, 32

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LABEL = re.compile(r"[A-Za-z0-9-]+")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[(\[]at[)\]]|:[a-fA-F]{1,4}:")
PROPOSE = {
    "ssn": re.compile(r"(?<![0-9])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9])"),
    "local_phone": re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ipv6": re.compile(r"(?<![A-Za-z0-9:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![A-Za-z0-9:])"),
    "spelled_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}"),
}
#: Words of the neighbourhood, by what they speak for.
CUES = {
    "person": {"name", "mr", "mrs", "ms", "dr", "born", "contact", "address", "customer", "patient", "employee", "client"},
    "phone": {"call", "phone", "tel", "telephone", "mobile", "cell", "fax", "text", "dial", "reach", "number", "whatsapp"},
    "identity": {"ssn", "social", "security", "tax", "passport", "identity", "id"},
    "bank": {"iban", "account", "bank", "transfer", "payment", "pay", "wire", "swift", "bic"},
    "mail": {"email", "mail", "write", "contact", "reach", "address"},
    "network": {"host", "server", "client", "login", "connected", "user", "address", "from"},
    "other": {"isbn", "version", "v", "order", "invoice", "part", "serial", "page", "figure", "table", "model", "sku", "ref", "doi", "issue", "chapter", "section", "size", "score"},
}
NEAR = 40
WORD = re.compile(r"[A-Za-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int, bool]]:
    """The matches of a local part, @ and a dotted domain, and those without a dot there, which fail; looking back from each @ keeps the search linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        local = LOCAL.match(text[free:at][::-1])
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            out.append((at - local.end(), domain.end(), True))
        elif local and (name := LABEL.match(text, at + 1)):
            out.append((at - local.end(), name.end(), False))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return out


def ips(text: str) -> list[tuple[int, int, bool]]:
    """Each four dotted numbers from the left; those with a number above 255 fail."""
    out = []
    for run in DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        at, held = run.start(), []
        for number in run[0].split("."):
            held = [*held, (at, number)] if number else []
            if len(held) == 4:
                out.append((held[0][0], at + len(number), all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for _, n in held)))
                held = []
            at += len(number) + 1
    return out


def checked(text: str) -> list[tuple[str, int, int, bool]]:
    """Spans of the form of a base kind, and whether each passes its check."""
    out = [("email", *m) for m in emails(text)] + [("ip", *m) for m in ips(text)]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            out.append(("card", *m.span(), luhn(digits)))
    for m in PHONE.finditer(text):
        out.append(("phone", *m.span(), 9 <= sum(c.isdigit() for c in m[0]) <= 15))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [s[:3] for s in checked(text) if s[3]]


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, pattern in PROPOSE.items() for m in pattern.finditer(text)]


def features(text: str, kind: str, start: int, stop: int) -> list[float]:
    """Format and neighbourhood of a span as numbers."""
    span, before, after = text[start:stop], text[max(0, start - NEAR) : start], text[stop : stop + NEAR]
    digits = [c for c in span if c in "0123456789"]
    numbers = re.findall("[0-9]+", span)
    words = [w.lower() for w in WORD.findall(before)]
    near = set(words[-6:]) | {w.lower() for w in WORD.findall(after)[:2]}
    compact = re.sub("[^A-Z0-9]", "", span) if kind == "iban" else ""
    checked = bool(compact) and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    return [
        FAMILIES.index(kind.removesuffix("_like")), int(digits[0]) if digits else -1, len(span), len(digits), len(numbers), len(set(digits)), span.count("-"), span.count("."), span.count(" "), span.startswith("("),
        before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in "#$€£=/", after[:1] in "%/=", checked, numbers[:1] == ["000"] or numbers[:1] == ["666"] or (bool(numbers) and numbers[0][:1] == "9"),
        *(len(near & cue) for cue in CUES.values()), len(words),
    ]


def examples(n: int = EXAMPLES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of seeded examples: spans among words that speak for a person's data, against it, or neither."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, k))
    cue_of = {"ssn": "identity", "local_phone": "phone", "iban": "bank", "ipv6": "network", "spelled_email": "mail"}

    def iban(valid: bool) -> str:
        country, body = pick(["DE", "FR", "ES", "GB", "NL"]), number(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        return f"{country}{(check if valid else (check + 7) % 97):02d}{body}"

    def form(kind: str, real: bool) -> str:
        if kind == "ssn":
            return f"{number(3) if not real else str(rng.integers(1, 899)).zfill(3)}-{number(2)}-{number(4)}"
        if kind == "local_phone":
            s = pick(["-", ".", " "])
            return pick([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}{s}{number(3)}{s}{number(4)}"] if real else [f"{number(2)}.{number(3)}.{number(3)}", f"{number(4)}-{number(4)}-{number(4)}", f"{number(3)} {number(3)} {number(3)}", f"{number(4)} {number(4)} {number(4)}"])
        if kind == "iban":
            return iban(real)
        if kind == "ipv6":
            return ":".join(f"{int(x):x}" for x in rng.integers(0, 65536, 8))
        return f"{letters(6)} (at) {letters(5)}{pick(['.', ' (dot) '])}{pick(['com', 'org', 'net'])}"

    rows, labels = [], []
    while len(rows) < n:
        kind, real = pick(MORE), bool(rng.random() < 0.5)
        cue = sorted(CUES[cue_of[kind]] | CUES["person"]) if real else sorted(CUES["other"])
        words = [letters(int(rng.integers(2, 9))) for _ in range(6)]
        # self-checking forms are real without a cue; others need one, and cues of other things speak against them
        bare = kind in ("iban", "ipv6", "spelled_email") or (kind == "local_phone" and real and rng.random() < 0.5)
        if not (bare and rng.random() < 0.5):
            words[int(rng.integers(3, 6))] = pick(cue)
        elif not real and kind in ("ipv6", "spelled_email"):
            continue
        text = " ".join(words) + pick([" ", ": ", " is "] if real else [" ", " #", " = ", " no. "]) + form(kind, real)
        text += pick([" ", ". ", ", "]) + letters(4)
        found = [c for c in candidates(text) if c[0] == kind]
        if found:
            rows.append(features(text, *found[0]))
            labels.append(real)
    return np.array(rows, float), np.array(labels, float)


@dataclass
class Trees:
    """Boosted trees of ``LEVELS`` levels, each complete: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    thresholds: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(LEVELS):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += value[node - (2**LEVELS - 1)]
        return 1 / (1 + np.exp(-z))


def _binned(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each feature's values as numbers of bins, and where the bins are cut."""
    cuts = []
    for column in x.T:
        kinds = np.unique(column)
        if len(kinds) > CUTS:
            kinds = np.unique(np.quantile(column, np.linspace(0, 1, CUTS)))
        cuts.append((kinds[1:] + kinds[:-1]) / 2)
    return np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T, strict=True)], 1), cuts


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of ``ROUNDS`` trees; a node splits where the gain is largest."""
    bins, cuts = _binned(x)
    flat = bins + CUTS * np.arange(x.shape[1])
    z, size = np.zeros(len(x)), CUTS * x.shape[1]
    nodes, leaves = 2**LEVELS - 1, 2**LEVELS
    trees = Trees(np.zeros((ROUNDS, nodes), int), np.full((ROUNDS, nodes), np.inf), np.zeros((ROUNDS, leaves)), {})
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        g, h, node = y - p, p * (1 - p), np.zeros(len(x), int)
        for k in range(nodes):
            at = np.flatnonzero(node == k)
            left_g, left_h = (np.cumsum(np.bincount(flat[at].ravel(), np.repeat(v[at], x.shape[1]), size).reshape(-1, CUTS), 1) for v in (g, h))
            all_g, all_h = g[at].sum(), h[at].sum()
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, b] > 1e-9 and b < len(cuts[f]):
                trees.feature[t, k], trees.cut[t, k] = f, cuts[f][b]
            node[at] = 2 * k + 1 + (x[at, trees.feature[t, k]] > trees.cut[t, k])
        leaf = node - nodes
        trees.value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        z += trees.value[t][leaf]
    return trees


def threshold(score: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float) -> float:
    """The least score, 0.5 at least, from which on the share of label 1 is ``precision``; 2 if there is none."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum((y * n)[order]) / np.maximum(np.cumsum(n[order]), 1)
    last = np.r_[score[order][1:] != score[order][:-1], True]  # equal scores stay together
    good = np.flatnonzero((right >= precision) & last)
    return max(0.5, float(score[order][good[-1]])) if len(good) else 2.0


@lru_cache(maxsize=1)
def _examples() -> tuple[np.ndarray, np.ndarray]:
    return examples()


def _with_thresholds(trees: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """``trees`` with the thresholds of kinds without a check, from the seeded examples ``x, y`` that the fit hasn't seen."""
    score = trees.scores(x)
    for kind in MORE:
        at = x[:, 0] == FAMILIES.index(kind)
        trees.thresholds[kind] = threshold(score[at], y[at], np.ones(at.sum()), PRECISION)
    for kind in LIKE:
        trees.thresholds.setdefault(kind, 2.0)
    return trees


@lru_cache(maxsize=1)
def fitted() -> Trees:
    """Trees of the seeded examples alone: they add no span of a form that has a check."""
    x, y = _examples()
    n = len(x) * 2 // 3
    return _with_thresholds(boost(x[:n], y[:n]), x[n:], y[n:])


def labelled(docs: DataFrame) -> DataFrame:
    """``held, kind, passed, features`` of each candidate with a check in the whole texts of ``docs(doc_id, text)``."""
    schema = pa.schema([("held", pa.bool_()), ("kind", pa.string()), ("passed", pa.bool_()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [
                    {"held": held, "kind": kind, "passed": ok, "features": [float(v) for v in features(t, kind, a, b)]}
                    for t, held in zip(part.column("text").to_pylist(), part.column("held").to_pylist(), strict=True)
                    if t and ANY.search(t)
                    for kind, a, b, ok in checked(t)
                ]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    small_batches(docs.sparkSession)
    return docs.select("text", (crc_bucket("doc_id", FOLDS) == 0).alias("held")).mapInArrow(run, "held boolean, kind string, passed boolean, features array<double>")


def fit(docs: DataFrame) -> Trees:
    """Trees fitted to the candidates of ``docs(doc_id, text)`` and to the seeded examples, with calibrated thresholds."""
    rows = materialize(labelled(docs), "candidates")
    order = [F.xxhash64("features"), F.col("features")]
    sample = reduce(DataFrame.unionByName, (rows.where((F.col("kind") == k) & (F.col("passed") == ok) & ~F.col("held")).orderBy(*order).limit(ROWS) for k in BASE for ok in (True, False)))
    got = sample.select("passed", "features").toPandas()  # at most 8 * ROWS rows
    x, y = _examples()
    n = len(x) * 2 // 3
    if not len(got):
        return fitted()
    trees = boost(np.concatenate([x[:n], np.stack(got["features"].to_list())]), np.r_[y[:n], got["passed"].to_numpy(np.float64)])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                bins = (trees.scores(np.stack(frame["features"].to_list())) * BINS).astype(np.int64)
                yield pd.DataFrame({"kind": frame["kind"], "passed": frame["passed"], "bin": bins})

    held = rows.where("held").mapInPandas(score, "kind string, passed boolean, bin long").groupBy("kind", "passed", "bin").count().toPandas()  # at most 8 * BINS rows
    for kind, cells in held.groupby("kind"):
        if cells.loc[cells["passed"], "count"].sum() >= LEAST_HELD:
            trees.thresholds[f"{kind}_like"] = threshold(cells["bin"].to_numpy() / BINS, cells["passed"].to_numpy(np.float64), cells["count"].to_numpy(), CORPUS_PRECISION)
    return _with_thresholds(trees, x[n:], y[n:])


class Taken:
    """Disjoint spans in order, to ask whether another one meets any of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.stops = [], []
        for a, b in sorted(spans):
            if self.stops and a < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], b)
            else:
                self.starts.append(a)
                self.stops.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return (i > 0 and self.stops[i - 1] > a) or (i < len(self.starts) and self.starts[i] < b)

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.stops.insert(i, b)


def find(text: str, trees: Trees) -> list[tuple[str, int, int, float]]:
    """All spans of a text: the sure ones and the chosen candidates, in the order of ``KINDS``, then by start."""
    if not ANY.search(text):
        return []
    sure = checked(text)
    base = [c[:3] for c in sure if c[3]]
    taken = Taken([s[1:] for s in base])
    like = [(f"{k}_like", a, b) for k, a, b, ok in sure if not ok and trees.thresholds[f"{k}_like"] <= 1]
    proposed = [c for c in [*like, *candidates(text)] if not taken.meets(*c[1:])]
    chosen: list[tuple[str, int, int, float]] = []
    if proposed:
        score = trees.scores(np.array([features(text, *c) for c in proposed], float))
        for s, c in sorted(zip(score.tolist(), proposed, strict=True), key=lambda x: (-x[0], x[1][1:])):
            if s >= trees.thresholds[c[0]] and not taken.meets(*c[1:]):
                chosen.append((*c, s))
                taken.add(*c[1:])
    return sorted([*((*b, 1.0) for b in base), *chosen], key=lambda s: (KINDS.index(s[0]), s[1]))


def find_spans(docs: DataFrame, trees: Trees, out: str = "_spans", drop: bool = False) -> DataFrame:
    """``docs`` with the array ``out`` of ``kind, start, stop, score`` of each whole ``text``; ``drop`` leaves the text out."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(part: pa.RecordBatch) -> pa.Array:
        found = [find(t, trees) if t else [] for t in part.column("text").to_pylist()]
        return pa.array([[{"kind": k, "start": a, "stop": b, "score": s} for k, a, b, s in spans] for spans in found], kind)

    return append_column(docs, out, SPANS, "text", run, drop)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kinds(kinds: tuple[str, ...], spans: str = "_spans") -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with every span of the text, overlapping ones together, replaced by the kind of the first, such as ``<EMAIL>``."""

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for kind, a, b, _ in sorted(find(text, trees), key=lambda s: (s[1], s[2])) if text else []:
            if a >= at:
                out += [text[at:a], f"<{kind.removesuffix('_like').upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    plain, place = numbered_columns(docs, docs.columns)
    marked = append_column(plain, "redacted", T.StringType(), place["text"], lambda part: pa.array([clean(t) for t in part.column(place["text"]).to_pylist()], pa.string()), drop=True)
    return marked.select(*[F.col("redacted" if c == "text" else place[c]).alias(c) for c in docs.columns])
