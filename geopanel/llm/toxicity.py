"""Toxicity by a string-kernel support vector machine over Nyström landmarks.

Two words are compared by the subsequences of three characters that they share, gaps allowed and discounted by their length,
so an insult stays close to itself when it is bent, stretched or has characters put between its own. Landmarks are words
picked on the training rows by how much more often toxic texts hold them, plus frequent words of other texts. A text is
described by its closest word for each landmark (runs of one-letter words count as one word too), that description is mapped by the inverse root of the landmarks' own kernel
matrix (Nyström), and a linear support vector machine with a logistic calibration gives the score.

Words recur, so each worker keeps what it has computed for those it met. Training uses a bounded sample of labelled rows
(``Settings.sample``, taken by a hash of the identifier); scoring covers every word of every text.

Defined results: null text counts as empty and gets the score of a text without words; rows with null or repeated identifiers
are scored like any other, one result each; without labelled rows of both kinds every score is 0; an empty table gives an
empty result. Of several labels for one identifier a toxic one counts.
"""

from __future__ import annotations

import dataclasses
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopanel.llm.common import once_per_worker, texts
from geopanel.session import materialised

_SPELLED = regex.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)").findall
#: Marks at the ends of a word that say nothing about it.
_EDGES = ".,;:!?\"'()[]{}…«»„“”*#$%&"
#: Character classes: 26 letters (accents dropped), 10 digits, word start, and 27 for all others by code point.
_START, _CLASSES = 36, 64
_BEFORE = 32


@dataclasses.dataclass(frozen=True)
class Settings:
    """``sample`` labelled rows at most are fitted; ``landmarks`` words are compared with, chosen from ``candidates`` with a log-likelihood ratio of at
    least ``evidence`` so that no two are closer than ``apart``; a gap costs ``decay`` for each character and a subsequence spans ``reach`` of them at most; words are
    compared in overlapping stretches of ``stretch`` characters; ``sharpness`` is the exponent of the kernel; ``penalty`` weighs
    margins and ``threshold`` makes the prediction."""

    sample: int = 20_000
    landmarks: int = 96
    candidates: int = 3_000
    apart: float = 0.65
    evidence: float = 10.0
    decay: float = 0.6
    reach: int = 5
    stretch: int = 8
    sharpness: float = 8.0
    penalty: float = 30.0
    threshold: float = 0.3


def _class_of(cp: int) -> int:
    base = unicodedata.normalize("NFKD", chr(cp).lower())[:1]
    if "a" <= base <= "z":
        return ord(base) - ord("a")
    return 26 + int(base) if "0" <= base <= "9" else 37 + cp % 27


_TABLE = np.array([_class_of(cp) for cp in range(0x250)], np.int64)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def words_of(text: str) -> set[str]:
    """The distinct words of a text, and its runs of one-letter words put together."""
    found = set(text.split())
    if sum([len(w) == 1 for w in found]) > 2:
        found.update(["".join(x.split()) for x in _SPELLED(text)])
    return found


def subsequences(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence, weight) of all words at once, the weights of a word having length one. A subsequence is three
    characters in order, the blank before a word counting as one; each character skipped costs ``decay``."""
    size = np.array([len(w) for w in words], np.int64)
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    char = np.where(cp < _TABLE.size, _TABLE[np.minimum(cp, _TABLE.size - 1)], 37 + cp % 27)
    char[cp == _BEFORE] = _START
    word = np.repeat(np.arange(len(words)), size)
    codes, weights = [], []
    for k in range(2, s.reach):
        same = np.flatnonzero(word[k:] == word[:-k])
        for j in range(1, k):
            codes.append((word[same] * _CLASSES + char[same]) * _CLASSES**2 + char[same + j] * _CLASSES + char[same + k])
            weights.append(np.full(same.size, s.decay ** (k - 2)))
    code, weight = np.concatenate(codes), np.concatenate(weights)
    order = np.argsort(code, kind="stable")
    code, weight = code[order], weight[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if code.size else np.zeros(0, np.int64)
    code, weight = code[first], np.add.reduceat(weight, first) if first.size else weight
    owner, key = code // _CLASSES**3, code % _CLASSES**3
    norm = np.sqrt(np.bincount(owner, weight**2, len(words)))
    return owner, key, weight / np.maximum(norm[owner], 1e-12)


def stretches(word: str, size: int) -> list[str]:
    """A blank and the word, in overlapping stretches; a word with marks inside also without them."""
    out = []
    for w in (word,) if word.isalnum() else dict.fromkeys((word, "".join(filter(str.isalnum, word)) or word)):
        w = " " + w
        out += [w] if len(w) <= size else [w[i : i + size] for i in range(0, len(w) - size // 2, size // 2)]
    return out


class Landmarks:
    """Kernel values of words against the landmarks, through a table from subsequence to the landmarks that hold it."""

    def __init__(self, words: tuple[str, ...], s: Settings, limit: int = 160_000):
        self.s, self.n, self.limit = s, len(words), limit
        owner, key, weight = subsequences([" " + w for w in words], s)  # landmarks are written as words begin: after a blank
        order = np.argsort(key, kind="stable")
        self.mark, self.weight = owner[order], weight[order]
        held, first, count = np.unique(key[order], return_index=True, return_counts=True)
        self.first, self.count = np.zeros(_CLASSES**3, np.int64), np.zeros(_CLASSES**3, np.int64)
        self.first[held], self.count[held] = first, count
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.zeros((4096, self.n), np.float32)

    def kernel(self, stretches_: list[str]) -> np.ndarray:
        """Shared subsequences of each stretch with each landmark, both of length one."""
        out = np.zeros((len(stretches_), self.n), np.float32)
        for at in range(0, len(stretches_), 5_000):  # each meets many landmarks
            part = stretches_[at : at + 5_000]
            owner, key, weight = subsequences(part, self.s)
            count = self.count[key]
            hit = count > 0
            owner, key, weight, count = owner[hit], key[hit], weight[hit], count[hit]
            each = np.repeat(np.arange(owner.size), count)
            entry = self.first[key][each] + np.arange(each.size) - np.repeat(np.cumsum(count) - count, count)
            out[at : at + len(part)] = np.bincount(owner[each] * self.n + self.mark[entry], weight[each] * self.weight[entry], len(part) * self.n).reshape(-1, self.n)
        return out

    def sharpened(self, values: np.ndarray) -> np.ndarray:
        return np.exp(self.s.sharpness * (np.minimum(values, 1) - 1))

    def _learn(self, new: list[str]) -> None:
        bare = [w.lower().strip(_EDGES) or w for w in new]
        index = {w: i for i, w in enumerate(dict.fromkeys(bare))}
        parts = [stretches(w, self.s.stretch) for w in index]
        value = self.kernel([p for ps in parts for p in ps])
        count = np.array([len(ps) for ps in parts])
        first = np.cumsum(count) - count
        best = value[first]
        for k in range(1, int(count.max())):
            longer = np.flatnonzero(count > k)
            best[longer] = np.maximum(best[longer], value[first[longer] + k])
        base = len(self.known)
        if base + len(new) > len(self.values):
            more = np.zeros((max(base + len(new), min(2 * len(self.values), self.limit)), self.n), np.float32)
            more[:base] = self.values[:base]
            self.values = more
        self.values[base : base + len(new)] = best[[index[w] for w in bare]]
        self.known.update(zip(new, range(base, base + len(new))))

    def _closest(self, sets: list[set[str]], out: np.ndarray) -> None:
        """Into ``out``, for each set of words and each landmark, the value of the closest word. No more than ``limit`` words are known at
        a time: sets that together have more are taken one after the other, and one of more words in parts."""
        new = set().union(*sets).difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self._forget()
            new = set().union(*sets)
        if len(new) <= self.limit:
            for part in _cut(list(new), 20_000):
                self._learn(part)
            for i, ws in enumerate(sets):
                if ws:
                    out[i] = np.maximum(out[i], self.values[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].max(axis=0))
        elif len(sets) > 1:
            half = len(sets) // 2
            self._closest(sets[:half], out[:half])
            self._closest(sets[half:], out[half:])
        else:
            for part in _cut(list(sets[0]), self.limit // 2):
                self._closest([set(part)], out)

    def describe(self, several: list[str]) -> np.ndarray:
        """For each text and landmark the value of the text's closest word."""
        out = np.zeros((len(several), self.n), np.float32)
        for at in range(0, len(several), 200):
            self._closest([words_of(t) for t in several[at : at + 200]], out[at : at + 200])
        return self.sharpened(out)


def _cut(items: list, size: int):
    return (items[at : at + size] for at in range(0, len(items), size))


@dataclasses.dataclass(frozen=True)
class Model:
    """Landmark words and the weights of their values (the Nyström map is already in them), offset, and logistic calibration."""

    words: tuple[str, ...]
    settings: Settings
    weights: tuple[float, ...]
    offset: float
    slope: float
    shift: float

    def score(self, values: np.ndarray) -> np.ndarray:
        margin = values.astype(np.float64) @ np.array(self.weights) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _landmarks(model_key: tuple[tuple[str, ...], Settings]) -> Landmarks:
    return Landmarks(*model_key)


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` rows whose labels may be learned, those with the least hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")
    # An identifier may stand on any number of rows; its first text is taken.
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def choose_landmarks(sample: DataFrame, s: Settings) -> tuple[str, ...]:
    """Words that toxic texts hold more often than others, and eight that other texts hold most often."""

    def run(batches):
        held: dict[str, list[int]] = {}

        def counted():
            cols = [pa.array(list(held), pa.string()), *(pa.array([n[k] for n in held.values()], pa.int64()) for k in (0, 1))]
            return pa.RecordBatch.from_arrays(cols, ["word", "n0", "n1"])

        for b in batches:
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
                bare = {w.lower().strip(_EDGES) for w in words_of(text)}
                for w in {w[:k] for w in bare for k in (4, 5, 6, s.stretch - 1) if len(w) >= 4} | {w for w in bare if 2 < len(w) < s.stretch}:
                    held.setdefault(w, [0, 0])[label > 0] += 1
                if len(held) > 500_000:
                    yield counted()
                    held = {}
        yield counted()

    parts = sample.select("label", "text").mapInArrow(run, "word string, n0 long, n1 long")
    counts = materialised(parts.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 + n0 > 1"))
    sizes = sample.groupBy(F.col("label").cast("boolean").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = {r["label"]: r["n"] for r in sizes}
    if set(total) != {0, 1}:
        return ()
    share = total[1] / (total[0] + total[1])
    n = F.col("n1") + F.col("n0")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(F.lit(0.0))
    gain = part(F.col("n1"), share) + part(F.col("n0"), 1 - share)
    toxic = [r["word"] for r in counts.where(F.col("n1") > n * share).withColumn("gain", gain).where(F.col("gain") >= s.evidence).orderBy(F.round("gain", 6).desc(), F.length("word").desc(), "word").limit(s.candidates).collect()]
    plain = [r["word"] for r in counts.orderBy(F.col("n0").desc(), "word").limit(s.candidates).collect()]
    chosen: list[str] = []
    for pool in (toxic, plain):
        most = s.landmarks - 8 if pool is toxic else len(chosen) + 8
        if not pool:
            continue
        all_ = Landmarks(tuple(pool), s)
        free = np.ones(len(pool), bool)
        if chosen:
            free &= all_.kernel([" " + c for c in chosen]).max(axis=0) < s.apart
        for i, w in enumerate(pool):
            if len(chosen) >= most:
                break
            if free[i]:
                chosen.append(w)
                free &= all_.kernel([" " + w])[0] < s.apart
    return tuple(chosen)


def _support_vectors(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps over the rows inside the margin; both classes weigh the same."""
    n, d = x.shape
    x = np.c_[x, np.ones(n)]
    cost = penalty * np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)) / n * 100
    ridge = np.eye(d + 1)
    ridge[d, d] = 1e-6
    w = np.zeros(d + 1)
    loss = lambda v: 0.5 * v @ ridge @ v + np.sum(cost * np.maximum(0, 1 - y * (x @ v)) ** 2)
    for _ in range(50):
        slack = 1 - y * (x @ w)
        on = slack > 0
        gradient = ridge @ w - 2 * (x[on] * (cost * y * slack)[on, None]).sum(axis=0)
        step = np.linalg.solve(ridge + 2 * (x[on] * cost[on, None]).T @ x[on], gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins (smoothed targets, Newton)."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    v = np.array([1.0, 0.0])
    x = np.c_[margin, np.ones(margin.size)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * v)
        v = v - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(v[0]), float(v[1])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """The model, or None without labels of both kinds. The driver sees ``sample`` rows of ``landmarks`` numbers."""
    sample = materialised(labelled_sample(docs, labels, s))
    words = choose_landmarks(sample, s)
    if not words:
        return None

    def run(batches):
        marks = once_per_worker(_landmarks, (words, s))
        for b in batches:
            values = marks.describe(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([v.tobytes() for v in values], pa.binary())], ["doc_id", "label", "values"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, values binary").toPandas().sort_values(["doc_id", "values"])
    x = np.frombuffer(b"".join(rows["values"]), np.float32).reshape(len(rows), len(words)).astype(np.float64)
    y = np.where(rows["label"].to_numpy() > 0, 1.0, -1.0)
    marks = Landmarks(words, s)
    value, vector = np.linalg.eigh(marks.sharpened(marks.kernel([" " + w for w in words])).astype(np.float64))
    keep = value > 1e-6 * value.max()
    nystroem = vector[:, keep] / np.sqrt(value[keep]) @ vector[:, keep].T
    apart = np.arange(len(rows)) % 5 == 0  # calibrated on rows that the machine has not seen
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.ones(len(rows), bool)
        fit = apart
    else:
        fit = ~apart
    w = _support_vectors(x[fit] @ nystroem, y[fit], s.penalty)
    weights = nystroem @ w[:-1]
    slope, shift = _calibrated(x[apart] @ weights + w[-1], y[apart])
    return Model(words, s, tuple(weights), float(w[-1]), slope, shift)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; with ``keep`` all the row's own columns and, last, ``predicted``
    (with lines added to its name where the row has such a column)."""
    source = docs if keep else texts(docs, id_col, text_col)
    fields = [f.name for f in source.schema.fields]
    flag = "predicted"
    while keep and flag.lower() in map(str.lower, fields):
        flag += "_"

    def run(batches):
        marks = once_per_worker(_landmarks, (model.words, model.settings)) if model else None
        for whole in batches:
            for b in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                texts_ = [t or "" for t in b.column(text_col if keep else "text").to_pylist()]
                values = model.score(marks.describe(texts_)) if model else np.zeros(len(texts_))
                predicted = pa.array((values >= model.settings.threshold).astype(np.int32) if model else np.zeros(len(texts_), np.int32))
                if keep:
                    yield pa.RecordBatch.from_arrays([*b.columns, predicted], [*fields, flag])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values, pa.float64()), predicted], ["doc_id", "score", "predicted"])

    if keep:
        return source.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in source.schema.fields), T.StructField(flag, T.IntegerType())]))
    return source.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")
