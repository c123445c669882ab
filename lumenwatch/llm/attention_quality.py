"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages with one label.

A passage is ``WORDS`` consecutive words (the last one of a text may be shorter). It is described by shares of its bytes by
class, of its words by length and by hashed bin, and by how often words come back. A learned layer encodes the description; gated
attention, tanh of one layer times the sigmoid of another, weighs the passages of a document; the weighted mean of the
encodings gives the score by a logistic unit. Encoder, gates and unit are trained together, from document labels
alone, by gradient descent on the cross-entropy of documents.

Training reads at most ``SAMPLE`` labelled ids, those of least hash, one row of each, and at most ``SAMPLE_BYTES`` characters of
text, without texts that no longer fit. Every document is scored from all passages of its whole text: a task describes about
``GROUP`` characters at once and adds each part of a long text to its running weighted mean.

Defined cases: null, empty and blank texts have one passage without words, whose description is all zeros, in training too;
repeated rows are scored each; without labelled rows of both classes all scores are the share of label 1 (0 without labels); an id
with both labels counts as label 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.llm.common import table
from lumenwatch.llm.shingles import Shingler

WORDS, GROUP = 64, 1 << 20
SAMPLE, SAMPLE_BYTES = 6000, 16 << 20
FOLDS = 5
HASHED, LENGTHS = 256, 12
HIDDEN, GATES = 32, 16
EPOCHS, BAG, RATE, DECAY = 30, 64, 4e-3, 1e-3
_SPACES = b" \t\n\x0b\x0c\r"


def _byte_classes() -> np.ndarray:
    """Each lower-case letter and mark is a class; so are capitals, digits, line feeds, other white space, the bytes of other letters by their first bits, and the rest."""
    single = [bytes([c]) for c in range(33, 127) if not (chr(c).isupper() or chr(c).isdigit())]
    groups = [*single, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b" \t\x0b\x0c\r", *(bytes(range(a, a + 16)) for a in range(128, 256, 16))]
    classes = np.full(256, len(groups))
    for k, group in enumerate(groups):
        classes[list(group)] = k
    return classes


_CLASS = _byte_classes()
_N_CLASSES = int(_CLASS.max()) + 1
WIDTH = _N_CLASSES + HASHED + LENGTHS + 4


def _parts(texts: Iterable[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Groups of (number of the text, part), each of about GROUP characters; long texts are cut at white space."""
    group, size = [], 0
    for k, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            end = at + GROUP
            if end < len(text):
                stop = max(text.rfind(chr(s), at + 1, end) for s in _SPACES)
                end = stop if stop > at else end
            group.append((k, text[at:end]))
            size, at = size + min(end, len(text)) - at, end
            if size >= GROUP:
                yield group
                group, size = [], 0
    if group:
        yield group


def describe(parts: list[tuple[int, str]], shingler: Shingler) -> tuple[np.ndarray, np.ndarray]:
    """The descriptions of the passages of a group of parts, and each one's text."""
    raw = [p.encode("utf-8", "surrogatepass") for _, p in parts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
    space = np.concatenate([[True], np.isin(data, np.frombuffer(_SPACES, np.uint8)), [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64)
    part = np.searchsorted(begins, starts, "right") - 1
    first = np.flatnonzero(np.diff(part, prepend=-1))  # of the words of each part
    within = np.arange(len(starts)) - np.repeat(first, np.diff(first, append=len(starts)))
    new = np.diff(part, prepend=-1).astype(bool) | (within % WORDS == 0)
    passage = np.cumsum(new) - 1
    n = int(passage[-1]) + 1
    of = np.array([k for k, _ in parts])[part[new]]

    def shares(group: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
        counts = np.bincount(group * kinds + kind, minlength=n * kinds).reshape(n, kinds)
        return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))

    spread = np.repeat(passage, np.diff(starts, append=len(data)))  # of each byte from the first word on
    hashes = shingler.words(" ".join(p for _, p in parts))
    words = np.bincount(passage, minlength=n)
    named = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((named[np.diff(named, prepend=~named[:1]) != 0] >> np.uint64(40)).astype(np.int64), minlength=n)
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])])
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    more = np.stack([distinct / words, np.bincount(passage, same, n) / words, np.bincount(passage, capital, n) / words, np.log1p(words) / np.log1p(WORDS)], 1)
    x = np.concatenate([
        shares(spread, _CLASS[data[starts[0] :]], _N_CLASSES), shares(passage, (hashes % np.uint64(HASHED)).astype(np.int64), HASHED),
        shares(passage, np.minimum(ends - starts, LENGTHS) - 1, LENGTHS), more,
    ], 1)
    return x.astype(np.float32), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Encoder, gated attention and logistic unit; ``fit`` trains them from bags."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {
            "encode": draw(WIDTH, HIDDEN), "shift": np.zeros(HIDDEN, np.float32), "tanh": draw(HIDDEN, GATES), "gate": draw(HIDDEN, GATES),
            "attend": draw(GATES), "score": draw(HIDDEN), "bias": np.zeros(1, np.float32),
        }

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.p["encode"] + self.p["shift"])

    def attention(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, g = np.tanh(h @ self.p["tanh"]), _sigmoid(h @ self.p["gate"])
        return (a * g) @ self.p["attend"], a, g

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return _sigmoid(pooled @ self.p["score"] + self.p["bias"])

    def _gradients(self, x: np.ndarray, y: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of bags, whose first passages are ``firsts``."""
        p, bag = self.p, np.repeat(np.arange(len(y)), np.diff(firsts, append=len(x)))
        scaled = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(scaled @ p["encode"] + p["shift"])
        e, a, g = self.attention(h)
        e = np.exp(e - np.maximum.reduceat(e, firsts)[bag])
        weight = (e / np.add.reduceat(e, firsts)[bag])[:, None]
        pooled = np.add.reduceat(weight * h, firsts)
        wrong = (self.score(pooled) - y) / len(y)
        by_bag = (wrong[:, None] * p["score"])[bag]
        pull = weight * (h * by_bag).sum(1, keepdims=True)
        de = (pull - weight * np.add.reduceat(pull, firsts)[bag])[:, 0]
        gated = de[:, None] * p["attend"]
        da, dg = gated * g * (1 - a * a), gated * a * g * (1 - g)
        dh = (weight * by_bag + da @ p["tanh"].T + dg @ p["gate"].T) * (1 - h * h)
        return {
            "encode": scaled.T @ dh, "shift": dh.sum(0), "tanh": h.T @ da, "gate": h.T @ dg, "attend": (a * g).T @ de,
            "score": pooled.T @ wrong, "bias": wrong.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-2
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BAG):
                chosen, step = order[at : at + BAG], step + 1
                firsts = np.cumsum([0, *(len(bags[i]) for i in chosen[:-1])])
                grad = self._gradients(np.concatenate([bags[i] for i in chosen]), labels[chosen], firsts)
                for k, d in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] = (self.p[k] - RATE * (move + (DECAY * self.p[k] if k != "bias" else 0))).astype(np.float32)


class Model:
    """Scores texts; without a trained network the score is a constant."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.network, self.prior = None, sum(labels) / max(1, len(labels))
        if len(set(labels)) == 2:
            shingler, bags = Shingler(1), [[] for _ in texts]
            for parts in _parts(texts):
                x, of = describe(parts, shingler)
                for k in np.unique(of):
                    bags[k].append(x[of == k])
            empty = np.zeros((1, WIDTH), np.float32)
            self.network = Network()
            self.network.fit([np.concatenate(b) if b else empty for b in bags], np.array(labels, np.float32))

    def scores(self, texts: list[str | None], shingler: Shingler) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The score of each text, its number of passages, and which of them has most weight (-1 without one)."""
        n, net = len(texts), self.network
        count, focus = np.zeros(n, np.int64), np.full(n, -1)
        if net is None:
            return np.full(n, self.prior), count, focus
        most, weight, pooled = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        for parts in _parts(texts):
            x, of = describe(parts, shingler)
            if not len(of):
                continue
            h = net.encode(x)
            e = net.attention(h)[0].astype(np.float64)
            firsts = np.flatnonzero(np.diff(of, prepend=-1))
            docs, bag = of[firsts], np.repeat(np.arange(len(firsts)), np.diff(firsts, append=len(of)))
            here = np.maximum.reduceat(e, firsts)
            top = np.maximum(most[docs], here)
            old, new = np.exp(most[docs] - top), np.exp(e - top[bag])
            leads = np.flatnonzero(e == here[bag])[::-1]
            lead = np.zeros(len(docs), np.int64)
            lead[bag[leads]] = leads  # the first of equals
            focus[docs] = np.where(here > most[docs], count[docs] + lead - firsts, focus[docs])
            weight[docs] = weight[docs] * old + np.add.reduceat(new, firsts)
            pooled[docs] = pooled[docs] * old[:, None] + np.add.reduceat(new[:, None] * h, firsts)
            most[docs] = top
            count[docs] += np.diff(firsts, append=len(of))
        pooled /= np.maximum(weight, 1e-300)[:, None]
        pooled[count == 0] = net.encode(np.zeros((1, WIDTH), np.float32))[0]
        return net.score(pooled), count, focus


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("label"))
    known = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample)  # at most ``sample`` ids are sent to the tasks
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("words"))
    each = lambda of: rows.join(F.broadcast(of), "id").groupBy("h", "id", "label").agg(F.min("words").alias("words"))
    room, fit = sample_bytes, []
    for r in sorted(each(known).select("h", "id", "label", F.length("words").alias("size")).collect()):
        if r["size"] <= room:  # a text that does not fit is passed over
            room -= r["size"]
            fit.append((r.h, r.id, r.label))
    chosen = docs.sparkSession.createDataFrame(fit, known.select("h", "id", "label").schema)
    taken = sorted(each(chosen).collect(), key=lambda r: (r.h, r.id))
    return Model([r.words for r in taken], [int(r.label) for r in taken])


def score_quality(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, n_passages, focus (the passage with most weight, from 0; -1 without passages) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)  # the model, some 50 kB, travels with the function
        for batch in batches:
            score, count, focus = model.scores(batch.column(1).to_pylist(), shingler)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(count), pa.array(focus)], names=["doc_id", "score", "n_passages", "focus"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_passages long, focus long")


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "focus")


QUERIES = {"op11_attention_quality": op11_attention_quality}
ORACLES: dict[str, str] = {}
