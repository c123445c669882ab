"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a word between fixed delimiters (longer words are cut into windows of 64 bytes). It is compressed with each
dictionary; a window that the toxic dictionary shortens more by some bytes, and down to few bytes over an empty one,
passes the threshold of those two numbers. Counts of windows that pass each threshold, as logarithms and as shares, are
weighed by a logistic regression on the training documents, which calibrates the thresholds. Short windows keep the few
telling words of a long document apart from the rest; equal windows of a partition are compressed once.

The ordinary dictionary is trained by zstandard on words of ordinary documents. The toxic one has raw content: the words that toxic
training documents hold significantly more often than ordinary ones (a lower bound of the log ratio of the shares over 2, and
at least LEAST documents), those in most documents last, where matches are cheapest; TOXIC_BYTES is the only other bound. Phrases
of two or three words that pass the same rule, though none of their words does, stand there too and are windows where they occur.

Training reads at most ``SAMPLE`` labelled ids of each class, those of least hash of the id, one row of each, and at most
``SAMPLE_BYTES`` of a class's texts, without those that no longer fit; every document is scored from its whole text alone.

Defined cases: null, empty and blank texts have no windows and get the score of such texts; repeated rows are scored each; without
labelled rows of both classes all scores are the share of toxic rows (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.llm.common import table

SAMPLE = 3000
SAMPLE_BYTES = 24 << 20
FOLDS = 5
START, STOP, CARRIER = b"\x01\x02\x03", b"\x11\x12\x13", bytes(33 + i * 7919 % 90 for i in range(48))
WINDOW = 64
ORDINARY_BYTES = 64 << 10
TOXIC_BYTES = 16 << 10
MOST, COSTS = 11, 5
LEAST = 3  # toxic documents that hold a telling word or phrase
REMEMBERED = 150_000


def word_windows(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z) without punctuation around them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = [w.strip(b".,;:!?#*$%&|<>\"'()[]") for w in words]
    if any(len(w) > WINDOW for w in out):
        out = [w[i : i + WINDOW] for w in out for i in range(0, max(1, len(w)), WINDOW)]
    return out


def _phrase(words: list[bytes]) -> bytes:
    return b" ".join(words)


class Lengths(dict):
    """Bin of a window by its two compressed lengths: how much shorter the toxic one is, and its cost."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self._toxic, self._ordinary = _compressor(toxic), _compressor(ordinary)
        self._base = len(self._toxic(CARRIER))
        held = (w.removesuffix(STOP) for w in toxic.split(START)[1:])
        self._phrases = {w for w in held if b" " in w}
        self._pairs = {tuple(w.split(b" ")[:2]) for w in self._phrases}

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        window = START + word + STOP + CARRIER
        short = len(self._toxic(window))
        cost = min(max(short - self._base, 0), COSTS - 1)  # the last bin is of all higher costs: gains count at any cost
        gain = min(max(len(self._ordinary(window)) - short, 0), MOST)
        self[word] = out = gain * COSTS + cost if gain else 0
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Of all windows of a text: how many gain at least 1..MOST bytes at each low cost and at any, and what share."""
        words = word_windows(text)
        n, windows = len(words), words
        if self._pairs:
            at = [i for i, pair in enumerate(zip(words, words[1:])) if pair in self._pairs]
            phrases = (_phrase(words[i : i + k]) for i in at for k in (2, 3) if i + k <= n)
            windows = words + [p for p in phrases if p in self._phrases]
        bins = np.bincount(np.fromiter((self[w] for w in windows), np.int64, len(windows)), minlength=(MOST + 1) * COSTS)
        least = bins.reshape(MOST + 1, COSTS)[::-1].cumsum(0)[::-1][1:]
        every = least.sum(1)
        return np.concatenate([np.log1p(least[:, :3]).T.ravel(), np.log1p(every), every / (n + 10), [math.log1p(n)]])


def _compressor(content: bytes):
    import zstandard as zstd

    settings = zstd.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=3, target_length=64, strategy=zstd.STRATEGY_BTULTRA,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary = zstd.ZstdCompressionDict(content + CARRIER, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    import zstandard as zstd

    held = [Counter(w for t in texts for w in set(word_windows(t))) for texts in (toxic, ordinary)]

    def evidence(n: int, m: int, phrase: bool) -> float:
        """Lower bound of the log ratio of the shares of n toxic and m ordinary documents. There are far more phrases than words,
        and more of them by chance in no ordinary document, so for these the bound is lower."""
        ratio = math.log((n + 0.5) / (len(toxic) + 1)) - math.log((m + 0.5) / (len(ordinary) + 1))
        return ratio - (1.5 * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)) if m or phrase else 1.0)

    def telling(n: int, m: int, phrase: bool = True) -> bool:
        return n >= LEAST and evidence(n, m, phrase) > 2

    words = {w: n for w, n in held[0].items() if len(w) >= 3 and telling(n, held[1][w], False)}
    usable = [w for w, n in held[0].items() if n >= LEAST and w and b" " not in w and w not in words]
    phrases = _phrases(toxic, ordinary, usable, telling)
    chosen = sorted((n, w) for w, n in (words | phrases).items())
    content = b"".join(START + w + STOP for _, w in chosen)[-TOXIC_BYTES:]
    samples = [b"".join(START + w + STOP for w in word_windows(t)) for t in ordinary]
    try:
        usual = zstd.train_dictionary(ORDINARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # too few samples to train on: their own beginning serves
        usual = b"".join(samples)[:ORDINARY_BYTES]
    return content, usual


def _phrases(toxic: list[str], ordinary: list[str], usable: list[bytes], telling) -> dict[bytes, int]:
    """Telling phrases of two words, or of three without a telling two, and how many toxic documents hold each. Phrases are
    numbers here, and those of ordinary documents are counted only where toxic ones hold them often enough."""
    number, size = {w: i for i, w in enumerate(usable)}, len(usable) + 1

    def numbers(text: str) -> np.ndarray:
        words = word_windows(text)
        return np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))

    texts = [[numbers(t) for t in texts] for texts in (toxic, ordinary)]

    def counted(firsts: list[list[np.ndarray]], longer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of a first part and the word after it, in how many toxic and how many ordinary documents."""
        every = []
        for first, of in zip(firsts, texts):
            rows = []
            for f, ids in zip(first, of):
                last = ids[longer:]
                f = f[: len(last)]
                rows.append(np.unique((f * size + last)[(f >= 0) & (last >= 0)]))
            every.append(np.concatenate([np.zeros(0, np.int64), *rows]))
        codes, n = np.unique(every[0], return_counts=True)
        codes, n = codes[n >= LEAST], n[n >= LEAST]
        m = np.bincount(_places(codes, every[1])[1], minlength=len(codes))
        return codes, n, m

    pairs, n2, m2 = counted(texts, 1)
    good = np.array([telling(int(n), int(m)) for n, m in zip(n2, m2)], bool)
    out = {_phrase([usable[c // size], usable[c % size]]): int(n) for c, n in zip(pairs[good].tolist(), n2[good])}
    rest, firsts = pairs[~good], []
    for of in texts:
        firsts.append([])
        for ids in of:
            codes = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * size + ids[1:], -1)
            place = np.full(len(codes), -1)
            found, places = _places(rest, codes)
            place[found] = places
            firsts[-1].append(place)
    triples, n3, m3 = counted(firsts, 2)
    inner = set(pairs[good].tolist())
    for c, n, m in zip(triples.tolist(), n3, m3):
        pair, last = int(rest[c // size]), c % size
        if telling(int(n), int(m)) and pair % size * size + last not in inner:
            out[_phrase([usable[pair // size], usable[pair % size], usable[last]])] = int(n)
    return out


def _places(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted numbers stand in the sorted codes, and where."""
    at = np.minimum(np.searchsorted(codes, wanted), max(len(codes) - 1, 0))
    found = codes[at] == wanted if len(codes) else np.zeros(len(wanted), bool)
    return found, at[found]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 3.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    ridge = np.eye(z.shape[1]) * penalty
    ridge[0, 0] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, spread, w


class Model:
    """Scores texts: dictionaries, and weights of the features. Without weights the score is a constant."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.weights, self.prior = None, len(toxic) / max(1, len(toxic) + len(ordinary))
        if toxic and ordinary:
            self.contents = _dictionaries(toxic, ordinary)
            lengths = Lengths(*self.contents)
            x = np.array([lengths.features(t) for t in (*toxic, *ordinary)])
            self.weights = _logistic(x, np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))])

    def scorer(self):
        if self.weights is None:
            return lambda text: self.prior
        lengths, (mean, spread, w) = Lengths(*self.contents), self.weights

        def score(text: str | None) -> float:
            z = w[0] + ((lengths.features(text) - mean) / spread) @ w[1:]
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def held_out(doc_id):
    """Rows that training never sees: crc32 of the id as text is a multiple of five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label"), F.xxhash64("doc_id").alias("h")
    ).distinct()
    # At most 2 * sample ids are sent to the tasks that read the documents.
    picked = [known.where(F.col("label") == label).orderBy("h", "id").limit(sample) for label in (1, 0)]
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("words"))
    # Of rows that repeat an id the least text, so the sample is bounded by the ids of each class.
    each = lambda of: rows.join(F.broadcast(of), "id").groupBy("h", "id", "label").agg(F.min("words").alias("words"))
    sizes = each(picked[0].unionByName(picked[1])).select("h", "id", "label", F.length("words").alias("size")).collect()
    room, fit = {1: sample_bytes, 0: sample_bytes}, []
    for r in sorted(sizes, key=lambda r: (r.h, r.id)):
        if r["size"] <= room[r.label]:  # a text that does not fit is passed over
            room[r.label] -= r["size"]
            fit.append((r.h, r.id, r.label))
    chosen = docs.sparkSession.createDataFrame(fit, known.select("h", "id", "label").schema)
    taken = sorted(each(chosen).collect(), key=lambda r: (r.h, r.id))
    samples = [[r.words for r in taken if r.label == label] for label in (1, 0)]
    return Model(*samples)


def score_texts(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()  # travels with the function: at most ORDINARY_BYTES + TOXIC_BYTES and the weights
        for batch in batches:
            scores = [score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
