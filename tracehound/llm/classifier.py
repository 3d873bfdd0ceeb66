"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import arrow_map, sampled, table

#: Labelled rows at most that a fit sees, half of each label where there are enough, taken by the hash of their id; a fit runs on the driver.
FIT_ROWS = 4_000
#: Bytes of a chunk and of the overlap of one with the next; a text has as many chunks as it takes.
CHUNK = 512
OVERLAP = 64
#: Chunks that a fit sees of a text in one round; each round draws others. Scoring sees all.
FIT_CHUNKS = 6
EMBED = 6
WIDTH = 8
STRIDE = 2
FILTERS = 24
ROUNDS = 14
RATE = 0.01
PAD = 256


def chunks(text: str | None) -> np.ndarray:
    """Overlapping chunks of a whole text's bytes, the last filled up; a text without bytes is one empty chunk."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-max(len(b) - OVERLAP, 1) // step))
    out = np.full(n * step + OVERLAP, PAD, np.int64)
    out[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(out, CHUNK)[::step]


@dataclass
class Network:
    """Byte vectors, filters over WIDTH bytes, and a logistic layer over the filters' maxima in a text and the mean of its chunks' maxima."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    @staticmethod
    def start(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        embed[PAD] = 0
        return Network(embed, r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def fields(self, c: np.ndarray) -> np.ndarray:
        """Vectors of the windows of each chunk, (chunks, windows, WIDTH * EMBED)."""
        e = self.embed[c]
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)[:, ::STRIDE]
        return w.transpose(0, 1, 3, 2).reshape(len(c), w.shape[1], -1)

    def maxima(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter in each chunk, not below 0, and its window."""
        x = self.fields(c)
        z = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(len(c), x.shape[1], FILTERS)
        at = z.argmax(1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias, 0), at

    def scores(self, texts: list) -> np.ndarray:
        """Probability of label 1 for each whole text. Chunks go through the filters a bounded number at a time."""
        best, mean = np.zeros((len(texts), FILTERS), np.float32), np.zeros((len(texts), FILTERS), np.float32)
        counts = np.zeros((len(texts), 1), np.float32)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            m, _ = self.maxima(np.concatenate([c for _, c in held]))
            a = 0
            for i, c in held:
                part = m[a : a + len(c)]
                best[i] = np.maximum(best[i], part.max(0))
                mean[i] += part.sum(0)
                a += len(c)
            held.clear()

        for i, t in enumerate(texts):
            c = chunks(t)
            counts[i] = len(c)
            for a in range(0, len(c), 256):
                held.append((i, c[a : a + 256]))
                size += len(held[-1][1])
                if size >= 256:
                    flush()
                    size = 0
        if held:
            flush()
        s = np.hstack([best, mean / counts]) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(s.astype(np.float64), -40, 40)))


def fit(texts: list, labels: np.ndarray, seed: int = 7, rounds: int = ROUNDS) -> Network:
    """Adam on the logistic loss; each label weighs half. With one label only, the shift alone tells its share."""
    net = Network.start(seed)
    share = labels.mean() if len(labels) else 0.5
    if len(np.unique(labels)) < 2:
        net.out[:] = 0
        net.shift[:] = 3.0 if share > 0.5 else -3.0 if share < 0.5 else 0.0
        return net
    rng = np.random.default_rng(seed)
    all_chunks = [chunks(t) for t in texts]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    names = ("embed", "filters", "bias", "out", "shift")
    m1, m2 = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 32):
            docs = order[a : a + 32]
            picks = [c if len(c) <= FIT_CHUNKS else c[rng.choice(len(c), FIT_CHUNKS, replace=False)] for c in (all_chunks[i] for i in docs)]
            n = np.array([len(p) for p in picks])
            c, owner, first = np.concatenate(picks), np.repeat(np.arange(len(docs)), n), np.cumsum(n) - n
            x = net.fields(c)
            z = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(len(c), x.shape[1], FILTERS)
            at = z.argmax(1)
            m = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + net.bias, 0)
            best, mean = np.maximum.reduceat(m, first), np.add.reduceat(m, first) / n[:, None]
            s = np.hstack([best, mean]) @ net.out + net.shift
            d = ((1 / (1 + np.exp(-s)) - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            g = {"out": np.hstack([best, mean]).T @ d, "shift": d.sum(keepdims=True)}
            to_best, to_mean = d[:, None] * net.out[:FILTERS], d[:, None] * net.out[FILTERS:]
            dm = (to_mean / n[:, None])[owner] + np.where(m == best[owner], to_best[owner], 0)
            dm *= m > 0
            g["bias"] = dm.sum(0)
            windows = np.take_along_axis(x[:, :, :, None].reshape(len(c), x.shape[1], -1), at[:, :, None], 1)
            g["filters"] = np.einsum("cfk,cf->kf", windows, dm)
            back = (dm[:, :, None] * net.filters.T[None]).reshape(len(c), FILTERS, WIDTH, EMBED)
            places = c[np.arange(len(c))[:, None, None], (at * STRIDE)[:, :, None] + np.arange(WIDTH)]
            flat = back.reshape(-1, EMBED)
            g["embed"] = np.stack([np.bincount(places.ravel(), weights=flat[:, k], minlength=257) for k in range(EMBED)], 1).astype(np.float32)
            g["embed"][PAD] = 0
            step += 1
            for k in names:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] ** 2 - m2[k])
                move = RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    return net


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[list, np.ndarray]:
    """At most `rows` labelled texts, half of each label where there are enough: the rows with the smallest hashes of their id."""
    ids = labels.where(learn & labels[label_col].isin(0, 1)).select(labels[id_col].alias("_id"), labels[label_col].alias("_y"))
    chosen = None
    for y in (0, 1):
        part = sampled(ids.where(F.col("_y") == y), "_id", rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(docs[id_col].alias("_doc"), docs[text_col].alias("_text"))
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).orderBy("_id", "_text", "_y").limit(2 * rows).toPandas()
    return found["_text"].tolist(), found["_y"].to_numpy(np.float32)


def classify(docs: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and score (0 to 1) of every whole text. Null is as empty; an empty text gets the score of an empty chunk. An empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return arrow_map(docs, text_col, lambda texts: {"score": shared.value.scores(texts)}, "score double", keep=keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5
    net = fit(*training_sample(docs, labels, fold(labels["doc_id"]) != 0, "doc_id", "text", "quality", FIT_ROWS))
    out = classify(docs, net)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
