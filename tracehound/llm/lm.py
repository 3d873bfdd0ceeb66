"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation, and a smoothed unigram base."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import batches, commonest, shared_folder, table, total, written
from tracehound.llm.shingles import word_hashes

#: Training count from which on a word is a symbol of the model: this, or the square root of all training tokens over SPARSE, if more. The vocabulary has no other bound.
LEAST, SPARSE = 10, 50
DIMS = 16
CONTEXT = 3
BATCH = 4096
#: Draws of noise a batch shares, of symbols and of classes.
NOISE, CLASS_NOISE = 96, 32
#: Tokens that are scored at once.
AT_ONCE = 262_144
RATE = 0.15
#: What the squared gradients of a row start from; a row that few tokens touch still moves.
FIRST = 1e-6
#: Words whose counts go out to all tasks beside those of the model (16 bytes each); the counts of all other words are joined by shuffle.
FREQUENT = 1 << 19
#: Rows of the parameters that travel together.
BLOCK = 1024
END = np.int64(-7046029254386353131)
#: Ways in which a word can end, and whether it has a character beyond ASCII: the classes of words that are no symbol.
CLASSES = 12


BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, A-Z lower-cased, then an end for each text), their classes, and the ends of the texts."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = b"\n".join(raw) + b"\n"
    h, at = word_hashes(buf)
    b = np.frombuffer(buf, np.uint8)
    n = len(texts)
    if len(h):
        stop = np.append(at[1:], len(b))
        solid = ~BLANK[b]
        last = np.maximum.accumulate(np.where(solid, np.arange(len(b)), 0))[stop - 1]
        tail = b[last]
        kind = np.select([(tail >= 97) & (tail <= 122), tail == 46, tail == 44, tail == 33, tail >= 128], [0, 1, 2, 3, 0], 4)
        kind[(tail >= 48) & (tail <= 57)] = 5
        cls = 2 * kind + (np.maximum.reduceat(b, at) >= 128)
    else:
        cls = np.empty(0, np.int64)
    words = np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])))
    ends = np.cumsum(words + 1)
    hashes, classes = np.full(len(h) + n, END), np.full(len(h) + n, -1, np.int64)
    spot = np.ones(len(hashes), bool)
    spot[ends - 1] = False
    hashes[spot], classes[spot] = h.view(np.int64), cls
    return hashes, classes, ends


def counted(frames):
    """Counts of tokens in a task, as (h, cls, c); held rows are merged, and sent on before they grow large."""
    held: list[tuple] = []
    size = 0

    def merged():
        h = np.concatenate([x[0] for x in held])
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.diff(h, prepend=h[0] - 1 if h[0] > np.iinfo(np.int64).min else h[0] + 1))
        return h[first], np.concatenate([x[1] for x in held])[order][first], np.add.reduceat(np.concatenate([x[2] for x in held])[order], first)

    for frame in batches(frames, "text", 4_000_000):
        h, cls, _ = tokens(frame["text"].tolist())
        u, first, c = np.unique(h, return_index=True, return_counts=True)
        held.append((u, cls[first], c))
        size += len(u)
        if size > 2_000_000:
            held = [merged()]
            size = len(held[0][0])
            if size > 1_000_000:
                yield pd.DataFrame(dict(zip(("h", "cls", "c"), held[0])))
                held, size = [], 0
    if held:
        yield pd.DataFrame(dict(zip(("h", "cls", "c"), merged())))


@dataclass
class Model:
    """Symbols, the commonest first, with their hashes in order, the symbol of each hash, their unigram shares (the noise), the
    first symbol of each class, and the parameters: input and output vectors and biases of symbols, vectors and biases of
    classes, one weight vector per context place. A score is a product of vectors and a bias on top of the log of the share."""

    names: np.ndarray
    which: np.ndarray
    noise: np.ndarray
    starts: np.ndarray
    params: dict[str, np.ndarray]

    def symbols(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        order = np.where(self.names.take(at) == h, self.which.take(at), self.rare.take(np.maximum(cls, 0)))
        return order

    def __post_init__(self) -> None:
        self.sizes = np.diff(self.starts, append=len(self.noise))
        self.class_of = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.class_noise = np.add.reduceat(self.noise.astype(np.float64), self.starts)


def first_model(frequent: pd.DataFrame, class_counts: np.ndarray, symbols: int, seed: int = 3) -> Model:
    """Biases that give every symbol its unigram share, small vectors from a seed.

    Symbols in order of share are cut into about as many classes as the square root of their number, each with the like
    share of all tokens, so the commonest words are classes of their own and the rarest share large ones.
    """
    top = frequent[frequent["h"] != END].nlargest(symbols - CLASSES - 1, "c") if len(frequent) else frequent
    end = frequent.loc[frequent["h"] == END, "c"].sum() if len(frequent) else 0
    names = np.append(top["h"].to_numpy(np.int64), END)
    counts = np.append(top["c"].to_numpy(np.float64), end)
    rest = class_counts - np.bincount(top["cls"].to_numpy(np.int64), weights=top["c"].to_numpy(np.float64), minlength=CLASSES) if len(top) else class_counts
    share = np.concatenate([counts, rest]) + 1.0
    share /= share.sum()
    order = np.argsort(-share, kind="stable")
    symbol = np.empty(len(order), np.int32)
    symbol[order] = np.arange(len(order))
    share = share[order]
    by_name = np.argsort(names)
    v = len(share)
    want = max(int(np.ceil(v**0.5)), 2)
    starts = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(share) - share, np.arange(1, want) / want)]))
    starts = starts[starts < v]
    rng = np.random.default_rng(seed)
    vectors = lambda n, by: rng.standard_normal((n, DIMS), np.float32) * np.float32(by)
    model = Model(names[by_name], symbol[:-CLASSES][by_name], share.astype(np.float32), starts, {
        "inputs": vectors(v, 0.3), "outputs": vectors(v, 0.02), "biases": np.zeros((v, 1), np.float32),
        "classes": vectors(len(starts), 0.02), "class_biases": np.zeros((len(starts), 1), np.float32), "places": np.full((CONTEXT, DIMS), 0.5, np.float32),
    })
    model.rare = symbol[-CLASSES:]
    return model


def contexts(s: np.ndarray, ends: np.ndarray, end_symbol: int) -> np.ndarray:
    """The CONTEXT symbols before each token of its own text, nearest first; before a text stand ends."""
    begin = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0))
    at = np.arange(len(s))[:, None] - np.arange(1, CONTEXT + 1)
    return np.where(at >= begin[:, None], s[np.maximum(at, 0)], end_symbol)


def guesses(p: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the context symbols, and their sum weighted by place."""
    vectors = p["inputs"].take(context, 0)
    return vectors, np.einsum("bkd,kd->bd", vectors, p["places"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; far below zero the exponential is infinite and its reciprocal zero, as it should be."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation by AdaGrad with a rate per row, over the tokens of a task, a batch at a time.

    A batch is told from NOISE symbols and CLASS_NOISE classes drawn anew from the unigram shares and shared by all its
    tokens, so their part is one product of matrices. A score minus log(number of draws * share) is the odds of data against noise.
    """

    def __init__(self, model: Model, seed: int) -> None:
        self.m, self.p, self.rng = model, {k: x.copy() for k, x in model.params.items()}, np.random.default_rng(seed)
        self.g = {k: np.full((len(x), 1), FIRST, np.float32) for k, x in self.p.items()}
        self.n = {k: np.zeros(len(x), np.float32) for k, x in self.p.items()}
        self.upto, self.class_upto = (np.cumsum(x, dtype=np.float64) for x in (model.noise, model.class_noise))

    def drawn(self, upto: np.ndarray, n: int) -> np.ndarray:
        return np.minimum(np.searchsorted(upto, self.rng.random(n) * upto[-1]), len(upto) - 1)

    def update(self, rows: np.ndarray, **grads: np.ndarray) -> None:
        """Move rows by the sums of their gradients."""
        key = np.sort((rows.astype(np.int64) << 24) | np.arange(len(rows)))
        r, order = key >> 24, key & 0xFFFFFF
        first = np.flatnonzero(np.diff(r, prepend=-1))
        at, n = r[first], np.diff(first, append=len(r))
        for name, x in grads.items():
            g = np.add.reduceat(x.take(order, 0), first)
            seen = self.g[name].take(at, 0) + np.einsum("ij,ij->i", g, g)[:, None] / np.float32(g.shape[1])
            self.g[name][at] = seen
            g *= np.float32(RATE) / np.sqrt(seen)
            g += self.p[name].take(at, 0)
            self.p[name][at] = g
            self.n[name][at] += n

    def contrast(self, guess: np.ndarray, target: np.ndarray, noise: np.ndarray, vectors: str, biases: str) -> np.ndarray:
        """Move output rows of targets and noise; the gradient of the guesses. The shares cancel: a bias stands on top of them."""
        p, log_k, one = self.p, np.float32(np.log(len(noise))), np.float32(1 / len(target))
        own, drawn = p[vectors].take(target, 0), p[vectors].take(noise, 0)
        pull = one - sigmoid(np.einsum("bd,bd->b", guess, own) + p[biases].take(target) - log_k) * one
        push = guess @ drawn.T
        push += p[biases].take(noise) - log_k
        push = sigmoid(push)
        own *= pull[:, None]
        own -= push @ (drawn * one)
        move = np.empty((len(target) + len(noise), guess.shape[1]), np.float32)
        np.multiply(guess, pull[:, None], out=move[: len(target)])
        np.matmul(push.T, guess * -one, out=move[len(target) :])
        rows = np.concatenate([target, noise])
        self.update(rows, **{vectors: move, biases: np.concatenate([pull, push.sum(0) * -one])[:, None]})
        return own

    def step(self, target: np.ndarray, context: np.ndarray) -> None:
        p = self.p
        vectors, guess = guesses(p, context)
        back = self.contrast(guess, target, self.drawn(self.upto, NOISE), "outputs", "biases")
        back += self.contrast(guess, self.m.class_of.take(target), self.drawn(self.class_upto, CLASS_NOISE), "classes", "class_biases")
        places = np.einsum("bd,bkd->kd", back, vectors)
        self.update(context.ravel(), inputs=(back[:, None, :] * p["places"]).reshape(-1, DIMS))
        self.g["places"] += (places * places).mean(1, keepdims=True)
        p["places"] += RATE * places / np.sqrt(self.g["places"])
        self.n["places"] += len(target)


#: Parameters that travel, the vectors with their biases.
PARTS = [("inputs", None), ("outputs", "biases"), ("classes", "class_biases"), ("places", None)]
#: A row of the parameters on its way: place in its block, tokens that moved it, how far (vector and bias).
MOVED = np.dtype([("at", "<u2"), ("n", "<f4"), ("by", "<f2", DIMS + 1)])
MEAN = np.dtype([("at", "<u2"), ("by", "<f2", DIMS + 1)])


def trained_in_task(shared):
    """How far the texts of a task move the parameters, as rows (block, moved); rows that no token touches stay where they are."""

    def run(frames):
        model, trainer = shared.value, None
        end = int(model.symbols(np.array([END]), np.array([0]))[0])
        for frame in batches(frames, "text", 2_000_000):
            trainer = trainer or Trainer(model, 11)
            h, cls, ends = tokens(frame["text"].tolist())
            unique, first, where = np.unique(h, return_index=True, return_inverse=True)
            s = model.symbols(unique, cls[first])[where]
            c = contexts(s, ends, end)
            order = np.random.default_rng(len(s)).permutation(len(s))
            for a in range(0, len(s), BATCH):
                part = order[a : a + BATCH]
                trainer.step(s[part], c[part])
        if trainer:
            base = 0
            for name, bias in PARTS:
                rows = np.flatnonzero(trainer.n[name])
                cuts = np.flatnonzero(np.diff((base + rows) // BLOCK, prepend=-1))
                for part in np.split(rows, cuts[1:]):
                    if len(part):
                        moved = np.zeros(len(part), MOVED)
                        moved["at"], moved["n"] = (base + part) % BLOCK, trainer.n[name][part]
                        moved["by"][:, :DIMS] = trainer.p[name][part] - model.params[name][part]
                        if bias:
                            moved["by"][:, DIMS] = trainer.p[bias][part, 0] - model.params[bias][part, 0]
                        yield pd.DataFrame({"block": [int(base + part[0]) // BLOCK], "moved": [moved.tobytes()]})
                base += len(trainer.n[name])

    return run


def averaged(frames):
    """The mean move of every row, weighted by the tokens that moved it in each task; rows come in order of block, a block at a time is held."""
    block, n, by = None, None, None

    def mean():
        at = np.flatnonzero(n)
        out = np.zeros(len(at), MEAN)
        out["at"], out["by"] = at, by[at] / n[at, None]
        return pd.DataFrame({"block": [block], "moved": [out.tobytes()]})

    for frame in frames:
        for k, raw in zip(frame["block"].tolist(), frame["moved"]):
            if k != block:
                if block is not None:
                    yield mean()
                block, n, by = k, np.zeros(BLOCK), np.zeros((BLOCK, DIMS + 1))
            moved = np.frombuffer(raw, MOVED)
            n[moved["at"]] += moved["n"]
            by[moved["at"]] += moved["n"][:, None] * moved["by"].astype(np.float64)
    if block is not None:
        yield mean()


def train(model: Model, texts: DataFrame) -> Model:
    """The model after a round over all texts: every task trains from the same start, and each row of the parameters moves by the mean of its moves.

    A task sends the rows its own words touch; the driver gets each row once, however many tasks there are. The given model's
    parameters are changed in place.
    """
    made = texts.mapInPandas(trained_in_task(texts.sparkSession.sparkContext.broadcast(model)), "block int, moved binary")
    means = made.repartition("block").sortWithinPartitions("block").mapInPandas(averaged, "block int, moved binary")
    p, ends = model.params, np.cumsum([0] + [len(model.params[name]) for name, _ in PARTS])
    for block, raw in means.collect():
        moved = np.frombuffer(raw, MEAN)
        rows, by = block * BLOCK + moved["at"].astype(np.int64), moved["by"]
        for (name, bias), low, high in zip(PARTS, ends, ends[1:]):
            own = (rows >= low) & (rows < high)
            p[name][rows[own] - low] += by[own, :DIMS]
            if bias:
                p[bias][rows[own] - low, 0] += by[own, DIMS]
    return model


def log_sums(guess: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log of the sum of exp(guess . vector + bias) over all vectors, by one product; scores are shifted where they could overflow."""
    x = np.column_stack([guess, np.ones(len(guess), np.float32)]) @ np.column_stack([vectors, bias]).T
    top = np.float32(0)
    if (guess * guess).sum(1).max() ** 0.5 * (vectors * vectors).sum(1).max() ** 0.5 + np.abs(bias).max() > 80:
        top = x.max(1)
        x -= top[:, None]
    np.exp(x, out=x)
    return top + np.log(x @ np.ones(len(vectors), np.float32))


def log_probs(model: Model, s: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of symbols in context: of the symbol's class among all, then of the symbol in its class.

    Both are normalised over all scores of a product of matrices; symbols are taken class by class for the second.
    """
    p, out = model.params, np.empty(len(s), np.float32)
    class_bias = p["class_biases"][:, 0] + np.log(model.class_noise).astype(np.float32)
    bias = p["biases"][:, 0] + np.log(model.noise)
    at_place = [p["inputs"] * weights for weights in p["places"]]
    for a in range(0, len(s), AT_ONCE):
        part = s[a : a + AT_ONCE]
        guess = sum(table.take(column, 0) for table, column in zip(at_place, context[a : a + AT_ONCE].T))
        of = model.class_of.take(part)
        found = class_bias.take(of) + np.einsum("bd,bd->b", guess, p["classes"].take(of, 0))
        for b in range(0, len(part), BATCH):
            found[b : b + BATCH] -= log_sums(guess[b : b + BATCH], p["classes"], class_bias)
        many = np.flatnonzero(model.sizes.take(of) > 1)
        found[many] += bias.take(part[many]) + np.einsum("bd,bd->b", guess[many], p["outputs"].take(part[many], 0))
        order = many[np.argsort(of[many], kind="stable")]
        edges = np.searchsorted(of[order], np.arange(len(model.starts) + 1))
        for c in np.flatnonzero(np.diff(edges)):
            low, n = model.starts[c], model.sizes[c]
            step = max(1, 1_000_000 // n)
            for at in range(edges[c], edges[c + 1], step):
                rows = order[at : min(at + step, edges[c + 1])]
                found[rows] -= log_sums(guess[rows], p["outputs"][low : low + n], bias[low : low + n])
        out[a : a + AT_ONCE] = found
    return out


def scored(shared):
    def run(frames):
        model, freq_h, freq_c, n_types, class_log = shared.value
        end = int(model.symbols(np.array([END]), np.array([0]))[0])
        rare_symbol = np.isin(np.arange(len(model.noise)), model.rare)
        for frame in batches(frames, "text", 2_000_000):
            h, cls, ends = tokens(frame["text"].tolist())
            unique, first, where = np.unique(h, return_index=True, return_inverse=True)
            s = model.symbols(unique, cls[first])[where]
            per_token = log_probs(model, s, contexts(s, ends, end)).astype(np.float64) / np.log(10)
            at = np.minimum(np.searchsorted(freq_h, unique), max(len(freq_h) - 1, 0))
            hit = freq_h[at] == unique if len(freq_h) else np.zeros(len(unique), bool)
            c = np.where(hit, freq_c[at], 0)[where] if len(freq_h) else np.zeros(len(h), np.int64)
            term = np.log10(c + 1.0)
            other = rare_symbol[s]
            per_token[other] += term[other] - class_log[cls[other]]
            begin = np.concatenate([[0], ends[:-1]])
            rare = ~hit[where]
            lists = []
            for a, b in zip(begin, ends):
                lists.append(h[a:b][rare[a:b]])
            yield pd.DataFrame({
                "row": frame["row"].to_numpy(), "id": frame["id"].array, "held_out": frame["held_out"].to_numpy(), "n_tokens": ends - begin,
                "known": np.add.reduceat((c > 0).astype(np.int64), begin), "terms": np.add.reduceat(term, begin) - (ends - begin) * np.log10(n_types), "model": np.add.reduceat(per_token, begin), "rare": lists,
            })

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, frequent: int = FREQUENT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs; it learns from rows that are not held out.

    Tokens are the words, A-Z lower-cased, then an end. base_score adds log10((c + 1) / (N + V + 1)) over tokens. score is
    the model's log10 probability: of the symbol in its context, and for a word that is no symbol also of the word among
    those of its class, (c + 1) / (n + v + 1), so an unseen word of each class has the share of one. Every word with a
    training count of `least` (and of the root of the training tokens over SPARSE) or more is a symbol, as target and as
    context, however many these are.
    Words are told apart by 64-bit hashes. Null text is as empty: its end only. A null held_out counts as not. Without
    training rows all counts are 0. Repeated rows get a row each; other columns are not read; an empty table gives none.

    Counts cover all training rows: summed in tasks, then by shuffle. Training passes over all training rows once, a
    quarter of them first. Counts of the most frequent words and of all symbols go out to the tasks; those of all others
    are joined. The parameters of a symbol take some 140 bytes on the driver and in every task, twice that where it trains.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    folder = shared_folder(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = rows.where("NOT held_out")
    counts = training.select("text").mapInPandas(counted, "h long, cls int, c long").groupBy("h").agg(F.sum("c").alias("c"), F.min("cls").alias("cls"))
    counts = written(counts, folder, "counts")
    n, v = (x or 0 for x in total(counts, F.sum("c"), F.count("*")))
    least = max(least, int(n**0.5 / SPARSE))
    top = pd.concat([part.select("h", "c", "cls").toPandas() for part in (commonest(counts, frequent), counts.where(F.col("c") >= least))])
    top = top.drop_duplicates("h").astype({"h": np.int64, "c": np.int64, "cls": np.int64})
    by_class = counts.where("cls >= 0").groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas().set_index("cls").reindex(range(CLASSES), fill_value=0)
    symbols = top[(top["c"] >= least) | (top["h"] == END)]
    model = first_model(symbols, by_class["n"].to_numpy(np.float64), len(symbols) + CLASSES + 1)
    named = top[top["h"].isin(model.names) & (top["cls"] >= 0)].groupby("cls")["c"].agg(["sum", "count"]).reindex(range(CLASSES), fill_value=0)
    class_log = np.log10((by_class["n"] - named["sum"] + by_class["v"] - named["count"] + 1).to_numpy(np.float64))
    quarter = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    for part in (quarter, ~quarter):
        model = train(model, training.where(part).select("text"))

    top = top.sort_values("h")
    shared = spark.sparkContext.broadcast((model, top["h"].to_numpy(), top["c"].to_numpy(), n + v + 1, class_log))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(scored(shared), f"row long, id {id_type}, held_out boolean, n_tokens long, known long, terms double, model double, rare array<long>")
    out = written(out, folder, "scored")
    rare = out.select("row", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h")
    rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("sum"))
    out = out.drop("rare").join(rare, "row", "left")
    more, extra = F.coalesce("more", F.lit(0)), F.coalesce("sum", F.lit(0.0))
    return out.select(
        "id", "held_out", "n_tokens", (F.col("known") + more).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("terms") + extra).alias("base_score"), (F.col("model") + extra).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 2
    return score(docs, held_out).withColumnRenamed("id", "doc_id")
