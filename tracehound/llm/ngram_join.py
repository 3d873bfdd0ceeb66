"""N-gram Jaccard join: exact blocking by partition signatures, then signature trees inside each block."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehound.llm.common import batches, commonest, partitions, shared_folder, table, total, word_count, written
from tracehound.llm.components import components
from tracehound.llm.shingles import U, mix, shingle_sets

SHINGLE = 4
PERCENT = 85
#: Members of a family compared in one task (half as many more at most); larger families are compared by pairs of blocks.
BLOCK = 1024
#: Bytes of shingles that are dealt at once for comparison: these, or half of all sets if that is more.
AT_ONCE = 2**28
FANOUT = 8
#: Bits of the bitmaps by which strangers with a signature in common are told apart, and the sets of a signature up to which they are.
BITS = 1024
STAR = 256
#: Common shingles (8 bytes each) at most that go out to all tasks, and the number of sets from which one counts.
COMMON = 65_536
COMMON_LEAST = 50
#: Members of families (some 50 bytes each) up to which their table is broadcast to the texts; beyond it, texts join by shuffle.
BROADCAST_ROWS = 400_000


# Partition signatures. Two linked sets differ in at most d shingles, so if their shingles are dealt over more than d
# parts by their hash, some part is the same in both. A link is never missed, and sets that agree on a whole part are
# mostly copies, so the families of sets that share signatures are small and hold few strangers. Shingles of passages
# that very many texts hold would make strangers agree on a part that has nothing else. Leaving any fixed list of
# shingles out of all sets never adds a difference, so sets with few of them are dealt without them; sets made of them
# for a fifth or more are dealt with all. Links across that border are kept: sets near it are dealt both ways.


@cache
def bands(percent: int, upto: int) -> list[tuple[int, int, int, int]]:
    """Size bands (lowest, next lowest, most differences of a linked pair, parts), with sizes up to `upto`."""
    out, low = [], 1
    while low <= upto:
        high = max(low + 1, low * 3 // 2)
        d = (100 - percent) * 2 * (high - 1) // (100 + percent)
        parts = d + 4 + int(2 * (d + 4) * exp(-0.66 * low * percent / 100 / (d + 4)))  # with room for empty parts
        out.append((low, high, d, parts))
        low = high
    return out


def signatures(s: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """Signatures of a set: of the parts in its own band, and in the next if a larger partner can be there."""
    n = len(s)
    common = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(n, bool)
    excess = 5 * int(common.sum()) - n  # above 0 for sets with more than a fifth of common shingles
    differ = (100 - percent) * (n + 100 * n // percent) // (100 + percent)  # from any linked set, so the excess differs by 4 times that at most
    dealt = [(0, s[~common])] if excess <= 4 * differ else []
    if excess > 0:
        dealt.append((1, s))
    out = []
    for k, (low, high, d, parts) in enumerate(bands(percent, 1 << (2 * n).bit_length())):
        if not (low <= n < high or n < low and 100 * n >= percent * low) or d == 0:
            continue
        for way, t in dealt:
            h = mix(t + U(1 + way))
            part = (mix(h + U(k)) >> U(11)) % U(parts)
            order = np.argsort(part, kind="stable")
            name, first = np.unique(part[order], return_index=True)
            salt = U(2 * k + way) * U(1_000_003)
            if len(name):
                out.append(mix(np.add.reduceat(h[order], first) + mix(name + salt)))
            if len(name) <= d:  # so many empty parts that they alone could be what is the same
                empty = np.setdiff1d(np.arange(parts, dtype=U), name)
                out.append(mix(mix(empty + salt) ^ U(0xE3779B97F4A7C15)))
    return np.concatenate(out) if out else np.empty(0, U)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    return tuple(int(mix(np.add.reduce(mix(s + U(k)), keepdims=True) + U(len(s))).view(np.int64)[0]) for k in (7, 11))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    at = s % U(bits)
    out = np.zeros(bits // 64, U)
    np.bitwise_or.at(out, (at >> U(6)).astype(np.intp), U(1) << (at & U(63)))
    return out


def described(size: int):
    """Id, size, digest and bitmap of each text's set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", 2_000_000):
            rows = [(len(s), *digest(s), bitmap(s, BITS).tobytes()) for s in shingle_sets(frame["text"].tolist(), size)]
            out = pd.DataFrame(rows, columns=["n", "d1", "d2", "map"])
            out.insert(0, "id", frame["id"].array)
            yield out

    return run


def repeated(size: int):
    """Shingles that are in two or more different sets of a stretch of a task's texts, with their number there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counts(held: dict) -> pd.DataFrame:
            s, c = np.unique(np.concatenate(list(held.values())), return_counts=True)
            return pd.DataFrame({"s": s[c > 1].view(np.int64), "c": c[c > 1]})

        held, rows = {}, 0
        for frame in batches(frames, "text", 2_000_000):
            for s in shingle_sets(frame["text"].tolist(), size):
                if len(s) and (key := digest(s)[0]) not in held:
                    held[key] = s
                    rows += len(s)
            if rows > 2_000_000:
                yield counts(held)
                held, rows = {}, 0
        if held:
            yield counts(held)

    return run


def common_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """The shingles in most sets, COMMON at most. Which ones they are matters for speed only, so counts may be low."""
    counts = texts.select("text").mapInPandas(repeated(size), "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    counts = written(counts.where(F.col("c") >= COMMON_LEAST), shared_folder(texts.sparkSession), "common")
    top = commonest(counts, COMMON).select("s").toPandas()["s"]
    return np.sort(top.to_numpy(np.int64).view(U))


def marked(size: int, percent: int, shared):
    """Signatures of each text's set, by digest; of equal sets of a batch only the first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot = shared.value
        for frame in batches(frames, "text", 2_000_000):
            sets = {digest(s)[0]: s for s in shingle_sets(frame["text"].tolist(), size) if len(s)}
            yield pd.DataFrame({"d1": list(sets), "marks": [signatures(s, percent, hot).view(np.int64) for s in sets.values()]})

    return run


# Signature trees.


def linked(a: int, b: int, common, percent: int):
    return 100 * common >= percent * (a + b - common)


class Tree:
    """Sets in order of size as leaves; each node has the OR of its sets' bitmaps, its range of sizes and the largest excess of a set over its bits."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        n, words = len(sets), bits // 64
        maps = np.zeros((n, words), U)
        for i, s in enumerate(sets):
            maps[i] = bitmap(s, bits)
        size = np.array([len(s) for s in sets])
        over = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, size, size, over)]
        while n > 1:
            cuts = np.arange(0, n, FANOUT)
            maps, low, high, over = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(over, cuts)))
            n = len(cuts)


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some set below node i and some below node j can be linked: by their sizes, then by the most they can have in common."""
    (maps_a, low_a, high_a, over_a), (maps_b, low_b, high_b, over_b) = a, b
    ok = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    at = np.flatnonzero(ok)
    for c in range(0, len(at), 65_536):
        p = at[c : c + 65_536]
        x, y = i[p], j[p]
        common = np.bitwise_count(maps_a[x] & maps_b[y]).sum(1).astype(np.int64) + np.minimum(over_a[x], over_b[y])
        ok[p] = (100 + percent) * common >= percent * (low_a[x] + low_b[y])
    return ok


def dual_traversal(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that no bound rules out, some at a time; with a is b each pair once. Levels of both trees go down together."""
    same = a is b
    depth = max(len(a.levels), len(b.levels)) - 1
    one = np.zeros(1, np.int64)
    stack = [(depth, one, one)]
    while stack:
        level, i, j = stack.pop()
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        ok = may_link(la, i, lb, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue

        def below(tree: Tree, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if level > len(tree.levels) - 1:  # the shorter tree waits at its root
                return node, np.ones(len(node), np.int64)
            first = node * FANOUT
            return first, np.minimum(FANOUT, len(tree.levels[level - 1][1]) - first)

        (fi, ni), (fj, nj) = below(a, i), below(b, j)
        many = ni * nj
        rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        x = np.repeat(fi, many) + rank // np.repeat(nj, many)
        y = np.repeat(fj, many) + rank % np.repeat(nj, many)
        if same:
            x, y = x[x <= y], y[x <= y]
        for c in range(0, len(x), 262_144):
            stack.append((level - 1, x[c : c + 262_144], y[c : c + 262_144]))


class Forest:
    """Disjoint sets with the smallest member as name."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def names(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def joined(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> np.ndarray:
    """For each set the smallest index it is connected with by links. side 0 or 1: only links between the sides are sought, None: all.

    One set is compared with all others at once, which joins most of a group of copies; then the trees are traversed,
    and pairs that are joined already are not compared again.
    """
    n = len(sets)
    forest = Forest(n)
    size = np.array([len(s) for s in sets])
    flat, ends = np.concatenate(sets), np.cumsum(size)
    owner = np.repeat(np.arange(n), size)
    for pivot in {0, n // 2}:
        at = np.searchsorted(sets[pivot], flat)
        hit = sets[pivot][np.minimum(at, size[pivot] - 1)] == flat
        common = np.bincount(owner[hit], minlength=n)
        near = np.flatnonzero(linked(size, size[pivot], common, percent))
        for i in near:
            forest.join(i, pivot)
    del owner, ends
    if len(np.unique(forest.names())) == 1 or side is not None and len(np.unique(side)) < 2:
        return forest.names()
    bits = 1 << max(8, int(2 * np.median(size)).bit_length())
    if side is None:
        order_a = order_b = np.argsort(size, kind="stable")
    else:
        order_a, order_b = (at[np.argsort(size[at], kind="stable")] for at in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)))
    a = Tree([sets[i] for i in order_a], bits)
    b = a if side is None else Tree([sets[i] for i in order_b], bits)
    for i, j in dual_traversal(a, b, percent):
        i, j = order_a[i], order_b[j]
        names = forest.names()
        apart = names[i] != names[j]
        for x, y in zip(i[apart], j[apart]):
            if forest.find(x) != forest.find(y):
                s, t = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                if linked(len(s), len(t), common, percent):
                    forest.join(x, y)
    return forest.names()


def plausible(percent: int):
    """Rows (mark, d1, n, map) in order of mark: edges (a, b) that connect all sets of a signature that their bitmaps allow to be linked.

    A signature of more than STAR sets stands for a large group of copies; all its sets are connected as they are.
    """

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        d, n = pdf["d1"].to_numpy(), pdf["n"].to_numpy()
        maps = np.frombuffer(b"".join(pdf["map"]), U).reshape(len(pdf), -1)
        node = (maps, n, n, n - np.bitwise_count(maps).sum(1).astype(np.int64))
        first = np.flatnonzero(np.diff(pdf["mark"].to_numpy(), prepend=~pdf["mark"].iloc[0]))
        count = np.diff(first, append=len(pdf))
        a, b = [], []
        i = first[count == 2]
        ok = may_link(node, i, node, i + 1, percent)
        a.append(d[i[ok]])
        b.append(d[i[ok] + 1])
        for start, size in zip(first[count > 2], count[count > 2]):
            if size > STAR:
                a.append(d[start : start + size])
                b.append(np.full(size, d[start]))
                continue
            x, y = np.triu_indices(size, 1)
            ok = may_link(node, start + x, node, start + y, percent)
            forest = Forest(size)
            for p, q in zip(x[ok], y[ok]):
                forest.join(p, q)
            a.append(d[start : start + size])
            b.append(d[start + forest.names()])
        out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
        return out[out["a"] != out["b"]].drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            last = frame["mark"].iloc[-1]
            done = frame["mark"] != last
            if done.any():
                yield edges(pd.concat([*held, frame[done]]))
                held = []
            elif held and held[-1]["mark"].iloc[-1] != last:
                yield edges(pd.concat(held))
                held = []
            held.append(frame[~done])
        if held:
            yield edges(pd.concat(held))

    return run


def families_joined(percent: int):
    """Rows (key, side, id, shingles) in order of key: (a, b), each id with another it is connected with by links inside its group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(key: str, rows: list[tuple]) -> pd.DataFrame:
            sets = [np.frombuffer(r[2], U) for r in rows]
            names = joined(sets, None if key.endswith("=") else np.array([r[0] for r in rows]), percent) if len(rows) > 1 else np.zeros(1, int)
            ids = np.array([r[1] for r in rows], np.int64)
            return pd.DataFrame({"a": ids, "b": ids[names]})

        key, held, done = None, [], []
        for frame in frames:
            for k, side, i, s in zip(frame["key"], frame["side"], frame["id"], frame["shingles"]):
                if k != key:
                    if len(held) > 1:
                        done.append(solved(key, held))
                        if len(done) >= 500:
                            yield pd.concat(done)
                            done = []
                    key, held = k, []
                held.append((side, i, s))
        if len(held) > 1:
            done.append(solved(key, held))
        if done:
            yield pd.concat(done)

    return run


def sets_of(size: int):
    """The shingle sets, as bytes, of rows whose set has the digest that the row names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", 2_000_000):
            sets = shingle_sets(frame["text"].tolist(), size)
            same = [digest(s)[0] == d for s, d in zip(sets, frame["d1"])]
            out = frame[["key", "side", "id"]].assign(shingles=[s.tobytes() for s in sets])
            yield out[same]

    return run


def paired_blocks(members: DataFrame, percent: int) -> DataFrame:
    """(rep, d1, n, key, side) for members (rep, d1, n, family) of families of two or more, once for each pair of blocks they are compared in.

    The blocks of a family are steps of its sizes, cut by hash where one size has more members than a block. Sets that
    link have sizes in the ratio `percent` at least, so only blocks with sizes that near are paired; a family's members
    are dealt to the blocks of like size, not to all.
    """
    of_family = Window.partitionBy("family")
    sizes = members.groupBy("family", "n").agg(F.count("*").alias("rows")).withColumn("all", F.sum("rows").over(of_family)).where("all > 1")
    sizes = sizes.withColumn("step", F.floor((F.sum("rows").over(of_family.orderBy("n")) - F.col("rows")) / BLOCK))
    of_step = Window.partitionBy("family", "step")
    sizes = sizes.withColumn("parts", F.greatest(F.lit(1), F.round(F.sum("rows").over(of_step) / BLOCK)).cast("int"))
    steps = sizes.groupBy("family", "step", "parts").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    blocks = steps.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    other = blocks.select(F.col("family").alias("f"), *[F.col(c).alias(f"other_{c}") for c in ("step", "part", "least")])
    later = F.struct("step", "part") <= F.struct("other_step", "other_part")
    pairs = blocks.join(other, (F.col("family") == F.col("f")) & later & (100 * F.col("most") >= percent * F.col("other_least")))
    same = (F.col("step") == F.col("other_step")) & (F.col("part") == F.col("other_part"))
    key = F.concat_ws("/", "family", "step", "part", "other_step", "other_part", F.when(same, "=").otherwise(""))
    pairs = pairs.select("family", "step", "part", "other_step", "other_part", same.alias("same"), key.alias("key"))
    first = pairs.select("family", "step", "part", "key", F.lit(0).alias("side"))
    second = pairs.where("NOT same").select("family", F.col("other_step").alias("step"), F.col("other_part").alias("part"), "key", F.lit(1).alias("side"))
    own = members.join(sizes.select("family", "n", "step", "parts"), ["family", "n"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    return own.join(first.unionByName(second), ["family", "step", "part"]).select("rep", "d1", "n", "key", "side")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs; component_id is the smallest id reachable by links, itself included.

    A text's set has its distinct shingles of `size` words, A-Z lower-cased; a text of fewer words is one shingle. Two
    texts link when 100 * common >= percent * all shingles of both. Null texts and texts without words have an empty set
    and link with nothing. Rows with the same id are one node of the graph. Other columns are not read. An empty table
    gives none.

    Equal sets become one class. Classes that share a partition signature form families (exact: no link is lost);
    inside a family, signature trees find the pairs that can be linked, and those not yet connected are compared
    shingle by shingle. A family too large for a task is compared by pairs of blocks of like sizes, a bounded share of
    the pairs at a time. Nothing is capped.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    sets = written(texts.mapInPandas(described(size), "id long, n int, d1 long, d2 long, map binary"), folder, "sets")
    classes = written(sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), folder, "classes")
    maps = sets.where("n > 0").join(classes.select(F.col("d1").alias("_d"), "rep"), (F.col("id") == F.col("rep")) & (F.col("d1") == F.col("_d"))).select("d1", "n", "map")
    maps = maps.groupBy("d1").agg(F.first("n").alias("n"), F.first("map").alias("map"))

    shared = spark.sparkContext.broadcast(common_shingles(texts, size))
    marks = texts.mapInPandas(marked(size, percent, shared), "d1 long, marks array<long>").select("d1", F.explode("marks").alias("mark"))
    by_mark = Window.partitionBy("mark")
    agreed = marks.withColumn("low", F.min("d1").over(by_mark)).withColumn("high", F.max("d1").over(by_mark)).withColumn("all", F.bit_xor(F.xxhash64("d1")).over(by_mark)).where("low != high")
    # Signatures that the same sets share are one, as copies share hundreds. Were others taken for one too, their sets would only be compared without need.
    agreed = written(agreed.select(F.xxhash64("low", "high", "all").alias("mark"), "d1").distinct(), folder, "agreed")
    agreed = agreed.join(maps, "d1").select("mark", "d1", "n", "map").repartition(partitions(spark), "mark").sortWithinPartitions("mark", "d1")
    family = components(agreed.mapInPandas(plausible(percent), "a long, b long"))
    members = written(classes.join(family, F.col("d1") == F.col("node")).select("rep", "d1", "n", F.col("component").alias("family")), folder, "members")
    dealt = written(paired_blocks(members, percent), folder, "dealt")

    # Blocks of a large family meet many others, so its sets are dealt a share at a time; the disk holds one share.
    held, whole = (8 * (total(f, F.sum(F.col("n").cast("long")))[0] or 0) for f in (dealt, classes))
    shares = max(1, ceil(held / max(AT_ONCE, whole / 2)))
    share = F.pmod(F.xxhash64("key"), F.lit(shares))
    links = None
    for k, rows in sorted((r[0], r[1]) for r in dealt.groupBy(share).count().collect()):  # a row per share
        of_share = dealt.where(share == k)
        found = texts.join(F.broadcast(of_share) if rows <= BROADCAST_ROWS else of_share, F.col("id") == F.col("rep")).select("id", "text", "d1", "key", "side")
        pairs = found.mapInPandas(sets_of(size), "key string, side int, id long, shingles binary")
        pairs = pairs.repartition(partitions(spark), "key").sortWithinPartitions("key")
        part = written(pairs.mapInPandas(families_joined(percent), "a long, b long"), folder, f"links{k}")
        links = part if links is None else links.unionByName(part)
    labels = components(spark.createDataFrame([], "a long, b long") if links is None else links)

    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("_n"), F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.coalesce("component", "rep").alias("component"))
    out = sets.select("id", "n", "d1", "d2").join(named, (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id.

    A row goes only if its own text is in a group that keeps another. Where ids repeat or are missing, rows are told
    apart by id and text: of rows that share both, the first by a digest of all columns stays; rows that share an id but
    have texts that do not link all stay; rows without an id come last in the choice. Rows without words all stay.
    """
    again = docs.groupBy(docs[id_col].alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1 OR _id IS NULL")
    if again.isEmpty():
        groups = jaccard_groups(docs, id_col, text_col, **options)
        firsts = groups.where("id = component_id").select(F.col("id").alias("_id"))
        return docs.join(firsts, docs[id_col] == firsts["_id"], "left_semi")
    folder = shared_folder(docs.sparkSession)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    rows = docs.select(row, docs[id_col].alias("id"), docs[text_col].alias("text"))
    wordy = word_count(F.col("text")) > 0
    # Numbers in order of id; the order is total over distinct rows, and written once.
    numbered = rows.where(wordy).groupBy("id", F.sha2("text", 256).alias("digest")).agg(F.min_by("doc", F.sha2(F.to_json("doc"), 256)).alias("doc"))
    numbered = numbered.sort(F.col("id").asc_nulls_last(), "digest").select(F.monotonically_increasing_id().alias("key"), "doc")
    numbered = written(numbered, folder, "numbered")
    groups = jaccard_groups(numbered.select("key", F.col(f"doc.`{text_col}`").alias("text")), "key", "text", **options)
    kept = numbered.join(groups.where("id = component_id").select(F.col("id").alias("key")), "key", "left_semi")
    return kept.select("doc.*").unionByName(rows.where(~wordy).select("doc.*"))


def query(spark, sf_dir: str) -> DataFrame:
    out = jaccard_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def twin(table_name: str, size: int, percent: int) -> str:
    """SQL of (id, n_shingles, component_id) for a table or CTE with doc_id and text; shingles are joined pair by pair, so for small tables only."""
    nxt = "".join(f" || ' ' || lead(w, {k}) OVER o" for k in range(1, size))
    return rf"""
j_d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {table_name}),
j_w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM j_d),
j_g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w{nxt} AS g FROM j_w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL
      UNION SELECT doc_id, array_to_string(ws, ' ') FROM j_d WHERE len(ws) BETWEEN 1 AND {size - 1}),
j_n AS (SELECT doc_id, count(*) AS n FROM j_g GROUP BY doc_id),
j_c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM j_g a JOIN j_g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
j_l AS (SELECT a, b FROM j_c JOIN j_n x ON x.doc_id = a JOIN j_n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
j_e AS (SELECT a, b FROM j_l UNION SELECT b, a FROM j_l),
j_r AS (SELECT doc_id, doc_id AS root FROM j_d UNION SELECT j_e.b, j_r.root FROM j_r JOIN j_e ON j_e.a = j_r.doc_id),
j_m AS (SELECT doc_id, min(root) AS component_id FROM j_r GROUP BY doc_id)"""


SQL = f"""
WITH RECURSIVE {twin("documents", SHINGLE, PERCENT)}
SELECT j_d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM j_d LEFT JOIN j_n USING (doc_id) JOIN j_m USING (doc_id)
"""
