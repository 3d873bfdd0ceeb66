"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, found by skipping along diagonals."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import shared_folder, table, total, written
from tracehound.llm.skew import rows_at_once
from tracehound.llm.token_counts import Tokenizer

#: Characters that are aligned at once, and segments of a lane; lanes are aligned side by side.
AT_ONCE, LANE = 500_000, 40
#: Both tokenizers start anew at a space between letters or digits, so texts are cut there into segments.
EDGE = re.compile(r"(?<=\w) (?=\w)")
#: Segments whose ids a task remembers.
REMEMBERED = 1_000_000
#: Characters of new segments that are encoded as one string.
TOGETHER = 4000
#: First probe along a diagonal; it doubles while everything agrees.
PROBE = 4
#: Pairs of ids whose counts go out to the tasks at once (some 17 bytes each). More pairs than that take more passes.
PAIRS = 4_000_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """One tokenizer with the bytes of each of its tokens and the digits of each id."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, t = tokenizer, tokenizer.load(plain=True)
        if tokenizer.library == "tokenizers":
            of, self.n = byte_characters(), t.get_vocab_size()
            entries = [t.id_to_token(i) or "" for i in range(self.n)]
            self.bytes = [bytes(of[c] for c in e) if all(c in of for c in e) else e.encode() for e in entries]
        else:
            self.n = t.vocab_size()
            self.bytes = [bytes([int(t.id_to_piece(i)[3:5], 16)]) if t.is_byte(i) else t.id_to_piece(i).replace("▁", " ").encode() for i in range(self.n)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part with a space before it."""
        t = self.tokenizer.load(plain=True)
        if self.tokenizer.library == "tokenizers":
            return [e.ids for e in t.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        return t.encode(parts, num_threads=1)


def digits(n: int, after: str) -> np.ndarray:
    """Ids below n in decimal with a character behind, a row each, padded with zero bytes."""
    width = len(str(max(n - 1, 0))) + 1
    return np.frombuffer(b"".join(f"{i}{after}".encode().ljust(width, b"\0") for i in range(n)), np.uint8).reshape(n, width)


def group_ends(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens end a group. a, b: rising byte ends of the tokens of both sides; lanes (from, to) end at the same byte.

    Every lane has a place i in a and j in b; its diagonal is the shift j - i. Along it, ends are compared in probes that
    double while all agree: stretches of one token to one. At the first difference the lane takes the side that is behind,
    token by token, until both end at one byte; that is a group, and the lane goes on with its new shift. All lanes step together.
    """
    cut_a, cut_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    i, j = a_from.copy(), b_from.copy()
    live = np.flatnonzero(i < a_to)
    while live.size:
        same, width = live, PROBE
        while same.size:
            step = np.arange(width)
            at_a, at_b = i[same, None] + step, j[same, None] + step
            inside = (at_a < a_to[same, None]) & (at_b < b_to[same, None])
            agree = inside & (a.take(at_a, mode="clip") == b.take(at_b, mode="clip"))
            full = agree.all(1)
            run = np.where(full, width, agree.argmin(1))
            on = step < run[:, None]
            cut_a[at_a[on]] = True
            cut_b[at_b[on]] = True
            i[same] += run
            j[same] += run
            same, width = same[full], 2 * width
        live = live[i[live] < a_to[live]]
        p, q = i[live], j[live]
        while True:
            ahead = a[p] - b[q]
            if not ahead.any():
                break
            p += ahead < 0
            q += ahead > 0
        cut_a[p] = True
        cut_b[q] = True
        i[live], j[live] = p + 1, q + 1
        live = live[i[live] < a_to[live]]
    return cut_a, cut_b


def linked(a: np.ndarray, b: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into a, into b) of all tokens that share a byte: every end on either side is the end of one shared stretch."""
    inner = np.flatnonzero(~cut_b)
    return np.concatenate([np.arange(len(a)), np.searchsorted(a, b[inner])]), np.concatenate([np.searchsorted(b, a), inner])


def dealt_out(side: Side, ids: list[int], text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids of a text with a space before it, and how many each of its segments has (bytes with the space before them); None if they don't fit."""
    if b"".join(map(side.bytes.__getitem__, ids)) != b" " + text.encode():
        return None
    flat = np.array(ids, np.int64)
    ends, stops = np.cumsum(side.length[flat]), np.cumsum(sizes)
    at = np.searchsorted(ends, stops)
    return (flat, np.diff(at + 1, prepend=0)) if (ends[at] == stops).all() else None


class Aligner:
    """Aligns texts in a task, some segments at a time, so that a text of any length takes bounded memory but for its distinct pairs."""

    def __init__(self, a: Tokenizer, b: Tokenizer) -> None:
        self.a, self.b = Side(a), Side(b)
        width = max(len(str(self.a.n)), len(str(self.b.n))) + 1
        tables = [digits(s.n, c) for s in (self.a, self.b) for c in (",", "|" if s is self.a else ";")]
        self.digits = np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in tables])
        self.cuts = a.cuts
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.wholes: list[np.ndarray] = [np.empty(0, bool)]
        self.held = [[[np.empty(0, np.int64)], [np.empty(0, np.int64)]] for _ in range(2)]  # by side: ids, and how many each segment has

    def learn(self, segments: list[str]) -> None:
        """Ids of new segments on both sides, and whether both give their bytes back.

        Segments without blanks or piece spaces at their ends are encoded many in a string, put together by spaces, and the
        ids dealt out by the bytes they cover; where these don't fit the segments, and for all others, one by one.
        """
        runs, alone, size = [[]], [], 0
        for x in segments:
            if self.cuts and x == x.strip() and "▁" not in x and len(x) < TOGETHER:
                runs[-1].append(x)
                size += len(x) + 1
                if size > TOGETHER:
                    runs.append([])
                    size = 0
            else:
                alone.append(x)
        runs = [r for r in runs if r]
        joined = [" ".join(r) for r in runs]
        sizes = [np.array([len(x.encode()) + 1 for x in r], np.int64) for r in runs]
        found = [s.ids(joined) if joined else [] for s in (self.a, self.b)]
        dealt = [[dealt_out(s, lists[k], joined[k], sizes[k]) for k in range(len(runs))] for s, lists in zip((self.a, self.b), found)]
        for k in range(len(runs)):
            if dealt[0][k] is None or dealt[1][k] is None:
                alone += runs[k]
            else:
                self.remember(runs[k], np.ones(len(runs[k]), bool), [d[k] for d in dealt])
        whole, parts = np.ones(len(alone), bool), []
        for s in (self.a, self.b):
            lists = s.ids(alone) if alone else []
            for x, (segment, ids) in enumerate(zip(alone, lists)):
                if b"".join(map(s.bytes.__getitem__, ids)) != b" " + segment.encode():
                    whole[x] = False
            parts.append((np.array([i for ids in lists for i in ids], np.int64), np.array([len(ids) for ids in lists], np.int64)))
        self.remember(alone, whole, parts)
        self.flat, self.count = ([np.concatenate(x[k]) for x in self.held] for k in (0, 1))
        self.held = [[[f], [c]] for f, c in zip(self.flat, self.count)]
        self.whole = np.concatenate(self.wholes)
        self.wholes = [self.whole]

    def remember(self, segments: list[str], whole: np.ndarray, parts: list[tuple]) -> None:
        for held, (flat, count) in zip(self.held, parts):
            held[0].append(flat)
            held[1].append(count)
        self.wholes.append(whole)
        for x in segments:
            self.known[x] = len(self.known)

    def pieces(self, text: str):
        """The text in pieces of AT_ONCE characters or so, cut at edges."""
        at = 0
        while self.cuts and len(text) - at > AT_ONCE and (edge := EDGE.search(text, at + AT_ONCE)):
            yield text[at : edge.start()]
            at = edge.end()
        yield text[at:]

    def columns(self, texts: list[str | None]) -> dict[str, list]:
        n = len(texts)
        self.sums = np.zeros((n, 4), np.int64)  # tokens of a and b, groups, links
        self.bad, self.pairs = np.zeros(n, bool), [([], []) for _ in range(n)]
        self.hash = [None] * n
        owner, held, size = [], [], 0
        for k, text in enumerate(texts):
            for piece in self.pieces(text) if text else ():
                segments = EDGE.split(piece) if self.cuts else [piece]
                held += segments
                owner.append((k, len(segments)))
                size += len(piece)
                if size > AT_ONCE:
                    self.add(owner, held)
                    owner, held, size = [], [], 0
        if held:
            self.add(owner, held)
        out = {name: np.where(self.bad, 0, self.sums[:, c]) for c, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        out["groups_sha256"] = ["" if bad or h is None else h.hexdigest() for bad, h in zip(self.bad, self.hash)]
        keys, times = zip(*[merged([], []) if bad else merged(*p) for bad, p in zip(self.bad, self.pairs)])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
        out["pairs"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
        out["times"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times).astype(np.int32)))
        return out

    def add(self, owner: list[tuple[int, int]], segments: list[str]) -> None:
        """Align segments, so many of each text in turn, and add what they hold to their texts."""
        if len(self.known) > REMEMBERED:
            self.forget()
        fresh = [s for s in dict.fromkeys(segments) if s not in self.known]
        if fresh:
            self.learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
        own, n = np.array(owner).T
        doc = np.repeat(own, n)
        self.bad[doc[~self.whole[at]]] = True
        rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        good = np.flatnonzero(~self.bad[doc])
        if not good.size:
            return
        doc, at, rank = doc[good], at[good], rank[good]
        tokens, ids = [], []
        for flat, count in zip(self.flat, self.count):
            each = count[at]
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            ids.append(flat[np.repeat((np.cumsum(count) - count)[at], each) + within])
            tokens.append(each)
        (each_a, each_b), (id_a, id_b) = tokens, ids
        a, b = np.cumsum(self.a.length[id_a]), np.cumsum(self.b.length[id_b])
        lane = np.flatnonzero((rank % LANE == 0) | (np.diff(doc, prepend=-1) != 0))
        count_a, count_b = np.add.reduceat(each_a, lane), np.add.reduceat(each_b, lane)
        doc_a, doc_b = np.repeat(doc, each_a), np.repeat(doc, each_b)
        to_a, to_b = np.cumsum(count_a), np.cumsum(count_b)
        cut_a, cut_b = group_ends(a, b, to_a - count_a, to_a, to_b - count_b, to_b)
        left, right = linked(a, b, cut_b)
        present, first_a = np.unique(doc_a, return_index=True)
        tallies = [np.bincount(d, minlength=len(self.sums)) for d in (doc_a, doc_b, doc_a[cut_a], doc_a[left])]
        self.sums += np.stack(tallies, 1)

        # Tokens in the order in which the groups are written: those of a, then those of b, group by group.
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        b_before = np.concatenate([[0], np.flatnonzero(cut_b) + 1])[group_a]
        a_until = (np.flatnonzero(cut_a) + 1)[group_b]
        written_as = np.empty(len(a) + len(b), np.int64)
        written_as[np.arange(len(a)) + b_before] = id_a + np.where(cut_a, self.a.n, 0)
        written_as[np.arange(len(b)) + a_until] = id_b + 2 * self.a.n + np.where(cut_b, self.b.n, 0)
        flat = self.digits[written_as]
        used = flat != 0
        text = flat[used]
        place = np.concatenate([[0], np.cumsum(used.sum(1))])
        first_b = np.searchsorted(doc_b, present)
        starts = place[first_a + first_b]
        for k, s, e in zip(present, starts, [*starts[1:], len(text)]):
            if self.hash[k] is None:
                self.hash[k] = hashlib.sha256()
            else:
                self.hash[k].update(b";")
            self.hash[k].update(text[s : e - 1])

        key = id_a[left] * self.b.n + id_b[right]
        both, times = np.unique((np.searchsorted(present, doc_a[left]) << 40) | key, return_counts=True)
        of, key = both >> 40, both & ((1 << 40) - 1)
        edge = np.searchsorted(of, np.arange(len(present) + 1))
        for x, k in enumerate(present):
            self.pairs[k][0].append(key[edge[x] : edge[x + 1]])
            self.pairs[k][1].append(times[edge[x] : edge[x + 1]])


def merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of times by key, in order of key."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0], times[0]
    keys, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy()[offsets[0] : offsets[-1]]


#: Distinct pairs that a task holds before it passes their counts on.
HELD = 2_000_000


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): links of each id pair over all texts; best: no pair with this id of b has more. Counts are summed in the tasks first."""

    def run(batches):
        keys, times, held = [], [], 0
        for batch in batches:
            _, k = lists(batch.column("pairs"))
            _, t = lists(batch.column("times"))
            keys.append(k)
            times.append(t.astype(np.int64))
            held += len(k)
            if held > 2 * HELD:
                k, t = merged(keys, times)
                if len(k) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t)], ["pair", "n"])
                    k, t = k[:0], t[:0]
                keys, times, held = [k], [t], len(k)
        k, t = merged(keys, times)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t)], ["pair", "n"])

    pairs = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = written(pairs.withColumn("b", F.col("pair") % size_b), shared_folder(aligned.sparkSession), "pairs")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, pairs: DataFrame, blocks: int, folder: str) -> DataFrame:
    """n_best and count_sum of every text. The counts go out in blocks, one pass over the texts' pairs for each; sums over blocks are sums over pairs."""
    spark = aligned.sparkSession
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]
    done = None
    for block in range(blocks):
        known = pairs.where(F.pmod(F.hash("pair"), F.lit(blocks)) == block).toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "n", "best")))

        def run(batches, sent=sent):
            key, n, best = sent.value
            for batch in batches:
                ends, k = lists(batch.column("pairs"))
                _, t = lists(batch.column("times"))
                at = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
                t = np.where(key[at] == k, t, 0).astype(np.int64) if len(key) else np.zeros(len(k), np.int64)
                sums = []
                for x in (best, n) if len(key) else (t, t):
                    upto = np.concatenate([[0], np.cumsum(t * x[at] if len(key) else t)])
                    sums.append(pa.array(upto[ends[1:]] - upto[ends[:-1]]))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + sums, [*rest, "n_best", "count_sum"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in rest) + ", n_best long, count_sum long"
        part = written(aligned.mapInArrow(run, schema), folder, f"scores{block}")
        sent.unpersist()
        if done is not None:
            sums = done.select("row", "n_best", "count_sum").unionByName(part.select("row", "n_best", "count_sum")).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
            part = written(part.drop("n_best", "count_sum").join(sums, "row"), folder, f"sums{block}")
        done = part
    return done


def alignments(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", most: int = PAIRS) -> DataFrame:
    """Per row: id_col, n_a, n_b (tokens of a space and the text), n_groups, n_links, n_best, count_sum, groups_sha256.

    file_a: a byte-level tokenizer (.json), file_b: a piece model (.model) that puts a space before a text itself. A group
    is the tokens between two bytes at which tokens of both end; a link is two tokens that share a byte; its count is how
    many links of the whole table join these two ids; it is best if no id of a has a higher count with its id of b.

    Each text is tokenized once; its groups and distinct id pairs are written to the shared folder. Pair counts are summed
    in the tasks, then over all, and go out to the tasks `most` at a time; more of them take more passes, so memory is
    bounded whatever the vocabularies. Null and empty texts, and texts that either side does not give back byte for byte (a
    literal piece space), have zeros and an empty hash. Long texts are aligned lane by lane. Null and repeated ids keep a row
    each; other columns are left out, whatever their names. An empty table gives none.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    a, b = Tokenizer(file_a), Tokenizer(file_b)
    sent, size_b = spark.sparkContext.broadcast((a, b)), Side(b).n
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[f"`{id_col}`"].alias("_id"), docs[f"`{text_col}`"].alias("text"))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(*sent.value)
            if batch.num_rows:
                out = aligner.columns(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("_id")] + [x if isinstance(x := out[c], pa.Array) else pa.array(x) for c in names], ["row", "_id", *names])

    with rows_at_once(spark):
        made = rows.mapInArrow(run, f"row long, _id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
        made.write.option("compression", "zstd").parquet(f"{folder}/aligned")
        aligned = spark.read.schema(made.schema).parquet(f"{folder}/aligned")
        pairs = written(pair_counts(aligned, size_b), folder, "best")
        blocks = max(1, -(-total(pairs, F.count("*"))[0] // most))
        out = scored(aligned, pairs, blocks, folder)
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
