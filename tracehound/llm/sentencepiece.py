"""SentencePiece encoding and decoding by suffix-array matching of the vocabulary over a batch of texts."""

from __future__ import annotations

import heapq
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracehound.llm.common import arrow_map, table

SPACE = "▁"
#: Characters that are indexed at once.
BLOCK = 262_144
#: Segments a task remembers between batches, some 200 bytes each.
REMEMBERED = 1_000_000
#: Segments up to this length are merged side by side, longer ones one by one with a heap.
SHORT = 48


class Vocabulary:
    """The pieces of a model file (BPE with byte fallback), ready for matching: packed four characters to a 64-bit key."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=os.fspath(model_file))
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        plain = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
        chars = sorted({ord(c) for i in plain for c in self.pieces[i]})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[chars] = np.arange(1, len(chars) + 1)
        self.ids = np.array(plain, np.int32)
        self.width = max(len(self.pieces[i]) for i in plain)
        self.length = np.array([len(self.pieces[i]) for i in plain])
        padded = np.zeros((len(plain), -(-self.width // 4) * 4), np.uint16)
        for row, i in enumerate(plain):
            padded[row, : self.length[row]] = self.code[[ord(c) for c in self.pieces[i]]]
        full = np.where(np.arange(padded.shape[1]) < self.length[:, None], padded, np.uint16(0xFFFF))
        self.low, self.high = packed(padded), packed(full)
        #: Merge order of a piece: better scores first, equal scores alike. The last entry stands for no piece.
        scores = np.array([-sp.get_score(int(i)) for i in plain])
        self.order = np.full(n + 1, np.iinfo(np.int32).max, np.int32)
        self.order[self.ids] = np.unique(scores, return_inverse=True)[1]
        #: A text may be cut before each run of spaces, as long as no piece has a space behind another character.
        inner = any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in plain)
        self.segment = re.compile("(?s).+" if inner else f"{SPACE}+[^{SPACE}]*")
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]


def packed(codes: np.ndarray) -> np.ndarray:
    """Columns of four 16-bit codes as one 64-bit number each, first code highest."""
    c = codes.astype(np.uint64).reshape(len(codes), -1, 4)
    return ((c[:, :, 0] << np.uint64(48)) | (c[:, :, 1] << np.uint64(32)) | (c[:, :, 2] << np.uint64(16)) | c[:, :, 3]).T.copy()


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text in order of the `depth` codes (a multiple of four) from there on, and their keys in that order."""
    long = np.concatenate([codes, np.zeros(depth, np.uint16)]).astype(np.uint64)
    n = len(codes)
    four = (long[:-3] << np.uint64(48)) | (long[1:-2] << np.uint64(32)) | (long[2:-1] << np.uint64(16)) | long[3:]
    keys = np.stack([four[k : k + n] for k in range(0, depth, 4)])
    order = np.lexsort(keys[::-1])
    return order, keys[:, order]


def occurrences(keys: np.ndarray, want: np.ndarray, side: str) -> np.ndarray:
    """For each wanted key (columns) the first place in the sorted keys that is not below it (left) or is above it (right)."""
    low, high = np.searchsorted(keys[0], want[0], "left"), np.searchsorted(keys[0], want[0], "right")
    for k in range(1, len(keys)):
        a, b = (_bisect(keys[k], low, high, want[k], s) for s in ("left", "right"))
        low, high = a, b
    return low if side == "left" else high


def _bisect(column: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, side: str) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) >> 1
        up = column[mid] < want[open_] if side == "left" else column[mid] <= want[open_]
        low[open_] = np.where(up, mid + 1, low[open_])
        high[open_] = np.where(up, high[open_], mid)
    return low


def edges(v: Vocabulary, text: str) -> np.ndarray:
    """Table of (place, length) -> id of the piece that stands there, -1 for none.

    Every piece is sought in the suffix array of the whole text by two binary searches; all its occurrences lie between.
    The edges found are then put in order of place.
    """
    codes = v.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    order, keys = suffix_array(codes, 4 * len(v.low))
    first, last = occurrences(keys, v.low, "left"), occurrences(keys, v.high, "right")
    count = np.maximum(last - first, 0)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = order[np.repeat(first, count) + rank]
    out = np.full((len(codes) + v.width + 1, v.width + 1), -1, np.int32)
    out[at, np.repeat(v.length, count)] = np.repeat(v.ids, count)
    return out


def _merge_alike(v: Vocabulary, e: np.ndarray, base: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the symbols that start at each place, for segments of n characters that start at `base`."""
    size = np.ones((len(base), n), np.int64)
    place = np.arange(n)
    live = np.arange(len(base))
    none = v.order[-1]
    while n > 1 and len(live):
        ln = size[live]
        nxt = np.minimum(place + ln, n - 1)
        both = ln + np.take_along_axis(ln, nxt, 1)
        ok = (ln > 0) & (place + ln < n) & (both <= v.width)
        r = np.where(ok, v.order[e[base[live][:, None] + place, np.where(ok, both, 0)]], none)
        best = r.argmin(1)
        row = np.arange(len(live))
        more = r[row, best] < none
        live, row, best = live[more], row[more], best[more]
        size[live, nxt[row, best]] = 0
        size[live, best] = both[row, best]
    return size


def _merge_one(v: Vocabulary, e: np.ndarray, base: int, n: int) -> np.ndarray:
    """As _merge_alike for one long segment, with a heap of pairs."""
    size, before = [1] * n, list(range(-1, n - 1))
    none = v.order[-1]
    order = v.order
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = i + size[i]
        if i >= 0 and j < n and size[i] + size[j] <= v.width and (r := order[e[base + i, size[i] + size[j]]]) < none:
            heapq.heappush(heap, (int(r), i, size[i], size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = i + a
        if size[i] != a or j >= n or size[j] != b:
            continue
        size[i], size[j] = a + b, 0
        if i + size[i] < n:
            before[i + size[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return np.array(size)


class Coder:
    """Encodes and decodes in a task. Segments already encoded are remembered, up to a bound."""

    def __init__(self, model_file: str) -> None:
        self.model_file, self.v = model_file, None

    def __getstate__(self):
        return {"model_file": self.model_file, "v": None}

    def load(self) -> Vocabulary:
        if self.v is None:
            self.v = Vocabulary(self.model_file)
            self.forget()
        return self.v

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, segments: list[str]) -> None:
        """Encode new segments and remember them."""
        v = self.v
        block, held = [], 0
        for s in [*segments, None]:
            if block and (s is None or held + len(s) > BLOCK):
                flat, count = self.relax(block)
                self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
                self.count = np.concatenate([self.count, count])
                self.flat = np.concatenate([self.flat, flat])
                for x in block:
                    self.known[x] = len(self.known)
                block, held = [], 0
            if s is not None:
                block.append(s)
                held += len(s) + 1
        assert v is not None

    def relax(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, one after the other, and how many each has: adjacent symbols merge along edges, best score first, leftmost first among equals."""
        v = self.v
        text = "\x00".join(block)
        e = edges(v, text)
        n = np.array([len(s) for s in block])
        base = np.cumsum(n + 1) - n - 1
        size = np.zeros(len(text) + 1, np.int64)
        for k in np.unique(n):
            rows = np.flatnonzero(n == k)
            if k <= SHORT:
                size[base[rows][:, None] + np.arange(k)] = _merge_alike(v, e, base[rows], int(k))
            else:
                for r in rows:
                    size[base[r] : base[r] + k] = _merge_one(v, e, int(base[r]), int(k))
        at = np.flatnonzero(size)
        ids = e[at, np.minimum(size[at], v.width)]
        owner = np.searchsorted(base, at, "right") - 1
        lost = np.flatnonzero(ids < 0)
        times = np.ones(len(at), np.int64)
        raw = [text[i].encode() for i in at[lost]]
        times[lost] = [len(r) for r in raw]
        out = np.repeat(ids, times)
        if len(lost):
            start = np.cumsum(times) - times
            spots = np.concatenate([np.arange(start[i], start[i] + times[i]) for i in lost])
            out[spots] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(owner, weights=times, minlength=len(block)).astype(np.int64)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the ends of each; null is as empty."""
        v = self.load()
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = [v.segment.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        every = [*chain.from_iterable(cut)]
        self.learn([s for s in dict.fromkeys(every) if s not in self.known])
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        count = self.count[at]
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        flat = self.flat[np.repeat(self.begin[at], count) + rank]
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([len(s) for s in cut])] if cut else np.empty(0, np.int64)
        return flat, ends

    def decode(self, ids) -> str:
        """The text of ids: the space that encoding puts in front goes, bytes that are no UTF-8 become replacement characters."""
        raw = self.load().raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def columns(self, texts: list) -> dict:
        flat, ends = self.encode(texts)
        begins = np.concatenate([[0], ends[:-1]])
        same = []
        for t, a, b in zip(texts, begins, ends):
            same.append(self.decode(flat[a:b].tolist()) == (t or ""))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return {"ids": pa.ListArray.from_arrays(offsets, pa.array(flat)), "n_tokens": (ends - begins).tolist(), "same": same}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, text_col: str = "text", model_file: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all but the text, if None), then ids array<int>, n_tokens, same (whether the ids decode to the text).

    model_file must be readable at that path on every executor. Null text is as empty: no ids, decodes to nothing.
    Texts are encoded whole. A text that holds the space mark itself decodes to a space there, so `same` is false.
    An empty table gives none; repeated rows a row each.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    coder = Coder(model_file or default_model())
    return arrow_map(docs, text_col, coder.columns, "ids array<int>, n_tokens long, same boolean", keep=keep)


def decoded(rows: DataFrame, ids_col: str = "ids", model_file: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Columns `keep` and the text of each row's ids; null ids are as none."""
    coder = Coder(model_file or default_model())
    out = arrow_map(rows, ids_col, lambda lists: {"decoded": [coder.decode(x or []) for x in lists]}, "decoded string", keep=keep)
    return out.withColumnRenamed("decoded", "text")


def query(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), keep=["doc_id"])
