"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens.  The queues are visited in
turn.  A visit adds to the queue's deficit counter its part of a window of
``WINDOW`` tokens by target weight; a queue whose counter covers ``TURN`` tokens
sends what it covers, and the rest stays in the counter.  Windows are cut from
the stream of what is sent.  So a window holds the target proportions up to about
a turn per source, and what a queue is short of is made up in the next windows.
A queue that runs dry drops out, and the others share its place by weight.

Partitions do not wait for each other.  The stream is cut into blocks of
``BLOCK_WINDOWS`` windows' worth of credit.  The prefix sums of credit and of
whole tokens sent say, in exact integers, where every queue stands at the start
of any block and what deficit is carried into it (``Plan``); the rounds inside a
block are played by the tasks that need it.

One pass tokenizes and stores ids with running offsets per task and source; sums
of a few numbers per task give each task its place in the queues; a second pass
places the pieces.  Token ids are never shuffled.

Cases: a null or empty text is the end token alone; a null source is a queue of
its own; a source without a weight has the least weight above 0; repeated rows
are packed one by one; a document of any length is cut where its turn or window
ends; an empty table gives no pieces; other columns are ignored.  All sequences
but the last one are full.  One row per source and task is collected to the
driver: sources are taken to be thousands at most.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, TEXT_BATCH_BYTES, stretches, hash_spans, join_small, lower_ascii, prepare, released, slices, store, text_bytes, word_spans

WINDOW = 4096
TURN = 256
END_ID = 2
WEIGHTS = (3, 1, 2)
TOKENIZER = "word_bpe_49k.json"
BLOCK_WINDOWS = 256
MEMO_BYTES = 48 << 20
MEMO_LENGTH = 48

#: What a remembered word takes besides its bytes and ids: two objects and a place in the table.
_ENTRY = 170
_NEVER = np.int32(1 << 30)

#: Deficits inside a block count in parts of a token, 2 ** -_UNIT each.
_UNIT = 30

#: ASCII marks, which the splitter keeps apart from letters and which nothing composes with.
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(_MARKS.encode())] = True
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


class Merges:
    """Byte-pair merges of many words side by side, from the tokenizer's own table.

    Words are rows of symbols.  Each step merges the first pair of lowest rank in
    every row that has one and looks up the two new pairs, so a step costs a few
    vector operations for thousands of words.  Only for words that the tokenizer
    takes as one piece: letters in composed form.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.append(True, np.diff(keys[order]) != 0)
        self.keys, self.rank = keys[order][first], order[first].astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        shown, spare = {}, 256
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                shown[b] = chr(b)
            else:
                shown[b], spare = chr(spare), spare + 1
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], np.int32)
        self.start = [self._ranks(np.repeat(self.inner, 256), np.tile(end, 256)) for end in (self.inner, self.last)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], _NEVER)

    def encode(self, words: list[bytes], dtype: np.dtype) -> list[bytes]:
        n, size = len(words), np.array([len(w) for w in words])
        data, width = np.frombuffer(b"".join(words), np.uint8), int(size.max())
        inside = np.arange(width + 1) < size[:, None]
        byte = np.zeros((n, width + 1), np.int64)
        byte[inside] = data
        symbol = np.where(inside, self.inner[byte], -1)
        symbol[np.arange(n), size - 1] = self.last[byte[np.arange(n), size - 1]]
        pair = byte[:, :-1] * 256 + byte[:, 1:]
        rank = np.where(inside[:, 1:], self.start[0][pair], _NEVER)
        long = np.flatnonzero(size > 1)
        rank[long, size[long] - 2] = self.start[1][pair[long, size[long] - 2]]
        live, column = np.arange(len(words)), np.arange(width + 1)
        while len(live):
            r = rank[live]
            at = r.argmin(axis=1)
            low = r[np.arange(len(live)), at]
            more = low < _NEVER
            live, at, low = live[more], at[more], low[more]
            if not len(live):
                break
            s, r = symbol[live], r[more]
            after = column[None, :] > at[:, None]
            s[:, :-1] = np.where(after[:, :-1], s[:, 1:], s[:, :-1])
            s[:, -1] = -1
            s[np.arange(len(live)), at] = self.made[low]
            r[:, :-1] = np.where(after[:, :-2], r[:, 1:], r[:, :-1])
            r[:, -1] = _NEVER
            r[np.arange(len(live)), at] = self._ranks(s[np.arange(len(live)), at], s[np.arange(len(live)), at + 1])
            before = np.maximum(at - 1, 0)
            r[np.arange(len(live)), before] = np.where(at > 0, self._ranks(s[np.arange(len(live)), before], s[np.arange(len(live)), before + 1]), r[np.arange(len(live)), before])
            symbol[live], rank[live] = s, r
        full = symbol >= 0
        raw, to = symbol[full].astype(dtype).tobytes(), np.append(0, np.cumsum(full.sum(axis=1)) * dtype.itemsize).tolist()
        return [raw[i:j] for i, j in zip(to, to[1:])]


def _id_type(path: str) -> str:
    """Two bytes an id where the vocabulary allows."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    most = max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


class Encoder:
    """Token ids of texts, remembered by word.

    The tokenizer lowers case, and its splitter never joins anything across
    white space, so a text's ids are those of its words one after the other.
    Texts are cut at ASCII white space; other white space stays inside a word,
    which the tokenizer then cuts itself.  Special tokens, told by case, and
    letters that Python lowers by context are the tokenizer's as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.dtype = np.dtype(_id_type(path))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _fresh(self, texts: list[str]) -> list[bytes]:
        """Ids from the tokenizer itself, some thousands of texts at a time."""
        out: list[bytes] = []
        for i in range(0, len(texts), 8192):
            found = self.tokenizer.encode_batch_fast(texts[i : i + 8192], add_special_tokens=False)
            out += [array(self.code, e.ids).tobytes() for e in found]
        return out

    def _merged(self, raw: list[bytes]) -> list[bytes]:
        """Ids of single pieces by ``Merges``, of about one length at a time."""
        order, out = np.argsort(np.fromiter(map(len, raw), np.int64, len(raw)), kind="stable").tolist(), [b""] * len(raw)
        for i in range(0, len(order), 4096):
            some = order[i : i + 4096]
            for k, ids in zip(some, self.merges.encode([raw[k] for k in some], self.dtype)):
                out[k] = ids
        return out

    def _pieces(self, words: list[str]) -> list[bytes]:
        """Ids of words: letters in composed form are single pieces; others are the tokenizer's."""
        raw = [w.encode() if w.isalpha() and (w.isascii() or is_normalized("NFC", w)) and w == w.lower() else b"" for w in words]
        single = [k for k, w in enumerate(raw) if 0 < len(w) <= MEMO_LENGTH]
        rest = [k for k, w in enumerate(raw) if not 0 < len(w) <= MEMO_LENGTH]
        out = [b""] * len(words)
        for some, found in ((single, self._merged([raw[k] for k in single])), (rest, self._fresh([words[k] for k in rest]))):
            for k, ids in zip(some, found):
                out[k] = ids
        return out

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of new words; one of composed letters with ASCII marks at its end is the letters' ids and the marks'."""
        single = [k for k, w in enumerate(words) if len(w) <= MEMO_LENGTH and w.isalpha()]
        out: list[bytes | None] = [None] * len(words)
        for k, ids in zip(single, self._merged([words[k] for k in single])):
            out[k] = ids
        rest = [k for k, x in enumerate(out) if x is None]
        first, second = [], []
        for k in rest:
            word = words[k].decode()
            w, tail = word.lower(), ""
            if not w.isalpha():
                body = w.rstrip(_MARKS)
                if body != w and body.isalpha() and is_normalized("NFC", body):
                    w, tail = body, w[len(body) :]
            if not word.isascii() and ("\u0130" in word or "\u03a3" in word) or "<|" in word:
                w, tail = word, ""
            first.append(w)
            second.append(tail)
        atoms = list({*first, *second} - {""})
        ids = dict(zip(atoms, self._pieces(atoms)))
        ids[""] = b""
        for k, a, b in zip(rest, first, second):
            out[k] = ids[a] + ids[b] if b else ids[a]
        return out

    def _remember(self, words: list[bytes], ids: list[bytes]) -> None:
        """Two generations of half of ``MEMO_BYTES`` each: words of the older one stay if they are used again."""
        for w, x in zip(words, ids):
            if len(w) <= MEMO_LENGTH:
                self.memo[w] = x
                self.held += len(w) + len(x) + _ENTRY
        if self.held > MEMO_BYTES // 2:
            self.older, self.memo, self.held = self.memo, {}, 0

    def encode(self, data: np.ndarray, offs: np.ndarray) -> Iterator[bytes]:
        """Ids of each text, as bytes, a slice of texts after the other; a long text is cut at white space."""
        for i, j in slices(offs):
            part, to = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if len(part) > 2 * SLICE_BYTES:
                yield b"".join(x for a, b in stretches(part) for x in self._slice(part[a:b], np.array([0, b - a])))
            else:
                yield from self._slice(part, to)

    @staticmethod
    def _words(part: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lower-cased bytes and their words; marks after an ASCII letter or digit, up to the word's end, are a word of their own.

        A word with the start of a special token stays as it is.
        """
        s, e, doc = word_spans(part, to)
        low, whole = lower_ascii(part), np.zeros(len(s), bool)
        special = np.flatnonzero((part[:-1] == 60) & (part[1:] == 124))
        if len(special):
            whole[np.searchsorted(s, special, side="right") - 1] = True
            for a, b in zip(s[whole].tolist(), e[whole].tolist()):
                low[a:b] = part[a:b]
        solid = np.maximum.accumulate(np.where(_MARK[low], -1, np.arange(len(low))))
        body = solid[e - 1] + 1
        cut = (body > s) & (body < e) & _PLAIN[low[body - 1]] & ~whole
        begin = np.repeat(s, 1 + cut)
        end, head = np.repeat(e, 1 + cut), np.cumsum(1 + cut) - 1 - cut
        end[head[cut]], begin[head[cut] + 1] = body[cut], body[cut]
        return low, begin, end, np.repeat(doc, 1 + cut)

    def _slice(self, part: np.ndarray, to: np.ndarray) -> list[bytes]:
        """Each different word of a slice is looked up once."""
        width = self.dtype.itemsize
        part, s, e, doc = self._words(part, to)
        _, first, each = np.unique(hash_spans(part, s, e), return_index=True, return_inverse=True)
        raw = part.tobytes()
        words = [raw[x:y] for x, y in zip(s[first].tolist(), e[first].tolist())]
        ids = list(map(self.memo.get, words))
        absent = [k for k, x in enumerate(ids) if x is None]
        if absent:
            for k in absent:
                ids[k] = self.older.get(words[k])
            new = [k for k in absent if ids[k] is None]
            for k, x in zip(new, self._learn([words[k] for k in new])):
                ids[k] = x
            self._remember([words[k] for k in absent], [ids[k] for k in absent])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        begin = np.cumsum(size) - size
        n = size[each]
        done = np.cumsum(n)
        at = np.arange(done[-1] if len(done) else 0) + np.repeat(begin[each] - done + n, n)
        tokens = np.frombuffer(b"".join(ids), self.dtype)[at].tobytes()
        ends = (np.cumsum(np.bincount(doc, weights=n, minlength=len(to) - 1)).astype(np.int64) * width).tolist()
        return [tokens[x:y] for x, y in zip([0, *ends], ends)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """A worker outlives the packing: the tokenizer and its words would stay beside all that it does next."""
    _ENCODERS.clear()


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, tidy: bool = False) -> DataFrame:
    """doc_id, source, n, part, at, ids: ids as bytes; ``at`` counts the source's tokens earlier in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, served = TaskContext.get().partitionId(), {}
        enc = encoder(path)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            found = ((x + end) for x in enc.encode(*text_bytes(batch.column("text"))))
            sources, done = batch.column("source").to_pylist(), 0
            while ids := list(islice(found, 256)):
                counts, starts = [len(x) // width for x in ids], []
                for source, n in zip(sources[done:], counts):
                    starts.append(served.get(source, 0))
                    served[source] = starts[-1] + n
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(ids)), batch.column("source").slice(done, len(ids)), pa.array(counts, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "part", "at", "ids"])
                done += len(ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(released(run) if tidy else run, "doc_id long, source string, n long, part int, at long, ids binary")


class Plan:
    """Where the queues stand at each block, from totals and weights alone, and the rounds of a block.

    In a phase the same queues are active.  Block ``k`` of a phase starts when
    each queue has been credited ``k * block * weight / whole`` tokens and sent the
    whole ones of them; the fraction is the deficit that it carries into the block.
    The last block of a phase sends the rest of the queue that runs dry.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW, turn: int = TURN, block_windows: int = BLOCK_WINDOWS) -> None:
        self.totals, self.window, self.turn, self.size = [int(n) for n in totals], window, turn, window * block_windows
        if weights is None:
            self.weights = [max(1, n) for n in self.totals]
        else:
            scale = (1 << 32) / (sum(weights) or 1)
            self.weights = [max(1, round(w * scale)) for w in weights]
        self.first, self.most, self.base, self.whole = [], [], [], []
        served, block = [0] * len(self.totals), 0
        while any(left := [n - s for n, s in zip(self.totals, served)]):
            active = [i for i, n in enumerate(left) if n]
            whole = sum(self.weights[i] for i in active)
            most = 0 if sum(left) <= self.size else min(((left[i] + 1) * whole - 1) // (self.size * self.weights[i]) for i in active)
            self.first.append(block)
            self.most.append(most)
            self.base.append(served)
            self.whole.append(whole)
            served = [served[i] + self._credit(i, whole, most) if n else served[i] for i, n in enumerate(left)]
            left = [n - s for n, s in zip(self.totals, served)]
            rest = sum(left) <= self.size
            served = [s + (n if rest else min(n, self._credit(i, whole, 1))) if n else s for i, (s, n) in enumerate(zip(served, left))]
            block += most + 1
        self.blocks, self.end = block, served
        self.rounds = lru_cache(64)(self._rounds)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rounds"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.rounds = lru_cache(64)(self._rounds)

    def _credit(self, queue: int, whole: int, blocks: int) -> int:
        return blocks * self.size * self.weights[queue] // whole

    def served(self, block: int) -> list[int]:
        """Tokens that each queue sent before ``block``."""
        if block >= self.blocks:
            return self.end
        p = bisect_right(self.first, block) - 1
        k = block - self.first[p]
        return [b + self._credit(i, self.whole[p], k) if b < n else b for i, (b, n) in enumerate(zip(self.base[p], self.totals))]

    def carried(self, block: int) -> list[tuple[int, int]]:
        """Each queue's deficit at the start of ``block``, in tokens, as a fraction."""
        p = bisect_right(self.first, block) - 1
        k = block - self.first[p]
        return [(k * self.size * w % self.whole[p], self.whole[p]) for w in self.weights]

    def block_of(self, queue: int, position: int) -> int:
        """The block that sends the queue's token at ``position``."""
        p = bisect_right(self.base, position, key=lambda b: b[queue]) - 1
        k = ((position - self.base[p][queue] + 1) * self.whole[p] - 1) // (self.size * self.weights[queue])
        return self.first[p] + min(k, self.most[p])

    def _rounds(self, block: int) -> tuple[np.ndarray, ...]:
        """(queue, first token in its queue, rank in the stream, tokens) of what is sent in ``block``, in order."""
        before, after = self.served(block), self.served(block + 1)
        left = [b - a for a, b in zip(before, after)]
        counter = [(a << _UNIT) // b for a, b in self.carried(block)]
        active, sent = [i for i, n in enumerate(left) if n], []
        while active:
            whole = sum(self.weights[i] for i in active)
            quantum = [(i, (self.window * self.weights[i] << _UNIT) // whole) for i in active]
            while len(active) == len(quantum):
                for i, credit in quantum:
                    counter[i] += credit
                    if left[i] and counter[i] >= min(self.turn, left[i]) << _UNIT:
                        tokens = min(counter[i] >> _UNIT, left[i])
                        counter[i] -= tokens << _UNIT
                        left[i] -= tokens
                        sent.append((i, tokens))
                active = [i for i in active if left[i]]
        queue, tokens = (np.array([x[k] for x in sent], np.int64) for k in (0, 1))
        rank = sum(before) + np.cumsum(tokens) - tokens
        order = np.argsort(queue, kind="stable")
        done = np.cumsum(tokens[order]) - tokens[order]
        start = np.empty(len(queue), np.int64)
        heads = np.searchsorted(queue[order], queue[order], side="left")
        start[order] = done - done[heads] + np.array(before, np.int64)[queue[order]]
        return queue, start, rank, tokens

    def sent(self, queue: int, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """(first token, rank, tokens) of the parts of the stream that hold the queue's tokens ``lo`` to ``hi``, cut at windows."""
        parts = []
        for block in range(self.block_of(queue, lo), self.block_of(queue, hi - 1) + 1):
            of, start, rank, tokens = self.rounds(block)
            mine = (of == queue) & (start < hi) & (start + tokens > lo)
            parts.append((start[mine], rank[mine], tokens[mine]))
        start, rank, tokens = (np.concatenate([p[k] for p in parts]) for k in range(3))
        inner = (rank + tokens - 1) // self.window - rank // self.window
        row = np.repeat(np.arange(len(start)), inner + 1)
        k = np.arange(len(row)) - np.repeat(np.cumsum(inner + 1) - inner - 1, inner + 1)
        begin = np.maximum(rank[row], (rank[row] // self.window + k) * self.window)
        end = np.minimum((rank + tokens)[row], (rank[row] // self.window + k + 1) * self.window)
        return start[row] + begin - rank[row], begin, end - begin

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in the row, length, window, offset) of the cut documents.

        Row ``r`` holds tokens ``start[r]`` to ``start[r] + n[r]`` of its queue.
        """
        out = []
        order = np.lexsort((start, queue))
        new = np.append(True, (queue[order][1:] != queue[order][:-1]) | (start[order][1:] != (start + n)[order][:-1]))
        heads = np.append(np.flatnonzero(new), len(order)).tolist()
        for a, b in zip(heads, heads[1:]):
            rows = order[a:b]
            lo, hi = int(start[rows[0]]), int(start[rows[-1]] + n[rows[-1]])
            first, rank, _ = self.sent(int(queue[rows[0]]), lo, hi)
            cut = np.unique(np.concatenate([start[rows], np.maximum(first[first < hi], lo)]))
            row, part = np.searchsorted(start[rows], cut, side="right") - 1, np.searchsorted(first, cut, side="right") - 1
            at = rank[part] + cut - first[part]
            join = np.append(False, (row[1:] == row[:-1]) & (at[1:] - at[:-1] == cut[1:] - cut[:-1]) & (at[1:] // self.window == at[:-1] // self.window))
            row, at, cut = row[~join], at[~join], cut[~join]
            out.append((rows[row], cut - start[rows[row]], np.append(cut[1:], hi) - cut, at // self.window, at % self.window))
        row, at, size, seq, offset = (np.concatenate([x[k] for x in out]) for k in range(5))
        by = np.lexsort((at, row))
        return row[by], at[by], size[by], seq[by], offset[by]


def pack(docs: DataFrame, path: str, weights: dict[str | None, float] | Callable[[list[str | None]], list[float]] | None = None, window: int = WINDOW, turn: int = TURN, with_ids: bool = False, end_id: int = END_ID, block_windows: int = BLOCK_WINDOWS, tidy: bool = False) -> DataFrame:
    """One row per piece.

    ``weights`` are target shares by source, or a function of the sources in
    order (by code point, null last); not given, the sources' shares of all
    tokens are the targets, so that all queues run dry together.  ``tidy`` leaves
    the workers little memory taken for other operators, at the price of a cold tokenizer.
    """
    prepare(docs.sparkSession, **{"batch_bytes": TEXT_BATCH_BYTES} if tidy else {})
    tokens = store(tokenize(docs, path, end_id, tidy), "pack-tokens")
    per_task = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    places = store(per_task.select("part", "source", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), "n"), "pack-places")
    totals = sorted(((r["source"], r["n"]) for r in places.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sources = [source for source, _ in totals]
    queue_of = {source: i for i, source in enumerate(sources)}
    shares = weights(sources) if callable(weights) else None if weights is None else [weights.get(s, 0.0) for s in sources]
    plan, dtype = Plan([n for _, n in totals], shares, window, turn, block_windows), np.dtype(_id_type(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tidy:
            forget_encoders()
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(c) for c in ("doc_id", "source", "n", "at", "base", "ids")}
            n, start = np.asarray(column["n"]), np.asarray(column["at"]) + np.asarray(column["base"])
            queue = np.array([queue_of[s] for s in column["source"].to_pylist()], np.int64)
            row, at, size, seq, offset = plan.pieces(queue, start, n)
            crc, parts, of, ids = [], [], -1, None
            for r, a, k in zip(row.tolist(), at.tolist(), size.tolist()):
                if r != of:
                    of, ids = r, np.frombuffer(column["ids"][r].as_buffer(), dtype).astype("<u4")
                crc.append(zlib.crc32(ids[a : a + k]))
                if with_ids:
                    parts.append(ids[a : a + k].astype(np.int32))
            out = [column["doc_id"].take(pa.array(row)), pa.array(at), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(offset), column["source"].take(pa.array(row))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            if with_ids:
                out, names = [*out, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<int>" * with_ids
    return join_small(tokens, places.select("part", "source", "base"), ["part", "source"]).mapInArrow(released(run) if tidy else run, kind)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from pieces with ids; a group is one window at most."""
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def target_weights(sources: list[str | None], weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """The weights, repeating, for the sources in order."""
    return [float(weights[i % len(weights)]) for i in range(len(sources))]


def op7_packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest of the contract; sources have the target weights of the mix of op 1 while their tokens last."""
    return pack(docs, path or tokenizer_path(), target_weights)


def pack_stage(docs: DataFrame) -> DataFrame:
    """Windows in the proportions of ``docs``, which the mixing stage has set."""
    return pack(docs, tokenizer_path(), tidy=True)
