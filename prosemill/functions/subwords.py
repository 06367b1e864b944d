"""Pieces of a vocabulary, the longest that fits first, with their places.

A vocabulary becomes a trie, and the trie one regular expression: the characters
that may follow a prefix are its branches, and a prefix that is a piece itself may
end there.  A regular expression takes the first branch that fits and goes back to
the last piece on the way if the rest does not, so it finds the longest piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_SPACE = r" \t\n\r\f\v"
_CODE_POINTS = 0x110000

#: Pieces of an Arrow batch, or those of one text.
SLICE_PIECES = 100_000

#: Words whose pieces a worker keeps, and the longest of them.
CUT_WORDS, CUT_CHARS = 100_000, 40


def trie_pattern(vocabulary: Iterable[str]) -> str:
    """A regular expression for the longest of the pieces."""
    root: dict = {}
    for piece in vocabulary:
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = {}

    def branches(node: dict) -> str:
        out = "|".join(re.escape(c) + branches(node[c]) for c in sorted(node) if c)
        return f"(?:{out})" + "?" * ("" in node) if out else ""

    if "" in root:
        raise ValueError("a piece is empty")
    return branches(root)


def piece_pattern(vocabulary: Iterable[str]) -> str:
    """As ``trie_pattern``; a character that begins no piece is one of its own, white space none."""
    pieces = trie_pattern(vocabulary)
    return f"{pieces}|" * bool(pieces) + r"[^ \t\n\r\f\v]"


class _Cuts(dict):
    """What ``cut`` makes of each word, kept for short words until there are ``CUT_WORDS`` of them."""

    def __init__(self, cut: Callable[[str], tuple]) -> None:
        self.cut = cut

    def __missing__(self, word: str) -> tuple:
        out = self.cut(word)
        if len(word) <= CUT_CHARS:
            if len(self) >= CUT_WORDS:
                self.clear()
            self[word] = out
        return out


def _words(vocabulary: Sequence[str]) -> str:
    """Runs in which pieces are found by themselves: words, or the whole text where a piece holds white space."""
    return r"(?s:.+)" if any(re.search(f"[{_SPACE}]", p) for p in vocabulary) else f"[^{_SPACE}]+"


def subword_pieces(docs: DataFrame, vocabulary: Iterable[str]) -> DataFrame:
    """doc_id and ``pieces``, an array of piece, start and end for each text, A to Z in lower case.

    Places are code points of the text.  A null or empty text has no pieces.  Texts
    are cut in Arrow batches: a running sum of lengths inside a row is what expressions
    lack, and a window would shuffle every piece.  A batch ends after ``SLICE_PIECES``.
    """
    vocabulary = list(vocabulary)
    pattern, words = piece_pattern(vocabulary), _words(vocabulary)
    kind = pa.list_(pa.struct([("piece", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, runs = re.compile(pattern).finditer, re.compile(words).finditer
        known = _Cuts(lambda word: tuple(zip(*((m[0], m.start(), len(m[0])) for m in find(word.translate(_LOWER))))) or ((), (), ()))
        pieces, inside, sizes, starts, counts = [], [], [], [], []

        def rows(ids: pa.Array, ends: list[int]) -> pa.RecordBatch:
            at = np.array(inside, np.int32) + np.repeat(np.array(starts, np.int32), np.array(counts, np.int64))
            columns = [pa.array(pieces, pa.string()), pa.array(at), pa.array(at + np.array(sizes, np.int32))]
            flat = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
            out = pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), flat).cast(kind)], ["doc_id", "pieces"])
            for kept in (pieces, inside, sizes, starts, counts):
                kept.clear()
            return out

        for batch in batches:
            first, ends = 0, []
            for i, text in enumerate(batch.column("text"), 1):
                for m in runs(text.as_py() or ""):
                    found, places, lengths = known[m[0]]
                    pieces += found
                    inside += places
                    sizes += lengths
                    starts.append(m.start())
                    counts.append(len(found))
                ends.append(len(pieces))
                if len(pieces) >= SLICE_PIECES or i == batch.num_rows:
                    yield rows(batch.column("doc_id").slice(first, i - first), ends)
                    first, ends = i, []

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {key}, pieces array<struct<piece:string,start:int,end:int>>")


def coded_tokens(docs: DataFrame, vocabulary: Iterable[str]) -> DataFrame:
    """doc_id, tok_idx, and numbers for ``word``, ``prev`` and ``prev2``: ``subword_tokens`` without places and texts.

    A piece's number is its place in the vocabulary beyond all code points, or its code
    point.  Rows are made slice by slice from arrays, so nothing is held but one text's numbers,
    and reading the texts again costs less than a stored table of all tokens.
    """
    vocabulary = list(dict.fromkeys(vocabulary))
    pattern, words = piece_pattern(vocabulary), _words(vocabulary)
    numbers = {p: _CODE_POINTS + i for i, p in enumerate(vocabulary)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, runs = re.compile(pattern).findall, re.compile(words).findall
        known = _Cuts(lambda word: tuple(numbers[p] if p in numbers else ord(p) for p in find(word.translate(_LOWER))))

        def rows(ids: pa.Array, parts: list[np.ndarray], first: int) -> pa.RecordBatch:
            """Rows of whole texts, or of one text from its token ``first`` on, which has two more before it."""
            lengths = np.array([len(p) for p in parts], np.int64)
            word = np.concatenate(parts)
            index = np.arange(len(word)) - np.repeat(lengths.cumsum() - lengths, lengths) + max(0, first - 2)
            before = [np.concatenate([np.zeros(min(k, len(word)), np.int32), word[:-k]]) for k in (1, 2)]
            columns = [ids.take(pa.array(np.repeat(np.arange(len(parts)), lengths))), pa.array(index.astype(np.int32)), pa.array(word), *(pa.array(b, mask=index < k) for k, b in enumerate(before, 1))]
            return pa.RecordBatch.from_arrays([c.slice(min(2, first)) for c in columns], ["doc_id", "tok_idx", "word", "prev", "prev2"])

        for batch in batches:
            parts, first, held = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                found = np.fromiter(chain.from_iterable(map(known.__getitem__, runs(text.as_py() or ""))), np.int32)
                if parts and held + len(found) > SLICE_PIECES:
                    yield rows(batch.column("doc_id").slice(first, i - first), parts, 0)
                    parts, first, held = [], i, 0
                if len(found) > SLICE_PIECES:
                    for at in range(0, len(found), SLICE_PIECES):
                        yield rows(batch.column("doc_id").slice(i, 1), [found[max(0, at - 2) : at + SLICE_PIECES]], at)
                    first = i + 1
                else:
                    parts.append(found)
                    held += len(found)
            if parts:
                yield rows(batch.column("doc_id").slice(first), parts, 0)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {key}, tok_idx int, word int, prev int, prev2 int")


def subword_tokens(cut: DataFrame) -> DataFrame:
    """doc_id, tok_idx, word, start_char, end_char, and the two words before, null before the text's begin: a map over ``pieces``."""
    at = lambda i: F.get("pieces", i)["piece"]
    token = lambda p, i: F.struct(i.alias("tok_idx"), p["piece"].alias("word"), p["start"].alias("start_char"), p["end"].alias("end_char"), F.when(i > 0, at(i - 1)).alias("prev"), F.when(i > 1, at(i - 2)).alias("prev2"))
    return cut.select("doc_id", F.inline(F.transform("pieces", token)))
