import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prosemill.functions.subwords import piece_pattern, subword_pieces, subword_tokens, trie_pattern
from prosemill.operators import backoff
from prosemill.operators import language_model as lm

WORDS = ["the", "he", "her", "here", "there", "a", "an", "and", "t.", "(x", "é𝄞"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def greedy(text, vocabulary):
    """The longest piece at each place, else one character; white space is skipped."""
    low, out, i = "".join(c.lower() if c.isascii() else c for c in text), [], 0
    while i < len(text):
        if low[i] in " \t\n\r\f\v":
            i += 1
            continue
        piece = max((p for p in vocabulary if low.startswith(p, i)), key=len, default=low[i])
        out.append((piece, i, i + len(piece)))
        i += len(piece)
    return out


def test_longest_piece(spark):
    rng = random.Random(2)
    texts = ["There he is, HERE.\tand (xx t.", "", None, "é𝄞é 𝄞\n\ntheretheher", " a b"] + ["".join(rng.choice("thera n(x.é𝄞") for _ in range(200)) for _ in range(20)]
    got = {r.doc_id: [tuple(p) for p in r.pieces] for r in subword_pieces(docs(spark, *texts), WORDS).collect()}
    assert got == {i: greedy(t or "", WORDS) for i, t in enumerate(texts)}
    assert re.fullmatch(trie_pattern(["ab", "abc"]), "abc") and trie_pattern([]) == "" and piece_pattern([]) == r"[^ \t\n\r\f\v]"
    with pytest.raises(ValueError):
        trie_pattern(["a", ""])
    tokens = subword_tokens(subword_pieces(docs(spark, "he the a"), WORDS)).orderBy("tok_idx").collect()
    assert [(t.word, t.prev, t.prev2, t.start_char) for t in tokens] == [("he", None, None, 0), ("the", "he", None, 3), ("a", "the", "he", 7)]


class Brute:
    """The model from its definition: whole distributions."""

    def __init__(self, texts, d=0.75):
        c3 = Counter()
        for words in texts:
            padded = ["", *words]
            c3.update(zip(padded, words, words[1:]))
        c2 = Counter((v, w) for _, v, w in c3)
        c1 = Counter(w for _, w in c2)
        self.words, self.d = [*c1, None], d
        self.p1 = {w: max(c1[w] - d, 0) / sum(c1.values()) + d * len(c1) / sum(c1.values()) / (len(c1) + 1) for w in self.words}
        self.two, self.three = defaultdict(Counter), defaultdict(Counter)
        for (v, w), n in c2.items():
            self.two[v][w] += n
        for (u, v, w), n in c3.items():
            self.three[u, v][w] += n

    def mixed(self, seen, low):
        if not seen:
            return low
        total = sum(seen.values())
        return {w: max(seen.get(w, 0) - self.d, 0) / total + self.d * len(seen) / total * low[w] for w in self.words}

    def after(self, u, v):
        return self.mixed(self.three.get((u or "", v)), self.mixed(self.two.get(v), self.p1))

    def score(self, word, v, u):
        p = self.after(u, v)
        assert math.isclose(sum(p.values()), 1)
        return math.log(p.get(word, p[None])), -sum(x * math.log(x) for x in p.values())


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    texts = [[rng.choice("aaaabbcde") for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    tokens = subword_tokens(subword_pieces(docs(spark, *(" ".join(t) for t in texts)), []))
    return texts, tokens, backoff.BackoffModel(tokens), Brute(texts)


def scores(frame):
    return {(r.doc_id, r.tok_idx): (r.logprob, r.entropy) for r in frame.collect()}


def test_model_is_its_definition(spark, model):
    texts, tokens, fitted, brute = model
    want = {(d, i): brute.score(t[i], t[i - 1], t[i - 2] if i > 1 else None) for d, t in enumerate(texts) for i in range(1, len(t))}
    assert scores(fitted.score(tokens)) == {k: pytest.approx(v) for k, v in want.items()}


def test_unseen_words_and_contexts(spark, model):
    texts, _, fitted, brute = model
    other = [list("azyea"), list("zzab"), list("ea"), list("z"), list("edcba"), ["a"]]
    got = scores(fitted.score(subword_tokens(subword_pieces(docs(spark, *(" ".join(t) for t in other)), []))))
    assert got == {(d, i): pytest.approx(brute.score(t[i], t[i - 1], t[i - 2] if i > 1 else None)) for d, t in enumerate(other) for i in range(1, len(t))}


@pytest.mark.parametrize(("width", "overlap"), [(8, 1), (9, 4)])
def test_windows_begin_anew(spark, model, width, overlap):
    """Each token is scored by the first window that has it after another, with that window's words alone."""
    texts, tokens, fitted, brute = model
    want = {}
    for d, t in enumerate(texts):
        for first, last, new in lm.window_spans(len(t), width, overlap):
            for i in range(new, last):
                want[d, i] = brute.score(t[i], t[i - 1], t[i - 2] if i - first > 1 else None)
    scored = fitted.score(backoff.in_windows(tokens, width, overlap))
    assert scores(scored) == {k: pytest.approx(v) for k, v in want.items()}
    lengths = spark.createDataFrame([(d, len(t)) for d, t in enumerate(texts)], "doc_id long, n_tokens long")
    rows = backoff.window_scores(scored, lengths, width, overlap).collect()
    assert sum(r.n_scored for r in rows) == len(want) and all(r.n_scored == r.scored for r in rows)


def test_look_up_by_hot_and_rare_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"w{i % 50}") for i in range(400)], "i long, w string")
    known = rows.groupBy("w").agg(F.count("*").alias("c"), F.max("i").alias("v")).filter("w <> 'w8'")
    want = {(r.i, r.c, r.v) for r in rows.join(known, "w", "left").collect()}
    for hot in (1, 3, 1000):
        monkeypatch.setattr(lm, "HOT_KEYS", hot)
        assert {(r.i, r.c, r.v) for r in lm.look_up(rows, known, ["w"]).collect()} == want


def test_tokens_meet_sentences_of_a_very_long_text(spark):
    """A million tokens of one document, some over two sentences, against sums by arithmetic."""
    n, span, step = 1_000_000, 37, 9
    tokens = spark.range(0, n, 1, 8).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * step).cast("int").alias("start_char"), (F.col("id") * step + step).cast("int").alias("end_char"), F.lit(-0.5).alias("logprob"))
    sentences = spark.range(0, n * step // span, 1, 8).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("sid"), (F.col("id") * span).cast("int").alias("start"), (F.col("id") * span + span - 1).cast("int").alias("end"))
    touched = F.floor((F.col("end") - 1) / step) - F.floor(F.col("start") / step) + 1
    got = lm.attribute_tokens(sentences, tokens).agg(F.sum("token_count").alias("n"), F.count_if(F.col("token_count") != touched).alias("wrong"), F.count("*").alias("rows")).first()
    assert (got.wrong, got.rows) == (0, n * step // span) and got.n > n


def test_ranges_against_all_pairs(spark):
    """Any ranges: empty, nested, longer than a bin."""
    rng = random.Random(6)
    place = lambda most: (lambda s: (s, s + rng.randrange(most)))(rng.randrange(400))
    rows = [(1 + i % 2, i, *place(120 if i % 9 else 2)) for i in range(60)]
    tokens = [(1 + i % 2, *place(40 if i % 7 else 1), -float(i)) for i in range(200)]
    want = {(d, s): len([1 for e, x, y, _ in tokens if e == d and y > a and x < b]) for d, s, a, b in rows}
    frame, cut = spark.createDataFrame(rows, "doc_id long, sid long, start int, end int"), spark.createDataFrame(tokens, "doc_id long, start_char int, end_char int, logprob double")
    for width in (1, 16, 1000):
        assert {(r.doc_id, r.sid): r.token_count for r in lm.attribute_tokens(frame, cut, width).collect()} == want

def test_pieces_and_codes_in_slices(spark, monkeypatch):
    """Batches of any size, words that are cut anew, pieces with white space: the same pieces and neighbours."""
    from prosemill.functions import subwords

    rng = random.Random(5)
    texts = ["", None, "x", "the the here", "here there " * 60] + ["".join(rng.choice("thera n(\tX.é𝄞") for _ in range(rng.randrange(60))) for _ in range(30)]
    frame = docs(spark, *texts)
    for slices, words, more in ((1, 2, []), (7, 3, ["here there"]), (100_000, 100_000, [])):
        monkeypatch.setattr(subwords, "SLICE_PIECES", slices)
        monkeypatch.setattr(subwords, "CUT_WORDS", words)
        want = {i: greedy(t or "", [*WORDS, *more]) for i, t in enumerate(texts)}
        assert {r.doc_id: [tuple(p) for p in r.pieces] for r in subword_pieces(frame, [*WORDS, *more]).collect()} == want
        code = {p: i for i, p in enumerate([*WORDS, *more], 0x110000)}
        numbers = {d: [code[p] if p in code else ord(p) for p, _, _ in ps] for d, ps in want.items()}
        got = {(r.doc_id, r.tok_idx): (r.word, r.prev, r.prev2) for r in subwords.coded_tokens(frame, [*WORDS, *more]).collect()}
        assert got == {(d, i): (n[i], n[i - 1] if i else None, n[i - 2] if i > 1 else None) for d, n in numbers.items() for i in range(len(n))}


def test_pieces_leave_in_bounded_batches(monkeypatch):
    """Whatever an Arrow batch holds, what a worker makes at once is a slice of pieces."""
    import pyarrow as pa

    from prosemill.functions import subwords

    kept = {}

    class Docs:
        schema = {"doc_id": type("T", (), {"dataType": type("D", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            kept["f"] = f

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": ["he the here " * 50] * 299 + ["he " * 2000]})
    monkeypatch.setattr(subwords, "SLICE_PIECES", 1000)
    for cut, size in ((subwords.subword_pieces, lambda b: len(b.column("pieces").flatten())), (subwords.coded_tokens, len)):
        cut(Docs(), WORDS)
        sizes = [size(b) for b in kept["f"](iter([batch]))]
        assert sum(sizes) == 299 * 150 + 2000 and sorted(sizes)[-2] < 1150 and max(sizes) <= 2900
