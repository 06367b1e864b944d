"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once per document and gives one bit for each
failure next to the measurements; ``stored_ledger`` writes it to the shared folder.
A ``Policy`` is a version name and the mask of the rules that it enforces;
``apply_policy``, ``ablations`` and ``rule_profile`` work on the stored bits alone, so
a new policy never reads the texts again.

Null and empty texts have no words: every count is 0 and ``too_few_words``
fails.  Repeated rows are judged one by one.  Documents of any length work in
one row: the only arrays are those of the document's own words, and repeated
windows are found by sorting their hashes, in n log n.  Columns of the input
whose names clash with the ledger's own are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, prepare, store, unused

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 30
MAX_UPPER_PERCENT = 70
MAX_MEAN_WORD = 20
MIN_ALPHA_PERCENT = 40

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: What fails each rule; the order gives the bits and is only ever extended.
RULES: dict[str, str] = {
    "too_few_words": f"n_words < {MIN_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words",
    "repeated_lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
    "shouting": f"100 * n_upper > {MAX_UPPER_PERCENT} * word_chars",
    "long_words": f"word_chars > {MAX_MEAN_WORD} * n_words",
    "few_letters": f"100 * n_letters < {MIN_ALPHA_PERCENT} * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]


@dataclass(frozen=True)
class Policy:
    """Rules that reject, under a version name that is stored with each verdict."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE_RULES = ("too_few_words", "repeated_words")
POLICIES = {
    "base": Policy("base", BASE_RULES),
    "v1": Policy("v1", (*BASE_RULES, "symbols", "repeated_lines", "shouting", "long_words", "few_letters")),
}


def _dropped(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in text order."""

    def covered(pairs: Column) -> Column:
        def starts(pair: Column, j: Column) -> Column:
            same = (F.get(pairs, j - 1)["w"] == pair["w"]) | (F.get(pairs, j + 1)["w"] == pair["w"])
            return F.when(same, pair["i"])

        return let(F.filter(F.transform(pairs, starts), lambda i: i.isNotNull()), lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))

    pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of every rule as long columns."""
    docs = docs.drop(*[m for m in MEASURES if m != text])
    t, solid, words, lines, windows = unused(docs, "t", "solid", "words", "lines", "windows")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.withColumns({t: body, solid: _dropped(body, _SPACES)})
    split = base.withColumns({words: F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != ""), lines: F.filter(F.split(t, "\n"), lambda line: _dropped(line, _SPACES) != "")})
    hashed = split.withColumn(windows, F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))))
    return hashed.select(
        *[f"`{c}`" for c in docs.columns],
        F.size(words).cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_dropped(F.col(t), _SYMBOLS))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(windows)).cast("long").alias("n_repeat_words"),
        F.regexp_count(solid, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.length(solid) - F.length(F.regexp_replace(solid, r"\p{L}+", ""))).cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failed_bits``: bit ``BIT[r]`` is set where rule ``r`` fails."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("failed_bits", bits)


def stored_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ledger without the texts, written once and read by every policy."""
    prepare(docs.sparkSession)
    return store(ledger(docs, text).drop(text), "quality-ledger")


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``policy`` (its version) and ``kept``."""
    return entries.withColumn("policy", F.lit(policy.version)).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def rule_profile(entries: DataFrame) -> DataFrame:
    """Documents and words for each combination of failures; ``bit_or`` of its rows is the rules that fail at all."""
    return entries.groupBy("failed_bits").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: documents that it fails, that it alone rejects, and that stay without it.

    ``shared_bits`` and ``other_bits`` are the rules that all and that any of the documents it fails break besides.
    The ledger is aggregated to its combinations of bits, 128 at most; the rest is bitwise work on these.
    """
    bits = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
    combined = rule_profile(entries).groupBy(bits.alias("bits")).agg(F.sum("n_docs").alias("n"))
    ruled = combined.withColumn("r", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])))
    n = F.col("n")
    own, others = F.col("r.bit"), F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    fails = F.col("bits").bitwiseAND(own) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0))
    out = ruled.groupBy(F.col("r.rule").alias("rule")).agg(
        total(fails).alias("n_failed"),
        total(fails & (others == 0)).alias("n_only"),
        total(others == 0).alias("n_kept_without"),
        F.coalesce(F.bit_and(F.when(fails, others)), F.lit(0)).alias("shared_bits"),
        F.coalesce(F.bit_or(F.when(fails, others)), F.lit(0)).alias("other_bits"),
    )
    return out.withColumn("policy", F.lit(policy.version))


def op10_quality(docs: DataFrame) -> DataFrame:
    """The digest of the contract: counts, ``base_failed`` and the verdict of policy v1, from the stored ledger."""
    judged = apply_policy(stored_ledger(docs.select("doc_id", "text")), POLICIES["v1"])
    base = F.col("failed_bits").bitwiseAND(F.lit(POLICIES["base"].mask)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits", "policy")


def rule_ablations(docs: DataFrame) -> DataFrame:
    """Ablations of policy v1 over all documents, from the stored ledger."""
    return ablations(stored_ledger(docs.select("doc_id", "text")), POLICIES["v1"])


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS s
  FROM documents),
g AS (SELECT rid, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'g': [w[i], w[i+1], w[i+2]]}), recursive := true) FROM d),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(s) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         length(s) - length(regexp_replace(s, '\p{Lu}', '', 'g')) AS n_upper,
         length(s) - length(regexp_replace(s, '\p{L}+', '', 'g')) AS n_letters
  FROM d LEFT JOIN c USING (rid)),
b AS (
  SELECT *, (n_words < 50)::BIGINT * 1 + (100 * n_repeat_words > 50 * n_words)::BIGINT * 2
    + (100 * n_symbols > 20 * n_words)::BIGINT * 4 + (100 * n_dup_lines > 30 * n_lines)::BIGINT * 8
    + (100 * n_upper > 70 * word_chars)::BIGINT * 16 + (word_chars > 20 * n_words)::BIGINT * 32
    + (100 * n_letters < 40 * word_chars)::BIGINT * 64 AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits & 127 = 0 AS kept, failed_bits, 'v1' AS policy
FROM b
"""

ABLATIONS_SQL = f"""
WITH j AS ({OP10_SQL}), r(rule, bit) AS (VALUES {", ".join(f"('{r}', {BIT[r]})" for r in POLICIES["v1"].rules)}),
x AS (SELECT rule, bit, failed_bits & bit <> 0 AS fails, failed_bits & ~bit::BIGINT AS others FROM j, r)
SELECT rule, 'v1' AS policy, count(*) FILTER (fails) AS n_failed, count(*) FILTER (fails AND others = 0) AS n_only, count(*) FILTER (others = 0) AS n_kept_without,
  coalesce(bit_and(others) FILTER (fails), 0) AS shared_bits, coalesce(bit_or(others) FILTER (fails), 0) AS other_bits
FROM x GROUP BY rule
"""
