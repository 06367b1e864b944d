import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from prosemill.llm import prefix_trie


def table(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)


def digest(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def arrays_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    return {c: [x[3] for x in sorted(v)] for c, v in out.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    return sorted(
        str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())) for p, m in members.items()
    )


def result(frame):
    return sorted(str(tuple(r)) for r in frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(260), -1, -150, 10_100, 10_101, 10_177]:
        if c == 100:
            continue  # a century without its first conversation
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"turn {t} {rng.randrange(3)} é𝄞"))
    rows += [(c, t, "user", f"hot {t}") for c in range(300, 460) for t in range(7)]
    rows += [(c, t, "user", f"hot {t}") for c in range(500, 530) for t in range(9)]
    rows += [(600, None, None, "late?"), (600, 2, "a", None), (600, 2, "a", "x"), (600, 1, None, None), (601, 1, "a", "x"), (601, 1, "a", "x"), (None, 1, "a", "lost")]
    return rows + [(700, t, "user", f"long {t % 7}") for t in range(900)] + [(701, t, "user", f"long {t % 7}") for t in range(650)]


def test_against_brute_force(spark, rows):
    assert result(prefix_trie.op11_trie(table(spark, rows))) == brute(rebuild(arrays_of(rows)))


@pytest.mark.parametrize(("parts", "waiting"), [(1, 10_000), (7, 3), (60, 10_000), (1, 1)])
def test_any_partitions(spark, rows, parts, waiting):
    """Edges that cut shared prefixes, equal conversations and long ones; nodes with more children than wait."""
    arrays = prefix_trie.turn_arrays(table(spark, rows))
    assert result(prefix_trie.prefix_trie(arrays, parts, waiting)) == brute(arrays_of(rows))


def test_every_edge():
    """All cuts of a sorted list of small arrays into partitions, by the sweep alone."""
    rng = random.Random(4)
    for _ in range(150):
        seqs = {c: [("", "xyz"[rng.randrange(3)] * rng.randrange(1, 3)) for _ in range(rng.randrange(5))] for c in rng.sample(range(50), 9)}
        mark = lambda turn: bytes.fromhex(digest(*turn))[: prefix_trie._SIZE]
        ordered = sorted((b"".join(map(mark, s)), c, [len(t[1]) for t in s]) for c, s in seqs.items())
        cuts = sorted(rng.sample(range(1, len(ordered)), rng.randrange(4)))
        parts = [ordered[a:b] for a, b in zip([0, *cuts], [*cuts, len(ordered)])]
        n_convs, n_children, n_leaves, saved = 0, 0, 0, 0
        for k, part in enumerate(parts):
            before = prefix_trie.shared(parts[k - 1][-1][0], part[0][0]) if k else -1
            after = prefix_trie.shared(part[-1][0], parts[k + 1][0][0]) if k + 1 < len(parts) else -1
            sweep = prefix_trie.Sweep(before, after, set(), waiting=rng.choice([1, 100]))
            for row in part:
                sweep.add(*row)
            sweep.finish()
            root = [r for r in sweep.rows if r[3] == 0]
            assert len(root) == 1
            n_convs, n_children, n_leaves, saved = (x + y for x, y in zip((n_convs, n_children, n_leaves, saved), root[0][6:10]))
        want = next(r for r in brute(seqs) if r.split(", ")[1] == "0").strip("()").split(", ")
        assert [str(x) for x in (n_convs, n_children, n_leaves, saved)] == want[3:7]


def test_empty_tables_and_clashing_columns(spark, rows):
    assert prefix_trie.op11_trie(table(spark, rows).limit(0)).collect() == []
    few = rows[:90]
    odd = table(spark, few).selectExpr("*", "1 AS known", "2 AS first", "3 AS h", "4 AS key", "5 AS part", "6 AS depth", "7 AS head", "8 AS turns")
    assert result(prefix_trie.op11_trie(odd)) == brute(rebuild(arrays_of(few)))


def test_only_turnless_conversations(spark):
    """Conversations whose own turns are all replaced by nothing end at the root."""
    one = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(one, 0, "user", "a"), (one, 1, "user", "b")]
    assert result(prefix_trie.op11_trie(table(spark, rows))) == brute({one: []})


def test_very_long_text(spark):
    rows = [(0, 0, "user", "ä" * 3_000_000), (1, 0, "user", "ä" * 3_000_000), (2, 0, "user", "ä" * 2_999_999)]
    assert result(prefix_trie.prefix_trie(prefix_trie.turn_arrays(table(spark, rows)))) == brute(arrays_of(rows))
