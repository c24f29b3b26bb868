import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quernel.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, proofs):
    """Root of nodes; proofs (lists, one for each node's rows) get (sibling or None, left) steps."""
    while len(nodes) > 1:
        for i, group in enumerate(proofs):
            j = i ^ 1
            for p in group:
                p.append((nodes[j] if j < len(nodes) else None, i % 2 == 1))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        proofs = [[p for group in proofs[i : i + 2] for p in group] for i in range(0, len(proofs), 2)]
    return nodes[0]


def fold(at, steps):
    for sibling, left in steps:
        at = h(at) if sibling is None else h(sibling, at) if left else h(at, sibling)
    return at


def by_hand(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    out, subroots, groups = [], [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        proofs = [[[]] for _ in mine]
        flat = [g[0] for g in proofs]
        subroots.append(climb([leaf(r) for r in mine], proofs))
        groups.append(flat)
        out += [(r, p, subroots[-1]) for r, p in zip(mine, flat, strict=True)]
    root = climb(subroots, [list(g) for g in groups]) if subroots else None
    told = []
    for r, steps, subroot in out:
        changed = list(r)
        if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
            changed[3] += 1
        folded = fold(leaf(changed), steps)
        told.append((r[0], leaf(r), subroot, root, h(*(s for s, _ in steps if s)), folded, folded == root))
    return sorted(told, key=str)


def cases(n):
    rnd = random.Random(n)
    word = lambda: rnd.choice(["", "a", "é", "日本\n", "3:abc", "-", "😀 x"]) * rnd.randrange(3)
    one = lambda i: (rnd.choice([i, i, i, None, 5, -i]), rnd.choice([None, "", "s1", "é"]), rnd.choice([None, "", "en", "en", "en", "fr", "ß", "-", "=", "zz"]), rnd.choice([None, i, 0, (1 << 63) - 1]), rnd.choice([None, word(), word()]))
    made = [one(i) for i in range(n)]
    return made + made[: n // 5] + [(8, "s", "alone", 1, "x")]


@pytest.mark.parametrize(("n", "levels"), [(0, 1), (7, 1), (60, 1), (150, 2), (150, 3)])
def test_whole_results_equal_brute_force(as_table, n, levels):
    rows = cases(n)
    got = sorted((tuple(r) for r in merkle.verify_manifest(as_table(rows, SCHEMA), levels).collect()), key=str)
    assert got == by_hand(rows)


def test_buckets_and_orders_do_not_change_the_root(as_table):
    rows = [(i % 1700, None, "en" if i % 3 else None, i, "word " * (i % 7)) for i in range(2600)]
    one = merkle.manifest(as_table(rows, SCHEMA, name="one"))
    expected = {r[3] for r in by_hand(rows)}
    assert {r.root for r in one.select("root").distinct().collect()} == expected
    random.Random(1).shuffle(rows)
    again = merkle.manifest(as_table(rows, SCHEMA, name="two").repartition(13))
    assert {r.root for r in again.select("root").distinct().collect()} == expected
    assert one.where(merkle.folded(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0


def test_long_texts_and_an_empty_table(as_table):
    rows = [(1, "s", "en", 12_000_000, "long é " * 2_000_000), (2, "s", "en", 0, "")]
    got = sorted((tuple(r) for r in merkle.verify_manifest(as_table(rows, SCHEMA)).collect()), key=str)
    assert got == by_hand(rows)
    assert merkle.verify_manifest(as_table([], SCHEMA, name="none")).collect() == []


def test_a_change_anywhere_is_seen(as_table):
    rows = cases(40)
    root = by_hand(rows)[0][3]
    for changed in ([*rows, rows[0]], rows[1:], [(rows[0][0], rows[0][1], rows[0][2], rows[0][3], "other"), *rows[1:]]):
        assert merkle.manifest(as_table(changed, SCHEMA)).first().root != root
