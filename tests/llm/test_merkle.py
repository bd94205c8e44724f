"""Operator 12 against a plain tree, and its defined results."""

import hashlib
import string
import zlib

import pytest

from inkwell.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `a.b` int, slot int, digest string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """All levels from the leaves to the top."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    """The runs of siblings on the way up, each with the node's place in it."""
    found = []
    for level in levels[:-1]:
        found.append((level[at // 8 * 8 : at // 8 * 8 + 8], at % 8))
        at //= 8
    return found


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    upper = climb([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for at, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = path(trees[g], at) + path(upper, n)
            fold = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                fold = leaf(row, row[4].translate(LOWER))
            for run, k in way:
                fold = h("".join([*run[:k], fold, *run[k + 1 :]]))
            proof = h("".join(d for run, k in way for d in run[:k] + run[k + 1 :]))
            out.append((row[0], own, trees[g][-1][0], upper[-1][0], proof, fold, fold == upper[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)


def rows_of(n, lang, first=0):
    return [(first + k, "s", lang, k, f"Text {k}", 1, 2, "x") for k in range(n)]


@pytest.mark.parametrize("sizes", [(1,), (8, 1), (9, 64, 65), (600,), tuple([1] * 70)])
def test_trees_equal_plain_ones(spark, sizes):
    rows = [r for g, n in enumerate(sizes) for r in rows_of(n, f"l{g}", 1000 * g)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = rows_of(20, None) + rows_of(3, "") + rows_of(12, "é") + rows_of(5, "z") + rows_of(2, "🙂") + rows_of(1, "ﬀ")
    rows += [(None, None, None, None, None, None, None, None)] * 2 + [(None, "s", "z", 1, "NULL ID", 1, 1, "x")]
    rows += [(7, "s", "z", 3, "", 1, 2, "y"), (7, "s", "z", 3, "A" * 100_000, 1, 2, "y"), (3, "-", "z", -3, "-", 1, 2, "y")]
    rows += [(11, "same", "z", 1, "Same", 1, 1, "x")] * 30
    for parts in (1, 5):
        assert found(spark, rows, parts) == plain(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = merkle.manifest(none)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.count() == 0


def test_lengths_keep_values_apart(spark):
    rows = [(1, "a", "b", None, "x", 1, 1, "x"), (1, "a1:b", "b", None, "x", 1, 1, "x"), (1, None, "b", None, "-", 1, 1, "x"), (1, "-", "b", None, None, 1, 1, "x")]
    assert len({r[1] for r in found(spark, rows)}) == 4
