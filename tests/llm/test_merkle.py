"""The manifest against a plain tree, with few and many nodes left to the driver."""

import hashlib
import zlib

import pytest
from tidemark.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain(rows):
    def tree(nodes):
        """Root, and for each node the siblings left and right by level."""
        sides, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
                sides[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
                at[i] = k // 3
            nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        return (nodes[0] if nodes else None), sides

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by_source[s], key=lambda x: x[:3]), *tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])])) for s in names}
    root, upper = tree([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, upper):
        leaves, subroot, sides = trees[s]
        for (_, _, leaf, row), side in zip(leaves, sides):
            bent = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and bent:
                bent = bent.replace("\n", "")
            node = leaf_of(row, bent)
            for left, right in side + up:
                node = H(left, node, right)
            out.append((row[0], leaf, subroot, root, H(*(x for pair in side + up for x in pair)), node, node == root))
    return sorted(out, key=str)


def made(spark, rows, top=4096, slices=4):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(slices)
    return sorted((tuple(r) for r in merkle.manifest(docs, top=top).collect()), key=str)


def rows_of(n, sources):
    return [(i, None if i % sources == 0 else f"s{i % sources}", "en" if i % 5 else None, i * 3, f"line {i}\nend" if i % 4 else None) for i in range(n)]


@pytest.mark.parametrize("n,sources,top", [(1, 1, 4096), (2, 1, 4096), (3, 1, 4096), (4, 1, 4096), (40, 3, 4096), (40, 40, 4096), (3000, 2, 4096), (3000, 2, 3), (1500, 1500, 1), (2200, 3, 1)])
def test_trees(spark, n, sources, top):
    assert made(spark, rows_of(n, sources), top) == plain(rows_of(n, sources))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", None, ""), (5, "é", "日本", -3, "a\n\nb"), (5, "é", "日本", -3, "a\n\nb"), (5, "é", "x", -3, "\n"), (6, "z\n", None, 0, "\n" * 50), (7, "z", "en", 2**60, "x" * 300_000 + "\n")]
    assert made(spark, rows) == plain(rows)


def test_layout_does_not_matter(spark):
    assert made(spark, rows_of(500, 4), slices=1) == made(spark, rows_of(500, 4), slices=9)


def test_hot_source(spark):
    rows = [(i, "hot" if i % 10 else f"s{i}", "en", 1, str(i)) for i in range(2500)]
    assert made(spark, rows, top=8) == plain(rows)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "s", "en", 3, "a\nb", "q", 2, "z")], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, node string")
    assert [tuple(r) for r in merkle.manifest(docs).collect()] == plain([(1, "s", "en", 3, "a\nb")])
    assert merkle.manifest(docs.where("false")).count() == 0
