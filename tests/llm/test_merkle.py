"""The manifest against a tree built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from martspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("gid", "pos", "size", "leaf", "node", "block", "file", "row", "items", "s0", "top", "path", "root")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASH})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def built(nodes):
    """Levels of a tree, from its nodes to the one that remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i: i + 16]) for i in range(0, len(below), 16)])
    return levels


def siblings(levels, place):
    for level in levels[:-1]:
        start = place // 16 * 16
        yield "".join(level[start:place]), "".join(level[place + 1: start + 16])
        place //= 16


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[3]].append((row[0] is not None, row[0], leaf_of(*row), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[s] = built([x[2] for x in by_source[s]])
    top = built([trees[s][-1][0] for s in order])
    root = top[-1][0] if order else None
    out = []
    for i, s in enumerate(order):
        for place, (_, doc, leaf, row) in enumerate(by_source[s]):
            path = [*siblings(trees[s], place), *siblings(top, i)]
            node = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
                node = leaf_of(row[0], lowered(row[1]), *row[2:])
            for left, right in path:
                node = h(left, node, right)
            proof = h(*[left + right for left, right in path])
            out.append((doc, leaf, trees[s][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def got(docs):
    return sorted(map(tuple, merkle.verify(merkle.manifest(docs)[0]).collect()), key=str)


def rows_of(sizes, seed=0):
    rng = random.Random(seed)
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            doc += 1
            text = rng.choice([None, "", "plain", "With Capitals É", "long " * rng.randrange(40)])
            rows.append((rng.choice([doc, -doc]), text, rng.choice([None, "en"]), source, rng.choice([None, doc])))
    rng.shuffle(rows)
    return rows


SIZES = [
    {"a": 1},
    {"a": 2, None: 1, "": 16, "é": 17, "b": 255, "z": 256, "Z": 257},
    {f"s{i}": 1 for i in range(40)},
]


@pytest.mark.parametrize("sizes", SIZES)
def test_as_built_by_hand(spark, sizes):
    rows = rows_of(sizes)
    result = got(frame(spark, rows).repartition(4))
    assert result == expected(rows)
    assert sizes == SIZES[0] or {r[-1] for r in result} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_roots_of_blocks_recurse(spark, monkeypatch, levels):
    """Blocks of 16 and 256 leaves instead of 4096, so that small tables need several rounds."""
    real = merkle._LEVELS
    monkeypatch.setattr(merkle, "_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    made = merkle.blocks
    padded = [F.col("s0").alias(f"s{i}") for i in range(levels, real)]
    monkeypatch.setattr(merkle, "blocks", lambda *x: made(*x).select("*", *padded))
    rows = rows_of({"hot": 4500, "b": 257, "c": 256, "d": 4097 if levels == 1 else 300, **{f"s{i}": 2 for i in range(300)}})
    assert got(frame(spark, rows).repartition(6)) == expected(rows)


def test_a_source_of_several_blocks(spark):
    rows = [(i, f"Text {i}", "en", "hot", i) for i in range(9000)] + [(-1, "x", None, None, None)]
    assert got(frame(spark, rows).repartition(5)) == expected(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "A", "en", "x", 1)] * 40 + [(1, "B", "en", "x", 1), (None, "C", "en", "x", 1), (None, "C", "en", "x", 1)]
    rows += [(2, "W" * 300_000, "en", "y", 1)]
    result = got(frame(spark, rows).repartition(3))
    assert result == expected(rows)


def test_an_empty_table_has_no_root(spark):
    found, sources = merkle.manifest(frame(spark, []))
    assert found.count() == 0 and sources.count() == 0


def test_sources_and_paths_of_the_manifest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, sources = merkle.manifest(docs)
    assert {r["source"]: r["rows"] for r in sources.collect()} == {
        r["source"]: r["count"] for r in docs.groupBy("source").count().collect()
    }
    assert sources.select("root").distinct().count() == 1
    honest = found.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"))
    assert honest.count() == docs.count()
    plan = merkle.verify(found)._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Python", "Pandas", "Arrow", "BroadcastNestedLoop") if node in plan]


def test_query_against_its_sql(spark, sf_dir):
    import oracle

    from martspark.llm.queries import ORACLES, QUERIES

    con = oracle.connect(sf_dir)
    name = "op13_merkle_manifest"
    assert oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []
