"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from martspark.llm import spelling

CLASH = ("word", "n", "m", "a", "b", "key", "near", "form", "root", "s", "best")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})


def counted(rows, least=7):
    words = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 2}


def one_edit(x, y):
    x, y = sorted((x, y), key=len)
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def expected(words, ratio=10):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def texts(seed):
    """Few stems, many variants and ties; letters that are not a-z; a long text; odd rows."""
    rng = random.Random(seed)
    stems = ["colouring", "colorings", "straßenbahn", "aaaaaaaaaa", "×÷×÷×÷×÷", "Éclairages", "éclairages", "organise"]
    words = []
    for _ in range(1500):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abé×") + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice("abé×") + w[i + 1:]])
        words += [w] * rng.choice([1, 2, 2, 30])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40: i * 40 + 40])) for i in range(len(words) // 40)]
    rows += [(None, "colouring colouring"), (-5, None), (-6, ""), (-7, " 1_2\n"), (-8, "ÀÉ日本colouring日Organiseİx")]
    rows += [(-9, "b" * 5000 + " " + "b" * 5000 + " " + "b" * 4999 + "c " + "b" * 4999 + "c"), rows[0], rows[0]]
    return rows + [(-10, " ".join(words))]


@pytest.mark.parametrize("group_words", [3, spelling.GROUP_WORDS])
def test_variants(spark, group_words):
    rows = texts(group_words)
    got = spelling.spelling_variants(frame(spark, rows).repartition(3), group_words=group_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = expected(counted(rows))
    assert any(r[1] and r[2] != r[1] for r in want) and max(r[4] for r in want) > 20
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_small_table_of_the_given_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = spelling.spelling_variants(docs, min_length=9)
    assert sorted(tuple(r) for r in got.collect()) == expected(counted(map(tuple, docs.select("doc_id", "text").collect()), 9))


def test_an_empty_table_has_no_words(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


def test_groups_stay_small_when_all_words_share_a_stem(spark):
    """All words begin and end alike; halving the interval still ends in small groups, and no pair is lost."""
    rng = random.Random(1)
    words = sorted({"pre" + "".join(rng.choice("ab") for _ in range(12)) + "fix" for _ in range(3000)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rows = spelling.blocks(df, group_words=50)
    largest = rows.groupBy("m", "a", "b", "key").count().agg(F.max("count")).first()[0]
    assert largest <= 50
    known = set(words)
    want = {(w, w[:i] + c + w[i + 1:]) for w in words for i in range(len(w)) for c in "abprefix"}
    got = {(r["word"], r["near"]) for r in spelling.near_pairs(rows).collect()}
    assert got == {(w, v) for w, v in want if v in known and v != w}


def test_distances_come_from_the_products(monkeypatch):
    """Only pairs whose letter counts are at most 2 apart are compared by letter."""
    words = ["abcdefg", "abcdefh", "abcdxyz", "gfedcba", "abcdefgg"]
    seen = []
    real = spelling._verified
    monkeypatch.setattr(spelling, "_verified", lambda *x: seen.extend(zip(x[5].tolist(), x[6].tolist())) or real(*x))
    zero, seven = np.zeros(5, int), np.full(5, 7)
    found = [(i, j) for a, b in spelling.near_in_block(words, 7, zero, seven, zero) for i, j in zip(a, b)]
    assert found == [(0, 1), (0, 4)]
    assert (0, 3) in seen and (0, 2) not in seen and (1, 2) not in seen


def test_a_ratio_that_allows_circles_is_refused(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, []), ratio=1)
