"""The text operators against brute force on small tables, with the odd cases of every table."""

import hashlib
import json
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from martspark.llm import (
    bpe,
    fingerprints,
    line_dedup,
    packing,
    pii,
    quality,
    simhash,
    substring_dedup,
    tool_calls,
    toxicity,
)
from martspark.llm.components import connected

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
# Extra columns whose names clash with those used inside.
CLASH = ("doc", "id", "pos", "r", "t", "s", "fp", "part", "k", "ID2")


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("x"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(1) for c in CLASH}) if clash else df


@pytest.fixture(scope="module")
def odd():
    """Empty, blank, NULL, odd letters, ties, repeated rows and a very long text."""
    rng = random.Random(3)
    letters = "abé ß\t\n's1²½中🙂<|endoftext|>!-  "
    texts = [None, "", " \n\t", "one", "one two", "a\x1cb\x85c\xa0d", "<|endoftext|> x <|startoftext|>", "🙂" * 70]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(rng.choice(["the", "of", "and", "x,"]) for _ in range(rng.randint(3, 90))) for _ in range(40)]
    texts.append(" ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randint(0, 99)) for _ in range(20_000)))
    rows = [(7 * i - 20, t) for i, t in enumerate(texts)]
    return rows + rows[-3:-1]


@pytest.fixture(scope="module")
def docs(spark, odd):
    return frame(spark, odd).repartition(3)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


EMPTY_INPUT = {
    "fingerprints": lambda d: fingerprints.edited_fingerprints(d),
    "packing": lambda d: packing.pack_documents(d, BYTE_BPE),
    "lines": lambda d: line_dedup.line_report(d),
    "dedup": lambda d: line_dedup.dedup_lines(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "one": lambda d: simhash.keep_one(d),
    "substrings": lambda d: substring_dedup.remove_repeats(d),
    "quality": lambda d: quality.score_quality(d),
    "good": lambda d: quality.keep_good(d),
    "bpe": lambda d: bpe.encode_documents(d, WORD_BPE),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.EMPTY),
    "pii": lambda d: pii.find_personal_data(d),
    "mask": lambda d: pii.mask_personal_data(d),
}


@pytest.mark.parametrize("name", sorted(EMPTY_INPUT))
def test_an_empty_table_gives_no_rows(spark, name):
    assert EMPTY_INPUT[name](frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["dedup", "one", "good", "mask"])
def test_stages_keep_the_columns(docs, name):
    assert EMPTY_INPUT[name](docs).columns == docs.columns


# -- 1 -----------------------------------------------------------------------------------------------


def winnowed(text, k=4, window=4):
    prime = (1 << 31) - 1
    units = [xxhash.xxh64_intdigest(u.encode(), 42) & prime for u in re.findall(r"[^\x20\x09-\x0D]{1,64}", text)]
    grams = []
    for i in range(len(units) - k + 1):
        h = 0
        for u in units[i: i + k]:
            h = (h * 1_000_003 + u) % prime
        grams.append(h)
    chosen = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i: i + window]
        if part:
            at = i + max(j for j, g in enumerate(part) if g == min(part))
            if (grams[at], at) not in chosen:
                chosen.append((grams[at], at))
    return ",".join(str(h * 2**31 + 2**31 - 1 - at) for h, at in chosen), len(units)


def test_fingerprints(spark, odd):
    unique = dict(odd)
    rows = sorted(unique.items(), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(text) < 5000:
            expected, n = winnowed(text)
            if n >= 4 or not n:
                assert r["fingerprint"] == expected
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_text = {}
    for doc, text in rows:
        by_text.setdefault(text or "", set()).add(got[doc]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_ranges_follow_the_rows(spark, monkeypatch):
    """100,000 documents at 8 partitions: as many ranges as the rows need, and no large one."""
    monkeypatch.setattr(fingerprints, "_RANGE_ROWS", 500)
    docs = spark.range(100_000).select((F.col("id") * F.col("id")).alias("doc_id"), F.lit("a b").alias("text"))
    sizes = [r["count"] for r in fingerprints.in_order(docs).where("rank = 1").groupBy("part").count().collect()]
    assert sum(sizes) == 100_000 and len(sizes) == 200 and max(sizes) <= 700


def test_likeness_and_edited_fingerprints_by_hand(spark, odd):
    """Edited texts fingerprinted by hand, short ones included, and both likenesses as shared over all hashes."""
    rows = sorted({d: t for d, t in odd if len(t or "") < 5000}.items(), reverse=True)

    def print_of(text):
        units = re.findall(r"[^\x20\x09-\x0D]{1,64}", text)
        return winnowed(text)[0] if len(units) >= 4 or not units else None

    def hashes(listed):
        return {int(x) >> 31 for x in listed.split(",") if x}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()}
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        r = got[doc]
        by_hand = print_of(text[: len(text) - half] + following[:half])
        if by_hand is not None:
            assert r["edited_fingerprint"] == by_hand
        else:
            assert len(hashes(r["edited_fingerprint"])) == 1
        own = hashes(r["fingerprint"])
        assert r["near_edited"] == pytest.approx(like(own, hashes(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(like(own, hashes(got[rows[(i + 1) % len(rows)][0]]["fingerprint"])))


def test_edited_texts_are_nearer_than_others(real):
    r = fingerprints.edited_fingerprints(real).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert r[0] > 0.25 and r[1] < 0.05


def test_repeated_ids_and_a_single_document(spark):
    assert fingerprints.edited_fingerprints(frame(spark, [(1, "a b c d e f")])).first()["n_chars"] == 11
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None)]
    assert fingerprints.edited_fingerprints(frame(spark, rows)).count() == 4


# -- 2 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(docs, odd, size):
    library = Tokenizer.from_file(BYTE_BPE)
    pieces = packing.pack_documents(docs, BYTE_BPE, size).collect()
    lengths = {}
    for p in pieces:
        lengths.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    fills = []
    for parts in lengths.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        fills.append(at)
    # No padding is needed: windows are full or have the length of a power of two.
    assert max(fills) <= size and all(f == size or f & (f - 1) == 0 for f in fills)
    copies = {}
    for doc, text in odd:
        copies.setdefault(doc, []).append(text or "")
    for doc, texts in copies.items():
        ids = library.encode(texts[0], add_special_tokens=False).ids + [1]
        own = sorted((p["start"], p["length"], bytes(p["ids"])) for p in pieces if p["doc_id"] == doc)
        assert {p["doc_tokens"] for p in pieces if p["doc_id"] == doc} == {len(ids)}
        assert sum(n for _, n, _ in own) == len(ids) * len(texts)
        for start, n, packed in own:
            assert packed == struct.pack(f"<{n}I", *ids[start: start + n])
    p = packing.digest(packing.pack_documents(docs, BYTE_BPE, size)).first()
    raw = next(bytes(q["ids"]) for q in pieces if (q["doc_id"], q["start"], q["length"]) == (p["doc_id"], p["start"], p["length"]))
    assert p["ids_crc32"] == zlib.crc32(raw)


def test_a_rest_goes_where_the_squares_grow_least():
    packer = packing.Packer(8)
    ids = [b"\0\0\0\0" * n for n in (5, 5, 6)]
    assert [list(packer.add(i, x)) for i, x in enumerate(ids)] == [[], [], []]
    # Three more tokens fill one of the two windows at level 5 rather than open a third level.
    assert [len(w) for w in packer.add(3, b"\0\0\0\0" * 3)] == [2]
    assert list(np.flatnonzero(packer.count)) == [5, 6]


@pytest.mark.parametrize("per_task", [1, 2, 30, 1000])
def test_windows_keep_what_was_placed_in_them(per_task):
    """At the end of a task the rest is only moved where windows are not full: under a tenth at 1,000 documents."""
    rng, size = np.random.default_rng(5), 2048
    lengths = np.minimum(rng.lognormal(6.3, 1.1, 3 * per_task).astype(int) + 1, 20_000)
    placed = moved = 0
    for at in range(0, len(lengths), per_task):
        packer, made = packing.Packer(size), []
        for doc, n in enumerate(lengths[at: at + per_task]):
            made += packer.add(doc, np.arange(n, dtype="<u4").tobytes())
        open_windows = [[p[:2] for p in w] for level in packer.open.values() for w in level]
        last = list(packer.rest())
        ends = [[p[:2] for p in w] for w in last]
        for w in open_windows:
            n = sum(int(lengths[at + doc]) - start for doc, start in w)
            moved += 0 if any(end[: len(w)] == w for end in ends) else n
        placed += sum(int(n) % size for n in lengths[at: at + per_task])
        ids, smaller = {}, 0
        for w in made + last:
            n = sum(len(p[2]) // 4 for p in w)
            assert n == size or n & (n - 1) == 0
            smaller += n < size
            for doc, start, cut, _ in w:
                assert cut
                ids.setdefault(doc, []).append((start, np.frombuffer(cut, "<u4")))
        for doc, cuts in ids.items():
            assert np.array_equal(np.concatenate([c for _, c in sorted(cuts, key=lambda c: c[0])]), np.arange(lengths[at + doc]))
        assert len(ids) == per_task and smaller <= 11
    if per_task == 1000:
        assert moved < 0.1 * placed


# -- 3 -----------------------------------------------------------------------------------------------


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len, reverse=True)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def slow_lines(rows):
    """Places of the lines of each document that repeat an earlier one."""
    seen, expected = [], {}
    for doc, text in sorted(rows):
        for at, text_line in enumerate((text or "").split("\n")):
            own = text_line.encode().split()
            if own:
                if any(x == own or (min(len(x), len(own)) >= 8 and one_apart(x, own)) for x in seen):
                    expected.setdefault(doc, []).append(at)
                seen.append(own)
    return expected


def test_line_dedup(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "dé", "e,"]

    def line():
        n = rng.choice([1, 2, 7, 8, 9, 9, 10, 16, 17, 17, 24, 25])
        return [rng.choice(words[:2] if n < 20 else words) for _ in range(n)]

    pool, rows = [line() for _ in range(25)], []
    for i in range(100):
        lines = []
        for _ in range(rng.randint(0, 4)):
            own = list(rng.choice(pool)) if rng.random() < 0.7 else line()
            at, kind = rng.randrange(len(own)), rng.random()
            if kind < 0.2:
                own[at] = rng.choice(words)
            elif kind < 0.4:
                own.pop(at)
            elif kind < 0.6:
                own.insert(at, rng.choice(words))
            lines.append(rng.choice([" ", "  ", "\t"]).join(own))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n "), (-5, "x y z")]
    expected = slow_lines(rows)
    docs = frame(spark, rows).repartition(4)
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == expected and sum(map(len, got.values())) > 50
    after = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for doc, text in rows:
        kept = None if text is None else "\n".join(
            x for i, x in enumerate(text.split("\n")) if i not in expected.get(doc, ()))
        assert after[doc]["text"] == kept and after[doc]["n_chars"] == (None if kept is None else len(kept))


def test_lines_of_rows_that_share_an_id(spark):
    rng = random.Random(7)

    def line(n=12):
        return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))

    a, b, c = line(), line(), line()
    near = " ".join(["other", *c.split()[1:]])
    rows = [
        (None, f"{line()}\n{a}"), (None, f"{a}\n{line()}\n{line()}"), (1, f"{line()}\n{line()}\n{line()}\n{b}\n{c}"),
        (1, line()), (1, f"{line()}\n{a}"), (2, f"{b}\n{line()}"), (2, line()), (2, f"{line()}\n{near}"), (2, line()),
    ] + [(2**62 + i, f"{line()}\n{near}") for i in range(3)]
    gone = {rows[i]: p for i, p in ((0, [1]), (4, [1]), (5, [0]), (7, [1]), (9, [1]), (10, [1]), (11, [1]))}
    docs = frame(spark, rows + rows[-1:]).repartition(3)
    for r in line_dedup.dedup_lines(docs).select("doc_id", "text", "n_chars").collect():
        kept = {
            "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ()))
            for d, t in rows if d == r["doc_id"]
        }
        assert r["text"] in kept and r["n_chars"] == len(r["text"])
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["removed"]) for r in line_dedup.line_report(docs).collect())
    expected = [(d or 0, t.count("\n") + 1, ",".join(map(str, gone.get((d, t), ())))) for d, t in rows + rows[-1:]]
    assert got == sorted(expected)


# -- 4 -----------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 1, "sum", '{"y": 2, "x": 1}', ["b", "gone"]),
        (1, "b", 5, "sum", '{"x": 1.5, "y": 0}', []),
        (1, "c", 6, "sum", '{"x": "1"}', ["a"]),
        (1, "c", 9, "sum", '{"x": 1, "y": 2}', None),
        (2, "d", 1, "loop", "{}", ["e"]),
        (2, "e", 2, "loop", "{}", ["d"]),
        (2, "f", 3, "what", "{}", ["e"]),
        (3, "g", 1, "loop", "{no", None),
        (3, "h", 2, "loop", None, None),
        (3, None, 3, "loop", "{}", None),
        (4, "i", 1, "loop", '{"é": [true, null]}', None),
    ], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame(
        [("a", 2, "3"), ("a", 3, "4"), ("b", 9, ""), ("zz", 1, "orphan"), ("i", 1, 'say "ü"\n'), (None, 1, "x")],
        "call_id string, turn long, content string")
    schemas = {"sum": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "number"}}},
               "loop": {"type": "object"}}
    got = {r["call_id"]: r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert {c: (r["level"], r["status"]) for c, r in got.items()} == {
        "a": (1, "linked"), "b": (0, "linked"), "c": (2, "arguments.y: missing"), "d": (None, "circular dependency"),
        "e": (None, "circular dependency"), "f": (None, "unknown tool"), "g": (0, "arguments: not JSON"),
        "h": (0, "arguments: not object"), "i": (0, "linked")}
    assert got["a"]["message"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"sum","result":"3","type":"tool_call"}'
    assert json.loads(got["i"]["message"])["result"] == 'say "ü"\n' and "é" in got["i"]["message"]
    assert tool_calls.link_calls(calls.limit(0), results, schemas).count() == 0


def test_levels_same_as_brute_force(spark):
    """Long chains, calls with several dependencies, repeated and unknown ones, and circles."""
    rng = random.Random(8)
    needs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(150)}  # one long chain
    for i in range(120):
        needs[f"d{i}"] = [f"d{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if i else []
    needs |= {f"star{i}": ["c149"] for i in range(20)} | {"both": ["star3", "d119", "both2"], "both2": ["c3", "c90"]}
    needs |= {"x": ["y"], "y": ["z"], "z": ["x"], "behind": ["x"], "more": ["c1", "behind"], "self": ["self"], "lost": ["gone"]}
    expected = {}
    for _ in needs:
        for call, on in needs.items():
            on = [n for n in on if n in needs]
            if all(n in expected for n in on):
                expected[call] = max((expected[n] + 1 for n in on), default=0)
    calls = spark.createDataFrame(list(needs.items()), "call_id string, depends_on array<string>")
    assert dict(map(tuple, tool_calls.levels(calls).collect())) == expected
    assert max(expected.values()) > 150 and {"x", "behind", "more", "self"}.isdisjoint(expected)


def test_tool_calls_same_as_sql(spark, sf_dir):
    import oracle

    from martspark.llm.queries import ORACLES, QUERIES

    con = oracle.connect(sf_dir)
    assert oracle.compare(QUERIES["op4_tool_calls"](spark, sf_dir), con, ORACLES["op4_tool_calls"]) == []


def test_arguments_that_break_readers_and_clashing_columns(spark):
    deep = "[" * 200_000
    given = {
        "half": '{"text":"\\ud83d"}', "name": '{"\\udc00":1}', "deep": deep, "nested": "[" * 900 + "]" * 900, "nan": '{"x":NaN}',
        "minus": "-Infinity", "huge": '{"x":1e999}', "fine": '{"text":"\\ud83d\\ude00"}', "digits": '{"x":' + "9" * 5000 + "}",
    }
    clash = {c: F.lit(1) for c in ("content", "r", "c", "n", "end", "steps", "done", "base", "level", "status", "message", "Turn_")}
    calls = spark.createDataFrame(
        [(1, c, i, "free" if c != "name" else "closed", a, None) for i, (c, a) in enumerate(given.items())],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>",
    ).withColumns(clash)
    results = spark.createDataFrame([(c, 1, "ok") for c in given], "call_id string, turn long, content string")
    results = results.withColumns({c: F.lit(1) for c in clash if c != "content"})
    schemas = {"free": {}, "closed": {"additionalProperties": False}}
    got = {r["call_id"]: (r["status"], r["message"]) for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert {c: s for c, (s, _) in got.items()} == {
        "half": "linked", "name": "arguments.\\udc00: unknown", "deep": "arguments: too deep",
        "nested": got["nested"][0], "nan": "arguments: not JSON", "minus": "arguments: not JSON",
        "huge": "arguments: number out of range", "fine": "linked", "digits": "arguments: not JSON",
    }
    assert got["nested"][0] in ("linked", "arguments: too deep")
    for call, (_, message) in got.items():
        read = json.loads(message)
        assert read["id"] == call and read["result"] == "ok"
    assert json.loads(got["half"][1])["arguments"] == {"text": "\ud83d"} and "\\ud83d" in got["half"][1]
    assert json.loads(got["deep"][1])["arguments"] == deep and "😀" in got["fine"][1]


def test_turns_without_a_role_are_neither_calls_nor_results(spark):
    turns = [(1, 0, "user", "a"), (1, 1, None, "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, None, "e")]
    conversations = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = tool_calls.link_calls(*tool_calls.from_conversations(conversations), tool_calls.SCHEMAS)
    assert sorted((r["call_id"], r["level"], r["status"]) for r in got.collect()) == [
        ("call-1-0", 0, "no result"), ("call-1-2", 1, "linked")]


# -- 5 -----------------------------------------------------------------------------------------------


def groups_of(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def slow_simhash(text, k=3):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = WORDS.findall(words)
    shingles = [" ".join(words[i: i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_of_odd_texts(docs, odd):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    rows = [(d, t or "") for d, t in odd if len(t or "") < 5000]
    prints = [slow_simhash(t) for _, t in rows]
    for (doc, _), p in zip(rows, prints):
        assert got[doc]["fp"] == simhash.signed(p)
    assert simhash.near_duplicates(docs).count() == len(odd)


@pytest.mark.parametrize("cell", [16, 1 << 15])
@pytest.mark.parametrize("distance", [2, 3, 5])
def test_trie_join_links_what_brute_force_links(spark, monkeypatch, cell, distance):
    """With small cells the trie is cut deeper, as for very many fingerprints in one place."""
    monkeypatch.setattr(simhash, "_CELL", cell)
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(15)] + [0x0F0F << 48]
    values = set()
    for b in base * 12:
        for _ in range(rng.randint(0, 4)):
            b ^= 1 << rng.randrange(64)
        values.add(b)
    values = sorted(values | {base[-1] ^ rng.getrandbits(8) for _ in range(60)})
    signed = [simhash.signed(v) for v in values]
    keys = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r["node"]: r["root"] for r in connected(simhash.linked(keys, distance)).collect()}
    found = [roots.get(v, v) for v in signed]
    expected = groups_of(values, lambda a, b: (a ^ b).bit_count() <= distance)
    assert len(set(zip(found, expected))) == len(set(found)) == len(set(expected))


def test_near_duplicates_of_the_table(real):
    rows = simhash.near_duplicates(real).collect()
    roots = groups_of([r["fp"] for r in rows], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    least = {}
    for r, g in zip(rows, roots):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least[g] for r, g in zip(rows, roots))
    kept = {r["doc_id"] for r in simhash.keep_one(real).select("doc_id").collect()}
    assert kept == set(least.values())


def test_connected_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    out = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}


# -- 6 -----------------------------------------------------------------------------------------------


def slow_repeats(rows, window=50):
    first, words = {}, {d: WORDS.findall(t or "") for d, t in rows}
    for doc in sorted(words):
        for i in range(len(words[doc]) - window + 1):
            first.setdefault(tuple(words[doc][i: i + window]), doc)
    out = {}
    for doc, own in words.items():
        gone = set()
        for i in range(len(own) - window + 1):
            if first[tuple(own[i: i + window])] < doc:
                gone.update(range(i, i + window))
        out[doc] = (len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone))
    return out


@pytest.mark.parametrize("hot, shard", [(500, 1000), (5, 20)])
def test_substring_dedup(spark, odd, monkeypatch, hot, shard):
    monkeypatch.setattr(substring_dedup, "_HOT", hot)
    monkeypatch.setattr(substring_dedup, "_SHARD", shard)
    rng = random.Random(9)

    def words(n):
        return [rng.choice("abcdefgh") for _ in range(n)]

    pool, rows = [words(rng.randint(45, 140)) for _ in range(10)], []
    for i in range(150):
        own = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            own += words(rng.randint(0, 30)) + p[rng.randint(0, 20): len(p) - rng.randint(0, 20)]
            own += ["z"] * rng.choice([0, 0, 0, 90])
        rows.append((5000 - i * 3, " ".join(own)))
    rows += [(6000, rows[3][1]), (6001, rows[3][1])] + [r for r in dict(odd).items()]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == slow_repeats(rows) and sum(g[1] for g in got.values()) > 1000


def test_an_anchor_many_times_in_few_documents_is_dealt_out(spark, monkeypatch):
    rng, staged = random.Random(6), {}
    keep = substring_dedup.stage
    monkeypatch.setattr(substring_dedup, "stage", lambda df, name: staged.setdefault(name, []).append(keep(df, name)) or staged[name][-1])
    monkeypatch.setattr(substring_dedup, "_SHARD", 50)
    line = [f"line{i}" for i in range(40)]
    parts = [[f"w{rng.randint(0, 10**6)}" for _ in range(30)] for _ in range(120)]
    rows = [(i, " ".join(w for p in rng.sample(parts, 100) for w in p + line)) for i in range(3)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == slow_repeats(rows) and got[2][1] > 1000
    sizes = staged["distinct-passages"][-1].groupBy("key").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50


def test_substrings_of_rows_that_share_an_id(spark):
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]

    shared, other = words(60), words(70)
    texts = [(1, shared), (1, other), (5, words(200) + shared), (5, words(80)), (5, words(3)), (5, words(90) + other)]
    got = substring_dedup.remove_repeats(frame(spark, [(d, " ".join(w)) for d, w in texts])).collect()
    expected = [(d, len(w), 0, " ".join(w)) for d, w in texts]
    for i, n in ((2, 60), (5, 70)):
        d, w = texts[i]
        expected[i] = (d, len(w), n, " ".join(w[:-n]))
    assert sorted(map(tuple, got)) == sorted(expected)


def test_substring_dedup_of_the_table(real):
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(real).collect()} == slow_repeats(rows)


# -- 7 -----------------------------------------------------------------------------------------------


def test_quality_measures(docs, odd):
    got = {r["doc_id"]: r for r in quality.score_quality(docs).collect()}
    assert quality.score_quality(docs).count() == len(odd)
    for doc, text in odd:
        text = text or ""
        words = WORDS.findall(text)
        triples = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
        count = {}
        for x in triples:
            count[x] = count.get(x, 0) + 1
        inside = {i + j for i, x in enumerate(triples) if count[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        r = got[doc]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(inside)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    kept = sorted(r["doc_id"] for r in quality.keep_good(docs).select("doc_id").collect())
    assert kept == sorted(d for d, _ in odd if got[d]["kept"])


def test_repeated_ngrams_are_measured():
    rng = random.Random(1)
    clean = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    assert quality.measure(" ".join(clean), quality.Limits())[5] == [0.0] * 6
    half = " ".join(clean[:100] * 2)
    shares = quality.measure(half, quality.Limits())[5]
    assert all(s == 0.5 for s in shares)  # only the repeat counts
    line = "\n".join([" ".join(clean)] * 3)
    assert quality.measure(line, quality.Limits())[6:] == pytest.approx((2 / 3, 2 / 3))


def test_limits_reject_what_the_base_rules_keep(spark):
    rng = random.Random(2)

    def words(n):
        return [f"w{rng.randint(1000, 9999)}x{rng.randint(1000, 9999)}" for _ in range(n)]

    rows, line = [], " ".join(words(10))
    for copies in range(2, 10):  # of 10 words each, in texts of 200 words
        lines = [" ".join(words(10)) for _ in range(20 - copies)]
        for _ in range(copies):
            lines.insert(rng.randrange(len(lines) + 1), line)
        rows.append((copies, "\n".join(lines)))
    got = {r["doc_id"]: r for r in quality.score_quality(frame(spark, rows)).collect()}
    assert not any(r["base_failed"] for r in got.values())
    # Only repeats count, so 7 copies are 30 percent and 8 are 35.
    assert [d for d in sorted(got) if not got[d]["kept"]] == [8, 9]
    assert sorted(r["doc_id"] for r in quality.keep_good(frame(spark, rows)).collect()) == list(range(2, 8))


# -- 8 -----------------------------------------------------------------------------------------------


def test_bpe_is_what_the_library_gives(docs, odd, real):
    library = Tokenizer.from_file(WORD_BPE)
    rows = [(d, t or "") for d, t in odd] + [tuple(r) for r in real.select("doc_id", "text").collect()]
    both = bpe.encode_documents(docs, WORD_BPE).collect() + bpe.encode_documents(real, WORD_BPE).collect()
    got = {}
    for r in both:
        got.setdefault(r["doc_id"], set()).add((bytes(r["ids"]), r["decoded"]))
    for doc, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert (struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)) in got[doc]


def test_pair_index_takes_a_lower_rank_first():
    """A pair that a merge brings about and that ranks before it is merged before the merge goes on."""
    merges = {(1, 2): (5, 9), (9, 1): (2, 8), (8, 2): (1, 7)}
    assert bpe.PairIndex(merges).merge([[1, 2, 1, 2], [], [1], [2, 1, 2]]) == [[7], [], [1], [2, 9]]


# -- 9 -----------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        words = [f"word{rng.choice('abcdefgh')}{rng.choice('ijklmnop')}" for _ in range(40)]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(words).title()))
        if rng.random() < 0.5:  # labels are spread like the rows, as the class prior comes from them
            labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "idiot")]
    docs = frame(spark, rows)
    marks = spark.createDataFrame([*labels, labels[0], (9999, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    for doc, r in got.items():
        held = doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    wrong = [i for i in range(1500) if got[i]["held_out"] and got[i]["predicted"] != (i % 8 == 0)]
    assert len(wrong) <= 3 and got[5000]["score"] == got[5001]["score"] < 0.3
    # The held-out labels are not looked at: turning them round changes nothing.
    turned = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, turned)
    assert np.array_equal(again.weights, model.weights)
    assert toxicity.train(docs, marks.limit(0)).score("idiot") == 0.0


def slow_fit(pos, unl, prior, settings):
    """The risk by its definition, text by text, and its slope by differences. Also how often the step went back up."""
    def share(rows, word):
        return sum(word in r for r in rows) / len(rows)

    deviation = {}
    for word in sorted(set().union(*pos, *unl)):
        a, b, both = share(pos, word), share(unl, word), share(pos + unl, word)
        if both * len(pos + unl) > 4.5:
            deviation[word] = abs(a - b) / math.sqrt(both * (1 - both) * (1 / len(pos) + 1 / len(unl)) + 1e-12)
    words = [w for w in sorted(deviation, key=lambda w: -deviation[w])[: settings.words] if deviation[w] > 4]
    words.sort()
    weights, back = [], 0
    for seed in range(settings.classifiers):
        draw = np.random.default_rng(seed)
        own_pos = [pos[i] for i in draw.integers(0, len(pos), len(pos))]
        own_unl = [unl[i] for i in draw.integers(0, len(unl), len(unl))]

        def loss(rows, w, sign):
            margins = [w[-1] + sum(v for v, word in zip(w, words) if word in r) for r in rows]
            return sum(math.log1p(math.exp(-sign * m)) for m in margins) / len(rows)

        def toxic(w):
            return prior * loss(own_pos, w, 1)

        def clean(w):
            return loss(own_unl, w, -1) - prior * loss(own_pos, w, -1)

        def slope(risk, w, i):
            up, down = list(w), list(w)
            up[i] += 1e-5
            down[i] -= 1e-5
            return (risk(up) - risk(down)) / 2e-5

        w = [0.0] * (len(words) + 1)
        mean, square = list(w), list(w)
        for step in range(1, settings.steps + 1):
            below = clean(w) < 0
            back += below
            slopes = [-slope(clean, w, i) if below else slope(toxic, w, i) + slope(clean, w, i) for i in range(len(w))]
            for i, g in enumerate(slopes):
                g += settings.decay * w[i] * (i < len(words))
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                w[i] -= settings.rate * mean[i] / (1 - 0.9**step) / (math.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
        weights.append(w)
    return words, weights, back


def test_risk_and_steps_are_those_of_the_definition():
    rng = random.Random(9)

    def row(toxic):
        found = {w for w in range(1, 9) if rng.random() < 0.4}
        return found | {w for w in (100, 101, 102) if rng.random() < (0.7 if toxic else 0.03)}

    pos = [row(True) for _ in range(40)]
    unl = [row(rng.random() < 0.1) for _ in range(80)]
    settings = toxicity.Settings(words=5, classifiers=2, steps=30, rate=0.2)
    arrays = [[np.array(sorted(r), dtype=np.uint32) for r in rows] for rows in (pos, unl)]
    for prior in (0.1, 0.5):
        words, weights, back = slow_fit(pos, unl, prior, settings)
        model = toxicity.fit(*arrays, prior, settings)
        assert list(model.words) == words and set(words) >= {100, 101, 102}
        assert np.allclose(np.column_stack([model.weights, model.bias]), weights, atol=1e-4)
        assert 0 < back < settings.classifiers * settings.steps  # both kinds of steps were taken


# -- 10 ----------------------------------------------------------------------------------------------


def plain_spans(text):
    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    out = []
    for rank, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark, docs, odd):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab@.-+ 0123456789()%_A\n€🙂") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("0123456789 -.+") for _ in range(rng.randint(10, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab@._") for _ in range(rng.randint(3, 30))) for _ in range(500)]
    texts += ["1" * 20_000, "0 1 " * 5000, "a" * 20_000 + "@", "a@b." * 3000, "+1" * 5000, None, "x￾1 2",
              "4111 1111 1111 1111", "IBAN DE89 3704 0044 0532 0130 00 ok", "ssn: 123-45-6789", "no 123-45-6789"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, rows).repartition(8)).collect()}
    for doc, text in rows:
        base = plain_spans(text or "")
        r = got[doc]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s.startswith(k) for s in base) for k in pii.BASE_KINDS]
    last = len(texts)
    assert got[last - 4]["spans"] == "card:0:19" and got[last - 3]["spans"] == "iban:5:32"
    assert got[last - 2]["spans"] == "ssn:5:16" and got[last - 1]["spans"] == ""
    assert pii.find_personal_data(docs).count() == len(odd)


IBANS = [
    "NO9386011117947", "BE68539007547034", "NL91ABNA0417164300", "AT611904300234573201", "CH9300762011623852957",
    "DE89370400440532013000", "GB82WEST12345698765432", "ES9121000418450200051332", "PT50000201231234567890154",
    "FR1420041010050500013M02606", "HU42117730161111101800000000", "PL61109010140000071219812874",
    "UA213223130000026007233566001", "MT84MALT011000012345MTLCAST001S",
]


def test_account_numbers_before_upper_case_words(spark):
    def grouped(number):
        return " ".join(number[i: i + 4] for i in range(0, len(number), 4))

    def checked(body):  # an account number of a country that has no length in the list
        digits = "".join(str(int(c, 36)) for c in body + "ZZ00")
        return f"ZZ{98 - int(digits) % 97:02d}{body}"

    others = [checked(("1234567890" * 3)[:n]) for n in (8, 12, 13, 16, 20, 24)]
    rows, expected = [], {}
    for number in IBANS + others:
        for shape in (number, grouped(number)):
            for after in ("", " ", ", ok", " and", " BIC", " BIC CAIXESBB", " EUR 500", " SWIFT", " SWIFT X", " 1234 5678"):
                for before in ("", "IBAN ", "🙂 account ", "AB12 3456 ", "AT61 1904 "):
                    if number in others and (before[:2] in ("AB", "AT") or after == " 1234 5678"):
                        continue  # of a country without a length only the check digits say where the number ends
                    expected[len(rows)] = f"iban:{len(before)}:{len(before) + len(shape)}"
                    rows.append((len(rows), before + shape + after))
    two = "BE68 5390 0754 7034 ES91 2100 0418 4502 0005 1332 AT611904300234573201"
    for text, spans in [
        (two, "iban:0:19,iban:20:49,iban:50:70"), ("BE68 5390 0754 7035 EUR", ""), ("BE68 5390 0754 7034EUR", ""),
    ]:
        expected[len(rows)] = spans
        rows.append((len(rows), text))
    got = pii.find_personal_data(frame(spark, rows)).collect()
    wrong = []
    for r in got:
        ibans = ",".join(s for s in r["spans"].split(",") if s.startswith("iban"))
        if ibans != expected[r["doc_id"]]:
            wrong.append((rows[r["doc_id"]][1], ibans, expected[r["doc_id"]]))
    assert len(got) == len(rows) and not wrong


def test_masking(spark):
    rows = [(1, "mail é@x a@b.co or +1 (323) 555-9830, a@b.co"), (2, None), (3, "clean"), (4, "")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask_personal_data(frame(spark, rows)).collect()}
    masked = "mail é@x <EMAIL> or <PHONE>, <EMAIL>"
    assert got == {1: (masked, len(masked)), 2: (None, None), 3: ("clean", 5), 4: ("", 0)}


def test_many_spans_in_one_text(spark):
    """Work grows with the spans, not with their square: places, scores and masks of 100,000 in one text."""
    rng = random.Random(4)
    kinds = ["a.b{0}@mail.org", "10.{0}.2.3", "4111 1111 1111 1111", "+1 (323) 555-98{0:02d}", "ssn 123-45-67{0:02d}", IBANS[5]]
    gaps = [" ", ", ", " é🙂 ", " call ", " x" * 300 + " "]

    def text(n, weights):
        parts = (kinds[rng.choices(range(6), weights)[0]].format(rng.randint(10, 99)) + rng.choice(gaps[:4]) for _ in range(n))
        return "".join(p + gaps[4] * (i % 50 == 0) for i, p in enumerate(parts))

    mixed, plain = text(3000, [1] * 6), text(100_000, [6, 1, 0, 1, 0, 0])
    docs = frame(spark, [(1, mixed), (2, plain), (3, mixed + "end"), (4, "x" * 256), (5, "a@b.c" + "x" * 507)])
    begun = time.monotonic()
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert time.monotonic() - begun < 60
    for doc, t in docs.select("doc_id", "text").collect():
        spans = [s for s in got[doc]["spans"].split(",") if s]
        assert [s for s in spans if s[:4] not in ("iban", "ssn:")] == plain_spans(t)
        out, at = [], 0
        for span, score in zip(spans, got[doc]["scores"].split(",")):
            kind, start, end = span.split(":")
            start, end = int(start), int(end)
            near = re.search(rf"(?i)(?<![^\W\d_])(?:{pii._WORDS[kind]})", t[max(0, start - 40): start] + " " + t[end: end + 40])
            assert float(score) == round(min(1.0, pii._SCORES[kind] + (0.3 if near else 0)), 1)
            if start >= at:
                out.append(t[at:start] + f"<{kind.upper()}>")
            at = max(at, end)
        assert masked[doc] == "".join(out) + t[at:]
    assert got[1]["spans"].count("iban:") == mixed.count(IBANS[5]) and got[1]["spans"].count("ssn:") == mixed.count("ssn ")


# -- the pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4] > 0
    packed = corpus_pipeline.run(spark, sf_dir)
    totals = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert totals.count() == counts[-1] and totals.where("n != all").count() == 0


def slow_verdict(text):
    """The quality rules, n-grams compared as such."""
    limits, words = quality.Limits(), WORDS.findall(text or "")
    triples = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, x in enumerate(triples) if triples.count(x) > 1 for j in range(3)}
    if len(words) < 50 or 100 * len(inside) > 50 * len(words):
        return False
    chars = sum(map(len, words))
    for n, most in limits.ngrams:
        seen, again = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i: i + n])
            if gram in seen:
                again |= set(range(i, i + n))
            seen.add(gram)
        if sum(len(words[i]) for i in again) > most * chars:
            return False
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    repeated = [x for i, x in enumerate(lines) if x in lines[:i]]
    letters = sum(len(w) for x in repeated for w in WORDS.findall(x))
    return letters <= limits.line_chars * chars and len(repeated) <= limits.lines * len(lines)


def slow_mask(text):
    out, at = [], 0
    for span in plain_spans(text):
        kind, start, end = span.split(":")
        if int(start) >= at:
            out.append(text[at: int(start)] + f"<{kind.upper()}>")
        at = max(at, int(end))
    return "".join(out) + text[at:]


def test_pipeline_same_as_brute_force(spark):
    """Every stage takes effect: rejected documents, repeated lines, near copies and personal data."""
    import corpus_pipeline
    from martspark.session import stage_path

    rng = random.Random(12)

    def words(n):
        return [f"w{rng.randint(0, 5000)}" for _ in range(n)]

    private = ["a.b@mail.org", "+1 (323) 555-9830", "10.1.2.3", "4111 1111 1111 1111"]
    shared, rows = [" ".join(words(12)) for _ in range(5)], [(-3, None), (-2, ""), (-1, "short")]
    for i in range(50):
        lines = [" ".join(words(rng.randint(2, 20))) for _ in range(rng.randint(3, 9))]
        if i % 3 == 0:
            lines.insert(1, rng.choice(shared))
        if i % 4 == 0:
            own = rng.choice(shared).split()
            own[rng.randrange(12)] = "changed"
            lines.append(" ".join(own))
        if i % 7 == 0:
            lines += lines[:3] * 4  # too many repeats
        if i % 5 == 0:
            lines[0] += " " + rng.choice(private)
        rows.append((i, "\n".join(lines)))
    for i in range(8):
        long = words(1200)
        rows.append((100 + i, " ".join(long)))
        long[5] = long[700] = "other"
        rows.append((200 + i, " ".join(long)))

    kept = [r for r in rows if slow_verdict(r[1])]
    assert 20 < len(kept) < len(rows) - 5
    repeated = slow_lines(kept)
    assert len(repeated) > 10
    cut = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in repeated.get(d, ()))) for d, t in kept]
    groups = groups_of([slow_simhash(t) for _, t in cut], lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for (doc, _), g in zip(cut, groups):
        first[g] = min(first.get(g, doc), doc)
    one = [r for r in cut if r[0] in first.values()]
    assert len(one) < len(cut)
    masked = [(d, slow_mask(t)) for d, t in one]
    assert sum(a != b for a, b in zip(masked, one)) > 2
    library = Tokenizer.from_file(BYTE_BPE)
    expected = {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in masked}

    folder = stage_path(spark, "corpus")
    frame(spark, rows, clash=False).repartition(5).write.parquet(f"{folder}/documents.parquet")
    got = {}
    for p in sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda p: p["start"]):
        got.setdefault(p["doc_id"], []).extend(struct.unpack(f"<{p['length']}I", bytes(p["ids"])))
    assert got == expected
