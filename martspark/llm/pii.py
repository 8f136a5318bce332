"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import text_or_empty

# Kinds in the order in which spans that begin at the same place are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# Patterns are written so that no place of a run of letters or digits is tried twice: a match can
# only begin where a run begins, or where the previous match ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# In a card number single blanks and hyphens between digits are first replaced by this letter.
_JOINT = "\uFFFE"
_CARD = f"[0-9][0-9{_JOINT}]++"
# Letters and digits of an account number by country (ISO 13616), the country and check digits included.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]{4}){2})"  # only the head; `_accounts` finds the end
_IBAN_REACH = 44  # the longest account number with its blanks, and the letter after it


def _iban_ends() -> list[str]:
    """Patterns of whole account numbers: by the country's length, for other countries by every length, longest first."""
    own = []
    for n, countries in _IBAN_LENGTHS.items():
        groups, more = divmod(n - 4, 4)
        tail = f" ?[A-Z0-9]{{{more}}}" if more else ""
        own.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    known = " ".join(_IBAN_LENGTHS.values()).replace(" ", "|")
    other = [
        f"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}"
        for groups in range(7, 1, -1) for tail in (" ?[A-Z0-9]{1,3}", "")
    ]
    return [f"^(?:{p})(?![A-Za-z0-9])" for p in ("|".join(own), *other)]


_SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"

# Score of a confirmed span, the words that raise it, and by how much.
_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
_WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|telefono|contact",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|social",
}
_RAISE = 0.3
_REACH = 40
LEAST_SCORE = 0.5


# Places of a text are looked up in pieces of this many code points, lists grow in blocks of so many entries:
# the work for a text grows with its length and its spans, not with their product.
_PIECE = 256
_BLOCK = 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, also where `use` reads it for every entry of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(
    items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], entry: str
) -> Column:
    """struct<carry, out>: `step` turns the carry and an item into the next carry and an array of results.

    Appending to an array copies it, so results are collected by block and the blocks joined once.
    """
    empty = F.array().cast(f"array<{entry}>")
    blocks = F.array().cast(f"array<array<{entry}>>")

    def add(state: Column, item: Column) -> Column:
        after, more = step(state["carry"], item)
        return F.struct(after.alias("carry"), F.concat(state["out"], more).alias("out"))

    def whole(xs: Column) -> Column:
        n = F.size(xs)

        def block(state: Column, at: Column) -> Column:
            mine = F.transform(F.sequence(at, F.least(at + _BLOCK, n) - 1), lambda i: F.get(xs, i))
            done = F.aggregate(mine, F.struct(state["carry"].alias("carry"), empty.alias("out")), add)
            return _let(done, lambda d: F.struct(
                d["carry"].alias("carry"), F.concat(state["out"], F.array(d["out"])).alias("out")
            ))

        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(
            starts,
            F.struct(carry.alias("carry"), blocks.alias("out")),
            block,
            lambda s: F.struct(s["carry"].alias("carry"), F.flatten(s["out"]).alias("out")),
        )

    return _let(items, whole)


def _pieces(text: Column, wanted: Column) -> Column:
    """The text in pieces of `_PIECE` code points; none if they are not wanted."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}+"), F.lit(0))
    return F.when(wanted, cut).otherwise(F.array().cast("array<string>"))


def _between(pieces: Column, begin: Column, end: Column) -> Column:
    """The code points from `begin` to `end` (exclusive; the text may end before)."""

    def part(i: Column) -> Column:
        skipped = F.greatest(begin - i * _PIECE, F.lit(0))
        return F.substring(
            F.get(pieces, i.cast("int")), (skipped + 1).cast("int"), (end - i * _PIECE - skipped).cast("int")
        )

    first, last = F.floor(begin / _PIECE), F.floor(end / _PIECE)
    return F.array_join(F.transform(F.sequence(first, last), part), "")


def _matches(text: Column, pattern: str, maybe: Column) -> Column:
    """array<struct<start, found>> of the leftmost non-overlapping matches, in code points from 0.

    Cutting the text at the matches gives what stands between them, so the starts are running sums.
    `maybe` is a cheap test that holds for every text with a match.
    """
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda b, m: F.struct(b.alias("before"), m.alias("found")),
    )

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.length(pair["before"])
        return start + F.length(pair["found"]), F.array(F.struct(start.alias("start"), pair["found"].alias("found")))

    entry = "struct<start:bigint,found:string>"
    # The piece after the last match has no match of its own.
    matched = F.filter(pairs, lambda p: p["found"].isNotNull())
    placed = _running(matched, F.lit(0).cast("bigint"), step, entry)["out"]
    return F.when(maybe, placed).otherwise(F.array().cast(f"array<{entry}>"))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits ends in 0."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) + F.lit(1) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """The first four letters moved to the end and letters read as 10 to 35, the number leaves 1."""
    plain = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def add(rest: Column, letter: Column) -> Column:
        value = F.when(letter < "A", F.ascii(letter) - 48).otherwise(F.ascii(letter) - 55)
        return F.when(letter < "A", rest * 10 + value).otherwise(rest * 100 + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), add) == 1


def _accounts(pieces: Column, heads: Column) -> Column:
    """The account numbers that begin at some heads, as `_matches` gives them. They do not overlap.

    Every head is tried by itself, so what fails the check hides nothing that begins inside it. Of two that
    overlap the first stays, but one of a listed country before one of another.
    """
    entry = "struct<start:bigint,found:string,listed:boolean>"

    def whole(head: Column) -> Column:
        ahead = _between(pieces, head["start"], head["start"] + _IBAN_REACH)
        tried = _let(ahead, lambda a: F.array(*[F.regexp_extract(a, p, 0) for p in _iban_ends()]))
        return _let(tried, lambda t: F.struct(
            head["start"].alias("start"),
            F.get(F.filter(t, lambda w: F.when(w == "", False).otherwise(mod97(w))), F.lit(0)).alias("found"),
            (t[0] != "").alias("listed"),
        ))

    def step(last: Column, m: Column) -> tuple[Column, Column]:
        # The last one waits until the next is known to begin behind it.
        apart = last.isNull() | (m["start"] >= last["start"] + F.length(last["found"]))
        kept = F.when(apart | (m["listed"] & ~last["listed"]), m).otherwise(last)
        return kept, F.when(apart & last.isNotNull(), F.array(last)).otherwise(F.array().cast(f"array<{entry}>"))

    found = F.filter(F.transform(heads, whole), lambda m: m["found"].isNotNull())
    ran = _running(found, F.lit(None).cast(entry), step, entry)
    return _let(ran, lambda r: F.filter(F.concat(r["out"], F.array(r["carry"])), lambda m: m.isNotNull()))


def _is_ip(found: Column) -> Column:
    return F.forall(
        F.split(found, r"\."), lambda part: part.rlike("^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")
    )


def _is_card(found: Column) -> Column:
    digits = _digits(found)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _is_phone(found: Column) -> Column:
    return F.length(_digits(found)).between(10, 15)


def _scored(pieces: Column, rank: int, kind: str) -> Callable[[Column], Column]:
    def span(m: Column) -> Column:
        end = m["start"] + F.length(m["found"])
        around = F.concat(
            _between(pieces, F.greatest(m["start"] - _REACH, F.lit(0)), m["start"]),
            F.lit(" "),
            _between(pieces, end, end + _REACH),
        )
        near = around.rlike(rf"(?i)(?<![\p{{L}}])(?:{_WORDS[kind]})")
        return F.struct(
            m["start"].alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            F.least(F.lit(1.0), F.lit(_SCORES[kind]) + F.when(near, _RAISE).otherwise(0.0)).alias("score"),
        )

    return span


def _of_kind(rank: int) -> Callable[[Column], Column]:
    return lambda span: span["rank"] == rank


def find_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, score>> of all spans in a text that is not NULL.

    Base kinds stay whatever their score; the others need `LEAST_SCORE`. Ends are exclusive.
    """
    # Replacing one code point by one keeps all places.
    joined = F.regexp_replace(F.translate(text, _JOINT, "x"), "(?<=[0-9])[ -](?=[0-9])", _JOINT)
    kinds: dict[str, tuple[Column, str, Column, Callable[[Column], Column]]] = {
        "email": (text, _EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        "ip": (text, _IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _is_ip),
        "card": (joined, _CARD, text.rlike("[0-9](?:[ -]?[0-9]){13}"), _is_card),
        "phone": (text, _PHONE, F.contains(text, F.lit("+")), _is_phone),
        "iban": (text, _IBAN, text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), lambda m: F.lit(True)),
        "ssn": (text, _SSN, text.rlike("[0-9]-[0-9]{2}-[0-9]"), lambda m: F.lit(True)),
    }

    def spans(pieces: Column) -> Column:
        found = []
        for rank, kind in enumerate(KINDS):
            where, pattern, maybe, confirmed = kinds[kind]
            matches = F.filter(_matches(where, pattern, maybe), _on_found(confirmed))
            if kind == "iban":
                matches = _accounts(pieces, matches)
            scored = F.transform(matches, _scored(pieces, rank, kind))
            found.append(scored if kind in BASE_KINDS else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE))
        return F.array_sort(F.concat(*found))

    return _let(_pieces(text, reduce(or_, (maybe for _, _, maybe, _ in kinds.values()))), spans)


def _on_found(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: check(m["found"])


def _listed(spans: Column) -> Column:
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: counts of the base kinds, all spans, and the scores of the spans.

    A NULL text is an empty one and has no spans. Spans of different kinds may overlap; of one kind
    they do not. Rows are independent: nothing is shuffled, repeated rows give repeated results, and
    other columns are not read.
    """
    spans = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", find_spans(F.col("text")).alias("s"))
    base = F.filter("s", lambda s: s["rank"] < len(BASE_KINDS))
    counts = [
        F.size(F.filter("s", _of_kind(i))).cast("long").alias(f"n_{kind}")
        for i, kind in enumerate(BASE_KINDS)
    ]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
        F.concat_ws(",", F.transform("s", lambda s: F.format_number(s["score"], 1))).alias("scores"),
    )


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets, and `n_chars` of the new text.

    Overlapping spans are replaced as one, named after the one that begins first. A text without
    spans, also NULL, stays as it is. Columns and their order stay.
    """
    text = F.coalesce(F.col("r.text"), F.lit(""))

    def masked(pieces: Column) -> Column:
        def step(at: Column, span: Column) -> tuple[Column, Column]:
            piece = F.concat(_between(pieces, at, span["start"]), F.lit("<"), F.upper(span["kind"]), F.lit(">"))
            inside = span["start"] < at
            new = F.when(inside, F.array().cast("array<string>")).otherwise(F.array(piece))
            return F.greatest(at, span["end"]), new

        ran = _running(F.col("s"), F.lit(0).cast("bigint"), step, "string")
        return _let(ran, lambda r: F.concat(
            F.array_join(r["out"], ""), _between(pieces, r["carry"], F.length(text).cast("bigint"))
        ))

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    found = row.withColumn("s", find_spans(text))
    hit = F.size("s") > 0
    new = found.withColumn("t", F.when(hit, _let(_pieces(text, hit), masked)).otherwise(F.col("r.text"))).select("r", "t")
    return replaced(new, docs)


def replaced(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` from the struct `r`, with the text `t` and its length."""
    out = []
    for field in docs.schema:
        c = field.name
        if c.lower() == "text":
            out.append(F.col("t").alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(F.col("t").isNull(), F.col("r")[c]).otherwise(F.length("t")).cast(field.dataType).alias(c))
        else:
            out.append(F.col("r")[c].alias(c))
    return rows.select(*out)

