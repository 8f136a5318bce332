"""Column expressions on message, reply and contact texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.functions.scalars import ColumnOrName, as_column


def holds_any(text: ColumnOrName, keywords: Sequence[str]) -> Column:
    """Does the text hold any of the keywords, as it is written?"""
    return reduce(lambda a, b: a | b, [as_column(text).contains(k) for k in keywords])


def held_keywords(text: ColumnOrName, keywords: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(as_column(text).contains(k), F.lit(k)) for k in keywords]))


def contains_any(text: ColumnOrName, keywords: Sequence[str]) -> Column:
    """Does the lower-cased text hold any of the (lower-case) keywords?"""
    return holds_any(F.lower(as_column(text)), keywords)


def matched_keywords(text: ColumnOrName, keywords: Sequence[str]) -> Column:
    """The keywords found in the lower-cased text, in the order given."""
    return held_keywords(F.lower(as_column(text)), keywords)


def ellipsis(text: ColumnOrName, n: int, mark: str = "...") -> Column:
    """The first n characters, followed by `mark` if something was cut off."""
    t = as_column(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(mark))).otherwise(t)


def non_blank_text(text: ColumnOrName) -> Column:
    return as_column(text).rlike(r"\S")


def extract_json(text: ColumnOrName) -> Column:
    """From the first "{" to the last "}" over all lines; NULL without such a pair."""
    return F.nullif(F.regexp_extract(as_column(text), r"(?s)\{.*\}", 0), F.lit(""))


def parse_json(text: ColumnOrName, schema: T.DataType | str) -> Column:
    return F.from_json(as_column(text), schema)


def strip_fences(text: ColumnOrName) -> Column:
    """Removes code fence lines, marked as sql or not."""
    return F.regexp_replace(F.regexp_replace(as_column(text), "```sql\\n?", ""), "```\\n?", "")


# Fixed list: the words a statement may start with.
STATEMENT_WORDS = ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE")


def first_sql(text: ColumnOrName) -> Column:
    """The first statement in a reply, "" if there is none.

    A statement begins on a line that starts with one of the words above and ends with the line
    that ends in ";" (which is dropped), with the next blank line, or with the text.
    """
    # Blanks around line ends go first, so that a blank line is two newlines in a row.
    lines = F.regexp_replace(strip_fences(text), r"[^\S\n]*\n[^\S\n]*", "\n")
    words = "|".join(STATEMENT_WORDS)
    pattern = rf"(?is)(?:\A|\n)((?:{words}).*?)(?:;(?=\n|\z)|\n\n|\n?\z)"
    return F.regexp_extract(F.regexp_replace(lines, r"\A\s+|\s+\z", ""), pattern, 1)


def split_list(text: ColumnOrName, separator: str = ",") -> Column:
    """Parts of a packed text; NULL counts as the empty text, which has one empty part."""
    return F.split(F.coalesce(as_column(text), F.lit("")), f"\\Q{separator}\\E", -1)


def safe_int(text: ColumnOrName) -> Column:
    """Integer of a digits-only text, NULL for anything else."""
    t = as_column(text)
    return F.when(t.rlike(r"\A[0-9]+\z"), t.try_cast("int"))


def zip_records(lists: Mapping[str, Column], first: str, defaults: Mapping[str, Column]) -> Column:
    """Parallel lists to an array of records, one per non-empty entry of the list `first`.

    A slot beyond the end of its list takes its default.
    """
    zipped = F.arrays_zip(*[column.alias(name) for name, column in lists.items()])
    kept = F.filter(F.slice(zipped, F.lit(1), F.size(lists[first])), lambda r: F.length(r[first]) > 0)
    return F.transform(
        kept,
        lambda r: F.struct(*[
            F.coalesce(r[name], defaults[name] if name in defaults else F.lit(None)).alias(name)
            for name in lists
        ]),
    )


def number_item(position: ColumnOrName, item: ColumnOrName, prefix: str) -> Column:
    """"<prefix> 1: a" for the item a at position 0."""
    number = (as_column(position) + 1).cast("string")
    return F.concat(F.lit(f"{prefix} "), number, F.lit(": "), as_column(item))


def number_items(items: ColumnOrName, prefix: str) -> Column:
    """["a", "b"] becomes ["<prefix> 1: a", "<prefix> 2: b"]."""
    return F.transform(as_column(items), lambda x, i: number_item(i, x, prefix))


def join_lines(items: ColumnOrName) -> Column:
    return F.concat_ws("\n", as_column(items))


# Fixed patterns of the contact rules: the address form of the HTML standard and the phone form.
EMAIL_PATTERN = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
)
PHONE_PATTERN = (
    r"^((\+[1-9]{1,4}[ -]?)|(\([0-9]{2,3}\)[ -]?)|([0-9]{2,4})[ -]?)*?[0-9]{3,4}[ -]?[0-9]{3,4}$"
)


def email_shape(email: ColumnOrName) -> Column:
    """The looser rule of the users table."""
    return as_column(email).like("%@%.%")


def valid_email(email: ColumnOrName) -> Column:
    return as_column(email).rlike(EMAIL_PATTERN)


def valid_phone(phone: ColumnOrName) -> Column:
    # The first test only keeps the second from backtracking over long texts.
    p = as_column(phone)
    return p.rlike(r"^[0-9+() -]+$") & p.rlike(PHONE_PATTERN)


def required(text: ColumnOrName) -> Column:
    return as_column(text).isNotNull() & (as_column(text) != "")


MAX_UPLOAD_BYTES = 10 * 1024 * 1024


def file_ext(name: ColumnOrName, default: str = "jpg") -> Column:
    n = as_column(name)
    return F.when(n.contains("."), F.substring_index(n, ".", -1)).otherwise(F.lit(default))


def is_image(content_type: ColumnOrName) -> Column:
    return F.coalesce(as_column(content_type).startswith("image/"), F.lit(False))


def size_ok(size: ColumnOrName, limit: int = MAX_UPLOAD_BYTES) -> Column:
    return as_column(size) <= limit


def code_number(code: ColumnOrName) -> Column:
    """Number of a code text ("0742" is 742), NULL if it is none; decimals are cut off."""
    whole = F.regexp_replace(as_column(code), r"^(\s*[+-]?[0-9]+)\.[0-9]*(\s*)$", "$1")
    return whole.try_cast("bigint")
