"""Names in chat exports: who sent the messages, and where else their names appear.

Senders are found natively; the names to look for then differ from row to row, so looking
for them is an Arrow function.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.rules import MENTION
from ..functions.spans import SPANS, clear_of, ordered
from .redact import free, masked, with_spans

# A name, a time, a date; export formats; line starts that are not people.
NAME = r"\p{L}[\p{L}\p{M}'’.-]*(?: \p{L}[\p{L}\p{M}'’.-]*){0,3}"
TIME = r"[0-9]{1,2}[:.][0-9]{2}(?:[:.][0-9]{2})?(?:\s?[AaPp]\.?[Mm]\.?)?"
DATE = "[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4}"
FORMATS = [
    rf"^\x{{200E}}?\[{DATE},? {TIME}\] ({NAME}):",
    rf"^{DATE},? {TIME} [-–] ({NAME}):",
    rf"^\[{TIME}\] ({NAME})\s*$",
    rf"^({NAME}) {{1,3}}\[?{TIME}\]?\s*$",
    rf"^({NAME}) [—-] (?:Today|Yesterday|{DATE}) at {TIME}\s*$",
]
PLAIN = rf"^({NAME}): \S"
NOT_NAMES = "note notes re fw fwd subject date time to from cc bcc update edit edited ps p.s q a question answer summary agenda action actions todo warning error info tip example result status reminder sent received meeting location address phone email url link file attachment".split()
#: Scripts without spaces between words.
UNSPACED = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"


def senders(text: Column) -> Column:
    """The names that sent messages, in order of format and line; by plain ``Name: message``
    lines only where no format fits and two people at least write so."""

    def names(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit("(?m)" + pattern), F.lit(1)), F.trim)
        return F.filter(found, lambda n: ~F.lower(n).isin(NOT_NAMES))

    formal = F.array_distinct(F.concat(*[names(p) for p in FORMATS]))
    plain = F.array_distinct(F.filter(names(PLAIN), lambda n: ~F.rlike(n, F.lit(r"^\p{Ll}"))))
    return F.when(F.size(formal) > 0, formal).when(F.size(plain) >= 2, plain).otherwise(F.array().cast("array<string>"))


def names_of(sent_by: Column) -> Column:
    """Full names and first names worth looking for, longest first."""
    first = F.transform(sent_by, lambda n: F.substring_index(n, " ", 1))
    worth = F.filter(F.arrays_zip(sent_by.alias("n"), first.alias("f")), lambda x: (x["f"] != x["n"]) & (F.length(x["f"]) >= F.when(F.rlike(x["f"], F.lit(UNSPACED)), 2).otherwise(3)))
    both = F.array_distinct(F.concat(sent_by, F.transform(worth, lambda x: x["f"])))
    return F.transform(F.array_sort(F.transform(both, lambda n: F.struct((-F.length(n)).alias("k"), F.array_position(both, n).alias("i"), n.alias("n")))), lambda s: s["n"])


def _find(texts: pa.Array, names: pa.Array) -> pa.Array:
    """The names of each row anywhere in its text; longer names come first and keep their place."""
    out = []
    for text, some in zip(texts.to_pylist(), names.to_pylist(), strict=True):
        parts = [regex.escape(n) if regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]", n) else rf"(?<![\p{{L}}\p{{N}}]){regex.escape(n)}(?![\p{{L}}\p{{N}}])" for n in some or []]
        spans: list[tuple[int, int]] = []
        for part in parts:
            found = [m.span() for m in regex.finditer(part, text or "")]
            spans = joined(spans, found)
        out.append([{"tag": "NAME", "start": a, "end": b} for a, b in spans])
    return pa.array(out, pa.list_(pa.struct([("tag", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))


def joined(taken: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those of ``more`` that overlap none of them: one sorted sweep."""
    out, till, k = [], 0, 0
    for a, b in more:
        while k < len(taken) and taken[k][0] < b:
            till = taken[k][1]
            k += 1
        if a >= till:
            out.append((a, b))
    return sorted(taken + out)


_find.__annotations__ = {"texts": pa.Array, "names": pa.Array, "return": pa.Array}


def find_names(text: Column, names: Column) -> Column:
    """Where the names stand in the text, the first names first."""
    return arrow_udf(_find, SPANS).asNondeterministic()(text, names)


def with_chat_names(df: DataFrame, text: str = "text", out: str = "chat") -> DataFrame:
    """Adds ``out``: the spans of senders' names anywhere in the text, and of @mentions (the
    sign stays), sorted."""
    names, named = free(df, "__names"), free(df, "__named")
    df = df.withColumn(names, names_of(senders(F.col(text)))).withColumn(named, find_names(F.col(text), F.col(names)))
    both = F.concat(F.col(named), clear_of(MENTION.spans(F.col(text)), F.col(named)))
    return df.withColumn(out, ordered(both)).drop(names, named)


def anonymize(df: DataFrame, text: str = "text", out: str = "masked", style: str = "fake", enabled: tuple[str, ...] = ("name", "contact", "place", "finance", "id"), **options) -> DataFrame:
    """Chats with names replaced by fake ones, and other personal data by numbered labels."""
    chat, spans = free(df, "__chat"), free(df, "__spans")
    df = with_spans(with_chat_names(df, text, chat), text, spans, enabled=list(enabled), extra=chat, **options)
    return masked(df, style, text, spans, out).drop(chat, spans)
