"""Detection and masking of sensitive text: the core operators.

Everything but pseudonyms is one chain of native column expressions, computed in stages so
that patterns stand in the plan once; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.spans import SPANS, blocks, bound, clear_of, coalesce, first_rule_wins, fold, none, part, rebuilt, scan, span, trimmed
from .names import pseudonyms

STYLES = ("labels", "numbered", "blocks", "redacted", "fake")


def detect_patterns(text: Column, upto: str | None = None) -> Column:
    """All pattern rules, first come first served: national numbers, general rules in their
    order, foreign dates. ``upto`` names the last rule wanted: rules after it can't matter
    to it and are left out."""
    order = [*R.NATIONAL, *R.GENERAL, R.FOREIGN_DATES]
    if upto:
        order = order[: [r.name for r in order].index(upto) + 1]
    return first_rule_wins(R.detect(text, order))


def literal(term: str) -> str:
    """A pattern that matches the term as it stands."""
    return "".join(f"\\{c}" if c in r".*+?^${}()|[]\\" else c for c in term)


def detect_terms(text: Column, terms: list[str]) -> Column:
    """Words to hide always: as they stand, in any case, not inside a word."""
    found = [scan(text, f"(?iu){R.U0}{literal(t)}{R.U1}", "CUSTOM") for t in terms if t]
    return F.concat(*found) if found else none()


def parse_terms(value: str) -> list[str]:
    return [t.strip() for t in value.replace("\n", ",").split(",") if t.strip()]


def model_tags(model_spans: Column, least: float = R.LEAST_MODEL_SCORE) -> Column:
    """A name model's ``array<struct<label, start, end, score>>`` as spans: known labels, and
    scores of ``least`` or more."""
    tags = F.create_map(*[F.lit(x) for pair in R.TAG_OF_LABEL.items() for x in pair])
    known = F.filter(model_spans, lambda s: (s["score"] >= least) & tags[s["label"]].isNotNull())
    return F.coalesce(F.transform(known, lambda s: span(tags[s["label"]], s["start"], s["end"])), none())


def enabled_only(spans: Column, enabled: list[str], category_of: dict[str, str] | None = None) -> Column:
    tags = [t for t, c in (category_of or R.CATEGORY_OF).items() if c in enabled] + ["CUSTOM"]
    return F.filter(spans, lambda s: s["tag"].isin(tags))


def free(df: DataFrame, name: str) -> str:
    """A name for a column of our own that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def with_spans(df: DataFrame, text: str = "text", out: str = "spans", enabled: list[str] | None = None, terms: list[str] | None = None, extra: str | None = None, model: str | None = None, category_of: dict[str, str] | None = None) -> DataFrame:
    """Adds ``out``: what to hide in ``text``, sorted and disjoint.

    ``extra`` names a column of a tool's own spans, which win over the patterns; ``model`` one
    of a name model's spans. Categories are filtered after detection, so that a rule that is
    off still shields its text. A null text has no spans."""
    t = F.col(text)
    found, every = free(df, "__found"), free(df, "__all")
    df = df.withColumn(found, detect_patterns(t))
    own = F.coalesce(F.col(extra), none()) if extra else none()
    left = clear_of(F.col(found), own) if extra else F.col(found)
    df = df.withColumn(every, F.concat(own, left, model_tags(F.col(model)) if model else none(), detect_terms(t, terms or [])))
    df = df.withColumn(every, coalesce(enabled_only(F.col(every), enabled or R.DEFAULT_ON, category_of)))
    return df.withColumn(out, F.coalesce(trimmed(t, F.col(every)), none())).drop(found, every)


def with_values(df: DataFrame, text: str = "text", spans: str = "spans", out: str = "values") -> DataFrame:
    value = lambda s, blocks: F.struct(s["tag"].alias("tag"), s["start"].alias("start"), s["end"].alias("end"), part(blocks, s["start"], s["end"]).alias("value"))
    return df.withColumn(out, bound(blocks(F.col(text)), lambda blocks: F.transform(spans, lambda s: value(s, blocks))))


def numbers(values: Column) -> Column:
    """The number of each value within its tag, by first appearance; case does not count.

    Sorted by tag and value, each value meets its first place; sorted by tag and first place, its
    number; sorted by place, they are as they came."""
    pair = lambda **columns: F.struct(*[c.alias(name) for name, c in columns.items()])

    def first_place(acc: Column, x: Column) -> tuple[Column, Column]:
        at = F.when((acc["tag"] == x["tag"]) & (acc["key"] == x["key"]), acc["at"]).otherwise(x["i"])
        return pair(tag=x["tag"], key=x["key"], at=at), F.array(pair(tag=x["tag"], at=at, i=x["i"]))

    def number(acc: Column, x: Column) -> tuple[Column, Column]:
        n = F.when(acc["tag"] == x["tag"], acc["n"] + (acc["at"] != x["at"]).cast("int")).otherwise(1)
        return pair(tag=x["tag"], at=x["at"], n=n), F.array(pair(i=x["i"], n=n))

    keyed = F.transform(values, lambda v, i: pair(tag=v["tag"], key=F.lower(v["value"]), i=i))
    places = fold(F.sort_array(keyed), F.lit(None).cast("struct<tag:string,key:string,at:int>"), "array<struct<tag:string,at:int,i:int>>", first_place)
    found = fold(F.sort_array(places), F.lit(None).cast("struct<tag:string,at:int,n:int>"), "array<struct<i:int,n:int>>", number)
    return F.transform(F.sort_array(found), lambda x: x["n"])


def masked(df: DataFrame, style: str = "labels", text: str = "text", spans: str = "spans", out: str = "masked", kept: str | None = None) -> DataFrame:
    """Adds ``out``: ``text`` with its spans hidden.

    Styles: ``labels`` [TAG]; ``numbered`` [TAG_n]; ``blocks``; ``redacted``; ``fake``: names by
    pseudonym, the rest numbered. ``kept`` names a column of ``start:end`` keys of spans to
    leave as they are; they use up their number or name all the same. Null text: null."""
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    at, n, fake, subs = (free(df, c) for c in ("__values", "__n", "__fake", "__subs"))
    df = with_values(df, text, spans, at)
    values = F.col(at)
    df = df.withColumn(n, numbers(values) if style in ("numbered", "fake") else F.transform(values, lambda v: F.lit(0)))
    names = F.transform(values, lambda v: F.when(v["tag"] == "NAME", v["value"]))
    df = df.withColumn(fake, pseudonyms(names) if style == "fake" else F.transform(values, lambda v: F.lit(None).cast("string")))
    left = F.coalesce(F.col(kept), F.array().cast("array<string>")) if kept else None

    def sub(v: Column, extra: Column) -> Column:
        if style == "blocks":
            new = F.repeat(F.lit("█"), F.greatest(F.lit(3), F.length(v["value"])))
        elif style == "redacted":
            new = F.lit("[REDACTED]")
        elif style == "labels":
            new = F.concat(F.lit("["), v["tag"], F.lit("]"))
        else:
            new = F.coalesce(extra["f"], F.concat(F.lit("["), v["tag"], F.lit("_"), extra["n"].cast("string"), F.lit("]")))
        if kept:
            new = F.when(F.array_contains(left, F.concat_ws(":", v["start"], v["end"])), v["value"]).otherwise(new)
        return F.struct(v["start"].alias("start"), v["end"].alias("end"), new.alias("sub"))

    extras = F.zip_with(F.col(n), F.col(fake), lambda n, f: F.struct(n.alias("n"), f.alias("f")))
    df = df.withColumn(subs, F.zip_with(values, extras, sub))
    return df.withColumn(out, rebuilt(F.col(text), F.col(subs))).drop(at, n, fake, subs)


def redact(df: DataFrame, style: str = "labels", text: str = "text", out: str = "masked", **options) -> DataFrame:
    """``with_spans`` and ``masked`` in one."""
    spans = free(df, "__spans")
    return masked(with_spans(df, text, spans, **options), style, text, spans, out).drop(spans)


def counts(df: DataFrame, spans: str = "spans", by: list[str] | None = None) -> DataFrame:
    """Hidden spans by tag, and by the columns ``by``."""
    return df.select(*(by or []), F.explode(spans).alias("s")).groupBy(*(by or []), F.col("s.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


__all__ = ["SPANS", "counts", "detect_patterns", "detect_terms", "masked", "model_tags", "parse_terms", "redact", "with_spans", "with_values"]
