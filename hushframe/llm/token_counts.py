"""Token counts of whole texts, without their ids.

A tokenizer cuts a text into pre-tokens (words with the space before them, numbers, signs) before
it merges anything, so a text has as many tokens as its pre-tokens have together. Pre-tokens
repeat, so each distinct one of the corpus is put to the tokenizer's model once, and gives a
number; those numbers meet each document's pre-token frequencies in a join and are summed.

Some ten thousand pre-tokens make up most of any text. Those that are more than one in ``COMMON``
of all (so there are at most ``COMMON`` of them, whatever the corpus) are sent to all tasks,
which sum them where the text is; only the others travel, and as each of them is rare, no key of
the join is hot. Longer pre-tokens than ``LONGEST`` characters travel as their sha256, so that
what is sent to all tasks is at most ``COMMON`` short strings.

A null text is an empty one: no bytes, no tokens. Repeated rows are counted and returned each;
an empty table gives an empty result. The string of an added token in a text is one token, as by
the library's default; added tokens that take the space beside them are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, per_text, written
from .tokens import KINDS, LONGEST, UNUSUAL, Encoder, tokenizer_path

#: One in how many pre-tokens of the corpus a common one is.
COMMON = 1 << 20
#: Distinct pre-tokens a task holds before it passes their counts on.
HELD = 1 << 20
TOKENIZER = "byte_bpe_50k.json"


class Cutter:
    """``cut(text)`` gives a text's pre-tokens and how many added tokens stand among them, and
    ``tokens(piece)`` how many tokens a pre-token has; together, as many as the library gives."""

    loaded: dict[str, Cutter] = {}

    def __init__(self, path: str):
        self.kind = self.added = None
        if path.endswith(".model"):
            import sentencepiece

            self.whole = sentencepiece.SentencePieceProcessor(model_file=path).encode
            return
        self.encoder = Encoder.get(path)
        about = json.loads(Path(path).read_text(encoding="utf-8"))
        odd = [t["content"] for t in about.get("added_tokens") or [] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        if odd:
            raise ValueError(f"added tokens {odd} depend on what is beside them")
        self.kind = self.encoder.kind
        self.whole = lambda text: self.encoder.tokenizer.encode(text, add_special_tokens=False).ids
        if self.kind and self.encoder.added:
            self.added = re.compile("|".join(re.escape(t) for t in sorted(self.encoder.added, key=len, reverse=True)))

    @classmethod
    def get(cls, path: str) -> Cutter:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def cut(self, text: str) -> tuple[list[str], int]:
        if self.kind is None:  # a tokenizer of another build: a text is its own pre-token
            return ([text] if text else []), 0
        if self.added is None or not self.added.search(text):
            return self.plain(text), 0
        parts = self.added.split(text)
        return [p for part in parts for p in self.plain(part)], len(parts) - 1

    def plain(self, text: str) -> list[str]:
        pattern, lower = KINDS[self.kind]
        if not UNUSUAL.search(text):
            return pattern.findall(text.lower() if lower else text)
        own = self.encoder.tokenizer
        text = own.normalizer.normalize_str(text) if own.normalizer else text
        return [text[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(text)]

    def tokens(self, piece: str) -> int:
        if self.kind is None:
            return len(self.whole(piece))
        return len(self.encoder.model.tokenize(piece.encode().decode("latin-1").translate(self.encoder.letters)))


def short(piece: str) -> str:
    return piece if len(piece) <= LONGEST else "\0" + hashlib.sha256(piece.encode()).hexdigest()


def short_of(piece: Column) -> Column:
    """The same as ``short``, for a column."""
    return F.when(F.length(piece) <= LONGEST, piece).otherwise(F.concat(F.lit("\0"), F.sha2(piece, 256)))


def frequencies(texts: DataFrame, path: str) -> DataFrame:
    """``(piece, n)``: how often each pre-token occurs in all of ``texts`` (one column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = Cutter.get(path), Counter()

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["piece", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                seen.update(cutter.cut(text.as_py() or "")[0])
                if len(seen) > HELD:
                    yield told()
        yield told()

    return texts.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def counted(pieces: DataFrame, path: str) -> DataFrame:
    """``(key, n, tokens)`` of distinct pre-tokens ``(piece, n)``."""

    def count(pieces: pa.Array) -> pa.Array:
        cutter = Cutter.get(path)
        return pa.array([cutter.tokens(p.as_py()) for p in pieces], pa.int64())

    count.__annotations__ = {"pieces": pa.Array, "return": pa.Array}
    return pieces.select(short_of(F.col("piece")).alias("key"), "n", arrow_udf(count, "long")("piece").alias("tokens"))


def parted(path: str, common) -> Callable[[Column], Column]:
    """``(known, rare)`` of a text: the sum of its added and common pre-tokens' tokens, and its other
    pre-tokens with their frequencies."""

    def part(texts: pa.Array) -> pa.Array:
        cutter, tokens = Cutter.get(path), common.value
        known, keys, numbers, ends = [], [], [], [0]
        for text in texts:
            found, total = cutter.cut(text.as_py())
            for piece, n in Counter(found).items():
                key = short(piece)
                each = tokens.get(key)
                if each is None:
                    keys.append(key)
                    numbers.append(n)
                else:
                    total += each * n
            known.append(total)
            ends.append(len(keys))
        rare = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int64())], names=["key", "n"])
        return pa.StructArray.from_arrays([pa.array(known, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)], names=["known", "rare"])

    return per_text(part, "struct<known long, rare array<struct<key string, n long>>>")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, common: int = COMMON, fixed: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every document. Rows are told apart by their place, so ``docs``
    has to give them in the same order whenever it is read, as files do; if it does not, as after a
    shuffle, ``fixed=False`` writes it first."""
    path = path or tokenizer_path(TOKENIZER)
    docs = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs if fixed else cut(docs)
    pieces = written(counted(frequencies(docs.select("text"), path), path))
    least = (pieces.agg(F.sum("n")).first()[0] or 0) / common
    frequent = pieces.where(F.col("n") > least).select("key", "tokens").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in frequent.columns), strict=True)))
    seen = docs.select(F.monotonically_increasing_id().alias("row"), "id", F.octet_length("text").cast("long").alias("bytes"), parted(path, sent)(F.col("text")).alias("seen"))
    # A document's own row goes along with its rare pre-tokens, under a key that is no pre-token's.
    nothing = [F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in ("id", "bytes")]
    own = F.struct(F.concat(F.lit("\0\0"), F.col("row")).alias("key"), F.col("seen.known").alias("n"), "id", "bytes")
    rare = F.transform("seen.rare", lambda p: F.struct(p["key"].alias("key"), p["n"].alias("n"), *nothing))
    rows = seen.select("row", F.explode(F.concat(F.array(own), rare)).alias("p")).select("row", "p.*")
    met = rows.join(pieces.where(F.col("n") <= least).select("key", "tokens"), "key", "left")
    total = met.groupBy("row").agg(F.sum(F.col("n") * F.coalesce("tokens", F.lit(1))).alias("n_tokens"), F.max("bytes").alias("n_bytes"), F.first("id", True).alias(doc_id))
    return total.select(doc_id, "n_bytes", "n_tokens")
