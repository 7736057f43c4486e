"""Language identification by prediction by partial matching (PPM) over bytes.

Per language, a tree of byte contexts of up to ``ORDER`` bytes is counted on training
texts and then frozen. A byte is coded in the longest context seen in that language; where
the context has not seen the byte, an escape is coded and the next shorter context tried,
down to a uniform code (escape probability by method C: distinct / (distinct + count)). The
code length of a text is exact: the sum over all of its bytes. The shortest code names the
language.

With frozen statistics a byte's code lengths in all languages depend on it and the ORDER
bytes before it alone. They are looked up in the languages' trees once, and kept in a table
of fixed size by the four bytes' hash, so that a text is scored in a few numpy gathers, with
no loop over its bytes. The trees hold what the training sample holds, nothing is left out.

Bytes are folded first: ASCII letters to lower case, and runs of other ASCII (white space,
digits, punctuation) to one space.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, per_text

ORDER = 3
#: Training rows per language, at most: those with the smallest hashed id.
MOST_ROWS = 2000
#: Code lengths in the table of a worker: slots times languages.
CELLS = 1 << 20
#: Bytes scored at once.
BLOCK = 1 << 18

FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def folded(text: str) -> bytes:
    return b" ".join(text.encode().translate(FOLD).split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Order:
    """A language's contexts of one length: sorted, with code lengths in bits. ``keys`` are a
    context and a byte that it has seen, ``contexts`` those that end in an escape."""

    keys: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, n: np.ndarray) -> Order:
        keys, at = np.unique(grams, return_inverse=True)
        n = np.bincount(at, n)
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        distinct = np.bincount(of)
        whole = np.bincount(of, n) + distinct
        return cls(keys, -np.log2(n / whole[of]), contexts, -np.log2(distinct / whole))

    def code(self, grams: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of ``grams``, given those in shorter contexts."""
        out = shorter.copy()
        at, known = found(self.contexts, grams >> 8)
        out[known] += self.escapes[at[known]]
        at, known = found(self.keys, grams)
        out[known] = self.bits[at[known]]
        return out


def found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``values`` stand in sorted ``keys``, and whether they do."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


@dataclass
class Model:
    langs: list[str]
    trees: list[list[Order]]  # by language, from order 0 on
    slots: dict = field(default_factory=dict, repr=False)  # a worker's own table

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code lengths in bits: one row per text, one column per language."""
        out = np.zeros((len(texts), len(self.langs)))
        pad = b" " * ORDER
        waiting, where, size = [], [], 0
        for i, text in enumerate(texts):
            raw = pad + folded(text)
            for at in range(ORDER, len(raw), BLOCK):  # a long text goes in parts, with its context
                part = raw[at - ORDER : at + BLOCK]
                waiting.append(part)
                where.append(i)
                size += len(part)
                if size >= BLOCK:
                    self.add(out, waiting, where)
                    waiting, where, size = [], [], 0
        if waiting:
            self.add(out, waiting, where)
        return out

    def add(self, out: np.ndarray, parts: list[bytes], where: list[int]) -> None:
        s = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        bits = np.append(self.code(s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:]), np.zeros((1, len(self.langs))), axis=0)
        ends = np.cumsum([len(p) for p in parts])
        starts = np.concatenate([[0], ends[:-1]])
        # a part's first ORDER bytes are context only: its bytes are coded from there on
        index = np.stack([starts, ends - ORDER], 1).ravel()
        np.add.at(out, where, np.add.reduceat(bits, index, axis=0)[::2])

    def code(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of ``grams``, one column per language."""
        if not self.slots:
            size = 1 << max(10, (CELLS // len(self.langs)).bit_length() - 1)
            self.slots |= {"shift": np.uint32(33 - size.bit_length()), "gram": np.full(size, 1 << 32, np.uint64), "bits": np.zeros((size, len(self.langs)))}
        slot = lambda g: (g * np.uint32(2654435769)) >> self.slots["shift"]
        at = slot(grams)
        bits, miss = self.slots["bits"][at], np.flatnonzero(self.slots["gram"][at] != grams)
        if len(miss):
            new, back = np.unique(grams[miss], return_inverse=True)
            lengths = self.look_up(new)
            bits[miss] = lengths[back]
            self.slots["gram"][slot(new)], self.slots["bits"][slot(new)] = new, lengths
        return bits

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        out = np.full((len(grams), len(self.langs)), 8.0)
        for k, orders in enumerate(self.trees):
            for m, order in enumerate(orders):
                out[:, k] = order.code(grams & np.uint32((1 << 8 * (m + 1)) - 1), out[:, k])
        return out


def count_contexts(batches):
    """Counts of (language, context of three bytes, byte) per Arrow batch of (lang, text)."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if folded(text or ""):
                by.setdefault(lang, []).append(b" " * ORDER + folded(text))
        for lang, texts in by.items():
            grams = [np.frombuffer(t, np.uint8).astype(np.int64) for t in texts]
            code = np.concatenate([((g[:-3] << 24) | (g[1:-2] << 16) | (g[2:-1] << 8) | g[3:]) for g in grams])
            seen, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(n)], names=["lang", "gram", "n"])


def sample(docs: DataFrame, most_rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, text)`` of at most ``most_rows`` rows of each language, by smallest hashed id.

    Hashes are first cut at a rate from the language's number of rows, so that the ranking
    sees few more rows than it keeps."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit("train")).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return rows.select("lang", "text").limit(0)
    most = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, (1.2 * most_rows + 100) / n)))])
    unit = (F.shiftrightunsigned("h", 11)).cast("double") / F.lit(float(1 << 53))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return rows.where(unit < most[F.col("lang")]).withColumn("r", rank).where(F.col("r") <= most_rows).select("lang", "text")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS) -> Model | None:
    """A model from the labelled rows of ``docs``, counted on a bounded sample (at most
    ``most_rows`` rows of each language, whole texts); None without any labelled text."""
    counts = sample(docs, most_rows, id_col, text_col, lang_col).mapInArrow(count_contexts, "lang string, gram long, n long")
    table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return build(table.column("lang").to_pylist(), table.column("gram").to_numpy(), table.column("n").to_numpy()) if table.num_rows else None


def build(lang_of: list[str], gram: np.ndarray, n: np.ndarray) -> Model:
    """A model from counts of four bytes (three of context, and the one that follows)."""
    langs = sorted(set(lang_of))
    which = np.searchsorted(np.array(langs), np.array(lang_of))
    gram, trees = gram.astype(np.uint32), []
    for k in range(len(langs)):
        mine = which == k
        trees.append([Order.of(gram[mine] & np.uint32((1 << 8 * (m + 1)) - 1), n[mine]) for m in range(ORDER + 1)])
    return Model(langs, trees)


def predict(model: Model | None, spark):
    """An Arrow function from a text to ``struct<lang, score>``.

    ``score`` is the posterior of the shortest code under equal priors, from the code lengths
    per character times the square root of the number of characters; ``und`` and 0 where the text is
    null or has no letter, or no language was learned."""
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        m, values = sent.value, texts.to_pylist()
        lettered = np.array([has_letter(t) for t in values], bool)
        if m is None:
            return pa.StructArray.from_arrays([pa.array(["und"] * len(values)), pa.array(np.zeros(len(values)))], names=["lang", "score"])
        lengths = m.lengths(values)
        n = np.array([len(t) for t in values], float).clip(1)
        gap = (lengths - lengths.min(1, keepdims=True)) / np.sqrt(n)[:, None]
        score = 1 / np.exp2(-gap.clip(0, 60)).sum(1)
        best = lengths.argmin(1)
        names = [m.langs[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["lang", "score"])

    return per_text(run, "struct<lang:string,score:double>")


def held_out(id_col: str = "doc_id", buckets: int = 5, bucket: int = 0):
    return bucket_of(F.col(id_col), buckets) == bucket


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS) -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` per row of ``docs``.

    Learns from text and language of rows that are not held out (crc32 of the id's text,
    modulo 5, is 0; a null id is not held out). Null texts, and texts without a letter, are
    ``und`` with score 0. Repeated rows come back each."""
    out = F.coalesce(held_out(id_col), F.lit(False))
    model = train(docs.where(~out), id_col, text_col, lang_col, most_rows)
    found = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), predict(model, docs.sparkSession)(F.col(text_col)).alias("p"))
    return found.select(F.col("id").alias(id_col), "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
