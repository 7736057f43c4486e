"""Words to hide always, given as a table: any number of them against any number of texts.

A term and a text are cut into the same atoms, words (runs of letters and digits) and single other
characters, so a term that stands in a text as it is, not inside a word, is a run of atoms equal
to its own. Runs of the lengths that terms have are looked up in a filter of fixed size, which
knows the terms and few others; what passes meets the terms by equality, so there is neither
a cross join nor an alternation of all terms. Texts are gone through many at a time, as arrays of
code points; what a run hashes to follows from the sums up to its two ends.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, StringType, StructType

#: Bits of the filter, a megabyte, whatever the number of terms; and how many of them a term sets.
BITS, MARKS = 1 << 23, 4
#: Code points of the texts that are gone through together (a longer text is one block), and found
#: runs that are handed on together.
BLOCK, ROWS = 1 << 18, 1 << 16
#: Bytes of terms up to which each task gets them, so that what passes the filter is not shuffled.
SMALL = 10 << 20
#: From here on, no code point has a case.
CASED = 0x20000
#: Hashes are polynomials in an odd number, modulo 2 ** 64.
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
ATOMS = regex.compile(r"[\p{L}\p{N}]+|.", regex.DOTALL)
WORDS = regex.compile(r"[\p{L}\p{N}]+")


def plain(c: str) -> str:
    """A character regardless of its case, one for one."""
    up = c.upper()
    return (up if len(up) == 1 else c).lower()[:1]


def low(text: str) -> str:
    small = text.lower() if text.isascii() else "".join(map(plain, text))
    return small


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point the ``plain`` one, whether it is part of words, and whether just one of the two is."""
    small, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    small[:CASED] = [ord(plain(chr(c))) for c in range(CASED)]
    for m in WORDS.finditer("".join(map(chr, range(0x110000)))):
        word[m.start() : m.end()] = True
    return small, word, word[small] != word


@functools.lru_cache(1)
def powers(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``BASE`` and of its inverse, the powers from 0 to ``most``."""
    each = [np.full(most + 1, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    for e in each:
        e[0] = 1
    return tuple(np.cumprod(e, dtype=np.uint64) for e in each)


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(max(BLOCK, 1 << max(0, n - 1).bit_length()))


def sums(small: np.ndarray) -> np.ndarray:
    """The sum up to each place between code points, of a code point times the power of its place."""
    upto = np.zeros(len(small) + 1, np.uint64)
    np.cumsum((small.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX) * powers_for(len(small))[0][: len(small)], out=upto[1:])
    return upto


def hashes(upto: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What runs of code points hash to, wherever they stand."""
    h = (upto[ends] - upto[starts]) * powers_for(len(upto) - 1)[1][starts]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def mark(h: np.ndarray, k: int) -> np.ndarray:
    """A bit of the filter of each hash, of ``MARKS``: two halves, stepped."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a + np.uint64(k) * b) & np.uint64(BITS - 1)).astype(np.int64)


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in order, as many at a time as have ``BLOCK`` code points, with the number of the first."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > BLOCK:
            yield first, texts[first:i]
            first, n = i, 0
        n += len(t)
    if n:
        yield first, texts[first:]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text begins in them, with the end."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def keys_of(term: Column) -> Column:
    """``struct<key, length>`` of a term: as it is compared, and its number of atoms."""

    def run(terms: pa.Array) -> pa.Array:
        rows = [{"key": low(t.strip()), "length": len(ATOMS.findall(t.strip()))} for t in (x or "" for x in terms.to_pylist())]
        return pa.array(rows, pa.struct([("key", pa.string()), ("length", pa.int32())]))

    run.__annotations__ = {"terms": pa.Array, "return": pa.Array}
    return arrow_udf(run, "struct<key string, length int>")(term)


def filter_of(terms: DataFrame) -> tuple[np.ndarray, list[int], int]:
    """The filter of terms ``key, length``, made in the tasks and joined bit by bit; the different lengths; and
    the bytes of all terms."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = np.zeros(BITS, bool), {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for _, some in blocks(keys):
                codes, begins = points(some)
                h = hashes(sums(codes), begins[:-1], begins[1:])
                for k in range(MARKS):
                    own[mark(h, k)] = True
            for key, n in zip(keys, batch.column(1).to_pylist(), strict=True):
                sizes[n] = sizes.get(n, 0) + len(key.encode("utf-8", "surrogatepass"))
        words = np.packbits(own, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        # A length is a negative place.
        rows = ([*at.tolist(), *(-n for n in sizes)], [*words[at].tolist(), *([0] * len(sizes))], [*([0] * len(at)), *sizes.values()])
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["at", "word", "size"])

    told = terms.select("key", "length").mapInArrow(bits, "at long, word long, size long").groupBy("at").agg(F.bit_or("word").alias("word"), F.sum("size").alias("size")).toArrow()
    at, word, size = (told.column(c).to_numpy() for c in ("at", "word", "size"))
    out = np.zeros(BITS // 64, "<i8")
    out[at[at >= 0]] = word[at >= 0]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool), sorted((-at[at < 0]).tolist()), int(size.sum())


def apart(small: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which runs stay: of those with the same key that overlap, the first."""
    stay, order = np.ones(len(h), bool), np.lexsort((starts, h))
    same = h[order][1:] == h[order][:-1]
    near = same & (starts[order][1:] < ends[order][:-1])
    if near.any():
        group = np.concatenate([[0], np.cumsum(~same)])
        till: dict[tuple[int, bytes], int] = {}
        for k in np.flatnonzero(np.isin(group, group[1:][near])).tolist():
            i = order[k]
            a, b = int(starts[i]), int(ends[i])
            key = (int(group[k]), small[a:b].tobytes())
            if a >= till.get(key, 0):
                till[key] = b
            else:
                stay[i] = False
    return stay


def found_in(codes: np.ndarray, begins: np.ndarray, lengths: list[int], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(small, starts, ends)``: the texts as they are compared, and in them the runs of atoms that may be
    terms; of runs with the same key that overlap, the first."""
    table, words, odd = tables()
    small, word = table[codes], words[codes]
    opens = np.zeros(len(codes) + 1, bool)
    opens[begins] = True
    new = ~word | opens[:-1]
    new[1:] |= ~word[:-1]
    at = np.append(np.flatnonzero(new), len(codes))  # where atoms begin, and the end
    opens, is_word = opens[at], np.append(word, False)[at]
    stop = np.flatnonzero(opens)[np.cumsum(opens[:-1])]  # the first atom of the next text
    may = opens[:-1].copy()
    may[1:] |= ~is_word[:-2]  # not inside a word
    may, upto, found = np.flatnonzero(may), sums(small), []
    for n in lengths:
        a = may[may + n <= stop[may]]
        b = a + n
        fit = ~is_word[b] | (b == stop[a])  # the next atom is no word
        a, b = at[a[fit]], at[b[fit]]
        h = hashes(upto, a, b)
        for k in range(MARKS):
            fit = known[mark(h, k)]
            a, b, h = a[fit], b[fit], h[fit]
        found.append((a, b, h))
    a, b, h = (np.concatenate(x) for x in zip(*found, strict=True))
    # Single atoms overlap none of their key, unless a key has other atoms than the text.
    long = np.arange(len(a)) >= (0 if lengths[0] > 1 or odd[codes].any() else len(found[0][0]))
    stay = ~long
    stay[long] = apart(small, h[long], a[long], b[long])
    return small, a[stay], b[stay]


def pieces(small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of code points as strings."""
    n = ends - starts
    upto = np.concatenate([[0], np.cumsum(n)])
    codes = small[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], n)]
    bytes_upto = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(bytes_upto[upto].astype(np.int32)), pa.py_buffer(text))


def term_spans(texts: DataFrame, terms: DataFrame, by: list[str], text: str = "text", term: str = "term") -> DataFrame:
    """``(by, tag, start, end)``: where the terms stand in the texts, as ``detect_terms`` finds them: as
    they are, in any case, not inside a word; matches of different terms may overlap.

    Null and blank terms are left out, repeated ones count once; null texts have no spans. The driver
    gets the terms' different lengths and the filter, and the terms themselves where they are
    ``SMALL``: then what passes the filter stays in its task."""
    known = terms.select(keys_of(F.col(term)).alias("k")).select("k.*").where("key <> ''").distinct()
    marked, lengths, size = filter_of(known)
    bits = texts.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(bits.value).astype(bool)
        for batch in batches if lengths else ():
            for first, some in blocks([t or "" for t in batch.column(len(by)).to_pylist()]):
                codes, begins = points(some)
                small, starts, ends = found_in(codes, begins, lengths, own)
                for i in range(0, len(starts), ROWS):
                    a, b = starts[i : i + ROWS], ends[i : i + ROWS]
                    of = np.searchsorted(begins, a, "right") - 1
                    rows = [c.take(pa.array(first + of)) for c in batch.columns[: len(by)]]
                    places = [pa.array((x - begins[of]).astype(np.int32)) for x in (a, b)]
                    yield pa.RecordBatch.from_arrays([*rows, pieces(small, a, b), *places], names=[*by, "__key", "start", "end"])

    asked = texts.select(*by, F.col(text).alias("__text"))
    kind = StructType(asked.schema.fields[:-1]).add("__key", StringType()).add("start", IntegerType()).add("end", IntegerType())
    own = known.select(F.col("key").alias("__key"))
    met = asked.mapInArrow(run, kind).join(F.broadcast(own) if size <= SMALL else own, "__key", "left_semi")
    return met.select(*by, F.lit("CUSTOM").alias("tag"), "start", "end")
