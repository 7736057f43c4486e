"""Personal data: fixed patterns, and a linear-chain conditional random field.

The base spans are the matches of four fixed patterns. The method adds spans that the
patterns miss (a phone number without a plus sign, a card number in other groups). Its
sequences are runs of neighbouring *marked* tokens, those with a digit or an at sign; any
other token can only be outside (a constraint of the model, so that a run decodes by
itself), but the words before a run are features of it. Features are word shapes, digit
counts, check digits and neighbours; labels are B and I of each kind, and O. The model is
trained on the small labelled table below, by gradient steps on the exact likelihood, and
decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

# Fixed patterns. The email pattern is matched from its at sign, the others as they stand
# (a run of digits can only begin a match at its own start).
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind, then start; each kind's matches from left to right."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append(("email", start, last))
        at = text.find("@", max(last, at + 1))
    for m in IP.finditer(text):
        if octets(m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# The labelled table: texts with {kind:value} where there is personal data. # stands for a
# digit drawn at random, ~ for a last digit that makes the Luhn sum right, ! for one that
# makes it wrong, and % for a number from 1 to 254.
TABLE = """
call me at {phone:(###) ###-####} after six
tel {phone:###-###-####} or write to {email:ann.lee@example.com} today
phone: {phone:###.###.####}, room 12
my number is {phone:### ### ####}.
mobile {phone:07### ######} evenings only
Tel. {phone:0## #### ####} or fax {phone:0## #### ####}
reach us on {phone:1-###-###-####} at any hour
call {phone:+1 (###) 555-####} now
phone {phone:+44 20 #### ####}; office 4
ring {phone:+49 30 ########} between 9 and 17
whatsapp {phone:+34 6## ### ###} por favor
telefon {phone:0###/#######} bitte
contact {phone:(0##) ### ####} for 25 copies
fax {phone:(###)###-####} page 2
the call lasted 45 minutes and 12 people came
card {card:#### #### #### ###~} expires 04/27
card number {card:####-####-####-###~} please
pay with {card:###############~} or cash
carte {card:#### ###### ####~} valable
visa {card:###############~}, cvv 123
kreditkarte {card:#### #### #### ###~} bis 2027
order #### #### #### ###! was shipped
serial ###############! in stock
invoice ############ of 2021
reference ######## and ######## differ
tracking ### ### ### ### ### is late
host {ip:%.%.%.%} is down
server at {ip:%.%.%.%}, port 8080
from {ip:%.%.%.%} to {ip:%.%.%.%} in 20 ms
ping {ip:10.%.%.%} failed 3 times
version 4.18.0.305 was installed
release 1.2.3 fixed 14 bugs
build 2021.10.12.3321 is out
mail {email:user.##@mail#.example.com} for help
write {email:k_smith@corp.example.org} or {email:info@shop.example}
email {email:root@localhost} on the host
e-mail: {email:ana@uni} thanks
contact {email:first.last##@mail.example.net}.
@handle said hello to @friend at 10
follow @news_24 for updates
meet @ 10:30 in room 204
in 1999 there were 250 of them
on 12/03/2021 at 14:05 we met
the year 2020 and 2021 were hard
2021-03-14 10:20:30 started 5 jobs
chapter 12, verses 3-17, page 455
sold 1,200 units for $45.50 each
isbn 978-3-16-148410-0 in print
price 1299 or 1,299.00 with 19% tax
population 8 336 817 in 2019
coordinates 52.5200 13.4050 north
id 12345 and 67890 are open
size 10x20x30 weight 5kg
temperature 21.5 to 23.7 degrees
article 7 of law 19/2003 applies
bus 42 leaves at 8 and 9 and 10
score was 3-2, then 4-1
room 101 floor 3 building 22
sum 100 200 300 400 500 600 700
ratio 16:9 or 4:3 at 60 hz
a1b2c3 and x9y8 are codes
call 911 now
phone extension 4312
tel 5 lines
card 52 of 78
card game with 52 cards
port 22 and port 443
email 3 people by 5
phones {phone:(###) ###-####} {phone:(###) ###-####} {phone:(###) ###-####} {phone:(###) ###-####}
list {phone:### ### ####} {phone:### ### ####} {phone:### ### ####} {phone:### ### ####}
3 7 a1 12 90 81 204 1999 55 5 {phone:(###) ###-####} 7 88 120 9
"""
#: Draws per line of the table, and steps of training.
DRAWS, STEPS, SEED = 5, 150, 5
CUES = {
    "phone": "phone tel telefon telephone téléphone teléfono call mobile cell fax ring whatsapp number reach contact".split(),
    "card": "card visa mastercard carte kreditkarte tarjeta credit pay".split(),
    "ip": "ip host server address ping from gateway".split(),
    "email": "email mail e-mail write correo courriel".split(),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}

TOKEN, MARK = re.compile(r"\S+"), re.compile("[0-9@]")
SHAPE = str.maketrans({**{c: "d" for c in "0123456789"}, **{chr(c): "a" for c in [*range(65, 91), *range(97, 123)]}})
SQUEEZE = re.compile(r"(.)\1+", re.DOTALL)
EDGE_LEFT, EDGE_RIGHT = re.compile("[^A-Za-z0-9+(@]*"), re.compile("[^A-Za-z0-9)]*")
#: Tokens of short runs decoded together, about; a run is never cut.
TOGETHER = 1 << 18


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    word = text[start:end]
    a, b = start + EDGE_LEFT.match(word).end(), end - EDGE_RIGHT.match(word[::-1]).end()
    return (a, b) if a < b else (start, end)


def runs(text: str) -> list[tuple[tuple[str, str], list[tuple[int, int]]]]:
    """Runs of neighbouring marked tokens, each with the two words before it on its line."""
    out: list = []
    if not MARK.search(text):
        return out
    one, two, last = (0, 0), (0, 0), -1  # the two tokens before, and the end of the last marked one
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if MARK.search(text, start, end):
            if 0 <= last and start - last <= 3 and "\n" not in text[last:start]:
                out[-1][1].append((start, end))
            else:
                near = [text[slice(*two)] if two[1] and "\n" not in text[two[1] : start] else ""]
                near.insert(0, text[slice(*one)] if near[0] and one[1] and "\n" not in text[one[1] : two[0]] else "")
                out.append((tuple(w.strip(".,:;()").lower() for w in near), [(start, end)]))
            last = end
        one, two = two, (start, end)
    return out


def bucket(n: int) -> str:
    return str(n) if n <= 4 else next((f"<={top}" for top in (6, 9, 12, 15, 19) if n <= top), "20+")


def token_features(word: str) -> tuple[str, ...]:
    """Features of a token alone."""
    d = digits_of(word)
    shape = SQUEEZE.sub(r"\1", word.translate(SHAPE))
    out = [f"shape={shape}", f"digits={bucket(len(d))}", f"first={shape[:1]}", "at" if "@" in word else "no-at"]
    if 13 <= len(d) <= 19:
        out.append("luhn" if luhn(d) else "no-luhn")
    if word.count(".") == 3 and shape == "d.d.d.d":
        out.append("octets" if octets(word.split(".")) else "no-octets")
    if "@" in word:
        out.append("mail" if re.fullmatch(r"[\w.%+-]+@[\w.-]+", word) else "no-mail")
    if not d.strip() or word[:1] == "@":
        out.append("handle")
    return tuple(out)


def features(text: str, run: tuple) -> Iterator[list[str]]:
    """Features of each token of a run."""
    before, spans = run
    words = [text[slice(*trimmed(text, a, b))] for a, b in spans]
    digits = [digits_of(w) for w in words]
    total = sum(map(len, digits))
    run_card = "run-luhn" if 13 <= total <= 19 and luhn("".join(digits)) else "run-other"
    cues = [f"cue={CUE_OF[w]}" for w in before if w in CUE_OF]
    last, mine = ("start",), token_features(words[0])
    for i in range(len(words)):
        following = token_features(words[i + 1]) if i + 1 < len(words) else ("end",)
        f = ["bias", *mine, f"run={bucket(total)}", run_card]
        f += [f"prev:{x}" for x in last[:2]]
        f += [f"next:{x}" for x in following[:2]]
        f += cues
        f.append(f"lone={len(words) == 1}")
        yield f
        last, mine = mine, following


@dataclass
class Model:
    index: dict[str, int]
    emit: np.ndarray  # feature, label
    move: np.ndarray  # label, label

    def emissions(self, found: Iterable[list[str]]) -> np.ndarray:
        return np.stack([self.emit[[self.index[f] for f in fs if f in self.index]].sum(0) for fs in found])


#: A B or O may follow anything, an I only its own kind.
ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
FIRST = np.array([not b.startswith("I-") for b in LABELS])
NO = -1e4


def viterbi(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best labels of each sequence; sequences of like length are decoded together."""
    out: list = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * len(scores[order[last]]) <= TOGETHER and last - first < 4096:
            last += 1
        part, first = order[first:last], last
        n = np.array([len(scores[i]) for i in part])
        padded = np.zeros((len(part), n.max(), len(LABELS)))
        for k, i in enumerate(part):
            padded[k, : n[k]] = scores[i]
        best = padded[:, 0] + np.where(FIRST, 0, NO)
        back = np.zeros(padded.shape, np.int8)
        allowed = np.where(ALLOWED, move, NO)
        final = np.where((n == 1)[:, None], best, 0)
        for t in range(1, padded.shape[1]):
            step = best[:, :, None] + allowed
            back[:, t] = step.argmax(1)
            best = step.max(1) + padded[:, t]
            final = np.where((n == t + 1)[:, None], best, final)
        label = final.argmax(1)
        labels = np.zeros((len(part), padded.shape[1]), np.int8)
        for t in range(padded.shape[1] - 1, -1, -1):
            inside = t < n
            labels[:, t] = np.where(inside, label, 0)
            label = np.where(inside, back[np.arange(len(part)), t, label], label) if t else label
        for k, i in enumerate(part):
            out[i] = labels[k, : n[k]]
    return out


def labelled(table: str = TABLE, draws: int = DRAWS, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with spans, drawn from the table."""
    rng = np.random.default_rng(seed)
    out = []
    for line in table.strip().split("\n"):
        for _ in range(draws):
            text, spans = "", []
            for piece in re.findall(r"\{[^}]*\}|[^{]+", line):
                kind, value = piece[1:-1].split(":", 1) if piece[0] == "{" else ("", piece)
                value = re.sub("#", lambda _: str(rng.integers(0, 10)), value)
                value = re.sub("%", lambda _: str(rng.integers(1, 255)), value) if "." in value and "%." in value else value
                for mark in "~!":
                    if mark in value:
                        good = next(d for d in "0123456789" if luhn(digits_of(value.replace(mark, d))))
                        value = value.replace(mark, good if mark == "~" else str((int(good) + 3) % 10))
                if kind:
                    spans.append((kind, len(text), len(text) + len(value)))
                text += value
            out.append((text, spans))
    return out


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS) -> Model:
    sequences, gold = [], []
    for text, spans in rows:
        for run in runs(text):
            tags, previous = [], None
            for a, b in run[1]:
                a, b = trimmed(text, a, b)
                hit = next((s for s in spans if a < s[2] and b > s[1]), None)
                tags.append("O" if hit is None else ("I-" if hit is previous else "B-") + hit[0])
                previous = hit
            sequences.append(list(features(text, run)))
            gold.append([LABELS.index(t) for t in tags])
    index = {f: i for i, f in enumerate(sorted({f for s in sequences for fs in s for f in fs}))}
    L, n, longest = len(LABELS), len(sequences), max(map(len, sequences))
    design = np.zeros((n, longest, len(index)), np.float32)
    target, live = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, s in enumerate(sequences):
        for t, fs in enumerate(s):
            design[i, t, [index[f] for f in fs]] = 1
        target[i, : len(s)], live[i, : len(s)] = gold[i], True
    flat = design.reshape(-1, len(index))
    emit, move = np.zeros((len(index), L)), np.zeros((L, L))
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    wanted = np.eye(L)[target] * live[:, :, None]
    wanted_move = np.zeros((L, L))
    for t in range(1, longest):
        np.add.at(wanted_move, (target[live[:, t], t - 1], target[live[:, t], t]), 1)
    for step in range(1, steps + 1):
        e = (flat @ emit).reshape(n, longest, L)
        allowed = np.where(ALLOWED, move, NO)
        alpha, beta = np.zeros((n, longest, L)), np.zeros((n, longest, L))
        alpha[:, 0] = e[:, 0] + np.where(FIRST, 0, NO)
        for t in range(1, longest):
            x = alpha[:, t - 1][:, :, None] + allowed
            alpha[:, t] = np.logaddexp.reduce(x, axis=1) + e[:, t]
        for t in range(longest - 2, -1, -1):
            x = allowed + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(live[:, t + 1][:, None], np.logaddexp.reduce(x, axis=2), 0)
        z = np.logaddexp.reduce(alpha[:, 0] + beta[:, 0], axis=1)
        node = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        got_move = np.zeros((L, L))
        for t in range(1, longest):
            x = alpha[:, t - 1][:, :, None] + allowed + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            got_move += (np.exp(x) * live[:, t][:, None, None]).sum(0)
        grads = [(flat.T @ (wanted - node).reshape(-1, L)) / n - 1e-3 * emit, (wanted_move - got_move) / n - 1e-3 * move]
        for k, (value, g) in enumerate(zip((emit, move), grads, strict=True)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(index, emit, np.where(ALLOWED, move, 0))


@functools.cache
def trained() -> Model:
    """The model of the table in this module; the same in every run."""
    return fit(labelled())


def valid(kind: str, value: str) -> bool:
    d = digits_of(value)
    if kind == "phone":
        return 8 <= len(d) <= 15
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "ip":
        return value.count(".") == 3 and all(p.isascii() and p.isdigit() for p in value.split(".")) and octets(value.split("."))
    return re.fullmatch(r"[\w.%+-]+@[\w.-]+", value) is not None


def model_spans(model: Model, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    out: list = [[] for _ in texts]
    where, scores, tokens = [], [], 0
    for i, text in enumerate(texts):
        for run in runs(text):
            where.append((i, run[1]))
            scores.append(model.emissions(features(text, run)))
            tokens += len(run[1])
        if len(scores) >= 20_000 or tokens >= TOGETHER or i == len(texts) - 1:
            for (k, spans), labels in zip(where, viterbi(scores, model.move), strict=True):
                kind, start, end = None, 0, 0
                for (a, b), label in [*zip(spans, [LABELS[x] for x in labels], strict=True), ((0, 0), "O")]:
                    if kind and not label.startswith("I-"):
                        s, e = trimmed(texts[k], start, end)
                        if valid(kind, texts[k][s:e]):
                            out[k].append((kind, s, e))
                        kind = None
                    if label.startswith("B-"):
                        kind, start = label[2:], a
                    end = b
            where, scores, tokens = [], [], 0
    return out


def all_spans(model: Model, texts: list[str]) -> list[tuple[list, list]]:
    """Base spans, and all spans: the base ones and those the model adds clear of them."""
    out = []
    for text, added in zip(texts, model_spans(model, texts), strict=True):
        base = base_spans(text)
        more = [m for m in added if all(m[2] <= b[1] or m[1] >= b[2] for b in base)]
        out.append((base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def text_of(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(spark, model: Model | None = None):
    """An Arrow function from a text to ``struct<base, spans>``, arrays of
    ``struct<kind, start, end>`` in code points, ends exclusive, by kind and start."""
    sent = spark.sparkContext.broadcast(model or trained())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(texts: pa.Array) -> pa.Array:
        found = all_spans(sent.value, texts.to_pylist())
        rows = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in part] for part in f] for f in found]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], span), pa.array([r[1] for r in rows], span)], names=["base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return per_text(run, f"struct<base:{kind},spans:{kind}>")


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``(id_col, base, spans)`` per row of ``docs``; null and empty texts have no spans.
    Repeated rows come back each."""
    found = docs.select(F.col(id_col).alias("id"), find(docs.sparkSession, model)(F.col(text_col)).alias("p"))
    return found.select(F.col("id").alias(id_col), "p.base", "p.spans")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become
    one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(spark, model: Model | None = None):
    """An Arrow function from a text to the text without personal data."""
    sent = spark.sparkContext.broadcast(model or trained())

    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        return pa.array([redacted(t, s[1]) if s[1] else t for t, s in zip(values, all_spans(sent.value, values), strict=True)], pa.string())

    return per_text(run, "string")
