import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hushframe.functions import rules as R
from hushframe.functions.spans import clear_of, coalesce, first_rule_wins, first_wins, scan, span, split_at_lines, trimmed
from hushframe.operators.chat import anonymize, joined, senders
from hushframe.operators.names import fakes
from hushframe.operators.redact import counts, parse_terms, redact, with_spans
from hushframe.operators.redact import masked as mask_with


def masked(spark, text, style="labels", **options):
    return redact(spark.createDataFrame([(text,)], "text string"), style, **options).first()["masked"]


TEXT = "Mail ann@example.com or call +44 20 7946 0958. Lives at 12 Baker Street, NW1 6XE, born 14 March 1987, SSN 078-05-1120, server 192.168.10.24."


def test_labels(spark):
    assert masked(spark, TEXT) == "Mail [EMAIL] or call [PHONE]. Lives at [ADDRESS], [ADDRESS], born [DATE], SSN [SSN], server [IP]."


def test_null_and_empty(spark):
    assert masked(spark, None) is None
    assert masked(spark, "") == ""


def test_numbers_follow_first_appearance_and_ignore_case(spark):
    assert masked(spark, "A@x.io b@x.io a@x.io", "numbered") == "[EMAIL_1] [EMAIL_2] [EMAIL_1]"


def test_blocks_are_three_at_least_and_count_code_points(spark):
    assert masked(spark, "😀 12:30 ab", "blocks", terms=["ab"]) == "😀 12:30 ███"


@pytest.mark.parametrize(
    "rule,good,bad",
    [
        ("card", "4111 1111 1111 1111", "4111 1111 1111 1112"),
        ("bsn", "BSN 111222333", "111222333"),
        ("dni", "12345678Z", "12345678A"),
        ("dni", "X1234567L", "X1234567M"),
        ("nir", "1 85 05 78 006 084 91", "1 85 05 78 006 084 36"),
        ("resident", "11010519491231002X", "110105194912310021"),
        ("my_number", "1234 5678 9018", "1234 5678 9012"),
        ("thai", "1-2345-67890-12-1", "1-2345-67890-12-3"),
        ("mac", "00:1A:2B:3C:4D:5E", "00:1A:2B:3C:4D:5E:6F"),
        ("ip", "10.0.0.255", "10.0.0.256"),
        ("iban", "GB29 NWBK 6016 1331 9268 19", "GB29 NWBK"),
        ("assigned", 'token = "abcd1234"', "token abcd"),
        ("phone", "(555) 123-4567", "12-34"),
        ("foreign_date", "14. März 2025", "14. Marsch 2025"),
        ("screen_date", "3 days ago", "3 dogs ago"),
        ("domain", "example.com/page", "example.zzz"),
    ],
)
def test_rules(spark, rule, good, bad):
    found = next(r for r in [*R.NATIONAL, *R.GENERAL, R.FOREIGN_DATES, R.SCREEN_DATE, R.DOMAIN] if r.name == rule)
    rows = spark.createDataFrame([(good,), (bad,)], "text string").select(F.size(found.spans(F.col("text"))).alias("n")).collect()
    assert [r["n"] for r in rows] == [1, 0]


def spans_of(spark, *rows):
    return spark.createDataFrame([(list(rows),)], "s array<struct<tag:string,start:int,end:int>>")


def test_first_wins_and_coalesce(spark):
    df = spans_of(spark, ("A", 0, 3), ("B", 2, 9), ("C", 3, 5), ("D", 4, 12))
    assert [tuple(s) for s in df.select(first_wins(F.col("s"))).first()[0]] == [("A", 0, 3), ("C", 3, 5)]
    assert [tuple(s) for s in df.select(coalesce(F.col("s"))).first()[0]] == [("B", 0, 12)]
    touching = spans_of(spark, ("A", 0, 3), ("B", 3, 5))
    assert [tuple(s) for s in touching.select(coalesce(F.col("s"))).first()[0]] == [("A", 0, 3), ("B", 3, 5)]


def test_split_at_lines(spark):
    df = spark.createDataFrame([("ab\n\ncd",)], "t string").select(split_at_lines(F.col("t"), F.array(span(F.lit("X"), F.lit(0), F.lit(6)))))
    assert [tuple(s) for s in df.first()[0]] == [("X", 0, 2), ("X", 4, 6)]


def test_disabled_category_still_shields(spark):
    df = spark.createDataFrame([("see https://x.io/2024-05-06/a",)], "text string")
    assert with_spans(df, enabled=["date"]).first()["spans"] == []


def test_model_spans_below_the_least_score_are_left_out(spark):
    df = spark.createDataFrame([("Ann met Bob", [("PERSON", 0, 3, 0.9), ("PERSON", 8, 11, 0.5)])], "text string, m array<struct<label:string,start:int,end:int,score:double>>")
    assert [tuple(s) for s in with_spans(df, model="m").first()["spans"]] == [("NAME", 0, 3)]


def test_terms():
    assert parse_terms(" a, b\n\nc ,") == ["a", "b", "c"]


def test_fake_names():
    assert fakes(["Sarah Smith", "sarah", "Sarah Jones", "Álex", "."]) == ["Alex", "Alex", "Alex", "Sam", "[NAME]"]


def test_chat(spark):
    text = "[12/03/2025, 14:05:12] Alex: Hi Sam, call +44 7700 900123\n[12/03/2025, 14:06:40] Sam: ok @Alex"
    out = anonymize(spark.createDataFrame([(text,), (None,), ("Note: x",)], "text string")).collect()
    assert out[0]["masked"] == "[12/03/2025, 14:05:12] Sam: Hi Jordan, call [PHONE_1]\n[12/03/2025, 14:06:40] Jordan: ok @Sam"
    assert out[1]["masked"] is None and out[2]["masked"] == "Note: x"


def test_long_texts(spark):
    n = 100_000
    texts = ["a." * n, "a" * n, "@" * n, "a@" * n, "1" * n, "1 " * n, "-----BEGIN PRIVATE KEY-----" * (n // 20), "a-" * n, "a:" * n, "+1(2) " * (n // 3), "Jan " * (n // 2)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    rules = [*R.NATIONAL, *R.GENERAL, R.FOREIGN_DATES, R.DOMAIN, R.HANDLE, R.SCREEN_DATE, R.MENTION, *R.SECRETS]
    began = time.time()
    assert rows.select(F.size(F.flatten(R.detect(F.col("text"), rules)))).count() == len(texts)
    assert rows.select(F.size(F.flatten(R.detect(F.col("text"), rules))).alias("n")).agg(F.sum("n")).first()[0] is not None
    assert time.time() - began < 100  # quadratic ones take hours, and recursion ends the JVM


def test_emails_begin_where_a_word_does(spark):
    texts = [".a@b.co", "a@b.co.c@d.org", "é.x@y.zz", "x@y", "a.b@c.de,f@g.hi", "%%a@b.com", "a@b@c.org", "_@b.co", "-@b.co"]
    rule = next(r for r in R.GENERAL if r.name == "email")
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", "text", rule.spans(F.col("text")).alias("s")).orderBy("i").collect()
    plain = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", re.ASCII)
    assert [[r["text"][s["start"] : s["end"]] for s in r["s"]] for r in found] == [plain.findall(t) for t in texts]


def test_hints_hold_where_patterns_match(spark):
    rng = random.Random(3)
    parts = ["12345678Z", "sk-abcdefghijklmnopqrst", "pass: abcdef", "a@b.co", "https://x.io/a", "GB29NWBK60161331926819", "4111 1111 1111 1111", "078-05-1120", "AB 12 34 56 C", "a:b:c:d:e:f:a:b", "aa:bb:cc:dd:ee:ff", "aaaa.bbbb.cccc", "2024-01-02", "+44 20 7946 0958", "NW1 6XE", "12 Baker Street", "Lunes", "MIÉRCOLES", "Aujourd’hui", "vor 3 Tagen", "星期一", "昨天", "วันนี้", " ", "\n", "é", "-"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for rule in [*R.NATIONAL, *R.GENERAL, R.FOREIGN_DATES, *R.SECRETS]:
        missed = rows.where(F.rlike("text", F.lit(rule.pattern)) & ~rule.likely(F.col("text")))
        assert missed.isEmpty(), rule.name
    each = rows.select(R.detect(F.col("text"), R.GENERAL).alias("a"), F.filter(F.array(*[r.spans(F.col("text")) for r in R.GENERAL]), lambda s: F.size(s) > 0).alias("b"))
    assert each.where(F.filter("a", lambda s: F.size(s) > 0) != F.col("b")).isEmpty()


def test_the_sweep_takes_what_first_wins_takes(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        rules = []
        for _ in range(rng.randint(0, 4)):
            at, spans = 0, []
            for _ in range(rng.randint(0, 5)):
                at += rng.randint(0, 4)
                spans.append((rng.choice("AB"), at, at := at + rng.randint(1, 4)))
            rules.append(spans)
        rows.append((rules,))
    df = spark.createDataFrame(rows, "r array<array<struct<tag:string,start:int,end:int>>>")
    both = df.select(F.array_sort(first_rule_wins(F.col("r"))).alias("a"), F.array_sort(first_wins(F.flatten("r"))).alias("b"))
    assert both.where("a <> b").isEmpty()


def test_names_found_by_sweep():
    assert joined([(5, 9), (20, 24)], [(0, 5), (4, 6), (8, 10), (9, 20), (23, 30)]) == [(0, 5), (5, 9), (9, 20), (20, 24)]


def test_styles_kept_and_counts(spark):
    df = spark.createDataFrame([("a@b.co, c@d.co", ["0:6"], "x", 1)], "text string, kept array<string>, __values string, __n int")
    with_all = with_spans(df)
    assert with_all.columns == [*df.columns, "spans"]
    for style, want in [("redacted", "a@b.co, [REDACTED]"), ("numbered", "a@b.co, [EMAIL_2]"), ("labels", "a@b.co, [EMAIL]"), ("blocks", "a@b.co, ██████")]:
        out = mask_with(with_all, style, kept="kept")
        assert out.columns == [*with_all.columns, "masked"] and out.first()["masked"] == want
    assert [tuple(r) for r in counts(with_all, by=["__n"]).collect()] == [(1, "EMAIL", 2)]


def test_trim(spark):
    text = "  ab.) ,"
    df = spark.createDataFrame([(text,)], "t string").select(trimmed(F.col("t"), F.array(span(F.lit("X"), F.lit(0), F.lit(len(text))), span(F.lit("Y"), F.lit(4), F.lit(8)))))
    assert [tuple(s) for s in df.first()[0]] == [("X", 2, 4)]


@pytest.mark.parametrize("text", ["19 de marzo de 2024", "hace 3 días", "lunes", "1er janvier 2024", "il y a 2 heures", "14h30", "3. März 2024", "vor 2 Tagen", "12 Uhr", "3 maart 2024", "2 dagen geleden", "gisteren", "2024年3月4日", "星期三", "金曜日", "上午 9:30", "3小时前", "วันที่ 3 มกราคม 2567", "เมื่อวาน", "9 โมงเช้า"])
def test_foreign_dates(spark, text):
    found = spark.createDataFrame([(f"x {text}.",)], "t string").select(R.FOREIGN_DATES.spans(F.col("t"))).first()[0]
    assert [(s["start"], s["end"]) for s in found] == [(2, 2 + len(text))]


@pytest.mark.parametrize("line", ["[12/03/2025, 14:05] Ann Lee: hi", "12/03/2025, 14:05 - Ann Lee: hi", "[14:05] Ann Lee", "Ann Lee  14:05", "Ann Lee — Today at 14:05"])
def test_chat_formats(spark, line):
    text = f"{line}\nhello Ann"
    assert spark.createDataFrame([(text,)], "t string").select(senders(F.col("t"))).first()[0] == ["Ann Lee"]


def test_texts_of_many_matches(spark):
    """20,000 addresses, each twice, in every style; what a text holds and where takes no time that
    grows faster than it."""
    words = [f"u{i // 2}@site{i % 97}.org" for i in range(40_000)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    names = [w.lower() for w in dict.fromkeys(words)]
    number = {w: i + 1 for i, w in enumerate(names)}
    for style in ("labels", "numbered", "fake"):
        new = "[EMAIL]" if style == "labels" else "[EMAIL_{}]"
        assert redact(df, style).first()["masked"] == " ".join(new.format(number[w]) for w in words)


def test_spans_clear_of_others(spark):
    kind = "spans array<struct<tag:string,start:int,end:int>>, others array<struct<tag:string,start:int,end:int>>"
    rows = [([("A", 8, 9), ("A", 0, 3), ("A", 3, 5), ("A", 20, 30)], [("B", 4, 7), ("B", 2, 2), ("B", 1, 9)]), ([("A", 5, 6)], []), ([], [("B", 0, 1)]), (None, [("B", 0, 1)]), ([("A", 0, 4), ("A", 6, 9)], [("B", 4, 6)])]
    got = [r[0] and [tuple(s) for s in r[0]] for r in spark.createDataFrame(rows, kind).select(clear_of(F.col("spans"), F.col("others"))).collect()]
    assert got == [[("A", 20, 30)], [("A", 5, 6)], [], None, [("A", 0, 4), ("A", 6, 9)]]


def test_columns_named_like_our_own(spark):
    df = spark.createDataFrame([("Ann Lee: hi\nBob Roe: hi Ann", 1, 2, 3, 4)], "text string, __names int, __named int, __chat int, __spans int")
    got = anonymize(df).first()
    assert got[1:5] == (1, 2, 3, 4) and "Ann" not in got["masked"]


NAMES = re.compile(r"(?i)(?<![A-Za-z0-9_@.-])(?:[a-z0-9-]+\.)+(?:" + R.DOMAINS + r")(?:/[^\s]*)?(?![A-Za-z0-9_])")
HOSTS = re.compile(r"(?i)(?<![A-Za-z0-9_.-])(?:[a-z0-9-]+\.)+(?:internal|local|corp|lan)(?![A-Za-z0-9_])")


def test_names_of_any_number_of_labels(spark):
    """Equal to a plain pattern that goes back over all labels, on texts of odd labels, and whole for
    names of many."""
    rng = random.Random(11)
    parts = ["a", "com", ".", ".", ".", "co", "-", "com-", "io", "..", "@", "_", "/", " ", "local", "lan", "Internal", "é", "7", "corp."]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    rules = {"domain": R.DOMAIN, "host": next(r for r in R.SECRETS if r.name == "host")}
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *[r.spans(F.col("text")).alias(n) for n, r in rules.items()])
    for r in df.collect():
        for name, plain in (("domain", NAMES), ("host", HOSTS)):
            assert [(s["start"], s["end"]) for s in r[name]] == [m.span() for m in plain.finditer(r["text"])], (name, r["text"])
    for n in (300, 50_000):
        for name, last in (("domain", "com"), ("host", "corp")):
            text = "x " + "ab." * n + last + ".zz y " + f"q.{last}." * n
            [found] = spark.createDataFrame([(text,)], "text string").select(rules[name].spans(F.col("text"))).first()
            ends = [(2, 2 + 3 * n + len(last)), (8 + 3 * n + len(last), len(text) - 1)]
            assert [(s["start"], s["end"]) for s in found] == ends


def test_a_pattern_goes_through_a_text_once_to_find_its_matches(spark):
    """Once for the matches and once for what lies between them; not again to see whether there are any."""
    told = str(scan(F.col("t"), "a+", "X"))
    assert told.count("regexp_extract_all(") == 1 and told.lower().count("rlike(") == 0


def test_addresses_ask_once_where_a_word_begins():
    """And only where what may begin one stands."""
    rule = next(r for r in R.GENERAL if r.name == "ip")
    assert rule.pattern.count(R.W0) == 1
    found = re.findall(rule.pattern, "10.0.0.255 x10.0.0.1 10.0.0.256 fe80:0:0:0:1:2:3:aB 1:2:3:4:5:6:7 add.a:b 1.2.3.4.5")
    assert found == ["10.0.0.255", "fe80:0:0:0:1:2:3:aB", "1.2.3.4"]


def test_screen_dates_ask_once_where_a_word_begins(spark):
    """And only where what may begin one stands; a time before am or pm may begin inside of a word."""
    assert R.SCREEN_DATE.pattern.count(R.W0) == 1
    text = "Mon, Jan 3rd x12:30 pm 7 MINS ago onehour ago an hour ago ytoday today 5 pm 12.30"
    spans = spark.createDataFrame([(text,)], "text string").select(R.SCREEN_DATE.spans(F.col("text")).alias("s")).first()["s"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["Mon, Jan 3rd", "12:30 pm", "7 MINS ago", "an hour ago", "today", "5 pm", "12.30"]
