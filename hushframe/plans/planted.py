"""Rules over values that Spark makes from the documents' ids, as the given texts hold few of them.

``planted_`` queries: each rule sees ``x <value> y``. Numbers get whatever check digits the ids
give them, so most of them are wrong; the SQL tells by arithmetic which are right.

``forms_`` queries: the forms of a rule in turn, and near misses of them, each behind the words of
the whole document (their letters other than vowels, so that no rule finds anything there)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..session import table

RULES = {r.name: r for r in [*R.NATIONAL, *R.GENERAL, R.FOREIGN_DATES, R.DOMAIN, R.HANDLE, R.SCREEN_DATE, R.MENTION, *R.SECRETS]}
#: Letters of DNI numbers and of the last place of residents' numbers.
DNI, RESIDENT = "TRWAGMYFPDXBNJZSQVHLCKE", "10X98765432"


def digit_sum(weights: list[int], first: int = 1) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr(v, {i}, 1) AS INTEGER)" for i, w in enumerate(weights, first)) + ")"


#: Query: rule, format of the value, its numbers (SQL over ``doc_id``), characters before the
#: value that the rule leaves out, and the condition on the value ``v``.
PLANTED = {
    "key": ("key", "sk_live_%08d0a", ["doc_id * 7919 % 100000000"], 0, "true"),
    "assigned": ("assigned", "token: a%06d", ["doc_id % 1000000"], 7, "true"),
    "url": ("url", "https://h%d.example/p/%d", ["doc_id % 100", "doc_id"], 0, "true"),
    "iban": ("iban", "GB%02d ABCD %04d %04d %04d", ["doc_id % 100", "doc_id % 9973", "doc_id * 3 % 9973", "doc_id * 7 % 9973"], 0, "true"),
    "ssn": ("ssn", "%03d-%02d-%04d", ["doc_id % 900", "doc_id % 100", "doc_id % 9973"], 0, "true"),
    "nino": ("nino", "AB %02d %02d %02d C", ["doc_id % 100", "doc_id * 3 % 100", "doc_id * 7 % 100"], 0, "true"),
    "mac": ("mac", "%02x:%02x:0a:1b:2c:%02x", ["doc_id % 256", "doc_id * 3 % 256", "doc_id * 7 % 256"], 0, "true"),
    "phone": ("phone", "+44 20 %04d %04d", ["doc_id % 9973", "doc_id * 3 % 9973"], 0, "true"),
    "postcode": ("postcode", "NW%d %dAB", ["doc_id % 10", "doc_id * 3 % 10"], 0, "true"),
    "street": ("street", "%d Baker Street", ["doc_id % 999 + 1"], 0, "true"),
    "bsn": ("bsn", "BSN %09d", ["doc_id * 7919001 % 1000000000"], 4, f"{digit_sum([9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0"),
    "dni": ("dni", "%08d%s", ["doc_id * 79190 % 100000000", f"substr('{DNI}', CAST((doc_id + doc_id % 2) % 23 + 1 AS INTEGER), 1)"], 0, f"substr('{DNI}', CAST(substr(v, 1, 8) AS INTEGER) % 23 + 1, 1) = substr(v, 9, 1)"),
    "nir": ("nir", "1%012d%02d", ["doc_id * 79190017 % 1000000000000", "doc_id % 97 + 1"], 0, "97 - CAST(substr(v, 1, 13) AS BIGINT) % 97 = CAST(substr(v, 14, 2) AS INTEGER)"),
    "resident": ("resident", "%017d%s", ["doc_id * 79190017331 % 100000000000000000", f"substr('{RESIDENT}', CAST(doc_id % 11 + 1 AS INTEGER), 1)"], 0, f"substr('{RESIDENT}', {digit_sum([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])} % 11 + 1, 1) = substr(v, 18, 1)"),
    "my_number": ("my_number", "%012d", ["doc_id * 79190017 % 1000000000000"], 0, f"CASE WHEN {digit_sum([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 <= 1 THEN 0 ELSE 11 - {digit_sum([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 END = CAST(substr(v, 12, 1) AS INTEGER)"),
    "thai": ("thai", "%013d", ["doc_id * 791900173 % 10000000000000"], 0, f"(11 - {digit_sum(list(range(13, 1, -1)))} % 11) % 10 = CAST(substr(v, 13, 1) AS INTEGER)"),
    "date_es": ("foreign_date", "%d de marzo de %04d", ["doc_id % 28 + 1", "1990 + doc_id % 40"], 0, "true"),
    "date_fr": ("foreign_date", "%d mars %04d", ["doc_id % 28 + 1", "1990 + doc_id % 40"], 0, "true"),
    "date_de": ("foreign_date", "%d. März %04d", ["doc_id % 28 + 1", "1990 + doc_id % 40"], 0, "true"),
    "date_nl": ("foreign_date", "%d maart %04d", ["doc_id % 28 + 1", "1990 + doc_id % 40"], 0, "true"),
    "date_zh": ("foreign_date", "%04d年%d月%d日", ["1990 + doc_id % 40", "doc_id % 12 + 1", "doc_id % 28 + 1"], 0, "true"),
    "date_th": ("foreign_date", "วันที่ %d มกราคม %04d", ["doc_id % 28 + 1", "2530 + doc_id % 40"], 0, "true"),
    "domain": ("domain", "h%d.example.com/p%d", ["doc_id % 1000", "doc_id"], 0, "true"),
    "handle": ("handle", "@user%dx", ["doc_id"], 1, "true"),
    "mention": ("mention", "@Ann.%dx", ["doc_id"], 1, "true"),
    "screen_date": ("screen_date", "%d hours ago", ["doc_id % 48 + 1"], 0, "true"),
    "private_key": ("private_key", "-----BEGIN PRIVATE KEY-----\n%d\n-----END PRIVATE KEY-----", ["doc_id"], 0, "true"),
    "connection": ("connection", "postgres://u:%d@db/x", ["doc_id"], 0, "true"),
    "password": ("password", "pass=pw%04d", ["doc_id % 9973"], 5, "true"),
    "host": ("host", "db%d.corp.internal", ["doc_id"], 0, "true"),
}


def planted_query(name: str, rule: str, form: str, numbers: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = table(spark, sf_dir, "documents").select("doc_id")
        text = F.concat(F.lit("x "), F.format_string(form, *[F.expr(n) for n in numbers]), F.lit(" y"))
        found = ids.select("doc_id", text.alias("text")).withColumn("s", F.explode(RULES[rule].spans(F.col("text"))))
        place = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
        return found.select("doc_id", F.col("s.tag").alias("tag"), F.col("s.start").cast("long").alias("start"), place.alias("value"))

    run.__name__ = f"planted_{name}"
    return run


def planted_sql(rule: str, form: str, numbers: list[str], before: int, condition: str) -> str:
    value = f"substr(printf('{form}', {', '.join(numbers)}), {before + 1})"
    return f"SELECT doc_id, '{RULES[rule].tag}' AS tag, CAST({before + 2} AS BIGINT) AS start, v AS value FROM (SELECT doc_id, {value} AS v FROM documents) WHERE {condition}"


#: Eight and two digits of a document.
D8, D2 = "lpad(CAST(doc_id * 7919 % 100000000 AS STRING), 8, '0')", "lpad(CAST(doc_id % 90 + 10 AS STRING), 2, '0')"


def joint(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


#: Query: its rule, and texts (SQL) with what the rule finds in them: a whole text, the SQL of a
#: part and the characters before it, or nothing.
WHOLE = (0, None)
FORMS = {
    "key": ("key", {
        joint("'sk_live_'", D8): WHOLE,
        joint("'pk-test-'", D8): WHOLE,
        joint("'rk_live_'", f"substr({D8}, 1, 7)"): None,
        joint("'sk-'", D8, D8): WHOLE,
        joint("'sk-'", D8, "'1234567'"): None,
        joint("'AKIA'", D8, D8): WHOLE,
        joint("'AKIA'", D8, D8, "'1'"): None,
        joint("'ghp_'", D8, D8, D8, "'abcdef'"): WHOLE,
        joint("'gho_'", D8, D8, D8, "'abcde'"): None,
        joint("'github_pat_'", D8, D8, D8, "'abc_ef'"): WHOLE,
        joint("'github_pat_'", D8, D8, D8, "'abc_e'"): None,
        joint("'xoxb-'", D8, "'-1'"): WHOLE,
        joint("'xoxc-'", D8, "'-1'"): None,
        joint("'AIza'", D8, D8, D8, D8, "'a_c'"): WHOLE,
        joint("'AIza'", D8, D8, D8, D8, "'a_cd'"): None,
        joint("'eyJ'", D8, "'.eyJ'", D8, "'.'", D8): WHOLE,
        joint("'eyJ'", D8, "'.eyJ'", D8, "'.1234567'"): None,
    }),
    "assigned": ("assigned", {
        joint("'password = '", D8): (11, D8),
        joint("'API-key: \"'", D8, "'\"'"): (10, D8),
        joint("'access_key='", D8): (11, D8),
        "'pass: abc'": None,
        joint("'passing: '", D8): None,
        joint("'token '", D8): None,
    }),
    "url": ("url", {
        joint("'https://h.example/'", D8): WHOLE,
        joint("'http://h.example/'", D8, "').'"): (0, joint("'http://h.example/'", D8)),
        joint("'xhttp://h.example/'", D8): None,
        "'https://'": None,
    }),
    "iban": ("iban", {
        joint("'GB'", D2, "' ABCD '", f"substr({D8}, 1, 4)", "' '", f"substr({D8}, 5, 4)"): WHOLE,
        joint("'NL'", D2, "'ABCD'", D8, "'12'"): WHOLE,
        joint("'gb'", D2, "'ABCD'", D8): None,
        joint("'GB'", D2, "' ABCD EFGH'"): None,
        joint("'GB'", D2, "' '", f"substr({D8}, 1, 4)"): None,
    }),
    "ssn": ("ssn", {
        joint(f"substr({D8}, 1, 3)", "'-'", D2, "'-'", f"substr({D8}, 5, 4)"): WHOLE,
        joint(f"substr({D8}, 1, 4)", "'-'", D2, "'-'", f"substr({D8}, 5, 4)"): None,
        joint(f"substr({D8}, 1, 3)", "'-'", D2, "'1-'", f"substr({D8}, 5, 4)"): None,
    }),
    "nino": ("nino", {
        joint("'AB '", D2, "' 34 56 C'"): WHOLE,
        joint("'AB'", D2, "'3456C'"): WHOLE,
        joint("'DB '", D2, "' 34 56 C'"): None,
        joint("'AB '", D2, "' 34 56 E'"): None,
    }),
    "ip": ("ip", {
        joint("'10.'", D2, "'.255.1'"): WHOLE,
        joint("'2001:db8:0:1:2:3:4:'", D2): WHOLE,
        joint("'10.'", D2, "'.256.1'"): None,
        joint("'10.'", D2, "'.255'"): None,
        joint("'2001:db8:0:1:2:3:'", D2): None,
    }),
    "mac": ("mac", {
        joint(D2, "':0a:1B:2c:3d:'", D2): WHOLE,
        joint(D2, "'-0a-1b-2c-3d-'", D2): WHOLE,
        joint("'0a'", D2, "'.1b2c.3d'", D2): WHOLE,
        joint(D2, "':0a-1b:2c:3d:'", D2): None,
        joint(D2, "':0a:1b:2c:3d:4e:'", D2): None,
        joint("'0a'", D2, "'.1b2c.3d4e.5f'", D2): None,
    }),
    "phone": ("phone", {
        joint("'+44 20 1234 '", f"substr({D8}, 1, 4)"): WHOLE,
        joint("'020 7946 '", f"substr({D8}, 1, 4)"): WHOLE,
        joint("'(020) 7946-'", f"substr({D8}, 1, 4)"): WHOLE,
        joint("'12 34 '", D2): None,
        D8: None,
    }),
    "postcode": ("postcode", {
        joint("'NW'", f"substr({D2}, 1, 1)", "' 2AB'"): WHOLE,
        joint("'W'", f"substr({D2}, 1, 1)", "'A2AB'"): WHOLE,
        joint("'nw'", f"substr({D2}, 1, 1)", "' 2ab'"): None,
        joint("'NWW'", f"substr({D2}, 1, 1)", "' 2AB'"): None,
    }),
    "street": ("street", {
        joint(D2, "' Baker Street'"): WHOLE,
        joint(D2, "'B, Old Kent Rd'"): WHOLE,
        joint(D2, "' baker Street'"): None,
        joint(D2, "'3456 Baker Street'"): None,
        joint(D2, "' Baker Streets'"): None,
    }),
    "screen_date": ("screen_date", {
        joint("'Mon, Jan '", D2, "'th, 2024'"): WHOLE,
        joint("'Sept. '", D2, "', 2024'"): WHOLE,
        joint(D2, "'th March 2024'"): WHOLE,
        joint(D2, "':30:15 p.m.'"): WHOLE,
        joint(D2, "' am'"): WHOLE,
        joint(D2, "'30PM'"): WHOLE,
        "'Tuesday'": WHOLE,
        "'yesterday'": WHOLE,
        joint(D2, "' mins ago'"): WHOLE,
        "'an hour ago'": WHOLE,
        joint("'Jann '", D2): None,
        joint(D2, "' minz ago'"): None,
        "'yesterdays'": None,
        joint("'x'", D2, "':30'"): None,
    }),
    "dates": ("foreign_date", {
        joint("'lunes, '", D2, "' de marzo de 2001'"): WHOLE,
        joint("'hace '", D2, "' días'"): WHOLE,
        "'anteayer'": WHOLE,
        joint("'lundi '", D2, "' août 2001'"): WHOLE,
        joint("'il y a '", D2, "' jours'"): WHOLE,
        "'aujourd’hui'": WHOLE,
        joint(D2, "'h30'"): WHOLE,
        joint("'Montag, '", D2, "'. März 2001'"): WHOLE,
        joint("'vor '", D2, "' Tagen'"): WHOLE,
        "'vorgestern'": WHOLE,
        joint(D2, "'.30 Uhr'"): WHOLE,
        joint("'maandag '", D2, "' maart 2001'"): WHOLE,
        joint(D2, "' dagen geleden'"): WHOLE,
        "'eergisteren'": WHOLE,
        joint(D2, "':30 uur'"): WHOLE,
        joint("'2001年5月'", D2, "'日'"): WHOLE,
        "'2001年5月'": WHOLE,
        "'星期一'": WHOLE,
        "'月曜日'": WHOLE,
        "'昨天'": WHOLE,
        "'下午3:15'": WHOLE,
        joint(D2, "'点半'"): WHOLE,
        joint(D2, "'分钟前'"): WHOLE,
        joint("'วันที่ '", D2, "' มกราคม 2544'"): WHOLE,
        "'วันจันทร์'": WHOLE,
        joint(D2, "' โมงเช้า'"): WHOLE,
        joint(D2, "':30 น.'"): WHOLE,
        joint(D2, "' de marza'"): None,
        joint("'hace '", D2, "' diaz'"): None,
        "'hiers'": None,
        joint("'il y a '", D2, "' jourz'"): None,
        joint(D2, "' März'"): None,
        joint("'vor '", D2, "' Tagex'"): None,
        joint(D2, "' dagen'"): None,
        joint(D2, "'月'"): None,
        "'星期八'": None,
        joint(D2, "'前'"): None,
        joint(D2, "' มกรา'"): None,
    }),
}


def told(values: list[str]) -> str:
    """SQL that gives the documents the values in turn; no value is null."""
    return f"CASE doc_id % {len(values)} {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(values) if v)} END"


def forms_query(name: str, rule: str, forms: dict[str, tuple[int, str | None] | None]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        words = F.regexp_replace(F.coalesce("text", F.lit("")), "[^b-df-hj-np-tv-xz]+", " ")
        found = docs.select("doc_id", F.concat(words, F.lit(" "), F.expr(told(list(forms))), F.lit(" y")).alias("text"))
        found = found.select("doc_id", "text", F.explode(RULES[rule].spans(F.col("text"))).alias("s"))
        place = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
        return found.select("doc_id", F.col("s.tag").alias("tag"), F.col("s.start").cast("long").alias("start"), place.alias("value"))

    run.__name__ = f"forms_{name}"
    return run


def forms_sql(rule: str, forms: dict[str, tuple[int, str | None] | None]) -> str:
    values, before = ([f(form, found) if found else "" for form, found in forms.items()] for f in (lambda form, found: found[1] or form, lambda form, found: str(found[0])))
    words = "regexp_replace(coalesce(text, ''), '[^b-df-hj-np-tv-xz]+', ' ', 'g')"
    return f"SELECT * FROM (SELECT doc_id, '{RULES[rule].tag}' AS tag, CAST(length({words}) + 1 + ({told(before)}) AS BIGINT) AS start, {told(values)} AS value FROM documents) WHERE value IS NOT NULL"


QUERIES = {f"planted_{n}": planted_query(n, *p[:3]) for n, p in PLANTED.items()} | {f"forms_{n}": forms_query(n, *f) for n, f in FORMS.items()}
SQL = {f"planted_{n}": planted_sql(*p) for n, p in PLANTED.items()} | {f"forms_{n}": forms_sql(*f) for n, f in FORMS.items()}
