"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans, checksum validators confirm them (Luhn for cards, mod 97 for
IBANs, value ranges for addresses), and words just before a span adjust its score.

Positions come without Python: a text split at a pattern gives the gaps between its matches, so
running sums of gap and match lengths are the spans, in code points.

Every pattern below is a sequence of single-class loops. Java's matcher recurses on repeated groups
and rescans on unanchored prefixes, so a megabyte of digits or letters without a break would
overflow the stack or take quadratic time. Two devices avoid both and keep the matches as they are:
look-behinds let a match begin only where a run begins (or where the last match ended), and
separators that touch another separator are overwritten, one code point for one, before matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm.store import read_table

#: Order of kinds where spans begin together.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z0-9-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9 -]{12,}[0-9]"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9_])"
_SSN = r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"

#: Words that make a kind likelier when they stand just before a span.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address",
    "card": "card|visa|master|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social security|tax id",
}
#: Score of a span that only matches, and what a checksum or context adds.
BASE_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.3, "ssn": 0.3}
CHECKSUM_BONUS, CONTEXT_BONUS = 0.5, 0.2
CONTEXT_WIDTH = 40


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, body, before>> of the pattern's matches; end exclusive.

    ``before`` is the part of the gap before the match that context is looked for in.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(
        found,
        F.slice(gaps, F.lit(1), F.size(found)),
        lambda m, g: F.struct(
            F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("body"), F.right(g, F.lit(CONTEXT_WIDTH)).alias("before")
        ),
    )
    zero = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int,body:string,before:string>>").alias("out"),
    )
    return F.aggregate(
        pairs,
        zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + x["gap"]).alias("start"),
                        (acc["at"] + x["gap"] + x["len"]).alias("end"),
                        x["body"].alias("body"),
                        x["before"].alias("before"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn_ok(body: Column) -> Column:
    """True where the digits of a text pass the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(_digits(body)), ""),
        lambda d, i: d.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (d.cast("int") > 4), F.lit(9)).otherwise(F.lit(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def iban_ok(body: Column) -> Column:
    """True where a text passes the mod-97 check: the first four places last, letters as 10 to 35."""
    moved = F.concat(F.substring(body, 5, 64), F.substring(body, 1, 4))
    return (
        F.aggregate(
            F.split(moved, ""),
            F.lit(0),
            lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97)
            .when(c.between("A", "Z"), (a * 100 + F.ascii(c) - 55) % 97)
            .otherwise(a),
        )
        == 1
    )


def _parts_ok(body: Column) -> Column:
    parts = F.transform(F.split(body, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _kind(kind: str, spans: Column, confirmed, required: bool) -> Column:
    """Spans of a kind with scores; ``confirmed`` maps a body to true where its validator passes."""
    checked = F.filter(spans, lambda s: confirmed(s["body"])) if required else spans
    near = lambda s: F.lower(s["before"]).rlike(f"(^|[^a-z0-9])({CONTEXT[kind]})")
    bonus = CHECKSUM_BONUS if required and kind != "ip" else 0.0
    return F.transform(
        checked,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.round(F.lit(BASE_SCORE[kind] + bonus) + F.when(near(s), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)), 2).alias("score"),
        ),
    )


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii``: array<struct<start, rank, end, kind, score>>, by start and then kind.

    Base kinds are email, ip (parts at most 255), card (14 to 19 digits passing Luhn) and phone
    (10 to 15 digits); a match that fails its validator is dropped and not retried. Added kinds are
    iban (mod 97) and ssn (kept only where a context word stands before it). Null and empty texts
    have no spans. Other columns stay; one named ``pii`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,body:string,before:string>>")
    dots = F.regexp_replace(whole, r"(?<=\.)\.|\.(?=\.)", "_")
    seps = F.regexp_replace(whole, r"(?<=[ -])[ -]|[ -](?=[ -])", "x")
    digit = whole.rlike("[0-9]")
    n_digits = lambda b: F.length(_digits(b))
    kinds = [
        _kind("email", F.when(F.contains(whole, F.lit("@")), _matches(dots, _EMAIL)).otherwise(none), None, False),
        _kind("ip", F.when(whole.rlike(r"[0-9]\.[0-9]"), _matches(whole, _IP)).otherwise(none), _parts_ok, True),
        _kind("card", F.when(digit, _matches(seps, _CARD)).otherwise(none), lambda b: n_digits(b).between(14, 19) & luhn_ok(b), True),
        _kind("phone", F.when(whole.rlike(r"\+[0-9]"), _matches(whole, _PHONE)).otherwise(none), lambda b: n_digits(b).between(10, 15), True),
        _kind("iban", F.when(whole.rlike("[A-Z]{2}[0-9]{2}"), _matches(whole, _IBAN)).otherwise(none), iban_ok, True),
        F.filter(
            _kind("ssn", F.when(whole.rlike("[0-9]{3}-[0-9]{2}-"), _matches(whole, _SSN)).otherwise(none), None, False),
            lambda s: s["score"] > BASE_SCORE["ssn"],
        ),
    ]
    return docs.withColumn("pii", F.array_sort(F.concat(*kinds)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _sql_spans(kind: str, pattern: str, valid: str = "true") -> str:
    """DuckDB list of {start, rank, end, kind, score} of one kind; positions as sums over gaps and matches."""
    rank, bonus = KINDS.index(kind), CHECKSUM_BONUS if kind in ("card", "phone", "iban") else 0.0
    return f"""list_filter(list_transform(range(1, len(m_{kind}) + 1), lambda i: {{
        's': coalesce(list_sum(list_transform(g_{kind}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m_{kind}[1:i-1], lambda x: length(x))), 0),
        'r': {rank}, 'n': length(m_{kind}[i]), 'k': '{kind}', 'body': m_{kind}[i],
        'score': round({BASE_SCORE[kind] + bonus} + CASE WHEN regexp_matches(lower(right(g_{kind}[i], {CONTEXT_WIDTH})), '(^|[^a-z0-9])({CONTEXT[kind]})') THEN {CONTEXT_BONUS} ELSE 0.0 END, 2)
      }}), lambda s: {valid})"""


_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_SQL_DIGITS = "regexp_replace(s.body, '[^0-9]', '', 'g')"
_SQL_VALID = {
    "ip": "list_bool_and(list_transform(string_split(s.body, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255))",
    "card": f"length({_SQL_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_SQL_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN ({_SQL_DIGITS})[-j]::INT WHEN ({_SQL_DIGITS})[-j]::INT > 4 THEN ({_SQL_DIGITS})[-j]::INT * 2 - 9 ELSE ({_SQL_DIGITS})[-j]::INT * 2 END)) % 10 = 0",
    "phone": f"length({_SQL_DIGITS}) BETWEEN 10 AND 15",
    "iban": "list_reduce(list_prepend(0, list_transform(string_split(s.body[5:] || s.body[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), lambda a, d: CASE WHEN d > 9 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END) = 1",
    "ssn": f"s.score > {BASE_SCORE['ssn']}",
}
_SQL_JOINED = "array_to_string(list_transform({}, lambda s: s.k || ':' || s.s || ':' || (s.s + s.n)), ',')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, {", ".join(f"regexp_extract_all(text, '{p}') AS m_{k}, string_split_regex(text, '{p}') AS g_{k}" for k, p in _SQL_PATTERNS.items())} FROM d),
s AS (SELECT doc_id, list_sort(flatten([{", ".join(_sql_spans(k, p, _SQL_VALID.get(k, "true")) for k, p in _SQL_PATTERNS.items())}])) AS spans FROM m)
SELECT doc_id, {", ".join(f"len(list_filter(spans, lambda s: s.k = '{k}'))::BIGINT AS n_{k}" for k in BASE_KINDS)},
  sha256({_SQL_JOINED.format(f"list_filter(spans, lambda s: s.r < {len(BASE_KINDS)})")}) AS base_sha256,
  {_SQL_JOINED.format("spans")} AS spans,
  array_to_string(list_transform(spans, lambda s: s.score::VARCHAR), ',') AS scores
FROM s
"""
