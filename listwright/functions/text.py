"""String functions as Column expressions; all stay inside generated code, none is a Python UDF."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .schema import SUFFIXES

#: The white space that is trimmed (wider than Java's \s), and the strings that count as domains and addresses.
SPACE = r"[\s\u000B   -     　﻿]"
SUFFIX = r"(?i)(?:\s*,?\s+(?:" + "|".join(re.escape(s).replace(r"\ ", " ") for s in SUFFIXES) + r")\.?)+\z"
DOMAIN = r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\z"
EMAIL = rf"^(?:(?!{SPACE})[^@])+@(?:(?!{SPACE})[^@])+\.(?:(?!{SPACE})[^@])+\z"


def filled(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(filled(c), rf"^{SPACE}+|{SPACE}+\z", "")


def present(c: Column) -> Column:
    return trimmed(c) != ""


def normalize_company(c: Column) -> Column:
    """Name without edge and double white space, closing marks and legal suffixes; cased if all upper or all lower."""
    clean = trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), rf"{SPACE}+", " "), r"[.,]+\z", ""))

    def named(clean: Column) -> Column:
        return once(trimmed(F.regexp_replace(clean, SUFFIX, "")), lambda bare: F.when(bare == "", clean).otherwise(bare))

    def written(name: Column) -> Column:
        upper = (name == F.upper(name)) & name.rlike("[A-Z]")
        lower = (name == F.lower(name)) & name.rlike("[a-z]")

        def cased(short: bool) -> Column:
            def token(t: Column) -> Column:
                head, word = F.regexp_extract(t, r"(?s)^(\W*)", 1), F.regexp_extract(t, r"(?s)^\W*(.*)\z", 1)
                title = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))
                return F.concat(head, F.when(F.length(word) <= 3, word).otherwise(title) if short else title)

            return F.array_join(F.transform(F.split(name, " "), token), " ")

        return F.when(upper, cased(True)).when(lower, cased(False)).otherwise(name)

    return once(once(clean, named), written)


def company_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(normalize_company(c)), "[^a-z0-9]+", "")


def is_valid_domain(c: Column) -> Column:
    return F.coalesce((F.length(c) <= 253) & c.rlike(DOMAIN), F.lit(False))


def extract_domain(c: Column) -> Column:
    """Host of a URL, an address or a bare domain; null if it is not a valid domain."""

    def host(v: Column) -> Column:
        at = F.instr(v, "@")
        rest = F.when(at > 0, v.substr(at + 1, F.length(v))).otherwise(
            F.regexp_extract(F.regexp_replace(v, r"(?i)^[a-z]+://", ""), r"^([^/?#]*)", 1)
        )
        rest = F.regexp_replace(F.regexp_replace(rest, r":[0-9]+\z", ""), r"(?i)^www\.", "")
        return F.regexp_replace(F.lower(trimmed(rest)), r"\.\z", "")

    return once(once(trimmed(c), host), lambda h: F.when(is_valid_domain(h), h))


def is_likely_email(c: Column) -> Column:
    return trimmed(c).rlike(EMAIL)


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(filled(a), filled(b))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(filled(a)), F.length(filled(b)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - distance(a, b) / longest)


def domain_of(domain: Column, email: Column) -> Column:
    return F.coalesce(extract_domain(domain), extract_domain(email))


def blocking_key(domain: Column, key: Column) -> Column:
    """From an extracted domain (or null) and a company key."""
    initial = F.when(filled(key) == "", "?").otherwise(F.substring(key, 1, 1))
    return F.when(domain.isNotNull(), F.concat(F.lit("d:"), F.substring(domain, 1, 3))).otherwise(F.concat(F.lit("c:"), initial))


def group_key(ids: Column) -> Column:
    return F.array_join(F.array_sort(ids), "-")


def csv_escape(c: Column) -> Column:
    v = filled(c)
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *map(csv_escape, columns))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "warn").otherwise("bad")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 if the whole is not positive."""
    return F.when(whole > 0, F.floor(part / F.when(whole > 0, whole) * 100 + 0.5)).otherwise(0).cast("int")


def match_percent(score: Column) -> Column:
    """A similarity as a whole per cent, rounded half up."""
    return F.floor(score * 100 + 0.5).cast("int")


def register_sql(spark: SparkSession) -> None:
    """The functions for SQL, as temporary SQL functions (inlined by the optimiser)."""
    word, head = r"regexp_extract(t, r'(?s)^\W*(.*)\z', 1)", r"regexp_extract(t, r'(?s)^(\W*)', 1)"
    title = f"concat(upper(substring({word}, 1, 1)), lower(substring({word}, 2)))"
    short = f"if(length({word}) <= 3, {word}, {title})"

    def cased(token: str) -> str:
        return f"array_join(transform(split(n, ' '), t -> concat({head}, {token})), ' ')"

    name = (
        f"CASE WHEN n = upper(n) AND n rlike '[A-Z]' THEN {cased(short)} WHEN n = lower(n) AND n rlike '[a-z]' THEN {cased(title)} ELSE n END"
    )
    rest = (
        "if(instr(v, '@') > 0, substring(v, instr(v, '@') + 1), regexp_extract(regexp_replace(v, r'(?i)^[a-z]+://', ''), r'^([^/?#]*)', 1))"
    )

    def trim(v: str) -> str:  # a lambda's body cannot call another SQL function
        return f"regexp_replace(coalesce({v}, ''), r'^{SPACE}+|{SPACE}+\\z', '')"

    bare = trim(f"regexp_replace(c, r'{SUFFIX}', '')")

    def valid(v: str) -> str:
        return f"coalesce(length({v}) <= 253 AND {v} rlike r'{DOMAIN}', false)"

    functions = {
        "trim_all": ("STRING", trim("v")),
        "bare_company": ("STRING", f"transform(array(trim_all(regexp_replace(regexp_replace(trim_all(v), r'{SPACE}+', ' '), r'[.,]+\\z', ''))), "
                                   f"c -> coalesce(nullif({bare}, ''), c))[0]"),
        "normalize_company": ("STRING", f"transform(array(bare_company(v)), n -> {name})[0]"),
        "company_key": ("STRING", "regexp_replace(lower(normalize_company(v)), '[^a-z0-9]+', '')"),
        "is_valid_domain": ("BOOLEAN", valid("v")),
        "domain_host": ("STRING", f"regexp_replace(lower(trim_all(regexp_replace(regexp_replace({rest}, r':[0-9]+\\z', ''), r'(?i)^www\\.', ''))), r'\\.\\z', '')"),
        "extract_domain": ("STRING", f"transform(array(domain_host(trim_all(v))), h -> if({valid('h')}, h, null))[0]"),
        "is_likely_email": ("BOOLEAN", f"trim_all(v) rlike r'{EMAIL}'"),
    }
    for f, (kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}(v STRING) RETURNS {kind} RETURN {body}")
