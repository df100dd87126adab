"""Pseudonyms of personal data that keep the format and link equal values across documents.

Column functions only. A Feistel network adds keyed digests of one half to the other half, modulo the
size of that half; every round can be undone, so different values get different pseudonyms.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.tallyspark.pseudonymKey"
ROUNDS = 8
KINDS = ("email", "card", "phone", "ip", "ssn", "date", "secret")

# The shapes of what is looked for. Numbers stand free of other digits.
_LOCAL = r"[\p{L}\p{N}._%+\-]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FREE, _ENDS = r"(?<![0-9\p{L}])(?<![0-9][.\-/])", r"(?![0-9\p{L}]|[.\-/][0-9])"
_ALONE = rf"(?![0-9]{{3}}(?:[ .\-][0-9]{{3}}[ .\-]|-[0-9]{{2}}-)[0-9]{{4}}|(?:{_OCTET}\.){{3}})"
SHAPES = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{{2,}}",
    "phone": "|".join(
        (
            r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])",
            r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,3}\)?[ .\-]?[0-9]{4}[ .\-]?[0-9]{4}(?![0-9])",
            rf"{_FREE}(?:1[ .\-]?)?\([0-9]{{3}}\) ?[0-9]{{3}}[ .\-][0-9]{{4}}{_ENDS}",
            rf"{_FREE}(?:1[ .\-])?[0-9]{{3}}(?:-[0-9]{{3}}-|\.[0-9]{{3}}\.)[0-9]{{4}}{_ENDS}",
            rf"{_FREE}(?<![0-9] )(?:1 )?[0-9]{{3}} [0-9]{{3}}[ \-][0-9]{{4}}{_ENDS}(?! [0-9])",
            rf"{_FREE}(?:\(0[0-9]{{2}}\) ?|0[0-9]{{2}}[ .\-])[0-9]{{4}}[ .\-][0-9]{{4}}{_ENDS}(?! [0-9])",
        )
    ),
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "date": r"(?<![0-9\-/])(?:[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{4})(?![0-9\-/])"
    r"|(?<![0-9\-/])(?<![0-9]\.)(?:[0-9]{4}\.[0-9]{2}\.[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9\-/]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9\p{L}])(?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-]" + _ALONE + r"[0-9]{3}(?![0-9\p{L}])|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}|[0-9]{13,19})(?![0-9\p{L}])",
    "secret": r"(?i:token|secret|password|api[_\-]?key)\s{0,3}[=:]\s{0,3}\"[A-Za-z0-9_\-]{16,}\"",
}
PATTERN = "|".join(f"(?:{SHAPES[k]})" for k in ("email", "secret", "phone", "ip", "date", "ssn", "card"))
_ERA, _ERA_START = 200 * 365, "1900-01-01"


def _digest(kind: str, value: str, turn: str) -> str:
    """A keyed number below 2^60 for one round."""
    inner = f"sha2(concat(_key, '|{kind}|', {turn}, '|', {value}), 256)"
    return f"cast(conv(substr(sha2(concat(_key, {inner}), 256), 1, 15), 16, 10) as bigint)"


def _feistel(kind: str, a: str, b: str, u: str, v: str) -> str:
    """SQL of the struct (a, b) after all rounds, a below u and b below v."""
    left = f"if(i % 2 = 0, pmod(s.a + pmod({_digest(kind, 'cast(s.b as string)', 'cast(i as string)')}, {u}), {u}), s.a)"
    right = f"if(i % 2 = 1, pmod(s.b + pmod({_digest(kind, 'cast(s.a as string)', 'cast(i as string)')}, {v}), {v}), s.b)"
    start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> named_struct('a', {left}, 'b', {right}))"


def _luhn(digits: str) -> str:
    """SQL of the Luhn sum of a digit string."""
    one = f"cast(substr({digits}, length({digits}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, k) -> t + if(k % 2 = 0, {one}, {one} * 2 - if({one} > 4, 9, 0)))"


# Digits at the end of a match in five groups that are no part of its card, as all five together fail the Luhn test.
_BESIDE = f"if(x.m rlike '^([0-9]{{4}}[ -]){{4}}[0-9]{{3}}$' and {_luhn('x.d')} % 10 <> 0, 3, 0)"


def _permuted_digits(kind: str, digits: str) -> str:
    """SQL of the digits permuted among all strings of the same length."""
    half = f"(length({digits}) div 2)"
    power = "cast(pow(10, {}) as bigint)"
    rest = f"(length({digits}) - {half})"
    both = _feistel(kind, f"substr({digits}, 1, {half})", f"substr({digits}, {half} + 1)", power.format(half), power.format(rest))
    return f"element_at(transform(array({both}), s -> concat(lpad(cast(s.a as string), {half}, '0'), lpad(cast(s.b as string), {rest}, '0'))), 1)"


def _refill(shape: str, digits: str) -> str:
    """SQL of ``shape`` with its digits replaced in order."""
    step = f"named_struct('n', t.n + if(c between '0' and '9', 1, 0), 'o', concat(t.o, if(c between '0' and '9', substr({digits}, t.n + 1, 1), c)))"
    return f"aggregate(split({shape}, ''), named_struct('n', 0, 'o', ''), (t, c) -> {step}, t -> t.o)"


_PLAIN = "translate(x.m, '/.', '--')"
_READ = {f: f"try_to_timestamp({_PLAIN}, '{f}')" for f in ("yyyy-MM-dd", "MM-dd-yyyy", "dd-MM-yyyy")}
_ORDERS = f"""when {_PLAIN} like '____-%' then {{}}
      when x.m like '%.%' and {_READ["dd-MM-yyyy"]} is not null then {{}}
      when {_READ["MM-dd-yyyy"]} is not null then {{}}"""
_DAY = f"case {_ORDERS.format(*(_READ[f] for f in ('yyyy-MM-dd', 'dd-MM-yyyy', 'MM-dd-yyyy')))} else {_READ['dd-MM-yyyy']} end"
_FORM = f"case {_ORDERS.format(*(repr(f) for f in ('yyyy-MM-dd', 'dd-MM-yyyy', 'MM-dd-yyyy')))} else 'dd-MM-yyyy' end"
_MARK = "if(x.m like '%/%', '/', if(x.m like '%.%', '.', '-'))"


def _kind() -> str:
    """SQL of the kind of a match x (m: text, d: its digits without those beside a card); null where it fails its own test."""
    return f"""case
      when x.m like '%@%' then 'email'
      when x.m like '%"' then 'secret'
      when x.m like '+%' or x.m rlike '^(1[ .-]?)?[(]?[0-9]{{3}}[)]?[ .-]?[0-9]{{3,4}}[ .-][0-9]{{4}}$' then 'phone'
      when x.m rlike '^([0-9]{{4}}[/.-][0-9]{{2}}[/.-][0-9]{{2}}|[0-9]{{2}}[/.-][0-9]{{2}}[/.-][0-9]{{4}})$'
        then if(year({_DAY}) between 1800 and 2200, 'date', null)
      when x.m like '%.%' then 'ip'
      when x.m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'
        then if(substr(x.d, 1, 3) not in ('000', '666') and x.d < '9' and substr(x.d, 4, 2) <> '00' and substr(x.d, 6) <> '0000', 'ssn', null)
      when {_luhn('x.d')} % 10 = 0 and x.d rlike '[1-9]' then 'card' end"""


def _pseudonym() -> str:
    """SQL of the pseudonym of a match x (m, d, the digits r beside a card, k)."""
    area = "(cast(substr(x.d, 1, 3) as int) - if(x.d > '666', 2, 1))"
    ssn = _feistel("ssn", f"{area} * 99 + cast(substr(x.d, 4, 2) as int) - 1", "cast(substr(x.d, 6) as int) - 1", "88902", "9999")
    ssn_area = "(s.a div 99) + if(s.a div 99 >= 665, 2, 1)"
    days = f"datediff({_DAY}, date '{_ERA_START}')"
    date = _feistel("date", f"pmod({days}, {_ERA}) div 365", f"pmod({days}, {_ERA}) % 365", "200", "365")
    moved = f"cast(floor({days} / {_ERA}.0D) as int) * {_ERA} + cast(s.a * 365 + s.b as int)"
    quads = "split(x.m, '[.]')"
    ip = _feistel("ip", f"cast({quads}[0] as int) * 256 + cast({quads}[1] as int)", f"cast({quads}[2] as int) * 256 + cast({quads}[3] as int)", "65536", "65536")
    lead = "(length(x.d) - 10)"
    card = f"element_at(transform(array({_permuted_digits('card', 'substr(x.d, 1, length(x.d) - 1)')}), p -> concat(p, cast(pmod(-({_luhn("concat(p, '0')")}), 10) as string))), 1)"
    address = "substr(sha2(concat(_key, sha2(concat(_key, '|email|', lower(x.m)), 256)), 256), 1, 16)"
    quoted = "regexp_extract(x.m, '\"(.*)\"', 1)"
    secret = f"substr(repeat(sha2(concat(_key, sha2(concat(_key, '|secret|', {quoted}), 256)), 256), length({quoted}) div 64 + 1), 1, length({quoted}))"
    return f"""case x.k
      when 'email' then concat('user-', {address}, '@mail.invalid')
      when 'secret' then concat(regexp_extract(x.m, '^([^\"]*\")', 1), {secret}, '"')
      when 'phone' then {_refill('x.m', f"concat(substr(x.d, 1, {lead}), {_permuted_digits('phone', f'substr(x.d, {lead} + 1)')})")}
      when 'card' then {_refill('x.m', f"concat({card}, x.r)")}
      when 'ssn' then element_at(transform(array({ssn}), s -> concat(lpad(cast({ssn_area} as string), 3, '0'), '-', lpad(cast(s.a % 99 + 1 as string), 2, '0'), '-', lpad(cast(s.b + 1 as string), 4, '0'))), 1)
      when 'ip' then element_at(transform(array({ip}), s -> concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)), 1)
      when 'date' then element_at(transform(array({date}), s -> translate(date_format(date_add(date '{_ERA_START}', {moved}), {_FORM}), '-', {_MARK})), 1)
      else x.m end"""


_drawn: dict[str, str] = {}


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key in ``spark.tallyspark.pseudonymKey``; where it is unset, a random one of this application.

    Pseudonyms of two runs are linked only if both were given the same key.
    """
    given = spark.conf.get(KEY, None)
    return given or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_private") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced and the number of replacements in ``count_col``.

    E-mail addresses, phone numbers, IPv4 addresses, payment cards that pass the Luhn test, social security
    numbers of issued ranges, dates that exist, and quoted secrets. Cards, phones, addresses, numbers and dates
    are permuted within their own format and stay valid; equal values under one key get equal pseudonyms
    wherever they stand. Addresses of mail and secrets become keyed digests. What fails its test stays.

    Phones: a leading + and 3-3-4, 2-4-4 or 3-4-4 digits, or nationally 3-3-4 (with or without brackets) and, after a
    trunk zero, 3-4-4. Cards: 13 to 19 digits unspaced, or 4-4-4-4, 4-4-4-4-3, 4-6-4 and 4-6-5. Dates: year first or
    last with -, / or .; where both readings exist the month is first, with dots the day. Other groupings stay.

    A null text stays null with count 0, an empty text stays empty. Other columns and repeated rows stay as
    they are. Texts without digit and ``@`` and without quotation are passed through unread.
    """
    kept = docs.columns
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike('[0-9@"]'), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), text.alias("_text"), F.lit(key).alias("_key"), F.lit(PATTERN).alias("_p"), found.alias("_m"))
    rows = rows.withColumn("_x", F.expr("transform(_m, m -> named_struct('m', m, 'd', regexp_replace(m, '[^0-9]', '')))"))
    rows = rows.withColumn("_x", F.expr(f"transform(_x, x -> named_struct('m', x.m, 'd', substr(x.d, 1, length(x.d) - {_BESIDE}), 'r', right(x.d, {_BESIDE})))"))
    rows = rows.withColumn("_x", F.expr(f"transform(_x, x -> named_struct('m', x.m, 'd', x.d, 'r', x.r, 'k', {_kind()}))"))
    new: Column = F.when(F.size("_m") > 0, F.array_join(F.expr(f"zip_with(split(_text, _p, -1), transform(_x, x -> {_pseudonym()}), (a, b) -> concat(a, coalesce(b, '')))"), "")).otherwise(F.col("_text"))
    count = F.coalesce(F.expr("size(filter(_x, x -> x.k is not null))"), F.lit(0))
    order = [new.alias(text_col) if c == text_col else F.col("_row").getField(c).alias(c) for c in kept if c != count_col]
    return rows.select(*order, F.when(F.col("_m").isNull(), 0).otherwise(count).cast("int").alias(count_col))
