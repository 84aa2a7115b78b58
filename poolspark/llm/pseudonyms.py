"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Numbers and dates that pass their check are permuted by a keyed Feistel network within their own format:
equal values get equal pseudonyms in every document, different ones different pseudonyms, and a holder of
the key can invert them.

* card: 13 to 19 digits, spaces or hyphens between them, that pass the Luhn test; the pseudonym passes it too.
* phone, ssn: the digits are permuted, punctuation stays; the country code of a phone stays.
* ip: the four bytes, as one number of 32 bits.
* date: a valid day of 1900-01-01 to 2099-12-31, within these 73,049 days. YYYY-MM-DD and DD/MM/YYYY, or
  MM/DD/YYYY where only that is valid.
* email: the part before ``@`` becomes ``u`` and a keyed number; the host stays.

Cases: null texts stay null and count nothing; empty texts stay; each row is changed on its own, so ties,
repeated rows and rows without doc_id need no care; very long texts are read once from left to right;
extra columns are kept, columns named as the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Fixed values. No expression starts inside a longer run, and each is bounded, so that reading is linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z/-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2})(?![0-9A-Za-z/-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
ROUNDS = 10
DAYS = (17, 4297)  # their product is the number of days from 1900-01-01 to 2099-12-31
DATE_FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")


def _network(kind: str, key: str, a: str, b: str, top_a: str, top_b: str) -> str:
    """SQL of the struct (a, b) permuted: in turn each half is moved by a keyed hash of the other."""
    moved = lambda own, other, top: (
        f"pmod({own} + cast(conv(substr(sha2(concat_ws(':', '{key}', '{kind}', cast({top_a} as string), i, {other}), 256), 1, 14), 16, 10) as bigint), {top})")
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', {a}, 'b', {b}), (s, i) -> "
        f"if(i % 2 = 1, named_struct('a', {moved('s.a', 's.b', top_a)}, 'b', s.b), named_struct('a', s.a, 'b', {moved('s.b', 's.a', top_b)})))")


def _digits(kind: str, key: str, d: str) -> str:
    """SQL: the digits of the SQL string ``d`` permuted among strings of its length."""
    n, half = f"length({d})", f"cast(floor(length({d}) / 2) as int)"
    top = lambda size: f"cast(rpad('1', {size} + 1, '0') as bigint)"
    net = _network(kind, key, f"cast(concat('0', substr({d}, 1, {half})) as bigint)", f"cast(substr({d}, {half} + 1) as bigint)", top(half), top(f"({n} - {half})"))
    return f"transform(array({net}), z -> concat(if({half} = 0, '', lpad(cast(z.a as string), {half}, '0')), lpad(cast(z.b as string), {n} - {half}, '0')))[0]"


def _bare(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, digits: str) -> str:
    """SQL: ``m`` with its digits replaced in order by the string ``digits``."""
    return (
        f"transform(array({digits}), p -> array_join(transform(sequence(1, length({m})), j -> if(substr({m}, j, 1) rlike '[0-9]', "
        f"substr(p, length({_bare(f'substr({m}, 1, j)')}), 1), substr({m}, j, 1))), ''))[0]")


def _luhn_sum(d: str, shift: int) -> str:
    """SQL: the Luhn sum of ``d``; the last digit counts once if shift is 0, twice if 1."""
    digit = f"cast(substr({d}, length({d}) - k, 1) as int)"
    return (f"aggregate(sequence(0, length({d}) - 1), 0, (t, k) -> t + if(pmod(k + {shift}, 2) = 0, {digit}, "
            f"if({digit} > 4, 2 * {digit} - 9, 2 * {digit})))")


def _card(m: str, key: str) -> str:
    body = "substr(d, 1, length(d) - 1)"
    valid = f"transform(array({_digits('card', key, body)}), q -> concat(q, cast(pmod(10 - pmod({_luhn_sum('q', 1)}, 10), 10) as string)))[0]"
    return _refill(m, f"transform(array({_bare(m)}), d -> {valid})[0]")


def _ip(m: str, key: str) -> str:
    part = lambda k: f"cast(split({m}, '[.]')[{k}] as bigint)"
    net = _network("ip", key, f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536L", "65536L")
    return f"transform(array({net}), z -> concat_ws('.', z.a div 256, z.a % 256, z.b div 256, z.b % 256))[0]"


def _phone(m: str, key: str) -> str:
    tail = f"regexp_extract({m}, '[(]?[0-9]{{3}}[)]?[ .-]?[0-9]{{3}}[ .-][0-9]{{4}}$', 0)"
    return f"transform(array({tail}), t2 -> concat(substr({m}, 1, length({m}) - length(t2)), {_refill('t2', _digits('phone', key, _bare('t2')))}))[0]"


def _date(m: str, key: str) -> str:
    tried = lambda form: f"cast(try_to_timestamp({m}, '{form}') as date)"
    a, b = DAYS
    shifted = lambda form: (
        "transform(array(" + _network("date", key, f"cast(datediff({tried(form)}, date'1900-01-01') div {b} as bigint)",
                                      f"cast(datediff({tried(form)}, date'1900-01-01') % {b} as bigint)", f"{a}L", f"{b}L")
        + f"), z -> date_format(date_add(date'1900-01-01', cast(z.a * {b} + z.b as int)), '{form}'))[0]")
    return "case " + " ".join(f"when {tried(f)} is not null then {shifted(f)}" for f in DATE_FORMS) + f" else {m} end"


def _email(m: str, key: str) -> str:
    local = f"lower(substring_index({m}, '@', 1))"
    return f"concat('u', lpad(conv(substr(sha2(concat('{key}:email:', {local}), 256), 1, 14), 16, 10), 17, '0'), '@', substring_index({m}, '@', -1))"


def kind_of(m: str) -> str:
    """SQL: the kind of the matched string ``m``, by the first expression that fits it whole and its check; else null."""
    tests = {"date": "(" + " or ".join(f"try_to_timestamp({m}, '{f}') is not null" for f in DATE_FORMS) + ")",
             "card": f"transform(array({_bare(m)}), d -> pmod({_luhn_sum('d', 0)}, 10) = 0)[0]"}
    full = {k: p.replace("\\", "\\\\").replace("'", "\\'") for k, p in PATTERNS.items()}
    return "case " + " ".join(f"when {m} rlike '^(?:{p})$' and {tests.get(k, 'true')} then '{k}'" for k, p in full.items()) + " end"


def pseudonymise(docs: DataFrame, key: str, prefix: str = "n_") -> DataFrame:
    """``docs`` with ``text`` pseudonymised and a count for each kind in ``prefix`` + kind. ``key``: letters and digits."""
    if not key.isalnum():
        raise ValueError("the key takes letters and digits only")
    every = "|".join(f"(?:{p})" for p in PATTERNS.values())
    makers = {"email": _email, "ip": _ip, "phone": _phone, "ssn": lambda m, k: _refill(m, _digits("ssn", k, _bare(m))), "date": _date, "card": _card}
    change = "case k " + " ".join(f"when '{kind}' then {make('m', key)}" for kind, make in makers.items()) + " else m end"
    walk = F.lit(rf"(?s)\G(.*?)({every})")
    text: Column = F.col("text")
    hit = F.coalesce(text.rlike(every), F.lit(False))
    counts = [f"{prefix}{k}" for k in KINDS]
    kept = [c for c in docs.columns if c not in counts]
    gaps = F.when(hit, F.regexp_extract_all(text, walk, F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = F.when(hit, F.regexp_extract_all(text, walk, F.lit(2))).otherwise(F.array().cast("array<string>"))
    cut = docs.select(*[F.col(c).alias(f"_d_{c}") for c in kept], gaps.alias("gaps"), found.alias("found"))
    cut = cut.withColumn("kinds", F.expr(f"transform(found, m -> {kind_of('m')})"))
    done = F.expr(f"zip_with(found, kinds, (m, k) -> {change})")
    length = F.expr("aggregate(gaps, 0, (n, g) -> n + length(g)) + aggregate(found, 0, (n, m) -> n + length(m))")
    tail = F.substring(F.col("_d_text"), length + 1, F.length("_d_text"))
    new = F.when(F.size("found") > 0, F.concat(F.array_join(F.zip_with("gaps", done, lambda g, m: F.concat(g, m)), ""), tail)).otherwise(F.col("_d_text"))
    n = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return cut.select(*[new.alias("text") if c == "text" else F.col(f"_d_{c}").alias(c) for c in kept],
                      *[n(k).alias(f"{prefix}{k}") for k in KINDS])
