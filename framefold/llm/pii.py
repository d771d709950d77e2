"""Format-preserving pseudonyms for personal data and secrets, in DataFrame functions only.

Candidates are found by one pattern, validated by kind (Luhn, mod 97, calendar, octets), and replaced by a
keyed permutation of the set of all values of their format.  The permutation is an alternating Feistel
network: a value is a list of digits v[i] in mixed radices r[i]; in each round the digits at even (odd)
places move by amounts that a keyed digest of the digits at odd (even) places decides.  So equal values
get equal pseudonyms in every document, different ones different pseudonyms, the key undoes it, and
cards, IBANs, dates, addresses and numbers stay valid.

Kinds, and what is permuted:
  card    numbers in an issuer's range that pass Luhn's check: what follows the first four digits; the last digit
          is computed anew
  iban    what follows the check digits, letters and digits apart; the check digits are computed anew
  ssn     area, group and serial within the ranges in use
  phone   the digits after the country code
  ipv4    the four octets
  date    the day, within the 400 years from 1800 (146097 days = 189 * 773); yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy
          or, where that is no date, mm/dd/yyyy (but for 02/29/yyyy, which stays)
  email   the part before the @, letters and digits apart, upper and lower case alike
  key     access key ids: what follows the four letters, base 36
  secret  values after password=, token = and the like, and hexadecimal runs of 32 or more

Defined cases: a null text stays null with no findings; an empty text stays empty; a candidate that fails
its validation stays as it is, but for what stands inside it; white space, quotes and separators stay; repeated
rows, and equal values in them, are each replaced alike; a very long text is replaced whole; an empty table gives an
empty result; a doc_id plays no part.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: Patterns of the kinds, tried in this order at each place.
_LOCAL = r"[\p{L}\p{N}._%+\-]"
PATTERNS: dict[str, str] = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){{1,126}}+",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_\-]?key))\s{0,3}[=:]\s{0,3}[\x22\x27]?[A-Za-z0-9+/_\-]{6,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .\-][0-9]{3}[.\-][0-9]{4}(?![0-9])",
    "ipv4": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "date": r"(?<![0-9.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9\-/])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])",
}
#: How payment card numbers begin.
ISSUERS = r"^(?:4|3[04-9]|5[0-8]|6[0-9]|2(?:2[2-9]|[3-6][0-9]|7[0-2]))"
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
KINDS = ("email", "secret", "key", "iban", "phone", "ipv4", "ssn", "date", "card")
#: Alphabets of characters that change into one another.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõö"
ACCENTED_UPPER = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ"
HEX, BASE36 = "0123456789abcdef", DIGITS + UPPER
PLAIN = (DIGITS, LOWER, UPPER, ACCENTED, ACCENTED_UPPER)
_FROM, _DAYS = "1800-01-01", 189 * 773


def _joined() -> str:
    """All patterns as one, in KINDS' order, found without being passed over; groups are counted for card's back reference."""
    return f"(?=({'|'.join(PATTERNS.values())}))".replace(r"\1", r"\2")


def _raw(text: str) -> str:
    """A raw SQL string literal."""
    return f'r"{text}"'


def feistel(v: str, r: str, kind: str, back: bool = False) -> str:
    """SQL: the permuted digits v in radices r; _key is the key's column.  back: undo it.

    r is read for each digit, so it is a variable or a constant, never something to compute.
    """
    rounds = f"reverse(sequence(0, {ROUNDS - 1}))" if back else f"sequence(0, {ROUNDS - 1})"
    sign = "-" if back else "+"
    seen = f"sha2(concat_ws(',', _key, '{kind}', cast(k as string), transform(filter(a, (x, i) -> i % 2 <> k % 2), x -> cast(x as string))), 256)"
    move = "cast(conv(substr(sha2(concat(d, cast(i as string)), 256), 1, 13), 16, 10) as bigint)"
    return f"aggregate({rounds}, {v}, (a, k) -> transform(array({seen}), d -> transform(a, (x, i) -> if(i % 2 = k % 2, pmod(x {sign} {move}, {r}[i]), x)))[0])"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _chars(text: str, alphabets: tuple[str, ...], kind: str, back: bool) -> str:
    """SQL: the text with the characters of each alphabet permuted, others in place."""
    one = "[" + "".join(alphabets) + "]"
    rest = "[^" + "".join(alphabets) + "]"
    value = "case " + " ".join(f"when instr('{a}', c) > 0 then instr('{a}', c) - 1" for a in alphabets) + " end"
    radix = "case " + " ".join(f"when instr('{a}', c) > 0 then {len(a)}" for a in alphabets) + " end"
    letter = "case " + " ".join(f"when instr('{a}', s[i]) > 0 then substr('{a}', int(x) + 1, 1)" for a in alphabets) + " end"
    permuted = _let(f"transform(s, c -> {radix})", "r", feistel(f"transform(s, c -> bigint({value}))", "r", kind, back))
    made = f"transform({permuted}, (x, i) -> {letter})"
    woven = f"array_join(zip_with(split({text}, '{one}', -1), {made}, (f, n) -> concat(f, coalesce(n, ''))), '')"
    return f"if({text} rlike '{one}', {_let(f"split(regexp_replace({text}, '{rest}', ''), '')", 's', woven)}, {text})"


def _luhn_digit(payload: str) -> str:
    """SQL: the digit that makes payload (an array of digits) pass Luhn's check."""
    doubled = "aggregate(reverse(P), named_struct('i', 0, 't', 0L), (a, x) -> named_struct('i', a.i + 1, 't', a.t + if(a.i % 2 = 0, if(x > 4, 2 * x - 9, 2 * x), x)), a -> a.t)"
    return f"pmod(10 - pmod({doubled.replace('P', payload)}, 10), 10)"


def _mod97(text: str) -> str:
    """SQL: the number that an IBAN's characters stand for, modulo 97."""
    step = "if(c rlike '[0-9]', pmod(a * 10 + int(c), 97), pmod(a * 100 + ascii(c) - 55, 97))"
    return f"aggregate(split({text}, ''), 0, (a, c) -> {step})"


def _card(m: str, back: bool) -> str:
    digits = f"transform(split(regexp_replace({m}, '[^0-9]', ''), ''), c -> bigint(c))"
    permuted = _let("transform(s, x -> 10)", "r", feistel("slice(s, 5, size(s) - 5)", "r", "card", back))
    payload = f"concat(slice(s, 1, 4), {permuted})"
    moved = _let(payload, "p", f"transform(concat(p, array({_luhn_digit('p')})), x -> cast(x as string))")
    return _let(digits, "s", f"array_join(zip_with(split({m}, '[0-9]', -1), {moved}, (f, n) -> concat(f, coalesce(n, ''))), '')")


def _iban(m: str, back: bool) -> str:
    bare = f"regexp_replace({m}, ' ', '')"
    moved = _let(f"substr({bare}, 1, 2)", "h", _let(_chars(f"substr({bare}, 5)", (DIGITS, UPPER), "iban", back), "b", f"concat(h, lpad(cast(98 - {_mod97("concat(b, h, '00')")} as string), 2, '0'), b)"))
    return f"array_join(zip_with(split({m}, '[A-Z0-9]', -1), split({moved}, ''), (f, n) -> concat(f, coalesce(n, ''))), '')"


def _ssn(m: str, back: bool) -> str:
    parts = f"transform(split({m}, '-'), x -> bigint(x))"
    values = "array(s[0] - if(s[0] > 666, 2, 1), s[1] - 1, s[2] - 1)"
    out = "concat_ws('-', lpad(cast(p[0] + if(p[0] >= 665, 2, 1) as string), 3, '0'), lpad(cast(p[1] + 1 as string), 2, '0'), lpad(cast(p[2] + 1 as string), 4, '0'))"
    return _let(parts, "s", _let(feistel(values, "array(898, 99, 9999)", "ssn", back), "p", out))


def _ipv4(m: str, back: bool) -> str:
    return f"array_join(transform({feistel(f"transform(split({m}, '[.]'), x -> bigint(x))", "array(256, 256, 256, 256)", 'ipv4', back)}, x -> cast(x as string)), '.')"


def _date_form(m: str) -> str:
    day_first = f"try_to_timestamp({m}, 'dd/MM/yyyy') is not null"
    return f"case when {m} like '____-%' then 'yyyy-MM-dd' when {m} like '%.%' then 'dd.MM.yyyy' when {day_first} then 'dd/MM/yyyy' else 'MM/dd/yyyy' end"


def _date(m: str, back: bool) -> str:
    day = f"datediff(to_date({m}, f), date'{_FROM}')"
    moved = _let(f"bigint({day})", "n", feistel("array(n div 773, n % 773)", "array(189, 773)", "date", back))
    by_day = _let(moved, "p", f"date_format(date_add(date'{_FROM}', int(p[0] * 773 + p[1])), f)")
    # mm/dd/yyyy counts only where the day is over 12, so its dates move among their like: days 13 to 28 with month
    # and year, later ones with the year alone.
    parts = f"transform(split({m}, '/'), x -> bigint(x))"
    early = _let(feistel("array(s[2] - 1800, s[0] - 1, s[1] - 13)", "array(400, 12, 16)", "month first", back), "p", "concat(lpad(cast(p[1] + 1 as string), 2, '0'), '/', cast(p[2] + 13 as string), '/', cast(p[0] + 1800 as string))")
    late = f"concat(substr({m}, 1, 6), cast({feistel('array(s[2] - 1800)', 'array(400)', 'month first', back)}[0] + 1800 as string))"
    month_first = _let(parts, "s", f"if(s[1] <= 28, {early}, {late})")
    return _let(_date_form(m), "f", f"if(f = 'MM/dd/yyyy', {month_first}, {by_day})")


def resolved(m: str) -> str:
    """SQL: candidate m, or the part of it that is a valid IBAN of its country's length and ends before a space.

    A short word or number that follows an IBAN looks like more of it.
    """
    length = "case " + " ".join(f"when substr({m}, 1, 2) in ({', '.join(repr(x) for x in c.split())}) then {n}" for n, c in IBAN_LENGTHS.items()) + " else 0 end"
    ends = "transform(sequence(1, size(w)), n -> array_join(slice(w, 1, n), ' '))"
    valid = f"filter({ends}, x -> length(replace(x, ' ')) = c and {_mod97("concat(substr(replace(x, ' '), 5), substr(x, 1, 4))")} = 1)"
    best = _let(length, "c", _let(f"split({m}, ' ')", "w", f"coalesce(get({valid}, 0), {m})"))
    return f"if({m} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]+$', {best}, {m})"


def _taken(candidates: str) -> str:
    """SQL: candidates (m, k, t) from the left; a valid one is taken with its text, so that t is what follows it.

    A failed candidate takes nothing, so what stands inside it counts.  left: how much of the last taken one is still to pass.
    """
    size, held = "length(z.t)", "length(z.m)"
    passing = f"struct(a.left - least(a.left, {size}) as left, concat(a.out, array(named_struct('m', z.m, 'k', cast(null as string), 't', substr(z.t, a.left + 1)))) as out)"
    taking = f"struct(greatest({held} - {size}, 0) as left, concat(a.out, array(named_struct('m', z.m, 'k', z.k, 't', substr(z.t, {held} + 1)))) as out)"
    start = "struct(0 as left, cast(array() as array<struct<m: string, k: string, t: string>>) as out)"
    return f"aggregate({candidates}, {start}, (a, z) -> if(a.left > 0 or z.k is null, {passing}, {taking}), a -> a.out)"


def kind_of(m: str) -> str:
    """SQL: the kind of candidate m, or null if it fails its validation."""

    def like(kind: str) -> str:
        return f"{m} rlike {_raw('^(?:' + PATTERNS[kind] + ')$')}"

    bare = f"regexp_replace({m}, '[^0-9]', '')"
    date = f"{like('date')} and not ({_date_form(m)} = 'MM/dd/yyyy' and {m} like '02/29/%') and year(try_to_timestamp({m}, {_date_form(m)})) between 1800 and 2199"
    iban = f"{like('iban')} and {_mod97(f"concat(substr(regexp_replace({m}, ' ', ''), 5), substr({m}, 1, 4))")} = 1"
    ssn = f"{like('ssn')} and int(substr({m}, 1, 3)) between 1 and 899 and substr({m}, 1, 3) <> '666' and substr({m}, 5, 2) <> '00' and substr({m}, 8) <> '0000'"
    return (
        f"case when {like('email')} then 'email' when {like('secret')} or {like('hex')} then 'secret' when {like('key')} then 'key' when {iban} then 'iban' "
        f"when {like('phone')} then 'phone' when {like('ipv4')} then 'ipv4' when {ssn} then 'ssn' when {date} then 'date' "
        f"when {like('card')} and {bare} rlike {_raw(ISSUERS)} and luhn_check({bare}) then 'card' end"
    )


def pseudonym(m: str, kind: str, back: bool = False) -> str:
    """SQL: what candidate m of that kind becomes."""
    local = f"substring_index({m}, '@', 1)"
    head = f"regexp_extract({m}, {_raw(r'(?i)^(?:(?:password|passwd|pwd|token|secret|api[_\-]?key)\s{0,3}[=:]\s{0,3}[\x22\x27]?)?')}, 0)"
    code = f"regexp_extract({m}, {_raw(r'^(?:\+[0-9]{1,3}(?=[ .\-(])|\+[0-9])?')}, 0)"
    tail = "substr(M, length(h) + 1)".replace("M", m)
    return (
        f"case {kind} when 'email' then concat({_chars(local, PLAIN, 'email', back)}, substr({m}, length({local}) + 1)) "
        f"when 'secret' then {_let(head, 'h', _let(tail, 't', f"concat(h, if(t rlike '^[0-9a-f]+$', {_chars('t', (HEX,), 'hex', back)}, {_chars('t', (DIGITS, LOWER, UPPER), 'secret', back)}))"))} "
        f"when 'key' then concat(substr({m}, 1, 4), {_chars(f'substr({m}, 5)', (BASE36,), 'key', back)}) "
        f"when 'iban' then {_iban(m, back)} "
        f"when 'phone' then {_let(code, 'h', f'concat(h, {_chars(tail, (DIGITS,), "phone", back)})')} "
        f"when 'ipv4' then {_ipv4(m, back)} when 'ssn' then {_ssn(m, back)} when 'date' then {_date(m, back)} when 'card' then {_card(m, back)} else {m} end"
    )


def pseudonymised(docs: DataFrame, key: Column | str, text: str = "text", back: bool = False, counts: bool = True) -> DataFrame:
    """docs with the text replaced; counts adds found_<kind>, how many of each kind it held.  back: undo it with the key.

    A row's own columns travel in one struct meanwhile, so none can clash; counts replace columns of their names.
    """
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(given, F.col(f"`{text}`").cast("string").alias("_text"), (F.lit(key) if isinstance(key, str) else key).alias("_key"))
    # _m: the candidates at every place, those inside others too; _t: the text from each up to the next, _h: up to the first.
    rows = rows.withColumn("_m", F.expr(f"transform(regexp_extract_all(_text, {_raw(_joined())}, 1), m -> {resolved('m')})"))
    rows = rows.withColumn("_p", F.when(F.size("_m") > 0, F.split("_text", _joined(), -1)))
    rows = rows.withColumn("_t", F.expr("if(size(_p) = size(_m), _p, slice(_p, 2, size(_m)))")).withColumn("_h", F.expr("if(size(_p) = size(_m), '', _p[0])"))
    # _k: for each candidate its kind, null where it fails or stands in one that was taken, and what follows it.
    rows = rows.withColumn("_c", F.expr(f"zip_with(_m, _t, (m, t) -> named_struct('m', m, 'k', {kind_of('m')}, 't', t))")).withColumn("_k", F.expr(_taken("_c")))
    new = f"transform(_k, z -> if(z.k is null, z.t, concat({pseudonym('z.m', 'z.k', back)}, z.t)))"
    changed = F.when(F.size("_m") > 0, F.expr(f"concat(_h, array_join({new}, ''))")).otherwise(F.col("_text"))
    sizes = {f"found_{k}": F.expr(f"if(_k is null, 0, size(filter(_k, z -> z.k = '{k}')))") for k in KINDS} if counts else {}
    kept = [changed.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns if c not in sizes]
    return rows.select(*kept, *[v.alias(k) for k, v in sizes.items()])


def secret_key(docs: DataFrame) -> str:
    """The key that the session names in framefold.pii.key.  Where it names none, one is drawn and named there, so that
    pseudonyms are linked within the session; nobody knows it, so they can't be undone after it.
    """
    spark = docs.sparkSession
    if not spark.conf.get("framefold.pii.key", None):
        spark.conf.set("framefold.pii.key", secrets.token_hex(32))
    return spark.conf.get("framefold.pii.key")
