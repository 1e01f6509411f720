"""Operator 3 - format-preserving Feistel pseudonyms (SQL functions only).

Personal numbers and dates are found by pattern, validated (check digits,
number ranges, calendar) and replaced by another valid value of the same
format. The replacement is a keyed permutation of the format's values: a
Feistel network over the value's symbols, whose halves are added, symbol by
symbol modulo the symbol's base, to a keyed hash of the other half. So equal
values get equal pseudonyms in every document, different values stay different,
and the holder of the key can invert it. Separators, letter case and lengths
stay; a card keeps its first digit and gets the check digit that fits; the same
date in another notation gets the same pseudonym in that notation.

Formats: payment cards (Luhn), IBANs (mod 97; of the country's length, other
codes as far as they reach), social security numbers, ten-digit and international phone
numbers (of the country's length where the plan has one), IPv4 addresses, dates (yyyy-mm-dd,
mm/dd/yyyy, dd.mm.yyyy from 1900 to 2099), and, symbol by symbol, the local part
of e-mail addresses and access key ids.

Edge cases: a null text stays null, an empty one empty; numbers that fail
validation stay as they are; texts of any length are scanned whole; repeated ids
or rows give one row each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.llm.common import table

KEY = "corpus-pseudonyms-1"       # an example; a real run passes its own secret
ROUNDS = 8

# Length of an IBAN by country (the registry, and the countries that use the format without an entry there).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD TG",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# Digits after the country code of international phone numbers, where the plan has one length or nearly so.
PHONE_LENGTHS = {
    (7, 7): "297 354 423 501 597 960", (8, 8): "45 47 53 65 216 220 227 228 229 230 357 370 371 373 374 382 386 389 502 503 504 505 506 507 852 853 965 968 973 974",
    (7, 8): "372 961", (7, 9): "46 353 359", (8, 9): "32 36 51 66 213 355 377 381 385 855 886 962 971 972",
    (9, 9): "27 31 33 34 40 41 48 56 61 93 212 233 251 254 255 256 351 375 380 420 421 966", (9, 10): "44 81 84 92 94",
    (10, 10): "1 7 30 52 57 58 90 91 98", (10, 11): "54 55 86", (8, 10): "20 60 63 64 82",
}
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"


def _phone_world() -> str:
    """By the country's length in any grouping; else up to 15 digits, where a blank behind a group of five or more ends
    the number (unless that leaves fewer than eight)."""
    known = "|".join(rf"\+(?:{'|'.join(codes.split())})(?:[ .-]?[0-9]){{{lo},{hi}}}" for (lo, hi), codes in PHONE_LENGTHS.items())
    group = r"(?=[0-9]{2})"
    other = rf"\+[0-9](?:(?:[.-]{group}|(?<![0-9]{{5}}) {group})?[0-9]){{7,14}}|\+[0-9](?:(?:[ .-]{group})?[0-9]){{7,14}}"
    return rf"{known}|(?!(?:{known})(?![A-Za-z0-9@]))(?:{other})"


def _iban() -> str:
    """The length follows from the country, so no word or number behind is taken; of other codes the longest run is taken."""
    each = [rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
            for n, codes in IBAN_LENGTHS.items()]
    listed = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    return "|".join([*each, r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"])


# Patterns of each format (fixed values); a match must also pass VALID.
PATTERNS = {
    "iban": _iban(),
    "access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,6}",
    "date_ymd": r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}",
    "date_mdy": r"[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}",
    "date_dmy": r"[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "phone": r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+1[0-9]{10}",
    "phone_world": _phone_world(),
}
DATE_FORMATS = {"date_ymd": "yyyy-MM-dd", "date_mdy": "MM/dd/yyyy", "date_dmy": "dd.MM.yyyy"}
FIRST_DAY, DAYS, DAY_BASE = "1900-01-01", 73049, 4297        # 73049 = 17 * 4297


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern() -> str:
    """All formats in one expression that starts and ends outside a word or number."""
    every = "|".join(PATTERNS.values())
    return rf"(?<![A-Za-z0-9._%+@-])(?:{every})(?![A-Za-z0-9@]|[.-][0-9])|(?<![A-Za-z0-9])(?:{every})(?![A-Za-z0-9@])"


def _let(value: str, name: str, body: str) -> str:
    """SQL that binds a value once: body may use ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _ints(text: str) -> str:
    """The characters of a digit string as whole numbers."""
    return f"transform(filter(split({text}, ''), c -> c <> ''), c -> cast(c AS bigint))"


def feistel(symbols: str, bases: str, tweak: str, key: str, inverse: bool = False) -> str:
    """SQL for the keyed permutation of an array of symbols, each below its base."""
    order = f"sequence({ROUNDS}, 1)" if inverse else f"sequence(1, {ROUNDS})"
    sign = "-" if inverse else "+"

    def added(half: str, other: str, base: str) -> str:
        seed = f"concat({_quote(key)}, '|{tweak}|', cast(i AS string), '|', array_join(transform({other}, o -> cast(o AS string)), ','))"
        prf = f"cast(conv(substring(sha2(concat(h, '|', cast(j AS string)), 256), 1, 12), 16, 10) AS bigint) % {base}[j]"
        return _let(seed, "h", f"transform({half}, (v, j) -> pmod(v {sign} {prf}, {base}[j]))")

    step = (f"IF(i % 2 = 1, named_struct('l', {added('s.l', 's.r', 'bl')}, 'r', s.r),"
            f" named_struct('l', s.l, 'r', {added('s.r', 's.l', 'br')}))")
    run = (f"aggregate({order}, named_struct('l', slice(x, 1, n), 'r', slice(x, n + 1, size(x) - n)), (s, i) -> {step},"
           " s -> concat(s.l, s.r))")
    halves = _let("slice(b, 1, n)", "bl", _let("slice(b, n + 1, size(b) - n)", "br", run))
    return _let(symbols, "x", _let(bases, "b", _let("cast(ceil(size(x) / 2) AS int)", "n", halves)))


def _same(base: int, x: str) -> str:
    return f"transform({x}, z -> {base}L)"


def _luhn(d: str, double: int) -> str:
    """Luhn sum of a digit string; every second digit from the right is doubled, the first if double = 1."""
    digit = f"cast(substring({d}, length({d}) - k + 1, 1) AS int)"
    return (f"aggregate(IF(length({d}) = 0, array(), sequence(1, length({d}))), 0, (t, k) -> t + IF(k % 2 = {double},"
            f" IF({digit} > 4, 2 * {digit} - 9, 2 * {digit}), {digit}))")


def _mod97(s: str) -> str:
    """Remainder of an IBAN part whose letters count as 10 to 35."""
    value = "IF(c BETWEEN '0' AND '9', cast(c AS int), ascii(c) - 55)"
    return (f"aggregate(filter(split({s}, ''), c -> c <> ''), 0, (t, c) -> IF(c BETWEEN '0' AND '9', (t * 10 + {value}) % 97,"
            f" (t * 100 + {value}) % 97))")


def _date(kind: str, m: str = "m") -> str:
    return f"cast(try_to_timestamp({m}, '{DATE_FORMATS[kind]}') AS date)"


def _core(m: str = "m") -> str:
    """The last ten digits of a phone number."""
    return f"right({_digits(m)}, 10)"


def _plain(m: str = "m") -> str:
    return f"replace({m}, ' ', '')"


VALID = {
    "iban": f"length({_plain()}) BETWEEN 15 AND 34 AND {_mod97(f'concat(substring({_plain()}, 5), substring({_plain()}, 1, 4))')} = 1",
    "access_key": "true",
    "email": "true",
    **{k: f"{_date(k)} IS NOT NULL" for k in DATE_FORMATS},
    "ssn": "substring(m, 1, 3) NOT IN ('000', '666') AND m < '9' AND substring(m, 5, 2) <> '00' AND substring(m, 8, 4) <> '0000'",
    "card": f"length({_digits('m')}) BETWEEN 13 AND 19 AND {_luhn(_digits('m'), 0)} % 10 = 0",
    "ipv4": "forall(split(m, '[.]'), o -> cast(o AS int) < 256 AND (o = '0' OR o NOT LIKE '0%'))",
    "phone": f"length({_digits('m')}) BETWEEN 10 AND 11",
    "phone_world": f"length({_digits('m')}) BETWEEN 8 AND 15",
}


def _refill(m: str, new: str) -> str:
    """``m`` with its digits replaced, in order, by those of ``new``."""
    at = f"length({_digits(f'substring({m}, 1, p)')})"
    return (f"array_join(transform(sequence(1, length({m})), p -> IF(substring({m}, p, 1) BETWEEN '0' AND '9',"
            f" substring({new}, {at}, 1), substring({m}, p, 1))), '')")


def _join(x: str) -> str:
    return f"array_join(transform({x}, z -> cast(z AS string)), '')"


def _letters(m: str, tweak: str, key: str, inverse: bool) -> str:
    """Letters and digits permuted in their own class; case and other characters stay."""
    chars = f"filter(split({m}, ''), c -> c <> '')"
    base = "IF(c BETWEEN '0' AND '9', 10L, IF(lower(c) BETWEEN 'a' AND 'z', 26L, 1L))"
    index = "IF(c BETWEEN '0' AND '9', cast(ascii(c) - 48 AS bigint), IF(lower(c) BETWEEN 'a' AND 'z', cast(ascii(lower(c)) - 97 AS bigint), 0L))"
    moved = feistel(f"transform(cs, c -> {index})", f"transform(cs, c -> {base})", tweak, key, inverse)
    back = ("IF(c BETWEEN '0' AND '9', char(48 + y), IF(c BETWEEN 'a' AND 'z', char(97 + y), IF(c BETWEEN 'A' AND 'Z', char(65 + y), c)))")
    return _let(chars, "cs", f"array_join(zip_with(cs, {moved}, (c, y) -> {back}), '')")


def replacement(kind: str, key: str, inverse: bool) -> str:
    """SQL of the pseudonym of a valid match ``m``."""
    def f(symbols: str, bases: str, tweak: str) -> str:
        return feistel(symbols, bases, tweak, key, inverse)

    if kind in DATE_FORMATS:
        day = f"cast(datediff({_date(kind)}, DATE'{FIRST_DAY}') AS bigint)"
        moved = f(f"array({day} div {DAY_BASE}, {day} % {DAY_BASE})", f"array({DAYS // DAY_BASE}L, {DAY_BASE}L)", "date")
        return _let(moved, "w", f"date_format(date_add(DATE'{FIRST_DAY}', cast(w[0] * {DAY_BASE} + w[1] AS int)), '{DATE_FORMATS[kind]}')")
    if kind == "card":
        body = "substring(d, 2, length(d) - 2)"
        moved = f(_ints(body), _same(10, _ints(body)), "card")
        whole = _let(f"concat(substring(d, 1, 1), {_join(moved)})", "e", f"concat(e, cast((10 - {_luhn('e', 1)} % 10) % 10 AS string))")
        return _let(_digits("m"), "d", _let(whole, "nd", _refill("m", "nd")))
    if kind == "ssn":
        # areas 001-899 without 666, groups 01-99, serials 0001-9999
        area = "IF(cast(substring(m, 1, 3) AS bigint) > 666, cast(substring(m, 1, 3) AS bigint) - 2, cast(substring(m, 1, 3) AS bigint) - 1)"
        rest = "(cast(substring(m, 5, 2) AS bigint) - 1) * 9999 + cast(substring(m, 8, 4) AS bigint) - 1"
        moved = f(f"array({area}, {rest})", "array(898L, 989901L)", "ssn")
        return _let(moved, "w", "concat(lpad(cast(IF(w[0] >= 665, w[0] + 2, w[0] + 1) AS string), 3, '0'), '-',"
                                " lpad(cast(w[1] div 9999 + 1 AS string), 2, '0'), '-', lpad(cast(w[1] % 9999 + 1 AS string), 4, '0'))")
    if kind == "ipv4":
        octets = "transform(split(m, '[.]'), o -> cast(o AS bigint))"
        return f"array_join(transform({f(octets, _same(256, octets), 'ipv4')}, z -> cast(z AS string)), '.')"
    if kind == "phone":
        moved = f(_ints("d"), _same(10, _ints("d")), "phone")
        prefix = f"substring({_digits('m')}, 1, length({_digits('m')}) - 10)"
        return _let(_core(), "d", _let(f"concat({prefix}, {_join(moved)})", "nd", _refill("m", "nd")))
    if kind == "phone_world":
        # the country code stays, so the pseudonym ends where the value ends
        code = f"IF(left(d, 1) IN ('1', '7') OR left(d, 2) IN ({', '.join(map(_quote, TWO_DIGIT_CODES.split()))}), 2, 3)"
        moved = f(_ints("substring(d, n + 1)"), _same(10, _ints("substring(d, n + 1)")), "phone_world")
        whole = _let(code, "n", f"concat(left(d, n), {_join(moved)})")
        return _let(_digits("m"), "d", _let(whole, "nd", _refill("m", "nd")))
    if kind == "iban":
        account = _letters("substring(g, 5)", "iban", key, inverse)
        check = f"lpad(cast(98 - {_mod97("concat(a, substring(g, 1, 2), '00')")} AS string), 2, '0')"
        whole = _let(account, "a", f"concat(substring(g, 1, 2), {check}, a)")
        spaced = ("array_join(transform(sequence(1, length(m)), p -> IF(substring(m, p, 1) = ' ', ' ',"
                  " substring(q, length(replace(substring(m, 1, p), ' ', '')), 1))), '')")
        return _let(_plain(), "g", _let(whole, "q", spaced))
    if kind == "access_key":
        return f"concat(substring(m, 1, 4), {_letters('substring(m, 5)', 'access_key', key, inverse)})"
    if kind == "email":
        return f"concat({_letters("substring_index(m, '@', 1)", 'email', key, inverse)}, '@', substring_index(m, '@', -1))"
    raise ValueError(kind)


def pseudonymise(docs: DataFrame, key: str = KEY, inverse: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), n_replaced, kinds, found (kind, value, pseudonym of each place).

    ``inverse`` turns pseudonyms back into the values they stand for."""
    found = _quote(pattern())
    kind = "CASE " + " ".join(f"WHEN m RLIKE {_quote('^(?:' + p + ')$')} AND {VALID[k]} THEN '{k}'" for k, p in PATTERNS.items()) + " END"
    new = "CASE k " + " ".join(f"WHEN '{k}' THEN {replacement(k, key, inverse)}" for k in PATTERNS) + " ELSE m END"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("matches", F.expr(f"CASE WHEN text RLIKE '[0-9@]|A[KS]IA' THEN regexp_extract_all(text, {found}, 0) ELSE array() END"))
    rows = rows.withColumn("found", F.expr(
        f"transform(matches, m -> {_let(kind, 'k', f"named_struct('kind', k, 'value', m, 'pseudonym', {new})")})"))
    text = f"CASE WHEN size(matches) = 0 THEN text ELSE array_join(zip_with(split(text, {found}, -1), found, (g, f) -> concat(g, coalesce(f.pseudonym, ''))), '') END"
    return (rows.withColumn("new_text", F.expr(f"CASE WHEN text IS NOT NULL THEN {text} END"))
            .withColumn("found", F.expr("coalesce(filter(found, f -> f.kind IS NOT NULL), array())"))
            .select("doc_id", F.col("new_text").alias("text"), F.size("found").alias("n_replaced"),
                    F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds"), "found"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text")).drop("found")
