"""Format-preserving pseudonyms for personal data, with built-in functions only.

Found values (mail addresses, phone, card, bank account and social security numbers,
IPv4 addresses, dates, access keys, secrets under a name that ends in "token",
"password", "secret", "key" of an api or the like) are replaced in place by a keyed
permutation of their own format, a Feistel network over the two halves of the
value: each character moves inside its class (digit, small letter, capital),
other characters stay, octets stay below 256, dates stay valid dates, a card number that passes the
Luhn check passes it again, and so do an account number (IBAN) and its check
digits.  Of a mail address the top-level domain stays, of an account number the
country.  Equal values get equal pseudonyms in every
document, different values of one format different ones.

The text around the values is untouched.  Null text stays null, "" stays "".
A calendar-impossible date is not a date and stays; so do digits that fail the
Luhn check or have no card issuer's beginning and length, unless they are
sixteen in one piece, account numbers with wrong check digits, and social
security numbers outside the ranges given out.  Rows are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: The formats, in the order in which they are tried.
NAMED = r"(?:\b|_|(?<=[a-z])(?=[A-Z]))(?:[Tt]oken|TOKEN|[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Pp]wd|PWD|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey|ACCESS[_-]?KEY)[\"']?\s{0,3}[=:]\s{0,3}"
MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
#: Lengths of bank account numbers by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{'|'.join(c.split())})\d\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
FORMATS = {
    # To the closing quote or, without one, to white space or a quote.  What follows the last letter or digit would not change.
    # What goes before is looked at only behind a sign that can end it.
    "secret": rf"(?<=[=:\s\"'])(?:(?<={NAMED}\")[^\"\r\n]*[A-Za-z0-9](?=[^\"\r\nA-Za-z0-9]*\")|(?<={NAMED}')[^'\r\n]*[A-Za-z0-9](?=[^'\r\nA-Za-z0-9]*')|(?<={NAMED}[\"']?)[^\s\"']*[A-Za-z0-9])",
    "email": rf"(?<![A-Za-z0-9._%+-]){MAIL}",
    "iban": rf"(?<![\w.])(?=[A-Z]{{2}}\d\d)(?:{IBAN})(?!\w)",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "date": r"(?<![\w-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])|(?<![\w/])(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/(?:19|20)\d\d(?![\w/])",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    # In one piece, in the groups that cards are printed in, or a whole run of digits with single separators.
    # Sixteen digits in one piece count as a card even if mistyped.
    "card": r"(?<![\w.])\d{16}(?!\w)|(?<![\w.])(?=[2-6])(?:\d{13,19}(?!\w)|\d{4}(?<sep>[ -])(?:\d{4}\k<sep>\d{4}\k<sep>\d{4}(?:\k<sep>\d{3})?|\d{6}\k<sep>\d{4,5})(?!\w)|(?<!\d[ -])(?!(?:\d+[ -]){1,9}?(?:\d{13}|\d{4}[ -](?:\d{4}[ -]\d{4}[ -]\d{4}|\d{6}[ -]\d{4,5})(?!\d)))\d(?:[ -]?\d){12,18}(?![ -]?\w))",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w.+])(?:\+[1-9]|00[1-9]\d{0,2}[ .-]\(?\d)(?:[ .()/-]{0,2}\d){6,14}(?!\w)"
    r"|(?<![\w.+-])[2-9]\d\d[2-9]\d{6}(?![\w-]|\.\d)",
}
#: First digits and lengths of cards.
ISSUED = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|220[0-4]\d{12,15}|3[47]\d{13}|3(?:0[0-5]\d|095|[689]\d\d)\d{10,15}|35(?:2[89]|[3-8]\d)\d{12,15}|(?:50|5[6-8]|6\d)\d{11,17})$"
PATTERN = "|".join(FORMATS.values())
#: What any value holds: a digit, an at sign, a sign of assignment or the beginning of a key.  Rows without it are passed by.
HINT = r"[0-9@=:]|AKIA"
DIGITS, SMALL, CAPITAL, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
DAYS = 73000  # from 1900-01-01; 292 x 250


def _digest(key: str, tweak: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), i.cast("string"), F.lit("|"), other).cast("binary"), 256)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _turn(c: Column, by: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), ((F.instr(F.lit(alphabet), c) - 1 + by) % len(alphabet) + 1).cast("int"), F.lit(1))


def _shift(half: Column, digest: Column, is_hex: Column) -> Column:
    """Each character moved inside its alphabet by the digest's byte for its place."""

    def one(c: Column, j: Column) -> Column:
        by = _number(F.substring(digest, (j % 32 * 2 + 1).cast("int"), F.lit(2)))
        return (
            F.when(is_hex & c.rlike("[0-9a-f]"), _turn(c, by, HEX))
            .when(c.between("0", "9"), _turn(c, by, DIGITS))
            .when(c.between("a", "z"), _turn(c, by, SMALL))
            .when(c.between("A", "Z"), _turn(c, by, CAPITAL))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(half, ""), one), "")


def _rounds(left: Column, right: Column, left_of, right_of) -> Column:
    """The network: odd rounds change the left half by the right one, even rounds the right by the left."""

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, left_of(acc["l"], acc["r"], i)).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(right_of(acc["l"], acc["r"], i)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), step)


def permute_string(value: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of all strings with this value's length and classes of characters."""
    half = F.floor(F.length(value) / 2).cast("int")
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, F.length(value))
    is_hex = value.rlike("^[0-9a-f]{16,}$") if tweak == "text" else F.lit(False)
    turned = _rounds(left, right, lambda a, b, i: _shift(a, _digest(key, tweak, i, b), is_hex), lambda a, b, i: _shift(b, _digest(key, tweak, i, a), is_hex))
    return F.aggregate(F.array(turned), F.lit(""), lambda _, x: F.concat(x["l"], x["r"]))


def _permute_pair(left: Column, right: Column, n_left: int, n_right: int, key: str, tweak: str) -> Column:
    def add(n):
        return lambda mine, other, i: (mine + _number(F.substring(_digest(key, tweak, i, other.cast("string")), F.lit(1), F.lit(12)))) % n

    return _rounds(left.cast("long"), right.cast("long"), lambda a, b, i: add(n_left)(a, b, i), lambda a, b, i: add(n_right)(b, a, i))


def permute_ipv4(value: Column, key: str) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    pair = _permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4")
    return F.aggregate(F.array(pair), F.lit(""), lambda _, p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string")))


def permute_date(value: Column, key: str) -> Column:
    iso = value.contains("-")
    day = F.when(iso, F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(value, F.lit("dd/MM/yyyy"))).cast("date")
    d = F.datediff(day, F.lit("1900-01-01").cast("date"))
    pair = _permute_pair(F.floor(d / 250), d % 250, DAYS // 250, 250, key, "date")
    moved = F.aggregate(F.array(pair), F.lit(0).cast("long"), lambda _, p: p["l"] * 250 + p["r"])
    rest = DAYS + (d - DAYS + _number(F.substring(_digest(key, "date", F.lit(0), F.lit("")), F.lit(1), F.lit(12)))) % 49  # the last days of 2099
    out = F.date_add(F.lit("1900-01-01").cast("date"), F.when(d < DAYS, moved).otherwise(rest).cast("int"))
    return F.coalesce(F.when(iso, F.date_format(out, "yyyy-MM-dd")).otherwise(F.date_format(out, "dd/MM/yyyy")), value)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted once."""

    def worth(c: Column, j: Column) -> Column:
        v = c.cast("int") * F.when(j % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def permute_card(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    valid = luhn_sum(digits) % 10 == 0
    body = permute_string(F.substring(value, F.lit(1), F.length(value) - 1), key, "card")
    check = (10 - luhn_sum(F.concat(F.regexp_replace(body, "[ -]", ""), F.lit("0"))) % 10) % 10
    return F.when(valid, F.concat(body, check.cast("string"))).otherwise(permute_string(value, key, "number"))


def iban_rest(characters: Column) -> Column:
    """Remainder by 97 of letters and digits read as numbers (A is 10)."""

    def step(acc: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + c.cast("int")) % 97

    return F.aggregate(F.split(characters, ""), F.lit(0), step)


def valid_iban(value: Column) -> Column:
    v = F.regexp_replace(value, " ", "")
    return iban_rest(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1


def permute_iban(value: Column, key: str) -> Column:
    """The country stays, the account moves within its classes of characters, the check digits follow."""
    body = permute_string(F.substring(value, F.lit(5), F.length(value)), key, "iban")
    country = F.substring(value, 1, 2)
    check = F.lit(98) - iban_rest(F.concat(F.regexp_replace(body, " ", ""), country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def permute_mail(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    last = F.length(value) - F.instr(F.reverse(value), ".") + 1  # the last dot
    domain = F.substring(value, at + 1, last - at - 1)
    return F.concat(permute_string(F.substring(value, F.lit(1), at - 1), key, "email"), F.lit("@"), permute_string(domain, key, "domain"), F.substring(value, last, F.length(value)))


def kind_of(value: Column) -> Column:
    return (
        F.when(value.rlike(f"^{MAIL}$"), "email")
        .when(value.rlike(rf"^(?:{IBAN})$"), "iban")
        .when(value.rlike("^AKIA[0-9A-Z]{16}$"), "key")
        .when(value.rlike(r"^(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4})$"), "date")
        .when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ipv4")
        .when(value.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card")
        .when(value.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
        .when(value.rlike(r"^\+[\d ().\/-]{7,}$|^[\d ().\/-]{10,}$"), "phone")
        .otherwise("secret")
    )


def pseudonym(value: Column, key: str) -> Column:
    kind = kind_of(value)
    plus = F.when(kind == "phone", F.regexp_extract(value, r"^(?:\+|00)[1-9]\d{0,2}[ .-]|^\+?(?:\d{1,3}[ .-]?(?=\(|\d{3}[ .-]\d{3}[ .-]\d{4}$))?", 0)).otherwise(F.lit(""))
    return (
        F.when(kind == "email", permute_mail(value, key))
        .when(kind == "iban", permute_iban(value, key))
        .when(kind == "key", F.concat(F.lit("AKIA"), permute_string(F.substring(value, 5, 16), key, "key")))
        .when(kind == "date", permute_date(value, key))
        .when(kind == "ipv4", permute_ipv4(value, key))
        .when(kind == "card", permute_card(value, key))
        .when(kind == "phone", F.concat(plus, permute_string(F.substring(value, F.length(plus) + 1, F.length(value)), key, "phone")))
        .otherwise(permute_string(value, key, "text"))
    )


def named(before: Column) -> Column:
    """Whether the text before a value names it a secret."""
    return F.substring(before, -40, 40).rlike(NAMED + r"[\"']?\z")


def stays(value: Column, before: Column) -> Column:
    """What has the form of a card or account number and is none, unless it is named a secret."""
    digits = F.regexp_replace(value, "[ -]", "")
    account = value.rlike(rf"^(?:{IBAN})$") & ~valid_iban(value) & ~named(before)
    return account | value.rlike(r"^[2-6](?:[ -]?\d){12,18}$") & ~value.rlike(r"^\d{16}$") & ~(digits.rlike(ISSUED) & (luhn_sum(digits) % 10 == 0)) & ~named(before)


def replaced(value: Column, before: Column, key: str) -> Column:
    """A secret may hold an at sign; then no part of it is a domain."""
    return F.when(stays(value, before), value).when(value.contains("@") & named(before), permute_string(value, key, "text")).otherwise(pseudonym(value, key))


def pseudonymize(df: DataFrame, key: str, text: str = "text", *, found: str | None = None) -> DataFrame:
    """Replace `text` by its pseudonymized form; `found`, if given, names a column with the number of values replaced."""
    t = F.col(f"`{text}`")
    values = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    between = F.split(t, PATTERN, -1)
    # between[0] v[0] between[1] v[1] ... : values are one fewer, so the last partner is null.
    joined = F.array_join(F.flatten(F.zip_with(between, values, lambda a, v: F.array(a, F.coalesce(replaced(v, a, key), F.lit(""))))), "")
    new = F.when(t.rlike(HINT), joined).otherwise(t).alias(text)
    kept = [new if c == text else F.col(f"`{c}`") for c in df.columns if not found or c.lower() != found.lower()]
    count = [F.coalesce(F.when(t.rlike(HINT), F.size(F.filter(values, lambda v, i: ~stays(v, between[i])))), F.lit(0)).alias(found)] if found else []
    return df.select(*kept, *count)
