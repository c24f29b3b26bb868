"""Format-preserving pseudonyms of personal data, in DataFrame operations only.

One pattern finds candidates in a text; each is validated (Luhn and mod-97 check digits, calendar dates, octets, number ranges). The valid ones
are replaced by a keyed Feistel permutation of the values of their format: a card number becomes another card number with a right
check digit, a date another date of 1900 to 2099 written the same way. Equal values get equal pseudonyms in all documents, different values
different ones; restore() undoes the permutation with the same key. The rest of a text stays as it is, byte for byte. A candidate that
doesn't validate as a whole, such as a card number beside other numbers, is searched again at each of its groups for the strict forms.

Formats: e-mail addresses (the local part; domains stay), IBANs (of the countries in IBAN_LENGTHS; the digits after the check digits), card numbers (solid or in groups of
3 to 7 digits; all but the first digit), social security numbers, phone numbers (the digits after the country code), IPv4 addresses, dates.
Case of e-mail addresses, and separators in numbers, don't matter for what is equal.

Defined cases: null text stays null with nothing found; empty text stays empty; invalid candidates stay; repeated rows repeat their
result; other columns stay, but columns named n_found or kinds are replaced. Very long texts are read whole: all repeats in the patterns are bounded (an e-mail
address has at most 10 dotted parts of 64 characters, 11 labels of 63), so neither a match's depth nor the time for one place grows with the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For the registered query, tests and examples; the operators ask for a key.
KEY = "quernel-example-key"
ROUNDS = 10
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Lengths of IBANs by country. Fixed values of the IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban_pattern() -> str:
    """Solid, or in groups of four from the start."""
    by: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by.setdefault(n, []).append(country)
    forms = []
    for n, countries in sorted(by.items()):
        fours, rest = divmod(n - 4, 4)
        forms.append(f"(?:{'|'.join(countries)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + f" ?[A-Z0-9]{{{rest}}}" * bool(rest))
    return f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})"


#: No part of a longer word, number or dotted version.
_LEFT, _RIGHT = r"(?<![A-Za-z0-9])(?<![0-9]\.)", r"(?![A-Za-z0-9])(?!\.[0-9])"
EMAIL = r"[A-Za-z0-9_%+-]{1,64}+(?:\.[A-Za-z0-9_%+-]{1,64}+){0,9}@(?:[A-Za-z0-9-]{1,63}+\.){1,10}[A-Za-z]{2,63}"
IBAN = iban_pattern()
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}"
#: A group of digits after a separator belongs to the number, unless a date begins there.
_GROUP = rf"(?!(?:{DATE})(?![0-9]))[0-9]"
_TEN = r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
PHONE = rf"{_TEN}|\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]{_GROUP}{{2,4}}|[0-9]{{2,4}}){{1,4}}"
CARD = rf"[0-9]{{13,19}}|[0-9]{{3,7}}(?:[ -]{_GROUP}{{3,7}}){{2,40}}"
#: Tried in this order at each place; the first that fits is the candidate.
KINDS = {"email": EMAIL, "iban": IBAN, "ssn": SSN, "ipv4": IPV4, "date": DATE, "phone": PHONE, "card": CARD}
CANDIDATE = rf"{_LEFT}(?:{'|'.join(KINDS.values())}){_RIGHT}"
#: What an invalid candidate is searched for: ten-digit and grouped phone numbers, and cards in their usual groups.
STRICT = {"phone": rf"{_TEN}|\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-][0-9]{{2,4}}){{1,3}}", "card": r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19}"}
INNER = rf"{_LEFT}(?=({'|'.join(STRICT.values())}){_RIGHT})"


@dataclass(frozen=True)
class Key:
    """secret, and whether pseudonyms are turned back into values."""

    secret: str
    back: bool = False


FIRST_DAY, N_DAYS = "1900-01-01", 17 * 4297  # all days of 1900 to 2099


def keyed(key: Key, kind: str, turn: Column, value: Column) -> Column:
    """Round function: a number of 52 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key.secret), F.lit(kind), turn.cast("string"), value.cast("string")).cast("binary"), 256), 1, 13), 16, 10).cast("long")


def turns(key: Key) -> Column:
    """Numbers of the rounds, in order."""
    return F.sequence(F.lit(ROUNDS), F.lit(1)) if key.back else F.sequence(F.lit(1), F.lit(ROUNDS))


def stepped(x: Column, by: Column, n: Column, key: Key) -> Column:
    """x moved on, or back, among the numbers below n."""
    return F.pmod(x - by, n) if key.back else (x + by) % n


def permute_pair(l: Column, r: Column, left: Column, right: Column, key: Key, kind: str) -> Column:  # noqa: E741
    """Feistel permutation of the pairs l, r of numbers below left and right, as a struct."""

    def turn(s: Column, i: Column) -> Column:
        new_left = F.struct(stepped(s["l"], keyed(key, kind, i, s["r"]), left, key).alias("l"), s["r"].alias("r"))
        new_right = F.struct(s["l"].alias("l"), stepped(s["r"], keyed(key, kind, i, s["l"]), right, key).alias("r"))
        return F.when(i % 2 == 1, new_left).otherwise(new_right)

    return F.aggregate(turns(key), F.struct(l.cast("long").alias("l"), r.cast("long").alias("r")), turn)


def permute(x: Column, left: Column, right: Column, key: Key, kind: str) -> Column:
    """The same of the numbers below left * right."""
    new = permute_pair(F.call_function("div", x, right), x % right, left, right, key, kind)
    # As the variable of a lambda, the pair is made once.
    return F.get(F.transform(F.array(new), lambda s: s["l"] * right + s["r"]), 0)


def number(n: int) -> Column:
    return F.lit(n).cast("long")


def chars(s: Column) -> Column:
    return F.array_remove(F.split(s, ""), "")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def permute_digits(d: Column, key: Key, kind: str) -> Column:
    """Permutation of the digit strings of one length, up to 36: a Feistel network over their two halves, so that every digit plays into every other."""
    n = F.length(d)
    ten = lambda k: F.element_at(F.array(*(number(10**i) for i in range(19))), k + 1)
    half = F.floor(n / 2).cast("int")
    value = lambda s: F.when(s == "", F.lit(0)).otherwise(s.try_cast("long"))
    new = permute_pair(value(d.substr(F.lit(1), half)), value(d.substr(half + 1, n)), ten(half), ten(n - half), key, kind)
    told = F.get(F.transform(F.array(new), lambda s: F.concat(F.when(half > 0, F.lpad(s["l"].cast("string"), half, "0")).otherwise(""), F.lpad(s["r"].cast("string"), n - half, "0"))), 0)
    return F.when(n == 0, d).otherwise(told)


def fill(m: Column, digits: Column) -> Column:
    """m with its digits replaced, in order, by others."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, digits.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(chars(m), start, put, lambda s: s["out"])


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string: every second digit from the right, but for the last, doubled, and its digits added."""
    symbols = F.reverse(F.transform(chars(d), lambda c: c.try_cast("int")))
    counted = F.transform(symbols, lambda x, i: F.when(i % 2 == 1, (x * 2) % 10 + F.floor(x * 2 / 10).cast("int")).otherwise(x))
    return F.aggregate(counted, F.lit(0), lambda a, x: a + x)


def mod97(s: Column) -> Column:
    """ISO 7064 remainder of digits and capital letters, letters as 10 to 35."""
    value = lambda c: F.instr(F.lit(ALPHABET.upper()), c) - 1
    return F.aggregate(chars(s), F.lit(0), lambda a, c: F.when(value(c) < 10, (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))


def card(m: Column, key: Key) -> Column:
    d = digits_of(m)
    n = F.length(d)
    body = F.concat(F.substring(d, 1, 1), permute_digits(d.substr(F.lit(2), n - 2), key, "card"))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    # Equal digits throughout (0000...) pass the sum but are no card numbers.
    valid = n.between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike(r"^([0-9])\1+$")
    return F.when(valid, fill(m, F.concat(body, check.cast("string"))))


def iban(m: Column, key: Key) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    n = F.length(s)
    rest = s.substr(F.lit(5), n)
    new = fill(rest, permute_digits(digits_of(rest), key, "iban"))
    check = F.lpad((98 - mod97(F.concat(new, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    valid = n.between(15, 34) & (mod97(F.concat(rest, F.substring(s, 1, 4))) == 1)
    # fill() keeps letters and spaces of m: only its digits change.
    return F.when(valid, fill(m, F.concat(check, digits_of(new))))


def ssn(m: Column, key: Key) -> Column:
    area, group, serial = (F.regexp_extract(m, "^([0-9]+)-([0-9]+)-([0-9]+)$", i).try_cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("long")
    x = permute((place * 99 + group - 1) * 9999 + serial - 1, number(898), number(99 * 9999), key, "ssn")
    a = F.floor(x / (99 * 9999)).cast("long") + 1
    a = a + (a >= 666).cast("long")
    return F.when(valid, F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(x / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((x % 9999 + 1).cast("string"), 4, "0")))


def ipv4(m: Column, key: Key) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda c: c.try_cast("long"))
    valid = F.forall(octets, lambda o: o <= 255)
    x = permute(F.aggregate(octets, number(0), lambda a, o: a * 256 + o), number(1 << 16), number(1 << 16), key, "ipv4")
    return F.when(valid, F.concat_ws(".", *(F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))))


def date(m: Column, key: Key) -> Column:
    a, x, b, c = (F.regexp_extract(m, "^([0-9]+)([./-])([0-9]+)[./-]([0-9]+)$", i) for i in (1, 2, 3, 4))
    iso = F.length(a) == 4
    # With slashes the month comes first, unless that is no date.
    day_first = ~iso & ((x == ".") | (b.try_cast("int") <= 12) & (a.try_cast("int") > 12))
    year = F.when(iso, a).otherwise(c)
    month = F.when(iso | day_first, b).otherwise(a)
    day = F.when(iso, c).when(day_first, a).otherwise(b)
    at = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
    index = F.datediff(at, F.lit(FIRST_DAY).cast("date")).cast("long")
    same = F.regexp_extract(m, "^[0-9]+([./-])[0-9]+([./-])", 1) == F.regexp_extract(m, "^[0-9]+([./-])[0-9]+([./-])", 2)
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), permute(index, number(17), number(4297), key, "date").cast("int"))
    short = (F.length(a) == 1) | (F.length(b) == 1)
    part = lambda f: F.when(short, f(new).cast("string")).otherwise(F.lpad(f(new).cast("string"), 2, "0"))
    y, mo, d = F.year(new).cast("string"), part(F.month), part(F.dayofmonth)
    out = F.when(iso, F.concat_ws("", y, x, mo, x, d)).when(day_first, F.concat_ws("", d, x, mo, x, y)).otherwise(F.concat_ws("", mo, x, d, x, y))
    return F.when(same & index.between(0, N_DAYS - 1), out)


def phone(m: Column, key: Key) -> Column:
    code = F.regexp_extract(m, r"^(\+1(?=(?:[^0-9]{0,2}[0-9]){10}$)|\+[0-9]{1,3}(?![0-9])|\+[0-9]{2})", 1)
    rest = m.substr(F.length(code) + 1, F.length(m))
    d = digits_of(rest)
    return F.when((F.length(d) >= 6) & (F.length(digits_of(m)) <= 15), F.concat(code, fill(rest, permute_digits(d, key, "phone"))))


def email(m: Column, key: Key) -> Column:
    """Letters and digits of the local part, as symbols of one alphabet, in a Feistel network over the two halves of the symbols."""
    local, domain = F.lower(F.substring_index(m, "@", 1)), F.lower(F.substring_index(m, "@", -1))
    symbols = F.transform(chars(F.regexp_replace(local, "[^a-z0-9]", "")), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = F.size(symbols)
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(0))

    def shifted(part: Column, other: Column, i: Column, name: str) -> Column:
        told = F.concat_ws(",", n.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ","))
        return F.transform(part, lambda v, j: stepped(v, keyed(key, name, F.concat_ws("-", i.cast("string"), j.cast("string")), told) % 36, number(36), key).cast("int"))

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(shifted(s["l"], s["r"], i, "email").alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i, "email").alias("r")))

    start = F.struct(F.slice(symbols, F.lit(1), half).alias("l"), F.slice(symbols, half + 1, n).alias("r"))
    new = F.aggregate(turns(key), start, turn, lambda s: F.concat(s["l"], s["r"]))
    put = lambda s, c: F.when(c.rlike("[a-z0-9]"), F.struct(F.concat(s["out"], F.lit(ALPHABET).substr(F.element_at(new, s["at"]) + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    renamed = F.aggregate(chars(local), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: s["out"])
    return F.when(local.rlike("[a-z0-9]"), F.concat_ws("@", renamed, domain))


MAKERS = {"email": email, "iban": iban, "ssn": ssn, "ipv4": ipv4, "date": date, "phone": phone, "card": card}


def pseudonym(m: Column, key: Key, kinds: dict[str, str]) -> Column:
    """Struct kind, text of a candidate: its first kind that fits and validates, in the order of kinds; null if none does."""
    options = [F.when(m.rlike(f"^(?:{pattern})$"), F.struct(F.lit(kind).alias("kind"), MAKERS[kind](m, key).alias("text"))) for kind, pattern in kinds.items()]
    return F.get(F.filter(F.array(*options), lambda o: o["text"].isNotNull()), F.lit(0))


def strict_parts(m: Column, key: Key) -> Column:
    """Struct text, kinds: an invalid candidate with the strict forms in it, if any is valid, replaced; they are tried at each of its groups, from the left."""
    tried = F.transform(F.regexp_extract_all(m, F.lit(INNER), 1), lambda x: F.struct(x.alias("was"), pseudonym(x, key, STRICT).alias("new")))
    start = F.struct(F.lit("").alias("done"), m.alias("rest"), F.array().cast("array<string>").alias("kinds"))

    def put(s: Column, x: Column) -> Column:
        at = F.instr(s["rest"], x["was"])
        taken = F.struct(
            F.concat(s["done"], s["rest"].substr(F.lit(1), at - 1), x["new"]["text"]).alias("done"),
            s["rest"].substr(at + F.length(x["was"]), F.length(s["rest"])).alias("rest"),
            F.concat(s["kinds"], F.array(x["new"]["kind"])).alias("kinds"),
        )
        return F.when(at > 0, taken).otherwise(s)

    valid = F.filter(tried, lambda x: x["new"].isNotNull())
    return F.aggregate(valid, start, put, lambda s: F.struct(F.concat(s["done"], s["rest"]).alias("text"), s["kinds"].alias("kinds")))


def replaced(m: Column, key: Key) -> Column:
    """Struct text, kinds: a candidate as it is to stand, and the kinds of the values replaced in it."""
    whole = pseudonym(m, key, KINDS)
    return F.transform(F.array(whole), lambda w: F.when(w.isNotNull(), F.struct(w["text"].alias("text"), F.array(w["kind"]).alias("kinds"))).otherwise(strict_parts(m, key)))[0]


def _rewritten(docs: DataFrame, key: Key) -> DataFrame:
    text = F.col("row.text")
    # Most texts have no candidate and are read once.
    some = docs.select(F.struct("*").alias("row")).withColumn("found", F.when(text.rlike(CANDIDATE), F.struct(F.split(text, CANDIDATE, -1).alias("gaps"), F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), 0), lambda m: replaced(m, key)).alias("hits"))))
    hits = F.col("found.hits")
    new = F.array_join(F.zip_with("found.gaps", hits, lambda g, h: F.concat(g, F.coalesce(h["text"], F.lit("")))), "")
    kinds = F.flatten(F.transform(hits, lambda h: h["kinds"]))
    out = some.select(F.col("row").withField("text", F.coalesce(new, text)).alias("row"), kinds.alias("kinds"))
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_found", "kinds")]
    n_found = F.when(F.col("kinds").isNull(), 0).otherwise(F.size("kinds")).cast("long")
    return out.select(*rest, n_found.alias("n_found"), F.coalesce(F.array_join(F.array_sort(F.array_distinct("kinds")), ","), F.lit("")).alias("kinds"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text rewritten, and n_found and kinds (how many values were replaced; of which kinds, sorted, comma-joined)."""
    return _rewritten(docs, Key(key))


def restore(docs: DataFrame, key: str) -> DataFrame:
    """pseudonymise() undone, with the same key: docs with the values, e-mail addresses in lower case."""
    return _rewritten(docs, Key(key, back=True))


def pseudonymise_texts(docs: DataFrame, key: str) -> DataFrame:
    return pseudonymise(docs.select("doc_id", "text"), key)
