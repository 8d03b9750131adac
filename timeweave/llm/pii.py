"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

Every validated value is permuted within its own format by a keyed alternating Feistel network: (l, r) in
Z_a x Z_b, where rounds add to l a keyed hash of r modulo a, and to r one of l modulo b, in turn. It is a bijection
for any a and b, so equal values stay equal in all documents and different values stay different. Where one shape has
several readings (a date with the day or the month first, a telephone number inside or outside a plan's ranges), each
reading's values are permuted among themselves, so that no two readings meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
LOWER = "0123456789abcdefghijklmnopqrstuvwxyz"
UPPER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIXED = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"
#: 1800-01-01 to 2199-12-31, a whole Gregorian cycle of 27 * 5411 days.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 27, 5411
#: Of these the days after a month's twelfth, which can't be a month's number: 9 * 9833.
LATE_A, LATE_B = 9, 9833

#: A host is one run of its characters: a repeated group would recurse once a label. An empty label is looked for afterwards.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"\bAKIA[0-9A-Z]{16}\b|\b(?i:password|passwd|pwd|secret|token|api_?key)[=:][0-9A-Za-z]{8,}\b|(?<=\")[0-9a-f]{24,}(?=\")"
IBAN = r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b"
CARD = r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)|(?<![\w+])\+\d{10,15}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\(?\d{2,8}\)?){1,5}(?!\d)"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"
ANY = "|".join((EMAIL, SECRET, IBAN, CARD, SSN, IPV4, DATE, PHONE))
#: A text without any of these holds no value of the kinds above: each alternative of ANY contains one of them.
MAYBE = r"\d{4}|@|\d\.\d|\+\d|[A-Z]{2}\d{2}|AKIA|\"[0-9a-f]{24}|(?i:password|passwd|pwd|secret|token|api_?key)[=:]"


def _noise(key: str, tweak: str, i: Column, x: Column, modulus: int) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), x.cast("string")), 256)
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), F.lit(modulus))


def permute_pair(left: Column, right: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """(l, r) permuted in Z_a x Z_b."""

    def step(acc: Column, i: Column) -> Column:
        on_left = F.struct(F.pmod(acc["l"] + _noise(key, tweak, i, acc["r"], a), F.lit(a)).alias("l"), acc["r"].alias("r"))
        on_right = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + _noise(key, tweak, i, acc["l"], b), F.lit(b)).alias("r"))
        return F.when(i % 2 == 0, on_left).otherwise(on_right)

    zero = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, step)


def permute_string(s: Column, alphabet: str, key: str, tweak: str) -> Column:
    """The characters of ``alphabet`` in ``s`` permuted by a Feistel network over its two halves, others kept.

    Halves of up to 32 characters are one hash block; longer ones use the block again.
    """
    n, letters = len(alphabet), F.lit(alphabet)

    def shift(half: Column, other: Column, i: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other), 512)

        def moved(block: Column) -> Column:
            def one(c: Column, j: Column) -> Column:
                at = F.instr(letters, c)
                add = F.conv(F.substring(block, F.pmod(j * 4, F.lit(128)) + 1, F.lit(4)), 16, 10).cast("int")
                return F.when((at == 0) | (c == ""), c).otherwise(F.substring(letters, F.pmod(at - 1 + add, F.lit(n)) + 1, F.lit(1)))

            return F.array_join(F.transform(F.split(half, ""), one), "")

        return F.transform(F.array(h), moved)[0]  # the block is hashed once, not once a character

    def step(acc: Column, i: Column) -> Column:
        on_left = F.struct(shift(acc["l"], acc["r"], i).alias("l"), acc["r"].alias("r"))
        on_right = F.struct(acc["l"].alias("l"), shift(acc["r"], acc["l"], i).alias("r"))
        return F.when(i % 2 == 0, on_left).otherwise(on_right)

    mid = F.floor(F.length(s) / 2).cast("int")
    zero = F.struct(F.substring(s, F.lit(1), mid).alias("l"), F.substring(s, mid + 1, F.length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, step, lambda a: F.concat(a["l"], a["r"]))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted once."""
    back = F.split(F.reverse(digits), "")

    def one(d: Column, i: Column) -> Column:
        x = d.cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(back, one), F.lit(0), lambda acc, x: acc + x)


def mod97(s: Column) -> Column:
    """Letters as 10 to 35, the whole decimal string modulo 97."""

    def step(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit(UPPER), c) - 1
        return (F.when(v > 9, acc * 100).otherwise(acc * 10) + v) % 97

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""

    def one(c: Column, i: Column) -> Column:
        seen = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("^[0-9]$"), F.substring(digits, seen, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _padded(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value) for a matched string; null where it doesn't validate."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    tight = F.regexp_replace(m, " ", "")

    # all digits but the check digit, as one string; the check digit is made anew
    body = permute_string(F.substring(digits, F.lit(1), F.length(digits) - 1), "0123456789", key, "card")
    card = refill(m, F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    card_ok = luhn_sum(digits) % 10 == 0

    bban = permute_string(F.substring(tight, 5, 99), "0123456789", key, "iban")
    country = F.substring(m, 1, 2)
    check = _padded(98 - mod97(F.concat(bban, country, F.lit("00"))), 2)
    iban_digits = F.regexp_replace(F.concat(check, bban), "[^0-9]", "")
    iban_ok = F.length(tight).between(15, 34) & (mod97(F.concat(F.substring(tight, 5, 99), F.substring(m, 1, 4))) == 1)

    area, group, serial = (F.substring(digits, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    ssn_ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    area_at = area - 1 - (area > 666).cast("int")
    p = permute_pair(area_at * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def ssn_text(q: Column) -> Column:
        a = F.floor(q["l"] / 99)
        return F.format_string("%03d-%02d-%04d", a + 1 + (a >= 665).cast("int"), F.pmod(q["l"], F.lit(99)) + 1, q["r"] + 1)

    ten = F.substring(digits, F.length(digits) - 9, F.lit(10))
    planned = (~m.startswith("+") | m.startswith("+1")) & F.length(digits).isin(10, 11)
    nanp_ok = planned & ten.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    v = ten.cast("bigint")
    number = (F.floor(v / 10000000) - 200) * 8000000 + (F.pmod(F.floor(v / 10000), F.lit(1000)) - 200) * 10000 + F.pmod(v, F.lit(10000))
    q = permute_pair(F.floor(number / 80000), F.pmod(number, F.lit(80000)), 80000, 80000, key, "nanp")

    def nanp_text(q: Column) -> Column:
        x = q["l"] * 80000 + q["r"]
        new = F.format_string("%03d%03d%04d", F.floor(x / 8000000) + 200, F.pmod(F.floor(x / 10000), F.lit(800)) + 200, F.pmod(x, F.lit(10000)))
        return refill(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), new))

    # the first digits are the country code; a number of another plan keeps two
    other = refill(m, F.concat(F.substring(digits, 1, 2), permute_string(F.substring(digits, 3, 99), "0123456789", key, "phone")))
    # one outside the plan's ranges keeps the two digits that put it there
    loose = permute_string(F.concat(F.substring(ten, 2, 2), F.substring(ten, 5, 6)), "0123456789", key, "loose")
    outside = refill(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), F.substring(ten, 1, 1), F.substring(loose, 1, 2), F.substring(ten, 4, 1), F.substring(loose, 3, 6)))
    phone_ok = F.length(digits).between(8, 15)

    octet = F.split(m, r"\.")
    ip = permute_pair(octet[0].cast("int") * 256 + octet[1].cast("int"), octet[2].cast("int") * 256 + octet[3].cast("int"), 65536, 65536, key, "ipv4")

    def ip_text(q: Column) -> Column:
        return F.concat_ws(".", *[x.cast("string") for h in "lr" for x in (F.floor(q[h] / 256), F.pmod(q[h], F.lit(256)))])

    first = F.lit(FIRST_DAY).cast("date")

    def late(at: Column) -> Column:
        """A day after a month's twelfth as struct(rank among these days)."""
        month = (F.year(at) - 1800) * 12 + F.month(at) - 1
        return F.datediff(at, first) - (month + 1) * 12

    def late_day(rank: Column) -> Column:
        """The day of a rank: the month is within one of what the mean length of a month says."""
        begun = lambda k: F.datediff(F.add_months(first, k), first) - k * 12
        near = F.floor((rank + 0.5) / (DAYS_A * DAYS_B / 4800 - 12)).cast("int")
        month = F.greatest(*[F.when(begun(near + d) <= rank, near + d) for d in (-1, 0, 1)])
        return F.date_add(F.add_months(first, month), (rank - begun(month) + 12).cast("int"))

    day = None
    for shape, fmt in (("-", "yyyy-MM-dd"), ("/", "MM/dd/yyyy"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy")):
        at = F.to_date(F.try_to_timestamp(m, F.lit(fmt)))
        n = F.datediff(at, first)
        if fmt == "dd/MM/yyyy":
            moved = permute_pair(F.floor(late(at) / LATE_B), F.pmod(late(at), F.lit(LATE_B)), LATE_A, LATE_B, key, "late")
            moved = F.transform(F.array(moved), lambda z: late_day(z["l"] * LATE_B + z["r"]))[0]
        else:
            moved = permute_pair(F.floor(n / DAYS_B), F.pmod(n, F.lit(DAYS_B)), DAYS_A, DAYS_B, key, "date")
            moved = F.transform(F.array(moved), lambda z: F.date_add(first, (z["l"] * DAYS_B + z["r"]).cast("int")))[0]
        hit = m.contains(shape) & n.between(0, DAYS_A * DAYS_B - 1)
        text = F.date_format(moved, fmt)
        day = F.when(hit, text) if day is None else day.when(hit, text)

    def named(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    def held(x: Column, text) -> Column:
        return F.transform(F.array(x), text)[0]

    at_sign = F.instr(m, "@")
    whole = ~m.contains("..")
    # an address ends before an empty label; what follows stays as it is
    address = F.when(whole, m).otherwise(F.regexp_extract(F.substring_index(m, "..", 1), EMAIL, 0))
    dot = F.length(address) - F.instr(F.reverse(address), ".") + 1
    email = F.concat(permute_string(F.lower(F.substring(address, F.lit(1), dot - 1)), LOWER, key, "email"), F.substring(m, dot, F.length(m)))
    sep = F.length(F.regexp_extract(m, "^[^=:]*[=:]", 0))
    tail = F.substring(m, sep + 1, F.length(m))
    secret = F.concat(F.substring(m, F.lit(1), sep), permute_string(tail, MIXED, key, "secret"))
    full = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return (
        F.when(at_sign > 0, F.when(address != "", named("email", email)))
        .when(full(r"AKIA[0-9A-Z]{16}"), named("secret", F.concat(F.lit("AKIA"), permute_string(F.substring(m, 5, 16), UPPER, key, "akia"))))
        .when(full(r"[A-Za-z_]+[=:].*"), named("secret", secret))
        .when(full(r"[0-9a-f]{24,}"), named("secret", permute_string(m, HEX, key, "hex")))
        .when(full(r"[A-Z]{2}\d{2}.*"), F.when(iban_ok, named("iban", F.concat(country, refill(F.substring(m, 3, 99), iban_digits)))))
        .when(full(r"\d{3}-\d{2}-\d{4}"), F.when(ssn_ok, named("ssn", held(p, ssn_text))))
        .when(full(r"\d{1,3}(\.\d{1,3}){3}"), named("ipv4", held(ip, ip_text)))
        .when(full(DATE), F.when(day.isNotNull(), named("date", day)))
        .when(full(r"\d[\d -]*") & ~full(r"\d{3}-\d{3}-\d{4}"), F.when(card_ok, named("card", card)))
        .when(nanp_ok, named("phone", held(q, nanp_text)))
        .when(planned, named("phone", outside))
        .when(phone_ok, named("phone", other))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``text`` with every validated e-mail address, card, IBAN, social security, phone and IPv4 number, date and
    credential replaced by its pseudonym; with ``found``, a column of the kinds replaced, in order.

    Values that do not validate (Luhn, modulo 97, calendar, the years 1800 to 2199, lengths) stay. Lengths in
    characters stay, but for IPv4 numbers, whose octets may have other numbers of digits. Letters of addresses are
    lower-cased first, as they name the same mailbox; a card or phone number has the same digits' pseudonym whatever
    its separators. A number outside the North American plan's ranges keeps the digits that put it there, one of
    another country its first two. Null texts stay null, empty ones empty; whole texts are read; repeated rows give
    equal results; an empty table gives an empty one. Other columns are kept whatever their names, but for one named
    as ``found`` is, which is replaced.
    """
    t = F.col(text)
    hit = t.rlike(MAYBE) & t.rlike(ANY)
    made = F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p")))
    none = F.array().cast("array<string>")

    def replaced(x: Column) -> Column:
        """struct(text, kinds) from struct(made, gaps)."""
        pieces = F.transform(x["made"], lambda y, i: F.concat(F.coalesce(y["p"]["value"], y["m"]), F.element_at(x["gaps"], i + 2)))
        whole = F.array_join(F.concat(F.slice(x["gaps"], 1, 1), pieces), "")
        kinds = F.filter(F.transform(x["made"], lambda y: y["p"]["kind"]), lambda k: k.isNotNull())
        return F.struct(whole.alias("text"), kinds.alias("kinds"))

    got = F.transform(F.array(F.struct(made.alias("made"), F.split(t, ANY, -1).alias("gaps"))), replaced)[0]
    told = F.when(hit, got).otherwise(F.struct(t.alias("text"), none.alias("kinds")))
    rest = [c for c in docs.columns if c != found]
    name = "_told"
    while name in rest:
        name += "_"
    df = docs.select(*rest, told.alias(name))
    columns = [F.col(f"{name}.text").alias(c) if c == text else F.col(c) for c in rest]
    return df.select(*columns, *([F.col(f"{name}.kinds").alias(found)] if found else []))
