"""Format-preserving pseudonyms for validated numbers and dates, in DataFrame functions only.

Each value is permuted by a keyed Feistel network within the values of its own format: a card number becomes a card
number with a right check digit, a date a date of 1900-2099, a phone number one of the same layout. Networks on mixed
radices are exact permutations; where a format is a part of the network's domain, the walk goes on until it is met
again (cycle walking), which keeps it a permutation of the format. Equal values so stay linked across documents, and
different ones stay different. E-mail addresses, which have no number format, get a keyed name.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: What is looked for, tried in this order at each place.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
LONG_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DAY, DAY_1 = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|[12][0-9]|3[01])"
MONTH, MONTH_1, YEAR = "(?:0[1-9]|1[0-2])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
#: Month names of dates in words: fixed values, long and short English and German ones, long French and Spanish ones.
MONTH_NAMES = [
    "january february march april may june july august september october november december".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "jan feb mär apr mai jun jul aug sep okt nov dez".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
]
NAMED = "|".join(sorted({form for names in MONTH_NAMES for n in names for form in (n, n.capitalize())}, key=lambda n: (-len(n), n)))
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:.])",
    "iso_date": rf"(?<![0-9.-]){YEAR}(?:-{MONTH}-{DAY}|/{MONTH}/{DAY})(?![0-9-])",
    "iso_date_1": rf"(?<![0-9.-]){YEAR}-{MONTH_1}-{DAY_1}(?![0-9-])",
    "point_date": rf"(?<![0-9.]){DAY}\.{MONTH}\.{YEAR}(?![0-9])",
    "point_date_1": rf"(?<![0-9.]){DAY_1}\.{MONTH_1}\.{YEAR}(?![0-9])",
    "month_date": rf"(?<![0-9/]){MONTH}/{DAY}/{YEAR}(?![0-9/])",
    "month_date_1": rf"(?<![0-9/]){MONTH_1}/{DAY_1}/{YEAR}(?![0-9/])",
    "day_date": rf"(?<![0-9/])(?:1[3-9]|2[0-9]|3[01])/{MONTH}/{YEAR}(?![0-9/])",
    "day_date_1": rf"(?<![0-9/])(?:1[3-9]|2[0-9]|3[01])/{MONTH_1}/{YEAR}(?![0-9/])",
    "word_date": rf"\b(?:{MONTHS}) {DAY_1}, {YEAR}(?![0-9])",
    "long_date": rf"\b(?:{LONG_MONTHS}) {DAY_1}, {YEAR}(?![0-9])",
    "day_named": rf"(?<![0-9\p{{L}}]){DAY_1}(?:\.|st|nd|rd|th)? (?:de )?(?:{NAMED})(?:,| de)? {YEAR}(?![0-9])",
    "named_day": rf"(?<!\p{{L}})(?:{NAMED}) {DAY_1}(?:st|nd|rd|th)?,? {YEAR}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "cards": r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){2,}(?:[ .-][0-9]{1,3})?(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "trunk": r"(?<![0-9+/.,-])(?:(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /-])[0-9]{3,8}(?:[ -][0-9]{2,5}){0,2}|0[1-9](?:[ .-][0-9]{2}){4})(?![0-9])",
    "e164": r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,12})){1,4}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
KINDS = ("email", "iban", "date", "ip", "ssn", "card", "phone")
FIRST_DAY, DAYS = "1900-01-01", 73049
#: Layouts of the date patterns.
LAYOUTS = {
    "iso_date": "yyyy-MM-dd", "iso_date_1": "yyyy-M-d", "point_date": "dd.MM.yyyy", "point_date_1": "d.M.yyyy", "month_date": "MM/dd/yyyy", "month_date_1": "M/d/yyyy",
    "day_date": "dd/MM/yyyy", "day_date_1": "d/M/yyyy", "word_date": "MMM d, yyyy", "long_date": "MMMM d, yyyy",
}


#: A key is a string, or a column that holds one, so that plans don't show it.
Key = str | Column
#: Country calling codes of one and two digits; all others have three. Fixed values.
CODES_1 = "1 7".split()
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _keyed(key: Key, tweak: str, i: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Key, tweak: str) -> Column:
    """struct(l, r): ROUNDS alternating rounds on Z_a x Z_b."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + F.pmod(_keyed(key, tweak, i, s["r"]), a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(_keyed(key, tweak, i, s["l"]), b), b)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted(x: Column, a: Column, b: Column, key: Key, tweak: str) -> Column:
    """A permutation of 0 .. a*b - 1."""
    out = feistel(_over(x, b), F.pmod(x, b), a, b, key, tweak)
    return F.transform(F.array(out), lambda o: o["l"] * b + o["r"])[0]


def _over(x: Column, b: Column) -> Column:
    """x div b on longs."""
    return F.call_function("div", x, b)


def walked(x: Column, a: Column, b: Column, key: Key, tweak: str, same: Callable[[Column], Column], most: int) -> Column:
    """The permutation repeated until ``same`` holds; ``most`` steps miss it with a chance below 1e-25."""

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(F.transform(F.array(permuted(s["x"], a, b, key, tweak)), lambda y: F.struct(y.alias("x"), same(y).alias("done")))[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(x.cast("long").alias("x"), F.lit(False).alias("done")), step)["x"]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def with_digits(m: Column, new: Column) -> Column:
    """m with its digits replaced in order by those of ``new``; all else stays in place."""
    char = lambda i: F.substring(m, i, F.lit(1))
    number = lambda i: F.length(digits(F.substring(m, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(char(i).rlike("[0-9]"), F.substring(new, number(i), F.lit(1))).otherwise(char(i))), "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(d: Column, key: Key, tweak: str) -> Column:
    """A permutation of the digit strings of d's length (2 to 36)."""
    n = F.length(d)
    a = _over(n, F.lit(2)).cast("int")
    b = n - a
    out = feistel(F.substring(d, F.lit(1), a).cast("long"), F.substring(d, a + 1, b).cast("long"), _power(a), _power(b), key, tweak)
    pair = F.transform(F.array(out), lambda o: F.concat(F.lpad(o["l"].cast("string"), a, "0"), F.lpad(o["r"].cast("string"), b, "0")))
    return pair[0]


def luhn_sum(d: Column, doubled: int) -> Column:
    """Luhn sum; ``doubled`` is 0 or 1: the parity, counted from the last digit, of the digits that are doubled."""
    n = F.length(d)
    one = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == doubled, twice(one(i))).otherwise(one(i)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def card(m: Column, key: Key) -> Column:
    """Permuted body and a right check digit; null if m fails the Luhn check."""
    d = digits(m)
    body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    full = F.transform(F.array(body), lambda x: F.concat(x, ((10 - luhn_sum(x, 0) % 10) % 10).cast("string")))[0]
    return F.when(luhn_sum(d, 1) % 10 == 0, F.transform(F.array(full), lambda x: with_digits(m, x))[0])


def cards(m: Column, key: Key) -> Column:
    """All cards in a run of groups of four and perhaps a shorter last one; null if there is none.

    Of the cards that begin at a group (19 digits, 16 or 13) the leftmost and then longest counts, then the next one
    behind it, so that numbers beside a card (another number, an expiry date, a security code) do not hide it.
    """
    d = digits(m)
    n = F.length(d)

    def step(s: Column, i: Column) -> Column:
        fit = lambda k: (i + k <= n) & ((F.lit(16) == k) | (i + k == n)) & (luhn_sum(F.substring(d, i + 1, k), 1) % 10 == 0)
        size = F.get(F.filter(F.array(F.lit(19), F.lit(16), F.lit(13)), fit), F.lit(0))
        found = F.struct((i + size).alias("next"), F.concat(s["out"], card(F.substring(d, i + 1, size), key)).alias("out"), F.lit(True).alias("any"))
        group = F.struct((i + 4).alias("next"), F.concat(s["out"], F.substring(d, i + 1, F.lit(4))).alias("out"), s["any"].alias("any"))
        return F.when(i < s["next"], s).when(size.isNotNull(), found).otherwise(group)

    start = F.struct(F.lit(0).alias("next"), F.lit("").alias("out"), F.lit(False).alias("any"))
    whole = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(4)), start, step, lambda s: F.when(s["any"], F.concat(s["out"], F.substring(d, s["next"] + 1, n))))
    return F.transform(F.array(whole), lambda x: F.when(x.isNotNull(), with_digits(m, x)))[0]


def ssn(m: Column, key: Key) -> Column:
    def valid(x: Column) -> Column:
        area, rest = _over(x, F.lit(1_000_000)), F.pmod(x, F.lit(1_000_000))
        return (area > 0) & (area != 666) & (area < 900) & (rest >= 10_000) & (F.pmod(rest, F.lit(10_000)) > 0)

    x = digits(m).cast("long")
    new = walked(x, F.lit(10_000), F.lit(100_000), key, "ssn", valid, 30)
    return F.when(valid(x), with_digits(m, F.lpad(new.cast("string"), 9, "0")))


def phone(m: Column, key: Key) -> Column:
    """The ten national digits are permuted among plans of the same validity (area and exchange from 2)."""
    d = digits(m)
    plan = lambda x: (x >= 2_000_000_000) & (F.pmod(x, F.lit(10_000_000)) >= 2_000_000)
    national = F.substring(d, F.length(d) - 9, F.lit(10)).cast("long")
    was = plan(national)
    new = walked(national, F.lit(100_000), F.lit(100_000), key, "phone", lambda x: plan(x) == was, 60)
    return with_digits(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), F.lpad(new.cast("string"), 10, "0")))


def trunk(m: Column, key: Key) -> Column:
    """A national number with a leading 0, which stays and is followed by no other 0; null beyond 9 to 12 digits."""
    d = digits(m)
    n = F.length(d) - 1
    a = _over(n, F.lit(2)).cast("int")
    new = walked(F.substring(d, F.lit(2), n).cast("long"), _power(a), _power(n - a), key, "trunk", lambda x: x >= _power(n - 1), 30)
    return F.when(n.between(8, 11), F.transform(F.array(new), lambda x: with_digits(m, F.concat(F.lit("0"), x.cast("string"))))[0])


def e164(m: Column, key: Key) -> Column:
    """The country's code and the layout stay, the other digits are permuted; null beyond 8 to 15 digits."""
    d = digits(m)
    size = F.when(F.substring(d, 1, 1).isin(CODES_1), 1).when(F.substring(d, 1, 2).isin(CODES_2), 2).otherwise(3)
    new = F.concat(F.substring(d, F.lit(1), size), permuted_digits(F.substring(d, size + 1, F.length(d) - size), key, "e164"))
    return F.when(F.length(d).between(8, 15), F.transform(F.array(new), lambda x: with_digits(m, x))[0])


def ipv6(m: Column, key: Key) -> Column:
    """An address of eight groups; ways to write the same address give the same one. Null if groups are missing."""
    half = F.split(m, "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(half, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    gap = 8 - F.size(groups(0)) - F.size(groups(1))
    full = F.transform(F.concat(groups(0), F.array_repeat(F.lit("0"), gap), groups(1)), lambda g: F.conv(g, 16, 10).cast("long"))
    # four numbers of 32 bits: two networks, crossed by a third and fourth
    two = lambda a, b, t: F.transform(F.array(feistel(a, b, F.lit(1 << 32), F.lit(1 << 32), key, t)), lambda o: F.array(o["l"], o["r"]))[0]
    number = lambda i: F.get(full, F.lit(2 * i)) * 65536 + F.get(full, F.lit(2 * i + 1))
    first = F.struct(two(number(0), number(1), "ipv6-a").alias("a"), two(number(2), number(3), "ipv6-b").alias("b"))
    second = F.transform(F.array(first), lambda x: F.struct(two(x["a"][0], x["b"][0], "ipv6-c").alias("a"), two(x["a"][1], x["b"][1], "ipv6-d").alias("b")))[0]
    hexes = lambda x: F.concat(F.lower(F.hex(_over(x, F.lit(65536)))), F.lit(":"), F.lower(F.hex(F.pmod(x, F.lit(65536)))))
    text = F.transform(F.array(second), lambda x: F.array_join(F.transform(F.concat(x["a"], x["b"]), hexes), ":"))[0]
    return F.when(F.when(m.contains("::"), gap > 0).otherwise(gap == 0), text)


def ip(m: Column, key: Key) -> Column:
    part = F.split(m, r"\.")
    octet = [F.get(part, F.lit(i)).cast("long") for i in range(4)]
    out = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, "ip")
    new = F.transform(F.array(out), lambda o: F.concat_ws(".", _over(o["l"], F.lit(256)), F.pmod(o["l"], F.lit(256)), _over(o["r"], F.lit(256)), F.pmod(o["r"], F.lit(256))))[0]
    valid = F.forall(part, lambda p: p.cast("int") < 256)
    return F.when(valid, new)


def date(m: Column, layout: str, key: Key) -> Column:
    """A date of 1900-2099 in the same layout; null if m is no date (30 February). A day-first layout with slashes,
    which only days after the 12th tell from a month-first one, stays among such days."""
    first = F.to_date(F.lit(FIRST_DAY))
    index = F.datediff(F.try_to_date(m, layout), first)
    tells = lambda x: F.dayofmonth(F.date_add(first, F.least(x, F.lit(DAYS - 1)).cast("int"))) > 12
    same = (lambda x: (x < DAYS) & tells(x)) if layout in ("dd/MM/yyyy", "d/M/yyyy") else (lambda x: x < DAYS)
    new = walked(index, F.lit(271), F.lit(270), key, "date", same, 60)
    return F.date_format(F.date_add(first, new.cast("int")), layout)


def named_date(m: Column, key: Key) -> Column:
    """A date whose month is a word, in the same language and layout; null if it is no date.

    A point behind the day tells German from English where both have the name.
    """
    word = F.regexp_extract(m, r"\p{L}{3,}", 0)
    lists = [F.array(*[F.lit(n) for n in names]) for names in MONTH_NAMES]
    german_first = F.array(*[lists[k] for k in (2, 3, 0, 1, 4, 5)])
    fits = F.filter(F.when(m.rlike(r"^[0-9]{1,2}\."), german_first).otherwise(F.array(*lists)), lambda names: F.array_contains(names, F.lower(word)))
    day = F.regexp_extract(m, r"(?<![0-9])([0-9]{1,2})(?![0-9])", 1)
    parts = F.struct(F.get(fits, F.lit(0)).alias("names"), day.alias("day"), word.alias("word"))
    first = F.to_date(F.lit(FIRST_DAY))

    def changed(p: Column) -> Column:
        was = F.try_to_date(F.concat_ws("-", F.right(m, F.lit(4)), F.array_position(p["names"], F.lower(p["word"])).cast("string"), p["day"]), "yyyy-M-d")
        new = walked(F.datediff(was, first), F.lit(271), F.lit(270), key, "date", lambda x: x < DAYS, 60)
        return F.when(was.isNotNull(), F.transform(F.array(F.date_add(first, new.cast("int"))), lambda d: shown(p, d))[0])

    def shown(p: Column, d: Column) -> Column:
        number = F.dayofmonth(d)
        ending = F.when(number.between(11, 13), "th").otherwise(F.coalesce(*[F.when(number % 10 == k, e) for k, e in ((1, "st"), (2, "nd"), (3, "rd"))], F.lit("th")))
        name = F.get(p["names"], F.month(d) - 1)
        name = F.when(p["word"] == F.lower(p["word"]), name).otherwise(F.initcap(name))
        text = F.when(p["day"].startswith("0"), F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
        text = F.when(m.rlike("[0-9](?:st|nd|rd|th)"), F.concat(text, ending)).otherwise(text)
        return F.regexp_replace(F.replace(F.regexp_replace(m, F.lit("(?<![0-9])[0-9]{1,2}(?:st|nd|rd|th)?(?![0-9])"), text), p["word"], name), F.lit("[0-9]{4}$"), F.date_format(d, "yyyy"))

    return F.transform(F.array(parts), changed)[0]


def mod97(s: Column) -> Column:
    """Remainder of the number that s spells, letters being 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: value(F.substring(s, i, F.lit(1))))
    return F.aggregate(chars, F.lit(0), lambda r, v: F.pmod(r * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def iban(m: Column, key: Key) -> Column:
    """The account's digits are permuted and the check digits set right; null if no check holds.

    The longest beginning of m that ends with a group and holds counts, so that a word behind it does not hide it.
    """
    ends = F.filter(F.sequence(F.length(m), F.lit(15), F.lit(-1)), lambda n: (n == F.length(m)) | (F.substring(m, n + 1, F.lit(1)) == " "))
    heads = F.filter(F.when(F.length(m) >= 15, ends), lambda n: F.substring(m, n, F.lit(1)) != " ")
    flat = lambda n: F.upper(F.replace(F.substring(m, F.lit(1), n), F.lit(" "), F.lit("")))
    holds = lambda x: mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1
    found = F.get(F.filter(heads, lambda n: (F.length(flat(n)) >= 15) & holds(flat(n))), F.lit(0))

    def changed(n: Column) -> Column:
        head, own = F.substring(flat(n), 1, 2), F.substring(flat(n), F.lit(5), F.length(flat(n)))
        new = F.when(F.length(digits(own)) > 1, with_digits(own, permuted_digits(digits(own), key, "iban"))).otherwise(own)
        check = lambda x: F.lpad((98 - mod97(F.concat(x, head, F.lit("00")))).cast("string"), 2, "0")
        full = F.transform(F.array(new), lambda x: F.concat(check(x), digits(x)))[0]
        text = F.transform(F.array(full), lambda x: with_digits(F.substring(m, F.lit(1), n), x))[0]
        return F.concat(text, F.substring(m, n + 1, F.length(m)))

    return F.transform(F.array(found), lambda n: F.when(n.isNotNull(), changed(n)))[0]


def email(m: Column, key: Key) -> Column:
    name = F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16)
    return F.concat(F.lit("u"), name, F.lit("@example.invalid"))


def pseudonym(m: Column, key: Key) -> Column:
    """struct(kind, text) of one match; kind is null and the text unchanged if no format validates it."""
    full = lambda p: m.rlike(rf"\A(?:{PATTERNS[p]})\z")
    dates = [("date", full(p) & (m.contains("-") if p == "iso_date" else F.lit(True)), date(m, layout, key)) for p, layout in LAYOUTS.items()]
    forms = [
        ("email", full("email"), email(m, key)),
        ("iban", full("iban"), iban(m, key)),
        ("ip", full("ipv6"), ipv6(m, key)),
        *dates,
        ("date", full("iso_date"), date(m, "yyyy/MM/dd", key)),
        ("date", full("day_named") | full("named_day"), named_date(m, key)),
        ("ip", full("ip"), ip(m, key)),
        ("ssn", full("ssn"), ssn(m, key)),
        ("card", full("cards"), cards(m, key)),
        ("card", full("card"), card(m, key)),
        ("phone", full("phone"), phone(m, key)),
        ("phone", full("trunk"), trunk(m, key)),
        ("phone", full("e164"), e164(m, key)),
    ]
    choice = F.lit(None).cast("struct<kind:string,text:string>")
    for kind, is_form, new in reversed(forms):
        choice = F.when(is_form, F.struct(F.lit(kind).alias("kind"), new.alias("text"))).otherwise(choice)
    kept = lambda c: F.struct(F.when(c["text"].isNotNull(), c["kind"]).alias("kind"), F.coalesce(c["text"], m).alias("text"))
    return F.transform(F.array(choice), kept)[0]


def session_key(spark: SparkSession) -> str:
    """The key in the setting ``lodestack.pii.key``; where it is unset, one is drawn for the session and kept there."""
    if not (key := spark.conf.get("lodestack.pii.key", None)):
        spark.conf.set("lodestack.pii.key", key := secrets.token_hex(16))
    return key


def pseudonymize(docs: DataFrame, key: Key, text_col: str = "text") -> DataFrame:
    """docs with the text's validated values replaced, and n_<kind> counts of them for each of KINDS.

    Whole texts; null stays null and empty stays empty, with counts of 0. Candidates that fail their validation
    stay as they are. Whoever has the key can invert the pseudonyms, so there is no default, and the key reaches the
    tasks as a one-row table: no plan, log or page of Spark shows it. Rows are handled one by one, so repeats stay
    repeats and nothing is shuffled; an empty table gives no rows. Columns named n_<kind> that docs has already are
    replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(text_col)
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    some = F.when(text.rlike("[0-9@]"), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, F.col("__key"))))
    found = docs.drop(*[f"n_{k}" for k in KINDS]).withColumn("__key", secret).withColumn("__new", some).drop("__key")
    gaps = F.split(text, ANY, -1)
    new = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("__new"), i)["text"], F.lit(""))))
    kinds = F.transform("__new", lambda x: x["kind"])
    counts = [F.coalesce(F.size(F.array_compact(kinds)) - F.size(F.array_remove(F.array_compact(kinds), k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    changed = F.when(F.size("__new") > 0, F.array_join(new, "")).otherwise(text)
    return found.select(*[changed.alias(c) if c == text_col else F.col(c) for c in found.columns if c != "__new"], *counts)
