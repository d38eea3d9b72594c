"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OPEN, _ESCAPE = "", ""

# Candidates; each is validated before it is replaced.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE_ISO = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
DATE_SLASH = r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])"
DATE_DOT = r"(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
PHONE = r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)\([2-9]\d{2}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])[2-9]\d{2}([.-])\d{3}\1\d{4}(?![\d.-]\d|\d)"
PHONE_OTHER = r"(?<![\d+])\+(?!1[ .(-]?\(?\d)[1-9]\d{0,2}[ .-]?(?:\(?\d+\)?[ .-]?){1,5}\d{2,}(?!\d)"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"

#: First and last day of the calendar's 400-year cycle in which dates are permuted.
FIRST_DAY, DAYS = "1800-01-01", 146_097  # 146,097 = 189 * 773
#: Steps in which a walk comes back to a writing that a fifth of all days have; it needs about 5.
WALK = 500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used in there."""
    return F.get(F.transform(F.array(value), body), 0)


Permute = Callable[[str | Column, Column, Column, Column | int, Column | int], Column]


def feistel(key: str, inverse: bool = False) -> Permute:
    """A keyed permutation of pairs (x below a, y below b): rounds add a hash of one half, modulo
    its size, to the other.  ``inverse`` undoes it."""

    def permute(kind: str | Column, x: Column, y: Column, a: Column | int, b: Column | int) -> Column:
        a, b = (F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in (a, b))

        def add(r: Column, half: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, r.cast("string"), a.cast("string"), b.cast("string"), half.cast("string")), 256)
            h = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
            return -h if inverse else h

        def step(s: Column, r: Column) -> Column:
            left = F.struct(F.pmod(s["x"] + add(r, s["y"]), a).alias("x"), s["y"].alias("y"))
            right = F.struct(s["x"].alias("x"), F.pmod(s["y"] + add(r, s["x"]), b).alias("y"))
            return F.when(r % 2 == 0, left).otherwise(right)

        order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
        return F.aggregate(F.array(*(F.lit(r) for r in order)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)

    return permute


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _number(s: Column, start: int | Column, length: int | Column) -> Column:
    return F.substr(s, F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length).cast("long")


def _padded(n: Column, width: int | Column) -> Column:
    return F.lpad(n.cast("string"), width if isinstance(width, int) else width, F.lit("0"))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by those of ``digits`` in order."""
    return let(digits, lambda d: _filled(shape, d))


def _filled(shape: Column, digits: Column) -> Column:
    def one(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum whose last digit is 0 if the last digit of a number is its Luhn check digit."""

    def total(back: Column) -> Column:
        def one(i: Column) -> Column:
            d = F.substr(back, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + one(i))

    return let(F.reverse(digits), total)


def _digit_string(permute: Permute, kind: str, s: Column) -> Column:
    """A digit string of up to 36 digits as another of the same length."""
    n = F.length(s)
    u = F.floor(n / 2).cast("int")
    v = n - u
    pair = permute(kind, F.coalesce(_number(s, 1, u), F.lit(0)), _number(s, u + 1, v), F.pow(F.lit(10), u), F.pow(F.lit(10), v))
    return let(pair, lambda p: F.concat(F.when(u > 0, _padded(p["x"], u)).otherwise(""), _padded(p["y"], v)))


def _card(permute: Permute, m: Column) -> Column:
    d = _digits(m)
    new = let(_digit_string(permute, "card", F.substr(d, F.lit(1), F.length(d) - 1)), lambda body: F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"), _refilled(m, new))


def _ip(permute: Permute, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    pair = permute("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)

    def dotted(p: Column) -> Column:
        parts = [F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256]
        return F.concat_ws(".", *(x.cast("long").cast("string") for x in parts))

    return F.when(F.forall(o, lambda x: x <= 255), let(pair, dotted))


def _phone(permute: Permute, m: Column) -> Column:
    d = F.right(_digits(m), F.lit(10))
    area = _number(d, 1, 3)
    least = F.when(area < 200, 0).otherwise(200)  # area codes in use are permuted among themselves
    pair = permute("phone", area - least, _number(d, 4, 7), F.when(area < 200, 200).otherwise(800), 10**7)
    first = F.when(F.length(_digits(m)) > 10, "1").otherwise("")
    return _refilled(m, let(pair, lambda p: F.concat(first, _padded(p["x"] + least, 3), _padded(p["y"], 7))))


def _phone_other(permute: Permute, m: Column) -> Column:
    d = _digits(m)
    kept = F.length(F.regexp_extract(m, r"^\+(\d{1,3})", 1))  # the country code, or what may be one
    out = F.concat(F.substr(d, F.lit(1), kept), _digit_string(permute, "phone", F.substr(d, kept + 1, F.length(d) - kept)))
    return F.when(F.length(d).between(8, 15) & (F.length(d) > kept + 3), _refilled(m, out))


def _ssn(permute: Permute, m: Column) -> Column:
    area, group, serial = _number(m, 1, 3), _number(m, 5, 2), _number(m, 8, 4)
    pair = permute("ssn", area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)

    def written(p: Column) -> Column:
        new = p["x"] + 1 + F.when(p["x"] + 1 >= 666, 1).otherwise(0)
        return F.concat_ws("-", _padded(new, 3), _padded(F.floor(p["y"] / 9999) + 1, 2), _padded(p["y"] % 9999 + 1, 4))

    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), let(pair, written))


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days from the cycle's first one; null where there is no such day."""
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")


def _on(days: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int"))


def _next_day(permute: Permute, days: Column) -> Column:
    return let(permute("date", F.floor(days / 773), days % 773, 189, 773), lambda p: p["x"] * 773 + p["y"])


def _date_iso(permute: Permute, m: Column) -> Column:
    days = _days(*(F.split(m, "-")[i] for i in range(3)))
    return F.when(days.between(0, DAYS - 1), F.date_format(_on(_next_day(permute, days)), "yyyy-MM-dd"))


def _date_short(permute: Permute, m: Column, separator: str, month_first: bool) -> Column:
    """day, month, year, or month, day, year where only that is a day.

    A writing is the numbers of digits of both parts and their order.  Within it each day has one
    form, which is read back in the same way, so the permutation of all days is walked until it
    comes to a day that has this writing.
    """
    part = F.split(m, "[/.]")
    plain, swapped = _days(part[2], part[1], part[0]), _days(part[2], part[0], part[1])
    if not month_first:
        swapped = F.lit(None).cast("long")
    start = F.struct(F.coalesce(plain, swapped).alias("days"), plain.isNull().alias("swap"), F.length(part[0]).alias("l1"), F.length(part[1]).alias("l2"))

    def walk(s: Column) -> Column:
        def fits(days: Column) -> Column:
            d, mo = F.day(_on(days)), F.month(_on(days))
            first, second = F.when(s["swap"], mo).otherwise(d), F.when(s["swap"], d).otherwise(mo)
            return ((s["l1"] == 2) | (first < 10)) & ((s["l2"] == 2) | (second < 10)) & (~s["swap"] | (d > 12))

        def step(at: Column, _: Column) -> Column:
            return F.when(at["done"], at).otherwise(let(_next_day(permute, at["days"]), lambda n: F.struct(n.alias("days"), fits(n).alias("done"))))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(s["days"].alias("days"), F.lit(False).alias("done")), step)

        def written(days: Column) -> Column:
            d, mo = (F.lpad(f(_on(days)).cast("string"), 2, "0") for f in (F.day, F.month))
            first, second = F.when(s["swap"], mo).otherwise(d), F.when(s["swap"], d).otherwise(mo)
            short = [F.when(n == 2, x).otherwise(F.right(x, F.lit(1))) for n, x in ((s["l1"], first), (s["l2"], second))]
            return F.concat_ws(separator, *short, F.date_format(_on(days), "yyyy"))

        return let(end["days"], written)

    return F.when(F.coalesce(plain, swapped).between(0, DAYS - 1), let(start, walk))


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).when(F.lower(c).between("a", "z"), 26).otherwise(1).cast("long")


def _numeral(s: Column) -> Column:
    """value and size: a string as a number among those of its shape (digits, letters, other signs)."""

    def step(n: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), c.cast("long")).when(F.lower(c).between("a", "z"), F.ascii(F.lower(c)) - 97).otherwise(0).cast("long")
        return F.struct((n["value"] * _radix(c) + v).alias("value"), (n["size"] * _radix(c)).alias("size"))

    one = F.struct(F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("size"))
    return F.aggregate(_chars(s), one, step)


def _spelled(shape: Column, value: Column) -> Column:
    """The string of that shape, upper and lower case included, with that number."""

    def step(n: Column, c: Column) -> Column:
        v = F.pmod(n["value"], _radix(c))
        low = F.char(v + 97)
        new = F.when(c.between("0", "9"), v.cast("string")).when(c.between("a", "z"), low).when(c.between("A", "Z"), F.upper(low)).otherwise(c)
        return F.struct(_quotient(n["value"] - v, _radix(c)).alias("value"), F.concat(new, n["text"]).alias("text"))

    start = F.struct(value.cast("long").alias("value"), F.lit("").alias("text"))
    return F.aggregate(F.reverse(_chars(shape)), start, step)["text"]


def _email(permute: Permute, m: Column) -> Column:
    """The local part as another one of its shape: letters, digits and case stay what they are.

    It is permuted in blocks of 20 characters, whose halves fit into a long, under the lower-cased
    domain, the length and the block's number.
    """
    local, domain = F.regexp_extract(m, "^([^@]+)@", 1), F.regexp_extract(m, "@(.*)$", 1)

    def block(i: Column) -> Column:
        own = F.substr(local, i * 20 + 1, F.lit(20))
        n = F.floor(F.length(own) / 2).cast("int")
        kind = F.concat_ws("|", F.lit("email"), F.lower(domain), F.length(local).cast("string"), i.cast("string"))

        def spelled(v: Column) -> Column:
            x, y = _numeral(v["left"]), _numeral(v["right"])
            pair = permute(kind, x["value"], y["value"], x["size"], y["size"])
            return let(pair, lambda p: F.concat(_spelled(v["left"], p["x"]), _spelled(v["right"], p["y"])))

        return let(F.struct(F.substr(own, F.lit(1), n).alias("left"), F.substr(own, n + 1, F.lit(20)).alias("right")), spelled)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(local) - 1) / 20).cast("int")), block)
    return F.concat(F.array_join(blocks, ""), F.lit("@"), domain)


def _replacement(permute: Permute, m: Column) -> Column:
    """The pseudonym of a candidate, or the candidate if it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    digits_only = m.rlike(r"^[\d -]+$")
    out = F.when(F.contains(m, F.lit("@")), _email(permute, m))
    out = out.when(whole(DATE_ISO), _date_iso(permute, m))
    out = out.when(whole(DATE_SLASH), _date_short(permute, m, "/", True)).when(whole(DATE_DOT), _date_short(permute, m, ".", False))
    out = out.when(whole(SSN), _ssn(permute, m)).when(whole(IPV4), _ip(permute, m))
    out = out.when(digits_only & (F.length(_digits(m)) >= 13), _card(permute, m))
    out = out.when(whole(PHONE), _phone(permute, m)).when(whole(PHONE_OTHER), _phone_other(permute, m))
    return F.coalesce(out, m)


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """Texts with personal numbers, dates and addresses replaced by pseudonyms of the same format.

    docs: doc_id long, text string; other columns are ignored.  Returns doc_id, text, and
    n_replaced (values that changed).  Payment card numbers (Luhn), IPv4 addresses, North
    American and other international phone numbers, social security numbers, calendar dates
    (year-month-day; day/month/year, or month/day/year where only that is a day; day.month.year)
    and the local parts of e-mail addresses are validated and permuted among the valid values of
    their format by a Feistel network under ``key``: equal values stay linked, different ones stay
    different, and ``inverse`` with the same key restores them.  Who knows the key can do so, so it
    has no default and must be kept apart from the result.

    A format is what a value looks like: separators, numbers of digits, for an e-mail address its
    letters, digits and case; its domain stays as it is.  Dates are permuted within 1800 to 2199;
    those of other years stay.  What isn't valid stays, as do ten digits without a separator.

    Null text stays null with 0 replaced; an empty text stays empty; a long one is read whole.  Null
    doc_ids and repeated rows are documents like others.  An empty table gives an empty result.
    """
    permute = feistel(key, inverse)
    numbers = "|".join([DATE_ISO, SSN, DATE_SLASH, DATE_DOT, IPV4, PHONE.replace(r"\1", r"\2"), CARD, PHONE_OTHER])
    pattern = f"{EMAIL}|(?=[0-9+(])(?:{numbers})"
    # Whole alternatives are one group, so the separator of a phone number is the second one.
    escaped = F.replace(F.replace(F.col("text"), F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_OPEN), F.lit(_ESCAPE + "1"))
    marked = F.regexp_replace(escaped, f"({pattern})", f"{_OPEN}$1{_OPEN}")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.split(marked, _OPEN).alias("parts"))
    # Odd parts are candidates.
    found = F.transform(F.filter(F.transform("parts", lambda x, i: F.struct(x.alias("m"), i.alias("i"))), lambda s: s["i"] % 2 == 1), lambda s: s["m"])
    rows = rows.withColumn("new", F.transform(found, lambda m: F.struct(m.alias("m"), _replacement(permute, m).alias("p"))))
    merged = F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 1, F.get("new", F.floor(i / 2).cast("int"))["p"]).otherwise(x)), "")
    back = F.replace(F.replace(merged, F.lit(_ESCAPE + "1"), F.lit(_OPEN)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
    changed = F.coalesce(F.size(F.filter("new", lambda s: s["m"] != s["p"])), F.lit(0)).cast("long")
    text = F.when(F.size("new") > 0, back).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(changed).cast("long").alias("n_replaced"))
