"""Format-preserving pseudonyms for personal data.

One regular expression finds where candidates begin; from there the first kind that is valid is taken
and permuted within its own format under a key, so equal values get equal pseudonyms in every document
and different values different ones. The search goes on right after the value, or after the first group
of what fails validation, so that a value next to other digits or capitals is found, too:

- card numbers (13-19 digits, Luhn-valid) and IBANs (mod-97-valid): all but the check digits are
  permuted by a digit- and letter-wise Feistel network, the check digits are computed anew;
- phone numbers (8-15 digits with + or 00 and a country code, ten after +1, ten with an area code in
  brackets or before a hyphen or dot): the country code stays;
- IPv6 addresses: the 32 hexadecimal digits are permuted, in whatever way they were written (the
  pseudonym has all eight groups);
- SSNs and IPv4 addresses (in range), dates from 1900 to 2099 (year-month-day, day.month.year,
  day/month/year, month/day/year where the day is over 12; also before a time of day): Feistel permutation with cycle walking
  of the index of the valid value;
- e-mail addresses: every letter and digit but the last label, each within its class.

Separators, letter case and padding stay. What fails validation is left as it is. Everything is a
chain of column expressions: no Python on the executors, no shuffle, no collected state.

Defined results: a null text stays null, an empty one empty; very long texts are treated whole;
repeated rows get equal results; columns of the input that clash with the new ones are replaced.

The key is the session's ``spark.docloom.pii.key``: who has it can undo the pseudonyms, and runs that
share it agree. Where it is unset, a random one is drawn and forgotten with the process.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.feistel import feistel
from docloom.staging import spread

KEY = "spark.docloom.pii.key"
_drawn = secrets.token_hex(32)
ROUNDS = 8
KINDS = ("email", "iban", "date", "ip", "ssn", "card", "phone")

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
DATE_YMD = r"(?<![0-9A-Za-z.\-/])[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}(?!(?!T[0-9]{2}:?[0-9]{2})[0-9A-Za-z]|[.\-/][0-9])"
DATE_DMY = r"(?<![0-9A-Za-z.\-/])[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4}(?![0-9A-Za-z]|[.\-/][0-9])"
DATE = f"(?:{DATE_YMD}|{DATE_DMY})"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){0,6}(?:[0-9A-Fa-f]{1,4})?::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
#: Phones and cards end before a separator that one of these follows.
STOP = f"(?![ .\\-](?:{IP}|{SSN}|{DATE}))"
#: Phones that have enough digits end before the last digits of a run if they are laid out as a card.
FULL = rf"(?<=(?:\+|(?<![0-9])00)(?:{'|'.join(r'[ .\-()]{0,3}[0-9]' * i for i in range(8, 16))}))"
CARDLIKE = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z]|[ \-][0-9])"
PHONE_1 = r"\+1[ .\-]?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-]?)[0-9]{3}[ .\-]?[0-9]{4}(?![0-9A-Za-z])"
PHONE_ANY = rf"(?:\+[0-9]{{1,3}}[ .\-]?|00[1-9][0-9]{{0,2}}[ .\-])(?:\([0-9]{{1,4}}\)[ .\-]?)?[0-9]{{2,4}}(?:{STOP}(?!{FULL}[ .\-]{CARDLIKE})[ .\-]?[0-9]{{2,4}}){{1,4}}(?![0-9A-Za-z]){FULL}"
PHONE_10 = r"(?<![0-9A-Za-z.\-+])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}(?![0-9A-Za-z]|[.\-][0-9])"
PHONE = rf"(?<![0-9A-Za-z])(?:{PHONE_1}|{PHONE_ANY}|{PHONE_10}|\([0-9]{{3}}\) ?[0-9]{{3}}[ .\-][0-9]{{4}}(?![0-9A-Za-z]))"


def iban_of(n: int | str) -> str:
    """IBANs of ``n`` characters after the check digits."""
    return rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])"


def card_of(n: int | str) -> str:
    """Cards of ``n`` digits after the first."""
    return rf"(?<![0-9A-Za-z])[0-9](?:{STOP}[ \-]?[0-9]){{{n}}}(?![0-9A-Za-z])"


FIND = "|".join([EMAIL, iban_of("11,30"), DATE, IP, IP6, SSN, PHONE, card_of("12,18")])

LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _shift(c: Column, k: Column, classes: tuple[str, ...]) -> Column:
    """``c`` moved on by k within the first class that has it; others stay."""
    out = c
    for alphabet in reversed(classes):
        moved = F.substring(F.lit(alphabet), ((F.instr(F.lit(alphabet), c) - 1 + k) % len(alphabet) + 1).cast("int"), F.lit(1))
        out = F.when(F.instr(F.lit(alphabet), c) > 0, moved).otherwise(out)
    return out


def permuted(s: Column, key: str, classes: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """``s`` with its characters permuted within their classes: digits, ASCII lower-case and upper-case letters.

    A Feistel network over the two halves of the string: in turn each half is shifted by a stream
    hashed from the key, the round and the other half.
    """

    def body(cs: Column) -> Column:
        half = F.floor(F.size(cs) / 2).cast("int")
        start = F.struct(F.slice(cs, F.lit(1), half).alias("a"), F.slice(cs, half + 1, F.size(cs) - half).alias("b"))

        def step(p: Column, i: Column) -> Column:
            def shifted(stream: Column) -> Column:
                return F.transform(p["a"], lambda c, at: _shift(c, F.conv(F.substring(stream, (at % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int"), classes))

            stream = F.sha2(F.concat_ws("/", F.lit(key), i.cast("string"), F.size(p["a"]).cast("string"), F.array_join(p["b"], "")), 512)
            return F.struct(p["b"].alias("a"), _let(stream, shifted).alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda p: F.array_join(F.concat(p["a"], p["b"]), ""))

    return _let(_chars(s), body)


def _respread(original: Column, plain: Column) -> Column:
    """The letters and digits of ``plain`` put where ``original`` has letters and digits."""
    at = lambda i: F.length(F.regexp_replace(F.substring(original, F.lit(1), i), "[^0-9A-Za-z]", ""))
    pick = lambda i: F.when(F.substring(original, i, F.lit(1)).rlike("[0-9A-Za-z]"), F.substring(plain, at(i), F.lit(1))).otherwise(F.substring(original, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(original)), pick), "")


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9A-Za-z]", "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows ``payload``."""
    n = F.length(payload)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(payload, i, F.lit(1)).cast("int")
        twice = (d * 2) % 10 + F.floor(d / 5).cast("int")
        return acc + F.when((n - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def mod97(s: Column) -> Column:
    """ISO 7064 remainder of digits and capital letters (A is 10)."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(s), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        ok = luhn_digit(payload) == F.substring(d, F.length(d), F.lit(1))
        made = _let(permuted(payload, f"{key}/card"), lambda p: F.concat(p, luhn_digit(p)))
        return F.when(ok, _respread(m, made))

    return _let(_bare(m), body)


def _iban(m: Column, key: str) -> Column:
    def body(s: Column) -> Column:
        land, bban = F.substring(s, F.lit(1), F.lit(2)), F.substring(s, F.lit(5), F.length(s) - 4)
        ok = mod97(F.concat(bban, F.substring(s, F.lit(1), F.lit(4)))) == 1
        made = _let(permuted(bban, f"{key}/iban"), lambda p: F.concat(land, F.lpad((98 - mod97(F.concat(p, land, F.lit("00")))).cast("string"), 2, "0"), p))
        return F.when(ok, _respread(m, made))

    return _let(_bare(m), body)


def _phone(m: Column, key: str) -> Column:
    def body(p: Column) -> Column:
        code, rest = p["code"], p["rest"]
        n = F.length(F.regexp_replace(F.regexp_replace(m, "^00", ""), "[^0-9]", ""))
        return F.when(n.between(8, 15), F.concat(code, _respread(rest, permuted(_bare(rest), f"{key}/phone"))))

    # the country code ends at a separator or bracket; without one, it is one digit
    code = F.when(m.startswith("00"), F.regexp_extract(m, r"^00[0-9]{1,3}(?=[ .\-(])", 0)).when(m.startswith("+"), F.coalesce(F.nullif(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .\-(])", 0), F.lit("")), F.substring(m, 1, 2))).otherwise(F.lit(""))
    return _let(_let(code, lambda c: F.struct(c.alias("code"), F.substring(m, F.length(c) + 1, F.length(m)).alias("rest"))), body)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1

    def back(y: Column) -> Column:
        a = F.floor(y / (99 * 9999))
        return F.format_string("%03d-%02d-%04d", (a + 1 + (a >= 665).cast("long")).cast("long"), (F.floor(y / 9999) % 99 + 1).cast("long"), (y % 9999 + 1).cast("long"))

    return F.when(ok, _let(feistel(898 * 99 * 9999, f"{key}/ssn").column(index), back))


def _ip(m: Column, key: str) -> Column:
    octets = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    ok = F.greatest(*octets) <= 255
    number = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    back = lambda y: F.concat_ws(".", *[(F.floor(y / 256**i) % 256).cast("long").cast("string") for i in (3, 2, 1, 0)])
    return F.when(ok, _let(feistel(1 << 32, f"{key}/ip").column(number), back))


def _ip6(m: Column, key: str) -> Column:
    """Both sides of :: in groups of four digits, zeros between them; at most seven groups where there is a ::."""
    wide = lambda side: F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    sides = F.split(m, "::")

    def body(p: Column) -> Column:
        n = F.size(p["a"]) + F.size(p["b"])
        zeros = F.array_repeat(F.lit("0000"), F.greatest(8 - n, F.lit(0)))
        digits = F.array_join(F.concat(p["a"], zeros, p["b"]), "")
        ok = F.when(F.contains(m, F.lit("::")), n <= 7).otherwise(n == 8)
        return F.when(ok, F.regexp_replace(permuted(digits, f"{key}/ip6", (HEX,)), "(.{4})(?=.)", "$1:"))

    return _let(F.struct(wide(sides[0]).alias("a"), F.coalesce(wide(F.try_element_at(sides, F.lit(2))), F.array().cast("array<string>")).alias("b")), body)


def _date(m: Column, key: str) -> Column:
    first, last = -25567, 47481  # days of 1900-01-01 and 2099-12-31
    parts = F.split(m, r"[./\-]")
    ymd = F.length(parts[0]) == 4
    month_first = ~ymd & F.contains(m, F.lit("/")) & (parts[1].cast("int") > 12)
    y = F.when(ymd, parts[0]).otherwise(parts[2])
    mo = F.when(ymd | ~month_first, parts[1]).otherwise(parts[0])
    d = F.when(ymd, parts[2]).when(month_first, parts[1]).otherwise(parts[0])
    day = F.unix_date(F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0"))))
    pattern = F.struct(day.cast("long").alias("day"), F.regexp_extract(m, r"([./\-])", 1).alias("sep"))

    def body(p: Column) -> Column:
        def back(new: Column) -> Column:
            at = F.date_from_unix_date((new + first).cast("int"))
            padded = (F.length(mo) == 2) & (F.length(d) == 2)
            nm = F.when(padded, F.date_format(at, "MM")).otherwise(F.date_format(at, "M"))
            nd = F.when(padded, F.date_format(at, "dd")).otherwise(F.date_format(at, "d"))
            ny = F.date_format(at, "yyyy")
            three = lambda *x: F.concat(x[0], p["sep"], x[1], p["sep"], x[2])
            return F.when(ymd, three(ny, nm, nd)).when(month_first, three(nm, nd, ny)).otherwise(three(nd, nm, ny))

        ok = p["day"].between(first, last)
        return F.when(ok, _let(feistel(last - first + 1, f"{key}/date").column(p["day"] - first), back))

    return _let(pattern, body)


def _email(m: Column, key: str) -> Column:
    stem = F.regexp_extract(m, r"^(.*)\.[^.]*$", 1)
    return F.concat(permuted(stem, f"{key}/email"), F.regexp_extract(m, r"\.[^.]*$", 0))


def first_value(near: Column, key: str) -> Column:
    """struct(kind, m, value) of the first kind that is valid right after the first character of ``near``, or null.

    Cards and IBANs are the longest valid ones that end where a group ends.
    """

    def at(pattern: str) -> Column:
        return F.regexp_extract(near, f"(?s)^.({pattern})", 1)

    def tried(kind: str, m: Column, make) -> Column:
        def body(m: Column) -> Column:
            return F.when(m != "", _let(make(m, key), lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), m.alias("m"), v.alias("value")))))

        return _let(m, body)

    def longest(patterns: list[str], ok) -> Column:
        return F.coalesce(*[_let(at(p), lambda m: F.when((m != "") & ok(_bare(m)), m)) for p in patterns], F.lit(""))

    iban = longest([iban_of(n) for n in range(30, 10, -1)], lambda s: mod97(F.concat(F.substring(s, F.lit(5), F.length(s) - 4), F.substring(s, 1, 4))) == 1)
    card = longest([card_of(n) for n in range(18, 11, -1)], lambda d: luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1)))
    return F.coalesce(
        tried("email", at(EMAIL), _email),
        F.when(near.rlike("(?s)^.[A-Z]"), tried("iban", iban, _iban)),
        tried("date", at(DATE), _date),
        tried("ip", at(IP), _ip),
        F.when(near.rlike("(?s)^.[0-9A-Fa-f:]"), tried("ip", at(IP6), _ip6)),
        tried("ssn", at(SSN), _ssn),
        tried("phone", at(PHONE), _phone),
        F.when(near.rlike("(?s)^.[0-9]"), tried("card", card, _card)),
    )


def scanned(line: Column, key: str) -> Column:
    """struct(parts, rest): array of struct(plain, kind, value) of a line, and the text after them.

    From each place where FIND matches, the valid value is taken and the search goes on right after
    it; if there is none, it goes on after the first group of letters and digits of the match. The
    text still to be searched is held with the character before it, which the patterns look at.
    """
    part = "array<struct<plain:string,kind:string,value:string>>"
    start = F.struct(F.array().cast(part).alias("parts"), F.concat(F.lit("\n"), line).alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        def found(head: Column) -> Column:
            # the head has the character before the text, too
            plain = F.substring(head, F.lit(2), F.length(head))
            near = F.substring(acc["rest"], F.length(head), F.length(acc["rest"]))

            def taken(near: Column) -> Column:
                def after(v: Column) -> Column:
                    skip = F.regexp_extract(near, "(?s)^.([^0-9A-Za-z]*[0-9A-Za-z]+)", 1)
                    done = F.when(v.isNull(), F.struct(F.concat(plain, skip).alias("plain"), F.lit(None).cast("string").alias("kind"), F.lit("").alias("value"))).otherwise(F.struct(plain.alias("plain"), v["kind"].alias("kind"), v["value"].alias("value")))
                    used = F.length(F.coalesce(v["m"], skip))
                    return F.struct(F.array_append(acc["parts"], done).cast(part).alias("parts"), F.substring(near, used + 1, F.length(near)).alias("rest"))

                return _let(first_value(near, key), after)

            return F.when(head == "", acc).otherwise(_let(near, taken))

        return _let(F.regexp_extract(acc["rest"], f"(?s)^.+?(?={FIND})", 0), found)

    n = F.regexp_count(line, F.lit(f"(?={FIND})"))
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: F.struct(acc["parts"].alias("parts"), F.substring(acc["rest"], F.lit(2), F.length(acc["rest"])).alias("rest")))


def key_of(spark: SparkSession) -> str:
    """The session's key, or the one drawn for this process."""
    return spark.conf.get(KEY, None) or _drawn


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with the text replaced and n_<kind> and n_found (BIGINT) added; other columns stay."""
    key = key or key_of(docs.sparkSession)
    text = F.col(text_col)
    # no value goes over the end of a line
    found = F.when(text.rlike("[0-9@]"), F.transform(F.split(text, "\n", -1), lambda line: scanned(line, key)))
    counted = docs.withColumn("_found", found)
    line = lambda x: F.concat(F.array_join(F.transform(x["parts"], lambda p: F.concat(p["plain"], p["value"])), ""), x["rest"])
    joined = F.array_join(F.transform(F.col("_found"), line), "\n")
    kinds = counted.withColumn(text_col, F.when(F.col("_found").isNotNull(), joined).otherwise(text))
    kinds = kinds.withColumn("_found", F.flatten(F.transform(F.col("_found"), lambda x: F.transform(x["parts"], lambda p: p["kind"]))))
    count = lambda k: F.coalesce(F.size(F.filter(F.col("_found"), lambda p: p == k)), F.lit(0))
    out = kinds
    for k in KINDS:
        out = out.withColumn(f"n_{k}", F.when(F.col("_found").isNull(), 0).otherwise(count(k)).cast("long"))
    total = sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
    return out.withColumn("n_found", total).drop("_found")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal data: doc_id, text, the counts."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    return pseudonymise(docs)
