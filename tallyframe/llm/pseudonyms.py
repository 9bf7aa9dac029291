"""Format-preserving pseudonyms for personal data, in SQL expressions only.

A pattern finds candidates; validation (Luhn, octet and calendar ranges)
settles the kind; a keyed Feistel network permutes the digits within the
format, so equal values have equal pseudonyms in all documents and different
values different ones:

* card: all digits but the last are permuted, and a new check digit made.
* phone and number with dashes (123-45-6789): digits permuted, layout kept.
* ip: octets permuted as two 16-bit halves.
* date (ISO or day/month/year): permuted among the 270 * 271 days from 1900-01-01.
* email and secret have no ring to permute: characters are drawn from a keyed
  hash of the value (128 bits of it for an email).

Rounds use keyed SHA-256.  The text is never handed to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# possessive, and begun only where a run begins, so that a text costs its length;
# the domain has at most the 127 labels that a domain name can have
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,125}\.\p{L}{2,}+"
SECRET = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[ ]*[=:][ ]*[\"']?[A-Za-z0-9_/+-]{8,}[\"']?|(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{40})(?![\p{L}\p{N}])"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
DASHED = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"
FOUND = "|".join((EMAIL, SECRET, DATE, IP, PHONE, DASHED, CARD))
KINDS = ("email", "secret", "date", "ip", "phone", "number", "card")


def _number(digits: Column) -> Column:
    return F.coalesce(digits.cast("long"), F.lit(0).cast("long"))


def _pick(key: str, what: str, i: Column, half: Column) -> Column:
    """60 keyed pseudorandom bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, m: Column, n: Column, key: str, what: str) -> tuple[Column, Column]:
    """Keyed permutation of the pairs (left < m, right < n)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        low = F.when(odd, F.pmod(s["l"] + F.pmod(_pick(key, what, i, s["r"]), m), m)).otherwise(s["l"])
        high = F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(_pick(key, what, i, s["l"]), n), n))
        return F.struct(low.cast("long").alias("l"), high.cast("long").alias("r"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return done["l"], done["r"]


def permute_digits(digits: Column, key: str, what: str) -> Column:
    """Keyed permutation of the digit strings of each length (2 to 36)."""
    n = F.length(digits)
    k = F.floor(n / 2).cast("int")
    ten = lambda e: F.element_at(F.array(*[F.lit(10**j) for j in range(19)]), e + 1)
    left, right = feistel(_number(F.substring(digits, F.lit(1), k)), _number(F.substring(digits, k + 1, n - k)), ten(k), ten(n - k), key, what)
    return F.concat(F.lpad(left.cast("string"), k, "0"), F.lpad(right.cast("string"), n - k, "0"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(
        chars,
        start,
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.between("0", "9"), F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + F.when(c.between("0", "9"), 1).otherwise(0)).cast("int").alias("k"),
        ),
    )["out"]


def _luhn(digits: Column, shift: int = 0) -> Column:
    """Luhn sum of a digit string; shift 1: as if a digit followed."""
    rest = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = F.transform(rest, lambda c, i: F.when((i + shift) % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b)


def _card_in(m: Column) -> Column:
    """The card in a digit run that is none as a whole: the first Luhn-valid part
    between separators, of 16 or 15 digits if there is one; m where there is none."""
    parts = F.concat(*[F.regexp_extract_all(m, F.lit(rf"(?<!\d)(?=(\d(?:[ -]?\d){{{n - 1}}})(?!\d))"), F.lit(1)) for n in (16, 15, 19, 18, 17, 14, 13)])
    valid = F.filter(parts, lambda c: _luhn(_digits(c)) % 10 == 0)
    run = m.rlike(r"^\d(?:[ -]?\d){12,18}$") & ~m.rlike(f"^(?:{DATE}|{PHONE}|{DASHED})$")
    return F.when(run & (_luhn(_digits(m)) % 10 != 0), F.coalesce(F.try_element_at(valid, F.lit(1)), m)).otherwise(m)


def kind_of(m: Column) -> Column:
    """Kind of a validated candidate, else null."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    octets = F.split(m, r"\.")
    day = _day(m)
    return (
        F.when(m.contains("@"), "email")
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"), F.when(day.between(0, 270 * 271 - 1), "date"))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), F.when(m.rlike(r"^(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)"), "number"))
        .when(m.startswith("+") | m.startswith("(") | whole(r"\d{3}[.-]\d{3}[.-]\d{4}"), F.when(F.length(_digits(m)).between(7, 15) & ~_digits(m).rlike(r"^(\d)\1*$"), "phone"))
        .when(whole(r"\d(?:[ -]?\d){12,18}"), F.when(_luhn(_digits(m)) % 10 == 0, "card"))
        .when(m.rlike("[A-Za-z]"), "secret")
    )


def _day(m: Column) -> Column:
    iso = F.when(m.contains("/"), F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2))).otherwise(m)
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))


def _hash(m: Column, key: str, what: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), m), 256)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    fresh = permute_digits(body, key, "card")
    card = F.concat(fresh, F.pmod(F.lit(10) - _luhn(fresh, 1) % 10, F.lit(10)).cast("string"))
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    at = lambda i: F.try_element_at(o, F.lit(i))
    a, b = feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(65536), F.lit(65536), key, "ip")
    ip = F.concat_ws(".", F.floor(a / 256), a % 256, F.floor(b / 256), b % 256)
    day = _day(m)
    p, q = feistel(F.floor(day / 271), day % 271, F.lit(270), F.lit(271), key, "date")
    when = F.date_add(F.lit("1900-01-01").cast("date"), (p * 271 + q).cast("int"))
    date = F.when(m.contains("/"), F.date_format(when, "dd/MM/yyyy")).otherwise(F.date_format(when, "yyyy-MM-dd"))
    email = F.concat(F.lit("u"), F.substring(_hash(F.lower(m), key, "email"), 1, 32), F.lit("@example.invalid"))
    lead = F.regexp_extract(m, "^(?:[A-Za-z_-]+[ ]*[=:][ ]*[\"']?)?", 0)
    tail = F.regexp_extract(m, "[\"']$", 0)
    secret = F.substring(m, F.length(lead) + 1, F.length(m) - F.length(lead) - F.length(tail))
    drawn = F.substring(F.repeat(_hash(F.lower(secret), key, "secret"), (F.floor(F.length(m) / 64) + 1).cast("int")), F.lit(1), F.length(secret))
    drawn = F.when(secret == F.upper(secret), F.upper(drawn)).otherwise(drawn)
    return (
        F.when(kind == "email", email)
        .when(kind == "card", _refill(m, card))
        .when(kind == "ip", ip)
        .when(kind == "date", date)
        .when(kind.isin("phone", "number"), _refill(m, permute_digits(digits, key, "phone")))
        .when(kind == "secret", F.concat(lead, drawn, tail))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replace personal data by keyed pseudonyms of the same format.

    docs: any columns with ``text``; the text is replaced and ``n_found`` (map of
    kind to count, empty if none) added, in place of a column of that name.  key:
    a secret of the owner; equal values under one key have equal pseudonyms.

    A null text stays null with an empty map; numbers that fail validation stay
    (cards by their check digit, dates by the calendar, addresses by octet, dashed
    numbers by the parts that are never issued, phones by 7 to 15 digits that are
    not all alike).  Repeated rows are treated alike;
    other columns, of any name, are kept; empty table: empty result.
    """
    pieces = F.split("text", FOUND, -1)
    parts = F.transform(F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)), lambda w: F.struct(w.alias("whole"), _card_in(w).alias("m")))
    pairs = F.transform(parts, lambda h: F.struct(h["whole"].alias("whole"), h["m"].alias("m"), kind_of(h["m"]).alias("kind")))

    def put(h: Column) -> Column:
        at = F.instr(h["whole"], h["m"])
        return F.concat(F.substring(h["whole"], F.lit(1), at - 1), pseudonym(h["m"], h["kind"], key), F.substring(h["whole"], at + F.length(h["m"]), F.length(h["whole"])))

    names = [c for c in docs.columns if c.lower() not in ("text", "n_found")]
    hits = "hits"
    while hits in map(str.lower, names):
        hits += "_"
    made = F.transform(hits, put)
    quoted = [F.col(f"`{c}`") for c in names]
    maybe = F.col("text").rlike("[@0-9]") | F.col("text").rlike(SECRET)  # all others hold a digit or @
    d = docs.select(*quoted, "text", F.when(maybe, pairs).alias(hits))
    some = F.size(hits) > 0
    text = F.when(some, F.array_join(F.flatten(F.zip_with(pieces, made, lambda p, h: F.array(p, F.coalesce(h, F.lit(""))))), "")).otherwise(F.col("text"))
    kinds = F.filter(F.transform(hits, lambda h: h["kind"]), lambda k: k.isNotNull())
    count = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    out = d.select(*quoted, text.alias("text"), F.coalesce(F.when(some, count), F.create_map().cast("map<string,int>")).alias("n_found"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_found"], "n_found")
