"""PII pseudonyms: keyed Feistel permutations within each value's format, so equal values stay linked in all documents.

Values are found by shape and then validated: card numbers (13 to 19 digits, Luhn), IBANs (mod 97), dates (days that
exist; year first, also before a time, day first, and month first where the day is after the 12th), IPv4 addresses (octets
to 255), telephone numbers (10 to 15 digits in groups, behind a plus, or ten that North America's plan allows), social
security numbers (area, group and serial in range), e-mail addresses (whose domain stays). What isn't valid is left alone, but its groups of digits are tried again
alone and with those that follow, so a neighbouring number hides nothing. Values whose shape or check is sure (all but
telephone numbers and cards in odd groups) go first, others are sought between them. No telephone number begins or ends
inside what has another kind's shape and isn't valid, save with a plus or a bracket. It ends where North America's
grouping, or one separator all through, says so; else it takes in up to four groups of at most 15 digits, be they its own
or not. Each value is a number in its format's
domain (days, 32 bits, digits of one length, letters and digits by place), which a Feistel network under the key permutes
by cycle walking; the outcome has the same format, with its check digits worked out anew, and its separators and case.
The permutation has no state: any task gives the same pseudonym, no table of values is kept or joined, and the key's
holder can reverse it (`reverse=True`), save where a pseudonym and numbers beside it pass a check by chance. A value is found again whatever its separators or case.

Nulls: a null text stays null, with no values. Very long texts are worked through whole, one at a time. Rows repeated
get the same result. An empty table gives an empty result. Of columns of the input the text alone changes.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_name, map_arrow

#: The key of the registered query. A real run passes its own.
DEMO_KEY = "demonstration key, not a secret"
ROUNDS = 8
KINDS = ("email", "iban", "ip", "phone", "card", "ssn", "date")
#: Shapes that a check or their punctuation makes sure. Cards stand in one group or in those printed on them.
STRICT = re.compile(
    r"(?P<email>(?<![\w.+-])[\w+-][\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,5}\.[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))"
    r"|(?P<date>(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]{2}:)|[.-][0-9]))"
    r"|(?P<ssn>(?<![0-9A-Za-z-])(?<!\+[0-9] )(?<!\+[0-9]{2} )(?<!\+[0-9]{3} )[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?P<s>[ -])(?:[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}(?:(?P=s)[0-9]{1,3})?|[0-9]{6}(?P=s)[0-9]{4,5}))(?![0-9A-Za-z]))",
    re.ASCII,
)
#: Digits in any groups, between the values of STRICT.
CARD = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])")
PHONE = re.compile(r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"
                   r"|(?:\+|00)[1-9][0-9]{0,2}[ .-]\(?[0-9]{1,5}\)?[ .-][0-9]{5,8}|\+[1-9][0-9]{9,14}|[2-9][0-9]{2}[2-9][0-9]{6})(?![0-9A-Za-z]|[.-][0-9])")
LOOSE = re.compile(f"{CARD.pattern}|{PHONE.pattern}")
#: Telephone numbers whose grouping says where they end: ten digits of North America; one separator all through.
BOUND = re.compile(r"(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?|\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])|\+?[0-9]{1,4}(?P<s>[.-])(?:[0-9]{2,4}(?P=s)){2,3}[0-9]{2,4}(?= )")
#: Every value has one of these.
HINT = re.compile(r"[0-9@]")
EPOCH, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


@lru_cache(maxsize=200_000)
def permuted(x: int, n: int, key: str, reverse: bool) -> int:
    """A keyed permutation of range(n) at x: a Feistel network over the next even number of bits, walked until it falls below n."""
    if n < 2:
        return x
    half = (max(2, (n - 1).bit_length()) + 1) // 2
    mask, size, rounds = (1 << half) - 1, (half + 7) // 8, range(ROUNDS)

    def f(r: int, right: int) -> int:
        h = hashlib.blake2b(r.to_bytes(1, "big") + n.to_bytes(96, "big") + right.to_bytes(size, "big"), key=hashlib.sha256(key.encode()).digest(), digest_size=min(64, size)).digest()
        return int.from_bytes(h, "big") & mask

    while True:
        left, right = x >> half, x & mask
        for r in reversed(rounds) if reverse else rounds:
            if reverse:
                left, right = right ^ f(r, left), left
            else:
                left, right = right, left ^ f(r, right)
        x = left << half | right
        if x < n:
            return x


def luhn(digits: str) -> bool:
    return check_digit(digits[:-1]) == int(digits[-1])


def check_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def fill(shape: str, chars: str) -> str:
    """The letters and digits of shape replaced by chars, one for one; case follows shape."""
    it = iter(chars)
    return "".join((next(it).upper() if c.isupper() else next(it)) if c.isalnum() else c for c in shape)


def by_place(text: str, key: str, tweak: str, reverse: bool) -> str:
    """Digits become digits and letters letters, at their places, over the product of the places' alphabets."""
    sizes = [10 if c.isdigit() else 26 for c in text]
    x, n = 0, 1
    for c, s in zip(text, sizes, strict=True):
        x, n = x * s + (int(c) if s == 10 else ord(c) - 97), n * s
    x, out = permuted(x, n, f"{key}/{tweak}", reverse), []
    for s in reversed(sizes):
        x, d = divmod(x, s)
        out.append(str(d) if s == 10 else chr(97 + d))
    return "".join(reversed(out))


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def digits(body: str, key: str, tweak: str, reverse: bool) -> str:
    return str(permuted(int(body), 10 ** len(body), f"{key}/{tweak}", reverse)).zfill(len(body))


def is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1


def card(v: str, key: str, reverse: bool) -> str | None:
    d = digits_of(v)
    if not is_card(d):
        return None
    body = digits(d[:-1], key, "card", reverse)
    return fill(v, body + str(check_digit(body)))


def iban(v: str, key: str, reverse: bool) -> str | None:
    c = v.replace(" ", "")
    number = lambda x: int("".join(str(int(y, 36)) for y in x))
    if not 15 <= len(c) <= 34 or number(c[4:] + c[:4]) % 97 != 1:
        return None
    body = by_place(c[4:].lower(), key, f"iban{c[:2]}", reverse).upper()
    return fill(v, c[:2] + str(98 - number(body + c[:2] + "00") % 97).zfill(2) + body)


def ip(v: str, key: str, reverse: bool) -> str | None:
    parts = [int(x) for x in v.split(".")]
    if max(parts) > 255 or any(x != str(int(x)) for x in v.split(".")):
        return None
    n = permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, f"{key}/ip", reverse)
    return ".".join(map(str, n.to_bytes(4, "big")))


def phone(v: str, key: str, reverse: bool) -> str | None:
    d = digits_of(v)
    if not 10 <= len(d) <= 15:
        return None
    if v.isdigit() and len(v) == 10:  # without groups: North America's, whose area and exchange begin with 2 to 9
        area, exchange, line = int(v[:3]) - 200, int(v[3:6]) - 200, int(v[6:])
        if min(area, exchange) < 0:
            return None
        x, line = divmod(permuted((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, f"{key}/phone ten", reverse), 10_000)
        return f"{x // 800 + 200}{x % 800 + 200}{line:04}"
    if v[1:] == d:  # how long the country's code is, isn't told by groups
        country = 1 if d[0] in "17" else 2
    elif v[0] == "+":
        country = min(len(re.match(r"\+([0-9]*)", v)[1]), 3, len(d) - 7)
    else:  # a group that begins with 00 has a country's code
        first = re.match(r"00[1-9][0-9]{0,2}(?![0-9])", v)
        country = len(first[0]) if first and len(d) - len(first[0]) >= 7 else 0
    new = digits(d[country:], key, f"phone{d[:country]}", reverse)
    while is_card(d[:country] + new) != is_card(d):  # or it would be read as a card
        new = digits(new, key, f"phone{d[:country]}", reverse)
    return fill(v, d[:country] + new)


def ssn(v: str, key: str, reverse: bool) -> str | None:
    area, group, serial = (int(x) for x in v.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permuted(x, 898 * 99 * 9999, f"{key}/ssn", reverse), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"


@cache
def late_days() -> list[int]:
    """Days after the 12th before each month since 1900."""
    out = [0]
    for i in range(2400):
        first = dt.date(1900 + i // 12, i % 12 + 1, 1)
        following = dt.date(1900 + (i + 1) // 12, (i + 1) % 12 + 1, 1)
        out.append(out[-1] + (following - first).days - 12)
    return out


def month_first(v: str, key: str, reverse: bool) -> str | None:
    """month/day/year with a day after the 12th, which no other format has, stays one."""
    month, day, year = (int(x) for x in v.split("/"))
    before, i = late_days(), (year - 1900) * 12 + month - 1
    if not month or not 0 <= i < 2400 or not 0 < day - 12 <= before[i + 1] - before[i]:
        return None
    x = permuted(before[i] + day - 13, before[-1], f"{key}/month first", reverse)
    i = bisect.bisect_right(before, x) - 1
    return f"{i % 12 + 1:02}/{x - before[i] + 13:02}/{1900 + i // 12}"


def date(v: str, key: str, reverse: bool) -> str | None:
    form = "%Y-%m-%d" if v[4] == "-" else f"%d{v[2]}%m{v[5]}%Y"
    if v[2] == v[5] == "/" and int(v[:2]) <= 12 < int(v[3:5]):
        return month_first(v, key, reverse)
    try:
        day = dt.datetime.strptime(v, form).date().toordinal() - EPOCH
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    return dt.date.fromordinal(EPOCH + permuted(day, DAYS, f"{key}/date", reverse)).strftime(form)


def email(v: str, key: str, reverse: bool) -> str | None:
    local, _, domain = v.partition("@")
    plain = "".join(c for c in local.lower() if c.isalnum())
    return f"{fill(local, by_place(plain, key, 'email@' + domain.lower(), reverse))}@{domain}" if plain else None


@cache
def makers() -> dict:
    return {"email": email, "iban": iban, "ip": ip, "phone": phone, "card": card, "ssn": ssn, "date": date}


def group_ends(text: str, start: int, end: int) -> list[int]:
    """Where the groups of text[start:end] end, the last first."""
    return [end, *[i for i in range(end - 1, start, -1) if text[i] in " .-" and text[i - 1].isalnum()]]


def strict_values(text: str, key: str, reverse: bool) -> tuple[list, list]:
    """(start, end, kind, pseudonym) of values found by STRICT, and the spans that have such a shape but aren't valid."""
    values, rejected, start = [], [], 0
    while m := STRICT.search(text, start):
        kind, a, b = m.lastgroup, m.start(), m.end()
        ends = [b]
        if kind == "iban":
            ends = group_ends(text, a, b)
        elif kind == "card" and m["s"] and m.group().count(m["s"]) == 4:
            ends = [a + 19, b]  # what follows four groups of four is seldom theirs
        for end in ends:
            if new := makers()[kind](text[a:end], key, reverse):
                values.append((a, end, kind, new))
                start = end
                break
        else:
            rejected.append((a, b))
            start = a + len(re.match(r"[^0-9A-Za-z]*[0-9A-Za-z]+", text[a:b])[0])  # a valid value may begin further on
    return values, rejected


def loose_values(text: str, begin: int, stop: int, rejected: list, key: str, reverse: bool):
    """(start, end, kind, pseudonym) of cards in odd groups and telephone numbers in text[begin:stop]."""
    start = begin
    while m := LOOSE.search(text, start, stop):
        a = m.start()
        near = [(x, y) for x, y in rejected[bisect.bisect_left(rejected, (a - 64, 0)) : bisect.bisect_left(rejected, (m.end(), 0))]]
        c, p = CARD.match(text, a, stop), PHONE.match(text, a, stop)
        cards = [("card", e) for e in group_ends(text, a, c.end())] if c else []
        cards = [(k, e) for k, e in cards if not any(x < a < y or x < e < y for x, y in near)]
        phones = []
        if p:
            ends = [e for e in group_ends(text, a, p.end()) if PHONE.fullmatch(text, a, e)]
            bound = BOUND.match(text, a, stop)
            ends = [*([bound.end()] if bound else []), *sorted(ends, key=lambda e: bool(re.match(r"/[0-9]", text[e : e + 2])))]
            phones = [("phone", e) for e in ends if text[a] in "+(" or not any(x <= a < y or x < e < y for x, y in near)]
        whole = [(k, e) for k, e in cards if e == c.end() or len(digits_of(text[a:e])) > 15]
        for kind, end in [*whole, *phones, *cards]:
            if new := makers()[kind](text[a:end], key, reverse):
                yield a, end, kind, new
                start = end
                break
        else:
            start = a + len(re.match(r"[^0-9]|[0-9]+", text[a : m.end()])[0])  # a valid number may begin further on


def pseudonymise(text: str, key: str, reverse: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with all valid values permuted, and (kind, start, end) of each in the text given."""
    if not HINT.search(text):
        return text, []
    strict, rejected = strict_values(text, key, reverse)
    edges = [0, *[x for a, b, _, _ in strict for x in (a, b)], len(text)]
    values = sorted([*strict, *[v for a, b in zip(edges[::2], edges[1::2], strict=True) for v in loose_values(text, a, b, rejected, key, reverse)]])
    out, at = [], 0
    for a, b, _, new in values:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in values]


def pseudonymised(docs: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """docs with pseudonyms in `text`, and a last column `found` (`found_` if docs has one) of structs kind, start, end."""
    name = "_pseudonyms"
    keep = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), "text")
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def change(batches):
        for batch in batches:
            texts, found = [], []
            for x in batch["text"].to_pylist():
                new, spans = pseudonymise(x, key, reverse) if x else (x, [])
                texts.append(new)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(texts, pa.string()), pa.array(found, kinds)], ["doc", "text", name])

    schema = T.StructType([keep.schema["doc"], *T.StructType.fromDDL(f"text string, {name} array<struct<kind:string,start:bigint,end:bigint>>")])
    out = map_arrow(keep, change, schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns], F.col(name).alias(free_name(docs, "found")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, and how many of each kind."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    out = pseudonymised(docs, DEMO_KEY)
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), *[count(k) for k in KINDS], spans.alias("spans"))


QUERIES = {"op10_pii": op10_pii}
