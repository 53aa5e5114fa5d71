"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for card numbers,
mod 97 for bank account numbers, ranges for addresses), and words near a span
raise or lower its score. Spans of the four base kinds (email, ip, card, phone)
that pass their check are always kept; spans of the other kinds (iban, secret)
are kept when their score reaches ``least``.

A span is (kind, start, end, score), counted in code points, end exclusive.
Matches of one kind are leftmost and don't overlap; spans of different kinds
may. Where a bank account number ends can't be seen from its characters, as it
is written with blanks and a word or number can follow: every end of a word that
leaves 1 modulo 97 is possible, and the one at the length of its country is
taken, or else the last. Positions come from the lengths of the pieces between matches, so every
kind needs two regex passes over a text, and only over texts that hold a
character the kind needs.

The patterns below are written so that a regex engine doesn't go back: runs
start where no character of the run stands before, or where the last match
ended, and quantifiers are possessive. They match what the plain forms in the
comments match.

Defined results: null text counts as empty and has no spans; repeated rows give
repeated results; other columns pass unchanged. A text is one row of work; n
matches in it cost about n log n steps besides the time in proportion to its
length, as positions are running sums by doubling and texts are cut up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order of precedence at equal starts.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = ("email", "ip", "card", "phone")

#: What proposes a span. Plain forms:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+
#: phone \+[0-9][\x20().0-9-]+[0-9]
#: iban is the first four characters, and looks ahead over the words that can belong to it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}+|[0-9A-Fa-f]{40}+)(?![A-Za-z0-9])",
}
#: Characters of a country's account numbers, without blanks.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "phone": "+"}
#: Score before context, and words that change it when they stand within NEAR characters before a span.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "secret": 0.6}
NEAR = 32
UP = {
    "email": r"(?i)\b(?:e-?mail|contact|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|mastercard|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|tel[eé]fono)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "secret": r"(?i)\b(?:token|key|secret|password|aws)\b",
}
DOWN = {
    "email": r"(?i)\b(?:example|noreply|no-reply)\b",
    "ip": r"(?i)\b(?:version|release|section|v)\b",
    "card": r"(?i)\b(?:isbn|order|serial|invoice|id)\b",
    "phone": r"(?i)\b(?:isbn|order|serial)\b",
    "iban": r"(?i)\b(?:serial|model)\b",
    "secret": r"(?i)\b(?:sha1|commit|checksum|digest|hash)\b",
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check: every second digit from the right is doubled, less 9 if over 9."""
    chars = F.split(F.reverse(digits), "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True if an account number without blanks leaves 1 modulo 97: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, (a * 100 + n - 55) % 97).otherwise((a * 10 + n - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, r"^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(F.when(F.length(short) <= 3, short).try_cast("int"), F.lit(0)) <= 255)


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), _octet)
    if kind == "card":
        d = _digits(s)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _account(run: Column) -> Column:
    """The account number that a run of words begins with, or null: up to the word's end at its country's length, or else the last possible one."""
    words = F.split(run, " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))

    def possible(h: Column) -> Column:
        a = F.regexp_replace(h, " ", "")
        return F.when(F.length(a).between(15, 34) & ~a.rlike("[a-z]"), mod97(a)).otherwise(False)

    def usual(h: Column) -> Column:
        n = F.length(F.regexp_replace(h, " ", ""))
        return F.coalesce(*(F.when(F.substr(h, F.lit(1), F.lit(2)).isin(*names.split()), n == k) for k, names in IBAN_LENGTHS.items()), F.lit(False))

    ends = F.array_sort(F.transform(F.filter(heads, possible), lambda h: F.struct(usual(h).alias("usual"), F.length(h).alias("n"), h.alias("h"))))
    return F.try_element_at(ends, F.lit(-1))["h"]


_FOUND = "array<struct<start:int,end:int,match:string,before:string>>"
#: Elements of an array that one inner loop handles, where a loop can't be had without copying what it has gathered.
_BLOCK = 256
#: Code points of the pieces that a text is cut into before parts of it are taken.
_PIECE = 4096


def _once(x: Column, use) -> Column:
    """use(x), where x is computed once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _running(x: Column, n: Column, join) -> Column:
    """Running sums (or maxima, by join) of an array of n numbers, by doubling: as many passes as n has binary digits."""

    def doubled(a: Column, s: Column) -> Column:
        return F.transform(a, lambda v, i: F.coalesce(join(v, F.get(a, (i - F.call_function("shiftleft", F.lit(1), s)).cast("int"))), v))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n)) - 1), x, doubled)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _proposed(text: Column, kind: str) -> Column:
    """Array of (start, end, match, before) of the confirmed matches of a kind."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind]), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(NEAR)).alias("before")))
    pairs = F.filter(F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g["n"].alias("n"), g["before"].alias("before"))), lambda x: x["m"].isNotNull())

    def placed(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x: x["n"] + F.length(x["m"])), F.size(p), _plus)
        return F.zip_with(p, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("match"), x["before"].alias("before")))

    found = F.filter(_once(pairs, placed), lambda x: _confirmed(kind, x["match"]))
    needs = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(PATTERNS[kind])
    return F.when(needs, found).otherwise(F.array().cast(_FOUND))


def _proposed_accounts(text: Column) -> Column:
    """The same for account numbers: runs overlap, and those that begin within a confirmed number are passed over."""
    kind = "iban"
    runs = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1))
    gaps = F.transform(F.split(text, PATTERNS[kind]), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(NEAR)).alias("before")))
    pairs = F.zip_with(F.transform(runs, _account), gaps, lambda m, g: F.struct(m.alias("m"), g["n"].alias("n"), g["before"].alias("before")))

    def placed(p: Column) -> Column:
        heads = _running(F.transform(p, lambda x: x["n"] + 4), F.size(p), _plus)
        return F.zip_with(p, heads, lambda x, e: F.struct((e - 4).alias("start"), (e - 4 + F.length(x["m"])).alias("end"), x["m"].alias("match"), x["before"].alias("before")))

    def step(a: Column, x: Column) -> Column:
        ok = x["start"] >= a["free"]
        return F.struct(F.when(ok, x["end"]).otherwise(a["free"]).alias("free"), F.when(ok, F.concat(a["got"], F.array(x))).otherwise(a["got"]).alias("got"))

    def block(a: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(a["free"].alias("free"), F.array().cast(_FOUND).alias("got")), step)
        return _once(own, lambda o: F.struct(o["free"].alias("free"), F.concat(a["got"], F.array(o["got"])).alias("got")))

    def apart(c: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / _BLOCK).cast("int")), lambda b: F.slice(c, b * _BLOCK + 1, F.lit(_BLOCK)))
        start = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{_FOUND}>").alias("got"))
        return F.when(F.size(c) > 0, F.flatten(F.aggregate(parts, start, block, lambda a: a["got"]))).otherwise(c)

    found = _once(F.filter(_once(pairs, placed), lambda x: x["match"].isNotNull()), apart)
    return F.when(text.rlike(PATTERNS[kind]), found).otherwise(F.array().cast(_FOUND))


def _scored(rank: int, kind: str):
    def f(x: Column) -> Column:
        score = F.lit(SCORES[kind]) + F.when(x["before"].rlike(UP[kind]), 0.1).otherwise(0.0) - F.when(x["before"].rlike(DOWN[kind]), 0.3).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    return f


def find_spans(text: Column, least: float = 0.5) -> Column:
    """Array of (start, rank, end, kind, score), by start and then by kind in the order of KINDS."""
    text = F.coalesce(text, F.lit(""))
    every = []
    for rank, kind in enumerate(KINDS):
        got = F.transform(_proposed_accounts(text) if kind == "iban" else _proposed(text, kind), _scored(rank, kind))
        every.append(got if kind in BASE else F.filter(got, lambda x: x["score"] >= least))
    return F.array_sort(F.concat(*every))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii", least: float = 0.5) -> DataFrame:
    """All rows and columns, and the array of spans as column out (a column of that name is replaced)."""
    return docs.withColumn(out, find_spans(F.col(text), least))


def _cut(pieces: Column, a: Column, z: Column) -> Column:
    """Code points a to z of a text in pieces of _PIECE."""
    first, last = F.floor(a / _PIECE).cast("int"), F.floor(z / _PIECE).cast("int")
    at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    across = F.concat(F.substr(at(first), a % _PIECE + 1), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substr(at(last), F.lit(1), z % _PIECE))
    return F.when(first == last, F.substr(at(first), a % _PIECE + 1, z - a)).otherwise(across)


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; overlapping spans give one mark, of the first."""

    def marked(most: Column) -> Column:
        """most: the largest end of each span and those before it."""

        def joined_up(pieces: Column) -> Column:
            places = F.transform(spans, lambda x, i: F.struct(F.coalesce(F.get(most, i - 1), F.lit(0)).alias("at"), x["start"].alias("start"), x["kind"].alias("kind")))
            parts = F.transform(F.filter(places, lambda x: x["start"] >= x["at"]), lambda x: F.concat(_cut(pieces, x["at"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
            return F.concat(F.array_join(parts, ""), _cut(pieces, F.element_at(most, F.lit(-1)), F.length(text)))

        return _once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), joined_up)

    most = _running(F.transform(spans, lambda x: x["end"]), F.size(spans), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(_once(most, marked))
