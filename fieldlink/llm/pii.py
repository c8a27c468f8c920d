"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and number rules
confirm them, and words nearby move the score; spans below the threshold go.
Four kinds are kept whenever their rule holds (their score starts above the
threshold): email, ip, card and phone.  Context words decide on the others.

Positions come from cutting the text at the matches: the lengths of gaps and
matches, added up, are the starts, and the gaps hold the words nearby.

The patterns are written so that Java's matcher neither recurses nor goes over a
run of characters twice: repetitions are possessive, and a match may only begin
at the head of a run of its characters or where the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.5
#: Code points on either side in which context words count, and what they add.
NEARBY = 40
CONTEXT_BONUS = 0.3
#: Elements that are totalled together in running sums, and code points of a text that are cut out of together.
BLOCK = 64
CHUNK = 256

_LOCAL = r"[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Cheap test that every text with a match passes.
    hint: str
    score: float
    context: str


# Kinds in output order; patterns of the first four as the contract states them.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]", 0.9, r"mail|contact|kontakt|correo"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]", 0.6, r"\bip\b|host|server|address|adresse"),
    Kind("card", r"(?:[0-9]{2,}+|[0-9][\x20-][0-9]++)(?:[\x20-][0-9]++)*+", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", 0.7, r"card|visa|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"phone|tel|call|mobil|handy|fax"),
    Kind("iban", r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", 0.8, r"iban|bank|konto|account|cuenta|compte"),
    Kind("short_card", r"(?<![0-9])(?<![0-9][\x20-])[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{3,5}(?![\x20-]?[0-9])", r"[0-9]{4}[\x20-]?[0-9]{6}", 0.3, r"card|amex|carte|karte|tarjeta"),
    Kind("ssn", r"(?<![0-9])(?<![0-9][\x20-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\x20-]?[0-9])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, r"ssn|social|security|tax"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    mirrored = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(mirrored, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number, letters as 10..35 and its head moved to the end, is 1 modulo 97."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    places = F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1)))
    return F.length(plain).between(15, 34) & (F.aggregate(places, F.lit(0), step) == 1)


def confirmed(kind: str, match: Column) -> Column:
    """The rule that a proposed span of this kind must pass."""
    n = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(match))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "short_card":
        return n.between(13, 15) & luhn(_digits(match))
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


SPAN = "array<struct<start:int,end:int,score:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it many times."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, join: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """Running sums (or greatest values) of an array of non-negative ints, each with its own element.

    Blocks of BLOCK elements are totalled, their totals run on the next level, and
    an element adds those before it in its block: no array grows step by step.
    """
    zero = F.lit(0)
    total = lambda part: F.aggregate(part, zero, join)
    if levels == 1:
        return F.transform(values, lambda _, i: total(F.slice(values, F.lit(1), i + 1)))
    number = lambda i: F.floor(i / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(zero, number(F.greatest(F.size(values) - 1, zero))), lambda k: total(F.slice(values, k * BLOCK + 1, F.lit(BLOCK))))

    def placed(upto: Column) -> Column:
        before = lambda i: F.when(number(i) > 0, F.get(upto, number(i) - 1)).otherwise(zero)
        return F.transform(values, lambda _, i: join(before(i), total(F.slice(values, number(i) * BLOCK + 1, i % BLOCK + 1))))

    return _let(blocks, lambda bs: _let(_running(bs, join, levels - 1), placed))


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, with scores."""

    def parts(cut: Column) -> Column:
        gap = lambda i: F.get(cut["gaps"], i)
        return F.transform(
            cut["found"],
            lambda m, i: F.struct(
                m.alias("match"), F.length(m).alias("size"), F.length(gap(i)).alias("gap"),
                F.concat_ws(" ", F.right(gap(i), F.lit(NEARBY)), F.left(gap(i + 1), F.lit(NEARBY))).alias("near"),
            ),
        )

    def place(rows: Column) -> Column:
        ends = _let(F.transform(rows, lambda p: p["gap"] + p["size"]), lambda v: _running(v, lambda a, b: a + b))
        return _let(ends, lambda at: F.transform(
            rows, lambda p, i: F.struct((F.get(at, i) - p["size"]).alias("start"), F.get(at, i).alias("end"), p["match"].alias("match"), p["near"].alias("near"))
        ))

    cut = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"), F.split(text, kind.pattern, -1).alias("gaps"))
    placed = _let(_let(cut, parts), place)
    good = F.filter(placed, lambda s: confirmed(kind.name, s["match"]))
    scored = F.transform(
        good,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.lower(s["near"]).rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)).alias("score"),
        ),
    )
    kept = F.filter(scored, lambda s: s["score"] >= THRESHOLD).cast(SPAN)
    return F.when(text.rlike(kind.hint), kept).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """The frame with one array column per kind: (start, end exclusive, score), in code points, by start.

    Null and empty texts give empty arrays; repeated rows and an empty table stay as
    they are.  All other columns stay; one that has the name of a span column is an
    error.  Time grows with the text and its spans, not with their product.
    """
    taken = [prefix + k.name for k in KINDS if prefix + k.name in docs.columns]
    if taken:
        raise ValueError(f"columns exist already, choose another prefix: {taken}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumns({prefix + k.name: _spans(text, k) for k in KINDS})


def joined(kinds: tuple[str, ...], prefix: str = "pii_") -> Column:
    """kind:start:end of all spans of these kinds, by kind, then start, comma-joined."""

    def texts(kind: str) -> Column:
        return F.transform(F.col(prefix + kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.concat_ws(",", *map(texts, kinds))


def redact(docs: DataFrame, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """The frame of :func:`find` with every span replaced by ``<KIND>``, and without the span columns.

    Where spans of several kinds overlap, the one that starts first (the longest of
    these) names the whole stretch.  Texts without spans stay as they are, null included.
    """
    text = F.col(f"`{text_col}`")
    flat = "array<struct<start:int,back:int,kind:string>>"

    def rows(kind: str) -> Column:
        return F.transform(F.col(prefix + kind), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(kind.upper()).alias("kind")))

    def clean(given: Column) -> Column:
        spans, chunks = given["spans"], given["chunks"]
        piece = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))

        def between(a: Column, b: Column) -> Column:
            """The text from a to b, out of its chunks."""
            first, last = F.floor(a / F.lit(CHUNK)).cast("int"), F.floor(b / F.lit(CHUNK)).cast("int")
            whole = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            apart = F.concat(F.substring(piece(first), a % CHUNK + 1, F.lit(CHUNK)), whole, F.substring(piece(last), F.lit(1), b % CHUNK))
            return F.when(b <= a, "").when(first == last, F.substring(piece(first), a % CHUNK + 1, b - a)).otherwise(apart)

        def put(upto: Column) -> Column:
            done = lambda i: F.when(i > 0, F.get(upto, i - 1)).otherwise(F.lit(0))
            tag = lambda s, i: F.concat(between(done(i), s["start"]), F.lit("<"), s["kind"], F.lit(">"))
            out = F.transform(spans, lambda s, i: F.when(s["start"] >= done(i), tag(s, i)).otherwise(""))
            rest = between(F.get(upto, F.size(upto) - 1), given["length"])
            return F.concat(F.array_join(out, ""), rest)

        ends = _let(F.transform(spans, lambda s: -s["back"]), lambda v: _running(v, lambda a, b: F.greatest(a, b)))
        return _let(ends, put)

    every = F.sort_array(F.concat(*(rows(k.name) for k in KINDS)).cast(flat))
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    given = F.struct(every.alias("spans"), chunks.alias("chunks"), F.length(text).alias("length"))
    some = F.greatest(*(F.size(prefix + k.name) for k in KINDS)) > 0
    return docs.withColumn(text_col, F.when(some, _let(given, clean)).otherwise(text)).drop(*(prefix + k.name for k in KINDS))
