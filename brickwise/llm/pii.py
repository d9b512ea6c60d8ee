"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is column expressions on the text: a pattern's matches and the gaps between them give the places
of the matches in code points; places are summed and texts cut in blocks, so that many matches in one text cost little
more than their number. The patterns are written with possessive loops and start conditions so that
no text, however long or repetitive, makes the matcher backtrack or recurse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.functions.arrays import cut, let, running, running_totals

SPAN = "struct<start:long,rank:int,kind:string,end:long,match:string,score:double>"


def _ip_valid(m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return m.rlike(f"^{part}(?:\\.{part}){{3}}$")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    digit = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).otherwise(doubled(digit(i))))
    return total % 10 == 0


def _card_valid(m: Column) -> Column:
    digits = _digits(m)
    return F.when(F.length(digits).between(14, 19), luhn_valid(digits)).otherwise(False)


def _phone_valid(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def iban_valid(m: Column) -> Column:
    """Whether an account number without its blanks passes the mod-97 checksum."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    fold = lambda acc, i: F.when(code(i) >= 65, (acc * 100 + code(i) - 55) % 97).otherwise((acc * 10 + code(i) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), fold) == 1


@dataclass(frozen=True)
class Kind:
    """How one kind is proposed (a pattern, a string without which it can't match, the least length of a match), confirmed and scored."""

    name: str
    pattern: str
    needs: str | None
    valid: object
    prior: float
    context: str
    base: bool
    shortest: int


#: A kept span scores at least this; a context word within CONTEXT_CHARS before or after it adds CONTEXT_SCORE.
THRESHOLD, CONTEXT_SCORE, CONTEXT_CHARS = 0.5, 0.3, 48

KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, 0.7, "mail|contact|write to", True, 5),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _ip_valid, 0.6, r"\bip\b|address|host|server", True, 7),
    Kind("card", r"(?=[0-9 -]{14})[0-9]++(?:[ -][0-9]++)*+", None, _card_valid, 0.6, "card|visa|credit|payment", True, 14),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", _phone_valid, 0.6, "phone|tel|call|fax|mobile", True, 3),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", None, iban_valid, 0.6, "iban|account|bank", False, 15),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", None, 0.3, r"\bssn\b|social security|tax id", False, 11),
    Kind("localphone", r"(?<![0-9+(). -])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", None, None, 0.3, "phone|tel|call|fax|mobile", False, 12),
]


def _proposed(text: Column, rank: int, kind: Kind) -> Column:
    """Array of SPAN of the confirmed matches of one kind, in order."""
    reach = -(-CONTEXT_CHARS // kind.shortest)  # so many matches are as long as the context
    first = lambda x: F.left(x, F.lit(CONTEXT_CHARS))
    last = lambda x: F.right(x, F.lit(CONTEXT_CHARS))

    def spans(s: Column) -> Column:
        gap, match = F.get(s["gaps"], s["i"]), F.get(s["found"], s["i"])
        start = F.get(s["totals"], s["i"]) + F.length(gap)
        low = F.greatest(s["i"] - reach, F.lit(0))
        before = last(F.concat(F.array_join(F.slice(s["ahead"], low + 1, s["i"] - low), ""), last(gap)))
        after = first(F.concat(first(F.get(s["gaps"], s["i"] + 1)), F.array_join(F.slice(s["behind"], s["i"] + 2, F.lit(reach)), "")))
        near = F.lower(F.concat(before, F.lit("\n"), after))
        score = F.lit(kind.prior) + F.when(near.rlike(kind.context), CONTEXT_SCORE).otherwise(0.0)
        ok = (score >= THRESHOLD) & (kind.valid(match) if kind.valid else F.lit(True))
        end = start + F.length(match)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"), match.alias("match"),
            score.alias("score"))
        return F.struct(ok.alias("ok"), span.alias("span"))

    def placed(s: Column) -> Column:
        following = F.slice(s["gaps"], F.lit(2), F.size(s["found"]))
        facts = F.struct(
            s["gaps"].alias("gaps"), s["found"].alias("found"),
            running_totals(F.zip_with(s["gaps"], s["found"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))).alias("totals"),
            F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["found"])), s["found"], lambda g, m: last(F.concat(last(g), last(m)))).alias("ahead"),
            F.zip_with(s["found"], following, lambda m, g: first(F.concat(first(m), first(g)))).alias("behind"),
        )
        numbers = F.sequence(F.lit(0), F.size(s["found"]) - 1)
        item = lambda f, i: spans({**{k: f[k] for k in ("gaps", "found", "totals", "ahead", "behind")}, "i": i})
        return let(facts, lambda f: F.filter(F.transform(numbers, lambda i: item(f, i)), lambda x: x["ok"]))

    pieces = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    kept = F.transform(let(pieces, placed), lambda x: x["span"])
    may = text.contains(kind.needs) if kind.needs else F.lit(True)
    return F.when(may & text.rlike(kind.pattern), kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``, whose ends grow with their starts. Both are looked through together, in order."""
    place = lambda x, own: F.struct(x["start"].alias("start"), F.when(F.lit(own), F.lit(None).cast("long")).otherwise(x["end"]).alias("reach"),
        F.lit(own).alias("own"), x.alias("span"))
    both = F.array_sort(F.concat(F.transform(base, lambda x: place(x, False)), F.transform(spans, lambda x: place(x, True))))
    largest, least = (lambda a, b: F.greatest(a, b)), (lambda a, b: F.least(a, b))

    def looked(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: F.coalesce(x["reach"], F.lit(-1).cast("long"))), F.lit(-1).cast("long"), largest)
        far = F.lit(1 << 62).cast("long")
        begins = F.reverse(running(F.reverse(F.transform(s, lambda x: F.when(x["own"], far).otherwise(x["start"]))), far, least))
        zipped = F.arrays_zip(s.alias("x"), ends.alias("end"), begins.alias("begin"))
        clear = lambda z: z["x"]["own"] & (z["end"] <= z["x"]["start"]) & (z["begin"] >= z["x"]["span"]["end"])
        return F.transform(F.filter(zipped, clear), lambda z: z["x"]["span"])

    return let(both, looked)


def find_spans(documents: DataFrame, text_col: str = "text", base_col: str = "_bw_base", spans_col: str = "_bw_spans") -> DataFrame:
    """``documents`` with two arrays of spans (start, rank, kind, end, match, score), by start, then kind as listed.

    ``base_col`` has the kinds email, ip, card and phone; ``spans_col`` has these and the added kinds, less the
    added ones that overlap a base one. Places count code points, the end is exclusive. A null or empty text has no spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda base: F.array_sort(F.concat(*[_proposed(text, i, k) for i, k in enumerate(KINDS) if k.base is base]))
    both = documents.withColumn(base_col, of(True)).withColumn("_bw_more", of(False))
    added = F.when(F.size(base_col) == 0, F.col("_bw_more")).otherwise(_apart(F.col("_bw_more"), F.col(base_col)))
    return both.withColumn(spans_col, F.when(F.size("_bw_more") == 0, F.col(base_col)).otherwise(F.array_sort(F.concat(F.col(base_col),
        added)))).drop("_bw_more")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of base spans by kind, the digest of the base spans, and all spans as text.

    Every row gives a row: a null or empty text has no spans (the digest of the empty string), ids may be null
    or repeated, an empty table gives no rows, other columns are ignored.
    """
    found = find_spans(documents.select(F.col(id_col), F.col(text_col)), text_col)
    count = lambda kind: F.size(F.filter("_bw_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *[count(k.name) for k in KINDS if k.base], F.sha2(_listed("_bw_base").cast("binary"), 256).alias("base_sha256"),
        _listed("_bw_spans").alias("spans"))


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with every span replaced by its kind in angle brackets, e.g. ``<EMAIL>``; spans that overlap become one.

    Other columns stay as they are; texts without spans, null ones among them, stay as they are.
    """
    text = F.col(text_col)
    longest = lambda a, b: F.greatest(a, b)

    def clean(spans: Column) -> Column:
        reached = running(F.transform(spans, lambda x: x["end"]), F.lit(0).cast("long"), longest)
        opened = F.filter(F.zip_with(spans, reached, lambda x, at: F.struct(at.alias("start"), x["start"].alias("end"), x["kind"].alias("kind"))),
            lambda x: x["end"] >= x["start"])
        tagged = lambda o: F.zip_with(cut(text, o), o, lambda piece, x: F.concat(piece, F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        rest = F.array_max(F.transform(spans, lambda x: x["end"])).cast("int")
        return F.concat(F.array_join(let(opened, tagged), ""), F.substring(text, rest + 1, F.length(text)))

    found = find_spans(documents, text_col)
    return found.withColumn(text_col, F.when(F.size("_bw_spans") > 0, let(F.col("_bw_spans"), clean)).otherwise(text)).select(*documents.columns)
