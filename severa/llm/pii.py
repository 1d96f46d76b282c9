"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Everything is a DataFrame expression on one row; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.llm.common import nested, rows_of


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. A base kind's valid spans stay at any score; others need the threshold."""

    name: str
    pattern: str
    score: float
    words: tuple[str, ...]
    base: bool = True
    #: A character without which the pattern can't match: a cheap test before the scan.
    needs: str | None = None


#: The patterns are linear-time forms of the contract's: a match starts where a run starts (or the last match ended)
#: and takes whole runs, so neither the runs nor their parts are ever tried again.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, ("mail", "contact", "write"), needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, ("ip", "address", "server", "host"), needs="."),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", 0.8, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, ("phone", "call", "tel", "fax", "mobile"), needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", 0.8, ("iban", "account", "bank", "transfer"), base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, ("ssn", "social security", "tax id"), base=False, needs="-"),
)
CONTEXT = 40
BONUS = 0.3
THRESHOLD = 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN, its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.split(F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value >= 65, (acc * 100 + value - 55) % 97).otherwise((acc * 10 + value - 48) % 97)

    return F.aggregate(F.array_remove(turned, ""), F.lit(0), lambda acc, c: step(acc, c).cast("int"))


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        # leading zeros apart, at most three digits and at most 255
        part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int").isNull() | (F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int") <= 255))
        return F.forall(F.split(x, r"\."), part)
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return _mod97(x) == 1
    return F.lit(True)


def _found(text: Column, kind: Kind) -> tuple[Column, Column]:
    """The kind's matches in the text, and the pieces between them, where there are matches."""
    could = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    matches = F.when(could, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))
    return F.when(F.size(matches) > 0, matches), F.split(text, kind.pattern, -1)


def _placed(kind_at: int, kind: Kind) -> Column:
    """From columns m{i}, the matches, and s{i}, the pieces between: spans with start, order, end, kind and score."""
    m, s = F.col(f"m{kind_at}"), F.col(f"s{kind_at}")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["length"]).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    both = F.zip_with(m, F.slice(s, F.lit(1), F.size(m)), lambda a, b: F.struct(F.length(b).alias("gap"), F.length(a).alias("length")))
    starts = F.aggregate(both, zero, step, lambda acc: acc["starts"])

    def span(x: Column, start: Column) -> Column:
        end, body = start + F.length(x), F.col("_text")
        left = F.greatest(start - CONTEXT, F.lit(0))
        near = F.lower(F.concat_ws(" ", F.substr(body, left + 1, start - left), F.substr(body, end + 1, F.lit(CONTEXT))))
        told = near.rlike("(?:^|[^a-z])(?:" + "|".join(kind.words) + ")")
        return F.struct(
            start.alias("start"), F.lit(kind_at).alias("order"), end.alias("end"), F.lit(kind.name).alias("kind"),
            F.least(F.lit(1.0), F.lit(kind.score) + F.when(told, F.lit(BONUS)).otherwise(F.lit(0.0))).alias("score"), F.coalesce(_valid(kind.name, x), F.lit(False)).alias("valid"),
        )

    made = F.zip_with(m, starts, span)
    kept = F.filter(made, lambda p: p["valid"] & (F.lit(kind.base) | (p["score"] >= THRESHOLD)))
    return F.coalesce(kept, F.array().cast(SPANS))


SPANS = "array<struct<start:int,order:int,end:int,kind:string,score:double,valid:boolean>>"


def scan(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column out: the array of its spans by start and kind, code points, end exclusive.

    A span has start, order (of its kind), end, kind, score and valid. Null and empty texts have none. Spans of
    different kinds may overlap; of one kind they don't. Other columns stay, whatever their names: those made on
    the way live in a struct of their own.
    """
    df = nested(docs, _text=F.coalesce(F.col(text), F.lit("")))
    found = {i: _found(F.col("_text"), k) for i, k in enumerate(KINDS)}
    df = df.select("*", *[m.alias(f"m{i}") for i, (m, _) in found.items()])
    # a text is cut again only for kinds that it holds
    df = df.select("_in", "_text", *[f"m{i}" for i in found], *[F.when(F.col(f"m{i}").isNotNull(), s).alias(f"s{i}") for i, (_, s) in found.items()])
    spans = F.array_sort(F.concat(*[F.when(F.col(f"m{i}").isNotNull(), _placed(i, k)).otherwise(F.array().cast(SPANS)) for i, k in enumerate(KINDS)]))
    return df.select(*rows_of(docs), spans.alias(out))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its id, n_<kind> of the base kinds, base_sha256 of its base spans and spans, all of them."""
    df = scan(docs.select(F.col(id_column), F.col(text).alias("_body")), "_body", "_spans")
    base = F.filter("_spans", lambda p: p["kind"].isin([k.name for k in KINDS if k.base]))
    kinds = F.transform("_spans", lambda p: p["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return df.select(id_column, *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def mask(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets, as in [EMAIL]; overlapping spans are one, named by the first.

    Texts without spans stay as they are, nulls included. length names a column that holds the text's code points:
    it is set anew where the text changed.
    """
    df = scan(nested(docs, _body=F.col(text)), "_body", "_pii")
    body = F.col("_body")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, p: Column) -> Column:
        gap = F.substr(body, acc["at"] + 1, F.greatest(p["start"] - acc["at"], F.lit(0)))
        new = F.concat(acc["parts"], F.array(gap, F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], p["end"]).alias("at"), F.when(p["start"] >= acc["at"], new).otherwise(acc["parts"]).alias("parts"))

    told = F.aggregate("_pii", zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(body, acc["at"] + 1)))
    dirty = F.size("_pii") > 0
    df = df.withColumn("_masked", F.when(dirty, told).otherwise(body))
    own = dict(zip(docs.columns, rows_of(docs)))
    if length:
        own[length] = F.when(dirty, F.length("_masked")).otherwise(own[length]).cast(docs.schema[length].dataType).alias(length)
    return df.select(*(own | {text: F.col("_masked").alias(text)}).values())
