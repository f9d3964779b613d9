"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Only DataFrame expressions.  Each kind has one pattern, scanned left to right without overlaps; a match
that fails its test is dropped and its text is not tried again.  The patterns are written so that the
regex engine neither backtracks over a run of characters nor recurses: possessive repeats, and a
look-behind that lets a run be tried from its first character only (``\\G``: or from the end of the match
before).  Offsets count code points; ends are exclusive.

Null text has no spans.  A text without a character that a kind needs skips that kind's pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import free_name

CONTEXT_WIDTH = 48
CONTEXT_GAIN = 0.3


@dataclass(frozen=True)
class Kind:
    """``needs``: a cheap necessary test.  ``score``: of a confirmed span; a context word nearby adds CONTEXT_GAIN."""

    name: str
    pattern: str
    needs: str
    score: float
    context: str


BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7,
         "mail|contact|write|kontakt|correo|courriel|escrib"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5, "ip|host|server|address|adresse|login|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.6, "card|visa|master|amex|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, "phone|call|tel|mobile|fax|anruf|llam|appel"),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+(?![A-Za-z0-9])", "", 0.7,
         "iban|account|bank|konto|cuenta|compte"),
)
KINDS = BASE + ADDED


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces leaves 1: the first four characters go last, letters count as 10 to 35."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    step = lambda rest, ch: F.when(
        ch.between("0", "9"), (rest * 10 + F.ascii(ch) - 48) % 97
    ).otherwise((rest * 100 + F.ascii(ch) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, ch: F.when(ch == "", rest).otherwise(step(rest, ch))) == 1


def confirmed(kind: str, hit: Column) -> Column:
    """The test of a match of ``kind``."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(hit)
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(hit, F.lit(" ")))
    return F.lit(True)


def _may_hold(kind: Kind, text: Column) -> Column:
    if kind.needs:
        return F.contains(text, F.lit(kind.needs))
    return text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}" if kind.name == "card" else "[A-Z]{2}[0-9]{2}")


def _located(kind: Kind, text: Column, hits: Column) -> Column:
    """Confirmed matches as array<struct<kind, start, end, text, score>>: what lies between the matches gives the offsets."""
    between = F.split(text, kind.pattern, -1)
    start = F.aggregate(
        F.zip_with(hits, F.slice(between, F.lit(1), F.size(hits)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap"))),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int,text:string,score:double>>)").alias("out")),
        lambda state, x: _append(kind, text, state, x),
    )
    return start["out"]


def _append(kind: Kind, text: Column, state: Column, x: Column) -> Column:
    start = state["at"] + F.length(x["gap"])
    end = start + F.length(x["hit"])
    before = F.substring(x["gap"], F.greatest(F.lit(1), F.length(x["gap"]) - CONTEXT_WIDTH + 1), F.lit(CONTEXT_WIDTH))
    near = F.lower(before).rlike(rf"(?:{kind.context})")
    span = F.struct(
        F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("text"),
        (F.lit(kind.score) + F.when(near, CONTEXT_GAIN).otherwise(0.0)).alias("score"),
    )
    return F.struct(end.alias("at"), F.when(confirmed(kind.name, x["hit"]), F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))


def find(documents: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``documents`` with ``spans``: array<struct<kind, start, end, text, score>>, by kind in the given order, then start.

    A column named spans is replaced.  Repeated rows get equal spans; an empty table stays empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,text:string,score:double>>)")
    hit, span = ({k.name: free_name(documents, f"{lead}{k.name}") for k in kinds} for lead in ("_hits_", "_spans_"))
    hits = {hit[k.name]: F.when(_may_hold(k, t), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))) for k in kinds}
    found = {span[k.name]: F.when(F.size(hit[k.name]) > 0, _located(k, t, F.col(hit[k.name]))).otherwise(none) for k in kinds}
    return (
        documents.withColumns(hits).withColumns(found)
        .withColumn("spans", F.concat(*[F.col(c) for c in found])).drop(*hits, *found)
    )


def redact(documents: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets; overlapping spans become one, named by the
    first, of equal starts the longest.

    Null text stays null.  Columns keep their names and order.
    """
    spans_of, kept, cuts = (free_name(documents, c) for c in ("_spans", "_kept_spans", "_cut"))
    spans = F.array_sort(F.transform(spans_of, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    cut = lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(
            F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out")))
    done = F.aggregate(spans, state, cut)
    whole = F.concat(F.array_join(F.col(f"{cuts}.out"), ""), F.substring(F.col(text), F.col(f"{cuts}.at") + 1, F.length(text)))
    marked = find(documents.withColumnRenamed("spans", kept), text, kinds).withColumnRenamed("spans", spans_of)
    cleaned = marked.withColumn(cuts, F.when(F.size(spans_of) > 0, done)).withColumn(text, F.when(F.col(cuts).isNotNull(), whole).otherwise(F.col(text)))
    return cleaned.drop(cuts, spans_of).withColumnRenamed(kept, "spans").select(*documents.columns)


def digest(found: DataFrame, base: tuple[Kind, ...] = BASE) -> DataFrame:
    """The spans of ``find`` as counts by kind, a digest of the base kinds and one string of all spans."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of_base = F.filter("spans", lambda s: reduce(lambda a, b: a | b, [s["kind"] == k.name for k in base]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k.name).alias(f"n_{k.name}") for k in base]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.array_join(F.transform(of_base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"),
    )
