"""Personal data by regular expressions, confirmed by checksums and weighed by nearby context words.

DataFrame functions only. A pattern's matches and the gaps between them come from ``regexp_extract_all`` and ``split``,
which walk a text alike; their lengths add up to code-point offsets. The patterns are the base ones written so that
a long run of matching characters is passed once: possessive repeats, and a look-behind where a match can only begin
at the start of a run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Cheap test a text with a match always passes.
    hint: str
    context: str
    #: Score of a confirmed span without a context word nearby.
    score: float


#: Characters of an account number by country: the registry's countries and those that use the form without an entry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GF GP GQ GR IT KM MC MG MQ NC PF PM RE SM TD TF WF YT BL MF",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
#: A number ends where its country says, so an upper-case word or a number behind it is not taken along.
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(
    f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"

#: Kinds in their fixed order; the first four are the base kinds, the others are added by this method.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"@", r"e-?mail|contact|write|kontakt|correo|courriel", 0.8),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", r"\bip\b|host|server|address|login", 0.6),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", r"[0-9]",
         r"card|visa|master|credit|debit|karte|tarjeta|carte", 0.8),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", r"phone|tel|call|mobile|fax|whatsapp", 0.6),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}",
         r"iban|account|bank|konto|cuenta|compte", 0.9),
)
N_BASE = 4
#: Characters before and after a span that are searched for context words, and what one adds to the score.
CONTEXT_CHARS, CONTEXT_BONUS = 40, 0.1


def luhn(digits: Column) -> Column:
    """The checksum of payment cards: from the right, every second digit doubled, digits summed, a multiple of ten."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(code: Column) -> Column:
    """The account-number checksum: country and check digits moved to the end, letters as 10 to 35, remainder 1."""
    c = F.replace(code, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substr(c, F.lit(5)), F.substring(c, 1, 4)), "")

    def step(a, ch):
        return F.when(ch.between("0", "9"), (a * 10 + ch.cast("int")) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = F.lit("0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])")
        return F.regexp_like(match, F.concat(F.lit("^"), small, F.lit("(?:\\."), small, F.lit("){3}$")))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _placed(matches: Column, gaps: Column) -> Column:
    """``array<struct<start, end, match>>`` from the matches of a text and the gaps around them."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def _scored(spans: Column, text: Column, place: int, kind: Kind) -> Column:
    """The confirmed spans of one kind, each with the score that its surroundings leave."""

    def score(s):
        around = F.substr(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, s["end"] - s["start"] + 2 * CONTEXT_CHARS)
        bonus = F.when(F.regexp_like(around, F.lit("(?i)" + kind.context)), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind.name).alias("kind"),
                        s["end"].alias("end"), F.round(F.lit(kind.score) + bonus, 3).alias("score"))

    return F.transform(F.filter(spans, lambda s: confirmed(kind.name, s["match"])), score)


def _of_kind(spans: Column, place: int) -> Column:
    return F.filter(spans, lambda s: s["place"] == place)


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``array<struct<start, place, kind, end, score>>`` of all confirmed spans, by start and then kind.

    Offsets count code points and ends are exclusive. Kinds are searched separately, so spans of different kinds may
    overlap. A null or empty text has an empty array. No shuffle: each whole text is searched where it is read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs
    temp = [f"_pii_{k.name}_{i}" for k in KINDS for i in (0, 1)]
    for k in KINDS:
        hit = F.contains(t, F.lit(k.hint)) if k.hint == "@" else F.regexp_like(t, F.lit(k.hint))
        found = found.withColumn(f"_pii_{k.name}_0", F.when(hit, F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))))
    for k in KINDS:
        m = F.col(f"_pii_{k.name}_0")
        found = found.withColumn(f"_pii_{k.name}_1", F.when(F.size(m) > 0, _placed(m, F.split(t, k.pattern, -1))))
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint,score:double>>")
    parts = [F.coalesce(_scored(F.col(f"_pii_{k.name}_1"), t, i, k), none) for i, k in enumerate(KINDS)]
    return found.withColumn(out, F.array_sort(F.concat(*parts))).drop(*temp)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score`` for every document.

    Null ids and repeated rows keep one result row each; a null text counts as empty.
    """
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")), "_text", "_spans")
    base = F.filter("_spans", lambda s: s["place"] < N_BASE)
    counts = [F.size(_of_kind(F.col("_spans"), i)).cast("bigint").alias(f"n_{k.name}")
              for i, k in enumerate(KINDS[:N_BASE])]
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"),
                       F.array_max(F.transform("_spans", lambda s: s["score"])).alias("max_score"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    rows = with_spans(docs, text, "_pii_spans")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        part = F.concat(F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.array_append(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"))

    clean = F.aggregate("_pii_spans", start, step,
                        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(F.col(text), acc["at"] + 1)))
    return rows.withColumn(text, F.when(F.size("_pii_spans") > 0, clean).otherwise(F.col(text))).drop("_pii_spans")
