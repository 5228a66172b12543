"""Salary: the best-scored amount around the digits of each section, as columns.

Windows of 60 characters around up to 20 amounts of a section are read in steps, each a transform over the structs of
the step before, so that nothing is computed twice.  Ties go to the first window in section order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import text_of
from .patterns import every, has, java, let, lowered, met

# Currencies in order of precedence, periods, types and what makes a window no salary.
CURRENCIES = [
    ("RUB", r"\bRUB\b|\bRUR\b|₽|руб(?:\.|ля|лей|ли)?"),
    ("USD", r"\bUSD\b|\$|доллар(?:ов|а|ы)?"),
    ("EUR", r"\bEUR\b|€|евро"),
    ("GBP", r"\bGBP\b|£"),
    ("CHF", r"\bCHF\b|fr\."),
    ("SEK", r"\bSEK\b"),
    ("NOK", r"\bNOK\b"),
    ("DKK", r"\bDKK\b"),
    ("CZK", r"\bCZK\b"),
    ("HUF", r"\bHUF\b"),
    ("UAH", r"\bUAH\b|₴"),
    ("KZT", r"\bKZT\b|₸"),
    ("BYN", r"\bBYN\b"),
    ("PLN", r"\bPLN\b|zł"),
    ("RON", r"\bRON\b|\blei\b"),
    ("BGN", r"\bBGN\b|\bлв\b|\blev\b"),
    ("TRY", r"\bTRY\b|₺"),
]
CROWNS = {"SE": "SEK", "SWE": "SEK", "SWEDEN": "SEK", "NO": "NOK", "NOR": "NOK", "NORWAY": "NOK", "DK": "DKK", "DNK": "DKK", "DENMARK": "DKK"}
PERIODS = [
    ("hour", r"\bper\s*hour\b|\b/\s*h\b|\b/\s*hour\b|\bчас\b|\bв\s*час\b|\bчасов\b"),
    ("day", r"\bper\s*day\b|\b/\s*d\b|\b/\s*day\b|\bдень\b|\bв\s*день\b"),
    ("week", r"\bper\s*week\b|\b/\s*w\b|\b/\s*week\b|\bнедел\b|\bв\s*недел\b"),
    ("year", r"\bper\s*year\b|\b/\s*y\b|\b/\s*year\b|\bгод\b|\bв\s*год\b|\byearly\b|\bannual\b|\bper\s*annum\b|\bp\.?a\.?\b|\bpa\b|\bote\b|on-?target"),
    ("project", r"\bproject\b|\bза\s*проект\b"),
    ("year", r"\bpro\s*jahr\b|\bper\s*jahr\b|\bper\s*anno\b"),
]
FLOORS = {"hour": 5, "day": 50, "week": 100, "month": 200, "year": 5000, "project": 50}
MOST = 10_000_000
SIGNAL = r"\bsalary\b|\bcompensation\b|\bpay\b|\brate\b|\bremuneration\b|\bbase\b|\btotal\s+comp\b|\bote\b|on-?target"
ANY_SIGNAL = SIGNAL + r"|зарплат|зп\b|оклад|оплат[аы]|вознагражден"
NET, GROSS = r"\bnet\b|на\s*руки|после\s*налогов", r"\bgross\b|до\s*налогов|before\s*tax"
NEVER = [
    r"\b(years?|yrs?)\b|\bлет\b\s*опыт|\bопыт\b|\bexperience\b",
    r"\b\d{1,2}[:.]\d{2}\s*[-–]\s*\d{1,2}[:.]\d{2}\b",
    r"\b\d{1,3}\s*[-–]\s*\d{1,3}\s*%|\b\d{1,3}\s*%\b",
    r"\b20\d{2}\s*[-–]\s*20\d{2}\b",
]
HOURS, AT_WORK = r"\b\d{1,2}\s*[-–]\s*\d{1,2}\b", r"\b(раб|work|office|график|schedule|часов)\b"
WITHOUT_SIGNAL = r"\bbonus\b|\bбонус\b|\breferral\b|\bреферал\b|\b401k\b|\bpto\b|\bmitarbeit\w*|\bemployees?\b|\bstaff\b|\bколлег|\bсотрудник|\bpeople\b"
FOUNDED = r"\bsince\s+\d{4}\b|\bfounded\b|\bestablished\b|\bс\s*\d{4}\s*года\b|\bс\s*\d{4}\b"
NUMBER = r"(?:\d{1,3}(?:[\s.,'’]\d{3})+|\d+)"
SIGN = r"(?:[$€£₽₴₸₺]|\b(?:RUB|RUR|USD|EUR|GBP|CHF|SEK|NOK|DKK|CZK|HUF|PLN|RON|BGN|UAH|KZT|BYN|TRY)\b)?\s*"
THOUSAND = r"(\s*(?:k|к|тыс\.?|тысяч)\b)?"
RANGE = rf"(?:(от)\s*)?{SIGN}({NUMBER}){THOUSAND}\s*[-–]\s*{SIGN}({NUMBER}){THOUSAND}"
FROM, TO, SINGLE = rf"(от|from|starting\s+from)\s*{SIGN}({NUMBER}){THOUSAND}", rf"(до|up\s*to|to)\s*{SIGN}({NUMBER}){THOUSAND}", rf"{SIGN}({NUMBER}){THOUSAND}"
ANCHOR = r"\d{2,}(?:[\s.,'’]\d{3})*(?:\s*(?:k|к|тыс\.?|тысяч)\b)?"


def currency(text: Column, country: Column) -> Column:
    """The first currency that the text names; crowns by the country; null without any."""
    crowns = F.lit("UNKNOWN")
    for c, kr in CROWNS.items():
        crowns = F.when(F.upper(F.trim(country)) == c, kr).otherwise(crowns)
    out = F.when(has(text, r"\bkr\b"), crowns)
    for name, pattern in reversed(CURRENCIES):
        out = F.when(has(text, pattern), name).otherwise(out)
    return out


def amount(raw: Column, with_suffix: Column) -> Column:
    """A written number, rounded half up: the last of comma and dot is the decimal mark unless it parts thousands; null outside 1 to 10 million."""
    def plain(x: Column) -> Column:
        comma, dot = F.instr(F.reverse(x), ","), F.instr(F.reverse(x), ".")  # places from the end, 0: none
        drop, turn = (lambda y, c: F.replace(y, F.lit(c), F.lit(""))), (lambda y: F.replace(y, F.lit(","), F.lit(".")))
        return (
            F.when((comma > 0) & (dot > 0), F.when(comma < dot, turn(drop(x, "."))).otherwise(drop(x, ",")))
            .when(comma > 0, F.when(comma <= 3, turn(x)).otherwise(drop(x, ",")))
            .when((dot == 4) & F.rlike(x, F.lit(r"\.\d{3}(\.|$)")), drop(x, "."))
            .otherwise(x)
        )

    times = F.when(has(with_suffix, r"\bк\b|\bk\b|тыс"), 1000).otherwise(1)
    value = F.floor(let(F.regexp_replace(raw, r"[^0-9,.]", ""), plain).try_cast("double") * times + 0.5)
    return let(value, lambda v: F.when((v > 0) & (v <= MOST), v))


def _windows(section: Column, country: Column) -> Column:
    """array<struct<section, w, whole>>: 60 characters on both sides of the first 20 amounts of a section, and the currency that all of it names."""
    cut_up = lambda text: F.struct(text.alias("text"), F.slice(every(text, ANCHOR), 1, 20).alias("found"), F.split(text, java(ANCHOR)).alias("gaps"), _named(text, country).alias("whole"))
    parts = let(text_of(section), lambda text: F.when(F.rlike(text, F.lit(r"\d{2}")), cut_up(text)))

    def of(p: Column) -> Column:
        sizes = F.transform(p["found"], F.length)
        before = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(F.transform(p["gaps"], F.length), 1, i + 1), F.lit(0), lambda a, x: a + x)
        cut = lambda x, i: F.substring(p["text"], F.greatest(before(i) - 59, F.lit(1)), F.length(x) + 60 + F.least(before(i), F.lit(60)))
        return F.transform(p["found"], lambda x, i: F.struct(section["name"].alias("section"), cut(x, i).alias("w"), p["whole"].alias("whole")))

    return F.flatten(F.transform(F.array_compact(F.array(parts)), of))


def _named(text: Column, country: Column) -> Column:
    """The currency that a text names which speaks of pay."""
    return F.when(let(lowered(text), lambda low: met(low, ANY_SIGNAL)), currency(text, country))


def salary(sections: Column, country: Column | None = None, hint: Column | None = None, strict: bool = False) -> Column:
    """struct<min, max, currency, period, type, raw, confidence>; only a currency is found where a text speaks of pay without an amount."""
    none = F.lit(None).cast("string")
    country, hint = country if country is not None else none, hint if hint is not None else none
    g = lambda w, p, k: F.regexp_extract(w, java(p), k)

    def read(x: Column) -> Column:
        w = x["w"]
        period = F.lit("month")
        for name, p in reversed(PERIODS):
            period = F.when(has(w, p), name).otherwise(period)
        kind = F.when(has(w, NET), "net").when(has(w, GROSS), "gross").otherwise("unknown")
        found = F.when(has(w, RANGE), "range").when(has(w, FROM) | has(w, TO), "from_to").otherwise("single")
        return F.struct(x["section"].alias("section"), x["whole"].alias("whole"), w.alias("w"), period.alias("period"), kind.alias("type"), found.alias("found"), has(w, SIGNAL).alias("signal"), currency(w, country).alias("here"))

    def values(x: Column) -> Column:
        w = x["w"]
        left, right = F.trim(g(w, RANGE, 3)), F.trim(g(w, RANGE, 5))
        shared = lambda a, b: F.concat(F.lit(" "), F.when(a != "", a).otherwise(b))
        low = amount(g(w, RANGE, 2), F.concat(g(w, RANGE, 2), shared(left, right)))
        high = amount(g(w, RANGE, 4), F.concat(g(w, RANGE, 4), shared(right, left)))
        one = lambda p, k: amount(g(w, p, k), F.concat(g(w, p, k), g(w, p, k + 1)))
        is_range = x["found"] == "range"
        low, high = F.when(is_range, low).when(x["found"] == "from_to", one(FROM, 2)).otherwise(one(SINGLE, 1)), F.when(is_range, high).when(x["found"] == "from_to", one(TO, 2)).otherwise(one(SINGLE, 1))
        return F.struct(x.alias("x"), low.alias("low"), high.alias("high"))

    def floored(v: Column) -> Column:
        x, floor = v["x"], F.lit(50)
        for name, f in FLOORS.items():
            floor = F.when(x["period"] == name, f).otherwise(floor)
        swap = v["low"] > v["high"]
        low, high = F.when(swap & (x["found"] == "range"), v["high"]).otherwise(v["low"]), F.when(swap & (x["found"] == "range"), v["low"]).otherwise(v["high"])
        money = F.coalesce(x["here"], hint, x["whole"], F.lit("UNKNOWN"))
        return F.struct(x.alias("x"), F.when(low >= floor, low).alias("low"), F.when(high >= floor, high).alias("high"), money.alias("currency"))

    def fits(v: Column) -> Column:
        x = v["x"]
        never = has(x["w"], HOURS) & has(x["w"], AT_WORK)
        for p in NEVER:
            never = never | has(x["w"], p)
        never = never | (~x["signal"] & has(x["w"], WITHOUT_SIGNAL))
        a, b = F.coalesce(v["low"], v["high"]), F.coalesce(v["high"], v["low"])
        year = a.between(1900, 2100) & b.between(1900, 2100) & (has(x["w"], FOUNDED) | ~x["signal"])
        out = a.isNotNull() & ~never & ~year
        return out & ~((v["currency"] == "UNKNOWN") & ~x["signal"]) if strict else out

    def scored(v: Column) -> Column:
        x, one = v["x"], lambda c: F.coalesce(c, F.lit(False)).cast("int")
        base = F.when(x["section"] == "head", 3).when(x["section"] == "benefits", 2).when(x["section"] == "body", 1).otherwise(0)
        score = base + one(x["signal"]) + 2 * one(v["currency"] != "UNKNOWN") + F.when(x["found"] == "range", 3).when(x["found"] == "from_to", 2).otherwise(1) + one(x["period"] != "month") + one(x["type"] != "unknown") + one(v["low"] != v["high"])
        return F.struct(score.alias("score"), v["low"].alias("min"), v["high"].alias("max"), v["currency"].alias("currency"), x["period"].alias("period"), x["type"].alias("type"), F.trim(F.regexp_replace(x["w"], r"\s+", " ")).alias("raw"))

    windows = F.flatten(F.transform(sections, lambda s: _windows(s, country)))
    hits = F.slice(F.transform(F.filter(F.transform(F.transform(F.transform(windows, read), values), floored), fits), scored), 1, 15)
    # of equal scores the first: the reduce keeps what it holds unless the next is greater
    nothing = "struct<score:int,min:bigint,max:bigint,currency:string,period:string,type:string,raw:string>"
    best = F.aggregate(hits, F.lit(None).cast(nothing), lambda a, h: F.when(a.isNull() | (h["score"] > a["score"]), h.cast(nothing)).otherwise(a))
    only = F.element_at(F.concat(F.filter(F.transform(F.transform(sections, text_of), lambda t: F.nullif(_named(t, country), F.lit("UNKNOWN"))), lambda c: c.isNotNull()), F.array(none)), 1)
    cap = 10 if strict else 8

    def chosen(best: Column) -> Column:
        return F.struct(best["min"].alias("min"), best["max"].alias("max"), best["currency"].alias("currency"), best["period"].alias("period"), best["type"].alias("type"), best["raw"].alias("raw"), (F.least(best["score"], F.lit(cap)) / cap).alias("confidence"))

    def bare(money: Column) -> Column:
        nothing = F.lit(None).cast("bigint")
        return F.struct(nothing.alias("min"), nothing.alias("max"), F.coalesce(money, F.lit("UNKNOWN")).alias("currency"), F.lit("unknown").alias("period"), F.lit("unknown").alias("type"), money.alias("raw"), F.when(money.isNotNull(), 0.2).otherwise(0.0).alias("confidence"))

    return let(best, lambda b: F.when(b.isNotNull(), chosen(b)).otherwise(let(only, bare)))
