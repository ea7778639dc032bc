"""Problem 2: timestamps in mixed notations and zones become one unambiguous form.

An ordered cascade of anchored patterns rewrites a value into its parts; the parts are checked strictly (calendar,
clock, twelve-hour range) and only then turned into an instant. Everything is a JVM column expression.

Policies
* no zone: local time of the default zone given by the caller (null: UTC);
* a local time that occurs twice: the earlier instant; one that is skipped: the clock is read as not yet changed;
* an offset beats a region named beside it; an abbreviation stands for its own fixed offset;
* dotted dates are day first, year-first dates are year, month, day; with slashes, a part above 12, or else the weekday,
  or else an AM/PM mark (month first) decides; what stays open is no value;
* blank, vague and impossible values give null.
"""

from __future__ import annotations

from datetime import timedelta
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramma.functions.symbols import col_of

# Hours that a zone abbreviation stands for.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "SAST": 2, "IST": 5.5, "NPT": 5.75, "PKT": 5, "SGT": 8, "HKT": 8, "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "ACDT": 10.5,
    "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13, "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "BRT": -3, "ART": -3,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)\\.?"
)
_WEEKDAY = "(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?"
_OFFSET = r"[+-]\d{1,2}(?::?\d{2})?"
_REGION = r"[a-z]+(?:/[a-z0-9_+-]+)+"
_ABBR = "|".join(sorted((a.lower() for a in ABBREVIATIONS), key=len, reverse=True))
_ZONE = rf"(?:\s*\(?((?:utc|gmt)?\s*{_OFFSET}|{_ABBR}|{_REGION})\)?(?:\s*\[{_REGION}\]|\s*\[utc\])?|\s*\[({_REGION})\])?"
_CLOCK = r"(\d{1,2})[:.](\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([ap])\.?m(?![a-z])\.?)?"

#: (pattern, parts): the groups of the pattern in the order year|month|day|hour|minute|second|am-pm|zone|epoch|slash parts|weekday.
CASCADE: list[tuple[str, str]] = [
    # 2023-02-13, 2023/02/13, 2023-02-13T12:46:01.25+01:00[Europe/Berlin], 2022/05/11 (Mon) 01:44 GMT+2
    (rf"(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:\s*\(?{_WEEKDAY}\)?)?(?:(?:\s*t\s*|,?\s+){_CLOCK}{_ZONE})?", "$1|$3|$4|$5|$6|$7|$8|$9$10|||"),
    (r"(\d{4})[-/](\d{1,2})", "$1|$2|||||||||"),
    (r"(\d{4})", "$1||||||||||"),
    # 20220730, 20220730T130007.437Z
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,]\d+)?)?{_ZONE})?", "$1|$2|$3|$4|$5|$6||$7$8|||"),
    (r"(\d{13})", "||||||||$1||"),
    (r"(\d{10})", "||||||||$1000||"),
    # 18.03.2023, 26.3.2023, 03:35 Uhr
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_CLOCK}(?:\s*uhr)?{_ZONE})?", "$3|$2|$1|$4|$5|$6|$7|$8$9|||"),
    # 3:59 am on 13 December, 2022 (UTC+5:30)
    (rf"{_CLOCK}\s+on\s+(?:{_WEEKDAY},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH},?\s+(\d{{4}}){_ZONE}", "$7|$6|$5|$1|$2|$3|$4|$8$9|||"),
    # 10 November 2022; Mon 10 Oct 2022; Thu, 12 Jan 2023 16:42:53 +0545; Sunday, 20 November 2022 at 3.45am
    (rf"(?:{_WEEKDAY},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\.?\s+(?:of\s+)?{_MONTH},?\s+(\d{{4}})(?:(?:,|\s+at)?\s+{_CLOCK}{_ZONE})?", "$3|$2|$1|$4|$5|$6|$7|$8$9|||"),
    # 20 Jul 2023, 15h34
    (rf"(?:{_WEEKDAY},?\s+)?(\d{{1,2}})\s+{_MONTH},?\s+(\d{{4}}),?\s+(\d{{1,2}})h(\d{{2}}){_ZONE}", "$3|$2|$1|$4|$5|||$6$7|||"),
    # December 17th, 2022; December 26, 2022 2:03 AM
    (rf"(?:{_WEEKDAY},?\s+)?{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:(?:,|\s+at)?\s+{_CLOCK}{_ZONE})?", "$3|$1|$2|$4|$5|$6|$7|$8$9|||"),
    (rf"{_MONTH},?\s+(\d{{4}})", "$2|$1|||||||||"),
    # 2023年6月20日, 2023年6月20日 21:42
    (rf"(\d{{4}})年(\d{{1,2}})月(?:(\d{{1,2}})日(?:\s*{_CLOCK}{_ZONE})?)?", "$1|$2|$3|$4|$5|$6|$7|$8$9|||"),
    # 08/06/2023 (Sun) 00:08; 28/06/2022 01:03; 05/21/2022 10:56 AM
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s*\(?({_WEEKDAY})\)?)?(?:,?\s+{_CLOCK}{_ZONE})?", "$3|||$5|$6|$7|$8|$9$10||$1/$2|$4"),
]
_FIELDS = ["y", "mo", "d", "h", "mi", "s", "ap", "zone", "epoch", "slash", "wd"]


def moment_parts(value: Column | str) -> Column:
    """The raw parts of a value as one ``|``-separated string, by the first pattern that fits whole; null if none does."""
    v = F.regexp_replace(F.trim(F.lower(col_of(value))), r"(?U)^\s+|\s+$", "")
    out = F.lit(None).cast("string")
    for pattern, parts in reversed(CASCADE):
        whole = f"^{pattern}$"
        out = F.when(v.rlike(whole), F.regexp_replace(v, whole, parts)).otherwise(out)
    return out


def with_moment(df: DataFrame, parts: str, home_tz: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the unambiguous form of the parts made by :func:`moment_parts`, null where they denote
    no possible date or time. Made in steps, so that no expression is repeated in the generated code."""
    fields = F.split(parts, r"\|")
    of = lambda c: F.col(f"_{c}")
    df = df.withColumn("_p", fields)
    df = df.withColumns({f"_{n}": F.nullif(F.col("_p")[i], F.lit("")) for i, n in enumerate(_FIELDS)})

    named = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    slash = F.split(of("slash"), "/")
    df = df.withColumns(
        {f"_{n}": of(n).try_cast("int") for n in ("y", "d", "h", "mi")}
        | {"_mo": F.coalesce(of("mo").try_cast("int"), named[F.substring(of("mo"), 1, 3)]), "_s": F.coalesce(of("s").try_cast("int"), F.lit(0)), "_epoch": of("epoch").try_cast("bigint")}
        | {"_a": slash[0].try_cast("int"), "_b": slash[1].try_cast("int"), "_wd": F.substring(of("wd"), 1, 3), "_zone": F.upper(F.regexp_replace(of("zone"), r"\s", ""))}
    )
    a, b, wd = of("a"), of("b"), of("wd")
    fits = lambda d, m: F.coalesce(F.substring(F.lower(F.date_format(_date(of("y"), m, d), "EEE")), 1, 3) == wd, F.lit(False))
    day_first = F.when(b > 12, False).when((a > 12) | (a == b), True).when(wd.isNotNull(), F.when(fits(a, b), True).when(fits(b, a), False)).when(of("ap").isNotNull(), False)
    hour = F.when(of("ap").isNull(), of("h")).when(of("h").between(1, 12), of("h") % 12 + F.when(of("ap") == "p", 12).otherwise(0))
    df = df.withColumns({"_f": F.when(a.isNotNull(), day_first), "_hour": hour, "_offset": F.regexp_extract(of("zone"), r"^(?:UTC|GMT)?([+-]\d{1,2}(?::?\d{2})?)$", 1)})

    slashed = a.isNotNull()
    df = df.withColumns(
        {
            "_mo": F.when(slashed, F.when(of("f"), b).when(~of("f"), a)).otherwise(of("mo")),
            "_d": F.when(slashed, F.when(of("f"), a).when(~of("f"), b)).otherwise(of("d")),
            "_open": slashed & of("f").isNull(),
            "_hh": F.regexp_extract(of("offset"), r"^[+-](\d{1,2}?):?(\d{2})?$", 1).try_cast("int"),
            "_mm": F.coalesce(F.regexp_extract(of("offset"), r"^[+-](\d{1,2}?):?(\d{2})?$", 2).try_cast("int"), F.lit(0)),
        }
    )
    clock_ok = of("hour").between(0, 23) & of("mi").between(0, 59) & of("s").between(0, 59)
    wall = F.when(clock_ok, F.try_make_timestamp(of("y"), of("mo"), of("d"), of("hour"), of("mi"), of("s").cast("decimal(8,6)"), F.lit("UTC")))
    fixed = F.create_map(*[x for n, h in ABBREVIATIONS.items() for x in (F.lit(n), F.lit(int(timedelta(hours=h).total_seconds())))])
    regions = {z.upper(): z for z in sorted(available_timezones()) if "/" in z}
    region = F.create_map(*[x for n, z in regions.items() for x in (F.lit(n), F.lit(z))])
    home = F.when(F.col(home_tz).isin([*regions.values(), "UTC", "GMT"]), F.col(home_tz)).otherwise("UTC")
    shift = F.when((of("hh") <= 18) & (of("mm") < 60), F.when(F.startswith(of("offset"), F.lit("-")), -1).otherwise(1) * (of("hh") * 3600 + of("mm") * 60))
    df = df.withColumns(
        {"_wall": wall, "_shift": F.when(of("offset") != "", shift).otherwise(fixed[of("zone")]), "_region": F.when(of("zone").isNull(), home).when(of("offset") == "", region[of("zone")])}
    )
    instant = F.when(of("shift").isNotNull(), F.unix_seconds(of("wall")) - of("shift")).when(of("region").isNotNull(), F.unix_seconds(F.to_utc_timestamp(of("wall"), of("region"))))
    df = df.withColumn("_e", F.when(of("epoch").isNotNull(), F.floor(of("epoch") / 1000)).when(of("h").isNotNull(), instant))

    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    year = F.lpad(of("y").cast("string"), 4, "0")
    text = (
        F.when(of("e").isNotNull(), _utc_text(of("e")))
        .when((of("y") < 1) | of("open") | of("h").isNotNull(), F.lit(None).cast("string"))
        .when(of("d").isNotNull(), F.when(_date(of("y"), of("mo"), of("d")).isNotNull(), F.concat_ws("-", year, two(of("mo")), two(of("d")))))
        .when(of("mo").isNotNull(), F.when(of("mo").between(1, 12), F.concat_ws("-", year, two(of("mo")))))
        .otherwise(year)
    )
    made = ["p", *_FIELDS, "a", "b", "f", "hour", "offset", "open", "hh", "mm", "wall", "shift", "region", "e"]
    return df.withColumn(out, text).drop(*[f"_{n}" for n in made])


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.to_date(F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit("UTC")))


def _utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC, whatever the session's zone is."""
    at = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
