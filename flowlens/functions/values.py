"""Column expressions that clean single values of foreign records.

All take a string column and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank around a value, and the characters of a decimal number.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
# A decimal number as people write it; underscores may stand between digits.
_DIGITS = "[0-9]++(?:_[0-9]++)*+"
NUMBER = rf"^[+-]?+(?:{_DIGITS}\.?+(?:{_DIGITS})?+|\.{_DIGITS})(?:[eE][+-]?+{_DIGITS})?+$"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"({_OCTET}\.){{3}}{_OCTET}"
# Extended and basic dates, week dates, any one character before the time, cut-off times, zones without a colon.
ISO_TIME = (
    r"^(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{4})([0-9]{2})([0-9]{2})"  # 1-6: calendar
    r"|([0-9]{4})-W([0-9]{2})(?:-([1-7]))?|([0-9]{4})W([0-9]{2})([1-7])?)"  # 7-12: week
    r"(?:.([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?|([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]+))?)?)?"  # 13-19: clock
    r"(?:([+-])([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.][0-9]+)?)?|([0-9]{2})(?:([0-9]{2})(?:[.][0-9]+)?)?)?)?)?$"  # 20-25: zone
)
# The same groups side by side: year, month, day, week year, week, weekday, hour, minute, second, fraction, sign,
# hours, minutes, seconds of the zone. Of two spellings one is empty.
ISO_PARTS = "$1$4|$2$5|$3$6|$7$10|$8$11|$9$12|$13|$14$17|$15$18|$16$19|$20|$21|$22$24|$23$25"


def _ipv6_pattern() -> str:
    """Alternatives for 8 groups: written out, or with one ``::`` standing for the rest.

    A dotted IPv4 tail takes the room of two groups.
    """
    h = "[0-9a-fA-F]{1,4}"
    forms = [f"({h}:){{7}}{h}", f"({h}:){{6}}{IPV4}"]
    for before in range(8):
        head = "::" if before == 0 else f"{h}(:{h}){{{before - 1}}}::"
        after = 7 - before
        tail = f"({h}(:{h}){{0,{after - 1}}})?" if after else ""
        forms.append(head + tail)
        if before <= 5:
            room = 5 - before
            forms.append(head + (f"({h}:){{0,{room}}}" if room else "") + IPV4)
    return "(" + "|".join(forms) + ")(%[^%]+)?"


IPV6 = _ipv6_pattern()


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def is_blank(value: Column) -> Column:
    return value.isNull() | (strip(value) == "")


def clean_ip(value: Column) -> Column:
    """The trimmed address if it is a valid IPv4 or IPv6 address, else null."""
    return valid_ip(strip(value))


def valid_ip(text: Column) -> Column:
    """Same for a value that is trimmed already."""
    valid = F.when(text.contains(":"), text.rlike(f"^{IPV6}$")).otherwise(text.rlike(f"^{IPV4}$"))
    return F.when(valid, text)


def to_number(value: Column) -> Column:
    """The value as a double if it is written as a finite decimal number, else null (also when it is too large).

    The pattern keeps out what only Java reads as a number (``1d``, ``0x1p3``, ``Infinity``), and text
    that would fail in the cast, which costs an exception per value.
    """
    text = strip(value)
    written = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")))
    number = written.try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def clean_port(value: Column) -> Column:
    """Port 0..65535, blank gives 0, anything else null (the caller warns)."""
    return valid_port(strip(value), to_number(value).try_cast("int"))


def valid_port(text: Column, whole: Column) -> Column:
    """Same for trimmed text and its whole number (cut towards zero)."""
    return F.when(text.isNull() | (text == ""), F.lit(0)).when((whole >= 0) & (whole <= 65535), whole)


def protocol_name(value: Column) -> Column:
    text = F.upper(strip(value))
    return (
        F.when(value.isNull() | (value == ""), "OTHER")
        .when(text.isin("TCP", "6", "IPPROTO_TCP"), "TCP")
        .when(text.isin("UDP", "17", "IPPROTO_UDP"), "UDP")
        .when(text.isin("ICMP", "1", "IPPROTO_ICMP"), "ICMP")
        .otherwise(text)
    )


def protocol_id(name: Column) -> Column:
    """Id of a normalised protocol name in the 7-feature vector of imported flows."""
    return (
        F.when(name.isin("TCP", "HTTP", "HTTPS", "TLS"), 1.0)
        .when(name.isin("UDP", "DNS", "ARP"), 2.0)
        .when(name == "ICMP", 3.0)
        .otherwise(0.0)
    )


def flow_protocol_id(name: Column) -> Column:
    """Id of a transport protocol in the feature vector of captured flows."""
    return (
        F.when(name == "TCP", 1.0).when(name == "UDP", 2.0).when(name == "ICMP", 3.0).otherwise(0.0)
    )


def device_protocol_id(name: Column) -> Column:
    """IP protocol number used by the per-device profile."""
    text = F.upper(name)
    return (
        F.when(text.contains("TCP"), 6.0)
        .when(text.contains("UDP"), 17.0)
        .when(text.contains("ICMP"), 1.0)
        .otherwise(0.0)
    )


_CLOCK = "[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
# Shape of the text -> layouts tried on it. A layout is only tried on text of its shape:
# a failed attempt costs an exception.
LAYOUTS = {
    rf"^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}} {_CLOCK}$": ("yyyy-M-d H:m:s",),
    rf"^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}} {_CLOCK}\.[0-9]{{1,6}}$": (
        "yyyy-M-d H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
    ),
    rf"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} {_CLOCK}$": ("d/M/yyyy H:m:s", "M/d/yyyy H:m:s"),
    rf"^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}} {_CLOCK}$": ("yyyy/M/d H:m:s",),
}


def parse_time(value: Column) -> Column:
    """Epoch seconds or milliseconds, ISO text, then the usual layouts (day before month).

    Null when nothing fits. Text without a zone is read in the session zone, which is UTC.
    """
    return time_of(strip(value), to_number(value))


def time_of(text: Column, number: Column) -> Column:
    """Same for trimmed text and its number."""
    # Above 1e11 milliseconds, above 1e8 seconds; beyond the year 9999 a number is no time.
    seconds = (
        F.when((number > 1e11) & (number < 253402300800e3), number / 1000.0)
        .when((number > 1e8) & (number <= 1e11), number)
    )
    tried = [
        F.when(text.rlike(shape), F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in layouts]))
        for shape, layouts in LAYOUTS.items()
    ]
    return F.coalesce(
        F.timestamp_micros(F.rint(seconds * 1e6).cast("long")),
        iso_time(text),
        *tried,
    )


def iso_time(text: Column) -> Column:
    """ISO 8601 text as a time, null for other text and dates that do not exist. Digits beyond microseconds are cut."""
    plain = F.replace(text, F.lit("Z"), F.lit("+00:00"))

    def of(p: Column) -> Column:
        year, week, day = p[3].try_cast("int"), p[4].try_cast("int"), F.coalesce(p[5].try_cast("int"), F.lit(1))
        fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in the first week
        weeks = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
        by_week = F.when(week.between(1, weeks), F.date_add(F.trunc(fourth, "week"), (week - 1) * 7 + day - 1))
        date = F.when(p[3] == "", F.concat_ws("-", p[0], p[1], p[2])).otherwise(by_week.cast("string"))

        def or_zero(x: Column) -> Column:
            return F.when(x == "", "00").otherwise(x)

        fraction = F.rpad(F.substring(p[9], 1, 6), 6, "0")
        clock = F.concat(or_zero(p[6]), F.lit(":"), or_zero(p[7]), F.lit(":"), or_zero(p[8]), F.lit("."), fraction)
        zoned = p[10] != ""
        local = F.concat(date, F.lit(" "), clock, F.when(zoned, "+00:00").otherwise("")).try_cast("timestamp")
        apart = or_zero(p[11]).cast("int") * 3600 + or_zero(p[12]).cast("int") * 60 + or_zero(p[13]).cast("int")
        shift = F.when(p[10] == "-", -apart).otherwise(apart) * F.lit(1_000_000).cast("long")
        return F.when(~zoned, local).when(apart < 86_400, F.timestamp_micros(F.unix_micros(local) - shift))

    parts = F.split(F.regexp_replace(plain, ISO_TIME, ISO_PARTS), r"\|")
    return F.when(plain.rlike(ISO_TIME), let(parts, of))


def at_least(number: Column, default: float = 0.0, floor: float = 0.0) -> Column:
    return F.greatest(F.coalesce(number, F.lit(default)), F.lit(floor))


def clean_number(value: Column, default: float = 0.0, floor: float = 0.0) -> Column:
    """A number not below ``floor``; blank or malformed text gives the default, ``nan`` the floor."""
    number = at_least(to_number(value), default, floor)
    if default == floor:
        return number
    return F.when(F.lower(strip(value)).rlike(r"^[+-]?nan$"), F.lit(floor)).otherwise(number)


def clean_count(value: Column) -> Column:
    """A whole number >= 0; one too large for a long is malformed."""
    return whole_of(to_number(value))


def whole_of(number: Column) -> Column:
    return F.coalesce(at_least(number).try_cast("long"), F.lit(0))


def ground_truth(value: Column) -> Column:
    """Label aliases to Normal, Suspicious or Malicious; null for labels that are not evaluated."""
    text = strip(value)
    name = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))
    # Accepted spellings after capitalisation.
    return (
        F.when(name.isin("0", "Benign", "Normal"), "Normal")
        .when(name.isin("1", "Attack", "Malicious", "Dos", "Ddos", "Portscan", "Botnet"), "Malicious")
        .when(name.isin("Suspicious", "Probe"), "Suspicious")
    )


def iso_text(ts: Column) -> Column:
    """Timestamp as ISO text with microseconds, the form reports print."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def round_places(value: Column, places: int) -> Column:
    """A number >= 0 rounded to ``places`` decimals by its exact binary value, ties to even.

    Spark's ``round`` works on the shortest decimal text and rounds ties up, so it turns 2889.25
    into 2889.3 and 0.35 into 0.4. Reports need 2889.2 and 0.3 (0.35 is stored just below).
    The fraction is taken as a whole number of 2**-52 and divided exactly.
    """
    unit, scale = 1 << 52, 10**places
    one = F.lit(unit).cast("decimal(16,0)")

    def with_steps(parts: Column, rest_below: Column, whole: Column) -> Column:
        def finish(steps: Column) -> Column:
            rest = parts - steps * one
            half = F.lit(unit // 2).cast("decimal(16,0)")
            tie = (rest == half) & (((steps % 2) == 1) | (rest_below > F.floor(rest_below)))
            up = F.when((rest > half) | tie, 1).otherwise(0).cast("decimal(1,0)")
            return (whole * F.lit(scale).cast("decimal(8,0)") + steps + up).cast("double") / F.lit(float(scale))

        return let(F.floor(parts / one).cast("decimal(8,0)"), finish)

    def of_value(v: Column) -> Column:
        whole = F.floor(v).cast("decimal(18,0)")

        def of_fine(fine: Column) -> Column:
            # What a value below 1 has beyond 2**-52.
            below = (fine - F.floor(fine)) * F.lit(float(scale))
            parts = F.floor(fine).cast("decimal(16,0)") * F.lit(scale).cast("decimal(8,0)")
            return let(parts + F.floor(below).cast("decimal(8,0)"), lambda p: with_steps(p, below, whole))

        return let((v - F.floor(v)) * F.lit(float(unit)), of_fine)

    return let(value.cast("double"), of_value)
