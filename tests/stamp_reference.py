"""A plain reading of stamps, one value at a time, to hold the operator against."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
OFFSETS = {"utc": 0, "gmt": 0, "z": 0, "jst": 540, "cet": 60, "cest": 120, "est": -300, "edt": -240, "pst": -480, "pdt": -420}
NONE = ("none", "")
CLOCK = re.compile(r"[tT ,]\s*(\d{1,2}):?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?\s*(?:([apAP])\.?[mM]\.?(?![A-Za-z]))?\s*(.*)")


def day(y, m, d):
    try:
        return dt.date(int(y), int(m), int(d))
    except ValueError:
        return None


def ordinal(y, n):
    at = dt.date(int(y), 1, 1) + dt.timedelta(int(n) - 1)
    return at if int(n) >= 1 and at.year == int(y) else None


def week(y, w, d):
    try:
        return dt.date.fromisocalendar(int(y), int(w), int(d))
    except ValueError:
        return None


def shown(at):
    return "instant", at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def number(text):
    if len(text) == 8 and day(text[:4], text[4:6], text[6:]):
        return "day", str(day(text[:4], text[4:6], text[6:]))
    n = int(text)
    for unit in (1, 10**3, 10**6, 10**9):
        if 1577836800 <= n // unit < 1893456000:
            return shown(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=n * 10**6 // unit))
    return NONE


def forms(order):
    return (
        (r"(\d{4})[-/](\d\d)[-/](\d\d)(?!\d)", lambda m: day(*m.groups())),
        (r"(\d{4})(\d\d)(\d\d)(?=t)", lambda m: day(*m.groups())),
        (r"(\d{4})-(\d{3})$", lambda m: ordinal(m[1], m[2])),
        (r"(\d{4})-w(\d\d)-(\d)$", lambda m: week(m[1], m[2], m[3])),
        (r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", lambda m: day(m[3], m[1], m[2]) if order == "mdy" else day(m[3], m[2], m[1])),
        (r"(?:[a-z]{3}, )?(\d{1,2}) ([a-z]{3}) (\d{4})", lambda m: day(m[3], MONTHS.get(m[2], 0), m[1])),
        (r"([a-z]{3}) (\d{1,2}), (\d{4})", lambda m: day(m[3], MONTHS.get(m[1], 0), m[2])),
    )


def ref(value, home, order):
    text = value.strip()
    if re.fullmatch(r"\d+", text):
        return number(text)
    date, rest = None, ""
    for form, read in forms(order):
        m = re.match(form, text.lower())
        if m:
            date, rest = read(m), text[m.end() :]
            break
    if date is None:
        return NONE
    if not rest:
        return "day", str(date)
    m = CLOCK.fullmatch(rest)
    if not m:
        return NONE
    hour, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
    if m[5]:
        if not 1 <= hour <= 12:
            return NONE
        hour = hour % 12 + (12 if m[5].lower() == "p" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return NONE
    local = dt.datetime(date.year, date.month, date.day, hour, minute, second, int(((m[4] or "") + "000000")[:6]))
    zone = m[6]
    offset = re.fullmatch(r"([+-])(\d\d):?(\d\d)", zone)
    if offset:
        minutes = (int(offset[2]) * 60 + int(offset[3])) * (1 if offset[1] == "+" else -1)
        return shown(local - dt.timedelta(minutes=minutes))
    if zone.lower() in OFFSETS:
        return shown(local - dt.timedelta(minutes=OFFSETS[zone.lower()]))
    try:
        place = ZoneInfo(zone.strip("[]") or home)
    except Exception:
        return NONE
    instants = set()
    for fold in (0, 1):
        at = local.replace(tzinfo=place, fold=fold).astimezone(dt.timezone.utc)
        if at.astimezone(place).replace(tzinfo=None) == local:
            instants.add(at)
    if not instants:
        return "gap", ""
    return ("ambiguous", "") if len(instants) == 2 else shown(instants.pop())
