"""What a lax field takes besides its own type, for readers of whole files: numbers and days that are spelled as texts or as other numbers."""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Callable

BAD = object()


def number(x: object) -> object:
    if isinstance(x, str):
        try:
            x = float(x.strip().replace("_", "x"))
        except ValueError:
            return BAD
    if not isinstance(x, (int, float)):
        return BAD
    try:
        x = float(x)
    except OverflowError:
        return BAD
    return x if math.isfinite(x) else BAD


def whole(least: int, most: int) -> Callable[[object], object]:
    def check(x: object) -> object:
        if isinstance(x, str):
            x = x.strip()
            if not re.fullmatch(r"[+-]?\d+(\.0*)?", x, re.ASCII):
                return BAD
            x = int(x.partition(".")[0])
        if isinstance(x, float):
            if not math.isfinite(x) or x != int(x):
                return BAD
            x = int(x)
        return int(x) if isinstance(x, int) and least <= x <= most else BAD

    return check


def day(x: object) -> object:
    """An ISO day; a midnight of seconds since 1970 as a number or digits; a date and time at midnight."""
    if x is None:
        return None
    if isinstance(x, str):
        if re.fullmatch(r"\d{4}-\d\d-\d\d", x, re.ASCII):
            try:
                return datetime.date.fromisoformat(x).isoformat()
            except ValueError:
                return BAD
        if m := re.fullmatch(r"(\d{4}-\d\d-\d\d)[T ]00:00(:00(\.0+)?)?(Z|[+-]00:?00)?", x, re.ASCII):
            return day(m[1])
        if not re.fullmatch(r"[+-]?\d+(\.\d+)?", x, re.ASCII) or len(x) == 8:
            return BAD
        x = float(x)
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x % 86400:
        return BAD
    if abs(x) > 2e10:
        x /= 1000
    try:
        return (datetime.date(1970, 1, 1) + datetime.timedelta(days=x / 86400)).isoformat()
    except OverflowError:
        return BAD
