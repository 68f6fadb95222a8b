"""Defaults that authors give, checked against the target type and put in one form for each value."""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from typing import Any

from .model import SparkDataType
from .vocabulary import INTEGER_BITS, Encoding, ParserType

_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_INSTANT = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,6}))?(Z|[+-][0-9]{2}:[0-9]{2})?")


def is_base64(text: str) -> bool:
    return len(text) % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/]*={0,2}", text) is not None


def _text(value: Any) -> str:
    if not isinstance(value, str):
        raise ValueError("must be a string")
    return value


def _integer(value: Any, bits: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError("must be an integer")
    if not -(1 << bits - 1) <= value < 1 << bits - 1:
        raise ValueError("is out of range")
    return value


def _floating(value: Any, single: bool) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError("must be a number")
    try:
        out = float(value)
        stored = struct.unpack("f", struct.pack("f", out))[0] if single else out
    except OverflowError:
        raise ValueError("is too large") from None
    if not math.isfinite(stored):
        raise ValueError("must be finite")
    if out and not stored:
        raise ValueError("vanishes in single precision")
    return out


def _decimal(value: Any, kind: SparkDataType) -> Decimal:
    if isinstance(value, bool) or not isinstance(value, (int, float, str, Decimal)):
        raise ValueError("must be a decimal number")
    try:
        number = Decimal(str(value))
    except InvalidOperation:
        raise ValueError("must be a decimal number") from None
    if not number.is_finite():
        raise ValueError("must be finite")
    sign, digits, exponent = number.as_tuple()
    whole = int("".join(map(str, digits)))
    if not whole:
        return Decimal(0).scaleb(-kind.scale)
    shift = exponent + kind.scale
    if abs(shift) > 400 or (shift < 0 and whole % 10**-shift):
        raise ValueError(f"does not fit {kind.canonical} exactly")
    units = whole * 10**shift if shift >= 0 else whole // 10**-shift
    if units >= 10**kind.precision:
        raise ValueError(f"does not fit {kind.canonical}")
    return Decimal((sign, tuple(map(int, str(units))), -kind.scale))


def _boolean(value: Any) -> bool:
    if not isinstance(value, bool):
        raise ValueError("must be true or false")
    return value


def _date(value: Any) -> str:
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value.isoformat()
    if not isinstance(value, str) or not _DAY.fullmatch(value):
        raise ValueError("must be a date as yyyy-MM-dd")
    return dt.date.fromisoformat(value).isoformat()


def _timestamp(value: Any, zoned: bool) -> str:
    """ISO text; an offset is turned into UTC."""
    if isinstance(value, dt.datetime):
        value = value.isoformat()
    m = _INSTANT.fullmatch(value) if isinstance(value, str) else None
    if not m:
        raise ValueError("must be a timestamp as yyyy-MM-ddTHH:mm:ss")
    moment, offset = dt.datetime.fromisoformat(m[1]), m[3]
    moment = moment.replace(microsecond=int((m[2] or "").ljust(6, "0") or 0))
    if offset:
        if not zoned:
            raise ValueError("must not have an offset")
        minutes = 0 if offset == "Z" else (1 if offset[0] == "+" else -1) * (int(offset[1:3]) * 60 + int(offset[4:]))
        if abs(minutes) > 18 * 60 or (offset != "Z" and int(offset[4:]) > 59):
            raise ValueError("has an offset beyond 18:00")
        try:
            moment -= dt.timedelta(minutes=minutes)
        except OverflowError:
            raise ValueError("is out of range") from None
    return moment.isoformat() + ("Z" if offset else "")


def _binary(value: Any, encoding: Encoding) -> str:
    text = _text(value)
    fine = {Encoding.BASE64: is_base64, Encoding.HEX: lambda x: re.fullmatch(r"[0-9A-Fa-f]*", x) is not None, Encoding.UTF8: lambda x: True}
    if not fine[encoding](text):
        raise ValueError(f"is not {encoding.value} text")
    return text


def typed_default(value: Any, kind: SparkDataType, encoding: Encoding = Encoding.BASE64) -> Any:
    """The default in its one form; ValueError says what is wrong with it."""
    if value is None:
        raise ValueError("must not be null")
    readers: dict[ParserType, Callable[[Any], Any]] = {
        ParserType.STRING: _text,
        ParserType.FLOAT: lambda v: _floating(v, True),
        ParserType.DOUBLE: lambda v: _floating(v, False),
        ParserType.DECIMAL: lambda v: _decimal(v, kind),
        ParserType.BOOLEAN: _boolean,
        ParserType.DATE: _date,
        ParserType.TIMESTAMP: lambda v: _timestamp(v, True),
        ParserType.TIMESTAMP_NTZ: lambda v: _timestamp(v, False),
        ParserType.BINARY: lambda v: _binary(v, encoding),
    }
    if kind.parser_type in INTEGER_BITS:
        return _integer(value, INTEGER_BITS[kind.parser_type])
    return readers[kind.parser_type](value)
