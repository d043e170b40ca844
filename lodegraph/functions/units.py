"""Unit spellings, number spellings and conversions to the common unit of each quantity."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple


class Unit(NamedTuple):
    quantity: str
    symbol: str
    scale: Fraction  # common = value * scale + offset
    offset: Fraction
    is_common: bool


# Quantity, unit symbol, scale and offset to the common unit, spellings (word stems take an optional s).
_TABLE = [
    ("temperature", "K", 1, 0, "K|kelvin|Kelvin|开尔文|开"),
    ("temperature", "°C", 1, "273.15", "°C|℃|ºC|degC|deg C|degree Celsius|degrees Celsius|Celsius|摄氏度"),
    ("temperature", "°F", "5/9", "45967/180", "°F|℉|ºF|degF|deg F|degree Fahrenheit|degrees Fahrenheit|Fahrenheit|华氏度"),
    ("stress", "MPa", 1, 0, "MPa|megapascal|N/mm²|N/mm2|N mm⁻²|newton per square millimetre|newtons per square millimetre|兆帕"),
    ("stress", "GPa", 1000, 0, "GPa|gigapascal|吉帕"),
    ("stress", "kPa", "1/1000", 0, "kPa|kilopascal|千帕"),
    ("stress", "Pa", "1/1000000", 0, "Pa|pascal|帕"),
    ("stress", "bar", "1/10", 0, "bar|巴"),
    ("stress", "psi", "0.006894757293168361", 0, "psi|磅每平方英寸|pound per square inch|pounds per square inch"),
    ("stress", "ksi", "6.894757293168361", 0, "ksi|千磅每平方英寸|kip per square inch|kips per square inch"),
    ("length", "µm", 1, 0, "µm|um|micron|micrometre|micrometer|微米"),
    ("length", "nm", "1/1000", 0, "nm|nanometre|nanometer|纳米"),
    ("length", "mm", 1000, 0, "mm|millimetre|millimeter|毫米"),
    ("length", "cm", 10000, 0, "cm|centimetre|centimeter|厘米"),
    ("length", "in", 25400, 0, "in|inch|inches|英寸"),
    ("length", "mil", "25.4", 0, "mil|密耳"),
    ("duration", "s", 1, 0, "s|sec|second|秒"),
    ("duration", "ms", "1/1000", 0, "ms|millisecond|毫秒"),
    ("duration", "min", 60, 0, "min|minute|分钟|分"),
    ("duration", "h", 3600, 0, "h|hr|hour|小时"),
    ("duration", "d", 86400, 0, "d|day|天"),
    ("frequency", "MHz", 1, 0, "MHz|megahertz|兆赫"),
    ("frequency", "Hz", "1/1000000", 0, "Hz|hertz|赫"),
    ("frequency", "kHz", "1/1000", 0, "kHz|kilohertz|千赫"),
    ("frequency", "GHz", 1000, 0, "GHz|gigahertz|吉赫"),
    ("frequency", "THz", 1000000, 0, "THz|terahertz|太赫"),
    ("energy", "meV", 1, 0, "meV|millielectronvolt|毫电子伏"),
    ("energy", "eV", 1000, 0, "eV|electronvolt|电子伏"),
    ("energy", "kJ/mol", "10.364269656262175", 0, "kJ/mol|kJ mol⁻¹|kJ mol-1|kilojoule per mole|kilojoules per mole|kJ·mol⁻¹|千焦每摩尔"),
    ("mass", "mg", 1, 0, "mg|milligram|毫克"),
    ("mass", "µg", "1/1000", 0, "µg|ug|microgram|微克"),
    ("mass", "g", 1000, 0, "g|gram|克"),
    ("mass", "kg", 1000000, 0, "kg|kilogram|千克"),
    ("voltage", "mV", 1, 0, "mV|millivolt|毫伏"),
    ("voltage", "V", 1000, 0, "V|volt|伏"),
    ("voltage", "kV", 1000000, 0, "kV|kilovolt|千伏"),
    ("capacity", "mAh/g", 1, 0, "mAh/g|mAh g⁻¹|mAh g-1|毫安时每克"),
    ("capacity", "Ah/kg", 1, 0, "Ah/kg|Ah kg⁻¹|Ah kg-1|安时每千克"),
    ("capacity", "C/g", "1/3.6", 0, "C/g|C g⁻¹|C g-1|库每克|库仑每克"),
    ("density", "kg/m³", 1, 0, "kg/m³|kg/m3|kg m⁻³|kg m-3|千克每立方米"),
    ("density", "g/cm³", 1000, 0, "g/cm³|g/cm3|g/cc|g cm⁻³|g cm-3|克每立方厘米"),
    ("density", "lb/ft³", "16.018463373960142", 0, "lb/ft³|lb/ft3|lb ft⁻³|磅每立方英尺|pound per cubic foot|pounds per cubic foot"),
]
COMMON = {"temperature": "K", "stress": "MPa", "length": "µm", "duration": "s", "frequency": "MHz", "energy": "meV", "mass": "mg", "voltage": "mV", "capacity": "mAh/g", "density": "kg/m³"}


def _fraction(x: object) -> Fraction:
    a, _, b = str(x).partition("/")
    return Fraction(a) / Fraction(b or 1)


def unit_key(label: str) -> str:
    """One spelling of a unit label: width, micro signs, superscripts and spacing made alike."""
    text = unicodedata.normalize("NFKC", label).replace("−", "-").replace("\u00ad", "")
    text = re.sub(r"\s+", " ", text).strip(" \t.")
    text = re.sub(r" ?([/]) ?", r"\1", text)
    return text.lower() if len(re.sub(r"[^A-Za-z]", "", text)) > 4 else text


def _spellings() -> tuple[dict[str, Unit], list[str]]:
    by_key: dict[str, Unit] = {}
    raw: list[str] = []
    for quantity, symbol, scale, offset, names in _TABLE:
        unit = Unit(quantity, symbol, _fraction(scale), _fraction(offset), COMMON[quantity] == symbol)
        for name in names.split("|"):
            forms = [name, f"{name}s"] if re.fullmatch(r"[a-z]{3,}", name) and not name.endswith(("z", "es", "bar", "psi", "ksi", "sec", "min")) else [name]
            for form in forms:
                by_key.setdefault(unit_key(form), unit)
                raw.append(form)
    return by_key, raw


UNITS, _RAW = _spellings()


BY_SYMBOL = {symbol: UNITS[unit_key(symbol)] for _, symbol, *_ in _TABLE}


def lookup(label: str | None) -> Unit | None:
    """The unit a label names by the fixed table alone."""
    return UNITS.get(unit_key(label)) if label else None


_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_APPROX = re.compile(r"^(?:about|approx\.?|approximately|around|circa|ca\.|c\.|roughly|nearly|some|~|≈|∼|约为|约|大约)\s*", re.I)
_NUMBER = r"[-+−]?\d+(?:[.,\u00a0\u2009\u202f ]\d{3})+(?:[.]\d+)?(?!\d)|[-+−]?\d+(?:[.,]\d+)?"
_POWER = r"(?:\s*[×x*·]\s*10\s*(?:\^\s*)?(?P<pow>[-+−]?\d+)|[eE](?P<exp>[-+]?\d+))?"
VALUE = re.compile(rf"(?P<num>{_NUMBER}){_POWER}(?:\s*(?:±|\+/-)\s*[\d.,]+)?\s*(?P<unit>.*)", re.S)


def number(text: str, decimal_comma: bool | None = None) -> Decimal:
    """A written number. A comma before exactly three digits groups, unless ``decimal_comma`` says otherwise."""
    text = text.replace("−", "-")
    text = re.sub("[\u00a0\u2009\u202f ]", "", text)
    if "," in text and "." in text:
        return Decimal(text.replace(",", ""))
    if "," in text:
        grouped = re.fullmatch(r"[-+]?\d{1,3}(,\d{3})+", text) is not None
        if decimal_comma is None:
            decimal_comma = not grouped
        return Decimal(text.replace(",", "." if decimal_comma and text.count(",") == 1 else ""))
    return Decimal(text)


def parse_value(text: str | None, decimal_comma: bool | None = None) -> tuple[Decimal, str, bool] | None:
    """(number, unit label, comma is ambiguous) of one measured value; None for a range, share, count or ratio."""
    if text is None:
        return None
    text = re.sub(r"(?<=10)\s*([⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+)", lambda m: "^" + m[1].translate(_SUPER), text)
    text = unicodedata.normalize("NFKC", text).strip()
    text = re.sub("[\u200b-\u200f\u2060\ufeff\u00ad]", "", text)
    while (stripped := _APPROX.sub("", text)) != text:
        text = stripped
    found = VALUE.fullmatch(text)
    if not found:
        return None
    unit = found["unit"].strip()
    if re.match(r"[-–—~∼至到]\s*\d|to \d|of \d|%|(?:wt|vol|at|mol)\b\.? ?%", unit):
        return None
    ambiguous = re.fullmatch(r"[-+]?\d{1,3},\d{3}", found["num"]) is not None
    try:
        value = number(found["num"], decimal_comma)
    except ArithmeticError:
        return None
    power = found["pow"] or found["exp"]
    if power:
        if abs(int(power.replace("−", "-"))) > 30:
            return None
        value = value.scaleb(int(power.replace("−", "-")))
    return value, unit, ambiguous


def to_common(value: Decimal, unit: Unit) -> int:
    """The value in the common unit, to the nearest whole number, halves away from zero."""
    exact = Fraction(value) * unit.scale + unit.offset
    whole = (abs(exact) + Fraction(1, 2)).__floor__()
    return whole if exact >= 0 else -whole


#: A number in running text and what follows it; codes and parts of names are no numbers.
MEASURE = re.compile(r"(?<![A-Za-z0-9.])(?<!\d,)(?<![A-Za-z]-)(?P<num>\d+(?:[.,]\d+)*)(?=(?P<tail>.{0,48}))", re.S)
_CLAUSE = re.compile(r"[.,;:!?](?=\s|$|[㐀-鿿])|[。，；：、！？（）()\[\]]")
_HAN_RUN = re.compile(r"[㐀-鿿]+")


#: How a unit of several words goes on: a power or factor, what "per" or a degree is of.
_GOES_ON = re.compile(r"per|square|cubic|[A-Za-zµμ]{1,4}\^?[-−+]?\d")
_WAITS = {"per", "square", "cubic", "deg", "degree", "degrees"}


def labels_after(tail: str) -> list[str]:
    """What may be the unit label at the beginning of a text, longest first: the words of one unit, or six characters of Han."""
    clause = _CLAUSE.split(re.sub(r"[\s>]+", " ", tail).lstrip(), maxsplit=1)[0]
    if run := _HAN_RUN.match(clause):
        return beginnings(run[0][:6])
    words = clause.split(" ")
    n = 1
    while n < min(6, len(words)) and (words[n - 1].lower() in _WAITS or _GOES_ON.fullmatch(words[n])):
        n += 1
    return [x for x in beginnings(" ".join(words[:n])) if not x[0].isdigit() and len(x) <= 40]


def beginnings(label: str) -> list[str]:
    """A label and what it begins with, longest first: word by word, Han character by character."""
    if _HAN_RUN.match(label):
        return [label[:n] for n in range(len(label), 0, -1)]
    words = label.split(" ")
    return [x for n in range(len(words), 0, -1) if (x := " ".join(words[:n]).strip())]
