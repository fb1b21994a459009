"""Checks on matched values. All are column expressions, run on candidates only."""

from __future__ import annotations

from pyspark.sql import Column

from spanveil.functions.arrays import bind, let

# Check letters and alphabets as published by their issuers.
NRIC_LETTERS = {"ST": "JZIHGFEDCBA", "FG": "XWUTRQPNMLK", "M": "XWUTRQPNJLK"}
NRIC_WEIGHTS = [2, 7, 6, 5, 4, 3, 2]
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
DAYS_IN_MONTH = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def _digit(text: str, position: int) -> str:
    """SQL: the digit at a one-based position."""
    return f"(ascii(substring({text}, {position}, 1)) - 48)"


def _weighted(text: str, weights: list[int], first: int = 1) -> str:
    """SQL: the sum of digits from ``first`` on, each times its weight."""
    return "(" + " + ".join(f"{w} * {_digit(text, first + i)}" for i, w in enumerate(weights)) + ")"


def _day_exists(year: str, month: str, day: str) -> str:
    """SQL: whether a date is in the calendar."""
    lengths = ", ".join(str(n) for n in DAYS_IN_MONTH)
    leap = f"({year} % 4 = 0 AND {year} % 100 <> 0 OR {year} % 400 = 0)"
    longest = f"get(array({lengths}), {month} - 1) - if({month} = 2 AND NOT {leap}, 1, 0)"
    return f"coalesce({day} BETWEEN 1 AND {longest}, false)"


def card(value: Column) -> Column:
    return bind(value, "luhn_check(regexp_replace(v, '[^0-9]', ''))")


def iban(value: Column) -> Column:
    """Remainder 97 over the rearranged number, digit by digit."""
    moved = "concat(substring(_n, 5), substring(_n, 1, 4))"
    step = "if(ascii(_c) < 58, _a * 10 + ascii(_c) - 48, _a * 100 + ascii(_c) - 55) % 97"
    return bind(value, let("replace(v, ' ', '')", "_n", f"aggregate(split({moved}, ''), 0, (_a, _c) -> {step}) = 1"))


def ipv4(value: Column) -> Column:
    return bind(value, "forall(split(v, '[.]'), _o -> cast(_o AS int) <= 255)")


def ipv6(value: Column) -> Column:
    """Eight groups, or fewer with one run of zeros left out."""
    odd = "v RLIKE '::.*::|:::|^:[^:]|[^:]:$'"
    return bind(
        value,
        let(
            "size(filter(split(v, ':'), _g -> _g <> ''))", "_filled",
            f"if(contains(v, '::'), _filled BETWEEN 1 AND 7 AND NOT {odd}, _filled = 8 AND size(split(v, ':')) = 8)",
        ),
    )


def nhs(value: Column) -> Column:
    check = f"(11 - {_weighted('_d', list(range(10, 1, -1)))} % 11) % 11"
    return bind(value, let("regexp_replace(v, '[^0-9]', '')", "_d", f"{check} = {_digit('_d', 10)}"))


def nric(value: Column) -> Column:
    shift = "CASE WHEN v RLIKE '^[TG]' THEN 4 WHEN v RLIKE '^M' THEN 3 ELSE 0 END"
    letters = "CASE " + " ".join(f"WHEN v RLIKE '^[{k}]' THEN '{x}'" for k, x in NRIC_LETTERS.items()) + " END"
    rest = f"({_weighted('v', NRIC_WEIGHTS, 2)} + {shift}) % 11"
    return bind(value, f"substring({letters}, {rest} + 1, 1) = substring(v, 9, 1)")


def medical_licence(value: Column) -> Column:
    return bind(value, f"{_weighted('v', [1, 2, 1, 2, 1, 2], 3)} % 10 = {_digit('v', 9)}")


def ssn(value: Column) -> Column:
    """Area, group and number as they are given out."""
    return bind(
        value,
        "substring(v, 1, 3) NOT IN ('000', '666') AND substring(v, 1, 1) <> '9' "
        "AND substring(v, 5, 2) <> '00' AND substring(v, 8, 4) <> '0000'",
    )


def iso_date(value: Column) -> Column:
    parts = [f"cast(substring(v, {p}, {n}) AS int)" for p, n in ((1, 4), (6, 2), (9, 2))]
    return bind(value, _day_exists(*parts))


def slashed_date(value: Column) -> Column:
    """Day first or month first."""
    one, two, year = (f"cast(get(_p, {i}) AS int)" for i in range(3))
    return bind(
        value, let("split(v, '[/.-]')", "_p", f"({_day_exists(year, two, one)} OR {_day_exists(year, one, two)})")
    )


def wallet(value: Column) -> Column:
    """Base-58 address: 21 bytes and the first 4 bytes of their double SHA-256.

    The number is kept as nine limbs of 24 bits, lowest first.
    """
    limbs, bits = 9, 24
    carry = f"cast(instr('{BASE58}', _c) - 1 AS bigint)"
    out = []
    for j in range(limbs):
        total = f"(get(_n, {j}) * 58 + {carry})"
        out.append(f"{total} & {(1 << bits) - 1}")
        carry = f"shiftright({total}, {bits})"
    zeros = ", ".join(["0L"] * limbs)
    number = f"aggregate(split(v, ''), array({zeros}), (_n, _c) -> array({', '.join(out)}))"
    # the top limb holds one byte, the others three each
    hexed = ", ".join(
        [f"lpad(hex(get(_n, {limbs - 1})), 2, '0')"]
        + [f"lpad(hex(get(_n, {j})), 6, '0')" for j in range(limbs - 2, -1, -1)]
    )
    check = "upper(substring(sha2(unhex(sha2(unhex(substring(_h, 1, 42)), 256)), 256), 1, 8))"
    verdict = let(f"concat({hexed})", "_h", f"{check} = substring(_h, 43, 8)")
    return bind(value, let(number, "_n", f"get(_n, {limbs - 1}) < 256 AND {verdict}"))
