"""Check-digit predicates as columns: string -> boolean, false for null. No UDF.

Each is one lambda in SQL, handed to the JVM as a whole: a tree of calls for the tax numbers of 28 prefixes would
take seconds to build. In the texts s is the value, b what follows a tax number's country, d its digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PAN_SHAPE, IBAN_SHAPE = r"^[A-Z]{5}[0-9]{4}[A-Z]\z", r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z"
SPACE, SPACE_OR_DASH, WHOLE = r"\s", r"[\s-]", r"^(?:{})\z"


def luhn_check(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def apply_sql(c: Column, body: str) -> Column:
    """The SQL expression body over the value s."""
    return F.element_at(F.call_function("transform", F.array(c), F.expr(f"s -> {body}")), 1)


def quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    """The ASCII digits as integers."""
    return f"transform(regexp_extract_all({x}, '[0-9]', 0), x -> cast(x as int))"


def _only_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _sum(a: str) -> str:
    return f"aggregate({a}, 0, (t, x) -> t + x)"


def _array(values: Sequence) -> str:
    return "array(" + ", ".join(_array(x) if isinstance(x, (list, tuple)) else str(x) for x in values) + ")"


def _weighted(d: str, weights: Sequence[int]) -> str:
    """Sum of weight times digit over the first digits."""
    return _sum(f"zip_with(slice({d}, 1, {len(weights)}), {_array(weights)}, (x, y) -> x * y)")


def _at(d: str, i: int) -> str:
    return f"get({d}, {i - 1})"


def _number(b: str, start: int, n: int) -> str:
    return f"cast(substring({b}, {start}, {n}) as bigint)"


def _let(value: str, name: str, body: str) -> str:
    """body, with the value under a name worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _when(shape: str, valid: str) -> str:
    """valid where the shape is right: what it reads is there then."""
    return f"coalesce(CASE WHEN {shape} THEN {valid} ELSE false END, false)"


def _verhoeff() -> tuple[list[list[int]], list[list[int]]]:
    """The product of the dihedral group of ten elements, and the powers of Verhoeff's permutation."""

    def product(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    step = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([step[x] for x in powers[-1]])
    return [[product(a, b) for b in range(10)] for a in range(10)], powers


def is_valid_aadhaar(c: Column) -> Column:
    """Twelve digits whose Verhoeff sum is 0; anything else in the text is passed over."""
    product, powers = _verhoeff()
    turned = f"transform(reverse({_digits('s')}), (x, i) -> get(get({_array(powers)}, i % 8), x))"
    return apply_sql(c, _when(f"length({_only_digits('s')}) = 12", f"aggregate({turned}, 0, (t, x) -> get(get({_array(product)}, t), x)) = 0"))


def is_valid_pan(c: Column) -> Column:
    """Five letters, four digits, and the letter that the weighted sum of the nine asks for. Upper case only."""
    values = f"transform(split(substring(s, 1, 9), ''), (x, i) -> CASE WHEN i < 9 THEN (instr('{ALNUM}', x) - 1) * (i + 1) ELSE 0 END)"
    return apply_sql(c, _when(f"s rlike {quoted(PAN_SHAPE)}", f"substring(s, 10, 1) = substring('{ALNUM}', {_sum(values)} % 36 + 1, 1)"))


def is_valid_npi(c: Column) -> Column:
    """Ten digits that pass Luhn after the prefix 80840."""
    return apply_sql(c, _let(_only_digits("s"), "n", _when("length(n) = 10", "luhn_check(concat('80840', n))")))


def is_valid_card(c: Column) -> Column:
    """12 to 19 digits that pass Luhn; spaces and dashes are passed over."""
    return apply_sql(c, _let(_only_digits("s"), "n", _when("length(n) BETWEEN 12 AND 19", "luhn_check(n)")))


def is_valid_routing_number(c: Column) -> Column:
    return apply_sql(c, _let(_digits("s"), "d", _when("size(d) = 9", f"{_weighted('d', [3, 7, 1] * 3)} % 10 = 0")))


def is_valid_cpf(c: Column) -> Column:
    check = lambda n: f"{_weighted('d', range(n + 1, 1, -1))} * 10 % 11 % 10 = {_at('d', n + 1)}"
    return apply_sql(c, _let(_digits("s"), "d", _when("size(d) = 11 AND size(array_distinct(d)) > 1", f"{check(9)} AND {check(10)}")))


def is_valid_cnpj(c: Column) -> Column:
    weights = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]

    def check(w: list[int]) -> str:
        rest = f"{_weighted('d', w)} % 11"
        return _let(rest, "r", f"CASE WHEN r < 2 THEN 0 ELSE 11 - r END = {_at('d', len(w) + 1)}")

    return apply_sql(c, _let(_digits("s"), "d", _when("size(d) = 14 AND size(array_distinct(d)) > 1", f"{check(weights)} AND {check([6, *weights])}")))


def _mod97(x: str) -> str:
    """The number that an alphanumeric string spells (A is 10), modulo 97."""
    each = f"transform(filter(split({x}, ''), y -> y <> ''), y -> instr('{ALNUM}', y) - 1)"
    return f"aggregate({each}, 0, (m, v) -> (m * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"


def is_valid_iban(c: Column) -> Column:
    """ISO 7064 mod 97 over the rotated text; spaces are taken out, the country's length isn't looked at."""
    shape = f"u rlike {quoted(IBAN_SHAPE)}"
    return apply_sql(c, _let(f"upper(regexp_replace(s, {quoted(SPACE)}, ''))", "u", _when(shape, f"{_mod97('concat(substring(u, 5, 40), substring(u, 1, 4))')} = 1")))


def _iso7064_11_10(n: int) -> str:
    step = "CASE WHEN (t + x) % 10 = 0 THEN 10 ELSE (t + x) % 10 END * 2 % 11"
    return f"(aggregate(slice(d, 1, {n - 1}), 10, (t, x) -> {step}) + {_at('d', n)}) % 10 = 1"


def _doubled(odd: int) -> str:
    """Sum of the first seven digits, those at places of this parity doubled, their two digits added."""
    return _sum(f"transform(slice(d, 1, 7), (x, i) -> CASE WHEN i % 2 <> {odd} THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)")


def _two_rounds(n: int, first: Sequence[int], second: Sequence[int]) -> str:
    """A sum modulo 11; where that is 10, a second one, of which 10 counts as 0."""
    return _let(f"{_weighted('d', first)} % 11", "r", f"CASE WHEN r = 10 THEN {_weighted('d', second)} % 11 % 10 ELSE r END = {_at('d', n)}")


def _sum_is(weights: Sequence[int], rest: str) -> str:
    return f"{_weighted('d', weights)} {rest}"


#: A company: letter, seven digits, and a digit or the letter that stands for it.
_ES_COMPANY = _let(f"pmod(-{_doubled(0)}, 10)", "r", "substring(b, 9, 1) = cast(r as string) OR substring(b, 9, 1) = substring('JABCDEFGHI', r + 1, 1)")
#: Digits, or X, Y, Z for a leading 0, 1, 2, and a letter of the number modulo 23.
_ES_PERSON = _let("translate(substring(b, 1, 8), 'XYZ', '012')", "n", "substring('TRWAGMYFPDXBNJZSQVHLCKE', CASE WHEN n rlike '^[0-9]{8}$' THEN cast(n as int) END % 23 + 1, 1) = substring(b, 9, 1)")
_CY = _sum("transform(slice(d, 1, 8), (x, i) -> CASE WHEN i % 2 = 0 THEN get(array(1, 0, 5, 7, 9, 13, 15, 17, 19, 21), x) ELSE x END)")
_IE = f"{_weighted('d', range(8, 1, -1))} + 9 * CASE WHEN length(b) = 9 THEN instr('ABCDEFGHI', substring(b, 9, 1)) ELSE 0 END"

NL = "concat('NL', b)"

#: country prefix -> (shape of the rest, SQL of its check)
VAT_RULES = {
    "AT": (r"U[0-9]{8}", f"pmod(6 - {_doubled(1)}, 10) = {_at('d', 8)}"),
    "BE": (r"[0-9]{9,10}", _let("lpad(b, 10, '0')", "n", f"({_number('n', 1, 8)} + {_number('n', 9, 2)}) % 97 = 0")),
    "BG": (r"[0-9]{9}", _two_rounds(9, range(1, 9), range(3, 11))),
    "CY": (r"[0-9]{8}[A-Z]", f"substring('{ALNUM}', {_CY} % 26 + 11, 1) = substring(b, 9, 1)"),
    "CZ": (r"[0-9]{8,10}", "true"),
    "SK": (r"[0-9]{10}", "true"),
    "DE": (r"[0-9]{9}", _iso7064_11_10(9)),
    "HR": (r"[0-9]{11}", _iso7064_11_10(11)),
    "DK": (r"[0-9]{8}", _sum_is([2, 7, 6, 5, 4, 3, 2, 1], "% 11 = 0")),
    "EE": (r"[0-9]{9}", _sum_is([3, 7, 1] * 3, "% 10 = 0")),
    "EL": (r"[0-9]{9}", f"aggregate(slice(d, 1, 8), 0, (t, x) -> 2 * t + x) * 2 % 11 % 10 = {_at('d', 9)}"),
    "ES": (r"[A-Z0-9][0-9]{7}[A-Z0-9]", f"CASE WHEN b rlike '^[A-HJ-NP-SUVW]' THEN {_ES_COMPANY} ELSE {_ES_PERSON} END"),
    "FI": (r"[0-9]{8}", _sum_is([7, 9, 10, 5, 8, 4, 2, 1], "% 11 = 0")),
    "FR": (r"[0-9]{11}", f"luhn_check(substring(b, 3, 9)) AND ({_number('b', 3, 9)} * 100 + 12) % 97 = {_number('b', 1, 2)}"),
    "HU": (r"[0-9]{8}", _sum_is([9, 7, 3, 1, 9, 7, 3, 1], "% 10 = 0")),
    "IE": (r"[0-9]{7}[A-W][A-I]?", f"substring('WABCDEFGHIJKLMNOPQRSTUV', ({_IE}) % 23 + 1, 1) = substring(b, 8, 1)"),
    "IT": (r"[0-9]{11}", "luhn_check(b)"),
    "LT": (r"[0-9]{9}|[0-9]{12}", f"CASE WHEN length(b) = 9 THEN {_two_rounds(9, range(1, 9), [3, 4, 5, 6, 7, 8, 9, 1])} ELSE {_two_rounds(12, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4])} END"),
    "LU": (r"[0-9]{8}", f"{_number('b', 1, 6)} % 89 = {_number('b', 7, 2)}"),
    "LV": (r"[0-9]{11}", _sum_is([9, 1, 4, 8, 3, 10, 2, 5, 7, 6, 1], "% 11 = 3")),
    "MT": (r"[0-9]{8}", _sum_is([3, 4, 6, 7, 8, 9, 10, 1], "% 37 = 0")),
    # the older numbers by weights, the newer by mod 97 over the whole
    "NL": (r"[0-9]{9}B[0-9]{2}", _sum_is([*range(9, 1, -1), -1], f"% 11 = 0 OR {_mod97(NL)} = 1")),
    "PL": (r"[0-9]{10}", _sum_is([6, 5, 7, 2, 3, 4, 5, 6, 7, -1], "% 11 = 0")),
    "PT": (r"[0-9]{9}", f"pmod(11 - {_weighted('d', range(9, 1, -1))} % 11, 11) % 10 = {_at('d', 9)}"),
    "RO": (r"[0-9]{2,10}", _let(_digits("lpad(b, 10, '0')"), "e", f"{_weighted('e', [7, 5, 3, 2, 1, 7, 5, 3, 2])} * 10 % 11 % 10 = {_at('e', 10)}")),
    "SE": (r"[0-9]{10}01", "luhn_check(substring(b, 1, 10))"),
    "SI": (r"[0-9]{8}", _let(f"{_weighted('d', range(8, 1, -1))} % 11", "r", f"r <> 0 AND (11 - r) % 10 = {_at('d', 8)}")),
    "GB": (r"[0-9]{9}", _sum_is([8, 7, 6, 5, 4, 3, 2, 10, 1], "% 97 IN (0, 42)")),
}


def _vat(x: str) -> str:
    cases = " ".join(f"WHEN {quoted(code)} THEN b rlike {quoted(WHOLE.format(shape))} AND ({valid})" for code, (shape, valid) in VAT_RULES.items())
    check = f"coalesce(CASE substring(u, 1, 2) {cases} ELSE false END, false)"
    value = f"upper(regexp_replace({x}, {quoted(SPACE_OR_DASH)}, ''))"
    return _let(value, "u", _let("substring(u, 3, 40)", "b", _let(_digits("b"), "d", check)))


def is_valid_vat(c: Column) -> Column:
    """The check of the country that the first two letters name, spaces and dashes out, in upper case. CZ and SK: shape only."""
    return apply_sql(c, f"coalesce({_vat('s')}, false)")


def vat_prefix_end(value: Column) -> Column:
    """How much of a match is a valid number: all of it, else the longest part that ends at a space or dash, else all but the
    upper-case letters at the end, four at most; 0 for none."""
    cuts = "filter(sequence(1, greatest(length(s) - 1, 1)), i -> substring(s, i + 1, 1) IN (' ', '-') AND substring(s, i, 1) NOT IN (' ', '-'))"
    tail = "length(regexp_extract(s, '([A-Z]*)$', 1))"
    trims = f"CASE WHEN {tail} BETWEEN 1 AND 4 THEN array(length(s) - {tail}) ELSE cast(array() as array<int>) END"
    candidates = f"concat(array(length(s)), reverse({cuts}), {trims})"
    return apply_sql(value, f"coalesce(get(filter({candidates}, c -> c > 0 AND {_vat('substring(s, 1, c)')}), 0), 0)")


VALIDATORS = {
    "aadhaar": is_valid_aadhaar,
    "pan": is_valid_pan,
    "npi": is_valid_npi,
    "routing": is_valid_routing_number,
    "cpf": is_valid_cpf,
    "cnpj": is_valid_cnpj,
    "iban": is_valid_iban,
    "vat": is_valid_vat,
    "card": is_valid_card,
}
