import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import checksums as C

CASES = {
    "npi": {"1234567893": True, "1234567892": False, "1234567890": False, None: False, "": False},
    "routing": {"021000021": True, "021000022": False, "0210000": False, "000000000": True, None: False},
    "cpf": {"529.982.247-25": True, "52998224726": False, "11111111111": False, "529": False, None: False},
    "cnpj": {"11.222.333/0001-81": True, "11222333000182": False, "11111111111111": False, None: False},
    "iban": {"GB29NWBK60161331926819": True, "GB29 NWBK 6016 1331 9268 19": True, "GB29NWBK60161331926818": False, "DE89370400440532013000": True, "x": False, None: False},
    "pan": {"ABCDE1234I": True, "ABCDE1234J": False, "abcde1234i": False, "ABCDE1234": False, None: False},
    "aadhaar": {"2345 6789 0124": True, "2345 6789 0123": False, "1234 5678 9012": False, "234567890": False, None: False},
    "card": {"4111 1111 1111 1111": True, "4111-1111-1111-1112": False, "79927398713": False, None: False},
}
VAT_VALID = (
    "ATU57194903 BE428759497 BG175074752 CY10259033P DE136695976 DK30792440 EE841485253 EL094259216 ESS92174218 FI52320444 "
    "FR61954506077 HR54176240103 HU43313604 IE6433435F IT74381650253 LT397419217 LU24181401 LV84142429166 MT11679112 "
    "NL888498780B84 PL1734521186 PT188358889 RO1319148890 SE123456789701 SI81458991 GB980780684 CZ12345678 SK1234567890"
).split()
VAT_INVALID = ["ATU57194904", "DE136695977", "PL1734521187", "CZ123", "SK12345678901", "beautiful", "detail", "Aadhaar", "routing", "IBAN", "CNPJ", "partner", "DE2024", "BE12", "", None]


@pytest.mark.parametrize("kind", sorted(CASES))
def test_vectors(spark, kind):
    df = spark.createDataFrame(list(CASES[kind].items()), "v string, want boolean")
    bad = df.withColumn("got", C.VALIDATORS[kind](F.col("v"))).filter("got is null or got <> want").collect()
    assert not bad


def test_vat(spark):
    rows = [(v, True) for v in [*VAT_VALID, "AT U 57194903", "DE 136 695 976", "FR-61954506077"]] + [(v, False) for v in VAT_INVALID]
    df = spark.createDataFrame(rows, "v string, want boolean").withColumn("got", C.is_valid_vat(F.col("v")))
    assert not df.filter("got is null or got <> want").collect()


def test_vat_prefix(spark):
    rows = [("DE 136 695 976 S", 14), ("ATU57194903X", 11), ("DE136695976 on the", 11), ("DE 136 695 976 on the", 14), ("detail", 0), ("DE136695976ABCDE", 0), ("ATU57194903", 11)]
    df = spark.createDataFrame(rows, "v string, want int").withColumn("got", C.vat_prefix_end(F.col("v")))
    assert not df.filter("got <> want").collect()


def verhoeff_ok(s):
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]

    def times(a, b):
        if a < 5:
            return (a + b) % 5 if b < 5 else (a + b) % 5 + 5
        return (a - b) % 5 + 5 if b < 5 else (a - b) % 5

    c = 0
    for i, ch in enumerate(reversed(s)):
        x = int(ch)
        for _ in range(i % 8):
            x = step[x]
        c = times(c, x)
    return c == 0


def test_random_numbers_against_loops(spark):
    rng = random.Random(42)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("0123456789") for _ in range(12))
        r = "".join(rng.choice("0123456789") for _ in range(9))
        rows.append((a, verhoeff_ok(a), r, sum(w * int(d) for w, d in zip([3, 7, 1] * 3, r)) % 10 == 0))
    df = spark.createDataFrame(rows, "a string, va boolean, r string, vr boolean")
    assert df.filter((C.is_valid_aadhaar(F.col("a")) != F.col("va")) | (C.is_valid_routing_number(F.col("r")) != F.col("vr"))).count() == 0
    # any one digit changed is noticed
    good = next(f"{n:012d}" for n in range(234567890120, 234567890140) if verhoeff_ok(f"{n:012d}"))
    changed = [good[:i] + str((int(good[i]) + 1) % 10) + good[i + 1 :] for i in range(12)]
    assert spark.createDataFrame([(x,) for x in changed], "v string").filter(C.is_valid_aadhaar(F.col("v"))).count() == 0
