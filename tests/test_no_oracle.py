"""The base-58 address rule held against exact decoding (its queries have oracles, which state the same rule)."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallyframe.functions.base58 import base58_encode
from tallyframe.functions.expr import BASE58_ALPHABET, base58_number, is_valid_address

from .conftest import SF_SMALL


def b58encode(raw):
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + base58_number(int.from_bytes(raw, "big"))


def _decoded_length(s):
    n = 0
    for ch in s:
        if ch not in BASE58_ALPHABET:
            return None
        n = n * 58 + BASE58_ALPHABET.index(ch)
    return len(s) - len(s.lstrip("1")) + (n.bit_length() + 7) // 8


def _valid(a):
    return 32 <= len(a) <= 44 and _decoded_length(a) == 32


def _candidates():
    hexed = str.maketrans("0123456789abcdef", "123456789ABCDEFG")
    rows = duckdb.sql(f"SELECT c_custkey, c_mktsegment FROM '{SF_SMALL}/customer.parquet'").fetchall()
    for k, segment in rows:
        a = f"acct{k:08d}"
        yield k, hashlib.sha256(a.encode()).hexdigest()[:44].translate(hexed) if segment == "HOUSEHOLD" else a


def test_address_rule_equals_exact_decoding(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BASE58_ALPHABET) for _ in range(rng.randint(30, 46))) for _ in range(2000)]
    texts += ["1" * k + "".join(rng.choice(BASE58_ALPHABET) for _ in range(rng.randint(0, 44 - k))) for k in range(45) for _ in range(20)]
    texts += [b58encode(bytes(k) + rng.randbytes(32 - k)) for k in range(33)] + [b58encode(b"\x01" * 31), b58encode(b"\xff" * 32), b58encode(b"\xff" * 33), "", "O" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "a string").select("a", is_valid_address("a").alias("ok")).collect()
    assert {r.a: r.ok for r in got} == {t: _valid(t) for t in texts}
    assert spark.range(1).select(is_valid_address(F.lit(None).cast("string")).alias("ok")).first().ok is False


def test_valid_addresses_bruteforce(spark):
    got = {r.id: (r.address, r.valid) for r in queries()["valid_addresses"](spark, SF_SMALL).collect()}
    want = {k: (a, _valid(a)) for k, a in _candidates()}
    assert got == want
    assert any(v for _, v in want.values()) and not all(v for _, v in want.values())


def test_registry_add_bruteforce(spark):
    got = sorted((r.id, r.address) for r in queries()["registry_add"](spark, SF_SMALL).collect())
    new = [(k + 9000000, a) for k, a in _candidates() if _valid(a)]
    assert got == sorted([(k, f"acct{k:08d}") for k, _ in _candidates()] + new)


def test_base58_text_equals_long_division(spark):
    rng = random.Random(1)
    values = [None, b"", b"\0", b"\0\0\x01", b"hello", b"\xff" * 64, b"\0" * 64, b"\0" * 63 + b"\x01", b"\xff" * 32]
    values += [bytes(rng.choice([0, 0, 1, 5])) + rng.randbytes(rng.randint(0, 59)) for _ in range(1000)] + [rng.randbytes(64) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "raw binary")
    assert [r.a for r in df.select(base58_encode("raw").alias("a")).collect()] == [None if v is None else b58encode(v) for v in values]
    short = [v for v in values if v is None or len(v) <= 32]
    df = spark.createDataFrame([(v,) for v in short], "raw binary")
    assert [r.a for r in df.select(base58_encode("raw", 32).alias("a")).collect()] == [None if v is None else b58encode(v) for v in short]


def test_base58_refuses_longer_values(spark):
    df = spark.createDataFrame([(b"\x01" * 33,)], "raw binary")
    with pytest.raises(Exception, match="more than 32 bytes"):
        df.select(base58_encode("raw", 32)).collect()
    with pytest.raises(ValueError):
        base58_encode("raw", 65)


def test_signatures_are_encoded_without_python(spark):
    df = queries()["ingest_transactions"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "Python" not in plan and "Exchange" not in plan
    rows = {r.signature for r in df.collect()}
    slots = duckdb.sql(f"SELECT event_id FROM '{SF_SMALL}/events.parquet'").fetchall()
    want = set()
    for (k,) in slots:
        name = f"sig{k:010d}"
        raw = hashlib.sha256(name.encode()).digest() + hashlib.sha256(name[::-1].encode()).digest()
        want.add(b58encode(bytes(3) + raw[3:] if k // 10 % 13 == 0 else raw))
    assert rows == want
