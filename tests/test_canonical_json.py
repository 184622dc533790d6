"""Canonical JSON against the standard library."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from memograph.functions import identity as I


def plain(text):
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def made(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r["c"] for r in df.select("i", I.canonical_json(F.col("t")).alias("c")).orderBy("i").collect()]


def test_any_value(spark):
    texts = [
        '{"b":1,"a":{"z":[3,{"y":1,"x":2}],"k":null}}', '{"a":1,"a":{"b":1,"b":{"c":2,"c":3}}}', "[ 1, 2 ,3\n]", '"x"', "true", "null", " 7 ", "{}", "[]",
        '{"\\u00e9":"\\u00fc\\u00e9 \\" \\\\ / \\n \\t \\u0001 \\u2028 \U0001f600", "ab":"1.50 and 2e3", "a-b":-1, "":"-3.0"}',
        '{"a":1.0,"b":1.50,"c":1e2,"f":-0.0,"g":0.1,"h":1e-7,"i":123456789.123,"j":1E400,"k":-2.5e-10,"l":0.00001,"m":0.0001,"n":1e15,"o":1e16,"p":3.0e0,"q":-1e22}',
        '{"whole":12345678901234567890123456789012345678901234567890,"small":-17,"zero":0}', '{"x":{"y":{"z":{"b":[[],[{}]],"a":{"d":1,"c":2}}}}}',
    ]
    assert made(spark, texts) == [plain(t) for t in texts]
    assert made(spark, [None]) == [None]


def test_random_values(spark):
    draw = random.Random(3)

    def value(depth):
        kind = draw.randint(0, 7 if depth else 5)
        if kind < 2:
            return draw.choice([draw.randint(-(10**6), 10**6), draw.randint(-5, 5) / 4, draw.randint(1, 9) * 10.0 ** draw.randint(-9, 20)])
        if kind < 4:
            return "".join(draw.choices('ab"\\/ \nü漢{}[]:,1.5e3-', k=draw.randint(0, 9)))
        if kind < 6:
            return draw.choice([True, False, None])
        many = [value(depth - 1) for _ in range(draw.randint(0, 4))]
        return many if kind == 6 else {value(0).__repr__() if draw.random() < 0.3 else draw.choice("zyxéab"): v for v in many}

    texts = [json.dumps(value(4), ensure_ascii=bool(i % 2), indent=i % 3 or None) for i in range(200)]
    assert made(spark, texts) == [plain(t) for t in texts]


def test_no_json_is_an_error(spark):
    for text in ('{"a":', "{'a':1}", "nope"):
        with pytest.raises(Exception, match="MALFORMED|parse|JSON"):
            made(spark, [text])


def test_signature_of_raw_constraints(spark):
    raw = '{ "limit": 3, "filter": {"to": 2, "from": 1.0} }'
    task = {"constraints": json.loads(raw), "output_contract": "short", "prompt": "find it", "task_type": "qa"}
    expected = hashlib.sha256(json.dumps(task, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    row = spark.range(1).select(I.task_signature(F.lit(" Find  it"), F.lit("QA"), F.lit("short"), F.lit(raw), raw=True).alias("s")).first()
    assert row["s"] == expected
