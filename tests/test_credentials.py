"""Credential names against a plain recursive walk over the parsed JSON."""

import json
import random

from pyspark.sql import functions as F

from tarnbeck.operators.credentials import NAMES, credential_names


def walk(value):
    if isinstance(value, dict):
        for k, v in value.items():
            if k.lower() in NAMES:
                yield k
            yield from walk(v)
    elif isinstance(value, list):
        if len(value) == 2 and isinstance(value[0], str) and value[0].lower() in NAMES:
            yield value[0]
        for v in value:
            yield from walk(v)


def nested(rnd, depth=0):
    text = lambda: rnd.choice(["token", "Token", "API_KEY", "apikey", "page", 'a"b', "token: 1", '["token", 1]', "back\\slash", "", "é"])
    kind = rnd.random()
    if depth > 4 or kind < 0.3:
        return rnd.choice([text(), 1, -2.5e3, True, None])
    if kind < 0.65:
        return {text() + rnd.choice(["", "", str(i)]): nested(rnd, depth + 1) for i in range(rnd.randint(0, 3))}
    return [nested(rnd, depth + 1) for _ in range(rnd.choice((0, 1, 2, 2, 2, 3)))]


def names(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, request string")
    return [r.names for r in sorted(df.select("id", credential_names(F.col("request")).alias("names")).collect(), key=lambda r: r.id)]


def test_equals_a_recursive_walk(spark):
    rnd = random.Random(1)
    cases = [["token", 'a"b'], [["page", 1], ["token", {"a": 1}]], ["token", ["token", ["token", 1]]], ["token", 1, 2], ["token"], [1, "token"], {"x": "token"}, {"a": {"b": [{"access_token": ""}]}}, ["token", [1, 2, 3]], {"token": {"token": ["Token", {}]}}]
    cases += [nested(rnd) for _ in range(400)]
    texts = [json.dumps(c, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice((None, 2))) for c in cases]
    got = names(spark, texts)
    for c, g in zip(cases, got):
        assert g == sorted(walk(c)), c
    assert sum(map(len, got)) > 200


def test_escaped_names_malformed_and_missing_requests(spark):
    assert names(spark, [r'{"token": 1}', '{"token": ', "", None, "token", '"token"']) == [["token"], [], [], [], [], []]
    deep = '{"a":' * 200 + '{"token": 1}' + "}" * 200
    assert names(spark, [deep]) == [["token"]]
