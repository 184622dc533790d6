import math

import pytest
from pyspark.sql import functions as F

from memograph.functions import entries as E
from memograph.functions import facts, parsing, scoring
from memograph.functions import identity as I
from memograph.functions import text as T


def one(spark, column, value=None):
    row = spark.createDataFrame([(value,)], "v STRING").select(column.alias("out")).first()
    return row["out"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("high", 0.9), ("medium", 0.6), ("low", 0.3), ("0.42", 0.42), ("75", 0.75), ("92%", 0.92), ("not-a-number", 0.7),
        ("1.5", 0.015), ("150", 1.0), ("-5", 0.0), ("NaN", 1.0), ("unknown", 0.7), (" Very High ", 0.95), (None, 0.7),
    ],
)
def test_confidence(spark, given, expected):
    assert math.isclose(one(spark, E.coerce_confidence(F.col("v"), 0.7), given), expected)


def test_blanks_follow_unicode_and_separators(spark):
    text = " a b\x1cc　 "
    assert one(spark, T.normalize_text("v"), text) == "a b c"
    assert one(spark, T.words("v"), text) == ["a", "b", "c"]
    assert one(spark, T.strip("v"), text) == "a b\x1cc"


def test_task_signature_is_the_canonical_hash(spark):
    import hashlib
    import json

    payload = {"prompt": "find é", "task_type": "t", "output_contract": "c", "constraints": {"a": 1}}
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    expected = hashlib.sha256(text.encode()).hexdigest()[:16]
    made = I.task_signature(F.lit(" Find  É"), F.lit("T"), F.lit("c"), F.lit('{"a":1}'))
    assert one(spark, made) == expected


def test_ascii_json_escapes_like_python(spark):
    import json

    for text in ("plain", "é \"q\" \n", "\U0001F600x"):
        assert one(spark, I.ascii_json_string(F.col("v")), text) == json.dumps(text)


def test_word_and_sentence_chunks(spark):
    assert one(spark, T.word_chunks("v", 2), "a b  c") == ["a b", "c"]
    assert one(spark, T.word_chunks("v", 2), "  ") == ["  "]
    assert one(spark, T.sentence_chunks("v", 2), "One. Two! Three? four") == ["One. Two!", "Three? four"]


def test_clean_generation(spark):
    assert one(spark, T.clean_generation("v"), "<think>a\nb</think> x <think> y") == "x"


def test_grounding_and_consensus(spark):
    g = one(spark, facts.grounding(F.col("v"), F.lit("$12.4M and 4.2%")), "Up 4.2% to $12.4M, not 9%")
    assert (g["grounding"], g["verified"], g["unverified"]) == ("PARTIAL", ["$12.4M", "4.2%", "12.4M"], ["9%"])
    assert one(spark, facts.grounding(F.col("v"), F.lit("")), "no figures")["grounding"] == "GROUNDED"
    assert one(spark, facts.consensus(F.col("v"), F.lit("48.7M")), "2,847 and 48.7M")["divergent"] == ["2,847"]


def test_planner_response_recovers_cut_json(spark):
    text = '{"answer": "the \\"key\\" is 5", "used_entry_ids": ["0123456789abcdef01234567", "'
    p = one(spark, parsing.planner_response(F.col("v"), F.array(F.lit("f"))), text)
    assert p["answer"] == 'the "key" is 5' and p["used_entry_ids"] == ["0123456789abcdef01234567"]
    assert p["confidence"] == 0.6 and p["action"] == "answer"


def test_json_object_rejects_two_objects(spark):
    assert one(spark, parsing.json_object_text(F.col("v")), 'x {"a": 1} and {"b": 2}') == "{}"
    assert one(spark, parsing.json_object_text(F.col("v")), 'x {"a": 1}, {"b": 2}') == "{}"
    assert one(spark, parsing.json_object_text(F.col("v")), 'x {"a": {"b": 2}} y') == '{"a": {"b": 2}}'


def test_split_prompt(spark):
    p = one(spark, parsing.split_prompt(F.col("v")), "a\nText: b\nText: c")
    assert (p["context"], p["question"]) == ("a\nText: b", "Text: c")
    p = one(spark, parsing.split_prompt(F.col("v")), "facts\n\nwhat is it")
    assert (p["context"], p["question"]) == ("facts", "what is it")
    p = one(spark, parsing.split_prompt(F.col("v")), "only context")
    assert p["question"] == parsing.FALLBACK_QUESTION


def test_lengths_depths_templates_segments(spark):
    assert one(spark, parsing.parse_lengths(F.col("v")), "8k, 16000,,8K,0") == [8000, 16000]
    assert one(spark, parsing.depth_values(F.lit(4))) == [0.0, 33.333333, 66.666667, 100.0]
    assert one(spark, parsing.depth_values(F.lit(1))) == [0.0]
    assert one(spark, parsing.fill_template(F.col("v"), F.array(F.lit("x"), F.lit("y"))), " {1}-{2}-{1} ") == "x-y-x"
    assert one(spark, parsing.safe_segment(F.col("v")), "--é/?") == "default"
    assert one(spark, parsing.length_from_path(F.col("v")), "/a/set_4096/task/f.jsonl") == "4096"


def test_scores(spark):
    gold = F.array(F.lit("Lisbon"), F.lit("Porto"))
    assert one(spark, scoring.exact_match(F.col("v"), gold), "Porto") == 1.0
    assert one(spark, scoring.contains_any(F.col("v"), gold), "in lisbon") == 0.0
    assert one(spark, scoring.mentions_any(F.col("v"), gold), "in lisbon") is True
    assert one(spark, scoring.mentions_all(F.col("v"), gold), "lisbon") is False
    assert one(spark, scoring.last_line_match(F.col("v"), gold), "x\n Lisbon \n") == 1.0
    assert one(spark, scoring.contains_any(F.col("v"), F.array().cast("array<string>")), "x") == 0.0
