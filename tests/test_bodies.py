"""Bodies of requests and replies, prompts as lists, and the report, against plain Python."""

import json

from pyspark.sql import functions as F

from routelake.functions import bodies, text
from routelake.operators import reports


def column(spark, rows, schema, expression):
    """The expression's value for each row, in the rows' order."""
    own = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in own.select("i", expression.alias("v")).orderBy("i").collect()]


def test_bodies_that_are_no_json(spark):
    raws = ["", None, '{"a":1}', "{", "plain", "[1]", "null", "7"]
    request = F.to_json(bodies.request_body(F.col("raw")))
    assert column(spark, [(r,) for r in raws], "raw string", request) == ["{}", "{}", '{"a":1}', None, None, "[1]", "null", "7"]
    reply = F.to_json(bodies.reply_body(F.col("raw")))
    found = column(spark, [(r,) for r in raws], "raw string", reply)
    assert [json.loads(found[i]) for i in (0, 3, 4)] == [{}, {"error": {"message": "{"}}, {"error": {"message": "plain"}}]


def test_messages_of_a_request(spark):
    long = [{"role": "assistant" if i % 3 == 0 else "system", "content": f"  {i}\n"} for i in range(45)]
    odd = [None, 7, "x", {"role": "user"}, {"content": None}, {"content": 5}, {"content": " \t "}, {"content": "a b "}, {"role": None, "content": "﻿c"}, {"role": 5, "content": "d"}]
    rows = [json.dumps({"messages": long}), json.dumps({"messages": odd}), '{"messages":[]}', '{"messages":{}}', "{}", "[]", "no"]
    found = column(spark, [(r,) for r in rows], "raw string", bodies.request_messages(bodies.request_body(F.col("raw"))))
    assert [tuple(m) for m in found[0]] == [("assistant" if i % 3 == 0 else "user", str(i)) for i in range(25, 45)]
    assert [tuple(m) for m in found[1]] == [("user", "a b"), ("user", "c"), ("user", "d")]
    assert found[2] == [] and found[3:] == [None] * 4


def test_requests_of_providers(spark):
    own = F.array(F.struct(F.lit("assistant").alias("role"), F.lit('a"').alias("content")), F.struct(F.lit("user").alias("role"), F.lit("b").alias("content")))
    made = bodies.provider_request(F.col("p"), F.lit("m"), F.when(F.col("p") != "none", own))
    groq, google, other, none = column(spark, [("groq",), ("google",), ("else",), ("none",)], "p string", made)
    assert json.loads(groq) == {"model": "m", "messages": [{"role": "assistant", "content": 'a"'}, {"role": "user", "content": "b"}], "temperature": 0.7}
    assert json.loads(google) == {"contents": [{"role": "model", "parts": [{"text": 'a"'}]}, {"role": "user", "parts": [{"text": "b"}]}], "generationConfig": {"temperature": 0.7}}
    assert other is None and none is None


def test_errors_of_replies(spark):
    cases = {
        '{"error":{"message":"m"}}': "m",
        '{"error":{"message":"","code":1}}': '{"code":1,"message":""}',
        '{"error":{"message":0}}': '{"message":0}',
        '{"error":{"message":[1]}}': "[1]",
        '{"error":{"message":false}}': '{"message":false}',
        '{"error":"e"}': "e",
        '{"error":""}': "",
        '{"error":0}': "fallback",
        '{"error":0.0}': "fallback",
        '{"error":false}': "fallback",
        '{"error":true}': "true",
        '{"error":12}': "12",
        '{"error":[]}': "[]",
        '{"error":null}': "fallback",
        "{}": "fallback",
        "null": "fallback",
        "[]": "fallback",
        "gone": "gone",
    }
    found = column(spark, [(raw,) for raw in cases], "raw string", bodies.reply_error(bodies.reply_body(F.col("raw")), F.lit("fallback")))
    assert dict(zip(cases, found, strict=True)) == cases


def test_replies(spark):
    rows = [
        ("groq", 200, '{"choices":[{"message":{"content":" a "}},{"message":{"content":"b"}}],"usage":{"prompt_tokens":3,"total_tokens":9}}'),
        ("google", 299, '{"candidates":[{"content":{"parts":[{"text":" x"},{},{"text":null},{"text":"y "}]}}],"usageMetadata":{"candidatesTokenCount":4,"thoughtsTokenCount":5}}'),
        ("groq", 200, "plain"),
        ("groq", 200, None),
        ("google", 200, '{"candidates":{}}'),
        ("google", 500, None),
        ("other", 404, "[]"),
        ("groq", None, '{"choices":[{"message":{"content":"a"}}]}'),
        ("groq", 300, '{"error":{"message":"moved"}}'),
    ]
    found = column(spark, rows, "p string, status int, raw string", bodies.reply(F.col("p"), F.col("status"), F.col("raw")))
    nothing = (None, None, None)
    assert [tuple(r) for r in found] == [
        (" a ", None, 3, 0, 9),
        ("x" + "y", None, 0, 9, 0),
        (None, "Groq returned an empty response.", *nothing),
        (None, "Groq returned an empty response.", *nothing),
        (None, "Google AI Studio returned an empty response.", *nothing),
        (None, "Google AI Studio request failed.", *nothing),
        (None, "other request failed.", *nothing),
        (None, "Groq request failed.", *nothing),
        (None, "moved", *nothing),
    ]


def test_prompts_as_lists(spark):
    cases = [
        ('"  a\\n b "', "a b"),
        ('["a",{"role":"assistant","content":"no"},{"role":"USER","content":["b",{"text":"c"},4]},{"from":"human","value":"d"},{"role":"","from":"gpt","text":"no"},{"text":"e"},null,7,[],["x"]]', "a\n\nb c\n\nd\n\ne"),
        ('["  ",{"role":"user","content":""}]', ""),
        ("[]", ""),
        ('{"content":"a"}', ""),
        ("null", ""),
        (None, ""),
    ]
    found = column(spark, [(raw,) for raw, _ in cases], "raw string", text.listed_user_turns(F.parse_json("raw")))
    assert found == [prompt for _, prompt in cases]


def test_report_lines(spark, tmp_path):
    arena = spark.createDataFrame([(True,)] * 1200 + [(False,)] * 1300, "strong_wins boolean")
    labels = [("coding", "easy", "low")] * 70 + [("math", "hard", "high")] * 5
    final = spark.createDataFrame(labels, "task_type string, difficulty string, privacy string")
    funnel = spark.createDataFrame([("b_rows", 12345), ("a_rows", 1)], "counter string, rows long")
    told = reports.summary("2026-01-01", arena, final, {"Arena funnel": funnel, "Other funnel": funnel.limit(0)}, floor=6)
    head = ["# Phase 2 Dataset Summary", "", "Generated: 2026-01-01", "", "## Totals", "", "- Arena preference records: 2,500", "- LMSYS labeled records: 75", "- Combined records: 2,575"]
    funnels = ["", "## Arena funnel", "", "- a_rows: 1", "- b_rows: 12,345", "", "Strong-model win rate: 48.00%", "", "## Other funnel", ""]
    spreads = ["", "## Task type distribution", "", "- coding: 70 (93.33%)", "- math: 5 (6.67%)", "", "## Difficulty distribution", "", "- easy: 70 (93.33%)", "- hard: 5 (6.67%)"]
    privacy = ["", "## Privacy distribution", "", "- high: 5 (6.67%)", "- low: 70 (93.33%)", "", "**FLAG:** High-privacy coverage is 6.67%, below 8%."]
    lines = told.split("\n")
    assert lines[: len(head + funnels + spreads + privacy)] == head + funnels + spreads + privacy
    gaps = lines[len(head + funnels + spreads + privacy) :]
    assert gaps[:3] == ["", "## Coverage gaps", ""] and "- math: 5 records" in gaps and not any("coding" in g for g in gaps) and gaps[-1] == ""
    path = f"file://{tmp_path}/report"
    reports.write_summary(reports.summary_lines("2026-01-01", arena, final, {"Arena funnel": funnel, "Other funnel": funnel.limit(0)}, floor=6), path)
    assert spark.read.text(path, wholetext=True).first()["value"] == told


def test_report_of_empty_tables(spark):
    arena = spark.createDataFrame([], "strong_wins boolean")
    final = spark.createDataFrame([], "task_type string, difficulty string, privacy string")
    told = reports.summary("2026-01-01", arena, final, {}, floor=0)
    assert "- Combined records: 0" in told and "No task type has fewer than 0 records.\n" in told and "coverage is 0.00%" in told
