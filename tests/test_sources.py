import json
import os

import pytest

from leafmill.functions import noise as N
from leafmill.sources import readers, sinks


def test_pages_and_questions(spark, tmp_path):
    pages = tmp_path / "pages.jsonl"
    pages.write_text('{"page": 1, "text": "é"}\n\n{"page": "2"}\n')
    assert sorted(tuple(r) for r in readers.pages_jsonl(spark, str(pages)).collect()) == [("document", 1, "é"), ("document", 2, "")]
    questions = tmp_path / "q.jsonl"
    questions.write_text('{"id": 7, "question": "a", "expected_pages": [1]}\n{"id": "b", "question": "c"}\n')
    assert sorted(tuple(r) for r in readers.questions_jsonl(spark, str(questions)).collect()) == [("7", "a", [1]), ("b", "c", [])]
    bad = tmp_path / "bad.jsonl"
    bad.write_text("{nope\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.pages_jsonl(spark, str(bad)).collect()


def test_tolerant(spark, tmp_path):
    at = tmp_path / "x.jsonl"
    at.write_text('{"id": "a"}\n\n{bad\n{"id": "b"}\n')
    rows, errors = readers.jsonl_tolerant(spark, str(at), "id string")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a"), (4, "b")]
    assert [tuple(r) for r in errors.collect()] == [(3, "{bad")]


def test_gold_and_prompts(spark):
    rows = spark.createDataFrame([(1, "﻿ P1 ", True), (2, "p1", False), (3, " ", True)], "line int, id string, expect_json boolean")
    assert [tuple(r) for r in readers.gold_index(rows).collect()] == [("p1", False)]
    prompts = spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "line int, id string")
    assert [r.id for r in readers.with_prompt_ids(prompts).orderBy("line").collect()] == ["x", "P2", "P3"]


def test_html(spark):
    html = "<html><head><title>T</title><style>x{}</style></head><body><p>A &amp; B</p><script>no()</script><!-- no --><div>c<br>d</div></body></html>"
    row = spark.createDataFrame([(html,)], "h string").select(readers.html_text(__import__("pyspark").sql.functions.col("h")))
    assert row.first()[0] == "T\nA & B\nc\nd"


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    assert sorted((r.page, r.text) for r in readers.documents(spark, str(tmp_path)).collect()) == [(1, "one"), (2, "two")]
    assert [r.text for r in readers.documents(spark, str(tmp_path), lambda b: [b.decode().upper()]).collect()] == ["ONE\x0cTWO"]


def test_config_and_env(tmp_path, monkeypatch):
    at = tmp_path / "c.yaml"
    at.write_text("")
    assert readers.config(str(at)) == {} and N.Profile.of({}) == N.BASIC
    env = tmp_path / ".env"
    env.write_text("# c\nLEAF_A='x'\nLEAF_B=y\nbad\n")
    monkeypatch.setenv("LEAF_B", "kept")
    monkeypatch.delenv("LEAF_A", raising=False)
    readers.dotenv(str(env))
    readers.dotenv(str(tmp_path / "none"))
    assert os.environ.pop("LEAF_A") == "x" and os.environ["LEAF_B"] == "kept"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ü")], "a int, b string")
    for _ in range(2):
        sinks.append_leaderboard(rows, str(tmp_path / "board"))
    assert spark.read.option("header", True).csv(str(tmp_path / "board")).count() == 2
    sinks.write_report(rows, str(tmp_path / "r" / "report.json"))
    assert json.load(open(tmp_path / "r" / "report.json")) == [{"a": 1, "b": "ü"}]
    with pytest.raises(ValueError, match="more than"):
        sinks.write_report(spark.range(5), str(tmp_path / "x.json"), 4)
    sinks.write_jsonl(rows, str(tmp_path / "lines"))
    assert readers.jsonl(spark, str(tmp_path / "lines")).first().b == "ü"
    sinks.write_vectors(spark.createDataFrame([(1, [1.0])], "doc int, vec array<float>"), str(tmp_path / "v"))
    sinks.echo_configs([str(tmp_path / "r" / "report.json")], str(tmp_path / "run"))
    assert os.path.exists(tmp_path / "run" / "report.json")


def test_line_numbers_of_a_file_in_many_splits(spark, tmp_path):
    """As a plain reader counts them, with a byte order mark, CR LF, blank lines and no line end at the end."""
    import random

    rng = random.Random(3)
    made = [rng.choice(["", " ", "x" * rng.randint(1, 300), f'{{"a": {i}}}', "ünï \r inside", "broken {"]) for i in range(900)]
    files = {"one.jsonl": "\ufeff" + "\r\n".join(made), "two.jsonl": "\n".join(made[:50]) + "\n", "empty.jsonl": ""}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(files["one.jsonl"].encode()) // 20))
    try:
        rows = readers.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 20
        got = {}
        for r in rows.collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.raw))
        assert sorted(got["one.jsonl"]) == list(enumerate(made, 1))
        assert sorted(got["two.jsonl"]) == list(enumerate(made[:50], 1)) and "empty.jsonl" not in got
        good, bad = readers.jsonl_tolerant(spark, str(tmp_path / "one.jsonl"), "a int")
        assert sorted((r.line, r.a) for r in good.collect()) == [(i, int(x[6:-1])) for i, x in enumerate(made, 1) if x.startswith("{")]
        assert sorted(r.line for r in bad.collect()) == [i for i, x in enumerate(made, 1) if x.strip() and not x.startswith("{")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_of_prompts(spark):
    rows = [(None if i % 3 else f"own{i}", i * 5 + 2, "t") for i in range(700)]
    frame = spark.createDataFrame(rows, "id string, line bigint, prompt string")
    got = {r.line: r.id for r in readers.with_prompt_ids(frame).collect()}
    assert got == {line: own or f"P{n}" for n, (own, line, _) in enumerate(rows, 1)}
    assert readers.with_prompt_ids(frame).columns == frame.columns
