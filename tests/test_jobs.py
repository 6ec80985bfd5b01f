"""The jobs, by runs over growing copies of the smallest tables, and against their SQL."""

import logging
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
import yaml

from jobs import ingest_chunks, leaderboard
from jobs import queries as jobs

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent
SCHEMA = "doc_id bigint, text string, source string, kept string, batch int"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")


def prose(n, word="meadow"):
    return ". ".join(f"The {word} of number {i} lies beyond the river" for i in range(n)) + "."


@pytest.fixture(scope="module")
def config():
    return yaml.safe_load(Path(ingest_chunks.CONFIG).read_text())


@pytest.fixture
def add(spark, tmp_path):
    """Adds one file of rows to the folder that the job reads."""

    def put(rows):
        spark.createDataFrame([(i, t, s, "x", 7) for i, t, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return put


@pytest.fixture
def ingest(spark, tmp_path, config):
    def run(**changed):
        return ingest_chunks.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), config | changed)

    return run


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_growing_input(spark, tmp_path, add, ingest, config):
    """The second run takes what is new alone; both together give what one run over everything gives."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    add(docs[:120])
    first = ingest()
    assert [d["pages"] for d in first] == [120] and ingest() == []
    before = files(tmp_path / "out")
    add(docs[120:])
    second = ingest()
    assert [(d["batch"], d["pages"]) for d in second] == [(1, 80)]
    after = files(tmp_path / "out")
    assert before.items() <= after.items() and len(after) > len(before)
    assert ingest() == [] and files(tmp_path / "out") == after
    whole = str(tmp_path / "whole")
    ingest_chunks.run(spark, f"{SF}/documents.parque[t]", f"{whole}/out", f"{whole}/checkpoint", config)
    assert shown(ingest_chunks.current(spark, str(tmp_path / "out"))) == shown(ingest_chunks.current(spark, f"{whole}/out"))
    assert sum(d["kept"] + d["noise"] for d in first + second) == ingest_chunks.chunks(spark, f"{whole}/out").count()
    assert shown(ingest_chunks.written(spark, str(tmp_path / "out")).select("batch", "pages", "kept", "noise")) == [(d["batch"], d["pages"], d["kept"], d["noise"]) for d in first + second]


def test_a_batch_that_was_cut_off_is_replaced(spark, tmp_path, add, ingest):
    add([(1, prose(60), "a"), (2, prose(70), "b")])
    ingest()
    add([(3, prose(80), "a"), (4, "DOI et al. 1999; 2000; 2001; journal", "c")])
    ingest()
    want = shown(ingest_chunks.chunks(spark, str(tmp_path / "out")))
    # as if the driver had been lost after the batch was written, or half written, before it was marked as done
    for p in (tmp_path / "checkpoint" / "commits").glob("*1*"):
        p.unlink()
    next((tmp_path / "out" / "chunks" / "batch=1" / "kept=true").rglob("*.parquet")).unlink()
    assert [(d["batch"], d["pages"]) for d in ingest()] == [(1, 2)]
    assert shown(ingest_chunks.chunks(spark, str(tmp_path / "out"))) == want


def test_pages_that_come_again(spark, tmp_path, add, ingest):
    add([(1, prose(60), "a"), (2, prose(60), "a"), (3, prose(50), "b"), (1, prose(60), "b")])
    ingest()
    add([(1, prose(40, "orchard"), "a"), (3, None, "b")])
    ingest()
    now = ingest_chunks.current(spark, str(tmp_path / "out"))
    texts = {(r.doc_key, r.page): r.text for r in now.collect()}
    assert set(texts) == {("a", 1), ("a", 2), ("b", 1)} and "orchard" in texts["a", 1] and "meadow" in texts["b", 1]


def test_odd_rows_and_settings(spark, tmp_path, add, ingest, config):
    """Nulls, empty texts, sources that make odd folder names, and profiles that keep all."""
    assert ingest_chunks.chunked(spark.createDataFrame([], "doc_key string, page bigint, text string"), config).count() == 0
    (tmp_path / "in").mkdir()
    assert ingest() == [] and ingest_chunks.current(spark, str(tmp_path / "out")).count() == 0
    add([(1, None, None), (2, "", ""), (3, prose(90), None), (4, prose(90), ""), (5, prose(30), "007"), (6, prose(30), "a/b=c d"), (None, prose(50), "007"), (7, "short", "007")])
    done = ingest(cleaning={"name": "basic"})
    assert [(d["pages"], d["noise"]) for d in done] == [(8, 0)]
    rows = ingest_chunks.current(spark, str(tmp_path / "out"))
    assert {(r.doc_key, r.page) for r in rows.collect()} == {(None, 3), ("", 4), ("007", 5), ("a/b=c d", 6), ("007", None), ("007", 7)}
    assert {r.chunk_id for r in rows.where("low_signal").collect()} == {"p0007_n0000"}


def test_small_batches(spark, tmp_path, add, ingest):
    for i in range(3):
        add([(i, prose(50), "s")])
    assert [d["pages"] for d in ingest(files_at_once=1)] == [1, 1, 1]
    assert ingest_chunks.listed(spark, str(tmp_path / "out")).count() == 3


RUNS = [
    {"name": "one", "chunking": {"strategy": "naive_tokens", "chunk_size": 60, "overlap": 10}, "retrieval": {"type": "bm25"}},
    {"name": "two", "chunking": {"strategy": "page_index"}, "retrieval": {"type": "dense"}},
]


@pytest.fixture
def compare(spark, tmp_path):
    def run(runs, k=3):
        base = yaml.safe_load(Path(leaderboard.CONFIG).read_text())
        pages = [(i, prose(20, w), s) for i, (w, s) in enumerate((w, s) for w in ("lantern", "harbour", "saffron", "velvet") for s in ("a", "b"))]
        spark.createDataFrame([(i, t, s, "x", 7) for i, t, s in pages], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "pages"))
        spark.createDataFrame([(1, "lantern of number 3"), (2, "saffron of number 19 lies"), (3, "nowhere at all"), (4, None)], "item_id bigint, text string").write.mode("overwrite").parquet(str(tmp_path / "questions"))
        return leaderboard.run(spark, str(tmp_path / "pages"), str(tmp_path / "questions"), str(tmp_path / "out"), base | {"runs": runs, "k": k})

    return run


def test_leaderboard(spark, tmp_path, compare, caplog):
    caplog.set_level(logging.INFO, "leaderboard")
    rows = {r["run"]: r for r in compare(RUNS)}
    assert "read 8 pages" in caplog.text and "wrote 12 results" in caplog.text
    assert rows["one"]["n"] == 4 and rows["one"]["hit_at_1"] == 0.5 and rows["two"]["hit_at_1"] == 0.5 and rows["two"]["n_chunks"] == 8
    out = str(tmp_path / "out")
    ranks, board = shown(leaderboard.ranks(spark, out)), shown(leaderboard.leaderboard(spark, out))
    assert {r.qid for r in leaderboard.ranks(spark, out).where("hit").collect()} == {1, 2}
    compare(RUNS)
    assert shown(leaderboard.ranks(spark, out)) == ranks and shown(leaderboard.leaderboard(spark, out)) == board
    # a run of fewer results replaces its own folder and no other; one with other settings has columns of its own
    assert compare([RUNS[0]], k=1)[0]["k"] == 1
    assert {r.run: r.n for r in leaderboard.ranks(spark, out).groupBy("run").count().withColumnRenamed("count", "n").collect()} == {"one": 4, "two": 12}
    compare([{"name": "three", "chunking": {"strategy": "tree_parent_child", "child_chunk_size": 50, "child_overlap": 5}}])
    merged = {r.run: r for r in leaderboard.leaderboard(spark, out).collect()}
    assert merged["three"].child_chunk_size == 50 and merged["one"].child_chunk_size is None and merged["one"].chunk_size == 60
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_runs_share_pages_and_tokens(compare, monkeypatch):
    """Pages are cleaned and cut into tokens once for all runs, and indexes of tokens don't cut the chunks again."""
    from leafmill.operators import chunks, lexical

    cut = []
    for module, name in ((chunks, "tokenized"), (chunks, "_normalized"), (lexical, "joined")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name: cut.append(n) or f(*a))
    assert len(compare([RUNS[0], RUNS[0] | {"name": "other", "chunking": RUNS[0]["chunking"] | {"chunk_size": 40}}, {"name": "pages", "chunking": {"strategy": "page_index"}, "retrieval": {"type": "bm25"}}])) == 3
    assert cut == ["tokenized"]


def test_names_of_runs(compare):
    for names in (["a/b"], ["x", "x"], [""]):
        with pytest.raises(ValueError):
            compare([RUNS[0] | {"name": n} for n in names])


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    done = con.execute(jobs.SQL[name])
    columns = [d[0] for d in done.description]
    want = sorted((tuple(r) for r in done.fetchall()), key=repr)
    got = jobs.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want


def test_command_line(spark, tmp_path, add, config):
    """In a process of its own, with a configuration given by path."""
    add([(1, prose(60), "a")])
    own = tmp_path / "own.yaml"
    own.write_text(yaml.safe_dump(config | {"chunking": {"chunk_size": 100, "overlap": 0}}))
    command = [sys.executable, str(ROOT / "jobs" / "ingest_chunks.py"), *(str(tmp_path / x) for x in ("in", "out", "checkpoint")), "--config", str(own)]
    done = subprocess.run(command, capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"})
    assert done.returncode == 0 and "read 1 pages" in done.stderr, done.stderr[-2000:]
    assert ingest_chunks.current(spark, str(tmp_path / "out")).count() == 6


def test_jobs_leave_the_training_data_operators_aside():
    for p in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        text = p.read_text()
        assert "import llm" not in text.replace('"import llm"', "") and "leafmill." + "llm" not in text and "corpus_" + "pipeline" not in text, p
