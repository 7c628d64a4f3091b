import json
import random

import pytest
from pyspark.sql import functions as F

from sparkassay.functions.difficulty import with_rule_grade
from sparkassay.operators import curation, features, prompts, relational, runlog, selection, skew
from sparkassay.sources import catalog, tables


def test_attempts_stop_at_success_or_limit(spark):
    log = [(1, 1, "a", "e", 1, 1, 1.0), (1, 2, "b", None, 2, 2, 2.0), (1, 3, "c", None, 4, 4, 4.0),
           (2, 1, "a", "e1", 1, 0, 1.0), (2, 2, "b", "e2", 1, 0, 1.0), (2, 3, "c", "e3", 1, 0, 1.0), (2, 4, "d", None, 1, 0, 1.0),
           (3, 1, "x", "bad", 5, 5, 5.0)]
    df = spark.createDataFrame(log, "q int, attempt int, sql string, error string, prompt_tokens long, completion_tokens long, cost double")
    got = {r.q: tuple(r)[1:] for r in runlog.fold_attempts(df, "q").collect()}
    assert got == {1: ("b", None, 2, 3, 3, 3.0), 2: ("c", "e3", 3, 3, 0, 3.0), 3: ("x", "bad", 1, 5, 5, 5.0)}


def test_events_of_one_hot_request(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for req, n in ((1, 3000), (2, 5), (3, 1)):
        text, retries, status = "", 0, None
        for i in range(n):
            kind = rng.choice(["sql_token"] * 30 + ["retry", "done", "start", "error"])
            rows.append((req, i, i * 90, kind, f"t{i} " if kind == "sql_token" else None))
            if kind == "sql_token":
                text += f"t{i} "
            elif kind == "retry":
                text, retries = "", retries + 1
            elif kind in ("done", "error"):
                status = kind
        want[req] = (text, retries, status)
    df = spark.createDataFrame(rows, "r int, i long, s long, kind string, content string").withColumn(
        "at", F.timestamp_seconds("s")).repartition(5)
    got = {r.r: (r.sql_text, r.retries, r.status) for r in runlog.fold_events(df, "r", "at", "i").collect()}
    assert got == want


@pytest.mark.parametrize("states,want", [(["completed", "running"], "running"), (["failed", "completed"], "failed"),
                                         (["completed"], "done"), (["odd"], "pending"), (["pending", "failed"], "running")])
def test_status_rollup(spark, states, want):
    df = spark.createDataFrame([(s,) for s in states], "status string")
    assert df.agg(runlog.status_rollup()).first()[0] == want


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0)], "s string, m double")
    assert [r.s for r in runlog.sort_nulls_last(df, "m", True, "s").collect()] == ["c", "b", "a"]
    assert [r.s for r in runlog.sort_nulls_last(df, "m", False, "s").collect()] == ["b", "c", "a"]


def test_gate_missing_scorer_fails(spark):
    df = spark.createDataFrame([(1, "syntax_valid", 1.0), (1, "execution_ok", 0.8), (1, "result_match", 0.6)], "run int, scorer string, value double")
    verdict = runlog.gate_verdict(runlog.gate(df, "run"), "run").first()
    assert (verdict.passed, verdict.failures) == (False, "semantic_judge")


def test_pending_requeues_failed(spark):
    req = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "s string, d int")
    jobs = spark.createDataFrame([("a", 1, "completed"), ("b", 1, "failed")], "s string, d int, status string")
    assert sorted(r.s for r in runlog.pending_runs(req, jobs, ["s", "d"]).collect()) == ["b", "c"]


def test_model_alias(spark):
    df = spark.createDataFrame([("gemini/x",), ("a/gemini/x",)], "m string")
    assert [r[0] for r in df.select(runlog.model_alias(F.col("m"))).collect()] == ["google/x", "a/gemini/x"]


@pytest.mark.parametrize("q,level,conf", [
    ("How many parts?", "easy", 1.0), ("tell me", "medium", 0.0), ("how many never", "easy", 0.0),
    ("average per month of never", "medium", 0.333), ("HOW MANY orders did each customer place", "medium", 0.333)])
def test_rule_grades(spark, q, level, conf):
    row = with_rule_grade(spark.createDataFrame([(q,)], "question string")).first()
    assert (row.difficulty, row.confidence) == (level, conf)


def test_knn_ties_and_fixed_k(spark):
    pool = spark.createDataFrame([(1, "hard", [1.0, 0.0]), (2, "easy", [1.0, 0.0]), (3, "medium", [0.0, 1.0])],
                                 "ex long, difficulty string, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "q long, embedding array<double>")
    row = selection.classify_knn(q, pool, "q", "ex", "difficulty", 5, tie=selection.level_rank(F.col("_label"))).first()
    assert (row.difficulty, row.confidence) == ("easy", 0.2)


def test_static_examples(spark):
    pool = spark.createDataFrame([(3, "hard", "h"), (1, "easy", "e1"), (0, "odd", "o"), (2, "easy", "e2")], "pos int, difficulty string, question string")
    assert [r.question for r in selection.fewshot_static(pool, "pos").collect()] == ["e1", "h"]
    assert [r.question for r in selection.fewshot_static(pool, "pos", 1).collect()] == ["e1"]


def test_demo_selection(spark):
    rows = [("r", 1, 0, True), ("r", 2, 1, False), ("r", 3, 0, True), ("r", 4, 1, False), ("r", 5, 0, True), ("r", 6, 1, False),
            ("s", 1, 0, False), ("s", 2, 1, False), ("s", 3, 1, False), ("s", 4, 1, False), ("s", 5, 1, False), ("s", 6, 1, False)]
    df = spark.createDataFrame(rows, "run string, pos int, score int, failed boolean")
    got = sorted((r.run, r["rank"], r.pos, r.kind) for r in selection.select_demos(df, "run", "pos", "score", "failed").collect())
    assert got == [("r", 1, 2, "bootstrapped"), ("r", 2, 4, "bootstrapped"), ("r", 3, 1, "labelled"), ("r", 4, 3, "labelled"),
                   ("s", 1, 2, "bootstrapped"), ("s", 2, 3, "bootstrapped"), ("s", 3, 4, "bootstrapped"), ("s", 4, 5, "bootstrapped")]


def test_salted_join_keeps_every_row(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
                                    .otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("key"))
    counts = left.groupBy("key").agg(F.count("*").alias("n"))
    right = counts.withColumn("v", F.length("key"))
    out = skew.salted_join(left, right, "key", counts, "n", rows_per_salt=100)
    assert out.count() == 5000
    assert out.select("id").distinct().count() == 5000
    assert out.filter(~F.col("v").eqNullSafe(F.length("key"))).count() == 0


def test_embedder_runs_once_per_text(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(60)], "i long, text string").repartition(4)
    rows = features.embed_distinct(df, embed).collect()
    assert len(rows) == 60 and all(r.embedding == [float(len(r.text))] for r in rows)
    assert calls.value == df.select("text").distinct().count()


def test_not_in_null_rules(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,)], "j int")
    assert [r.k for r in relational.not_in(left, "k", right, "j").collect()] == [2]
    assert relational.not_in(left, "k", right.union(spark.createDataFrame([(None,)], "j int")), "j").count() == 0
    assert relational.not_in(left, "k", right.limit(0), "j").count() == 3


@pytest.mark.parametrize("share,least,want", [(0.8, 0, 80), (0.9, 1, 90), (0.0, 1, 1), (1.0, 0, 100), (0.333, 0, 33)])
@pytest.mark.parametrize("digits", [1, 4])
def test_split_is_exact(spark, share, least, want, digits):
    df = spark.range(100).repartition(3)
    out = curation.split_train_holdout(df, "id", share, seed=1, at_least=least, digits=digits).collect()
    assert len(out) == 100 and sum(r.split == "train" for r in out) == want
    again = curation.split_train_holdout(df.repartition(5), "id", share, seed=1, at_least=least, digits=digits).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_dedup_keeps_first_source(spark):
    df = spark.createDataFrame([(2, 0, "q", "b"), (1, 5, "q", "a5"), (1, 3, "q", "a3"), (2, 1, "r", "c")], "src int, pos int, question string, sql string")
    assert sorted((r.question, r.sql) for r in curation.combine_dedup(df).collect()) == [("q", "a3"), ("r", "c")]
    assert sorted((r.question, r.sql) for r in curation.combine_dedup(df, exclude=[1]).collect()) == [("q", "b"), ("r", "c")]


def test_ids_follow_arrival(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "batch int, pos int")
    assert [(r.batch, r.pos, r.id) for r in curation.assign_ids(df, ["batch", "pos"], 2).orderBy("id").collect()] == [(1, 1, "sq001"), (1, 2, "sq002")]


def test_prompt_pieces(spark):
    df = spark.createDataFrame([([("q1", "s1"), ("q2", "s2")],), ([],), (None,)], "p array<struct<question:string,sql:string>>")
    head = prompts.EXAMPLES_HEADER
    assert [r[0] for r in df.select(prompts.fewshot_block(F.col("p"))).collect()] == [
        f"{head}\n\nQuestion: q1\nSQL: s1\n\nQuestion: q2\nSQL: s2\n\n---\n", "", ""]
    msgs = spark.createDataFrame([("a", "q1"), ("a", "q2"), ("b", "q1")], "s string, q string").select(
        prompts.prefix_hash(prompts.prefix_stable_messages(F.lit(""), F.col("s"), F.col("q"))).alias("h")).collect()
    assert msgs[0].h == msgs[1].h != msgs[2].h


def test_catalogue_lookup_is_exact(spark):
    df = spark.createDataFrame([(1, "orders(id) -- x"), (2, "orders_old(id)"), (3, "items (orders)")], "pos int, table_def string")
    assert [r.pos for r in catalog.lookup(df, "Orders").collect()] == [1]
    assert [r.table_name for r in catalog.with_names(df).collect()] == ["orders", "orders_old", "items"]
    block = catalog.schema_block(df.withColumn("g", F.lit(1)), ["g"], "pos").first().schema_block
    assert block == "Database schema\n\nTables:\n  orders(id) -- x\n  orders_old(id)\n  items (orders)"


def test_question_file_with_mixed_rows(spark, tmp_path):
    path = tmp_path / "questions.json"
    path.write_text(json.dumps([
        {"id": "a", "difficulty": "easy", "question": "q", "sql": "s", "expected_rows": [[1, "x ", 2.5], [None, "10", True]]},
        {"id": "b", "difficulty": "hard", "question": "q", "sql": "s", "expected_rows": [], "notes": "n"}]))
    df = tables.load_questions(spark, str(path))
    assert {r.id: r.notes for r in df.collect()} == {"a": "", "b": "n"}
    assert [r.id for r in tables.load_questions(spark, str(path), "hard").collect()] == ["b"]
    assert [tuple(r) for r in tables.expected_cells(df).orderBy("row_no").collect()] == [
        ("a", 0, ["n:1.00", "s:x", "n:2.50"]), ("a", 1, [None, "s:10", "b:true"])]


def test_documents_and_index(spark, tmp_path):
    (tmp_path / "kb.md").write_text("# One\n\nTwo. Three.\n")
    doc = tables.load_documents(spark, str(tmp_path / "kb.md")).first()
    assert doc.text == "# One\n\nTwo. Three.\n" and doc.metadata["source"] == "kb.md" and doc.metadata["path"].endswith("/kb.md")
    index = tables.ChunkIndex(spark, str(tmp_path / "index"))
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "i int, text string")
    index.add(chunks)
    index.add(chunks)
    assert index.count().first().n_chunks == 4
    index.reset(chunks)
    assert index.count().first().n_chunks == 0


def test_jsonl_per_split(spark, tmp_path):
    df = spark.createDataFrame([("train", "a"), ("eval", "b")], "split string, question string")
    curation.write_jsonl(df, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.split, r.question) for r in back.collect()) == [("eval", "b"), ("train", "a")]


def test_shared_folder_is_read_or_made_once():
    from types import SimpleNamespace as NS

    from sparkassay.session import shared_dir

    def session(value, app):
        return NS(conf=NS(get=lambda k, d: value), sparkContext=NS(applicationId=app, master="local[2]"))

    assert shared_dir(session("/shared/x/", "a")) == "/shared/x"
    first = shared_dir(session(None, "b"))
    assert first and shared_dir(session(None, "b")) == first != shared_dir(session(None, "c"))
    on_cluster = session(None, "d")
    on_cluster.sparkContext.master = "spark://host:1"
    with pytest.raises(ValueError):
        shared_dir(on_cluster)


def test_several_calls_in_a_round(spark):
    rows = [(1, 1, 0, "query_database", "s1"), (1, 1, 1, "query_database", "s2"), (1, 2, 0, "get_schema", "x"), (2, 1, 1, "query_database", None),
            (2, 1, 0, "query_database", "only")]
    calls = spark.createDataFrame(rows, "q int, iteration int, call int, tool string, sql string").repartition(3)
    got = {r.q: (r.n_calls, r.last_sql, r.iterations, r.note) for r in runlog.tool_trace(calls, "q", F.col("sql"), max_rounds=2).collect()}
    assert got == {1: (3, "s2", 2, runlog.NO_ANSWER), 2: (2, "only", 1, None)}


def test_a_scorer_without_a_value_fails_the_gate(spark):
    scores = spark.createDataFrame([(1, s, 1.0) for s in runlog.THRESHOLDS] + [(2, s, 1.0) for s in list(runlog.THRESHOLDS)[1:]],
                                   "run int, scorer string, value double")
    got = {r.run: (r.passed, r.failures) for r in runlog.gate_verdict(runlog.gate(scores, "run"), "run").collect()}
    assert got == {1: (True, ""), 2: (False, list(runlog.THRESHOLDS)[0])}


def test_split_and_first_pairs_by_several_key_columns(spark):
    # Packed into one number these keys would meet.
    rows = [(1, 10_000, 5, "a"), (2, 0, 5, "b"), (1, 9_999, 1005, "c"), (1, 10_000, 4, "a")]
    df = spark.createDataFrame(rows, "src int, pos long, turn int, question string")
    first = curation.combine_dedup(df, pos=["pos", "turn"])
    assert sorted((r.question, r.src, r.pos, r.turn) for r in first.collect()) == [("a", 1, 10_000, 4), ("b", 2, 0, 5), ("c", 1, 9_999, 1005)]
    split = curation.split_train_holdout(first, ["src", "pos", "turn"], 0.67, at_least=1)
    assert sorted(r.split for r in split.collect()) == ["holdout", "train", "train"]
