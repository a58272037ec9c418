"""Operators, sources and the incremental evaluation on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import tables as T
from ledgerlane.functions import text as X
from ledgerlane.operators import evaluation as E
from ledgerlane.operators import graph as G
from ledgerlane.operators import preparation as Q
from ledgerlane.operators import retrieval as R
from ledgerlane.sources import readers as S
from ledgerlane.streaming import incremental as I


def test_vote_ties_and_nulls(spark):
    rows = [("s", i, a, f"p{i}") for i, a in enumerate(["A", "B", "B", "A", None])] + [("t", 0, None, "")]
    got = {r["id"]: r for r in E.majority_vote(spark.createDataFrame(rows, "id string, pos int, answer string, program string"), "id").collect()}
    assert tuple(got["s"])[1:] == ("A", "p0", 0.4, 4, 5)
    assert tuple(got["t"])[1:] == (None, None, 0.0, 0, 1)


def test_join_gold_keeps_and_last_wins(spark):
    p = spark.createDataFrame([("a",), ("b",)], "id string")
    g = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "id string, gold string, n int")
    assert sorted(map(tuple, E.join_gold(p, g, order="n").select("id", "gold").collect())) == [("a", "y"), ("b", None)]


def test_accepted_attempts(spark):
    df = spark.createDataFrame([(1, 1, False, "a"), (1, 2, True, "b"), (1, 3, True, "c"), (2, 1, False, "d"), (2, 2, False, "e")], "id int, n int, ok boolean, text string")
    assert sorted((r["id"], r["text"], r["error"]) for r in E.accepted_attempts(df).collect()) == [(1, "b", 0), (2, "e", 1)]


def test_markdown(spark):
    md = "| A | B |\n|---|:-:|\n| 1 | x y |\n\n| - | |\n"
    assert spark.range(1).select(T.parse_markdown(F.lit(md))).first()[0] == [["A", "B"], ["1", "x y"]]
    table = [["h", "2019"], ["row one", "5"], ["short"]]
    df = spark.createDataFrame([(table,)], "t array<array<string>>")
    out = df.select(T.to_markdown(F.col("t")).alias("m")).select("m", T.parse_markdown(F.col("m"))).first()
    assert out[0].split("\n")[1] == "| ------- | ---- |" and [r[: len(t)] for r, t in zip(out[1], table, strict=True)] == table
    text = spark.createDataFrame([("intro\n| a | b |\n| 1 | 2 |\nend\nx | y",), ("a | b\nend",), ("none",)], "x string")
    assert [r[0] for r in text.select(T.first_table(F.col("x"))).collect()] == ["| a | b |\n| 1 | 2 |", "", ""]


def test_small_graph(spark):
    md = "| Revenue | COGS | Gross Profit |\n|---|---|---|\n| 100 | 60 | 40 |"
    full = "| Revenue | COGS | Gross Profit | Operating Expenses | Operating Income | Income Tax | Net Income |\n| 100 | 60 | 40 | 10 | 30 | 5 | 25 |"
    docs = spark.createDataFrame([(1, md), (2, full), (3, "no table")], "doc_id int, md string")
    tables = G.parsed_tables(docs, "md").cache()
    got = {r["doc_id"]: r for r in tables.collect()}
    assert got[1]["template"] == "gross_margin_ratio" and abs(got[1]["confidence"] - 2 / 3) < 1e-9 and got[2]["confidence"] == 1.0
    node, edge = G.nodes(tables), G.edges(tables)
    assert {(r["doc_id"], r["edge_type"]): r["count"] for r in edge.groupBy("doc_id", "edge_type").count().collect()} == {(1, "positional"): 3, (2, "accounting"): 6, (2, "positional"): 3}
    scores = {r["doc_id"]: r for r in G.constraint_scores(docs, node, edge).collect()}
    assert scores[1]["score"] == 1.0 and scores[3]["total"] == 0 and scores[2]["total"] == 6 and 0 < scores[2]["score"] < 1
    bad = G.perturbed(tables, node, edge, "additive").collect()
    assert [r["doc_id"] for r in bad] == [2] and bad[0]["new_value"] != bad[0]["original_value"]
    assert G.wrong_entity(docs.withColumn("c", F.lit("X")).withColumn("y", F.lit("2020")), "md", "c", "y").first()["table_md"].startswith("Company: Other X | Year: 2021\n")


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.row_to_text(F.array(F.lit("h"), F.lit("2019")), F.array(F.lit("sales"), F.lit("5")))) == "h the sales of 2019 is 5 ;"
    assert one(X.windows(F.lit("a b c d"), 2, 2)) == ["a b", "c d"] and one(X.windows(F.lit("a"), 2, 2)) == []
    assert one(X.without_thoughts(F.lit("<think>a\nb</think>c"))) == "c" and one(X.strip_html(F.lit("<a b>c</a>"))) == "c"
    assert one(X.html_tables(F.lit("<table><tr><th>A</th></tr><tr><td><b>1</b> </td></tr></table>"))) == [["A"], ["1"]]
    assert one(X.stringify_answer(F.array(F.lit("1"), F.lit("2")), F.lit("million"))) == "1 | 2 million"
    assert one(X.table_blocks(F.lit("|a\n|b\nx\n|c"))) == 2 and one(X.detokenize(F.lit("foo ##bar  x"))) == "foobar x"
    assert one(X.render("a X b Y", {"X": F.lit("Y"), "Y": F.lit("z")})) == "a z b z"


def test_preparation(spark):
    df = spark.createDataFrame([("1", "add(1,2)", "add(2, 1)"), ("2", "add(1, 2)", "add(1,2)"), ("3", "x", None)], "id string, program string, program_re string")
    assert sorted(r["id"] for r in Q.augment(df).collect()) == ["1", "1_re", "2", "3"]
    e = spark.createDataFrame([(1, ["a"], ["b"], [["h", "2019"], ["r", "5"]], {"text_1": "b"})], "id int, pre_text array<string>, post_text array<string>, table array<array<string>>, gold_inds map<string,string>")
    assert sorted((r["ind"], r["label"]) for r in Q.evidence(e).collect()) == [("table_0", 0), ("table_1", 0), ("text_0", 0), ("text_1", 1)]
    k = spark.createDataFrame([("g", i, int(i == 0)) for i in range(10)], "g string, k int, y int")
    assert Q.down_sample(k, "g", "y", "k").count() == 4
    split = Q.hash_split(spark.range(2000), "id", {"train": 80, "valid": 20}).groupBy("split").count().collect()
    assert {r["split"] for r in split} == {"train", "valid"} and sum(r["count"] for r in split) == 2000
    assert Q.hash_sample(spark.range(100), "id", 7).count() == 7
    b = Q.length_batches(spark.range(100).withColumn("n", F.col("id") % 10), "n", "id", 8, 4).groupBy("batch_id").agg(F.count("*").alias("c"), (F.max("n") - F.min("n")).alias("d"))
    assert b.agg(F.sum("c"), F.max("c"), F.max("d")).first()[0:2] == (100, 8)
    blocks = spark.createDataFrame([('[["a","b"],["c","d"]]',), ('["x","y"]',), ('{"text":"t"}',), ("plain",)], "b string")
    assert [r[0] for r in blocks.select(Q.block_text(F.col("b"))).collect()] == ["a | b\nc | d", "x\ny", "t", "plain"]
    nested = spark.createDataFrame([((1, ("x",)),)], "a struct<b:int,c:struct<d:string>>")
    assert Q.flatten(nested).columns == ["a_b", "a_c_d"]


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, 5), ("q", 2, 9), ("q", 3, 1)], "q string, k int, n int")
    assert [r["k"] for r in Q.budget_prefix(df, "q", ["k"], "n", 10, 10).collect()] == [1]


def test_ranking(spark):
    a = spark.createDataFrame([("q", "x", 3.0), ("q", "y", 2.0), ("q", "z", 1.0)], "query_id string, doc_id string, score double")
    b = spark.createDataFrame([("q", "z", 3.0), ("q", "x", 2.0)], "query_id string, doc_id string, score double")
    ra, rb = R.ranked(a), R.ranked(b)
    assert [r["doc_id"] for r in R.interleave(ra, rb, 4).orderBy("rank").collect()] == ["x", "z", "y"]
    fused = {r["doc_id"]: r["score"] for r in R.rrf([ra, rb]).collect()}
    assert abs(fused["x"] - (1 / 61 + 1 / 62)) < 1e-12 and abs(fused["y"] - 1 / 62) < 1e-12
    gold = spark.createDataFrame([("q", "y"), ("r", "x")], "query_id string, doc_id string")
    m = R.rank_metrics(ra, gold, 3).first()
    assert (m["queries"], m["mrr"], m["recall"]) == (2, 0.25, 0.5)
    assert R.evidence_recall(a, gold, 2).orderBy("query_id").collect()[0]["recall"] == 1.0


def test_sources(spark, tmp_path):
    sample = {"id": "1", "table": [["a"]], "qa": {"question": "q", "program": "add(1, 2)", "exe_ans": True}}
    (tmp_path / "train.json").write_text(json.dumps([sample]))
    (tmp_path / "rows.jsonl").write_text('{"id": "1"}\nbroken\n{"id": "2"}\n')
    (tmp_path / "lines.txt").write_text(" a \n\nb\n")
    reg = S.Registry([S.Corpus("ledger_qa", ("lq",), "program", (("train", str(tmp_path / "train.json")), ("test", str(tmp_path / "no.json"))), ("train",))])
    got = reg.read(spark, "LQ", "train").first()
    assert got["benchmark"] == "ledger_qa" and got["qa"]["exe_ans"] == "true" and got["pre_text"] is None
    assert {r["split"]: r["available"] for r in reg.status(spark).collect()} == {"train": True, "test": False} and reg.enabled("suite") == []
    assert S.read_json_lines(spark, str(tmp_path / "rows.jsonl"), "id string").count() == 2
    assert [r[0] for r in S.read_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["a", "b"]
    assert S.read_or_empty(spark, str(tmp_path / "gone.json"), "id string").count() == 0
    df = spark.createDataFrame([("1", "x,y")], "id string, t string")
    S.write_csv(df, str(tmp_path / "csv"))
    assert S.read_csv(spark, str(tmp_path / "csv"), "id string, t string").collect() == df.collect()
    r = spark.createDataFrame([("q", 1, "d", 0.5)], "query_id string, rank int, doc_id string, score double")
    S.write_rankings(r, spark.createDataFrame([("d", "text")], "doc_id string, text string"), str(tmp_path / "rank"))
    assert spark.read.json(str(tmp_path / "rank")).first()["context"] == "[DOC 1] text"


def test_incremental_evaluation(spark, tmp_path):
    schema = "id string, benchmark string, predicted_answer string, gold_answer string, predicted_program string"
    rows = [("1", "b", "5%", "5", "add(1, 2)"), ("2", "b", "x", "y", "plus(1)")]
    paths = [str(tmp_path / x) for x in ("in", "out", "ck")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.mode("append").json(paths[0])
        I.judge_new(spark, *paths, schema)
        assert I.report(spark, paths[1]).first()["total"] == i + 1
    got = I.report(spark, paths[1]).first()
    assert (got["answer_accuracy"], got["valid_rate"]) == (0.5, 0.5)


def test_windowed_counts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert I.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_remaining_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    strings = lambda *x: F.array(*map(F.lit, x))
    assert one(X.transliterate(F.lit("Umsatzerlöse 2, groß"))) == "Umsatzerloese gross" and one(X.german_number(F.lit("1.234,5"))) == 1234.5
    assert [one(c) for c in X.report_title(F.lit("Geschäftsbericht Alpha AG 2021"))] == ["alpha ag", 2021]
    assert one(X.token_indices(strings("add(", "5", "7.0", "x"), ["EOF", "add("], strings("7", "5"))) == [1, 3, 2, -1]
    ids = F.array(*map(F.lit, (1, 2, 3)))
    assert one(X.label_mask(ids, F.lit(2))) == [-100, -100, 3] and one(X.label_mask(ids, F.lit(5), tail=1)) == [-100, -100, 3]
    assert one(X.pad(ids, F.lit(5), 0)) == [1, 2, 3, 0, 0] and one(X.first_paragraphs(F.lit("abc"), 2)) == "ab"
    assert one(X.normalize_markers(F.lit("** a ** KEY ** b **\n\n\n\nc"), "KEY")) == "** a ** KEY **b**\n\nc"


def test_remaining_preparation(spark):
    df = spark.createDataFrame([(i, "x") for i in range(50)], "k int, t string")
    got = Q.unique_ids(df, ["k"]).orderBy("k").collect()
    assert [r["unique_id"] for r in got] == list(range(1_000_000_000, 1_000_000_050))
    nodes = spark.createDataFrame([(1, "v_0_0", 0, 0), (1, "v_0_1", 0, 1)], "doc_id int, node_id string, row_idx int, col_idx int")
    edges = spark.createDataFrame([(1, "v_0_1", "v_0_0"), (1, "v_9_9", "v_0_0")], "doc_id int, src string, tgt string")
    assert [(r["src_index"], r["tgt_index"]) for r in Q.indexed_edges(edges, nodes).collect()] == [(1, 0)]
    scored = spark.createDataFrame([("q", "table_1", 0.9), ("q", "text_2", 0.8), ("q", "text_3", 0.1)], "query_id string, ind string, score double")
    gold = spark.createDataFrame([("q", "text_2"), ("q", "text_3")], "query_id string, ind string")
    r = Q.split_retrieved(scored, gold, 2).first()
    assert ([x["ind"] for x in r["table_retrieved"]], [x["ind"] for x in r["text_retrieved"]], r["recall"]) == (["table_1"], ["text_2"], 0.5)
    c = spark.createDataFrame([(["a . . . . . . b"], ["w"], ["r", "s"])], "gold_facts array<string>, window array<string>, retrieved array<string>")
    assert [Q.context(c, m).first()["context"] for m in ("gold", "slide", "single", "none")] == ["a  b", "w", "r s", ""]


def test_join_unique(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    right = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, v string")
    assert sorted(map(tuple, E.join_unique(left, right).collect())) == [("a", 1, "x"), ("b", 2, "y")]
    for bad in (right.filter("id <> 'b'"), right.unionByName(right.filter("id = 'b'"))):
        with pytest.raises(Exception, match="key: b"):
            E.join_unique(left, bad).collect()


def test_metrics_by_name(spark):
    with pytest.raises(ValueError, match="unknown metrics: ContextLength"):
        E.metrics(spark.createDataFrame([(True,)], "ea boolean"), ["answer_accuracy", "ContextLength"])


def test_flatten_arrays(spark):
    df = spark.range(1).selectExpr("named_struct('b', array(named_struct('c', 1), named_struct('c', 2)), 'd', 3) AS a")
    assert Q.flatten(df, items=2).first().asDict() == {"a_b_0_c": 1, "a_b_1_c": 2, "a_d": 3} and Q.flatten(df).columns == ["a_b", "a_d"]


def test_done_rows_and_manifest(spark, tmp_path):
    from ledgerlane.sources import readers as S

    at, schema = str(tmp_path / "done"), "id long"
    assert S.read_done(spark, at, schema).count() == 0
    S.write_done(spark.range(3), at)
    S.write_done(spark.range(3, 5), at)
    (tmp_path / "done" / "part-broken.parquet").write_bytes(b"PAR1 not whole")
    assert sorted(r[0] for r in S.read_done(spark, at, schema).collect()) == [0, 1, 2, 3, 4]
    ranking = spark.createDataFrame([(1, 7, 0.5, 1), (1, 8, 0.4, 2), (2, 7, 0.1, 1)], "query_id long, doc_id long, score double, rank int")
    S.write_rankings(ranking, spark.createDataFrame([(7, "x"), (8, "y")], "doc_id long, text string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r_manifest")).first().asDict() == {"record_count": 2, "save_top_k": 2}
    assert spark.read.json(str(tmp_path / "r")).filter("query_id = 1").first()["context"] == "[DOC 1] x\n\n[DOC 2] y"
    cached = S.read_cached(spark, str(tmp_path / "none.json"), schema, lambda: spark.range(2))
    assert cached.count() == 2
    S.write_manifest(spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "test")], "benchmark string, split string"), str(tmp_path / "m"))
    assert sorted((r["benchmark"], r["n"]) for r in spark.read.json(str(tmp_path / "m")).collect()) == [("a", 2), ("b", 1)]
    S.write_compact(spark.createDataFrame([(1, "c")], "id int, all_candidates string"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).columns == ["id"]


def test_numbering_ignores_the_file_split(spark):
    df = spark.range(200).selectExpr("id", "id % 17 AS o")
    got = [{(r["id"], r["unique_id"]) for r in Q.unique_ids(x, ["o", "id"]).collect()} for x in (df, df.repartition(7), df.coalesce(1))]
    assert got[0] == got[1] == got[2] and len({u for _, u in got[0]}) == 200
    rows = spark.createDataFrame([(None, [("p",)], [(None, "q", "a", "", "x"), ("u", "r", "b", "", "y")])], "table struct<table:array<array<string>>>, paragraphs array<struct<text:string>>, questions array<struct<uid:string,question:string,answer:string,scale:string,answer_type:string>>")
    ids = [sorted(r["id"] for r in Q.unnest_questions(x, "tatqa").collect()) for x in (rows, rows.repartition(3))]
    assert ids[0] == ids[1] and ids[0][1] == "tatqa::u"
