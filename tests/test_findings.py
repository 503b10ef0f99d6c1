"""Small cases for faults that larger or odd inputs showed."""

import datetime as dt
import pathlib

import __spark_entry__ as entry
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid import session as SE
from clausegrid.functions import ordered
from clausegrid.functions import similarity as S
from clausegrid.functions import text as T
from clausegrid.operators import alerts as A
from clausegrid.operators import citations as C
from clausegrid.operators import compare as CP
from clausegrid.operators import obligations as O
from clausegrid.operators import portfolio as P
from clausegrid.operators import retrieval as R
from clausegrid.operators import risk as RK
from clausegrid.operators import text as TX
from clausegrid.plans import entities as E
from clausegrid.plans import stream_queries as SQ
from clausegrid.streaming import jobs as ST


def test_a_table_streams_from_a_file_and_from_a_folder(spark, tmp_path):
    tables, out = tmp_path / "tables", tmp_path / "out"
    spark.range(30).repartition(3).write.parquet(str(tables / "folder.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "made"))
    [part] = (tmp_path / "made").glob("*.parquet")
    part.rename(tables / "file.parquet")
    for name, n in (("folder", 30), ("file", 5)):
        stream = ST.table_stream(spark, str(tables), f"{name}.parquet")
        ST.run_to_sink(stream, lambda df, _: df, str(out / name), str(out / f"{name}-cp")).awaitTermination()
        assert sorted(r[0] for r in spark.read.parquet(str(out / name)).select("id").collect()) == list(range(n))


def test_upper_case_by_character(spark):
    [row] = spark.createDataFrame([("aß ŉﬁ\U0001d400ǆᾳ é",)], "t string").select(T.upper_each("t")).collect()
    assert row[0] == "Aẞ ŉﬁ\U0001d400Ǆᾼ É"
    assert spark.createDataFrame([(None,)], "t string").select(T.upper_each("t")).first()[0] is None


def test_the_feed_takes_events_of_any_day(spark, tmp_path):
    start = dt.datetime(2023, 11, 5)
    kinds = ["view", "click", "purchase", "signup"]
    rows = [(i, i % 3, kinds[i * 7 % 4], start + dt.timedelta(hours=13 * i)) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    events = spark.read.parquet(str(tmp_path / "events.parquet")).filter(F.col("ts") < rows[-1][3] - dt.timedelta(days=5))
    want = ST.status_changes(SQ._status_of(events)).select("dv_id", "seq", "status", "done").collect()
    assert sorted(SQ.st1b(spark, str(tmp_path)).collect()) == sorted(want)


def test_a_quote_is_searched_once(spark):
    rows = spark.createDataFrame([("some page", "some qu ote")], "p string, q string").withColumn("x", C.find_slice("p", "q")).select("x.start", "x.end", "x.score")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("ArrowEvalPython [")[1].split("\n")[0].count("search(") == 1
    assert plan.count("ArrowEvalPython") == 1


def test_lint_tries_a_pattern_only_where_its_literal_occurs(spark):
    assert [T.literal(p) for p, _ in K.LINT_PATTERNS] == [
        "enforceable", "legally", "you should sue", "liable", "this violates", "is compliant with", "we recommend terminating", "you should terminate",
        " u.s.c.", "v.", " of the ", "guarantee", "certified", "consult ", "legal advice"]
    texts = ["Unenforceable, NOT  legally\xa0binding", "you WILL be not liable; Roe v.\u2009Wade", "uncertified guaranteesx", "per § 5 of the Data Act, under 42 u.s.c.", "Certified: consult YOUR lawyer", "", None]
    plain = F.filter(F.array(*[F.regexp_extract(F.coalesce("t", F.lit("")), T.jvm(p), 0) for p, _ in K.LINT_PATTERNS]), lambda h: h != "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(plain.alias("a"), T.lint("t")["phrase"].alias("b"), T.lint_clean("t").alias("c")).collect()
    assert [len(r.a) for r in rows] == [2, 2, 0, 2, 2, 0, 0]
    assert all(r.a == r.b and r.c == (not r.a) for r in rows)


def test_the_staff_of_a_workspace_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "STAFF_BLOCK", 3)
    due = spark.createDataFrame([("s1", "k1", 1, 10, "email", None), ("s2", "k2", 1, 11, "in_app", 7), ("s3", "k3", 2, 10, "email", None), ("s4", "k4", 3, 12, "email", None)],
                                "schedule_id string, idempotency_key string, workspace_id long, obligation_id long, channel string, recipient_user_id long")
    obligations = spark.createDataFrame([(10, "o", 5), (11, "p", 6), (12, "q", 5)], "obligation_id long, title string, contract_id long").withColumn("due_date", F.current_date())
    contracts = spark.createDataFrame([(5, "c")], "contract_id long, title string")
    members = spark.createDataFrame([(1, u, K.ALERT_ROLES[0]) for u in range(20)] + [(2, 30, K.ALERT_ROLES[0]), (2, 31, "viewer")], "workspace_id long, user_id long, role string")
    users = spark.createDataFrame([(u, f"u{u}") for u in range(40)], "user_id long, email string")
    rows = A.notifications_for(due, obligations, contracts, members, users)
    assert sorted((r.schedule_id, r.user_id, r.email) for r in rows.collect()) == sorted(
        [("s1", u, f"u{u}") for u in range(20)] + [("s2", 7, None), ("s3", 30, "u30")])


def test_java_white_space_is_the_fixed_class(spark):
    chars = spark.createDataFrame([(chr(i),) for i in [*range(0xd800), *range(0xe000, 0x10000), 0x1f600]], "c string")
    for plain, quick in ((K.WS, K.JVM_WS), (K.WS_NO_NEWLINE, K.JVM_WS_NO_NEWLINE)):
        assert chars.filter(F.col("c").rlike(f"[{plain}]") != F.col("c").rlike(f"[{quick}]")).count() == 0
        assert chars.filter(F.col("c").rlike(f"[-{plain}]+") != F.col("c").rlike(f"[-{quick}]+")).count() == 0
    assert "(" not in K.JVM_WS and K.JVM_WS.count("&&") == 1
    blank = spark.createDataFrame([("",), (" \xa0\n　",), (" x ",), ("\x85",), (None,)], "t string").select(T.is_blank("t"), T.trim_ws("t") == "").collect()
    assert [tuple(r) for r in blank] == [(True, True), (True, True), (False, False), (False, False), (None, None)]


def test_words_are_tried_only_where_they_occur(spark):
    texts = ["a TERMINATION fee", "Knotice", "noK", "Audit of the ſecurity", "", None, "limitation\nof liability", "uninsurance"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for stage, pattern in K.CONTEXT_STAGES.items():
        assert [r[0] or False for r in rows.select(F.col("t").rlike(pattern)).collect()] == [r[0] for r in rows.select(T.any_word("t", pattern)).collect()], stage
    plain = F.coalesce(*[F.when(F.coalesce("t", F.lit("")).rlike(p), n) for p, n in K.CLAUSE_TYPES])
    assert [r[0] for r in rows.select(plain).collect()] == [r[0] for r in rows.select(T.clause_type("t", "t")).collect()] == [r[0] for r in rows.select(T.clause_type(F.lit(None).cast("string"), "t")).collect()]


def test_vectors_are_made_within_the_row(spark):
    texts = ["Alpha beta beta 42", "", None, "été xK-\x00y", "-- €", "z" * 3000 + " z alpha", "alpha"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(2)
    tok = rows.select("chunk_id", F.explode(T.tokens("text")).alias("tok"))
    counts = tok.groupBy("chunk_id", T.hash_dimension(F.col("tok"), 97).alias("dim")).agg(F.count("*").alias("n"))
    norm = counts.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    want = counts.join(norm, "chunk_id").select("chunk_id", "dim", (F.col("n") / F.col("norm")).alias("weight"))
    got = R.hash_embed(rows, dim=97)
    assert sorted(got.collect()) == sorted(want.collect())
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.chunk_id for r in R.reembed(rows, 97).filter("vector IS NULL").collect()} == {1, 2, 4}


def test_current_versions_are_looked_up_before_they_become_fields(spark):
    d = "/root/testdata/sf0.001"
    some = E.table(spark, d, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("dv_id"))
    fields = E.extracted_fields(spark, d, some)
    assert sorted(fields.collect(), key=str) == sorted(E.extracted_fields(spark, d).filter("dv_id % 7 = 0").collect(), key=str)
    plan = entry.queries()["s05_export_fields"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan.split("Generate explode")[1]


def test_clauses_are_classed_by_a_digest_that_comes_along(spark):
    rows = [("p", "c1", "Pay  NOW"), ("p", "c2", "pay now"), ("p", "c3", "pay “now”"), ("p", "c4", 'PAY "now"'), ("q", "c5", "pay now"), ("q", "c6", "")]
    clauses = spark.createDataFrame(rows, "pair_id string, clause_id string, text string")
    want = {("c1", "c1", "pay now"), ("c2", "c1", None), ("c3", "c3", 'pay "now"'), ("c4", "c3", None), ("c5", "c5", "pay now"), ("c6", "c6", "")}
    brought = CP._classes(clauses.withColumn("form", CP.form_of("text")), None)
    for got in (CP._classes(clauses, None), brought):
        assert {(r["clause_id"], r["class"], r["norm"]) for r in got.collect()} == want
    known = spark.createDataFrame([(*r, b"f") for r in rows], "pair_id string, clause_id string, text string, form binary")
    assert "translate" not in CP._classes(known, None).select("clause_id", "class")._jdf.queryExecution().optimizedPlan().toString()


def test_a_rule_is_read_once_a_row(spark):
    rows = [(1, "FREQ=MONTHLY;BYMONTHDAY=31", dt.date(2024, 1, 15)), (2, "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", dt.date(2023, 3, 1)), (3, "freq=yearly", None), (4, "FREQ=YEARLY;BYMONTH=13;BYMONTHDAY=1", dt.date(2024, 1, 1)),
            (5, "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", dt.date(2023, 2, 28)), (6, "FREQ=MONTHLY", dt.date(2024, 1, 1)), (7, None, dt.date(2024, 1, 1)), (8, "FREQ=MONTHLY;BYMONTHDAY=1", None)]
    got = O.expand_recurrence(spark.createDataFrame(rows, "id int, r string, s date"), "r", "s", 2)
    assert sorted((r.id, r.n, str(r.occurrence)) for r in got.collect()) == [
        (1, 1, "2024-02-29"), (1, 2, "2024-03-31"), (2, 1, "2024-02-29"), (2, 2, "2025-02-28"), (5, 1, "2023-02-28"), (5, 2, "2024-02-29")]
    assert got.columns == ["id", "r", "s", "n", "occurrence"]
    above, below = got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")
    assert "str_to_map" not in above and "str_to_map" in below


def test_versions_are_dealt_before_they_become_fields(spark):
    d = "/root/testdata/sf0.001"
    for keys, make in ((K.ANCHOR_FIELDS.values(), O.anchors), (O.RENEWAL_FIELDS, O.renewal_notice_by)):
        some = E.extracted_fields(spark, d, keys=keys)
        assert sorted(some.collect(), key=str) == sorted(E.extracted_fields(spark, d).filter(F.col("field_key").isin(*keys)).collect(), key=str)
        assert sorted(make(some).collect(), key=str) == sorted(make(E.extracted_fields(spark, d)).collect(), key=str)
    for name in ("d01_anchors", "d07_renewal_notice"):
        plan = entry.queries()[name](spark, d)._jdf.queryExecution().sparkPlan().toString()
        executed = entry.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in executed.split("Generate explode")[0] and plan.split("Generate explode")[0].count("Aggregate") == 2, name


def test_whole_texts_are_compared_without_a_shuffle(spark):
    rows = [(1, "Pay  NOW", "pay now"), (2, "night", "nacht"), (3, "a", "b"), (4, None, "x"), (5, "", ""), (6, "aaaa\U0001d400b", "aab\U0001d400b"), (7, "ab" * 30_000, "ba" * 30_000)]
    got = S.dice_table(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b")
    assert {r["id"]: r.score for r in got.collect()} == {1: 1.0, 2: 0.25, 3: 0.0, 4: None, 5: 1.0, 6: 4 / 9, 7: 2 * 59_998 / 119_998}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_bounds_of_ranges_move_no_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLE", 7)
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 != 0, F.col("id") * 7 % 101).alias("v"), "id")
    cut = ordered.blocked(rows, ["k"], [F.col("v"), F.col("id")])
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    held = cut.groupBy("k", "__block").agg(F.min(F.struct("v", "id")).alias("a"), F.max(F.struct("v", "id")).alias("b")).collect()
    assert len(held) > 30
    spans = sorted((r.k, r["__block"], *((-1 if x.v is None else x.v, x.id) for x in (r.a, r.b))) for r in held)
    assert all(x[3] < y[2] for x, y in zip(spans, spans[1:]) if x[0] == y[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unhinted = ordered.top_n(rows, ["k"], [F.col("v"), F.col("id")], None, split=[F.col("v"), F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
        assert unhinted.count("strategy=broadcast") >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_index_is_written_in_segments_without_a_shuffle(spark, tmp_path):
    texts = ["Net payment of THIRTY days", None, "thirty net thirty", "", "of the", "été net 30", "notice -only \"net payment\" net", "net"] * 5
    chunks = spark.createDataFrame([(f"c{i}", i % 3, x) for i, x in enumerate(texts)], "chunk_id string, workspace_id long, text string").repartition(3).cache()
    asked = ["thirty net", '"net payment"', "payment OR notice", "thirty -days", "net OR 30", "missing net", "the of", "t net"]
    questions = spark.createDataFrame([(i * 3 + w, w, x) for i, x in enumerate(asked) for w in range(3)], "question_id long, workspace_id long, question string")
    assert "Exchange" not in R.text_segments(spark.range(9).selectExpr("id AS chunk_id", "id % 2 AS workspace_id", "'a b' AS text"))._jdf.queryExecution().executedPlan().toString()
    want = R.text_index(chunks)
    for words, least in ((2, 10), (R.SEGMENT_WORDS, 1)):
        index = R.write_text_index(chunks, str(tmp_path / f"index-{words}"), words)
        assert index.lists.select("segment").distinct().count() >= least
        assert index.lists.count() == index.lists.select("segment", "workspace_id", "term").distinct().count()
        stored = index.lists.select("segment", "workspace_id", "term", F.explode(F.arrays_zip("places", "counts")).alias("x")).select(
            "segment", "workspace_id", "term", F.col("x.places").alias("place"), F.col("x.counts").alias("tf")).join(index.chunks, ["segment", "place"])
        assert sorted(stored.select(*want.columns).collect()) == sorted(want.collect())
        found = R.fts_topk(questions, chunks, 10, index).select("question_id", "chunk_id", "score", "rank").collect()
        assert sorted(found) == sorted(R.fts_topk(questions, chunks, 10).select("question_id", "chunk_id", "score", "rank").collect())
        assert len(found) > 50
    empty = R.write_text_index(chunks.filter("chunk_id = 'none'"), str(tmp_path / "none"))
    assert R.fts_topk(questions, chunks, 10, empty).count() == 0


def test_titles_and_citations_are_looked_up_once_an_order(spark, tmp_path):
    d, odd = "/root/testdata/sf0.001", str(tmp_path)
    for name in ("nation", "customer", "orders", "lineitem"):
        rows = spark.read.parquet(f"{d}/{name}.parquet")
        key = F.col(rows.columns[0])
        if name in ("customer", "orders"):  # some are unknown, some known twice
            rows = rows.filter(key % 11 != 3).unionByName(rows.filter(key % 13 == 6))
        rows.write.parquet(f"{odd}/{name}.parquet")
    contracts, users, citations = E.contracts(spark, odd), E.users(spark, odd), E.order_citations(spark, odd)
    plain = P.risk_tab(E.risk_flags(spark, odd), contracts, RK.latest_decision(E.risk_decisions(spark, odd), users), citations)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tab = entry.queries()["s04_tab_risk_flags"](spark, odd)
        assert sorted(tab.collect(), key=str) == sorted(plain.collect(), key=str)
        assert 0 < tab.filter("`Source citation` = ''").count() < tab.count() != E.risk_flags(spark, odd).select("flag_id").distinct().count()
        plan = entry.queries()["s04_tab_risk_flags"](spark, odd)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(citation_id" not in plan and plan.count("hashpartitioning(flag_id") == 3  # decisions, those with names, flags
        assert "Join" not in plan.split("partial_max")[1].split("FileScan")[0]  # decisions are made where a line is read
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_order_of_a_latest_row_moves_once(spark):
    rows = [("a", 1, "x", None), ("a", 2, "y", 5), ("a", 2, "z", 4), ("b", None, "p", 1), ("b", None, "q", None), ("c", 3, None, None)]
    df = spark.createDataFrame(rows, "k string, at int, id string, v int")
    want = [("a", 2, "z", 4), ("b", None, "q", None), ("c", 3, None, None)]
    found = ordered.latest(df, ["k"], ["at", "id"])
    assert found.columns == df.columns and sorted(tuple(r) for r in found.collect()) == want
    assert "max_by" not in found._jdf.queryExecution().optimizedPlan().toString()
    mapped = ordered.latest(df.withColumn("m", F.create_map(F.lit("v"), "v")), ["k"], ["at", "id"])
    assert sorted((r.k, r["at"], r.id, r.m["v"]) for r in mapped.collect()) == want


def test_clauses_and_pages_are_ordered_together_without_moving_again(spark):
    pages = [(1, p, f"{p}. Title {p}\n{p}.1 Body of {p} goes\non here.\n", False, None) for p in range(1, 5)] + [(2, p, f"plain {p}", False, None) for p in (1, 2)]
    placed = TX.page_offsets(spark.createDataFrame(pages, "dv_id long, page_number int, text string, ocr_derived boolean, ocr_confidence double"))
    clauses = TX.segment(TX.assemble(placed))
    # one exchange for each of the two kinds of versions, whose pages move once
    assert clauses._jdf.queryExecution().sparkPlan().toString().count("Union") == 1
    assert clauses._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    rows = {r.clause_id: (r.section_ref, r.page_start, r.page_end, r.text) for r in clauses.collect()}
    assert [rows[k] for k in rows if rows[k][0] is None] == [(None, 1, 1, "plain 1"), (None, 2, 2, "plain 2")] and len(rows) == 7 and rows["1:49"][:3] == ("2.1", 2, 3)


def test_texts_of_equal_clauses_are_not_looked_up(spark):
    def side(rows, dv):
        return spark.createDataFrame([("p", f"{dv}:{i}", dv, ref, None, 100 * i, 100 * i + 9, text) for i, (ref, text) in enumerate(rows)],
                                     "pair_id string, clause_id string, dv_id int, section_ref string, section_title string, char_start int, char_end int, text string")

    kept, gone, new = "The Supplier shall deliver forty units.", "Each invoice is due in thirty days.", "All data stays within the country."
    base, target = side([("1", kept), ("2", gone), (None, "A preamble stands here.")], 1), side([("1", kept.upper()), ("2", new), (None, "A preamble stood here."), ("9", gone)], 2)
    texts = base.select("clause_id", "text").union(target.select("clause_id", "text"))
    bare = [s.withColumns({"form": CP.form_of("text"), "size": F.length(T.normalize_for_compare("text"))}).drop("text") for s in (base, target)]
    whole, aligned = CP.align_clauses(base, target), CP.align_clauses(*bare, texts=texts)
    assert sorted(aligned.collect(), key=str) == sorted(whole.collect(), key=str) and aligned.count() == 4
    pairs = CP.with_texts(aligned, *bare, texts)
    assert {(r.base_id, r.target_id, r.b_text, r.t_text) for r in pairs.collect()} == {
        ("1:1", "2:1", gone, new), ("1:2", "2:2", "A preamble stands here.", "A preamble stood here."), (None, "2:3", None, gone)}
    want = CP.changed_pairs(CP.with_texts(whole, base, target))
    assert [sorted(map(str, x.select("pair_id", x.columns[-1]).collect())) for x in CP.changed_pairs(pairs)] == [sorted(map(str, x.select("pair_id", x.columns[-1]).collect())) for x in want]


def test_a_written_table_leaves_no_shuffle_files(spark):
    def blocks():
        return {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}

    before, set_before = blocks(), spark.conf.get(SE.CLEANUP_CONF)
    table = SE.written(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(3, "k").groupBy("k").count())
    assert blocks() <= before and spark.conf.get(SE.CLEANUP_CONF) == set_before and table.count() == 7
    file = pathlib.Path(table.inputFiles()[0].removeprefix("file://"))
    assert file.exists()
    SE.unwrite(table)
    assert not file.exists()


def test_missing_fields_are_found_within_the_version(spark):
    (k0, _, _), (k1, _, _), *rest = K.TARGET_FIELDS
    fields = spark.createDataFrame([(1, k0), (1, k0), (1, k1), (2, "unknown.key"), (9, k0), (None, k0), (2, None)], "dv_id long, field_key string")
    versions = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "dv_id long, name string")
    searched = spark.createDataFrame([(1, "1,,2")], "dv_id long, sections string")
    out = C.complete_coverage(fields, versions, "p1", searched)
    rows = out.collect()
    assert sorted((str(r.dv_id), r.name, r.field_key) for r in rows) == sorted(
        [("1", "a", k) for k, _, _ in rest] + [(v, n, k) for v, n in (("2", "b"), ("2", "b"), ("None", "c")) for k, _, _ in K.TARGET_FIELDS])
    assert {tuple(r.searched_sections) for r in rows if r.dv_id == 1} == {("1", "2")} and {tuple(r.searched_sections) for r in rows if r.dv_id == 2} == {()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and "LeftAnti" not in plan  # the explosion is above the joins


def test_a_document_batch_keeps_compressed_tables_and_no_shuffle_files(spark, tmp_path, monkeypatch):
    seen = []

    def stages(batch, to_pages, draft, anchors, put):
        seen.append(batch.sparkSession.conf.get(SE.CLEANUP_CONF))
        assert put("kept", batch.repartition(2, "id")).count() == 9

    monkeypatch.setattr(ST, "process_documents", stages)
    spark.range(9).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    ST.document_stream(stream, lambda b: b, None, None, None, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["true"] and spark.conf.get(SE.CLEANUP_CONF) == "false"
    assert {f.name.endswith(".zstd.parquet") for f in (tmp_path / "out" / "kept").rglob("*.parquet")} == {True}
