"""Small hand-made frames: quirks, ladder exits, properties, skew and streaming twins."""

import datetime as dt
import random
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import dates as D
from clausegrid.functions import ordered
from clausegrid.functions import similarity as S
from clausegrid.functions import text as T
from clausegrid.operators import alerts as A
from clausegrid.operators import citations as C
from clausegrid.operators import compare as CMP
from clausegrid.operators import obligations as O
from clausegrid.operators import portfolio as P
from clausegrid.operators import retrieval as R
from clausegrid.operators import risk as RK
from clausegrid.operators import text as TX
from clausegrid.sources import io
from clausegrid.streaming import jobs as ST

SPACE = "\t\n\x0b\x0c\r \xa0 　﻿"


def values(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


# ------------------------------------------------------------------ text

def test_normalize_page_properties(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab-\n \t\xa0 é😀") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_page("t").alias("n")).collect()
    for r in rows:
        assert "-\n" in r.t or not re.search(f"[{SPACE}]{{2}}", r.n)
        assert "-\n" in r.t or r.n == r.n.strip(SPACE)
        assert not set(r.n) & set(SPACE) - {" ", "\n"}
        letters = f"[-{SPACE}]+"
        assert re.sub(letters, "", r.n) == re.sub(letters, "", r.t)


@pytest.mark.parametrize(("text", "expected"), [
    ("", ""), ("a", "a"), (" a  b ", "a b"), ("a \n b", "a\nb"), ("a\n\n\nb", "a\nb"), ("con-\ntract", "contract"),
    ("a\t\xa0b", "a b"), ("a - \n b", "a -\nb"), ("\n\n", ""), ("é😀  é", "é😀 é"),
])
def test_normalize_page_cases(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(T.normalize_page("t")).first()[0] == expected


def plain_dice(a, b):
    def norm(s):
        for src, to in zip(K.COMPARE_FROM, K.COMPARE_TO):
            s = s.replace(src, to)
        return re.sub(f"[{SPACE}]+", " ", s).strip(" ").lower()

    a, b = norm(a), norm(b)
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    ca, cb = (Counter(x[i:i + 2] for i in range(len(x) - 1)) for x in (a, b))
    return 2 * sum((ca & cb).values()) / (len(a) + len(b) - 2)


def test_dice_both_forms(spark):
    rng = random.Random(2)
    pairs = [(i, "".join(rng.choice("aab “”'—\n😀") for _ in range(rng.randint(0, 20))), "".join(rng.choice("aab \"'-\xa0😀") for _ in range(rng.randint(0, 20)))) for i in range(300)]
    df = spark.createDataFrame(pairs, "id int, a string, b string")
    both = df.select("id", S.dice("a", "b").alias("ab"), S.dice("b", "a").alias("ba")).join(S.dice_table(df, "id", "a", "b"), "id").collect()
    want = {i: plain_dice(a, b) for i, a, b in pairs}
    for r in both:
        assert r.ab == pytest.approx(want[r.id]) == pytest.approx(r.ba) == pytest.approx(r.score)
        assert 0 <= r.ab <= 1


def test_headings_and_segments(spark):
    text = "Intro\n1. One\nbody\n2\nNext line\n1.2.3.4.5 too deep\n3.1 " + "x" * 130 + "\n4. End  here\nlast"
    pages = spark.createDataFrame([(1, 1, text[:30], False), (1, 2, text[30:], False), (2, 1, "no numbers", False)], "dv_id long, page_number int, text string, ocr_derived boolean")
    placed = pages.withColumn("char_start", F.when(F.col("page_number") == 2, 30).otherwise(0)).withColumn("char_end", F.col("char_start") + F.length("text"))
    docs = TX.assemble(placed)
    found = values(TX.headings(docs).filter("dv_id = 1"), "char_start", "section_ref", "title", "depth")
    assert [f[1:3] for f in sorted(found)] == [("1", "One"), ("2", "Next line"), ("4", "End  here")]
    clauses = TX.segment(docs)
    rows = {r.section_title: r for r in clauses.collect()}
    assert set(rows) == {"Preamble", "One", "Next line", "End", "Page 1"}
    ordered_texts = [r.text for r in sorted((r for r in rows.values() if r.dv_id == 1), key=lambda r: r.char_start)]
    assert "".join(ordered_texts) == text
    assert rows["One"].page_start == 1 and rows["End"].page_start == 2


def test_page_offsets_tile(spark):
    pages = spark.createDataFrame([(1, n, "word " * (n % 7), False) for n in range(1, 900)], "dv_id long, page_number int, text string, ocr_derived boolean")
    rows = TX.page_offsets(pages).orderBy("page_number").collect()
    at = 0
    for r in rows:
        assert r.char_start == at and r.char_end == at + len(r.text)
        at = r.char_end
    big = spark.createDataFrame([(1, 1)], "dv_id long, page_number int").select("*", F.repeat(F.lit("x"), 60_000_000).alias("text"))
    assert TX.page_offsets(big).first().char_end == 60_000_000


@pytest.mark.parametrize("n", [0, 1, 799, 800, 801, 1480, 1481, 2161])
def test_chunk_windows_cover_all_words(spark, n):
    words = [f"w{i}" for i in range(n)]
    clause = spark.createDataFrame([("c", 1, None, 0, " \n" + "  ".join(words))], "clause_id string, dv_id long, section_ref string, char_start long, text string").withColumn("char_end", F.length("text").cast("long"))
    pages = clause.select("dv_id", F.lit(1).alias("page_number"), "char_start", "char_end", F.lit(True).alias("ocr_derived"))
    rows = TX.chunk(clause, pages).orderBy("seq").collect()
    text = clause.first().text
    seen = [w for r in rows for w in r.text.split(" ")]
    assert set(seen) == set(words)
    for r in rows:
        assert text[r.true_start:].startswith(r.text.split(" ")[0]) and r.ocr_derived
    for a, b in zip(rows, rows[1:]):
        assert a.text.split(" ")[-120:] == b.text.split(" ")[:120]


# ------------------------------------------------------------------ citations

def test_find_slice(spark):
    page = "The “Supplier” shall pay — within\nthirty days. Then the Supplier shall deliver all of the goods to the named warehouse."
    cases = {
        "exact": ("shall pay", 0), "loose": ('THE "SUPPLIER" shall PAY - within thirty', 5),
        "fuzzy": ("Then the Suplier shall deliver all the goods to named warehous", 40), "none": ("zzzz qqqq xxxx kkkk", 0), "empty": ("  ", 0)}
    df = spark.createDataFrame([(n, page, q, h) for n, (q, h) in cases.items()], "n string, p string, q string, h int")
    got = {r.n: r.hit for r in df.select("n", C.find_slice("p", "q", "h").alias("hit")).collect()}
    assert page[got["exact"].start:got["exact"].end] == "shall pay" and got["exact"].score == 1
    assert got["loose"].start == 0 and page[:got["loose"].end].endswith("thirty") and got["loose"].score == 1
    assert 0.5 <= got["fuzzy"].score < 1
    assert got["none"] is None and got["empty"] is None


def test_any_substring_is_found(spark):
    rng = random.Random(3)
    page = "".join(rng.choice("abc d\n“—") for _ in range(300))
    rows = []
    for i in range(60):
        s = rng.randint(0, 250)
        q = page[s:s + rng.randint(5, 40)]
        if q.strip():
            rows.append((i, page, q))
    got = spark.createDataFrame(rows, "i int, p string, q string").select(C.find_slice("p", "q").alias("h"), "q").collect()
    assert all(r.h.score == 1 and page[r.h.start:r.h.end] == r.q for r in got)


def candidate(key, status, value, kind, quotes, conf=0.9):
    ev = [(1, None, None, 0, len(q), q) for q in quotes]
    return (1, key, status, value, None, kind, ev, conf)


def test_field_ladder(spark):
    from clausegrid.plans.citation_queries import SPAN
    page = "Payment is due in thirty days. The cap is 12 months of fees paid by the Customer."
    a, b = page[:30], page[31:]
    rows = [
        candidate("absent", "not_found", None, "factual", [a]), candidate("no evidence", "found", "x", "factual", []),
        candidate("no citation", "found", "Payment", "factual", ["qq zz xx vv ww"]), candidate("lone conflict", "conflicting", "999", "factual", [a]),
        candidate("numbers differ", "found", "payment in 45 days", "factual", [a]), candidate("number word", "found", "payment due in 30 days", "factual", [a]),
        candidate("not grounded", "found", "warranty period", "factual", [a]), candidate("interpretation", "found", "warranty period", "interpretation", [a]),
        candidate("phrasing", "found", "payment days guarantees", "interpretation", [a]), candidate("conflicting", "conflicting", "fees paid", "interpretation", [b, a]),
        candidate("low", "found", "payment due", "factual", [a], 0.0)]
    cands = spark.createDataFrame(rows, f"dv_id long, field_key string, status string, value_text string, value_normalized string, extraction_kind string, evidence array<{SPAN}>, self_confidence double")
    pages = spark.createDataFrame([(1, 1, page, False, 0)], "dv_id long, page_number int, text string, ocr_derived boolean, char_start int")
    got = {r.field_key: r for r in C.validate_fields(cands, pages).collect()}
    assert {k: (r.verdict, r.status, r.superseded) for k, r in got.items()} == {
        "absent": ("absent", "not_found", False), "no evidence": ("absent", "not_found", False), "no citation": ("no citation", "not_found", True),
        "lone conflict": ("lone conflict", "found", False), "numbers differ": ("numbers differ", "not_found", True), "number word": ("valid", "found", False),
        "not grounded": ("not grounded", "not_found", True), "interpretation": ("valid", "found", False), "phrasing": ("phrasing", "not_found", True),
        "conflicting": ("valid", "conflicting", False), "low": ("valid", "needs_confirmation", False)}
    assert len(got["conflicting"].alt_citation_ids) == 1 and got["low"].confidence == 0.44


# ------------------------------------------------------------------ ordered helpers under skew

def test_blocked_forms_equal_plain_windows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLE", 40)
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 5), i, rng.choice([None, "a", "b"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int, v string")
    got = {(r.k, r.i): r for r in ordered.last_known_before(ordered.previous(ordered.numbered(df, ["k"], ["i"], "n"), ["k"], ["i"], ["v"]), ["k"], ["i"], "v", "known").collect()}
    seen, last, known = Counter(), {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        r = got[(k, i)]
        assert (r.n, r.prev_v, r.known) == (seen[k] + 1, last.get(k), known.get(k))
        seen[k] += 1
        last[k] = v
        known[k] = v if v is not None else known.get(k)


@pytest.mark.parametrize("same_instant", [True, False])
def test_a_hot_key_of_one_instant_is_cut(spark, monkeypatch, same_instant):
    """Nearly all rows in one key and one time unit: ranges of the whole order keep every group below a share of them."""
    monkeypatch.setattr(ordered, "SAMPLE", 100)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(7, i, t0 if same_instant else t0 + dt.timedelta(microseconds=i % 50), i % 3) for i in range(6000)] + [(k, k, None, 0) for k in range(100, 130)]
    df = spark.createDataFrame(rows, "k int, i int, t timestamp, v int")
    sizes = [r["count"] for r in ordered.blocked(df, ["k"], [F.col("t"), F.col("i")]).groupBy("k", ordered._B).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 0.2 * len(rows)
    cut = ordered.top_n(df, ["k"], [F.col("t").desc(), F.col("i")], None, split=[ordered.down("t"), F.col("i")])
    plain = ordered.top_n(df, ["k"], [F.col("t").desc(), F.col("i")], None)
    assert values(cut, "k", "i", "rank") == values(plain, "k", "i", "rank")
    sums = values(ordered.running_total(df.filter("t IS NOT NULL"), ["k"], ["t", "i"], F.col("v"), "s"), "i", "s")
    total = 0
    for (i, s), r in zip(sorted(sums, key=lambda x: (0 if same_instant else x[0] % 50, x[0])), sorted(rows[:6000], key=lambda r: (r[2], r[1]))):
        assert (i, s) == (r[1], total)
        total += r[3]


def test_due_totals_are_exact_beyond_what_is_shown(spark):
    rng = random.Random(21)
    as_of = dt.date(2000, 6, 15)
    obs = [(rng.randint(0, 2), i, 1, f"t{i}", as_of + dt.timedelta(days=rng.randint(-5, 400)), rng.choice(["active", "overdue", "completed"])) for i in range(900)]
    o = spark.createDataFrame(obs, "workspace_id int, obligation_id int, contract_id int, title string, due_date date, status string")
    c = spark.createDataFrame([(1, "C")], "contract_id int, title string")
    qs = [(i, rng.randint(0, 3), rng.choice([0, 1, 30, 31, 32, 33, 64, 365, 5000])) for i in range(60)]
    q = spark.createDataFrame(qs, "question_id int, workspace_id int, window_days int")
    want = {i: sum(w == x[0] and x[5] != "completed" and as_of <= x[4] <= as_of + dt.timedelta(days=n) for x in obs) for i, w, n in qs}
    got = {r.question_id: r for r in R.portfolio_answer(q, o, c, str(as_of)).collect()}
    assert {i: r.n for i, r in got.items()} == want
    assert all(r.content.count("\n") == min(r.n, 20) + (r.n > 20) for r in got.values())
    rows = Counter(r.question_id for r in R.portfolio_due(q, o, c, str(as_of)).collect())
    assert rows == Counter({i: n for i, n in want.items() if n})


# ------------------------------------------------------------------ dates and alerts

def test_due_dates_and_math(spark):
    rows = [("absolute", dt.date(2024, 1, 6), None, None, "business"), ("absolute", None, None, None, "calendar"), ("expiration_date", None, dt.date(2024, 3, 31), -90, "calendar"),
            ("event:go_live", None, dt.date(2024, 1, 1), 0, None), ("invoice_date", None, None, 15, "calendar"), ("custom", None, dt.date(2024, 1, 5), 1, "business")]
    df = spark.createDataFrame(rows, "anchor string, anchor_value date, a date, offset_days int, calendar string")
    got = {(r.anchor, r.anchor_value): r for r in O.with_due_date(df, F.col("a")).collect()}
    assert got[("absolute", dt.date(2024, 1, 6))].due_date_math == "fixed date 2024-01-06 (business calendar) = 2024-01-08"
    assert got[("absolute", None)].assumption_reason == "No fixed date supplied."
    assert got[("expiration_date", None)].due_date_math == "expiration 2024-03-31 minus 90 days notice = 2024-01-01"
    assert got[("event:go_live", None)].due_date_math == 'event "go live" 2024-01-01 (same day) = 2024-01-01'
    assert got[("invoice_date", None)].needs_assumption
    assert got[("custom", None)].due_date == dt.date(2024, 1, 8) and got[("custom", None)].due_date_math.endswith("(business days)")
    rec = spark.createDataFrame([("absolute", None, "FREQ=MONTHLY;BYMONTHDAY=5")], "anchor string, anchor_value date, recurrence string").withColumns({"offset_days": F.lit(0), "calendar": F.lit("calendar")})
    assert O.with_due_date(rec, F.lit(None).cast("date"), F.lit("2024-01-31").cast("date")).first().due_date == dt.date(2024, 2, 5)


def test_recurrence(spark):
    rows = [(1, "FREQ=MONTHLY;BYMONTHDAY=31", dt.date(2024, 1, 31)), (2, "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=30", dt.date(2023, 3, 1)), (3, "FREQ=DAILY", dt.date(2024, 1, 1))]
    got = O.expand_recurrence(spark.createDataFrame(rows, "id int, r string, s date"), "r", "s", 3)
    assert values(got, "id", F.col("occurrence").cast("string")) == [
        (1, "2024-02-29"), (1, "2024-03-31"), (1, "2024-04-30"), (2, "2024-02-29"), (2, "2025-02-28"), (2, "2026-02-28")]


def test_nine_local_over_daylight_saving(spark):
    df = spark.sql("select timestamp'2024-03-30 09:00:00' t, 'Europe/London' z union all select timestamp'2024-03-31 09:00:00', 'Europe/London' union all select timestamp'2024-07-01 23:30:00', 'Asia/Tokyo'")
    got = [r[0] for r in df.select(F.date_format(D.at_nine_local("t", "z"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-03-30 09:00", "2024-03-31 08:00", "2024-07-02 00:00"]


def test_alerts_prune_and_reschedule(spark):
    ob = spark.createDataFrame([(1, 1, dt.date(2024, 2, 1), 7, "in_app", "UTC"), (2, 1, None, 7, "in_app", "UTC")], "obligation_id long, workspace_id long, due_date date, owner_user_id long, channel string, timezone string")
    first = A.alert_schedule(ob, "2024-01-20 00:00:00")
    assert values(first, "offset_days") == [(1,), (7,)]
    moved = ob.filter("obligation_id = 1").withColumn("due_date", F.lit("2024-02-20").cast("date"))
    none = spark.createDataFrame([], "schedule_id string, delivered_at timestamp")
    again = A.reschedule(first, none, moved, "2024-01-20 00:00:00")
    assert {r.offset_days: r.status for r in again.collect()} == {1: "scheduled", 7: "scheduled", 14: "scheduled", 30: "scheduled"}
    strict = A.reschedule(first, none, moved, "2024-01-20 00:00:00", strict=True)
    assert {r.offset_days: r.status for r in strict.collect()} == {1: "cancelled", 7: "cancelled", 14: "scheduled", 30: "scheduled"}


# ------------------------------------------------------------------ retrieval

def test_search_syntax_against_brute_force(spark):
    texts = {"a": "the payment term is net thirty days", "b": "net payment of thirty", "c": "thirty net days of notice", "d": "notice only"}
    chunks = spark.createDataFrame([(k, 1, v) for k, v in texts.items()], "chunk_id string, workspace_id long, text string")
    asked = {1: "thirty net", 2: '"net thirty"', 3: "payment OR notice", 4: "thirty -notice", 5: "missing thirty", 6: "the of"}
    q = spark.createDataFrame([(i, 1, t) for i, t in asked.items()], "question_id long, workspace_id long, question string")
    got = {}
    for r in R.fts_topk(q, chunks).collect():
        got.setdefault(r.question_id, set()).add(r.chunk_id)
    assert got == {1: {"a", "b", "c"}, 2: {"a"}, 3: {"a", "b", "c", "d"}, 4: {"a", "b"}}


def test_vector_blocks_equal_brute_force(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(5)
    m = rng.normal(size=(90, 8)).round(3)
    rows = [(i, 0 if i % 3 else 1, [float(x) for x in m[i]]) for i in range(90)]
    monkeypatch.setattr(R, "CHUNKS_PER_BLOCK", 10)
    monkeypatch.setattr(R, "QUESTIONS_PER_BLOCK", 7)
    c = spark.createDataFrame(rows, "chunk_id long, workspace_id long, vector array<double>")
    got = {}
    for r in R.vector_topk(c.withColumnRenamed("chunk_id", "question_id"), c, 8, k=4, skip_same=True).collect():
        got.setdefault(r.question_id, {})[r["rank"]] = r.chunk_id
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(90):
        mates = [j for j in range(90) if j != i and (j % 3 == 0) == (i % 3 == 0)]
        want = sorted(mates, key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:4]
        assert [got[i][n] for n in (1, 2, 3, 4)] == want


def test_fusion_ignores_list_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "question_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "question_id long, chunk_id string, rank int")
    one, two = (values(R.rrf(p), "chunk_id", "rank", "score") for p in ([a, b], [b, a]))
    assert one == two and [r[0] for r in sorted(one, key=lambda r: r[1])] == ["y", "x", "z"]


# ------------------------------------------------------------------ comparison

def test_similar_clauses_and_greedy_against_brute_force(spark):
    rng = random.Random(6)
    stems = ["deliver goods to the warehouse", "pay invoices within thirty days", "keep data secret and safe", "x", ""]

    def texts(n, side):
        out = []
        for i in range(n):
            t = list(rng.choice(stems))
            for _ in range(rng.randint(0, 6)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("abcde ")
            out.append((rng.randint(1, 2), f"{side}{i:02d}", i * 10, None, "".join(t)))
        return out

    base, target = texts(25, "b"), texts(25, "t")
    schema = "pair_id int, clause_id string, char_start long, section_ref string, text string"
    b, t = spark.createDataFrame(base, schema), spark.createDataFrame(target, schema)
    got = {(r.base_id, r.target_id): r.score for r in CMP.similar_clauses(b, t).collect()}
    want = {(x[1], y[1]): plain_dice(x[4], y[4]) for x in base for y in target if x[0] == y[0] and plain_dice(x[4], y[4]) > 0.6}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    used, match = set(), {}
    for x in sorted(base, key=lambda r: r[2]):
        best = max(((s, -y[2], y[1]) for y in target for s in [want.get((x[1], y[1]), 0)] if s and y[1] not in used), default=None)
        if best:
            match[x[1]] = best[2]
            used.add(best[2])
    rows = CMP.align_clauses(b, t).collect()
    assert {r.base_id: r.target_id for r in rows if r.how == "similar"} == match
    assert {r.base_id for r in rows if r.how == "removed"} == {x[1] for x in base} - set(match)
    assert {r.target_id for r in rows if r.how == "added"} == {y[1] for y in target} - used


# ------------------------------------------------------------------ writes and governance

def test_upsert_and_replace_are_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    upd = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, v string")
    once = io.upsert(base, upd, ["id"])
    assert values(once, "id", "v") == [(1, "a"), (2, "c"), (3, "e")] == values(io.upsert(once, upd, ["id"]), "id", "v")
    kept = io.upsert(base, upd, ["id"], "ignore")
    assert values(kept, "id", "v") == [(1, "a"), (2, "b"), (3, "d")] == values(io.upsert(kept, upd, ["id"], "ignore"), "id", "v")
    new = spark.createDataFrame([(1, "open"), (1, "open")], "s int, st string")
    old = spark.createDataFrame([(1, "open"), (1, "done"), (2, "open")], "s int, st string")
    first = io.replace_slice(old, new, ["s"], F.col("st") == "open")
    assert values(first, "s", "st") == [(1, "done"), (1, "open"), (1, "open"), (2, "open")] == values(io.replace_slice(first, new, ["s"], F.col("st") == "open"), "s", "st")


def test_role_matrix(spark):
    roles = K.ROLES
    members = spark.createDataFrame([(1, i, r) for i, r in enumerate(roles)], "workspace_id long, user_id long, role string")
    acts = spark.createDataFrame([(w, i, a) for w in (1, 2) for i in range(6) for a in K.ACTIONS], "workspace_id long, user_id long, action string")
    rows = P.authorize(acts, members).collect()
    allowed = Counter((r.action) for r in rows if r.decision == "allowed")
    assert allowed["contract.create"] == 4 and allowed["risk.decide"] == 2 and allowed["member.remove"] == 1
    assert all(r.decision == "not_found" for r in rows if r.workspace_id == 2)


# ------------------------------------------------------------------ streams over several batches

def _files(spark, frames):
    folder = tempfile.mkdtemp(prefix="clausegrid-test-")
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return folder


def test_status_stream_equals_batch(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randint(1, 3), i, start + dt.timedelta(minutes=i), rng.choice(["parsing", "parsing", "ready"])) for i in range(160)]
    schema = "dv_id long, seq long, happened_at timestamp, status string"
    files = [[] for _ in range(5)]
    for r in rows:  # up to 25 minutes out of order, and shuffled within a file
        files[(r[1] + rng.randint(0, 25)) // 40].append(r)
    parts = [spark.createDataFrame(rng.sample(f, len(f)), schema) for f in files if f]
    folder = _files(spark, parts)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ST.run_to_sink(ST.status_change_stream(stream, "30 minutes"), lambda df, _: df, f"{folder}/out", f"{folder}/cp").awaitTermination()
    passed = spark.createDataFrame([r for r in rows if r[1] < 159 - 30], schema)  # what the watermark has passed at the end
    want = values(ST.status_changes(passed), "dv_id", "seq", "status", "done")
    assert values(spark.read.parquet(f"{folder}/out"), "dv_id", "seq", "status", "done") == want


def test_idle_keys_of_the_feed_expire(spark):
    start = dt.datetime(2024, 1, 1)
    schema = "dv_id long, seq long, happened_at timestamp, status string"
    rows = [(1, 0, 0, "parsing"), (1, 1, 5, "parsing"), (1, 2, 200, "parsing"), (2, 3, 900, "parsing")]
    parts = [spark.createDataFrame([(k, i, start + dt.timedelta(minutes=m), s)], schema) for k, i, m, s in rows]
    folder = _files(spark, parts)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ST.run_to_sink(ST.status_change_stream(stream, "10 minutes", idle_ms=60 * 60_000), lambda df, _: df, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert values(spark.read.parquet(f"{folder}/out"), "dv_id", "seq") == [(1, 0), (1, 2)]


def test_deliveries_once_over_batches(spark):
    schema = "idempotency_key string, n long"
    parts = [spark.createDataFrame(p, schema) for p in ([("a", 1), ("a", 2), ("b", 3)], [("a", 4), ("c", 5)], [("c", 6), ("b", 7), ("d", 8)])]
    folder = _files(spark, parts)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for checkpoint in ("cp", "cp", "empty"):  # again, and with an empty checkpoint over the same ledger
        ST.dedupe_deliveries(stream, f"{folder}/out", f"{folder}/{checkpoint}", ["n"]).awaitTermination()
        assert values(spark.read.parquet(f"{folder}/out"), "idempotency_key", "n") == [("a", 1), ("b", 3), ("c", 5), ("d", 8)]


def test_limiter_window_edges(spark):
    start = dt.datetime(2024, 1, 1)
    at = [0, 1, 2, 3, 4, 599, 600, 601]
    df = spark.createDataFrame([(1, i, start + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "k long, i long, ts timestamp")
    got = [r.limited for r in ST.rate_flags(df, "k", "ts", "i", 5, 600).orderBy("i").collect()]
    assert got == [sum(1 for x in at[:j + 1] if at[j] - x < 600) > 5 for j in range(len(at))]


# ------------------------------------------------------------------ newest rows, several versions and runs

FIELD = "contract_id long, dv_id long, field_id string, prompt_version string, field_key string, value_text string, value_normalized string, validation_status string"


def test_promote_dates_takes_both_from_the_newest_version(spark):
    fields = spark.createDataFrame([
        (1, 1, "a", "p1", "dates.effective", "2020-01-01", None, "found"), (1, 1, "b", "p1", "dates.expiration", "2021-01-01", None, "found"),
        (1, 2, "c", "p1", "dates.effective", "2022-01-01", None, "found")], FIELD)
    contracts = spark.createDataFrame([(1, None, None), (2, "2019-05-05", None)], "contract_id long, effective_date string, expiration_date string").selectExpr(
        "contract_id", "cast(effective_date AS date) AS effective_date", "cast(expiration_date AS date) AS expiration_date")
    got = {r.contract_id: (str(r.effective_date), str(r.expiration_date)) for r in O.promote_dates(fields, contracts).collect()}
    assert got == {1: ("2022-01-01", "None"), 2: ("2019-05-05", "None")}


def test_the_newest_run_counts(spark):
    fields = spark.createDataFrame([
        (1, 1, "a", "p1", "liability.cap_months", "9 months", '{"value":9}', "found"), (1, 1, "b", "p2", "liability.cap_months", "24 months", '{"value":24}', "found"),
        (1, 1, "c", "p1", "dates.expiration", "x", '{"date":"2030-01-01"}', "found"), (1, 1, "d", "p2", "dates.expiration", "y", '{"date":"2029-01-01"}', "found"),
        (1, 1, "e", "p1", "renewal.notice_period_days", "90", '{"days":90}', "found"), (1, 1, "f", "p2", "renewal.notice_period_days", "30", '{"days":30}', "found")], FIELD)
    rules = spark.createDataFrame([("r", 5, '{"type":"threshold","field":"liability.cap_months","op":">=","value":12}', "x", "high", "legal", True)],
                                  "rule_id string, workspace_id long, evaluator string, outcome string, severity string, reviewer_role string, active boolean")
    versions = spark.createDataFrame([(1, 5)], "dv_id long, workspace_id long")
    assert [r.result for r in RK.evaluate_playbook(versions, fields, rules).collect()] == ["ok"]
    (notice,) = O.renewal_notice_by(fields).collect()
    assert (str(notice.expiration_date), notice.notice_days) == ("2029-01-01", 30)


def test_sweep_ends_schedules_without_recipients(spark):
    schedules = spark.createDataFrame([(k, k, 7, "email", "scheduled", "2024-01-01 00:00:00", None) for k in (1, 2)],
        "schedule_id long, obligation_id long, workspace_id long, channel string, status string, at string, recipient_user_id long").selectExpr(
        "* except (at)", "cast(at AS timestamp) AS scheduled_for", "0 AS offset_days")
    none = spark.createDataFrame([], "idempotency_key string")
    due = A.due_schedules(schedules, none, "2024-02-01 00:00:00")
    no_result = spark.createDataFrame([], "schedule_id long, ok boolean")
    assert {r.status for r in A.settle_deliveries(schedules, no_result, "2024-02-01 00:00:00", due).collect()} == {"sent"}
    assert A.due_schedules(schedules, due.select("idempotency_key"), "2024-02-01 00:00:00").count() == 0


# ------------------------------------------------------------------ written indexes

def test_vector_index_covers_all_and_reaches_its_recall(spark):
    rng = random.Random(31)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, i % 3, [c + rng.gauss(0, 0.4) for c in centres[rng.randrange(12)]]) for i in range(3000)] + [(3001, 0, None), (3002, 1, [0.0] * 16)]
    df = spark.createDataFrame(rows, "chunk_id long, workspace_id int, vector array<double>")
    index = R.build_vector_index(df, 16, f"{tempfile.mkdtemp(prefix='clausegrid-test-')}/index", k=10)
    assert sorted(r.chunk_id for r in index.rows.collect()) == [i for i, _, v in rows if v is not None]
    assert index.probes < len(index.pivots) and index.recall >= 0.95
    asked = df.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "question_id")
    exact = {(r.question_id, r.chunk_id) for r in R.vector_topk(asked, df, 16, 10, skip_same=True).collect()}
    found = {(r.question_id, r.chunk_id) for r in index.search(asked, 10, skip_same=True).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_written_text_index_answers_as_the_unwritten(spark):
    rng = random.Random(32)
    words = [f"term{i}" for i in range(40)]
    chunks = spark.createDataFrame([(f"c{i}", i % 2, " ".join(rng.choices(words, k=30))) for i in range(200)], "chunk_id string, workspace_id int, text string")
    asked = spark.createDataFrame([(i, i % 2, q) for i, q in enumerate(["term1 term2", "term3 or term4 term5", '"term6 term7"', "term8 -term9", "absent"])], "question_id int, workspace_id int, question string")
    index = R.write_text_index(chunks, f"{tempfile.mkdtemp(prefix='clausegrid-test-')}/index")
    columns = ("question_id", "chunk_id", "rank", "score")
    assert values(R.fts_topk(asked, chunks, 10, index), *columns) == values(R.fts_topk(asked, chunks, 10), *columns)


# ------------------------------------------------------------------ comparisons of many alike clauses

def _clauses(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, clause_id string, char_start long, section_ref string, text string")


def test_hundreds_of_equal_clauses_match_in_order(spark):
    """Equal texts are one class: 300 of them cost one score, and the k-th base takes the k-th target."""
    text = "The Supplier shall keep the equipment insured at its own cost."
    other = "The Customer pays each invoice within thirty days of receipt."
    base = [("p", f"b{i:03d}", 10 * i, None, text if i % 2 else other) for i in range(600)]
    target = [("p", f"t{i:03d}", 10 * i, None, text if i < 300 else other) for i in range(600)]
    b, t = _clauses(spark, base), _clauses(spark, target)
    assert CMP._similar_classes(CMP._classes(b, None), CMP._classes(t, None), 0.6).count() == 2
    got = {r.base_id: r.target_id for r in CMP.align_clauses(b, t).collect()}
    equal = [f"b{i:03d}" for i in range(600) if i % 2]
    assert [got[x] for x in equal] == [f"t{k:03d}" for k in range(300)]
    assert [got[f"b{i:03d}"] for i in range(0, 600, 2)] == [f"t{k:03d}" for k in range(300, 600)]


def test_clauses_that_differ_only_late_are_changed(spark):
    head = "word " * 400
    rows = spark.createDataFrame([("p", "a", "b", 0, head + "x", head + " ".join(f"other{i}" for i in range(60))), ("p", "c", "d", 5, head, head.upper())],
                                 "pair_id string, base_id string, target_id string, base_ord long, b_text string, t_text string")
    listed, totals = CMP.changed_pairs(rows)
    assert [r.base_id for r in listed.collect()] == ["a"] and [tuple(r) for r in totals.collect()] == [("p", 1, "ready")]
    assert CMP.changed_pairs(rows, limit=0)[1].first().status == "partial"


def test_consecutive_versions_and_reuse(spark):
    versions = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 13, 4), (2, 20, 1)], "contract_id long, dv_id long, version_number int")
    pairs = CMP.consecutive_versions(versions)
    assert {(r.base_id, r.target_id) for r in pairs.collect()} == {(10, 11), (11, 13)}
    wanted = spark.createDataFrame([(10, 11, 1, 1), (11, 13, 1, 1), (10, 20, 1, 2), (10, 13, 1, 1)], "base_id long, target_id long, base_contract_id long, target_contract_id long")
    existing = spark.createDataFrame([("c1", 10, 11, "partial"), ("c2", 11, 13, "failed")], "comparison_id string, base_id long, target_id long, status string")
    got = {(r.base_id, r.target_id): (r.comparison_id, r.action, r.status) for r in CMP.start_comparisons(wanted, existing).collect()}
    assert got == {(10, 11): ("c1", "reuse", "partial"), (11, 13): ("c2", "restart", "computing"), (10, 20): (None, "refused", None), (10, 13): (None, "create", "computing")}


def test_batched_dice_equals_the_native_form(spark):
    rng = random.Random(8)
    pairs = [(i, "".join(rng.choice("aab ü😀") for _ in range(rng.randint(0, 30))), "".join(rng.choice("aab ü") for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows = spark.createDataFrame(pairs, "id int, a string, b string").select("id", S.dice_of_normalized(F.col("a"), F.col("b")).alias("x"), S.dice_batched(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(r.x == pytest.approx(r.y) for r in rows)


def test_fuzzy_search_reads_the_whole_page(spark):
    rng = random.Random(9)
    page = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(700))
    far = page[4000:4200]
    quote = far[:90] + "ZZ" + far[95:]
    hit = spark.createDataFrame([(page, quote, 0)], "p string, q string, h int").select(C.find_slice("p", "q", "h").alias("x")).first().x
    assert hit.score > 0.7 and 3900 < hit.start < 4100


def test_windows_of_the_fuzzy_search_are_scored_as_dice(spark):
    from clausegrid.operators.citations import fuzzy_hit
    rng = random.Random(10)
    rows = []
    for _ in range(60):
        page = "".join(rng.choice("ab c\n\xa0“") for _ in range(rng.randint(30, 200)))
        quote = "".join(rng.choice("abc ") for _ in range(rng.randint(2, 30))).strip()
        rows.append((page, quote))
    norm = {r.p: r.n for r in spark.createDataFrame([(q,) for _, q in rows], "p string").select("p", T.normalize_for_compare("p").alias("n")).collect()}
    for page, quote in rows:
        span = max(len(quote), 40)
        best = None
        for s in range(0, len(page) - span + 1, max(20, span // 4)):
            for z in (span, int(span * 0.8), -(-span * 5 // 4)):
                if s + z <= len(page):
                    score = plain_dice(page[s:s + z], quote)
                    if best is None or score > best[2]:
                        best = (s, s + z, score)
        got = fuzzy_hit(page, norm[quote], len(quote)) if len(norm[quote]) > 1 else None
        if best is None or best[2] < 0.5:
            assert got is None
        elif got is not None:
            assert got[:2] == best[:2] and got[2] == pytest.approx(best[2])
