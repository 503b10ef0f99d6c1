"""Brute-force comparisons and edge cases of the operators on small tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clausegrid.llm import (
    op1_fingerprints as op1,
    op2_warc as op2,
    op3_licenses as op3,
    op4_topk as op4,
    op5_mixing as op5,
    op6_html as op6,
    op7_packing as op7,
    op8_quality as op8,
    op9_sharding as op9,
    op10_near_dedup as op10,
    op11_whitening as op11,
    op12_runs as op12,
    op13_secrets as op13,
)
from clausegrid.llm.queries import tokenizer_path

ODD = [(1, None, "a"), (2, "", None), (3, "x", "b"), (4, "x", "b"), (4, "x", "b"), (5, "wort " * 30_000, "b"), (6, "ein Text ünd mehr \U0001f600", None)]
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(frame):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    return frame([r + ("en", 1, "z", 7) for r in ODD], DOCS + ", lang string, size long, `group` string, _row int")


@pytest.fixture(scope="module")
def none(frame):
    return frame([], DOCS + ", lang string")


# op1


def test_fingerprints_follow_the_next_document(frame, none):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 1, 7, 400, 3000]))) for _ in range(40)]
    got = {r.doc_id: r for r in op1.chained(frame(list(enumerate(texts)), "doc_id long, text string", 7)).collect()}
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        n = len(t) // 2
        edited = t[: len(t) - n] + after[:n]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (op1.fingerprint(t), op1.fingerprint(edited))
        assert (r.near_edited, r.near_next) == (op1.likeness(r.fingerprint, r.edited_fingerprint), op1.likeness(r.fingerprint, op1.fingerprint(after)))
    assert op1.chained(none).count() == 0


def test_fingerprint_cases(odd):
    rows = op1.chained(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.fingerprint)
    assert by[1] == by[2] and by[3] == by[4] and len(by[4]) == 1


def test_one_document_follows_itself(frame):
    (r,) = op1.chained(frame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0


def test_few_edits_are_near():
    rng = random.Random(3)
    t = "".join(rng.choice("abcdefghijklmnop ") for _ in range(5000))
    u = t[:1000] + "zz" + t[1000:3000] + t[3005:]
    other = "".join(rng.choice("abcdefghijklmnop ") for _ in range(5000))
    assert op1.likeness(op1.fingerprint(t), op1.fingerprint(u)) > 0.8
    assert op1.likeness(op1.fingerprint(t), op1.fingerprint(other)) < 0.3


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bounded_distance():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        for k in range(6):
            assert op1.within(a, b, k) == (_distance(a, b) <= k), (a, b, k)


def test_near_links(frame):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    rows = [(1, base), (2, base), (3, base[:500] + "X" + base[500:]), (4, base[::-1])]
    got = {(r.doc_id, r.hub_id) for r in op1.near_links(frame(rows, "doc_id long, text string"), most=8).collect()}
    assert {(2, 1), (3, 1)} <= got and not any(4 in p for p in got)


@pytest.mark.parametrize("block", [2000, 2])
def test_near_links_do_not_hang_on_the_smallest_id(frame, monkeypatch, block):
    monkeypatch.setattr(op1, "BLOCK", block)
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("abcdefghij ") for _ in range(600))
    rows = [(i, text()) for i in range(30)]  # unrelated, with the smallest ids
    for i in range(30, 60, 3):
        base = text()
        far = base[:200] + "#" * 20 + base[200:]
        rows += [(i, far), (i + 1, base), (i + 2, base[:300] + "X" + base[301:])]
    rows += [(100, rows[31][1]), (101, None), (102, "")]
    got = {(r.doc_id, r.hub_id) for r in op1.near_links(frame(rows, "doc_id long, text string"), most=8, bands=2, width=1).collect()}
    assert got == {(i + 2, i + 1) for i in range(30, 60, 3)} | {(100, 31), (102, 101)}


# op2


def test_warc_round_trip(spark, frame, tmp_path):
    pages = [(1, "http://a/ü?x=1\r\n", "<p>ä</p>"), (2, None, None), (3, "u", ""), (4, "v", "long " * 5000), (5, "w", "long " * 5000), (5, "w", "long " * 5000), (None, "n", "q")]
    index = op2.write_archives(op2.chunk_rows(op2.records(frame([p + (0,) for p in pages], "page_id long, url string, html string, chunk int")), chars=1000), f"file://{tmp_path}/w", 2000)
    chunks = op2.read_archives(index, 700)
    rows = op2.verified(chunks).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = next((p[2] or "") for p in pages if p[0] == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows} == {
        (1, "response", None), (2, "revisit", 3), (3, "response", None), (4, "revisit", 5), (5, "response", None), (None, "response", None)}
    whole = defaultdict(bytes)
    for r in chunks.where("page_id = 5").orderBy("chunk").collect():
        whole[r.chunk] = r.data
    assert b"".join(whole[k] for k in sorted(whole)) == b"long " * 5000 and len(whole) > 10
    assert {op2.decode_uri(r.target_uri) for r in rows if r.page_id == 1} == {"http://a/ü?x=1\r\n"}


def test_damaged_archive_is_seen(spark, frame):
    bad = frame([(1, "u", "response", None, "AAAA", 3, 0, b"abc", "BBBB", True)], op2.CHUNK_TABLE)
    with pytest.raises(Exception, match="damaged record"):
        op2.verified(bad).collect()


def test_warc_minimum_size_and_empty(frame):
    rows = op2.records(frame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), at_least=3).collect()
    assert [r.refers_to for r in rows] == [None, None]
    assert op2.archive_round_trip(frame([], "x int").sparkSession, frame([], "page_id long, url string, html string")).count() == 0


# op3


def test_license_rules(frame):
    s = op3.SENTENCES
    mit = "\n\n".join([s["mit-title"], "Copyright (c) 2020 X", s["mit-grant"].replace(" to ", "\nto "), s["mit-notice"], s["mit-asis"]])
    rows = [(1, mit), (2, "a | b\n" + s["cc-by-nc-4"] + "\nmore | words"), (3, s["mit-notice"]), (4, None), (5, "Some words. " + s["apache-short"] + " " + s["gpl3-short"]),
            (6, "You need a license to drive."), (7, ""), (5, "Some words. " + s["apache-short"] + " " + s["gpl3-short"])]
    got = {r.doc_id: r for r in op3.scan(frame(rows, "doc_id long, text string")).collect()}
    assert (got[1].licenses, got[1].n_matches, got[1].n_unused) == ("MIT", 1, 0)
    assert (got[2].licenses, got[2].state) == ("CC-BY-NC-4.0", "known")
    assert (got[3].licenses, got[3].n_unused, got[3].state) == ("", 1, "unknown")
    assert (got[4].n_sentences, got[4].state, got[7].state) == (0, "none", "none")
    assert got[5].licenses == "Apache-2.0,GPL-3.0-only"
    assert (got[6].n_unknown, got[6].state) == (1, "unknown")


# op4


def test_topk_brute_force(frame):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    rows += [(600, None), (601, [math.nan] * 8), (650, [None, 1.0]), (700, [1.0] * 8), (701, [1.0] * 8), (702, [1.0] * 8), (750, [0.5, 0.5])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in op4.topk(frame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()]
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and not any(x is None or not math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in vectors if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_topk_few_candidates_and_large_values(frame):
    rows = [(0, [1e9, -2e9]), (1, [3e9, 1e9]), (2, [-1e9, 0.0])]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in op4.topk(frame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    exact = {1: 65536 * (3 * 10**18 - 2 * 10**18), 2: -65536 * 10**18}  # beyond 64 bits, so at its ends
    assert got == {(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))} and all(abs(x) > 2**63 for x in exact.values())
    again = [(50, [1.0, 0.0]), (1, [1.0, 2.0]), (1, [5.0, 5.0]), (2, [3.0, 0.0]), (50, [9.0, 9.0])]
    rows = op4.topk(frame([r + (1, 2) for r in again], "vec_id long, embedding array<double>, rank int, score int"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in rows) == [(1, 1, 5 * 65536), (2, 2, 3 * 65536), (3, 1, 65536)]
    assert op4.topk(frame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).count() == 0


# op5


def _mixed(rows):
    """The mix copy by copy: the queue whose next copy ends at the smallest virtual time goes on, until the budget is reached."""
    order = sorted({r[2] for r in rows}, key=lambda x: (x is None, (x or "").encode()))
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    total = {x: sum(size[r[0]] for r in rows if r[2] == x) for x in order}
    weight, held = {x: k % 3 + 1 for k, x in enumerate(order)}, set()
    while True:
        free = [x for x in order if x not in held]
        level = (sum(total.values()) - sum(3 * total[x] for x in held)) / sum(weight[x] for x in free)
        more = {x for x in free if 3 * total[x] < level * weight[x]}
        if not more:
            break
        held |= more
    target = {x: float(3 * total[x]) if x in held else level * weight[x] for x in order}
    copies = []
    for k, x in enumerate(order):
        queue, done = sorted((r[0] for r in rows if r[2] == x), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)), 0
        for _ in range(3):
            for i in queue:
                done += size[i]
                if size[i]:
                    copies.append((done / target[x], k, done, i))
    left, took = sum(size.values()), Counter()
    for _, _, _, i in sorted(copies):
        took[i] += min(left, size[i])
        left -= min(left, size[i])
    return size, took, target


def test_mix(frame, odd, none):
    rng = random.Random(4)
    rows = [(i, " w" * rng.choice([0, 1, 5, 40]), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(400)]
    size, took, target = _mixed(rows)
    got = op5.report(frame(rows, DOCS, 5)).collect()
    assert {(r.doc_id, r.size, r.taken) for r in got} == {(i, size[i], took[i]) for i in size} and len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    by = Counter()
    for r in got:
        by[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 3 * r.size
    assert sum(by.values()) == sum(size.values()) and all(abs(by[x] - target[x]) <= 40 for x in by)
    order = op5.schedule(op5.mix(frame(rows, DOCS))).collect()
    ends = sorted((r.position, r.words, r.finish) for r in order)
    assert all(a + n == b and f <= g for (a, n, f), (b, _, g) in zip(ends, ends[1:]))
    assert op5.report(odd).count() == len(ODD) and op5.report(none).count() == 0


def test_choose(frame, odd, none):
    rng = random.Random(5)
    rows = [(i, " w" * rng.choice([0, 1, 5, 40]), rng.choice("ab")) for i in range(200)]
    size, took, _ = _mixed(rows)
    got = Counter(r.doc_id for r in op5.choose(frame(rows, DOCS)).collect())
    assert got == Counter({i: (2 * took[i] + size[i]) // (2 * size[i]) - (2 * took[i] % (2 * size[i]) == size[i]) for i in size if size[i] and 2 * took[i] > size[i]})
    out = op5.choose(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} <= {3, 4, 5, 6}
    assert op5.choose(none).count() == 0
    blank = frame([(1, " " * 60, "a", 9, 9), (2, None, "a", 9, 9), (3, "one word", "a", 9, 9), (3, "three more words", "b", 9, 9)], DOCS + ", _row int, _copies int")
    out = op5.choose(blank)
    assert out.columns == blank.columns and {(r.doc_id, r.text) for r in out.collect()} <= {(3, "one word"), (3, "three more words")}
    assert op5.choose(frame([(1, " ", "a"), (2, None, None)], DOCS)).count() == 0


# op6


def _page(body, host="h.example", k=0):
    return (k, f"http://{host}/{k}", f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>")


def test_extract_kinds():
    html = ('<html><body><header>Site</header><nav><a>m</a></nav><div class="cookie-notice">ok?</div><script>var t="</p>";</script>'
            '<article><h1>T&amp;T</h1><p><b>one<br>two<p>three &lt;x> <i>fo</i>ur\n\n five</p><aside>side</aside><form>f</form>'
            '<div class="comments"><p>first!</p></div></article><footer>&copy; x</footer>')
    assert op6.extract(html) == "T&T one two three <x> four five"
    assert op6.extract("") == "" and op6.extract("plain < 3 text") == "plain < 3 text"
    assert op6.extract("<p>a<p>b <span>c") == "a b c"


def test_wrapper_induction(frame):
    pages = [_page(f'<div class="top">Welcome to the site</div><div class="x"><div class="y">Read more of us</div><p>{" ".join(f"w{k}x{j}" for j in range(30))}</p><p>end{k}</p></div><div class="z">All about us</div>', k=k) for k in range(12)]
    got = {r.page_id: r.text for r in op6.extract_pages(frame(pages + [(99, None, None), (100, "http://h.example/e", "")], "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == " ".join(f"w{k}x{j}" for j in range(30)) + f" end{k}"
    assert got[99] == got[100] == ""


def test_tree_matching_is_the_largest_mapping():
    a = op6.shape([op6.parse("<div><p>1</p><ul><li>2</ul><h2>3</h2></div>")])
    b = op6.shape([op6.parse("<div><p>1</p><h2>4</h2></div>")])
    assert op6.match(a, b, {})[0] == 4  # page, div, p, h2
    merged = op6.merge(a, b)
    texts = {k.kind: k.text for k in merged.kids[0].kids}
    assert texts["p"] > 0 and texts["h2"] == -1 and merged.kids[0].kids[1].pages == 1


def test_constants_by_share_of_pages_small_hosts_and_neighbours(frame):
    def body(k):
        foot = "Imprint 2019" if k % 10 == 0 else "Imprint 2020"  # varies on a tenth of the pages
        return f'<div class="x"><p>story {k} starts</p><p>Please write to us</p><p>story {k} ends</p></div><div class="z">{foot}</div>'

    pages = [_page(body(k), k=k) for k in range(100)]
    pages += [_page(f'<h2>About</h2><p>one {k}</p><h2>Shop</h2><p>two {k}</p>', "two.example", k) for k in (200, 201)]
    pages += [_page("<p>same</p><p>text</p>", "copies.example", 300)] * 4  # one page, however often it is read
    got = {r.page_id: r.text for r in op6.extract_pages(frame(pages, "page_id long, url string, html string")).collect()}
    for k in range(100):
        assert got[k] == f"story {k} starts story {k} ends" + (" Imprint 2019" if k % 10 == 0 else "")
    assert (got[200], got[201], got[300]) == ("one 200 two 200", "one 201 two 201", "same text")


def test_children_of_one_kind_stay_apart():
    a = op6.shape([op6.parse("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p>")])
    assert [k.kind for k in a.kids] == ["h2", "p", "h2", "p"] and len(a.kids[3].texts) == 2
    total = a
    for k in range(2000):
        total = op6.merge(total, op6.shape([op6.parse(f"<h2>a</h2><p>b{k}</p><h2>c</h2><p>{k}</p><p>e</p>")]))
    assert [len(k.constant()) for k in total.kids] == [1, 0, 1, 1] and max(len(k.texts) for k in total.kids) <= op6.KEPT


def test_a_template_forgets_no_node():
    word = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    own = lambda k: "".join(f'<div class="{word(1000 * k + j)}"><b>{k}</b></div>' for j in range(30))
    rare = '<section class="rare"><p>Printed in Ghent</p></section>'
    total = None
    for k in range(100, 160):  # 3600 nodes that only one page has, the rare one on the first and on the last page
        total = op6._joined(total, op6.shape([op6.parse(own(k) + (rare if k in (100, 159) else ""))]))
    found = [n for n in total.kids if n.kind == "section.rare"]
    assert [(n.pages, len(n.kids[0].constant())) for n in found] == [(2, 1)] and total.count() == 1 + 60 * 60 + 2


def test_every_varying_slot_stays():
    assert op6.extract(f"<body><h1>Title</h1><p>Lead</p><div class=text>{'long ' * 200}</div></body>") == "Title Lead " + ("long " * 200).strip()
    assert op6.extract("<main><article>one</article><article>two, longer</article></main><p>last</p>") == "one two, longer last"
    html = ("<article><h2 id='related-work'>Related work</h2><section id='navigation'>At sea</section><div class='entry-header'><h1>T</h1></div>"
            "<h2 class='banner'>B</h2><div class='post cookie-notice'>no</div><div class='sidebar'>no</div></article><article class='comment'>no</article>")
    assert op6.extract(html) == "Related work At sea T B"


def test_any_depth(frame):
    deep = "<div>" * 5000 + "<p>deep down</p>"
    pages = [(k, f"http://deep.example/{k}", deep + f"<p>page {k}</p>") for k in range(6)] + [(9, "http://deep.example/9", "<b>" * 40_000 + "bold")]
    got = {r.page_id: r.text for r in op6.extract_pages(frame([p + (1, "z") for p in pages], "page_id long, url string, html string, host int, template string")).collect()}
    assert all(got[k].endswith(f"page {k}") for k in range(6)) and got[9] == "bold"
    a = op6.shape([op6.parse("<ul><li>a<li>b</ul><p>c <i>d</i></p>")])
    assert op6.Shape.load(a.dump()).dump() == a.dump() and a.count() == 5


def test_near_copies_are_one_page_of_evidence(frame):
    story = "".join(f"<p>{' '.join(f'w{k}x{j}' for j in range(40))}</p>" for k in range(12))
    site = '<div class="a">About our small site</div>'
    pages = [(k, f"http://copies.example/{k}", f"<body>{site}<h1>Title {k}</h1>{story}<p>only {k}</p></body>") for k in (1, 2)]
    pages += [(k, f"http://copies.example/{k}", f"<body>{site}<h1>Other {k}</h1><p>{' '.join(f'v{k}y{j}' for j in range(300))}</p></body>") for k in range(3, 12)]
    got = {r.page_id: r.text for r in op6.extract_pages(frame(pages, "page_id long, url string, html string")).collect()}
    for k in (1, 2):
        assert got[k].startswith(f"Title {k} w0x0") and got[k].endswith(f"w11x39 only {k}")
    assert got[5].startswith("Other 5 v5y0")


def test_template_decides_without_telling_names(frame):
    """The same pages, their names told and untold: what is constant goes either way."""
    def page(k, names):
        a, b, c = names
        return (f'<body><div class="{a}"><a>Home</a><a>News</a></div><div class="{b}"><h1>Story {k}</h1><p>{" ".join(f"t{k}w{j}" for j in range(50))}</p></div>'
                f'<div class="{c}">All rights of this site</div></body>')

    told = [(k, f"http://told.example/{k}", page(k, ("menu", "story", "footer"))) for k in range(20)]
    untold = [(100 + k, f"http://untold.example/{k}", page(k, ("u1", "u2", "u3"))) for k in range(20)]
    alone = [(999, "http://alone.example/", page(0, ("u1", "u2", "u3")))]
    got = {r.page_id: r.text for r in op6.extract_pages(frame(told + untold + alone, "page_id long, url string, html string")).collect()}
    assert all(got[100 + k] == got[k] for k in range(20)) and got[3].startswith("Story 3 t3w0")
    assert got[999] != got[0] and "Home" in got[999]


# op7


def test_packing(frame, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = [(1, None), (2, ""), (3, "  two  spaces \n and 'll <|endoftext|>"), (4, "word " * 9000), (5, "ünï " * 3)]
    got = op7.pack(frame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) and len(part) == r.length
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, p in pieces.items():
        assert sum(n for _, n in p) == len(ids[i])
        assert [s for s, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= 1
    assert op7.pack(odd, tokenizer_path()).select("doc_id").distinct().count() == 6 and op7.pack(none, tokenizer_path()).count() == 0


# op8


def _brute(train, text):
    """Interpolated modified Kneser-Ney, written from its formulas with plain dictionaries."""
    order = op8.ORDER
    seq = lambda t: op8.codes(t).tolist()
    counts = {order: Counter()}
    for t in train:
        s = seq(t)
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        n = Counter(c.values())
        cuts[k] = op8.discounts(n[1], n[2], n[3], n[4])
    def p(g):
        if not g:
            return 1 / op8.CLASSES
        c, ctx = counts[len(g)], g[:-1]
        same = [v for h, v in c.items() if h[:-1] == ctx]
        if not same:
            return p(g[1:])
        cut = lambda v: cuts[len(g)][min(v, 3) - 1]
        return (max(c[g] - cut(c[g]), 0) if c[g] else 0) / sum(same) + sum(map(cut, same)) / sum(same) * p(g[1:])
    s = seq(text)
    return sum(math.log(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1))


def test_kneser_ney(frame):
    train = ["the cat sat on the mat", "a cat and a hat", "the end", "", None, "über den Fluß"]
    texts = [(1, "the cat", "en"), (2, "zzz the", None), (3, "ünd 漢字", "de"), (4, "", "en"), (5, None, "en"), (1, "the cat", "en")]
    model = op8.train(frame([(t,) for t in train], "text string"))
    docs = op8.keep(frame(texts, "doc_id long, text string, lang string"), "docs")
    got = op8.score(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        text = next(t for i, t, _ in texts if i == r.doc_id)
        if text:
            assert r.logp == pytest.approx(_brute([t for t in train if t], text), rel=1e-9)
        else:
            assert r.logp is None


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("doc_id % 2 = 1").select("doc_id", "quality")
    got = op8.classify(docs, labels.where("doc_id % 2 = 0")).join(held, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.97 and kept[0] < 0.5


def test_a_language_without_enough_trusted_documents_stays(frame):
    rng = random.Random(11)
    def word(alphabet):
        return "".join(rng.choice(alphabet) for _ in range(5))
    rows = [(i, " ".join(word("abcde") for _ in range(40)), "en") for i in range(60)]
    rows += [(100 + i, " ".join(word("漢字文書契約条項") for _ in range(40)), "ja" if i % 2 else None) for i in range(20)]
    rows += [(200, "zq#%&!xj" * 20, "en"), (201, "", "ja")]
    docs = op8.keep(frame(rows, "doc_id long, text string, lang string"), "docs")
    labels = frame([(i, 1) for i in range(60)] + [(100 + i, 1) for i in range(8)] + [(200, 0)], "doc_id long, quality int")
    got = {r.doc_id: (r.kept, r.limit) for r in op8.classify(docs, labels).collect()}
    assert all(got[100 + i] == (True, None) for i in range(20))
    assert all(got[i][0] for i in range(60)) and not got[200][0] and not got[201][0]


def test_quality_cases(odd, none, frame):
    labels = frame([], "doc_id long, quality int")
    docs = op8.keep(odd, "odd")
    got = {r.doc_id: r.kept for r in op8.classify(docs, labels).collect()}
    assert not got[1] and not got[2] and got[3] and got[5]
    assert op8.classify(op8.keep(none, "none"), labels).count() == 0
    assert op8.select_good(docs, labels).columns == odd.columns


# op9


def test_best_fit_decreasing():
    rng = random.Random(8)
    sizes = sorted((rng.randrange(1, 50) for _ in range(300)), reverse=True)
    got, rooms, want = op9.best_fit_decreasing(sizes, 100), [], []
    for s in sizes:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= s]
        if fits:
            k = min(fits)[1]
        else:
            k = len(rooms)
            rooms.append(100)
        rooms[k] -= s
        want.append(k)
    assert got == want
    assert op9.pack_evenly([90, 5, 3, 2], 3) == [0, 1, 2, 2]


def test_shards(frame, odd, none):
    rng = random.Random(9)
    texts = ["t%d " % i * rng.randrange(1, 60) for i in range(700)] + ["hot text"] * 400
    got = op9.shard(frame(list(enumerate(texts)), "doc_id long, text string")).collect()
    shard_of, load, slots = {}, Counter(), defaultdict(list)
    for r in got:
        text = texts[r.doc_id]
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes"
        assert shard_of.setdefault(text, r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(load) == 16 and max(load.values()) - min(load.values()) < 0.02 * max(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert op9.shard(odd).count() == len(ODD) and op9.shard(none).count() == 0


# op10


def _near(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_all_pairs(frame, words):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two")]
    base = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(10, 130):  # a family around the threshold, links to some and not to others
        t = list(base)
        for _ in range(rng.randrange(0, 14 if words == 2 else 6)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((i, " ".join(t)))
    rows += [(i, rows[-1][1]) for i in range(130, 160)]
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(160, 200)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op10.link(frame(rows, "doc_id long, text string"), words=words).collect()}
    assert got == _near(rows, words, 80)


def test_near_cases(odd, none):
    got = {(r.doc_id, r.component_id, r.kept) for r in op10.link(odd).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False)} <= got
    out = op10.deduplicate(odd)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 5, 6]
    assert op10.link(none).count() == 0


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (900, 50, 50))
    x, y = (op10.odd_sketch(op10.min_samples(np.concatenate([common, s]))) for s in (a, b))
    differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
    assert abs(1 + op10.BITS / (4 * op10.SAMPLES) * math.log(1 - 2 * differ / op10.BITS) - 0.9) < 0.12


def test_components_of_a_chain(frame):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.id: r.root for r in op10.components(frame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


# op11


def _whitened(rows):
    import numpy as np

    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    mean = fit.mean(axis=0)
    e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    deviation = ((len(fit) * x - fit.sum(axis=0)) ** 2).sum(axis=1)
    return len(fit), deviation, (x - mean) @ v[:, ::-1][:, :4] / np.sqrt(np.maximum(e[::-1][:4], 1e-300)), e[::-1] / e.sum()


def test_whitening_brute_force(frame):
    rng = random.Random(12)
    scale = [3.0, 2.0, 1.5, 1.2, 1.0, 0.4, 0.0, 0.1, 0.1]
    rows = [(i, [rng.gauss(1, s) for s in scale]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # a third are copies
    bad = [(500, None), (501, []), (502, [math.nan] * 9), (503, [None] + [1.0] * 8), (504, [math.inf] * 9), (505, [1.0, 2.0]), (506, [1e300] * 9)]
    table = frame([r + (0, 1) for r in rows + bad], "vec_id long, embedding array<double>, component int, x int")
    n, deviation, want, explained = _whitened(rows)
    got = {(r.vec_id, r.component): r for r in op11.report(table).collect()}
    assert set(got) == {(i, k) for i, _ in rows for k in (1, 2, 3, 4)}
    for k in range(4):
        sign = 1 if got[0, k + 1].whitened * want[0][k] > 0 else -1
        for at, (i, _) in enumerate(rows):
            r = got[i, k + 1]
            assert (r.n, r.deviation) == (n, deviation[at]) and r.whitened == pytest.approx(sign * want[at][k], abs=1e-8)
            assert r.explained == pytest.approx(explained[k], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_finds_equal_eigenvalues(frame):
    rows = [(k, [s * 2.0 if j == k % 5 else 0.0 for j in range(6)]) for k, s in enumerate([1, 1, 1, 0.75, 0.5, -1, -1, -1, -0.75, -0.5])]
    got = op11.report(frame(rows, "vec_id long, embedding array<double>")).collect()
    share = {r.component: r.explained for r in got}
    assert [share[k] for k in (1, 2, 3, 4)] == pytest.approx([1 / 3.8125] * 3 + [0.5625 / 3.8125]) and got[0].identity_error < 1e-9


def test_whitening_cases(frame):
    schema = "vec_id long, embedding array<double>"
    assert op11.report(frame([], schema)).count() == 0
    assert op11.report(frame([(1, None)], schema)).count() == 0
    assert op11.report(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # nothing varies
    rows = op11.report(frame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -2.0]), (2, [0.0, -0.0])], schema)).collect()
    assert Counter((r.vec_id, r.component) for r in rows) == {(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1, (2, 1): 1, (2, 2): 1}
    big = op11.report(frame([(1, [1e15]), (2, [-1e15]), (3, [0.0])], schema)).collect()
    assert {(r.vec_id, r.deviation) for r in big} == {(1, None), (2, None), (3, 0)}  # beyond 64 bits


# op12


def _runs(words):
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q) and not any(all(words[k] == words[k + r] for k in range(s, e - r)) for r in range(1, q)):
                found.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(found)


def _planted(rng, letters, length):
    words = []
    while len(words) < length:
        if rng.random() < 0.5:
            words += [rng.randrange(letters) for _ in range(rng.randrange(1, 15))]
        else:
            period = [rng.randrange(letters) for _ in range(rng.randrange(1, 14))]
            words += (period * rng.randrange(2, 12))[: rng.randrange(5, 120)]
    return words


def test_runs_brute_force():
    rng = random.Random(13)
    total = 0
    for _ in range(1500):
        words = _planted(rng, rng.choice([1, 2, 3, 5, 20]), rng.choice([10, 30, 60, 200]))
        if rng.random() < 0.3:
            words += words[: rng.randrange(len(words))]
        want = _runs(words)
        assert op12.periodic_runs(words) == want
        total += len(want)
    assert total > 500
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 600:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert op12.periodic_runs(fibonacci[1]) == _runs(fibonacci[1])


def test_grammar_derives_the_text():
    rng = random.Random(14)
    for _ in range(200):
        words = _planted(rng, 4, 100)
        symbols, left = op12.grammar(words)
        covered = set(range(len(words)))
        for part, size, at in symbols:
            assert 0 < part < size and len(at) > 1 and len({tuple(words[p : p + size]) for p in at}) == 1
        assert left[0] == 0 and set(left) <= covered


def test_long_runs_take_linear_time():
    n = 200_000
    assert op12.periodic_runs([7] * n) == [(0, n, 1)]
    assert op12.periodic_runs([k % 1000 for k in range(n)]) == [(0, n, 1000)]


def test_runs_report(frame, odd, none):
    rng = random.Random(15)
    rows = [(i, " \t\n".join(f"w{c}" for c in _planted(rng, 3, rng.randrange(0, 90)))) for i in range(300)] + [(300, None), (301, ""), (None, "a b")]
    got = {r.doc_id: r for r in op12.report(frame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode() if i is not None else b""), len((text or "").split())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = _runs(words)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(runs), best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest()
    rows = op12.report(odd).collect()
    assert len(rows) == len(ODD) and {(r.start, r.length, r.period) for r in rows if r.doc_id == 5} == {(0, 30_000, 1)}
    assert op12.report(none).count() == 0


# op13


def _spans(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, re.ASCII | (re.IGNORECASE if r.fold else 0)):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), k, f"{r.kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_secrets_brute_force(frame, odd, none):
    rng = random.Random(16)
    parts = ["password", "PassWd", "secret", "TOKEN", "apikey", "api_key", "=", ":", " ", '"', "'", "abcd1234", "x", "AKIA", "ABCDEFGH1234", "0123456789abcdef",
             "é", "\u212aey", "ghp_", "A" * 36, "eyJ", ".", "-----BEGIN ", "PRIVATE KEY-----", "https://", "user:pass@host", "words of text", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(1500)] + [(2000, None), (2001, "")]
    rows += [(3000 + i, "token = abcdefgh1") for i in range(200)]
    rules = op13.BASE + op13.MORE
    got = {r.doc_id: r for r in op13.report(frame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base, spans = _spans(text or "", op13.BASE), _spans(text or "", rules)
        r = got[i]
        assert r.spans == ",".join(spans)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k + ":") for s in base) for k in ("assign", "access", "hex")]
    assert op13.report(odd).count() == len(ODD) and op13.report(none).count() == 0


def test_trigram_queries():
    assert op13.trigram_query("abcd") == ("and", (b"abc", b"bcd"))
    assert op13.trigram_query("AB[cC]x*d") == b"abc"
    assert op13.trigram_query("(one|two)+z?") == ("or", (b"one", b"two"))
    assert op13.trigram_query("[0-9a-f]+") is True and op13.trigram_query("(abc|)") is True and op13.trigram_query("a.c") is True
    assert op13.trigram_query("x(abc)*yz1") == b"yz1"
    held = lambda q, t: q is True or (q in t if isinstance(q, bytes) else (all if q[0] == "and" else any)(held(p, t) for p in q[1]))
    for rule, text in zip(op13.BASE + op13.MORE, [
            "API_KEY : 'abcdefgh", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "ghs_" + "a" * 36, "xoxp-" + "1" * 20, "AIza" + "x" * 40,
            "rk_live_" + "1" * 20, "eyJa.eyJb.c" + "x" * 20, "-----BEGIN RSA PRIVATE KEY-----", "ftp://me:pw@host"]):
        assert rule.compiled().search(text) and held(op13.trigram_query(rule.pattern), text.lower().encode())


def test_rules_without_an_index(frame):
    docs = frame([(1, "deadbeef" * 5), (2, "ÄÖ"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in op13.find(docs, op13.BASE[2:]).collect()}
    assert got == {1: [("hex", 0, 40)], 2: [], 3: []}
    assert {r.doc_id for r in op13.find(docs, [op13.Rule("umlaut", "ÄÖ")]).collect() if r.spans} == {2}


def test_long_rows_of_children_are_matched_as_short_ones(monkeypatch):
    rng = random.Random(12)

    def tree(depth):
        return "".join(f"<{(k := rng.choice(['p', 'h2', 'ul', 'b']))}>{rng.choice('xyz')}{tree(depth - 1) if depth else ''}</{k}>" for _ in range(rng.randint(0, 7)))

    for _ in range(40):
        a, b = (op6.shape([op6.parse(f"<div>{tree(2)}</div>")]) for _ in range(2))
        short = op6._align(a, b, {})
        with monkeypatch.context() as m:
            m.setattr(op6, "CELLS", 0)
            assert op6._align(a, b, {}) == short
    a, b = (op6.shape([op6.parse("<div>" + rows + "</div>")]) for rows in ("<b>0</b>" + "<p>1</p><h2>2</h2>" * 300, "<p>1</p><h2>2</h2>" * 300 + "<b>0</b>"))
    assert op6.match(a, b, {})[0] == 602  # the root, the div and all but the one that moved


def test_tables_of_the_rounds_are_few_files(spark):
    few = 2 * spark.sparkContext.defaultParallelism
    links = spark.range(5000).repartition(211, "id").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    kept = op10._keep_few(links, "links")
    assert len(kept.inputFiles()) <= few and sorted(kept.collect()) == sorted(links.collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        roots = op10.components(links.where("a % 10 <> 9"))
        assert len(roots.inputFiles()) <= few
        assert {tuple(r) for r in roots.collect()} == {(i, i - i % 10) for i in range(5000) if i % 10}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
