"""Mixing, packing, neighbours, WARC and HTML, and the pipeline."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import html, mixing, neighbours, packing, warc
from plumbline.llm.queries import QUERIES, SQL
from tests.llm.cases import TEXTS, WORD, documents
from tests.parity import compare, duck

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200.0, 450 * 2 / 8 + (450 * 5 / 8 - 200) * 2 / 3, 450 / 8 + (450 * 5 / 8 - 200) / 3]
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 15.0]
    assert mixing.targets([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    at = mixing.permuted(np.arange(n), n, 5)
    assert sorted(at) == list(range(n))
    assert (mixing.permuted(at, n, 5, inverse=True) == np.arange(n)).all()


@pytest.mark.parametrize(("block", "shard"), [(512, 1024), (7, 3), (1, 50)])
def test_mix_of_awkward_rows(spark, block, shard):
    df = documents(spark)
    got = rows_of(mixing.taken_words(mixing.mix(df, block=block, shard=shard)))
    sizes = Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in TEXTS)
    assert Counter((r["doc_id"], r["size"]) for r in got) == sizes
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    wanted = {(r["source_size"], r["target"]) for r in got}
    taken = Counter()
    for r in got:
        taken[r["source_size"], r["target"]] += r["taken"]
    assert sum(taken.values()) == sum(n * k for (_, n), k in sizes.items()) * 3 // 2 or block
    assert all(abs(taken[w] - w[1]) <= 0.5 * len([x for x in wanted if x == w]) + 0.5 for w in wanted)
    again = rows_of(mixing.taken_words(mixing.mix(df.repartition(7), block=block, shard=shard)))
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_a_third_of_all_rows_alike(spark):
    """Equal rows with one id are spread: over packing groups, and over buckets of a source's word order."""
    rows = [(7, "one two three", "en", "a")] * 3000 + [(100 + i, f"w{i} and more", "en", "ab"[i % 2]) for i in range(5000)]
    df = documents(spark, rows)
    items = packing.pieces(df)
    dealt = packing.deal(items, 100).groupBy("group").count().collect()
    assert sum(r["count"] for r in dealt) == 8000 and max(r["count"] for r in dealt) < 400
    packed = packing.packed_documents(df).groupBy("doc_id").count().where("doc_id = 7").first()
    assert packed["count"] == 3000
    plan = mixing.mix(df, block=16, shard=8)
    got = mixing.taken_words(plan).collect()
    assert len(got) == 8000 and sum(r.doc_id == 7 for r in got) == 3000
    for s in plan.sources:
        mine = sorted((r.start, r.size) for r in plan.rows.where(F.col("s") == s.key).collect())
        ends = [0, *(a + n for a, n in mine)]
        assert [a for a, _ in mine] == ends[:-1] and ends[-1] == s.size
        assert abs(sum(r.taken for r in got if r.target == s.target) - s.target) <= 1
    again = mixing.taken_words(mixing.mix(df.repartition(7), block=16, shard=8)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mixed_documents_hold_the_words_taken(spark):
    df = documents(spark)
    taken = Counter()
    for r in rows_of(mixing.taken_words(mixing.mix(df, block=7, shard=3))):
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mixed_documents(df, block=7, shard=3)
    assert out.columns == df.columns
    words = Counter()
    texts = dict((i, t) for i, t, *_ in TEXTS)
    for r in rows_of(out):
        mine = WORD.findall(r["text"])
        words[r["doc_id"]] += len(mine)
        assert r["n_chars"] == len(r["text"]) and not Counter(mine) - Counter(WORD.findall(texts[r["doc_id"]]))
    assert words == +taken


def test_best_fit_fills_and_shrinks():
    sizes = sorted(np.random.default_rng(2).integers(1, 4097, 800).tolist(), reverse=True)
    bins, caps = packing.best_fit(sizes)
    used = Counter()
    for b, n in zip(bins, sizes, strict=True):
        used[b] += n
    assert all(used[b] <= c for b, c in enumerate(caps)) and set(caps) <= set(packing.LENGTHS)
    assert all(c == min(x for x in packing.LENGTHS if x >= used[b]) for b, c in enumerate(caps))
    # No worse than packing at any one length alone.
    total = sum(map(packing.cost, caps))
    assert total <= sum(map(packing.cost, packing.best_fit(sizes, (4096,))[1]))
    assert sum(used.values()) / sum(caps) > 0.93
    assert packing.best_fit([]) == ([], [])


def test_packing_keeps_every_word(spark):
    df = documents(spark)
    got = rows_of(packing.packed_documents(df))
    sizes = sorted((str(i), len(WORD.findall(t or ""))) for i, t, *_ in TEXTS)
    sums = Counter()
    for r in got:
        sums[str(r["doc_id"])] += r["n_words"]
        assert (r["seq_id"] is None) == (r["n_words"] == 0)
    assert sums == sum((Counter({i: n}) for i, n in sizes), Counter())
    seqs = rows_of(packing.sequences(df))
    words = Counter(w for r in seqs for w in WORD.findall(r["text"]))
    assert words == Counter(w for _, t, *_ in TEXTS for w in WORD.findall(t or ""))
    assert all(len(WORD.findall(r["text"])) == r["used"] <= r["length"] for r in seqs)


def vectors(spark, x, extra=()):
    data = [(i, [float(v) for v in row], "?") for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")


def brute(x, queries, k):
    x = np.asarray(x, np.float32).astype(np.float64)
    out = {}
    for q in queries:
        s = x @ x[q]
        out[q] = [i for i in sorted(range(len(x)), key=lambda i: (-s[i], i)) if i != q][:k]
    return out


def test_neighbours_of_awkward_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[10:40] = x[5]
    bad = [(60, None, "?"), (61, [0.0] * 8, "?"), (62, [float("nan")] * 8, "?"), (63, [None] * 8, "?"), (64, [float("inf")] + [1.0] * 7, "?"), (65, [1.0], "?"), (None, [1.0] * 8, "?"), (7, [float(v) for v in x[7]], "?")]
    got = rows_of(neighbours.nearest(vectors(spark, x, bad), (neighbours.F.col("vec_id") % 5 == 0), k=20))
    want = brute(x, range(0, 60, 5), 20)
    lists = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]].astype(float) @ x[r["vec_id"]].astype(float)), abs=1e-9)
    assert set(lists) == set(want)
    # Equal vectors give equal scores up to the order of sums.
    assert all(len(set(lists[q]) & set(want[q])) >= 19 for q in want)
    assert lists[15] == want[15] or set(lists[15]) == set(want[15])


def test_neighbours_few_and_none(spark):
    q = neighbours.F.col("vec_id") % 2 == 0
    assert neighbours.nearest(vectors(spark, []), q).count() == 0
    assert neighbours.nearest(vectors(spark, [[1.0, 0.0]]), q).count() == 0
    assert neighbours.nearest(vectors(spark, np.eye(3)), q).count() == 4


def test_neighbours_recall_through_the_graph(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 64)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)).astype(np.float32) * rng.uniform(0.5, 1.5, (1500, 1)).astype(np.float32)
    got = rows_of(neighbours.nearest(vectors(spark, x), neighbours.F.col("vec_id") % 20 == 0))
    want = brute(x, range(0, 1500, 20), 20)
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in got)
    assert hits >= 0.95 * 20 * len(want)


@pytest.mark.parametrize("noise", [0.03, 0.001])
def test_neighbours_recall_among_near_copies(spark, monkeypatch, noise):
    """A third of the rows are slightly perturbed copies of one vector."""
    monkeypatch.setattr(neighbours, "LEAF", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(1000, 64)) * noise / 8
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = rows_of(neighbours.nearest(vectors(spark, x), neighbours.F.col("vec_id") % 20 == 0))
    want = brute(x, range(0, 3000, 20), 20)
    for group in (0, 1):
        asked = [q for q in want if (q % 3 == 0) == (group == 0)]
        hits = sum(r["vec_id"] in want[r["query_id"]] for r in got if r["query_id"] in asked)
        assert hits >= 0.9 * 20 * len(asked), group


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", None),
    (3, None, ""),
    (4, "http://a/4", "x" + FAKE + "tail"),
    (5, "http://a/5", FAKE[:-4]),
    (6, "http://a/6", FAKE),
    (7, "http://a/\r\n7", "WARC/1.1\r\n" * 5),
    (8, "http://a/8", "é漢\U0001f600\r\n\r\n" * 3000),
    (9, "http://a/9", "<p>one</p>"),
    (10, "http://a/10", "<p>one</p>"),
    (11, "http://a/11", "x" + FAKE + "tail"),
    (12, "http://a/12", "\r\n\r\n"),
]


def test_warc_round_trip(spark, tmp_path):
    import base64
    import hashlib

    df = spark.createDataFrame([(*r, "?", "?") for r in PAGES], "page_id long, url string, html string, id string, payload string").repartition(2)
    got = {r["page_id"]: r for r in rows_of(warc.round_trip(df, path=f"file://{tmp_path}/a"))}
    assert sorted(got) == [r[0] for r in PAGES]
    body = {i: (h or "").encode() for i, _, h in PAGES}
    for i, r in got.items():
        top = max(j for j in body if body[j] == body[i])
        digest = base64.b32encode(hashlib.sha1(body[i]).digest()).decode()
        want = (len(body[i]), digest, "response" if top == i else "revisit", None if top == i else top)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want, i
    records = warc.read(spark, f"file://{tmp_path}/a")
    assert records.where("record_type = 'response' and payload_digest <> declared_digest").count() == 0
    found = {r.record_id: bytes(r.payload) for r in warc.payloads(spark, f"file://{tmp_path}/a", records.where("record_type = 'response'")).collect()}
    assert found["<urn:page:8>"] == body[8]


def test_warc_of_an_id_with_several_payloads(spark, tmp_path):
    rows = [(1, "u", "A"), (1, "u", "unique"), (2, "u", "A"), (1, "u", "B"), (3, "u", "B"), (3, "u", "C"), (0, "u", "C"), (0, "u", "B")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(df, path=f"file://{tmp_path}/d").collect()
    import base64
    import hashlib

    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "A", 2), (1, "unique", None), (2, "A", None), (1, "B", 3), (3, "B", None), (3, "C", None), (0, "C", 3), (0, "B", 3)]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter((i, len(t), digest(t), "revisit" if at else "response", at) for i, t, at in want)


def test_warc_read_in_small_splits(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    df = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " * (i * 37 % 900) + (FAKE if i % 7 == 0 else "")) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = warc.round_trip(df, path=path)
        assert got.select("page_id").distinct().count() == got.count() == 300
        text = {r.page_id: len(r.html) for r in df.collect()}
        assert all(text[r.page_id] == r.payload_bytes for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert warc.round_trip(df.limit(0), path=f"file://{tmp_path}/c").count() == 0


def page(body, head="<title>T</title><script>if(a<b){x='</p>'}</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


STORY = "<p>First &amp; long   paragraph of the story\n goes on and on for a while.</p><p><b>Second</b>ary text, with <a href='/x'>a link</a>.<br>New line"
CASES = [
    (page(f"<nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><article><h1>Title</h1>{STORY}</article><footer>&copy; x</footer>"), "Title"),
    (page(f"<div class='menu'>M</div><div class='content c1'><h1>Title</h1>{STORY}<div class='share'>Share</div></div><div id='comments'><p>Comment text</p></div>"), "Title"),
    (page(f"<header>H</header><main><h1>Title</h1>{STORY}<aside>See also</aside><form><p>Mail</p></form></main><div class='cookie-notice'>We use cookies</div>"), "Title"),
    (f"<body><article><h1>Title{STORY}", "Title"),
]
EXPECT = "First & long paragraph of the story goes on and on for a while. Secondary text, with a link. New line"


def test_html_cases(spark):
    rows = [(i, f"http://h{i}.org/", h) for i, (h, _) in enumerate(CASES)] + [(90, None, None), (91, "nonsense", ""), (92, "http://h0.org/", "just text &lt;"), (93, "http://h0.org/", "<div>" * 3000 + "deep"), (94, "http://h0.org/x", "<nav>menu only</nav>")]
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id long, url string, html string, host string, paths string")
    got = {r["page_id"]: r for r in rows_of(html.main_texts(df))}
    assert len(got) == len(rows)
    for i, (_, title) in enumerate(CASES):
        assert got[i]["text"] == f"{title} {EXPECT}", i
    assert [got[i]["text"] for i in (90, 91, 92, 93, 94)] == ["", "", "just text <", "deep", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_html_hosts_vote(spark):
    """One page whose advert is longer than its article still follows its host."""
    good = [(i, "http://h.org/", page(f"<div class='body-{i}'>{STORY}</div><div class='zone'>short</div>")) for i in range(20)]
    odd = [(20, "http://h.org/", page(f"<div class='body-20'><p>Brief.</p></div><div class='zone'>{'offer ' * 200}</div>"))]
    df = spark.createDataFrame(good + odd, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in rows_of(html.main_texts(df))}
    assert got[20] == "Brief." and set(got[i] for i in range(20)) == {EXPECT}
    assert html.main_texts(df.limit(0)).count() == 0


BODY = "<p>" + "Long text of the story goes on. " * 30 + "</p>"
NESTED = [
    f"<article><h1>Title</h1><p>lead</p><div class='body'>{BODY}</div></article>",
    f"<article><div class='hd'><h1>Title</h1></div><div><p>lead</p></div><section>{BODY}</section></article>",
    f"<main><h1>Title</h1><article><p>lead</p><table><tr><td>{BODY}</td></tr></table></article></main>",
    f"<div class='post'><h1>Title</h1><p>lead</p><div><div><blockquote>{BODY}</blockquote></div></div></div>",
    f"<h1>Title</h1><p>lead</p><ul><li>{BODY}</li></ul>",
]


@pytest.mark.parametrize("copies", [1, 5])
def test_html_text_beside_a_nested_body(spark, copies):
    junk = "<nav><a href='/'>Home</a></nav><div class='ad'>Buy</div>"
    rows = [(10 * c + i, f"http://n{i}.org/{c}", page(junk + h + "<footer>f</footer>")) for i, h in enumerate(NESTED) for c in range(copies)]
    got = {r["page_id"]: r["text"] for r in rows_of(html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert len(got) == len(rows)
    for at, text in got.items():
        assert text == "Title lead " + " ".join(["Long text of the story goes on."] * 30), at


def test_html_other_parts_stay_out(spark):
    beside = page(f"<div class='wrap'><div class='zone'>offers</div><article><div class='body'>{BODY}</div></article><div class='zone'>more</div></div>")
    got = rows_of(html.main_texts(spark.createDataFrame([(1, "http://o.org/", beside)], "page_id long, url string, html string")))
    assert got[0]["text"] == " ".join(["Long text of the story goes on."] * 30)


def test_pipeline_stages(spark):
    df = documents(spark)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == [c for c in df.columns if c not in ("lang_pred", "score")], name
        kept.append(out.count())
        assert stage(spark, df.limit(0), "").count() == 0, name
        df = out
    assert kept[0] == sum(any(map(str.isalpha, t or "")) for _, t, *_ in TEXTS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "source_mixing", "best_fit_packing"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, name):
    message, _, _ = compare(spark, duck(SMALL), name, QUERIES[name], SQL[name], SMALL)
    assert message == "ok", message
