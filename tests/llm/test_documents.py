"""Exact dedup, language identification, token counts, Jaccard join, toxicity on awkward rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact, jaccard, langid, tokens, toxicity
from tests.llm.cases import LONG, TEXTS, documents, jaccard_components

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_exact_groups_against_brute_force(spark):
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    got = rows_of(exact.exact_groups(documents(spark), carry={"text_sha256": sha}))
    assert len(got) == len(TEXTS)
    groups = {}
    for i, t, *_ in TEXTS:
        groups.setdefault(t or "", []).append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = digest[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_groups_with_a_hot_text(spark):
    rows = [(i, "same" if i % 3 else f"text {i}", "en", "a") for i in range(3000)]
    got = exact.exact_groups(documents(spark, rows))
    assert got.where("kept").count() == 1001
    assert got.where("keep_id = 2999 and group_size = 2000").count() == 2000


def test_exact_groups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", -1)
    a = exact.exact_groups(documents(spark))
    monkeypatch.undo()
    key = ["doc_id", "keep_id", "group_size"]
    assert sorted(map(repr, a.select(key).collect())) == sorted(map(repr, exact.exact_groups(documents(spark)).select(key).collect()))


def test_drop_copies_keeps_columns_and_one_row_each(spark):
    df = documents(spark)
    out = exact.drop_copies(df)
    assert out.columns == df.columns
    texts = [r.text or "" for r in out.select("text").collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, *_ in TEXTS})


def test_language(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(df.where("doc_id % 3 <> 1"))
    got = langid.predict(df.where("doc_id % 3 = 1"), model)
    n, hits = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert hits >= 0.97 * n
    counts = {}
    for r in df.where("doc_id % 3 <> 1").collect():
        counts[r.lang] = counts.get(r.lang, 0) + np.bincount(langid.grams(r.text), minlength=langid.BUCKETS)
    for k, la in enumerate(model.languages):
        want = np.log((counts[la] + langid.ALPHA) / (counts[la].sum() + langid.ALPHA * langid.BUCKETS))
        assert np.allclose(model.log_prob[k], want, atol=1e-5)


def test_language_of_awkward_rows(spark):
    df = documents(spark)
    got = rows_of(langid.predict(df, langid.fit(df)))
    assert len(got) == len(TEXTS) and list(got[0]) == [c for c in df.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    for r in got:
        blank = not any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1 and (not blank or r["score"] == 0)
    nothing = langid.fit(df.where("lang is null"))
    assert {r["lang_pred"] for r in rows_of(langid.predict(df, nothing, keep=["doc_id"]))} == {"und"}


@pytest.fixture(scope="module")
def model_file():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_are_the_librarys(spark, model_file):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    got = rows_of(tokens.token_counts(documents(spark), model_file, segment=500, batch_bytes=900))
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in TEXTS)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want


@pytest.mark.parametrize("text", [LONG, "a  b " * 300, "ab▁ c" * 200, " " * 900, "x" * 900, "<s> a</s> " * 100, "a\n b\t c " * 200, "q " * 400 + " "])
def test_segments_add_up(model_file, text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    assert tokens.splits_at_space(model)
    parts = list(tokens.segments(text, 40))
    assert " ".join(parts) == text
    assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text))


def test_jaccard_on_awkward_rows(spark):
    got = rows_of(jaccard.near_duplicates(documents(spark)))
    want = jaccard_components([(i, t) for i, t, *_ in TEXTS])
    assert len(got) == len(TEXTS)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def near_copies(n, seed, length=60, edits=3):
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(length)]
    passage = [f"p{k}" for k in range(30)]
    out = [(0, " ".join(base))]
    for i in range(1, n):
        words = list(base) if i % 2 else [f"r{x}" for x in rng.integers(0, 10**6, 45)] + passage
        for at in rng.integers(0, len(words), rng.integers(0, edits + 1)):
            words[at] = f"e{i}_{at}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("rounds", [0, 6])
def test_jaccard_of_a_large_group_and_a_shared_passage(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    rows = near_copies(400, 3)
    df = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.near_duplicates(df))}
    assert got == jaccard_components(rows)


def test_jaccard_on_the_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.near_duplicates(df))}
    assert got == jaccard_components([(r.doc_id, r.text) for r in df.collect()])
    assert jaccard.drop_near_copies(df).count() == len({c for _, c in got.values()})


def test_an_id_with_several_texts_loses_only_near_copies(spark):
    words = [f"w{k}" for k in range(60)]
    near, alone = " ".join(words[:-1] + ["end"]), " ".join(f"u{k}" for k in range(40))
    df = documents(spark, [(1, " ".join(words), "en", "a"), (2, near, "en", "a"), (2, alone, "en", "a"), (2, alone, "fr", "a"), (2, None, "en", "a"), (3, near, "en", "a"), (4, alone, "en", "b"), (3, "", "en", "a")])
    got = jaccard.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, " ".join(words)), (2, ""), (2, alone), (2, alone), (3, "")]


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    plain = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows, labels = [], []
    for i in range(2400):
        words = list(rng.choice(plain, 20))
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["oaf"] * insult + ["tribe"] * group
        rows.append((i, " ".join(rng.permutation(words)), "en", "a"))
        labels.append((i, int(insult and group)))
    df, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r["score"] for r in rows_of(toxicity.predict(df, model))}
    held = [(got[i], y) for i, y in labels if i % 4 == 2]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95  # the pair, not either word


@pytest.mark.parametrize("train_rows", [20_000, 500])
def test_toxicity_of_a_rare_insult(spark, train_rows):
    """Seven of 4,000 documents hold it; few of them, or none, are among the rows of the gradient steps."""
    rng = np.random.default_rng(3)
    plain = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rare = {500 * k + 7 for k in range(7)}
    rows, labels = [], []
    for i in range(4000):
        common = i not in rare and rng.random() < 0.05
        rows.append((i, " ".join([*rng.choice(plain, 20), *["oaf"] * common, *["churl"] * (i in rare)]), "en", "a"))
        labels.append((i, int(common or i in rare)))
    usual = " ".join(rng.choice(plain, 20))
    new = [(9000, f"{usual} churl", "en", "a"), (9001, usual, "en", "a"), (9002, f"{usual} oaf", "en", "a")]
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), train_rows=train_rows)
    got = {r["doc_id"]: r["score"] for r in rows_of(toxicity.predict(documents(spark, new), model))}
    assert got[9000] > 5 * got[9001] and got[9001] < 0.3 <= got[9002]  # seven are shrunk, but no longer nothing


def test_toxicity_of_awkward_rows(spark):
    df = documents(spark)
    marks = spark.createDataFrame([(1, 0), (7, 1), (7, 0), (9, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    got = rows_of(toxicity.predict(df, model, keep=["doc_id"]))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.predict(df, toxicity.fit(df, marks.limit(0)), keep=["doc_id"]).count() == len(TEXTS)


def test_empty_tables(spark, model_file):
    none = documents(spark).limit(0)
    assert exact.exact_groups(none).count() == exact.drop_copies(none).count() == 0
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert tokens.token_counts(none, model_file).count() == 0
    assert jaccard.near_duplicates(none).count() == jaccard.drop_near_copies(none).count() == 0
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.predict(none, toxicity.fit(none, marks)).count() == 0
